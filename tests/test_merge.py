"""A batch of sightings against merging them one by one, written out here."""

from __future__ import annotations

import random

import pytest
from test_rules import AT, state_rows

from tidemark import registry
from tidemark.operators import merge

BATCH = (
    "giveaway_id long, ordinal long, canonical_url string, source_id long, title string, raw_excerpt string, prize string, wanted_prize boolean, entry_url string, platform string, platform_campaign_id string, "
    "link_hints array<string>, content_hash string, status string, seen_at timestamp_ntz"
)
NAMES = [x.split()[0] for x in BATCH.split(", ")]
COMPARED = ("canonical_url", "source_id", "title", "raw_excerpt", "prize", "wanted_prize", "entry_url", "platform", "platform_campaign_id", "link_hints", "content_hash", "status", "manual_status", "last_seen_at", "discovered_at", "analyzed_at")


def one_by_one(state, sightings):
    """The rules for one sighting, applied to each in turn."""
    rows = {r["id"]: dict(r) for r in state}
    for s in sorted(sightings, key=lambda x: (x["seen_at"], x["ordinal"])):
        old = rows.get(s["giveaway_id"])
        if old is None:
            fresh = {k: s[k] for k in NAMES if k not in ("giveaway_id", "ordinal", "seen_at")}
            rows[s["giveaway_id"]] = fresh | {"manual_status": "none", "last_seen_at": s["seen_at"], "discovered_at": s["seen_at"], "analyzed_at": None}
            continue
        differs, done = old["content_hash"] != s["content_hash"], old["analyzed_at"] is not None
        either = lambda a, b: b if a is None else a
        for c in ("title", "raw_excerpt"):
            if old[c] is None:
                old[c] = s[c]
            elif differs:
                old[c] = either(s[c], old[c])
        if differs and s["link_hints"]:
            old["link_hints"] = s["link_hints"]
        old["entry_url"] = either(s["entry_url"], old["entry_url"])
        for c in ("source_id", "platform", "platform_campaign_id"):
            old[c] = either(old[c], s[c])
        old["prize"] = either(old["prize"], s["prize"]) if done else either(s["prize"], old["prize"])
        old["wanted_prize"] = old["wanted_prize"] if done else either(s["wanted_prize"], old["wanted_prize"])
        if not done and s["status"] in ("rejected", "expired"):
            old["status"] = s["status"]
        old["content_hash"], old["last_seen_at"] = s["content_hash"], s["seen_at"]
    return rows


def some(rng, *values):
    return rng.choice([None, *values])


@pytest.mark.parametrize("seed", [1, 2])
def test_a_batch_is_its_sightings_one_by_one(spark, seed):
    rng = random.Random(seed)
    state = [
        dict(id=i, canonical_url=f"u{i}", title=some(rng, "T0"), raw_excerpt=some(rng, "E0"), prize=some(rng, "P0"), wanted_prize=some(rng, True, False), source_id=some(rng, 1), platform=some(rng, "gleam"), link_hints=["l0"], content_hash=rng.choice("abc"), status="candidate", manual_status="entered", last_seen_at=AT(0), discovered_at=AT(0), analyzed_at=some(rng, AT(0)))
        for i in range(60)
    ]
    sightings = [
        dict(
            giveaway_id=rng.randint(0, 90), ordinal=n, canonical_url=f"s{n}", source_id=some(rng, 7, 8), title=some(rng, f"T{n}"), raw_excerpt=some(rng, f"E{n}"), prize=some(rng, f"P{n}"), wanted_prize=some(rng, True, False), entry_url=some(rng, f"x{n}"),
            platform=some(rng, "gleam", "other"), platform_campaign_id=some(rng, "k"), link_hints=rng.choice([None, [], [f"l{n}"]]), content_hash=rng.choice("abc"), status=rng.choice(["candidate", "candidate", "rejected", "expired"]), seen_at=AT(rng.randint(1, 3)),
        )
        for n in range(400)
    ]
    known = state_rows(spark, *state)
    batch = spark.createDataFrame([tuple(s[n] for n in NAMES) for s in sightings], BATCH).repartition(5)
    blank = dict.fromkeys(known.columns)
    wanted = one_by_one([{**blank, **r} for r in state], sightings)
    got = {r.id: r.asDict() for r in merge.merge_crawl(known, batch).collect()}
    assert set(got) == set(wanted)
    for i, row in wanted.items():
        assert {c: got[i][c] for c in COMPARED} == {c: row[c] for c in COMPARED}, i


def test_plans_stay_small(spark):
    """Exchanges of what is left to run once the identities are stored."""
    d = "/root/testdata/sf0.001"
    found = registry.resolved(spark, d)
    text = lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert text(found).count("Exchange") <= 5 and "RLike" not in text(found)
    assert text(merge.merge_crawl(registry.state(spark, d), found)).count("Exchange") <= 8

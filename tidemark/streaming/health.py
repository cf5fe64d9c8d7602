"""The polling worker's folds as streams; each has a batch twin in the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.merge import BACKOFF_MINUTES, BACKOFF_MOST, link_outcome

_HEALTH = "source_id long, consecutive_failures long, last_run_at timestamp, backoff_minutes long"


def stream_last_seen(sightings: DataFrame) -> DataFrame:
    """First and last time of each (giveaway, source); an update-mode aggregate, so state is one row a key."""
    return sightings.groupBy("giveaway_id", "source_id").agg(F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"))


def stream_counters(events: DataFrame, at: str = "started_at", late: str = "2 days") -> DataFrame:
    """Runs, pages and errors of each day; rows later than the watermark are left out, and closed days are appended once."""
    day = F.window(at, "1 day")
    counts = events.withWatermark(at, late).groupBy(day).agg(F.count(F.lit(1)).alias("runs"), F.sum("pages_fetched").alias("pages"), F.sum("errors_count").alias("errors"))
    return counts.select(F.col("window.start").alias("day"), "runs", "pages", "errors")


def stream_dedup(candidates: DataFrame, at: str = "seen_at", late: str = "1 day") -> DataFrame:
    """The first sighting of each canonical URL within the watermark."""
    return candidates.withWatermark(at, late).dropDuplicatesWithinWatermark(["canonical_url"])


#: What a fold keeps of a key: the last reset, the counted events since then (one by one while rows may still come before them, else as a number), and the latest event.
_STREAK = "reset_at long, reset_id long, settled long, ats array<long>, ids array<long>, last_at long, last_id long"
_EMPTY = (-1, -1, 0, [], [], -1, -1)


def _streak(kept: tuple, events: list[tuple[int, int, bool, bool]], late_micros: int) -> tuple:
    """The kept state after events ``(at, id, resets, counts)`` in any order.

    Events counted since the last reset stay one by one for ``late_micros`` behind the latest event,
    so a late reset or failure falls into its place; what comes later than that is left out.
    """
    reset, settled, last = (kept[0], kept[1]), kept[2], (kept[5], kept[6])
    open_ = set(zip(kept[3], kept[4], strict=True))
    too_late = last[0] - late_micros
    last = max([last, *((at, i) for at, i, *_ in events)])
    for at, i, resets, counts in events:
        if at < too_late or (at, i) <= reset:
            continue
        if resets:
            # Settled events are older than any that may still come, so a reset is behind them all.
            reset, settled, open_ = (at, i), 0, {x for x in open_ if x > (at, i)}
        elif counts:
            open_.add((at, i))
    old = {x for x in open_ if x[0] < last[0] - late_micros}
    open_ = sorted(open_ - old)
    return (*reset, settled + len(old), [x[0] for x in open_], [x[1] for x in open_], *last)


def _expire(state: GroupState, kept: tuple) -> None:
    """Let the state go once the watermark passes its latest event."""
    state.setTimeoutTimestamp(max(kept[5] // 1000, state.getCurrentWatermarkMs() + 1))


def _micros(interval: str) -> int:
    return int(pd.Timedelta(interval).value // 1000)


def stream_source_health(runs: DataFrame, late: str = "7 days", keep: str = "90 days") -> DataFrame:
    """Failures in a row and the back-off of each source, updated by micro-batch.

    Rows that come up to ``late`` behind a source's latest run are counted in their place; later
    ones are left out. A source is forgotten, and begins anew, when the stream is ``keep`` past its
    latest run; rows that far behind the stream are left out.
    """
    horizon = _micros(late)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames))
        events = [(r.started_at.value // 1000, int(r.id), not r.failed, bool(r.failed)) for r in rows.itertuples()]
        now = _streak(state.get if state.exists else _EMPTY, events, horizon)
        state.update(now)
        _expire(state, now)
        failures = now[2] + len(now[3])
        wait = min(BACKOFF_MINUTES * 2 ** min(failures - 1, 20), BACKOFF_MOST) if failures else 0
        yield pd.DataFrame({"source_id": [key[0]], "consecutive_failures": [failures], "last_run_at": [pd.Timestamp(now[5] * 1000)], "backoff_minutes": [wait]})

    keyed = runs.select("source_id", "id", F.col("started_at").cast("timestamp"), "failed").withWatermark("started_at", keep)
    return keyed.groupBy("source_id").applyInPandasWithState(fold, _HEALTH, _STREAK, "update", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now and give its table; for batch use and tests."""
    spark = stream.sparkSession
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


_LINKS = "giveaway_id long, entry_check_fail_count long, entry_url_status string, checked_at timestamp, rejected boolean"


def stream_link_health(checks: DataFrame, late: str = "7 days", keep: str = "90 days") -> DataFrame:
    """Failures since the last live check, the latest outcome and whether any was gone, of each giveaway.

    Rows that come up to ``late`` behind a giveaway's latest check are counted in their place; later
    ones are left out. A giveaway is forgotten, and begins anew, when the stream is ``keep`` past its
    latest check; rows that far behind the stream are left out.
    """
    horizon = _micros(late)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames))
        *kept, status, gone = state.get if state.exists else (*_EMPTY, "", False)
        events = [(r.checked_at.value // 1000, int(r.check_id), r.outcome == "live", r.outcome in ("temporary_error", "gone")) for r in rows.itertuples()]
        now = _streak(tuple(kept), events, horizon)
        latest = {(at, i): o for (at, i, *_), o in zip(events, rows["outcome"], strict=True)}.get((now[5], now[6]), status)
        gone = bool(gone or any(o == "gone" and e[0] >= kept[5] - horizon for e, o in zip(events, rows["outcome"], strict=True)))
        state.update((*now, latest, gone))
        _expire(state, now)
        yield pd.DataFrame({"giveaway_id": [key[0]], "entry_check_fail_count": [now[2] + len(now[3])], "entry_url_status": [latest], "checked_at": [pd.Timestamp(now[5] * 1000)], "rejected": [gone]})

    keyed = checks.select("giveaway_id", "check_id", F.col("checked_at").cast("timestamp"), link_outcome(F.col("http_status")).alias("outcome")).withWatermark("checked_at", keep)
    return keyed.groupBy("giveaway_id").applyInPandasWithState(fold, _LINKS, f"{_STREAK}, status string, gone boolean", "update", GroupStateTimeout.EventTimeTimeout)


def stream_last_day(events: DataFrame, at: str = "started_at", late: str = "2 days") -> DataFrame:
    """Runs, pages and errors of the 24 hours up to each full hour; exact to that hour, closed windows are appended once."""
    counts = events.withWatermark(at, late).groupBy(F.window(at, "24 hours", "1 hour")).agg(F.count(F.lit(1)).alias("runs"), F.sum("pages_fetched").alias("pages"), F.sum("errors_count").alias("errors"))
    return counts.select(F.col("window.end").alias("up_to"), "runs", "pages", "errors")


def stream_reminders(changes: DataFrame, late: str = "1 hour") -> DataFrame:
    """``(giveaway_id, remind_at)`` once a reminder is due by the stream's time: some whole hours (1 to 720) after the latest change, unless that change cleared it or the giveaway is ignored.

    ``changes(giveaway_id, change_id, changed_at, hours, manual_status)``; state is three values a
    giveaway and goes once it is due.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at = state.get[2]
            state.remove()
            yield pd.DataFrame({"giveaway_id": [key[0]], "remind_at": [pd.Timestamp(at * 1000)]})
            return
        last, last_id, due = state.get if state.exists else (-1, -1, -1)
        for r in pd.concat(list(frames)).itertuples():
            at = r.changed_at.value // 1000
            hours = None if pd.isna(r.hours) else int(r.hours // 1)
            if (at, r.change_id) <= (last, last_id) or (hours is not None and not 1 <= hours <= 720):
                continue
            last, last_id, due = at, int(r.change_id), -1 if hours is None or r.manual_status == "ignored" else at + hours * 3_600_000_000
        state.update((last, last_id, due))
        if due >= 0:
            # Timers run behind the watermark: one that has passed already is due with the next batch.
            state.setTimeoutTimestamp(max(due // 1000, state.getCurrentWatermarkMs() + 1))
        return
        yield

    keyed = changes.select("giveaway_id", "change_id", F.col("changed_at").cast("timestamp"), "hours", "manual_status").withWatermark("changed_at", late)
    return keyed.groupBy("giveaway_id").applyInPandasWithState(fold, "giveaway_id long, remind_at timestamp", "last long, last_id long, due long", "append", GroupStateTimeout.EventTimeTimeout)

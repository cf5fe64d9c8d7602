"""Entry actions: their class, and what a campaign's actions say about entering it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.acceptability import REASON, verdict
from tidemark.functions.campaigns import action_category
from tidemark.functions.logic import is_true, let

# Action types by class, and fragments that hint at one.
NON_PUBLIC = (
    "visit_website", "visit_page", "visit", "click", "hidden", "bonus", "custom_action", "choose_image", "question", "trivia", "quiz", "poll", "email_subscribe",
    "email_submit", "newsletter", "register", "signup", "login", "account", "twitter_follow", "instagram_follow", "tiktok_follow", "youtube_subscribe", "twitch_follow",
    "spotify_follow", "facebook_like", "facebook_visit", "facebook_check_in", "instagram_visit_profile", "instagram_view_post", "tiktok_view_video",
    "youtube_visit_channel", "youtube_watch_video", "spotify_listen", "discord_join_server", "discord_join", "pinterest_follow", "linkedin_follow", "soundcloud_follow",
)
PUBLIC = (
    "twitter_retweet", "twitter_tweet", "twitter_hashtags", "twitter_comment", "twitter_reply", "twitter_quote", "facebook_share", "facebook_comment", "facebook_post",
    "instagram_comment", "instagram_upload_photo", "instagram_post", "instagram_story", "tiktok_comment", "tiktok_share", "tiktok_post", "share_action", "upload_file",
    "upload_image", "upload_video", "media_upload", "submit_content", "blog", "essay", "creative", "video_submit", "photo_submit", "referral", "refer_friend",
    "custom_refer", "public_referral",
)
NON_PUBLIC_PARTS = (
    "follow", "subscribe", "newsletter", "email", "visit", "watch", "listen", "view_post", "view_video", "join_server", "discord", "login", "sign_up", "signup",
    "register", "question", "trivia", "checkbox",
)
PUBLIC_PARTS = (
    "comment", "retweet", "tweet", "hashtag", "share", "repost", "reshare", "story", "upload", "submit_content", "tag_friend", "tag_a_friend", "mention", "quote",
    "refer", "referral",
)
#: Fragments of a mandatory action that make an entry hard.
CREATIVE = "blog|essay|creative|video_submit|photo_submit"
#: Action types that are easy beside those that email, visit or are of no category.
EASY = ("email_subscribe", "newsletter", "visit_website", "visit_page", "hidden", "bonus", "custom_action", "question", "choose_image")


def action_class(entry_type: Column) -> Column:
    """non_public, public_social or unknown: by exact type, then by its fragments; following and subscribing win over public fragments."""
    t = F.lower(F.trim(F.coalesce(entry_type, F.lit(""))))
    public, private = t.rlike("|".join(PUBLIC_PARTS)), t.rlike("|".join(NON_PUBLIC_PARTS))
    return (
        F.when(t == "", "unknown")
        .when(t.isin(*NON_PUBLIC), "non_public")
        .when(t.isin(*PUBLIC), "public_social")
        .when(public & ~private, "public_social")
        .when(private & ~public, "non_public")
        .when(t.rlike("follow|subscribe"), "non_public")
        .when(public, "public_social")
        .otherwise("unknown")
    )


def platform_counts(actions: DataFrame) -> DataFrame:
    """Per campaign: actions by class, mandatory ones by class, and the quota of actions required."""
    c = F.col
    must = F.coalesce(c("mandatory"), F.lit(False))
    return actions.withColumn("kind", action_class(c("entry_type"))).groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("actions"),
        F.count_if(c("kind") == "non_public").alias("non_public"),
        F.count_if(c("kind") == "public_social").alias("public_social"),
        F.count_if(c("kind") == "unknown").alias("unknown"),
        F.count_if((c("kind") == "public_social") & must).alias("mandatory_public"),
        F.count_if((c("kind") == "non_public") & must).alias("mandatory_non_public"),
        F.max("actions_required").alias("quota"),
    )


def _verdict_name(non_public: Column, public: Column, unknown: Column, mandatory_public: Column, quota: Column) -> Column:
    """accept, reject or inconclusive, from the counts of a campaign's actions.

    A mandatory public action rejects. With a quota the other actions, unknown ones included, must
    fill it, and public ones that would be needed reject. Without a quota any private action
    accepts, only public ones reject, only unknown ones accept.
    """
    asked = F.coalesce(quota, F.lit(0)) > 0
    return (
        F.when(mandatory_public > 0, "reject")
        .when(asked & (non_public + unknown >= quota), "accept")
        .when(asked & (public > 0), "reject")
        .when(asked, "inconclusive")
        .when(non_public > 0, "accept")
        .when((public > 0) & (unknown == 0), "reject")
        .when((unknown > 0) & (public == 0), "accept")
        .otherwise("inconclusive")
    )


def _said(name: Column, public: Column, non_public: Column, signals: Column | None = None) -> Column:
    """What a verdict says; null where it is inconclusive."""
    known = {"public_available": public > 0, "non_public": non_public, "signals": signals}
    return F.when(name == "accept", verdict(False, True, None, has_path=True, **known)).when(name == "reject", verdict(True, False, REASON, has_path=False, **known))


def platform_verdict(actions: DataFrame) -> DataFrame:
    """Per campaign ``verdict`` (accept, reject or inconclusive), what it says (:mod:`~tidemark.functions.acceptability`) as ``says``, and the counts."""
    c = F.col
    name = _verdict_name(c("non_public"), c("public_social"), c("unknown"), c("mandatory_public"), c("quota"))
    counted = platform_counts(actions).withColumn("verdict", name)
    return counted.withColumn("says", _said(c("verdict"), c("public_social"), c("non_public"))).select("campaign_id", "non_public", "public_social", "unknown", "verdict", "says")


def _mandatory(a: Column) -> Column:
    return F.coalesce(a["mandatory"], F.lit(False))


def array_verdict(actions: Column, quota: Column) -> Column:
    """:func:`platform_verdict`'s ``says`` of one campaign's own array of ``(entry_type, mandatory)``; null where it has none or they say nothing.

    Signals are the public actions that must be done, or else those and the first eight public ones.
    """
    classed = F.transform(actions, lambda a: F.struct(F.coalesce(a["entry_type"], F.lit("unknown")).alias("label"), action_class(a["entry_type"]).alias("kind"), _mandatory(a).alias("must")))

    def judged(a: Column) -> Column:
        of = lambda kind: F.filter(a, lambda x: x["kind"] == kind)
        labels = lambda xs: F.transform(xs, lambda x: x["label"])
        n = lambda kind: F.size(of(kind)).cast("long")
        must = labels(F.filter(of("public_social"), lambda x: x["must"]))
        every = F.concat(must, F.slice(labels(of("public_social")), 1, 8))
        name = _verdict_name(n("non_public"), n("public_social"), n("unknown"), F.size(must), quota)
        return _said(name, n("public_social"), n("non_public"), F.array_distinct(F.when(F.size(must) > 0, must).otherwise(every)))

    return F.when(F.size(actions) > 0, let(classed, judged))


def _friction_name(paid: Column, heavy: Column, login: Column, asked: Column, n: Column, social: Column, easy: Column) -> Column:
    """From what a campaign asks for (the quota, or the mandatory actions), and how many of the mandatory actions are heavy, social and easy."""
    return (
        F.when(is_true(paid) | (heavy > 0) | (asked >= 6) | (social >= 4), "hard")
        .when(is_true(login) | (asked >= 3) | (social >= 2), "medium")
        .when((asked <= 2) & ((n <= 2) | (easy == n)), "easy")
        .when(asked <= 4, "medium")
        .otherwise("unknown")
    )


def _easy(entry_type: Column) -> Column:
    return action_category(entry_type).isin("email", "visit", "other") | entry_type.isin(*EASY)


def _heavy(entry_type: Column) -> Column:
    return action_category(entry_type).isin("referral", "upload") | F.lower(entry_type).rlike(CREATIVE)


def array_friction(actions: Column, quota: Column, login: Column, paid: Column) -> Column:
    """:func:`platform_friction` of one campaign's own array of ``(entry_type, mandatory)``; null where there is no array."""
    must = F.filter(actions, _mandatory)

    def judged(a: Column) -> Column:
        n = F.size(a)
        count = lambda test: F.size(F.filter(a, lambda x: F.coalesce(test(x["entry_type"]), F.lit(False))))
        return _friction_name(paid, count(_heavy), login, F.coalesce(quota, n), n, count(lambda t: action_category(t) == "social"), count(_easy))

    return F.when(actions.isNotNull(), let(must, judged))


def platform_friction(actions: DataFrame, campaigns: DataFrame) -> DataFrame:
    """``(campaign_id, friction)`` of ``campaigns(campaign_id, login_required, has_paid)`` by their actions ``(campaign_id, entry_type, mandatory, actions_required)``.

    Paid ways, and mandatory referrals, uploads or own works, are hard. Else it counts how many
    actions are asked for (the quota, or the mandatory ones), and how many of them are social.
    """
    c = F.col
    counted = actions.withColumn("must", F.coalesce(c("mandatory"), F.lit(False))).groupBy("campaign_id").agg(
        F.count_if("must").alias("n"),
        F.count_if(c("must") & (action_category(c("entry_type")) == "social")).alias("social"),
        F.count_if(c("must") & _heavy(c("entry_type"))).alias("heavy"),
        F.count_if(c("must") & _easy(c("entry_type"))).alias("easy"),
        F.max("actions_required").alias("quota"),
    )
    rows = campaigns.join(counted, "campaign_id", "left").fillna(0, ["n", "social", "heavy", "easy"])
    return rows.select("campaign_id", _friction_name(c("has_paid"), c("heavy"), c("login_required"), F.coalesce("quota", "n"), c("n"), c("social"), c("easy")).alias("friction"))

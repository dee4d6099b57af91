"""Chat messages and social posts from JSON, wholly in built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of sources and how each can be fetched (fixed values).
KINDS = {"imap": "email", "outlook": "email", "telegram": "chat", "instagram": "social", "facebook": "social", "x": "social"}
MODES = {"imap": ("incremental", "range", "last"), "telegram": ("incremental",), "instagram": ("incremental", "last"), "facebook": ("incremental", "last"), "x": ("incremental", "last"), "outlook": ()}
#: Names under which platforms give the same thing, the first that is there counts.
ALIASES = {
    "post_id": ("id", "postId", "id_str", "shortCode"),
    "url": ("url", "postUrl", "facebookUrl", "twitterUrl"),
    "text": ("text", "caption", "full_text", "message"),
    "account": ("ownerUsername", "pageName", "author.userName", "user.username"),
    "posted": ("timestamp", "time", "createdAt", "created_at"),
}


def kind_of(source_type: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), source_type)


def _first(payload: Column, paths: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object(payload, f"$.{p}"), F.lit("")) for p in paths])


def moment(value: Column) -> Column:
    """An instant from seconds, ISO or the long form with the weekday; else null."""
    long_form = F.regexp_replace(value, "^[A-Za-z]{3} ", "")
    return F.coalesce(
        F.when(value.rlike(r"^\d{9,11}$"), F.timestamp_seconds(value.try_cast("long"))),
        F.when(value.rlike(r"^\d{4}-"), F.try_to_timestamp(value)),
        F.try_to_timestamp(long_form, F.lit("MMM dd HH:mm:ss xx yyyy")),
    )


def posts(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """`raw` with post_id, url, text, account, posted_at and media (addresses
    without repeats, in order) of each payload; null where there is none."""
    p = F.col(payload)
    lists = [F.from_json(F.get_json_object(p, f"$.{k}"), "array<string>") for k in ("images", "videoUrls", "media")]
    one = F.array(F.get_json_object(p, "$.displayUrl"), F.get_json_object(p, "$.videoUrl"))
    media = F.array_distinct(F.filter(F.concat(one, *[F.coalesce(x, F.array().cast("array<string>")) for x in lists]), lambda u: u.isNotNull()))
    named = {name: _first(p, paths) for name, paths in ALIASES.items()}
    return raw.withColumns({**{k: v for k, v in named.items() if k != "posted"}, "posted_at": moment(named["posted"]), "media": media})


def chats(raw: DataFrame, payload: str = "payload", direct: bool = False) -> DataFrame:
    """Chat messages: chat, sender, text, what it answers. Direct chats, and those
    of an unknown kind, are left out unless asked for."""
    get = lambda k: F.get_json_object(F.col(payload), f"$.{k}")
    kind = F.when(get("chat_kind").isin("group", "supergroup", "channel"), get("chat_kind")).otherwise("direct")
    rows = raw.withColumns(
        {
            "chat_id": get("chat_id").try_cast("long"), "chat_kind": kind, "chat_title": get("chat_title"), "message_id": get("message_id").try_cast("long"),
            "sender_id": get("sender.user_id").try_cast("long"), "sender": F.coalesce(get("sender.display_name"), get("sender.username")), "text": get("text"), "reply_to": get("reply_to").try_cast("long"),
        }
    )
    return rows if direct else rows.where("chat_kind <> 'direct'")


def newer(rows: DataFrame, cursors: DataFrame, account: str = "account", at: str = "posted_at", ident: str = "post_id") -> DataFrame:
    """Rows beyond the cursor (account, seen_at, seen_id) of their account: later,
    or at the same instant with another id; all of an account without one."""
    c = cursors.select(F.col("account").alias(account), "seen_at", "seen_id")
    beyond = F.col("seen_at").isNull() | (F.col(at) > F.col("seen_at")) | ((F.col(at) == F.col("seen_at")) & (F.col(ident) != F.col("seen_id")))
    return rows.join(c, account, "left").where(beyond).drop("seen_at", "seen_id")


def advanced(rows: DataFrame, account: str = "account", at: str = "posted_at", ident: str = "post_id") -> DataFrame:
    """The cursors after these rows: the latest of each account, the largest id on a tie."""
    last = F.max(F.struct(F.col(at).alias("seen_at"), F.col(ident).alias("seen_id"))).alias("x")
    return rows.groupBy(F.col(account).alias("account")).agg(last).select("account", "x.*")


def saturated(count: Column, limit: int) -> Column:
    """A window that came back full may hide a gap."""
    return count >= limit


def first_reason(*tests: tuple[Column, str]) -> Column:
    """The label of the first test that holds."""
    return reduce(lambda rest, t: F.when(t[0], F.lit(t[1])).otherwise(rest), reversed(tests), F.lit(None).cast("string"))

"""Who sent a message: by the medium's own rules, against a stored directory.

Chats bring people: a sender's number on the platform is what tells them apart, and
one that is new becomes a person, unless the user name is known, which then gets the
number too. Accounts of posts become entries of a kind that is still open. Mail makes
no entries for people: a known address is its owner; a corporate or free address that
isn't known stays open; an address of a role speaks for the organisation of its
domain, which is the domain's owner or the one that the sender's name names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import identifiers as I
from tracelake.functions import text as T
from tracelake.operators.ingest import numbered
from tracelake.operators.joins import similar_names
from tracelake.operators.latest import first_per_key
from tracelake.shared import written
from tracelake.store import Snapshot, Store, Table

DIRECTORY_TABLES = {
    "identities": Table("id long, kind string, name string", ("id",), ("id",)),
    "identifiers": Table("platform string, kind string, value string, id long", ("platform", "kind", "value"), ("platform", "kind", "value")),
}
PERSON, COMPANY, OPEN = "person", "company", "unknown"
KEYS = ["platform", "kind", "value"]


def keyed(messages: DataFrame) -> DataFrame:
    """Messages with the identifier that tells their sender: (message, medium, platform,
    kind, value, handle, name, role). Messages without one are left out."""
    m, low = messages, F.lower(F.trim("email"))
    host = F.substring_index(low, "@", -1)
    mail = m.where("medium = 'email'").where(F.contains(low, F.lit("@")) & (host != "")).select(
        "message", "medium", F.when(I.is_role(low), "domain").otherwise("email").alias("platform"), F.when(I.is_role(low), "domain").otherwise("email").alias("kind"),
        F.when(I.is_role(low), I.registrable_domain(host)).otherwise(I.email(low)).alias("value"), F.lit(None).cast("string").alias("handle"), F.nullif(F.trim("name"), F.lit("")).alias("name"),
        (I.is_role(low) & ~I.is_free_mail(low)).alias("role"),
    )
    user = F.nullif(I.handle(F.col("account")), F.lit(""))
    shown = F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("@"), user), F.concat(F.lit("chat "), F.col("sender")))
    chat = m.where("medium = 'chat' AND sender IS NOT NULL AND NOT coalesce(bot, false)").select(
        "message", "medium", F.lit("chat").alias("platform"), F.lit("platform_id").alias("kind"), F.col("sender").alias("value"), user.alias("handle"), shown.alias("name"), F.lit(False).alias("role")
    )
    post = m.where("medium = 'social'").where(user.isNotNull() & (F.trim("platform") != "")).select(
        "message", "medium", F.lower(F.trim("platform")).alias("platform"), F.lit("handle").alias("kind"), user.alias("value"), F.lit(None).cast("string").alias("handle"), F.trim("account").alias("name"), F.lit(False).alias("role")
    )
    return mail.unionByName(chat).unionByName(post)


def resolved_senders(store: Store, base: Snapshot, messages: DataFrame) -> tuple[Snapshot, DataFrame]:
    """The directory after some messages, and (message, id, kind) of those whose sender is
    known then. `messages`: (message, medium: chat, social or email; sender, account,
    name, bot, platform, email). What a batch brings holds for the messages after it, in order of `message`."""
    rows = written(keyed(messages), "senders")
    known = base.table("identifiers", rows)
    found = written(rows.join(known, KEYS, "left"), "found")
    fresh = found.where("id IS NULL")

    # people of chats: one a number, with the last message's names; user names that are known, or shared by several numbers, are one entry
    last = first_per_key(fresh.where("medium = 'chat'"), ["value"], [F.desc("message")]).select("value", "handle", "name")
    handles = last.where("handle IS NOT NULL").select(F.lit("chat").alias("platform"), F.lit("handle").alias("kind"), F.col("handle").alias("value")).distinct()
    owners = base.table("identifiers", handles).join(handles, KEYS, "left_semi").select(F.col("value").alias("handle"), F.col("id").alias("owner"))
    people = last.join(owners, "handle", "left").select("value", "handle", "name", "owner", F.coalesce(F.concat(F.lit("@"), "handle"), F.concat(F.lit("#"), "value")).alias("as"))
    # accounts of posts: one each
    accounts = first_per_key(fresh.where("medium = 'social'"), ["platform", "value"], [F.col("message")])
    # roles: the first message of a domain with a name says whose it is
    named = first_per_key(fresh.where("role AND name IS NOT NULL"), ["value"], [F.col("message")]).select("value", "name", "message", T.org_core(F.col("name")).alias("core"))
    cores = base.table("identities").where(F.col("kind") == COMPANY).select("id", T.org_core(F.col("name")).alias("core")).where("core <> ''").groupBy("core").agg(F.min("id").alias("owner"))
    named = written(named.join(cores, "core", "left").withColumn("as", F.when(F.col("core") != "", F.col("core")).otherwise(F.concat(F.lit("#"), "value"))), "named")
    people, accounts = written(people, "people"), written(accounts, "accounts")

    new = first_per_key(people.where("owner IS NULL").withColumn("as", F.concat(F.lit("chat\t"), "as")), ["as"], [F.col("value")]).select(F.lit(0).alias("turn"), "as", F.col("value").alias("first"), F.lit(PERSON).alias("kind"), "name")
    new = new.unionByName(accounts.select(F.lit(1).alias("turn"), F.concat_ws("\t", F.lit("social"), "platform", "value").alias("as"), F.lpad(F.col("message").cast("string"), 20, "0").alias("first"), F.lit(OPEN).alias("kind"), "name"))
    org = first_per_key(named.where("owner IS NULL").withColumn("as", F.concat(F.lit("email\t"), "as")), ["as"], [F.col("message")])
    new = new.unionByName(org.select(F.lit(2).alias("turn"), "as", F.lpad(F.col("message").cast("string"), 20, "0").alias("first"), F.lit(COMPANY).alias("kind"), "name"))
    after = base.table("identities").agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0] + 1
    made = written(numbered(new.withColumn("_one", F.lit(0)), ["_one"], ["turn", "first", "as"]).withColumn("id", F.col("place") + after).select("as", "id", "kind", "name"), "new-identities")

    of = made.select("as", F.col("id").alias("new"))
    people = people.withColumn("as", F.concat(F.lit("chat\t"), "as")).join(of, "as", "left").withColumn("id", F.coalesce("owner", "new"))
    keys = people.select(F.lit("chat").alias("platform"), F.lit("platform_id").alias("kind"), "value", "id")
    firsts = first_per_key(people.where("owner IS NULL AND handle IS NOT NULL"), ["handle"], [F.col("value")])
    keys = keys.unionByName(firsts.select(F.lit("chat").alias("platform"), F.lit("handle").alias("kind"), F.col("handle").alias("value"), "id"))
    keys = keys.unionByName(accounts.drop("id").withColumn("as", F.concat_ws("\t", F.lit("social"), "platform", "value")).join(of, "as").select("platform", F.lit("handle").alias("kind"), "value", F.col("new").alias("id")))
    domains = named.withColumn("as", F.concat(F.lit("email\t"), "as")).join(of, "as", "left").select("value", F.coalesce("owner", "new").alias("id"), "message")
    keys = written(keys.unionByName(domains.select(F.lit("domain").alias("platform"), F.lit("domain").alias("kind"), "value", "id")), "new-identifiers")
    done = store.commit(base, {"identities": made.drop("as").withColumn("gone", F.lit(False)), "identifiers": keys.withColumn("gone", F.lit(False))})

    # a domain's messages before the first one with a name came when nobody was known for it
    since = domains.select(F.lit("email").alias("medium"), "value", F.col("message").alias("since"))
    now = fresh.drop("id").join(keys, KEYS).join(since, ["medium", "value"], "left").where("since IS NULL OR message >= since")
    every = found.where("id IS NOT NULL AND (kind <> 'domain' OR role)").select("message", "id").unionByName(now.select("message", "id"))
    kinds = done.table("identities", every).select("id", "kind")
    return done, every.join(kinds, "id").select("message", "id", "kind")


def domain_owners(mails: DataFrame, mentions: DataFrame, companies: DataFrame, most: int = 12, least: float = 0.55) -> DataFrame:
    """(domain, id, origin): companies that a domain might belong to. met: named in mails
    from the domain; alike: named like its first label; at most `most` of these, those
    that meet it most often first, then by id; above: what these stand under, over any
    number of steps. `mails`: (message, domain); `mentions`: (message, id); `companies`: (id, name, parent)."""
    mails = mails.where("domain <> ''")
    domains = mails.select("domain").distinct()
    ids = companies.select("id")
    met = mails.join(mentions, "message").groupBy("domain", "id").agg(F.count_distinct("message").alias("n")).join(ids, "id", "left_semi")
    labels = domains.select(F.col("domain").alias("key"), F.substring_index("domain", ".", 1).alias("name"))
    alike = similar_names(labels, companies.select(F.col("id").cast("string").alias("key"), "name"), "key", "name", least)
    alike = alike.select(F.col("a_id").alias("domain"), F.col("b_id").cast("long").alias("id"), F.lit(0).cast("long").alias("n"))
    direct = met.unionByName(alike).groupBy("domain", "id").agg(F.max("n").alias("n"))
    direct = first_per_key(direct, ["domain"], [F.desc("n"), F.col("id")], most)
    out = front = written(direct.select("domain", "id", F.when(F.col("n") > 0, "met").otherwise("alike").alias("origin")), "owners")
    parents = companies.where("parent IS NOT NULL").select("id", F.col("parent").alias("_up")).join(ids.withColumnRenamed("id", "_up"), "_up", "left_semi")
    while not front.isEmpty():
        up = front.join(parents, "id").select("domain", F.col("_up").alias("id")).distinct().join(out, ["domain", "id"], "left_anti")
        front = written(up.withColumn("origin", F.lit("above")), "owners")
        out = out.unionByName(front)
    return out

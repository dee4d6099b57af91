"""Mentions of people and organisations against those that are known.

A known identity has an id, kind, name and aliases; its identifiers a kind
(email, domain, handle), a platform and a value in normal form. A mention has an
id, kind (null: not known), name, email, handle and platform.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import identifiers as I
from tracelake.functions import text as T
from tracelake.operators.joins import joined, similar_names

#: Similarity from which a name is taken for the same one, and from which it is a candidate (fixed values).
SAME, CANDIDATE = 0.92, 0.55
PERSON, UNKNOWN = "person", "unknown"


def _group(kind: Column) -> Column:
    """Names are told apart between people, the unknown, and all others."""
    return F.when(kind.isin(PERSON, UNKNOWN), kind).otherwise(F.when(kind.isNotNull(), "other"))


def _first(df: DataFrame, keys: list[str], found: str) -> DataFrame:
    """The first identity of each key; `<found>_n` of them have it."""
    return df.groupBy(*keys).agg(F.min("identity").alias(found), F.count_distinct("identity").alias(f"{found}_n"))


def resolved(mentions: DataFrame, known: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, identity, method) of each mention: by its address; by the domain of its
    address, which is never a person and of no use for one; by its handle on its
    platform, or anywhere if only one has it; by its name, then an alias, among
    identities of its group; by those of an unknown one; for a mention of no
    kind, by a name or alias that only one has. Null where none is found.
    Addresses of roles say nothing. Of several, the smallest id."""
    email = I.email(F.col("email"))
    rows = mentions.select(
        "id", F.when(~I.is_role(email), email).alias("_email"), F.col("kind").alias("_kind"), _group(F.col("kind")).alias("_group"),
        F.when(F.col("handle") != "", I.handle(F.col("handle"))).alias("_handle"), F.col("platform").alias("_platform"), F.when(F.col("name") != "", T.match_key(F.col("name"))).alias("_name"),
    )
    rows = rows.withColumn("_domain", I.registrable_domain(F.substring_index("_email", "@", -1)))
    of = lambda kind: ids.where(F.col("kind") == kind).select(F.col("identity"), F.col("platform").alias("_platform"), F.col("value").alias(f"_{kind}"))
    people = known.where(F.col("kind") == PERSON).select(F.col("id").alias("identity"))
    names = known.select(F.col("id").alias("identity"), _group(F.col("kind")).alias("_group"), T.match_key(F.col("name")).alias("_name"))
    aliases = known.select(F.col("id").alias("identity"), _group(F.col("kind")).alias("_group"), F.explode("aliases").alias("_alias"))
    aliases = aliases.select("identity", "_group", T.match_key(F.col("_alias")).alias("_name"))
    steps = [
        (_first(of("email"), ["_email"], "by_email"), ["_email"]),
        (_first(of("domain").join(people, "identity", "left_anti"), ["_domain"], "by_domain"), ["_domain"]),
        (_first(of("handle"), ["_platform", "_handle"], "by_handle"), ["_platform", "_handle"]),
        (_first(of("handle"), ["_handle"], "any_handle"), ["_handle"]),
    ]
    for name, table in (("name", names), ("alias", aliases)):
        steps += [
            (_first(table, ["_group", "_name"], f"by_{name}"), ["_group", "_name"]),
            (_first(table.where(F.col("_group") == UNKNOWN), ["_name"], f"claim_{name}"), ["_name"]),
            (_first(table, ["_name"], f"any_{name}"), ["_name"]),
        ]
    for table, keys in steps:
        rows = rows.join(table, keys, "left")
    kind, claims = F.col("_kind"), F.col("_kind") != UNKNOWN
    one = lambda c: F.when(F.col(f"{c}_n") == 1, F.col(c))
    ladder = [
        ("email", F.col("by_email")), ("domain", F.when(kind.isNull() | (kind != PERSON), F.col("by_domain"))),
        ("handle", F.when(F.col("_platform").isNotNull(), F.col("by_handle")).otherwise(one("any_handle"))),
        ("exact_name", F.when(kind.isNotNull(), F.col("by_name"))), ("alias", F.when(kind.isNotNull(), F.col("by_alias"))),
        ("exact_name", F.when(claims, F.col("claim_name"))), ("alias", F.when(claims, F.col("claim_alias"))),
        ("exact_name", F.when(kind.isNull(), one("any_name"))), ("alias", F.when(kind.isNull(), one("any_alias"))),
    ]
    best = F.coalesce(*[F.when(found.isNotNull(), F.struct(found.alias("identity"), F.lit(method).alias("method"))) for method, found in ladder])
    return rows.select("id", best["identity"].alias("identity"), best["method"].alias("method"))


def alike(unresolved: DataFrame, known: DataFrame) -> DataFrame:
    """(id, identity, score, decision) of mentions (id, kind, name) that nothing
    settled: the known name of the same kind that is most alike, the one with the
    fewest edits and the smallest id on a tie; merge, candidate or new. What a name
    is like is looked up once a kind and name, however many mentions have it."""
    told = F.struct("kind", "name").alias("told")
    names = unresolved.select("kind", "name").distinct().select("kind", "name", told)
    targets = known.groupBy("kind", "name").agg(F.min("id").alias("id")).select("kind", "name", F.struct("kind", "name", "id").alias("told"))
    pairs = similar_names(names, targets, "told", "name", CANDIDATE, ("kind",))
    edits = F.levenshtein(F.substring("a_id.name", 1, 255), F.substring("b_id.name", 1, 255))
    best = pairs.groupBy("a_id").agg(F.min(F.struct(-F.col("score"), edits, F.col("b_id.id").alias("b_id"))).alias("x")).select("a_id.kind", "a_id.name", F.col("x.b_id").alias("identity"), (-F.col("x.col1")).alias("score"))
    often = unresolved.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("_n"))
    found = joined(unresolved.select("id", told), often.join(best, ["kind", "name"], "left").select(told, "identity", "score", "_n"), "told", "_n")
    decision = F.when(F.col("score") >= SAME, "merge").when(F.col("score").isNotNull(), "candidate").otherwise("new")
    return found.select("id", "identity", "score", decision.alias("decision"))


def upserted(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """`table` after changes with the same columns (etag, deleted among them): rows
    with the etag they had stay as they are, others are replaced or added; one that
    is deleted keeps its columns and is marked. `change` tells which."""
    new = changes.select([F.col(c).alias(c if c == key else f"_{c}") for c in table.columns])
    both = table.withColumn("_old", F.lit(True)).join(new, key, "full")
    change = (
        F.when(F.col("_etag").isNull(), "kept").when(F.col("_deleted"), "deleted").when(F.col("_old").isNull(), "added").when(F.col("etag") == F.col("_etag"), "kept").otherwise("updated")
    )
    taken = F.col("change").isin("added", "updated")
    fields = [F.when(F.col("change") == "deleted", True).otherwise(F.when(taken, F.col("_deleted")).otherwise(F.col("deleted"))).alias("deleted")]
    fields += [F.when(taken, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in table.columns if c not in (key, "deleted")]
    rows = both.withColumn("change", change).where("NOT (change = 'deleted' AND _old IS NULL)")
    return rows.select(key, *fields, "change")

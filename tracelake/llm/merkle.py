"""Merkle manifest of a table: a hash a row, a tree a group, a tree over the groups.

A parent is stored with its preimage, the concatenated hashes of its children (64
characters each). Parents are stored by bands of BAND levels: one row holds the
preimages of all parents under one node of the band's top, so a tree of n leaves
takes a job for each band, not for each level, and no row grows with n. Going
down again, each band's rows join the row above them (32 rows a key at most), so
a row of the lowest band has the preimages of all its ancestors up to the root,
and each leaf joins that row. A leaf's siblings are the preimages without its own
64-character slot; a root is folded by splicing the replaced hash into the slot,
hashing, and going on with the parent.

Everything is JVM-side. Places within a group come from ranges and their sizes,
so a group with a third of all rows is many tasks' work.

Defined results: rows with equal ids stand in the order of their hashes; null ids
come first; a null group is the first group; a single row is its own root, with
the hash of no siblings as its proof; an empty table has no rows. Null columns are
hashed as `-`. Further columns are neither hashed nor returned.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import table, union
from tracelake.operators.ingest import numbered
from tracelake.operators.joins import joined
from tracelake.shared import written

#: Characters of a hash in hex, and levels of a tree that one row of a band holds.
HEX = 64
BAND = 5

#: Columns of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    """Lowercase hex sha256 of a string's UTF-8 bytes."""
    return F.sha2(value.cast("binary"), 256)


def netstring(value: Column) -> Column:
    """The value with its number of bytes before it, or `-` for null, so that no two rows are spelled alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**changed: Column) -> Column:
    """Hash of a row of documents; `changed` replaces columns."""
    return digest(F.concat(*[netstring(changed.get(c, F.col(c))) for c in FIELDS]))


def depth(count: Column) -> Column:
    """Levels above so many leaves: how often they can be halved, rounded up, until one is left."""
    return F.length(F.bin(count - 1)) * (count > 1).cast("int")


class Tree(NamedTuple):
    """leaves: (grp, pos, hash, ...). bands, lowest first: (grp, pos, levels, preimages,
    hash), a row for each node at the band's top, with the preimages of the parents
    under it, an array for each level. tops: (grp, hash, levels)."""

    leaves: DataFrame
    bands: list[DataFrame]
    tops: DataFrame


def tree(rows: DataFrame) -> Tree:
    """Trees of (grp, id, hash, ...): a group's rows in order of id, then hash; every
    two consecutive nodes, or the last alone, have a parent, until one is left.
    Every table is written, so plans stay as small as a step."""
    leaves = written(numbered(rows, ["grp"], ["id", "hash"]).withColumnRenamed("place", "pos"), "merkle-leaves")
    sizes = leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("_n")).withColumn("levels", depth(F.col("_n")))
    nodes, bands, tops = joined(leaves.select("grp", "pos", "hash"), sizes, "grp", "_n"), [], []
    while True:
        done = BAND * len(bands)
        tops.append(nodes.where(F.col("levels") <= done).select("grp", "hash", "levels"))
        band = written(_band(nodes.where(F.col("levels") > done), done), "merkle-parents")
        if band.isEmpty():
            return Tree(leaves, bands, written(union(tops), "merkle-tops"))
        bands.append(band)
        nodes = band.select("grp", "pos", "levels", "hash")


def _band(nodes: DataFrame, done: int) -> DataFrame:
    """The parents of nodes that have `done` levels below them, by runs of 2^BAND nodes."""
    run = F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"])
    rows = nodes.groupBy("grp", F.shiftright("pos", BAND).alias("pos")).agg(F.max("levels").alias("levels"), run.alias("_h"))
    for level in range(BAND):
        more = F.col("levels") > done + level
        pairs = F.transform(F.sequence(F.lit(0), F.expr("CAST((size(_h) - 1) div 2 AS INT)")), lambda i: F.array_join(F.slice("_h", 2 * i + 1, F.lit(2)), ""))
        rows = rows.withColumn(f"_p{level}", F.when(more, pairs).otherwise(F.array().cast("array<string>")))
        rows = rows.withColumn("_h", F.when(more, F.transform(f"_p{level}", digest)).otherwise(F.col("_h")))
    return rows.select("grp", "pos", "levels", F.array(*[f"_p{level}" for level in range(BAND)]).alias("preimages"), F.col("_h")[0].alias("hash"))


def _steps(preimages: Column, pos: Column) -> Column:
    """From a node of a band, by its place, to the band's top: each parent's preimage and the slot in it."""
    steps = []
    for level in range(BAND):
        up = F.shiftright(pos.bitwiseAND(F.lit(2**BAND - 1)), level).cast("int")
        steps.append(F.struct(F.get(F.get(preimages, F.lit(level)), F.shiftright(up, 1)).alias("preimage"), up.bitwiseAND(F.lit(1)).alias("slot")))
    return F.filter(F.array(*steps), lambda x: x["preimage"].isNotNull())


def with_paths(of: Tree, above: DataFrame | None = None) -> DataFrame:
    """The leaves with `path`: for each ancestor, the lowest first, its preimage and
    the slot in it that the way from the leaf has. `above`, one row for each group
    with grp, path and more columns, goes on from the groups' tops; its other
    columns come too."""
    none = F.array().cast("array<struct<preimage:string,slot:int>>")
    if above is None:
        above = of.tops.select("grp", none.alias("path"))
    more = [c for c in above.columns if c not in ("grp", "path")]
    carried = above.withColumnRenamed("path", "_rest")
    # a group of one leaf has no parents
    upper = alone = of.tops.where("levels = 0").join(carried, "grp").select("grp", F.lit(0).cast("long").alias("_up"), F.array().cast("array<array<string>>").alias("_preimages"), "_rest", *more)
    for k, band in reversed(list(enumerate(of.bands))):
        at_top = F.col("levels") <= BAND * (k + 1)
        rows = band.where(at_top).select("grp", "pos", "preimages").join(carried, "grp")
        if k + 1 < len(of.bands):
            below = band.where(~at_top).select("grp", "pos", "preimages", F.shiftright("pos", BAND).alias("_up")).join(upper, ["grp", "_up"])
            rows = rows.unionByName(below.withColumn("_rest", F.concat(_steps(F.col("_preimages"), F.col("pos")), "_rest")).drop("_up", "_preimages"))
        rows = rows.select("grp", F.col("pos").alias("_up"), F.col("preimages").alias("_preimages"), "_rest", *more)
        if k == 0:
            rows = rows.unionByName(alone)
        upper = written(rows, "merkle-paths")
    inner = of.leaves.withColumn("_up", F.shiftright("pos", BAND)).join(upper, ["grp", "_up"])
    return inner.withColumn("path", F.concat(_steps(F.col("_preimages"), F.col("pos")), "_rest")).drop("_up", "_preimages", "_rest")


def _before(step: Column) -> Column:
    return F.substring(step["preimage"], F.lit(1), HEX * step["slot"])


def _after(step: Column) -> Column:
    return F.substring(step["preimage"], HEX * step["slot"] + HEX + 1, F.lit(HEX))


def siblings(path: Column) -> Column:
    """The hashes beside the way, from the leaf up: each preimage without the way's own slot."""
    return F.array_join(F.transform(path, lambda x: F.concat(_before(x), _after(x))), "")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's hash gives with its siblings: spliced into each preimage, hashed, and on."""
    return F.aggregate(path, start, lambda h, x: digest(F.concat(_before(x), h, _after(x))))


def manifest(rows: DataFrame) -> DataFrame | None:
    """Of (grp, id, hash, ...): the rows with pos, path, subroot and root; None of an empty table."""
    groups = tree(rows)
    over = tree(groups.tops.select(F.lit("").alias("grp"), F.col("grp").alias("id"), "hash"))
    root = over.tops.first()
    if root is None:
        return None
    above = written(with_paths(over).select(F.col("id").alias("grp"), "path", F.col("hash").alias("subroot")), "merkle-above")
    return with_paths(groups, above).withColumn("root", F.lit(root["hash"]))


OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def verified(docs: DataFrame, tampered: Column, **changed: Column) -> DataFrame:
    """The manifest of documents by lang, and each row's root folded again from its
    hash, which is that of the row with the columns in `changed` where `tampered` is true."""
    grp = F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0"))  # null first
    rows = docs.select(
        grp.alias("grp"), F.col("doc_id").cast("long").alias("id"), leaf_hash().alias("hash"), F.when(tampered, leaf_hash(**changed)).alias("found"),
    )
    proven = manifest(written(rows, "merkle-rows"))
    if proven is None:
        return docs.sparkSession.createDataFrame([], OUT)
    got = proven.withColumn("folded_root", folded(F.coalesce("found", "hash"), F.col("path")))
    return got.select(
        F.col("id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents by lang; where 7 divides the crc32 of a row's id, its
    n_chars is one more than when the manifest was made, which the folded root shows."""
    docs = table(spark, sf_dir, "documents")
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    return verified(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, n_chars=more)

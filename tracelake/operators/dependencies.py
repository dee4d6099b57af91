"""Dependencies between names: closure, drops, orders, packs.

Graphs are edge tables and of any size; what one request needs of them, a request
being a message's modules, is an array in its row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tracelake.operators.ingest import numbered
from tracelake.shared import written

#: Requests times items that are ordered at once, a byte each.
CELLS = 1 << 22
#: Names and dependencies that are sent to all tasks, at most: some 50 MB.
SENT = 1 << 23


def closure(chosen: DataFrame, deps: DataFrame) -> DataFrame:
    """(grp, name) of what is chosen and all it depends on, from (grp, name) and
    (name, dep). Each round follows the names that are new in their group."""
    known = fresh = written(chosen.select("grp", "name").distinct(), "closure")
    while not fresh.isEmpty():
        onward = fresh.join(deps.select("name", "dep"), "name").select("grp", F.col("dep").alias("name")).distinct()
        fresh = written(onward.join(known.hint("merge"), ["grp", "name"], "left_anti"), "closure")  # what is known grows: never sent to all
        known = known.unionByName(fresh)
    return known


def dropped(deps: DataFrame, active: DataFrame) -> DataFrame:
    """(name) of all names in (name, dep) that can't run: those that aren't among the
    active ones, and what depends on them over any number of steps."""
    names = deps.select("name").unionByName(deps.select(F.col("dep").alias("name"))).distinct()
    out = fresh = written(names.join(active.select("name"), "name", "left_anti"), "dropped")
    while not fresh.isEmpty():
        behind = deps.join(fresh.select(F.col("name").alias("dep")), "dep", "left_semi").select("name").distinct()
        fresh = written(behind.join(out, "name", "left_anti"), "dropped")
        out = out.unionByName(fresh)
    return out


def peeled(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (name, dep): (name, level), where a level's names depend on earlier levels
    only, from 0; and the edges among names on a cycle or behind one, which have no
    level. Each round takes the names that nothing left in the table keeps."""
    edges = edges.select("name", "dep").distinct()
    names = edges.select("name").unionByName(edges.select(F.col("dep").alias("name"))).distinct()
    free = written(names.join(edges, "name", "left_anti").select("name", F.lit(0).alias("level")), "peeled")
    levels, left, level = free, written(edges, "edges"), 0
    while not free.isEmpty() and not left.isEmpty():
        level += 1
        rest = written(left.join(free.select(F.col("name").alias("dep")), "dep", "left_anti").select("name", "dep"), "edges")
        kept = left.select("name").distinct().join(rest.select("name").distinct(), "name", "left_anti")
        free = written(kept.select("name", F.lit(level).alias("level")), "peeled")
        levels, left = levels.unionByName(free), rest
    return levels, left


def _least_first(group: np.ndarray, heads: np.ndarray, deps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of many requests' items at once, request by request, each a number, how many hard
    and soft dependencies it has (-1: it is lost) and in `deps` these: one item of each
    request and number, its place, its pack and whether it is lost. Each turn takes from every
    request the least number whose dependencies among the items have run. No place
    (-1) though it isn't lost: it waits for itself. An item starts a pack if the last of its
    hard dependencies runs in the one before, where those behind that one can't run earlier."""
    key, first = np.unique(group << 32 | heads[:, 0], return_index=True)
    counts = np.maximum(heads[:, 1], 0) + heads[:, 2]
    begin, count, hard, of = (np.cumsum(counts) - counts)[first], counts[first], heads[first, 1], group[first]
    item = np.repeat(np.arange(len(key)), count)
    nth = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    needed = of[item] << 32 | deps[begin[item] + nth]
    to = np.minimum(np.searchsorted(key, needed), max(len(key) - 1, 0))
    met = (key[to] == needed) & (hard[to] >= 0)
    by = np.argsort(to[met], kind="stable")
    behind, firmly, many = item[met][by], (nth < hard[item])[met][by], np.bincount(to[met], minlength=len(key))
    since, waits = np.cumsum(many) - many, np.bincount(item[met], minlength=len(key))
    place, pack, last = (np.full(len(key), -1) for _ in range(3))
    sizes = np.bincount(of)
    offset, row = np.cumsum(sizes) - sizes, np.zeros(len(sizes), int)
    left = np.argsort(-sizes, kind="stable")
    while len(left):
        some, left = np.split(left, [max(1, CELLS // max(sizes[left[0]], 1))])
        row[some] = np.arange(len(some))
        inside = np.flatnonzero(np.isin(of, some))
        free = np.zeros((len(some), max(sizes[some[0]], 1)), bool)
        free[row[of[inside]], inside - offset[of[inside]]] = (waits[inside] == 0) & (hard[inside] >= 0)
        live, start, now, turn = some, np.zeros(len(some), int), np.zeros(len(some), int), 0
        while len(live):
            column = free[row[live]].argmax(axis=1)
            on = free[row[live], column]
            live, column = live[on], column[on]
            x, r = offset[live] + column, row[live]
            free[r, column] = False
            new = (turn - start[r] >= most) | (last[x] >= start[r])
            now[r] += new
            start[r[new]] = turn
            place[x], pack[x] = turn, now[r]
            edge = np.repeat(since[x] - np.cumsum(many[x]) + many[x], many[x]) + np.arange(many[x].sum())
            waits[behind[edge]] -= 1
            last[behind[edge[firmly[edge]]]] = turn
            ready = behind[edge][waits[behind[edge]] == 0]
            free[row[of[ready]], ready - offset[of[ready]]] = True
            turn += 1
    return first, place, pack, hard < 0


def _sent(among: DataFrame, items: DataFrame) -> DataFrame:
    """(name) of the names that are sent to all tasks, with all that these need: all of (name, h, s), if
    they and their dependencies are no more than SENT; else without those that none needs, then without those
    that none of the rest needs, and so on. None at all, if what is left is too much, as on a large cycle."""
    size = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(1 + F.size("h") + F.size("s")), F.lit(0)).alias("size")).first()
    kept, left, now = items.select("name"), among, size(items)
    while now["size"] > SENT:
        kept, before = written(left.select(F.col("dep").alias("name")).distinct(), "sent"), now["n"]
        left, now = left.join(kept, "name", "left_semi"), size(items.join(kept, "name", "left_semi"))
        if now["n"] == before:
            return kept.limit(0)
    return kept


def _shelf(items: DataFrame) -> dict:
    """Names as arrays, by number: texts; how many hard and soft dependencies each has (-1: it is lost) and, one after
    the other, these; and, as places among the names, what an active name needs."""
    rows = items.select("name", "text", "on", "off", "h", "s").toArrow().combine_chunks().sort_by("name").combine_chunks()
    flat = lambda c: (pc.list_value_length(rows[c]).to_numpy().astype(np.int64), pc.list_flatten(rows[c]).to_numpy().astype(np.int64))
    ids, on, off, (hard, h), (soft, s) = rows["name"].to_numpy().astype(np.int64), rows["on"].to_numpy(), rows["off"].to_numpy(), flat("h"), flat("s")
    item = np.repeat(np.arange(len(ids)), hard)
    at = np.minimum(np.searchsorted(ids, h), max(len(ids) - 1, 0))
    need = on[item] & on[at] & (ids[at] == h)
    both = np.concatenate((item[~off[item]], np.repeat(np.arange(len(ids)), soft)[np.repeat(~off, soft)]))
    deps = np.concatenate((h[~off[item]], s[np.repeat(~off, soft)]))[np.argsort(both, kind="stable")]
    got = {"ids": ids, "hard": np.where(off, -1, hard), "soft": np.where(off, 0, soft), "deps": deps, "needs": np.bincount(item[need], minlength=len(ids)), "need": at[need]}
    return {k: v.astype(np.int32) for k, v in got.items()} | {"text": pa.chunked_array(rows["text"]).combine_chunks()}


def _spans(counts: np.ndarray, begin: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of these rows' values, where row k has counts[k] values from begin[k] on."""
    n = counts[rows]
    return np.repeat(begin[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())


def _followed(group: np.ndarray, at: np.ndarray, needs: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, place) of these and of all that they need, each once: place k needs the next needs[k] of `need`."""
    n, begin, turn = max(len(needs), 1), np.cumsum(needs, dtype=np.int64) - needs, 0
    fresh, out = np.unique(group * n + at), [np.zeros(0, np.int64)]
    while len(fresh):
        out.append(fresh)
        row = fresh % n
        more = np.repeat(fresh // n, needs[row]) * n + need[_spans(needs, begin, row)]
        if (turn := turn + 1) % 32 == 0:  # else a circle has no end
            out = [np.unique(np.concatenate(out))]
            more = np.setdiff1d(more, out[0])
        fresh = np.unique(more) if len(more) > len(fresh) else more
    every = np.unique(np.concatenate(out))
    return every // n, every % n


def _arranged(chosen: DataFrame, deps: DataFrame, active: DataFrame, most: int) -> DataFrame:
    """(grp, name, place, pack) as `ordered` and `packed` say. Names are numbers, in their order. The
    names that are needed are followed once, not for each group that chose them. Those that most others
    build on, at most SENT with their dependencies, are sent to all tasks, so that a choice is
    shuffled as a number; one of the others goes with what it needs of the others, as arrays."""
    ends = lambda df, *columns: reduce(DataFrame.unionByName, [df.select(F.col(c).alias("name")) for c in columns]).distinct()
    names = ends(active.select("name"), "name").unionByName(ends(deps, "name", "dep")).distinct().where("name IS NOT NULL")
    numbers = written(numbered(names.withColumn("_one", F.lit(0)), ["_one"], ["name"]).select("name", F.col("place").cast("int").alias("n")), "names")
    n_of = lambda name, n: numbers.select(F.col("name").alias(name), F.col("n").alias(n))
    edges = written(deps.join(n_of("name", "_n"), "name").join(n_of("dep", "_d"), "dep").groupBy(F.col("_n").alias("name"), F.col("_d").alias("dep")).agg(F.max("hard").alias("hard")), "deps")
    hard, on = edges.where("hard").select("name", "dep"), written(active.join(numbers, "name").select(F.col("n").alias("name")).distinct(), "active")
    among = written(hard.join(on, "name", "left_semi").join(on.withColumnRenamed("name", "dep"), "dep", "left_semi"), "among")
    wanted = written(chosen.select("name").distinct().join(numbers, "name").select(F.col("n").alias("name")), "wanted")
    need = written(closure(wanted.select(F.lit(0).alias("grp"), "name"), among).select("name"), "needed")
    off = dropped(hard.unionByName(need.select("name", F.col("name").alias("dep"))), on)
    marked = lambda df, c: df.select("name", F.lit(True).alias(c))
    kind = lambda hard: F.array_sort(F.collect_list(F.when(F.col("hard") == hard, F.col("dep"))))
    per_name = edges.groupBy("name").agg(kind(True).alias("h"), kind(False).alias("s"))
    none, no_text = F.array().cast("array<int>"), F.array().cast("array<string>")
    items = need.join(per_name, "name", "left").join(marked(off, "off"), "name", "left").join(marked(on, "on"), "name", "left").join(n_of("text", "name"), "name")
    items = written(items.select("name", "text", F.coalesce("on", F.lit(False)).alias("on"), F.coalesce("off", F.lit(False)).alias("off"), F.coalesce("h", none).alias("h"), F.coalesce("s", none).alias("s")), "items")
    among = among.join(need, "name", "left_semi")
    kept = _sent(among, items)
    shelf = chosen.sparkSession.sparkContext.broadcast(_shelf(items.join(kept, "name", "left_semi")))
    cold = wanted.join(kept, "name", "left_anti")
    alone = not cold.isEmpty()
    load = wanted.join(kept, "name", "left_semi").join(n_of("text", "name"), "name").select(F.col("text").alias("name"), F.array("name").alias("kept"))
    columns = ["kept"]
    if alone:
        columns = ["kept", "names", "heads", "deps"]
        to = kept.withColumnRenamed("name", "dep")
        need = written(closure(cold.select(F.col("name").alias("grp"), "name"), among.join(kept, "name", "left_anti").join(to, "dep", "left_anti")), "needed")
        onward = among.join(kept, "name", "left_anti").join(to, "dep", "left_semi").groupBy("name").agg(F.collect_list("dep").alias("kept"))
        head = F.when(F.col("off"), F.array("name", F.lit(-1), F.lit(0))).otherwise(F.array(F.col("name"), F.size("h"), F.size("s")))
        each = items.join(kept, "name", "left_anti").join(onward, "name", "left").select("name", F.struct(F.coalesce("kept", none).alias("kept"), "text", head.alias("heads"), F.when(F.col("off"), none).otherwise(F.concat("h", "s")).alias("deps")).alias("x"))
        behind = need.join(each, "name").groupBy(F.col("grp").alias("n")).agg(F.collect_list("x").alias("x"))
        behind = behind.join(numbers, "n").select("name", F.array_distinct(F.flatten("x.kept")).alias("kept"), F.col("x.text").alias("names"), F.flatten("x.heads").alias("heads"), F.flatten("x.deps").alias("deps"))
        load = written(load.select("name", "kept", no_text.alias("names"), none.alias("heads"), none.alias("deps")).unionByName(behind), "needs")
    rows = chosen.select("grp", "name").where("name IS NOT NULL").join(load, "name", "left").select("grp", F.when(F.col("kept").isNull(), F.col("name")).alias("unknown"), *columns)
    if not alone:
        rows, columns = rows.withColumn("kept", F.col("kept")[0]), []  # one number, or none
    all_of = [F.collect_list("kept").alias("kept")] if not alone else [F.flatten(F.collect_list(c)).alias(c) for c in columns]
    groups = rows.repartition("grp").groupBy("grp").agg(F.collect_list("unknown").alias("unknown"), *all_of)
    grp = chosen.schema["grp"].dataType

    def arranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shelf.value
        begin = np.cumsum(counts := np.maximum(known["hard"], 0) + known["soft"], dtype=np.int64) - counts
        flat = lambda column: column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        of = lambda column: np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
        for batch in batches:
            keys, strange, kept, *more = batch.columns
            group, at = _followed(of(kept), np.searchsorted(known["ids"], flat(kept)), known["needs"], known["need"])
            heads, deps, texts = np.stack([known[c][at] for c in ("ids", "hard", "soft")], axis=1).astype(np.int64), known["deps"][_spans(counts, begin, at)], known["text"].take(pa.array(at))
            if more:
                group, heads = np.concatenate((group, of(more[0]))), np.concatenate((heads, flat(more[1]).reshape(-1, 3)))
                deps, texts = np.concatenate((deps, flat(more[2]))), pa.concat_arrays([texts, more[0].flatten()])
            first, place, pack, lost = _least_first(group, heads, deps, most)
            if (stuck := (place < 0) & ~lost).any():
                raise ValueError(f"the dependencies go round in a circle in {keys[int(group[first[stuck.argmax()]])]}")
            numbers = [pa.array(c, pa.int32(), mask=lost) for c in (place, pack)]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(group[first])), texts.take(pa.array(first)), *numbers], ["grp", "name", "place", "pack"])
            if len(row := of(strange)):  # names that are neither active nor depend on any
                one = sorted(set(zip(row.tolist(), strange.flatten().to_pylist(), strict=True)))
                empty = pa.nulls(len(one), pa.int32())
                yield pa.RecordBatch.from_arrays([keys.take(pa.array([g for g, _ in one])), pa.array([n for _, n in one], pa.string()), empty, empty], ["grp", "name", "place", "pack"])

    return groups.select("grp", "unknown", "kept", *columns[1:]).mapInArrow(arranged, StructType([StructField("grp", grp)]).add("name", "string").add("place", "integer").add("pack", "integer"))


def ordered(chosen: DataFrame, deps: DataFrame, active: DataFrame) -> DataFrame:
    """(grp, name, place): what each group's choice needs, with its place in the
    group's order from 0, null for a name that is dropped: one that isn't active or
    depends on such a one, over any number of steps. The order always takes the least
    name whose dependencies in the group have run. Inactive names that weren't
    chosen are not listed. `deps`: (name, dep, hard); a soft one orders two names
    that both run and adds none. A group with a cycle gets an error.
    """
    return _arranged(chosen, deps, active, 1).select("grp", "name", "place")


def ordered_packs(chosen: DataFrame, deps: DataFrame, active: DataFrame, most: int) -> DataFrame:
    """(grp, name, place, pack): `packed(ordered(...), hard deps, most)`, from one pass over each group."""
    return _arranged(chosen, deps, active, most).where("place IS NOT NULL")


def packs(items: Column, most: int) -> Column:
    """The pack, from 0, of each item of an ordered array of (name, before), `before`
    being all that the name depends on over any number of steps: the last pack, or a
    new one if that holds `most` names or one that the name depends on."""
    kind = "struct<pack:int,held:array<string>,out:array<int>>"
    start = F.struct(F.lit(0).alias("pack"), F.array().cast("array<string>").alias("held"), F.array().cast("array<int>").alias("out")).cast(kind)

    def step(state: Column, x: Column) -> Column:
        full = (F.size(state["held"]) >= most) | F.arrays_overlap(state["held"], x["before"])
        new = full & (F.size(state["held"]) > 0)
        pack = state["pack"] + new.cast("int")
        held = F.concat(F.when(new, F.array().cast("array<string>")).otherwise(state["held"]), F.array(x["name"]))
        return F.struct(pack.alias("pack"), held.alias("held"), F.concat(state["out"], F.array(pack)).alias("out")).cast(kind)

    return F.aggregate(items, start, step)["out"]


def packed(orders: DataFrame, deps: DataFrame, most: int) -> DataFrame:
    """(grp, name, place, pack) of (grp, name, place): packs of `most` names, in order,
    none beside a name that it depends on. What a name depends on counts among its group's names only."""
    rows = written(orders.where("place IS NOT NULL"), "orders")
    reach = closure(rows.select(F.col("name").alias("grp"), "name").distinct(), deps)
    before = rows.select("grp", "name").join(reach.where("grp <> name").select(F.col("grp").alias("name"), F.col("name").alias("_b")), "name")
    inside = before.join(rows.select("grp", F.col("name").alias("_b")), ["grp", "_b"], "left_semi").groupBy("grp", "name").agg(F.array_sort(F.collect_list("_b")).alias("before"))
    each = rows.join(inside, ["grp", "name"], "left").select("grp", F.struct("place", "name", F.coalesce("before", F.array().cast("array<string>")).alias("before")).alias("x"))
    runs = each.groupBy("grp").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return runs.select("grp", F.explode(F.arrays_zip("x", packs(F.col("x"), most).alias("pack"))).alias("z")).select("grp", "z.x.name", "z.x.place", "z.pack")

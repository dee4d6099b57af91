"""JSON inside text: answers of models with fences and prose around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parses(text: Column) -> Column:
    """The text is one JSON value. Spark's parsers stop after a value, whatever follows,
    so it is read as one of two items, and as a member."""
    item = F.json_array_length(F.concat(F.lit("["), text, F.lit(",0]"))) == 2
    return F.coalesce(item & F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}"))).isNotNull(), F.lit(False))


def outermost(text: Column, opening: str, closing: str) -> Column:
    """From the first opening to the last closing bracket, if that is JSON."""
    start, end = F.instr(text, opening), F.length(text) - F.instr(F.reverse(text), closing) + 1
    piece = F.substring(text, start, end - start + 1)
    return F.when((start > 0) & (F.instr(text, closing) > 0) & (end > start) & parses(piece), piece)


def balanced(text: Column) -> Column:
    """The object or array that begins first of those whose brackets close: a scan
    that skips brackets in strings and knows escapes. Null if none closes. It reads
    each character once, but a state for each makes it a function for answers, not for books."""
    kind = "struct<pos:int,open:array<struct<at:int,mark:string>>,start:int,end:int,quoted:boolean,escaped:boolean>"
    none = F.array().cast("array<struct<at:int,mark:string>>")
    begin = F.struct(F.lit(0).alias("pos"), none.alias("open"), F.lit(None).alias("start"), F.lit(None).alias("end"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped")).cast(kind)

    def step(s: Column, c: Column) -> Column:
        pos, last, deep = s["pos"] + 1, F.get(s["open"], F.size(s["open"]) - 1), F.size(s["open"]) > 0
        opens, closes = ~s["quoted"] & c.isin("{", "["), ~s["quoted"] & deep & c.isin("}", "]")
        fits = closes & (last["mark"] == F.translate(c, "}]", "{["))
        earlier = fits & (s["start"].isNull() | (last["at"] < s["start"]))
        stack = F.when(opens, F.concat(s["open"], F.array(F.struct(pos.alias("at"), c.alias("mark"))))).when(fits, F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1)).when(closes, none).otherwise(s["open"])
        return F.struct(
            pos.alias("pos"), stack.alias("open"), F.when(earlier, last["at"]).otherwise(s["start"]).alias("start"), F.when(earlier, pos).otherwise(s["end"]).alias("end"),
            F.when(deep & (c == '"') & ~s["escaped"], ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), (s["quoted"] & ~s["escaped"] & (c == "\\")).alias("escaped"),
        ).cast(kind)

    found = F.aggregate(F.split(text, ""), begin, step)
    return F.when(found["start"].isNotNull(), F.substring(text, found["start"], found["end"] - found["start"] + 1))


def salvaged(text: Column, scan: bool = False) -> Column:
    """The JSON in a text: the text, trimmed, if it parses; else the outermost object
    or array, that of the bracket that opens first before the other; with `scan` the
    first balanced one; else the text as it is."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    objects, arrays = outermost(trimmed, "{", "}"), outermost(trimmed, "[", "]")
    first = lambda c: F.when(F.instr(trimmed, c) > 0, F.instr(trimmed, c)).otherwise(F.length(trimmed) + 1)
    found = F.when(first("{") <= first("["), F.coalesce(objects, arrays)).otherwise(F.coalesce(arrays, objects))
    if scan:
        inner = balanced(trimmed)
        found = F.coalesce(found, F.when(parses(inner), inner))
    return F.when(parses(trimmed), trimmed).otherwise(F.coalesce(found, text))

"""SQL for queries of this subpackage whose rows SQL can say, in another engine's dialect."""

from __future__ import annotations

from tracelake.llm.filtering_lloyd import ENTRIES, PARTS, ROUNDS, SCALE
from tracelake.llm.merkle import FIELDS
from tracelake.llm.sharding import KEEP, ROW, SHARDS

#: The reversed polynomial of crc32, and its table of bytes.
POLYNOMIAL = 0xEDB88320


def _byte(value: int) -> int:
    for _ in range(8):
        value = value >> 1 ^ POLYNOMIAL * (value & 1)
    return value


def crc32(text: str) -> str:
    """The unsigned crc32 of a string's UTF-8 bytes, byte by byte."""
    lookup = f"list_extract([{','.join(str(_byte(k)) for k in range(256))}], xor(c & 255, b) + 1)"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, {lookup})))"


def vector_codes() -> str:
    """Plain Lloyd rounds, all entries against all parts."""
    far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    ctes = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"parts AS MATERIALIZED (SELECT vec_id, p, list_slice(v, p * len(v) // {PARTS} + 1, (p + 1) * len(v) // {PARTS}) AS x FROM kept, range({PARTS}) t(p))",
        f"book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        ctes.append(f"near{k} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT vec_id, p, x, e, {far} AS d FROM parts JOIN book{k} USING (p)) GROUP BY vec_id, p)")
        if k < ROUNDS:
            ctes.append(f"""book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN (
                SELECT p, e, list(y ORDER BY i) AS c FROM (SELECT p, e, i, CAST(floor(sum(y) / count(*)) AS BIGINT) AS y FROM (SELECT p, e, unnest(x) AS y, unnest(range(len(x))) AS i FROM near{k}) GROUP BY 1, 2, 3) GROUP BY 1, 2
                ) m ON b.p = m.p AND b.e = m.e)""")  # fmt: skip
    return f"""WITH {', '.join(ctes)}, coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} JOIN kept USING (vec_id) GROUP BY 1, 2)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256 FROM coded"""


def _levels(name: str, rows: str, most: int) -> list[str]:
    """Of `rows` (g, pos, n, h): the nodes of each level; a tree that has ended keeps its top."""
    ctes = [f"{name}0 AS MATERIALIZED ({rows})"]
    for k in range(most):
        ctes.append(f"{name}{k + 1} AS MATERIALIZED (SELECT g, pos // 2 AS pos, n, CASE WHEN n > {2**k} THEN sha256(string_agg(h, '' ORDER BY {name}{k}.pos)) ELSE min(h) END AS h FROM {name}{k} GROUP BY g, {name}{k}.pos // 2, n)")
    return ctes


def _folds(name: str, nodes: str, rows: str, most: int) -> list[str]:
    """Of `rows` (id, g, pos, n, acc, sib, ...): the folded hash and the siblings, level by level."""
    ctes, before = [], rows
    for k in range(most):
        here = f"(r.pos >> {k}) & 1"
        ctes.append(f"""{name}{k} AS MATERIALIZED (SELECT r.* REPLACE (r.sib || CASE WHEN r.n > {2**k} THEN coalesce(s.h, '') ELSE '' END AS sib,
            CASE WHEN r.n > {2**k} THEN sha256(CASE WHEN {here} = 1 THEN coalesce(s.h, '') || r.acc ELSE r.acc || coalesce(s.h, '') END) ELSE r.acc END AS acc)
            FROM {before} r LEFT JOIN {nodes}{k} s ON s.g = r.g AND s.pos = xor(r.pos >> {k}, 1))""")  # fmt: skip
        before = f"{name}{k}"
    return ctes


def merkle(most: int = 20, groups: int = 8) -> str:
    """Up to 2^most rows a lang and 2^groups langs."""
    spell = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"
    leaf = lambda **new: "sha256(" + " || ".join(spell(new.get(c, f'"{c}"')) for c in FIELDS) + ")"
    bits = "list_transform(range(8 * strlen(CAST(doc_id AS VARCHAR))), lambda i: (ascii(CAST(doc_id AS VARCHAR)[i // 8 + 1]) >> (i % 8)) & 1)"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: xor(c >> 1, {POLYNOMIAL} * (xor(c, b) & 1))))"
    ctes = [
        f"""leaves AS MATERIALIZED (SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS g, {leaf()} AS h, CASE WHEN {crc} % 7 = 0 THEN {leaf(n_chars='(n_chars + 1)')} ELSE {leaf()} END AS found FROM documents)""",
        "ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves)",
        *_levels("low", "SELECT g, pos, n, h FROM ranked", most),
        f"tops AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, h, g AS lang FROM low{most})",
        *_levels("high", "SELECT g, pos, n, h FROM tops", groups),
    ]
    ctes += _folds("fold", "low", "(SELECT doc_id, g, pos, n, found AS acc, '' AS sib, h AS leaf FROM ranked)", most)
    over = f"(SELECT f.doc_id, '' AS g, t.pos, t.n, f.acc, f.sib, f.leaf, t.h AS subroot FROM fold{most - 1} f JOIN tops t ON t.lang = f.g)"
    ctes += _folds("above", "high", over, groups)
    root = f"(SELECT h FROM high{groups})"
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, {root} AS root, sha256(sib) AS proof_sha256, acc AS folded_root, acc = {root} AS verified FROM above{groups - 1}"


def shards() -> str:
    """Exact edges: a small group of equal texts by its middle, other rows by their own."""
    return f"""WITH rows AS MATERIALIZED (SELECT doc_id, md5(coalesce("text", '')) AS key, CAST(strlen(coalesce("text", '')) + {ROW} AS BIGINT) AS size, {crc32('''coalesce("text", '')''')} AS crc FROM documents),
        placed AS (SELECT *, sum(size) OVER (ORDER BY key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total, sum(size) OVER (PARTITION BY key) AS own FROM rows),
        grouped AS (SELECT *, min(start) OVER (PARTITION BY key) AS first FROM placed),
        dealt AS (SELECT *, CAST(CASE WHEN own * {KEEP * SHARDS} <= total THEN (2 * first + own) * {SHARDS} // (2 * total) ELSE (2 * start + size) * {SHARDS} // (2 * total) END AS INTEGER) AS shard FROM grouped)
        SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY start) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM dealt"""

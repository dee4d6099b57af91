"""Text columns: normal forms, names of organisations, trigrams, signatures."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a company's name that say its legal form or kind (fixed values). "spa" is none here.
LEGAL_FORMS = (
    "ag bv co company corp corporation eirl gmbh group grupo holding holdings inc incorporated kg kk limited llc llp ltd ltda ohg oy oyj plc pte pty "
    "sa sac sapi sas sca scs sl slu srl technologies"
).split()

#: Hangul syllables stay whole: their parts tell them apart as well as they do themselves.
HANGUL = range(0xAC00, 0xD7A4)


@cache
def _decompositions() -> tuple[str, str, str, str]:
    """By Unicode's own tables: characters that stand for another one, without its
    marks, and that one; marks after the former, which so have none; those that stand for several,
    as a look-up string; and a pattern of these."""
    one, plain, marks, several, found = [], [], [], [], []
    for code in range(0x80, 0x30000):
        c = chr(code)
        if unicodedata.combining(c):
            marks.append(c)
        elif code not in HANGUL and not 0xD800 <= code < 0xE000:
            bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if len(bare) == 1 and bare != c:
                one.append(c)
                plain.append(bare)
            elif bare != c:
                several.append(f"\x01{c}\x02{bare}")
                found.append(c)
    return "".join(one + marks), "".join(plain), "".join(several) + "\x01", f"[{''.join(found)}]"


def unmarked(text: Column) -> Column:
    """Characters in their compatibility decomposition, without combining marks."""
    one, plain, several, found = _decompositions()
    piece = lambda c: F.substring_index(F.substring(F.lit(several), F.instr(F.lit(several), F.concat(F.lit("\x01"), c, F.lit("\x02"))) + 3, F.lit(24)), "\x01", 1)
    spread = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(found), piece(c)).otherwise(c)), "")
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(F.when(text.rlike(found), spread).otherwise(text), one, plain)).otherwise(text)


def normalized(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def match_key(text: Column) -> Column:
    """`normalized`, without accents and with compatible characters as one."""
    return normalized(unmarked(text))


def org_core(name: Column) -> Column:
    """A company's name without dots, punctuation and legal forms."""
    plain = F.regexp_replace(F.regexp_replace(match_key(name), r"\.", ""), "[^a-z0-9]+", " ")
    bare = F.regexp_replace(F.concat(F.lit(" "), plain, F.lit(" ")), rf" (?:{'|'.join(LEGAL_FORMS)})(?= )", "")
    return F.trim(F.regexp_replace(bare, " +", " "))


def trigrams(text: Column) -> Column:
    """The set of trigrams of each word, with two spaces before it and one after."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements over all elements of two sets; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, both / every).otherwise(0.0)


def message_id_key(value: Column) -> Column:
    """A message id without angle brackets and space around it, in lower case; null if empty."""
    bare = F.lower(F.trim(F.regexp_replace(F.trim(value), "^<|>$", "")))
    return F.when(bare != "", F.concat(F.lit("msgid:"), bare))


def subject_key(subject: Column) -> Column:
    """Line breaks as spaces, in lower case."""
    return F.lower(F.regexp_replace(subject, r"[\r\n]+", " "))


def body_key(body: Column, most: int = 16384) -> Column:
    """Without soft hyphens and joiners, white space collapsed, in lower case, cut."""
    bare = F.regexp_replace(body, "[­͏]", "")
    return F.left(F.lower(F.trim(F.regexp_replace(bare, r"\s+", " "))), F.lit(most))


def set_signature(members: Column) -> Column:
    """SHA-256 of a set's members in order: the same for any order of the same set."""
    return F.sha2(F.concat_ws(",", F.array_sort(F.array_distinct(members))), 256)


def grounded(quote: Column, text: Column, least: int = 8) -> Column:
    """The quote, of at least so many characters, stands in the text (both normalized)."""
    q = normalized(quote)
    return (F.length(q) >= least) & F.contains(normalized(text), q)


def either_contains(a: Column, b: Column) -> Column:
    """One of two non-empty normal forms holds the other."""
    a, b = match_key(a), match_key(b)
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def size_label(size: Column) -> Column:
    """Bytes as B, KB or MB, rounded half up in integers."""
    label = lambda unit, name: F.concat(F.expr("CAST(0 AS BIGINT)") + F.floor((size + unit // 2) / unit), F.lit(name))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024 * 1024, label(1024, " KB")).otherwise(label(1024 * 1024, " MB"))


def cut_bytes(text: Column, most: int) -> Column:
    """At most so many UTF-8 bytes, never half a character."""
    data = F.encode(text, "UTF-8")
    inside = lambda at: F.hex(F.substring(data, F.lit(at + 1), F.lit(1))).rlike("^[89AB]")  # noqa: E731 - the next byte goes on with a character
    end = F.lit(max(0, most - 3))
    for at in range(max(0, most - 2), most + 1):
        end = F.when(inside(at), end).otherwise(F.lit(at))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(data, F.lit(1), end), "UTF-8"))

"""Contact identifiers in their normal form."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Common public suffixes, `*.` for any label and `!` for an exception to
#: that, as the public list spells them; mail providers open to anyone; local parts that stand for a role.
PUBLIC_SUFFIXES = """
ac ad ae ai am app ar at au be bg biz blog bo br by ca cat cc ch cl cloud cn co com cr cu cz de dev do dk ec edu ee es eu fi fm fr gg gov gr gt hk hn hr hu id ie il
in info int io is it jobs jp kr kz la li lt lu lv me media mil mobi mx museum my name net ni nl no nu nz online org pa page pe ph pk pl pro pt py ro rs ru sa se sg
shop si site sk store sv tech th tk top tr travel tv tw ua ug uk us uy uz ve vn ws xyz za
co.uk org.uk ac.uk gov.uk ltd.uk com.co edu.co gov.co net.co org.co com.mx org.mx gob.mx com.ar gob.ar com.br gov.br com.au net.au org.au edu.au co.jp ac.jp or.jp
co.nz co.za co.in co.kr com.cn com.tw com.pe com.ec com.ve com.tr com.sg com.hk co.il com.es
*.ck !www.ck *.bd *.kawasaki.jp !city.kawasaki.jp
"""
FREE_MAIL = (
    "aol.com fastmail.com gmail.com gmx.com gmx.net googlemail.com hey.com hotmail.co.uk hotmail.com hotmail.es icloud.com live.com live.com.mx mac.com mail.com me.com msn.com "
    "outlook.com outlook.es pm.me proton.me protonmail.com rocketmail.com tutanota.com yahoo.com yahoo.com.mx yahoo.es yandex.com ymail.com zoho.com"
).split()
ROLE_TOKENS = "bounce bounces daemon donotreply mailer noreply notification notifications notify postmaster".split()


def email(value: Column) -> Column:
    """Lower case, without +tag; Gmail's domains are one and its dots mean nothing."""
    low = F.lower(F.trim(value))
    domain = F.substring_index(low, "@", -1)
    local = F.split_part(F.substring_index(low, "@", 1), F.lit("+"), F.lit(1))
    gmail = domain.isin("gmail.com", "googlemail.com")
    return F.when(
        F.contains(low, F.lit("@")),
        F.concat(F.when(gmail, F.replace(local, F.lit("."), F.lit(""))).otherwise(local), F.lit("@"), F.when(gmail, F.lit("gmail.com")).otherwise(domain)),
    ).otherwise(low)


def phone(value: Column, country: str = "+57", mobile: str = "^3[0-9]{9}$") -> Column:
    """Digits and plus; a national mobile number gets its country code."""
    digits = F.regexp_replace(value, "[^0-9+]", "")
    return F.when(digits.rlike(mobile), F.concat(F.lit(country), digits)).otherwise(digits)


def handle(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(value)), "^@+", "")


def host(url: Column) -> Column:
    """Host of an address, in lower case, without port and leading www."""
    rest = F.regexp_replace(F.lower(F.trim(url)), "^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_extract(rest, "^([^/?#:]*)", 1), r"^www\.", "")


class SuffixRules(NamedTuple):
    plain: frozenset[str]
    wild: frozenset[str]  # of `*.x`: x
    exceptions: frozenset[str]


def suffix_rules(text: str = PUBLIC_SUFFIXES) -> SuffixRules:
    """Rules in the public list's format: one a word, or a line; comments begin with //."""
    words = [w.lower() for line in text.splitlines() if not line.strip().startswith("//") for w in line.split()]
    return SuffixRules(
        frozenset(w for w in words if w[0] not in "*!"), frozenset(w[2:] for w in words if w.startswith("*.")), frozenset(w[1:] for w in words if w[0] == "!"),
    )


def registrable_domain(name: Column, rules: SuffixRules | None = None) -> Column:
    """The registrable part of a host: one label before its public suffix, the longest
    that a rule says. An exception is registrable itself. A host without a known
    suffix, an address of numbers, or a suffix alone stays as it is; an empty one is empty.
    The rules are sets in the plan, looked up by hash: each label is one look-up."""
    rules = rules or suffix_rules()
    host = F.lower(F.trim(name))
    labels = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")
    n = F.size(labels)
    tail = lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")  # noqa: E731  from a label, counted from 1
    among = lambda c, held: c.isin(*sorted(held)) if held else F.lit(False)
    # from the left, so the longest suffix comes first: where the registrable part begins
    places = F.filter(F.sequence(F.lit(1), n), lambda i: among(tail(i), rules.exceptions) | (i < n) & (
        among(tail(i + 1), rules.plain) | (i + 2 <= n) & among(tail(i + 2), rules.wild) & ~among(tail(i + 1), rules.exceptions)
    ))
    suffix = among(tail(F.lit(1)), rules.plain) | (n > 1) & among(tail(F.lit(2)), rules.wild) & ~among(tail(F.lit(1)), rules.exceptions)
    return F.when(suffix | (F.size(places) == 0), host).otherwise(tail(F.get(places, F.lit(0))))


def is_free_mail(address: Column) -> Column:
    return F.trim(F.substring_index(F.lower(address), "@", -1)).isin(*FREE_MAIL)


def is_role(address: Column) -> Column:
    """A word of the local part, or the local part without separators, stands for a role."""
    local = F.substring_index(F.lower(address), "@", 1)
    flat = F.regexp_replace(local, "[^a-z]", "")
    return F.arrays_overlap(F.split(local, "[._+-]"), F.array(*map(F.lit, ROLE_TOKENS))) | F.exists(F.array(*map(F.lit, ("noreply", "donotreply"))), lambda t: F.contains(flat, t))

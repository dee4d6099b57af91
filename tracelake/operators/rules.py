"""Declarative rules over JSON payloads, compiled to columns."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """`scope`: conditions by dotted path, each {operator: value}; all must hold."""

    id: int
    action: str
    scope: dict[str, dict[str, Any]]
    priority: int = 0
    enabled: bool = True
    source_type: str | None = None
    source_id: int | None = None


def _condition(payload: Column, path: str, test: dict[str, Any]) -> Column:
    if not isinstance(test, dict) or len(test) != 1 or not re.fullmatch(r"\w+(\.\w+)*", path):
        return F.lit(False)
    value, (op, want) = F.get_json_object(payload, f"$.{path}"), next(iter(test.items()))
    if op == "equals" and isinstance(want, (str, int, float)):
        held = value == F.lit(str(want).lower() if isinstance(want, bool) else str(want))
    elif op == "in" and isinstance(want, list):
        held = value.isin(*[str(x) for x in want]) if want else F.lit(False)
    elif op == "regex" and isinstance(want, str):
        held = value.rlike(want)
    elif op == "prefix" and isinstance(want, str):
        held = F.startswith(value, F.lit(want))
    else:
        return F.lit(False)
    return F.coalesce(held, F.lit(False))


def matches(rule: Rule, payload: Column) -> Column:
    """All conditions hold; no conditions match everything; an unknown operator nothing."""
    out = F.lit(True)
    for path, test in rule.scope.items():
        out = out & _condition(payload, path, test)
    return out


def decided(df: DataFrame, rules: list[Rule], payload: str = "payload", source_type: str | None = None, source_id: str | None = None) -> DataFrame:
    """`df` with rule_id and action of the first rule that matches, by falling
    priority, then id; null and "keep" without one."""
    rule_id, action = F.lit(None).cast("long"), F.lit("keep")
    for rule in sorted((r for r in rules if r.enabled), key=lambda r: (r.priority, -r.id)):
        applies = matches(rule, F.col(payload))
        if rule.source_type is not None:
            applies = applies & (F.col(source_type) == rule.source_type) if source_type else F.lit(False)
        if rule.source_id is not None:
            applies = applies & (F.col(source_id) == rule.source_id) if source_id else F.lit(False)
        rule_id = F.when(applies, F.lit(rule.id).cast("long")).otherwise(rule_id)
        action = F.when(applies, F.lit(rule.action)).otherwise(action)
    return df.withColumns({"rule_id": rule_id, "action": action})


def filtered(df: DataFrame, rules: list[Rule], **columns: str) -> tuple[DataFrame, DataFrame]:
    """What is kept, and how many rows each rule dropped. "archive" keeps."""
    rows = decided(df, rules, **columns)
    drops = rows.where("action = 'ignore'").groupBy("rule_id").agg(F.count(F.lit(1)).alias("dropped"))
    return rows.where("action <> 'ignore'").select(df.columns), drops


def tier(payload: Column) -> Column:
    """Bulk mail is on the blacklist, everything else goes in batches."""
    get = lambda p: F.get_json_object(payload, f"$.{p}")
    bulk = get("list_id").isNotNull() | get("list_unsubscribe").isNotNull() | F.lower(get("precedence")).isin("bulk", "list", "junk")
    auto = get("auto_submitted").isNotNull() & (F.lower(get("auto_submitted")) != "no")
    return F.when(F.coalesce(bulk, F.lit(False)) | F.coalesce(auto, F.lit(False)), "blacklist").otherwise("batch")


def safe_pattern(pattern: str, most: int = 256) -> bool:
    """A pattern that all engines read alike and that can't run away: lower case,
    no look-around, back references or classes by letter, no repeated repeats,
    and nothing that matches the empty text."""
    if not pattern or len(pattern) > most or pattern != pattern.lower():
        return False
    if re.search(r"\(\?(?!:)|\\[0-9a-z]|[+*}]\)?[+*{]", pattern):
        return False
    try:
        return re.search(pattern, "") is None
    except re.error:
        return False


def dry_run(df: DataFrame, condition: Column, verdict: str, ident: str, samples: int = 20) -> DataFrame:
    """What a rule would hit: counts by verdict and the smallest ids."""
    hit = df.where(condition)
    smallest = hit.orderBy(ident).limit(samples).agg(F.array_sort(F.collect_list(ident)).alias("sample_ids"))
    counts = hit.agg(
        F.count(F.lit(1)).alias("matched"), F.count_if(F.col(verdict)).alias("relevant"), F.count_if(~F.col(verdict)).alias("not_relevant"),
        F.count_if(F.col(verdict).isNull()).alias("unverdicted"),
    )
    return counts.crossJoin(smallest)  # two single rows


@dataclass(frozen=True)
class MailRule:
    """A predicate on the sender, a pattern on subject, body or either, or both of them."""

    id: int
    effect: str
    sender_kind: str | None = None
    sender_value: str | None = None
    pattern: str | None = None
    field: str | None = None


def mail_matches(rule: MailRule, email: Column, list_id: Column, subject: Column, body: Column) -> Column:
    """Whether a rule holds for a mail: all of its predicates that are there, at least
    one. An empty sender, a field that isn't one, or a pattern that isn't safe holds
    for none; an unknown kind of sender is an error. Patterns look at lower case."""
    held = []
    if rule.sender_kind is not None:
        sides = {"sender_email": F.lower(F.trim(email)), "sender_domain": F.lower(F.substring_index(F.trim(email), "@", -1)), "list_id": F.lower(F.trim(list_id))}
        if rule.sender_kind not in sides:
            raise ValueError(f"no such kind of sender: {rule.sender_kind}")
        value = (rule.sender_value or "").strip().lower()
        held.append((sides[rule.sender_kind] == value) if value else F.lit(False))
    if rule.pattern is not None:
        fields = {"subject": [subject], "body": [body], "subject_or_body": [subject, body]}.get(rule.field or "", [])
        found = [F.lower(F.coalesce(f, F.lit(""))).rlike(rule.pattern) for f in fields] if safe_pattern(rule.pattern) else []
        held.append(F.greatest(*found) if len(found) > 1 else found[0] if found else F.lit(False))
    out = F.lit(bool(held))
    for h in held:
        out = out & F.coalesce(h, F.lit(False))
    return out


def mail_decided(df: DataFrame, rules: list[MailRule], **columns: Column) -> DataFrame:
    """`df` with block_id and allow_id, the first rule of either effect that holds, and the
    decision: block, allow, conflict if both hold, null if none does."""
    first = lambda effect: F.least(*([F.when(mail_matches(r, **columns), r.id) for r in rules if r.effect == effect] + [F.lit(None).cast("int")] * 2))
    rows = df.withColumns({"block_id": first("block"), "allow_id": first("allow")})
    both = F.when(F.col("block_id").isNotNull() & F.col("allow_id").isNotNull(), "conflict")
    return rows.withColumn("decision", both.when(F.col("block_id").isNotNull(), "block").when(F.col("allow_id").isNotNull(), "allow"))

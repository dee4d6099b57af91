"""Amounts: conversion through a table of rates, and prices of model calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Worth of one unit in dollars (fixed values; a table can take their place).
USD_RATES = {"USD": 1.0, "EUR": 1.08, "COP": 0.00025, "MXN": 0.058}


def in_usd(amount: Column, currency: Column, rates: dict[str, float] | None = None) -> Column:
    """Null for an unknown currency."""
    known = F.create_map(*[F.lit(x) for pair in (rates or USD_RATES).items() for x in pair])
    return amount * F.try_element_at(known, F.upper(currency))


def nearly_equal(a: Column, b: Column, tolerance: float = 0.12) -> Column:
    """The difference is within a share of the larger amount."""
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))


def call_cost(hit: Column, miss: Column, output: Column, rates: Column) -> Column:
    """Cost of a call in dollars, six decimals; rates: struct of dollars per million tokens; 0 if unknown."""
    cost = (hit * rates["hit"] + miss * rates["miss"] + output * rates["output"]) / 1_000_000
    return F.coalesce(F.round(cost.cast("decimal(20,10)"), 6), F.lit(0).cast("decimal(20,6)"))

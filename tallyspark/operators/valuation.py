"""Discounted cash flow, the growth that a market value implies, and its sensitivity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE, TERMINAL, YEARS = 0.10, 0.03, 5
#: Growth rates of the sensitivity table, and the bracket of the search.
STEPS = [-0.05, 0.0, 0.05, 0.10, 0.15, 0.20, 0.30]
LOW, HIGH, ROUNDS = -0.60, 1.50, 100


def dcf_value(base: Column, growth: Column, rate: float = RATE, terminal: float = TERMINAL, years: int = YEARS) -> Column:
    """Present value of `years` growing cash flows and the terminal value; null unless base > 0."""
    if years < 1 or rate <= terminal:
        raise ValueError("years must be at least 1 and the rate above the terminal growth")
    flow, value = base, F.lit(0.0)
    for t in range(1, years + 1):
        flow = flow * (growth + 1.0)
        value = value + flow / (1 + rate) ** t
    end = flow * (1 + terminal) / (rate - terminal)
    return F.when(base > 0, value + end / (1 + rate) ** years)


def dcf_multiple(growth: Column, rate: float = RATE, terminal: float = TERMINAL, years: int = YEARS) -> Column:
    """dcf_value of a base of 1."""
    return dcf_value(F.lit(1.0), growth, rate, terminal, years)


def implied_growth(market_cap: Column, base: Column, rate: float = RATE, terminal: float = TERMINAL, years: int = YEARS) -> Column:
    """The growth at which the value is the market's, by bisection; null if it is outside the bracket or an input is not positive."""
    wanted = F.when((market_cap > 0) & (base > 0), F.try_divide(market_cap, base))

    def halve(span: Column, _: Column) -> Column:
        middle = (span["low"] + span["high"]) / 2
        under = dcf_multiple(middle, rate, terminal, years) < span["wanted"]
        return F.struct(F.when(under, middle).otherwise(span["low"]).alias("low"), F.when(under, span["high"]).otherwise(middle).alias("high"), span["wanted"].alias("wanted"))

    start = F.struct(F.lit(LOW).alias("low"), F.lit(HIGH).alias("high"), wanted.alias("wanted"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, halve, lambda s: (s["low"] + s["high"]) / 2)
    inside = (wanted >= dcf_multiple(F.lit(LOW), rate, terminal, years)) & (wanted <= dcf_multiple(F.lit(HIGH), rate, terminal, years))
    return F.when(inside, found)

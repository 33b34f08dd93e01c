"""Period starts, epochs and dates from titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period_start(end: Column, period: Column) -> Column:
    """First day of a fiscal period that ends on a date: a year back for FY (1 January where there is no such day), 1 January for interim periods."""
    back = F.date_add(F.add_months(end, -12), 1)
    leap = (F.month(end) == 2) & (F.dayofmonth(end) == 29)
    new_year = F.make_date(F.year(end), F.lit(1), F.lit(1))
    return F.when(period == "FY", F.when(leap, new_year).otherwise(back)).when(period.isin("H1", "Q1", "Q3"), new_year)


def from_epoch(number: Column) -> Column:
    """A timestamp from seconds, or from milliseconds where the number is over 1e10."""
    return F.timestamp_seconds(F.when(number > 10_000_000_000, number / 1000).otherwise(number.cast("double")))


def period_end(year: Column, period: Column, filed_at: Column) -> Column:
    """The last day of a period as text; the filing's day where the period has none."""
    day = F.when(period == "FY", "12-31").when(period == "H1", "06-30").when(period == "Q1", "03-31").when(period == "Q3", "09-30")
    return F.when(day.isNull(), F.substring(filed_at, 1, 10)).otherwise(F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), day))


#: Months that have gone by before the one in which a period ends.
ELAPSED = {"Q2": 5, "H1": 5, "Q3": 8, "9M": 8}
#: The formats in which dates are printed, in the order in which they are tried.
FORMATS = ["d/M/yyyy H:m", "d/M/yyyy", "yyyy-M-d H:m:s"]


def year_back(end: Column) -> Column:
    """The day after the same day a year before; 29 February counts back 364 days."""
    leap = (F.month(end) == 2) & (F.dayofmonth(end) == 29)
    return F.when(leap, F.date_sub(end, 364)).otherwise(F.date_add(F.add_months(end, -12), 1))


def elapsed_start(end: Column, period: Column, year: Column) -> Column:
    """First day of a cumulative period by the months that have gone by: a quarter for Q1, the year for FY; 1 January of the year without an end."""
    first = F.trunc(end, "MM")
    months = F.lit(0)
    for p, n in ELAPSED.items():
        months = F.when(period == p, n).otherwise(months)
    start = F.when(period.isin("FY", "ANNUAL", "CY", ""), year_back(end)).when(period.isin("Q1", "Q"), F.trunc(end, "quarter")).otherwise(F.add_months(first, -months))
    return F.coalesce(start, F.make_date(year, F.lit(1), F.lit(1)))


def statement_start(end: Column, period: Column, statement: Column) -> Column:
    """None for a balance sheet; a year back for FY; else 1 January."""
    return F.when(statement != "balance_sheet", F.when(period == "FY", year_back(end)).otherwise(F.trunc(end, "year")))


def fiscal_year(period_end: Column, filed_at: Column) -> Column:
    year = lambda text: F.substring(text, 1, 4).try_cast("int")
    return F.coalesce(year(period_end), year(filed_at), F.lit(0))


def printed_date(text: Column, year: Column | None = None) -> Column:
    """A timestamp in one of FORMATS; else 1 January of the year, where one is known."""
    tries = [F.try_to_timestamp(F.btrim(text), F.lit(f)) for f in FORMATS]
    return F.coalesce(*tries, *([F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp")] if year is not None else []))


def calendar_end(year: Column, period: Column, filed_at: Column, supplied: Column) -> Column:
    """The supplied end if it is a date, else the period's last day in the year."""
    return F.coalesce(F.date_format(F.substring(supplied, 1, 10).try_cast("date"), "yyyy-MM-dd"), period_end(year, period, filed_at))

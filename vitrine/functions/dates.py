"""Years and dates out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_year(col: Column, compat_zero: bool = False) -> Column:
    """The leading number of a date text after an optional ``c.``; null where there is none (0 with ``compat_zero``)."""
    digits = F.regexp_extract(F.regexp_replace(col, r"(?i)^c\.?\s*", ""), r"^\s*(\d+)", 1)
    year = digits.try_cast("int")
    return F.coalesce(year, F.lit(0)) if compat_zero else year


def first_year4(dates: Column, created: Column) -> Column:
    """The first date that starts with four digits, else the year of creation, else 0."""
    fit = F.filter(dates, lambda d: d.rlike(r"^\d{4}"))
    return F.coalesce(F.substring(F.get(fit, F.lit(0)), 1, 4).try_cast("int"), F.year(created), F.lit(0))


def parse_year(col: Column) -> Column:
    """The first year from 1800 to 2099 anywhere in a text."""
    return F.regexp_extract(col, r"((?:18|19|20)\d{2})", 1).try_cast("int")


def year_word(col: Column) -> Column:
    """The first stand-alone year from 1900 to 2099."""
    return F.regexp_extract(col, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")


def iso_date(col: Column) -> Column:
    """The first ISO date in a text, or null."""
    found = F.regexp_extract(col, r"(\d{4}-\d{2}-\d{2})", 1)
    return F.when(found != "", found)


def modified_epoch(modified: Column, created: Column) -> Column:
    """Seconds since 1970 of the modification text, else of the creation text, else 0."""
    seconds = lambda c: F.unix_timestamp(F.try_to_timestamp(c))
    return F.coalesce(seconds(modified), seconds(created), F.lit(0).cast("long"))


def pretty_date(col: Column) -> Column:
    """``March 5, 2020`` for an ISO date of year, month and day; any other text as it is."""
    day = F.when(col.cast("string").rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), col.cast("string").try_cast("date"))
    return F.coalesce(F.date_format(day, "MMMM d, yyyy"), col.cast("string"))


#: How coverage of each kind is read: fixed values.
VERBS = {
    "video": "Watch at", "broadcast": "Watch at", "podcast": "Listen at", "pdf": "Read the PDF at", "archive": "View at", "aggregator": "View at",
    "article": "Read the original at",
}


def coverage(name: str, outlet: Column, url: Column, kind: Column) -> Column:
    """A sentence that says where coverage of ``name`` is found."""
    verbs = F.create_map(*[F.lit(x) for pair in VERBS.items() for x in pair])
    verb = F.coalesce(F.try_element_at(verbs, kind), F.lit("Read at"))
    return F.concat(F.lit(f"Coverage of {name} in "), outlet, F.lit(". "), verb, F.lit(" "), url)

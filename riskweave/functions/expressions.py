"""Column expressions shared by the operators: flags, dates, weeks, rounding, text tests. All run inside generated code."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.vocabulary import NO_VENDORS, VENDOR_PATTERNS

DAY_US = 86_400_000_000


def flag(test: Column) -> Column:
    """1 where the test is true, 0 where it is false or unknown."""
    return F.when(test, F.lit(1)).otherwise(F.lit(0))


def number(column: str | Column, default: float | None = 0.0) -> Column:
    """The column as a double; NaN and what is no number count as missing."""
    c = F.col(column) if isinstance(column, str) else column
    value = c.try_cast("double")
    value = F.when(F.isnan(value), None).otherwise(value)
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """df with the columns that it lacks, and missing values of the ones that it has, set to their defaults."""
    have = set(df.columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v) for c, v in defaults.items()})


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days elapsed, rounded down: 23 hours are 0 days."""
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(float(DAY_US)))


def sunday_week(ts: Column) -> Column:
    """Year and week as ``YYYY-WW``; weeks begin on Sunday, days before the first Sunday are week 00."""
    week = F.floor((F.dayofyear(ts) + 6 - (F.dayofweek(ts) - 1)) / 7)
    return F.concat(F.year(ts).cast("string"), F.lit("-"), F.lpad(week.cast("string"), 2, "0"))


def monday_week(ts: Column) -> Column:
    """First and last day of the week that begins on Monday, as ``YYYY-MM-DD/YYYY-MM-DD``."""
    first = F.to_date(F.date_trunc("week", ts))
    return F.concat(first.cast("string"), F.lit("/"), F.date_add(first, 6).cast("string"))


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether the lower-case text holds one of the terms anywhere: plain searches, which cost a fraction of a pattern of all of them."""
    return reduce(or_, (text.contains(t) for t in terms)) if terms else text.rlike("")


def word_pattern(term: str) -> str:
    return r"\b" + r"\s+".join(re.escape(w) for w in term.split(" ")) + r"\b"


def contains_words(text: Column, terms: list[str]) -> Column:
    """Whether the lower-case text holds one of the terms as whole words. A term's pattern is tried only on texts that hold its longest word anywhere."""
    return reduce(or_, (text.contains(max(t.split(" "), key=len)) & text.rlike(word_pattern(t)) for t in terms)) if terms else text.rlike("")


def short_or_long(text: Column, terms: list[str]) -> Column:
    """Terms of up to four letters as whole words, longer ones anywhere."""
    short = [t for t in terms if len(t) <= 4 and t.isalpha()]
    long = [t for t in terms if t not in short]
    found = F.lit(False)
    if short:
        found = found | contains_words(text, short)
    if long:
        found = found | contains_any(text, long)
    return found


def hash_bucket(key: str | Column, n: int, salt: str = "") -> Column:
    """A bucket in [0, n) from the md5 of the key: the same value in every engine."""
    k = F.col(key) if isinstance(key, str) else key
    text = F.concat(k.cast("string"), F.lit(salt)) if salt else k.cast("string")
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % F.lit(n)).cast("int")


def vendor_of(description: Column) -> Column:
    """Vendor by four phrasings, else the first word, else ``unknown_vendor``."""
    text = F.lower(F.coalesce(description, F.lit("")))
    found = [F.trim(F.regexp_extract(text, p, 1)) for p in VENDOR_PATTERNS]
    named = [F.when((F.length(v) >= 2) & ~v.isin(NO_VENDORS), v) for v in found]
    first = F.regexp_replace(F.regexp_extract(F.trim(text), r"^\S+", 0), "[^a-z0-9]", "")
    return F.coalesce(*named, F.when(F.length(first) >= 2, first), F.lit("unknown_vendor"))


def phrases(text: Column, stop_words: list[str]) -> Column:
    """Distinct two-word phrases of eight characters or more, of words of four letters or more that are no stop words; and the whole text if it is short."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.regexp_extract_all(lowered, F.lit(r"([a-z][a-z0-9_-]{3,})"), 1), lambda w: ~w.isin(stop_words))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    whole = F.when((F.length(F.trim(lowered)) > 0) & (F.length(F.trim(lowered)) <= 80), F.array(F.trim(lowered))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(F.filter(pairs, lambda p: F.length(p) >= 8), whole)))


def dealt_by_size(texts: DataFrame, key: str, text: str, size: int = 8_000_000) -> DataFrame:
    """The rows dealt out by key to parts of about ``size`` bytes of text each, so that what a task makes of its texts, such as counts of their phrases, does not grow with the files."""
    whole = texts.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0
    return texts.repartition(max(1, -(-whole // size)), key)


def clipped(column: str | Column, low: float, high: float) -> Column:
    """The number moved into [low, high]; missing stays missing."""
    c = number(column, None)
    return F.when(c.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), c)))


def any_of(items: Column, wanted: list[str]) -> Column:
    """1 where the array holds one of the wanted values; 0 for a missing array."""
    return flag(F.arrays_overlap(items, F.array(*map(F.lit, wanted))))


def first_items(items: Column, most: int) -> Column:
    """The first ``most`` of the array's distinct values, sorted."""
    return F.slice(F.array_sort(F.array_distinct(items)), 1, most)


def looked_up(key: Column, table: dict, default) -> Column:
    """The table's value of the key, the default for others and for a missing key."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def named_values(text: Column, names: list[str]) -> Column:
    """The texts of the named fields of a printed structure (``'name': 'text'``), in order."""
    pattern = rf"'(?:{'|'.join(re.escape(n) for n in names)})'\s*:\s*'([^']+)'"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1)

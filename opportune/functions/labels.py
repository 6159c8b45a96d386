"""Column expressions for labels, categories and dates that come as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalise_label(c: Column) -> Column:
    """Trimmed, upper case, white space collapsed."""
    return F.trim(F.regexp_replace(F.upper(c), r"\s+", " "))


def safe_name(c: Column) -> Column:
    """A label as part of a column name: lower case, separators to single underscores, other signs dropped."""
    c = F.regexp_replace(F.lower(c), r"[ /\-(),.]", "_")
    c = F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9_]", ""), r"_+", "_")
    return F.regexp_replace(c, r"^_+|_+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def mapped(c: Column, aliases: dict[str, str]) -> Column:
    """c, or its alias."""
    if not aliases:
        return c
    pairs = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.element_at(pairs, c), c)


def era(time: Column, width: int = 5) -> Column:
    """'2000-2004' for a year of it, 'unknown' for null."""
    start = (F.floor(F.year(time) / width) * width).cast("int")
    return F.when(time.isNull(), "unknown").otherwise(F.concat(start.cast("string"), F.lit("-"), (start + width - 1).cast("string")))


def age_bin(age: Column) -> Column:
    """Right-closed bins; null: unknown."""
    return F.when(age.isNull(), "unknown").when(age <= 17, "0-17").when(age <= 40, "18-40").when(age <= 65, "41-65").otherwise("66+")


def parsed_age(text: Column) -> Column:
    """Years from '34', 'above 89', 'under 18' (one less) or '20-30' (the middle); null if there is no number."""
    low = F.lower(F.trim(text))
    numbers = F.regexp_extract_all(low, F.lit(r"(\d+(?:\.\d+)?)"), 1)
    first = F.try_element_at(numbers, F.lit(1)).try_cast("double")
    second = F.try_element_at(numbers, F.lit(2)).try_cast("double")
    return F.when(low.startswith("under"), first - 1).when(second.isNotNull() & low.contains("-"), (first + second) / 2).otherwise(first)


def keyword_class(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The class of the first keyword that the lower-case text holds."""
    low, out = F.lower(c), None
    for word, label in rules:
        out = F.when(low.contains(word), label) if out is None else out.when(low.contains(word), label)
    return F.lit(default) if out is None else out.otherwise(default)


def parsed_time(text: Column) -> Column:
    """A timestamp from text in any format that a cast reads; others give null."""
    return text.try_cast("timestamp")


def harmonised(c: Column, aliases: dict[str, str], missing: tuple[str, ...] = ("", "NULL", "NONE", "N/A")) -> Column:
    """A label in its canonical form: trimmed, upper case, plus signs as tight slashes, spaced hyphens as spaces, then its alias; missing tokens null."""
    c = F.regexp_replace(F.upper(c), r"\s*[+/]\s*", "/")
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+-\s+", " "), r"\s+", " "))
    return mapped(F.when(~c.isin(*missing), c), aliases)


def first_word(c: Column, stop: list[str]) -> Column:
    """The first word of a label that isn't a stop word; null without one."""
    words = F.filter(F.split(F.trim(c), r"[\s/]+"), lambda w: (w != "") & ~w.isin(*stop))
    return F.try_element_at(words, F.lit(1))


def selected(df: DataFrame, label: str, wanted: str, aliases: dict[str, str]) -> DataFrame:
    """Rows of a requested label, relabelled as requested: all its aliases if it is canonical, else the exact label only."""
    canonical = wanted in aliases.values()
    return df.where((mapped(F.col(label), aliases) if canonical else F.col(label)) == wanted).withColumn(label, F.lit(wanted))


def require_one(df: DataFrame, column: str) -> DataFrame:
    """df, after raising ValueError if the column has more than one distinct value."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(6).collect()]
    if len(found) > 1:
        raise ValueError(f"{column} has several values: {', '.join(map(str, sorted(found)))}")
    return df


def require_present(df: DataFrame, column: str, wanted: list[str], preview: int = 10) -> DataFrame:
    """df, after raising ValueError if a wanted value is absent; the message lists the first labels that there are."""
    found = {r[0] for r in df.where(F.col(column).isin(*wanted)).select(column).distinct().collect()}
    if missing := [w for w in wanted if w not in found]:
        there = [r[0] for r in df.select(column).distinct().orderBy(column).limit(preview).collect()]
        raise ValueError(f"{column} lacks {', '.join(missing)}; it has {', '.join(map(str, there))}")
    return df


def pair_key(a: Column, b: Column) -> Column:
    """One key for two labels in either order."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def month_text(time: Column) -> Column:
    """'March 2001', or 'unknown'."""
    return F.coalesce(F.date_format(time, "MMMM yyyy"), F.lit("unknown"))


def year_by_prefix(text: Column) -> Column:
    """The year that a text begins with, whatever follows; null without four digits."""
    return F.nullif(F.regexp_extract(text, r"^\s*(\d{4})", 1), F.lit("")).cast("int")


def sentence_case(c: Column) -> Column:
    """First letter in upper case, the rest in lower case."""
    low = F.lower(F.trim(c))
    return F.concat(F.upper(low.substr(1, 1)), low.substr(F.lit(2), F.length(low)))

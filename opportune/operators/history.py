"""Look-back features: what a key's records before an index time say, by windows of days."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def look_back(index: DataFrame, records: DataFrame, key: str, index_day: str, record_day: str, value: str, windows: tuple[int, ...]) -> DataFrame:
    """One row for each row of index (index_id): availability, counts, distinct values, least days and window flags of its key's records so far.

    Records of the index row's day or before it count; windows include both ends. Null keys and days match nothing, null values
    aren't counted as a value. Nothing is joined record by record: records are counted by key and day, a value where it is first
    seen, and the counts run along the days, of which a key has no more than the calendar.
    """
    k, day = "__key", "__day"
    past = records.where(F.col(key).isNotNull() & F.col(record_day).isNotNull()).select(F.col(key).alias(k), F.to_date(record_day).alias(day), F.col(value).alias("__value"))
    counted = past.groupBy(k, day).agg(F.count("*").alias("n"))
    fresh = past.where("__value is not null").groupBy(k, "__value").agg(F.min(day).alias(day)).groupBy(k, day).agg(F.count("*").alias("fresh"))
    rows = index.select("index_id", F.col(key).alias(k), F.to_date(index_day).alias(day))
    asked = rows.select(k, day).distinct().where(f"{k} is not null and {day} is not null")
    zero = lambda *cs: {c: F.lit(0).cast("bigint") for c in cs}
    days = counted.withColumns(zero("fresh", "asked")).unionByName(fresh.withColumns(zero("n", "asked"))).unionByName(asked.withColumns(zero("n", "fresh") | {"asked": F.lit(1).cast("bigint")}))
    days = days.groupBy(k, day).agg(F.sum("n").alias("n"), F.sum("fresh").alias("fresh"), F.sum("asked").alias("asked"))
    upto = Window.partitionBy(k).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    running = days.select(k, day, "asked", F.sum("n").over(upto).alias("records"), F.sum("fresh").over(upto).alias("distinct_values"), F.max(F.when(F.col("n") > 0, F.col(day))).over(upto).alias("last"))
    running = running.where("asked > 0 and records > 0").withColumn("least_days", F.datediff(day, "last")).drop("asked", "last")
    out = rows.join(running, [k, day], "left").drop(k, day)
    flags = {f"any_{w}d": F.coalesce((F.col("least_days") <= w).cast("int"), F.lit(0)) for w in windows}
    out = out.select("index_id", "records", "distinct_values", "least_days", *[v.alias(c) for c, v in flags.items()])
    return out.withColumn("available", F.col("records").isNotNull().cast("int")).fillna(0, ["records", "distinct_values"])


def within(index: DataFrame, records: DataFrame, key: str, at: str, of: str, seconds: int) -> DataFrame:
    """Rows of index with the same key's records of the `seconds` before them, both ends included: index's columns, then records' but the key.

    A range join by time buckets as wide as the window: an index row looks into its own bucket and the one before, so what meets is
    at most about twice what matches, however long a key's history is. Null keys and times match nothing.
    """
    bucket = lambda c: F.floor(F.col(c).cast("timestamp").cast("double") / seconds)
    left = index.where(F.col(at).isNotNull()).withColumn("__bucket", F.explode(F.array(bucket(at) - 1, bucket(at))))
    right = records.where(F.col(of).isNotNull()).withColumn("__bucket", bucket(of))
    moment = lambda c: F.col(c).cast("timestamp")
    met = left.join(right, [key, "__bucket"]).where((moment(of) <= moment(at)) & (moment(of) >= moment(at) - F.expr(f"interval {seconds} seconds")))
    return met.select(*index.columns, *[c for c in records.columns if c != key])


@dataclass(frozen=True)
class History:
    """Records that a point-in-time star looks back on: their key, day and, for some kinds, a value.

    kind "any": whether there were records within each window of days; "count": how many records and distinct values so far;
    "first": the value of the key's first record (by day, then value) whenever it is, as with what doesn't change; "worst": the
    most severe value so far, by `order`; "suppressed": records whose times can't be trusted, which never count as known.
    strict: only records of days before the index row's count, not those of its own day.
    """

    name: str
    frame: DataFrame
    key: str
    day: str
    kind: str = "any"
    value: str | None = None
    windows: tuple[int, ...] = ()
    order: tuple[str, ...] = ()
    strict: bool = False


def point_in_time(index: DataFrame, key: str, day: str, histories: Sequence[History]) -> DataFrame:
    """index with columns of every history as of its row's day: rows are kept one for one.

    All histories are one tagged union, grouped by key and day with an aggregate for each, and one window runs along a key's days;
    so any number of histories takes one grouping, one window and one join, and a key has as many rows as the calendar has days.
    Columns: <name>_<w>d, <name>_available (any); <name>_records, <name>_values, <name>_available (count); <name>,
    <name>_available (first, worst); <name> null, <name>_available 0 (suppressed). Null keys or days match nothing; an index row
    without records has 0, or null values; records with a null value count as records, not as a value. Clashing names raise.
    """
    k, d, tag, v, fresh = "__key", "__day", "__tag", "__value", "__fresh"
    kinds = {"any", "count", "first", "worst", "suppressed"}
    if bad := [h.name for h in histories if h.kind not in kinds]:
        raise ValueError(f"unknown kind of history: {', '.join(bad)}")
    none, parts = F.lit(None).cast("string"), []
    for h in histories:
        if h.kind == "suppressed":
            continue
        value = F.col(h.value).cast("string") if h.value else none
        rows = h.frame.where(F.col(h.key).isNotNull() & F.col(h.day).isNotNull()).select(F.col(h.key).alias(k), F.to_date(h.day).alias(d), F.lit(h.name).alias(tag), value.alias(v), F.lit(0).alias(fresh))
        parts.append(rows)
        if h.kind == "count":  # a value counts on the day that it is first seen
            firsts = rows.where(F.col(v).isNotNull()).groupBy(k, v).agg(F.min(d).alias(d))
            parts.append(firsts.select(k, d, F.lit(h.name).alias(tag), v, F.lit(1).alias(fresh)))
    asked = index.select(F.col(key).alias(k), F.to_date(day).alias(d)).where(f"{k} is not null and {d} is not null")
    parts.append(asked.distinct().select(k, d, F.lit(None).cast("string").alias(tag), none.alias(v), F.lit(0).alias(fresh)))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    rank = lambda h: F.coalesce(*[F.when(F.col(v) == o, F.lit(len(h.order) - i)) for i, o in enumerate(h.order)])
    aggs = [F.max(F.col(tag).isNull()).alias("__asked")]
    for i, h in enumerate(histories):
        mine = F.col(tag) == h.name
        if h.kind in ("any", "count"):
            aggs.append(F.count(F.when(mine & (F.col(fresh) == 0), 1)).alias(f"__n{i}"))
        if h.kind == "count":
            aggs.append(F.sum(F.when(mine, F.col(fresh)).otherwise(0)).alias(f"__f{i}"))
        if h.kind == "first":
            aggs.append(F.min(F.when(mine & F.col(v).isNotNull(), F.col(v))).alias(f"__v{i}"))
        if h.kind == "worst":
            aggs.append(F.max(F.when(mine, rank(h))).alias(f"__r{i}"))
    days = union.groupBy(k, d).agg(*aggs)
    every = Window.partitionBy(k).orderBy(d)
    out = {}
    for i, h in enumerate(histories):
        upto = every.rowsBetween(Window.unboundedPreceding, -1 if h.strict else 0)
        if h.kind == "any":
            last = F.max(F.when(F.col(f"__n{i}") > 0, F.col(d))).over(upto)
            out |= {f"{h.name}_{w}d": F.coalesce((F.datediff(F.col(d), last) <= w).cast("int"), F.lit(0)) for w in h.windows}
            out[f"{h.name}_available"] = last.isNotNull().cast("int")
        elif h.kind == "count":
            n = F.coalesce(F.sum(f"__n{i}").over(upto), F.lit(0))
            out |= {f"{h.name}_records": n, f"{h.name}_values": F.coalesce(F.sum(f"__f{i}").over(upto), F.lit(0)), f"{h.name}_available": (n > 0).cast("int")}
        elif h.kind == "first":
            first = F.min(F.when(F.col(f"__v{i}").isNotNull(), F.struct(d, f"__v{i}"))).over(Window.partitionBy(k))[f"__v{i}"]
            out |= {h.name: first, f"{h.name}_available": first.isNotNull().cast("int")}
        elif h.kind == "worst":
            most = F.max(f"__r{i}").over(upto)
            out |= {h.name: F.coalesce(*[F.when(most == len(h.order) - j, F.lit(o)) for j, o in enumerate(h.order)]), f"{h.name}_available": most.isNotNull().cast("int")}
        else:
            out |= {h.name: none, f"{h.name}_available": F.lit(0)}
    if clash := set(index.columns) & set(out):
        raise ValueError(f"index has columns of these names: {', '.join(sorted(clash))}")
    state = days.select(k, d, "__asked", *[c.alias(n) for n, c in out.items()]).where("__asked").drop("__asked")
    rows = index.withColumns({k: F.col(key), d: F.to_date(day)}).join(state, [k, d], "left").drop(k, d)
    zero = [n for n in out if n.endswith(("_available", "_records", "_values")) or any(n == f"{h.name}_{w}d" for h in histories for w in h.windows)]
    return rows.select(*index.columns, *out).fillna(0, zero)


def active(start: Column, end: Column, lenient: bool = False) -> Column:
    """Was a condition active at the index? start and end in days before it; lenient: an unknown start counts as started."""
    started = (start.isNull() | (start >= 0)) if lenient else F.coalesce(start >= 0, F.lit(False))
    return started & (end.isNull() | (end <= 0))


def active_counts(df: DataFrame, key: str, name: str, start: str, end: str) -> DataFrame:
    """Distinct active conditions by the strict and the lenient rule, and whether some record has no dates."""
    s, e = F.col(start), F.col(end)
    return df.groupBy(key).agg(
        F.countDistinct(F.when(active(s, e), F.col(name))).alias("active_strict"), F.countDistinct(F.when(active(s, e, True), F.col(name))).alias("active_lenient"), F.max(F.when(s.isNull() & e.isNull(), 1).otherwise(0)).alias("undated")
    )


def merge_features(base: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """base with features by key, rows preserved; a duplicate feature key raises."""
    from .cleaning import assert_unique

    return base.join(assert_unique(features, [key]), key, "left")


def suppressed(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the columns null and `available` 0: aggregates of records whose times can't be verified don't count as known."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.lit(None).cast(kinds[c]) for c in columns} | {"available": F.lit(0)})

"""Ordered operators that never bring a whole key, or the whole table, into one task.

A row's order key is cut into fixed-width buckets. Windows run inside a (key, bucket) pair, and a
table with one row per pair carries totals or last values from earlier buckets. The order key is an
integer such as an id, a line number or a time in ms, so ``width`` bounds how far a bucket reaches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 20


def _bucketed(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("__bucket", F.floor(F.col(order) / F.lit(width)).cast("long"))


def _same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def _attach(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    renamed = carried
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    )
    return rows.join(renamed, condition, "left").drop(*[f"__r_{k}" for k in keys])


def running_sums(
    df: DataFrame,
    order: str,
    sums: dict[str, Column],
    by: tuple[str, ...] = (),
    ties: tuple[str, ...] = (),
    width: int = WIDTH,
) -> DataFrame:
    """Add inclusive running sums of never-null values over ``order`` (then ``ties``), per ``by`` key.

    What earlier buckets carry over is a row of its own before a bucket's first one, so no row meets it in a join.
    """
    keys = [*by, "__bucket"]
    rows = _bucketed(df, order, width).select("*", *[c.alias(f"__v_{n}") for n, c in sums.items()])
    totals = rows.groupBy(*keys).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    earlier = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = totals.select(*keys, *[F.sum(f"__t_{n}").over(earlier).alias(f"__v_{n}") for n in sums])
    carried = carried.where(reduce(lambda a, b: a | b, [F.col(f"__v_{n}") != 0 for n in sums]))
    both = rows.withColumn("__own", F.lit(True)).unionByName(carried.withColumn("__own", F.lit(False)), allowMissingColumns=True)
    inside = Window.partitionBy(*keys).orderBy("__own", order, *ties).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    summed = both.select(*df.columns, "__own", *[F.sum(f"__v_{n}").over(inside).alias(f"__s_{n}") for n in sums])
    return summed.where("__own").select(*df.columns, *[F.col(f"__s_{n}").alias(n) for n in sums])


def running_min(
    df: DataFrame, order: str, values: dict[str, Column], by: tuple[str, ...] = (), ties: tuple[str, ...] = (), width: int = WIDTH,
) -> DataFrame:
    """Add inclusive running minima over ``order`` (then ``ties``), per ``by`` key."""
    keys = [*by, "__bucket"]
    rows = _bucketed(df, order, width)
    totals = rows.groupBy(*keys).agg(*[F.min(c).alias(f"__t_{n}") for n, c in values.items()])
    earlier = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, *[F.min(f"__t_{n}").over(earlier).alias(f"__c_{n}") for n in values])
    inside = Window.partitionBy(*keys).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.select("*", *[F.min(c).over(inside).alias(f"__l_{n}") for n, c in values.items()])
    return _attach(local, carried, keys).select(*df.columns, *[F.least(f"__l_{n}", f"__c_{n}").alias(n) for n in values])


def with_ordinal(
    df: DataFrame, order: str, out: str = "ordinal", by: tuple[str, ...] = (), width: int = WIDTH,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """1-based position by an integer ``order`` key that is unique together with ``ties``."""
    return running_sums(df, order, {out: F.lit(1).cast("long")}, by=by, ties=ties, width=width)


def carry_last(
    df: DataFrame,
    order: str,
    values: dict[str, Column],
    by: tuple[str, ...] = (),
    ties: tuple[str, ...] = (),
    width: int = WIDTH,
) -> DataFrame:
    """Add the last non-null value of each expression strictly before the row, per ``by`` key."""
    keys = [*by, "__bucket"]
    rows = _bucketed(df, order, width).select(
        "*", *[c.alias(f"__v_{n}") for n, c in values.items()]
    )
    position = F.struct(order, *ties)
    tails = rows.groupBy(*keys).agg(
        *[
            F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), position)).alias(f"__t_{n}")
            for n in values
        ]
    )
    earlier = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = tails.select(
        *keys, *[F.last(f"__t_{n}", ignorenulls=True).over(earlier).alias(f"__c_{n}") for n in values]
    )
    inside = Window.partitionBy(*keys).orderBy(order, *ties).rowsBetween(
        Window.unboundedPreceding, -1
    )
    local = rows.select(
        "*", *[F.last(f"__v_{n}", ignorenulls=True).over(inside).alias(f"__l_{n}") for n in values]
    )
    joined = _attach(local, carried, keys)
    return joined.select(
        *df.columns, *[F.coalesce(f"__l_{n}", f"__c_{n}").alias(n) for n in values]
    )


def numbered_after(
    df: DataFrame, order: str, out: str, values: dict[str, Column], width: int = WIDTH
) -> DataFrame:
    """``with_ordinal`` by a unique ``order`` and ``carry_last`` of never-null ``values``, with one shuffle of the rows."""
    rows = _bucketed(df, order, width).withColumn("__v", F.struct(*[c.alias(n) for n, c in values.items()]))
    tails = rows.groupBy("__bucket").agg(F.count("*").alias("__n"), F.max_by("__v", F.struct(order)).alias("__t"))
    earlier = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(
        "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__c"), F.last("__t").over(earlier).alias("__e")
    )
    inside = Window.partitionBy("__bucket").orderBy(order)
    local = rows.select("*", F.row_number().over(inside).alias("__l"), F.lag("__v").over(inside).alias("__p"))
    joined = _attach(local, carried, ["__bucket"])
    before = F.coalesce("__p", "__e")
    return joined.select(*df.columns, (F.col("__l") + F.col("__c")).alias(out), *[before[n].alias(n) for n in values])


def islands(df: DataFrame, pos: str, by: tuple[str, ...] = (), width: int = WIDTH) -> DataFrame:
    """Add ``run``: equal for rows whose positions follow each other without a hole."""
    numbered = with_ordinal(df, pos, "__n", by=by, width=width)
    return numbered.withColumn("run", F.col(pos) - F.col("__n")).drop("__n")


def out_of_order(df: DataFrame, stamp: str, pos: str, width: int = WIDTH) -> DataFrame:
    """Rows whose stamp is smaller than the previous row's."""
    previous = carry_last(df, pos, {"previous_stamp": F.col(stamp)}, width=width)
    return previous.where(F.col(stamp) < F.col("previous_stamp"))


def top_per_key(df: DataFrame, key: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows per key. Spark limits each map task to n rows per key before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def keyset_page(
    df: DataFrame, id_col: str, cursor: int | None, limit: int
) -> tuple[DataFrame, DataFrame]:
    """(page, info): rows below the cursor, newest first cut, plus has_more and next_cursor.

    The page is bounded by ``limit``, a report feature; info is one row.
    """
    below = df if cursor is None else df.where(F.col(id_col) < cursor)
    probe = below.orderBy(F.desc(id_col)).limit(limit + 1)
    # At most limit + 1 rows from here on.
    ranked = probe.withColumn("__r", F.row_number().over(Window.orderBy(F.desc(id_col))))
    page = ranked.where(F.col("__r") <= limit).drop("__r").orderBy(id_col)
    info = ranked.agg(
        (F.count("*") > limit).alias("has_more"),
        F.when(
            F.count("*") > limit, F.min(F.when(F.col("__r") <= limit, F.col(id_col)))
        ).alias("next_cursor"),
    )
    return page, info

"""Line dedup on overlapping three-line windows, in DataFrame functions only.

Windows run over the non-blank lines of a text (trimmed for comparison); a text of one or two such lines is one window. The
first occurrence of a window, by doc_id, text and position, stays; the lines of every later occurrence go, save those
that the first one itself covers. Covered ranges are merged before lines are cut, blank lines between them included.
A long passage repeats between differing neighbours too: one line, or two in a row, of ``passage`` words or more is a window
of its own, in the same grouping. The registered query follows its SQL, which knows the three-line windows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query, table

LINE = r"\n"
PASSAGE = 50  # words from which one or two lines are a window of their own


def _named(text: Column, passage: int | None) -> Column:
    """array of (i, a, b, n): the non-blank lines' numbers, two hashes of each and its words, if they are asked for."""
    lines = F.transform(F.split(text, LINE, -1), lambda line, i: F.struct(i.alias("i"), F.trim(line).alias("line")))
    return F.transform(
        F.filter(lines, lambda x: x.line != ""),
        lambda x: F.struct(
            x.i.alias("i"),
            F.xxhash64(x.line).alias("a"),
            F.xxhash64(F.lit(7), x.line).alias("b"),
            (F.lit(0) if passage is None else F.regexp_count(x.line, F.lit(r"\S+"))).alias("n"),
        ),
    )


def _window(named: str, j: Column, length: int) -> Column:
    part = F.slice(named, j + 1, F.lit(length))
    return F.struct(
        F.xxhash64(F.transform(part, lambda y: y.a)).alias("h1"),
        F.xxhash64(F.transform(part, lambda y: y.b)).alias("h2"),
        F.get(named, j).i.alias("start"),
        F.get(named, F.least(j + length, F.size(named)) - 1).i.alias("end"),
    )


def _windows(named: str, passage: int | None) -> Column:
    """array of (h1, h2, start, end): 128-bit window hashes and the line range that each covers."""
    size = F.size(named)
    threes = F.transform(F.sequence(F.lit(0), F.greatest(size - 3, F.lit(0))), lambda j: _window(named, j, 3))
    if passage is not None:
        at = F.sequence(F.lit(0), size - 1)
        ones = F.filter(at, lambda j: F.get(named, j).n >= passage)
        twos = F.filter(at, lambda j: F.get(named, j).n + F.get(named, j + 1).n >= passage)  # null at the last line
        threes = F.concat(threes, F.transform(ones, lambda j: _window(named, j, 1)), F.transform(twos, lambda j: _window(named, j, 2)))
    return F.when(size > 0, threes)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", passage: int | None = PASSAGE) -> DataFrame:
    """``docs`` with repeated lines cut from ``text``, and the columns ``n_lines`` and ``n_removed`` (long).

    Every row stays, with all its columns (columns already named n_lines or n_removed are replaced). Null text stays
    null and has no lines removed. Without ``passage`` only three-line windows and whole texts count. Rows equal in key and text count as one document and are cut alike; a null key is
    a key, the smallest. Nothing is cut from an empty table.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(
        F.struct(*columns).alias("row"), F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.coalesce(text, F.lit("")).alias("body")
    )
    named = keyed.select("k", "t", _named(F.col("body"), passage).alias("named"))
    windows = named.select("k", "t", F.explode(_windows("named", passage)).alias("w")).select("k", "t", "w.*")
    firsts = (
        windows.groupBy("h1", "h2")
        .agg(F.min(F.struct("k", "t", "start", "end")).alias("first"), F.max(F.struct("k", "t", "start", "end")).alias("last"))
        .where(~F.col("first").eqNullSafe(F.col("last")))
        .drop("last")
    )
    same_text = F.col("first.k").eqNullSafe(F.col("k")) & (F.col("first.t") == F.col("t"))
    later = (
        windows.join(firsts, ["h1", "h2"])
        .where(~(same_text & (F.col("first.start") == F.col("start"))))
        .select("k", "t", F.when(same_text, F.greatest("start", F.col("first.end") + 1)).otherwise(F.col("start")).alias("start"), "end")
        .where(F.col("start") <= F.col("end"))
    )
    merged = merge_ranges(later.groupBy("k", "t", "start").agg(F.max("end").alias("end")))
    cuts = merged.select(F.col("k").alias("ck"), F.col("t").alias("ct"), "cuts")
    joined = keyed.join(cuts, F.col("k").eqNullSafe(F.col("ck")) & (F.col("t") == F.col("ct")), "left")
    joined = joined.withColumn("lines", F.split("body", LINE, -1))
    lines = F.col("lines")
    cut = F.array_join(_kept(lines, F.col("cuts")), "\n")
    removed = F.aggregate("cuts", F.lit(0), lambda acc, c: acc + c.end - c.start + 1)
    kept = [F.col(f"row.{c}") if c != text else F.when(F.col("cuts").isNull(), F.col(f"row.{c}")).otherwise(cut).alias(c) for c in columns]
    return joined.select(
        *kept,
        F.when(F.col("body") == "", 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
    )


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """(k, t, cuts): per document its ranges, merged where they meet, as a sorted array."""
    by = Window.partitionBy("k", "t").orderBy("start")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("reach") + 1, 0).otherwise(1)).over(by)
    return (
        ranges.withColumn("reach", reach)
        .withColumn("island", island)
        .groupBy("k", "t", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("k", "t")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    )


def _kept(lines: Column, cuts: Column) -> Column:
    """The lines outside disjoint sorted ranges: one slice before each range and one after the last."""
    befores = F.transform(
        cuts,
        lambda c, i: F.slice(
            lines,
            F.when(i == 0, 1).otherwise(F.get(cuts, i - 1).end + 2),
            c.start - F.when(i == 0, 0).otherwise(F.get(cuts, i - 1).end + 1),
        ),
    )
    tail = F.element_at(cuts, -1).end
    return F.concat(F.flatten(befores), F.slice(lines, tail + 2, F.greatest(F.size(lines) - tail - 1, F.lit(0))))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS i, trim(list_extract(parts, i), ' ') AS line, list_extract(parts, i) AS raw
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), named AS (
  SELECT *, row_number() OVER w AS j, count(*) OVER (PARTITION BY doc_id) AS m,
    lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3, lead(i, 1) OVER w AS i2, lead(i, 2) OVER w AS i3
  FROM lines WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), windows AS (
  SELECT doc_id, i AS s, coalesce(i3, i2, i) AS e, line, l2, l3 FROM named WHERE j = 1 OR l3 IS NOT NULL
), ranked AS (
  SELECT *, first_value(doc_id) OVER w AS fd, first_value(s) OVER w AS fs, first_value(e) OVER w AS fe
  FROM windows WINDOW w AS (PARTITION BY line, l2, l3 ORDER BY doc_id, s)
), cuts AS (
  SELECT doc_id, CASE WHEN fd = doc_id THEN greatest(s, fe + 1) ELSE s END AS s, e
  FROM ranked WHERE NOT (fd = doc_id AND fs = s)
), removed AS (
  SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM cuts
)
SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE x.n_lines END AS n_lines, x.n_removed, x.text
FROM documents d JOIN (
  SELECT l.doc_id, count(*) AS n_lines, count(r.i) AS n_removed,
    coalesce(string_agg(raw, chr(10) ORDER BY l.i) FILTER (r.i IS NULL), '') AS text
  FROM lines l LEFT JOIN removed r ON l.doc_id = r.doc_id AND l.i = r.i GROUP BY l.doc_id
) x ON d.doc_id = x.doc_id
"""


@query("op8_line_dedup", ORACLE)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), passage=None)

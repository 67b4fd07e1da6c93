"""Conversation prefix trie, rolled up by centroid decomposition of its parent-edge forest.

A node is a distinct sequence of first turns. It is named by its depth and four sums of hashes of its turns and their places,
which prefix sums give in any partitioning, and is known by its smallest member and its depth. ``member`` holds, for every
conversation and depth, the node and the next one below: it answers whether a node lies below another, and under
which child, by one look-up.

The rollup adds up a subtree's values. Every component of the forest has a centroid, the deepest node with at least half
of it below. The centroid's total is added along its path to the component's top, and the component falls into the parts
below the centroid's children and the part above it, each at most half as large. Components of more than ``fit`` nodes are
split so by joins, all at a time; smaller ones by the same steps inside a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.batches import whole_groups
from . import sequences
from .registry import query, table
from .repair import CRC_SQL, crc_sql
from .store import stored

FIT = 4096  # nodes of a component that one task decomposes
STEP = 4096  # turns over which one window adds up
SUMS = ("s1", "s2", "s3", "s4")
NODE = ("m", "d")


def ordered_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, o, same, size): a conversation's turns numbered from 1, their digests and the code points of their texts.

    By ``order`` (null first), then role and digest; null role or text is empty; rows with a null key belong to no
    conversation. Repeated rows are turns of their own.
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = turns.where(F.col(key).isNotNull()).select(
        F.col(key).alias("c"), F.col(order).alias("turn"), r.alias("role"), F.unhex(F.md5(F.concat(r, F.lit("\x00"), t))).alias("same"), F.length(t).cast("long").alias("size")
    )
    rows = sequences.placed(rows, "c", [F.col("turn"), F.col("role"), F.col("same")], "turns")
    spans = sequences.spans(rows, "c").select("c", "part", "base", "before")
    rows = rows.withColumn("part", F.shiftright("pos", sequences.PART)).join(spans, ["c", "part"])
    return rows.select("c", (F.col("before") + F.col("pos") - F.col("base") + 1).alias("o"), "same", "size")


def _halves(h: Column) -> list[Column]:
    return [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))]


def _prefixes(rows: DataFrame) -> DataFrame:
    """(c, d, s1..s4, size): for every turn the sums over the turns up to it, first within steps of turns, then over the steps."""
    parts = [*_halves(F.xxhash64("d", "same")), *_halves(F.xxhash64("same", F.lit(7), "d"))]
    rows = rows.select("c", "d", "size", F.floor(F.col("d") / STEP).alias("b"), *[p.alias(s) for p, s in zip(parts, SUMS)])
    within = Window.partitionBy("c", "b").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    steps = rows.groupBy("c", "b").agg(*[F.sum(s).alias(s) for s in SUMS])
    before = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select("c", "b", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"p_{s}") for s in SUMS])
    sums = rows.select("c", "b", "d", "size", *[F.sum(s).over(within).alias(s) for s in SUMS]).join(steps, ["c", "b"])
    return sums.select("c", "d", "size", *[(F.col(s) + F.col(f"p_{s}")).alias(s) for s in SUMS])


def trie(rows: DataFrame, ids: DataFrame, fit: int = FIT) -> DataFrame:
    """One row per node of the trie of ``rows`` (c, d, same, size): turns of conversation c at depths 1 to n without gaps.

    ``ids`` (c) are all conversations, turnless ones too; both are without nulls and repeats. Without conversations there
    is no root and no row. Columns: m (smallest member), d, parent (its m; root: null), n_convs, n_children, n_leaves,
    saved (summed over the subtree: (n_convs - 1) times size) and ends (digest of the ids that end here).
    """
    rows = stored(_prefixes(rows), "prefixes")
    named = rows.groupBy("d", *SUMS).agg(F.min("c").alias("m"), F.count("*").alias("n"), F.max("size").alias("size"))
    named = stored(named, "nodes")
    root = stored(ids.agg(F.min("c").alias("m"), F.count("*").alias("n")).where("n > 0"), "root")
    at_root = ids.select("c", F.lit(0).cast("long").alias("d")).withColumn("m", root.select("m").scalar())
    member = rows.select("c", "d", *SUMS).join(named.select("d", *SUMS, "m"), ["d", *SUMS]).select("c", "d", "m").unionByName(at_root)
    member = stored(member, "prefix_nodes")
    below = member.select("c", (F.col("d") - 1).alias("d"), F.col("m").alias("next"))
    member = stored(member.join(below, ["c", "d"], "left"), "member")
    edges = member.where(F.col("next") == F.col("c")).select(F.col("c").alias("m"), (F.col("d") + 1).alias("d"), F.col("m").alias("parent"))
    children = edges.groupBy(F.col("parent").alias("m"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"))
    all_nodes = named.select(*NODE, "n", "size").unionByName(root.select("m", F.lit(0).cast("long").alias("d"), "n", F.lit(0).cast("long").alias("size")))
    nodes = all_nodes.join(edges, [*NODE], "left").join(children, [*NODE], "left")
    # a subtree's nodes are those first met by its members, save the part of the smallest member's path above it
    own = nodes.groupBy(F.col("m").alias("c")).agg(F.count("*").alias("own"), F.min("d").alias("top"))
    counted = member.join(own, "c").groupBy(*NODE).agg(F.sum("own").alias("own"), F.max(F.when(F.col("c") == F.col("m"), F.col("top"))).alias("top"))
    nodes = nodes.join(counted, [*NODE]).select(
        *NODE, "parent", "n", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        (F.col("own") - (F.col("d") - F.col("top"))).alias("below"), ((F.col("n") - 1) * F.col("size")).alias("saved"),
    )
    nodes = stored(nodes, "tree")
    sums = _rollup(nodes, member, fit)
    ends = member.where("next IS NULL").select(*NODE, "c", F.col("c").cast("string").alias("id"))
    ends = sequences.digests(ends, [*NODE], ["c"], "id", ",").withColumnRenamed("sha256", "ends")
    out = nodes.drop("saved", "below").join(sums, [*NODE]).join(ends, [*NODE], "left")
    return out.withColumnRenamed("n", "n_convs").withColumn("ends", F.coalesce("ends", F.sha2(F.lit(""), 256)))


def _rollup(nodes: DataFrame, member: DataFrame, fit: int) -> DataFrame:
    """(m, d, n_leaves, saved): sums over subtrees, by centroid decomposition."""
    zero = F.lit(0).cast("long")
    leaf = (F.col("n_children") == 0).cast("long")
    columns = ["cm", "cd", *NODE, "parent", "below", "leaf", "saved", "n_leaves", "total"]
    top = nodes.where("d = 0").select("m").scalar()
    active = nodes.select(top.alias("cm"), zero.alias("cd"), *NODE, "parent", "below", leaf.alias("leaf"), "saved", zero.alias("n_leaves"), zero.alias("total"))
    comp, ready, solved = ["cm", "cd"], [], []
    while True:
        tops = active.where((F.col("m") == F.col("cm")) & (F.col("d") == F.col("cd"))).select(*comp, F.col("below").alias("whole"))
        large = stored(tops.where(F.col("whole") > fit), "large")
        ready.append(active.join(large, comp, "left_anti").select(*columns))
        if large.isEmpty():
            break
        split = active.join(large, comp)
        centroid = split.where(F.col("below") * 2 >= F.col("whole")).groupBy(*comp).agg(F.min(F.struct("below", *NODE)).alias("x"))
        centroid = stored(centroid.select(*comp, F.col("x.m").alias("xm"), F.col("x.d").alias("xd"), F.col("x.below").alias("gone")), "centroids")
        look = member.select(F.col("c").alias("m"), F.col("d").alias("xd"), F.col("m").alias("at"), "next")
        seen = split.join(centroid, comp).join(look, ["m", "xd"], "left")
        under = F.coalesce((F.col("at") == F.col("xm")) & (F.col("d") >= F.col("xd")), F.lit(False))
        seen = stored(seen.withColumn("under", under), "split")
        totals = seen.where("under").groupBy(*comp).agg(F.sum("leaf").alias("t_leaf"), F.sum("saved").alias("t_saved"))
        path = member.join(centroid.join(totals, comp), F.col("c") == F.col("xm")).where("d BETWEEN cd AND xd")
        path = path.select(*NODE, "t_leaf", "t_saved", F.col("gone").alias("less"))
        done = seen.drop("whole", "gone").join(path, [*NODE], "left")
        plus = lambda a, b: (F.col(a) + F.coalesce(b, zero)).alias(a)
        inside = F.col("under") & (F.col("d") > F.col("xd"))
        done = done.select(
            F.when(inside, F.col("next")).otherwise(F.col("cm")).alias("cm"), F.when(inside, F.col("xd") + 1).otherwise(F.col("cd")).alias("cd"), *NODE, "parent",
            (F.col("below") - F.coalesce("less", zero)).alias("below"), "leaf", "saved", plus("n_leaves", "t_leaf"), plus("total", "t_saved"),
            ((F.col("m") == F.col("xm")) & (F.col("d") == F.col("xd"))).alias("is_centroid"),
        )
        done = stored(done, "level")
        solved.append(done.where("is_centroid"))
        active = done.where("NOT is_centroid").drop("is_centroid")
    rest = ready[0]
    for more in ready[1:]:
        rest = rest.unionByName(more)
    made = rest.select(F.xxhash64(*comp).alias("group"), *columns).repartition("group").sortWithinPartitions("group")
    kind = nodes.schema["m"].dataType.simpleString()
    out = made.mapInArrow(_decompose_groups, f"m {kind}, d long, n_leaves long, saved long")
    for more in solved:
        out = out.unionByName(more.select(*NODE, "n_leaves", F.col("total").alias("saved")))
    return out


def _decompose_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, _ in whole_groups(batches, "group"):
        at = pd.MultiIndex.from_arrays([rows.column("m").to_pandas(), rows.column("d").to_pandas()])
        up = pd.MultiIndex.from_arrays([rows.column("parent").to_pandas(), rows.column("d").to_pandas() - 1])
        is_top = (rows.column("m").to_pandas() == rows.column("cm").to_pandas()) & (rows.column("d").to_pandas() == rows.column("cd").to_pandas())
        parent = np.where(is_top, -1, at.get_indexer(up))
        numbers = [rows.column(c).to_numpy().copy() for c in ("below", "leaf", "saved", "n_leaves", "total")]
        leaves, total = decompose(parent, *numbers)
        kind = rows.schema.field("m").type
        yield pa.RecordBatch.from_arrays([rows.column("m").combine_chunks().cast(kind), rows.column("d").combine_chunks(), pa.array(leaves), pa.array(total)], ["m", "d", "n_leaves", "saved"])


def decompose(parent: np.ndarray, below: np.ndarray, leaf: np.ndarray, saved: np.ndarray, leaves: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subtree sums of a forest (parent -1: a top), added to ``leaves`` and ``total``; ``below`` counts a subtree's nodes."""
    here = np.arange(len(parent))
    solved, top = np.zeros(len(parent), bool), parent < 0
    label = _tops(parent, top, solved)
    values, sums = np.stack((leaf, saved), 1), np.stack((leaves, total), 1)
    while not solved.all():
        open_ones = here[~solved]
        fit = open_ones[2 * below[open_ones] >= below[label[open_ones]]]
        fit = fit[np.lexsort((below[fit], label[fit]))]
        centre = fit[np.concatenate(([True], label[fit][1:] != label[fit][:-1]))]
        end = label[centre].copy()
        solved[centre] = True
        fresh = here[~solved & (parent >= 0)]
        fresh = fresh[solved[parent[fresh]] & ~top[fresh]]
        top[fresh] = True
        label = _tops(parent, top, solved)
        parts = np.zeros_like(values)
        left = here[~solved]
        np.add.at(parts, label[left], values[left])
        sum_of = values.copy()
        np.add.at(sum_of, parent[fresh], parts[fresh])
        node, source = centre, centre
        sums[node] += sum_of[source]
        while len(node):
            more = node != end
            node, source, end = parent[node[more]], source[more], end[more]
            sums[node] += sum_of[source]
            below[node] -= below[source]
    return sums[:, 0].copy(), sums[:, 1].copy()


def _tops(parent: np.ndarray, top: np.ndarray, solved: np.ndarray) -> np.ndarray:
    """The top of every node's component, by pointer doubling; a solved node is alone."""
    label = np.where(top | solved, np.arange(len(parent)), parent)
    while True:
        further = label[label]
        if (further == label).all():
            return label
        label = further


def rebuilt(turns: DataFrame, ids: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """The contract's conversations as rows (c, d, same, size): c's first h turns are those of conversation c - c % group.

    h is the CRC-32 of the decimal c, modulo ``most``.
    """
    head = lambda c: F.crc32(F.col(c).cast("string")) % most
    base = lambda c: F.col(c) - F.col(c) % group
    heads = turns.where((F.col("c") % group == 0) & (F.col("o") < most)).select(F.col("c").alias("base"), "o", "same", "size")
    of_base = ids.select("c", base("c").alias("base"), head("c").alias("h")).join(heads, "base").where("o <= h")
    known = heads.groupBy("base").agg(F.count("*").alias("n"))
    own = turns.select("*", base("c").alias("base"), head("c").alias("h")).where("o > h").join(known, "base", "left")
    own = own.select("c", (F.col("o") - F.col("h") + F.least("h", F.coalesce("n", F.lit(0)))).alias("d"), "same", "size")
    return own.unionByName(of_base.select("c", F.col("o").alias("d"), "same", "size"))


ORACLE = f"""
WITH RECURSIVE {CRC_SQL}, turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(role, '') || chr(0) || coalesce(text, ''))) AS o
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT c, c - c % 100 AS base, {crc_sql("CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT c FROM turns), crc_table
), rebuilt AS (
  SELECT i.c, t.o AS d, role, text FROM ids i JOIN turns t ON t.c = i.base AND t.o <= i.h
  UNION ALL
  SELECT i.c, t.o - i.h + least(i.h, coalesce(n, 0)), role, text FROM ids i JOIN turns t ON t.c = i.c AND t.o > i.h
    LEFT JOIN (SELECT c AS base, count(*) AS n FROM turns GROUP BY c) b ON b.base = i.base
), keyed AS (
  SELECT c, d, length(text) AS size, list(sha256(role || chr(0) || text)) OVER (PARTITION BY c ORDER BY d) AS k FROM rebuilt
), paths AS (
  SELECT c, d, size, k FROM keyed UNION ALL SELECT c, 0, 0, [] FROM ids
), member AS (
  SELECT c, d, size, min(c) OVER w AS m, count(*) OVER w AS n FROM paths WINDOW w AS (PARTITION BY k)
), nodes AS (
  SELECT m, d, any_value(n) AS n, any_value(size) AS size FROM member GROUP BY m, d
), parents AS (
  SELECT a.m, a.d, b.m AS parent FROM nodes a JOIN member b ON b.c = a.m AND b.d = a.d - 1
), children AS (
  SELECT parent AS m, d - 1 AS d, count(*) AS n_children FROM parents GROUP BY parent, d - 1
), weights AS (
  SELECT n.m, n.d, (n - 1) * size AS saved, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf FROM nodes n LEFT JOIN children c ON c.m = n.m AND c.d = n.d
), pairs AS (
  SELECT DISTINCT a.m, a.d, b.m AS bm, b.d AS bd FROM member a JOIN member b ON b.c = a.c AND b.d >= a.d
), sums AS (
  SELECT p.m, p.d, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM pairs p JOIN weights w ON w.m = p.bm AND w.d = p.bd GROUP BY p.m, p.d
), ends AS (
  SELECT m, d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS x
  FROM (SELECT *, max(d) OVER (PARTITION BY c) AS last FROM member) WHERE d = last GROUP BY m, d
)
SELECT n.m AS conv_id, n.d AS depth, parent AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
  sha256(coalesce(x, '')) AS ends_sha256
FROM nodes n JOIN sums s ON s.m = n.m AND s.d = n.d LEFT JOIN parents p ON p.m = n.m AND p.d = n.d
  LEFT JOIN children c ON c.m = n.m AND c.d = n.d LEFT JOIN ends e ON e.m = n.m AND e.d = n.d
"""


@query("op12_prefix_trie", ORACLE)
def prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(ordered_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "ordered")
    ids = stored(turns.select("c").distinct(), "ids")
    nodes = trie(rebuilt(turns, ids), ids)
    return nodes.select(
        F.col("m").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )

"""N-gram Jaccard self-join with rare-first prefix filtering, and the components of its links.

1. Every document becomes a set of shingle hashes with a fingerprint; equal sets are one node. All sets are counted
   into a table of hashed shingle counts of fixed size, which orders shingles from rare to frequent.
2. Similar sets share a shingle among their rarest n - ceil(t n) + 1. Only these prefixes are dealt out, packed; shingles
   met in one node's prefix alone are dropped.
3. Candidates of a shingle are compared star-wise: with the node whose prefix others share most, not all pairs. Nodes that
   are in one component already need no more; pairs across components that remain are all taken up at the end. Pairs pass
   length and positional filters inside the join; the positional one counts, of the rarer shingles, only those that another
   node has. What passes is verified once on whole texts, behind a suffix filter, and no pair is left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays
from .components import components
from .decontaminate import SHINGLES_SQL
from .registry import query, table
from .store import stored

SHINGLE, PERCENT = 5, 80
BUCKET_BITS = 20  # of the table of counts
CHUNK = 1 << 14
FAN = 64
PART_BYTES = 8 << 20
HOT = 50_000  # a shingle counted more often is not gathered into one part
FLUSH = 4 << 20  # prefix entries a task holds
SIEVE_BITS = 24
STARS = 6  # star rounds at most before the rest is compared pair by pair
FEW = 1000  # remaining pairs per prefix entry, counted per shingle, that the filters may face at once
_BUCKET = np.uint64(64 - BUCKET_BITS)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit fingerprints (signed) of a set of hashes."""
    one = arrays.mix(s ^ np.uint64(0x452821E638D01377)).sum() + np.uint64(len(s))
    two = arrays.mix(s ^ np.uint64(0xBE5466CF34E90C6C)).sum()
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def profile(rows: DataFrame, k: int) -> DataFrame:
    """(key, hash, n, f1, f2) of every row (key, text, hash), and each task's shingle counts as rows with a chunk."""
    kind = rows.schema["key"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        held: list[np.ndarray] = []
        waiting = 0
        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            n, f1, f2 = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for row, s in arrays.shingle_sets(batch.column(1), k):
                n[row] = len(s)
                f1[row], f2[row] = fingerprint(s)
                held.append(s >> _BUCKET)
                waiting += len(s)
                if waiting > FLUSH:
                    counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(counts))
                    held, waiting = [], 0
            none = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(f1), pa.array(f2), *none], names)
        if held:
            counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(counts))
        if key_type is not None and counts.any():
            chunks = range(len(counts) // CHUNK)
            blobs = [zlib.compress(counts[c * CHUNK : (c + 1) * CHUNK].tobytes(), 1) for c in chunks]
            task = np.full(len(blobs), TaskContext.get().partitionId() % FAN)
            empty = pa.nulls(len(blobs), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(blobs), key_type), empty, pa.array(task), empty, empty, pa.array(chunks, pa.int32()), pa.array(blobs, pa.binary())], names
            )

    names = ["key", "hash", "n", "f1", "f2", "chunk", "counts"]
    return stored(rows.mapInArrow(describe, f"key {kind}, hash long, n long, f1 long, f2 long, chunk int, counts binary"), "sets")


def counted(profiled: DataFrame) -> np.ndarray:
    """The table of counts of all documents, summed in two steps; its size is fixed."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.int64)
        for blob in group["counts"]:
            total += np.frombuffer(zlib.decompress(blob), np.int64)
        return pd.DataFrame({"chunk": [group["chunk"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    rows = profiled.where("chunk IS NOT NULL").withColumnRenamed("n", "fan")
    once = rows.groupBy("chunk", "fan").applyInPandas(add, "chunk int, counts binary")
    table_ = np.zeros(1 << BUCKET_BITS, np.int64)
    for row in once.groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect():
        table_[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(zlib.decompress(row.counts), np.int64)
    return np.minimum(table_, 2**32 - 1).astype(np.uint32)


def shared_prefixes(rows: DataFrame, counts: np.ndarray, total: int, k: int, percent: int, hot: int) -> DataFrame:
    """(sh, node, np): prefix shingles that more than one node has; np is size << 32 | position."""
    bits = max(8, int(total * 24 // PART_BYTES).bit_length())
    parts, shift = 1 << bits, np.uint64(64 - bits)
    hot = max(hot, 8 * int(counts.mean(dtype=np.float64)))
    sent = rows.sparkSession.sparkContext.broadcast(counts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = sent.value
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            sh, node, np_ = (np.concatenate(x) for x in zip(*held, strict=True))
            part = (sh >> shift).astype(np.int64)
            often = table_[sh >> _BUCKET] > hot  # dealt by node instead
            part[often] = parts + (arrays.mix(node[often].view(np.uint64)) >> shift).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part = part[order]
            packed = np.stack((sh.view(np.int64)[order], node[order], np_[order]), axis=1)
            at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            blobs = [x.tobytes() for x in np.split(packed, at[1:])]
            return pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array(blobs, pa.binary())], ["part", "blob"])

        for batch in batches:
            for _, s in arrays.shingle_sets(batch.column(0), k):
                node, _ = fingerprint(s)
                if node in seen:  # a copy within the task
                    continue
                seen.add(node)
                n = len(s)
                prefix = n - least_overlap(n, percent) + 1
                rare = s[np.argsort(table_[s >> _BUCKET], kind="stable")[:prefix]]
                held.append((rare, np.full(prefix, node), np.arange(prefix) | (n << 32)))
                size += prefix
                if size > FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        packed = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 3) for x in group["blob"]])
        packed = packed[np.lexsort((packed[:, 1], packed[:, 0]))]
        new = np.ones(len(packed), bool)
        new[1:] = (packed[1:, :2] != packed[:-1, :2]).any(axis=1)
        packed = packed[new]
        if group["part"].iloc[0] < parts:
            same = packed[1:, 0] == packed[:-1, 0]
            packed = packed[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        return pd.DataFrame({"sh": packed[:, 0], "node": packed[:, 1], "np": packed[:, 2]})

    dealt = rows.select("text").mapInArrow(deal, "part long, blob binary")
    return stored(dealt.groupBy("part").applyInPandas(meet, "sh long, node long, np long"), "prefixes")


def _may_link(a: Column, b: Column, before_a: Column, before_b: Column, percent: int) -> Column:
    """Length and positional filter on two np values of a common prefix shingle.

    Rarer shingles that the two sets may share are among the ``before`` of each that any other node has.
    """
    na, nb = F.shiftright(a, 32), F.shiftright(b, 32)
    i, j = a.bitwiseAND(0xFFFFFFFF), b.bitwiseAND(0xFFFFFFFF)
    most = F.least(before_a, before_b) + 1 + F.least(na - i - 1, nb - j - 1)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * most >= percent * (na + nb))


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that are similar, by their whole texts."""
    first = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    joined = pairs.join(second, "b").join(first, "a").select("a", "b", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                left, right = (dict(arrays.shingle_sets(batch.column(c), k)) for c in (2, 3))
                keep = [i for i in range(len(a)) if i in left and i in right and same_text(left[i], a[i]) and same_text(right[i], b[i])]
                linked = pa.array([i for i in keep if similar(left[i], right[i], percent)], pa.int64())
                yield batch.select([0, 1]).take(linked)

    def same_text(s: np.ndarray, node: int) -> bool:  # a key may have several texts
        return fingerprint(s)[0] == node

    return joined.mapInArrow(compare, "a long, b long")


def similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union; first bounded by how the sets spread over 64 ranges of hashes."""
    total = len(s) + len(t)
    apart = np.abs(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=64) - np.bincount((t >> np.uint64(58)).astype(np.int64), minlength=64)).sum()
    if (100 + percent) * (total - int(apart)) < 2 * percent * total:  # suffix filter
        return False
    both = np.concatenate((s, t))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (total - common)


def texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) for ``wanted`` (node, key); a sieve of fixed size drops most other rows before the shuffle."""
    mask = (1 << SIEVE_BITS) - 1
    slot = F.xxhash64("key").bitwiseAND(mask)
    bits = wanted.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(xxhash64(key) & 63 AS INT))")).alias("bits"))
    words = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    for row in bits.collect():  # at most 2^18 rows
        words[row.word] = row.bits
    sent = rows.sparkSession.sparkContext.broadcast(words)

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            hit = (sent.value[at >> 6] >> (at & 63)) & 1
            yield batch.filter(pa.array(hit == 1))

    kind = rows.schema["key"].dataType.simpleString()
    passed = rows.select("key", "text", slot.alias("slot")).mapInArrow(sieve, f"key {kind}, text string, slot long")
    return stored(passed.join(wanted, "key").select("node", "text").dropDuplicates(), "texts")


def similar_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT, hot: int = HOT
) -> DataFrame:
    """(key, n_shingles, component_id) of every row of ``docs``.

    Words are lower-cased (A-Z) runs without white space; a text of fewer than ``k`` words is one shingle. Null or blank
    texts have no shingles and are linked with nothing; a row's component_id is the smallest key that links reach.
    Repeated rows get the same component. Rows of one key with different texts are linked by their texts alone. Rows
    with a null key take no part and get a null component. Keys are integers; other columns are not read; an empty
    table gives no rows. Two sets with equal 64-bit fingerprints are told apart by a second one, and are an error.
    """
    return similar_rows(docs, key, text, k, percent, hot).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def similar_rows(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT, hot: int = HOT
) -> DataFrame:
    """(key, hash, n, component_id, root) of every row, as of ``similar_documents``.

    ``hash`` is xxhash64 of the text. ``root`` names the group, which component_id does not where keys are repeated: two
    groups may have the same smallest key. It is null in rows that are linked with nothing for want of shingles or a key.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    profiled = profile(rows.withColumn("hash", F.xxhash64("text")), k)
    sets = profiled.where("chunk IS NULL").select("key", "hash", "n", "f1", "f2")
    solid = sets.where("n > 0 AND key IS NOT NULL")
    classes = solid.groupBy(F.col("f1").alias("node")).agg(F.min("key").alias("rep"), (F.min("f2") == F.max("f2")).alias("sound"))
    total = int(sets.agg(F.coalesce(F.sum(F.ceil(F.col("n") * (100 - percent) / 100) + 1), F.lit(0))).first()[0])
    shared = shared_prefixes(rows.where("key IS NOT NULL"), counted(profiled), total, k, percent, hot)
    links = find_links(rows, shared, classes, k, percent)
    checked = classes.select("node", F.when(~F.col("sound"), F.raise_error(F.lit("two sets share a fingerprint"))).otherwise(F.col("rep")).alias("rep"))
    joined = checked.join(links, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    named = stored(joined, "names")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_node = named.join(least, "root").select(F.col("node").alias("f1"), "component_id", "root")
    linked = solid.join(by_node, "f1").select("key", "hash", "n", "component_id", "root")
    alone = sets.where("n = 0 OR key IS NULL").select("key", "hash", "n", F.col("key").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return linked.unionByName(alone)


def find_links(rows: DataFrame, shared: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, root) of the nodes that links join, from the shared prefix shingles."""
    prefix = F.shiftright("np", 32) - F.ceil(F.shiftright("np", 32) * percent / 100) + 1
    weighed = shared.groupBy("node").agg((F.count("*") * 1_000_000 / F.max(prefix)).cast("long").alias("weight"))
    nodes = stored(weighed, "nodes")
    texts = texts_of(rows, nodes.join(classes, "node").select("node", F.col("rep").alias("key")))
    few = FEW * max(shared.count(), 1000)
    ranked = shared.withColumn("before", F.row_number().over(Window.partitionBy("node").orderBy("np")) - 1)
    roots: DataFrame | None = None
    tested: DataFrame | None = None
    links: DataFrame | None = None
    for round_ in range(STARS + 1):
        placed = nodes if roots is None else nodes.join(roots, "node", "left")
        placed = placed.select("node", "weight", (F.col("node") if roots is None else F.coalesce("root", "node")).alias("comp"))
        entries = stored(ranked.join(placed, "node"), "entries")
        rank = F.col("weight") if round_ == 0 else F.xxhash64("node", F.lit(round_))
        stars = entries.groupBy("sh").agg(
            F.max(F.struct(rank.alias("rank"), "node", "np", "before", "comp")).alias("star"), F.min("comp").alias("low"), F.max("comp").alias("high")
        )
        stars = stored(stars.where("low <> high").select("sh", "star"), "stars")
        last = round_ == STARS or (round_ > 0 and _remaining(entries, stars) <= few)
        if last:
            one = entries.join(stars.select("sh"), "sh").select("sh", "node", "np", "before", "comp")
            two = one.select("sh", *[F.col(c).alias(f"{c}2") for c in ("node", "np", "before", "comp")])
            may = _may_link(F.col("np"), F.col("np2"), F.col("before"), F.col("before2"), percent)
            met = one.join(two, (one.sh == two.sh) & (F.col("comp") < F.col("comp2")) & may)
            pairs = met.select(*_pair(F.col("node"), F.col("node2")))
        else:
            may = _may_link(F.col("np"), F.col("star.np"), F.col("before"), F.col("star.before"), percent)
            met = entries.join(stars, "sh").where((F.col("comp") != F.col("star.comp")) & may)
            pairs = met.select(*_pair(F.col("node"), F.col("star.node")))
        pairs = stored(_new_pairs(pairs, tested), "pairs")
        found = stored(verify(pairs, texts, k, percent), "links")
        links = found if links is None else links.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        roots = components(links)
        if last:
            break
    return roots


def _new_pairs(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
    """The distinct pairs that are not among ``tested``: one grouping, since an anti join would run before the distinct."""
    if tested is None:
        return pairs.distinct()
    marked = pairs.withColumn("old", F.lit(False)).unionByName(tested.withColumn("old", F.lit(True)))
    return marked.groupBy("a", "b").agg(F.bool_or("old").alias("old")).where("NOT old").select("a", "b")


def _remaining(entries: DataFrame, stars: DataFrame) -> int:
    """How many pairs of nodes in different components share a prefix shingle, counted per shingle."""
    sizes = entries.join(stars.select("sh"), "sh").groupBy("sh", "comp").agg(F.count("*").alias("m"))
    pairs = sizes.groupBy("sh").agg((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))).alias("p"))
    return int(pairs.agg(F.coalesce(F.sum("p"), F.lit(0))).first()[0]) // 2


ORACLE = f"""
WITH RECURSIVE sets AS (
  SELECT DISTINCT id, unnest(s) AS s FROM ({SHINGLES_SQL.format(id="doc_id", table="documents")})
), sized AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM sets
), links AS (
  SELECT a.id AS a, b.id AS b FROM sized a JOIN sized b ON a.s = b.s AND a.id <> b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT a, a AS r FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.r = links.a
), least AS (SELECT a, min(r) AS c FROM reach GROUP BY a
), sizes AS (SELECT id, count(*) AS n FROM sets GROUP BY id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(c, doc_id), doc_id) AS component_id
FROM documents LEFT JOIN sizes ON doc_id = id LEFT JOIN least ON doc_id = a
"""


@query("op5_jaccard_join", ORACLE)
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))

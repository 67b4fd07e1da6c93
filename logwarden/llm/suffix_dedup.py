"""Removal of byte strings that start anywhere else: prefix doubling over blocks of positions, ranked by Spark.

Ranking every byte at every offset would shuffle the text dozens of times over, so the positions are kept sparse:

* Every window of ``length`` bytes is named by its anchor, the leftmost of its grams with the smallest hash. Equal windows
  have equal anchors at equal distances; a window whose anchor gram occurs once is unique at the first offset.
* Positions with the same anchor form blocks by their distance from it. All windows of a block share a core, and the block
  as a whole spans a longer string. A round ranks both: the pairs of (rank of the block that it was cut from, bytes which
  the growing offset adds) are grouped by Spark, and equal pairs get one rank.
* A block whose core is unique has no repeated window; one whose whole string is repeated has only repeated ones, past the
  threshold. Both are finished. The others, and one of every kind of repeated block that they may still meet, are cut into
  smaller blocks, whose cores are longer: ``SPANS`` positions a block, to the single one, whose core is the window.

Texts are told apart by 128 bits of their SHA-256, so copies are looked at once; ranks are 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays
from .registry import query, table
from .store import stored

LENGTH = 400  # bytes from which a repeated string goes
GRAM = 32  # bytes of an anchor
SPANS = (64, 8, 1)  # positions of a block in each round; the last must be 1
SEGMENT = 1 << 18  # positions that are hashed at a time

# a block's first position, their number, their first phase, its rank, the other places of the same block in its text, its bytes
RANKED = (
    "t binary, at long, k int, phase int, rank binary, also array<bigint>, text binary, "
    "children array<struct<at:bigint,k:int,phase:int,core:binary,whole:binary>>"
)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, segment: int = SEGMENT) -> tuple[np.ndarray, ...]:
    """(row, first, count, phase, name) of maximal runs of windows with one anchor; phase is the first's place in the anchor's reach.

    ``data`` holds rows from ``offsets`` on; windows lie within a row. ``phase`` rises with the position: the window that
    ends with its anchor has the last one. Long data is hashed in segments; a run over a border comes in two parts.
    """
    reach, parts = length - gram + 1, []
    for low in range(0, max(len(data) - length + 1, 0), segment):
        part = data[low : low + segment + length - 1]
        names, n = _gram_names(part, gram), len(part) - length + 1
        at = _leftmost_least(names, reach)[:n]
        row = np.searchsorted(offsets, np.arange(low, low + n), "right") - 1
        whole = np.arange(low, low + n) + length <= offsets[row + 1]
        new = whole.copy()
        new[1:] &= (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | ~whole[:-1]
        first = np.flatnonzero(new)
        upto = np.cumsum(whole)
        count = np.diff(np.concatenate((upto[first] - 1, upto[-1:])))
        parts.append((row[first], first + low - offsets[row[first]], count, reach - 1 - (at[first] - first), names[at[first]]))
    return tuple(map(np.concatenate, zip(*parts))) if parts else (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)


def _gram_names(data: np.ndarray, gram: int) -> np.ndarray:
    power, inverse = arrays.powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(arrays._CODE[data] * power[: len(data)], out=sums[1:])
    return arrays.mix((sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1])


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each start, the place of the leftmost smallest of ``width`` values: the minima of block suffixes and prefixes."""
    n = -(-len(values) // width) * width
    rows = np.full(n, np.uint64(2**64 - 1))
    rows[: len(values)] = values
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]
    places = np.arange(n).reshape(-1, width)
    # the leftmost place of each running minimum: ahead, where it last fell; behind, where the value itself is the minimum
    fell = np.ones(rows.shape, bool)
    fell[:, 1:] = ahead[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(fell, places, 0), axis=1).ravel()
    own = np.where(rows == behind, places, n)
    behind_at = np.minimum.accumulate(own[:, ::-1], axis=1)[:, ::-1].ravel()
    ahead, behind = ahead.ravel(), behind.ravel()
    starts = np.arange(len(values) - width + 1)
    ends = starts + width - 1
    return np.where(behind[starts] <= ahead[ends], behind_at[starts], ahead_at[ends])


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def _children(text: bytes, at: int, k: int, phase: int, rank: bytes, span: int, parent: int, length: int) -> list[dict]:
    """The blocks of ``span`` positions of a block of ``parent`` positions (0: of all of an anchor), with their rank pairs.

    A core's rank pairs the rank of the parent's core with the bytes added on its two sides; a whole string has a rank
    only where every one of the block's positions is there.
    """
    out = []
    low = phase // parent * parent if parent else 0
    left, right = (low + parent - 1 - phase, low - phase + length) if parent else (0, 0)
    for j in range(phase // span, (phase + k - 1) // span + 1):
        start, end = j * span, (j + 1) * span  # phases
        a, b = end - 1 - phase, start - phase + length
        core = _digest(rank, j.to_bytes(4, "big"), text[a:left], b"|", text[right:b]) if parent else _digest(rank, j.to_bytes(4, "big"), text[a:b])
        whole = None
        if start >= phase and end <= phase + k:
            whole = core if span == 1 else _digest(core, text[start - phase : a], b"|", text[b : end - 1 - phase + length])
        first, last = max(start, phase), min(end, phase + k)
        out.append({"at": at + first - phase, "k": last - first, "phase": first, "core": core, "whole": whole})
    return out


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(text, F.lit(""))
    return docs.select(F.col(key).alias("key"), body.alias("body"), F.unhex(F.substring(F.sha2(body, 256), 1, 32)).alias("t"))


def repeated_starts(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, spans: tuple[int, ...] = SPANS) -> DataFrame:
    """(t, at, k): runs of positions in the distinct texts ``t`` whose ``length`` bytes start anywhere else, another text or place.

    A text that is there several times counts once here (``repeated_bytes`` adds that its copies repeat each other). Texts
    shorter than ``length`` have no such positions; null is an empty text.
    """
    if spans[-1] != 1 or spans[0] > length:
        raise ValueError("spans must end in 1 and not exceed the length")
    spark = docs.sparkSession
    texts = _named(docs.select(text, F.lit(0).alias("_key")), "_key", text).select("t", "body").where(F.octet_length("body") >= length)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, offsets in arrays.slices(batch.column("body"), SEGMENT):
                row, _, _, _, name = anchors(data, offsets, length, gram)
                order = np.lexsort((name, row))
                row, name = row[order], name[order]
                cuts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (name[1:] != name[:-1]), [True])))
                one = cuts[:-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[one].view(np.int64)), batch.column("t").take(pa.array(row[one] + i)), pa.array(np.diff(cuts).astype(np.int32))], ["gram", "t", "n"]
                )

    seen = texts.mapInArrow(grams, "gram long, t binary, n int").groupBy("gram", "t").agg(F.max("n").alias("n"))
    seen = stored(seen, "grams")
    shared = seen.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
    wanted = seen.join(shared, "gram").groupBy("t").agg(F.collect_list("gram").alias("grams"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in arrays.slices(batch.column("body"), SEGMENT):
                rows, *runs = anchors(data, offsets, length, gram)
                bounds = np.searchsorted(rows, np.arange(j - i + 1))
                for r in range(j - i):
                    grams = np.sort(batch.column("grams")[i + r].values.to_numpy().view(np.uint64))
                    first, count, phase, name = (x[bounds[r] : bounds[r + 1]] for x in runs)
                    place = np.minimum(np.searchsorted(grams, name), len(grams) - 1)
                    shared = np.flatnonzero(grams[place] == name)
                    text = data[offsets[r] : offsets[r + 1]].tobytes()
                    chosen = zip(*(x[shared].tolist() for x in (first, count, phase, name)))
                    yield from _batches(_first_blocks(batch.column("t")[i + r].as_py(), text, chosen), ranked)

    def _first_blocks(t: bytes, text: bytes, runs: Iterator[tuple[int, int, int, int]]) -> list[dict]:
        met: dict[tuple, dict] = {}
        for at, k, phase, name in runs:
            part = text[at : at + k - 1 + length]
            known = met.get((phase, k, part))
            if known:
                known["also"].append(at)
                continue
            row = {"t": t, "at": at, "k": k, "phase": phase, "rank": name.to_bytes(8, "big"), "also": [], "text": part}
            met[phase, k, part] = row | {"children": _children(part, at, k, phase, row["rank"], spans[0], 0, length)}
        return list(met.values())

    schema = spark.createDataFrame([], RANKED).schema
    ranked = _arrow(schema)
    one = texts.groupBy("t").agg(F.first("body").alias("body"))
    level = stored(one.join(wanted, "t").mapInArrow(blocks, schema), "blocks")
    in_one_text = level.where(F.size("also") > 0).select("t", F.explode(F.concat(F.array("at"), "also")).alias("at"), "k")
    finished = [in_one_text]
    for span, smaller in zip(spans, (*spans[1:], 0)):
        child = level.select("t", F.col("at").alias("block"), F.explode("children").alias("c")).select("t", "block", "c.*")
        by_whole = child.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("t", "block", "at", "k", "phase")).alias("one"))
        whole = by_whole.where("n > 1 AND whole IS NOT NULL").select("core", F.col("whole").alias("same"))
        finished.append(stored(child.join(whole, (child["core"] == whole["core"]) & (child["whole"] == F.col("same"))).select("t", "at", "k"), "repeated"))
        if span == 1:
            break
        # a core with several kinds of blocks: one of each kind, and every partial block, are cut further
        kinds = by_whole.groupBy("core").agg(F.sum(F.when(F.col("whole").isNull(), F.col("n")).otherwise(1)).alias("kinds")).where("kinds > 1")
        whole_ones = by_whole.where("whole IS NOT NULL").join(kinds, "core").select("core", "one.*")
        partial = child.where("whole IS NULL").join(kinds, "core").select("core", "t", "block", "at", "k", "phase")
        open_ones = whole_ones.unionByName(partial).groupBy("t", F.col("block").alias("at")).agg(F.collect_list(F.struct("at", "k", "phase", "core")).alias("open"))

        def cut(batches: Iterator[pa.RecordBatch], span: int = span, smaller: int = smaller) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for block in batch.to_pylist():
                    for c in block["open"]:
                        low = c["at"] - block["at"]
                        row = {"t": block["t"], "at": c["at"], "k": c["k"], "phase": c["phase"], "rank": c["core"], "also": [], "text": block["text"][low : low + c["k"] - 1 + length]}
                        rows.append(row | {"children": _children(row["text"], c["at"], c["k"], c["phase"], c["core"], smaller, span, length)})
                yield from _batches(rows, ranked)

        level = stored(level.select("t", "at", "text").join(open_ones, ["t", "at"]).mapInArrow(cut, schema), "blocks")
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batches(rows: list[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_pylist(rows[i : i + size], schema)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint (start, end) of ranges that meet or overlap."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, **how) -> DataFrame:
    """(key, body, spans): every row of ``docs`` with its text (null: empty) and the sorted byte ranges (start, end) to remove.

    A byte goes if a ``length``-byte string that covers it also starts anywhere else: in another row, of any key, or in
    the same one; strings may overlap. All occurrences go, repeated rows included; nulls in the key are a key like any other;
    an empty table gives no rows. Other columns of ``docs`` are not read.
    """
    named = _named(docs, key, text)
    copied = named.groupBy("t").agg(F.count("*").alias("n"), F.max(F.octet_length("body")).alias("size")).where(f"n > 1 AND size >= {length}")
    none = F.array().cast("array<struct<at:bigint,k:int>>")
    starts = repeated_starts(docs, text, length, **how).groupBy("t").agg(F.collect_list(F.struct("at", "k")).alias("runs"))
    all_known = starts.withColumn("copied", F.lit(False)).unionByName(copied.select("t", none.alias("runs"), F.lit(True).alias("copied")))
    known = all_known.groupBy("t").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.max("copied").alias("copied"))
    found = named.join(known, "t", "left").select(
        "key", "body",
        F.when(F.col("copied"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("body").cast("long").alias("end"))))
        .otherwise(F.transform("runs", lambda r: F.struct(r.at.alias("start"), (r.at + r.k + (length - 1)).alias("end")))).alias("spans"),
    )
    kind = named.select(F.col("key").alias(key)).schema[key].dataType.simpleString()
    schema = docs.sparkSession.createDataFrame([], f"`{key}` {kind}, body string, spans array<struct<start:bigint,end:bigint>>").schema
    arrow = _arrow(schema)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in s or []])] for s in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), batch.column(1).cast(arrow.field(1).type), pa.array(spans, arrow.field(2).type)], schema=arrow)

    return found.mapInArrow(tidy, schema)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of the rows of ``repeated_bytes``."""
    kind = found.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    arrow = _arrow(found.sparkSession.createDataFrame([], schema).schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, counts, hashes = [], [], [], []
            for body, spans in zip(batch.column("body"), batch.column("spans").to_pylist()):
                view, end, sha = memoryview(body.as_buffer() or b""), 0, hashlib.sha256()
                for s in spans:
                    sha.update(view[end : s["start"]])
                    end = s["end"]
                sha.update(view[end:])
                sizes.append(len(view))
                removed.append(sum(s["end"] - s["start"] for s in spans))
                counts.append(len(spans))
                hashes.append(sha.hexdigest())
            made = [pa.array(x, f.type) for x, f in zip((sizes, removed, counts, hashes), list(arrow)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), *made], schema=arrow)

    return found.mapInArrow(digest, schema)


ORACLE = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), windows AS (
  SELECT r, i, md5(b[i + 1 : i + 400]) AS w FROM (SELECT r, b, unnest(range(0, octet_length(b) - 399)) AS i FROM docs WHERE octet_length(b) >= 400)
), again AS (
  SELECT r, i FROM windows JOIN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1) USING (w)
), islands AS (
  SELECT r, i, sum(CASE WHEN i <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS g
  FROM (SELECT *, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM again)
), spans AS (
  SELECT r, min(i) AS s, max(i) + 400 AS e FROM islands GROUP BY r, g
), gaps AS (
  SELECT r, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY s) AS a, s AS z FROM spans
  UNION ALL SELECT d.r, coalesce(max(e), 0), octet_length(any_value(d.b)) FROM docs d LEFT JOIN spans s ON d.r = s.r GROUP BY d.r
), kept AS (
  SELECT g.r, sha256(unhex(string_agg(CASE WHEN z > a THEN hex(b[a + 1 : z]) ELSE '' END, '' ORDER BY a))) AS kept_sha256
  FROM gaps g JOIN docs d ON g.r = d.r GROUP BY g.r
)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_spans, kept_sha256
FROM docs d JOIN kept USING (r) LEFT JOIN (SELECT r, sum(e - s) AS n, count(*) AS c FROM spans GROUP BY r) s ON d.r = s.r
"""


@query("op11_suffix_dedup", ORACLE)
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text")))

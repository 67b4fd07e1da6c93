"""Sum-of-squares online packing of token sequences into fixed windows.

A document first fills whole windows; its rest goes to the fill level at which the sum over levels of (open windows at that
level)^2 becomes least, as read from an array of counts per level. At the end of a partition, and whenever many windows are
open, the emptiest windows are cut up to close the fullest; what is left, less than one window, is cut at powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encode import Encoder
from .registry import query, table

WINDOW = 2048
END = 1
MAX_OPEN = 4096  # windows held by a task before they are closed by cutting
Piece = tuple[object, int, np.ndarray, int]  # key, start, ids, tokens of the document


class Packer:
    """Windows of one task; ``closed`` gathers finished ones as lists of pieces."""

    def __init__(self, window: int, max_open: int) -> None:
        self.window, self.max_open = window, max_open
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.held = 0
        self.closed: list[list[Piece]] = []

    def add(self, key: object, ids: np.ndarray) -> None:
        total = len(ids)
        whole = total - total % self.window
        for start in range(0, whole, self.window):
            self.closed.append([(key, start, ids[start : start + self.window], total)])
        if total > whole:
            self._place((key, whole, ids[whole:].copy(), total))

    def _place(self, piece: Piece) -> None:
        size, count = len(piece[2]), self.count
        level = 0
        if self.held:
            levels = np.flatnonzero(count[1 : self.window - size + 1]) + 1
            if len(levels):
                after = count[levels + size]
                cost = np.where(levels + size == self.window, 1 - 2 * count[levels], 2 * (after - count[levels]) + 2)
                best = len(cost) - 1 - int(np.argmin(cost[::-1]))  # of equals the fullest
                if cost[best] <= 2 * count[size] + 1:
                    level = int(levels[best])
        if level:
            held = self.open[level].pop()
            count[level] -= 1
            self.held -= 1
        else:
            held = []
        held.append(piece)
        if level + size == self.window:
            self.closed.append(held)
            return
        self.open.setdefault(level + size, []).append(held)
        count[level + size] += 1
        self.held += 1
        if self.held >= self.max_open:
            self._place_rest(self.compact())

    def _place_rest(self, rest: list[Piece]) -> None:
        for piece in rest:
            self._place(piece)

    def compact(self) -> list[Piece]:
        """Close all open windows but the contents of less than one, which are returned."""
        queue = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open, self.held = {}, 0
        self.count[:] = 0
        i, j = 0, len(queue) - 1
        while i < j:
            room = self.window - sum(len(p[2]) for p in queue[i])
            while room and i < j:
                key, start, ids, total = queue[j].pop()
                if len(ids) > room:
                    queue[j].append((key, start + room, ids[room:], total))
                queue[i].append((key, start, ids[:room], total))
                room -= min(room, len(ids))
                if not queue[j]:
                    j -= 1
            if not room:
                self.closed.append(queue[i])
                i += 1
        return queue[i] if i == j and i < len(queue) else []

    def finish(self) -> None:
        rest = self.compact()
        left = sum(len(p[2]) for p in rest)
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            part: list[Piece] = []
            while size:
                key, start, ids, total = rest.pop(0)
                if len(ids) > size:
                    rest.insert(0, (key, start + size, ids[size:], total))
                part.append((key, start, ids[:size], total))
                size -= min(size, len(ids))
            self.closed.append(part)


def pack(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, key: str = "doc_id", text: str = "text",
    max_open: int = MAX_OPEN,
) -> DataFrame:
    """Pieces of packed sequences: key, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` is binary, little-endian unsigned 32-bit: a file of token ids once written in order. Every document
    ends with ``end``; null or empty text is that id alone. Documents are taken as they come, so nothing is shuffled;
    each partition of the input packs by itself and leaves no window unfilled: its last tokens form sequences whose
    lengths are powers of two. ``sequence_id`` is the partition's number times 2^33 plus a count. Null keys and repeated
    rows are documents like any other; other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = rows.schema["key"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder.of(tokenizer), Packer(window, max_open)
        sequence = TaskContext.get().partitionId() << 33
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            keys = batch.column(0).to_pylist()
            for first, at, ids in encoder.encode(batch.column(1), end):
                bounds = at.tolist()
                for i in range(len(bounds) - 1):
                    packer.add(keys[first + i], ids[bounds[i] : bounds[i + 1]])
                yield from emit(packer, sequence, kind)
                sequence += len(packer.closed)
                packer.closed = []
        if kind is not None:
            packer.finish()
            yield from emit(packer, sequence, kind)

    schema = f"key {key_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(pieces, schema).withColumnRenamed("key", key)


def emit(packer: Packer, sequence: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    columns: list[list] = [[] for _ in range(7)]
    for i, held in enumerate(packer.closed):
        offset = 0
        for key, start, ids, total in held:
            row = key, start, len(ids), ids.astype("<u4").tobytes(), total, sequence + i, offset
            for column, value in zip(columns, row, strict=True):
                column.append(value)
            offset += len(ids)
    if columns[0]:
        types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def digests(packed: DataFrame) -> DataFrame:
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query("op1_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents"), default_tokenizer()))

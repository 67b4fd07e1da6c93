"""Log templates: masking, mining (Drain) and matching."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import TEMPLATE_MAX_CHILDREN, TEMPLATE_SIMILARITY
from ..functions.net import settled
from ..functions.text import mask, single_spaced, tokens
from ..session import cut_lineage, stored
from .ordering import WIDTH, with_ordinal

WILD = "<*>"


def with_mask(lines: DataFrame, content: str = "content") -> DataFrame:
    """Add ``masked``, computed once however often it is read."""
    return settled(lines, "masked", mask(F.col(content)))


def distinct_masked(lines: DataFrame, content: str = "content", position: str = "position") -> DataFrame:
    """Distinct masked contents with their count and first position; the pre-aggregation of mining."""
    masked = settled(lines.select(F.col(content).alias("__c"), F.col(position).alias("pos")), "masked", mask(F.col("__c")))
    return shapes_of(masked, "pos")


def shapes_of(masked: DataFrame, position: str = "position") -> DataFrame:
    """Distinct ``masked`` with their count and first position, in tokens."""
    counted = masked.groupBy("masked").agg(F.min(position).alias("first_pos"), F.count("*").alias("lines"))
    return counted.withColumn("tokens", tokens(F.col("masked"))).withColumn("n_tokens", F.size("tokens"))


def _leaf_key(first: Column) -> Column:
    return F.when(first.rlike(r"(?U)\d"), F.lit(WILD)).otherwise(first)


def _keyed(shapes: DataFrame) -> DataFrame:
    """``masked`` as ``text``, the tokens joined, and ``spaced``, itself where its white space is another; with ``n_tokens`` and
    ``key``, the first token as the tree sees it."""
    masked, words, plain = F.col("masked"), F.col("words"), F.col("plain")
    # The usual line is its own text; only others are cut into words here.
    cut = settled(settled(shapes, "plain", single_spaced(masked)), "words", F.when(~plain, tokens(masked)))
    spaces = F.octet_length(masked) - F.octet_length(F.replace(masked, F.lit(" "), F.lit("")))
    first = F.when(plain, F.substring_index(masked, " ", 1)).otherwise(F.get(words, F.lit(0)))
    cut = cut.withColumn("n_tokens", F.when(plain, spaces + 1).otherwise(F.size(words))).withColumn("first", first)
    key = F.when(F.col("n_tokens") > 1, _leaf_key(F.col("first"))).otherwise(F.lit(""))
    joined = cut.withColumn("key", key).withColumn("text", F.when(plain, masked).otherwise(F.array_join(words, " ")))
    spaced = F.when(masked != F.col("text"), masked)
    return joined.withColumn("spaced", spaced).select("n_tokens", "key", "text", "spaced", "first_pos", "lines")


def own_leaves(keyed: DataFrame, max_children: int = TEMPLATE_MAX_CHILDREN) -> DataFrame:
    """(n_tokens, key) of the leaves with a first token of their own: of each token count the first ``max_children`` - 1 plain
    ones in order of appearance, so that the ranking is cut per map task before the shuffle."""
    firsts = keyed.where(F.col("key") != WILD).groupBy("n_tokens", "key").agg(F.min("first_pos").alias("seen"))
    w = Window.partitionBy("n_tokens").orderBy("seen", "key")
    return firsts.withColumn("r", F.row_number().over(w)).where(F.col("r") < max_children).select("n_tokens", "key")


def with_leaf(keyed: DataFrame, own: DataFrame, prefix: int = 1) -> DataFrame:
    """Add the prefix-tree leaf: (token count, first token). First tokens with a digit, and those
    beyond the child limit in order of appearance, share the wildcard leaf. Further prefix tokens
    are added as they are, or as the wildcard if they hold a digit.

    ``own`` has fewer rows than ``max_children`` for each token count and meets the shapes where they are."""
    known = F.broadcast(own.select(F.col("n_tokens").alias("own_n"), F.col("key").alias("own_key")))
    same = (F.col("n_tokens") == F.col("own_n")) & (F.col("key") == F.col("own_key"))
    leaf = F.coalesce("own_key", F.lit(WILD))
    if prefix > 1:
        deeper = F.transform(F.slice(F.split("text", " "), 2, prefix - 1), _leaf_key)
        leaf = F.concat_ws(" ", leaf, F.array_join(deeper, " "))
    return keyed.join(known, same, "left").withColumn("leaf", leaf).drop("own_n", "own_key", "key")


HELD = 1 << 24  # bytes of lines in which a task finds equal ones before they are dealt out


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal lines of a task become one with the first position and their number, so that a line of any share of the log stays few rows."""

    def merged() -> pa.Table:
        sums = pa.Table.from_batches(held).group_by("masked", use_threads=False).aggregate([("first_pos", "min"), ("lines", "sum")])
        return sums.select(["masked", "first_pos_min", "lines_sum"]).rename_columns(names)

    names, held, size = ["masked", "first_pos", "lines"], [], 0
    for batch in batches:
        held.append(pa.RecordBatch.from_arrays(batch.columns, names))  # nullable, as merged ones are
        size += batch.nbytes
        if size >= HELD:
            table = merged()
            held, size = table.to_batches(), table.nbytes
            if size > HELD // 2:
                yield from table.to_batches(max_chunksize=10_000)
                held, size = [], 0
    if held:
        yield from merged().to_batches(max_chunksize=10_000)


PENDING = 256  # latest templates, which are compared one and all; older ones are looked up by their words


class _Clusters:
    """Templates of one leaf as rows of word numbers, 0 for the wildcard. Lines must come in order of appearance.

    A template that is similar enough has ``need`` words in the line's places, so at least one in any choice of all but
    ``need`` - 1 of the line's fixed places. The places whose words fewest templates have are chosen, and only templates found
    there are compared: the same result as comparing all, without the square of their number. Sorted runs of (place and word,
    template) find them; a run is merged with the one before it while that is less than four times as long.
    """

    def __init__(self, similarity: float, width: int):
        self.need = math.ceil(similarity * width)
        while self.need and (self.need - 1) / width >= similarity:  # as the division decides
            self.need -= 1
        self.matrix = np.zeros((1, width), np.int32)
        self.places = np.arange(width, dtype=np.int64) << 32
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.indexed = 0
        self.first_pos: list[int] = []
        self.lines: list[int] = []

    def _index_pending(self) -> None:
        rows = self.matrix[self.indexed : len(self.lines)]
        codes, ids = (rows + self.places).ravel(), np.repeat(np.arange(self.indexed, len(self.lines), dtype=np.int32), rows.shape[1])
        codes, ids = codes[rows.ravel() != 0], ids[rows.ravel() != 0]
        while True:
            order = np.argsort(codes, kind="stable")
            codes, ids = codes[order], ids[order]
            if not self.runs or len(self.runs[-1][0]) >= 4 * len(codes):
                break
            older = self.runs.pop()
            codes, ids = np.concatenate((older[0], codes)), np.concatenate((older[1], ids))
        self.runs.append((codes, ids))
        self.indexed = len(self.lines)

    def _found(self, row: np.ndarray) -> np.ndarray:
        """Templates that may be similar enough, oldest first."""
        known = len(self.lines)
        pending = np.arange(self.indexed, known)
        codes = (row + self.places)[row != 0]
        if not self.runs or len(codes) < self.need:
            return pending
        spans = [(run.searchsorted(codes), run.searchsorted(codes, "right"), ids) for run, ids in self.runs]
        chosen = sum(to - at for at, to, _ in spans).argsort()[: len(codes) - self.need + 1]
        ids = [ids[a:b] for at, to, ids in spans for a, b in zip(at[chosen].tolist(), to[chosen].tolist(), strict=True) if a < b]
        return np.concatenate((np.unique(np.concatenate(ids)), pending)) if ids else pending

    def add(self, row: np.ndarray, position: int, lines: int) -> None:
        known, best = len(self.lines), -1
        # few templates, or a line without words: all of them, where they are
        found = self._found(row) if self.runs else np.arange(known)
        if len(found):
            rows = self.matrix[found] if self.runs else self.matrix[:known]
            same = ((rows == row) & (row != 0)).sum(axis=1)
            most = int(same.max())
            if most >= self.need:  # most equal tokens, then most wildcards, then the oldest
                tied = np.flatnonzero(same == most)
                best = int(found[tied[np.argmax((rows[tied] == 0).sum(axis=1))]])
        if best < 0:
            if known == len(self.matrix):
                self.matrix = np.concatenate((self.matrix, np.zeros_like(self.matrix)))
            self.matrix[known] = row
            self.first_pos.append(position)
            self.lines.append(lines)
            if known + 1 - self.indexed >= PENDING and self.need:
                self._index_pending()
            return
        self.matrix[best][self.matrix[best] != row] = 0
        self.first_pos[best] = min(self.first_pos[best], position)
        self.lines[best] += lines


FOUND = ("n_tokens", "leaf", "part", "text", "first_pos", "lines")
OUT_ROWS = 2000  # templates that leave a task together
WORDS = 1 << 20  # numbered words at which a task starts its numbering anew, between leaves


class _Words:
    def __init__(self):
        self.numbers: dict[str, int] = {WILD: 0}
        self.names = [WILD]

    def numbered(self, values: pa.Array) -> np.ndarray:
        coded, before = values.dictionary_encode(), len(self.names)
        distinct = coded.dictionary.to_pylist()
        known = [self.numbers.setdefault(word, len(self.numbers)) for word in distinct]
        self.names += [word for word, number in zip(distinct, known, strict=True) if number >= before]
        return np.array(known, np.int32)[coded.indices.to_numpy()]

    def rows(self, done: list[tuple[tuple, _Clusters]], at: pa.DataType) -> pa.RecordBatch:
        """The templates of leaves, in words again."""
        kept = [(key, c, len(c.lines)) for key, c in done]
        flat = np.concatenate([c.matrix[:n].ravel() for _, c, n in kept])
        used, which = np.unique(flat, return_inverse=True)
        words = pa.array([self.names[i] for i in used], pa.string()).take(pa.array(which))
        widths = np.concatenate([[0], *(np.full(n, key[0]) for key, _, n in kept)])
        columns = [
            pa.array(widths[1:], pa.int32()), *(pa.array([key[i] for key, _, n in kept for _ in range(n)], pa.string()) for i in (1, 2)),
            pc.binary_join(pa.ListArray.from_arrays(pa.array(np.cumsum(widths), pa.int32()), words), " "),
            *(pa.array([x for _, c, _ in kept for x in getattr(c, name)], kind) for name, kind in (("first_pos", at), ("lines", pa.int64()))),
        ]
        return pa.RecordBatch.from_arrays(columns, FOUND)


def _cluster(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, key, clusters, done, held, at = _Words(), None, None, [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            width, lines = (batch.column(c).to_numpy() for c in ("n_tokens", "lines"))
            first_pos, at = batch.column("first_pos").to_pylist(), batch.column("first_pos").type
            names = [batch.column(c).dictionary_encode() for c in ("leaf", "part")]
            leaf, part = (c.indices.to_numpy() for c in names)
            leaves, parts = (c.dictionary.to_pylist() for c in names)
            changes = np.flatnonzero((np.diff(width) != 0) | (np.diff(leaf) != 0) | (np.diff(part) != 0)) + 1
            opens = (int(width[0]), leaves[leaf[0]], parts[part[0]]) != key
            if len(words.names) > WORDS and opens and clusters is not None:
                yield words.rows([*done, (key, clusters)], at)
                words, key, clusters, done, held = _Words(), None, None, [], 0
            split = pc.split_pattern(batch.column("text"), " ")
            numbers, offsets = words.numbered(split.flatten()), split.offsets.to_numpy().tolist()
            for a, b in zip([0, *changes.tolist()], [*changes.tolist(), len(width)], strict=True):
                group = (int(width[a]), leaves[leaf[a]], parts[part[a]])
                if group != key:
                    if clusters is not None:
                        done.append((key, clusters))
                        held += len(clusters.lines)
                    if held >= OUT_ROWS:
                        yield words.rows(done, at)
                        done, held = [], 0
                    key, clusters = group, _Clusters(similarity, group[0])
                for i, position, n in zip(range(a, b), first_pos[a:b], lines[a:b].tolist(), strict=True):
                    clusters.add(numbers[offsets[i] : offsets[i] + group[0]], position, n)
        if clusters is not None:
            yield words.rows([*done, (key, clusters)], at)

    return run


def mine_templates(
    lines: DataFrame,
    similarity: float = TEMPLATE_SIMILARITY,
    max_children: int = TEMPLATE_MAX_CHILDREN,
    content: str = "content",
    position: str = "position",
    prefix: int = 1,
    digits: int = 0,
    width: int = WIDTH,
    many: bool = False,
) -> DataFrame:
    """(template_id, n_tokens, leaf, tokens, first_pos, lines) mined from the lines.

    Distinct masked lines are clustered leaf by leaf in order of appearance; a task streams its leaves and holds their
    templates only. A leaf is (token count, first ``prefix`` tokens). The published tree has one such token; more of them are
    another, finer tree, for logs in which one first token opens most shapes.

    With ``digits`` a leaf is no task's own: its shapes fall into 16^digits parts by a digest of their tokens, which are
    clustered apart, and the templates of 16 parts are merged by the same rule in each of ``digits`` further rounds, so that the
    last one meets templates only. Where templates are well apart the result is that of one pass. Positions are integers or
    decimals; ``width`` is that of the buckets in which templates are put in order.

    The log is masked once into distinct shapes, which are written. With ``many``, for logs with nearly as many shapes as lines, they
    are not: the log is masked once for the first tokens and once more for the first round, whose shuffle also brings equal lines together.
    """
    if not many:
        shapes = distinct_masked(lines, content, position).select("masked", "first_pos", "lines")
        return mine_shapes(cut_lineage(shapes), similarity, max_children, prefix, digits, width)
    masked = settled(lines.select(F.col(content).alias("__c"), F.col(position).alias("first_pos")), "masked", mask(F.col("__c")))
    rows = masked.select("masked", "first_pos", F.lit(1).cast("long").alias("lines"))
    own = own_leaves(_keyed(rows), max_children)
    return _mined(_keyed(rows.mapInArrow(_combined, rows.schema)), own, similarity, prefix, digits, width)


def mine_shapes(
    shapes: DataFrame, similarity: float = TEMPLATE_SIMILARITY, max_children: int = TEMPLATE_MAX_CHILDREN, prefix: int = 1, digits: int = 0,
    width: int = WIDTH,
) -> DataFrame:
    """``mine_templates`` of distinct shapes that are written already."""
    keyed = _keyed(shapes.select("masked", "first_pos", "lines"))
    return _mined(keyed, own_leaves(keyed, max_children), similarity, prefix, digits, width)


def _mined(keyed: DataFrame, own: DataFrame, similarity: float, prefix: int, digits: int, width: int) -> DataFrame:
    """Templates of keyed lines. Equal lines meet in the first round's tasks; a round whose parts are in one task already needs no shuffle."""
    leaves = with_leaf(keyed, stored(own), prefix)
    position = keyed.schema["first_pos"].dataType.simpleString()
    schema = f"n_tokens int, leaf string, part string, text string, first_pos {position}, lines long"
    found = leaves.withColumn("part", F.substring(F.md5("text"), 1, digits))
    dealt = None
    for kept in range(digits, -1, -1):
        group = ("n_tokens", "leaf", "part")
        found = found.withColumn("part", F.substring("part", 1, kept))
        if dealt is None or kept < dealt:
            dealt = max(kept - 1, min(kept, 1))
            found = found.withColumn("dealt", F.substring("part", 1, dealt)).repartition("n_tokens", "leaf", "dealt")
        if kept == digits:
            found = found.groupBy("dealt", *group, "text", "spaced").agg(F.min("first_pos").alias("first_pos"), F.sum("lines").alias("lines"))
        rows = found.select(*FOUND).sortWithinPartitions(*group, "first_pos")
        found = rows.mapInArrow(_cluster(similarity), schema)
    ordered = with_ordinal(stored(found.drop("part")), "first_pos", "template_id", width=width)
    words = F.when(F.col("n_tokens") > 0, F.split("text", " ")).otherwise(F.array().cast("array<string>"))
    return ordered.select("template_id", "n_tokens", "leaf", words.alias("tokens"), "first_pos", "lines")


def match_masked(distinct: DataFrame, templates: DataFrame) -> DataFrame:
    """(masked, template_id): every token equal or wildcard; null when nothing matches.

    Runs on distinct masked lines. Among several matches the line's own leaf comes first, then the
    template with most wildcards, then the oldest one. Templates meet lines on the token count and their
    first fixed token; a line is looked up once for each place at which a template of its length has
    that token, which is the first place but for templates that open with a wildcard.
    """
    at = lambda words: F.coalesce(F.get(words, F.col("place")), F.lit(""))
    t = templates.select(
        "template_id", F.col("n_tokens").alias("t_n"), F.col("leaf").alias("t_leaf"),
        F.col("tokens").alias("t_tokens"),
        # without a fixed token: the place after the last one
        F.array_position(F.transform("tokens", lambda x: x != WILD), True).cast("int").alias("__p"),
        F.size(F.filter("tokens", lambda x: x == WILD)).alias("wilds"),
    ).withColumn("place", F.when(F.col("__p") > 0, F.col("__p") - 1).otherwise(F.col("t_n"))).drop("__p")
    t = t.withColumn("t_fixed", at("t_tokens"))
    places = t.select(F.col("t_n").alias("n_tokens"), "place").distinct()
    lines = distinct.select("masked", "tokens", "n_tokens").join(places, "n_tokens")
    lines = lines.withColumn("fixed", at("tokens"))
    own_leaf = F.when(F.col("n_tokens") <= 1, "").otherwise(_leaf_key(F.get("tokens", F.lit(0))))
    agrees = F.forall(F.zip_with("tokens", "t_tokens", lambda a, b: (a == b) | (b == WILD)), lambda x: x)
    same = (F.col("n_tokens") == F.col("t_n")) & (lines["place"] == t["place"]) & (F.col("fixed") == F.col("t_fixed"))
    hits = lines.join(t, same).where(agrees)
    order = F.struct(
        (F.col("t_leaf") == own_leaf).cast("int").alias("a"),
        F.col("wilds").alias("b"),
        (-F.col("template_id")).alias("c"),
    )
    best = hits.groupBy("masked").agg(F.max_by("template_id", order).alias("template_id"))
    return distinct.select("masked").join(best, "masked", "left")


def match_templates(lines: DataFrame, templates: DataFrame, content: str = "content") -> DataFrame:
    """Add ``template_id``; null for a line no template covers. No template is ever created."""
    masked = settled(lines, "__masked", mask(F.col(content)))
    distinct = (
        masked.select(F.col("__masked").alias("masked")).distinct()
        .withColumn("tokens", tokens(F.col("masked"))).withColumn("n_tokens", F.size("tokens"))
    )
    matched = match_masked(distinct, templates)
    return masked.join(matched, F.col("__masked") == F.col("masked"), "left").drop("__masked", "masked")


def template_text(column: Column) -> Column:
    return F.array_join(column, " ")

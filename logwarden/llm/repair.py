"""Conversation structure repair: the cheapest edits that give roles ``(s?(ua)+)?``, by a square-root checkpointed DP.

The DP runs backwards over four states (nothing yet, after s, after u, after a): a row's vector holds the least cost to
finish from each. A conversation of n rows falls into blocks of about sqrt(n) rows. One pass turns every block into a 4 x 4
matrix of costs; a conversation's matrices, at most about sqrt(n), give the vectors at the block borders, the only
ones that are stored. Walking forward, every block recomputes its own vectors from its border and picks, for each state in
which it may be entered, the least letter among the tight edits; which state it is entered in is then chained over
the borders. Blocks are spread over all tasks, however long their conversation is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batches import whole_groups
from . import sequences
from .registry import query, table
from .store import stored

# fixed values of the task: what edits cost, and what a turn that is cut off costs if it is not deleted
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
D, I, K, R = range(4)  # edits in the order of their letters  # noqa: E741
LETTERS = "DIKR"
OK, CUT, GONE = range(3)  # faults: none, truncated, one that must be deleted
NEXT = np.array([2, 2, 3, 2])  # the state after the turn that a state wants: user from all but "after u"
KEEP = np.full((4, 4), -1)  # by state and initial (s, u, a, other)
KEEP[0, 0], KEEP[0, 1], KEEP[1, 1], KEEP[2, 2], KEEP[3, 1] = 1, 2, 2, 3, 2
FAR = np.int64(1) << 60
FINISH = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
LEGAL = np.zeros((4, 4), bool)
LEGAL[0, 1] = LEGAL[1, 2] = LEGAL[2, 1] = True


def _step(after: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Cost vectors (..., 4) before rows of ``code``, from those after them."""
    initial, fault = code // 3, code % 3
    wide = (slice(None),) + (None,) * (after.ndim - 1)
    extra = np.where(fault == CUT, TRUNCATED, 0)[wide]
    to = KEEP[:, initial].T  # rows, states
    to = np.broadcast_to(to[:, None, :] if after.ndim == 3 else to, after.shape)
    keep = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), -1), FAR) + extra
    best = np.minimum(keep, after[..., NEXT] + REROLE + extra)
    best = np.where((fault == GONE)[wide], FAR, best)
    best = np.minimum(best, after + DELETE)
    for _ in range(2):  # inserted turns lead through at most two other states
        best = np.minimum(best, best[..., NEXT] + INSERT)
    return np.minimum(best, FAR)


def _backward(offsets: np.ndarray, start: np.ndarray, step: Callable[[np.ndarray, np.ndarray], np.ndarray], seen: Callable | None = None) -> np.ndarray:
    """Fold every group of rows from its end, all groups at a time; ``seen`` is told (groups, rows, value after the rows)."""
    value, sizes = start, np.diff(offsets)
    for j in range(int(sizes.max(initial=0))):
        groups = np.flatnonzero(sizes > j)
        rows = offsets[groups + 1] - 1 - j
        if seen:
            seen(rows, value[groups])
        value[groups] = step(value[groups], rows)
    return value


def block_costs(offsets: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The (block, from, to) costs of whole blocks."""
    unit = np.where(np.eye(4, dtype=bool), np.int64(0), FAR)
    start = np.broadcast_to(unit, (len(offsets) - 1, 4, 4)).copy()  # (block, to, from)
    return _backward(offsets, start, lambda v, rows: _step(v, code[rows])).transpose(0, 2, 1)


def walk(offsets: np.ndarray, code: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row and entry state of its block the edit (state, inserts before it and kind in one byte); every block's exits."""
    after = np.empty((len(code), 4), np.int64)

    def keep(rows: np.ndarray, value: np.ndarray) -> None:
        after[rows] = value

    before = np.empty_like(after)

    def step(value: np.ndarray, rows: np.ndarray) -> np.ndarray:
        before[rows] = _step(value, code[rows])
        return before[rows]

    _backward(offsets, border.copy(), step, keep)
    state = np.broadcast_to(np.arange(4), (len(offsets) - 1, 4)).copy()
    edits, sizes = np.empty((len(code), 4), np.uint8), np.diff(offsets)
    for j in range(int(sizes.max(initial=0))):
        groups = np.flatnonzero(sizes > j)
        rows, now = offsets[groups] + j, state[groups]
        v0, v1, entered = before[rows], after[rows], now
        at = lambda v, q: np.take_along_axis(v, q, 1)
        inserts = np.zeros_like(now)
        for _ in range(2):
            more = (at(v1, now) + DELETE != at(v0, now)) & (at(v0, NEXT[now]) + INSERT == at(v0, now))
            inserts, now = inserts + more, np.where(more, NEXT[now], now)
        initial, extra = code[rows] // 3, np.where(code[rows] % 3 == CUT, TRUNCATED, 0)[:, None]
        to = KEEP[now, initial[:, None]]
        delete = at(v1, now) + DELETE == at(v0, now)
        kept = (to >= 0) & (code[rows] % 3 != GONE)[:, None] & (at(v1, np.maximum(to, 0)) + extra == at(v0, now))
        kind = np.where(delete, D, np.where(kept, K, R))
        edits[rows] = entered * 16 + inserts * 4 + kind
        state[groups] = np.where(delete, now, np.where(kept, to, NEXT[now]))
    return edits, state.astype(np.uint8)


def _fault(text: Column) -> Column:
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(last == "", GONE).when(last.isin(".", "!", "?"), OK).otherwise(CUT)


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def _fixed(batches: Iterator[pa.RecordBatch], key: str, fn: Callable[[pa.Table, np.ndarray], list], names: list[str]) -> Iterator[pa.RecordBatch]:
    for rows, offsets in whole_groups(batches, key):
        yield pa.RecordBatch.from_arrays(fn(rows, offsets), names)


def _vectors(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(values: np.ndarray) -> pa.Array:
    flat = values.reshape(len(values), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel().astype(np.int64)))


def plan(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, conversations): every turn with its edit, and every conversation's counts and cost.

    ``rows``: key, order, role, text, pos (the order of turns within a conversation), blk, fault (blank, duplicate, truncated
    or ""), entered (state), inserts (turns to insert before it) and edit (D, K or R). ``conversations``: key, cost, illegal
    and last, the state after the last turn, which tells the turns to insert at the end.

    Turns go by ``order`` (nulls first), then role and a digest of the text; repeated rows are turns of their own. Null role
    or text counts as one space; a null key is a key like any other; an empty table gives none. A role counts by its first
    letter. ``block`` rows make a block; by default the square root of the conversation's size. Other columns are dropped.
    """
    space = F.lit(" ")
    r, t = F.coalesce(F.col(role), space), F.coalesce(F.col(text), space)
    rows = turns.select(
        F.col(key).alias("key"), F.col(order).alias("turn"), r.alias("role"), t.alias("text"),
        F.unhex(F.md5(F.concat(r, F.lit("\x00"), t))).alias("same"), _fault(t).alias("bare"), _initial(r).alias("initial"),
    )
    rows = sequences.placed(rows, "key", [F.col("turn"), F.col("role"), F.col("same")], "turns")
    spans = sequences.spans(rows, "key")
    size = F.lit(block) if block else F.ceil(F.sqrt("total")).cast("long")
    spans = spans.select(F.col("key").alias("k"), "part", "base", size.alias("size"))
    part = F.shiftright("pos", sequences.PART)
    firsts = rows.groupBy("key", "role", "same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    flagged = (
        rows.select("key", "pos", "bare", "initial", part.alias("in_part"))
        .join(spans, F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("in_part")))
        .select("key", "pos", "bare", "initial", (F.col("base") + F.floor((F.col("pos") - F.col("base")) / F.col("size")) * F.col("size")).alias("blk"))
        .join(firsts, "pos", "left")
    )
    again = (F.col("bare") != GONE) & F.col("first").isNull()
    items = stored(
        flagged.select(
            "key", "blk", "pos",
            F.when(F.col("bare") == GONE, "blank").when(again, "duplicate").when(F.col("bare") == CUT, "truncated").otherwise("").alias("fault"),
            (F.col("initial") * 3 + F.when(again, GONE).otherwise(F.col("bare"))).alias("code"),
        ),
        "items",
    )
    by_block = items.select("blk", "pos", "code").repartition("blk").sortWithinPartitions("blk", "pos")

    def summarise(rows: pa.Table, offsets: np.ndarray) -> list:
        code = rows.column("code").to_numpy()
        initial = code // 3
        bad = np.concatenate(([0], np.cumsum(~LEGAL[initial[:-1], initial[1:]])))
        first, last = offsets[:-1], offsets[1:] - 1
        return [rows.column("blk").combine_chunks().take(pa.array(first)), _lists(block_costs(offsets, code)), *map(pa.array, (initial[first].astype(np.int64), initial[last].astype(np.int64), bad[last] - bad[first]))]

    names = ["blk", "costs", "first", "last", "illegal"]
    blocks = by_block.mapInArrow(lambda b: _fixed(b, "blk", summarise, names), "blk long, costs array<bigint>, first long, last long, illegal long")
    owners = items.groupBy("key", "blk").agg(F.count("*").alias("n")).withColumn("owner", F.min("blk").over(_window("key")))
    blocks = stored(blocks.join(owners.select("key", "blk", "owner"), "blk"), "block_costs")

    def borders(rows: pa.Table, offsets: np.ndarray) -> list:
        """The vectors after every block, and each conversation's cost and illegal pairs."""
        costs = _vectors(rows.column("costs"), 16).reshape(-1, 4, 4)
        after = np.empty((len(costs), 4), np.int64)

        def keep(at: np.ndarray, value: np.ndarray) -> None:
            after[at] = value

        step = lambda v, at: np.minimum((costs[at] + v[:, None, :]).min(2), FAR)
        start = _backward(offsets, np.broadcast_to(FINISH, (len(offsets) - 1, 4)).copy(), step, keep)
        first, last = rows.column("first").to_numpy(), rows.column("last").to_numpy()
        bad = rows.column("illegal").to_numpy().copy()
        bad[1:] += ~LEGAL[last[:-1], first[1:]]
        bad[offsets[:-1]] = rows.column("illegal").to_numpy()[offsets[:-1]]
        whole = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        return [rows.column("blk").combine_chunks(), _lists(after), pa.array(start[whole, 0]), pa.array(np.add.reduceat(bad, offsets[:-1])[whole])]

    chained = blocks.select("owner", "blk", "costs", "first", "last", "illegal").repartition("owner").sortWithinPartitions("owner", "blk")
    after = stored(chained.mapInArrow(lambda b: _fixed(b, "owner", borders, ["blk", "after", "cost", "illegal"]), "blk long, after array<bigint>, cost long, illegal long"), "borders")

    def forward(rows: pa.Table, offsets: np.ndarray) -> list:
        edits, exits = walk(offsets, rows.column("code").to_numpy(), _vectors(rows.column("after"), 4)[offsets[:-1]])
        whole = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        return [rows.column("blk").combine_chunks(), rows.column("pos").combine_chunks(), _lists(edits), _lists(exits[whole])]

    bordered = items.select("blk", "pos", "code").join(after.select("blk", "after"), "blk").repartition("blk").sortWithinPartitions("blk", "pos")
    walked = stored(bordered.mapInArrow(lambda b: _fixed(b, "blk", forward, ["blk", "pos", "edits", "exits"]), "blk long, pos long, edits array<bigint>, exits array<bigint>"), "walked")

    def entries(rows: pa.Table, offsets: np.ndarray) -> list:
        exits, state = _vectors(rows.column("exits"), 4), np.zeros(len(offsets) - 1, np.int64)
        entry, sizes = np.empty(len(exits), np.int64), np.diff(offsets)
        for j in range(int(sizes.max(initial=0))):
            groups = np.flatnonzero(sizes > j)
            at = offsets[groups] + j
            entry[at] = state[groups]
            state[groups] = exits[at, state[groups]]
        return [rows.column("blk").combine_chunks(), pa.array(entry), pa.array(np.repeat(state, sizes))]

    exits = walked.groupBy("blk").agg(F.max_by("exits", "pos").alias("exits")).join(blocks.select("blk", "owner"), "blk")
    exits = exits.select("owner", "blk", "exits").repartition("owner").sortWithinPartitions("owner", "blk")
    entry = stored(exits.mapInArrow(lambda b: _fixed(b, "owner", entries, ["blk", "entry", "last"]), "blk long, entry long, last long"), "entries")
    byte = F.get("edits", F.col("entry").cast("int"))
    chosen = walked.join(entry, "blk").select(
        "pos", F.floor(byte / 16).cast("int").alias("entered"), F.floor(byte % 16 / 4).cast("int").alias("inserts"),
        F.substring(F.lit(LETTERS), F.lit(1) + (byte % 4).cast("int"), F.lit(1)).alias("edit"),
    )
    done = rows.select("pos", "turn", "role", "text").join(items.select("key", "blk", "pos", "fault"), "pos").join(chosen, "pos")
    firsts = blocks.where("blk = owner").select("key", "blk").join(after, "blk").join(entry, "blk")
    return (
        done.select(F.col("key").alias(key), F.col("turn").alias(order), F.col("role").alias(role), F.col("text").alias(text), "pos", "blk", "fault", "entered", "inserts", "edit"),
        firsts.select(F.col("key").alias(key), "cost", "illegal", "last"),
    )


def _window(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key)


def _inserted(state: Column, n: Column) -> Column:
    """The roles of ``n`` turns inserted from a state on."""
    turns = F.when(state == 2, F.array(F.lit("assistant"), F.lit("user"))).otherwise(F.array(F.lit("user"), F.lit("assistant")))
    return F.slice(turns, F.lit(1), n)


def repaired(rows: DataFrame, conversations: DataFrame, key: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    """(key, pos, sub, role, text) of the repaired turns, in the order of pos and sub; inserted turns have an empty text."""
    even = F.col("inserts") % 2 == 0
    wants = F.when((F.col("entered") == 2) == even, "assistant").otherwise("user")
    own = F.struct(F.when(F.col("edit") == "R", wants).otherwise(F.col(role)).alias("role"), F.col(text).alias("text"))
    empty = lambda roles: F.transform(roles, lambda x: F.struct(x.alias("role"), F.lit("").alias("text")))
    before = empty(_inserted(F.col("entered"), F.col("inserts")))
    turns = F.when(F.col("edit") == "D", before).otherwise(F.concat(before, F.array(own)))
    tail = conversations.select(key, F.lit((1 << 63) - 1).alias("pos"), empty(_inserted(F.col("last"), _tail(F.col("last")))).alias("turns"))
    both = rows.select(key, "pos", turns.alias("turns")).unionByName(tail)
    return both.select(key, "pos", F.posexplode("turns").alias("sub", "made")).select(key, "pos", "sub", F.col("made.role").alias(role), F.col("made.text").alias(text))


def _tail(last: Column) -> Column:
    return F.when(last == 1, 2).when(last == 2, 1).otherwise(0)


def summary(rows: DataFrame, conversations: DataFrame, ids: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per key of ``ids`` with counts, cost, audit string and the digest of the repaired turns; zeros where no turn is left."""
    letters = F.concat(F.repeat(F.lit("I"), F.col("inserts")), F.col("edit"))
    by_block = rows.groupBy(key, "blk").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", letters.alias("x")))), lambda s: s.x), "").alias("x"))
    audit = by_block.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("blk", "x"))), lambda s: s.x), "").alias("audit"))
    per_turn = rows.groupBy(key, order).agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    gaps = F.max(order) - F.min(order) + 1 - F.count(order)
    counts = per_turn.groupBy(key).agg(F.coalesce(gaps, F.lit(0)).alias("gaps"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    made = repaired(rows, conversations, key, role, text).withColumn("piece", F.concat(role, F.lit(":"), text))
    sha = sequences.digests(made, [key], ["pos", "sub"], "piece", "\n")
    out = ids.select(F.col(key).alias("_id")).distinct()
    for other in (counts, conversations, audit, sha):
        out = out.join(other.withColumnRenamed(key, "_k"), F.col("_id").eqNullSafe(F.col("_k")), "left").drop("_k")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        F.col("_id").alias(key), *[count(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.concat(F.coalesce("audit", F.lit("")), F.repeat(F.lit("I"), F.coalesce(_tail(F.col("last")), F.lit(0)))).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage to conversations (conv_id, turn, role, text), by the CRC-32 of ``conv_id:turn``; null is one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    hit = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return hit.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies)).drop("col")


# The CRC-32 table and its use on short ASCII strings, in SQL.
CRC_SQL = """crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)
)"""


def crc_sql(text: str) -> str:
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(unicode({text}[i]) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])))"


ORACLE = rf"""
WITH RECURSIVE {CRC_SQL}, hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 0] ELSE [0] END) FROM hit WHERE kind <> 0)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(role || chr(0) || text)) AS i FROM damaged
), faults AS (
  SELECT *, substring(role, 1, 1) AS x, lag(substring(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS px,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM numbered
), items AS (
  SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS t FROM faults
), sizes AS (
  SELECT conv_id, count(*) AS n FROM items GROUP BY conv_id
), costs AS (
  SELECT conv_id, n + 1 AS i, 0 AS v0, 6 AS v1, 3 AS v2, 0 AS v3 FROM sizes
  UNION ALL
  SELECT conv_id, i, least(r0, 3 + least(r2, 3 + r3)), least(r1, 3 + least(r2, 3 + r3)), least(r2, 3 + r3), least(r3, 3 + r2)
  FROM (
    SELECT c.conv_id, d.i,
      least(4 + v0, CASE WHEN gone THEN 999999999 ELSE t + least(3 + v2, CASE x WHEN 's' THEN v1 WHEN 'u' THEN v2 ELSE 999999999 END) END) AS r0,
      least(4 + v1, CASE WHEN gone THEN 999999999 ELSE t + least(3 + v2, CASE x WHEN 'u' THEN v2 ELSE 999999999 END) END) AS r1,
      least(4 + v2, CASE WHEN gone THEN 999999999 ELSE t + least(3 + v3, CASE x WHEN 'a' THEN v3 ELSE 999999999 END) END) AS r2,
      least(4 + v3, CASE WHEN gone THEN 999999999 ELSE t + least(3 + v2, CASE x WHEN 'u' THEN v2 ELSE 999999999 END) END) AS r3
    FROM costs c JOIN items d ON d.conv_id = c.conv_id AND d.i = c.i - 1
  )
), vectors AS (
  SELECT conv_id, i, [v0, v1, v2, v3] AS v FROM costs
), steps AS (
  SELECT conv_id, CAST(1 AS BIGINT) AS i, 0 AS q, '' AS audit, CAST([] AS VARCHAR[]) AS made, false AS over FROM sizes
  UNION ALL
  SELECT conv_id, CASE WHEN e IN ('D', 'K', 'R') THEN i + 1 ELSE i END, CASE e WHEN 'D' THEN q WHEN 'K' THEN k ELSE z END,
    audit || e,
    CASE e WHEN 'D' THEN made WHEN 'K' THEN list_append(made, role || ':' || text)
      WHEN 'R' THEN list_append(made, wanted || ':' || text) ELSE list_append(made, wanted || ':') END,
    false
  FROM (
    SELECT *, CASE WHEN i <= n AND 4 + w[q + 1] = v[q + 1] THEN 'D' WHEN 3 + v[z + 1] = v[q + 1] THEN 'I'
      WHEN k IS NOT NULL AND NOT gone AND t + w[k + 1] = v[q + 1] THEN 'K' ELSE 'R' END AS e
    FROM (
      SELECT s.conv_id, s.i, s.q, s.audit, s.made, a.v, b.v AS w, d.role, d.text, d.gone, d.t, z.n,
        CASE WHEN s.q = 2 THEN 3 ELSE 2 END AS z, CASE WHEN s.q = 2 THEN 'assistant' ELSE 'user' END AS wanted,
        CASE WHEN s.q = 0 AND d.x = 's' THEN 1 WHEN s.q <> 2 AND d.x = 'u' THEN 2 WHEN s.q = 2 AND d.x = 'a' THEN 3 END AS k
      FROM steps s JOIN sizes z ON z.conv_id = s.conv_id JOIN vectors a ON a.conv_id = s.conv_id AND a.i = s.i
        LEFT JOIN vectors b ON b.conv_id = s.conv_id AND b.i = s.i + 1 LEFT JOIN items d ON d.conv_id = s.conv_id AND d.i = s.i
      WHERE s.i <= z.n OR s.q IN (1, 2)
    )
  )
), finals AS (
  SELECT s.conv_id, s.audit, s.made FROM steps s JOIN sizes z ON z.conv_id = s.conv_id WHERE s.i = z.n + 1 AND s.q IN (0, 3)
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (px IS NOT NULL AND px || x NOT IN ('su', 'ua', 'au')) AS illegal
  FROM items GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(v0, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(array_to_string(made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id = o.conv_id
  LEFT JOIN costs x ON x.conv_id = o.conv_id AND x.i = 1 LEFT JOIN finals f ON f.conv_id = o.conv_id
"""


@query("op13_structure_repair", ORACLE)
def structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows, conversations = plan(damaged(turns))
    return summary(rows, conversations, turns)

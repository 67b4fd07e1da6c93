"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation := turn*
    turn         := "<s>[INST]" role "[/INST]" text "</s>"

Role and text may hold no control string. One static escape puts a backslash inside each string that looks like a control
string with any number of backslashes; every field is then given back, since the parser takes exactly one away. No field is
parsed to decide on it: ``round_trip`` compares the parsed result with the source afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table

OPEN, HEADER, CLOSE = "<s>[INST]", "[/INST]", "</s>"
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def render_field(text: Column) -> Column:
    """The text, escaped where it looks like a control string; any other text comes out as it is."""
    return escape(text)


def parse(formatted: Column) -> Column:
    """The turns, as an array of (role, text), of a formatted conversation."""
    pieces = F.split(formatted, CLOSE, -1)
    return F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda piece: F.struct(
            unescape(F.substring_index(_after(piece, OPEN), HEADER, 1)).alias("role"),
            unescape(_after_first(piece, HEADER)).alias("text"),
        ),
    )


def _after(text: Column, head: str) -> Column:
    return text.substr(F.lit(len(head) + 1), F.length(text))


def _after_first(text: Column, mark: str) -> Column:
    return text.substr(F.instr(text, mark) + F.lit(len(mark)), F.length(text))


def format_conversations(
    turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: key, formatted string, loss array of (start, length) and round_trip.

    ``loss`` marks, in code points of ``formatted``, the field text of every assistant turn. ``round_trip`` says
    whether the parsed turns equal the source. Turns are ordered by ``order``, then role and text; null text or
    role counts as empty, a null key is a conversation of its own, repeated rows are turns like any other, an empty
    table gives no rows. Other columns are not read. One conversation must fit a row, as its digest does.
    """
    rows = turns.select(
        F.col(key).alias("key"),
        F.struct(
            F.col(order).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("source"),
    )
    rendered = (
        rows.groupBy("key")
        .agg(F.sort_array(F.collect_list("source")).alias("source"))
        .select(
            "key",
            "source",
            F.transform(
                "source",
                lambda t: F.struct(t.role.alias("role"), render_field(t.role).alias("head"), render_field(t.text).alias("body")),
            ).alias("fields"),
        )
    )
    sized = rendered.select(
        "key",
        "source",
        F.array_join(
            F.transform("fields", lambda f: F.concat(F.lit(OPEN), f.head, F.lit(HEADER), f.body, F.lit(CLOSE))), ""
        ).alias("formatted"),
        _loss("fields").alias("loss"),
    )
    recovered = parse(F.col("formatted"))
    source = F.transform("source", lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))
    return sized.select(F.col("key").alias(key), "formatted", "loss", recovered.eqNullSafe(source).alias("round_trip"))


def _loss(fields: str) -> Column:
    """(start, length) of assistant bodies; lengths run over all fields, and only assistant ones are kept."""
    fixed = len(OPEN + HEADER + CLOSE)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, f: Column) -> Column:
        start = acc.at + F.length(f.head) + F.lit(len(OPEN + HEADER))
        span = F.struct(start.cast("long").alias("start"), F.length(f.body).cast("long").alias("length"))
        none = F.array().cast("array<struct<start:bigint,length:bigint>>")
        return F.struct(
            (acc.at + F.length(f.head) + F.length(f.body) + F.lit(fixed)).cast("long").alias("at"),
            F.concat(acc.spans, F.when(f.role == "assistant", F.array(span)).otherwise(none)).alias("spans"),
        )

    return F.aggregate(fields, zero, step, lambda acc: acc.spans)


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, 20 + length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')) AS n
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars, TRUE AS round_trip
FROM sized GROUP BY conv_id
"""


@query("op9_chat_format", ORACLE)
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from the formatted conversations, the conflicting one of the contract included."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conflict = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(conflict).alias("text"),
    )
    formatted = format_conversations(turns.unionByName(extra))
    read = formatted.select(
        "conv_id",
        "round_trip",
        F.length("formatted").cast("long").alias("formatted_chars"),
        parse(F.col("formatted")).alias("turns"),
        F.array_join(F.transform("loss", lambda s: unescape(F.col("formatted").substr(s.start + 1, s.length))), "").alias("loss_text"),
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
        "round_trip",
    )

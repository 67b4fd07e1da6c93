"""What mining in parts writes and moves, and that equal lines and sparse positions give the same templates."""

import random
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logwarden import session
from logwarden.operators import templates


def written(spark):
    """Bytes of the shared folder and of the shuffles."""
    session._ensure_checkpoint_dir(spark)
    shared = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = [*shared.rglob("*"), *(f for d in blocks for f in Path(d).rglob("shuffle_*.data"))]
    return sum(f.stat().st_size for f in files if f.is_file())


def test_texts_are_moved_three_times_and_written_once(spark):
    rnd = random.Random(3)
    lines = [" ".join(f"{rnd.getrandbits(40):010x}g" for _ in range(20)) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(lines)), "position long, content string").repartition(4).cache()
    assert df.count() == len(lines)
    before = written(spark)
    mined = templates.mine_templates(df, digits=2, many=True).collect()
    grown = written(spark) - before
    assert sorted(" ".join(r.tokens) for r in mined) == sorted(lines) and {r.lines for r in mined} == {1}
    assert grown < 5 * sum(map(len, lines)), grown


@pytest.mark.parametrize("held", [2000, 20000])  # what is merged is sent on, or held
def test_equal_lines_leave_a_task_once(monkeypatch, held):
    monkeypatch.setattr(templates, "HELD", held)
    rows = [("hot" if i % 2 else f"line {i % 300}", i, 1) for i in range(3000)]
    schema = pa.schema([("masked", pa.string()), ("first_pos", pa.int64()), pa.field("lines", pa.int64(), nullable=False)])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[a : a + 50]], schema) for a in range(0, 3000, 50)]
    out = pa.Table.from_batches(templates._combined(iter(batches))).to_pylist()
    assert sum(r["lines"] for r in out) == 3000
    hot = [r for r in out if r["masked"] == "hot"]
    assert sum(r["lines"] for r in hot) == 1500 and min(r["first_pos"] for r in hot) == 1 and len(hot) <= 60
    assert {r["masked"]: r["first_pos"] for r in reversed(out)} == {m: min(i for n, i, _ in rows if n == m) for m, _, _ in rows}
    assert list(templates._combined(iter([]))) == []


def test_sparse_positions_and_white_space(spark):
    rnd = random.Random(5)
    words = ["red", "blue", "green", "gold", "a b", "x1"]
    lines = [rnd.choice([" ", "  ", "\t"]).join(rnd.choice(words) for _ in range(rnd.randrange(1, 6))) for _ in range(400)] + ["", " ", "red "]
    dense = spark.createDataFrame(list(enumerate(lines)), "position long, content string")
    sparse = dense.withColumn("position", ((F.col("position") - 200).cast("decimal(20,0)") * F.lit(1 << 40)).cast("decimal(38,0)"))
    rows = lambda df, **how: [(r.template_id, r.n_tokens, r.leaf, r.tokens, r.lines) for r in templates.mine_templates(df, digits=2, **how).orderBy("template_id").collect()]
    want = rows(dense)
    assert rows(sparse.repartition(5), width=1 << 46, many=True) == want
    assert sum(r[4] for r in want) == len(lines) and [r[0] for r in want] == list(range(1, len(want) + 1))
    assert templates.mine_templates(dense.limit(0), digits=2, many=True).count() == 0

import random
import statistics

import pytest
from pyspark.sql import functions as F

from logwarden.operators import profile, quantiles


@pytest.mark.parametrize("few", [3, 100, 1 << 16])
def test_medians_are_exact(spark, few):
    rng = random.Random(few)
    columns = {
        "even": [rng.random() for _ in range(1000)], "odd": [rng.gauss(0, 1e6) for _ in range(999)], "ties": [rng.choice([1.0, 2.0]) for _ in range(800)],
        "wide": [10.0 ** rng.randrange(-200, 200) for _ in range(901)], "one": [7.0], "same": [4.0] * 700,
    }
    rows = [tuple(v[i] if i < len(v) else None for v in columns.values()) for i in range(1000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).withColumn("none", F.lit(None).cast("double")).repartition(4)
    got, counts = quantiles.medians(df, {c: F.col(c) for c in [*columns, "none"]}, few)
    assert got == {c: statistics.median(v) for c, v in columns.items()} | {"none": None}
    assert counts == {c: len(v) for c, v in columns.items()} | {"none": 0}


def test_ranks_at_the_ends_and_coarse_sketches(spark):
    rng = random.Random(6)
    data = sorted(rng.choice([rng.random(), 0.5]) for _ in range(3000))
    values = spark.createDataFrame([("a", x) for x in data], "f string, v double").repartition(3)
    ranks = [0, 1, 700, 1500, 2998, 2999]
    assert quantiles.order_statistics(values, {"a": ranks}, few=20, accuracy=50)["a"] == [data[k] for k in ranks]


def test_profile_of_nothing(spark):
    empty = spark.createDataFrame([], "failed_attempts_count int, request_frequency double, ip_reputation_score double")
    row = profile.fit_profile(empty).first()
    assert row.normal_windows is None or row.normal_windows == 0

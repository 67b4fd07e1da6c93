import hashlib
import json
from collections import Counter

from logwarden.operators import blocks as blk


def test_digest_is_of_counted_rows_and_shuffled_as_bytes(spark):
    rows = [(i % 7, None if i % 3 else "x") for i in range(40)]
    got = blk.table_digest(spark.createDataFrame(rows, "a int, b string"), ["a", "b"])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    cell = lambda v: json.dumps({"v": v}, separators=(",", ":")) if v is not None else "{}"
    sums = Counter()
    for (a, b), n in Counter(rows).items():
        g = sha(f"{sha(chr(31).join((cell(a), cell(b))))}*{n}")
        sums[int(g[:3], 16)] += int(g[3:18], 16)
    want = sha("40|" + "|".join(f"{b}:{s}" for b, s in sorted(sums.items())))
    assert tuple(got.first()) == (40, want)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "unhex(sha2(" in plan

"""Keyed state of the streams: one call, one state value and one timer for all keys of a bucket."""

import numpy as np
import pandas as pd

from logwarden.operators.loop import DEFAULT_PARAMS, EVENT, ActorState, fold_rows
from logwarden.streaming.loop_stream import LoopProcessor
from logwarden.streaming.score_stream import BlockProcessor


class Handle:
    """A bucket's state value and timers; counts what is asked of them."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.discard(ms)

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def expire(self, processor, watermark):
        self.watermark = watermark
        while due := [t for t in self.timers if t <= watermark]:
            self.timers.discard(due[0])
            list(processor.handleExpiredTimer((0,), self, None))


def test_blocks_of_a_bucket_share_state_and_timer():
    rng, idle, n = np.random.default_rng(3), 50, 600
    ms = np.cumsum(rng.integers(0, 5, n))
    rows = pd.DataFrame({"block_id": [f"blk_{b}" for b in rng.integers(0, 40, n)], "position": np.arange(n), "ms": ms, "units": rng.integers(-9, 9, n)})
    want, kept = {}, {}
    for r in rows.itertuples():
        lines, units, last = kept.get(r.block_id, (0, 0, None))
        if last is not None and r.ms - last > idle:
            lines, units = 0, 0
        kept[r.block_id] = lines + 1, units + r.units, r.ms
        want[r.position] = r.block_id, lines + 1, units + r.units
    handle, processor, got = Handle(), BlockProcessor(idle), {}
    processor.init(handle)
    for part in np.array_split(np.arange(n), 5):
        before, batch = handle.calls, rows.iloc[part].sample(frac=1, random_state=1)
        for out in processor.handleInputRows((0,), iter([batch.iloc[:7], batch.iloc[7:]]), handle):
            got |= {r.position: (r.block_id, r.lines, r.units) for r in out.itertuples()}
        assert handle.calls - before <= 5
        handle.expire(processor, int(ms[part[-1]]) - 10)
    assert got == want
    end = int(ms[-1]) - 10
    left = {k: v for k, v in kept.items() if v[2] + idle + 1 > end}
    assert 0 < len(left) < len(kept)
    assert dict(zip(handle.value[0], zip(*handle.value[1:4]))) == left
    assert handle.timers == {min(v[2] for v in left.values()) + idle + 1}
    handle.expire(processor, int(ms[-1]) + idle + 1)
    assert handle.value is None and not handle.timers


def test_addresses_of_a_bucket_share_state():
    rng, n = np.random.default_rng(4), 500
    rows = pd.DataFrame(
        {
            "ip": [f"10.0.0.{b}" for b in rng.integers(0, 25, n)], "ms": np.cumsum(rng.integers(0, 4000, n)), "id": np.arange(n), "kind": EVENT,
            "event": rng.choice(["failed_login", "suspicious_ip"], n), "base": rng.choice([0, 35], n), "ttl_s": rng.choice([np.nan, 60.0], n),
        }
    )
    want = {}
    for _, r in rows.groupby("ip"):
        got = fold_rows(ActorState(DEFAULT_PARAMS), *(r[c].to_numpy() for c in ("ms", "kind", "event", "base", "ttl_s")))
        want |= dict(zip(r["id"], zip(got["dropped"], got["alerted"], got["score"])))
    handle, processor, seen = Handle(), LoopProcessor(DEFAULT_PARAMS, None), {}
    processor.init(handle)
    for part in np.array_split(np.arange(n), 4):
        for out in processor.handleInputRows((0,), iter([rows.iloc[part[::-1]]]), handle):
            seen |= {r.id: (r.dropped, r.alerted, r.score_hundredths) for r in out.itertuples()}
    assert seen == want and any(x[0] for x in want.values()) and len(handle.value[0]) == rows["ip"].nunique()

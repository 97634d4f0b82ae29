"""The state of first-seen keys by itself: a bucket is asked for once a batch, whatever number of keys it has, and forgets like a state for each key."""

import random
from types import SimpleNamespace

import pandas as pd

from groundwork.streaming import incremental


class State:
    def __init__(self, calls):
        self.value, self.calls = None, calls

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.calls, self.timers = [], set()

    def getValueState(self, *_):
        return State(self.calls)

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def frame(rows):
    """rows: (seq, ms, key)."""
    keys = [k.encode().ljust(incremental.DIGEST, b"\0") for *_, k in rows]
    return pd.DataFrame({"seq": [s for s, *_ in rows], "ts": pd.to_datetime([t for _, t, _ in rows], unit="ms"), "k1": [k for *_, k in rows], "key_digest": keys, "key_bucket": 0})


def begun(keep):
    first, handle = incremental.FirstOfKeys(keep), Handle()
    first.init(handle)
    return first, handle


def test_a_bucket_is_asked_for_once_a_batch():
    first, handle = begun(100)
    rows = [(i, 1000 + i % 7, f"key{i % 900}") for i in range(2000)]
    out = pd.concat(first.handleInputRows((0,), iter([frame(rows[:700]), frame(rows[700:])]), None))
    least = {}
    for s, t, k in rows:
        least[k] = min(least.get(k, (t, s)), (t, s))
    assert sorted(out["seq"]) == sorted(s for _, s in least.values()) and list(out.columns) == ["seq", "ts", "k1"]
    assert list(first.handleInputRows((0,), iter([frame(rows)]), None)) == []
    assert len(handle.calls) <= 6 and handle.timers == {101_000}


def test_keys_are_kept_as_long_as_with_a_state_each():
    rnd = random.Random(3)
    first, handle = begun(5)
    until, now, seq = {}, 0, 0
    for _ in range(60):
        now += rnd.randrange(4000)
        rows = [((seq := seq + 1), now + rnd.randrange(1000), f"k{rnd.randrange(12)}") for _ in range(rnd.randrange(1, 9))]
        out = [s for part in first.handleInputRows((0,), iter([frame(rows)]), None) for s in part["seq"]]
        want = []
        for k in {k for *_, k in rows} - set(until):
            t, s = min((t, s) for s, t, x in rows if x == k)
            until[k] = t + 5000
            want.append(s)
        assert sorted(out) == sorted(want)
        until = {k: t for k, t in until.items() if t > now}
        for at in sorted(t for t in handle.timers if t <= now):
            handle.timers.remove(at)
            list(first.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), SimpleNamespace(getExpiryTimeInMs=lambda at=at: at)))
        assert handle.timers == ({min(until.values())} if until else set())

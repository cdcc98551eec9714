"""Stale claims keep the state of many jobs together."""

import random
from datetime import UTC

import pandas as pd
import pytest

from sonoshelf.streaming import stateful

from .test_stateful import BEATS, Stream, beat, recovered


@pytest.mark.parametrize("shards", [1, 3])
def test_jobs_of_one_shard_go_stale_each_at_its_time(spark, tmp_path, monkeypatch, shards):
    monkeypatch.setattr(stateful, "SHARDS", shards)
    r = random.Random(shards)
    rows = sorted((beat(r.randrange(25), 400 * k + r.randrange(3), r.choice(["claim", "beat", "beat", "end"]), r.randrange(5)) for k in range(120)), key=lambda x: x[1])
    rows.append(beat(99, 400 * 120, "claim"))
    parts = [rows[:40], rows[40:41], rows[41:90], rows[90:]]
    for p in parts:
        r.shuffle(p)
    s = Stream(spark, tmp_path, BEATS, lambda e: stateful.recoveries(e, late="0 seconds"))
    s.give(parts[0], parts[1])
    got = s.give(parts[2], parts[3])
    assert sorted((g.job_id, g.attempts, g.updated_at.astimezone(UTC)) for g in got if g.record == "job") == recovered(rows, 400 * 120)


class Counted:
    """A handle and a value state in one, which count what is asked of the JVM."""

    def __init__(self):
        self.value, self.calls, self.timers = None, 0, set()

    def _ask(self, out=None):
        self.calls += 1
        return out

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        return self._ask(self.value is not None)

    def get(self):
        return self._ask(self.value)

    def update(self, value):
        self.value = self._ask(value)

    def clear(self):
        self.value = self._ask()

    def registerTimer(self, at):  # noqa: N802
        self._ask(self.timers.add(at))

    def deleteTimer(self, at):  # noqa: N802
        self._ask(self.timers.discard(at))


def test_many_jobs_take_few_calls():
    h, p = Counted(), stateful.Stale(30)
    p.init(h)
    told = pd.DataFrame([(k, k * 1000, 0, 0, 1, f"p{k}", "by") for k in range(5000)], columns=["job_id", "at", "seq", "kind", "attempts", "file_path", "claimed_by"])
    assert sum(map(len, p.handleInputRows(("s",), iter([told[3000:], told[:3000]]), None))) == 0
    assert h.calls < 8 and h.timers == {30_001}
    later = told.assign(at=40_000_000, kind=1)[:10]
    assert sum(map(len, p.handleInputRows(("s",), iter([later]), None))) == 10  # silent for over 30 s before these beats
    assert h.calls < 16 and h.timers == {30_011}

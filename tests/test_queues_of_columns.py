"""Queues keep many jobs in few values of state."""

import random

import pandas as pd

from sonoshelf.streaming import stateful


class Counted:
    """A handle and its states in one, which count what is asked of the JVM."""

    def __init__(self):
        self.calls = 0

    def getValueState(self, *named):  # noqa: N802
        return State(self)

    getMapState = getValueState  # noqa: N815


class State:
    def __init__(self, handle):
        self.handle, self.values = handle, {}

    def _count(self):
        self.handle.calls += 1
        return self.values

    def exists(self):
        return () in self._count()

    def get(self):
        return self._count()[()]

    def update(self, value):
        self._count()[()] = value

    def clear(self):
        self._count().clear()

    def getValue(self, key):  # noqa: N802
        return self._count()[key]

    def updateValue(self, key, value):  # noqa: N802
        self._count()[key] = value

    def removeKey(self, key):  # noqa: N802
        del self._count()[key]


def test_many_jobs_take_few_calls(monkeypatch):
    monkeypatch.setattr(stateful, "PART", 5000)
    h, r = Counted(), random.Random(5)
    news, queue = stateful.News(), stateful.Claims()
    news.init(h)
    queue.init(h)
    ids = list(range(12_000))
    r.shuffle(ids)
    jobs = pd.DataFrame([(0, t, t, i, f"p{i}", i, i % 4, i % 2) for t, i in enumerate(ids)], columns=["shard", "at", "seq", "job_id", "file_path", "created_at", "attempts", "status"])
    told = pd.concat(news.handleInputRows((0,), iter([jobs[:7000], jobs[7000:]]), None))
    free = sorted(i for i in ids if i % 2 == 0 and i % 4 < 3)
    assert sorted(told.job_id) == free and told.takes.all()
    log = told.assign(kind=0, runner=None, paused=False, run_limit=-1)
    polls = lambda t, n: log[:1].assign(kind=1, runner="r", job_id=0).loc[lambda f: f.index.repeat(n)].assign(at=range(t, t + n), seq=range(n))
    first = pd.concat(queue.handleInputRows((0,), iter([log, polls(20_000, 3000)]), None))
    assert first.job_id.tolist() == free[:3000] and (first.attempts == first.job_id % 4 + 1).all()
    again = list(news.handleInputRows((0,), iter([jobs]), None))
    assert sum(len(x[x.job_id % 2 == 0]) for x in again) == 0  # known already
    rest = pd.concat(queue.handleInputRows((0,), iter([log, polls(40_000, 9000)]), None))  # a repeat of what was claimed changes nothing
    assert rest.job_id.tolist() == free[3000:] and h.calls < 40

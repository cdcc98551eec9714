"""Streams with state against plain Python, over batches and restarts."""

import random
from datetime import UTC, datetime, timedelta

import pytest

from sonoshelf.streaming import stateful

DAY0 = datetime(2024, 1, 1, tzinfo=UTC)


def at(seconds):
    return DAY0 + timedelta(seconds=seconds)


class Stream:
    """Files that come one by one; each run goes on from the checkpoint, as after a restart."""

    def __init__(self, spark, folder, schema, job):
        self.spark, self.folder, self.schema, self.job, self.n = spark, str(folder), schema, job, 0

    def give(self, *batches):
        for rows in batches:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/in/b{self.n}")
            self.n += 1
        s = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in/*")
        out = self.job(s)
        q = out.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        return self.spark.read.schema(out.schema).parquet(f"{self.folder}/out").collect()


QUEUE = "shard long, at timestamp, seq long, kind string, job_id long, file_path string, created_at timestamp, attempts int, status string, runner string, paused boolean, run_limit long"


def job(t, seq, i, created, attempts=0, status="pending", shard=0):
    return (shard, at(t), seq, "job", i, f"p{i}", at(created), attempts, status, None, None, None)


def poll(t, seq, runner="r", shard=0):
    return (shard, at(t), seq, "poll", None, None, None, None, None, runner, None, None)


def control(t, seq, paused=False, limit=None, shard=0):
    return (shard, at(t), seq, "control", None, None, None, None, None, None, paused, limit)


def simulated(rows):
    """The queue by hand: {(time, seq): (shard, job, attempts)}."""
    jobs, gate, out = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        shard, t, seq, kind = r[:4]
        if kind == "job":
            jobs[shard, r[4]] = [r[8], r[6], r[7]]
        elif kind == "control":
            gate[shard] = [r[10], r[11]]
        else:
            g = gate.setdefault(shard, [False, None])
            can = sorted((c, i) for (s, i), (status, c, n) in jobs.items() if s == shard and status == "pending" and n < 3)
            if g[0] or g[1] == 0 or not can:
                continue
            i = can[0][1]
            jobs[shard, i][0] = "claimed"
            jobs[shard, i][2] += 1
            if g[1] is not None:
                g[1] -= 1
            out[t.timestamp(), seq] = (shard, i, jobs[shard, i][2], g[1])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_claims_are_those_of_a_queue_by_hand(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = []
    for k in range(160):
        shard = r.randrange(2)
        kind = r.choice(["job", "job", "poll", "poll", "poll", "control"] if k % 9 == 0 else ["job", "poll"])
        t = k // 2  # two rows of one time, in order of seq
        if kind == "job":
            i = r.randrange(30)
            rows.append(job(t, k, i, r.randrange(10), r.choice([0, 0, 1, 2, 3]), r.choice(["pending"] * 5 + ["failed", "claimed"]), shard))
        elif kind == "poll":
            rows.append(poll(t, k, f"r{k}", shard))
        else:
            rows.append(control(t, k, r.random() < 0.3, r.choice([None, 0, 1, 3]), shard))
    s, got = Stream(spark, tmp_path, QUEUE, stateful.claims), []
    for a, b in [(0, 50), (50, 90), (90, 160)]:
        part = rows[a:b]
        r.shuffle(part)
        got = s.give(part)
    want = simulated(rows)
    assert sorted(((g.shard, g.job_id, g.attempts, g.left, g.claimed_by) for g in got), key=repr) == sorted(((*v, f"r{seq}") for (_, seq), v in want.items()), key=repr)


def test_a_job_is_claimed_once_though_its_row_comes_again(spark, tmp_path):
    s = Stream(spark, tmp_path, QUEUE, stateful.claims)
    s.give([job(0, 0, 1, 5), job(0, 1, 2, 3), poll(1, 2, "a")])
    got = s.give([job(0, 0, 1, 5), job(0, 1, 2, 3), poll(2, 3, "b"), poll(3, 4, "c")], [poll(4, 5, "d")])
    assert sorted((g.job_id, g.claimed_by) for g in got) == [(1, "b"), (2, "a")]
    got = s.give([job(9, 6, 2, 3, attempts=1), poll(10, 7, "e"), job(11, 8, 1, 5, status="done"), poll(12, 9, "f")])
    assert sorted((g.job_id, g.claimed_by, g.attempts) for g in got) == [(1, "b", 1), (2, "a", 1), (2, "e", 2)]


def test_an_empty_poll_takes_nothing_from_the_budget(spark, tmp_path):
    s = Stream(spark, tmp_path, QUEUE, stateful.claims)
    got = s.give([control(0, 0, limit=2), poll(1, 1), poll(2, 2)], [job(3, 3, 1, 1), job(3, 4, 2, 1), job(3, 5, 3, 1), poll(4, 6), poll(5, 7), poll(6, 8)])
    assert sorted((g.job_id, g.left) for g in got) == [(1, 1), (2, 0)]


BEATS = "job_id long, at timestamp, seq int, kind string, attempts int, file_path string, claimed_by string"


def beat(i, t, kind="beat", attempts=0):
    return (i, at(t), {"claim": 0, "beat": 1, "end": 2}[kind], kind, attempts, f"p{i}", "runner")


def recovered(rows, until, timeout=1800):
    out = []
    for i in {r[0] for r in rows}:
        held = None
        for r in sorted((r for r in rows if r[0] == i), key=lambda r: r[1:3]) + [(i, at(until), 9, "over", 0)]:
            if held and (r[1] - held[0]).total_seconds() > timeout:
                out.append((i, held[1], held[0]))
                held = None
            if r[3] == "claim":
                held = (r[1], r[4])
            elif r[3] == "beat" and held:
                held = (r[1], held[1])
            elif r[3] == "end":
                held = None
    return sorted(out)


@pytest.mark.parametrize("seed", [3, 4])
def test_stale_claims_are_recovered_with_their_events(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = sorted((beat(r.randrange(12), 600 * k + r.randrange(3), r.choice(["claim", "beat", "beat", "end"]), r.randrange(5)) for k in range(60)), key=lambda x: x[1])
    rows.append(beat(99, 600 * 60, "claim"))
    parts = [rows[:20], rows[20:45], rows[45:]]
    for p in parts:
        r.shuffle(p)
    s = Stream(spark, tmp_path, BEATS, lambda e: stateful.recoveries(e, late="0 seconds"))
    s.give(parts[0])
    got = s.give(parts[1], parts[2])
    want = recovered(rows, 600 * 60)
    assert want and sorted((g.job_id, g.attempts, g.updated_at.astimezone(UTC)) for g in got if g.record == "job") == want
    for g in got:
        if g.record == "job":
            assert (g.status, g.claimed_by, g.error) == (("pending", None, None) if g.attempts < 3 else ("failed", "runner", "max attempts reached"))
        else:
            assert (g.stage, g.event, g.runner_host) == (("requeue", "retry", "go-worker") if g.attempts < 3 else ("fail", "error", "go-worker")) and g.reason and g.file_path == f"p{g.job_id}"
    assert len(got) == 2 * len(want)


def test_late_beats_and_a_new_claim(spark, tmp_path):
    s = Stream(spark, tmp_path, BEATS, lambda e: stateful.recoveries(e, late="1 hour"))
    s.give([beat(1, 0, "claim"), beat(1, 1500)])
    got = s.give([beat(1, 900), beat(2, 4000, "claim")], [beat(1, 3000)])  # both late, neither moves the beat back
    assert got == []
    got = s.give([beat(3, 20_000, "claim")], [beat(1, 20_100, "claim", 1)], [beat(1, 20_200), beat(3, 26_000)])
    assert sorted((g.job_id, g.updated_at.astimezone(UTC)) for g in got if g.record == "job") == [(1, at(3000)), (1, at(20_200)), (2, at(4000)), (3, at(20_000))]


LOOKS = "path string, at timestamp, length long"


def test_files_settle_once(spark, tmp_path):
    look = lambda p, t, n: (p, at(t), n)
    s = Stream(spark, tmp_path, LOOKS, stateful.settled_files)
    first = [look("a", 0, 5), look("a", 2, 5), look("grows", 0, 1), look("grows", 2, 2), look("b", 0, 0), look("b", 2, 0), look("b", 4, 0), look("b", 6, 0)]
    assert [(g.path, g.length, g.settled) for g in s.give(first)] == [("b", 0, True)]
    more = [look("a", 4, 5), look("a", 6, 5), look("a", 8, 5), look("a", 10, 6), look("b", 8, 9), *[look("b", 10 + k, 9) for k in range(5)], *[look("grows", 4 + 2 * k, 3 + k) for k in range(10)]]
    got = s.give(more[:4], more[4:])
    assert sorted((g.path, g.at.astimezone(UTC), g.length, g.settled) for g in got) == [("a", at(6), 5, True), ("b", at(6), 0, True)]
    got = s.give([look("c", 700, 1)], [look("grows", 702, 99), look("grows", 704, 99), look("grows", 706, 99), look("grows", 708, 99)], [look("d", 2000, 1)])
    assert sorted((g.path, g.at.astimezone(UTC), g.length, g.settled) for g in got if g.path not in "ab") == [("c", at(1300), 1, False), ("grows", at(600), 12, False)]


def test_a_stored_checkpoint_keeps_its_provider(spark):
    stateful.use_rocksdb(spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == stateful.ROCKSDB

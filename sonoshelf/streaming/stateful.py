"""Streams with state of their own: claims from a queue, claims that went stale, files that have settled.

Each is one processor on ``transformWithStateInPandas``: state in RocksDB, timers by event time, exactly once with the
checkpoint and a sink that repeats a batch. Rows of a key are taken in order of time, whatever batches they come in; a
result that time alone decides (a claim gone stale, a file that never settles) is due at its time, both where a timer
fires and where a later row of the key shows that it has passed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from sonoshelf.operators.pipeline import DISCARD, MOST_ATTEMPTS, NO_ATTEMPTS, RETRY, WORKER

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS = 1_000_000


def use_rocksdb(spark: SparkSession) -> None:
    """New stateful streams keep their state in RocksDB; those that have a checkpoint keep what it names."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def micros(column: str):
    return F.coalesce(F.unix_micros(F.col(column).cast("timestamp")), F.lit(0)).alias(column)


def ordered(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator:
    """The rows of one key in a batch, in order."""
    return pd.concat(list(frames)).sort_values(by, kind="stable").itertuples(index=False)


# ---- claims

CLAIMED = "shard long, job_id long, file_path string, claimed_by string, at long, attempts int, left long"
UNLIMITED = -1
#: Jobs are dealt by hash over so many keys of state; a checkpoint holds to its number.
SHARDS = 1024


STATUSES = {"pending": 0, "done": 1}
NEWS = "shard long, at long, seq long, job_id long, file_path string, created_at long, attempts int, takes boolean"
KNOWN = pa.schema([("shard", pa.int64()), ("job_id", pa.int64()), ("at", pa.int64()), ("seq", pa.int64()), ("takes", pa.bool_())])
QUEUED = pa.schema([("job_id", pa.int64()), ("at", pa.int64()), ("seq", pa.int64()), ("created_at", pa.int64()), ("attempts", pa.int32()), ("takes", pa.bool_()), ("file_path", pa.string())])
#: Rows of a queue in one value of state, and of its log that are objects at a time.
PART = 100_000
CLAIMED_SINCE, UNTOLD = -2, -1


def packed(columns: list, schema: pa.Schema) -> bytes:
    """Columns as one value of state."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as w:
        w.write_batch(pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))
    return sink.getvalue().to_pybytes()


def unpacked(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


class News(StatefulProcessor):
    """The jobs that fall to one of SHARDS keys, each with the last row that told of it: rows that are no later are left
    out, and so are those that change nothing for a queue, as the job could not be taken before and can't be now."""

    def init(self, handle) -> None:
        self.known = handle.getValueState("known", "jobs binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = {}
        if self.known.exists():
            known = {(s, j): (a, q, t) for s, j, a, q, t in zip(*[c.to_pylist() for c in unpacked(self.known.get()[0]).columns], strict=True)}
        told = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        mask, over = [], {}
        for shard, job, at, seq, status, attempts in zip(*[told[c].tolist() for c in ("shard", "job_id", "at", "seq", "status", "attempts")], strict=True):
            have, takes = known.get((shard, job)), status == STATUSES["pending"] and attempts < MOST_ATTEMPTS
            new = have is None or (at, seq) > have[:2]
            mask.append(new and (takes or (have is not None and have[2])))
            if new:
                known[shard, job] = (at, seq, takes)
                over[shard, job] = status == STATUSES["done"]
        for job, done in over.items():
            if done:
                del known[job]  # ended for good
        if known:
            self.known.update((packed([*map(list, zip(*[(*k, *v) for k, v in known.items()], strict=True))], KNOWN),))
        elif self.known.exists():
            self.known.clear()
        news = told[np.asarray(mask, bool)]
        takes = (news["status"] == STATUSES["pending"]) & (news["attempts"] < MOST_ATTEMPTS)
        yield news.assign(takes=takes)[[c.split()[0] for c in NEWS.split(", ")]]

    def close(self) -> None:
        pass


class Claims(StatefulProcessor):
    """The queue of one shard: jobs that can be taken, the times of claims that no later row has told of, and the gate.
    Rows are columns; polls and jobs meet in one pass in order of time, over a heap of places in the queue's order."""

    def init(self, handle) -> None:
        self.queue = handle.getMapState("queue", "part int", "jobs binary")
        self.gate = handle.getValueState("gate", "paused boolean, run_limit long, parts int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        paused, left, parts = self.gate.get() if self.gate.exists() else (False, UNLIMITED, 0)
        told, jobs = self._columns(rows)
        stored = [unpacked(self.queue.getValue((k,))[0]) for k in range(parts)]
        have = pa.concat_tables([*stored, jobs]).combine_chunks()
        job, at, seq, created, attempts, takes = (have.column(c).to_numpy() for c in QUEUED.names[:6])
        n = have.num_rows - jobs.num_rows
        ids, code = np.unique(job, return_inverse=True)
        places = np.lexsort((seq, at, job, created))  # the queue's order
        rank = np.empty(len(places), np.int64)
        rank[places] = np.arange(len(places))
        latest, since = np.full(len(ids), UNTOLD, np.int64), np.zeros((len(ids), 2), np.int64)
        latest[code[:n]] = np.where(takes[:n], np.arange(n), CLAIMED_SINCE)
        since[code[:n], 0], since[code[:n], 1] = at[:n], seq[:n]
        heap = np.sort(rank[:n][takes[:n]]).tolist()
        order = np.lexsort((told["seq"], told["at"]))
        for part in range(0, len(order), PART):
            out = []
            some = order[part : part + PART]
            for r, t, s, kind, i in zip(some.tolist(), *[told[c][some].tolist() for c in ("at", "seq", "kind", "job")], strict=True):
                if kind == 0:
                    i += n
                    c = code[i]
                    if latest[c] == UNTOLD or (t, s) > (since[c, 0], since[c, 1]):
                        latest[c], since[c] = i, (t, s)
                        if takes[i]:
                            heapq.heappush(heap, int(rank[i]))
                elif kind == 2:
                    paused, left = bool(told["paused"][r]), int(told["run_limit"][r])
                elif not paused and left != 0:
                    while heap:
                        i = places[heapq.heappop(heap)]
                        if latest[code[i]] == i:
                            left -= left > 0
                            latest[code[i]], since[code[i]] = CLAIMED_SINCE, (t, s)
                            out.append((i, r, t, left))
                            break
            if out:
                took, by, when, rest = (list(x) for x in zip(*out, strict=True))
                yield pd.DataFrame({
                    "shard": int(key[0]), "job_id": job[took], "file_path": have.column("file_path").take(pa.array(took)).to_pandas(), "claimed_by": told["runner"].take(pa.array(by)).to_pandas(),
                    "at": when, "attempts": attempts[took] + 1, "left": rest,
                })
        self._keep(have, ids, latest, since, takes, parts, paused, left)

    @staticmethod
    def _columns(rows: Iterator[pd.DataFrame]) -> tuple[dict, pa.Table]:
        """All rows as columns, with the number of a job's row among those of jobs; and the jobs' rows."""
        got, runner, jobs = [], [], [QUEUED.empty_table()]
        for f in rows:
            mine = f["kind"] == 0
            got.append({c: f[c].to_numpy() for c in ("at", "seq", "kind", "paused", "run_limit")})
            runner.append(pa.array(f["runner"], pa.string()))
            jobs.append(pa.table([pa.array(f.loc[mine, c], t) for c, t in zip(QUEUED.names, QUEUED.types, strict=True)], schema=QUEUED))
        told = {c: np.concatenate([g[c] for g in got]) for c in got[0]}
        told["job"] = np.cumsum(told["kind"] == 0) - 1
        told["runner"] = pa.chunked_array(runner, pa.string())
        return told, pa.concat_tables(jobs)

    def _keep(self, have, ids, latest, since, takes, parts: int, paused: bool, left: int) -> None:
        waiting = np.sort(latest[latest >= 0])
        waiting = waiting[takes[waiting]]
        claimed = np.flatnonzero(latest == CLAIMED_SINCE)
        none = [0] * len(claimed)
        tables = [have.take(pa.array(waiting)), pa.table([pa.array(c, t) for c, t in zip([ids[claimed], since[claimed, 0], since[claimed, 1], none, none, [False] * len(claimed), [None] * len(claimed)], QUEUED.types, strict=True)], schema=QUEUED)]
        whole, now = pa.concat_tables(tables).combine_chunks(), 0
        for k in range(0, whole.num_rows, PART):
            part = whole.slice(k, PART).combine_chunks()
            self.queue.updateValue((now,), (packed([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in part.columns], QUEUED),))
            now += 1
        for k in range(now, parts):
            self.queue.removeKey((k,))
        self.gate.update((paused, left, now))

    def close(self) -> None:
        pass


def claims(events: DataFrame) -> DataFrame:
    """(shard, job_id, file_path, claimed_by, claimed_at, attempts, left): each poll takes its shard's oldest pending job
    with attempts left, if the gate is open, and only then a run of the budget.

    events: shard, at, seq (orders rows of one time), kind; kind job has job_id, file_path, created_at, attempts and
    status (a row for each change of a job), kind poll has runner, kind control has paused and run_limit (null: without
    limit). A budget holds for a shard: a queue of one shard keeps it exactly, several get shares. A row that is no later
    than what is known of its job, such as a repeat of one that was claimed since, changes nothing."""
    use_rocksdb(events.sparkSession)
    null = lambda t: F.lit(None).cast(t)
    status = F.when(F.col("status") == "pending", STATUSES["pending"]).when(F.col("status") == "done", STATUSES["done"]).otherwise(-1).alias("status")
    deal = F.pmod(F.xxhash64("shard", "job_id"), F.lit(SHARDS)).alias("deal")
    jobs = events.where("kind = 'job'").select(deal, "shard", micros("at"), F.col("seq").cast("long").alias("seq"), F.coalesce("job_id", F.lit(0)).cast("long").alias("job_id"), "file_path", micros("created_at"), F.coalesce("attempts", F.lit(0)).cast("int").alias("attempts"), status)
    news = jobs.groupBy("deal").transformWithStateInPandas(News(), NEWS, "Append", "None")
    news = news.select("shard", "at", "seq", F.lit(0).alias("kind"), "job_id", "file_path", "created_at", "attempts", "takes", null("string").alias("runner"), F.lit(False).alias("paused"), F.lit(UNLIMITED).cast("long").alias("run_limit"))
    others = events.where("kind in ('poll', 'control')").select(
        "shard", micros("at"), F.col("seq").cast("long").alias("seq"), F.when(F.col("kind") == "poll", 1).otherwise(2).alias("kind"), F.lit(0).cast("long").alias("job_id"), null("string").alias("file_path"), F.lit(0).cast("long").alias("created_at"), F.lit(0).alias("attempts"),
        F.lit(False).alias("takes"), "runner", F.coalesce("paused", F.lit(False)).alias("paused"), F.coalesce(F.col("run_limit").cast("long"), F.lit(UNLIMITED)).alias("run_limit"),
    )
    out = news.unionByName(others).groupBy("shard").transformWithStateInPandas(Claims(), CLAIMED, "Append", "None")
    return out.withColumn("claimed_at", F.timestamp_micros("at")).withColumn("left", F.when(F.col("left") != UNLIMITED, F.col("left"))).drop("at")


# ---- claims that went stale

RECOVERED = "job_id long, file_path string, attempts int, beat long, claimed_by string"


KINDS = {"claim": 0, "beat": 1, "end": 2}
HELD = pa.schema([("job_id", pa.int64()), ("beat", pa.int64()), ("attempts", pa.int32()), ("file_path", pa.string()), ("claimed_by", pa.string())])


class Stale(StatefulProcessor):
    """The open claims of a shard of jobs, each with its last beat, and one timer for when the first goes stale. They are
    one value, read and written once a batch: a state per job costs several calls to the JVM for each."""

    def __init__(self, timeout_s: int):
        self.timeout = timeout_s * MICROS

    def init(self, handle) -> None:
        self.handle = handle
        self.claims = handle.getValueState("claims", "held binary, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, timer = self._held()
        told = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        out = []
        for job, at, kind, attempts, path, by in zip(*[told[c].tolist() for c in ("job_id", "at", "kind", "attempts", "file_path", "claimed_by")], strict=True):
            have = held.get(job)
            if have and at - have[0] > self.timeout:
                out.append(self._row(job, held.pop(job)))
                have = None
            if kind == KINDS["claim"]:
                held[job] = (at, attempts, path, by)
            elif kind == KINDS["beat"] and have:
                held[job] = (max(have[0], at), *have[1:])
            elif kind == KINDS["end"]:
                held.pop(job, None)
        self._keep(held, timer)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, now = self._held()[0], timerValues.getCurrentWatermarkInMs()
        over = [job for job, h in held.items() if self._due(h[0]) <= now]
        out = [self._row(job, held.pop(job)) for job in over]
        self._keep(held, None)  # the one that fired is gone
        yield self._frame(out)

    def _due(self, beat: int) -> int:
        return (beat + self.timeout) // 1000 + 1

    def _held(self) -> tuple[dict, int | None]:
        if not self.claims.exists():
            return {}, None
        raw, timer = self.claims.get()
        t = pa.ipc.open_stream(raw).read_all()
        return {job: tuple(rest) for job, *rest in zip(*[c.to_pylist() for c in t.columns], strict=True)}, timer

    def _keep(self, held: dict, timer: int | None) -> None:
        due = self._due(min(h[0] for h in held.values())) if held else None
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if not held:
            if self.claims.exists():
                self.claims.clear()
            return
        if timer != due:
            self.handle.registerTimer(due)
        columns = [list(held), *map(list, zip(*held.values(), strict=True))]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, HELD) as w:
            w.write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, HELD, strict=True)], schema=HELD))
        self.claims.update((sink.getvalue().to_pybytes(), due))

    @staticmethod
    def _row(job: int, held: tuple) -> tuple:
        return job, held[2], held[1], held[0], held[3]

    @staticmethod
    def _frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RECOVERED.split(", ")])

    def close(self) -> None:
        pass


def recoveries(events: DataFrame, timeout_s: int = 1800, late: str = "5 minutes") -> DataFrame:
    """What becomes of claims without a beat for longer than the timeout: (record, job_id, file_path, attempts, status,
    claimed_by, error, updated_at, stage, event, runner_host, reason), two rows each: record "job" with the job's new
    values (pending and free again, or failed where its attempts are used up) and record "event" for the audit log.

    events: job_id, at, seq, kind (claim, with attempts, file_path and claimed_by; beat; end). Beats before a claim, after
    its end or after its recovery change nothing, nor do late ones that are older than the last. Rows that come more than
    ``late`` after the newest row are left out, and a silence is told of that much later."""
    use_rocksdb(events.sparkSession)
    timed = events.where("job_id is not null").withWatermark("at", late)
    kind = F.when(F.col("kind") == "claim", KINDS["claim"]).when(F.col("kind") == "beat", KINDS["beat"]).when(F.col("kind") == "end", KINDS["end"]).otherwise(-1).alias("kind")
    rows = timed.select("job_id", "at", micros("at").alias("us"), "seq", kind, F.coalesce("attempts", F.lit(0)).alias("attempts"), "file_path", "claimed_by")
    shard = F.pmod(F.xxhash64("job_id"), F.lit(SHARDS)).alias("shard")
    rows = rows.select(shard, "job_id", F.col("us").alias("at"), F.col("at").alias("event_time"), "seq", "kind", "attempts", "file_path", "claimed_by")
    found = rows.groupBy("shard").transformWithStateInPandas(Stale(timeout_s), RECOVERED, "Append", "EventTime")
    return told(found)


def told(found: DataFrame) -> DataFrame:
    """The job's row and the audit event of each recovery."""
    free = F.col("attempts") < MOST_ATTEMPTS
    none = F.lit(None).cast("string")
    job = F.struct(
        F.lit("job").alias("record"), F.when(free, "pending").otherwise("failed").alias("status"), F.when(~free, F.col("claimed_by")).alias("claimed_by"), F.when(~free, NO_ATTEMPTS).alias("error"),
        none.alias("stage"), none.alias("event"), none.alias("runner_host"), none.alias("reason"),
    )
    of = lambda k: F.when(free, RETRY[k]).otherwise(DISCARD[k])
    event = F.struct(
        F.lit("event").alias("record"), none.alias("status"), none.alias("claimed_by"), none.alias("error"), of(0).alias("stage"), of(1).alias("event"), F.lit(WORKER).alias("runner_host"), of(2).alias("reason")
    )
    return found.withColumn("r", F.explode(F.array(job, event))).select("job_id", "file_path", "attempts", F.timestamp_micros("beat").alias("updated_at"), "r.*")


# ---- files that have settled

SETTLED = "path string, at long, length long, settled boolean"


class Settling(StatefulProcessor):
    """One file: the length last seen, how often in a row, and whether it was told of."""

    def __init__(self, repeats: int, cap_s: float):
        self.repeats, self.cap = repeats, int(cap_s * MICROS)

    def init(self, handle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", "start long, length long, streak int, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, out = (self.file.get() if self.file.exists() else None), []
        for r in ordered(rows, ["at", "length"]):
            if state is None:
                self.handle.registerTimer((r.at + self.cap) // 1000 + 1)
                state = (r.at, r.length, 0, False)
                continue
            start, length, streak, done = state
            if done:
                break
            if r.at - start > self.cap:
                state = self._tell(out, key, start + self.cap, state, False)
                break
            streak = streak + 1 if r.length == length else 0
            state = (start, r.length, streak, False)
            if streak >= self.repeats:
                state = self._tell(out, key, r.at, state, True)
        self.file.update(state)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.file.get() if self.file.exists() else None
        if state and not state[3]:
            out = []
            self.file.update(self._tell(out, key, state[0] + self.cap, state, False))
            yield self._frame(out)

    def _tell(self, out: list, key, at: int, state: tuple, settled: bool) -> tuple:
        out.append((key[0], at, state[1], settled))
        if settled:
            self.handle.deleteTimer((state[0] + self.cap) // 1000 + 1)
        return (*state[:3], True)

    @staticmethod
    def _frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SETTLED.split(", ")])

    def close(self) -> None:
        pass


def settled_files(looks: DataFrame, repeats: int = 3, cap_s: float = 600, late: str = "1 minute") -> DataFrame:
    """(path, at, length, settled), once a path: at the look that finds the same length as the ``repeats`` looks before
    it, or unsettled, with the last length, once more than cap_s seconds have passed since the first look.

    looks: path, at, length. A path is told of once, however often it changes afterwards. Looks that come more than
    ``late`` after the newest one are left out."""
    use_rocksdb(looks.sparkSession)
    rows = looks.withWatermark("at", late).select("path", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), "at", "length")
    rows = rows.select("path", F.col("us").alias("at"), F.col("at").alias("event_time"), "length")
    found = rows.groupBy("path").transformWithStateInPandas(Settling(repeats, cap_s), SETTLED, "Append", "EventTime")
    return found.withColumn("at", F.timestamp_micros("at"))


def replayed(spark: SparkSession, log: DataFrame, folder: str, job, files_per_batch: int | None = None) -> DataFrame:
    """What a stream job gives for a table that is written below folder and read as a stream until it ends."""
    log.write.mode("overwrite").parquet(f"{folder}/log")
    read = spark.readStream.schema(log.schema)
    stream = (read.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else read).parquet(f"{folder}/log")
    out = job(stream)
    q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


# ---- phases

PHASES = "service string, at long, phase string, run_limit long, batch long"


class Phases(StatefulProcessor):
    """A service's phase and the number of its batch."""

    def __init__(self, size: int, most: int, judges_first: bool):
        self.size, self.most, self.judges_first = size, most, judges_first

    def init(self, handle) -> None:
        self.state = handle.getValueState("phase", "phase string, batch long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        phase, batch = self.state.get() if self.state.exists() else (None, 0)
        out = []
        for r in ordered(rows, ["at", "seq"]):
            before = phase
            if r.kind == "start":
                # a run that died while it analysed goes on there, without budget
                phase, batch = ("analyze", 0) if r.phase == "analyze" else ("ready", 0)
                if phase == "analyze":
                    out.append((key[0], r.at, "analyze", 0, batch))
            elif r.kind == "stop" and phase is not None:
                phase = None
            elif r.kind == "status":
                if phase == "transcribe" and r.claimed == 0 and (r.run_limit == 0 or r.pending == 0):
                    phase = "analyze"
                    out.append((key[0], r.at, phase, UNLIMITED, batch))
                elif phase == "analyze" and r.embed_backlog == 0 and (not self.judges_first or r.eval_backlog == 0):
                    phase = "ready"
                if phase == "ready":
                    if (r.pending == 0 and r.claimed == 0) or (self.most and batch >= self.most):
                        phase = None
                    else:
                        phase, batch = "transcribe", batch + 1
                        out.append((key[0], r.at, phase, self.size, batch))
            if phase is None and before is not None:
                out.append((key[0], r.at, "idle", 0, batch))  # not without limit, which would let all run
        self.state.update((phase, batch))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PHASES.split(", ")])

    def close(self) -> None:
        pass


def phases(log: DataFrame, size: int, most_batches: int = 0, judges_first: bool = False) -> DataFrame:
    """(service, at, phase, run_limit, batch): what a service's control row is set to, as its log tells.

    log: service, at, seq, kind; kind start (with the phase that was found), kind status (pending, claimed, run_limit,
    embed_backlog, eval_backlog) and kind stop. From its start, work goes in batches: transcribe with a budget of size
    runs, until nothing is claimed and the budget is spent or nothing waits; then analyze (the budget stays as it is),
    until nothing is left to embed (nor to judge, if that comes first); then the next batch, or idle without budget, once
    nothing waits or most_batches are done (0: any number). A stop is idle at once. A run that finds analyze goes on with
    it. Each status row makes one step at most, but that the end of a batch and the start of the next are one."""
    use_rocksdb(log.sparkSession)
    number = lambda c, v=0: F.coalesce(F.col(c).cast("long"), F.lit(v)).alias(c)
    rows = log.select("service", micros("at"), "seq", "kind", "phase", number("pending"), number("claimed"), number("run_limit", UNLIMITED), number("embed_backlog"), number("eval_backlog"))
    out = rows.groupBy("service").transformWithStateInPandas(Phases(size, most_batches, judges_first), PHASES, "Append", "None")
    return out.withColumn("at", F.timestamp_micros("at")).withColumn("run_limit", F.when(F.col("run_limit") != UNLIMITED, F.col("run_limit")))


PHASE_NAMES = ("idle", "transcribe", "analyze")


def control_row(settings: DataFrame) -> DataFrame:
    """(service, paused, run_limit, phase, runner_version) from the log of settings (service, at, seq, name, value): the
    last value of each name, an empty or null one being none. Unset, it is not paused, without limit and idle; a phase
    that isn't one is an error."""
    at = F.struct("at", "seq")
    last = lambda name: F.max_by(F.struct(F.nullif("value", F.lit("")).alias("v")), F.when(F.col("name") == name, at))["v"]
    row = settings.groupBy("service").agg(*[last(n).alias(n) for n in ("paused", "run_limit", "phase", "runner_version")])
    phase = F.coalesce("phase", F.lit("idle"))
    checked = F.when(phase.isin(*PHASE_NAMES), phase).otherwise(F.raise_error(F.concat(F.lit("no such phase: "), phase)))
    return row.select("service", F.coalesce(F.col("paused").cast("boolean"), F.lit(False)).alias("paused"), F.col("run_limit").cast("long").alias("run_limit"), checked.alias("phase"), "runner_version")

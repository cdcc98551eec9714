"""Registered queries of runs, evaluation and service views, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonoshelf.functions import text as tx
from sonoshelf.operators import evaluation, findings, library, pipeline, runs, search, service, vector
from sonoshelf.sources.scratch import new_folder

from . import roles
from .catalogue import query, table
from .queries import COS, ROLLUP, _similarity, _spoken
from .roles import BOOKS, EVENTS, FINDINGS, JOBS, METRICS

#: Jobs whose transcripts have chunks, and those that were evaluated; a transcript has the id of its job.
PARTS = """k AS (SELECT l_orderkey AS transcript_id, max(l_shipdate) AS created_at, count(*) AS n FROM lineitem WHERE l_discount >= 0.08 GROUP BY 1),
ev AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R'), tr AS (SELECT job_id AS id, duration_seconds FROM metrics)"""


def _parts(spark, sf):
    """jobs, transcripts, chunks and metrics by the roles of the tables."""
    line = table(spark, sf, "lineitem")
    j = roles.jobs(spark, sf).withColumn("completed_at", F.when(F.col("status") == "done", F.col("updated_at") - F.expr("interval 1 minute")))
    m = roles.metrics(spark, sf)
    judged = F.when(F.col("eval_findings") > 0, F.col("finished_at")).alias("eval_finished_at")
    ends = F.col("finished_at").alias("transcribe_finished_at"), F.col("finished_at").alias("embed_finished_at")
    metrics = m.select("job_id", judged, F.col("started_at").alias("transcribe_started_at"), *ends, F.col("total_tokens").alias("embed_total_tokens"), "word_count")
    transcripts = m.select(F.col("job_id").alias("id"), "job_id", "duration_seconds")
    chunks = line.where("l_discount >= 0.08").select(F.col("l_orderkey").alias("transcript_id"), F.col("l_shipdate").alias("created_at"))
    return j, transcripts, chunks, metrics


def _snapshot(spark, sf):
    j, t, c, m = _parts(spark, sf)
    e = roles.pipeline_events(spark, sf)
    log = e.where("stage = 'view'").select(F.lit("runner_availability").alias("stage"), "created_at", F.lit("busy").alias("reason"), "detail")
    control = e.agg(F.lit(False).alias("paused"), F.max("event_id").alias("run_limit"), F.lit("idle").alias("phase"))
    as_of = F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")
    return service.snapshot(j, t, c, m, log, control, as_of)


SNAPSHOT = f"""{JOBS}, {METRICS}, {EVENTS}, {PARTS}, q AS (SELECT *, CASE WHEN status = 'done' THEN updated_at - INTERVAL 1 MINUTE ELSE updated_at END AS finished FROM jobs),
n AS (SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'claimed') AS claimed, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS total_jobs,
  count(*) FILTER (WHERE status = 'done' AND finished > TIMESTAMP '1996-01-01' - INTERVAL 1 HOUR) AS done_last_hour,
  greatest(max(updated_at) FILTER (WHERE status = 'claimed'), max(finished) FILTER (WHERE status = 'done')) AS latest_activity,
  arg_max(claimed_by, {{'a': updated_at, 'b': claimed_by}}) FILTER (WHERE status = 'claimed') AS runner_id, max(updated_at) FILTER (WHERE status = 'claimed') AS last_heartbeat FROM q),
d AS (SELECT regexp_replace(file_path, '/[^/]+$', '') AS d, count(*) FILTER (WHERE status <> 'done') AS o FROM jobs GROUP BY 1),
snap AS (SELECT n.*, n.runner_id IS NOT NULL AS runner_active, (SELECT count(*) FROM tr) AS transcripts, (SELECT sum(duration_seconds)::BIGINT FROM tr) AS total_duration_seconds,
  (SELECT sum(n)::BIGINT FROM k) AS chunks, (SELECT max(created_at) FROM k) AS last_embed_at, (SELECT avg(epoch(finished_at) - epoch(started_at)) FROM metrics) AS avg_processing_seconds,
  (SELECT sum(total_tokens)::BIGINT FROM metrics) AS total_embed_tokens, (SELECT sum(word_count)::BIGINT FROM metrics) AS total_words,
  (SELECT count(*) FROM jobs WHERE status = 'done' AND id NOT IN (SELECT id FROM ev) AND id NOT IN (SELECT transcript_id FROM k)) AS transcribed,
  (SELECT count(*) FROM jobs WHERE status = 'done' AND id IN (SELECT id FROM ev) AND id NOT IN (SELECT transcript_id FROM k)) AS evaluated,
  (SELECT count(*) FROM jobs WHERE status = 'done' AND id IN (SELECT transcript_id FROM k)) AS embedded,
  (SELECT count(*) FROM tr WHERE id NOT IN (SELECT transcript_id FROM k)) AS embed_backlog,
  (SELECT count(*) FROM tr JOIN jobs USING (id) WHERE status = 'done' AND id NOT IN (SELECT transcript_id FROM k) AND id NOT IN (SELECT id FROM ev)) AS eval_backlog,
  (SELECT count(*) FROM jobs WHERE status = 'done' AND id IN (SELECT id FROM ev)) AS eval_coverage_done, (SELECT count(*) FROM d) AS books_total, (SELECT count(*) FROM d WHERE o = 0) AS books_fully_done,
  true AS runner_available_known, (SELECT arg_max(coalesce(detail->>'$.reason', 'busy'), created_at) FROM log WHERE stage = 'view') = 'idle' AS runner_available,
  false AS paused, (SELECT max(event_id) FROM log) AS run_limit, 'idle' AS phase FROM n)"""


@query(f"WITH {SNAPSHOT} SELECT * REPLACE (round(avg_processing_seconds, 3) AS avg_processing_seconds) FROM snap")
def status_snapshot(spark, sf):
    return _snapshot(spark, sf).withColumn("avg_processing_seconds", F.round("avg_processing_seconds", 3))


@query(f"""WITH {SNAPSHOT}, c AS (SELECT *, CASE WHEN done > 0 THEN eval_coverage_done / done ELSE 0.0 END AS coverage FROM snap),
f AS (SELECT *, pending = 0 AND claimed = 0 AND embed_backlog = 0 AND coverage >= 1 AS fully_done FROM c)
SELECT pending, claimed, done, CASE WHEN claimed > 0 THEN 'transcribing' WHEN embed_backlog > 0 THEN 'embedding' WHEN fully_done THEN 'idle' WHEN coverage < 1 THEN 'evaluating' ELSE 'winding-down' END AS activity,
  round(coverage, 6) AS coverage, fully_done, embedded, books_total FROM f""")
def status_json(spark, sf):
    j = service.status_json(_snapshot(spark, sf))
    kind = "struct<queue:struct<pending:bigint,claimed:bigint,done:bigint>,lifecycle:struct<activity:string,coverage:double,fully_done:boolean>,stages:struct<embedded:bigint>,library:struct<books_total:bigint>>"
    s = j.select(F.from_json("status", kind).alias("s"))
    return s.select("s.queue.pending", "s.queue.claimed", "s.queue.done", "s.lifecycle.activity", "s.lifecycle.coverage", "s.lifecycle.fully_done", "s.stages.embedded", "s.library.books_total")


@query(f"""WITH {ROLLUP}, q AS (SELECT 'queue' AS feed, * FROM joined WHERE pending > 0 OR claimed > 0 ORDER BY (claimed > 0) DESC, claimed DESC, pending DESC, last_updated ASC NULLS FIRST, book_dir LIMIT 20),
r AS (SELECT 'activity' AS feed, * FROM joined ORDER BY last_updated DESC NULLS LAST, book_dir LIMIT 12), b AS (SELECT * FROM q UNION ALL SELECT * FROM r WHERE book_dir NOT IN (SELECT book_dir FROM q))
SELECT feed, book_dir, title, author, total, pending, claimed, done, failed, (done * 100 // total)::INTEGER AS done_pct, (SELECT count(*) FROM jobs WHERE jobs.book_dir = b.book_dir) AS tracks, (SELECT min(file_path) FROM jobs WHERE jobs.book_dir = b.book_dir) AS first_track FROM b""")
def feeds(spark, sf):
    f = service.feeds(roles.jobs(spark, sf), roles.metrics(spark, sf), roles.books(spark, sf))
    return f.select("feed", "book_dir", "title", "author", "total", "pending", "claimed", "done", "failed", "done_pct", F.size("tracks").cast("long").alias("tracks"), F.col("tracks")[0]["file_path"].alias("first_track"))


@query(f"""WITH {JOBS}, {METRICS}, {PARTS}, t AS (SELECT * FROM jobs LEFT JOIN k ON k.transcript_id = jobs.id WHERE starts_with(file_path, 'lib/b7/'))
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'claimed') AS claimed, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status = 'done') AS embed_total, count(*) FILTER (WHERE status = 'done' AND n IS NOT NULL) AS embed_done FROM t""")
def book_page(spark, sf):
    j, _, c, _ = _parts(spark, sf)
    counts = c.groupBy(F.col("transcript_id").alias("id")).agg(F.count("*").alias("embed_chunk_count"))
    return service.book_page(j.where(service.in_book(F.col("file_path"), "lib/b7")).join(counts, "id", "left"))


@query("""WITH s AS (SELECT conv_id, list({'i': turn, 'e': turn * 60.0 + 50} ORDER BY turn) AS s FROM conversations GROUP BY 1), t AS (SELECT *, (conv_id * 53 % 700 - 20)::DOUBLE AS t FROM s),
f AS (SELECT conv_id, s, t, CASE WHEN t <= 0 THEN 0 ELSE coalesce(list_position(list_transform(s, lambda x: x.e >= t), true), len(s)) - 1 END AS g FROM t)
SELECT conv_id, greatest(g, 0)::INTEGER AS segment, (greatest(g, 0) // 3)::INTEGER AS page, len(s[greatest(g, 0) // 3 * 3 + 1 : greatest(g, 0) // 3 * 3 + 3])::INTEGER AS shown FROM f""")
def page_by_time(spark, sf):
    c = table(spark, sf, "conversations")
    s = c.groupBy(F.col("conv_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("turn", (F.col("turn") * 60.0 + 50).alias("end")))).alias("segments"))
    p = service.track_page(s, (F.col("id") * 53 % 700 - 20).cast("double"), 3)
    return p.select(F.col("id").alias("conv_id"), "segment", "page", F.size("segments").alias("shown"))


@query(f"""WITH {EVENTS}, s AS (SELECT runner_host AS name, min(event_id) AS position, CASE WHEN min(event_id) % 5 = 0 THEN NULL ELSE 'family' || (min(event_id) % 5) END AS family FROM log GROUP BY 1)
SELECT coalesce(family, 'unknown') AS family, min(position) AS "first", count(*) AS servers, arg_min(name, position) AS first_server FROM s GROUP BY 1""")
def servers_by_family(spark, sf):
    s = roles.pipeline_events(spark, sf).groupBy(F.col("runner_host").alias("name")).agg(F.min("event_id").alias("position"))
    f = service.by_family(s.withColumn("family", F.when(F.col("position") % 5 != 0, F.concat(F.lit("family"), F.col("position") % 5))))
    return f.select("family", "first", F.size("servers").cast("long").alias("servers"), F.col("servers")[0].alias("first_server"))


_TITLED = """b AS (SELECT 'lib/' || c_custkey || ' [B0ABCDEF' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || ']' AS book_dir, c_mktsegment AS author,
  c_name || CASE WHEN c_custkey % 3 = 0 THEN ' [' || (1000000 + c_custkey) || ']' ELSE '' END AS title FROM customer)"""


def _titled(spark, sf):
    c = table(spark, sf, "customer")
    mark = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" ["), (F.col("c_custkey") + 1000000).cast("string"), F.lit("]"))).otherwise("")
    at = F.concat(F.lit("lib/"), "c_custkey", F.lit(" [B0ABCDEF"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit("]"))
    return c.select(at.alias("book_dir"), F.col("c_mktsegment").alias("author"), F.concat("c_name", mark).alias("title"))


@query(f"""WITH {_TITLED} SELECT 'number' AS asked, book_dir FROM b WHERE CASE WHEN contains(title, '[') THEN regexp_extract(title, '\\[([0-9]+)\\]', 1) ELSE regexp_extract(book_dir, '\\[(B0[0-9A-Z]+)\\]', 1) END = 'B0ABCDEF07'
UNION ALL SELECT 'text', book_dir FROM b WHERE contains(lower(trim(author || ' ' || trim(regexp_replace(title, '\\s*\\[[0-9]+\\]', '')))), 'building customer#00000001')
UNION ALL SELECT 'only a number', book_dir FROM b WHERE contains(lower(trim(author || ' ' || trim(regexp_replace(title, '\\s*\\[[0-9]+\\]', '')))), '100000')""".replace("\\\\", "\\"))
def book_candidates(spark, sf):
    b = _titled(spark, sf)
    asked = [("number", "x [b0abcdef07]"), ("text", "Building Customer#00000001"), ("only a number", "100000")]
    found = [service.candidates_for(b, text).select(F.lit(kind).alias("asked"), "book_dir") for kind, text in asked]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"""WITH {JOBS}, {METRICS}, {BOOKS}, q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 2), h AS (SELECT vec_id, {COS} AS s FROM embeddings, q WHERE vec_id <> 2 ORDER BY {COS} DESC, vec_id LIMIT 10),
f AS (SELECT vec_id, s, j.file_path, j.book_dir, (vec_id % 50)::DOUBLE AS start_sec FROM h LEFT JOIN jobs j ON j.id = h.vec_id * 4 + 1),
t AS (SELECT j.book_dir, j.file_path, coalesce(sum(m.duration_seconds) OVER w, 0)::DOUBLE AS o, coalesce(min(CASE WHEN m.duration_seconds > 0 THEN 1 ELSE 0 END) OVER w, 1) AS good, sha256(j.file_path) AS checksum
  FROM jobs j LEFT JOIN metrics m ON j.id = m.job_id WINDOW w AS (PARTITION BY j.book_dir ORDER BY j.file_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT f.*, t.checksum, CASE WHEN good = 1 THEN o END + start_sec AS sec, b.title, b.author, b.series FROM f LEFT JOIN t ON t.file_path = f.file_path LEFT JOIN books b ON b.book_dir = f.book_dir)
SELECT vec_id, trunc(s * 100)::INTEGER AS percent, title, author, series, checksum, sec AS book_sec, CASE WHEN sec IS NOT NULL AND title IS NOT NULL THEN least(floor(sec / 100000), 4)::INTEGER END AS chapter_index, CASE WHEN title IS NULL THEN 0 ELSE 5 END AS total_chapters FROM x""")
def search_context(spark, sf):
    v = table(spark, sf, "embeddings")
    hits = search.similar(v, vector.vector_of(v, "vec_id", 2), scope=F.col("vec_id") != 2, id_col="vec_id").select("vec_id", "similarity", (F.col("vec_id") * 4 + 1).alias("id"))
    j, m = roles.jobs(spark, sf), roles.metrics(spark, sf)
    hits = hits.join(j.select("id", "file_path"), "id", "left").withColumn("start_sec", (F.col("vec_id") % 50).cast("double"))
    tracks = j.join(m, F.col("id") == F.col("job_id"), "left").select("file_path", "duration_seconds", F.sha2("file_path", 256).alias("checksum"))
    chapters = [f"named_struct('index', {i}, 'start_sec', {i * 100000}.0D, 'end_sec', {(i + 1) * 100000 if i < 4 else 0}.0D, 'title', 'c{i}')" for i in range(5)]
    books = roles.books(spark, sf).withColumn("chapters", F.expr(f"array({', '.join(chapters)})"))
    out = service.search_context(hits, tracks, books)
    return out.select("vec_id", "percent", "title", "author", "series", "checksum", "book_sec", "chapter_index", "total_chapters")


@query(f"""WITH {JOBS}, c AS (SELECT l_orderkey AS transcript_id, l_linenumber AS chunk_index, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS id, l_comment_len AS chars, l_quantity AS start_sec FROM (SELECT *, length(l_returnflag || l_linestatus) AS l_comment_len FROM lineitem))
SELECT j.id AS job_id, c.chunk_index, c.id, c.start_sec, c.chars, row_number() OVER (ORDER BY c.chunk_index, c.id)::INTEGER AS place FROM c JOIN jobs j ON j.id = c.transcript_id WHERE starts_with(j.file_path, 'lib/b7/')""")
def track_chunks(spark, sf):
    from pyspark.sql import Window

    line = table(spark, sf, "lineitem")
    c = line.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("chunk_index"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")).alias("id"), F.col("l_quantity").alias("start_sec"), F.char_length(F.concat("l_returnflag", "l_linestatus")).cast("long").alias("chars"))
    j = roles.jobs(spark, sf).where(service.in_book(F.col("file_path"), "lib/b7")).select(F.col("id").alias("job_id"))
    return c.join(j, "job_id").withColumn("place", F.row_number().over(Window.orderBy("chunk_index", "id")))  # the chunks of one book


@query(f"WITH {JOBS} SELECT id FROM jobs WHERE starts_with(file_path, 'lib/b1/')")
def directory_scope(spark, sf):
    return roles.jobs(spark, sf).where(service.in_book(F.col("file_path"), "lib/b1")).select("id")


# ---- runs


@query("""WITH s AS (SELECT conv_id, turn, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: CASE WHEN length(w) % 3 > 0 THEN length(w) / 10.0 END) AS x, trim(text) AS t FROM conversations),
w AS (SELECT conv_id, unnest(x) AS score FROM s WHERE conv_id % 4 > 0), m AS (SELECT conv_id, avg(score) AS mean FROM w GROUP BY 1)
SELECT s.conv_id, round(any_value(m.mean), 6) AS mean, sum(len(x))::BIGINT AS word_count, (sum(length(t)) + count(*) - 1)::BIGINT AS char_count, count(*) AS segment_count FROM s LEFT JOIN m USING (conv_id) GROUP BY 1""".replace("\\\\", "\\"))
def run_statistics(spark, sf):
    score = lambda w: F.when(F.length(w) % 3 > 0, F.length(w) / 10.0)
    c = table(spark, sf, "conversations")
    words = F.transform(tx.words(F.col("text")), lambda w: F.struct(w.alias("word"), F.when(F.col("conv_id") % 4 > 0, score(w)).alias("score")))
    s = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.trim("text").alias("text"), words.alias("words")))).alias("segments"))
    stats = runs.run_statistics(F.col("segments"))
    return s.select("conv_id", F.round(runs.mean_word_confidence(F.col("segments")), 6).alias("mean"), *stats).drop("raw_text")


@query("""SELECT o_custkey AS book, CASE WHEN count(*) FILTER (WHERE o_orderkey % 97 = 0) = 0 THEN sum(o_custkey + o_orderkey % 9)::BIGINT END AS total_tokens, count(*) AS chunk_count, count(*) FILTER (WHERE o_orderkey % 97 = 0) AS failed FROM orders GROUP BY 1""")
def token_totals(spark, sf):
    o = table(spark, sf, "orders")
    tokens = F.when(F.col("o_orderkey") % 97 != 0, F.col("o_custkey") + F.col("o_orderkey") % 9)
    return runs.token_totals(o.select(F.col("o_custkey").alias("book"), tokens.alias("tokens")), "book")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'diarization=true' WHEN 1 THEN 'diarization=false,word_timestamps=true' WHEN 2 THEN NULL ELSE 'context_biasing=true' END AS flags, CASE WHEN event_id % 4 = 1 THEN 'off' END AS reason FROM events""")
def capability_maps(spark, sf):
    raw = F.element_at(F.array(F.lit('{"diarization": true, "x": true}'), F.lit('{"word_timestamps": true, "diarization": false}'), F.lit('{"other": true}'), F.lit('{"context_biasing": true}')), (F.col("event_id") % 4 + 1).cast("int"))
    e = table(spark, sf, "events").select("event_id", runs.flags(raw).alias("m"), runs.reasons(F.when(F.col("event_id") % 4 == 1, F.lit('{"diarization": "off", "y": "z"}')).otherwise(F.lit('{"y": "z"}'))).alias("r"))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return e.select("event_id", told.alias("flags"), F.element_at("r", "diarization").alias("reason"))


@query(f"WITH {METRICS} SELECT job_id, greatest(1, ceil(duration_seconds / 600.0))::BIGINT AS windows FROM metrics")
def window_counts(spark, sf):
    return roles.metrics(spark, sf).select("job_id", runs.window_count(F.col("duration_seconds"), 600.0).alias("windows"))


@query(f"""WITH {JOBS}, {METRICS}, a AS (SELECT id AS job_id, attempts AS audio_bytes FROM jobs WHERE id % 3 = 0), e AS (SELECT job_id, embed_chunks FROM metrics WHERE job_id % 2 = 0),
b AS (SELECT coalesce(job_id, a.job_id) AS job_id, word_count, audio_bytes FROM (SELECT job_id, word_count FROM metrics WHERE job_id % 5 < 3) m FULL JOIN a USING (job_id))
SELECT coalesce(b.job_id, e.job_id) AS job_id, word_count, audio_bytes, embed_chunks FROM b FULL JOIN e ON b.job_id = e.job_id""")
def metric_slices(spark, sf):
    m = roles.metrics(spark, sf)
    audio = roles.jobs(spark, sf).where("id % 3 = 0").select(F.col("id").alias("job_id"), F.col("attempts").alias("audio_bytes"))
    return runs.with_slices(m.where("job_id % 5 < 3").select("job_id", "word_count"), [audio, m.where("job_id % 2 = 0").select("job_id", "embed_chunks")])


@query("""SELECT event_id, nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, '') AS stage, CASE WHEN event_id % 4 < 2 THEN user_id END AS host, CASE WHEN event_id % 4 = 0 THEN event_id END AS n FROM events""")
def event_append(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select("event_id", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("stage"), F.when(F.col("event_id") % 4 < 2, F.col("user_id")).alias("host"), F.when(F.col("event_id") % 4 == 0, F.col("event_id")).alias("n"))
    out = runs.event_rows(rows, ["host", "n"])
    return out.select("event_id", "stage", F.get_json_object("detail", "$.host").cast("long").alias("host"), F.get_json_object("detail", "$.n").cast("long").alias("n"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS known FROM customer")
def queued_probe(spark, sf):
    return runs.known(table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), table(spark, sf, "customer").select("c_custkey"), "c_custkey")


# ---- findings and requeues


@query(f"""WITH {FINDINGS}, {JOBS}, g AS (SELECT id FROM jobs WHERE starts_with(file_path, 'lib/b3/')), k AS (SELECT * FROM findings WHERE transcript_id NOT IN (SELECT id FROM g))
SELECT (SELECT count(*) FROM k) + (SELECT count(*) FROM part) AS kept, (SELECT count(*) FROM findings WHERE transcript_id IN (SELECT id FROM g)) AS removed, (SELECT count(*) FROM k WHERE patch_state = 'proposed') + (SELECT count(*) FROM part) AS proposed""")
def findings_cleared_and_inserted(spark, sf):
    j = roles.jobs(spark, sf).select(F.col("id").alias("transcript_id"), "file_path")
    f = roles.findings(spark, sf).join(j, "transcript_id", "left")
    left, removed = findings.clear(f, service.in_book(F.col("file_path"), "lib/b3"))
    after = findings.insert(left, table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit(0.9).alias("confidence")))
    return after.agg(F.count("*").alias("kept"), F.count_if(F.col("patch_state") == "proposed").alias("proposed")).crossJoin(removed)


@query(f"""WITH {FINDINGS} SELECT id, transcript_id, chunk_index, row_number() OVER (PARTITION BY transcript_id ORDER BY chunk_index, CASE WHEN id % 3 > 0 THEN id % 100 END NULLS LAST, id)::INTEGER AS place FROM findings WHERE patch_state IN ('accepted', 'applied')""")
def correction_overlay(spark, sf):
    from pyspark.sql import Window

    f = roles.findings(spark, sf).withColumn("anchor_offset", F.when(F.col("id") % 3 > 0, F.col("id") % 100))
    w = Window.partitionBy("transcript_id").orderBy("chunk_index", F.asc_nulls_last("anchor_offset"), "id")
    return findings.overlay_of(f).select("id", "transcript_id", "chunk_index", F.row_number().over(w).alias("place"))


@query(f"""WITH {FINDINGS}, f AS (SELECT id, max(patch_state) AS s FROM findings GROUP BY 1), o AS (SELECT *, CASE id // 7 % 3 WHEN 0 THEN 'applied' WHEN 1 THEN 'stale' END AS told FROM f),
r AS (SELECT *, (told = 'applied' AND s = 'accepted') OR (told = 'stale' AND s IN ('proposed', 'accepted', 'applied')) AS ok FROM o)
SELECT id, CASE WHEN ok THEN told ELSE s END AS patch_state, CASE WHEN ok AND told = 'stale' THEN 'gone' END AS stale_reason FROM r""")
def outcomes_marked(spark, sf):
    f = roles.findings(spark, sf).groupBy("id").agg(F.max("patch_state").alias("patch_state"))
    kind = F.floor(F.col("id") / 7) % 3
    told = f.where(kind < 2).select("id", F.when(kind == 0, "applied").otherwise("stale").alias("state"), F.when(kind == 1, "gone").alias("reason"))
    return findings.mark_outcomes(f, told).select("id", "patch_state", "stale_reason")


@query(f"""WITH {FINDINGS}, h AS (SELECT DISTINCT transcript_id, chunk_index FROM findings WHERE patch_state = 'reverted') SELECT DISTINCT l_orderkey AS transcript_id, l_linenumber AS chunk_index,
  l_orderkey % 4 = 0 OR EXISTS (SELECT 1 FROM h WHERE h.transcript_id = l_orderkey AND h.chunk_index = l_linenumber) AS embedding_stale FROM lineitem""")
def chunks_flagged(spark, sf):
    chunks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("transcript_id"), F.col("l_linenumber").alias("chunk_index")).distinct().withColumn("embedding_stale", F.col("transcript_id") % 4 == 0)
    return findings.flagged(chunks, roles.findings(spark, sf).where("patch_state = 'reverted'"))


@query(f"""WITH {FINDINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY original_text, suggested_correction, issue_type ORDER BY confidence DESC, id) AS n FROM findings)
SELECT original_text, suggested_correction, issue_type, count(*) AS findings, max(confidence) AS confidence, least(count(*), 3)::INTEGER AS places, max(transcript_id) FILTER (WHERE n = 1) AS first_place FROM r GROUP BY 1, 2, 3""")
def findings_places(spark, sf):
    g = findings.groups(roles.findings(spark, sf), 3)
    return g.select("original_text", "suggested_correction", "issue_type", "findings", "confidence", F.size("places").alias("places"), F.col("places")[0]["transcript_id"].alias("first_place"))


@query(f"""WITH {JOBS}, p AS (SELECT 'path' AS chosen, id, file_path FROM jobs WHERE contains(lower(file_path), 'b1/t0000') UNION ALL SELECT 'failed', id, file_path FROM jobs WHERE status = 'failed' UNION ALL SELECT 'id', id, file_path FROM jobs WHERE id = 7 UNION ALL SELECT 'directory', id, file_path FROM jobs WHERE book_dir = 'lib/b3')
SELECT chosen, id AS job_id, file_path, 'requeue' AS stage, 'retry' AS event, 'operator requeue (re-transcribe)' AS reason, 'go-monitor' AS runner_host FROM p""")
def requeue_events(spark, sf):
    j = roles.jobs(spark, sf)
    chosen = {"path": pipeline.by_path("B1/t0000"), "failed": pipeline.by_status(), "id": F.col("id") == 7, "directory": pipeline.by_directory("lib/b3")}
    rows = [pipeline.requeue_events(j, c).withColumn("chosen", F.lit(why)) for why, c in chosen.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def _as_of():
    return F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")


@query(f"""WITH {JOBS} SELECT id, CASE WHEN g THEN 'pending' ELSE status END AS status, CASE WHEN g THEN 0 ELSE attempts END AS attempts, CASE WHEN NOT g THEN claimed_by END AS claimed_by,
  CASE WHEN NOT g THEN error END AS error, CASE WHEN g THEN TIMESTAMP '2000-01-01' ELSE updated_at END AS updated_at
FROM (SELECT *, status = 'failed' OR attempts = 2 AS g, CASE WHEN status = 'failed' THEN 'error ' || id END AS error FROM jobs)""")
def requeued_jobs(spark, sf):
    j, m = roles.jobs(spark, sf).withColumn("error", F.when(F.col("status") == "failed", F.concat(F.lit("error "), "id"))), roles.metrics(spark, sf)
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("transcript_id"))
    out = pipeline.requeued(j, m.select(F.col("job_id").alias("id"), "job_id"), c, m, pipeline.by_status() | (F.col("attempts") == 2), _as_of())
    return out["jobs"].select("id", "status", "attempts", "claimed_by", "error", "updated_at")


@query(f"""WITH {JOBS}, s AS (SELECT *, attempts < 3 AS free FROM jobs WHERE status = 'claimed' AND epoch_us(TIMESTAMP '2000-01-01 00:00:00') - epoch_us(updated_at) > 1800000000)
SELECT id AS job_id, file_path, attempts AS attempt, CASE WHEN free THEN 'requeue' ELSE 'fail' END AS stage, CASE WHEN free THEN 'retry' ELSE 'error' END AS event,
  CASE WHEN free THEN 'stale claim recovered (heartbeat expired); retryable' ELSE 'max attempts reached after stale-claim recovery; discarded' END AS reason, 'go-worker' AS runner_host FROM s""")
def recovery_events(spark, sf):
    return pipeline.recovery_events(pipeline.recovered(roles.jobs(spark, sf), _as_of()))


def _requeue_sql(what: str) -> str:
    return f"WITH {JOBS}, g AS (SELECT id FROM jobs WHERE {what})"


@query(_requeue_sql("status = 'failed' OR attempts = 2") + """ SELECT (SELECT count(*) FROM jobs WHERE status = 'pending' OR id IN (SELECT id FROM g)) AS pending, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM g)) AS transcripts,
  (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM g)) AS chunks, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM g)) AS metrics""")
def requeue_all_tables(spark, sf):
    j, m = roles.jobs(spark, sf), roles.metrics(spark, sf)
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("transcript_id"))
    out = pipeline.requeued(j, m.select(F.col("job_id").alias("id"), "job_id"), c, m, pipeline.by_status() | (F.col("attempts") == 2), _as_of())
    n = lambda name, df: df.agg(F.count("*").alias(name))
    return n("pending", out["jobs"].where("status = 'pending'")).crossJoin(n("transcripts", out["transcripts"])).crossJoin(n("chunks", out["chunks"])).crossJoin(n("metrics", out["metrics"]))


@query(f"WITH {JOBS} SELECT l_orderkey AS transcript_id, count(*) AS chunks FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM jobs WHERE contains(lower(file_path), '/b2')) GROUP BY 1")
def reembed(spark, sf):
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("transcript_id"))
    left = pipeline.reembedded(c, roles.jobs(spark, sf).select("id", "file_path"), pipeline.by_path("/B2"))
    return left.groupBy("transcript_id").agg(F.count("*").alias("chunks"))


@query(f"""WITH {EVENTS} SELECT event_id, stage FROM (SELECT *, lag(stage) OVER (ORDER BY created_at, event_id) AS b FROM log) WHERE b IS DISTINCT FROM stage""")
def log_changes(spark, sf):
    return pipeline.changes(roles.pipeline_events(spark, sf), "stage").select("event_id", "stage")


# ---- evaluation


_CHUNKS = """c AS (SELECT conv_id * 1000 + turn AS id, conv_id AS transcript_id, turn::INTEGER AS chunk_index, 'lib/b' || conv_id || '/t.mp3' AS file_path, text FROM conversations)"""


def _chunks(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("transcript_id"), F.col("turn").cast("int").alias("chunk_index"), F.concat(F.lit("lib/b"), "conv_id", F.lit("/t.mp3")).alias("file_path"), (F.col("turn") * 60.0).alias("start_sec"), "text")


def _transcripts(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), (F.col("conv_id") * 2).alias("job_id")).distinct()


@query(f"WITH {_CHUNKS} SELECT id, transcript_id * 2 AS job_id, chunk_index, text FROM c WHERE file_path ILIKE '%B1%' ORDER BY file_path, chunk_index, id LIMIT 200")
def eval_chunks_of_book(spark, sf):
    return evaluation.of_book(_chunks(spark, sf), _transcripts(spark, sf), "B1").select("id", "job_id", "chunk_index", "text")


@query()
def eval_sample(spark, sf):
    return evaluation.sample(_chunks(spark, sf), _transcripts(spark, sf), seed=1).select("id", "job_id", "chunk_index")


@query(f"""WITH {JOBS}, {METRICS} SELECT m.job_id AS id FROM metrics m JOIN jobs j ON j.id = m.job_id WHERE j.status = 'done' AND m.eval_findings = 0""")
def eval_backfill(spark, sf):
    j, t, _, m = _parts(spark, sf)
    return evaluation.unevaluated(j, t.withColumn("created_at", F.lit(0)), m).select("id")


@query()
def judge_run(spark, sf):
    return evaluation.judge(_chunks(spark, sf)).select("chunk_id", "transcript_id", "chunk_index", "original_text", "issue_type", "suggested_correction", "confidence", "patch_state")


@query()
def process_transcripts(spark, sf):
    from sonoshelf.operators import chunking

    def kept(df, tag):  # read by several steps, made once
        at = new_folder(spark, tag)
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    made = kept(chunking.chunk_rows(_spoken(spark, sf), 200), "chunks")
    found = kept(evaluation.judge(made.withColumn("start_sec", F.col("start"))).withColumn("patch_state", F.lit("accepted")), "findings")
    out = evaluation.processed_chunks(made, found)
    done = out["outcomes"].groupBy("state").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("state", "n"))).alias("outcomes"))
    chunks = out["chunks"].select("transcript_id", "chunk_index", F.length("source_text").alias("before"), F.length("text").alias("after"), F.size("embedding").alias("dims"))
    return chunks.crossJoin(done.select(F.coalesce(F.element_at("outcomes", "applied"), F.lit(0)).alias("applied")))


@query()
def resegment_backfill(spark, sf):
    from sonoshelf.operators.chunking import SEGMENT

    whole = F.struct(F.lit(0).alias("id"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), F.lit("").alias("text"), F.lit(None).cast("string").alias("speaker"), "words")
    coarse = _spoken(spark, sf).select("id", F.array(whole.cast(SEGMENT)).alias("segments"))
    return evaluation.resegmented(coarse, apply=True)[1]


# ---- search and sorts on the large table


@query()
def text_topk_documents(spark, sf):
    q = table(spark, sf, "benchmark").where("item_id = 1").first().text
    return search.by_text(table(spark, sf, "documents"), q, limit=20, id_col="doc_id", order="n_chars").select("doc_id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH q AS (SELECT text AS q FROM conversations WHERE conv_id = 3 ORDER BY turn, text LIMIT 1), s AS (SELECT conv_id, turn, {_similarity("text", "q.q")} AS s, text, q.q FROM conversations, q WHERE conv_id % 2 = 1)
SELECT conv_id, turn, round(s, 6) AS similarity FROM s WHERE s >= 0.3 OR text ILIKE '%' || q || '%' ORDER BY s DESC, turn, conv_id LIMIT 20""")
def text_topk_scoped(spark, sf):
    c = table(spark, sf, "conversations")
    q = c.where("conv_id = 3").orderBy("turn", "text").first().text
    return search.by_text(c, q, limit=20, scope=F.col("conv_id") % 2 == 1, id_col="conv_id", order="turn").select("conv_id", "turn", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {ROLLUP}, t AS (SELECT book_dir, row_number() OVER (ORDER BY CASE WHEN trim(coalesce(author, '') || ' ' || coalesce(title, '')) = '' THEN lower(book_dir) ELSE lower(trim(coalesce(author, '') || ' ' || coalesce(title, ''))) END, last_updated DESC NULLS LAST, book_dir)::INTEGER AS by_title,
  row_number() OVER (ORDER BY done / total DESC, last_updated DESC NULLS LAST, book_dir)::INTEGER AS by_progress, row_number() OVER (ORDER BY failed DESC, last_updated DESC NULLS LAST, book_dir)::INTEGER AS by_findings FROM joined)
SELECT * FROM t WHERE by_title <= 30 OR by_progress <= 30 OR by_findings <= 30""")
def library_sorts(spark, sf):
    from pyspark.sql import Window

    rows = library.book_rollup(roles.jobs(spark, sf), roles.metrics(spark, sf)).join(roles.books(spark, sf), "book_dir", "left").withColumn("findings", F.col("failed"))
    place = lambda sort: F.row_number().over(Window.orderBy(*library.library_sort(sort))).alias(f"by_{sort}")
    return rows.select("book_dir", place("title"), place("progress"), place("findings")).where("by_title <= 30 or by_progress <= 30 or by_findings <= 30")


@query(f"""WITH {METRICS}, t AS (SELECT job_id, duration_seconds AS d, duration_seconds * 977 AS n FROM metrics)
SELECT job_id, CASE WHEN d >= 3600 THEN printf('%dh%02dm%02ds', d // 3600, d % 3600 // 60, d % 60) WHEN d >= 60 THEN printf('%dm%02ds', d // 60, d % 60) ELSE printf('%ds', d) END AS hms,
  CASE WHEN d >= 3600 THEN printf('%d:%02d:%02d', d // 3600, d % 3600 // 60, d % 60) ELSE printf('%02d:%02d', d // 60, d % 60) END AS clock, format('{{:,}}', d) AS number,
  CASE WHEN n < 1000000 THEN format('{{:,}}', n) WHEN n < 999950000 THEN printf('%.1fM', n / 1e6) ELSE printf('%.1fB', n / 1e9) END AS compact,
  CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size,
  CASE WHEN d < 3600 THEN '<1h' WHEN d < 172800 THEN printf('~%dh', floor(d / 3600.0 + 0.5)::BIGINT) ELSE printf('~%.1f days', d / 86400.0) END AS rough FROM t""")
def time_and_number_labels(spark, sf):
    from sonoshelf.functions import labels

    d = F.col("duration_seconds")
    return roles.metrics(spark, sf).select(
        "job_id", labels.hms(d.cast("double")).alias("hms"), labels.clock(d.cast("double")).alias("clock"), labels.count(d).alias("number"), labels.compact(d * 977).alias("compact"),
        labels.size(d * 977).alias("size"), labels.rough(d.cast("double")).alias("rough"),
    )


@query("""SELECT p_partkey, 'A ' || p_size AS author, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 0 END::INTEGER AS chapter_index, CASE WHEN p_partkey % 3 = 0 THEN 'ch ' || p_partkey ELSE '' END AS chapter_name FROM part""")
def legacy_paths(spark, sf):
    book = F.concat(F.lit("/m/audiobooks/A "), "p_size", F.lit("/"), "p_name", F.lit(" [B0X]/"))
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" [B0X] - "), "p_size", F.lit(" - ch "), "p_partkey", F.lit(".mp3"))).otherwise("01.mp3")
    return table(spark, sf, "part").select("p_partkey", tx.parsed_path(F.concat(book, name)).alias("p")).select("p_partkey", "p.*")

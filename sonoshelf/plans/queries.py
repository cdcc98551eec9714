"""The registered queries of the library's own operators, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sonoshelf.functions import text as tx
from sonoshelf.operators import chunking, findings, library, overlay, pipeline, search, vector
from sonoshelf.operators import text_index as text_index_of
from sonoshelf.operators import vector_index as vector_index_of
from sonoshelf.session import bound_batches
from sonoshelf.sources.scratch import new_folder

from . import roles
from .catalogue import query, table
from .roles import BOOKS, EVENTS, FINDINGS, JOBS, METRICS

COS = "list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[])"
#: Trigrams of a text column in DuckDB.
TRI = "list_distinct(flatten(list_transform(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: w <> ''), lambda w: '  ' || w || ' '), lambda w: list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)))))"


def _similarity(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({TRI.format(a)}, {TRI.format(b)}))::DOUBLE / nullif(len(list_distinct(list_concat({TRI.format(a)}, {TRI.format(b)}))), 0), 0)"


# ---- search


@query(f"""WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 3)
SELECT vec_id, label, round({COS}, 5) AS similarity FROM embeddings, q WHERE {COS} >= 0.3 ORDER BY {COS} DESC, vec_id LIMIT 50""")
def vector_topk_threshold(spark, sf):
    v = table(spark, sf, "embeddings")
    return search.similar(v, vector.vector_of(v, "vec_id", 3), limit=50, threshold=0.3, id_col="vec_id").select("vec_id", "label", F.round("similarity", 5).alias("similarity"))


@query(f"""WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 5)
SELECT vec_id, label, round({COS}, 5) AS similarity FROM embeddings, q WHERE label = 2 ORDER BY {COS} DESC, vec_id LIMIT 10""")
def vector_topk_scoped(spark, sf):
    v = table(spark, sf, "embeddings")
    return search.similar(v, vector.vector_of(v, "vec_id", 5), scope=F.col("label") == 2, id_col="vec_id").select("vec_id", "label", F.round("similarity", 5).alias("similarity"))


@query()
def ann_buckets(spark, sf):
    v = table(spark, sf, "embeddings")
    return search.near_by_buckets(v, vector.vector_of(v, "vec_id", 0), id_col="vec_id").select("vec_id", "label", F.round("similarity", 5).alias("similarity"))


@query()
def vector_index(spark, sf):
    """The ten nearest of every fiftieth vector by a stored index of all, which a test holds against brute force."""
    v, at = table(spark, sf, "embeddings"), new_folder(spark, "vector-index")
    vector_index_of.build(v, at, id_col="vec_id")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector_index_of.Search(spark, at, asked).hits().select("query_id", "rank", F.col("id").alias("vec_id"), F.round("similarity", 5).alias("similarity"))


@query("""WITH hit AS (SELECT conv_id, turn FROM conversations WHERE role = 'user' AND text ILIKE '%that%')
SELECT c.conv_id, c.turn, c.role, c.text FROM conversations c JOIN hit h ON c.conv_id = h.conv_id AND c.turn BETWEEN greatest(0, h.turn - 1) AND h.turn + 1""")
def chunk_context(spark, sf):
    c = table(spark, sf, "conversations")
    hit = c.where((F.col("role") == "user") & tx.contains_wild(F.col("text"), "that"))
    return search.neighbours(c, hit, 1, "conv_id", "turn").select("conv_id", "turn", "role", "text")


@query(f"""WITH q AS (SELECT text AS q FROM benchmark WHERE item_id = 1), s AS (
  SELECT conv_id, turn, {_similarity("text", "q.q")} AS s FROM conversations, q)
SELECT conv_id, turn, round(s, 6) AS similarity FROM s WHERE s >= 0.3 ORDER BY s DESC, turn, conv_id LIMIT 20""")
def text_topk(spark, sf):
    q = table(spark, sf, "benchmark").where("item_id = 1").first().text
    rows = table(spark, sf, "conversations")
    return search.by_text(rows, q, limit=20, id_col="conv_id", order="turn").select("conv_id", "turn", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH q AS (SELECT text AS q FROM benchmark WHERE item_id = 3), s AS (
  SELECT doc_id, source, text ILIKE '%' || q.q || '%' AS held, {_similarity("text", "q.q")} AS s FROM documents, q)
SELECT doc_id, source, round(s, 6) AS similarity FROM s WHERE s >= 0.3 OR held ORDER BY s DESC, source, doc_id LIMIT 50""")
def text_index(spark, sf):
    """What the trigram scan finds, by a stored index of all documents."""
    d, at = table(spark, sf, "documents"), new_folder(spark, "text-index")
    q = table(spark, sf, "benchmark").where("item_id = 3").first().text
    text_index_of.build(d, at, id_col="doc_id")
    hits = text_index_of.by_index(text_index_of.TextIndex(spark, at), d, q, limit=50, id_col="doc_id", order="source")
    return hits.select("doc_id", "source", F.round("similarity", 6).alias("similarity"))


@query("""SELECT doc_id, source FROM documents WHERE source = 'src3' AND lower(text) LIKE '%th%er%' ORDER BY doc_id""")
def text_ilike_scoped(spark, sf):
    d = table(spark, sf, "documents").where("source = 'src3'")
    return d.where(tx.contains_wild(F.col("text"), "th%er")).orderBy("doc_id").select("doc_id", "source")


@query(f"""WITH q AS (SELECT text AS q FROM benchmark WHERE item_id = 2), s AS (
  SELECT conv_id * 100 + turn AS id, {_similarity("text", "q.q")} AS s FROM conversations, q)
SELECT id, round(s, 6) AS similarity FROM s WHERE s >= 0.2""")
def trigram_index_search(spark, sf):
    q = table(spark, sf, "benchmark").where("item_id = 2").first().text
    rows = table(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 100 + F.col("turn"))
    return search.by_index(search.trigram_index(rows), q, 0.2).select("id", F.round("similarity", 6).alias("similarity"))


@query("""SELECT c.conv_id, c.turn, n.total_chunks FROM conversations c JOIN (SELECT conv_id, count(*) AS total_chunks FROM conversations GROUP BY 1) n USING (conv_id)
WHERE c.role = 'user' AND c.text ILIKE '%the%'""")
def total_chunks_per_hit(spark, sf):
    c = table(spark, sf, "conversations")
    hits = c.where((F.col("role") == "user") & tx.contains_wild(F.col("text"), "the")).select("conv_id", "turn")
    return search.with_totals(hits, c, "conv_id").select("conv_id", "turn", "total_chunks")


@query("""SELECT source AS file_path, count(*) AS chunks FROM documents GROUP BY 1""")
def hierarchical_counts(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("source").alias("file_path")).agg(F.count("*").alias("chunks"))


# ---- library

ROLLUP = f"""{JOBS}, {METRICS}, {BOOKS}, rollup AS (SELECT j.book_dir, count(*) AS total, count(*) FILTER (WHERE status = 'done') AS done,
  count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'claimed') AS claimed, count(*) FILTER (WHERE status = 'failed') AS failed,
  sum(duration_seconds)::BIGINT AS duration_seconds, sum(word_count)::BIGINT AS words, max(updated_at) AS last_updated
  FROM jobs j LEFT JOIN metrics m ON j.id = m.job_id GROUP BY 1),
joined AS (SELECT r.*, b.title, b.author, b.series FROM rollup r LEFT JOIN books b USING (book_dir))"""


def _books_sql(where: str, order: str, page: str) -> str:
    return f"WITH {ROLLUP}, m AS (SELECT *, count(*) OVER () AS matching FROM joined WHERE {where}) SELECT * FROM m ORDER BY {order} {page}"


def _summaries(spark, sf, **how):
    return library.book_summaries(roles.jobs(spark, sf), roles.metrics(spark, sf), roles.books(spark, sf), **how)


@query(_books_sql("true", "done / nullif(total, 0) DESC NULLS LAST, done DESC, last_updated DESC NULLS LAST, book_dir", "LIMIT 20"))
def book_summaries_default(spark, sf):
    return _summaries(spark, sf)


@query(_books_sql("true", "last_updated DESC NULLS LAST, book_dir", "LIMIT 20 OFFSET 20"))
def book_summaries_activity(spark, sf):
    return _summaries(spark, sf, sort="activity", offset=20)


@query(_books_sql("true", "(claimed > 0) DESC, claimed DESC, pending DESC, last_updated ASC NULLS FIRST, book_dir", "LIMIT 50"))
def book_summaries_queue(spark, sf):
    return _summaries(spark, sf, sort="queue", limit=50)


@query(_books_sql("failed > 0", "last_updated DESC NULLS LAST, book_dir", "LIMIT 100"))
def book_summaries_status(spark, sf):
    return _summaries(spark, sf, status="failed", sort="activity", limit=100)


@query(_books_sql("total > 0 AND done = total", "last_updated DESC NULLS LAST, book_dir", "LIMIT 100"))
def book_summaries_complete(spark, sf):
    return _summaries(spark, sf, status="complete", sort="activity", limit=100)


@query(_books_sql("series ILIKE '%Saga 1_ %' AND (book_dir ILIKE '%1%' OR title ILIKE '%1%' OR author ILIKE '%1%')", "last_updated DESC NULLS LAST, book_dir", "LIMIT 40"))
def book_summaries_series(spark, sf):
    return _summaries(spark, sf, series="Saga 1_ ", query="1", sort="activity", limit=40)


@query(f"""WITH {ROLLUP} SELECT count(*) AS books, count(*) FILTER (WHERE total = done) AS complete, count(*) FILTER (WHERE failed > 0) AS with_failures,
  sum(total)::BIGINT AS tracks, sum(done)::BIGINT AS done, sum(duration_seconds)::BIGINT AS duration_seconds, sum(words)::BIGINT AS words FROM rollup""")
def library_totals(spark, sf):
    return library.library_totals(roles.jobs(spark, sf), roles.metrics(spark, sf))


@query(f"""WITH {JOBS}, {METRICS} SELECT id, file_path, status, attempts, word_count, duration_seconds FROM jobs LEFT JOIN metrics ON id = job_id WHERE book_dir = 'lib/b7'""")
def book_tracks(spark, sf):
    return library.book_tracks(roles.jobs(spark, sf), roles.metrics(spark, sf), "lib/b7").select("id", "file_path", "status", "attempts", "word_count", "duration_seconds")


@query("""SELECT l_orderkey AS job_id, l_linenumber AS chunk_index, l_quantity AS start_sec, length(l_returnflag || l_linestatus) AS chars FROM lineitem WHERE l_orderkey = 7""")
def track_detail(spark, sf):
    line = table(spark, sf, "lineitem").where("l_orderkey = 7")
    return line.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("chunk_index"), F.col("l_quantity").alias("start_sec"), F.char_length(F.concat("l_returnflag", "l_linestatus")).cast("long").alias("chars"))


@query(f"WITH {JOBS} SELECT id, status, updated_at FROM jobs ORDER BY updated_at DESC, id LIMIT 15")
def recent_jobs(spark, sf):
    return roles.jobs(spark, sf).orderBy(F.desc("updated_at"), "id").limit(15).select("id", "status", "updated_at")


@query(f"WITH {JOBS} SELECT id, file_path, updated_at FROM jobs WHERE status = 'failed' ORDER BY updated_at DESC, id")
def failed_jobs(spark, sf):
    return roles.jobs(spark, sf).where("status = 'failed'").orderBy(F.desc("updated_at"), "id").select("id", "file_path", "updated_at")


@query(f"WITH {JOBS} SELECT id, file_path FROM jobs WHERE contains(lower(file_path), 'b1/t')")
def find_jobs(spark, sf):
    return roles.jobs(spark, sf).where(tx.contains_exact(F.col("file_path"), "B1/t")).select("id", "file_path")


@query(f"""WITH {JOBS}, {METRICS}, t AS (SELECT j.book_dir, j.file_path, m.duration_seconds FROM jobs j LEFT JOIN metrics m ON j.id = m.job_id),
w AS (SELECT *, sum(CASE WHEN duration_seconds > 0 THEN duration_seconds END) OVER b AS s, min(CASE WHEN duration_seconds > 0 THEN 1 ELSE 0 END) OVER b AS good FROM t
  WINDOW b AS (PARTITION BY book_dir ORDER BY file_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT file_path, CASE WHEN coalesce(good, 1) = 1 THEN coalesce(s, 0)::DOUBLE END AS "offset" FROM w""")
def track_offset_prefix_sum(spark, sf):
    j = roles.jobs(spark, sf).join(roles.metrics(spark, sf), F.col("id") == F.col("job_id"), "left")
    return library.track_offsets(j.withColumn("book_dir", tx.book_dir(F.col("file_path"))), "book_dir", "file_path", "duration_seconds").select("file_path", "offset")


@query("""WITH c AS (SELECT conv_id, list({'i': turn, 's': turn * 60.0, 'e': CASE WHEN turn = 3 THEN 0.0 ELSE turn * 60.0 + 50 END, 't': role} ORDER BY turn) AS chapters FROM conversations GROUP BY 1),
t AS (SELECT conv_id, (conv_id * 37 % 300)::DOUBLE AS t, chapters FROM c), h AS (SELECT conv_id, t, list_filter(chapters, lambda x: x.s <= t) AS f FROM t)
SELECT conv_id, t, CASE WHEN len(f) > 0 AND (f[-1].e = 0 OR t <= f[-1].e + 0.001) THEN f[-1].i END AS chapter FROM h""")
def chapter_asof(spark, sf):
    c = table(spark, sf, "conversations")
    chapter = F.struct(F.col("turn").alias("index"), (F.col("turn") * 60.0).alias("start_sec"), F.when(F.col("turn") == 3, 0.0).otherwise(F.col("turn") * 60.0 + 50).alias("end_sec"), F.col("role").alias("title"))
    by = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(chapter)).alias("chapters")).withColumn("t", (F.col("conv_id") * 37 % 300).cast("double"))
    return by.select("conv_id", "t", library.chapter_at(F.col("chapters"), F.col("t"))["index"].alias("chapter"))


@query(f"""WITH {BOOKS}, p AS (SELECT book_dir, trim(x) AS x FROM (SELECT book_dir, unnest(string_split(series, ',')) AS x FROM books WHERE series IS NOT NULL)),
r AS (SELECT book_dir, trim(CASE WHEN contains(x, '#') THEN regexp_extract(x, '^(.*)#[^#]*$', 1) ELSE x END) AS name, CASE WHEN contains(x, '#') THEN trim(regexp_extract(x, '#([^#]*)$', 1)) ELSE '' END AS sequence FROM p),
a AS (SELECT * FROM r WHERE name <> '' UNION ALL SELECT book_dir, 'No series', '' FROM books WHERE series IS NULL)
SELECT name, sequence, book_dir, row_number() OVER (PARTITION BY name ORDER BY sequence = '', try_cast(sequence AS DOUBLE) IS NULL, try_cast(sequence AS DOUBLE) NULLS FIRST, sequence, book_dir)::INTEGER AS place FROM a""")
def series_members(spark, sf):
    return library.series_members(roles.books(spark, sf))


@query(f"""WITH {ROLLUP} SELECT author, count(*) AS books, sum(total)::BIGINT AS tracks, min(title) AS first_title FROM joined GROUP BY 1""")
def books_by_author(spark, sf):
    rows = library.book_rollup(roles.jobs(spark, sf), roles.metrics(spark, sf)).join(roles.books(spark, sf), "book_dir", "left")
    return rows.groupBy("author").agg(F.count("*").alias("books"), F.sum("total").alias("tracks"), F.min("title").alias("first_title"))


# ---- pipeline


@query(f"""WITH {JOBS} SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'claimed') AS claimed,
  count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS total FROM jobs""")
def job_status_counts(spark, sf):
    return pipeline.status_counts(roles.jobs(spark, sf))


@query(f"""WITH {JOBS}, e AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R'), c AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_discount >= 0.08),
f AS (SELECT status, EXISTS (SELECT 1 FROM e WHERE e.id = j.id) AS e, EXISTS (SELECT 1 FROM c WHERE c.id = j.id) AS c FROM jobs j)
SELECT count(*) FILTER (WHERE status = 'pending') AS waiting, count(*) FILTER (WHERE status = 'claimed') AS running, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status = 'done' AND NOT e AND NOT c) AS transcribed, count(*) FILTER (WHERE status = 'done' AND e AND NOT c) AS evaluated, count(*) FILTER (WHERE status = 'done' AND c) AS embedded FROM f""")
def pipeline_buckets(spark, sf):
    line = table(spark, sf, "lineitem")
    return pipeline.pipeline_buckets(roles.jobs(spark, sf), line.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")), line.where("l_discount >= 0.08").select(F.col("l_orderkey").alias("id")))


@query(f"""WITH {JOBS}, m AS (SELECT max(updated_at) AS now FROM jobs) SELECT count(*) AS done_last_day FROM jobs, m WHERE status = 'done' AND updated_at > now - INTERVAL 1 DAY""")
def done_last_window(spark, sf):
    j = roles.jobs(spark, sf)
    return j.crossJoin(F.broadcast(j.agg(F.max("updated_at").alias("now")))).where("status = 'done' and updated_at > now - interval 1 day").agg(F.count("*").alias("done_last_day"))


@query(f"""WITH {JOBS}, {METRICS} SELECT greatest((SELECT max(updated_at) FROM jobs), (SELECT max(finished_at) FROM metrics)) AS latest""")
def latest_activity(spark, sf):
    a = roles.jobs(spark, sf).agg(F.max("updated_at").alias("a"))
    return a.crossJoin(roles.metrics(spark, sf).agg(F.max("finished_at").alias("b"))).select(F.greatest("a", "b").alias("latest"))


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def embed_backlog(spark, sf):
    return pipeline.backlog(table(spark, sf, "orders"), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").select("o_orderkey")


@query("""SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)""")
def eval_backlog(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")
    return pipeline.backlog(d, table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


def _batch_sql(kind: str) -> str:
    return f"""WITH {JOBS}, e AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R'), c AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_discount >= 0.08)
SELECT id, created_at FROM jobs WHERE status = 'done' AND id NOT IN (SELECT id FROM c) AND id {kind} (SELECT id FROM e) ORDER BY created_at, id LIMIT 32"""


def _batch(spark, sf, want):
    line = table(spark, sf, "lineitem")
    done = roles.jobs(spark, sf).where("status = 'done'")
    return pipeline.next_batch(done, line.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")), line.where("l_discount >= 0.08").select(F.col("l_orderkey").alias("id")), want_evaluated=want).select("id", "created_at")


@query(_batch_sql("IN"))
def evaluated_unembedded(spark, sf):
    return _batch(spark, sf, True)


@query(_batch_sql("NOT IN"))
def unevaluated_unembedded(spark, sf):
    return _batch(spark, sf, False)


@query(f"""WITH {JOBS} SELECT id, created_at FROM jobs j WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = j.id AND l.l_tax >= 0.08) ORDER BY created_at, id LIMIT 32""")
def stale_semi(spark, sf):
    chunks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_tax") >= 0.08).alias("embedding_stale"))
    return pipeline.stale_transcripts(roles.jobs(spark, sf), chunks).select("id", "created_at")


@query(f"""WITH {JOBS}, {METRICS} SELECT count(*) AS evaluated, sum(eval_findings)::BIGINT AS found, round(sum(eval_findings) / sum(embed_chunks), 6) AS a_chunk
FROM jobs JOIN metrics ON id = job_id WHERE status = 'done'""")
def eval_coverage(spark, sf):
    m = roles.jobs(spark, sf).where("status = 'done'").join(roles.metrics(spark, sf), F.col("id") == F.col("job_id"))
    return m.agg(F.count("*").alias("evaluated"), F.sum("eval_findings").alias("found"), F.round(F.sum("eval_findings") / F.sum("embed_chunks"), 6).alias("a_chunk"))


@query(f"""WITH {METRICS} SELECT round(avg(epoch(finished_at) - epoch(started_at)), 3) AS seconds, sum(total_tokens)::BIGINT AS tokens FROM metrics""")
def run_averages(spark, sf):
    return roles.metrics(spark, sf).agg(F.round(F.avg(pipeline.seconds(F.col("finished_at"), F.col("started_at"))), 3).alias("seconds"), F.sum("total_tokens").alias("tokens"))


@query(f"""WITH {EVENTS} SELECT runner_host, count(*) AS events, round(avg(duration), 6) AS avg_duration, max(created_at) AS last_seen,
  arg_max(stage, {{'a': created_at, 'b': event_id}}) AS last_stage, arg_max(duration, {{'a': created_at, 'b': event_id}}) FILTER (WHERE stage = 'purchase') AS last_purchase FROM log GROUP BY 1""")
def host_metrics_latest(spark, sf):
    return pipeline.hosts(roles.pipeline_events(spark, sf)).withColumn("avg_duration", F.round("avg_duration", 6))


@query(f"""WITH {JOBS} SELECT claimed_by, count(*) AS claims, max(updated_at) AS last_beat FROM jobs WHERE status = 'claimed' GROUP BY 1""")
def live_runners(spark, sf):
    return roles.jobs(spark, sf).where("status = 'claimed'").groupBy("claimed_by").agg(F.count("*").alias("claims"), F.max("updated_at").alias("last_beat"))


@query(f"""WITH {EVENTS}, g AS (SELECT runner_host, stage, epoch_us(lead(created_at) OVER w) - epoch_us(created_at) AS gap FROM log WINDOW w AS (PARTITION BY runner_host ORDER BY created_at, event_id)),
s AS (SELECT runner_host, coalesce(sum(CASE WHEN gap > 0 AND stage = 'view' THEN gap ELSE 0 END) / nullif(sum(CASE WHEN gap > 0 THEN gap END), 0), 0) AS a FROM g GROUP BY 1)
SELECT runner_host, round(a, 6) AS available FROM s""")
def availability_fraction(spark, sf):
    return pipeline.availability(roles.pipeline_events(spark, sf), "stage", "runner_host", "view").withColumn("available", F.round("available", 6))


@query(f"""WITH {EVENTS} SELECT event_id, runner_host, stage FROM (SELECT *, lag(stage) OVER (PARTITION BY runner_host ORDER BY created_at, event_id) AS b FROM log) WHERE b IS DISTINCT FROM stage""")
def availability_changes(spark, sf):
    return pipeline.changes(roles.pipeline_events(spark, sf), "stage", "runner_host").select("event_id", "runner_host", "stage")


@query(f"""WITH {EVENTS} SELECT coalesce(detail->>'$.reason', stage) AS reason, coalesce(detail->>'$.reason', stage) = 'view' AS available FROM log ORDER BY created_at DESC, event_id DESC LIMIT 1""")
def availability_latest(spark, sf):
    last = roles.pipeline_events(spark, sf).agg(F.max_by(F.struct("stage", "detail"), F.struct("created_at", "event_id")).alias("l"))
    reason = F.coalesce(F.get_json_object("l.detail", "$.reason"), "l.stage")
    return last.select(reason.alias("reason"), (reason == "view").alias("available"))


@query(f"""WITH {EVENTS} SELECT event_id, coalesce((detail->>'$.k')::BIGINT, -1) AS k, coalesce(detail->>'$.reason', stage, '') AS reason FROM log""")
def json_reason_fallback(spark, sf):
    e = roles.pipeline_events(spark, sf)
    return e.select("event_id", F.coalesce(F.get_json_object("detail", "$.k").cast("long"), F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("detail", "$.reason"), "stage", F.lit("")).alias("reason"))


@query(f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY created_at DESC, event_id DESC) AS n FROM log WHERE stage IN ('view', 'click', 'error')),
m AS (SELECT quantile_cont(duration, 0.5) FILTER (WHERE stage = 'view') AS transcribe, quantile_cont(duration, 0.5) FILTER (WHERE stage = 'click') AS embed, quantile_cont(duration, 0.5) FILTER (WHERE stage = 'error') AS evaluate FROM r WHERE n <= 50),
g AS (SELECT stage, epoch_us(lead(created_at) OVER (PARTITION BY runner_host ORDER BY created_at, event_id)) - epoch_us(created_at) AS gap FROM log),
a AS (SELECT coalesce(sum(CASE WHEN stage = 'view' THEN gap ELSE 0 END) / sum(gap), 0) AS available FROM g WHERE gap > 0), c AS (SELECT count(*) AS chunks FROM orders WHERE o_orderstatus = 'P')
SELECT round(transcribe, 6) AS transcribe, round(embed, 6) AS embed, round(evaluate, 6) AS evaluate, chunks, round(available, 6) AS available, round(chunks * (transcribe + embed + evaluate), 3) AS work,
  round(chunks * (transcribe + embed + evaluate) / nullif(available, 0), 3) AS calendar FROM m, c, a""")
def eta_rates_median(spark, sf):
    log = roles.pipeline_events(spark, sf)
    r = pipeline.rates(log, {"transcribe": "view", "embed": "click", "evaluate": "error"})
    c = roles.jobs(spark, sf).where("status = 'pending'").agg(F.count("*").alias("chunks"))
    out = pipeline.time_left(r.crossJoin(c).crossJoin(pipeline.overall_availability(log, "stage", "runner_host", "view")))
    return out.select(*[F.round(x, 6).alias(x) for x in ("transcribe", "embed", "evaluate", "available")], "chunks", F.round("work", 3).alias("work"), F.round("calendar", 3).alias("calendar"))


@query(f"""WITH {JOBS}, s AS (SELECT *, status = 'claimed' AND epoch_us(TIMESTAMP '2000-01-01 00:00:00') - epoch_us(updated_at) > 1800000000 AS stale FROM jobs)
SELECT id, stale, CASE WHEN NOT stale THEN status WHEN attempts < 3 THEN 'pending' ELSE 'failed' END AS status,
  CASE WHEN NOT (stale AND attempts < 3) THEN claimed_by END AS claimed_by, CASE WHEN stale AND attempts >= 3 THEN 'max attempts reached' END AS error, updated_at FROM s""")
def stale_claim_recovery(spark, sf):
    return pipeline.recovered(roles.jobs(spark, sf), F.lit("2000-01-01 00:00:00").cast("timestamp")).select("id", "stale", "status", "claimed_by", "error", "updated_at")


@query(f"WITH {JOBS} SELECT id, created_at FROM jobs WHERE status = 'pending' AND attempts < 3 ORDER BY created_at, id LIMIT 5")
def claim_next(spark, sf):
    return pipeline.claimable(roles.jobs(spark, sf), 5).select("id", "created_at")


@query("""WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_id FROM events, m WHERE NOT (event_type IN ('view', 'click') AND ts < now - INTERVAL 10 DAY)""")
def retention_prune(spark, sf):
    e = table(spark, sf, "events")
    now = F.broadcast(e.agg(F.max("ts").alias("now")))
    return e.crossJoin(now).where("not (event_type in ('view', 'click') and ts < now - interval 10 days)").select("event_id")


@query("""WITH p AS (SELECT o_custkey AS file_path, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'claimed' ELSE 'pending' END AS status, o_orderdate AS created_at, o_orderkey AS id FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY CASE status WHEN 'done' THEN 0 WHEN 'claimed' THEN 1 ELSE 2 END, created_at, id) AS n FROM p)
SELECT file_path, status, id FROM r WHERE n = 1""")
def dedup_keep_best(spark, sf):
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "claimed").otherwise("pending")
    return pipeline.keep_best(o.select(F.col("o_custkey").alias("file_path"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("id"))).select("file_path", "status", "id")


@query("""WITH o AS (SELECT c_custkey AS k, c_name AS title, c_mktsegment AS narrator, 'old' AS source FROM customer WHERE c_acctbal > 0),
n AS (SELECT c_custkey AS k, upper(c_name) AS title, CASE WHEN c_custkey % 2 = 0 THEN 'new' END AS narrator, 'never' AS source FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.title ELSE o.title END AS title, coalesce(n.narrator, o.narrator) AS narrator, coalesce(o.source, n.source) AS source FROM o FULL JOIN n ON o.k = n.k""")
def upsert_coalesce(spark, sf):
    c = table(spark, sf, "customer")
    old = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("narrator"), F.lit("old").alias("source"))
    new = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("k"), F.upper("c_name").alias("title"), F.when(F.col("c_custkey") % 2 == 0, "new").alias("narrator"), F.lit("never").alias("source"))
    return pipeline.upsert(old, new, ["k"], ["title"], ["narrator"])


@query("""WITH e AS (SELECT o_orderkey AS path, o_custkey AS checksum FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT o_orderkey AS path, o_custkey * 2 AS checksum FROM orders),
a AS (SELECT * FROM n WHERE path NOT IN (SELECT path FROM e) AND checksum NOT IN (SELECT checksum FROM e)),
r AS (SELECT *, row_number() OVER (PARTITION BY checksum ORDER BY path) AS k FROM a) SELECT path, checksum FROM r WHERE k = 1""")
def insert_if_absent(spark, sf):
    o = table(spark, sf, "orders")
    old = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("checksum"))
    new = o.select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") * 2).alias("checksum"))
    return pipeline.insert_if_absent(old, new, ["path", "checksum"])


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def anti_difference(spark, sf):
    queued = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(queued, "c_custkey", "left_anti")


@query("""SELECT host, kind, count(*) AS n FROM (SELECT 'host' || (o_custkey % 7) AS host, 'live' AS kind FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'host' || user_id, 'historic' FROM events) GROUP BY ALL""")
def union_views(spark, sf):
    live = roles.jobs(spark, sf).where("status in ('claimed', 'failed')").select(F.col("claimed_by").alias("host"), F.lit("live").alias("kind"))
    past = roles.pipeline_events(spark, sf).select(F.col("runner_host").alias("host"), F.lit("historic").alias("kind"))
    return live.unionByName(past).groupBy("host", "kind").agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT o_custkey AS job, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'claimed' ELSE 'pending' END AS status, epoch_us(o_orderdate) * 1000 + o_orderkey AS moment FROM orders),
l AS (SELECT *, lag(status) OVER (PARTITION BY job ORDER BY moment) AS prev FROM h)
SELECT job, CASE WHEN arg_max(status, moment) = 'done' THEN max(moment) FILTER (WHERE status = 'done' AND prev IS DISTINCT FROM 'done') END AS completed_at FROM l GROUP BY 1""")
def completed_at_fold(spark, sf):
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "claimed").otherwise("pending")
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000 + F.col("o_orderkey")
    return pipeline.completed_at(o.select(F.col("o_custkey").alias("job"), status.alias("status"), at.alias("at")))


@query(f"""WITH {JOBS}, g AS (SELECT id FROM jobs WHERE book_dir IN ('lib/b3', 'lib/b4')) SELECT j.id, CASE WHEN g.id IS NULL THEN j.status ELSE 'pending' END AS status, CASE WHEN g.id IS NULL THEN j.attempts ELSE 0 END AS attempts FROM jobs j LEFT JOIN g USING (id)""")
def requeue_by_dir(spark, sf):
    j = roles.jobs(spark, sf)
    m = roles.metrics(spark, sf)
    t = m.select(F.col("job_id").alias("id"), "job_id")
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("transcript_id"))
    return pipeline.requeued(j, t, c, m, tx.book_dir(F.col("file_path")).isin("lib/b3", "lib/b4"), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))["jobs"].select("id", "status", "attempts")


@query(f"""WITH {JOBS}, {EVENTS}, tok(t) AS (VALUES ('host2'), ('T1'), ('gpu')), l AS (SELECT 'runner-' || claimed_by AS name, max(updated_at) AS last_seen FROM jobs WHERE status = 'claimed' GROUP BY 1),
h AS (SELECT 'host' || (substr(runner_host, 5)::BIGINT % 12) AS name, count(*) AS jobs, max(created_at) AS last_seen FROM log GROUP BY 1),
ht AS (SELECT h.*, t FROM h JOIN tok ON contains(lower(h.name), lower(t))), lt AS (SELECT l.*, t FROM l JOIN tok ON contains(lower(l.name), lower(t))),
c AS (SELECT t AS server, true AS configured, (SELECT arg_max(name, last_seen) FROM lt WHERE lt.t = tok.t) AS live, (SELECT arg_max(name, last_seen) FROM ht WHERE ht.t = tok.t) AS host,
  coalesce((SELECT sum(jobs) FROM ht WHERE ht.t = tok.t), 0)::BIGINT AS jobs, coalesce((SELECT max(last_seen) FROM lt WHERE lt.t = tok.t), (SELECT max(last_seen) FROM ht WHERE ht.t = tok.t)) AS last_seen FROM tok),
hl AS (SELECT * FROM h WHERE name NOT IN (SELECT name FROM ht)), ll AS (SELECT * FROM l WHERE name NOT IN (SELECT name FROM lt)),
u AS (SELECT ll.name AS server, false AS configured, ll.name AS live, hl.name AS host, coalesce(hl.jobs, 0) AS jobs, ll.last_seen FROM ll LEFT JOIN hl ON contains(ll.name, hl.name))
SELECT * FROM c UNION ALL SELECT * FROM u UNION ALL SELECT name, false, NULL, name, jobs, last_seen FROM hl WHERE name NOT IN (SELECT host FROM u WHERE host IS NOT NULL)""")
def server_view(spark, sf):
    live = roles.jobs(spark, sf).where("status = 'claimed'").groupBy(F.concat(F.lit("runner-"), "claimed_by").alias("name")).agg(F.max("updated_at").alias("last_seen"))
    e = roles.pipeline_events(spark, sf).withColumn("name", F.concat(F.lit("host"), F.substr("runner_host", F.lit(5)).cast("long") % 12))
    return pipeline.server_view(["host2", "T1", "gpu"], live, e.groupBy("name").agg(F.count("*").alias("jobs"), F.max("created_at").alias("last_seen")))


# ---- findings


@query(f"""WITH {FINDINGS} SELECT count(*) AS findings, count(DISTINCT transcript_id) AS transcripts, round(avg(confidence), 6) AS mean, min(confidence) AS lowest, max(confidence) AS highest,
  count(*) FILTER (WHERE confidence >= 0.8) AS high, count(*) FILTER (WHERE confidence >= 0.4 AND confidence < 0.8) AS medium, count(*) FILTER (WHERE confidence < 0.4) AS low FROM findings""")
def findings_totals(spark, sf):
    return findings.totals(roles.findings(spark, sf))


@query(f"WITH {FINDINGS} SELECT issue_type, count(*) AS findings, round(avg(confidence), 6) AS mean FROM findings GROUP BY 1")
def findings_by_issue(spark, sf):
    return findings.by_issue(roles.findings(spark, sf))


@query(f"""WITH {FINDINGS}, {JOBS}, f AS (SELECT j.book_dir, f.* FROM findings f JOIN jobs j ON f.transcript_id = j.id), c AS (SELECT book_dir, issue_type, count(*) AS n, max(confidence) AS h FROM f GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY book_dir ORDER BY n DESC, issue_type) AS k FROM c)
SELECT book_dir, sum(n)::BIGINT AS findings, max(h) AS highest, max(issue_type) FILTER (WHERE k = 1) AS top_issue FROM r GROUP BY 1""")
def findings_by_book_mode(spark, sf):
    j = roles.jobs(spark, sf).select(F.col("id").alias("transcript_id"), tx.book_dir(F.col("file_path")).alias("book_dir"))
    return findings.by_book(roles.findings(spark, sf).join(j, "transcript_id"), "book_dir")


@query(f"WITH {FINDINGS}, {JOBS} SELECT f.id, j.file_path, f.confidence FROM findings f LEFT JOIN jobs j ON f.transcript_id = j.id ORDER BY f.confidence DESC, j.file_path, f.start_sec, f.id LIMIT 200")
def findings_list(spark, sf):
    j = roles.jobs(spark, sf).select(F.col("id").alias("transcript_id"), "file_path")
    return roles.findings(spark, sf).join(j, "transcript_id", "left").orderBy(F.desc("confidence"), "file_path", "start_sec", "id").limit(200).select("id", "file_path", "confidence")


@query(f"""WITH {FINDINGS} SELECT original_text, suggested_correction, issue_type, count(*) AS findings, max(confidence) AS confidence, min(id) AS first_id FROM findings WHERE confidence >= 0.6 GROUP BY 1, 2, 3""")
def findings_groups(spark, sf):
    return findings.worklist(roles.findings(spark, sf), floor=findings.FLOOR)


@query(f"""WITH {FINDINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY transcript_id, chunk_index % 2 ORDER BY confidence DESC, id) AS n FROM findings) SELECT id, transcript_id, confidence FROM r WHERE n <= 2""")
def findings_topn_per_chunk(spark, sf):
    f = roles.findings(spark, sf).withColumn("chunk_index", F.col("chunk_index") % 2)
    return findings.top_per_chunk(f, 2).select("id", "transcript_id", "confidence")


@query("""WITH c AS (SELECT doc_id AS id, doc_id // 4 AS transcript_id, (doc_id % 4)::INTEGER AS chunk_index, text FROM documents),
f AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS chunk_id, doc_id // 4 AS transcript_id, (doc_id % 5)::INTEGER AS chunk_index FROM labels)
SELECT f.id, length(c.text) AS chars FROM f LEFT JOIN c ON c.id = f.chunk_id OR (f.chunk_id IS NULL AND c.transcript_id = f.transcript_id AND c.chunk_index = f.chunk_index)""")
def corrections_or_join(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    place = F.floor(F.col("doc_id") / 4)
    chunks = d.select(F.col("doc_id").alias("id"), place.alias("transcript_id"), (F.col("doc_id") % 4).cast("int").alias("chunk_index"), "text")
    found = lab.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("chunk_id"), place.alias("transcript_id"), (F.col("doc_id") % 5).cast("int").alias("chunk_index"))
    return findings.with_chunk(found, chunks).select("id", F.length("chunk_text").cast("long").alias("chars"))


@query(f"""WITH {FINDINGS}, legal(a, b) AS (VALUES ('proposed', 'accepted'), ('proposed', 'rejected'), ('proposed', 'stale'), ('accepted', 'applied'), ('accepted', 'rejected'), ('accepted', 'stale'),
  ('applied', 'reverted'), ('applied', 'stale'), ('rejected', 'proposed'), ('reverted', 'proposed')),
f AS (SELECT id, max(patch_state) AS patch_state FROM findings GROUP BY 1),
d AS (SELECT *, CASE WHEN id % 5 = 0 THEN 'accepted' ELSE patch_state END AS expected, (['proposed', 'accepted', 'applied', 'rejected', 'reverted', 'stale'])[id // 5 % 6 + 1] AS state FROM f)
SELECT id, CASE WHEN patch_state = expected AND EXISTS (SELECT 1 FROM legal WHERE a = d.patch_state AND b = d.state) THEN state ELSE patch_state END AS patch_state FROM d""")
def decisions_applied(spark, sf):
    f = roles.findings(spark, sf).groupBy("id").agg(F.max("patch_state").alias("patch_state"))
    state = F.element_at(F.array(*map(F.lit, roles.STATES)), (F.floor(F.col("id") / 5) % 6 + 1).cast("int"))
    d = f.select("id", F.when(F.col("id") % 5 == 0, "accepted").otherwise(F.col("patch_state")).alias("expected"), state.alias("state"), F.lit(0).alias("at"))
    return findings.decide(f, d).select("id", "patch_state")


@query(f"""WITH {FINDINGS}, h AS (SELECT DISTINCT transcript_id, chunk_index FROM findings WHERE decided_at > TIMESTAMP '2001-01-01' OR (patch_state = 'accepted' AND confidence >= 0.9)),
c AS (SELECT l_orderkey AS transcript_id, l_linenumber AS chunk_index, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT c.transcript_id, c.chunk_index, h.transcript_id IS NOT NULL AS embedding_stale FROM c LEFT JOIN h USING (transcript_id, chunk_index)""")
def stale_cleared_by_watermark(spark, sf):
    f = roles.findings(spark, sf).withColumn("patch_state", F.when((F.col("patch_state") == "accepted") & (F.col("confidence") < 0.9), "applied").otherwise(F.col("patch_state")))
    chunks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("transcript_id"), F.col("l_linenumber").alias("chunk_index")).distinct().withColumn("embedding_stale", F.lit(True))
    return findings.clear_stale(chunks, f, F.lit("2001-01-01").cast("timestamp_ntz"))


# ---- text


@query("""SELECT page_id, regexp_replace(url, '/[^/]+$', '') AS dir, string_split(url, '/')[-1] AS base FROM pages""")
def page_dirs(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", tx.book_dir(F.col("url")).alias("dir"), tx.basename(F.col("url")).alias("base"))


@query(r"""WITH p AS (SELECT page_id, 'Book [' || CASE WHEN page_id % 3 = 0 THEN 'b0abcdef' || lpad((page_id % 100)::VARCHAR, 2, '0') WHEN page_id % 3 = 1 THEN (1000000 + page_id)::VARCHAR ELSE 'x' END || ']' AS t FROM pages)
SELECT page_id, nullif(regexp_extract(upper(t), '\[((?:B0[0-9A-Z]{8})|(?:[0-9]{6,}))\]', 1), '') AS asin FROM p""")
def asin_extract(spark, sf):
    inner = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("b0abcdef"), F.lpad((F.col("page_id") % 100).cast("string"), 2, "0"))).when(F.col("page_id") % 3 == 1, (F.col("page_id") + 1000000).cast("string")).otherwise("x")
    return table(spark, sf, "pages").select("page_id", tx.asin(F.concat(F.lit("Book ["), inner, F.lit("]"))).alias("asin"))


_SUFFIX = (" - Part {0}", " CD{0}", " – Disc {0}", "_vol {0}", " Volume {0}", " chp{0}", " — {0}", "")


@query(r"""WITH p AS (SELECT p_partkey, 'lib/x/' || CASE WHEN p_partkey % 11 = 0 THEN lpad((p_partkey % 90)::VARCHAR, 2, '0') ELSE p_name || replace(([' - Part {0}', ' CD{0}', ' – Disc {0}', '_vol {0}', ' Volume {0}', ' chp{0}', ' — {0}', ''])[p_partkey % 8 + 1], '{0}', p_size::VARCHAR) END || '.mp3' AS path FROM part),
b AS (SELECT p_partkey, regexp_replace(string_split(path, '/')[-1], '\.[^.]*$', '') AS base FROM p),
t AS (SELECT p_partkey, base, rtrim(trim(regexp_replace(base, '(?i)[\s_]*[-–—]?[\s_]*(track|part|chapter|chp|pt|disc|cd|vol|volume)?[\s_]*\d+\s*$', '')), ' -–—_') AS t FROM b)
SELECT p_partkey, CASE WHEN t = '' THEN trim(base) ELSE t END AS title FROM t""")
def title_from_path(spark, sf):
    p = table(spark, sf, "part")
    ends = F.element_at(F.array(*map(F.lit, _SUFFIX)), (F.col("p_partkey") % 8 + 1).cast("int"))
    name = F.concat("p_name", F.replace(ends, F.lit("{0}"), F.col("p_size").cast("string")))
    bare = F.lpad((F.col("p_partkey") % 90).cast("string"), 2, "0")
    path = F.concat(F.lit("lib/x/"), F.when(F.col("p_partkey") % 11 == 0, bare).otherwise(name), F.lit(".mp3"))
    return p.select("p_partkey", tx.title_from_path(path).alias("title"))


@query("""SELECT page_id, contains(lower(url), 'page=2&') AS hit FROM pages""")
def like_escape(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.col("url").ilike("%" + tx.like_escape("page=2&") + "%").alias("hit"))


@query("""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::BIGINT AS words, length(text) AS chars, sha256(text) AS hash FROM documents""".replace("\\\\", "\\"))
def word_count_char_count(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.word_count(F.col("text")).alias("words"), F.char_length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("hash"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^\p{L}\p{Nd}]+', ' ', 'g')) AS normal FROM conversations""")
def normalize_compare(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.normalised(F.col("text")).alias("normal"))


@query()
def snippet_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.snippet(F.col("text"), "the", 120).alias("snippet"))


@query("""SELECT doc_id, (i - 1)::INTEGER AS pos, substr(text, (i - 1) * 500 + 1, 500) AS chunk FROM (SELECT doc_id, text, unnest(range(1, ceil(length(text) / 500)::BIGINT + 1)) AS i FROM documents)""")
def char_chunks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.char_chunks(F.col("text"), 500)).alias("pos", "chunk"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, (i - 1)::INTEGER AS pos, array_to_string(w[(i - 1) * 100 + 1 : i * 100], ' ') AS chunk FROM (SELECT doc_id, w, unnest(range(1, ceil(len(w) / 100)::BIGINT + 1)) AS i FROM w)""")
def word_chunks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.word_chunks(F.col("text"), 100)).alias("pos", "chunk"))


@query()
def token_chunks(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(chunking.token_chunks("text", F.lit(64))).alias("pos", "chunk"))


def _spoken(spark, sf):
    """Conversations as word-timed transcripts: words of a turn follow each other, turns lie two seconds apart."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.posexplode(tx.words(F.col("text"))).alias("pos", "word"))
    start = F.col("turn") * 60.0 + F.col("pos") * 0.3
    w = F.struct("word", start.alias("start"), (start + 0.25).alias("end"), F.col("role").alias("speaker"))
    return c.groupBy(F.col("conv_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("turn", "pos", w.alias("w")))).alias("x")).select("id", F.transform("x", lambda x: x["w"]).alias("words"))


# words of a conversation, three a second; turns stand for speakers' turns of 20 s that overlap by 2 s
@query("""WITH w AS (SELECT conv_id, turn * 1000 + pos AS word_id, turn * 60.0 + pos * 0.3 AS s, turn * 60.0 + pos * 0.3 + 0.25 AS e FROM (
  SELECT conv_id, turn, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda v: v <> '') AS x FROM conversations))),
t AS (SELECT conv_id, turn * 3 + k AS turn, role || k AS speaker, turn * 60.0 + k * 18.0 AS s, turn * 60.0 + k * 18.0 + 20.0 AS e FROM conversations, range(3) r(k))
SELECT w.conv_id, w.word_id::BIGINT AS word_id, arg_min(t.speaker, t.turn) AS speaker FROM w LEFT JOIN t ON w.conv_id = t.conv_id AND (w.s + w.e) / 2 BETWEEN t.s AND t.e GROUP BY 1, 2""")
def midpoint_speakers(spark, sf):
    c = table(spark, sf, "conversations")
    w = c.select("conv_id", "turn", F.posexplode(tx.words(F.col("text"))).alias("pos", "word"))
    start = F.col("turn") * 60.0 + F.col("pos") * 0.3
    w = w.select("conv_id", (F.col("turn") * 1000 + F.col("pos")).alias("word_id"), start.alias("start"), (start + 0.25).alias("end"))
    t = c.select("conv_id", "role", "turn", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    begins = F.col("turn") * 60.0 + F.col("k") * 18.0
    t = t.select("conv_id", (F.col("turn") * 3 + F.col("k")).alias("turn"), begins.alias("start"), (begins + 20.0).alias("end"), F.concat("role", "k").alias("speaker"))
    return chunking.speakers_by_midpoint(w, t, "conv_id")


@query()
def words_to_segments(spark, sf):
    bound_batches(spark)
    s = _spoken(spark, sf).select("id", F.explode(chunking.to_segments("words")).alias("s"))
    return s.select(F.col("id").alias("conv_id"), F.col("s.id").alias("segment"), F.round("s.start", 3).alias("start"), F.round("s.end", 3).alias("end"), "s.text", "s.speaker")


@query()
def segment_chunks(spark, sf):
    c = chunking.chunk_rows(_spoken(spark, sf), 200)
    return c.select("transcript_id", "chunk_index", "id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text", "speaker")


@query()
def window_stitch(spark, sf):
    w = F.explode("words").alias("w")
    windows = _spoken(spark, sf).select("id", w).select("id", "w", F.explode(F.array(F.floor(F.col("w.start") / 55), F.greatest(F.lit(0), F.floor((F.col("w.start") - 5) / 55)))).alias("window")).distinct()
    moved = windows.select("id", "window", F.struct("w.word", (F.col("w.start") - F.col("window") * 55).alias("start"), (F.col("w.end") - F.col("window") * 55).alias("end")).alias("w"))
    by = moved.groupBy(F.col("id").cast("string").alias("file"), F.col("window").cast("int").alias("window")).agg(F.sort_array(F.collect_list(F.struct("w.start", "w.word", "w.end"))).alias("words"))
    return chunking.stitch(by, 60.0, 5.0).select("file", "word", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"))


@query()
def overlay_replay(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("transcript_id"), F.col("turn").cast("int").alias("chunk_index"), "text")
    w = c.select("transcript_id", "chunk_index", "text", F.posexplode(tx.words(F.col("text"))).alias("pos", "span")).where("pos % 7 = 3 and length(span) > 3")
    p = w.select("transcript_id", "chunk_index", (F.col("transcript_id") * 100_000 + F.col("chunk_index") * 1000 + F.col("pos")).alias("id"), "span", F.upper("span").alias("correction"), F.sha2("text", 256).alias("sha256"), F.lit(None).cast("int").alias("offset"), F.lit(0).alias("occurrence"))
    out = overlay.corrected(c, p)
    return out.select("transcript_id", "chunk_index", "text", F.size("applied").alias("applied"), F.size(F.map_keys("stale")).alias("stale"))


@query()
def manual_edits(spark, sf):
    """The first word of each turn edited by hand, beside corrections of every seventh word, some of them for another text:
    recorded where they fit."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("transcript_id"), F.col("turn").cast("int").alias("chunk_index"), "text", F.lit(None).cast("string").alias("source_text"), F.lit(False).alias("embedding_stale"))
    w = c.select("transcript_id", "chunk_index", "text", F.posexplode(tx.words(F.col("text"))).alias("pos", "span"))
    number = F.col("transcript_id") * 100_000 + F.col("chunk_index") * 1000 + F.col("pos")
    w = w.select("transcript_id", "chunk_index", "pos", number.alias("id"), "span", F.upper("span").alias("correction"), F.when(number % 3 > 0, F.sha2("text", 256)).otherwise("old").alias("sha256"), F.lit(None).cast("int").alias("offset"), F.lit(0).alias("occurrence"))
    edits, others = w.where("pos = 0").withColumn("sha256", F.lit(None).cast("string")).drop("pos"), w.where("pos % 7 = 0 and id % 2 = 0").drop("pos")
    plan = overlay.planned_edits(edits.withColumn("occurrence", F.when(F.col("id") % 5 > 0, 0)), c, others)
    found = spark.createDataFrame([], "id long, transcript_id long, chunk_index int, original_text string, suggested_correction string, anchor_offset int, anchor_occurrence int, model string, origin string, patch_state string, confidence double")
    recorded, flagged = overlay.record_edits(found, plan, edits, c, F.lit("2000-01-01").cast("timestamp"))
    out = plan.join(recorded.select("id", "original_text", "suggested_correction", "anchor_offset", "model", "origin", "patch_state", "confidence"), "id", "left")
    return out.join(flagged.select("transcript_id", "chunk_index", "embedding_stale"), ["transcript_id", "chunk_index"]).select("id", "status", "start", "occurrence", "preview", F.size(F.map_keys("stale")).alias("stale"), "original_text", "suggested_correction", "anchor_offset", "model", "origin", "patch_state", "confidence", "embedding_stale")


@query("""WITH l AS (SELECT event_id, user_id, ts, lag(ts) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, sum(CASE WHEN epoch_us(ts) - epoch_us(b) > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS session FROM l""")
def gap_sessions(spark, sf):
    e = table(spark, sf, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return chunking.gap_sessions(e, "user_id", "s", "s", 6 * 3600.0, "event_id").select("event_id", "user_id", "session")


@query("""WITH l AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS run FROM l)
SELECT user_id, run, any_value(event_type) AS speaker, count(*) AS turns FROM r GROUP BY 1, 2""")
def speaker_runs(spark, sf):
    return chunking.speaker_runs(table(spark, sf, "events"), "user_id", "event_id", "event_type")


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type DESC) AS k FROM n) SELECT user_id, event_type AS speaker, n AS turns FROM r WHERE k = 1""")
def dominant_speaker(spark, sf):
    return chunking.dominant_speaker(table(spark, sf, "events"), "user_id", "event_type")


@query("""SELECT date_trunc('hour', ts) AS start, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1""")
def throughput_by_hour(spark, sf):
    from sonoshelf.streaming.jobs import throughput

    e = table(spark, sf, "events").withColumn("created_at", F.col("ts").cast("timestamp"))
    return throughput(e, "view").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT * FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INTEGER AS place FROM documents) WHERE place <= 3""")
def longest_per_book(spark, sf):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf, "documents").withColumn("place", F.row_number().over(w)).where("place <= 3").select("doc_id", "source", "place")


# ---- status and metadata


@query(f"""WITH {JOBS}, e AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R'), k AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_discount >= 0.08),
n AS (SELECT count(*) FILTER (WHERE status = 'pending') AS p, count(*) FILTER (WHERE status = 'claimed') AS c, count(*) FILTER (WHERE status = 'done') AS d,
  count(*) FILTER (WHERE status = 'done' AND id NOT IN (SELECT id FROM k)) AS b, count(*) FILTER (WHERE status = 'done' AND id IN (SELECT id FROM e)) AS ev FROM jobs),
s(scene, paused, evaluates, phase, running, waiting, behind, judged) AS (VALUES ('as is', false, true, 'idle', 1, 1, 1, 0), ('paused', true, true, 'idle', 1, 1, 1, 0), ('transcribe', false, true, 'transcribe', 0, 0, 1, 0),
  ('analyze', false, true, 'analyze', 0, 1, 1, 0), ('embed', false, true, 'idle', 0, 1, 1, 0), ('judge', false, true, 'idle', 0, 0, 0, 0), ('wind', false, true, 'idle', 0, 1, 0, 1), ('done', false, true, 'idle', 0, 0, 0, 1), ('no judge', false, false, 'idle', 0, 0, 0, 0)),
v AS (SELECT scene, paused, evaluates, phase, p * waiting AS pending, c * running AS claimed, d AS done, b * behind AS backlog, CASE WHEN judged = 1 THEN d ELSE ev END AS ev FROM s, n),
w AS (SELECT *, CASE WHEN NOT evaluates THEN -1.0 WHEN done > 0 THEN ev / done ELSE 0.0 END AS coverage FROM v),
x AS (SELECT *, pending = 0 AND claimed = 0 AND backlog = 0 AND (NOT evaluates OR coverage >= 1) AS fully_done, phase IN ('transcribe', 'analyze') AS committed FROM w)
SELECT scene, round(coverage, 6) AS coverage, committed, fully_done, CASE WHEN paused THEN 'paused' WHEN claimed > 0 OR phase = 'transcribe' THEN 'transcribing' WHEN phase = 'analyze' THEN 'evaluating' WHEN backlog > 0 THEN 'embedding'
  WHEN fully_done AND NOT committed THEN 'idle' WHEN evaluates AND coverage < 1 THEN 'evaluating' ELSE 'winding-down' END AS activity FROM x""")
def pipeline_lifecycle(spark, sf):
    from sonoshelf.operators.status import lifecycle

    line, j = table(spark, sf, "lineitem"), roles.jobs(spark, sf)
    b = pipeline.pipeline_buckets(j, line.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")), line.where("l_discount >= 0.08").select(F.col("l_orderkey").alias("id")))
    judged = j.where("status = 'done'").join(line.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")), "id", "left_semi").agg(F.count("*").alias("ev"))
    scenes = [("as is", False, True, "idle", 1, 1, 1, 0), ("paused", True, True, "idle", 1, 1, 1, 0), ("transcribe", False, True, "transcribe", 0, 0, 1, 0), ("analyze", False, True, "analyze", 0, 1, 1, 0), ("embed", False, True, "idle", 0, 1, 1, 0),
              ("judge", False, True, "idle", 0, 0, 0, 0), ("wind", False, True, "idle", 0, 1, 0, 1), ("done", False, True, "idle", 0, 0, 0, 1), ("no judge", False, False, "idle", 0, 0, 0, 0)]
    s = spark.createDataFrame(scenes, "scene string, paused boolean, evaluates boolean, phase string, r int, w int, b int, j int")
    counts = b.crossJoin(judged).select(F.col("waiting").alias("n_p"), F.col("running").alias("n_c"), F.expr("transcribed + evaluated + embedded").alias("done"), F.expr("transcribed + evaluated").alias("n_b"), "ev")
    stats = counts.crossJoin(F.broadcast(s)).select(
        "scene", "paused", "evaluates", "phase", "done", F.expr("n_p * w").alias("pending"), F.expr("n_c * r").alias("claimed"), F.expr("n_b * b").alias("embed_backlog"),
        F.expr("if(j = 1, done, ev)").alias("evaluated"), F.lit(False).alias("probed"), F.lit(False).alias("probe_active"),
    )
    return lifecycle(stats).select("scene", F.round("coverage", 6).alias("coverage"), "committed", "fully_done", "activity")


@query(f"""WITH {JOBS}, {METRICS}, b AS (SELECT count(*) AS backlog FROM jobs WHERE id NOT IN (SELECT job_id FROM metrics)), l AS (SELECT max(finished_at) AS last FROM metrics)
SELECT backlog, last, backlog >= 10 AND epoch_us(TIMESTAMP '2030-01-01') - epoch_us(last) > 600000000 AS stalled FROM b, l""")
def stall_detection(spark, sf):
    from sonoshelf.operators.status import stalled

    m = roles.metrics(spark, sf)
    left = pipeline.backlog(roles.jobs(spark, sf), m.select(F.col("job_id").alias("id")), "id")
    return stalled(left, m.select(F.col("finished_at").alias("created_at")), F.lit("2030-01-01").cast("timestamp_ntz"))


_WORDS = r"""list_filter(regexp_split_to_array(coalesce({0}, ''), '[\s\-/\\()\[\]:,.''"]+'), lambda w: w <> '')"""
_NOUNS = "list_filter({0}, lambda w: length(w) >= 3 AND regexp_matches(w, '^\\p{{Lu}}') AND NOT list_contains(c.common, lower(w)))"


def _named_sql(column: str) -> str:
    w, n = _WORDS.format(column), _NOUNS.format(_WORDS.format(column))
    return f"list_concat({n}, CASE WHEN len({n}) > 0 AND len({w}) > 1 THEN [array_to_string({w}, ' ')] ELSE [] END)"


@query(f"""WITH {BOOKS}, c AS (SELECT string_split('a an the in on at to of for by up as or if it its is be do no and but nor yet so i me my we us our he him his she her they them their you your am are was were has have had does did will would could should may might must can get got this that these those not all one two new also just then than with from into what who how when where why', ' ') AS common),
m AS (SELECT book_dir, author || ' O''Hara-Jones Jr.' AS author, CASE WHEN substr(book_dir, 6)::BIGINT % 3 = 0 THEN 'the end of Ed' END AS narrator, series, title || ': The MAN who Was (Thursday)' AS title FROM books),
a AS (SELECT book_dir, list_concat(list_concat(list_concat({_named_sql("author")}, {_named_sql("narrator")}), {_named_sql("series")}), {_NOUNS.format(_WORDS.format("title"))}) AS x FROM m, c)
SELECT book_dir, array_to_string(list_filter(x, lambda y, i: list_position(list_transform(x, lambda z: lower(z)), lower(y)) = i), '|') AS terms FROM a""")
def bias_terms(spark, sf):
    from sonoshelf.functions.bias import bias_terms as of

    b = roles.books(spark, sf)
    narrator = F.when(F.substr("book_dir", F.lit(6)).cast("long") % 3 == 0, "the end of Ed")
    terms = of(F.concat("author", F.lit(" O'Hara-Jones Jr.")), narrator, F.col("series"), F.concat("title", F.lit(": The MAN who Was (Thursday)")))
    return b.select("book_dir", F.array_join(terms, "|").alias("terms"))


@query(f"""WITH {ROLLUP}, f AS (SELECT book_dir, sum(CASE WHEN r.l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS n FROM jobs j JOIN lineitem r ON r.l_orderkey = j.id GROUP BY 1)
SELECT book_dir, total, done, coalesce(n, 0) AS findings, count(*) OVER () AS matching FROM rollup LEFT JOIN f USING (book_dir) WHERE coalesce(n, 0) > 0 ORDER BY findings DESC, book_dir LIMIT 50""")
def library_page_by_findings(spark, sf):
    j = roles.jobs(spark, sf)
    found = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"))
    by = j.join(found, "id").groupBy(tx.book_dir(F.col("file_path")).alias("book_dir")).agg(F.sum("n").alias("findings"))
    rows = library.book_rollup(j, roles.metrics(spark, sf)).select("book_dir", "total", "done").join(by, "book_dir")
    page = rows.orderBy(F.desc("findings"), "book_dir").limit(50)
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("matching"))))


@query(f"""WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 1), h AS (SELECT vec_id, label, {COS} AS s FROM embeddings, q ORDER BY s DESC, vec_id LIMIT 10)
SELECT vec_id, trunc(s * 100) AS percent, d.source AS book, len(list_filter(regexp_split_to_array(d.text, '\\s+'), lambda w: w <> ''))::BIGINT AS words FROM h LEFT JOIN documents d ON d.doc_id = h.vec_id""".replace("\\\\", "\\"))
def search_enriched(spark, sf):
    v = table(spark, sf, "embeddings")
    hits = search.similar(v, vector.vector_of(v, "vec_id", 1), id_col="vec_id")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source")
    context = docs.join(F.broadcast(hits.select("vec_id")), "vec_id", "left_semi")
    out = hits.join(context, "vec_id", "left").withColumn("percent", (F.col("similarity") * 100).cast("int").cast("double"))
    return out.select("vec_id", "percent", F.col("source").alias("book"), tx.word_count(F.col("text")).alias("words"))


@query("""WITH p AS (SELECT conv_id, list({'turn': turn, 'role': role} ORDER BY turn)[2:4] AS page, count(*) AS segments FROM conversations GROUP BY 1),
u AS (SELECT conv_id, segments, unnest(page) AS s FROM p) SELECT conv_id, segments, s.turn AS turn, s.role AS role FROM u""")
def transcript_page(spark, sf):
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("s"), F.count("*").alias("segments"))
    return t.select("conv_id", "segments", F.inline(library.page_of(F.col("s"), 1, 3)))


@query("""WITH c AS (SELECT conv_id AS transcript_id, turn::INTEGER AS chunk_index, text FROM conversations),
f AS (SELECT l_orderkey * 10 + l_linenumber AS k, round(l_discount * 10, 1) AS confidence, (['proposed', 'accepted', 'applied', 'rejected', 'reverted', 'stale'])[l_partkey % 6 + 1] AS patch_state, l_orderkey % 97 AS transcript_id, (l_linenumber - 1)::INTEGER AS chunk_index, l_quantity AS start_sec,
  CASE l_returnflag WHEN 'A' THEN 'and' WHEN 'R' THEN 'thher' ELSE 'the' END AS span, ((l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey) AS id FROM lineitem),
p AS (SELECT * FROM f WHERE confidence >= 0.6 AND patch_state = 'proposed' ORDER BY confidence DESC, transcript_id, start_sec, id LIMIT 200),
j AS (SELECT p.*, c.text, CASE WHEN c.text IS NULL THEN NULL ELSE (length(c.text) - length(replace(c.text, span, ''))) // length(span) END AS n FROM p LEFT JOIN c USING (transcript_id, chunk_index))
SELECT id, confidence, patch_state, CASE WHEN n = 1 THEN (strpos(text, span) - 1)::INTEGER END AS start,
  CASE WHEN text IS NULL THEN 'no chunk' WHEN n = 1 THEN 'unique' WHEN n = 0 THEN 'not found' ELSE 'ambiguous' END AS status,
  CASE WHEN n = 1 THEN substr(text, greatest(strpos(text, span) - 1 - 220, 0) + 1, least(length(text), strpos(text, span) - 1 + length(span) + 220) - greatest(strpos(text, span) - 1 - 220, 0)) ELSE substr(text, 1, 600) END AS context FROM j""")
def corrections_page(spark, sf):
    from sonoshelf.operators.corrections import corrections

    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("transcript_id"), F.col("turn").cast("int").alias("chunk_index"), "text")
    span = F.when(F.col("l_returnflag") == "A", "and").when(F.col("l_returnflag") == "R", "thher").otherwise("the")
    f = roles.findings(spark, sf).select("id", "confidence", "patch_state", (F.col("transcript_id") % 97).alias("transcript_id"), (F.col("chunk_index") - 1).alias("chunk_index"), "start_sec", F.col("issue_type").alias("l_returnflag"))
    f = f.select("*", span.alias("original_text"), F.lit(None).cast("long").alias("chunk_id"), F.lit(None).cast("int").alias("anchor_offset"))
    return corrections(f, c, states=["proposed"], floor=findings.FLOOR, limit=200).select("id", "confidence", "patch_state", "start", "status", "context")


@query(f"""WITH {JOBS}, {EVENTS}, e AS (SELECT DISTINCT l_orderkey AS id FROM lineitem)
SELECT 'jobs' AS metric, status AS label, count(*)::DOUBLE AS value FROM jobs GROUP BY 2 UNION ALL SELECT 'backlog', '', count(*)::DOUBLE FROM jobs WHERE id NOT IN (SELECT id FROM e)
UNION ALL SELECT 'coverage', '', round(avg(CASE WHEN id IN (SELECT id FROM e) THEN 1 ELSE 0 END), 6) FROM jobs UNION ALL SELECT 'events', runner_host, count(*)::DOUBLE FROM log GROUP BY 2""")
def monitor_gauges(spark, sf):
    from sonoshelf.operators.status import gauges

    j = roles.jobs(spark, sf)
    rows = gauges(j, j, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")), roles.pipeline_events(spark, sf))
    return rows.withColumn("value", F.round("value", 6))

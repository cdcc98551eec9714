"""Words to segments, segments to chunks, windows to one transcript.

Cuts by characters and words are Column functions. Those whose limits start anew after each cut are folds over one
transcript's array: Arrow UDFs from array to array, so the rows stay as parallel as the table is. Their batches are
bounded by bytes, as a transcript may have very many words.
"""

from __future__ import annotations

import uuid
from collections import Counter
from itertools import pairwise, takewhile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoshelf.functions.text import words
from sonoshelf.session import bound_batches

GAP_S, MOST_S, MOST_WORDS, TOKENS = 0.6, 30.0, 80, 512
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "sonoshelf/chunks")
WORD = T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("speaker", T.StringType())])
SEGMENT = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("speaker", T.StringType()), T.StructField("words", T.ArrayType(WORD))])
CHUNK = T.StructType([T.StructField("chunk_index", T.IntegerType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("speaker", T.StringType())])


def char_chunks(text: Column, size: int) -> Column:
    """Pieces of size characters; none of an empty text."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def word_chunks(text: Column, size: int) -> Column:
    """Pieces of size words joined by single spaces; none of an empty text."""

    def pieces(w: Column) -> Column:
        n = F.ceil(F.size(w) / size).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i * size + 1, F.lit(size)), " "))).otherwise(F.array().cast("array<string>"))

    # the words are bound as a lambda's argument, so they are split once and not for each piece
    return F.transform(F.array(words(text)), pieces)[0]


def simple_tokens(text: str) -> list[str]:
    """A deterministic stand-in for a vocabulary: words with the space before them, and punctuation marks."""
    import re

    return re.findall(r"\s*(?:\w+|[^\w\s])", text)


def pack_tokens(text: str, size: int, tokens=simple_tokens) -> list[str]:
    """Pieces of size tokens, trimmed, without overlap; an empty text is one empty piece."""
    found = tokens(text)
    return ["".join(found[i : i + size]).strip() for i in range(0, len(found), size)] or [""]


@F.pandas_udf(T.ArrayType(T.StringType()))
def token_chunks(text: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([pack_tokens(t or "", int(n)) for t, n in zip(text, size, strict=True)])


def chunk_uuid(transcript: str, index: int, namespace: uuid.UUID = NAMESPACE) -> str:
    """The same id for the same place of a transcript, whenever it is made."""
    return str(uuid.uuid5(namespace, f"{transcript}/{index}"))


def chunk_id(transcript: Column, index: Column | str) -> Column:
    """chunk_uuid as a Column, so that rows needn't reach Python for it: the SHA-1 of namespace and name, with the marks of
    version 5. An unknown transcript is called None."""
    name = F.concat(F.coalesce(transcript, F.lit("None")), F.lit("/"), (F.col(index) if isinstance(index, str) else index).cast("string"))
    digest = F.sha1(F.concat(F.lit(NAMESPACE.bytes), F.encode(name, "UTF-8")))
    part = lambda start, n: F.substring(digest, start, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def clean_words(found: list[dict]) -> list[dict]:
    """Words in order of time; a repeat of the word before that starts before that one's end goes."""
    out: list[dict] = []
    for w in sorted(found, key=lambda w: (w["start"], w["end"])):
        if out and w["word"] == out[-1]["word"] and w["start"] < out[-1]["end"]:
            continue
        out.append(w)
    return out


def segments_of(found: list[dict]) -> list[dict]:
    """Segments cut at gaps over 0.6 s, at another speaker where both are known, and once they have 30 s or 80 words."""
    out: list[list[dict]] = []
    for w in clean_words(found):
        cur = out[-1] if out else None
        other = cur and w["speaker"] is not None and cur[-1]["speaker"] is not None and w["speaker"] != cur[-1]["speaker"]
        if cur and not other and w["start"] - cur[-1]["end"] <= GAP_S and cur[-1]["end"] - cur[0]["start"] < MOST_S and len(cur) < MOST_WORDS:
            cur.append(w)
        else:
            out.append([w])
    return [
        {"id": k, "start": s[0]["start"], "end": s[-1]["end"], "text": " ".join(w["word"].strip() for w in s), "speaker": dominant([w["speaker"] for w in s]), "words": s}
        for k, s in enumerate(out)
    ]


def dominant(speakers: list) -> str | None:
    """The most frequent speaker, the greatest name of equals; None if there is none."""
    counts = Counter(s for s in speakers if s)
    return max(counts, key=lambda s: (counts[s], s)) if counts else None


def _distinct(values: pa.Array) -> tuple[list, np.ndarray]:
    """The different values and each place's number among them, -1 for null."""
    coded = pc.dictionary_encode(values)
    return coded.dictionary.to_pylist(), coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _cuts(starts: list, ends: list, words: list, speakers: list) -> tuple[list[int], list[int]]:
    """Places of the words that stay and where among those segments begin, of one transcript's words in order of time;
    words and speakers are numbers, an unknown speaker is negative. The rules are those of segments_of."""
    kept, begins = [], []
    for i, start in enumerate(starts):
        if kept:
            last, first = kept[-1], kept[begins[-1]]
            if words[i] == words[last] and start < ends[last]:
                continue
            other = speakers[i] >= 0 and speakers[last] >= 0 and speakers[i] != speakers[last]
            if other or start - ends[last] > GAP_S or ends[last] - starts[first] >= MOST_S or len(kept) - begins[-1] >= MOST_WORDS:
                begins.append(len(kept))
        else:
            begins.append(0)
        kept.append(i)
    return kept, begins


def segment_lists(found: pa.Array, words: bool = True) -> pa.Array:
    """segments_of for a batch of lists of words, on Arrow's columns: no word becomes an object of its own. Without words
    it is what chunks are made of."""
    flat, sizes = found.flatten(), pc.list_value_length(found).fill_null(0).to_numpy(zero_copy_only=False)
    start, end = (pc.struct_field(flat, c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
    word, speaker = (_distinct(pc.struct_field(flat, c)) for c in ("word", "speaker"))
    order = np.lexsort((end, start, np.repeat(np.arange(len(sizes)), sizes)))
    at, kept, begins, rows = 0, [np.empty(0, np.int64)], [np.empty(0, np.int64)], [0]
    base = 0
    for n in sizes.tolist():
        mine = order[at : at + n]
        stay, cuts = _cuts(start[mine].tolist(), end[mine].tolist(), word[1][mine].tolist(), speaker[1][mine].tolist())
        kept.append(mine[np.asarray(stay, np.int64)])
        begins.append(np.asarray(cuts, np.int64) + base)
        rows.append(rows[-1] + len(cuts))
        at, base = at + n, base + len(stay)
    kept, begins = np.concatenate(kept), np.concatenate(begins)
    bounds = np.append(begins, len(kept)).astype(np.int32)
    stripped = pa.array([w.strip() for w in word[0]], pa.string()).take(pa.array(word[1][kept]))
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), stripped), " ")
    codes, names = speaker[1][kept], speaker[0]
    said = []
    for a, b in pairwise(bounds.tolist()):
        only = codes[a] if (codes[a:b] == codes[a]).all() else None
        said.append(dominant([names[k] if k >= 0 else None for k in (codes[a:b].tolist() if only is None else [only])]))
    numbers = np.arange(len(begins)) - np.repeat(np.asarray(rows[:-1], np.int64), np.diff(rows))
    columns = [pa.array(numbers.astype(np.int32)), pa.array(start[kept[bounds[:-1]]]), pa.array(end[kept[bounds[1:] - 1]]), text, pa.array(said, pa.string())]
    if words:
        columns.append(pa.ListArray.from_arrays(pa.array(bounds), flat.take(pa.array(kept))))
    return pa.ListArray.from_arrays(pa.array(np.asarray(rows, np.int32)), pa.StructArray.from_arrays(columns, SEGMENT.names[: len(columns)]))


@F.arrow_udf(T.ArrayType(SEGMENT))
def _to_segments(found: pa.Array) -> pa.Array:
    return segment_lists(found)


def to_segments(found: Column | str) -> Column:
    """Segments of an array of words, as segments_of has them; none of a null one."""
    bound_batches()
    return _to_segments(found)


def pack_segments(segments: list[dict], size: int = TOKENS, tokens=simple_tokens) -> list[dict]:
    """Chunks of whole segments with at most size tokens, unless one segment alone has more. The tokens of joined
    texts are counted piece by piece, as the tokens of the stand-in don't reach over a joint."""
    out, cur, n = [], [], 0

    def flush() -> None:
        text = " ".join(s["text"] for s in cur)
        if cur and text:
            out.append({"chunk_index": len(out), "start": cur[0]["start"], "end": cur[-1]["end"], "text": text, "speaker": dominant([s["speaker"] for s in cur])})

    for s in segments:
        k = len(tokens(s["text"]))
        if cur and n + k > size:
            flush()
            cur, n = [], 0
        cur.append(s)
        n += k
    flush()
    return out


def _chunk_lists(segments: pa.Array, size: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("chunk_index", pa.int32()), ("start", pa.float64()), ("end", pa.float64()), ("text", pa.string()), ("speaker", pa.string())]))
    return pa.array((pack_segments(x.as_py() or [], n.as_py()) for x, n in zip(segments, size, strict=True)), kind)


@F.arrow_udf(T.ArrayType(CHUNK))
def _to_chunks(segments: pa.Array, size: pa.Array) -> pa.Array:
    return _chunk_lists(segments, size)


@F.arrow_udf(T.ArrayType(CHUNK))
def _words_to_chunks(found: pa.Array, size: pa.Array) -> pa.Array:
    return _chunk_lists(segment_lists(found, words=False), size)


def to_chunks(segments: Column | str, size: Column) -> Column:
    """Chunks of an array of segments; their words stay behind."""
    bound_batches()
    return _to_chunks(without_words(segments), size)


def words_to_chunks(found: Column | str, size: Column) -> Column:
    """to_chunks of to_segments in one worker, so segments don't go from it to the JVM and to another."""
    bound_batches()
    return _words_to_chunks(found, size)


def without_words(segments: Column | str) -> Column:
    """What chunks are made of."""
    column = F.col(segments) if isinstance(segments, str) else segments
    return F.transform(column, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["speaker"].alias("speaker")))


def chunk_rows(transcripts: DataFrame, size: int = TOKENS) -> DataFrame:
    """(transcript_id, chunk_index, id, start, end, text, speaker) of transcripts (id, segments), or of (id, words)."""
    bound_batches(transcripts.sparkSession)
    made = to_chunks("segments", F.lit(size)) if "segments" in transcripts.columns else words_to_chunks("words", F.lit(size))
    c = transcripts.select(F.col("id").alias("transcript_id"), F.explode(made).alias("c")).select("transcript_id", "c.*")
    return c.withColumn("id", chunk_id(F.col("transcript_id").cast("string"), "chunk_index"))


SEAM_S = 0.25


def advancing(rows: list[dict]) -> list[dict]:
    """Entries that start after the last one kept and don't repeat one that was kept within SEAM_S seconds of starts."""
    kept: list[dict] = []
    for r in rows:
        if kept and r["start"] <= kept[-1]["start"]:
            continue
        near = takewhile(lambda k: r["start"] - k["start"] <= SEAM_S, reversed(kept))  # starts ascend, so no others are near
        if not any(k["word"] == r["word"] for k in near):
            kept.append(r)
    return kept


def stitch(windows: DataFrame, length: float = 600.0, overlap: float = 15.0) -> DataFrame:
    """(file, word, start, end) of overlapping windows (file, window, words): each keeps what starts in its core, times
    move to the file's, ends aren't before starts, and entries must go forward and not repeat a near one.

    An entry over SEAM_S seconds after all before it is kept whatever they are, so only runs of nearer entries are
    folded, each on its own; the entries that stand alone don't leave the JVM."""
    step, half = length - overlap, overlap / 2
    top = F.max("window").over(Window.partitionBy("file"))
    w = windows.withColumn("last", top).select("file", "window", "last", F.posexplode("words").alias("pos", "w"))
    low, high = F.when(F.col("window") > 0, half).otherwise(0.0), F.when(F.col("window") < F.col("last"), length - half).otherwise(float("inf"))
    w = w.where((F.col("w.start") >= low) & (F.col("w.start") < high))
    start = F.col("w.start") + F.col("window") * step
    w = w.select("file", "window", "pos", F.col("w.word").alias("word"), start.alias("start"), F.greatest(start, F.col("w.end") + F.col("window") * step).alias("end"))
    order = Window.partitionBy("file").orderBy("window", "pos")
    before = F.max("start").over(order.rowsBetween(Window.unboundedPreceding, -1))
    w = w.withColumn("alone", F.coalesce(F.col("start") > before + SEAM_S, F.lit(True)))
    w = w.withColumn("run", F.sum(F.col("alone").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("more", F.count("*").over(Window.partitionBy("file", "run")) > 1)

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        kept = advancing(rows.sort_values(["window", "pos"]).to_dict("records"))
        return pd.DataFrame(kept, columns=rows.columns)[["file", "word", "start", "end"]]

    # neighbouring runs share a group, which keeps groups few and changes nothing, as no run reaches another
    folded = w.where("more").drop("alone", "more").groupBy("file", F.floor(F.col("run") / 256)).applyInPandas(join, "file string, word string, start double, end double")
    return w.where("not more").select(F.col("file").cast("string").alias("file"), "word", "start", "end").unionByName(folded)


def gap_sessions(rows: DataFrame, by: str, start: str, end: str, gap_s: float, order: str) -> DataFrame:
    """rows with session: a new one where more than gap_s lie between an end and the next start."""
    w = Window.partitionBy(by).orderBy(start, order)
    new = F.col(start) - F.lag(end).over(w) > gap_s
    return rows.withColumn("session", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def speaker_runs(turns: DataFrame, group: str, order: str, speaker: str) -> DataFrame:
    """(group, run, speaker, turns): neighbouring turns of one speaker."""
    w = Window.partitionBy(group).orderBy(order)
    change = (~F.lag(speaker).over(w).eqNullSafe(F.col(speaker))).cast("int")
    runs = turns.withColumn("run", F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(group, "run").agg(F.first(speaker).alias("speaker"), F.count("*").alias("turns"))


def dominant_speaker(turns: DataFrame, group: str, speaker: str) -> DataFrame:
    """The speaker with the most turns of each group, the greatest name of equals."""
    n = turns.groupBy(group, speaker).agg(F.count("*").alias("n"))
    return n.groupBy(group).agg(F.max(F.struct("n", speaker)).alias("m")).select(group, F.col(f"m.{speaker}").alias("speaker"), F.col("m.n").alias("turns"))


#: Seconds of a bucket of the midpoint join.
BUCKET_S = 60.0


def speakers_by_midpoint(found: DataFrame, turns: DataFrame, by: str, bucket_s: float = BUCKET_S) -> DataFrame:
    """(by, word_id, speaker): words (by, word_id, start, end) with the speaker of the first turn (by, turn, start, end,
    speaker) around their middle, both ends included; null if there is none.

    Time is cut into buckets; a turn stands in each bucket that it reaches into and a word in that of its middle, so they
    meet by file and bucket, and no file's words meet all its turns. A turn without an end, or that ends before it starts,
    holds no word; so does one with a null file."""
    whole = turns.where(F.col(by).isNotNull() & (F.col("end") >= F.col("start")) & (F.col("end") < float("inf")) & (F.col("start") > float("-inf")))
    span = F.sequence(F.floor(F.col("start") / bucket_s), F.floor(F.col("end") / bucket_s))
    t = whole.select(F.col(by).alias("_by"), F.explode(span).alias("_bucket"), "turn", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("speaker").alias("_speaker"))
    w = found.select(by, "word_id", ((F.col("start") + F.col("end")) / 2).alias("_mid")).withColumn("_at", F.floor(F.col("_mid") / bucket_s))
    hit = w.join(t, (F.col(by) == F.col("_by")) & (F.col("_at") == F.col("_bucket")) & F.col("_mid").between(F.col("_s"), F.col("_e")), "left")
    return hit.groupBy(by, "word_id").agg(F.min_by("_speaker", "turn").alias("speaker"))

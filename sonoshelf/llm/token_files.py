"""Token ids in ORC: integer run-length encoded stripes with row indexes and a Bloom filter on the document id.

Documents are dealt into ranges of ascending id and sorted; each range is encoded in order into one file, whose
rows carry the number of ids before them in that file. A document's start is that plus the sizes of the files
before, so readers need no sort: they read stripes in parallel, and a lookup by id skips stripes by their index.

Encoding is by strings between spaces: the vocabulary's rules never look across white space, so the ids of a text are
those of its words, and each different word of a batch is encoded once. The file's added tokens (<|endoftext|>,
<|startoftext|>) get their own ids wherever they stand in the text as written, as in the library with the file as
loaded: a string is cut at them before anything else, also inside a word.

Defined results: a null text counts as empty and has the end id only; null ids come first; rows that repeat an id
each have their own place, ordered by text; an empty table gives empty files; extra columns are not written.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunk_ids import KnownIds, as_lists, text_arrays
from .common import BROADCAST_ROWS, bound_batches, held_by_worker, text_or_empty, trim

END_ID = 1
#: Strings kept from batch to batch, text bytes a batch, and text bytes a file.
KNOWN_CHUNKS, KNOWN_RUNS, TEXT_BYTES, FILE_BYTES = 600_000, 600_000, 12_000_000, 256 << 20
STRIPE_BYTES, INDEX_STRIDE = 16 << 20, 2000
FILE_SCHEMA = "doc_id long, local_start long, n_tokens long, ids array<int>"


def _is_latin(text: str) -> bool:
    """Whether the lower case and composition of each character depend on nothing else."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class ChunkEncoder:
    """The ids of strings without spaces, by the runs of letters, digits and other characters that the vocabulary
    encodes separately, and of texts."""

    def __init__(self, tokenizer_path: str):
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        # in what lies between the added tokens, lower case must not make another one
        self.tokenizer.encode_special_tokens = True
        self.added: dict[str, int] = {}
        for i, t in self.tokenizer.get_added_tokens_decoder().items():
            if not t.special or t.normalized or t.single_word or t.lstrip or t.rstrip:
                raise ValueError(f"added token {t.content!r} isn't matched as written")
            self.added[t.content] = i
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        self.runs = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.odd_space = re.compile("[\x1c-\x1f]")
        self.space = re.compile("[^\\S\x1c-\x1f]+")
        self.known = KnownIds(self._learn, KNOWN_CHUNKS)
        self.known_runs = KnownIds(self._encode_runs, KNOWN_RUNS)

    def _encode_runs(self, runs: list[str]) -> pa.ListArray:
        """The ids of runs; an added token stands for itself."""
        ids = [[self.added[r]] if r in self.added else None for r in runs] if self.added else [None] * len(runs)
        told = iter(self.tokenizer.encode_batch_fast([r for r, i in zip(runs, ids, strict=True) if i is None], add_special_tokens=False))
        return pa.array([next(told).ids if i is None else i for i in ids], pa.list_(pa.int32()))

    def _runs_of(self, text: str) -> list[str]:
        """The runs of a string between added tokens, or its words where a run could change by what stands beside it."""
        latin = text.isascii() or _is_latin(text)
        if latin:
            text = text.lower()  # for these characters, the same as the vocabulary's own lower case
            if text.isalpha():
                return [text]
            if text[:-1].isalpha() and not text[-1].isspace():
                return [text[:-1], text[-1]]
        odd = self.odd_space.search(text)  # white space for Python, but not for the vocabulary
        out: list[str] = []
        for word in [w for w in self.space.split(text) if w] if odd else text.split():
            if word.isalpha() or not latin or "'" in word:
                out.append(word)
            else:
                out += self.runs.findall(word)
        return out

    def _learn(self, chunks: list[str]) -> pa.ListArray:
        split = []
        for c in chunks:
            if "<" in c and self.cut and self.cut.search(c):
                parts = self.cut.split(c)  # at odd places, added tokens
                split.append([x for k, p in enumerate(parts) for x in ([p] if k % 2 else self._runs_of(p))])
            else:
                split.append(self._runs_of(c))
        codes, runs = pd.factorize(np.array(list(chain.from_iterable(split)), object))
        ids, sizes = self.known_runs.in_order(pa.array(runs, pa.string()), codes)
        return as_lists(ids, np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([len(s) for s in split])]) if split else self.known.ids.slice(0, 0)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text, with the end id; none is null."""
        if not len(texts):
            return self.known.ids.slice(0, 0)
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        last = np.cumsum(split.value_lengths().to_numpy().astype(np.int64)) - 1
        ids, sizes = self.known.in_order(coded.dictionary, coded.indices.to_numpy())
        ends = np.cumsum(sizes)[last]
        return as_lists(np.insert(ids, ends, END_ID), ends + np.arange(1, len(texts) + 1))


def _encoder(tokenizer_path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one for all tasks of a worker process, so that its cache goes on
        encoder, start = held_by_worker(("token_files", tokenizer_path), lambda: ChunkEncoder(tokenizer_path)), 0
        for doc_ids, texts in text_arrays(batches, TEXT_BYTES):
            ids = encoder.encode(texts)
            offsets = ids.offsets.to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(start + offsets[:-1]), pa.array(np.diff(offsets)), ids], ["doc_id", "local_start", "n_tokens", "ids"])
            start += int(offsets[-1])
            del texts, ids
        trim()  # what a task's texts took, before the next one's come

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, files: int | None = None) -> None:
    """Encode docs (doc_id, text) into ORC files of path, in ascending order of doc_id across and within files.

    There are as many files as the text has FILE_BYTES, and no fewer than tasks run at a time."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    if not files:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    out = texts.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(_encoder(tokenizer_path), FILE_SCHEMA)
    (
        # a task's rows count from its start, so they stay in one file
        out.write.option("maxRecordsPerFile", 0).option("orc.compress", "ZSTD").option("orc.stripe.size", str(STRIPE_BYTES)).option("orc.row.index.stride", str(INDEX_STRIDE))
        .option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files of path; start counts the ids of all documents before."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path).select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
    # a file's number is that of its task; as text it doesn't sort from 100,000 files on
    number = F.regexp_extract("file", "^part-([0-9]+)", 1).cast("long")
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("total")).withColumn("number", number)
    before = F.sum("total").over(Window.orderBy("number", "file").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    bases = sums.select(F.col("file").alias("of"), F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases) if len(rows.inputFiles()) <= BROADCAST_ROWS else bases, F.col("file") == F.col("of")).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def with_checksum(tokens: DataFrame) -> DataFrame:
    """ids replaced by the CRC-32 of the ids as little-endian unsigned 32-bit integers, and n_tokens by their number."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            raw = memoryview(values.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long")

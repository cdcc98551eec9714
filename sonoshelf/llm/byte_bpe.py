"""Byte-level BPE: recursive DuckDB queries in each partition merge the pieces of texts; ordered aggregation decodes.

Spark deals out the texts. In a task, texts are cut to pieces and each different piece of a batch is merged once, while
a small cache of the commonest goes on: token-position rows join the merge table, every piece contracts its leftmost
pair of lowest rank, and the recursion goes on until no piece has a pair that merges. A piece that is itself a token is
that token. Decoding takes nothing but the ids: their position rows join the vocabulary, and an ordered aggregation
puts the bytes of each window of positions together.

The recursion takes a round for each merge of its longest piece and keeps the rows of all rounds, so its work grows
with the square of a piece's length. Pieces of over ``LONG_PIECE`` bytes, which no natural word has, go to an exact
merge with a heap instead, which takes n log n steps; README has the figures.

Defined results: a null text counts as empty, without ids; special tokens are ordinary text; extra columns are
ignored; rows are independent, so repeated rows repeat their result; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .chunk_ids import KnownIds, as_lists, take_lists, text_arrays
from .common import bound_batches, held_by_worker, text_or_empty, trim

LONG_PIECE = 256
#: Chunks and pieces kept from batch to batch, some 30 bytes each.
KNOWN_CHUNKS, KNOWN_PIECES = 150_000, 400_000
#: Text bytes a batch, rows of all rounds of a recursion, and tokens a decoding query.
TEXT_BYTES, ROUND_ROWS, DECODED_ROWS = 2_000_000, 600_000, 1 << 17
#: Positions an aggregation puts in order together.
WINDOW_BITS = 12
MEMORY = "120MB"

#: Rows of pieces whose merges go on, round by round, and of those that are done. Each row knows the token to its
#: right; rank, position and the position to the right are one number, as positions are below 1024.
ENCODE = """
WITH RECURSIVE state(piece, pos, token, right_pos, right_token, done) AS (
    SELECT piece, pos, token, lead(pos) OVER w, lead(token) OVER w, false FROM start_rows WINDOW w AS (PARTITION BY piece ORDER BY pos)
  UNION ALL (
    WITH live AS MATERIALIZED (SELECT piece, pos, token, right_pos, right_token FROM state WHERE NOT done),
    best AS MATERIALIZED (
        SELECT l.piece, min((m.rank::BIGINT << 20) + (l.pos << 10) + l.right_pos) AS low
        FROM live l JOIN merges m ON l.token = m.left_token AND l.right_token = m.right_token GROUP BY l.piece),
    merged AS (
        SELECT b.piece, (b.low >> 20)::INTEGER AS token, (b.low >> 10) & 1023 AS pos, b.low & 1023 AS gone, r.right_pos, r.right_token
        FROM best b JOIN live r ON b.piece = r.piece AND r.pos = b.low & 1023)
    SELECT l.piece, l.pos, CASE WHEN l.pos = m.pos THEN m.token ELSE l.token END,
           CASE WHEN l.pos = m.pos THEN m.right_pos ELSE l.right_pos END,
           CASE WHEN l.pos = m.pos THEN m.right_token WHEN l.right_pos = m.pos THEN m.token ELSE l.right_token END, m.pos IS NULL
    FROM live l LEFT JOIN merged m ON l.piece = m.piece WHERE l.pos IS DISTINCT FROM m.gone))
SELECT piece, list(token ORDER BY pos) AS ids FROM state WHERE done GROUP BY piece ORDER BY piece
"""
#: The bytes of the ids in each window of positions, in order.
DECODE = """
SELECT r.pos >> {bits} AS part, list(v.raw ORDER BY r.pos) AS raw
FROM token_rows r JOIN vocab v ON r.token = v.token GROUP BY part ORDER BY part
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the leftmost pair of lowest rank until none is left, with a heap over a linked list of parts."""
    end, prev = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
    alive, n = [True] * len(piece), len(piece)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] == n or end[end[i]] != stop:
            continue  # one of its parts has changed
        alive[end[i]] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if prev[i] >= 0 and (r := ranks.get(piece[prev[i] : stop])) is not None:
            heapq.heappush(heap, (r, prev[i], stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class PieceCoder:
    """Encodes pieces and decodes ids in a DuckDB database of its own, in memory and without files."""

    def __init__(self, ranks_path: str):
        import duckdb

        self.ranks = read_ranks(ranks_path)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        left, right, rank = zip(*pairs, strict=True)
        self._table("merge_rows", left_token=pa.array(left, pa.int32()), right_token=pa.array(right, pa.int32()), rank=pa.array(rank, pa.int32()))
        self.db.execute("CREATE TABLE merges AS FROM merge_rows")
        tokens = pa.array(list(self.ranks.values()), pa.int32())
        self._table("vocab_rows", token=tokens, raw=pa.array(list(self.ranks), pa.binary()))
        self.db.execute("CREATE TABLE vocab AS FROM vocab_rows")
        self.db.unregister("merge_rows")
        self.db.unregister("vocab_rows")
        size = max(self.ranks.values()) + 1
        self.byte_token, self.told, self.bytes_of = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32), pa.array(map(str, range(size))), np.zeros(size, np.int64)
        for raw, r in self.ranks.items():
            self.bytes_of[r] = len(raw)

    def _table(self, name: str, **columns) -> None:
        self.db.register(name, pa.table(columns))

    def _merged(self, pieces: list[bytes]) -> pa.ListArray:
        sizes = np.array([len(p) for p in pieces])
        first = np.cumsum(sizes) - sizes
        pos = np.arange(sizes.sum()) - np.repeat(first, sizes)
        tokens = self.byte_token[np.frombuffer(b"".join(pieces), np.uint8)]
        self._table("start_rows", piece=pa.array(np.repeat(np.arange(len(pieces)), sizes), pa.int32()), pos=pa.array(pos, pa.int32()), token=pa.array(tokens))
        return self.db.sql(ENCODE).to_arrow_table()["ids"].combine_chunks().cast(pa.list_(pa.int32()))

    def encode(self, pieces: list[bytes]) -> pa.ListArray:
        """The ids of each piece; none is empty."""
        whole, long, todo = [], [], []
        for k, p in enumerate(pieces):
            (whole if p in self.ranks else long if len(p) > LONG_PIECE else todo).append(k)
        todo.sort(key=lambda k: len(pieces[k]))  # a recursion ends when its longest piece is done
        made = [pa.array([[self.ranks[pieces[k]]] for k in whole], pa.list_(pa.int32())), pa.array([heap_merge(pieces[k], self.ranks) for k in long], pa.list_(pa.int32()))]
        rounds = np.cumsum([len(pieces[k]) ** 2 // 2 for k in todo]) // ROUND_ROWS
        for part in np.split(np.array(todo, int), np.flatnonzero(np.diff(rounds)) + 1) if todo else ():
            made.append(self._merged([pieces[k] for k in part]))
        back = np.empty(len(pieces), np.int64)
        back[np.array(whole + long + todo, int)] = np.arange(len(pieces))
        return pa.concat_arrays(made).take(pa.array(back))

    def decode(self, lists: pa.ListArray) -> pa.LargeBinaryArray:
        """The bytes of each list of ids."""
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        parts = []
        for low in range(0, len(ids), DECODED_ROWS):
            part = ids[low : low + DECODED_ROWS]
            self._table("token_rows", pos=pa.array(np.arange(len(part)), pa.int32()), token=pa.array(part, pa.int32()))
            for raw in self.db.sql(DECODE.format(bits=WINDOW_BITS)).to_arrow_table()["raw"].chunks:
                flat = raw.flatten()
                first, last = (flat.offset, flat.offset + len(flat))
                at = np.frombuffer(flat.buffers()[1], np.int32)[[first, last]]
                parts.append(flat.buffers()[2].slice(int(at[0]), int(at[1] - at[0])))
        ends = np.concatenate([[0], np.cumsum(self.bytes_of[ids])])[np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])]
        raw = pa.py_buffer(b"".join(parts))
        return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int64)), raw])


class TextCoder:
    """Texts by chunks, which start at a space between two characters that aren't white space or at the text's start.

    No piece of the pattern reaches over such a space, so a chunk's ids are the same in every text. Most texts have
    no other spaces, and splitting at each gives their chunks. A key without a space before it stands for the chunk of
    a space and itself, and a space and a chunk for that chunk.
    """

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        self.pieces, self.coder = regex.compile(pattern), PieceCoder(ranks_path)
        self.cuts = regex.compile(r"(?<=\S)(?= \S)", regex.V1)
        self.known = KnownIds(self._learn, KNOWN_CHUNKS)
        self.merged = KnownIds(lambda pieces: self.coder.encode([p.encode() for p in pieces]), KNOWN_PIECES)

    def _pieces_of(self, chunk: str) -> list[str]:
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha():
            return [chunk]
        if word[:-1].isalpha() and word[-1] in ".,!?;:":
            return [chunk[:-1], chunk[-1]]
        return self.pieces.findall(chunk)

    def _learn(self, keys: list[str]) -> pa.ListArray:
        """The ids of the chunks of these keys."""
        split = [self._pieces_of(k[1:] if k[:1] == " " else " " + k) for k in keys]
        if not split:
            return self.known.ids.slice(0, 0)
        codes, pieces = pd.factorize(np.array(list(chain.from_iterable(split)), object))
        ids, sizes = self.merged.in_order(pa.array(pieces, pa.string()), codes)
        return as_lists(ids, np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([len(s) for s in split])])

    @staticmethod
    def _spaced(keys: pa.Array, place: int) -> np.ndarray:
        """Whether the first or last character of each key is white space, or none."""
        end = pc.utf8_slice_codeunits(keys, place, place + 1 or None).dictionary_encode()
        return np.array([not c or c.isspace() for c in end.dictionary.to_pylist()], bool)[end.indices.to_numpy()]

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text; none is null."""
        if not len(texts):
            return self.known.ids.slice(0, 0)
        split = pc.split_pattern(texts, " ")
        sizes = split.value_lengths().to_numpy().astype(np.int64)
        first, values = np.cumsum(sizes) - sizes, split.flatten()
        coded = values.dictionary_encode()
        heads = pc.binary_join_element_wise("", values.take(pa.array(first)), " ").dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        codes[first] = len(coded.dictionary) + heads.indices.to_numpy()
        keys = pa.concat_arrays([coded.dictionary, heads.dictionary])
        odd = self._spaced(keys, -1)
        odd[: len(coded.dictionary)] |= self._spaced(coded.dictionary, 0)
        uneven = np.logical_or.reduceat(odd[codes], first)
        if uneven.any():
            cut = [[" " + c for c in self.cuts.split(t) if c] for t in texts.filter(pa.array(uneven)).to_pylist()]
            other = pa.array(list(chain.from_iterable(cut)), pa.string()).dictionary_encode()
            even = codes[~np.repeat(uneven, sizes)]
            sizes[uneven] = [len(c) for c in cut]
            codes, at = np.empty(sizes.sum(), np.int64), np.repeat(uneven, sizes)
            codes[~at], codes[at] = even, len(keys) + other.indices.to_numpy()
            keys = pa.concat_arrays([keys, other.dictionary])
        ids, lengths = self.known.in_order(keys, codes)
        return as_lists(ids, np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(sizes)])


def _text_coder(ranks_path: str, pattern: str) -> TextCoder:
    """One for all tasks of a worker process, so that its cache goes on."""
    return held_by_worker(("byte_bpe", ranks_path, pattern), lambda: TextCoder(ranks_path, pattern))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _text_coder(ranks_path, pattern)
        for doc_ids, texts in text_arrays(batches, TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([doc_ids, coder.encode(texts)], ["doc_id", "ids"])

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, raw) of tokens (doc_id, ids), the decoded bytes; null ids give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(ranks_path)
        for batch in batches:
            raw = coder.decode(pc.fill_null(batch.column("ids"), pa.scalar([], pa.list_(pa.int32()))) if batch.column("ids").null_count else batch.column("ids"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), raw.cast(pa.binary())], ["doc_id", "raw"])

    bound_batches(tokens.sparkSession)
    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode each text, and decode the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _text_coder(ranks_path, pattern)
        for doc_ids, texts in text_arrays(batches, TEXT_BYTES):
            ids = coder.encode(texts)
            told = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, coder.coder.told.take(ids.values)), ",")
            digests = [pa.array([hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in column]) for column in (told, coder.coder.decode(ids))]
            yield pa.RecordBatch.from_arrays([doc_ids, ids.value_lengths().cast(pa.int64()), *digests], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            del texts, ids, told
            trim()

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Language-model scores from an n-gram trie in Elias-Fano levels.

The model interpolates n-grams up to ``order`` with absolute discounting, and unigrams with add-0.1 smoothing. A context
is the tokens before one: one of them at level 2, two at level 3, and so on, as long as the text goes back so far. Tasks
count the pairs of context and token in their share of the training texts; the counts meet by hash of both, so that
nothing common gathers in one place. From level 3 on, pairs seen fewer than ``cutoff`` times are left out, as if they had
not been seen. The trie is made of files in the shared folder, which executors map into memory and only read where a
query leads:

- level 1, by hash of the token: an Elias-Fano sequence of the hashes, the exact counts and numbers of successors; and
  the same of the contexts of each level from 3 on;
- level 2 and on, by hashes of context and token: an Elias-Fano sequence of the contexts, monotone Elias-Fano pointers to
  each context's successors, the successors' hashes sorted within their context, and the smoothed probability of each in
  16 bits. A pair is found by successor search between its context's pointers.

Words stand for their 56-bit hashes, so counts are exact but for words whose hashes are equal: among v words that is
about v * v / 2^57 pairs, 0.07 for a hundred million. What is gathered grows with the corpus, in files of bounded size
each. Executors map them into memory where the shared folder is mounted, and read them into it elsewhere.

Defined results: a null text counts as empty, whose only token is the end; A-Z is lower-cased; rows that repeat an id
are training texts or held out together; without training texts only the add-0.1 base of an empty corpus scores; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_remainder, new_path, stow, text_or_empty
from .elias_fano import EliasFano, open_arrays, pack, search, unpack, write_arrays

HASH_BITS = 56
DISCOUNT, ADDED = 0.75, 0.1
ORDER, CUTOFF = 2, 2
#: Probabilities are kept as -log10 in steps of this.
CODE_STEP = 24 / 65535
TOKENS_A_SHARD, TOKENS_A_BATCH = 2_000_000, 600_000
#: Stand-ins for start and end, which no word can be.
START, END = b"\n", b"\r"
_U = np.uint64


@lru_cache(1)
def _marks() -> tuple[int, int]:
    a, b = _hash([START, END])
    return int(a), int(b)


def _hash(words) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], _U) >> _U(64 - HASH_BITS)


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, sorted distinct hashes, number of tokens of each text); each text is start, words, end."""
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    flat = np.empty(int(sizes.sum()) + len(words), object)
    at = 0
    for w in words:
        flat[at] = START
        flat[at + 1 : at + 1 + len(w)] = w
        flat[at + 1 + len(w)] = END
        at += len(w) + 2
    codes, distinct = pd.factorize(flat)
    hashes, back = np.unique(_hash(distinct), return_inverse=True)
    return back[codes] if len(flat) else np.zeros(0, np.int64), hashes, sizes


def _pairs(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and token of each token; sizes are the numbers of tokens of each text."""
    token = np.ones(len(codes), bool)
    token[np.cumsum(sizes + 1) - sizes - 1] = False
    at = np.flatnonzero(token)
    return codes[at - 1], codes[at]


def _contexts(hashes: np.ndarray, codes: np.ndarray, sizes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the context of each token at a level, and whether the text goes back so far. The start is one of the
    tokens before; at level 2 the context's hash is that of the token before."""
    flat = hashes[codes]
    first = np.cumsum(sizes + 1) - sizes - 1
    back = np.arange(len(codes)) - np.repeat(first, sizes + 1)
    token = back > 0
    h = np.concatenate([[_U(0)], flat[:-1]]) if len(flat) else flat
    for k in range(2, level):
        before = np.concatenate([np.zeros(k, _U), flat[:-k]]) if len(flat) >= k else np.zeros(len(flat), _U)
        h = ((h ^ (before * _U(0x9E3779B97F4A7C15))) * _U(0xBF58476D1CE4E5B9)) >> _U(64 - HASH_BITS)
    return h[token], back[token] >= level - 1


def _reduced(h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((h2, h1))
    h1, h2, n = h1[order], h2[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])) if len(h1) else np.zeros(0, np.int64)
    return h1[first], h2[first], np.add.reduceat(n, first) if len(first) else n


def _to_bytes(h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs in order as runs of contexts, seven bytes a successor, and counts."""
    starts = np.flatnonzero(np.concatenate([[True], h1[1:] != h1[:-1]])) if len(h1) else np.zeros(0, np.int64)
    runs = np.diff(np.append(starts, len(h1))).astype("<u4")
    width = "<u4" if n.max(initial=0) < 1 << 32 else "<u8"
    head = np.array([len(starts), len(h1), int(width[-1])], "<i8")
    seven = h2.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
    return b"".join([head.tobytes(), h1[starts].astype("<u8").tobytes(), runs.tobytes(), n.astype(width).tobytes(), np.ascontiguousarray(seven).tobytes()])


def _from_bytes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    contexts, size, width = (int(x) for x in np.frombuffer(raw, "<i8", 3))
    at = 24
    h = np.frombuffer(raw, "<u8", contexts, at)
    runs = np.frombuffer(raw, "<u4", contexts, at + 8 * contexts)
    n = np.frombuffer(raw, f"<u{width}", size, at + 12 * contexts)
    seven = np.frombuffer(raw, np.uint8, 7 * size, at + 12 * contexts + width * size).reshape(-1, 7)
    h2 = np.zeros((size, 8), np.uint8)
    h2[:, :7] = seven
    return np.repeat(h, runs), h2.view("<u8").reshape(-1).astype(_U), n.astype(np.int64)


class Shape:
    """How hashes are dealt: level 1 by the first bits of the token, level 2 by those of context and token."""

    def __init__(self, tokens: int):
        shards = max(4, -(-tokens // TOKENS_A_SHARD))
        bits = (shards - 1).bit_length()
        self.successor_bits = bits // 2  # so that a common context is in as many shards as there are successors' bits
        self.context_bits = bits - self.successor_bits

    def level1(self, h: np.ndarray) -> np.ndarray:
        return (h >> _U(HASH_BITS - self.context_bits)).astype(np.int64)

    def level2(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return self.level1(h1) << self.successor_bits | (h2 >> _U(HASH_BITS - self.successor_bits)).astype(np.int64)

    @property
    def within(self) -> int:
        """Bits of a token's hash that tell it within its shard."""
        return HASH_BITS - self.context_bits


def _part(h: np.ndarray, bits: int) -> np.ndarray:
    return h & _U((1 << bits) - 1)


class Model:
    """The levels in a folder, mapped into memory file by file as queries need them."""

    def __init__(self, folder: str, shape: Shape, tokens: int, kinds: int, order: int = ORDER):
        self.folder, self.shape, self.tokens, self.kinds, self.order = folder, shape, tokens, kinds, order
        self.files: dict[str, dict | None] = {}

    def _file(self, name: str) -> dict | None:
        if name not in self.files:
            self.files[name] = open_arrays(f"{self.folder}/{name}")
        return self.files[name]

    def counts(self, h: np.ndarray, level: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Count and number of different successors of each context of a level; those of level 2 are the tokens, of
        which the start stands for the end's count."""
        count, kinds = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        shard = self.shape.level1(h)
        for s, at in _by_shard(shard):
            f = self._file(f"level1-{s}" if level == 2 else f"contexts{level}-{s}")
            if f is None:
                continue
            place = EliasFano(f, "token").find(_part(h[at], self.shape.within))
            at, place = at[place >= 0], place[place >= 0]
            count[at] = unpack(f["count"], int(f["bits"][0]), place)
            kinds[at] = unpack(f["kinds"], int(f["bits"][1]), place)
        return count, kinds

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + ADDED) / (self.tokens + ADDED * (self.kinds + 1))

    def probability(self, h1: np.ndarray, h2: np.ndarray, lower: np.ndarray, level: int = 2) -> np.ndarray:
        """The probability of each token after its context of a level: the kept one, or what the context leaves to the
        lower level, or that itself after a context that wasn't seen."""
        seen, (count, followers) = self.codes(h1, h2, level), self.counts(h1, level)
        left = np.where(count > 0, DISCOUNT * followers / np.maximum(1, count), 1.0)
        return np.where(seen >= 0, 10.0 ** (-seen * CODE_STEP), left * lower)

    def codes(self, h1: np.ndarray, h2: np.ndarray, level: int = 2) -> np.ndarray:
        """The kept probability of each pair, -1 for pairs that weren't seen."""
        out = np.full(len(h1), -1, np.int64)
        for s, at in _by_shard(self.shape.level2(h1, h2)):
            f = self._file(f"level{level}-{s}")
            if f is None:
                continue
            contexts = EliasFano(f, "context")
            place = contexts.find(_part(h1[at], self.shape.within))
            at, place = at[place >= 0], place[place >= 0]
            pointers = EliasFano(f, "pointer")
            found = search(f["successor"], HASH_BITS, pointers.get(place), pointers.get(place + 1), h2[at])
            out[at[found >= 0]] = f["code"][found[found >= 0]]
        return out


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for k, a in enumerate(cuts):
        yield int(shard[order[a]]), order[a : cuts[k + 1] if k + 1 < len(cuts) else len(order)]


def _as_end(h: np.ndarray) -> np.ndarray:
    """The end's count is that of the start, which begins as many texts."""
    start, end = _marks()
    return np.where(h == _U(end), _U(start), h)


def _batches_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t) // 6 + 2
            if size > TOKENS_A_BATCH:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def pair_counts(docs: DataFrame, shape: Shape, level: int = 2, cutoff: int = 1) -> DataFrame:
    """(shard, pairs): the counts of contexts and tokens in docs (doc_id, text), one row a shard, as bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _batches_of_texts(batches):
            codes, hashes, sizes = _tokens(texts)
            a, b = _pairs(codes, sizes)
            if level == 2:
                key, n = np.unique(a * len(hashes) + b, return_counts=True)
                h1, h2 = hashes[key // len(hashes)], hashes[key % len(hashes)]
            else:
                h, far = _contexts(hashes, codes, sizes, level)
                h1, h2, n = _reduced(h[far], hashes[b[far]], np.ones(int(far.sum()), np.int64))
            rows = [(s, _to_bytes(h1[at], h2[at], n[at])) for s, at in _by_shard(shape.level2(h1, h2))]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.binary())], ["shard", "pairs"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None

        def out() -> pa.RecordBatch:
            merged = _reduced(*(np.concatenate(x) for x in zip(*held, strict=True)))
            merged = tuple(x[merged[2] >= cutoff] for x in merged)
            return pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([_to_bytes(*merged)], pa.binary())], ["shard", "pairs"])

        for batch in batches:
            for s, raw in zip(batch.column("shard").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                if s != of and held:
                    yield out()
                    held = []
                of = s
                held.append(_from_bytes(raw))
        if held:
            yield out()

    kept = "shard long, pairs binary"
    shards = 1 << (shape.context_bits + shape.successor_bits)
    counted = docs.mapInArrow(count, kept)
    return counted.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard").mapInArrow(merge, kept)


def build(docs: DataFrame, order: int = ORDER, cutoff: int = CUTOFF) -> Model:
    """Train on docs (doc_id, text) and write the levels to the shared folder."""
    if order < 2:
        raise ValueError(f"the order must be 2 or more, not {order}")
    spark = docs.sparkSession
    bound_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shape = Shape(int(size) // 6)
    folder = new_path(spark, "trie")
    tokens = kinds = 0
    for level in range(2, order + 1):
        pairs = stow(pair_counts(docs, shape, level, 1 if level == 2 else cutoff), "pairs")
        sums = _write_contexts(pairs, folder, shape, level)
        if level == 2:
            tokens, kinds = sums
        _write_level(pairs, Model(folder, shape, tokens, kinds, level - 1), level, None if level == 2 else docs)
    return Model(folder, shape, tokens, kinds, order)


def _write_contexts(pairs: DataFrame, folder: str, shape: Shape, level: int) -> tuple[int, int]:
    """Write counts and numbers of successors of the contexts of a level, and give the sums of both."""
    name = "level1" if level == 2 else f"contexts{level}"

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, raw in zip(batch.column("shard").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                h1, _, n = _from_bytes(raw)
                if not len(h1):
                    continue
                first = np.flatnonzero(np.concatenate([[True], h1[1:] != h1[:-1]]))
                kinds = np.diff(np.append(first, len(h1)))
                yield pa.RecordBatch.from_pydict({"shard": pa.array([s >> shape.successor_bits], pa.int64()), "tokens": pa.array([h1[first].tobytes()], pa.binary()), "counts": pa.array([np.add.reduceat(n, first).tobytes()], pa.binary()), "kinds": pa.array([kinds.tobytes()], pa.binary())})

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = [f for f in batches if len(f)]
        frame = pd.concat(whole) if whole else pd.DataFrame({"shard": []})
        for s, rows in frame.groupby("shard"):
            h = np.concatenate([np.frombuffer(x, _U) for x in rows["tokens"]])
            n = np.concatenate([np.frombuffer(x, np.int64) for x in rows["counts"]])
            k = np.concatenate([np.frombuffer(x, np.int64) for x in rows["kinds"]])
            h, at = np.unique(h, return_inverse=True)
            n, k = (np.bincount(at, x, len(h)).astype(np.int64) for x in (n, k))
            bits = [max(1, int(x.max()).bit_length()) for x in (n, k)]
            write_arrays(f"{folder}/{name}-{int(s)}", EliasFano.build(_part(h, shape.within), shape.within, "token") | {"bits": np.array(bits), "count": pack(n, bits[0]), "kinds": pack(k, bits[1])})
            yield pd.DataFrame({"tokens": [int(n.sum())], "kinds": [len(h)]})

    parts = pairs.mapInArrow(contexts, "shard long, tokens binary, counts binary, kinds binary")
    sums = parts.repartitionById(1 << shape.context_bits, F.col("shard").cast("int")).mapInPandas(write, "tokens long, kinds long").agg(F.sum("tokens"), F.sum("kinds")).first()
    return int(sums[0] or 0), int(sums[1] or 0)


def _write_level(pairs: DataFrame, lower: Model, level: int, docs: DataFrame | None) -> None:
    """Write the smoothed probabilities of a level over those of the lower one.

    At level 2 those are of single tokens. From level 3 on a pair's lower context isn't known from its hash, so the
    lower probabilities come from the texts again, as (context, token, probability) of the pairs that are kept."""
    folder, shape, tokens, kinds = lower.folder, lower.shape, lower.tokens, lower.kinds

    def put(s: int, h1: np.ndarray, h2: np.ndarray, n: np.ndarray, below: np.ndarray | None) -> None:
        model = Model(folder, shape, tokens, kinds, level)
        first = np.flatnonzero(np.concatenate([[True], h1[1:] != h1[:-1]])) if len(h1) else np.zeros(0, np.int64)
        runs = np.diff(np.append(first, len(h1)))
        count, followers = (np.repeat(x, runs) for x in model.counts(h1[first], level))
        if below is None:
            distinct, back = np.unique(_as_end(h2), return_inverse=True)
            below = model.unigram(model.counts(distinct)[0])[back]
        p = (np.maximum(n - DISCOUNT, 0) + DISCOUNT * followers * below) / count
        code = np.clip(np.rint(-np.log10(p) / CODE_STEP), 0, 65535).astype(np.uint16)
        arrays = EliasFano.build(_part(h1[first], shape.within), shape.within, "context")
        arrays |= EliasFano.build(np.append(first, len(h1)), max(1, len(h1)).bit_length(), "pointer")
        write_arrays(f"{folder}/level{level}-{s}", arrays | {"successor": pack(h2, HASH_BITS), "code": code})

    def from_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, raw in zip(batch.column("shard").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                put(s, *_from_bytes(raw), None)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int64())})

    if docs is None:
        pairs.mapInArrow(from_pairs, "shard long").agg(F.count("*")).first()
        return

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(folder, shape, tokens, kinds, level - 1)
        for _, texts in _batches_of_texts(batches):
            codes, hashes, sizes = _tokens(texts)
            _, b = _pairs(codes, sizes)
            h, far = _contexts(hashes, codes, sizes, level)
            below = _probabilities(model, codes, hashes, sizes, level - 1)[far]
            h1, h2 = h[far], hashes[b[far]]
            order = np.lexsort((h2, h1))
            h1, h2, below = h1[order], h2[order], below[order]
            one = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) if len(h1) else np.zeros(0, bool)
            h1, h2, below = h1[one], h2[one], below[one]
            rows = [(s, np.stack([h1[at], h2[at], below[at].view(_U)]).tobytes()) for s, at in _by_shard(shape.level2(h1, h2))]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.binary())], ["shard", "told"])

    def from_both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        kept: dict[int, bytes] = {}
        for batch in batches:
            for s, t, raw in zip(batch.column("shard").to_pylist(), batch.column("told").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                if raw is not None:
                    kept[s] = raw
                else:
                    held.setdefault(s, []).append(np.frombuffer(t, _U).reshape(3, -1))
        for s, raw in kept.items():
            h1, h2, n = _from_bytes(raw)
            a, b, p = np.concatenate(held.get(s, [np.zeros((3, 0), _U)]), axis=1)
            # the same context and token are at the same place, whatever lies around them
            both, (c, d) = np.concatenate([np.stack([h1, h2], 1), np.stack([a, b], 1)]), (len(h1), len(a))
            _, at = np.unique(both, axis=0, return_inverse=True) if c + d else (None, np.zeros(0, np.int64))
            below = np.zeros(int(at.max(initial=-1)) + 1)
            below[at[c:]] = p.view(float)
            put(s, h1, h2, n, below[at[:c]])
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int64())})

    both = docs.mapInArrow(told, "shard long, told binary").select("shard", "told", F.lit(None).cast("binary").alias("pairs")).unionByName(pairs.select("shard", F.lit(None).cast("binary").alias("told"), "pairs"))
    both.repartitionById(1 << (shape.context_bits + shape.successor_bits), F.col("shard").cast("int")).mapInArrow(from_both, "shard long").agg(F.count("*")).first()


def _probabilities(model: Model, codes: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, order: int) -> np.ndarray:
    """The model's probability of each token, from the levels up to order."""
    a, b = _pairs(codes, sizes)
    base = model.unigram(model.counts(_as_end(hashes))[0])
    key, back = np.unique(a * len(hashes) + b, return_inverse=True)
    left, right = key // max(1, len(hashes)), key % max(1, len(hashes))
    p = model.probability(hashes[left], hashes[right], base[right])[back]
    for level in range(3, order + 1):
        h, far = _contexts(hashes, codes, sizes, level)
        p[far] = model.probability(h[far], hashes[b[far]], p[far], level)
    return p


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of docs (doc_id, text)."""
    folder, shape, tokens, kinds, order = model.folder, model.shape, model.tokens, model.kinds, model.order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(folder, shape, tokens, kinds, order)
        for ids, texts in _batches_of_texts(batches):
            codes, hashes, sizes = _tokens(texts)
            _, b = _pairs(codes, sizes)
            count, _ = model.counts(_as_end(hashes))
            base = model.unigram(count)
            logs = np.log10(_probabilities(model, codes, hashes, sizes, order))
            starts = np.cumsum(sizes) - sizes
            sums = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(sums((count[b] > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array(np.full(len(ids), tokens), pa.int64()), "base_score": pa.array(sums(np.log10(base)[b]), pa.float64()), "score": pa.array(sums(logs), pa.float64()),
            })

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_held_out(docs: DataFrame, modulus: int = 10, order: int = ORDER, cutoff: int = CUTOFF) -> DataFrame:
    """Scores of all docs by a model of those whose crc32 remainder isn't 0, with held_out."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    model = build(texts.where(id_remainder("doc_id", modulus) != 0), order, cutoff)
    return score(texts, model).withColumn("held_out", id_remainder("doc_id", modulus) == 0)

"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole and encoded once, with the offsets of its tokens; the spans of the turns that
count for the loss are known from rendering, and a binary search in the sorted offsets finds the tokens of each.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` for each turn, and nothing between turns. The three marks are
tokens of their own, so no token reaches over the edge of a text. Inside roles and texts, ``<``, any backslashes and
``|`` get one more backslash, so that no mark and no other added token can stand there; readers take it off again.

Turns are grouped by conversation. Since the marks cut the text before anything else is looked at, a conversation of
over ``TURNS`` turns is dealt by the places of its turns into parts of so many, which are rendered and encoded each
for itself with the same ids; no task gathers more turns than that. Digests over such a conversation need all its text
in order, so its parts stream, sorted, through one task that holds a part at a time.

Defined results: null roles and texts count as empty; a null conversation is one of its own; null turns come first;
rows that repeat a turn are turns of their own, ordered by role, then by the SHA-256 of their text; conversations
without turns that count have an empty loss text; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunk_ids import KnownIds
from .common import BROADCAST_ROWS, bound_batches, held_by_worker, stow, trim
from .positions import numbered

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLES = ("assistant",)
#: Turns of a part, and strings kept from batch to batch.
TURNS, KNOWN = 256, 100_000
ROW = "conv_id {conv}, part long, parts long, text string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"
DIGEST = "conv_id {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
TURN = re.compile(rf"{re.escape(START)}(.*?){re.escape(SEP)}(.*?){re.escape(END)}", re.DOTALL)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]], loss_roles: tuple[str, ...] = LOSS_ROLES) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) turns, and the sorted spans of the texts that count, by code point."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        at += len(head)
        if role in loss_roles and body:
            spans.append((at, at + len(body)))
        out += [head, body, END]
        at += len(body) + len(END)
    return "".join(out), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    turns, at = [], 0
    for m in TURN.finditer(text):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError(f"no turn at {at}")
    return turns


class Encoder:
    """A byte-level vocabulary with the marks as tokens of their own.

    Texts are cut before a space between two word characters, where the vocabulary's rules always cut, and each different
    string of a batch is encoded once; those met last are kept. A token's offsets follow from the bytes that it stands for."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import AddedToken, Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        if self.tokenizer.normalizer is not None or any(not t.content.startswith("<|") for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("needs a vocabulary that takes texts as they are, with added tokens that begin with <|")
        self.tokenizer.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in (START, SEP, END)])
        # a token's string has one character for each byte
        self.bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())])
        self.cut = re.compile(r"(?<=\w)(?= \w)")
        self.known = KnownIds(self._learn, KNOWN)

    def _learn(self, strings: list[str]) -> pa.ListArray:
        return pa.array([x.ids for x in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)], pa.list_(pa.int32()))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, starts and ends of the tokens of each text, by code point."""
        split = [self.cut.split(t) for t in texts]
        codes, keys = pd.factorize(np.array(list(chain.from_iterable(split)), object))
        ids, sizes = self.known.in_order(pa.array(keys, pa.string()), codes)
        last = np.cumsum([0, *map(len, split)])
        tokens = np.concatenate([[0], np.cumsum(sizes)])[last]
        return [self._placed(t, ids[a:b]) for t, a, b in zip(texts, tokens[:-1], tokens[1:], strict=True)]

    def _placed(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ends = np.cumsum(self.bytes[ids])
        starts = ends - self.bytes[ids]
        if not text.isascii() and len(ids):
            # characters that have begun up to each byte; tokens that share a character both have it
            begun = np.cumsum(np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80)
            starts, ends = begun[starts] - 1, begun[ends - 1]
        return ids.astype(np.int32), starts.astype(np.int32), ends.astype(np.int32)


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens meet one of the sorted spans."""
    mask = np.zeros(len(starts), bool)
    if spans:
        a, b = np.array(spans).T
        for low, high in zip(np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left"), strict=True):
            mask[low:high] = True
    return mask


def masked_text(text: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> str:
    """The unescaped text under the mask. Several tokens may share a character; it is taken once."""
    at = np.flatnonzero(loss)
    if not len(at):
        return ""
    s, e = starts[at], np.maximum.accumulate(ends[at])
    first = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
    # marks lie between the texts of two turns, so each run is one text
    return "".join(unescape(text[a:b]) for a, b in zip(s[first], e[np.r_[first[1:] - 1, len(e) - 1]], strict=True))


def in_parts(conversations: DataFrame, turns: int = TURNS) -> DataFrame:
    """(conv_id, part, parts, turns array<struct<role,text>>): whole conversations, and parts of long ones."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.sha2("text", 256))
    long_ = stow(conversations.groupBy(F.col("conv_id").alias("of")).agg(F.count("*").alias("n")).where(F.col("n") > turns).select("of"), "long")
    n = long_.count()
    long_ = F.broadcast(long_) if n <= BROADCAST_ROWS else long_
    match = F.col("conv_id").eqNullSafe(F.col("of"))
    whole = rows.join(long_, match, "left_anti").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "key", "text"))).alias("turns"))
    out = whole.select("conv_id", F.lit(0).cast("long").alias("part"), F.lit(1).cast("long").alias("parts"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    if not n:
        return out
    placed = numbered(rows.join(long_, match, "left_semi"), "conv_id", ["turn", "role", "key"])
    part, parts = F.floor(F.col("pos") / turns).cast("long"), F.ceil(F.col("size") / turns).cast("long")
    dealt = placed.groupBy("conv_id", part.alias("part"), parts.alias("parts")).agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    return out.unionByName(dealt.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))))


def format_conversations(conversations: DataFrame, tokenizer_path: str, loss_roles: tuple[str, ...] = LOSS_ROLES, turns: int = TURNS) -> DataFrame:
    """A row per part of a conversation (conv_id, turn, role, text), most of one part: conv_id, part, parts, the
    formatted text, ids, starts and ends of its tokens, and loss (whether a token counts)."""
    bound_batches(conversations.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held_by_worker(("chat", tokenizer_path), lambda: Encoder(tokenizer_path))
        for batch in batches:
            told = [render([(t["role"], t["text"]) for t in turns.as_py()], loss_roles) for turns in batch.column("turns")]
            placed = encoder.encode([text for text, _ in told]) if told else []
            out = [(text, ids, starts, ends, loss_mask(starts, ends, spans)) for (text, spans), (ids, starts, ends) in zip(told, placed, strict=True)]
            kinds = [pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_())]
            columns = [pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("conv_id", "part", "parts")] + columns, ["conv_id", "part", "parts", "text", "ids", "starts", "ends", "loss"])
            del told, placed, out, columns
        trim()

    parts = in_parts(conversations, turns)
    return parts.mapInArrow(encode, ROW.format(conv=dict(parts.dtypes)["conv_id"]))


def write_formatted(conversations: DataFrame, path: str, tokenizer_path: str, **options) -> None:
    format_conversations(conversations, tokenizer_path, **options).write.parquet(path)


def digests(formatted: DataFrame) -> DataFrame:
    """A row per conversation, read back from its formatted parts: conv_id, n_turns, turns_sha256 (role, line end,
    text, line end of each turn), loss_chars and loss_sha256 (text under the mask), formatted_chars."""
    bound_batches(formatted.sparkSession)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = chars = formatted_chars = 0
        turns, loss = sha256(), sha256()
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_py()
                starts, ends, mask = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("starts", "ends", "loss"))
                for role, said in parse(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                under = masked_text(text, starts, ends, mask)
                loss.update(under.encode())
                chars, formatted_chars = chars + len(under), formatted_chars + len(text)
                if batch.column("part")[k].as_py() + 1 == batch.column("parts")[k].as_py():
                    out.append((batch.column("conv_id")[k].as_py(), n, turns.hexdigest(), chars, loss.hexdigest(), formatted_chars))
                    n = chars = formatted_chars = 0
                    turns, loss = sha256(), sha256()
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    told = formatted.select("conv_id", "part", "parts", "text", "starts", "ends", "loss")
    schema = DIGEST.format(conv=dict(formatted.dtypes)["conv_id"])
    long_ = told.where("parts > 1").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return told.where("parts = 1").mapInArrow(check, schema).unionByName(long_.mapInArrow(check, schema))


def read_formatted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

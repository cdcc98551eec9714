"""Ids of the strings that texts are cut to, for a whole batch at once in Arrow arrays.

Texts of a batch share most of their strings, so each different one is encoded once. Those that were met last are kept
from batch to batch: at most ``most`` of them, none over ``LONGEST`` bytes, which bounds what a worker holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONGEST = 64


def take_lists(lists: pa.ListArray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the lists at these places, one after another, and how many each has."""
    taken = lists.take(pa.array(at))
    return taken.flatten().to_numpy(), taken.value_lengths().to_numpy().astype(np.int64)


def as_lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """Lists of values; list k ends before ends[k]."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, pa.int32()))


class KnownIds:
    """Id lists of strings, by learn for those that aren't known. The most that were met last are kept."""

    def __init__(self, learn: Callable[[list[str]], pa.ListArray], most: int):
        self.learn, self.most = learn, most
        self.keys, self.ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))

    def of(self, keys: pa.Array) -> pa.ListArray:
        """The ids of different keys."""
        place = pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy().copy()
        new = np.flatnonzero(place < 0)
        idle = np.ones(len(self.keys), bool)
        idle[place[place >= 0]] = False
        place[new] = len(self.keys) + np.arange(len(new))
        out = pa.concat_arrays([self.ids, self.learn(keys.take(pa.array(new)).to_pylist())]).take(pa.array(place))
        short = pa.array(pc.binary_length(keys).to_numpy() <= LONGEST)
        idle = pa.array(np.flatnonzero(idle))
        self.keys = pa.concat_arrays([keys.filter(short), self.keys.take(idle)]).slice(0, self.most)
        self.ids = pa.concat_arrays([out.filter(short), self.ids.take(idle)]).slice(0, self.most)
        return out

    def in_order(self, keys: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of keys[codes], one after another, and how many each has. Keys that no code names aren't met."""
        used = np.flatnonzero(np.bincount(codes, minlength=len(keys)))
        at = np.zeros(len(keys), np.int64)
        at[used] = np.arange(len(used))
        return take_lists(self.of(keys.take(pa.array(used))), at[codes])


def text_arrays(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts (columns doc_id and text) of some batches at a time, as many as have so many bytes."""
    ids, texts, held = [], [], 0
    for batch in batches:
        ids.append(batch.column("doc_id"))
        texts.append(batch.column("text"))
        held += batch.column("text").nbytes
        if held >= size:
            yield pa.concat_arrays(ids), pa.concat_arrays(texts)
            ids, texts, held = [], [], 0
    if ids:
        yield pa.concat_arrays(ids), pa.concat_arrays(texts)

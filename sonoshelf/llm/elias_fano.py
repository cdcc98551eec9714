"""Elias-Fano sequences and packed integers over memory-mapped arrays, queried in bulk."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np
from pyarrow import fs

_BYTE_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: Place of the k-th set bit of a byte.
_BYTE_SELECT = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint8)
_U = np.uint64


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file with all arrays, put in place at once, so a task that runs twice leaves a whole file."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (str(a.dtype), list(a.shape), at)
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    files, path = _opened(uri)
    files.create_dir(os.path.dirname(path))
    part = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8))
    files.move(part, path)


def open_arrays(uri: str) -> dict[str, np.ndarray] | None:
    """The arrays of a file, None if there is none: mapped into memory where the file system is a mounted one, else
    read into it."""
    files, path = _opened(uri)
    if isinstance(files, fs.LocalFileSystem):
        if not os.path.exists(path):
            return None
        raw = np.memmap(path, np.uint8, "r")
    else:
        if files.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with files.open_input_file(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    out = {}
    for name, (kind, shape, at) in json.loads(raw[8 : 8 + size].tobytes()).items():
        n = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = raw[8 + size + at : 8 + size + at + n].view(kind).reshape(shape)
    return out


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """values of so many bits each, one after another in 64-bit words."""
    words = np.zeros(len(values) * bits // 64 + 2, _U)
    if bits:
        at = np.arange(len(values), dtype=np.int64) * bits
        k, s, v = at >> 6, (at & 63).astype(_U), values.astype(_U)
        np.bitwise_or.at(words, k, v << s)
        over = s.astype(np.int64) + bits > 64
        np.bitwise_or.at(words, k[over] + 1, v[over] >> (_U(64) - s[over]))
    return words


def unpack(words: np.ndarray, bits: int, i: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(i), _U)
    at = i.astype(np.int64) * bits
    k, s = at >> 6, (at & 63).astype(_U)
    low = words[k] >> s
    high = np.where(s > 0, words[k + 1] << ((_U(64) - s) & _U(63)), _U(0))
    return (low | high) & _U((1 << bits) - 1)


class EliasFano:
    """A sorted sequence below 2^universe_bits: low bits packed, high bits as a unary bit vector."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.bits = (int(x) for x in arrays[f"{name}.size"])
        self.low, self.high = arrays[f"{name}.low"], arrays[f"{name}.high"]
        self.ones, self.zeros = arrays[f"{name}.ones"], arrays[f"{name}.zeros"]

    @staticmethod
    def build(values: np.ndarray, universe_bits: int, name: str) -> dict[str, np.ndarray]:
        n = len(values)
        bits = max(0, universe_bits - max(1, n).bit_length())
        v = values.astype(_U)
        high = (v >> _U(bits)).astype(np.int64)
        length = n + (1 << (universe_bits - bits)) + 1
        flags = np.zeros(-(-length // 64) * 64, np.uint8)
        flags[high + np.arange(n)] = 1
        words = np.packbits(flags, bitorder="little").view(_U)
        ones = np.concatenate([[0], np.cumsum(flags.reshape(-1, 64).sum(1, dtype=np.int64))])
        zeros = np.arange(len(ones)) * 64 - ones
        return {f"{name}.size": np.array([n, bits]), f"{name}.low": pack(v & _U((1 << bits) - 1), bits), f"{name}.high": words, f"{name}.ones": ones, f"{name}.zeros": zeros}

    def _select(self, k: np.ndarray, counts: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the k-th one, or zero, of the bit vector."""
        w = np.searchsorted(counts, k, side="right") - 1
        word = self.high[w]
        if flip:
            word = ~word
        left, at = k - counts[w], w * 64
        out, open_ = np.zeros(len(k), np.int64), np.ones(len(k), bool)
        for b in range(8):
            byte = (word >> _U(8 * b)).astype(np.uint8)
            here = _BYTE_ONES[byte]
            hit = open_ & (left < here)
            out[hit] = at[hit] + 8 * b + _BYTE_SELECT[byte[hit], left[hit]]
            open_ &= ~hit
            left = np.where(open_, left - here, left)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.int64)
        high = (self._select(i, self.ones, False) - i).astype(_U)
        return high << _U(self.bits) | unpack(self.low, self.bits, i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x in the sequence, or -1: a successor search among those with the same high bits."""
        x = x.astype(_U)
        h = (x >> _U(self.bits)).astype(np.int64)
        start = np.where(h > 0, self._select(np.maximum(h - 1, 0), self.zeros, True) - h + 1, 0)
        end = self._select(h, self.zeros, True) - h
        return search(self.low, self.bits, start, end, x & _U((1 << self.bits) - 1))


def search(words: np.ndarray, bits: int, start: np.ndarray, end: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each x among the packed, sorted values from start to before end, or -1."""
    low, high = start.astype(np.int64), end.astype(np.int64)
    last = high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_]) >> 1
        less = unpack(words, bits, mid) < x[open_]
        low[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]
        open_ = open_[low[open_] < high[open_]]
    out = np.full(len(x), -1, np.int64)
    inside = np.flatnonzero(low < last)
    same = unpack(words, bits, low[inside]) == x[inside]
    out[inside[same]] = low[inside[same]]
    return out

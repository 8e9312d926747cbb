"""Token ids of many texts at once: each distinct unit of a batch is encoded once and its ids are dealt out to all its places."""

from __future__ import annotations

import contextlib
import ctypes
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct units in each of the two generations that a Python worker remembers, and characters of the longest it remembers.
REMEMBERED, LONGEST = 200_000, 40
#: Bytes of text that are worked on at once.
SLICE = 3_000_000


def slices(texts: pa.Array, limit: int = SLICE):
    """Slices of an Arrow text array of about `limit` bytes, one text at least."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("float64")))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield texts.slice(at, to - at)
        at = to


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array without nulls, and the place where each text begins, with the end of the last."""
    _, offsets, data = texts.cast(pa.string()).buffers()
    at = np.frombuffer(offsets, "<i4")[texts.offset : texts.offset + len(texts) + 1].astype("int64")
    return (np.frombuffer(data, "u1") if data else np.zeros(0, "u1"))[at[0] : at[-1]], at - at[0]


class Units:
    """ids of texts through `encode`, which gives the id lists of a list of units."""

    def __init__(self, encode, dtype="<u4", remembered: int = REMEMBERED):
        self.encode, self.dtype, self.young, self.old, self.remembered = encode, np.dtype(dtype), {}, {}, remembered

    def of(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units, one after the other, and the number of ids of each. The units differ from each other."""
        if len(self.young) > self.remembered:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        found = list(map(young.get, units))
        missed = [i for i, x in enumerate(found) if x is None]
        new = []
        for i in missed:
            found[i] = old.get(units[i])
            if found[i] is None:
                new.append(i)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for i, ids in zip(part, self.encode([units[i] for i in part]), strict=True):
                found[i] = np.array(ids, self.dtype).tobytes()
        for i in missed:
            if len(units[i]) <= LONGEST:
                young[units[i]] = found[i]
        return np.frombuffer(b"".join(found), self.dtype), np.fromiter(map(len, found), "int64", len(found)) // self.dtype.itemsize

    def deal(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: UTF-8 bytes; starts: where each unit begins (it goes on to the next); ends: where each text ends. Gives all ids, and
        the ids up to the end of each text."""
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(len(ends), "int64")
        offsets = np.append(starts, len(data)).astype("<i4")
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        codes = coded.indices.to_numpy()
        ids, n = self.of(coded.dictionary.to_pylist())
        first, each = (np.cumsum(n) - n)[codes], n[codes]
        upto = np.concatenate([[0], np.cumsum(each)])
        places = np.repeat(first - upto[:-1], each) + np.arange(upto[-1])
        return ids[places], upto[np.searchsorted(starts, ends)]


def simple_first(simple, one, many):
    """An `encode` for Units: units that match the pattern `simple` are a single word of the vocabulary's rules and go straight to the
    merges (`one`); the others go through all rules (`many`)."""

    def encode(units: list[str]) -> list:
        plain = [simple(u) is not None for u in units]
        rest = iter(many([u for u, p in zip(units, plain, strict=True) if not p]))
        return [one(u) if p else next(rest) for u, p in zip(units, plain, strict=True)]

    return encode


def quiet() -> None:
    """The tokenizers library would start a thread for each core of the machine; Spark has already one task on each."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def release() -> None:
    """Gives freed memory of a Python worker back to the system, as workers stay for the next stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)

"""Recursive character chunks, as an Arrow function from a text to its chunks."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.schema import SETTINGS

#: Separators from the coarsest to none.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def check_window(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("chunk size must be positive and the overlap less than it, from 0 on")


def _cut(text: str, separator: str) -> list[str]:
    """Pieces, each with the separator before it."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Joins neighbouring pieces up to `size`; a chunk begins with the last pieces of the one before, up to `overlap`."""
    out, held, total = [], [], 0
    for piece in pieces:
        if held and total + len(piece) > size:
            out.append("".join(held).strip())
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    out.append("".join(held).strip())
    return [c for c in out if c]


def recursive_chunks(text: str | None, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    if not (text or "").strip():
        return []
    at = next(i for i, s in enumerate(separators) if s in text)
    finer, out, small = separators[at + 1 :], [], []
    for piece in _cut(text, separators[at]):
        if len(piece) < size:
            small.append(piece)
            continue
        if small:
            out += _pack(small, size, overlap)
            small = []
        out += recursive_chunks(piece, size, overlap, finer) if finer else [piece]
    return out + (_pack(small, size, overlap) if small else [])


#: Characters of chunks that leave a task at once.
AT_ONCE = 4 << 20


def chunk_rows(size: int, overlap: int):
    """A function from Arrow batches of document_id and text to a row for each chunk: document_id, node_index, content. A task holds the chunks of AT_ONCE
    characters, and of one text, whatever the batch has. A wrong window is an error at once."""
    check_window(size, overlap)
    names = ["document_id", "node_index", "content"]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string()), strict=True)], names=names)

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                own, d = recursive_chunks(batch.column("text")[i].as_py(), size, overlap), batch.column("document_id")[i].as_py()
                rows += [(d, k, c) for k, c in enumerate(own)]
                held += sum(map(len, own))
                if held > AT_ONCE:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return run


def chunks(c: Column, size: int = SETTINGS.chunk_size, overlap: int = SETTINGS.chunk_overlap) -> Column:
    """array<string>; blank texts give none. A wrong window is an error when the plan is built."""
    check_window(size, overlap)

    @F.pandas_udf("array<string>")
    def split(s: pd.Series) -> pd.Series:
        return s.map(lambda t: recursive_chunks(t, size, overlap))

    return split(c)

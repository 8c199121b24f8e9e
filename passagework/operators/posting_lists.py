"""Posting lists of blocks of passages, packed: what a task writes of its passages, and how a search reads it.

A block is some thousand passages of one task. A list has the places in its block of the
passages with a term, as steps from one to the next, and then how often each has it: whole
numbers of seven bits a byte, so nearly all take one byte. What the postings of a passage
share, its id and its lengths by field, is stored once for a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import types as T

SEPARATOR = "\u001f"
PASSAGES_PER_STEP = 1000  # passages that a task codes at once
PASSAGES_PER_BLOCK = 1 << 15
POSTINGS_PER_BLOCK = 2_000_000
POSTINGS_PER_BATCH = 250_000  # postings that a task packs at once; one list may have more
SCHEMA = (
    T.StructType()
    .add("field", T.StringType()).add("term", T.StringType()).add("block", T.LongType()).add("n", T.IntegerType()).add("packed", T.BinaryType())
    .add("ids", T.ArrayType(T.StringType())).add("lens", T.ArrayType(T.IntegerType())).add("norms", T.ArrayType(T.DoubleType()))
)
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.float64())]


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of whole numbers, low seven bits first and the last byte below 128; and where each number ends."""
    size, rest = np.ones(len(values), np.int64), values >> 7
    while rest.any():
        size += rest > 0
        rest >>= 7
    ends = np.cumsum(size)
    packed = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(size.max(initial=0)):
        more = np.flatnonzero(size > k)
        packed[ends[more] - size[more] + k] = (values[more] >> 7 * k & 127) | np.where(size[more] > k + 1, 128, 0)
    return packed, ends


def unpack(packed: np.ndarray) -> np.ndarray:
    if not len(packed):
        return np.empty(0, np.int64)
    last = np.flatnonzero(packed < 128)
    starts = np.append(0, last[:-1] + 1)
    shift = 7 * (np.arange(len(packed)) - np.repeat(starts, last - starts + 1))
    return np.add.reduceat((packed & 127).astype(np.int64) << shift, starts)


def _steps_first(n: np.ndarray) -> np.ndarray:
    """Where the steps of lists of ``n`` postings stand when each list's counts follow its steps."""
    return np.arange(n.sum()) + np.repeat(np.cumsum(n) - n, n)


def _batch(**columns: object) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    arrays = [columns.get(name, [None] * n) for name in SCHEMA.names]
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, kind) for a, kind in zip(arrays, _TYPES)], names=SCHEMA.names)


def block_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the passages of a task, from ``passage_id`` and the members of its entries."""
    yield from blocks(batches, TaskContext.get().partitionId() << 32)


def blocks(batches: Iterator[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
    """Blocks numbered from ``number``."""
    held = []
    for batch in batches:
        for begin in range(0, batch.num_rows, PASSAGES_PER_STEP):
            held.append(_coded(batch.slice(begin, PASSAGES_PER_STEP)))
            if sum(len(h[0]) for h in held) >= PASSAGES_PER_BLOCK or sum(len(h[1]) for h in held) >= POSTINGS_PER_BLOCK:
                yield from _block(held, number)
                number, held = number + 1, []
    if held:
        yield from _block(held, number)


def _coded(rows: pa.RecordBatch) -> tuple:
    """Ids; place, count and name of every entry, with the names; place, len and norm by field."""
    field, term, tf = (rows.column(c).flatten() for c in ("field", "term", "tf"))
    place = np.repeat(np.arange(rows.num_rows, dtype=np.int32), rows.column("tf").value_lengths().to_numpy(zero_copy_only=False))
    names = pc.binary_join_element_wise(field, term, SEPARATOR).dictionary_encode()
    fields = field.dictionary_encode()
    of = fields.indices.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (of[1:] != of[:-1]))[: len(of)])  # a field's entries stand together
    lens, norms = (rows.column(c).flatten().to_numpy(zero_copy_only=False)[first] for c in ("len", "norm"))
    sizes = {f: (place[at := first[of[first] == i]], lens[of[first] == i], norms[of[first] == i]) for i, f in enumerate(fields.dictionary.to_pylist())}
    # copies, so that the batch is not kept
    return rows.column("passage_id").to_pylist(), place, tf.to_numpy(zero_copy_only=False).copy(), names.indices.to_numpy(zero_copy_only=False).copy(), names.dictionary, sizes


def _block(held: list[tuple], block: int) -> Iterator[pa.RecordBatch]:
    ids = [i for h in held for i in h[0]]
    base = np.cumsum([0] + [len(h[0]) for h in held], dtype=np.int32)[:-1]
    yield _batch(block=[block], n=[len(ids)], ids=[ids])
    for f in sorted({f for h in held for f in h[5]}):
        lens, norms = np.zeros(len(ids), np.int32), np.zeros(len(ids))
        for start, h in zip(base, held):
            if f in h[5]:
                place, size, norm = h[5][f]
                lens[start + place], norms[start + place] = size, norm
        yield _batch(field=[f], block=[block], n=[int((lens > 0).sum())], lens=[lens], norms=[norms])
    every = pa.concat_arrays([h[4] for h in held]).dictionary_encode()
    codes, begin = every.indices.to_numpy(zero_copy_only=False), np.cumsum([0] + [len(h[4]) for h in held])
    code = np.concatenate([codes[b : b + len(h[4])][h[3]] for b, h in zip(begin, held)])
    order = np.argsort(code, kind="stable")
    place = np.concatenate([start + h[1] for start, h in zip(base, held)])[order]
    tf = np.concatenate([h[2] for h in held])[order]
    n = np.bincount(code, minlength=len(every.dictionary))
    ends, first = np.cumsum(n), 0
    while first < len(n):
        start = ends[first] - n[first]
        last = max(first + 1, int(np.searchsorted(ends, start + POSTINGS_PER_BATCH, side="right")))
        names = [name.split(SEPARATOR, 1) for name in every.dictionary.slice(first, last - first).to_pylist()]
        packed = _packed(n[first:last], place[start : ends[last - 1]], tf[start : ends[last - 1]])
        yield _batch(field=[f for f, _ in names], term=[t for _, t in names], block=np.full(last - first, block), n=n[first:last], packed=packed)
        first = last


def _packed(n: np.ndarray, place: np.ndarray, tf: np.ndarray) -> pa.Array:
    """The lists of ``n`` postings each, one after another."""
    steps = np.diff(place, prepend=0)
    starts = np.cumsum(n) - n
    steps[starts] = place[starts]
    values, at = np.empty(2 * len(place), np.int64), _steps_first(n)
    values[at], values[at + np.repeat(n, n)] = steps, tf
    packed, ends = pack(values)
    offsets = np.append(0, ends[2 * np.cumsum(n) - 1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])


def postings_of(lists: pa.ChunkedArray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List, place in the block and count of every posting of packed lists."""
    values, at = unpack(np.frombuffer(b"".join(lists.to_pylist()), np.uint8)), _steps_first(n)
    owner = np.repeat(np.arange(len(n)), n)
    steps, tf = values[at], values[at + n[owner]]
    place = np.cumsum(steps)
    starts = np.cumsum(n) - n
    return owner, place - (place[starts] - steps[starts])[owner], tf

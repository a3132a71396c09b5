"""How often hashes occur over all blocks of a corpus, counted with one row per block and bucket.

A block is a run of an input partition's documents; its distinct hashes are dealt into buckets, packed, and merged
by bucket; a class of frequency for each comes back to the block, one byte per hash. A bucket has one entry
per block for a hash, so a hash that all documents hold is no larger than the number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarry.llm.words import mix

#: Bytes of text of a block; buckets per input partition; bytes of a hash that are counted. Hashes that share those
#: bytes share a class, which may only be too high then: a frequency is an order to all who ask, never a proof.
BLOCK_BYTES, PER_BLOCK, HASH_BYTES = 1 << 22, 2, 6
PACKED = "bucket int, block long, hashes binary, counts binary"
CLASSES = "bucket int, block long, classes binary"


def numbered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a partition (the text last) in blocks of about ``size`` bytes of text, with the block's number."""
    from pyspark import TaskContext

    block, filled, held = TaskContext.get().partitionId() << 24, 0, []
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy()
        start = 0
        for i, more in enumerate(lengths.tolist()):
            filled += more
            if filled >= size:
                held.append(batch.slice(start, i + 1 - start))
                yield block, pa.Table.from_batches(held)
                block, filled, held, start = block + 1, 0, [], i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield block, pa.Table.from_batches(held)


def cut(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of hashes by bucket, and where each bucket ends; hashes with the same counted bytes share a bucket."""
    bucket = (mix(hashes >> np.uint64(64 - 8 * HASH_BYTES)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def packed(block: int, distinct: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A block's distinct hashes and their counts, one row per bucket."""
    order, ends = cut(distinct, buckets)
    values = distinct[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES:]
    many = counts[order].astype("<u4")
    some = np.flatnonzero(ends[1:] > ends[:-1])
    return pa.RecordBatch.from_arrays(
        [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), block, np.int64)),
         pa.array([values[ends[b]:ends[b + 1]].tobytes() for b in some], pa.binary()),
         pa.array([many[ends[b]:ends[b + 1]].tobytes() for b in some], pa.binary())], ["bucket", "block", "hashes", "counts"])


def frequencies(table: pa.Table) -> pa.Table:
    """Group function: the rows of a bucket -> bucket, block, classes: of each hash, 0 if its count over all blocks
    is one, else the power of two of that count, plus one."""
    lists = []
    for x in table.column("hashes").to_pylist():
        wide = np.zeros((len(x) // HASH_BYTES, 8), np.uint8)
        wide[:, :HASH_BYTES] = np.frombuffer(x, np.uint8).reshape(-1, HASH_BYTES)
        lists.append(wide.reshape(-1).view("<u8"))
    many = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()]).astype(np.float64)
    _, place = np.unique(np.concatenate(lists), return_inverse=True)
    classes = np.log2(np.bincount(place, many)).astype(np.uint8) + (np.bincount(place, many) > 1)
    found, cuts = classes[place].astype(np.uint8), np.cumsum([0, *map(len, lists)])
    return pa.table({"bucket": table.column("bucket"), "block": table.column("block"),
                     "classes": pa.array([found[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def unpacked(distinct: np.ndarray, classes: pa.Table, buckets: int) -> np.ndarray:
    """The class of each of a block's distinct hashes, from the rows that came back to the block."""
    order, ends = cut(distinct, buckets)
    out = np.zeros(len(distinct), np.uint8)
    for bucket, found in zip(classes.column("bucket").to_pylist(), classes.column("classes").to_pylist(), strict=True):
        out[order[ends[bucket]:ends[bucket + 1]]] = np.frombuffer(found, np.uint8)
    return out

"""Counting for chunks of documents: each chunk asks shards of the key space once a distinct key, and gets answers back.

A chunk is what one task holds of its documents. It sends each shard one packet of sorted distinct keys with counts; a
shard merges the packets of all chunks and answers each in the order of its packet. A key that every document has costs
one entry a chunk, so nothing gets hot, and neither texts nor postings move.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKETS = "chunk long, shard int, packet binary"
PACKETS_TYPES = pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("packet", pa.binary())])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 on, compressed: rising ones as differences, all by planes of bytes."""
    parts = []
    for a in arrays:
        a = np.asarray(a)
        a = a.astype(np.uint64, copy=False) if a.dtype != np.uint8 else a
        rising = a.dtype != np.uint8 and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        if rising:
            a = np.concatenate([a[:1], np.diff(a)])
        width = 1 if a.dtype == np.uint8 or not len(a) else max(1, (int(a.max()).bit_length() + 7) // 8)
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1)[:, :width].T) if len(a) else a
        parts.append(struct.pack("<qBB", len(a), width, rising) + planes.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(packed: bytes) -> list[np.ndarray]:
    """The arrays, as int64."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(packed), 0, []
    while at < len(raw):
        n, width, rising = struct.unpack_from("<qBB", raw, at)
        at += struct.calcsize("<qBB")
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        at += n * width
        a = a.reshape(-1).view(np.int64)
        out.append(np.cumsum(a) if rising else a)
    return out


def dealt(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(shard, its slice) for shard numbers in order."""
    if not len(shard):
        return
    starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    for low, high in zip(starts, [*starts[1:], len(shard)], strict=True):
        yield int(shard[low]), slice(int(low), int(high))


def packet_batch(chunk: int, packets: Sequence[tuple[int, bytes]]) -> pa.Table:
    shards, packed = ([p[i] for p in packets] for i in (0, 1))
    return pa.Table.from_arrays([pa.array([chunk] * len(packets), pa.int64()), pa.array(shards, pa.int32()), pa.array(packed, pa.binary())], schema=PACKETS_TYPES)


def answers(packets: DataFrame, answer: Callable[[int, list[list[np.ndarray]]], list[bytes]]) -> DataFrame:
    """(chunk, shard, packet): the shards' answers to packets; answer(shard, packets in order of chunk) gives one for each."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        said = answer(rows["shard"][0].as_py(), [unpack(p) for p in rows["packet"].to_pylist()])
        return rows.set_column(rows.schema.get_field_index("packet"), "packet", pa.array(said, pa.binary())).select(["chunk", "shard", "packet"]).cast(PACKETS_TYPES)

    return packets.groupBy("shard").applyInArrow(run, PACKETS)


def received(rows: pa.Table) -> list[list[np.ndarray]]:
    """A chunk's answers, in order of shard."""
    return [unpack(p) for p in rows.sort_by("shard")["packet"].to_pylist()]


def shards_for(total: int, each: int) -> int:
    return max(1, -(-total // each))


def mixed_bits(keys: np.ndarray) -> np.ndarray:
    """Whole numbers spread evenly over 63 bits (a finaliser of multiplications and shifts)."""
    x = keys.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def let_go(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of steps that are over; it notices them when the driver's JVM collects garbage."""
    spark.sparkContext._jvm.System.gc()


def total(df: DataFrame, column: str) -> int:
    return df.agg(F.coalesce(F.sum(column), F.lit(0)).cast("long")).first()[0]

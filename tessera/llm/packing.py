"""Packing tokenised documents into sequences of bounded length by the sum-of-squares rule.

The rule: N(g) open sequences have g free tokens. A piece of length s goes where the sum of all N(g)^2 (g > 0) becomes
smallest: into a sequence with gap g, which costs 2 (N(g-s) - N(g) + 1), or into a new one of gap capacity - s, which
costs 2 N(capacity - s) + 1. It keeps the gaps diverse, so that a fitting one is at hand for nearly any piece.

Only lengths matter for that, so the tokens never move: tasks tokenise and hand on (document, piece, length), these are
dealt by hash into shards of about SHARD pieces, and each shard is packed by itself, long pieces first. A shard leaves
few sequences open, so sharding costs a small share (see the README).
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import kind_of, table, written

CAPACITY, END_ID = 4096, 1
#: Pieces packed by one task; at most about twice that.
SHARD = 20_000
#: Chunks of text whose ids a worker process keeps; at the limit it starts afresh. Bounds memory only (about 0.2 GB).
REMEMBERED = 800_000

#: In texts of these characters alone, white space separates what the tokenizer splits and folds, so chunks between white space are
#: encoded one by one and remembered. Any other text, and one with a special token's opening, goes through the tokenizer whole.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*")
_SPECIAL = "<|"
#: How the tokenizer file says that a chunk is split, and the same for the characters above in Python's syntax.
SPLIT_OF_FILE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\sa-zA-Z0-9\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+")

PIECES = "row long, doc_id {}, piece int, start long, length long, ids_crc32 long"
PLACED = "doc_id {}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte: itself if it is printable, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """Token ids of texts, as packed little-endian unsigned 32-bit integers. The dict holds those of chunks."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._merge = self._tokenizer.model.tokenize
        self._letters = _byte_letters()
        steps = (json.loads(self._tokenizer.to_str())["pre_tokenizer"] or {}).get("pretokenizers", [])
        self._known_split = [s.get("pattern", {}).get("Regex") for s in steps] == [SPLIT_OF_FILE, None]

    def _whole(self, text: str) -> bytes:
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        if self._known_split:
            words = (w if w.isascii() else "".join(map(self._letters.__getitem__, w.encode())) for w in _SPLIT.findall(chunk))
            ids = [t.id for w in words for t in self._merge(w)]
            self[chunk] = packed_ids = struct.pack(f"<{len(ids)}I", *ids)
        else:
            self[chunk] = packed_ids = self._whole(chunk)
        return packed_ids

    def encode(self, text: str) -> bytes:
        if _SPECIAL in text or not _PLAIN.fullmatch(text):
            return self._whole(text)
        return b"".join(map(self.__getitem__, text.lower().split()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker process, so that what it remembers serves all its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces_of(path: str, capacity: int, end_id: int):
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for row, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = code.encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((row, doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), batch.schema.field(1).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32) of each document's ids and end_id, cut every capacity ids; row tells repeated rows apart."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pieces_of(tokenizer_path, capacity, end_id), PIECES.format(kind_of(rows, "doc_id")))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, placed in the given order. Ties go to the smallest gap, an old sequence before a new one."""
    n = np.zeros(capacity + 1, dtype=np.int64)  # n[0] stays 0: full sequences don't count
    with_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, new = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    closed = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        held = n[s:]
        cost = np.where(held > 0, 2 * (n[: capacity + 1 - s] - held + 1), closed)
        if s <= capacity:
            cost[0] = 1 - 2 * held[0] if held[0] else closed  # a full sequence leaves the sum
        g = int(cost.argmin())
        if cost[g] != closed and cost[g] <= 2 * n[capacity - s] + 1:
            g += s
            at = with_gap[g].pop()
            n[g] -= 1
        else:
            g, at, new = capacity, new, new + 1
        sequence[i], offset[i] = at, capacity - g
        left = g - s
        if left:
            with_gap[left].append(at)
            n[left] += 1
    return sequence, offset


def _pack_shard(capacity: int):
    def run(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "doc_id", "row", "piece"], ascending=[False, True, True, True], kind="stable")
        sequence, shard["offset"] = sum_of_squares(shard["length"].to_numpy(), capacity)
        shard["sequence_id"] = (key[0] << 32) + sequence
        return shard[[x.split()[0] for x in PLACED.split(", ")]]

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """pieces with sequence_id and offset: gapless from 0 in each sequence. An empty table gives an empty result."""
    n_shards = max(1, -(-pieces.count() // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(n_shards)))
    return dealt.groupBy("shard").applyInPandas(_pack_shard(capacity), PLACED.format(kind_of(pieces, "doc_id")))


def packed(docs: DataFrame, spark: SparkSession, tokenizer_path: str | None = None, **kind) -> DataFrame:
    """Places of all pieces of docs. Null texts are empty and give a piece of one id; rows with one id are packed each for itself. Only ids and texts are read, whatever else docs has."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack(written(tokenised_pieces(docs, tokenizer_path, **kind), spark, "pieces"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), spark)

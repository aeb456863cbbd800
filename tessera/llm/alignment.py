"""Alignment of two tokenizers' vocabularies by inverted pair bitmaps.

A text's tokens of both kinds are cut into groups where tokens of both end at the same byte; within a group every A token
links with every B token. For each chunk of documents, every linked pair of ids has a compressed bitmap of the chunk's
documents that hold it (16-bit document numbers, or plain bits where these are smaller), and planes for its further links:
bit p of a document's links less one is in plane p, whose documents weigh 2^p.

A chunk's bitmaps are OR-merged from its documents one after another. Chunks have different documents, so the popcount of
the OR of all chunks' bitmaps is the sum of their popcounts: chunks send (pair, popcount) to shards of A ids, which add them
up, find each A id's highest count and answer. Each posting then returns its pair's count to its document.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, kind_of, table, written
from tessera.llm.exchange import PACKETS, answers, dealt, mixed_bits, pack, packet_batch, received, shards_for, total, unpack
from tessera.llm.packing import _byte_letters

#: Postings and documents after which a chunk ends; distinct pairs of all chunks for which a shard is made.
POSTINGS, DOCUMENTS, SHARD = 3_000_000, 1 << 16, 500_000
#: Links of a group that are listed one by one; larger groups are counted by distinct ids.
LISTED = 1 << 16
#: Fixed value: how byte-level files of this kind split a text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE_MARK = "▁"


class ByteTokens:
    """Ids by a byte-level BPE file, and each id's bytes.

    Where the file's merges are in order of id and split as SPLIT says, they are run as ranks, which is several times as fast
    as the file's own tokenizer and gives the same ids; else, and for texts that this refuses, the file's own runs.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._own = Tokenizer.from_file(path)
        self._own.encode_special_tokens = True
        byte_of = {c: b for b, c in _byte_letters().items()}
        file = json.loads(self._own.to_str())
        added = {t["content"] for t in file["added_tokens"]}
        self.bytes = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in file["model"]["vocab"].items() if t not in added}
        vocab = file["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        split = file["pre_tokenizer"] or {}
        ranked = file["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self._ranks = None
        if ranked and [vocab.get(a + b) for a, b in merges] == list(range(256, 256 + len(merges))):
            import tiktoken

            self._ranks = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self._ranks is not None:
            try:
                return self._ranks.encode_ordinary(text)
            except (ValueError, RuntimeError):  # a run of characters too long for its pattern
                pass
        return self._own.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """Ids by a sentencepiece model, and each id's bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = {i: bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace(SPACE_MARK, " ").encode() for i in range(m.get_piece_size())}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


class Aligner:
    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        tables = [(t.bytes, max(t.bytes) + 1) for t in (self.a, self.b)]
        self._sizes = [np.array([len(known.get(i, b"")) for i in range(n)], np.int64) for known, n in tables]
        # an id as text, by whether it is its group's last
        self._said = [np.array([[b"%d%s" % (i, end) for i in range(n)] for end in (b",", last)], object) for (_, n), last in zip(tables, (b"|", b";"), strict=True)]

    def align(self, text: str, b_ids: list[int]) -> tuple | None:
        """(n_a, n_b, n_groups, n_links, sha, pairs, links of each): pairs are A id << 32 | B id. None if the text has no tokens."""
        want, a_ids = (" " + text).encode(), self.a.encode(" " + text)
        if b"".join(map(self.a.bytes.get, a_ids)) != want or b"".join(map(self.b.bytes.get, b_ids)) != want:
            return None
        a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        end_a, end_b = np.cumsum(self._sizes[0][a]), np.cumsum(self._sizes[1][b])
        cuts = np.intersect1d(end_a, end_b)
        of_a, of_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        n_a, n_b = np.bincount(of_a, minlength=len(cuts)), np.bincount(of_b, minlength=len(cuts))
        past_a, past_b = np.cumsum(n_a), np.cumsum(n_b)
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + (past_b - n_b)[of_a]] = self._said[0][(np.arange(len(a)) == past_a[of_a] - 1).astype(int), a]
        out[np.arange(len(b)) + past_a[of_b]] = self._said[1][(np.arange(len(b)) == past_b[of_b] - 1).astype(int), b]
        sha = hashlib.sha256(b"".join(out.tolist())[:-1]).hexdigest()
        n_links = n_a * n_b
        large = n_links > LISTED
        listed = np.flatnonzero(~large[of_a])
        each = n_b[of_a[listed]]
        first = np.repeat((past_b - n_b)[of_a[listed]] - (np.cumsum(each) - each), each)
        pairs, links = np.unique(np.repeat(a[listed], each) << 32 | b[first + np.arange(len(first))], return_counts=True)
        if large.any():
            more = [(pairs, links)]
            for g in np.flatnonzero(large):
                (ua, ca), (ub, cb) = (np.unique(x[past[g] - n[g] : past[g]], return_counts=True) for x, past, n in ((a, past_a, n_a), (b, past_b, n_b)))
                more.append(((ua[:, None] << 32 | ub).ravel(), np.outer(ca, cb).ravel()))
            pairs, at = np.unique(np.concatenate([p for p, _ in more]), return_inverse=True)
            links = np.zeros(len(pairs), np.int64)
            np.add.at(links, at, np.concatenate([n for _, n in more]))
        return len(a), len(b), len(cuts), int(n_links.sum()), sha, pairs, links


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One a worker process."""
    key = (path_a, path_b)
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def bitmaps(place: np.ndarray, docs: np.ndarray, weight: int, n_docs: int) -> list[np.ndarray]:
    """Bitmaps of documents for the pairs at `place` (sorted, with their documents): [weight, sparse places, lengths, documents, dense places, bits]."""
    at, n = np.unique(place, return_counts=True)
    width = -(-n_docs // 8)
    dense = 2 * n > width
    bits = np.zeros((int(dense.sum()), width), np.uint8)
    thick = np.repeat(dense, n)
    row = np.repeat(np.cumsum(dense) - 1, n)[thick]
    np.bitwise_or.at(bits, (row, docs[thick] >> 3), (1 << (docs[thick] & 7)).astype(np.uint8))
    return [np.array([weight]), at[~dense], n[~dense], docs[~thick], at[dense], bits.ravel()]


def popcounts(maps: list[np.ndarray], n_pairs: int) -> np.ndarray:
    """Documents of each pair."""
    _, sparse, n, _, dense, bits = maps
    out = np.zeros(n_pairs, np.int64)
    out[sparse] = n
    out[dense] = np.bitwise_count(bits.astype(np.uint8)).reshape(len(dense), -1).sum(axis=1, dtype=np.int64) if len(dense) else 0
    return out


def returned(maps: list[np.ndarray], value: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document, the sum of the values of the pairs whose bitmap holds it, times the plane's weight."""
    weight, sparse, n, docs, dense, bits = maps
    out = np.bincount(docs, np.repeat(value[sparse], n).astype(np.float64), n_docs).astype(np.int64)
    bits = bits.astype(np.uint8).reshape(len(dense), -1 if len(dense) else 0)
    for part in range(0, len(dense), 64):
        out += value[dense[part : part + 64]] @ np.unpackbits(bits[part : part + 64], axis=1, count=n_docs, bitorder="little").astype(np.int64)
    return out * int(weight[0])


def _chunks(path_a: str, path_b: str, postings: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = aligner(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        ids, said, shas, held, size = [], [], [], [], 0

        def chunk() -> pa.RecordBatch:
            pairs = np.concatenate([p for p, _ in held]) if held else np.empty(0, np.int64)
            links = np.concatenate([n for _, n in held]) if held else pairs
            docs = np.repeat(np.arange(len(ids)), [len(p) for p, _ in held])
            order = np.argsort(pairs, kind="stable")
            keys, place = np.unique(pairs[order], return_inverse=True)
            docs, more = docs[order], links[order] - 1
            planes = [bitmaps(place, docs, 1, len(ids))]
            for p in range(int(more.max(initial=0)).bit_length()):
                has = (more >> p & 1).astype(bool)
                planes.append(bitmaps(place[has], docs[has], 1 << p, len(ids)))
            sums = np.array(said, np.int64).reshape(-1, 4).T
            n = popcounts(planes[0], len(keys))
            cells = [number, ids, shas, pack(*sums), pack(keys >> 32, keys & 0xFFFFFFFF, n), [pack(*m) for m in planes], len(keys)]
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in range(0, len(texts), 64):
                some = texts[part : part + 64]
                for text, b_ids, doc_id in zip(some, code.b.encode(some), batch.column(0).slice(part, 64).to_pylist(), strict=True):
                    got = code.align(text, b_ids) if text else None
                    ids.append(doc_id)
                    said.append(got[:4] if got else (0, 0, 0, 0))
                    shas.append(got[4] if got else "")
                    held.append(got[5:] if got else (np.empty(0, np.int64), np.empty(0, np.int64)))
                    size += len(held[-1][0])
                    if size >= postings or len(ids) >= DOCUMENTS:
                        yield chunk()
                        number += 1
                        ids, said, shas, held, size = [], [], [], [], 0
        if ids:
            yield chunk()

    return run


def _order(a: np.ndarray, b: np.ndarray, n_shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a chunk's pairs by shard of the A id, and the shards in that order."""
    shard = mixed_bits(a) % n_shards
    order = np.lexsort((b, a, shard))
    return order, shard[order]


def _ask(n_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pairs in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                a, b, n = unpack(pairs)
                order, shard = _order(a, b, n_shards)
                a, b, n = a[order], b[order], n[order]
                yield from packet_batch(chunk, [(s, pack(a[at], b[at], n[at])) for s, at in dealt(shard)]).to_batches()

    return run


def _add_up(shard: int, packets: list[list[np.ndarray]]) -> list[bytes]:
    """For each pair of each packet: how many documents of all chunks hold it, and whether no pair of its A id has more."""
    keys = np.concatenate([a << 32 | b for a, b, _ in packets])
    unique, at = np.unique(keys, return_inverse=True)
    n = np.zeros(len(unique), np.int64)
    np.add.at(n, at, np.concatenate([c for *_, c in packets]))
    starts = np.flatnonzero(np.concatenate([[True], (unique[1:] >> 32) != (unique[:-1] >> 32)]))
    highest = np.repeat(np.maximum.reduceat(n, starts), np.diff([*starts, len(unique)]))
    best = (n == highest).astype(np.int64)
    return [pack(n[i], best[i]) for i in np.split(at, np.cumsum([len(a) for a, *_ in packets])[:-1])]


def _scores(n_shards: int, schema: pa.Schema):
    def run(chunks: pa.Table, said: pa.Table) -> pa.Table:
        c = chunks.to_pylist()[0]
        sums = unpack(c["sums"])
        a, b, _ = unpack(c["pairs"])
        counts, best = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        if len(a):
            order, _ = _order(a, b, n_shards)
            got = received(said)
            counts[order], best[order] = np.concatenate([n for n, _ in got]), np.concatenate([x for _, x in got])
        n_docs = len(c["doc_ids"])
        n_best, count_sum = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
        for plane in c["planes"]:
            maps = unpack(plane)
            n_best += returned(maps, best, n_docs)
            count_sum += returned(maps, counts, n_docs)
        cells = [c["doc_ids"], *sums, n_best, count_sum, c["shas"]]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(cells, schema, strict=True)], schema=schema)

    return run


def _chunked(docs: DataFrame, spark: SparkSession, path_a: str, path_b: str, id_col: str, text_col: str, postings: int) -> tuple[DataFrame, DataFrame, int]:
    """The chunks, the answers that they get, and the number of shards."""
    kind = kind_of(docs, id_col)
    kinds = f"chunk long, doc_ids array<{kind}>, shas array<string>, sums binary, pairs binary, planes array<binary>, n_pairs long"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chunks = written(rows.mapInArrow(_chunks(path_a, path_b, postings, arrow_schema(kinds)), kinds), spark, "alignment")
    n_shards = shards_for(total(chunks, "n_pairs"), SHARD)
    packets = chunks.select("chunk", "pairs").mapInArrow(_ask(n_shards), PACKETS)
    return chunks, answers(packets, _add_up), n_shards


def alignment(docs: DataFrame, spark: SparkSession, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", postings: int = POSTINGS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of docs.

    path_a is a byte-level BPE file, path_b a sentencepiece model. Null and empty texts, and those that either tokenizer
    doesn't give back byte for byte, have no tokens: zeros and an empty hash. Repeated rows are documents of their own.
    Ids may be null and of any type. An empty table gives an empty result; other columns are not read.
    """
    chunks, said, n_shards = _chunked(docs, spark, path_a, path_b, id_col, text_col, postings)
    kinds = f"doc_id {kind_of(docs, id_col)}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return chunks.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(_scores(n_shards, arrow_schema(kinds)), kinds)


def pair_counts(docs: DataFrame, spark: SparkSession, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", postings: int = POSTINGS) -> DataFrame:
    """(a, b, n_docs, n_links): for each pair of ids that is linked anywhere, its documents and its links in them."""
    chunks, _, _ = _chunked(docs, spark, path_a, path_b, id_col, text_col, postings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, planes in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                a, b, n = unpack(pairs)
                maps = [unpack(p) for p in planes]
                links = sum((int(m[0][0]) * popcounts(m, len(a)) for m in maps), np.zeros(len(a), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, n, links)], ["a", "b", "n_docs", "n_links"])

    each = chunks.select("pairs", "planes").mapInArrow(run, "a long, b long, n_docs long, n_links long")
    return each.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(table(spark, sf_dir, "documents"), spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))

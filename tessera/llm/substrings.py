"""Removing long word runs that occur elsewhere, found by recompression.

Recompression replaces, round by round, what lies inside runs of one symbol and then all pairs of a left and a right
symbol (the sides are drawn by hash) by new symbols. Equal content gets equal names everywhere, so equal strings get
the same symbols but for a few at their ends: each symbol carries the range of words that decided it, and wherever
these words stand, this symbol comes out. A window of WINDOW words owns the symbols that were decided inside it, and
equal windows own equal symbols at equal places.

The first rounds make symbols of a few words, which are common, so tasks name them alone. From then on every round is
one of Spark: a table of names counts every symbol over all texts; a name that occurs once tells that no window which
owns it is repeated. Such windows are closed, symbols that no open window owns are cut out, and the next round goes on
with what is left, so that each round moves less. Names are hashes of what they stand for (words by BLAKE2); should
two contents ever share a name, windows stay open that could be closed, and nothing is lost.

Windows that are still open are verified by their words: they count as equal if the 128-bit BLAKE2 digests of their
words are.

Equal texts (by SHA-256) are merged first: of a text that occurs twice, all windows do; one copy stands for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, written

#: Words of a window; rounds that tasks name alone; rounds that Spark names and counts.
WINDOW, TASK_ROUNDS, SPARK_ROUNDS = 35, 5, 2
#: Bytes of text worked on, and windows digested, at a time within a task; bounds memory only.
CHUNK, WINDOWS_AT_ONCE = 2_000_000, 500_000
#: Words whose names a worker keeps, and the longest of them; at the limit it starts afresh.
REMEMBERED, LONGEST = 500_000, 64

U = np.uint64
_FAR = 1 << 30


class _Names(dict):
    """64-bit names of words."""

    def __missing__(self, word: bytes) -> int:
        name = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = name
        return name


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _shift(a: np.ndarray, by: int, fill) -> np.ndarray:
    out = np.full_like(a, fill)
    if by > 0:
        out[by:] = a[:-by]
    else:
        out[:by] = a[-by:]
    return out


def _squeezed_runs(sym, part, lo, hi):
    """Runs of four or more: all but their first and last symbol become one. lo, hi: the words that decided each symbol."""
    new = np.ones(len(sym), bool)
    new[1:] = (sym[1:] != sym[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(sym)))
    long = n >= 4
    if not long.any():
        return sym, part, lo, hi
    at, n = first[long], n[long]
    sym, lo, hi = sym.copy(), lo.copy(), hi.copy()
    end = at + n
    inside = at + 1
    alone_before = (at == 0) | (part[np.maximum(at - 1, 0)] != part[at])
    alone_after = (end == len(sym)) | (part[np.minimum(end, len(sym) - 1)] != part[at])
    before, after = np.where(alone_before, -_FAR, lo[np.maximum(at - 1, 0)]), np.where(alone_after, _FAR, hi[np.minimum(end, len(sym) - 1)])
    sym[inside] = _mixed(sym[at] * U(3) + (n - 2).astype(U))
    lo[inside], hi[inside] = before, after
    drop = np.zeros(len(sym) + 1, np.int64)
    np.add.at(drop, at + 2, 1)
    np.add.at(drop, end - 1, -1)
    keep = np.cumsum(drop[:-1]) == 0
    return sym[keep], part[keep], lo[keep], hi[keep]


def _paired(sym, part, lo, hi, number: int):
    """Left symbols followed by right ones become one; others remember the neighbour that made them stay single."""
    right = (_mixed(sym + U(number)) >> U(63)).astype(bool)
    follows = np.zeros(len(sym), bool)
    follows[:-1] = part[1:] == part[:-1]
    pair = np.zeros(len(sym), bool)
    pair[:-1] = ~right[:-1] & right[1:] & follows[:-1]
    second = _shift(pair, 1, False)
    single = ~pair & ~second
    precedes = _shift(follows, 1, False)
    n_lo, n_hi, n_sym = _shift(lo, -1, 0), _shift(hi, -1, 0), _shift(sym, -1, 0)
    p_lo, p_hi, p_sym = _shift(lo, 1, 0), _shift(hi, 1, 0), _shift(sym, 1, 0)
    out_lo, out_hi = lo.copy(), hi.copy()
    out_lo[pair], out_hi[pair] = np.minimum(lo, n_lo)[pair], np.maximum(hi, n_hi)[pair]
    on, back = single & ~right, single & right
    sure = on & follows & (n_sym != sym)
    out_lo[on], out_hi[on] = np.where(sure, np.minimum(lo, n_lo), -_FAR)[on], np.where(sure, np.maximum(hi, n_hi), _FAR)[on]
    sure = back & precedes & (p_sym != sym)
    out_lo[back], out_hi[back] = np.where(sure, np.minimum(lo, p_lo), -_FAR)[back], np.where(sure, np.maximum(hi, p_hi), _FAR)[back]
    out = np.where(pair, _mixed(_mixed(sym) + n_sym * U(0x2545F4914F6CDD1D)), sym)
    keep = ~second
    return out[keep], part[keep], out_lo[keep], out_hi[keep]


def _round(sym, part, lo, hi, number: int):
    return _paired(*_squeezed_runs(sym, part, lo, hi), number)


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Slices of about CHUNK bytes."""
    row = 0
    while row < len(texts):
        end, size = row + 1, len(texts[row])
        while end < len(texts) and size + len(texts[end]) <= CHUNK:
            size += len(texts[end])
            end += 1
        yield row, end
        row = end


def _kept_sha(words: list[bytes], gone: np.ndarray | None = None) -> str:
    return hashlib.sha256(b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest()


#: Symbols of a text that open windows own: name, deciding words, and whether the symbol follows the one before it.
SYMBOLS = "sym array<bigint>, lo array<int>, hi array<int>, joined array<boolean>"
#: Windows that are open, as runs of consecutive ones.
OPEN = "open array<struct<lo: int, n: int>>"
_RUN = pa.struct([("lo", pa.int32()), ("n", pa.int32())])


def _lists(row: np.ndarray, n_rows: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n_rows + 1)).astype(np.int32)), values)


def _symbol_lists(row, n_rows: int, sym, lo, hi, joined) -> list[pa.Array]:
    values = (sym.view(np.int64), lo.astype(np.int32), hi.astype(np.int32), joined)
    return [_lists(row, n_rows, pa.array(v)) for v in values]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's number of words, hash of the whole, and the symbols that its windows own after TASK_ROUNDS."""
    names = _Names()
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for row, end in _chunks(texts):
            split = [t.split() for t in texts[row:end]]
            n = np.array([len(w) for w in split])
            first = np.concatenate([[0], np.cumsum(n)])
            sym = np.fromiter((x for w in split for x in map(names.__getitem__, w)), U, int(first[-1]))
            at = np.repeat(np.arange(len(n)), n)
            lo = np.arange(len(sym)) - first[at]
            part, hi = at, lo + 1
            for number in range(TASK_ROUNDS):
                sym, part, lo, hi = _round(sym, part, lo, hi, number)
            own = np.flatnonzero((lo >= 0) & (hi - lo <= WINDOW) & (n[part] >= WINDOW))
            joined = np.zeros(len(own), bool)
            joined[1:] = (np.diff(own) == 1) & (part[own][1:] == part[own][:-1])
            shas = pa.array([_kept_sha(w) for w in split], pa.string())
            lists = _symbol_lists(part[own], end - row, sym[own], lo[own], hi[own], joined)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(n), shas, *lists], ["key", "n_words", "whole_sha256", "sym", "lo", "hi", "joined"])


def _flat(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The row of each value, and the values, of a column of lists."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), n), column.flatten()


def _named(number: int):
    """Closes the windows that own a symbol which isn't in `known`, then makes round `number` of what open windows own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            row, sym = _flat(c["sym"])
            sym = sym.to_numpy(zero_copy_only=False).view(U)
            lo, hi = (c[k].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in ("lo", "hi"))
            joined = c["joined"].flatten().to_numpy(zero_copy_only=False)
            k_row, known = _flat(c["known"])
            known = known.to_numpy(zero_copy_only=False).view(U)
            salt = _mixed(np.arange(batch.num_rows).astype(U))  # a name is known to its own text only
            repeated = np.isin(_mixed(sym) ^ salt[row], _mixed(known) ^ salt[k_row])

            n = c["n_words"].to_numpy(zero_copy_only=False) - WINDOW + 1
            base = np.concatenate([[0], np.cumsum(n)])
            o_row, runs = _flat(c["open"])
            o_lo, o_n = (runs.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            change = np.zeros(base[-1] + 1, np.int64)
            np.add.at(change, base[o_row] + o_lo, 1)
            np.add.at(change, base[o_row] + o_lo + o_n, -1)
            open_ = np.cumsum(change[:-1]) > 0
            from_, upto = base[row] + np.maximum(hi - WINDOW, 0), base[row] + np.minimum(lo, n[row] - 1) + 1
            change[:] = 0
            np.add.at(change, from_[~repeated], 1)
            np.add.at(change, upto[~repeated], -1)
            open_ &= np.cumsum(change[:-1]) == 0

            before = np.concatenate([[0], np.cumsum(open_)])
            own = np.flatnonzero(before[upto] > before[from_])
            chain = np.ones(len(own), bool)
            chain[1:] = ~joined[own][1:] | (np.diff(own) > 1)
            part = np.cumsum(chain) - 1
            of_part = row[own][chain]
            sym, part, lo, hi = _round(sym[own], part, lo[own], hi[own], number)
            row = of_part[part] if len(part) else part
            good = np.flatnonzero((lo >= 0) & (hi - lo <= WINDOW))
            owned = before[base[row[good]] + np.minimum(lo[good], n[row[good]] - 1) + 1] > before[base[row[good]] + np.maximum(hi[good] - WINDOW, 0)]
            own = good[owned]
            joined = np.zeros(len(own), bool)
            joined[1:] = (np.diff(own) == 1) & (part[own][1:] == part[own][:-1])

            edge = np.flatnonzero(np.diff(np.concatenate([[0], open_.view(np.int8), [0]])))
            # runs of open windows don't go on into the next text
            inner = base[1:-1][open_[base[1:-1] - 1] & open_[np.minimum(base[1:-1], len(open_) - 1)]] if len(base) > 2 else base[:0]
            edge = np.sort(np.concatenate([edge, inner, inner]))
            starts, ends = edge[::2], edge[1::2]
            r_row = np.searchsorted(base, starts, side="right") - 1
            opened = pa.StructArray.from_arrays([pa.array((starts - base[r_row]).astype(np.int32)), pa.array((ends - starts).astype(np.int32))], fields=list(_RUN))
            out = pa.RecordBatch.from_arrays(
                [c["u"], c["n_words"], *_symbol_lists(row[own], batch.num_rows, sym[own], lo[own], hi[own], joined), _lists(r_row, batch.num_rows, opened)],
                ["u", "n_words", "sym", "lo", "hi", "joined", "open"],
            )
            yield out.filter(pa.array(before[base[1:]] > before[base[:-1]]))

    return run


def open_windows(texts: DataFrame, spark: SparkSession) -> DataFrame:
    """(u, open): windows of each text all whose symbols, in every round, occur twice or more. texts: (u, n_words, SYMBOLS)."""
    every = F.array(F.struct(F.lit(0).alias("lo"), (F.col("n_words") - WINDOW + 1).cast("int").alias("n")))
    state = texts.filter(F.col("n_words") >= WINDOW).select("u", "n_words", "sym", "lo", "hi", "joined", every.alias("open"))
    for number in range(TASK_ROUNDS, TASK_ROUNDS + SPARK_ROUNDS):
        symbols = state.select("u", F.explode("sym").alias("sym"))
        # Written, so that the join shuffles both sides for itself and Spark can split the texts of a very common symbol.
        names = written(symbols.groupBy("sym").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("sym"), spark, "names")
        known = symbols.join(names, "sym", "left_semi").groupBy("u").agg(F.collect_set("sym").alias("known"))
        state = state.join(known, "u", "left").withColumn("known", F.coalesce("known", F.array().cast("array<bigint>")))
        state = written(state.mapInArrow(_named(number), f"u long, n_words long, {SYMBOLS}, {OPEN}"), spark, "round")
    return state.select("u", "open")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w1, w2, u, pos): digests of the words of open windows."""
    for batch in batches:
        for u, runs, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = raw.split()
            joined = memoryview(b" ".join(words))
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            pos = np.concatenate([np.arange(r["lo"], r["lo"] + r["n"]) for r in runs])
            for k in range(0, len(pos), WINDOWS_AT_ONCE):
                p = pos[k : k + WINDOWS_AT_ONCE]
                found = b"".join(hashlib.blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(starts[p].tolist(), ends[p + WINDOW - 1].tolist(), strict=True))
                w = np.frombuffer(found, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy()), pa.array(np.full(len(p), u)), pa.array(p.astype(np.int32))], ["w1", "w2", "u", "pos"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_removed, shas = [], []
        for pos, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = raw.split()
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, pos, 1)
            np.add.at(change, np.array(pos) + WINDOW, -1)
            gone = np.cumsum(change[:-1]) > 0
            n_removed.append(int(gone.sum()))
            shas.append(_kept_sha(words, gone))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string())], ["u", "n_removed", "kept_sha256"])


def repeated_removed(docs: DataFrame, spark: SparkSession, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of docs: what stays when all words of repeated windows go.

    Null and empty texts have no words. Rows are told apart by content, so repeated rows and null ids get what their text
    gets; ids may be of any type. An empty table gives an empty result. Other columns of docs are not read.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(raw, 256)).alias("key"), raw.cast("binary").alias("text"))
    scanned = rows.select("key", "text").mapInArrow(_scan, f"key binary, n_words long, whole_sha256 string, {SYMBOLS}")
    one = [F.first(c).alias(c) for c in ("n_words", "whole_sha256", "sym", "lo", "hi", "joined")]
    texts = scanned.groupBy("key").agg(*one, F.count(F.lit(1)).alias("copies")).withColumn("u", F.monotonically_increasing_id())
    texts = written(texts, spark, "texts")

    suspects = written(open_windows(texts, spark).join(texts.select("u", "key", "copies"), "u"), spark, "suspects")
    with_text = rows.select("key", "text").join(suspects, "key").select("key", "copies", "u", "open", "text")
    once = with_text.filter("copies = 1").select("u", "open", "text")
    more = with_text.filter("copies > 1").groupBy("key", "u").agg(F.first("open").alias("open"), F.first("text").alias("text")).select("u", "open", "text")
    windows = written(once.unionByName(more).mapInArrow(_digests, "w1 long, w2 long, u long, pos int"), spark, "windows")
    repeated = written(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("w1", "w2"), spark, "repeated-windows")
    met = windows.join(repeated, ["w1", "w2"], "left_semi").groupBy("u").agg(F.collect_list("pos").alias("pos"))
    found = written(met.join(suspects.filter("copies = 1").select("u", "key"), "u"), spark, "found")
    cut = rows.select("key", "text").join(found, "key").select("u", "pos", "text")
    removed = written(cut.mapInArrow(_remove, "u long, n_removed long, kept_sha256 string"), spark, "removed")

    everything = (F.col("copies") > 1) & (F.col("n_words") >= WINDOW)
    per_text = texts.select("u", "key", "copies", "n_words", "whole_sha256").join(removed, "u", "left").select(
        "key", "n_words",
        F.when(everything, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(everything, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
    )
    return rows.select("doc_id", "key").join(written(per_text, spark, "per-text"), "key").select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_removed(table(spark, sf_dir, "documents"), spark)

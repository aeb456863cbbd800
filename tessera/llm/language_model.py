"""Log probabilities of texts by an n-gram model in Elias-Fano tries.

A chunk of documents numbers its distinct words, asks the shards of the vocabulary for their ids and counts, and then, order
by order, the shards of the tries for its n-grams. A shard merges the counts of all chunks' training documents, builds its
part of the trie's level, and answers from it. An n-gram's key is the node of its first n-1 words and the place of its last
word among the successors of the words between (of all words, for pairs), so that keys are small numbers. A level holds

- the prefixes' nodes, their pointers into the successors, and the successors' places, raised from prefix to prefix so that
  they rise throughout: three monotone sequences in Elias-Fano form, searched for a prefix and then for the successor;
- for each successor the quantised smoothed probability count / (count of the prefix + SMOOTHING), in 16 bits.

Levels are memory-mapped while they answer. The model: p(w) = (count + 1) / (N + V + 1) for one word, and p(w | context) =
(count(context w) + SMOOTHING * p(w | shorter context)) / (count(context) + SMOOTHING), which is the quantised value plus a
share of the shorter context's. Contexts reach back over up to ORDER - 1 tokens of the document and no further, so a
document's first token has none. A prefix that occurs more than SHARD times is split by successor over several shards.
"""

from __future__ import annotations

import mmap
import tempfile
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, bucketed, kind_of, table
from tessera.llm.exchange import PACKETS, answers, dealt, let_go, mixed_bits, pack, packet_batch, shards_for, total, unpack

ORDER, SMOOTHING = 3, 100.0
#: Tokens after which a chunk ends, and tokens for which a shard is made.
CHUNK, SHARD = 1_000_000, 500_000
#: A node's number is its place in its shard, and above so many bits the shard.
NODE_BITS = 40
#: Steps of the quantised probabilities a power of ten; 16 bits reach down to 10^-16.
STEPS = 4000

STATE = "chunk long, doc_ids array<{}>, held array<boolean>, tokens binary, words binary, n_tokens long, n_train long"
RESULT = "doc_id {}, held_out boolean, n_tokens long, n_known long, base_sum double, score double"


# -- the trie -----------------------------------------------------------------------------------------------------


_1, _2, _3, _4, _8, _BYTE = (np.uint64(x) for x in (1, 2, 3, 4, 8, 255))
#: The byte 01, 80, 55, 33 and 0F in each byte of a word.
_EACH, _TOPS, _FIVES, _THREES, _FIFTEENS = (np.uint64(x * 0x0101010101010101) for x in (0x01, 0x80, 0x55, 0x33, 0x0F))
#: Where a byte has its 1st, 2nd ... one.
_PLACES = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[:8] for byte in range(256)], np.int64)


class EliasFano:
    """A rising sequence of whole numbers: low bits packed, high bits as one 1 a number and one 0 a step."""

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, np.int64)
        self.n = len(values)
        self.low_bits = min(56, max(0, int((int(values[-1]) + 1) // self.n).bit_length() - 1)) if self.n else 0
        bits = np.arange(self.low_bits, dtype=np.int64)
        lows = np.packbits((values[:, None] >> bits & 1).astype(np.uint8).ravel(), bitorder="little")
        self.lows = np.concatenate([lows, np.zeros(8, np.uint8)])
        high = values >> self.low_bits
        self.steps = int(high[-1]) + 1 if self.n else 1
        flags = np.zeros(-(-(self.n + self.steps) // 64) * 64, np.uint8)
        flags[high + np.arange(self.n)] = 1
        self.words = np.packbits(flags, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    arrays = ("lows", "words", "before")

    def _select(self, i: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the i-th 1, or 0, from 0 on."""
        before = self.before if ones else 64 * np.arange(len(self.before), dtype=np.int64) - self.before
        word = np.searchsorted(before, i, "right") - 1
        left = i - before[word]
        x = self.words[word] if ones else ~self.words[word]
        left = left.astype(np.uint64)
        # ones of each byte, then of each byte and those before it; the byte is the first with more than `left`
        n = x - ((x >> _1) & _FIVES)
        n = (n & _THREES) + ((n >> _2) & _THREES)
        upto = ((n + (n >> _4)) & _FIFTEENS) * _EACH
        byte = np.bitwise_count((((left * _EACH) | _TOPS) - upto) & _TOPS).astype(np.uint64) << _3
        rank = left - (((upto << _8) >> byte) & _BYTE)
        return 64 * word + byte.astype(np.int64) + _PLACES[((x >> byte) & _BYTE).astype(np.intp), rank.astype(np.intp)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        window = np.ndarray((len(self.lows) - 7,), "<u8", buffer=self.lows, strides=(1,))
        bit = i * self.low_bits
        return (window[bit >> 3] >> (bit & 7).astype(np.uint64)).astype(np.int64) & ((1 << self.low_bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self._select(i, True) - i) << self.low_bits | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x, -1 where it isn't there."""
        out = np.full(len(x), -1, np.int64)
        high = x >> self.low_bits
        could = np.flatnonzero((high < self.steps) & (x >= 0)) if self.n else np.empty(0, int)
        high, low = high[could], x[could] & ((1 << self.low_bits) - 1)
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) + 1, 0) - high
        end = self._select(high, False) - high
        a, b = start.copy(), end.copy()
        while (open_ := np.flatnonzero(a < b)).size:
            middle = (a[open_] + b[open_]) >> 1
            less = self._low(middle) < low[open_]
            a[open_[less]] = middle[less] + 1
            b[open_[~less]] = middle[~less]
        there = np.flatnonzero(a < end)
        there = there[self._low(a[there]) == low[there]]
        out[could[there]] = a[there]
        return out


def mapped(parts: Sequence) -> None:
    """Moves the arrays of the parts (each with `arrays`, their names) into one memory-mapped file without a name."""
    with tempfile.TemporaryFile() as file:
        places = []
        for part in parts:
            for name in part.arrays:
                a = getattr(part, name)
                places.append((part, name, a.dtype, len(a), file.tell()))
                file.write(a.tobytes() + bytes(8 + -a.nbytes % 8))
        file.flush()
        pages = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    for part, name, kind, n, at in places:
        setattr(part, name, np.frombuffer(pages, kind, n, at))


class Level:
    """The n-grams of a shard: (prefix, successor) pairs in order, each with its smoothed probability."""

    arrays = ("codes",)

    def __init__(self, prefix: np.ndarray, successor: np.ndarray, probability: np.ndarray):
        first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]])) if len(prefix) else np.empty(0, int)
        ends = np.concatenate([first[1:], [len(prefix)]]) if len(first) else first
        self.prefixes = EliasFano(prefix[first])
        self.pointers = EliasFano(np.concatenate([first, [len(prefix)]]))
        raised = np.concatenate([[0], np.cumsum(successor[ends - 1] + 1)])
        self.raised = EliasFano(raised)
        self.successors = EliasFano(successor + np.repeat(raised[:-1], ends - first))
        self.codes = np.clip(np.rint(-STEPS * np.log10(probability)), 0, 65535).astype(np.uint16)
        mapped([self, self.prefixes, self.pointers, self.raised, self.successors])

    def find(self, prefix: np.ndarray, runs: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(each n-gram's place, -1 if it isn't there; each prefix's pointer, the place of its first). runs: successors asked of each prefix."""
        node = self.prefixes.find(prefix)
        known = np.flatnonzero(node >= 0)
        pointer, low, high = (np.zeros(len(node), np.int64) for _ in range(3))
        pointer[known], low[known], high[known] = self.pointers[node[known]], self.raised[node[known]], self.raised[node[known] + 1]
        low, high = (np.repeat(v, runs) for v in (low, high))
        place = np.full(len(successor), -1, np.int64)
        asked = np.flatnonzero(low + successor < high)
        place[asked] = self.successors.find(low[asked] + successor[asked])
        return place, pointer


def probability(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (-np.asarray(code, np.float64) / STEPS)


# -- shards -------------------------------------------------------------------------------------------------------


def _vocabulary(n_shards: int):
    """For each packet of (words, training counts): each word's id + 1 (0 if it isn't known) and count, and new known words."""

    def run(shard: int, packets: list[list[np.ndarray]]) -> list[bytes]:
        numbers = _Numbers()
        at = [np.fromiter(map(numbers.__getitem__, w.astype(np.uint8).tobytes().split(b" ")), np.int64, len(n)) for w, n in packets]
        counts = np.bincount(np.concatenate(at), np.concatenate([n for _, n in packets]), len(numbers)).astype(np.int64)
        order = np.argsort(-counts, kind="stable")  # packets come in order of chunk, so ties always fall alike
        known = int(np.count_nonzero(counts))
        ids = np.zeros(len(counts), np.int64)
        ids[order[:known]] = np.arange(known) * n_shards + shard + 1
        return [pack(ids[i], counts[i], np.array([0 if k else known])) for k, i in enumerate(at)]

    return run


def _rising(places: np.ndarray) -> np.ndarray:
    """Places with each 0 (not known) as the place before it, so that they rise; the codes tell which are known."""
    return np.maximum.accumulate(places) if len(places) else places


def _level(smoothing: float, last: bool):
    """For each packet of n-grams: code + 1 (0 if it isn't known), and unless it is the last level, place + 1 and each prefix's pointer."""

    def run(shard: int, packets: list[list[np.ndarray]]) -> list[bytes]:
        prefixes, runs, of_prefix, successor, n = (np.concatenate([p[i] for p in packets]) for i in range(5))
        distinct, which = np.unique(prefixes, return_inverse=True)
        which = np.repeat(which, runs)
        firsts, at = _unique(which, successor)
        prefix, follows = distinct[which[firsts]], successor[firsts]
        counts = np.bincount(at, n, len(prefix)).astype(np.int64)
        total = np.empty(len(prefix), np.int64)
        total[at] = np.repeat(of_prefix, runs)
        known = counts > 0
        trie = Level(prefix[known], follows[known], counts[known] / (total[known] + smoothing))
        first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        place, pointer = trie.find(prefix[first], np.diff([*first, len(prefix)]), follows)  # each n-gram once, whoever asks
        code = np.where(place >= 0, trie.codes[place].astype(np.int64) + 1, 0) if len(trie.codes) else np.zeros(len(place), np.int64)
        code, place, pointer = code[at], place[at], pointer[np.searchsorted(prefix[first], prefixes)]
        said = []
        first = np.cumsum([0, *(len(p[3]) for p in packets)])
        heads = np.cumsum([0, *(len(p[0]) for p in packets)])
        for low, high, head, tail in zip(first[:-1], first[1:], heads[:-1], heads[1:], strict=True):
            said.append(pack(code[low:high]) if last else pack(code[low:high], _rising(place[low:high] + 1), pointer[head:tail]))
        return said

    return run


# -- chunks -------------------------------------------------------------------------------------------------------


def _ranked(at: np.ndarray, values: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values at these places in order, what stands beside them, and the rank of each place's value."""
    used = np.zeros(len(values), bool)
    used[at] = True
    places = np.flatnonzero(used)
    if (np.diff(values[places]) < 0).any():
        places = places[np.argsort(values[places])]
    rank = np.empty(len(values), np.int64)
    rank[places] = np.arange(len(places))
    return values[places], beside[places], rank[at]


def _unique(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct one of columns of whole numbers, in order, and each row's place among these."""
    n = len(columns[0])
    least = [int(c.min(initial=1 << 62)) if n else 0 for c in columns]
    bits = [int(c.max() - low).bit_length() if n else 0 for c, low in zip(columns, least, strict=True)]
    own = max(1, n).bit_length()
    if sum(bits) + own <= 63:  # row and number as one number each, which sort several times as fast as places of rows
        key = columns[0] - least[0]
        for c, low, b in zip(columns[1:], least[1:], bits[1:], strict=True):
            key = key << b | (c - low)
        key = np.sort(key << own | np.arange(n))
        order = key & ((1 << own) - 1)
    else:
        order = np.lexsort(columns[::-1])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    at = np.empty(n, np.int64)
    at[order] = np.cumsum(new) - 1
    return order[new], at


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _chunks(size: int, schema: pa.Schema):
    """Documents to chunks: each token by the number of its word in the chunk; number 0 is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, held, docs, numbers, n = [], [], [], _Numbers({b"": 0}), 0

        def chunk() -> pa.RecordBatch:
            lengths = np.array([len(d) for d in docs])
            train = int(lengths[~np.array(held, bool)].sum())
            words = list(numbers)
            hashes = np.array([zlib.crc32(w) for w in words])
            order = np.argsort(hashes, kind="stable")  # by hash, so by shard, however many there will be; the end stays first
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            cells = [number, ids, held, pack(lengths, rank[np.concatenate(docs)], hashes[order]), b" ".join(map(words.__getitem__, order.tolist())), n, train]
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, text, out in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = (text or "").encode().lower().split()  # bytes: lower() folds A-Z only and split() knows the six ASCII blanks
                words.append(b"")
                docs.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                ids.append(doc_id)
                held.append(out)
                n += len(words)
                if n >= size:
                    yield chunk()
                    number += 1
                    ids, held, docs, numbers, n = [], [], [], _Numbers({b"": 0}), 0
        if ids:
            yield chunk()

    return run


class Chunk:
    """A chunk's tokens, and what it knows of its n-grams of each order from the answers so far."""

    def __init__(self, row: dict, n_shards: int, smoothing: float, shard: int = SHARD):
        self.n_shards, self.smoothing, self.most, self.ids, self.held = n_shards, smoothing, shard, row["doc_ids"], np.array(row["held"], bool)
        self.lengths, self.tokens, hashes = unpack(row["tokens"])
        self.word_shard = hashes * n_shards >> 32
        starts = np.cumsum(self.lengths) - self.lengths
        self.doc = np.repeat(np.arange(len(starts)), self.lengths)
        self.place = np.arange(len(self.tokens)) - starts[self.doc]
        self.train = ~self.held[self.doc]
        self.at = self.tokens  # for each token, which of the chunk's n-grams ends with it; -1 where none is known

    # words

    def ask_words(self, words: list[bytes]) -> list[tuple[int, bytes]]:
        n = np.bincount(self.tokens[self.train], minlength=len(words))
        return [(s, pack(np.frombuffer(b" ".join(words[at]), np.uint8), n[at])) for s, at in dealt(self.word_shard)]

    def hear_words(self, said: list[list[np.ndarray]]) -> None:
        self.node, self.count = np.concatenate([s[0] for s in said]) - 1, np.concatenate([s[1] for s in said])
        self.relative = self.node
        self.order = np.empty(len(self.node), np.int64)  # of the words' ids
        self.order[np.argsort(self.node)] = np.arange(len(self.node))
        self.word_count = self.count

    # n-grams of order n, once those of order n - 1 are known

    def keys(self, n: int) -> None:
        """The chunk's distinct n-grams whose first and last n - 1 words are known, in order of shard, prefix and successor."""
        i = np.flatnonzero(self.place >= n - 1)
        self.tail, self.context = i, self.at[i - 1]  # tokens with a context of n - 1 words, and that context
        j = i[(self.node[self.context] >= 0) & (self.node[self.at[i]] >= 0)]
        head, last = self.at[j - 1], self.at[j]
        # prefixes in order of shard, those that occur very often once for each split, so that one sort gives the packets
        heads, count, group = _ranked(head, self.node, self.count)
        successor = self.relative[last]
        shard = mixed_bits(heads) % self.n_shards if n == 2 else heads >> NODE_BITS  # longer n-grams go where their prefix is
        if len(count) and count.max() >= self.most:
            hot = np.flatnonzero(count[group] >= self.most)
            split = mixed_bits(successor[hot]) % (1 + count[group[hot]] // self.most)
            pairs, which = np.unique(group[hot] << 32 | split, return_inverse=True)
            group[hot] = len(heads) + which
            own, split = pairs >> 32, pairs & 0xFFFFFFFF
            shard = np.concatenate([shard, (shard[own] + split) % self.n_shards])
            heads, count = (np.concatenate([x, x[own]]) for x in (heads, count))
        order = np.lexsort((heads, shard))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        firsts, at = _unique(rank[group], self.order[last])
        group, self.successor = group[firsts], successor[firsts]
        self.shard, self.prefix, self.of_prefix = shard[group], heads[group], count[group]
        self.splits = 1 + self.of_prefix // self.most
        self.split = np.where(self.splits > 1, mixed_bits(self.successor) % self.splits, 0)
        self.next = np.full(len(self.tokens), -1, np.int64)
        self.next[j] = at
        self.n = np.bincount(at[self.train[j]], minlength=len(group))

    def ask(self) -> list[tuple[int, bytes]]:
        out = []
        for s, at in dealt(self.shard):
            prefix = self.prefix[at]
            first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
            runs = np.diff(np.concatenate([first, [len(prefix)]]))
            out.append((s, pack(prefix[first], runs, self.of_prefix[at][first], self.successor[at], self.n[at])))
        return out

    def hear(self, said: list[list[np.ndarray]], p: np.ndarray, last: bool) -> None:
        """Takes the answers; p, each token's probability by shorter contexts, becomes that by contexts of this order."""
        code = np.concatenate([s[0] for s in said]) if said else np.empty(0, np.int64)
        value = np.where(code > 0, probability(code - 1), 0.0)
        seen = np.flatnonzero(self.node[self.context] >= 0)
        i, of_context = self.tail[seen], self.count[self.context[seen]]
        own = np.append(value, 0.0)[self.next[i]]  # 0 stands last, for n-grams that aren't known
        p[i] = own + p[i] * self.smoothing / (of_context + self.smoothing)
        if not last:
            place, pointer = (np.concatenate([s[k] for s in said]) if said else np.empty(0, np.int64) for k in (1, 2))
            self.count = np.where(code > 0, np.maximum(1, np.rint(value * (self.of_prefix + self.smoothing))), 0).astype(np.int64)
            self.node = np.append(np.where(code > 0, self.shard << NODE_BITS | (place - 1), -1), -1)  # -1 stands last, for tokens that end no n-gram
            first = np.concatenate([[True], (self.shard[1:] != self.shard[:-1]) | (self.prefix[1:] != self.prefix[:-1])]) if len(self.prefix) else np.empty(0, bool)
            rank = place - 1 - pointer[np.cumsum(first) - 1]
            self.relative = self.order = rank * self.splits + self.split
            self.at = self.next


def _said(row: dict, level: int) -> list[list[np.ndarray]]:
    return [unpack(x["packet"]) for x in sorted(row[f"said_{level}"] or (), key=lambda x: x["shard"])]


def _heard(c: Chunk, row: dict, order: int, upto: int, vocabulary: int, train_tokens: int) -> np.ndarray:
    """Tells the chunk the answers of orders up to `upto`; each token's probability by then."""
    c.hear_words(_said(row, 1))
    p = ((c.word_count + 1) / (train_tokens + vocabulary + 1))[c.tokens]
    for n in range(2, upto + 1):
        c.keys(n)
        c.hear(_said(row, n), p, n == order)
    return p


def lm_scores(
    docs: DataFrame, spark: SparkSession, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, smoothing: float = SMOOTHING, chunk: int = CHUNK, shard: int = SHARD
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    The model learns from rows that aren't held out (a null counts as not held out). Tokens are words, A-Z lower-cased, and
    one end a document; null and empty texts have the end only. base_score is the log10 probability by single words, score
    that by contexts of up to order - 1 tokens. Repeated rows count and are scored each; ids may be null and of any type. An
    empty table gives an empty result; other columns are not read.
    """
    kind = kind_of(docs, id_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    kinds = STATE.format(kind)
    state = bucketed(rows.mapInArrow(_chunks(chunk, arrow_schema(kinds)), kinds), spark, "chunks", "chunk")
    train_tokens = total(state, "n_train")
    n_shards = shards_for(total(state, "n_tokens"), shard)

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from packet_batch(row["chunk"], Chunk(row, n_shards, smoothing).ask_words(row["words"].split(b" "))).to_batches()

    def gathered(packets: DataFrame, answer, level: int) -> DataFrame:
        """A row for each chunk with its answers; there are as many as shards."""
        return answers(packets, answer).groupBy("chunk").agg(F.collect_list(F.struct("shard", "packet")).alias(f"said_{level}"))

    said = bucketed(gathered(state.mapInArrow(ask_words, PACKETS), _vocabulary(n_shards), 1), spark, "said", "chunk")
    vocabulary = total(said.select("said_1").mapInArrow(_new_words, "n long"), "n")
    known = state.join(said, "chunk")  # both in the same buckets

    def asking(n: int):
        def ask(rows: pa.Table) -> pa.Table:
            row = rows.to_pylist()[0]
            c = Chunk(row, n_shards, smoothing, shard)
            _heard(c, row, order, n - 1, vocabulary, train_tokens)
            c.keys(n)
            return packet_batch(row["chunk"], c.ask())

        return ask

    for n in range(2, order + 1):
        let_go(spark)  # of the level before
        said = gathered(known.groupBy("chunk").applyInArrow(asking(n), PACKETS), _level(smoothing, n == order), n)
        known = known.join(said if n == order else bucketed(said, spark, "said", "chunk"), "chunk", "left")
    let_go(spark)
    result = RESULT.format(kind)
    result_types = arrow_schema(result)

    def score(rows: pa.Table) -> pa.Table:
        row = rows.to_pylist()[0]
        c = Chunk(row, n_shards, smoothing, shard)
        p = _heard(c, row, order, order, vocabulary, train_tokens)
        n_docs = len(c.ids)
        base = np.bincount(c.doc, np.log10((c.word_count + 1) / (train_tokens + vocabulary + 1))[c.tokens], n_docs)
        cells = [c.ids, c.held, c.lengths, np.bincount(c.doc, (c.word_count > 0)[c.tokens], n_docs).astype(np.int64), base, np.bincount(c.doc, np.log10(p), n_docs)]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(cells, result_types, strict=True)], schema=result_types)

    scored = known.groupBy("chunk").applyInArrow(score, result)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), F.col("base_sum").alias("base_score"), "score")


def _new_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for said in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array([sum(int(unpack(x["packet"])[2][0]) for x in said)], pa.int64())], ["n"])


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    return lm_scores(table(spark, sf_dir, "documents"), spark, held)

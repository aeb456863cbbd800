import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.packing import Encoder, packed, sum_of_squares

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2FF), max_size=60) | st.text(max_size=30))
def test_fast_path_gives_the_tokenizers_ids(text):
    ids = ids_of(text)
    assert ENCODER.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


ENCODER = Encoder(PATH)


@pytest.mark.parametrize("text", ["It's I'LL don't 'tis", "½ 3² x×y a÷b", "<|endoftext|> <|startoftext|>", "a\x1cb\x85c\xa0d", "İstanbul ﬁ é Å", "a1b22--!!__"])
def test_special_cases(text):
    ids = ids_of(text)
    assert ENCODER.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def plain_sum_of_squares(lengths, capacity):
    """The rule word by word: try every place, take the smallest sum of squares; ties to the smallest gap, old before new."""
    bins, where = [], []
    for s in lengths:
        def total(gaps):
            n = defaultdict(int)
            for g in gaps:
                n[g] += g > 0
            return sum(v * v for v in n.values())

        options = {}
        for g in sorted({b for b in bins if b >= s}):
            rest = list(bins)
            rest[rest.index(g)] = g - s
            options[g] = total(rest)
        new = total([*bins, capacity - s])
        best = min(options, key=lambda g: (options[g], g), default=None)
        if best is not None and options[best] <= new:
            i = max(i for i, b in enumerate(bins) if b == best)
            where.append(best)
            bins[i] -= s
        else:
            where.append(None)
            bins.append(capacity - s)
    return where, len(bins)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_rule(lengths):
    sequence, offset = sum_of_squares(np.array(lengths, np.int64), 20)
    where, n = plain_sum_of_squares(lengths, 20)
    assert len(set(sequence.tolist())) == n
    assert [20 - o if o else None for o in offset.tolist()] == [w if w != 20 else None for w in where]


def check(rows, docs, capacity):
    seen, places = defaultdict(list), defaultdict(list)
    for r in rows:
        seen[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= capacity
    want = defaultdict(list)
    for doc_id, text in docs:
        ids = [*ids_of(text), 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[doc_id].append((k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    got = {k: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in v) for k, v in seen.items()}
    assert got == {k: sorted(v) for k, v in want.items()}
    return sum(n for p in places.values() for _, n in p), len(places)


def test_round_trip(spark, messy, small):
    for docs in (messy, small):
        rows = docs.select("doc_id", "text").collect()
        total, n = check(packed(docs, spark).collect(), [tuple(r) for r in rows], 4096)
        assert n <= -(-total // 4096) + 2


def test_several_shards(spark, small):
    from tessera.llm.packing import pack, tokenised_pieces

    rows = pack(tokenised_pieces(small, PATH), shard=30).collect()
    check(rows, [tuple(r) for r in small.select("doc_id", "text").collect()], 4096)


def test_empty_table(spark, nothing):
    assert packed(nothing, spark).count() == 0

import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import alignment as A
from tessera.llm import exchange as X

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def plain_groups(text, a, b):
    """[(A ids, B ids)] of a text by whole encodings and byte ends, one token after another; None without tokens."""
    want = (" " + text).encode()
    a_ids = a.encode(" " + text, add_special_tokens=False).ids
    b_ids = b.encode(text)
    letters = {c: i for i, c in A._byte_letters().items()}
    a_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
        return None
    ends = [np.cumsum([len(x) for x in t]).tolist() for t in (a_bytes, b_bytes)]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups = [([], []) for _ in cuts]
    for side, (ids, stops) in enumerate(zip((a_ids, b_ids), ends, strict=True)):
        for token, stop in zip(ids, stops, strict=True):
            groups[bisect.bisect_left(cuts, stop)][side].append(token)
    return groups


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def plain(rows, tokenizers):
    groups = [(i, plain_groups(t or "", *tokenizers)) for i, t in rows]
    links = [Counter((x, y) for a, b in g or () for x in a for y in b) for _, g in groups]
    documents = Counter(p for n in links for p in n)
    best = Counter()
    for (x, _), n in documents.items():
        best[x] = max(best[x], n)
    out = []
    for (i, g), n in zip(groups, links, strict=True):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or ())
        out.append((
            i, sum(len(a) for a, _ in g or ()), sum(len(b) for _, b in g or ()), len(g or ()), sum(n.values()), sum(k for p, k in n.items() if documents[p] == best[p[0]]),
            sum(k * documents[p] for p, k in n.items()), hashlib.sha256(said.encode()).hexdigest() if g else "",
        ))
    return sorted(out, key=repr), documents, sum(links, Counter())


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ODD = ["", None, " ", "  two", "a<|endoftext|>b <s> </s> <unk> <0x41>", "▁mark", "tab\tand\nlines\r\n  ", "日本語 \U0001f642\U0001f9ea é́", "x" * 3000, "=" * 5000, " " * 3000, "\x00\x01", "1234567 't's'll", "\U0001f9ea" * 400, "﻿bom", "   wide"]


def test_whole_table(spark, small, tokenizers):
    got = rows_of(A.alignment(small, spark, *PATHS, postings=20_000))
    want, documents, links = plain([(r.doc_id, r.text) for r in small.collect()], tokenizers)
    assert got == want
    pairs = {(r.a, r.b): (r.n_docs, r.n_links) for r in A.pair_counts(small, spark, *PATHS).collect()}
    assert pairs == {p: (n, links[p]) for p, n in documents.items()}


def test_odd_texts(spark, messy, nothing, tokenizers):
    rows = [(i % 7 or None, t) for i, t in enumerate(ODD * 2)] + [(1, "same text"), (1, "same text")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(A.alignment(frame, spark, *PATHS)) == plain(rows, tokenizers)[0]
    assert rows_of(A.alignment(messy, spark, *PATHS)) == plain([(r.doc_id, r.text) for r in messy.collect()], tokenizers)[0]
    assert A.alignment(nothing, spark, *PATHS).count() == 0


def test_large_groups(spark, tokenizers, monkeypatch):
    monkeypatch.setattr(A, "LISTED", 3)
    aligner = A.Aligner(*PATHS)
    for text in [t for t in ODD if t] + ["אב ג uné thé"]:
        got, groups = aligner.align(text, aligner.b.encode([text])[0]), plain_groups(text, *tokenizers)
        if groups is None:
            assert got is None
            continue
        links = Counter((x, y) for a, b in groups for x in a for y in b)
        assert dict(zip([(p >> 32, p & 0xFFFFFFFF) for p in got[5].tolist()], got[6].tolist(), strict=True)) == links and got[3] == sum(links.values())


def test_ranks_give_the_files_ids(tokenizers):
    """The fast path against the file's own tokenizer on random mixtures of what splits and merges differently."""
    ours, rng = A.ByteTokens(PATHS[0]), random.Random(5)
    assert ours._ranks is not None
    parts = ["the", "ing", "'s", "'LL", " ", "  ", "\n", "\t", "12", "½", "é", "é", "日本", "\U0001f642", "<|endoftext|>", "--", "==", "İ", "ǅ", " ", "\x85", "​", "٠", "Ⅷ", "aa", "ab", "zq"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert ours.encode(text) == tokenizers[0].encode(text, add_special_tokens=False).ids, text


def test_packing_is_exact():
    rng = np.random.default_rng(1)
    arrays = [np.array([], np.int64), np.array([5]), np.sort(rng.integers(0, 2**40, 1000)), rng.integers(0, 2**62, 50), np.zeros(9, np.int64), np.arange(7, dtype=np.uint8)]
    assert all((a.astype(np.int64) == b).all() and len(a) == len(b) for a, b in zip(arrays, X.unpack(X.pack(*arrays)), strict=True))


def test_bitmaps_sparse_and_dense():
    place = np.repeat([0, 1, 4], [1, 60, 3])
    docs = np.concatenate([[63], np.arange(60), [0, 8, 62]])
    maps = A.bitmaps(place, docs, 2, 64)
    assert len(maps[4]) == 1 and A.popcounts(maps, 5).tolist() == [1, 60, 0, 0, 3]
    value = np.array([1, 10, 100, 1000, 10000])
    want = np.zeros(64, np.int64)
    np.add.at(want, docs, 2 * value[place])
    assert A.returned(maps, value, 64).tolist() == want.tolist()

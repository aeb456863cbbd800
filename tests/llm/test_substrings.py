import hashlib
import random
from collections import Counter

from tessera.llm.substrings import WINDOW, repeated_removed


def brute(texts):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + WINDOW]) for w in split for i in range(len(w) - WINDOW + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - WINDOW + 1):
            if seen[tuple(w[i : i + WINDOW])] > 1:
                gone[i : i + WINDOW] = [True] * WINDOW
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows])))
    assert Counter(tuple(r) for r in repeated_removed(docs, spark).collect()) == want
    return sum(k[2] for k in want)


def test_matches_brute_force(spark, messy, small):
    check(spark, messy)
    assert check(spark, small) > 0


def test_runs_small_alphabets_and_shifted_passages(spark):
    r = random.Random(3)
    base = [" ".join(r.choice("ab") if r.random() < 0.5 else "a" for _ in range(r.randint(0, 400))) for _ in range(60)]
    texts = []
    for _ in range(150):
        x, y = r.choice(base).split(), r.choice(base).split()
        i = r.randint(0, max(0, len(x) - 30))
        texts.append(" ".join(y[: r.randint(0, 60)] + x[i : i + r.randint(20, 90)] + [r.choice("abc") for _ in range(r.randint(0, 20))]))
    texts += ["a " * 200, "a " * 34, "a " * 35, "a " * 36, None, "", " ", "x y z"]
    texts += [" ".join(str(r.randint(0, 999)) for _ in range(300)) for _ in range(30)]
    for k in range(60):
        x = texts[-r.randint(1, 30)].split()
        i = r.randint(0, 200)
        texts.append(f"q{k} " + " ".join(x[i : i + r.randint(33, 50)]) + f" z{k}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert check(spark, docs) > 0


def test_empty_table(spark, nothing):
    assert repeated_removed(nothing, spark).count() == 0


def test_words_that_only_differ_for_weak_hashes(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2 ** 64, whatever the base."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    head = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{head} {word}"), (2, f"{head} {other}"), (3, f"{head} {other} end")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in repeated_removed(docs, spark).collect()}
    assert got == {1: 0, 2: 35, 3: 35}


def test_ids_of_any_type_and_periodic_texts(spark):
    texts = ["x y " * 60, "x y z " * 40, "q " + "x y " * 30, " ".join(["p"] * 40 + ["q"] * 40), " ".join(["p"] * 36 + ["q"] * 5), "the same text " * 30, "the same text " * 30]
    docs = spark.createDataFrame([(f"id-{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    check(spark, docs)

from pyspark.sql import functions as F
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessera.llm import simhash as S
from tessera.llm.components import components


def plain_fingerprint(text):
    import re

    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints(messy, small):
    for docs in (messy, small):
        for r in docs.select("text").collect():
            assert S.fingerprint(r.text) == plain_fingerprint(r.text)


def test_links_give_the_components_of_all_pairs():
    rng = np.random.default_rng(0)
    fps = set(rng.integers(0, 2**63, 150, dtype=np.uint64).tolist()) | {0, 1, 3, 7, 15, 2**64 - 1}
    for b in list(fps)[:40]:
        for _ in range(25):
            x = int(b)
            for i in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(i)
            fps.add(x)
        for _ in range(8):  # differences within one block
            (low, size), x = S.BLOCKS[int(rng.integers(0, len(S.BLOCKS)))], int(b)
            for i in rng.integers(0, size, 3):
                x ^= 1 << (low + int(i))
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    emitted = list(S._emit([pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64))], ["fp"])]))
    key, fp = (np.concatenate([b.column(i).to_numpy() for b in emitted]) for i in (0, 1))
    order = np.argsort(key, kind="stable")
    batches = [pa.RecordBatch.from_arrays([pa.array(key[order][i : i + 777]), pa.array(fp[order][i : i + 777])], ["key", "fp"]) for i in range(0, len(key), 777)]
    links = {pair for b in S._links(iter(batches)) for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= S.RADIUS
    signed = fps.view(np.int64).tolist()
    i, j = np.where(near)
    assert classes(links, signed) == classes([(signed[a], signed[b]) for a, b in zip(i, j)], signed)
    assert len(links) < 5 * S.RADIUS * len(fps)


def brute(rows):
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    distinct = sorted({f for _, f in fps})
    links = [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 3]
    label = classes(links, distinct)
    least = {}
    for d, f in fps:
        if d is not None:
            least[label[f]] = min(d, least.get(label[f], d))
    return sorted(((d, f"{f:016x}", least.get(label[f])) for d, f in fps), key=repr)


def test_components_match_brute_force(spark, messy, small):
    for docs in (messy, small):
        want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
        assert sorted((tuple(r) for r in S.near_duplicates(docs, spark).collect()), key=repr) == want


def test_dedup_and_empty_table(spark, messy, nothing):
    assert S.near_duplicates(nothing, spark).count() == 0
    kept = S.near_dedup(messy, spark)
    assert kept.columns == messy.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert None in ids and {4, 5}.isdisjoint(ids) and 3 in ids
    assert ids.count(8) == 1 and len(ids) == len(set(brute_labels(messy)))


def brute_labels(docs):
    rows = [(d, plain_fingerprint(t)) for d, t in docs.select("doc_id", "text").collect()]
    fps = sorted({f for _, f in rows})
    label = classes([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3], fps)
    return [label[f] for _, f in rows]


def test_ids_of_any_type(spark, messy):
    named = messy.withColumn("doc_id", F.concat(F.lit("id-"), "doc_id"))
    assert S.near_duplicates(named, spark).count() == messy.count()
    assert S.near_dedup(named, spark).count() == S.near_dedup(messy, spark).count()


@pytest.mark.parametrize("n", [2, 3, 50, 333])
def test_components_of_a_chain_and_a_hub(spark, n):
    chain = [(i, i + 1) for i in range(n)] + [(10_000, 10_000 + i) for i in range(1, n)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "u long, v long"), spark).collect()}
    nodes = {x for e in chain if e[0] != e[1] for x in e}
    assert got == {k: v for k, v in classes(chain, nodes | {7}).items() if k in nodes}

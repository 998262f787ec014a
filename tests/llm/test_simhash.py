import random

import pytest
import xxhash

from rowloom.llm import simhash
from rowloom.llm.components import components
from rowloom.llm.queries import op7_simhash


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id reachable, by all pairs of distinct fingerprints."""
    distinct = sorted(set(prints.values()))
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for doc, f in prints.items():
        least[root(f)] = min(least.get(root(f), doc), doc)
    return {doc: least[root(f)] for doc, f in prints.items()}


def test_query_equals_brute_force(spark, sf_dir, texts):
    prints = {i: plain_print(t) for i, t, _ in texts}
    want = plain_components(prints)
    got = op7_simhash(spark, sf_dir).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == want


def test_balls_find_all_links_of_random_and_near_prints(spark):
    r = random.Random(5)
    prints = set()
    for _ in range(150):
        f = r.getrandbits(64)
        prints.add(f)
        for _ in range(r.randint(0, 4)):
            for _ in range(r.randint(1, 4)):
                f ^= 1 << r.randrange(64)
            prints.add(f)
    dense = r.getrandbits(64)
    prints |= {dense ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) for _ in range(300)}
    signed = [(f - (f >> 63 << 64),) for f in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    assert all(((e.a ^ e.b) & (1 << 64) - 1).bit_count() <= 3 for e in edges.collect())
    roots = {n.node & (1 << 64) - 1: n.root & (1 << 64) - 1 for n in components(edges, "a", "b").collect()}
    want = plain_components({f: f for f in prints})
    groups = {}
    for f in prints:
        groups.setdefault(roots.get(f, f), set()).add(f)
    expected = {}
    for f in prints:
        expected.setdefault(want[f], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("n", [2, 65])
def test_components_of_chains_and_hubs(spark, n):
    chain = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(n)] + [(3, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long"), "u", "v").collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000 + i: 1000 for i in range(n) if n > 1}


def test_odd_rows(spark, odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    empty = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in empty} == {None, 1, 2, 3} and {r.component_id for r in empty} == {1}
    same = [r.component_id for r in got if r.doc_id in (4, 5)]
    assert same.count(4) == 3
    assert simhash.near_duplicates(no_docs).count() == 0


def test_keep_one(spark, odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    classes = simhash.near_duplicates(odd_docs).select("fingerprint").distinct().count()
    rows = kept.collect()
    assert len(rows) <= classes
    assert sum((r.text or "").startswith("the same") for r in rows) == 1
    assert sum(not (r.text or "").strip() for r in rows) == 1
    assert simhash.keep_one(no_docs).count() == 0


def test_keep_one_keeps_the_first_of_each_component(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert kept == sorted({r.component_id for r in simhash.near_duplicates(docs).collect()})

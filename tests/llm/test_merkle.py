"""The Merkle manifest against trees built in plain Python."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from rowloom.llm import merkle

NEEDED = ["doc_id", "text", "lang", "source", "n_chars"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """The top of the nodes and, for each, the (left, right) digests level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at):
            first = i - i % 3
            path.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 3])))
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], paths


def by_hand(docs):
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in docs.select(*NEEDED).toLocalIterator():
        found = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            found = text.replace("\n", "")
        row = doc_id, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, n_chars, found)
        groups[source].append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    if not names:
        return []
    for rows in groups.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    subtrees = [tree([row[1] for row in groups[name]]) for name in names]
    root, above = tree([top for top, _ in subtrees])
    out = []
    for name, (subroot, paths), over in zip(names, subtrees, above):
        for (doc_id, own, seen), path in zip(groups[name], paths):
            for left, right in path + over:
                seen = h(left, seen, right)
            proof = h(*(left + right for left, right in path + over))
            out.append((doc_id, own, subroot, root, proof, seen, seen == root))
    return sorted(out, key=repr)


def got(docs, levels=merkle.LEVELS):
    return sorted(map(tuple, merkle.audit(docs, levels).collect()), key=repr)


@pytest.mark.parametrize("levels", [2, merkle.LEVELS])
def test_manifest_of_documents(spark, sf_dir, levels):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = got(docs, levels)
    assert rows == by_hand(docs)
    assert {row[-1] for row in rows} == {True, False}


@pytest.mark.parametrize("n", [1, 10, 83])
def test_one_hot_source_over_many_blocks(spark, n):
    # Blocks of nine rows: the hot source takes several steps, the others stop earlier.
    rows = [(i * 7, f"a\nb{i}", "en", "hot" if i < n else f"s{i}", i) for i in range(n + 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert got(docs, levels=2) == by_hand(docs)


def test_odd_rows(spark, odd_docs, no_docs):
    assert got(odd_docs) == by_hand(odd_docs)
    assert got(no_docs) == []
    taken = odd_docs.selectExpr("*", "'x' as leaf", "1 as pos", "2 as n", "'y' as node", "3 as _at", "4 as `group`", "5 as seen")
    assert got(taken) == by_hand(odd_docs)


def test_all_rows_equal(spark):
    docs = spark.range(40).selectExpr("1L as doc_id", "'x' as text", "'en' as lang", "'s' as source", "1L as n_chars")
    assert got(docs, levels=1) == by_hand(docs)


def test_texts_are_not_moved(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    leaves = merkle.leaves(docs, merkle.without_newlines_if_even())
    assert "Exchange" not in leaves._jdf.queryExecution().executedPlan().toString()
    assert "text" not in leaves.columns

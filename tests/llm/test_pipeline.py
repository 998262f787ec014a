"""Each stage of the pipeline on all that its predecessor kept, against plain Python and SQL."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rowloom.llm import decontaminate, rule_quality
from rowloom.llm.oracle import MIXING_PARTS
from rowloom.llm.queries import tokenizer_path
from test_near_copies import similar_pairs
from test_token_store import expected

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Documents before and after each stage, as written."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name)
        stage(spark, docs, SF).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path), path)
        docs = out[name][1]
    return out


def texts_of(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def test_all_but_the_last_keep_the_columns(steps):
    for name in ("quality", "near_duplicates", "decontamination", "mixture"):
        before, after, _ = steps[name]
        assert after.columns == before.columns


def test_quality(spark, steps):
    before, after, _ = steps["quality"]
    model = rule_quality.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    stats = before.select("doc_id", *(c.alias(n) for n, c in rule_quality.statistics(F.col("text")).items())).toPandas()
    good = rule_quality.predict(model, stats.drop(columns="doc_id").to_numpy()) >= 0.5
    assert set(texts_of(after)) == set(stats["doc_id"][good])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = [labels[i] for i in texts_of(after) if i in labels]
    assert sum(kept) / len(kept) > 0.95


def test_near_duplicates(steps):
    """One document of each group stays: no two that are left are one text, few are similar, and no other goes."""
    before, after, _ = steps["near_duplicates"]
    texts = {i: t or "" for i, t in texts_of(before).items()}
    ids = sorted(texts)
    kept = set(texts_of(after))
    plain = {i: b" ".join(texts[i].encode().lower().split()) for i in ids}
    assert len({plain[i] for i in kept}) == len(kept)
    pairs = [(ids[a], ids[b]) for a, b in similar_pairs([texts[i] for i in ids])]
    missed = sum(plain[a] != plain[b] and a in kept and b in kept for a, b in pairs)
    assert missed <= 0.1 * len(pairs)
    linked = {i for pair in pairs for i in pair}
    assert set(ids) - linked <= kept


def test_decontamination(spark, steps):
    before, after, _ = steps["decontamination"]
    items = [decontaminate.tokens_of(r.text)[0] for r in decontaminate.read_benchmark(spark, SF).collect()]
    size = decontaminate.WINDOW
    windows = {tuple(w[k : k + size]) for w in items for k in range(len(w) - size + 1)}
    kept = set(texts_of(after))
    gone = 0
    for i, text in texts_of(before).items():
        words = decontaminate.tokens_of(text)[0]
        shared = [k for k in range(len(words) - size + 1) if tuple(words[k : k + size]) in windows]
        whole = any(words[k : k + len(w)] == w for k in shared for w in items)
        gone += whole
        assert not (whole and i in kept)
        assert shared or i in kept
    assert gone > 0


def test_mixture(steps):
    before, after, _ = steps["mixture"]
    path = steps["decontamination"][2]
    sql = f"with docs as (select * from '{path}/*.parquet'), {MIXING_PARTS} select doc_id, copies from mixed where copies > 0"
    want = Counter({i: c for i, c in duckdb.sql(sql).fetchall()})
    assert Counter(r.doc_id for r in after.select("doc_id").collect()) == want
    assert set(map(tuple, after.distinct().collect())) <= set(map(tuple, before.collect()))


def test_tokens(steps):
    before, after, _ = steps["tokens"]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
    want = expected(rows, lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids)
    assert sorted(map(tuple, after.collect())) == sorted(want)


def test_run_gives_the_rows_of_the_stages(spark, steps):
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, steps["tokens"][1].collect()))


def test_odd_rows_pass_through(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            ids = {r.doc_id for r in out.select("doc_id").collect()}
            assert ids <= {r.doc_id for r in docs.select("doc_id").collect()}
            if name != "tokens":
                assert out.columns == docs.columns
            if docs is no_docs:
                assert not ids

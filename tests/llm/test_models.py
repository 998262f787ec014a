"""Quality rules, languages, decontamination and the language model against plain Python."""

import math
import random
import tempfile
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowloom.llm import attention_lm, decontaminate, language, rule_quality
from rowloom.llm.encoding import Encoder
from rowloom.llm.queries import op2_decontaminate, op4_rule_quality, op5_language, op8_attention_lm, tokenizer_path

BIG = "/root/testdata/sf0.1"


def area(scores, labels):
    """Area under the curve: share of pairs in the right order."""
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(order))
    values, inverse, counts = np.unique(np.asarray(scores)[order], return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    ranks[order] = (ends - (counts - 1) / 2)[inverse]
    labels = np.asarray(labels) == 1
    n = labels.sum()
    return (ranks[labels].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


def test_quality_on_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = op4_rule_quality(spark, BIG).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert area([s for s, _, _ in held], [y for _, y, _ in held]) > 0.95
    good = [p for _, y, p in held if y == 1]
    assert sum(good) / len(good) > 0.98


def test_labels_of_the_held_out_fold_are_not_read(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    flipped = labels.withColumn(
        "quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    assert rule_quality.fit(docs, labels) == rule_quality.fit(docs.repartition(7), flipped)


def test_compiled_rules_equal_numpy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = rule_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    stats = docs.select("doc_id", *(c.alias(n) for n, c in rule_quality.statistics(F.col("text")).items())).toPandas()
    want = dict(zip(stats["doc_id"], rule_quality.predict(model, stats.drop(columns="doc_id").to_numpy())))
    got = {r.doc_id: r.score for r in rule_quality.score(docs, model).collect()}
    assert got == pytest.approx(want)


def test_quality_of_odd_rows(spark, sf_dir, odd_docs, no_docs):
    model = rule_quality.fit(spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet"))
    rows = rule_quality.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    kept = rule_quality.keep_good(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.predicted for r in rows)
    assert rule_quality.score(no_docs, model).count() == 0
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert {r.score for r in rule_quality.score(odd_docs, rule_quality.fit(odd_docs, none)).collect()} == {0.5}


# Languages


def test_languages_of_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    declared = {r.page_id: r.d for r in pages.select("page_id", F.regexp_extract("html", 'lang="(..)', 1).alias("d")).collect()}
    rows = op5_language(spark, sf_dir).collect()
    assert len(rows) == len(declared)
    assert sum(r.lang == declared[r.page_id] for r in rows) / len(rows) > 0.97
    assert sum(r.text_lang == declared[r.page_id] for r in rows) / len(rows) > 0.9
    assert all(0 < r.confidence <= 1 for r in rows)


def plain_fusion(model, evidence):
    """Posteriors of ``evidence``: id -> (log evidence, declared, suffix, domain, host)."""
    p = {}
    for i, (e, *_) in evidence.items():
        x = np.exp(np.array(e) - max(e))
        p[i] = x / x.sum()
    every = sum(p.values()) + language.SMOOTHING
    out = {}
    for i, (e, declared, suffix, domain, host) in evidence.items():
        def sums(k, value):
            return sum((p[j] for j, row in evidence.items() if row[k] == value), np.zeros(len(e)))

        g = every / every.sum()
        d = np.maximum(sums(3, domain) - p[i], 0)
        d = (d + language.PRIOR_PAGES * g) / (d.sum() + language.PRIOR_PAGES)
        h = np.maximum(sums(4, host) - p[i], 0)
        h = (h + language.PRIOR_PAGES * d) / (h.sum() + language.PRIOR_PAGES)
        total = np.array(e) + np.log(h)
        for k, value in ((1, declared), (2, suffix)):
            kinds = len({row[k] for row in evidence.values()})
            total += np.log((sums(k, value) + language.SMOOTHING) / (every + language.SMOOTHING * kinds))
        x = np.exp(total - total.max())
        out[i] = x / x.sum()
    return out


def test_fusion_equals_plain_python(spark, sf_dir):
    model = language.fit_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = [
        (1, "http://a.site.fr/x", "<html lang=de><body>the and of ing</body>"),
        (2, "http://a.site.fr/y", "<html lang='fr'>les des vous entre</html>"),
        (3, "http://b.site.fr/", "<p>les des vous entre</p>"),
        (4, "http://other.com/", "<html lang=en-US>the and of ing that</html>"),
        (5, None, None),
        (6, "no address", ""),
        (6, "http://a.site.fr/x", "<script>the and</script><!-- of -->12"),
    ]
    pages = spark.createDataFrame([(*r, 1.0) for r in rows[:6]], "page_id long, url string, html string, p double")
    seen = language.page_evidence(pages, model).collect()
    evidence = {r.page_id: (r.evidence, r.declared, r.suffix, r.domain, r.host) for r in seen}
    assert evidence[1][1:] == ("=de", "=fr", "=site.fr", "=a.site.fr") and evidence[5][1:] == ("null",) * 4
    want = plain_fusion(model, evidence)
    for r in language.identify(pages, model).collect():
        assert r.confidence == pytest.approx(want[r.page_id].max())
        assert r.lang == model.languages[int(want[r.page_id].argmax())]
    assert language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model).count() == 7


def test_languages_without_pages_or_documents(spark, sf_dir, no_docs):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = language.fit_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert language.identify(pages.limit(0), model).count() == 0
    assert {r.lang for r in language.identify(pages, language.fit_text(no_docs)).collect()} == {None}


def test_trigram_blocks_do_not_change_counts(monkeypatch):
    text = "Les élèves ont 3 pommes, the end. " * 50
    whole = language.trigram_counts(text)
    monkeypatch.setattr(language, "_BLOCK", 7)
    assert (language.trigram_counts(text) == whole).all() and whole.sum() > 0


# Decontamination

ITEM = "Tom has 12 apples and gives Anna 5 apples. How many apples does Tom have after he met Anna for 3 hours at the old market near the river?"


def found(spark, texts, items):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.contaminations(docs, bench).collect()}


def test_reparameterised_questions_are_caught(spark):
    again = ITEM.replace("Tom", "Bob").replace("Anna", "Jane").replace("12", "31").replace(" 5 ", " 7 ").replace("3 hours", "9 minutes")
    mixed_up = again.replace("does Bob", "does Jane").replace("met Jane", "met Paul")
    filler = " ".join(f"filler{i}" for i in range(50))
    got = found(
        spark,
        [ITEM, f"{filler} {again} {filler}", f"{filler} {mixed_up}", filler, None, "", ITEM.lower(), f"{filler}. {ITEM[:60]}"],
        [ITEM, "too short", None, ITEM],
    )
    assert {d for d, _ in got} == {0, 1, 6}
    assert {i for _, i in got} == {0, 3}
    assert got[0, 0].share == 1 and got[0, 0].changed_slots == 0
    assert got[1, 0].changed_slots > 0


def test_a_clash_removes_only_the_windows_that_hold_it(spark):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    words[20] = words[40] = "40"
    twice = " ".join(words)
    words[40] = "45"
    apples = "Yesterday the farmer packed 3 apples into a box and then put 4 apples on the shelf above the door of the barn"
    got = found(
        spark,
        [" ".join(words), apples.replace("3", "4"), apples.replace("3", "7").replace(" 4 ", " 7 ")],
        [twice, apples],
    )
    assert set(got) == {(0, 0), (1, 1), (2, 1)}
    assert got[0, 0].n_windows >= 53 - 16


def test_names_that_open_sentences_are_replaced(spark):
    item = "Anna bought 12 pens for 3 euros each. Anna sold 4 pens to Ben. How many pens does Anna have left?"
    again = item.replace("Anna", "Mary").replace("Ben", "Tim").replace("12", "15").replace(" 3 ", " 2 ").replace(" 4 ", " 6 ")
    mixed_up = again.replace("Mary sold", "Paul sold").replace("does Mary", "does Jane")
    inside = "We know that " + again
    filler = " ".join(f"filler{i}" for i in range(30))
    got = found(spark, [item, again, f"{filler}. {again} {filler}", inside, mixed_up, filler], [item])
    assert {d for d, _ in got} == {0, 1, 2, 3}
    assert got[1, 0].share == 1 and got[1, 0].changed_slots == 5


def test_thirteen_tokens_in_a_row_are_a_passage(spark):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    split = [*words[5:14], "other", *words[15:24], "other", *words[25:34]]
    got = found(spark, [" ".join(words[5:18]), " ".join(words[5:17]), " ".join(split)], [" ".join(words)])
    assert set(got) == {(0, 0)} and got[0, 0].longest_run == 6


def test_short_items_are_one_window(spark):
    got = found(spark, ["x The capital of France is it y", "The capital of it France is"], ["the capital of france is it", "a b c d"])
    assert set(got) == {(0, 0)}


MANY_SLOTS = (
    "At the fair Tom paid 3 euros, Anna paid 5 euros, Ben paid 7 euros, Eva paid 4 euros, "
    "Max paid 6 euros, Lea paid 9 euros. How much did all pay?"
)


def test_questions_full_of_slots_are_caught(spark):
    """Windows with few words as they stand are widened until they have four."""
    again = MANY_SLOTS
    names = {"Tom": "Jim", "Anna": "Rosa", "Ben": "Karl", "Eva": "Ida", "Max": "Otto", "Lea": "Nora"}
    for a, b in {**names, " 3 ": " 13 ", " 5 ": " 15 ", " 7 ": " 17 ", " 4 ": " 14 ", " 6 ": " 16 ", " 9 ": " 19 "}.items():
        again = again.replace(a, b)
    filler = " ".join(f"filler{i}" for i in range(30))
    table = " ".join(str(i) for i in range(60))
    other_table = " ".join(str(i) for i in range(100, 160))
    got = found(spark, [MANY_SLOTS, f"{filler}. {again} {filler}", filler, table, other_table], [MANY_SLOTS, table])
    assert set(got) == {(0, 0), (1, 0), (3, 1)}
    assert got[0, 0].share == 1 and got[1, 0].share >= 0.5 and got[1, 0].changed_slots >= 12


def plain_windows(text, sizes):
    """Windows of a text, one token after another."""
    words, kinds, opening = decontaminate.tokens_of(text)
    n, made = len(words), set()
    for form, known in enumerate([{}, kinds, kinds | dict.fromkeys(opening, "n")]):
        marks = [f"<{ {'#': 'number', 'u': 'unit', 'n': 'name'}[known[i]]}>" if i in known else words[i] for i in range(n)]
        for start in range(n):
            for size in sizes:
                end = start + size
                while form and size == decontaminate.WINDOW and end <= n and sum(j not in known for j in range(start, end)) < 4:
                    end += 1
                if end > n or end - start > 32:
                    continue
                slots = tuple(f"{known[j]}{j - start}:{words[j]}" for j in range(start, end) if j in known)
                if form and (not slots or end - start - len(slots) < min(4, size - 1)):
                    continue
                if form == 2 and not any(start <= j < end for j in opening):
                    continue
                made.add((min(form, 1), start, tuple(marks[start:end]), slots))
    return made


def test_windows_equal_plain_python(spark, sf_dir):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    texts += ["", " ", ". ! ?", "x  y\n\nA.b\tC", ITEM, MANY_SLOTS, "Tom paid 3 euros. Anna paid 5 euros, Ben\nMay", "a_b 3 m 4. m"]
    made = decontaminate._Windows([6, 8], None)
    got, by_hash = {}, {}
    for number, view, size, value, place, slots in made.of(texts):
        got.setdefault(number, set()).add((view, place, size, tuple(slots)))
        by_hash.setdefault((number, view, place, size, tuple(slots)), value)
    same = {}
    for number, text in enumerate(texts):
        want = plain_windows(text, [6, 8])
        assert got.get(number, set()) == {(v, p, len(m), s) for v, p, m, s in want}
        for view, place, marks, slots in want:
            same.setdefault(marks, set()).add(by_hash[number, view, place, len(marks), slots])
    # One hash for one row of marks, and another for another.
    assert all(len(values) == 1 for values in same.values())
    assert len({next(iter(values)) for values in same.values()}) == len(same)


def test_shared_openings_start_no_pair(spark, monkeypatch):
    """An opening of many items meets every document that has it, but starts no pair with any."""
    opening = "for each of the questions below choose the one right answer here"
    tails = [" ".join(f"item{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(20)) for i in range(40)]
    others = [" ".join(f"page{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(20)) for i in range(100)]
    texts = [f"{opening} {t}" for t in [*others, tails[7], tails[9]]]
    n_pairs = []
    plain = decontaminate.started_pairs

    def counted(windows, item_side):
        pairs = plain(windows, item_side)
        n_pairs.append(pairs.count())
        return pairs

    monkeypatch.setattr(decontaminate, "started_pairs", counted)
    got = found(spark, texts, [f"{opening} {t}" for t in tails])
    assert set(got) == {(100, 7), (101, 9)}
    assert n_pairs == [2]


def test_bitmap_drops_no_match(spark, sf_dir):
    """Every planted passage: documents that hold all words of an item in a row."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    bench = spark.read.parquet(f"{BIG}/benchmark.parquet")
    words = {r.item_id: decontaminate.tokens_of(r.text)[0] for r in bench.collect()}
    index = {}
    for i, w in words.items():
        if len(w) >= decontaminate.WINDOW:
            index.setdefault(tuple(w[: decontaminate.WINDOW]), []).append(i)
    want = set()
    for r in docs.select("doc_id", "text").toLocalIterator():
        t = decontaminate.tokens_of(r.text or "")[0]
        for k in range(len(t) - decontaminate.WINDOW + 1):
            for i in index.get(tuple(t[k : k + decontaminate.WINDOW]), ()):
                if t[k : k + len(words[i])] == words[i]:
                    want.add((r.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in op2_decontaminate(spark, BIG).collect()}
    assert len(want) > 200 and want <= got
    assert len({d for d, _ in got} - {d for d, _ in want}) <= 5


def test_decontamination_of_odd_rows(spark, sf_dir, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "the same text of some words that stay the same"), (None, None)], "item_id long, text string")
    kept = decontaminate.drop_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in odd_docs.collect() if not (r.text or "").startswith("the same"))
    assert decontaminate.drop_contaminated(no_docs, bench).count() == 0
    assert decontaminate.drop_contaminated(odd_docs, bench.limit(0)).count() == odd_docs.count()


# Language model


def small_subwords(n=40):
    return attention_lm.subword_classes(np.random.default_rng(0).integers(0, 50, n + 1))


def test_gradient_by_differences():
    r = np.random.default_rng(1)
    subwords = small_subwords()
    flat = attention_lm.pack(attention_lm.first_weights(subwords))
    x = r.integers(0, attention_lm.SLOTS + 30, (3, 2 * attention_lm.BLOCK))
    x[0, : attention_lm.BLOCK] = subwords.pad
    y = r.integers(-1, attention_lm.CLASSES, (3, attention_lm.BLOCK))
    loss = lambda f: attention_lm.loss_and_gradient(attention_lm.unpack(f), x, y, subwords.pad)
    gradient = attention_lm.pack(loss(flat)[1])
    for at in [*np.argsort(-np.abs(gradient))[:15], *r.integers(0, len(flat), 15)]:
        step = np.zeros_like(flat)
        step[at] = 1e-5
        assert (loss(flat + step)[0] - loss(flat - step)[0]) / 2e-5 == pytest.approx(gradient[at], abs=1e-6)


def plain_log_p(flat, subwords, ids):
    """Log probability of a text, token after token, from the weights."""
    w = attention_lm.unpack(flat)
    block = attention_lm.BLOCK
    seen = [subwords.start, *(subwords.slot[i] for i in ids)]
    targets = [*ids, len(subwords.slot) - 1]
    total = 0.0
    for t, target in enumerate(targets):
        low = max(0, (t // block - 1) * block)
        keys = np.array([w["e"][s] for s in seen[low : t + 1]])
        q = w["e"][seen[t]] @ w["q"]
        s = keys @ w["k"] @ q / math.sqrt(attention_lm.WIDTH) + w["r"][t - np.arange(low, t + 1)]
        a = np.exp(s - s.max())
        a /= a.sum()
        z = (w["e"][seen[t]] + a @ keys @ w["v"] @ w["o"]) @ w["u"] + w["b"]
        z -= z.max()
        total += z[subwords.klass[target]] - math.log(np.exp(z).sum()) + subwords.log_share[target]
    return total


def test_scorer_equals_token_by_token():
    subwords = small_subwords()
    r = np.random.default_rng(2)
    flat = attention_lm.pack(attention_lm.first_weights(subwords)) + r.normal(0, 0.1, sum(int(np.prod(s)) for s in attention_lm._SHAPES.values()))
    texts = [r.integers(0, 40, n) for n in (0, 1, 15, 16, 17, 31, 32, 33, 100)]
    got = attention_lm.Scorer(flat, subwords).log_probabilities(texts)
    assert got == pytest.approx([plain_log_p(flat, subwords, t) for t in texts], rel=1e-4)


def test_classes_and_shares_sum_to_one():
    subwords = small_subwords(500)
    for k in set(subwords.klass):
        assert np.exp(subwords.log_share[subwords.klass == k]).sum() == pytest.approx(1)


def test_language_model_of_documents(spark, sf_dir, texts):
    rows = {r.doc_id: r for r in op8_attention_lm(spark, sf_dir).collect()}
    words = {i: (t or "").encode().lower().split() for i, t, _ in texts}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for i, ws in words.items():
        r = rows[i]
        tokens = [*ws, None]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(tokens), n)
        assert r.n_known == sum(w in counts for w in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
        assert r.score < 0
    # On texts it has not seen, better than the frequencies of subwords alone.
    encoder = Encoder(tokenizer_path())
    plain = {i: " " + b" ".join(ws).decode() if ws else "" for i, ws in words.items()}
    ids = {i: np.frombuffer(encoder.encode([t])[0], encoder.dtype) for i, t in plain.items()}
    n_ids = np.ones(encoder.vocab_size + 1)
    for i, found_ids in ids.items():
        if not held[i]:
            np.add.at(n_ids, [*found_ids, encoder.vocab_size], 1)
    logs = np.log10(n_ids / n_ids.sum())
    unseen = [i for i in rows if held[i]]
    assert sum(rows[i].score for i in unseen) > sum(logs[ids[i]].sum() + logs[-1] for i in unseen)


def test_training_helps(spark, sf_dir):
    """The trained weights beat those that know frequencies alone."""
    r = random.Random(1)
    subwords = small_subwords(30)
    ids = [np.array([(k + j) % 30 for j in range(64)]) for k in (r.randrange(30) for _ in range(300))]
    windows, classes = [], []
    for t in ids:
        x, y = attention_lm.blocks_of(t, subwords)
        for b in range(1, len(x)):
            windows.append(np.concatenate([x[b - 1], x[b]]))
            classes.append(np.where(y[b] >= 0, subwords.klass[y[b]], -1))
    windows, classes = np.array(windows), np.array(classes)
    first = attention_lm.pack(attention_lm.first_weights(subwords))
    trained = attention_lm.train_group(first, windows, classes, subwords.pad)
    loss = lambda f: attention_lm.loss_and_gradient(attention_lm.unpack(f), windows, classes, subwords.pad)[0]
    assert loss(trained) < 0.5 * loss(first)


def test_language_model_of_odd_rows(spark, odd_docs, no_docs):
    rows = attention_lm.score_texts(odd_docs, tokenizer_path()).collect()
    assert len(rows) == odd_docs.count()
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert attention_lm.score_texts(no_docs, tokenizer_path()).count() == 0


def test_every_block_of_every_text_is_trained_on(spark, monkeypatch):
    """Short and long texts, cut in segments or not: the windows of ``blocks_of``, each once a round."""
    subwords = small_subwords()
    r = np.random.default_rng(3)
    monkeypatch.setattr(attention_lm, "SEGMENT", 4)
    texts = [r.integers(0, 40, n).astype("<u2") for n in (0, 1, 15, 16, 17, 63, 64, 65, 127, 128, 129, 400)]
    n_windows = 0
    for ids in texts:
        x, y = attention_lm.blocks_of(ids, subwords)
        parts = [attention_lm.segment_windows(s, a, b, subwords) for _, a, b, s in attention_lm.segments_of(ids)]
        assert (np.concatenate([p[0] for p in parts]) == np.concatenate([x[:-1], x[1:]], axis=1)).all()
        assert (np.concatenate([p[1] for p in parts]) == np.where(y[1:] >= 0, subwords.klass[y[1:]], -1)).all()
        n_windows += len(x) - 1
    docs = spark.createDataFrame([(i, t.tobytes()) for i, t in enumerate(texts)], "doc_id long, ids binary")
    segments = docs.mapInArrow(attention_lm._segments("<u2"), "doc_id long, number int, first boolean, last boolean, ids binary")
    step = attention_lm._train_task(attention_lm.pack(attention_lm.first_weights(subwords)), subwords, "<u2")
    seen = step(segments.toPandas().assign(key=0))
    assert seen["n"].sum() == n_windows
    assert attention_lm.CLASSES >= 64


def test_short_training_texts_move_the_weights(spark):
    """Texts of a single block each: all of them are trained on."""
    subwords = small_subwords()
    for seed in range(5):
        ids = np.random.default_rng(seed).integers(0, 40, 9).astype("<u2")
        docs = spark.createDataFrame([(1, ids.tobytes())], "doc_id long, ids binary")
        flat = attention_lm.train(docs, subwords, "<u2")
        assert np.abs(flat - attention_lm.pack(attention_lm.first_weights(subwords))).max() > 0.01


def test_groups_are_trained_in_32_bits(spark, monkeypatch):
    """The kept arrays and 32 bits change nothing but the last digits of the weights."""
    subwords = small_subwords()
    r = np.random.default_rng(4)
    first = attention_lm.pack(attention_lm.first_weights(subwords))
    texts = [r.integers(0, 40, n).astype("<u2") for n in (0, 5, 16, 700, 2000, 33)]
    rows = [(i, *s[:3], s[3].tobytes()) for i, t in enumerate(texts) for s in attention_lm.segments_of(t)]
    frame = pd.DataFrame(rows, columns=["key", "number", "first", "last", "ids"])
    kinds, plain = [], attention_lm.train_group

    def recorded(flat, windows, classes, pad):
        kinds.append(flat.dtype)
        m, v, want = np.zeros_like(first), np.zeros_like(first), first.copy()
        for step, start in enumerate(range(0, len(windows), attention_lm.MINIBATCH), 1):
            part = slice(start, start + attention_lm.MINIBATCH)
            g = attention_lm.pack(attention_lm.loss_and_gradient(attention_lm.unpack(want), windows[part], classes[part], pad)[1])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            want -= attention_lm.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        got = plain(flat, windows, classes, pad)
        assert got.dtype == np.float32 and np.abs(got - want).max() < 1e-3 < np.abs(got - first).max()
        return got

    monkeypatch.setattr(attention_lm, "train_group", recorded)
    attention_lm._train_task(first, subwords, "<u2")(frame)
    assert kinds == [np.float32]


def test_gradient_of_large_weights():
    """Exponents beyond 32 bits: rows are shifted, and the result is that of 64 bits."""
    subwords = small_subwords()
    r = np.random.default_rng(5)
    x = r.integers(0, attention_lm.SLOTS, (4, 2 * attention_lm.BLOCK))
    x[1, : attention_lm.BLOCK] = subwords.pad
    y = r.integers(0, attention_lm.CLASSES, (4, attention_lm.BLOCK))
    for factor, bias in ((1, 200), (1, -200), (4, 0)):
        flat = attention_lm.pack(attention_lm.first_weights(subwords)) * factor
        flat[-attention_lm.CLASSES :] += bias
        got, want = (attention_lm.loss_and_gradient(attention_lm.unpack(flat.astype(kind)), x, y, subwords.pad) for kind in ("f4", "f8"))
        assert got[0] == pytest.approx(want[0], rel=1e-3)
        for name, gradient in want[1].items():
            assert np.abs(got[1][name] - gradient).max() <= 1e-3 * max(1, np.abs(gradient).max())


def test_windows_of_many_segments(monkeypatch):
    """All segments of a group at once: the windows of each, one after another."""
    subwords = small_subwords()
    r = np.random.default_rng(6)
    monkeypatch.setattr(attention_lm, "SEGMENT", 2)
    texts = [r.integers(0, 40, n).astype("<u2") for n in (0, 0, 1, 15, 16, 31, 32, 33, 63, 64, 200, 0)]
    segments = [s for t in texts for s in attention_lm.segments_of(t)]
    x, y = attention_lm.windows_of([s[3] for s in segments], *(np.array([s[k] for s in segments]) for k in (1, 2)), subwords)
    wanted = [attention_lm.blocks_of(t, subwords) for t in texts]
    assert (x == np.concatenate([np.concatenate([b[:-1], b[1:]], axis=1) for b, _ in wanted])).all()
    assert (y == np.concatenate([np.where(t[1:] >= 0, subwords.klass[t[1:]], -1) for _, t in wanted])).all()


def test_words_encoded_together(spark, sf_dir, texts):
    """The ids of words encoded as one text are those of each behind a space."""
    encoder = Encoder(tokenizer_path())
    r = random.Random(7)
    letters = [*"ab1'.,;$-é漢字\x00\x1c​", "'s", "Ġ"]
    odd = ["".join(r.choices(letters, k=r.randint(1, 8))) for _ in range(3000)]
    spaces = ["a\xa0b", "\x85", " c", "d　", "<|endoftext|>", "x<|endoftext|>y"]
    known = sorted({w.decode() for _, t, _ in texts for w in (t or "").encode().lower().split()})
    for words in ([], ["a"], odd, known, odd[:20] + spaces + odd[20:40]):
        ids, lengths = encoder.encode_words(words)
        want = encoder.encode([" " + w for w in words])
        assert ids.tobytes() == b"".join(want)
        assert lengths.tolist() == [len(code) // encoder.dtype.itemsize for code in want]


def test_rounds_leave_no_shuffle_files(spark):
    """The segments that a round moved are gone when it ends; the setting of the session is as before."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    folder = Path(spark.conf.get("spark.local.dir", tempfile.gettempdir()))
    files = lambda: set(folder.glob("blockmgr-*/*/shuffle_*.data"))
    ids = np.random.default_rng(8).integers(0, 40, (200, 30)).astype("<u2")
    docs = spark.createDataFrame([(i, t.tobytes()) for i, t in enumerate(ids)], "doc_id long, ids binary")
    old = files()
    attention_lm.train(docs, small_subwords(), "<u2")
    made = [f for f in files() - old]
    end = time.time() + 10
    while any(f.exists() and f.stat().st_size > 10_000 for f in made) and time.time() < end:
        time.sleep(0.2)
    assert not [f for f in made if f.exists() and f.stat().st_size > 10_000]
    assert spark.conf.get(name) == before

"""Piece counts, secrets, line rules and mixing against plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest
from tokenizers.models import WordPiece

from rowloom.llm import line_rules, mixing, piece_counts, secret_ledger
from rowloom.llm.queries import op3_piece_counts, op6_secret_ledger, tokenizer_path

MODEL = "piece_bpe_32k.model"


def greedy(starts, continuations, word):
    """Pieces of a word by trying all lengths, longest first; 0 if there is no match."""
    pieces = at = 0
    while at < len(word):
        known = continuations if at else starts
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return 0
        pieces, at = pieces + 1, end
    return pieces


def test_automaton_on_random_vocabularies():
    r = random.Random(1)
    for _ in range(60):
        make = lambda n: {"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(n)}
        starts, continuations = make(12), make(r.randint(0, 12))
        machine = piece_counts.Automaton(starts, continuations)
        for _ in range(200):
            word = "".join(r.choice("abcd" if r.random() < 0.1 else "abc") for _ in range(r.randint(1, 12)))
            assert machine.count(word) == greedy(starts, continuations, word), (starts, continuations, word)


def test_automaton_equals_the_library():
    starts, continuations = piece_counts.piece_vocabulary(tokenizer_path(MODEL))
    names = [*starts, *("\ue000" + c for c in continuations), "[UNK]"]
    library = WordPiece({n: i for i, n in enumerate(names)}, unk_token="[UNK]", max_input_chars_per_word=30, continuing_subword_prefix="\ue000")
    machine = piece_counts.Automaton(starts, continuations, max_chars=30)
    r = random.Random(2)
    for _ in range(3000):
        word = "".join(r.choice("etaoinshrdlé漢.##1𝛼") for _ in range(r.randint(1, 33)))
        got = [t.value for t in library.tokenize(word)]
        assert machine.count(word) == (0 if got == ["[UNK]"] else len(got)), word


def test_piece_counts_of_documents(spark, sf_dir, texts):
    starts, continuations = (set(x) for x in piece_counts.piece_vocabulary(tokenizer_path(MODEL)))
    known = {}
    want = []
    for doc_id, text, _ in texts:
        words = (text or "").encode().split()
        for word in set(words).difference(known):
            known[word] = greedy(starts, continuations, word.decode())
        counts = [known[w] for w in words]
        want.append((doc_id, len(words), sum(c or 1 for c in counts), counts.count(0)))
    assert sorted(map(tuple, op3_piece_counts(spark, sf_dir).collect())) == sorted(want)


def test_piece_counts_of_odd_rows(spark, odd_docs, no_docs):
    got = piece_counts.token_counts(odd_docs, tokenizer_path(MODEL)).collect()
    assert len(got) == odd_docs.count()
    assert all(r.n_tokens == 0 for r in got if r.doc_id in (1, 2, 3))
    assert piece_counts.token_counts(no_docs, tokenizer_path(MODEL)).count() == 0


def plain_base(text):
    text = text or ""
    found = []
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


KINDS = ["assign", "access", "hex"]


def joined(found):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def test_secrets_of_documents(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smaller tables hold none
    texts = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in op6_secret_ledger(spark, sf_dir).collect()}
    assert len(got) == len(texts)
    n = 0
    for doc_id, text in texts:
        base = plain_base(text)
        n += len(base)
        r = got[doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if s.split(":")[0] in KINDS] == joined(base).split(",")[: len(base)]
    assert n > 0


@pytest.mark.parametrize(
    "text",
    [
        'é token=secret: longvalue123 PASSWORD = "abcdefgh" ſecret=abcdefghij apikey:12345678',
        "AKIA AKIAAKIA AKIA0123456789AB" + "f" * 31 + " " + "0" * 33 + "g" + "a" * 32 + "é",
        "secret==abcdefgh token='' password : 'x' passwd=........ api_key=\"ABC/def+123=\"",
    ],
)
def test_base_rules(text):
    got = sorted((a, i, b) for i, rule in enumerate(secret_ledger.BASE_RULES) for a, b in secret_ledger.spans_of(text, rule))
    assert got == plain_base(text)


def test_ledger_scans_only_what_is_new(spark, tmp_path, odd_docs):
    ledger = str(tmp_path / "ledger")
    first = secret_ledger.BASE_RULES
    docs = odd_docs.select("doc_id", "text")
    secret_ledger.scan_new(docs, ledger, first)
    n_blobs = docs.selectExpr("coalesce(text, '') t").distinct().count()
    assert secret_ledger.read_ledger(spark, ledger).count() == 3 * n_blobs
    secret_ledger.scan_new(docs, ledger, first)
    assert secret_ledger.read_ledger(spark, ledger).count() == 3 * n_blobs
    more = docs.union(spark.createDataFrame([(99, "new text -----BEGIN RSA PRIVATE KEY-----")], docs.schema))
    secret_ledger.scan_new(more, ledger)
    assert secret_ledger.read_ledger(spark, ledger).count() == 6 * (n_blobs + 1)
    newer = (first[0]._replace(version=2), *first[1:])
    secret_ledger.scan_new(more, ledger, newer)
    assert secret_ledger.read_ledger(spark, ledger).count() == 7 * (n_blobs + 1)
    got = {r.doc_id: [f.kind for f in r.found] for r in secret_ledger.findings(more, ledger).collect() if r.doc_id}
    assert got[99] == ["private_key"] and got[8] == ["assign", "hex", "access"] and got[7] == []


def test_ledger_of_no_documents(spark, tmp_path, no_docs):
    secret_ledger.scan_new(no_docs, str(tmp_path / "none"))
    assert secret_ledger.findings(no_docs, str(tmp_path / "none")).count() == 0


def test_repeat_words_by_brute_force():
    r = random.Random(4)
    for _ in range(500):
        words = [r.choice("ab") if r.random() < 0.5 else r.choice("cdefgh") for _ in range(r.randint(0, 25))]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        n = Counter(windows)
        assert line_rules.repeat_words(words) == len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)})


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    def name(i, k):  # digits of a line are all one
        return "".join(chr(97 + int(d)) for d in f"{i}{k:02d}")

    own = [" ".join("w" + name(i, k) for k in range(60)) for i in range(40)]
    menu = "Menu of the Site 2024 " + " ".join("item" + chr(97 + k) for k in range(20))
    rows = [(i, text + ("\n" + menu.replace("2024", str(i)) if i < 30 else ""), "a") for i, text in enumerate(own)]
    rows += [(100 + i, " ".join("v" + name(i, k) for k in range(20)) + "\n" + menu + " \n" + menu.upper(), "a") for i in range(5)]
    rows += [(200, own[0] + "\n" + menu, None)]
    got = {r.doc_id: r for r in line_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].n_removed_words == 25 and got[0].kept and got[35].n_removed_words == 0 and got[35].kept
    assert all(got[100 + i].n_removed_words == 50 and not got[100 + i].kept for i in range(5))
    assert not got[100].base_failed
    assert got[200].n_removed_words == 0 and got[200].kept  # a host of its own


def test_verdict_does_not_depend_on_the_size_of_the_host(spark):
    def word(i):
        return "".join(chr(97 + int(d)) for d in f"{i:04d}")

    passage = " ".join("p" + word(k) for k in range(60))
    for size in (300, 2_000):
        docs = spark.range(size).selectExpr("id as doc_id", "cast(id as string) as t").collect()
        own = {r.doc_id: " ".join(f"o{word(r.doc_id)}{word(k)}" for k in range(55)) for r in docs}
        rows = [(i, text + ("\n" + passage if i < 80 else ""), "host") for i, text in own.items()]
        got = {r.doc_id: r for r in line_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
        assert all(got[i].n_removed_words == 60 and not got[i].kept for i in range(80))
        assert all(got[i].n_removed_words == 0 and got[i].kept for i in range(80, size))


def test_repeated_rows_of_one_id_do_not_make_a_line_frequent(spark):
    text = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    schema = "doc_id long, text string, source string"
    same = line_rules.apply_rules(spark.createDataFrame([(7, text, "a")] * 30, schema)).collect()
    assert len(same) == 30 and all(r.kept and r.n_removed_words == 0 for r in same)
    for n, removed in ((10, 0), (11, 60)):  # a line in exactly ten documents stays
        rows = [(None, text, "a")] * n
        assert {r.n_removed_words for r in line_rules.apply_rules(spark.createDataFrame(rows, schema)).collect()} == {removed}


def test_line_rules_of_odd_rows(spark, odd_docs, no_docs):
    got = line_rules.apply_rules(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in got if r.doc_id in (1, 2, 3))
    assert line_rules.apply_rules(no_docs).count() == 0


def plain_targets(sizes):
    """Targets by sharing again and again, sources in order."""
    total = sum(sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        shared = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / shared for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_by_sharing_again(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{i}": r.choice([0, 1, 10, 1000, 100000]) * r.randint(1, 9) for i in range(12)} | {None: r.randint(0, 500)}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix_comes_near_its_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix_plan(docs).collect()
    taken, target, size = Counter(), {}, Counter()
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        size[source[r.doc_id]] = max(size[source[r.doc_id]], r.size)
        target[source[r.doc_id]] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
    assert target == pytest.approx(plain_targets({r_: s for r_, s in {source[r.doc_id]: r.source_size for r in rows}.items()}))
    for name in target:
        assert abs(taken[name] - target[name]) <= 2 * size[name]
    copies = {r.doc_id: r.copies for r in rows}
    mixed = Counter(r.doc_id for r in mixing.mix(docs).select("doc_id").collect())
    assert mixed == Counter({i: c for i, c in copies.items() if c})


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    plan = mixing.mix_plan(odd_docs).collect()
    assert len(plan) == odd_docs.count()
    assert all(r.taken == 0 for r in plan if r.size == 0)
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() == sum(r.copies for r in plan)
    assert sorted(map(str, mixing.mix_plan(odd_docs.repartition(5)).collect())) == sorted(map(str, plan))
    assert mixing.mix_plan(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0

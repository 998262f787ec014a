"""Recursive BPE against the tiktoken library and against merges one by one."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from rowloom.llm import recursive_bpe as rb

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=rb.read_ranks(PATH), special_tokens={})
    return lambda text: np.array(encoding.encode_ordinary(text), "<u4").tobytes()


@pytest.fixture(scope="module")
def coder():
    return rb.Coder(PATH, PATTERN)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_query_equals_the_library(spark, sf_dir, texts, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted((i, len(library(t or "")) // 4, sha(library(t or "")), sha((t or "").encode())) for i, t, _ in texts)
    assert sorted(map(tuple, rb.round_trips(docs, PATH, PATTERN).collect())) == want


def test_ids_and_bytes_of_odd_rows(spark, odd_docs, no_docs, library):
    encoded = rb.encode_texts(odd_docs, PATH, PATTERN)
    rows = [(r.doc_id, r.text or "") for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, bytes(r.ids)) for r in encoded.collect()), key=repr) == sorted(
        ((i, library(t)) for i, t in rows), key=repr
    )
    decoded = rb.decode_ids(encoded, PATH, PATTERN).collect()
    assert sorted(((r.doc_id, bytes(r.bytes)) for r in decoded), key=repr) == sorted(((i, t.encode()) for i, t in rows), key=repr)
    for empty in (rb.encode_texts(no_docs, PATH, PATTERN), rb.round_trips(no_docs, PATH, PATTERN)):
        assert empty.collect() == []


@pytest.mark.parametrize(
    "text",
    [
        "a" * 5_000,
        "ab" * 3_000,
        " " * 777 + "x" + "\n" * 900,
        "0" * 3_001,
        "".join(random.Random(1).choice("abcdefgh") for _ in range(3_000)),
        "".join(chr(random.Random(i).randrange(0x4E00, 0x9FFF)) for i in range(600)),
        "<|endoftext|> \x1c\x1d x\x85y​z é it's I'LL",
    ],
)
def test_long_words_and_odd_characters(coder, library, text):
    (ids,) = coder.encode([text])
    assert ids == library(text)
    assert list(coder.decode([ids])) == [text.encode()]


def test_every_code_point(coder, library):
    points = [chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a{c}b {c}{c}1" for c in points[i : i + 8192]) for i in range(0, len(points), 8192)]
    assert list(coder.encode(texts)) == [library(text) for text in texts]


def test_words_of_any_length_by_either_query(library, texts):
    some = [t or "" for _, t, _ in texts[:60]]
    want = [library(text) for text in some]
    for long in (0, 5, 10_000):
        assert list(rb.Coder(PATH, PATTERN, long=long).encode(some)) == want


@pytest.mark.parametrize("seed", range(6))
def test_vocabularies_with_lower_ranks_inside(tmp_path, seed):
    """Random ranks: new pairs often have a lower rank than the pair that made them."""
    import base64

    rng = random.Random(seed)
    tokens = {bytes([b]) for b in range(256)}
    while len(tokens) < 256 + 150:
        left, right = rng.choices([t for t in sorted(tokens) if set(t) <= set(b"abc")], k=2)
        if len(left + right) <= 9:
            tokens.add(left + right)
    order = sorted(tokens)
    rng.shuffle(order)
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + f" {i}\n".encode() for i, t in enumerate(order)))
    ranks = rb.read_ranks(str(path))
    assert len(ranks) == len(tokens)

    def one_by_one(word):
        parts = [bytes([b]) for b in word]
        while word not in ranks or len(parts) == len(word):
            if word in ranks:
                return [ranks[word]]
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    want = [np.array(one_by_one(word.encode()), "<u4").tobytes() for word in words]
    for long in (0, 1_000):
        coder = rb.Coder(str(path), r"\S+|\s", long=long)
        assert list(coder.encode(words)) == want
        assert list(coder.decode(want)) == [word.encode() for word in words]


def test_memo_is_bounded(library):
    coder = rb.Coder(PATH, PATTERN, memo_words=50)
    some = [f"word{i} other{i * i} words of text {'z' * 70}" for i in range(200)]
    for text in some:
        assert list(coder.encode([text])) == [library(text)]
        assert len(coder._memo) <= 50 and len(coder._old) <= 50 + 20


def test_unknown_ids_fail(coder):
    with pytest.raises(ValueError, match="no token"):
        list(coder.decode([np.array([60_000], "<u4").tobytes()]))

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowloom.llm import token_store
from rowloom.llm.encoding import Encoder
from rowloom.llm.queries import op1_token_store, tokenizer_path


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def expected(rows, whole):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.asarray([*whole(text), 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_equals_the_library(spark, sf_dir, texts, whole):
    got = sorted(map(tuple, op1_token_store(spark, sf_dir).collect()))
    assert got == expected([(i, t) for i, t, _ in texts], whole)


def test_pieces_equal_whole_texts(whole):
    encoder = Encoder(tokenizer_path(), memo_pieces=300)
    letters = [*"ab1'. \n\t\x85\xa0 　\x1c\x1fé👍$,;", "'s", " the", "<|endoftext|>"]
    r = random.Random(3)
    cases = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    for text, data in zip(cases, encoder.encode(cases)):
        assert np.frombuffer(data, encoder.dtype).tolist() == whole(text), repr(text)


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_builds_are_encoded_whole(name):
    path = tokenizer_path(name)
    tokenizer = Tokenizer.from_file(path)
    cases = ["The  cat's hat\n\n it", "", "É à 12"]
    encoder = Encoder(path)
    for text, data in zip(cases, encoder.encode(cases)):
        assert np.frombuffer(data, encoder.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_round_trip_and_odd_rows(spark, tmp_path, odd_docs, whole):
    path = str(tmp_path / "store")
    token_store.write_store(odd_docs, path, tokenizer_path())
    got = token_store.read_store(spark, path, with_ids=True).orderBy("start").collect()
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert sorted(r.ids for r in got) == sorted([*whole(t), 0] for _, t in rows)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got]).tolist()[:-1]
    assert all(r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) for r in got)


def test_many_parts(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_store.write_store(docs, str(tmp_path / "many"), tokenizer_path())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = token_store.read_parts(spark, str(tmp_path / "many")).orderBy("part").collect()
    assert len(parts) > 3
    assert [p.base for p in parts] == np.cumsum([0] + [p.n_tokens for p in parts]).tolist()[:-1]
    ids = [r.doc_id for r in token_store.read_store(spark, str(tmp_path / "many")).orderBy("start").collect()]
    assert ids == sorted(ids)


def test_empty_table(spark, tmp_path, no_docs):
    path = str(tmp_path / "none")
    token_store.write_store(no_docs, path, tokenizer_path())
    assert token_store.read_store(spark, path).count() == 0


def test_damaged_part_fails(spark, tmp_path, sf_dir):
    path = tmp_path / "cut"
    token_store.write_store(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(5), str(path), tokenizer_path())
    part = sorted(path.glob("*.bin"))[0]
    part.write_bytes(part.read_bytes()[:-2])
    with pytest.raises(Exception, match="sizes differ"):
        token_store.read_store(spark, str(path)).agg(F.count("*")).collect()

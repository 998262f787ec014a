"""One registered query per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import (
    attention_lm,
    decontaminate,
    language,
    line_rules,
    merkle,
    mixing,
    piece_counts,
    product_codes,
    recursive_bpe,
    rule_quality,
    secret_ledger,
    simhash,
    token_store,
)
from rowloom.llm.common import documents
from rowloom.workdir import fresh_path


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-store")
    token_store.write_store(documents(spark, sf_dir), path, tokenizer_path())
    return token_store.read_store(spark, path)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(documents(spark, sf_dir), decontaminate.read_benchmark(spark, sf_dir))


def op3_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.token_counts(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op4_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return rule_quality.score(docs, rule_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit_text(documents(spark, sf_dir))
    return language.identify(language.read_pages(spark, sf_dir), model)


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = fresh_path(spark, "secret-ledger")
    docs = documents(spark, sf_dir)
    secret_ledger.scan_new(docs, ledger)
    found = secret_ledger.findings(docs, ledger)
    base = [rule.kind for rule in secret_ledger.BASE_RULES]

    def joined(items):
        return F.array_join(
            F.transform(items, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))),
            ",",
        )

    def of(*kinds):
        return F.filter("found", lambda x: x["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in base),
        F.sha2(joined(of(*base)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score_texts(documents(spark, sf_dir), tokenizer_path())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(documents(spark, sf_dir)).drop("copies")


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.apply_rules(documents(spark, sf_dir))


def op11_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes.with_errors(product_codes.quantise(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op12_recursive_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    return recursive_bpe.round_trips(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(documents(spark, sf_dir))


QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_decontaminate": op2_decontaminate,
    "op3_piece_counts": op3_piece_counts,
    "op4_rule_quality": op4_rule_quality,
    "op5_language": op5_language,
    "op6_secret_ledger": op6_secret_ledger,
    "op7_simhash": op7_simhash,
    "op8_attention_lm": op8_attention_lm,
    "op9_mixing": op9_mixing,
    "op10_line_rules": op10_line_rules,
    "op11_product_codes": op11_product_codes,
    "op12_recursive_bpe": op12_recursive_bpe,
    "op13_merkle_manifest": op13_merkle_manifest,
}

"""A shuffled store that grows, and collections over several stores."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from rowloom import schemas
from rowloom.operators import ordering
from rowloom.operators.growing import GrowingStore
from rowloom.sources import registry, scans


def files_of(root):
    return {path: os.path.getmtime(path) for path in glob.glob(f"{root}/run=*/**/*.parquet", recursive=True)}


def numbers(spark, low, high):
    return spark.range(low, high).select(F.col("id").alias("row_id"), (F.col("id") * 3).alias("payload"))


def in_order(df):
    return [tuple(r) for r in df.select("ord", "row_id", "payload").orderBy("ord").collect()]


def shuffled(spark, high):
    return in_order(ordering.global_order(numbers(spark, 0, high)))


def test_appends_and_compactions_keep_the_order_of_a_full_shuffle(spark, tmp_path):
    store = GrowingStore(spark, str(tmp_path / "store"), digits=1, rows_per_file=50)
    before = {}
    for version, (low, high) in enumerate([(0, 700), (700, 705), (705, 1_500)], 1):
        assert store.append(numbers(spark, low, high)) == version
        after = files_of(store.root)
        assert before.items() <= after.items()
        assert in_order(store.ordered()) == shuffled(spark, high)
        before = after
    assert store.runs().agg(F.sum("n_rows")).first()[0] == 1_500

    # The second append had five rows: only ranges it falls in have three runs.
    runs = store.runs().groupBy("range").count().collect()
    many = {r["range"] for r in runs if r["count"] > 2}
    few = {r["range"] for r in runs} - many
    assert 0 < len(many) <= 5 and few
    assert store.compact(max_runs=2) == 4
    assert before.items() <= files_of(store.root).items()
    lines = store.runs().collect()
    assert {r["range"] for r in lines if r.run == 4} == many
    assert sorted(r["range"] for r in lines if r.run != 4) == sorted([*few, *few])
    assert in_order(store.ordered()) == shuffled(spark, 1_500)
    assert store.compact(max_runs=2) == 4
    assert store.append(numbers(spark, 1_500, 1_600)) == 5
    assert in_order(store.ordered(digits=1)) == shuffled(spark, 1_600)
    assert sorted(r.row_id for r in store.rows().collect()) == list(range(1_600))


def test_files_of_an_append_that_died_are_not_read(spark, tmp_path):
    store = GrowingStore(spark, str(tmp_path / "store"), digits=1)
    with pytest.raises(LookupError):
        store.rows()
    store.append(numbers(spark, 0, 100))
    # The run is written, its version is not.
    keyed = numbers(spark, 100, 150).withColumn("_key", F.md5(F.col("row_id").cast("string"))).withColumn("range", F.lit("r0"))
    store._write_run(keyed, 2)
    again = GrowingStore(spark, store.root, digits=1)
    assert in_order(again.ordered()) == shuffled(spark, 100)
    assert again.append(numbers(spark, 100, 150)) == 2
    assert in_order(again.ordered()) == shuffled(spark, 150)


def test_another_seed_is_another_order(spark, tmp_path):
    store = GrowingStore(spark, str(tmp_path / "store"), seed=7, digits=1)
    store.append(numbers(spark, 0, 200))
    assert in_order(store.ordered()) == in_order(ordering.global_order(numbers(spark, 0, 200), seed=7))


# --- collections over several stores ------------------------------------------------


@pytest.mark.parametrize("ids", [True, False])
def test_shards_of_one_name_in_several_stores(spark, tmp_path, ids):
    schema = schemas.T.StructType([schemas.T.StructField("row_id", schemas.T.LongType()), schemas.T.StructField("v", schemas.T.LongType())])
    lines = []
    for k, (where, n) in enumerate([("a/x", 30), ("b/x", 20), ("b/y", 10), ("c", 5)]):
        path = str(tmp_path / where / "shard=0")
        rows = spark.range(n, numPartitions=3).select(F.col("id").alias("row_id"), (F.col("id") + 100 * k).alias("v"))
        (rows if ids else rows.drop("row_id")).write.parquet(path)
        lines.append(("all", "", k, f"shard_{k}", path, n))
    manifest = spark.createDataFrame(lines, schemas.MANIFEST)
    got = scans.concat_scan(spark, manifest, "all", schema).orderBy("row_id").collect()
    want = [(k, 100 * k + i) for k, n in enumerate((30, 20, 10, 5)) for i in range(n)]
    assert [(r.shard, r.v) for r in got] == want
    assert [r.row_id for r in got] == list(range(65))
    twice = manifest.unionByName(manifest.limit(1).withColumn("shard_ord", F.lit(9)))
    with pytest.raises(ValueError, match="listed twice"):
        scans.concat_scan(spark, twice, "all", schema)
    assert registry.collection_total(manifest, "all").first().n_samples == 65

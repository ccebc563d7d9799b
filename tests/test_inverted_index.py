"""Retrieval from the stored index: the candidates of a full pass, from a bounded share of the blocks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from clickloom.operators import inverted_index, search
from tests.conftest import rows

ADS = "id STRING, title STRING, category STRING"


def stored(spark, tmp_path, ads, range_ads):
    path = str(tmp_path / "index")
    inverted_index.write_index(ads, path, range_ads)
    return path


def some_ads(spark, n, seed=5):
    rng = random.Random(seed)
    words = ["camera", "lens", "alpha", "beta", "tripod", "été"]
    return spark.createDataFrame(
        [(f"ad{i:04}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 7))), rng.choice(["Cameras", "Lens"])) for i in range(n)], ADS
    )


@pytest.mark.parametrize("depth", [1, 7, 1000])
def test_equals_a_full_pass(spark, tmp_path, depth):
    ads = some_ads(spark, 400).cache()
    asked = ["camera", "Camera  lens", "lens camera lens", "été-alpha", "missing camera", "beta", "...", "", None, "alpha beta tripod lens"]
    queries = spark.createDataFrame([(q,) for q in [*asked, *asked]], "query STRING")
    path = stored(spark, tmp_path, ads, 40)
    found = inverted_index.retrieve(spark, queries, path, depth).candidates
    expected = rows(search.lexical_candidates(queries, ads, depth), "query", "ad_id", "relevance", "rank")
    assert rows(found, "query", "ad_id", "relevance", "rank") == expected
    assert expected


def test_a_block_is_one_token_frequency_and_range(spark, tmp_path):
    ads = some_ads(spark, 300).cache()
    index = spark.read.parquet(stored(spark, tmp_path, ads, 50))
    postings = index.select("token", "tf", F.explode("ads").alias("ad_id"))
    assert rows(postings, "token", "ad_id", "tf") == rows(search.token_postings(ads), "token", "ad_id", "tf")
    assert index.groupBy("token", "range", "tf").count().where("count > 1").isEmpty()
    assert index.where("n <> size(ads) OR ads <> array_sort(ads)").isEmpty()
    # Ranges rise with the ids.
    spans = index.select("range", F.explode("ads").alias("a")).groupBy("range").agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
    ordered = [(r["lo"], r["hi"]) for r in spans.orderBy("range").collect()]
    assert len(ordered) > 3 and all(a[1] < b[0] for a, b in zip(ordered, ordered[1:]))


def test_two_common_tokens_read_a_bounded_share(spark, tmp_path):
    """Both tokens are in every ad, twice in few: the best ads come from few blocks, however many ads there are."""
    reads = {}
    for n in (2000, 8000):
        ads = spark.range(n).select(
            F.format_string("ad%06d", "id").alias("id"),
            F.when(F.col("id") % 97 == 0, "red ring red ring").otherwise("red ring").alias("title"), F.lit("thing").alias("category"),
        )
        path = stored(spark, tmp_path / str(n), ads, 100)
        found = inverted_index.retrieve(spark, spark.createDataFrame([("red ring",), ("Ring, red!",)], "query STRING"), path, 200)
        best = [r["ad_id"] for r in found.candidates.where("query = 'red ring'").orderBy("rank").collect()]
        twice = [f"ad{i:06}" for i in range(0, n, 97)][:200]
        assert best == (twice + [f"ad{i:06}" for i in range(n) if i % 97])[:200]
        total = spark.read.parquet(path).where("token IN ('red', 'ring')").agg(F.sum("n")).first()[0]
        reads[n] = found.reads.agg(F.sum("postings")).first()[0], total
    # Every ad with both tokens twice may be read, and some ranges of the others; these do not grow with the table.
    assert all(read < 2 * n / 97 + 2 * 800 for n, (read, _) in reads.items()), reads
    assert reads[8000][0] / reads[8000][1] < 0.1


def test_tokens_that_rarely_meet_go_on(spark, tmp_path):
    """Two common tokens that share three ads at the end: steps go on until all units are read."""
    ads = spark.range(1000).select(
        F.format_string("ad%06d", "id").alias("id"),
        F.when(F.col("id") > 996, "red ring").when(F.col("id") % 2 == 0, "red").otherwise("ring").alias("title"), F.lit("thing").alias("category"),
    )
    path = stored(spark, tmp_path, ads, 20)
    found = inverted_index.retrieve(spark, spark.createDataFrame([("red ring",)], "query STRING"), path, 5)
    assert [r["ad_id"] for r in found.candidates.orderBy("rank").collect()] == ["ad000997", "ad000998", "ad000999"]
    assert found.reads.select("step").distinct().count() > 2


def test_only_buckets_of_tokens_asked_for_are_read(spark, tmp_path):
    path = stored(spark, tmp_path, some_ads(spark, 200), 50)
    buckets = spark.read.parquet(path).select("bucket").distinct().count()
    blocks = spark.read.schema(inverted_index.SCHEMA).parquet(path)
    asked = spark.createDataFrame([("camera",)], "token STRING").select(inverted_index._bucket("token")).first()[0]
    files = blocks.where(F.col("bucket") == asked).select("_metadata.file_path").distinct().count()
    assert buckets > 1 and 0 < files < len(blocks.inputFiles())


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], ADS)
    queries = spark.createDataFrame([("red",)], "query STRING")
    path = stored(spark, tmp_path, none, 10)
    found = inverted_index.retrieve(spark, queries, path)
    assert found.candidates.count() == 0 and found.reads.count() == 0
    assert found.candidates.columns == ["query", "ad_id", "relevance", "rank"]
    nobody = inverted_index.retrieve(spark, queries.where("false"), stored(spark, tmp_path / "b", some_ads(spark, 10), 10))
    assert nobody.candidates.count() == 0


def test_ads_without_id_or_token(spark, tmp_path):
    ads = spark.createDataFrame([(None, "red", "x"), ("a", None, None), ("b", "red", None)], ADS)
    path = stored(spark, tmp_path, ads, 10)
    found = inverted_index.retrieve(spark, spark.createDataFrame([("red",)], "query STRING"), path)
    assert [r["ad_id"] for r in found.candidates.collect()] == ["b"]

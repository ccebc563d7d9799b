"""A stored inverted index, and retrieval from it that stops once the best ads are found.

Ads are cut into ranges of neighbouring ids. A block holds the ads of one range in which a token occurs equally
often: ``token, range, tf, n, ads``. The best ads of a set of tokens are those of the greatest smallest frequency,
then of the lowest id. So a set's units of work, (smallest frequency falling, range rising), come in the order of
its results: a unit needs the blocks of the set's tokens in that range at that frequency or above, and as soon as
the units read so far have given ``depth`` ads, no other can enter.

What the units are follows from the blocks' heads alone, which a columnar file yields without the ids.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.functions import text
from clickloom.operators.search import relevance, token_postings
from clickloom.operators.windows import top_per_group
from clickloom.schemas import RETRIEVAL_DEPTH
from clickloom.session import scratch_table

#: Ads of a range that are aimed at, folders that tokens are dealt to, and ranges that share a file.
RANGE_ADS, BUCKETS, FILE_RANGES = 10_000, 64, 64
#: Each step may read this many times the ads of the one before.
GROWTH = 4
SCHEMA = "token string, range int, tf int, n long, ads array<string>, bucket int"


def _bucket(token: str) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def write_index(ads: DataFrame, path: str, range_ads: int = RANGE_ADS) -> None:
    """Writes the blocks of ``ads`` (id, title, category; ids are unique) below ``path``, a folder for each bucket.

    The ads are shuffled once by range of ids. A block never holds more than its range, so a token that every ad
    has is spread like the ads themselves. Ads without an id or without a token are not in the index.
    """
    named = ads.where("id IS NOT NULL").select("id", "title", "category")
    ranges = max(1, -(-named.count() // range_ads))
    postings = token_postings(named.repartitionByRange(ranges, "id").withColumn("range", F.spark_partition_id()), "range")
    blocks = (
        postings.groupBy("token", "range", "tf")
        .agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("ad_id")).alias("ads"))
        .withColumn("bucket", _bucket("token"))
    )
    dealt = blocks.repartition("bucket", F.floor(F.col("range") / FILE_RANGES)).sortWithinPartitions("bucket", "token", "range")
    dealt.write.mode("errorifexists").partitionBy("bucket").parquet(path)


class Retrieval(NamedTuple):
    """``candidates``: query, ad_id, relevance, rank. ``reads``: terms, step and how many blocks and postings it read."""

    candidates: DataFrame
    reads: DataFrame


def _units(sets: DataFrame, heads: DataFrame, depth: int) -> DataFrame:
    """``_terms, range, tf, step``: the units that can hold a result.

    A unit's ads are at most the postings of its scarcest token; the units before it are read first. The
    step is the first whose allowance, ``depth * GROWTH ** step``, exceeds what these may hold.
    """
    terms = sets.select("_terms", F.explode("_terms").alias("token"))
    here = (
        terms.join(heads, "token").groupBy("_terms", "range")
        .agg(F.collect_list(F.struct("token", "tf", "n")).alias("_heads"))
    )

    def most(tf: Column) -> Column:
        def held(token: Column) -> Column:
            enough = F.filter("_heads", lambda h: (h["token"] == token) & (h["tf"] >= tf))
            return F.aggregate(enough, F.lit(0).cast("long"), lambda total, h: total + h["n"])

        return F.array_min(F.transform("_terms", held))

    levels = F.array_distinct(F.transform("_heads", lambda h: h["tf"]))
    found = here.select(
        "_terms", "range", F.explode(F.transform(levels, lambda tf: F.struct(tf.alias("tf"), most(tf).alias("most")))).alias("_u")
    ).select("_terms", "range", "_u.tf", "_u.most").where("most > 0")
    # One set's units are as many as the ranges and frequencies of its tokens: heads, never ads.
    earlier = Window.partitionBy("_terms").orderBy(F.desc("tf"), "range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("most").over(earlier), F.lit(0))
    step = F.when(ahead < depth, 0).otherwise(F.floor(F.log(float(GROWTH), ahead / F.lit(depth))) + 1).cast("int")
    return found.select("_terms", "range", "tf", step.alias("step"))


def _read(units: DataFrame, blocks: DataFrame) -> DataFrame:
    """``_terms, tf, ad_id`` of the ads that hold all tokens, the scarcest of them exactly ``tf`` times."""
    asked = units.select("_terms", "range", F.col("tf").alias("_tf"), F.explode("_terms").alias("token"))
    met = asked.join(blocks, ["token", "range"]).where("tf >= _tf")
    # A token has an ad in one block only, so an ad's rows are its tokens.
    return (
        met.select("_terms", "_tf", "tf", F.explode("ads").alias("ad_id"))
        .groupBy("_terms", "_tf", "ad_id").agg(F.count(F.lit(1)).alias("_n"), F.min("tf").alias("_least"))
        .where((F.col("_n") == F.size("_terms")) & (F.col("_least") == F.col("_tf")))
        .select("_terms", F.col("_tf").alias("tf"), "ad_id")
    )


def retrieve(spark: SparkSession, queries: DataFrame, path: str, depth: int = RETRIEVAL_DEPTH) -> Retrieval:
    """The best ``depth`` ads for each query, equal to ``search.lexical_candidates`` over the indexed ads.

    Queries that ask for the same tokens are one retrieval, and only folders of tokens asked for are read.
    Steps allow ``GROWTH`` times more each, so their number is a logarithm of the ads, and a set takes part until
    it has ``depth`` ads or no units. Null queries and queries without a token have no candidates.
    """
    asked = (
        queries.select("query").distinct()
        .withColumn("_terms", F.array_sort(F.array_distinct(text.tokens(F.col("query")))))
        .where(F.size("_terms") > 0)
    )
    sets = scratch_table(asked.select("_terms").distinct(), "token-sets")
    touched = sets.select(F.explode("_terms").alias("token")).select(_bucket("token").alias("b")).distinct()
    # At most one number for each bucket.
    blocks = spark.read.schema(SCHEMA).parquet(path).where(F.col("bucket").isin([row["b"] for row in touched.collect()]))
    heads = blocks.select("token", "range", "tf", "n")
    units = scratch_table(_units(sets, heads, depth), "units")

    results, reads = [], []
    steps = sorted(row["step"] for row in units.select("step").distinct().collect())
    due = units
    for at, step in enumerate(steps):
        now = scratch_table(due.where(F.col("step") == step), "due-units")
        best = top_per_group(_read(now, blocks), ["_terms"], [F.desc("tf"), F.asc("ad_id")], depth)
        results.append(scratch_table(best.select("_terms", "tf", "ad_id"), "retrieved"))
        asked_heads = now.select("_terms", "range", F.col("tf").alias("_tf"), F.explode("_terms").alias("token")).join(heads, ["token", "range"])
        # A block that several units of a step need is read once.
        distinct = asked_heads.where("tf >= _tf").select("_terms", "token", "range", "tf", "n").distinct()
        reads.append(
            distinct.groupBy("_terms").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("postings")).select(
                F.col("_terms").alias("terms"), F.lit(step).alias("step"), "blocks", "postings"
            )
        )
        if at + 1 == len(steps):
            break
        full = _union(results).groupBy("_terms").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= depth)
        due = units.where(F.col("step") > step).join(full, "_terms", "left_anti")
        if due.isEmpty():
            break

    if not results:
        nothing = units.where("false")
        return Retrieval(
            nothing.selectExpr("string(null) AS query", "string(null) AS ad_id", "double(0) AS relevance", "0 AS rank"),
            nothing.selectExpr("_terms AS terms", "step", "0L AS blocks", "0L AS postings"),
        )
    best = top_per_group(_union(results), ["_terms"], [F.desc("tf"), F.asc("ad_id")], depth)
    candidates = asked.join(best, "_terms").select("query", "ad_id", relevance(F.col("tf")).alias("relevance"), "rank")
    return Retrieval(candidates, _union(reads))


def _union(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.union(table)
    return whole

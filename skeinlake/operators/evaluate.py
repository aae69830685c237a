"""Retrieval quality: precision, reciprocal rank and NDCG of ranked results against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIFFICULTIES = ("easy", "medium", "hard")
METRICS = ("precision_at_1", "precision_at_3", "precision_at_5", "mrr", "ndcg_at_10")


def _dcg(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))


def per_query(queries: DataFrame, results: DataFrame) -> DataFrame:
    """queries: query_id, difficulty, relevant_chunks; results: query_id, rank, chunk_id ->
    query_id, difficulty, precision_at_1/3/5, reciprocal_rank, ndcg_at_10, zero_result.

    Labels are joined to results by (query, chunk): a semi-join-like lookup, not a scan of arrays."""
    labels = queries.select("query_id", F.explode("relevant_chunks").alias("chunk_id")).distinct().withColumn("hit", F.lit(True))
    judged = results.join(labels, ["query_id", "chunk_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return judge(queries.select("query_id", "difficulty", F.size(F.array_distinct("relevant_chunks")).alias("n_relevant")), judged)


def judge(queries: DataFrame, results: DataFrame) -> DataFrame:
    """The same from queries: query_id, difficulty, n_relevant; results: query_id, rank, hit. For labels
    that follow from a rule and need not be listed."""
    hit = lambda k: F.sum(F.when((F.col("rank") <= k) & F.col("hit"), 1).otherwise(0)) / k
    found = results.groupBy("query_id").agg(
        *[hit(k).alias(f"p{k}") for k in (1, 3, 5)], F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("hit") & (F.col("rank") <= 10), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    all_ = queries.withColumn("ideal", F.least(F.col("n_relevant").cast("int"), F.lit(10))).join(found, "query_id", "left")
    return all_.select(
        "query_id", "difficulty", *[F.coalesce(f"p{k}", F.lit(0.0)).alias(f"precision_at_{k}") for k in (1, 3, 5)],
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(F.col("ideal") > 0, F.coalesce(F.col("dcg"), F.lit(0.0)) / _dcg(F.greatest("ideal", F.lit(1)))).otherwise(0.0).alias("ndcg_at_10"),
        F.col("p1").isNull().alias("zero_result"),
    )


def _averages() -> list[Column]:
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return [
        *[mean(F.col(f"precision_at_{k}")).alias(f"precision_at_{k}") for k in (1, 3, 5)],
        mean(F.when(~F.col("zero_result"), F.col("reciprocal_rank"))).alias("mrr"),
        mean(F.col("ndcg_at_10")).alias("ndcg_at_10"), F.count_if("zero_result").alias("zero_results"), F.count("*").alias("n_queries"),
    ]


def summary(judged: DataFrame) -> DataFrame:
    """One row of averages; the mean reciprocal rank leaves out queries without results."""
    return judged.agg(*_averages())


def by_difficulty(judged: DataFrame) -> DataFrame:
    """The averages for each of easy, medium and hard; 0 where there is no query."""
    spark = judged.sparkSession
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, DIFFICULTIES))).alias("difficulty"))
    found = names.join(judged.groupBy("difficulty").agg(*_averages()), "difficulty", "left")
    return found.select("difficulty", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in METRICS], *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("zero_results", "n_queries")])


def baseline_diff(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """metric, diff: each of the five metrics of one summary less the other's; empty without one."""
    long = lambda d, n: d.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(n)) for m in METRICS])).alias("x")).select("x.*")
    return long(current, "now").join(long(baseline, "before"), "metric").select("metric", (F.col("now") - F.col("before")).alias("diff"))


def missing_labels(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, missing: how many labels are no live chunk; queries with none left out."""
    labels = queries.select("query_id", F.explode("relevant_chunks").alias("id")).distinct()
    return labels.join(chunks.where("not is_deleted"), "id", "left_anti").groupBy("query_id").agg(F.count("*").alias("missing"))


def baseline_eligible(total: Column, missing: Column, zero: Column) -> Column:
    return (total > 0) & (missing == 0) & (F.coalesce(F.try_divide(zero, total), F.lit(0.0)) < 0.2)


def best_per_file(chunks: DataFrame) -> DataFrame:
    """One chunk for each file: functions before methods before modules, then by line and id."""
    from pyspark.sql import Window

    kind = F.when(F.col("chunk_type") == "function", 0).when(F.col("chunk_type") == "method", 1).when(F.col("chunk_type") == "module", 2).otherwise(3)
    at = F.row_number().over(Window.partitionBy("file_path").orderBy(kind, "start_line", "id"))
    return chunks.withColumn("_n", at).where("_n = 1").drop("_n")

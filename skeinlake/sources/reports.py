"""Evaluation query sets in, reports and notes out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sessions import decision_note

QUERY_SET = "id string, query string, type string, difficulty string, relevant_chunks array<string>"
# Kinds of query.
QUERY_TYPES = ("definitional", "semantic", "implementation")


def read_query_set(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines query set; a row that breaks the rules is an error when it is read."""
    rows = spark.read.schema(QUERY_SET).json(path)
    good = (
        (F.length("id") > 0) & (F.length("query") > 0) & F.col("type").isin(*QUERY_TYPES) & F.col("difficulty").isin("easy", "medium", "hard")
        & (F.size("relevant_chunks") > 0) & ~F.exists("relevant_chunks", lambda x: x.isNull() | (F.length(x) == 0))
    )
    return rows.where(F.assert_true(F.coalesce(good, F.lit(False)), F.concat(F.lit("bad query: "), F.coalesce("id", F.lit("?")))).isNull())


def parse_query_set(spark: SparkSession, text: str) -> DataFrame:
    """A query set written as a YAML list of flat mappings."""
    rows: list[dict] = []
    key = None
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        body = line.strip()
        clean = lambda s: s.strip().strip("\"'")
        if body.startswith("- ") and ":" in body and not line.startswith("    "):
            rows.append({})
            body = body[2:]
        if body.startswith("- "):
            rows[-1].setdefault(key, []).append(clean(body[2:]))
            continue
        key, _, value = body.partition(":")
        key = key.strip()
        if value.strip():
            rows[-1][key] = [clean(x) for x in value.strip()[1:-1].split(",")] if value.strip().startswith("[") else clean(value)
    return spark.createDataFrame([(r.get("id"), r.get("query"), r.get("type"), r.get("difficulty"), r.get("relevant_chunks")) for r in rows], QUERY_SET)


def write_run(judged: DataFrame, summary: DataFrame, difficulty: DataFrame, config: DataFrame, path: str) -> None:
    """config, summary, queries as JSON and the summary as Markdown below path."""
    config.coalesce(1).write.mode("overwrite").json(f"{path}/config")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    judged.write.mode("overwrite").json(f"{path}/queries")
    render_run(summary, difficulty).coalesce(1).write.mode("overwrite").text(f"{path}/summary_md")


def newest_run(spark: SparkSession, path: str) -> str | None:
    """The folder below path that was written last (of equal times the last by name); None if there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(s.getModificationTime(), s.getPath().toString()) for s in (fs.listStatus(where) if fs.exists(where) else []) if s.isDirectory()]
    return max(found)[1] if found else None


def render_run(summary: DataFrame, difficulty: DataFrame) -> DataFrame:
    """value: the averages as one Markdown text."""
    line = lambda name, c: F.format_string(f"- {name}: %.4f", F.col(c))
    head = F.concat_ws(
        "\n", F.lit("# Benchmark Summary"), F.lit(""), *[line(f"Precision@{k}", f"precision_at_{k}") for k in (1, 3, 5)], line("MRR", "mrr"), line("NDCG@10", "ndcg_at_10"),
        F.format_string("- Zero-result queries: %d", F.col("zero_results")),
    )
    part = F.concat_ws("\n", F.concat(F.lit("### "), "difficulty"), line("Precision@5", "precision_at_5"), line("MRR", "mrr"), line("NDCG@10", "ndcg_at_10"))
    rank = F.when(F.col("difficulty") == "easy", 0).when(F.col("difficulty") == "medium", 1).otherwise(2)
    parts = difficulty.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(rank.alias("r"), part.alias("p")))), lambda x: x["p"]), "\n\n").alias("parts"))
    return summary.select(head.alias("head")).crossJoin(parts).select(F.concat_ws("\n\n", "head", F.lit("## By Difficulty"), "parts").alias("value"))


def write_notes(ledger: DataFrame, path: str) -> None:
    """A Markdown note for each decision, one folder each, named by id and title; characters that
    could leave the folder never get into a name."""
    decision_note(ledger).select(F.col("note").alias("value"), "file_name").write.mode("overwrite").partitionBy("file_name").text(path)


def queue_retry(decisions: DataFrame, path: str) -> None:
    """Append decisions whose note could not be written, with attempts 0."""
    decisions.withColumn("attempts", F.lit(0)).write.mode("append").json(path)

"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only.

Every document draws the exponential key -ln(u) / quality, u from a seeded hash of the row. Within
a source the documents stand in the order of their keys; complete epochs take every document, and
what is left of the target goes to a prefix of that order.

No source meets in one task, nor do all sources, which may be hosts: the documents are sorted by
source and key in ranges, whose bounds Spark samples, so that a large source is many ranges whatever
its keys are like. The ranges are summed first, and the prefix sums run within a range on top of what
the ranges before it hold; what the sources before hold is taken off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, store

#: Weights of the sources in code-point order, repeating; share of all words; most epochs.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2


def _in_order(rows: DataFrame, by: list[Column | str], **sums: str) -> DataFrame:
    """rows with, by these names, the running sum of a column over all rows in this order, the row's
    own included. The sort deals ranges; a range's own sums start from those of the ranges before."""
    placed = store(rows.orderBy(*by).withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumn("range", F.shiftrightunsigned("place", 33))
    held = placed.groupBy("range").agg(*[F.sum(c).alias(f"b_{name}") for name, c in sums.items()])
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    held = held.select(F.col("range").alias("r_"), *[F.coalesce(F.sum(f"b_{n}").over(earlier), F.lit(0)).alias(f"b_{n}") for n in sums])
    inside = Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.join(F.broadcast(held), F.col("range") == F.col("r_"))
    return out.withColumns({n: F.col(f"b_{n}") + F.sum(c).over(inside) for n, c in sums.items()}).select(*rows.columns, *sums)


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """source, source_size, n -> those and target. One row a source; an empty table gives an empty one.

    Sources by code point, null last, weigh `weights` in turn and share `share` times all words.
    A target stops at `epochs` times its source's size and the excess is shared among the rest by
    weight until none is above: the sources by size to weight stop in this order, so one prefix
    sum finds where the sharing ends (of equal ratios all stop or none). Sources of size 0 get 0.
    """
    ranked = _in_order(sources.withColumn("one", F.lit(1)), [F.col("source").isNull(), "source"], rank="one")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    by = ranked.withColumn("w", w).withColumn("r", epochs * F.col("source_size") / F.col("w"))
    by = store(_in_order(by, ["r"], so_far="source_size", w_so_far="w"))
    total = by.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))
    by = by.crossJoin(F.broadcast(total)).withColumn("total", share * F.col("all_size"))
    stops = epochs * F.col("so_far") + F.col("r") * (F.col("all_w") - F.col("w_so_far")) <= F.col("total")
    by = by.withColumn("stops", stops)
    rest = by.agg(F.coalesce(F.sum(F.when(F.col("stops"), epochs * F.col("source_size"))), F.lit(0.0)).alias("held"), F.sum(F.when(~F.col("stops"), F.col("w"))).alias("sharing"))
    by = by.crossJoin(F.broadcast(rest))
    full = (epochs * F.col("source_size")).cast("double")
    part = (F.col("total") - F.col("held")) * F.col("w") / F.col("sharing")
    return by.select("source", "source_size", "n", F.when(F.col("stops"), full).otherwise(F.least(full, part)).alias("target"))


def exponential_key(doc_id: Column, text: Column, quality: Column, seed: int) -> Column:
    """-ln(u) / quality for u in (0, 1], from a hash of the row; a quality that is null, not a
    number or not above 0 counts as 1."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, text, F.lit(seed)), 11) + 1) / F.lit(float(1 << 53))
    return -F.ln(u) / F.when((quality > 0) & ~F.isnan(quality), quality).otherwise(1.0)


def mix_sources(
    docs: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS,
    seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, part, taken and the columns in `carry` for
    every row of docs.

    size: words of the whole text (null: 0). copies: how often the mix takes the document whole;
    part: words of the one document a source that the end of its budget cuts, beside its copies;
    taken: size * copies + part. A source's taken words are its target less a fraction of a word.
    quality: doc_id, quality; documents without a row weigh 1, with several their mean.
    Null sources are one source, the last. A repeated row is a document of its own. Ties of keys
    are settled by doc_id and size. Extra columns are ignored; an empty table gives an empty one.
    """
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    # the hash goes by the text, of which nothing but its hash is kept
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), words.alias("size"), F.xxhash64(F.col(text)).alias("h"),
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)],
    )
    names = [f"c{i}" for i in range(len(carry))]
    if quality is None:
        rows = rows.withColumn("quality", F.lit(1.0))
    else:
        per = quality.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("quality").cast("double")).alias("quality"))
        rows = rows.join(per, "doc_id", "left")
    rows = store(rows.select("doc_id", "source", "size", exponential_key(F.col("doc_id"), F.col("h"), F.col("quality"), seed).alias("key"), *names))

    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    by_name = [F.col("source").isNull(), F.col("source")]
    plan = store(_in_order(plan, by_name, upto="source_size"))

    dealt = rows.join(plan.withColumnRenamed("source", "s"), rows["source"].eqNullSafe(F.col("s"))).drop("s")
    dealt = _in_order(dealt, [*by_name, "key", "doc_id", "size"], run="size")
    before = F.col("run") - F.col("size") - (F.col("upto") - F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("rest")).cast("long") - before))
    full = F.col("part") >= F.col("size")
    out = dealt.withColumn("part", F.when(F.col("rest") > 0, part).otherwise(0).cast("long"))
    out = out.withColumn("copies", (F.col("whole") + F.when(full & (F.col("size") > 0), 1).otherwise(0)).cast("long")).withColumn("part", F.when(full, 0).otherwise(F.col("part")).cast("long"))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", "part", (F.col("size") * F.col("copies") + F.col("part")).alias("taken"), *[F.col(n).alias(c) for n, c in zip(names, carry)])

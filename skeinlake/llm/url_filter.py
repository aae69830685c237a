"""URL filters: explicit rules first, then a tree of path templates a host; DataFrame functions only.

A segment of a path is kept as it is where many urls of its host have it at that depth, else with its
digits masked where many have that, else it is a wildcard; wildcards in a row are one. The templates
of a host form a tree. A branch whose labelled share of bad urls is close to that of its siblings
together (within the Hoeffding bounds of both), and which has no branch below that stands apart, is
merged into the wildcard branch. What is left is judged by its share of good labelled urls, smoothed
towards the host's and that towards the share of all.

Whatever is aggregated is summed on the map side; joins bring a row a key to the side that may have a
third of all rows under one key, so that Spark can split it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import scratch
from .common import store

#: (action, host and path), as a filter list has them.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Least urls and share of its host and depth that keep a segment; error of the merge test; urls that
#: the smoothing counts for; least purity.
SUPPORT, SHARE, ALPHA, WEIGHT, PURITY = 5, 0.05, 0.05, 10.0, 0.7

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first :// up to the path, in lower case, and the path; empty without."""
    part = lambda i: F.coalesce(F.regexp_extract(url, _URL, i), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits the host or one above it and whose path
    begins the url's; null if none. Of equally long ones the first by code point."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("verdict"))).otherwise(found)
    return found


def path_templates(urls: DataFrame, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """key, template from key, host, path: segments as `=literal`, `~masked` or `*`, joined by /.

    Masked: each run of digits is one #. `**` stands for several wildcards in a row. A path without
    segments has the empty template."""
    parts = urls.select("key", "host", F.posexplode(F.slice(F.split("path", "/"), 2, 1 << 30)).alias("depth", "seg"))
    parts = parts.withColumn("mask", F.regexp_replace("seg", "[0-9]+", "#"))
    reach = parts.groupBy("host", "depth").agg(F.count("*").alias("reach"))

    def frequent(form: str) -> DataFrame:
        n = parts.groupBy("host", "depth", form).agg(F.count("*").alias("n")).where(F.col("n") >= support)
        return n.join(reach, ["host", "depth"]).where(F.col("n") >= share * F.col("reach")).select("host", "depth", form, F.lit(True).alias(f"{form}_kept"))

    parts = parts.join(frequent("seg"), ["host", "depth", "seg"], "left").join(frequent("mask"), ["host", "depth", "mask"], "left")
    kept = F.when(F.col("seg_kept"), F.concat(F.lit("="), F.col("seg"))).when(F.col("mask_kept"), F.concat(F.lit("~"), F.col("mask"))).otherwise("*")
    whole = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("depth", kept.alias("t")))).alias("ts"))
    return whole.select("key", F.regexp_replace(F.array_join("ts.t", "/"), r"(^|/)\*(/\*)+(?=/|$)", "$1**").alias("template"))


def merged_templates(stats: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """host, template, merged from host, template, labelled, bad: the template after the merge of
    branches that are alike. One row a template; its nodes are its prefixes."""
    slack = math.sqrt(math.log(2 / alpha) / 2)
    at = stats.select("host", "template", "labelled", "bad", F.posexplode(F.split("template", "/")).alias("depth", "seg"))
    at = at.withColumn("node", F.array_join(F.slice(F.split("template", "/"), F.lit(1), F.col("depth") + 1), "/"))
    at = store(at.withColumn("parent", F.array_join(F.slice(F.split("template", "/"), F.lit(1), F.col("depth")), "/")))
    nodes = at.groupBy("host", "depth", "parent", "node").agg(F.sum("labelled").alias("m"), F.sum("bad").alias("b"))
    around = Window.partitionBy("host", "depth", "parent")
    nodes = nodes.withColumns({"ms": F.sum("m").over(around), "bs": F.sum("b").over(around)})
    gap = F.abs(F.col("b") / F.col("m") - F.col("bs") / F.col("ms"))
    apart = (F.col("m") > 0) & (gap > F.lit(slack) * (1 / F.sqrt("m") + 1 / F.sqrt("ms")))
    far = nodes.select("host", "node", F.coalesce(apart, F.lit(False)).alias("apart")).where("apart")
    # the nodes above one that stands apart keep their names too
    up = far.select("host", F.posexplode(F.split("node", "/")).alias("depth", "seg"), F.split("node", "/").alias("segs"))
    keep = up.select("host", F.array_join(F.slice("segs", F.lit(1), F.col("depth") + 1), "/").alias("node")).distinct().withColumn("keep", F.lit(True))
    named = at.join(keep, ["host", "node"], "left").withColumn("t", F.when(F.col("keep"), F.col("seg")).otherwise("*"))
    out = named.groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("depth", "t"))).alias("ts"))
    return out.select("host", "template", F.array_join("ts.t", "/").alias("merged"))


def judge_urls(
    pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, bad: str | None = None, support: int = SUPPORT, share: float = SHARE,
    alpha: float = ALPHA, weight: float = WEIGHT, purity: float = PURITY,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template, labelled, n_bad, purity for every row of pages.

    bad: a boolean column, null where a page has no label; without it all rates are one half. labelled
    and n_bad count the labelled urls of the page's merged template; purity is the smoothed share of
    good ones, below `purity` the template is rejected. A null url, or one without ://, has an empty
    host and path and the empty template. Repeated rows and null ids are rows of their own; a url of
    any length is one row, its segments beyond the frequent ones one wildcard. Extra columns are
    ignored; an empty table gives an empty one."""
    host, path = host_and_path(F.col("url"))
    label = F.col(f"`{bad}`") if bad else F.lit(None)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), label.cast("boolean").alias("bad"))
    with scratch(pages.sparkSession) as kept:
        rows = store(rows.withColumn("key", F.monotonically_increasing_id()))
        named = store(rows.join(path_templates(rows, support, share), "key", "left").withColumn("template", F.coalesce("template", F.lit(""))))

        counts = [F.count("bad").alias("labelled"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad")]
        stats = store(named.groupBy("host", "template").agg(*counts))
        merged = store(stats.join(merged_templates(stats, alpha), ["host", "template"]))
        sums = [F.sum("labelled").alias("m"), F.sum("bad").alias("b")]
        per = merged.groupBy("host", "merged").agg(*sums)
        hosts = stats.groupBy("host").agg(F.sum("labelled").alias("hm"), F.sum("bad").alias("hb"))
        total = stats.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("am"), F.coalesce(F.sum("bad"), F.lit(0)).alias("ab"))
        per = per.join(hosts, "host").crossJoin(F.broadcast(total))  # one row
        overall = (F.col("ab") + 1) / (F.col("am") + 2)
        of_host = (F.col("hb") + weight * overall) / (F.col("hm") + weight)
        per = per.select("host", "merged", "m", "b", (1 - (F.col("b") + weight * of_host) / (F.col("m") + weight)).alias("purity"))
        known = merged.select("host", "template", "merged").join(per, ["host", "merged"])
        known = known.select("host", "template", "merged", F.col("m").alias("labelled"), F.col("b").alias("n_bad"), "purity")

        out = named.join(known, ["host", "template"]).withColumn("found", fitting_rule(F.col("host"), F.col("path"), rules))
        learned = F.when(F.col("purity") < purity, "block").otherwise("allow")
        verdict = F.coalesce("found.verdict", learned).alias("verdict")
        out = store(out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict, F.col("merged").alias("template"), "labelled", "n_bad", "purity"))
        kept.append(out)
    return out

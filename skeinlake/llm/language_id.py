"""Language identification by Bayesian evidence fusion.

The log posterior of a language is the sum of

* the text's likelihood under byte-pair frequencies of that language (tempered, as neighbouring
  pairs are not independent),
* the likelihood of the declared markup language and of the address suffix, from how often each
  goes with each language that the text alone points to,
* the prior of the host, smoothed towards its parent domain and that towards all rows.

Every table of counts is a grouped aggregation over all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import scratch
from .common import pieces, store, text_buffers

TEMPER, STRENGTH = 0.25, 20.0
_PAIRS = 1 << 16


def _pair_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte pairs of all documents (A-Z lower-cased, _PAIRS where the pair would cross a
    document's end) and the letters (A-Z and non-ASCII bytes) before each place."""
    low = data.copy()
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    codes = np.full(len(low), _PAIRS, np.int32)
    np.add(low[:-1].astype(np.int32) << 8, low[1:], out=codes[:-1])
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    codes[ends] = _PAIRS
    letters = np.zeros(len(low) + 1, np.int64)
    np.cumsum(((low >= 97) & (low <= 122)) | (low >= 128), out=letters[1:])
    return codes, letters


def _pair_counts(rows: DataFrame) -> DataFrame:
    """lang, pair, n over all rows with a declared language."""

    def count(batches):
        for batch in batches:
            declared = batch.column(0).dictionary_encode()
            code = declared.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            data, offsets = text_buffers(batch.column(1).take(pa.array(order)))
            bounds = np.searchsorted(code[order], np.arange(len(declared.dictionary) + 1))
            # one language at a time, however many a batch has
            for i, name in enumerate(declared.dictionary.to_pylist()):
                lo, hi = int(bounds[i]), int(bounds[i + 1])
                sums = np.zeros(_PAIRS + 1, np.int64)
                for a, b in pieces(offsets[lo : hi + 1], 1 << 20):
                    at = offsets[lo + a : lo + b + 1]
                    if at[-1] > at[0]:
                        sums += np.bincount(_pair_codes(data[at[0] : at[-1]], at - at[0])[0], minlength=_PAIRS + 1)
                at = np.flatnonzero(sums[:_PAIRS])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at])], ["lang", "pair", "n"])

    return rows.select("declared", "text").mapInArrow(count, "lang string, pair int, n long").groupBy("lang", "pair").agg(F.sum("n").alias("n"))


def language_model(rows: DataFrame) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray, float]]]:
    """Every declared language and its log P(pair | language): the pairs that it has, theirs, and
    that of any other pair (Witten-Bell: unseen pairs share what the seen kinds weigh, so that a
    language of one page is as well described as a large one)."""
    declared = rows.where("declared is not null")
    names = sorted(r["declared"] for r in declared.select("declared").distinct().collect())
    found = _pair_counts(declared).toPandas() if names else None
    parts = {} if found is None else {x: (g["pair"].to_numpy(), g["n"].to_numpy()) for x, g in found.groupby("lang")}
    model = []
    for name in names:
        pairs, n = parts.get(name, (np.zeros(0, np.int32), np.zeros(0, np.int64)))
        each = max(1, len(pairs)) / _PAIRS
        total = n.sum() + each * _PAIRS
        model.append((pairs, np.log((n + each) / total).astype(np.float32), float(np.log(each / total))))
    return names, model


def _likelihoods(rows: DataFrame, model: list[tuple[np.ndarray, np.ndarray, float]], temper: float) -> DataFrame:
    """The rows' other columns, ll (tempered log likelihood by language, the best is 0), letters
    (share of the bytes that are not white space)."""
    other = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in other) + ", ll array<double>, letters double"
    k = len(model)
    most = max(1, (1 << 22) // k)  # rows whose ll are held at a time

    def score(batches):
        row = np.empty(_PAIRS + 1, np.float32)
        for batch in batches:
            data, offsets = text_buffers(batch.column(len(other)))
            for a, b in ((lo, min(lo + most, to)) for at, to in pieces(offsets, 1 << 20) for lo in range(at, to, most)):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                ll, letters = np.zeros((b - a, k)), np.zeros(b - a)
                if len(part):
                    pairs, before = _pair_codes(part, at)
                    solid = np.zeros(len(part) + 1, np.int64)
                    np.cumsum((part > 32), out=solid[1:])
                    full = np.flatnonzero(np.diff(at) > 0)
                    for i, (has, logs, rest) in enumerate(model):
                        row[:_PAIRS], row[_PAIRS] = rest, 0
                        row[has] = logs
                        ll[full, i] = np.add.reduceat(row[pairs], at[:-1][full], dtype=np.float64)
                    letters[:] = (before[at[1:]] - before[at[:-1]]) / np.maximum(1, solid[at[1:]] - solid[at[:-1]])
                    ll *= temper
                    ll -= ll.max(1, keepdims=True)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * k), pa.array(ll.ravel()))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(other)]), flat, pa.array(letters)], [*other, "ll", "letters"])

    return rows.select(*other, "text").mapInArrow(score, schema)


def _smoothed(counts: DataFrame, base: Column | str, strength: float) -> DataFrame:
    """p: counts (array c) of each row, smoothed towards the array `base` of the same row."""
    total = F.aggregate("c", F.lit(0.0), lambda a, x: a + x)
    base = F.col(base) if isinstance(base, str) else base
    return counts.withColumn("p", F.zip_with("c", base, lambda x, y: (x + F.lit(strength) * y) / (total + F.lit(strength))))


def identify_language(
    rows: DataFrame, temper: float = TEMPER, strength: float = STRENGTH, least_letters: float = 0.35, least_posterior: float = 0.5,
    evidence: DataFrame | None = None, by: str = "id",
) -> DataFrame:
    """id, lang, posterior, text_lang, accepted for every row of id, text, declared, host, suffix.

    Any column but `id` may be null or missing: that evidence is then left out (a null host is a
    host of its own). Every language that a row declares is one to identify, however rare; time and
    memory a row grow with their number. evidence (key, declared, host, suffix; one row each at most)
    takes the place of what the rows with that key in the column `by` say themselves, where it is
    not null; the byte-pair models are counted by the rows' own declarations. It meets the rows
    when their texts are gone. accepted: the text has letters in at least `least_letters` of its bytes that
    are not white space, and the posterior is at least `least_posterior`; so null, empty and blank
    texts are rejected, with the language that the other evidence points to. Equal posteriors go
    to the alphabetically first language. With no declared language in the table there is nothing
    to identify: lang is null and nothing is accepted. Whole texts are read. Extra columns are
    ignored, repeated rows kept; an empty table gives an empty one.
    """
    with scratch(rows.sparkSession) as kept:
        out = store(_identified(rows, temper, strength, least_letters, least_posterior, evidence, by))
        kept.append(out)
    return out


def _identified(rows: DataFrame, temper: float, strength: float, least_letters: float, least_posterior: float, evidence: DataFrame | None, by: str) -> DataFrame:
    have = set(rows.columns)
    pick = lambda c: F.col(f"`{c}`").cast("string") if c in have else F.lit(None).cast("string")
    subtag = lambda c: F.regexp_extract(F.when(F.trim(c) != "", F.lower(F.trim(c))), r"^[^-_]*", 0)
    rows = rows.select(F.col("id"), F.col(by).alias("by"), subtag(pick("declared")).alias("declared"), F.lower(pick("host")).alias("host"), F.lower(pick("suffix")).alias("suffix"), pick("text").alias("text"))
    names, model = language_model(rows)
    if not names:
        return rows.select("id", *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("posterior", "double"), ("text_lang", "string"))], F.lit(False).alias("accepted"))
    n = len(names)
    scored = _likelihoods(rows, model, temper)
    if evidence is not None:
        more = evidence.select(F.col("key").alias("by"), subtag(F.col("declared")).alias("d"), F.lower("host").alias("h"), F.lower("suffix").alias("x"))
        scored = scored.join(more, "by", "left").withColumns({"declared": F.coalesce("d", "declared"), "host": F.coalesce("h", "host"), "suffix": F.coalesce("x", "suffix")}).drop("d", "h", "x")
    best = F.array_position("ll", F.array_max("ll")) - 1
    scored = store(scored.withColumn("best", F.when(F.col("letters") >= least_letters, best).cast("int")))
    # the last two labels of an address; a host that is no more than that has no parent
    domain = F.when(F.col("host").contains("."), F.regexp_extract("host", r"[^.]+\.[^.]+$", 0))
    sure = scored.where("best is not null").withColumn("domain", domain)

    def counted(*by: str) -> DataFrame:
        """c, the sure rows of each language as an array, by these columns; no expression is as
        long as the list of languages."""
        per = sure.groupBy(*by, "best").agg(F.count("*").cast("double").alias("n"))
        return per.groupBy(*by).agg(dense.alias("c"))

    held = F.map_from_entries(F.collect_list(F.struct("best", "n")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at(held, i), F.lit(0.0)))

    # languages of all rows, then of parent domains, then of hosts
    every = F.broadcast(_smoothed(counted(), F.array_repeat(F.lit(1.0 / n), n), strength).select(F.col("p").alias("pa")))
    domains = _smoothed(counted("domain").where("domain is not null").crossJoin(every), "pa", strength).select("domain", F.col("p").alias("pd"))
    hosts = counted("host").withColumn("domain", F.when(domain != F.col("host"), domain)).join(domains, "domain", "left").crossJoin(every)
    priors = _smoothed(hosts, F.coalesce("pd", "pa"), strength).select(F.col("host").alias("h"), F.col("p").alias("prior"))

    def table(column: str) -> DataFrame:
        """P(value | language) up to a factor: what goes with each language, smoothed evenly."""
        counts = counted(column).where(F.col(column).isNotNull())
        of = sure.where(F.col(column).isNotNull()).groupBy("best").agg(F.count("*").cast("double").alias("n")).agg(dense.alias("t"))
        both = counts.crossJoin(F.broadcast(of))
        ratio = F.zip_with("c", "t", lambda x, t: F.ln((x + 1.0) / (t + F.lit(float(n)))))
        return both.select(F.col(column).alias(f"_{column}"), ratio.alias(f"l_{column}"))

    zero = F.array_repeat(F.lit(0.0), n)
    out = scored.join(priors, scored["host"].eqNullSafe(F.col("h")), "left")
    for c in ("declared", "suffix"):
        out = out.join(table(c), F.col(c) == F.col(f"_{c}"), "left")
    fused = F.when(F.col("letters") > 0, F.col("ll")).otherwise(zero)
    fused = F.zip_with(fused, F.coalesce(F.transform("prior", lambda x: F.ln(x)), zero), lambda x, y: x + y)
    for c in ("declared", "suffix"):
        fused = F.zip_with(fused, F.coalesce(F.col(f"l_{c}"), zero), lambda x, y: x + y)
    out = out.select("id", "letters", "best", fused.alias("s")).withColumn("top", F.array_max("s"))
    name = F.array(*map(F.lit, names))
    posterior = 1.0 / F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    at = F.array_position("s", F.col("top")).cast("int")
    accepted = (F.col("letters") >= least_letters) & (posterior >= least_posterior)
    text_lang = F.when(F.col("best").isNotNull(), F.get(name, F.col("best")))
    return out.select("id", F.element_at(name, at).alias("lang"), posterior.alias("posterior"), text_lang.alias("text_lang"), accepted.alias("accepted"))


def _said(url: str, html: str) -> list[Column]:
    """declared, host, suffix: the lang attribute of <html>, and the host and its last label (with the
    first part of the path where that is a two-letter code) of the address."""
    declared = F.regexp_extract(F.col(html), r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", 1)
    host = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    code = F.lower(F.regexp_extract(F.col(url), r"^[^?#]*?://[^/]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    suffix = F.concat_ws("/", F.regexp_extract(host, r"[^.]+$", 0), F.when(code != "", code))
    return [F.when(c != "", c).alias(name) for c, name in ((declared, "declared"), (host, "host"), (suffix, "suffix"))]


def page_rows(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """id, text, declared, host, suffix of web pages; text: what is left without tags."""
    bare = F.regexp_replace(F.regexp_replace(F.col(html), r"(?is)<(script|style|title)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return pages.select(F.col(page_id).alias("id"), bare.alias("text"), *_said(url, html))


def page_evidence(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, declared, host, suffix of the documents that pages show: the number at the end of the
    address's path is the document's id. Of several pages of one document that with the smallest id
    speaks; pages without such an address (null, no number) speak for none."""
    number = F.regexp_extract(F.col(url), r"^[^?#]*?://[^?#]*/([0-9]{1,18})(?:\.\w+)?/?(?:[?#]|$)", 1)
    rows = pages.select(F.when(number != "", number.cast("long")).alias("key"), F.col(page_id).alias("id"), F.struct(*_said(url, html)).alias("r"))
    return rows.where("key is not null").groupBy("key").agg(F.min_by("r", F.struct("id", "r")).alias("r")).select("key", "r.*")

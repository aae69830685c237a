"""The queries of the operators: opN_<name>(spark, sf_dir) over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .html_extract import extract_main_text
from .language_id import identify_language, page_evidence
from .media import media_columns
from .mixing import mix_sources
from .mtree import exact_top_k
from .ngram_join import ngram_jaccard_join
from .packing import pack
from .prefix_trie import prefix_trie
from .quality import quality_scores
from .substring_dedup import substring_dedup
from .token_count import token_counts
from .url_filter import host_and_path, judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, quality: 2 where `labels` calls a document good and 0.5 where it does not."""
    return _table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).alias("quality"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"), quality_weights(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "part")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), texts=False)


def document_evidence(docs: DataFrame) -> DataFrame:
    """The evidence that `documents` themselves hold: the source stands for the host."""
    return docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a page shows have its markup language, host and address for evidence."""
    rows = document_evidence(_table(spark, sf_dir, "documents"))
    return identify_language(rows, evidence=page_evidence(_table(spark, sf_dir, "pages"))).withColumnRenamed("id", "doc_id")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies, as the n-gram join finds them, are one duplicate cluster; rows that it cannot link
    (a null doc_id) go by their set of n-grams. It counts the words too, so that texts are read once."""
    found = ngram_jaccard_join(_table(spark, sf_dir, "documents"), carry=("source",), measures=True)
    linked = F.concat(F.lit("component "), F.col("component_id").cast("string"))
    cluster = F.coalesce(linked, F.concat(F.lit("set "), F.col("set_hash").cast("string")))
    return pack(found.withColumn("cluster", cluster), cluster="cluster", size="n_words")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests beside what is stored: the telephony file and its resampled PCM."""
    return media_columns(_table(spark, sf_dir, "documents"))


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, bad: whether `labels` call the document that a page shows poor or toxic; the last
    number of the path is its id. Null where the document has no label."""
    labels = _table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    number = F.regexp_extract(host_and_path(F.col("url"))[1], "([0-9]+)[^0-9]*$", 1)
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", number.try_cast("long").alias("doc_id"))
    return pages.join(labels, "doc_id", "left").select("page_id", "url", "bad")


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(labelled_pages(spark, sf_dir), bad="bad")
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "labelled", "n_bad")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations")).drop("node")


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_source_mix, op3_quality, op4_ngram_join, op5_substring_dedup,
        op6_language_id, op7_best_fit_packing, op8_exact_top_k, op9_html_extraction, op10_media_columns,
        op11_url_filters, op12_collocations, op13_prefix_trie,
    )
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The others have no SQL form: merges, hash draws, trained models and bin search.
ORACLE_SQL: dict[str, str] = {
    "op4_ngram_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)""",
    "op5_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i : i + 19], ' ') ORDER BY doc_id, i) AS nth FROM win),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM k WHERE nth > 1),
x AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t FROM x ANTI JOIN cov USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op8_exact_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5""",
    "op11_url_filters": r"""WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path, row_number() OVER () AS key FROM pages),
l AS (SELECT doc_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
r AS (SELECT u.*, bad FROM u LEFT JOIN l ON l.doc_id = try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS BIGINT)),
s AS (SELECT key, host, x.d, x.seg, regexp_replace(x.seg, '[0-9]+', '#', 'g') AS mask FROM (SELECT key, host, unnest(list_transform(string_split(path, '/')[2:], lambda s, i: {'seg': s, 'd': i})) AS x FROM r)),
w AS (SELECT key, string_agg(CASE WHEN n1 >= 5 AND n1 >= 0.05 * n0 THEN '=' || seg WHEN n2 >= 5 AND n2 >= 0.05 * n0 THEN '~' || mask ELSE '*' END, '/' ORDER BY d) AS t FROM (
 SELECT *, count(*) OVER (PARTITION BY host, d) AS n0, count(*) OVER (PARTITION BY host, d, seg) AS n1, count(*) OVER (PARTITION BY host, d, mask) AS n2 FROM s) GROUP BY key),
n AS (SELECT r.*, coalesce(regexp_replace(regexp_replace(replace('/' || t || '/', '/', '//'), '(/\*/){2,}', '/**/', 'g'), '//', '/', 'g'), '//') AS t FROM r LEFT JOIN w USING (key)),
st AS (SELECT host, trim(t, '/') AS template, count(bad) AS m, coalesce(sum(bad::INT), 0)::BIGINT AS b FROM n GROUP BY 1, 2),
a AS (SELECT host, template, m, b, unnest(range(1, len(string_split(template, '/')) + 1)) AS d FROM st),
p AS (SELECT *, array_to_string(string_split(template, '/')[:d], '/') AS node, array_to_string(string_split(template, '/')[:d - 1], '/') AS parent, string_split(template, '/')[d] AS seg FROM a),
o AS (SELECT host, d, parent, node, sum(m) AS m, sum(b) AS b FROM p GROUP BY ALL),
q AS (SELECT *, sum(m) OVER x AS ms, sum(b) OVER x AS bs FROM o WINDOW x AS (PARTITION BY host, d, parent)),
f AS (SELECT host, d, node FROM q WHERE m > 0 AND abs(b / m - bs / ms) > sqrt(ln(2 / 0.05) / 2) * (1 / sqrt(m) + 1 / sqrt(ms))),
k AS (SELECT DISTINCT host, array_to_string(string_split(node, '/')[:i], '/') AS node FROM (SELECT host, node, unnest(range(1, d + 1)) AS i FROM f)),
g AS (SELECT p.host, template, any_value(m) AS m, any_value(b) AS b, string_agg(CASE WHEN k.node IS NULL THEN '*' ELSE seg END, '/' ORDER BY d) AS merged FROM p LEFT JOIN k ON k.host = p.host AND k.node = p.node GROUP BY 1, 2),
h AS (SELECT host, merged, sum(m)::BIGINT AS m, sum(b)::BIGINT AS b, (SELECT (coalesce(sum(b), 0) + 1) / (coalesce(sum(m), 0) + 2) FROM st) AS overall FROM g GROUP BY 1, 2),
v AS (SELECT h.*, 1 - (b + 10 * ((hb + 10 * overall) / (hm + 10))) / (m + 10) AS purity FROM h JOIN (SELECT host, sum(m) AS hm, sum(b) AS hb FROM st GROUP BY 1) USING (host)),
j AS (SELECT n.*, v.merged, v.m, v.b, v.purity, CASE WHEN (n.host = 'example.net' OR ends_with(n.host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
 WHEN (n.host = 'example.com' OR ends_with(n.host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
 WHEN (n.host = 'org' OR ends_with(n.host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (n.host = 'net' OR ends_with(n.host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
 FROM n JOIN g ON g.host = n.host AND g.template = trim(n.t, '/') JOIN v ON v.host = g.host AND v.merged = g.merged)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR purity < 0.7 THEN 'block' ELSE 'allow' END AS verdict, merged AS template, m AS labelled, b AS n_bad FROM j""",
    "op12_collocations": r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(ps) AS p FROM d)),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS r(k)) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
x AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT x.lang, x.phrase, x.k, x.a, cut, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score FROM x JOIN t ON t.lang = x.lang
 JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(w[:cut], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(w[cut + 1 :], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, array_to_string(w[j : j + n - 1], ' ') AS phrase, max(a) AS around FROM (SELECT lang, w, a, k, n, unnest(range(1, k - n + 2)) AS j FROM c, range(2, 5) AS r(n) WHERE n < k) GROUP BY 1, 2)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score::BIGINT AS score FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase
 WHERE around IS NULL OR 100 * around < 100 * a QUALIFY rank <= 2000""",
    "op13_prefix_trie": r"""WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS tab),
h AS (SELECT c, c - c % 100 AS base, xor(list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda a, b: xor(a // 256, tab[xor(a, b) % 256 + 1])), 4294967295) % 6 AS h
 FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), tab),
t AS (SELECT conv_id AS c, x, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, x) AS i FROM (
 SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL)),
b AS (SELECT h.c, 0 AS own, i, x, n FROM h JOIN t ON t.c = h.base AND i <= h UNION ALL SELECT h.c, 1, i, x, n FROM h JOIN t ON t.c = h.c AND i > h),
o AS (SELECT c, n, row_number() OVER y AS d, string_agg(x, '') OVER y AS k FROM b WINDOW y AS (PARTITION BY c ORDER BY own, i ROWS UNBOUNDED PRECEDING)),
p AS (SELECT c, 0 AS d, '' AS k, 0 AS n FROM h UNION ALL SELECT c, d, k, n FROM o),
z AS (SELECT c, max(d) AS z FROM p GROUP BY 1),
v AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n FROM p GROUP BY 1, 2),
e AS (SELECT d, k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ends FROM p JOIN z USING (c) WHERE d = z GROUP BY 1, 2),
u AS (SELECT d - 1 AS d, left(k, length(k) - 64) AS k, count(*) AS n_children FROM v WHERE d > 0 GROUP BY 1, 2),
y AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN u ON u.d = v.d AND u.k = v.k),
s AS (SELECT p.d, p.k, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * y.n)::BIGINT AS saved_tokens FROM y JOIN p ON p.c = y.conv_id AND p.d <= y.d GROUP BY 1, 2)
SELECT y.conv_id, y.d::BIGINT AS depth, q.conv_id AS parent_conv_id, y.n_convs, y.n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
 FROM y JOIN s ON s.d = y.d AND s.k = y.k LEFT JOIN e ON e.d = y.d AND e.k = y.k LEFT JOIN v q ON q.d = y.d - 1 AND q.k = left(y.k, length(y.k) - 64)""",
}

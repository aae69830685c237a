from pyspark.sql import functions as F

from skeinlake.functions import text as X
from skeinlake.functions import vectors as V


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def test_tokens_fold_case_and_marks(spark):
    assert one(spark, X.tokens, "Été `a::b` src/x.ts!") == ["ete", "a::b", "src/x.ts!"]
    assert X.query_terms("Été été, a::b") == ["ete", "a::b"]
    assert X.query_terms("``") == []


def test_phrase_takes_one_pair_of_quotes():
    assert X.query_phrase('  "a "b" c" ') == 'a "b" c'
    assert X.query_phrase('""') is None


def test_routes(spark):
    rows = [("a::b", 0, "sub"), ("a/b", 0, "sub"), ("a.b", 0, "sub"), ('"a b"', 0, "sub"), ("a b", 0, "none"), ("a.b", 1, "kw"), ('"a', 0, "none"), ("", 0, "none")]
    df = spark.createDataFrame(rows, "q string, h int, want string")
    assert df.where(X.route(F.col("q"), F.col("h")) != F.col("want")).count() == 0


def test_language_and_slugs(spark):
    assert [one(spark, X.language_of, p) for p in ("a/b.TSX", "x.cjs", "m.py", "n", ".py", "a.b/c")] == ["typescript", "javascript", "python", "text", "text", "text"]
    assert one(spark, X.slug, "  Hello,  World -- Again! ") == "hello-world-again"
    assert one(spark, X.title_slug, "Éa  b/../c" + "x" * 90) == ("ea-b-c" + "x" * 90)[:64]
    assert one(spark, X.utf16_length, "a😀") == 3


def test_nul_within_first_bytes(spark):
    assert one(spark, X.has_nul, bytearray(b"ab\0c"), "binary") is True
    assert one(spark, X.has_nul, bytearray(b"a" * 4096 + b"\0"), "binary") is False


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [1.0])], "a array<float>, b array<float>, c array<float>")
    got = df.select(V.l2_distance(F.col("a"), F.col("b")), V.norm(F.col("a")), V.truncate(F.col("a"), 1), V.normalise(F.col("b")), V.l2_distance(F.col("a"), F.col("c"))).first()
    assert tuple(got) == (5.0, 5.0, [1.0], [0.0, 0.0], None)
    assert df.select(V.similarity(F.lit(1.0)), V.sigmoid(F.lit(0.0))).first()[:] == (0.5, 0.5)

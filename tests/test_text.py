import random

import pytest
from pyspark.sql import functions as F

from querykiln.functions import text as X
from querykiln.functions.numeric import ratio, three_decimals, whole_percent

SPACES = ["  A  b\t\nC ", "Ä Ö", "x  y", "\u0085a\u0085", "\x1ca\x1fb", "", "   ", "a　 b", "ß Q"]


def column(spark, values, expr):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in frame.orderBy("i").select(expr(F.col("v"))).collect()]


def test_normalize_like_python(spark):
    assert column(spark, SPACES, X.normalize) == [" ".join(v.lower().split()) for v in SPACES]


def test_strip_like_python(spark):
    assert column(spark, SPACES, X.strip) == [v.strip() for v in SPACES]


def test_word_count_like_python(spark):
    assert column(spark, SPACES, X.word_count) == [len(v.split()) for v in SPACES]


CASES = [
    ("SELECT 1", "SELECT 1", "SELECT 1"),
    ("```sql\nSELECT 1\n```", "SELECT 1", "SELECT 1"),
    ("<think>x</think>\n```sql\nSELECT 1\n```\n", "SELECT 1", "<think>x</think>\n```sql\nSELECT 1"),
    ("a</think>b</think> SELECT 2", "SELECT 2", "a</think>b</think> SELECT 2"),
    ("```", "", ""),
    ("```SELECT 3```", "```SELECT 3", "```SELECT 3"),
    (" SELECT 4 ", "SELECT 4", "SELECT 4"),
    ("```\n\n SELECT 5 \n\n```  ", "SELECT 5", "SELECT 5"),
    ("SELECT 6\n```", "SELECT 6", "SELECT 6"),
    ("x</think>", "", "x</think>"),
]


def test_strip_sql_fences(spark):
    raw = [c[0] for c in CASES]
    assert column(spark, raw, X.strip_sql_fences) == [c[1] for c in CASES]
    assert column(spark, raw, lambda c: X.strip_sql_fences(c, False)) == [c[2] for c in CASES]


def test_last_subsequence_against_brute_force(spark):
    rnd = random.Random(5)
    cases = [([rnd.randint(1, 3) for _ in range(rnd.randint(0, 12))],
              [rnd.randint(1, 3) for _ in range(rnd.randint(1, 3))]) for _ in range(300)]
    cases += [([1, 11, 1], [1, 1]), ([11], [1]), ([1, 1, 1], [1, 1])]
    frame = spark.createDataFrame([(i, t, m) for i, (t, m) in enumerate(cases)], "i int, t array<int>, m array<int>")
    got = [r[0] for r in frame.orderBy("i").select(X.last_subsequence_index(F.col("t"), F.col("m"))).collect()]
    hits = [[k for k in range(len(t)) if t[k:k + len(m)] == m] for t, m in cases]
    assert got == [max(h, default=-1) for h in hits]


def test_empty_marker_is_rejected(spark):
    frame = spark.sql("SELECT array(1, 2) AS t, CAST(array() AS ARRAY<INT>) AS m")
    with pytest.raises(Exception, match="marker"):
        frame.select(X.last_subsequence_index(F.col("t"), F.col("m"))).collect()


def test_template_prefix_and_marker(spark):
    fill = lambda c: X.fill_template(c, {"schema_context": F.lit("S {{question_de}}"), "question_de": F.lit("Q")})
    assert column(spark, ["{{schema_context}}|{{question_de}}"], fill) == ["S Q|Q"]
    assert column(spark, ["<bos><bos>a", "b<bos>"], X.drop_prefix) == ["<bos>a", "b<bos>"]
    assert column(spark, ["ab##c##", "abc"], lambda c: X.through_marker(c, "##")) == ["ab##", None]


def test_ratio_and_formats(spark):
    one = spark.range(1)
    got = one.select(ratio(F.lit(1), F.lit(0)), ratio(F.lit(1), F.lit(4)), three_decimals(F.lit(0.12345)),
                     whole_percent(F.lit(0.615))).first()
    assert tuple(got) == (0.0, 0.25, "0.123", "62%")


@pytest.mark.parametrize("most", [range(1, 260), (300, 640, 1000, 2000, 8000)])
def test_shares_are_printed_by_their_exact_value(spark, most):
    pairs = [(k, n) for n in most for k in range(n + 1)]
    shares = spark.createDataFrame(pairs, "k int, n int").withColumn("share", F.col("k") / F.col("n"))
    for r in shares.select("k", "n", three_decimals(F.col("share")).alias("d"), whole_percent(F.col("share")).alias("p")).collect():
        assert (r.d, r.p) == (f"{r.k / r.n:.3f}", f"{r.k / r.n:.0%}")

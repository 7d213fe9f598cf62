"""Randomised checks (hypothesis) of the exact percent/total arithmetic and of
distributed numbering, against plain Python."""
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checkwise.functions.scoring import percent_hundredths, total_hundredths
from checkwise.operators.numbering import with_row_number


def _half_away(x: Fraction) -> int:
    s = -1 if x < 0 else 1
    a = abs(x)
    return s * (int(a) + (1 if a - int(a) >= Fraction(1, 2) else 0))


pairs = st.lists(st.tuples(st.integers(-10**12, 10**12), st.integers(-10**6, 10**12),
                           st.integers(0, 10**12), st.integers(0, 10**12), st.integers(0, 1)),
                 min_size=1, max_size=40)


@settings(max_examples=15, deadline=None)
@given(pairs)
def test_percent_and_total_exact(spark, rows):
    df = spark.createDataFrame(rows, "te long, tp long, ie long, ip long, admin int")
    t = percent_hundredths(F.col("te"), F.col("tp"))
    i = percent_hundredths(F.col("ie"), F.col("ip"))
    out = df.select("te", "tp", "ie", "ip", "admin", t.alias("t"), i.alias("i"),
                    total_hundredths(t, i, F.col("admin"), F.col("ip")).alias("tot")).collect()
    for r in out:
        want_t = _half_away(Fraction(r.te * 10000, r.tp)) if r.tp > 0 else 0
        want_i = _half_away(Fraction(r.ie * 10000, r.ip)) if r.ip > 0 else 0
        want_tot = want_t if (r.admin == 1 or r.ip == 0) else _half_away(Fraction(8 * want_t + 2 * want_i, 10))
        assert (r.t, r.i, r.tot) == (want_t, want_i, want_tot), r


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=300), st.integers(1, 9))
def test_row_number_matches_sorted_order(spark, keys, parts):
    df = spark.createDataFrame([(k, j) for j, k in enumerate(keys)], "k int, j int").repartition(parts)
    got = sorted((r.n, r.k, r.j) for r in with_row_number(df, ["k", "j"], "n").collect())
    want = [(n + 1, k, j) for n, (k, j) in enumerate(sorted((k, j) for j, k in enumerate(keys)))]
    assert got == want

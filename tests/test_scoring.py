"""T2/T6/T7 percentages and C4 bands, worked examples from FIXTURES §5."""
from decimal import Decimal

from pyspark.sql import functions as F

from checkwise.functions.scoring import (as_percent, hundredths, kpi_band, percent_hundredths,
                                         total_hundredths)


def _kpi(spark, rows):
    df = spark.createDataFrame(rows, "te decimal(18,2), tp decimal(18,2), ie decimal(18,2), "
                                     "ip decimal(18,2), admin int")
    t = percent_hundredths(hundredths(F.col("te")), hundredths(F.col("tp")))
    i = percent_hundredths(hundredths(F.col("ie")), hundredths(F.col("ip")))
    tot = total_hundredths(t, i, F.col("admin"), hundredths(F.col("ip")))
    return [tuple(r) for r in df.select(as_percent(t), as_percent(i), as_percent(tot)).collect()]


def test_half_up_tie_is_exact(spark):
    # 23/160*100 = 14.375 exactly; binary floats round it down
    assert _kpi(spark, [(Decimal(23), Decimal(160), Decimal(0), Decimal(0), 0)]) == [(14.38, 0.0, 14.38)]


def test_blend_and_admin(spark):
    rows = [(Decimal(8), Decimal(10), Decimal(1), Decimal(3), 0),
            (Decimal(8), Decimal(10), Decimal(1), Decimal(3), 1),
            (Decimal(0), Decimal(0), Decimal(1), Decimal(2), 0),
            (Decimal(1), Decimal(2), Decimal(0), Decimal(0), None)]
    assert _kpi(spark, rows) == [(80.0, 33.33, 70.67), (80.0, 33.33, 80.0),
                                 (0.0, 50.0, 10.0), (50.0, 0.0, 50.0)]


def test_negative_weights_round_away_from_zero(spark):
    assert _kpi(spark, [(Decimal("-23"), Decimal(160), Decimal(0), Decimal(0), 0)]) == [(-14.38, 0.0, -14.38)]


def test_exact_over_all_small_pairs(spark):
    """round(e/p*100, 2) half-up in exact arithmetic, for all 0<=e<=p<=120."""
    from fractions import Fraction
    pairs = [(e, p) for p in range(1, 121) for e in range(0, p + 1)]
    df = spark.createDataFrame(pairs, "e long, p long")
    got = {(r.e, r.p): r.h for r in df.select("e", "p", percent_hundredths(
        F.col("e") * 100, F.col("p") * 100).alias("h")).collect()}
    for e, p in pairs:
        x = Fraction(e * 10000, p)
        want = int(x) + (1 if x - int(x) >= Fraction(1, 2) else 0)
        assert got[(e, p)] == want, (e, p)


def test_bands(spark):
    df = spark.createDataFrame([(90.0,), (89.99,), (70.0,), (69.99,), (None,), (float("nan"),)], "v double")
    assert [r[0] for r in df.select(kpi_band(F.col("v"))).collect()] == \
        ["kpi-good", "kpi-warn", "kpi-warn", "kpi-bad", "kpi-bad", "kpi-bad"]

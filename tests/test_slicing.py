import pytest
from pyspark.sql import functions as F

from tidebar.operators import bars as B
from tidebar.operators import indicators as I
from tidebar.operators import labels as L
from tidebar.operators import slicing
from tidebar.operators import structure as S
from tests.test_operators import frame, walk


@pytest.mark.parametrize("size", [70, 100, 4096])
def test_slices_equal_the_whole(spark, size):
    df = frame(spark, walk(420, 1) + walk(150, 2, "b"))
    steps = [
        (lambda x: L.triple_barrier(S.with_atr(x), (12, 24), (1, 2)), 15, 24, ["label_long_hit_1r_12c", "label_short_hit_2r_24c"]),
        (I.volatility, 50, 0, ["rv_20", "rv_48_half", "garman_klass", "ar_spread"]),
        (lambda x: S.displacement(S.with_atr(x)), 66, 0, ["disp_bull", "disp_bull_age", "disp_bear_strength"]),
    ]
    for f, back, ahead, names in steps:
        order = ["series_id", "bar_idx"]
        whole = f(df).select(*order, *names).orderBy(*order).collect()
        assert slicing.sliced(df, f, back, ahead, size).select(*order, *names).orderBy(*order).collect() == whole


def test_numbering_by_days_equals_numbering(spark):
    df = B.bars_of_events(spark, "/root/testdata/sf0.001", "1h").drop("bar_idx")
    assert slicing.with_bar_idx(df).select("series_id", "ts", "bar_idx").exceptAll(B.with_bar_idx(df).select("series_id", "ts", "bar_idx")).count() == 0
    assert slicing.with_bar_idx(df.limit(0)).count() == 0
    assert slicing.with_bar_idx(df).agg(F.countDistinct("series_id", "bar_idx")).first()[0] == df.count()

"""Core operators on small signals with known results."""

from datetime import datetime, timedelta

from breathline.operators.sessions import sessionize
from breathline.operators.signal import flag_clipping, flag_spikes


def signal(spark, values, step=1.0):
    start = datetime(2026, 1, 1)
    rows = [(1, i, start + timedelta(seconds=step * i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "dev int, seq long, ts timestamp_ntz, v double")


def test_a_gap_equal_to_the_limit_does_not_split(spark):
    df = signal(spark, [1.0, 1.0, 1.0], step=4 * 3600)
    assert {r.session_id for r in sessionize(df, ["dev"]).collect()} == {1}
    assert {r.session_id for r in sessionize(df, ["dev"], limit_hours=3.9).collect()} == {1, 2, 3}


def test_no_bounds_no_clipping_and_one_bound_flags_its_side(spark):
    df = signal(spark, [1.0, 5.0, None])
    assert not any(r.clipping for r in flag_clipping(df, "v").collect())
    assert [r.clipping for r in flag_clipping(df, "v", hi=5.0).orderBy("seq").collect()] == [False, True, False]


def test_a_lone_outlier_is_a_spike_and_a_ramp_is_not(spark):
    wave = [i % 2 * 0.1 for i in range(60)]
    wave[30] = 40.0
    found = [r.seq for r in flag_spikes(signal(spark, wave), ["dev"], ["ts", "seq"], "v").filter("spike").collect()]
    assert found == [30]
    ramp = [float(max(0, min(i - 20, 20)) * 10) for i in range(60)]
    assert flag_spikes(signal(spark, ramp), ["dev"], ["ts", "seq"], "v").filter("spike").count() == 0

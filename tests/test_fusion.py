"""Camera paths from pictures and attitude logs on a small clip."""

import pytest
from pyspark.sql import functions as F

from skyfix.operators import fusion


def frames(spark, rows):
    return spark.createDataFrame(rows, "clip int, t double, az double, el double, roll double, n int, held boolean")


def test_missed_motion_paths_and_what_is_left_alone(spark):
    logs = spark.createDataFrame([(1, k * 0.5, (350.0 + 10 * k) % 360, 5.0, None) for k in range(9)], "clip int, t double, az double, el double, roll double")
    still = frames(spark, [(1, float(k), 90.0 + 0.1 * k, 5.0, 0.0, 20, False) for k in range(5)] + [(2, float(k), 10.0, 0.0, 0.0, 20, False) for k in range(2)])
    m = {r.clip: r for r in fusion.missed_motion(still, logs).collect()}
    assert set(m) == {1} and m[1].seen == pytest.approx(0.4, abs=0.01) and m[1].sensed == pytest.approx(80, abs=0.5) and m[1].ratio < 0.01
    anchors = spark.createDataFrame([(1, 2.0, 100.0, 7.0, 1.0)], "clip int, t double, az double, el double, roll double")
    path = {r.t: r for r in fusion.log_paths(still.select("clip", "t"), logs, anchors).collect()}
    assert path[2.0].az == pytest.approx(100) and path[0.0].az == pytest.approx(60) and path[4.0].az == pytest.approx(140) and path[3.0].el == 7 and path[3.0].roll == 1
    # Weak frames before any trusted one, after too long a time, and of clips without a log stay.
    rows = [(1, 0.0, 1.0, 1.0, 0.0, 2, False), (1, 1.0, 90.0, 5.0, 0.0, None, False), (1, 2.0, 90.0, 5.0, 0.0, 20, True), (1, 3.75, 90.0, 5.0, 0.0, 3, False), (3, 0.0, 4.0, 4.0, 0.0, 20, False), (3, 1.0, 4.0, 4.0, 0.0, 0, False)]
    got = {(r.clip, r.t): (r.src, round(r.az, 6)) for r in fusion.fused(frames(spark, rows), logs).collect()}
    assert got == {(1, 0.0): ("h", 1.0), (1, 1.0): ("v", 90.0), (1, 2.0): ("s", 110.0), (1, 3.75): ("h", 90.0), (3, 0.0): ("v", 4.0), (3, 1.0): ("h", 4.0)}


def test_offsets_need_motion(spark):
    logs = spark.createDataFrame([(1, k * 0.1, 10.0 * k % 360, 5.0, 0.0) for k in range(200)], "clip int, t double, az double, el double, roll double")
    pan = frames(spark, [(1, 5.0 + k, (100.0 * k + 7) % 360, 5.0, 0.0, 20, False) for k in range(6)])
    found = fusion.offsets(pan, logs, 0.5, 0.1).first()
    assert found.confidence == 0 and found.rms == pytest.approx(0, abs=1e-6)  # an even pan fits at every lag
    assert fusion.offsets(pan.where(F.col("t") < 7), logs).count() == 0

"""Series whose rows share times: refused as such, ordered where tie-break columns are named."""

import datetime as dt

import pytest

from tidegauge.plans import workflows as W


def test_rows_that_share_a_time_need_a_tiebreak(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=15 * (i // 3)), i, int(i % 5 == 0), float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "ts timestamp, id int, y int, a double")
    with pytest.raises(ValueError, match="timestamp_duplicate"):
        W.binary_signal(df, ["a"], "y", "ts")
    found = W.binary_signal(df, ["a"], "y", "ts", tiebreak=["id"])
    assert {r["part"]: r["n"] for r in found["parts"].collect()} == {"train": 240, "test": 60}
    lag = {r["lag"]: (r["r"], r["n_pairs"]) for r in found["autocorrelation"].collect()}
    train, n = [r[2] for r in rows[:240]], 239
    x, z = train[1:], train[:-1]
    mx, mz = sum(x) / n, sum(z) / n
    r = sum((a - mx) * (b - mz) for a, b in zip(x, z)) / (sum((a - mx) ** 2 for a in x) * sum((b - mz) ** 2 for b in z)) ** 0.5
    assert lag[1] == (pytest.approx(r), n)
    assert W.class_signal(df, ["a"], "y", {0: "n", 1: "y"}, "ts", ["id"], tiebreak=["id"])["features"].count() == 1
    # The tie-break itself must tell the rows apart.
    with pytest.raises(ValueError, match="timestamp_duplicate"):
        W.binary_signal(df, ["a"], "y", "ts", tiebreak=["y"])

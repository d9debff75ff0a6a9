"""Order statistics, prefix sums and numbering against brute force, on skewed and awkward data."""

import datetime as dt

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidegauge.functions import ordering as O
from tidegauge.functions.expr import hash_order
from tidegauge.operators import splits as S

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def samples():
    rng = np.random.default_rng(7)
    hot = np.concatenate([np.full(1000, 3.25), rng.normal(0, 1, 1500), rng.normal(1e6, 1, 500)])
    return {
        "normal": rng.normal(0, 1, 3000), "lognormal": np.exp(rng.normal(0, 8, 2500)), "hot": hot,
        "narrow": 1e9 + rng.integers(0, 50, 2000) * 1e-6, "constant": np.full(100, 0.1), "one": np.array([4.0]),
        "two": np.array([1.0, 2.0]), "signed": np.concatenate([-np.exp(rng.normal(0, 5, 700)), [0.0] * 300, np.exp(rng.normal(0, 5, 701))]),
        "tiny": rng.uniform(-1e-300, 1e-300, 500),
    }


@pytest.fixture
def keyed(frame):
    rows = [(k, float(v)) for k, vs in samples().items() for v in vs] + [("normal", None), ("empty", None)]
    return frame(rows, "k string, v double")


def test_quantiles_equal_numpy(keyed):
    found = {r["k"]: r for r in O.quantiles(keyed, ["k"], "v", PROBS).collect()}
    assert set(found) == set(samples())
    for k, vs in samples().items():
        assert found[k]["n"] == len(vs)
        np.testing.assert_allclose(found[k]["q"], np.quantile(vs, PROBS), rtol=1e-12, atol=0)


def test_quantiles_without_keys(keyed):
    row = O.quantiles(keyed, [], "v", [0.5]).collect()
    assert len(row) == 1 and row[0]["q"][0] == pytest.approx(np.quantile(np.concatenate(list(samples().values())), 0.5))


def test_infinities_are_ordered_values(frame):
    df = frame([(v,) for v in (float("-inf"), 1.0, 2.0, float("inf"), float("inf"))], "v double")
    assert O.quantiles(df, [], "v", [0.0, 0.375, 0.5, 0.75, 1.0]).first()["q"] == [float("-inf"), 1.5, 2.0, float("inf"), float("inf")]
    tally = df.groupBy("v").agg(F.count("*").alias("n"))
    assert {r["v"]: r["below_n"] for r in O.prefix_sums(tally, [], "v", ["n"]).collect()} == {float("-inf"): 0, 1.0: 1, 2.0: 2, float("inf"): 3}


def test_values_at_ranks_keep_the_integer_type(frame):
    big = 2 ** 60
    df = frame([(big + i,) for i in range(50)] * 3, "v bigint")
    got = O.values_at_ranks(df, [], "v", lambda n: F.array(F.lit(0).cast("bigint"), F.lit(75).cast("bigint"), n - 1))
    assert {r["_rank"]: r["_value"] for r in got.collect()} == {0: big, 75: big + 25, 149: big + 49}


@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sums(keyed, descending):
    tally = keyed.filter("v is not null").groupBy("k", "v").agg(F.count("*").alias("n"))
    got = O.prefix_sums(tally, ["k"], "v", ["n"], descending).collect()
    for k, vs in samples().items():
        ordered = np.sort(vs)
        for r in (r for r in got if r["k"] == k):
            want = (ordered > r["v"]).sum() if descending else (ordered < r["v"]).sum()
            assert r["below_n"] == want


def test_number_rows(frame):
    rng = np.random.default_rng(3)
    base = dt.datetime(2024, 1, 1)
    seconds = sorted(set(int(s) for s in np.exp(rng.normal(8, 3, 2000))))
    df = frame([(base + dt.timedelta(seconds=s), s) for s in rng.permutation(seconds).tolist()], "ts timestamp, s int")
    got = sorted((r["s"], r["obs"]) for r in O.number_rows(df, "ts").collect())
    assert [o for _, o in got] == list(range(1, len(seconds) + 1))


def test_number_by_hash_of_a_hot_class(frame):
    df = frame([(i, "hot" if i % 3 else f"c{i % 7}") for i in range(1500)], "id int, c string").withColumn("h", hash_order(F.col("id"), 1))
    got = O.number_by_hash(df, ["c"], "h", "n").collect()
    for c in {r["c"] for r in got}:
        mine = sorted((r["h"], r["n"]) for r in got if r["c"] == c)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


@pytest.mark.parametrize("n,size", [(10, 0.2), (60, 0.2), (101, 0.35)])
def test_split_with_a_day_that_holds_most_rows(frame, n, size):
    day = dt.date(2024, 5, 1)
    rows = [(day + dt.timedelta(days=(i % 5) if i % 3 == 0 else 2), (i * 37) % n, i) for i in range(n)]
    df = frame(rows, "d date, a int, b int")
    got = S.chronological_split(df, ["d", "a", "b"], size).collect()
    want = sorted(rows)[: int(n * (1 - size))]
    assert sorted((r["d"], r["a"], r["b"]) for r in got if r["part"] == "train") == want


def test_split_rejects_bad_requests(frame):
    df = frame([(1, 1)], "t int, v int")
    with pytest.raises(ValueError, match="one side of the split"):
        S.chronological_split(df, ["t"])
    with pytest.raises(ValueError, match="has to lie inside"):
        S.chronological_split(df, ["t"], 1.0)
    with pytest.raises(ValueError, match="no column"):
        S.chronological_split(df, ["x"])
    twins = frame([(1, 1)] * 10, "t int, v int")
    with pytest.raises(ValueError, match="uniquely"):
        S.chronological_split(twins, ["t", "v"])


def test_order_columns_must_be_orderable_numbers(frame):
    with pytest.raises(TypeError):
        S.chronological_split(frame([("a",), ("b",), ("c",)], "t string"), ["t"], 0.5)
    with pytest.raises(ValueError, match="1 of 3 rows"):
        S.chronological_split(frame([(1,), (None,), (3,)], "t int"), ["t"], 0.5)


def test_split_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.sql("SELECT id, timestamp_seconds(id DIV 3) AS t, cast(timestamp_seconds(id DIV 3) AS timestamp_ntz) AS n FROM range(100)").write.parquet(path)
    rows = spark.read.parquet(path)
    for time in ("t", "n"):
        data, train, test = S.chronological_parts(rows, [time, "id"])
        assert {r["part"]: r["count"] for r in data.groupBy("part").count().collect()} == {"train": 80, "test": 20}
        for part, want in ((train, range(80)), (test, range(80, 100))):
            assert sorted(r["id"] for r in part.collect()) == list(want)
            plan = part._jdf.queryExecution().executedPlan().toString()
            assert f"ThanOrEqual({time}," in plan or f"LessThan({time}," in plan


@pytest.mark.parametrize("values,want", [([1, 2, 3, 3, 5], 0), ([5, 4, 3], 2), ([1, 3, 2, 4, 1], 2), ([7], 0)])
def test_count_descents(frame, values, want):
    df = frame([(i * 10, v) for i, v in enumerate(values)], "o int, v int")
    assert O.count_descents(df, "o", "v").first()["descents"] == want


def test_plans_have_no_single_task_window_over_rows(frame, spark):
    """Every row-level window is partitioned by cell, block or hash prefix."""
    df = frame([(i, float(i)) for i in range(100)], "id int, v double").withColumn("h", hash_order(F.col("id"), 1))
    for out in (O.number_rows(df, "id"), O.number_by_hash(df, [], "h", "n"), O.prefix_sums(df, [], "v", ["v"])):
        top = out._jdf.queryExecution().optimizedPlan().toString().split("Window")[1]
        assert "_c#" in top or "_p#" in top


def test_null_order_values_and_null_keys_stay(frame):
    df = frame([(None if i % 10 == 0 else i, None if i % 4 == 0 else "k", float(i)) for i in range(100)], "o int, k string, v double")
    numbers = {r["v"]: r["obs"] for r in O.number_rows(df, ["o", "v"]).collect()}
    order = sorted(range(100), key=lambda i: (i % 10 != 0, i))
    assert numbers == {float(i): n for n, i in enumerate(order, 1)}
    hashed = df.withColumn("h", hash_order(F.col("v"), 1))
    found = O.number_by_hash(hashed, ["k"], "h", "n").collect()
    assert sorted((r["k"] or "", r["n"]) for r in found) == sorted([("", n) for n in range(1, 26)] + [("k", n) for n in range(1, 76)])
    assert {r["k"]: r["n"] for r in O.quantiles(df, ["k"], "v", [0.5]).collect()} == {None: 25, "k": 75}
    tally = df.groupBy("k", "o").agg(F.count("*").alias("n"))
    below = {(r["k"], r["o"]): r["below_n"] for r in O.prefix_sums(tally, ["k"], "o", ["n"]).collect()}
    assert len(below) == tally.count() and below[None, None] == 0 and below[None, 4] == 5


def test_no_range_holds_a_run_of_ties(spark):
    """Nine of ten rows share the first order value, and a third of all rows are equal throughout."""
    rows = spark.range(30_000).selectExpr("CASE WHEN id % 10 = 0 THEN id ELSE 7 END AS t", "CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS u", "id % 11 AS v", "id")
    rows = rows.withColumn("id", F.expr("CASE WHEN t = 7 AND u = -1 THEN 0 ELSE id END"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows make one range
    ranges = O.in_ranges(rows.repartition(8), ["t", "u"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in ranges.groupBy("_p").count().collect()]
    assert sum(sizes) == 30_000 and max(sizes) < 2.5 * 30_000 / spark.sparkContext.defaultParallelism
    got = sorted((r["obs"], r["t"], r["u"]) for r in O.number_rows(rows, ["t", "u"]).collect())
    assert [o for o, *_ in got] == list(range(1, 30_001)) and [x[1:] for x in got] == sorted(x[1:] for x in got)


def test_prefix_sums_and_descents_of_a_dense_key(spark):
    """One key with most rows, whose values lie close together around one number."""
    rows = spark.range(20_000).selectExpr("CASE WHEN id % 10 = 0 THEN id % 7 ELSE 3 END AS k", "1 + id * 1e-14 AS v", "id % 5 AS n", "id")
    got = O.prefix_sums(rows, ["k"], "v", ["n"]).collect()
    seen = {}
    for r in sorted(got, key=lambda r: r["id"]):
        assert r["below_n"] == seen.get(r["k"], 0)
        seen[r["k"]] = seen.get(r["k"], 0) + r["n"]
    assert len(got) == 20_000
    assert O.count_descents(rows, "id", "n").first()["descents"] == 3_999


def test_numbering_an_empty_table(spark):
    none = spark.range(0).selectExpr("id", "id AS v")
    assert O.number_rows(none, "id").count() == 0 and O.prefix_sums(none, [], "id", ["v"]).count() == 0
    assert O.count_descents(none, "id", "v").first()["descents"] == 0


@pytest.mark.parametrize("sampled, bracketed", [(40, 20), (40_000, 100_000)])
def test_rows_at_ranks_with_long_runs_of_ties(spark, monkeypatch, sampled, bracketed):
    """All rounds happen on few rows when the sample and the bracket are small."""
    monkeypatch.setattr(O, "SAMPLED", sampled)
    monkeypatch.setattr(O, "BRACKETED", bracketed)
    rng = np.random.default_rng(11)
    rows = [(float(a), int(b)) for a, b in zip(rng.choice([0.0, 1.0, 2.0, float("nan")], 3000, p=[0.9, 0.05, 0.04, 0.01]), rng.integers(0, 40, 3000))]
    df = spark.createDataFrame(rows, "a double, b int")
    order = sorted((O._in_order(r), r) for r in rows)
    keys = [k for k, _ in order]
    for rank in (2699, 2999, keys.index(O._in_order((1.0, min(b for a, b in rows if a == 1.0))))):
        found, before = O.numbers_at_rank(df, ["a", "b"], rank)
        assert O._in_order(found) == keys[rank] and before == keys.index(keys[rank])
        alone, before = O.numbers_at_rank(df, ["a"], rank, 3000)
        assert O._in_order(alone) == keys[rank][:1] and before == [k[:1] for k in keys].index(keys[rank][:1])
    with pytest.raises(ValueError, match="no row 3000"):
        O.numbers_at_rank(df, ["a"], 3000)

"""Inverted multi-index mining against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import hard_negatives as H
from tidegauge.llm import queries
from tidegauge.llm.topk import products, top_k
import oracle


def clipped(x, most):
    return max(-most, min(most, x))


def whole(x, scale):
    return clipped(int(np.floor(x * scale)) if abs(x * scale) < 1e300 else (1 << 63) * (1 if x > 0 else -1), (1 << 63) - 1)


def brute(rows, anchors, k=5):
    """(anchor, positive, rank, negative, scores) from {id: (label, vector)}."""
    ints = {i: (y, [whole(x, 256) for x in v]) for i, (y, v) in rows.items()}
    out = []
    for a in sorted(i for i in ints if anchors(i)):
        y, v = ints[a]
        scores = [(clipped(sum(p * q for p, q in zip(v, w)), 1 << 55), i, z) for i, (z, w) in ints.items() if i != a and len(w) == len(v)]
        scores.sort(key=lambda s: (-s[0], s[1]))
        for s, p, _ in [x for x in scores if x[2] == y][:k]:
            inside = [x for x in scores if x[2] != y and 80 * s <= 100 * x[0] <= 100 * s][:k]
            out += [(a, p, r, n, s, t) for r, (t, n, _) in enumerate(inside, 1)]
    return out


SCHEMA = "vec_id long, label int, embedding array<double>, id string, c int, score string"


@pytest.mark.parametrize("components", [1 << 19, 400])
def test_negatives_as_by_brute_force(spark, components):
    rnd = random.Random(components)
    rows = {i: (rnd.randrange(4), [rnd.choice([-1.0, 0.5, 0.25, 3.0, 0.1]) for _ in range(7)]) for i in range(300)}
    rows |= {300 + i: (1, [1.0] * 7) for i in range(80)} | {400 + i: (2, [1.0] * 7) for i in range(40)}  # copies and ties
    rows |= {500 + i: (i % 2, [float(i), 2.0]) for i in range(30)} | {540: (0, []), 541: (1, []), 550: (0, []), 560: (9, [1.5]), 570: (0, [0.0] * 7)}
    rows |= {600 + i: (i % 3, [1e300 if i % 4 else -1e300] * 7) for i in range(12)} | {620: (0, [1e9] * 7), 621: (1, [1e9] * 7), 622: (0, [1e9] * 7)}
    table = [(i, y, v, "x", 1, None) for i, (y, v) in rows.items()]
    table += table[:20] + [(10, 3, [9.0] * 7, "", 0, "")]  # of rows with one id the smallest stays
    rows[10] = min((rows[10][0], rows[10][1]), (3, [9.0] * 7))
    table += [(700, None, [1.0] * 7, "", 0, ""), (710, 1, None, "", 0, ""), (720, 1, [None, 1.0], "", 0, ""), (730, 1, [float("nan")] * 7, "", 0, ""),
              (740, 1, [float("inf")] * 7, "", 0, ""), (None, 1, [1.0] * 7, "", 0, "")]
    got = H.hard_negatives(spark.createDataFrame(table, SCHEMA), lambda i: i % 10 == 0, components=components, anchor_block=16).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(rows, lambda i: i % 10 == 0))


def test_copied_anchor_blocks_are_not_broadcast(spark, frame, monkeypatch):
    rnd, plans, real = random.Random(7), [], H.over_index
    monkeypatch.setattr(H, "over_index", lambda *a: plans.append(real(*a)) or plans[-1])
    rows = [(i, i % 3, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(400)]
    found = H.hard_negatives(frame(rows, "vec_id long, label int, embedding array<double>"), lambda i: i % 10 == 0, components=100, anchor_block=8)
    assert found.count() > 0 and len(plans) == 2
    for met in plans:  # however large a table may be that Spark broadcasts
        assert len(met.collect()) > 40
        assert set(re.findall(r"(\w+Join) \[c#", met._jdf.queryExecution().executedPlan().toString())) == {"SortMergeJoin"}


def test_empty_table_and_single_row(spark):
    df = spark.createDataFrame([(0, 1, [1.0], "", 0, "")], SCHEMA)
    assert H.hard_negatives(df, lambda i: i >= 0).count() == 0
    assert H.hard_negatives(df.limit(0), lambda i: i >= 0).count() == 0


def test_pairs_of_cells_fall():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (1, 7), (6, 5), (16, 16)):
        first, second = rng.integers(0, 9, n).astype(float), rng.integers(0, 9, m).astype(float)
        given = list(H.multi_sequence(first, second))
        sums = [s for *_, s in given]
        assert sorted((i, j) for i, j, _ in given) == [(i, j) for i in range(n) for j in range(m)]
        assert sums == sorted(sums, reverse=True) and all(s == first[i] + second[j] for i, j, s in given)


def test_walk_scores_what_it_must_and_no_more():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 300, (12, 16))
    vectors = (centres[rng.integers(0, 12, 3000)] + rng.normal(0, 10, (3000, 16))).astype(np.int64)
    index = H.indexed(np.arange(3000), np.zeros(3000, np.int64), vectors)
    for q in vectors[:5]:
        found = H.Window(-H.MOST, H.MOST, 10, [], [])
        scored = H.walk(q, index, found.line, lambda p, s, found=found: found.add(index.ids[p], s))
        score = vectors @ q
        assert found.scores == sorted(score.tolist(), reverse=True)[:10] and scored < 2000


def test_scores_beyond_64_bits(spark):
    a = np.array([[1 << 62, 3], [5, -7], [1 << 31, 1 << 31], [-(1 << 63), 1]], np.int64)
    want = [[clipped(sum(int(x) * int(y) for x, y in zip(r, s)), 1 << 60) for s in a] for r in a]
    assert products(a, a).tolist() == want
    rows = [(0, [1.0, 2.0]), (1, [1e300, 1.0]), (2, [-1e300, 1.0]), (3, [1e17, 1e17]), (100, [1e300, 1e300])]
    found = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 100 == 0, k=4).collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == 0] == [3, 100, 1, 2] and len(found) == 8


def test_query_has_the_rows_of_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    verdict, n = oracle.compare(spark, oracle.connect(sf), sf, queries.QUERIES["op11_hard_negatives"], queries.SQL["op11_hard_negatives"])
    assert verdict == "ok" and n > 0
    assert queries.QUERIES["op11_hard_negatives"](spark, sf).filter(F.col("rank") > 5).count() == 0

"""Language ID, toxicity, quality by held-out accuracy; top-k and the pipeline against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidegauge.llm import language_id, queries, topk
from tidegauge.llm.language_id import context_trees, grams, identify
from tidegauge.llm.quality import STATISTICS, score_quality, text_statistics, tree_paths
from tidegauge.llm.topk import top_k
from tidegauge.llm.toxicity import log_ratio, score_toxicity
import oracle

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op5_near_dedup", "op9_exact_dedup", "op10_top_k"])
def test_same_rows_as_sql(spark, name):
    verdict, _ = oracle.compare(spark, oracle.connect("/root/testdata/sf0.001"), "/root/testdata/sf0.001", queries.QUERIES[name], queries.SQL[name])
    assert verdict == "ok"


def test_language_of_held_out_documents(spark):
    found = queries.QUERIES["op4_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_code_lengths_by_hand():
    codes, size = grams(["ab", "ab", "ac"])
    trees = context_trees(["x"], [(np.unique(c), np.zeros(len(np.unique(c)), int), np.unique(c, return_counts=True)[1]) for c in codes])
    bits = trees.bits(grams(["ab"])[0])[:, 0]
    # After three zero bytes: a 3 of 3 with one kind. After those and a: b 2 of 3 with two kinds.
    assert size.tolist() == [2, 2, 2] and bits == pytest.approx([-np.log2(3 / 4), -np.log2(2 / 5)])


@pytest.mark.parametrize("short", [True, False])
def test_languages_of_long_texts_alone_are_learned(spark, short):
    rnd = random.Random(5)

    def text(letters, n):
        return " ".join("".join(rnd.choices(letters, k=5)) for _ in range(n))

    rows = [(i, text("abcdefg", 5000), "aa") for i in range(3)] + [(10 + i, text("uvwxyz", 40 if short else 5000), "uu") for i in range(3)]
    rows += [(20, text("abcdefg", 30), None), (21, text("uvwxyz", 30), None)]
    found = {r.doc_id: r.lang_pred for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert found == {i: "aa" if i < 10 or i == 20 else "uu" for i in found}


def test_counts_of_a_text_in_pieces(monkeypatch):
    text = "".join(random.Random(6).choices("abcdé", k=1000))
    monkeypatch.setattr(language_id, "SLICE_BYTES", 64)
    monkeypatch.setattr(language_id, "TOGETHER", 300)
    batch = pa.RecordBatch.from_pydict({"text": [text, "", "ab"], "language": pa.array([0, 0, 1], pa.int32())})
    got = {}
    for out in language_id.gram_counts([batch.slice(0, 1), batch.slice(1)]):
        for r in out.to_pylist():
            got[r["language"], r["code"]] = got.get((r["language"], r["code"]), 0) + r["n"]
    want = {}
    for i, t in ((0, text), (1, "ab")):
        for c in grams([t])[0][-1].tolist():
            want[i, c] = want.get((i, c), 0) + 1
    assert got == want


@pytest.mark.parametrize("name, label, least", [("op1_quality", "quality", 0.9), ("op3_toxicity", "toxic", 0.9)])
def test_accuracy_on_held_out_labels(spark, name, label, least):
    found = queries.QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out")
    assert found.agg(F.avg((F.col(label) == F.col("predicted")).cast("int"))).first()[0] >= least
    assert found.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_models_without_labels_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, None, 1.0), (2, "", "en", 2.0), (2, "123 !", "en", 2.0), (None, "Word word", "en", 3.0), (4, "x" * 200000, None, 0.0)],
                               "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(1, None, 1), (4, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    assert [r.lang_pred for r in identify(df).orderBy(F.col("doc_id").asc_nulls_last()).collect()] == ["und", "und", "und", "en", "en"]
    assert {r.lang_pred for r in identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    for score in (score_quality, score_toxicity):
        for known in (labels, none):
            rows = score(df, known).collect()
            assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
        assert score(df.limit(0), labels).count() == 0
    assert identify(df.limit(0)).count() == 0
    stats = {r.doc_id: r for r in text_statistics(df).collect()}
    assert stats[4].longest_word == 200000 and stats[1].log_chars == 0 and set(STATISTICS) < set(stats[1].asDict())


def test_rules_are_the_paths_of_the_trees():
    text = "  Tree 0 (weight 1.0):\n    If (feature 0 <= 1.5)\n     If (feature 1 <= 2.0)\n      Predict: 0.0\n     Else (feature 1 > 2.0)\n      Predict: 1.0\n" \
           "    Else (feature 0 > 1.5)\n     Predict: 1.0\n"
    assert [r.conditions for r in tree_paths(text, ["a", "b"])] == [
        (("a", True, 1.5),), (("a", True, 1.5), ("b", True, 2.0)), (("a", True, 1.5), ("b", False, 2.0)), (("a", False, 1.5),)]


def test_class_models_are_distributions():
    rng = np.random.default_rng(1)
    toxic, ordinary = (rng.poisson(0.02, 32**4).astype(float) for _ in range(2))
    assert np.isfinite(log_ratio(toxic, ordinary)).all() and np.abs(log_ratio(toxic, toxic)).max() == 0


def test_top_k_of_awkward_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.5, 0.25, 3.0]) for _ in range(5)], "c") for i in range(300)] + [(300 + i, [1.0] * 5, "hot") for i in range(200)]
    rows += [(600, None, ""), (700, [1.0, None, 1.0, 1.0, 1.0], ""), (800, [float("nan")] * 5, ""), (900, [float("inf")] * 5, ""), (1000, [1.0, 2.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in top_k(df, lambda v: v % 50 == 0, k=7, block=64, query_block=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ints = {i: [int(np.floor(1024 * x)) for x in v] for i, v, _ in rows[:500]}
    for q in range(0, 500, 50):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:7]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert set(got) == set(range(0, 500, 50))
    assert top_k(df.limit(0), lambda v: v >= 0).count() == 0


def test_copied_query_blocks_are_not_broadcast(spark, frame, monkeypatch):
    rng, plans, real = random.Random(8), [], topk.over_grid
    monkeypatch.setattr(topk, "over_grid", lambda grid, step: plans.append(grid) or real(grid, step))
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(400)]
    found = top_k(frame(rows, "vec_id long, embedding array<double>"), lambda v: v % 10 == 0, k=3, block=16, query_block=8)
    assert found.count() == 40 * 3 and len(plans) == 2
    for grid in plans:  # however large a table may be that Spark broadcasts
        assert len(grid.collect()) > 40
        assert set(re.findall(r"(\w+Join) \[c#", grid._jdf.queryExecution().executedPlan().toString())) == {"SortMergeJoin"}


def test_pipeline_stages_take_effect(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "12 34 !!", "en", "s", 8)], base.schema)
    docs, kept = base.unionByName(odd), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    first = {r.doc_id: r.text for r in base.collect()}
    assert kept["language"] == first
    low = {}
    for i, t in sorted(first.items()):
        low.setdefault("".join(c.lower() if c.isascii() else c for c in t), i)
    assert set(kept["exact_dedup"]) == set(low.values())
    from test_dedup import components, cut

    want, _ = components(kept["exact_dedup"], 5, 80)
    assert set(kept["near_dedup"]) == set(want.values())
    whole = cut(kept["near_dedup"], 100)
    assert set(kept["substring_dedup"]) == set(whole)
    assert all(len(whole[i][1]) <= len(t.encode()) <= len(whole[i][1]) + 3 * 2 * whole[i][2] for i, t in kept["substring_dedup"].items())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert pieces.select("doc_id").distinct().count() == len(whole) and pieces.filter("length & (length - 1) <> 0").count() == 0

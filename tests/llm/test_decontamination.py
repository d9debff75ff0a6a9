"""Positional index against brute force over words."""

import hashlib
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import decontamination as D
from tidegauge.llm.decontamination import build_index, contamination, covered, find_matches
from tidegauge.llm import queries
import oracle


def words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def windows(text, width):
    w = words(text)
    n = min(width, len(w))
    return [(i, w[i : i + n]) for i in range(len(w) - n + 1)] if n else []


def brute(docs, items, width):
    """For each row: words, words hit, ids of items found."""
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, passage in items:
            for _, x in windows(passage, width) if item is not None else []:
                for k in range(len(w) - len(x) + 1):
                    if w[k : k + len(x)] == x:
                        hit |= set(range(k, k + len(x)))
                        ids.add(str(item))
        out.append((doc, len(w), len(hit), sorted(ids)))
    return out


def got(frame):
    return [(r.doc_id, r.n_words, r.hit, r["items"]) for r in frame.withColumn("hit", covered("spans")).collect()]


def by_text(rows):
    return sorted(rows, key=repr)


DOCS = "doc_id long, text string, items string, segment string"
ITEMS = "item_id long, text string, words string"


def sample(seed, n=120):
    rnd = random.Random(seed)
    vocabulary = ["a", "bb", "Straße", "naïve", "7", "éa", "x9", "中文"]
    text = lambda k: rnd.choice([" ", "_", "\0", "\n- "]).join(rnd.choices(vocabulary, k=k)).swapcase()
    docs = [(i, text(rnd.randrange(40)), "clash", None) for i in range(n)]
    docs += [(n, None, None, None), (n + 1, "", None, None), (3, docs[3][1], "", ""), (None, docs[5][1], "", ""), (n + 2, "a " * 3000, None, None)]
    items = [(i, text(rnd.choice([1, 2, 3, 4, 5, 8])), "clash") for i in range(25)]
    return docs, items + [(100, None, ""), (101, "?!", ""), (4, items[4][1], ""), (4, "bb bb bb", ""), (None, "a a a a", ""), (102, "missing words here", "")]


@pytest.mark.parametrize("width, block, segment", [(4, 1 << 21, 1 << 22), (4, 40, 300), (10, 1 << 21, 500)])
def test_hits_as_by_brute_force(spark, width, block, segment):
    docs, items = sample(width + block)
    index = build_index(spark.createDataFrame(docs, DOCS), segment_bytes=segment)
    found = got(contamination(index, spark.createDataFrame(items, ITEMS), width=width, block_bytes=block))
    want = brute([d[:2] for d in docs], [i[:2] for i in items], width)
    assert by_text(found) == by_text(want) and any(n for _, _, n, _ in want)


def test_places_of_phrases(spark):
    docs, items = sample(9, 40)
    docs = docs[:40]
    found = find_matches(build_index(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(items, ITEMS), width=3).collect()
    want = {(d, str(i), o, k, len(x)) for d, t, *_ in docs for i, p, _ in items if i is not None for o, x in windows(p, 3)
            for k in range(len(words(t))) if words(t)[k : k + len(x)] == x}
    same = {(r.doc_id, r.item_id, r.start, r.length, tuple(words(docs[r.doc_id][1])[r.start : r.start + r.length])) for r in found}
    assert {(d, i, o, k, n) for d, i, o, k, n in want if i != "4"} == {tuple(r) for r in found if r.item_id != "4"} and len(same) <= len(found)


def test_proximity(spark):
    docs = [(1, "one two three four"), (2, "one x two y three"), (3, "three two one"), (4, "one two"), (5, "three"), (6, "one x x x two three")]
    items = [(9, "one two three")]
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string"), segment_bytes=1000)

    def near(slop):
        want = set()
        for d, text in docs:
            w = text.split()
            for s in range(-slop, len(w) + slop):
                if all(any(0 <= p < len(w) and w[p] == t for p in range(s + j - slop, s + j + slop + 1)) for j, t in enumerate(["one", "two", "three"])):
                    want.add((d, s))
        return want

    for slop in (0, 1, 2):
        found = find_matches(index, spark.createDataFrame(items, "item_id long, text string"), slop=slop).collect()
        assert {(r.doc_id, r.start) for r in found} == near(slop) and len(found) == len(near(slop))


def test_segments_go_to_python_one_by_one(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"one two w{i} three") for i in range(60)], "doc_id long, text string").coalesce(1)
    index, items = build_index(docs, segment_bytes=40), spark.createDataFrame([(1, "one two")], "item_id long, text string")
    before, real = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), D.release

    def noted():
        (tmp_path / uuid.uuid4().hex).touch()
        real()

    D.release = noted
    try:
        assert contamination(index, items).filter("size(items) = 1").count() == 60
    finally:
        D.release = real
    assert len(list(tmp_path.iterdir())) == index.count() >= 20  # a batch for each segment
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_empty_sides(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert contamination(build_index(docs.limit(0)), items).count() == 0
    assert got(contamination(build_index(docs), items.limit(0))) == [(1, 2, 0, [])]
    assert find_matches(build_index(docs), items.limit(0)).count() == 0 and find_matches(build_index(docs.limit(0)), items).count() == 0


def test_query_has_the_rows_of_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    verdict, _ = oracle.compare(spark, oracle.connect(sf), sf, queries.QUERIES["op13_decontamination"], queries.SQL["op13_decontamination"])
    assert verdict == "ok"
    rows = queries.QUERIES["op13_decontamination"](spark, sf)
    assert rows.filter("contaminated").count() > 0
    assert rows.filter(F.col("n_items") == 0).select("items_sha256").distinct().collect()[0][0] == hashlib.sha256(b"").hexdigest()

"""Ball-tree search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidegauge.llm import lexical_search, queries
from tidegauge.llm.lexical_search import Best, Queries, bounds, grow, ranked_search, search
import oracle


def terms(text):
    return ["".join(c.lower() if c.isascii() else c for c in t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        scores = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows, block", [(4096, 1 << 20), (16, 30)])
def test_ranks_as_by_brute_force(spark, monkeypatch, rows, block):
    monkeypatch.setattr(lexical_search, "TREE_ROWS", rows)
    monkeypatch.setattr(lexical_search, "LEAF", 4)
    rnd = random.Random(rows)
    vocabulary = [a + b for a in "abcdefgh" for b in ["", "1", "é", "中", "zz"]]
    text = lambda n: rnd.choice([" ", "-", "\0", "\n"]).join(rnd.choices(vocabulary, [1 / (1 + i) for i in range(40)], k=n)).upper()
    docs = [(i, text(rnd.randrange(30))) for i in range(300)] + [(1000 + i, "A1 A1 Bé hot") for i in range(100)]
    docs += [(2000, None), (2001, ""), (2002, "?!"), (7, docs[7][1]), (None, "a1 bé hot rare"), (2003, "a " * 20000), (2004, "rare")]
    items = [(i, text(rnd.randrange(1, 12))) for i in range(12)] + [(50, None), (51, ""), (52, "nowhere"), (53, "rare hot a1 a1"), (3, "gzz hot"), (None, "rare")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, term string, n int")
    asked = spark.createDataFrame([(*i, "y", 2) for i in items], "item_id int, text string, score string, item int")
    got = sorted((tuple(r) for r in ranked_search(frame, asked, k=5, block_bytes=block).collect()), key=repr)
    assert got == brute(docs, items, 5)


def test_text_ids_of_items_and_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    items = spark.createDataFrame([("q", "a"), ("r", "c c")], "item_id string, text string")
    assert sorted((r.item_id, r["rank"], r.doc_id) for r in ranked_search(docs, items).collect()) == [("q", 1, 1), ("r", 1, 2)]
    assert ranked_search(docs.limit(0), items).count() == 0 and ranked_search(docs, items.limit(0)).count() == 0
    assert ranked_search(docs, items).schema["item_id"].dataType.simpleString() == "string"


@pytest.mark.parametrize("bands", [1, 5, 40])
def test_bounds_hold_and_subtrees_are_left_out(bands):
    rng = np.random.default_rng(bands)
    n, v = 400, 40
    dense = np.where(rng.random((n, v)) < 0.15, rng.integers(1, 10**6, (n, v)), 0)
    dense[:, 0] += 1
    ends = np.append(0, np.cumsum((dense > 0).sum(1)))
    weights = rng.integers(1, 20000, v)
    root, band = np.sqrt(weights), np.arange(v) % bands
    own = [np.sort(rng.choice(v, 6, replace=False)) for _ in range(9)]
    asked = Queries(np.concatenate(own), np.arange(0, 55, 6), weights)
    tree = grow(np.arange(n), ends, np.nonzero(dense)[1], dense[dense > 0], root, band, 8)
    score = np.stack([dense[:, o] @ weights[o] for o in own], 1)
    limit = bounds(tree, asked, root, band)
    for (lo, hi, *_), most in zip(tree.nodes.tolist(), limit):
        assert (score[tree.ids[lo:hi]].max(0) <= most).all()
    best = Best(9, 5, np.zeros(9, np.int64))
    scored = search(tree, asked, root, band, best, None)
    for i in range(9):
        assert best.scores[i].tolist() == np.sort(score[:, i])[::-1][:5].tolist()
    assert scored < 9 * n or bands < 40
    assert tree.ids.tolist() != sorted(tree.ids.tolist()) and sorted(tree.ids.tolist()) == list(range(n))


def test_query_has_the_rows_of_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert oracle.compare(spark, oracle.connect(sf), sf, queries.QUERIES["op12_lexical_search"], queries.SQL["op12_lexical_search"]) == ("ok", 400)

"""Exact, near and substring deduplication against brute force, on awkward tables too."""

import hashlib
import random

import pytest

from tidegauge.llm.components import connected_components
from tidegauge.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from tidegauge.llm import near_dedup
from tidegauge.llm.near_dedup import common_shingles, drop_near_duplicates, links_within_families, near_duplicates, packed_texts, shingle_hashes, shingle_set
from tidegauge.llm.suffix_dedup import repeated_substrings

DOCS = "doc_id long, text string"


def components(texts, k, percent):
    sets = {i: shingle_set((t or "").encode(), k) for i, t in texts.items()}
    up = {i: i for i in texts}

    def top(i):
        return i if up[i] == i else top(up[i])

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: top(i) for i in texts}, sets


def edited(rnd, words, share):
    return " ".join(w if rnd.random() > share else f"w{rnd.randrange(10**6)}" for w in words)


def test_near_duplicates_equal_brute_force(spark):
    rnd, texts = random.Random(5), {}
    for family in range(6):
        words = [f"f{family}x{rnd.randrange(300)}" for _ in range(rnd.choice([6, 20, 80, 200]))]
        for _ in range(25):
            texts[len(texts)] = edited(rnd, words, rnd.choice([0, 0.01, 0.03, 0.05, 0.1]))
    for t in (None, "", " \t\n", "one", "ONE", "one two", "Two One", "É a", "é a"):
        texts[len(texts)] = t
    want, sets = components(texts, 2, 80)
    df = spark.createDataFrame(list(texts.items()), DOCS)
    got = {r.doc_id: r for r in near_duplicates(df, 2, 80).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert drop_near_duplicates(df, 2, 80).count() == len(set(want.values()))


def test_near_duplicates_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "y"), (0, "A b c d e f", None)], DOCS + ", rep string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(False, 0, 0, True), (False, 1, 0, False), (False, 1, 0, False), (True, 0, None, True)]
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("together", [1, 7, 8192])
def test_common_shingles_of_all_pairs(monkeypatch, together):
    monkeypatch.setattr(near_dedup, "TOGETHER", together)
    rnd = random.Random(together)
    texts = [" ".join(rnd.choices("abcdefg", k=rnd.randrange(30))) for _ in range(40)]
    got = common_shingles(*shingle_hashes(texts, 2), 15, 40)
    sets = [shingle_set(t.encode(), 2) for t in texts]
    assert got.tolist() == [[len(a & b) for b in sets[15:]] for a in sets[:15]]


def test_families_keep_links_of_small_sets_at_the_line(spark):
    """Sets of 5 and 4 shingles with 4 in common, all in one family: every link between different texts is found."""
    texts = {}
    for i in range(150):
        words = [f"{c}{i}" for c in "abcdef"]
        texts[2 * i], texts[2 * i + 1] = " ".join(words), " ".join(words[:5])
    texts[400] = "long " + " ".join(f"w{j}" for j in range(60_000))
    texts[401] = " ".join(f"w{j}" for j in range(59_000))
    df = spark.createDataFrame(list(texts.items()), DOCS)
    mixed = spark.createDataFrame([(i, len(shingle_set(t.encode(), 2)), i, 0) for i, t in texts.items()], "rep long, n_shingles long, component long, centre long")
    found = links_within_families(mixed, packed_texts(df, "doc_id", "text"), 2, 80).collect()
    assert {tuple(sorted((r.a, r.b))) for r in found} == {(2 * i, 2 * i + 1) for i in range(150)} | {(400, 401)}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_duplicates_equal_brute_force(spark, keep):
    texts = ["a", "A", None, "", "É", "é", "long " * 5000, "LONG " * 5000] + ["hot"] * 200
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], DOCS + ", sha string")
    low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "") for t in texts]
    groups = {t: [i for i, x in enumerate(low) if x == t] for t in low}
    best = min if keep == "smallest" else max
    for r in exact_duplicates(df, keep=keep).collect():
        own = groups[low[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (best(own), len(own), r.doc_id == best(own))
        assert r.text_sha256 == hashlib.sha256(low[r.doc_id].encode()).hexdigest()
    assert {r.doc_id for r in drop_exact_duplicates(df, keep=keep).collect()} == {best(g) for g in groups.values()}


def test_exact_duplicates_of_odd_tables(spark):
    df = spark.createDataFrame([(5, "x"), (5, "x"), (None, "x"), (None, "y"), (None, "y")], DOCS)
    got = sorted((r.text_sha256 == hashlib.sha256(b"x").hexdigest(), r.keep_id or 0, r.group_size, r.kept) for r in exact_duplicates(df).collect())
    assert got == [(False, 0, 2, True)] * 2 + [(True, 5, 3, False), (True, 5, 3, True), (True, 5, 3, True)]
    assert exact_duplicates(df.limit(0)).count() == 0


def cut(texts, width):
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            if w in seen:
                gone[p : p + width] = b"\1" * width
            seen.add(w)
        spans = [p for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1])]
        out[i] = (len(b), bytes(x for x, g in zip(b, gone) if not g), len(spans))
    return out


@pytest.mark.parametrize("batch_rows", [10000, 7])
def test_substrings_equal_brute_force(spark, batch_rows):
    rnd, texts = random.Random(batch_rows), {}
    passage = "".join(rnd.choices("abcdefgh é", k=260))
    for i in range(900):  # the passage stands in more kinds of surroundings than a small bucket holds
        texts[i] = "".join(rnd.choices("abcdefgh ", k=rnd.randint(20, 90))) + passage[rnd.choice([0, 0, 0, 31]) :] + "".join(rnd.choices("xyz", k=rnd.randint(0, 60)))
    for t in (None, "", "a" * 500, "ab" * 300, texts[3], passage + passage, "short", "x" * 99, "é" * 200):
        texts[len(texts)] = t
    order = list(texts)
    rnd.shuffle(order)
    df = spark.createDataFrame([(i, texts[i], "k") for i in order], DOCS + ", runs string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    try:
        got = {r.doc_id: (r.n_bytes, bytes(r.kept), len(r.spans)) for r in repeated_substrings(df, 100).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == cut(texts, 100)


def test_substrings_in_whole_characters_and_odd_tables(spark):
    text = "é" * 150 + "".join(map(chr, range(300, 420)))
    df = spark.createDataFrame([(1, text, "a"), (2, "q" + text, "b"), (None, text, None)], DOCS + ", source string")
    rows = {r.doc_id: r for r in repeated_substrings(df, 99, keep=("source",), whole_characters=True).collect()}
    assert all(bytes(r.kept).decode() is not None for r in rows.values())
    assert bytes(rows[2].kept).startswith(b"q") and rows[2].n_bytes == 1 + len(text.encode()) and rows[2].source == "b"
    assert len(rows[None].kept) == 0
    same = spark.createDataFrame([(1, text), (1, text)], DOCS)
    assert len({bytes(r.kept) for r in repeated_substrings(same, 99).collect()}) == 1
    assert repeated_substrings(df.limit(0), 100).count() == 0


def cut_rows(rows, width):
    """What is kept of (id, text) rows, where rows of one id, null included, are one document."""
    first, windows = {}, []
    for i, text in rows:
        b, i = text.encode(), float("inf") if i is None else i
        windows.append([(b[p : p + width], (i, p)) for p in range(len(b) - width + 1)])
        for w, place in windows[-1]:
            first[w] = min(first.get(w, place), place)
    out = []
    for (i, text), found in zip(rows, windows):
        b = text.encode()
        gone = bytearray(len(b))
        for w, (_, p) in found:
            if first[w] < (float("inf") if i is None else i, p):
                gone[p : p + width] = b"\1" * width
        out.append((i, hashlib.sha256(b).hexdigest(), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batch_rows", [10000, 1])
@pytest.mark.parametrize("many", [4, 700])
def test_substrings_of_rows_that_share_an_id(spark, batch_rows, many):
    rnd = random.Random(many)

    def text(n):
        return "".join(rnd.choices("abcdefgh ", k=n))

    passage, one, two, three = (text(n) for n in (260, 300, 350, 150))
    rows = [(1, one), (1, one), (None, two), (None, two), (None, two + three), (None, text(400)), (None, text(130) + two[40:]), (3, passage), (3, passage + three)]
    rows += [(4, text(20) + passage), (4, text(20) + passage), (4, passage), (5, three + three), (5, three + three)]
    rows += [(rnd.choice([6, None, 100 + i]), text(rnd.choice([0, 0, 35])) + passage[rnd.choice([0, 31]) :] + text(rnd.randint(0, 40))) for i in range(many)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, DOCS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    try:
        source = df.selectExpr("doc_id", "text", "sha2(text, 256) AS sha")
        got = [(r.doc_id, r.sha, bytes(r.kept)) for r in repeated_substrings(source, 100, keep=("sha",)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = cut_rows(rows, 100)
    assert sorted(got, key=str) == want
    assert [kept for i, _, kept in want if i == 1] == [one.encode()] * 2

"""Quoted line breaks in files that are read in many blocks, against a character machine and the csv module."""

import csv
import io
import random

import pytest

from tidegauge.sources import files as A
from tidegauge.sources.records import composed, read_records


@pytest.fixture
def small_blocks(spark):
    """Files are cut every 400 bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def machine(lines, sep):
    """(first line, last line, text, broken) of each record; one character after the other."""
    out, state, held, first = [], "start", [], 1
    for n, line in enumerate(lines, 1):
        if state != "inside":
            state, held, first = "start", [], n
        held.append(line)
        broken = False
        for c in line:
            if state == "start":
                state = "inside" if c == '"' else "start" if c == sep else "bare"
            elif state == "bare":
                state = "start" if c == sep else "bare"
            elif state == "inside":
                state = "quote" if c == '"' else "inside"
            elif state == "quote":
                if c not in ('"', sep):
                    broken = True
                    break
                state = "inside" if c == '"' else "start"
        if broken or state != "inside":
            out.append((first, n, "\n".join(held), broken))
            state = "start"
    if state == "inside":
        out.append((first, len(lines), "\n".join(held), True))
    return out


def write(folder, name, content):
    (folder / name).write_bytes(content.encode() if isinstance(content, str) else content)
    return str(folder / name)


@pytest.mark.parametrize("sep", [",", "|"])
def test_records_as_by_a_character_machine(spark, tmp_path, small_blocks, sep):
    rnd, texts = random.Random(sep), {}
    for i in range(6):
        lines = ["".join(rnd.choices(['"', '""', sep, "a", "é", " ", ""], [3, 2, 3, 6, 1, 1, 1], k=rnd.randrange(9))) for _ in range(40)]
        texts[f"f{i}.csv"] = lines
        write(tmp_path, f"f{i}.csv", "\n".join(lines) + "\n")
    found = {name: [] for name in texts}
    for r in read_records(spark, str(tmp_path), sep).collect():
        found[r.file.rsplit("/", 1)[-1]].append((r.first_line, r.line, r.text, r.broken))
    assert {name: sorted(rows) for name, rows in found.items()} == {name: machine(lines, sep) for name, lines in texts.items()}


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_cells_equal_the_csv_module(spark, tmp_path, small_blocks, ending):
    rnd, want = random.Random(7), {}
    for name, sep in (("c", ","), ("s", ";"), ("t", "\t"), ("p", "|")):
        rows = [["id", " note ", "x"]] + [[str(i), "".join(rnd.choices(["a", '"', sep, "\n", "é", " ", ","], k=rnd.randrange(30))), f"{i / 7}"] for i in range(50)]
        out = io.StringIO(newline="")
        csv.writer(out, delimiter=sep, lineterminator=ending).writerows(rows)
        write(tmp_path, name, "﻿" + out.getvalue())
        reader = csv.reader(io.StringIO(out.getvalue(), newline=""), delimiter=sep, strict=True)
        want |= {(name, reader.line_num): row for row in reader}
    found = A.read_delimited(spark, str(tmp_path))
    assert {r.file[-1]: (r.delimiter, r.names) for r in found.headers.collect()} == {n: (s, ["id", "note", "x"]) for n, s in (("c", ","), ("s", ";"), ("t", "\t"), ("p", "|"))}
    assert {(r.file[-1], r.line): r.cells for r in found.records.collect()} == {k: v for k, v in want.items() if k[1] > 1}
    assert found.issues.count() == 0
    assert A.load_delimited(spark, str(tmp_path)).columns == ["id", "note", "x"]


def test_strict_reader_takes_quoted_breaks_and_sniffs(spark, tmp_path):
    write(tmp_path, "a.csv", 'note;b;a\n"two\nlines; ""so""";0.5;0.25\nplain;1;0\n')
    write(tmp_path, "b.csv", 'a,b\n0.5,0.5\n"0.1\n",7\n')
    write(tmp_path, "c.csv", 'a\tb\n0.5\t"0.5\n0.1\t0.2\n')
    found = A.strict_csv(spark, str(tmp_path), ["a", "b"], sep=None)
    assert {r.file[-5]: (r.accepted, r.reason, r.n_rows, r.first_line) for r in found.verdict.collect()} == {
        "a": (True, None, 2, None), "b": (False, "out_of_range", 2, 4), "c": (False, "bad_quote", 1, 3)}
    assert sorted((r.line, r.a, r.b) for r in found.rows.collect()) == [(3, 0.25, 0.5), (4, 0.0, 1.0)]


def test_records_that_never_close_are_not_put_together(spark, tmp_path, small_blocks):
    path = write(tmp_path, "a.csv", "a,b\n1,2\n" + '3,"open\n' + "x,y\n" * 500)
    found = {r.first_line: (r.line, r.text, r.broken) for r in read_records(spark, path, longest=100).collect()}
    assert found == {1: (1, "a,b", False), 2: (2, "1,2", False), 3: (503, None, True)}
    with pytest.raises(ValueError, match="Line 503 of .*bad_quote"):
        A.load_delimited(spark, write(tmp_path, "b.csv", "a,b\n1,2\n" + '3,"open\n' + "x,y\n" * 500))


def test_wrong_width_blank_line_and_encoding_are_named(spark, tmp_path):
    path = write(tmp_path, "a.csv", b"a,b\n1,2\n\n1,2,3\n\xff,1\n")
    assert sorted((r.line, r.kind) for r in A.read_delimited(spark, path).issues.collect()) == [(3, "width"), (4, "width"), (5, "invalid_utf8")]
    for text, message in (("", "no line"), ("a,a\n1,2\n", "a")):
        with pytest.raises(ValueError, match=message):
            A.load_delimited(spark, write(tmp_path, "x.csv", text))
    write(tmp_path / ".", "y.csv", "a;b\n1;2\n")
    two = tmp_path / "two"
    two.mkdir()
    write(two, "1.csv", "a;b\n1;2\n")
    write(two, "2.csv", "a,c\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        A.load_delimited(spark, str(two))


def test_composition_of_line_maps():
    import numpy as np

    rng = np.random.default_rng(2)
    start, again = rng.integers(0, 3, 500), rng.integers(0, 3, 500)
    for first in (0, 1):
        state, want = first, []
        for a, b in zip(start, again):
            state = int((a, b)[state] == 1)
            want.append(state)
        before, after = composed(start, again, first)
        assert after.tolist() == want and before.tolist() == [first, *want[:-1]]


def test_titled_header_with_a_quoted_delimiter(spark, tmp_path):
    path = write(tmp_path, "t.csv", 'Title\n"a,b",c\n1,2\n')
    assert A.load_dataset(spark, path).columns == ["a,b", "c"]

"""The verdict of a file is counted where its lines were read: nothing is sorted or gathered by file."""

import contextlib
import io

from tidegauge.sources import files as L


def test_first_problem_without_sorting_lines(spark, tmp_path):
    bad = {"a": ("0.1,0.2\n0.1,x\n,0.2\n", (3, "nonnumeric", "v")), "b": ("0.1,7\n", (2, "out_of_range", "v")), "c": ("inf,0.1\n", (2, "nonfinite", "u")),
           "d": ("0.1\n", (2, "width", None)), "e": (' ,0.1\n', (2, "missing", "u")), "f": ('0.1,"a"b\n', (2, "bad_quote", None)), "g": ("0.1,0.2\n", (None, None, None))}
    for name, (text, _) in bad.items():
        (tmp_path / f"{name}.csv").write_text("u,v\n" + text)
    (tmp_path / "h.csv").write_bytes(b"u,v\n0.5,0.5\n0.1,\xff\n")
    verdict = L.strict_csv(spark, str(tmp_path), ["u", "v"]).verdict
    got = {r["file"][-5]: (r["first_line"], r["reason"], r["first_feature"]) for r in verdict.collect()}
    assert got == {n: w for n, (_, w) in bad.items()} | {"h": (3, "invalid_utf8", None)}
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        verdict.explain()
    assert "SortAggregate" not in plan.getvalue()

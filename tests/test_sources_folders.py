"""Folders whose tables are folders of part files."""

from tidegauge.sources import files as L


def test_a_folder_of_part_files_is_one_dataset(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    (tmp_path / "one.csv").write_text("a\n1\n")
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "old.v1").mkdir()
    (tmp_path / "old.v1" / "past.csv").write_text("a\n")
    found = L.list_files(spark, str(tmp_path)).collect()
    assert [(r["name"], r["format"]) for r in found] == [("one.csv", "csv"), ("t.parquet", "parquet")]
    parts = list((tmp_path / "t.parquet").glob("part-*"))
    assert len(parts) == 3 and found[1]["n_bytes"] == sum(p.stat().st_size for p in parts) and found[0]["n_bytes"] == 4
    assert found[1]["path"].endswith(f"{tmp_path}/t.parquet")

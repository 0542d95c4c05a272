"""Every file's header counts, not the first file's alone."""

from __future__ import annotations

from panelforge.sources.csv_strict import strict_csv


def test_a_folder_with_one_reordered_header_shows_it(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n1,2\n")
    assert strict_csv(spark, str(tmp_path), ["x", "y"]).header == ["y", "x"]
    assert strict_csv(spark, str(tmp_path / "a.csv"), ["x", "y"]).header == ["x", "y"]

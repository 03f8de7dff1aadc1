from __future__ import annotations

import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sessionlake.sources import archives, files


def test_paths(tmp_path, monkeypatch):
    monkeypatch.setenv("SOME_DIR", str(tmp_path))
    assert files.resolve_path(None, "SOME_DIR", "/nowhere", "the folder") == str(tmp_path)
    assert files.resolve_path("/x", "SOME_DIR", "/y", "the folder", must_exist=False) == "/x"
    monkeypatch.delenv("SOME_DIR")
    with pytest.raises(FileNotFoundError):
        files.resolve_path(None, "SOME_DIR", "/nowhere/at/all", "the folder")


def test_zip_to_events(spark, tmp_path):
    """Members are read in place; equal file names in two folders stay apart; marks, ragged records, quotes and empty members have defined results."""
    archive = tmp_path / "a.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("data/job_started.csv", "\ufeffpid,Time_utc,CurrentGameMode,Level\np1,2024-01-01 00:00:00,Career,1.5\n,2024-01-01 00:00:00,,\np2,bad,,\np3,2024-01-02 00:00:00,,x\n")
        z.writestr("data/old/job_started.csv", 'pid,CurrentGameMode,Time_utc\n\n"p,4","a ""b""\nc",2024-01-03 00:00:00,beyond,the header\np5\n')
        z.writestr("data/empty.csv", "")
        z.writestr("readme.csv", "x")
        z.writestr("data/notes.txt", "x")
    assert [m for _, m in archives.csv_members(str(archive))] == ["data/empty.csv", "data/job_started.csv", "data/old/job_started.csv"]
    raw = archives.read_zip_csv(spark, str(archive), ["pid", "Time_utc", "CurrentGameMode", "Level"])
    assert raw.rdd.getNumPartitions() == 3
    assert sorted((r.member, r.pid, r.CurrentGameMode, r.Level) for r in raw.filter("member like '%old%'").collect()) == [("data/old/job_started.csv", "p,4", 'a "b"\nc', ""), ("data/old/job_started.csv", "p5", "", "")]
    df = files.typed_events(raw, archives.table_of(F.col("member")), ["Level", "Absent"], ["CurrentGameMode"])
    rows = sorted((r.pid, r.event_table, r.CurrentGameMode, r.Level, r.Absent) for r in df.collect())
    assert rows == [("p,4", "job_started", 'a "b"\nc', None, None), ("p1", "job_started", "Career", 1.5, None), ("p3", "job_started", "", None, None)]


def test_archives_are_written_whole_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "z")
    df = spark.range(1000).selectExpr("concat('t', id % 3) AS kind", "id", "if(id % 7 = 0, null, concat('a,\"\n', id)) AS text").repartition(4)
    archives.write_zip_csv(df, f"file://{folder}", "kind")
    assert len(list((tmp_path / "z").iterdir())) == 4
    got = archives.read_zip_csv(spark, f"file:{folder}", ["id", "text", "absent"])
    assert got.rdd.getNumPartitions() == 12
    assert Counter((r.member, int(r.id), r.text, r.absent) for r in got.collect()) == Counter((f"data/{r.kind}.csv", r.id, r.text or "", "") for r in df.collect())
    failing = df.withColumn("kind", F.when(F.col("id") != 500, F.col("kind")))
    with pytest.raises(Exception, match="has no name"):
        archives.write_zip_csv(failing, folder, "kind")
    assert len(list((tmp_path / "z").iterdir())) == 4
    archives.write_zip_csv(df.limit(0), str(tmp_path / "e"), "kind")
    (tmp_path / "e").mkdir(exist_ok=True)
    assert archives.read_zip_csv(spark, str(tmp_path / "e"), ["id"]).count() == 0
    with pytest.raises(Exception, match="other types"):
        spark.read.format("zip_csv").schema("id long").load(folder).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b")], "k int, v string")
    files.write_small_csv(df, str(tmp_path / "t.csv"))
    assert (tmp_path / "t.csv").read_bytes() == b"\xef\xbb\xbfk,v\r\n1,a|b\r\n"
    files.write_small_csv(df.limit(0), str(tmp_path / "e.csv"))
    assert (tmp_path / "e.csv").read_bytes() == b""
    assert "a\\|b" in files.report("T", {"Table": df}, {"n": 1})
    files.write_csv(df, str(tmp_path / "c"), bom=True)
    assert files.read_text_csv(spark, str(tmp_path / "c")).columns == ["k", "v"]
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    assert files.union_by_name([df, df.select("k")]).count() == 2


def test_markdown_says_what_it_leaves_out(spark):
    df = spark.range(60)
    assert "first 50 rows" in files.markdown_table(df)
    assert "first" not in files.markdown_table(df.limit(50))

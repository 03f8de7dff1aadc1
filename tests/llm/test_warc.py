from __future__ import annotations

import gzip
import hashlib
import io
import zlib

import pytest
from pyspark.sql import functions as F

from sessionlake.llm import warc
from sessionlake.llm.shared import materialise, shared_folder


def brute(rows):
    first: dict[str, int] = {}
    data = [(k, (h or "").encode()) for k, _, h in rows]
    for k, p in data:
        if len(p) >= 1000:
            d = hashlib.sha1(p).hexdigest()
            first[d] = max(first.get(d, k), k)
    out = []
    for k, p in data:
        d = hashlib.sha1(p).hexdigest()
        again = len(p) >= 1000 and first[d] != k
        out.append((k, len(p), d, "revisit" if again else "response", first[d] if again else None))
    return sorted(out)


LONG = "é" * 700
ROWS = [(1, "http://a/", "x" * 1000), (2, "http://a/ b\r\nX: y", "x" * 1000), (9, None, "x" * 1000), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", ""), (7, "ü://x", LONG), (8, "u", LONG), (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 200), (11, "u", "z" * 3_000_000)]


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS path")
    assert sorted(tuple(r) for r in warc.round_trip(df).collect()) == brute(ROWS)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_repeated_rows_and_null_ids(spark):
    rows = [(3, "u", "q" * 2000), (3, "u", "q" * 2000), (2, "u", "q" * 2000), (None, "u", "q" * 2000), (None, None, None)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [(0, "response", 0), (0, "revisit", 3), (2, "revisit", 3), (3, "response", 0), (3, "response", 0)]


def test_payloads_of_other_pages_are_not_shuffled(spark):
    """With automatic broadcast off, only pages that may repeat a payload go through the exchange of the join."""
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(tuple(r) for r in warc.round_trip(df).collect()) == brute(ROWS)
        pages = df.selectExpr("page_id", "url", "cast(coalesce(html, '') as binary) AS payload").selectExpr("*", "cast(octet_length(payload) as long) AS payload_bytes", "sha1(payload) AS payload_digest")
        again = pages.filter("payload_bytes >= 1000").groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
        alone, others = warc.maybe_repeated(pages, materialise(again, f"{shared_folder(spark)}/again"), 1000)
        assert sorted(r.page_id for r in alone.collect()) == [3, 4, 5, 6, 10, 11]  # those of 7 and 8 are the same
        assert sorted(r.page_id for r in others.collect()) == [1, 2, 7, 8, 9]
        plan = alone._jdf.queryExecution().executedPlan().toString()
        scan = plan[plan.index("BroadcastHashJoin") :]
        assert "SortMergeJoin" not in plan and "hashpartitioning(payload" not in scan.split("BroadcastExchange")[0]
        whole = warc.with_revisits(df)._jdf.queryExecution().executedPlan().toString()
        assert whole.count("LeftSemi") == 1 and whole.count("LeftAnti") == 1 and whole.count("SortMergeJoin") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_archives_rotate_and_are_whole_streams(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    folder = shared_folder(spark)
    made = warc.write_archives(warc.with_revisits(df).coalesce(1), folder, archive_bytes=600).collect()
    assert len(made) > 1
    assert sum(r.records for r in made) == len(ROWS)
    for r in made:
        fs, at = warc.file_system(r.path)
        d = zlib.decompressobj(warc.GZIP)
        assert d.decompress(fs.open_input_stream(at, compression=None).read()).startswith(b"WARC/1.1\r\n")
        assert d.eof
        assert not d.unused_data


def records(n):
    return [warc.record_head(k, f"http://x/{k}", hashlib.sha1(b"p" * k).hexdigest(), k, None) + b"p" * k + b"\r\n\r\n" for k in range(n)]


@pytest.mark.parametrize("members", [1, 3])
@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_normaliser(members, piece, monkeypatch):
    monkeypatch.setattr(warc, "PIECE", piece)
    rows = records(40)
    parts = [b"".join(rows[k::members]) for k in range(members)]
    out, index = io.BytesIO(), io.BytesIO()
    assert warc.normalise_stream(io.BytesIO(b"".join(map(gzip.compress, parts))), out.write, index.write) == 40
    whole = out.getvalue()
    assert gzip.decompress(whole) == b"".join(parts)
    got = []
    for line in index.getvalue().splitlines():
        offset, length, kind, urn = line.decode().split("\t")
        alone = gzip.decompress(whole[int(offset) : int(offset) + int(length)])
        assert kind == "response"
        assert urn in alone.decode()
        got.append(alone)
        assert warc.read_record(warc.read_member(io.BytesIO(whole), int(offset), int(length)))[1] == int(urn[10:-1])
    assert b"".join(got) == b"".join(parts)


def test_broken_streams_are_errors():
    rows = b"".join(records(5))
    for bad in (gzip.compress(rows[:-30]), gzip.compress(rows + b"WARC/1.1\r\nhalf")):
        with pytest.raises(ValueError, match="ends within"):
            warc.normalise_stream(io.BytesIO(bad), lambda _: None, lambda _: None)
    head = warc.record_head(1, "u", hashlib.sha1(b"other").hexdigest(), 4, None) + b"text\r\n\r\n"
    with pytest.raises(ValueError, match="digest"):
        warc.read_record(iter([head]))


def test_each_file_has_a_task(spark):
    df = spark.createDataFrame([(k, f"http://x/{k}", f"{k}" * 400) for k in range(60)], "page_id long, url string, html string")
    folder = shared_folder(spark)
    made = materialise(warc.write_archives(warc.with_revisits(df).coalesce(1), f"{folder}/whole", archive_bytes=4000), f"{folder}/manifest")
    files = made.count()
    assert files >= 8
    tasks = warc._file_a_task(made, "path").withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in tasks}) == len(tasks) == files
    apart = materialise(warc.normalise_archives(made, f"{folder}/members"), f"{folder}/apart")
    assert apart.count() == files
    rows = warc.read_archives(apart).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in rows}) == files
    assert sorted(r.page_id for r in rows) == list(range(60))

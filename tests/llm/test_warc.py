import pytest
from latticelu.llm import warc
from latticelu.llm.common import new_path
from latticelu.llm.queries import op7_warc
from pyspark.sql import functions as F

SCHEMA = "page_id bigint, url string, html string"


def expected(rows, least=0):
    """(page, digest, bytes, kind, refers) of every row, sorted."""
    out, taken = [], set()
    for page, _, html in rows:
        payload = (html or "").encode()
        first = min((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        again = page is not None and len(payload) >= least and (first != page or (page, payload) in taken)
        if page == first:
            taken.add((page, payload))
        out.append((page, warc.payload_digest(payload), len(payload), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def got(df):
    return sorted([(r.page, r.payload_digest, r.payload_bytes, r.response.kind, r.refers_page) for r in df.collect()], key=repr)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    found = [(r.page_id, r.payload_digest, r.payload_bytes, r.record_type, r.refers_to) for r in op7_warc(spark, sf_dir).collect()]
    assert sorted(found, key=repr) == expected(rows)


@pytest.mark.parametrize("least", [0, 3])
def test_payloads_that_look_like_records(spark, least):
    evil = "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n\r\nWARC/1.1"
    rows = [(1, "http://a/%0A\n x", evil), (2, None, None), (3, "u", ""), (4, "v", "\r\n"), (5, "w", "\r\n"), (6, "é", evil), (None, "n", "\r\n"), (7, "z", "x" * 200_000), (7, "z", "other"), (8, "k", "other")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("first", F.lit(1))
    assert got(warc.round_trip(df, min_revisit_bytes=least)) == expected(rows, least)


def test_payloads_and_requests_come_back_whole(spark):
    rows = [(k, f"http://h/{k}", "é\r\n" * k) for k in range(1, 30)]
    path = f"{new_path(spark, 'w')}/t"
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), path, archive_bytes=2000)
    back = warc.assemble(warc.read_records(spark, path)).collect()
    assert {(r.page, r.response.url, bytes(r.response.payload).decode()) for r in back} == set(rows)
    assert all(r.request.concurrent_to == r.response.id == r.metadata.concurrent_to == r.capture for r in back)


def test_records_without_partners(spark):
    records = [("response", "<a>", None, None), ("request", "<b>", "<x>", None), ("metadata", "<c>", "<a>", None), ("revisit", "<d>", None, "<nowhere>")]
    df = spark.createDataFrame([(*r, *[None] * 6) for r in records], warc._RECORD)
    out = {r.capture: (r.request is None, r.response is None, r.metadata is None) for r in warc.assemble(df).collect()}
    assert out == {"<a>": (True, False, False), "<x>": (False, True, True), "<d>": (True, False, True)}
    assert {r.capture: r.payload_bytes for r in warc.resolve(warc.assemble(df)).collect()} == dict.fromkeys(out)


def test_no_row_is_lost_to_repeats_and_nulls(spark):
    rows = [(1, "u", "x"), (1, "u", "x"), (None, "a", "p"), (None, "b", "p"), (2, "c", "p"), (3, "c", "p")]
    found = got(warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert found == expected(rows) and len(found) == 6
    assert warc.round_trip(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


def test_digests_are_verified(spark):
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 9"))
    import gzip
    import os

    path = f"{new_path(spark, 'bad')}".removeprefix("file:")
    made = warc.build_record("response", [("WARC-Record-ID", "<a>"), ("WARC-Payload-Digest", "sha1:" + warc.payload_digest(b"other"))], b"HTTP/1.1 200 OK\r\n\r\npayload")
    os.makedirs(path, exist_ok=True)
    with gzip.open(f"{path}/x.gz", "wb") as f:
        f.write(made + b"\r\n\r\n")
    with pytest.raises(Exception, match="the payload's digest is"):
        warc.read_records(spark, path).collect()
    schema = warc._RECORD
    pair = [("response", "<a>", None, None, "u", None, 1, "X", "X", None), ("revisit", "<b>", None, "<a>", "u", None, None, None, "Y", None)]
    with pytest.raises(Exception, match="is not that of revisit"):
        warc.resolve(warc.assemble(spark.createDataFrame(pair, schema))).collect()


def test_large_pages_stream(spark):
    df = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.col("id").cast("string"), F.expr("repeat('0123456789abcdef', 320000)")).alias("html"))  # 5 MB each
    assert [(r[2], r[3]) for r in got(warc.round_trip(df.repartition(2)))] == [(len(str(k)) + 5_120_000, "response") for k in sorted(range(40), key=str)]

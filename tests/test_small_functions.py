import base64
import math
import struct
from datetime import UTC, datetime, timedelta, timezone

import pyarrow.parquet as pq
import pytest
from folioscope.functions.clock import parse_iso_time, timestamp_tag, utc_now
from folioscope.functions.vectors import pack_vector, unpack_vector
from folioscope.operators.ingest import process_records
from pyspark.sql import functions as F


def test_vectors_as_text(spark):
    vectors = [[1.0, -0.5, 0.1], [1e-310, -0.0, 1.7976931348623157e308, 5e-324], [math.pi], None, [k / 7 for k in range(300)]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "i int, v array<double>").withColumn("t", pack_vector(F.col("v")))
    rows = df.withColumn("w", unpack_vector(F.col("t"))).orderBy("i").collect()
    for r in rows:
        assert (r.t, r.w) == ((None, None) if r.v is None else (base64.b64encode(struct.pack(f">{len(r.v)}d", *r.v)).decode(), r.v))
    assert math.copysign(1, rows[1].w[1]) == -1
    for bad in ([], [1.0, float("nan")], [float("inf")], [1.0, None]):
        with pytest.raises(Exception, match="finite numbers"):
            spark.createDataFrame([(bad,)], "v array<double>").select(pack_vector(F.col("v"))).collect()
    for bad in ("", "AAAA"):
        with pytest.raises(Exception, match="no vector"):
            spark.createDataFrame([(bad,)], "t string").select(unpack_vector(F.col("t"))).collect()


def test_times(spark):
    at = datetime(2026, 3, 4, 23, 5, 6, 700_000, tzinfo=timezone(timedelta(hours=-2)))
    assert utc_now(at) == "2026-03-05T01:05:06Z" and timestamp_tag(at) == "20260305010506" and len(utc_now()) == 20
    df = spark.createDataFrame([(utc_now(at),), ("2026-03-05",), (None,)], "t string")
    got = [r[0] for r in df.select(F.unix_timestamp(parse_iso_time(F.col("t")))).collect()]
    assert got == [int(at.astimezone(UTC).timestamp()), None, None]


def test_a_processed_table_is_written_in_order(spark, tmp_path):
    rows = [(f"Title {k * 7 % 40:02}", f"A{k}", None if k % 5 == 0 else 2000 + k % 3) for k in range(160)]
    done = process_records(spark.createDataFrame(rows, "title string, authors string, year int").repartition(5))
    want = [(r.title_normalized, r.year) for r in done.ordered.collect()]
    assert want == sorted(want, key=lambda x: (x[0], x[1] is None, x[1] or 0)) and len(want) > 60
    done.write(str(tmp_path / "p"))
    files = sorted((tmp_path / "p").glob("*.parquet"))
    got = [(r["title_normalized"], r["year"]) for f in files for r in pq.read_table(f, columns=["title_normalized", "year"]).to_pylist()]
    assert got == want

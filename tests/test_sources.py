import pytest
from pyspark.sql import functions as F

from millrace.sources.tables import read, streamed, table, write
from millrace.streaming.windows import counts, drained


@pytest.mark.parametrize("form", ["parquet", "orc", "json", "csv", "xml"])
def test_round_trip(spark, tmp_path, form):
    options = {"xml": {"rowTag": "row"}, "csv": {"header": "true"}}.get(form, {})
    df = spark.createDataFrame([(1, "a"), (2, "b, c")], "n int, s string")
    write(df, str(tmp_path / form), form, **options)
    assert sorted(map(tuple, read(spark, str(tmp_path / form), form, "n int, s string", **options).collect())) == [(1, "a"), (2, "b, c")]


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError, match="none of"):
        write(spark.range(1), str(tmp_path / "x"), "tar")


def test_stream_counts_like_the_batch(spark, sf_dir, tmp_path):
    events = streamed(spark, sf_dir, "events")
    out, saved = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for _ in range(2):  # a restart adds nothing twice
        drained(counts(events, "ts", "event_type", "1 hour", "1 hour"), out, saved)
    rows = spark.read.parquet(out).collect()
    got = {(r.start, r.event_type): r.n for r in rows}
    assert len(got) == len(rows) > 0
    batch = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour")["start"].alias("start"), "event_type").count()
    want = {(r.start, r.event_type): r["count"] for r in batch.collect()}
    assert all(want[k] == n for k, n in got.items())

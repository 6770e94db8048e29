import datetime

from quern.streaming.debounce import debounce_stream


def test_debounce_over_a_stream(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    at = lambda s: base + datetime.timedelta(seconds=s)
    parts = [[(1, 1, at(0)), (1, 2, at(0.4)), (1, 2, at(0.4)), (2, 3, at(0))], [(1, 4, at(60))], [(9, 5, at(3600))], [(9, 6, at(7200))]]
    schema = "page long, event_id long, ts timestamp"
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = debounce_stream(stream, 1000, 3000, "1 second")
    run = out.writeStream.format("memory").queryName("batches").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    got = {(r.page, r.batch, r.events, r.newest_event) for r in spark.sql("SELECT * FROM batches").collect()}
    assert {(1, 0, 2, 2), (1, 1, 1, 4), (2, 0, 1, 3)} <= got

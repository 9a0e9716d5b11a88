import datetime as dt

from tracewell.streaming import operators as S


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2026, 9, 8, 10)
    rows = [("A", "B", 100.0, t0 + dt.timedelta(seconds=s)) for s in (0, 20)] + [("A", "C", 100.0, t0 + dt.timedelta(minutes=m)) for m in (1, 2, 3, 200)]
    spark.createDataFrame(rows, "src string, dst string, amount double, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src string, dst string, amount double, ts timestamp").parquet(str(tmp_path / "in"))
    for name, df, want in (("once", S.deduplicate(stream), 2), ("burst", S.bursts(stream, "src", slide="60 minutes"), 1), ("visits", S.sessions(stream, "src"), 2)):
        mode = "append" if name == "once" else "complete" if name == "burst" else "complete"
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() == want, name

import pandas as pd

from ledgerloom.streaming import ledger_stream as S


def test_leases_time_out(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    stream = spark.readStream.schema("job bigint, ts timestamp").parquet(str(src))
    query = S.leases(stream, 1, 60_000).writeStream.outputMode("append").format("parquet").option("checkpointLocation", out + "-c").start(out)
    try:
        for k, rows in enumerate([[(1, "2024-01-01 00:00"), (2, "2024-01-01 00:00")], [(2, "2024-01-01 00:30")], [(2, "2024-01-01 01:30")]]):
            frame = pd.DataFrame(rows, columns=["job", "ts"])
            spark.createDataFrame(frame.assign(ts=pd.to_datetime(frame.ts)), "job bigint, ts timestamp").coalesce(1).write.parquet(str(src / f".new{k}"))
            for f in (src / f".new{k}").glob("*.parquet"):
                f.rename(src / f"{k}.parquet")
            query.processAllAvailable()
    finally:
        query.stop()
    got = {(r.job, r.state) for r in spark.read.parquet(out).collect()}
    assert (1, "failed") in got and (2, "running") in got and (1, "running") in got

from __future__ import annotations

import os
from datetime import datetime

from polyomics.streaming import ingest


def test_append(spark, tmp_path):
    folder = {k: str(tmp_path / k) for k in ("in", "store", "cp", "cp2")}
    day = lambda d: datetime(2020, 1, d)
    first = [("t", 1, "b1", 1.0, day(1)), ("t", 1, "b1", 2.0, day(2)), ("p", 1, "b1", 5.0, day(1))]
    spark.createDataFrame(first, ingest.SCHEMA).write.mode("append").parquet(folder["in"])
    ingest.append(spark, folder["in"], folder["store"], folder["cp"]).awaitTermination()
    assert ingest.stored(spark, folder["store"]).count() == 2
    late = [("t", 1, "b1", 9.0, day(1)), ("t", 2, "b1", 3.0, day(3))]
    spark.createDataFrame(late, ingest.SCHEMA).write.mode("append").parquet(folder["in"])
    ingest.append(spark, folder["in"], folder["store"], folder["cp"]).awaitTermination()
    got = {(r["layer"], r["profile_id"]): r["value"] for r in ingest.stored(spark, folder["store"]).collect()}
    assert got == {("t", 1): 2.0, ("p", 1): 5.0, ("t", 2): 3.0}
    q = ingest.layer_counts(spark, folder["in"]).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", folder["cp2"]).start()
    q.processAllAvailable()
    q.stop()
    assert sum(r["cells"] for r in spark.table("counts").collect()) == 5


def test_written_folders_are_discarded(spark):
    from polyomics import session

    df = session.materialize(spark.range(5), "five")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 5 and os.path.isdir(path)
    session.discard(spark)
    assert not os.path.exists(path) and not session._written

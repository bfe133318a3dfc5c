import numpy as np
import pytest
from pyspark.sql import functions as F

from mentionflow.streaming import strategies

SCHEMA = "seq long, block string, embedding array<double>"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Three files of two streams, one micro-batch each; a null vector and a null block among them."""
    folder = tmp_path_factory.mktemp("arrivals")
    x = np.random.default_rng(7).normal(size=(45, 3))
    rows = [(i, None if i % 11 == 0 else "ab"[i % 2], v.tolist()) for i, v in enumerate(x)]
    rows[20] = (20, "a", None)
    for k in range(3):
        spark.createDataFrame(rows[15 * k : 15 * (k + 1)], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder), spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted(((r["block"] or "", r["seq"], r["link_to"], r["cluster_id"]) for r in df.collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("strategy", strategies.STRATEGIES)
def test_stream_equals_batch(spark, files, tmp_path, strategy):
    folder, rows = files
    arrivals = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    linked = strategies.link_stream(arrivals, strategy, 0.5, 4)
    query = linked.writeStream.format("memory").queryName(f"linked_{strategy}").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    batches = sum(p["numInputRows"] > 0 for p in query.recentProgress)
    assert batches == 3
    want = rows_of(strategies.link(rows, strategy, 0.5, 4, block="block"))
    assert rows_of(spark.table(f"linked_{strategy}")) == want
    assert len(want) == rows.filter(F.col("embedding").isNotNull()).count()

"""A fitted model is plain tables: scoring a stream is the stream-static join of predict."""

from twinfold.operators.predict import predict
from twinfold.plans.catalog import lcg_factors, x1
from twinfold.sources import tpch
from twinfold.spec import Tensor


def test_predict_on_a_stream_matches_batch(spark, sf, scratch):
    t = x1(spark, sf)
    cells = tpch.split(t.entries)[1]  # the held-out cells arrive as a stream
    cells.write.mode("overwrite").parquet(f"{scratch}/cells")
    f = lcg_factors(spark, t, 0, 3)
    batch = predict(spark, Tensor(spark.read.parquet(f"{scratch}/cells"), t.dims), f, 3)
    stream_in = spark.readStream.schema(cells.schema).parquet(f"{scratch}/cells")
    scored = predict(spark, Tensor(stream_in, t.dims), f, 3)
    q = scored.writeStream.format("memory").queryName("scored_cells").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.sql("SELECT * FROM scored_cells")
    assert got.count() == batch.count() == cells.count()
    assert got.exceptAll(batch).count() == 0

import os

from moodgrid.streaming import ingest as ST


def test_stream_surface_features_memory_sink(spark, scratch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    src = os.path.join(scratch, "in")
    docs.repartition(3).write.parquet(src)
    s = ST.stream_surface_features(ST.read_documents_stream(spark, src))
    q = (s.writeStream.format("memory").queryName("surface_stream")
         .option("checkpointLocation", os.path.join(scratch, "ckpt")).outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    out = spark.sql("SELECT * FROM surface_stream")
    assert out.count() == docs.count()
    assert "n_tokens" in out.columns

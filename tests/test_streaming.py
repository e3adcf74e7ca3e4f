from rasterloom.operators import pixels as px, prompts
from rasterloom.session import new_folder


def drained(spark, stream, name):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", new_folder(spark, name)).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_stateless_operators_run_on_streams(spark, gray):
    folder = new_folder(spark, "arriving")
    batch = gray({0: [[0, 100, 255]]})
    batch.write.parquet(folder)
    stream = spark.readStream.schema(batch.schema).parquet(folder)
    out = drained(spark, px.threshold(px.negative(stream), 100), "thresholded")
    assert sorted((r.x, r.v) for r in out.collect()) == [(0, 255), (1, 255), (2, 0)]


def test_prompts_run_on_streams(spark):
    folder = new_folder(spark, "asked")
    asked = spark.createDataFrame([("Load Centaurus",), ("kmeans",)], "prompt STRING")
    asked.write.parquet(folder)
    out = drained(spark, prompts.routed(spark.readStream.schema(asked.schema).parquet(folder)), "routed")
    assert {r.intent for r in out.collect()} == {"fetch_satellite", "process_image"}

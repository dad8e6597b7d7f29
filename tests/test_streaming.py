import math

from pyspark.sql import functions as F

from arcloom.operators import normalise, paths
from arcloom.streaming.lattices import SCHEMA, label_rates, read_stream


def rows(spark):
    w = -math.log(0.5)
    arcs = [(1, 0, 0, 1, 5, w, None), (1, 0, 1, 1, 6, w, None)]
    return spark.createDataFrame([(i, 0, [math.inf, 0.0], arcs) for i in range(6)], SCHEMA)


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_operators_apply_to_streams(spark, tmp_path):
    rows(spark).repartition(3).write.parquet(str(tmp_path / "in"))
    made = normalise.normalize(read_stream(spark, str(tmp_path / "in"), 1))
    best = paths.shortest_path(made)
    got = drain(best, "best_paths")
    assert got.count() == 6 and {tuple(r.hyp) for r in got.collect()} == {(5,)}


def test_label_rates(spark, tmp_path):
    stamped = rows(spark).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("lattice_id") * 300))
    stamped.write.parquet(str(tmp_path / "in"))
    rates = label_rates(read_stream(spark, str(tmp_path / "in"), more="at timestamp"), "at")
    got = drain(rates, "rates", "complete")
    assert abs(got.agg(F.sum("expected")).first()[0] - 6) < 1e-9

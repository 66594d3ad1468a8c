"""Streams: incremental scans and late data."""

from tessera.streaming.incremental import scan_incrementally


def test_new_rows_only(spark, tmp_path):
    source, target, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    schema = "id long, v string"

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        scan_incrementally(spark.readStream.schema(schema).parquet(source), "id", target, offsets).awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(target).collect())

    assert run([(1, "a"), (1, "a"), (2, "b")]) == [1, 2]
    assert run([(2, "x"), (3, "c")]) == [1, 2, 3]
    assert run([(3, "y")]) == [1, 2, 3]

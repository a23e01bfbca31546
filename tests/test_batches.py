"""Streams of the queries take every row, written by all tasks."""

from pyspark.sql import functions as F

from chalkline.plans import queries as Q


def test_every_row_arrives_once_and_batches_are_written_in_parallel(spark, tmp_path):
    ids = [*range(-20, 20), None]
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(4)
    third = Q._thirds(F.col("id"))
    for name, batches in {"thirds": [third == 0, third == 2, third == 1], "ranges": Q._ranges(F.col("id"), [-5, 7])}.items():
        got = []

        def start(stream):
            def put(batch, batch_id):
                files = batch.select(F.input_file_name()).distinct().count()
                got.append((batch_id, files, [r.id for r in batch.collect()]))

            sink = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"file://{tmp_path}/{name}")
            return sink.trigger(availableNow=True).start()

        Q._run_batches([(df, batches)], start, name)
        assert [b for b, _, _ in got] == [0, 1, 2]
        assert all(files > 1 for _, files, _ in got)
        assert sorted((i for _, _, part in got for i in part), key=repr) == sorted(ids, key=repr)
    none = Q._ranges(F.col("id"), [None, None])
    assert [df.where(c).count() for c in none] == [41, 0, 0]

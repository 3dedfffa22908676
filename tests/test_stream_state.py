"""State of ordered rules over a stream goes once it can't change a verdict; until then it is carried between runs."""

from corvid.streaming import folds

SCHEMA = "key string, event_id long, at long, units long"


def test_state_is_forgotten_and_verdicts_stay(spark, tmp_path):
    step, hold = folds.replay_guard(10_000), 10_000
    drops = [
        [("a", 1, 1_000, 1), ("a", 2, 3_000, 1), ("b", 3, 4_000, 1), (None, 4, 4_500, 1)],
        [("a", 5, 10_999, 1), ("c", 6, 11_000, 1)],
        [("c", 7, 90_000, 1), ("b", 8, 90_001, 1)],
        [("a", 9, 95_000, 1), ("b", 10, 99_000, 1), ("a", 11, 96_000, 1), ("late", 12, 2_000, 1)],
    ]
    states = []
    for drop in drops:
        spark.createDataFrame(drop, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        out = folds.stream(source, step, hold, "1 second").writeStream.format("parquet").option("path", f"{tmp_path}/out")
        q = out.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        states.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted(map(tuple, spark.read.schema(folds.VERDICT).parquet(f"{tmp_path}/out").collect()), key=lambda r: r[1])
    on_time = spark.createDataFrame([r for d in drops for r in d if r[0] != "late"], SCHEMA)
    assert got == sorted(map(tuple, folds.batch(on_time, step).collect()), key=lambda r: r[1])
    assert [r[1] for r in got if r[2]] == [1, 3, 4, 6, 7, 8, 9]
    assert states[1] == 4 and states[2] == 2  # a and the null key are forgotten; b and c begin anew

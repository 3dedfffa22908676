"""Leases as a stream with timers: each expiry once, also over restarts and out of order, equal to the batch twin."""

import random

import pytest

from corvid.streaming import leases

SCHEMA = "id string, event_id long, at long, worker string, action string, lease_ms long"


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, leases.ROCKSDB)
    yield spark
    spark.conf.set(name, old)


def streamed(spark, root, drops, hold, late):
    for drop in drops:
        spark.createDataFrame(drop, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        out = leases.stream(spark.readStream.schema(SCHEMA).parquet(f"{root}/in"), hold, late).writeStream.format("parquet").option("path", f"{root}/out")
        q = out.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    return rows(spark.read.schema(leases.OUTCOME).parquet(f"{root}/out")), q


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rules(spark):
    events = [
        ("a", 1, 0, "crashed", "claim", 1_000), ("a", 2, 1_000, "other", "claim", 1_000), ("a", 3, 1_001, "other", "claim", 1_000),
        ("a", 4, 1_500, "crashed", "renew", 1_000), ("a", 5, 2_000, "other", "renew", 500), ("a", 6, 2_400, "other", "complete", None), ("a", 7, 2_500, "x", "claim", 9),
        ("b", 8, 0, "w", "claim", 10), ("b", 9, 50, "w", "renew", 10), ("b", 10, 60, "w", "renew", 0), ("b", 11, 60, None, "claim", 10), ("b", 12, 60, "w", "sing", 10),
        (None, 13, 0, "w", "claim", 1), ("c", 14, None, "w", "claim", 1), ("d", 15, 0, "w", "claim", 100_000), ("e", 16, 0, "w", "claim", 5), ("e", 17, 20_000, "v", "claim", 99_999),
    ]
    got = rows(leases.batch(spark.createDataFrame(events, SCHEMA), 30_000, 10_000))
    outcome = {r[1]: (r[4], r[5]) for r in got if r[1]}
    assert outcome == {
        1: ("claimed", 1), 2: ("refused", 1), 3: ("claimed", 2), 4: ("refused", 2), 5: ("renewed", 2), 6: ("completed", 2), 7: ("refused", 2),
        8: ("claimed", 1), 9: ("renewed", 1), 10: ("refused", 1), 11: ("refused", 1), 12: ("refused", 1), 15: ("claimed", 1), 16: ("claimed", 1), 17: ("claimed", 1),
    }
    assert sorted((r[0], r[2], r[3]) for r in got if r[4] == "expired") == [("a", 1_000, "crashed"), ("b", 10, "w"), ("b", 60, "w"), ("e", 5, "w")]
    assert rows(leases.batch(spark.createDataFrame([], SCHEMA), 1, 1)) == []


def test_timers_equal_the_batch_twin_out_of_order(rocksdb, tmp_path):
    rng = random.Random(5)
    events = [(f"j{rng.randrange(6)}", i, i * 100 + 7, f"w{rng.randrange(2)}", rng.choice(["claim", "claim", "renew", "complete"]), rng.choice([150, 900, None])) for i in range(300)]
    order = sorted(events, key=lambda e: e[2] + rng.randrange(0, 900))  # at most 0.9 s late
    late = ("j0", 999, 8, "w0", "claim", 100)
    got, q = streamed(rocksdb, tmp_path, [order[:100], order[100:200], [*order[200:], late]], 2_000, "1 second")
    until = events[-1][2] - 1_000
    assert got == rows(leases.batch(rocksdb.createDataFrame(events, SCHEMA), until, 2_000))
    assert {r[4] for r in got} == {"claimed", "renewed", "completed", "refused", "expired"}
    assert sum(r[4] == "expired" for r in got) > 5


def test_expiry_without_another_event_and_state_that_goes(rocksdb, tmp_path):
    drops = [[("a", 1, 1_000, "w", "claim", 500), ("b", 2, 1_100, "w", "claim", 60_000)], [("c", 3, 3_000, "w", "claim", 1)], [("c", 4, 30_000, "w", "claim", 1)]]
    got, q = streamed(rocksdb, tmp_path, drops, 5_000, "0 seconds")
    assert [(r[0], r[2]) for r in got if r[4] == "expired"] == [("a", 1_500), ("c", 3_001)]
    state = rocksdb.read.format("statestore").option("stateVarName", "lease").load(f"{tmp_path}/checkpoint").selectExpr("key.id", "value.ends").collect()
    assert sorted(map(tuple, state))[0] == ("b", 61_100) and "a" not in {r.id for r in state}

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corvid.llm import mixing


def highest(weights, blocks, seats):
    """Seats by plainly sorting all quotients."""
    offers = sorted((-w / (2 * k + 1), i, k) for i, w in enumerate(weights) for k in range(blocks[i]))
    return Counter(i for _, i, _ in offers[:seats])


def test_apportion_matches_sorted_quotients(spark):
    rng = random.Random(4)
    for n, top in ((7, 300), (40, 3)):
        targets = [float(rng.randrange(top)) for _ in range(n)]
        blocks = [rng.randrange(0, 30) for _ in range(n)]
        table = spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(zip(targets, blocks, strict=True))], "number long, target double, blocks long")
        for seats in (0, 1, sum(blocks) // 2, sum(blocks)):
            want = highest(targets, blocks, seats)
            for natural in (0.001, 77.0):
                got = {r.number: r.seats for r in mixing.apportion(table, seats, natural).collect()}
                assert {k: v for k, v in got.items() if v} == dict(want)


def test_apportion_sorts_the_last_quotients_alone(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", 3)
    targets = [10.0] * 20 + [3.0, 500.0]
    table = spark.createDataFrame([(i, t, 40) for i, t in enumerate(targets)], "number long, target double, blocks long")
    got = {r.number: r.seats for r in mixing.apportion(table, 47, 5.0).collect()}
    assert {k: v for k, v in got.items() if v} == dict(highest(targets, [40] * 22, 47))


def test_shard_quotas_match_sorted_quotients():
    rng = random.Random(6)
    for _ in range(400):
        shard, block, most = rng.choice([16, 32, 64]), 8, rng.choice([1, 2, 3])
        size = rng.randrange(1, 6 * shard)
        full, rest = divmod(size, shard)
        weights = [shard] * full + [rest] * (rest > 0)
        blocks = [-(-most * w // block) for w in weights]
        seats = rng.randrange(sum(blocks) + 1)
        want = highest(weights, blocks, seats)
        each, more, last = mixing.shard_quotas(seats, size, shard, block, most)
        got = [each + (t < more) for t in range(full)] + [last] * (rest > 0)
        assert got == [want[i] for i in range(len(weights))]


def test_chosen_blocks_go_pass_by_pass():
    for tokens, quota in ((100, 0), (100, 3), (100, 7), (100, 13), (100, 19), (64, 12), (5, 1)):
        begin, end = mixing.chosen(0, "s", 2, tokens, quota, 16, 3)
        assert (end - begin).sum() == min(16 * quota, 3 * tokens)
        held = [0] * (3 * tokens)
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            held[b:e] = [1] * (e - b)
        begun = [b // tokens for b in range(0, 3 * tokens, 16) if held[b]]
        assert sorted(begun) == sorted(b // tokens for b in range(0, 3 * tokens, 16))[: len(begun)]


@pytest.fixture(scope="module")
def uneven(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, i, i]), rng.choice(["a", "a", "a", "é", "z", "", None, f"rare{i % 7}"]), "w " * rng.choice([0, 1, 3, 40, 400])) for i in range(900)]
    return spark.createDataFrame([*rows, *[(None, "a", "x " * 50)] * 300, (7, "b", None)], "doc_id long, source string, text string")


def test_targets_and_taken_words(spark, uneven):
    out = mixing.mix(uneven, block=16, shard=256, seed=3).collect()
    assert len(out) == uneven.count()
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in out:
        size[r.source] += r.size
        target[r.source] = r.target
        taken[r.source] += r.taken
        assert r.taken == sum(s.end - s.begin for s in r.spans) <= 3 * r.size
        assert all(0 <= s.begin < s.end <= r.size for s in r.spans)
        times = Counter(i for s in r.spans for i in range(s.begin, s.end))
        assert max(times.values(), default=0) <= 3
    weight = dict(zip(sorted(size, key=lambda s: (s is None, s)), [5, 2, 1] * 9, strict=False))
    capped, total = set(), sum(size.values())
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        over = {s for s in size if s not in capped and weight[s] * level > 3 * size[s]}
        if not over:
            break
        capped |= over
    for s in size:
        assert target[s] == pytest.approx(3 * size[s] if s in capped else weight[s] * level)
        assert abs(taken[s] - target[s]) <= 32
    assert {r.source_size for r in out if r.source == "a"} == {size["a"]}


def test_reruns_agree_in_any_partitioning(uneven):
    rows = lambda df: sorted(map(repr, mixing.mix(df, shard=256).select("doc_id", "source", "size", "taken").collect()))
    assert rows(uneven) == rows(uneven.repartition(7)) == rows(uneven.orderBy(F.rand(1)))


def test_odd_rows(odd, empty):
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0
    none = mixing.mix(odd.withColumn("text", F.lit(None).cast("string")))
    assert {(r.size, r.taken, r.target) for r in none.collect()} == {(0, 0, 0.0)}
    given = mixing.mix(odd, size=F.lit(10), share=3.0)
    assert {r.taken for r in given.collect()} == {30}
    with pytest.raises(ValueError):
        mixing.mix(odd, share=4)

"""Mixing: every row once, shares within a block at every slot, positions gapless."""

from collections import Counter

import pytest

from tagtrack.llm import mixing as M


@pytest.mark.parametrize("share", [{"a": 1}, {"a": 1, "b": 1}, {"a": 500, "b": 499, "c": 1}, {"a": 333, **{f"s{i}": 7 for i in range(23)}, "z": 506}])
def test_schedule_keeps_every_share(share):
    period, slots = sum(share.values()), M.schedule(share)
    assert sorted(x for v in slots.values() for x in v) == list(range(period))
    for s, q in share.items():
        assert len(slots[s]) == q
        done = 0
        for t in range(period):
            done += t in set(slots[s]) if q < 20 else 0
            if q < 20:
                assert abs(done - (t + 1) * q / period) < 1
        for k, t in enumerate(slots[s], 1):
            assert (k - 1) * period // q <= t < -(-k * period // q)


def test_shares_are_whole_and_near():
    got = M.shares({"a": 0.7, "b": 0.2999, "c": 0.0001}, 1000)
    assert sum(got.values()) == 1000 and got["c"] == 1 and abs(got["a"] - 700) <= 2


def test_hot_source_in_buckets(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 4}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"hot": 0.5, "s0": 0.2, "s1": 0.1, "s2": 0.1, "s3": 0.1}
    got = sorted(M.mixed(df, weights, block_rows=4, bucket_rows=100).collect(), key=lambda r: r.position)
    assert sorted((r.doc_id, r.source) for r in got) == sorted(rows)
    assert [r.position for r in got] == list(range(3000))
    assert all(a.slot <= b.slot for a, b in zip(got, got[1:]))
    assert max(Counter(r.slot for r in got).values()) <= 4
    assert len({(r.slot, r.source) for r in got}) == len({r.slot for r in got})
    seen, share = Counter(), M.shares({f"={k}": v for k, v in weights.items()}, 1000)
    first_out = min(max(r.slot for r in got if r.source == s) for s in weights)
    for slot, source in sorted({(r.slot, r.source) for r in got}):
        if slot <= first_out:
            seen[source] += 1
            for s in weights:
                assert abs(seen[s] - (slot + 1) * share[f"={s}"] / 1000) < 1


def test_repeatable_and_shuffled(spark):
    df = spark.createDataFrame([(i, "a") for i in range(300)], "doc_id long, source string")
    order = lambda: [r.doc_id for r in sorted(M.mixed(df).collect(), key=lambda r: r.position)]
    a = order()
    assert a == order() and a != sorted(a)


def test_nulls_repeats_clashes_and_empty(spark):
    rows = [(None, None, 1, "k")] * 5 + [(1, "-", 1, "k"), (2, "", 2, None), (2, "", 2, None), (3, "x", None, "q")]
    df = spark.createDataFrame(rows, "doc_id long, source string, n int, _key string").withColumnRenamed("n", "start")
    got = M.mixed(df, {"x": 1.0, None: 3.0, "gone": 1.0})
    assert got.columns == ["doc_id", "source", "start", "_key", "block", "slot", "position"]
    assert Counter(tuple(r)[:4] for r in got.collect()) == Counter(rows)
    assert sorted(r.position for r in got.collect()) == list(range(len(rows)))
    assert M.mixed(df.limit(0)).count() == 0
    assert M.in_order(df).columns == df.columns


@pytest.mark.parametrize("weights", [{"a": 0.98, "b": 0.01, "c": 0.01}, {"a": 0.9996, "b": 0.0004}, {"a": 1 / 3, "b": 1 / 7, "c": 11 / 21}])
def test_shares_follow_the_target_weights_over_many_blocks(weights):
    share = M.shares(weights, M.PERIOD)
    slots = M.schedule(share, {s: int(w * 50_000) + 1 for s, w in weights.items()})
    for s, w in weights.items():
        for k, t in enumerate(slots[s]):  # k blocks before slot t, one more after it
            assert abs(k - w * t) < 1 + 1e-6 and abs(k + 1 - w * (t + 1)) < 1 + 1e-6


def test_target_weights_reach_the_rows(spark):
    weights = {"a": 0.98, "b": 0.01, "c": 0.01}
    df = spark.range(100_000).selectExpr("id", "case when id < 98000 then 'a' when id < 99000 then 'b' else 'c' end as source")
    seen = Counter()
    rows = M.mixed(df, weights, block_rows=4).select("slot", "source").distinct().collect()
    for slot, source in sorted((r.slot, r.source) for r in rows):
        seen[source] += 1
        assert all(abs(seen[s] - w * (slot + 1)) < 1 + 1e-6 for s, w in weights.items())
    assert seen == {"a": 24_500, "b": 250, "c": 250}


def test_rows_move_twice_on_their_way_into_order(spark):
    """Dealt by bucket and sorted by position; what joins them is small and comes to them."""
    df = spark.range(5000).selectExpr("id", "concat('text', id) as text", "if(id % 3 = 0, 'a', 'b') as source")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = M.in_order(df)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    nodes = [n.split("\n") for n in plan.split("\n\n")]
    assert sum(n[0].endswith(") Exchange") and "text#" in n[1] for n in nodes if len(n) > 1) == 2

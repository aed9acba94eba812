"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline as P
from tagtrack.llm.common import saved

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import sys

    sys.path.insert(0, __file__.rsplit("/", 1)[0])
    from test_llm_decontaminate import brute as contaminated
    from test_llm_neardup import brute as grouped

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    kept = {}
    for name, stage in P.STAGES:
        docs = saved(stage(spark, docs, SF), "stage")
        rows = docs.collect()
        kept[name] = {r.doc_id: r for r in rows}
        assert len(kept[name]) == len(rows)
        if name != "sharding":
            assert docs.columns == columns
        for r in rows:
            assert r.text == before[r.doc_id].text
    names = [n for n, _ in P.STAGES]
    assert [n.split()[0] for n in names] == ["quality", "near", "benchmark", "mixing", "sharding"]
    groups = grouped([(i, r.text) for i, r in kept[names[0]].items()], 5)
    assert set(kept[names[1]]) == {g[0] for g in groups if g[3]}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {c[0] for c in contaminated([(i, r.text) for i, r in kept[names[1]].items()], items) if c[-1]}
    assert bad and set(kept[names[2]]) == set(kept[names[1]]) - bad
    assert set(kept[names[3]]) == set(kept[names[4]]) == set(kept[names[2]])
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    clean = [r.doc_id for r in labels if r.quality == 1]
    junk = [r.doc_id for r in labels if r.quality == 0]
    assert sum(i in kept[names[0]] for i in clean) / len(clean) > 0.95
    assert sum(i in kept[names[0]] for i in junk) / len(junk) < 0.2


def test_run(spark):
    got = P.run(spark, SF)
    assert {"doc_id", "text", "shard", "slot"} <= set(got.columns)
    assert got.count() > 0


def test_shards_hold_the_sources_at_their_weights(spark):
    from collections import Counter

    from tagtrack.llm import mixing

    sizes = {"a": 9000, "b": 2400, "c": 600}
    docs = spark.createDataFrame([(i, s, f"text {s} {i}") for s, n in sizes.items() for i in range(n)], "doc_id long, source string, text string")
    mixed = saved(P.mix(spark, docs.repartition(7), SF), "mixed")
    rows = [(r.shard, r.slot, r.source, r.doc_id) for r in P.shard(spark, mixed, SF).collect()]
    assert Counter(r[2] for r in rows) == sizes and len(set(rows)) == len(rows) == 12_000
    weight = mixing.tempered(sizes)
    total = sum(weight.values())
    first_out = min(n * total / weight[s] for s, n in sizes.items())  # rows until a source has no more
    full = [s for s in range(P.SHARDS) if (s + 1) * 500 <= first_out - 16]
    assert len(full) > 5
    for s in full:
        inside = sorted(r[1:] for r in rows if r[0] == s)
        assert [r[0] for r in inside] == list(range(500))
        have = Counter(r[1] for r in inside)
        for x in sizes:
            assert abs(have[x] - 500 * weight[x] / total) <= 2 * mixing.BLOCK_ROWS
        ids = [r[2] for r in inside if r[1] == "a"]
        assert ids != sorted(ids)
    order = lambda: [(r.shard, r.slot, r.doc_id) for r in P.shard(spark, mixed, SF).orderBy("shard", "slot").collect()]
    assert order() == order()

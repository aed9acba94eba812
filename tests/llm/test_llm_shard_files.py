"""The query shards whole documents: its figures are read from the shards it wrote."""

import zlib

from pyspark.sql import functions as F

from tagtrack.llm import sharding
from tagtrack.llm.queries import QUERIES


def test_shards_hold_the_documents(spark, tmp_path, monkeypatch):
    texts = [None, "", "é", "same"] * 20 + [f"text {i}" for i in range(40)]
    rows = [(i, t, "web") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    paths, write = [], sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda placed, path: paths.append(path) or write(placed, path))
    got = {r.doc_id: r for r in QUERIES["op6_sharding"](spark, str(tmp_path)).collect()}
    kept = spark.read.parquet(*paths).withColumn("file", F.input_file_name()).collect()
    assert sorted((r.doc_id, r.text or "", r.source) for r in kept) == sorted((i, t or "", s) for i, t, s in rows)
    for r in kept:
        q, text = got[r.doc_id], (r.text or "").encode()
        assert f"/shard={r.shard}/" in r.file and (q.shard, q.slot) == (r.shard, r.slot)
        assert (q["size"], q.text_crc32) == (len(text) + 8, zlib.crc32(text))

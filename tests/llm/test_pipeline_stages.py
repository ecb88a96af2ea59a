"""The corpus pipeline: its stages one by one, and whole."""

from collections import Counter

import corpus_pipeline as cp
from claimloom.llm import decontam, langid, mix, shard, simhash


def test_stages_chain(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench = [(1, rows[0][1] + " and some words that make this long enough")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "decontaminate", "mix_sources", "shards"]
    now, kept = docs, []
    for name, f in cp.STAGES[:-1]:
        now = f(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        kept.append(Counter(r["doc_id"] for r in now.collect()))
    for a, b in zip(kept, kept[1:]):
        assert set(b) <= set(a)
    assert max(kept[1].values()) == 1 and 60 not in kept[1]
    out = cp.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "shard"]
    assert Counter(r["doc_id"] for r in out.collect()) == kept[-1]
    for m in (decontam, langid, mix, shard, simhash):
        assert m.__doc__


def test_empty(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0

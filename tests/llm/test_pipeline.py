"""The pipeline's stages on the fixture, each against what its predecessor kept."""

from collections import Counter

import corpus_pipeline
from lodequery.llm import bpe, toxicity

from .test_operators import LOWER, brute_simhash, closure, words


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        assert name == "bpe" or docs.columns == columns
        assert name in ("mixing", "bpe") or {r.doc_id for r in kept[name]} <= {r.doc_id for r in before.collect()}
    whole, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = toxicity.judge(whole, toxicity.fit(whole, labels)).filter("not flagged").collect()
    assert {r.doc_id for r in kept["toxicity"]} == {r.doc_id for r in judged} and len(judged) > 0.85 * whole.count()
    last = {}
    for r in kept["toxicity"]:
        key = (r.text or "").translate(LOWER)
        last[key] = max(last.get(key, r.doc_id), r.doc_id)
    assert {r.doc_id for r in kept["exact_dedup"]} == set(last.values())
    prints = {r.doc_id: brute_simhash(r.text) for r in kept["exact_dedup"]}
    label, least = closure(set(prints.values())), {}
    for i, p in prints.items():
        least[label[p]] = min(least.get(label[p], i), i)
    assert {r.doc_id for r in kept["simhash"]} == set(least.values())
    sizes, mixed = Counter(), Counter()
    for r in kept["simhash"]:
        sizes[r.source] += len(words(r.text))
    for r in kept["mixing"]:
        mixed[r.source] += len(words(r.text))
    assert sum(mixed.values()) == round(1.5 * sum(sizes.values())) or abs(sum(mixed.values()) - 1.5 * sum(sizes.values())) <= len(sizes)
    assert all(mixed[s] <= 2 * sizes[s] for s in sizes)
    model = bpe.Speculator(bpe.default_path())
    want = Counter((r.doc_id, ids) for r, (ids, _) in zip(kept["mixing"], model.encode_batch([r.text or "" for r in kept["mixing"]])))
    assert Counter((r.doc_id, " ".join(map(str, r.ids))) for r in kept["bpe"]) == want


def test_nulls_repeats_and_nothing(spark, tmp_path, rows):
    """Null ids, texts and sources, repeated rows and odd texts go through all stages; an empty table comes out empty."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    marks = spark.createDataFrame([(1, 1, 0), (None, None, None), (9, 0, 0), (9, 0, 0)], "doc_id bigint, quality int, toxic int")
    for name, given in (("some", [r[:5] for r in rows]), ("none", [])):
        folder = f"{tmp_path}/{name}"
        marks.write.parquet(f"{folder}/labels.parquet")
        docs = spark.createDataFrame(given, schema)
        for stage, function in corpus_pipeline.STAGES:
            function(spark, docs, folder).write.parquet(f"{folder}/{stage}")
            docs = spark.read.parquet(f"{folder}/{stage}")
            assert stage == "bpe" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            if stage == "exact_dedup":
                lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
                assert docs.count() == len({(r[1] or "").translate(lower) for r in given})
        assert (docs.count() > 0) == bool(given)

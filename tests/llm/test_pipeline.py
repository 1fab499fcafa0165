"""The pipeline's stages against brute force on a small corpus, and on empty and odd ones."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphmill.llm import pieces, privacy, rules
from glyphmill.llm.common import clear_scratch

from .test_operators import brute_components, brute_rules, odd_texts, prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    items = [prose(rng, 25) for _ in range(4)]
    good = [prose(rng, rng.randrange(30, 200)) + f" mail a{k}.b@mail.example.com." for k in range(80)]
    near = []
    for t in good[:10]:
        w = t.split(" ")
        w[len(w) // 2] = "edited"
        near.append(" ".join(w))
    leaks = [f"{prose(rng, 20)} {i} {prose(rng, 20)}" for i in items]
    bad = [" ".join(w.upper() + "!!!" for w in prose(rng, 80).split(" ")) for _ in range(30)]
    texts = [*good, *near, good[0], *leaks, *bad, *odd_texts()]
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(k, 1, 0) for k in range(60)] + [(95 + k, 0, 0) for k in range(25)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(enumerate(texts))


def test_stages(spark, corpus):
    path, texts = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality rules", "minhash near-dedup", "benchmark decontamination", "personal data", "sentencepiece segmentations"]
    ids = lambda df: sorted(r.doc_id for r in df.collect())

    one = corpus_pipeline.quality_rules(spark, docs, path).persist()
    kept = ids(one)
    verdict = {r.doc_id: r.kept for r in rules.judge(docs, rules.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))).collect()}
    assert kept == sorted(d for d, ok in verdict.items() if ok)
    for d in kept:
        n, _, _, _, again = brute_rules(texts[d])
        assert n >= 10 and 100 * again <= 20 * n
    assert len([d for d in kept if d < 80]) >= 78 and not [d for d in kept if 95 <= d < 125]

    two = corpus_pipeline.minhash_near_dedup(spark, one, path).persist()
    assert ids(two) == [d for d, _, _, keep in brute_components([(d, texts[d]) for d in kept], 5, 80) if keep]

    three = corpus_pipeline.benchmark_decontamination(spark, two, path).persist()
    assert ids(three) == [d for d in ids(two) if not 91 <= d < 95]

    four = corpus_pipeline.personal_data(spark, three, path).persist()
    p = privacy.Permuter()
    assert {r.doc_id: (r.text, r.n_chars) for r in four.collect()} == {d: (t := privacy.replace_all(texts[d], p)[0], len(t)) for d in ids(three)}
    assert all(df.columns == docs.columns for df in (one, two, three, four))

    v = pieces.Vocabulary.load(pieces.default_model())
    said = {r.doc_id: r.text for r in four.collect()}
    five = corpus_pipeline.sentencepiece_segmentations(spark, four, path).collect()
    assert {r.doc_id for r in five} == set(said) and all(v.decode(r.ids) == said[r.doc_id] for r in five)

    whole = {(r.doc_id, r.sample): tuple(r.ids) for r in corpus_pipeline.run(spark, path).collect()}
    assert whole == {(r.doc_id, r.sample): tuple(r.ids) for r in five}
    clear_scratch(spark)


def test_empty_tables(spark, corpus):
    path, _ = corpus
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        assert out.count() == 0
        docs = docs if "ids" in out.columns else out


def test_null_ids_and_texts(spark, corpus):
    path, texts = corpus
    docs = spark.createDataFrame([(None, texts[0], None, None, None), (1, None, "en", "s", None), (None, texts[0], None, None, None)], COLUMNS).withColumn("more", F.lit(1))
    kept = corpus_pipeline.minhash_near_dedup(spark, docs, path)
    assert kept.count() == 3 and kept.columns == docs.columns
    assert corpus_pipeline.quality_rules(spark, docs, path).count() == 2
    for stage in (corpus_pipeline.benchmark_decontamination, corpus_pipeline.personal_data):
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "None", "None"]
    assert {r.doc_id for r in corpus_pipeline.sentencepiece_segmentations(spark, docs, path).collect()} == {None, 1}

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from auditmill.llm import mixing, toxicity

from tests.llm import helpers as h


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A corpus with toxic documents, shared lines, near copies and leaks, and some null rows."""
    random.seed(9)
    vocabulary = [f"t{i}" for i in range(900)]
    sentence = lambda n: " ".join(random.choices(vocabulary, k=n))
    items = [(i, sentence(25) + ". " + sentence(6) + ".") for i in range(5)]
    docs, labels = [], []
    for i in range(500):
        text = "\n".join(sentence(20) for _ in range(4))
        if i % 7 == 0:
            text = text.replace("t1", "grub grub", 4) + " grub slime you grub slime"
        if i % 11 == 1:
            text += "\nThis line stands in many documents"
        if i % 29 == 2:
            text += "\n" + items[i % 5][1]
        if i % 31 == 3 and i > 40:
            text = docs[i - 31][1] + " tail"
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(i % 7 == 0)))
    docs += [(900, None, None, None, None), (901, "", "en", "s0", 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {d[0]: d[1] for d in docs}, items


def test_pipeline_agrees_with_brute_force(spark, folder):
    path, texts, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{path}/labels.parquet")))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    kept = {i: t for i, t in texts.items() if scores[i] < 0.5}
    assert sum(i % 7 == 0 for i in kept) < 8 and sum(i % 7 != 0 for i in texts) - sum(i % 7 != 0 for i in kept) < 8
    kept = {i: v[2] for i, v in h.line_dedup(list(kept.items())).items()}
    near = h.near_components(list(kept.items()), 80)
    kept = {i: t for i, t in kept.items() if near[i] == i}
    leaked = {i for i, t in kept.items() for _, item in items if 5 * len(h.shingles(item) & h.shingles(t)) >= 4 * len(h.shingles(item))}
    assert leaked
    kept = {i: t for i, t in kept.items() if i not in leaked}
    sources = {r.doc_id: r.source for r in docs.collect()}
    plan = mixing.mix(spark.createDataFrame([(i, t, sources[i]) for i, t in kept.items()], "doc_id long, text string, source string"))
    want = sorted((r.doc_id, kept[r.doc_id], n) for r in plan.collect() for n in range(1, r.copies + 1))
    out = corpus_pipeline.run(spark, path)
    assert sorted((r.doc_id, r.text, r.copy_no) for r in out.collect()) == want
    assert [c for c in out.columns if c != "copy_no"] == docs.columns


def test_stages_keep_the_columns_of_documents(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns

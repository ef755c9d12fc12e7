"""The pipeline and the registered queries of this subpackage."""

import random

import pytest
from llm.brute import components, edits_within, families, frame, prose, removed

import corpus_pipeline
from tesselle.llm import decontamination, queries, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables with near copies, repeated passages, benchmark items and toxic texts."""
    rng, path = random.Random(11), str(tmp_path_factory.mktemp("tables"))
    items = [(i, prose(rng, 40)) for i in range(4)]
    rows = families(3, groups=4) + [(500 + i, f"{prose(rng, 20)} {t} {prose(rng, 9)}") for i, (_, t) in enumerate(items)]
    rows += [(600 + i, f"{prose(rng, 30)} vilgrub{'aeiou'[i % 5]} {prose(rng, 30)}") for i in range(60)] + [(700 + i, prose(rng, 60)) for i in range(120)]
    rows += [(900, None), (901, "")]
    frame(spark, rows).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(600 <= i < 700)) for i, _ in rows if i >= 600], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, items


def test_stages_against_brute_force(spark, folder):
    path, rows, items = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), dict(rows)
    (_, toxic), (_, near), (_, repeat), (_, leak), (_, pack) = corpus_pipeline.STAGES
    model = toxicity.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    assert len(bad & set(range(600, 660))) >= 57 and len(bad - set(range(600, 660))) <= 2
    kept = {d: t for d, t in kept.items() if d not in bad}
    for stage, step in ((toxic, lambda k: k), (near, _one_of_each), (repeat, _without_repeats), (leak, lambda k: _without_items(k, items))):
        docs = _written(spark, stage(spark, docs, path))
        kept = step(kept)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {r.doc_id: r.text for r in docs.collect()} == kept
    pieces = pack(spark, docs, path).collect()
    assert {r.doc_id for r in pieces} == set(kept)
    assert len(corpus_pipeline.run(spark, path).collect()) == len(pieces)


def _written(spark, df):
    from tesselle.llm.scratch import saved

    return saved(df, "test")


def _one_of_each(kept):
    rows = list(kept.items())
    return {d: t for (d, t), (_, c) in zip(rows, components(rows, 5, 80), strict=True) if c == d}


def _without_repeats(kept):
    raw, gone = removed(kept.values(), 200)
    return {d: None if t is None else bytes(x for x, y in zip(r, g, strict=True) if not y).decode(errors="ignore") for (d, t), r, g in zip(kept.items(), raw, gone, strict=True)}


def _without_items(kept, items):
    plain = [decontamination.plain(t) for _, t in items]
    return {d: t for d, t in kept.items() if not any(edits_within(p, decontamination.plain(t or "")) <= len(p) // 10 for p in plain)}


def test_every_number_has_a_query():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and set(queries.oracle_sql()) <= set(names)
    assert list(corpus_pipeline.queries()) == ["pipeline"] and len(corpus_pipeline.STAGES) == 5

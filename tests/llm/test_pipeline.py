"""The corpus pipeline stage by stage, each against what its predecessor kept."""

import re

import corpus_pipeline
import pytest

from tabwright.llm.common import written

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], FOLDER), name))
    return out


def test_columns_stay_until_the_last_stage(stages):
    assert all(d.columns == stages[0].columns for d in stages[1:-1])


def test_each_stage_takes_away_only_what_it_should(spark, stages):
    rows = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in stages[:-1]]
    documents, good, exact, near, cut = rows
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert sum(d in good for d, q in labels.items() if q == 1) >= 0.98 * sum(q == 1 for q in labels.values())
    lowered = {}
    for d, t in good.items():
        key = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        lowered[key] = max(d, lowered.get(key, d))
    assert set(exact) == set(lowered.values())
    assert set(near) <= set(exact) and len(near) >= 0.9 * len(exact)
    assert set(cut) <= set(near) and all(len(t) <= len(near[d]) for d, t in cut.items())
    seen, again = {}, 0
    for d, t in sorted(cut.items()):
        words = t.lower().split()
        for k in range(len(words) - 49):
            key = tuple(words[k : k + 50])
            again += seen.setdefault(key, d) != d
    before = {}
    repeats = 0
    for d, t in sorted(near.items()):
        words = t.lower().split()
        for k in range(len(words) - 49):
            repeats += before.setdefault(tuple(words[k : k + 50]), d) != d
    assert again <= 0.02 * repeats


def test_packing_holds_every_document(stages):
    kept, packed = stages[-2], stages[-1]
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in packed.collect()}


def test_rows_are_written_between_stages(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_quality_leaves_no_words_in_its_workers(spark):
    """The next stage runs no Python, so nothing else would free what idle workers hold."""
    from tabwright.llm import quality

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert written(quality.keep_good(docs), "good").count() > 0

    def held(batches):
        import sys

        for batch in batches:
            shelf = sys.modules.get("_tabwright_caches")
            yield batch.assign(held=int(getattr(shelf, "cache", None) is not None))

    assert spark.range(64).repartition(16).mapInPandas(held, "id long, held int").where("held = 1").count() == 0

"""The stages of the pipeline, each on what the one before kept."""

from collections import Counter

import corpus_pipeline as pipeline
from conftest import SF
from strandline.llm.common import table
from strandline.llm.decontaminate import contamination
from strandline.llm.mixing import mix
from strandline.llm.simhash import group_near_duplicates
from strandline.llm.toxicity import toxicity


def test_stages(spark):
    docs = table(spark, SF, "documents")
    kept = []
    frame = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == docs.columns, name
        kept.append(Counter(r.doc_id for r in out.collect()))
        frame = docs.where(docs.doc_id.isin(*kept[-1]))
    toxic = {r.doc_id for r in toxicity(docs, table(spark, SF, "labels")).where("_toxic.predicted = 1").collect()}
    clean = docs.where(~docs.doc_id.isin(*toxic))
    assert set(kept[0]) == {r.doc_id for r in clean.collect()}
    assert set(kept[1]) == {r._component for r in group_near_duplicates(clean).collect()} and max(kept[1].values()) == 1
    third = docs.where(docs.doc_id.isin(*kept[1]))
    hit = {r.doc_id for r in contamination(third, table(spark, SF, "benchmark")).where("_hit.contaminated").collect()}
    assert set(kept[2]) == set(kept[1]) - hit
    fourth = docs.where(docs.doc_id.isin(*kept[2]))
    assert kept[3] == Counter({r.doc_id: r._mix.copies for r in mix(fourth).collect() if r._mix.copies})


def test_near_duplicates_by_fingerprint_and_by_set(spark):
    """1 and 2 have one fingerprint but few shingles in common, 2 and 4 are similar: all three are one group."""
    tail = lambda w, n=30: " ".join(f"{w}{i}" for i in range(n))
    rows = [(1, "one two three four five " * 60 + tail("x")), (2, "one two three four five " * 60 + tail("y")), (3, tail("z")), (4, "one two three four five " + tail("y")), (None, tail("v"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in pipeline.drop_near_duplicates(spark, docs, SF).collect()) == [0, 1, 3]


def test_run_keeps_repeats(spark):
    out = pipeline.run(spark, SF).toPandas()
    assert len(out) > 0 and set(table(spark, SF, "documents").columns) < set(out.columns)
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))

"""Every stage on nulls in every column, very long texts, repeated rows and columns with names of the stages' own."""

from __future__ import annotations

import tracemalloc

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F
from test_operators import DOCS, own

from veilframe.llm import pieces
from veilframe.llm.common import BATCH_ROWS, small_batches, written

NAMES = ("n_words", "KEPT", "over_lines", "n_removed_words", "node", "label", "tiles", "component_id", "text_hash", "n_ip", "n_email", "size", "taken", "target", "range", "key", "rank", "score", "ids", "host", "line")


def test_stages_on_odd_rows(spark, small):
    long = " ".join(f"long{i} mail{i}@x.com" for i in range(40_000))
    texts = [(None, own(1)), (None, own(1)), (3, own(2)), (3, own(3)), (4, None), (5, ""), (6, long), (7, long), (8, "z" * 300_000 + " " + own(4)), (9, own(5))]
    rows = [(i, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else "s", None) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit(f"own {n}") for n in NAMES})
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        docs = written(out, name)
        assert all(docs.where(F.col(n) != f"own {n}").isEmpty() for n in NAMES), name
        seen[name] = sorted((r.doc_id or -1, len(r.text)) for r in docs.select("doc_id", "text").collect())
    assert [i for i, _ in seen["quality_rules"]] == [-1, -1, 3, 3, 6, 7, 8, 9]
    assert [i for i, _ in seen["near_duplicates"]] == [-1, 3, 3, 6, 8, 9]
    assert {i: n for i, n in seen["pii"] if i == 6} == {6: len(long)}
    assert "mail7@x.com" not in docs.where("doc_id = 6").first().text if docs.where("doc_id = 6").count() else True
    found = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert found.where("rank = 1").count() == docs.count() and found.where("not decoded_equal").isEmpty()


def test_the_last_stage_runs_with_small_batches(spark, small, monkeypatch):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    monkeypatch.setattr(corpus_pipeline.pieces, "encode_n_best", lambda docs, *a, **k: docs.mapInArrow(sizes, "n long"))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        with small_batches(spark):
            pass
        assert spark.conf.get(name, None) is None
        found = [r.n for r in corpus_pipeline.STAGES[-1][1](spark, spark.range(3000).coalesce(1), small).collect()]
        assert sum(found) == 3000 and max(found) <= BATCH_ROWS
        spark.conf.set(name, "700")  # a number that someone has set stays
        corpus_pipeline.STAGES[-1][1](spark, spark.range(1), small)
        assert spark.conf.get(name) == "700"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_parts_take_little_memory():
    model = pieces.Pieces.load(corpus_pipeline.MODEL)
    parts = [f"{pieces.SPACE}w{i}" for i in range(10_000, 30_000)]
    tracemalloc.start()
    try:
        model.learn([parts])
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(model.kept) == len(parts) and held < len(parts) * 130


def test_equal_parts_of_a_batch_are_one_string(monkeypatch):
    model, seen = pieces.Pieces.load(corpus_pipeline.MODEL), []
    learn = model.learn
    monkeypatch.setattr(model, "learn", lambda parts: (seen.extend(p for x in parts for p in x), learn(parts)))
    monkeypatch.setattr(pieces, "loaded", lambda path, n: (model, pieces.Speller(model)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3)), pa.array(["one two three two", "three two", None])], names=["doc_id", "__text"])
    rows = [r for b in pieces._encoded(corpus_pipeline.MODEL, 3, True, ["doc_id"])(iter([batch])) for r in b.to_pylist()]
    assert len(rows) == 7 and len(seen) == 6 and len({id(p) for p in seen}) == len(set(seen)) == 3

"""A worker of the pipeline's packing stage ends its task without its caches."""
from types import SimpleNamespace

import pyarrow as pa

import corpus_pipeline
from vigil.llm import packing


class Tasks:
    """Stands for the documents: gives the function that packs a task's batches."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *columns):
        return self

    def mapInArrow(self, fn, schema):
        return fn


def test_packing_can_leave_its_caches_empty(spark, monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": [f"alpha beta gamma{i}" for i in range(40)]})
    encoder = packing.encoder(packing.default_tokenizer())
    kept, found = {}, {}
    for name, pack in (("pipeline", lambda docs: corpus_pipeline.pack_sequences(spark, docs, "")), ("query", packing.pack)):
        found[name] = [x.to_pydict() for x in pack(Tasks(spark))(iter([batch]))]
        kept[name] = len(encoder.words) + len(encoder.parts)
    assert found["pipeline"] == found["query"]
    assert kept["pipeline"] == 0 < kept["query"]

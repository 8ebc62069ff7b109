"""Queries that are to cover whole tables and whole texts do."""

import os

import pytest

from vellum.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_every_turn_has_its_context(spark):
    found = registry.queries()["context_neighbors_every_turn"](spark, DIR)
    turns = spark.read.parquet(f"{DIR}/conversations.parquet").count()
    assert found.where("not is_context").count() == turns == found.select("conv_id", "target_seq").distinct().count()


def test_chunks_make_up_the_text(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect() if r.text}
    made = {}
    for r in sorted(registry.queries()["chunk_fixed_width_every_chunk"](spark, DIR).collect(), key=lambda r: (r.doc_id, r.chunk_no)):
        made[r.doc_id] = made.get(r.doc_id, "") + r.chunk
        assert len(made[r.doc_id]) == min(40 * (r.chunk_no + 1), len(texts[r.doc_id]))
    assert made == texts

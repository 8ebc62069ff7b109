"""Every stage, and all of them one after another, against brute force on rows with nulls, repeats, long texts and odd column names."""

import collections
import os
import random

import pytest

from test_operators import brute_components, brute_pieces, brute_suffixes, check_sequences, corpus

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a b` string, `c.d` long, `e``f` string, starts string, mix_row string"
BAD = ["awful", "horrid", "vile"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    plain = [(*r[:5], "x", r[0], "y", "s", "m") for r in corpus()]
    toxic = [(500 + i, " ".join(rng.choice(["one", "two", "three", "four", "five"]) for _ in range(30)) + " " + " ".join(rng.sample(BAD, 2)), "en", "t", 1, "x", 1, "y", "s", "m") for i in range(40)]
    return plain + toxic


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(where / "documents.parquet"))
    labels = [(r[0], 1, int(r[0] >= 500)) for r in rows if r[0] is not None] + [(None, 1, 1), (9999, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(where / "labels.parquet"))
    return str(where)


def bag(frame) -> collections.Counter:
    return collections.Counter(tuple(r) for r in frame.collect())


def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def brute_kept(rows) -> list[tuple]:
    return [r for r, found in zip(rows, brute_components(rows, 5, 80)) if found[3]]


def brute_cut(rows) -> list[tuple]:
    left = []
    for r, (_, kept) in zip(rows, brute_suffixes(rows)[1]):
        text = None if r[1] is None else kept
        left.append((r[0], text, *r[2:4], None if text is None else len(text), *r[5:]))
    return left


def test_toxicity_stage(spark, rows, sf_dir):
    from vellum.llm.toxicity import CUT, train

    docs = documents(spark, sf_dir)
    score = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).scorer()
    kept = [r for r in rows if score(None if r[1] is None else r[1].encode()) < CUT]
    found = stages()["toxicity"](spark, docs, sf_dir)
    assert found.columns == docs.columns and bag(found) == collections.Counter(kept)
    assert sum(r[0] is None or r[0] < 500 for r in kept) == len(rows) - 40 and len(kept) < len(rows) - 30


def test_near_duplicate_stage(spark, rows, sf_dir):
    docs = documents(spark, sf_dir)
    found = stages()["near_duplicates"](spark, docs, sf_dir)
    assert found.columns == docs.columns and bag(found) == collections.Counter(brute_kept(rows))


def test_repeated_passage_stage(spark, rows, sf_dir):
    docs = documents(spark, sf_dir)
    found = stages()["repeated_passages"](spark, docs, sf_dir)
    assert found.columns == docs.columns
    assert bag(found) == collections.Counter(brute_cut(rows))


def test_source_mix_stage(spark, rows, sf_dir):
    from vellum.llm.mixing import mix_report

    docs = documents(spark, sf_dir)
    found = stages()["source_mix"](spark, docs, sf_dir)
    assert found.columns == docs.columns
    times = bag(found)
    assert set(times) <= set(rows) and all(n <= 2 * rows.count(r) for r, n in times.items())
    words = collections.Counter()
    for r, n in times.items():
        words[r[0], len((r[1] or "").split())] += n * len((r[1] or "").split())
    want = collections.Counter()
    for r in mix_report(docs).collect():
        want[r.doc_id, r.size] += r.taken
    assert +words == +want


def test_packing_stage(spark, rows, sf_dir):
    found = stages()["packing"](spark, documents(spark, sf_dir), sf_dir)
    assert bag(found.drop("sequence_id", "offset")) == brute_pieces([(r[0], (r[1] or "").encode()) for r in rows])
    check_sequences(found.collect())


def test_empty_tables(spark, sf_dir):
    none = documents(spark, sf_dir).limit(0)
    for name, stage in stages().items():
        found = stage(spark, none, sf_dir)
        assert found.count() == 0 and (name == "packing" or found.columns == none.columns)


def test_whole_run(spark, rows, sf_dir):
    """run() against brute force up to the mix, whose choice is taken from the operator, and on to the pieces."""
    import corpus_pipeline

    from vellum.llm.mixing import mix
    from vellum.llm.toxicity import CUT, train

    score = train(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).scorer()
    left = brute_kept([r for r in rows if score(None if r[1] is None else r[1].encode()) < CUT])
    mixed = mix(spark.createDataFrame(brute_cut(left), SCHEMA)).collect()
    found = corpus_pipeline.run(spark, sf_dir)
    assert bag(found.drop("sequence_id", "offset")) == brute_pieces([(r.doc_id, (r.text or "").encode()) for r in mixed])
    check_sequences(found.collect())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_stages_on_the_test_tables(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, count = docs.schema.names, {"": docs.count()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        count[name] = docs.count()
        if name != "packing":
            assert docs.schema.names == columns
    assert count["toxicity"] <= count[""] and count["near_duplicates"] < count["toxicity"]
    assert count["repeated_passages"] == count["near_duplicates"] and count["packing"] >= count["source_mix"]
    assert docs.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").isEmpty()

"""Compaction of the index and the making of blocks: what is dealt anew, what is not, and that nothing is lost."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.operators import blocks, index, search


def texts(spark, ids, salt: int = 0):
    return spark.createDataFrame([(i, " ".join(f"w{(i * k + salt) % 61}" for k in range(i % 23))) for i in ids], "k long, text string")


def tables(made) -> dict:
    return {name: sorted(map(str, getattr(made, name).collect())) for name in ("points", "terms", "postings")}


def grown(spark, path: str, first: int, more: list[range], gone: list[int]):
    made = index.build(texts(spark, range(first)), path + "/grown", "k", "text")
    live = {i: 0 for i in range(first)}
    for n, ids in enumerate(more, 1):
        made = made.upsert(texts(spark, ids, n), spark.createDataFrame([(i,) for i in gone], "k long") if n == len(more) else None)
        live |= dict.fromkeys(ids, n)
    left = {i: n for i, n in live.items() if i not in gone}
    rows = None
    for n in set(left.values()):
        part = texts(spark, [i for i, x in left.items() if x == n], n)
        rows = part if rows is None else rows.unionByName(part)
    return made, index.build(rows, path + "/once", "k", "text")


def compacted(made, monkeypatch) -> tuple:
    """The index put together, and the plan by which its blocks were made."""
    plans, finished = [], index._finished
    monkeypatch.setattr(index, "_finished", lambda where, segment, rows, *a: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or finished(where, segment, rows, *a))
    return made.compact(most=1), plans[0]


def test_compaction_deals_no_postings(spark, tmp_path, monkeypatch):
    """Every posting was shuffled several times before: to drop dead ones, to find a place, to be dealt. Blocks go on where they are, though Spark would send nothing by itself."""
    made, once = grown(spark, str(tmp_path), 1200, [range(100, 300), range(1200, 1500)], list(range(0, 300, 7)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        whole, plan = compacted(made, monkeypatch)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange hashpartitioning" not in plan and "MapInArrow" not in plan
    assert tables(whole) == tables(once) and len(whole.manifest["segments"]) == 1 and whole.tombstones is None
    bounds = whole.every("blocks").select("n", F.size("entries").alias("size"), F.bit_count("docs").alias("docs"), "max_tf", F.array_max("entries.tf").alias("tf"), "min_dl", F.array_min("entries.dl").alias("dl"))
    assert bounds.where("n <> size or n <> docs or max_tf <> tf or min_dl <> dl").isEmpty()
    again = whole.upsert(texts(spark, range(0, 1500, 3), 5)).compact(most=1)  # ranges with places that are free
    rest = index.build(texts(spark, range(0, 1500, 3), 5).unionByName(once.points.where("k % 3 <> 0")), str(tmp_path / "rest"), "k", "text")
    assert tables(again) == tables(rest)
    asked = spark.createDataFrame([(1, "w0"), (1, "w7"), (2, "w60")], "qid long, tok string")
    best = lambda made: sorted(map(str, made.top(asked, "qid", 20, prune=True).collect()))
    assert best(again) == best(rest)


def test_hollow_ranges_are_numbered_anew(spark, tmp_path, monkeypatch):
    """Batches of few documents leave ranges nearly empty: put together, documents lie side by side."""
    made, once = grown(spark, str(tmp_path), 40, [range(n, n + 12) for n in range(0, 60, 10)], [3, 4, 5])
    hollow = made.every("docs").select("segment", "range").distinct().count()
    whole, plan = compacted(made, monkeypatch)
    assert "MapInArrow" in plan and tables(whole) == tables(once)
    assert whole.every("docs").select("range").distinct().count() < hollow / 2


@pytest.mark.parametrize("rows", [7, 64, 1 << 19])
def test_blocks_of_tokens(monkeypatch, rows):
    """Whatever is held at a time: ranges go on over batches, a range with more rows than are held is kept as counts."""
    monkeypatch.setattr(blocks, "ROWS", rows)
    monkeypatch.setattr(blocks, "SLICE", 4)
    rng = np.random.default_rng(3)
    docs = [(at, at * 10 + slot, slot, [f"t{x}" if x else None for x in rng.integers(0, 9, rng.integers(1, 40))]) for at in (0, 1, 5, 6, 40) for slot in range(0, 32, 1 + at % 3)]
    want = {}
    for at, key, slot, toks in docs:
        for tok, tf in Counter(toks).items():
            want.setdefault((at, tok), []).append((f"k{key}", tf, len(toks), slot))
    one = [(at, slot, len(toks), f"k{key}", tok) for at, key, slot, toks in docs for tok in toks]
    names = ["range", "slot", "dl", "key", "tok"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()]
    by_row = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*one), kinds)], names)
    cut = [(at, slot, len(toks), f"k{key}", toks[i : i + 4]) for at, key, slot, toks in docs for i in range(0, len(toks), 4)]
    by_list = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*cut), [*kinds[:4], pa.list_(pa.string())])], [*names[:4], "toks"])
    counts = [(at, slot, dl, key, tok, tf) for (at, tok), es in want.items() for key, tf, dl, slot in es]
    by_count = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*sorted(counts, key=lambda x: x[0])), [*kinds, pa.int64()])], [*names, "tf"])
    for whole in (by_row, by_list, by_count):
        parts = [whole.slice(i, 50) for i in range(0, whole.num_rows, 50)]
        made = [r for b in blocks.maker(32, "key")(iter(parts)) for r in b.to_pylist()]
        assert len(made) == len(want)
        for r in made:
            es = [(e["key"], e["tf"], e["dl"], e["slot"]) for e in r["entries"]]
            assert es == sorted(want[r["range"], r["tok"]], key=lambda e: e[3]) and r["n"] == len(es)
            assert r["max_tf"] == max(e[1] for e in es) and r["min_dl"] == min(e[2] for e in es) and r["docs"] == sum(1 << e[3] for e in es)


def test_rows_out_of_order_are_told():
    at = pa.record_batch([pa.array([2, 1]), pa.array([0, 0], pa.int32()), pa.array([1, 1]), pa.array([5, 6]), pa.array(["a", "b"])], ["range", "slot", "dl", "key", "tok"])
    with pytest.raises(ValueError, match="order"):
        list(blocks.maker(32, "key")(iter([at])))


def test_texts_are_shuffled_once(spark, tmp_path, monkeypatch):
    """Where places were too many to send along, texts were shuffled to meet them by key, and again to their super-ranges."""
    plans, made_of = [], blocks.made_of
    monkeypatch.setattr(blocks, "made_of", lambda rows, *a: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or made_of(rows, *a))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        made = index.build(texts(spark, range(400)), str(tmp_path / "i"), "k", "text", payload=["k"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans[0].count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plans[0]  # texts, and narrow places
    files = made.every("blocks").select("range", F.input_file_name().alias("f")).groupBy("range").agg(F.countDistinct("f").alias("n"))
    assert files.count() > 3 and files.where("n > 1").isEmpty() and made.every("blocks").groupBy("range", "tok").count().where("count > 1").isEmpty()
    assert made.postings.count() == sum(len({(i * k) % 61 for k in range(i % 23)}) for i in range(400))


def test_many_shares(spark, tmp_path, monkeypatch):
    """Documents of many shares, numbered apart, are all there, a range in one file."""
    monkeypatch.setattr(index, "PER_SHARE", 32)
    made = index.build(texts(spark, range(900)), str(tmp_path / "i"), "k", "text")
    assert made.every("docs").select(F.shiftright("range", 28)).distinct().count() == 26 and made.every("docs").select("range", "slot").distinct().count() == 900
    assert made.postings.count() == sum(len({(i * k) % 61 for k in range(i % 23)}) for i in range(900))
    blocks_in = made.every("blocks").select("range", "tok", F.input_file_name().alias("f"))
    assert blocks_in.groupBy("range").agg(F.countDistinct("f").alias("n")).where("n > 1").isEmpty() and blocks_in.groupBy("range", "tok").count().where("count > 1").isEmpty()

"""Hash trees: equal states have equal roots, a change is named from the ranges that differ, whatever the order and the partitions."""

from vellum.operators import fingerprint

SCHEMA = "k string, t string"


def test_changes_are_named(spark, tmp_path):
    rows = [(f"k{i}", f"text {i}") for i in range(200)] + [("null", None), ("empty", "")]
    of = lambda some, name: fingerprint.write_tree(spark.createDataFrame(some, SCHEMA).repartition(3), str(tmp_path / name), "k", "t", levels=2)
    first, again = of(rows, "a"), of(rows[::-1], "b")
    root = lambda t: [(r.digest, r.n) for r in t.where("level = 0").collect()]
    assert root(first) == root(again) and root(first)[0][1] == 202 and fingerprint.changed(first, again).isEmpty()
    assert first.where("level = 1").count() <= 16 and first.where("level = 2").count() <= 256 and first.where("level = 3").count() == 202
    other = of([(k, t + "!" if k == "k7" else t) for k, t in rows if k != "k9"] + [("new", "x")], "c")
    assert {tuple(r) for r in fingerprint.changed(first, other).collect()} == {("k7", "changed"), ("k9", "removed"), ("new", "added")}
    swapped = of([(k, {"null": "", "empty": None}.get(k, t)) for k, t in rows], "d")
    assert {r.key for r in fingerprint.changed(first, swapped).collect()} == {"null", "empty"}


def test_few_leaves_are_compared(spark, tmp_path):
    rows = [(f"k{i}", str(i)) for i in range(400)]
    of = lambda some, name: fingerprint.write_tree(spark.createDataFrame(some, SCHEMA), str(tmp_path / name), "k", "t", levels=2)
    before, after = of(rows, "a"), of([(k, t if k != "k11" else "other") for k, t in rows], "b")
    ranges = before.where("level = 2").join(after.where("level = 2"), ["node", "digest"], "left_anti")
    assert ranges.count() == 1 and ranges.first().n <= 10

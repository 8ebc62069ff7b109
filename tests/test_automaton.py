"""Many strings in many texts, sent along or dealt to shards, against plain search."""

import random

import pytest

from vellum.operators import automaton, glossary


def plain(texts, strings):
    return [(i, s, scope, t.count(s)) for i, scope, t in texts for s, of in set(strings) if t and s and scope is not None and of == scope and s in t]


@pytest.mark.parametrize("sent, group", [(1 << 20, 1 << 24), (40, 300)])
def test_occurrences(spark, sent, group):
    """With the tasks; in several shards and groups."""
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    texts = [(i, rng.choice(["x", "y", None]), rng.choice([word(rng.randint(0, 60)), None, "aaaa"])) for i in range(60)] + [(1, "x", "abab"), (None, "x", "abab")]
    strings = [(word(rng.randint(0, 4)), rng.choice(["x", "y"])) for _ in range(60)] + [("aa", "x"), ("aa", "x"), (None, "x"), ("a", None), ("abab", "x")]
    t, s = spark.createDataFrame(texts, "k long, scope string, text string").repartition(3), spark.createDataFrame(strings, "s string, scope string")
    found = automaton.occurrences(t, ["k"], "text", s, "s", ["scope"], sent, group)
    want = plain(texts, strings)
    assert sorted(((r.k, r.s, r.scope, r.n) for r in found.collect()), key=str) == sorted(want, key=str) and want
    assert automaton.occurrences(t, ["k"], "text", s.limit(0), "s").isEmpty()


def test_no_nested_loop_in_longest_matches(spark):
    texts = spark.createDataFrame([(1, "the net realisable value of it"), (2, "value net"), (3, None), (4, "")], "q long, text string")
    terms = spark.createDataFrame([("value",), ("realisablevalue",), ("netrealisablevalue",), ("net",), ("v",), ("of",)], "term string")
    found = glossary.longest_matches(texts, "q", "text", terms)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "netrealisablevalue"), (1, "of"), (2, "net"), (2, "value")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

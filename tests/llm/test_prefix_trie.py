"""Prefix tries against brute force: families, sequences that many families share, long conversations, nulls, ties, repeats, other columns."""

import collections
import hashlib
import random
import zlib

import pytest

SCHEMA = "family long, conv_id long, turn long, role string, text string, ends string"


def conversations() -> list[tuple]:
    rng = random.Random(6)
    common = [("user", "hello"), ("assistant", "hi é"), ("user", None), (None, "x"), (None, None), ("user", "𝒳 again"), ("user", "more")]
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 225), 307, 311, *range(-120, -95), -3, -1, 2**40 + 5]:
        kind = rng.random()
        n = rng.randint(1, 12)
        turns = [common[k % 7] if kind < 0.6 or k < 3 else (rng.choice(["user", "assistant"]), f"t{rng.randint(0, 3)}") for k in range(n)]
        places = list(range(n)) if kind < 0.8 else [rng.choice([None, 1, 2]) for _ in range(n)]
        rows += [(5, c, p, *t, "e") for p, t in zip(places, turns)]
    rows += [(5, 100, 50 + k, "user", f"tail {k % 5}", "e") for k in range(60)] + [(5, 223, 50 + k, *common[k % 7], "e") for k in range(60)] + [(5, 224, 50 + k, *common[k % 7], "e") for k in range(60)]
    rows += rows[10:14] + [(5, None, 1, "user", "nobody", "e")]
    rng.shuffle(rows)
    return rows


def brute(rows: list[tuple], limit: int = 6) -> collections.Counter:
    own = collections.defaultdict(list)
    for _, c, turn, role, text, _ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    members, ends = collections.defaultdict(set), collections.defaultdict(list)
    for c in sorted(own):
        base = int(c / 100) * 100
        h = zlib.crc32(str(c).encode()) % limit
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(str(c))
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return collections.Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(ends[p]).encode()).hexdigest()) for p, m in members.items())


@pytest.mark.parametrize("long_turns", [2000, 20, 7])
def test_prefix_trie(spark, long_turns):
    """All in families; the longest as chains; many as chains, some of the same family and with the same end."""
    from vellum.llm.prefix_trie import prefix_trie

    rows = conversations()
    found = prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), long_turns=long_turns)
    assert collections.Counter(tuple(r) for r in found.collect()) == brute(rows)


def test_turnless_and_empty(spark):
    from vellum.llm.prefix_trie import prefix_trie

    ids = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6][:3]  # their only turn is replaced by a base that is not there
    rows = [(1, c, 1, "user", "gone", "e") for c in ids]
    assert collections.Counter(tuple(r) for r in prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).isEmpty()

"""License scans against naive search, and expressions against a recursive-descent parser."""

import random
import re

import pytest

from vellum.llm import license_scan as L

SCHEMA = "matches long, doc_id long, text string, label string, score string"


class Descent:
    """or < and < with, brackets; over a list of tokens that is a whole expression."""

    def __init__(self, got):
        self.got, self.at, self.named = got, 0, set()

    def look(self):
        return self.got[self.at] if self.at < len(self.got) else None

    def alternatives(self):
        value = self.both()
        while self.look() in ("or", "/"):
            self.at += 1
            value = min(value, self.both())
        return value

    def both(self):
        value = self.one()
        while self.look() == "and":
            self.at += 1
            value = max(value, self.one())
        return value

    def one(self):
        t, self.at = self.look(), self.at + 1
        if t == "(":
            value, self.at = self.alternatives(), self.at + 1
            return value
        value = L.of(t, self.named)
        if self.look() == "with":
            exception, self.at = self.got[self.at + 1], self.at + 2
            value = L.WEAK if value == L.STRONG and L.LINKING.search(exception) else value
        return value


def expression(rng, depth=0):
    ids = ["mit", "apache-2.0", "gpl-2.0-only", "gpl-3.0+", "lgpl-2.1-or-later", "bsd-3-clause", "cc-by-nc-4.0", "gpl-2.0 with classpath-exception-2.0", "licenseref-own"]
    parts = [f"({expression(rng, depth + 1)})" if depth < 3 and rng.random() < 0.3 else rng.choice(ids) for _ in range(rng.randint(1, 4))]
    return "".join(p + (f" {rng.choice(['and', 'or'])} " if k < len(parts) - 1 else "") for k, p in enumerate(parts))


def test_expressions_mean_what_a_recursive_parser_says():
    rng = random.Random(8)
    for _ in range(500):
        said = expression(rng)
        got, polish, end = L.shunting_yard(said, lambda t: True)
        assert end == len(said)
        other = Descent(got)
        terms = other.alternatives()
        assert L.evaluated(polish) == (other.named, terms)


@pytest.mark.parametrize("line, tokens, families, terms", [
    (" mit or apache-2.0 */ then", ["mit", "or", "apache-2.0"], {"mit", "apache"}, L.PERMISSIVE),
    (" (mit or gpl-3.0-only", [], set(), None),
    (" mit and (gpl-2.0-or-later or bsd-2-clause) see below", ["mit", "and", "(", "gpl-2.0-or-later", "or", "bsd-2-clause", ")"], {"mit", "gpl", "bsd"}, L.PERMISSIVE),
    (" gpl-2.0 with gcc-exception-3.1 and", ["gpl-2.0", "with", "gcc-exception-3.1"], {"gpl"}, L.WEAK),
    (" mit and\nzlib", ["mit"], {"mit"}, L.PERMISSIVE),
    (" or mit", [], set(), None),
    (" )", [], set(), None),
    ("mit/apache-2.0", ["mit", "/", "apache-2.0"], {"mit", "apache"}, L.PERMISSIVE),
])
def test_longest_whole_expression(line, tokens, families, terms):
    got, polish, _ = L.shunting_yard(line, lambda t: L.family(t) is not None)
    assert got == tokens
    assert not got or L.evaluated(polish) == (families, terms)


def test_long_expressions_need_no_recursion():
    deep = "(" * 20_000 + "mit" + ")" * 20_000 + " and gpl-3.0" * 20_000
    got, polish, _ = L.shunting_yard(deep, lambda t: True)
    assert L.evaluated(polish) == ({"mit", "gpl"}, L.STRONG)


def naive(text):
    """Of the contract's columns, those that phrases give, by comparing words at every place."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    at = lambda phrase: [i for i in range(len(words)) if words[i : i + phrase.count(" ") + 1] == phrase.split(" ")]
    places = [(i, label) for phrase, label in L.BASE.items() for i in at(phrase)]
    own = [(i, i + p.count(" ") + 1, label) for table in (L.NOTICES, L.NAMES) for p, label in table.items() for i in at(p)]
    own = {label for i, j, label in own if not any((a, b) != (i, j) and a <= i and j <= b for a, b, _ in own)}
    starts = [i for i, _ in places]
    base = {label for _, label in places}
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | own))


def texts():
    rng = random.Random(2)
    parts = [*L.BASE, *L.NOTICES, *L.NAMES, "MIT\tLicense", "mit,license", "mit-é license", "Apache\nLicense", "license", "GNU GENERAL PUBLIC LICENSE", "cc", "by", "nc", "x", "Àé"]
    some = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(120)]
    return [None, "", " \n", "mit license", "mitlicense", "MIT LİCENSE", "mit license " * 30_000, "ſ mit license", "é" * 500, *some, some[0], some[0]]


def test_phrases_against_naive_search(spark):
    rows = [(1, i, t, "l", "s") for i, t in enumerate(texts())] + [(1, None, "apache license", "l", "s"), (1, 3, "gpl", "l", "s")]
    found = L.license_scan(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = sorted(map(str, ((r[1], *naive(r[2])) for r in rows)))
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)) for r in found) == want
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in found)
    assert L.license_scan(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_tags_and_spans(spark):
    text = "é // SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */\nLicense: of the house\n{\"license\": \"ISC\"}\nReleased under the MIT License."
    rows = [(1, 1, text, "l", "s"), (1, 2, "SPDX-License-Identifier: LicenseRef-House", "l", "s")]
    found = {r.doc_id: r for r in L.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[1].labels == "apache,gpl,isc,mit" and found[1].base_labels == "mit"
    assert found[1].expressions == "(mit OR apache-2.0) AND gpl-2.0-only WITH classpath-exception-2.0; isc"
    assert found[1].terms == "weak copyleft"
    assert (found[2].labels, found[2].terms, found[2].score) == ("licenseref-house", "unknown", 0.95)
    raw = text.encode()
    for m in L.license_matches(spark.createDataFrame(rows[:1], SCHEMA)).first().matches:
        piece = raw[m.start : m.end].decode().lower()
        assert piece == "mit license" if m.kind == "base" else piece.startswith(("spdx", '"license"'))

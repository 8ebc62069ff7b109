"""License scans: identifier tags and notice phrases by Aho-Corasick, expressions by a shunting-yard parser.

Two automata go over each whole text. One, over its words joined by one space, finds phrases: the base ones, of which
every place counts, and notices of this operator, of which one inside a longer one does not. The other, over the text
in lower case, finds tags such as `SPDX-License-Identifier:`; what follows on the line is read as an expression of identifiers, `and`,
`or` (also `/`), `with` and brackets. The parser keeps two stacks and no recursion, so an expression may be of any length; where a line
goes on with other text, the longest run from its start that is a whole expression holds. An expression names all its
identifiers' families; its terms are the strictest side of an `and` and the mildest of an `or`, and an exception for linking makes strong copyleft weak.

Rows stay in the scan: each text gives one row, nothing is shuffled, and a task that runs again gives the same rows.

The score is 1 less the product, over the distinct kinds and labels found, of 1 less a weight (`WEIGHTS`): 0 without any.
Nulls: a null text is empty (no words, no matches, score 0), a null doc_id is kept. Repeated rows each give a row. An
empty table gives an empty one. Other columns are not read. Texts are whole, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import modest_batches, sliced

#: Fixed values of the contract: phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Phrases of notices and short names, with their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this program is free software you can redistribute it and or modify": "gpl",
}
NAMES = {
    "lesser general public license": "lgpl", "library general public license": "lgpl", "affero general public license": "agpl", "mozilla public license": "mpl",
    "eclipse public license": "epl", "european union public licence": "eupl", "bsd license": "bsd", "2 clause bsd": "bsd", "3 clause bsd": "bsd", "isc license": "isc", "zlib license": "zlib",
    "boost software license": "bsl", "open font license": "ofl", "creative commons zero": "cc0", "cc0": "cc0", "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa", "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution non commercial": "cc-by-nc", "all rights reserved": "reserved",
}
#: Tags, and whether they are always followed by an expression, so that an identifier not known here stands as it is.
TAGS = {"spdx-license-identifier:": True, "license-expression:": True, '"license":': False, "license:": False, "licence:": False}
PERMISSIVE, WEAK, STRONG, RESTRICTED, UNKNOWN = range(5)
TERMS = ["permissive", "weak copyleft", "strong copyleft", "restricted", "unknown"]
#: Identifiers without their version.
FAMILIES = {
    PERMISSIVE: "mit apache bsd isc zlib unlicense bsl cc0 cc-by wtfpl artistic python psf postgresql ncsa x11 mit-0 0bsd".split(),
    WEAK: "lgpl mpl epl cddl eupl ofl".split(),
    STRONG: "gpl agpl cc-by-sa osl".split(),
    RESTRICTED: "cc-by-nc cc-by-nc-sa cc-by-nc-nd cc-by-nd".split(),
}
TERMS_OF = {f: t for t, families in FAMILIES.items() for f in families}
SAME = {"mit-0": "mit", "x11": "mit", "0bsd": "bsd", "psf": "python"}
WEIGHTS = {"tag": 0.95, "notice": 0.9, "base": 0.6, "name": 0.5}

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
TOKEN = re.compile(r"[ \t\"',]*(\(|\)|/|[a-z0-9][a-z0-9.:-]*\+?)")
BINDS = {"or": 1, "/": 1, "and": 2, "with": 3}
LINKING = re.compile(r"classpath|gcc|llvm|linking|runtime|autoconf|font")

MATCH = "kind string, label string, first_word long, n_words long, start long, end long, expression string, terms string"
FOUND = f"doc_id long, n_words long, matches array<struct<{', '.join(x.replace(' ', ': ') for x in MATCH.split(', '))}>>, score double"


# ---- expressions


def family(identifier: str) -> tuple[str, int] | None:
    """The family of an identifier and its terms; None for one that is not known."""
    base = re.sub(r"(-only|-or-later|\+)+$", "", identifier)
    for known in (base, re.sub(r"-v?\d+(\.\d+)*$", "", base), re.sub(r"-[0-9]-clause.*$", "", base)):
        if known in TERMS_OF:
            return SAME.get(known, known), TERMS_OF[known]
    return None


def tokens(text: str, at: int) -> Iterator[tuple[str, int]]:
    """What may belong to an expression, from a place on to the line's end at most: each token with its end."""
    while m := TOKEN.match(text, at):
        at = m.end()
        yield m[1], at


def shunting_yard(text: str, accept, at: int = 0) -> tuple[list[str], list[str], int]:
    """The longest run from a place on that is a whole expression: its tokens, the same in reverse Polish order, and its end. `accept` says which identifiers are such."""
    got, whole, end = [], 0, at
    operand, depth, exception = True, 0, False
    for t, at in tokens(text, at):  # what is an expression, as far as it goes
        if operand:
            if t == "(" and not exception:
                depth += 1
            elif t in BINDS or t in "()" or not (accept(t) if not exception else "exception" in t or accept(t)):
                break
            else:
                operand = False
        elif t in BINDS:
            operand, exception = True, t == "with"
        elif t == ")" and depth:
            depth -= 1
        else:
            break
        got.append(t)
        if not operand and not depth:
            whole, end = len(got), at
    out, stack = [], []
    for t in got[:whole]:
        if t in BINDS:
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[t]:
                out.append(stack.pop())
            stack.append(t)
        elif t == "(":
            stack.append(t)
        elif t == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            out.append(t)
    return got[:whole], out + stack[::-1], end


def evaluated(polish: list[str]) -> tuple[set[str], int]:
    """The families that an expression in reverse Polish order names, and its terms."""
    named, stack = set(), []
    for t in polish:
        if t not in BINDS:
            stack.append(t)
            continue
        right, left = stack.pop(), stack.pop()
        left = of(left, named) if isinstance(left, str) else left
        if t == "with":
            stack.append(WEAK if left == STRONG and LINKING.search(right) else left)
        else:
            right = of(right, named) if isinstance(right, str) else right
            stack.append(max(left, right) if t == "and" else min(left, right))
    last = stack.pop()
    return named, of(last, named) if isinstance(last, str) else last


def of(identifier: str, named: set[str]) -> int:
    label, terms = family(identifier) or (identifier, UNKNOWN)
    named.add(label)
    return terms


# ---- scanning


def automata() -> tuple:
    import ahocorasick

    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    by_phrase: dict[str, list[tuple[str, str, int]]] = {}
    for kind, table in (("base", BASE), ("notice", NOTICES), ("name", NAMES)):
        for phrase, label in table.items():
            by_phrase.setdefault(phrase, []).append((kind, label, phrase.count(" ") + 1))
    for phrase, what in by_phrase.items():
        phrases.add_word(f" {phrase} ", what)
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def outermost(spans: list[tuple]) -> list[tuple]:
    """Spans (first, last, ...) but those inside a longer one."""
    kept, reach = [], -1
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if s[1] > reach:
            kept.append(s)
            reach = s[1]
    return kept


def phrase_matches(lower: bytes, automaton) -> tuple[int, list[dict]]:
    """The number of words, and the places of phrases among them."""
    words = WORDS.findall(lower)
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    at, before, base, own = 0, 0, [], []
    for end, phrases in automaton.iter(joined):
        before += joined.count(" ", at, end)  # ends come in order, so spaces are counted once
        at = end
        for kind, label, n in phrases:
            (base if kind == "base" else own).append((before - n, before, kind, label))
    found = base + outermost(own)
    if not found:
        return len(words), []
    places = [m.span() for m in WORDS.finditer(lower)]
    return len(words), [
        {"kind": kind, "label": label, "first_word": first, "n_words": last - first, "start": places[first][0], "end": places[last - 1][1], "expression": None, "terms": TERMS[TERMS_OF.get(label, UNKNOWN)]}
        for first, last, kind, label in found
    ]


def tag_matches(lower: bytes, automaton) -> list[dict]:
    """One for each family that the expression behind a tag names."""
    text, found = lower.decode("latin-1"), []
    for start, end, tag in outermost([(last + 1 - len(tag), last + 1, tag) for last, tag in automaton.iter(text)]):
        accept = (lambda t: True) if TAGS[tag] else (lambda t: family(t) is not None)
        got, polish, until = shunting_yard(text, accept, end)
        if got:
            named, terms = evaluated(polish)
            shown = re.sub(r"\( | (?=\))", lambda m: m[0].strip(), " ".join("OR" if t == "/" else t.upper() if t in BINDS else t for t in got))
            found += [{"kind": "tag", "label": x, "first_word": None, "n_words": None, "start": start, "end": until, "expression": shown, "terms": TERMS[terms]} for x in sorted(named)]
    return found


def score(matches: list[dict]) -> float:
    rest = 1.0
    for kind, _ in sorted({(m["kind"], m["label"]) for m in matches}):
        rest *= 1 - WEIGHTS[kind]
    return round(1 - rest, 9)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    phrases, tags = automata()
    match = pa.struct([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in MATCH.split(", ")])
    for batch in sliced(batches):
        n_words, found, scores = [], [], []
        for text in batch.column(1).cast(pa.binary()):
            lower = (text.as_py() or b"").lower()  # of bytes: A-Z only
            n, matches = phrase_matches(lower, phrases)
            matches += tag_matches(lower, tags)
            n_words.append(n)
            found.append(matches)
            scores.append(score(matches))
        yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(found, pa.list_(match)), pa.array(scores, pa.float64())], ["doc_id", "n_words", "matches", "score"])


def license_matches(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, matches, score: a row for each document, with all places of phrases (in words and bytes) and tags (in bytes)."""
    modest_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(_scan, FOUND)


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, terms (the strictest of any match; null without one)."""
    found = license_matches(docs)
    base = F.filter("matches", lambda m: m["kind"] == "base")
    starts = F.transform(base, lambda m: m["first_word"])
    listed = lambda some, of, by: F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda m: m[of]))), by)
    order = F.array(*(F.lit(t) for t in TERMS))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base, "label", ",").alias("base_labels"), listed(F.col("matches"), "label", ",").alias("labels"), "score",
        listed(F.filter("matches", lambda m: m["expression"].isNotNull()), "expression", "; ").alias("expressions"),
        F.get(order, F.array_max(F.transform("matches", lambda m: F.array_position(order, m["terms"]).cast("int"))) - 1).alias("terms"),
    )

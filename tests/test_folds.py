"""Numbers and sections by windows, against plain loops over random files."""

import random

import pytest

from vellum.operators import normalise, numbering


def by_file(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        found.setdefault(r[0], []).append(r[1:])
    return found


def test_sections_are_written_when_they_change(spark):
    rng = random.Random(1)
    rows = [(f"f{f}", i, k := rng.choice(["section", "section", "cont"]), "1" if k == "para" else None, rng.choice("ABC") if k == "section" else "x") for f in range(60) for i in range(rng.randint(1, 25))]
    want = []
    for f, lines in by_file(rows).items():
        now = waiting = None
        for i, kind, _, text in lines:
            if kind == "section":
                waiting = text if text != now else waiting
            else:
                want += [(f, i, k, line) for k, line in enumerate(["", f"## {waiting}", text] if waiting else [text])]
                now, waiting = waiting or now, None
    found = normalise.emitted(spark.createDataFrame(rows, "file string, pos int, kind string, number string, text string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_promotion(spark):
    rng = random.Random(2)
    rows = [(f"f{f}", i, rng.choice(["A1 x", "A2 x", "B1 x", "B7 x", "C3 x", "text", "**B2 bold"]), rng.choice([None, None, "A9", "B4", "31"]), rng.random() < 0.7) for f in range(40) for i in range(20)]
    series = lambda n: n[0] if n and n[0].isalpha() else None
    want = []
    for f, lines in by_file(rows).items():
        last = None
        for i, line, number, candidate in lines:
            head = line.strip("*").split()[0] if candidate and line != "text" else None
            up = head and (head[1:] == "1" or series(head) == last)
            if up or number:
                last = series(head or number)
            want.append((f, i, head if up else None))
    found = normalise.promoted(spark.createDataFrame(rows, "file string, line_no int, line string, number string, candidate boolean"))
    assert sorted(((r.file, r.line_no, r.promoted) for r in found.collect()), key=str) == sorted(want, key=str)


def test_appendices(spark):
    rng = random.Random(3)
    rows = []
    for f in range(60):
        for i in range(25):
            opens = rng.random() < 0.15
            rows.append((f"f{f}", i, rng.choice(["text", "", None, "> 사례 1", "사례 1 - a", "사례 2", "사례 3: b", "사례 2x follows"]), opens, opens and rng.random() < 0.3, opens and rng.random() < 0.4, not opens and rng.random() < 0.15))
    want = []
    for f, lines in by_file(rows).items():
        appendix = reference = 0
        case, pending = 1, None
        for i, line, opens, is_reference, lone, numbered in lines:
            got = None
            if opens:
                appendix, reference = appendix + 1, reference + is_reference
                pending = f"참조{reference}" if is_reference else "case" if lone else f"부록{appendix}"
            elif numbered:
                pending = None
            elif appendix and (line or "").strip():
                named = line.lstrip("> ").split(" ")[1].rstrip(":") if "사례" in line and "follows" not in line else None
                if named == str(case) or pending == "case":
                    got, case = f"부록-사례{case}", case + 1
                else:
                    got = pending
                pending = None
            want.append((f, i, got))
    frame = spark.createDataFrame(rows, "file string, line_no int, line string, opens boolean, reference boolean, single_case boolean, numbered boolean")
    assert sorted(((r.file, r.line_no, r.virtual) for r in normalise.appendix_numbers(frame).collect()), key=str) == sorted(want, key=str)


FORMATS = {0: ("decimal", "%1.", 3), 1: ("lowerLetter", "%1.%2", 1), 2: ("upperLetter", "%2-%3", 26), 3: ("bullet", "-", 1), 4: ("lowerRoman", "%5", 1), 5: ("decimal", "%5%6", 1), 7: ("decimal", "%7|%8", 2)}


def letter(n):
    return chr(97 + (n - 1) % 26)


def write(kind, n):
    return {"decimal": str(n), "lowerLetter": letter(n), "upperLetter": letter(n).upper()}.get(kind)


@pytest.mark.parametrize("starts_at", [5, None])
def test_list_numbers(spark, starts_at):
    """Shared counters, own starts at a list's first use, levels without rows, levels that are not defined."""
    rng = random.Random(4)
    rows = [(f"f{f}", i, rng.choice(["one", "two", "three", None]), rng.choice([0, 0, 1, 1, 2, 3, 4, 5, 6, 7])) for f in range(40) for i in range(18)]
    abstract = {"one": "x", "two": "x", "three": "y", None: None}
    starts = {("two", 1): starts_at, ("two", 0): 9, ("three", 2): 4} if starts_at else {}
    want = []
    for f, lines in by_file(rows).items():
        counters, begun = {"x": {}, "y": {}}, set()
        for i, own, level in lines:
            label = None
            if own:
                here = counters[abstract[own]]
                if own not in begun:
                    begun.add(own)
                    here.update({k: v - 1 for (o, k), v in starts.items() if o == own})
                if level in FORMATS:
                    here[level] = here.get(level, FORMATS[level][2] - 1) + 1
                    for k in [k for k in here if k > level]:
                        del here[k]
                    shown = {k: write(kind, here.get(k, start)) for k, (kind, _, start) in FORMATS.items()}
                    template = FORMATS[level][1]
                    used = [int(template[k + 1]) - 1 for k, c in enumerate(template) if c == "%"]
                    if FORMATS[level][0] != "bullet" and all(shown.get(k, "") is not None for k in used):
                        label = template
                        for k in used:
                            label = label.replace(f"%{k + 1}", shown.get(k, ""))
            want.append((f, i, label))
    listed = spark.createDataFrame([(f, i, own, abstract[own], level, None, None, None) for f, i, own, level in rows], "file string, pos int, list_id string, abstract_id string, level int, format string, template string, start double")
    defined = spark.createDataFrame([(f"f{f}", a, k, *v) for f in range(40) for a in "xy" for k, v in FORMATS.items()], "file string, abstract_id string, level int, format string, template string, start int")
    own = spark.createDataFrame([(f"f{f}", o, k, v) for f in range(40) for (o, k), v in starts.items()], "file string, list_id string, level int, override int")
    found = numbering.numbering_expand(listed, "file", defined, own)
    assert sorted(((r.file, r.pos, r.label) for r in found.collect()), key=str) == sorted(want, key=str)


def test_an_upper_level_takes_back_an_own_start(spark):
    """A list that begins at level 0, with an own start of 5 at level 1, and a template that names a level without rows."""
    levels = [(0, "decimal", "%1."), (1, "decimal", "%1.%2"), (2, "decimal", "%1.%3")]
    defined = spark.createDataFrame([("f", "a", k, kind, t, 1) for k, kind, t in levels] + [("f", "b", 0, "decimal", "%1.", 4), ("f", "b", 1, "decimal", "%1.%2", 1)], "file string, abstract_id string, level int, format string, template string, start int")
    own = spark.createDataFrame([("f", "l", 1, 5)], "file string, list_id string, level int, override int")
    rows = spark.createDataFrame([("f", 0, "l", "a", 0), ("f", 1, "l", "a", 1), ("f", 2, "m", "b", 1)], "file string, pos int, list_id string, abstract_id string, level int")
    rows = rows.selectExpr("*", "cast(null as string) as format", "cast(null as string) as template", "cast(null as double) as start")
    assert [r.label for r in numbering.numbering_expand(rows, "file", defined, own).orderBy("pos").collect()] == ["1.", "1.1", "4.1"]


def test_scopes(spark):
    rng = random.Random(5)
    rows = [(f"f{f}", i, rng.choice(["IE", "IE", "ie", "BC", None]), rng.choice(["1", "2", "1.2", "10", "A1", "CU5", "BC3", "x", None]), rng.choice([None, None, None, "S", "T", "사례 7", "사례 0", "부록 C"])) for f in range(50) for i in range(20)]
    want = []
    for f, lines in by_file(rows).items():
        scope, last, title = 0, None, None
        for i, zone, number, section in lines:
            if section and section != title:
                named = section.split(" ")[1] if section.startswith("사례") else None
                scope, last, title = int(named) if named else scope + 1, None, section
            got = None
            if number and number[:2] in ("BC", "IE", "IG"):
                got = number
            elif number and number != "x" and not number.startswith("CU"):
                if (zone or "").upper() == "BC":
                    got = f"BC-{number}"
                elif number[0] == "A":
                    got = f"IE부록A-{number[1:]}"
                elif title == "부록 C":
                    got = f"IE부록C-{number}"
                else:
                    digits = [int(x) for x in number.split(".")]
                    scope, last = max(1, scope + (last is not None and digits <= last)), digits
                    got = f"IE사례{scope}-{number}"
            want.append((f, i, got))
    found = numbering.synthetic_number_scope(spark.createDataFrame(rows, "file string, pos int, zone string, number string, section string"), "file")
    assert sorted(((r.file, r.pos, r.synthetic_id) for r in found.collect()), key=str) == sorted(want, key=str)
    assert "Pandas" not in found._jdf.queryExecution().executedPlan().toString()

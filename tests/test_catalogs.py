"""Catalogues as nested JSON, and documents as ordered blocks."""

import json
import random

from pyspark.sql import functions as F

from ledgerline.operators.scan import numbered, ordered_scan
from ledgerline.sources import catalog, provisions, texts
from ledgerline.sources.provisions import Style


def deep(n):
    node = {"id": f"d-{n}", "title": "Deep"}
    return node if n == 9 else {**node, "controls": [deep(n + 1)]}


CATALOG = {
    "catalog": {
        "id": "cat",
        "groups": [
            {
                "id": "g1",
                "title": "Group",
                "groups": [{"title": "Inner", "controls": [{"id": "ism-12", "title": "Control: ism-12", "parts": [{"name": "statement", "prose": " Keep it. "}]}]}],
                "controls": [
                    {
                        "id": "ac-1",
                        "title": "Access",
                        "class": "SP",
                        "params": [
                            {"id": "p1", "label": "time {{ insert: param, p2 }}"}, {"id": "p2", "select": {"choice": ["a", {"value": "b"}, {"prose": "c {{ insert: param, p3 }}"}, {"other": 1}]}}, {"id": "p3", "values": ["x", "y"]},
                            {"id": "p4", "select": {}}, {"id": "p5", "values": "one"}, {"id": "p6"}, {"id": "p7", "label": "{{ insert: param, p7 }}+"}, {"id": "p5", "values": "two"},
                        ],
                        "props": [{"name": "label", "value": "AC-01"}, {"name": "label", "value": "AC-1"}, {"name": "x", "value": "A"}],
                        "parts": [
                            {"name": "statement", "prose": "Do:", "parts": [
                                {"name": "item", "props": [{"name": "label", "value": "a."}], "prose": "{{ insert: param, p1 }} and {{insert: param,p9}}", "parts": [{"name": "item", "prose": "p4 {{ insert: param, p4 }}, {{ insert: param, p5 }}, {{ insert: param, p6 }}"}]},
                                {"name": "item", "props": [{"name": "label", "value": "b."}], "parts": [{"name": "item", "props": [{"name": "label", "value": "1."}], "prose": "deep"}]}]},
                            {"name": "guidance", "prose": "See {{ insert: param, p3 }}"}, {"name": "assessment-objective", "prose": "no"},
                        ],
                        "controls": [{"id": "ac-1.1", "title": "Sub", "parts": [{"name": "statement", "prose": "$1 \\\\ {{ insert: param, p1 }}"}]}],
                    }
                ],
            }
        ],
        "controls": [{"id": "Top", "title": "Top one"}, deep(0)],
    }
}


def test_catalog_of_any_depth(spark):
    docs = [("a", json.dumps(CATALOG)), ("bad", "{"), ("none", '{"catalog": {}}'), ("null", None), ("b", json.dumps({"catalog": {"controls": [{"id": "x-1", "props": [{"name": "label", "value": "X"}]}]}}))]
    got = {(r.doc, r.id): r for r in catalog.catalog_controls(spark.createDataFrame(docs, "doc string, json string")).collect()}
    assert len(got) == 15
    ac = got["a", "ac-1"]
    assert ac.text == "Do:\n  a. [time [a or b or c x, y]] and [p9]\n    p4 [selection], two, [p6]\n    1. deep" and ac.guidance == "See x, y"
    assert (ac.identifier, ac.alternates, ac.title, ac.depth, ac.parent_id, ac.section_ref, ac["class"]) == ("AC-1", ["AC-01"], "Access", 0, "g1", "Group", "SP")
    ism = got["a", "ism-12"]
    assert (ism.identifier, ism.title, ism.text, ism.section_ref, ism.parent_id) == ("ISM-12", None, "Keep it.", "Group > Inner", None)
    assert got["a", "ac-1.1"].text == "$1 \\\\ [p1]" and got["a", "ac-1.1"].parent_id == "ac-1" and got["a", "Top"].identifier == "Top"
    assert got["a", "d-9"].depth == 9 and got["a", "d-9"].parent_id == "d-8" and got["a", "d-0"].parent_id == "cat"
    order = [r.id for r in sorted((r for (d, _), r in got.items() if d == "a"), key=lambda r: r.place)]
    assert order == ["ism-12", "ac-1", "ac-1.1", "Top", *[f"d-{k}" for k in range(10)]]
    assert catalog.catalog_controls(spark.createDataFrame([], "doc string, json string")).count() == 0


def test_parameters_that_insert_themselves_stop(spark):
    df = spark.createDataFrame([("{{ insert: param, p }}", {"p": "{{ insert: param, p }}+"})], "t string, m map<string,string>")
    assert df.select(catalog.resolve_params(F.col("t"), F.col("m"))).first()[0] == "{{ insert: param, p }}+++++"


def test_scan_over_many_parts(spark):
    """One group fills most parts, a null group is one, fills end where a struct of nulls says so."""
    rng = random.Random(2)
    rows = [(g, k, rng.choice(["h", None, None, None, "x"]), rng.randint(0, 3)) for g, n in (("long", 4000), (None, 300), ("short", 3)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k long, mark string, v int").repartition(7)
    ends = F.when(F.col("mark") == "h", F.struct(F.col("k").alias("k"))).when(F.col("mark") == "x", F.struct(F.lit(None).cast("long").alias("k")))
    got = ordered_scan(df, ["g"], ["k"], {"open": ends, "last": F.col("mark")}, {"run": F.col("v")}).collect()
    want = set()
    for g in ("long", None, "short"):
        opened, last, run = None, None, 0
        for _, k, mark, v in (r for r in rows if r[0] == g):
            opened, last, run = (k if mark == "h" else None if mark == "x" else opened), mark or last, run + v
            want.add((g, k, opened, last, run))
    assert {(r.g, r.k, r.open.k if r.open else None, r.last, r.run) for r in got} == want and len(got) == len(rows)
    assert {(r.g, r.k + 1) for r in numbered(df, ["g"], ["k"], "n").where("n = k + 1").collect()} == {(g, k + 1) for g, k, _, _ in rows}
    assert ordered_scan(df.limit(0), ["g"], ["k"], {"last": F.col("mark")}).count() == 0


STYLES = [
    Style("^toc", "skip"), Style("^end", "end"), Style("^part", "level0", r"^(Part\s+[0-9]+)\s*[—-]?\s*(.*)$"), Style("^division", "level1", r"^(Division\s+[0-9]+)\s*[—-]?\s*(.*)$"),
    Style("^section", "section", r"^([0-9]+[A-Z]*)\s+(.*)$", "s {number}"), Style("^subsection$", "subsection", r"^\(([0-9]+)\)\s*(.*)$", "s {section}({number})"), Style("^(paragraph|penalty)", "more"), Style("^note", "note"),
]


def blocks_of(spark, *docs):
    return spark.createDataFrame([(d, k, s, t) for d, rows in docs for k, (s, t) in enumerate(rows)], "doc string, idx long, style string, text string")


def test_levels_are_qualified_and_reset(spark):
    act = [
        ("toc1", "Part 9 — Contents"), ("paragraph", "lost"), ("part", "Part 1 — First"), ("division", "Division 1 — One"), ("section", "5 Duties"), ("subsection", "(1) A person must:"), ("paragraph", "(a) lock;"), ("paragraph", "(b) log."), ("note", "See 6."),
        ("subsection", "Plain words may follow."), ("penalty", "60 units."), ("division", "Division 2"), ("paragraph", "lost"), ("section", "6A Empty"), ("part", "Part 2 — Second"), ("division", "Division 1 — Again"), ("section", "Schedule"), ("subsection", "(1) lost"),
        ("section", "7 Last"), ("subsection", " (1)  Keep. "), ("part", "Preamble without any number at all"), ("section", "8 Under"), ("end", "Notes"), ("section", "9 Gone"),
    ]
    got = provisions.assemble_levels(blocks_of(spark, ("a", act), ("b", [("division", "Division 7 — Alone"), ("section", "1 X")])), STYLES, section_depth=2).collect()
    rows = {(r.doc, r.idx): (r.identifier, r.title, r.depth, r.parent, r.text, r.structural) for r in got}
    assert rows == {
        ("a", 2): ("Part 1", "First", 0, None, "", True), ("a", 3): ("Part 1 Division 1", "One", 1, "Part 1", "", True), ("a", 4): ("s 5", "Duties", 2, "Part 1 Division 1", "Plain words may follow.\n60 units.", False),
        ("a", 5): ("s 5(1)", None, 3, "s 5", "A person must:\n(a) lock;\n(b) log.", False), ("a", 11): ("Part 1 Division 2", None, 1, "Part 1", "", True), ("a", 13): ("s 6A", "Empty", 2, "Part 1 Division 2", "", True),
        ("a", 14): ("Part 2", "Second", 0, None, "", True), ("a", 15): ("Part 2 Division 1", "Again", 1, "Part 2", "", True), ("a", 18): ("s 7", "Last", 2, "Part 2 Division 1", "", True), ("a", 19): ("s 7(1)", None, 3, "s 7", "Keep.", False),
        ("a", 20): ("Preamble without any num", None, 0, None, "", True), ("a", 21): ("s 8", "Under", 2, "Preamble without any num", "", True), ("b", 0): ("Division 7", "Alone", 1, None, "", True), ("b", 1): ("s 1", "X", 2, "Division 7", "", True),
    }
    assert next(r for r in got if r.doc == "a" and r.idx == 5).notes == ["See 6."] and next(r for r in got if r.idx == 19).section_ref == "Last"


def test_a_section_runs_over_parts_of_the_scan(spark):
    """A document of many thousand lines is dealt over all tasks: the boundaries lie inside its sections."""
    rows = [("part", "Part 1 — P")]
    for s in range(4):
        rows += [("section", f"{s + 1} S"), ("subsection", "(1) Begin")] + [("paragraph", f"line {s} {k}") for k in range(1500)]
    got = provisions.assemble_levels(blocks_of(spark, ("d", rows)), STYLES).collect()
    texts_ = {r.identifier: r.text for r in got}
    assert texts_["s 3(1)"].split("\n") == ["Begin", *[f"line 2 {k}" for k in range(1500)]] and {r.parent for r in got if r.role == "section"} == {"Part 1"}


def test_principles_are_loaded_whole_or_not(spark):
    styles = [
        Style("^schedule", "level0", r"^(Schedule [12]) — (.+)$"), Style("^heading", "section", r"^(\d+)\. Principle \d+: (.+)$", "{prefix} {number}"), Style("^sub", "subsection", r"^(\d+\.\d+)\s+(.+)$", "{prefix} {number}"), Style("^line", "more"),
    ]
    good = [("schedule", "Schedule 1 — Privacy"), ("heading", "1. Principle 1: Collect"), ("sub", "1.1 Only what is needed."), ("line", "more"), ("sub", "1.2 Fairly."), ("schedule", "Schedule 2 — Sharing"), ("heading", "1. Principle 1: Share"), ("line", "In trust.")]
    blocks = blocks_of(spark, ("good", good), ("short", good[:5]), ("changed", good), ("twice", good + good[6:]), ("empty", [*good[:4], ("sub", "1.2  "), *good[5:]]))
    wanted = [(d, i) for d in ("good", "short", "changed", "twice", "empty") for i in ("IPP 1", "IPP 1.1", "IPP 1.2", "RSP 1")]
    expected = spark.createDataFrame(wanted, "doc string, identifier string")
    reviewed = spark.createDataFrame([(d, "changed" if d == "changed" else "available") for d in ("good", "short", "changed", "twice", "empty")], "doc string, state string")
    notes, contexts = spark.createDataFrame([("IPP 1.1", "since July")], "identifier string, scope_note string"), spark.createDataFrame([("RSP 1", "x:2", "b"), ("RSP 1", "x:1", "a")], "identifier string, uid string, label string")
    controls, problems = provisions.assemble_principles(blocks, styles, expected, reviewed, notes, contexts, prefixes={"Schedule 1": "IPP", "Schedule 2": "RSP"})
    got = {r.identifier: r for r in controls.collect()}
    assert {r.doc for r in got.values()} == {"good"} and got["IPP 1.1"].text == "Only what is needed.\nmore" and got["IPP 1.1"].scope_note == "since July" and got["RSP 1"].text == "In trust."
    assert [c.uid for c in got["RSP 1"].context] == ["x:1", "x:2"] and got["IPP 1"].structural and got["IPP 1.1"].depth == 2
    assert {(r.doc, r.identifier, r.problem) for r in problems.collect()} == {
        ("short", "RSP 1", "missing"), ("changed", None, "not the reviewed file"), ("twice", "RSP 1", "repeated"), ("empty", "IPP 1.2", "missing"),
    }


def test_table_rows_under_headings(spark):
    html = """<h2>Intro</h2><table><tr><td>No</td><td>no</td></tr></table><h2> Level <b>One</b></h2><table><thead><tr><th>S</th></tr></thead>
      <tr><td>Patch</td><td>Apply<br>fixes &amp; <i>test</i>s&nbsp;.</td></tr><tr><td>Again.</td></tr><tr><td>Unknown</td><td>u</td></tr></table><h2>Level Two</h2><tr><td>Back up</td><td>Daily</td></tr><H2>End</H2><tr><td>x</td></tr>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<h2>Level One</h2><tr><td>Patch</td><td>a</td></tr><tr><td>Back up</td><td>b</td></tr><h2>Level Two</h2>" + "<tr><td>Patch</td><td>c</td></tr>" * 100 + "<tr><td>Back up</td><td>d</td></tr>")], "page_id int, html string")
    controls, problems = provisions.table_rows(pages, {"Level One": "L1", "Level Two": "L2"}, {"Patch": "P", "Patches": "P", "Back up": "B"})
    got = [(r.page_id, r.identifier, r.title, r.text, r.level) for r in controls.orderBy("page_id", "pos").collect()]
    assert got[:3] == [(1, "L1-P-01", "Patch", "Apply fixes & tests .", "L1"), (1, "L1-P-02", "Patch", "Again.", "L1"), (1, "L2-B-01", "Back up", "Daily", "L2")]
    assert got[-2][1] == "L2-P-100" and len(got) == 3 + 103
    assert {(r.page_id, r.what) for r in problems.collect()} == {(1, "unknown group: Unknown"), (1, "no rows: L1-B"), (1, "no rows: L2-P")}


def test_details_under_headings(spark):
    html = "<h2>Other</h2><h3>A</h3><p>no</p><h2>Mitigation strategies</h2>lost<h3>Patch <i>now</i></h3><p>Why.<li>One</li><h4>How</h4>x<br>y<h3>B</h3><h2>End</h2><h3>C</h3>"
    got = provisions.heading_details(spark.createDataFrame([(1, html)], "page_id int, html string"), "Mitigation strateg").collect()
    assert {(r.title, r.text) for r in got} == {("Patch now", "Why.\nOne\nHowx\ny"), ("B", "")}


def test_labelled_blocks_with_wrapped_titles_and_levels(spark):
    rows = [
        "1.1 Not confirmed", "x", "1.2 (L1) Ensure that", "it is set (Automated)", "stray", "Profile Applicability:", "Level 1 (L1) and Level 2 (L2), Level 1 (L1)", "Description:", "Words", "of it.", "1.3 Mapping row", "Rationale:", "Why", "and more",
        "2.1 (L2) Whole (Manual)", "Profile Applicability:", "all", "Description:", "More",
    ]
    lines = spark.createDataFrame([("d", k, t) for k, t in enumerate(rows)], "doc string, idx long, text string")
    labels = ["Profile Applicability", "Description", "Rationale"]
    got = texts.labelled_blocks(lines, r"^\d+(\.\d+)+\s", "^Profile Applicability:", labels, ends=r"\((Automated|Manual)\)\s*$", levels=r"\((L\d)\)")
    rows = {(r.record, r.label): r.text for r in got.collect()}
    assert rows[1, "title"] == "1.2 (L1) Ensure that it is set (Automated)" and rows[1, "levels"] == "L1,L2" and rows[1, "Description"] == "Description: Words of it. 1.3 Mapping row" and rows[1, "Rationale"] == "Rationale: Why and more"
    assert rows[2, "title"] == "2.1 (L2) Whole (Manual)" and rows[2, "levels"] == "L2" and {r for r, _ in rows} == {1, 2}


def test_statements_are_unique_in_a_volume(spark):
    text = "The service SHALL keep the session for at most 30 minutes of idling."
    pages = spark.createDataFrame([(1, "v", f"<h2>A</h2><p>{text}</p>"), (2, "v", f"<h2>B</h2><li>{text}</li><p>{text} Always.</p>"), (3, "w", f"<p>{text}</p>")], "page_id int, volume string, html string")
    keys = lambda **k: sorted((r.page_id, r.pos) for r in texts.html_normative_statements(pages, prefix=40, **k).collect())
    assert keys(volume="volume") == [(1, 1), (3, 0)] and keys() == [(1, 1), (2, 1), (3, 0)]

"""Published tables and sheets on literals; the registered queries are compared with SQL elsewhere."""

import pytest

from ledgerline.sources import tables, texts


def test_numeric_cells_and_titles_decide(spark):
    controls = spark.createDataFrame([("c:3.1", "3.1", "Keep a process"), ("c:3.10", "3.10", "Encrypt  Data"), ("c:4.2", "4.2", "Same"), ("c:5.1", "5.1", "Twice"), ("c:5.10", "5.10", "twice")], "uid string, identifier string, title string")
    rows = [("3.1", "encrypt data", "patch", "subset"), ("3.10", "Keep a process", "macros", "superset"), ("4.20", "renamed", "backup", "subset"), ("4.2", "renamed", "backup", "subset"), ("5.1", "Twice", "patch", "subset"), ("3.1", "neither", "patch", "subset"), ("9.9", "none", "patch", "subset"), ("3.1", "encrypt data", "", "subset"), (None, "x", "patch", "subset")]
    good, bad = tables.mapping_tags(spark.createDataFrame(rows, "number string, title string, strategy string, relationship string"), controls)
    assert {tuple(r) for r in good.collect()} == {("c:3.10", "patch", "subset"), ("c:3.1", "macros", "superset"), ("c:4.2", "backup", "subset")}
    assert {tuple(r) for r in bad.collect()} == {("5.1", "Twice", 2), ("3.1", "neither", 0), ("9.9", "none", 0)}


def test_stored_numbers(spark):
    rows = spark.createDataFrame([("3.10",), ("4.0",), ("10",), (" 3.0999999999999996 ",), ("1.A",), (None,), (" 7.2",)], "c string")
    assert [r.n for r in rows.select(tables.stored_number(rows.c).alias("n")).collect()] == ["3.1", "4", "10", "3.1", "1.A", "", "7.2"]


def test_sheet(spark):
    group, leaf = r"(?s)^[^(]*\(([A-Z]{2}(?:\.[A-Z]{2})?)\)\s*:?\s*(.*)$", r"(?s)^([A-Z]{2}\.[A-Z]{2}-\d{2})\s*:\s*(.*)$"
    rows = [(1, "GOVERN (GV): Strategy is set", None, None, None), (2, "", "Context (GV.OC): Known", "", None), (3, None, None, "GV.OC-01: The mission\nis known", "Cat 1: AC-1,\n CRI: EX-1\nloose"), (4, None, "Old (GV.XX): [Withdrawn: Incorporated into GV and GV.OC-01]", None, None),
        (5, None, None, "GV.XX-01: kept below", "Cat 1: ZZ-9"), (6, "GOVERN (GV)", None, None, None), (7, "GOVERN (GV): again", None, None, None), (8, None, None, "no identifier", None), (9, None, None, "GV.OC-02: [Withdrawn: gone]", None)]
    rows = spark.createDataFrame([("d", *r) for r in rows], "document string, load_seq int, function string, category string, subcategory string, refs string")
    controls, moved, cited = tables.hierarchical_sheet(rows, "csf", group, leaf, r"(?i)^\[Withdrawn[:\]]", r"\b([A-Z]{2}(?:\.[A-Z]{2}(?:-\d{2})?)?)\b")
    assert {(r.uid, r.parent_uid, r.title, r.text) for r in controls.collect()} == {("csf:gv", None, "GOVERN", "Strategy is set"), ("csf:gv.oc", "csf:gv", "Context", "Known"), ("csf:gv.oc-1", "csf:gv.oc", None, "The mission\nis known"), ("csf:gv.xx-1", "csf:gv.xx", None, "kept below")}
    assert {(r.identifier, tuple(r.targets)) for r in moved.collect()} == {("GV.XX", ("GV", "GV.OC-01")), ("GV.OC-02", ())}
    known = spark.createDataFrame([("cat:ac-1", "cat", "AC-01")], "uid string, framework_key string, identifier string")
    links, other = tables.reference_links(cited, spark.createDataFrame([("Cat 1", "cat")], "source string, framework_key string"), known)
    assert [tuple(r) for r in links.collect()] == [("csf:gv.oc-1", "cat:ac-1", "Cat 1")]
    assert [(r.source, r.identifier) for r in other.collect()] == [("CRI", "EX-1")]


def test_requirements_need_a_text_column(spark):
    rows = spark.createDataFrame([("1", "GOV", "1. Roles", "Do it", "Yes", "Ceased 2025", 1), ("2", "GOV", "1. Roles", "Do more", "Yes", None, 2), ("", "GOV", "2. X", "unnumbered", None, None, 3), ("4", "", "", "Alone", None, None, 4)], "req_number string, Domain string, Section string, `Release 24 text` string, `Question Mandatory` string, Decision string, load_seq int")
    got = {(r.uid, r.parent_uid, r.obligation, r.ceased) for r in tables.requirement_controls(rows, "p", ["release", "requirement"], ["question mandatory", "decision"], "ceased|retire").collect()}
    assert got == {("p:gov", None, "informative", False), ("p:gov 1", "p:gov", "informative", False), ("p:req 1", "p:gov 1", "informative", True), ("p:req 2", "p:gov 1", "mandatory", False), ("p:req 4", None, "mandatory", False)}
    with pytest.raises(ValueError):
        tables.requirement_controls(rows, "p", ["statement"], [], "ceased")
    assert tables.requirement_controls(rows.limit(0), "p", ["release"], ["nothing"], "ceased").count() == 0


def test_guides_and_practices(spark):
    guides = spark.createDataFrame([("Report 3: Cyber", "Cyber guide", 1)], "report string, title string, load_seq int")
    records = spark.createDataFrame([("Report 3: Cyber", "GA 1.1", "1", "People", "Train", "Train staff.", 1), ("Report 3: Cyber", "GA 1.2", "1", "People", None, " ", 2), ("Report 3: Cyber", "GA 9", " ", None, None, "Loose.", 3)], "report string, identifier string, section_number string, section_title string, heading string, text string, load_seq int")
    got = {(r.uid, r.parent_uid, r.depth, r.title, r.obligation) for r in tables.guide_controls(guides, records, "g").collect()}
    assert got == {("g:report 3", None, 0, "Cyber guide", "informative"), ("g:ga 1", "g:report 3", 1, "People", "informative"), ("g:ga 1.1", "g:ga 1", 2, "Train", "recommended"), ("g:ga 9", None, 2, None, "recommended")}
    rows = spark.createDataFrame([("ASSET", "A-1", "Manage", "A-1a", "List", "1", " ", 1), ("ASSET", "A-1", "Other", "A-1a", "Again", "2", "P", 2), ("ASSET", "A-2", "Gone", "A-2a", None, "1", "P", 3)], "domain string, objective_id string, objective string, practice_id string, practice string, mil string, profile string, load_seq int")
    got = {(r.uid, r.parent_uid, r.title, r.text, tuple(r.tags.items())) for r in tables.practice_controls(rows, "m", ["mil", "profile"]).collect()}
    assert got == {("m:asset", None, "Asset", "", ()), ("m:a-1", "m:asset", None, "Manage", ()), ("m:a-1a", "m:a-1", None, "List", (("mil", "1"),))}


def test_normative_html(spark):
    html = "<h2>Length</h2><p>Passwords SHALL be at least 15 characters in length always.</p><p>Passwords SHALL be at least 15 characters in length always.</p><p>Passwords shall be at least 15 characters in length always.</p><li>Verifiers SHOULD say nothing at all about it to anyone.</li>"
    got = texts.html_normative_statements(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()
    assert [(r.heading, sorted(r.parameters)) for r in got] == [("Length", ["bound", "length"])]

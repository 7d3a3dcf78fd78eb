import hashlib
import json

from pyspark.sql import functions as F

from ledgerline.sources import catalog, sinks, texts


def test_flatten_catalog(spark, tmp_path):
    doc = {"catalog": {"groups": [{"id": "ac", "title": "Access", "controls": [{"id": "ac-1", "title": "Policy", "controls": [{"id": "ac-1.1", "title": "More"}]}]}, {"id": "au", "title": "Audit", "groups": [{"id": "au-x", "title": "Inner", "controls": [{"id": "au-1", "title": "Logs"}]}]}]}}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    rows = catalog.flatten_catalog(spark, str(tmp_path / "c.json")).collect()
    assert {(r.id, r.parent_id, r.depth, "/".join(r.group_path)) for r in rows} == {("ac-1", None, 0, "Access"), ("ac-1.1", "ac-1", 1, "Access"), ("au-1", None, 0, "Audit/Inner")}


def test_resolve_params_nested_and_unknown(spark):
    df = spark.createDataFrame([("Do {{ insert: param, p-1 }} and {{ insert: param, zz }}", {"p-1": "x {{ insert: param, p-2 }}", "p-2": "$5"})], "t string, m map<string,string>")
    assert df.select(catalog.resolve_params(F.col("t"), F.col("m")).alias("r")).first().r == "Do x $5 and [zz]"


def test_labels_titles_props(spark):
    df = spark.createDataFrame([("ac-6.5", ["AC-06(05)", "AC-6(5)"], "Control: AC-6(5)")], "id string, labels array<string>, title string")
    label, rest = catalog.preferred_label(F.col("labels"), F.col("id"))
    r = df.select(label.alias("l"), rest.alias("r"), catalog.real_title(F.col("title"), F.col("id"), label).alias("t")).first()
    assert (r.l, r.r, r.t) == ("AC-6(5)", ["AC-06(05)"], None)


def test_part_text_and_parents(spark):
    p = spark.createDataFrame([("u", [1], "", "Do:"), ("u", [1, 2], "b.", "that"), ("u", [1, 1], "a.", "this")], "control_uid string, path array<int>, label string, prose string")
    assert catalog.part_text(p).first().text == " Do:\n  a. this\n  b. that"


def test_gaps_positions_fill(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 4, ""), (1, 2, "")], "g long, n long, s string")
    assert [(r.g, r.n) for r in catalog.numbering_gaps(df, "g", "n").collect()] == [(1, 3)]
    assert [r.identifier for r in catalog.positional_ids(df, "g", ["n"]).orderBy("n").collect()] == ["1.1", "1.2", "1.3"]
    assert [r.s for r in catalog.forward_fill(df, "g", "n", ["s"]).orderBy("n").collect()] == ["x", "x", "x"]


def test_source_audit(spark, tmp_path):
    import hashlib

    (tmp_path / "a.txt").write_bytes(b"a")
    (tmp_path / "b.txt").write_bytes(b"b")
    (tmp_path / "d.txt").write_bytes(b"d")
    m = spark.createDataFrame([("a.txt", hashlib.sha256(b"a").hexdigest()), ("b.txt", "0"), ("c.txt", "0")], "filename string, sha256 string")
    got = {r.filename: r.state for r in catalog.source_audit(spark, str(tmp_path), m).collect()}
    assert got == {"a.txt": "available", "b.txt": "changed", "c.txt": "missing", "d.txt": "unlisted"}


def test_threat_graph(spark):
    t = spark.createDataFrame([("t1", 1), ("t1", 2)], "technique_id string, load_seq long")
    m = spark.createDataFrame([("m1", 1)], "mitigation_id string, load_seq long")
    e = spark.createDataFrame([("m1", "t1", "mitigates"), ("m1", "t9", "mitigates"), ("m1", "t1", "uses")], "mitigation_id string, technique_id string, kind string")
    a, b, good, bad = catalog.threat_graph(t, m, e)
    assert (a.count(), b.count(), good.count(), [r.technique_id for r in bad.collect()]) == (1, 1, 1, ["t9"])


def test_mend_and_sentences(spark):
    df = spark.createDataFrame([("d", "secu-\nrity and 12-\nand 24-hour, 30 days12 more")], "doc string, text string")
    assert df.select(texts.mend(F.col("text")).alias("m")).first().m == "security and 12- and 24-hour, 30 days more"
    s = spark.createDataFrame([("d", "Short. The verifier SHALL lock the account after at least 10 failed tries, e.g. A bad one. Nothing normative is stated here for 10 days at all.")], "doc string, text string")
    assert [r.parameters for r in texts.normative_sentences(s).collect()] == [["bound"]]


def test_html_and_markdown(spark):
    html = "<h2>One</h2><h3>In</h3><p>" + "word " * 10 + "</p><li>short</li><h2>Two</h2><li>" + "item " * 10 + "</li>"
    got = texts.html_statements(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("pos").collect()
    assert [(r.section, r.heading) for r in got] == [("1.1", "In"), ("2.0", "Two")]
    md = "intro\n#### AA.1 title\nDo this.\nAnd that.\n## next\nno\n#### AA.2\nSecond.\n"
    assert [(r.identifier, r.statement) for r in texts.markdown_blocks(spark.createDataFrame([("d", md)], "doc string, text string")).collect()] == [("AA.1", "Do this. And that."), ("AA.2", "Second.")]


def test_blocks_letters_labels_tables(spark):
    b = spark.createDataFrame([("d", 1, "toc", "x"), ("d", 2, "sec", "8 Duty"), ("d", 3, "par", "(a) one"), ("d", 4, "sec", "9 More")], "doc string, idx long, style string, text string")
    got = texts.assemble_provisions(b, F.col("style") == "sec", F.col("style") == "toc").orderBy("nth").collect()
    assert [(r.heading_idx, r.text) for r in got] == [(2, "8 Duty\n(a) one"), (4, "9 More")]
    items = spark.createDataFrame([("s", 1, "You must:"), ("s", 2, "(a) do"), ("s", 3, "it"), ("s", 4, "(b) say"), ("t", 1, "Alone")], "section string, idx long, text string")
    assert {(r.section, r.text) for r in texts.lettered_items(items).collect()} == {("s", "You must: (a) do it"), ("s", "You must: (b) say"), ("t", "Alone")}
    lines = spark.createDataFrame([("d", 1, "1.1 not one"), ("d", 2, "1.2 Real"), ("d", 3, "title"), ("d", 4, "Profile: L1"), ("d", 5, "Desc: what"), ("d", 6, "more")], "doc string, idx long, text string")
    got = {(r.label, r.text) for r in texts.labelled_blocks(lines, r"^\d\.\d ", "^Profile:", ["Profile", "Desc"], within=2).collect()}
    assert got == {("title", "1.2 Real title"), ("Profile", "Profile: L1"), ("Desc", "Desc: what more")}
    cells = spark.createDataFrame([("t", 0, 0, ""), ("t", 0, 1, "Key"), ("t", 1, 0, "AES"), ("t", 1, 1, "128"), ("t", 1, 2, "")], "table string, row int, col int, val string")
    assert [r.text for r in texts.fold_tables(cells).collect()] == ["AES; Key: 128"]


def test_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x long, k string")
    sinks.write(df, str(tmp_path / "o"), "csv", by=["k"])
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).count() == 2


def test_audit_of_a_file_longer_than_a_value(spark, tmp_path):
    """Two GB that take no disk, and a name with a blank; small files are read by tasks, large ones by a stream."""
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a b.bin").write_bytes(b"x" * 100)
    with open(tmp_path / "long.bin", "wb") as f:
        f.truncate(1 << 31)
    digest = hashlib.sha256()
    for _ in range(128):
        digest.update(bytes(1 << 24))
    want = {"a b.bin": hashlib.sha256(b"x" * 100).hexdigest(), "long.bin": digest.hexdigest()}
    assert {r.filename: r.state for r in catalog.source_audit(spark, str(tmp_path), spark.createDataFrame(list(want.items()), "filename string, sha256 string")).collect()} == dict.fromkeys(want, "available")
    (tmp_path / "long.bin").unlink()
    assert {r.filename: r.sha256 for r in catalog.file_digests(spark, str(tmp_path), whole=10).collect()} == {"a b.bin": want["a b.bin"]}

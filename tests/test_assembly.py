from pyspark.sql import functions as F

from ledgerline.operators import assembly, search
from ledgerline.sources import extracts

CONTROLS = "uid string, framework_key string, title string, text string, section_ref string, structural boolean"


def test_neighbours_leave_out_own_document_and_links(spark):
    text = "Backups of servers are tested and restored yearly."
    rows = [("a:1", "a", "Backups", text, "", False), ("a:2", "a", "Backups", text, "", False), ("b:1", "b", "Backups", text, "", False), ("c:1", "c", "Backups", text, "", False), ("d:1", "d", "Other", "Statues stand in the yard.", "", False)]
    controls = spark.createDataFrame(rows, CONTROLS)
    frameworks = spark.createDataFrame([(k, 4) for k in "abcd"], "framework_key string, tier int")
    links = spark.createDataFrame([("c:1", "a:1", "published", "relates", "c", 1)], "source_uid string, target_uid string, provenance string, kind string, asserted_by string, load_seq long")
    found = assembly.subject_neighbours(spark.createDataFrame([("a:1",)], "uid string"), controls, frameworks, links, search.build_index(controls))
    assert [(r.uid, r.neighbour) for r in found.collect()] == [("a:1", "b:1")]


def test_preview_of_nothing(spark):
    none = spark.createDataFrame([], "uid string, identifier string, text string")
    assert [(r.problem, r.key) for r in assembly.preview(none).collect()] == [("number of controls", "0")]


def test_a_refused_control_has_nothing_else(spark):
    rows = [("a", None, None, False, None), ("b", "", "Logs are kept every day by personnel.", None, []), ("c", "x", "y", True, None)]
    controls = spark.createDataFrame(rows, "uid string, title string, text string, structural boolean, ancestor_titles array<string>")
    out = assembly.derive_all(controls, [("record", "Logs"), ("periodic", "every")], [], spark.createDataFrame([("record", "logs are lost")], "archetype string, risk string"), spark.createDataFrame([], "uid string, figures array<string>"))
    got = {r.uid: r for r in out.collect()}
    assert got["a"].refusal == "no text" and got["c"].refusal == "structural" and got["a"].test is None and got["c"].risk is None
    assert got["b"].archetypes == ["record", "periodic"] and got["b"].risk.startswith("There is a risk that logs are lost.")


def test_statement_and_section_never_collide(spark):
    rows = [("v", "3.2", "MUST", "a", ["x"], 1), ("v", "3.2.1", None, "b", None, 2), ("v", "3.2", "Shall Not", "c", [], 3), ("v", "4", "MAY", None, None, 4)]
    df = spark.createDataFrame(rows, "group_key string, section_number string, keyword string, text string, parameters array<string>, load_seq long")
    out = {r.uid: (r.parent_uid, r.obligation, r.n_parameters) for r in extracts.grouped_statements(df, "f").collect()}
    assert out["f:v §3.2#2"] == ("f:v §3.2", "prohibited", 0) and out["f:v §3.2.1#1"] == ("f:v §3.2.1", "unknown", 0) and out["f:v §3.2#1"][2] == 1
    assert len(out) == 6 and "f:v §4" not in out


def test_incorporations_fall_back_to_headings(spark):
    rows = spark.createDataFrame([("p", "The Core Standard", None), ("q", "Nothing known", None), ("r", None, None)], "source_uid string, cell string, condition string")
    phrases = spark.createDataFrame([("standard", "b", 1), ("core", "a", 0)], "phrase string, framework_key string, ord int")
    roots = spark.createDataFrame([("a:1", "a", True), ("a:2", "a", True), ("b:1", "b", False)], "uid string, framework_key string, structural boolean")
    links, rest = extracts.incorporations(rows, phrases, roots)
    assert {(r.source_uid, r.target_uid) for r in links.collect()} == {("p", "a:1"), ("p", "a:2")} and {r.source_uid for r in rest.collect()} == {"q", "r"}


def test_moved_class_is_checked(spark):
    controls = spark.createDataFrame([("a:1", "a", "1", "t", True), ("a:2", "a", "2", "", True), ("a:3", "a", "3", "u", None)], "uid string, framework_key string, identifier string, text string, m boolean")
    out, aliases, problems = extracts.move_class(controls, F.col("m"), "b", spark.createDataFrame([("1",), ("9",)], "identifier string"))
    assert {r.uid for r in out.collect()} == {"b:1", "b:2", "a:3"} and {r.old_uid for r in aliases.collect()} == {"a:1", "a:2"}
    assert {(r.identifier, r.problem) for r in problems.collect()} == {("2", "unexpected"), ("2", "empty"), ("9", "missing")}


def test_candidate_mentions_bounds_words_by_ascii_letters(spark):
    """As RE2 does: a letter beyond ASCII is no part of a word, so a boundary lies behind it; an escaped backslash is none."""
    controls = spark.createDataFrame([("a:1", "a", "", "éABCDEFGH!! so"), ("a:2", "a", "", "xABCDEFGH!! no"), ("a:3", "a", "", r"at c:\build")], "uid string, framework_key string, title string, text string")
    candidates = spark.createDataFrame([("shout", r"\b[A-Z]{8,}!!", ["a:1"]), ("inside", r"x\B[A-Z]{8}", ["a:1"]), ("folder", r"c:\\b", ["a:1"])], "candidate string, pattern string, uids array<string>")
    families, details = spark.createDataFrame([("a", "f")], "framework_key string, family string"), spark.createDataFrame([], "broad_uid string, uid string")
    counts, _ = assembly.candidate_mentions(controls, candidates, families, details)
    assert sorted(tuple(r) for r in counts.collect()) == [("folder", "f", 1), ("inside", "f", 1), ("shout", "f", 1)]


def test_plan_rows_deal_each_row_once(spark):
    """A text that is stated again and again is told apart where it is read: no more rows are dealt than there are different ones."""
    related = spark.range(200_000, numPartitions=2).select(F.concat(F.lit("u"), (F.col("id") % 3).cast("string")).alias("uid"), F.lit("f").alias("source_uid"))
    derived = spark.createDataFrame([("u0", None, "t0"), ("u1", "structural", None)], "uid string, refusal string, test string")
    none = spark.createDataFrame([], "uid string, content string, detail_id int")
    out = assembly.test_plan_rows(derived, none.select("uid", "content"), related, none.select("uid", "detail_id"))
    assert sorted(tuple(r) for r in out.collect()) == [("u0", "derived", "t0"), ("u0", "related", "f"), ("u1", "refusal", "structural"), ("u1", "related", "f")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in plan.split("\n") if "LeftSemi" in line]
    assert joined and "Aggregate" in plan.split("LeftSemi")[1].split("Project")[0]

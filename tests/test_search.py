"""Topical search: phrases on places, concepts and their traps, reasons, neighbours."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import rules
from ledgerline.functions.text import stem_of, with_stem
from ledgerline.operators import assembly, search, vocabulary

CONTROLS = "uid string, framework_key string, title string, text string, section_ref string, structural boolean"


def controls_of(spark, rows):
    return spark.createDataFrame([(uid, uid[0], title, text, section, False) for uid, title, text, section in rows], CONTROLS)


@pytest.fixture(scope="module")
def made(spark):
    rows = [
        ("a:1", None, "The end of support is near, and the risk register grows.", None),
        ("a:2", "Risk register", "Keep what is at stake in view.", None),
        ("a:3", None, "Archive the log of archives; register the risks of it.", "risk register"),
        ("b:1", None, "Multi-factor authentication of every user; application control is kept.", None),
        ("b:2", None, "The eight strategies are essential: the essential eight.", None),
        ("b:3", None, "Logs archive each other. A log archive is whole. The log archive. Log archive log archive.", None),
        ("c:1", "Register", "A register of the risk", None),
    ]
    controls = controls_of(spark, rows)
    return controls, search.build_index(controls)


def concepts_of(spark, rows):
    return spark.createDataFrame(rows, "concept string, phrase string, ord int, side string")


def scores(spark, made, concepts, queries, excluded=None):
    controls, index = made
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, text string")
    shut = None if excluded is None else spark.createDataFrame(excluded, "concept string, phrase string")
    found = vocabulary.concept_scores(asked, controls, concepts_of(spark, concepts), index, shut)
    return {(r.query_id, r.uid): r.conceptual for r in found.collect()}


def test_phrases_with_stopwords_are_said_nowhere(spark, made):
    """A query names the concept, but the index has no place for its stopword."""
    assert scores(spark, made, [("eos", "end of support", 0, None)], ["what is the end of support"]) == {}
    texts = made[0].select("uid", "text")
    assert [r.uid for r in vocabulary.concepts_in(texts, concepts_of(spark, [("eos", "end of support", 0, None)])).collect()] == ["a:1"]


def test_concept_in_the_title_and_over_stopwords(spark, made):
    """In a title, over a dropped stopword and from the text into the title; not in the section, not in another order."""
    got = scores(spark, made, [("rr", "risk register", 0, None)], ["our risk registers"])
    assert set(got) == {(0, "a:1"), (0, "a:2"), (0, "c:1")}


def test_first_phrase_of_a_concept_counts(spark, made):
    index = made[1]
    length = {r.uid: r.length for r in index.doc_stats.collect()}
    average = sum(length.values()) / len(length)
    saturated = lambda n, uid: n / (n + rules.K1 * (1 - rules.B + rules.B * length[uid] / average))
    got = scores(spark, made, [("l", "log archive", 0, None), ("l", "archive log", 1, None)], ["log archive"])
    # five places without stopwords, but neighbours share the blank between them
    n = " log archiv log archiv whole log archiv log archiv log archiv ".count(" log archiv ")
    assert n == 3 and math.isclose(got[(0, "b:3")], saturated(n, "b:3")) and set(got) == {(0, "a:3"), (0, "b:3")}
    assert math.isclose(got[(0, "a:3")], saturated(1, "a:3"))


def test_exclusions_compare_stems_as_substrings(spark, made):
    concept = [("l", "archive log", 0, None), ("l", "log archive", 1, None)]
    assert set(scores(spark, made, concept, ["log archive"], [("l", "logs archives")])) == {(0, "a:3")}
    # one excluded phrase anywhere is enough, also within a word
    assert scores(spark, made, concept, ["log archive"], [("l", "g archive"), ("l", "register the")]) == {}
    assert scores(spark, made, concept, ["log archive"], [("other", "log")]) == scores(spark, made, concept, ["log archive"])


def test_groups_do_not_fan_out(spark, made):
    concepts = [("e8", "application control", 0, "query"), ("e8", "multi-factor authentication", 1, "query"), ("e8", "essential eight", 2, None)]
    assert set(scores(spark, made, concepts, ["application control"])) == {(0, "b:2")}
    assert {r.uid for r in vocabulary.concepts_in(made[0].select("uid", "text"), concepts_of(spark, concepts)).collect()} == {"b:2"}
    asked = spark.createDataFrame([(1, "application controls"), (2, "nothing")], "query_id long, text string")
    assert [r.query_id for r in vocabulary.concepts_for(asked, concepts_of(spark, concepts)).collect()] == [1]


def test_occurrences_are_counted_as_text_replacement_does(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("ab") * 3 for _ in range(rng.randint(0, 14)))) for k in range(60)]
    phrases = [("p", " ".join(rng.choice("ab") * 3 for _ in range(n))) for n in (1, 2, 3) for _ in range(6)]
    found = vocabulary.phrases_in(spark.createDataFrame(rows, "uid long, text string"), spark.createDataFrame(phrases, "concept string, phrase string"))
    got = {(r.uid, r.phrase): r.n for r in found.collect()}
    want = {(k, p): n for k, t in rows for _, p in phrases if (n := f" {t} ".count(f" {p} "))}
    assert got == want


def test_phrase_bonus(spark, made):
    controls, index = made
    frameworks = spark.createDataFrame([("a", None), ("b", None), ("c", None)], "framework_key string, tier int")
    queries = spark.createDataFrame([(1, "risk register"), (2, "risk of register"), (3, "log archive log")], "query_id long, text string")
    got = {(r.query_id, r.uid): r.phrase for r in search.search(queries, controls, frameworks, index).collect()}
    assert got[(1, "a:1")] and got[(1, "a:2")] and got[(1, "c:1")] and not got[(1, "a:3")]
    assert not any(v for (q, _), v in got.items() if q == 2) and got[(3, "b:3")] and not got[(3, "a:3")]


def test_reasons(spark, made):
    controls, index = made
    frameworks = spark.createDataFrame([("a", 2), ("b", None), ("c", 5)], "framework_key string, tier int")
    queries = spark.createDataFrame([(1, "risk register")], "query_id long, text string")
    aliases = spark.createDataFrame([("risk", ["at", "stake"])], "token string, expansion array<string>")
    terms = search.query_terms(queries, index, aliases)
    concepts = concepts_of(spark, [("rr", "risk register", 0, None)])
    asked = vocabulary.concepts_for(queries, concepts)
    found = vocabulary.concept_hits(asked, controls, concepts, index)
    hits = search.search(queries, controls, frameworks, index, aliases=aliases, concepts=vocabulary.best_concepts(asked, found, index))
    hits = hits.join(frameworks, "framework_key").withColumn("structural", F.col("uid") == "c:1")
    why = assembly.explain(hits, search.evidence(hits, terms, index), vocabulary.concept_notes(hits, asked, found))
    got = {r.uid: [(x.kind, x.what, x.field) for x in r.reasons] for r in why.collect()}
    assert got["a:1"] == [("term", "risk", "text"), ("term", "register", "text"), ("concept", "risk register", "rr"), ("all terms", "2", None), ("phrase", None, None), ("tier", "2", None)]
    assert got["a:2"][:2] == [("term", "risk", "title"), ("term", "register", "title")]
    assert got["c:1"] == [("term", "risk", "text"), ("term", "register", "title"), ("concept", "risk register", "rr"), ("all terms", "2", None), ("phrase", None, None), ("heading", None, None)]
    shares = [x.share for x in next(r.reasons for r in why.collect() if r.uid == "a:1") if x.kind == "term"]
    assert math.isclose(sum(shares), 1.0)


def test_threshold_join_loses_nothing(spark):
    """Under a floor the pruned scores are those of the whole join, for every pair that reaches it."""
    rng = random.Random(5)
    words = [f"w{k}x" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    rows = [(f"{'abc'[k % 3]}:{k}", " ".join(rng.choices(words, weights, k=2)), " ".join(rng.choices(words, weights, k=rng.randint(1, 30))), None) for k in range(120)]
    controls = controls_of(spark, rows)
    index = search.build_index(controls)
    terms = search.query_terms(controls.select(F.col("uid").alias("query_id"), F.concat_ws(" ", "title", "text").alias("text")), index)
    row = lambda r: (r.query_id, r.uid, round(r.literal, 9), round(r.coverage, 9), r.n_matched)
    whole = search.literal_scores(terms, index).collect()
    for least in (0.05, 0.29, 0.6):
        got = {row(r) for r in search.literal_scores(terms, index, least).collect()}
        assert got <= {row(r) for r in whole}
        assert {row(r) for r in whole if r.literal >= least or r.n_matched == r.n_terms} <= got and len(got) < len(whole)


def test_neighbours_read_a_bounded_list(spark):
    """Twenty-four rows beside the limit and the links are read: copies in the control's own framework can fill them."""
    text = "Backups of servers are tested and restored yearly."
    rows = [(f"a:{k}", "Backups", text, None) for k in range(40)] + [("b:1", "Backups", text, None), ("c:1", None, "Statues stand.", None)]
    controls = controls_of(spark, rows)
    frameworks = spark.createDataFrame([("a", 1), ("b", 4), ("c", 4)], "framework_key string, tier int")
    links = spark.createDataFrame([], "source_uid string, target_uid string, provenance string, kind string, asserted_by string, load_seq long")
    one = spark.createDataFrame([("a:1",)], "uid string")
    assert assembly.subject_neighbours(one, controls, frameworks, links, search.build_index(controls)).count() == 0
    assert assembly.subject_neighbours(one, controls, frameworks, links, search.build_index(controls), spare=60).count() == 1


def test_postings_of_a_batch_are_those_of_meeting_tokens(spark):
    """Counted where a text is read, without a shuffle: the same as by tokens that meet; empty, null and stopword texts, repeated stems, letters beyond ASCII, uids that stand twice."""
    rows = [(f"u{k}", "the of" if k % 7 == 0 else f"Tests tested testing backup's {k % 5} ünder the servers' organisations", None if k % 3 else "Backups of tests", "" if k % 2 else "sec 1 test") for k in range(600)] + [("v", None, None, None), (None, "backup", "x", None)]
    controls = spark.createDataFrame(rows, "uid string, text string, title string, section_ref string")
    row = lambda r: (str(r.uid), r.stem, r.tf_body, r.tf_title, r.tf_section, tuple(r.places))
    got, want = (sorted(map(row, df.collect())) for df in (search.posted(controls, "uid", search.FIELDS, False), search._posted_by_words(controls)))
    assert got == want and len(got) > 1000
    plan = search.posted(controls, "uid", search.FIELDS, False)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    twice = search.build_index(controls.union(controls.where("uid = 'u1'"))).postings.where("uid = 'u1' and stem = 'test'").first()
    assert (twice.tf_body, twice.tf_title) == (6, 0) and search.build_index(controls).postings.inputFiles()


def test_stems_in_python_and_in_spark_agree(spark):
    words = ["".join(w) + x for w in ("ab", "bless", "organ", "adv", "runn", "sse", "ox", "c'e", "colo") for x in ("", "s", "ss", "es", "ing", "ed", "ies", "ied", "ation", "ations", "isations", "ise", "ised", "izers", "our", "e", "ning")] + [*rules.SPELLINGS, *rules.KEEP_ISE]
    assert all(r.stem == stem_of(r.token) for r in with_stem(spark.createDataFrame([(w,) for w in words], "token string")).collect())

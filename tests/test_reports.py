"""Lineage, matching, thresholds, topics, audits on literals."""

import hashlib
import os
import random

from ledgerline.operators import graph, reports, thresholds
from ledgerline.operators.common import phrases_said
from ledgerline.plans import document_queries as Q


def test_lineage_orders_neighbours_and_tells_why_a_band_is_empty(spark):
    links = spark.createDataFrame(
        [("a:1", "c:1", "relates", "published", "c", 5), ("b:1", "a:1", "relates", "published", "b", 1), ("a:1", "b:1", "aligns-with", "published", "a", 9), ("a:2", "b:2", "relates", "derived", None, 2)],
        "source_uid string, target_uid string, kind string, provenance string, asserted_by string, load_seq long",
    )
    frameworks = spark.createDataFrame([("a", "A", 1, 0, 0), ("b", "B", 2, 1, 0), ("c", "C", 2, 0, 0)], "framework_key string, short_name string, tier int, jurisdiction int, intra_order int")
    got = graph.lineage(spark.createDataFrame([("a:1",), ("a:2",), ("z:1",)], "uid string"), links, frameworks).collect()
    rows = {(r.uid, r.provenance, r.nth): (r.other_uid, r.outward, r.load_seq, r.note) for r in got}
    # jurisdiction 0 before 1; two links to b:1 take two places, both with the incoming one, which was read last
    assert [rows["a:1", "published", k] for k in (1, 2, 3)] == [("c:1", True, 5, None), ("b:1", False, 1, None), ("b:1", False, 1, None)]
    assert rows["a:1", "derived", None][3] == "nothing was matched to this control" == rows["z:1", "derived", None][3]
    assert rows["a:1", "published-tag", None][3] == "A has published-tag links, none of this control" and rows["z:1", "published", None][3] == "nobody maps z"
    assert rows["a:2", "derived", 1][0] == "b:2" and len(rows) == 3 + 2 + 3 + 3


def test_lineage_takes_the_same_of_two_links_loaded_at_once(spark):
    rows = [("a:1", "b:1", kind, "published", "a", 5) for kind in ("incorporates", "relates")]
    frameworks = spark.createDataFrame([("a", "A", 1, 0, 0)], "framework_key string, short_name string, tier int, jurisdiction int, intra_order int")
    for order in (rows, rows[::-1]):
        links = spark.createDataFrame(order, "source_uid string, target_uid string, kind string, provenance string, asserted_by string, load_seq long").coalesce(1)
        got = graph.lineage(spark.createDataFrame([("a:1",)], "uid string"), links, frameworks, ["published"]).collect()
        assert [(r.nth, r.other_uid, r.kind) for r in got] == [(1, "b:1", "relates"), (2, "b:1", "relates")]


def test_threat_match_prunes_nothing_that_counts(spark):
    rng = random.Random(4)
    stems = [f"s{k}" for k in range(30)]
    weight = {s: 1 + rng.random() * 5 for s in stems}
    texts = {f"u{k}": set(rng.sample(stems, rng.randint(1, 12))) for k in range(40)}
    names = {m: (set(rng.sample(stems, rng.randint(1, 4))), set(rng.sample(stems, 12))) for m in range(12)}
    shared = {(f"u{rng.randint(0, 39)}", rng.randint(0, 11)) for _ in range(15)}
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = graph.threat_match(
        df([(u, s) for u, ss in texts.items() for s in ss], "uid string, stem string"),
        df([(m, p, s) for m, parts in names.items() for p, ss in zip(("name", "body"), parts, strict=True) for s in ss], "mitigation_id int, part string, stem string"),
        df(list(weight.items()), "stem string, weight double"), df(sorted(shared), "uid string, mitigation_id int"),
    )
    want = set()
    for u, said in texts.items():
        of = {}
        for m, (name, body) in names.items():
            share = lambda part, whole: sum(weight[s] for s in part) / sum(weight[s] for s in whole)
            score = round(min(1, 0.65 * share(name & said, name) + 0.20 * share(body & said, said) + 0.45 * ((u, m) in shared)), 6)
            if score >= 0.45:
                of[m] = score
        best = sorted(((-v, m) for m, v in of.items() if v >= 0.75 * max(of.values())))[:3]
        want |= {(u, m, -v) for v, m in best}
    assert {(r.uid, r.mitigation_id, r.score) for r in got.collect()} == want and want


def test_thresholds_of_title_and_text(spark):
    rows = [("a", "Review within 30 days", "Keep logs for at least 12 months."), ("b", None, "Keep logs for at least 90 days (3 months)."), ("c", "At least", "14 characters are used."), ("d", None, None)]
    got = {(r.uid, r.value, r.unit, r.bound) for r in thresholds.stated_by(spark.createDataFrame(rows, "uid string, title string, text string")).collect()}
    assert {("a", 30.0, "day", "at most"), ("a", 12.0, "month", "at least"), ("b", 90.0, "day", "at least")} <= got
    assert not [r for r in got if r[0] == "b" and r[1] == 3.0] and [r[2] for r in got if r[0] == "c"] == ["character"]


def test_topics(spark):
    rows = [(k, "f" if k % 2 else "g", "backup" if k < 25 else "patch", k) for k in range(30)] + [(99, "h", "nothing", 99)]
    entries = spark.createDataFrame(rows, "uid long, family string, text string, load_seq long")
    report = reports.topic_report(entries, [("b", "Backups", "(?i)BACKUP"), ("p", "Patching", "patch"), ("n", "None", "zzz")], ["Backups", "Patching", "Logging"])
    assert [(r.code, r.n, r.families, r.band, r["rank"]) for r in report.topics.orderBy("rank").collect()] == [("b", 25, 2, 2, 1), ("p", 5, 2, 1, 2), ("n", 0, 0, 1, 3)]
    shares = {r.code: r.mean_share for r in report.topics.collect()}
    assert shares["b"] == round((12 / 15 + 13 / 15) / 3 * 100, 2) and shares["n"] == 0
    assert [r.uid for r in report.samples.where("code = 'b'").orderBy("nth").collect()] == list(range(8)) and report.samples.where("code = 'p'").count() == 5
    assert {r.band: r.n for r in report.ratings.collect()} == {1: 2, 2: 1, 3: 0, 4: 0, 5: 0}
    assert {(r.problem, r.topic) for r in report.problems.collect()} == {("no pattern", "Logging"), ("unknown topic", "None")}


def test_audit_of_the_given_files(spark, sf_dir):
    got = {r.filename: (r.state, r.known_as) for r in Q.source_audit(spark, sf_dir).collect()}
    digest = lambda f: hashlib.sha256(open(os.path.join(sf_dir, f), "rb").read()).hexdigest()
    want = {}
    for f in os.listdir(sf_dir):
        if f[0] == "r":
            want[f], want[f"old-{f}"] = ("unlisted", f"old-{f}"), ("missing", None)
        else:
            want[f] = ("unlisted", None) if f[0] == "p" else ("changed" if f[0] == "n" else "available", None)
    assert got == want and len({digest(f) for f in os.listdir(sf_dir)}) == len(os.listdir(sf_dir))


def test_clauses_meet_only_their_own_subjects(spark):
    stated = spark.createDataFrame([(1, "x", 5), (1, "y", 6), (2, "x", 7), (3, "z", 8)], "subject_id int, clause string, v int")
    clauses = spark.createDataFrame([("x", "c1"), ("y", "c2"), ("z", "c3")], "clause string, concept string")
    subjects = spark.createDataFrame([(1, "c1"), (2, "c2")], "subject_id int, concept string")
    assert {r.v: r.on_subject for r in thresholds.on_subject(stated, clauses, subjects).collect()} == {5: True, 6: False, 7: False, 8: True}


def test_phrases_in_one_run_and_by_rarest_gram(spark):
    """The automaton and the join find the same: overlapping and nested phrases, other cases, empty and null ones, short and long texts."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abAB ") for _ in range(n))
    phrases = sorted({word(rng.randint(1, 6)) for _ in range(60)} | {"", "É", "zz"})
    texts = [(k, word(rng.randint(0, 40))) for k in range(80)] + [(90, None), (91, ""), (92, "aé" * 3000)]
    want = {(k, p) for k, t in texts if t is not None for p in phrases if p.lower() in t.lower()}
    df, ps = spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame([(p,) for p in [*phrases, None]], "phrase string")
    for most in (1000, 5):
        got = [(r.k, r.phrase) for r in phrases_said(df, ps, "k", most).collect()]
        assert set(got) == want and len(got) == len(want)
    assert phrases_said(df, ps.limit(0), "k").count() == 0


def test_topics_bound_words_by_ascii_letters(spark):
    """As RE2 does: a letter beyond ASCII is no part of a word, so a boundary lies behind it."""
    entries = spark.createDataFrame([(1, "f", "éABCDEFGH!! so", 1), (2, "f", "xABCDEFGH!! no", 2), (3, "g", "le théâtre, the", 3)], "uid long, family string, text string, load_seq long")
    report = reports.topic_report(entries, [("s", "Shouting", r"\b[A-Z]{8,}!!"), ("t", "A th", r"\bth\b")], [])
    assert sorted(tuple(r) for r in report.families.collect()) == [("s", "f", 1), ("t", "g", 1)]
    assert sorted((r.code, r.n, r.mean_share) for r in report.topics.collect()) == [("s", 1, 25.0), ("t", 1, 50.0)]
    topics = spark.createDataFrame([("shouting", r"\b[A-Z]{8,}!!"), ("th", r"\bth\b")], "topic string, pattern string")
    assert sorted((r.topic, r.n, r.mean_share) for r in reports.topic_prevalence(entries, topics).collect()) == [("shouting", 1, 25.0), ("th", 1, 50.0)]

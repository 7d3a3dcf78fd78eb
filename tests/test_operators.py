import random

from pyspark.sql import functions as F

from ledgerline.operators import corpus, graph, lookup, reports, search, shape, thresholds


def test_thresholds_read_bounds(spark):
    cases = {
        "Retain logs for at least 90 days.": (90.0, "day", "at least", False),
        "It must not be shorter than 28 days.": (28.0, "day", "at least", False),
        "Sessions end after no more than 60 seconds.": (60.0, "second", "at most", False),
        "Review at least every 24 months.": (24.0, "month", "at most", False),
        "A minimum notification period of one month applies.": (1.0, "month", "at least", True),
        "Not set to greater than 1440 minutes": (1440.0, "minute", "at most", False),
    }
    rows = thresholds.thresholds(spark.createDataFrame([(k, k) for k in cases], "uid string, text string")).collect()
    assert {r.uid: (r.value, r.unit, r.bound, r.inferred) for r in rows} == cases


def test_rates_and_restatements(spark):
    df = spark.createDataFrame([("a", "Open 24 hours per day."), ("b", "less than 24 hours (86400 seconds)"), ("c", None)], "uid string, text string")
    rows = thresholds.thresholds(df).orderBy("uid", "nth").collect()
    assert [(r.uid, r.value, r.restates) for r in rows] == [("b", 24.0, False), ("b", 86400.0, True)]


def test_obligation(spark):
    df = spark.createDataFrame([("must not do",), ("shall do",), ("may do",), ("does",)], "t string")
    assert [r[0] for r in df.select(thresholds.obligation_of(F.col("t"))).collect()] == ["prohibited", "mandatory", "permitted", "informative"]


def test_merge_keeps_generated_then_first(spark):
    df = spark.createDataFrame([("a", "shipped", 1), ("a", "generated", 2), ("b", "shipped", 3), ("b", "shipped", 4)], "uid string, origin string, load_seq long")
    kept, warned = corpus.merge_controls(df)
    assert {(r.uid, r.load_seq) for r in kept.collect()} == {("a", 2), ("b", 3)}
    assert [(r.key, r.load_seq) for r in warned.collect()] == [("b", 4)]


def test_jurisdiction_zero_is_a_value(spark):
    f = spark.createDataFrame([("a", 1, 0, 0), ("b", 1, None, 0)], "framework_key string, tier int, jurisdiction int, intra_order int")
    c = spark.createDataFrame([("b:1", "b"), ("a:1", "a"), ("x:1", "x")], "uid string, framework_key string")
    assert [r.uid for r in corpus.governance_order(c, f).orderBy("place").collect()] == ["a:1", "b:1", "x:1"]


def test_lookup_statuses(spark):
    controls = spark.createDataFrame([("ism:1", "ism", "ISM-0421"), ("n:1", "nist", "AC-6(5)"), ("p:1", "pspf", "Req 93"), ("q:1", "q", "AC-6(5)")], "uid string, framework_key string, identifier string")
    words = spark.createDataFrame([("nist", "nist")], "word string, framework_key string")
    gone = spark.createDataFrame([("nist", "SI-9", "AC-6")], "framework_key string, identifier string, target string")
    q = spark.createDataFrame([(k,) for k in ("421", "ac-06[05]", "nist AC-6.5", "Req 94", "multi factor", "SI-09")], "query string").withColumn("query_id", F.col("query"))
    got = {r.query_id: (r.status, r.uids) for r in lookup.lookup(q, lookup.identifier_index(controls), words, gone).collect()}
    assert got["421"] == ("unique", ["ism:1"]) and got["ac-06[05]"] == ("ambiguous", ["n:1", "q:1"]) and got["nist AC-6.5"] == ("unique", ["n:1"])
    assert got["Req 94"][0] == "none" and got["multi factor"][0] == "not-an-identifier" and got["SI-09"][0] == "withdrawn"


def test_ancestors_stop_at_cycles_and_missing_parents(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "gone")], "uid string, parent_uid string")
    got = {(r.uid, r.ancestor_uid, r.level) for r in graph.ancestors(df).collect()}
    assert got == {("b", "a", 1), ("c", "b", 1), ("c", "a", 2), ("x", "y", 1), ("y", "x", 1)}


def test_quotable_climbs_through_fragments(spark):
    df = spark.createDataFrame([("a", None, "The entity must:"), ("b", "a", "keep records; and"), ("c", "a", "Review them.")], "uid string, parent_uid string, text string")
    got = {r.uid: r.quotable for r in graph.quotable_text(df).collect()}
    assert got == {"a": "The entity must:", "b": "The entity must: keep records; and", "c": "The entity must: Review them."}


def test_chains_go_down_tiers_and_never_back(spark):
    schema = "source_uid string, target_uid string, provenance string, kind string, asserted_by string, load_seq long"
    links = spark.createDataFrame([("a:1", "b:1", "published", "incorporates", "a", 1), ("b:1", "c:1", "published", "relates", "b", 2), ("c:1", "b:2", "published", "relates", "c", 3), ("b:1", "c:9", "derived", "relates", None, 4)], schema)
    controls = spark.createDataFrame([("c:2", "c:1", 1)], "uid string, parent_uid string, load_seq long")
    tiers = spark.createDataFrame([("a", 1), ("b", 2), ("c", 4)], "framework_key string, tier int")
    found = graph.path_semantics(graph.chains(spark.createDataFrame([("a:1",)], "uid string"), links, controls, tiers))
    assert {(r.uid, r.level, r.strength, r.obligation_uid) for r in found.collect()} == {("b:1", 1, "published", "b:1"), ("c:1", 2, "published", "b:1")}


def test_not_derivable(spark):
    rows = [("a", "", "Definitions of terms used here", False, []), ("b", "", "On advice the Minister may make rules for this Act.", False, []), ("c", "", "System owners keep event logs.", False, []), ("d", "", "System owners keep event logs.", False, ["Interpretation"]), ("e", "x", "y", True, [])]
    df = spark.createDataFrame(rows, "uid string, title string, text string, s boolean, up array<string>")
    got = {r.uid: r.r for r in df.select("uid", shape.not_derivable(F.col("title"), F.col("text"), F.col("s"), F.col("up")).alias("r")).collect()}
    assert got == {"a": "definition", "b": "power of an office holder", "c": None, "d": "definition", "e": "structural"}


def test_search_ranks_and_gates(spark):
    c = [("f:1", "f", "Backups", "Backups are tested and restored yearly.", "", False), ("f:2", "f", "Passwords", "Passwords are stored hashed.", "", False), ("g:1", "g", "Other", "Restored statues stand in the yard.", "", False)]
    controls = spark.createDataFrame(c, "uid string, framework_key string, title string, text string, section_ref string, structural boolean")
    frameworks = spark.createDataFrame([("f", 4), ("g", None)], "framework_key string, tier int")
    q = spark.createDataFrame([(1, "test the backup and restore"), (2, "how"), (3, "")], "query_id long, text string")
    hits = search.search(q, controls, frameworks, search.build_index(controls)).collect()
    assert [(r.query_id, r.uid) for r in hits] == [(1, "f:1")]


def test_aliases_are_forms_of_one_term(spark):
    controls = spark.createDataFrame([("f:1", "f", "", "multi-factor authentication is used", "", False)], "uid string, framework_key string, title string, text string, section_ref string, structural boolean")
    aliases = spark.createDataFrame([("mfa", ["multi-factor", "authentication"])], "token string, expansion array<string>")
    index = search.build_index(controls)
    q = spark.createDataFrame([(1, "MFA")], "query_id long, text string")
    lit = search.literal_scores(search.query_terms(q, index, aliases), index).collect()
    assert [(r.uid, r.n_matched, round(r.coverage, 6)) for r in lit] == [("f:1", 1, 1.0)]


def test_roundtrip_verdicts(spark):
    doc = " ".join(f"word{k}" for k in range(200))
    texts = {"verbatim": "word5 word6 word7 word8 word9", "joined": "word5 word6word7 word8 word9", "near": " ".join(f"word{k}" for k in range(100) if k != 50), "absent": "nothing of this is there"}
    t = spark.createDataFrame(list(texts.items()), "uid string, text string")
    got = {r.uid: r.verdict for r in reports.roundtrip_verify(t, spark.createDataFrame([(1, doc)], "doc_id long, text string")).collect()}
    assert got["verbatim"] == "verbatim" and got["near"] == "verbatim" and got["absent"] == "absent"  # what the document has besides is passed over


def test_roundtrip_walks_from_rare_phrases(spark):
    filler = [" ".join(f"the common word{k} of line{n}" for k in range(6)) for n in range(30)]
    stock = "assets that are important to the delivery of the function"
    doc = " . ".join([*(f"{stock} kind{k} end{k}" for k in range(20)), *filler, "the seldom phrase stands here inserted marker in the middle of it", "A head line"])
    other = "quite another document without any of it at all"
    texts = {
        "late": "the seldom phrase stands here in the middle of it", "stock": f"{stock} kind17 end17", "rarest last": "zzz yyy the seldom phrase stands here",
        "half": "the seldom phrase stands here but nothing that comes then is known in any of the lines", "pieces": "the seldom phrase stands here; the common word3 of line7; the common word1 of line2", "short": "head line", "gone": "tail line", "none": " ",
        "near": "the common word0 of line4 " + " ".join(f"the common word{k} of line4" for k in range(1, 6)) + " missing", "absent": "not one of these words is to be found",
    }
    t = spark.createDataFrame(list(texts.items()), "uid string, text string")
    docs = spark.createDataFrame([(1, doc), (2, other)], "doc_id long, text string")
    got = {r.uid: (r.verdict, r.coverage) for r in reports.roundtrip_verify(t, docs).collect()}

    def brute(words, hay):
        grams = {}
        for k in range(len(hay) - 3):
            grams.setdefault(tuple(hay[k : k + 4]), []).append(k)
        starts = sorted((len(grams[g]), o) for o in range(len(words) - 3) if (g := tuple(words[o : o + 4])) in grams)[:4]
        best = 0
        for _, o in starts:
            for p in grams[tuple(words[o : o + 4])][:12]:
                n = 0
                for part, at, step in ((words[o:], p, 1), (words[:o][::-1], p - 1, -1)):
                    for w in part:
                        near = [q for q in range(at, at + 9 * step, step) if 0 <= q < len(hay) and hay[q] == w]
                        n, at = (n + 1, near[0] + step) if near else (n, at + step)
                best = max(best, n)
        return best / len(words)

    hay = doc.lower().split()
    assert {k: got[k] for k in ("late", "stock", "pieces", "short", "gone", "none")} == {"late": ("verbatim", 1.0), "stock": ("verbatim", 1.0), "pieces": ("joined", 1.0), "short": ("verbatim", 1.0), "gone": ("absent", 0.0), "none": ("empty", 1.0)}
    for k in ("rarest last", "half", "near", "absent"):
        share = brute(texts[k].split(), hay)
        assert abs(got[k][1] - share) < 1e-9 and got[k][0] == ("near" if share >= 0.97 else "partial" if share >= 0.5 else "absent"), k
    only = reports.roundtrip_verify(t, docs, spark.createDataFrame([(u, 2) for u in texts], "uid string, doc_id long")).collect()
    assert {r.verdict for r in only} == {"absent", "empty"}


def test_threat_match_reads_the_controls_share_of_the_body(spark):
    """A short control that a long description covers whole scores 0.20; the share of the description that it covers doesn't count."""
    texts = spark.createDataFrame([("a", "log"), ("a", "event"), ("b", "log"), ("b", "other"), ("c", "thing")], "uid string, stem string")
    mitigations = spark.createDataFrame([("m", "name", "log"), ("m", "name", "audit"), ("m", "body", "log"), ("m", "body", "event"), *(("m", "body", f"x{k}") for k in range(50))], "mitigation_id string, part string, stem string")
    weights = spark.createDataFrame([(s, 1.0) for s in ("log", "event", "audit", "other", "thing", *(f"x{k}" for k in range(50)))], "stem string, weight double")
    shared = spark.createDataFrame([("c", "m")], "uid string, mitigation_id string")
    got = {r.uid: r.score for r in graph.threat_match(texts, mitigations, weights, shared).collect()}
    assert got == {"a": 0.525, "c": 0.45}


def test_disagreements_lie_between_families(spark):
    rows = [("s", "time", "e8", "ism", 1, 0, "at most", 48.0), ("s", "time", "ism", "ism", 2, 0, "at most", 72.0), ("s", "time", "csf", None, 3, 0, "at least", 60.0), ("s", "time", "csf", None, 4, 0, "at least", 60.0)]
    df = spark.createDataFrame([(*r, False, False) for r in rows], "subject_id string, dimension string, framework_key string, family string, load_seq int, nth int, bound string, canonical double, classifies boolean, restates boolean")
    got = {(r.family, r.r_family, r.canonical, r.r_canonical, r.incompatible, r.pairs) for r in thresholds.disagreements(df).collect()}
    assert got == {("ism", "csf", 48.0, 60.0, True, 2), ("ism", "csf", 72.0, 60.0, False, 2)}


def test_ancestors_of_a_deep_chain_and_a_tail_into_a_cycle(spark):
    rows = [(f"n{k}", f"n{k - 1}" if k else None) for k in range(60)] + [("t2", "t1"), ("t1", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("self", "self")]
    got = {}
    for r in graph.ancestors(spark.createDataFrame(rows, "uid string, parent_uid string")).orderBy("level").collect():
        got.setdefault(r.uid, []).append(r.ancestor_uid)
    assert all(got[f"n{k}"] == [f"n{j}" for j in range(k - 1, -1, -1)] for k in range(1, 60))
    assert {k: got.get(k) for k in ("t2", "t1", "x", "y", "z", "self")} == {"t2": ["t1", "x", "y", "z"], "t1": ["x", "y", "z"], "x": ["y", "z"], "y": ["z", "x"], "z": ["x", "y"], "self": None}


def test_containment_of_long_and_short_texts(spark):
    hays = ["The quick brown fox jumps over the lazy dog, and then some more of it follows.", "Nothing", "brown fox jumps over the lazy dog and then"]
    texts = {"a": "Quick brown fox; jumps over the lazy dog and", "b": "fox jumps", "c": "brown fox jumps over the lazy cat and then", "d": "..."}
    docs = spark.createDataFrame(list(enumerate(hays)), "doc_id long, text string")
    assert {r.uid: r.n for r in reports.containment_check(spark.createDataFrame(list(texts.items()), "uid string, text string"), docs).collect()} == {"a": 1, "b": 2, "c": 0, "d": 0}


def test_families_share_a_place_in_the_shown_order(spark):
    ranked = spark.createDataFrame([(1, f"{f}:{k}", f, 1.0 - k / 100, k) for k, f in enumerate(["a", "b", "c", "d"], 1)], "query_id int, uid string, framework_key string, score double, rank int")
    frameworks = spark.createDataFrame([("a", 3, 0, 0, "x"), ("b", 2, 0, 0, "x"), ("c", 2, 0, 0, None), ("d", 1, 0, 0, None)], "framework_key string, tier int, jurisdiction int, intra_order int, family string")
    assert [r.framework_key for r in search.compose(ranked, frameworks, lead=1).orderBy("shown").collect()] == ["a", "d", "c", "b"]


def test_two_hop_counts_are_those_of_the_paths(spark):
    """Counted without a row a path; repeated links and unknown kinds count as the paths do."""
    rng = random.Random(5)
    rows = [(f"{rng.choice('abc')}:{rng.randint(0, 2)}", f"{rng.choice('abc')}:{rng.randint(0, 2)}", rng.choice(["relates", "aligns-with", None]), rng.choice(["published", "derived"]), "x", k) for k in range(60)]
    links = spark.createDataFrame([*rows, (None, "a:0", "relates", "published", "x", 99)], "source_uid string, target_uid string, kind string, provenance string, asserted_by string, load_seq long")
    of = lambda c: graph.framework_of(F.col(c))
    want = graph.two_hop_paths(links).groupBy(of("start").alias("a"), "via", of("end").alias("b"), "first_kind", "second_kind").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted(map(str, graph.two_hop_counts(links).collect())) == sorted(map(str, want)) and want
    hub = spark.range(1_000_000).select(F.concat((F.col("id") % 3).cast("string"), F.lit(":"), F.col("id").cast("string")).alias("source_uid"), F.lit("h:0").alias("target_uid"), F.lit("relates").alias("kind"), F.lit("published").alias("provenance"), F.lit("x").alias("asserted_by"), F.col("id").alias("load_seq"))
    assert graph.two_hop_counts(hub).where("via = 'h:0'").agg(F.sum("n")).first()[0] == 2 * sum(x * y for x, y in ((333_334, 333_333), (333_334, 333_333), (333_333, 333_333)))

"""Whole answers from the parts: prepared queries, routes, notes, derivations and revalidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import plain_boundaries
from ledgerline.operators import search as S
from ledgerline.operators import shape
from ledgerline.operators.common import if_small
from ledgerline.operators.corpus import preferred
from ledgerline.operators.graph import framework_of, relations
from ledgerline.operators.vocabulary import concepts_for, of_side


def prepare_queries(queries: DataFrame, aliases: DataFrame, concepts: DataFrame) -> DataFrame:
    """(query_id, stem, origin) in order of origin: typed, of an alias, of a concept; each stem once.

    ``aliases(token, expansion ARRAY)``, ``concepts(concept, phrase)``: a concept that a query names adds the stems of all its phrases.
    """
    words = S.query_stems(queries)
    typed = words.select("query_id", "stem", F.lit(0).alias("o"))
    stems = lambda rows: rows.select("query_id", F.explode(S.tokens(F.col("t"))).alias("token"))
    by_alias = stems(words.join(aliases, "token").select("query_id", F.explode("expansion").alias("t")))
    named = concepts_for(queries, concepts).join(of_side(concepts, "query"), "concept")
    by_concept = stems(named.select("query_id", F.col("phrase").alias("t")))
    parts = [typed] + [df.join(S.vocabulary(df), "token").select("query_id", "stem", F.lit(k).alias("o")) for k, df in ((1, by_alias), (2, by_concept))]
    out = parts[0].union(parts[1]).union(parts[2]).groupBy("query_id", "stem").agg(F.min("o").alias("o"))
    return out.select("query_id", "stem", F.get(F.array(F.lit("typed"), F.lit("alias"), F.lit("concept")), "o").alias("origin"))


def named_listing(named: DataFrame, controls: DataFrame, limit: int = 25) -> DataFrame:
    """(query_id, uid, rank, n): the first controls of the document that a query names, and how many it has; nothing is scored. ``named(query_id, framework_key)``.

    A query names one document, so governance order within it is that of the uids. Spark keeps ``limit`` rows a
    query in each task before it shuffles, so a document of any size may be named.
    """
    rows = named.select("query_id", "framework_key").distinct().join(controls.select("uid", "framework_key"), "framework_key")
    n = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("uid"))).where(F.col("rank") <= limit)
    return first.join(n, "query_id").select("query_id", "uid", "rank", "n")


def search_notes(queries: DataFrame, found: DataFrame, kept: DataFrame, floor: float) -> DataFrame:
    """(query_id, note): why a query has no answer; null if it has one. ``found`` are scored hits before the floor, ``kept`` those above it."""
    has = lambda df, name: df.select("query_id").distinct().withColumn(name, F.lit(True))
    out = queries.select("query_id").join(has(S.query_stems(queries), "t"), "query_id", "left").join(has(found, "f"), "query_id", "left").join(has(kept, "k"), "query_id", "left")
    note = F.when(F.col("t").isNull(), "the query has no term to search for").when(F.col("f").isNull(), "nothing loaded is about this").when(F.col("k").isNull(), f"the best match is below {floor}")
    return out.select("query_id", note.alias("note"))


def explain(hits: DataFrame, matched: DataFrame, said: DataFrame | None = None) -> DataFrame:
    """(query_id, uid, reasons): why each of ``hits(query_id, uid, n_matched, n_terms, phrase, tier, structural)`` scores as it does.

    ``reasons`` is ``array<struct<kind, what, field, share>>`` in the order terms, concepts, all terms, phrase, tier, heading. ``matched`` are the
    terms of the reported hits (``search.evidence``), ``said`` their concepts (``vocabulary.concept_notes``); both hold a bounded number of entries a hit.
    """
    one = lambda kind, what, field=None, share=None: F.struct(
        F.lit(kind).alias("kind"), what.cast("string").alias("what"), (F.lit(None) if field is None else field).cast("string").alias("field"), (F.lit(None) if share is None else share).cast("double").alias("share")
    )
    none = F.array().cast("array<struct<kind:string,what:string,field:string,share:double>>")
    out = hits.join(matched, ["query_id", "uid"], "left")
    out = out.join(said, ["query_id", "uid"], "left") if said is not None else out.withColumn("said", F.lit(None).cast("array<struct<concept:string,phrase:string>>"))
    more = [
        F.when((F.col("n_matched") == F.col("n_terms")) & (F.col("n_terms") > 1), one("all terms", F.col("n_terms"))),
        F.when(F.col("phrase"), one("phrase", F.lit(None))),
        F.when(F.col("tier").between(1, 4), one("tier", F.col("tier"))),
        F.when(F.col("structural"), one("heading", F.lit(None))),
    ]
    terms = F.transform("matched", lambda t: one("term", t["label"], t["field"], t["share"]))
    concepts = F.transform("said", lambda c: one("concept", c["phrase"], c["concept"]))
    return out.select("query_id", "uid", F.concat(F.coalesce(terms, none), F.coalesce(concepts, none), F.array_compact(F.array(*more))).alias("reasons"))


def gather(ranked: DataFrame, depth: int = 200) -> DataFrame:
    """(subject_id, uid): the set that an analysis reads, by score and not composed."""
    return ranked.where(F.col("rank") <= depth).select(F.col("query_id").alias("subject_id"), "uid")


def route(queries: DataFrame, controls: DataFrame, lookups: DataFrame, ranked: DataFrame, depth: int = 200, limit: int = 25) -> DataFrame:
    """(query_id, route, uid, place, shown): a query that is a uid, else an identifier, else a withdrawn one, else a subject.

    ``lookups(query_id, status, uids)`` as of ``lookup``; ``shown`` marks what is displayed, the rest is only analysed.
    """
    direct = queries.select("query_id", F.trim("text").alias("uid")).join(controls.select("uid"), "uid", "left_semi").select("query_id", F.lit("uid").alias("route"), "uid", F.lit(1).alias("place"))
    ids = lookups.where("status in ('unique', 'ambiguous', 'withdrawn')").join(direct.select("query_id"), "query_id", "left_anti")
    ids = ids.select("query_id", F.when(F.col("status") == "withdrawn", "withdrawn").otherwise("identifier").alias("route"), F.posexplode("uids").alias("p", "uid")).select("query_id", "route", "uid", (F.col("p") + 1).alias("place"))
    taken = direct.select("query_id").union(ids.select("query_id"))
    topical = ranked.where(F.col("rank") <= depth).join(taken, "query_id", "left_anti").select("query_id", F.lit("subject").alias("route"), "uid", F.col("rank").alias("place"))
    return direct.union(ids).union(topical).withColumn("shown", F.col("place") <= limit)


def subject_neighbours(
    uids: DataFrame, controls: DataFrame, frameworks: DataFrame, links: DataFrame, index: S.Index, limit: int = 8, least: float = 0.35, spare: int = 24, details: DataFrame | None = None
) -> DataFrame:
    """(uid, neighbour, score): what a search with a control's own title and text finds in other frameworks and isn't linked to it.

    ``controls`` may have ``quotable``, asked in place of the text, and ``title_is_shared``, where the title isn't asked. The search is a
    threshold join: a pair meets only through stems whose absence would leave it under ``least`` (``search.literal_scores``). As many hits
    are read as a control has links, and ``spare`` and ``limit`` more; among them its own, linked ones and those of its framework go.
    """
    own_text = F.coalesce("quotable", "text") if "quotable" in controls.columns else F.col("text")
    own_title = F.when(~F.coalesce("title_is_shared", F.lit(False)), F.col("title")) if "title_is_shared" in controls.columns else F.col("title")
    asked = controls.join(uids.select("uid").distinct(), "uid", "left_semi").select(F.col("uid").alias("query_id"), F.concat_ws(" ", own_title, own_text).alias("text"))
    hits = S.search(asked, controls, frameworks, index, details=details, floor=least)
    hits = hits.select(F.col("query_id").alias("uid"), F.col("uid").alias("neighbour"), "score", "framework_key", "rank")
    linked = relations(links).select("uid", F.col("other_uid").alias("neighbour")).distinct()
    n_linked = linked.groupBy("uid").agg(F.count(F.lit(1)).alias("n_linked"))
    own = controls.select("uid", F.col("framework_key").alias("__f"))
    hits = hits.join(n_linked, "uid", "left").where(F.col("rank") <= limit + spare + F.coalesce("n_linked", F.lit(0)))
    hits = hits.where("uid <> neighbour").join(linked, ["uid", "neighbour"], "left_anti").join(own, "uid").where("framework_key <> __f")
    n = F.row_number().over(Window.partitionBy("uid").orderBy("rank"))
    return hits.withColumn("n", n).where(F.col("n") <= limit).select("uid", "neighbour", "score")


def analysis_notes(readings: DataFrame, bands: DataFrame, quantities: DataFrame) -> DataFrame:
    """(subject_id, note): strengths that aren't one scale, tiers with nothing, numbers that nothing bounds, numbers of other things.

    ``readings(subject_id, short_name, way)`` with way keyword, currency or wording; ``bands(subject_id, tier, n)``;
    ``quantities(subject_id, bound, off_subject)``.
    """
    names = lambda w: F.array_join(F.array_sort(F.collect_set(F.when(F.col("way") == w, F.col("short_name")))), ", ")
    said = readings.groupBy("subject_id").agg(names("keyword").alias("k"), names("currency").alias("c"), names("wording").alias("w"))
    part = lambda c, text: F.when(F.col(c) != "", F.concat(c, F.lit(text)))
    one = F.concat(F.lit("strength is not one scale: "), F.concat_ws("; ", part("k", " by keyword"), part("c", " by a level of their own"), part("w", " by the wording only")))
    notes = said.where("c <> '' or w <> ''").select("subject_id", one.alias("note"))
    empty = bands.where("n = 0").groupBy("subject_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("tier")), lambda t: t.cast("string")), ", ").alias("t"))
    notes = notes.union(empty.select("subject_id", F.concat(F.lit("nothing at tiers "), "t")))
    q = quantities.groupBy("subject_id").agg(F.sum((~F.col("off_subject") & (F.col("bound") != "unstated")).cast("int")).alias("b"), F.sum((~F.col("off_subject")).cast("int")).alias("n"), F.sum(F.col("off_subject").cast("int")).alias("off"))
    notes = notes.union(q.where("n > 0 and b = 0").select("subject_id", F.lit("numbers stand here, none with a bound")))
    return notes.union(q.where("off > 0").select("subject_id", F.concat(F.col("off").cast("string"), F.lit(" quantities govern something else"))))


def curated_sources(texts: DataFrame, profiles: DataFrame, key: str = "uid") -> DataFrame:
    """(key, source_uid): the curated sources of the first profile that a text matches. ``profiles(pattern, uids ARRAY, ord)`` is a rule table."""
    hit = texts.join(if_small(profiles), F.expr("text rlike pattern")).groupBy(key).agg(F.min_by("uids", "ord").alias("uids"))
    return hit.select(key, F.explode("uids").alias("source_uid"))


def related_assessments(links: DataFrame, curated: DataFrame, statements: DataFrame) -> DataFrame:
    """(uid, source_uid, connection): linked controls and curated sources that have a published procedure; a link's own provenance wins over a suggestion."""
    linked = relations(links).groupBy("uid", "other_uid").agg(F.max_by("provenance", F.struct("load_seq", "provenance")).alias("connection"))
    both = linked.select("uid", F.col("other_uid").alias("source_uid"), "connection", F.lit(0).alias("o")).union(curated.select("uid", "source_uid", F.lit("suggested"), F.lit(1)))
    both = both.where("uid <> source_uid").groupBy("uid", "source_uid").agg(F.min_by("connection", "o").alias("connection"))
    published = statements.where("provenance = 'published'").select(F.col("control_uid").alias("source_uid")).distinct()
    return both.join(published, "source_uid", "left_semi").select("uid", "source_uid", "connection")


def risk_statement(risk: Column, quote: Column) -> Column:
    return F.concat(F.lit("There is a risk that "), risk, F.lit(". The requirement says: "), quote, F.lit("."))


def derive_all(controls: DataFrame, archetypes: list[tuple[str, str]], profiles: list[tuple], risks: DataFrame, figures: DataFrame) -> DataFrame:
    """(uid, refusal, archetypes, test, risk, assessment) of ``controls(uid, title, text, structural, ancestor_titles)``: a control that can't be derived from has its refusal and nothing else.

    ``figures(uid, figures ARRAY<STRING>)``; ``profiles`` and ``risks`` as of ``shape.guidance``.
    """
    read = controls.withColumn("refusal", shape.not_derivable(F.col("title"), F.col("text"), F.col("structural"), F.col("ancestor_titles")))
    open_ = read.where("refusal is null").select("uid", "text")
    kinds = shape.classify(open_, archetypes)
    listed = kinds.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "archetype"))), lambda x: x["archetype"]).alias("archetypes"))
    out = read.join(listed, "uid", "left").join(shape.guidance(kinds, open_, profiles, risks), "uid", "left").join(figures, "uid", "left")
    test = shape.test_procedure(F.get("archetypes", 0), F.col("text"), F.coalesce("figures", F.array().cast("array<string>")), F.lit(None).cast("string"))
    derived = lambda c: F.when(F.col("refusal").isNull(), c)
    return out.select("uid", "refusal", "archetypes", derived(test).alias("test"), derived(risk_statement(F.col("risk"), F.col("text"))).alias("risk"), derived(F.col("assessment")).alias("assessment"))


def candidate_mentions(controls: DataFrame, candidates: DataFrame, families: DataFrame, details: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidate, family, n): controls whose title or text matches a candidate's pattern, broad rows with a detailed one left out; and (candidate, uid) references that no control has.

    ``candidates(candidate, pattern, uids ARRAY)`` is a rule table, ``details(broad_uid, uid)``, ``families(framework_key, family)``.
    """
    hay = controls.select("uid", "framework_key", F.concat_ws(" ", "title", "text").alias("hay"))
    hit = hay.join(if_small(candidates.select("candidate", plain_boundaries(F.col("pattern")).alias("pattern"))), F.expr("hay rlike pattern")).select("candidate", "uid", "framework_key")
    hit = preferred(hit, details, ["candidate"]).join(families, "framework_key", "left")
    counts = hit.groupBy("candidate", F.coalesce("family", "framework_key").alias("family")).agg(F.count(F.lit(1)).alias("n"))
    cited = candidates.select("candidate", F.explode("uids").alias("uid"))
    return counts, cited.join(controls.select("uid"), "uid", "left_anti").select("candidate", "uid")


def revalidation(controls: DataFrame, links: DataFrame, mappings: DataFrame, parents: DataFrame, library: DataFrame) -> DataFrame:
    """(problem, key): links and mappings with an unknown end, and library controls and checks' parents that don't cover each other."""
    known = controls.select(F.col("uid").alias("key"))
    ends = links.select(F.col("source_uid").alias("key")).union(links.select("target_uid")).distinct()
    out = ends.join(known, "key", "left_anti").select(F.lit("link end").alias("problem"), "key")
    out = out.union(mappings.select(F.col("uid").alias("key")).distinct().join(known, "key", "left_anti").select(F.lit("mapping"), "key"))
    p, lib = parents.select(F.col("control_id").alias("key")).distinct(), library.select(F.col("control_id").alias("key")).distinct()
    return out.union(lib.join(p, "key", "left_anti").select(F.lit("no check"), "key")).union(p.join(lib, "key", "left_anti").select(F.lit("no library control"), "key"))


def scoped_mappings(library: DataFrame, scope: DataFrame, details: DataFrame) -> DataFrame:
    """(control_id, uid, relationship): a row a mapping of ``library(control_id, mappings ARRAY<STRUCT<uid, relationship>>)`` in ``scope(framework_key)``, detailed rows preferred."""
    rows = library.select("control_id", F.explode("mappings").alias("m")).select("control_id", "m.uid", "m.relationship").withColumn("framework_key", framework_of(F.col("uid")))
    return preferred(rows.join(scope, "framework_key", "left_semi"), details, ["control_id"]).select("control_id", "uid", "relationship")


def preview(controls: DataFrame, expected: int | None = None) -> DataFrame:
    """(problem, key): controls without identifier or text, repeated ones, and a number other than expected."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    out = controls.where(blank("identifier")).select(F.lit("no identifier").alias("problem"), F.col("uid").alias("key"))
    out = out.union(controls.where(blank("text")).select(F.lit("no text"), "uid"))
    out = out.union(controls.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated"), "uid"))
    n = controls.agg(F.count(F.lit(1)).alias("n"))
    wrong = F.col("n") == 0 if expected is None else F.col("n") != expected
    return out.union(n.where(wrong).select(F.lit("number of controls"), F.col("n").cast("string")))


def reports_for(reports: DataFrame, controls: DataFrame) -> DataFrame:
    """``reports(report_id, dated, control_ids ARRAY)`` by control, the latest first: (control_id, report_id, dated, nth)."""
    rows = reports.select("report_id", "dated", F.explode(F.array_distinct("control_ids")).alias("control_id")).join(controls, "control_id", "left_semi")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("control_id").orderBy(F.desc("dated"), "report_id"))).select("control_id", "report_id", "dated", "nth")


def risk_rows(derived: DataFrame, related: DataFrame, published: DataFrame) -> DataFrame:
    """(uid, risk, test, refusal, n_published, n_related): one row a control, as a plan of tests is written."""
    n = lambda df, key, name: df.groupBy(F.col(key).alias("uid")).agg(F.count(F.lit(1)).alias(name))
    out = derived.join(n(published, "control_uid", "n_published"), "uid", "left").join(n(related, "uid", "n_related"), "uid", "left").fillna(0, ["n_published", "n_related"])
    return out.select("uid", "risk", "test", "refusal", "n_published", "n_related")


def test_plan_rows(derived: DataFrame, published: DataFrame, related: DataFrame, details: DataFrame) -> DataFrame:
    """(uid, kind, content): a row for each thing that a test plan of a control lists, so that a control with many needs no row that holds them all.

    Kinds: published (``published(uid, content)``), derived (the composed test) or refusal (why there is none), related
    (``related(uid, source_uid)``) and detail (``details(uid, detail_id)``). A publisher's own procedures take the place of a composed one.
    """
    # equal rows go where they are read, before anything is dealt by uid
    row = lambda df, kind, content: df.select("uid", F.lit(kind).alias("kind"), F.col(content).cast("string").alias("content")).distinct()
    own = derived.join(published.select("uid").distinct(), "uid", "left_anti")
    composed = row(own.where("refusal is null"), "derived", "test").union(row(own.where("refusal is not null"), "refusal", "refusal"))
    known = derived.select("uid")
    listed = row(published, "published", "content").union(row(related, "related", "source_uid")).union(row(details, "detail", "detail_id"))
    return composed.union(listed.join(known, "uid", "left_semi")).distinct()

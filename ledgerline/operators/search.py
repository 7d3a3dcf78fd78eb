"""Topical search in batch: many queries over many controls, scored term by term with reasons.

``build_index`` gives ``postings(uid, stem, tf_body, tf_title, tf_section, places)`` and ``doc_stats(uid, length)`` (both written once, as
any index is) and ``stem_stats(stem, df, idf)``. ``places`` are where a stem stands among the stems of body and title, stopwords left
out: a phrase stands where the places of its stems, each moved back by its number in the phrase, meet. Everything after the index is
joins on stems and windows by query; the query side is small, so Spark may broadcast it, and nothing is ranked across queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import rules
from ledgerline.functions.text import stem_of, tokens, with_stem
from ledgerline.operators.common import if_small, materialise, semi_small, single, written
from ledgerline.operators.corpus import preferred

FIELDS = ("text", "title", "section_ref")


@dataclass
class Index:
    postings: DataFrame
    doc_stats: DataFrame
    stem_stats: DataFrame
    totals: DataFrame


def vocabulary(counted: DataFrame) -> DataFrame:
    """(token, stem) of the distinct tokens of a table with a token column, stopwords (tested on stems) left out."""
    return with_stem(counted.select("token").distinct()).where(~F.col("stem").isin(rules.STOPWORDS))


def placed(words: DataFrame, stems: DataFrame, key: str = "uid") -> DataFrame:
    """(key, place, field, stem) of ``words(key, field, pos, token)``: stems in order, numbered over those that ``stems(token, stem)`` keeps."""
    kept = words.join(stems, "token").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("field", "pos", "stem"))).alias("s"))
    return kept.select(key, F.posexplode("s").alias("place", "x")).select(key, "place", "x.field", "x.stem")


#: Texts whose tokens are counted at once.
AT_ONCE = 256


def posted(texts: DataFrame, key: str, columns: tuple[str, ...], stopwords: bool) -> DataFrame:
    """(key, stem, tf_body, tf_title, tf_section, places) of ``texts``, one row a key, with up to three columns of text, read in order.

    A text's stems are counted in the batch in which it is read, so no token is shuffled. With ``stopwords`` they are placed too. ``places`` are those of the first two columns.
    """
    lists = [tokens(F.col(c)).alias(f"t{k}") for k, c in enumerate(columns)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                yield _posted_slice(batch.slice(at, AT_ONCE), key, memo, frozenset() if stopwords else _STOP)

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, *lists).mapInArrow(count, f"`{key}` {kind}, stem string, tf_body bigint, tf_title bigint, tf_section bigint, places array<int>")


def _posted_slice(batch: pa.RecordBatch, key: str, memo: dict[str, str], stop: frozenset[str]) -> pa.RecordBatch:
    docs, fields, words = [], [], []
    for k, column in enumerate(batch.columns[1:]):
        n = column.value_lengths().to_numpy(zero_copy_only=False)
        docs.append(np.repeat(np.arange(len(n)), n))
        fields.append(np.full(len(docs[-1]), k))
        words.append(column.flatten())
    coded = pa.chunked_array(words).combine_chunks()
    coded = (coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
    doc, field, word = np.concatenate(docs), np.concatenate(fields), coded.indices.to_numpy(zero_copy_only=False)
    if len(memo) > 1_000_000:
        memo.clear()
    names: dict[str, int] = {}
    code = np.empty(len(coded.dictionary), np.int64)
    for j, token in enumerate(coded.dictionary.to_pylist()):
        stem = memo.get(token)
        if stem is None:
            stem = memo[token] = stem_of(token)
        code[j] = -1 if stem in stop else names.setdefault(stem, len(names))
    code = code[word] if len(word) else np.empty(0, np.int64)
    order = np.argsort(doc * 3 + field, kind="stable")
    order = order[code[order] >= 0]
    doc, field, code = doc[order], field[order], code[order]
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)  # numbered from the text's first stem
    group = doc * max(len(names), 1) + code
    order = np.argsort(group, kind="stable")
    group, field, place, doc, code = group[order], field[order], place[order], doc[order], code[order]
    first = np.flatnonzero(np.diff(group, prepend=-1)) if len(group) else np.empty(0, np.int64)
    tf = [np.add.reduceat((field == k).astype(np.int64), first) if len(first) else first for k in range(3)]
    placed_at = place[field < 2].astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(tf[0] + tf[1])]).astype(np.int32)
    stems = pa.array(list(names), pa.string()).take(pa.array(code[first])) if names else pa.array([], pa.string())
    columns = [batch.column(0).take(pa.array(doc[first])), stems, *[pa.array(x, pa.int64()) for x in tf], pa.ListArray.from_arrays(pa.array(ends), pa.array(placed_at))]
    return pa.RecordBatch.from_arrays(columns, [key, "stem", "tf_body", "tf_title", "tf_section", "places"])


_STOP = frozenset(rules.STOPWORDS)


def _posted_by_words(controls: DataFrame) -> DataFrame:
    """The postings of controls of which several have one uid: their tokens meet."""
    part = lambda k, c: controls.select("uid", F.lit(k).alias("field"), F.posexplode(tokens(F.col(c))).alias("pos", "token"))
    words = part(0, FIELDS[0]).union(part(1, FIELDS[1])).union(part(2, FIELDS[2]))
    of = lambda k, name: F.count(F.when(F.col("field") == k, 1)).alias(name)
    places = F.array_sort(F.collect_list(F.when(F.col("field") < 2, F.col("place")))).alias("places")
    return placed(words, vocabulary(words)).groupBy("uid", "stem").agg(of(0, "tf_body"), of(1, "tf_title"), of(2, "tf_section"), places)


def build_index(controls: DataFrame) -> Index:
    postings = written(posted(controls, "uid", FIELDS, False) if single(controls, "uid") else _posted_by_words(controls))
    doc_stats = postings.groupBy("uid").agg(F.sum(F.col("tf_body") + F.col("tf_title") + F.col("tf_section")).alias("length"))
    doc_stats = materialise(doc_stats)
    totals = materialise(doc_stats.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("average_length")))
    df = materialise(postings.groupBy("stem").agg(F.count(F.lit(1)).alias("df")))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    stem_stats = df.join(F.broadcast(totals)).select("stem", "df", idf.alias("idf"))  # one row of totals
    return Index(postings, doc_stats, stem_stats, totals)


def phrase_parts(phrases: DataFrame, key: str, text: str = "phrase") -> DataFrame:
    """(key, k, stem, m): the stems of each phrase in order, stopwords included, and how many there are."""
    words = phrases.select(key, F.posexplode(tokens(F.col(text))).alias("k", "token"))
    words = words.join(with_stem(words.select("token").distinct()), "token")
    return words.select(key, "k", "stem", F.count(F.lit(1)).over(Window.partitionBy(key)).alias("m"))


def phrases_at(postings: DataFrame, parts: DataFrame, key: str, pairs: DataFrame, uid: str = "uid") -> DataFrame:
    """(key, uid, starts): where each phrase of ``parts`` stands whole in the controls that ``pairs(key, uid)`` names; ``postings(uid, stem, places)``.

    The places of each stem, moved back by its number in the phrase, are intersected; a task holds one phrase's places in one control.
    """
    near = semi_small(semi_small(postings.select(uid, "stem", "places"), parts, "stem"), pairs, uid)
    said = pairs.join(if_small(parts), key).join(near, [uid, "stem"])
    moved = F.transform("places", lambda at: at - F.col("k"))
    met = said.groupBy(key, uid).agg(F.first("m").alias("m"), F.count(F.lit(1)).alias("n"), F.collect_list(moved).alias("moved")).where("n = m")
    starts = F.aggregate(F.slice("moved", 2, F.size("moved")), F.get("moved", 0), F.array_intersect)
    return met.select(key, uid, "m", F.array_sort(F.array_distinct(starts)).alias("starts")).where(F.size("starts") > 0)


def occurrences(starts: Column, m: Column) -> Column:
    """How many of a phrase's places count, from the left: two that share a stem, or only the blank between them, are one."""
    step = lambda acc, at: F.when(at >= acc["free"], F.struct((acc["n"] + 1).alias("n"), (at + m + 1).alias("free"))).otherwise(acc)
    return F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("free")), step, lambda acc: acc["n"])


def phrase_counts(postings: DataFrame, stem_df: DataFrame, phrases: DataFrame, uid: str = "uid") -> DataFrame:
    """(concept, phrase, uid, n): how often each of ``phrases(concept, phrase)`` stands in the controls that have it; ``stem_df(stem, df)``.

    A phrase is looked for only in controls that have its rarest stem, which is an equi-join.
    """
    wanted = materialise(phrases.select("concept", "phrase").distinct().withColumn("p", F.monotonically_increasing_id()))
    parts = materialise(phrase_parts(wanted, "p"))
    rare = parts.join(stem_df, "stem").groupBy("p").agg(F.min_by("stem", F.struct("df", "k")).alias("stem"))
    rare = materialise(rare)
    pairs = written(if_small(rare).join(semi_small(postings.where(F.size("places") > 0).select(uid, "stem"), rare, "stem"), "stem").select("p", uid))
    found = phrases_at(postings, parts, "p", pairs, uid).join(if_small(wanted), "p")
    return found.select("concept", "phrase", uid, occurrences(F.col("starts"), F.col("m")).alias("n"))


def query_stems(queries: DataFrame) -> DataFrame:
    """(query_id, pos, token, stem), stopwords kept out of the terms but counted in ``n_tokens``."""
    words = queries.select("query_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))
    return words.join(vocabulary(words), "token")


def query_terms(queries: DataFrame, index: Index, aliases: DataFrame | None = None, most: int = rules.MAX_TERMS) -> DataFrame:
    """(query_id, term, label, form, form_size, nth, stem, weight): the heaviest terms of each query with their forms.

    A term is a distinct stem in order of first use; ``aliases(token, expansion ARRAY<STRING>)`` adds a second form whose
    stems must all be present. A form weighs its rarest-known stem's least idf, a term its best form. Aliases of
    three letters or fewer count only in queries of at most four tokens.
    """
    words = query_stems(queries)
    size = queries.select("query_id", F.size(tokens(F.col("text"))).alias("n_tokens"))
    first = words.groupBy("query_id", "stem").agg(F.min(F.struct("pos", "token")).alias("at"))
    forms = first.select("query_id", F.col("at.pos").alias("term"), F.col("at.token").alias("label"), F.lit(0).alias("form"), F.lit(0).alias("nth"), "stem")
    if aliases is not None:
        usable = forms.join(size, "query_id").join(aliases, forms["label"] == aliases["token"])
        usable = usable.where((F.length("label") > 3) | (F.col("n_tokens") <= 4))
        parts = usable.select("query_id", "term", "label", F.posexplode(tokens(F.concat_ws(" ", "expansion"))).alias("nth", "token"))
        extra = parts.join(with_stem(parts.select("token").distinct()), "token").groupBy("query_id", "term", "label", F.lit(1).alias("form"), "stem").agg(F.min("nth").alias("nth"))
        forms = forms.unionByName(extra)
    unseen = F.log(1 + (F.col("n_docs") + 0.5) / 1.5)
    weighed = forms.join(index.stem_stats, "stem", "left").join(F.broadcast(index.totals)).withColumn("w", F.coalesce("idf", unseen))
    per_form = Window.partitionBy("query_id", "term", "form")
    weighed = weighed.withColumn("form_weight", F.min("w").over(per_form)).withColumn("form_size", F.count(F.lit(1)).over(per_form))
    weighed = weighed.withColumn("weight", F.max("form_weight").over(Window.partitionBy("query_id", "term")))
    place = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.round("weight", 9).desc(), "term"))
    return materialise(weighed.withColumn("place", place).where(F.col("place") <= most)).select("query_id", "term", "label", "form", "form_size", "nth", "stem", "weight")


def saturate(tf: Column, length: Column, average: Column) -> Column:
    return F.when(tf > 0, tf / (tf + rules.K1 * (1 - rules.B + rules.B * length / average))).otherwise(0.0)


def candidates(queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, uid) of every control that has any stem of the query in any field."""
    asked = query_stems(queries).select("query_id", "stem").distinct()
    # dealt by control before a control meets its queries, so that no pair is dealt
    near = semi_small(index.postings.select("uid", "stem"), asked, "stem").repartition("uid")
    return if_small(asked).join(near, "stem").select("query_id", "uid").distinct()


def literal_scores(terms: DataFrame, index: Index, least: float = 0.0) -> DataFrame:
    """(query_id, uid, literal, coverage, n_matched, n_terms): a term counts if one of its forms is present whole in body or title.

    A threshold join: pairs whose literal score can't reach ``least`` and that don't have all terms may be left out, all others come with
    their exact scores. Terms are taken rarest first. The lightest ones, as many as have no more than ``least`` of the weight together, find
    no pairs of their own; they are looked up only in pairs that are still able to reach it, so common stems meet few controls.
    """
    each = terms.select("query_id", "term", "weight").distinct()
    all_of = Window.partitionBy("query_id")
    lighter = all_of.orderBy(F.round("weight", 9), F.col("term").desc()).rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("share", F.col("weight") / F.sum("weight").over(all_of)).withColumn("n_terms", F.count(F.lit(1)).over(all_of))
    each = each.withColumn("light", F.sum("share").over(lighter) < least - 1e-9)
    light = F.col("light")
    sums = each.groupBy("query_id").agg(F.sum(F.when(light, F.col("share")).otherwise(0.0)).alias("light_share"), F.count(F.when(~light, 1)).alias("n_heavy"))
    shared = terms.join(each.drop("weight"), ["query_id", "term"])
    heavy = _term_scores(shared.where(~light), index.postings, ["stem"], index)
    if least <= 0:
        return _summed(heavy)
    # what the heavy terms give: a pair stays if it has all of them, or if the light ones could lift it to ``least``
    hits = materialise(heavy)
    able = hits.groupBy("query_id", "uid").agg(F.sum("part").alias("part"), F.count(F.lit(1)).alias("n")).join(sums, "query_id")
    able = able.where((F.col("part") + F.col("light_share") >= least - 1e-9) | (F.col("n") == F.col("n_heavy"))).select("query_id", "uid")
    more = _term_scores(able.join(shared.where(light), "query_id"), index.postings, ["uid", "stem"], index)
    return _summed(hits.join(able, ["query_id", "uid"], "left_semi").union(more))


def _term_scores(shared: DataFrame, postings: DataFrame, on: list[str], index: Index) -> DataFrame:
    """(query_id, uid, n_terms, share, part) of each term that a control has: its best form's least frequency, saturated."""
    near = postings.drop("places").where(F.col("tf_body") + F.col("tf_title") > 0)
    # dealt by control once: all that is grouped and joined below has the control in its key
    near = semi_small(near, shared, "stem").repartition("uid") if on == ["stem"] else near
    hit = if_small(shared).join(near, on)
    tf = rules.TF_BODY * F.col("tf_body") + rules.TF_TITLE * F.col("tf_title") + rules.TF_SECTION * F.col("tf_section")
    hit = hit.withColumn("tf", tf).groupBy("query_id", "term", "form", "form_size", "share", "n_terms", "uid").agg(F.count(F.lit(1)).alias("present"), F.min("tf").alias("tf"))
    best = hit.where("present = form_size").groupBy("query_id", "term", "share", "n_terms", "uid").agg(F.max("tf").alias("tf"))
    scored = best.join(index.doc_stats, "uid").join(F.broadcast(index.totals))  # one row of totals
    return scored.select("query_id", "uid", "n_terms", "share", (F.col("share") * saturate(F.col("tf"), F.col("length"), F.col("average_length"))).alias("part"))


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("query_id", "uid", "n_terms").agg(F.sum("part").alias("literal"), F.sum("share").alias("coverage"), F.count(F.lit(1)).alias("n_matched"))


def search(
    queries: DataFrame, controls: DataFrame, frameworks: DataFrame, index: Index, aliases: DataFrame | None = None, concepts: DataFrame | None = None, details: DataFrame | None = None,
    floor: float = rules.FLOOR,
) -> DataFrame:
    """(query_id, uid, framework_key, score, n_matched, n_terms, phrase, rank) above the floor, best first.

    ``concepts(query_id, uid, conceptual)`` are scores of concept phrases, if any (``vocabulary.concept_scores``); of a broad control and its
    detailed one, ``details(broad_uid, uid)``, only the detailed one stays among a query's hits; the subject score is the better of
    the literal one and 0.8 of that. One incidental word is no answer: without a concept two terms must match,
    or one that carries 0.7 of the weight. A score is at least ``floor``; under a higher one than usual, pairs that can't reach it aren't met.
    """
    # beside its subject a hit gains by its tier, and by all terms and the phrase only if it has all terms
    least = floor - max(rules.TIER_NUDGE.values()) - 5e-5 if concepts is None and floor > rules.FLOOR else 0.0
    found = literal_scores(query_terms(queries, index, aliases), index, least)
    # what can't come to the floor goes before hits are dealt or written: all terms and the phrase count only with all terms, a concept only where there is one
    able = (F.col("literal") + max(rules.TIER_NUDGE.values()) + 5e-5 + 1e-9 >= floor) | (F.col("n_matched") == F.col("n_terms"))
    if concepts is not None:
        concepts = written(concepts.select("query_id", "uid", "conceptual"))
        named = concepts.groupBy("uid").agg(F.map_from_entries(F.collect_set(F.struct("query_id", F.lit(True)))).alias("__named"))
        found = found.join(named, "uid", "left").where(able | F.coalesce(F.try_element_at("__named", F.col("query_id")), F.lit(False))).drop("__named")
        found = found.join(concepts, ["query_id", "uid"], "full").fillna(0, ["literal", "coverage", "n_matched", "n_terms", "conceptual"])
    else:
        found = found.where(able).withColumn("conceptual", F.lit(0.0))
    found = found.withColumn("subject", F.greatest("literal", rules.CONCEPT * F.col("conceptual")))
    found = materialise(found.where((F.col("conceptual") > 0) | (F.col("n_matched") >= 2) | (F.round("coverage", 9) >= rules.SOLO)))
    phrases = phrase_hits(queries, index, found.where("n_matched = n_terms"))
    found = found.join(phrases, ["query_id", "uid"], "left").join(controls.select("uid", "framework_key", "structural"), "uid").join(frameworks.select("framework_key", "tier"), "framework_key", "left")
    nudge = F.coalesce(F.get(F.array(*[F.lit(rules.TIER_NUDGE[t]) for t in range(1, 6)]), F.col("tier") - 1), F.lit(0.0))
    score = F.col("subject") + F.when((F.col("n_matched") == F.col("n_terms")) & (F.col("n_terms") > 1), rules.ALL_TERMS).otherwise(0.0)
    score = score + F.when(F.col("phrase"), rules.PHRASE).otherwise(0.0) + nudge - F.when(F.col("structural"), rules.STRUCTURAL).otherwise(0.0)
    found = found.withColumn("score", F.round(score, 4)).withColumn("phrase", F.coalesce("phrase", F.lit(False)))
    # the best of each query by partial maximums, so that no task holds all hits of a query before the floor has cut them
    found = materialise(found)
    best = found.groupBy("query_id").agg(F.max("score").alias("__best"))
    found = found.join(best, "query_id").where(F.col("score") >= F.greatest(F.lit(floor), rules.RELATIVE_FLOOR * F.col("__best"))).drop("__best")
    if details is not None:
        found = preferred(found, details, ["query_id"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "framework_key", "uid"))
    return found.withColumn("rank", rank).select("query_id", "uid", "framework_key", "score", "n_matched", "n_terms", "phrase", "rank")


def phrase_hits(queries: DataFrame, index: Index, pairs: DataFrame) -> DataFrame:
    """(query_id, uid, phrase): the pairs, of those that have all terms, in which the query's two or more stems stand one after the other.

    A query with a stopword is never a phrase: places count without them.
    """
    parts = phrase_parts(queries.select("query_id", "text"), "query_id", "text").where("m > 1")
    spoilt = parts.where(F.col("stem").isin(rules.STOPWORDS)).select("query_id").distinct()
    found = phrases_at(index.postings, parts.join(spoilt, "query_id", "left_anti"), "query_id", pairs.select("query_id", "uid"))
    return found.select("query_id", "uid", F.lit(True).alias("phrase"))


def evidence(hits: DataFrame, terms: DataFrame, index: Index) -> DataFrame:
    """(query_id, uid, matched): of each hit the terms it has, in the query's order: ``array<struct<term, label, field, share>>``.

    Only hits that are reported are looked up again, and a query has ``rules.MAX_TERMS`` terms at most, so a hit costs a fixed number of
    entries. A term counts by its best form; it stands in the title if that form's first stem does.
    """
    each = terms.select("query_id", "term", "label", "weight").distinct()
    each = each.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("query_id"))).drop("weight")
    tf = rules.TF_BODY * F.col("tf_body") + rules.TF_TITLE * F.col("tf_title") + rules.TF_SECTION * F.col("tf_section")
    near = semi_small(index.postings.drop("places"), hits, "uid")
    hit = hits.select("query_id", "uid").join(terms.select("query_id", "term", "form", "form_size", "nth", "stem"), "query_id").join(near, ["uid", "stem"])
    hit = hit.where(F.col("tf_body") + F.col("tf_title") > 0).withColumn("tf", tf)
    form = hit.groupBy("query_id", "uid", "term", "form", "form_size").agg(F.count(F.lit(1)).alias("n"), F.min("tf").alias("tf"), F.min_by(F.col("tf_title") > 0, "nth").alias("titled"))
    best = form.where("n = form_size").groupBy("query_id", "uid", "term").agg(F.max_by("titled", F.struct("tf", -F.col("form"))).alias("titled"))
    named = best.join(each, ["query_id", "term"])
    one = F.struct("term", "label", F.when(F.col("titled"), "title").otherwise("text").alias("field"), "share")
    return named.groupBy("query_id", "uid").agg(F.array_sort(F.collect_list(one)).alias("matched"))


def joined_stems(texts: DataFrame, key: str, without_stopwords: bool) -> DataFrame:
    """(key, joined): the stems of ``texts(key, text)`` in order, with blanks between and around; texts without any have no row."""
    if not single(texts, key):
        words = texts.select(key, F.posexplode(tokens(F.col("text"))).alias("pos", "token"))
        stems = vocabulary(words) if without_stopwords else with_stem(words.select("token").distinct())
        listed = words.join(stems, "token").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "stem"))).alias("s"))
        return listed.select(key, F.concat(F.lit(" "), F.array_join(F.col("s.stem"), " "), F.lit(" ")).alias("joined"))
    stop = _STOP if without_stopwords else frozenset()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}
        for batch in batches:
            if len(memo) > 1_000_000:
                memo.clear()
            joined = []
            for words in batch.column(1).to_pylist():
                stems = [memo[w] if w in memo else memo.setdefault(w, stem_of(w)) for w in words]
                stems = [x for x in stems if x not in stop]
                joined.append(f" {' '.join(stems)} " if stems else None)
            kept = [k for k, x in enumerate(joined) if x is not None]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array([joined[k] for k in kept], pa.string())], [key, "joined"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, tokens(F.col("text")).alias("t")).mapInArrow(join, f"`{key}` {kind}, joined string")


def compose(ranked: DataFrame, frameworks: DataFrame, lead: int = rules.LEAD, limit: int = 25) -> DataFrame:
    """The order in which hits are shown: the ``lead`` best, then the best of each family not yet seen in governance order, then the rest by score.

    ``frameworks`` may have a ``family``; a framework without one is a family of its own.
    """
    if "family" in frameworks.columns:
        ranked = ranked.join(frameworks.select("framework_key", "family"), "framework_key", "left").withColumn("family", F.coalesce("family", "framework_key"))
    else:
        ranked = ranked.withColumn("family", F.col("framework_key"))
    seen = ranked.where(F.col("rank") <= lead).select("query_id", "family").distinct().withColumn("led", F.lit(True))
    gov = frameworks.select("framework_key", F.struct(F.coalesce("tier", F.lit(99)).alias("t"), F.coalesce("jurisdiction", F.lit(99)).alias("j"), F.coalesce("intra_order", F.lit(99)).alias("i"), "framework_key").alias("gov"))
    hits = ranked.join(seen, ["query_id", "family"], "left").join(gov, "framework_key", "left")
    best = F.row_number().over(Window.partitionBy("query_id", "family").orderBy("rank"))
    hits = hits.withColumn("best", best)
    block = F.when(F.col("rank") <= lead, 0).when(F.col("led").isNull() & (F.col("best") == 1), 1).otherwise(2)
    hits = hits.withColumn("block", block)
    order = Window.partitionBy("query_id").orderBy("block", F.when(F.col("block") == 1, F.col("gov")), "rank")
    return hits.withColumn("shown", F.row_number().over(order)).where(F.col("shown") <= limit).select("query_id", "uid", "framework_key", "score", "rank", "block", "shown")

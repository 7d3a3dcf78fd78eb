"""What a requirement asks for: refusals, archetypes, guidance, details in scope. Rules are tables; the first in order wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import rules
from ledgerline.operators.common import phrases_said


def not_derivable(title: Column, text: Column, structural: Column, ancestor_titles: Column, refusals: list[tuple] = rules.REFUSALS, above: str = rules.REFUSED_ABOVE, shortest: int = rules.SHORTEST_TEXT) -> Column:
    """Why an entry states nothing to test, or null. ``ancestor_titles`` is an array, nearest first.

    ``refusals`` is a rule table, the first row that holds wins: (reason, part, letters, pattern, lifted by, letters read for that). A part is
    the title, the text or both; letters are those from its start that are read, None for all; a row whose text also matches what
    lifts it (None: nothing does) doesn't hold. Structural entries, those below a title that matches ``above`` and those with fewer than
    ``shortest`` letters come before all rows.
    """
    title = F.trim(F.coalesce(title, F.lit("")))
    text = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    parts = {"title": title, "text": text, "both": F.concat_ws(" ", title, text)}
    head = lambda c, n: c if n is None else F.substring(c, 1, n)
    out = F.when(F.coalesce(structural, F.lit(False)), "structural")
    out = out.when(F.exists(F.coalesce(ancestor_titles, F.array().cast("array<string>")), lambda t: t.rlike(above)), "definition").when(F.length(text) < shortest, "no text")
    for reason, part, letters, pattern, lifted_by, lifted_letters in refusals:
        holds = head(parts[part], letters).rlike(pattern)
        out = out.when(holds if lifted_by is None else holds & ~head(text, lifted_letters).rlike(lifted_by), reason)
    return out


def first_match(named: list[tuple[str, str]]) -> Column:
    """The name of the first rule (name, pattern) that the column ``text`` matches, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(named):
        out = F.when(F.col("text").rlike(pattern), F.lit(name)).otherwise(out)
    return out


def classify(texts: DataFrame, archetypes: list[tuple[str, str]], fallback: str = "activity", key: str = "uid") -> DataFrame:
    """(key, archetype, evidence): every archetype whose pattern a text of ``texts(key, text)`` matches, with what matched; else the fallback.

    All patterns are tried in one projection.
    """
    hits = F.array_compact(
        F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(k).alias("ord"), F.lit(name).alias("archetype"), F.lower(F.regexp_extract("text", p, 0)).alias("evidence"))) for k, (name, p) in enumerate(archetypes)])
    )
    none = F.array(F.struct(F.lit(len(archetypes)).alias("ord"), F.lit(fallback).alias("archetype"), F.lit("").alias("evidence")))
    return texts.select(key, F.explode(F.when(F.size(hits) > 0, hits).otherwise(none)).alias("h")).select(key, "h.archetype", "h.evidence", "h.ord")


def guidance(classified: DataFrame, texts: DataFrame, profiles: list[tuple], by_archetype: DataFrame, key: str = "uid") -> DataFrame:
    """(key, risk, assessment): of the first profile that matches the text, else of the first archetype, else general ones.

    ``profiles`` are (risk, pattern[, assessment]), ``by_archetype(archetype, risk[, assessment])``; what a rule doesn't say of the
    assessment the next one may.
    """
    first = classified.groupBy(key).agg(F.min_by("archetype", "ord").alias("archetype"))
    said = by_archetype.select("archetype", F.col("risk").alias("__r"), (F.col("assessment") if "assessment" in by_archetype.columns else F.lit(None).cast("string")).alias("__a"))
    out = texts.withColumn("risk", first_match([p[:2] for p in profiles])).withColumn("assessment", first_match([(p[2], p[1]) for p in profiles if len(p) > 2]))
    out = out.join(first, key, "left").join(said, "archetype", "left")
    return out.select(key, F.coalesce("risk", "__r", F.lit("the requirement is not met")).alias("risk"), F.coalesce("assessment", "__a", F.lit("assess whether the requirement is met")).alias("assessment"))


def details_in_scope(texts: DataFrame, sources: DataFrame, key: str = "uid") -> DataFrame:
    """(key, source, phrase): a source is in scope if the text names one of its phrases; the first phrase is kept. ``sources(source, phrase, ord)`` is a rule table."""
    hit = phrases_said(texts, sources, key).join(sources, "phrase")
    return hit.groupBy(key, "source").agg(F.min_by("phrase", "ord").alias("phrase"))


def rank_details(stems: DataFrame, details: DataFrame, scope: DataFrame, weights: DataFrame, shared: DataFrame | None = None, limit: int = 6, least: float = 0.45, key: str = "uid") -> DataFrame:
    """(key, detail_id, score): of the sources in scope, the details that cover most of a control's stems by weight, with 0.2 more for a shared concept and 1 at most.

    ``stems(key, stem)``, ``details(source, detail_id, stem)``, ``scope(key, source)``, ``weights(stem, weight)``,
    ``shared(key, detail_id)`` as ``graph.shared_concepts`` gives it.
    """
    scope = scope.select(key, "source").distinct()
    own = stems.distinct().join(weights, "stem")
    total = own.groupBy(key).agg(F.sum("weight").alias("total"))
    got = own.join(details.distinct(), "stem").join(scope, [key, "source"], "left_semi").groupBy(key, "detail_id").agg(F.sum("weight").alias("got"))
    parts = got.join(total, key).select(key, "detail_id", (F.col("got") / F.col("total")).alias("c"))
    if shared is not None:
        named = shared.join(details.select("source", "detail_id").distinct(), "detail_id").join(scope, [key, "source"], "left_semi")
        parts = parts.union(named.select(key, "detail_id").distinct().withColumn("c", F.lit(0.2)))
    scored = parts.groupBy(key, "detail_id").agg(F.round(F.least(F.lit(1.0), F.sum("c")), 6).alias("score")).where(F.col("score") >= least)
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "detail_id"))
    return scored.withColumn("n", n).where(F.col("n") <= limit).select(key, "detail_id", "score")


def test_procedure(archetype: Column, quote: Column, figures: Column, applies: Column) -> Column:
    """Composed text: what to obtain, the words it comes from, at most three figures, whom it applies to."""
    return F.concat_ws(
        " ",
        F.concat(F.lit("Obtain evidence of the "), archetype, F.lit(".")),
        F.concat(F.lit("The requirement says: "), quote, F.lit(".")),
        F.when(F.size(figures) > 0, F.concat(F.lit("Check the stated figures: "), F.array_join(F.slice(figures, 1, 3), "; "), F.lit("."))),
        F.when(applies.isNotNull(), F.concat(F.lit("Applies to "), applies, F.lit("."))),
    )

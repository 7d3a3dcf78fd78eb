"""Corpus assembly and integrity: first-wins merging, link and child validation, reports, governance order.

Every operator takes and returns DataFrames; ``load_seq`` decides what came first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.common import materialise
from ledgerline.operators.scan import numbered

NO_TIER = 99


def merge_controls(controls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row a uid: a generated row supersedes shipped ones, else the first loaded stays. Second: a warning for each row dropped that was no supersession."""
    best = Window.partitionBy("uid").orderBy(F.when(F.col("origin") == "generated", 0).otherwise(1), "load_seq")
    ranked = controls.withColumn("__n", F.row_number().over(best)).withColumn("__by", F.first("origin").over(best))
    warnings = ranked.where((F.col("__n") > 1) & (F.col("__by") == F.col("origin"))).select(F.lit("duplicate").alias("stage"), F.col("uid").alias("key"), F.col("load_seq"))
    return ranked.where("__n = 1").drop("__n", "__by"), warnings


def known_frameworks(controls: DataFrame, frameworks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Controls of loaded frameworks, their fidelity filled from the framework; and those of none."""
    named = frameworks.select("framework_key", F.col("fidelity").alias("__f"))
    kept = controls.join(named, "framework_key").withColumn("fidelity", F.coalesce("fidelity", "__f")).drop("__f")
    return kept, controls.join(named, "framework_key", "left_anti")


def link_problem(provenance: Column, kind: Column, asserted_by: Column, tag_side: Column) -> Column:
    """The first invariant a link breaks, or null."""
    return (
        F.when((kind == "incorporates") & (provenance != "published"), "incorporation must be published")
        .when((provenance == "published") & asserted_by.isNull(), "published needs an asserter")
        .when((provenance == "published-tag") & tag_side.isNull(), "tag needs a side")
        .when((provenance == "derived") & asserted_by.isNotNull(), "derived has no asserter")
    )


def validate_links(links: DataFrame, uids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links that keep the invariants and whose ends are known; and (load_seq, problem) of the others."""
    ends = uids.select("uid").distinct()
    checked = links.withColumn("problem", link_problem(F.col("provenance"), F.col("kind"), F.col("asserted_by"), F.col("tag_side")))
    checked = checked.join(ends.select(F.col("uid").alias("source_uid"), F.lit(True).alias("__s")), "source_uid", "left")
    checked = checked.join(ends.select(F.col("uid").alias("target_uid"), F.lit(True).alias("__t")), "target_uid", "left")
    problem = F.coalesce("problem", F.when(F.col("__s").isNull(), "unknown source").when(F.col("__t").isNull(), "unknown target"))
    checked = checked.withColumn("problem", problem).drop("__s", "__t")
    return checked.where("problem is null").drop("problem"), checked.where("problem is not null").select("load_seq", "problem")


def validate_children(children: DataFrame, controls: DataFrame, key: str = "control_uid") -> tuple[DataFrame, DataFrame]:
    """Rows whose control exists and that are published exactly if they name a publisher; and the rest."""
    known = children.join(controls.select(F.col("uid").alias(key)).distinct(), key, "left_semi")
    sound = (F.col("provenance") == "published") == F.col("published_by").isNotNull()
    good = known.where(sound)
    return good, children.join(controls.select(F.col("uid").alias(key)).distinct(), key, "left_anti").union(known.where(~sound).select(children.columns))


def mark_shared_titles(controls: DataFrame) -> DataFrame:
    """``title_is_shared``: another control of the framework has the same title, blanks and case aside."""
    title = F.lower(F.trim("title"))
    n = controls.where(title != "").groupBy(F.col("framework_key").alias("__f"), title.alias("__t")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    out = controls.withColumn("__title", title).join(n, (F.col("framework_key") == F.col("__f")) & (F.col("__title") == F.col("__t")), "left")
    return out.withColumn("title_is_shared", F.col("__n").isNotNull()).drop("__f", "__t", "__n", "__title")


def integrity_report(controls: DataFrame, frameworks: DataFrame, folded: Column) -> DataFrame:
    """(kind, key, detail): colliding identifiers, unplaced tiers, empty frameworks, orphan parents."""
    same = controls.withColumn("__k", folded).groupBy("framework_key", "__k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    collisions = same.select(F.lit("identifier collision").alias("kind"), F.concat_ws(":", "framework_key", "__k").alias("key"), F.col("n").cast("string").alias("detail"))
    unplaced = frameworks.where("tier is null").select(F.lit("no tier").alias("kind"), F.col("framework_key").alias("key"), F.lit("").alias("detail"))
    empty = frameworks.join(controls.select("framework_key").distinct(), "framework_key", "left_anti").select(F.lit("empty framework").alias("kind"), F.col("framework_key").alias("key"), F.lit("").alias("detail"))
    parents = controls.select(F.col("uid").alias("parent_uid"))
    orphans = controls.where("parent_uid is not null").join(parents, "parent_uid", "left_anti").select(F.lit("orphan parent").alias("kind"), F.col("uid").alias("key"), F.col("parent_uid").alias("detail"))
    return collisions.union(unplaced).union(empty).union(orphans)


def load_report(frameworks: DataFrame, controls: DataFrame, links: DataFrame) -> DataFrame:
    """(part, key, n): controls of every framework (0 where none loaded), links by provenance, empty tiers."""
    counted = controls.groupBy("framework_key").agg(F.count(F.lit(1)).alias("n"))
    per = frameworks.join(counted, "framework_key", "left").select("framework_key", "tier", F.coalesce("n", F.lit(0)).alias("n"))
    tiers = frameworks.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("tier"))
    empty = tiers.join(per.where("n > 0").groupBy("tier").agg(F.sum("n").alias("n")), "tier", "left").where("n is null")
    return (
        per.select(F.lit("framework").alias("part"), F.col("framework_key").alias("key"), "n")
        .union(links.groupBy("provenance").agg(F.count(F.lit(1)).alias("n")).select(F.lit("links"), "provenance", "n"))
        .union(empty.select(F.lit("empty tier"), F.col("tier").cast("string"), F.lit(0).cast("long")))
    )


def load_summary(frameworks: DataFrame, controls: DataFrame, links: DataFrame, statements: DataFrame, absent: DataFrame, beside: dict[str, DataFrame] | None = None) -> DataFrame:
    """(part, key, n, note): what a corpus holds and what it lacks, counted in one pass over all its tables.

    ``frameworks(framework_key, tier, family, revision, fidelity, permissive)``, ``controls(framework_key)``, ``links(provenance)``,
    ``statements(provenance)``, ``absent(framework_key, reason)``; ``beside`` are further tables whose rows are counted. Parts: a framework
    with its revision and fidelity, or ``not loaded`` with the reason; totals; loaded frameworks and families; links and statements by
    provenance; licences; tiers in which nothing is loaded.
    """
    none = F.lit(None).cast("string")
    fact = lambda df, kind, key=none, way=none: df.select(F.lit(kind).alias("kind"), key.alias("framework_key"), way.cast("string").alias("way"))
    facts = fact(controls, "controls", F.col("framework_key")).union(fact(links, "links", way=F.col("provenance"))).union(fact(statements, "statements", way=F.col("provenance")))
    facts = facts.union(fact(frameworks, "licence", way=F.when(F.col("permissive"), "shippable").otherwise("import only")))
    for kind, df in (beside or {}).items():
        facts = facts.union(fact(df, kind))
    by, per, way = F.grouping_id("kind", "framework_key", "way"), F.col("framework_key"), F.col("way")
    counted = materialise(facts.groupingSets([[F.col("kind"), per], [F.col("kind"), way], [F.col("kind")]], F.col("kind"), per, way).agg(F.count(F.lit(1)).alias("n"), by.alias("set")))
    # set 1 is by framework, 2 by provenance or licence, 3 over all
    n = counted.where("kind = 'controls' and set = 1").select("framework_key", "n")
    state = frameworks.join(n, "framework_key", "left").join(absent.select("framework_key", "reason"), "framework_key", "left")
    gone = F.col("reason").isNotNull() | F.col("n").isNull()
    state = state.withColumn("gone", gone).withColumn("n", F.coalesce("n", F.lit(0)))
    note = F.when(F.col("gone"), F.coalesce("reason", F.lit("no loader ran"))).otherwise(F.concat_ws(", ", F.coalesce("revision", F.lit("revision not stated")), "fidelity"))
    lines = state.select(F.when(F.col("gone"), "not loaded").otherwise("framework").alias("part"), F.col("framework_key").alias("key"), "n", note.alias("note"))
    ways = counted.where("set = 2 and way is not null").select("kind", "way", "n", none)
    totals = counted.where("set = 3 and kind <> 'licence'").select(F.lit("total"), "kind", "n", none)
    loaded = state.where("not gone").agg(F.count(F.lit(1)).alias("frameworks"), F.countDistinct(F.coalesce("family", "framework_key")).alias("families"))
    loaded = loaded.select(F.explode(F.create_map(F.lit("frameworks"), "frameworks", F.lit("families"), "families")).alias("key", "n")).select(F.lit("loaded"), "key", "n", none)
    tiers = frameworks.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("tier"))
    empty = tiers.join(state.where("n > 0").select("tier").distinct(), "tier", "left_anti").select(F.lit("empty tier"), F.col("tier").cast("string"), F.lit(0).cast("long"), none)
    return lines.union(ways).union(totals).union(loaded).union(empty)


def framework_warnings(frameworks: DataFrame) -> DataFrame:
    """(framework_key, warning): no tier, no levels, a revision without its source, no source files."""
    checks = F.array(
        F.when(F.col("tier").isNull(), "no tier"),
        F.when(F.col("levels") == 0, "no levels"),
        F.when(F.col("revision").isNotNull() & F.col("revision_source").isNull(), "revision without source"),
        F.when(F.col("source_files") == 0, "no source"),
    )
    return frameworks.select("framework_key", F.explode(F.array_compact(checks)).alias("warning"))


def governance_key(frameworks: DataFrame) -> DataFrame:
    """(framework_key, gov): the struct by which everything is ordered: tier, jurisdiction, order within the tier, key."""
    of = lambda c: F.coalesce(F.col(c), F.lit(NO_TIER)).cast("int").alias(c)  # noqa: E731  a value of 0 is a value
    return frameworks.select("framework_key", F.struct(of("tier"), of("jurisdiction"), of("intra_order"), F.col("framework_key").alias("key")).alias("gov"))


def governance_order(controls: DataFrame, frameworks: DataFrame, within: list[str] | None = None) -> DataFrame:
    """``controls`` with ``place``, its number in governance order, over all or ``within`` groups (of a bounded size)."""
    unknown = F.struct(*[F.lit(NO_TIER).alias(c) for c in ("tier", "jurisdiction", "intra_order")], F.col("framework_key").alias("key"))
    joined = controls.join(governance_key(frameworks), "framework_key", "left").withColumn("gov", F.coalesce("gov", unknown))
    if within:
        return joined.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy("gov", "uid"))).drop("gov")
    # dealt by ranges of the order: neither a large framework nor the whole is sorted in one task
    return numbered(joined.withColumn("__all", F.lit(0)), ["__all"], ["gov", "uid"], "place").drop("gov", "__all")


def tier_bands(frameworks: DataFrame, controls: DataFrame) -> DataFrame:
    """(tier, framework_key, n): every tier, and every placed framework even if empty; frameworks without a tier have no band."""
    tiers = frameworks.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("tier"))
    n = controls.groupBy("framework_key").agg(F.count(F.lit(1)).alias("n"))
    placed = frameworks.where("tier is not null").select(F.col("tier").cast("int").alias("tier"), "framework_key")
    return tiers.join(placed, "tier", "left").join(n, "framework_key", "left").select("tier", "framework_key", F.coalesce("n", F.lit(0)).alias("n"))


def resolve_aliases(uids: DataFrame, aliases: DataFrame) -> DataFrame:
    """``uids(uid)`` with ``resolved``: the new uid where an alias names one."""
    return uids.join(aliases.select(F.col("old_uid").alias("uid"), F.col("uid").alias("__new")), "uid", "left").withColumn("resolved", F.coalesce("__new", "uid")).drop("__new")


def preferred(uids: DataFrame, details: DataFrame, group: list[str]) -> DataFrame:
    """``uids`` without broad rows whose detailed row (``details(broad_uid, uid)``) stands in the same group."""
    present = details.join(uids.select(*group, "uid"), "uid").select(*group, F.col("broad_uid").alias("uid")).distinct()
    return uids.join(present, [*group, "uid"], "left_anti")


def family_counts(controls: DataFrame, families: DataFrame) -> DataFrame:
    """(family, n_frameworks, n): ``families(framework_key, family)``; a framework outside it is its own family."""
    joined = controls.join(families, "framework_key", "left").withColumn("family", F.coalesce("family", "framework_key"))
    return joined.groupBy("family").agg(F.countDistinct("framework_key").alias("n_frameworks"), F.count(F.lit(1)).alias("n"))


def statements_for(statements: DataFrame) -> DataFrame:
    """``statements`` numbered for each control, published ones first, then as loaded."""
    order = Window.partitionBy("control_uid").orderBy(F.when(F.col("provenance") == "published", 0).otherwise(1), "load_seq")
    return statements.withColumn("nth", F.row_number().over(order))


def links_from(links: DataFrame, uids: DataFrame, provenance: str | None = None) -> DataFrame:
    """The links that go out from ``uids(uid)``, of one provenance if it is given; ``published`` are those that may be cited."""
    out = links.join(uids.select(F.col("uid").alias("source_uid")).distinct(), "source_uid", "left_semi")
    return out if provenance is None else out.where(F.col("provenance") == provenance)


def techniques_for(mitigations: DataFrame, mitigates: DataFrame, techniques: DataFrame) -> DataFrame:
    """(mitigation_id, technique...) of every technique that the given mitigations mitigate; edges to techniques that aren't loaded go."""
    return mitigates.join(mitigations.select("mitigation_id").distinct(), "mitigation_id", "left_semi").select("mitigation_id", "technique_id").distinct().join(techniques, "technique_id")


def mitigations_for(techniques: DataFrame, mitigates: DataFrame, mitigations: DataFrame) -> DataFrame:
    """(technique_id, mitigation...) of every mitigation of the given techniques; edges from mitigations that aren't loaded go."""
    return mitigates.join(techniques.select("technique_id").distinct(), "technique_id", "left_semi").select("mitigation_id", "technique_id").distinct().join(mitigations, "mitigation_id")


def broad_uid(uid: Column, pattern: str, codes: dict[str, str], broad: str) -> Column:
    """The uid of the broad control that a detailed one belongs to: the whole uid fits ``pattern``, whose group is one of ``codes``; else null."""
    low = F.lower(uid)
    code = F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), F.regexp_extract(low, f"^(?:{pattern})$", 1))
    return F.concat(F.lit(f"{broad}:"), code)

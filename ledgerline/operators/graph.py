"""Hierarchy and links: closures by frontier joins, relations from both sides, paths of two hops and chains.

No graph is collected: closures double their chains by joins, paths are joined a step at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.common import materialise
from ledgerline.operators.corpus import NO_TIER, governance_key


def ancestors(controls: DataFrame) -> DataFrame:
    """(uid, ancestor_uid, level): level 1 is the parent. It stops at a missing parent and at a repeated one, however many levels there are.

    Only nodes that are parents themselves keep a chain of ancestors; a chain is doubled a round by that of its last node,
    so there are as many rounds as the logarithm of the depth. All others take their parent's chain in one join. Uids are unique.
    """
    edges = controls.where("parent_uid is not null and uid <> parent_uid").select("uid", "parent_uid")
    edges = materialise(edges.join(controls.select(F.col("uid").alias("parent_uid")), "parent_uid", "left_semi").select("uid", "parent_uid"))
    inner = edges.join(edges.select(F.col("parent_uid").alias("uid")), "uid", "left_semi")
    chains = materialise(inner.select("uid", F.array("parent_uid").alias("chain")))
    fresh = "slice(more, 1, coalesce(array_position(transform(more, x -> x = uid or array_contains(chain, x)), true) - 1, 0) + if(exists(more, x -> x = uid or array_contains(chain, x)), 0, size(more) + 1))"
    open_, done = chains, None
    while True:
        nxt = chains.select(F.col("uid").alias("__last"), F.col("chain").alias("more"))
        grown = open_.withColumn("__last", F.element_at("chain", -1)).join(nxt, "__last", "left")
        grown = grown.select("uid", "chain", F.when(F.col("more").isNotNull(), F.expr(fresh)).otherwise(F.array().cast("array<string>")).alias("add"), F.size("more").alias("n"))
        grown = materialise(grown.select("uid", F.concat("chain", "add").alias("chain"), (F.size("add") == F.col("n")).alias("on")))
        ended = grown.where("on is null or not on").select("uid", "chain")
        done = ended if done is None else done.union(ended)
        open_ = grown.where("on").select("uid", "chain")
        chains = done.union(open_)
        if open_.isEmpty():
            break
    above = chains.select(F.col("uid").alias("parent_uid"), F.col("chain").alias("more"))
    found = edges.join(above, "parent_uid", "left").withColumn("chain", F.array("parent_uid"))
    found = found.select("uid", F.concat("chain", F.when(F.col("more").isNotNull(), F.expr(fresh)).otherwise(F.array().cast("array<string>"))).alias("chain"))
    return found.select("uid", F.posexplode("chain").alias("level", "ancestor_uid")).select("uid", "ancestor_uid", (F.col("level") + 1).alias("level"))


def descendants(controls: DataFrame) -> DataFrame:
    """(uid, relative_uid, kind): children, further descendants and siblings."""
    up = ancestors(controls)
    below = up.select(F.col("ancestor_uid").alias("uid"), F.col("uid").alias("relative_uid"), F.when(F.col("level") == 1, "child").otherwise("descendant").alias("kind"))
    a, b = controls.select("uid", "parent_uid"), controls.select(F.col("uid").alias("relative_uid"), F.col("parent_uid").alias("__p"))
    siblings = a.join(b, F.col("parent_uid") == F.col("__p")).where("uid <> relative_uid").select("uid", "relative_uid", F.lit("sibling").alias("kind"))
    return below.union(siblings)


def quotable_text(controls: DataFrame) -> DataFrame:
    """(uid, n_stems, quotable): the texts above a control that its own text goes on from, and both joined.

    A text goes on from its parent's while it begins in lower case or the parent's ends in a colon or semicolon.
    """
    texts = controls.select("uid", F.coalesce("text", F.lit("")).alias("text"))
    up = ancestors(controls).join(texts.select(F.col("uid").alias("ancestor_uid"), F.col("text").alias("above")), "ancestor_uid")
    chain = Window.partitionBy("uid").orderBy("level")
    own = texts.withColumnRenamed("text", "own")
    up = up.join(own, "uid").withColumn("child", F.coalesce(F.lag("above").over(chain), F.col("own")))
    goes_on = F.substring("child", 1, 1).rlike("^[a-z]") | F.trim("above").rlike("[:;]$")
    up = up.withColumn("all", F.min(goes_on.cast("int")).over(chain.rowsBetween(Window.unboundedPreceding, 0))).where("all = 1")
    stems = up.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("level", "above")), asc=False).alias("s"))
    out = own.join(stems, "uid", "left")
    return out.select("uid", F.coalesce(F.size("s"), F.lit(0)).alias("n_stems"), F.concat_ws(" ", F.col("s.above"), "own").alias("quotable"))


def breadcrumbs(controls: DataFrame) -> DataFrame:
    """(uid, crumb): the uids from the root down."""
    up = ancestors(controls).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("level", "ancestor_uid")), asc=False).alias("s"))
    return controls.select("uid").join(up, "uid", "left").select("uid", F.concat_ws(" > ", F.col("s.ancestor_uid"), "uid").alias("crumb"))


def relations(links: DataFrame) -> DataFrame:
    """Every link read from both its ends: (uid, other_uid, outward, kind, provenance, asserted_by, load_seq)."""
    rest = ["kind", "provenance", "asserted_by", "load_seq"]
    out = links.select(F.col("source_uid").alias("uid"), F.col("target_uid").alias("other_uid"), F.lit(True).alias("outward"), *rest)
    return out.union(links.select("target_uid", "source_uid", F.lit(False), *rest))


def framework_of(uid: Column) -> Column:
    return F.substring_index(uid, ":", 1)


def lineage_bands(uids: DataFrame, links: DataFrame, provenances: list[str]) -> DataFrame:
    """(uid, provenance, n, note): each provenance for each control, whether or not it has links."""
    bands = uids.select("uid").distinct().withColumn("provenance", F.explode(F.array(*[F.lit(p) for p in provenances])))
    rel = relations(links)
    n = rel.groupBy("uid", "provenance").agg(F.countDistinct("other_uid").alias("n"))
    mapped = rel.select(framework_of(F.col("uid")).alias("framework_key"), F.lit(True).alias("mapped")).distinct()
    out = bands.join(n, ["uid", "provenance"], "left").withColumn("framework_key", framework_of(F.col("uid"))).join(mapped, "framework_key", "left")
    note = F.when(F.col("n") > 0, "").when(F.col("mapped"), "mapped, but not this one").otherwise("never mapped")
    return out.select("uid", "provenance", F.coalesce("n", F.lit(0)).alias("n"), note.alias("note"))


def lineage(uids: DataFrame, links: DataFrame, frameworks: DataFrame, provenances: list[str] | None = None) -> DataFrame:
    """(uid, provenance, nth, other_uid, kind, outward, load_seq, note): each provenance of each control with its neighbours in governance order, or one row with a note.

    A neighbour that several links reach takes as many places, each of them with the last of these links (outgoing ones come first, then
    by load order, then by kind, so that the order of the rows doesn't count). ``frameworks(framework_key, short_name, tier, jurisdiction, intra_order)``; an unknown one comes last. The notes tell
    a derived band in which nothing was matched from a framework that nobody maps and from one that is mapped elsewhere.
    """
    provenances = provenances or ["published", "published-tag", "derived"]
    wanted = uids.select("uid").distinct()
    rel = relations(links).join(wanted, "uid", "left_semi").where(F.col("provenance").isin(provenances))
    seq = F.struct((~F.col("outward")).cast("int").alias("inward"), "load_seq", "kind")
    last = rel.groupBy("uid", "provenance", "other_uid").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("kind", "outward", "load_seq"), seq).alias("r"))
    gov = governance_key(frameworks).withColumnRenamed("framework_key", "__f")
    far = F.struct(*[F.lit(NO_TIER).alias(c) for c in ("tier", "jurisdiction", "intra_order")], F.col("__f").alias("key"))
    placed = last.withColumn("__f", framework_of(F.col("other_uid"))).join(gov, "__f", "left").withColumn("gov", F.coalesce("gov", far))
    listed = placed.groupBy("uid", "provenance").agg(F.array_sort(F.collect_list(F.struct("gov", "other_uid", "r", "n"))).alias("others"))
    said = listed.select("uid", "provenance", F.flatten(F.transform("others", lambda o: F.array_repeat(o, o["n"].cast("int")))).alias("others"))

    bands = wanted.withColumn("provenance", F.explode(F.array(*[F.lit(p) for p in provenances]))).withColumn("framework_key", framework_of(F.col("uid")))
    mapped = mapped_frameworks(links).withColumn("mapped", F.lit(True))
    out = bands.join(said, ["uid", "provenance"], "left").join(mapped, "framework_key", "left").join(frameworks.select("framework_key", "short_name"), "framework_key", "left")
    name = F.coalesce("short_name", "framework_key")
    note = F.when(F.col("provenance") == "derived", F.lit("nothing was matched to this control"))
    note = note.when(F.col("mapped"), F.concat(name, F.lit(" has "), "provenance", F.lit(" links, none of this control"))).otherwise(F.concat(F.lit("nobody maps "), name))
    out = out.withColumn("note", F.when(F.col("others").isNull(), note)).select("uid", "provenance", "note", F.posexplode_outer("others").alias("p", "o"))
    return out.select("uid", "provenance", (F.col("p") + 1).alias("nth"), "o.other_uid", "o.r.kind", "o.r.outward", "o.r.load_seq", "note")


def mapped_frameworks(links: DataFrame) -> DataFrame:
    return relations(links).select(framework_of(F.col("uid")).alias("framework_key")).distinct()


def two_hop_paths(links: DataFrame, provenances: list[str] | None = ("published",)) -> DataFrame:
    """(start, via, end, first_kind, second_kind): the second hop leaves both documents of the first."""
    rel = relations(links)
    if provenances is not None:
        rel = rel.where(F.col("provenance").isin(list(provenances)))
    a = rel.select(F.col("uid").alias("start"), F.col("other_uid").alias("via"), F.col("kind").alias("first_kind"))
    b = rel.select(F.col("uid").alias("via"), F.col("other_uid").alias("end"), F.col("kind").alias("second_kind"))
    paths = a.join(b, "via")
    f = {c: framework_of(F.col(c)) for c in ("start", "via", "end")}
    return paths.where((f["end"] != f["via"]) & (f["end"] != f["start"])).select("start", "via", "end", "first_kind", "second_kind")


def two_hop_counts(links: DataFrame, provenances: list[str] | None = ("published",)) -> DataFrame:
    """(a, via, b, first_kind, second_kind, n): how many paths of two hops lead from a document over a control to another document.

    The links at a control are counted by document and kind before they meet, so no path is made: a hub costs the square of
    the documents around it, not of its links.
    """
    rel = relations(links)
    if provenances is not None:
        rel = rel.where(F.col("provenance").isin(list(provenances)))
    ends = rel.groupBy(F.col("other_uid").alias("via"), framework_of(F.col("uid")).alias("a"), F.col("kind").alias("first_kind")).agg(F.count(F.lit(1)).alias("n"))
    more = rel.groupBy(F.col("uid").alias("via"), framework_of(F.col("other_uid")).alias("b"), F.col("kind").alias("second_kind")).agg(F.count(F.lit(1)).alias("m"))
    met = ends.join(more, "via").where((F.col("b") != framework_of(F.col("via"))) & (F.col("b") != F.col("a")))
    return met.select("a", "via", "b", "first_kind", "second_kind", (F.col("n") * F.col("m")).alias("n"))


HOP = "array<struct<source:string,target:string,kind:string,provenance:string,outward:boolean,structural:boolean>>"


def chains(starts: DataFrame, links: DataFrame, controls: DataFrame, tiers: DataFrame, most: int = 4, per_framework: int = 3, limit: int = 12, derived: bool = False) -> DataFrame:
    """(start, uid, level, path): what a control leads to in lower tiers, level by level, for all starts at once.

    A step follows a link, or goes to the parent or a child; a document once left isn't entered again, and a path
    that went up doesn't go down nor the other way round. A node counts for a start when it is first seen, in the
    order of the path's steps (out-links, in-links, parent, children; each as loaded). An end is reached by a link,
    into a document of a lower tier (a larger number). Each start keeps ``per_framework`` ends a document and
    ``limit`` in all.
    """
    rel = relations(links)
    if not derived:
        rel = rel.where("provenance <> 'derived'")
    step = rel.select("uid", "other_uid", "outward", "kind", "provenance", F.lit("link").alias("move"), F.struct(F.when(F.col("outward"), 0).otherwise(1).alias("a"), "load_seq").alias("seq"))
    tree = controls.where("parent_uid is not null").select("uid", "parent_uid", "load_seq")
    none = F.lit(None).cast("string")
    up = tree.select("uid", F.col("parent_uid").alias("other_uid"), F.lit(True).alias("outward"), none.alias("kind"), none.alias("provenance"), F.lit("up").alias("move"), F.struct(F.lit(2).alias("a"), "load_seq").alias("seq"))
    down = tree.select(F.col("parent_uid").alias("uid"), F.col("uid").alias("other_uid"), F.lit(False).alias("outward"), none.alias("kind"), none.alias("provenance"), F.lit("down").alias("move"), F.struct(F.lit(3).alias("a"), "load_seq").alias("seq"))
    steps = materialise(step.union(up).union(down))
    tier = tiers.select(F.col("framework_key").alias("__fw"), "tier")
    start = starts.select(F.col("uid").alias("start")).distinct().withColumn("fw", framework_of(F.col("start"))).join(tier, F.col("fw") == F.col("__fw"), "left")
    front = start.select("start", F.col("tier").alias("start_tier"), F.col("start").alias("node"), F.array("fw").alias("left"), F.lit("").alias("way"), F.array().cast("array<struct<a:int,load_seq:bigint>>").alias("seq"), F.array().cast(HOP).alias("path"))
    seen = materialise(front.select("start", "node"))
    front, ends = materialise(front), None
    for level in range(1, most + 1):
        s = steps.withColumnRenamed("seq", "s")
        new = front.join(s, F.col("node") == F.col("uid"))
        here, there = framework_of(F.col("node")), framework_of(F.col("other_uid"))
        same = here == there
        new = new.where(((F.col("move") == "link") & ~F.array_contains("left", there)) | ((F.col("move") != "link") & same))
        new = new.where(~((F.col("move") == "down") & (F.col("way") == "up")) & ~((F.col("move") == "up") & (F.col("way") == "down")))
        hop = F.struct(F.col("node").alias("source"), F.col("other_uid").alias("target"), "kind", "provenance", "outward", (F.col("move") != "link").alias("structural"))
        new = new.select(
            "start", "start_tier", F.col("other_uid").alias("node"), F.when(F.col("move") == "link", F.concat("left", F.array(there))).otherwise(F.col("left")).alias("left"),
            F.when(F.col("move") == "link", F.lit("")).otherwise(F.col("move")).alias("way"), F.concat("seq", F.array("s")).alias("seq"), F.concat("path", F.array(hop)).alias("path"), "move",
        )
        new = new.join(seen, ["start", "node"], "left_anti")
        first = Window.partitionBy("start", "node").orderBy("seq")
        new = materialise(new.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n"))
        if new.isEmpty():
            break
        seen = materialise(seen.union(new.select("start", "node")))
        hit = new.where("move = 'link'").withColumn("fw", framework_of(F.col("node"))).join(tier, F.col("fw") == F.col("__fw")).where("tier > start_tier").select("start", F.col("node").alias("uid"), "fw", F.lit(level).alias("level"), "seq", "path")
        ends = hit if ends is None else ends.union(hit)
        front = new.drop("move")
    if ends is None:
        ends = front.limit(0).select("start", F.col("node").alias("uid"), F.lit("").alias("fw"), F.lit(0).alias("level"), "seq", "path")
    ends = ends.withColumn("__f", F.row_number().over(Window.partitionBy("start", "fw").orderBy("level", "seq"))).where(F.col("__f") <= per_framework)
    ends = ends.withColumn("__n", F.row_number().over(Window.partitionBy("start").orderBy("level", "seq"))).where(F.col("__n") <= limit)
    return ends.select("start", "uid", "level", "path")


def path_semantics(paths: DataFrame) -> DataFrame:
    """``paths`` with the strength of the weakest hop, and the obligation point: the target of the last incorporating hop, none if any hop only aligns."""
    rank = "aggregate(path, 0, (a, h) -> greatest(a, case h.provenance when 'published' then 0 when 'published-tag' then 1 when 'derived' then 2 else 0 end))"
    strength = F.get(F.array(F.lit("published"), F.lit("published-tag"), F.lit("derived")), F.expr(rank))
    last = "get(filter(path, h -> h.kind = 'incorporates'), size(filter(path, h -> h.kind = 'incorporates')) - 1).target"
    obligation = F.when(~F.expr("exists(path, h -> coalesce(h.kind = 'aligns-with', false))"), F.expr(last))
    return paths.withColumn("strength", strength).withColumn("obligation_uid", obligation).withColumn("carries", F.col("obligation_uid").isNotNull())


def direction_note(outward: Column, asserted_by: Column, kind: Column) -> Column:
    """Who asserts a link, said from the side it is read from."""
    who = F.coalesce(asserted_by, F.lit("this engine"))
    return F.when(outward, F.concat(who, F.lit(" says this "), kind, F.lit(" it"))).otherwise(F.concat(who, F.lit(" says it "), kind, F.lit(" this")))


def bridge_by_name(mapped: DataFrame, targets: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(source_uid, target_uid, provenance): a section-path segment names a target; ``aliases(segment, required, name)`` narrow others by a phrase.

    ``mapped(uid, section_ref, text)``, ``targets(uid, name)``.
    """
    parts = mapped.select("uid", "text", F.explode(F.split("section_ref", ">")).alias("segment")).withColumn("segment", F.lower(F.trim("segment")))
    names = targets.select(F.col("uid").alias("target_uid"), F.lower(F.trim("name")).alias("name"))
    direct = parts.join(names, F.col("segment") == F.col("name")).select(F.col("uid").alias("source_uid"), "target_uid", F.lit("published-tag").alias("provenance"))
    if aliases is None:
        return direct.distinct()
    by_alias = parts.join(aliases.select(F.lower("segment").alias("segment"), "required", F.lower("name").alias("name")), "segment")
    by_alias = by_alias.where(F.lower("text").contains(F.lower("required"))).join(names, "name").select(F.col("uid").alias("source_uid"), "target_uid", F.lit("derived").alias("provenance"))
    return direct.union(by_alias.join(direct.select("source_uid", "target_uid"), ["source_uid", "target_uid"], "left_anti")).distinct()


def bridge_by_strategy(mapped: DataFrame, targets: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, unmatched): from controls that name strategies to the controls that stand under a heading of that name, or under what an alias says.

    ``mapped(uid, strategy)``, ``targets(uid, section_ref, text)`` with the headings above a target parted by ``>``, and the rule table ``aliases(strategy, sections
    ARRAY, requires ARRAY, excludes ARRAY)``, all in any case. Where a heading is called like the strategy, links are ``published-tag`` and no alias is
    read; else a target under one of the alias's sections is linked as ``derived`` if its text has any of the required phrases (when there are some) and none of
    the excluded ones. Links are (source_uid, target_uid, provenance, strategy, section); unmatched are strategies with neither.
    """
    low = lambda c: F.lower(F.trim(c))
    named = mapped.select(F.col("uid").alias("source_uid"), F.trim("strategy").alias("strategy"), low("strategy").alias("name")).distinct()
    under = targets.select(F.col("uid").alias("target_uid"), "text", F.explode(F.array_distinct(F.transform(F.split("section_ref", ">"), low))).alias("section")).where("section <> ''")
    headings = under.select(F.col("section").alias("name")).distinct()
    direct = named.join(under.drop("text"), F.col("name") == F.col("section")).select("source_uid", "target_uid", F.lit("published-tag").alias("provenance"), "strategy", "section")
    other = named.join(headings, "name", "left_anti")
    rules = aliases.select(low("strategy").alias("name"), "sections", "requires", "excludes")
    none = F.array().cast("array<string>")
    has = lambda c: F.exists(F.coalesce(c, none), lambda p: F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lower(p)))
    read = other.join(rules, "name").select("source_uid", "strategy", "requires", "excludes", F.explode(F.transform("sections", low)).alias("section")).join(under, "section")
    read = read.where(((F.coalesce(F.size("requires"), F.lit(0)) <= 0) | has("requires")) & ~has("excludes"))
    links = direct.union(read.select("source_uid", "target_uid", F.lit("derived"), "strategy", "section"))
    return links, other.join(rules.select("name"), "name", "left_anti").select("strategy").distinct()


def align_by_title(left: DataFrame, right: DataFrame) -> DataFrame:
    """(source_uid, target_uid): equal titles at the top level, blanks and case aside."""
    t = F.lower(F.trim("title"))
    a = left.where("depth = 0").select(F.col("uid").alias("source_uid"), t.alias("t"))
    return a.join(right.where("depth = 0").select(F.col("uid").alias("target_uid"), t.alias("t")), "t").select("source_uid", "target_uid")


def profile_tags(controls: DataFrame, profile: DataFrame, tag: str) -> DataFrame:
    """(uid, tags): the values under which a profile selects a control, sorted; controls that none selects have an empty list."""
    chosen = profile.groupBy("uid").agg(F.array_sort(F.collect_set("value")).alias("__v"))
    return controls.select("uid").join(chosen, "uid", "left").select("uid", F.create_map(F.lit(tag), F.coalesce("__v", F.array().cast("array<string>"))).alias("tags"))


def threat_match(texts: DataFrame, mitigations: DataFrame, stem_weights: DataFrame, shared: DataFrame | None = None, limit: int = 3, least: float = 0.45, near_best: float = 0.75) -> DataFrame:
    """(uid, mitigation_id, score): the weighted share of a mitigation's name that a control says (0.65), the share of the control that the mitigation's body says (0.20), and 0.45 for a shared concept; 1 at most.

    ``texts(uid, stem)``, ``mitigations(mitigation_id, part, stem)`` with part name or body, ``stem_weights(stem, weight)``,
    ``shared(uid, mitigation_id)`` as ``shared_concepts`` gives it; a concept alone makes a match.
    """
    said, parts = texts.select("uid", "stem").distinct().join(stem_weights, "stem"), mitigations.distinct()
    name, body = parts.where("part = 'name'").drop("part").join(stem_weights, "stem"), parts.where("part = 'body'").drop("part")
    # the body gives 0.20 at most, so without a shared concept a pair needs this share of the name; its lightest stems that weigh less together find no pair
    need = (least - 0.20) / 0.65
    inside = Window.partitionBy("mitigation_id")
    name = name.withColumn("total", F.sum("weight").over(inside))
    lighter = inside.orderBy("weight", "stem").rowsBetween(Window.unboundedPreceding, 0)
    name = materialise(name.withColumn("light", F.sum("weight").over(lighter) < (need - 1e-6) * F.col("total")))
    met = name.where("not light").select("mitigation_id", "stem").join(said.select("uid", "stem"), "stem").select("uid", "mitigation_id").distinct()
    named = shared.select("uid", "mitigation_id").distinct() if shared is not None else None
    met = met if named is None else met.union(named).distinct()
    by_name = met.join(name.select("mitigation_id", "stem", "weight", "total"), "mitigation_id").join(said.select("uid", "stem"), ["uid", "stem"]).groupBy("uid", "mitigation_id", "total").agg(F.sum("weight").alias("got"))
    by_name = by_name.select("uid", "mitigation_id", (0.65 * F.col("got") / F.col("total")).alias("c"))
    cover = by_name if named is None else by_name.union(named.withColumn("c", F.lit(0.45)))
    # bodies are weighed only for pairs that can still pass
    able = materialise(cover.groupBy("uid", "mitigation_id").agg(F.sum("c").alias("c")).where(F.col("c") >= least - 0.20 - 1e-6))
    by_body = able.select("uid", "mitigation_id").join(body, "mitigation_id").join(said, ["uid", "stem"]).groupBy("uid", "mitigation_id").agg(F.sum("weight").alias("got"))
    by_body = by_body.join(said.groupBy("uid").agg(F.sum("weight").alias("total")), "uid").select("uid", "mitigation_id", (0.20 * F.col("got") / F.col("total")).alias("c"))
    scored = able.union(by_body).groupBy("uid", "mitigation_id").agg(F.round(F.least(F.lit(1.0), F.sum("c")), 6).alias("score")).where(F.col("score") >= least)
    w = Window.partitionBy("uid")
    scored = scored.withColumn("best", F.max("score").over(w)).where(F.col("score") >= near_best * F.col("best"))
    return scored.withColumn("n", F.row_number().over(w.orderBy(F.desc("score"), "mitigation_id"))).where(F.col("n") <= limit).select("uid", "mitigation_id", "score")


def shared_concepts(left: DataFrame, right: DataFrame, left_key: str = "uid", right_key: str = "mitigation_id") -> DataFrame:
    """(left_key, right_key) of every two that name a concept in common; ``left(left_key, concept)``, ``right(right_key, concept)`` as ``concepts_in`` gives them."""
    return left.join(right, "concept").select(left_key, right_key).distinct()


def tactic_counts(matches: DataFrame, mitigates: DataFrame, techniques: DataFrame) -> DataFrame:
    """(uid, tactic, n): tactics of the techniques that a control's mitigations mitigate."""
    reached = matches.select("uid", "mitigation_id").join(mitigates, "mitigation_id").select("uid", "technique_id").distinct()
    return reached.join(techniques, "technique_id").select("uid", F.explode("tactics").alias("tactic")).groupBy("uid", "tactic").agg(F.count(F.lit(1)).alias("n"))

"""Stated quantities: where they stand, what bounds them, and how sets of them compare.

All of it is Catalyst expressions over the text, a row a quantity; nothing is a UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import rules

UNITS = "seconds|second|minutes|minute|hours|hour|days|day|weeks|week|months|month|years|year|bits|bit|characters|character"
NUMBER = r"(?:\d[\d,]*(?:\.\d+)?|" + "|".join(sorted(rules.WORD_NUMBERS, key=len, reverse=True)) + ")"
QUANTITY = rf"(?i)(?<![\w.-])({NUMBER})\s*({UNITS})\b"
LOOK_BACK = 52


def quantities(texts: DataFrame, key: str = "uid") -> DataFrame:
    """(key, nth, start, end, value, unit, flat) of every quantity in ``texts(key, text)``; offsets are those of the text."""
    flat = F.translate(F.coalesce("text", F.lit("")), "\n", " ")
    rows = texts.select(key, flat.alias("flat")).where(F.col("flat").rlike(QUANTITY))
    rows = rows.withColumn("m", F.regexp_extract_all("flat", F.lit(QUANTITY), F.lit(0))).withColumn("gap", F.split("flat", QUANTITY, -1))
    rows = rows.select(key, "flat", "m", "gap", F.posexplode("m").alias("nth", "found"))
    lengths = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    start = lengths(F.col("gap"), F.col("nth") + 1) + lengths(F.col("m"), F.col("nth"))
    word = F.lower(F.regexp_extract("found", QUANTITY, 1))
    numbers = F.create_map(*[F.lit(x) for kv in rules.WORD_NUMBERS.items() for x in (kv[0], float(kv[1]))])
    value = F.coalesce(F.try_element_at(numbers, word), F.regexp_replace(word, ",", "").try_cast("double"))
    unit = F.regexp_replace(F.lower(F.regexp_extract("found", QUANTITY, 2)), "s$", "")
    return rows.select(key, "nth", start.alias("start"), (start + F.length("found")).alias("end"), value.alias("value"), unit.alias("unit"), "flat").where("value is not null")


def dimension(unit: Column) -> Column:
    return F.when(unit == "bit", "bits").when(unit == "character", "characters").otherwise("time")


def canonical(value: Column, unit: Column) -> Column:
    """Hours, bits or characters."""
    hours = F.create_map(*[F.lit(x) for kv in {**rules.EXACT_HOURS, **rules.CALENDAR_HOURS}.items() for x in kv])
    return value * F.coalesce(F.try_element_at(hours, unit), F.lit(1.0))


def _last_place(text: Column, phrase: Column) -> Column:
    """Where a phrase begins last, from 0; -1 if nowhere."""
    at = F.instr(F.reverse(text), F.reverse(phrase))
    return F.when(at > 0, F.length(text) - at - F.length(phrase) + 1).otherwise(-1)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def read_bound(window: Column) -> Column:
    """(bound, negated, cadence, inferred) from the words before a number, lower case and single blanks.

    A phrase counts if it runs up to the number (two characters of slack); the one that begins first wins. A
    negation before it turns the bound round unless the phrase carries its own; a cadence makes it a ceiling. With
    no such phrase, the nearest loose word decides, and the reading is marked as inferred.
    """
    return _let(window, lambda w: _let(_first_bound(w), lambda first: _bound_from(w, first)))


def _first_bound(window: Column) -> Column:
    phrases = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(p).alias("p"), F.lit(b).alias("bound"), F.lit(s).alias("own")) for k, (p, b, s) in enumerate(rules.BOUNDS)])

    def placed(x: Column) -> Column:
        at = _last_place(window, x["p"])
        return F.struct(F.when((at >= 0) & (at + F.length(x["p"]) >= F.length(window) - 2), at).alias("at"), x["ord"].alias("ord"), x["bound"].alias("bound"), x["own"].alias("own"))

    return F.array_min(F.filter(F.transform(phrases, placed), lambda x: x["at"].isNotNull()))


def _bound_from(window: Column, first: Column) -> Column:
    cadence = F.lit(False)
    for c in rules.CADENCE:
        cadence = cadence | F.endswith(window, F.lit(c))
    tail = F.when(first.isNotNull(), F.substring(window, F.greatest(first["at"] - 24, F.lit(0)) + 1, F.least(first["at"], F.lit(24)))).otherwise(F.right(window, F.lit(24)))
    negated = F.lit(False)
    for n in rules.NEGATIONS:
        negated = negated | F.contains(tail, F.lit(n))
    negated = negated & ~F.coalesce(first["own"], F.lit(False))
    bound = F.coalesce(first["bound"], F.lit("unstated"))
    turned = F.when(negated & (bound == "at most"), "at least").when(negated & (bound == "at least"), "at most").otherwise(bound)
    turned = F.when(cadence, "at most").otherwise(turned)
    loose = F.array(*[F.struct(_last_place(window, F.lit(p)).alias("at"), F.lit(-k).alias("ord"), F.lit(b).alias("bound")) for k, (p, b) in enumerate(rules.LOOSE_BOUNDS)])
    near = F.array_max(F.filter(loose, lambda x: x["at"] >= 0))
    inferred = (turned == "unstated") & near.isNotNull()
    return F.struct(F.when(inferred, near["bound"]).otherwise(turned).alias("bound"), negated.alias("negated"), cadence.alias("cadence"), inferred.alias("inferred"))


def clause(flat: Column, start: Column, end: Column) -> Column:
    """The text around a quantity up to the nearest breaks."""
    breaks = rules.CLAUSE_BREAKS
    left = F.element_at(F.split(F.substring(flat, F.lit(1), start), breaks, -1), -1)
    right = F.element_at(F.split(F.substring(flat, end + 1, F.length(flat)), breaks, -1), 1)
    whole = F.regexp_replace(F.concat(left, F.substring(flat, start + 1, end - start), right), r"\s+", " ")
    return F.regexp_replace(whole, "^[ .;:—-]+|[ .;:—-]+$", "")


def thresholds(texts: DataFrame, key: str = "uid") -> DataFrame:
    """Quantities with their bounds: rates are left out; restatements in brackets and texts that classify are marked."""
    q = quantities(texts, key)
    follows = F.substring("flat", F.col("end") + 1, F.lit(12))
    q = q.where(~follows.rlike(rules.RATE))
    before = F.substring("flat", F.greatest(F.col("start") - LOOK_BACK, F.lit(0)) + 1, F.least(F.col("start"), F.lit(LOOK_BACK)))
    q = q.withColumn("__w", F.trim(F.regexp_replace(F.lower(before), r"\s+", " "))).withColumn("__b", read_bound(F.col("__w")))
    q = q.withColumn("dimension", dimension(F.col("unit"))).withColumn("canonical", canonical(F.col("value"), F.col("unit")))
    q = q.withColumn("approximate", F.col("unit").isin(list(rules.CALENDAR_HOURS)))
    head = F.substring("flat", F.lit(1), F.col("start"))
    opened, closed = _last_place(head, F.lit("(")), _last_place(head, F.lit(")"))
    earlier = F.lag("dimension").over(Window.partitionBy(key).orderBy("nth"))
    restates = F.coalesce((earlier == F.col("dimension")) & (opened >= 0) & (opened > closed) & (F.col("start") - opened <= 24), F.lit(False))
    status = F.lit(False)
    for w in rules.STATUS_WORDS:
        status = status | F.contains(F.lower("flat"), F.lit(w))
    q = q.withColumn("restates", restates).withColumn("classifies", status).withColumn("clause", clause(F.col("flat"), F.col("start"), F.col("end")))
    return q.select(key, "nth", "start", "end", "value", "unit", "dimension", "canonical", "approximate", "__b.*", "restates", "classifies", "clause")


def stated_by(controls: DataFrame, key: str = "uid") -> DataFrame:
    """``thresholds`` of a control's title and text together, restatements left out; ``controls(key, title, text)``. Places count in the joined text."""
    parts = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("text", F.lit("")))
    return thresholds(controls.select(key, F.regexp_replace(parts, r"^[. ]+|[. ]+$", "").alias("text")), key).where("not restates")


def compare(stated: DataFrame, subject: str = "subject_id") -> DataFrame:
    """A row a subject and dimension: how many, the strictest and loosest value if all are ceilings or all floors, what is unstated."""
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    at_most, at_least = F.col("bound") == "at most", F.col("bound") == "at least"
    g = stated.where("not restates").groupBy(subject, "dimension").agg(
        F.count(F.lit(1)).alias("n"), n(at_most).alias("ceilings"), n(at_least).alias("floors"), n(F.col("bound") == "unstated").alias("unstated"),
        F.min(F.when(at_most, F.col("canonical"))).alias("lc"), F.max(F.when(at_most, F.col("canonical"))).alias("hc"), F.min(F.when(at_least, F.col("canonical"))).alias("lf"), F.max(F.when(at_least, F.col("canonical"))).alias("hf"),
        F.max("approximate").alias("approximate"),
    )
    only_c, only_f = (F.col("ceilings") > 0) & (F.col("floors") == 0), (F.col("floors") > 0) & (F.col("ceilings") == 0)
    return g.select(
        subject, "dimension", "n", "unstated", F.when(only_c, F.col("lc")).when(only_f, F.col("hf")).alias("strictest"), F.when(only_c, F.col("hc")).when(only_f, F.col("lf")).alias("loosest"),
        ((F.col("ceilings") > 0) & (F.col("floors") > 0)).alias("mixed"), "approximate",
    )


def disagreements(stated: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Unordered pairs of one subject and dimension from different families whose bound or value differ; ``incompatible``: a floor over a ceiling.

    A framework without a ``family`` in ``stated`` is a family of its own. Equal statements of a family are one, with their number as
    ``copies``, so a pair stands for ``pairs`` of them: what is joined grows with the different statements of a subject, not with their repeats.
    """
    use = stated.where("bound <> 'unstated' and not classifies and not restates")
    use = use.withColumn("family", F.coalesce("family", "framework_key") if "family" in stated.columns else F.col("framework_key"))
    use = use.groupBy(subject, "dimension", "family", "bound", F.round("canonical", 9).alias("canonical")).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("load_seq", "nth")).alias("first"))
    right = use.select(*[F.col(c).alias(f"r_{c}") for c in use.columns])
    pairs = use.join(right, (F.col(subject) == F.col(f"r_{subject}")) & (F.col("dimension") == F.col("r_dimension")))
    pairs = pairs.where((F.col("first") < F.col("r_first")) & (F.col("family") != F.col("r_family"))).withColumn("pairs", F.col("copies") * F.col("r_copies"))
    pairs = pairs.where((F.col("bound") != F.col("r_bound")) | (F.abs(F.col("canonical") - F.col("r_canonical")) >= 1e-9))
    floor = F.when(F.col("bound") == "at least", F.col("canonical")).otherwise(F.col("r_canonical"))
    ceiling = F.when(F.col("bound") == "at most", F.col("canonical")).otherwise(F.col("r_canonical"))
    return pairs.withColumn("incompatible", (F.col("bound") != F.col("r_bound")) & (floor > ceiling))


def on_subject(stated: DataFrame, clause_concepts: DataFrame, subject_concepts: DataFrame, subject: str = "subject_id") -> DataFrame:
    """``stated(subject, clause, ...)`` with ``on_subject``: whether the clause of a quantity shares a concept with its subject; all are where the subject has none.

    ``clause_concepts(clause, concept)`` and ``subject_concepts(subject, concept)`` as ``vocabulary.concepts_in`` gives them.
    """
    has = subject_concepts.select(subject).distinct().withColumn("__has", F.lit(True))
    # only the concepts of clauses that a subject states meet the subject's own, on both keys: no product of clauses and subjects
    said = stated.select(subject, "clause").distinct().join(clause_concepts, "clause")
    shared = said.join(subject_concepts, [subject, "concept"], "left_semi").select(subject, "clause").distinct().withColumn("__shared", F.lit(True))
    out = stated.join(has, subject, "left").join(shared, ["clause", subject], "left")
    return out.withColumn("on_subject", F.col("__has").isNull() | F.col("__shared").isNotNull()).drop("__has", "__shared")


def obligation_of(text: Column) -> Column:
    return (
        F.when(text.rlike(r"(?i)\bmust not\b|\bmay not\b"), "prohibited").when(text.rlike(r"(?i)\bmust\b|\bis required to\b|\bshall\b"), "mandatory").when(text.rlike(r"(?i)\bmay\b"), "permitted").otherwise("informative")
    )


def coverage(frameworks: DataFrame, found: DataFrame, shown: DataFrame) -> DataFrame:
    """(tier, framework_key, total, shown, hidden, state) of every placed framework: says something, or is silent."""
    n = lambda df, name: df.groupBy("framework_key").agg(F.count(F.lit(1)).alias(name))
    out = frameworks.where("tier is not null").join(n(found, "total"), "framework_key", "left").join(n(shown, "shown"), "framework_key", "left").fillna(0, ["total", "shown"])
    return out.select("tier", "framework_key", "total", "shown", F.greatest(F.lit(0), F.col("total") - F.col("shown")).alias("hidden"), F.when(F.col("total") > 0, "says").otherwise("silent").alias("state"))


def coverage_lists(bands: DataFrame, frameworks: DataFrame, absent: DataFrame) -> DataFrame:
    """(list, framework_key, note) beside ``coverage``: the placed documents that are silent, those that aren't loaded with the reason, and the attribution of each document that something is shown of, once.

    ``bands`` as of ``coverage``, ``frameworks(framework_key, attribution)``, ``absent(framework_key, reason)``; a document that is loaded isn't absent.
    """
    none = F.lit(None).cast("string")
    silent = bands.where("state = 'silent'").select(F.lit("silent").alias("list"), "framework_key", none.alias("note"))
    missing = absent.join(frameworks.select("framework_key"), "framework_key", "left_anti").select(F.lit("absent"), "framework_key", "reason")
    shown = bands.where("shown > 0").select("framework_key").join(frameworks.select("framework_key", "attribution"), "framework_key").where("attribution is not null")
    return silent.union(missing).union(shown.select(F.lit("attribution"), "framework_key", "attribution")).distinct()


def readings(controls: DataFrame, currency: DataFrame) -> DataFrame:
    """(uid, summary): the obligation a publisher states, else its own currency, else what the wording says.

    ``controls(uid, framework_key, obligation, published, tags MAP<STRING,STRING>)``, ``currency(framework_key, tag, label, ord)``.
    """
    said = controls.join(currency, "framework_key").withColumn("v", F.try_element_at("tags", "tag")).where("v is not null")
    said = said.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat_ws(": ", "label", "v").alias("t")))).alias("s"))
    out = controls.join(said, "uid", "left")
    summary = (
        F.when(F.col("published") & (F.col("obligation") != "unknown"), F.col("obligation"))
        .when(F.col("s").isNotNull(), F.array_join("s.t", "; "))
        .when(F.col("obligation") != "unknown", F.concat("obligation", F.lit(" (read from the wording)")))
        .otherwise("states no strength")
    )
    return out.select("uid", summary.alias("summary"))

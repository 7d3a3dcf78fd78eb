"""A Merkle manifest of a dataset: a tree for each source, and one over the sources' roots.

A row's leaf is the digest of its columns; every 16 consecutive nodes of a level make one node above. Rows are numbered within
their source without sorting any source in one task, and dealt into aligned blocks of 256. A block keeps each of its levels as one
string of hex digests, 64 letters a node: fixed-width substrings of a level are what the level above hashes, and the substrings on
both sides of a node within its run are its siblings. The digests of the blocks are the nodes of the next round, 256 times fewer, so
there are as many rounds as the logarithm of the largest source; then the sources' roots go the same way. Sibling segments go back
down by joins on (source, block): a row gets those of its block from the round above.

Defined results: nulls are written ``-`` and so differ from empty texts; a null source is a source of its own, first in order; rows
ascend by doc_id, null first, and rows that share one by their leaf; repeated rows have equal leaves, each in its own place; an empty
table has no rows and no root. Only the five columns of ``documents`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialise, numbered

# Nodes a run, hex digits a digest, the columns of a leaf in their order.
FAN = 16
WIDTH = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Every so many checksums of a doc_id, the row's text is changed to show that its proof fails.
EVERY = 5

RUN = FAN * WIDTH
BLOCK = FAN * FAN
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(*values: Column) -> Column:
    """Digest of the values: each ``-`` if null, else its length in bytes, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _parents(level: str) -> str:
    return f"array_join(transform(sequence(0, cast((length({level}) - 1) div {RUN} as int)), r -> sha2(substring({level}, r * {RUN} + 1, {RUN}), 256)), '')"


def _beside(level: str, at: str) -> str:
    """What stands left and right of a node in its run."""
    return f"named_struct('l', substring({level}, ({at} div {FAN}) * {RUN} + 1, ({at} % {FAN}) * {WIDTH}), 'r', substring({level}, ({at} + 1) * {WIDTH} + 1, ({FAN - 1} - {at} % {FAN}) * {WIDTH}))"


def _blocks(nodes: DataFrame) -> DataFrame:
    """One row a block of ``nodes(g, idx, n, digest, own)``: (g, b, n, rows, l0, l1, top). A group of one node has no level above, one of up to 16 has one."""
    rows = F.array_sort(F.collect_list(F.struct((F.col("idx") % BLOCK).cast("int").alias("pos"), "digest", "own")))
    out = nodes.groupBy("g", F.floor(F.col("idx") / BLOCK).alias("b")).agg(F.first("n").alias("n"), rows.alias("rows"))
    out = out.withColumn("l0", F.expr("array_join(rows.digest, '')"))
    out = out.withColumn("l1", F.expr(f"if(n > 1, {_parents('l0')}, '')"))
    return out.withColumn("top", F.expr(f"case when n = 1 then l0 when n <= {FAN} then l1 else {_parents('l1')} end"))


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round over ``nodes(g, idx, n, digest, own)``, and ``(g, digest)`` of the roots."""
    rounds = []
    while True:
        blocks = materialise(_blocks(nodes))
        rounds.append(blocks)
        nodes = blocks.select("g", F.col("b").alias("idx"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("digest"), F.lit(None).cast("string").alias("own"))
        if nodes.where("n > 1").isEmpty():
            return rounds, nodes.select("g", "digest")


def _below(blocks: DataFrame, tails: DataFrame, made: str) -> DataFrame:
    """The rows of ``blocks``, each with what ``made`` says of it (``x``), its path (siblings to the root, ``path``) and the root."""
    steps = f"if(n > 1, array({_beside('l0', 'x.pos')}), array()), if(n > {FAN}, array({_beside('l1', '(x.pos div 16)')}), array()), tail"
    one = f"transform(array(concat({steps})), path -> named_struct('g', g, 'b', b * {BLOCK} + x.pos, 'root', root, {made}))[0]"
    return blocks.join(tails, ["g", "b"]).select(F.inline(F.expr(f"transform(rows, x -> {one})")))


def descend(rounds: list[DataFrame], tails: DataFrame, made: str) -> DataFrame:
    """From ``tails(g, tail, root)`` of the groups down to the rows of the first round."""
    tails = tails.withColumn("b", F.lit(0).cast("long"))
    for blocks in reversed(rounds[1:]):
        tails = materialise(_below(blocks, tails, "'tail', path"))
    return _below(rounds[0], tails, made)


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    row = docs.select(*COLUMNS)
    changed = leaf(*(F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in COLUMNS))
    leaves = row.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("g"),
        leaf(*(F.col(c) for c in COLUMNS)).alias("digest"),
        F.struct("doc_id", F.when(F.crc32(F.col("doc_id").cast("string")) % EVERY == 0, changed).alias("changed")).alias("own"),
    )
    leaves = numbered(materialise(leaves), ["g"], [F.col("own.doc_id"), F.col("digest")])
    rounds, subroots = climb(leaves)
    # the sources' roots, in the order of their names: the same again, as one group
    over = numbered(subroots.select(F.lit("").alias("g"), "digest", F.struct(F.col("g").alias("source")).alias("own")), ["g"], [F.col("own.source")])
    over, roots = climb(over)
    path = "array<struct<l:string,r:string>>"
    tails = roots.select("g", F.expr(f"cast(array() as {path})").alias("tail"), F.col("digest").alias("root"))
    of_source = descend(over, tails, "'source', x.own.source, 'tail', path, 'subroot', x.digest")
    tails = materialise(of_source.select(F.col("source").alias("g"), "tail", F.struct("root", "subroot").alias("root")))
    folded = "aggregate(path, coalesce(x.own.changed, x.digest), (node, s) -> sha2(concat(s.l, node, s.r), 256))"
    proof = "sha2(array_join(transform(path, s -> concat(s.l, s.r)), ''), 256)"
    out = descend(rounds, tails, f"'doc_id', x.own.doc_id, 'leaf', x.digest, 'proof_sha256', {proof}, 'folded_root', {folded}")
    out = out.select("doc_id", "leaf", "root.subroot", "root.root", "proof_sha256", "folded_root")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(docs: DataFrame) -> DataFrame:
    """The contract's row for every document."""
    return manifest(docs)


def oracle(levels: int = 6) -> str:
    """The same rows in DuckDB SQL, level by level, each level of a source in one window; sources of up to 16 ** ``levels`` rows, as many sources."""
    field = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    hashed = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in COLUMNS) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)), lambda a, x: xor(tab[(xor(a, x) & 255) + 1], a >> 8)), 4294967295)"
    bit = "case when {v} & 1 = 1 then xor({v} >> 1, 3988292384) else {v} >> 1 end"
    table = "select list(v order by i) as tab from (select i, v from crc8)"
    steps = ["c0 as (select i, i::bigint as v from range(256) t(i))"] + [f"c{k + 1} as (select i, {bit.format(v='v')} as v from c{k})" for k in range(8)] + ["crc8 as (select * from c8)"]

    def tree(name: str, start: str) -> list[str]:
        out = [f"{name}0 as ({start})"]
        for k in range(levels):
            beside = lambda rows: f"case when n > 1 then coalesce(string_agg(h, '') over (partition by g, i // 16 order by i rows between {rows}), '') else '' end"
            out.append(f"{name}s{k} as (select g, i, n, {beside('unbounded preceding and 1 preceding')} as l, {beside('1 following and unbounded following')} as r from {name}{k})")
            joined = f"select g, i // 16 as i, case when any_value(n) > 1 then sha256(string_agg(h, '' order by i)) else any_value(h) end as h from {name}{k} group by g, i // 16"
            out.append(f"{name}{k + 1} as (select *, count(*) over (partition by g) as n from ({joined}))")
        return out

    def path(name: str, alias: str, at: str, g: str) -> str:
        return " ".join(f"join {name}s{k} {alias}{k} on {alias}{k}.g = {g} and {alias}{k}.i = {at} // {16**k}" for k in range(levels))

    names = [f"a{k}" for k in range(levels)] + [f"b{k}" for k in range(levels)]
    folded = "f0"
    for a in names:
        folded = f"case when {a}.n > 1 then sha256({a}.l || {folded} || {a}.r) else {folded} end"
    base = f"""select doc_id, coalesce('=' || source, '') as g, {hashed("text")} as h,
        case when {crc} % {EVERY} = 0 then {hashed(f"translate(text, '{UPPER}', '{LOWER}')")} end as changed from documents, ({table})"""
    ctes = [
        *steps,
        f"d as ({base})",
        "e as (select *, row_number() over (partition by g order by doc_id nulls first, h) - 1 as i, count(*) over (partition by g) as n, coalesce(changed, h) as f0 from d)",
        *tree("x", "select g, i, n, h from e"),
        f"sub as (select g as source, '' as g, h, row_number() over (order by g) - 1 as i, count(*) over () as n from x{levels})",
        *tree("y", "select g, i, n, h from sub"),
    ]
    return f"""with {", ".join(ctes)} select *, folded_root = root as verified from (
        select e.doc_id, e.h as leaf, sub.h as subroot, y{levels}.h as root, sha256({" || ".join(f"{a}.l || {a}.r" for a in names)}) as proof_sha256, {folded} as folded_root
        from e join sub on sub.source = e.g join y{levels} on true {path("x", "a", "e.i", "e.g")} {path("y", "b", "sub.i", "''")})"""

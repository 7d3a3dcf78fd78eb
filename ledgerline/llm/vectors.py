"""Embedding near duplicates and approximate nearest neighbours, by cosine in double precision.

Both read (vec_id, embedding). A vector takes no part if it is null, empty, zero, or holds a null or a component that
isn't finite. Vectors of different lengths have no cosine: each length is a space of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import by_key, components, materialise, sampled
from ledgerline.llm.near_dup import forest, sorted_groups

BLOCK = 4096
#: Rows that are multiplied with a block at once.
STRIP = 512
#: Lengths that get a fit of their own, commonest first; vectors of any other length share one cell or part, in blocks.
LENGTHS = 8


def by_length(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors as rows) of the vectors that take part, a length at a time.

    A vector is scaled by the power of two that brings its largest component between 0.5 and 1: cosines stay what they
    are to the last bit, and no norm over- or underflows.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(0))
    for dim in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == dim)
        values = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        m = values.reshape(len(rows), dim)  # a null component is NaN
        top = np.abs(m).max(axis=1)
        ok = np.isfinite(top) & (top > 0)
        if ok.any():
            yield rows[ok], np.ldexp(m[ok], -np.frexp(top[ok])[1][:, None])


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def lengths_of(vectors: DataFrame, least: int) -> dict[int, int]:
    """Rows of each of the commonest lengths that at least so many rows have."""
    found = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count().where((F.col("count") >= least) & (F.col("d") > 0))
    return {r["d"]: r["count"] for r in found.orderBy(F.desc("count"), "d").limit(LENGTHS).collect()}


def sample_of(vectors: DataFrame, key: str, dim: int, bound: int, total: int) -> np.ndarray:
    """Unit vectors of about ``bound`` of the ``total`` rows of a length, drawn by a keyed hash of the column ``key``, which tells the rows apart."""
    drawn = vectors.where(F.size("embedding") == dim)
    if total > bound:
        drawn = drawn.where(sampled("vectors", key, bound, total))
    got = [unit(m) for _, m in by_length(drawn.select("embedding").toArrow().column(0))]
    return got[0] if got else np.zeros((0, dim))


def in_slices(batches: Iterator[pa.RecordBatch], keys: int, most: int = 2048) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first ``keys`` columns, cut where one of them changes and before they grow beyond ``most`` rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for k in range(keys):
            c = batch.column(k).to_numpy()
            change |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            for s in range(a, b, most):
                yield batch.slice(s, min(most, b - s))


def spherical_kmeans(u: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit centroids; an empty cell takes the vector worst served."""
    rng = np.random.default_rng(seed)
    c = u[rng.choice(len(u), k, replace=False)]
    for _ in range(rounds):
        s = u @ c.T
        own = s.argmax(axis=1)
        new = np.zeros_like(c)
        np.add.at(new, own, u)
        empty = np.flatnonzero(np.bincount(own, minlength=k) == 0)
        if len(empty):
            new[empty] = u[np.argsort(s.max(axis=1), kind="stable")[: len(empty)]]
        c = unit(new)
    return c


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, per_cell: int = 3000, max_cells: int = 2048, sample: int = 20_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors(vec_id, embedding)``.

    Equal vectors are one vector with a count. Spherical k-means on a bounded sample gives the cells of a length (one for
    each ``per_cell`` rows, ``max_cells`` at most); every vector goes to its nearest centroid's cell and, as a
    guest, to each other cell whose border is nearer than half the chord of the threshold. Of two vectors
    nearer than that chord one is then always a guest in the other's cell, so no link is missed. A cell's own
    vectors lie in blocks of about ``BLOCK``; guests, and those of later blocks, pass by each block in strips and give
    counts of links and a spanning forest, not the links: any number may share a cell. The smallest vec_id of a component is kept.

    Defined results: vectors that take no part (see above) have no link, are their own component and are kept; vectors of
    different lengths have no link; repeated rows are other vectors at cosine 1; a null vec_id comes last in its
    component; an empty table gives no rows. Only vec_id and embedding are read, so other columns can't clash.
    """
    rows = vectors.select("vec_id", "embedding")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[bytes | None] = [None] * batch.num_rows
            for at, m in by_length(batch.column(1)):
                for x, v in zip(at.tolist(), m):
                    names[x] = hashlib.blake2b(v.tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), batch.column(1)], ["vec_id", "digest", "embedding"])

    kinds = dict(rows.dtypes)
    named = materialise(rows.mapInArrow(name, f"vec_id {kinds['vec_id']}, digest binary, embedding {kinds['embedding']}"))
    reps = named.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("vec_id"), F.first("embedding").alias("embedding"))
    reps = materialise(reps)
    centres = {}
    for dim, n in lengths_of(reps, per_cell).items():
        fit = sample_of(reps, "digest", dim, sample, n)
        centres[dim] = spherical_kmeans(fit, int(max(1, min(n // per_cell, max_cells, len(fit) // 4))))
    sent = reps.sparkSession.sparkContext.broadcast(centres)
    half_chord = float(np.sqrt(2 - 2 * cosine) / 2) + 1e-9
    width = -(-max([len(c) for c in centres.values()], default=1) // 8)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = {dim: np.sqrt(np.maximum(0, 2 - 2 * c @ c.T)) for dim, c in sent.value.items()}
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                for at, m in by_length(batch.column("embedding")):
                    dim, u = m.shape[1], unit(m)
                    c = sent.value.get(dim)
                    s = u @ c.T if c is not None else np.zeros((len(u), 1))
                    own = s.argmax(axis=1)
                    border = s[np.arange(len(s)), own][:, None] - s
                    goes = border <= half_chord * apart[dim][own] if c is not None else border == 0
                    goes[np.arange(len(s)), own] = True
                    bits = np.packbits(goes, axis=1)
                    bits = np.hstack([bits, np.zeros((len(bits), width - bits.shape[1]), np.uint8)])
                    r, cell = np.nonzero(goes)
                    take = pa.array(at[r])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(r), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(own[r].astype(np.int32)), pa.array([x.tobytes() for x in bits], pa.binary()).take(pa.array(r)),
                            *(batch.column(k).take(take) for k in ("digest", "copies", "embedding")),
                        ],
                        ["dim", "cell", "home", "cells", "digest", "copies", "embedding"],
                    )

    placed = reps.select("digest", "copies", "embedding").mapInArrow(assign, f"dim int, cell int, home int, cells binary, digest binary, copies long, embedding {kinds['embedding']}")
    # a cell's residents lie in blocks; its guests, and the residents of later blocks, visit each block
    homes = placed.where("cell = home").groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    homes = materialise(homes)
    few = homes.count() <= LENGTHS * max_cells + 10_000  # a row of 12 bytes a cell; more only with thousands of rare lengths
    placed = placed.join(F.broadcast(homes) if few else homes, ["dim", "cell"])
    placed = placed.withColumn("own", F.when(F.col("cell") == F.col("home"), F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")))
    placed = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("own", F.col("blocks") - 1))))
    placed = placed.withColumn("visits", F.coalesce(F.col("own") != F.col("block"), F.lit(True)))
    groups = sorted_groups(placed.select("dim", "cell", "block", "visits", "home", "cells", "digest", "copies", "embedding"), ["dim", "cell", "block"], ["visits"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lived = None, {}
        for g in in_slices(batches, 3, STRIP):
            at = (g.column(0)[0].as_py(), g.column(1)[0].as_py(), g.column(2)[0].as_py())
            ((_, m),) = by_length(g.column("embedding"))
            now = {
                "keys": np.array(g.column("digest").to_pylist(), object), "home": g.column("home").to_numpy(), "copies": g.column("copies").to_numpy(), "u": unit(m),
                "cells": np.frombuffer(b"".join(g.column("cells").to_pylist()), np.uint8).reshape(g.num_rows, -1),
            }
            visits = np.asarray(g.column("visits").to_pylist(), bool)
            if at != held:
                held, lived = at, {k: v[:0] for k, v in now.items()}
            before = len(lived["keys"])
            if not visits.all():
                lived = {k: np.concatenate([lived[k], v[~visits]]) for k, v in now.items()}
            for these in (np.flatnonzero(~visits), np.flatnonzero(visits)):
                if not len(these) or not len(lived["keys"]):
                    continue
                near = now["u"][these] @ lived["u"].T
                x, y = np.nonzero(near >= cosine - 1e-9)
                close = np.flatnonzero(near[x, y] < cosine + 1e-9)  # sums of another order decide at the border
                keep = np.ones(len(x), bool)
                keep[close] = (now["u"][these[x[close]]] * lived["u"][y[close]]).sum(axis=1) >= cosine
                if not visits[these[0]]:  # residents that came now: with those before them, each pair once
                    keep &= y < before + x
                # two vectors that meet in both their cells count in the one with the smaller number
                home = now["home"][these[x]]
                twice = np.flatnonzero(home < at[1])
                keep[twice] &= (lived["cells"][y[twice], home[twice] >> 3] >> (7 - (home[twice] & 7)) & 1) == 0
                x, y = x[keep], y[keep]
                if not len(x):
                    continue
                n = np.concatenate([np.bincount(x, lived["copies"][y], len(these)), np.bincount(y, now["copies"][these[x]], len(lived["keys"]))])
                names = np.concatenate([now["keys"][these], lived["keys"]])
                some = np.flatnonzero(n)
                # a visitor is joined to the first it meets, and that one to the others: as connected as all links
                first = np.full(len(these), -1)
                first[x[::-1]] = y[::-1]
                a, b = np.divmod(np.unique(first[x] * len(names) + y), len(names))
                met = np.flatnonzero(first >= 0)
                tree = forest(len(names), np.concatenate([met, a + len(these)]), np.concatenate([first[met], b]) + len(these))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[z] for z in some] + [names[p] for p, _ in tree], pa.binary()), pa.array([None] * len(some) + [names[q] for _, q in tree], pa.binary()), pa.array(n[some].astype(np.int64).tolist() + [0] * len(tree), pa.int64())],
                    ["a", "b", "n"],
                )

    found = materialise(groups.mapInArrow(compare, "a binary, b binary, n long"))
    counts = found.where("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("n").alias("n"))
    labels = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "digest")
    linked = materialise(reps.select("digest", "vec_id").join(labels, "digest"))
    least = materialise(linked.groupBy("label").agg(F.min("vec_id").alias("component_id"), F.count(F.lit(1)).alias("members")))
    linked = by_key(linked.select("digest", "label"), least, "label", "members").select("digest", "component_id")
    told = reps.select("digest", "copies", "vec_id").join(counts, "digest", "left").join(linked.withColumn("linked", F.lit(True)), "digest", "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    told = materialise(told.select("digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), component.alias("component_id"), "copies"))
    out = by_key(named.where("digest is not null").select("vec_id", "digest"), told, "digest", "copies").select("vec_id", "n_links", "component_id")
    out = out.union(named.where("digest is null").select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_embedding_dups(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)

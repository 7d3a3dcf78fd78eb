"""Approximate nearest neighbours over learned partitions.

The index is fitted on a bounded sample: its exact neighbour graph is cut into equal parts by recursive
bisection (the second eigenvector of each part's graph, split at the median and smoothed by neighbours'
votes, both halves kept equal). A softmax classifier learns, for a vector, the shares of its neighbours'
parts. Every row of the table is then indexed: it goes to its likeliest part, and a part is stored in blocks
of about ``BLOCK`` rows. A query goes to its likeliest parts, where every row is compared exactly, and
the best of all blocks are kept.

The number of parts follows the number of rows (one for about ``ROWS`` of them, between ``LEAST`` and ``MOST``). How many parts
a query goes to is measured: on ``HELD`` rows of the sample that the classifier wasn't fitted on, it is the smallest number that
holds the share ``recall`` of their neighbours in the sample. In the whole table neighbours are nearer than in a sample, so the
share found there is rarely less. Vectors without structure need most of the parts, vectors in clusters few.

A query's score is the cosine of the original vectors, in double precision and summed in one fixed order, so
equal vectors score equally; ties go to the smaller vec_id, null last. A row is no candidate of its own; any other row is one,
whatever its vec_id, and a query row that comes twice asks twice.

Defined results: vectors that take no part (null, empty, zero, a null or non-finite component) neither ask nor answer; a vector's
candidates are those of its length; with fewer candidates than asked for, all found are returned; rows with a null vec_id
don't ask but answer; an empty table gives no rows. Only vec_id and embedding are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import materialise
from ledgerline.llm.near_dup import sorted_groups
from ledgerline.llm.vectors import by_length, in_slices, lengths_of, sample_of, unit

BLOCK = 2048
NEIGHBOURS = 10
ROWS, LEAST, MOST = 2048, 8, 512
#: Rows of the sample for which the number of parts is measured.
HELD = 512
LAST = (1 << 63) - 1


def neighbour_graph(u: np.ndarray, k: int = NEIGHBOURS, strip: int = 64) -> np.ndarray:
    """The k nearest other rows of each row, a strip of rows at a time."""
    k = min(k, len(u) - 1)
    out = np.zeros((len(u), max(k, 0)), np.int32)
    for a in range(0, len(u) if k > 0 else 0, strip):
        s = -(u[a : a + strip] @ u.T)
        s[np.arange(len(s)), a + np.arange(len(s))] = np.inf
        out[a : a + strip] = np.argpartition(s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, steps: int = 40, seed: int = 0) -> np.ndarray:
    """Part of each node; ``parts`` is a power of two, and sizes differ by one at most a bisection."""
    n = len(graph)
    rng = np.random.default_rng(seed)
    src, dst = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    label, made = np.zeros(n, int), 1
    while made < parts:
        new = np.zeros(n, int)
        for p in range(made):
            nodes = np.flatnonzero(label == p)
            place = np.full(n, -1)
            place[nodes] = np.arange(len(nodes))
            inside = (place[src] >= 0) & (place[dst] >= 0)
            a, b = place[src[inside]], place[dst[inside]]
            a, b = np.concatenate([a, b]), np.concatenate([b, a])
            degree = np.bincount(a, minlength=len(nodes)) + 1e-9
            x = rng.normal(size=len(nodes))
            for _ in range(steps):
                x = x - (x * degree).sum() / degree.sum()
                x = (x + np.bincount(b, weights=x[a], minlength=len(nodes)) / degree) / 2
                x /= np.linalg.norm(x) + 1e-12
            half = len(nodes) // 2
            side = np.zeros(len(nodes))
            side[np.argsort(x, kind="stable")[half:]] = 1
            for _ in range(5):
                vote = np.bincount(b, weights=(2 * side - 1)[a], minlength=len(nodes)) / degree + 0.2 * (2 * side - 1)
                side[:] = 0
                side[np.argsort(vote, kind="stable")[half:]] = 1
            new[nodes] = 2 * p + side.astype(int)
        label, made = new, made * 2
    return label


def fit_router(u: np.ndarray, near: np.ndarray, parts: int, rounds: int = 300, rate: float = 0.1, batch: int = 2048, seed: int = 0) -> np.ndarray:
    """Weights (dimension + 1, parts) of a softmax regression onto the shares of the parts ``near`` of each row's neighbours, by Adam on parts of the rows."""
    x = np.hstack([u, np.ones((len(u), 1))])
    w = np.zeros((x.shape[1], parts))
    m, v = np.zeros_like(w), np.zeros_like(w)
    rng = np.random.default_rng(seed)
    for t in range(1, rounds + 1):
        at = rng.choice(len(x), batch, replace=False) if len(x) > batch else np.arange(len(x))
        d = softmax(x[at] @ w)
        np.subtract.at(d, (np.repeat(np.arange(len(at)), near.shape[1]), near[at].ravel()), 1 / near.shape[1])
        g = x[at].T @ d / len(at) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def likeliest(u: np.ndarray, router: np.ndarray) -> np.ndarray:
    """The parts of each row, likeliest first."""
    return np.argsort(-(np.hstack([u, np.ones((len(u), 1))]) @ router), axis=1, kind="stable")


def fit_index(u: np.ndarray, total: int, recall: float) -> tuple[np.ndarray, int]:
    """(router, parts that a query goes to) for a table of ``total`` rows, fitted on the unit vectors ``u`` of its sample."""
    parts = LEAST
    while parts < min(MOST, total / ROWS, len(u) / 32):
        parts *= 2
    if len(u) < 4 * parts:  # fewer rows than make parts
        return np.zeros((u.shape[1] + 1, 1)), 1
    graph = neighbour_graph(u)
    label = balanced_parts(graph, parts)
    held = np.zeros(len(u), bool)
    held[np.random.default_rng(1).choice(len(u), min(HELD, len(u) // 4), replace=False)] = True
    router = fit_router(u[~held], label[graph[~held]], parts)
    home = np.concatenate([likeliest(u[a : a + 2048], router)[:, 0] for a in range(0, len(u), 2048)])
    asked = likeliest(u[held], router)
    place = np.argsort(asked, axis=1)  # of each part in a query's order
    met = np.take_along_axis(place, home[graph[held]], axis=1)
    found = np.cumsum(np.bincount(met.ravel(), minlength=parts)) / met.size
    return router, int(np.searchsorted(found, recall) + 1)


def search(vectors: DataFrame, is_query: Column, k: int = 5, recall: float = 0.95, sample: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query row among all rows.

    The index of a length is fitted on about ``sample`` rows, 64 a part where there are more parts (32,768 at most).
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = materialise(rows)  # from here on the rows' numbers stay
    models = {}
    for dim, n in lengths_of(rows, 4 * LEAST).items():
        bound = int(max(sample, min(64 * n / ROWS, 64 * MOST)))
        models[dim] = fit_index(sample_of(rows, "row", dim, bound, n), n, recall)
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                wants = np.asarray(batch.column("asks").to_pylist(), bool)
                for at, m in by_length(batch.column("embedding")):
                    router, probes = sent.value.get(m.shape[1], (None, 1))
                    order = likeliest(unit(m), router) if router is not None else np.zeros((len(m), 1), int)
                    asks = wants[at]
                    r = np.concatenate([at, np.repeat(at[asks], probes)])
                    part = np.concatenate([order[:, 0], order[asks, :probes].ravel()])
                    query = np.arange(len(r)) >= len(at)
                    take = pa.array(r)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(r), m.shape[1], np.int32)), pa.array(part.astype(np.int32)), pa.array(query), *(batch.column(c).take(take) for c in ("row", "vec_id", "embedding"))],
                        ["dim", "part", "query", "row", "vec_id", "embedding"],
                    )

    kinds = dict(rows.dtypes)
    routed = rows.mapInArrow(route, f"dim int, part int, query boolean, row long, vec_id {kinds['vec_id']}, embedding {kinds['embedding']}")
    # blocks of a part follow from its size alone: any number of rows, or copies, may go to one part
    size = materialise(routed.where("not query").groupBy("dim", "part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    few = size.count() <= 20_000  # a row of 12 bytes a part; more only with thousands of rare lengths
    placed = routed.join(F.broadcast(size) if few else size, ["dim", "part"])
    block = F.when(F.col("query"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")))
    # a block's own rows come first, then the queries that pass by
    placed = placed.select("dim", "part", F.explode(block).alias("block"), "query", "row", "vec_id", "embedding")
    groups = sorted_groups(placed, ["dim", "part", "block"], ["query"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept = None, []
        for g in in_slices(batches, 3, 512):
            at = tuple(g.column(c)[0].as_py() for c in range(3))
            asks = np.asarray(g.column("query").to_pylist(), bool)
            ((_, m),) = by_length(g.column("embedding"))
            ids = np.asarray(g.column("vec_id").cast(pa.int64()).fill_null(LAST))
            now = (g.column("row").to_numpy(), ids, m)
            if at != held:
                held, kept = at, [x[:0] for x in now]
            if not asks.all():
                kept = [np.concatenate([x, y[~asks]]) for x, y in zip(kept, now)]
            if asks.any() and len(kept[0]):
                yield best_of(*(x[asks] for x in now), *kept, k)

    found = groups.mapInArrow(compare, "row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(*(F.nullif(c, F.lit(LAST)).cast(kinds["vec_id"]).alias(c) if c == "vec_id" else F.col(c).cast(kinds["vec_id"]) if c == "query_id" else c for c in ("query_id", "rank", "vec_id", "score")))


def best_of(asking: np.ndarray, query_ids: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int) -> pa.RecordBatch:
    """The best ``k`` of each query among other rows. Products by matrix find what is near; what can be among the best is scored one by one."""
    qn, mn = np.sqrt((q * q).sum(axis=1)), np.sqrt((m * m).sum(axis=1))
    rough = (q / qn[:, None]) @ (m / mn[:, None]).T
    rough[asking[:, None] == rows[None, :]] = -np.inf
    n = np.zeros(len(q), int)
    out_v, out_s = [ids[:0]], [rough[0, :0]]
    for x in range(len(q)):
        s = rough[x]
        least = -np.inf if len(s) <= k else np.partition(s, len(s) - k)[len(s) - k]
        near = np.flatnonzero((s >= least - 1e-9) & np.isfinite(s))
        exact = (m[near] * q[x]).sum(axis=1) / (mn[near] * qn[x])
        top = np.lexsort((ids[near], -exact))[:k]
        n[x] = len(top)
        out_v.append(ids[near][top])
        out_s.append(exact[top])
    made = [np.repeat(asking, n), np.repeat(query_ids, n), np.concatenate(out_v), np.concatenate(out_s)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["row", "query_id", "vec_id", "score"])


def op8_neighbours(vectors: DataFrame) -> DataFrame:
    """The contract's rows: queries are the rows whose vec_id is divisible by 50."""
    found = search(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""Near-duplicate documents: ProbMinHash signatures, banding, and exact verification.

Texts are lower-cased words between white space; a shingle is five of them (a shorter text is one shingle).

Two weightings of the shingles are compared, each by the probability Jaccard similarity of its weights: every shingle
weighs 1, which makes it the Jaccard similarity of the sets; and a shingle said c times weighs 1 + ln(c), so that a
line said over and over counts for more, but doesn't drown the rest. Two texts are linked if either similarity is
``similarity`` or more. In a text that repeats no shingle both weightings are one.

1. Equal word sequences are one text: only its digest goes on, so a group of copies costs one row.
2. ProbMinHash: every shingle is a Poisson process of arrivals with its weight as rate, each arrival at a random slot of the
   signature; a slot keeps its first arrival. All processes advance together to a common time, which is put off only while
   a slot is still empty, so most shingles stop after their first arrivals. Two slots agree with the probability Jaccard
   similarity of the weights. A text that repeats shingles is signed once for each weighting, any other text once.
3. Banding: ``BANDS`` bands of ``ROWS`` slots; signatures that share a band are candidates if ``NEAR`` of all slots or more agree. A bucket's
   signatures are first compared with one of them, its leader; those near it are joined through it. Only those that aren't are
   compared with all others, in blocks of at most about ``BLOCK``, one task for each pair of blocks. Only a spanning forest of the
   pairs goes on. Buckets of any size are compared whole, and one that holds copies of one text costs a row a text.
4. Verification: the forests' components are the groups inside which every link lies. Their texts are read again
   as 64-bit shingle hashes with their numbers, and both similarities are computed exactly. Again a group's leader comes first:
   texts that are linked with it are one class already and need not be compared with each other; every other text is compared
   with all texts of the group, in blocks.
5. Components of the links are the classes; a class's id is its smallest doc_id.

At 0.8, 24 bands of 5 slots miss a pair with probability 7e-5 and the slot filter drops one with less than 1e-6;
together they miss at most the sum.

Defined results: null texts and texts without a word are in no class but their own (each row for itself, with
its doc_id); repeated rows are copies of each other; a null doc_id comes last in its class. Texts are compared whole, however
long: one takes the memory of its own shingles. An empty table gives an empty result. Of other columns none is read, whatever its name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import by_key, components, materialise, per_worker
from ledgerline.llm.langid import blocks

WIDTH = 5
BANDS, ROWS = 24, 5
SLOTS = BANDS * ROWS
NEAR = 0.6
BLOCK = 128
FORMS = ["sig", "bands", "heavy_sig", "heavy_bands"]
#: Texts that are compared with their leader in one task.
LED = 256
#: A worker keeps the hashes of at most so many words.
REMEMBERED = 500_000
#: Letters of the texts that are signed together.
TOGETHER = 200_000

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C[1]
    x = (x ^ (x >> np.uint64(27))) * _C[2]
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    _words: dict[str, int] = per_worker("word hashes", dict)
    if len(_words) > REMEMBERED:
        _words.clear()
    h = list(map(_words.get, words))
    if None in h:
        for i, v in enumerate(h):
            if v is None:
                h[i] = _words[words[i]] = int.from_bytes(hashlib.blake2b(words[i].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return np.array(h, np.uint64)


def shingles(words: list[str], width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of all shingles, repeats included."""
    a = word_hashes(words)
    n = len(a) - width + 1
    if n < 1:
        a = np.concatenate([a, np.zeros(width - len(a), np.uint64)])
        n = 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix64(out * _C[3] + a[k : k + n] + _C[0])
    return out


def prob_minhash(items: np.ndarray, weights: np.ndarray, texts: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (text, slot), 64-bit, of many weighted sets; ``texts`` numbers the set of each item from 0, without gaps."""
    n = int(texts.max()) + 1
    best = np.full(n * slots, np.inf)
    who = np.zeros(n * slots, np.uint64)
    time = np.zeros(len(items))
    state = mix64((items ^ _C[4]) + _C[0])
    # about so long until every slot of a set has had an arrival
    limit = slots * (np.log(slots) + 1.5) / np.bincount(texts, weights, n)

    def arrival(at: np.ndarray) -> np.ndarray:
        return time[at] - np.log(((state[at] >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / weights[at]

    ahead = arrival(np.arange(len(items)))
    waiting = np.arange(len(items))
    while True:
        live = waiting[ahead[waiting] <= limit[texts[waiting]]]
        while len(live):
            t = ahead[live]
            slot = texts[live] * slots + (mix64(state[live] ^ _C[3]) % np.uint64(slots)).astype(np.int64)
            sooner = np.flatnonzero(t < best[slot])
            sooner = sooner[np.argsort(-t[sooner], kind="stable")]  # the earliest comes last and stays
            s = slot[sooner]
            best[s], who[s] = t[sooner], items[live[sooner]]
            time[live] = t
            state[live] = mix64(state[live] + _C[0])
            ahead[live] = t = arrival(live)
            live = live[t <= limit[texts[live]]]
        last = best.reshape(n, slots).max(axis=1)
        late = ~np.isfinite(last)
        if not late.any():
            return who.reshape(n, slots)
        limit[late] *= 1.3
        waiting = waiting[late[texts[waiting]]]


def weights_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def signatures(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Of texts given as words: signatures of the sets; signatures by weight, of the texts that repeat shingles; the numbers of these texts."""
    found = [np.unique(shingles(words), return_counts=True) for words in texts]
    heavy = [x for x, (_, counts) in enumerate(found) if counts.max() > 1]
    forms = [(items, np.ones(len(items))) for items, _ in found] + [(found[x][0], weights_of(found[x][1])) for x in heavy]
    items, weights = (np.concatenate(c) for c in zip(*forms))
    made = prob_minhash(items, weights, np.repeat(np.arange(len(forms)), [len(x) for x, _ in forms]))
    return made[: len(texts)], made[len(texts) :], heavy


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Of two weighted sets, items ``a`` with weights ``x`` and ``b`` with ``y``: the sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    _, p, q = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    only_x, only_y = x.sum() - x[p].sum(), y.sum() - y[q].sum()
    x, y = x[p], y[q]
    # for an i the first ratio is the larger one just where x_j / y_j is at least x_i / y_i
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    above, below = x[::-1].cumsum()[::-1], y.cumsum() - y
    return float((1 / ((above + only_x) / x + (below + only_y) / y)).sum())


def similar(a: np.ndarray, m: np.ndarray | None, b: np.ndarray, n: np.ndarray | None, similarity: float) -> bool:
    """Whether two texts are linked: sorted shingle hashes ``a`` and ``b`` with their numbers, which are null where all are 1."""
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    if common >= similarity * (len(a) + len(b) - common) - 1e-9:
        return True
    if m is None and n is None:
        return False
    return probability_jaccard(a, weights_or_ones(a, m), b, weights_or_ones(b, n)) >= similarity - 1e-9


def weights_or_ones(items: np.ndarray, counts: np.ndarray | None) -> np.ndarray:
    return np.ones(len(items)) if counts is None else weights_of(counts)


def digest(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, sig, bands, heavy_sig, heavy_bands) of every row; digest is null for a text without a word, the last two
    are null for a text that repeats no shingle. One byte of a slot is kept for comparing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = np.arange(BANDS, dtype=np.uint64) * _C[2]

        def packed(sigs: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
            h = np.tile(band, (len(sigs), 1))
            for r in range(ROWS):
                h = mix64(h * _C[3] + sigs[:, r::ROWS])
            return [(s.tobytes(), x) for s, x in zip((sigs & np.uint64(255)).astype(np.uint8), h.view(np.int64))]

        for whole in batches:
            texts = whole.column(1).to_pylist()
            for a, b in blocks(texts, TOGETHER):
                words = [(t or "").lower().split() for t in texts[a:b]]
                keys = [digest(w) if w else None for w in words]
                distinct = {k: w for k, w in zip(keys, words) if k is not None}
                made: dict[bytes | None, tuple] = {None: (None, None, None, None)}
                if distinct:
                    plain, weighted, heavy = signatures(list(distinct.values()))
                    beside = dict(zip(heavy, packed(weighted)))
                    made.update({k: (*form, *beside.get(x, (None, None))) for x, (k, form) in enumerate(zip(distinct, packed(plain)))})
                s, bands, hs, hbands = zip(*[made[k] for k in keys])
                many = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [whole.column(0).slice(a, b - a), pa.array(keys, pa.binary()), pa.array(s, pa.binary()), pa.array(bands, many), pa.array(hs, pa.binary()), pa.array(hbands, many)],
                    ["doc_id", "digest", *FORMS],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, digest binary, sig binary, bands array<long>, heavy_sig binary, heavy_bands array<long>")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the edges a-b over nodes 0..n-1."""
    root = list(range(n))
    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = x, y
        while root[rx] != rx:
            root[rx] = root[root[rx]]
            rx = root[rx]
        while root[ry] != ry:
            root[ry] = root[root[ry]]
            ry = root[ry]
        if rx != ry:
            root[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def led(members: DataFrame, key: str, count: str, leads: Column) -> DataFrame:
    """``members`` dealt to parts of about ``LED`` rows of their key: a column ``part`` and ``leads`` are added; the key's leader is in every part."""
    parts = F.ceil(F.col(count) / LED).cast("int")
    out = members.withColumn("leads", leads).withColumn("own", F.pmod(F.xxhash64(F.lit("part"), "digest"), parts).cast("int"))
    out = out.withColumn("part", F.explode(F.when(F.col("leads"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array("own"))))
    return out.withColumn("last", ~F.col("leads"))


def rest_blocked(members: DataFrame, key: str, per_block: int, beside: DataFrame | None = None) -> DataFrame:
    """``members(key, digest, near, ...)`` dealt to pairs of blocks of their key, so that every two of which one isn't near the leader meet: columns ``i <= j`` and ``own`` are added.

    Keys whose members are all near their leader go. A near member meets the blocks of the rest, one of the rest meets all blocks; how many
    blocks there are follows from the counts, so a task holds about two blocks, whatever the key's size. ``beside`` has one row a digest and is
    joined to the members before they are sent to their blocks.
    """
    counts = members.groupBy(key).agg(F.count_if("near").alias("n_near"), F.count_if(~F.col("near")).alias("n_rest")).where("n_rest > 0")
    counts = materialise(counts.withColumn("members", F.col("n_near") + F.col("n_rest")))
    out = by_key(members, counts, key, "members")
    if beside is not None:
        out = out.join(beside, "digest")
    near, rest = (F.ceil(F.col(c) / per_block).cast("int") for c in ("n_near", "n_rest"))
    turn = F.xxhash64(F.lit("block"), "digest")
    out = out.withColumn("own", F.when(F.col("near"), F.pmod(turn, near)).otherwise(near + F.pmod(turn, rest)).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.when(F.col("near"), near).otherwise(F.lit(0)), near + rest - 1)))
    return out.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "n_near", "n_rest", "members")


def in_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first ``keys`` columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        change[0] = before is not None and before != tuple(c[0] for c in cols)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        before = tuple(c[-1] for c in cols)
        at = 0
        for cut in np.flatnonzero(change).tolist():
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _emit(edges: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.binary()), pa.array([y for _, y in edges], pa.binary())], ["a", "b"])


def sorted_groups(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with all rows of a key in one partition, one after the other."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order)


def _signed(g: pa.Table | pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    ids = g.column("digest").to_pylist()
    return ids, np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)


def candidates(texts: DataFrame, near: float = NEAR) -> DataFrame:
    """Edges (a, b) between digests of ``texts(digest, sig, bands, heavy_sig, heavy_bands)``: forests of the pairs of which a signature agrees nearly enough."""
    # a signature goes by its text's digest and a byte for the weighting
    plain = F.struct(F.concat("digest", F.unhex(F.lit("00"))).alias("digest"), "sig", "bands")
    heavy = F.struct(F.concat("digest", F.unhex(F.lit("01"))).alias("digest"), F.col("heavy_sig").alias("sig"), F.col("heavy_bands").alias("bands"))
    signed = texts.select(F.inline(F.when(F.col("heavy_sig").isNull(), F.array(plain)).otherwise(F.array(plain, heavy))))
    members = signed.select("digest", "sig", F.explode("bands").alias("bucket")).withColumn("turn", F.xxhash64(F.lit("leader"), "digest"))
    text = F.xxhash64(F.substring("digest", 1, 16))
    size = members.groupBy(F.col("bucket").alias("__bucket")).agg(F.count(F.lit(1)).alias("members"), F.min("turn").alias("__turn"), F.min(text).alias("__least"), F.max(text).alias("__most"))
    # both signatures of one text are nothing to compare
    size = size.where("__least <> __most").drop("__least", "__most")
    members = members.join(size, F.col("bucket") == F.col("__bucket")).select("bucket", "members", "digest", "sig", (F.col("turn") == F.col("__turn")).alias("first"))
    dealt = sorted_groups(led(members, "bucket", "members", F.col("first")).select("bucket", "part", "last", "digest", "sig"), ["bucket", "part"], ["last", "digest"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, leader = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sig = _signed(batch)
            bucket, part = batch.column("bucket").to_numpy(), batch.column("part").to_numpy()
            change = np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])) + 1
            leaders: list[bytes | None] = [None] * len(ids)
            told = np.ones(len(ids), bool)
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(ids)]):
                if (bucket[a], part[a]) != held:
                    held, leader = (bucket[a], part[a]), (ids[a], sig[a])
                    told[a] = part[a] == 0  # the leader is told of once
                key, own = leader
                ok = (sig[a:b] == own).sum(axis=1) >= near * len(own)
                for x in np.flatnonzero(ok).tolist():
                    leaders[a + x] = key
            made = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bucket", "digest", "sig")), pa.array(leaders, pa.binary())], ["bucket", "digest", "sig", "leader"])
            yield made.filter(pa.array(told))

    told = materialise(dealt.mapInArrow(follow, "bucket long, digest binary, sig binary, leader binary"))
    starry = told.where("leader is not null and leader <> digest").select(F.least("leader", "digest").alias("a"), F.greatest("leader", "digest").alias("b"))
    rest = rest_blocked(told.select("bucket", "digest", "sig", F.col("leader").isNotNull().alias("near")), "bucket", BLOCK)
    sent = sorted_groups(rest.select("bucket", "i", "j", "own", "digest", "sig"), ["bucket", "i", "j"], [])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, bytes]] = []
        done: set[tuple[bytes, bytes]] = set()
        for g in in_groups(batches, 3):
            ids, sig = _signed(g)
            own = g.column("own").to_numpy()
            i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
            left = np.flatnonzero(own == i)
            right = left if i == j else np.flatnonzero(own == j)
            if not len(left) or not len(right):
                continue
            found = []
            for x in left.tolist():
                others = right[right > x] if i == j else right
                found.append((x, others[(sig[others] == sig[x]).sum(axis=1) >= near * sig.shape[1]]))
            for x, y in forest(len(ids), np.repeat([x for x, _ in found], [len(y) for _, y in found]), np.concatenate([y for _, y in found])):
                e = (min(ids[x], ids[y]), max(ids[x], ids[y]))
                if e not in done:
                    done.add(e)
                    out.append(e)
            if len(out) > 10_000:
                yield _emit(out)
                out, done = [], set()
        yield _emit(out)

    edges = starry.union(sent.mapInArrow(compare, "a binary, b binary"))
    return edges.select(F.substring("a", 1, 16).alias("a"), F.substring("b", 1, 16).alias("b")).where("a <> b").distinct()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(digest, set, counts) of the distinct texts of ``docs(text)``: sorted 64-bit hashes and their numbers (null if all are 1) as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                rows = []
                for text in whole.column(0).slice(at, 200).to_pylist():
                    words = (text or "").lower().split()
                    if words:
                        items, counts = np.unique(shingles(words), return_counts=True)
                        rows.append((digest(words), items.tobytes(), counts.astype(np.uint32).tobytes() if counts.max() > 1 else None))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.binary()) for c in range(3)], ["digest", "set", "counts"])

    return docs.select("text").mapInArrow(run, "digest binary, set binary, counts binary")


def _unpacked(g: pa.Table | pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray | None]]:
    sets = [np.frombuffer(s, np.uint64) for s in g.column("set").to_pylist()]
    return sets, [None if c is None else np.frombuffer(c, np.uint32) for c in g.column("counts").to_pylist()]


def similar_pairs(sets: list[np.ndarray], counts: list[np.ndarray | None], left: np.ndarray, right: np.ndarray, similarity: float, piece: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of left, of right) that are linked, counted exactly, a bounded part of the shingles at a time.

    A probability Jaccard similarity is at most the share of either side's weight that lies on common shingles; only pairs
    whose shares allow it get the exact sum.
    """
    size = np.array([len(s) for s in sets])
    heavy = np.array([c is not None for c in counts])
    weights = [weights_or_ones(s, c) for s, c in zip(sets, counts)] if heavy.any() else []
    items, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(len(sets)), size)
    shared = count[inverse] > 1
    weight = np.concatenate(weights)[shared].astype(np.float32) if weights else None
    who, inverse = who[shared], inverse[shared]
    _, inverse = np.unique(inverse, return_inverse=True)
    common, of_left, of_right = (np.zeros((len(left), len(right)), np.float32) for _ in range(3))
    width = max(1, piece // (len(left) + len(right)))
    at = np.full(len(sets), -1)
    at[left] = np.arange(len(left))
    to = np.full(len(sets), -1)
    to[right] = np.arange(len(right))
    order = np.argsort(inverse, kind="stable")
    who, inverse = who[order], inverse[order]
    for a in range(0, int(inverse.max(initial=-1)) + 1, width):
        s, e = np.searchsorted(inverse, [a, a + width])
        w, c = who[s:e], inverse[s:e] - a
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        x[at[w[at[w] >= 0]], c[at[w] >= 0]] = 1
        y[to[w[to[w] >= 0]], c[to[w] >= 0]] = 1
        common += x @ y.T
        if weight is not None:
            v = weight[order[s:e]]
            wx, wy = np.zeros_like(x), np.zeros_like(y)
            wx[at[w[at[w] >= 0]], c[at[w] >= 0]] = v[at[w] >= 0]
            wy[to[w[to[w] >= 0]], c[to[w] >= 0]] = v[to[w] >= 0]
            of_left += wx @ y.T
            of_right += x @ wy.T
    jaccard = common / (size[left][:, None] + size[right][None, :] - common)
    p, q = np.nonzero(jaccard >= similarity - 1e-6)
    exact = common[p, q].astype(np.float64)
    ok = exact >= similarity * (size[left][p] + size[right][q] - exact) - 1e-9
    p, q = p[ok], q[ok]
    if weight is not None:
        total = np.array([w.sum() for w in weights])
        open_ = (of_left >= (similarity - 1e-3) * total[left][:, None]) & (of_right >= (similarity - 1e-3) * total[right][None, :])
        open_ &= heavy[left][:, None] | heavy[right][None, :]
        open_[p, q] = False
        more = [(x, y) for x, y in np.argwhere(open_).tolist() if similar(sets[left[x]], counts[left[x]], sets[right[y]], counts[right[y]], similarity)]
        if more:
            p, q = (np.concatenate([old, new]) for old, new in zip((p, q), np.array(more).T))
    return left[p], right[q]


def links(docs: DataFrame, texts: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Verified edges (a, b) between digests; ``texts`` holds one row (doc_id, digest, sig, bands, heavy_sig, heavy_bands) a distinct text."""
    edges = candidates(texts)
    groups = components(edges)
    size = materialise(groups.groupBy("label").agg(F.count(F.lit(1)).alias("members")))
    groups = by_key(groups, size, "label", "members")
    wanted = materialise(texts.join(groups, texts["digest"] == groups["node"]).select("doc_id", "digest", F.col("label").alias("grp"), "members"))
    ids = wanted.select(F.col("doc_id").alias("__id")).distinct()
    read = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    sets = shingle_sets(read).withColumnRenamed("digest", "__digest")
    got = wanted.join(sets, F.col("digest") == F.col("__digest")).select("grp", "members", "digest", "set", "counts")
    # copies of a text under one doc_id give the same set again
    got = materialise(got.groupBy("digest").agg(F.first("grp").alias("grp"), F.first("members").alias("members"), F.first("set").alias("set"), F.first("counts").alias("counts")))
    # a group is named after one of its texts, its leader
    dealt = sorted_groups(led(got, "grp", "members", F.col("digest") == F.col("grp")).select("grp", "part", "last", "digest", "set", "counts"), ["grp", "part"], ["last", "digest"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, leader = None, None
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            rows = []
            for grp, part, key, items, counts in zip(*(batch.column(c).to_pylist() for c in ("grp", "part", "digest")), *_unpacked(batch)):
                if (grp, part) != held:
                    held, leader = (grp, part), (items, counts)
                    if not part:
                        rows.append((grp, key, True))
                    continue
                rows.append((grp, key, similar(*leader, items, counts, similarity)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.bool_())], ["grp", "digest", "near"])

    told = materialise(dealt.mapInArrow(follow, "grp binary, digest binary, near boolean"))
    starry = told.where("near and grp <> digest").select(F.col("grp").alias("a"), F.col("digest").alias("b"))
    rest = rest_blocked(told, "grp", BLOCK // 2, got.select("digest", "set", "counts"))
    sent = sorted_groups(rest.select("grp", "i", "j", "own", "digest", "set", "counts"), ["grp", "i", "j"], [])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, bytes]] = []
        for g in in_groups(batches, 3):
            if g.num_rows < 2:
                continue
            keys = g.column("digest").to_pylist()
            own = g.column("own").to_numpy()
            sets, counts = _unpacked(g)
            i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            if not len(left) or not len(right):
                continue
            x, y = similar_pairs(sets, counts, left, right, similarity)
            differ = x != y
            out += [(keys[a], keys[b]) for a, b in forest(len(keys), x[differ], y[differ])]
            if len(out) > 10_000:
                yield _emit(out)
                out = []
        yield _emit(out)

    return starry.union(sent.mapInArrow(verify, "a binary, b binary"))


def near_duplicates(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, class_id, kept) of every row of ``docs(doc_id, text)``; kept: the row has its class's id."""
    signed = materialise(sign(docs))
    reps = signed.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in FORMS))
    reps = materialise(reps)
    found = components(links(docs, reps, similarity))
    linked = materialise(reps.select("digest", "doc_id").join(found.withColumnRenamed("node", "__node"), F.col("digest") == F.col("__node")).select("digest", "doc_id", "label"))
    least = materialise(linked.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("members")))
    linked = by_key(linked.select("digest", "label"), least, "label", "members").select("digest", "class_id", F.lit(True).alias("linked"))
    classes = reps.select("digest", "doc_id", "copies").join(linked, "digest", "left")
    classes = materialise(classes.select("digest", F.when(F.col("linked"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), "copies"))
    out = by_key(signed.where("digest is not null").select("doc_id", "digest"), classes, "digest", "copies").select("doc_id", "class_id")
    out = out.union(signed.where("digest is null").select("doc_id", F.col("doc_id").alias("class_id")))
    return out.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs(doc_id, text, ...)`` for each class of near duplicates; columns unchanged.

    Defined results: every null text and every text without a word stays (repeated rows of one doc_id once); of rows that share the
    kept doc_id one of each text stays; an empty table stays empty; other columns are carried along, whatever their names.
    """
    kept = near_duplicates(docs.select("doc_id", "text"), similarity).where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n"))
    kept = materialise(kept.withColumnRenamed("doc_id", "__id"))
    out = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "inner")
    once = out.where("__n = 1").select(*docs.columns)
    if kept.where("__n > 1").isEmpty():
        return once
    # rows that share a doc_id: one of each text that the class keeps
    return once.union(out.where("__n > 1").select(*docs.columns).dropDuplicates(["doc_id", "text"]))

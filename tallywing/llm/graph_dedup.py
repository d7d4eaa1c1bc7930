"""Near duplicates among embeddings, by a robust-pruned flat graph over overlapping cluster shards.

Vectors of a label are clustered around centres found on a bounded sample, and each goes to every
centre that could be the nearest one of a vector in range of it, so that two vectors in range always
share a shard; a label for which that would take more comparisons than all its pairs is one shard.
A shard larger than `SHARD_ROWS` is dealt into blocks, and each pair of blocks becomes a task, so
that every pair of a shard's vectors meets and no task holds more than a bounded number. Tasks come
in rounds, each of which moves about one copy of the vectors, whatever the number of blocks. A task
links each vector to a robust-pruned choice of its nearest ones and searches for each of its
vectors: greedily from the medoid, and on from everything within range, or a little past it, until
nothing new is. Links are confirmed by the exact
cosine in double precision. The search of `AUDITED` rows of each task is compared with all its rows;
the audit's columns tell what they had found. A pair counts as found if either of its two vectors has
found the other; what all searches of a task have missed is added by a product of all its rows.

Equal vectors of a label are one vector with a weight throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import _matrix, usable
from .common import cut
from .components import components

SHARD_ROWS, OVERLAP = 4096, 2
SAMPLE_ROWS, MOST_CENTRES = 20_000, 2048
DEGREE, CANDIDATES, ALPHA = 32, 64, 1.2
AUDITED = 32
#: Rounds whose results are kept one by one.
MOST_ROUNDS_KEPT = 32
#: How far below the range a search goes on, so that it gets across thin places of the graph.
PAST_RANGE = 0.03


def robust_prune(near: np.ndarray, among: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Which of each row's candidates, nearest first, are chosen: those not much nearer to one already chosen.

    near: distances (rows, candidates); among: distances between the candidates of each row.
    """
    alive, chosen, count = np.ones(near.shape, bool), np.zeros(near.shape, bool), np.zeros(len(near), np.int64)
    for i in range(near.shape[1]):
        pick = alive[:, i] & (count < degree)
        chosen[:, i] = pick
        count += pick
        alive &= ~pick[:, None] | (alpha * among[:, i, :] > near)
    return chosen


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


def build(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each unit vector the neighbours chosen for it and those that have chosen it: offsets, and indices.

    Single precision is enough to choose neighbours; links are confirmed in double precision later.
    """
    unit, n = unit.astype(np.float32), len(unit)
    most = min(CANDIDATES, n - 1)
    if most < 1:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int64)
    own, other = [], []
    for a in range(0, n, 256):
        sims = unit[a : a + 256] @ unit.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -2
        part = np.argpartition(-sims, most - 1, axis=1)[:, :most]
        cosine = np.take_along_axis(sims, part, axis=1)
        rank = np.argsort(-cosine, axis=1, kind="stable")
        order, cosine = np.take_along_axis(part, rank, axis=1), np.take_along_axis(cosine, rank, axis=1)
        vectors = unit[order]
        row, at = np.nonzero(robust_prune(_distance(cosine), _distance(vectors @ vectors.transpose(0, 2, 1))))
        own.append(row + a)
        other.append(order[row, at])
    own, other = np.concatenate(own), np.concatenate(other)
    back = np.argsort(other, kind="stable")
    first = np.searchsorted(other[back], other[back])
    back = back[np.arange(len(back)) - first < DEGREE]
    pairs = np.unique(np.r_[own * n + other, other[back] * n + own[back]])
    return np.searchsorted(pairs, np.arange(n + 1) * n), pairs % n


def range_search(unit: np.ndarray, off: np.ndarray, flat: np.ndarray, least: float, past: float = PAST_RANGE) -> list[np.ndarray]:
    """For each vector the others in range: greedily from the medoid, then on through all that are in range or no more than `past` below it.

    All walks take their steps together; only vectors with something in range go on one by one.
    """
    n = len(unit)
    width = int(np.diff(off).max(initial=0))
    padded = np.repeat(np.arange(n)[:, None], max(width, 1), axis=1)
    place = np.arange(len(flat)) - np.repeat(off[:-1], np.diff(off))
    padded[np.repeat(np.arange(n), np.diff(off)), place] = flat
    medoid = int(np.argmax(unit @ unit.mean(axis=0)))
    seen = np.full(n, -1)
    out = []
    for a in range(0, n, 128):
        q = unit[a : a + 128]
        me = np.arange(a, a + len(q))
        at, best = np.full(len(q), medoid), q @ unit[medoid]
        walking = np.arange(len(q))
        while len(walking):
            near = padded[at[walking]]
            sims = np.einsum("qd,qkd->qk", q[walking], unit[near])
            top = sims.argmax(axis=1)
            better = sims[np.arange(len(walking)), top] > best[walking] + 1e-12
            walking, near, sims, top = walking[better], near[better], sims[better], top[better]
            at[walking], best[walking] = near[np.arange(len(walking)), top], sims[np.arange(len(walking)), top]
        front = np.concatenate([at[:, None], padded[at], padded[me]], axis=1)
        near = (np.einsum("qd,qkd->qk", q, unit[front]) >= least - past) & (front != me[:, None])
        for i in range(len(q)):
            if not near[i].any():
                out.append(np.zeros(0, np.int64))
                continue
            todo, found = np.unique(front[i, near[i]]), []
            seen[front[i]] = seen[me[i]] = me[i]
            while len(todo):
                found.append(todo)
                new = np.unique(padded[todo])
                new = new[seen[new] != me[i]]
                seen[new] = me[i]
                todo = new[unit[new] @ q[i] >= least - past]
            found = np.concatenate(found)
            out.append(found[unit[found] @ q[i] >= least])
    return out


def homes(unit: np.ndarray, centres: np.ndarray, least: float) -> np.ndarray:
    """For each unit vector (rows) the centres (columns) that are the nearest of some vector at a cosine of `least` or more to it.

    That vector lies past the plane between the own nearest centre and the other one, which is no farther than the angle allows.
    """
    sims = unit @ centres.T
    best = sims.argmax(axis=1)
    apart = _distance(np.minimum(centres @ centres.T, 1))
    return sims.max(axis=1)[:, None] - sims <= np.sqrt(max(0.0, 1 - least * least)) * apart[best] + 1e-6


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _centres(rows: DataFrame, least: float, seed: int = 11) -> dict[str, np.ndarray]:
    """For each label with more vectors than a shard, unit centres from a few rounds of k-means on a bounded sample."""
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_ROWS).orderBy(F.desc("n"), "label").limit(MOST_CENTRES).collect()}
    if not sizes:
        return {}
    picked = rows.where(F.col("label").isin(list(sizes))).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE_ROWS).select("id", "label", "vector").toArrow().sort_by("id").combine_chunks()
    points, labels = _unit(_matrix(picked.column("vector").chunk(0), np.float64)), np.array(picked.column("label").to_pylist())
    rng, out, total = np.random.default_rng(seed), {}, sum(sizes.values())
    for label, n in sizes.items():
        own = points[labels == label]
        k = min(-(-2 * n * OVERLAP // SHARD_ROWS), max(2, MOST_CENTRES * n // total), len(own))
        if k < 2:
            continue
        centres = own[rng.choice(len(own), k, replace=False)]
        for _ in range(5):
            nearest = np.argmax(own @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, own)
            full = np.linalg.norm(sums, axis=1) > 0
            centres[full] = _unit(sums[full])
        # pairs to compare, as a share of all pairs of the label
        if (homes(own, centres, least).mean(axis=0) ** 2).sum() < 1:
            out[label] = centres
    return out


def _with_classes(rows: DataFrame, classes: DataFrame, most: int = 10_000) -> DataFrame:
    """rows beside the row of their class. The largest classes, a bounded number, come to their rows; rows of others are dealt by class."""
    on = ["label", "p", "q"]
    large = classes.where(F.col("copies") > 256).orderBy(F.desc("copies"), "cid").limit(most)
    values = [c for c in classes.columns if c not in on]
    met = rows.join(F.broadcast(large.select(*on, F.struct(*values).alias("own"))), on, "left")
    rest = met.where(F.col("own").isNull()).drop("own").join(classes, on)
    return met.where(F.col("own").isNotNull()).select("id", "own.*").unionByName(rest.select("id", *values))


def _round(placed: DataFrame, apart: int, turn: int) -> DataFrame:
    """The vectors of the tasks of a round, with low and high, its two blocks.

    Blocks of a shard meet those that are `apart` places further on, the even ones and the odd ones
    in turns, so that a round holds about one copy of a vector; in round 0 shards of one block do.
    """
    if not apart:
        return placed.where(F.col("blocks") == 1).withColumns({"low": F.lit(0), "high": F.lit(0)})
    low = F.filter(F.array(F.col("block"), F.col("block") - apart), lambda x: (x >= 0) & (x + apart < F.col("blocks")) & (x % 2 == turn))
    return placed.where(F.col("blocks") > 1).withColumn("low", F.explode(low)).withColumn("high", F.col("low") + apart)


def _united(found: list[DataFrame]) -> DataFrame:
    """The results of several rounds, one row for each vector and root."""
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return cut(every.groupBy("id", "root").agg(*[F.sum(c).alias(c) for c in ("links", "audit_found", "audit_true")]))


def near_duplicates(rows: DataFrame, least: float = 0.98) -> DataFrame:
    """id, n_links, component_id, audit_found and audit_true for every row of rows (id long, label, vector array<float>).

    A row without an id or a label or with an unusable vector (null, empty, zero, a component null or
    not finite), or of another length than most, links with nothing: 0 links, its own component.
    Labels of any type are compared as they are. Copies of a vector link with each other. Rows that
    share an id are rows of their own, each with the links of its vector. An empty table gives an
    empty result; other columns are not read. The audit's columns are null for rows not audited.
    """
    every = rows.select("id", "label", "vector")
    takes_part = F.col("id").isNotNull() & F.col("label").isNotNull() & usable("vector")
    length = every.where(takes_part).groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    takes_part = F.coalesce(takes_part & (F.size("vector") == (length[0]["n"] if length else 1)), F.lit(False))
    rows = every.where(takes_part).select("id", F.col("label").cast("string").alias("label"), "vector")
    rows = rows.withColumns({"p": F.xxhash64("vector"), "q": F.xxhash64(F.lit(1), F.reverse("vector"))})
    classes = rows.groupBy("label", "p", "q").agg(F.min(F.struct("id", "vector")).alias("one"), F.count("*").alias("copies"))
    # a class has a number of its own, since ids may repeat
    classes = cut(classes.select(F.monotonically_increasing_id().alias("cid"), F.col("one.id").alias("least_id"), "label", "p", "q", "one.vector", "copies"))
    centres = _centres(classes.select(F.col("cid").alias("id"), "label", "vector"), least)

    def sharded(batches):
        for batch in batches:
            labels, ids = np.array(batch.column("label").to_pylist()), np.asarray(batch.column("id"))
            unit = _unit(_matrix(batch.column("vector"), np.float64)) if len(ids) else np.zeros((0, 1))
            shards = [[0] for _ in ids]
            for label in set(labels.tolist()) & set(centres):
                own = np.flatnonzero(labels == label)
                for a in range(0, len(own), 1024):
                    some = own[a : a + 1024]
                    for i, at in zip(some, homes(unit[some], centres[label], least), strict=True):
                        shards[i] = np.flatnonzero(at).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards, pa.list_(pa.int32()))], ["id", "label", "vector", "copies", "shards"])

    placed = classes.select(F.col("cid").alias("id"), "label", "vector", "copies").mapInArrow(sharded, "id long, label string, vector array<float>, copies long, shards array<int>")
    placed = placed.withColumn("shard", F.explode("shards"))
    half = SHARD_ROWS // 2
    # one row for each SHARD_ROWS vectors at most
    large = cut(placed.groupBy("label", "shard").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_ROWS).select("label", "shard", F.ceil(F.col("n") / half).cast("int").alias("blocks")))
    placed = placed.join(F.broadcast(large), ["label", "shard"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))

    def searched(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id").combine_chunks()
        ids, copies, block = (np.asarray(table.column(c)) for c in ("id", "copies", "block"))
        low, high, blocks = (table.column(c)[0].as_py() for c in ("low", "high", "blocks"))
        shard = table.column("shard")[0].as_py()
        vectors = _matrix(table.column("vector").chunk(0), np.float64)
        unit, n = _unit(vectors), len(ids)
        lists = table.column("shards").chunk(0)
        long = np.asarray(lists.value_lengths(), np.int64)
        row = np.repeat(np.arange(n), long)
        shards = np.full((n, long.max()), -1, np.int32)
        shards[row, np.arange(len(row)) - np.repeat(np.cumsum(long) - long, long)] = np.asarray(lists.flatten())
        off, flat = build(unit)
        norms = np.linalg.norm(vectors, axis=1)
        slack = least - 1e-9
        audited = np.argsort((ids * 2654435761) % (1 << 32), kind="stable")[:AUDITED]
        # a pair that either of the two has found is found
        met = np.zeros((n, n), bool)
        for i, others in enumerate(range_search(unit, off, flat, slack)):
            met[i, others] = True
        met |= met.T
        inside = unit[audited] @ unit.T >= slack
        inside[np.arange(len(audited)), audited] = False
        checked = {i: (hit, true) for i, hit, true in zip(audited.tolist(), (met[audited] & inside).sum(axis=1).tolist(), inside.sum(axis=1).tolist(), strict=True)}
        # an exact check follows: what the search has missed is added; links are confirmed in double precision below
        single = unit.astype(np.float32)
        for a in range(0, n, 256):
            met[a : a + 256] |= single[a : a + 256] @ single.T >= least - 1e-5
        np.fill_diagonal(met, False)
        links, root = np.zeros(n, np.int64), np.arange(n)

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i in range(n):
            others = np.flatnonzero(met[i])
            others = others[(vectors[others] @ vectors[i]) / (norms[others] * norms[i]) >= least]
            if not len(others):
                continue
            # a pair counts in one task: that of its first common shard, and of its two blocks
            if shards.shape[1] > 1:
                both = np.isin(shards[others], shards[i][: long[i]])
                first = np.where(both, shards[others], np.iinfo(np.int32).max).min(axis=1) == shard
            else:
                first = np.ones(len(others), bool)
            if blocks > 1:
                same = block[others] == block[i]
                meets_itself_here = (high == low + 1 and block[i] == low) or (low == 0 and high == blocks - 1 and block[i] == high)
                first &= ~same | meets_itself_here
            links[i] = copies[others[first]].sum()
            for j in others[others < i].tolist():
                a, b = top(i), top(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
        tops = np.array([top(i) for i in range(n)], np.int64)
        # rows that have no link here and aren't audited have nothing to tell
        told = [i for i in range(n) if links[i] or tops[i] != i or i in checked]
        audit = [checked.get(i, (None, None)) for i in told]
        return pa.table({
            "id": pa.array(ids[told], pa.int64()), "links": pa.array(links[told], pa.int64()), "root": pa.array(ids[tops[told]], pa.int64()),
            "audit_found": pa.array([a[0] for a in audit], pa.int64()), "audit_true": pa.array([a[1] for a in audit], pa.int64()),
        })

    most = large.agg(F.coalesce(F.max("blocks"), F.lit(1))).first()[0]
    found = []
    for apart, turn in [(0, 0), *((d, t) for d in range(1, most) for t in range(min(2, most - d)))]:
        some = _round(placed, apart, turn)
        found.append(cut(some.groupBy("label", "shard", "low", "high").applyInArrow(searched, "id long, links long, root long, audit_found long, audit_true long")))
        if len(found) == MOST_ROUNDS_KEPT:
            found = [_united(found)]
    out = _united(found)
    totals = out.groupBy(F.col("id").alias("cid")).agg(F.sum("links").alias("links"), F.sum("audit_found").alias("audit_found"), F.sum("audit_true").alias("audit_true"))
    joined = components(out.select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("cid"), F.col("component_id").alias("top"))
    named = classes.select("cid", "label", "p", "q", "least_id", "copies").join(totals, "cid", "left").join(joined, "cid", "left")
    named = named.withColumns({"links": F.coalesce("links", F.lit(0)), "top": F.coalesce("top", "cid")})
    smallest = named.groupBy("top").agg(F.min("least_id").alias("component_id"))
    state = named.join(smallest, "top").select("cid", "label", "p", "q", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id", "audit_found", "audit_true")
    alone = every.where(~takes_part).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(None).cast("long").alias("audit_found"), F.lit(None).cast("long").alias("audit_true"))
    return _with_classes(rows.select("id", "label", "p", "q"), cut(state)).select("id", "n_links", "component_id", "audit_found", "audit_true").unionByName(alone)


def deduplicate(embeddings: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept and the audit's columns for every row of embeddings (vec_id, embedding, label); odd rows as `near_duplicates` says."""
    rows = embeddings.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    out = near_duplicates(rows, least)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"), "audit_found", "audit_true")

"""The k most similar vectors of every vector: inverted file of coarse centroids with product-quantised residuals.

Equal vectors are joined into classes first, so copies cost one row each. The index (coarse centroids, codebooks) is
fitted on a sample of at most SAMPLE classes; every class is indexed and every class is a query. A class is stored in
the list of its nearest cell with the codes of its residual, and asks the `probes` nearest cells. Cells that lie near
each other are held by one task (a group), so a query is sent once per group it asks, not once per list. There the sums
of its distance tables over the stored codes choose a shortlist, and only the shortlist is compared exactly. Groups and
their queries are cut into blocks, so a task's work is bounded whatever the size of a list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.joins import checked
from skein.session import ensure_checkpoint_dir

#: Classes the index is fitted on, at most.
SAMPLE = 20_000
#: Residents and queries that one task compares at most.
RESIDENTS, ASKING = 25_000, 16_000
#: Queries whose distance tables a task holds at a time.
TABLES = 2_048
SUBSPACES, CODES = 8, 256
#: Cells per square root of the number of classes. Beyond one centroid per 16 sampled classes, cells are made of a coarse
#: centroid and one of a second level, so their number has no ceiling.
CELL_FACTOR = 5
#: Standard deviations of the quantisation error that a rough score may lie below the k-th best exact one.
SLACK = 2.5
#: Nearest cells in a group whose exact products give a query its first k-th best.
FIRST_CELLS = 4


def valid(c: str, width: int = 64):
    """The vector has the given width, finite values only, and isn't all zero."""
    return F.coalesce((F.size(c) == width) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.stack([np.bincount(near, weights=x[:, d], minlength=len(centres)) for d in range(x.shape[1])], axis=1)
        full = count > 0
        centres[full] = total[full] / count[full, None]
        centres[~full] = x[rng.integers(0, len(x), int((~full).sum()))]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, block: int = 4096) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + block] @ centres.T - half, axis=1) for i in range(0, len(x), block)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Cells (coarse centroids, or sums of a coarse and a second one), their groups, and the codebooks of residuals."""

    def __init__(self, sample: np.ndarray, cells: int, residents: int = RESIDENTS, total: int | None = None):
        x = unit(sample)
        self.coarse = k_means(x, max(1, min(cells, len(x) // 16)), 8)
        own = nearest(x, self.coarse)
        second = -(-cells // len(self.coarse))
        rest = x - self.coarse[own]
        self.second = k_means(rest, min(second, len(x)), 6, 5) if second > 1 else np.zeros((1, x.shape[1]))
        weight = np.bincount(own, minlength=len(self.coarse)) * ((total or len(x)) / len(x))
        self.group = grouped(self.coarse, weight, residents)
        self.subspaces = math.gcd(SUBSPACES, x.shape[1])
        cell = self.cell_of(x, own)
        rest = x - self.centre(cell)
        self.books = [k_means(p, min(CODES, len(p)), 6, 11 + i) for i, p in enumerate(np.split(rest, self.subspaces, axis=1))]
        error = rest - self.decoded(self.encode(x, cell))
        self.error = float(np.sqrt((error**2).sum(axis=1).mean() / x.shape[1]))

    def centre(self, cell: np.ndarray) -> np.ndarray:
        return self.coarse[cell // len(self.second)] + self.second[cell % len(self.second)]

    def cell_of(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        return own * len(self.second) + nearest(x - self.coarse[own], self.second)

    def asked(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The cells nearest to each vector, nearest first."""
        score = x @ self.coarse.T - (self.coarse**2).sum(axis=1) / 2
        two = len(self.second)
        if two > 1:
            m = min(score.shape[1], max(16, -(-4 * probes // two)))
            near = np.argpartition(-score, m - 1, axis=1)[:, :m]
            length = ((self.coarse[:, None, :] + self.second[None]) ** 2).sum(axis=2) / 2
            both = (x @ self.coarse.T)[np.arange(len(x))[:, None], near][:, :, None] + (x @ self.second.T)[:, None, :] - length[near]
            score, cells = both.reshape(len(x), -1), (near[:, :, None] * two + np.arange(two)).reshape(len(x), -1)
        else:
            cells = np.broadcast_to(np.arange(score.shape[1]), score.shape)
        m = min(probes, score.shape[1])
        top = np.argpartition(-score, m - 1, axis=1)[:, :m]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, axis=1), axis=1), axis=1)
        return np.take_along_axis(cells, top, axis=1)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = np.split(x - self.centre(cell), self.subspaces, axis=1)
        return np.stack([nearest(r, b) for r, b in zip(rest, self.books)], axis=1).astype(np.uint8)

    def decoded(self, code: np.ndarray) -> np.ndarray:
        return np.concatenate([b[code[:, i]] for i, b in enumerate(self.books)], axis=1)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """The distance tables of queries: per subspace, a row per code with the product of each query and the code."""
        return [(b @ part.T).astype(np.float32) for b, part in zip(self.books, np.split(q, self.subspaces, axis=1))]


def grouped(centres: np.ndarray, weight: np.ndarray, most: float) -> np.ndarray:
    """A group for each centroid: they are halved across the direction in which they differ most until a group's weight
    is at most `most` or it is a single centroid."""
    out, todo, n = np.zeros(len(centres), np.int64), [np.arange(len(centres))], 0
    while todo:
        own = todo.pop()
        if len(own) == 1 or weight[own].sum() <= most:
            out[own] = n
            n += 1
            continue
        apart = centres[own] - centres[own].mean(axis=0)
        order = own[np.argsort(apart @ np.linalg.svd(apart, full_matrices=False)[2][0], kind="stable")]
        half = int(np.clip(np.searchsorted(np.cumsum(weight[order]), weight[order].sum() / 2), 1, len(order) - 1))
        todo += [order[:half], order[half:]]
    return out


def _assign(df: DataFrame, index, probes: int) -> DataFrame:
    """Each vector's cell, group and codes, and the groups it asks with the cells there, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = unit(np.stack(part.column(1).to_numpy(zero_copy_only=False)))
                cell = ix.cell_of(x, nearest(x, ix.coarse))
                codes = ix.encode(x, cell)
                cells = ix.asked(x, probes)
                group = ix.group[cells // len(ix.second)]
                order = np.argsort(group, axis=1, kind="stable")  # nearest first within a group
                cells, group = np.take_along_axis(cells, order, axis=1), np.take_along_axis(group, order, axis=1)
                first = np.ones(group.shape, bool)
                first[:, 1:] = group[:, 1:] != group[:, :-1]
                begins = np.flatnonzero(first.ravel())
                inner = pa.ListArray.from_arrays(pa.array(np.append(begins, group.size), pa.int32()), pa.array(cells.ravel(), pa.int32()))
                at_row = np.concatenate(([0], np.cumsum(first.sum(axis=1)))).astype(np.int32)
                asks = pa.ListArray.from_arrays(pa.array(at_row), pa.StructArray.from_arrays([pa.array(group.ravel()[begins], pa.int32()), inner], names=["grp", "cells"]))
                own = ix.group[cell // len(ix.second)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell, pa.int32()), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), asks], names=["id", "v", "cell", "grp", "code", "asks"])

    return df.mapInArrow(run, "id bigint, v array<float>, cell int, grp int, code binary, asks array<struct<grp:int,cells:array<int>>>")


def _search(index, k: int):
    def run(table: pa.Table) -> pa.Table:
        ix = index.value
        ids = table.column("id").to_numpy()
        x = unit(np.stack(table.column("v").to_numpy())) if len(ids) else np.zeros((0, 1))
        cell = table.column("cell").to_numpy()
        q, r = np.flatnonzero(cell < 0), np.flatnonzero(cell >= 0)
        r = r[np.lexsort((ids[r], cell[r]))]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(q) and len(r):
            codes = np.frombuffer(b"".join(table.column("code").take(pa.array(r)).to_pylist()), np.uint8).reshape(len(r), -1).astype(np.int64)
            cells, begins = np.unique(cell[r], return_index=True)
            ends = np.append(begins[1:], len(r))
            centres = ix.centre(cells).astype(np.float32)
            scale = (1 / np.maximum(np.linalg.norm(ix.centre(cell[r]) + ix.decoded(codes), axis=1), 0.1)).astype(np.float32)
            near32, own = x[r].astype(np.float32), ids[r]
            asks = table.column("cells").take(pa.array(q)).combine_chunks()
            of, wanted = np.repeat(np.arange(len(q)), asks.value_lengths().to_numpy()), asks.flatten().to_numpy()
            place = np.arange(len(of)) - np.searchsorted(of, of)  # 0 for the nearest cell of the group
            at = np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)
            held = cells[at] == wanted
            of, at, place = of[held], at[held], place[held]
            for i in range(0, len(q), TABLES):
                mine = q[i : i + TABLES]
                lo, hi = np.searchsorted(of, [i, i + TABLES])
                out.append(_asked(ix, k, ids[mine], x[mine], of[lo:hi] - i, at[lo:hi], place[lo:hi], begins, ends, centres, codes, scale, near32, x, r, own))
        a, b, s = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"id": pa.array(a, pa.int64()), "other": pa.array(b, pa.int64()), "similarity": pa.array(s, pa.float64())})

    return run


def _asked(ix, k, ids, q, of, at, place, begins, ends, centres, codes, scale, near32, x, r, own):
    """The best k residents of each query (rows of q) among the cells it asks: of is the query and at the cell of each
    visit, place its rank for the query."""
    q32 = q.astype(np.float32)
    tables, base = ix.tables(q), q32 @ centres.T
    floor = np.full(len(q), -np.inf, np.float32)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def visits(chosen: np.ndarray):
        order = chosen[np.argsort(at[chosen], kind="stable")]
        edges = np.flatnonzero(np.diff(at[order], prepend=-1))
        for lo, hi in zip(edges, np.append(edges[1:], len(order))):
            yield int(at[order[lo]]), of[order[lo:hi]]

    def keep(who: np.ndarray, which: np.ndarray, score: np.ndarray) -> None:
        ok = (score >= floor[who] - 1e-5) & (own[which] != ids[who])
        found.append((who[ok], which[ok], score[ok]))

    for c, who in visits(np.flatnonzero(place < FIRST_CELLS)):
        exact = q32[who] @ near32[begins[c] : ends[c]].T
        keep(np.repeat(who, exact.shape[1]), np.tile(np.arange(begins[c], ends[c]), len(who)), exact.ravel())
    if found:
        who, _, score = (np.concatenate(z) for z in zip(*found))
        who, score, rank = ranked(who, score)[1:]
        floor[who[rank == k - 1]] = score[rank == k - 1]
    slack = np.float32(SLACK * ix.error)
    for c, who in visits(np.flatnonzero(place >= FIRST_CELLS)):
        code = codes[begins[c] : ends[c]]
        rough = np.take(np.take(tables[0], code[:, 0], axis=0), who, axis=1)
        for s in range(1, len(tables)):
            rough += np.take(np.take(tables[s], code[:, s], axis=0), who, axis=1)
        rough += base[who, c]
        rough *= scale[begins[c] : ends[c], None]  # what codes stand for is shorter than a unit vector
        which, mine = np.nonzero(rough >= floor[who] - slack)
        for j in range(0, len(which), 1 << 16):
            b, a = which[j : j + (1 << 16)] + begins[c], who[mine[j : j + (1 << 16)]]
            keep(a, b, np.einsum("pd,pd->p", q32[a], near32[b]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    who, which, score = (np.concatenate(z) for z in zip(*found))
    ok = score >= floor[who] - 1e-5
    order, who, _, rank = ranked(who[ok], score[ok])
    which = which[ok][order]
    who, which = who[rank < k + 4], which[rank < k + 4]
    exact = np.einsum("pd,pd->p", q[who], x[r[which]])
    order = np.lexsort((own[which], -exact, who))
    who, which, exact = who[order], which[order], exact[order]
    few = np.arange(len(who)) - np.searchsorted(who, who) < k
    return ids[who[few]], own[which[few]], exact[few]


def ranked(who: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order by who and falling score, both in that order, and the rank from 0 within who; scores are products of
    unit vectors."""
    order = np.argsort(who * 4.0 - score)
    who = who[order]
    return order, who, score[order], np.arange(len(who)) - np.searchsorted(who, who)


def best(df: DataFrame, k: int, key: str = "id") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("similarity"), "other")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar_vectors(df: DataFrame, key: str, vector: str, k: int = 5, width: int = 64, probes: int = 300) -> DataFrame:
    """(key, other, similarity, rank) of the k most similar other vectors of every valid vector, by cosine; equal
    similarities go to the smaller key.

    Vectors that are null, of another width, with null or non-finite values or all zero are neither queries nor
    results. Keys must be unique integers; rows with a null key drop out; fewer than k other vectors give fewer rows;
    an empty table gives an empty result; other columns are ignored."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kind = "id bigint, other bigint, similarity double, rank int"
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).where(F.col(key).isNotNull() & valid(vector, width))
    named = rows.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")).checkpoint()
    several = named.groupBy("h1", "h2").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "head")
    tagged = named.join(checked(several), ["h1", "h2"], "left").select("id", "v", "head").checkpoint()
    single = tagged.where("head is null or id = head").select("id", "v")
    n = single.count()
    if n == 0:
        return spark.createDataFrame([], kind).withColumnRenamed("id", key)
    sample = single.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
    index = spark.sparkContext.broadcast(Index(np.stack(sample.to_numpy()), max(1, int(CELL_FACTOR * math.sqrt(n))), total=n))
    placed = _assign(single, index, probes).checkpoint()
    held = {r.grp: r.n for r in placed.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    asking = {r.grp: r.n for r in placed.select(F.explode("asks.grp").alias("grp")).groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = spark.createDataFrame([(int(g), max(1, -(-m // RESIDENTS)), max(1, -(-asking.get(g, 0) // ASKING))) for g, m in held.items()], "grp int, rb int, qb int")
    none = F.lit(None)
    residents = placed.join(F.broadcast(blocks), "grp").select("grp", F.pmod(F.xxhash64("id"), F.col("rb")).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), "id", "v", "cell", "code", none.cast("array<int>").alias("cells"))
    asked = placed.select("id", "v", F.explode("asks").alias("ask")).select("id", "v", "ask.grp", "ask.cells").join(F.broadcast(blocks), "grp")
    asked = asked.select("grp", F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("r"), F.pmod(F.xxhash64("id"), F.col("qb")).cast("int").alias("q"), "id", "v", F.lit(-1).alias("cell"), none.cast("binary").alias("code"), "cells")
    found = residents.unionByName(asked).groupBy("grp", "r", "q").applyInArrow(_search(index, k), "id bigint, other bigint, similarity double")
    near = best(found, k).select(F.col("id").alias("head"), "other", "similarity")
    # from classes back to vectors: the first k + 1 members of a class are all that can be among k results
    member = tagged.where("head is not null").select("id", "head")
    w = Window.partitionBy("head").orderBy("id")
    first = checked(member.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1).select(F.col("head").alias("other"), F.col("id").alias("member")))
    heads = member.where("id = head").select("head", F.lit(True).alias("copied"))
    near = near.unionByName(heads.select("head", F.col("head").alias("other"), F.lit(1.0).alias("similarity")))
    spread = near.join(first, "other", "left").select("head", F.coalesce("member", "other").alias("other"), "similarity")
    lists = best(spread, k + 1, "head").join(checked(heads), "head", "left").checkpoint()
    alone = lists.where("copied is null").where(F.col("rank") <= k).select(F.col("head").alias("id"), "other", "similarity", "rank")
    copied = checked(lists.where("copied").select("head", "other", "similarity"))
    copies = best(member.join(copied, "head").where("id <> other").select("id", "other", "similarity"), k)
    return alone.unionByName(copies).withColumnRenamed("id", key)

"""Exact similarity join of texts on word shingles in the Jaccard metric space.

Pivots are the single shingles {s}. In the Jaccard metric every text that holds s is at distance 1 - 1/n from {s}, any
other text at 1, so a text's nearest pivots are its own shingles; ties go to the rarer shingle, and the Voronoi region
of a text is that of its rarest shingle. (Pivots that are texts cannot work at this radius: the triangle inequality
keeps a text in its own region only if its distance to the nearest pivot is 2r = 0.8 less than to the next, but
distances end at 1, so every text would be copied into nearly every region.) The windows follow from the radius: a text
within distance 1 - t of another shares at least `need` shingles with it, so a text is copied into the regions of its
n - ceil(t n) + 1 rarest shingles as a seeker and of its n - ceil(2t/(1+t) n) + 1 rarest as a resident, and a seeker
only meets residents whose size lies in [t n, n]. Regions of more than HOT_REGION texts are split again by the next shared
shingle, which keeps the join exact; what is still larger is cut into blocks of that size, which meet two by two in tasks
of their own. Hot shingles that nearly always stand together (a stock phrase) count as one pivot that weighs as much as a
text has of them, so a text made of such phrases enters few regions. Inside a region the distance to a fixed set of hashed sub-universes (a bitmap of 256
bits) bounds the symmetric difference from below; what is left is verified on the full shingle sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.text import mix, slices, words
from skein.operators.joins import checked, with_keys, without_keys
from skein.session import ensure_checkpoint_dir, let_go

#: Bits of a bitmap, and (from LARGE shingles on) of the second, wider one.
BITS, LARGE, WIDE_BITS = 256, 200, 2048
#: Counters of the frequency sketch that orders shingles by rarity, as powers of two: one per SKETCH_BYTES bytes of text
#: within these bounds. Any order is exact, a better one is faster.
LEAST_COUNTERS, MOST_COUNTERS, SKETCH_BYTES = 20, 25, 32
#: Counters of one block of the sketch, and sketches that one task adds up.
BLOCK, FAN_IN = 1 << 16, 64
#: Steps per doubling in which counts are passed on.
STEPS = 256.0
#: Texts of a region above which its members are sent on to regions of two shingles.
HOT_REGION = 50_000
#: Share of the places of two hot shingles at which they follow each other, from which they are of one phrase.
TOGETHER = 0.9
#: Region entries that one task is meant to join, and the most it unpacks at a time.
TASK_ENTRIES = 1_200_000


def in_order(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all texts in the order of the text as 64-bit hashes, and the number of the text of each."""
    w, counts = words(texts)
    ends = np.cumsum(counts)
    of = np.repeat(np.arange(len(counts)), counts)
    h = np.zeros(max(0, len(w) - width + 1), np.uint64)
    for k in range(width):
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + w[k : k + len(h)])
    whole = (np.arange(len(h)) + width) <= ends[of[: len(h)]]
    return h[whole], of[: len(whole)][whole]


def shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as 64-bit hashes, text after text and sorted within each, and where each
    text's begin (the end as the last entry)."""
    h, of = in_order(texts, width)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(of[order], kind="stable")]
    h, of = h[order], of[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[fresh], of[fresh]
    return h, np.searchsorted(of, np.arange(len(texts) + 1))


def bitmaps(h: np.ndarray, at: np.ndarray, width: int = BITS) -> np.ndarray:
    """Bits of each text, as words of 64: which classes of shingles it holds."""
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    bit = (h >> np.uint64(40)) & np.uint64(width - 1)
    out = np.zeros((len(at) - 1, width // 8), np.uint8)
    np.bitwise_or.at(out, (rows, (bit >> np.uint64(3)).astype(np.int64)), np.left_shift(1, (bit & np.uint64(7)).astype(np.int64)).astype(np.uint8))
    return out.view(np.uint64)


def least_common(n: np.ndarray, t: float) -> np.ndarray:
    """Shingles that two sets of n elements together must share for a similarity of t."""
    return np.ceil(t / (1 + t) * n - 1e-9).astype(np.int32)


def seeker_prefix(n: np.ndarray, t: float) -> np.ndarray:
    return n - np.ceil(t * n - 1e-9).astype(n.dtype) + 1


def resident_prefix(n: np.ndarray, t: float) -> np.ndarray:
    return n - np.ceil(2 * t / (1 + t) * n - 1e-9).astype(n.dtype) + 1


def meet(key: np.ndarray, who: np.ndarray, n: np.ndarray, pos: np.ndarray, maps: list[tuple[int, np.ndarray]], t: float, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts that may be similar within regions. One entry per text and region: key of the region, number of
    the text (rows of n and of the bitmaps), place of the region's shingle in the text's order. maps: bitmaps with the
    least size from which each is needed. Memory is bounded by block, not by the size of a region."""
    n = n.astype(np.int32)
    top = int(n.max(initial=0)) + 2
    _, region = np.unique(key, return_inverse=True)
    place = region.astype(np.int64) * top + n[who]
    order = np.argsort(place)
    place, who, pos = place[order], who[order].astype(np.int32), pos[order].astype(np.int32)
    size = n[who]
    base = place - size
    r = np.flatnonzero(pos < resident_prefix(size, t))
    rp = place[r]
    rest = size - pos  # at most so many shingles can still be shared
    most = np.minimum(size, np.floor(rest * ((1 + t) / t) + 1e-6).astype(np.int32) - size)
    low = np.searchsorted(rp, base + np.ceil(t * size - 1e-9).astype(np.int64))
    high = np.searchsorted(rp, base + np.maximum(most, 0), side="right")
    many = np.maximum(high - low, 0)
    rwho, rrest, rsize = who[r], rest[r], size[r]
    need = least_common(np.arange(2 * top), t)
    seekers = np.flatnonzero(many > 0)
    total = np.cumsum(many[seekers])
    out, i = [], 0
    while i < len(seekers):
        done = int(total[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(total, done + block, side="right")))
        s = seekers[i:j]
        wide = int(many[s[0]]) if j == i + 1 else block
        for first in range(0, wide, block):
            m = np.minimum(many[s] - first, block)
            b = np.arange(int(m.sum())) + np.repeat(low[s] + first - (np.cumsum(m) - m), m)
            limit = need[np.repeat(size[s], m) + rsize[b]]
            ok = np.flatnonzero((rrest[b] >= limit) & (np.repeat(who[s], m) != rwho[b]))
            a, b = np.repeat(s.astype(np.int32), m)[ok], b[ok]
            wa, wb = who[a], rwho[b]
            limit = size[a] + rsize[b] - 2 * limit[ok]
            for least, bits in maps:
                apart = np.zeros(len(wa), np.int32)
                for k in range(bits.shape[1]):
                    apart += np.bitwise_count(bits[wa, k] ^ bits[wb, k])
                ok = (apart <= limit) if not least else (apart <= limit) | (np.minimum(n[wa], n[wb]) < least)
                wa, wb, limit = wa[ok], wb[ok], limit[ok]
            out.append(np.minimum(wa, wb).astype(np.int64) << np.int64(32) | np.maximum(wa, wb))
        i = j
    meet.pairs = int(total[-1]) if len(total) else 0
    pairs = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
    return pairs >> np.int64(32), pairs & np.int64(0xFFFFFFFF)


def _counts(df: DataFrame, key: str, text: str, width: int, least: int, counters: int) -> DataFrame:
    """One pass over the texts. Rows with a block hold counters of the sketch of one task (compressed); the others hold
    a text's key, its number of shingles and two hashes of its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(counters, np.uint32)
        names = [key, "n", "f1", "f2", "block", "task", "counts"]
        for batch in slices(batches, 1):
            h, at = shingles([x or "" for x in batch.column(1).to_pylist()], width)
            n = np.diff(at)
            slots, add = np.unique((h & np.uint64(counters - 1)).astype(np.int64), return_counts=True)
            seen[slots] += add.astype(np.uint32)
            total = np.concatenate(([0], np.cumsum(h, dtype=np.uint64)))
            mixed = np.concatenate(([0], np.cumsum(mix(h), dtype=np.uint64)))
            f1, f2 = (np.diff(x.astype(np.uint64)[at]).view(np.int64) for x in (total, mixed))
            keep = np.flatnonzero(n >= least)
            none = pa.nulls(len(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(n[keep], pa.int32()), pa.array(f1[keep]), pa.array(f2[keep]), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        by_block = seen.reshape(-1, min(BLOCK, counters))
        blocks = np.flatnonzero(by_block.any(axis=1))
        none = pa.nulls(len(blocks))
        packed = [zlib.compress(_narrow(by_block[b]), 1) for b in blocks]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.int64()), pa.array(blocks, pa.int32()), pa.array([task] * len(blocks), pa.int32()), pa.array(packed, pa.binary())], names=names)

    return df.select(F.col(key).cast("bigint").alias(key), text).mapInArrow(run, f"`{key}` bigint, n int, f1 bigint, f2 bigint, block int, task int, counts binary")


def _sketch(rows: DataFrame, counters: int) -> np.ndarray:
    """How often the shingles of each slot stand in texts, as STEPS * log2(1 + count). The sketches of FAN_IN tasks are
    added up at a time, so a task holds FAN_IN blocks at most; the driver gets two bytes per counter."""

    def add(last: bool):
        def run(table: pa.Table) -> pa.Table:
            total = 0
            for c in table.column("counts").to_pylist():
                total = total + _widened(zlib.decompress(c))
            out = np.rint(np.log2(total + 1.0) * STEPS).astype(np.int64) if last else total
            return pa.table({"block": table.column("block").slice(0, 1), "task": table.column("task").slice(0, 1), "counts": pa.array([zlib.compress(_narrow(out), 1)], pa.binary())})

        return run

    kind = "block int, task int, counts binary"
    rows = rows.where("block is not null").select("block", "task", "counts")
    tasks = (rows.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > FAN_IN:
        rows = rows.withColumn("task", (F.col("task") / FAN_IN).cast("int")).groupBy("block", "task").applyInArrow(add(False), kind).checkpoint()
        tasks = -(-tasks // FAN_IN)
    out = np.zeros((max(1, counters // BLOCK), min(BLOCK, counters)), np.uint16)
    for row in rows.withColumn("task", F.lit(0)).groupBy("block", "task").applyInArrow(add(True), kind).toLocalIterator():
        out[row.block] = _widened(zlib.decompress(row.counts))
    return out.ravel()


def hot_level(sketch: np.ndarray, hot: int) -> float:
    """The value of a counter from which its shingle counts as hot. A counter holds its shingles' own count and those of
    the others that share it; what counters hold in the middle is taken for the latter, so a full sketch makes no
    shingle hot that isn't."""
    count = lambda q: 2.0 ** (float(np.quantile(sketch, q)) / STEPS) - 1
    middle = count(0.5)
    return STEPS * float(np.log2(1 + middle + max(hot, 8 * (count(0.75) - middle))))


def _phrases(df: DataFrame, key: str, text: str, width: int, sketch, level: float, share: float = TOGETHER) -> tuple[np.ndarray, np.ndarray]:
    """The hot shingles of phrases (sorted) and the one that stands for the phrase of each. Two hot shingles are of one
    phrase if they follow each other at a share of their places in all texts. Any phrases keep the join exact. The driver
    gets pairs of one phrase only, for each shingle one at most if the share is more than a half; those that merely share
    a counter with a hot one hardly ever stand side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            h, of = in_order([x or "" for x in batch.column(0).to_pylist()], width)
            hot = sketch.value[(h & np.uint64(len(sketch.value) - 1)).astype(np.int64)] > level
            both = np.flatnonzero(hot[1:] & hot[:-1] & (of[1:] == of[:-1]))
            a, b = np.concatenate((h[hot], h[both])), np.concatenate((np.zeros(int(hot.sum()), np.uint64), h[both + 1]))
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            n = np.diff(np.append(begins, len(a)))
            yield pa.RecordBatch.from_arrays([pa.array(a[begins].view(np.int64)), pa.array(b[begins].view(np.int64)), pa.array(n, pa.int64())], names=["a", "b", "n"])

    seen = df.select(text).mapInArrow(run, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).checkpoint()
    alone = seen.where("b = 0").select("a", F.col("n").alias("own"))
    pairs = seen.where("b <> 0").join(alone, "a").where(F.col("n") >= share * F.col("own")).join(alone.select(F.col("a").alias("b"), F.col("own").alias("other")), "b").where(F.col("n") >= share * F.col("other"))
    found = pairs.select("a", "b").toArrow()
    a, b = (found.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
    keys = np.unique(np.concatenate((a, b)))
    up = {h: h for h in keys.tolist()}

    def top(h: int) -> int:
        while up[h] != h:
            up[h] = h = up[up[h]]
        return h

    for x, y in sorted(zip(a.tolist(), b.tolist())):
        up[top(x)] = top(y)
    return keys, np.array([top(int(h)) for h in keys], np.uint64)


def entries(h: np.ndarray, at: np.ndarray, sketch: np.ndarray, level: float, t: float, least: int, phrases: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The regions of each text: key, number of the text, and how many of the text's shingles can't be shared any more at
    the region's pivot, in the text's order of rarity. Pivots are shingles, or phrases of hot ones, which weigh as much as
    the text has of them. Shingles that stand in one text only lead nowhere and are left out. level: see hot_level."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    if phrases is not None and len(phrases[0]):
        place = np.minimum(np.searchsorted(phrases[0], h), len(phrases[0]) - 1)
        h = np.where(phrases[0][place] == h, phrases[1][place], h)
    count = sketch[(h & np.uint64(len(sketch) - 1)).astype(np.int64)]
    order = np.lexsort((h, count, doc))
    h, count = h[order], count[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    begins = np.flatnonzero(fresh)
    weight = np.diff(np.append(begins, len(h)))
    h, count, doc = h[begins], count[begins], doc[begins]
    pos = begins - at[:-1][doc]
    last = seeker_prefix(n, t)
    keep = (pos < last[doc]) & (count > STEPS) & (n[doc] >= least)  # a single text gives STEPS
    hot = count > level
    split = np.flatnonzero(keep & hot)
    # texts that may be similar with this pivot alone meet in the hot region too
    plain = np.flatnonzero(keep & (~hot | (np.ceil(t * n - 1e-9)[doc] <= weight)))
    key, who, place = [h[plain]], [doc[plain]], [pos[plain]]
    if len(split):
        # the next shared pivot: what is left from it on must make up for all but the first pivot's weight
        line = doc * (int(n.max()) + 2) + pos
        until = np.searchsorted(line, doc[split] * (int(n.max()) + 2) + np.minimum(last[doc[split]] + weight[split], n[doc[split]]))
        more = np.maximum(until - split - 1, 0)
        first = np.repeat(split, more)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(more) - more, more)
        key.append(mix(h[first] * np.uint64(3) ^ mix(h[second])))
        who.append(doc[first])
        place.append(pos[second] - weight[first])
    return np.concatenate(key), np.concatenate(who), np.concatenate(place)


def _narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 up in as few bytes each as the largest takes; the first byte tells how many."""
    kind = np.uint8 if not len(x) or x.max() < 1 << 8 else np.uint16 if x.max() < 1 << 16 else np.uint32 if x.max() < 1 << 32 else np.int64
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _packed(x: np.ndarray) -> bytes:
    """Bitmaps are sparse, so they shrink by a third."""
    return zlib.compress(x.tobytes(), 1)


def _widened(x: bytes) -> np.ndarray:
    return np.frombuffer(x, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[x[0]], offset=1).astype(np.int64)


def _regions(df: DataFrame, key: str, text: str, width: int, t: float, least: int, level: float, sketch, phrases, buckets: int) -> DataFrame:
    """Packed region entries by bucket: a bucket holds many regions, a region stands in one bucket."""
    names = ["bucket", "least", "ids", "n", "bits", "wide", "each", "keys", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            h, at = shingles([x or "" for x in batch.column(1).to_pylist()], width)
            n = np.diff(at)
            bits, large = bitmaps(h, at), n >= LARGE
            wide = np.zeros((len(n), WIDE_BITS // 64), np.uint64)
            if large.any():
                at_large = np.concatenate(([0], np.cumsum(n[large])))
                wide[large] = bitmaps(h[np.repeat(large, n)], at_large, WIDE_BITS)
            k, who, pos = entries(h, at, sketch.value, level, t, least, phrases.value)
            k = mix(k)
            bucket = (k % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((who, bucket))
            k, who, pos, bucket = (k[order] >> np.uint64(32)).astype(np.uint32), who[order], pos[order], bucket[order]
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            rows: list[list] = [[] for _ in names]
            for b in np.flatnonzero(np.diff(edges)):
                lo, hi = edges[b], edges[b + 1]
                docs, each = np.unique(who[lo:hi], return_counts=True)
                own = ids[docs].astype(np.int64)
                parts = (_narrow(own - own.min()), _narrow(n[docs]), _packed(bits[docs]), _packed(wide[docs[large[docs]]]), _narrow(each), k[lo:hi], _narrow(pos[lo:hi]))
                for column, value in zip(rows, (int(b), int(own.min()), *(p if isinstance(p, bytes) else p.tobytes() for p in parts))):
                    column.append(value)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), *(pa.array(r, pa.binary()) for r in rows[2:])], names=names)

    return df.select(F.col(key).cast("bigint").alias(key), text).mapInArrow(run, "bucket int, least bigint, ids binary, n binary, bits binary, wide binary, each binary, keys binary, places binary")


def _unpacked(table: pa.Table, narrow: list[str]) -> dict:
    """The arrays of packed rows; bitmaps of the second kind are zero where a text is too small to have one."""
    columns = {c: table.column(c).to_pylist() for c in table.column_names}
    out = {c: np.concatenate([_widened(x) for x in columns[c]]) for c in narrow if c != "ids"}
    out["ids"] = np.concatenate([_widened(x) + least for x, least in zip(columns["ids"], columns["least"])])
    out["n"] = out["n"].astype(np.int32)
    out["bits"] = np.frombuffer(b"".join(map(zlib.decompress, columns["bits"])), np.uint64).reshape(-1, BITS // 64)
    large = out["n"] >= LARGE
    out["wide"] = np.zeros((len(large), WIDE_BITS // 64 if large.any() else 0), np.uint64)
    if large.any():
        out["wide"][large] = np.frombuffer(b"".join(map(zlib.decompress, columns["wide"])), np.uint64).reshape(-1, WIDE_BITS // 64)
    if "keys" in columns:
        out["keys"] = np.frombuffer(b"".join(columns["keys"]), np.uint32)
    return out


#: What a bucket gives: pairs, or (where a region is too large for one task) the blocks of a region.
MET = "a bigint, b bigint, bucket int, region bigint, block int, low int, high int, least bigint, ids binary, n binary, bits binary, wide binary, places binary"


def _meet_bucket(t: float, hot: int, seen):
    def run(table: pa.Table) -> pa.Table:
        x = _unpacked(table, ["ids", "n", "each", "places"])
        ids, n, bits, wide, keys, places = (x[c] for c in ("ids", "n", "bits", "wide", "keys", "places"))
        who = np.repeat(np.arange(len(n)), x["each"])
        heads, sizes = np.unique(keys, return_counts=True)
        blocks: list[tuple] = []
        large = heads[sizes > hot]
        for region in large.tolist():
            own = np.flatnonzero(keys == region)
            own = own[np.argsort(n[who[own]], kind="stable")]  # by size, so that blocks of very different sizes needn't meet
            for number, at in enumerate(range(0, len(own), hot)):
                part = own[at : at + hot]
                w = who[part]
                some = n[w] >= LARGE
                least = int(ids[w].min())
                blocks.append((int(table.column("bucket")[0].as_py()), region, number, int(n[w].min()), int(n[w].max()), least, _narrow(ids[w] - least), _narrow(n[w]), _packed(bits[w]), _packed(wide[w[some]]), _narrow(places[part])))
        if blocks:
            seen.add(len(blocks))
        rest = np.ones(len(keys), bool) if not len(large) else ~np.isin(keys, large)
        parts = max(1, -(-int(rest.sum()) // TASK_ENTRIES))
        out_a, out_b = [], []
        for p in range(parts):  # a bucket larger than planned is joined in several steps
            own = np.flatnonzero(rest & (keys % np.uint32(parts) == p)) if parts > 1 else np.flatnonzero(rest)
            a, b = meet(keys[own], who[own], n, places[own], [(0, bits), (LARGE, wide)], t)
            out_a.append(ids[a])
            out_b.append(ids[b])
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        return _met(np.minimum(a, b), np.maximum(a, b), blocks)

    return run


def _met(a: np.ndarray, b: np.ndarray, blocks: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
    names = [c.split()[0] for c in MET.split(", ")]
    columns = list(zip(*blocks)) or [[]] * len(kinds)
    pairs = [pa.array(a, pa.int64()), pa.array(b, pa.int64())]
    none = [pa.nulls(len(blocks), pa.int64())] * 2
    return pa.table([pa.chunked_array([p, e]) for p, e in zip(pairs, none)] + [pa.chunked_array([pa.nulls(len(a), k), pa.array(list(c), k)]) for c, k in zip(columns, kinds)], names=names)


def _meet_blocks(t: float):
    """Two blocks of one region, or one with itself."""

    def run(table: pa.Table) -> pa.Table:
        x = _unpacked(table.select(["least", "ids", "n", "bits", "wide", "places"]), ["ids", "n", "places"])
        n = x["n"]
        side = np.repeat(np.arange(table.num_rows), [len(_widened(c)) for c in table.column("n").to_pylist()])
        a, b = meet(np.zeros(len(n), np.uint32), np.arange(len(n)), n, x["places"], [(0, x["bits"]), (LARGE, x["wide"])], t)
        if table.num_rows > 1:
            apart = side[a] != side[b]
            a, b = a[apart], b[apart]
        a, b = x["ids"][a], x["ids"][b]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return run


def _between_blocks(blocks: DataFrame, t: float) -> DataFrame:
    """The pairs of the blocks of each region, two blocks to a task, if their sizes allow for any."""
    sizes = blocks.select("bucket", "region", "block", "low", "high")
    other = sizes.select("bucket", "region", F.col("block").alias("second"), F.col("low").alias("low2"))
    turns = sizes.join(other, ["bucket", "region"]).where((F.col("second") >= F.col("block")) & (F.col("low2") * F.lit(t) <= F.col("high") + 1e-6))
    turns = turns.select("bucket", "region", F.col("block").alias("first"), "second", F.explode(F.array_distinct(F.array("block", "second"))).alias("block"))
    both = turns.join(blocks.drop("a", "b", "low", "high"), ["bucket", "region", "block"])
    return both.groupBy("bucket", "region", "first", "second").applyInArrow(_meet_blocks(t), "a bigint, b bigint")


def similar_texts(df: DataFrame, key: str, text: str, t: float = 0.8, width: int = 5, least: int = 1, hot: int = HOT_REGION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The exact join: (classes, copies, pairs). classes has (key, class_id): texts with the same set of shingles have one
    class, named by its smallest key; copies are its rows in classes of several texts. pairs has (class_a, class_b, common, n_a, n_b, similarity), class_a < class_b,
    for all classes whose sets are at least t similar.

    Texts with fewer than `least` shingles, null and empty ones included, are in no class. Keys must be unique
    integers; rows with a null key drop out; an empty table gives empty results; other columns are ignored. Words and
    shingles: see skein.llm.text.words. Copies meet only by their hash, so a text that makes up a third of all rows
    costs one row per copy in a map-side combined count."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    df = df.select(key, text).where(F.col(key).isNotNull())
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    counters = 1 << min(MOST_COUNTERS, max(LEAST_COUNTERS, int(size // SKETCH_BYTES).bit_length()))
    counted = _counts(df, key, text, width, least, counters).checkpoint()
    counts = _sketch(counted, counters)
    level = hot_level(counts, hot)
    sketch = spark.sparkContext.broadcast(counts)
    sets = counted.where("block is null").select(key, "n", "f1", "f2")
    by_set = sets.groupBy("f1", "f2", "n").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("copies"))
    several = by_set.where("copies > 1")
    copies = sets.join(checked(several.select("f1", "f2", "n", "class_id")), ["f1", "f2", "n"]).select(key, "class_id")
    classes = sets.select(key).join(copies, key, "left").select(key, F.coalesce("class_id", key).alias("class_id"))
    first = without_keys(df, copies.where(F.col(key) != F.col("class_id")).select(key), key)
    total = seeker_share(t) * (sets.agg(F.sum("n")).first()[0] or 0)
    phrases = _phrases(first, key, text, width, sketch, level) if (counts > level).any() else None
    phrases = spark.sparkContext.broadcast(phrases)
    buckets = max(2, int(total // TASK_ENTRIES) + 1)
    packed = _regions(first, key, text, width, t, max(least, 1), level, sketch, phrases, buckets)
    large = spark.sparkContext.accumulator(0)
    found = packed.groupBy("bucket").applyInArrow(_meet_bucket(t, hot, large), MET)
    met = found.where("region is null").select("a", "b").distinct().checkpoint()
    if large.value:  # few regions are too large for a task; only then the buckets are read again for them
        blocks = found.where("region is not null").checkpoint()
        met = met.unionByName(_between_blocks(blocks, t)).distinct().checkpoint()
        del blocks
    del packed, found
    let_go(spark)
    ends = met.select(F.col("a").alias(key)).union(met.select(F.col("b").alias(key))).distinct()
    full = _sets(with_keys(df, ends, key), key, text, width).checkpoint()
    pairs = (
        met.join(full.select(F.col(key).alias("a"), F.col("h").alias("ha")), "a")
        .join(full.select(F.col(key).alias("b"), F.col("h").alias("hb")), "b")
        .select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), F.size(F.array_intersect("ha", "hb")).alias("common"), F.size("ha").alias("n_a"), F.size("hb").alias("n_b"))
        .withColumn("similarity", F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common")))
        .where(F.col("similarity") >= t)
    )
    return classes, copies, pairs


def seeker_share(t: float) -> float:
    return 1 - t


def _sets(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            h, at = shingles([x or "" for x in batch.column(1).to_pylist()], width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h.view(np.int64)))], names=[key, "h"])

    return df.select(F.col(key).cast("bigint").alias(key), text).mapInArrow(run, f"`{key}` bigint, h array<bigint>")


def member_pairs(copies: DataFrame, pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """All pairs of keys, smaller first, that pairs of classes and classes of copies stand for. Only classes of several
    texts are looked up: any other is its own member."""
    own = checked(copies)
    one, other = (own.select(F.col("class_id").alias(c), F.col(key).alias(k)) for k, c in (("x", "class_a"), ("y", "class_b")))
    crossed = pairs.select("class_a", "class_b").join(one, "class_a", "left").join(other, "class_b", "left").select(F.coalesce("x", "class_a").alias("x"), F.coalesce("y", "class_b").alias("y"))
    inside = one.join(other.withColumnRenamed("class_b", "class_a"), "class_a").where("x < y").select("x", "y")
    return crossed.union(inside).select(F.least("x", "y").alias(a), F.greatest("x", "y").alias(b))


def groups(classes: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(key, class_id, links, group_id): links are the similar classes of a row's class, groups the connected components
    of classes, named by their smallest class. Components come from min-label rounds with pointer jumping, so a
    component of n classes takes about log n rounds; nothing is collected."""
    links = pairs.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).union(pairs.select("class_b", "class_a")).checkpoint()
    label = links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).checkpoint()
    moved = 1
    while moved:
        near = links.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("to").alias("near"))
        new = label.join(near, "a").select("a", F.least("to", "near").alias("to"), F.col("to").alias("old"))
        jump = new.select(F.col("a").alias("to"), F.col("to").alias("further"))
        new = new.join(jump, "to").select("a", F.least("to", "further").alias("to"), "old").checkpoint()
        moved = new.where("to <> old").count()
        label = new.select("a", "to")
    count = links.groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    known = count.join(label, "a").select(F.col("a").alias("class_id"), "links", F.col("to").alias("group_id"))
    out = classes.join(known, "class_id", "left")
    return out.select(key, "class_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", "class_id").alias("group_id"))

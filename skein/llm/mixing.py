"""Mixing sources to target weights: packed blocks, multinomial counts per shard, pseudorandom permutations.

The token stream of a source (its texts one after the other, in the order of a hash of their key, so that it doesn't
depend on how the table is stored) is cut into blocks of fixed length. A plan gets as many
slots as its scarcest source allows at its target share. Every output shard draws its source counts: the whole part of
its expectation, the rest from a multinomial. The j-th slot of a source takes block perm_e(j mod blocks) of its e-th
pass, e = j div blocks, where perm_e is a keyed permutation computed from the index alone; so no pass uses a block
twice, and passes never exceed max_repeat. Slots and blocks meet in one equi-join by (source, block).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.encode import TOKENIZERS, encoder
from skein.llm.text import slices
from skein.operators.running import running_sum
from skein.session import ensure_checkpoint_dir

BLOCK, SHARDS, SEED = 512, 64, 20240611
#: Slots that are listed at a time; runs of slots are spread over all tasks.
RUN = 4096


def source_key(c):
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """perm_key(index) on 0..n-1, elementwise: a Feistel network of four rounds on the next even power of two, walked
    until the value falls below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, key = index.astype(np.uint64), key.astype(np.uint64)
    out, todo = x.copy(), np.arange(len(x))
    while len(todo):
        v, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = v >> h, v & m
        for r in range(4):
            f = (right + k + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _sized(df: DataFrame, key: str, text: str, tokenizer: str) -> DataFrame:
    """Tokens of each text. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for part in slices(batches, 2):
            n = code.counts([t or "" for t in part.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], names=["doc", "source", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("doc"), "source", text).mapInArrow(run, f"doc {kind}, source string, n_tokens bigint")


def draw(plans: list[tuple[str, str, float, int]], blocks: dict[str, int], tokens: dict[str, int], shards: int, seed: int) -> tuple[list[tuple], dict[str, int]]:
    """(plan, shard, source, first slot of the source, count) and the slots of each plan. plans are few rows."""
    rows, totals = [], {}
    for plan in sorted({p for p, *_ in plans}):
        own = [(s, w, r) for p, s, w, r in plans if p == plan and blocks.get(s, 0) > 0 and w > 0 and r > 0]
        if not own:
            totals[plan] = 0
            continue
        # a source's last block may be short, so shares of tokens are not quite shares of slots
        weight = np.array([w * blocks[s] / tokens[s] for s, w, _ in own])
        weight = weight / weight.sum()
        room = np.array([r * blocks[s] for s, _, r in own])
        slots = int(np.floor((room / weight).min() + 1e-9))
        while True:
            rng = np.random.default_rng([seed, *plan.encode()])
            count, used = [], np.zeros(len(own), np.int64)
            for shard in range(shards):
                size = slots * (shard + 1) // shards - slots * shard // shards
                mean = size * weight
                whole = np.floor(mean + 1e-9).astype(np.int64)
                rest = size - int(whole.sum())
                if rest > 0:
                    part = np.maximum(mean - whole, 0) + 1e-12
                    whole = whole + rng.multinomial(rest, part / part.sum())
                count.append(whole)
                used += whole
            if (used <= room).all():
                break
            slots = min(slots - 1, int(slots * (room / np.maximum(used, 1)).min()))
        first = np.zeros(len(own), np.int64)
        for shard, whole in enumerate(count):
            for i, (s, _, _) in enumerate(own):
                if whole[i]:
                    rows.append((plan, shard, s, int(first[i]), int(whole[i])))
            first += whole
        totals[plan] = slots
    return rows, totals


def mix(df: DataFrame, plans: DataFrame, key: str, source: str, text: str, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> tuple[DataFrame, DataFrame]:
    """(mixed, shares). mixed has a row per slot and text in it: (plan_code, shard, source, slot, block, pass_no, doc,
    from_token, to_token), tokens of the text that stand in the block. shares has a row per line of a plan: (plan_code,
    source, target_share, wanted_share, blocks, available_tokens, tokens, actual_share, passes).

    plans has (plan_code, source, target_share, max_repeat) and is a small table; a source's lines in a plan add up
    their weights with the least max_repeat. wanted_share is the weight divided by the weights of the plan's sources
    that have tokens; sources without any get 0. Null and empty texts have no tokens and are in no mix, nor are texts of
    sources that no plan names or without a source. A plan none of whose sources has tokens gets no slot. Repeated
    keys are separate texts; an empty table gives empty results; other columns are ignored."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    wanted: dict[tuple[str, str], tuple[float, int]] = {}
    for r in plans.select("plan_code", source_key(F.col("source")).alias("source"), "target_share", "max_repeat").collect():
        if r.plan_code is not None and r.source is not None:
            w, m = wanted.get((r.plan_code, r.source), (0.0, 1 << 30))
            wanted[r.plan_code, r.source] = (w + max(r.target_share or 0.0, 0.0), min(m, max(r.max_repeat or 0, 0)))
    lines = [(p, s, w, m) for (p, s), (w, m) in sorted(wanted.items())]
    named = sorted({s for _, s, _, _ in lines})
    texts = df.select(F.col(key), source_key(F.col(source)).alias("source"), F.col(text))
    sized = _sized(texts.where(F.col("source").isin(named) & (F.length(text) > 0)), key, text, tokenizer).where("n_tokens > 0").checkpoint()
    # places in the token stream: only keys and sizes are sorted; texts of equal key and size are interchangeable
    placed = running_sum(sized.withColumn("h", F.xxhash64("doc")), "source", ["h", "doc", "n_tokens"], "n_tokens", "start")
    totals = {r.source: r.n for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    blocks = {s: -(-n // block) for s, n in totals.items()}
    drawn, _ = draw(lines, blocks, totals, shards, seed)
    slots = spark.createDataFrame(drawn, "plan_code string, shard int, source string, first bigint, count bigint")
    end_slot = F.col("first") + F.col("count") - 1
    runs = slots.select("plan_code", "shard", "source", end_slot.alias("last"), F.explode(F.sequence("first", end_slot, F.lit(RUN))).alias("begin")).repartition("plan_code", "source", "begin")
    slots = runs.select("plan_code", "shard", "source", F.explode(F.sequence("begin", F.least(F.col("begin") + RUN - 1, F.col("last")))).alias("slot"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(2).to_pylist()
            n = np.array([blocks[s] for s in names], np.int64)
            slot = batch.column(3).to_numpy()
            pass_no = slot // np.maximum(n, 1)
            salt = {s: int.from_bytes(s.encode()[:6].ljust(6, b"."), "big") + i for i, s in enumerate(named)}
            keys = np.array([salt[s] for s in names], np.uint64) * np.uint64(1_000_003) + pass_no.astype(np.uint64) * np.uint64(7919) + np.uint64(seed)
            chosen = permuted(slot - pass_no * n, n, keys) if len(n) else slot
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chosen, pa.int64()), pa.array(pass_no, pa.int64())], names=["plan_code", "shard", "source", "slot", "block", "pass_no"])

    slots = slots.mapInArrow(choose, "plan_code string, shard int, source string, slot bigint, block bigint, pass_no bigint")
    end = F.col("start") + F.col("n_tokens")
    cut = placed.select("doc", "source", "start", "n_tokens", F.explode(F.sequence((F.col("start") / block).cast("bigint"), ((end - 1) / block).cast("bigint"))).alias("block"))
    cut = cut.select("doc", "source", "block", (F.greatest(F.col("start"), F.col("block") * block) - F.col("start")).alias("from_token"), (F.least(end, (F.col("block") + 1) * block) - F.col("start")).alias("to_token"))
    # both sides grow with the corpus, so neither is ever broadcast, whatever size is guessed for it
    mixed = slots.join(cut.hint("merge"), ["source", "block"]).select("plan_code", "shard", "source", "slot", "block", "pass_no", "doc", "from_token", "to_token")
    present = {p: sum(w for q, s, w, m in lines if q == p and blocks.get(s) and m) for p, *_ in lines}
    report = spark.createDataFrame([(p, s, w, w / present[p] if blocks.get(s) and m and present[p] else 0.0, blocks.get(s, 0), totals.get(s, 0), m) for p, s, w, m in lines], "plan_code string, source string, target_share double, wanted_share double, blocks bigint, available_tokens bigint, max_repeat int")
    reached = mixed.groupBy("plan_code", "source").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("tokens"), F.max(F.col("pass_no") + 1).alias("passes"))
    shares = report.join(reached, ["plan_code", "source"], "left").na.fill(0, ["tokens", "passes"])
    shares = shares.withColumn("actual_share", F.coalesce(F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy("plan_code"))), F.lit(0.0)))
    return mixed, shares

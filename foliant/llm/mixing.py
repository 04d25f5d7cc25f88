"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's rows fall into a fixed number of blocks by a keyed hash, so the table
of block sizes is small against the corpus. A source's target is its share of all
sizes by weight, at most ``most`` times its own size; the excess goes to the others
by weight until none is above. Passes over a source's blocks, each in a permutation
of its own, are cut where the sum comes nearest to the target: that many blocks are
the source's exact quota. A binary tree then splits the quotas of all sources among
the output shards: at each node the left half's counts are one multivariate
hypergeometric draw, so that every division is as likely as if all blocks had been
shuffled; a shard takes the next blocks of each permutation. Within a pass a block is
in one shard only; a block that several passes take may be in several, or in one more
than once. Within a shard rows are in random order.

Everything random comes from the seed and from hashes of rows: reruns agree. The driver
holds a few numbers for each source, about 200 bytes with 16 shards; what is known for
each block stays a table, which is joined by broadcast only if Spark finds it small.

Defined cases: null and empty texts have size 0 and fall into blocks like others; a
null source is a source of its own, after all others in code point order; sources
without words have target 0; repeated rows fall into the same block and are taken
as often; an empty table gives no rows. Columns added take the place of columns with
the same name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, materialise

BLOCKS = 1024
WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3
#: Columns that mix_draws adds.
ADDED = ("size", "source_size", "target", "draws")
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: np.ndarray, weights: np.ndarray, most: float = MOST) -> np.ndarray:
    """Share of the sum of sizes by weight, none above ``most`` times its size."""
    sizes, weights = np.asarray(sizes, np.float64), np.asarray(weights, np.float64)
    left, out = float(sizes.sum()), np.zeros(len(sizes))
    free = (weights > 0) & (sizes > 0)
    while free.any() and left > 0:
        unit = left / weights[free].sum()
        full = free & (weights * unit > most * sizes)
        if not full.any():
            out[free] = weights[free] * unit
            break
        out[full] = most * sizes[full]
        left -= out[full].sum()
        free &= ~full
    return out


def block_order(source: int, blocks: list[int], seed: int, turn: int) -> list[int]:
    """The order in which a pass takes a source's blocks."""
    return [blocks[i] for i in np.random.default_rng([seed, source, turn]).permutation(len(blocks))]


def quota(source: int, sizes: dict[int, int], goal: float, seed: int, most: int = MOST) -> int:
    """How many blocks of the passes come nearest to the goal."""
    blocks, have, taken, best, cut = sorted(sizes), 0, 0, goal, 0
    for turn in range(most if goal > 0 else 0):
        for b in block_order(source, blocks, seed, turn):
            have, taken = have + sizes[b], taken + 1
            if abs(have - goal) < best:
                best, cut = abs(have - goal), taken
        if have >= goal:
            break
    return cut


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): how many blocks of each source each shard takes, by the splitting tree."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(lo: int, hi: int, counts: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = counts
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        whole = int(counts.sum())
        left, rest = divmod(whole * (mid - lo), hi - lo)
        if rest and rng.random() * (hi - lo) < rest:
            left += 1
        part = rng.multivariate_hypergeometric(counts, left, method="marginals") if len(counts) else counts
        split(lo, mid, part)
        split(mid, hi, counts - part)

    split(0, shards, np.asarray(quotas, np.int64))
    return out


def dealt(source: int, blocks: list[int], counts: list[int], seed: int) -> dict[int, list[int]]:
    """The shards that take each block of a source, which gives ``counts`` of its passes' blocks to them in turn."""
    draws: dict[int, list[int]] = {}
    order: list[int] = []
    for k, shard in enumerate(np.repeat(np.arange(len(counts)), counts).tolist()):
        turn, at = divmod(k, len(blocks))
        if not at:
            order = block_order(source, blocks, seed, turn)
        draws.setdefault(order[at], []).append(shard)
    return draws


def mix_draws(df: DataFrame, source: str = "source", text: str = "text", key: Column | None = None, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, shards: int = 16, blocks: int = BLOCKS, seed: int = 17) -> DataFrame:
    """df with ``size`` (words), ``source_size``, ``target`` and ``draws``: array of struct
    (shard, copy), one for each time that the mix takes the row."""
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in ADDED]
    key = F.xxhash64(*df.columns) if key is None else key
    block = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(blocks)).cast("int")
    sized = df.select(*(F.col(c) for c in kept), F.col(source).alias("__source"), word_count(F.col(text)).alias("__size"), block.alias("__block"))
    of_block = sized.groupBy(F.col("__source").alias("s"), F.col("__block").alias("b")).agg(F.sum("__size").alias("n"))
    shelf = Shelf()
    of_block = shelf.put(of_block, "blocks")
    # a row for each source: its place in code point order, null last, and its size
    ranked = of_block.groupBy("s").agg(F.sum("n").alias("source_size"))
    ranked = shelf.put(ranked.select((F.row_number().over(Window.orderBy(F.col("s").asc_nulls_last())) - 1).alias("code"), "s", "source_size"), "sources")
    sizes = np.array([n for _, n in sorted(map(tuple, ranked.select("code", "source_size").collect()))], np.int64)
    goals = targets(sizes, np.resize(np.array(weights, np.float64), len(sizes)), most)
    facts = spark.createDataFrame(pa.table({"code": pa.array(np.arange(len(sizes)), pa.int32()), "target": pa.array(goals, pa.float64())}))
    coded = of_block.join(ranked, of_block["s"].eqNullSafe(ranked["s"])).join(facts, "code").select("code", of_block["s"], "b", "n", "source_size", "target")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        code = int(pdf["code"].iloc[0])
        return pd.DataFrame({"code": [code], "quota": [quota(code, dict(zip(pdf["b"].tolist(), pdf["n"].tolist(), strict=True)), float(pdf["target"].iloc[0]), seed, most)]})

    quotas = np.zeros(len(sizes), np.int64)
    for code, n in coded.groupBy("code").applyInPandas(cut, "code int, quota bigint").collect():
        quotas[code] = n
    counts = split_quotas(quotas, shards, seed).T
    split = spark.createDataFrame(pa.table({"code": pa.array(np.arange(len(sizes)), pa.int32()), "counts": pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * shards, pa.int32()), pa.array(counts.ravel(), pa.int64()))}))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        held = sorted(pdf["b"].tolist())
        draws = dealt(int(pdf["code"].iloc[0]), held, list(pdf["counts"].iloc[0]), seed)
        return pd.DataFrame({"s": pdf["s"], "b": pdf["b"], "source_size": pdf["source_size"], "target": pdf["target"], "shards": [draws.get(b, []) for b in pdf["b"].tolist()]})

    plan = coded.join(split, "code").groupBy("code").applyInPandas(deal, "s string, b int, source_size bigint, target double, shards array<int>")
    plan = materialise(plan, "mix-plan")
    shelf.clear()
    joined = sized.join(plan, sized["__source"].eqNullSafe(plan["s"]) & (sized["__block"] == plan["b"]), "left")
    draws = F.transform(plan["shards"], lambda s, i: F.struct(s.alias("shard"), i.alias("copy")))
    return joined.select(*(sized[c] for c in kept), sized["__size"].alias("size"), plan["source_size"], plan["target"], draws.alias("draws"))


def mixed(drawn: DataFrame, columns: list[str], seed: int = 17) -> DataFrame:
    """The mix: a row for each draw, columns then shard, each shard in random order."""
    columns = [c for c in columns if c != "shard"]
    once = drawn.select(*columns, F.explode("draws").alias("__draw"))
    once = once.select(*columns, F.col("__draw.shard").alias("shard"), F.xxhash64(*[F.col(c) for c in columns], F.col("__draw.copy"), F.lit(seed)).alias("__order"))
    # ranges of (shard, order), not shards, are dealt to tasks: a shard may be large
    return once.repartitionByRange("shard", "__order").sortWithinPartitions("shard", "__order").drop("__order")


def counted_back(drawn: DataFrame, mix: DataFrame, by: list[str]) -> DataFrame:
    """A row for each row of ``drawn``: the columns ``by``, which tell rows apart (those that are alike
    in them are taken alike), ``taken``, the words that the rows of ``mix`` have of it, and ``shards``, a
    bit for each shard that has some (of the first 63)."""
    none = F.lit(0).cast("bigint")
    bit = F.expr("shiftleft(1L, least(shard, 62))")
    whole = drawn.select(*by, F.lit(1).cast("bigint").alias("__rows"), none.alias("taken"), none.alias("shards"))
    parts = mix.select(*by, none.alias("__rows"), F.col("size").alias("taken"), bit.alias("shards"))
    each = whole.unionByName(parts).groupBy(*by).agg(F.sum("__rows").alias("__rows"), F.sum("taken").alias("taken"), F.bit_or("shards").alias("shards"))
    each = each.select(*by, F.call_function("div", F.col("taken"), F.col("__rows")).alias("taken"), "shards", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__rows"))).alias("__nth"))
    return each.drop("__nth")

"""Near-duplicate embeddings by sorted projection passes.

Each pass orders the vectors of a group lexicographically by concatenated random
hashes (the signs of projections on random directions), compares every vector with
the bounded window of those before it, and keeps pairs whose cosine, in double
precision, reaches the threshold. The larger a group, the more signs two vectors must
agree in to be within a window, so the number of passes follows from the group's size
(passes_for): of pairs at the threshold at most ``missed`` are never compared. Pairs are
united within a task; what tasks found in all passes is united by contraction
(graph.components).

Direct links are then counted in full within each component: vectors within half
the threshold's angle of the component's mean direction are all linked to each
other, so they are counted, not compared; every other vector is compared with all
of its component in blocks of bounded size. Windows bound only the search for
components, not the counts.

Defined cases: a vector that is null, empty, zero or has null or non-finite parts,
or whose group is null, links with nothing; vectors of different lengths do not
link; equal vectors have cosine 1 and link; rows with equal ids are vectors of
their own; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import arrow_type
from .common import Shelf, bound_batches, join_facts, lean
from .graph import LocalUnion, components

BLOCK = 2048


def directions(dim: int, passes: int, bits: int, seed: int) -> np.ndarray:
    """Random directions, (passes * bits, dim); the same wherever they are made."""
    return np.random.default_rng([seed, dim]).standard_normal((passes * bits, dim))


def passes_for(n: int, threshold: float, least: int, window: int, missed: float) -> int:
    """Passes over a group of n vectors, ``least`` at least: a window holds the vectors that agree
    in the first log2(n / window) signs, which two at the threshold do with a chance of ``agree``."""
    signs = math.log2(max(n / window, 1))
    agree = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** signs
    return max(least, 1 if agree >= 1 else math.ceil(math.log(missed) / math.log1p(-agree)))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _stack(col: pa.Array) -> np.ndarray:
    """Binary column of float64 vectors of one length as rows."""
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(len(col), -1)


def near_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", group: str = "label", threshold: float = 0.93, passes: int = 8, bits: int = 32, window: int = 32, seed: int = 7, missed: float = 0.01) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id of its
    component), kept (whether it is that one). ``passes`` are the fewest of a group."""
    spark = df.sparkSession
    bound_batches(spark)
    base = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(group).alias("grp"), F.col(vector).cast("array<double>").alias("v"))
    ok = F.col("grp").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    kept, shelf = Shelf(), Shelf()
    rows = kept.put(base.select(F.monotonically_increasing_id().alias("row"), "vec_id", "grp", F.when(ok, F.col("v")).alias("v")), "vectors")
    good = rows.where("v is not null")
    grp = rows.schema["grp"].dataType.simpleString()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(bits - 1, -1, -1, dtype=np.int64)).astype(np.float64)
        for b in batches:
            row, g, v, number = b.columns
            number = number.to_numpy()
            flat, lengths = v.flatten().to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy())
            scale = np.maximum.reduceat(np.abs(flat), v.offsets.to_numpy()[:-1] - v.offsets[0].as_py()) if len(flat) else flat
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                start = (np.cumsum(lengths) - lengths)[at]
                u = _unit(flat[start[:, None] + np.arange(dim)] / scale[at, None])
                most = number[at]
                towards = directions(int(dim), int(most.max()), bits, seed).reshape(-1, bits, dim)
                for lo in range(len(towards)):
                    on = np.flatnonzero(most > lo)
                    key = ((u[on] @ towards[lo].T > 0) @ weights).astype(np.int64)
                    take = pa.array(at[on])
                    raw = [x.tobytes() for x in u[on]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), lo, np.int32)), g.take(take), pa.array(np.full(len(on), dim, np.int32)), pa.array(key), row.take(take), pa.array(raw, pa.binary())], names=["pass", "grp", "dim", "key", "row", "u"])

    number = F.udf(lambda n: passes_for(n, threshold, passes, window, missed), "int")
    groups = good.select(F.struct("grp", F.size("v").alias("dim")).alias("group"), "row", "grp", "v")
    numbers = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    numbers = shelf.put(numbers.select("group", number("n").alias("number"), "n"), "numbers")
    sized = join_facts(groups, numbers, "group", "n").select("row", "grp", "v", "number")
    keyed = sized.mapInArrow(lean(keys), f"pass int, grp {grp}, dim int, key bigint, row bigint, u binary")
    found = components(_window_links(keyed, window, threshold, shelf))

    members = found.select(F.col("node").alias("row"), "component").join(good.select("row", "vec_id", "v"), "row")
    members = shelf.put(members, "members")
    named = _count_links(members, threshold, shelf)
    out = rows.select("row", "vec_id").join(kept.put(named, "named"), "row", "left")
    shelf.clear()
    comp = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), comp.alias("component_id"), F.col("vec_id").eqNullSafe(comp).alias("kept"))


ORDER = ["pass", "grp", "dim", "key", "row"]


def _window_links(keyed: DataFrame, window: int, threshold: float, shelf: Shelf) -> DataFrame:
    """(a, b) for vectors of one pass, group and length within a window of each other in the order,
    whose cosine is at least the threshold, united within tasks.

    Each task gives its first and last ``window`` vectors too. A window across the border of two
    tasks, or of more where some have few vectors, lies within those, and they are as near to
    each other among themselves as in the full order; so they are scanned again, in fewer
    tasks, until one is left."""
    given = keyed.schema["grp"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union, seen = LocalUnion(), 0
        head: list[pa.RecordBatch] = []
        tail: pa.RecordBatch | None = None
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                s = b.slice(lo, 2000)
                if seen < window:
                    head.append(_copy(s.slice(0, window - seen)))
                seen += s.num_rows
                part = s if tail is None else pa.Table.from_batches([tail, s]).combine_chunks().to_batches()[0]
                kind = list(zip(*(part.column(k).to_pylist() for k in (0, 1, 2)), strict=True))
                raw, row = part.column(5).to_pylist(), part.column(4).to_numpy()
                code = np.unique([repr(k) for k in kind], return_inverse=True)[1]
                for c in np.unique(code):
                    at = np.flatnonzero(code == c)
                    u = np.frombuffer(b"".join([raw[i] for i in at]), np.float64).reshape(len(at), -1)
                    for d in range(1, min(window, len(at) - 1) + 1):
                        hit = np.flatnonzero(np.einsum("ij,ij->i", u[d:], u[:-d]) >= threshold)
                        for x, y in zip(row[at[hit + d]].tolist(), row[at[hit]].tolist(), strict=True):
                            union.join(x, y)
                tail = _copy(part.slice(max(0, part.num_rows - window)))
        pairs = union.pairs()
        for lo in range(0, len(pairs), 10_000):
            a, b = zip(*pairs[lo : lo + 10_000], strict=True)
            none = [pa.nulls(len(a), f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *none], names=["a", "b", *keyed_names])
        if tail is not None:  # without those that are among the first already
            for end in (*head, tail.slice(max(0, tail.num_rows - max(0, seen - window)))):
                yield pa.RecordBatch.from_arrays([pa.nulls(end.num_rows, pa.int64()), pa.nulls(end.num_rows, pa.int64()), *end.columns], names=["a", "b", *keyed_names])

    keyed_names = keyed.columns
    arrow = list(arrow_type(f"struct<pass:int,grp:{given},dim:int,key:bigint,row:bigint,u:binary>"))
    schema = f"a bigint, b bigint, pass int, grp {given}, dim int, key bigint, row bigint, u binary"
    dealt, tasks, links = keyed.repartitionByRange(*ORDER), int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), None
    while True:
        scanned = shelf.put(dealt.sortWithinPartitions(*ORDER).mapInArrow(lean(scan), schema), "window")
        pairs = scanned.where("a is not null").select("a", "b")
        links = pairs if links is None else links.unionByName(pairs)
        if tasks == 1:
            return links
        tasks = -(-tasks // 256)
        dealt = scanned.where("a is null").select(*keyed_names).repartitionByRange(tasks, *ORDER)


def _copy(b: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of a slice alone, without the batch that they are of."""
    return b.take(pa.array(range(b.num_rows), pa.int32()))


def _count_links(members: DataFrame, threshold: float, shelf: Shelf) -> DataFrame:
    """(row, least, n_links) for members (row, vec_id, component, v): the smallest vec_id of the
    component, and the links, which are within components only."""
    half = math.cos(math.acos(threshold) / 2 - 1e-7)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                comp = b.column(0).to_numpy()[at]
                order = np.argsort(comp, kind="stable")
                u = _unit(_scaled(b.column(1).take(pa.array(at[order]))))
                ids, start, many = np.unique(comp[order], return_index=True, return_counts=True)
                sums = np.add.reduceat(u, start, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([s.tobytes() for s in sums], pa.binary()), pa.array(many)], names=["component", "s", "n"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.sum([np.frombuffer(x) for x in pdf["s"]], axis=0)
        return pd.DataFrame({"component": [pdf["component"].iloc[0]], "mean": [s.tolist()], "n": [pdf["n"].sum()]})

    # sums of each batch first, so that one row for each batch of a component at most is shuffled
    sums = members.select("component", "v").mapInArrow(lean(partial), "component bigint, s binary, n bigint")
    mean = shelf.put(sums.groupBy("component").applyInPandas(total, "component bigint, mean array<double>, n bigint"), "means")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            inner = []
            for v, m in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                m = np.array(m)
                v = np.array(v)
                v = v / np.abs(v).max()
                n = np.sqrt((m * m).sum()) * np.sqrt((v * v).sum())
                inner.append(bool(n > 0 and m @ v / n >= half))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(inner)], names=["row", "component", "v", "inner"])

    known = join_facts(members.select("row", "component", "v"), mean, "component", "n")
    marked = known.select("row", "component", "v", "mean").mapInArrow(lean(mark), "row bigint, component bigint, v array<double>, inner boolean")
    marked = shelf.put(marked.join(members.select("row", "vec_id"), "row"), "marked")
    sizes = marked.groupBy("component").agg(F.count_if("inner").alias("n_inner"), F.count_if(~F.col("inner")).alias("n_outer"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    sizes = shelf.put(sizes.withColumn("rows_of", F.ceil(F.col("n") / BLOCK)).withColumn("outs_of", F.ceil(F.col("n_outer") / BLOCK)), "sizes")
    sized = shelf.put(join_facts(marked, sizes, "component", "n"), "sized")
    # outer vectors against all members, each block of one against each block of the other
    todo = sized.where("n_outer > 0")
    deal = F.pmod(F.xxhash64("row"), F.col("rows_of"))
    left = todo.select("component", deal.alias("x"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("outs_of") - 1)).alias("y"), F.lit(False).alias("query"), "row", "v", "inner")
    right = todo.where("not inner").select("component", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows_of") - 1)).alias("x"), F.pmod(F.xxhash64("row"), F.col("outs_of")).alias("y"), F.lit(True).alias("query"), "row", "v", "inner")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        q, m = pdf[pdf["query"]], pdf[~pdf["query"]]
        if q.empty or m.empty:
            return pd.DataFrame({"row": [], "n": []}).astype("int64")
        unit = lambda d: _unit(_scaled(pa.array(d["v"].map(list).tolist(), pa.list_(pa.float64()))))
        hit = (unit(q) @ unit(m).T >= threshold) & (q["row"].to_numpy()[:, None] != m["row"].to_numpy()[None, :])
        inner = m["inner"].to_numpy().astype(bool)
        return pd.DataFrame({"row": np.concatenate((q["row"], m["row"][inner])), "n": np.concatenate((hit.sum(1), hit[:, inner].sum(0)))}).astype("int64")

    compared = left.unionByName(right).groupBy("component", "x", "y").applyInPandas(compare, "row bigint, n bigint")
    same = sized.select("row", "least", F.when(F.col("inner"), F.col("n_inner") - 1).otherwise(0).cast("bigint").alias("n"))
    none = F.lit(None).cast("bigint").alias("least")
    return same.unionByName(compared.select("row", none, "n")).groupBy("row").agg(F.max("least").alias("least"), F.sum("n").alias("n_links"))


def _scaled(col: pa.Array) -> np.ndarray:
    """Lists of one length as rows, each divided by its largest part, so that no square overflows."""
    v = np.array(col.to_pylist(), np.float64)
    return v / np.abs(v).max(axis=1, keepdims=True)

"""Near-duplicate documents by order MinHash.

A text is its lower-cased words between ASCII white space; its k-mers are runs of
five words (all words, where there are fewer), labelled by occurrence. Each of
``sketches`` random orders samples the ``sample`` smallest labelled k-mers and keeps
them in text order; their hash is a key. Texts that share a key are candidates;
they link where word edit similarity, 1 - edits / words of the longer, is 0.8 or
more, by an alignment inside the band of the edits allowed.

Work follows links, not pairs: exact copies are one class; each key first pairs its
members with its smallest one, and links are united, so that a key whose members are
copies of one text costs one comparison for each. Members of a key that are then
still in different components meet by a prefix filter over all their k-mers, ordered by
full counts; texts that only have a passage in common do not. There too each key pairs
its members with one of them first, in turns, while that unites components; pair by pair
only those of its members are compared that are in different components at the end.

Candidates are complete for k-mer similarity 0.8 but for the chance of sharing none of
24 keys, under 1e-7. Pairs that edits leave with fewer common k-mers, down to edit
similarity 0.8, are mostly found too, by the keys of their smallest member or their
rare parts.

Nodes are numbered in the order of their texts' digests, so reruns agree.

Defined cases: null texts and texts without words link with nothing and are classes
of their own; rows with equal ids are one document if their texts are equal, else
classes that share an id; an empty table gives no rows; texts of any length are
taken whole. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shelf, bound_batches, join_facts, lean
from .graph import components

K, SKETCHES, SAMPLE, SIMILARITY = 5, 24, 3, 0.8
#: Texts that hold a k-mer by which less similar texts are paired too, at most.
OFTEN = 64
#: Turns, at most, in which keys pair their members with one of them before all pairs that are left.
TURNS = 3
#: Texts that a task remembers to have passed on, about.
SEEN = 100_000
#: Texts whose k-mers are counted together before they are added up.
BLOCK = 500
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse to the powers 0 to n - 1, modulo 2**64."""
    if len(_powers[0]) < n:
        more = max(n, 2 * len(_powers[0]))
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(more, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash for each word of the lower-cased text."""
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    gap = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _power(len(b) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1])))
    return mix((total[end] - total[start]) * down[start])


def kmer_hashes(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all runs of k words, labelled by occurrence."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(3) + words[j : j + n])
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if same.any():
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        nth = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        label = np.empty(n, np.uint64)
        label[order] = nth.astype(np.uint64)
        h = np.where(label > 0, mix(h + label * np.uint64(_BASE)), h)
    return h


def order_sketch(kmers: np.ndarray, sketches: int = SKETCHES, sample: int = SAMPLE, seed: int = 5) -> np.ndarray:
    """One key for each sketch: the hash of the sampled k-mers in text order."""
    factor = np.random.default_rng(seed).integers(0, 1 << 63, sketches, np.uint64) * np.uint64(2) + np.uint64(1)
    take = min(sample, len(kmers))
    if take == len(kmers):
        at = np.tile(np.arange(take), (sketches, 1))
    elif len(kmers) * sketches <= 1 << 20:
        at = np.sort(np.argpartition(kmers[None, :] * factor[:, None], take - 1, axis=1)[:, :take], axis=1)
    else:
        at = np.stack([np.sort(np.argpartition(kmers * f, take - 1)[:take]) for f in factor])
    key = mix(np.arange(1, sketches + 1, dtype=np.uint64))
    for j in range(take):
        key = mix(key * np.uint64(5) + kmers[at[:, j]])
    return key


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two word sequences if it is at most ``most``, else None.

    Furthest-reaching alignment: for each number of edits the furthest place on every
    diagonal of the band, extended along equal words."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    # a bound first: words in common, order aside
    u, v = np.sort(a), np.sort(b)
    values, inverse = np.unique(np.concatenate((u, v)), return_inverse=True)
    common = np.minimum(np.bincount(inverse[:n], minlength=len(values)), np.bincount(inverse[n:], minlength=len(values))).sum()
    if max(n, m) - common > most:
        return None
    ends = np.array([0, 1], np.uint64)  # never equal: sequences stop at their ends
    x_of = np.concatenate((a, np.full(33, ends[0])))
    y_of = np.concatenate((b, np.full(33, ends[1])))
    width = np.arange(32)
    far = np.full(2 * most + 3, -(1 << 40), np.int64)  # far[k + most + 1]: place in a on diagonal x - y = k

    def slide(k: np.ndarray, x: np.ndarray) -> np.ndarray:
        live = np.flatnonzero((x >= 0) & (x <= n) & (x - k >= 0) & (x - k <= m))
        while len(live):
            i, j = x[live], x[live] - k[live]
            same = x_of[np.minimum(i[:, None] + width, n + 32)] == y_of[np.minimum(j[:, None] + width, m + 32)]
            run = np.where(same.all(axis=1), 32, np.argmin(same, axis=1))
            run = np.minimum(run, np.minimum(n - i, m - j))
            x[live] += run
            live = live[run == 32]
        return x

    goal = n - m
    for d in range(most + 1):
        lo, hi = max(-d, goal - (most - d)), min(d, goal + (most - d))
        k = np.arange(lo, hi + 1)
        at = k + most + 1
        x = np.zeros(1, np.int64) if d == 0 else np.maximum(np.maximum(far[at] + 1, far[at - 1] + 1), far[at + 1])
        x = np.minimum(x, np.minimum(n, m + k))
        x = slide(k, x)
        far[at] = x
        if lo <= goal <= hi and far[goal + most + 1] >= n:
            return d
    return None


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    longer = max(len(a), len(b))
    return longer > 0 and edits_within(a, b, int((1 - least) * longer + 1e-9)) is not None


def near_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY, k: int = K, sketches: int = SKETCHES, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), class_size
    (rows), kept (whether doc_id is that smallest)."""
    spark = df.sparkSession
    bound_batches(spark)
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).withColumn("digest", F.unhex(F.md5("text")))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Drops copies that the task has seen lately, before texts are moved."""
        seen, old = set(), set()
        for b in batches:
            new = []
            for d in b.column(0).to_pylist():
                new.append(d not in seen and d not in old)
                seen.add(d)
            yield b.filter(pa.array(new, pa.bool_()))
            if len(seen) > SEEN:
                seen, old = set(), seen

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, keys = [], []
            for value in b.column(1).to_pylist():
                words = word_hashes(value)
                size.append(len(words))
                keys.append(order_sketch(kmer_hashes(words, k), sketches, sample).view(np.int64) if len(words) else np.empty(0, np.int64))
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int32()), lists], names=["digest", "words", "keys"])

    shelf, kept = Shelf(), Shelf()
    # texts are moved once, and read where they are from then on
    texts = docs.where("digest is not null").select("digest", "text").mapInArrow(lean(once), "digest binary, text string")
    texts = shelf.bucketed(texts, "digest", "texts")
    rows = kept.put(docs.select("doc_id", "digest"), "digests")
    # exact copies are one class: (node, digest, first doc_id, copies, words, keys)
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    sketched = texts.mapInArrow(lean(sketch), "digest binary, words int, keys array<bigint>").where("words > 0")
    sketched = shelf.put(sketched, "sketches").groupBy("digest").agg(F.any_value("words").alias("words"), F.any_value("keys").alias("keys"))
    classes = numbered(copies.join(sketched, "digest"), "digest", "node", shelf)
    keyed = classes.select("node", "words", F.explode("keys").alias("key"))
    lead = keyed.groupBy("key").agg(F.min(F.struct("node", "words")).alias("lead"), F.max("node").alias("last")).where("lead.node <> last").select("key", "lead")
    shared = shelf.put(keyed.join(lead, "key").select("key", "node", "words", "lead"), "shared")
    near_size = lambda x, y: F.least(x, y) >= F.greatest(x, y) * (least - 1e-9)
    stars = shared.where((F.col("node") != F.col("lead.node")) & near_size(F.col("words"), F.col("lead.words"))).select(F.col("node").alias("a"), F.col("lead.node").alias("b")).distinct()
    first = _verify(shelf.put(stars, "stars"), classes, texts, least, shelf)
    found = components(first)

    # members of a key in different components yet: compared where they can be similar
    labels = found.select("node", "component")
    left = shared.select("key", "node", "words").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = left.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    rest = shelf.put(left.join(mixed, "key").select("node", "words", "component").distinct(), "mixed")
    second = _close_links(rest, classes, texts, k, least, sketches, shelf)
    final = components(first.unionByName(second))
    named = shelf.put(classes.join(final, "node", "left").select("digest", "copies", "first", F.coalesce("component", "node").alias("component")), "named")
    sizes = named.groupBy("component").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("members"))
    sizes = shelf.put(sizes, "sizes")
    by_text = join_facts(named.select("digest", "component", "copies"), sizes, "component", "members").select("digest", "class_id", "class_size", "copies")
    by_text = kept.put(by_text, "by-text")
    known = join_facts(rows, by_text, "digest", "copies", "left")
    shelf.clear()
    class_id = F.coalesce("class_id", "doc_id")
    return known.select("doc_id", class_id.alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"), F.col("doc_id").eqNullSafe(class_id).alias("kept"))


def numbered(df: DataFrame, by: str, out: str, shelf: Shelf) -> DataFrame:
    """df with the place of each row in the order of ``by``, whose values differ, from 0: the same
    whatever the partitions. A row for each partition comes to the driver."""
    placed = df.repartitionByRange(by).sortWithinPartitions(by).select(F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__at"), "*")
    placed = shelf.put(placed, "numbered")
    many = sorted((r[0], r[1] + 1) for r in placed.groupBy("__part").agg(F.max("__at")).collect())
    before, total = [], 0
    for part, n in many:
        before.append((part, total))
        total += n
    start = df.sparkSession.createDataFrame(before, "__part int, __before bigint")
    return placed.join(F.broadcast(start), "__part").select((F.col("__before") + F.col("__at")).alias(out), *df.columns)


def _texts(nodes: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text); the nodes move, the texts do not."""
    return texts.join(nodes.join(classes.select("node", "digest"), "node"), "digest").dropDuplicates(["digest"]).select("node", "text")


def prefix_size(n: int, alone: int, least: float) -> int:
    """How many of the k-mers that other texts hold too, rarest first, a text of ``n`` k-mers,
    ``alone`` of them its own, must give as keys: two texts of similarity ``least`` have
    ``least * n`` in common, so they meet in one of these."""
    return max(0, n - alone - math.ceil(least * n - 1e-9) + 1)


def _close_links(rest: DataFrame, classes: DataFrame, texts: DataFrame, k: int, least: float, sketches: int, shelf: Shelf) -> DataFrame:
    """Links (a, b) that unite all components of nodes (node, words, component) between which one
    of the pairs that share a key of _close_keys is similar.

    In a turn each key pairs its members with one of them: first with the one that has the
    fewest k-mers of its own, which is near the middle of a group of copies, then with any. Pairs
    within a component are left out from then on, so a group of copies costs some comparisons
    for each member and key. When a turn unites nothing, or after TURNS, all pairs of a key that
    are still in different components are compared."""
    now = shelf.put(_close_keys(rest, classes, texts, k, least, sketches, shelf), "close")
    seqs = _words(rest.select("node"), classes, texts, shelf)
    links, tried = [], []
    for turn in range(TURNS):
        first = F.col("own") / F.col("n") if turn == 0 else F.xxhash64("key", "node", F.lit(turn))
        lead = now.groupBy("key").agg(F.min(F.struct(first.alias("first"), *now.columns)).alias("q"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        lead = shelf.put(lead.where("lo <> hi").select("q.*").drop("first"), "lead")
        now = shelf.put(now.join(lead.select("key"), "key", "left_semi"), "mixed-keys")
        p, q = now.alias("p"), lead.alias("q")
        stars = _may_link(p.join(q, (F.col("p.key") == F.col("q.key")) & _apart(least)), tried)
        tried.append(shelf.put(stars, "turn"))
        new = _similar(tried[-1], seqs, least, shelf)
        links.append(new)
        if new.isEmpty():
            break
        of = now.select("node", "component").distinct()
        ends = new.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b")
        united = components(ends, "ca", "cb").toDF("component", "united")
        now = now.join(united, "component", "left").withColumn("component", F.coalesce("united", "component")).select(*now.columns)
        now = shelf.put(now, "united")
    p, q = now.alias("p"), now.alias("q")
    pairs = _may_link(p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.node") > F.col("q.node")) & _apart(least)), tried)
    links.append(_similar(shelf.put(pairs, "rest"), seqs, least, shelf))
    return reduce(DataFrame.unionByName, links)


def _apart(least: float) -> Column:
    """Whether p and q, rows of _close_keys with the same key, are in different components and may be similar."""
    sizes = F.least("p.words", "q.words") >= F.greatest("p.words", "q.words") * (least - 1e-9)
    # k-mers that two texts can have in common at most, by the places where they meet
    common = F.least("p.place", "q.place") + F.least(F.col("p.n") - F.col("p.place"), F.col("q.n") - F.col("q.place"))
    by_place = (F.col("p.place") < 0) | (common >= (F.col("p.n") + F.col("q.n")) * (least / (1 + least)) - 1e-6)
    return (F.col("p.component") != F.col("q.component")) & sizes & by_place


def _may_link(joined: DataFrame, tried: list[DataFrame]) -> DataFrame:
    """The different pairs (a, b), a > b, of joined rows p and q that were not compared yet."""
    pairs = joined.select(F.greatest("p.node", "q.node").alias("a"), F.least("p.node", "q.node").alias("b")).distinct()
    return reduce(lambda x, y: x.join(y, ["a", "b"], "left_anti"), tried, pairs)


def _close_keys(rest: DataFrame, classes: DataFrame, texts: DataFrame, k: int, least: float, sketches: int, shelf: Shelf) -> DataFrame:
    """Keys by which nodes (node, words, component) meet that may be similar, with the number n of
    k-mers of the node, how many of them are its own, and the place of the key (or -1) among them.

    All pairs of k-mer similarity ``least`` are there: k-mers are ordered by the number of
    texts here that hold them, counted in full, and a pair meets in a prefix of that order
    (prefix filter, with filters by size and position). Texts that only have a common
    passage meet where it fills ``least`` of them.

    Less similar pairs, that edits leave with fewer common k-mers, meet where they agree in
    one of ``sketches`` smallest k-mers of those that at most OFTEN texts hold; where nearly
    nothing else is left of a text, of all its k-mers too."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = [kmer_hashes(word_hashes(t or ""), k).view(np.int64) for t in b.column(1).to_pylist()]
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in seqs]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*seqs, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["node", "kmers"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                s = b.slice(lo, BLOCK)
                one = [pa.ListArray.from_arrays(pa.array([0, s.num_rows], pa.int32()), c) for c in s.columns]
                yield pa.RecordBatch.from_arrays([pa.array([block]), *one], names=["block", "node", "words", "component", "kmers"])
                block += 1

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, whole in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                value, count = np.unique(whole.values.flatten().to_numpy(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), block)), pa.array(value), pa.array(count)], names=["block", "kmer", "n"])

    kmers = _texts(rest.select("node"), classes, texts).mapInArrow(lean(hashes), "node bigint, kmers array<bigint>")
    kmers = kmers.join(rest, "node").select("node", "words", "component", "kmers")
    blocks = shelf.put(kmers.mapInArrow(lean(pack), "block bigint, node array<bigint>, words array<int>, component array<bigint>, kmers array<array<bigint>>"), "kmers")
    # texts that hold a k-mer, counted within blocks of texts first: a row for each block, not for each text
    each = blocks.select("block", "kmers").mapInArrow(lean(tally), "block bigint, kmer bigint, n bigint")
    held = each.groupBy("kmer").agg(F.sum("n").alias("held")).where("held > 1")
    known = each.join(held, "kmer").groupBy("block").agg(F.collect_list("kmer").alias("kmer"), F.collect_list("held").alias("held"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                node, words, component, whole, kmer, held = (c[i].values for c in b.columns[1:])
                value, count = kmer.to_numpy().view(np.uint64), held.to_numpy()
                order = np.argsort(value)
                value, count = value[order], count[order]
                row, key, place, size, own = [], [], [], [], []
                for j, text in enumerate(whole):
                    all_of = text.values.to_numpy().view(np.uint64)
                    at = np.minimum(np.searchsorted(value, all_of), max(0, len(value) - 1))
                    d = np.where(value[at] == all_of, count[at], 1) if len(value) else np.ones(len(all_of), np.int64)
                    order = np.lexsort((all_of, d))
                    n, alone = len(all_of), int((d == 1).sum())
                    rare = all_of[d <= OFTEN]
                    keys = [all_of[order[alone:]][: prefix_size(n, alone, least)]]
                    keys += [order_sketch(x, sketches, 1) for x in ((rare,) if len(rare) * 20 > n else (rare, all_of)) if len(x)]
                    key += keys
                    place += [alone + np.arange(len(keys[0])), np.full(sum(map(len, keys[1:])), -1)]
                    row.append(np.full(sum(map(len, keys)), j))
                    size.append(n)
                    own.append(alone)
                take = np.concatenate(row)
                cols = [*(c.take(pa.array(take)) for c in (node, words, component)), *(pa.array(np.array(x, np.int32)[take]) for x in (size, own)), pa.array(np.concatenate(place).astype(np.int32)), pa.array(np.concatenate(key).view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "words", "component", "n", "own", "place", "key"])

    chosen = blocks.join(known, "block").select("block", "node", "words", "component", "kmers", "kmer", "held")
    return chosen.mapInArrow(lean(choose), "node bigint, words int, component bigint, n int, own int, place int, key bigint").distinct()


def _verify(pairs: DataFrame, classes: DataFrame, texts: DataFrame, least: float, shelf: Shelf) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar; a written table."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    return _similar(pairs, _words(nodes, classes, texts, shelf), least, shelf)


def _words(nodes: DataFrame, classes: DataFrame, texts: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, seq), the hashes of the words of each node's text; a written table."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = [word_hashes(t or "").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(seqs, pa.binary())], names=["node", "seq"])

    return shelf.put(_texts(nodes, classes, texts).mapInArrow(lean(hashes), "node bigint, seq binary"), "words")


def _similar(pairs: DataFrame, seqs: DataFrame, least: float, shelf: Shelf) -> DataFrame:
    """The pairs (a, b) of nodes whose words are similar; a written table."""
    joined = pairs.join(seqs.select(F.col("node").alias("a"), F.col("seq").alias("sa")), "a").join(seqs.select(F.col("node").alias("b"), F.col("seq").alias("sb")), "b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return shelf.put(joined.select("a", "b", "sa", "sb").mapInArrow(lean(keep), "a bigint, b bigint"), "similar")

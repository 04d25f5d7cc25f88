"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad. Its features, and those of the lines
before and after it, are numbers of the line (shares of letters, capitals, signs,
signs in runs, ...) cut into bins; weights for bins and for pairs of neighbouring
labels are trained in numpy by gradient ascent on the likelihood of labelled
documents, whose lines all have the label of the document. That likelihood counts texts
alike whatever their number of lines, and both labels alike. Forward-backward gives
each line's marginal; their mean weighted by length, through a logistic curve
fitted on training documents kept apart, is the score.

Training takes a bounded sample of labelled documents: of each label those that come
first by a hash of their id, whole, ``PER_LABEL`` of them at most, and none after
``LABEL_BYTES`` of them; of documents with the same id the least text. Scoring takes every
row and whole texts.

Defined cases: a null or empty text is one empty line; equal texts get equal scores;
without labelled rows of both labels every score is the share of label 1, or 0.5; an
empty table gives no rows; lines and texts of any length are taken whole. The column
added takes the place of one of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, lean
from .order_minhash import _power, mix

PER_LABEL, LABEL_BYTES = 1500, 24 << 20
BINS = 8
#: Bytes handled at once when features of many texts are made.
CHUNK = 256 << 10

# Classes of bytes: 0 space, 1 lower-case letter, 2 capital, 3 digit, 4 full stop and comma,
# 5 exclamation and question mark, 6 bar, 7 other sign, 8 first byte of a longer character, 9 its other bytes.
_CLASS = np.full(256, 7, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[44, 46]], _CLASS[[33, 63]], _CLASS[124] = 4, 5, 6
_CLASS[192:], _CLASS[128:192] = 8, 9
N_FEATURES = 15


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, N_FEATURES) numbers, length of each line in characters, number of lines of each text."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    size = np.array([len(t) + 1 for t in texts])
    text_end = np.cumsum(size)
    stop = np.flatnonzero(data == 10)
    start = np.concatenate(([0], stop[:-1] + 1))
    lines = len(stop)
    of_text = np.searchsorted(text_end, stop, side="right")
    line = np.repeat(np.arange(lines), stop - start + 1)
    kind = _CLASS[data]
    count = np.bincount(line.astype(np.int64) * 10 + kind, minlength=10 * lines).reshape(lines, 10).astype(np.float64)
    count[:, 0] -= 1  # the line end itself
    chars = count[:, :9].sum(axis=1)
    letters = count[:, 1] + count[:, 2] + count[:, 8]
    signs = count[:, 5:8].sum(axis=1)
    gap = kind == 0
    first = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    last = np.flatnonzero(~gap & np.concatenate((gap[1:], [True])))
    words = np.bincount(line[first], minlength=lines)
    long = last - first + 1
    short = np.bincount(line[first[long <= 3]], minlength=lines)
    with_sign = np.bincount(line[last[(kind[last] >= 5) & (kind[last] <= 7)]], minlength=lines)
    run = (data[1:] == data[:-1]) & (kind[1:] >= 3) & (kind[1:] <= 7)
    runs = np.bincount(line[1:][run], minlength=lines)
    final = np.where(stop > start, kind[np.maximum(stop - 1, 0)], 0)
    begin = kind[start]
    # words and lines that their text has had before
    up, down = _power(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])))
    again = _seen(mix((total[stop] - total[start]) * down[start]), of_text)
    h = mix((total[last + 1] - total[first]) * down[first])
    doc = of_text[line[first]]
    three = mix(h[2:] * np.uint64(3) + mix(h[1:-1] * np.uint64(3) + h[:-2])) if len(h) > 2 else h[:0]
    told = np.bincount(line[first[2:]][_seen(three, doc[2:])], minlength=lines) if len(h) > 2 else np.zeros(lines)
    n, w = np.maximum(chars, 1), np.maximum(words, 1)
    out = np.stack([
        np.log1p(chars), np.log1p(words), letters / n, count[:, 2] / np.maximum(letters, 1), count[:, 3] / n, count[:, 4] / w, count[:, 5] / w,
        count[:, 6] / w, signs / n, runs / n, (chars - count[:, 0]) / w, short / w, with_sign / w, again.astype(np.float64) * (words > 0), told / w,
    ], axis=1)
    out[:, 2] += (final == 4) * 2.0 + (begin == 2) * 4.0  # ends as a sentence, begins as one: bins of their own
    return out, chars, np.bincount(of_text, minlength=len(texts))


def chunked_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line_features of any number of texts, CHUNK bytes at a time."""
    parts = [line_features(texts[lo:hi]) for lo, hi in _chunks(texts)]
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.empty((0, N_FEATURES)), np.empty(0), np.empty(0, np.int64))


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of CHUNK bytes together, or one longer text."""
    lo = 0
    while lo < len(texts):
        hi, held = lo, 0
        while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= CHUNK):
            held += len(texts[hi]) + 1
            hi += 1
        yield lo, hi
        lo = hi


def _seen(h: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether the same value came before in its group."""
    order = np.lexsort((h, group))
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        o = order
        same[o[1:]] = (h[o[1:]] == h[o[:-1]]) & (group[o[1:]] == group[o[:-1]])
    return same


@dataclass
class QualityModel:
    edges: np.ndarray  # (N_FEATURES, BINS - 1)
    weight: np.ndarray  # (3, N_FEATURES, BINS): previous, own, next line; for good against bad
    pair: np.ndarray  # (2, 2): label of a line, of the next
    bias: float
    curve: tuple[float, float]
    rate: float

    def bins(self, features: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, features[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)

    def unary(self, bins: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Score of good against bad for each line."""
        k = np.arange(N_FEATURES)
        own, before, after = (self.weight[j][k, bins].sum(axis=1) for j in (1, 0, 2))
        first = np.cumsum(per_text) - per_text
        inner = np.ones(len(bins), bool)
        inner[first[per_text > 0]] = False
        out = own + self.bias
        out[inner] += before[np.flatnonzero(inner) - 1]
        tail = np.flatnonzero(inner) - 1
        out[tail] += after[tail + 1]
        return out

    def marginals(self, unary: np.ndarray, per_text: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of every line, expected pairs of labels, log partition of every text."""
        return forward_backward(unary, per_text, self.pair, weight)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.edges):
            return np.full(len(texts), self.rate)
        features, chars, per_text = line_features(texts)
        good = self.marginals(self.unary(self.bins(features), per_text), per_text)[0]
        return self._curved(_weighted(good, chars, per_text))

    def _curved(self, mean: np.ndarray) -> np.ndarray:
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.curve[0] * np.log(mean / (1 - mean)) + self.curve[1])))


def _weighted(good: np.ndarray, chars: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Mean of the marginals of each text, weighted by length (an empty line counts a little)."""
    first = np.cumsum(per_text) - per_text
    w = chars + 1e-3
    return np.add.reduceat(good * w, first) / np.add.reduceat(w, first)


def forward_backward(unary: np.ndarray, per_text: np.ndarray, pair: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For chains of lines of all texts at once; every text has a line at least. Texts are
    taken in descending order of their number of lines, so that those still going are the first.
    Expected pairs of labels are summed over texts with ``weight``, 1 each without it."""
    order = np.argsort(-per_text, kind="stable")
    first = (np.cumsum(per_text) - per_text)[order]
    many = per_text[order]
    live = [int(np.searchsorted(-many, -t, side="left")) for t in range(int(many[0]))] if len(many) else []
    u = np.stack((np.zeros_like(unary), unary), axis=1)
    top = u.max(axis=1, keepdims=True)
    e, move = np.exp(u - top), np.exp(pair)
    alpha, scale = np.empty_like(e), np.empty(len(unary))
    for t, n in enumerate(live):
        at = first[:n] + t
        a = e[at] if t == 0 else (alpha[at - 1] @ move) * e[at]
        scale[at] = a.sum(axis=1)
        alpha[at] = a / scale[at, None]
    beta = np.ones_like(e)
    pairs = np.zeros((2, 2))
    weight = np.ones(len(order)) if weight is None else weight[order]
    for t in range(len(live) - 1, 0, -1):
        at = first[: live[t]] + t
        back = e[at] * beta[at] / scale[at, None]
        beta[at - 1] = back @ move.T
        pairs += np.einsum("n,ni,nj->ij", weight[: live[t]], alpha[at - 1], back) * move
    good = alpha * beta
    good = good[:, 1] / good.sum(axis=1)
    log_z = np.add.reduceat(np.log(scale) + top[:, 0], np.cumsum(per_text) - per_text) if len(per_text) else np.empty(0)
    return good, pairs, log_z


def train(texts: list[bytes], labels: list[int], prior: float | None = None, epochs: int = 120, rate: float = 0.08, penalty: float = 1e-3, apart: float = 0.25, seed: int = 3) -> QualityModel:
    """Fit a model. prior: share of label 1 among all labelled rows, if the sample's differs."""
    y = np.array(labels, np.int64)
    rate_of_good = prior if prior is not None else float(y.mean()) if len(y) else 0.5
    if len(set(labels)) < 2:
        return QualityModel(np.empty((0, 0)), np.empty((3, 0, 0)), np.zeros((2, 2)), 0.0, (1.0, 0.0), rate_of_good)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held, fit = order[: int(apart * len(order))], order[int(apart * len(order)) :]
    features, _, per_text = chunked_features([texts[i] for i in fit])
    edges = np.stack([np.quantile(features[:, k], np.linspace(0, 1, BINS + 1)[1:-1]) for k in range(N_FEATURES)])
    model = QualityModel(edges, np.zeros((3, N_FEATURES, BINS)), np.zeros((2, 2)), 0.0, (1.0, 0.0), rate_of_good)
    bins = model.bins(features)
    gold = np.repeat(y[fit], per_text).astype(np.float64)
    # texts count alike whatever their number of lines, and so do both labels
    weight = (1.0 / np.maximum(per_text, 1)) * np.where(y[fit] == 1, 0.5 / max(1e-9, (y[fit] == 1).mean()), 0.5 / max(1e-9, (y[fit] == 0).mean()))
    line_weight = np.repeat(weight, per_text)
    first = np.cumsum(per_text) - per_text
    inner = np.ones(len(bins), bool)
    inner[first] = False
    inside = np.flatnonzero(inner)
    flat = np.arange(N_FEATURES) * BINS + bins
    gold_pairs = np.zeros((2, 2))
    for a in (0, 1):
        gold_pairs[a, a] = (weight * (per_text - 1))[y[fit] == a].sum()
    m = [np.zeros_like(model.weight), np.zeros((2, 2)), 0.0]
    v = [np.zeros_like(model.weight), np.zeros((2, 2)), 0.0]
    for step in range(1, epochs + 1):
        good, pairs, _ = model.marginals(model.unary(bins, per_text), per_text, weight)
        r = (gold - good) * line_weight
        g = np.zeros_like(model.weight)
        tally = lambda at, to: np.bincount(flat[at].ravel(), np.repeat(r[to], N_FEATURES), N_FEATURES * BINS).reshape(N_FEATURES, BINS)
        g[1] = tally(np.arange(len(bins)), np.arange(len(bins)))
        g[0] = tally(inside - 1, inside)
        g[2] = tally(inside, inside - 1)
        n = len(fit)
        grads = [g / n - penalty * model.weight, (gold_pairs - pairs) / n - penalty * model.pair, float(r.sum()) / n]
        for k, grad in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad**2
            move = rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            if k == 0:
                model.weight = model.weight + move
            elif k == 1:
                model.pair = model.pair + move
            else:
                model.bias += float(move)
    held = held if len(held) else fit
    features, chars, per_text = chunked_features([texts[i] for i in held])
    mean = np.clip(_weighted(model.marginals(model.unary(model.bins(features), per_text), per_text)[0], chars, per_text), 1e-6, 1 - 1e-6)
    slope, offset = _logistic(np.log(mean / (1 - mean)), y[held])
    odds = lambda p: np.log(p / (1 - p))
    model.curve = slope, offset + float(odds(np.clip(rate_of_good, 0.01, 0.99)) - odds(y.mean()))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0.05) and offset of a logistic curve, by Newton's method, with smoothed targets."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        d = p - target
        hess = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, [(d * x).sum() + 1e-3 * (a - 1), d.sum()])
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    return max(0.05, float(a)), float(b)


def labelled_sample(docs: DataFrame, labels: DataFrame, use: Column, label: str = "quality", per_label: int = PER_LABEL, most_bytes: int = LABEL_BYTES) -> tuple[list[tuple[bytes, int]], float]:
    """(text, label) of the first documents of each label (0, 1) by a hash of their id, per_label at most, until
    they have most_bytes together; and the share of label 1 among all. Ids first, of which there are 2 * per_label;
    then their texts. An id with both labels counts with the smaller."""
    spot = F.xxhash64("doc_id", F.lit(0))
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & use).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y"))
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    first = [known.where(F.col("y") == y).distinct().select("doc_id", "y", spot.alias("spot")).orderBy("spot", "doc_id").limit(per_label) for y in sorted(counts)]
    if not first:
        return [], prior
    wanted = first[0] if len(first) == 1 else first[0].unionByName(first[1])
    wanted = wanted.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("spot").alias("spot"))  # 2 * per_label rows at most
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(wanted), "doc_id")
    rows = rows.groupBy("y", "spot", "doc_id").agg(F.min("text").alias("text"))
    w = Window.partitionBy("y").orderBy("spot", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.octet_length("text").cast("long")).over(w), F.lit(0))).where(F.col("before") < most_bytes)
    got = sorted((r["doc_id"], bytes(r["text"]), r["y"]) for r in rows.select("doc_id", F.col("text").cast("binary").alias("text"), "y").collect())
    return [(t, y) for _, t, y in got], prior


def score_quality(df: DataFrame, model: QualityModel, text: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """The columns ``keep`` (all if None), then the score, 0 to 1, higher for better texts."""
    bound_batches(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c != out]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(b.num_columns - 1).to_pylist()]
            scores = [model.score(texts[lo:hi]) for lo, hi in _chunks(texts)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate([*scores, np.empty(0)]), pa.float64())], names=schema.names)

    return df.select(*keep, F.col(text).cast("binary").alias("__text")).mapInArrow(lean(run), schema)

"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its subwords, the 1- to 4-grams of its
letter runs with their borders, hashed into a fixed number of rows; a linear layer
and a softmax give the languages. Both are trained together by stochastic gradient
descent in numpy. For prediction the two are folded into one table of a row of
scores for each bucket, so a whole text costs one lookup for each subword.

The temperature of the softmax and the rejection level are fitted on a part of the
training rows kept apart: the lowest probability with which predictions there are
right at the wished rate. A rejected prediction has ``accepted`` false. Texts with the
same smallest subword hash, as near copies have mostly, are on the same side.

Training takes a bounded sample of labelled rows: of each language, of all languages,
the different texts that come first by their hash, whole, ``per_label`` of them at most,
and none after ``most_bytes`` of them. Prediction takes every row and whole texts.

Defined cases: null texts and texts without a letter give ``und`` with score 0, not
accepted; equal texts give equal results; with no labelled row everything is
``und``; an empty table gives no rows. Columns added take the place of columns of
the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, lean

BUCKETS, WIDTH, LONGEST = 1 << 16, 16, 4
UNKNOWN = "und"
#: Lower-case letters by code point up to the end of the basic plane; others are asked one by one.
_lower: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, 0 where it is no letter."""
    if not _lower:
        table = np.zeros(1 << 16, np.uint32)
        for c in range(1 << 16):
            if (s := chr(c)).isalpha():
                table[c] = ord(low) if len(low := s.lower()) == 1 else c
        _lower.append(table)
    return _lower[0]


def subwords(text: str) -> np.ndarray:
    """Buckets of all subwords of the text, in no order that matters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _letters()
    low = table[np.minimum(points, 0xFFFF)]
    if len(points) and points.max() > 0xFFFF:
        for i in np.flatnonzero(points > 0xFFFF):
            low[i] = ord(chr(points[i]).lower()) if chr(points[i]).isalpha() else 0
    inside = low > 0
    if not inside.any():
        return np.empty(0, np.int64)
    # one border mark, 0, between runs of letters and at both ends
    keep = inside | np.concatenate(([False], inside[:-1]))
    s = np.concatenate((np.zeros(1, np.uint32), low[keep], np.zeros(1, np.uint32))).astype(np.uint64)
    letter = s > 0
    out = []
    h = np.zeros(len(s), np.uint64)
    for n in range(1, LONGEST + 1):
        m = len(s) - n + 1
        if m <= 0:
            break
        h = (h[:m] * np.uint64(0x100000001B3)) ^ (s[n - 1 :] + np.uint64(1))
        inner = np.ones(m, bool)  # a border may only be the first or the last mark of a subword
        for j in range(1, n - 1):
            inner &= letter[j : j + m]
        some = letter[:m].copy()
        for j in range(1, n):
            some |= letter[j : j + m]
        mixed = h ^ (h >> np.uint64(29))
        mixed = mixed * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
        out.append((mixed[inner & some] >> np.uint64(48)).astype(np.int64))
    return np.concatenate(out)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages), float32: embeddings times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    level: float = 0.0

    def logits(self, text: str) -> np.ndarray | None:
        at = subwords(text)
        if not len(at):
            return None
        count = np.bincount(at, minlength=BUCKETS) if len(at) > BUCKETS else None
        total = count @ self.table if count is not None else self.table[at].sum(axis=0, dtype=np.float64)
        return total / len(at) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        z = self.logits(text) if text and self.languages else None
        if z is None:
            return UNKNOWN, 0.0, False
        p = np.exp((z - z.max()) / self.temperature)
        p /= p.sum()
        k = int(np.argmax(p))
        return self.languages[k], float(p[k]), bool(p[k] >= self.level)


def train(texts: list[str], labels: list[str], steps: int = 16_000, rate: float = 0.5, apart: float = 0.2, right: float = 0.99, seed: int = 11) -> LanguageModel:
    """Fit a model with about ``steps`` steps of a text each, all texts equally often; ``apart``
    of the rows, the last by their smallest subword hash, set temperature and level."""
    rows = []
    for t, y in zip(texts, labels, strict=True):
        if len(s := subwords(t or "")):
            at, count = np.unique(s, return_counts=True)
            rows.append((at, count / len(s), y))
    languages = sorted({y for *_, y in rows})
    if not rows:
        return LanguageModel([], np.zeros((1, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    side = rng.permutation(BUCKETS)  # a minimum over this order is shared by texts with mostly the same subwords
    order = sorted(range(len(rows)), key=lambda i: int(side[rows[i][0]].min()))
    cut = max(1, len(rows) - int(apart * len(rows)))
    fit, held = [rows[i] for i in order[:cut]], [rows[i] for i in order[cut:]]
    embed = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    weight, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    code = {y: k for k, y in enumerate(languages)}
    epochs, done = -(-steps // len(fit)), 0
    steps = epochs * len(fit)
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            at, share, y = fit[i]
            hidden = share @ embed[at]
            z = hidden @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[code[y]] -= 1
            step = rate * (1 - done / steps)
            back = weight @ p
            weight -= step * np.outer(hidden, p)
            bias -= step * p
            embed[at] -= np.outer(share / np.sqrt(share @ share), step * back)  # short and long texts move their subwords alike
            done += 1
    model = LanguageModel(languages, (embed @ weight).astype(np.float32), bias)
    if held:
        z = np.stack([share @ model.table[at] + bias for at, share, _ in held])
        y = np.array([code[y] for *_, y in held])

        doubt = 1 / (len(y) + 2)  # weight of the other languages, so that a faultless part gives no certainty

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
            return -float((1 - doubt) * s[np.arange(len(y)), y].mean() + doubt * s.mean())

        model.temperature = min(np.geomspace(0.02, 20, 80), key=loss)
        p = np.exp((z - z.max(axis=1, keepdims=True)) / model.temperature)
        p /= p.sum(axis=1, keepdims=True)
        best, ok = p.max(axis=1), p.argmax(axis=1) == y
        falling = np.argsort(-best)
        good = np.cumsum(ok[falling]) / np.arange(1, len(y) + 1) >= right
        model.level = float(best[falling][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return model


def training_sample(df: DataFrame, text: str, label: str, per_label: int, most_bytes: int = 4 << 20) -> list[tuple[str, str]]:
    """(place, text, label) of the first different texts of each label by a hash of the text, per_label at
    most, until they have most_bytes together. Counts first, over narrow columns; then only rows under twice
    their label's share of the hash range are looked at, copies once."""
    span = 1 << 32
    spot = F.pmod(F.xxhash64(text), F.lit(span))
    labelled = df.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"), spot.alias("spot"))
    share = labelled.groupBy("label").agg(F.least(F.lit(span), F.floor(F.lit(float(2 * span * per_label)) / F.approx_count_distinct("spot", 0.02))).alias("share"))
    few = labelled.join(F.broadcast(share), "label").where("spot < share").groupBy("label", "spot").agg(F.min("text").alias("text"))
    w = Window.partitionBy("label").orderBy("spot", "text")
    few = few.select("label", "spot", "text", F.row_number().over(w).alias("nth"), F.sum(F.octet_length("text").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    rows = few.where((F.col("nth") <= per_label) & (F.coalesce("before", F.lit(0)) < most_bytes)).select("spot", "text", "label").collect()
    return sorted(map(tuple, rows))


def detect_language(df: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but text if None), then lang_pred, score (calibrated
    probability) and accepted."""
    bound_batches(df.sparkSession)
    keep = [c for c in df.columns if c != text] if keep is None else keep
    keep = [c for c in keep if c not in ("lang_pred", "score", "accepted")]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS * languages floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            got = [model.predict(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], names=schema.names)

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(lean(run), schema)

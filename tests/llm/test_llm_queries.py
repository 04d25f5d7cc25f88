"""The registered queries and the pipeline on the smallest tables, against the library,
SQL or brute force."""

import glob
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as e
import corpus_pipeline
from foliant.llm import crf, langid, mixing, op6, op9, op10, order_minhash, projections, pseudonyms, tiff
from foliant.llm.queries import ORACLE_SQL, QUERIES

from plain_pseudonyms import Plain, luhn

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return {r[0]: r[1] for r in duck.sql("SELECT doc_id, text FROM documents").fetchall()}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))
    assert set(QUERIES) | {"pipeline"} <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DIR), duck.sql(ORACLE_SQL[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, want.select(*cols).fetchall()))


def plain_feature(payload):
    """Pages, rows, sum and squares of samples, and each page's 8 x 8 grid, cell by cell."""
    rows = [payload[i : i + 192] for i in range(0, len(payload), 192)]
    hashes = []
    for top in range(0, len(rows), 4096):
        page = rows[top : top + 4096]
        n, mean, bits = len(page), sum(map(sum, page)) / (len(page) * 64), ""
        for i in range(8):
            for j in range(8):
                cell = [page[y][3 * x : 3 * x + 3] for y in range(i * n // 8, (i + 1) * n // 8) for x in range(j * 8, j * 8 + 8)]
                bits += "01"[bool(cell) and sum(map(sum, cell)) / len(cell) > mean]
        hashes.append(f"{int(bits, 2):016x}")
    return f"{len(hashes)}:{len(rows)}:{sum(payload)}:{sum(b * b for b in payload)}:{','.join(hashes)}"


def test_op1(spark, docs):
    rows = QUERIES["op1_tiff"](spark, DIR).collect()
    assert len(rows) == len(docs)
    same, layouts = {}, set()
    stored = tiff.store_tiff(spark.createDataFrame([(k, bytearray((t or "").encode())) for k, t in docs.items()], "doc_id long, payload binary"), "payload", layouts=tiff.EVERY)
    media = {r.doc_id: bytes(r.media) for r in stored.collect()}
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        payload = raw + b" " * (192 - len(raw) if len(raw) < 192 else -len(raw) % 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])) and r.tiff_error is None
        assert r.feature == plain_feature(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media[r.doc_id]), hashlib.sha256(media[r.doc_id]).hexdigest())
        assert same.setdefault(raw, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
        (tags, *_) = tiff.walk_directories(media[r.doc_id])
        layouts.add((tags[tiff.COMPRESSION][0], tags[tiff.PREDICTOR][0], tiff.TILE_OFFSETS in tags))
    assert len(layouts) >= 18  # of 20


def test_op4(spark, docs, library):
    got, at = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op4_simple8b"](spark, DIR).collect()}, 0
    assert len(got) == len(docs)
    for k in sorted(docs):
        ids = np.array([*library.encode(docs[k] or "", add_special_tokens=False).ids, 1], "<u4")
        assert got[k] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op5(spark, docs):
    got = {r.doc_id: r.class_id for r in QUERIES["op5_order_minhash"](spark, DIR).collect()}
    words = {k: order_minhash.word_hashes(t or "") for k, t in docs.items()}
    kmers = {k: set(order_minhash.kmer_hashes(w).tolist()) for k, w in words.items()}
    for a in docs:
        for b in docs:
            if a < b and (n := len(kmers[a] & kmers[b])) and n / len(kmers[a] | kmers[b]) >= 0.8 and order_minhash.similar(words[a], words[b]):
                assert got[a] == got[b]
    groups = defaultdict(list)
    for k, c in got.items():
        groups[c].append(k)
    assert all(len(g) == 1 or all(any(o != k and order_minhash.similar(words[o], words[k]) for o in g) for k in g) for g in groups.values())


def test_op6(spark, docs):
    """Whole texts against plain Python; nothing that was there in clear is left."""
    plain, changed = Plain(op6.KEY), 0
    for r in QUERIES["op6_pseudonyms"](spark, DIR).collect():
        assert r.text == plain.text(docs[r.doc_id])
        changed += r.text != docs[r.doc_id]
        for m in re.findall(r"\+1 \(\d{3}\) 555-\d{4}|(?<!\d)4\d{15}(?!\d)|[\w.]+@mail\d\.example\.com", docs[r.doc_id] or ""):
            assert m not in r.text
    assert changed > 10


def test_pseudonyms_of_made_up_texts_against_plain_python(spark):
    rng, plain = random.Random(4), Plain("k")
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(groups):
        body = d(sum(groups) - 1)
        body += next(c for c in "0123456789" if not luhn(body + c))
        return rng.choice(" -").join(body[sum(groups[:i]) : sum(groups[: i + 1])] for i in range(len(groups)))

    kinds = [
        lambda: card(rng.choice(([16], [13], [19], [4] * 4, [4, 6, 5], [3] * 5, [4, 4, 4, 4, 3]))), lambda: d(rng.randint(1, 22)), lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"+1 {d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}",
        lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: ".".join(str(rng.randrange(300)) for _ in range(4)), lambda: f"{rng.randint(1890, 2110)}-{rng.randint(0, 13):02d}-{rng.randint(0, 32):02d}", lambda: f"{rng.randint(0, 32):02d}/{rng.randint(0, 13):02d}/{rng.randint(1900, 2099)}",
        lambda: f"{rng.randint(0, 32):02d}.{rng.randint(0, 13):02d}.{rng.randint(1900, 2099)}", lambda: "".join(rng.choice("aB9._-") for _ in range(rng.randint(1, 9))) + "@" + rng.choice(("a.io", "x-y.example.com", "b", "c.d1")), lambda: rng.choice(("word", "é", "\n", "/", "12/25", "٣", "")),
    ]
    texts = [rng.choice((" ", ", ", "", "-")).join(rng.choice(kinds)() for _ in range(rng.randint(1, 8))) for _ in range(1500)]
    p = pseudonyms.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k")
    got = {r.doc_id: r.text for r in p.collect()}
    for k, t in enumerate(texts):
        assert got[k] == plain.text(t), t
    assert sum(got[k] != t for k, t in enumerate(texts)) > 700


def test_op7(spark, docs, library):
    for r in QUERIES["op7_bpe"](spark, DIR).collect():
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op8(spark, docs, duck):
    """Sizes, targets and quotas from the definition, in plain Python."""
    source = dict(duck.sql("SELECT doc_id, source FROM documents").fetchall())
    rows = {r.doc_id: r for r in QUERIES["op8_mix"](spark, DIR).collect()}
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in docs.items()}
    assert {k: r.size for k, r in rows.items()} == size
    names = sorted({s for s in source.values() if s is not None}) + [None] * (None in source.values())
    of = {s: sum(size[k] for k in docs if source[k] == s) for s in names}
    weight, left, target = {s: 1 + k % 3 for k, s in enumerate(names)}, float(sum(of.values())), {}
    while open_ := [s for s in names if s not in target]:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = [s for s in open_ if share[s] > 3 * of[s]]
        target |= {s: 3.0 * of[s] for s in full} if full else share
        left -= sum(3.0 * of[s] for s in full)
    block = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in docs], "doc_id long").select("doc_id", F.pmod(F.xxhash64(F.struct("doc_id"), F.lit(17)), F.lit(1024))).collect()}
    for code, s in enumerate(names):
        mine = [k for k in docs if source[k] == s]
        assert all((rows[k].source_size, rows[k].target) == (of[s], pytest.approx(target[s])) and rows[k].taken <= 3 * size[k] for k in mine)
        by_block = Counter()
        for k in mine:
            by_block[block[k]] += size[k]
        order = [b for turn in range(3) for b in mixing.block_order(code, sorted(by_block), 17, turn)]
        sums = np.cumsum([0] + [by_block[b] for b in order])
        assert abs(sum(rows[k].taken for k in mine) - target[s]) == pytest.approx(np.abs(sums - target[s]).min())
    assert sorted(map(tuple, QUERIES["op8_mix"](spark, DIR).collect())) == sorted(map(tuple, rows.values()))


def test_op9_and_op10(spark, duck):
    lang = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = [r for r in QUERIES["op9_langid"](spark, DIR).collect() if r.held_out]
    assert rows and np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) >= 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    quality = dict(duck.sql("SELECT doc_id, quality FROM labels").fetchall())
    scored = QUERIES["op10_crf"](spark, DIR).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in scored)
    known = [(r.score, r.predicted, quality[r.doc_id]) for r in scored if r.held_out and r.doc_id in quality]
    assert np.mean([p == y for _, p, y in known]) > max(np.mean([y for *_, y in known]), 0.85)  # more than a constant
    good, bad = ([s for s, _, y in known if y == k] for k in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) >= 0.9


def test_op9_and_op10_at_a_larger_size(spark):
    """Held-out accuracy of each class, which no constant reaches."""
    at = DIR.replace("sf0.001", "sf0.1")
    if not os.path.isdir(at):
        pytest.skip("no larger tables")
    lang = dict(spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "lang").collect())
    rows = [(lang[r.doc_id], r.lang_pred) for r in QUERIES["op9_langid"](spark, at).collect() if r.held_out and lang[r.doc_id]]
    assert all(np.mean([p == y for y, p in rows if y == k]) >= 0.97 for k in {y for y, _ in rows})
    quality = dict(spark.read.parquet(f"{at}/labels.parquet").select("doc_id", "quality").collect())
    known = [(r.score, r.predicted, quality[r.doc_id]) for r in QUERIES["op10_crf"](spark, at).collect() if r.held_out and r.doc_id in quality]
    assert all(np.mean([p == y for _, p, y in known if y == k]) >= 0.95 for k in (0, 1))
    good, bad = (np.array([s for s, _, y in known if y == k]) for k in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() >= 0.99


def test_op9_and_op10_predict_as_plain_code_does(spark, docs):
    """Every document against the models' formulas, one subword and one labelling at a time."""
    tables = {n: spark.read.parquet(f"{DIR}/{n}.parquet") for n in ("documents", "labels")}
    sample = langid.training_sample(tables["documents"].where(~op9.held_out()), "text", "lang", op9.PER_LANGUAGE, op9.LANGUAGE_BYTES)
    m = langid.train([t for _, t, _ in sample], [y for *_, y in sample])
    for r in QUERIES["op9_langid"](spark, DIR).collect():
        at = langid.subwords(docs[r.doc_id] or "").tolist()
        if not at:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        z = [sum(float(m.table[k, j]) for k in at) / len(at) + m.bias[j] for j in range(len(m.languages))]
        p = [math.exp((x - max(z)) / m.temperature) for x in z]
        assert r.lang_pred == m.languages[int(np.argmax(p))] and r.score == pytest.approx(max(p) / sum(p), rel=1e-5)
    q = op10.quality_model(tables["documents"], tables["labels"])
    for r in QUERIES["op10_crf"](spark, DIR).collect():
        features, chars, _ = crf.line_features([(docs[r.doc_id] or "").encode()])
        n, score = len(chars), lambda i, j, b: q.weight[j][np.arange(crf.N_FEATURES), b[i]].sum()
        b = np.array([[sum(e < x for e in q.edges[k]) for k, x in enumerate(f)] for f in features])
        u = [score(i, 1, b) + q.bias + (score(i - 1, 0, b) if i else 0) + (score(i + 1, 2, b) if i + 1 < n else 0) for i in range(n)]
        f = [[0.0, u[0]]]  # logarithms of forward and backward sums
        for x in u[1:]:
            f.append([np.logaddexp(f[-1][0] + q.pair[0, k], f[-1][1] + q.pair[1, k]) + k * x for k in (0, 1)])
        g = [[0.0, 0.0]]
        for x in reversed(u[1:]):
            g.append([np.logaddexp(q.pair[k, 0] + g[-1][0], q.pair[k, 1] + x + g[-1][1]) for k in (0, 1)])
        good = np.array([1 / (1 + math.exp(min(700, (a[0] + c[0]) - (a[1] + c[1])))) for a, c in zip(f, reversed(g), strict=True)])
        mean = np.clip((good * (chars + 1e-3)).sum() / (chars + 1e-3).sum(), 1e-6, 1 - 1e-6)
        assert r.score == pytest.approx(1 / (1 + math.exp(-(q.curve[0] * math.log(mean / (1 - mean)) + q.curve[1]))), abs=1e-6)


def test_pipeline_stages(spark, library):
    stages, rows = dict(corpus_pipeline.STAGES), {}
    assert list(stages) == ["quality classifier", "near-dedup", "pseudonyms", "mix", "bpe"]
    df = spark.read.parquet(f"{DIR}/documents.parquet")
    before = {r.doc_id: r for r in df.collect()}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, DIR).cache()
        rows[name] = df.collect()
        assert name == "bpe" or df.columns == corpus_pipeline.COLUMNS
    predicted = {r.doc_id for r in QUERIES["op10_crf"](spark, DIR).collect() if r.predicted}
    assert {r.doc_id for r in rows["quality classifier"]} == predicted
    words = {r.doc_id: order_minhash.word_hashes(r.text or "") for r in rows["quality classifier"]}
    kept = {r.doc_id for r in rows["near-dedup"]}
    assert all(any(order_minhash.similar(words[k], words[o]) for o in words if o != k) for k in words if k not in kept)
    assert {r.doc_id for r in rows["pseudonyms"]} == kept and all(r.text == before[r.doc_id].text or any(c in before[r.doc_id].text for c in "0123456789@") for r in rows["pseudonyms"])
    clear = {r.doc_id: r for r in rows["pseudonyms"]}
    assert all(r == clear[r.doc_id] for r in rows["mix"]) and max(Counter(r.doc_id for r in rows["mix"]).values()) <= 3
    assert Counter(r.doc_id for r in rows["bpe"]) == Counter(r.doc_id for r in rows["mix"])
    for r in rows["bpe"]:
        ids = library.encode(clear[r.doc_id].text or "", add_special_tokens=False).ids
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes() and r.n_tokens == len(ids)
    spark.catalog.clearCache()


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, DIR).count() > 0


def test_held_out(spark):
    got = spark.range(50).select(F.col("id").alias("doc_id")).withColumn("h", op9.held_out()).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def empty_tables(spark, folder, *full):
    """All tables without rows, but for those named."""
    for p in glob.glob(f"{DIR}/*.parquet"):
        name = os.path.basename(p)
        df = spark.read.parquet(p)
        (df if name[:-8] in full else df.limit(0)).write.parquet(f"{folder}/{name}")
    return str(folder)


def test_empty_tables(spark, tmp_path):
    none = empty_tables(spark, tmp_path / "none")
    for name, q in QUERIES.items():
        rows = q(spark, none).collect()
        assert len(rows) == (name == "op2_chat"), name
    assert corpus_pipeline.run(spark, none).count() == 0


def test_models_without_labels(spark, tmp_path, docs):
    """Nothing to learn from: every language is unknown where no row has one, every score the share of label 1."""
    bare = empty_tables(spark, tmp_path / "bare", "documents")
    assert {r.score for r in QUERIES["op10_crf"](spark, bare).collect()} == {0.5}
    unlabelled = tmp_path / "unlabelled"
    spark.read.parquet(f"{DIR}/documents.parquet").withColumn("lang", F.lit(None).cast("string")).write.parquet(f"{unlabelled}/documents.parquet")
    rows = QUERIES["op9_langid"](spark, str(unlabelled)).collect()
    assert len(rows) == len(docs) and {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}


def test_nulls_in_every_column(spark, tmp_path):
    """Rows of nulls, repeated, beside the others, in all tables that the queries read."""
    for name in ("documents", "embeddings", "conversations", "labels"):
        df = spark.read.parquet(f"{DIR}/{name}.parquet")
        blank = df.limit(2).select(*(F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns))
        df.limit(60).unionByName(blank).withColumn("extra", F.lit("clash")).withColumn("size", F.lit("clash")).withColumn("score", F.lit(0)).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = {n: len(q(spark, str(tmp_path)).collect()) for n, q in QUERIES.items()}
    chats = spark.read.parquet(f"{tmp_path}/conversations.parquet").select("conv_id").distinct().count() + 1
    assert rows == {n: chats if n == "op2_chat" else 62 for n in QUERIES}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_recall_of_sorted_passes():
    """Planted pairs at the threshold within a window in some pass, among 20,000 vectors of one label."""
    rng, dim, pairs, n = np.random.default_rng(1), 64, 2000, 20_000
    u = rng.standard_normal((n, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    side = rng.standard_normal((pairs, dim))
    side -= (side * u[:pairs]).sum(1, keepdims=True) * u[:pairs]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    u[pairs : 2 * pairs] = 0.93 * u[:pairs] + (1 - 0.93**2) ** 0.5 * side
    many, hit = projections.passes_for(n, 0.93, 8, 32, 0.01), np.zeros(pairs, bool)
    for towards in projections.directions(dim, many, 32, 7).reshape(many, 32, dim):
        key = (u @ towards.T > 0) @ (1 << np.arange(31, -1, -1, dtype=np.int64)).astype(np.float64)
        place = np.empty(n, np.int64)
        place[np.argsort(key, kind="stable")] = np.arange(n)
        hit |= np.abs(place[:pairs] - place[pairs : 2 * pairs]) <= 32
    assert hit.mean() >= 0.98

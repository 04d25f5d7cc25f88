"""Operators against brute force, exact round trips and held-out accuracy; and the cases
that every operator has to define: nulls, empty and long texts, ties, repeated rows, empty
tables, clashing column names."""

import hashlib
import io
import json
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliant.llm import bpe, chat, common, crf, graph, langid, mixing, order_minhash, projections, pseudonyms, simple8b, tiff, token_files

from foliant.llm.common import Shelf

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = "the of and lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()


def text_of(rng, n, words=WORDS):
    return " ".join(rng.choice(words) + str(rng.randint(0, 400)) for _ in range(n))


def documents(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame(list(enumerate(texts)), schema)


# ------------------------------------------------------------------------ TIFF

@pytest.mark.parametrize("how", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.DEFLATE_OLD, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 16)])
def test_tiff_round_trip(how, predictor, tile):
    rng = np.random.default_rng(1)
    for kind in (np.uint8, np.uint16):
        pages = [rng.integers(0, 9, (h, w, 3)).astype(kind) for h, w in ((1, 1), (20, 33))]
        for order in "<>":
            data = tiff.encode_tiff(pages, how, predictor, 8, tile, order=order)
            got = [tiff.decode_page(data, t) for t in tiff.walk_directories(data)]
            assert len(got) == 2 and all((a == b).all() for a, b in zip(pages, got, strict=True))


def test_lzw_and_packbits_at_code_width_changes():
    rng = np.random.default_rng(0)
    for n in (0, 1, 254, 255, 256, 257, 511, 512, 5000, 70000):
        for data in (rng.integers(0, 256, n, dtype=np.uint8).tobytes(), bytes(n)):
            assert tiff.lzw_decode(tiff.lzw_encode(data), n + 1) == data
            assert tiff.packbits_decode(tiff.packbits_encode(data), n + 1) == data


def read_all(data):
    pages = list(tiff.read_pages(data))
    return [p for p in pages if "error" not in p], next((p["error"] for p in pages if "error" in p), None)


def directory(data, change):
    """The file with one directory whose tags are changed by ``change``: tag -> (type, values) or None."""
    (tags,) = tiff.walk_directories(data)
    shifted = {t: tuple(x + 8 for x in v) if t in (tiff.STRIP_OFFSETS, tiff.TILE_OFFSETS) else v for t, v in tags.items() if t != "order"}
    fields = {t: (4, v) for t, v in shifted.items()} | change  # the old file is moved by a header and holds the strips
    fields = sorted((t, *f) for t, f in fields.items() if f is not None)
    body, extra, at = b"", b"", 8 + len(data) + 2 + 12 * len(fields) + 4
    for tag, kind, values in fields:
        raw = struct.pack("<" + tiff.FIELD_CODES[kind] * len(values), *(x for v in values for x in (v if isinstance(v, tuple) else (v,))))
        body += struct.pack("<HHI", tag, kind, len(values)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", at + len(extra)))
        extra += raw if len(raw) > 4 else b""
    return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + struct.pack("<H", len(fields)) + body + b"\0\0\0\0" + extra


def test_tiff_broken_files():
    good = tiff.encode_tiff([np.zeros((2, 2, 1), np.uint8)])
    for data in (b"", b"II*\0", b"nonsense" * 4, good[:-6], good.replace(good[8:12], b"\xff\xff\xff\xff")):
        assert read_all(data)[1]
    assert read_all(None) == ([], None)
    loop = bytearray(good)
    at = int.from_bytes(good[4:8], "little")
    loop[-4:] = at.to_bytes(4, "little")
    assert len(read_all(bytes(loop))[0]) == 1


def test_tiff_directories_that_lie():
    image = np.arange(4 * 40 * 3, dtype=np.uint8).reshape(4, 40, 3)
    strips, tiles = tiff.encode_tiff([image]), tiff.encode_tiff([image], tile=(16, 16))
    for base in (strips, tiles):
        (page,), error = read_all(directory(base, {}))
        assert error is None and page["samples"] == image.tobytes()
    top = (1 << 32) - 1
    lies = [(strips, c) for c in (
        {tiff.WIDTH: (4, (top,)), tiff.LENGTH: (4, (top,))}, {tiff.LENGTH: (4, (top,)), tiff.ROWS_PER_STRIP: (4, (1,))}, {tiff.SAMPLES: (4, (0,))}, {tiff.SAMPLES: (4, (top,))}, {tiff.WIDTH: None},
        {tiff.WIDTH: (11, (40.0,))}, {tiff.WIDTH: (5, ((40, 1),)), tiff.LENGTH: None}, {tiff.BITS: (4, (4, 4, 4))}, {tiff.COMPRESSION: (4, (7,))}, {tiff.PREDICTOR: (4, (3,))}, {tiff.STRIP_COUNTS: None}, {tiff.STRIP_OFFSETS: None},
        {tiff.STRIP_COUNTS: (4, (5,))}, {tiff.STRIP_OFFSETS: (4, (top - 8,))}, {tiff.ROWS_PER_STRIP: (4, (0,))}, {tiff.STRIP_COUNTS: (11, (5.5,))}, {tiff.LENGTH: (4, (100_000,))}, {tiff.COMPRESSION: (4, (tiff.LZW,))},
    )] + [(tiles, c) for c in ({tiff.TILE_COUNTS: None}, {tiff.TILE_WIDTH: None}, {tiff.TILE_WIDTH: (4, (0,))}, {tiff.TILE_LENGTH: (4, (top,)), tiff.TILE_WIDTH: (4, (top,))}, {tiff.TILE_OFFSETS: (4, (8,))})]
    for base, change in lies:
        pages, error = read_all(directory(base, change))
        assert error and not pages, change
    rng = random.Random(3)
    for base in (strips, tiles, tiff.encode_tiff([image, image], tiff.LZW), tiff.encode_tiff([image, image], tiff.PACKBITS)):
        for _ in range(400):
            data = bytearray(base)
            for _ in range(rng.randint(1, 6)):
                data[rng.randrange(len(data))] = rng.choice((0, 1, 255, rng.randrange(256)))
            read_all(bytes(data[: rng.choice((len(data), rng.randrange(len(data))))]))  # ends, whatever it gives
    bomb = zlib.compress(bytes(50_000_000))
    assert len(tiff.expand(bomb, tiff.DEFLATE, 1000)) == 1000


def test_tiff_operator(spark):
    texts = ["", None, "a" * 500_000, "é", "é"]
    df = documents(spark, texts).select("doc_id", F.col("text").cast("binary").alias("payload"), F.lit("x").alias("samples"), F.lit("y").alias("media"))
    for layout in tiff.EVERY:
        stored = tiff.store_tiff(df, "payload", page_rows=1000, layouts=(layout,))
        assert stored.columns == ["doc_id", "samples", "media"]
        pages, kinds = defaultdict(list), set()
        rows = tiff.tiff_pages(stored)
        assert rows.columns == ["doc_id", *tiff.PAGE_FIELDS]
        for r in rows.collect():
            pages[r.doc_id].append((r.page_no, bytes(r.samples)))
            kinds.add((r.compression, r.predictor, r.tiled))
        assert kinds == {(layout[0], layout[1], layout[2] is not None)}
        for k, t in enumerate(texts):
            raw = (t or "").encode()
            raw += b" " * (192 - len(raw) if len(raw) < 192 else -len(raw) % 192)
            assert b"".join(s for _, s in sorted(pages[k])) == raw
        assert len(pages[2]) == 3 and pages[3] == pages[4]
    assert tiff.tiff_pages(stored.limit(0)).count() == 0


def test_tiff_digests_of_files_whose_pages_span_batches(spark, monkeypatch):
    monkeypatch.setattr(tiff, "OUT_ROWS", 2)
    rng = np.random.default_rng(5)
    bodies = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 5000, 192 * 70, 192 * 10, 192 * 10 + 1, 30_000)]
    media = [tiff.encode_tiff([np.frombuffer(b.ljust(192 * max(1, -(-len(b) // 192))), np.uint8).reshape(-1, 64, 3)[y : y + 10] for y in range(0, max(1, -(-len(b) // 192)), 10)]) for b in bodies]
    rows = [(k, bytearray(m)) for k, m in enumerate([*media, media[2], b"broken", media[5][:-20]])] + [(99, None)]
    df = spark.createDataFrame(rows, "doc_id long, media binary").coalesce(2)
    got = {r.doc_id: r for r in tiff.file_digests(tiff.tiff_pages(df), ["doc_id"]).collect()}
    assert sorted(got) == list(range(9))
    for k, b in enumerate([*bodies, bodies[2]]):
        whole = b.ljust(192 * max(1, -(-len(b) // 192)))
        assert (got[k].payload_bytes, got[k].payload_sha256, got[k].tail_crc32, got[k].error) == (len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-16:]), None)
        assert got[k].n_pages == -(-len(whole) // 1920)
    assert got[7].error and got[7].n_pages == 0 and got[8].error


# ------------------------------------------------------------------------ chat

def test_chat_is_reversible(spark):
    control = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", control), (1, 1, "assistant", "a <\\| b <\\\\| <<|"), (1, 2, "we<ird\n%role", ""), (2, 0, None, None), (None, 5, "assistant", "é\n"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text"))).withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.format_chat(df).withColumn("turns", chat.parse_turns(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_mask"))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3]) for r in rows[:3]]
    assert got[1].loss == rows[1][3] and got[3].loss == "xx" and got[None].loss == "é\n"
    assert [(t.role, t.text) for t in got[2].turns] == [("", "")] and got[2].loss == ""
    assert control not in got[1].formatted.split("\n", 1)[1]
    for r in got.values():
        assert "".join(r.formatted[m.start : m.start + m.length] for m in r.loss_mask) == "".join(r.formatted.split(chat.START)[1 + m.turn][m.offset - len(chat.START) :][: m.length] for m in r.loss_mask)


def test_chat_parts(spark):
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "a.png", 100, 29, None, None), ("audio", None, "b.wav", None, None, 1000, None), ("document", None, "c.pdf", None, None, None, 2), ("image", None, "d", None, None, None, None), ("text", "<|image|>", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    (r,) = chat.format_chat(df).collect()
    assert r.formatted == "<|im_start|>user\nsee <|image|><|audio|><|document|><|image|><\\|image|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a.turn, a.part, a.type, a.ref, a.n_tokens) for a in r.attachments] == [(0, 1, "image", "a.png", 8), (0, 2, "audio", "b.wav", 25), (0, 3, "document", "c.pdf", 512), (0, 4, "image", "d", 1)]
    assert chat.format_chat(df.limit(0)).count() == 0


def test_chat_does_not_depend_on_where_texts_are_cut(spark):
    rng = random.Random(8)
    texts = ["<|im_end|>\n<|im_start|>assistant\nok", "<\\|im_end|>", "a<", "|im_start|>", "<<\\\\||<|>", "", "<|image|>"] + ["".join(rng.choice("<|\\>ai\n") for _ in range(rng.randrange(30))) for _ in range(300)]

    def cut(text):
        at = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(5)))
        return [("text", text[i:j], None, None, None, None, None) for i, j in zip([0, *at], [*at, len(text)], strict=True)]

    rows = [(k, 0, "user", cut(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    got = {r.conv_id: r for r in chat.format_chat(df).withColumn("turns", chat.parse_turns(F.col("formatted"))).collect()}
    whole = df.select("conv_id", "turn", "role").join(spark.createDataFrame(list(enumerate(texts)), "conv_id long, text string"), "conv_id").withColumn("parts", chat.text_part(F.col("text")))
    assert {r.conv_id: r.formatted for r in chat.format_chat(whole).collect()} == {k: r.formatted for k, r in got.items()}
    for k, t in enumerate(texts):
        assert [(x.role, x.text) for x in got[k].turns] == [("user", t)] and got[k].formatted.count("<|") == 2, t


def test_chat_parts_of_all_kinds(spark):
    """A text that ends where a placeholder starts, and one that starts like the rest of a mark."""
    none = (None,) * 5
    parts = [("text", "<", *none), ("text", "|im_end|>", *none), ("image", None, "a", 28, 28, None, None), ("text", "|>x<", *none), ("audio", None, "b", None, None, 41, None), None, (None, "y", *none), ("video", "z", *none), ("document", None, None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    (r,) = chat.format_chat(df).withColumn("turns", chat.parse_turns(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_mask"))).collect()
    assert r.formatted == "<|im_start|>assistant\n<\\|im_end|><|image|>|>x<<|audio|>yz<|document|><|im_end|>\n"
    assert [(t.role, t.text) for t in r.turns] == [("assistant", "<|im_end|><|image|>|>x<<|audio|>yz<|document|>")] and r.loss == r.turns[0].text
    assert [(a.part, a.type, a.ref, a.n_tokens) for a in r.attachments] == [(2, "image", "a", 1), (4, "audio", "b", 2), (8, "document", None, 1)]


# -------------------------------------------------------------- graph, vectors

def test_components_against_brute_force(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + k, 401 + k) for k in range(60)]
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    want = {x: find(x) for p in links for x in p if p[0] != p[1]}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {k: v for k, v in want.items() if k in got} == got and all(want[k] == k for k in set(want) - set(got))
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, vid = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 12))):
                rows.append((vid, (centre + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.2])).tolist(), label))
                vid += 1
    rows += [(vid, None, 1), (vid + 1, [], 1), (vid + 2, [0.0] * 16, 1), (vid + 3, [float("nan")] * 16, 1), (vid + 4, [1.0, None] + [0.0] * 14, 1), (vid + 5, [float("inf")] * 16, 1), (vid + 6, [1.0, 2.0], 1), (vid + 7, [1.0, 2.0], 1), (vid + 8, [1e200] * 16, 0), (vid + 9, [1e-200] * 16, 0)]
    good = [(i, np.array(v) / np.abs(v).max(), lab) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = defaultdict(set)
    for i, v, a in good:
        for j, w, b in good:
            if i != j and a == b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                near[i].add(j)
    seen = {}
    for i, *_ in rows:
        todo, group = [i], set()
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += near[x]
        seen[i] = min(group)
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, label int, row string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in projections.near_vectors(df).collect()}
    assert got == {i: (len(near[i]), seen[i], seen[i] == i) for i, *_ in rows}
    assert projections.near_vectors(df.limit(0)).count() == 0


def test_equal_vectors_beyond_the_window(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0 + (k % 2) * 1e-3], 1) for k in range(300)], "vec_id long, embedding array<float>, label int")
    got = projections.near_vectors(df, window=4).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(299, 0)}


def test_windows_reach_across_short_tasks(spark):
    """Every pair within a window is found, whatever the tasks: many with one vector or none."""
    n, window = 60, 5
    angle = [0.001 * k * k for k in range(n)]
    raw = [np.array([math.cos(a), math.sin(a)]).tobytes() for a in angle]
    rows = [(0, k % 2, 2, k, k, bytearray(u)) for k, u in enumerate(raw)]
    keyed = spark.createDataFrame(rows, "pass int, grp int, dim int, key bigint, row bigint, u binary")
    near = lambda a, b: math.cos(angle[a] - angle[b]) >= 0.999
    want = graph.LocalUnion()
    for g in (0, 1):
        mine = [k for k in range(n) if k % 2 == g]
        for i in range(len(mine)):
            for j in range(i + 1, min(i + window + 1, len(mine))):
                if near(mine[i], mine[j]):
                    want.join(mine[i], mine[j])
    many = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for tasks in ("1", "3", "200", "300"):
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            got = graph.LocalUnion()
            for r in projections._window_links(keyed, window, 0.999, Shelf()).collect():
                assert r.a % 2 == r.b % 2
                got.join(r.a, r.b)
            assert {k: got.find(k) for k in range(n)} == {k: want.find(k) for k in range(n)}, tasks
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", many)


def test_facts_of_hot_and_other_keys(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"key {k % 40}" if k % 4 else None) for k in range(4000)], "id long, key string")
    facts = Shelf().put(rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top")), "facts")
    want = {r.id: r for r in rows.join(facts.drop("n"), "key", "left").collect()}
    for hot in (1, 10, 1000):
        common.HOT_KEYS = hot
        try:
            assert {r.id: r.top for r in common.join_facts(rows, facts, "key", "n", "left").collect()} == {k: r.top for k, r in want.items()}
            assert common.join_facts(rows, facts, "key", "n").count() == sum(r.key is not None for r in want.values())
        finally:
            common.HOT_KEYS = 1000


def test_passes_follow_the_size_of_a_group(spark):
    assert [projections.passes_for(n, 0.93, 8, 32, 0.01) for n in (10, 10**5, 10**6)] == [8, 18, 29]
    rng, n, pairs = np.random.default_rng(4), 4000, 300
    u = rng.standard_normal((n, 32))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    side = rng.standard_normal((pairs, 32))
    side -= (side * u[:pairs]).sum(1, keepdims=True) * u[:pairs]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    u[pairs : 2 * pairs] = 0.935 * u[:pairs] + (1 - 0.935**2) ** 0.5 * side
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(u)], "vec_id long, embedding array<double>, label int")
    got = projections.near_vectors(df, window=1).where("not kept").collect()
    assert all(r.vec_id - r.component_id == pairs and r.n_links == 1 for r in got) and len(got) >= 0.98 * pairs


# ---------------------------------------------------------- tokens and files

ODD = ["", "   ", "Hello <|endoftext|> wOrld it's 123", "ΑΣ ΣΑ İstanbul", "é é ẛ̣", "a\x1cb\x85c\xa0d\ve", "***it's'd!!! <|startoftext|>x<|endoftext", "中文字 한국어 😀👍🏽", "x" * 5000, "don't we'll they'Ve", "½ ² ٣ Ⅸ"]


def test_bpe_equals_the_library():
    t, m, v = Tokenizer.from_file(PATH), bpe.load(PATH), bpe.load(PATH, bpe.Vocabulary)
    rng = random.Random(1)
    vocab = list(t.get_vocab())
    texts = ODD + ["".join(rng.choice("aabcdeht's é Éß<|>!.12\n\tΣ中😀́") for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["".join(rng.choice(vocab).replace("</w>", "") for _ in range(3)) for _ in range(3000)]
    ids, bounds = m.encode_array(bpe.pa.array([*texts, None]))
    for k, e in enumerate(t.encode_batch([*texts, ""], add_special_tokens=False)):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == e.ids, texts[k : k + 1]
        assert v.decode(e.ids) == t.decode(e.ids, skip_special_tokens=False)


def test_every_token_is_its_own_encoding_or_out_of_reach():
    """The pair test agrees with the library on all tokens of the vocabulary."""
    t, m = Tokenizer.from_file(PATH), bpe.load(PATH)
    pieces = [s[:-4] for s in t.get_vocab() if s.endswith("</w>") and s[:-4].isascii() and s[:-4].isalpha()]
    ids, bounds = m.encode_array(bpe.pa.array(pieces))
    for k, e in enumerate(t.encode_batch(pieces, add_special_tokens=False)):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == e.ids


def test_bpe_operators(spark):
    df = documents(spark, [*ODD, None, "same", "same"]).withColumn("ids", F.lit("clash"))
    coded = bpe.encode_bpe(df.drop("ids").withColumn("kept", F.lit(1)), "text", PATH, decoded="back")
    again = {r.doc_id: r.text for r in bpe.decode_bpe(coded.select("doc_id", "ids"), "ids", PATH, "text").collect()}
    rows = {r.doc_id: r for r in coded.collect()}
    assert all(again[k] == r.back for k, r in rows.items()) and rows[len(ODD)].back == ""
    assert rows[len(ODD) + 1].ids == rows[len(ODD) + 2].ids
    assert bpe.encode_bpe(df.drop("ids").limit(0), "text", PATH).count() == 0


def test_bpe_equals_the_library_on_random_unicode():
    """Whole texts of any characters, through both encoders."""
    t, own, shared = Tokenizer.from_file(PATH), bpe.load(PATH), token_files.LibraryEncoder(PATH)
    rng = random.Random(12)
    ranges = [(0, 0x7F), (0, 0x2FF), (0x300, 0x52F), (0x590, 0x6FF), (0x900, 0xDFF), (0x1100, 0x11FF), (0x1E00, 0x2FFF), (0x3040, 0x30FF), (0xAC00, 0xD7A3), (0xE000, 0xFFFD), (0x10000, 0x1FFFF), (0, 0x10FFFF)]

    def char():
        c = rng.randint(*rng.choice(ranges))
        return " " if 0xD800 <= c <= 0xDFFF else chr(c)

    texts = ["".join(char() if rng.random() < 0.8 else rng.choice(" \t\n\x0b\x85\u2028") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += [f"a{chr(c)}b{chr(c)} {chr(c)}1" for c in range(0x250)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    for encoder in (own, shared):
        ids, bounds = encoder.encode_array(bpe.pa.array(texts))
        for k, w in enumerate(want):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == w, (type(encoder), texts[k])


def test_bpe_refuses_files_of_another_kind(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": {"type": "ByteLevel"}}, {"model": spec["model"] | {"unk_token": "?"}}):
        with pytest.raises(ValueError, match="another kind"):
            bpe.Words(spec | change)
    short = {k: v for k, v in spec["model"]["vocab"].items() if k not in ("z", "z</w>") and "z" not in k}
    merges = [m for m in spec["model"]["merges"] if "z" not in "".join(m)]
    (tmp_path / "short.json").write_text(json.dumps(spec | {"model": spec["model"] | {"vocab": short, "merges": merges}}))
    m = bpe.PrefixBPE(str(tmp_path / "short.json"))
    assert m.encode("hello") and m.encode("") == []
    with pytest.raises(ValueError, match="no token"):
        m.encode("a zebra")


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 59, 60, 61, 1000, simple8b.BLOCK):
        for top in (1, 2, 7, 100, 49408, 1 << 20, 1 << 31, 1 << 59, 1 << 60, 1 << 63):
            v = (rng.random(n) * top).astype(np.uint64)
            v[rng.random(n) < 0.3] %= np.uint64(50)
            assert (simple8b.unpack_block(simple8b.pack_block(v), n) == v).all()
    with pytest.raises(ValueError):
        simple8b.unpack_block(np.array([15 << 60], np.uint64), 1)


def test_token_file_ranges():
    rng = np.random.default_rng(1)
    docs = [(k if k % 7 else None, rng.integers(0, 50_000, rng.integers(0, 2000 if k % 40 else 70_000)).astype(np.uint32)) for k in range(200)]
    w = simple8b.TokenFileWriter()
    for d in docs:
        w.add(*d)
    data = w.finish()
    f = simple8b.TokenFile(io.BytesIO(data), len(data))
    at = 0
    for (doc, v), (i, start, got) in zip(docs, f.documents(), strict=True):
        assert (doc, at) == (i, start) and (v == got).all()
        at += len(v)
    whole = np.concatenate([v for _, v in docs])
    assert (f.values(12_345, 54_321) == whole[12_345 : 12_345 + 54_321]).all()
    with pytest.raises(ValueError):
        simple8b.TokenFile(io.BytesIO(data[:-1] + b"x"), len(data))


def test_token_files_operator(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(1 << 40) if k else None, t) for k, t in enumerate([*ODD, None, *(text_of(rng, rng.randrange(300)) for _ in range(60))])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    t = Tokenizer.from_file(PATH)
    want, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        want.append((doc, at, len(ids) // 4, zlib.crc32(ids), ids))
        at += len(ids) // 4
    manifest = token_files.write_token_files(df, PATH, file_tokens=3000)
    assert manifest.count() > 2
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in token_files.read_token_files(manifest).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_files.read_token_files(token_files.write_token_files(df.limit(0), PATH)).count() == 0


# ------------------------------------------------------------- near duplicates

def levenshtein(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_alignment_against_brute_force():
    rng = random.Random(0)
    for _ in range(1500):
        top = rng.choice([3, 10, 1000])
        a = [rng.randint(10, 10 + top) for _ in range(rng.randint(1, 60))]
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 3 + 1)):
            i, o = rng.randrange(len(b) + 1), rng.random()
            if o < 0.5 and i < len(b):
                b[i : i + 1] = [rng.randint(10, 10 + top)] if o < 0.3 else []
            else:
                b.insert(i, rng.randint(10, 10 + top))
        most, d = rng.randint(0, 20), levenshtein(a, b)
        assert order_minhash.edits_within(np.array(a, np.uint64), np.array(b, np.uint64), most) == (d if d <= most else None)


def test_near_texts_against_brute_force(spark):
    rng = random.Random(7)
    passage, texts = text_of(rng, 70), []
    for _ in range(40):
        base = text_of(rng, rng.randint(40, 200)).split()
        if rng.random() < 0.4:
            base[10:10] = passage.split()
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += ["", None, "   ", "one two", "one two", "One  TWO", "word " * 3000, "word " * 3000]
    df = documents(spark, texts).withColumn("words", F.lit("clash"))
    got = {r.doc_id: r for r in order_minhash.near_texts(df).collect()}
    words = [order_minhash.word_hashes(t or "") for t in texts]
    kmers = [set(order_minhash.kmer_hashes(w).tolist()) for w in words]
    for i in range(len(texts)):
        for j in range(i):
            both = len(kmers[i] & kmers[j])
            if both and both / len(kmers[i] | kmers[j]) >= 0.8 and order_minhash.similar(words[i], words[j]):
                assert got[i].class_id == got[j].class_id, (i, j)
    members = defaultdict(list)
    for k, r in got.items():
        members[r.class_id].append(k)
    for c, m in members.items():
        assert c == min(m) and all(got[k].class_size == len(m) and got[k].kept == (k == c) for k in m)
        assert len(m) == 1 or all(any(o != k and order_minhash.similar(words[o], words[k]) for o in m) for k in m)
    n = len(texts)
    assert [len(members[n - 8 + k]) for k in range(3)] == [1, 1, 1] and len(members[n - 5]) == 3
    assert order_minhash.near_texts(df.limit(0)).count() == 0


def test_large_group_of_texts_with_a_common_passage_stays_apart(spark):
    rng = random.Random(3)
    passage = text_of(rng, 120)
    df = documents(spark, [passage + " " + text_of(rng, 70) for _ in range(150)])
    assert order_minhash.near_texts(df).where("kept").count() == 150


def quoted_texts():
    """Pairs that are 85 to 95 % a quoted passage, among texts that quote three quarters of it."""
    rng = random.Random(5)
    texts, pairs = [], []
    for own in (16, 24, 30, 40):
        passage = text_of(rng, 270).split()
        for _ in range(100):
            quote = list(passage)
            for at in rng.sample(range(0, 270, 30), 2):
                quote[at : at + 30] = text_of(rng, 30).split()
            texts.append(" ".join(quote + text_of(rng, 30).split()))
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join([*passage, text_of(rng, own)]) for _ in range(2)]
    return texts, pairs


def test_pairs_that_are_mostly_a_quoted_passage_are_found(spark):
    texts, pairs = quoted_texts()
    words = [order_minhash.word_hashes(t) for t in texts]
    kmers = [set(order_minhash.kmer_hashes(w).tolist()) for w in words]
    got = {r.doc_id: r.class_id for r in order_minhash.near_texts(documents(spark, texts)).collect()}
    alike = [(a, b) for a, b in pairs if len(kmers[a] & kmers[b]) >= 0.8 * len(kmers[a] | kmers[b]) and order_minhash.similar(words[a], words[b])]
    assert len(alike) >= 2 and [(a, b) for a, b in alike if got[a] != got[b]] == []
    assert all(got[i] == i for i in range(len(texts)) if not any(i in p for p in pairs))


def test_pairs_are_found_alike_among_few_and_many_texts(spark):
    texts, pairs = quoted_texts()
    rng = random.Random(9)
    for n in (0, 1500):
        got = order_minhash.near_texts(documents(spark, texts + [text_of(rng, 20) for _ in range(n)])).where("not kept").collect()
        assert {(r.class_id, r.doc_id) for r in got} == set(pairs)


def test_counts_of_kmers_are_of_all_texts(spark, monkeypatch):
    texts, pairs = quoted_texts()
    monkeypatch.setattr(order_minhash, "BLOCK", 7)  # counts of many blocks are added up
    got = order_minhash.near_texts(documents(spark, texts)).where("not kept").collect()
    assert {(r.class_id, r.doc_id) for r in got} == set(pairs)


def test_copies_that_the_first_keys_leave_apart_cost_few_comparisons(spark, monkeypatch):
    rng, texts = random.Random(11), []
    for _ in range(4):
        base = text_of(rng, 150).split()
        edits = [(at, f"edit{at}") for at in range(2, 150, 6)]
        for i in range(300):
            copy = list(base)
            for at, word in rng.sample(edits, rng.randint(1, 4)):
                copy[at] = word
            # every other text is too long to link, and can be the smallest of a key
            texts.append(" ".join(copy + [text_of(rng, 45)] * (i % 2)))
    compared, put = [], common.Shelf.put

    def counted(self, df, name):
        out = put(self, df, name)
        if df.columns == ["a", "b"]:
            compared.append(out.count())
        return out

    monkeypatch.setattr(common.Shelf, "put", counted)
    got, few = order_minhash.near_texts(documents(spark, texts), sketches=1).collect(), sum(compared)
    monkeypatch.setattr(order_minhash, "TURNS", 0, raising=False)  # all pairs of a key, as a measure
    compared.clear()
    assert sorted(got) == sorted(order_minhash.near_texts(documents(spark, texts), sketches=1).collect())
    assert few < 10 * len(texts) and 2 * few < sum(compared), (few, sum(compared))


# --------------------------------------------------------------- pseudonyms

def test_pseudonyms_restore_and_link(spark):
    texts = ["call +1 (499) 555-6503 or 212-555-0199", "again +1 (499) 555-6503", "card 4337166598464399, 4111 1111 1111 1111, bad 4111111111111112", "ip 10.0.0.1 and 256.1.1.1 1.2.3.4.5", "bob.Smith99@mail2.example.com", "1984-02-29 1985-02-29 31.12.1999 12/31/1999 31/12/1999", "ssn 123-45-6789 000-12-3456", None, "", "no data, version 2.0.", "+1 (139) 555-2766 +1 (055) 055-0000 +1 (555) 155-2766 and 139-555-2766", "x" * 100_000 + " 10.0.0.1", "call +1 (499) 555-6503 or 212-555-0199"]
    df = documents(spark, texts).withColumn("found", F.lit("kept"))
    p = pseudonyms.pseudonymise(df, "key", count="n")
    out = {r.doc_id: r for r in p.collect()}
    back = {r.doc_id: r.text for r in pseudonyms.pseudonymise(p.drop("n"), "key", reverse=True).collect()}
    assert [back[k] for k in range(len(texts))] == texts
    assert out[0].text == out[12].text and out[0].text.split(" or ")[0][5:] == out[1].text[6:]
    assert [sum(out[k].n.values()) for k in range(len(texts))] == [2, 1, 2, 1, 1, 4, 1, 0, 0, 0, 3, 1, 2]
    for k in (0, 1, 2, 3, 4, 5, 6, 10, 11):
        assert out[k].text != texts[k] and len(out[k].text.split()) == len(texts[k].split())
    assert "4111111111111112" in out[2].text and out[9].text == texts[9] and out[0].found == "kept" and out[10].text.endswith("139-555-2766")
    assert pseudonyms.pseudonymise(df.limit(0), "key").count() == 0


def test_cards_beside_other_numbers(spark):
    card = "4111 1111 1111 1111"
    texts = [f"{card} 12/25", f"{card.replace(' ', '')} 123", f"item 7 {card.replace(' ', '')}", f"{card} 123", "3782 822463 10005 99", card.replace(" ", "-"), "4111 1111 1111 1112 12"]
    p = pseudonyms.pseudonymise(documents(spark, texts), "key", count="n")
    out = {r.doc_id: r for r in p.collect()}
    assert [r.n["card"] for _, r in sorted(out.items())] == [1, 1, 1, 1, 1, 1, 0] and out[6].text == texts[6]
    digits = [re.sub("[^0-9]", "", out[k].text) for k in range(6)]
    assert len({d[:16] for d in (digits[0], digits[1], digits[3], digits[5])} | {digits[2][1:]}) == 1
    assert out[0].text.endswith(" 12/25") and out[1].text.endswith(" 123") and out[2].text.startswith("item 7 4") and out[4].text.endswith(" 99") and all(out[k].text != texts[k] for k in range(6))
    assert [r.text for r in pseudonyms.pseudonymise(p.drop("n"), "key", reverse=True).orderBy("doc_id").collect()] == texts


def test_the_key_is_in_no_plan(spark):
    p = pseudonyms.pseudonymise(documents(spark, ["10.0.0.1"]), "very-secret-key")
    assert p.collect()[0].text != "10.0.0.1"
    assert "very-secret" not in p._jdf.queryExecution().toString() and "EvalPython" not in p._jdf.queryExecution().toString()


def test_permutation_against_python(spark):
    """The rounds in plain Python; and a whole range is permuted."""

    def want(x, a, b):
        left, right = divmod(x, b)
        for i in range(pseudonyms.ROUNDS):
            h = lambda v: int(hashlib.sha256(f"k|t|{i}|{v}".encode()).hexdigest()[:14], 16)  # noqa: B023, E731
            if i % 2 == 0:
                left = (left + h(right)) % a
            else:
                right = (right + h(left)) % b
        return left * b + right

    n = 17 * 43
    got = {r.id: r.y for r in spark.range(n).select("id", pseudonyms.permute(F.col("id"), 17, 43, "k", "t").alias("y")).collect()}
    assert got == {x: want(x, 17, 43) for x in range(n)} and set(got.values()) == set(range(n))


# --------------------------------------------------------------------- mixing

def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    got = mixing.targets([10, 1000, 1000], [3, 1, 1])
    assert got[0] == 30 and sum(got) == pytest.approx(2010)
    assert list(mixing.targets([0, 5], [1, 2])) == [0, 5.0] and len(mixing.targets([], [])) == 0


def test_quotas_against_brute_force():
    rng = random.Random(8)
    for k in range(60):
        sizes = {b: rng.randrange(50) for b in rng.sample(range(1024), rng.randint(1, 12))}
        goal = rng.random() * 3 * sum(sizes.values())
        order = [b for turn in range(3) for b in mixing.block_order(k, sorted(sizes), 17, turn)]
        off = [abs(sum(sizes[b] for b in order[:n]) - goal) for n in range(len(order) + 1)]
        assert off[mixing.quota(k, sizes, goal, 17)] == pytest.approx(min(off))
        n = rng.randrange(len(order) + 1)
        cuts = sorted(rng.randrange(n + 1) for _ in range(3))
        counts = [j - i for i, j in zip([0, *cuts], [*cuts, n], strict=True)]
        want = defaultdict(list)
        for b, shard in zip(order, [s for s, c in enumerate(counts) for _ in range(c)], strict=False):
            want[b].append(shard)
        assert mixing.dealt(k, sorted(sizes), counts, 17) == want


def test_splitting_tree_has_the_law_of_a_shuffle():
    """Counts of each shard, over many seeds, against the multivariate hypergeometric law."""
    quotas, shards, n = np.array([5, 0, 3, 4]), 4, 4000
    seen = [Counter() for _ in range(shards)]
    for seed in range(n):
        counts = mixing.split_quotas(quotas, shards, seed)
        assert (counts.sum(axis=0) == quotas).all() and (counts.sum(axis=1) == 3).all()
        for shard in range(shards):
            seen[shard][tuple(counts[shard].tolist())] += 1
    for counter in seen:
        stat, cells = 0.0, 0
        for a in range(4):
            for b in range(4 - a):
                p = math.comb(5, a) * math.comb(3, b) * math.comb(4, 3 - a - b) / math.comb(12, 3)
                stat += (counter[a, 0, b, 3 - a - b] - n * p) ** 2 / (n * p)
                cells += 1
        assert stat < 30 and cells == 10  # 9 degrees of freedom: beyond 30 once in 2000
    uneven = sum(mixing.split_quotas(np.array([7, 4]), 3, seed).sum(axis=1) for seed in range(600)) / 600
    assert np.allclose(uneven, 11 / 3, atol=0.1)


def test_mix(spark):
    rng = random.Random(5)
    rows = [(k, f"s{k % 5}" if k % 11 else None, text_of(rng, rng.randrange(60))) for k in range(2000)] + [(5000, "s1", None), (5001, "s9", "")]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, source string, text string, shard int, size string, draws string")
    drawn = mixing.mix_draws(df, key=F.struct("doc_id"), shards=7)
    assert drawn.columns == ["doc_id", "source", "text", "shard", "size", "source_size", "target", "draws"]
    got = drawn.collect()
    assert len(got) == len(rows) and all(len(r.draws) <= 3 for r in got)
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.size * len(r.draws)
        target[r.source] = r.target
        assert len({d.copy for d in r.draws}) == len(r.draws)
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(60, 0.02 * t)
    assert sorted(map(repr, mixing.mix_draws(df, key=F.struct("doc_id"), shards=7).collect())) == sorted(map(repr, got))
    out = mixing.mixed(drawn, ["doc_id", "text", "shard"]).collect()
    assert Counter(r.doc_id for r in out) == Counter({r.doc_id: len(r.draws) for r in got if r.draws})
    sizes = Counter(r.shard for r in out)
    assert len(sizes) == 7 and max(sizes.values()) < 2 * min(sizes.values())
    assert mixing.mix_draws(df.limit(0)).count() == 0


def test_mix_is_counted_back_from_its_rows(spark):
    rng = random.Random(6)
    rows = [(k // 2, f"s{k % 40 // 2 % 3}", text_of(rng, 9)) for k in range(400)] + [(7, "s1", "same text")] * 3 + [(None, None, None), (None, None, "a b"), (8, "only", "")]
    drawn = mixing.mix_draws(spark.createDataFrame(rows, "doc_id long, source string, text string"), key=F.struct("doc_id"))
    drawn = drawn.withColumn("text_hash", F.xxhash64("text")).cache()
    by = ["doc_id", "text_hash", "size", "source_size", "target"]
    mix = mixing.mixed(drawn, by)
    got = Counter((r.doc_id, r.text_hash, r.taken, r.shards) for r in mixing.counted_back(drawn, mix, by).collect())
    bits = lambda r: sum({1 << d.shard for d in r.draws})
    assert got == Counter((r.doc_id, r.text_hash, r.size * len(r.draws), bits(r)) for r in drawn.collect()) and sum(got.values()) == len(rows)
    # rows that are missing from the mix are missing from the count
    some = mix.where("shard < 4")
    assert sum(r.taken * n for r, n in Counter(mixing.counted_back(drawn, some, by).collect()).items()) == some.agg(F.sum("size")).first()[0]


def test_mix_of_many_sources(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("source "), F.col("id") % 12_000).alias("source"), F.lit("a b c").alias("text"))
    got = mixing.mix_draws(df, key=F.struct("doc_id")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("s"), F.sum(F.size("draws") * F.col("size")).alias("t")).first()
    assert (got.n, got.s) == (30_000, 12_000) and abs(got.t - 90_000) < 9000


# --------------------------------------------------------------------- models

def test_language_model(spark):
    rng = random.Random(1)
    vocab = {"aa": ["kala", "mato", "suka", "niva"], "bb": ["thorn", "brick", "wrong", "strength"], "cc": ["été", "où", "çeau", "île"]}
    rows = [(" ".join(rng.choice(vocab[lang]) for _ in range(rng.randint(3, 40))), lang) for _ in range(400) for lang in vocab]
    m = langid.train(*zip(*rows[:900], strict=True))
    assert sum(m.predict(t)[0] == y for t, y in rows[900:]) >= 0.98 * 300
    df = documents(spark, ["kala mato", None, "", "123 !!", "thorn " * 20_000, "kala mato"]).withColumn("lang_pred0", F.lit(1))
    got = {r.doc_id: r for r in langid.detect_language(df, m).collect()}
    assert [got[k].lang_pred for k in range(6)] == ["aa", "und", "und", "und", "bb", "aa"] and got[0].score == got[5].score
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1].score == 0 and not got[1].accepted
    assert langid.train([], []).predict("abc") == ("und", 0.0, False)
    assert langid.detect_language(df.limit(0), m).count() == 0


def test_training_sample_has_every_language(spark):
    rows = [(f"text {k} {n}", f"lang{k}") for k in range(230) for n in range(3 if k < 229 else 1)]
    df = spark.createDataFrame(rows + [(None, "lang0"), ("text", None)], "text string, lang string")
    got = langid.training_sample(df, "text", "lang", 5)
    assert sorted((t, y) for _, t, y in got) == sorted(rows)


def test_training_samples_are_bounded_and_do_not_depend_on_the_run(spark):
    rows = [(k, f"copy {'x' * 1000}" if k % 3 == 0 else f"text {k} {'y' * 1000}", "a") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = langid.training_sample(df, "text", "lang", 200), langid.training_sample(df.repartition(7), "text", "lang", 200)
    assert a == b and len(a) == 200 and sum(t.startswith("copy") for _, t, _ in a) <= 1
    assert len(langid.training_sample(df, "text", "lang", 200, most_bytes=10_000)) == 10
    assert langid.training_sample(df.limit(0), "text", "lang", 5) == []
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).unionByName(spark.createDataFrame([(None, 1), (5, None), (0, 1)], "doc_id long, quality int"))
    twice = df.unionByName(df.select("doc_id", F.lit("another").alias("text"), "lang"))
    one, prior = crf.labelled_sample(twice, labels, F.lit(True), per_label=50)
    again, _ = crf.labelled_sample(twice.repartition(5), labels.repartition(3), F.lit(True), per_label=50)
    assert one == again and len(one) == 100 and 0.49 < prior < 0.51 and {t for t, _ in one} == {b"another"}
    assert len(crf.labelled_sample(df, labels, F.lit(True), per_label=50, most_bytes=5000)[0]) == 10
    assert crf.labelled_sample(df.limit(0), labels, F.lit(True))[0] == [] and crf.labelled_sample(df, labels.limit(0), F.lit(True)) == ([], 0.5)


def test_models_replace_columns_of_their_names(spark):
    df = documents(spark, ["kala", None]).withColumns({"score": F.lit(7), "lang_pred": F.lit("x")})
    got = langid.detect_language(df, langid.train([], []))
    assert got.columns == ["doc_id", "lang_pred", "score", "accepted"] and {r.score for r in got.collect()} == {0.0}
    assert crf.score_quality(df, crf.train([], [])).columns == ["doc_id", "text", "lang_pred", "score"]


def test_likelihood_and_its_gradient_agree():
    """The gradient that training follows is that of the weighted likelihood, by finite differences."""
    rng = np.random.default_rng(6)
    per_text, weight = np.array([3, 1, 5]), np.array([0.5, 2.0, 1.2])
    unary, pair, gold = rng.standard_normal(9), rng.standard_normal((2, 2)), np.array([1, 1, 1, 0, 1, 1, 1, 1, 1])
    ends = np.cumsum(per_text)

    def likelihood(u, p):
        log_z = crf.forward_backward(u, per_text, p)[2]
        total = 0.0
        for k, (end, n) in enumerate(zip(ends, per_text, strict=True)):
            y = gold[end - n : end]
            total += weight[k] * (u[end - n : end] @ y + sum(p[y[i], y[i + 1]] for i in range(n - 1)) - log_z[k])
        return total

    good, pairs, _ = crf.forward_backward(unary, per_text, pair, weight)
    by_unary = (gold - good) * np.repeat(weight, per_text)
    want = np.zeros((2, 2))
    for k, (end, n) in enumerate(zip(ends, per_text, strict=True)):
        for a, b in zip(gold[end - n : end], gold[end - n + 1 : end], strict=False):
            want[a, b] += weight[k]
    step = 1e-6
    for i in range(9):
        d = np.eye(9)[i] * step
        assert (likelihood(unary + d, pair) - likelihood(unary - d, pair)) / (2 * step) == pytest.approx(by_unary[i], abs=1e-6)
    for a in (0, 1):
        for b in (0, 1):
            d = np.zeros((2, 2))
            d[a, b] = step
            assert (likelihood(unary, pair + d) - likelihood(unary, pair - d)) / (2 * step) == pytest.approx((want - pairs)[a, b], abs=1e-6)


def test_subwords_ignore_case_and_signs():
    assert sorted(langid.subwords("Ab c")) == sorted(langid.subwords("  aB,, C ")) and len(langid.subwords("12 !")) == 0
    assert len(langid.subwords("a")) == 4  # a, _a, a_, _a_


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(3)
    per_text = np.array([1, 4, 3, 1, 6])
    unary, pair = rng.standard_normal(per_text.sum()), rng.standard_normal((2, 2))
    good, pairs, log_z = crf.forward_backward(unary, per_text, pair)
    at, want_pairs = 0, np.zeros((2, 2))
    for k, n in enumerate(per_text):
        u, total, on, both = unary[at : at + n], 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(1 << n):
            y = [(code >> i) & 1 for i in range(n)]
            w = np.exp(sum(u[i] * y[i] for i in range(n)) + sum(pair[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            on += w * np.array(y)
            for i in range(n - 1):
                both[y[i], y[i + 1]] += w
        assert np.allclose(good[at : at + n], on / total) and np.isclose(log_z[k], np.log(total))
        want_pairs += both / total
        at += n
    assert np.allclose(pairs, want_pairs)


def test_quality_model(spark):
    rng = random.Random(2)
    fine = lambda: "\n".join(text_of(rng, rng.randint(4, 20)).capitalize() + "." for _ in range(rng.randint(1, 8)))
    poor = lambda: "\n".join(" ".join(rng.choice(WORDS) + rng.choice(["***", "$$$"]) for _ in range(rng.randint(4, 20))) for _ in range(rng.randint(1, 8)))
    rows = [(fine().encode(), 1) if rng.random() < 0.8 else (poor().encode(), 0) for _ in range(900)]
    m = crf.train([t for t, _ in rows[:600]], [y for _, y in rows[:600]], 0.8)
    score = np.concatenate([m.score([t]) for t, _ in rows[600:]])
    assert ((score >= 0.7) == np.array([y for _, y in rows[600:]])).mean() >= 0.98
    assert np.allclose(score, m.score([t for t, _ in rows[600:]]))
    df = documents(spark, [None, "", "\n\n", rows[0][0].decode(), "a" * 700_000]).withColumn("__x", F.lit(1))
    got = {r.doc_id: r.score for r in crf.score_quality(df, m).collect()}
    assert got[0] == got[1] and all(0 <= s <= 1 for s in got.values())
    assert set(crf.train([b"x"], [1]).score([b"a", b""])) == {1.0}
    assert crf.score_quality(df.limit(0), m).count() == 0



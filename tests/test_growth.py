"""What keeps queries in proportion to their input: work done where a file is, without a sort or a
shuffle of its rows; bounded batches; the same results as before by every way."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant import pdfs_of
from foliant.fixtures import pdfgen as g
from foliant.grammar.objects import Hex, Name, Reader, Ref, Str
from foliant.operators import collection
from foliant.operators.collection import Made, Pdfs, listing
from foliant.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _revised() -> bytes:
    p = g.Pdf("1.5").revision({1: b"<< /Type /Catalog >>", 9: b"(nine)", 12: b"(twelve)"}, b"/Root 1 0 R /Info 9 0 R")
    return p.revision({12: b"[9 0 R]"}, b"/Root 1 0 R /Info 12 0 R", free=(9,), xref="hybrid", packed={5: b"(x)", 20: b"7"}).bytes()


def _files(spark, *made: tuple[str, bytes]):
    return pdfs_of(spark.createDataFrame([(p, bytearray(d)) for p, d in made], "path string, content binary"))


def test_listing_in_place(spark):
    """The lines of a sorted table of entries, without its sort; F1."""
    pdfs = _files(spark, ("a-1", _revised()), ("b-2", _revised()), ("c-3", b"%PDF-1.4 broken"))
    want = [tuple(r) for r in listing(pdfs.xref()).collect()]
    rows = [tuple(r) for r in pdfs.listing().collect()]
    assert sorted(rows) == want and len(want) > 10
    for path in ("a-1", "b-2"):
        assert [r for r in rows if r[0] == path] == [r for r in want if r[0] == path]


@pytest.mark.parametrize("name", ["xref_listing", "reachable_objects", "reach_chain", "incremental_trailer"])
def test_no_sort_or_aggregate(spark, name):
    """rows of a file are put together where it is read."""
    plan = _plan(QUERIES[name](spark, DIR))
    assert "Sort" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("name", ["xref_listing", "reachable_objects", "reach_chain", "content_tokens", "dict_values", "deref_aggregate", "content_sequence"])
def test_dealt_out(spark, name):
    """Rows that each become a file are dealt to all cores, not left in the one part of a small table."""
    assert "Repartition" in _plan(QUERIES[name](spark, DIR))


@pytest.mark.parametrize("name", ["xref_listing", "reachable_objects", "content_tokens", "operators_with_operands", "operators_of_stored_tokens"])
def test_one_worker_for_a_task(spark, name):
    """files are made, read and decoded by one Python worker, not by up to four."""
    plan = _plan(QUERIES[name](spark, DIR))
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan


def test_walk_by_file(spark):
    pdfs = _files(spark, ("a", g.page_file(g.stream(b""), extra={5: b"<< /A <12 >>", 6: b"[5 0 R]"})), ("b", _revised()), ("c", b"%PDF-1.4 broken"))
    want: dict = {}
    for r in pdfs.reachable().collect():
        want.setdefault(r["path"], []).append(r)
    for r in pdfs.reachable_by_file().collect():
        rows = want.pop(r["path"])
        if r["error"] is not None:
            assert [x["obj_num"] for x in rows] == [None]
            continue
        assert r["objects"] == [x["obj_num"] for x in rows]
        assert r["failed"] == [x["obj_num"] for x in rows if x["error"] is not None]
    assert not want


def test_made_files(spark):
    """Files made where they are read are those of a table."""
    rows = spark.range(40).withColumnRenamed("id", "k")
    make = lambda r: (f"f-{r['k']}", g.page_file(g.filtered(b"q %d Td Q" % r["k"], "FlateDecode"), extra={5: b"(%d)" % r["k"]}))
    made, stored = Pdfs(Made(rows, make)), Pdfs(g.generate(rows, make))
    for table in (lambda p: p.objects(raw=False).select("path", "obj_num", F.to_json("value")), lambda p: p.operators([4]), lambda p: p.headers(), lambda p: p.trailer().select("path", "key", F.to_json("value"))):
        assert sorted(map(repr, table(made).collect())) == sorted(map(repr, table(stored).collect()))


def test_batches_close_early():
    """F3 to F6: what a worker holds is a few MB, whatever the size of the table."""
    assert collection.BATCH_BYTES <= 4 << 20 and collection.OUT_BYTES <= 4 << 20


def test_flat_values_by_one_match():
    """Plain dictionaries and arrays are read by one match; others token by token, alike."""
    flat = b"<< /A 1 /B -2 /C 12 0 R /D /N /E (a>b) /F <414> /G 1.5 /H true /I null /A 3 >>"
    want = {"A": 3, "B": -2, "C": Ref(12, 0), "D": Name("N"), "E": Str(b"a>b"), "F": Hex(b"414"), "G": 1.5, "H": True, "I": None}
    assert Reader(flat).read() == Reader(flat.replace(b" /G", b" % ]\n /G")).read() == want
    assert Reader(b"[1 0 R 2 3 (x) /N]").read() == Reader(b"[1 0 R 2 3 (x)% )\n /N]").read() == [Ref(1, 0), 2, 3, Str(b"x"), Name("N")]


def test_built_column():
    """Arrays of tokens are made column by column."""
    schema = pa.schema([("tokens", pa.list_(pa.int32()))])
    assert collection._batch([(b"a",), (b"bb",)], schema, {"tokens": lambda c: pa.array([[len(x)] for x in c], pa.list_(pa.int32()))}).column(0).to_pylist() == [[1], [2]]


def test_aes_tables():
    """a round of AES is one look into tables; the vectors of FIPS 197."""
    import numpy as np

    from foliant.functions import ciphers

    plain, back = np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), np.uint8)[None], ciphers._back_tables
    for size, sealed in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (24, "dda97ca4864cdfe06eaf70a0ec0d7191"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        block = np.frombuffer(bytes.fromhex(sealed), np.uint8)[None]
        assert (ciphers.decrypt_blocks(block, bytes(range(size))) == plain).all()
        assert (ciphers.encrypt_blocks(plain, bytes(range(size))) == block).all()
    assert back()[0].shape == (1024,)


def test_security_derived_once(monkeypatch):
    """F11, F16: equal encryption dictionaries are opened once, different ones apart."""
    from foliant.functions import ciphers

    calls = []
    monkeypatch.setattr(ciphers, "_KNOWN", {})
    monkeypatch.setattr(ciphers, "open_security", lambda *a: calls.append(a) or object())
    e = {"V": 2, "O": Str(b"41"), "CF": {"A": [1]}}
    assert ciphers.security_of(e, b"i", b"p") is ciphers.security_of(dict(e), b"i", bytearray(b"p"))
    for other in (({**e, "O": Hex(b"41")}, b"i", b"p"), (e, b"j", b"p"), (e, b"i", "p"), ({**e, "CF": {"A": [True]}}, b"i", b"p")):
        ciphers.security_of(*other)
    assert len(calls) == 5

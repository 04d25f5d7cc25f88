"""Files: revisions, cross-reference kinds, errors, pages, tables, sources and streams."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foliant import Pdfs, PDFSyntaxError, parse_sequence, pdfs_of, read_pdfs, register_filter, register_source, stream_pdfs
from foliant.fixtures import pdfgen as g
from foliant.functions import columns
from foliant.functions.filters import FILTERS
from foliant.grammar.file import PdfFile
from foliant.grammar.objects import Name, Ref, Str
from foliant.operators import freed, latest, listing, operator_groups

ROOT = b"/Root 1 0 R"


def collection(spark, *files, **options):
    return Pdfs(spark.createDataFrame([(f"f-{k}", f) for k, f in enumerate(files)], "path string, content binary"), **options)


def test_revisions_newest_counts():
    p = g.Pdf().revision({1: b"<< >>", 2: b"(old)", 3: b"(gone)"}, ROOT + b" /Info 2 0 R")
    p.revision({2: b"(new)"}, ROOT + b" /Info 3 0 R", free=(3,))
    f = PdfFile(p.bytes())
    assert f.object(2) == Str(b"new") and f.object(3) is None and f.object(99) is None
    assert f.trailer["Info"] == Ref(3, 0) and [s.rev for s in f.sections] == [0, 1]


@pytest.mark.parametrize("kind", ["stream", "hybrid"])
def test_packed_objects(kind):
    f = PdfFile(g.Pdf("1.5").revision({1: b"<< >>"}, ROOT, xref=kind, packed={5: b"(a)", 6: b"[1 2 3]", 7: b"/N"}).bytes())
    assert [f.object(n) for n in (5, 6, 7)] == [Str(b"a"), [1, 2, 3], Name("N")]


def test_table_counts_before_the_stream_of_a_hybrid_file():
    p = g.Pdf("1.5").revision({1: b"<< >>", 5: b"(table)"}, ROOT, xref="hybrid", packed={6: b"(packed)"})
    assert PdfFile(p.bytes()).object(5) == Str(b"table") and PdfFile(p.bytes()).object(6) == Str(b"packed")


def test_loops_and_broken_chains_are_errors():
    p = g.Pdf().revision({1: b"<< >>"}, ROOT)
    loop = p.bytes().replace(b"/Root 1 0 R", b"/Root 1 0 R /Prev %d" % p.prev)
    for data in (loop, b"%PDF-1.4\n", b"", p.bytes().replace(b"trailer", b"tr"), p.bytes().replace(b" 00000 n", b" 00000 x")):
        with pytest.raises(PDFSyntaxError):
            PdfFile(data)


def test_tables_of_a_collection(spark):
    c = collection(spark, g.Pdf().revision({1: b"<< /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] >>", 3: b"<< /Type /Page /Contents [5 0 R 6 0 R] >>", 4: b"<< /Type /Page >>", 5: g.filtered(b"q", "FlateDecode"), 6: g.stream(b"Q")}, ROOT).revision({}, ROOT, free=(9,)).bytes())
    assert c.headers().collect()[0].version == "PDF-1.4"
    assert [tuple(r) for r in c.sections().select("rev", "kind").orderBy("rev").collect()] == [(0, "table"), (1, "table")]
    assert c.xref(live=True).count() == 6 and latest(c.xref()).count() == 6 and freed(c.xref()).count() == 0
    assert {r.key for r in c.trailer().collect()} == {"Root", "Size", "Prev"}
    assert [r.line for r in listing(c.xref()).collect()][:2] == ["9 1 free", "1 0 at 15"]
    pages = {r.page_no: bytes(r.content) for r in c.page_contents().collect()}
    assert pages == {0: b"q\nQ", 1: b""}
    assert c.objects([5]).count() == 1
    assert {r.obj_num for r in c.reachable().collect()} == {1, 2, 3, 4, 5, 6}


def test_reachable_follows_long_chains_and_loops(spark):
    chain = {n: f"<< /Next {n + 1} 0 R >>".encode() for n in range(1, 300)}
    c = collection(spark, g.Pdf().revision(chain | {300: b"<< /Next 1 0 R >>", 301: b"<< /Next 1 0 R >>"}, ROOT).bytes())
    got = [r.obj_num for r in c.reachable().collect()]
    assert sorted(got) == list(range(1, 301))


def test_page_tree_loop_is_an_error_row(spark):
    c = collection(spark, g.Pdf().revision({1: b"<< /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [2 0 R] >>"}, ROOT).bytes())
    (row,) = c.pages().collect()
    assert row.error["class"] == "PDFSyntaxError"


def test_modes(spark):
    good, bad = g.page_file(g.stream(b"ok")), b"nothing"
    assert sorted(r.path for r in collection(spark, good, bad).objects().where("error is not null").collect()) == ["f-1"]
    assert collection(spark, good, bad, mode="DROPMALFORMED").objects().count() == 4
    with pytest.raises(PySparkException):
        collection(spark, good, bad, mode="FAILFAST").objects().collect()
    with pytest.raises(ValueError):
        collection(spark, good, mode="LENIENT")


def test_null_content_gives_no_rows(spark):
    df = spark.createDataFrame([("a", None), ("b", bytearray(g.page_file(g.stream(b"x"))))], "path string, content binary")
    assert Pdfs(df).objects().select("path").distinct().collect()[0].path == "b"


def test_resolution(spark):
    c = collection(spark, g.page_file(g.stream(b""), extra={5: b"6 0 R", 6: b"(t)", 7: b"99 0 R"}))
    refs = c.nodes().where("obj_num in (5, 7)").select("path", "obj_num", F.struct("ref_num", "ref_gen").alias("ref"))
    got = {r.obj_num: r.target for r in c.resolve(refs, "ref").collect()}
    assert (got[5].tag, got[5].status) == ("string", "found") and (got[7].tag, got[7].status) == (None, "missing")


def test_external_files_are_not_supported(spark):
    c = collection(spark, g.page_file(g.stream(b"x", b"/F (other)")))
    assert c.objects([4]).collect()[0].error["class"] == "PDFUnsupportedError"


def test_decoding_is_dropped_when_not_selected(spark):
    plan = collection(spark, g.page_file(g.stream(b"x"))).streams().select("path", "obj_num")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_own_filter(spark):
    register_filter("Reverse", lambda d, p: d[::-1])
    try:
        assert bytes(collection(spark, g.page_file(g.stream(b"abc", b"/Filter /Reverse"))).streams().collect()[0].decoded) == b"cba"
    finally:
        del FILTERS["Reverse"]


def test_crypt_filter_of_a_stream(spark):
    """Identity by name leaves a stream of a locked file as it is."""
    o, u, _ = g.legacy_keys(b"", b"", b"id", 4, 16)
    trailer = ROOT + b" /ID [<6964> <00>] /Encrypt << /Filter /Standard /V 4 /R 4 /Length 128 /P -4 /O <" + o.hex().encode() + b"> /U <" + u.hex().encode() + b"> /CF << /S << /CFM /V2 >> >> /StmF /S /StrF /S >>"
    body = g.stream(b"open", b"/Filter /Crypt /DecodeParms << /Name /Identity >>")
    c = collection(spark, g.Pdf().revision({1: b"<< >>", 4: body}, trailer).bytes())
    assert bytes(c.streams().collect()[0].decoded) == b"open"


def test_operator_groups(spark):
    c = collection(spark, g.page_file(g.stream(b"1 2 m (x) Tj")))
    rows = operator_groups(c.tokens()).orderBy("group_no").collect()
    assert [(r.operator, r.operands) for r in rows] == [("m", ["1", "2"]), ("Tj", ["x"])]


def test_sql_functions(spark):
    columns.register(spark)
    got = spark.sql("SELECT t.tag FROM VALUES (CAST('1 (a) Tj' AS BINARY)) v(b), LATERAL pdf_tokens(b) t ORDER BY t.seq").collect()
    assert [r.tag for r in got] == ["integer", "string", "operator"]
    assert spark.sql("SELECT pdf_node_array(CAST('[1 /N]' AS BINARY)) n").collect()[0].n[2].name_val == "N"
    assert bytes(spark.sql("SELECT pdf_rc4(CAST('Hello world!' AS BINARY), CAST('123456' AS BINARY)) x").collect()[0].x).hex() == "489d120b4b1362f30d5b4697"


def test_aes_columns(spark):
    key, iv = bytes.fromhex("603deb1015ca71be2b73aef0857d77811f352c073b6108d72d9810a30914dff4"), bytes(range(16))
    plain = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51")  # NIST SP 800-38A, F.2.5
    df = spark.range(1).select(columns.aes_cbc_encrypt(F.lit(plain), F.lit(key), F.lit(iv), padding=False).alias("x"))
    assert bytes(df.collect()[0].x)[16:].hex() == "f58c4c04d6e5f1ba779eabfb5f7bfbd69cfc4e967edb808d679f777bc6702c7d"


def test_folder_source_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"a{k}.pdf").write_bytes(g.page_file(g.filtered(b"text %d" % k, "FlateDecode")))
    (folder / "other.txt").write_bytes(b"no")
    assert sorted(bytes(r.decoded) for r in read_pdfs(spark, str(folder)).streams().collect()) == [b"text 0", b"text 1", b"text 2"]
    register_source(spark)
    assert spark.read.format("pdfobjects").load(str(folder)).where("obj_num = 4").count() == 3
    q = stream_pdfs(spark, str(folder)).streams().select("path", "decoded").writeStream.format("memory").queryName("texts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert spark.table("texts").count() == 3


def test_table_with_other_column_names(spark):
    df = spark.createDataFrame([(7, bytearray(g.page_file(g.stream(b"x"))), "extra")], "id long, body binary, error string")
    assert pdfs_of(df, "id", "body").objects().where("path = '7'").count() == 4


def test_references_name_a_generation(spark):
    data = g.Pdf().revision({1: b"<< >>", 4: b"(a)", 5: b"(b)"}, ROOT, gens={5: 2}).revision({}, ROOT, free=(4,)).bytes()
    f = PdfFile(data)
    assert [f.find(Ref(*r))[0] for r in ((4, 0), (5, 2), (5, 0), (9, 0))] == ["free", "found", "generation", "missing"]
    assert [f.get(Ref(*r)) for r in ((4, 0), (5, 2), (5, 7), (9, 0))] == [None, Str(b"b"), None, None]
    c = collection(spark, g.page_file(g.stream(b""), extra={6: b"[4 7 R 4 0 R]"}))
    refs = c.nodes([6]).where("ref_num is not null").select("path", "pos", F.struct("ref_num", "ref_gen").alias("ref"))
    assert {r.pos: r.target.status for r in c.resolve(refs, "ref").collect()} == {0: "generation", 1: "found"}
    with pytest.raises(PySparkException):
        strict = collection(spark, g.page_file(g.stream(b""), extra={6: b"[4 7 R]"}), mode="FAILFAST")
        strict.resolve(refs, "ref").select("path", "target.status").collect()


def test_old_generations_are_found_as_long_as_they_are_not_free(spark):
    f = PdfFile(g.Pdf().revision({1: b"<< >>", 4: b"(old)"}, ROOT).revision({4: b"(new)"}, ROOT, gens={4: 1}).bytes())
    assert (f.get(Ref(4, 0)), f.get(Ref(4, 1)), f.object(4)) == (Str(b"old"), Str(b"new"), Str(b"new"))


def test_follow_paths_through_references(spark):
    c = collection(spark, g.page_file(g.stream(b"x", b"/Extra 6 0 R"), extra={6: b"<< /Deep 7 0 R >>", 7: b"<< /End 8 0 R >>", 8: b"[1 2]"}))
    (r,) = c.objects([4], raw=False, follow={"end": "Extra.Deep.End", "none": "Extra.Nothing", "far": "Extra.Deep"}).collect()
    assert (r.end.status, r.end.obj_num, r.end.tag, r.end.value.toPython()) == ("found", 8, "array", [1, 2])
    assert r.none.status == "absent" and r.none.value is None and r.far.obj_num == 7
    assert "stream_raw" not in c.objects([4], raw=False).columns
    broken = collection(spark, g.page_file(b"<< /To 99 0 R >>"), mode="FAILFAST")
    with pytest.raises(PySparkException):
        broken.objects([4], raw=False, follow={"to": "To"}).select("path").collect()


@pytest.mark.parametrize("table", ["objects", "pages", "page_contents", "nodes", "edges", "reachable", "sections", "xref", "trailer", "tokens", "freed"])
def test_strict_mode_fails_whatever_is_selected(spark, table):
    good, bad = g.page_file(g.stream(b"ok")), b"nothing"
    with pytest.raises(PySparkException):
        getattr(collection(spark, good, bad, mode="FAILFAST"), table)().select("path").collect()
    getattr(collection(spark, good, bad, mode="DROPMALFORMED"), table)().select("path").collect()
    getattr(collection(spark, good, bad), table)().select("path").collect()


def test_broken_objects_have_rows_in_every_table(spark):
    c = collection(spark, g.Pdf().revision({1: b"<< /Pages 2 0 R >>", 2: b"<< /A <12 >>"}, ROOT).bytes(), b"nothing")
    assert {(r.path, r.obj_num) for r in c.nodes().where("error is not null").collect()} == {("f-0", 2), ("f-1", None)}
    got = {(r.path, r.obj_num): r.error and r.error["class"] for r in c.reachable().collect()}
    assert got == {("f-0", 1): None, ("f-0", 2): "PDFLexicalError", ("f-1", None): "PDFSyntaxError"}


def test_a_subtree_of_two_parents_is_no_loop(spark):
    kids = {1: b"<< /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 3 0 R 4 0 R] >>", 3: b"<< /Type /Pages /Kids [5 0 R] >>", 4: b"<< /Type /Pages /Kids [3 0 R] >>", 5: b"<< /Type /Page >>"}
    rows = collection(spark, g.Pdf().revision(kids, ROOT).bytes()).pages().orderBy("page_no").collect()
    assert [(r.page_no, r.obj_num, r.error) for r in rows] == [(0, 5, None), (1, 5, None), (2, 5, None)]


def test_long_first_line(spark):
    line = b"%PDF-1.4" + b"x" * 5000
    assert collection(spark, line + b"\n" + b"rest", line).headers().select("version").distinct().collect()[0].version == line[1:].decode()


def test_context_size(spark):
    data = g.page_file(b"<< /A <12 " + b"x" * 500 + b" >>")
    size = lambda n: len(collection(spark, data, context_size=n).objects([4]).collect()[0].error.context)
    assert (size(200), size(20)) == (200, 20)


def test_stream_reader():
    data = b"<< /Length 9 0 R >> stream\nabc\nendstream 7"
    with pytest.raises(PDFSyntaxError):
        list(parse_sequence(data))
    stream, after = parse_sequence(data, stream_reader=lambda d: 3 if d["Length"] == Ref(9, 0) else 0)
    assert stream.raw == b"abc" and after == 7


def test_data_source_gives_what_decoding_needs(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(g.page_file(g.filtered(b"text", "FlateDecode")))
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    register_source(spark)
    load = lambda mode: spark.read.format("pdfobjects").option("mode", mode).load(str(tmp_path))
    rows = load("PERMISSIVE")
    s = rows.where("tag = 'stream'").select(columns.pdf_decode(*(F.col(c) for c in ("stream_raw", "filters", "parms", "cipher", "cipher_key")))["data"].alias("d"))
    assert bytes(s.collect()[0].d) == b"text" and rows.where("error is not null").count() == 1
    assert load("DROPMALFORMED").count() == 4
    with pytest.raises(PySparkException):
        load("FAILFAST").select("path").collect()


def test_page_contents_with_a_broken_part(spark):
    data = g.Pdf().revision({1: b"<< /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] >>", 3: b"<< /Type /Page /Contents [4 0 R 5 0 R 9 0 R] >>", 4: g.stream(b"q"), 5: g.stream(b"x", b"/Filter /FlateDecode")}, ROOT).bytes()
    (r,) = collection(spark, data).page_contents().collect()
    assert bytes(r.content) == b"q\n\n" and r.error["class"] == "PDFGenericError"

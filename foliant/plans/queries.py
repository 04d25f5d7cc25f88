"""Queries over PDF files made from tables, each with the SQL that gives the same rows
from the tables alone. Every query writes its files in memory, one for each row or
group of a whole table, and reads them with the engine."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import pdfgen as g
from ..functions import columns
from ..functions.filters import register_filter
from ..operators.collection import Made, Pdfs, freed, operator_groups
from ..operators.collection import latest as latest_entries
from ..shared import shared_dir
from ..sources.files import read_pdfs, register_source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(path: str | Column = "path") -> Column:
    return F.substring_index(F.col(path) if isinstance(path, str) else path, "-", -1).cast("bigint")


def _utf8(c: str | Column) -> Column:
    return F.decode(F.col(c) if isinstance(c, str) else c, "UTF-8")


def _raw(text: str | None) -> bytes:
    return (text or "").encode()


def _dealt(rows: DataFrame) -> DataFrame:
    """Short rows, of which many fit one part of a table, dealt out to all cores: each becomes a file."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def _documents(spark: SparkSession, sf_dir: str, make: Callable[[dict], bytes], password: str | bytes | None = None, *more: Column) -> Pdfs:
    """A file for each document, by a function of doc_id and text (and more columns)."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text", *more)
    return Pdfs(Made(rows, lambda r: (f"doc-{r['doc_id']}", make(r))), password)


def _page_text(pdfs: Pdfs, number: int = 4) -> DataFrame:
    """doc_id, text of the decoded stream with that number."""
    return pdfs.streams([number]).select(_key().alias("doc_id"), _utf8("decoded").alias("text"))


TEXT_SQL = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


# --------------------------------------------------------------- files, pages

@query(TEXT_SQL)
def first_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From trailer to catalog to page tree to contents to bytes."""
    pdfs = _documents(spark, sf_dir, lambda r: g.page_file(g.filtered(_raw(r["text"]), "FlateDecode")))
    return pdfs.page_contents().where("page_no = 0").select(_key().alias("doc_id"), _utf8("content").alias("text"))


@query("SELECT doc_id, 'PDF-1.' || (doc_id % 8) AS version FROM documents")
def header_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = _documents(spark, sf_dir, lambda r: g.page_file(g.stream(_raw(r["text"])), f"1.{r['doc_id'] % 8}"))
    return pdfs.headers().select(_key().alias("doc_id"), "version")


def _filter_query(name: str, *filters: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _page_text(_documents(spark, sf_dir, lambda r: g.page_file(g.filtered(_raw(r["text"]), *filters))))

    run.__name__ = name
    query(TEXT_SQL)(run)


_filter_query("plain_text")
_filter_query("flate_text", "FlateDecode")
_filter_query("ahx_text", "ASCIIHexDecode")
_filter_query("a85_text", "ASCII85Decode")
_filter_query("rl_text", "RunLengthDecode")
_filter_query("filter_chain_text", "ASCII85Decode", "RunLengthDecode", "FlateDecode")


def _filled(data: bytes, row: int) -> bytes:
    return data + b" " * (-len(data) % row)


@query("SELECT doc_id, doc_id % 5 AS row_type, rtrim(coalesce(text, ''), ' ') AS text FROM documents")
def png_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of 60 bytes, 3 a pixel, of one of the five types."""

    def make(r: dict) -> bytes:
        rows = g.png_rows(_filled(_raw(r["text"]), 60), 60, 3, r["doc_id"] % 5)
        return g.page_file(g.filtered(rows, "FlateDecode", extra=b"/DecodeParms << /Predictor %d /Colors 3 /Columns 20 >>" % (10 + r["doc_id"] % 5)))

    t = _page_text(_documents(spark, sf_dir, make))
    return t.select("doc_id", (F.col("doc_id") % 5).alias("row_type"), F.rtrim("text").alias("text"))


@query("SELECT doc_id, rtrim(coalesce(text, ''), ' ') AS text FROM documents")
def tiff_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = lambda r: g.page_file(g.filtered(g.tiff_rows(_filled(_raw(r["text"]), 40), 40, 4), "FlateDecode", extra=b"/DecodeParms [<< /Predictor 2 /Colors 4 /Columns 10 >>]"))
    return _page_text(_documents(spark, sf_dir, make)).select("doc_id", F.rtrim("text").alias("text"))


@query(TEXT_SQL)
def indirect_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream lengths that are references to integers."""
    make = lambda r: g.page_file(g.stream(_raw(r["text"]), length=b"5 0 R"), extra={5: b"%d" % len(_raw(r["text"]))})
    return _page_text(_documents(spark, sf_dir, make))


# -------------------------------------------------------------------- lexemes

def _values(pdfs: Pdfs, number: int = 5) -> DataFrame:
    """Nodes of the object with that number."""
    return pdfs.nodes([number]).where(F.col("obj_num") == number)


@query("SELECT page_id, coalesce(html, '') AS html FROM pages")
def literal_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "pages").select("page_id", "html")
    pdfs = Pdfs(Made(rows, lambda r: (f"page-{r['page_id']}", g.page_file(g.stream(b""), extra={5: g.literal(_raw(r["html"]))}))))
    return _values(pdfs).where("tag = 'string'").select(_key().alias("page_id"), _utf8("bytes_val").alias("html"))


@query("SELECT doc_id, coalesce(text, '') AS text, coalesce(hex(text), '') AS digits FROM documents")
def hex_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = _documents(spark, sf_dir, lambda r: g.page_file(g.stream(b""), extra={5: g.hexadecimal(_raw(r["text"]))}))
    return _values(pdfs).select(_key().alias("doc_id"), _utf8(columns.pdf_unhex(F.col("bytes_val"))).alias("text"), _utf8("bytes_val").alias("digits"))


@query("SELECT page_id, coalesce(url, '') AS url FROM pages")
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "pages").select("page_id", "url")
    pdfs = Pdfs(Made(rows, lambda r: (f"page-{r['page_id']}", g.page_file(g.stream(b""), extra={5: g.name(r["url"] or "")}))))
    return _values(pdfs).where("tag = 'name'").select(_key().alias("page_id"), F.col("name_val").alias("url"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, -l_discount AS discount FROM lineitem")
def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers and reals of all lines of an order, as arrays in an array."""
    line = F.struct("l_linenumber", "l_partkey", F.format_string("%.2f", "l_quantity").alias("q"), F.format_string("%.2f", "l_extendedprice").alias("p"), F.format_string("-.%02d", F.round(F.col("l_discount") * 100).cast("int")).alias("d"))
    orders = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))

    def make(r: dict) -> tuple[str, bytes]:
        body = b"[" + b"\n".join(f"[{x['l_linenumber']} +{x['l_partkey']} {x['q']} {x['p']} {x['d']}]".encode() for x in r["lines"]) + b"]"
        return f"order-{r['l_orderkey']}", g.page_file(g.stream(b""), extra={5: body})

    n = _values(Pdfs(Made(orders, make))).where("tag in ('integer', 'real')")
    pick = lambda pos, c: F.max(F.when(F.col("pos") == pos, F.col(c)))
    lines = n.groupBy("path", "parent_id").agg(pick(0, "long_val").cast("int").alias("l_linenumber"), pick(1, "long_val").alias("l_partkey"), pick(2, "double_val").alias("l_quantity"), pick(3, "double_val").alias("l_extendedprice"), pick(4, "double_val").alias("discount"))
    return lines.select(_key().alias("l_orderkey"), "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "discount")


@query("SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id FROM events")
def dict_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionaries with a nested one and a key given twice, read as VARIANT."""
    rows = _table(spark, sf_dir, "events").select("event_id", "event_type", F.format_string("%.6f", "value").alias("shown"), "value", F.get_json_object("props", "$.k").alias("k"), "user_id")

    def make(r: dict) -> tuple[str, bytes]:
        body = b"<< /Value 0 /Type " + g.name(r["event_type"]) + f" /Value {r['value']:f} /Props << /k {r['k']} /u null >> /User {r['user_id']} >>".encode()
        return f"event-{r['event_id']}", g.page_file(g.stream(b""), extra={5: body})

    exact = rows.select("event_id", "event_type", "value", "k", "user_id")
    o = Pdfs(Made(_dealt(exact), make)).objects([5], raw=False)
    get = lambda p, t: F.variant_get("value", p, t)
    return o.select(_key().alias("event_id"), get("$.Type.v", "string").alias("event_type"), get("$.Value", "double").alias("value"), get("$.Props.k", "bigint").alias("k"), get("$.User", "bigint").alias("user_id"))


# ------------------------------------------------------------------ references

def _order_files(spark: SparkSession, sf_dir: str) -> Pdfs:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.format_string("%.2f", "o_totalprice").alias("price"))
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")

    def make(r: dict) -> tuple[str, bytes]:
        order = f"<< /Type /Order /Price {r['price']} /Customer 6 0 R >>".encode()
        customer = b"<< /Type /Customer /Name " + g.literal(_raw(r["c_name"])) + b" /Segment " + g.name(r["c_mktsegment"]) + b" >>"
        return f"order-{r['o_orderkey']}", g.page_file(g.stream(b""), extra={5: order, 6: customer})

    return Pdfs(Made(_dealt(orders.join(customers, "o_custkey")), make))


def _resolved_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the customers that they refer to, resolved where the file is."""
    o = _order_files(spark, sf_dir).objects([5], raw=False, follow={"customer": "Customer"})
    return o.select("path", F.variant_get("value", "$.Price", "double").alias("price"), "customer")


@query("SELECT o_orderkey, c_name, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def deref_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    get = lambda p: F.variant_get("customer.value", p, "string")
    return _resolved_orders(spark, sf_dir).select(_key().alias("o_orderkey"), F.decode(F.unbase64(get("$.Name.b64")), "UTF-8").alias("c_name"), get("$.Segment.v").alias("c_mktsegment"), F.col("price").alias("o_totalprice"))


@query("SELECT c_mktsegment AS segment, count(*) AS n, CAST(round(sum(o_totalprice), 2) AS DECIMAL(18, 2)) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def deref_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _resolved_orders(spark, sf_dir).select(F.variant_get("customer.value", "$.Segment.v", "string").alias("segment"), F.col("price").cast("decimal(18,2)").alias("price"))
    return r.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("price").cast("decimal(18,2)").alias("total"))


def _generation_file(r: dict) -> tuple[str, bytes]:
    """Object 6 is of generation 1; 5 refers to its generation 0, 1 or 2, and to one that isn't there."""
    k = r["c_custkey"]
    objects = {1: b"<< /Type /Catalog >>", 5: b"<< /To 6 %d R /Gone 99 0 R /In << /To 6 %d R >> >>" % (k % 3, k % 2), 6: b"<< /Name " + g.literal(_raw(r["c_name"])) + b" >>"}
    return f"customer-{k}", g.Pdf().revision(objects, b"/Root 1 0 R", gens={6: 1}).bytes()


GENERATION_SQL = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 'found' ELSE 'generation' END AS status, CASE WHEN c_custkey % 3 = 1 THEN c_name END AS name"


@query(GENERATION_SQL + ", 'missing' AS gone, CASE WHEN c_custkey % 2 = 1 THEN c_name END AS inner_name FROM customer")
def resolve_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References name a generation too; followed in the file, along paths of keys."""
    pdfs = Pdfs(Made(_dealt(_table(spark, sf_dir, "customer").select("c_custkey", "c_name")), _generation_file))
    o = pdfs.objects([5], raw=False, follow={"to": "To", "gone": "Gone", "inside": "In.To.Name"})
    name = lambda c, p: F.decode(F.unbase64(F.variant_get(F.col(f"{c}.value"), p, "string")), "UTF-8")
    return o.select(_key().alias("c_custkey"), F.col("to.status").alias("status"), name("to", "$.Name.b64").alias("name"), F.col("gone.status").alias("gone"), name("inside", "$.b64").alias("inner_name"))


@query(GENERATION_SQL + " FROM customer")
def resolve_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from stored references, by a join."""
    pdfs = Pdfs(Made(_dealt(_table(spark, sf_dir, "customer").select("c_custkey", "c_name")), _generation_file))
    refs = pdfs.nodes([5]).where("key = 'To' and parent_id = 0").select("path", F.struct("ref_num", "ref_gen").alias("ref"))
    r = pdfs.resolve(refs, "ref", numbers=[6])
    name = F.decode(F.unbase64(F.variant_get("target.value", "$.Name.b64", "string")), "UTF-8")
    return r.select(_key().alias("c_custkey"), F.col("target.status").alias("status"), name.alias("name"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'free' ELSE 'found' END AS status, CASE WHEN o_orderkey % 3 <> 0 THEN 'kept' END AS text FROM orders")
def freed_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to an object that a later revision frees."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey")

    def make(r: dict) -> tuple[str, bytes]:
        p = g.Pdf().revision({1: b"<< /Type /Catalog >>", 5: b"[6 0 R]", 6: b"(kept)", 7: b"<< /To 6 0 R >>"}, b"/Root 1 0 R")
        if r["o_orderkey"] % 3 == 0:
            p.revision({}, b"/Root 1 0 R", free=(6,))
        return f"order-{r['o_orderkey']}", p.bytes()

    o = Pdfs(Made(_dealt(rows), make)).objects([7], raw=False, follow={"to": "To"})
    return o.select(_key().alias("o_orderkey"), F.col("to.status").alias("status"), F.decode(F.unbase64(F.variant_get("to.value", "$.b64", "string")), "UTF-8").alias("text"))


@query("SELECT o_orderkey, CAST(6 + o_orderkey % 4 AS BIGINT) AS objects FROM orders JOIN customer ON o_custkey = c_custkey")
def reachable_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that the trailer leads to, over all references."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))

    def make(r: dict) -> tuple[str, bytes]:
        more = {10 + k: b"[%d 0 R 2 0 R]" % (11 + k) for k in range(r["o_orderkey"] % 4)}
        objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Order 5 0 R >>", 4: g.stream(b""), 5: b"[6 0 R 10 0 R]", 6: b"%d" % r["o_orderkey"], 7: b"(alone)"} | more
        return f"order-{r['o_orderkey']}", g.Pdf().revision(objects, b"/Root 1 0 R").bytes()

    found = Pdfs(Made(_dealt(orders.join(customers, "o_custkey")), make)).reachable_by_file()
    return found.select(_key().alias("o_orderkey"), F.size("objects").cast("bigint").alias("objects"))


@query("SELECT s_suppkey, CAST(250 + s_suppkey % 100 AS BIGINT) AS objects, CAST(0 AS BIGINT) AS errors FROM supplier")
def reach_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks of some hundred references, one after the other, that end in a loop."""

    def make(r: dict) -> tuple[str, bytes]:
        n = 250 + r["s_suppkey"] % 100
        chain = {k: b"<< /Next %d 0 R >>" % (k % n + 1) for k in range(1, n + 1)}
        return f"supplier-{r['s_suppkey']}", g.Pdf().revision(chain | {n + 1: b"(alone)"}, b"/Root 1 0 R").bytes()

    found = Pdfs(Made(_dealt(_table(spark, sf_dir, "supplier").select("s_suppkey")), make)).reachable_by_file()
    return found.select(_key().alias("s_suppkey"), F.size("objects").cast("bigint").alias("objects"), F.size("failed").cast("bigint").alias("errors"))


# ------------------------------------------------------------ cross references

def _order_revisions(spark: SparkSession, sf_dir: str) -> Pdfs:
    """Revision by revision: status O first, then the order's own; every third order's object 6 is freed."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")

    def make(r: dict) -> tuple[str, bytes]:
        root = b"/Root 1 0 R /Info 5 0 R"
        p = g.Pdf().revision({1: b"<< /Type /Catalog >>", 5: b"<< /Status (O) >>", 6: b"(kept)"}, root)
        p.revision({5: b"<< /Status " + g.literal(_raw(r["o_orderstatus"])) + b" /Priority " + g.literal(_raw(r["o_orderpriority"])) + b" >>"}, b"/Root 1 0 R /Info 5 0 R /Mark %d" % r["o_orderkey"])
        if r["o_orderkey"] % 3 == 0:
            p.revision({}, b"/Root 1 0 R /Info 1 0 R", free=(6,))
        return f"order-{r['o_orderkey']}", p.bytes()

    return Pdfs(Made(_dealt(rows), make))


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def xref_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    get = lambda k: F.decode(F.unbase64(F.variant_get("value", f"$.{k}.b64", "string")), "UTF-8")
    return _order_revisions(spark, sf_dir).objects([5]).select(_key().alias("o_orderkey"), get("Status").alias("o_orderstatus"), get("Priority").alias("o_orderpriority"))


@query("SELECT o_orderkey, 6 AS obj_num FROM orders WHERE o_orderkey % 3 = 0")
def xref_freed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects in use in some revision and free in the newest that has them."""
    return _order_revisions(spark, sf_dir).freed().select(_key().alias("o_orderkey"), "obj_num")


@query("SELECT o_orderkey, 6 AS obj_num FROM orders WHERE o_orderkey % 3 = 0")
def xref_freed_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a table of entries, by one aggregate."""
    return freed(_order_revisions(spark, sf_dir).xref()).select(_key().alias("o_orderkey"), "obj_num")


@query("SELECT o_orderkey, rev, CASE WHEN rev = (CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END) THEN 3 WHEN rev = 0 AND o_orderkey % 3 = 0 THEN 1 ELSE 1 END AS entries FROM orders, range(3) t(rev) WHERE rev < 2 OR o_orderkey % 3 = 0")
def xref_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of sections, newest first, and the entries of each."""
    s = _order_revisions(spark, sf_dir).sections(trailer=False)
    return s.select(_key().alias("o_orderkey"), F.col("rev").cast("bigint").alias("rev"), F.size("entries").alias("entries"))


@query("SELECT o_orderkey, 1 AS obj_num FROM orders UNION ALL SELECT o_orderkey, 5 FROM orders UNION ALL SELECT o_orderkey, 6 FROM orders WHERE o_orderkey % 3 <> 0")
def xref_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest entries over all revisions of a stored table."""
    return latest_entries(_order_revisions(spark, sf_dir).xref()).select(_key().alias("o_orderkey"), "obj_num")


@query("SELECT o_orderkey, 'Info' AS key, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 5 END AS ref, CAST(NULL AS BIGINT) AS num FROM orders UNION ALL SELECT o_orderkey, 'Root', 1, NULL FROM orders UNION ALL SELECT o_orderkey, 'Mark', NULL, o_orderkey FROM orders")
def incremental_trailer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailer keys over revisions: the newest counts."""
    t = _order_revisions(spark, sf_dir).trailer(["Info", "Root", "Mark"])
    return t.select(_key().alias("o_orderkey"), "key", F.when(F.col("tag") == "ref", F.variant_get("value", "$.n", "int")).alias("ref"), F.when(F.col("tag") == "integer", F.expr("try_variant_get(value, '$', 'bigint')")).alias("num"))


def _packed_query(name: str, xref: str) -> None:
    def make(r: dict) -> bytes:
        objects = {1: b"<< /Type /Catalog /Text 5 0 R >>", 4: g.stream(b"x")}
        packed = {5: g.literal(_raw(r["text"])), 6: b"%d" % r["doc_id"], 7: b"<< /Next 5 0 R >>"}
        if xref == "hybrid":
            return g.Pdf("1.5").revision(objects, b"/Root 1 0 R", xref=xref, packed=packed).bytes()
        return g.Pdf("1.5").revision(objects | ({} if packed and name == "object_stream" else packed), b"/Root 1 0 R", xref=xref, packed=packed if name == "object_stream" else None).bytes()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = _documents(spark, sf_dir, make).nodes([5, 6])
        pick = lambda num, c: F.max(F.when(F.col("obj_num") == num, F.col(c)))
        return n.groupBy("path").agg(pick(6, "long_val").alias("doc_id"), _utf8(pick(5, "bytes_val")).alias("text")).select("doc_id", "text")

    run.__name__ = name
    query(TEXT_SQL)(run)


_packed_query("xref_stream", "stream")
_packed_query("object_stream", "stream")
_packed_query("hybrid_xref", "hybrid")


@query("SELECT doc_id, CAST(4 + doc_id % 7 AS BIGINT) AS objects FROM documents")
def object_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = _documents(spark, sf_dir, lambda r: g.page_file(g.stream(b""), extra={10 + k: b"null" for k in range(r["doc_id"] % 7)}))
    return pdfs.xref(live=True).groupBy("path").count().select(_key().alias("doc_id"), F.col("count").alias("objects"))


@query("SELECT 'Catalog' AS type, count(*) AS n FROM documents UNION ALL SELECT 'Pages', count(*) FROM documents UNION ALL SELECT 'Page', count(*) FROM documents UNION ALL SELECT 'Lang' || lang, count(*) FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = lambda r: g.page_file(g.stream(b""), extra={5: b"<< /Type " + g.name("Lang" + r["lang"]) + b" >>"} if r["lang"] else None)
    n = _documents(spark, sf_dir, make, None, F.col("lang")).nodes().where("key = 'Type' and tag = 'name' and parent_id = 0")
    return n.groupBy(F.col("name_val").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN rev ELSE rev - 1 END AS rev, line
FROM orders, (VALUES (2, '1 0 at 15'), (2, '5 0 at 51'), (2, '6 0 at 84'), (1, '5 0 at 265'), (0, '6 1 free')) l(rev, line)
WHERE rev > 0 OR o_orderkey % 3 = 0""")
def xref_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries of all sections as text; files of this kind have their objects at the same places."""
    return _order_revisions(spark, sf_dir).listing().select(_key().alias("o_orderkey"), "rev", "line")


# ----------------------------------------------------------------------- pages

@query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, n_name, c_custkey, CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey, c_custkey) - 1 AS INT) AS page_no FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey")
def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each region, a subtree for each nation, a page for each customer."""
    rows = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    trees = rows.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "c_custkey", "n_name"))).alias("pages"))

    def make(r: dict) -> tuple[str, bytes]:
        objects, nations = {}, {}
        for p in r["pages"]:
            nations.setdefault(p["n_nationkey"], []).append(p)
        num, kids = 3, []
        for pages in nations.values():
            node, num = num, num + 1
            kids.append(node)
            refs = []
            for p in pages:
                objects[num] = b"<< /Type /Page /Parent %d 0 R /Nation " % node + g.literal(_raw(p["n_name"])) + b" /Key %d >>" % p["c_custkey"]
                refs.append(b"%d 0 R" % num)
                num += 1
            objects[node] = b"<< /Type /Pages /Parent 2 0 R /Kids [" + b" ".join(refs) + b"] >>"
        objects |= {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % k for k in kids) + b"] >>"}
        return f"region-{r['n_regionkey']}", g.Pdf().revision(objects, b"/Root 1 0 R").bytes()

    p = Pdfs(Made(trees, make)).pages()
    nation = F.decode(F.unbase64(F.variant_get("value", "$.Nation.b64", "string")), "UTF-8")
    return p.select(_key().alias("r_regionkey"), nation.alias("n_name"), F.variant_get("value", "$.Key", "bigint").alias("c_custkey"), "page_no")


# ------------------------------------------------------------- content streams

def _event_content(spark: SparkSession, sf_dir: str) -> Pdfs:
    rows = _table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")

    def make(r: dict) -> tuple[str, bytes]:
        body = b"q %% comment ( ]\nBT /F1 12 Tf %d 712.5 Td " % r["user_id"] + g.literal(_raw(r["event_type"])) + b" Tj [(a) -20 (b)] TJ ET Q" + b" q Q" * (r["user_id"] % 4)
        return f"event-{r['event_id']}", g.page_file(g.filtered(body, "FlateDecode"))

    return Pdfs(Made(_dealt(rows), make))


@query("SELECT event_id, CAST(18 + 2 * (user_id % 4) AS BIGINT) AS n_tokens, CAST(8 + 2 * (user_id % 4) AS BIGINT) AS n_operators, event_type AS shown, user_id AS x FROM events")
def content_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of each stream's tokens, taken from their array in place."""
    t = _event_content(spark, sf_dir).token_arrays([4])
    of = lambda f: F.filter("tokens", f)
    shown = F.decode(of(lambda t: t["tag"] == "string")[0]["bytes_val"], "UTF-8")
    return t.select(_key().alias("event_id"), F.size("tokens").cast("bigint").alias("n_tokens"), F.size(of(lambda t: t["tag"] == "operator")).cast("bigint").alias("n_operators"), shown.alias("shown"), F.col("tokens")[5]["long_val"].alias("x"))


OPERATORS_SQL = """SELECT event_id, g.group_no, g.operator, replace(replace(g.operands, '@T', event_type), '@U', CAST(user_id AS VARCHAR)) AS operands
FROM events, (VALUES (0, 'q', ''), (1, 'BT', ''), (2, 'Tf', 'F1 12'), (3, 'Td', '@U 712.5'), (4, 'Tj', '@T'), (5, 'TJ', '[ a -20 b ]'), (6, 'ET', ''), (7, 'Q', ''),
  (8, 'q', ''), (9, 'Q', ''), (10, 'q', ''), (11, 'Q', ''), (12, 'q', ''), (13, 'Q', '')) g(group_no, operator, operands) WHERE g.group_no < 8 + 2 * (user_id % 4)"""


@query(OPERATORS_SQL)
def operators_with_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _event_content(spark, sf_dir).operators([4])
    return o.select(_key().alias("event_id"), "group_no", "operator", F.array_join("operands", " ").alias("operands"))


@query(OPERATORS_SQL)
def operators_of_stored_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a table with a row for each token, by a window and an aggregate."""
    o = operator_groups(_event_content(spark, sf_dir).tokens([4]))
    return o.select(_key().alias("event_id"), F.col("group_no").cast("int").alias("group_no"), "operator", F.array_join("operands", " ").alias("operands"))


@query("SELECT event_id, CAST(14 + 2 * (user_id % 4) AS BIGINT) AS objects, CAST(8 + 2 * (user_id % 4) AS BIGINT) AS operators FROM events")
def content_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level objects of content streams through the SQL table function."""
    columns.register(spark)
    s = _event_content(spark, sf_dir).streams([4]).select("path", "decoded")
    found = spark.sql("SELECT path, t.tag FROM {s}, LATERAL pdf_parse_sequence(decoded, true) t", s=s)
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("objects"), F.count_if(F.col("tag") == "operator").alias("operators")).select(_key().alias("event_id"), "objects", "operators")


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'DCTDecode' WHEN 1 THEN 'JPXDecode' WHEN 2 THEN 'CCITTFaxDecode' WHEN 3 THEN 'JBIG2Decode' ELSE 'Crypt' END AS filter, coalesce(text, '') AS text FROM documents")
def passed_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codecs of images, whose data stays, after one that is undone; and Crypt in an open file."""
    known = ("DCTDecode", "JPXDecode", "CCITTFaxDecode", "JBIG2Decode", "Crypt")
    make = lambda r: g.page_file(g.stream(g.ENCODE["ASCIIHexDecode"](_raw(r["text"])), b"/Filter [/ASCIIHexDecode /" + known[r["doc_id"] % 5].encode() + b"]"))
    s = _documents(spark, sf_dir, make).streams([4])
    return s.select(_key().alias("doc_id"), F.col("filters")[1].alias("filter"), _utf8("decoded").alias("text"))


# --------------------------------------------------------------------- sources

def _supplier_folder(spark: SparkSession, sf_dir: str) -> str:
    """A file for each supplier in a folder that the cluster shares."""
    folder = f"{shared_dir(spark)}/suppliers-{uuid.uuid4().hex}"
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    g.write_files(g.generate(rows, lambda r: (f"supplier-{r['s_suppkey']}", g.page_file(g.filtered(_raw(r["s_name"]), "FlateDecode"), extra={5: g.literal(_raw(r["s_name"]))}))), folder)
    return folder


SUPPLIERS_SQL = "SELECT s_suppkey, s_name FROM supplier"


@query(SUPPLIERS_SQL)
def folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder, by Spark's own source."""
    s = read_pdfs(spark, _supplier_folder(spark, sf_dir)).streams([4])
    return s.select(_key(F.regexp_replace("path", r"\.pdf$", "")).alias("s_suppkey"), _utf8("decoded").alias("s_name"))


@query(SUPPLIERS_SQL)
def pdfobjects_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a folder's files, by the data source; their streams decoded afterwards."""
    register_source(spark)
    o = spark.read.format("pdfobjects").option("mode", "FAILFAST").load(_supplier_folder(spark, sf_dir)).where("obj_num = 4")
    decoded = columns.pdf_decode(*(F.col(c) for c in ("stream_raw", "filters", "parms", "cipher", "cipher_key")))
    return o.select(_key(F.regexp_replace("path", r"\.pdf$", "")).alias("s_suppkey"), _utf8(decoded["data"]).alias("s_name"))


# ------------------------------------------------------------------ encryption

FILE_ID, USER, OWNER = b"0123456789abcdef", b"reader", b"writer"


def _locked(v: int, r: int, size: int, o: bytes, u: bytes, more: bytes = b"") -> bytes:
    return b"/Root 1 0 R /ID [<" + FILE_ID.hex().encode() + b"> <00>] /Encrypt << /Filter /Standard /V %d /R %d /Length %d /P -4 /O <" % (v, r, size * 8) + o.hex().encode() + b"> /U <" + u.hex().encode() + b"> " + more + b" >>"


def _locked_file(stream_data: bytes, string_data: bytes, trailer: bytes, extra: bytes = b"") -> bytes:
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", 4: g.stream(stream_data, extra), 5: g.hexadecimal(string_data)}
    return g.Pdf("1.6").revision(objects, trailer).bytes()


def _opened(pdfs: Pdfs) -> DataFrame:
    """doc_id, text of the stream and the string, decrypted: one scan, one row for each object, and
    those of a file put together."""
    o = pdfs.with_decoded(pdfs.objects([4, 5]))
    part = F.coalesce("decoded", F.unbase64(F.variant_get("value", "$.b64", "string")))
    pick = lambda n: _utf8(F.max(F.when(F.col("obj_num") == n, F.col("part"))))
    o = o.select(_key().alias("doc_id"), "obj_num", part.alias("part"))
    return o.groupBy("doc_id").agg(pick(4).alias("text"), pick(5).alias("string"))


LOCKED_SQL = "SELECT doc_id, coalesce(text, '') AS text, coalesce(text, '') AS string FROM documents"


def _rc4_query(name: str, v: int, r: int, size: int, password: bytes) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o, u, key = g.legacy_keys(USER, OWNER, FILE_ID, r, size)
        make = lambda x: _locked_file(g.arcfour(g.object_key(key, 4, False), _raw(x["text"])), g.arcfour(g.object_key(key, 5, False), _raw(x["text"])), _locked(v, r, size, o, u))
        return _opened(_documents(spark, sf_dir, make, password))

    run.__name__ = name
    query(LOCKED_SQL)(run)


_rc4_query("rc4_40", 1, 2, 5, USER)
_rc4_query("rc4_128", 2, 3, 16, USER)
_rc4_query("owner_password", 2, 3, 16, OWNER)


def _sealed(key_4: bytes, key_5: bytes) -> list[Column]:
    """Text encrypted twice by the JVM, each led by a vector of its own."""
    text = F.coalesce("text", F.lit(""))
    iv = lambda tag: F.unhex(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(tag))))
    seal = lambda key, tag: F.aes_encrypt(F.encode(text, "UTF-8"), F.lit(key), F.lit("CBC"), F.lit("PKCS"), iv(tag))
    return [seal(key_4, "s").alias("sealed"), seal(key_5, "h").alias("string")]


AES_128 = b"/CF << /StdCF << /CFM /AESV2 /Length 16 >> >> "


@query(LOCKED_SQL)
def aes128(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, u, key = g.legacy_keys(USER, OWNER, FILE_ID, 4, 16)
    trailer = _locked(4, 4, 16, o, u, AES_128 + b"/StmF /StdCF /StrF /StdCF")
    make = lambda x: _locked_file(bytes(x["sealed"]), bytes(x["string"]), trailer)
    return _opened(_documents(spark, sf_dir, make, USER, *_sealed(g.object_key(key, 4, True), g.object_key(key, 5, True))))


@query(LOCKED_SQL)
def identity_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings are encrypted, streams are not: StmF is Identity."""
    o, u, key = g.legacy_keys(USER, OWNER, FILE_ID, 4, 16)
    trailer = _locked(4, 4, 16, o, u, AES_128 + b"/StmF /Identity /StrF /StdCF")
    make = lambda x: _locked_file(_raw(x["text"]), bytes(x["string"]), trailer)
    return _opened(_documents(spark, sf_dir, make, USER, *_sealed(g.object_key(key, 4, True), g.object_key(key, 5, True))))


@query(LOCKED_SQL)
def crypt_filter_rc4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 4 with RC4 for strings; streams name Identity by a Crypt filter of their own."""
    o, u, key = g.legacy_keys(USER, OWNER, FILE_ID, 4, 16)
    trailer = _locked(4, 4, 16, o, u, b"/CF << /StdCF << /CFM /V2 /Length 16 >> >> /StmF /StdCF /StrF /StdCF")
    make = lambda x: _locked_file(_raw(x["text"]), g.arcfour(g.object_key(key, 5, False), _raw(x["text"])), trailer, b"/Filter [/Crypt] /DecodeParms [<< /Name /Identity >>]")
    return _opened(_documents(spark, sf_dir, make, USER))


@query(TEXT_SQL)
def locked_object_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of an encrypted object stream are not decrypted once more; its index never is."""
    o, u, key = g.legacy_keys(USER, OWNER, FILE_ID, 3, 16)
    trailer = _locked(2, 3, 16, o, u)
    seal = lambda num, data: g.arcfour(g.object_key(key, num, False), data)
    make = lambda r: g.Pdf("1.5").revision({1: b"<< /Type /Catalog >>"}, trailer, xref="stream", packed={5: g.literal(_raw(r["text"])), 6: b"%d" % r["doc_id"]}, seal=seal).bytes()
    n = _documents(spark, sf_dir, make, USER).nodes([5])
    return n.select(_key().alias("doc_id"), _utf8("bytes_val").alias("text"))


def _aes256_query(name: str, given: str, user: str = "reader") -> None:
    """Opened with ``given``; the user's password, prepared, is ``user``, the owner's ``writer``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key, raw = hashlib.sha256(b"file key").digest(), user.encode()
        u = hashlib.sha256(raw + b"VALIDSLT").digest() + b"VALIDSLT" + b"KEY-SALT"
        wrap = lambda k: bytes(spark.range(1).select(columns.aes_cbc_encrypt(F.lit(key), F.lit(k), F.lit(bytes(16)), padding=False)).first()[0])[16:]
        ue = wrap(hashlib.sha256(raw + b"KEY-SALT").digest())
        o = hashlib.sha256(b"writer" + b"VALIDSLT" + u).digest() + b"VALIDSLT" + b"KEY-SALT"
        oe = wrap(hashlib.sha256(b"writer" + b"KEY-SALT" + u).digest())
        trailer = _locked(5, 5, 32, o, u, b"/CF << /StdCF << /CFM /AESV3 /Length 32 >> >> /StmF /StdCF /StrF /StdCF /UE <" + ue.hex().encode() + b"> /OE <" + oe.hex().encode() + b">")
        make = lambda x: _locked_file(bytes(x["sealed"]), bytes(x["string"]), trailer)
        return _opened(_documents(spark, sf_dir, make, given, *_sealed(key, key)))

    run.__name__ = name
    query(LOCKED_SQL)(run)


_aes256_query("aes256", "reader")
_aes256_query("aes256_owner", "writer")
_aes256_query("aes256_prepared", "\u2168 re\u00adader\u00aa", "IX readera")  # a numeral, a soft hyphen and an ordinal sign


@query("""WITH RECURSIVE k AS (
  SELECT doc_id, 0 AS i, md5(unhex(hex(encode('pw' || doc_id)) || upper(substr('28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A', 1, 2 * (32 - length('pw' || doc_id)))) || repeat('AB', 32) || 'FCFFFFFF' || hex(encode('0123456789abcdef')))) AS h FROM documents
  UNION ALL SELECT doc_id, i + 1, md5(unhex(h)) FROM k WHERE i < 50)
SELECT doc_id, h AS file_key, left(md5(unhex(h || '040000' || '0000' || '73416C54')), 32) AS object_key FROM k WHERE i = 50""")
def md5_file_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File and object keys by built-in functions alone."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.encode(F.concat(F.lit("pw"), F.col("doc_id").cast("string")), "UTF-8").alias("pw"))
    key = columns.legacy_file_key(F.col("pw"), F.lit(b"\xab" * 32), F.lit(-4), F.lit(FILE_ID), 16, 3)
    d = d.select("doc_id", key.alias("key"))
    return d.select("doc_id", F.lower(F.hex("key")).alias("file_key"), F.lower(F.hex(columns.object_key(F.col("key"), F.lit(4), F.lit(0), True))).alias("object_key"))


@query(TEXT_SQL)
def aes_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AES-CBC as column functions, without any file."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("t"), F.unhex(F.md5(F.col("doc_id").cast("string"))).alias("iv"))
    key = F.lit(b"0123456789abcdef0123456789abcdef")
    return d.select("doc_id", _utf8(columns.aes_cbc_decrypt(columns.aes_cbc_encrypt(F.col("t"), key, F.col("iv")), key)).alias("text"))


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def rc4_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RC4 of one implementation undone by the other."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "text")
    sealed = g.generate(d, lambda r: (f"doc-{r['doc_id']}", g.arcfour(b"key-%d" % r["doc_id"], _raw(r["text"]))))
    key = F.encode(F.concat(F.lit("key-"), _key().cast("string")), "UTF-8")
    return sealed.select(_key().alias("doc_id"), _utf8(columns.rc4(F.col("content"), key)).alias("text"))


# ---------------------------------------------------------------------- errors

@query("""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'PDFSyntaxError' WHEN 1 THEN 'PDFSyntaxError' WHEN 2 THEN 'PDFUnsupportedError' WHEN 3 THEN 'PDFGenericError' WHEN 4 THEN 'PDFLexicalError'
  WHEN 5 THEN 'PDFWrongPasswordError' WHEN 6 THEN 'PDFSyntaxError' ELSE 'none' END AS error FROM documents""")
def bad_pdf_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of files, objects and streams as rows."""
    o, u, _ = g.legacy_keys(USER, OWNER, FILE_ID, 3, 16)

    def make(r: dict) -> bytes:
        k, text = r["doc_id"] % 8, _raw(r["text"])
        if k == 0:  # no startxref
            return b"%PDF-1.4\n" + text.replace(b"startxref", b"")
        if k == 1:  # startxref points nowhere
            return g.Pdf().revision({1: b"<< >>", 4: b"null"}, b"/Root 1 0 R", bad_start=3).bytes()
        if k == 2:
            return g.page_file(g.stream(text, b"/Filter /Nonesuch"))
        if k == 3:
            return g.page_file(g.stream(b"not deflated", b"/Filter /FlateDecode"))
        if k == 4:
            return g.page_file(b"<< /A <12 >>")
        if k == 5:
            return _locked_file(text, b"", _locked(2, 3, 16, o, u))
        if k == 6:  # length too long
            return g.page_file(g.stream(text, length=b"%d" % (len(text) + 1000)))
        return g.page_file(g.stream(text))

    pdfs = _documents(spark, sf_dir, make, b"wrong")
    o = pdfs.objects([4]).withColumn("d", columns.pdf_decode(*(F.col(c) for c in ("stream_raw", "filters", "parms", "cipher", "cipher_key"))))
    return o.select(_key().alias("doc_id"), F.coalesce("error.class", "d.error.class", F.lit("none")).alias("error"))


@query("""SELECT doc_id, 'PDFLexicalError' AS class, CAST(70 + doc_id % 50 AS BIGINT) AS pos,
  substr(repeat('x', 50) || chr(10) || '5 0 obj' || chr(10) || repeat(' ', CAST(doc_id % 50 AS INT)) || '<< /A <12 >>' || chr(10) || 'endobj' || chr(10) || 'xref' || chr(10) || '0 2' || chr(10) || '00', CAST(51 + doc_id % 50 AS INT), 40) AS context
FROM documents""")
def error_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where errors are, and 40 bytes about the place."""
    make = lambda r: (f"doc-{r['doc_id']}", g.Pdf().revision({1: b"<< /Type /Catalog >>", 5: b" " * (r["doc_id"] % 50) + b"<< /A <12 >>"}, b"/Root 1 0 R").bytes())
    o = Pdfs(Made(_table(spark, sf_dir, "documents").select("doc_id"), make), context_size=40).objects([5], raw=False)
    return o.select(_key().alias("doc_id"), F.col("error.class").alias("class"), F.col("error.pos").alias("pos"), F.decode("error.context", "ISO-8859-1").alias("context"))


@query(TEXT_SQL)
def own_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered filter, after one of the format's."""
    register_filter("FoliantReversed", lambda data, parms: data[::-1])
    make = lambda r: g.page_file(g.stream(g.ENCODE["FlateDecode"](_raw(r["text"])[::-1]), b"/Filter [/FlateDecode /FoliantReversed]"))
    return _page_text(_documents(spark, sf_dir, make))

"""Tables of a collection of PDF files.

A file is one row (path, content); everything inside a file (its chain of
cross-reference sections, object streams, page tree) is read where the row is, in
batches of bounded size, so that indexing and parsing need no shuffle at all. What
comes out is relational: stored references are resolved by equi-joins, stored revisions
compared by aggregates, decoded streams are column expressions that Catalyst drops when
nobody selects them.

mode: PERMISSIVE gives errors as a struct (class, msg, pos, context), FAILFAST
raises where a broken file or object is read, whatever columns are selected,
DROPMALFORMED leaves broken rows out. A null content gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..arrow import lower_batches
from ..errors import PDFError, PDFSyntaxError, set_context_size
from ..functions import ciphers, columns, filters
from ..grammar.file import Entry, PdfFile, Section
from ..grammar.objects import Name, Ref, Stream, nodes_of, tag_of, to_plain

#: Whole files in one Arrow batch: rows and bytes, whichever comes first. Few enough that the
#: Python stages of a task work at the same time, and that a worker holds some MB.
BATCH_FILES, BATCH_BYTES = 512, 4 << 20
#: Output rows of one batch, and the bytes after which one is closed.
OUT_ROWS, OUT_BYTES = 4096, 4 << 20
#: Bytes of output after which a worker gives unused memory of Arrow back.
KEPT_BYTES = 32 << 20

ENTRY = "struct<obj_num:int,gen_num:int,kind:string,offset:bigint,objstm_num:int,idx:int,live:boolean>"
TRAILER = "struct<key:string,tag:string,json:string>"
SECTIONS = f"path string, rev int, pos bigint, kind string, prev bigint, trailer array<{TRAILER}>, entries array<{ENTRY}>, error {columns.ERROR}"
HEAD = "path string, obj_num int, gen_num int, kind string, tag string, json string"
STREAM = ", stream_raw binary, filters array<string>, parms array<string>, cipher string, cipher_key binary"
TARGET = "struct<status:string,obj_num:int,gen_num:int,tag:string,json:string>"
NODES = "path string, obj_num int, gen_num int, " + columns.NODE.removeprefix("struct<").removesuffix(">").replace(":", " ") + f", error {columns.ERROR}"
PAGES = f"path string, page_no int, obj_num int, gen_num int, json string, contents array<struct<obj_num:int,gen_num:int>>, error {columns.ERROR}"
MODES = ("PERMISSIVE", "FAILFAST", "DROPMALFORMED")
DEEPEST_TREE = 10_000


def _whole(e: Exception) -> dict:
    return columns.error_row(e if isinstance(e, PDFError) else PDFSyntaxError(f"{type(e).__name__}: {e}"))


def _batch(rows: list[tuple], schema: pa.Schema, build: dict[str, Callable[[tuple], pa.Array]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([build[f.name](c) if f.name in build else pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class Made:
    """Files that a function of a row (as a dict) makes: (path, content). They are made by the
    worker that reads them, so that their bytes pass neither through the JVM nor a second worker."""

    rows: DataFrame
    make: Callable[[dict], tuple[str, bytes]]

    def files(self) -> DataFrame:
        make = self.make

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [make(r) for r in batch.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.binary())], names=["path", "content"])

        lower_batches(self.rows.sparkSession, BATCH_FILES, BATCH_BYTES)
        return self.rows.mapInArrow(run, "path string, content binary")


class Pdfs:
    """Files as (path, content), or Made of rows, opened with one password; see the module for modes.
    ``context_size``: bytes about an error's place that its struct holds."""

    def __init__(self, files: DataFrame | Made, password: str | bytes | None = None, mode: str = "PERMISSIVE", context_size: int = 200):
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        self.made = files if isinstance(files, Made) else None
        self._files = None if self.made else files.select("path", "content")
        self.password, self.mode, self.context_size = password, mode, context_size
        self.spark: SparkSession = (files.rows if self.made else files).sparkSession

    @property
    def files(self) -> DataFrame:
        """path, content."""
        return self.made.files() if self.made else self._files

    # ------------------------------------------------------------ machinery

    def _scan(self, rows_of: Callable[[str, bytes, str | bytes | None], Iterator[dict | tuple]], schema: str, build: dict[str, Callable[[tuple], pa.Array]] | None = None) -> DataFrame:
        """Rows (dicts, or tuples in the order of the schema) of every file by a function of its
        path, bytes and password. The first column is the path, the last one the error. Errors are
        raised or left out here, so that it does not matter who selects the column. ``build``:
        functions that make a column's array of the values in rows."""
        lower_batches(self.spark, BATCH_FILES, BATCH_BYTES)
        password, mode, context_size = self.password, self.mode, self.context_size
        strict, build = mode != "PERMISSIVE", build or {}
        make = self.made.make if self.made else None
        kind = columns.arrow_type(f"struct<{_colons(schema)}>")
        arrow = pa.schema(list(kind))

        # bytes that become an array take a multiple of themselves
        wide = [(k, 16 if f.name in build else 1) for k, f in enumerate(arrow) if f.name in build or (f.name != "path" and (pa.types.is_string(f.type) or pa.types.is_binary(f.type)))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            set_context_size(context_size)
            out, held, sent = [], 0, 0
            for batch in batches:
                files = map(make, batch.to_pylist()) if make else ((p.as_py(), c.as_py()) for p, c in zip(batch.column(0), batch.column(1), strict=True))
                for path, content in files:
                    if content is None:
                        continue
                    for row in rows_of(path, content, password):
                        if type(row) is dict:
                            row = tuple(map(row.get, arrow.names))
                        if row[-1] is not None and strict:
                            if mode == "FAILFAST":
                                raise PDFError(f"{row[0]}: {row[-1]['class']}: {row[-1]['msg']}")
                            continue
                        out.append(row)
                        held += 64
                        for k, times in wide:
                            if row[k]:
                                held += len(row[k]) * times
                        if len(out) >= OUT_ROWS or held >= OUT_BYTES:
                            yield _batch(out, arrow, build)
                            sent += held
                            out, held = [], 0
                            if sent >= KEPT_BYTES:
                                pa.default_memory_pool().release_unused()
                                sent = 0
            if out:
                yield _batch(out, arrow, build)

        return (self.made.rows if make else self._files).mapInArrow(run, schema)

    # --------------------------------------------------------------- tables

    def headers(self) -> DataFrame:
        """path, version."""
        return self.files.select("path", columns.pdf_version(F.col("content")).alias("version"))

    def sections(self, trailer: bool = True) -> DataFrame:
        """One row per cross-reference section, rev 0 the newest; or one with the error of the file.
        Without ``trailer`` that column is null, and costs nothing."""
        return self._scan(lambda path, data, password: _section_rows(path, data, password, trailer), SECTIONS)

    def xref(self, live: bool = False) -> DataFrame:
        """path, rev, obj_num, gen_num, kind (n, f, c), offset, objstm_num, idx, live; with
        ``live`` only what current lookups find."""
        fields = ENTRY.removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")
        e = self._scan(lambda path, data, password: _entry_rows(path, data, live), f"path string, rev int, {fields}, error {columns.ERROR}")
        return e.where("error is null").drop("error")

    def listing(self) -> DataFrame:
        """path, rev, part, obj_num, line: entries as text, file by file; in a file section by section:
        in use, free, compressed, by number. Each file's lines are put in order where it is read; for
        a stored table, and an order over all files, there is the function ``listing``."""
        e = self._scan(_listing_rows, f"path string, rev int, part int, obj_num int, line string, error {columns.ERROR}")
        return e.where("error is null").drop("error")

    def trailers(self) -> DataFrame:
        """path, rev, key, tag, value of every section's trailer."""
        t = self.sections().where("error is null").select("path", "rev", F.explode("trailer").alias("t"))
        return t.select("path", "rev", "t.key", "t.tag", F.parse_json("t.json").alias("value"))

    def trailer(self, keys: list[str] | None = None) -> DataFrame:
        """path, key, tag, value: the newest revision's value of every key (of ``keys`` only, if
        given); read with the chain of a file."""
        wanted = None if keys is None else frozenset(keys)
        t = self._scan(lambda path, data, password: _trailer_rows(path, data, wanted), f"path string, key string, tag string, json string, error {columns.ERROR}")
        return t.where("error is null").select("path", "key", "tag", F.parse_json("json").alias("value"))

    def freed(self) -> DataFrame:
        """path, obj_num that were in use in some revision and are free now; read with the chain of a file."""
        return self._scan(_freed_rows, f"path string, obj_num int, error {columns.ERROR}").where("obj_num is not null").drop("error")

    def objects(self, numbers: list[int] | None = None, live: bool = True, raw: bool = True, follow: dict[str, str] | None = None) -> DataFrame:
        """One row per current object (of ``numbers`` only, if given: others are not parsed):
        path, obj_num, gen_num, kind, tag, value, stream_raw, filters, parms, cipher,
        cipher_key, error. Freed objects too (kind f) unless ``live``; without the five columns
        of streams unless ``raw``.

        ``follow``: column name -> path of keys in the object, as ``Info`` or ``Resources.Font``.
        Such a column is a struct of what is at the end of the path, references on it and at its
        end resolved in the file, without a join: status (found; or free, generation, missing:
        what the last reference leads to; or absent), obj_num, gen_num, tag, value."""
        wanted = None if numbers is None else frozenset(numbers)
        paths = {name: tuple(path.split(".")) for name, path in (follow or {}).items()}
        schema = HEAD + (STREAM if raw else "") + "".join(f", `{name}` {TARGET}" for name in paths) + f", error {columns.ERROR}"
        mode = self.mode
        df = self._scan(lambda path, data, password: _object_rows(path, data, password, wanted, live, raw, paths, mode == "FAILFAST"), schema)
        for name in paths:
            df = df.withColumn(name, F.when(F.col(name).isNotNull(), F.struct(*(F.col(name)[c].alias(c) for c in ("status", "obj_num", "gen_num", "tag")), F.parse_json(F.col(name)["json"]).alias("value"))))
        return df.withColumn("value", F.parse_json("json")).drop("json")

    def streams(self, numbers: list[int] | None = None) -> DataFrame:
        """Streams with ``decoded`` and ``decode_error``; the decoding is a column
        expression and is not run unless one of them is selected."""
        return self.with_decoded(self.objects(numbers).where("tag = 'stream'"))

    def with_decoded(self, objects: DataFrame) -> DataFrame:
        """Rows of ``objects`` with ``decoded`` and ``decode_error``, null where they are no streams."""
        # AES is undone by the JVM; only what has filters or another cipher goes to Python
        aes = F.col("cipher").isin("AESV2", "AESV3") & (F.octet_length("stream_raw") >= 32)
        s = objects.withColumn("__aes", F.when(aes, columns.aes_cbc_decrypt(F.col("stream_raw"), F.col("cipher_key"))))
        cipher = F.when(F.col("__aes").isNotNull(), "Identity").otherwise(F.col("cipher"))
        s = s.withColumns({"__clear": F.coalesce("__aes", "stream_raw"), "__cipher": cipher})
        plain = (F.col("__cipher") == "Identity") & (F.size("filters") == 0)
        s = s.withColumn("__d", columns.pdf_decode(F.when(~plain, F.col("__clear")), *(F.col(c) for c in ("filters", "parms", "__cipher", "cipher_key"))))
        s = s.withColumns({"decoded": F.when(plain, F.col("__clear")).otherwise(F.col("__d.data")), "decode_error": F.col("__d.error")}).drop("__d", "__aes", "__clear", "__cipher")
        if self.mode == "DROPMALFORMED":
            return s.where("decode_error is null")
        if self.mode == "FAILFAST":
            failed = F.raise_error(F.concat_ws(": ", "path", "decode_error.class", "decode_error.msg")).cast("binary")
            return s.withColumn("decoded", F.when(F.col("decode_error").isNotNull(), failed).otherwise(F.col("decoded")))
        return s

    def nodes(self, numbers: list[int] | None = None) -> DataFrame:
        """Every value inside every current object, in pre-order; a row with ``error`` for each
        file or object that cannot be read."""
        wanted = None if numbers is None else frozenset(numbers)
        return self._scan(lambda path, data, password: _node_rows(path, data, password, wanted), NODES)

    def token_arrays(self, numbers: list[int] | None = None) -> DataFrame:
        """path, source_obj, tokens: those of a decoded stream as one array; null where it cannot be decoded."""
        t = self._decoded_scan(numbers, lambda head, data, error: [(*head, data, error)], f"tokens array<{columns.TOKEN}>", {"tokens": columns.token_lists})
        return t.drop("error")

    def operators(self, numbers: list[int] | None = None) -> DataFrame:
        """Operands gathered with the operator that follows them, stream by stream where it is:
        path, source_obj, group_no, operator, operands (array of text)."""

        def rows(head: tuple, data: bytes | None, error: dict | None) -> Iterator[tuple]:
            if data is not None:
                yield from ((*head, *group, None) for group in columns.operator_groups_of(data))
            elif error is not None:
                yield (*head, None, None, None, error)

        return self._decoded_scan(numbers, rows, "group_no int, operator string, operands array<string>").where("error is null").drop("error")

    def _decoded_scan(self, numbers: list[int] | None, rows: Callable[[tuple, bytes | None, dict | None], Iterator[tuple]], schema: str, build: dict | None = None) -> DataFrame:
        """Rows of decoded streams by a function of (path, obj_num), the bytes and the error, read
        and decoded where the file is. Errors of whole files and objects give none in mode PERMISSIVE."""
        wanted = None if numbers is None else frozenset(numbers)
        strict, known, empty = self.mode != "PERMISSIVE", dict(filters.FILTERS), (None,) * schema.count(", ") + (None,)

        def scan(path: str, data: bytes, password) -> Iterator[tuple]:
            for num, content, error, read in _stream_rows(path, data, password, wanted, known):
                if read:
                    yield from rows((path, num), content, error)
                elif strict:
                    yield (path, num, *empty, error)

        return self._scan(scan, f"path string, source_obj int, {schema}, error {columns.ERROR}", build)

    def tokens(self, numbers: list[int] | None = None) -> DataFrame:
        """Tokens of decoded streams: path, source_obj, seq, pos, tag, values."""
        return self.token_arrays(numbers).select("path", "source_obj", F.explode("tokens").alias("t")).select("path", "source_obj", "t.*")

    def pages(self) -> DataFrame:
        """path, page_no (from 0, in the order of the tree), obj_num, gen_num, value, contents, error."""
        return self._scan(_page_rows, PAGES).withColumn("value", F.parse_json("json")).drop("json")

    def page_contents(self) -> DataFrame:
        """path, page_no, content, error: decoded content streams of each page, parts joined by a
        line feed, read where the file is. A part that is missing or cannot be decoded is empty,
        with the first such error."""
        known = dict(filters.FILTERS)
        return self._scan(lambda path, data, password: _content_rows(path, data, password, known), f"path string, page_no int, content binary, error {columns.ERROR}")

    # ----------------------------------------------------------- resolution

    def resolve(self, df: DataFrame, ref: Column | str, path: str = "path", into: str = "target", numbers: list[int] | None = None) -> DataFrame:
        """df with the object that ``ref`` (a struct ref_num, ref_gen) names as struct ``into``:
        status (found, free, generation, missing), tag, value, kind; null where ref is null. A join
        for references that are stored apart from their files; ``objects(follow=...)`` resolves
        those of an object without one. ``numbers`` bounds the objects that are parsed. In mode
        FAILFAST a reference that finds nothing is an error."""
        column = F.col(ref) if isinstance(ref, str) else ref
        target = self.objects(numbers, live=False, raw=False).where("obj_num is not null")
        target = target.select(F.col("path").alias("__path"), F.col("obj_num").alias("__num"), F.col("gen_num").alias("__gen"), "tag", "value", "kind")
        keyed = df.withColumns({"__ref": column["ref_num"], "__ref_gen": column["ref_gen"]})
        joined = keyed.join(target, (F.col(path) == F.col("__path")) & (F.col("__ref") == F.col("__num")), "left")
        status = F.when(F.col("__num").isNull(), "missing").when(joined["kind"] == "f", "free").when(F.col("__gen") != F.coalesce("__ref_gen", F.lit(0)), "generation").otherwise("found")
        status = F.when(F.col("__ref").isNotNull(), status)
        if self.mode == "FAILFAST":
            failed = F.raise_error(F.concat_ws(" ", F.col(path), F.lit("reference"), F.col("__ref"), F.lit("finds nothing:"), status)).cast("string")
            status = F.when(status.isNull() | (status == "found"), status).otherwise(failed)
        have = lambda c: F.when(status == "found", target[c]).alias(c)
        found = F.when(F.col("__ref").isNotNull(), F.struct(status.alias("status"), have("tag"), have("value"), have("kind"))).alias(into)
        return joined.select(*(df[c] for c in df.columns if c != into), found)

    def edges(self) -> DataFrame:
        """path, obj_num, ref_num: which object refers to which."""
        return self.nodes().where("ref_num is not null").select("path", "obj_num", "ref_num").distinct()

    def reachable(self) -> DataFrame:
        """path, obj_num, error of all objects that can be reached from the trailers; each file is
        walked where its row is, until nothing new is found, and only what the walk meets is
        parsed. An object that cannot be read has an error, and a file that cannot be opened
        one row without obj_num."""
        return self._scan(_reachable_rows, f"path string, obj_num int, error {columns.ERROR}")

    def reachable_by_file(self) -> DataFrame:
        """path, objects, failed, error: the same with a row for each file, which no shuffle has to
        gather: its numbers in the order of the walk, and those of them that cannot be read. In modes
        FAILFAST and DROPMALFORMED objects that cannot be read are raised or left out, as for ``reachable``."""
        mode = self.mode
        return self._scan(lambda path, data, password: _reached_rows(path, data, password, mode), f"path string, objects array<int>, failed array<int>, error {columns.ERROR}")


def _newest(row: list[str]) -> Column:
    return F.min_by(F.struct(*row), F.struct("rev", F.col("kind") == "c"))


def latest(xref: DataFrame) -> DataFrame:
    """The newest entry of every (path, obj_num) of a stored xref table, freed ones left out."""
    rest = [c for c in xref.columns if c not in ("path", "obj_num")]
    best = xref.groupBy("path", "obj_num").agg(_newest(rest).alias("__e")).where("__e.kind <> 'f'")
    return best.select(*(F.col(c) if c in ("path", "obj_num") else F.col(f"__e.{c}").alias(c) for c in xref.columns))


def freed(xref: DataFrame) -> DataFrame:
    """(path, obj_num) of a stored xref table that were in use once and are free now."""
    state = xref.groupBy("path", "obj_num").agg(F.bool_or(F.col("kind") != "f").alias("__used"), _newest(["kind"]).alias("__e"))
    return state.where("__used and __e.kind = 'f'").select("path", "obj_num")


def listing(xref: DataFrame) -> DataFrame:
    """Entries as text, section by section: in use, free, compressed, by number."""
    order = F.when(F.col("kind") == "n", 0).when(F.col("kind") == "f", 1).otherwise(2)
    text = F.when(F.col("kind") == "c", F.format_string("%d %d in object stream %d at %d", "obj_num", "gen_num", "objstm_num", "idx")).when(F.col("kind") == "f", F.format_string("%d %d free", "obj_num", "gen_num")).otherwise(F.format_string("%d %d at %d", "obj_num", "gen_num", "offset"))
    return xref.select("path", "rev", order.alias("part"), "obj_num", text.alias("line")).orderBy("path", "rev", "part", "obj_num")


def operator_groups(tokens: DataFrame) -> DataFrame:
    """Operands gathered with the operator that follows them: path, source_obj, group_no,
    operator, operands (array of text)."""
    is_op = (F.col("tag") == "operator").cast("int")
    w = Window.partitionBy("path", "source_obj").orderBy("seq")
    grouped = tokens.withColumn("group_no", F.sum(is_op).over(w) - is_op)
    text = F.coalesce("name_val", F.col("long_val").cast("string"), F.col("double_val").cast("string"), F.col("bool_val").cast("string"), F.decode("bytes_val", "ISO-8859-1"))
    return grouped.groupBy("path", "source_obj", "group_no").agg(F.max(F.when(is_op == 1, F.col("name_val"))).alias("operator"), F.transform(F.sort_array(F.collect_list(F.when(is_op == 0, F.struct("seq", text.alias("v"))))), lambda s: s["v"]).alias("operands"))


# ------------------------------------------------------------ rows of a file

def _colons(schema: str) -> str:
    out, depth = [], 0
    for part in schema.split(", "):
        out.append(part.replace(" ", ":", 1) if depth == 0 else part)
        depth += part.count("<") - part.count(">")
    return ",".join(out)


def _open(path: str, data: bytes, password) -> tuple[PdfFile | None, dict | None]:
    try:
        return PdfFile(data, password), None
    except Exception as e:  # noqa: BLE001 - whatever broken bytes do to the reader is this file's error
        return None, _whole(e)


def _sections(data: bytes) -> list[Section]:
    file = PdfFile.__new__(PdfFile)
    file.data = data
    return file._read_sections()


def _section_rows(path: str, data: bytes, password, trailers: bool = True) -> Iterator[tuple]:
    try:
        found = _sections(data)
    except Exception as e:  # noqa: BLE001
        yield (path, *(None,) * 6, _whole(e))
        return
    seen: set[int] = set()
    for s in found:
        entries = [(e.num, e.gen, e.kind, e.offset, e.objstm, e.idx, e.num not in seen and e.kind != "f") for e in s.entries]
        seen.update(e.num for e in s.entries)
        trailer = [(k, tag_of(v), json.dumps(to_plain(v))) for k, v in s.trailer.items()] if trailers else None
        yield (path, s.rev, s.pos, s.kind, s.prev, trailer, entries, None)


def _entry_rows(path: str, data: bytes, live: bool) -> Iterator[tuple]:
    try:
        found = _sections(data)
    except Exception as e:  # noqa: BLE001
        yield (path, *(None,) * 8, _whole(e))
        return
    seen: set[int] = set()
    for s in found:
        for e in s.entries:
            now = e.kind != "f" and e.num not in seen
            if now or not live:
                yield (path, s.rev, e.num, e.gen, e.kind, e.offset, e.objstm, e.idx, now, None)
        seen.update([e.num for e in s.entries])


def _line(e: Entry) -> tuple[int, int, str]:
    """Part, number and text of an entry."""
    if e.kind == "n":
        return 0, e.num, f"{e.num} {e.gen} at {e.offset}"
    if e.kind == "f":
        return 1, e.num, f"{e.num} {e.gen} free"
    return 2, e.num, f"{e.num} {e.gen} in object stream {e.objstm} at {e.idx}"


def _listing_rows(path: str, data: bytes, password) -> Iterator[tuple]:
    try:
        found = _sections(data)
    except Exception as e:  # noqa: BLE001
        yield (path, *(None,) * 4, _whole(e))
        return
    for s in found:
        for line in sorted(map(_line, s.entries)):
            yield (path, s.rev, *line, None)


def _trailer_rows(path: str, data: bytes, wanted: frozenset[str] | None) -> Iterator[tuple]:
    try:
        found = _sections(data)
    except Exception as e:  # noqa: BLE001
        yield (path, *(None,) * 3, _whole(e))
        return
    newest: dict[str, object] = {}
    for s in found:
        newest = s.trailer | newest
    for k, v in newest.items():
        if wanted is None or k in wanted:
            yield (path, k, tag_of(v), str(v) if type(v) is int else json.dumps(to_plain(v)), None)


def _freed_rows(path: str, data: bytes, password) -> Iterator[dict]:
    try:
        found = _sections(data)
    except Exception as e:  # noqa: BLE001
        yield {"path": path, "error": _whole(e)}
        return
    free: dict[int, bool] = {}
    used: set[int] = set()
    for s in found:
        for e in s.entries:
            free.setdefault(e.num, e.kind == "f")
            if e.kind != "f":
                used.add(e.num)
    yield from ({"path": path, "obj_num": n} for n in sorted(used) if free[n])


def _target(file: PdfFile, value: object, path: tuple[str, ...]) -> dict:
    """What is at the end of a path of keys, all references resolved."""
    status, at = "found", None
    for key in (*path, None):
        while isinstance(value, Ref):
            at = value
            status, entry = file.find(value)
            if status != "found":
                return {"status": status, "obj_num": at.num, "gen_num": at.gen}
            value = file.read(entry)
        if key is None:
            break
        inside = value.entries if isinstance(value, Stream) else value
        if not isinstance(inside, dict) or key not in inside:
            return {"status": "absent"}
        value, at = inside[key], None
    return {"status": status, "tag": tag_of(value), "json": json.dumps(to_plain(value))} | ({} if at is None else {"obj_num": at.num, "gen_num": at.gen})


def _object_rows(path: str, data: bytes, password, wanted: frozenset[int] | None, live: bool, raw: bool = True, follow: dict[str, tuple[str, ...]] | None = None, strict: bool = False) -> Iterator[dict]:
    file, error = _open(path, data, password)
    if file is None:
        yield {"path": path, "error": error}
        return
    numbers = file.latest.keys() if wanted is None else wanted & file.latest.keys()
    for e in (file.latest[n] for n in sorted(numbers)):
        if live and e.kind == "f":
            continue
        row = {"path": path, "obj_num": e.num, "gen_num": e.gen, "kind": e.kind}
        try:
            value = file.read(e)
            row |= {"tag": tag_of(value), "json": json.dumps(to_plain(value))}
            if raw and isinstance(value, Stream):
                row["stream_raw"] = value.raw
                names, parms = file.filters_of(value.entries)
                method, key = file.cipher_of(value, e.num, e.gen)
                row |= {"filters": names, "parms": [None if p is None else json.dumps(to_plain(p)) for p in parms], "cipher": method, "cipher_key": key}
            for name, keys in (follow or {}).items():
                row[name] = _target(file, value, keys)
                if strict and row[name]["status"] not in ("found", "absent"):
                    raise PDFSyntaxError(f"reference {row[name]['obj_num']} {row[name]['gen_num']} finds nothing: {row[name]['status']}")
        except Exception as x:  # noqa: BLE001
            row["error"] = _whole(x)
        yield row


def _node_rows(path: str, data: bytes, password, wanted: frozenset[int] | None) -> Iterator[dict]:
    file, error = _open(path, data, password)
    if file is None:
        yield {"path": path, "error": error}
        return
    numbers = file.latest.keys() if wanted is None else wanted & file.latest.keys()
    for e in (file.latest[n] for n in sorted(numbers)):
        if e.kind == "f":
            continue
        head = (path, e.num, e.gen)
        try:
            value = file.read(e)
        except Exception as x:  # noqa: BLE001
            yield dict(zip(("path", "obj_num", "gen_num"), head, strict=True)) | {"error": _whole(x)}
            continue
        for n in nodes_of(value):
            yield (*head, *n, None)


def _refs(value: object) -> list[Ref]:
    """All references inside a value."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        kind = type(v)
        if kind is Ref:
            out.append(v)
        elif kind is dict:
            todo += v.values()
        elif kind is list:
            todo += v
        elif kind is Stream:
            todo += v.entries.values()
    return out


def _walk(file: PdfFile) -> Iterator[tuple[int, dict | None]]:
    """Numbers of all objects that the trailers lead to, each with the error that reading it gave."""
    todo = [r for s in file.sections for r in _refs(s.trailer)]
    seen: set[int] = set()
    while todo:
        ref = todo.pop()
        if ref.num in seen:
            continue
        status, e = file.find(ref)
        if status != "found":
            continue
        seen.add(ref.num)
        error = None
        try:
            todo += _refs(file.read(e))
        except Exception as x:  # noqa: BLE001
            error = _whole(x)
        yield ref.num, error


def _reachable_rows(path: str, data: bytes, password) -> Iterator[tuple]:
    file, error = _open(path, data, password)
    if file is None:
        yield (path, None, error)
        return
    yield from ((path, num, error) for num, error in _walk(file))


def _reached_rows(path: str, data: bytes, password, mode: str) -> Iterator[tuple]:
    file, error = _open(path, data, password)
    if file is None:
        yield (path, None, None, error)
        return
    objects, failed = [], []
    for num, error in _walk(file):
        if error is not None:
            if mode == "FAILFAST":
                yield (path, None, None, error)
            if mode == "DROPMALFORMED":
                continue
            failed.append(num)
        objects.append(num)
    yield (path, objects, failed, None)


def _stream_rows(path: str, data: bytes, password, wanted: frozenset[int] | None, known: dict) -> Iterator[tuple[int | None, bytes | None, dict | None, bool]]:
    """Number, decoded bytes, error, and whether the object could be read, of every stream."""
    file, error = _open(path, data, password)
    if file is None:
        yield None, None, error, False
        return
    numbers = file.latest.keys() if wanted is None else wanted & file.latest.keys()
    for n in sorted(numbers):
        e = file.latest[n]
        if e.kind == "f":
            continue
        try:
            value = file.read(e)
            if not isinstance(value, Stream):
                continue
            names, parms = file.filters_of(value.entries)
            method, key = file.cipher_of(value, e.num, e.gen)
        except Exception as x:  # noqa: BLE001
            yield n, None, _whole(x), False
            continue
        try:
            content, error = filters.decode(ciphers.decrypt(method, key, value.raw), names, parms, known), None
        except PDFError as x:
            content, error = None, columns.error_row(x)
        yield n, content, error, True


def _content_rows(path: str, data: bytes, password, known: dict) -> Iterator[dict]:
    file, _ = _open(path, data, password)
    for page in _page_rows(path, data, password, file):
        if page.get("error") is not None:
            yield {"path": path, "page_no": page.get("page_no"), "error": page["error"]}
            continue
        parts, error = [], None
        for p in page["contents"]:
            try:
                status, e = file.find(Ref(p["obj_num"], p["gen_num"]))
                stream = file.read(e) if status == "found" else None
                if not isinstance(stream, Stream):
                    raise PDFSyntaxError(f"content stream {p['obj_num']} is missing")
                parts.append(file.stream_bytes(stream, e.num, e.gen, known))
            except Exception as x:  # noqa: BLE001
                parts.append(b"")
                error = error or _whole(x)
        yield {"path": path, "page_no": page["page_no"], "content": b"\n".join(parts), "error": error}


def _page_rows(path: str, data: bytes, password, file: PdfFile | None = None) -> Iterator[dict]:
    error = None
    if file is None:
        file, error = _open(path, data, password)
    if file is None:
        yield {"path": path, "error": error}
        return
    count = 0
    try:
        catalog = file.get(file.trailer.get("Root"))
        if not isinstance(catalog, dict) or not isinstance(catalog.get("Pages"), Ref):
            raise PDFSyntaxError("no page tree")
        stack, above = [(catalog["Pages"], False)], set()
        while stack:
            ref, done = stack.pop()
            if done:  # all below that node is read: it may occur again elsewhere, but not below itself
                above.remove(ref.num)
                continue
            if not isinstance(ref, Ref):
                raise PDFSyntaxError("a kid of the page tree is no reference")
            if ref.num in above or len(above) > DEEPEST_TREE:
                raise PDFSyntaxError("the page tree has a loop")
            node = file.get(ref)
            if not isinstance(node, dict):
                raise PDFSyntaxError(f"page object {ref.num} is missing")
            if node.get("Type") == Name("Pages"):
                above.add(ref.num)
                kids = file.get(node.get("Kids", []))
                if not isinstance(kids, list):
                    raise PDFSyntaxError("kids of the page tree are no array")
                stack.append((ref, True))
                stack.extend((k, False) for k in reversed(kids))
                continue
            contents = node.get("Contents")
            if isinstance(contents, Ref) and isinstance(inner := file.get(contents), list):
                contents = inner
            parts = contents if isinstance(contents, list) else [] if contents is None else [contents]
            if not all(isinstance(p, Ref) for p in parts):
                raise PDFSyntaxError("contents of a page are neither an array nor a stream")
            yield {"path": path, "page_no": count, "obj_num": ref.num, "gen_num": ref.gen, "json": json.dumps(to_plain(node)), "contents": [{"obj_num": p.num, "gen_num": p.gen} for p in parts]}
            count += 1
    except Exception as e:  # noqa: BLE001
        yield {"path": path, "page_no": count, "error": _whole(e)}

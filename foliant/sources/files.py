"""Opening collections: folders of files, tables with bytes, and a Spark data source."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..errors import PDFError, set_context_size
from ..functions.columns import ERROR
from ..operators.collection import HEAD, MODES, STREAM, Pdfs, _object_rows

#: Columns of a row after its path.
COLUMNS = ("obj_num", "gen_num", "kind", "tag", "json", "stream_raw", "filters", "parms", "cipher", "cipher_key")


def read_pdfs(spark: SparkSession, path: str | list[str], password: str | bytes | None = None, mode: str = "PERMISSIVE", glob: str = "*.pdf", recursive: bool = True, context_size: int = 200) -> Pdfs:
    """The files under a path that Spark can read. Spark's own binaryFile source lists and
    reads them; conditions on path, length and modification time reach its listing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return Pdfs(files, password, mode, context_size)


def pdfs_of(df: DataFrame, path: str = "path", content: str = "content", password: str | bytes | None = None, mode: str = "PERMISSIVE", context_size: int = 200) -> Pdfs:
    """Files held in a table."""
    return Pdfs(df.selectExpr(f"CAST(`{path}` AS STRING) AS path", f"CAST(`{content}` AS BINARY) AS content"), password, mode, context_size)


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class PdfObjectsReader(DataSourceReader):
    """Objects of files that pyarrow's file systems reach. Conditions on obj_num are used to
    parse fewer objects, and are left to Spark as well."""

    def __init__(self, options: dict):
        self.options, self.numbers = options, None

    def pushFilters(self, pushed: list[Filter]) -> Iterator[Filter]:
        for f in pushed:
            if isinstance(f, (EqualTo, In)) and tuple(f.attribute) == ("obj_num",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.numbers = values if self.numbers is None else self.numbers & values
            yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.options["path"])
        info = store.get_file_info(root)
        found = [info] if info.is_file else sorted((i for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.path.lower().endswith(".pdf")), key=lambda i: i.path)
        most, parts, held = int(self.options.get("maxpartitionbytes", 64 << 20)), [[]], 0
        for i in found:
            if parts[-1] and held + i.size > most:
                parts.append([])
                held = 0
            parts[-1].append(i.path)
            held += i.size
        return [_Part(p) for p in parts if p]

    def read(self, part: _Part) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.options["path"])
        wanted = None if self.numbers is None else frozenset(self.numbers)
        mode = self.options.get("mode", "PERMISSIVE").upper()
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        set_context_size(int(self.options.get("contextsize", 200)))
        for path in part.paths:
            with store.open_input_file(path) as f:
                data = f.read()
            for r in _object_rows(path, data, self.options.get("password"), wanted, True):
                error = r.get("error")
                if error is not None and mode == "FAILFAST":
                    raise PDFError(f"{path}: {error['class']}: {error['msg']}")
                if error is None or mode == "PERMISSIVE":
                    yield path, *(r.get(c) for c in COLUMNS), error and (error["class"], error["msg"], error["pos"], error["context"])


class PdfObjectsSource(DataSource):
    """spark.read.format("pdfobjects").option("password", ...).load(path); options mode,
    contextSize and maxPartitionBytes too. With filters, parms, cipher and cipher_key,
    streams are decoded by ``Pdfs.with_decoded`` or ``pdf_decode``; value is JSON."""

    @classmethod
    def name(cls) -> str:
        return "pdfobjects"

    def schema(self) -> str:
        return HEAD.replace("json string", "value string") + STREAM + f", error {ERROR}"

    def reader(self, schema) -> DataSourceReader:
        return PdfObjectsReader(dict(self.options))


def register_source(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PdfObjectsSource)

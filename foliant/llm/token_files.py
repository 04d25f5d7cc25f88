"""Token files: texts encoded with a tokenizers file, written in document order as
Simple-8b files in a shared folder, and read back.

Each task of a range partitioning by document id writes the files of its range:
under a name of its own first, then renamed, so that a task that is run again leaves
whole files only; what failed attempts leave is deleted at the end; the manifest lists the
files of the attempts that succeeded. Task
memory holds one file's code words. Where each document starts follows from sums of
the files before it.

Defined cases: null text is empty and has the end id only; rows with equal ids are
written in the order of a hash of their texts, null ids first; an empty table gives
no files and no rows; a text of any length is one document across as many blocks
as it needs. Columns other than the two named are not read.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import SUFFIX, Encoder, Recent, Words, slices
from .common import bound_batches, fresh_path, lean, materialise
from .simple8b import TokenFile, TokenFileWriter

MANIFEST = "part int, piece int, path string, n_docs bigint, n_tokens bigint"


class LibraryEncoder(Encoder):
    """Ids by the tokenizers library, for files whose pre-tokenizer drops white space and
    marks the end of each word: each distinct word is encoded once, many words with spaces
    between them at a time, and kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.text = Words(json.load(f))
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[[k for t, k in self.tokenizer.get_vocab().items() if t.endswith(SUFFIX)]] = True
        self.kept = Recent(self._alone, 500_000)

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn_words(self, words: list[str]) -> list[bytes]:
        kept = self.kept
        new = [w for w in words if w not in kept and w not in kept.old and len(w) <= kept.longest]
        for lo in range(0, len(new), 200):
            part = new[lo : lo + 200]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            stop = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stop) != len(part):  # a word that the library cuts otherwise: one by one
                kept.update((w, self._alone(w)) for w in part)
                continue
            raw, at = ids.tobytes(), 0
            for word, to in zip(part, stop, strict=True):
                kept[word] = raw[at:to]
                at = to
        out = list(map(kept.__getitem__, words))
        kept.age()
        return out

    def learn_pieces(self, pieces: list[str]) -> list[bytes]:
        return [self._alone(p) for p in pieces]


_encoders: dict[str, LibraryEncoder] = {}


def _encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def write_token_files(df: DataFrame, tokenizer: str, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int | None = 1, file_tokens: int = 16_000_000) -> DataFrame:
    """Write the files and return their manifest (part, piece, path, n_docs, n_tokens), in
    ascending document order by (part, piece). The job runs at once."""
    spark = df.sparkSession
    bound_batches(spark, 8 << 20)
    folder = folder or fresh_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, writer, encoder = TaskContext.get().partitionId(), 0, None, _encoder(tokenizer)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        def close() -> pa.RecordBatch:
            path = f"{root}/part-{part:07d}-{piece:04d}.s8b"
            hidden = f"{root}/.{uuid.uuid4().hex}"
            with store.open_output_stream(hidden) as f:
                f.write(writer.finish())
            store.move(hidden, path)
            return pa.RecordBatch.from_pylist([{"part": part, "piece": piece, "path": path, "n_docs": len(writer.ids), "n_tokens": writer.n_values}], schema=pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        end = np.array([] if end_id is None else [end_id], "<u4")
        for part_of in (p for batch in batches for p in slices(batch, 1, 6 << 20)):
            ids, bounds = encoder.encode_array(part_of.column(1))
            edge = bounds.tolist()
            for k, doc in enumerate(part_of.column(0).to_pylist()):
                writer = writer or TokenFileWriter()
                writer.add(doc, np.concatenate((ids[edge[k] : edge[k + 1]], end)))
                if writer.n_values >= file_tokens:
                    yield close()
                    writer, piece = None, piece + 1
        if writer:
            yield close()

    rows = df.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    ranged = rows.repartitionByRange(F.col("doc").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc").asc_nulls_first(), "tie")
    manifest = materialise(ranged.mapInArrow(lean(write), MANIFEST), "manifest")
    _sweep(folder)
    return manifest.withColumn("uri", F.concat(F.lit(folder + "/"), F.element_at(F.split("path", "/"), -1))).drop("path").withColumnRenamed("uri", "path")


def _sweep(folder: str) -> None:
    """Delete what attempts that failed have left; all tasks have ended."""
    store, root = fs.FileSystem.from_uri(folder)
    if store.get_file_info(root).type == fs.FileType.Directory:
        for info in store.get_file_info(fs.FileSelector(root)):
            if info.base_name.startswith("."):
                store.delete_file(info.path)


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start (values in all documents before
    it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)
    and, with_ids, ids (binary, the same integers)."""
    bound_batches(manifest.sparkSession)
    # one row per file: its start is the sum of the files before it
    files = manifest.withColumn("before", F.sum("n_tokens").over(Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.binary())] * with_ids])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as f:
                    rows, held = [], 0
                    for doc, at, ids in TokenFile(f, f.size()).documents():
                        raw = ids.astype("<u4").tobytes()
                        rows.append({"doc_id": doc, "start": before + at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(raw)} | ({"ids": raw} if with_ids else {}))
                        held += len(raw)
                        if len(rows) >= 2000 or held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "before", "part").repartition(F.col("part")).select("path", "before").mapInArrow(lean(read), schema)

"""Writes small PDF files from object bodies, deterministically.

Imports nothing of the reader, so that an error made alike in both directions shows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from ..arrow import lower_batches

SPECIAL = b"()<>[]{}/%#"


def literal(data: bytes) -> bytes:
    """A literal string; line ends and odd bytes as octal escapes, balanced parentheses bare."""
    out, depth, balanced = bytearray(b"("), 0, True
    for c in data:
        depth += (c == 40) - (c == 41)
        balanced &= depth >= 0
    balanced &= depth == 0
    for c in data:
        if c == 92 or (c in b"()" and not balanced):
            out += b"\\" + bytes((c,))
        elif c == 10:
            out += b"\\n"
        elif c < 32 or c > 126:
            out += b"\\%03o" % c
        else:
            out.append(c)
    return bytes(out + b")")


def hexadecimal(data: bytes) -> bytes:
    h = data.hex().upper().encode()
    return b"<" + b"\n".join(h[i : i + 64] for i in range(0, len(h), 64)) + b">"


def name(text: str) -> bytes:
    return b"/" + b"".join(bytes((c,)) if 33 <= c <= 126 and c not in SPECIAL else b"#%02X" % c for c in text.encode())


def stream(data: bytes, extra: bytes = b"", length: bytes | None = None) -> bytes:
    return b"<< /Length " + (length or b"%d" % len(data)) + b" " + extra + b" >>\nstream\n" + data + b"\nendstream"


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        j = i
        while j < len(data) and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 2:
            out += bytes((257 - (j - i), data[i]))
        else:
            j = min(i + 100, len(data))
            out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out + b"\x80")


ENCODE: dict[str, Callable[[bytes], bytes]] = {
    "FlateDecode": zlib.compress,
    "ASCIIHexDecode": lambda d: d.hex().encode() + b">",
    "ASCII85Decode": lambda d: base64.a85encode(d) + b"~>",
    "RunLengthDecode": run_length,
}


def filtered(data: bytes, *filters: str, extra: bytes = b"") -> bytes:
    """A stream whose first-named filter is decoded first."""
    for f in reversed(filters):
        data = ENCODE[f](data)
    return stream(data, (b"/Filter [" + b" ".join(b"/" + f.encode() for f in filters) + b"] " if len(filters) > 1 else b"/Filter /" + filters[0].encode() + b" ") + extra if filters else extra)


def png_rows(data: bytes, row: int, step: int, kind: int) -> bytes:
    """Rows of a whole number of bytes coded with one PNG row type."""
    out, above = bytearray(), bytes(row)
    for at in range(0, len(data), row):
        line = data[at : at + row]
        out.append(kind)
        for i, v in enumerate(line):
            a, b, c = line[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            p = a + b - c
            guess = (0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2])[kind]
            out.append((v - guess) % 256)
        above = line
    return bytes(out)


def tiff_rows(data: bytes, row: int, step: int) -> bytes:
    return bytes((v - (data[i - step] if i % row >= step else 0)) % 256 for i, v in enumerate(data))


class Pdf:
    """A file made revision by revision."""

    def __init__(self, version: str = "1.4"):
        self.data = bytearray(f"%PDF-{version}\n%\xe2\xe3\xcf\xd3\n".encode("latin-1"))
        self.size, self.prev = 1, None

    def _put(self, num: int, body: bytes, gen: int = 0) -> int:
        at = len(self.data)
        self.data += b"%d %d obj\n" % (num, gen) + body + b"\nendobj\n"
        self.size = max(self.size, num + 1)
        return at

    def revision(self, objects: dict[int, bytes], trailer: bytes = b"", free: tuple[int, ...] = (), xref: str = "table", packed: dict[int, bytes] | None = None, bad_start: int | None = None, gens: dict[int, int] | None = None, seal: Callable[[int, bytes], bytes] | None = None) -> Pdf:
        """Append objects and their cross-reference section: table, stream or hybrid. ``packed``
        objects go into an object stream, whose data ``seal`` encrypts by its number. ``gens``:
        generations of objects that are not of the first."""
        gens = gens or {}
        where: dict[int, tuple[int, int, int]] = {n: (1, self._put(n, b, gens.get(n, 0)), gens.get(n, 0)) for n, b in objects.items()}
        for n in free:
            where[n] = (0, 0, 1)
            self.size = max(self.size, n + 1)
        if packed:
            container = max([self.size, *(n + 1 for n in packed)])
            pairs, body = [], bytearray()
            for n, b in packed.items():
                pairs.append(b"%d %d" % (n, len(body)))
                body += b + b" "
            head = b" ".join(pairs) + b" "
            data = zlib.compress(head + bytes(body))
            data = seal(container, data) if seal else data
            where[container] = (1, self._put(container, stream(data, b"/Filter /FlateDecode /Type /ObjStm /N %d /First %d" % (len(packed), len(head)))), 0)
            for k, n in enumerate(packed):
                where[n] = (2, container, k)
        prev = b" /Prev %d" % self.prev if self.prev is not None else b""
        if xref == "table":
            start = self._table(where, trailer + prev)
        elif xref == "stream":
            start = self._stream(where, trailer + prev)
        else:
            hidden = {n: w for n, w in where.items() if w[0] == 2}
            extra = self._stream(hidden, b"")
            start = self._table({n: w for n, w in where.items() if w[0] != 2}, trailer + prev + b" /XRefStm %d" % extra)
        self.prev = start
        self.data += b"startxref\n%d\n%%%%EOF\n" % (start if bad_start is None else bad_start)
        return self

    @staticmethod
    def _runs(nums: list[int]) -> Iterator[list[int]]:
        run: list[int] = []
        for n in nums:
            if run and n != run[-1] + 1:
                yield run
                run = []
            run.append(n)
        if run:
            yield run

    def _table(self, where: dict[int, tuple[int, int, int]], trailer: bytes) -> int:
        at = len(self.data)
        self.data += b"xref\n"
        rows = {0: b"0000000000 65535 f \n"} if self.prev is None else {}
        rows |= {n: b"%010d %05d %s \n" % (w[1], w[2], b"n" if w[0] else b"f") for n, w in where.items()}
        for run in self._runs(sorted(rows)):
            self.data += b"%d %d\n" % (run[0], len(run)) + b"".join(rows[n] for n in run)
        self.data += b"trailer\n<< /Size %d " % self.size + trailer + b" >>\n"
        return at

    def _stream(self, where: dict[int, tuple[int, int, int]], trailer: bytes) -> int:
        own = self.size
        self.size += 1
        at = len(self.data)
        where = where | {own: (1, at, 0)}
        index = b" ".join(b"%d %d" % (r[0], len(r)) for r in self._runs(sorted(where)))
        body = b"".join(bytes((where[n][0],)) + where[n][1].to_bytes(4, "big") + where[n][2].to_bytes(2, "big") for n in sorted(where))
        self._put(own, filtered(body, "FlateDecode", extra=b"/Type /XRef /W [1 4 2] /Size %d /Index [" % self.size + index + b"] " + trailer))
        return at

    def bytes(self) -> bytes:
        return bytes(self.data)


def page_file(content: bytes, version: str = "1.4", extra: dict[int, bytes] | None = None) -> bytes:
    """One page whose content stream is object 4, given as a whole stream body."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", 4: content}
    return Pdf(version).revision(objects | (extra or {}), b"/Root 1 0 R").bytes()


# ----------------------------------------------------------------- encryption

FILL = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")  # ISO 32000-1, 7.6.3.3


def arcfour(key: bytes, data: bytes) -> bytes:
    s = list(range(256))
    j = 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) % 256
        s[i], s[j] = s[j], s[i]
    i = j = 0
    out = bytearray()
    for c in data:
        i = (i + 1) % 256
        j = (j + s[i]) % 256
        s[i], s[j] = s[j], s[i]
        out.append(c ^ s[(s[i] + s[j]) % 256])
    return bytes(out)


def legacy_keys(user: bytes, owner: bytes, file_id: bytes, revision: int, size: int, permissions: int = -4) -> tuple[bytes, bytes, bytes]:
    """O, U and the file key for revisions 2 to 4."""
    k = hashlib.md5((owner + FILL)[:32]).digest()
    for _ in range(50 if revision > 2 else 0):
        k = hashlib.md5(k).digest()
    o = (user + FILL)[:32]
    for i in range(20 if revision > 2 else 1):
        o = arcfour(bytes(b ^ i for b in k[:size]), o)
    k = hashlib.md5((user + FILL)[:32] + o + permissions.to_bytes(4, "little", signed=True) + file_id).digest()
    for _ in range(50 if revision > 2 else 0):
        k = hashlib.md5(k[:size]).digest()
    k = k[:size]
    if revision == 2:
        return o, arcfour(k, FILL), k
    u = hashlib.md5(FILL + file_id).digest()
    for i in range(20):
        u = arcfour(bytes(b ^ i for b in k), u)
    return o, u + bytes(16), k


def object_key(key: bytes, num: int, aes: bool) -> bytes:
    return hashlib.md5(key + num.to_bytes(3, "little") + b"\0\0" + (b"sAlT" if aes else b"")).digest()[: min(len(key) + 5, 16)]


def generate(df: DataFrame, make: Callable[[dict], tuple[str, bytes]]) -> DataFrame:
    """(path, content) of one file for each row, by a function of the row as a dict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [make(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.binary())], names=["path", "content"])

    lower_batches(df.sparkSession, 2000, 4 << 20)
    return df.mapInArrow(run, "path string, content binary")


def write_files(files: DataFrame, folder: str) -> None:
    """Write the contents under a folder that all executors share, named by their paths; a task
    that is run again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{root}/{path}.pdf") as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    files.mapInArrow(run, "n bigint").agg({"n": "sum"}).collect()

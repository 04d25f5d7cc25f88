"""One file: its chain of cross-reference sections, and its objects on demand."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..errors import PDFError, PDFLexicalError, PDFSyntaxError, PDFUnsupportedError, around
from ..functions import ciphers, filters
from .lexer import REGULAR, token_at
from .objects import FLAT_ARRAY, FLAT_DICT, Hex, Indirect, Name, Reader, Ref, Str, Stream, flat_array, flat_dict

START = re.compile(rb"startxref[\x00\t\n\x0c\r ]*(\d+)")
HEADER = re.compile(rb"[^\r\n]*")
ENTRIES = re.compile(rb"(?:\d{10} \d{5} [nf](?: [\r\n]|\r\n))*+")  # of the length that the standard asks for
FIELDS = re.compile(rb"(\d{10}) (\d{5}) ([nf])")
ENTRY = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+)[ \t]+(\d+)[ \t]+([nf])(?![!-~])")
PAIR = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*(\d+)[\x00\t\n\x0c\r ]+(\d+)(?=[\x00\t\n\x0c\r ])")
_BLANK = rb"[\x00\t\n\x0c\r ]"
#: What most files hold, each read by one match; anything else goes token by token.
XREF = re.compile(rb"xref(?=[\r\n ])")
FLAT_TRAILER = re.compile(_BLANK + rb"*+trailer" + _BLANK + rb"*+<<(" + FLAT_DICT.pattern + rb")(?=" + _BLANK + rb"++startxref)")
FLAT_OBJECT = re.compile(_BLANK + rb"*+\d++" + _BLANK + rb"++\d++" + _BLANK + rb"++obj(?:" + _BLANK + rb"*+<<(" + FLAT_DICT.pattern + rb")|" + _BLANK + rb"*+\[(" + FLAT_ARRAY.pattern + rb")|" + _BLANK + rb"++([+-]?+\d++)(?=" + _BLANK + rb"))" + _BLANK + rb"*+endobj(?![" + REGULAR + rb"])")
#: Keys of an xref stream's dictionary that belong to the trailer.
TRAILER_KEYS = ("Root", "ID", "Size", "Encrypt", "Info", "Prev")
MOST_SECTIONS = 100_000


@dataclass(slots=True, unsafe_hash=True)
class Entry:
    """kind n: at offset; c: member idx of object stream objstm; f: free."""

    kind: str
    num: int
    gen: int = 0
    offset: int | None = None
    objstm: int | None = None
    idx: int | None = None
    ended: int = 0  # of a free entry: the generation that was freed


@dataclass
class Section:
    rev: int
    pos: int
    kind: str  # table, stream, hybrid
    trailer: dict
    entries: list[Entry] = field(default_factory=list)
    prev: int | None = None


def version_of(data: bytes) -> str:
    """The first line without its first character."""
    return HEADER.match(data)[0][1:].decode("latin-1")


class PdfFile:
    """Index of a file; objects are parsed when asked for. The index of the file is read on
    creation; of two entries for a number the newer revision's counts. References name a
    number and a generation: of two entries for both the newer one counts, and a free one
    stands for the generation that it ended."""

    def __init__(self, data: bytes, password: str | bytes | None = None):
        self.data = data
        self.version = version_of(data)
        self.sections = self._read_sections()
        self.trailer: dict = {}
        for s in self.sections:  # newest first
            for k, v in s.trailer.items():
                self.trailer.setdefault(k, v)
        self.latest: dict[int, Entry] = {}
        self.by_generation: dict[tuple[int, int], Entry] = {}
        for s in self.sections:
            for e in s.entries:
                self.latest.setdefault(e.num, e)
                self.by_generation.setdefault((e.num, e.ended if e.kind == "f" else e.gen), e)
        self._members: dict[int, dict[int, object]] = {}
        self.security = None
        encrypt = self.trailer.get("Encrypt")
        if encrypt is not None:
            if isinstance(encrypt, Ref):
                self.encrypt_num = encrypt.num
                encrypt = self.get(encrypt)
            if not isinstance(encrypt, dict):
                raise PDFSyntaxError("Encrypt is no dictionary")
            ids = self.trailer.get("ID")
            ids = self.get(ids)
            first = ids[0] if isinstance(ids, list) and ids else b""
            first = first.decoded if isinstance(first, Hex) else bytes(first)
            self.security = ciphers.security_of(encrypt, first, password)

    encrypt_num: int | None = None

    # ------------------------------------------------------------- sections

    def _read_sections(self) -> list[Section]:
        found = None
        at = self.data.rfind(b"startxref")
        while at >= 0 and (found := START.match(self.data, at)) is None:
            at = self.data.rfind(b"startxref", 0, at)
        if found is None:
            raise PDFSyntaxError("no startxref", len(self.data), around(self.data, len(self.data)))
        out, pos, seen = [], int(found[1]), set()
        while pos is not None:
            if pos in seen or len(out) > MOST_SECTIONS:
                raise PDFSyntaxError("the chain of cross-reference sections has a loop", pos, around(self.data, pos))
            seen.add(pos)
            at = pos + 4 if XREF.match(self.data, pos) else None
            if at is None and (t := token_at(self.data, pos)) is not None and (t.tag, t.value) == ("keyword", "xref"):
                at = t.end
            if at is not None:
                section = self._table(len(out), pos, at)
                extra = section.trailer.get("XRefStm")
                if isinstance(extra, int):  # behind its table, so that the table counts first
                    section.kind = "hybrid"
                    known = {e.num for e in section.entries if e.kind != "f"}
                    hidden = [e for e in self._stream(len(out), extra).entries if e.num not in known]
                    over = {e.num for e in hidden}
                    section.entries = [e for e in section.entries if e.num not in over] + hidden
            else:
                section = self._stream(len(out), pos)
            out.append(section)
            prev = section.trailer.get("Prev")
            pos = section.prev = prev if isinstance(prev, int) and not isinstance(prev, bool) else None
        return out

    def _table(self, rev: int, pos: int, at: int) -> Section:
        entries: list[Entry] = []
        while (m := PAIR.match(self.data, at)) is not None:
            first, many, at = int(m[1]), int(m[2]), m.end()
            start = at + 2 if self.data.startswith((b"\r\n", b" \n", b" \r"), at) else at + 1
            if 0 < many < (1 << 32) and (found := ENTRIES.match(self.data, start, start + 20 * many)).end() == start + 20 * many:
                for num, row in enumerate(FIELDS.findall(found[0]), first):
                    offset, gen, kind = row
                    if num:
                        entries.append(Entry("n", num, int(gen), int(offset)) if kind == b"n" else Entry("f", num, int(gen), ended=int(gen) - 1))
                at = found.end() - 2
                continue
            for k in range(many):
                e = ENTRY.match(self.data, at)
                if e is None:
                    raise PDFSyntaxError("a cross-reference entry is broken", at, around(self.data, at))
                at = e.end()
                if first + k == 0:
                    continue
                offset, gen, kind = e.groups()
                if kind == b"n":
                    entries.append(Entry("n", first + k, int(gen), int(offset)))
                else:
                    entries.append(Entry("f", first + k, int(gen), ended=int(gen) - 1))
        if (m := FLAT_TRAILER.match(self.data, at)) is not None:
            return Section(rev, pos, "table", flat_dict(self.data, *m.span(1)), entries)
        t = token_at(self.data, at)
        if t is None or (t.tag, t.value) != ("keyword", "trailer"):
            raise PDFSyntaxError("no trailer after a cross-reference table", at, around(self.data, at))
        try:
            trailer = Reader(self.data, t.end).read()
        except StopIteration:
            trailer = None
        if not isinstance(trailer, dict):
            raise PDFSyntaxError("a trailer is no dictionary", t.end, around(self.data, t.end))
        return Section(rev, pos, "table", trailer, entries)

    def _stream(self, rev: int, pos: int) -> Section:
        try:
            found = Reader(self.data, pos).read()
        except StopIteration:
            found = None
        stream = found.value if isinstance(found, Indirect) else None
        if not isinstance(stream, Stream) or stream.entries.get("Type") != Name("XRef"):
            raise PDFSyntaxError("no cross-reference section", pos, around(self.data, pos))
        d = stream.entries
        body = filters.decode(stream.raw, *self.filters_of(d, direct=True))
        w, size = d.get("W"), d.get("Size")
        if not isinstance(w, list) or len(w) < 3 or not all(isinstance(x, int) and x >= 0 for x in w):
            raise PDFSyntaxError("W of a cross-reference stream is broken", pos, around(self.data, pos))
        index = d.get("Index", [0, size])
        entries, at, step = [], 0, sum(w)
        for first, many in zip(index[::2], index[1::2], strict=False):
            for num in range(first, first + many):
                row = body[at : at + step]
                if len(row) < step:
                    raise PDFSyntaxError("a cross-reference stream is too short", pos, around(self.data, pos))
                at += step
                a = int.from_bytes(row[: w[0]], "big") if w[0] else 1
                b, c = int.from_bytes(row[w[0] : w[0] + w[1]], "big"), int.from_bytes(row[w[0] + w[1] : w[0] + w[1] + w[2]], "big")
                if num == 0 and a == 0:
                    continue
                if a == 0:
                    entries.append(Entry("f", num, c, ended=c - 1))
                elif a == 1:
                    entries.append(Entry("n", num, c, offset=b))
                elif a == 2:
                    entries.append(Entry("c", num, 0, objstm=b, idx=c))
        return Section(rev, pos, "stream", {k: d[k] for k in TRAILER_KEYS if k in d}, entries)

    # -------------------------------------------------------------- objects

    def filters_of(self, d: dict, direct: bool = False) -> tuple[list[str], list[dict | None]]:
        """Names and parameters of the filters of a stream's dictionary."""
        look = (lambda v: v) if direct else self.get
        names, parms = look(d.get("Filter")), look(d.get("DecodeParms"))
        if look(d.get("F")) is not None:
            raise PDFUnsupportedError("streams in external files")
        names = [] if names is None else [look(n) for n in names] if isinstance(names, list) else [names]
        parms = [] if parms is None else [look(p) for p in parms] if isinstance(parms, list) else [parms]
        parms = [{k: look(v) for k, v in p.items()} if isinstance(p, dict) else None for p in parms]
        return [str(n) for n in names], parms

    def _length(self, d: dict) -> int:
        length = d.get("Length")
        try:
            length = self.get(length)
        except RecursionError:
            length = None
        if not isinstance(length, int) or isinstance(length, bool):
            raise PDFSyntaxError("the length of a stream is missing or no integer")
        return length

    def find(self, ref: Ref) -> tuple[str, Entry | None]:
        """What a reference finds: ``found``, ``free``, ``generation`` (the number is in use, but
        not under that generation) or ``missing``; and the entry."""
        newest = self.latest.get(ref.num)
        if newest is None or newest.kind == "f":
            return ("missing" if newest is None else "free"), newest
        e = self.by_generation.get((ref.num, ref.gen))
        if e is None:
            return "generation", None
        return ("free" if e.kind == "f" else "found"), e

    def get(self, value: object) -> object:
        """The value itself, or what it refers to: None if there is nothing or it is free."""
        if not isinstance(value, Ref):
            return value
        e = self.find(value)[1]
        return None if e is None or e.kind == "f" else self.read(e)

    def object(self, num: int) -> object:
        """The current value of an object, whatever its generation; None if there is none or it is free."""
        e = self.latest.get(num)
        return None if e is None else self.read(e)

    def read(self, e: Entry) -> object:
        if e.kind == "f":
            return None
        if e.kind == "c":
            members = self._object_stream(e.objstm)
            if e.num not in members:
                raise PDFSyntaxError(f"object {e.num} is not in object stream {e.objstm}")
            return members[e.num]
        if (m := FLAT_OBJECT.match(self.data, e.offset)) is not None:
            kind = m.lastindex
            value = int(m[3]) if kind == 3 else flat_dict(self.data, *m.span(1)) if kind == 1 else flat_array(self.data, *m.span(2))
        else:
            try:
                found = Reader(self.data, e.offset, length_of=self._length).read()
            except StopIteration:
                found = None
            if not isinstance(found, Indirect):
                raise PDFSyntaxError("no indirect object where the cross-reference table says", e.offset, around(self.data, e.offset))
            value = found.value
        if self.security and e.num != self.encrypt_num:
            value = self._clear(value, e.num, e.gen)
        return value

    def _clear(self, value: object, num: int, gen: int) -> object:
        """The value with its strings decrypted; data of streams stays."""
        if isinstance(value, (Str, Hex)):
            return Str(self.security.string(value.decoded if isinstance(value, Hex) else bytes(value), num, gen))
        if isinstance(value, list):
            return [self._clear(v, num, gen) for v in value]
        if isinstance(value, dict):
            return {k: self._clear(v, num, gen) for k, v in value.items()}
        if isinstance(value, Stream) and value.entries.get("Type") != Name("XRef"):
            return Stream({k: self._clear(v, num, gen) for k, v in value.entries.items()}, value.start, value.length, value.raw)
        return value

    def cipher_of(self, stream: Stream, num: int, gen: int) -> tuple[str, bytes]:
        """Method and key that a stream's data is encrypted with."""
        if not self.security:
            return "Identity", b""
        method = self.security.method_of(stream)
        return method, b"" if method == "Identity" else self.security.object_key(num, gen, method)

    def stream_bytes(self, stream: Stream, num: int, gen: int, known: dict | None = None) -> bytes:
        return filters.decode(ciphers.decrypt(*self.cipher_of(stream, num, gen), stream.raw), *self.filters_of(stream.entries), known)

    def _object_stream(self, num: int) -> dict[int, object]:
        """All members of an object stream, decoded once."""
        if num not in self._members:
            self._members[num] = {}  # a stream that is its own member ends here
            e = self.latest.get(num)
            stream = self.read(e) if e is not None and e.kind == "n" else None
            if not isinstance(stream, Stream):
                raise PDFSyntaxError(f"object stream {num} is missing")
            body = self.stream_bytes(stream, num, e.gen)
            many, first = (self.get(stream.entries.get(k)) for k in ("N", "First"))
            head = Reader(body)
            try:
                pairs = [head.read() for _ in range(2 * many)]
            except (StopIteration, TypeError):
                pairs = [None]
            if not all(isinstance(x, int) for x in pairs):
                raise PDFSyntaxError(f"the head of object stream {num} is broken")
            for member, at in zip(pairs[::2], pairs[1::2], strict=True):
                try:
                    self._members[num][member] = Reader(body, first + at).read()
                except StopIteration:
                    self._members[num][member] = None
        return self._members[num]

    def objects(self, live: bool = True) -> Iterator[tuple[Entry, object, PDFError | None]]:
        """Every object in use, with its value or the error that reading it gave."""
        for e in sorted(self.latest.values(), key=lambda e: e.num):
            if e.kind == "f" and live:
                continue
            try:
                yield e, self.read(e), None
            except PDFError as error:
                yield e, None, error
            except RecursionError:
                yield e, None, PDFSyntaxError("objects refer to themselves for their length")


__all__ = ["Entry", "PdfFile", "Section", "PDFLexicalError", "version_of"]

"""Tokens to objects.

Values: bool, int, float, None, list and dict as such; Name, Str (bytes of a literal
string), Hex (digits of a hexadecimal string), Ref, Operator and Stream as types of
their own, so that values of different kinds never compare equal.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from ..errors import PDFLexicalError, PDFSyntaxError, around
from .lexer import REGULAR, WHITE, Token, token_at, tokens

DEEPEST = 400
END_STREAM = re.compile(rb"[\x00\t\n\x0c\r ]*endstream")
STREAM_START = re.compile(rb"\r?\n")
GAP = rb"(?:[" + WHITE + rb"]++|%[^\r\n]*+)"
#: What makes an integer the start of a reference or an indirect object.
AFTER_NUMBER = re.compile(GAP + rb"++\+?+(\d++)" + GAP + rb"++(R|obj)(?![" + REGULAR + rb"])")
STREAM_WORD = re.compile(GAP + rb"*+stream(?![" + REGULAR + rb"])")
END_OBJECT = re.compile(GAP + rb"*+endobj(?![" + REGULAR + rb"])")
#: Dictionaries and arrays of plain values are read by one match and one findall; whatever else
#: they hold (comments, number signs, escapes, nested ones) goes token by token, with the same result.
_BLANK = rb"[" + WHITE + rb"]"
_WORD = rb"[" + REGULAR.replace(rb"!-$", rb"!\"$") + rb"]++"
_REF = rb"\d++" + _BLANK + rb"++\d++" + _BLANK + rb"++R"
_INT, _REAL = rb"[+-]?+\d++", rb"[+-]?+(?:\d++\.\d*+|\.\d++)"
_STRING, _HEX = rb"\([^()\\\r]*+\)", rb"<[0-9A-Fa-f]*+>"
_END = rb"(?=[" + WHITE + rb"/()<>\[\]])"
_SIMPLE = rb"(?:/" + _WORD + rb"|(?>" + _REF + rb"|" + _REAL + rb"|" + _INT + rb"|true|false|null)" + _END + rb"|" + _STRING + rb"|" + _HEX + rb")"
FLAT_DICT = re.compile(rb"(?:" + _BLANK + rb"*+/" + _WORD + _BLANK + rb"*+" + _SIMPLE + rb")*+" + _BLANK + rb"*+>>")
FLAT_ARRAY = re.compile(rb"(?:" + _BLANK + rb"*+" + _SIMPLE + rb")*+" + _BLANK + rb"*+\]")
_VALUE = rb"(?:/(" + _WORD + rb")|(\d++)" + _BLANK + rb"++(\d++)" + _BLANK + rb"++R" + _END + rb"|(" + _INT + rb")" + _END + rb"|(" + _REAL + rb"|true|false|null|" + _STRING + rb"|" + _HEX + rb"))"
FLAT_PAIRS = re.compile(rb"/(" + _WORD + rb")" + _BLANK + rb"*+" + _VALUE)
FLAT_VALUES = re.compile(_VALUE)
_CONSTANTS = {b"true": True, b"false": False, b"null": None}


class Name(str):
    __slots__ = ()

    def __eq__(self, other):
        return isinstance(other, Name) and str.__eq__(self, other)

    def __ne__(self, other):
        return not self == other

    __hash__ = str.__hash__


class Str(bytes):
    __slots__ = ()


class Hex(bytes):
    """Digits without blanks; ``decoded`` pads an odd number of them with 0."""

    __slots__ = ()

    @property
    def decoded(self) -> bytes:
        return bytes.fromhex((self + b"0" * (len(self) % 2)).decode("ascii"))


@dataclass(frozen=True)
class Operator:
    name: str


@dataclass(slots=True, unsafe_hash=True)  # not frozen, which would triple the time of making one
class Ref:
    num: int
    gen: int


@dataclass
class Stream:
    entries: dict
    start: int
    length: int
    raw: bytes


@dataclass
class Indirect:
    num: int
    gen: int
    value: object


def _flat(word: bytes, num: bytes, gen: bytes, whole: bytes, other: bytes) -> object:
    """A value from the groups of ``_VALUE``."""
    if num:
        return Ref(int(num), int(gen))
    if whole:
        return int(whole)
    if word:
        return Name(word.decode())
    c = other[0]
    if c == 40:
        return Str(other[1:-1])
    if c == 60:
        return Hex(other[1:-1])
    return _CONSTANTS[other] if other in _CONSTANTS else float(other)


def flat_dict(data: bytes, start: int, end: int) -> dict:
    """Of a dictionary that FLAT_DICT has matched there."""
    return {k.decode(): Ref(int(num), int(gen)) if num else int(whole) if whole else _flat(word, num, gen, whole, other) for k, word, num, gen, whole, other in FLAT_PAIRS.findall(data, start, end)}


def flat_array(data: bytes, start: int, end: int) -> list:
    """Of an array that FLAT_ARRAY has matched there."""
    return [Ref(int(num), int(gen)) if num else _flat(word, num, gen, whole, other) for word, num, gen, whole, other in FLAT_VALUES.findall(data, start, end)]


class Reader:
    """Objects from a position on. ``length_of`` gives the length of a stream from its
    dictionary where that is not a direct integer."""

    def __init__(self, data: bytes, pos: int = 0, content_mode: bool = False, length_of: Callable[[dict], int] | None = None):
        self.data, self.pos, self.content_mode, self.length_of = data, pos, content_mode, length_of

    def _next(self) -> Token | None:
        t = token_at(self.data, self.pos)
        if t is not None:
            self.pos = t[3]
        return t

    def _need(self, what: str) -> Token:
        t = self._next()
        if t is None:
            raise PDFSyntaxError(f"the input ends within {what}", len(self.data), around(self.data, len(self.data)))
        return t

    def _fail(self, message: str, t: Token):
        raise PDFSyntaxError(message, t.pos, around(self.data, t.pos))

    def read(self) -> object:
        """The next object; raises StopIteration at the end."""
        t = self._next()
        if t is None:
            raise StopIteration
        return self._object(t, 0)

    def __iter__(self) -> Iterator[object]:
        while True:
            try:
                value = self.read()
            except StopIteration:
                return
            yield value

    def _object(self, t: Token, depth: int) -> object:
        tag, value = t[0], t[1]
        if tag == "name":
            return Name(value)
        if tag == "integer":
            return self._after_integer(t, depth)
        if tag == "string":
            return Str(value)
        if tag == "hex":
            return Hex(value)
        if tag in ("real", "bool", "null"):
            return value
        if depth > DEEPEST:
            self._fail("objects are nested too deeply", t)
        if tag == "dict_delim" and value == "<<":
            return self._after_dict(self._dict(depth))
        if tag == "singleton" and value == "[":
            if (m := FLAT_ARRAY.match(self.data, self.pos)) is not None:
                at, self.pos = self.pos, m.end()
                return flat_array(self.data, at, self.pos)
            out = []
            while not ((t := self._need("an array")).tag == "singleton" and t.value == "]"):
                out.append(self._object(t, depth + 1))
            return out
        if tag in ("operator", "singleton") and self.content_mode and value not in ("[", "]"):
            return Operator(value)
        self._fail(f"{tag} {value!r} starts no object", t)

    def _dict(self, depth: int) -> dict:
        if (m := FLAT_DICT.match(self.data, self.pos)) is not None:
            at, self.pos = self.pos, m.end()
            return flat_dict(self.data, at, self.pos)
        out = {}
        while not ((t := self._need("a dictionary"))[0] == "dict_delim" and t[1] == ">>"):
            if t[0] != "name":
                self._fail("a dictionary key is no name", t)
            out[t[1]] = self._object(self._need("a dictionary"), depth + 1)
        return out

    def _after_integer(self, t: Token, depth: int) -> object:
        """Three tokens may make a reference or start an indirect object."""
        m = AFTER_NUMBER.match(self.data, t.end)
        if m is None or t.value < 0:
            return t.value
        if m[2] == b"R":
            self.pos = m.end()
            return Ref(t.value, int(m[1]))
        self.pos = m.end()
        value = self._object(self._need("an indirect object"), depth + 1)
        if (e := END_OBJECT.match(self.data, self.pos)) is not None:
            self.pos = e.end()
            return Indirect(t.value, int(m[1]), value)
        end = self._need("an indirect object")
        if (end.tag, end.value) != ("keyword", "endobj"):
            self._fail("an indirect object does not end with endobj", end)
        return Indirect(t.value, int(m[1]), value)

    def _after_dict(self, entries: dict) -> object:
        t = STREAM_WORD.match(self.data, self.pos)
        if t is None:
            return entries
        start = t.end()
        m = STREAM_START.match(self.data, start)
        if m is None:
            raise PDFLexicalError("stream is not followed by a line feed", start, around(self.data, start))
        length = entries.get("Length")
        if not isinstance(length, int) or isinstance(length, bool):
            if self.length_of is None:
                raise PDFSyntaxError("a stream has no direct integer length", start, around(self.data, start))
            length = self.length_of(entries)
        end = END_STREAM.match(self.data, m.end() + length) if 0 <= length <= len(self.data) else None
        if end is None:
            raise PDFSyntaxError("no endstream where the length of a stream says", start, around(self.data, start))
        self.pos = end.end()
        return Stream(entries, m.end(), length, bytes(self.data[m.end() : m.end() + length]))


_TAGS = {bool: "bool", int: "integer", float: "real", Name: "name", Str: "string", Hex: "hex", Ref: "ref", Operator: "operator", Stream: "stream", dict: "dict", list: "array", Indirect: "indirect"}


def tag_of(value: object) -> str:
    return _TAGS.get(type(value), "null")


def to_plain(value: object) -> object:
    """A value for JSON: scalars and containers as such, other kinds as tagged objects."""
    if isinstance(value, Name):
        return {"t": "name", "v": str(value)}
    if isinstance(value, (Str, Hex)):
        return {"t": tag_of(value), "b64": base64.b64encode(value).decode("ascii")}
    if isinstance(value, Ref):
        return {"t": "ref", "n": value.num, "g": value.gen}
    if isinstance(value, Operator):
        return {"t": "operator", "v": value.name}
    if isinstance(value, Stream):
        return {"t": "stream", "dict": to_plain(value.entries)}
    if isinstance(value, Indirect):
        return {"t": "indirect", "n": value.num, "g": value.gen, "v": to_plain(value.value)}
    if isinstance(value, dict):
        return {k: to_plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [to_plain(v) for v in value]
    return value


def nodes_of(value: object) -> Iterator[tuple]:
    """The tree of a value in pre-order: (node_id, parent_id, key, pos, tag, bool, long, double, name, bytes, ref num, ref gen)."""
    count = 0
    stack: list[tuple] = [(value, None, None, None)]
    while stack:
        v, parent, key, pos = stack.pop()
        node, tag = count, tag_of(v)
        count += 1
        head = (node, parent, key, pos, tag)
        if tag == "integer":
            fits = -(1 << 63) <= v < 1 << 63
            yield (*head, None, v if fits else None, None, None if fits else str(v), None, None, None)
        elif tag == "name":
            yield (*head, None, None, None, str(v), None, None, None)
        elif tag == "real":
            yield (*head, None, None, v, None, None, None, None)
        elif tag in ("string", "hex"):
            yield (*head, None, None, None, None, bytes(v), None, None)
        elif tag == "ref":
            yield (*head, None, None, None, None, None, v.num, v.gen)
        else:
            yield (*head, v if tag == "bool" else None, None, None, v.name if tag == "operator" else None, None, None, None)
        if tag == "array":
            stack.extend((x, node, None, i) for i, x in zip(range(len(v) - 1, -1, -1), reversed(v), strict=True))
        elif tag in ("dict", "stream"):
            stack.extend((x, node, k, None) for k, x in reversed((v if tag == "dict" else v.entries).items()))


def parse_sequence(data: bytes, content_mode: bool = True, stream_reader: Callable[[dict], int] | None = None) -> Iterator[object]:
    """Top-level objects of a byte sequence, one after the other. ``stream_reader`` gives the
    length of a stream from its dictionary where that is no direct integer, as for lengths that
    are references; without it such a stream is an error."""
    return iter(Reader(data, 0, content_mode, stream_reader))


__all__ = ["Hex", "Indirect", "Name", "Operator", "Reader", "Ref", "Str", "Stream", "nodes_of", "parse_sequence", "tag_of", "to_plain", "tokens"]

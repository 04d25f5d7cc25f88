"""Bytes to tokens.

One compiled pattern recognises every token but literal strings, whose nesting is
followed by a second pattern over their special bytes. A token is (tag, value, pos,
end); tags: integer, real, string, hex, name, bool, null, keyword, singleton,
dict_delim, operator, inline_image.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from ..errors import PDFLexicalError, around

# Fixed values of ISO 32000-1, 7.2 and 7.3.
WHITE = rb"\x00\t\n\x0c\r "
DELIMITERS = rb"()<>\[\]{}/%"
REGULAR = rb"!-$&'*-.0-;=?-Z\\^-z|~"  # printable, and no delimiter
KEYWORDS = (b"endobj", b"obj", b"trailer", b"xref", b"startxref", b"endstream", b"stream")
#: Words that are no operators: (tag, value).
WORDS = {b"true": ("bool", True), b"false": ("bool", False), b"null": ("null", None)} | {w: ("keyword", w.decode()) for w in KEYWORDS}
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}

#: Blanks and comments, then one token or the end; nothing in it is ever matched twice.
TOKEN = re.compile(
    rb"(?>(?:[" + WHITE + rb"]++|%[^\r\n]*+)*+)(?:(?P<name>/[" + REGULAR + rb"]*+)|(?P<integer>[+-]?+\d++(?!\.))|(?P<dict_delim><<|>>)|(?P<singleton>[\[\]{}])"
    rb"|(?P<real>[+-]?+(?:\d++\.\d*+|\.\d++))|(?P<word>[" + REGULAR + rb"]++)|(?P<open>\()|(?P<hex><[0-9A-Fa-f" + WHITE + rb"]*+>)|(?P<end>\Z))"
)
SKIP = re.compile(rb"(?:[" + WHITE + rb"]++|%[^\r\n]*+)*+")
IN_STRING = re.compile(rb"[()\\\r]")
ESCAPED = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|\r|\n)|(.))|\r\n?", re.S)
NAME_CODE = re.compile(rb"#(.{0,2})", re.S)
BLANKS = re.compile(rb"[" + WHITE + rb"]+")
IMAGE_END = re.compile(rb"[" + WHITE + rb"]EI(?=[" + WHITE + DELIMITERS + rb"]|\Z)")


class Token(NamedTuple):
    tag: str
    value: object
    pos: int
    end: int


def unescape(raw: bytes) -> bytes:
    """The bytes of a literal string written without its outer parentheses: escapes of one
    letter, one to three octal digits modulo 256, line ends after a backslash dropped, any
    other backslash dropped, other line ends read as one line feed."""

    def one(m: re.Match) -> bytes:
        octal, line_end, other = m.groups()
        if octal is not None:
            return bytes((int(octal, 8) & 255,))
        if other is not None:
            return ESCAPES.get(other, other)
        return b"" if line_end is not None else b"\n"

    return ESCAPED.sub(one, raw) if b"\\" in raw or b"\r" in raw else raw


def unescape_name(raw: bytes, pos: int, data: bytes) -> str:
    def one(m: re.Match) -> bytes:
        try:
            return bytes.fromhex(m[1].decode("ascii")) if len(m[1]) == 2 else _bad()
        except ValueError:
            raise PDFLexicalError("a number sign in a name is not followed by two hexadecimal digits", pos, around(data, pos)) from None

    return NAME_CODE.sub(one, raw).decode("utf-8", "replace") if b"#" in raw else raw.decode("utf-8", "replace")


def _bad() -> bytes:
    raise ValueError


def string_end(data: bytes, pos: int) -> int:
    """Position after the parenthesis that closes the one at pos."""
    depth, at = 0, pos
    while m := IN_STRING.search(data, at):
        c, at = m[0], m.end()
        if c == b"(":
            depth += 1
        elif c == b")":
            depth -= 1
            if not depth:
                return at
        elif c == b"\\":
            at += 1
    raise PDFLexicalError("a literal string has no end", pos, around(data, pos))


def token_at(data: bytes, pos: int, match=TOKEN.match, new=tuple.__new__) -> Token | None:
    """The token at or after pos; None at the end."""
    m = match(data, pos)
    if m is None:
        pos = SKIP.match(data, pos).end()
        raise PDFLexicalError("bytes that start no token", pos, around(data, pos))
    kind = m.lastgroup
    pos, end = m.span(kind)
    if kind == "name":
        raw = data[pos + 1 : end]
        return new(Token, ("name", unescape_name(raw, pos, data) if b"#" in raw else raw.decode(), pos, end))
    if kind == "integer":
        return new(Token, ("integer", int(m[kind]), pos, end))
    if kind == "dict_delim" or kind == "singleton":
        return new(Token, (kind, m[kind].decode(), pos, end))
    if kind == "end":
        return None
    if kind == "open":
        end = string_end(data, pos)
        return new(Token, ("string", unescape(data[pos + 1 : end - 1]), pos, end))
    raw = m[kind]
    if kind == "real":
        return new(Token, ("real", float(raw), pos, end))
    if kind == "hex":
        return new(Token, ("hex", BLANKS.sub(b"", raw[1:-1]), pos, end))
    word = WORDS.get(raw)
    if word is not None:
        return new(Token, (*word, pos, end))
    if raw[:1] in b"+-.":
        raise PDFLexicalError("a sign or point without digits", pos, around(data, pos))
    return new(Token, ("operator", unescape_name(raw, pos, data), pos, end))


def tokens(data: bytes, pos: int = 0) -> Iterator[Token]:
    """All tokens from pos on. The data of an inline image (after ID) is one token."""
    image = False
    while (t := token_at(data, pos)) is not None:
        yield t
        pos = t.end
        if t.tag == "operator":
            if t.value == "BI":
                image = True
            elif t.value == "ID" and image:
                image = False
                m = IMAGE_END.search(data, pos)
                end = m.start() if m else len(data)
                yield Token("inline_image", bytes(data[pos + 1 : end]), pos + 1, end)
                pos = end

"""Errors of reading PDF files; their class names are also the values of error columns."""

from __future__ import annotations

from contextvars import ContextVar

_context_size: ContextVar[int] = ContextVar("context_size", default=200)


class PDFError(Exception):
    """An error at a byte position, with the bytes around it."""

    def __init__(self, message: str, pos: int | None = None, context: bytes = b""):
        super().__init__(message if pos is None else f"{message} (at byte {pos})")
        self.pos, self.context = pos, context


class PDFGenericError(PDFError):
    """A value outside what the format allows."""


class PDFLexicalError(PDFError):
    """Bytes that are no token."""


class PDFSyntaxError(PDFError):
    """Tokens that are no object, or a structure that is broken."""


class PDFUnsupportedError(PDFError):
    """A feature that is not implemented."""


class PDFWrongPasswordError(PDFError):
    """Neither the user's nor the owner's password."""


def set_context_size(size: int) -> None:
    """How many bytes of context errors carry from now on; 200 at first."""
    _context_size.set(size)


def around(data: bytes, pos: int) -> bytes:
    """Bytes about a position, for error columns."""
    half = _context_size.get() // 2
    return bytes(data[max(0, pos - half) : pos + half])

"""PDF files at the object level as Spark DataFrames."""

from .errors import PDFError, PDFGenericError, PDFLexicalError, PDFSyntaxError, PDFUnsupportedError, PDFWrongPasswordError
from .functions.filters import register_filter
from .grammar.objects import parse_sequence
from .operators import Pdfs
from .sources.files import pdfs_of, read_pdfs, register_source
from .streaming import stream_pdfs

__all__ = ["PDFError", "PDFGenericError", "PDFLexicalError", "PDFSyntaxError", "PDFUnsupportedError", "PDFWrongPasswordError", "Pdfs", "parse_sequence", "pdfs_of", "read_pdfs", "register_filter", "register_source", "stream_pdfs"]

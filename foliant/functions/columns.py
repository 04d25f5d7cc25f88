"""Column functions and table functions over bytes of PDF."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import PDFError
from ..grammar.lexer import tokens
from ..grammar.objects import Reader, nodes_of, tag_of, to_plain
from . import ciphers, filters

ERROR = "struct<class:string,msg:string,pos:bigint,context:binary>"
TOKEN = "struct<seq:int,pos:bigint,tag:string,bool_val:boolean,long_val:bigint,double_val:double,name_val:string,bytes_val:binary>"
NODE = "struct<node_id:int,parent_id:int,key:string,pos:int,tag:string,bool_val:boolean,long_val:bigint,double_val:double,name_val:string,bytes_val:binary,ref_num:int,ref_gen:int>"
NODE_FIELDS = ("node_id", "parent_id", "key", "pos", "tag", "bool_val", "long_val", "double_val", "name_val", "bytes_val", "ref_num", "ref_gen")


#: The same as Arrow types, for workers, which have no session to parse them with.
_VALUES = [("tag", pa.string()), ("bool_val", pa.bool_()), ("long_val", pa.int64()), ("double_val", pa.float64()), ("name_val", pa.string()), ("bytes_val", pa.binary())]
TOKEN_LIST = pa.list_(pa.struct([("seq", pa.int32()), ("pos", pa.int64()), *_VALUES]))
NODE_LIST = pa.list_(pa.struct([("node_id", pa.int32()), ("parent_id", pa.int32()), ("key", pa.string()), ("pos", pa.int32()), *_VALUES, ("ref_num", pa.int32()), ("ref_gen", pa.int32())]))


def error_row(e: PDFError) -> dict:
    return {"class": type(e).__name__, "msg": str(e), "pos": e.pos, "context": e.context}


def arrow_type(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(ddl))


# ------------------------------------------------------------- JVM expressions

def pdf_version(content: Column) -> Column:
    """The first line without its first character; more than the head of the file is only
    looked at where the line goes on beyond it."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    line = F.when(head.rlike(r"[\r\n]"), head).otherwise(F.decode(content, "ISO-8859-1"))
    return F.substr(F.regexp_extract(line, r"^[^\r\n]*", 0), F.lit(2))


def pdf_unhex(digits: Column) -> Column:
    """Bytes of the digits of a hexadecimal string; an odd number is padded at the end."""
    text = F.decode(digits, "ISO-8859-1")
    return F.unhex(F.rpad(text, (F.length(text) + F.length(text) % 2).cast("int"), "0"))


def md5_bytes(c: Column) -> Column:
    return F.unhex(F.md5(c))


def legacy_file_key(password: Column, owner: Column, permissions: Column, file_id: Column, size: int, revision: int) -> Column:
    """The file key of revisions 2 to 4 from binary columns, by built-in functions."""
    fill = F.lit(ciphers.PAD)
    p = F.unhex(F.lpad(F.hex(F.pmod(permissions.cast("bigint"), F.lit(1 << 32))), 8, "0"))
    little = F.concat(*[F.substring(p, k, 1) for k in (4, 3, 2, 1)])
    first = md5_bytes(F.concat(F.substring(F.concat(password, fill), 1, 32), F.substring(owner, 1, 32), little, file_id))
    if revision >= 3:
        first = F.aggregate(F.sequence(F.lit(1), F.lit(50)), first, lambda k, _: md5_bytes(F.substring(k, 1, size)))
    return F.substring(first, 1, size)


def object_key(key: Column, num: Column, gen: Column, aes: bool) -> Column:
    """The key of one object for RC4 or 128-bit AES."""
    low = lambda c, n: F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(c.cast("bigint"), 8 * k) % 256), 2, "0")) for k in range(n)])
    whole = md5_bytes(F.concat(key, low(num, 3), low(gen, 2), F.lit(b"sAlT" if aes else b"")))
    return F.substr(whole, F.lit(1), F.least(F.octet_length(key) + 5, F.lit(16)))


def aes_cbc_encrypt(data: Column, key: Column, iv: Column, padding: bool = True) -> Column:
    """AES-CBC with padding, or without: data is then whole blocks, and the block that
    padding adds is cut off. The result starts with iv."""
    sealed = F.aes_encrypt(data, key, F.lit("CBC"), F.lit("PKCS"), iv)
    return sealed if padding else F.substr(sealed, F.lit(1), F.octet_length(sealed) - 16)


def aes_cbc_decrypt(data: Column, key: Column) -> Column:
    """Decrypt data led by its 16-byte vector; null where key, length or padding is wrong."""
    return F.try_aes_decrypt(data, key, F.lit("CBC"), F.lit("PKCS"))


# ----------------------------------------------------------- Arrow functions

def decode_function(registry: dict | None = None):
    """Decrypt and decode as an Arrow function of (raw, filters, parms as JSON, cipher, key);
    filters registered up to now go along."""
    known = dict(filters.FILTERS if registry is None else registry)
    kind = f"struct<data:binary,error:{ERROR}>"
    arrow = arrow_type(kind)

    def run(raw: pa.Array, names: pa.Array, parms: pa.Array, cipher: pa.Array, key: pa.Array) -> pa.Array:
        out = []
        for d, n, p, c, k in zip(*(x.to_pylist() for x in (raw, names, parms, cipher, key)), strict=True):
            if d is None:
                out.append(None)
                continue
            try:
                clear = ciphers.decrypt(c or "Identity", k or b"", d)
                out.append({"data": filters.decode(clear, n or [], [json.loads(x) if x else None for x in p or []], known), "error": None})
            except PDFError as e:
                out.append({"data": None, "error": error_row(e)})
        return pa.array(out, arrow)

    return F.arrow_udf(run, kind)


def pdf_decode(raw: Column, names: Column, parms: Column | None = None, cipher: Column | None = None, key: Column | None = None) -> Column:
    """Struct (data, error) of a stream's raw bytes after its cipher and filters."""
    none = F.lit(None)
    return decode_function()(raw, names, none.cast("array<string>") if parms is None else parms, none.cast("string") if cipher is None else cipher, none.cast("binary") if key is None else key)


def _rc4(data: pa.Array, key: pa.Array) -> pa.Array:
    return pa.array([None if d is None or not k else ciphers.rc4(k, d) for d, k in zip(data.to_pylist(), key.to_pylist(), strict=True)], pa.binary())


def rc4(data: Column, key: Column) -> Column:
    return F.arrow_udf(_rc4, "binary")(data, key)


def token_row(seq: int, tag: str, value: object, pos: int) -> dict:
    row = dict.fromkeys(("bool_val", "long_val", "double_val", "name_val", "bytes_val")) | {"seq": seq, "pos": pos, "tag": tag}
    if tag == "bool":
        row["bool_val"] = value
    elif tag == "integer":
        row |= {"long_val": value} if -(1 << 63) <= value < 1 << 63 else {"name_val": str(value)}
    elif tag == "real":
        row["double_val"] = value
    elif isinstance(value, bytes):
        row["bytes_val"] = bytes(value)
    elif value is not None:
        row["name_val"] = str(value)
    return row


def _tokens(data: pa.Array) -> pa.Array:
    return token_lists(data.to_pylist())


def token_lists(data: Sequence[bytes | None]) -> pa.Array:
    """Columns of all tokens first, then their lists: no object for each token."""
    seq, pos, tags, bools, longs, doubles, names, raw = ([] for _ in range(8))
    ends, empty = [0], []
    for d in data:
        k = 0
        empty.append(d is None)
        try:
            for tag, value, at, _ in tokens(d) if d else ():
                seq.append(k)
                pos.append(at)
                tags.append(tag)
                whole = tag == "integer" and -(1 << 63) <= value < 1 << 63
                bools.append(value if tag == "bool" else None)
                longs.append(value if whole else None)
                doubles.append(value if tag == "real" else None)
                raw.append(value if isinstance(value, bytes) else None)
                names.append(None if whole or value is None or tag in ("bool", "real") or isinstance(value, bytes) else str(value))
                k += 1
        except PDFError as e:
            for c, v in zip((seq, pos, tags, bools, longs, doubles, names, raw), (k, e.pos, "error", None, None, None, type(e).__name__, None), strict=True):
                c.append(v)
        ends.append(len(seq))
    kinds = TOKEN_LIST.value_type
    flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip((seq, pos, tags, bools, longs, doubles, names, raw), kinds, strict=True)], fields=list(kinds))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array(empty, pa.bool_()))


def pdf_token_array(data: Column) -> Column:
    """All tokens of a byte sequence as an array; a token ``error`` ends it where bytes are no token."""
    return F.arrow_udf(_tokens, f"array<{TOKEN}>")(data)


GROUP = "struct<group_no:int,operator:string,operands:array<string>>"
GROUP_LIST = pa.list_(pa.struct([("group_no", pa.int32()), ("operator", pa.string()), ("operands", pa.list_(pa.string()))]))


def _text(tag: str, value: object) -> str | None:
    if isinstance(value, bool):
        return str(value).lower()
    return value.decode("latin-1") if isinstance(value, bytes) else None if value is None else str(value)


def operator_groups_of(data: bytes) -> Iterator[tuple[int, str | None, list[str | None]]]:
    """Groups of a content stream, in order: number, operator, operands as text."""
    count, held = 0, []
    try:
        for t in tokens(data) if data else ():
            if t.tag == "operator":
                yield count, str(t.value), held
                count, held = count + 1, []
            else:
                held.append(_text(t.tag, t.value))
    except PDFError as e:
        held.append(type(e).__name__)
    if held:
        yield count, None, held


def _operators(data: pa.Array) -> pa.Array:
    return pa.array([None if d is None else list(operator_groups_of(d)) for d in data.to_pylist()], GROUP_LIST)


def pdf_operator_array(data: Column) -> Column:
    """Operators of a content stream with their operands as text; what no operator follows is
    a last group without one, ended by the class of the error where bytes are no token."""
    return F.arrow_udf(_operators, f"array<{GROUP}>")(data)


def _nodes(data: pa.Array) -> pa.Array:
    out = []
    for d in data.to_pylist():
        try:
            out.append(None if d is None else [dict(zip(NODE_FIELDS, n, strict=True)) for n in nodes_of(Reader(d).read())])
        except (PDFError, StopIteration):
            out.append(None)
    return pa.array(out, NODE_LIST)


def pdf_node_array(data: Column) -> Column:
    """The nodes of the first object of a byte sequence, in pre-order; null if it is broken."""
    return F.arrow_udf(_nodes, f"array<{NODE}>")(data)


# ------------------------------------------------------------ table functions

class PdfTokens:
    def eval(self, data: bytes):
        for k, t in enumerate(tokens(data) if data else ()):
            yield tuple(token_row(k, t.tag, t.value, t.pos)[c] for c in ("seq", "pos", "tag", "bool_val", "long_val", "double_val", "name_val", "bytes_val"))


class PdfSequence:
    def eval(self, data: bytes, content_mode: bool):
        for k, v in enumerate(Reader(data, 0, content_mode) if data else ()):
            yield k, tag_of(v), json.dumps(to_plain(v))


def register(spark: SparkSession) -> None:
    """SQL names: pdf_tokens(bytes) and pdf_parse_sequence(bytes, content_mode) as table
    functions (they raise on broken input), pdf_token_array, pdf_node_array, pdf_rc4."""
    spark.udtf.register("pdf_tokens", F.udtf(PdfTokens, returnType="seq int, pos bigint, tag string, bool_val boolean, long_val bigint, double_val double, name_val string, bytes_val binary"))
    spark.udtf.register("pdf_parse_sequence", F.udtf(PdfSequence, returnType="seq int, tag string, value string"))
    spark.udf.register("pdf_token_array", F.arrow_udf(_tokens, f"array<{TOKEN}>"))
    spark.udf.register("pdf_node_array", F.arrow_udf(_nodes, f"array<{NODE}>"))
    spark.udf.register("pdf_rc4", F.arrow_udf(_rc4, "binary"))


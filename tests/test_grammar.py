"""Lexer and object grammar: values that the format fixes, and one test for each decision
on unclear input."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from foliant.errors import PDFLexicalError, PDFSyntaxError
from foliant.fixtures import pdfgen as g
from foliant.grammar.lexer import tokens
from foliant.grammar.objects import Hex, Indirect, Name, Operator, Reader, Ref, Str, Stream, nodes_of, parse_sequence, tag_of


def values(data, content_mode=False):
    return list(Reader(data, 0, content_mode))


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (b"% comment ( /% ) blah blah blah", []),
        (b"346% comment ( /% ) blah blah blah\n123", [346, 123]),
        (b"1%x\r2", [1, 2]),  # a carriage return ends a comment too
        (b"true false", [True, False]),
        (b"123 43445 +17 -98 0", [123, 43445, 17, -98, 0]),
        (b"34.5 -3.62 +123.6 4. -.002 0.0", [34.5, -3.62, 123.6, 4.0, -0.002, 0.0]),
        (b"null", [None]),
        (b"", []),
    ],
)
def test_scalars(data, want):
    got = values(data)
    assert got == want and [type(v) for v in got] == [type(v) for v in want]


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (b"(plain)", b"plain"),
        (b"(a (nested (deeply)) b)", b"a (nested (deeply)) b"),
        (b"()", b""),
        (b"(a\\nb\\a)", b"a\nba"),
        (b"(\\245\\307)", b"\xa5\xc7"),
        (b"(\\0053 \\053 \\53)", b"\x053 + +"),
        (b"(\\777)", b"\xff"),  # modulo 256
        (b"(\\8)", b"8"),
        (b"(a\\\nb\\\r\nc)", b"abc"),  # line ends after a backslash vanish
        (b"(a\r\nb\rc)", b"a\nb\nc"),
        (b"(\\(\\)\\\\)", b"()\\"),
    ],
)
def test_literal_strings(data, want):
    assert values(data) == [Str(want)]


def test_hex_strings():
    assert values(b"<4E6F 76\n20 7>") == [Hex(b"4E6F76207")]
    assert values(b"<4E6>")[0].decoded == b"N\x60"
    with pytest.raises(PDFLexicalError):
        values(b"<12")


@pytest.mark.parametrize(("data", "want"), [(b"/Name1", "Name1"), (b"/A;Name_With-Various***Characters?", "A;Name_With-Various***Characters?"), (b"/1.2", "1.2"), (b"/$$", "$$"), (b"/.notdef", ".notdef"), (b"/lime#20Green", "lime Green"), (b"/paired#28#29parentheses", "paired()parentheses"), (b"/A#42", "AB"), (b"/ 1", "")])
def test_names(data, want):
    assert values(data)[0] == Name(want)


@pytest.mark.parametrize("data", [b"/A#4", b"/A#zz", b"+", b".", b"-.", b">", b"\xff", b"(open"])
def test_lexical_errors(data):
    with pytest.raises(PDFLexicalError) as e:
        values(data)
    assert e.value.pos is not None


@pytest.mark.parametrize("data", [b"[1 2", b"<< /A 1", b"<< 1 2 >>", b"]", b">>", b"1 0 obj 5", b"endobj", b"truex", b"BT"])
def test_syntax_errors(data):
    with pytest.raises(PDFSyntaxError):
        values(data)


def test_sequence_ending_in_integers_keeps_them():
    assert values(b"1 2") == [1, 2] and values(b"1 2 3") == [1, 2, 3]


def test_containers():
    d = values(b"<< /Type /Example /N 0.01 /S (x) /D << /Item1 0.4 /Last (end) >> /K 1 /K 2 /Z null >>")[0]
    assert d == {"Type": Name("Example"), "N": 0.01, "S": Str(b"x"), "D": {"Item1": 0.4, "Last": Str(b"end")}, "K": 2, "Z": None}
    assert values(b"[549 3.14 false (Ralph) /SomeName [1 0 R]]") == [[549, 3.14, False, Str(b"Ralph"), Name("SomeName"), [Ref(1, 0)]]]


def test_indirect_object_and_reference():
    assert values(b"12 0 obj ( Brillig ) endobj 12 0 R") == [Indirect(12, 0, Str(b" Brillig ")), Ref(12, 0)]


def test_stream():
    body = b"28 0 obj << /Length 34 >> stream\r\n" + b"x" * 34 + b"\nendstream endobj"
    (o,) = values(body)
    assert isinstance(o.value, Stream) and o.value.raw == b"x" * 34
    with pytest.raises(PDFSyntaxError):
        values(body.replace(b"34", b"33", 1))
    with pytest.raises(PDFLexicalError):
        values(body.replace(b"stream\r\n", b"stream\rx", 1))


def test_content_mode():
    data = b"BT /F1 12 Tf 72 712 Td (A stream) Tj ET"
    want = [Operator("BT"), Name("F1"), 12, Operator("Tf"), 72, 712, Operator("Td"), Str(b"A stream"), Operator("Tj"), Operator("ET")]
    assert list(parse_sequence(data)) == want
    with pytest.raises(PDFSyntaxError):
        list(parse_sequence(data, content_mode=False))


def test_values_of_different_kinds_differ():
    assert Name("a") != "a" and Name("a") == Name("a")
    assert [tag_of(v) for v in (Str(b"a"), Hex(b"61"), Name("a"), True, 1)] == ["string", "hex", "name", "bool", "integer"]


def test_inline_image_is_one_token():
    t = list(tokens(b"q BI /W 2 ID \x00(<EI\xff\n EI Q"))
    assert [x.tag for x in t] == ["operator", "operator", "name", "integer", "operator", "inline_image", "operator", "operator"]
    assert t[5].value == b"\x00(<EI\xff\n"


def test_keywords_and_lone_tilde():
    assert [(t.tag, t.value) for t in tokens(b"  ~ obj endobj xref")] == [("operator", "~"), ("keyword", "obj"), ("keyword", "endobj"), ("keyword", "xref")]


def test_nodes_are_in_pre_order():
    rows = list(nodes_of({"A": [1, {"B": Ref(3, 0)}], "C": None}))
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in rows] == [(0, None, None, None, "dict"), (1, 0, "A", None, "array"), (2, 1, None, 0, "integer"), (3, 1, None, 1, "dict"), (4, 3, "B", None, "ref"), (5, 0, "C", None, "null")]


@given(st.binary(max_size=200))
def test_written_strings_read_back(data):
    assert values(g.literal(data)) == [Str(data)]
    assert values(g.hexadecimal(data))[0].decoded == data


@given(st.text(max_size=40).filter(lambda s: s.encode("utf-8", "ignore").decode() == s))
def test_written_names_read_back(text):
    assert values(g.name(text)) == [Name(text)]


@given(st.binary(max_size=300))
def test_any_bytes_end_in_tokens_or_an_error(data):
    try:
        list(tokens(data))
    except PDFLexicalError:
        pass

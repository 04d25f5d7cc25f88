"""Filters, predictors and ciphers against vectors of the format's standards and against
encoders that share nothing with them."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from foliant.errors import PDFGenericError, PDFUnsupportedError, PDFWrongPasswordError
from foliant.fixtures import pdfgen as g
from foliant.functions import ciphers as c
from foliant.functions import filters as f


def test_known_vectors():
    assert f.ascii_85(b"6Z6LH+Co%nDe*F#+@/pn8P(m!~>", {}) == b"Code decodes ASCII85"
    assert f.run_length(b"\x0bHello world.\x82c", {}) == b"Hello world." + b"c" * 127
    assert f.ascii_hex(b"383763555244 5D>", {}) == b"87cURD]"
    assert f.ascii_hex(b"414>", {}) == b"A@"
    with pytest.raises(PDFGenericError):
        f.ascii_hex(b"41>42", {})


def test_zero_groups_and_blanks_of_base_85():
    assert f.ascii_85(base64.a85encode(b"\0\0\0\0\0\0ab") + b"~>", {}) == b"\0\0\0\0\0\0ab"
    assert f.ascii_85(b"6Z6L\nH+Co%~>", {}) == f.ascii_85(b"6Z6LH+Co%~>", {})


@given(st.binary(max_size=500))
def test_filters_undo_their_encoders(data):
    for name, encode in g.ENCODE.items():
        assert f.decode(encode(data), [name], []) == data


@given(st.binary(min_size=1, max_size=600), st.integers(0, 4), st.sampled_from([1, 3, 4]))
def test_png_rows(data, kind, step):
    columns = 7
    data += bytes(-len(data) % (columns * step))
    coded = zlib.compress(g.png_rows(data, columns * step, step, kind))
    assert f.decode(coded, ["FlateDecode"], [{"Predictor": 12, "Columns": columns, "Colors": step}]) == data


def test_png_rows_of_mixed_types():
    data = np.random.default_rng(0).integers(0, 256, 600, np.uint8).tobytes()
    rows = b"".join(g.png_rows(data[: 60 * (k + 1)], 60, 3, k % 5)[-61:] for k in range(10))
    assert f.png_predictor(rows, 3, 20) == data


def test_tiff_rows():
    data = bytes(range(24)) * 2
    assert f.undo_predictor(g.tiff_rows(data, 12, 4), {"Predictor": 2, "Columns": 3, "Colors": 4}) == data
    wide = np.arange(40, dtype=">u2").reshape(2, 10, 2)
    coded = np.concatenate((wide[:, :1], np.diff(wide, axis=1)), axis=1).astype(">u2").tobytes()
    assert f.tiff_predictor(coded, 4, 10, 16) == wide.tobytes()


def test_predictors_not_supported_or_not_known():
    with pytest.raises(PDFUnsupportedError):
        f.undo_predictor(b"xx", {"Predictor": 12, "BitsPerComponent": 4})
    with pytest.raises(PDFUnsupportedError):
        f.png_predictor(b"\x05ab", 1, 2)
    assert f.undo_predictor(b"xx", {"Predictor": 7}) == b"xx"


def test_filter_chain_order_and_registry():
    data = g.ENCODE["ASCII85Decode"](zlib.compress(b"chain"))
    assert f.decode(data, ["ASCII85Decode", "FlateDecode"], []) == b"chain"
    assert f.decode(b"x", ["DCTDecode", "CCITTFaxDecode", "Crypt"], []) == b"x"
    for name in ("LZWDecode", "Nonesuch"):
        with pytest.raises(PDFUnsupportedError):
            f.decode(b"x", [name], [])
    f.register_filter("Upper", lambda d, p: d.upper())
    assert f.decode(b"x", ["Upper"], []) == b"X"
    del f.FILTERS["Upper"]


def test_rc4_vector_and_other_implementation():
    assert c.rc4(b"123456", b"Hello world!").hex() == "489d120b4b1362f30d5b4697"
    assert c.rc4(b"\1\2\3\4\5", bytes(16)).hex() == "b2396305f03dc027ccc3524a0a1118a8"  # RFC 6229
    assert c.rc4(b"k", g.arcfour(b"k", b"abc")) == b"abc"


def test_aes_vectors():
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for size, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (24, "dda97ca4864cdfe06eaf70a0ec0d7191"), (32, "8ea2b7ca516745bfeafc49904b496089")):  # FIPS 197, appendix C
        key = bytes(range(size))
        got = c.encrypt_blocks(np.frombuffer(plain, np.uint8)[None], key)
        assert got.tobytes().hex() == want
        assert c.decrypt_blocks(got, key).tobytes() == plain


@given(st.binary(max_size=100), st.sampled_from([16, 24, 32]))
def test_cbc_round_trip(data, size):
    key, iv = bytes(range(size)), bytes(range(16))
    assert c.cbc_decrypt(key, iv, c.cbc_encrypt(key, iv, data)) == data


def test_cbc_bad_input():
    with pytest.raises(PDFGenericError):
        c.cbc_decrypt(bytes(16), bytes(16), b"short")
    with pytest.raises(PDFGenericError):
        c.cbc_encrypt(bytes(16), bytes(16), b"short", padding=False)
    with pytest.raises(PDFGenericError):
        c.expand_key(bytes(10))
    assert c.cbc_decrypt(bytes(16), bytes(16), b"") == b""


def test_saslprep():
    for text, want in (("I­X", "IX"), ("user", "user"), ("USER", "USER"), ("ª", "a"), ("Ⅸ", "IX"), ("a b", "a b")):
        assert c.saslprep(text) == want
    with pytest.raises(PDFGenericError):
        c.saslprep("\u0007")


@pytest.mark.parametrize(("v", "r", "size"), [(1, 2, 5), (2, 3, 16), (2, 3, 5)])
def test_legacy_passwords(v, r, size):
    o, u, key = g.legacy_keys(b"user", b"owner", b"id", r, size)
    e = {"V": v, "R": r, "Length": size * 8, "P": -4, "O": c.Hex(o.hex().encode()), "U": c.Hex(u.hex().encode())}
    for password, owner in ((b"user", False), (b"owner", True)):
        s = c.open_security(e, b"id", password)
        assert (s.key, s.owner) == (key, owner)
    assert c.open_security(e | {"P": (1 << 32) - 4}, b"id", b"user").key == key
    with pytest.raises(PDFWrongPasswordError):
        c.open_security(e, b"id", b"wrong")


def test_security_errors():
    for e, error in (({"V": 6}, PDFGenericError), ({}, PDFGenericError), ({"V": 3, "R": 3}, PDFUnsupportedError), ({"V": 2, "R": 3, "Length": 41}, PDFGenericError)):
        with pytest.raises(error):
            c.open_security(e, b"", b"")
    e = {"V": 5, "R": 5, "CF": {"S": {"CFM": c.Name("AESV3")}}, "StmF": c.Name("S"), "StrF": c.Name("S")}
    with pytest.raises(PDFGenericError):
        c.open_security(e, b"", b"bytes")
    with pytest.raises(PDFWrongPasswordError):
        c.open_security(e | {"O": bytes(48), "U": bytes(48)}, b"", "text")
    with pytest.raises(PDFUnsupportedError):
        c.open_security({"V": 4, "R": 4, "CF": {"S": {}}, "StmF": c.Name("S"), "StrF": c.Name("S")}, b"", b"")


def test_object_key():
    key = hashlib.md5(b"k").digest()
    s = c.Security(4, key, False, "AESV2", "AESV2")
    assert s.object_key(12, 0, "AESV2") == g.object_key(key, 12, True)
    assert len(c.Security(1, key[:5], False).object_key(1, 0, "V2")) == 10

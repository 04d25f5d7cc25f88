"""RC4, AES-CBC, password preparation and the keys of the standard security handler."""

from __future__ import annotations

import hashlib
import stringprep
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from ..errors import PDFGenericError, PDFSyntaxError, PDFUnsupportedError, PDFWrongPasswordError
from ..grammar.objects import Hex, Name, Stream

# Fixed value of ISO 32000-1, 7.6.3.3: what short passwords are filled up with.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    if not key:
        raise PDFGenericError("an RC4 key is empty")
    state, j, n = list(range(256)), 0, len(key)
    for i in range(256):
        j = (j + state[i] + key[i % n]) & 255
        state[i], state[j] = state[j], state[i]
    stream, i, j = bytearray(len(data)), 0, 0
    for k in range(len(data)):
        i = (i + 1) & 255
        a = state[i]
        j = (j + a) & 255
        b = state[i] = state[j]
        state[j] = a
        stream[k] = state[(a + b) & 255]
    return (np.frombuffer(bytes(stream), np.uint8) ^ np.frombuffer(data, np.uint8)).tobytes()


# ------------------------------------------------------------------------ AES

def _times(a: np.ndarray, by: int) -> np.ndarray:
    """Product in the field of 256 elements modulo x^8 + x^4 + x^3 + x + 1."""
    out, a = np.zeros_like(a), a.astype(np.uint16)
    while by:
        if by & 1:
            out = out ^ a.astype(np.uint8)
        a = (a << 1) ^ np.where(a & 128, 0x11B, 0)
        by >>= 1
    return out


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Substitution, its inverse, and products with the constants of mixing, all from their rules."""
    everything = np.arange(256, dtype=np.uint8)
    inverse = np.zeros(256, np.uint8)
    for a in range(1, 256):
        inverse[a] = np.flatnonzero(_times(everything, a) == 1)[0]
    turn = lambda v, n: (v << n) | (v >> (8 - n))
    box = inverse ^ turn(inverse, 1) ^ turn(inverse, 2) ^ turn(inverse, 3) ^ turn(inverse, 4) ^ np.uint8(0x63)
    back = np.zeros(256, np.uint8)
    back[box] = everything
    return box, back, {k: _times(everything, k) for k in (2, 3, 9, 11, 13, 14)}


@lru_cache(1)
def _box_bytes() -> tuple[bytes, bytes]:
    """Substitution, and bytes times 2 modulo the field's polynomial."""
    return _tables()[0].tobytes(), _tables()[2][2].tobytes()


def expand_key(key: bytes) -> np.ndarray:
    """Round keys, (rounds + 1, 16)."""
    if len(key) not in (16, 24, 32):
        raise PDFGenericError(f"an AES key has {len(key)} bytes")
    box, twice = _box_bytes()
    n = len(key) // 4
    words = [int.from_bytes(key[4 * i : 4 * i + 4], "big") for i in range(n)]
    factor = 1
    for i in range(n, 4 * (n + 7)):
        t = words[-1]
        if i % n == 0:
            t = box[t >> 16 & 255] << 24 ^ box[t >> 8 & 255] << 16 ^ box[t & 255] << 8 ^ box[t >> 24] ^ factor << 24
            factor = twice[factor]
        elif n > 6 and i % n == 4:
            t = box[t >> 24] << 24 ^ box[t >> 16 & 255] << 16 ^ box[t >> 8 & 255] << 8 ^ box[t & 255]
        words.append(words[i - n] ^ t)
    return np.array(words, ">u4").view(np.uint8).reshape(-1, 16)


def _mix(s: np.ndarray, c: tuple[int, int, int, int]) -> np.ndarray:
    m = _tables()[2] | {1: np.arange(256, dtype=np.uint8)}
    s = s.reshape(-1, 4, 4)
    return np.stack([m[c[0]][s[:, :, r]] ^ m[c[1]][s[:, :, (r + 1) % 4]] ^ m[c[2]][s[:, :, (r + 2) % 4]] ^ m[c[3]][s[:, :, (r + 3) % 4]] for r in range(4)], axis=2).reshape(-1, 16)


_SHIFT = np.array([(4 * ((k // 4 + k % 4) % 4)) + k % 4 for k in range(16)])


def encrypt_blocks(blocks: np.ndarray, key: bytes) -> np.ndarray:
    box, keys = _tables()[0], expand_key(key)
    s = blocks ^ keys[0]
    for k in keys[1:-1]:
        s = _mix(box[s][:, _SHIFT], (2, 3, 1, 1)) ^ k
    return box[s][:, _SHIFT] ^ keys[-1]


@lru_cache(1)
def _back_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For decryption: one table for the four rows of a column, which substitutes a byte back and
    mixes it into its column; where the bytes of a block come from, row by row, and their row's place in it."""
    _, back, times = _tables()
    factors = (14, 11, 13, 9)
    table = np.concatenate([np.stack([times[factors[(r - k) % 4]][back] for k in range(4)], axis=1).copy().view(np.uint32)[:, 0] for r in range(4)])
    source = np.array([[4 * ((c - r) % 4) + r for c in range(4)] for r in range(4)]).reshape(-1)
    return table, source, np.repeat(np.arange(4, dtype=np.intp) * 256, 4)


def decrypt_blocks(blocks: np.ndarray, key: bytes) -> np.ndarray:
    """All blocks at once; the keys of the inner rounds are mixed back beforehand, so that a round
    is one look into the tables."""
    keys = expand_key(key)
    table, source, place = _back_tables()
    inner = (_tables()[0][keys[1:-1]].reshape(-1, 4, 4) + place.reshape(4, 4)[:, 0]).reshape(-1, 4)
    mixed = np.bitwise_xor.reduce(table[inner], axis=1).reshape(-1, 4)
    s = blocks ^ keys[-1]
    for k in mixed[::-1]:
        t = table.take(s.take(source, axis=1) + place)
        s = (t[:, 0:4] ^ t[:, 4:8] ^ t[:, 8:12] ^ t[:, 12:16] ^ k).view(np.uint8)
    return _tables()[1][s[:, np.argsort(_SHIFT)]] ^ keys[0]


def cbc_decrypt(key: bytes, iv: bytes, data: bytes, padding: bool = True) -> bytes:
    if len(data) % 16 or len(iv) != 16:
        raise PDFGenericError("AES data is no multiple of 16 bytes")
    if not data:
        return b""
    blocks = np.frombuffer(iv + data, np.uint8).reshape(-1, 16)
    out = (decrypt_blocks(blocks[1:], key) ^ blocks[:-1]).tobytes()
    return out[: -out[-1]] if padding and 1 <= out[-1] <= 16 else out


def cbc_encrypt(key: bytes, iv: bytes, data: bytes, padding: bool = True) -> bytes:
    if padding:
        n = 16 - len(data) % 16
        data += bytes((n,)) * n
    if len(data) % 16:
        raise PDFGenericError("AES data is no multiple of 16 bytes")
    last, out = np.frombuffer(iv, np.uint8), []
    for block in np.frombuffer(data, np.uint8).reshape(-1, 16):
        last = encrypt_blocks((block ^ last)[None], key)[0]
        out.append(last.tobytes())
    return b"".join(out)


# ------------------------------------------------------------------ passwords

def saslprep(text: str) -> str:
    """RFC 4013 without the check of text direction."""
    kept = []
    for c in text:
        if stringprep.in_table_c12(c):
            kept.append(" ")
        elif not stringprep.in_table_b1(c):
            kept.append(c)
    out = unicodedata.normalize("NFKC", "".join(kept))
    forbidden = (stringprep.in_table_c12, stringprep.in_table_c21_c22, stringprep.in_table_c3, stringprep.in_table_c4, stringprep.in_table_c5, stringprep.in_table_c6, stringprep.in_table_c7, stringprep.in_table_c8, stringprep.in_table_c9)
    for c in out:
        if any(t(c) for t in forbidden):
            raise PDFGenericError(f"character U+{ord(c):04X} may not be in a password")
    return out


def _bytes(v: object) -> bytes:
    return v.decoded if isinstance(v, Hex) else bytes(v) if isinstance(v, bytes) else b""


@dataclass
class Security:
    """The standard security handler of one file, opened with a password."""

    version: int
    key: bytes
    owner: bool
    string_method: str = "V2"
    stream_method: str = "V2"
    filters: dict = field(default_factory=dict)
    encrypt_metadata: bool = True

    def object_key(self, num: int, gen: int, method: str) -> bytes:
        if method in ("AESV3", "Identity"):
            return self.key
        salt = b"sAlT" if method == "AESV2" else b""
        return hashlib.md5(self.key + num.to_bytes(4, "little")[:3] + gen.to_bytes(4, "little")[:2] + salt).digest()[: min(len(self.key) + 5, 16)]

    def string(self, value: bytes, num: int, gen: int) -> bytes:
        return decrypt(self.string_method, self.object_key(num, gen, self.string_method), value)

    def method_of(self, stream: Stream) -> str:
        """The method for a stream: Identity for cross-reference streams and open metadata, its Crypt filter's if it names one."""
        kind = stream.entries.get("Type")
        if kind == "XRef" or (kind == "Metadata" and not self.encrypt_metadata):
            return "Identity"
        filters, parms = stream.entries.get("Filter"), stream.entries.get("DecodeParms")
        names = filters if isinstance(filters, list) else [filters]
        if "Crypt" in [str(n) for n in names if isinstance(n, Name)]:
            parms = parms if isinstance(parms, list) else [parms]
            chosen = parms[[str(n) for n in names].index("Crypt")] if parms else None
            name = str((chosen or {}).get("Name", "Identity"))
            return _method(self.filters, name)
        return self.stream_method


def decrypt(method: str, key: bytes, data: bytes) -> bytes:
    if method == "Identity":
        return data
    if method == "V2":
        return rc4(key, data)
    if len(data) < 16:
        return b""
    return cbc_decrypt(key, data[:16], data[16:])


def _method(filters: dict, name: str) -> str:
    if name == "Identity":
        return "Identity"
    entry = filters.get(name)
    if not isinstance(entry, dict):
        raise PDFSyntaxError(f"crypt filter {name} is not defined")
    method = str(entry.get("CFM", "None"))
    if method == "None":
        raise PDFUnsupportedError("a crypt filter without a method")
    if method not in ("V2", "AESV2", "AESV3"):
        raise PDFSyntaxError(f"crypt filter method {method}")
    return method


def _file_key(password: bytes, e: dict, file_id: bytes, revision: int, size: int) -> bytes:
    p = (int(e.get("P", 0)) & 0xFFFFFFFF).to_bytes(4, "little")
    seed = (password + PAD)[:32] + _bytes(e.get("O"))[:32] + p + file_id
    if revision >= 4 and e.get("EncryptMetadata") is False:
        seed += b"\xff\xff\xff\xff"
    key = hashlib.md5(seed).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key[:size]).digest()
    return key[:size]


def _turns(key: bytes, data: bytes, order: range) -> bytes:
    for k in order:
        data = rc4(bytes(b ^ k for b in key), data)
    return data


def _is_user(key: bytes, e: dict, file_id: bytes, revision: int) -> bool:
    u = _bytes(e.get("U"))
    if revision == 2:
        return rc4(key, PAD) == u[:32]
    return _turns(key, hashlib.md5(PAD + file_id).digest(), range(20)) == u[:16]


def _from_owner(password: bytes, e: dict, revision: int, size: int) -> bytes:
    key = hashlib.md5((password + PAD)[:32]).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key).digest()
    return _turns(key[:size], _bytes(e.get("O"))[:32], range(19, -1, -1) if revision >= 3 else range(1))


def open_security(e: dict, file_id: bytes, password: str | bytes | None) -> Security:
    """Derive the file key; the user's password is tried first, then the owner's."""
    version, revision = e.get("V"), e.get("R", 2)
    if not isinstance(version, int) or not 0 <= version <= 5:
        raise PDFGenericError("V of the encryption dictionary is not 0 to 5")
    filters = e.get("CF") if isinstance(e.get("CF"), dict) else {}
    string_method = stream_method = "V2"
    if version >= 4:
        if version == 5 or "CF" in e:
            string_method, stream_method = (_method(filters, str(e.get(k, "Identity"))) for k in ("StrF", "StmF"))
        else:
            raise PDFSyntaxError("no crypt filters")
    known = {"string_method": string_method, "stream_method": stream_method, "filters": filters, "encrypt_metadata": e.get("EncryptMetadata") is not False}
    if version == 5:
        if isinstance(password, (bytes, bytearray)):
            raise PDFGenericError("the password of an AES-256 file is text")
        raw = saslprep(password or "").encode()[:127]
        o, u = _bytes(e.get("O"))[:48], _bytes(e.get("U"))[:48]
        digest = lambda salt, more=b"": hashlib.sha256(raw + salt + more).digest()
        if digest(o[32:40], u) == o[:32]:
            return Security(5, cbc_decrypt(digest(o[40:48], u), bytes(16), _bytes(e.get("OE"))[:32], False), True, **known)
        if digest(u[32:40]) == u[:32]:
            return Security(5, cbc_decrypt(digest(u[40:48]), bytes(16), _bytes(e.get("UE"))[:32], False), False, **known)
        raise PDFWrongPasswordError("neither the user's nor the owner's password")
    if version == 3:
        raise PDFUnsupportedError("encryption of version 3")
    bits = e.get("Length", 40)
    if version == 4 and "Length" not in e:  # writers put it into the crypt filter, in bytes or bits
        inner = [f.get("Length") for f in filters.values() if isinstance(f, dict) and isinstance(f.get("Length"), int)]
        bits = (inner[0] * 8 if inner[0] <= 32 else inner[0]) if inner else 128
    if version in (0, 1):
        bits = 40
    if not isinstance(bits, int) or bits % 8 or not 40 <= bits <= 128:
        raise PDFGenericError(f"a key of {bits} bits")
    size = bits // 8
    raw = password.encode("latin-1", "replace") if isinstance(password, str) else bytes(password or b"")
    key = _file_key(raw, e, file_id, revision, size)
    if _is_user(key, e, file_id, revision):
        return Security(version, key, False, **known)
    key = _file_key(_from_owner(raw, e, revision, size), e, file_id, revision, size)
    if _is_user(key, e, file_id, revision):
        return Security(version, key, True, **known)
    raise PDFWrongPasswordError("neither the user's nor the owner's password")


#: Opened handlers by all that they depend on: files of one producer may share their dictionary.
_KNOWN: dict[tuple, Security] = {}
MOST_KNOWN = 256


def _frozen(v: object) -> tuple:
    if isinstance(v, dict):
        return "dict", tuple((k, _frozen(x)) for k, x in v.items())
    return ("list", tuple(map(_frozen, v))) if isinstance(v, list) else (type(v).__name__, v)


def security_of(e: dict, file_id: bytes, password: str | bytes | None) -> Security:
    """The same as ``open_security``, derived once for equal dictionaries, identifiers and passwords."""
    password = bytes(password) if isinstance(password, bytearray) else password
    key = _frozen(e), file_id, _frozen(password)
    found = _KNOWN.get(key)
    if found is None:
        found = open_security(e, file_id, password)
        if len(_KNOWN) >= MOST_KNOWN:
            _KNOWN.clear()
        _KNOWN[key] = found
    return found

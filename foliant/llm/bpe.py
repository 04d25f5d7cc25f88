"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word the BPE result has one last token. It is the vocabulary
token ending there whose predecessor, the last token of the prefix before it, is
compatible: no merge of lower rank crosses their boundary. An automaton over the
vocabulary gives all tokens that are suffixes of each prefix, the pair test walks the
two merge trees back, and back-pointers give the ids. The work for a word is linear in
its length times the tokens ending at a position, however long the word is. The
automaton is that of Aho and Corasick, whose states are the prefixes of tokens and
whose links lead to suffixes: it recognises whole tokens, which is what is asked for
here, in fewer states than one of all substrings of tokens.

The vocabulary is a public tokenizer file (its path is a parameter) of the kind:
NFC, white space collapsed, lower case; words split by a pattern, bytes mapped to
characters, ``</w>`` on the last one. A file of another kind is an error, and so is a
word with a byte for which the vocabulary has no token. Special tokens in a text are
matched before normalisation, as the tokenizers library does. Nothing is trained.

Defined cases: null text counts as empty and gives no ids; an empty id list decodes
to the empty text; a text of one very long word takes linear time; repeated rows
are encoded each on its own. Other columns pass unchanged.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bound_batches, lean

SUFFIX = "</w>"


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte: itself where it prints, else 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: What a file of this kind says; other values would give other ids.
STAGES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "post_processor": None,
    "decoder": None,
}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": SUFFIX, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def expect_kind(spec: dict) -> None:
    """An error where a tokenizer file is of another kind than this module reads."""
    differ = [k for k, v in STAGES.items() if spec.get(k) != v]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    if len(steps) != 2 or (steps[0].get("type"), steps[0].get("behavior"), steps[0].get("invert")) != ("Split", "Removed", True) or "Regex" not in steps[0].get("pattern", {}) or any(steps[1].get(k) != v for k, v in BYTES.items()):
        differ.append("pre_tokenizer")
    differ += [f"model.{k}" for k, v in MODEL.items() if spec["model"].get(k, v) != v]
    if any(a.get(k, v) != v or not a["content"].startswith("<") for a in spec["added_tokens"] for k, v in ADDED.items()):
        differ.append("added_tokens")
    if differ:
        raise ValueError(f"the tokenizer file is of another kind: {', '.join(differ)}")


class Words:
    """What a tokenizer file of this kind does before BPE: special tokens, normalisation, word pattern."""

    def __init__(self, spec: dict):
        expect_kind(spec)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.source = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(self.source.replace("\\s", "\\t-\\r "))
        # beyond ASCII the library's own tables count: those of Python are of another Unicode version
        from tokenizers import Regex, normalizers, pre_tokenizers

        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex("\\s+"), " "), normalizers.Lowercase()])
        self.split = pre_tokenizers.Split(Regex(self.source), "removed", invert=True)

    def parts(self, piece: str) -> list[str]:
        """The piece cut at special tokens, which stay as parts of their own."""
        return self.split_special.split(piece) if self.split_special and "<" in piece else [piece]

    def words(self, part: str) -> list[str]:
        if part.isascii():
            return self.pattern.findall(part.lower())
        return [w for w, _ in self.split.pre_tokenize_str(self.normal.normalize_str(part))]


class Recent(dict):
    """A map from pieces of text to what ``make`` gives for them, of bounded size:
    two generations, of which the older is dropped when the newer is full."""

    def __init__(self, make: Callable, limit: int = 300_000, longest: int = 80):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, piece: str):
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        if len(piece) <= self.longest:
            self.age()
            self[piece] = value
        return value

    def age(self) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()


#: Pieces of ASCII and composed Latin letters only: there NFC changes nothing, and lower case and letter classes are the same everywhere.
LATIN = "^[\\x00-\\x7f\u00a1-\u012f\u0131-\u017f]*$"


class Encoder:
    """Encodes arrays of texts. No token spans white space, so each distinct piece between
    ASCII white space is encoded once in a batch: Latin ones word by word, cut and lowered by
    Arrow, all others whole."""

    text: Words

    def learn_words(self, words: list[str]) -> list[bytes]:
        """Ids of words as the pattern gives them."""
        raise NotImplementedError

    def learn_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without ASCII white space, whatever they hold."""
        raise NotImplementedError

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts (null: empty), and where each text's ids start and end."""
        return _assemble(pc.ascii_split_whitespace(pc.fill_null(texts, "")), self._learn)

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces and their bounds: Latin ones by their words, others whole."""
        plain = pc.match_substring_regex(pieces, LATIN)
        for special in self.text.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(pieces, special)))
        ids, ends = self._latin(pieces.filter(plain))
        if len(ends) == len(pieces) + 1:
            return ids, ends
        more, more_ends = _joined(self.learn_pieces(pieces.filter(pc.invert(plain)).to_pylist()))
        plain = plain.to_numpy(zero_copy_only=False)
        start, many = np.empty(len(plain), np.int64), np.empty(len(plain), np.int64)
        start[plain], many[plain] = ends[:-1], np.diff(ends)
        start[~plain], many[~plain] = more_ends[:-1] + len(ids), np.diff(more_ends)
        return _gather(np.concatenate((ids, more)), start, many)

    def _latin(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct Latin pieces and their bounds: pieces of letters are words, others are cut by the pattern."""
        low = pc.utf8_lower(pieces)
        mixed = pc.invert(pc.utf8_is_alpha(low))
        words = "(" + self.text.source.replace("\\s", "\\t-\\r ") + ")"
        spaced = pc.replace_substring_regex(low.filter(mixed), words, "\\1 ")
        return _assemble(pc.ascii_split_whitespace(pc.replace_with_mask(low, mixed, spaced)), lambda d: _joined(self.learn_words(d.to_pylist())))


def _gather(ids: np.ndarray, start: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ids one after the other, and their bounds."""
    ends = np.concatenate(([0], np.cumsum(many)))
    return ids[np.repeat(start - ends[:-1], many) + np.arange(ends[-1])], ends


def _joined(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    count = np.fromiter(map(len, values), np.int64, len(values)) // 4
    return np.frombuffer(b"".join(values), "<u4"), np.concatenate(([0], np.cumsum(count)))


def _assemble(lists: pa.ListArray, learn: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of lists of strings, each distinct string learned once."""
    bounds = lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0)
    coded = lists.flatten().dictionary_encode()
    ids, edge = learn(coded.dictionary)
    which = coded.indices.to_numpy()
    ids, ends = _gather(ids, edge[:-1][which], np.diff(edge)[which])
    return ids, ends[bounds]


class PrefixBPE(Encoder):
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.text = Words(spec)
        # merge trees: the merge of rank r makes the token of rank r; single symbols have rank -1
        n = 1 + max(vocab.values())
        self.rank, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        self.merge: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = vocab[a + b]
            self.merge[vocab[a], vocab[b]] = r
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = r, vocab[a], vocab[b]
        byte_of = byte_characters()
        self.automaton = ahocorasick.Automaton()
        for token, k in vocab.items():
            if token in self.text.special:
                continue
            last = token.endswith(SUFFIX) and token != SUFFIX
            body = token[: -len(SUFFIX)] if last else token
            symbols = [byte_of[c] for c in body]
            if last:
                symbols[-1] += 256
            if self.rank[k] < 0 or self._boundary_holds(self.left[k], self.right[k], self.rank[k]):
                self.automaton.add_word("".join(map(chr, symbols)), (len(symbols), k))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.kept = Recent(self._word, 120_000)

    def _boundary_holds(self, a: int, b: int, limit: int) -> bool:
        """Whether BPE keeps a boundary between the expansions of a and b until rank ``limit``.
        The later merge on either side is undone first; at equal rank the right one, as equal merges run from left to right."""
        rank = self.rank
        while True:
            r = self.merge.get((a, b))
            if r is not None and r < limit:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            else:
                limit, b = rank[b] + 1, self.left[b]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 24 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= 300_000:
                self.pairs.clear()
            known = self.pairs[key] = self._boundary_holds(a, b, 1 << 60)
        return known

    def encode_symbols(self, symbols: str) -> list[int]:
        """Ids of one word given as a string of byte values, 256 more on the last."""
        last = [-1] * (len(symbols) + 1)
        size = [0] * (len(symbols) + 1)
        for end, (n, token) in self.automaton.iter(symbols):
            end += 1
            if last[end] < 0:
                start = end - n
                if start == 0 or (last[start] >= 0 and self.compatible(last[start], token)):
                    last[end], size[end] = token, n
        if len(symbols) and last[-1] < 0:
            raise ValueError("the vocabulary has no token for a byte of the text")
        ids, at = [], len(symbols)
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        raw = word.encode()
        return np.array(self.encode_symbols(raw[:-1].decode("latin-1") + chr(256 + raw[-1])), "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        out = []
        for part in self.text.parts(piece):
            special = self.text.special.get(part)
            out += [np.array([special], "<u4").tobytes()] if special is not None else map(self.kept.__getitem__, self.text.words(part))
        return b"".join(out)

    def learn_words(self, words: list[str]) -> list[bytes]:
        return list(map(self.kept.__getitem__, words))

    def learn_pieces(self, pieces: list[str]) -> list[bytes]:
        return list(map(self._piece, pieces))

    def encode(self, text: str) -> list[int]:
        return self.encode_array(pa.array([text]))[0].tolist()

class Vocabulary:
    """Token strings only, for decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = dict(spec["model"]["vocab"]) | {a["content"]: a["id"] for a in spec["added_tokens"]}
        tokens = [""] * (1 + max(ids.values()))
        for token, k in ids.items():
            tokens[k] = token
        self.strings = pa.array(tokens, pa.large_string())

    def decode_arrays(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts of lists of ids: tokens joined by spaces."""
        tokens = self.strings.take(pa.array(ids.astype(np.int64)))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), tokens), pa.scalar(" ", pa.large_string())).cast(pa.string())

    def decode(self, ids: list[int]) -> str:
        return self.decode_arrays(np.array(ids), np.array([0, len(ids)]))[0].as_py()


_loaded: dict[tuple[type, str], object] = {}

#: Characters of text encoded at a time, whatever the size of the batch.
SLICE = 3 << 19


def load(path: str, kind: type = PrefixBPE):
    """One model of a kind for each path and worker process."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose values in a column have few bytes together, a row at least."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _replace(df: DataFrame, column: str, out: dict[str, T.DataType], make: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """Replace ``column`` by columns made of its values, slice by slice."""
    bound_batches(df.sparkSession)
    schema = T.StructType([*(f for f in df.schema.fields if f.name != column), *(T.StructField(n, t) for n, t in out.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(column)
            for part in slices(batch, k):
                yield pa.RecordBatch.from_arrays([c for i, c in enumerate(part.columns) if i != k] + make(part.column(k)), names=schema.names)

    return df.mapInArrow(lean(run), schema)


def encode_bpe(df: DataFrame, text: str, path: str, out: str = "ids", decoded: str | None = None) -> DataFrame:
    """Replace the column ``text`` by ``out``: its ids as little-endian unsigned 32-bit integers
    (binary), and, if ``decoded`` names a column, by the text that those ids decode to."""

    def make(texts: pa.Array) -> list[pa.Array]:
        ids, bounds = load(path).encode_array(texts)
        raw = ids.astype("<u4").tobytes()
        edge = (4 * bounds).tolist()
        packed = pa.array([raw[a:b] for a, b in zip(edge, edge[1:], strict=False)], pa.binary())
        return [packed, load(path, Vocabulary).decode_arrays(ids, bounds)] if decoded else [packed]

    return _replace(df, text, {out: T.BinaryType()} | ({decoded: T.StringType()} if decoded else {}), make)


def decode_bpe(df: DataFrame, ids: str, path: str, out: str = "decoded") -> DataFrame:
    """Replace the binary column ``ids`` by the text of its tokens; null counts as empty."""

    def make(column: pa.Array) -> list[pa.Array]:
        raw = [v or b"" for v in column.to_pylist()]
        bounds = np.concatenate(([0], np.cumsum([len(v) // 4 for v in raw], dtype=np.int64)))
        return [load(path, Vocabulary).decode_arrays(np.frombuffer(b"".join(raw), "<u4"), bounds)]

    return _replace(df, ids, {out: T.StringType()}, make)

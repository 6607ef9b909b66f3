"""Operator 11, byte-level BPE by dynamic programming over prefixes, and its decoding.

For every prefix of a piece there is exactly one token that its encoding ends with. An automaton over the vocabulary
names, at each byte, all tokens that are suffixes of the prefix. Of these the last token is the one that is compatible
with the last token of the prefix before it; back-pointers from the whole piece give the ids. Time grows linearly with
the piece, however long it is.

Two tokens are compatible when encoding their joined bytes gives just the two. Each token was merged from parts, so the
parts that ever stood at the inner boundary are the right edge of the one's merge tree and the left edge of the other's.
The pair is incompatible when two of these parts have a merge that comes before either part's own next merge (at equal
rank the merge further left comes first).

Texts are cut at special tokens, and into pieces by the vocabulary's published split. Texts with characters from U+0250
on are split by the tokenizers library, whose Unicode tables decide there. Ids of pieces are kept in bounded memory, as
texts repeat most of theirs.

Defined cases: a null or empty text has no ids and decodes to an empty text; very long texts and pieces are encoded
whole; repeated rows and null ids are encoded each; an empty table gives an empty result; of other columns, all are
kept, and `ids` and `decoded` replace columns of these names. Bytes that are not UTF-8 decode to replacement characters.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from quire.llm.common import quoted, text_of

#: From this letter on, versions of Unicode differ in their classes of characters.
LATIN_END = "ɐ"
#: The published split of byte-level BPE.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = 1 << 40

_BEYOND = re.compile(f"[^\0-{chr(ord(LATIN_END) - 1)}]")


def latin_split(split: str = SPLIT) -> re.Pattern:
    """The split for characters below LATIN_END, with its classes written out: faster than a search by property."""
    import regex

    letters, digits, spaces = ("".join(re.escape(chr(c)) for c in range(ord(LATIN_END)) if regex.match(kind, chr(c))) for kind in (r"\p{L}", r"\p{N}", r"\s"))
    split = split.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{digits}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{digits}]")
    return re.compile(split.replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]"))


def spelling() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself, or the next from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def token_bytes(described: dict) -> tuple[dict[int, bytes], dict[str, int]]:
    """Bytes of each id of a vocabulary file, and the ids of its special tokens."""
    spelt, special = spelling(), {t["content"]: t["id"] for t in described["added_tokens"]}
    ids = described["model"]["vocab"] | special
    return {i: bytes(map(spelt.__getitem__, t)) if t not in special or all(c in spelt for c in t) else t.encode() for t, i in ids.items()}, special


class Spelling:
    """Bytes of tokens by id."""

    def __init__(self, spelt: list[bytes]):
        self.lengths = np.array([*map(len, spelt)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(spelt), np.uint8)

    def spelt(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes one after another."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


class Decoder(Spelling):
    """The text that ids stand for."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            bytes_of, _ = token_bytes(json.load(f))
        super().__init__([bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)])

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes one after another; ids that the vocabulary lacks have none."""
        return self.spelt(ids[(ids >= 0) & (ids < len(self.lengths))])


class Vocabulary:
    """Tokens as bytes, merges by ranks, and the compatibility of pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        model, split = described["model"], described["pre_tokenizer"]
        if model["type"] != "BPE" or model.get("ignore_merges") or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or described["normalizer"]:
            raise ValueError("only plain byte-level BPE")
        added = described["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("special tokens that take in their surroundings")
        self.bytes_of, self.special = token_bytes(described)
        ids = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        made: dict[int, int] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (ids[a], ids[b]), ids[a + b]
            if whole in made or max(made.get(pair[0], -1), made.get(pair[1], -1)) >= r:
                raise ValueError("a token of two merges, or a merge before its parts'")
            self.rank[pair], self.parts[whole], made[whole] = r, pair, r
        self.made = made
        self._edges: tuple[dict, dict] = ({}, {})

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens at the left (0) or right (1) end of a token's merge tree, each with the rank of the merge that takes it."""
        found = self._edges[side].get(token)
        if found is None:
            found, until, at = [(token, NEVER)], NEVER, token
            while at in self.parts:
                until, at = self.made[at], self.parts[at][side]
                found.append((at, until))
            self._edges[side][token] = found
        return found

    def joins(self, a: int, b: int, end: int = NEVER) -> bool:
        """Whether bytes merge across the boundary of a and b before `end`, the rank of the merge that takes both."""
        rank = self.rank
        for x, x_until in self.edge(a, 1):
            for y, y_until in self.edge(b, 0):
                r = rank.get((x, y))
                if r is not None and r < min(x_until, end) and (r <= y_until if y_until < end else r < end):
                    return True
        return False

    def compatible(self, a: int, b: int) -> bool:
        return not self.joins(a, b)

    def reachable(self, token: int) -> bool:
        """Whether the token's bytes are encoded as the token; no text has it among its ids otherwise."""
        return token not in self.parts or not self.joins(*self.parts[token], self.made[token])


class Known(dict):
    """What was computed of short texts, in bounded memory: two generations, of which the older one goes when both are
    full."""

    def __init__(self, compute, most: int = 400_000):
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text)
        return self.keep(text, self.compute(text) if found is None else found)

    def keep(self, text: str, found: bytes) -> bytes:
        if len(text) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


class _Pairs(dict):
    """Whether two tokens are compatible, by both ids in one number."""

    def __init__(self, compatible):
        self.compatible = compatible

    def __missing__(self, pair: int) -> bool:
        found = self[pair] = self.compatible(pair >> 32, pair & 0xFFFFFFFF)
        return found


class Encoder:
    """Ids of texts as native 32-bit integers."""

    def __init__(self, path: str):
        import ahocorasick

        self.path, self.vocabulary = path, Vocabulary(path)
        self.suffixes = ahocorasick.Automaton()
        for i, b in self.vocabulary.bytes_of.items():
            if i not in self.vocabulary.special.values() and self.vocabulary.reachable(i):
                self.suffixes.add_word(b.decode("latin-1"), (i, len(b)))
        self.suffixes.make_automaton()
        self.split = latin_split().findall
        self.pairs = _Pairs(self.vocabulary.compatible)
        self.pieces = Known(lambda p: array("i", self.piece(p)).tobytes())
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.vocabulary.special, key=len, reverse=True))) + ")") if self.vocabulary.special else None

    def piece(self, text: str) -> list[int]:
        """The ids of a piece: of each prefix the last token, then the way back from the end."""
        raw, pairs = text.encode("utf-8").decode("latin-1"), self.pairs
        if len(pairs) > 1 << 19:
            pairs.clear()
        last: list[tuple[int, int] | None] = [None] * (len(raw) + 1)
        for end, token in self.suffixes.iter(raw):
            if last[end + 1] is None:
                before = last[end + 1 - token[1]]
                if before is None or pairs[before[0] << 32 | token[0]]:
                    last[end + 1] = token
        ids, at = [], len(raw)
        while at:
            i, size = last[at]
            ids.append(i)
            at -= size
        return ids[::-1]

    def together(self, pieces: Iterable[str]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, pieces))

    def ordinary(self, text: str) -> bytes:
        """Ids of a text in which strings of special tokens are text like any other."""
        if not text:
            return b""
        if not text.isascii() and _BEYOND.search(text):
            return self.together(text[a:b] for _, (a, b) in library(self.path).pre_tokenizer.pre_tokenize_str(text))
        return self.together(self.split(text))

    def encode(self, text: str) -> bytes:
        if self.specials and self.specials.search(text):
            special = self.vocabulary.special
            return b"".join(np.int32(special[p]).tobytes() if i % 2 else self.ordinary(p) for i, p in enumerate(self.specials.split(text)))
        return self.ordinary(text)


@lru_cache(1)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One a worker process, for all its tasks."""
    return Encoder(path)


@lru_cache(1)
def decoder_of(path: str) -> Decoder:
    return Decoder(path)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _added(df: DataFrame, source: str, of, name: str, kind: DataType) -> DataFrame:
    """df with a column that `of` computes from the Arrow array of another."""
    kept = df.select(*[F.col(quoted(c)) for c in df.columns if c.lower() not in (name, "__in")], F.expr(source).alias("__in"))
    out = [f for f in kept.schema.fields if f.name != "__in"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, len(b), 1024):  # lists of a part, not of the whole batch, are in memory at once
                part = b.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], of(part.column(len(out)))], [*[f.name for f in out], name])

    return kept.mapInArrow(batches, StructType([*out, StructField(name, kind)]))


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """docs with `ids` instead of the text."""
    path = path or vocabulary_path()
    kept = docs.select(*[F.col(quoted(c)) for c in docs.columns if c != text and c.lower() != "__text"], text_of(quoted(text)).alias("__text"))
    return _added(kept, "__text", lambda a: _lists([encoder_of(path).encode(t) for t in a.to_pylist()]), "ids", ArrayType(IntegerType())).drop("__text")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with `decoded`, the text that its `ids` stand for."""
    path = path or vocabulary_path()

    def texts(a: pa.Array) -> pa.Array:
        a = a.fill_null([])
        ids, ends = a.flatten().to_numpy(zero_copy_only=False), np.asarray(a.offsets) - a.offsets[0].as_py()
        return pa.array([decoder_of(path).decode(ids[x:y]).decode("utf-8", "replace") for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.string())

    return _added(encoded, "ids", texts, "decoded", StringType())


def digests(encoded: DataFrame) -> DataFrame:
    """Number and digest of each row's ids, and the digest of what they decode to."""
    return encoded.withColumns({"n_tokens": F.size("ids").cast("bigint"), "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256), "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256)})

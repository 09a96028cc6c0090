"""Byte-level BPE encoding and decoding.

The encoder takes, at each position, the longest vocabulary entry that an Aho-Corasick automaton
finds there, and keeps it if it is *compatible* with the token before: two tokens are compatible if
applying the merges in rank order to their joined bytes leaves exactly these two.  Otherwise it
falls back to the next shorter entry that is a prefix, and, when none is left, takes the previous
token back.  Positions found to be dead ends are remembered, so the work is linear in the text and
the result is that of applying all merges.  The decoder is one gather from the joined bytes of all
tokens by an offset table.

Text is cut into pieces first (letters, digits, other signs, white space).  Pieces repeat, so each
Python worker remembers those it has met, up to ``CACHE_PIECES``.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: How byte-level vocabularies of this family split text before merging (fixed value).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_PIECES = 150_000
DECODE_ROWS = 256


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: itself where the byte
    is a printable Latin-1 sign, else the next free code point from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Seen(dict):
    """Ids of the pieces met.  When full, it becomes the older half and starts anew, so that frequent
    pieces are never lost for long and memory stays bounded."""

    def __init__(self, codec: Codec):
        self.codec, self.older = codec, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.older = dict(self)
            self.clear()
        found = self.older.get(piece) or self.codec.piece(piece)
        if len(piece) < 64:
            self[piece] = found
        return found


class Codec:
    """Tables of one vocabulary.  Inside, a token is its *rank*: bytes first, then merges in order."""

    def __init__(self, vocabulary: str):
        import ahocorasick
        import regex

        spec = json.loads(vocabulary)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        raw = lambda name: bytes(letters[c] for c in name)
        base = sorted(letters, key=letters.get)
        names, self.left, self.right = list(base), list(range(256)), list(range(256))
        rank = {name: i for i, name in enumerate(names)}
        self.merged: dict[tuple[int, int], int] = {}
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair = rank[a], rank[b]
            rank[a + b] = len(names)
            self.merged[pair] = len(names)
            self.left.append(pair[0])
            self.right.append(pair[1])
            names.append(a + b)
        self.size = [len(n) for n in names]
        self.packed = [vocab[n].to_bytes(4, sys.byteorder) for n in names]
        # An entry that the merges never produce from its own bytes takes no part in matching.
        made = [True] * 256
        for t in range(256, len(names)):
            a, b = self.left[t], self.right[t]
            made.append(made[a] and made[b] and self.compatible(a, b, t))
        self.finder = ahocorasick.Automaton()
        usable = {n: i for i, n in enumerate(names) if made[i]}
        for name, i in usable.items():
            self.finder.add_word(raw(name).decode("latin-1"), i)
        self.finder.make_automaton()
        self.shorter = [next((usable[n[:k]] for k in range(len(n) - 1, 0, -1) if n[:k] in usable), -1) for n in names]
        self.split = regex.compile(PIECES).findall
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", ())}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.pairs: dict[int, bool] = {}
        self.seen = _Seen(self)

    def compatible(self, a: int, b: int, below: int = 1 << 60) -> bool:
        """Whether no merge with a rank under ``below`` joins bytes across the border of a and b
        before both are complete.  The later-made of the two is undone step by step: at each step the
        pieces at the border must have no merge that would have come before the one undone."""
        merged, left, right = self.merged, self.left, self.right
        while True:
            if merged.get((a, b), below) < below:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:  # a was made last: before that, its right part stood at the border
                below, a = a, right[a]
            else:  # equal ranks: merges run from the left, so b is the one made last
                below, b = b + 1, left[b]

    def fits(self, a: int, b: int) -> bool:
        """compatible(a, b) by the pair table, which is filled as pairs are met."""
        found = self.pairs.get(a << 32 | b)
        if found is None:
            if len(self.pairs) > 2 * CACHE_PIECES:
                self.pairs.clear()
            found = self.pairs[a << 32 | b] = self.compatible(a, b)
        return found

    def piece(self, text: str) -> bytes:
        """Token ids of one piece, four bytes each."""
        data = text.encode().decode("latin-1")
        n, size, fits = len(data), self.size, self.fits
        longest = [0] * n
        for end, t in self.finder.iter(data):
            longest[end + 1 - size[t]] = t  # ends only grow, so the longest one stays
        out: list[int] = []
        dead = bytearray(n + 1)
        pos, token = 0, longest[0]
        while True:
            end = pos + size[token]
            if not dead[end] and (not out or fits(out[-1], token)):
                out.append(token)
                if end == n:
                    return b"".join([self.packed[t] for t in out])
                pos, token = end, longest[end]
                continue
            token = self.shorter[token]
            while token < 0:  # nothing fits here: this border is dead, the token before must be shorter
                dead[pos] = 1
                back = out.pop()
                pos -= size[back]
                token = self.shorter[back]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if self.special_split and any(s in text for s in self.special):
            parts = [np.array([self.special[p]], np.int32) if p in self.special else self.encode_plain(p) for p in self.special_split(text) if p]
            return np.concatenate(parts)
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.seen.__getitem__, self.split(text))), np.int32)


class Decoder:
    """The offset table of one vocabulary: bytes of token i are blob[start[i]:start[i + 1]]."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        letters = byte_letters()
        raw = lambda name: bytes(letters[c] for c in name)
        special = {a["content"]: a["id"] for a in spec.get("added_tokens", ())}
        by_id = {i: raw(n) for n, i in spec["model"]["vocab"].items() if all(c in letters for c in n)} | {i: n.encode() for n, i in special.items()}
        parts = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        # One empty entry more, for ids that are none.
        self.start = np.cumsum([0, *map(len, parts), 0], dtype=np.int32)
        self.blob = np.frombuffer(b"".join(parts), np.uint8)

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids joined, and where each id's bytes begin and end in them."""
        start, none = self.start, len(self.start) - 2
        ids = np.where((ids < 0) | (ids > none), none, ids)
        sizes = start[ids + 1] - start[ids]
        borders = np.concatenate((np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)))
        where = np.repeat(start[ids] - borders[:-1], sizes)
        where += np.arange(len(where), dtype=np.int32)
        return self.blob[where], borders


@functools.lru_cache(2)
def _tables(kind: type, digest: str, carrier: _Carrier):
    return kind(carrier.text)


class _Carrier:
    """Keeps a vocabulary's text out of the cache key, so that each Python worker builds its tables once."""

    def __init__(self, text: str):
        self.text = text

    def __hash__(self) -> int:
        return 0

    def __eq__(self, other) -> bool:
        return isinstance(other, _Carrier)


def load(path: str) -> str:
    """The vocabulary file's text (a bounded few MB), read where the job is declared."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _shared(df: DataFrame, path: str | None):
    common.bound_batches(df.sparkSession)
    text = load(path or default_path())
    return df.sparkSession.sparkContext.broadcast(text), hashlib.sha256(text.encode()).hexdigest()


def encode(df: DataFrame, text_col: str = "text", out_col: str = "token_ids", path: str | None = None) -> DataFrame:
    """Adds ``out_col`` array<int>: the token ids of the whole text.

    Null and empty texts give an empty list.  A special token's string in a text becomes that token.
    Repeated rows are encoded each; an input column named like the output is replaced.
    """
    sent, digest = _shared(df, path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _tables(Codec, digest, _Carrier(sent.value))
        for texts in batches:
            lists = [codec.encode((v.as_buffer().to_pybytes() if v.is_valid else b"").decode("utf-8", "replace")) for v in texts]
            ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            flat = np.concatenate(lists) if lists else np.empty(0, np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(run, "array<int>")
    return df.withColumn(out_col, udf(F.col(text_col).cast("binary")))


def decode(df: DataFrame, ids_col: str = "token_ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds ``out_col`` string: the text of a list of ids, special tokens as their strings.

    A null list gives an empty text; ids outside the vocabulary and null ids give nothing; bytes that
    are no UTF-8 become the replacement sign.
    """
    sent, digest = _shared(df, path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = _tables(Decoder, digest, _Carrier(sent.value))
        for lists in batches:
            out = []
            for k in range(0, len(lists), DECODE_ROWS):  # bounds the index arrays
                part = lists.slice(k, DECODE_ROWS)
                data, borders = decoder.decode_flat(np.asarray(part.flatten().fill_null(-1)))
                rows = borders[np.cumsum([0, *part.value_lengths().fill_null(0).to_pylist()])]
                data = data.tobytes()
                out += [data[a:b].decode("utf-8", "replace") for a, b in itertools.pairwise(rows.tolist())]
            yield pa.array(out, pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(run, "string")
    return df.withColumn(out_col, udf(F.col(ids_col)))


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes, decodes and condenses: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded = decode(encode(docs.select("doc_id", "text"), path=path), path=path)
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        ids_digest(F.col("token_ids")).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))

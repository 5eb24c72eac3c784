"""Byte-level BPE by longest match and backtracking.

Two neighbouring tokens are compatible when the merges, run on their joined bytes, give
back exactly these two tokens.  A sequence whose neighbours are all compatible is the one
that the merges produce, and it can be found from left to right: take the longest token,
step down to shorter ones or back a token when it does not fit its neighbour, and never
try a position that has failed before.  Compatibility is memoised, so a piece takes time
in proportion to its length.

Bytes are mapped to Latin-1 characters, so the automaton works on any byte string.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts

#: Neighbour pairs and pieces (some 200 bytes each) remembered in a task; a full table is emptied.
MEMO, PIECES = 500_000, 250_000

#: Fixed value: the pattern that _FAST stands for on characters below U+0250.
_FAST_OF = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters below U+0250 by class, where every Unicode version agrees.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\\t\\n\\v\\f\\r \\x85\\xa0"
_FAST = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[^\x00-ɏ]")


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the lines of a .tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def merge_reference(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain repeated merging of the lowest-ranked pair, leftmost first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.quick = _FAST if pattern == _FAST_OF else self.pattern
        self.whole = {b.decode("latin-1"): i for b, i in ranks.items()}
        self.text_of = {i: t for t, i in self.whole.items()}
        self.size_of = {i: len(b) for b, i in ranks.items()}
        self.widest = max(map(len, ranks))
        self.fits: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.name_of = {i: str(i) for i in self.text_of}
        self.shorter: dict[int, int] = {}
        self.spines: dict[int, tuple[list, list] | None] = {}
        self.automaton = ahocorasick.Automaton()
        for text, i in self.whole.items():
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a byte or an unreachable token."""
        parts, get = list(self.text_of[token]), self.whole.get
        while len(parts) > 2:
            costs = [get(x + y, 1 << 60) for x, y in zip(parts, parts[1:], strict=False)]
            least = min(costs)
            if least == 1 << 60:
                return None
            k = costs.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return (self.whole[parts[0]], self.whole[parts[1]]) if len(parts) == 2 else None

    def _edges(self, token: int) -> tuple[list, list] | None:
        """What stands at the token's left and at its right edge while its bytes merge.

        Each is a list of (text, rank of the merge that absorbs it), smallest first; the token
        itself is absorbed never.  None if merging its bytes does not give the token.
        """
        if token not in self.spines:
            sides: list[list] | None = []
            for side in (0, 1):
                chain, t = [(self.text_of[token], 1 << 60)], token
                while len(self.bytes_of[t]) > 1:
                    halves = self._halves(t)
                    if halves is None:
                        sides = None
                        break
                    chain.append((self.text_of[halves[side]], t))
                    t = halves[side]
                if sides is None:
                    break
                sides.append(chain[::-1])
            self.spines[token] = tuple(sides) if sides else None
        return self.spines[token]

    def _compatible(self, a: int, b: int) -> bool:
        """Do the merges leave the border between ``a`` and ``b`` alone?

        Follows both edges at the border through time.  The pair across the border merges if
        its rank is lower than that of the next merge on the left, and no higher than that of
        the next merge on the right (of equal ranks, the leftmost merges first).
        """
        key = a << 32 | b
        found = self.fits.get(key)
        if found is None:
            left, right = self._edges(a), self._edges(b)
            found = left is not None and right is not None
            if found:
                left, right, i, j = left[1], right[0], 0, 0
                whole = self.whole
                while True:
                    (x, until_x), (y, until_y) = left[i], right[j]
                    across = whole.get(x + y, 1 << 60)
                    if across < until_x and across <= until_y and across < 1 << 60:
                        found = False
                        break
                    if until_x <= until_y:
                        if until_x == 1 << 60:
                            break
                        i += 1
                    else:
                        j += 1
            if len(self.fits) >= MEMO:
                self.fits.clear()
            self.fits[key] = found
        return found

    def _prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``; -1 if none."""
        found = self.shorter.get(token)
        if found is None:
            text, found = self.text_of[token], -1
            for n in range(len(text) - 1, 0, -1):
                found = self.whole.get(text[:n], -1)
                if found >= 0:
                    break
            self.shorter[token] = found
        return found

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Ids of one piece, as the merges give them."""
        text = piece.decode("latin-1")
        if text in self.whole:
            return [self.whole[text]]
        greedy = [token for _, token in self.automaton.iter_long(text)]
        known, last = self.fits, -1
        for k, token in enumerate(greedy):
            if last >= 0:
                fits = known.get(last << 32 | token)
                if fits is None:
                    fits = self._compatible(last, token)
                if not fits:
                    return self._backtrack(text, greedy[: k - 1], last)
            last = token
        return greedy

    def _longest(self, text: str, at: int) -> int:
        for _, token in self.automaton.iter_long(text[at : at + self.widest]):
            return token
        raise ValueError("a byte is missing from the vocabulary")

    def _backtrack(self, text: str, out: list[int], token: int) -> list[int]:
        """Go on from ``out``, which ``token`` follows: tokens whose neighbours are compatible."""
        n, size, known, shorter, dead = len(text), self.size_of, self.fits, self.shorter, set()
        at = sum([size[t] for t in out])
        last = out[-1] if out else -1
        while at < n:
            while token >= 0:
                end = at + size[token]
                if end not in dead:
                    fits = last < 0 or known.get(last << 32 | token)
                    if fits is None:
                        fits = self._compatible(last, token)
                    if fits:
                        break
                found = shorter.get(token)
                token = self._prefix(token) if found is None else found
            if token >= 0:
                out.append(token)
                last, at = token, end
                if at < n:
                    token = self._longest(text, at)
            else:
                if not out:
                    raise ValueError("no sequence of compatible tokens: a byte is missing from the vocabulary")
                dead.add(at)
                token = out.pop()
                last = out[-1] if out else -1
                at -= size[token]
                token = self._prefix(token)
        return out

    def split(self, text: str) -> list[str]:
        return (self.pattern if _BEYOND.search(text) else self.quick).findall(text)

    def _piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece."""
        ids = tuple(self.encode_bytes(piece.encode("utf-8", "replace")))
        if len(piece) <= 64:
            if len(self.pieces) >= PIECES:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        get, make = self.pieces.get, self._piece
        return [i for p in self.split(text) for i in (get(p) or make(p))]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, text: str) -> tuple[list[int], str, str]:
        """The ids, SHA-256 of the ids' decimal form, SHA-256 of the decoded bytes."""
        ids = self.encode(text)
        names = ",".join(map(self.name_of.__getitem__, ids))
        return ids, hashlib.sha256(names.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def _tables(spark: SparkSession, vocabulary: str):
    """The vocabulary file as a broadcast: its size (under 1 MB) is that of the file."""
    with open(vocabulary, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", column: str = "ids") -> DataFrame:
    """``docs`` with the ids of every text; a null text has no ids."""
    data = _tables(docs.sparkSession, vocabulary)

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = Encoder(load_ranks(data.value), pattern)
        for s in parts:
            yield pd.Series([e.encode(t) if isinstance(t, str) else [] for t in s])

    return docs.withColumn(column, run(F.col(text).cast("string")))


def decode_documents(docs: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of an id column (binary; they are UTF-8 if the ids came whole)."""
    data = _tables(docs.sparkSession, vocabulary)

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = Encoder(load_ranks(data.value), pattern)
        for s in parts:
            yield pd.Series([e.decode(list(x)) if x is not None else b"" for x in s])

    return docs.withColumn(column, run(ids))


def digest_documents(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256 and decoded_sha256 for every row; ``ids`` too if asked for.

    Encodes and decodes each whole text in the task that reads it, one text at a time; null
    and empty texts have no ids, repeated rows are encoded each, an empty table gives none.
    The encoder (0.1 s to build) goes with its task: the worker serves other stages next.
    """
    data = _tables(docs.sparkSession, vocabulary)
    fields = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if with_ids else {})

    def make():
        e = Encoder(load_ranks(data.value), pattern)

        def run(texts: list[str]) -> dict:
            out: dict = {name: [] for name in fields}
            for t in texts:
                ids, own, decoded = e.digest(t)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(own)
                out["decoded_sha256"].append(decoded)
                if with_ids:
                    out["ids"].append(np.array(ids, np.int32))
            return out

        return run

    return map_texts(docs.select(*keep, F.col(text).cast("string").alias("_text")), make, fields)


def _defaults() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), *_defaults())


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: doc_id, source and lang (where ``docs`` has them), the ids, their number and the digests of every document."""
    keep = tuple(c for c in ("doc_id", "source", "lang") if c in docs.columns)
    return digest_documents(docs, *_defaults(), keep=keep, with_ids=True)

"""Byte-level BPE encoding and decoding: exact merges without running the merges.

Method: the vocabulary, its bytes read as Latin-1, is one Aho-Corasick automaton.
For a pre-token the automaton gives the longest token that starts at every
position; from there the encoder walks left to right, takes the longest token
that is *compatible* with the one before it, tries shorter prefixes when it is
not, and steps back when none fits.  A sequence of tokens is the BPE encoding
exactly if every adjacent pair is, so that compatibility is a property of two
ids, decided from their merge trees and memoised.  Positions that failed are
marked and never tried twice, which keeps the walk linear.

Text is cut by the pattern of the rank file.  White space runs and the words
after them are cut first, as no match of the pattern crosses from a non-space
to the space after it; what a word encodes to is kept in a bounded cache of two
generations.  Nothing is shuffled, and each row is independent.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeframe.llm._common import id_and_text, tidy

#: Code points with the Unicode property White_Space, which ``\s`` of the rank files means.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pieces that the pattern never crosses: a word with one space before it; the
#: rest of a white space run before a word; any other white space.
CHUNKS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
#: Cached words per generation and worker; longer words than KEY_CHARS are never cached.
CACHE_WORDS, KEY_CHARS, CACHE_PAIRS = 120_000, 64, 200_000


class Codec:
    """Encoder and decoder for one rank file and its pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        top = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * top
        for tok, r in ranks.items():
            self.bytes_of[r] = tok
        self.len_of = [len(t) for t in self.bytes_of]
        self.text_of = {str(r): t for t, r in ranks.items()}
        auto = ahocorasick.Automaton()
        for tok, r in ranks.items():
            auto.add_word(tok.decode("latin-1"), r)
        auto.make_automaton()
        self.matches = auto.iter
        # the longest proper prefix that is a token, or -1
        self.prefix = [-1] * top
        for tok, r in ranks.items():
            for k in range(len(tok) - 1, 0, -1):
                p = ranks.get(tok[:k])
                if p is not None:
                    self.prefix[r] = p
                    break
        # the last merge of each token: (left, right), or (itself, itself)
        self.halves: list[tuple[int, int]] = [(r, r) for r in range(top)]
        self.joined: dict[tuple[int, int], int] = {}
        self.fits: dict[int, bool] = {}
        for r in range(top):
            tok, left = self.bytes_of[r], self.prefix[r]
            while left >= 0:
                right = ranks.get(tok[self.len_of[left] :])
                if right is not None and left < r and right < r and self._compatible(left, right):
                    self.joined[left, right] = r
                    self.halves[r] = (left, right)
                    break
                left = self.prefix[left]
        self.new: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def _compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay two tokens when their bytes are merged together."""
        joined, halves, limit = self.joined, self.halves, 1 << 62
        while True:
            both = joined.get((a, b))
            if both is not None and both < limit:
                return False
            if a > b:
                limit, a = a, halves[a][1]
                if a == limit:
                    limit, b = b + 1, halves[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, halves[b][0]
                if b + 1 == limit:
                    limit, a = a, halves[a][1]
                    if a == limit:
                        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, len_of, fits, prefix = len(piece), self.len_of, self.fits, self.prefix
        longest = [-1] * (n + 1)
        for end, tok in self.matches(piece.decode("latin-1")):  # ends ascend: the last one is the longest
            longest[end + 1 - len_of[tok]] = tok
        out: list[int] = []
        open_ = bytearray(b"\1") * (n + 1)
        pos, tok = 0, longest[0]
        while tok >= 0:
            last = out[-1] if out else -1
            while True:
                end = pos + len_of[tok]
                if open_[end]:
                    if last < 0:
                        ok = True
                    else:
                        ok = fits.get(last << 20 | tok)
                        if ok is None:
                            if len(fits) > CACHE_PAIRS:
                                fits.clear()
                            ok = fits[last << 20 | tok] = self._compatible(last, tok)
                    if ok:
                        out.append(tok)
                        pos, tok = end, longest[end]
                        break
                if prefix[tok] >= 0:
                    tok = prefix[tok]
                    continue
                open_[pos] = 0
                if not out:
                    raise ValueError("the vocabulary lacks a byte of this text")
                tok = out.pop()
                pos -= len_of[tok]
                break
        if pos != n:
            raise ValueError("the vocabulary lacks a byte of this text")
        return out

    def _encode_chunk(self, chunk: str) -> str:
        return ",".join([str(i) for p in self.split(chunk) for i in self.encode_piece(p.encode())])

    def lookup(self, chunk: str) -> str:
        """The ids of a chunk, comma-separated, through the cache."""
        got = self.new.get(chunk)
        if got is None:
            got = self.old.get(chunk)
            if got is None:
                got = self._encode_chunk(chunk)
            if len(chunk) <= KEY_CHARS:
                if len(self.new) >= CACHE_WORDS:
                    self.old, self.new = self.new, {}
                self.new[chunk] = got
        return got

    def encode_text(self, text: str) -> str:
        """The ids of a whole text as decimal numbers joined by commas; the empty text has none."""
        new, chunks = self.new, CHUNKS.findall(text)
        got = list(map(new.get, chunks))
        if None in got:
            look = self.lookup
            got = [look(c) if g is None else g for g, c in zip(got, chunks)]
        return ",".join(got)

    def decode_text(self, ids: str) -> bytes:
        return b"".join(map(self.text_of.__getitem__, ids.split(","))) if ids else b""


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec per process and file: workers are reused between tasks."""
    found = _codecs.get((ranks_path, pattern))
    if found is None:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        found = _codecs[ranks_path, pattern] = Codec(ranks, pattern)
    return found


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col`` array<int>: the tokens of each whole text.

    Null text: an empty array.  A column of that name is replaced; all others pass
    through untouched, nulls and repeated rows included.
    """
    rest = [c for c in df.columns if c != ids_col]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for b in batches:
            flat, offs = [], [0]
            for t in b.column(b.schema.get_field_index(text_col)).to_pylist():
                ids = own.encode_text(t or "")
                part = np.array(ids.split(","), np.int32) if ids else np.zeros(0, np.int32)
                flat.append(part)
                offs.append(offs[-1] + len(part))
            ids = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *flat])))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), ids], [*rest, ids_col])

    return df.select(*(F.col(f"`{c}`") for c in df.columns)).mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with ``bytes_col`` binary: the bytes that the ids stand for.

    Null ids: null bytes; an empty array: no bytes.  An id outside the vocabulary, or a
    null id, fails the job, as a silent gap would be worse.
    """
    rest = [c for c in df.columns if c != bytes_col]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(bytes_col, T.BinaryType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(ranks_path, pattern).bytes_of
        for b in batches:
            out = [None if x is None else b"".join([of[i] for i in x]) for x in b.column(b.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), pa.array(out, pa.binary())], [*rest, bytes_col])

    return df.mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode every whole text, decode the ids, and return digests of both.

    Columns: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256.  Null text counts as empty: no token, the digests of nothing.  Null
    ids stay null; repeated rows give repeated rows; other columns are ignored.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = codec(ranks_path, pattern), hashlib.sha256
        for b in batches:
            n, a, d = [], [], []
            for t in b.column(1):
                ids = own.encode_text(t.as_py() or "")
                n.append(ids.count(",") + 1 if ids else 0)
                a.append(sha(ids.encode()).hexdigest())
                d.append(sha(own.decode_text(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_rows(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """What a trainer reads: doc_id, n_tokens, ids array<int>, and decoded_sha256 of the ids decoded again.

    Null text counts as empty; repeated rows give repeated rows; other columns are ignored.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = codec(ranks_path, pattern), hashlib.sha256
        for b in batches:
            for lo in range(0, b.num_rows, 250):
                part = b.slice(lo, 250)
                flat, offs, digest = [np.zeros(0, np.int32)], [0], []
                for t in part.column(1):
                    ids = own.encode_text(t.as_py() or "")
                    flat.append(np.array(ids.split(","), np.int32) if ids else np.zeros(0, np.int32))
                    offs.append(offs[-1] + len(flat[-1]))
                    digest.append(sha(own.decode_text(ids)).hexdigest())
                ids = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offs), pa.int64()), ids, pa.array(digest, pa.string())], ["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")

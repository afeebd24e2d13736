"""Token counts by a map-side lookup in two tiers.

Tier one is a compact hash table, text to count, of frequent pre-tokens; it is
broadcast and has at most ``TABLE_WORDS`` entries, whatever the corpus.  Tier two
is a bounded cache in every worker; what is in neither is encoded by the
tokenizer library itself.  No pre-token is ever shuffled.

A pre-token here is what stands between blanks, tabs and line ends.  The
tokenizer drops white space and none of its steps looks across it, so the count
of a text is the sum over them; each count is the library's own, special strings
included.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeframe.llm._common import id_and_text, tidy

#: Entries of the broadcast table, and about how many rows, chosen by a hash of their ids all over
#: the corpus, it is learnt from.  They decide only what is found in tier one, never a count.
TABLE_WORDS, SAMPLE_ROWS = 32_768, 2_000
#: Entries of a worker's cache, per generation; longer pre-tokens are not kept.
CACHE_WORDS, KEY_CHARS = 200_000, 64

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer, one per process, without threads of its own."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def pretokens(text: str) -> list[str]:
    """Pieces between blanks, tabs and line ends; may hold empty strings."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


class Counts:
    """Tier two: lengths that this worker had to encode, in two generations."""

    def __init__(self, path: str, frequent: dict[str, int]):
        self.frequent, self.encode = frequent, tokenizer(path).encode
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def lookup(self, word: str) -> int:
        got = self.new.get(word)
        if got is None:
            got = self.old.get(word)
            if got is None:
                got = len(self.encode(word, add_special_tokens=False).ids)
            if len(word) <= KEY_CHARS:
                if len(self.new) >= CACHE_WORDS:
                    self.old, self.new = self.new, {}
                self.new[word] = got
        return got

    def count(self, text: str) -> int:
        words = pretokens(text)
        got = list(map(self.frequent.get, words))
        if None in got:
            look = self.lookup
            got = [look(w) if g is None else g for g, w in zip(got, words)]
        return sum(got)


def frequent_lengths(docs: DataFrame, path: str) -> dict[str, int]:
    """The broadcast table: lengths of the commonest pre-tokens of whole texts from all over the corpus.

    Tasks count their share and hand on at most TABLE_WORDS words each.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(w for w in pretokens(t.as_py() or "") if w and len(w) <= KEY_CHARS)
                if len(seen) > 4 * TABLE_WORDS:
                    seen = Counter(dict(seen.most_common(TABLE_WORDS)))
        top = seen.most_common(TABLE_WORDS)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    every = max(1, docs.count() // SAMPLE_ROWS)
    some = docs.where(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(every)) == 0).select("text")
    counts = some.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = [r.word for r in counts.orderBy(F.desc("n"), "word").limit(TABLE_WORDS).collect()]
    got = tokenizer(path).encode_batch(words, add_special_tokens=False)
    return {"": 0} | {w: len(g.ids) for w, g in zip(words, got)}


_counters: dict[tuple[str, int], Counts] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every whole text.

    Null text counts as empty: no byte and no token.  Null ids stay null, repeated rows
    are counted each, other columns are ignored; an empty table gives an empty result.
    """
    docs = id_and_text(docs)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))
    key = (path, shared._jbroadcast.id())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _counters.get(key)
        if own is None:
            _counters.clear()
            own = _counters[key] = Counts(path, shared.value)
        for b in batches:
            n = [own.count(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = docs.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

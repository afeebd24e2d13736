"""Language-model scores by cross-entropy difference.

A target model (texts that the labels call good) and a background model (all
documents) are bigram models of the same kind over one shared vocabulary: all words
of the whole corpus (or the commonest, if a size is stated) and a text start.  A
text's score is the mean difference of its per-token losses; higher is nearer the
target.  Every text is scored by models without itself: its own counts are taken off.

The models grow with the corpus and are never in one place.  Texts are packed into
slices; the distinct n-grams of a few neighbouring slices meet those of the others by
64-bit hash in partitions, where they are counted, and the counts go back to those
that asked.  Which texts are good is found by their ids alone, so no text is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeframe.llm._common import id_and_text, tidy, tidy_groups, write_shared
from codeframe.llm._words import mix

#: Weight of the unigram in a bigram estimate.
BACKOFF = 20.0
#: Distinct words that a task holds before it hands them on, where a vocabulary of a stated size is counted.
HELD_WORDS = 200_000
#: Characters of a slice of texts, about; tokens for each partition of pairs, about; bytes of marks that are broadcast, at most.
SLICE_CHARS, PART_TOKENS, BROADCAST_BYTES = 1 << 21, 2_000_000, 1 << 25
#: Slices, as a power of two, whose n-grams are asked for together: what is asked and answered has a row for each such bundle and partition.
#: A bundle is one group in memory: of eight slices, executors took over 3,000 MB where two cores share them.
BUNDLE = 1
#: N-grams in a batch of rows that ask, about.
ASK_GRAMS = 1 << 18
#: Partitions of pairs for each of words, which are far fewer.
WORD_PARTS = 4
#: Hashes of the text start and of any word outside a vocabulary of a stated size.
START, UNKNOWN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: N-grams of each slice: (previous, word) with how often it occurs; a word, or the start, with how often it occurs and how often it is previous.
PAIR, WORD = 0, 1


def _pack(a: np.ndarray) -> bytes:
    """All first bytes, all second bytes and so on: small numbers and sorted hashes are compressed well so."""
    return a.ravel().view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def vocabulary(docs: DataFrame, size: int) -> list[str]:
    """The ``size - 2`` commonest words of all documents; ties in the order of the words."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for t in b.column(0):
                seen.update((t.as_py() or "").split())
                if len(seen) > HELD_WORDS:
                    yield out()
                    seen.clear()
        yield out()

    counts = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(size - 2).collect()]


def slices_of(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Runs of rows of (doc_id, text): their ids and lengths, the hashes of their distinct words, and each token's place among these."""
    shared = None if words is None else docs.sparkSession.sparkContext.broadcast(frozenset(words))
    names = ["doc_id", "n", "words", "at", "tokens"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if shared is None else shared.value
        ids, n, tokens, chars = [], [], [], 0

        def out():
            place = {w: i for i, w in enumerate(dict.fromkeys(tokens))}
            at = np.fromiter(map(place.__getitem__, tokens), np.int32, len(tokens))
            hashes = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) if known is None or w in known else int(UNKNOWN) for w in place], np.uint64)
            row = [pa.array(ids, pa.int64()), np.array(n, np.int32).tobytes(), hashes.tobytes(), _pack(at), len(tokens)]
            return pa.RecordBatch.from_arrays([pa.array([row[0].to_pylist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in row[1:4]), pa.array([row[4]], pa.int64())], names)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py() or ""
                found = text.split()
                ids.append(i)
                n.append(len(found))
                tokens += found
                chars += len(text) + 100
                if chars > SLICE_CHARS:
                    yield out()
                    ids, n, tokens, chars = [], [], [], 0
        if ids:
            yield out()

    return docs.mapInArrow(run, "doc_id array<long>, n binary, words binary, at binary, tokens long")


@tidy
def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of places to bitmaps."""
    for b in batches:
        out = []
        for x in b.column(1):
            at = x.values.to_numpy()
            flags = np.zeros(at.max() + 1, bool)
            flags[at] = True
            out.append(np.packbits(flags).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["slice", "good"])


def marked(slices: DataFrame, good: DataFrame, docs: int, n: int) -> DataFrame:
    """``slices`` (``n`` of ``docs`` texts) with ``good``, a bit for each text whose id is in ``good``; null: none. Only ids are shuffled."""
    at = slices.select("slice", F.posexplode("doc_id").alias("at", "doc_id")).join(good, "doc_id").groupBy("slice").agg(F.collect_list("at").alias("at"))
    marks = write_shared(at.mapInArrow(_bits, "slice long, good binary"), "lm-marks")
    if docs // 8 + 64 * n <= BROADCAST_BYTES:
        return slices.join(F.broadcast(marks), "slice", "left")
    return slices.join(marks, "slice", "left").repartition(F.shiftright("slice", BUNDLE)).sortWithinPartitions("slice")


def _flags(good: bytes | None, n: int) -> np.ndarray:
    own = np.zeros(0, bool) if good is None else np.unpackbits(np.frombuffer(good, np.uint8))[:n].astype(bool)
    return np.append(own, np.zeros(n - len(own), bool))


def _slice(row: dict) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, list[np.ndarray]]]]:
    """Lengths and flags of a slice's texts; by kind of n-gram the distinct hashes, and each token's places among them."""
    n, words, at = np.frombuffer(row["n"], np.int32).astype(np.int64), np.frombuffer(row["words"], np.uint64), _unpack(row["at"], np.int32)
    start = (np.cumsum(n) - n)[n > 0]
    keys, place = np.unique(np.append(words, START), return_inverse=True)
    word = place[at]
    previous = np.roll(word, 1)
    previous[start] = place[-1]
    pair, both = np.unique(mix(mix(keys[previous]) + keys[word]), return_inverse=True)
    return n, _flags(row["good"], len(n)), [(pair, [both.astype(np.int32)]), (keys, [word.astype(np.int32), previous.astype(np.int32)])]


def _union(keys: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys of several slices, and the place of each slice's keys among them."""
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.split(place.astype(np.int32), np.cumsum([len(k) for k in keys])[:-1])


def _cuts(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Bounds in sorted hashes of the stretches that belong to each of ``parts`` partitions."""
    return np.searchsorted(hashes, np.array([(p << 64) // parts for p in range(1, parts)], np.uint64))


def _ask(parts: int):
    names = ["part", "kind", "piece", "keys", "background", "target"]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())

    def counted(n: np.ndarray, good: np.ndarray, grams: list) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        flag = np.repeat(good, n)
        return [(key, [np.stack([np.bincount(at[f], minlength=len(key)) for at in places]).astype(np.int32) for f in (slice(None), flag)]) for key, places in grams]

    def asked(piece: int, held: list) -> Iterator[pa.RecordBatch]:
        for kind in (PAIR, WORD):
            key, places = _union([x[kind][0] for x in held])
            count = [np.zeros((1 + kind, len(key)), np.int32) for _ in range(2)]
            for x, at in zip(held, places):
                for total, own in zip(count, x[kind][1]):
                    total[:, at] += own
            own_parts = parts if kind == PAIR else -(-parts // WORD_PARTS)
            bounds = [0, *_cuts(key, own_parts), len(key)]
            rows = [(p, kind, piece, _pack(key[x:y]), *(_pack(c[:, x:y]) for c in count)) for p, (x, y) in enumerate(zip(bounds, bounds[1:])) if x < y]
            step = max(1, len(rows) * ASK_GRAMS // max(1, len(key)))
            for i in range(0, len(rows), step):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + step]), kinds)], names)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a piece is a run of neighbouring slices of one bundle, named by the first; a bundle that tasks share has several
        held, first, last = [], 0, 0
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                if held and (row["slice"] != last + 1 or row["slice"] >> BUNDLE != first >> BUNDLE):
                    yield from asked(first, held)
                    held = []
                first, last = (first if held else row["slice"]), row["slice"]
                held.append(counted(*_slice(row)))
        if held:
            yield from asked(first, held)

    return run


def _answer(asked: pa.Table) -> pa.Table:
    """Counts over all slices of one partition's n-grams of one kind; the first row has also how many there are."""
    part, kind = asked["part"][0].as_py(), asked["kind"][0].as_py()
    lengths = np.array([len(k.as_py()) // 8 for k in asked["keys"]], np.int64)
    keys, at = np.unique(np.concatenate([_unpack(k.as_py(), np.uint64) for k in asked["keys"]]), return_inverse=True)
    ends, got = np.cumsum(lengths), []
    for c in ("background", "target"):
        own = np.concatenate([_unpack(x.as_py(), np.int32).reshape(1 + kind, -1) for x in asked[c]], axis=1)
        count = np.stack([np.bincount(at, x, len(keys)).astype(np.int64)[at] for x in own])
        got.append(pa.array([_pack(count[:, e - k : e]) for e, k in zip(ends, lengths)], pa.binary()))
    distinct = [len(keys) - int(kind == WORD and START in keys)] + [0] * (len(lengths) - 1)
    return pa.table([pa.array([part] * len(lengths), pa.int32()), pa.array([kind] * len(lengths), pa.int32()), asked["piece"], *got, pa.array(distinct, pa.int64())], schema=pa.schema(ANSWER))


ANSWER = [("part", pa.int32()), ("kind", pa.int32()), ("piece", pa.int64()), ("background", pa.binary()), ("target", pa.binary()), ("distinct", pa.int64())]


def _own(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often its own text has the n-gram of each place."""
    _, which, count = np.unique(doc * (int(at.max(initial=0)) + 1) + at, return_inverse=True, return_counts=True)
    return count[which]


SCORES = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())]


def _score(tokens: tuple[int, int], size: int):
    """Scores of a bundle's texts from its counts. tokens: of the background and the target; size: of the vocabulary."""

    def one(ids: list, n: np.ndarray, good: np.ndarray, grams: list, counts: dict[str, list[np.ndarray]]) -> pa.Table:
        doc = np.repeat(np.arange(len(n)), n)
        (_, (both,)), (_, (own_word, own_previous)) = grams
        own = [_own(doc, both), _own(doc, own_word), _own(doc, own_previous)]
        means = []
        for name, total in zip(("background", "target"), tokens):
            count = [c[at] for got, (_, places) in zip(counts[name], grams) for c, at in zip(got, places)]
            # what the text itself has added to this model
            in_it = np.ones(len(n), bool) if name == "background" else good
            pair, word, previous = (c - np.where(in_it[doc], o, 0) for c, o in zip(count, own))
            rest = (total - np.where(in_it, n, 0))[doc]
            loss = -np.log((pair + BACKOFF * ((word + 1) / (rest + size))) / (previous + BACKOFF))
            sums, ends = np.concatenate([[0.0], np.cumsum(loss)]), np.cumsum(n)
            means.append((sums[ends] - sums[ends - n]) / np.maximum(n, 1))
        return pa.table([pa.array(ids, pa.int64()), pa.array(n), pa.array(means[1]), pa.array(means[0]), pa.array(means[0] - means[1])], schema=pa.schema(SCORES))

    @tidy_groups
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds, pieces, part = (right[c].to_numpy() for c in ("kind", "piece", "part"))
        by_part, order = np.argsort(part, kind="stable"), np.argsort(left["slice"].to_numpy())
        number = left["slice"].to_numpy()[order]
        starts, out = np.unique(pieces), []
        for piece, x, y in zip(starts, np.searchsorted(number, starts), np.append(np.searchsorted(number, starts[1:]), len(number))):
            at = order[x:y].tolist()
            own = [_slice({c: left[c][i].as_py() for c in ("n", "good", "words", "at")}) for i in at]
            places = [_union([grams[k][0] for _, _, grams in own])[1] for k in (PAIR, WORD)]
            counts = {}
            for name in ("background", "target"):
                raw = [[_unpack(right[name][int(i)].as_py(), np.int64).reshape(1 + k, -1) for i in by_part[(kinds[by_part] == k) & (pieces[by_part] == piece)]] for k in (PAIR, WORD)]
                counts[name] = [np.concatenate([np.zeros((1 + k, 0), np.int64), *x], axis=1) for k, x in enumerate(raw)]
            for i, (n, good, grams) in enumerate(own):
                out.append(one(left["doc_id"][at[i]].as_py(), n, good, grams, {name: [c[:, places[k][i]] for k, c in enumerate(got)] for name, got in counts.items()}))
        return pa.concat_tables(out) if out else pa.schema(SCORES).empty_table()

    return run


def score(docs: DataFrame, labels: DataFrame, size: int | None = None) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of every whole text.

    Losses are nats per token; score = background_loss - target_loss.  Null and empty
    texts have no token, losses 0 and score 0.  Labels other than a single quality of 1
    teach nothing; null ids are scored and count in the background; repeated rows count
    each time; other columns are ignored.  ``size`` is the vocabulary's with the start and
    the unknown word: all words where none is stated.
    """
    docs = id_and_text(docs)
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("a"), F.max("quality").alias("b")).where("a = 1 and b = 1").select("doc_id")
    packed = slices_of(docs, None if size is None else vocabulary(docs, size)).withColumn("slice", F.monotonically_increasing_id())
    slices = write_shared(packed, "lm-slices", 32)
    n, texts, number = slices.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum(F.size("doc_id")), F.lit(0)), F.count("*")).first()
    slices = marked(slices, good, texts, number)
    asked = slices.mapInArrow(_ask(max(1, -(-n // PART_TOKENS))), "part int, kind int, piece long, keys binary, background binary, target binary")
    counts = write_shared(asked.groupBy("part", "kind").applyInArrow(_answer, "part int, kind int, piece long, background binary, target binary, distinct long"), "lm-counts")
    words = counts.where(F.col("kind") == WORD).agg(F.sum("distinct")).first()[0] or 0
    taught = slices.select("good", "n").mapInArrow(_taught, "tokens long").agg(F.sum("tokens")).first()[0] or 0
    run = _score((n, taught), words + 2 if size is None else size)
    bundle = lambda name: F.shiftright(name, BUNDLE).alias("bundle")
    return slices.groupBy(bundle("slice")).cogroup(counts.groupBy(bundle("piece"))).applyInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def _taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of good texts."""
    for b in batches:
        got = 0
        for g, n in zip(b.column(0), b.column(1)):
            size = np.frombuffer(n.as_py(), np.int32)
            got += int(size[_flags(g.as_py(), len(size))].sum(dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([got], pa.int64())], ["tokens"])

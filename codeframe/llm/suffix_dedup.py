"""Exact repeated-substring removal over a sparse, distributed suffix array.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts
anywhere else.  Sorting every suffix of the corpus would move many times its size,
so the array is sparse, and exact for strings of that length:

1. *Slices.*  Rows are packed into numbered slices of about ``SLICE`` bytes and written
   once; a byte is known by its slice and its place there, whatever ids the rows have.
2. *Anchors.*  In every stretch of LENGTH bytes the ``GRAM``-byte gram of least hash
   is its anchor.  Equal stretches have the same anchor at the same place, so only
   suffixes at anchors need sorting: about one in 63 bytes of prose.
3. *Buckets.*  Slices ask partitions of grams, by packed hashes, which of their anchors
   occur elsewhere.  Those whose whole surroundings (all stretches with this anchor)
   are equal are repeats outright; grams that occur once are done.
4. *Deep-shallow sorting.*  For the grams that occur in different surroundings these are
   sent, and the suffixes from the anchor, and the reversed prefixes before it, are
   sorted: multikey quicksort with 8-byte letters to a shallow depth, then a blind trie
   for every group that is still tied.  A stretch that starts o bytes before the anchor
   repeats if another one shares o bytes to the left and LENGTH - o to the right, which
   are runs of both orders.

A gram with more than ``GROUP_ROWS`` surroundings is split by its next bytes: stretches
that start within 21 neighbouring bytes have a core of 180 bytes in common, whose hash is
the finer key, and the pieces are sorted in the same way.  What shares even a core more
often than that is split down to whole stretches, which need no more sorting.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeframe.llm._common import id_and_text, salted, tidy, tidy_groups, utf8, write_shared
from codeframe.llm._words import Hasher, mix

LENGTH, GRAM = 200, 40
#: Bytes of text in a slice, about (one longer text is a slice of its own), and in a partition of grams.
SLICE, PART_BYTES = 1 << 21, 1 << 24
#: More surroundings than this of one key are split by their next bytes before they are sorted.
GROUP_ROWS = 50_000
#: Surroundings that are sorted together, and bytes that are scanned for anchors together.
SORT_ROWS, SCAN_BYTES = 16_384, 1 << 19
#: Depth of the multikey quicksort; longer common prefixes go to blind tries.
SHALLOW_RIGHT, SHALLOW_LEFT = 64, 32
#: Offsets of one key before splitting, after it, and after that.
WIDTHS = (LENGTH - GRAM + 1, 21, 1)
_U = np.uint64


# ---------------------------------------------------------------- anchors


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every ``width`` neighbours, by doubling."""
    step = 1
    while step * 2 <= width:
        x = op(x[:-step], x[step:])
        step *= 2
    return op(x[: -(width - step)], x[width - step :]) if width > step else x


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors in texts of one buffer, ascending, and the hash of the gram at each."""
    width, n = LENGTH - GRAM + 1, len(data)
    pos, keys = [], []
    for s in range(0, n, SCAN_BYTES):
        part = data[s : min(n, s + SCAN_BYTES + LENGTH - 1)]
        if len(part) < LENGTH:
            break
        at = np.arange(len(part) - GRAM + 1)
        h = Hasher(part)(at, at + GRAM)
        rank = (h >> _U(32)).astype(np.uint32) | np.uint32(1)
        least = _slide(rank, width, np.minimum)
        start = at[: len(least)] + s
        inside = start + LENGTH <= offs[np.searchsorted(offs, start, side="right")]
        least = np.where(inside, least, np.uint32(0))
        pad = np.zeros(width - 1, np.uint32)
        hit = np.nonzero(_slide(np.concatenate([pad, least, pad]), width, np.maximum)[: len(rank)] == rank)[0]
        pos.append(hit + s)
        keys.append(h[hit])
    if not pos:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    pos, keys = np.concatenate(pos), np.concatenate(keys)
    pos, first = np.unique(pos, return_index=True)
    return pos, keys[first]


def merge(start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join overlapping or touching stretches of one text; input sorted by (doc, start), ends below 2**40."""
    if not len(start):
        return start, end, doc
    far = np.maximum.accumulate(end + (doc.astype(np.int64) << 40)) - (doc.astype(np.int64) << 40)
    new = np.ones(len(start), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > far[:-1])
    at = np.nonzero(new)[0]
    return start[at], far[np.append(at[1:], len(start)) - 1], doc[at]



def entries(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors of a slice and their classes of equal surroundings, in an order that depends on the slice alone.

    Per anchor: a, s, e (place, and bounds of its surroundings) and ``of``, its class; per class
    its first anchor, kh and ch (hashes of gram and surroundings), and whether it has several.
    """
    a, kh = anchors(data, offs)
    doc = np.searchsorted(offs, a, side="right") - 1
    s, e = np.maximum(offs[doc], a + GRAM - LENGTH), np.minimum(offs[doc + 1], a + LENGTH)
    raw = data.tobytes()
    ch = np.fromiter((xxhash.xxh3_64_intdigest(raw[x:y], z) for x, y, z in zip(s.tolist(), e.tolist(), (a - s).tolist())), _U, len(a))
    order = np.lexsort((a, ch, kh))
    new = np.ones(len(a), bool)
    new[1:] = (kh[order][1:] != kh[order][:-1]) | (ch[order][1:] != ch[order][:-1])
    of = np.empty(len(a), np.int64)
    of[order] = np.cumsum(new) - 1
    first = order[new]
    return {"a": a, "s": s, "e": e, "of": of, "first": first, "kh": kh[first], "ch": ch[first], "several": np.bincount(of, minlength=len(first)) > 1}


#: Flags of what a slice asks: the class has several anchors here; no class, only a mark that the gram has several; the gram is known to have several.
_SEVERAL, _MARK, _MIXED = 1, 2, 4
#: Answers: nothing else has the gram; all of the surroundings repeat; others have the gram in other surroundings; both, and this slice sends them.
NOTHING, WHOLE, ALONE, SENDS = 0, 1, 2, 3


def asks(c: dict[str, np.ndarray], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a slice asks, ordered by partition and kh: partition, kh, ch, flags, and the class (-1: a mark).

    A gram with one class here goes by its own hash, so a partition gets it once a slice.  One with
    several may be hot: its classes are spread by both hashes, and a mark goes by the gram's.  Hashes
    of anchors are the least of many, so they are mixed again: else nearly all go to one partition.
    """
    kh, ch = c["kh"], c["ch"]
    gram, which, count = np.unique(kh, return_inverse=True, return_counts=True)
    mixed = count[which] > 1
    marks = gram[count > 1]
    part = _part(np.concatenate([np.where(mixed, mix(kh ^ mix(ch + _U(1))), mix(kh)), mix(marks)]), parts)
    flags = np.concatenate([c["several"] * _SEVERAL + mixed * _MIXED, np.full(len(marks), _MARK)]).astype(np.uint8)
    cls = np.concatenate([np.arange(len(kh)), np.full(len(marks), -1)])
    kh = np.concatenate([kh, marks])
    order = np.lexsort((kh, part))
    return part[order], kh[order], np.concatenate([ch, np.zeros(len(marks), _U)])[order], flags[order], cls[order]


def _part(route: np.ndarray, parts: int) -> np.ndarray:
    """Partitions, of at most 2**31, by the first half of a hash."""
    return ((route >> _U(32)) * _U(parts) >> _U(32)).astype(np.int32)


def _planes(x: np.ndarray) -> bytes:
    """First bytes, then second bytes and so on: sorted hashes are compressed well so."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unplanes(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def answer(kh: np.ndarray, ch: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Answers to all that was asked of one partition, in the order of asking."""
    n = len(kh)
    order = np.lexsort((np.arange(n), ch, kh))
    kh, ch, flags = kh[order], ch[order], flags[order]
    gram = np.ones(n, bool)
    gram[1:] = kh[1:] != kh[:-1]
    cls = gram.copy()
    cls[1:] |= ch[1:] != ch[:-1]
    mark = flags & _MARK > 0
    # a mark counts as several classes
    of_gram, of_cls = np.cumsum(gram) - 1, np.cumsum(cls) - 1
    kinds = np.bincount(of_gram, weights=cls & ~mark) + 2 * np.bincount(of_gram, weights=flags & (_MARK | _MIXED) > 0)
    mixed = kinds[of_gram] > 1
    rows = np.bincount(of_cls, weights=np.where(mark, 0, 1 + (flags & _SEVERAL > 0)))[of_cls]
    got = np.where(rows > 1, np.where(mixed & cls, SENDS, WHOLE), np.where(mixed, ALONE, NOTHING))
    out = np.empty(n, np.uint8)
    out[order] = np.where(mark, NOTHING, got)
    return out


# ---------------------------------------------------------------- deep-shallow sorting


class BlindTrie:
    """Orders byte strings of one length; looks only at branching bytes on the way down, then compares once."""

    def __init__(self, first: bytes):
        self.size = len(first)
        self.root: list | bytes = first  # a leaf is its string; a node is [depth, {byte: child}, any leaf]

    def add(self, s: bytes) -> None:
        at = self.root
        while type(at) is list:  # blind descent
            at = at[1].get(s[at[0]]) or at[2]
        x = int.from_bytes(s, "big") ^ int.from_bytes(at, "big")
        if not x:
            return
        lcp = self.size - (x.bit_length() + 7) // 8
        up, at = None, self.root
        while type(at) is list and at[0] < lcp:
            up, at = at, at[1][s[at[0]]]
        if type(at) is list and at[0] == lcp:
            at[1][s[lcp]] = s
            return
        leaf = at if type(at) is bytes else at[2]
        node = [lcp, {leaf[lcp]: at, s[lcp]: s}, leaf]
        if up is None:
            self.root = node
        else:
            up[1][s[up[0]]] = node

    def in_order(self) -> list[tuple[bytes, int]]:
        """Strings in order, each with the prefix it shares with the one before (0 for the first)."""
        out: list[tuple[bytes, int]] = []
        todo = [(self.root, 0)]
        while todo:
            at, lcp = todo.pop()
            if type(at) is bytes:
                out.append((at, lcp))
            else:
                kids = [at[1][k] for k in sorted(at[1])]
                todo.extend((k, at[0] if i else lcp) for i, k in reversed(list(enumerate(kids))))
        return out



def multikey_quicksort(words: np.ndarray, group: np.ndarray, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of ``words`` within ``group`` (ascending) by their first ``letters``, and where segments of equal ones begin.

    Every segment is cut in three by a pivot's letter: the less and the greater parts go on
    with the same letter, the equal part with the next.  All segments take a step at once.
    """
    n = len(words)
    order, depth = np.arange(n), np.zeros(n, np.int64)
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    at = np.arange(n)
    while True:
        head = new[at]
        size = np.diff(np.append(np.nonzero(head)[0], len(at)))
        open_ = np.repeat(size > 1, size) & (depth[at] < letters)
        at = at[open_]
        if not len(at):
            return order, new
        first = np.nonzero(new[at])[0]
        size = np.diff(np.append(first, len(at)))
        letter = words[order[at], depth[at]]
        pivot = np.repeat(letter[first + size // 2], size)
        side = (letter >= pivot).astype(np.int64) + (letter > pivot)
        key = np.repeat(np.arange(len(first)) * 3, size) + side
        put = np.argsort(key, kind="stable")
        order[at] = order[at][put]
        key = key[put]
        new[at[1:]] |= key[1:] != key[:-1]
        depth[at] += key % 3 == 1


def deep_shallow(rows: np.ndarray, lens: np.ndarray, group: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort byte rows (padded with zeros, ``lens`` long) within ``group``, which ascends.

    Returns the order and the common prefix of each row with the one before it, at most
    the shorter of both; -1 where a group begins.
    """
    n, width = rows.shape
    words = np.ascontiguousarray(rows).view(">u8").astype(_U)
    order, new = multikey_quicksort(words, group, shallow // 8)
    starts = np.nonzero(new)[0]
    ends = np.append(starts[1:], n)
    deep = ends - starts > 1
    raw = np.ascontiguousarray(rows[:, shallow:]).tobytes()
    rest = width - shallow
    for s, e in zip(starts[deep].tolist(), ends[deep].tolist()):  # long common prefixes: blind tries
        same: dict[bytes, list[int]] = {}
        for r in order[s:e].tolist():
            same.setdefault(raw[r * rest : (r + 1) * rest], []).append(r)
        it = iter(same)
        trie = BlindTrie(next(it))
        for x in it:
            trie.add(x)
        order[s:e] = [r for x, _ in trie.in_order() for r in sorted(same[x], key=lens.__getitem__)]
    lcp = np.full(n, -1, np.int64)
    inner = np.nonzero(group[1:] == group[:-1])[0] + 1
    x = words[order[inner]] ^ words[order[inner - 1]]
    differ = x != 0
    word = np.where(differ.any(1), differ.argmax(1), x.shape[1])
    left = x[np.arange(len(inner)), np.minimum(word, x.shape[1] - 1)]
    common = 8 * word + np.where(word < x.shape[1], (64 - bits(left)) // 8, 0)
    size = lens[order]
    lcp[inner] = np.minimum(common, np.minimum(size[inner], size[inner - 1]))
    return order, lcp


def bits(x: np.ndarray) -> np.ndarray:
    """Bit length of unsigned words."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x |= x >> _U(k)
    return np.bitwise_count(x).astype(np.int64)


def match(left: np.ndarray, left_len: np.ndarray, right: np.ndarray, right_len: np.ndarray, group: np.ndarray, first: int = 0, last: int = LENGTH - GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For every surrounding the least and largest o, of ``first`` to ``last``, such that the stretch from o bytes before the anchor repeats; -1: none."""
    n = len(group)
    lo, hi = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    r_order, r_lcp = deep_shallow(right, right_len, group, SHALLOW_RIGHT)
    l_order, l_lcp = deep_shallow(left, left_len, group, SHALLOW_LEFT)
    r_cls, l_cls = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(first, last + 1):
        r_new, l_new = r_lcp < LENGTH - o, l_lcp < o
        r_cls[r_order] = np.cumsum(r_new)
        # rows alone in a run of either order are done
        alone = np.zeros(n, bool)
        alone[r_order] = r_new & np.append(r_new[1:], True)
        alone[l_order] |= l_new & np.append(l_new[1:], True)
        at = np.nonzero(~alone)[0]
        if len(at) < 2:
            continue
        l_cls[l_order] = np.cumsum(l_new)
        key = r_cls[at] * (n + 1) + l_cls[at]
        s = np.sort(key)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if not len(twice):
            continue
        hit = at[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
        lo[hit] = np.where(lo[hit] < 0, o, lo[hit])
        hi[hit] = o
    return lo, hi


#: Surroundings: key (k1, k2) and first offset that is judged, slice, place of the anchor, bytes before it, whether an answer is wanted.
AROUND_ROW = "k1 long, k2 long, first int, slice long, a long, before int, alone boolean, around binary"
SPAN_ROW = "slice long, s long, e long"


def _batch(schema: str, **cols) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(cols[k], kinds[x.split()[1]]) for k, x in zip(names, schema.split(", "))], names)


def _match_rows(width: int):
    """Surroundings in order of their key: whole keys are gathered to SORT_ROWS and matched together."""

    def solve(t: pa.Table, first: int):
        g = {k: t[k].combine_chunks().to_numpy(zero_copy_only=False) for k in ("k1", "k2", "slice", "a", "before", "alone")}
        data, offs = utf8(t["around"])
        new = np.ones(t.num_rows, bool)
        new[1:] = (g["k1"][1:] != g["k1"][:-1]) | (g["k2"][1:] != g["k2"][:-1])
        group, before = np.cumsum(new), g["before"].astype(np.int64)
        start, size = offs[:-1], np.diff(offs)
        padded = np.concatenate([data, np.zeros(2 * LENGTH, np.uint8)])
        k = np.arange(LENGTH)
        right_len = size - before
        right = np.where(k < right_len[:, None], padded[np.minimum((start + before)[:, None] + k, len(padded) - 1)], 0).astype(np.uint8)
        k = np.arange(LENGTH - GRAM)
        left = np.where(k < before[:, None], padded[np.maximum((start + before)[:, None] - 1 - k, 0)], 0).astype(np.uint8)
        lo, hi = match(left, before, right, right_len, group, first, min(first + width - 1, LENGTH - GRAM))
        hit = np.nonzero((lo >= 0) & g["alone"])[0]
        if len(hit):
            yield _batch(SPAN_ROW, slice=g["slice"][hit], s=g["a"][hit] - hi[hit], e=g["a"][hit] - lo[hit] + LENGTH)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        held = 0

        def whole(last: bool):
            """Solve whole keys of what is held; the last key may go on."""
            nonlocal parts, held
            t = pa.Table.from_batches(parts)
            f, k1, k2 = (t[c].to_numpy() for c in ("first", "k1", "k2"))
            new = np.ones(len(f), bool)
            new[1:] = (f[1:] != f[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            ends = np.append(np.nonzero(new)[0][1:], len(f))
            if not last:
                ends = ends[:-1]
            done = 0
            while len(ends) and done < ends[-1]:
                # as many keys of one first offset as make SORT_ROWS, one at least
                same = ends[(ends > done) & (f[ends - 1] == f[done])]
                fit = same[same <= done + SORT_ROWS]
                to = int(fit[-1] if len(fit) else same[0])
                yield from solve(t.slice(done, to - done), int(f[done]))
                done = to
            parts, held = t.slice(done).to_batches(), t.num_rows - done

        for b in batches:
            if b.num_rows:
                parts.append(b)
                held += b.num_rows
                if held >= SORT_ROWS:
                    yield from whole(False)
        if held:
            yield from whole(True)

    return run


def _split(width: int):
    """Surroundings to those of a finer key: the hash of what all stretches from ``width`` neighbouring offsets have in common."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {x.split()[0]: [] for x in AROUND_ROW.split(", ")}
            for r in b.to_pylist():
                text, before = r["around"], r["before"]
                end = min(r["first"] + WIDTHS[WIDTHS.index(width) - 1], LENGTH - GRAM + 1)
                for first in range(r["first"], end, width):
                    last = min(first + width, end) - 1
                    if before < first or len(text) - before < LENGTH - last:
                        continue
                    h = xxhash.xxh3_128_intdigest(text[before - first : before + LENGTH - last])
                    for k, v in (r | {"k1": (h >> 64) - (1 << 63), "k2": (h & (1 << 64) - 1) - (1 << 63), "first": first}).items():
                        out[k].append(v)
            yield _batch(AROUND_ROW, **out)

    return run


def matched_spans(near: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Spans of the rows of ``near`` that want an answer; hot keys are split by their next bytes and sorted again."""
    key = ["first", "k1", "k2"]
    out = None
    for level, width in enumerate(WIDTHS[:-1]):
        sizes = near.groupBy(*key).agg(F.count("*").alias("hits"))
        limit = max(group_rows, (near.count() if group_rows == GROUP_ROWS else 0) // 1_000_000)
        big = sizes.where(F.col("hits") > limit).select(*key)  # a million keys at most
        some = not big.isEmpty()
        small = near.join(F.broadcast(big), key, "left_anti") if some else near
        got = small.repartition(*key).sortWithinPartitions(*key, "slice", "a").mapInArrow(_match_rows(width), SPAN_ROW)
        out = got if out is None else out.unionByName(got)
        if not some:
            return out
        near = write_shared(near.join(F.broadcast(big), key, "left_semi").select(*(x.split()[0] for x in AROUND_ROW.split(", "))).mapInArrow(_split(WIDTHS[level + 1]), AROUND_ROW), "dedup-split")
    # keys are whole stretches now: two rows of one are repeats
    twice = near.groupBy("first", "k1", "k2").agg(F.count("*").alias("hits")).where("hits > 1")
    name = F.concat_ws(":", *key)
    hit = salted(near.where("alone").select(name.alias("key"), "slice", "a", "first"), twice.select(name.alias("key"), "hits"), "key", "a")
    s = F.col("a") - F.col("first")
    return out.unionByName(hit.select("slice", s.alias("s"), (s + LENGTH).alias("e")))


# ---------------------------------------------------------------- the operator


def _slices(docs: DataFrame) -> DataFrame:
    """Numbered runs of rows as compressed Arrow tables: slice, bytes (of text), rows."""
    at = docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        held = 0

        def out():
            t = pa.Table.from_batches(parts).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as w:
                w.write_table(t)
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bytes", "rows"])

        for b in batches:
            _, offs = utf8(b.column(at))
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE - held, side="right")) - 1)
                parts.append(b.slice(i, j - i))
                held += int(offs[j] - offs[i])
                i = j
                if held >= SLICE or i < b.num_rows:
                    yield out()
                    parts, held = [], 0
        if parts:
            yield out()

    rows = docs.mapInArrow(run, "bytes long, rows binary").withColumn("slice", F.monotonically_increasing_id())
    return write_shared(rows, "dedup-slices", 32)


def _text(raw: bytes, at: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows of a slice, and the bytes and offsets of their texts."""
    t = pa.ipc.open_stream(raw).read_all()
    return t, *utf8(t.column(at))


def _ask(parts: int, at: int):
    names = ["part", "slice", "kh", "ch", "flags"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, number in enumerate(b.column(0).to_pylist()):
                part, kh, ch, flags, _ = asks(entries(*_text(b.column(1)[i].as_py(), at)[1:]), parts)
                cut = np.searchsorted(part, np.arange(parts + 1)).tolist()
                rows = [(p, number, _planes(kh[x:y]), ch[x:y].tobytes(), flags[x:y].tobytes()) for p, (x, y) in enumerate(zip(cut, cut[1:])) if x < y]
                if rows:
                    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def _answer_part(asked: pa.Table) -> pa.Table:
    """Answers of one partition, a row for each slice that asked it; slices in their order."""
    asked = asked.sort_by("slice")
    size = np.array([len(f) for f in asked["flags"].to_pylist()])
    kh = np.concatenate([_unplanes(x, _U) for x in asked["kh"].to_pylist()])
    ch, flags = np.frombuffer(b"".join(asked["ch"].to_pylist()), _U), np.frombuffer(b"".join(asked["flags"].to_pylist()), np.uint8)
    got, ends = answer(kh, ch, flags), np.cumsum(size)
    return pa.table([asked["part"], asked["slice"], pa.array([got[e - n : e].tobytes() for e, n in zip(ends, size)], pa.binary())], names=["part", "slice", "answers"])


def _tell(parts: int, at: int):
    """A slice with its answers: the spans that repeat outright (packed), and surroundings that have to be matched."""
    names = [x.split()[0] for x in AROUND_ROW.split(", ")] + ["told"]
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int32()), ("slice", pa.int64()), ("a", pa.int64()), ("before", pa.int32()), ("alone", pa.bool_()), ("around", pa.binary()), ("told", pa.binary())])

    @tidy_groups
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        number = left["slice"][0].as_py()
        _, data, offs = _text(left["rows"][0].as_py(), at)
        c = entries(data, offs)
        _, _, _, _, cls = asks(c, parts)
        got = np.frombuffer(b"".join(right.sort_by("part")["answers"].to_pylist()), np.uint8)
        code = np.zeros(len(c["kh"]), np.uint8)
        code[cls[cls >= 0]] = got[cls >= 0]
        told = np.nonzero((code[c["of"]] == WHOLE) | (code[c["of"]] == SENDS))[0]
        doc = np.searchsorted(offs, c["a"][told], side="right") - 1
        s, e, _ = merge(c["s"][told], c["e"][told], doc)
        near = np.nonzero(code >= ALONE)[0]
        a = c["first"][near]
        raw = data.tobytes()
        n, z = len(near), [None] * len(near)
        cols = {
            "k1": c["kh"][near].view(np.int64), "k2": np.zeros(n, np.int64), "first": np.zeros(n, np.int32), "slice": np.full(n, number), "a": c["a"][a], "before": (c["a"] - c["s"])[a].astype(np.int32),
            "alone": code[near] == ALONE, "around": [raw[x:y] for x, y in zip(c["s"][a].tolist(), c["e"][a].tolist())], "told": z,
        }
        out = pa.table([pa.array(cols[k], schema.field(k).type) for k in names], schema=schema)
        if len(s):
            one = {k: [None] for k in names} | {"slice": [number], "told": [np.stack([s, e]).astype(np.int64).tobytes()]}
            out = pa.concat_tables([out, pa.table([pa.array(one[k], schema.field(k).type) for k in names], schema=schema)])
        return out

    return run


def _with_spans(docs: DataFrame, group_rows: int, finish: Callable, schema) -> DataFrame:
    """``finish(rows, bytes, offsets, starts, ends, row of each)`` of every slice, with its merged spans in order."""
    at = docs.columns.index("text")
    slices = _slices(docs)
    n = slices.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, -(-n // PART_BYTES))
    asked = slices.select("slice", "rows").mapInArrow(_ask(parts, at), "part int, slice long, kh binary, ch binary, flags binary")
    answers = asked.groupBy("part").applyInArrow(_answer_part, "part int, slice long, answers binary")
    told = slices.select("slice", "rows").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_tell(parts, at), AROUND_ROW + ", told binary")
    told = write_shared(told, "dedup-surroundings")
    spans = matched_spans(told.where("told is null").drop("told"), group_rows)
    none = F.lit(None)
    both = told.where("told is not null").select("slice", none.cast("long").alias("s"), none.cast("long").alias("e"), "told").unionByName(spans.withColumn("told", none.cast("binary")))

    @tidy_groups
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        t, data, offs = _text(left["rows"][0].as_py(), at)
        told = [np.frombuffer(x, np.int64).reshape(2, -1) for x in right["told"].drop_null().to_pylist()]
        single = right.filter(pc.is_valid(right["s"]))
        s, e = np.concatenate([np.stack([single[k].to_numpy().astype(np.int64) for k in ("s", "e")]), *told], axis=1)
        order = np.argsort(s, kind="stable")
        s, e = s[order], e[order]
        s, e, row = merge(s, e, np.searchsorted(offs, s, side="right") - 1)
        return finish(t, data.tobytes(), offs, s, e, row)

    return slices.select("slice", "rows").groupBy("slice").cogroup(both.groupBy("slice")).applyInArrow(run, schema)


def kept_parts(raw: bytes, offs: np.ndarray, s: np.ndarray, e: np.ndarray, row: np.ndarray) -> Iterator[tuple[list[bytes], int, int]]:
    """Of every row what stays of it, the bytes removed, and how many runs they are in."""
    first = np.searchsorted(row, np.arange(len(offs))).tolist()
    s, e, offs = s.tolist(), e.tolist(), offs.tolist()
    for i in range(len(offs) - 1):
        parts, at, removed = [], offs[i], 0
        for k in range(first[i], first[i + 1]):
            parts.append(raw[at : s[k]])
            removed += e[k] - s[k]
            at = e[k]
        parts.append(raw[at : offs[i + 1]])
        yield parts, removed, first[i + 1] - first[i]


def digest(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``.

    Null text counts as empty; texts under 200 bytes keep every byte.  Null ids stay null;
    rows of one id are different rows, and repeated rows repeat each other and both lose
    their text; other columns are ignored.
    """

    def finish(t, raw, offs, s, e, row):
        size, gone, runs, sha = np.diff(offs), [], [], []
        for parts, removed, n in kept_parts(raw, offs, s, e, row):
            gone.append(removed)
            runs.append(n)
            sha.append(hashlib.sha256(b"".join(parts)).hexdigest())
        return pa.table([t.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(id_and_text(docs), group_rows, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``, and ``n_chars`` (if there) counted anew.

    A character that lost some of its bytes goes with them.  Null text becomes empty;
    texts that lose everything stay as empty rows; other columns pass through.
    """
    whole = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    at, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def finish(t, raw, offs, s, e, row):
        texts = pa.array(["".join(x.decode("utf-8", "ignore") for x in parts) for parts, _, _ in kept_parts(raw, offs, s, e, row)], pa.string())
        t = t.set_column(at, t.field(at), texts.cast(t.field(at).type))
        return t if count is None else t.set_column(count, t.field(count), pc.utf8_length(texts).cast(t.field(count).type))

    return _with_spans(whole, group_rows, finish, T.StructType([T.StructField(f.name, f.dataType) for f in whole.schema]))

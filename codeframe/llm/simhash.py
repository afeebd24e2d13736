"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint is a majority vote over the XXH64 of all word shingles.  Candidates
come from an exact cover: the 64 bits are cut into b blocks (5 to 9, more for more
fingerprints, so that a key has about 64 at most), two fingerprints that differ in at
most four bits agree on at least b - 4 whole blocks, so each choice of b - 4 blocks is a
key.  All comparisons are bit-sliced: bit planes are stored vertically, one word holds
one bit of 64 fingerprints, carry-save counters add up the differing planes, and a block
of 64 distances is left as soon as every one in it is beyond the radius.  No link is missed.

Equal fingerprints are one vertex.  A key with more than ``BLOCK`` fingerprints is
cut into blocks, and each pair of blocks is its own group, so no task holds an
unbounded one.  Of a group's links only a spanning forest leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeframe.llm._common import id_and_text, row_key, salted, tidy, write_shared
from codeframe.llm.components import components

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Fingerprints of one key, about, that the number of blocks is chosen for.
LOAD = 64
#: Fingerprints that one group compares, at most; larger keys are cut into blocks of this many.
BLOCK = 4096
_U = np.uint64


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text: A-Z lower-cased, words, shingles with repeats."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    n = max(1, len(words) - size + 1)
    starts = [0, *ends][:n]
    stops = [e - 1 for e in ends[min(size, len(words)) - 1 :]]
    h = np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(starts, stops)], repeat(SEED)), _U, n)
    votes = np.zeros(64, np.int64)
    for k in range(0, n, 4096):
        votes += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(_U)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, k1, k2, fp): fp as a signed long; k1 and k2 name the row (see ``row_key``)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py() or "", size) for t in b.column(3)], _U).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fp)], ["doc_id", "k1", "k2", "fp"])

    return id_and_text(docs).select("doc_id", *row_key(), "text").mapInArrow(run, "doc_id long, k1 long, k2 long, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 bit planes: bit j % 64 of plane[b][j // 64] is bit b of fingerprint j."""
    n = len(fps)
    bits = np.zeros((64, (n + 63) // 64 * 64), np.uint8)
    bits[:, :n] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(_U)


_FULL = ~_U(0)


def sliced(plane, places: list[np.ndarray], dead: np.ndarray, radius: int = RADIUS) -> tuple[list[np.ndarray], np.ndarray]:
    """Blocks of 64 distances: where they are, for those with one within ``radius``, and a word that flags these.

    ``plane(bit, *places)`` is the word of each block that flags the distances in which the bit
    differs; ``dead`` flags what is no pair.  A block is dropped as soon as all in it are dead.
    """
    count = [np.zeros_like(dead) for _ in range(int(radius).bit_length() + 1)]
    for bit in range(64):
        carry = plane(bit, *places)
        for c in range(len(count)):  # carry-save: the counters are planes too
            count[c], carry = count[c] ^ carry, count[c] & carry
        dead = dead | carry  # beyond what the counters hold
        if bit % 8 == 7:
            dead |= over(count, radius)
            alive = dead != _FULL
            if not alive.all():
                places, dead, count = [p[alive] for p in places], dead[alive], [c[alive] for c in count]
                if not len(dead):
                    break
    return places, ~dead


def _flagged(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of which word, and at which bit, each flag is."""
    return np.nonzero(np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))


def near_pairs(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j), i in a and j in b, at distance at most ``radius`` (i < j within a, if b is None)."""
    planes = planes_of(a if b is None else b)
    n, width = len(a if b is None else b), planes.shape[1]
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, (1 << 16) // width)
    for lo in range(0, len(a), step):
        q = a[lo : lo + step]
        mine = np.stack([-(q >> _U(bit) & _U(1)) for bit in range(64)])
        dead = np.zeros((len(q), width), _U)
        if n % 64:
            dead[:, -1] = _FULL << _U(n % 64)
        if b is None:
            for r in range(len(q)):
                k = lo + r + 1
                dead[r, : k // 64] = _FULL
                if k % 64:
                    dead[r, k // 64] |= _FULL >> _U(64 - k % 64)
        row, word = np.nonzero(dead != _FULL)
        (row, word), left = sliced(lambda bit, r, w: planes[bit][w] ^ mine[bit][r], [row, word], dead[row, word], radius)  # noqa: B023
        k, j = _flagged(left)
        out_i.append(lo + row[k])
        out_j.append(word[k] * 64 + j)
    return np.concatenate(out_i), np.concatenate(out_j)


def pairs_in_runs(fps: np.ndarray, run: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at distance at most ``radius`` within runs (ascending numbers), all runs at once.

    Fingerprints of many runs share planes: those d places apart are compared by shifting a
    plane against itself; blocks without two of one run are dropped before.
    """
    longest = int(np.bincount(run - run[0]).max()) if len(run) else 0
    planes = np.pad(planes_of(fps), ((0, 0), (0, longest // 64 + 2)))
    out_i, out_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, longest):
        pair = np.zeros((len(fps) + 63) // 64 * 64, np.uint8)
        pair[: len(fps) - d] = run[:-d] == run[d:]
        alive = np.packbits(pair, bitorder="little").view(_U)
        at = np.nonzero(alive)[0]
        up, down = _U(d % 64), _U(-d % 64)

        def plane(bit, w, far=d // 64, up=up, down=down):
            p = planes[bit]
            return p[w] ^ (p[w + far] >> up | (p[w + far + 1] << down if up else _U(0)))

        (at,), left = sliced(plane, [at], ~alive[at], radius)
        k, j = _flagged(left)
        out_i.append(at[k] * 64 + j)
        out_d.append(np.full(len(k), d))
    i = np.concatenate(out_i)
    return i, i + np.concatenate(out_d)


def over(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the bit-sliced counters exceed ``radius``."""
    more, same = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for c in range(len(count) - 1, -1, -1):
        if radius >> c & 1:
            same &= count[c]
        else:
            more |= same & count[c]
            same &= ~count[c]
    return more


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the links make a spanning forest."""
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    keep = np.zeros(len(i), bool)
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
        x, y = root(x), root(y)
        if x != y:
            up[x] = y
            keep[k] = True
    return keep


def blocks_for(n: int) -> int:
    """How many blocks the bits are cut into, so that ``n`` random fingerprints leave about LOAD to a key."""
    return next((b for b in range(RADIUS + 1, RADIUS + 5) if n >> (b - RADIUS) * (64 // b) <= LOAD), RADIUS + 5)


def keys_of(fp: Column, blocks: int) -> Column:
    """The keys of a fingerprint: number of the choice in the high bits, then the bits of the chosen blocks."""
    ends = [64 * k // blocks for k in range(blocks + 1)]
    cuts = list(zip(ends, ends[1:]))
    keys = []
    for k, chosen in enumerate(combinations(cuts, blocks - RADIUS)):
        bits = F.lit(0).cast("long")
        for lo, hi in chosen:
            bits = F.shiftleft(bits, hi - lo).bitwiseOR(F.shiftrightunsigned(fp, lo).bitwiseAND((1 << hi - lo) - 1))
        keys.append(bits.bitwiseOR(F.lit(k << 48).cast("long")))
    return F.array(*keys)


#: Runs up to this length share planes, many at once; longer ones have planes of their own.  Rows that are compared together, at least.
SHARED, HELD_ROWS = 256, 1 << 18


@tidy
def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of (key, i, j) in sorted order; side 0 holds block i, side 1 block j (all is side 0 where i = j)."""
    names = ["key", "i", "j", "side", "fp"]

    def solve(g: dict[str, np.ndarray]):
        n = len(g["fp"])
        if n == 0:
            return
        fp = g["fp"].view(_U)
        new = np.ones(n, bool)
        new[1:] = (g["key"][1:] != g["key"][:-1]) | (g["i"][1:] != g["i"][:-1]) | (g["j"][1:] != g["j"][:-1])
        starts = np.nonzero(new)[0]
        size = np.diff(np.append(starts, n))
        shared = (size > 1) & (size <= SHARED) & (g["i"][starts] == g["j"][starts])
        at = np.nonzero(np.repeat(shared, size))[0]
        i, j = pairs_in_runs(fp[at], np.repeat(np.arange(len(starts)), size)[at])
        ui, vi = [at[i]], [at[j]]
        own = ~shared & (size > 1)
        for s, e in zip(starts[own].tolist(), (starts + size)[own].tolist()):
            if g["i"][s] == g["j"][s]:
                i, j = near_pairs(fp[s:e], None)
                i, j = i + s, j + s
            else:
                m = s + int(np.searchsorted(g["side"][s:e], 1))
                i, j = near_pairs(fp[s:m], fp[m:e]) if s < m < e else (np.zeros(0, np.int64),) * 2
                i, j = i + s, j + m
            ui.append(i)
            vi.append(j)
        u, v = np.concatenate(ui), np.concatenate(vi)
        keep = forest(n, u, v)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(g["fp"][u[keep]]), pa.array(g["fp"][v[keep]])], ["u", "v"])

    parts: list[dict[str, np.ndarray]] = []
    held = 0

    def whole(last: bool):
        nonlocal parts, held
        g = {k: np.concatenate([p[k] for p in parts]) for k in names}
        # the last group may go on in the next batch; it has at most two blocks
        n = len(g["fp"])
        cut = n if last else n - int(((g["key"] == g["key"][-1]) & (g["i"] == g["i"][-1]) & (g["j"] == g["j"][-1])).sum())
        yield from solve({k: x[:cut] for k, x in g.items()})
        parts, held = [{k: x[cut:] for k, x in g.items()}], n - cut

    for b in batches:
        parts.append({k: b.column(c).to_numpy(zero_copy_only=False) for c, k in enumerate(names)})
        held += b.num_rows
        if held >= HELD_ROWS:
            yield from whole(False)
    if held:
        yield from whole(True)


def link(fps: DataFrame, block: int = BLOCK, blocks: int | None = None) -> DataFrame:
    """A spanning set of links (u, v) between distinct fingerprints (column fp) at most RADIUS bits apart."""
    fps = fps.select("fp").distinct()
    blocks = blocks_for(fps.count()) if blocks is None else blocks
    keyed = fps.select("fp", F.explode(keys_of(F.col("fp"), blocks)).alias("key"))
    # keys with more than a block: few, as each takes over ``block`` rows; Spark broadcasts them only if small
    hot = keyed.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    spread = keyed.join(hot, "key", "left").withColumn("own", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).otherwise(0))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1))
    groups = spread.select("key", "fp", "own", other.alias("other")).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "fp"
    )
    return groups.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side").mapInArrow(_links, "u long, v long")


def components_of(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Of every fingerprint in ``rows``: hits (its rows), root, component_id, and k1 and k2 of the one row to keep of its component.

    All but the joins to the root fold before they move, and these spread a giant component.
    """
    one = F.struct("doc_id", "k1", "k2")
    each = rows.groupBy("fp").agg(F.count("*").alias("hits"), F.min(F.when(F.col("doc_id").isNotNull(), one)).alias("least"), F.min(one).alias("any"))
    roots = components(link(rows, block)).select(F.col("id").alias("fp"), "root")
    each = write_shared(each.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-classes")
    keep = F.coalesce(F.min("least"), F.min("any"))
    reps = each.groupBy("root").agg(F.count("*").alias("hits"), F.min("least")["doc_id"].alias("component_id"), keep["k1"].alias("k1"), keep["k2"].alias("k2"))
    return salted(each.select("fp", F.col("hits").alias("copies"), "root"), reps, "root", "fp").withColumnRenamed("copies", "hits")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id linked, directly or through others).

    Null text has no words: fingerprint zero, linked like any other.  Rows with a null id
    are returned and link others, but name no component; one of nothing else has a null
    component_id.  Repeated rows are returned each; other columns are ignored.
    """
    rows = write_shared(fingerprints(docs), "fingerprints")
    found = write_shared(components_of(rows, block).select("fp", "hits", "component_id"), "simhash-components")
    return salted(rows, found, "fp", "k1").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each component, that of the least id.

    Rows are told apart by id and whole text (128 bits), so rows that share an id, or have
    none, stay if they are no near-duplicates; of rows equal in both one stays.
    """
    rows = write_shared(fingerprints(docs), "fingerprints")
    keep = components_of(rows, block).select(F.col("k1").alias("__cf_k1"), F.col("k2").alias("__cf_k2")).distinct()
    k1, k2 = row_key()
    kept = docs.withColumns({"__cf_k1": k1, "__cf_k2": k2}).join(keep, ["__cf_k1", "__cf_k2"], "left_semi")
    return kept.dropDuplicates(["__cf_k1", "__cf_k2"]).select(*(F.col(f"`{c}`") for c in docs.columns))

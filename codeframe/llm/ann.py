"""Approximate nearest neighbours by additive quantisation.

A vector's direction is a sum of one full-dimensional codeword from each of BOOKS codebooks,
fitted to residuals one after the other on a bounded sample and refined together
by least squares.  Encoding is a beam search; the factor that makes the sum as long as
the vector (its stored norm) is beside the codes, and a bound on what these miss.  A query scores codes by table look-up;
in every block of candidates those whose score and bound cannot reach the k-th best
are left out, and all others are ranked by exact inner products in double precision.
No list has a fixed length, so nothing near is lost at any size of the table.

Queries and candidates meet in pairs of blocks, a stated query set against all
rows; no pair of rows leaves a task but each block's best k.  As long as the queries are
one block, every coded row moves once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeframe.llm._common import tidy, write_shared

BOOKS, WORDS, BEAM = 8, 256, 8
#: Rows that the codebooks are fitted on, at most: the least by a hash of their id.
TRAIN_ROWS = 8_000
#: Queries of one task; its candidates stream by, as many as make TASKS tasks, between these bounds; so many are compared at once.
BLOCK_QUERIES, LEAST_ROWS, MOST_ROWS, TASKS, STEP_ROWS = 65_536, 2_048, 1 << 22, 16, 8_192


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, d): distinct rows that take part, with their number of components.

    Null ids, null or zero vectors, and null or non-finite components do not.  Components
    stay as they are (those that are neither float nor double become double).
    """
    v = F.col("embedding")
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast(f"array<{kind if kind == 'float' else 'double'}>").alias("embedding"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & ~zero)
    return rows.select("vec_id", F.col("embedding").alias("v"), F.size("embedding").alias("d")).distinct()


def _matrix(col, d: int) -> np.ndarray:
    """Rows of components as doubles."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths that neither overflow nor vanish on the way."""
    most = np.abs(x).max(1, initial=0)
    most = np.where(most > 0, most, 1.0)
    return most * np.linalg.norm(x / most[:, None], axis=1)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and unit vectors in single precision."""
    most = np.abs(x).max(1, initial=0)
    most = np.where(most > 0, most, 1.0)
    y = x / most[:, None]
    size = np.linalg.norm(y, axis=1)
    return most * size, (y / np.maximum(size, 1e-300)[:, None]).astype(np.float32)


class Quantiser:
    """Codebooks as one (BOOKS, WORDS, d) array."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.flat = books.reshape(-1, books.shape[2])
        self.gram = self.flat @ self.flat.T

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (n, BOOKS): in each step the ``beam`` best partial sums go on."""
        return np.concatenate([self._encode(x[i : i + 1024], beam) for i in range(0, len(x), 1024)]) if len(x) else np.zeros((0, len(self.books)), np.uint8)

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        m, k, _ = self.books.shape
        n, dots, norms = len(x), x @ self.flat.T, np.diag(self.gram)
        cost, codes = np.zeros((n, 1), np.float32), np.zeros((n, 1, 0), np.int64)
        for b in range(m):
            own = slice(b * k, (b + 1) * k)
            cross = np.zeros((n, cost.shape[1], k), np.float32)
            for j in range(b):
                cross += self.gram[codes[:, :, j] + j * k, own]
            total = cost[:, :, None] + 2 * cross + (norms[own] - 2 * dots[:, own])[:, None, :]
            flat = total.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            at = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            cost = np.take_along_axis(flat, at, 1)
            codes = np.concatenate([np.take_along_axis(codes, (at // k)[:, :, None], 1), (at % k)[:, :, None]], 2)
        return codes[np.arange(n), cost.argmin(1)].astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[b][codes[:, b]] for b in range(len(self.books)))


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 3) -> Quantiser:
    """k-means on residuals, then two rounds of joint least squares; deterministic."""
    rng, rest = np.random.RandomState(seed), x.copy()
    out = np.zeros((books, words, x.shape[1]), np.float32)
    for b in range(books):
        c = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(rounds):
            near = (np.square(c).sum(1) - 2 * rest @ c.T).argmin(1)
            n = np.bincount(near, minlength=words)
            sums = np.zeros_like(c)
            np.add.at(sums, near, rest)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], rest[rng.randint(0, len(rest), words)])
        out[b] = c
        rest = rest - c[(np.square(c).sum(1) - 2 * rest @ c.T).argmin(1)]
    q = Quantiser(out)
    for _ in range(2):
        codes = q.encode(x, 4).astype(np.int64) + np.arange(books) * words
        hot = np.zeros((len(x), books * words), np.float32)
        np.put_along_axis(hot, codes, 1, axis=1)
        left = hot.T @ hot + 0.1 * np.eye(books * words, dtype=np.float32)
        q = Quantiser(np.linalg.solve(left, hot.T @ x + 0.1 * q.flat).reshape(out.shape).astype(np.float32))
    return q


def _encode_rows(q: Quantiser, d: int):
    """Codes, stored norm and bound of rows of ``d`` components; rows of another length get none and are ranked exactly."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.nonzero(b.column(2).to_numpy() == d)[0]
            x = _matrix(b.column(1).take(pa.array(own)), d)
            length, unit = directions(x)
            codes = q.encode(unit)
            whole = q.decode(codes).astype(np.float64)
            # a score is (sum of look-ups) * norm * length of the query
            norm = length / np.maximum(np.linalg.norm(whole, axis=1), 1e-12)
            # it is off by at most |query| * far: what the codes miss, and the rounding of single precision
            words = np.linalg.norm(q.books, axis=2)[np.arange(len(q.books)), codes].sum(1, dtype=np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                far = lengths(x - norm[:, None] * whole) + (d + 16) * 2.4e-7 * (length + norm * words)
            raw: list[bytes | None] = [None] * b.num_rows
            norms, fars = np.zeros(b.num_rows), np.full(b.num_rows, np.inf)
            for i, c in zip(own.tolist(), codes):
                raw[i] = c.tobytes()
            norms[own], fars[own] = norm, far
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(raw, pa.binary()), pa.array(norms), pa.array(fars)], ["vec_id", "v", "d", "codes", "norm", "far"])

    return run


def _kth(s: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; minus infinity if there are not more than k."""
    n = s.shape[1]
    return np.partition(s, n - k, axis=1)[:, n - k] if n > k else np.full(len(s), -np.inf)


class Best:
    """The ``k`` nearest so far of a block of queries of ``d`` components, with exact scores."""

    def __init__(self, q: Quantiser, coded: int, k: int, ids: np.ndarray, x: np.ndarray):
        self.q, self.coded, self.k, self.ids, self.x = q, coded == x.shape[1], k, ids, x
        self.size, self.unit = directions(x)
        self.tables = self.unit @ q.flat.T if self.coded else None
        # rows found so far, in the order of queries, scores and ids
        self.of, self.vid, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.floor = np.full(len(ids), -np.inf)

    def see(self, vid: np.ndarray, y: np.ndarray, codes: list[bytes | None], norm: np.ndarray, far: np.ndarray) -> None:
        k, d, (m, w, _) = self.k, self.x.shape[1], self.q.books.shape
        longest = lengths(y).max()
        code = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, m) if self.coded else None
        found = [[self.of], [self.vid], [self.score]]
        step = max(1, (1 << 21) // len(vid))
        for i in range(0, len(self.ids), step):
            part, size, floor = self.x[i : i + step], self.size[i : i + step, None], self.floor[i : i + step, None]
            other = self.ids[i : i + step, None] != vid
            with np.errstate(over="ignore", invalid="ignore"):
                if code is not None:
                    tables = self.tables[i : i + step]
                    s = np.zeros((len(tables), len(vid)), np.float32)
                    for b in range(m):
                        s += tables[:, b * w : (b + 1) * w][:, code[:, b]]
                    s, reach = s * norm * size, size * far
                    low = s - reach
                    low[~other | ~np.isfinite(low)] = -np.inf
                    other &= ~(s + reach < np.maximum(_kth(low, k)[:, None], floor))
                cols = np.flatnonzero(other.any(0))
                if not len(cols):
                    continue
                dots = part @ y[cols].T
                sure = np.where(other[:, cols] & ~np.isnan(dots), dots, -np.inf)
                # products of matrices may round equal rows differently: near the k-th best, components are added in order
                least = np.maximum(_kth(sure, k)[:, None], floor) - d * 1e-15 * longest * size
                a, c = np.nonzero(other[:, cols] & ~(dots < least))
                c = cols[c]
                score = np.zeros(len(a))
                for j in range(d):
                    score += part[a, j] * y[c, j]
            for old, new in zip(found, (a + i, vid[c], score)):
                old.append(new)
        of, ids, score = (np.concatenate(x) for x in found)
        order = np.lexsort((ids, -score, of))
        of, ids, score = of[order], ids[order], score[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        self.of, self.vid, self.score = (x[place < k] for x in (of, ids, score))
        last = np.nonzero(place == k - 1)[0]
        self.floor[of[last]] = np.where(np.isnan(score[last]), -np.inf, score[last])


def _nearest(q: Quantiser, coded: int, k: int):
    """Rows in order of (d, qb, cb, side): the queries of a block (side 0), then its candidates, which stream by."""
    names = ["query_id", "vec_id", "score"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, held, best = None, [], [], None

        def look():
            """Compare what is held with the block's queries."""
            nonlocal best, asked, held
            if held and asked and best is None:
                t = pa.Table.from_batches(asked)
                best, asked = Best(q, coded, k, t["vec_id"].to_numpy(), _matrix(t["v"].combine_chunks(), now[0])), [1]
            if held and best is not None:
                t = pa.Table.from_batches(held)
                best.see(t["vec_id"].to_numpy(), _matrix(t["v"].combine_chunks(), now[0]), t["codes"].to_pylist(), t["norm"].to_numpy(), t["far"].to_numpy())
            held = []

        def done():
            nonlocal best, asked
            look()
            if best is not None and len(best.of):
                yield pa.RecordBatch.from_arrays([pa.array(best.ids[best.of]), pa.array(best.vid), pa.array(best.score)], names)
            best, asked = None, []

        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("d", "qb", "cb", "side")])
            cuts = [0, *(np.nonzero((key[:, 1:] != key[:, :-1]).any(0))[0] + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                group = tuple(key[:3, i].tolist())
                if group != now:
                    if now is not None:
                        yield from done()
                    now = group
                (held if key[3, i] else asked).append(b.slice(i, j - i))
                if sum(x.num_rows for x in held) >= STEP_ROWS:
                    look()
        if now is not None:
            yield from done()

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of every query among all usable rows but its own id.

    ``queries`` are rows of ``usable(...)``; score is the exact inner product of the
    original vectors in double precision, ties go to the smaller vec_id.  A query's
    candidates are the rows with as many components as it has: codes are for the commonest
    number, other rows are ranked without.  With fewer candidates than ``k`` all are
    returned; without queries or rows the result is empty.  Rows of the query's own id are
    never its candidates; equal rows count once.  A product that is no number comes last.
    """
    rows = vectors
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    common = rows.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], schema)
    d = common.d
    # a bounded sample, by hash, so that it does not depend on partitions
    sample = rows.where(F.col("d") == d).orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRAIN_ROWS).toArrow()
    x = directions(_matrix(sample["v"].combine_chunks(), d))[1]
    q = fit(x, words=WORDS if len(x) >= WORDS else max(1, len(x)))
    # of equal vectors the k + 1 smallest ids (one may be the query's own) can be among the k nearest, the others never
    copies = rows.withColumn("copy", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("copy") <= k + 1).drop("copy")
    coded = write_shared(copies.mapInArrow(_encode_rows(q, d), f"vec_id long, v {rows.schema['v'].dataType.simpleString()}, d int, codes binary, norm double, far double"), "ann-coded")
    n, nq = coded.groupBy("d").agg(F.count("*").alias("n")), queries.groupBy("d").agg(F.count("*").alias("nq"))
    qbs = F.ceil(F.col("nq") / BLOCK_QUERIES).cast("int")
    size = F.least(F.lit(MOST_ROWS), F.greatest(F.lit(LEAST_ROWS), F.ceil(F.col("n") * F.col("qbs") / TASKS)))
    # one row for each number of components that occurs among the queries
    blocks = n.join(nq, "d").withColumn("qbs", qbs).withColumn("cbs", F.ceil(F.col("n") / size).cast("int")).select(F.col("d").alias("of"), "qbs", "cbs")
    tasks = min(100_000, blocks.agg(F.sum(F.col("qbs") * F.col("cbs"))).first()[0] or 1)
    own = lambda count, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(count)).cast("int")
    each = lambda count, name: F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias(name)
    on, row = F.col("d") == F.col("of"), ["vec_id", "v", "d"]
    codes = [F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("norm"), F.lit(0.0).alias("far")]
    asks = queries.join(blocks, on).select(*row, *codes, own("qbs", 1).alias("qb"), "cbs", F.lit(0).alias("side"), each("cbs", "cb"))
    cands = coded.join(blocks, on).select(*row, "codes", "norm", "far", own("cbs", 2).alias("cb"), "cbs", F.lit(1).alias("side"), each("qbs", "qb"))
    both = asks.unionByName(cands)
    placed = both.repartitionById(tasks, F.pmod(F.col("qb") * F.col("cbs") + F.col("cb") + F.col("d"), F.lit(tasks)).cast("int")).sortWithinPartitions("d", "qb", "cb", "side")
    exact = placed.mapInArrow(_nearest(q, d, k), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc(F.nanvl("score", F.lit(float("-inf")))), "vec_id")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """``search`` with the rows whose vec_id is divisible by ``every`` as queries."""
    rows = write_shared(usable(vectors), "ann-usable")
    return search(rows, rows.where(F.col("vec_id") % every == 0), k)

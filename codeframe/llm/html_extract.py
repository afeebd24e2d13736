"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded as a hierarchy.

Every node of a page, elements and text, gets a probability that it holds main
text given that its parent does, from boosted trees over subtree density, hashed
attribute tokens, depth and sibling statistics.  Labels are then chosen together: a node
can hold main text only if its parent does, and among all such choices the likeliest is
found by one pass up and one down the tree, so an ancestor and a descendant never
contradict each other.

The trees are trained here on generated pages of known main text
(:mod:`codeframe.llm.html_train`) and kept as a small JSON file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeframe.llm._common import tidy
from codeframe.llm.html_tree import SKIP, TOKEN_BINS, Page, blocks, features

#: Pages are read and scored together up to so many characters of html.
PAGES_BYTES = 1 << 19
MODEL = Path(__file__).with_name("html_model.json")


class Trees:
    """Boosted regression trees of one depth in arrays: scores add up to log odds.  ``weights``: of hashed tokens."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, base: float, weights: np.ndarray):
        self.feature, self.cut, self.leaf, self.base, self.weights = feature, cut, leaf, base, weights
        self.depth = int(np.log2(leaf.shape[1]))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        flat, wide = np.ascontiguousarray(x).ravel(), rows * x.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            at = (x[:, f[0]] > c[0]) + 1
            for _ in range(self.depth - 1):
                at = 2 * at + 1 + (flat[wide + f[at]] > c[at])
            out += v[at - len(f)]
        return out

    def dump(self) -> str:
        return json.dumps({"base": round(self.base, 6), "feature": self.feature.tolist(), "cut": [[float(f"{c:.6g}") for c in t] for t in self.cut], "leaf": [[float(f"{c:.5g}") for c in t] for t in self.leaf], "tokens": {str(i): round(float(w), 3) for i, w in enumerate(self.weights) if w}})

    @staticmethod
    def load(text: str) -> Trees:
        d = json.loads(text)
        weights = np.zeros(TOKEN_BINS, np.float32)
        weights[[int(k) for k in d["tokens"]]] = list(d["tokens"].values())
        return Trees(np.array(d["feature"]), np.array(d["cut"], np.float32), np.array(d["leaf"]), d["base"], weights)


@lru_cache(maxsize=2)
def model(path: str = str(MODEL)) -> Trees:
    return Trees.load(Path(path).read_text())


def decode(parent: list[int], odds: np.ndarray, never: np.ndarray) -> list[bool]:
    """The likeliest labels under: a node is main only if its parent is; ``never`` nodes are not main.

    ``odds`` are of a node whose parent is main; below a node that is not, nothing is left to decide.
    """
    n = len(parent)
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    best = np.where(never, -1e9, yes).tolist()  # a main node with the best below it
    out = no.tolist()
    for i in range(n - 1, 0, -1):
        best[parent[i]] += best[i] if best[i] > out[i] else out[i]
    main = [False] * n
    main[0] = best[0] > out[0]
    for i in range(1, n):
        main[i] = main[parent[i]] and best[i] > out[i]
    return main


def extract(sources: list[str | None], trees: Trees, cache: dict) -> list[str]:
    """Main text of each page; blocks are joined by two line ends."""
    pages = [Page(x) if x and x.strip() else None for x in sources]
    real = [p for p in pages if p is not None]
    if not real:
        return [""] * len(pages)
    odds = trees.log_odds(features(real, cache, trees.weights))
    out, at = [], 0
    for p in pages:
        if p is None:
            out.append("")
            continue
        n = len(p.tag)
        keep = decode(p.parent, odds[at : at + n], np.array([t in SKIP for t in p.tag]))
        out.append("\n\n".join(blocks(p, keep)))
        at += n
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, from its whole html.

    Null or empty html, and pages without main text, give an empty text.  Null ids and
    urls stay null, repeated rows are extracted each, other columns are ignored.  Broken
    markup, however long or deep, is read in time proportional to its length: a stray quote
    does not keep a tag open, elements nested over 512 deep lie side by side.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, cache = model(), {}
        for b in batches:
            text, held, size = [], [], 0
            for h in b.column(2):
                held.append(h.as_py())
                size += len(held[-1] or "")
                if size > PAGES_BYTES:
                    text += extract(held, trees, cache)
                    held, size = [], 0
            text += extract(held, trees, cache)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))

"""A forgiving HTML reader: a tree of elements and text in flat arrays, and features of every node."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter

import numpy as np

#: A well-formed tag; anything else is read by ``_odd_tag``.  Nothing is tried twice, so a page takes time in proportion to its length.
_TAG_AT = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*+)((?>[^<>"'=]++|=(?:\s*+(?:"[^"<>]*+"|'[^'<>]*+'))?)*+)>""")
_BEGIN = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"</?[a-zA-Z][^\s/>]*+")
_SPACE, _KEY, _EQUALS, _BARE = re.compile(r"[\s/]*+"), re.compile(r"[^>][^\s/>=]*+"), re.compile(r"\s*+=\s*+"), re.compile(r"[^\s>]*+")
_ATTR = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp", "noframes", "object", "canvas", "select", "button"}
#: Elements whose inside is never text of the page.
SKIP = {"script", "style", "template", "iframe", "svg", "math", "noframes", "head", "title", "noscript", "object", "canvas", "select", "button", "textarea", "option"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
    "th", "thead", "tr", "ul", "head", "title",
}
#: What an opening tag closes, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set()),
}
CLOSES_P = BLOCK - {"body", "html", "head", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"} | {"li", "dd", "dt"}
_SCOPE = {"button", "table", "td", "th", "caption", "object", "html", "body"}
#: Raw elements that swallow the page if they are never closed; others are then taken as empty.
_SWALLOW = {"script", "style", "textarea", "title", "iframe", "xmp", "noframes"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
#: Elements open at once; deeper ones count as children of the deepest.
DEPTH = 512


def _odd_tag(source: str, at: int) -> tuple[str, int] | None:
    """Attributes of a tag that is not well formed, from behind its name, and where it ends; None: it never does.

    A quoted value goes to the next quote of its kind.  Where there is none, or where the value
    would hold the end of a tag and run straight into more text, the quote is stray: the tag ends
    at the first >.
    """
    n, out = len(source), []
    while True:
        at = _SPACE.match(source, at).end()
        if at >= n:
            return None
        if source[at] == ">":
            return " ".join(out), at + 1
        key = _KEY.match(source, at)
        at, value = key.end(), ""
        equals = _EQUALS.match(source, at)
        if equals:
            at = equals.end()
            if at >= n:
                return None
            mark = source[at]
            if mark in "\"'":
                to = source.find(mark, at + 1)
                close = source.find(">", at + 1, to if to >= 0 else n)
                if to < 0 and close < 0:
                    return None
                if close >= 0 and (to < 0 or source[to + 1 : to + 2] not in ("", ">", "/") and not source[to + 1].isspace()):
                    return " ".join(out), close + 1
                value, at = source[at + 1 : to], to + 1
            else:
                bare = _BARE.match(source, at)
                value, at = bare[0], bare.end()
        out.append(key[0] + '="' + value.replace('"', " ") + '"')


class Page:
    """Nodes in page order: parent, depth, tag ('' for text), attribute string, text."""

    __slots__ = ("parent", "depth", "tag", "attr", "text", "end")

    def __init__(self, source: str):
        self.parent, self.depth, self.tag, self.attr, self.text, self.end = [-1], [0], ["#root"], [""], [""], [0]
        stack, at, n = [0], 0, len(source)
        is_open: Counter[str] = Counter()
        unclosed: set[str] = set()

        def add(tag: str, attr: str, text: str) -> int:
            self.parent.append(stack[-1])
            self.depth.append(len(stack))
            self.tag.append(tag)
            self.attr.append(attr)
            self.text.append(text)
            self.end.append(0)
            return len(self.tag) - 1

        def close(upto: int) -> None:
            while len(stack) > upto:
                k = stack.pop()
                self.end[k] = len(self.tag)
                is_open[self.tag[k]] -= 1

        def put(text: str) -> None:
            if text and not text.isspace():
                add("", "", html.unescape(text) if "&" in text else text)
            elif text:
                add("", "", " ")

        def end_tag(tag: str) -> None:
            if not is_open[tag]:
                return
            for k in range(len(stack) - 1, 0, -1):
                open_ = self.tag[stack[k]]
                if open_ == tag:
                    close(k)
                    return
                if tag not in BLOCK and open_ in BLOCK or tag == "p" and open_ in _SCOPE:
                    return  # an inline end tag does not close a block

        while at < n:
            begin = _BEGIN.search(source, at)
            if begin is None:
                put(source[at:])
                break
            m = begin.start()
            after = source[m + 1]
            if after in ("!", "?") or after == "/" and not source[m + 2 : m + 3].isalpha():
                put(source[at:m])
                if source.startswith("<!--", m):
                    stop, size = source.find("-->", m + 4), 3
                elif source.startswith("<![CDATA[", m):
                    stop, size = source.find("]]>", m + 9), 3
                else:
                    stop, size = source.find(">", m), 1
                at = n if stop < 0 else stop + size
                continue
            found = _TAG_AT.match(source, m)
            name = None if found else _NAME.match(source, m)
            put(source[at:m])
            if found:
                shut, tag, attr, at = bool(found[1]), found[2].lower(), found[3], found.end()
            else:
                odd = _odd_tag(source, name.end())
                if odd is None:
                    break  # a tag that never ends
                shut, tag, (attr, at) = name[0][1] == "/", name[0].lstrip("</").lower(), odd
            if shut:
                end_tag(tag)
                continue
            if tag in CLOSES:
                these, stop_at = CLOSES[tag]
                if any(is_open[t] for t in these):
                    for k in range(len(stack) - 1, 0, -1):
                        open_ = self.tag[stack[k]]
                        if open_ in stop_at:
                            break
                        if open_ in these:
                            close(k)
            if tag in CLOSES_P and is_open["p"]:
                for k in range(len(stack) - 1, 0, -1):
                    open_ = self.tag[stack[k]]
                    if open_ == "p":
                        close(k)
                        break
                    if open_ in _SCOPE or open_ in BLOCK:
                        break
            if tag in ("html", "body") and is_open[tag]:
                continue
            node = add(tag, attr, "")
            if tag in VOID or attr.endswith("/") and tag not in BLOCK:
                self.end[node] = node + 1
                continue
            if tag in RAW and tag not in ("noscript", "select", "button", "object"):
                stop = None if tag in unclosed else _RAW_END[tag].search(source, at)
                if stop is None:
                    unclosed.add(tag)
                if stop is None and tag not in _SWALLOW:
                    self.end[node] = node + 1
                    continue
                if tag in ("textarea", "title"):
                    stack.append(node)
                    put(source[at : stop.start() if stop else n])
                    stack.pop()
                self.end[node] = len(self.tag)
                at = source.find(">", stop.end()) + 1 if stop else n
                at = at or n
                continue
            if len(stack) <= DEPTH:
                stack.append(node)
                is_open[tag] += 1
            else:
                self.end[node] = node + 1
        close(0)

    def attributes(self, node: int) -> dict[str, str]:
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(self.attr[node])}


#: Bins of hashed attribute tokens and of hashed first words, each with a weight that training gives it.
TOKEN_BINS = 1 << 12
_SPLIT = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])|\d+")
_WORD = re.compile(r"\w+")
ATTRIBUTES = ("class", "id", "role", "aria-label", "itemprop", "itemtype", "rel", "data-component", "data-testid", "name")
TAGS = [
    ("article",), ("main",), ("section",), ("div", "center"), ("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "menu", "dl"), ("li", "dt", "dd"), ("nav",), ("header", "hgroup"), ("footer",),
    ("aside",), ("form", "fieldset"), ("table", "tbody", "thead", "tr"), ("td", "th"), ("blockquote", "q"), ("pre", "code"), ("figure", "figcaption"), ("a",), ("body",), ("",), ("label", "input", "legend"),
]
_TAG = {t: i for i, ts in enumerate(TAGS) for t in ts}
_STOP = re.compile(r"[.!?,;:](?=\s|$)")
INLINE_PLAIN = {"b", "i", "em", "strong", "span", "u", "small", "sub", "sup", "code", "abbr", "mark", "cite", "time", "font"}


def tokens_of(page: Page, node: int, cache: dict[str, tuple[int, ...]]) -> tuple[int, ...]:
    """Bins of the tokens of an element's naming attributes."""
    raw = page.attr[node]
    if not raw or raw.isspace():
        return ()
    got = cache.get(raw)
    if got is None:
        a = page.attributes(node)
        got = tuple({zlib.crc32(w.lower().encode()) % TOKEN_BINS for k in ATTRIBUTES for w in _SPLIT.findall(a.get(k, "")) if len(w) > 1})
        if len(cache) < 50_000:
            cache[raw] = got
    return got


def lead_of(text: str) -> tuple[int, ...]:
    """Bins of the first three words of a text of a few words, as headings have."""
    words = _WORD.findall(text[:60].lower())
    return tuple({zlib.crc32(b"lead:" + w.encode("utf-8", "replace")) % TOKEN_BINS for w in words[:3]}) if len(text) <= 60 else ()


def _ends(bins: list[tuple[int, ...]], weights: np.ndarray) -> np.ndarray:
    """The least and the greatest weight of each node's bins; zeros without any."""
    out = np.zeros((len(bins), 2), np.float32)
    some = [i for i, x in enumerate(bins) if x]
    if some:
        flat = weights[np.concatenate([np.array(bins[i]) for i in some])]
        at = np.cumsum([0, *(len(bins[i]) for i in some[:-1])])
        out[some, 0], out[some, 1] = np.minimum.reduceat(flat, at), np.maximum.reduceat(flat, at)
    return out


def features(pages: list[Page], cache: dict[str, tuple[int, ...]], weights: np.ndarray) -> np.ndarray:
    """A row per node of all pages: subtree density, hashed attribute tokens and first words (own, parent's, any ancestor's), depth and siblings."""
    sizes = np.array([len(p.tag) for p in pages])
    root = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n, at_root = int(sizes.sum()), np.repeat(root, sizes)
    tags = [t for p in pages for t in p.tag]
    texts = ["" if t.isspace() else t for p in pages for t in p.text]
    parent = np.concatenate([p.parent for p in pages]) + at_root
    parent[root] = root
    depth = np.concatenate([p.depth for p in pages])
    end = np.concatenate([p.end for p in pages])
    end = np.where(end == 0, np.arange(n) + 1, end + at_root)
    tag = np.array([_TAG.get(t, len(TAGS)) for t in tags])
    chars = np.array([len(t) for t in texts], np.float64)
    words = np.array([t.count(" ") + 1 if t else 0 for t in texts], np.float64)
    stops = np.array([len(_STOP.findall(t)) if t else 0 for t in texts], np.float64)
    # weights of attribute tokens, and of the first words below a node: its own text, or the first text of a child that is a heading or leaf
    named = _ends([tokens_of(p, i, cache) for p in pages for i in range(len(p.tag))], weights)
    lead = _ends([lead_of(t) if t else () for t in texts], weights)
    first = np.nonzero(np.array([bool(t) for t in texts]))[0]
    at_first = np.append(first, n)[np.searchsorted(first, np.arange(n))]
    below = at_first < end
    lead = np.where(below[:, None], np.vstack([lead, np.zeros((1, 2), np.float32)])[at_first], 0).astype(np.float32)
    attrs = np.concatenate([named, lead], 1)
    kinds = np.zeros((n, len(TAGS) + 1), np.float32)
    kinds[np.arange(n), tag] = 1
    kinds = kinds[:, :-1]
    above, above_tag = attrs * np.array([-1, 1, -1, 1], np.float32), kinds.copy()
    skip, link = np.array([t in SKIP for t in tags]), np.array([t == "a" for t in tags])
    order = np.argsort(depth, kind="stable")
    level = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    for d in range(1, len(level) - 1):  # from parents to children, a level of all pages at a time
        here = order[level[d] : level[d + 1]]
        up = parent[here]
        above[here] = np.maximum(above[here], above[up])
        above_tag[here] = np.maximum(above_tag[here], above_tag[up])
        skip[here] |= skip[up]
        link[here] |= link[up]
    chars, words, stops = (np.where(skip, 0, x) for x in (chars, words, stops))
    flag = lambda names: np.array([t in names for t in tags], np.float64)

    def sub(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(x)])
        return sums[end] - sums[:-1]

    c, w, s, linked, t = sub(chars), sub(words), sub(stops), sub(np.where(link, chars, 0)), sub(np.array([g != "" for g in tags], np.float64))
    total = np.maximum(c[root], 1.0)[np.repeat(np.arange(len(pages)), sizes)]
    is_root = np.arange(n) == at_root
    # siblings: position among the children of the parent, and how many share the tag
    by_parent = np.argsort(np.where(is_root, n, parent), kind="stable")
    first = np.searchsorted(np.where(is_root, n, parent)[by_parent], np.where(is_root, n, parent))
    index = np.empty(n)
    index[by_parent] = np.arange(n)
    index = np.where(is_root, 0, index - first)
    sib = np.bincount(np.where(is_root, n, parent), minlength=n + 1)[parent].astype(np.float64)
    sib[root] = 1
    numbers: dict[str, int] = {}
    code = np.array([numbers.setdefault(g, len(numbers)) for g in tags])
    _, which, alike = np.unique(parent * np.int64(len(numbers)) + code + is_root * np.int64(n * len(numbers)), return_inverse=True, return_counts=True)
    same = np.where(is_root, 0, alike[which])
    # what the siblings of one tag have together
    of_same = lambda x: np.bincount(which, weights=x)[which]
    same_chars, same_words = of_same(c), np.maximum(of_same(w), 1)
    same_stops, same_linked = of_same(s) / same_words, of_same(linked) / np.maximum(same_chars, 1)
    before = np.concatenate([[0.0], np.cumsum(chars)])[:n]
    before = before - before[at_root]
    per_tag, share = c / np.maximum(t, 1), linked / np.maximum(c, 1)
    dens = np.stack(
        [
            np.log1p(c), np.log1p(w), c / total, share, np.log1p(per_tag), s / np.maximum(w, 1), c / np.maximum(w, 1), np.log1p(t),
            sub(flag({"p", "br"})), sub(flag({"li"})), sub(flag({"a"})), sub(flag({"input", "select", "textarea", "button", "label", "form"})),
            depth, np.log1p(same_chars), same_stops, same_linked, np.log1p(sib), index / np.maximum(sib - 1, 1), same, c / np.maximum(c[parent], 1), before / total, np.log1p(c[parent]), share[parent], np.log1p(per_tag[parent]), (s / np.maximum(w, 1))[parent], chars,
        ],
        1,
    ).astype(np.float32)
    return np.concatenate([dens, kinds, kinds[parent], above_tag, attrs, attrs[parent], above], 1)


def blocks(page: Page, keep: np.ndarray) -> list[str]:
    """Kept text in page order, cut at block elements, white space made single."""
    out: list[str] = []
    now: list[str] = []

    def flush():
        t = " ".join("".join(now).split())
        if t:
            out.append(t)
        now.clear()

    # a block element cuts before it begins and after it ends
    ends: list[int] = []
    for i in range(1, len(page.tag)):
        while ends and ends[-1] <= i:
            ends.pop()
            flush()
        g = page.tag[i]
        if g == "":
            if keep[i]:
                now.append(page.text[i])
        elif g in BLOCK:
            flush()
            if page.end[i] > i + 1:
                ends.append(page.end[i])
        elif g in ("br", "wbr", "img"):
            now.append(" " if g == "br" else "")
    flush()
    return out

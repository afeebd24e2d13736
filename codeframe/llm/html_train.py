"""Training of the page model: ``python -m codeframe.llm.html_train`` writes html_model.json.

Pages are generated from many layouts with known main text, which a ``data-main``
attribute marks for the trainer and the features never see.
"""

from __future__ import annotations

import random
import re

import numpy as np

from codeframe.llm.html_extract import MODEL, Trees, decode
from codeframe.llm.html_tree import SKIP, TOKEN_BINS, Page, features, lead_of, tokens_of

#: Names that sites give to the parts of a page.
NAMES = {
    "main": "article content main post entry story text page prose markdown richtext blog single detail document body news reading".split(),
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs pagination pager toc tabs topnav links skip".split(),
    "edge": "header footer masthead banner topbar toolbar bottom colophon copyright legal site".split(),
    "side": "sidebar aside widget related recommended popular trending more recent rail complementary also teaser".split(),
    "ad": "ad ads advert advertisement advertising sponsor sponsored promo promotion adsense dfp taboola partner".split(),
    "notice": "cookie cookies consent gdpr notice alert notification popup modal overlay dialog toast privacy".split(),
    "form": "form search login signup subscribe newsletter contact register".split(),
    "talk": "comment comments reply replies discussion disqus respond thread feedback responses kommentare".split(),
    "share": "share sharing social follow like tweet tags meta byline".split(),
}
HEADS = {
    "talk": ["Comments", "Leave a Reply", "Discussion", "Responses", "Reader comments", "Join the conversation", "Kommentare", "Kommentar schreiben", "Leserkommentare", "Commentaires", "Laisser un commentaire", "Réactions", "Comentarios", "Deja un comentario", "Opiniones"],
    "side": ["Related", "Related articles", "More stories", "Read more", "Popular", "Most read", "You may also like", "Latest news", "Mehr zum Thema", "Meistgelesen", "Ähnliche Artikel", "Articles liés", "À lire aussi", "Les plus lus", "Artículos relacionados", "Lo más leído", "Archives", "Categories", "Tags"],
    "form": ["Newsletter", "Subscribe", "Sign up", "Stay informed", "Search", "Anmelden", "Abonnieren", "Suche", "S'abonner", "Inscription", "Suscríbete", "Boletín"],
    "ad": ["Advertisement", "Sponsored", "Anzeige", "Publicité", "Publicidad", "Promoted"],
    "notice": ["We use cookies", "Your privacy", "Wir verwenden Cookies", "Nous utilisons des cookies", "Usamos cookies", "Cookie settings"],
    "edge": ["About us", "Contact", "Imprint", "Impressum", "Datenschutz", "Mentions légales", "Aviso legal", "All rights reserved"],
}
_VOWELS, _CONS = "aeiouéü", "bcdfghlmnprstvw"


class Maker:
    """One page after another; what is inside ``main`` marks is main text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.words = ["".join(self.r.choice(_CONS) + self.r.choice(_VOWELS) for _ in range(self.r.choice((1, 1, 2, 2, 3)))) for _ in range(800)]

    def say(self, lo: int, hi: int) -> str:
        n = self.r.randint(lo, hi)
        out, fresh = [], True
        for _ in range(n):
            w = self.r.choice(self.words)
            out.append(w.capitalize() if fresh else w)
            fresh = self.r.random() < 0.1
            if fresh:
                out[-1] += self.r.choice(("." * 5 + ",,?!")[:9]) if self.r.random() < 0.9 else ""
        t = " ".join(out)
        return t + "." if self.r.random() < 0.8 else t

    def inline(self, lo: int, hi: int) -> str:
        t = self.say(lo, hi)
        if self.r.random() < 0.25:
            w = t.split(" ")
            i = self.r.randrange(len(w))
            g = self.r.choice(("b", "em", "a href='/x'", "strong", "i", "span", "code"))
            w[i] = f"<{g}>{w[i]}</{g.split(' ')[0]}>"
            t = " ".join(w)
        return t.replace(" ", self.r.choice((" ", " ", " ", "\n", "&nbsp;")), 1)

    def opaque(self) -> str:
        """A class name that says nothing."""
        r = self.r
        return r.choice(("css-", "sc-", "x", "jsx-", "_", "e", "block-")) + "".join(r.choice("0123456789abcdefghkmnpqrstuvwxz") for _ in range(r.randint(2, 7)))

    def element(self, kind: str) -> str:
        """Some names of a kind of element, or none, or opaque ones, now and then with a word of another kind."""
        r, x = self.r, self.r.random()
        if x < 0.2:
            return ""
        if x < 0.4:
            return f' class="{self.opaque()}"'
        words = [r.choice(NAMES[kind]) for _ in range(r.choice((1, 1, 1, 2)))]
        if r.random() < 0.35:
            words.insert(r.randint(0, len(words)), r.choice(NAMES[r.choice(list(NAMES))]))
        name = r.choice(("-", "-", "_", "__", " ")).join(words)
        if r.random() < 0.3:
            name += r.choice(("-wrap", "-box", "__inner", " row", "-1", " clearfix", "-container", " " + self.opaque()))
        if r.random() < 0.15:
            name = "".join(w.capitalize() for w in re.split("[-_ ]+", name))
        return f' {r.choice(("class", "class", "class", "id", "data-component", "aria-label", "data-testid"))}="{name}"'

    def headed(self, kind: str, level: str = "") -> str:
        """A heading that says what follows, in one of several languages, or one of no meaning."""
        r = self.r
        t = r.choice(HEADS[kind]) if r.random() < 0.7 else self.say(1, 4)
        if r.random() < 0.2:
            t = f"{r.randint(0, 400)} {t}" if r.random() < 0.5 else f"{t} ({r.randint(0, 99)})"
        g = level or r.choice(("h2", "h3", "h3", "h4", "div", "strong", "p"))
        return f"<{g}>{t}</{g}>"

    def cls(self, *names: str) -> str:
        x = self.r.random()
        if x < 0.25:
            return ""
        name = self.r.choice(names)
        if self.r.random() < 0.3:
            name += self.r.choice(("-wrap", "-box", "__inner", " row", "-1", " clearfix"))
        return f' {self.r.choice(("class", "class", "id"))}="{name}"'

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{k}">{self.say(1, 3).rstrip(".")}</a></li>' for k in range(n))

    def wrap(self, kind: str, inner: str, *tags: str) -> str:
        g = self.r.choice(tags)
        return f"<{g}{self.element(kind)}>{inner}</{g}>"

    def junk(self, where: str) -> str:
        r = self.r
        kind = r.choice({"top": ("menu", "menu", "header", "ad", "notice", "search", "crumbs"), "side": ("side", "side", "ad", "newsletter", "menu", "share"), "end": ("footer", "talk", "talk", "side", "ad", "share", "newsletter", "notice", "menu")}[where])
        if kind == "menu":
            links = self.links(r.randint(3, 14))
            return r.choice((self.wrap("menu", f"<ul>{links}</ul>", "nav", "nav", "div"), self.wrap("menu", links, "ul"), self.wrap("menu", re.sub("</?li>", " ", links), "div", "nav")))
        if kind == "header":
            title = f"<h1><a href='/'>{self.say(1, 4)}</a></h1>" if r.random() < 0.6 else f"<div><a href='/'>{self.say(1, 3)}</a></div>"
            return self.wrap("edge", title + f"<p>{self.say(2, 10)}</p>", "header", "header", "div")
        if kind == "ad":
            body = self.say(3, 30)
            body = r.choice((body, f"<p>{body}</p>", f"<a href='/buy'>{body}</a>", f"<p>{body}</p><p>{self.say(2, 9)}</p>"))
            return self.wrap("ad", (self.headed("ad") if r.random() < 0.4 else "") + body, "div", "aside", "section", "div")
        if kind == "notice":
            return self.wrap("notice", (self.headed("notice") if r.random() < 0.4 else "") + f"<p>{self.say(8, 50)}</p><button>{self.say(1, 2)}</button>", "div", "section", "div", "dialog")
        if kind == "search":
            return f"<form{self.element('form')}><label>{self.say(1, 4)}</label><input type=text><button>{self.say(1, 1)}</button></form>"
        if kind == "crumbs":
            return self.wrap("menu", r.choice((" &gt; ", " / ", " » ")).join(f"<a href='/'>{self.say(1, 2)}</a>" for _ in range(3)), "div", "p", "nav")
        if kind == "side":
            link = lambda: f'<a href="/{r.randint(1, 99)}">{self.say(2, 9)}</a>'
            inner = r.choice((
                lambda: self.headed("side") + f"<ul>{self.links(r.randint(2, 7))}</ul>",
                lambda: "".join(self.headed("side") + f"<p>{self.say(5, 35)}</p>" for _ in range(r.randint(1, 4))),
                lambda: self.headed("side") + "".join(f"<div><h4>{link()}</h4><p>{self.say(5, 30)}</p></div>" for _ in range(r.randint(2, 5))),
                lambda: self.headed("side") + "".join(f"<p>{link()}</p>" for _ in range(r.randint(2, 6))),
            ))()
            return self.wrap("side", inner, "aside", "aside", "div", "section")
        if kind == "newsletter":
            return self.wrap("form", (self.headed("form") if r.random() < 0.6 else "") + f"<p>{self.say(5, 25)}</p><form><label>{self.say(1, 5)}</label><input name=e><button>{self.say(1, 2)}</button></form>", "div", "section", "form")
        if kind == "talk":
            who = lambda: r.choice((f"<b>{self.say(1, 2)}</b>", f"<div{self.element('share')}>{self.say(1, 2)} <time>{r.randint(1, 28)}.{r.randint(1, 12)}.20{r.randint(10, 25)}</time></div>", f"<cite>{self.say(1, 2)}</cite>", f"<h4>{self.say(1, 2)}</h4>"))
            each = lambda: who() + "".join(f"<p>{self.say(4, 70)}</p>" for _ in range(r.choice((1, 1, 1, 2)))) + r.choice(("", "", f"<a href='#'>{r.choice(('Reply', 'Antworten', 'Répondre', 'Responder', self.say(1, 1)))}</a>"))
            g = r.choice(("div", "li", "article", "div"))
            many = "".join(f"<{g}{self.element('talk')}>{each()}</{g}>" for _ in range(r.randint(1, 9)))
            return self.wrap("talk", self.headed("talk") * (r.random() < 0.8) + (f"<ol>{many}</ol>" if g == "li" else many), "section", "div", "div", "aside")
        if kind == "share":
            return self.wrap("share", "".join(f"<a href='/s'>{self.say(1, 1)}</a> " for _ in range(r.randint(2, 5))), "div", "p", "ul")
        inner = r.choice((f"&copy; x.example.com &middot; {self.say(3, 25)}", f"<p>{self.say(4, 30)}</p>", f"<ul>{self.links(4)}</ul><p>{self.say(3, 12)}</p>", f"<div>{self.say(2, 8)}</div><div>{self.say(2, 30)}</div>", self.headed("edge") + f"<p>{self.say(4, 30)}</p>"))
        return self.wrap("edge", inner, "footer", "footer", "div")

    def article(self, flat: bool = False) -> str:
        """Blocks of main text; flat: paragraphs and headings only."""
        r, out = self.r, []
        if r.random() < 0.8:
            out.append(f"<h1>{self.say(1, 14)}</h1>")
        size = r.choice(((1, 6), (3, 40), (10, 120), (1, 150)))
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 12, 25))):
            x = r.random() * (0.6 if flat else 1)
            if x < 0.66:
                out.append("<p>{}</p>".format(self.inline(*size)) if flat else r.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<p><b>{}<br>")).format(self.inline(*size)))
            elif x < 0.74:
                out.append(f"<h{r.randint(2, 4)}>{self.say(1, 8)}</h2>".replace("</h2>", "") if r.random() < 0.1 else f"<h2>{self.say(1, 8)}</h2>")
            elif x < 0.82:
                out.append("<ul>" + "".join(f"<li>{self.inline(2, 20)}</li>" for _ in range(r.randint(1, 7))) + "</ul>")
            elif x < 0.87:
                out.append(f"<blockquote><p>{self.say(5, 50)}</p></blockquote>")
            elif x < 0.91:
                out.append("<table>" + "".join(f"<tr><td>{self.say(1, 4)}</td><td>{self.say(1, 6)}</td></tr>" for _ in range(r.randint(1, 5))) + "</table>")
            elif x < 0.94:
                out.append(f"<figure><img src=x><figcaption>{self.say(2, 12)}</figcaption></figure>")
            elif x < 0.97:
                out.append(f"<pre>{self.say(3, 20)}</pre>")
            else:
                out.append(f"<div>{''.join(f'<p>{self.inline(*size)}</p>' for _ in range(r.randint(1, 3)))}</div>")
            if r.random() < 0.04 and not flat:
                out.append("<div data-junk>" + self.junk("side") + "</div>")
        return "".join(out)

    def page(self) -> str:
        r = self.r
        g = r.choice(("article", "article", "main", "div", "div", "div", "div", "section", "td"))
        inner = self.article()
        if r.random() < 0.12:  # blocks right in the page
            main = re.sub(r"(?<![^>])<(h1|p|h2|ul|blockquote|table|figure|pre|div)(?=[ >])", r"<\1 data-main", self.article(flat=True))
            g = ""
        for _ in range(r.choice((0, 0, 1, 2))):
            inner = f"<div{self.element('main')}>{inner}</div>"
        if g:
            main = f"<{g}{self.element('main')} data-main>{inner}</{g}>"
        if g == "td":
            main = f"<table><tr>{main}</tr></table>"
        if r.random() < 0.03:
            main = ""  # a page without main text
        top = [self.junk("top") for _ in range(r.choice((0, 1, 2, 2, 3)))]
        side = [self.junk("side") for _ in range(r.choice((0, 0, 1, 2)))]
        end = [self.junk("end") for _ in range(r.choice((0, 1, 1, 2, 3)))]
        mid = side + [main] if r.random() < 0.4 else [main, *side]
        if r.random() < 0.25:
            mid.append(self.junk("end"))
        if r.random() < 0.5:
            w = r.choice(("main", "div class='container'", "div id='page'", "div class='wrapper'", "div", f"div class='{self.opaque()}'"))
            mid = [f"<{w}>", *mid, f"</{w.split(' ')[0]}>"]
        head = f"<head><meta charset=utf-8><title>{self.say(1, 9)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head>"
        body = "".join(top + mid + end)
        tail = "</body></html>" if r.random() < 0.85 else ""
        return f"<!DOCTYPE html><html>{head}<body>{body}{tail}" if r.random() < 0.92 else body


def labelled(source: str) -> tuple[Page, np.ndarray]:
    """The page as the features see it, and whether each node holds main text."""
    page = Page(source)
    n = len(page.tag)
    inside, junk = np.zeros(n, bool), np.zeros(n, bool)
    for i in range(1, n):
        p = page.parent[i]
        junk[i] = junk[p] or "data-junk" in page.attr[i] or page.tag[i] in SKIP
        inside[i] = (inside[p] or "data-main" in page.attr[i]) and not junk[i]
    holds = np.array([inside[i] and page.tag[i] == "" and not page.text[i].isspace() for i in range(n)])
    for i in range(n - 1, 0, -1):
        if holds[i]:
            holds[page.parent[i]] = True
    page.attr = [re.sub(r"\s*data-(main|junk)", "", a) for a in page.attr]
    return page, holds


def boost(x: np.ndarray, y: np.ndarray, trees: int = 150, depth: int = 5, rate: float = 0.12, bins: int = 32, least: float = 8.0, share: float = 0.4, seed: int = 5) -> Trees:
    """Gradient boosting of the logistic loss over binned features; nodes split for the largest gain on a share of the rows, drawn anew for each tree."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    width = max(len(c) for c in cuts) + 1
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    z = np.full(len(y), base)
    inner, nf = 2**depth - 1, x.shape[1]
    feats, cutv, leaves = [], [], []
    draw, all_binned, all_x = np.random.RandomState(seed), binned, x
    for _ in range(trees):
        some = np.nonzero(draw.rand(len(y)) < share)[0]
        binned, x = all_binned[some], all_x[some]
        p = 1 / (1 + np.exp(-z[some]))
        g, h = y[some] - p, p * (1 - p)
        feat, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(some), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = at - first
            gs, hs = np.zeros((nf, count, width)), np.zeros((nf, count, width))
            for f in range(nf):
                key = local * width + binned[:, f]
                gs[f] = np.bincount(key, weights=g, minlength=count * width).reshape(count, width)
                hs[f] = np.bincount(key, weights=h, minlength=count * width).reshape(count, width)
            gl, hl = gs.cumsum(2)[:, :, :-1], hs.cumsum(2)[:, :, :-1]
            gt, ht = gs.sum(2)[:, :, None], hs.sum(2)[:, :, None]
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(hl < least) | (ht - hl < least)] = -1
            for c in range(count):
                f, b = np.unravel_index(gain[:, c].argmax(), (nf, width - 1))
                if gain[f, c, b] > 1e-6 and b < len(cuts[f]):
                    feat[first + c], cut[first + c] = f, cuts[f][b]
            at = 2 * at + 1 + (x[np.arange(len(some)), feat[at]] > cut[at])
        leaf = at - inner
        gs, hs = np.bincount(leaf, weights=g, minlength=inner + 1), np.bincount(leaf, weights=h, minlength=inner + 1)
        value = rate * gs / (hs + 1)
        at = np.zeros(len(y), np.int64)
        for _ in range(depth):
            at = 2 * at + 1 + (all_x[np.arange(len(y)), feat[at]] > cut[at])
        z += value[at - inner]
        feats.append(feat)
        cutv.append(np.where(np.isinf(cut), 3e38, cut))
        leaves.append(value)
    return Trees(np.stack(feats), np.stack(cutv).astype(np.float32), np.stack(leaves), base, np.zeros(TOKEN_BINS, np.float32))


def token_weights(made: list[tuple[Page, np.ndarray]], cache: dict) -> np.ndarray:
    """Of each bin the smoothed log odds that a node with it holds main text, against a node of no such token; a page counts once a bin and label."""
    n = np.zeros((2, TOKEN_BINS))
    for p, holds in made:
        for label in (0, 1):
            seen = set()
            for i in range(1, len(p.tag)):
                if holds[i] == label:
                    seen.update(tokens_of(p, i, cache) if p.tag[i] else lead_of(p.text[i]))
            n[label, list(seen)] += 1
    out = np.log((n[1] + 0.5) / (n[0] + 0.5)) * (n.sum(0) / (n.sum(0) + 4))
    return np.where(n.sum(0) >= 3, np.clip(out, -4, 4), 0).astype(np.float32)


def main(pages: int = 4200, seed: int = 11) -> float:
    """Train, write the model, and return the share of text that held-out pages get right.

    Trees are fitted on token weights that each half of the pages has from the other, so
    that they learn how far weights can be trusted.
    """
    maker, cache = Maker(seed), {}
    made = [labelled(maker.page()) for _ in range(pages)]
    cut = pages * 5 // 6
    fit, half = made[:cut], cut // 2
    parts = ((fit[:half], token_weights(fit[half:], cache)), (fit[half:], token_weights(fit[:half], cache)))
    # a node is decided on only where its parent holds main text
    asked = [np.append(True, h[np.array(p.parent[1:], np.int64)]) for part, _ in parts for p, h in part]
    x = np.concatenate([features([p], cache, w) for part, w in parts for p, _ in part])[np.concatenate(asked)]
    y = np.concatenate([h for part, _ in parts for _, h in part]).astype(float)[np.concatenate(asked)]
    trees = boost(x, y)
    trees.weights = token_weights(fit, cache)
    MODEL.write_text(trees.dump())
    trees = Trees.load(MODEL.read_text())
    right = total = 0
    for p, h in made[cut:]:
        keep = decode(p.parent, trees.log_odds(features([p], cache, trees.weights)), np.array([t in SKIP for t in p.tag]))
        size = np.array([len(t.strip()) if g == "" else 0 for t, g in zip(p.text, p.tag)])
        right += int(size[np.array(keep) == h].sum())
        total += int(size.sum())
    return right / total


if __name__ == "__main__":
    print(f"held-out text labelled rightly: {main():.4f}")

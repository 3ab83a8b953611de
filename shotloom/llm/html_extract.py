"""Main text of web pages by a recurrent block labeller.

The leaf blocks of a page are a sequence.  Each block is a vector: the sum of learned vectors of its hashed tag-path
tokens, the mean of those of its hashed words, and a few plain measures.  A bidirectional LSTM in numpy reads the whole
sequence, so that each block is labelled in the context of its document, and the blocks labelled as content are joined.

The labeller is trained here, on a bounded sample of the given pages.  Labels come from telling element names (weak
supervision); sampled pages are also re-dressed: their containers get other names of the same kind, names that say nothing
or none at all, and boilerplate groups are put around and into the article, worded as menus, notices, adverts and comments
are.  So names, wording and context decide, not one layout.  Pages are read, re-dressed and turned into numbers inside
tasks; only numbers of at most WINDOWS windows of MOST_TRAINED blocks reach the driver.  A labeller can be saved and used
again (save, load).

Defined results: a null or empty page, or one without content, gives empty text; pages of any length are read whole;
repeated rows are extracted each, and pages that share an id, or have none, are sampled by their place; a block that ties at
one half is content; an empty table gives an empty one; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, located, with_row_key
from .html_blocks import Block, Element, read_blocks

SAMPLE = 400  # pages that the labeller is trained on, about
WINDOWS = 2400  # windows of blocks, of these pages as they are and re-dressed, that it is trained on, at most
PATHS, WORDS, PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 4096, 16384, 16, 8, 8, 16
EPOCHS, BATCH, RATE = 8, 32, 0.01
MOST_TRAINED = 120  # blocks of a training window; windows reach the end of a page, labelling reads it in one

UPPER = bytes(range(65, 91))

#: Names that tell boilerplate, and names that tell content.
BOILERPLATE_TAGS = "nav header footer aside form menu dialog search fieldset".split()
BOILERPLATE_NAMES = "ad ads advert advertisement advertising banner sponsor sponsored promo promotion sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs topbar masthead header footer foot copyright legal cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login register search form related recommended recommendations trending popular share sharing social comment comments respond replies disqus discussion widget pagination pager toolbar hidden disclaimer tags skip toc".split()
LEAVES = [[Element(t) for t in x.split()] for x in ("p", "p", "ul li", "ol li", "h1", "h2", "h3", "blockquote p", "blockquote", "div", "table tr td", "table tbody tr td", "figure figcaption", "pre", "dl dd", "section p", "div p")]
#: Wording of boilerplate.
WORDING = [
    "Home", "About us", "About", "Contact", "Contact us", "Contact us | Privacy", "Imprint", "Privacy policy", "Privacy", "Terms of service", "Terms of use", "Terms and conditions", "Sitemap", "Help", "FAQ", "Careers", "Jobs", "Press", "Blog", "News", "Shop",
    "Products", "Services", "Categories", "Archive", "Archives", "Tags", "Menu", "Search", "Search this site", "Login", "Log in", "Sign in", "Sign up", "Register", "My account", "Cart", "Checkout", "Skip to content", "Back to top", "Top", "Next", "Previous",
    "Next page", "Previous page", "Older posts", "Newer posts", "Page 1 of 12", "1 2 3 4 5", "Read more", "Continue reading", "Learn more", "Show more", "Load more", "See all", "Related articles", "Related posts", "You may also like", "More from this author",
    "Most read", "Most popular", "Popular posts", "Recent posts", "Recent comments", "Trending now", "Recommended for you", "Share", "Share this", "Share this post", "Share this article", "Share on Facebook", "Share on Twitter", "Tweet", "Pin it", "Follow us",
    "Follow us on social media", "Like us on Facebook", "Email this", "Print this page", "Subscribe", "Subscribe now", "Subscribe to our newsletter", "Sign up for our newsletter", "Enter your email address", "Get the latest news in your inbox", "Unsubscribe at any time",
    "Advertisement", "Sponsored", "Sponsored content", "Sponsored links", "Promoted", "Ads by our partners", "Buy now", "Shop now", "Order today", "Limited offer: save 20% today", "Free shipping on all orders", "Click here", "Download our app", "Try it for free",
    "We use cookies", "We use cookies to improve your experience", "This site uses cookies", "This website uses cookies to ensure you get the best experience", "By continuing to use this site you agree to our use of cookies", "Accept", "Accept all", "Accept cookies",
    "Reject all", "Cookie settings", "Manage preferences", "Got it", "Close", "Please enable JavaScript", "Your browser is out of date", "Please upgrade your browser", "© 2024 Example Inc. All rights reserved.", "Copyright 2023", "All rights reserved", "Powered by WordPress",
    "Theme by example", "Made with love", "Comments", "3 comments", "Leave a comment", "Leave a reply", "Post a comment", "Add a comment", "Reply", "Report", "Like", "Great article, thanks for sharing!", "Thanks for this post, I really liked it", "I disagree with the author",
    "First comment!", "Anonymous says:", "2 hours ago", "said on Monday at 10:15", "Filed under: news", "Posted in", "Tagged with", "Written by", "About the author", "Startseite", "Impressum", "Datenschutz", "Über uns", "Kontakt", "Anmelden", "Weiterlesen", "Wir verwenden Cookies",
    "Alle Rechte vorbehalten", "Accueil", "Mentions légales", "Nous contacter", "Lire la suite", "Nous utilisons des cookies", "Tous droits réservés", "Inicio", "Contacto", "Leer más", "Utilizamos cookies", "Todos los derechos reservados",
]
CONTENT_TAGS = "article main".split()
CONTENT_NAMES = "article content main post entry story body text page document blog news single".split()


def _hashed(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % PATHS


def _path_ids(block: Block) -> list[int]:
    """Hashed tag-path tokens: tags and names of all elements, each once however deep a page nests, and the tag of the last."""
    out: dict[int, None] = {}
    for e in block.path:
        if e.ids is None:
            e.ids = [_hashed(f"<{e.tag}"), *(_hashed(f".{w}") for w in e.names)]
        out.update(dict.fromkeys(e.ids))
    return [*out, _hashed(f"={block.path[-1].tag}" if block.path else "=")]


TELLING = {_hashed(f"<{t}") for t in (*BOILERPLATE_TAGS, *CONTENT_TAGS)} | {_hashed(f".{w}") for w in (*BOILERPLATE_NAMES, *CONTENT_NAMES)}


def _telling_apart(paths: list[list[int]]) -> list[list[int]]:
    """Without the tokens that all blocks of a page share, unless they tell content or boilerplate: wrappers of a whole page say
    nothing of its blocks, however many there are and whatever their names."""
    if len(paths) < 2:
        return paths
    shared = set.intersection(*(set(p[:-1]) for p in paths)) - TELLING
    return [[*(t for t in p[:-1] if t not in shared), p[-1]] for p in paths]


def _measures(block: Block, at: int, n: int) -> list[float]:
    t = block.text
    size, raw = len(t), t.encode("utf-8", "replace")
    share = lambda chars: 1 - len(raw.translate(None, chars)) / len(raw)
    return [np.log1p(size) / 6, block.link, float(t[-1] in ".!?…\"”"), at / max(1, n - 1), share(b"0123456789"), share(UPPER), float("©" in t), min(n, 100) / 100]


class Sequence:
    """A page's blocks as numbers."""

    def __init__(self, blocks: list[Block]):
        self.paths = [np.array(p, np.int32) for p in _telling_apart([_path_ids(b) for b in blocks])]
        self.words = [np.array([zlib.crc32(w) % WORDS for w in b.text.encode("utf-8", "replace").lower().split()] or [0], np.int32) for b in blocks]
        self.measures = np.array([_measures(b, k, len(blocks)) for k, b in enumerate(blocks)], np.float32).reshape(-1, MEASURES)

    def __len__(self) -> int:
        return len(self.paths)

    def windows(self, most: int) -> list[tuple["Sequence", slice]]:
        """All blocks in even windows of ``most`` at most; the measures stay those of the whole page."""
        out, edges = [], np.linspace(0, len(self), -(-len(self) // most) + 1).astype(int)
        for part in map(slice, edges[:-1], edges[1:]):
            w = Sequence([])
            w.paths, w.words, w.measures = self.paths[part], self.words[part], self.measures[part]
            out.append((w, part))
        return out

    def row(self) -> dict[str, np.ndarray]:
        """Flat arrays of numbers, from which from_row makes the sequence again."""
        n = lambda ids: np.array([len(x) for x in ids], np.int32)
        return {"paths": np.concatenate(self.paths), "path_n": n(self.paths), "words": np.concatenate(self.words), "word_n": n(self.words), "measures": self.measures.ravel()}

    @staticmethod
    def from_row(paths: np.ndarray, path_n: np.ndarray, words: np.ndarray, word_n: np.ndarray, measures: np.ndarray) -> "Sequence":
        s = Sequence([])
        s.paths, s.words = np.split(np.asarray(paths, np.int32), np.cumsum(path_n)[:-1]), np.split(np.asarray(words, np.int32), np.cumsum(word_n)[:-1])
        s.measures = np.asarray(measures, np.float32).reshape(-1, MEASURES)
        return s


def _sums(table: np.ndarray, ids: list[np.ndarray], mean: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum (halved) or mean of the learned vectors of each block's ids; the ids and weights that it is made of."""
    n = np.array([len(x) for x in ids])
    weight = 1 / n if mean else np.full(len(n), 0.5)
    flat = np.concatenate(ids)
    return np.add.reduceat(table[flat], np.r_[0, np.cumsum(n)[:-1]], axis=0) * weight[:, None], flat, np.repeat(weight, n)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM + MEASURES
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {"path": f(PATHS, PATH_DIM, scale=0.3), "word": f(WORDS, WORD_DIM, scale=0.05), "out": f(2 * HIDDEN + d, 1, scale=0.1), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p[f"w{side}"] = f(d + HIDDEN, 4 * HIDDEN, scale=0.2)
            self.p[f"b{side}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)

    def save(self, path: str) -> None:
        np.savez(path, **self.p)

    @staticmethod
    def load(path: str) -> "Labeller":
        out = Labeller()
        with np.load(path) as data:
            out.p = dict(data)
        return out

    def _inputs(self, some: list[Sequence]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        lens = np.array([len(s) for s in some])
        paths, words = _sums(self.p["path"], [x for s in some for x in s.paths], False), _sums(self.p["word"], [x for s in some for x in s.words], True)
        flat = np.concatenate([paths[0], words[0], np.concatenate([s.measures for s in some])], axis=1)
        sizes = [np.array([len(x) for s in some for x in ids(s)]) for ids in (lambda s: s.paths, lambda s: s.words)]
        row = np.repeat(np.arange(len(some)), lens)
        step = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
        x = np.zeros((lens.max(), len(some), flat.shape[1]), np.float32)
        mask = np.zeros((lens.max(), len(some), 1), np.float32)
        x[step, row], mask[step, row] = flat, 1
        return x, mask, (step, row), ((*paths[1:], sizes[0]), (*words[1:], sizes[1]))

    def _scan(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states of one direction."""
        steps = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
        w, out = self.p[f"w{side}"], np.zeros((*x.shape[:2], HIDDEN), np.float32)
        seen = x @ w[: x.shape[2]] + self.p[f"b{side}"]
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t in steps:
            z = seen[t] + h @ w[x.shape[2] :]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            before_h, before_c = h, c
            c = (f * before_c + i * g) * mask[t]
            tc = np.tanh(c)
            h = o * tc * mask[t]
            out[t] = h
            if keep is not None:
                keep.append((t, i, f, o, g, before_h, before_c, tc))
        return out

    def scores(self, some: list[Sequence]) -> list[np.ndarray]:
        """Probability of content of each block of each page (pages without blocks give none)."""
        out: list[np.ndarray] = [np.empty(0, np.float32)] * len(some)
        order = sorted((k for k in range(len(some)) if len(some[k])), key=lambda k: len(some[k]))
        at = 0
        while at < len(order):
            size = max(1, min(128, 60_000 // len(some[order[min(at + 127, len(order) - 1)]])))
            part = order[at : at + size]
            at += size
            x, mask, (step, row), _ = self._inputs([some[k] for k in part])
            h = np.concatenate([self._scan(x, mask, "f"), self._scan(x, mask, "b"), x], axis=2)
            p = _sigmoid((h @ self.p["out"])[..., 0] + self.p["bias"])[step, row]
            for k, v in zip(part, np.split(p, np.cumsum([len(some[k]) for k in part])[:-1]), strict=True):
                out[k] = v
        return out

    def _gradients(self, some: list[Sequence], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        x, mask, (step, row), (paths, words) = self._inputs(some)
        d = x.shape[2]
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self._scan(x, mask, "f", kept["f"]), self._scan(x, mask, "b", kept["b"]), x], axis=2)
        s = (h @ self.p["out"])[..., 0] + self.p["bias"]
        y = np.zeros(s.shape, np.float32)
        y[step, row] = np.concatenate(labels)
        ds = ((_sigmoid(s) - y) * mask[..., 0] / mask.sum())[..., None]
        g = {"out": np.einsum("tbk,tbo->ko", h, ds), "bias": ds.sum(axis=(0, 1))}
        dh = ds @ self.p["out"].T
        dx = dh[..., 2 * HIDDEN :].copy()
        for n, side in enumerate("fb"):
            w = self.p[f"w{side}"]
            gw, gb = np.zeros_like(w), np.zeros_like(self.p[f"b{side}"])
            next_h = next_c = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, i, f, o, c_in, before_h, before_c, tc in reversed(kept[side]):
                to_h = (dh[t, :, n * HIDDEN : (n + 1) * HIDDEN] + next_h) * mask[t]
                to_c = (to_h * o * (1 - tc**2) + next_c) * mask[t]
                dz = np.concatenate([to_c * c_in * i * (1 - i), to_c * before_c * f * (1 - f), to_h * tc * o * (1 - o), to_c * i * (1 - c_in**2)], axis=1)
                gw[:d] += x[t].T @ dz
                gw[d:] += before_h.T @ dz
                gb += dz.sum(axis=0)
                dx[t] += dz @ w[:d].T
                next_h, next_c = dz @ w[d:].T, to_c * f
            g[f"w{side}"], g[f"b{side}"] = gw, gb
        flat = dx[step, row]
        for name, (ids, weight, n), lo, hi in (("path", paths, 0, PATH_DIM), ("word", words, PATH_DIM, PATH_DIM + WORD_DIM)):
            g[name] = np.zeros_like(self.p[name])
            np.add.at(g[name], ids, np.repeat(flat[:, lo:hi], n, axis=0) * weight[:, None])
        return g

    def train(self, pages: list[tuple[Sequence, np.ndarray]], seed: int = 4, epochs: int = EPOCHS) -> "Labeller":
        r = np.random.default_rng(seed)
        m, v, k = {n: 0.0 for n in self.p}, {n: 0.0 for n in self.p}, 0
        for epoch in range(epochs):
            order = r.permutation(len(pages))
            order = np.concatenate([sorted(x, key=lambda i: len(pages[i][0])) for x in np.array_split(order, max(1, len(order) // (8 * BATCH)))]).astype(int) if len(order) else order
            batches = [order[at : at + BATCH] for at in range(0, len(order), BATCH)]  # of like lengths, so few steps are padding
            for k_batch in r.permutation(len(batches)):
                part = [pages[i] for i in batches[k_batch]]
                g = self._gradients([s for s, _ in part], [y for _, y in part])
                k += 1
                rate = RATE * (1 - 0.8 * epoch / epochs)
                for n, x in g.items():  # Adam
                    m[n], v[n] = 0.9 * m[n] + 0.1 * x, 0.98 * v[n] + 0.02 * x * x
                    self.p[n] -= rate * (m[n] / (1 - 0.9**k)) / (np.sqrt(v[n] / (1 - 0.98**k)) + 1e-8)
        self.p = {n: x.astype(np.float32) for n, x in self.p.items()}
        return self


def weak_labels(blocks: list[Block]) -> np.ndarray | None:
    """1 for content, 0 for boilerplate, by telling names; None if the page has no telling container of content."""
    boiler, content = set(BOILERPLATE_NAMES), set(CONTENT_NAMES)
    y, found = [], False
    for b in blocks:
        bad = any(e.tag in BOILERPLATE_TAGS or boiler & set(e.names) for e in b.path)
        inside = any(e.tag in CONTENT_TAGS or content & set(e.names) for e in b.path)
        found |= inside
        y.append(float(inside and not bad))
    return np.array(y, np.float32) if found else None


def plain_labels(blocks: list[Block]) -> np.ndarray:
    """Labels where no page has telling names of content: long texts that are not links and not in boilerplate."""
    boiler = set(BOILERPLATE_NAMES)
    return np.array([float(len(b.text) >= 60 and b.link < 0.3 and not any(e.tag in BOILERPLATE_TAGS or boiler & set(e.names) for e in b.path)) for b in blocks], np.float32)


def _dress(r: np.random.Generator, tags: list[str], names: list[str], named: float) -> Element:
    """A container of one kind under some name."""
    if r.random() > named:
        return Element(str(r.choice(tags)))
    first = str(r.choice(names))
    return Element(str(r.choice(["div", "section", "div", "ul" if names is BOILERPLATE_NAMES else "div"])), [first] if r.random() < 0.5 else [first, str(r.choice(names))])


def _mute(r: np.random.Generator) -> list[Element]:
    """Containers that say nothing: bare elements, table cells, or made-up names."""
    kind = r.random()
    if kind < 0.4:
        return [Element(str(r.choice(["div", "div", "span", "section", "td", "center"])))]
    if kind < 0.6:
        return [Element(t) for t in (("table", "tbody", "tr", "td") if r.random() < 0.5 else ("table", "tr", "td"))]
    return [Element("div", ["".join(chr(97 + int(c)) for c in r.integers(0, 26, int(r.integers(1, 7)))) for _ in range(int(r.integers(1, 3)))])]


def redressed(blocks: list[Block], y: np.ndarray, r: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A page in another layout: its content in other containers, with groups of boilerplate around and inside."""
    texts = [b.text for b in blocks]
    short = [t for t in texts if len(t) < 80] or texts
    mute = r.random() < 0.35  # no telling names: wording, links and places must do
    pick = lambda some: some[int(r.integers(len(some)))]

    def worded() -> str:
        t = pick(WORDING)
        if r.random() < 0.3:
            t = f"{t} {pick([' | ', '· ', '- ', ''])}{pick(WORDING)}"
        return f"{t} {' '.join(pick(texts).split()[: int(r.integers(1, 12))])}" if r.random() < 0.25 else t

    def group(base: list[Element], inside: bool) -> list[Block]:
        if mute:  # no telling name
            path = [*base, *_mute(r)]
            return [Block([*path, *(LEAVES[r.integers(len(LEAVES))] if r.random() < 0.5 else [])], t, float(link)) for t, link in ((worded(), r.random() < (0.3 if inside else 0.6)) if inside or r.random() < 0.85 else (pick(short), True) for _ in range(r.integers(1, 6)))]
        shell = [Element("div", [str(r.choice(["wrapper", "row", "inner", "box", "container"]))])] * int(r.random() < 0.3)
        path = [*base, *shell, _dress(r, BOILERPLATE_TAGS, BOILERPLATE_NAMES, 0.55)]
        if r.random() < 0.25:  # named after what it stands in, too
            path.append(Element("div", [pick(CONTENT_NAMES), pick(BOILERPLATE_NAMES)]))
        leaf = LEAVES[r.integers(len(LEAVES))] if r.random() < 0.8 else []
        kind = r.random()
        make = worded if kind < 0.45 else (lambda: pick(short)) if kind < 0.6 else (lambda: pick(pick(texts).split() or ["-"])) if kind < 0.75 else (lambda: pick(texts))
        link = float(r.random() < 0.6) if kind < 0.75 else 0.0
        return [Block([*path, *leaf], make(), link) for _ in range(r.integers(1, 7))]

    body = [e for e in blocks[0].path if e.tag in ("html", "body")]
    if r.random() < 0.3:
        body = [*body, Element("div", [str(r.choice(["page", "site", "wrapper", "container", "layout"]))])]
    inside = [*body, *_mute(r)] if mute else [*body, _dress(r, CONTENT_TAGS, CONTENT_NAMES, 0.5)]
    if r.random() < 0.3 and not mute:
        inside.append(_dress(r, CONTENT_TAGS, CONTENT_NAMES, 0.7))
    own = []
    for b, good in zip(blocks, y, strict=True):
        if good:  # now and then as a list, a quotation, a table or plain text
            leaf = b.path[-1:] if r.random() < 0.6 else LEAVES[r.integers(len(LEAVES))]
            own.append(Block([*inside, *leaf], b.text, float(r.random()) if r.random() < 0.1 else b.link))
    seq = [(b, 0.0) for _ in range(r.integers(0, 3)) for b in group(body, False)] + [(b, 1.0) for b in own] + [(b, 0.0) for _ in range(r.integers(0, 4)) for b in group(body, False)]
    for _ in range(r.integers(0, 3)):  # inside the article
        at = int(r.integers(0, len(seq) + 1))
        seq[at:at] = [(b, 0.0) for b in group(inside, True)]
    return [b for b, _ in seq], np.array([t for _, t in seq], np.float32)


def training_windows(page: str | None, seed: int = 11) -> list[tuple[Sequence, np.ndarray, bool]]:
    """Labelled windows of a page as it is and re-dressed, and whether its labels come from telling names."""
    blocks = read_blocks(page)
    if not blocks:
        return []
    y = weak_labels(blocks)
    named = y is not None
    if y is None:
        y = plain_labels(blocks)
    r = np.random.default_rng([seed, zlib.crc32((page or "").encode("utf-8", "replace"))])
    out = [(blocks, y), (blocks, y), *(redressed(blocks, y, r) for _ in range(3))]  # twice as it is: this layout is known to occur
    return [(w, t[part], named) for b, t in out if b for w, part in Sequence(b).windows(MOST_TRAINED)]


def training_pages(pages: list[str]) -> list[tuple[Sequence, np.ndarray]]:
    """Labelled windows; pages without telling names count only if no page has any."""
    every = [x for page in pages for x in training_windows(page)]
    some = any(named for _, _, named in every)
    return [(s, y) for s, y, named in every if named or not some]


def fit(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample: int = SAMPLE, windows: int = WINDOWS) -> Labeller:
    """A labeller trained on about ``sample`` pages, chosen by a hash of id, page and place."""
    rows = with_row_key(located(pages), html=F.col(html_col), id=F.col(id_col)).where("html is not null and html <> ''")
    share = sample / max(1, rows.count())
    place = F.pmod(F.xxhash64(F.lit("pages"), "id", "html", *ROW), F.lit(1_000_000)) / 1_000_000
    some = rows.where(place < share).select("html", place.alias("place"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for page, at in zip(b["html"], b["place"], strict=True):
                got = [{"place": at, "part": k, "named": named, "y": y, **w.row()} for k, (w, y, named) in enumerate(training_windows(page))]
                if got:
                    yield pd.DataFrame(got)

    schema = "place double, part int, named boolean, y array<float>, paths array<int>, path_n array<int>, words array<int>, word_n array<int>, measures array<float>"
    made = some.mapInPandas(run, schema)
    mixed = F.xxhash64(F.lit("windows"), "place", "part")  # whole pages where they fit, a fair draw where they do not
    got = made.orderBy(F.desc("named"), mixed, "place", "part").limit(windows).toPandas()  # ``windows`` rows of numbers at most
    if got["named"].any():
        got = got[got["named"].to_numpy(bool)]
    names = ["paths", "path_n", "words", "word_n", "measures"]
    return Labeller().train([(Sequence.from_row(*(r[c] for c in names)), np.asarray(r["y"], np.float32)) for r in got.to_dict("records")])


def extract(pages: DataFrame, labeller: Labeller | None = None, html_col: str = "html", id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    model = labeller or fit(pages, html_col, id_col, sample)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # weights of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at : at + 512]
                blocks = [read_blocks(h) for h in part["html"]]
                scores = shared.value.scores([Sequence(x) for x in blocks])
                text = ["\n".join(k.text for k, s in zip(x, p, strict=True) if s >= 0.5) for x, p in zip(blocks, scores, strict=True)]
                yield part[["page_id", "url"]].assign(text=text, n_chars=[len(t) for t in text])

    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return slim.mapInPandas(run, "page_id long, url string, text string, n_chars long")

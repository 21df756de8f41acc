"""Main-text extraction by a recurrent block labeller.

A page is read into its leaf sequence: runs of text between block-level tags,
each with the path of open elements.  Two vectors describe a block: its tag
path (element names and class, id and role words, hashed) and its words
(hashed), plus a few numbers.  A bidirectional LSTM in numpy reads the whole
sequence, so every block is labelled in the context of the document; blocks
labelled as article are joined.

Training: nobody labels blocks here, so the labeller is taught by pages whose
answer is known by construction.  A bounded sample of the corpus' pages
(``TRAIN_PAGES``, smallest hash of the id) is read; where a page has
<article> or <main>, that markup is the answer, else the containers that
``LAYOUT_ARTICLE`` names (role=main, class=content and the like).  The article
texts are also dealt anew into other page layouts (``LAYOUT_*``: containers and
class names that hold articles or not); a page without any such container
gives its long unlinked blocks to that.  Weights (under 1 MB) travel with the
tasks.

Only what HTML reads raw (``RAW``) and comments are skipped; formulas and
drawings are read in their line, fallback texts and controls as blocks.

Edge cases: a null or empty page gives an empty text; unclosed, stray and
nested tags are tolerated; repeated rows give equal results; a page with one
huge block or very many blocks is read whole; without any page there is
nothing to learn or to label; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopebook.llm.common import bounded_sample, field, with_text_columns

#: Pages that the labeller is trained on at most; of each a stretch of so many blocks from a random place on.  Other layouts
#: are made of stretches of so many blocks of an article, of so many words of a text.
TRAIN_PAGES = 192
TRAIN_BLOCKS, TRAIN_ARTICLE, TRAIN_WORDS = 120, 12, 40
PATH_DIM, WORD_DIM = 96, 32
HIDDEN = 20
EPOCHS = 14
SEED = 11

# Fixed values of HTML: elements by how they shape the text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr br img "
                   # formulas and drawings stand in the line, as do their parts
                   "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced msub msup msubsup "
                   "munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics annotation annotation-xml "
                   "svg g defs use symbol path rect circle ellipse line polyline polygon text tspan textpath image marker mask pattern "
                   "clippath lineargradient radialgradient stop filter foreignobject".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that HTML reads raw, up to their end tag, and whose text is none of the page's.  What stands in for a script or
#: a frame (noscript, iframe) is read like the rest.
RAW = frozenset("script style textarea title".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
                     "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A start tag ends an open element of the same group, up to the group's container.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "option": ({"option"}, {"select", "datalist"}), "button": ({"button"}, {"object", "template", "td", "th", "table"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[^<]++|<", re.S)
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAMES = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # "tag" and ".word" entries, outermost first
    linked: int  # characters inside links


def _entries(tag: str, attrs: str) -> tuple[str, ...]:
    words = [w for _n, value in _ATTR.findall(attrs) for w in _NAMES.findall(value.lower())] if "=" in attrs else []
    return (tag, *(f".{w}" for w in words))


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = in_link = 0

    def flush():
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, tuple(e for _t, es in stack for e in es), linked))
            parts.clear()
        linked = 0

    def pop_to(depth: int):
        nonlocal in_link
        for tag, _e in stack[depth:]:
            in_link -= tag == "a"
        del stack[depth:]

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            got = m[0]
            if got[:2] not in ("<!", "<?"):
                parts.append(got)
                linked += len(got) if in_link > 0 else 0
            continue
        tag, closing, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag == "br" or tag == "img":
            parts.append(" ")
            continue
        if tag not in INLINE and tag not in RAW:
            flush()
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if tag in INLINE and any(t not in INLINE for t, _e in stack[depth:]):
                        break  # an inline end tag does not close blocks
                    pop_to(depth)
                    break
            continue
        if tag in RAW:
            # A slash at the end of the start tag means nothing here.
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else (n if tag in ("script", "style") else at)
            continue
        if tag in VOID or attrs.endswith("/") and (tag not in INLINE or any(t in ("svg", "math") for t in (tag, *(t for t, _e in stack)))):
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    pop_to(depth)
                    break
                if stack[depth][0] not in INLINE:
                    break
        elif tag in SIBLINGS:
            ends, limit = SIBLINGS[tag]
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in limit:
                    break
                if stack[depth][0] in ends:
                    pop_to(depth)
                    break
        stack.append((tag, _entries(tag, attrs)))
        in_link += tag == "a"
    flush()
    return out


# --- features ----------------------------------------------------------------

DIM = PATH_DIM + WORD_DIM + 8
_slot_cache: dict[tuple[str, int], int] = {}


def _slot(word: str, size: int) -> int:
    """Hash slot and sign of a word: sign * (slot + 1)."""
    key = (word, size)
    got = _slot_cache.get(key)
    if got is None:
        h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        got = (h % size + 1) * (1 if h >> 31 else -1)
        if len(_slot_cache) > 300_000:
            _slot_cache.clear()
        _slot_cache[key] = got
    return got


def features(blocks: list[Block]) -> np.ndarray:
    """(blocks, DIM) inputs of the labeller."""
    out = np.zeros((len(blocks), DIM), dtype=np.float32)
    for k, b in enumerate(blocks):
        row = out[k]
        entries = [e for e in b.path if e not in ("html", "body")]
        for e in set(entries):
            s = _slot(e, PATH_DIM)
            row[abs(s) - 1] += 1.0 if s > 0 else -1.0
        words = b.text.lower().split()
        slots = np.fromiter((_slot(w, WORD_DIM) for w in words), dtype=np.int64, count=len(words))
        v = np.bincount(np.abs(slots) - 1, weights=np.sign(slots), minlength=WORD_DIM)
        size = np.sqrt((v * v).sum())
        if size:
            row[PATH_DIM:PATH_DIM + WORD_DIM] = 0.5 * v / size
        n = len(b.text)
        row[PATH_DIM + WORD_DIM:] = (np.log1p(n) / 6, np.log1p(len(words)) / 5, min(1.0, b.linked / n), len(entries) / 8,
                                     min(k, 16) / 16, min(len(blocks) - 1 - k, 16) / 16, sum(map(b.text.count, ".,;!?")) / (len(words) + 1), float(k == 0))
    return out


# --- the labeller --------------------------------------------------------------

def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with one logistic output per block."""

    def __init__(self, dim: int = DIM, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.normal(0, 1 / np.sqrt(dim), (dim, 4 * hidden)).astype(np.float32)
            self.w[f"h{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, dtype=np.float32)
            bias[hidden:2 * hidden] = 1.0  # remember by default
            self.w[f"c{d}"] = bias
        self.w["o"] = rng.normal(0, 0.2, (2 * hidden + dim, 1)).astype(np.float32)
        self.w["oc"] = np.zeros(1, dtype=np.float32)

    def _direction(self, x, mask, d, keep=False):
        """States (time, batch, hidden); padding carries the state through."""
        T, B, _ = x.shape
        H = self.hidden
        gates_x = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h, c = np.zeros((B, H), np.float32), np.zeros((B, H), np.float32)
        hs, tape = np.empty((T, B, H), np.float32), []
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            g = gates_x[t] + h @ self.w[f"h{d}"]
            i, f, o = _sigmoid(g[:, :H]), _sigmoid(g[:, H:2 * H]), _sigmoid(g[:, 2 * H:3 * H])
            z = np.tanh(g[:, 3 * H:])
            m = mask[t][:, None]
            c_new = m * (f * c + i * z) + (1 - m) * c
            tc = np.tanh(c_new)
            h_new = m * (o * tc) + (1 - m) * h
            if keep:
                tape.append((t, i, f, o, z, c, tc, h, m))
            h, c = h_new, c_new
            hs[t] = h
        return hs, tape

    def forward(self, x, mask, keep=False):
        """Probability of article per block; x (time, batch, dim), mask (time, batch)."""
        hf, tf = self._direction(x, mask, "f", keep)
        hb, tb = self._direction(x, mask, "b", keep)
        both = np.concatenate([hf, hb, x], axis=2)
        return _sigmoid(both @ self.w["o"] + self.w["oc"])[..., 0], (both, tf, tb)

    def gradients(self, x, mask, y):
        p, (both, tf, tb) = self.forward(x, mask, keep=True)
        H = self.hidden
        total = mask.sum()
        err = ((p - y) * mask / total)[..., None].astype(np.float32)
        g = {"o": np.einsum("tbk,tbo->ko", both, err), "oc": err.sum(axis=(0, 1))}
        back = err @ self.w["o"].T
        for d, tape, dh_out in (("f", tf, back[..., :H]), ("b", tb, back[..., H:2 * H])):
            gx, gh, gc = np.zeros_like(self.w[f"x{d}"]), np.zeros_like(self.w[f"h{d}"]), np.zeros_like(self.w[f"c{d}"])
            dh, dc = np.zeros((x.shape[1], H), np.float32), np.zeros((x.shape[1], H), np.float32)
            for t, i, f, o, z, c, tc, h, m in reversed(tape):
                dh = dh + dh_out[t]
                live, dc_now = dh * m, dc + dh * m * o * (1 - tc * tc)
                dg = np.concatenate([dc_now * m * z * i * (1 - i), dc_now * m * c * f * (1 - f), live * tc * o * (1 - o),
                                     dc_now * m * i * (1 - z * z)], axis=1)
                gx += x[t].T @ dg
                gh += h.T @ dg
                gc += dg.sum(axis=0)
                dc = dc_now * (m * f + (1 - m))
                dh = dg @ self.w[f"h{d}"].T + dh * (1 - m)
            g |= {f"x{d}": gx, f"h{d}": gh, f"c{d}": gc}
        q = np.clip(p, 1e-6, 1 - 1e-6)
        return g, float(-((y * np.log(q) + (1 - y) * np.log(1 - q)) * mask).sum() / total)

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, batch: int = 24, rate: float = 0.012, seed: int = SEED):
        """Adam over padded batches of like length."""
        rng = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.w.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        by_length = sorted(range(len(pages)), key=lambda k: len(pages[k][1]))
        groups = [by_length[s:s + batch] for s in range(0, len(by_length), batch)]
        for _ in range(epochs):
            for k in rng.permutation(len(groups)):
                x, mask, y = pad([pages[j] for j in groups[k]])
                g, _loss = self.gradients(x, mask, y)
                size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                step += 1
                for name, v in g.items():
                    v = v * min(1.0, 2.0 / (size + 1e-9))
                    m1[name] = 0.9 * m1[name] + 0.1 * v
                    m2[name] = 0.99 * m2[name] + 0.01 * v * v
                    self.w[name] -= (rate * (m1[name] / (1 - 0.9 ** step)) / (np.sqrt(m2[name] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)

    def label(self, inputs: list[np.ndarray], cells: int = 20_000) -> list[np.ndarray]:
        """True per article block, for each page; pages of like length share a batch."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(inputs)
        order = sorted((k for k in range(len(inputs)) if len(inputs[k])), key=lambda k: len(inputs[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(inputs[order[end]]) * (end - at + 1) <= cells:
                end += 1
            group = order[at:end]
            x, mask, _y = pad([(inputs[k], None) for k in group])
            p, _ = self.forward(x, mask)
            for b, k in enumerate(group):
                out[k] = p[:len(inputs[k]), b] > 0.5
            at = end
        return out


def pad(pages):
    T, B = max(len(x) for x, _y in pages), len(pages)
    x = np.zeros((T, B, pages[0][0].shape[1]), np.float32)
    mask, y = np.zeros((T, B), np.float32), np.zeros((T, B), np.float32)
    for b, (xs, ys) in enumerate(pages):
        x[:len(xs), b] = xs
        mask[:len(xs), b] = 1
        if ys is not None:
            y[:len(xs), b] = ys
    return x, mask, y


# --- training pages ------------------------------------------------------------

# Where page layouts put articles, and what is not the article.
LAYOUT_ARTICLE = ["<article>", "<main>", "<article class='post'>", "<div class='content'>", "<div id='content'>", "<div class='article-body'>",
                  "<div class='post-content'>", "<div class='entry-content'>", "<main id='main'>", "<section class='story'>",
                  "<div class='text'>", "<main><article>", "<div id='main'><div class='body'>", "<div itemprop='articleBody'>", "<section>", "<div>"]
LAYOUT_OTHER = ["<nav>", "<nav><ul>", "<div class='menu'>", "<ul class='nav'>", "<div id='menu'><ul>", "<div class='breadcrumb'>", "<header>",
                "<div class='header'>", "<div id='header'>", "<header><nav>", "<footer>", "<div class='footer'>", "<div id='footer'>",
                "<aside>", "<aside class='sidebar'>", "<div class='sidebar'>", "<div id='sidebar'>", "<div class='widget'>",
                "<div class='related'>", "<div class='cookie-notice'>", "<div class='cookie-banner'>", "<div id='cookie-consent'>",
                "<div class='notice'>", "<div class='banner'>", "<div class='popup'>", "<div role='alert'>", "<div role='navigation'>",
                "<div class='ad'>", "<div class='ads'>", "<div class='advert'>", "<div class='advertisement'>", "<div class='sponsored'>",
                "<div class='promo'>", "<form>", "<form class='search'>", "<form class='newsletter'>", "<div class='subscribe'>",
                "<div class='login'>", "<section class='comments'>", "<div class='comments'>", "<div id='comments'>", "<div class='comment'>",
                "<ol class='comment-list'>", "<div class='share'>", "<div class='social'>", "<div class='tags'>", "<div class='copyright'>",
                "<div class='legal'>", "<div class='disclaimer'>", "<div class='pagination'>", "<div class='newsletter'>"]
#: How a block of an article is marked up; three of five are plain paragraphs.
LAYOUT_BLOCKS = ["<h2>", "<h3>", "<li>", "<ul><li>", "<ul class='list'><li>", "<ol><li>", "<blockquote>", "<blockquote><p>", "<table><tr><td>",
                 "<figure><figcaption>", "<div><p>", "<div>", "<pre>", "<dl><dd>", "<section><p>", "<noscript><p>", "<div class='row'><p>"]
#: Those that also occur inside an article's container.
LAYOUT_INSIDE = [x for x in LAYOUT_OTHER if any(w in x for w in ("ad", "aside", "related", "share", "social", "comment", "promo", "form", "tags", "nav"))]
_NOT_ARTICLE = {"nav", "aside", "footer", "header", "form", "button", "select", "template"} | {f".{w}" for x in LAYOUT_OTHER for w in _NAMES.findall(" ".join(re.findall(r"'([^']*)'", x)))}
_NOT_ARTICLE -= {".list"}  # a list of comments is known by its first word, any other list may be the article's


def truth(block: Block) -> bool:
    """The answer that a page's own markup gives: inside article or main and inside nothing that is not the article."""
    inside = [i for i, e in enumerate(block.path) if e in ("article", "main")]
    return bool(inside) and not any(e in _NOT_ARTICLE for e in block.path[inside[0] + 1:])


#: Elements and attribute words of the containers that hold articles, and the words of a long block.
_ARTICLE_TAGS = {t for x in LAYOUT_ARTICLE for t in re.findall(r"<(\w+)", x)}
_ARTICLE_WORDS = {f".{w}" for x in LAYOUT_ARTICLE for w in _NAMES.findall(" ".join(re.findall(r"'([^']*)'", x)).lower())}
LONG_WORDS = 12


def _below_body(path: tuple[str, ...]) -> tuple[str, ...]:
    """The path without html and body and their words."""
    at = next((i for i, e in enumerate(path) if e[0] != "." and e not in ("html", "body")), len(path))
    return path[at:]


def contained(block: Block) -> bool:
    """The answer of containers without article or main: inside one that ``LAYOUT_ARTICLE`` names, inside nothing that is
    not the article, and no list of links."""
    tag, held = "", False
    for e in _below_body(block.path):
        if e in _NOT_ARTICLE:
            return False
        if e[0] != ".":
            tag = e
        held = held or e in _ARTICLE_WORDS and tag in _ARTICLE_TAGS
    return held and 2 * block.linked < len(block.text)


def long_unlinked(block: Block) -> bool:
    """What is taken for article text where no container tells: many words, few in links, inside nothing that is not the article."""
    return len(block.text.split()) >= LONG_WORDS and 5 * block.linked < len(block.text) and not any(e in _NOT_ARTICLE for e in _below_body(block.path))


def _close(opened: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opened)))


def stretch(items: list, size: int, rng: np.random.Generator) -> list:
    """At most ``size`` consecutive items, from a random place on."""
    start = int(rng.integers(max(len(items) - size, 0) + 1))
    return items[start:start + size]


def relayout(article: list[str], other: list[str], rng: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """A page of another layout that holds these texts, read into blocks, and each block's answer."""
    seen: list[bool] = []
    out: list[str] = []

    def put(opened: str, texts: list[str], is_article: bool, close=True):
        out.append(opened)
        for t in texts:
            t = " ".join(stretch(t.split(), TRAIN_WORDS, rng)) or "x"
            kind = rng.integers(5)
            words = html.escape(t)
            if is_article:
                box = "<p>" if rng.random() < 0.6 else str(rng.choice(LAYOUT_BLOCKS))
                out.append(box + words + _close(box))
            elif "<ul" in opened or "<ol" in opened or rng.random() < 0.3:
                out.append(f"<li><a href='/x'>{words}</a></li>")
            else:
                tag = ("p", "div", "h3", "p", "div")[kind]
                out.append(f"<{tag}>{words}</{tag}>")
            seen.append(is_article)
        if close:
            out.append(_close(opened))

    def others(kinds, at_most):
        for _ in range(rng.integers(at_most + 1)):
            put(str(rng.choice(kinds)), [str(rng.choice(other)) for _ in range(rng.integers(1, 5))], False)

    others(LAYOUT_OTHER, 4)
    box = str(rng.choice(LAYOUT_ARTICLE))
    if article:
        out.append(box)
        out.append(f"<h1>{html.escape(' '.join(stretch(article[0].split(), 9, rng))) or 'x'}</h1>")
        seen.append(True)
        half = rng.integers(len(article) + 1)
        put("", article[:half], True)
        if rng.random() < 0.5:
            others(LAYOUT_INSIDE, 2)
        put("", article[half:], True)
        if rng.random() < 0.4:
            others(LAYOUT_INSIDE, 2)
        out.append(_close(box))
    others(LAYOUT_OTHER, 4)
    blocks = blocks_of("<html><body>" + "".join(out) + "</body></html>")
    return (blocks, seen) if len(blocks) == len(seen) else ([], [])


def train(pages: list[str], seed: int = SEED) -> Labeller:
    """Fit a labeller on sample pages: as they are where their markup or containers answer, and dealt into other layouts."""
    rng = np.random.default_rng(seed)
    read = [stretch(blocks_of(p), TRAIN_BLOCKS, rng) for p in pages]
    marked = []
    for b in read:
        ys = [truth(x) for x in b]
        marked.append((b, ys if any(ys) else [contained(x) for x in b]))
    good = [[x.text for x, y in zip(b, ys) if y] or [x.text for x in b if long_unlinked(x)] for b, ys in marked]
    rest = [x.text for b, ys in marked for x, y in zip(b, ys) if not y] or ["menu", "about us", "contact"]
    examples = [(features(b), np.array(ys, np.float32)) for b, ys in marked if any(ys)]
    for texts in good:
        for _ in range(6):
            # Article texts stand in boxes too: the words alone must not give the answer.
            pool = rest + [str(t) for t in rng.choice(texts, min(3, len(texts)))] if texts else rest
            # Some pages are long: the state must hold over many blocks.
            blocks, ys = relayout(stretch(texts, TRAIN_ARTICLE, rng) * int(rng.choice([1, 1, 1, 2, 8])), pool, rng)
            if blocks:
                examples.append((features(blocks), np.array(ys, np.float32)))
    model = Labeller()
    if examples:
        model.fit(examples)
    return model


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = TRAIN_PAGES) -> Labeller:
    """Train on at most ``sample`` pages: those of smallest hash of the id."""
    rows = bounded_sample(pages.select(F.col(id_col).alias("i"), F.col(html_col).alias("t")).where(F.length("t") > 0), "i", sample).collect()
    return train([r["t"] for r in rows])


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    read = [blocks_of(p) if p else [] for p in pages]
    marks = model.label([features(b) for b in read])
    return ["\n".join(x.text for x, y in zip(b, m) if y) for b, m in zip(read, marks)]


def extract(pages: DataFrame, model: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("__html"))

    def compute(texts):
        for t in main_texts(texts, model):
            yield t, len(t)

    return with_text_columns(slim, "__html", [field("text", "string"), field("n_chars", "long")], compute).drop("__html")

"""Main-text extraction: a linear-chain conditional random field over a page's leaf blocks."""

from __future__ import annotations

import html as html_lib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.workspace import let_workers_import

# --- blocks of a page -------------------------------------------------------------------------

#: A quote matters only where it begins an attribute's value, after "="; elsewhere it is any character.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)|=)*)(?:>|\Z)", re.S
)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
_NAME_PART = re.compile(r"[a-z]+|[0-9]+")

#: Scripts, styles and form controls hold no text; what stands in a frame is markup for browsers without frames.
_RAW = frozenset("script style textarea select iframe".split())
_IN_HEAD = frozenset("html head title meta link base script style noscript template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre search section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
#: Opening one of these ends an open element of the set beside it.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = _BLOCK - {"button", "label", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "title", "head", "html", "body", "option"}


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]  # (tag, name parts of class, id and role) from the root
    linked: int  # characters inside links


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order: runs of text no block element interrupts, white space
    as one space, references decoded. Scripts, styles, comments, form controls and the head
    hold no text; formulas, drawings, embedded objects, templates and what is shown without scripts are read
    like all else. Unclosed elements end where HTML would end them."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if not parts:
            return
        text = " ".join("".join(parts).split())
        if text and not any(t in ("head", "title") for t, _ in stack):
            out.append(Block(text, tuple(stack), linked))
        parts.clear()
        linked = 0

    def close(names: frozenset | set, within: frozenset | set = frozenset()) -> None:
        """End the innermost open element of ``names``, unless one of ``within`` is nearer."""
        nonlocal in_link
        if stack and stack[-1][0] in names:
            tag, _ = stack[-1]
            if tag in _BLOCK:
                flush()
            in_link -= tag == "a"
            stack.pop()
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                if any(t in _BLOCK for t, _ in stack[i:]):
                    flush()
                in_link -= sum(t == "a" for t, _ in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in within:
                return

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html_lib.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    at, in_head = 0, False
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                parts.append(" ")
            elif tag == "p" and not any(t == "p" for t, _ in stack):
                flush()
            else:
                close({tag}, {"td", "th", "table"} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th") and tag not in ("body", "html", "article", "main") else set())
            continue
        if in_head and tag not in _IN_HEAD:
            opened = {t for t, _ in stack}
            if "title" not in opened:  # the first tag that may not stand in a head ends it, as </head> would
                if "head" in opened:
                    flush()
                    close({"head"})
                in_head = False
        in_head |= tag == "head"
        if tag in _VOID:
            if tag == "hr":
                flush()
            else:
                parts.append(" " if tag in ("br", "img", "input") else "")
            continue
        if tag in _RAW:
            if not m[0].endswith("/>") or tag in ("script", "style"):
                end = re.compile(rf"</{tag}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in _BLOCK:
            flush()
            if tag in _ENDS_P:
                close({"p"}, {"td", "th", "button", "table"})
            if tag in _CLOSES:
                close(_CLOSES[tag], {"ul", "ol", "dl", "table", "select", "menu"})
            if tag == "body":
                close({"head"})
        if tag == "a" and in_link:
            close({"a"})
        names: list[str] = []
        if m[3]:
            for name, *values in _ATTR.findall(m[3]):
                value = next(filter(None, values), "")
                if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
                    names += _NAME_PART.findall(value.lower())
                elif name.lower() == "hidden" or name.lower() == "style" and "display:none" in value.replace(" ", "").lower():
                    names.append("hidden")
        in_link += tag == "a"
        stack.append((tag, tuple(names)))
    flush()
    return out


# --- features ---------------------------------------------------------------------------------

#: Name parts that tell what an element is for; others share one feature by absence.
_CUES = frozenset(
    "ad ads advert advertisement advertising adverts aside author banner bar bio body breadcrumb breadcrumbs byline caption category comment "
    "comments complementary consent content contentinfo contact cookie cookies copyright credits dialog discussion disclaimer disqus email entry "
    "figure foot footer form gdpr head header hero hidden hentry legal links lead list login main mainmenu masthead menu message meta modal nav "
    "navbar navigation newsletter notice notification overlay page pager pagination paragraph popup post prev promo promoted promotion publish rail "
    "read reader recommended related reply replies respond responses search secondary section share sharing sidebar signup site skip skyscraper "
    "social sponsor sponsored sponsors sticky story subscribe subscription summary tag tags teaser text toc toolbar top topbar trending user "
    "utility warning widget widgets alert article articlebody next privacy policy main".split()
)


def _bucket(n: int) -> int:
    return min(9, n.bit_length())


def _path_features(path: tuple, known: dict[tuple, tuple[str, list[str]]]) -> tuple[str, list[str]]:
    """The leaf block element, and what the ancestors tell; ``known`` keeps a page's answers."""
    got = known.get(path)
    if got is None:
        leaf = next((t for t, _ in reversed(path) if t in _BLOCK), "none")
        tags = {f"in:{t}" for t, _ in path if t in _BLOCK or t == "a"}
        got = known[path] = leaf, [f"leaf:{leaf}", *sorted(tags), *sorted({f"cue:{n}" for _, names in path for n in names if n in _CUES})]
    return got


def block_features(page: list[Block]) -> list[list[str]]:
    out, known = [], {}
    for b in page:
        size = _bucket(b.text.count(" ") + 1)
        leaf, around = _path_features(b.path, known)
        end = b.text[-1]
        f = [
            "bias", f"words:{size}", f"link:{min(4, 5 * b.linked // len(b.text))}", f"marks:{min(3, b.text.count('.') + b.text.count('!') + b.text.count('?'))}",
            f"end:{'x' if end.isalnum() else end}", f"leaf:{leaf}:words:{min(5, size)}", *around,
        ]
        if "©" in b.text:
            f.append("sign")
        out.append(f)
    if out:
        out[0].append("first")
        out[-1].append("last")
    return out


# --- the chain --------------------------------------------------------------------------------


@dataclass(frozen=True)
class ChainModel:
    """Two labels (0 other, 1 main text). Only differences count: a feature's weight is that of
    label 1 less that of label 0; pair holds the weights of label pairs."""

    weights: dict[str, float]
    pair: tuple[float, float, float, float]  # 00, 01, 10, 11

    def decode(self, feats: list[list[str]]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not feats:
            return []
        weight = self.weights.get
        p00, p01, p10, p11 = self.pair
        a, b, back = 0.0, sum([weight(x, 0.0) for x in feats[0]]), []
        for f in feats[1:]:
            back.append((0 if a + p00 >= b + p10 else 1, 0 if a + p01 >= b + p11 else 1))
            a, b = max(a + p00, b + p10), max(a + p01, b + p11) + sum([weight(x, 0.0) for x in f])
        label = 0 if a >= b else 1
        path = [label]
        for step in reversed(back):
            label = step[label]
            path.append(label)
        return path[::-1]


def fit_chain(pages: list[tuple[list[list[str]], list[int]]], steps: int = 200, ridge: float = 0.002) -> ChainModel:
    """Maximum conditional likelihood with a ridge, by Adam; expectations by forward and
    backward sums over all pages at once, padded to the longest."""
    index: dict[str, int] = {}
    for feats, _ in pages:
        for f in feats:
            for x in f:
                index.setdefault(x, len(index))
    n, longest = len(pages), max(len(f) for f, _ in pages)
    row, col = [], []
    gold, live = np.zeros((n, longest), dtype=int), np.zeros((n, longest), dtype=bool)
    for p, (feats, labels) in enumerate(pages):
        live[p, : len(feats)] = True
        gold[p, : len(feats)] = labels
        for t, f in enumerate(feats):
            row += [p * longest + t] * len(f)
            col += [index[x] for x in f]
    row, col = np.array(row), np.array(col)
    one = np.eye(2)[gold] * live[..., None]
    pair_live = (live[:, 1:] & live[:, :-1])[..., None, None]
    gold_pair = (one[:, :-1, :, None] * one[:, 1:, None, :] * pair_live).sum((0, 1))
    w = np.zeros(2 * len(index) + 4)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)

    def logsum(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        unary, pair = w[:-4].reshape(-1, 2), w[-4:].reshape(2, 2)
        u = np.column_stack([np.bincount(row, weights=unary[col, k], minlength=n * longest) for k in (0, 1)]).reshape(n, longest, 2)
        fwd, bwd = np.zeros_like(u), np.zeros_like(u)
        fwd[:, 0] = u[:, 0]
        for t in range(1, longest):
            ahead = logsum(fwd[:, t - 1, :, None] + pair, 1) + u[:, t]
            fwd[:, t] = np.where(live[:, t, None], ahead, fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            bwd[:, t] = np.where(live[:, t + 1, None], logsum(pair + (u[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), 0.0)
        z = logsum(fwd[:, -1], 1)
        node = np.exp(fwd + bwd - z[:, None, None]) * live[..., None]
        edge = np.exp(fwd[:, :-1, :, None] + pair + (u + bwd)[:, 1:, None, :] - z[:, None, None, None]) * pair_live
        gap = (node - one).reshape(-1, 2)
        g = np.concatenate([
            np.column_stack([np.bincount(col, weights=gap[row, k], minlength=len(index)) for k in (0, 1)]).ravel(),
            (edge.sum((0, 1)) - gold_pair).ravel(),
        ]) / n + ridge * w / 10
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w -= 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    unary = w[:-4].reshape(-1, 2)
    return ChainModel({x: float(unary[i, 1] - unary[i, 0]) for x, i in index.items()}, tuple(w[-4:].tolist()))


# --- labelled pages ---------------------------------------------------------------------------


def _prose(rng: random.Random, low: int, high: int) -> str:
    n, words = rng.randint(low, high), []
    for i in range(n):
        w = "".join(rng.choice("bcdfglmnprstvzéñ") + rng.choice("aeiouüá") for _ in range(rng.randint(1, 4)))
        words.append(w.capitalize() if not i or words[-1].endswith(".") else w)
        if i < n - 1 and rng.random() < 0.1:
            words[-1] += rng.choice([".", ".", ","])
    return " ".join(words) + rng.choice([".", ".", ".", "!", "", " |"])


_WRAPS = {
    "menu": ["<nav>{}</nav>", '<div class="menu">{}</div>', '<ul class="navbar">{}</ul>', '<div id="navigation">{}</div>', '<div role="navigation">{}</div>', '<header><nav>{}</nav></header>', '<div class="breadcrumbs">{}</div>', '<nav class="top-menu">{}</nav>'],
    "header": ["<header>{}</header>", '<div class="header">{}</div>', '<div id="masthead">{}</div>', '<div role="banner">{}</div>', '<div class="site-header">{}</div>'],
    "footer": ["<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer">{}</div>', '<div role="contentinfo">{}</div>', '<div class="site-footer">{}</div>', '<div class="copyright">{}</div>'],
    "sidebar": ["<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="sidebar">{}</div>', '<div class="related">{}</div>', '<section class="widget">{}</section>', '<div role="complementary">{}</div>', '<aside class="related-posts">{}</aside>', '<div class="side-bar">{}</div>'],
    "notice": ['<div class="cookie-notice">{}</div>', '<div id="cookie-banner">{}</div>', '<div class="notice">{}</div>', '<div role="dialog">{}</div>', '<div class="gdpr consent">{}</div>', '<dialog>{}</dialog>', '<div class="alert">{}</div>', '<div class="newsletter-popup">{}</div>', '<div class="cookie">{}</div>', '<div class="subscribe">{}</div>'],
    "advert": ['<div class="ad">{}</div>', '<div class="ads">{}</div>', '<div class="advert">{}</div>', '<div class="sponsored">{}</div>', '<div id="ad-banner">{}</div>', '<aside class="promo">{}</aside>', '<div class="advertisement">{}</div>', '<p class="ad">{}</p>'],
    "form": ["<form>{}</form>", '<form class="search">{}</form>', '<form action="/s"><label>{}</label><input></form>', '<div class="login"><form>{}</form></div>', '<form class="newsletter">{}<button>Go</button></form>', '<div class="form">{}</div>'],
    "comments": ['<section class="comments">{}</section>', '<div id="comments">{}</div>', '<div class="comment">{}</div>', '<ol class="comment-list"><li>{}</li></ol>', '<div class="discussion">{}</div>', '<div class="replies">{}</div>', '<section id="respond">{}</section>', '<div class="reader-comments">{}</div>', '<article class="comment">{}</article>'],
}
_MAIN = ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="content">{}</div>', '<main><article>{}</article></main>', '<div class="post"><div class="entry-content">{}</div></div>', "<article>{}</article>", '<div role="main">{}</div>', '<section class="article-body">{}</section>', "<div><div>{}</div></div>", '<article class="post">{}</article>', '<div id="main">{}</div>']


def _noise(rng: random.Random, kind: str) -> str:
    if kind in ("menu", "header") or kind in ("sidebar", "footer") and rng.random() < 0.5:
        items = [f'<a href="/x">{_prose(rng, 1, 3)}</a>' for _ in range(rng.randint(1, 7))]
        inner = rng.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " ".join(items), "".join(f"<p>{x}</p>" for x in items), "<h2>" + _prose(rng, 1, 4) + "</h2>" + "".join(f"<div>{x}</div>" for x in items)])
        if kind == "header" and rng.random() < 0.5:
            inner = f"<h1>{_prose(rng, 1, 5)}</h1>" + rng.choice([inner, f"<p>{_prose(rng, 2, 12)}</p>"])
    elif kind == "footer":
        inner = "© " + _prose(rng, 2, 20)
    else:
        low, high = (3, 60) if kind in ("comments", "advert", "notice", "sidebar") else (1, 12)
        inner = rng.choice(["{0}", "<p>{0}</p>", "<h3>{1}</h3><p>{0}</p>", "<p>{0}</p><p>{1}</p>", "<ul><li>{0}</li><li>{1}</li></ul>", "<div><p>{0}</p></div>"]).format(_prose(rng, low, high), _prose(rng, 1, 30))
    return rng.choice(_WRAPS[kind]).format(inner)


def _article(rng: random.Random) -> str:
    parts = [f"<h1>{_prose(rng, 1, 12)}</h1>"] if rng.random() < 0.85 else []
    for _ in range(rng.randint(1, 9)):
        p = _prose(rng, *rng.choice([(1, 6), (5, 40), (40, 160)]))
        if rng.random() < 0.15:
            p = f'<a href="/y">{_prose(rng, 1, 3)}</a> ' + p
        parts.append(rng.choice(["<p>{}</p>"] * 7 + ["<p><b>{}<br>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<pre>{}</pre>", "<div>{}</div>", "<ol><li>{}</li></ol>", "<figure><figcaption>{}</figcaption></figure>", "<table><tr><td>{}</td></tr></table>", "<section><p>{}</p></section>"]).format(p))
    return "".join(parts)


def labelled_page(rng: random.Random) -> tuple[list[Block], list[int]]:
    """A made-up page as blocks, with the label of each; marks in the text carry the labels."""
    def marked(text: str, mark: str) -> str:
        return re.sub(r">([^<]+)", lambda m: f">{mark}{m[1]}", text)

    kinds = ["menu", "header", "notice", "advert", "sidebar", "form"]
    before = [_noise(rng, rng.choice(kinds)) for _ in range(rng.randint(0, 4))]
    after = [_noise(rng, rng.choice(["footer", "footer", "sidebar", "comments", "comments", "form", "advert", "notice", "menu"])) for _ in range(rng.randint(0, 4))]
    body = _article(rng)
    if rng.random() < 0.3:
        cut = [m.start() for m in re.finditer(r"<(?:p|h2)>", body)]
        at = rng.choice(cut) if cut else 0
        middle = marked(_noise(rng, rng.choice(["advert", "notice", "form", "sidebar", "comments"])), "\x01")
        body = marked(body[:at], "\x02") + middle + marked(body[at:], "\x02")
    else:
        body = marked(body, "\x02")
    page = "<html><body>" + marked("".join(before), "\x01") + rng.choice(_MAIN).format(body) + marked("".join(after), "\x01")
    found = blocks(page)
    labels = [int("\x02" in b.text) for b in found]
    for b in found:
        b.text = _SPACE.sub(" ", b.text.replace("\x01", "").replace("\x02", "")).strip() or "x"
    return found, labels


@lru_cache
def trained(pages: int = 700, seed: int = 5) -> ChainModel:
    """The model fitted on made-up labelled pages: always the same for the same arguments."""
    rng = random.Random(seed)
    made = [labelled_page(rng) for _ in range(pages)]
    return fit_chain([(block_features(b), y) for b, y in made if b])


# --- the operator -----------------------------------------------------------------------------


def main_text(page: str, model: ChainModel) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, model.decode(block_features(found)), strict=True) if keep)


def extract(pages: DataFrame, model: ChainModel | None = None) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars (its code points).

    The page is cut into leaf blocks; a linear-chain conditional random field labels them from
    ancestor tags, telling class and id names, and the text's size, links and marks; Viterbi
    decoding picks the blocks, joined in page order by a line break. Nothing is cut or capped.

    Null or empty html, and pages without main text, give an empty text and 0. Broken markup
    is read as far as it goes. Repeated rows give equal rows, null ids stay null, extra
    columns are ignored, and an empty table gives an empty result.
    """
    spark = pages.sparkSession
    let_workers_import(spark)
    shared = spark.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p or "", shared.value) for p in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

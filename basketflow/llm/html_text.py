"""Main text of HTML pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the text between two block-level tags. Each has features of
its ancestors (tags, and words of their class, id and role) and of its text. A two-label
chain model, trained here on labelled pages by full-batch gradient ascent of the conditional
likelihood, labels the blocks by Viterbi; the article's blocks are the main text.

Markup is read in one pass whose time grows with the page's length whatever is in it. Scripts,
styles, head, form controls, comments in the markup and hidden elements are no blocks;
hidden by an attribute of that name, aria-hidden="true" or display:none in style. The ends of head,
p, li and the like may be left out; an inline end tag closes nothing beyond its own block. Defined
results: a null or empty page, and one without article blocks, has an empty text; broken
markup is read as far as it goes: a < that begins no tag and an unclosed tag are text, an
attribute's quote that is never closed is part of its value, a tag whose quotes hide every later > (and from there on
every tag) ends at its first >; nothing is cut or dropped by size. Repeated rows come back each;
columns beside page_id, url and html are not read.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[^\s/>]++")
_SPACE = re.compile(r"[\s/]*+")
_ATTRIBUTE = re.compile(r"=?[^\s/>=]*+")
_VALUE = re.compile(r"\s*+=\s*+")
_BARE = re.compile(r"[^\s>]*+")
_WORD = re.compile(r"[a-z]+")
_CSS_COMMENT = re.compile(r"/\*.*?\*/", re.S)
#: HTML's element groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style noscript template head title textarea select option button svg math iframe object canvas audio video datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_ROW, _PART = frozenset(("tr", "td", "th")), frozenset(("tr", "td", "th", "tbody", "thead", "tfoot"))
_CLOSES = {"li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": _ROW, "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "tbody": _PART, "thead": _PART, "tfoot": _PART}
#: What words of tags, classes and ids say about what is below.
ROLES = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs skip",
    "header": "header masthead banner topbar top logo",
    "footer": "footer foot bottom colophon copyright legal imprint",
    "aside": "aside sidebar side widget related recommended rail complementary teaser trending popular",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense banner commercial",
    "notice": "notice cookie cookies consent gdpr alert warning modal popup overlay dialog message",
    "form": "form search login signup subscribe newsletter register input contact",
    "comment": "comment comments reply replies discussion disqus respond thread reader",
    "share": "share sharing social follow buttons tools meta byline tags",
    "article": "article post story entry blogpost",
    "content": "main content body text prose maincontent articlebody",
}
_ROLE_OF = {w: [r for r, ws in ROLES.items() if w in ws.split()] for ws in ROLES.values() for w in ws.split()}


@lru_cache(maxsize=1 << 14)
def _roles(word: str) -> tuple[str, ...]:
    """Roles of a word, or of the longest known word of five letters or more that it begins with."""
    return next((tuple(_ROLE_OF[word[:n]]) for n in (len(word), *range(min(len(word) - 1, 16), 4, -1)) if word[:n] in _ROLE_OF), ())


_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "div", "blockquote", "pre", "figcaption", "section", "article", "body", "dd", "dt")
_SAYS = (("copyright", re.compile(r"©|\(c\)|all rights reserved|copyright", re.I)), ("asks", re.compile(r"\b(cookies?|subscribe|sign up|log in|newsletter|share this|accept|privacy policy|advertisement|sponsored)\b", re.I)), ("replies", re.compile(r"\b(repl(?:y|ies)|comments?|said:|wrote:)\b", re.I)))


def _hidden(values: dict[str, str]) -> bool:
    """Whether a tag's attributes hide it."""
    if values.get("hidden", "until-found").lower() != "until-found" or values.get("aria-hidden", "").lower() == "true":
        return True
    shown, fixed = "", False
    for part in _CSS_COMMENT.sub("", values.get("style", "").lower()).split(";"):
        name, _, value = part.partition(":")
        if name.strip() == "display":
            value, mark, _ = value.partition("!")
            if mark or not fixed:
                shown, fixed = value.strip(), bool(mark)
    return shown == "none"


def _attributes(page: str, at: int, last: dict[str, int]) -> tuple[dict[str, str], int]:
    """A tag's attributes from behind its name, of one name the first, and where the tag ends (-1: nowhere)."""
    values: dict[str, str] = {}
    size = len(page)
    while True:
        at = _SPACE.match(page, at).end()
        if at >= size:
            return values, -1
        if page[at] == ">":
            return values, at + 1
        m = _ATTRIBUTE.match(page, at)
        name, at, value = m[0].lower(), m.end(), ""
        if eq := _VALUE.match(page, at):
            at = eq.end()
            quote = page[at : at + 1]
            if quote in last and last[quote] > at:
                end = page.index(quote, at + 1)
                value, at = page[at + 1 : end], end + 1
            else:
                m = _BARE.match(page, at)
                value, at = m[0], m.end()
        if name not in values:
            values[name] = html.unescape(value).strip()


def tags(page: str):
    """(start, end, name, whether it ends an element, attributes) of a page's tags in order; of a comment the name is empty."""
    last = {q: page.rfind(q) for q in ("\"", "'")}
    final, at, loose = page.rfind(">"), page.find("<"), False
    while 0 <= at < final:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            yield at, (len(page) if end < 0 else end + 3), "", False, {}
            at = len(page) if end < 0 else page.find("<", end + 3)
            if at < 0 or end < 0:
                return
            continue
        closes = page.startswith("/", at + 1)
        first = page[at + 1 + closes : at + 2 + closes]
        if first.isascii() and first.isalpha():
            m = _NAME.match(page, at + 1 + closes)
            values, end = (None, -1) if loose else _attributes(page, m.end(), last)
            if end < 0:
                loose, end = True, page.find(">", m.end()) + 1
                values = values if values is not None and end <= 0 else _attributes(page[m.end() : end], 0, {})[0]
            if end <= 0:
                return
            yield at, end, m[0].lower(), closes, values
        elif closes or first in ("!", "?"):
            end = page.find(">", at + 1) + 1
            yield at, end, "", False, {}
        else:
            end = at + 1
        at = page.find("<", end)


class _Open:
    """An open element: what is true of everything below it. inline: its open inline elements by name, if it is a block."""

    __slots__ = ("inline", "near", "own", "roles", "skip", "tag")

    def __init__(self, tag, roles, near, own, skip, inline):
        self.tag, self.roles, self.near, self.own, self.skip, self.inline = tag, roles, near, own, skip, inline


_PAGE = _Open("", frozenset(), "none", "none", False, None)


def blocks(page: str | None) -> list[tuple[str, list[str]]]:
    """(text, features) of a page's leaf blocks in order."""
    page = page or ""
    stack: list[_Open] = []
    frames: list[int] = []  # places of the blocks in the stack
    count: dict[str, int] = {}  # open blocks by name
    loose: dict[str, int] = {}  # open inline elements outside all blocks
    endless: set[str] = set()  # raw elements that have no end from here on
    out: list[tuple[str, list[str]]] = []
    parts: list[str] = []
    links, at, gone, in_link, body = 0, 0, 0, False, False  # gone: open elements that are skipped

    def end() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, _features(text, stack[-1] if stack else _PAGE, links / max(1, sum(map(len, parts))))))
            parts.clear()
            links = 0

    def pop(n: int) -> None:
        nonlocal gone
        while len(stack) > n:
            x = stack.pop()
            gone -= x.skip
            if frames and frames[-1] == len(stack):
                frames.pop()
                count[x.tag] -= 1
            else:
                own = stack[frames[-1]].inline if frames else loose
                own[x.tag] -= 1

    def read(text: str) -> None:
        nonlocal links
        if text and stack and stack[-1].tag == "head" and not text.isspace():
            pop(len(stack) - 1)
        if text and not gone:
            parts.append(text)
            if in_link:
                links += len(text)

    size = len(page)
    for start, stop, tag, closes, values in tags(page):
        if start < at:  # inside a script or the like
            continue
        read(page[at:start])
        at = stop
        if tag in BLOCK:
            end()
        if closes:
            if tag == "a":
                in_link = False
            if tag in ("body", "html"):
                continue
            if tag in BLOCK or tag == "head":
                if count.get(tag):
                    pop(next(i for i in reversed(frames) if stack[i].tag == tag))
            elif (stack[frames[-1]].inline if frames else loose).get(tag):
                pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
            continue
        if not tag or tag == "html":
            continue
        if stack and stack[-1].tag == "head" and tag not in HEAD:
            pop(len(stack) - 1)
        if tag in VOID:
            continue
        while frames and tag in BLOCK and ((x := stack[frames[-1]].tag) == "p" or x in _CLOSES.get(tag, ())):
            pop(frames[-1])
        if tag in RAW:
            close = None if tag in endless else re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I).search(page, at)
            if not close:
                endless.add(tag)
            if close or tag in ("script", "style"):
                at = close.end() if close else size
                continue
        if tag == "a":
            in_link = True
        if tag == "body":
            if body:
                continue
            body = True
            pop(0)
        roles = set(_ROLE_OF.get(tag, ()))
        for k in ("class", "id", "role", "itemprop") if tag != "body" else ():
            for w in _WORD.findall(values.get(k, "").lower()):
                roles.update(_roles(w))
        skip = tag in SKIP and tag not in RAW or tag == "head" or bool(values) and _hidden(values)
        block = tag in BLOCK or tag == "head"
        if not (block or roles or skip):
            continue
        above = stack[-1] if stack else _PAGE
        if block:
            frames.append(len(stack))
            count[tag] = count.get(tag, 0) + 1
        else:
            own = stack[frames[-1]].inline if frames else loose
            own[tag] = own.get(tag, 0) + 1
        gone += skip
        stack.append(_Open(tag, above.roles if roles <= above.roles else above.roles | roles, min(roles) if roles else above.near, tag if block else above.own, skip, {} if block else None))
    read(page[at:])
    end()
    return out


def _features(text: str, above: _Open, link: float) -> list[str]:
    own, roles, near, n = above.own, above.roles, above.near, len(text)
    out = ["bias", f"tag:{own if own in _TAGS else 'other'}", f"near:{near}", *(f"in:{r}" for r in roles)]
    if not roles:
        out.append("in:nothing")
    if "article" in roles or "content" in roles:
        out.append("inside")
        out += [f"inside+{r}" for r in roles if r not in ("article", "content")]
        out += [f"inside+{own}"] if own in ("h1", "h2", "p", "li") else []
    out.append(f"len:{0 if n < 25 else 1 if n < 80 else 2 if n < 250 else 3}")
    out.append(f"link:{0 if link == 0 else 1 if link < 0.5 else 2}")
    out.append(f"stop:{text[-1] in '.!?:;'}")
    out += [f"says:{k}" for k, p in _SAYS if 300 * sum(1 for _ in p.finditer(text)) >= n]
    return out


def labelled_pages(n: int = 400, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Pages (html, texts of their article's blocks in order), made by rule in many layouts."""
    rng = random.Random(seed)
    syllables = [a + b for a in "b d f g k l m n p r s t v z th st".split() for b in "a e i o u en er an on".split()]

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(lo, hi)))

    def sentence(lo: int = 3, hi: int = 30) -> str:
        return words(lo, hi).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 2)}</a></li>' for i in range(k)) + "</ul>"

    def wrap(kind: str, body: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "notice": "div", "ad": "div", "comment": "section", "share": "div"}[kind]
        word = rng.choice(ROLES[kind].split())
        if tag not in ("div", "section") and rng.random() < 0.5:
            return f"<{tag}>{body}</{tag}>"
        tag = rng.choice(["div", "div", "section", tag])
        return f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(["", "site-", "page "])}{word}">{body}</{tag}>'

    def other(kind: str) -> str:
        body = {
            "nav": lambda: links(rng.randint(3, 8)), "header": lambda: f"<h1>{words(1, 3)}</h1><p>{sentence(2, 6)}</p>" if rng.random() < 0.6 else f"<a href='/'>{words(1, 2)}</a>",
            "footer": lambda: rng.choice([f"&copy; {words(1, 3)}", f"<p>&copy; {words(1, 2)}. All rights reserved.</p>{links(3)}", f"<p>{sentence(3, 12)}</p>"]),
            "aside": lambda: f"<h3>{words(1, 3)}</h3>" + rng.choice([links(4), f"<p>{sentence()}</p>"]), "form": lambda: f"<label>{words(1, 3)}</label><input name=q><p>{sentence(2, 9)}</p><button>{words(1, 1)}</button>",
            "notice": lambda: rng.choice([f"<p>{sentence(4, 20)}</p>", sentence(4, 20) + " Cookies."]), "ad": lambda: rng.choice([sentence(3, 14), f"<p>{sentence(3, 20)}</p>", f"<a href=x>{words(2, 6)}</a>"]),
            "comment": lambda: "".join(rng.choice([f"<p>{sentence()}</p>", f'<div class="comment"><b>{words(1, 2)}</b><p>{sentence()}</p></div>']) for _ in range(rng.randint(1, 4))),
            "share": lambda: links(3),
        }[kind]()
        return wrap(kind, body)

    pages = []
    for _ in range(n):
        own: list[str] = []

        def keep(text: str, own=own) -> str:
            own.append(" ".join(text.split()))
            return text

        body = [f"<h1>{keep(words(2, 9).capitalize())}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 14)):
            x = rng.random()
            if x < 0.42:
                body.append(f"<p>{keep(sentence(1, 60))}" + rng.choice(["</p>", "</p>", ""]))
            elif x < 0.52:
                one, two, three = sentence(1, 30), words(1, 8), rng.choice([sentence(1, 30), sentence(1, 6), "."])
                one = one if rng.random() < 0.85 else ""
                keep(f"{one} {two} {three}")
                body.append(f"<p>{one} {rng.choice(['<a href=/x>', '<a href=/x>', '<em>', '<strong>', '<code>'])}{two}</a></em> {three}</p>")
            elif x < 0.6:
                body.append(f"<{(h := rng.choice(['h2', 'h2', 'h3', 'h4']))}>{keep(words(1, 6).capitalize())}</{h}>")
            elif x < 0.68:
                linked = rng.random() < 0.3
                body.append((tag := rng.choice(["<ul>", "<ol>"])) + "".join("<li>" + ("<a href=/y>" if linked else "") + f"{keep(sentence(2, 12))}</a></li>" for _ in range(rng.randint(2, 5))) + f"</{tag[1:]}")
            elif x < 0.71:
                body.append(f"<blockquote><p>{keep(sentence(4, 30))}</p></blockquote>")
            elif x < 0.76:
                rows = [[keep(words(1, 4)) for _ in range(2)] for _ in range(rng.randint(1, 4))]
                body.append("<table>" + "".join("<tr>" + "".join(f"<{(c := rng.choice(['td', 'td', 'th']))}>{x}</{c}>" for x in r) + "</tr>" for r in rows) + "</table>")
            elif x < 0.81:
                terms = "".join(f"<dt>{keep(words(1, 3))}</dt><dd>{keep(sentence(2, 20))}</dd>" for _ in range(rng.randint(1, 3))) if rng.random() < 0.5 else ""
                body.append(f"<dl>{terms}</dl>" if terms else rng.choice([lambda: f"<pre>{keep(words(2, 9))}</pre>", lambda: f"<figure><img src=z><figcaption>{keep(sentence(2, 12))}</figcaption></figure>"])())
            elif x < 0.85:
                body.append(f"<p><b>{keep(sentence(1, 8))}<br>")
            else:
                body.append(other(rng.choice(["ad", "ad", "aside", "share", "share", "form", "notice"])))
        open_, close = rng.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"), ('<div class="post-body">', "</div>"), ('<div class="entry">', "</div>"), ("<div>", "</div>"), ("<div>", "</div>"), ("", ""), ("", "")])
        few = rng.choice([0.1, 0.5, 0.5])
        before = [other(k) for k in ("notice", "header", "nav", "form", "ad", "aside") if rng.random() < few]
        after = [other(k) for k in ("share", "comment", "aside", "ad", "form", "notice", "footer") if rng.random() < few]
        pages.append((f"<html><head><title>{words(2, 5)}</title></head><body>" + "".join([*before, open_, *body, close, *after]) + "</body></html>", own))
    return pages


class Chain:
    """Two-label chain: weights of features, and of label pairs."""

    def __init__(self, pages: list[tuple[str, list[str]]], rounds: int = 200, rate: float = 0.1, decay: float = 2e-3):
        seqs = []
        for page, own in pages:
            got, k = blocks(page), 0
            y = []
            for text, _ in got:
                hit = k < len(own) and text == own[k]
                k += hit
                y.append(int(hit))
            if got:
                seqs.append(([f for _, f in got], y))
        names = sorted({f for fs, _ in seqs for b in fs for f in b})
        self.index = {f: i for i, f in enumerate(names)}
        b, n, d = len(seqs), max(len(y) for _, y in seqs), len(names)
        x, y, on = np.zeros((b, n, d)), np.zeros((b, n), int), np.zeros((b, n), bool)
        for i, (fs, ys) in enumerate(seqs):
            on[i, : len(ys)], y[i, : len(ys)] = True, ys
            for j, f in enumerate(fs):
                x[i, j, [self.index[v] for v in f]] = 1
        w, t = np.zeros((d, 2)), np.zeros((2, 2))
        true = np.eye(2)[y] * on[..., None]
        true_pairs = np.einsum("bna,bnc->ac", true[:, :-1], true[:, 1:])
        moments = [np.zeros_like(w), np.zeros_like(t), np.zeros_like(w), np.zeros_like(t)]
        for step in range(1, rounds + 1):
            own, pairs = self._expected(x @ w, t, on)
            grads = [np.einsum("bnd,bna->da", x, true - own) / b - decay * w, (true_pairs - pairs) / b - decay * t]
            for i, (p, g) in enumerate(zip((w, t), grads, strict=True)):
                moments[i] = 0.9 * moments[i] + 0.1 * g
                moments[i + 2] = 0.99 * moments[i + 2] + 0.01 * g * g
                p += rate * (moments[i] / (1 - 0.9**step)) / (np.sqrt(moments[i + 2] / (1 - 0.99**step)) + 1e-8)
        self.w, self.t = w, t

    @staticmethod
    def _expected(s, t, on):
        """Marginals of labels and summed marginals of label pairs (forward-backward, in logs)."""
        b, n, _ = s.shape
        f, r = np.zeros_like(s), np.zeros_like(s)
        f[:, 0] = s[:, 0]
        for j in range(1, n):
            f[:, j] = np.where(on[:, j, None], s[:, j] + np.logaddexp(f[:, j - 1, 0, None] + t[0], f[:, j - 1, 1, None] + t[1]), f[:, j - 1])
        for j in range(n - 2, -1, -1):
            nxt = s[:, j + 1] + r[:, j + 1]
            r[:, j] = np.where(on[:, j + 1, None], np.logaddexp(t[:, 0] + nxt[:, 0, None], t[:, 1] + nxt[:, 1, None]), 0)
        z = np.logaddexp(f[:, -1, 0], f[:, -1, 1])[:, None, None]
        own = np.exp(np.minimum(f + r - z, 0)) * on[..., None]
        pair = f[:, :-1, :, None] + t + (s[:, 1:] + r[:, 1:])[:, :, None, :] - z[..., None]
        return own, (np.exp(np.minimum(pair, 0)) * on[:, 1:, None, None]).sum((0, 1))

    def labels(self, features: list[list[str]]) -> list[int]:
        """Viterbi."""
        w, t = self.w, self.t.tolist()
        back, a, b = [], 0.0, 0.0
        for k, f in enumerate(features):
            s0, s1 = w[[i for v in f if (i := self.index.get(v)) is not None]].sum(0).tolist()
            if k:
                p0, p1 = a + t[0][0] < b + t[1][0], a + t[0][1] < b + t[1][1]
                back.append((p0, p1))
                a, b = (b + t[1][0] if p0 else a + t[0][0]) + s0, (b + t[1][1] if p1 else a + t[0][1]) + s1
            else:
                a, b = s0, s1
        out = [int(b > a)]
        for p in reversed(back):
            out.append(int(p[out[-1]]))
        return out[::-1]

    def text(self, page: str | None) -> str:
        got = blocks(page)
        return "\n".join(x for (x, _), y in zip(got, self.labels([f for _, f in got]), strict=True) if y) if got else ""


@lru_cache(maxsize=1)
def trained() -> Chain:
    return Chain(labelled_pages())


def extracted(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """pages (page_id, url, html) to (page_id, url, text, n_chars)."""
    held = pages.sparkSession.sparkContext.broadcast(chain or trained())

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = [held.value.text(x.as_py()) for x in b.column(2)]
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(run, rows.select("page_id", "url", F.lit("").cast("string").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema)

"""Main text of web pages: flat text blocks, judged by a decision tree.

A page is read once, left to right, in time that grows with its length, at any depth of containers: `<` ends an
unfinished tag, an end tag finds the last open container of its name at once, and an end tag that never comes hides
nothing but what a browser hides too (script, style, comments). A block tag ends a text block. Each block has its
word count and link density, those of the two blocks before and after it, its tag, how it is punctuated, and where
it stands: in an article, after one, in a menu, footer, aside or form, in a container with a name that tells. No
word of the text itself counts. A decision tree keeps or drops it. It is grown here on a small labelled table: the
blocks of PAGES pages laid out by chance (`layout`), with and without containers, with telling, empty and misleading
names, with menus and link lists of short and long link texts, adverts, notices and comments in and around the
article. So no single mark decides: without containers word counts and link densities do.

Null or empty html, or no kept block: the empty text. Unclosed and cut-off markup is read as far as it
goes. Extra columns are ignored; repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import html as _html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read
from .texts import arrow_batches, batch_of

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile("[<>\"']")
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
#: What these hold is no text. Without an end tag, script and style hide the rest, the others only their tag.
RAW = frozenset("script style noscript template svg iframe object select textarea title".split())
_ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINER = frozenset("article main section div nav header footer aside form ul ol dl table td th tr blockquote figure fieldset menu dialog body".split())
#: Tag -> the kind of place it opens.
PLACE = {"nav": "nav", "menu": "nav", "header": "nav", "footer": "foot", "aside": "aside", "form": "form", "fieldset": "form", "button": "form", "dialog": "form"}
#: Parts of a class or id that name what isn't the article.
BAD_NAMES = frozenset("nav navbar navigation menu footer foot sidebar side ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice alert popup modal share sharing social comment comments disqus reply replies breadcrumb breadcrumbs related recommended widget newsletter subscribe pagination pager copyright masthead toolbar login signup".split())
GOOD_NAMES = frozenset("article content post entry story main body text".split())
#: Containers that an end tag of another name doesn't close from inside.
CELLS = frozenset("td th".split())
TAGS = ("p", "h", "li", "td", "pre", "other")
PLACES = ("article", "named", "nav", "foot", "aside", "form", "bad", "hidden")
NEAR = ("words", "density")
FEATURES = (*NEAR, *(f"{x}_{side}{k}" for k in (1, 2) for side in ("before", "after") for x in NEAR), "marks", "sentence", "outside", "after_article", "page_has_article", "page_has_named", *(f"in_{x}" for x in PLACES), *(f"is_{x}" for x in TAGS[:5]), "before_is_h")


def tokens(page: str):
    """(text, None, False, "") and ("", tag, closing, attributes) in page order, comments and RAW left out."""
    at, n = 0, len(page)
    last = {q: page.rfind(q) for q in "\"'"}  # no quote closes beyond it
    endless: set[str] = set()  # RAW tags that no end tag follows any more
    while at < n:
        i = page.find("<", at)
        if i < 0:
            yield page[at:], None, False, ""
            return
        if i > at:
            yield page[at:i], None, False, ""
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            if end < 0:
                return
            at = end + 3
            continue
        if page[i + 1 : i + 2] in ("!", "?"):
            end = page.find(">", i)
            if end < 0:
                return
            at = end + 1
            continue
        m = _NAME.match(page, i + 1)
        if not m:
            yield "<", None, False, ""
            at = i + 1
            continue
        p, begin = m.end(), m.end()
        while True:
            stop = _STOP.search(page, p)
            if stop is None or stop[0] in "<>":
                break
            p = stop.end()
            if page[p - 2] in "= \t\n":  # a quote that opens a value
                p = page.find(stop[0], p) + 1 if p <= last[stop[0]] else p
        end = n if stop is None else stop.start()
        at = end + 1 if stop is not None and stop[0] == ">" else end
        name, closing, attributes = m[2].lower(), bool(m[1]), page[begin:end]
        if name in RAW:
            if closing or attributes.endswith("/") and name in ("svg", "iframe", "object"):
                continue
            found = None if name in endless else _ENDS[name].search(page, at)
            if found:
                at = found.end()
            elif name in ("script", "style"):
                return
            else:
                endless.add(name)
            continue
        yield "", name, closing, attributes


def places(name: str, attributes: str, inside: frozenset) -> frozenset:
    """What a container adds to where its blocks stand. An article or main begins anew, whatever it stands in."""
    names, hidden = set(), False
    for a in _ATTR.finditer(attributes):
        key, value = a[1].lower(), (a[2] or "").lower()
        if key in ("class", "id", "role"):
            names.update(_SPLIT.split(value))
        elif key == "hidden" or key == "style" and "display:none" in value.replace(" ", "") or key == "aria-hidden" and "true" in value:
            hidden = True
    out = set(inside)
    if name in ("article", "main"):
        out = {"article"} | inside & {"hidden"}
        if name == "article" and names & BAD_NAMES and not names & GOOD_NAMES:
            out.add("bad")  # a comment or a teaser
    elif name in PLACE and not (name == "header" and "article" in inside):
        out.add(PLACE[name])
    if name not in ("article", "main", "body"):
        if names & BAD_NAMES:
            out.add("bad")
        elif names & GOOD_NAMES:
            out = out - {"bad"} | {"named"} if "article" not in inside else out | {"named"}
    if hidden:
        out.add("hidden")
    return frozenset(out)


def blocks(page: str) -> list[tuple]:
    """(text, words, linked words, places, tag, after an article) of each block."""
    out: list = []
    stack: list[tuple[str, frozenset]] = []
    open_: dict[str, list[int]] = {}  # places in the stack of each open name
    cells: list[int] = []
    inside, parts, linked = frozenset(), [], []
    in_a, tag, after = False, "other", False

    def end() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                out.append((text, text.count(" ") + 1, len(_html.unescape(" ".join(linked)).split()), inside, tag, after))
            parts, linked = [], []

    for text, name, closing, attributes in tokens(page):
        if name is None:
            parts.append(text)
            if in_a:
                linked.append(text)
        elif name in INLINE:
            if name == "a":
                in_a = not closing
            elif name == "br":
                parts.append(" ")
        elif closing:
            end()
            in_a, tag = False, "other"
            at = open_.get(name)
            if at and (not cells or at[-1] >= cells[-1] or name in ("table", "tr")):
                k = at[-1]
                after = after or "article" in inside and "article" not in stack[k][1]
                inside = stack[k][1]
                for gone, _ in stack[k:]:
                    open_[gone].pop()
                del stack[k:]
                while cells and cells[-1] >= k:
                    cells.pop()
        else:
            end()
            in_a = False
            tag = "h" if len(name) == 2 and name[0] == "h" and name[1] in "123456" else "li" if name in ("li", "dt", "dd") else "td" if name in CELLS else name if name in TAGS else "other"
            if name in CONTAINER or name in PLACE:
                if name in CELLS:
                    cells.append(len(stack))
                open_.setdefault(name, []).append(len(stack))
                stack.append((name, inside))
                inside = places(name, attributes, inside)
    end()
    return out


_MARKS = re.compile(r"[.!?…。,;:]")


def features(pages: list[list]) -> np.ndarray:
    """A row for each block of all pages, one page after the other."""
    found = [b for page in pages for b in page]
    if not found:
        return np.zeros((0, len(FEATURES)))
    at = np.repeat(np.arange(len(pages)), [len(page) for page in pages])
    words = np.array([b[1] for b in found], float)
    density = np.minimum(1.0, np.array([b[2] for b in found]) / words)

    def shift(x: np.ndarray, k: int) -> np.ndarray:
        """x of the block k before (after, if negative) on the same page, else 0."""
        out = np.zeros(len(x))
        if k > 0:
            out[k:] = np.where(at[k:] == at[:-k], x[:-k], 0)
        else:
            out[:k] = np.where(at[:k] == at[-k:], x[-k:], 0)
        return out

    places_ = {p: np.fromiter((p in b[3] for b in found), bool, len(found)) for p in PLACES}
    has, named = (np.bincount(at, places_[p], len(pages))[at] > 0 for p in ("article", "named"))
    tag = np.array([b[4] for b in found])
    near = [shift(x, k) for k in (1, -1, 2, -2) for x in (words, density)]
    flags = [[len(_MARKS.findall(b[0])) for b in found], [b[0][-1] in ".!?…。:;\"”»" for b in found], has & ~places_["article"], [b[5] for b in found], has, named]
    flags += [*places_.values(), *(tag == t for t in TAGS[:5]), shift((tag == "h").astype(float), 1)]
    return np.stack([words, density, *near, *(np.asarray(f, float) for f in flags)], axis=1)


# ---- the labelled table -----------------------------------------------------------------------

#: Pages of the table and the seed of their layout.
PAGES, SEED = 1000, 11
KEEP = "keep"


def layout(rng: random.Random) -> str:
    """A page; a block is article if its text begins with KEEP. Pages of three kinds: with an article or main
    (`held`), with a container whose name tells (`named`), and with neither, where long text is all that tells."""
    pick, chance = rng.choice, lambda p: rng.random() < p
    kind = pick(["held"] * 5 + ["named"] * 2 + ["bare"] * 3)
    held, bare = kind == "held", kind == "bare"
    words = lambda a, b: " ".join("w" * rng.randint(1, 9) + pick([""] * 7 + [","]) for _ in range(rng.randint(a, b)))
    said = lambda a, b: words(a, b) + pick(["."] * 5 + ["?", "!"])
    link = lambda a, b: f"<a href=/x>{words(a, b)}{pick(['', '', '', '.', '?', '!'])}</a>"
    box = lambda names, inner: f"<{pick(['div', 'div', 'section'])} class='{pick(names)}'>{inner}</div></section>"
    plain = ["row", "c1", "x", "wrap"]

    def links(a: int = 1, b: int = 0) -> str:
        """A list of links, of short texts or of headlines."""
        b = b or pick([2, 4, 4, 9, 14])
        items = [link(max(1, b // 2) if chance(0.7) else a, b) + pick(["", "", "", f" {words(1, 3)}"]) for _ in range(rng.randint(2, 9))]
        form = rng.random()
        if form < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        if form < 0.75:
            return "".join(f"<div>{x}</div>" for x in items)
        if form < 0.85:
            return "".join(f"<p>{x}</p>" for x in items[:3]) if not held else "<div>" + " | ".join(items) + "</div>"
        return pick(["<p>{}</p>", "<div>{}</div>"]).format(pick([" | ", " ", " - "]).join(items))

    def heading(level: int = 2) -> str:
        return f"<h{rng.randint(level, 4)}>{KEEP} {words(0, 8)}</h2>"

    def para() -> str:
        form = rng.random()
        if form < 0.6:
            inner = f"{KEEP} {said(1 if not bare else 7, 80)}"
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                inner += f" {link(1, 4)} {said(2 if not bare else 6, 30)}"
            return pick([f"<p>{inner}</p>"] * 4 + [f"<div>{inner}</div>", f"<p>{inner}", f"<p><b>{inner}<br>"])
        if form < 0.68:
            if bare:
                return f"<p>{KEEP} {said(10, 30)}</p>"
            return pick([f"<p>{KEEP}{pick(['', '.', ' ' + words(1, 4)])}</p>", f"<p><a href=/x>{KEEP} {words(0, 12)}</a></p>", f"<p><a href=/x>{KEEP} {words(3, 9)}</a>.</p>"])
        if form < 0.78:
            return heading()
        if form < 0.86:
            ending = lambda: pick([said(1, 12), said(2, 20), f"{link(1, 3)} {words(2, 6)}" if not bare else said(4, 9)])
            return pick(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(f"<li>{KEEP} {words(2 if not bare else 5, 12)} {ending()}</li>" for _ in range(rng.randint(2, 6))))
        if form < 0.91:
            return f"<blockquote>{KEEP} {said(6, 40)}</blockquote>"
        if form < 0.95:
            return f"<pre>{KEEP} {words(2, 30)}</pre>" if not bare else f"<p>{KEEP} {said(20, 60)}</p>"
        return "<table>" + "".join(f"<tr><td>{KEEP} {words(0, 5)}</td><td>{KEEP} {words(0, 5)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>" if held else f"<p>{KEEP} {said(12, 50)}</p>"

    def between() -> str:
        return pick([
            box(["ad", "advert box", "sponsored"], said(3, 40)), box(["share", "social-bar"], words(1, 6) + links(1, 2)), box(["related", "promo", "related-posts"], f"<h3>{words(1, 3)}</h3>{links()}"),
            f"<aside><p>{said(5, 60)}</p></aside>", f"<aside class={pick(['related', 'x'])}>{pick(['', f'<h3>{words(1, 4)}</h3>'])}{links()}</aside>", f"<nav>{links()}</nav>",
            f"<form><p>{words(2, 25)}</p><input><button>{words(1, 2)}</button></form>", box(["newsletter", "cookie-notice", "alert"], f"<p>{said(4, 40)}</p>"), f"<div style='display:none'>{said(3, 50)}</div>", links(3, 10) if not held else f"<nav>{links()}</nav>",
        ])

    def comments(inside: bool = False) -> str:
        inner = "".join(pick(["<p>{}</p>", "<li>{}</li>", "<div>{}</div>", "<article class=comment><p>{}</p></article>"]).format(said(2, 70)) for _ in range(rng.randint(1, 6)))
        head = f"<h3>{words(1, 3)}</h3>" * chance(0.5)
        return pick([box(["comments", "comment-list", "replies"], head + inner), f"<section id=comments>{head}{inner}</section>"] + ([box(plain, head + inner)] if held and not inside else []))

    body = f"<h1>{KEEP} {words(0, 10)}</h1>" if chance(0.7) else ""
    if chance(0.15):
        body = heading()
    for _ in range(rng.randint(1, 9)):
        body += para() + (between() if chance(0.25) else "")
    if not held:  # nothing but its paragraphs tells such an article
        body += f"<p>{KEEP} {said(15, 60)}</p>"
    if held and chance(0.2):
        body += comments(True)
    if held:
        shell = pick(["<article>{}</article>"] * 3 + ["<main>{}</main>", "<main><article>{}</article></main>", "<article class='post x'><div class=content>{}</div></article>", "<div class='page with-sidebar'><article>{}</article></div>", "<main><div class=row><div class=c1>{}</div></div></main>"])
    elif bare:
        shell = pick(["{}", "<div class=x>{}</div>", "<table><tr><td>{}</td></tr></table>", "<section>{}</section>", "<div class=row><div class=c1>{}</div></div>"])
    else:
        shell = pick(["<div class=content>{}</div>", "<div id=post-12>{}</div>", "<section class='entry body'>{}</section>", "<div class='story text'>{}</div>"])
    if chance(0.15):
        shell = "<div>" * rng.randint(1, 90) + shell
    body = shell.format(body)
    if kind == "named" and chance(0.4):  # the container begins late or ends early
        body = f"<p>{KEEP} {said(12, 60)}</p>" * chance(0.7) + body + f"<p>{KEEP} {said(12, 60)}</p>" * chance(0.5)
    top = pick([f"<nav>{links()}</nav>"] * 2 + [f"<nav>{'<div>' * rng.randint(1, 80)}{links()}</nav>", f"<header><div>{words(1, 4)}</div>{links()}</header>", f"<div id=menu>{links()}</div>", links(), f"<header><h1>{words(1, 3)}</h1></header><nav>{links()}</nav>", f"<header>{words(1, 12)}</header><div role=navigation>{links()}</div>"])
    top = top if chance(0.8) else ""
    top += box(["banner ad", "notice", "cookie-consent", "ad"], said(3, 40)) if chance(0.45) else ""
    top += f"<div class=x><p>{said(1, 40)}</p></div>" if held and chance(0.3) else ""
    foot = comments() if chance(0.4) else ""
    foot += pick([f"<aside><h3>{words(1, 3)}</h3><p>{said(10, 60)}</p></aside>", f"<aside>{links()}</aside>", box(["sidebar", "side widget"], f"<p>{said(5, 50)}</p>{links()}"), box(plain, links()), links(4, 12), f"<h3>{words(1, 4)}</h3>{links()}", box(plain, f"<h3>{words(1, 4)}</h3>{links()}")]) if chance(0.7) else ""
    foot += box(plain, f"<p>{said(2, 60)}</p>") if held and chance(0.4) else ""
    if held and chance(0.2):  # a second article
        foot += pick(["", links()]) + f"<article><h2>{KEEP} {words(1, 6)}</h2>{para()}</article>"
    foot += "" if chance(0.15) else pick([f"<footer>{said(3, 50)}</footer>", f"<footer>{words(3, 20)} {link(1, 3)}</footer>", f"<div id=footer>{words(2, 20)} {link(1, 3)}</div>", f"<div>{link(1, 2)} | {link(1, 2)} {words(0, 2)}</div>", f"<footer><p>{said(5, 40)}</p>{links()}</footer>"])
    return f"<html><body>{top}{body}{foot}</body></html>"


def labelled(pages: int = PAGES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = random.Random(seed)
    found = [blocks(layout(rng)) for _ in range(pages)]
    return features(found), np.array([b[0].startswith(KEEP) for page in found for b in page], float)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 20, least: int = 4):
    """A binary tree by Gini impurity: a share of kept blocks, or (feature, limit, below, above)."""
    n, best = len(y), (y.var() * len(y) - 1e-9, None)
    if depth and n >= 2 * least and best[0] > 0:
        k = np.arange(1, n)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, s = x[order, f], np.cumsum(y[order])
            low, high = s[:-1], s[-1] - s[:-1]
            loss = low - low * low / k + high - high * high / (n - k)
            loss[(v[1:] == v[:-1]) | (k < least) | (n - k < least)] = np.inf
            i = int(loss.argmin())
            if loss[i] < best[0]:
                best = (loss[i], (f, float(v[i] + v[i + 1]) / 2))
    if best[1] is None:
        return float(y.mean())
    f, limit = best[1]
    low = x[:, f] < limit
    return (f, limit, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def judge(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree >= 0.5)
    f, limit, low, high = tree
    below = x[:, f] < limit
    out = np.empty(len(x), bool)
    out[below], out[~below] = judge(low, x[below]), judge(high, x[~below])
    return out


@functools.cache
def grown():
    """The tree on the labelled table."""
    return grow(*labelled())


def main_texts(pages: list[str | None], tree) -> list[str]:
    found = [blocks(page or "") for page in pages]
    kept = iter(judge(tree, features(found)).tolist())
    return ["\n".join([b[0] for b in page if next(kept)]) for page in found]


def main_text(page: str | None, tree) -> str:
    return main_texts([page], tree)[0]


#: Characters of html whose blocks a task holds at once; one longer page is held on its own.
TOGETHER = 1 << 20


def _groups(pages):
    """Consecutive pages of TOGETHER characters."""
    group, size = [], 0
    for page in pages:
        if group and size + len(page or "") > TOGETHER:
            yield group
            group, size = [], 0
        group.append(page)
        size += len(page or "")
    if group:
        yield group


def extract(df: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of page_id, url, html."""
    arrow_batches(df.sparkSession)
    tree = grown()

    def run(batches):
        for batch in batches:
            texts = [t for group in _groups(x.as_py() for x in batch.column(2)) for t in main_texts(group, tree)]
            yield batch_of(page_id=batch.column(0).cast(pa.int64()), url=batch.column(1), text=pa.array(texts, pa.string()), n_chars=pa.array([len(t) for t in texts], pa.int64()))

    return df.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


QUERIES = {"op4_html": op4_html}

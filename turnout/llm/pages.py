"""Main text of web pages by the container paths that the pages of a host agree on.

Each page's containers are scored by the text that is not in links; scores vote for generalised
tag-and-class paths, per host in Spark.  From the winning path its host goes up to the smallest path
that holds nearly all text on half of the pages, as an article may lie in several parts, but not
beyond an article or main.  Then every page is extracted again with that path.  A page without an element of that path, or with none that has text, uses its own best one.

Words in classes and ids are evidence, not a verdict.  A compound name counts by its last word, or if all its other words
only say what kind of box it is: post-comments and ad-slot are marked, share-price and social-post are not.  Headings and
paragraphs go only as adverts.  Where marked elements hold nearly all text of a page, words count nothing there.

Null or empty html gives empty text; a null url's pages vote together under an empty host.  Long
pages are handled whole and in linear time; containers more than ``DEPTH`` deep count as part of the one there.  Repeated rows give repeated results, an empty table
an empty one, other columns are ignored.  Equal votes go to the first path in order.
"""

from __future__ import annotations

import html as markup
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnout.llm.base import apart, batched, saved
from turnout.llm.urls import address

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split())
CONTAINERS = frozenset("body div section article main td center details blockquote".split())
#: Elements that never hold the article's text.
LEFT_OUT = frozenset(
    "head nav footer aside form script style noscript template svg math canvas object audio video iframe button select "
    "option textarea dialog menu title input".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Words of a class or id that mark menus, headers, footers, sidebars, notices, adverts, forms and comments.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar sidebars "
    "menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent notice notices "
    "gdpr popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended "
    "recommendations comment comments commentlist disqus reply replies respond discussion widget widgets toolbar "
    "pagination pager skip".split())
#: Words of a class that only say what kind of box it is.
BOXES = frozenset(
    "area author bar block body bottom box btn bubble button buttons col column container content floating footer form grid header "
    "heading holder icon icons inline inner item items label large left link links list main meta mobile articles posts stories news "
    "options outer panel popup posts region right row rows section slot small space sticky tags text thread title top unit "
    "units wrap wrapper zone".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6".split())
NOT_MARKED = frozenset("html body main article".split())
HAS = ("has-", "with-", "no-")
SEMANTIC = {"article": 1.0, "main": 0.8}
ROLL_UP = 0.5
#: Containers of a path, at most; and the share of a page's text below which what words leave is no article.
DEPTH = 256
REMAINS = 0.1
VOTE = 1000
#: The share of an article's or, without one, a page's text that a path holds to be its whole.
NEARLY = 0.95


class Container(NamedTuple):
    parent: int
    name: str
    path: str


class Page(NamedTuple):
    """Containers (the first is the page itself) and the pieces of text: container, text, in a link."""
    containers: list[Container]
    pieces: list[tuple[int, str, bool]]


def attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)} if "=" in rest or "hidden" in rest else {}


def left_out(name: str, has: dict[str, str], in_article: bool) -> bool:
    """Whether its kind, role or style makes an element, and what it holds, no part of the article."""
    if name in LEFT_OUT or name == "header" and not in_article:
        return True
    return name not in NOT_MARKED and bool(has) and (
        "hidden" in has or has.get("role", "").lower() in OTHER_ROLES or "display:none" in has.get("style", "").replace(" ", "").lower())


def worded(name: str, has: dict[str, str], in_article: bool) -> bool:
    """Whether words in its class or id say so."""
    if not has or name in NOT_MARKED:
        return False
    words = [w for w in f"{has.get('class', '')} {has.get('id', '')}".lower().split() if not w.startswith(HAS)]
    if name in TEXTUAL:
        return any(w in ADVERTS for w in words)
    for word in words:
        parts = [p for p in re.split(r"[-_]+|[0-9]+(?:x[0-9]+)?", word) if p]
        hit = [p in MARKS or p == "header" and not in_article for p in parts]
        if any(hit) and (hit[-1] or all(h or p in BOXES for h, p in zip(hit, parts))):
            return True
    return False


def step(name: str, has: dict[str, str]) -> str:
    """One step of a generalised path: digits of classes and ids are folded."""
    classes = sorted({re.sub(r"[0-9]+", "#", c) for c in has.get("class", "").lower().split()})
    if classes:
        return ".".join([name, *classes])
    return name + ("#" + re.sub(r"[0-9]+", "#", has["id"].lower()) if has.get("id") else "")


def parsed(source: str) -> Page:
    """The page without what is left out by kind, and without what words mark unless that is nearly all of it."""
    page, lost = _parsed(source, True)
    kept = sum(len(text) for _, text, link in page.pieces if text != " " and not link) if lost else 0
    return _parsed(source, False)[0] if kept < REMAINS * (kept + lost) else page


def _parsed(source: str, words: bool) -> tuple[Page, int]:
    """The page, and how much text outside links was dropped for words alone."""
    containers, pieces, paths = [Container(-1, "", "")], [], {}
    depths = [0]
    opened: dict[str, int] = {}
    lost = by_words = 0
    #: open elements that matter: name, container that was current before, dropped (2 for words alone)
    stack: list[tuple[str, int, int]] = []
    now, dropped, links, articles, done, size = 0, 0, 0, 0, 0, len(source)

    def close(n: int) -> None:
        nonlocal now, dropped, articles, by_words
        while len(stack) > n:
            name, before, drop = stack.pop()
            opened[name] -= 1
            now, dropped, articles = before, dropped - (drop > 0), articles - (name in SEMANTIC and not drop)
            by_words -= drop == 2

    while done < size:
        tag = TAG.search(source, done)
        end = tag.start() if tag else size
        if end > done and not dropped:
            text = source[done:end]
            pieces.append((now, markup.unescape(text) if "&" in text else text, links > 0))
        elif end > done and by_words == dropped and not links:
            lost += len(source[done:end].strip())
        if not tag:
            break
        done = tag.end()
        name = tag["name"] or tag["name2"]
        if not name:
            continue
        name, rest = name.lower(), tag["rest"] or tag["rest2"] or ""
        if name not in INLINE and not dropped:
            pieces.append((now, " ", False))
        if tag["end"] or tag["end2"]:
            if name == "a":
                links = 0
            if opened.get(name):
                n = len(stack) - 1
                while stack[n][0] != name:
                    n -= 1
                close(n)
            continue
        if name == "a" and not rest.endswith("/"):
            links = 1
        if name in VOID:
            continue
        if name in RAW:
            raw = RAW_END[name].search(source, done)
            done = raw.start() if raw else size
            continue
        if name not in INLINE and stack and stack[-1][0] in ("p", "li", "td", "option") and (stack[-1][0] in ("p", "option") or stack[-1][0] == name):
            close(len(stack) - 1)
        has = attributes(rest)
        drop = 1 if left_out(name, has, articles > 0) else 2 if words and worded(name, has, articles > 0) else 0
        if rest.endswith("/") and name not in CONTAINERS:
            continue
        if drop or name in CONTAINERS or dropped and name not in INLINE:
            stack.append((name, now, drop))
            opened[name] = opened.get(name, 0) + 1
            if drop:
                dropped += 1
                by_words += drop == 2
            elif not dropped and name in CONTAINERS and depths[now] < DEPTH:
                key = containers[now].path, step(name, has)
                path = paths.get(key) or paths.setdefault(key, "/".join(key))
                containers.append(Container(now, name, path))
                depths.append(depths[now] + 1)
                now = len(containers) - 1
            articles += name in SEMANTIC and not drop
    return Page(containers, pieces), lost


def scores(page: Page) -> list[float]:
    """Of each container: its own text, text in links counted against it, and a share of what it holds.

    An article keeps all that its parts score, other containers half.
    """
    out = [0.0] * len(page.containers)
    for at, text, link in page.pieces:
        out[at] += -len(text) if link else len(text) if text != " " else 0
    for n in range(len(out) - 1, 0, -1):
        parent = page.containers[n].parent
        share = SEMANTIC.get(page.containers[parent].name, ROLL_UP)
        out[parent] += max(0.0, out[n]) * share
    return out


def complete(page: Page) -> set[str]:
    """Paths that hold nearly all text of the article or main around them, else of the page; a container's own text counts nothing if it has more links."""
    own = [0] * len(page.containers)
    for at, text, link in page.pieces:
        own[at] += -len(text) if link else len(text) if text != " " else 0
    own = [max(0, n) for n in own]
    for n in range(len(own) - 1, 0, -1):
        own[page.containers[n].parent] += own[n]
    around, held, base = [""], {"": own[0]}, {}
    for n, container in enumerate(page.containers[1:], 1):
        around.append(container.path if container.name in SEMANTIC else around[container.parent])
        base[container.path] = around[n]
        held[container.path] = held.get(container.path, 0) + own[n]
    return {path for path, top in base.items() if held[path] and held[path] >= NEARLY * held[top]}


def votes(page: Page) -> dict[str, tuple[int, bool]]:
    """Each path's best score in thousandths of the page's text, and whether it is complete."""
    whole = sum(len(text) for _, text, _ in page.pieces if text != " ")
    best: dict[str, int] = {}
    for container, score in zip(page.containers[1:], scores(page)[1:]):
        if score > 0:
            best[container.path] = max(best.get(container.path, 0), int(VOTE * score / whole))
    full = complete(page) if best else set()
    return {path: (best.get(path, 0), path in full) for path in best.keys() | full}


def extracted(page: Page, path: str | None) -> str:
    """The text of all elements of that path, else of the page's own best container."""
    for inside in (lambda n: page.containers[n].path == path, None):
        if inside is None:
            score = scores(page)
            best = max(range(1, len(score)), key=lambda n: (score[n], -n), default=0)
            full, up = complete(page), best
            while up and page.containers[up].path not in full:
                up = page.containers[up].parent
            best = up or best
            inside = (lambda n: n == best) if score[best] > 0 else (lambda n: True)
        held: list[bool] = []
        for n, container in enumerate(page.containers):
            held.append(inside(n) or n > 0 and held[container.parent])
        text = " ".join("".join([text for at, text, _ in page.pieces if held[at]]).split())
        if text:
            return text
    return ""


def path_votes(pages: DataFrame) -> DataFrame:
    """``host``, ``path`` and ``votes``, summed over pages, the number of ``pages`` that vote for it and on how many it is ``complete``."""
    batched(pages.sparkSession)

    def run(batches):
        for batch in batches:
            total: dict[tuple[str, str], list[int]] = {}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for path, (n, full) in votes(parsed(source or "")).items():
                    own = total.setdefault((host, path), [0, 0, 0])
                    own[0] += n
                    own[1] += 1
                    own[2] += full
            yield pa.RecordBatch.from_pydict(
                {"host": pa.array([k[0] for k in total], pa.string()), "path": pa.array([k[1] for k in total], pa.string()),
                 **{name: pa.array([v[k] for v in total.values()], pa.int64()) for k, name in enumerate(("votes", "pages", "complete"))}})

    host, _ = address("url")
    found = pages.select(F.coalesce(host, F.lit("")).alias("host"), "html").mapInArrow(run, "host string, path string, votes bigint, pages bigint, complete bigint")
    return found.groupBy("host", "path").agg(*(F.sum(c).alias(c) for c in ("votes", "pages", "complete")))


def winning(voted: DataFrame) -> DataFrame:
    """``host`` and its ``path``: the one with most votes, or the nearest around it that is complete on half of its pages."""
    most = voted.groupBy("host").agg(F.min_by(F.struct("path", "pages"), F.struct(-F.col("votes"), F.col("path"))).alias("_w"))
    around = voted.join(apart(most), "host").filter(
        "path = _w.path OR startswith(_w.path, concat(path, '/')) AND 2 * complete >= _w.pages")
    full = F.when(F.expr("2 * complete >= _w.pages"), F.struct(F.length("path"), F.col("path")))
    return around.groupBy("host").agg(F.coalesce(F.max(full)["path"], F.first("_w.path")).alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, the main ``text`` and ``n_chars``."""
    winners = saved(winning(saved(path_votes(pages), "votes")), "paths")
    host, _ = address("url")
    placed = pages.select("page_id", "url", "html", F.coalesce(host, F.lit("")).alias("host"))
    placed = placed.join(winners, "host", "left").select(F.col("page_id").cast("bigint"), "url", "html", "path")

    def run(batches):
        for batch in batches:
            text = [extracted(parsed(source or ""), path) for source, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return placed.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")

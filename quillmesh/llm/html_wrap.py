"""Main text of pages by union-free wrappers inferred per host (operator 5).

A page is read as a stream of blocks, each with its signature: the block's tag inside all its containers.
Runs of a signature fold into a repeated group. The streams of a host's pages are aligned one after
another to a wrapper, a union-free regular expression: what only some pages have becomes optional,
what repeats in any page becomes a repeated group, and texts that differ become text slots, while equal
texts stay template text. Two wrappers align like two streams, so each partition infers its own and
a host's are merged in two levels; a host that holds most pages is spread over all tasks.

The wrapper tells template from content: an item whose text is equal on CONSTANT different pages is
template, one whose text is mostly links is a menu, and a container weighs the slot text it has on a page
that has it. On each page the article is what an article or main element holds, but for template in side
containers; without such an element it is the page's weightiest container with all nested in it, single
containers beside it of at least a quarter of its weight, and the main heading. So a page of a rare
template is judged by its own containers. Elements, roles and class names that say menu, header, footer,
sidebar, notice, advert, form or comment rule a block out beforehand; names that say nothing leave it to
the wrapper.

White space is what Python's str.split parts at, no-break spaces included. Null and empty html, and pages
without an article, give an empty string. Pages without a host are a host of their own. Repeated pages
give their text each, but count once as evidence of template; of containers of equal weight the first by
path is taken. Texts of any length are read whole, and alignment takes time in proportion to their items.
An empty table gives no rows. Other columns are kept; one named like the output is replaced, and columns
may be named like the operator's own.
"""

from __future__ import annotations

import bisect
import html as htmllib
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.url_trust import host_of
from quillmesh.llm.util import cut, mapped, table

CONSTANT = 3  # different pages that show a text to be template
MENU = 0.7  # share of an item's characters in links that makes it a menu
SALTS = 64
SHIPPED = 32 << 20  # bytes of wrappers that may go to all tasks

# HTML vocabulary (fixed values).
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "canvas", "object", "math", "xmp", "noframes"}
DROP = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "datalist", "audio", "video", "map"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source nobr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = set("html body article main section div header footer nav aside form ul ol dl table tbody thead tfoot tr blockquote figure details center fieldset hgroup".split()) | DROP
BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|side-?bar|menu\w*|nav|navbar|navigation|breadcrumbs?|cookies?|notice|notices|consent|gdpr|newsletter|subscribe|subscription|popup|modal|overlay|share|sharing|social|related|recommended|comments?|comment-?list|disqus|respond|replies|masthead|site-?header|page-?header|header|footer|site-?footer|page-?footer|copyright|legal|widget|toolbar|pagination|pager|skip-?link|alert|login|signup|search)(?:$|[\s_-])",
    re.I,
)
ARTICLE = re.compile(r"(?:^|/)(?:article|main)(?:[./]|$)")
PROSE = set("ul ol dl table blockquote figure details section".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
TOKEN = re.compile(r"<!--(.*?)(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTR = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|\b(hidden)\b")


def boilerplate(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in DROP or tag == "header" and not in_article:
        return True
    if not attrs:
        return False
    for name, value, hidden in ATTR.findall(attrs):
        v = value.strip("\"'")
        n = name.lower()
        if hidden or n in ("class", "id") and BOILER.search(v) and tag not in ("html", "body", "article", "main"):
            return True
        if n == "role" and v.lower() in ROLES or n == "aria-hidden" and v.lower() == "true" or n == "style" and re.search(r"display\s*:\s*none", v, re.I):
            return True
    return False


def label(tag: str, attrs: str) -> str:
    m = re.search(r"class\s*=\s*[\"']?([\w-]+)", attrs) if attrs else None
    return tag + ("." + re.sub(r"[0-9]{2,}", "#", m[1].lower()) if m else "")


def blocks(page: str) -> list[tuple[str, bool, str, float, int]]:
    """(signature, boilerplate, text, share in links, container's number) of each block of a page, in order; texts decoded, white space single."""
    stack: list[tuple] = []  # tag, label, boilerplate (own or inherited), number
    out: list[tuple[str, bool, str, float, int]] = []
    buf: list[str] = []
    tag_of_block, at, n, articles, number, linked, link = "", 0, len(page), 0, 0, 0, False

    def close():
        nonlocal linked
        if buf:
            text = " ".join(htmllib.unescape("".join(buf)).split())
            if text:
                out.append(("/".join(x[1] for x in stack) + "/" + tag_of_block, bool(stack) and stack[-1][2], text, linked / max(sum(map(len, buf)), 1), stack[-1][3] if stack else 0))
            buf.clear()
        linked = 0

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            buf.append(page[at:])
            break
        if lt > at:
            buf.append(page[at:lt])
            linked += (lt - at) * link
        m = TOKEN.match(page, lt) or LOOSE.match(page, lt)
        if not m:
            buf.append("&lt;")
            at = lt + 1
            continue
        at = m.end()
        groups = m.groups()
        if len(groups) == 5:
            if groups[3] is None:
                continue
            end, tag, attrs = groups[2], groups[3].lower(), groups[4]
        else:
            end, tag, attrs = groups[0], groups[1].lower(), groups[2]
        if not end and tag in RAW and not attrs.endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else n
            if tag not in INLINE:
                close()
            continue
        if tag == "a":
            link = not end
        if tag in INLINE:
            if not end and attrs and tag not in VOID and boilerplate(tag, attrs, articles > 0):
                close()
                stack.append((tag, label(tag, attrs), True, number))
            elif end and stack and stack[-1][0] == tag:
                close()
                stack.pop()
            continue
        close()
        if tag in VOID:
            continue
        if tag not in CONTAINERS:
            if not end and boilerplate(tag, attrs, articles > 0):  # a paragraph of its own that is none of the article
                stack.append((tag, label(tag, attrs), True, number))
            elif end and stack and stack[-1][0] == tag:
                stack.pop()
            elif not end and stack and stack[-1][0] not in CONTAINERS and stack[-1][0] not in INLINE:
                stack.pop()
            tag_of_block = "" if end else tag
            continue
        tag_of_block = ""
        if not end:
            while stack and stack[-1][0] == tag and tag in ("tr", "thead", "tbody", "tfoot"):
                stack.pop()
            bad = bool(stack) and stack[-1][2] or boilerplate(tag, attrs, articles > 0)
            number += 1
            stack.append((tag, label(tag, attrs), bad, number))
            articles += tag in ("article", "main")
        elif any(x[0] == tag for x in stack):
            while True:
                gone = stack.pop()
                articles -= gone[0] in ("article", "main")
                if gone[0] == tag:
                    break
    close()
    return out


# A wrapper is a list of items [signature, optional, repeated, template text or None, boilerplate, characters, pages,
# characters in links, digests of up to CONSTANT different pages].


def stream(page_blocks: list) -> list[list]:
    """A page as a wrapper: runs of a signature folded to one repeated item."""
    out: list[list] = []
    digest = zlib.crc32("\n".join(b[2] for b in page_blocks).encode("utf-8", "surrogatepass"))
    for sig, bad, text, linked, _ in page_blocks:
        if out and out[-1][0] == sig:
            out[-1][2], out[-1][3] = True, None
            out[-1][5] += len(text)
            out[-1][7] += len(text) * linked
        else:
            out.append([sig, False, False, text if len(text) <= 200 else None, bad, len(text), 1, len(text) * linked, [digest]])
    return out


def united(p: list, q: list, pages: int, optional: bool, repeated: bool, text) -> list:
    return [p[0], optional, repeated, text, p[4] and q[4], p[5] + q[5], pages, p[7] + q[7], sorted({*p[8], *q[8]})[:CONSTANT]]


def common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a long common subsequence: k-th occurrences of a signature match, as many in order as can (n log n)."""
    seen: dict[str, int] = {}
    place = {}
    for j, sig in enumerate(y):
        seen[sig] = k = seen.get(sig, 0) + 1
        place[sig, k] = j
    seen, tails, last, back = {}, [], [], {}
    for i, sig in enumerate(x):
        seen[sig] = k = seen.get(sig, 0) + 1
        j = place.get((sig, k))
        if j is None:
            continue
        at = bisect.bisect_left(tails, j)
        tails[at : at + 1] = [j]
        last[at : at + 1] = [(i, j)]
        back[i, j] = last[at - 1] if at else None
    out, p = [], last[-1] if last else None
    while p is not None:
        out.append(p)
        p = back[p]
    return out[::-1]


def align(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of two: signatures of a common subsequence match, what is left becomes optional."""
    maybe = lambda p: [p[0], True, *p[2:]]
    out: list[list] = []
    i = j = 0
    for x, y in [*common([p[0] for p in a], [p[0] for p in b]), (len(a), len(b))]:
        out += [maybe(p) for p in a[i:x]] + [maybe(p) for p in b[j:y]]
        if x < len(a):
            p, q = a[x], b[y]
            out.append(united(p, q, p[6] + q[6], p[1] or q[1], p[2] or q[2], p[3] if p[3] == q[3] else None))
        i, j = x + 1, y + 1
    return squeeze(out)


def squeeze(items: list[list]) -> list[list]:
    """Neighbours of equal signature, and neighbouring equal groups, fold into repeated items."""
    out: list[list] = []
    for p in items:
        for size in range(1, 9):  # a group that repeats what the wrapper just had
            if len(out) >= size and out[-size][0] == p[0]:
                q = out[-size]
                out[-size] = united(q, p, max(q[6], p[6]), q[1] and p[1], True, None)
                break
        else:
            out.append(list(p))
    return out


def container(sig: str) -> str:
    return sig.rpartition("/")[0]


def learned(wrapper: list[list]) -> dict:
    """What a host's wrapper knows: template (signature and text), signatures of menus, and each container's weight."""
    fixed, links, chars, pages = [], [], {}, {}
    for p in wrapper:
        if p[4]:
            continue
        if p[3] is not None and len(p[8]) >= CONSTANT:
            fixed.append([p[0], p[3]])
        elif p[7] >= MENU * p[5]:
            links.append(p[0])
        else:
            q = container(p[0])
            chars[q] = chars.get(q, 0) + p[5]
            pages[q] = max(pages.get(q, 0), p[6])
    return {"fixed": fixed, "links": links, "weight": {q: chars[q] / pages[q] for q in chars}}


def article(page_blocks: list, known: dict) -> list[str]:
    """The texts of a page's article."""
    fixed, links, weight = {tuple(x) for x in known["fixed"]}, set(known["links"]), known["weight"]
    live = [(sig, text, number) for sig, bad, text, _, number in page_blocks if not bad]
    first = lambda found: max(sorted({container(x[0]) for x in found}), key=lambda q: weight.get(q, 0), default="")
    inside = [x for x in live if ARTICLE.search(x[0])]
    slots = [x for x in inside if x[:2] not in fixed]
    if slots:
        top = first(slots)
        return [x[1] for x in inside if x[:2] not in fixed or container(x[0]) == top]
    slots = [x for x in live if x[:2] not in fixed and x[0] not in links]
    top = first(slots)
    single = {q for q in {container(x[0]) for x in slots} if len({x[2] for x in slots if container(x[0]) == q}) == 1}
    whole = top.rpartition("/")[2].partition(".")[0] not in ("", "html", "body")

    def belongs(sig: str) -> bool:
        q = container(sig)
        if q == top or sig.endswith("/h1"):
            return True
        if q.startswith(top + "/") and (whole or q[len(top) + 1 :].partition("/")[0].partition(".")[0] in PROSE):
            return True
        beside = container(q) == container(top) or container(q) == top
        return beside and q in single and weight.get(q, 0) * 4 >= weight.get(top, 0)

    return [text for sig, text, _ in slots if belongs(sig)]


def _infer(url_host: str, page: str):
    def run(batches):
        for batch in batches:
            got: dict = {}
            for h, p in zip(batch.column(url_host).to_pylist(), batch.column(page).to_pylist()):
                s = squeeze(stream(blocks(p))) if p else []
                got[h] = align(got[h], s) if h in got else s
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array([json.dumps(w) for w in got.values()], pa.string())], ["host", "wrapper"])

    return run


def wrappers(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(host, wrapper JSON): a partition's wrappers, merged by salt, then by host."""
    found = mapped(pages.select(host, html), _infer(host, html), "host string, wrapper string")

    def merge(t: pa.Table) -> pa.Table:
        w = None
        for x in sorted(t.column("wrapper").to_pylist()):
            w = json.loads(x) if w is None else align(w, json.loads(x))
        return pa.table({"host": pa.array([t.column("host")[0].as_py()], pa.string()), "wrapper": pa.array([json.dumps(w)], pa.string())})

    found = found.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    found = found.groupBy("host", "salt").applyInArrow(merge, "host string, wrapper string")
    return found.groupBy("host").applyInArrow(merge, "host string, wrapper string")


def extract(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text") -> DataFrame:
    """pages with `out`: the main text of each."""
    kept = [c for c in pages.columns if c != out]
    cols = [f"c{i}" for i in range(len(kept))]
    p = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, cols)], host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html"))
    known = cut(mapped(wrappers(p, "host", "html"), _learned, "host string, known string"))
    schema = p.select(*cols).withColumn("text", F.lit("")).schema
    total = known.agg(F.coalesce(F.sum(F.length("known")), F.lit(0)), F.count("*")).first()
    if total[0] + 100 * total[1] <= SHIPPED:
        found = mapped(p, _texts({r.host: r.known for r in known.collect()}, cols), schema)
    else:
        found = mapped(p.join(known, "host", "left"), _texts(None, cols), schema)
    return found.select(*[F.col(n).alias(c) for c, n in zip(kept, cols)], F.col("text").alias(out))


NOTHING = '{"fixed": [], "links": [], "weight": {}}'


def _learned(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([json.dumps(learned(json.loads(w))) for w in b.column(1).to_pylist()], pa.string())], ["host", "known"])


def _texts(known, cols):
    def run(batches):
        last: dict = {}
        for b in batches:
            at = b.schema.names.index
            host, html = b.column(at("host")).to_pylist(), b.column(at("html")).to_pylist()
            have = [known.get(h, NOTHING) for h in host] if known is not None else [x or NOTHING for x in b.column(at("known")).to_pylist()]
            texts = []
            for h, k, page in zip(host, have, html):
                if h not in last:
                    last = {**(last if len(last) < 1000 else {}), h: json.loads(k)}
                texts.append("\n\n".join(article(blocks(page), last[h])) if page else "")
            yield pa.RecordBatch.from_arrays([*[b.column(at(c)) for c in cols], pa.array(texts, pa.string())], [*cols, "text"])

    return run


def op5(spark, sf_dir):
    d = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return d.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

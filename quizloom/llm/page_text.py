"""HTML extraction by union-free wrappers inferred for each host.

A page becomes a stream of block tags and texts (implied end tags put in, inline tags taken
out), kept nested.  The wrapper of a host is a union-free regular expression over such
streams: tags and text slots in order, each possibly optional ``(x)?`` or repeated ``(x)+``,
also groups of several.  Where texts differ a constant becomes a slot, equal neighbours (or
pairs, up to four) fold to a repeated group, and what only one side has becomes optional.

All pages take part.  A task joins its pages of one host and one structure (the labels alone)
to one wrapper; the wrappers of a host are then aligned, ``MERGE`` at a time, round after round,
until one is left, so neither a host with a third of all pages nor one with many layouts
needs a task of its own.

The wrapper says which texts of a page change from page to page and are not links.  The
article is the ``main`` or outermost ``article`` element with most of such text (one within it,
if that has most of it), whole but for menus, forms, adverts and the like.  On a host without
such elements it is the smallest part of the wrapper with most of the changing text; a page
that has nothing there gives all its text that no menu, header, footer and the like holds.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm.common import prepare, stored, text_bytes

#: Wrappers of a host aligned in one task, and wrappers that a task holds before it passes them on.
MERGE, HELD = 64, 2000
#: Longest repeated group of siblings.
GROUP = 4
#: A slot that is the same on so many pages, and no longer, is not the article's.
SAME_PAGES, SAME_CHARS = 4, 200
#: Share of the changing text that a part must have to stand for what is around it.
MOST = 0.7

NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
STOP = re.compile(r"[>\"']")
#: Elements whose content is no markup.
RAW = {t: re.compile(rf"</{t}\s*+>", re.I) for t in
       "script style noscript template textarea select svg iframe object title".split()}
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Start tags that end an open element of these, up to the list or table around it.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "body": ("head",)}
SCOPE = frozenset("ul ol dl table html body article section div main".split())

BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog head button fieldset".split())
BOILERPLATE_WORDS = frozenset(
    "nav navbar navigation menu sidebar side aside header masthead footer foot ad ads advert adverts advertisement sponsor "
    "sponsored promo promotion banner cookie cookies consent notice notices alert popup modal newsletter subscribe signup "
    "login search breadcrumb breadcrumbs pagination pager share sharing social related recommended widget comment comments "
    "commentlist reply replies respond disqus toolbar copyright skip".split())
#: Of these, words that name the heads of things within an article, and elements that are plain text there.
HEAD_WORDS = frozenset("header masthead head side search skip alert".split())
TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre figcaption article main".split())
ARTICLE = ("article", "main")


class Node:
    """A block element: tag, label (tag with its class, id and role words), children (Node or Text)."""
    __slots__ = ("tag", "label", "children", "bad", "target")

    def __init__(self, tag: str, label: str):
        self.tag, self.label, self.children, self.bad, self.target = tag, label, [], False, False


class Text:
    """A text: how many of its characters are links', and whether it may be an article's (``use``)."""
    __slots__ = ("text", "linked", "use")
    label = "#"

    def __init__(self, text: str, linked: int):
        self.text, self.linked, self.use = text, linked, False


def scan(page: str) -> Iterator[tuple[str | None, bool, str]]:
    """(None, False, text) or (tag, closing, attributes), in order; each character is looked at a bounded number of times.

    A tag ends at the first ``>`` outside quotes.  Once a quote has no end, tags of the page end at the first
    ``>``; a ``<`` with none after it, or before no name, is text.  Comments and raw elements without an end run to
    the end of the page.
    """
    at, last, quoted = 0, page.rfind(">"), True
    ends = {q: page.rfind(q) for q in "\"'"}
    while at < len(page):
        i = page.find("<", at)
        if i < 0 or i > last and not page.startswith("<!--", i):
            cut = page.find("<!--", at)
            yield None, False, page[at:cut] if cut >= 0 else page[at:]
            return
        if i > at:
            yield None, False, page[at:i]
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            at = j + 3 if j >= 0 else len(page)
            continue
        if page.startswith(("<!", "<?"), i):
            at = page.index(">", i) + 1
            continue
        m = NAME.match(page, i)
        if not m:
            yield None, False, "<"
            at = i + 1
            continue
        j = m.end()
        while quoted and (stop := STOP.search(page, j)) and stop[0] != ">":
            if stop.start() >= ends[stop[0]]:
                quoted = False
                break
            j = page.index(stop[0], stop.end()) + 1
        j = page.find(">", j if quoted else m.end())
        if j < 0:  # the last one stands in quotes
            quoted, j = False, page.index(">", m.end())
        tag, closing = m[2].lower(), bool(m[1])
        at = j + 1
        if not closing and tag in RAW:
            end = RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        yield tag, closing, page[m.end():j]


def parse(page: str) -> Node:
    """The page's blocks.  A text is what stands between two block tags: references decoded, white
    space as one space, trimmed; empty ones are left out."""
    root = Node("", "")
    stack, held, links, linked = [root], [], 0, 0

    def flush():
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                stack[-1].children.append(Text(text, min(linked, len(text))))
            held.clear()
        linked = 0

    for tag, closing, text in scan(page):
        if tag is None:
            text = entities.unescape(text) if "&" in text else text
            held.append(text)
            if links:
                linked += len(text.strip())
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        if tag in VOID:
            if tag == "br":
                held.append(" ")
            elif tag == "hr":
                flush()
            continue
        flush()
        links = 0
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("table", "body", "html") and tag not in ("table", "body", "html"):
                    break
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE:
                    break
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ENDS.get(tag, ()):
                del stack[i:]
            elif stack[i].tag in SCOPE:
                break
        words = " ".join(sorted({w for a in ATTRIBUTE.finditer(text) for w in re.findall(
            r"[a-z]+", (a[2] or a[3] or a[4] or "").lower())})) if text else ""
        node = Node(tag, f"{tag} {words}" if words else tag)
        stack[-1].children.append(node)
        if len(stack) < 200:  # deeper nesting goes on at this level
            stack.append(node)
    flush()
    return root


# A wrapper is a list of particles: dicts of label, opt, rep, and
#   slots ("#"): same (digest of the constant text, or None), size (its length), pages, chars, linked;
#   elements: kids; groups ("()"): kids, always repeated.

def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _key(p: dict) -> str:
    return p["label"] if p["label"] != "()" else "(" + ",".join(map(_key, p["kids"])) + ")"


def _particles(node: Node) -> list[dict]:
    out = []
    for c in node.children:
        if isinstance(c, Text):
            out.append({"label": "#", "opt": False, "rep": False, "same": _digest(c.text), "size": len(c.text), "pages": 1,
                        "chars": len(c.text), "linked": c.linked})
        else:
            out.append({"label": c.label, "opt": False, "rep": False, "kids": _particles(c)})
    return fold(out)


def _join(a: dict, b: dict, one_page: bool) -> dict:
    """One particle for two of the same label (of one page, or of two)."""
    out = {"label": a["label"], "opt": a["opt"] or b["opt"], "rep": a["rep"] or b["rep"]}
    if a["label"] == "#":
        out |= {"same": a["same"] if a["same"] == b["same"] and not one_page else None,
                "size": a["size"], "pages": max(a["pages"], b["pages"]) if one_page else a["pages"] + b["pages"],
                "chars": a["chars"] + b["chars"], "linked": a["linked"] + b["linked"]}
    else:
        out["kids"] = align(a["kids"], b["kids"], one_page)
    return out


def fold(seq: list[dict]) -> list[dict]:
    """Neighbours that repeat become one repeated particle: single ones first, then groups."""
    out: list[dict] = []
    for p in seq:
        if out and _key(out[-1]) == _key(p):
            out[-1] = _join(out[-1], p, True)
            out[-1]["rep"] = True
        else:
            out.append(p)
    for size in range(2, GROUP + 1):
        i = 0
        while i + 2 * size <= len(out):
            keys = [_key(p) for p in out[i:i + size]]
            n = 1
            while [_key(p) for p in out[i + n * size:i + (n + 1) * size]] == keys:
                n += 1
            if n > 1:
                unit = out[i:i + size]
                for k in range(1, n):
                    unit = [_join(a, b, True) for a, b in zip(unit, out[i + k * size:i + (k + 1) * size])]
                out[i:i + n * size] = [{"label": "()", "opt": False, "rep": True, "kids": unit}]
            i += 1
    return out


def common(a: list[str], b: list[str], cells: int = 1 << 28) -> list[tuple[int, int]]:
    """Positions (i, j) of a longest common subsequence, ascending.

    Rows of the length table are bit vectors (a zero bit: the length grows at that column); where
    they would hold more than ``cells`` bits the longer problem is halved first.
    """
    n, m = len(a), len(b)
    lo = 0
    while lo < min(n, m) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(n, m) - lo and a[n - 1 - hi] == b[m - 1 - hi]:
        hi += 1
    out = [(i, i) for i in range(lo)]
    x, y = a[lo:n - hi], b[lo:m - hi]
    if len(x) > 1 and len(x) * len(y) > cells:
        half = len(x) // 2
        grown = _growth(x[:half], y)
        back = _growth(x[half:][::-1], y[::-1])
        left, right, best, cut = 0, back.count(True), -1, 0
        for j in range(len(y) + 1):
            if left + right > best:
                best, cut = left + right, j
            if j < len(y):
                left += grown[j]
                right -= back[len(y) - 1 - j]
        inner = common(x[:half], y[:cut], cells) + [(i + half, j + cut) for i, j in common(x[half:], y[cut:], cells)]
    else:
        rows, inner = list(_rows(x, y)), []
        i, j = len(x), len(y)
        while i and j:
            if rows[i - 1] >> j - 1 & 1:
                j -= 1
            elif i > 1 and not rows[i - 2] >> j - 1 & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                inner.append((i, j))
        inner.reverse()
    out += [(i + lo, j + lo) for i, j in inner]
    return out + [(n - k, m - k) for k in range(hi, 0, -1)]


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    where: dict[str, int] = {}
    for j, k in enumerate(b):
        where[k] = where.get(k, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for k in a:
        met = row & where.get(k, 0)
        row = (row + met | row - met) & full
        yield row


def _growth(a: list[str], b: list[str]) -> list[bool]:
    """For each column of the last row, whether the length grows there."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):
        pass
    return [c == "0" for c in f"{row:0{len(b)}b}"[::-1]] if b else []


def align(a: list[dict], b: list[dict], one_page: bool = False) -> list[dict]:
    """Two sequences as one: equal labels in order (as many as can be) are joined, others are optional."""
    ka, kb = [_key(p) for p in a], [_key(p) for p in b]
    out, i, j = [], 0, 0
    for x, y in [*common(ka, kb), (len(a), len(b))]:
        out += [p | {"opt": True} for p in a[i:x]] + [p | {"opt": True} for p in b[j:y]]
        if x < len(a):
            out.append(_join(a[x], b[y], one_page))
        i, j = x + 1, y + 1
    return fold(out)


def infer(pages: list[str]) -> list[dict]:
    """The wrapper of some pages: pages are aligned one after the other, until none changes it."""
    wrapper: list[dict] | None = None
    for page in pages:
        own = _particles(parse(page))
        wrapper = own if wrapper is None else align(wrapper, own)
    return wrapper or []


def boilerplate(label: str, in_article: bool) -> bool:
    """Whether an element is no part of an article.  Within one, a class word drops only containers that are no
    plain text, and words for the heads of things drop nothing."""
    tag, _, words = label.partition(" ")
    if tag in BOILERPLATE_TAGS and not (tag == "header" and in_article):
        return True
    if in_article:
        return tag not in TEXT_TAGS and not (BOILERPLATE_WORDS - HEAD_WORDS).isdisjoint(words.split())
    return tag not in ("html", "body", *ARTICLE) and not BOILERPLATE_WORDS.isdisjoint(words.split())


def _heading(tag: str) -> bool:
    return tag[:1] == "h" and tag[1:].isdigit()


def _mark(wrapper: list[dict]) -> list:
    """Decisions as nested lists [label, repeated, yes, kids].  A slot's yes: it may be an article's; an
    element's: it is the smallest part with most of the changing text."""
    def usable(p, heading):
        linked = p["linked"] * 2 > p["chars"]
        constant = p["same"] is not None and p["pages"] >= SAME_PAGES and p["size"] <= SAME_CHARS and not p["rep"]
        return heading or not constant and not linked

    def survey(seq, heading, inside):
        total = 0
        for p in seq:
            if p["label"] == "#":
                p["use"] = usable(p, heading)
                total += p["chars"] * (p["use"] and not heading)
            else:
                tag = p["label"].partition(" ")[0]
                bad = p["label"] != "()" and boilerplate(p["label"], inside)
                p["mass"] = survey(p["kids"], _heading(tag) or heading and tag == "()", inside or tag in ARTICLE) * (not bad)
                total += p["mass"]
        return total

    total, target, seq = survey(wrapper, False, False), None, wrapper
    while total:
        below = next((p for p in seq if p["label"] != "#" and p["mass"] >= MOST * total and not p["rep"]), None)
        if below is None:
            break
        target, seq = below, below["kids"]

    def decided(seq):
        return [["#", p["rep"], p["use"], []] if p["label"] == "#" else
                [p["label"], p["rep"], p is target, decided(p["kids"])] for p in seq]

    return decided(wrapper)


def _flat(seq: list) -> list[tuple]:
    """(label, particle, first, last): where the same particle, or its group, may start again."""
    out: list[tuple] = []
    for p in seq:
        start = len(out)
        if p[0] == "()":
            inner = _flat(p[3])
            n = start + len(inner) - 1
            out += [(k, q, start, n) for k, q, *_ in inner]
        else:
            out.append((p[0], p, start if p[1] else start + 1, start))
    return out


def _annotate(node: Node, seq: list, inside: bool) -> None:
    """Aligns the children of a node with its part of the wrapper and notes what that says of them."""
    flat = _flat(seq)
    at = -1  # position matched last
    later: dict[str, list[int]] = {}
    for i in range(len(flat) - 1, -1, -1):
        later.setdefault(flat[i][0], []).append(i)
    for c in node.children:
        found = None
        if at >= 0 and flat[at][2] <= at:  # a repeated one, or its group, may come again
            around = [*range(at if flat[at][1][1] else at + 1, flat[at][3] + 1), *range(flat[at][2], at)]
            found = next((i for i in around if flat[i][0] == c.label), None)
        if found is None:
            ahead = later.get(c.label, [])
            while ahead and ahead[-1] <= at:
                ahead.pop()
            found = ahead[-1] if ahead else None
        if found is not None:
            at = found
        particle = flat[found][1] if found is not None else None
        if isinstance(c, Text):
            c.use = particle[2] if particle else _heading(node.tag) or c.linked * 2 <= len(c.text)
        else:
            c.bad, c.target = boilerplate(c.label, inside), bool(particle and particle[2])
            _annotate(c, particle[3] if particle else [], inside or c.tag in ARTICLE)


def _texts(node: Node) -> Iterator[Text]:
    for c in node.children:
        if isinstance(c, Text):
            yield c
        elif not c.bad:
            yield from _texts(c)


def _elements(node: Node, wanted) -> Iterator[Node]:
    """Elements outside boilerplate that are wanted, outermost first."""
    for c in node.children:
        if isinstance(c, Node) and not c.bad:
            if wanted(c):
                yield c
            yield from _elements(c, wanted)


def extract(page: str, wrapper: list) -> list[str]:
    """The article's texts of a page, in page order, by its host's wrapper."""
    root = parse(page)
    _annotate(root, wrapper, False)
    mass = lambda n: sum(len(t.text) for t in _texts(n) if t.use)
    held = [(mass(n), n) for n in _elements(root, lambda n: n.tag in ARTICLE)]
    if held:
        most, best = max(held, key=lambda x: x[0])
        while True:  # the smallest within it that has most of it
            inner = [(m, n) for m, n in ((mass(n), n) for n in _elements(best, lambda n: n.tag in ARTICLE)) if m >= MOST * most]
            if not inner or not most:
                break
            best = inner[0][1]
        if out := [t.text for t in _texts(best)]:
            return out
    parts = next(([t.text for t in _texts(n) if t.use] for n in _elements(root, lambda n: n.target)), [])
    rest = list(_texts(root))
    return parts or [t.text for t in rest if t.use] or [t.text for t in rest]


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)), F.lit(""))


def _structure(seq: list[dict]) -> list:
    return [p["label"] if p["label"] == "#" else [p["label"], p["rep"], _structure(p["kids"])] for p in seq]


def host_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper as JSON), inferred from all pages of each host that hold anything."""
    rows = pages.select(host_of(F.col(f"`{url}`")).alias("host"), text_bytes(html).alias("html")).where("octet_length(html) > 0")

    def own(batches):
        held: dict[tuple[str, str], list] = {}

        def passed():
            host, key = zip(*held)
            return pa.RecordBatch.from_arrays(
                [pa.array(host, pa.string()), pa.array(key, pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())],
                ["host", "key", "wrapper"])

        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1)):
                seq = _particles(parse(page.as_py().decode("utf-8", "replace")))
                key = (host, _digest(json.dumps(_structure(seq))))
                held[key] = align(held[key], seq) if key in held else seq
                if len(held) >= HELD:
                    yield passed()
                    held.clear()
        if held:
            yield passed()

    def merge(key, table):
        table = table.sort_by([("key", "ascending"), ("wrapper", "ascending")])
        wrapper = None
        for w in table.column("wrapper"):
            one = json.loads(w.as_py())
            wrapper = one if wrapper is None else align(wrapper, one)
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "key": pa.array([str(key[1].as_py())], pa.string()),
                         "wrapper": pa.array([json.dumps(wrapper)], pa.string())})

    kind = "host string, key string, wrapper string"
    parts = stored(rows.mapInArrow(own, kind))
    while True:
        counts = parts.groupBy("host").agg(F.ceil(F.count("*") / MERGE).alias("buckets"))
        most = counts.agg(F.max("buckets")).first()[0] or 1
        parts = parts.join(counts, "host").withColumn("bucket", F.pmod(F.xxhash64("key"), "buckets")) \
            .select("host", "key", "wrapper", "bucket").groupBy("host", "bucket").applyInArrow(merge, kind)
        if most == 1:
            break
        parts = stored(parts)

    def mark(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(
                [json.dumps(_mark(json.loads(w))) for w in b.column(1).to_pylist()], pa.string())], ["host", "wrapper"])

    return parts.select("host", "wrapper").mapInArrow(mark, "host string, wrapper string")


def page_texts(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, blocks (array of the article's texts, in page order).

    Null and empty html give no blocks.  Pages without a URL are one host.  Broken and very long
    pages are read whole, in time linear in their length.  Of equally heavy articles the first counts.
    Repeated rows are extracted alike (and count as pages of their own where constant texts are told
    from changing ones), other columns aren't looked at, an empty table gives no rows.
    """
    prepare(pages.sparkSession)
    wrappers = stored(host_wrappers(pages, url, html))
    rows = pages.select(F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").alias("url"), host_of(F.col(f"`{url}`")).alias("host"),
                        text_bytes(html).alias("html")).join(wrappers, "host", "left").select("id", "url", "html", "wrapper")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        last, wrapper = None, []
        for b in batches:
            out = []
            for page, own in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if own != last:
                    last, wrapper = own, json.loads(own) if own else []
                out.append(extract(page.decode("utf-8", "replace"), wrapper) if page else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.string()))], ["id", "url", "blocks"])

    return rows.mapInArrow(run, f"id {kind}, url string, blocks array<string>").select(
        F.col("id").alias(id), F.col("url").alias(url), "blocks")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    text = F.array_join("blocks", "\n\n")
    return page_texts(pages).select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))

"""Main-text extraction by union-free regular expressions inferred per host.

A page becomes a stream of tokens, tags (name, class or id) and text.  A wrapper is a
union-free regular expression over such tokens: items that are elements or texts, each
once, optional (?), repeated (+) or both (*).  A page's own expression comes from folding:
a run of neighbouring elements that open alike is one repeated item.  Wrappers grow by
iterative alignment: where a page and its host's wrapper agree, items merge; a mismatch of
elements makes them optional or repeated; a mismatch of text makes a text slot.  Text
that was equal on every page which has the item stays part of the template.

A page is read through its host's wrapper.  Its runs are matched with the wrapper's items,
and what the wrapper holds as template (the same content on at least SUPPORT different
pages) is left out, whatever its names; slots are the page's own text.  Two rules stand
above that, page by page: regions that are boilerplate by name (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, comments) never count, and if the page
has text in an article or main region, that alone counts.

Pages seen before change nothing, so a task aligns each distinct page of a host once;
tasks' wrappers are aligned with each other in the same way, in rounds of a bounded number
a group.  Every walk has a stack of its own, and alignment is linear in the folded items.
"""

from __future__ import annotations

import bisect
import html as _html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Elements whose content is never text.
RAW = ("script", "style", "template", "noscript", "iframe", "svg", "math", "textarea", "select", "title", "object", "canvas", "audio", "video")
#: Elements without content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: Elements that don't end a block.
INLINE = ("a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "ruby", "rt", "rp", "big")
#: Elements that are boilerplate by name.
BOILER_TAGS = ("nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head")
#: Words of class, id or role names that mark boilerplate.
BOILER_WORDS = (
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side rail aside widget widgets header masthead topbar footer "
    "bottom comment comments disqus reply replies respond discussion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations trending form search toolbar pagination pager copyright legal complementary contentinfo"
).split()
#: Different pages of a host that must agree before equal content is the host's template.
SUPPORT = 3
#: Elements and roles of the main content.
MAIN = ("article", "main")
_OPENS_P = ("p",)
_ENDS_P = ("p", "div", "ul", "ol", "li", "table", "section", "article", "main", "aside", "nav", "header", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "dl", "figure", "hr", "address", "fieldset", "details", "center")
_CLOSES_BY_SELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_MARKS = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v \u0085  -     　\x1c-\x1f]+")
_SPLIT = re.compile(r"[^a-z]+")

# ---------------------------------------------------------------- pages as tokens


def _label(tag: str, attributes: str) -> str:
    """tag, or tag.names where class, id or role names mark boilerplate or main content."""
    if not attributes.strip():
        return tag
    names, hidden = set(), False
    for m in _MARKS.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            hidden = True
        elif key in ("class", "id", "role"):
            names.update(_SPLIT.split(value))
    kept = sorted(names & _NAMES)
    return ".".join([tag, *kept, *(["hidden"] if hidden else [])])


_NAMES = frozenset(BOILER_WORDS) | frozenset(MAIN)


def stream(page: str) -> list[tuple[str, str]]:
    """Tokens of a page: ("<label", ""), (">tag", ""), ("#", raw text); tags are balanced.

    Inline tags and comments vanish, so that a block's text is one token; <br> is a
    line end in it.  Elements that never end are closed with their parent.
    """
    out: list[tuple[str, str]] = []
    open_tags: list[str] = []
    how_many: Counter[str] = Counter()
    text: list[str] = []
    at = 0

    def flush() -> None:
        if text:
            joined = "".join(text)
            text.clear()
            if joined.strip():
                out.append(("#", joined))

    def close_to(k: int) -> None:
        flush()
        while len(open_tags) > k:
            how_many[open_tags[-1]] -= 1
            out.append((">" + open_tags.pop(), ""))

    def opened(tag: str, label: str) -> None:
        flush()
        open_tags.append(tag)
        how_many[tag] += 1
        out.append(("<" + label, ""))

    def last(tag: str, barriers: tuple[str, ...]) -> int | None:
        """Where the innermost open `tag` is, unless one of `barriers` is inside it."""
        if not how_many[tag]:
            return None
        k = len(open_tags) - 1
        while open_tags[k] != tag:
            if open_tags[k] in barriers:
                return None
            k -= 1
        return k

    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            text.append(_html.unescape(page[at:]))
            break
        if m.start() > at:
            text.append(_html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:].removesuffix("]]>"))
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not closing and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|$)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in INLINE:
            if not closing and m[3] and _boiler_label(label := _label(tag, m[3])):
                # an inline element marked as boilerplate: leave its content out as a block
                opened(tag, label)
            elif closing and tag in open_tags[-3:]:
                close_to(last(tag, ()))
            continue
        if tag in VOID:
            text.append("\n")
            if tag == "hr":
                flush()
            continue
        if closing:
            if (k := last(tag, ())) is not None:
                close_to(k)
            elif tag == "p":  # stands for an empty paragraph; other stray ends are none
                flush()
            continue
        if tag in _ENDS_P and (k := last("p", _ENDS_P)) is not None:
            close_to(k)
        if tag in _CLOSES_BY_SELF and (k := last(tag, _CLOSES_BY_SELF[tag])) is not None:
            close_to(k)
        opened(tag, _label(tag, m[3]))
    close_to(0)
    return out


def _boiler_label(label: str) -> bool:
    tag, *names = label.split(".")
    return tag in BOILER_TAGS or "hidden" in names or any(n in _BOILER for n in names)


_BOILER = frozenset(BOILER_WORDS)

class Piece:
    """An element or text block of one page, with the hash of all that it holds.

    `runs` groups neighbouring pieces of one label: (label, hash of the run, pieces).
    """

    __slots__ = ("label", "hash", "text", "runs")

    def __init__(self, label: str, text: str = ""):
        self.label, self.text, self.runs, self.hash = label, text, [], 0


def _hash(label: str, parts: list[int]) -> int:
    h = xxhash.xxh64(label.encode("utf-8", "surrogatepass"))
    h.update(b"".join(p.to_bytes(8, "little") for p in parts))
    return h.intdigest()


def parse(page: str) -> Piece:
    """The page as pieces below a root without a label."""
    root = Piece("")
    stack, kids = [root], [[]]

    def close() -> None:
        piece, own = stack.pop(), kids.pop()
        at = 0
        while at < len(own):
            end = at + 1
            while end < len(own) and own[end].label == own[at].label:
                end += 1
            run = own[at:end]
            piece.runs.append((run[0].label, run[0].hash if len(run) == 1 else _hash("+", [p.hash for p in run]), run))
            at = end
        piece.hash = _hash(piece.label, [h for _, h, _ in piece.runs])

    for name, raw in stream(page):
        if name[0] == "<":
            piece = Piece(name[1:])
            kids[-1].append(piece)
            stack.append(piece)
            kids.append([])
        elif name[0] == ">":
            close()
        elif block := _SPACE.sub(" ", raw).strip(" "):
            piece = Piece("#", block)
            piece.hash = _hash("#" + block, [])
            kids[-1].append(piece)
    close()
    return root


# ---------------------------------------------------------------- wrappers


class Node:
    """An item of a wrapper: an element (or a text, label #), once, optional or repeated.

    `fixed` is the hash of its content while that was equal on all pages, None once it
    differed; `pages` names up to SUPPORT pages that have it.  Of a fixed node only its own
    `pages` count; they move to its content when it stops being fixed.
    """

    __slots__ = ("label", "optional", "repeated", "kids", "fixed", "pages")

    def __init__(self, label: str, fixed: int | None, kids: list[Node], optional: bool = False, repeated: bool = False, pages: tuple[int, ...] = ()):
        self.label, self.fixed, self.kids, self.optional, self.repeated, self.pages = label, fixed, kids, optional, repeated, pages


def _few(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    return a if a == b else tuple(sorted({*a, *b})[:SUPPORT])


def _vary(x: Node) -> None:
    """`x` is fixed no more: its pages become those of its content."""
    if x.fixed is None:
        return
    x.fixed = None
    todo = [x] if x.pages else []
    while todo:
        for kid in todo.pop().kids:
            kid.pages = _few(kid.pages, x.pages)
            if kid.fixed is None:
                todo.append(kid)


def align(a: list[Node], b: list[Node], todo: list[tuple[Node, Node]]) -> list[Node]:
    """One list of items for two: what both have is one item (its pair goes to `todo`), the rest optional.

    Where the two differ, the side that meets the other's next label sooner skips to it;
    the lists are walked once, however long.
    """
    places: tuple[dict, dict] = {}, {}
    for found, items in zip(places, (a, b)):
        for k, x in enumerate(items):
            found.setdefault(x.label, []).append(k)

    def following(side: int, label: str, at: int) -> int | None:
        known = places[side].get(label, ())
        k = bisect.bisect_left(known, at)
        return known[k] if k < len(known) else None

    out: list[Node] = []

    def put(x: Node, other: Node | None = None) -> None:
        if other is None:
            x.optional = True
        if out and out[-1].label == x.label:
            out[-1].repeated = True
            todo.append((out[-1], x))
        else:
            out.append(x)
        if other is not None:
            todo.append((out[-1], other))

    i = j = 0
    while i < len(a) and j < len(b):
        if a[i].label == b[j].label:
            put(a[i], b[j])
            i, j = i + 1, j + 1
            continue
        skip_a, skip_b = following(0, b[j].label, i), following(1, a[i].label, j)
        if skip_a is None and skip_b is None:
            put(a[i])
            put(b[j])
            i, j = i + 1, j + 1
        elif skip_b is None or skip_a is not None and skip_a - i <= skip_b - j:
            for x in a[i:skip_a]:
                put(x)
            i = skip_a
        else:
            for x in b[j:skip_b]:
                put(x)
            j = skip_b
    for x in (*a[i:], *b[j:]):
        put(x)
    return out


def merge(x: Node, y: Node) -> Node:
    """`x` becomes one item for both; `y` is used up."""
    todo = [(x, y)]
    while todo:
        x_, y_ = todo.pop()
        x_.optional |= y_.optional
        x_.repeated |= y_.repeated
        if x_.fixed is not None and x_.fixed == y_.fixed:
            x_.pages = _few(x_.pages, y_.pages)
            continue
        _vary(x_)
        _vary(y_)
        x_.kids = align(x_.kids, y_.kids, todo)
    return x


def infer(page: Piece) -> Node:
    """The wrapper of one page: runs of neighbouring equal elements become repeated items."""
    order, made = [page], {}
    for piece in order:  # grows: parents before their content
        order.extend(p for _, _, run in piece.runs for p in run)
    for piece in reversed(order):
        kids = []
        for _, run_hash, run in piece.runs:
            first = made.pop(id(run[0]))
            for p in run[1:]:
                merge(first, made.pop(id(p)))
            first.repeated |= len(run) > 1
            first.fixed = run_hash
            kids.append(first)
        made[id(piece)] = Node(piece.label, piece.hash, kids)
    root = made[id(page)]
    root.pages = (page.hash,)
    return root


def expression(wrapper: Node) -> str:
    """The wrapper as a readable expression; text equal on all pages is =, other text #."""
    out: list[str] = []
    todo: list = [wrapper]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        mark = "*" if x.optional and x.repeated else "?" if x.optional else "+" if x.repeated else ""
        name = x.label.split(".")[0]
        opens, closes = (f"<{x.label}>", f"</{name}>") if x.label not in ("", "#") else ("", "")
        body = x.kids[::-1] if x.label != "#" else ["=" if x.fixed is not None else "#"]
        todo += [f"){mark}" if mark else "", closes, *body, ("(" if mark else "") + opens]
    return "".join(out)


def dump(wrapper: Node) -> str:
    """Flat, so that depth doesn't matter: parents before their content."""
    flat, todo = [], [wrapper]
    while todo:
        x = todo.pop()
        flat.append([x.label, x.optional + 2 * x.repeated, len(x.kids), x.fixed, *x.pages])
        todo += x.kids[::-1]
    return json.dumps(flat, separators=(",", ":"))


def load(text: str) -> Node:
    todo: list[tuple[Node, int]] = []
    root = None
    for label, marks, count, fixed, *pages in json.loads(text):
        node = Node(label, fixed, [], bool(marks & 1), bool(marks & 2), tuple(pages))
        if todo:
            parent, left = todo.pop()
            parent.kids.append(node)
            if left > 1:
                todo.append((parent, left - 1))
        else:
            root = node
        if count:
            todo.append((node, count))
    return root


def _template(x: Node) -> bool:
    return x.fixed is not None and len(x.pages) >= SUPPORT


def prune(wrapper: Node) -> Node | None:
    """What reading pages needs: the labels beside and above text that is template; None without any."""
    order = [wrapper]
    for x in order:
        if _template(x) or x.fixed is not None:
            x.kids = []
        order.extend(x.kids)
    useful: set[int] = set()
    for x in reversed(order):
        if _template(x) or any(id(k) in useful for k in x.kids):
            useful.add(id(x))
        else:
            x.kids = []
    return wrapper if id(wrapper) in useful else None


# ---------------------------------------------------------------- reading a page


def _is_main(label: str) -> bool:
    tag, *names = label.split(".")
    return tag in MAIN or tag in ("div", "section") and any(n in MAIN for n in names)


def _matched(piece: Piece, wrapper: Node | None) -> list[Node | None]:
    """The wrapper's item for each run of `piece`, by the walk that align() makes."""
    if wrapper is None or not wrapper.kids:
        return [None] * len(piece.runs)
    items = wrapper.kids
    places: dict[str | int, list[int]] = {}
    for k, x in enumerate(items):
        places.setdefault(x.label, []).append(k)
        if x.fixed is not None:
            places.setdefault(x.fixed, []).append(k)
    out, at = [], 0
    for label, run_hash, _ in piece.runs:
        place = None
        for key in (run_hash, label):  # of items further on, the one that is fixed to just this content, else the next one
            known = places.get(key, ())
            k = bisect.bisect_left(known, at)
            if place is None and k < len(known):
                place = known[k]
        out.append(None if place is None else items[place])
        at = at if place is None else place + 1
    return out


def extract_text(page: str, wrapper: Node | None) -> str:
    """The page's main text: blocks in order, one blank between.

    Boilerplate regions are left out.  If the page itself has text inside article or main
    regions, that alone counts.  Else what the host's wrapper holds as template is left out,
    unless it is most of the page's text: then the page is one of a set of near copies.
    """
    root = parse(page)
    out: list[tuple[bool, bool, str]] = []
    todo: list[tuple[Piece, Node | None, bool, bool]] = [(root, wrapper, False, wrapper is not None and _template(wrapper) and wrapper.fixed == root.hash)]
    while todo:
        piece, item, main, template = todo.pop()
        if piece.label == "#":
            out.append((main, template, piece.text))
            continue
        if piece.label and _boiler_label(piece.label):
            continue
        main = main or bool(piece.label) and _is_main(piece.label)
        below = []
        for (_, run_hash, run), x in zip(piece.runs, _matched(piece, item)):
            fixed = template or x is not None and _template(x) and x.fixed == run_hash
            below.extend((p, x, main, fixed) for p in run)
        todo.extend(reversed(below))
    if any(main for main, _, _ in out):
        return " ".join(block for main, _, block in out if main)
    own = sum(len(block) for _, template, block in out if not template)
    if 2 * own < sum(len(block) for _, _, block in out):
        return " ".join(block for _, _, block in out)
    return " ".join(block for _, template, block in out if not template)


# ---------------------------------------------------------------- tables


def host_of(url: Column) -> Column:
    """Lower-case host; empty for null and where there is no ://."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


_WRAPPER = "host string, wrapper string"
_SEEN = 100_000  # page hashes remembered; forgetting one only costs an alignment
_HELD = 2_000  # hosts of which a task holds wrappers; beyond that it hands out what it has


def _table(by_host: dict[str, Node]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(by_host), pa.string()), pa.array([dump(w) for w in by_host.values()], pa.string())], ["host", "wrapper"])


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", group: int = 32) -> DataFrame:
    """(host, wrapper): one wrapper for each host, from all its pages.

    Each task folds and aligns its own pages; then up to `group` wrappers of a host meet
    in a task at a time, until each host has one.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host: dict[str, Node] = {}
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                parsed = parse(page.as_py() or "")
                key = (host, parsed.hash)
                if key in seen:
                    continue
                if len(seen) < _SEEN:
                    seen.add(key)
                own = infer(parsed)
                by_host[host] = merge(by_host[host], own) if host in by_host else own
                if len(by_host) > _HELD:
                    yield _table(by_host)
                    by_host.clear()
        yield _table(by_host)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None  # rows come by host
        for batch in batches:
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held is not None and host != at:
                    yield _table({at: held})
                    held = None
                own = load(text.as_py())
                at, held = host, own if held is None else merge(held, own)
        if held is not None:
            yield _table({at: held})

    found = materialize(pages.select(host_of(F.col(url_col)).alias("host"), html_col).mapInArrow(local, _WRAPPER), "wrappers")
    while True:
        most = found.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return found
        salted = found.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(-(-most // group))))
        dealt = salted.repartition("host", "part").sortWithinPartitions("host", "wrapper").select("host", "wrapper")
        found = materialize(dealt.mapInArrow(meet, _WRAPPER), "wrappers")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(page_id, url, text) for every row of `pages`.

    Null HTML is empty, and empty pages have an empty text.  Null URLs and those without a
    host share one wrapper.  Repeated rows each return a row and count once as support of a
    template; an empty table gives an empty result.  Markup may nest to any depth.  Wrappers
    are broadcast while their summed size is proven to be at most `broadcast_bytes`; beyond
    that they are joined by host.
    """

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_host = {h: kept for h, w in zip(batch.column(0).to_pylist(), batch.column(1)) if (kept := prune(load(w.as_py()))) is not None}
            yield _table(by_host)

    wrappers = materialize(infer_wrappers(pages, url_col, html_col).mapInArrow(pruned, _WRAPPER), "templates")
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("_host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Node] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column(2), batch.column(3).to_pylist()):
                if wrapper and wrapper not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[wrapper] = load(wrapper)
                texts.append(extract_text(page.as_py() or "", known[wrapper] if wrapper else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    side = wrappers.select(F.col("host").alias("_h"), "wrapper")
    side = F.broadcast(side) if size <= broadcast_bytes else side
    joined = rows.join(side, F.col("_host") == F.col("_h"), "left")
    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(run, "page_id bigint, url string, text string")

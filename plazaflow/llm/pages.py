"""Main text of web pages by equivalence classes of template tokens.

A page is a sequence of tokens: opening and closing tags of blocks, told apart by the path of blocks they stand in, and
pieces of text, told apart by path and words. Tokens of one host that have the same occurrence vector (how often each page of the
host holds them) form an equivalence class. Vectors are never gathered: sums of hashes of (page, count), which partial
aggregation forms, are equal for equal vectors. Of the classes that SUPPORT of the host's pages hold, pages without any
token not counted:

1. a class is valid if its tags, in the order of their mean places, close what they open and its texts stand in elements
   that are open there; tokens that cross others, as when pages differ in their order, leave the class;
2. valid classes are nested: all tokens of a class must stand in one slot, that is, in one element of the classes of more
   pages, or at the top; a class that doesn't is taken apart. The nested classes are the host's template, and what stands
   between their tokens are slots;
3. texts of the template are its own words, not a page's. The main container is the innermost element of the template
   whose slots hold MAIN_SHARE of the text that varies; around it, elements that add nothing but headings to it.

A page's main text is what its slots within the main container hold. Elements that never hold main text (menus, footers,
forms, scripts ...) are no part of any slot. An article may repeat what others of its host say, so texts of the template in
an article or main element are its own unless they stand in a box of the template, such as a notice, that holds nothing else
on any page. Pages whose text is the template's for the most part are copies of one another, which have made the template:
they keep all of it, and a host of such pages finds its main container by all text instead of that which varies.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazaflow.llm.common import batches, cut, texts

#: Share of a host's pages that must hold a class of its template; a text must stand on two pages at least.
SUPPORT = 0.8
#: Share of the text that varies that a main container's slots must hold.
MAIN_SHARE = 0.6
#: Share of a page's main text, or of a host's, from which on what is the template's makes it a copy.
COPY = 0.5
#: An article beside one that is larger by more than this is a teaser.
TEASER = 0.125
#: Templates up to this size are broadcast.
BROADCAST_BYTES = 32 << 20

#: A tag from its name on; a quote starts a value only after an equals sign. Possessive, so nothing is tried twice.
TAG = re.compile(r"""<(?P<end>/)?+(?P<tag>[a-zA-Z][\w:-]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
#: The same to the next >, whatever quotes say: for what follows a tag that doesn't end.
LAX = re.compile(r"<(?P<end>/)?+(?P<tag>[a-zA-Z][\w:-]*+)(?P<attrs>[^>]*+)>")
RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in ("script", "style")}
NAMED = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())
#: An opening tag ends these elements if they are open within the same container.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCKS - {"body", "html"}
ENDED = {tag: sorted(ENDS.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())) for tag in {*ENDS, *CLOSES_P}}
CONTAINERS = frozenset("article aside body blockquote div fieldset footer form header html main nav section table td th ul ol dl".split())
#: Elements that may be a host's main container.
MAIN = frozenset("article main section div td body".split())
#: Elements whose text is never main text, and words that say so in a class, id or role that holds no others but PARTS.
NEVER = frozenset("nav footer aside form head script style noscript template iframe button select option textarea dialog menu svg object canvas audio video".split())
NEVER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain pagination popup promo promoted promotion related search share sharing sidebar skip social sponsor sponsored subscribe taboola toolbar widget widgets".split()
)
#: Those of them that say so within an article or main element as well.
SURE_WORDS = frozenset("ad ads advert adverts advertisement advertising comment comments cookie cookies disqus newsletter outbrain promoted sponsored taboola".split())
PARTS = frozenset("area bar block bottom box button buttons container content form global group header inner item items left link links list main outer page panel primary reader readers right secondary section site slot thread top user wrap wrapper".split())
SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
OPEN, CLOSE, TEXT, PAGE = range(4)
MASK = (1 << 64) - 1
#: Article and main elements around an article or main that a piece of text knows of.
OWN = 8


@dataclass
class Piece:
    """Text between two blocks' borders: the path of its element and of the block it stands in, and where it stands."""

    path: int
    text: str
    never: bool
    heading: bool
    inside: bool  # the main container asked for
    boxed: bool  # in one of the elements asked for that hold the template's words only
    own: tuple[int, ...]  # numbers of the article and main elements of the page that it stands in, innermost first


@dataclass
class Fact:
    """What is known of a token: its place, element, parent path and depth, and the text within: all of it, and in headings."""

    place: int
    tag: str = ""
    parent: int = 0
    depth: int = 0
    count: int = 0
    chars: int = 0
    heads: int = 0


@dataclass
class Page:
    pieces: list[Piece] = field(default_factory=list)
    tokens: dict[tuple[int, int], Fact] = field(default_factory=dict)


@dataclass
class Element:
    tag: str
    path: int
    never: bool
    heading: bool
    inside: bool
    boxed: bool
    own: tuple[int, ...]
    fact: Fact | None = None
    chars: int = 0
    heads: int = 0


_labels: dict[tuple[str, str], tuple[str, bool, bool]] = {}


def _label(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """The element's name in paths, and whether it never holds main text: outside of articles, and within."""
    known = _labels.get((tag, attrs))
    if known is None:
        names = [next(filter(None, m), "") for m in NAMED.findall(attrs)] if "=" in attrs else []
        words = {w.lower() for n in names for w in SPLIT.split(n) if w}
        each = [{w.lower() for w in SPLIT.split(n) if w} for value in names for n in value.split()]
        said = [own & NEVER_WORDS for own in each if own <= NEVER_WORDS | PARTS]
        named = tag not in ("body", "html", "article", "main")
        known = tag + "".join("." + w for w in sorted(words)), tag in NEVER or named and any(said), tag in NEVER or named and any(x & SURE_WORDS for x in said)
        if len(_labels) > 20_000:
            _labels.clear()
        if len(attrs) < 400:
            _labels[tag, attrs] = known
    return known


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_token(path: int, text: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(text, path & MASK))


def parse(html: str, main: int | None = None, boxes: frozenset[int] = frozenset()) -> Page:
    """Blocks of text in page order and the page's tokens, in time linear in the page; never fails on malformed markup.

    A tag that doesn't end before the page does is text, and from there on tags end at the next >. main, boxes: paths of the
    container that pieces are asked to stand in, and of elements that hold the template's words only.
    """
    page = Page()
    tokens = page.tokens
    stack = [Element("", 0, False, False, False, False, ())]
    open_: dict[str, list[int]] = defaultdict(list)  # where in the stack elements of a tag stand
    borders = [0]  # where containers stand
    buffer: list[str] = []
    owns = 0

    def seen(kind: int, path: int, **facts) -> Fact:
        fact = tokens.get((kind, path))
        if fact is None:
            fact = tokens[kind, path] = Fact(len(tokens), **facts)
        fact.count += 1
        return fact

    def flush() -> None:
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                top = stack[-1]
                page.pieces.append(Piece(top.path, text, top.never, top.heading, top.inside, top.boxed, top.own))
                if not top.never:
                    top.chars += len(text)
                    top.heads += len(text) if top.heading else 0
                    seen(TEXT, text_token(top.path, text), parent=top.path).chars += len(text)

    def pop_to(k: int) -> None:
        if any(e.tag in BLOCKS or e.never for e in stack[k:]):
            flush()
        while len(stack) > k:
            e = stack.pop()
            open_[e.tag].pop()
            if borders[-1] == len(stack):
                borders.pop()
            stack[-1].chars += e.chars
            stack[-1].heads += e.heads
            if e.fact:
                e.fact.chars += e.chars
                e.fact.heads += e.heads
                seen(CLOSE, e.path, parent=e.fact.parent)

    at, size, last, tagged = 0, len(html), html.rfind(">"), TAG
    while at < size:
        start = html.find("<", at)
        if start < 0 or start > last:
            buffer.append(html[at:])
            break
        if start > at:
            buffer.append(html[at:start])
        follows = html[start + 1 : start + 2]
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        if follows in ("!", "?"):
            at = html.find(">", start) + 1
            continue
        m = tagged.match(html, start)
        if m is None and tagged is TAG and (follows.isalpha() or follows == "/"):
            m = LAX.match(html, start)
            tagged = LAX if m else TAG
        if m is None:
            if follows == "/":  # no tag
                at = html.find(">", start) + 1
            else:
                buffer.append("<")
                at = start + 1
            continue
        at, tag, attrs = m.end(), m["tag"].lower(), m["attrs"]
        if m["end"]:
            if open_[tag]:
                pop_to(open_[tag][-1])
            elif tag in BLOCKS:
                flush()
            continue
        if tag in ENDED:
            while (k := max((open_[t][-1] for t in ENDED[tag] if open_[t]), default=0)) and k >= borders[-1]:
                pop_to(k)
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            buffer.append(" ")
        if tag in VOID:
            continue
        top = stack[-1]
        label, outside, within = _label(tag, attrs)
        never = (within if top.own else outside) or top.never or tag == "header" and not top.own
        if never and not top.never:
            flush()
        path, fact = top.path, None
        if tag in BLOCKS and not top.never:
            path = _signed(xxhash.xxh3_64_intdigest(label, top.path & MASK))
            fact = seen(OPEN, path, tag=tag, parent=top.path, depth=len(stack))
        own = top.own
        if tag in ("article", "main") and not never:
            owns += 1
            own = (owns, *own[:OWN])
        open_[tag].append(len(stack))
        if tag in CONTAINERS:
            borders.append(len(stack))
        stack.append(Element(tag, path, never, tag in HEADINGS or top.heading and tag not in CONTAINERS, top.inside or path == main, top.boxed or path in boxes, own, fact))
        if tag in RAW_END:
            m = RAW_END[tag].search(html, at)
            at = m.end() if m else size
            pop_to(len(stack) - 1)
        elif attrs.endswith("/") and tag not in BLOCKS:
            pop_to(len(stack) - 1)
    flush()
    pop_to(1)
    return page


TOKENS = "host string, kind int, token bigint, v1 bigint, v2 bigint, v3 bigint, n_pages bigint, place double, tag string, parent bigint, depth int, chars bigint, heads bigint"
TYPES = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
WORD = (1 << 21) - 1


def occurrences(pages: DataFrame) -> DataFrame:
    """Of each page's distinct tokens the facts that are summed by host and token. The hash of (page, count) comes as three
    words of 21 bits, whose sums stay within 64 bits for 2**42 pages of a host. The page itself is a token of kind PAGE."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, "html"):
            rows = []
            for host, key, html in zip(batch.column("host").to_pylist(), batch.column("page_key").to_pylist(), texts(batch.column("html"))):
                tokens = parse(html).tokens
                if tokens:
                    rows.append((host, PAGE, 0, 0, 0, 0, 1, 0.0, None, 0, 0, 0, 0))
                hashes = {}
                for (kind, path), f in tokens.items():
                    h = hashes.get(f.count)
                    if h is None:
                        x = xxhash.xxh64_intdigest(f"{key}:{f.count}")
                        h = hashes[f.count] = (x & WORD, x >> 21 & WORD, x >> 42 & WORD)
                    rows.append((host, kind, path, *h, 1, float(f.place), f.tag or None, f.parent, f.depth, f.chars, f.heads))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), TYPES)], [f.split()[0] for f in TOKENS.split(", ")])

    return pages.mapInArrow(run, TOKENS)


@dataclass
class Template:
    """A host's template: its nested classes, each with the slot that it stands in (0 for the top), its texts, the path
    of its main container (None if it has none), and of elements that hold no text but the template's."""

    classes: list[tuple[int, list[tuple[int, int]]]]
    texts: frozenset[int]
    main: int | None
    boxes: frozenset[int] = frozenset()


def nested(tokens: list[tuple[int, int]], parent: dict[tuple[int, int], int], above: dict[int, int], depth: dict[int, int]) -> list[tuple[int, int]]:
    """The tokens of a class, in their order, without those that cross others: a closing tag must close what was opened
    last, and a text must stand in an element below the one that is open there."""
    held = set(tokens)
    open_: list[int] = []
    still: set[int] = set()
    bad: set[int] = set()
    good = []
    for kind, path in tokens:
        if kind == OPEN and (CLOSE, path) in held:
            open_.append(path)
            still.add(path)
            good.append((kind, path))
        elif kind == CLOSE and path in still:
            while open_[-1] != path:
                bad.add(open_[-1])
                still.discard(open_.pop())
            still.discard(open_.pop())
            good.append((kind, path))
        elif kind == TEXT:
            at = parent[kind, path]
            while open_ and depth.get(at, 0) > depth[open_[-1]]:
                at = above[at]
            if not open_ or at == open_[-1]:
                good.append((kind, path))
    return [t for t in good if t[0] == TEXT or t[1] not in bad]


def _slot(at: int, above: dict[int, int], within: set[int], own: set[int], known: dict[int, int]) -> int:
    """The innermost of `at` and what is above it that nested classes hold, other than the class's own elements."""
    passed = []
    while at and at not in known and (at in own or at not in within):
        passed.append(at)
        at = above.get(at, 0)
    found = known.get(at, at)
    known.update(dict.fromkeys(passed, found))
    return found


def deduce(tokens: list[dict]) -> Template:
    """Template of a host from its tokens, those that SUPPORT of its pages hold. An element that so many pages hold stands in
    elements that as many hold, so paths are whole."""
    opened = [t for t in tokens if t["kind"] == OPEN]
    above, tag, depth, chars, heads = ({t["token"]: t[name] for t in opened} for name in ("parent", "tag", "depth", "chars", "heads"))
    parent = {(t["kind"], t["token"]): t["parent"] for t in tokens}
    classes: dict[tuple, list[dict]] = defaultdict(list)
    for t in tokens:
        classes[t["v1"], t["v2"], t["v3"], t["n_pages"]].append(t)
    found: list[tuple[int, list[tuple[int, int]]]] = []
    within: set[int] = set()
    boilerplate: set[int] = set()
    for members in sorted(classes.values(), key=lambda c: (-c[0]["n_pages"], -len(c), min((t["place"], t["kind"], t["token"]) for t in c))):
        order = nested([(t["kind"], t["token"]) for t in sorted(members, key=lambda t: (t["place"], t["kind"], t["token"]))], parent, above, depth)
        own, known = {path for kind, path in order if kind != TEXT}, {}
        parts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for token in order:
            parts[_slot(parent[token], above, within, own, known)].append(token)
        found += parts.items()
        within |= own
        if members[0]["n_pages"] > 1:
            boilerplate.update(path for kind, path in order if kind == TEXT)
    less: dict[int, int] = defaultdict(int)
    for t in tokens:
        if t["kind"] == TEXT and t["token"] in boilerplate:
            less[t["parent"]] += t["chars"]
    every = dict(chars)
    for path in sorted(chars, key=lambda p: -depth[p]):  # what varies is the rest
        chars[path] -= less[path]
        less[above[path]] += less[path]
    boxes = frozenset(p for p in within if tag[p] in CONTAINERS and every[p] and not chars[p])
    top = [p for p in chars if above[p] not in chars]
    if sum(chars[p] for p in top) < COPY * sum(every[p] for p in top):
        chars = every
    total = max((n for path, n in chars.items() if above[path] not in chars), default=0)
    inside = [p for p in within if tag[p] in MAIN and total > 0 and chars[p] >= MAIN_SHARE * total]
    main = max(inside, key=lambda p: (depth[p], chars[p], p), default=None)
    while main is not None and (up := above[main]) in within and tag[up] in MAIN - {"body"} and chars[up] - heads[up] <= chars[main] - heads[main]:
        main = up
    return Template(found, frozenset(boilerplate), main, boxes)


NO_TEMPLATE = Template([], frozenset(), None)


def own_template(html: str) -> Template:
    """Template of a page whose host has none: of the page alone."""
    return deduce([{"kind": kind, "token": path, "v1": f.count, "v2": 0, "v3": 0, "n_pages": 1, "place": float(f.place), "tag": f.tag or None, "parent": f.parent, "depth": f.depth, "chars": f.chars, "heads": f.heads} for (kind, path), f in parse(html).tokens.items()])


def slots(html: str, template: Template) -> list[str]:
    """The blocks of the main text, in page order: what the slots in the main container hold, or those of the whole page
    where it lacks that container.

    Where article and main elements there hold MAIN_SHARE of the text, what stands outside of them is left out, and so are
    articles that are teasers beside the largest one; all others stay, in order. A page whose text is the template's for the
    most part is a copy and keeps it.
    """
    pieces = [p for p in parse(html, template.main, template.boxes).pieces if not p.never]
    if any(p.inside for p in pieces):
        pieces = [p for p in pieces if p.inside]
    held: dict[tuple[int, ...], int] = defaultdict(int)
    for p in pieces:
        held[p.own[:1]] += len(p.text)
    if len(held) > 1:
        if held[()] < (1 - MAIN_SHARE) * sum(held.values()):
            del held[()]
        largest = max(held, key=lambda k: (held[k], k))
        around = {k for p in pieces if p.own[:1] == largest for k in p.own}
        pieces = [p for p in pieces if (k := p.own[:1]) in held and (held[k] >= TEASER * held[largest] or k and k[0] in around)]
    own = [p for p in pieces if text_token(p.path, p.text) not in template.texts or p.own and not p.boxed] if template.texts else pieces
    copied = sum(len(p.text) for p in own) < COPY * sum(len(p.text) for p in pieces)
    return [p.text for p in (pieces if copied else own)]


def with_host(pages: DataFrame) -> DataFrame:
    """Lower-cased host of the URL; null or host-less URLs share the host ''. page_key tells pages of one host apart."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select("page_id", "url", "html", host.alias("host"), F.xxhash64("page_id", "url").alias("page_key"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, tokens): what SUPPORT of a host's pages hold; pages without a token, such as null html, don't count. A host's
    pages are never gathered, only sums over them; what is listed is no longer than a page's tokens divided by SUPPORT.
    Tokens of one page, which most texts are, can't be listed and are left out before hosts meet their number of pages
    (a host's only page is its own template). The listed ones are written before they are gathered by host, so that a
    host with very many tokens splits like any skewed join."""
    sums = [F.sum(c).alias(c) for c in ("v1", "v2", "v3", "n_pages", "place", "chars", "heads")]
    found = cut(occurrences(pages).groupBy("host", "kind", "token").agg(*sums, F.max("tag").alias("tag"), F.max("parent").alias("parent"), F.max("depth").alias("depth")))
    number = found.where(F.col("kind") == PAGE).select("host", F.col("n_pages").alias("pages"))
    listed = cut(found.where((F.col("kind") != PAGE) & (F.col("n_pages") > 1)).join(number, "host").where(F.col("n_pages") >= SUPPORT * F.col("pages")))
    each = F.struct("kind", "token", "v1", "v2", "v3", "n_pages", (F.col("place") / F.col("n_pages")).alias("place"), "tag", "parent", "depth", "chars", "heads")
    return listed.groupBy("host").agg(F.collect_list(each).alias("tokens"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages.

    Templates of up to BROADCAST_BYTES go to every executor, so that pages aren't shuffled; more are joined by host, where
    a host with very many pages splits like any skewed join. Null html counts as empty and gives an empty text; rows
    without a host share a template; repeated rows count as pages of their own and come out as they go in; other columns
    are dropped, whatever their names.
    """
    base = with_host(pages)
    known = cut(templates(base).withColumnRenamed("host", "_host"))
    size = known.agg(F.sum(F.size("tokens").cast("bigint") * 100)).first()[0] or 0
    known = F.broadcast(known) if size <= BROADCAST_BYTES else known
    joined = base.join(known, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "host", "tokens")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, Template | None] = {}
        for batch in batches(source, "html"):
            out = []
            tokens = batch.column("tokens")
            for k, (host, html) in enumerate(zip(batch.column("host").to_pylist(), texts(batch.column("html")))):
                if host not in own:
                    if len(own) > 1000:
                        own.clear()
                    listed = tokens[k].as_py()
                    own[host] = deduce(listed) if listed else None
                out.append("\n".join(slots(html, own[host] or own_template(html))))
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")

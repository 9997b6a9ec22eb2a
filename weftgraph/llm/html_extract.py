"""Main text of web pages by deduction of each host's template from equivalence classes of tokens."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .url_filter import url_host

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAME = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {
    **dict.fromkeys("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split(), ("p",)),
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",),
    "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "thead": ("caption", "colgroup"), "tfoot": ("thead", "tbody", "tr", "td", "th"),
}
SCOPES = frozenset("article aside section div ul ol dl table body main nav header footer form fieldset blockquote figure td th".split())

CONTAINERS = frozenset("html body div section center table tbody tr td".split())

# Parts of a page that are not its main text: by element, by role, and by words in class and id.
ASIDE = frozenset("head nav aside footer form script style noscript template iframe textarea select button input object svg math canvas audio video map dialog menu datalist title xmp noembed noframes".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Words that tell such a part wherever they stand in a container's class or id.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promoted nav navbar navigation menu menus sidebar sidebars breadcrumb breadcrumbs "
    "footer masthead topbar cookie cookies consent gdpr popup modal newsletter comment comments commentlist disqus pagination pager".split()
)
#: Words that tell one as a container's whole class; in longer names and in ids they may be an article's own, so there the template must have the element.
VAGUE_WORDS = frozenset("header toolbar notice notices notification alert overlay promotion subscribe subscription signup login share sharing social discussion respond reply replies related recommended recommendations widget widgets copyright legal disclaimer skip".split())
MAIN_WORDS = frozenset("article articlebody main maincontent content contents post postcontent postbody entry entrycontent story storybody body text".split())
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")

#: What a token is: no side part, one wherever it stands, one if the template has it.
PLAIN, SIDE, VAGUE = 0, 1, 2


@dataclass(slots=True)
class Element:
    """An open element: the number of its token, and what it hands down."""

    tag: str
    token: int
    aside: bool
    link: bool
    main: bool


@dataclass(slots=True)
class Token:
    """A start tag, told apart by its path from the root, in which class and id tell elements of one name apart. A path is
    known by a 64-bit hash of its parent's and its own name, so that depth costs nothing."""

    id: int
    parent: int
    name: str
    depth: int
    place: float
    grade: int
    kind: int
    count: int = 0
    chars: int = 0
    linked: int = 0


@dataclass(slots=True)
class Page:
    """A page as tokens, in order of their first place, and the blocks of text between them. Parents come before their children; the first
    token is the page itself. sequence: every occurrence of a tag or block, by id, in page order."""

    tokens: list[Token] = field(default_factory=list)
    blocks: list[tuple[int, int, str]] = field(default_factory=list)  # token, id, text
    sequence: list[int] = field(default_factory=list)


def _id(parent: int, name: str) -> int:
    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), parent & (1 << 64) - 1) - (1 << 63)


def _names(tag: str, attributes: str) -> tuple[str, set[str], int]:
    """Class and id as they stand in a token, their words, and what kind of token they make."""
    label, words, kind = "", set(), PLAIN
    container = tag in CONTAINERS or tag in SCOPES or tag in ("ul", "ol", "dl", "details", "center")
    for m in _NAME.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "itemprop"):
            if not value:
                continue
            label += "." + ".".join(sorted(value.split()))
            whole = {re.sub("[^a-z0-9]", "", w.lower()) for w in value.split()}
            parts = {w.lower() for w in _SPLIT.split(value) if w} | whole
            words |= parts
            vague = VAGUE_WORDS - {"header"} if parts & MAIN_WORDS else VAGUE_WORDS
            if name == "class" and whole & (ASIDE_WORDS | vague if container else ASIDE_WORDS) or container and parts & ASIDE_WORDS:
                kind = SIDE
            elif kind == PLAIN and container and parts & vague:
                kind = VAGUE
        elif name == "role":
            kind = SIDE if value.lower() in ASIDE_ROLES else kind
            words |= {"main"} if value.lower() in ("main", "article") else set()
        elif name == "hidden" or value.lower() == "true":
            kind = SIDE
    return label, words, kind


class _Open:
    """The open elements, from the root. Those since the last element that bounds a search form a frame, which counts its tags, so
    that a search is made only where it finds something."""

    def __init__(self):
        self.elements: list[Element] = []
        self.frames: list[dict[str, int]] = [{}]
        self.scopes: list[int] = []
        self.tags: dict[str, int] = {}

    def push(self, e: Element) -> None:
        self.elements.append(e)
        self.tags[e.tag] = self.tags.get(e.tag, 0) + 1
        if e.tag in SCOPES:
            self.frames.append({})
            self.scopes.append(len(self.elements) - 1)
        else:
            self.frames[-1][e.tag] = self.frames[-1].get(e.tag, 0) + 1

    def cut(self, k: int) -> bool:
        """Close the elements from place k on; whether one of them is a block."""
        block = False
        while len(self.elements) > k:
            e = self.elements.pop()
            self.tags[e.tag] -= 1
            if e.tag in SCOPES:
                self.frames.pop()
                self.scopes.pop()
            else:
                self.frames[-1][e.tag] -= 1
            block |= e.tag not in INLINE
        return block

    def last(self, tag: str) -> int | None:
        """The place of the innermost element that an end tag closes: an inline one doesn't reach beyond its frame."""
        if not (self.frames[-1] if tag in INLINE else self.tags).get(tag):
            return None
        return next(k for k in range(len(self.elements) - 1, -1, -1) if self.elements[k].tag == tag)

    def closing(self, tags: tuple[str, ...]) -> int | None:
        """The place of the innermost element of these tags, no further than the element that bounds the search."""
        if any(self.frames[-1].get(t) for t in tags):
            return next(k for k in range(len(self.elements) - 1, -1, -1) if self.elements[k].tag in tags)
        return self.scopes[-1] if self.scopes and self.elements[self.scopes[-1]].tag in tags else None


def read_page(html: str | None) -> Page:
    """Tokens and text blocks of a page. Text is decoded, white space is one space, empty blocks are left out. A block ends
    where a block element begins or ends, and is known by its element's token and its text. Time and memory grow with the page, however deep its elements lie."""
    out, opened, text = Page([Token(0, -1, "", 0, 0.0, 0, PLAIN, 1)], [], [0]), _Open(), []
    numbers: dict[int, int] = {0: 0}
    where, linked = -1, 0
    blocks_of: list[int] = [0]  # the token of the innermost block element, for each open element

    def flush() -> None:
        nonlocal text, where, linked
        if text:
            block = " ".join(entities.unescape("".join(text)).split())
            if block and where >= 0:
                token = out.tokens[where]
                out.blocks.append((where, _id(token.id, "#" + block), block))
                out.sequence.append(out.blocks[-1][1])
                token.chars += len(block)
                token.linked += min(linked, len(block))
        text, where, linked = [], -1, 0

    def add(part: str) -> None:
        nonlocal where, linked
        if not part:
            return
        if part.isspace():
            if text:
                text.append(" ")
            return
        top = opened.elements[-1] if opened.elements else None
        if top and top.aside:
            return
        if where < 0:
            where = blocks_of[-1]
        if top and top.link:
            linked += len(part)
        text.append(part)

    def close(k: int) -> None:
        was = len(opened.elements)
        if opened.cut(k):
            flush()
        del blocks_of[len(blocks_of) - (was - k) :]

    html = html or ""
    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        ending, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if ending:
            if (k := opened.last(tag)) is not None:
                close(k)
            continue
        if closes := CLOSES.get(tag):
            while (k := opened.closing(closes)) is not None:
                close(k)
                if tag not in ("tr", "td", "th", "tbody", "tfoot"):
                    break
        if tag not in INLINE:
            if tag in ("br", "img", "input"):
                add(" ")
            else:
                flush()
        above = opened.elements[-1] if opened.elements else None
        label, words, kind = _names(tag, attributes) if attributes.strip() else ("", set(), PLAIN)
        inside = bool(above and above.main)
        grade = 2 if tag in ("article", "main") or "main" in words or "articlebody" in words else 1 if words & MAIN_WORDS else 0 if tag in CONTAINERS else -1
        if tag in ("body", "html", "article", "main"):
            kind = PLAIN
        if tag in ASIDE or tag == "header" and not inside or bool(above and above.aside):
            kind = SIDE
        parent = above.token if above else 0
        path = _id(out.tokens[parent].id, tag + label)
        if (number := numbers.get(path)) is None:
            number = numbers[path] = len(out.tokens)
            out.tokens.append(Token(path, parent, tag + label, out.tokens[parent].depth + 1, m.start() / size, -1 if kind == SIDE else grade, kind))
        out.tokens[number].count += 1
        if kind != SIDE:
            out.sequence.append(path)
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "math"):
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        opened.push(Element(tag, number, kind == SIDE, bool(above and above.link) or tag == "a", inside or grade > 0 and kind != SIDE))
        blocks_of.append(blocks_of[-1] if tag in INLINE else number)
    flush()
    for t in reversed(out.tokens[1:]):
        out.tokens[t.parent].chars += t.chars
        out.tokens[t.parent].linked += t.linked
    return out


def best_token(tokens: list[Token]) -> int | None:
    """The outermost token that marks main text, if it holds any; else the innermost container that holds all of the page's text; None if there is no such token."""
    if not tokens[0].chars:
        return None
    for grade in (2, 1):
        if marked := [(-t.chars if grade == 1 else 0, t.depth, t.place, t.id) for t in tokens if t.grade == grade and t.chars > t.linked]:
            return min(marked)[-1]
    return max(((t.depth, -t.place, t.id) for t in tokens[1:] if t.chars >= tokens[0].chars and t.grade == 0), default=(None,))[-1]


def extract(page: Page, main: int | None = None, texts: frozenset[int] = frozenset(), sides: frozenset[int] = frozenset()) -> str:
    """The text in the slots below the template's main token, in page order; of a page without it, that of the page's own. Where
    that token marks main text, the text below all of the page's tokens that mark it as clearly is kept. What the template itself
    has there, blocks of text (`texts`) and side parts (`sides`), goes. Where the template's text would be half or more of a page's, its pages are copies of each other, and it stays."""
    found = next((t for t in page.tokens if t.id == main), None) if main is not None else None
    if found is None and (best := best_token(page.tokens)) is not None:
        found = next(t for t in page.tokens if t.id == best)
    kept, gone = [False] * len(page.tokens), [False] * len(page.tokens)
    for i, t in enumerate(page.tokens):
        kept[i] = found is None or t.id == found.id or found.grade > 0 and t.grade == found.grade and t.chars > t.linked or i > 0 and kept[t.parent]
        gone[i] = t.kind == VAGUE and t.id in sides or i > 0 and gone[t.parent]
    blocks = [(i, text) for where, i, text in page.blocks if kept[where] and not gone[where]]
    own = [text for i, text in blocks if i not in texts]
    if 2 * sum(map(len, own)) <= sum(len(text) for _, text in blocks):
        own = [text for _, text in blocks]
    return " ".join(own)


_SEEN = "host string, id long, name string, block boolean, pages long, vector long, place double, depth int, grade int, kind int, chars long, linked long"
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch, host and token: the pages with it, and its occurrence vector as a sum of hashes of (page, count). Blocks of text are tokens, too."""
    for b in batches:
        seen: dict[tuple[str, int], list] = {}
        for host, page_hash, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            page, marks = read_page(html.as_py()), {}
            rows = [(t.id, t.name, False, t.count, t.place, t.depth, t.grade, t.kind, t.chars, t.linked) for t in page.tokens]
            counts: dict[int, list[int]] = {}
            for k, (_, i, _) in enumerate(page.blocks):
                counts.setdefault(i, [0, k])[0] += 1
            rows += [(i, "", True, n, k / len(page.blocks), 0, -1, PLAIN, 0, 0) for i, (n, k) in counts.items()]
            for i, name, block, count, place, depth, grade, kind, chars, linked in rows:
                if count not in marks:
                    marks[count] = xxhash.xxh64_intdigest(f"{page_hash} {count}") >> 20
                s = seen.setdefault((host, i), [name, block, 0, 0, 0.0, depth, grade, kind, 0, 0])
                s[2] += 1
                s[3] += marks[count]
                s[4] += place
                s[6], s[7] = max(s[6], grade), max(s[7], kind)
                s[8] += chars
                s[9] += linked
        if seen:
            rows = [(*k, *v) for k, v in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=[x.split()[0] for x in _SEEN.split(", ")])


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, class, order) of each class of more than one token that a page has: a hash of its tokens' order if the page has them over
    and over in the same one, else 0. Columns: host, html, ids, classes."""
    for b in batches:
        out: set[tuple[str, int, int]] = set()
        for host, html, ids, classes in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), strict=True):
            if not ids.is_valid:
                continue
            class_of, runs = dict(zip(ids.as_py(), classes.as_py(), strict=True)), {}
            for i in read_page(html.as_py()).sequence:
                if (c := class_of.get(i)) is not None:
                    runs.setdefault(c, []).append(i)
            for c, run in runs.items():
                period = list(dict.fromkeys(run))
                again = run == period * (len(run) // len(period))
                out.add((host, c, xxhash.xxh64_intdigest(str(period)) >> 1 | 1 if again else 0))
        rows = list(zip(*out, strict=True)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64())], names=["host", "class", "order"])


def templates(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", support: float = 0.5, least: int = 4) -> DataFrame:
    """(host, main, name, pages, classes, tokens, texts, sides): each host's template.

    Tokens are start tags, told apart by their path, and blocks of text, told apart by their tag and words. Those of a host with the same
    occurrence vector, the count on each page, form an equivalence class. A class is valid if its tokens stand on at least
    `support` of the host's pages, and on every page that has them in one and the same order, as often as it may be repeated;
    paths nest, so valid classes nest into one template. Its tokens are the template, its slots what stands between them:
    main is the token whose slots hold the main text, the outermost that marks an article, else one named so with most
    text, else the innermost container with all of the host's text. texts are the template's blocks of text, those in a
    class with a tag, and sides its tags that may be side parts by their name; both only on `least` pages or more, as fewer may be copies of each other.
    Only counts and sums per (host, token) and orders per (host, class) are shuffled; no task holds a host's pages.
    """
    slim = pages.select(url_host(F.col(url)).alias("host"), F.xxhash64(page, url).alias("page"), F.col(html).alias("html"))
    tokens = slim.mapInArrow(_observe, _SEEN).groupBy("host", "id").agg(
        F.max("name").alias("name"), F.max("block").alias("block"), F.sum("pages").alias("pages"), F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector"), (F.sum("place") / F.sum("pages")).alias("place"),
        F.max("depth").alias("depth"), F.max("grade").alias("grade"), F.max("kind").alias("kind"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
    )
    tokens = saved(tokens, "tokens")
    whole = tokens.where("id = 0").select("host", F.col("pages").alias("_pages"), F.col("chars").alias("_chars"))
    common = tokens.join(whole, "host").where((F.col("pages") >= support * F.col("_pages")) & (~F.col("block") | (F.col("pages") >= least)))
    common = common.withColumn("class", F.xxhash64("vector", "pages"))
    sizes = common.groupBy("host", "class").agg(F.count("*").alias("size"), F.bool_or(~F.col("block") & (F.col("kind") != SIDE)).alias("tagged")).where("tagged").drop("tagged")
    common = saved(common.join(sizes, ["host", "class"]), "classes")
    asked = common.where((F.col("size") > 1) & (F.col("kind") != SIDE)).groupBy("host").agg(F.collect_list(F.struct("id", "class")).alias("of"))
    asked = asked.select("host", F.transform("of", lambda x: x["id"]).alias("ids"), F.transform("of", lambda x: x["class"]).alias("classes"))
    orders = slim.join(asked, "host").select("host", "html", "ids", "classes").mapInArrow(_orders, "host string, class long, order long")
    broken = orders.groupBy("host", "class").agg(F.min("order").alias("a"), F.max("order").alias("b")).where("a != b or a = 0").select("host", "class")
    valid = common.join(saved(broken, "broken"), ["host", "class"], "left_anti")
    grade = F.when((F.col("grade") > 0) & (F.col("chars") > F.col("linked")), F.col("grade")).when((F.col("grade") == 0) & (F.col("id") != 0) & (F.col("chars") > 0) & (F.col("chars") >= F.col("_chars")), 0).otherwise(-1)
    first = F.when(grade == 2, -F.col("depth")).when(grade == 1, F.col("chars")).otherwise(F.col("depth"))
    order = F.struct(grade.alias("grade"), first.alias("first"), (-F.col("place")).alias("place"), F.col("size"), F.col("id"), F.col("name"))
    often = F.col("pages") >= least
    best = valid.groupBy("host").agg(
        F.max(F.when(~F.col("block"), order)).alias("best"), F.max("_pages").alias("pages"), F.countDistinct("class").alias("classes"), F.count("*").alias("tokens"),
        F.collect_list(F.when(F.col("block") & often, F.col("id"))).alias("texts"), F.collect_list(F.when((F.col("kind") == VAGUE) & often, F.col("id"))).alias("sides"),
    )
    found = F.col("best.grade") >= 0
    return best.select("host", F.when(found, F.col("best.id")).alias("main"), F.when(found, F.col("best.name")).alias("name"), "pages", "classes", "tokens", "texts", "sides")


def extract_pages(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page, url, text) for each page: the main text in the slots of its host's template.

    Menus, headers, footers, sidebars, notices, adverts, forms, reader comments, scripts and styles are left out: by the
    template, where they are the same on every page; by element, role, or words in class and id, where their text differs.
    Markup goes, character references are decoded, blocks are joined by a space. A null or empty page, or one without such text, has an empty text. A null url's host is
    empty, and a host like any other. Markup that is cut off or badly nested is read as far as it makes sense, nesting of any depth too;
    repeated rows keep a row each. Templates are a table; whether it is sent whole or shuffled, Spark decides by size.
    """
    found = saved(templates(pages, page, url, html).select(F.col("host").alias("_host"), "main", "texts", "sides"), "templates")
    slim = pages.select(F.col(page).cast("long").alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), url_host(F.col(url)).alias("_host"))
    joined = slim.join(found, "_host", "left").select("id", "url", "html", "main", "texts", "sides")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(read_page(h.as_py()), m.as_py(), frozenset(t.as_py() or ()), frozenset(x.as_py() or ())) for h, m, t, x in zip(*b.columns[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    return joined.mapInArrow(run, "id long, url string, text string").withColumnsRenamed({"id": page, "url": url})

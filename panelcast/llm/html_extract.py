"""Main text of web pages by wrapper induction.

Pages of a host come from the same program, so their DOM trees differ where the
program filled in content. For every host:

1. each page is parsed and reduced to an outline: tags, classes, hashes and lengths
   of texts, with runs of like siblings (the paragraphs of an article) as one node;
2. over all pages of the host, the pages are counted that have a text in an element of
   the same name. Pages whose ``LONGEST`` longest texts are the same are copies of one
   article and count once. A text that recurs on a share of ``RECURS`` of the different
   pages, and on ``RECURS_ON`` at least, is template, wherever it stands and whatever its element is called: a notice in
   the article, a menu made of <div>, one of two layouts;
3. the outlines of ``REFERENCES`` pages, those with the smallest of as many hashes of
   their page_id, are aligned pairwise by simple tree matching. Nodes with the same
   text in all of them, or with template text only, are template; the others are slots.
   The wrapper is the path of the <article> or <main> that holds nearly all slot text, or
   else of the smallest container that holds all of it, outside of links and of elements
   that are furniture by their tag, role or class, and the template texts;
4. each page is parsed again and gives the blocks below its host's wrapper path,
   without template texts and furniture.

A page that lacks its host's path, or a host with one page, is its own reference: all
its text counts as slot. Only hashes and lengths are shuffled; counts and references
combine before the shuffle, and are kept by host and text, so a host with a third of all
pages is spread by its texts and sends a few outlines per task. Wrappers are broadcast
while they take less than ``BROADCAST_BYTES``, else joined.

A class or id makes furniture if all words of the name are listed (``has-sidebar`` is
not), unless the element holds most of the text of a page without <article> or <main>.

Elements nested deeper than ``DEPTH`` are laid out in the one at that depth: their texts
and blocks stay, in order. Pages are read in one pass, whatever they hold; a tag that is
cut off at the end of the page is no text.

Defined cases: pages of any length are read whole; a null or empty html, or one without text, gives an empty text; a null
url counts as a host of its own; unclosed, misnested and cut off elements end with
what contains them; repeated page_ids are extracted row by row; ties between paths go
to the one that more references have, then the first in order of text; an empty table
gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.session import materialize

REFERENCES = 3
SHARE = 0.75
#: Different pages of a host on which a text of the template recurs: so many, and this share.
RECURS_ON = 3
RECURS = 0.3
#: Texts, outside of furniture, by which copies of one article are told.
LONGEST = 3
BROADCAST_BYTES = 32 << 20
#: Elements in each other, of a page's tree.
DEPTH = 200

#: Elements by role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math select".split())
BLOCKS = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre address figure figcaption header footer nav aside form fieldset details summary hr center".split()
)
CLOSES_P = BLOCKS - {"html", "body", "tr", "td", "th", "thead", "tbody", "tfoot"}
CONTAINERS = frozenset("html body article section main div table tbody tr td center".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("table ul ol dl td th article section main div body aside nav form".split())
FURNITURE_TAGS = frozenset("nav footer aside form button menu dialog head object fieldset".split()) | RAW
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar sidebars nav navbar "
    "navigation menu menus submenu breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended "
    "recommendations comment comments commentlist respond disqus reply replies widget widgets toolbar pagination pager skip".split()
)
#: Words that may stand beside these in the name of an element.
QUALIFIERS = frozenset(
    "site page main left right top bottom primary secondary global post posts list box block area container wrapper wrap "
    "section inner outer links link bar form icons buttons button item items row rail slot unit policy message".split()
)

TOKEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
QUOTE_OR_END = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[a-z]+")


def is_furniture(name: str) -> bool:
    """Whether a whole class or id names furniture."""
    words = set(WORD.findall(name))
    return not FURNITURE_WORDS.isdisjoint(words) and words <= FURNITURE_WORDS | QUALIFIERS


SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "name", "furniture", "named", "parts")

    def __init__(self, tag: str, attributes: str) -> None:
        self.tag, self.name, self.parts = tag, tag, []
        self.furniture, self.named = tag in FURNITURE_TAGS, False
        if attributes.strip(" /"):
            given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
            names = f"{given.get('class', '')} {given.get('id', '')}".lower()
            marks = WORD.findall(names)
            self.name = ".".join([tag, *marks])
            hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
            named = any(map(is_furniture, names.split())) and tag not in ("html", "body", "article", "main")
            if tag in ("article", "main"):  # a reader's comment may be an article
                named = not {"comment", "comments", "reply", "related", "promo", "ad"}.isdisjoint(marks)
            self.furniture |= hidden or given.get("role", "").lower() in FURNITURE_ROLES
            #: furniture by nothing but its name
            self.named = named and not self.furniture
            self.furniture |= named


class Tokens:
    """Tags of a page with their place, each character looked at a bounded number of times."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.missing: set[str] = set()  # quotes that no later place closes

    def tag_end(self, at: int) -> int:
        """Place of the > that ends a tag, not one in quotes; -1 if there is none."""
        while found := QUOTE_OR_END.search(self.text, at):
            mark, at = found[0], found.end()
            if mark == ">":
                return found.start()
            if mark not in self.missing:
                closing = self.text.find(mark, at)
                if closing < 0:
                    self.missing.add(mark)
                else:
                    at = closing + 1
        return -1


def parse(text: str) -> Node:
    """The page as a tree; texts are strings among the children."""
    root = Node("html", "")
    tokens, stack, flat = Tokens(text), [root], []
    at = written = 0
    while token := TOKEN.search(text, at):
        start, at = token.span()
        if token[1]:
            end = text.find("-->", at)
            after = len(text) if end < 0 else end + 3
        else:
            end = text.find(">", at) if token[2] else tokens.tag_end(at)
            after = end + 1
            if end < 0:  # no tag ends any more: what stands before the last one is text
                cut = text.rfind("<") if token[4] else len(text)
                stack[-1].parts.append(text[written:cut])
                written = len(text)
                break
        if start > written:
            stack[-1].parts.append(text[written:start])
        at = written = after
        tag = (token[4] or "").lower()
        if not tag or (tag == "html" and not token[3]):
            continue
        if token[3]:
            if tag in flat:
                del flat[len(flat) - 1 - flat[::-1].index(tag) :]
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    flat.clear()
                    break
            continue
        if len(stack) < DEPTH:
            close(stack, tag)
        attributes = text[token.end() : end]
        node = Node(tag, attributes)
        stack[-1].parts.append(node)
        if tag in RAW:
            finish = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(text, at)
            at = written = finish.end() if finish else len(text)
        elif tag not in VOID and not attributes.endswith("/"):
            if len(stack) < DEPTH:
                stack.append(node)
            elif len(flat) < DEPTH:
                flat.append(tag)
    if written < len(text):
        stack[-1].parts.append(text[written:])
    relieve(root)
    return root


def relieve(root: Node) -> None:
    """Names do not make furniture of what holds most of a page's text, unless an
    <article> or <main> tells where the text is."""
    length: dict[int, int] = {}

    def measure(node: Node, linked: bool) -> int:
        own = sum(0 if linked else len(p.strip()) for p in node.parts if isinstance(p, str))
        below = (measure(p, linked or p.tag == "a") for p in node.parts if isinstance(p, Node) and (p.named or not p.furniture))
        length[id(node)] = own + sum(below)
        return length[id(node)]

    whole = measure(root, False)
    most, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        if node.tag in ("article", "main") and not inside and length[id(node)]:
            return
        if node.named and 2 * length[id(node)] > whole:
            most.append(node)
        todo += [(p, inside or node.named) for p in node.parts if isinstance(p, Node) and id(p) in length]
    for node in most:
        node.furniture = False


def close(stack: list[Node], tag: str) -> None:
    """Ends elements that cannot contain a ``tag``: paragraphs, items, cells."""
    if tag in CLOSES_P:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag == "p":
                del stack[depth:]
                break
            if stack[depth].tag in SCOPES:
                break
    for depth in range(len(stack) - 1, 0, -1) if tag in SIBLINGS else ():
        if stack[depth].tag in SIBLINGS[tag]:
            del stack[depth:]
            break
        if stack[depth].tag in ("table", "ul", "ol", "dl"):
            break


def tidy(text: str) -> str:
    return SPACE.sub(" ", html.unescape(text)).strip()


def code(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=6).hexdigest()


def blocks(node: Node, path: str = "", everything: bool = False) -> Iterator[tuple[str, str]]:
    """(path, text) of the blocks below a node in page order; furniture is left out,
    unless ``everything`` with a text is asked for."""
    run: list[str] = []

    def walk(node: Node, path: str, article: bool) -> Iterator[tuple[str, str]]:
        for part in node.parts:
            if isinstance(part, str):
                run.append(part)
            elif part.tag in RAW or part.tag == "head" if everything else part.furniture or (part.tag == "header" and not article):
                continue
            elif part.tag in BLOCKS:
                if ready := tidy("".join(run)):
                    yield path, ready
                run.clear()
                below = f"{path}>{part.name}"
                yield from walk(part, below, article or part.tag in ("article", "main"))
                if ready := tidy("".join(run)):
                    yield below, ready
                run.clear()
            elif part.tag == "br":
                run.append(" ")
            else:
                yield from walk(part, path, article)

    yield from walk(node, path, node.tag in ("article", "main") or ">article" in path or ">main" in path)
    if ready := tidy("".join(run)):
        yield path, ready


def outline(node: Node, linked: bool = False) -> list:
    """[name, text hashes, slot length, children]: what wrappers are made from.

    Furniture has no length; runs of siblings that look alike are one node.
    """
    texts, length, children = [], 0, []
    for part in node.parts:
        if isinstance(part, str):
            if ready := tidy(part):
                texts.append(mark(node.name, ready))
                length += 0 if linked else len(ready)
        elif not part.furniture:
            child = outline(part, linked or part.tag == "a")
            if part.tag not in BLOCKS and not child[3]:
                texts += child[1]
                length += child[2]
            elif children and children[-1][0] == child[0] and part.tag not in CONTAINERS:
                merge(children[-1], child)
            else:
                children.append(child)
    return [node.name, sorted(set(texts)), length, children]


def merge(into: list, other: list) -> None:
    into[1] = sorted({*into[1], *other[1]})
    into[2] += other[2]
    for child in other[3]:
        for own in into[3]:
            if own[0] == child[0]:
                merge(own, child)
                break
        else:
            into[3].append(child)


def match(a: list, b: list) -> tuple[int, list]:
    """Simple tree matching: (nodes matched, pairs of matched nodes), the most
    that keeps the order of siblings; roots of different names match nothing."""
    if a[0] != b[0]:
        return 0, []
    rows, columns = len(a[3]), len(b[3])
    inner = [[match(x, y) for y in b[3]] for x in a[3]]
    best = [[0] * (columns + 1) for _ in range(rows + 1)]
    for i in range(rows):
        for j in range(columns):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + inner[i][j][0])
    pairs, i, j = [(a, b)], rows, columns
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs += inner[i][j][1]
    return best[rows][columns] + 1, pairs


def slots(page: list, others: list[list], template: set[str]) -> dict[int, int]:
    """By node of ``page``: length of its slot text. A node has none if its texts are
    constant in all others, or template."""
    constant: dict[int, set] = {}
    for number, other in enumerate(others):
        aligned = {id(x): set(y[1]) for x, y in match(page, other)[1]}
        walk = [page]
        while walk:
            node = walk.pop()
            walk += node[3]
            same = aligned.get(id(node), set()) & set(node[1])
            constant[id(node)] = same if not number else constant[id(node)] & same
    length: dict[int, int] = {}

    def measure(node: list) -> int:
        fixed = bool(node[1]) and set(node[1]) <= constant.get(id(node), set()) | template
        length[id(node)] = (0 if fixed else node[2]) + sum(map(measure, node[3]))
        return length[id(node)]

    measure(page)
    return length


def content_path(page: list, length: dict[int, int]) -> str:
    """The path of the <article> or <main> with nearly all slot text, if there is one,
    else of the smallest container with all of it."""
    whole = max(length[id(page)], 1)
    for least in (SHARE * whole, whole):
        node, path = page, page[0]
        while node[0].split(".")[0] not in ("article", "main"):
            down = [c for c in node[3] if c[0].split(".")[0] in CONTAINERS and length[id(c)] >= least]
            if not down:
                break
            node, path = down[0], f"{path}>{down[0][0]}"
        else:
            return path
    return path


def induce(outlines: list[list], template: Iterable[str] = ()) -> dict:
    """The wrapper of one host: paths by its references, best first, and template texts."""
    template = set(template)
    distinct = list({json.dumps(o): o for o in outlines}.values())
    votes: Counter[str] = Counter()
    for page in distinct:
        length = slots(page, [o for o in distinct if o is not page], template)
        if length[id(page)]:
            votes[content_path(page, length)] += 1
    paths = [p for p, _ in sorted(votes.items(), key=lambda v: (-v[1], v[0]))]
    return {"paths": paths, "constant": sorted(template)}


def mark(name: str, text: str) -> str:
    """What a text is counted by: its own hash and the name of its element."""
    return code(f"{name} {text}")


def marks(root: Node) -> tuple[list[str], str]:
    """The marks of all blocks of a page, and the hash of its ``LONGEST`` longest texts."""
    found = [mark(path.rpartition(">")[2], text) for path, text in blocks(root, root.name, everything=True)]
    texts = sorted({text for _, text in blocks(root, root.name)}, key=lambda t: (-len(t), t))
    return list(dict.fromkeys(found)), code("\n".join(texts[:LONGEST]))


def find(node: Node, names: list[str]) -> list[Node]:
    """Nodes at a path, outside of furniture."""
    if node.name != names[0] or node.furniture:
        return []
    if len(names) == 1:
        return [node]
    return [hit for part in node.parts if isinstance(part, Node) for hit in find(part, names[1:])]


def extract(text: str | None, wrapper: dict | None) -> str:
    """The blocks of a page that its wrapper leaves, two line ends between them."""
    if not text:
        return ""
    page = parse(text)
    found: list[Node] = []
    for path in (wrapper or {}).get("paths", ()):
        if found := find(page, path.split(">")):
            break
    else:
        path = induce([outline(page)], (wrapper or {}).get("constant", ()))["paths"]
        path = path[0] if path else page.name
        found = find(page, path.split(">"))
    template = set((wrapper or {}).get("constant", ()))
    out = [b for node in found for b in blocks(node, path.rpartition(">")[0] + ">" + node.name)]
    kept = [t for p, t in out if mark(p.rpartition(">")[2], t) not in template]
    return "\n\n".join(kept)


def host(url: str) -> F.Column:
    return F.regexp_extract(F.lower(F.coalesce(F.col(url).cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)


def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Outline, marks and longest text of every page."""
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            roots = [parse(h.as_py() or "") for h in part.column("html")]
            found = [marks(root) for root in roots]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("host"),
                    part.column("page_id"),
                    pa.array([json.dumps(outline(root), separators=(",", ":")) for root in roots]),
                    pa.array([m for m, _ in found], pa.list_(pa.string())),
                    pa.array([longest for _, longest in found]),
                ],
                names=["host", "page_id", "outline", "marks", "article"],
            )


def induced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        given = zip(batch.column("references").to_pylist(), batch.column("template").to_pylist(), strict=True)
        made = [json.dumps(induce([json.loads(o) for o in own if o], template or ())) for own, template in given]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(made)], names=["host", "wrapper"])


def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, dict] = {}
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            texts = []
            for page, wrapper in zip(part.column("html"), part.column("wrapper").to_pylist(), strict=True):
                if wrapper is not None and wrapper not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[wrapper] = json.loads(wrapper)
                texts.append(extract(page.as_py(), known.get(wrapper)))
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def templates(drawn: DataFrame) -> DataFrame:
    """(host, template: marks of the texts that recur on the host's different pages).

    Marks are counted by host, mark and article, then by host and mark, so no task has all
    texts of a host. A host has at most 1 / ``RECURS`` times the texts of a page.
    """
    articles = drawn.groupBy("host").agg(F.countDistinct("article").alias("articles"))
    seen = drawn.select("host", "article", F.explode("marks").alias("mark")).distinct()
    counted = seen.groupBy("host", "mark").agg(F.count("*").alias("n")).where(F.col("n") >= RECURS_ON)
    often = counted.join(articles, "host").where(F.col("n") >= RECURS * F.col("articles"))
    return often.groupBy("host").agg(F.sort_array(F.collect_list("mark")).alias("template"))


def wrappers(pages: DataFrame, references: int = REFERENCES) -> DataFrame:
    """(host, wrapper as JSON: paths and template texts)."""
    own = pages.select(host("url").alias("host"), F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    drawn = own.mapInArrow(outlines, "host string, page_id long, outline string, marks array<string>, article string")
    drawn = materialize(drawn)
    picked = drawn.groupBy("host").agg(
        F.array(
            *[F.min_by("outline", F.struct(F.xxhash64("page_id", F.lit(r)), "outline")) for r in range(references)]
        ).alias("references")
    )
    picked = picked.join(templates(drawn), "host", "left")
    return picked.mapInArrow(induced, "host string, wrapper string")


def main_text(pages: DataFrame, references: int = REFERENCES) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    found = materialize(wrappers(pages, references))
    size = found.agg(F.sum(F.length("host") + F.length("wrapper") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        found = F.broadcast(found)
    own = pages.select(
        host("url").alias("host"),
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    return own.join(found, "host", "left").mapInArrow(extracted, "page_id long, url string, text string, n_chars long")

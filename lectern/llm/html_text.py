"""Main text of web pages by tree scoring.

A page becomes a tree. Parts that never are main text (scripts, styles, navigation, headers and footers of the page,
side bars, forms, and whatever a class, id or role names as advert, notice, menu, comment list and the like) are
taken out. Every paragraph gets points for its length and its commas; its parent gets all of them, the ancestors
above shares that shrink with distance. A container's points are discounted by the share of its text inside links.
The container with the most points is kept, and with it those siblings whose own points or plain text are good enough.
Its text blocks are joined in page order.

Defined results: null or empty html gives the empty string; a page without any scored paragraph gives the text of its
body without the parts above; a page that has no text beside parts named as advert and the like gives those; broken,
unclosed or cut mark-up is read as far as it goes; repeated rows give repeated results; equal points go to the earlier
container. Empty tables give no rows. Whole pages are read, whatever their size; tags nested deeper than `DEEPEST` add
to the container at that depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import slices, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(("script style noscript template iframe object embed svg math canvas nav header footer aside form "
                     "button select option textarea input label fieldset dialog menu head title").split())
BLOCKS = frozenset(("address article blockquote body br caption center dd details div dl dt fieldset figcaption figure "
                    "h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul "
                    "header footer nav aside form").split())
#: Blocks whose own text earns points.
PARAGRAPHS = frozenset("p pre td li blockquote h1 h2 h3 h4 h5 h6 div section article main dd".split())
#: A new one of these ends an open paragraph.
ENDS_PARAGRAPH = BLOCKS - {"br"}
#: What an open element's implied end depends on: the new tag, and what stops the search for it.
CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}),
          "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}),
          "option": ("option", {"select"})}
#: Names of parts that are no article wherever they stand.
UNLIKELY = re.compile(
    r"(?:^|(?<!has)(?<!with)(?<!no)[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notices?|gdpr|popup|modal|menu|nav\w*|"
    r"breadcrumbs?|sidebar|side-bar|footer|header|masthead|comments?|disqus|replies|"
    r"newsletter|subscribe|signup|login|pagination|pager|hidden)(?:$|[\s_-])", re.I)
#: Names that also occur in names of content: they count alone or before a word for a part of a page.
PARTS = "posts?|links?|articles?|items?|list|box|block|section|buttons?|bar|icons?|media|stories|topics?|tools?|nav|area|footer"
UNLIKELY_ALONE = re.compile(
    rf"(?:^|\s)(?:widget|share|sharing|social|related|recommend\w*|toolbar|skip|legal|copyright)(?:[_-](?:{PARTS}))*(?:$|\s)", re.I)
#: Names that count where nothing else is found, too.
NEVER = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|cookies?|consent|notices?|gdpr|comments?|disqus|replies)(?:$|[\s_-])", re.I)
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")  # between the words of a camel-case name
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())
KEPT = frozenset(("html", "body", "article", "main"))
DEEPEST = 400
OPENS_TAG = re.compile(r"<[A-Za-z/!?]")
SPACE = re.compile(r"\s+")


class Node:
    """An element: children are nodes and strings, in page order."""

    __slots__ = ("tag", "parent", "children", "points", "depth")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.children = tag, parent, []
        self.points = 0.0
        self.depth = parent.depth + 1 if parent else 0


def _unlikely(tag: str, attributes: list[tuple[str, str | None]], named: bool) -> bool:
    if tag in DROPPED:
        return True
    if tag in KEPT:
        return False
    for name, value in attributes:
        if name in ("class", "id") and value:
            spaced = HUMP.sub("-", value)
            if NEVER.search(spaced) if not named else UNLIKELY.search(spaced) or UNLIKELY_ALONE.search(spaced):
                return True
        if not named:
            continue
        if name == "role" and value and value.lower() in ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class Tree(HTMLParser):
    """Builds the tree of what may be main text; keeps count of what is taken out."""

    def __init__(self, named: bool = True) -> None:
        """named: take out what class, id, role or style name as no main text; else only what `NEVER` names, and tags."""
        super().__init__(convert_charrefs=True)
        self.named = named
        self.root = self.at = Node("html", None)
        self.out: list[str] = []  # open elements inside a part that is taken out, that part first

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if self.out and (tag in ENDS_PARAGRAPH and self.out[0] == "p" and not BLOCKS.intersection(self.out[1:])
                         or tag in CLOSES and tag == self.out[0] and not BLOCKS.intersection(self.out[1:])):
            self.out.clear()  # the new tag ends the part
        if self.out:
            if tag not in VOID:
                self.out.append(tag)
            return
        if tag in ("html", "body"):
            return
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, BLOCKS - {"p"})
        if tag in CLOSES:
            self._close(set(CLOSES[tag][0].split()), CLOSES[tag][1])
        if _unlikely(tag, attributes, self.named):
            if tag not in VOID:
                self.out.append(tag)
            elif tag in BLOCKS:
                self.at.children.append(Node(tag, self.at))
            return
        node = Node(tag, self.at)
        self.at.children.append(node)
        if tag not in VOID and node.depth < DEEPEST:
            self.at = node

    def handle_startendtag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attributes)
        if tag not in VOID and tag in ("svg", "path", "iframe", "script"):
            self.handle_endtag(tag)

    def _close(self, tags: set[str], stop: frozenset[str] | set[str]) -> None:
        node = self.at
        while node is not None and node.tag not in stop:
            if node.tag in tags and node.parent is not None:
                self.at = node.parent
                return
            node = node.parent

    def handle_endtag(self, tag: str) -> None:
        if self.out:
            if tag in self.out:
                while self.out.pop() != tag:
                    pass
            elif tag in ("body", "article", "main") or tag in BLOCKS and self._open(tag) and tag not in ("p", "li"):
                self.out.clear()  # the part was never closed
                self.handle_endtag(tag)
            return
        if self._open(tag):
            while self.at.tag != tag:
                self.at = self.at.parent
            if self.at.parent is not None:
                self.at = self.at.parent

    def _open(self, tag: str) -> bool:
        node = self.at
        while node is not None:
            if node.tag == tag:
                return True
            node = node.parent
        return False

    def handle_data(self, data: str) -> None:
        if not self.out:
            self.at.children.append(data)

    def unknown_decl(self, data: str) -> None:
        """CDATA sections and the like are no text."""


def nodes_of(root: Node) -> Iterator[Node]:
    """All elements, parents before children, in page order."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))


def measures(root: Node) -> dict[int, tuple[int, int]]:
    """By id(node): characters of text below it, and those inside links."""
    order = list(nodes_of(root))
    found: dict[int, tuple[int, int]] = {}
    for node in reversed(order):
        size = linked = 0
        for child in node.children:
            if isinstance(child, str):
                size += len(SPACE.sub(" ", child).strip())
            else:
                a, b = found[id(child)]
                size, linked = size + a, linked + b
        found[id(node)] = size, size if node.tag == "a" else linked
    return found


def blocks_of(node: Node) -> list[str]:
    """Text blocks below a node in page order."""
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = SPACE.sub(" ", "".join(run)).strip()
        if text:
            blocks.append(text)
        run.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            run.append(item)
        else:
            if item.tag in BLOCKS:
                end()
                stack.append(None)
            stack.extend(reversed(item.children))
    end()
    return blocks


def own_text(node: Node) -> str:
    """A block's text outside the blocks within it."""
    parts: list[str] = []
    stack: list[Node | str] = list(reversed(node.children))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            parts.append(item)
        elif item.tag not in BLOCKS:
            stack.extend(reversed(item.children))
    return SPACE.sub(" ", "".join(parts)).strip()


def best_nodes(root: Node) -> list[Node]:
    """The best container with the siblings that belong to it."""
    sizes = measures(root)
    scored: list[Node] = []
    for node in nodes_of(root):
        if node.tag not in PARAGRAPHS or node.parent is None:
            continue
        text = own_text(node)
        if len(text) < 2:
            continue
        points = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)
        size, linked = sizes[id(node)]
        points *= 1 - linked / size if size else 1
        holder, share = (node, 1.0) if node.tag in ("article", "main") else (node.parent, 1.0)
        for level in range(5):
            if holder is None:
                break
            if holder.points == 0:
                scored.append(holder)
            holder.points += points * share
            holder, share = holder.parent, 1 / 2 if level == 0 else 1 / (3 * (level + 1))
    if not scored:
        return [root]

    def worth(node: Node) -> float:
        size, linked = sizes[id(node)]
        bonus = 25 if node.tag in ("article", "main") else 0
        return (node.points + bonus) * (1 - linked / size if size else 0)

    best = max(scored, key=worth)
    top = worth(best)
    whole: Node | None = best
    while whole is not None and whole.tag not in ("article", "main"):
        whole = whole.parent
    if whole is not None:
        size, linked = sizes[id(whole)]
        if size and linked / size < 0.25:
            return [whole]
    if best.parent is None:
        return [best]
    kept = []
    for child in best.parent.children:
        if isinstance(child, str):
            continue
        size, linked = sizes[id(child)]
        density = linked / size if size else 1
        if child is best or child.points and worth(child) >= max(10, 0.2 * top):
            kept.append(child)
        elif best.tag not in ("article", "main") and child.tag in ("p", "h1", "h2", "h3", "blockquote", "pre") and (
                size > 80 and density < 0.25 or 0 < size and density == 0):
            kept.append(child)
    return kept


def main_text(html: str | None) -> str:
    if not html:
        return ""
    cut = OPENS_TAG.search(html, html.rfind(">") + 1)  # a page that ends inside a tag
    if cut:
        html = html[:cut.start()]
    for named in (True, False):
        tree = Tree(named)
        tree.feed(html)
        tree.close()
        text = "\n".join(block for node in best_nodes(tree.root) for block in blocks_of(node))
        if text:
            break
    return text


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `text`, the main text of `html`, in place of `html`."""
    columns = [c for c in pages.columns if c not in (html, "text")]
    rows = pages.select(*columns, html)
    place = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, place)):
            texts = [main_text(h) for h in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays(batch.columns[:place] + [pa.array(texts, pa.string())],
                                             columns + ["text"])

    schema = rows.select(*columns).schema.add("text", "string")
    return rows.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

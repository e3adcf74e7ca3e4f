"""Main text of web pages by composite text density.

A page becomes a tree. Parts that name themselves as furniture (menus, footers, forms, adverts, comments and so on)
are cut off. Every node then has a density: characters per tag, lowered as more of them belong to links. Names that
ordinary sections of an article have too (``WEAK``) cut a part off only if its density is below the body's or much of
it is links. The block whose children's densities have the largest sum is the core of the article. It is widened to
the article element around it, or else to the highest block below the body whose density is not below the body's own.

Headings are never cut off for their names, and inside an article or main element an id says nothing unless it names
reader comments, since ids there are often made from headings. Lists that are nearly all links are left out only
where no article or main element says what belongs to the article.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterloom.llm.arrow import aside, ddl, extended, slices, without

# fixed values: element names by their part in HTML, and words by which furniture names itself
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr main menu nav ol p pre section table ul".split()
)
# an opening tag that ends open ones of these names, up to the container named after them
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
FURNITURE = frozenset(
    "head script style noscript template nav footer aside form button input select textarea iframe object embed applet svg canvas"
    " dialog menu title audio video map xmp noembed noframes datalist fieldset".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar alert".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsored sponsors promo promos"
    " promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe"
    " subscription signup login paywall sidebar sidebars rail widget widgets menu menus nav navbar navigation navi breadcrumb"
    " breadcrumbs pagination pager toolbar topbar header masthead footer copyright social share sharing sharebar related recommended"
    " recommendations trending comment comments commentlist reply replies respond responses feedback disqus discussion outbrain"
    " taboola skip aside promoted advertorial disclaimer announcement topnav subnav mainnav sidenav sitenav crumbs siteheader"
    " pageheader sitefooter pagefooter".split()
)
WEAK = frozenset(
    "discussion feedback related recommended recommendations navigation social share sharing responses subscription subscribe"
    " promotion consent trending alert overlay widget widgets rail skip promoted disclaimer login cookies"
    .split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
COMMENT_NAMES = frozenset("comment comments commentlist respond disqus replies".split())
ARTICLE_NAMES = frozenset("article entry post content title story".split())

_NEXT = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>")
_ATTRIBUTE = re.compile(r"([^\s/=][^\s/=]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'][^\s]*+)?+)?+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Tree:
    """Nodes in page order: name, parent, attributes, and the texts directly in each; node 0 is the page."""

    def __init__(self) -> None:
        self.name, self.parent, self.attributes = ["#page"], [-1], [""]
        self.items: list[tuple[int, str | None]] = []  # (node, text), or (node, None) where a node begins or ends

    def add(self, name: str, parent: int, attributes: str) -> int:
        self.name.append(name)
        self.parent.append(parent)
        self.attributes.append(attributes)
        return len(self.name) - 1


def parse(page: str) -> Tree:
    """A tree from any text; unclosed and stray tags are taken as browsers take the common cases."""
    tree, open_, at = Tree(), [0], 0
    held: dict[str, int] = {}  # how many open nodes have a name

    def close(depth: int) -> None:
        while len(open_) > depth:
            node = open_.pop()
            held[tree.name[node]] -= 1
            tree.items.append((node, None))

    def find(names: set[str], stop: set[str]) -> int:
        """Depth of the outermost open node of these names inside the innermost container."""
        found = len(open_)
        if not any(held.get(x) for x in names):
            return found
        for depth in range(len(open_) - 1, 0, -1):
            name = tree.name[open_[depth]]
            if name in stop:
                break
            if name in names:
                found = depth
        return found

    while at < len(page):
        hit = _NEXT.search(page, at)
        if not hit:
            tree.items.append((open_[-1], page[at:]))
            break
        if hit.start() > at:
            tree.items.append((open_[-1], page[at : hit.start()]))
        at = hit.start()
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page[at + 1] in "!?":
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
            continue
        tag = _TAG.match(page, at)
        if not tag:  # a tag that never ends
            break
        at = tag.end()
        name = tag[2].lower()
        if tag[1]:
            if held.get(name):
                depth = max(d for d in range(len(open_)) if tree.name[open_[d]] == name)
                if not (name in INLINE and any(tree.name[n] not in INLINE for n in open_[depth + 1 :])):
                    close(depth)
            continue
        if name in CLOSES_P and held.get("p"):
            close(find({"p"}, {"button", "td", "th", "table", "object"}))
        if name in ENDS:
            close(find(*ENDS[name]))
        node = tree.add(name, open_[-1], tag[3])
        tree.items.append((node, None))
        if name in RAW and not tag[3].endswith("/"):
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else len(page)
            tree.items.append((node, page[at:stop]))
            tree.items.append((node, None))
            close_at = page.find(">", stop)
            at = len(page) if close_at < 0 else close_at + 1
        elif name not in VOID and not (tag[3].endswith("/") and name in ("svg", "path")):
            open_.append(node)
            held[name] = held.get(name, 0) + 1
    return tree


def _kept(tree: Tree) -> tuple[list[bool], list[int]]:
    """Which nodes are not furniture and not inside any, and which of them have a weak name."""
    n = len(tree.name)
    article = [False] * n  # holds, or is, an article or main element
    for i in range(n - 1, 0, -1):
        article[i] = article[i] or tree.name[i] in ("article", "main")
        if article[i]:
            article[tree.parent[i]] = True
    inside = [False] * n  # is inside an article or main element
    kept = [True] * n
    weak: list[int] = []
    for i in range(1, n):
        up = tree.parent[i]
        name = tree.name[i]
        inside[i] = inside[up] or tree.name[up] in ("article", "main")
        kept[i] = kept[up] and not (name in FURNITURE or name == "header" and not inside[i])
        if not kept[i] or not tree.attributes[i] or name in ("html", "body"):
            continue
        words: set[str] = set()
        for key, value in _ATTRIBUTE.findall(tree.attributes[i]):
            key, value = key.lower(), html.unescape(value.strip("\"'"))
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" and name not in INLINE:
                kept[i] = False
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                kept[i] = False
            elif key == "role":
                kept[i] = kept[i] and (value.lower() not in ROLES or article[i])
            elif key in ("class", "id") and name not in HEADINGS:
                found = {x.lower() for x in _NAME.findall(value)}
                words |= found & (COMMENT_NAMES | ARTICLE_NAMES) if key == "id" and inside[i] else found
        named = words & NAMES
        if named == {"header"} and (inside[i] or words & ARTICLE_NAMES):
            named = set()
        # an element around the article is not cut off for its name, but comments may be articles themselves
        if named and (not article[i] or inside[i] or named & COMMENT_NAMES and not words & ARTICLE_NAMES):
            if named <= WEAK:
                weak.append(i)
            else:
                kept[i] = False
    return kept, [i for i in weak if kept[i]]


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_links: float) -> float:
    """Composite text density; ``body_links`` is the share of link characters in the body."""
    if not chars:
        return 0.0
    base = math.log(chars / max(1, chars - link_chars) * link_chars + body_links * chars + math.e)
    ratio = chars / max(1, link_chars) * max(1, tags) / max(1, link_tags)
    return chars / max(1, tags) * max(0.0, math.log(ratio) / base if ratio > 1 else 0.0)


def _densities(
    tree: Tree, kept: list[bool], link: list[bool], sizes: list[int]
) -> tuple[list[int], list[int], list[int], list[float], int]:
    """Characters, link characters, link tags and density below every kept node, and the body."""
    n = len(tree.name)
    chars, link_chars, tags, link_tags = ([0] * n for _ in range(4))
    for (node, _), size in zip(tree.items, sizes):
        if size and kept[node]:
            chars[node] += size
            if link[node]:
                link_chars[node] += size
    for i in range(n - 1, 0, -1):
        if kept[i]:
            up = tree.parent[i]
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (tree.name[i] == "a")
    body = next((i for i in range(n) if tree.name[i] == "body" and kept[i]), 0)
    if not chars[body]:
        body = 0
    share = link_chars[body] / max(1, chars[body])
    dense = [density(chars[i], tags[i], link_chars[i], link_tags[i], share) if kept[i] else 0.0 for i in range(n)]
    return chars, link_chars, link_tags, dense, body


def main_text(page: str | None) -> str:
    """The main text: blocks joined by a blank line, white space inside a block as one space."""
    if not page:
        return ""
    tree = parse(page)
    n = len(tree.name)
    kept, weak = _kept(tree)
    link = [False] * n
    for i in range(1, n):
        link[i] = link[tree.parent[i]] or tree.name[i] == "a"
    texts: list[str | None] = []
    sizes: list[int] = []
    for node, text in tree.items:
        decoded = None
        if text is not None and kept[node]:
            decoded = html.unescape(text) if "&" in text else text
        texts.append(decoded)
        sizes.append(sum(map(len, decoded.split())) if decoded else 0)
    chars, link_chars, link_tags, dense, body = _densities(tree, kept, link, sizes)
    cut = [i for i in weak if dense[i] < dense[body] or 4 * link_chars[i] > chars[i]]
    if cut:
        for i in cut:
            kept[i] = False
        for i in range(1, n):
            kept[i] = kept[i] and kept[tree.parent[i]]
        chars, link_chars, link_tags, dense, body = _densities(tree, kept, link, sizes)

    sums = [0.0] * n
    for i in range(1, n):
        if kept[i] and tree.name[i] not in INLINE:
            sums[tree.parent[i]] += dense[i]
    under = [False] * n
    under[body] = True
    for i in range(body + 1, n):
        under[i] = under[tree.parent[i]]
    best = max((i for i in range(n) if under[i] and kept[i] and tree.name[i] not in INLINE), key=lambda i: (sums[i], -i), default=body)

    path = [best]
    while path[-1] != body:
        path.append(tree.parent[path[-1]])
    named = [i for i in path if tree.name[i] in ("article", "main")]
    articles = [i for i in named if tree.name[i] == "article"]
    if articles or named:
        core = (articles or named)[-1]
    else:
        core = best
        for i in path[:-1]:
            if dense[i] >= dense[body]:
                core = i
    menu = [False] * n  # lists of links inside a core that no article element bounds
    for i in range(core + 1, n):
        up = tree.parent[i]
        menu[i] = menu[up] or (not named and tree.name[i] in ("ul", "ol", "dl", "table") and link_tags[i] >= 3 and link_chars[i] > 0.8 * chars[i])

    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        block = " ".join("".join(line).split())
        if block:
            blocks.append(block)
        line.clear()

    within = [False] * n
    within[core] = True
    for i in range(core + 1, n):
        within[i] = within[tree.parent[i]]
    for (node, raw), text in zip(tree.items, texts):
        if not within[node] or not kept[node] or menu[node]:
            if raw is None and within[node] and tree.name[node] not in INLINE:
                end()
            continue
        if raw is not None:
            line.append(text or "")
        elif tree.name[node] in ("br", "wbr", "img"):
            line.append(" " if tree.name[node] == "br" else "")
        elif tree.name[node] not in INLINE:
            end()
    end()
    return "\n\n".join(blocks)


def extract(pages: DataFrame, markup: str = "html", name: str = "text") -> DataFrame:
    """Add the main text (empty if none) and ``n_chars``, its code points; columns of these names are replaced.

    A null page is empty. Each page is a row of its own, of any length; repeated rows give equal texts.
    """
    kept = without(pages, [c for c in (name, "n_chars") if c != markup])
    moved, own = aside(kept)
    given = moved.withColumn("_llm_html", F.col(own[markup]).cast("string"))
    shown = {c: own[c] for c in kept.columns if c not in (name, "n_chars")}
    added = {"_llm_main": name, "_llm_size": "n_chars"}
    schema = pa.schema([("_llm_main", pa.string()), ("_llm_size", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_llm_html"):
                texts = [main_text(page) for page in part.column("_llm_html").to_pylist()]
                columns = {"_llm_main": pa.array(texts, pa.string()), "_llm_size": pa.array(map(len, texts), pa.int64())}
                yield extended(part.select(list(shown.values())), schema, columns)

    out = given.mapInArrow(read, ddl(moved.select(*shown.values()), "_llm_main string, _llm_size long"))
    return out.select(*(F.col(c).alias(old) for old, c in shown.items()), *(F.col(c).alias(new) for c, new in added.items()))

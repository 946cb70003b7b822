"""Main text of pages by site style trees.

The pages of a host are merged into one tree: an element is known by its path of block tags with
their classes and ids. For every element the tree counts

* its presentations, the sequences of child elements that it shows on different pages,
* its contents, the texts that it holds itself.

On ``m`` pages the entropy (base m) of the presentations says how much its look is made for
the page, and the entropy of the pages that share a content how much a text is repeated over
the site. An element's importance weighs both; a branch goes if all elements in it
that hold text have low importance, which is to cut those elements' texts.

The pieces of text of an element are its leaves: one that ``n`` of the element's ``m`` pages show has importance
``-log_m(n / m)``, so a paragraph repeated over the site goes though its neighbours of the same path stay.

The page's own markup is a weight of the importance: 0 for elements that by their tag, role or
class are never part of the text (menus, forms, adverts, comments and so on), ``HALF`` for those of which only one part
of a class or id says so (``left-sidebar``) and for what lies outside the main elements (``article``, ``main``) of a
page that has some, 0 for both at once, 1 for all else, inside main elements too. A wrapper is no junk: nothing is that holds
all main elements of the page, nor a form, a hidden element or one known by a part of a name that holds any of
them or more than half of the page's text.
Elements that the host shows on fewer than ``MIN_PAGES`` pages have no importance; there the markup decides alone,
and what has a weight below 1 goes. A page of which nothing would be left shows the text of other pages in its
main elements, which is no frame: that text stays.

Counts are grouped sums with partial aggregation over (host, element, value), so a
host with very many pages is no single group.
"""

import hashlib
import html
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barfold.llm.common import map_rows, stored

#: Least importance of an element that stays, and the weight of contents in it.
MIN_IMPORTANCE, CONTENT_WEIGHT = 0.3, 0.9
#: Weight of elements outside the main elements of their page, and of those that one part of a name calls junk.
HALF = 0.5
#: Pages of a host from which on repetition says something.
MIN_PAGES = 5
#: Elements that the tree decides on (24 bytes each) up to which their table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ELEMENTS = 500_000

# Names of HTML, and of usual classes.
HIDDEN = frozenset("script style noscript template head title iframe object svg canvas select button textarea datalist".split())
NEVER = frozenset("nav header footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta source track".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
JUNK = re.compile(
    r"^(ads?|advert\w*|banner|sponsor\w*|promo\w*|side-?bar|nav\w*|menu\w*|breadcrumbs?|header|footer|cookies?|consent|"
    r"notices?|alert|popup|modal|newsletter|subscribe|share|sharing|social|related|recommend\w*|comments?|respond|replies|"
    r"discuss\w*|widget|toolbar|login|signup|pager|pagination)$"
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDING = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
#: An open element that ends where one of these starts.
ENDS = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
        "th": {"td", "th", "tr"}, "option": {"option"}}


class Element:
    __slots__ = ("children", "doubt", "junk", "key", "main", "name", "parent", "says", "tag")

    def __init__(self, tag: str, name: str, parent: "Element | None", says: str, main: bool):
        self.tag, self.name, self.parent = tag, name, parent
        #: What its own markup says: "" text, "part" or "form" junk unless it is a wrapper, "junk".
        self.says = says
        self.junk = self.doubt = False
        self.main = main or (parent is not None and parent.main)
        self.key = _key(f"{parent.key if parent else 0}/{name}")
        self.children: list[Element] = []


def _judge(elements: list[Element], texts: list[tuple[Element, str]]) -> None:
    """Set ``junk`` and ``doubt`` of all elements; parents come before their children."""
    size = dict.fromkeys(map(id, elements), 0)
    for element, text in texts:
        size[id(element)] += len(text)
    mains = [e for e in elements if e.tag in MAIN]
    mains = [e for e in mains if not e.says] or [e for e in mains if e.says != "junk"]
    holds = dict.fromkeys(map(id, elements), 0)
    for element in mains:
        holds[id(element)] = 1
    for element in reversed(elements):
        if element.parent:
            size[id(element.parent)] += size[id(element)]
            holds[id(element.parent)] += holds[id(element)]
    for element in elements:
        says, held = element.says, holds[id(element)]
        wraps = bool(mains) and held == len(mains)
        if says in ("part", "form"):
            wraps = wraps or held > 0 or 2 * size[id(element)] > size[id(elements[0])]
        up = element.parent
        element.junk = (up is not None and up.junk) or (says in ("junk", "form") and not wraps)
        element.doubt = (up is not None and up.doubt) or (says == "part" and not wraps)


def blocks(source: str | None) -> tuple[list[Element], list[tuple[Element, str]]]:
    """Block elements in page order, and (element, text) of every piece of text between block tags.

    Tags may be left open, closed twice or cut off. White space runs are one blank.
    """
    source = source or ""
    root = Element("", "", None, "", False)
    elements, texts, buffer = [root], [], []
    here, at = root, 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            texts.append((here, text))

    while match := _TOKEN.search(source, at):
        buffer.append(source[at : match.start()])
        at = match.end()
        tag = (match[2] or "").lower()
        if not tag or tag in INLINE:
            continue
        if tag in VOID:
            buffer.append(" ")
            continue
        flush()
        if match[1]:
            node = here
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                here = node.parent
            continue
        if tag in HIDDEN:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|$)", re.IGNORECASE).search(source, at)
            if end or tag in ("script", "style", "title", "textarea"):
                at = end.end() if end else len(source)
            continue
        while here.tag in ENDS and (ENDS[here.tag] is None or tag in ENDS[here.tag]):
            here = here.parent
        here = _open(tag, match[3], here)
        here.parent.children.append(here)
        elements.append(here)
        if match[3].endswith("/") and tag not in ("p", "div"):
            here = here.parent
    buffer.append(source[at:])
    flush()
    _judge(elements, texts)
    return elements, texts


def _open(tag: str, attributes: str, parent: Element) -> Element:
    names: list[str] = []
    says = {"junk"} if tag in NEVER - {"form"} and not (tag == "header" and parent.main) else set()
    if tag == "form" or _HIDING.search(attributes):
        says.add("form")
    for key, *values in _ATTRIBUTE.findall(attributes):
        words = "".join(values).lower().split()
        if key.lower() == "role":
            if ROLES.intersection(words):
                says.add("form" if "form" in words else "junk")
        else:
            names += words
            says.update(map(_says, words))
    name = ".".join([tag, *(re.sub(r"\d+", "0", n) for n in names)])
    most = "" if tag in ("html", "body") else next((x for x in ("junk", "form", "part") if x in says), "")
    return Element(tag, name, parent, most, tag in MAIN)


def _says(name: str) -> str:
    """Whether a class or id names a part that is no text, or only has a part that does; ``has-sidebar`` or ``post-header`` do not."""
    if JUNK.match(name):
        return "junk"
    parts = re.split(r"[-_]+", name)
    if parts[0] in ("no", "has", "with") or ("header" in parts and len(parts) > 1 and parts[0] not in ("site", "page", "main")):
        return ""
    return "part" if any(JUNK.match(p) for p in parts) else ""


def host_of(url: Column) -> Column:
    """Host of an address, without user, port and case; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)
    return F.when(host != "", host)


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def style_tree(pages: DataFrame) -> DataFrame:
    """``host, element, pages, importance, weak`` of ``pages(host, html)``: the elements that hold text.

    ``weak`` is whether the markup gives the element a weight below 1 on some page. A piece of text that
    ``MIN_PAGES`` pages or more show in one element is a row of its own, with the element's ``pages``. Pages of a
    host with equal html count once.
    """
    def observe(host: str, source: str) -> Iterator[tuple]:
        elements, texts = blocks(source)
        held: dict[int, list[str]] = {}
        pieces: dict[int, set[int]] = {}
        weak: set[int] = set()
        main = _has_main(elements)
        for element, text in texts:
            held.setdefault(element.key, []).append(text)
            if weight := _weight(element, main):
                pieces.setdefault(element.key, set()).add(_piece(element, text))
                if weight < 1:
                    weak.add(element.key)
        shown: dict[int, list[str]] = {}
        for element in elements:
            if element.key in held:
                shown.setdefault(element.key, []).append(",".join(c.name for c in element.children))
        page = _key(source)
        for key, content in held.items():
            own = sorted(pieces.get(key, ()))
            yield host, page, key, _key("|".join(shown[key])), _key("\n".join(content)), own, key in weak

    seen = pages.where(F.col("host").isNotNull() & F.col("html").isNotNull()).select("host", "html")
    observed = stored(map_rows(
        seen, observe,
        "host string, page bigint, element bigint, look bigint, content bigint, pieces array<bigint>, weak boolean"
    ).distinct(), "observed")
    every = observed.groupBy("host", "element").agg(
        F.count("*").cast("double").alias("pages"), F.max("weak").alias("weak")
    )

    def repeated(value: str) -> DataFrame:
        """Sum of n log n over the values, n being the pages that show one."""
        counts = observed.groupBy("host", "element", value).agg(F.count("*").alias("n"))
        return counts.groupBy("host", "element").agg(F.sum(F.col("n") * F.log("n")).alias(value))

    tree = every.join(repeated("look"), ["host", "element"]).join(repeated("content"), ["host", "element"])
    m = F.col("pages")
    # -sum(n/m log_m(n/m)) = 1 - sum(n log n) / (m log m), for presentations and for contents alike.
    entropy = lambda value: F.when(m > 1, 1 - F.col(value) / (m * F.log(m))).otherwise(1.0)
    importance = CONTENT_WEIGHT * entropy("content") + (1 - CONTENT_WEIGHT) * entropy("look")
    tree = tree.select("host", "element", "pages", importance.alias("importance"), "weak")
    pieces = observed.select("host", "element", F.explode("pieces").alias("piece")).groupBy("host", "element", "piece").agg(
        F.count("*").alias("n")
    ).where(F.col("n") >= MIN_PAGES)
    leaves = pieces.join(every, ["host", "element"]).select(
        "host", F.col("piece").alias("element"), "pages", (1 - F.log("n") / F.log(m)).alias("importance"),
        F.lit(False).alias("weak"),
    )
    return tree.unionByName(leaves)


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_importance: float = MIN_IMPORTANCE,
) -> DataFrame:
    """``page_id, url, text`` per row: the page's text without its site's repeated parts.

    Blocks follow each other in page order, separated by a line feed; white space
    runs inside a block are one blank. A null html gives an empty text; pages without
    a host in their address are judged by their own markup only. Repeated rows stay, an
    empty table gives no rows.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    own = own.withColumn("host", host_of(F.col("url")))
    known = style_tree(own).where(F.col("pages") >= MIN_PAGES)
    low = F.col("importance") < min_importance
    high = F.col("weak") & (F.col("importance") * HALF >= min_importance)
    told = stored(known.where(low | high).select("host", "element", low.alias("low")), "told")
    tree = told.groupBy("host").agg(
        F.sort_array(F.collect_set(F.when(F.col("low"), F.col("element")))).alias("cut"),
        F.sort_array(F.collect_set(F.when(~F.col("low"), F.col("element")))).alias("kept"),
    )
    if told.count() <= BROADCAST_ELEMENTS:
        tree = F.broadcast(tree)

    def extract(page, url, source, cut, kept):
        return [(page, url, text_of(source, frozenset(cut or ()), frozenset(kept or ())))]

    joined = own.join(tree, "host", "left").select("page_id", "url", "html", "cut", "kept")
    kind = pages.schema[id_col].dataType.simpleString()
    return map_rows(joined, extract, f"page_id {kind}, url string, text string")


def _has_main(elements: list[Element]) -> bool:
    return any(e.main and not e.junk and not e.doubt for e in elements)


def _weight(element: Element, has_main: bool) -> float:
    """What the markup says about the element, in a page with or without main elements."""
    outside = has_main and not element.main
    if element.junk or (outside and element.doubt):
        return 0.0
    return HALF if outside or element.doubt else 1.0


def _piece(element: Element, text: str) -> int:
    return _key(f"{element.key}:{text}")


def text_of(source: str | None, cut: frozenset[int], kept: frozenset[int] = frozenset()) -> str:
    """The page's text: ``cut`` holds elements and pieces that go, ``kept`` elements of weight ``HALF`` that stay."""
    elements, texts = blocks(source)
    main = _has_main(elements)
    weighed = [(w, e, t) for e, t in texts if (w := _weight(e, main)) > 0]
    left = [
        t for w, e, t in weighed
        if (w == 1 or e.key in kept) and e.key not in cut and (not cut or _piece(e, t) not in cut)
    ]
    if main and not left:
        left = [t for w, _, t in weighed if w == 1]
    return "\n".join(left)

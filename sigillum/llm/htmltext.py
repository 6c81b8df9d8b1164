"""Main text of web pages by two passes of block rules.

A page is cut into blocks at its block elements. The first pass classifies each
block by its place (menus, headers, footers, sidebars, notices, adverts, forms
and comments are known by element or by class), its density of stop words, its
length and its share of link text: good, bad, or too short to tell. In the
second pass those that are undecided take the class of the nearest decided
blocks around them.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few, table

# Sent with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Frequent words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be because been but by can could did do for from had has have he
    her his how i if in into is it its more most no not of on one only or other our out she so some than that the
    their them then there these they this to up was we were what when which who will with would you
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais même ne nous on ou
    par pas pour plus qu que qui sa se ses son sont sur tout un une vous
    aber als am auch auf aus bei bin bis das dass dem den der die durch ein eine einem einen einer er es für hat ich
    ihr im ist mit nach nicht noch nur oder sein sich sie sind über und uns von vor war wie wird zu zum zur
    al como con cuando del desde donde el ella entre era es esta este fue ha hay las lo los me mi muy o para pero por
    porque se sin sobre su sus también te tiene todo una uno y ya""".split()
)
# Elements by what their text is.
RAW = ("script", "style", "iframe", "title")
UNSEEN = frozenset("head svg object noscript template script style annotation annotation-xml".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
BAD = frozenset(
    "nav footer aside form menu menuitem dialog button select option textarea input label fieldset datalist"
    " audio video canvas map".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
MAIN = frozenset(("article", "main"))
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select"
    " summary table tbody td textarea tfoot th thead tr ul".split()
)
# Of SVG and MathML: what opens them, where HTML goes on within them, and what ends them unless closed before.
FOREIGN = frozenset(("svg", "math"))
HTML_WITHIN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKS_OUT = BLOCKS | frozenset(
    "b big code em embed i img listing meta nobr ruby s small span strike strong sub sup tt u var".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": "li", "dt": "dd", "dd": "dd", "tr": "tr", "td": "td", "th": "td", "option": "option"}
# Words that class and id names of page furniture are made of.
COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies response responses respond".split())
FURNITURE = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidenav nav"
    " navbar navigation menu submenu breadcrumb breadcrumbs footer masthead topbar toolbar pagination pager cookie cookies"
    " gdpr consent newsletter notice notices alert popup paywall skip-link tagcloud".split()
)
# Titles of sections may be these: within an article they count only where there is no prose.
DOUBTFUL = frozenset(
    "discussion search related popular trending recommended recommendation recommendations social share sharing shares"
    " follow tags side copyright disclaimer subscribe subscription login signin signup widget widgets overlay modal"
    " more-stories header foot top".split()
)
# What such words say something about: `related-posts`, `share-buttons`, `cookie-bar`.
OBJECTS = frozenset(
    "post posts article articles story stories link links content news button buttons icon icons bar box banner form list"
    " item items notice popup modal overlay area section wrapper wrap container inner slot unit block panel media thread"
    " body text title row column widget widgets toggle menu nav top bottom left right main wide primary secondary".split()
)
# What is said by them is about the layout or the subject of an article: `has-sidebar`, `tag-popular`.
SAYS_OF = frozenset(
    "has no not with without hide show is in category cat tag topic type status format author term taxonomy section".split()
)
# Within an article ids are often made of titles: these whole names only are of something else.
BAD_ID = re.compile(
    r"(?:[a-z]+[_-])?(?:side-?bar|nav-?bar|breadcrumbs?|footer|masthead|top-?bar|tool-?bar|pagination|pager|newsletter)"
    r"|(?:top|main|site|page|post|entry|left|right|bottom)?[_-]?(?:nav|menu)|nav[_-]?menu"
    r"|ads?|ad[_-]?(?:slot|unit|box|banner|container|wrapper)?[_-]?\d*|advert\w*|sponsored|promo"
    r"|(?:cookies?|gdpr|consent)[_-](?:notice|banner|bar|consent|popup|modal|overlay)"
    r"|newsletter[_-](?:sign-?up|form|box)|subscribe[_-](?:form|box)|(?:sign-?up|log-?in|search)[_-]?(?:form|box)"
    r"|(?:share|sharing|social)[_-](?:buttons?|links?|bar|icons?|media[_-]links?|share)"
    r"|(?:related|recommended|popular|trending|more)[_-](?:posts?|articles?|stories|links|content|news)"
    r"|comments?(?:[_-](?:list|area|section|form|\d+))?|commentlist|disqus\w*|respond|popup|modal|overlay|widgets?",
    re.IGNORECASE,
)
MAIN_NAME = re.compile(
    r"(?:^|.*[_-])(?:article|post|entry|story|main|content)(?:[_-]?(?:body|text|content))?", re.IGNORECASE | re.DOTALL
)
BAD_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PARTS = re.compile(r"[_-]+")

LONG, SHORT = 120, 40  # characters
HIGH_STOPS, LOW_STOPS = 0.2, 0.08
MOST_LINKS = 0.4
LONG_SIGNS = 40  # of scripts that write words or syllables
WRAPS, WRAPS_FORM = 0.8, 0.5  # shares of a page's prose

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(
    r"[\s/]*+(?:(?P<end>>)|(?P<name>[^\s/>][^\s/>=]*+)"
    r"(?:\s*+=\s*+(?:\"(?P<double>[^\"]*+)\"|'(?P<single>[^']*+)'|(?P<open>[\"'])|(?P<bare>[^\s>]*+)))?)"
)
_READ = frozenset(("class", "id", "role", "style", "hidden", "aria-hidden"))
# Where elements of text only end; within noscript its end ends them as well.
_END = {
    (name, within): re.compile(rf"</{name}(?=[\s/>])[^>]*>" + (r"|(?=</noscript[\s/>])" if within else "") + r"|\Z", re.I)
    for name in RAW
    for within in (False, True)
}
_COMMENT_END = {
    False: re.compile(r"--!?>|\Z"),
    True: re.compile(r"--!?>|(?=</noscript[\s/>])|\Z", re.IGNORECASE),
}
_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile(r"[A-Za-z\u00aa\u00ba\u00c0-\u02af\u1e00-\u1eff]")
_SIGN = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\ua000-\ua4cf\uac00-\ud7af\uf900-\ufaff]")
_SENTENCE = re.compile(r"[.!?\u2026](?=\s|[\"')\u00bb\u201d\u2019]|\Z)|[\u0964\u3002\uff01\uff1f\u061f\u06d4]")

_COMMENT, _STRONG, _WEAK, _HARD = "comment", "strong", "weak", "hard"


def attributes(page: str, place: int) -> tuple[dict[str, str], bool, int]:
    """`(values by name, whether the tag closes itself, where it ends)`, from behind a tag's name.

    A quote opens a value only after an equals sign. A tag whose value is never
    closed ends at its first `>`, one without any `>` at the page's end.
    """
    if page.startswith(">", place):
        return {}, False, place + 1
    found: dict[str, str] = {}
    at = place
    while True:
        match = _ATTRIBUTE.match(page, at)
        if match is None:
            return found, False, len(page)
        if match["open"]:
            end = page.find(">", place)
            return found, False, len(page) if end < 0 else end + 1
        if match["end"]:
            is_closed = page[match.start("end") - 1] == "/" and match.start("end") - 1 >= at
            return found, is_closed, match.end()
        name = match["name"].lower()
        if name in _READ and name not in found:
            value = match["double"] or match["single"] or match["bare"] or ""
            found[name] = html.unescape(value) if "&" in value else value
        at = match.end()


def name_kind(name: str) -> str | None:
    """What a class or id says of its element, as a whole: of comments, of furniture, or in doubt."""
    parts = [p for p in _PARTS.split(_CAMEL.sub("-", name).lower()) if p]
    while len(parts) > 1 and parts[-1].isdigit():
        parts.pop()
    if not parts or (len(parts) > 1 and parts[0] in SAYS_OF):
        return None
    whole, last = "-".join(parts), parts[-1]
    if whole in COMMENT_NAMES:
        return _COMMENT
    if whole in FURNITURE:
        return _STRONG
    if whole in DOUBTFUL:
        return _WEAK
    if len(parts) == 1:
        return None
    others = parts[1:]
    if parts[0] in COMMENT_NAMES and all(p in OBJECTS or p in COMMENT_NAMES or p == "author" for p in others):
        return _COMMENT
    if last in ("comments", "commentlist", "replies"):
        return _COMMENT
    if last in FURNITURE or (parts[0] in FURNITURE and all(p in OBJECTS for p in others)):
        return _STRONG
    if parts[0] in DOUBTFUL and all(p in OBJECTS or p in FURNITURE for p in others):
        return _WEAK if parts[0] in ("header", "top", "side") else _STRONG
    return None


@dataclass(slots=True, eq=False)
class Node:
    """An element, and what its place and its content say of it."""

    name: str
    parent: Node | None
    kind: str | None = None
    is_main: bool = False  # in an article
    opens_main: bool = False
    is_link: bool = False
    is_unseen: bool = False
    is_foreign: bool = False
    is_noscript: bool = False
    mark: Node | None = None  # the nearest element that may decide
    mains: int = 0  # articles within
    prose: int = 0
    length: int = 0
    is_bad: bool = False
    is_header: bool = False  # of an article: only its headings belong to it


@dataclass(slots=True, eq=False)
class Block:
    node: Node
    is_joined: bool  # no element of its own starts here
    parts: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    text: str = ""
    is_bad: bool = False
    is_main: bool = False

    def settle(self) -> None:
        self.text = " ".join(html.unescape("".join(self.parts)).split())

    def link_share(self) -> float:
        return len(" ".join("".join(self.links).split())) / max(1, len(self.text)) if self.links else 0.0

    def stop_share(self) -> float:
        words = _WORD.findall(self.text.lower())
        return sum(w in STOP_WORDS for w in words) / max(1, len(words))

    def is_long(self) -> bool:
        n = len(self.text)
        return n >= LONG or (n >= LONG_SIGNS and len(_SIGN.findall(self.text)) * 2 >= n)

    def is_listed(self) -> bool:
        """Whether a list of stop words may know its script."""
        letters = sum(map(len, _WORD.findall(self.text)))
        return len(_LATIN.findall(self.text)) * 2 >= letters


def _kind(name: str, read: dict[str, str], above: Node) -> tuple[str | None, bool]:
    """What class, id, role and style say, and whether they name an article."""
    if not read or name in ("html", "body"):
        return None, False
    classes = read.get("class", "").split()
    own_id = read.get("id", "").strip()
    is_section = name == "section" or "section" in map(str.lower, classes)
    kinds = [] if name in HEADINGS else [name_kind(c) for c in classes]
    if own_id and name not in HEADINGS:
        if not above.is_main:
            kinds.append(name_kind(own_id))
        elif not is_section and BAD_ID.fullmatch(own_id):  # a section's id is its title's
            kinds.append(_COMMENT if own_id.lower().startswith(("comment", "disqus", "respond")) else _STRONG)
    is_article = any(MAIN_NAME.fullmatch(c) and not name_kind(c) for c in [*classes, own_id] if c)
    if name in MAIN:
        kinds = [k for k in kinds if k == _COMMENT]
    elif is_article:
        kinds = [k for k in kinds if k != _WEAK]
    is_hidden = (
        "hidden" in read and read["hidden"].lower() != "until-found"
        or read.get("aria-hidden", "").strip().lower() == "true"
        or _NONE.search(read.get("style", ""))
    )
    if is_hidden or any(r in BAD_ROLES for r in read.get("role", "").lower().split()):
        return _HARD, is_article
    for kind in (_COMMENT, _STRONG, _WEAK):
        if kind in kinds:
            return kind, is_article and kind == _WEAK
    return None, is_article


def _opened(name: str, read: dict[str, str], above: Node) -> Node:
    kind, is_article = _kind(name, read, above)
    opens_main = (name in MAIN and kind != _COMMENT) or is_article
    node = Node(
        name,
        above,
        kind,
        is_main=above.is_main or name in MAIN or is_article,
        opens_main=opens_main,
        is_link=above.is_link or name == "a",
        is_unseen=above.is_unseen or name in UNSEEN,
        is_foreign=name in FOREIGN or (above.is_foreign and name not in HTML_WITHIN),
        is_noscript=above.is_noscript or name == "noscript",
    )
    decides = kind or name in BAD or name == "header" or node.is_main != above.is_main or name in HEADINGS
    node.mark = node if decides else above.mark
    return node


def _parsed(page: str) -> tuple[list[Node], list[Block]]:
    """The elements, parents first, and the blocks with text, in page order."""
    root = Node("", None)
    root.mark = root
    nodes, stack = [root], [root]
    found: list[Block] = []
    current: Block | None = None
    is_joined = False
    place, size = 0, len(page)
    while place < size:
        top = stack[-1]
        if page[place] != "<":
            end = page.find("<", place)
            text, place = page[place : size if end < 0 else end], size if end < 0 else end
        elif tag := _TAG.match(page, place):
            text = None
        elif top.is_foreign and page.startswith("<![CDATA[", place):
            end = page.find("]]>", place)
            end = size if end < 0 else end
            if current is not None and not top.is_unseen:
                current.parts.append(html.escape(page[place + 9 : end]))
            place = end + 3
            continue
        elif page.startswith("<!--", place):
            if page.startswith((">", "->"), place + 4):
                place = page.index(">", place) + 1
            else:
                place = _COMMENT_END[top.is_noscript].search(page, place + 4).end()
            continue
        elif page.startswith(("<!", "<?", "</"), place):
            end = page.find(">", place)
            place = size if end < 0 else end + 1
            continue
        else:
            text, place = "<", place + 1
        if text is not None:
            if top.name == "head" and not text.isspace():
                stack.pop()
                top = stack[-1]
            if top.is_unseen:
                continue
            if current is None or current.node.mark is not top.mark:
                current = Block(top, is_joined and current is not None)
                found.append(current)
                is_joined = True
            current.parts.append(text)
            if top.is_link:
                current.links.append(text)
            continue
        is_end, name = tag[1], tag[2].lower()
        read, is_closed, place = attributes(page, tag.end())
        if is_end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
            if (name in BLOCKS or name == "head") and not stack[-1].is_unseen:
                current = None
            continue
        if name in BREAKS_OUT:
            while stack[-1].is_foreign:
                stack.pop()
        if name == "body" or (stack[-1].name == "head" and name not in IN_HEAD):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "head":
                    del stack[k:]
                    break
        top = stack[-1]
        if (name in BLOCKS or name in ("head", "title")) and not (top.is_unseen or top.is_foreign):
            current = None
        if name in RAW and not top.is_foreign:
            place = _END[name, top.is_noscript].search(page, place).end()
            continue
        if name in BLOCKS and name != "br":
            ends = CLOSES.get(name)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p" or (ends and CLOSES.get(stack[k].name) == ends):
                    del stack[k:]
                    break
                if stack[k].name in BLOCKS or stack[k].name in UNSEEN or stack[k].name in FOREIGN:
                    break
        if name not in VOID and not is_closed:
            node = _opened(name, read, stack[-1])
            stack.append(node)
            nodes.append(node)
    for block in found:
        block.settle()
    return nodes, found


def _judge(nodes: list[Node], found: list[Block]) -> None:
    """Decides for each element whether it is of the article, by names and by what it holds.

    An element that holds all articles of the page is none of its furniture, nor
    is a form or a layout that holds most of its prose.
    """
    for block in found:
        n = len(block.text)
        block.node.length += n
        if n >= SHORT and block.link_share() <= MOST_LINKS and (
            block.stop_share() >= (LOW_STOPS if n >= LONG else HIGH_STOPS) or (block.is_long() and not block.is_listed())
        ):
            block.node.prose += n
    for node in reversed(nodes):
        node.mains += node.opens_main
        if node.parent is not None:
            node.parent.mains += node.mains
            node.parent.prose += node.prose
            node.parent.length += node.length
    mains, prose = nodes[0].mains, nodes[0].prose
    for node in nodes[1:]:
        above, name = node.parent, node.name
        is_bad, is_header = above.is_bad, above.is_header
        holds_all = mains > 0 and node.mains == mains
        if name == "header" and above.is_main and not is_bad:
            is_header = is_bad = True
        elif is_header and name in HEADINGS:
            is_header = is_bad = False
        if name == "form":
            is_bad = is_bad or not (holds_all or (prose > 0 and node.prose > WRAPS_FORM * prose))
        elif name in BAD or name == "header":
            is_bad = True
        if node.kind == _WEAK:
            is_bad = is_bad or not (holds_all or (above.is_main and 0 < node.length <= 2 * node.prose))
        elif node.kind == _STRONG:
            is_bad = is_bad or not (holds_all or (mains == 0 and node.prose > WRAPS * prose))
        elif node.kind:
            is_bad = is_bad or not holds_all
        node.is_bad, node.is_header = is_bad, is_header


def blocks(page: str) -> list[Block]:
    """The blocks with text, in page order, each with its place."""
    nodes, found = _parsed(page)
    _judge(nodes, found)
    joined: list[Block] = []
    for block in found:
        block.is_bad, block.is_main = block.node.is_bad, block.node.is_main
        last = joined[-1] if joined else None
        if block.is_joined and last and (last.is_bad, last.is_main) == (block.is_bad, block.is_main):
            last.parts += block.parts
            last.links += block.links
            last.settle()
        else:
            joined.append(block)
    return [block for block in joined if block.text]


def _is_known_language(found: list[Block]) -> bool:
    """Whether the stop words of the lists occur in the page's prose at all."""
    long = [b for b in found if not b.is_bad and len(b.text) >= LONG and b.is_listed() and b.link_share() <= MOST_LINKS]
    return not long or sum(b.stop_share() * len(b.text) for b in long) >= LOW_STOPS * sum(len(b.text) for b in long)


def _first_pass(block: Block, has_main: bool, is_known: bool) -> bool | None:
    """Good, bad, or None for undecided."""
    if block.is_bad or (has_main and not block.is_main):
        return False
    if block.link_share() > MOST_LINKS:
        return None if block.is_main and not block.is_long() else False
    if not block.is_listed() or not is_known:
        return True if block.is_long() and _SENTENCE.search(block.text) else None
    stops = block.stop_share()
    if len(block.text) >= LONG and stops >= LOW_STOPS:
        return True
    if len(block.text) >= SHORT and stops >= HIGH_STOPS:
        return True
    if len(block.text) >= LONG and not block.is_main:
        return False
    return None


def main_text(page: str) -> str:
    """The article's text: its blocks joined by one space, empty if there is none."""
    found = blocks(page)
    has_main = any(b.is_main and not b.is_bad for b in found)
    is_known = _is_known_language(found)
    first = [_first_pass(b, has_main, is_known) for b in found]
    # A decided block outside the article says nothing about one inside it.
    says = [c if c or not (has_main and (b.is_bad or not b.is_main)) else None
            for b, c in zip(found, first, strict=True)]
    n = len(found)
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    last = None
    for k in range(n):
        before[k] = last
        last = (k, says[k]) if says[k] is not None else last
    last = None
    for k in range(n - 1, -1, -1):
        after[k] = last
        last = (k, says[k]) if says[k] is not None else last
    kept = []
    for k, block in enumerate(found):
        good = first[k]
        if good is None:
            near = [x for x in (before[k], after[k]) if x]
            if not near:
                good = block.is_main  # nothing is decided: its place tells
            elif len(near) == 2 and near[0][1] != near[1][1]:
                left, right = k - near[0][0], near[1][0] - k
                good = near[0][1] if left < right else near[1][1] if right < left else True
            else:
                good = near[0][1]
        if good:
            kept.append(block.text)
    return " ".join(kept)


@F.arrow_udf(T.StringType())
def _main_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in batches:
        done = [pa.array([main_text(page) if page else "" for page in some], pa.string()) for some in few(pages)]
        yield pa.concat_arrays(done) if done else pa.array([], pa.string())


def extracted(page: Column) -> Column:
    """The main text of each whole page; empty for a NULL or empty page."""
    return _main_texts(page)


def extract(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """`(page_id, url, text, n_chars)`, one row for each row of `pages`.

    Cases. NULL and empty pages, and pages without an article, give an empty
    text. What a page leaves open (elements, comments, quotes) ends with the
    page or with the element around it; a head ends at the first element or text
    that cannot be in one, SVG and MathML at the first HTML element that cannot
    be in them. Formulas are text, but for their annotations. A very long page is
    read whole, in time that follows its length. Names of headings tell nothing;
    within an article an id tells what is not of it as a whole name only, and that
    of a section nothing. Classes and ids are compared as whole names; no class
    of an `article` or of what holds all articles makes it furniture, nor does a
    form or a layout that holds most of the prose. Prose of scripts and languages
    that the lists of stop words do not know is told by its length, its links and
    the ends of its sentences. Equal pages have equal texts; NULL and repeated
    ids and urls stay as they are. Further columns, whatever their names, are not
    read. An empty table gives none.
    """
    return pages.select("page_id", "url", extracted(F.col(html_col)).alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long")
    )


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

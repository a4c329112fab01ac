"""HTML extraction by wrappers: the pages of a host are aligned into a union-free expression, whose slots tell what is main text."""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import discard, pieces, stash

#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Those of them whose content is text.
TEXT = {"title": True, "textarea": True, "xmp": False}
#: Elements that hold no main text.
ASIDE = frozenset("head nav header footer aside form script style noscript template iframe button select option textarea title menu dialog noembed noframes".split())
#: Elements inside a line of text; all others end a block. br counts as white space.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics annotation".split())
#: Words of class, id or role (whole, or before a - or _) that name what is never main text, and words that do so outside main elements
#: if they stand alone. Words that only hint at it: such a block goes if it is mostly links.
NEVER = re.compile(
    r"(?:^|\s)(?:ads?(?:[-_]?(?:box|slot|unit|banner|container|wrapper|block|space|sense|s|\d+))?|advert\w*|sponsor(?:ed|s)?|cookies?[-_]?(?:notice|banner|bar|consent|law|message|popup|warning)|"
    r"gdpr|consent|newsletter|comments?|comment[-_](?:list|body|form|thread|section|area)|commentlist|disqus\w*|sidebar|breadcrumbs?|pagination|navbar|nav|navigation|menu|menu[-_](?:item|list|bar)|"
    r"complementary|contentinfo|popup|modal)(?=$|\s|[-_]\d)"
)
OUTSIDE = re.compile(r"(?:^|\s)(?:site[-_])?(?:header|footer|notices?|masthead|banner|copyright|login|search|overlay|toolbar|topbar|widget|alert|skip|foot|side|subscribe|signup|promo)(?=$|\s)")
HINT = re.compile(r"(?:^|[^a-z])(?:share|sharing|social|related|recommend\w*|pager|reply|replies|respond|links|tags|header|footer|menu|nav|sidebar|comments?|widget|promo)(?:$|[^a-z])")
#: Elements of main text, and how near they are to it.
MAIN = {"main": 1, "article": 2}
#: Elements that stand in lists and tables.
ITEMS = frozenset("li dt dd tr td th option".split())
#: Elements that the start of a block closes if it is open.
IN_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+\Z", re.S)
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"[ \t\n\r\f\v\x85\xa0  -     　]+")


@dataclass(slots=True)
class Token:
    """A tag (text None) or the text of a block. symbol: the tag's name, / and the name at its end, or '#' for text. main: 2 in an
    article, 1 in another main element; aside: whether it stands in an element that holds no main text; hint: whether a name
    around it says so without being sure; link: whether it is mostly links."""

    symbol: str
    text: str | None = None
    main: int = 0
    aside: bool = False
    hint: bool = False
    link: bool = False


@dataclass(slots=True)
class _Open:
    """An element that is open: what holds for what it contains."""

    name: str
    main: int = 0
    aside: bool = False
    hint: bool = False
    closed: bool = False


def tokens(page: str | None) -> list[Token]:
    """The block tags and texts of a page. Inline tags only part words where the page has white space; character references are
    decoded and white space becomes one space."""
    out: list[Token] = []
    stack: list[_Open] = []
    opened: Counter = Counter()
    inline: dict[str, list[_Open]] = {}
    words: list[str] = []
    linked = 0
    ground = _Open("")

    def say(text: str) -> None:
        nonlocal linked
        words.append(text)
        if opened["a"]:
            linked += len(text)

    def flush() -> None:
        nonlocal linked
        if words:
            text = SPACE.sub(" ", "".join(words)).strip(" ")
            words.clear()
            if text:
                at = stack[-1] if stack else ground
                out.append(Token("#", text, at.main, at.aside, at.hint, 2 * linked >= len(text)))
            linked = 0

    def leave() -> None:
        x = stack.pop()
        if not x.closed:
            opened[x.name] -= 1
            if x.name in INLINE:
                inline[x.name].pop()
            else:
                out.append(Token("/" + x.name))

    def pop(name: str) -> None:
        if opened[name]:
            flush()
            while stack[-1].name != name or stack[-1].closed:
                leave()
            leave()

    page = page or ""
    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            say(entities.unescape(page[at:]))
            break
        if m.start() > at:
            say(entities.unescape(page[at : m.start()]))
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in INLINE:
                if opened[name]:  # an inline element ends no block
                    inline[name].pop().closed = True
                    opened[name] -= 1
                    while stack and stack[-1].closed:
                        stack.pop()
            else:
                flush()
                pop(name)
            continue
        if name == "br":
            words.append(" ")
            continue
        if name not in INLINE:
            flush()
            if name in IN_P:
                pop("p")
            if name in CLOSES and any(opened[x] for x in CLOSES[name].split()):
                for x in reversed(stack):
                    if x.name in ("ul", "ol", "dl", "table", "select"):
                        break
                    if x.name in CLOSES[name].split() and not x.closed:
                        pop(x.name)
                        break
        around = stack[-1] if stack else ground
        marks = " ".join(v for x in NAMED.finditer(m[3] or "") for v in x.groups()[1:] if v).lower() if m[3] else ""
        main = max(around.main, MAIN.get(name, 1 if "main" in marks.split() else 0))
        aside = around.aside or name in ASIDE and not (name == "header" and around.main)
        hint = around.hint
        if marks and name not in ("body", "html"):
            aside = aside or bool(NEVER.search(marks)) or not main and bool(OUTSIDE.search(marks))
            hint = hint or bool(HINT.search(marks))
        own = _Open(name, main, aside, hint)
        if name in VOID or (m[3] or "").endswith("/") and name in ("path", "g", "rect"):
            continue
        if name not in INLINE:
            out.append(Token(name, None, main, aside, hint))
        stack.append(own)
        opened[name] += 1
        if name in INLINE:
            inline.setdefault(name, []).append(own)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            stop = end.start() if end else n
            if name in TEXT:
                say(entities.unescape(page[at:stop]) if TEXT[name] else page[at:stop])
                flush()
            leave()
            at = end.end() if end else n
    flush()
    return out


# --- wrappers ---------------------------------------------------------------------------------------------------------------

#: Parts of an element that are aligned in order; an element of more kinds of parts takes them in any order: ((a)? (b)? ...)+.
#: Elements nested deeper than DEEPEST are not told apart. Parts of a whole wrapper, before its largest elements take any order.
MOST_PARTS, DEEPEST, MOST_NODES = 40, 150, 4000


@dataclass(slots=True)
class Node:
    """Part of a wrapper, or of a page: a text (kind '#': `text` if it is always the same, else None: a slot), an element (its tag) or a
    group of several parts ('(').

    opt: not every page has it; repeat: it may follow itself; free: its parts come in any order and number. pages, main, aside,
    link: of how many pages it is, and on how many of them it was in a main element, aside, or a hinted block of links. src:
    the page's tokens that it stands for.
    """

    kind: str
    key: str
    parts: list[Node] = field(default_factory=list)
    text: str | None = None
    opt: bool = False
    repeat: bool = False
    free: bool = False
    pages: int = 1
    main: int = 0
    aside: int = 0
    link: int = 0
    src: list[int] = field(default_factory=list)


def _constant(text: str) -> str:
    """A text, or for a long one its digest: enough to see whether it is always the same."""
    return text if len(text) <= 80 else "\0" + blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def as_tree(page: list[Token], places: bool = False) -> list[Node]:
    """The parts of a page; with the places of their tokens, if asked for."""
    levels: list[list[Node]] = [[]]
    owners: list[Node] = []
    too_deep = 0
    for k, t in enumerate(page):
        if t.text is not None:
            levels[-1].append(Node("#", "#", [], _constant(t.text), main=int(t.main > 0), aside=int(t.aside), link=int(t.hint and t.link), src=[k] if places else []))
        elif t.symbol[0] == "/":
            if too_deep:
                too_deep -= 1
            elif owners:
                owners[-1].parts = levels.pop()
                _settle(owners.pop())
        elif len(owners) >= DEEPEST:
            too_deep += 1
        else:
            key = t.symbol + "*" * (t.main > 0) + "!" * t.aside + "~" * t.hint  # parts of different standing are no instances of each other
            node = Node(t.symbol, key, main=int(t.main > 0), aside=int(t.aside))
            levels[-1].append(node)
            owners.append(node)
            levels.append([])
    while owners:
        owners[-1].parts = levels.pop()
        _settle(owners.pop())
    return levels[0]


def _merge(a: Node, b: Node, one_page: bool) -> Node:
    """A part that stands for both; both have the same key. one_page: both are of the same page."""
    count = max if one_page else int.__add__
    free = a.free or b.free
    return _settle(Node(
        a.kind, a.key, _loose(a.parts + b.parts, one_page) if free else widen(a.parts, b.parts, one_page) if a.parts or b.parts else [],
        a.text if a.text == b.text else None, a.opt or b.opt, a.repeat or b.repeat, free,
        count(a.pages, b.pages), count(a.main, b.main), count(a.aside, b.aside), count(a.link, b.link), a.src + b.src,
    ))


def _settle(node: Node) -> Node:
    """node; if it has too many parts, with those that follow themselves as repeated ones, and else in any order."""
    if not node.free and node.kind != "(" and len(node.parts) > MOST_PARTS:
        runs: list[Node] = []
        for x in node.parts:
            if runs and runs[-1].key == x.key and x.kind != "#":
                runs[-1] = _merge(runs[-1], x, True)
                runs[-1].repeat = True
            else:
                runs.append(x)
        node.free, node.parts = (True, _loose(runs, True)) if len(runs) > MOST_PARTS else (False, runs)
    return node


def _flat(nodes: Iterable[Node]) -> Iterator[Node]:
    for x in nodes:
        if x.kind == "(":
            yield from _flat(x.parts)
        else:
            yield x


def _loose(nodes: list[Node], one_page: bool) -> list[Node]:
    """Each kind of part once, an optional one; parts of one page count as one."""
    found: dict[str, Node] = {}
    for x in _flat(nodes):
        found[x.key] = _merge(found[x.key], x, one_page) if x.key in found else x
        found[x.key].opt = True
    return list(found.values())


def _says(x: Node) -> str | None:
    """The constant text of a part, or of the first part in it that has one."""
    while x.kind != "#" and x.parts:
        x = x.parts[0]
    return x.text if x.kind == "#" else None


def _again(x: Node, y: Node) -> bool:
    """Whether two neighbours are instances of one repeated part: one of them isn't on every page or repeats already, and neither has a
    text of its own on several pages. Items of a list or table are, even so, and also if the text of one varies."""
    if x.key != y.key or x.kind == "#":
        return False
    if x.kind in ITEMS and (_says(x) is None or _says(y) is None):
        return True
    if not (x.opt or y.opt or x.repeat or y.repeat):
        return False
    return x.kind in ITEMS or not any(z.pages > 1 and _says(z) is not None for z in (x, y)) or _says(x) == _says(y)


def fold(nodes: list[Node]) -> list[Node]:
    """An expression in which parts that follow themselves, and then runs of parts that do, become repeated: the shortest runs first."""
    out: list[Node] = []
    for x in nodes:
        if out and _again(out[-1], x):
            out[-1] = _merge(out[-1], x, True)
            out[-1].repeat = True
        else:
            out.append(x)
    size = 2
    while 2 * size <= len(out):
        new, i = [], 0
        while i < len(out):
            unit, k = out[i : i + size], i + size
            while len(unit) == size and len(out) >= k + size and any(x.kind != "#" for x in unit) and all(
                x.key == y.key and (x.kind == "#" or _again(x, y)) for x, y in zip(unit, out[k : k + size], strict=True)
            ):
                unit = [_merge(x, y, True) for x, y in zip(unit, out[k : k + size], strict=True)]
                k += size
            if k > i + size:
                new.append(Node("(", "(" + " ".join(x.key for x in unit) + ")", unit, repeat=True, pages=max(x.pages for x in unit)))
                i = k
            else:
                new.append(out[i])
                i += 1
        out = new
        size += 1
    return out


def _instance(group: Node, nodes: list[Node], at: int) -> list[list[Node]] | None:
    """The parts from `at` on that are instances of each of a group's parts, None if they make no instance of the group."""
    out, i = [], at
    for x in group.parts:
        begin = i
        while i < len(nodes) and nodes[i].key == x.key and (x.repeat or i == begin):
            i += 1
        if i == begin and not x.opt:
            return None
        out.append(nodes[begin:i])
    return out if i > at else None


def _grouped(nodes: list[Node], others: list[Node]) -> list[Node]:
    """nodes, with runs that are instances of groups that others have taken together."""
    for g in others:
        if g.kind == "(" and len(nodes) > 1:
            out, i = [], 0
            while i < len(nodes):
                parts = _instance(g, nodes, i) if nodes[i].kind != "(" else None
                if parts is None:
                    out.append(nodes[i])
                    i += 1
                else:
                    own = [_together(ys) if ys else _optional(_blank(x)) for x, ys in zip(g.parts, parts, strict=True)]
                    out.append(Node("(", g.key, own, pages=max(x.pages for x in own)))
                    i += sum(map(len, parts))
            nodes = out
    return nodes


def _blank(x: Node) -> Node:
    """A part of which a page has no instance."""
    return Node(x.kind, x.key, [_blank(y) for y in x.parts], x.text, x.opt, x.repeat, x.free, 0)


def _together(nodes: list[Node]) -> Node:
    """Instances of one repeated part on the same page."""
    out = nodes[0]
    for x in nodes[1:]:
        out = _merge(out, x, True)
        out.repeat = True
    return out


def pair(a: list[Node], b: list[Node]) -> list[tuple[list[Node], list[Node]]]:
    """Both sides in order, like parts side by side; several if they are instances of a repeated part of the other side. Where they
    differ, as many are paired as can be; elements count more than texts, and those with the same constant text more than others."""
    if len(a) == len(b) and all(x.key == y.key and not x.repeat and not y.repeat for x, y in zip(a, b, strict=True)):
        return [([x], [y]) for x, y in zip(a, b, strict=True)]
    a, b = _grouped(a, b), _grouped(b, a)
    front = 0
    while front < min(len(a), len(b)) and (x := a[front]).key == (y := b[front]).key and not x.repeat and not y.repeat and _says(x) == _says(y):
        front += 1
    done = [([x], [y]) for x, y in zip(a[:front], b[:front], strict=True)]
    a, b = a[front:], b[front:]
    n, m = len(a), len(b)
    says_a, says_b = [_says(x) for x in a], [_says(x) for x in b]
    # Best worth of the parts from i and j on, and how many parts of either side the first step takes: (1, 0) and (0, 1) leave one
    # alone. on_a[i][j]: the same if a[i], a repeated part, has been paired with what stands before b[j]; on_b the other way round.
    best = [[(0, 0, 1)] * (m + 1) for _ in range(n + 1)]
    on_a = [[(0, 0)] * (m + 1) for _ in range(n + 1)]
    on_b = [[(0, 0)] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        best[i][m] = (0, 1, 0)
        x, sx = a[i], says_a[i]
        for j in range(m - 1, -1, -1):
            y = b[j]
            choice = max((best[i + 1][j][0], 1, 0), (best[i][j + 1][0], 0, 1))
            more_a, more_b = (best[i + 1][j][0], 0), (best[i][j + 1][0], 0)
            if x.key == y.key:
                w = (2 if x.kind == "#" else 4) + 3 * (sx is not None and sx == says_b[j])
                choice = max(choice, (best[i + 1][j + 1][0] + w, 1, 1))
                if x.repeat:
                    worth, further = on_a[i][j + 1]
                    choice = max(choice, (worth + w, 1, 1 + further))
                    more_a = max(more_a, (worth + w, 1 + further))
                if y.repeat:
                    worth, further = on_b[i + 1][j]
                    choice = max(choice, (worth + w, 1 + further, 1))
                    more_b = max(more_b, (worth + w, 1 + further))
            best[i][j], on_a[i][j], on_b[i][j] = choice, more_a, more_b
    i = j = 0
    while i < n or j < m:
        _, di, dj = best[i][j]
        done.append((a[i : i + di], b[j : j + dj]))
        i, j = i + di, j + dj
    return done


def _optional(x: Node) -> Node:
    x.opt = True
    return x


def widen(a: list[Node], b: list[Node], one_page: bool = False) -> list[Node]:
    """The expression a, widened to match b as well: like parts are merged, texts that differ become slots, parts that one side lacks
    become optional, and what then follows itself becomes a repeated group."""
    out = [_merge(_together(x), _together(y), one_page) if x and y else _optional(_together(x or y)) for x, y in pair(a, b)]
    return fold(out)


@dataclass
class Wrapper:
    """The expression of a host's pages, their number (a page that a task sees several times counts once), and up to three
    checksums of different pages."""

    root: Node = field(default_factory=lambda: Node("html", "html", pages=0))
    prints: list[int] = field(default_factory=list)

    @property
    def pages(self) -> int:
        return self.root.pages

    @property
    def sure(self) -> bool:
        """Whether enough pages differ for what they share to be no accident."""
        return len(self.prints) >= FRAME_PAGES

    def take(self, other: Wrapper) -> None:
        a, b = self.root, other.root
        self.root = _merge(a, b, False) if a.pages and b.pages else a if a.pages else b
        self.prints = sorted({*self.prints, *other.prints})[:FRAME_PAGES]
        limit = MOST_PARTS
        while limit > 1 and size(self.root) > MOST_NODES:
            limit //= 2
            _loosen(self.root, limit)

    @staticmethod
    def of(every: list[Token], places: bool = False) -> Wrapper:
        """The wrapper of one page."""
        text = "\n".join(t.text for t in every if t.text is not None)
        mark = int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        root = _settle(Node("html", "html", as_tree(every, places)))
        return Wrapper(root, [mark])

    def dump(self) -> str:
        return json.dumps([_packed(self.root), self.prints], separators=(",", ":"))

    @staticmethod
    def load(text: str) -> Wrapper:
        root, prints = json.loads(text)
        return Wrapper(_unpacked(root), prints)


def _packed(x: Node) -> list:
    return [x.kind, x.key if x.key != x.kind else 0, x.text, x.opt + 2 * x.repeat + 4 * x.free, x.pages, x.main, x.aside, x.link, [_packed(y) for y in x.parts]]


def _unpacked(x: list) -> Node:
    kind, key, text, flags, pages, main, aside, link, parts = x
    return Node(kind, key or kind, [_unpacked(y) for y in parts], text, bool(flags & 1), bool(flags & 2), bool(flags & 4), pages, main, aside, link)


def size(x: Node) -> int:
    return 1 + sum(map(size, x.parts))


def _loosen(x: Node, limit: int) -> None:
    if not x.free and x.kind != "(" and len(x.parts) > limit:
        x.free, x.parts = True, _loose(x.parts, True)
    for y in x.parts:
        _loosen(y, limit)


def infer(pages: Iterable[str | None]) -> Wrapper | None:
    """A wrapper for pages of one host; None without pages. Copies of a page count once."""
    out = Wrapper()
    for page in dict.fromkeys(pages):
        out.take(Wrapper.of(tokens(page)))
    return out if out.pages else None


def expression(nodes: Node | list[Node]) -> str:
    """The wrapper as text, for people: tags, #text or the constant, (...)? and (...)+."""

    def one(x: Node) -> str:
        inside = expression(x.parts)
        if x.free and inside:
            inside = f"({inside})+"
        body = ("#text" if x.text is None else repr(x.text)) if x.kind == "#" else inside if x.kind == "(" else " ".join(y for y in (f"<{x.kind}>", inside, f"</{x.kind}>") if y)
        body = f"({body})+" if x.repeat else body
        return f"({body})?" if x.opt else body

    return " ".join(one(x) for x in ([nodes] if isinstance(nodes, Node) else nodes))


#: Different pages of a host that must have a constant text at its place for it to be part of the frame: this many, and this share of all.
FRAME_PAGES, FRAME_SHARE = 3, 0.8


def label(x: Node, wrapper: Wrapper) -> str:
    """What a text of the wrapper is: 'frame' if nearly all pages have it and it never changes, 'aside' if its elements say so on most
    of its pages, 'main' if it stands in a main element on most, else 'open'."""
    if x.text is not None and wrapper.sure and x.pages >= FRAME_SHARE * wrapper.pages:
        return "frame"
    if 2 * x.aside > x.pages or 2 * x.link > x.pages:
        return "aside"
    return "main" if 2 * x.main > x.pages else "open"


def match(wrapper: list[Node], page: list[Node], free: bool = False) -> Iterator[tuple[Node, Node | None]]:
    """Each text of a page with the text of the wrapper that it is an instance of, None if there is none."""
    if free:
        known = {x.key: [x] for x in wrapper}
        pairs: Iterable = ((known.get(y.key, []), [y]) for y in _flat(page))
    else:
        pairs = pair(wrapper, page)
    for xs, ys in pairs:
        x = _together(xs) if xs and ys else None
        for y in ys:
            if y.kind == "#":
                yield y, x
            elif x is None:
                yield from match([], y.parts)
            elif x.free or y.free:
                yield from match(x.parts if x.free else _loose(x.parts, True), y.parts, True)
            else:
                yield from match(x.parts, y.parts)


def extract(page: str | None, wrapper: Wrapper | None = None) -> str:
    """Main text of a page, a block a line: the texts that instantiate main slots of its host's wrapper, or, if the page has none, open
    ones. Without a wrapper the page is its own."""
    every = tokens(page)
    own = Wrapper.of(every, True)
    wrapper = wrapper if wrapper and wrapper.pages else own
    kinds: dict[str, list[int]] = {"main": [], "open": [], "aside": [], "frame": []}
    for y, x in match([wrapper.root], [own.root]):
        kinds[label(y, own) if x is None else label(x, wrapper)] += y.src
    chosen = kinds["main"]
    if not chosen and not (any(t.main for t in every) and has_main(wrapper.root)):
        chosen = kinds["open"]
    return "\n".join(every[k].text for k in sorted(chosen))


def has_main(x: Node) -> bool:
    """Whether a text of the wrapper stands in a main element."""
    return any(has_main(y) for y in x.parts) if x.kind != "#" else 2 * x.main > x.pages and 2 * x.aside <= x.pages


# --- Spark ------------------------------------------------------------------------------------------------------------------


def host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


#: Parts of wrappers that a task holds before it hands over what it has.
HELD_NODES = 200_000


def partial_wrappers(pages: DataFrame, most: int = 300_000) -> DataFrame:
    """host, task, wrapper: of each task's pages. A task holds wrappers of at most HELD_NODES parts before it hands them on, and the
    checksums of `most` pages at a time, by which copies are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: dict[str, Wrapper] = {}
        total, task, sizes = 0, None, {}

        def hand_over() -> pa.RecordBatch:
            rows = [{"host": h, "task": task, "wrapper": w.dump()} for h, w in held.items()]
            held.clear()
            sizes.clear()
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in pieces(batches):
            for h, page, mark, own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                task = own if task is None else task
                if (key := hash((h, mark))) in seen:
                    continue
                if len(seen) >= most:
                    seen.clear()
                seen.add(key)
                w = held.setdefault(h, Wrapper())
                w.take(Wrapper.of(tokens(page)))
                total += (now := size(w.root)) - sizes.get(h, 0)
                sizes[h] = now
                if total > HELD_NODES:
                    yield hand_over()
                    total = 0
        if held:
            yield hand_over()

    schema = pa.schema([("host", pa.string()), ("task", pa.int64()), ("wrapper", pa.string())])
    own = pages.where("html IS NOT NULL").select(host().alias("host"), "html", F.xxhash64("html").alias("mark"), F.monotonically_increasing_id().alias("task"))
    return own.mapInArrow(run, "host string, task long, wrapper string")


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (Wrapper.dump()), inferred from all its pages: by tasks, then by bundles of tasks, then by host, so that no task
    meets more than a small part of the wrappers of a host with a third of all pages."""

    def join(table: pa.Table) -> pa.Table:
        out = Wrapper()
        rows = sorted(zip(table.column("task").to_pylist(), table.column("wrapper").to_pylist(), strict=True))
        for _, text in rows:
            out.take(Wrapper.load(text))
        return pa.table({"host": pa.array([table.column("host")[0].as_py()], pa.string()), "task": pa.array([rows[0][0]], pa.int64()), "wrapper": pa.array([out.dump()], pa.string())})

    schema = "host string, task long, wrapper string"
    found = stash(partial_wrappers(pages), "wrapper-parts")
    bundles = found.groupBy("host", F.pmod(F.xxhash64("task"), F.lit(64)).alias("bundle")).applyInArrow(join, schema)
    out = stash(bundles.groupBy("host").applyInArrow(join, schema).select("host", "wrapper"), "wrappers")
    discard(found)
    return out


def extract_pages(pages: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """page_id, url, text, n_chars of each page; null pages have an empty text, pages with no url or an odd one share the host "".

    One pass infers a wrapper for each host from all its pages, of any length; a second one matches each page with its host's
    wrapper, with no shuffle while the wrappers, whose size is measured, take broadcast_bytes at most, and else by a join on the
    host that adaptive execution can split. Repeated rows are rows of their own, and count once for a wrapper as far as a task sees
    them together. An empty table has an empty result; columns of other names are left behind.
    """
    learned = wrappers(pages)
    total = learned.agg(F.sum(F.octet_length("host") + F.octet_length("wrapper"))).first()[0] or 0
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host().alias("host"))
    known = None
    if total <= broadcast_bytes:
        known = pages.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in learned.collect()})
        rows = rows.withColumn("wrapper", F.lit(None).cast("string"))
        discard(learned)
    else:
        rows = rows.join(learned, "host", "left").select("page_id", "url", "html", "host", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, Wrapper] = {}
        for batch in pieces(batches):
            texts = []
            for page, h, text in zip(*(batch.column(i).to_pylist() for i in range(2, 5)), strict=True):
                w = ready.get(h)
                if w is None and page is not None:
                    text = known.value.get(h) if known else text
                    if len(ready) >= 64:
                        ready.clear()
                    w = ready[h] = Wrapper.load(text) if text else Wrapper()
                texts.append(extract(page, w))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))

"""Leaf blocks of a web page: runs of text under one block element, with what their ancestors say about them."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Elements of the HTML standard by how they lay out text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template iframe object svg math canvas title".split())
#: A new one of these ends an open one of the same group.
IMPLIED_END = {
    **dict.fromkeys("p address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                    "header hr main nav ol pre section table ul".split(), ("p",)),
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"),
    "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",),
}
#: An implied end does not reach beyond these.
SCOPE = frozenset("article aside body div footer form header main nav ol section table ul dl tr blockquote".split())

_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"[a-z]+")


#: Elements that hold items: where several of one look stand side by side, they are a list of entries.
ITEMS = frozenset("article details dd div dl figure form li section tr".split())
#: Elements and roles that hold a page's main part.
MAIN_TAGS, MAIN_ROLES = frozenset(("article", "main")), frozenset(("article", "main"))


#: Code points from which on a block counts as prose, in scripts with spaces and without.
PROSE = 25


def is_sentence(text: str) -> bool:
    return text[-1] in ".!?…。！？" and text.count(" ") > 2


@dataclass
class Block:
    """A run of text. What it says of its ancestors is shared with the elements that hold it, never copied."""

    text: str
    own: str
    tags: frozenset[str]
    names: frozenset[str]
    roles: frozenset[str]
    linked: int
    siblings: tuple[list[int], list[int]]  # how many elements like its item there are, and like that item's parent
    in_main: bool
    #: Code points of prose straight in its item, and in the item around that with the items of that.
    mass: tuple[list[int], list[int]]
    heads: int = 0  # headings before it
    page: list[int] = field(default_factory=list)  # main parts of the page, and the greatest mass of either kind, anywhere and in them


@dataclass(frozen=True, slots=True)
class _Open:
    tag: str
    own: str
    tags: frozenset[str]
    names: frozenset[str]
    roles: frozenset[str]
    siblings: tuple[list[int], list[int]]
    in_main: bool
    mass: tuple[list[int], list[int], list[int]]  # straight in its item; that with inner items; the item around it with its inner items
    children: dict


def _with(held: frozenset[str], more) -> frozenset[str]:
    return held if held.issuperset(more) else held.union(more)


class _Reader(HTMLParser):
    """Every step takes time in proportion to what it adds or closes, however deep the page is.

    `names`, if given, are the only words of class and id that are kept; without it a page's own words are.
    """

    def __init__(self, names: frozenset[str] | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.kept = names
        self.blocks: list[Block] = []
        none: frozenset[str] = frozenset()
        self.root = _Open("", "", none, none, none, ([1], [1]), False, ([0], [0], [0]), {})
        self.open: list[_Open] = []
        #: Places in `open` by tag, rising.
        self.at: dict[str, list[int]] = {}
        self.hidden: list[int] = []
        self.text: list[str] = []
        self.links = self.linked = self.heads = 0
        self.page = [0, 1, 1, 1, 1]

    def flush(self) -> None:
        if not self.text:
            return
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            top = self.open[-1] if self.open else self.root
            if len(text) >= PROSE and 2 * self.linked < len(text):
                for m in top.mass:
                    m[0] += len(text)
                for at in (1, 3) if top.in_main else (1,):
                    self.page[at : at + 2] = max(self.page[at], top.mass[0][0]), max(self.page[at + 1], top.mass[1][0], top.mass[2][0])
            self.blocks.append(Block(text, top.own, top.tags, top.names, top.roles, min(self.linked, len(text)), top.siblings, top.in_main, top.mass[::2], self.heads, self.page))
        self.text, self.linked = [], 0

    def push(self, e: _Open) -> None:
        self.at.setdefault(e.tag, []).append(len(self.open))
        if e.tag in HIDDEN:
            self.hidden.append(len(self.open))
        self.links += e.tag == "a"
        self.open.append(e)

    def pop(self, at: int) -> list[_Open]:
        gone = self.open[at:]
        for e in gone:
            self.at[e.tag].pop()
            self.links -= e.tag == "a"
        while self.hidden and self.hidden[-1] >= at:
            self.hidden.pop()
        del self.open[at:]
        return gone

    def barrier(self, but=()) -> int:
        """The place of the innermost element that an implied end does not pass."""
        return max((self.at[t][-1] for t in SCOPE if t not in but and self.at.get(t)), default=-1)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
            return
        if tag not in INLINE and tag not in VOID or tag == "hr":
            self.flush()
            self.end_implied(IMPLIED_END.get(tag, ()))
        if tag in VOID:
            return
        if tag == "body" and self.hidden:
            # Where the head was never closed.
            for e in self.pop(self.hidden[0]):
                if e.tag not in HIDDEN:
                    self.push(e)
        above = self.open[-1] if self.open else self.root
        words = {k: frozenset(_TOKEN.findall(v.lower())) for k, v in attrs if k in ("class", "id", "role") and v}
        role = words.pop("role", frozenset())
        names = frozenset().union(*words.values())
        siblings, mass = above.siblings, above.mass
        if tag in ITEMS or tag in SCOPE:
            mass = ([0], [0], above.mass[1])
        if tag in ITEMS:
            same = above.children.setdefault((tag, names), [0])
            same[0] += 1
            siblings = (same, above.siblings[0])
        is_main = tag in MAIN_TAGS or bool(role & MAIN_ROLES)
        self.page[0] += is_main and not above.in_main
        self.heads += tag in ("h1", "h2", "h3")
        block = tag not in INLINE
        self.push(_Open(
            tag, tag if block else above.own, _with(above.tags, (tag,)) if block else above.tags,
            _with(above.names, names if self.kept is None else names & self.kept), _with(above.roles, role), siblings, above.in_main or is_main, mass, {},
        ))

    def end_implied(self, ended) -> None:
        if not ended:
            return
        least, place = self.barrier(ended), len(self.open)
        for name in ended:
            held = self.at.get(name, ())
            k = bisect_right(held, least)
            if k < len(held):
                place = min(place, held[k])
        if place < len(self.open):
            self.pop(place)

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if tag not in INLINE:
            self.flush()
        held = self.at.get(tag)
        if held and (tag not in INLINE or held[-1] > self.barrier()):
            self.pop(held[-1])

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str | None, names: frozenset[str] | None = None) -> list[Block]:
    """The page's blocks in order; character references decoded, white space in a block made one space."""
    reader, html = _Reader(names), html or ""
    # A comment that is never closed hides the rest of the page, as browsers read it.
    opened = html.rfind("<!--")
    reader.feed(html[:opened] if opened >= 0 and html.find("-->", opened) < 0 else html)
    reader.close()
    reader.flush()
    return reader.blocks


def features(block: Block, named: bool = True) -> list[str]:
    """Names of the features that hold for a block: its ancestors' tags, roles and names, where it stands, and its look.

    Without `named` the words of class and id are left out; the rest holds in any language.
    """
    words = block.text.count(" ") + 1
    last = block.text[-1]
    mains, sentence = min(block.page[0], 2), "s" if is_sentence(block.text) else "x"
    # Where a page names its main parts, the rest of it is not what prose is measured by.
    most_prose = block.page[3:] if mains else block.page[1:3]
    brief = "b" if most_prose[0] < PROSE else ""
    # A page without prose tells nothing by where its prose is.
    straight, around = ("b" if most < PROSE else min(3, 4 * m[0] // most) if m[0] * 12 >= most else "n" for m, most in zip(block.mass, most_prose))
    return [
        "bias",
        *(f"in:{t}" for t in block.tags),
        *(f"role:{r}" for r in block.roles),
        *(f"name:{n}" for n in (block.names if named else ())),
        f"own:{block.own}",
        f"words:{min(words.bit_length(), 9)}{brief}",
        f"linked:{4 * block.linked // len(block.text)}",
        f"end:{'.' if last in '.!?…:;' else 'x'}",
        f"sign:{'©' in block.text or '®' in block.text}",
        f"main:{mains}{block.in_main}",
        *(f"{name}:{min(held[0], 3)}{sentence}" for name, held in zip(("like", "outer"), block.siblings) if held[0] > 1),
        f"heads:{min(block.heads, 2)}{mains}",
        f"mass:{straight}{around}main:{mains}{block.in_main}",
        f"mass:{straight}{around}{sentence}",
        f"mass:{straight}{block.own}",
    ]

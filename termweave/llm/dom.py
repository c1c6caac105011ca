"""Pages as blocks of text over a structure tree; simple tree matching and the merging of structure trees."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

from xxhash import xxh3_64_intdigest

#: Quotes count after an equals sign only, and only if they are closed.
_TAG = r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*+"[^"]*"|=\s*+'[^']*'|["'=])*+)>"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|{_TAG}|[^<]+|<", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - frozenset("body html head title td th tr tbody thead tfoot caption option optgroup li dd dt".split()) | {"p"}
#: An opening tag ends the nearest open one of these, unless one of the bounds lies between.
SIBLINGS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select datalist"), "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table")}
SIBLINGS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in SIBLINGS.items()}

#: Elements whose text is never read, and elements that say by their tag that they stand beside the article.
NEVER = frozenset("button canvas datalist head iframe noembed noframes noscript object script select style svg template textarea title".split())
REGIONS = frozenset("aside footer form nav".split())
MAIN = frozenset(["article", "main"])
#: Elements that a head may hold; anything else ends it.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Elements that hold text rather than other blocks.
TEXT = frozenset("address blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 legend li p pre summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Words by which a whole token of class, id or role names something beside the article ...
BESIDE = frozenset((
    "ad ads advert advertisement advertisements alert banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies dialog "
    "disqus footer menu menubar modal nav navbar navigation newsletter notice notices popup promo recommendations recommended related share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget"
).split())
#: ... if its other words are of these, which only say where it is or what it is made of. Any other word (no-sidebar, share-price) takes the name's force.
AROUND = frozenset((
    "and area article articles aside bar blog body bottom box button buttons column consent container content entry fixed form global group header icons "
    "inner item items layer left link links list main media more outer page panel post posts primary reader right rss secondary section site sticky "
    "stories story the top up user widgets wrap wrapper x"
).split())
#: Words of headers; such names count outside of main elements, unless they name a part of the article.
HEADER, OWN = frozenset(["header", "masthead"]), frozenset("article body content entry main post story text".split())
#: Longer words are written as their hash in labels.
LONGEST = 32


@lru_cache(maxsize=100_000)
def _token(token: str) -> tuple[tuple[str, ...], str]:
    """The words of a token of class, id or role for labels, and what it names: "!" something beside, "h" a header, "*" main, or ""."""
    words = [w.lower() for w in _WORDS.findall(token)]
    words = [w for w in words if not w.isdigit()]
    named = ""
    if token.lower() == "main":
        named = "*"
    elif token.lower() == "top" or any(w in BESIDE for w in words) and all(w in BESIDE or w in AROUND for w in words):
        named = "!"
    elif any(w in HEADER for w in words) and all(w in HEADER or w in AROUND for w in words) and not any(w in OWN for w in words):
        named = "h"
    return tuple(w if len(w) <= LONGEST else f"{xxh3_64_intdigest(w):016x}" for w in words), named


def _named(attributes: str) -> tuple[str, frozenset[str]]:
    """What a tag's class, id and role add to its label, and what they name (see _token)."""
    if "=" not in attributes:
        return "", frozenset()
    tokens = [_token(t) for m in _NAMED.finditer(attributes) for t in unescape(m[2] or m[3] or m[4] or "").split()]
    words = dict.fromkeys(w for ws, _ in tokens for w in ws)
    return "".join("." + w for w in words), frozenset(n for _, n in tokens if n)


def mark(tag: str, named: frozenset[str], main: bool, article: bool) -> str:
    """What an element says of its text: "#" no text of the page, "!" beside the article, "*" main, "" nothing.

    main and article: whether it lies in a main element, and in an article. Of html, body and main elements names
    don't count, but of articles within articles (comments are marked up so).
    Main elements are article, main, and those with main as a whole role, id or class.
    """
    if tag in NEVER:
        return "#"
    if tag in ("html", "body"):
        return ""
    beside = "!" in named or "h" in named and not main
    if (tag in MAIN or "*" in named and not beside) and not (beside and article):
        return "*"
    return "!" if beside or tag in REGIONS or tag == "header" and not main else ""


def tag_of(label: str) -> str:
    return label.lstrip("#!*").partition(".")[0]


@dataclass
class Standing:
    """Of each node: whether its text is never read, whether it lies in a main element, and whether its mark may put it beside.

    What holds a main element isn't beside, unless the page has another main element that nothing beside holds.
    """

    never: list[bool]
    main: list[bool]
    marked: list[bool]
    holder: list[bool]
    #: Whether a main element stands outside of all marked ones.
    free_main: bool

    def dropped(self, structure: list[tuple[int, str]], overruled=frozenset()) -> list[bool]:
        """Whether a node lies in a marked one that neither holds a main element nor is overruled."""
        out: list[bool] = []
        for i, (parent, _) in enumerate(structure):
            out.append(bool(i) and out[parent] or self.marked[i] and not self.holder[i] and i not in overruled)
        return out


def standing(structure: list[tuple[int, str]]) -> Standing:
    never, main, marked, under = [], [], [], []
    for i, (parent, label) in enumerate(structure):
        says = label[:1]
        never.append(says == "#" or bool(i) and never[parent])
        main.append(says == "*" or bool(i) and main[parent])
        marked.append(says == "!")
        under.append(says == "!" or bool(i) and under[parent])
    mains = [i for i, (_, label) in enumerate(structure) if label[:1] == "*" and not never[i]]
    free = any(not under[i] for i in mains)
    holds = [False] * len(structure)
    for i in mains:
        while not free and not holds[i]:
            holds[i] = True
            i = structure[i][0]
    return Standing(never, main, marked, [m and h for m, h in zip(marked, holds)], free)


def unmarked(structure: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The structure without the marks of names and regions: only what is never text keeps its own. Nodes stay apart."""
    return [(p, label if label[:1] == "#" else label.lstrip("!*")) for p, label in structure]


def path_hashes(structure: list[tuple[int, str]]) -> list[int]:
    """A signed 64-bit hash of the labels from the root to each node."""
    out = [0]
    for parent, label in structure[1:]:
        out.append(xxh3_64_intdigest(f"{out[parent]} {label}".encode("utf-8", "surrogatepass")) - 2**63)
    return out


def words_of(structure: list[tuple[int, str]]) -> set[str]:
    return {w for _, label in structure for w in label.split(".")[1:]}


def reduced(structure: list[tuple[int, str]], words) -> tuple[list[tuple[int, str]], list[int]]:
    """The structure with only these words in its labels, siblings that become equal being one node, and each old node's new one."""
    out, place = [structure[0]], [0]
    known: dict[tuple[int, str], int] = {}
    for parent, label in structure[1:]:
        tag, *rest = label.split(".")
        at = (place[parent], ".".join([tag, *(w for w in rest if w in words)]))
        if at not in known:
            known[at] = len(out)
            out.append(at)
        place.append(known[at])
    return out, place


def pruned(structure: list[tuple[int, str]], kept) -> list[tuple[int, str]]:
    """The structure without the nodes whose path hash isn't kept; what lies below one isn't either."""
    out, place = [structure[0]], {0: 0}
    for i, (path, (parent, label)) in enumerate(zip(path_hashes(structure), structure)):
        if i and path in kept and parent in place:
            place[i] = len(out)
            out.append((place[parent], label))
    return out


@dataclass
class Page:
    """structure: (parent, label) of each node, the root being its own parent; siblings of a label are one node.

    A label begins with its element's mark, if it has one (see mark). blocks: (node, text, characters of it in links) in
    page order, the node being the text's own block or marked element.
    """

    structure: list[tuple[int, str]] = field(default_factory=lambda: [(0, "")])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    @property
    def key(self) -> str:
        return structure_key(self.structure)


def structure_key(structure: list[tuple[int, str]]) -> str:
    return "\n".join(f"{p} {label}" for p, label in structure)


def parse_structure(key: str) -> list[tuple[int, str]]:
    return [(int(p), label) for p, _, label in (line.partition(" ") for line in key.split("\n"))]


def read_page(html: str) -> Page:
    """Reads a page as it is: unclosed and misplaced tags, raw script text and cut-off comments included."""
    page = Page()
    structure, blocks = page.structure, page.blocks
    nodes: dict[tuple[int, str], int] = {}
    known: dict[str, tuple[str, frozenset[str]]] = {}
    # (tag, node, block's node, in a main element, in an article, in a link)
    stack: list[tuple[str, int, int, bool, bool, bool]] = [("", 0, 0, False, False, False)]
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                blocks.append((stack[-1][2], text, min(linked, len(text))))
        linked = 0

    def pop_to(depth: int) -> None:
        if any(e[1] == e[2] for e in stack[depth:]):
            flush()
        del stack[depth:]

    def end_head() -> None:
        for depth in range(1, min(4, len(stack))):
            if stack[depth][0] == "head":
                pop_to(depth)
                return

    at, end = 0, len(html)
    find = _TOKEN.match
    while at < end:
        m = find(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                if stack[-1][0] == "head" and not token.isspace():
                    end_head()
                pieces.append(token)
                if stack[-1][5]:
                    linked += len(token.strip())
            continue
        tag = tag.lower()
        if len(tag) > LONGEST:
            tag = f"{xxh3_64_intdigest(tag.encode('utf-8', 'surrogatepass')):016x}"
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    pop_to(depth)
                    break
            continue
        if tag == "body" or tag not in IN_HEAD and stack[-1][0] == "head":
            end_head()
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    pop_to(depth)
                    break
                if stack[depth][0] in BLOCK:
                    break
        if tag in SIBLINGS:
            ended, bounds = SIBLINGS[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in bounds:
                    break
                if stack[depth][0] in ended:
                    pop_to(depth)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
        if tag in ("br", "hr", "wbr"):
            if tag != "wbr":
                pieces.append(" ")
            continue
        _, above, block, main, article, link = stack[-1]
        attributes = m[3]
        name, named = known.get(attributes) or known.setdefault(attributes, _named(attributes))
        says = mark(tag, named, main, article)
        label = says + tag.replace(".", "-") + name
        node = nodes.get((above, label))
        if node is None:
            node = nodes[above, label] = len(structure)
            structure.append((above, label))
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            at = close.start() if close else end
            if close:
                at = html.find(">", close.start()) + 1 or end
            continue
        if tag in BLOCK or says:
            flush()
            block = node
        stack.append((tag, node, block, main or says == "*", article or tag == "article", link or tag == "a"))
    flush()
    return page


def children_of(structure: list[tuple[int, str]]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in structure]
    for i, (parent, _) in enumerate(structure[1:], 1):
        out[parent].append(i)
    return out


def simple_tree_matching(a: list[tuple[int, str]], b: list[tuple[int, str]]) -> dict[int, int]:
    """A largest top-down matching of two ordered trees that keeps labels and the order of siblings: nodes of a to nodes of b.

    Only children of matched nodes with equal labels are matched. Such pairs are listed from the roots down; their
    sizes are found in the opposite order by the usual recurrence over prefixes of both child lists (children
    without a partner are left out) and read off top down. Nothing recurs, so trees may be deep.
    """
    if a[0][1] != b[0][1]:
        return {}
    ca, cb = children_of(a), children_of(b)
    pairs, shared = [(0, 0)], []
    for x, y in pairs:
        labels = {b[q][1] for q in cb[y]} & {a[p][1] for p in ca[x]}
        xs, ys = [p for p in ca[x] if a[p][1] in labels], [q for q in cb[y] if b[q][1] in labels]
        shared.append((xs, ys))
        pairs.extend((p, q) for p in xs for q in ys if a[p][1] == b[q][1])
    size: dict[tuple[int, int], int] = {}
    tables: dict[tuple[int, int], list[list[int]]] = {}
    for (x, y), (xs, ys) in zip(reversed(pairs), reversed(shared)):
        best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, p in enumerate(xs, 1):
            for j, q in enumerate(ys, 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + size.get((p, q), 0))
        size[x, y], tables[x, y] = 1 + best[-1][-1], best
    children = dict(zip(pairs, shared))
    out: dict[int, int] = {}
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        out[x] = y
        best, (xs, ys) = tables[x, y], children[x, y]
        i, j = len(xs), len(ys)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                todo.append((xs[i - 1], ys[j - 1]))
                i, j = i - 1, j - 1
    return out


def merged(template: list[tuple[int, str]], other: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The template with what the other tree has besides; node numbers of the template stay."""
    out, place = list(template), simple_tree_matching(other, template)
    for i, (parent, label) in enumerate(other):
        if i not in place:
            place[i] = len(out)
            out.append((place[parent], label))
    return out

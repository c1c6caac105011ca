"""Main text of web pages by wrapper induction over the pages of a host."""

from __future__ import annotations

import json
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm import dom
from termweave.llm.common import fits, passing, stored, text_of
from termweave.llm.dom import merged, parse_structure, read_page, simple_tree_matching, standing

#: A text is template if it stands at one place of a slot on this share of a host's distinct pages, and a little more:
#: on both of two pages, on all of four, on 7 of 10, on 61 of 100.
CONSTANT_SHARE, CONSTANT_MORE = 0.6, 0.8
#: Words of labels and nodes of structures that fewer of a host's pages have (and less than one page and a bit) don't help to
#: align pages. So a host has at most 20 pages' worth of words and 50 pages' worth of nodes, whatever its number of pages.
WORD_SHARE, NODE_SHARE, RARE_MORE = 0.05, 0.02, 0.8
#: A marked element isn't beside the article if it holds more than this share of a host's varying text.
MARKED_SHARE = 2 / 3
#: Main elements are all that counts on a host if they hold this share of its varying text.
MAIN_SHARE = 0.5
#: The node of a host's content holds this share of what varies; text that is links to this share is a menu outside of it.
CONTENT_SHARE, LINK_SHARE = 0.8, 0.8
#: Structures that a task merges, on average, before the merged ones are merged in turn.
MERGE = 2000
#: Parts over which the texts of a slot are dealt where they meet the slots by a shuffle.
SLOT_PARTS = 16
#: Bytes of all wrappers up to which they are broadcast, as measured; pages of a host that meet its wrapper in one task beyond.
WRAPPER_BYTES, HOST_ROWS = 16_000_000, 20_000

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST, 1))


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


SEEN = (
    "host string, structure long, key string, slot long, hash long, page long, main boolean, "
    "first long, last long, chars long, links long, own long, pages long"
)
_SEEN = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in SEEN.split(", "))])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _read(html: str, marks: bool) -> dom.Page:
    page = read_page(html)
    if not marks:
        page.structure = dom.unmarked(page.structure)
    return page


def _observe(batches, marks: bool):
    """For each page its structure (slot null), and each distinct text of each slot with its places in the slot from both ends.

    page is a hash of what the page says besides marked elements: equal for copies. own is the length of the
    distinct texts of its main elements.
    """
    for batch in batches:
        found: Counter = Counter()
        keys: dict[int, str] = {}
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
            page = _read(html.as_py(), marks)
            key = page.key
            structure = text_hash(key)
            keys[structure] = key
            stand = standing(page.structure)
            beside = stand.dropped(page.structure)
            blocks = [b for b in page.blocks if not stand.never[b[0]]]
            copy = text_hash("\n".join([t for n, t, _ in blocks if not beside[n]] or [t for _, t, _ in blocks]))
            size, first, last, links = Counter(b[0] for b in blocks), {}, {}, {}
            at: Counter = Counter()
            for n, text, link in blocks:
                first.setdefault((n, text), at[n])
                links[n, text] = link
                at[n] += 1
                last[n, text] = size[n] - at[n]
            inside = {b for b in first if stand.main[b[0]] and not beside[b[0]]}
            own = sum(len(text) for _, text in inside)
            found[host, structure, None, None, copy, None, None, None, 0, 0, own] += 1
            for b, n in first.items():
                found[host, structure, b[0], text_hash(b[1]), copy, b in inside, n, last[b], len(b[1]), links[b], own] += 1
        rows = [(h, s, keys[s] if slot is None else None, slot, *rest, n) for (h, s, slot, *rest), n in found.items()]
        yield _table(rows, _SEEN)


def _frequent(structures: DataFrame, parts_of, share: float) -> DataFrame:
    """(host, kept): the parts (words or path hashes, as text) of a host's structures that aren't rare on its pages.

    structures: (host, key, pages). A page has a part at most once, so a host keeps at most 1 / share times as
    many parts as a page has on average: a list of bounded length.
    """

    def rows(batches):
        schema = pa.schema([("host", pa.string()), ("part", pa.string()), ("pages", pa.int64())])
        for batch in batches:
            found: Counter = Counter()
            for host, key, pages in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for part in parts_of(parse_structure(key)):
                    found[host, part] += pages
            yield _table([(*k, n) for k, n in found.items()], schema)

    counts = structures.select("host", "key", "pages").mapInArrow(rows, "host string, part string, pages long")
    counts = counts.groupBy("host", "part").agg(F.sum("pages").alias("n"))
    hosts = structures.groupBy("host").agg(F.sum("pages").alias("n_pages"))
    kept = counts.join(hosts, "host").where(F.col("n") >= F.col("n_pages") * share + RARE_MORE)
    return hosts.select("host").join(kept.groupBy("host").agg(F.sort_array(F.collect_list("part")).alias("kept")), "host", "left")


def _with(rows: DataFrame, hosts: DataFrame, spread: str) -> DataFrame:
    """rows joined with a table of one row for each host: by broadcast if that one is measured to be small, else by (host, part).

    A host of more than HOST_ROWS rows (more, if the table is so large that over 100,000 hosts would be) is dealt
    over as many parts as that takes, by the hash of the column spread; its row is copied to each.
    """
    if fits(hosts, WRAPPER_BYTES):
        return rows.join(F.broadcast(hosts), "host")
    counts = stored(rows.groupBy("host").agg(F.count("*").alias("n")))
    most = max(HOST_ROWS, (counts.agg(F.sum("n")).head()[0] or 0) // 100_000)
    hot = stored(counts.where(F.col("n") > most).select("host", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    hot = F.broadcast(hot) if fits(hot, WRAPPER_BYTES) else hot
    parts = F.coalesce("parts", F.lit(1))
    left = rows.join(hot, "host", "left").withColumn("part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("parts")
    right = hosts.join(hot, "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, ["host", "part"]).drop("part")


def _simplified(batches, by_words: bool):
    """Structures with the host's frequent words only, or without its rare nodes; those that become equal are counted together."""
    schema = pa.schema([("host", pa.string()), ("key", pa.string()), ("pages", pa.int64())])
    for batch in batches:
        found: Counter = Counter()
        for host, key, pages, kept in zip(*(batch.column(i).to_pylist() for i in range(4))):
            structure = parse_structure(key)
            if by_words:
                structure = dom.reduced(structure, frozenset(kept or ()))[0]
            else:
                structure = dom.pruned(structure, {int(x) for x in kept or ()})
            found[host, dom.structure_key(structure)] += pages
        yield _table([(*k, n) for k, n in found.items()], schema)


def _simpler(structures: DataFrame, frequent: DataFrame, by_words: bool) -> DataFrame:
    rows = _with(structures.select("host", "key", "pages"), stored(frequent), "key").select("host", "key", "pages", "kept")
    rows = rows.mapInArrow(lambda b: _simplified(b, by_words), "host string, key string, pages long")
    return stored(rows.groupBy("host", "key").agg(F.sum("pages").alias("pages")))


def _merge(table: pa.Table) -> pa.Table:
    """One tree for all structures of a group, the most frequent first."""
    rows = sorted(zip(table["pages"].to_pylist(), table["key"].to_pylist()), key=lambda r: (-r[0], r[1]))
    tree = parse_structure(rows[0][1])
    for _, key in rows[1:]:
        tree = merged(tree, parse_structure(key))
    pages = pa.array([sum(r[0] for r in rows)], pa.int64())
    return pa.table({"host": pa.array([table["host"][0].as_py()], pa.string()), "key": [dom.structure_key(tree)], "pages": pages})


def _trees(structures: DataFrame) -> DataFrame:
    """(host, tree): structures of a host are merged in groups of MERGE on average, and the merged ones again, until one is left."""
    while True:
        counts = stored(structures.groupBy("host").agg(F.count("*").alias("n")))
        if not counts.where("n > 1").take(1):
            return structures.select("host", F.col("key").alias("tree"))
        groups = counts.select("host", F.ceil(F.col("n") / MERGE).alias("groups"))
        dealt = structures.join(groups, "host").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("groups")))
        structures = stored(dealt.drop("groups").groupBy("host", "salt").applyInArrow(lambda t: _merge(t), "host string, key string, pages long"))


@lru_cache(maxsize=500)
def _tree(key: str) -> tuple[list[tuple[int, str]], frozenset[str]]:
    tree = parse_structure(key)
    return tree, frozenset(dom.words_of(tree))


def align(structure: list[tuple[int, str]], tree: str) -> list[int]:
    """Of each node of a structure the node of the host's tree that it matches, or -1. Words that the tree doesn't have don't count."""
    nodes, words = _tree(tree)
    simpler, place = dom.reduced(structure, words)
    match = simple_tree_matching(simpler, nodes)
    return [match.get(p, -1) for p in place]


def _aligned(batches):
    """(host, structure, slot, node): for each structure and each of its slots, the node of the host's tree that it matches."""
    schema = pa.schema([("host", pa.string()), ("structure", pa.int64()), ("slot", pa.int64()), ("node", pa.int64())])
    for batch in batches:
        out = []
        for host, structure, key, tree in zip(*(batch.column(i).to_pylist() for i in range(4))):
            out += [(host, structure, slot, node) for slot, node in enumerate(align(parse_structure(key), tree)) if node >= 0]
        yield _table(out, schema)


def _slotted(texts: DataFrame, slots: DataFrame) -> DataFrame:
    """texts with the node of the host's tree. A slot that most of the texts are in is dealt over SLOT_PARTS parts by their hash."""
    at = ["host", "structure", "slot"]
    if fits(slots):
        return texts.join(F.broadcast(slots), at)
    parts = F.explode(F.sequence(F.lit(0), F.lit(SLOT_PARTS - 1)))
    dealt = texts.withColumn("part", F.pmod("hash", F.lit(SLOT_PARTS)).cast("int"))
    return dealt.join(slots.withColumn("part", parts), [*at, "part"]).drop("part")


def _below(tree: list[tuple[int, str]], own: dict[int, int]) -> list[int]:
    """Sums over each node and all below it."""
    out = [own.get(i, 0) for i in range(len(tree))]
    for i in range(len(tree) - 1, 0, -1):
        out[tree[i][0]] += out[i]
    return out


def judge(tree: list[tuple[int, str]], mass: list[dict]) -> dict:
    """What the varying text of the nodes of a host's tree says of them.

    mass, by node: chars that vary, those of them in links, how often texts were seen there (times) and how many of
    these times the same text stood on another page, too (again).

    overruled: marked nodes that aren't beside the article, as they hold over MARKED_SHARE of what varies and are no
    list of links; unless another main element stands free, or, but for forms, other text that varies.
    main: whether main elements are all that counts, holding MAIN_SHARE of what isn't beside.
    outside: nodes outside of main elements and of the content node whose varying text is links, where most of the
    host's isn't, or is taken in turn from some texts (adverts, menus): it is found again elsewhere as constants are.
    The content node is the lowest one that holds CONTENT_SHARE of the text besides links, above elements that
    hold text only.
    """
    stand = standing(tree)
    mass = [m for m in mass if not stand.never[m["node"]]]
    chars, links = ({m["node"]: max(0, m[k]) for m in mass} for k in ("chars", "links"))
    total, below, links_below = sum(chars.values()), _below(tree, chars), _below(tree, links)
    dropped = stand.dropped(tree)
    free = any(n > 0 and not dropped[i] for i, n in chars.items())
    overruled = []
    for i, (_, label) in enumerate(tree):
        if stand.marked[i] and below[i] > MARKED_SHARE * total and 2 * links_below[i] < below[i]:
            whole = stand.holder[i] or stand.main[i] or not stand.free_main
            if whole and (not free or dom.tag_of(label) == "form"):
                overruled.append(i)
    dropped = stand.dropped(tree, frozenset(overruled))
    kept = {i: n for i, n in chars.items() if not dropped[i]}
    main = sum(n for i, n in kept.items() if stand.main[i])
    plain = _below(tree, {i: max(0, n - links.get(i, 0)) for i, n in kept.items()})
    children, content = dom.children_of(tree), 0
    while True:
        lower = [c for c in children[content] if plain[c] >= CONTENT_SHARE * plain[0] and dom.tag_of(tree[c][1]) not in dom.TEXT]
        if not lower:
            break
        content = lower[0]
    within = [False] * len(tree)
    for i, (parent, _) in enumerate(tree):
        within[i] = i == content or stand.main[i] or bool(i) and within[parent]
    prose = 2 * plain[0] >= sum(kept.values())
    outside = []
    for m in mass:
        i = m["node"]
        menu = prose and 0 < links[i] >= LINK_SHARE * chars[i] and dom.tag_of(tree[i][1]) not in dom.HEADINGS
        if not within[i] and (menu or m["again"] >= CONSTANT_SHARE * m["times"] + CONSTANT_MORE):
            outside.append(i)
    return {"overruled": overruled, "main": main > 0 and main >= MAIN_SHARE * sum(kept.values()), "outside": sorted(outside)}


def _wrappers(batches):
    schema = pa.schema([("host", pa.string()), ("wrapper", pa.string())])
    for batch in batches:
        out = []
        for host, tree, mass, constants in zip(*(batch.column(i).to_pylist() for i in range(4))):
            fixed = sorted([c["node"], c["hash"]] for c in constants or [])
            out.append((host, json.dumps({"tree": tree, "constants": fixed} | judge(parse_structure(tree), mass or []))))
        yield _table(out, schema)


def induce(pages: DataFrame, marks: bool = True) -> DataFrame:
    """(host, wrapper) from pages (host, html): the tree, the constant texts of its slots, and what judge() says of its nodes.

    Labels lose the words, and structures the nodes, that are rare among the host's pages; the distinct structures
    that are left are merged into one tree, in rounds of groups. Texts are counted as hashes by slot over all
    pages, copies once. What the main elements of pages share is template only if it is on the pages that share
    half of their main elements' text at most: pages that share more are near copies.

    A host's wrapper is one row. Its tree has at most 50 pages' worth of nodes (see NODE_SHARE), its constants are at
    most 1 / CONSTANT_SHARE pages' worth of texts, as hashes: it grows with the host's average page, not with their number.
    """
    with passing(pages.sparkSession) as keep:
        return keep(_induced(pages, marks))


def _induced(pages: DataFrame, marks: bool) -> DataFrame:
    seen = stored(pages.mapInArrow(lambda b: _observe(b, marks), SEEN))
    raw = stored(seen.where("key is not null").groupBy("host", "structure", "key").agg(F.sum("pages").alias("pages")))
    simple = _simpler(raw, _frequent(raw, lambda s: dom.words_of(s), WORD_SHARE), True)
    simple = _simpler(simple, _frequent(simple, lambda s: {str(p) for p in dom.path_hashes(s)}, NODE_SHARE), False)
    trees = stored(_trees(simple))
    slots = _with(raw.select("host", "structure", "key"), trees, "structure").select("host", "structure", "key", "tree")
    slots = stored(slots.mapInArrow(_aligned, "host string, structure long, slot long, node long"))

    texts = seen.where("hash is not null")
    often = F.col("n") >= CONSTANT_SHARE * F.col("n_pages") + CONSTANT_MORE
    place = ["host", "node", "hash"]

    def placed(at: DataFrame, n_pages: DataFrame) -> DataFrame:
        """The texts that are at one place of their slot, from its start or its end, on enough pages."""
        ends = [at.groupBy(*place, F.col(end).alias("end")).agg(F.count("*").alias("n")) for end in ("first", "last")]
        most = ends[0].unionByName(ends[1]).groupBy(*place).agg(F.max("n").alias("n"))
        return most.join(n_pages, "host").where(often).select(*place)

    n_pages = stored(seen.where("key is not null").groupBy("host").agg(F.countDistinct("page").alias("n_pages")))
    frequent = texts.groupBy("host", "hash").agg(F.sum("pages").alias("n")).join(n_pages, "host").where(often).select("host", "hash")
    frequent = stored(frequent)
    frequent = F.broadcast(frequent) if fits(frequent, WRAPPER_BYTES) else frequent
    at = _slotted(texts.join(frequent, ["host", "hash"]), slots).groupBy(*place, "page").agg(
        F.max("main").alias("main"), F.min("first").alias("first"), F.min("last").alias("last"), F.max("chars").alias("chars"),
        F.max("own").alias("own"), F.sum(F.col("chars") * F.col("pages")).alias("mass"), F.sum(F.col("links") * F.col("pages")).alias("links"),
    )
    at = stored(at)
    at = stored(at.join(placed(at, n_pages), place))
    shared = at.where("main").groupBy("host", "page").agg(F.sum("chars").alias("shared"), F.max("own").alias("own"))
    near = stored(shared.where(F.col("shared") * 2 > F.col("own")).select("host", "page"))
    n_near = near.groupBy("host").agg(F.count("*").alias("near"))
    n_others = n_pages.join(n_near, "host", "left").select("host", (F.col("n_pages") - F.coalesce("near", F.lit(0))).alias("n_pages"))
    inside = placed(at.where("main").join(near, ["host", "page"], "left_anti"), n_others)
    sums = at.groupBy(*place).agg(F.max("main").alias("main"), F.sum("mass").alias("chars"), F.sum("links").alias("links"))
    constants = sums.join(inside.withColumn("shared", F.lit(True)), place, "left").where(~F.col("main") | F.col("shared"))
    constants = stored(constants.select(*place, "chars", "links"))

    pages_ = F.col("pages")
    by_text = _slotted(texts, slots).groupBy(*place).agg(
        F.sum(F.col("chars") * pages_).alias("chars"), F.sum(F.col("links") * pages_).alias("links"),
        F.sum("pages").alias("times"), (F.min("page") < F.max("page")).alias("elsewhere"),
    )
    again = F.when(F.col("elsewhere"), F.col("times")).otherwise(0)
    mass = by_text.select("host", "node", "chars", "links", "times", again.alias("again"))
    less = constants.select("host", "node", (-F.col("chars")).alias("chars"), (-F.col("links")).alias("links"), F.lit(0).alias("times"), F.lit(0).alias("again"))
    sums = [F.sum(c).alias(c) for c in ("chars", "links", "times", "again")]
    mass = mass.unionByName(less).groupBy("host", "node").agg(*sums)
    mass = mass.groupBy("host").agg(F.collect_list(F.struct("node", "chars", "links", "times", "again")).alias("mass"))
    fixed = constants.groupBy("host").agg(F.collect_list(F.struct("node", "hash")).alias("constants"))
    joined = trees.join(mass, "host", "left").join(fixed, "host", "left").select("host", "tree", "mass", "constants")
    return stored(joined.mapInArrow(_wrappers, "host string, wrapper string"))


class _Reader:
    """Applies wrappers; what was found out of a wrapper or of a structure is remembered, as far as memory is meant to go."""

    def __init__(self, marks: bool):
        self.marks = marks
        self.wrappers: dict[str, tuple] = {}
        self.alignments: dict[tuple[str, str], tuple[list[int], list[bool], list[bool]]] = {}

    def _wrapper(self, wrapper: str) -> tuple:
        if wrapper not in self.wrappers:
            if len(self.wrappers) > 500:
                self.wrappers.clear()
            raw = json.loads(wrapper)
            self.wrappers[wrapper] = raw["tree"], {tuple(c) for c in raw["constants"]}, set(raw["overruled"]), raw["main"], set(raw["outside"])
        return self.wrappers[wrapper]

    def _nodes(self, wrapper: str, page: dom.Page) -> tuple[list[int], list[bool], list[bool]]:
        """Of each node of a page: its place in the tree, whether it is dropped, whether it is in a main element."""
        known = (wrapper, page.key)
        if known not in self.alignments:
            if len(self.alignments) > 5000:
                self.alignments.clear()
            tree, _, overruled, _, outside = self._wrapper(wrapper)
            place, stand = align(page.structure, tree), standing(page.structure)
            dropped = stand.dropped(page.structure, frozenset(i for i, p in enumerate(place) if p in overruled))
            gone = [n or d or p in outside for n, d, p in zip(stand.never, dropped, place)]
            self.alignments[known] = place, gone, stand.main
        return self.alignments[known]

    def text(self, html: str, wrapper: str) -> str:
        page = _read(html, self.marks)
        place, gone, main = self._nodes(wrapper, page)
        _, constants, _, only_main, _ = self._wrapper(wrapper)
        blocks = [b for b in page.blocks if not gone[b[0]]]
        own = [b for b in blocks if (place[b[0]], text_hash(b[1])) not in constants]
        inside = [b for b in own if main[b[0]]]
        if not own:
            own = [b for b in blocks if main[b[0]]]
        elif only_main and inside:
            own = inside
        return " ".join(text for _, text, _ in own)


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", marks: bool = True) -> DataFrame:
    """page_id, url, text, n_chars (code points) of the main text of every page.

    A wrapper is induced for each host from all of its pages. A page's text is what is left of its blocks, in order, after
    those that are the host's template: the same text at the same place of a slot on most of its distinct pages (see
    CONSTANT_SHARE; the rule is one for all hosts, and one page alone has no template). Near copies of an article don't
    make it template. Then go, outside of the host's content node, blocks of slots that are lists of links or that are filled from
    a stock of texts (see judge), and, if main elements hold half of the host's varying text, what is outside of them.

    What varies and still isn't the article (reader comments, adverts, related stories) can't be told by alignment alone.
    There tags (nav, aside, footer, form, header) and names (a class, id or role made of such words only) are heard; the
    host's slots overrule them where they hold most of what varies, or hold the main element. marks=False hears
    neither tags nor names and lets alignment decide alone. On a host of one page they are all there is.

    A page of nothing but template texts has those of its main elements, if any. Null html is empty and has the text "". Null,
    relative or odd URLs share the host "". Very long pages and deep nesting are read whole. Repeated rows repeat and
    count once as evidence; other columns aren't looked at; an empty table gives an empty one.
    """
    rows = df.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), text_of(html).alias("html"), host_of(url).alias("host"))
    wrappers = induce(rows.select("host", "html"), marks)

    def read(batches):
        reader = _Reader(marks)
        for batch in batches:
            texts = [reader.text(h.as_py(), w) for h, w in zip(batch.column(2), batch.column(3).to_pylist())]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    met = _with(rows, wrappers, "html").select("page_id", "url", "html", "wrapper")
    return met.mapInArrow(read, "page_id long, url string, text string, n_chars long")

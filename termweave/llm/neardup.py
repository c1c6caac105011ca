"""MinHash near-duplicates by a multi-index Hamming join, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.llm.common import join_spread, passing, small, stored, text_of
from termweave.llm.graph import components

#: Tasks over which groups with the same least member are dealt.
LEAD_TASKS = 2
#: Members of a large group with which all others are compared, and rows of one that a task compares at once.
PIVOTS, BLOCK = 8, 2048

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass(frozen=True)
class Index:
    """A signature of chunks * width symbols of 16 bits, and how it is looked up.

    The distance of two signatures is the number of symbols in which they differ. Two within the radius differ in at
    most `errors` symbols of some chunk (pigeonhole: radius < chunks * (errors + 1)). So each chunk is entered once for
    each way to leave `errors` of its symbols out, and equal entries find every pair within the radius, guaranteed.
    Candidates are the pairs within the radius and no others (but for symbols taken for equal by chance, below). A symbol
    of two documents is equal with probability of their Jaccard similarity at least: at 0.8, 20 of 100 symbols differ on
    average, and more than 39 do with probability 3.6e-6.
    """

    chunks: int = 20
    width: int = 5
    errors: int = 1
    seed: int = 9

    @property
    def symbols(self) -> int:
        return self.chunks * self.width

    @property
    def entries(self) -> int:
        return self.chunks * comb(self.width, self.errors)

    @property
    def radius(self) -> int:
        return self.chunks * (self.errors + 1) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """Words between the six ASCII white-space characters, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles; of the whole sequence, if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _MIX[0] + h[i : len(h) - k + 1 + i]
    return np.unique(_mixed(out))


def _permutations(index: Index) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(index.seed)
    a, b = (rng.integers(0, 2**63, (index.symbols, 1), dtype=np.uint64) for _ in "ab")
    return a * np.uint64(2) + np.uint64(1), b


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 4096):
        np.minimum(low, (hashes[at : at + 4096] * a + b).min(axis=1), out=low)
    return (_mixed(low) >> np.uint64(48)).astype("<u2")


def _node(hashes: np.ndarray) -> str | None:
    """A 128-bit name of a set of shingles; null if it is empty."""
    return xxhash.xxh3_128_hexdigest(hashes.astype("<u8").tobytes()) if len(hashes) else None


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _sketch(batches, n: int, index: Index):
    a, b = _permutations(index)
    for batch in batches:
        counts, nodes, signatures = [], [], []
        for text in batch.column(1):
            words = words_of(text.as_py())
            s = shingles(words, n)
            counts.append(len(s))
            nodes.append(_node(s))
            signatures.append(signature(s, a, b).tobytes() if words else None)
        yield _batch({"doc_id": batch.column(0), "n_shingles": pa.array(counts, pa.int64()), "node": pa.array(nodes, pa.string()), "signature": pa.array(signatures, pa.binary())})


def _entries(batches, index: Index):
    """(entry, node) for every chunk and every choice of symbols left out."""
    from itertools import combinations

    odd = np.random.default_rng(index.seed + 1).integers(0, 2**63, index.width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    choices = list(combinations(range(index.width), index.width - index.errors))
    for batch in batches:
        if not len(batch):
            continue
        nodes = batch.column(0).to_numpy()
        symbols = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(len(nodes), index.chunks, index.width).astype(np.uint64)
        for c in range(index.chunks):
            for i, choice in enumerate(choices):
                key = np.full(len(nodes), np.uint64(1 + c * len(choices) + i))
                for j in choice:
                    key = _mixed(key * _MIX[0] + symbols[:, c, j] * odd[j])
                yield _batch({"entry": pa.array(key.view(np.int64)), "node": pa.array(nodes)})


class _Forest:
    """The groups that links make of the nodes of a task, of MOST_NODES at once: more are handed on in parts."""

    MOST_NODES = 300_000

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)

    def stars(self):
        """Links of each node to the least node of its tree: tasks that see the same group mostly name the same links."""
        nodes = [x for x in self.up if self.root(x) != x]
        for at in range(0, len(nodes), 50_000):
            part = nodes[at : at + 50_000]
            yield _batch({"a": pa.array([self.root(x) for x in part], pa.int64()), "b": pa.array(part, pa.int64())})

    def full(self):
        """stars(), and a new start, if there are too many nodes."""
        if len(self.up) > self.MOST_NODES:
            yield from self.stars()
            self.up = {}


def _groups(batches, by: int):
    """Tables of whole groups (equal in the first `by` columns) from a sorted stream; a group may span batches."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not len(table):
            continue
        keys = np.column_stack([table.column(i).to_numpy() for i in range(by)])
        last = len(keys) - int(np.argmax((keys[::-1] != keys[-1]).any(axis=1))) if (keys != keys[-1]).any() else 0
        if last:
            yield table.slice(0, last), keys[:last]
        held = table.slice(last).combine_chunks()
    if held is not None and len(held):
        yield held, np.column_stack([held.column(i).to_numpy() for i in range(by)])


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a[i] and b[i] for all i; every node's parent is the least node of its tree, before and after."""
    while len(a):
        differ = parent[a] != parent[b]
        a, b = a[differ], b[differ]
        np.minimum.at(parent, np.maximum(parent[a], parent[b]), np.minimum(parent[a], parent[b]))
        while ((further := parent[parent]) != parent).any():
            parent[:] = further


def _near(batches, radius: int):
    """Links between nodes of a bucket whose signatures differ in at most radius symbols: emitted as stars over the groups that they make."""
    forest = _Forest()
    for table, keys in _groups(batches, 3):
        nodes = table.column(3).to_numpy()
        bytes_ = np.frombuffer(b"".join(table.column(4).to_pylist()), np.uint8).reshape(len(nodes), -1)
        number = np.cumsum(np.r_[0, (keys[1:] != keys[:-1]).any(axis=1)])
        names, place = np.unique(nodes, return_inverse=True)
        parent = np.arange(len(names))
        for d in range(1, int(np.bincount(number).max())):
            at = np.flatnonzero((number[:-d] == number[d:]) & (parent[place[:-d]] != parent[place[d:]]))
            for part in np.array_split(at, max(1, len(at) // 50_000)):
                close = part[np.count_nonzero(bytes_[part] != bytes_[part + d], axis=1) <= radius]
                _unite(parent, place[close], place[close + d])
        for x in np.flatnonzero(parent != np.arange(len(names))).tolist():
            forest.join(int(names[x]), int(names[parent[x]]))
        yield from forest.full()
    yield from forest.stars()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections. Hashes that one set alone holds are left out, those in all sets are counted once."""
    m = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    which = np.cumsum(new) - 1
    n = np.bincount(which)
    everywhere = int(np.count_nonzero(n == m)) if m > 1 else 0
    keep = (n > 1) & (n < m)
    place = np.cumsum(keep) - 1
    mine = keep[which]
    columns, owner = place[which[mine]], owner[mine]
    out = np.full((m, m), everywhere, np.int64)
    for at in range(0, int(keep.sum()), 4096):
        chunk = (columns >= at) & (columns < at + 4096)
        bits = np.zeros((m, 4096), np.float32)
        bits[owner[chunk], columns[chunk] - at] = 1
        out += np.rint(bits @ bits.T).astype(np.int64)
    return out


def _confirm(batches, percent: int):
    """Links with percent * union <= 100 * intersection on the full sets: emitted as stars over the groups that they make."""
    forest = _Forest()
    for table, keys in _groups(batches, 3):
        ends = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        nodes = table.column(3).to_pylist()
        column = table.column(4)
        for first, last in zip(ends, ends[1:]):
            sets = [np.frombuffer(x.as_py(), "<u8") for x in column.slice(first, last - first)]
            sizes = np.array([len(s) for s in sets])
            inter = overlaps(sets)
            np.fill_diagonal(inter, 0)
            linked = 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)
            parent = np.arange(len(sets))
            _unite(parent, *np.nonzero(np.triu(linked, 1)))
            for x in np.flatnonzero(parent != np.arange(len(sets))).tolist():
                forest.join(nodes[first + x], nodes[first + int(parent[x])])
        yield from forest.full()
    yield from forest.stars()


def _sets(batches, n: int):
    for batch in batches:
        nodes, sets = [], []
        for text in batch.column(0):
            found = shingles(words_of(text.as_py()), n)
            if len(found):
                nodes.append(_node(found))
                sets.append(found.astype("<u8").tobytes())
        yield _batch({"node": pa.array(nodes, pa.string()), "shingles": pa.array(sets, pa.binary())})


@dataclass(frozen=True)
class Metric:
    """How payloads are compared: a distance that keeps to the triangle inequality, up to which of it two are linked, and in bulk.

    Groups of up to `whole` members meet in blocks of `block`, each two blocks once; larger ones by way of pivots.
    """

    distances: Callable[[list[bytes], list[bytes]], np.ndarray]
    limit: float
    links: Callable
    whole: int
    block: int


def _symbols_differ(rows: list[bytes], pivots: list[bytes]) -> np.ndarray:
    a, b = (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) for x in (rows, pivots))
    return np.column_stack([np.count_nonzero(a != p, axis=1) for p in b]).astype(np.float64)


def _jaccard_distances(rows: list[bytes], pivots: list[bytes]) -> np.ndarray:
    """1 - intersection / union of sorted sets of hashes."""
    out, sets = np.zeros((len(rows), len(pivots))), [np.frombuffer(p, "<u8") for p in pivots]
    for i, row in enumerate(rows):
        mine = np.frombuffer(row, "<u8")
        for j, other in enumerate(sets):
            at = np.minimum(np.searchsorted(other, mine), len(other) - 1)
            both = int(np.count_nonzero(other[at] == mine))
            out[i, j] = 1 - both / (len(mine) + len(other) - both)
    return out


def _meetings(rows: DataFrame, metric: Metric) -> DataFrame:
    """(grp, i, j, node, payload): splits groups of n members into blocks and brings each two blocks of a group together once, sorted.

    Groups with the same least member (lead) meet in the same LEAD_TASKS tasks: near copies are in many groups together, and a
    task names their links once.
    """
    met = rows.withColumn("blocks", F.ceil(F.col("n") / metric.block).cast("int"))
    met = met.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("grp", F.least("mine", "other").cast("long").alias("i"), F.greatest("mine", "other").cast("long").alias("j"), "node", "payload", "lead")
    met = met.repartition("lead", F.pmod(F.xxhash64("grp", "i", "j"), F.lit(LEAD_TASKS))).sortWithinPartitions("grp", "i", "j")
    return met.select("grp", "i", "j", "node", "payload")


def _to_pivots(rows: pa.Table, pivots: pa.Table, metric: Metric) -> pa.Table:
    """Of each row its distance to each pivot of its group (far beyond any for a place without one), and the pivots it is linked to."""
    schema = pa.schema([("grp", pa.int64()), ("node", pa.int64()), ("far", pa.list_(pa.float64())), ("met", pa.list_(pa.int64()))])
    if not len(rows) or not len(pivots):
        return schema.empty_table()
    pivots = pivots.sort_by("slot")
    names = pivots["pivot"].to_numpy()
    far = metric.distances(rows["payload"].to_pylist(), pivots["held"].to_pylist())
    met = [names[np.flatnonzero(x <= metric.limit + 1e-9)].tolist() for x in far]
    padded = np.zeros((len(far), PIVOTS))
    padded[:, : far.shape[1]] = far
    return pa.table([rows["grp"], rows["node"], pa.array(padded.tolist(), pa.list_(pa.float64())), pa.array(met, pa.list_(pa.int64()))], schema=schema)


def _linked(rows: DataFrame, sizes: DataFrame, metric: Metric) -> DataFrame:
    """Links (a, b) among the members of each group, as stars: rows (grp, node, payload), a node once in a group; sizes (grp, n, lead), stored,
    lead being the least node.

    The components that the links make are those of all pairs within metric.limit. Small groups meet as a whole. A
    large one is compared with PIVOTS of its members, chosen by hash, in as many tasks as it takes; what is within the
    limit of one pivot is one cluster and needn't meet. The rest, and clusters among each other, meet in blocks
    of alike distances from the pivots, and by the triangle inequality only those blocks meet whose distances from
    every pivot leave room for a link. So a group of near copies is walked through once, and the rows that meet
    grow with the pairs that only their sets can tell apart.
    """
    n_rows = sizes.agg(F.sum("n")).head()[0] or 0
    rows = join_spread(rows, sizes, "grp", "node", n_rows, counts=sizes.select("grp", "n"))
    links = [_meetings(rows.where(F.col("n") <= metric.whole), metric).mapInArrow(metric.links, "a long, b long")]
    if not sizes.where(F.col("n") > metric.whole).take(1):
        return links[0]
    large = stored(rows.where(F.col("n") > metric.whole))
    slot = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(PIVOTS)).cast("int").alias("slot")
    chosen = large.groupBy("grp", slot).agg(F.min_by(F.struct("node", "payload"), F.xxhash64("node", F.lit(4))).alias("p"))
    chosen = stored(chosen.select("grp", "slot", F.col("p.node").alias("pivot"), F.col("p.payload").alias("held")))
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = large.select("grp", F.pmod(F.xxhash64("node", F.lit(5)), parts).cast("int").alias("part"), "node", "payload")
    sent = chosen.join(sizes.select("grp", "n"), "grp").select("grp", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "slot", "pivot", "held")
    far = dealt.groupBy("grp", "part").cogroup(sent.groupBy("grp", "part"))
    far = stored(far.applyInArrow(lambda r, p: _to_pivots(r, p, metric), "grp long, node long, far array<double>, met array<long>"))

    first = F.col("met")[0]
    links.append(far.where(F.size("met") > 0).select(first.alias("a"), F.col("node").alias("b")))
    between = stored(far.where(F.size("met") > 1).select(first.alias("a"), F.explode("met").alias("b")).distinct())
    links.append(between)
    clusters = components(between).select(F.col("node").alias("pivot"), "label")
    placed = join_spread(far.withColumn("pivot", F.get("met", F.lit(0))), clusters, "pivot", "node", n_rows, "left")
    placed = placed.select("grp", "node", "far", F.coalesce("label", "pivot").alias("cluster"))
    # Groups that are one cluster are done.
    open_ = placed.groupBy("grp").agg(F.min("cluster").alias("x"), F.max("cluster").alias("y"), F.count_if(F.col("cluster").isNull()).alias("loose"))
    open_ = stored(open_.where("loose > 0 or x < y").select("grp"))
    placed = join_spread(placed, open_, "grp", "node", n_rows, counts=sizes.select("grp", "n"))

    nearest = F.array_min("far")
    ring = F.floor(nearest / metric.limit * 4)
    cell = F.xxhash64("grp", F.coalesce("cluster", F.lit(-1)), F.array_position("far", nearest), ring).alias("cell")
    placed = stored(placed.select("grp", "cluster", "node", "far", cell))
    in_cell = stored(placed.groupBy("cell").agg(F.count("*").alias("n")))
    placed = join_spread(placed, in_cell, "cell", "node", n_rows, counts=in_cell)
    block = F.xxhash64("cell", F.pmod(F.xxhash64("node", F.lit(6)), F.ceil(F.col("n") / BLOCK))).alias("block")
    placed = stored(placed.select("grp", "cluster", "node", "far", block))
    ends = [f(F.col("far")[i]).alias(f"{name}{i}") for i in range(PIVOTS) for name, f in (("lo", F.min), ("hi", F.max))]
    blocks = stored(placed.groupBy("grp", "block", "cluster").agg(*ends))
    x, y = blocks.alias("x"), blocks.alias("y")
    room = F.lit(True)
    for i in range(PIVOTS):
        for p, q in (("x", "y"), ("y", "x")):
            room = room & (F.col(f"{p}.lo{i}") - F.col(f"{q}.hi{i}") <= metric.limit + 1e-9)
    apart = F.coalesce(F.col("x.cluster") != F.col("y.cluster"), F.lit(True))
    pairs = x.join(y, (F.col("x.grp") == F.col("y.grp")) & (F.col("x.block") <= F.col("y.block")) & apart & room)
    pairs = stored(pairs.select(F.col("x.grp").alias("grp"), F.col("x.block").alias("i"), F.col("y.block").alias("j")).distinct())
    members = pairs.select("grp", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    met = placed.select("grp", "block", "node").join(members, ["grp", "block"]).select("grp", "i", "j", "node")
    met = met.join(large.select("grp", "node", "payload"), ["grp", "node"]).select("grp", "i", "j", "node", "payload")
    met = met.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    links.append(met.mapInArrow(metric.links, "a long, b long"))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def with_set(df: DataFrame, column: str, n: int = 5, text: str = "text") -> DataFrame:
    """df with the 128-bit name of each text's set of shingles (null without any) in a new column."""

    def rows(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            names = pa.array([_node(shingles(words_of(t.as_py() or ""), n)) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, names], names=[*batch.schema.names, column])

    return df.mapInArrow(rows, T.StructType([*df.schema.fields, T.StructField(column, T.StringType())]))


def near_duplicates(
    df: DataFrame, n: int = 5, percent: int = 80, index: Index = Index(), key: str = "doc_id", text: str = "text", with_sets: bool = False
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id is component_id).

    Two documents are linked if 100 * intersection >= percent * union of their sets of n-word shingles. Equal sets are
    one node. Signatures find candidates (see Index); whole sets, recomputed from whole texts, decide. A task emits its
    links as stars, one link for each node beyond the first of a group, which leaves components as they are (see _linked).

    Shingles are named by 64-bit hashes, sets by 128-bit ones. Null and blank texts have no shingles and are linked with
    nothing, not even each other; texts shorter than n words are one shingle; very long texts are read whole; repeated
    rows are linked; a null key is never the smallest unless a component has no other, and its rows are then kept; other
    columns aren't looked at; an empty table gives an empty one.

    with_sets: adds set, the 128-bit name of the row's set (null without shingles), and leads, whether that is the set of
    the row that names the component (of several such sets the least).
    """
    texts = df.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    with passing(df.sparkSession) as keep:
        sketches = keep(stored(texts.mapInArrow(lambda b: _sketch(b, n, index), "doc_id long, n_shingles long, node string, signature binary")))
        classes = sketches.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("signature").alias("signature"))
        # Short names, fixed once they are written.
        classes = stored(classes.withColumn("id", F.monotonically_increasing_id()))

        entries = classes.select("id", "signature").mapInArrow(lambda b: _entries(b, index), "entry long, node long")
        shared = entries.groupBy("entry").agg(F.count("*").alias("n"), F.min("node").alias("lead")).where("n > 1")
        shared = stored(shared)
        n_entries = classes.count() * index.entries
        members = stored(join_spread(entries, shared, "entry", "node", n_entries, counts=shared.select("entry", "n")).select("entry", "node"))
        # Of a symbol its low byte: other symbols are taken for equal once in 256 times, which only adds candidates.
        low_bytes = F.expr(f"concat({', '.join(f'substring(signature, {2 * i + 1}, 1)' for i in range(index.symbols))})")
        members = members.join(classes.select(F.col("id").alias("node"), low_bytes.alias("payload")), "node").withColumnRenamed("entry", "grp")
        alike = Metric(_symbols_differ, index.radius, lambda b: _near(b, index.radius), 4096, 2048)
        groups = components(_linked(members, shared.withColumnRenamed("entry", "grp"), alike))

        wanted = stored(groups.join(classes.select(F.col("id"), "node", "first"), F.col("id") == groups["node"]).select("label", "id", classes["node"], "first"))
        ids = small(stored(wanted.groupBy("first").agg(F.count("*").alias("n")).select(F.col("first").alias("wanted_id"))))
        whole = texts.join(ids, texts.doc_id.eqNullSafe(F.col("wanted_id")), "left_semi").select("text").mapInArrow(lambda b: _sets(b, n), "node string, shingles binary")
        whole = whole.groupBy("node").agg(F.min("shingles").alias("payload")).join(wanted.select("node", "label", "id"), "node")
        whole = stored(whole.select(F.col("label").alias("grp"), F.col("id").alias("node"), "payload"))
        confirmed = Metric(_jaccard_distances, 1 - percent / 100, lambda b: _confirm(b, percent), 512, 256)
        sizes = stored(whole.groupBy("grp").agg(F.count("*").alias("n"), F.min("node").alias("lead")).where("n > 1"))
        found = components(_linked(whole, sizes, confirmed)).select(F.col("node").alias("id"), F.col("label").alias("component"))

        lowest = keep(stored(classes.select("id", "node", "first").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))))
    names = lowest.groupBy("component").agg(F.min("first").alias("component_id"), F.min_by("node", F.struct(F.col("first").isNull(), "first", "node")).alias("leader"))
    named = lowest.join(names, "component").select("node", "component_id", (F.col("node") == F.col("leader")).alias("leads"))
    out = sketches.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), F.col("node").alias("set"), "leads")
    return out if with_sets else out.drop("set", "leads")

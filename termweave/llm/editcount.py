"""Edit-aware token counts: a tree over each document's pre-tokens, kept in a column, of which edits re-encode only a part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.llm.common import text_of
from termweave.llm.tokens import Counter

#: Pre-tokens that a leaf of a tree holds at most, and characters that a pre-token's end may look ahead.
BLOCK, LOOKAHEAD = 128, 3
#: The narrowest numbers that hold all of a tree's are written; the first byte says which.
WIDTHS = {1: "<u1", 2: "<u2", 4: "<u4"}


class Node:
    """A leaf with a block of pre-tokens (rows of characters, tokens), or two subtrees; with the sums of what is below."""

    __slots__ = ("left", "right", "block", "height", "chars", "tokens", "count")

    def __init__(self, left: Node | None = None, right: Node | None = None, block: np.ndarray | None = None):
        self.left, self.right, self.block = left, right, block
        if block is not None:
            self.height, self.count = 0, len(block)
            self.chars, self.tokens = (int(x) for x in block.sum(axis=0))
        else:
            self.height, self.count = 1 + max(left.height, right.height), left.count + right.count
            self.chars, self.tokens = left.chars + right.chars, left.tokens + right.tokens


Tree = Node | None


def _balanced(left: Node, right: Node) -> Node:
    """A node over two trees whose heights differ by two at most, rotated if they do."""
    if left.height > right.height + 1:
        if left.left.height < left.right.height:
            left = Node(Node(left.left, left.right.left), left.right.right)
        return Node(left.left, Node(left.right, right))
    if right.height > left.height + 1:
        if right.right.height < right.left.height:
            right = Node(right.left.left, Node(right.left.right, right.right))
        return Node(Node(left, right.left), right.right)
    return Node(left, right)


def join(left: Tree, right: Tree) -> Tree:
    """One tree with the pre-tokens of both, in time of the difference of their heights."""
    if left is None or right is None:
        return left or right
    if left.block is not None and right.block is not None and left.count + right.count <= BLOCK:
        return Node(block=np.vstack([left.block, right.block]))
    if left.height > right.height + 1:
        return _balanced(left.left, join(left.right, right))
    if right.height > left.height + 1:
        return _balanced(join(left, right.left), right.right)
    return Node(left, right)


def build(leaves: np.ndarray) -> Tree:
    level: list[Node] = [Node(block=leaves[i : i + BLOCK]) for i in range(0, len(leaves), BLOCK)]
    while len(level) > 1:
        paired = [Node(a, b) for a, b in zip(level[::2], level[1::2])]
        level = paired + level[len(level) - len(level) % 2 :]
    return level[0] if level else None


def split(tree: Tree, at: int) -> tuple[Tree, Tree]:
    """The pre-tokens that end at the character position at or before it, and the others, in time of the tree's height."""
    if tree is None:
        return None, None
    if tree.block is not None:
        k = int(np.searchsorted(np.cumsum(tree.block[:, 0]), at, side="right"))
        return (Node(block=tree.block[:k]) if k else None), (Node(block=tree.block[k:]) if k < tree.count else None)
    if at < tree.left.chars:
        a, b = split(tree.left, at)
        return a, join(b, tree.right)
    a, b = split(tree.right, at - tree.left.chars)
    return join(tree.left, a), b


def starts_at(tree: Tree, at: int) -> bool:
    """Whether a pre-token starts, or the last one ends, at the character position."""
    start = 0
    while tree is not None and tree.block is None:
        if at < start + tree.left.chars:
            tree = tree.left
        else:
            start += tree.left.chars
            tree = tree.right
    return at == start or tree is not None and at - start in np.cumsum(tree.block[:, 0])


def leaves_of(tree: Tree) -> np.ndarray:
    out, todo = [], [tree] if tree is not None else []
    while todo:
        node = todo.pop()
        if node.block is not None:
            out.append(node.block)
        else:
            todo += [node.right, node.left]
    return np.vstack(out) if out else np.zeros((0, 2), np.int64)


def dump(tree: Tree) -> bytes:
    """A tree as bytes: its pre-tokens' characters and tokens. Sums aren't written: they are added up faster than read."""
    leaves = leaves_of(tree)
    most = int(leaves.max(initial=0))
    width = 1 if most < 2**8 else 2 if most < 2**16 else 4
    return bytes([width]) + leaves.astype(WIDTHS[width]).tobytes()


def load(raw: bytes) -> Tree:
    return build(np.frombuffer(raw, WIDTHS[raw[0]], offset=1).reshape(-1, 2).astype(np.int64))


class EditedText:
    """A text, its tree and the number of characters that edits made it encode again."""

    def __init__(self, text: str, counter: Counter, tree: Tree = None):
        """tree: the text's, as kept; it is counted if there is none."""
        self.text, self.counter, self.encoded = text, counter, 0
        self.tree = build(counter.counts(text)) if tree is None else tree

    @property
    def tokens(self) -> int:
        return self.tree.tokens if self.tree else 0

    @property
    def pretokens(self) -> int:
        return self.tree.count if self.tree else 0

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces text[start:end] by new.

        Pre-tokens that end at least LOOKAHEAD characters before the edit stay. From there on the new text is split
        again until a boundary beyond the edit falls on an old one: what follows is the same text from the same
        boundary, so its pre-tokens stay as well. The tree is split there, and joined with a tree over the new part.
        """
        size = len(self.text)
        start = max(0, min(start, size))
        end = max(start, min(end, size))
        text = self.text[:start] + new + self.text[end:]
        before, rest = split(self.tree, max(0, start - LOOKAHEAD))
        begin, moved, reach = before.chars if before else 0, len(new) - (end - start), 32
        while True:
            stop = min(len(text), start + len(new) + reach)
            leaves = self.counter.counts(text[begin:stop])
            ends = begin + np.cumsum(leaves[:, 0])
            if stop == len(text):
                after = None
                break
            # The end of the piece may have cut a pre-token short: only boundaries well before it count.
            sure = np.flatnonzero((ends >= start + len(new)) & (ends <= stop - 2 * LOOKAHEAD))[:-1]
            k = next((k for k in sure if starts_at(rest, int(ends[k]) - moved - begin)), None)
            if k is not None:
                leaves, after = leaves[: k + 1], split(rest, int(ends[k]) - moved - begin)[1]
                break
            reach *= 4
        self.encoded += int(leaves[:, 0].sum())
        self.tree = join(join(before, build(leaves)), after)
        self.text = text


def with_trees(df: DataFrame, path: str | None = None, text: str = "text", column: str = "tree") -> DataFrame:
    """df with each text's tree as bytes, in a column that replaces one of that name. Null texts are empty; very long ones are counted whole."""
    df = df.drop(column)
    schema = T.StructType([*df.schema.fields, T.StructField(column, T.BinaryType())])

    def rows(batches):
        counter = Counter(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            trees = pa.array([dump(build(counter.counts(t.as_py() or ""))) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, trees], names=[*batch.schema.names, column])

    return df.mapInArrow(rows, schema)


SCHEMA = (
    "doc_id long, text string, tree binary, n_pretokens long, n_tokens long, tokens_after long, chars_after long, chars_encoded_again long"
)


def apply_edits(
    df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", edits: str = "edits", tree: str = "tree"
) -> DataFrame:
    """The texts after their edits, array<struct<start:int,end:int,text:string>>, applied in turn, with their trees and token counts.

    Counts before come from the kept tree, those after from the tree that the edits changed: only what they touch is
    encoded. The result has text and tree, so further edits can start from it. A null tree is counted anew; one that
    doesn't belong to its text gives wrong counts. Positions are code points of the text as it then is and are
    moved into it; an end before its start counts as the start; null parts of an edit count as 0, start and the empty
    text. A null text is empty, null edits are none, null keys stay null, repeated rows are counted each, other columns
    aren't looked at, an empty table gives an empty one.
    """

    def rows(batches):
        counter = Counter(path)
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in range(7))
            for doc, kept, changes in zip(batch.column(1), batch.column(2), batch.column(3)):
                raw = kept.as_py()
                edited = EditedText(doc.as_py(), counter, load(raw) if raw else None)
                before = (edited.pretokens, edited.tokens)
                for e in changes.as_py() or []:
                    if e is not None:
                        start = e["start"] or 0
                        edited.edit(start, start if e["end"] is None else e["end"], e["text"] or "")
                for column, value in zip(out, (edited.text, dump(edited.tree), *before, edited.tokens, len(edited.text), edited.encoded)):
                    column.append(value)
            types = (pa.string(), pa.binary(), *[pa.int64()] * 5)
            columns = [batch.column(0), *(pa.array(x, t) for x, t in zip(out, types))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    changes = F.col(edits).cast("array<struct<start:int,end:int,text:string>>")
    held = F.col(tree) if tree in df.columns else F.lit(None).cast("binary")
    return df.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"), held.alias("tree"), changes.alias("edits")).mapInArrow(rows, SCHEMA)

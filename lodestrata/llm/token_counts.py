"""Edit-aware token counts.

Per document a segment tree is kept over runs of white-space-delimited pieces: a leaf holds the
characters and tokens of up to ``LEAF`` pieces, an inner node the sums below it. An edit touches the
leaves its span overlaps, and the next one where the edit takes away the white space that ended its
span; only their text is encoded again, and the sums on their paths are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, lean, with_fields
from .token_store import WordEncoder

LEAF = 32
#: White space that no token crosses.
_BLANKS = " \t\n\x0b\x0c\r"
_GAP = re.compile(f"[{_BLANKS}]+")


class CountTree:
    """Sums of characters and tokens; leaf i is node size + i of a heap, row 0 characters, row 1 tokens."""

    def __init__(self, node: np.ndarray):
        self.node, self.size = node, node.shape[1] // 2

    @classmethod
    def over(cls, leaves: np.ndarray) -> CountTree:
        size = 1 << max(0, (leaves.shape[1] - 1).bit_length())
        node = np.zeros((2, 2 * size), "<i8")
        node[:, size : size + leaves.shape[1]] = leaves
        while size > 1:
            half = size // 2
            node[:, half:size] = node[:, size : 2 * size : 2] + node[:, size + 1 : 2 * size : 2]
            size = half
        return cls(node)

    @classmethod
    def load(cls, data: bytes) -> CountTree:
        return cls(np.frombuffer(data, "<i4").astype("<i8").reshape(2, -1))

    def dump(self) -> bytes:
        return self.node.astype("<i4").tobytes()

    @property
    def chars(self) -> int:
        return int(self.node[0, 1])

    @property
    def tokens(self) -> int:
        return int(self.node[1, 1])

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` and where it begins; the last leaf in use for the end."""
        at, k, begin = min(at, max(self.chars - 1, 0)), 1, 0
        while k < self.size:
            left = int(self.node[0, 2 * k])
            if at < begin + left:
                k = 2 * k
            else:
                begin, k = begin + left, 2 * k + 1
        return k - self.size, begin

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        k = leaf + self.size
        step = np.array([chars, tokens], "<i8") - self.node[:, k]
        while k:
            self.node[:, k] += step
            k //= 2


def leaves(text: str) -> list[str]:
    """``text`` cut after every LEAF-th run of white space, so no piece crosses a cut."""
    cuts = [m.end() for m in _GAP.finditer(text)][LEAF - 1 :: LEAF]
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]


def _count(encoder: WordEncoder, texts: list[str]) -> list[int]:
    return encoder.count(texts)


def build_tree(text: str, encoder: WordEncoder) -> CountTree:
    parts = leaves(text)
    return CountTree.over(np.array([[len(p) for p in parts], _count(encoder, parts)], "<i8"))


class Edit:
    """An edit of ``text[start:end]`` under way: ``parts`` is what has to be encoded, ``settle`` takes its counts."""

    def __init__(self, text: str, tree: CountTree, start: int, end: int, put: str):
        self.tree = tree
        start = min(max(start, 0), len(text))
        end = min(max(end, start), len(text))
        self.first, begin = tree.find(start)
        self.last, at = tree.find(max(start, end - 1))
        stop = at + int(tree.node[0, tree.size + self.last])
        region = text[begin:start] + put + text[end:stop]
        while stop < len(text) and region[-1:] not in tuple(_BLANKS):
            self.last += 1
            more = int(tree.node[0, tree.size + self.last])
            region, stop = region + text[stop : stop + more], stop + more
        self.text = text[:begin] + region + text[stop:]
        self.encoded, self.parts = len(region), leaves(region)

    def settle(self, counts: list[int]) -> CountTree:
        tree, first, last, parts = self.tree, self.first, self.last, self.parts
        if len(parts) <= last - first + 1:
            for k in range(first, last + 1):
                i = k - first
                tree.put(k, len(parts[i]) if i < len(parts) else 0, counts[i] if i < len(parts) else 0)
            return tree
        old = tree.node[:, tree.size : 2 * tree.size]
        return CountTree.over(np.concatenate([old[:, :first], np.array([[len(p) for p in parts], counts], "<i8"), old[:, last + 1 :]], axis=1))


def edit(text: str, tree: CountTree, start: int, end: int, put: str, encoder: WordEncoder) -> tuple[str, CountTree, int]:
    """Replaces text[start:end]; returns the text, its tree and how many characters were encoded again."""
    e = Edit(text, tree, start, end, put)
    return e.text, e.settle(_count(encoder, e.parts)), e.encoded


def build(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Adds ``tree`` (binary) and ``n_tokens`` to ``docs(doc_id, text, edits)``, in place of columns of these names; null texts are empty."""
    docs = docs.drop("tree", "n_tokens")

    def run(it):
        encoder = WordEncoder.of(tokenizer)
        for b in it:
            trees, n = [], []
            for some in batches(((t.as_py() or "",) for t in b.column("text")), 1 << 22, lambda r: len(r[0]) + 64):
                parts = [leaves(t) for (t,) in some]
                counts = iter(_count(encoder, [p for ps in parts for p in ps]))
                for ps in parts:
                    tree = CountTree.over(np.array([[len(p) for p in ps], [next(counts) for _ in ps]], "<i8"))
                    trees.append(tree.dump())
                    n.append(tree.tokens)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(trees, pa.binary()), pa.array(n, pa.int64())], names=[*b.schema.names, "tree", "n_tokens"])

    return docs.mapInArrow(lean(run), with_fields(docs, "tree binary, n_tokens long"))


EDITED = "doc_id long, n_tokens long, n_edited long, n_chars long, n_encoded long, n_edits long"


def apply(trees: DataFrame, tokenizer: str) -> DataFrame:
    """Applies each row's ``edits`` (array of start, stop, put; in order, offsets in characters of the text as it then is).

    Takes what ``build`` returns. Returns the counts before and after, the edited text's length and the
    characters encoded again. A null list or edit is none; offsets are held to the text, a null start
    is 0, a null stop the start, a null put the empty string. Each row is counted by itself: repeated rows give equal rows,
    and an empty table an empty one.
    """

    def run(it):
        encoder = WordEncoder.of(tokenizer)
        for b in it:
            texts = [t or "" for t in b.column("text").to_pylist()]
            trees = [CountTree.load(t) for t in b.column("tree").to_pylist()]
            edits = [[e for e in es or [] if e is not None] for es in b.column("edits").to_pylist()]
            again = [0] * len(texts)
            for k in range(max(map(len, edits), default=0)):  # the k-th edits of all documents are encoded together
                under_way = []
                for i, es in enumerate(edits):
                    if k < len(es):
                        start = es[k]["start"] or 0
                        under_way.append((i, Edit(texts[i], trees[i], start, start if es[k]["stop"] is None else es[k]["stop"], es[k]["put"] or "")))
                counts = iter(_count(encoder, [p for _, e in under_way for p in e.parts]))
                for i, e in under_way:
                    texts[i], trees[i] = e.text, e.settle([next(counts) for _ in e.parts])
                    again[i] += e.encoded
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), *[pa.array(c, pa.int64()) for c in ([t.tokens for t in trees], list(map(len, texts)), again, list(map(len, edits)))]], names=["doc_id", "n_tokens", "n_edited", "n_chars", "n_encoded", "n_edits"])

    return trees.mapInArrow(lean(run), EDITED)

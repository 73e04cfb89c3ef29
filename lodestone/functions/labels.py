"""Boolean label expressions: ``&``, ``|``, ``-`` (difference) and parentheses over label numbers.

``&`` and ``-`` bind tighter than ``|``; equal precedence goes left to right. A leaf
holds the rows that carry the label or are universal, so a difference takes
universal rows away; with ``universal="always"`` they stay in every result. The
empty expression is the universal rows alone. Anything malformed is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+)|([&|()\-]))")


@dataclass(frozen=True)
class Node:
    """A label (op is None) or an operation on two nodes."""

    op: str | None
    label: int | None = None
    left: Node | None = None
    right: Node | None = None


def parse(text: str) -> Node | None:
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected character at {at} in {text!r}")
        tokens.append(int(m[1]) if m[1] else m[2])
        at = m.end()
    if not tokens:
        return None
    node, rest = _union(tokens, text)
    if rest:
        raise ValueError(f"unexpected {rest[0]!r} in {text!r}")
    return node


def _union(tokens: list, text: str) -> tuple[Node, list]:
    node, tokens = _chain(tokens, text)
    while tokens and tokens[0] == "|":
        right, tokens = _chain(tokens[1:], text)
        node = Node("|", None, node, right)
    return node, tokens


def _chain(tokens: list, text: str) -> tuple[Node, list]:
    node, tokens = _leaf(tokens, text)
    while tokens and tokens[0] in ("&", "-"):
        right, rest = _leaf(tokens[1:], text)
        node, tokens = Node(tokens[0], None, node, right), rest
    return node, tokens


def _leaf(tokens: list, text: str) -> tuple[Node, list]:
    if not tokens:
        raise ValueError(f"{text!r} ends too early")
    head, rest = tokens[0], tokens[1:]
    if isinstance(head, int):
        return Node(None, head), rest
    if head != "(":
        raise ValueError(f"unexpected {head!r} in {text!r}")
    node, rest = _union(rest, text)
    if not rest or rest[0] != ")":
        raise ValueError(f"missing ) in {text!r}")
    return node, rest[1:]


def predicate(expression: str, labels: Column, is_universal: Column, universal: str = "leaf") -> Column:
    """The expression as a condition on one row, which Catalyst can push down and simplify."""

    def build(node: Node) -> Column:
        if node.op is None:
            held = F.array_contains(labels, node.label)
            return held | is_universal if universal == "leaf" else held
        a, b = build(node.left), build(node.right)
        return a & b if node.op == "&" else a | b if node.op == "|" else a & ~b

    node = parse(expression)
    if node is None:
        return is_universal
    found = build(node)
    return found | is_universal if universal == "always" else found


_parsed = lru_cache(4096)(parse)


def rows_that_hold(expression: str, owner: np.ndarray, values: np.ndarray, universal: np.ndarray) -> np.ndarray:
    """The expression over rows in memory: row owner[i] carries the label values[i]."""

    def build(node: Node) -> np.ndarray:
        if node.op is None:
            held = universal.copy()
            held[owner[values == node.label]] = True
            return held
        a, b = build(node.left), build(node.right)
        return a & b if node.op == "&" else a | b if node.op == "|" else a & ~b

    node = _parsed(expression)
    return universal.copy() if node is None else build(node)


def arrow_rows_that_hold(expression: str, labels: pa.Array, universal: pa.Array) -> np.ndarray:
    """The expression over a batch's lists of labels; null lists are empty, a null flag is false."""
    lengths = labels.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = labels.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
    return rows_that_hold(expression, np.repeat(np.arange(len(labels)), lengths), values, universal.fill_null(False).to_numpy(zero_copy_only=False).copy())


def candidates(expression: str, postings: DataFrame, universal_ids: DataFrame) -> DataFrame:
    """The expression as set algebra over posting lists: (vec_id)."""

    def build(node: Node) -> DataFrame:
        if node.op is None:
            return postings.where(F.col("label") == node.label).select("vec_id").union(universal_ids.select("vec_id")).distinct()
        a, b = build(node.left), build(node.right)
        if node.op == "|":
            return a.union(b).distinct()
        return a.join(b, "vec_id", "left_semi" if node.op == "&" else "left_anti")

    node = parse(expression)
    return universal_ids.select("vec_id").distinct() if node is None else build(node)


def conjunction(wanted: list[int], labels: Column, is_universal: Column) -> Column:
    """Rows with all the labels, or universal; without labels, universal rows alone."""
    if not wanted:
        return is_universal
    return reduce(lambda a, b: a & b, [F.array_contains(labels, x) for x in wanted]) | is_universal

"""Loops in the small graphs that one geometry's rings and edges make.

A graph belongs to one record and is no larger than it, so each is looked at where its row is.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"


class Groups:
    """Disjoint sets of nodes."""

    def __init__(self):
        self.up: dict = {}

    def root(self, node):
        self.up.setdefault(node, node)
        while self.up[node] != node:
            self.up[node] = self.up[self.up[node]]
            node = self.up[node]
        return node

    def join(self, a, b) -> bool:
        """False if both were in one group already."""
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


def has_loop(touches: Iterable[tuple]) -> bool:
    """Of rings and the spots (x, y) where they touch: is there a cycle?"""
    groups = Groups()
    return any(not groups.join(("ring", ring), ("spot", *spot)) for ring, spot in touches)


def close_a_loop(touches: Column) -> Column:
    """Of rings and the spots where they touch (each pair once): does the graph of both have a cycle?"""

    def loops(column: pd.Series) -> pd.Series:
        return column.map(
            lambda ts: ts is not None and has_loop((t["ring"], (t["spot"]["x"], t["spot"]["y"])) for t in ts)
        )

    return F.pandas_udf(loops, "boolean")(touches)


def _closed(edges) -> list:
    """The edges left when loose ends are taken off again and again; only groups whose nodes all have
    an even number of them, so that they are closed rings."""
    ends = [((e["start"]["x"], e["start"]["y"]), (e["end"]["x"], e["end"]["y"])) for e in edges]
    at = defaultdict(set)
    for i, (a, b) in enumerate(ends):
        at[a].add(i)
        at[b].add(i)
    loose = [node for node, own in at.items() if len(own) == 1]
    while loose:
        node = loose.pop()
        for i in list(at[node]) if len(at[node]) == 1 else ():
            for end in ends[i]:
                at[end].discard(i)
                if len(at[end]) == 1:
                    loose.append(end)
    left = set().union(*at.values()) if at else set()
    groups = Groups()
    for i in left:
        groups.join(*ends[i])
    odd = {groups.root(node) for node, own in at.items() if len(own) % 2}
    return [edges[i] for i in sorted(left) if groups.root(ends[i][0]) not in odd]


def closed_edges(edges: Column) -> Column:
    """Of one record's edges those that make closed rings among themselves."""

    def closed(column: pd.Series) -> pd.Series:
        return column.map(lambda e: _closed(list(e)))

    return F.pandas_udf(closed, f"array<struct<start:{POINT},end:{POINT}>>")(edges)

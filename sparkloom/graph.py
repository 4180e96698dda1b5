"""The property graph: a DataFrame for each node label and each relationship type."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


class Lazy(Mapping):
    """Frames by name that are made when first asked for, so a query plans and opens only the tables that it reads."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self.makers, self.made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)

    def __contains__(self, name) -> bool:
        return name in self.makers


@dataclass(frozen=True)
class PropertyGraph:
    """``nodes``: label -> (id long, properties); ``edges``: type -> (eid, src, dst long, properties). Ids are unique across labels.

    A graph is never changed: writes return a new one. ``sets``: for a label and a type that joins all members of sets, each pair once, smaller id first, what makes
    the sets (o, id) of the label's nodes.
    """

    nodes: Mapping[str, DataFrame]
    edges: Mapping[str, DataFrame]
    ends: dict[str, tuple[frozenset, frozenset]] = field(default_factory=dict)
    sets: dict[tuple[str, str], Callable[[], DataFrame]] = field(default_factory=dict)

    def node_frame(self, labels: list[str] | None = None, some: list[str] | None = None) -> DataFrame:
        """Nodes with all of ``labels``, or every node; with ``some``, those with one of these. A frame's name is its nodes' label set, joined by colons. Adds ``labels``."""
        names = [n for n in self.nodes if set(labels or ()) <= set(n.split(":")) and (some is None or set(some) & set(n.split(":")))]
        own = lambda n: F.array(*map(F.lit, filter(None, n.split(":")))).cast("array<string>")
        if not names:
            first = next(iter(self.nodes))
            return self.nodes[first].withColumn("labels", own(first)).limit(0)
        return union([self.nodes[n].withColumn("labels", own(n)) for n in names])

    def edge_frame(self, types: list[str] | None = None) -> DataFrame:
        names = [t for t in self.edges if types is None or t in types]
        if not names:
            some = next(iter(self.edges))
            return self.edges[some].withColumn("rel_type", F.lit(some)).limit(0)
        return union([self.edges[t].withColumn("rel_type", F.lit(t)) for t in names])

    def far_labels(self, types: list[str] | None, out: bool) -> list[str] | None:
        """Labels that the far ends of ``types`` can have, if known: an unlabelled pattern node then scans those alone."""
        sides = [self.ends.get(t) for t in self.edges if types is None or t in types]
        return None if not sides or None in sides else sorted(set().union(*(s[1 if out else 0] for s in sides)))

    def projection(self, label: str | None = None, via: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(id) and (eid, src, dst, properties) of a label's induced subgraph."""
        nodes = self.node_frame([label] if label else None).select("id")
        edges = self.edge_frame([via] if via else None)
        if label:
            ends = nodes.select(F.col("id").alias("_e"))
            edges = edges.join(ends, edges.src == ends._e, "left_semi").join(ends, edges.dst == ends._e, "left_semi")
            if (label, via) in self.sets:
                edges._sets = self.sets[label, via]
        return nodes, edges

    def with_nodes(self, label: str, frame: DataFrame) -> PropertyGraph:
        return PropertyGraph({**self.nodes, label: frame}, self.edges, self.ends)

    def with_edges(self, kind: str, frame: DataFrame) -> PropertyGraph:
        return PropertyGraph(self.nodes, {**self.edges, kind: frame}, {k: v for k, v in self.ends.items() if k != kind})

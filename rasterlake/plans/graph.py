"""Computed sequences: an acyclic graph of reductions and frame arithmetic."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.plans.stage import shared_dir


@dataclass(frozen=True)
class Node:
    kind: str  # mean, std, add, sub
    a: int
    b: int | None = None

    def sources(self) -> tuple[int, ...]:
        return (self.a,) if self.b is None else (self.a, self.b)


#: Kinds, with the old name of sub.
KINDS = {"mean": "mean", "std": "std", "add": "add", "sub": "sub", "diff": "sub"}


def parse_node(token: str) -> Node | None:
    """The node of ``compute:kind:a[,b][:auto]``, else None."""
    head, _, rest = token.partition(":")
    kind, _, sources = rest.partition(":")
    ids = sources.split(":")[0].split(",")
    if head != "compute" or kind not in KINDS or not all(x.isdigit() for x in ids):
        return None
    kind, numbers = KINDS[kind], [int(x) for x in ids]
    wanted = 1 if kind in ("mean", "std") else 2
    return Node(kind, *numbers[:wanted]) if len(numbers) >= wanted else None


@dataclass
class Graph:
    """Inputs by index, and nodes computed from them; one lazy plan each."""

    inputs: dict[int, DataFrame]
    nodes: dict[int, Node] = field(default_factory=dict)

    def add(self, index: int, node: Node) -> Graph:
        if index in self._above(node):
            raise ValueError(f"node {index} would depend on itself")
        self.nodes[index] = node
        return self

    def _above(self, node: Node) -> set[int]:
        found, open_ = set(), list(node.sources())
        while open_:
            at = open_.pop()
            if at not in found:
                found.add(at)
                open_ += self.nodes[at].sources() if at in self.nodes else ()
        return found

    def plan(self, index: int) -> DataFrame:
        """(frame_idx, y, x, v) of an input or a node; a still is its frame 0."""
        if index in self.inputs:
            return self.inputs[index]
        node = self.nodes[index]
        a = self.plan(node.a)
        if node.kind in ("mean", "std"):
            v = F.col("v").cast("double")
            mean = F.sum(v) / F.count("*")
            made = mean if node.kind == "mean" else F.sqrt(F.greatest(F.sum(v * v) / F.count("*") - mean * mean, F.lit(0.0)))
            return a.groupBy("y", "x").agg(made.cast("float").alias("v")).select(F.lit(0).alias("frame_idx"), "y", "x", "v")
        b, on = self.plan(node.b).withColumnRenamed("v", "other"), ["frame_idx", "y", "x"]
        if node.b in self.nodes and self.nodes[node.b].kind in ("mean", "std"):
            b, on = b.drop("frame_idx"), ["y", "x"]
        value = F.col("v") + F.col("other") if node.kind == "add" else F.col("v") - F.col("other")
        return a.join(b, on).select("frame_idx", "y", "x", value.cast("float").alias("v"))


def reachable(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, source): everything that each node depends on, from (node, source) edges.

    Each round follows the edges of what the last one found and keeps only what is new, so a diamond
    costs its pairs, not its paths. Rounds end at the longest chain; each writes what it found beside the
    rounds before it, and nothing is written twice.
    """
    folder = f"{shared_dir(spark).rstrip('/')}/cut/{uuid.uuid4().hex}"
    schema = edges.select("node", "source").schema

    def found(round_: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{folder}/round={round_}")

    edges.select("node", "source").distinct().write.parquet(f"{folder}/round=0")
    at = 0
    while not found(str(at)).isEmpty():
        further = found(str(at)).alias("f").join(found("0").alias("e"), F.col("f.source") == F.col("e.node")).select("f.node", "e.source").distinct()
        known = found("*")
        further.join(known, ["node", "source"], "left_anti").write.parquet(f"{folder}/round={at + 1}")
        at += 1
    return found("*")

"""Computed sequences kept up to date while their inputs change.

``stream.writeStream.foreachBatch(Refresh(nodes, folder))`` takes micro-batches of
(input, frame_idx, y, x, v) rows. An input's signature folds in the batches that touched
it, a node's the kind of computation and its sources' signatures, so a node is computed
again exactly if something that it depends on has changed. Nodes follow their sources;
each reads what is stored of them, not their computation.

Everything of a batch is written under its number or under a signature, and the batch's
state last, so a batch that is cut off and comes again does the same once more, and one
that was finished does nothing. What stands in ``folder``: ``inputs/batch=n``,
``nodes/<node>/<signature>``, ``state/batch=n``.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.plans.graph import Graph, Node

SAMPLE = "frame_idx int, y int, x int, v float"
STATE = "node int, signature string, recomputed boolean"


def folded(*parts) -> str:
    return hashlib.sha256("\n".join(map(str, parts)).encode()).hexdigest()[:32]


class Refresh:
    """Called with each micro-batch and its number."""

    def __init__(self, nodes: dict[int, Node], folder: str):
        self.graph, self.folder = Graph({}), folder.rstrip("/")
        for index, node in nodes.items():
            self.graph.add(index, node)
        self.order: list[int] = []
        open_ = sorted(nodes)
        while open_:
            ready = [k for k in open_ if all(s not in nodes or s in self.order for s in nodes[k].sources())]
            self.order += ready
            open_ = [k for k in open_ if k not in ready]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before, known = self._state(spark, batch_id)
        if known == batch_id:
            return
        rows = batch.select("input", *(c.split()[0] for c in SAMPLE.split(", ")))
        rows.write.mode("overwrite").parquet(f"{self.folder}/inputs/batch={batch_id}")
        inputs = sorted({s for node in self.graph.nodes.values() for s in node.sources()} - set(self.order))
        written = spark.read.parquet(f"{self.folder}/inputs/batch={batch_id}")
        touched = {r.input for r in written.filter(F.col("input").isin(inputs)).select("input").distinct().collect()}
        now = {i: folded(before.get(i, ""), batch_id) if i in touched else before.get(i, "") for i in inputs}
        state = [(i, now[i], i in touched) for i in inputs]
        for index in self.order:
            node = self.graph.nodes[index]
            now[index] = folded(node.kind, *(now[s] for s in node.sources()))
            if again := now[index] != before.get(index) and all(now[s] for s in node.sources()):
                stored = {s: self._of(spark, s, now[s], batch_id) for s in node.sources()}
                self._one(node, stored).write.mode("overwrite").parquet(self._place(index, now[index]))
            elif now[index] != before.get(index):
                now[index] = ""
            state.append((index, now[index], bool(again)))
        spark.createDataFrame(state, STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/state/batch={batch_id}")

    def _one(self, node: Node, stored: dict[int, DataFrame]) -> DataFrame:
        """A single node over what is stored of its sources; what kind of node each is says how frames meet."""
        single = Graph(dict(stored), {s: self.graph.nodes[s] for s in stored if s in self.graph.nodes})
        single.nodes[-1] = node
        return single.plan(-1)

    def _place(self, node: int, signature: str) -> str:
        return f"{self.folder}/nodes/{node}/{signature}"

    def _of(self, spark: SparkSession, index: int, signature: str, batch_id: int) -> DataFrame:
        if index in self.graph.nodes:
            return spark.read.schema(SAMPLE).parquet(self._place(index, signature))
        rows = spark.read.schema(f"input int, {SAMPLE}, batch long").parquet(f"{self.folder}/inputs").filter((F.col("input") == index) & (F.col("batch") <= batch_id))
        return rows.groupBy("frame_idx", "y", "x").agg(F.max_by("v", "batch").alias("v"))

    def _state(self, spark: SparkSession, batch_id: int | None = None) -> tuple[dict[int, str], int]:
        """Signatures after the last finished batch up to ``batch_id``, and its number."""
        try:
            rows = spark.read.schema(f"{STATE}, batch long").parquet(f"{self.folder}/state")
            last = rows.filter(F.col("batch") <= batch_id).agg(F.max("batch")).first()[0]
        except AnalysisException:
            last = None
        if last is None:
            return {}, -1
        return {r.node: r.signature for r in rows.filter(F.col("batch") == last).collect()}, last

    def state(self, spark: SparkSession) -> DataFrame:
        """(node, signature, recomputed, batch) of every finished batch."""
        return spark.read.schema(f"{STATE}, batch long").parquet(f"{self.folder}/state")

    def results(self, spark: SparkSession) -> DataFrame:
        """(node, recomputed, frame_idx, y, x, v) of all nodes as the last batch left them."""
        state = self.state(spark)
        last = state.filter(F.col("batch") == state.agg(F.max("batch")).first()[0]).collect()
        parts = [spark.read.schema(SAMPLE).parquet(self._place(r.node, r.signature)).select(F.lit(r.node).alias("node"), F.lit(r.recomputed).alias("recomputed"), "frame_idx", "y", "x", "v") for r in last if r.node in self.graph.nodes and r.signature]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

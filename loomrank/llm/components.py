"""Connected components of a link table, fully distributed.

Each partition first contracts its links with an in-memory union-find (a forest has
fewer edges than nodes), then large-star and small-star rounds alternate until the
edge set is a set of stars.  Every round is checkpointed to the shared folder, so a
lost executor costs a re-read and not the whole lineage; links never reach the driver.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    Where none is set, a local master gets a temporary one that is removed at exit; a cluster
    is an error, because its machines do not share a temporary folder.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        if not named:
            named = tempfile.mkdtemp(prefix="loomrank-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` in the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Compressed intermediate tables in the shared folder, each removed as soon as it is not needed."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.n = spark, 0
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, batch: int | None = None) -> DataFrame:
        """``df`` written and read back; shuffle files of the writing query are removed at its end.

        ``batch``: rows that readers and Arrow hold at once while it is written, for tables whose rows are megabytes.
        """
        self.n += 1
        path, settings = f"{self.folder}/{self.n}", {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
        if batch:
            settings |= {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch), "spark.sql.parquet.columnarReaderBatchSize": str(batch)}
        before = {key: self.spark.conf.get(key) for key in settings}
        try:
            for key, value in settings.items():
                self.spark.conf.set(key, value)
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for key, value in before.items():
                self.spark.conf.set(key, value)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, n: int) -> None:
        """Remove the n-th written table."""
        remove(self.spark, f"{self.folder}/{n}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class UnionFind:
    """Union-find over hashable ids whose roots are the smallest members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent.setdefault(a, a)
        self.parent.setdefault(b, b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        uf = UnionFind()
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            uf.union(a, b)
        nodes = [x for x in uf.parent if uf.find(x) != x]
        yield pd.DataFrame({"a": nodes, "b": [uf.find(x) for x in nodes]}, dtype="int64")


def _contract_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Like _contract, over a whole partition."""
    frames = list(batches)
    yield from _contract(iter([pd.concat(frames)] if frames else []))


#: Edges of one task; fewer edges run in fewer tasks than the session's partitions.
TASK_EDGES = 100_000


#: A node with more edges than this, and than a two-thousandth of all edges, has its minimum broadcast.
HOT_EDGES = 200


def _with_minimum(edges: DataFrame, key: str, mins: DataFrame, count: int) -> DataFrame:
    """``edges`` left-joined by ``key`` with mins(node, m).

    At most 2,000 nodes hold more than 1/2,000 of all ``count`` edges: their minima are
    broadcast, and no task gets all edges of one node.
    """
    hot = edges.groupBy(key).count().where(F.col("count") > max(HOT_EDGES, count // 2000)).select(key)
    marked = edges.join(F.broadcast(hot.withColumn("hot", F.lit(True))), key, "left")
    mins = mins.withColumnRenamed("node", key)
    few = F.broadcast(mins.join(F.broadcast(hot), key, "left_semi"))
    return marked.where("hot").drop("hot").join(few, key, "left").unionByName(marked.where("hot is null").drop("hot").join(mins, key, "left"))


def _star(edges: DataFrame, large: bool, tasks: int, count: int) -> DataFrame:
    """One star round over edges (a > b), in ``tasks`` tasks on the sending side of each exchange.

    Large: every larger neighbour of a node moves to the node's smallest neighbour or itself.
    Small: every smaller neighbour, and the node, move to its smallest neighbour.
    """
    edges = edges.coalesce(tasks)
    mins = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    if large:
        out = _with_minimum(edges, "b", mins, count).select("a", F.coalesce("m", "b").alias("b"))
    else:
        moved = _with_minimum(edges, "a", mins, count).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.union(mins.select("node", F.col("m").alias("b")))
    return out.where("a != b").coalesce(tasks).distinct()


def components(links: DataFrame, max_rounds: int = 60, one_task: int = TASK_EDGES) -> DataFrame:
    """(id, comp) for every id that occurs in ``links(a, b)``; comp is the smallest id reachable.

    Self-links and repeated links are ignored; rows with a null end link nothing.  Up to
    ``one_task`` edges, counted after the first contraction, are united in one task.
    """
    edges = links.where("a is not null and b is not null and a != b").select(
        F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")
    )
    edges = checkpointed(edges.mapInPandas(_contract, "a long, b long"))
    count = edges.count()
    if not count:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    if count <= one_task:
        edges = checkpointed(edges.coalesce(1).mapInPandas(_contract_all, "a long, b long"))
    last, rounds = None, max_rounds if count > one_task else 0
    for _ in range(rounds):
        tasks = max(1, -(-count // TASK_EDGES))
        edges = checkpointed(_star(_star(edges, True, tasks, count), False, tasks, count).coalesce(tasks))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last, count = now, now[0]
    else:
        if rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(
        edges.select("b", "b").distinct()
    )

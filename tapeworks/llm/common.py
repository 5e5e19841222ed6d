"""Helpers that the training-data operators share: shared folders, lineage cuts, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tapeworks-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def quoted(names: list[str]) -> list[str]:
    """Names of columns as they are, with full stops and the like, for select()."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared folder, so that a lost executor costs no recomputation of what led to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def as_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and rereads it; columns can then be pruned, unlike with checkpoint()."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joins the classes of rows i and j; label[row] is the smallest row of its class."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, nxt := label[label]):
            label = nxt


def thinned(edges: DataFrame, most: int = 400_000) -> DataFrame:
    """(src, dst) longs, src > dst -> fewer edges with the same components: of each task's edges, `most` at once, a spanning forest
    of links to the smallest id. A node of many small links comes to one task, so that most of them fall away."""

    def forest(batches):
        held, rows = [], 0

        def flush():
            src, dst = (np.concatenate([b[c].to_numpy() for b in held]) for c in ("src", "dst"))
            ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
            label = merge(np.arange(len(ids)), at[: len(src)], at[len(src) :])
            linked = np.flatnonzero(label != np.arange(len(ids)))
            return pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[label[linked]])], ["src", "dst"])

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= most:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    return edges.repartition("src").mapInArrow(forest, "src bigint, dst bigint")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(src, dst) longs, undirected -> (id, component): each node that has an edge, with the smallest id it reaches.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each is a grouped minimum and a join back, so that
    a node of very many links is a skewed join key that AQE splits, never a list in one task. Self links and nulls are dropped.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    e, before = cut(thinned(e).distinct()), None
    for _ in range(rounds):
        both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst")
        large = large.distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(low.select("src", F.col("m").alias("dst")))
        e = cut(small.where("src <> dst").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return e.select(F.col("src").alias("id"), F.col("dst").alias("component")).union(e.select(F.col("dst"), F.col("dst"))).distinct()

"""A Merkle manifest of a dataset: a tree of sixteens for each group of rows, a tree over the groups' roots, and proofs.

Where a leaf belongs follows from ranks, not from a sort of the leaves. A group's doc_ids are held as bitmaps of 65,536 ids
(sorted 16-bit arrays while there are under 4,096): tasks make them of what they read, those of one group and range are merged,
and each gets the number of ids before it from sums in two levels. A leaf meets the bitmap of its range, and the directory of
popcounts gives its place. Ids that occur more than once have their extra counts beside the bitmap, and only their rows are
numbered by a window. Then each run of sixteen is one grouping by (group, place div 16) into an array by slot, level by level;
each level has a sixteenth of the rows, and no group, whatever its size, is one task's.

Proofs are handed down from the roots: a run's path is joined to its sixteen children, which adds their siblings. What is
shuffled for that is runs, not leaves.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import as_table, quoted

FANOUT = 16
#: The range of null ids, before all others.
NO_ID = -(1 << 47) - 1
#: From so many ids on, a range's bitmap is shorter than the sorted array.
DENSE = 4096
#: Ranges in one step of the upper level of sums.
STEP_BITS = 12
#: Ids that a task gathers before it makes bitmaps of them.
GATHER = 1_000_000
PROOF = "array<struct<left:string,right:string>>"


def leaf_hash(columns: list[Column]) -> Column:
    """SHA-256 (hex) of values: `-` for null, else the UTF-8 byte count, `:` and the value; integers in decimal."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]), 256)


def container(low: np.ndarray) -> bytes:
    """Distinct ascending 16-bit numbers, compressed: 8,192 bytes are a bitmap, fewer a sorted array."""
    if len(low) < DENSE:
        return low.astype("<u2").tobytes()
    bits = np.zeros(65_536, bool)
    bits[low] = True
    return np.packbits(bits, bitorder="little").tobytes()


def contents(raw: bytes) -> np.ndarray:
    if len(raw) < 8192:
        return np.frombuffer(raw, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")).astype("<u2")


def rank(raw: bytes, low: np.ndarray) -> np.ndarray:
    """How many numbers of a container are below each of `low`: its directory of popcounts, and the bits of one word."""
    if len(raw) < 8192:
        return np.searchsorted(np.frombuffer(raw, "<u2"), low)
    words = np.frombuffer(raw, "<u8")
    directory = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    below = (np.uint64(1) << (low & 63).astype(np.uint64)) - np.uint64(1)
    return directory[low >> 6] + np.bitwise_count(words[low >> 6] & below)


def bitmaps(ids: DataFrame) -> DataFrame:
    """(grp, chunk, low) -> (grp, chunk, n, bits, again, extra): a row for each group and range of ids, with the ids that recur."""
    out = pa.schema([("grp", pa.string()), ("chunk", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("again", pa.binary()), ("extra", pa.binary())])

    def row(grp, chunk, low, n):
        more = n > 1
        return {"grp": grp, "chunk": chunk, "n": int(n.sum()), "bits": container(low), "again": low[more].astype("<u2").tobytes(), "extra": (n[more] - 1).astype("<i8").tobytes()}

    def counts(r):
        low = contents(r["bits"])
        n = np.ones(len(low), np.int64)
        n[np.searchsorted(low, np.frombuffer(r["again"], "<u2"))] += np.frombuffer(r["extra"], "<i8")
        return low, n

    def parts(held):
        t = pa.Table.from_batches(held).group_by(["grp", "chunk", "low"]).aggregate([([], "count_all")]).sort_by([("grp", "ascending"), ("chunk", "ascending"), ("low", "ascending")])
        grp, chunk, low, n = t["grp"].combine_chunks().dictionary_encode(), *(t[c].to_numpy() for c in ("chunk", "low", "count_all"))
        code = pc.fill_null(grp.indices, -1).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1]), [True]]))
        names = grp.dictionary.to_pylist()
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield row(None if code[lo] < 0 else names[code[lo]], int(chunk[lo]), low[lo:hi], n[lo:hi])

    def some(rows, size=2000):
        held = []
        for r in rows:
            held.append(r)
            if len(held) >= size:
                yield pa.RecordBatch.from_pylist(held, out)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, out)

    def made(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= GATHER:
                yield from some(parts(held))
                held, size = [], 0
        if size:
            yield from some(parts(held))

    def merged(batches):
        def one(key, rows):
            low, n = counts(next(rows))
            for r in rows:  # one by one, so that no more than two bitmaps are held
                more, m = counts(r)
                both, of = np.unique(np.concatenate([low, more]), return_inverse=True)
                low, n = both, np.bincount(of, np.concatenate([n, m]), len(both)).astype(np.int64)
            return row(*key, low, n)

        rows = (r for b in batches for r in b.to_pylist())
        yield from some(one(key, own) for key, own in groupby(rows, lambda r: (r["grp"], r["chunk"])))

    kinds = "grp string, chunk long, n long, bits binary, again binary, extra binary"
    return ids.mapInArrow(made, kinds).repartition("grp", "chunk").sortWithinPartitions("grp", "chunk").mapInArrow(merged, kinds)


def directory(maps: DataFrame) -> DataFrame:
    """Bitmaps with `base`, the group's rows before the range, and `total`, the group's rows; sums in two levels."""
    step = F.shiftright("chunk", STEP_BITS).alias("step")
    steps = maps.groupBy("grp", step).agg(F.sum("n").alias("rows"))
    own = Window.partitionBy("grp")
    steps = steps.select(F.col("grp").alias("g"), F.col("step").alias("s"), (F.sum("rows").over(own.orderBy("step")) - F.col("rows")).alias("before"), F.sum("rows").over(own).alias("total"))
    within = F.sum("n").over(Window.partitionBy("grp", "step").orderBy("chunk")) - F.col("n")
    placed = maps.withColumn("step", step).withColumn("within", within)
    return placed.join(steps, F.col("grp").eqNullSafe(F.col("g")) & (F.col("step") == F.col("s"))).select("grp", "chunk", "bits", "again", "extra", (F.col("before") + F.col("within")).alias("base"), "total")


def placed(leaves: DataFrame, index: DataFrame) -> DataFrame:
    """Leaves (grp, chunk, low, ...) with `rank` (the group's rows of smaller ids), `n` (the group's rows) and `tied`."""
    fields, extra = [f for f in leaves.schema if f.name not in ("grp", "chunk")], ["bits", "again", "extra", "base", "total"]
    lone = [index[c] if c in extra else F.lit(None) for c in extra]
    a = index.select("grp", "chunk", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields], *lone)
    b = leaves.select("grp", "chunk", *quoted([f.name for f in fields]), *[F.lit(None).cast(index.schema[c].dataType).alias(c) for c in extra])
    both = a.union(b).repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", F.col("bits").asc_nulls_last())

    def ranked(batches):
        bits, again, sums, base, total = b"", np.empty(0, "<u2"), np.zeros(1, np.int64), 0, 0
        for b in batches:
            heads = np.flatnonzero(pc.is_valid(b["bits"]).to_numpy(zero_copy_only=False))
            low = pc.fill_null(b["low"], 0).to_numpy(zero_copy_only=False)
            at, n, tied = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64), np.zeros(len(low), bool)
            for lo, hi in zip([-1, *heads.tolist()], [*heads.tolist(), len(low)]):
                if lo >= 0:
                    bits, base, total = b["bits"][lo].as_py(), b["base"][lo].as_py(), b["total"][lo].as_py()
                    again, sums = np.frombuffer(b["again"][lo].as_py(), "<u2"), np.concatenate([[0], np.cumsum(np.frombuffer(b["extra"][lo].as_py(), "<i8"))])
                if hi > lo + 1:
                    own = low[lo + 1 : hi]
                    before = np.searchsorted(again, own)
                    at[lo + 1 : hi], n[lo + 1 : hi] = base + rank(bits, own) + sums[before], total
                    tied[lo + 1 : hi] = np.append(again, 0)[before] == own if len(again) else False
                    tied[lo + 1 : hi] &= before < len(again)
            keep = pc.is_null(b["bits"])
            columns = [b[f.name] for f in fields]
            out = pa.RecordBatch.from_arrays([b["grp"], *columns, pa.array(at), pa.array(n), pa.array(tied)], ["grp", *[f.name for f in fields], "rank", "n", "tied"])
            yield out.filter(keep)

    kinds = T.StructType([T.StructField("grp", T.StringType()), *[T.StructField(f.name, f.dataType) for f in fields], T.StructField("rank", T.LongType()), T.StructField("n", T.LongType()), T.StructField("tied", T.BooleanType())])
    return both.mapInArrow(ranked, kinds)


def upper(n: Column) -> Column:
    """Nodes of the level above n nodes."""
    return F.floor((n + (FANOUT - 1)) / FANOUT).cast("long")


def levels(nodes: DataFrame, by: list[str], most: int, name: str) -> list[DataFrame]:
    """Nodes (by, idx, n, node struct with `digest`) -> for each level its runs (by, run, n, slots), while a group has more than one node.

    most: the largest n. A run is a grouping of at most sixteen nodes; its slots are in the order of their places.
    """
    out = []
    while most > 1:
        slot = F.struct((F.col("idx") % FANOUT).alias("slot"), F.col("node"))
        runs = nodes.where("n > 1").groupBy(*by, F.floor(F.col("idx") / FANOUT).cast("long").alias("run")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(slot)).alias("slots"))
        out.append(as_table(runs.withColumn("slots", F.col("slots.node")), f"{name}-{len(out)}"))
        nodes = out[-1].select(*by, F.col("run").alias("idx"), upper(F.col("n")).alias("n"), F.struct(F.sha2(F.array_join("slots.digest", ""), 256).alias("digest")).alias("node"))
        most = -(-most // FANOUT)
    return out


def tops(nodes: DataFrame, runs: list[DataFrame], by: list[str]) -> DataFrame:
    """The one node that each group comes to: (by, digest)."""
    found = nodes.where("n = 1").select(*by, "node.digest")
    for r in runs:
        found = found.union(r.where(upper(F.col("n")) == 1).select(*by, F.sha2(F.array_join("slots.digest", ""), 256)))
    return found


def siblings(digests: Column, slot: Column) -> Column:
    """What stands left and right of a slot in a run."""
    slot = slot.cast("int")
    return F.struct(F.array_join(F.slice(digests, 1, slot), "").alias("left"), F.array_join(F.slice(digests, slot + 2, FANOUT), "").alias("right"))


def handed_down(nodes: DataFrame, runs: list[DataFrame], by: list[str], above: DataFrame) -> DataFrame:
    """Each lowest node (by, node) with `path`, the siblings of all levels up to its group's top and `above` (by, path, ...) from there."""
    more = [c for c in above.columns if c not in (*by, "path")]

    def same(a: DataFrame, b: DataFrame) -> Column:
        cond = F.lit(True)
        for c in by:
            cond = cond & a[c].eqNullSafe(b[c])
        return cond

    top = lambda rows: rows.join(above, same(rows, above)).select(*[rows[c] for c in rows.columns], "path", *more)
    upward = None
    for r in reversed(runs):
        ended = top(r.where(upper(F.col("n")) == 1))
        if upward is not None:
            here, up = r.where(upper(F.col("n")) > 1), upward.select(*by, F.col("run").alias("up_run"), F.col("slots.digest").alias("up"), F.col("path").alias("up_path"), *more)
            on = same(here, up) & (F.floor(here["run"] / FANOUT).cast("long") == up["up_run"])
            path = F.concat(F.array(siblings(F.col("up"), here["run"] % FANOUT)), F.col("up_path"))
            ended = ended.union(here.join(up, on).select(*[here[c] for c in r.columns], path.alias("path"), *more))
        upward = ended
    lone = top(nodes.where("n = 1").select(*by, "node"))
    if upward is None:
        return lone
    each = upward.select(*by, F.posexplode("slots").alias("slot", "node"), F.col("slots.digest").alias("digests"), "path", *more)
    return lone.union(each.select(*by, "node", F.concat(F.array(siblings(F.col("digests"), F.col("slot"))), F.col("path")).alias("path"), *more))


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """rows with `idx`, their number in the order of a column (null first, strings by UTF-8 bytes), and `n`, how many there are.

    A range-partitioned sort numbers the rows within partitions; partitions are few, and their sums are joined back.
    """
    ordered = as_table(rows.orderBy(F.col(column).asc_nulls_first()).withColumn("m", F.monotonically_increasing_id()), "order")
    part = F.shiftright("m", 33)
    parts = ordered.groupBy(part.alias("p")).agg(F.count("*").alias("c"))
    parts = parts.select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy()).alias("n"))
    return ordered.join(F.broadcast(parts), part == F.col("p")).select(*rows.columns, (F.col("before") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("idx"), "n")  # a row for each partition


def prove(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", group: str = "source", carry: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, source, leaf, the carried columns, subroot, root and proof (array of left and right siblings, level by level).

    Leaves of a group ascend by id, a null id first; rows of one id by their leaf, so equal rows are interchangeable. A null group
    is a group, the first. A tree of one leaf is that leaf, with an empty path. carry: small expressions over docs' columns, kept
    with the leaf. Other columns are not read. An empty table has no leaves and gives an empty one.
    """
    spark, names = docs.sparkSession, list(carry or {})
    doc_id = F.col(key).cast("long")
    base = docs.select(
        F.col(group).cast("string").alias("grp"), F.coalesce(F.shiftright(doc_id, 16), F.lit(NO_ID)).alias("chunk"), F.coalesce(doc_id.bitwiseAND(65_535), F.lit(0)).cast("int").alias("low"),
        F.struct(leaf_hash([F.col(c) for c in quoted(list(fields))]).alias("digest"), doc_id.alias("id"), *[e.alias(f"carried_{k}") for k, e in enumerate((carry or {}).values())]).alias("node"),
    )
    leaves = as_table(base.select("grp", "chunk", "low", "node.*"), "leaves")
    index = as_table(directory(bitmaps(leaves.select("grp", "chunk", "low"))), "directory")
    size = index.agg(F.max("total"), F.count_distinct("grp"), F.max(F.col("grp").isNull().cast("int"))).first()
    found = as_table(placed(leaves, index), "ranks")
    nth = F.row_number().over(Window.partitionBy("grp", "id").orderBy("digest")) - 1
    node = F.struct("digest", *[c for c in leaves.columns if c not in ("grp", "chunk", "low", "digest")]).alias("node")
    nodes = found.where("not tied").select("grp", F.col("rank").alias("idx"), "n", node).union(found.where("tied").select("grp", (F.col("rank") + nth).alias("idx"), "n", node))

    runs = levels(nodes, ["grp"], size[0] or 0, "runs")
    roots = numbered(tops(nodes, runs, ["grp"]), "grp").select("idx", "n", F.struct("digest", "grp").alias("node"))
    upper_runs = levels(roots, [], size[1] + (size[2] or 0), "upper")
    root = tops(roots, upper_runs, []).first()
    nothing = spark.range(1).select(F.array().cast(PROOF).alias("path"), F.lit(root and root["digest"]).alias("root"))
    above = handed_down(roots, upper_runs, [], nothing).select("node.grp", "path", F.col("node.digest").alias("subroot"), "root")
    proven = handed_down(nodes, runs, ["grp"], as_table(above, "roots"))
    return proven.select(F.col("node.id").alias(key), F.col("grp").alias(group), F.col("node.digest").alias("leaf"), *[F.col(f"node.carried_{k}").alias(c) for k, c in enumerate(names)], "subroot", "root", F.col("path").alias("proof"))


def proof_hash(proof: Column) -> Column:
    """SHA-256 of a proof's siblings, in order."""
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings come to."""
    return F.aggregate(proof, leaf, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))

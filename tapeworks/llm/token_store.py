"""Token ids in binary shards with a minimal perfect hash index.

A store is a folder of shards in ascending key order. A shard has three files:

* `.bin`: the ids of its documents, one after the other, as little-endian unsigned integers of 16 bits, or of 32 if the
  vocabulary needs them (the manifest has the width in bytes);
* `.idx`: a minimal perfect hash over its distinct keys (levels of bit arrays; a key's slot is the rank of its bit), and for
  each slot a 32-bit fingerprint of the key and the number of its first record, then the records' offsets into `.bin`;
* `.key`: the keys in record order, for scans.

`manifest` (Parquet, written last by Spark's own committer) has a row for each shard: its files, first and last key, documents
and ids. Tasks write to names of their own, so a task that runs again or twice leaves files that no manifest names. Paths
are URIs, opened with pyarrow's file systems.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut
from .tokens import encoder

MANIFEST = "shard string, pos long, first_key string, last_key string, docs long, ids long, width int"


def open_fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(uri)


def key_hash(keys: list[str], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k, seed) for k in keys), np.uint64, len(keys))


def key_name(key) -> str:
    """A null key has a name that no other key has."""
    return "null" if key is None else f"={key}"


class PerfectHash:
    """Minimal perfect hash over 64-bit key hashes: each level holds a bit for every key that lands there alone; the rest go on.

    A slot is the number of bits set before the key's bit. Keys that were not given get some slot or none.
    """

    GAMMA = 2

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # boolean arrays
        self.ranks, before = [], 0
        for bits in levels:
            self.ranks.append(before + np.concatenate(([0], np.cumsum(bits, dtype=np.int64)[:-1])))
            before += int(bits.sum())
        self.n = before

    @staticmethod
    def _at(h: np.ndarray, level: int, size: int) -> np.ndarray:
        x = h ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        return (x % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        if len(np.unique(h)) != len(h):
            raise ValueError("two keys have one hash: build with another seed")
        levels = []
        while len(h):
            size = max(64, cls.GAMMA * len(h))
            at = cls._at(h, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            h = h[~alone[at]]
        return cls(levels)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """-1: certainly not a key."""
        out, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, bits in enumerate(self.levels):
            at = self._at(h[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = self.ranks[level][at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = json.dumps([len(x) for x in self.levels]).encode()
        return len(head).to_bytes(4, "little") + head + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n = int.from_bytes(raw[:4], "little")
        at, levels = 4 + n, []
        for size in json.loads(raw[4 : 4 + n]):
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, (size + 7) // 8, at), count=size).astype(bool))
            at += (size + 7) // 8
        return cls(levels)


class ShardIndex:
    """Constant-time lookup of a shard's keys: hash, slot, fingerprint, first record; records of one key lie together."""

    def __init__(self, seed: int, mph: PerfectHash, prints: np.ndarray, first: np.ndarray, counts: np.ndarray, offsets: np.ndarray):
        self.seed, self.mph, self.prints, self.first, self.counts, self.offsets = seed, mph, prints, first, counts, offsets

    @classmethod
    def build(cls, keys: list[str], offsets: np.ndarray) -> ShardIndex:
        """keys: of each record, equal ones together. offsets: ids before each record, and the total."""
        names = list(dict.fromkeys(keys))
        place, starts = {}, []
        for r, k in enumerate(keys):
            if k not in place:
                place[k] = len(starts)
                starts.append(r)
        for seed in range(8):
            try:
                mph = PerfectHash.build(key_hash(names, seed))
                break
            except ValueError:
                continue
        slots = mph.slots(key_hash(names, seed))
        prints, first, counts = np.zeros(len(names), "<u4"), np.zeros(len(names), "<i8"), np.zeros(len(names), "<i8")
        prints[slots] = key_hash(names, seed + 100).astype(np.uint32)
        first[slots] = starts
        counts[slots] = np.diff([*starts, len(keys)])
        return cls(seed, mph, prints, first, counts, np.asarray(offsets, "<i8"))

    def find(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; -1 and 0 for keys that are not there (but for 1 in 2^32)."""
        if not self.mph.n:
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        slots = self.mph.slots(key_hash(keys, self.seed))
        there = (slots >= 0) & (self.prints[slots] == key_hash(keys, self.seed + 100).astype(np.uint32))
        return np.where(there, self.first[slots], -1), np.where(there, self.counts[slots], 0)

    def to_bytes(self) -> bytes:
        mph = self.mph.to_bytes()
        head = np.array([self.seed, len(mph), len(self.prints), len(self.offsets)], "<i8").tobytes()
        return head + mph + self.prints.tobytes() + self.first.tobytes() + self.counts.tobytes() + self.offsets.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> ShardIndex:
        seed, m, n, r = np.frombuffer(raw, "<i8", 4).tolist()
        at = 32 + m
        parts = [np.frombuffer(raw, kind, size, at + skip) for kind, size, skip in (("<u4", n, 0), ("<i8", n, 4 * n), ("<i8", n, 12 * n), ("<i8", r, 20 * n))]
        return cls(seed, PerfectHash.from_bytes(raw[32 : 32 + m]), *parts)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 1 << 26) -> DataFrame:
    """Encodes every whole text (null: empty), appends end_id and writes a store in ascending key order (nulls first); returns its manifest.

    A task begins another shard after `shard_ids` ids, where the key changes: so a shard's index, which a task holds, is
    bounded, and a key lies in one shard. Rows of equal key stand side by side, in the order of their texts. Other columns,
    whatever their names, are not written. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    ordered = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    ordered = ordered.repartitionByRange(F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), F.col("text"))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = open_fs(folder)
        enc, pos = encoder(tokenizer, end_id), TaskContext.get().partitionId() << 24
        raw, sizes, out, name = [], [], None, ""

        def close() -> pa.RecordBatch:
            nonlocal out, pos
            out.close()
            out, pos, keys = None, pos + 1, [key_name(k) for k in raw]
            with fs.open_output_stream(f"{root}/{name}.idx") as f:
                f.write(ShardIndex.build(keys, np.cumsum([0, *sizes])).to_bytes())
            table = pa.table({"key": pa.array(raw, kind)})
            with fs.open_output_stream(f"{root}/{name}.key") as f, pa.ipc.new_file(f, table.schema) as w:
                w.write_table(table)
            return pa.RecordBatch.from_pydict({"shard": [name], "pos": [pos - 1], "first_key": [keys[0]], "last_key": [keys[-1]], "docs": [len(keys)], "ids": [sum(sizes)], "width": pa.array([enc.width], pa.int32())})

        for b in batches:
            kind, keys = b["key"].type, b["key"].to_pylist()
            for some, encoded in enc.stepwise(b["text"]):
                if out is not None and sum(sizes) >= shard_ids and keys[some.start] != raw[-1]:
                    yield close()
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name, raw, sizes = f"shard-{uuid.uuid4().hex}", [], []
                    out = fs.open_output_stream(f"{root}/{name}.bin")
                raw += keys[some]
                sizes += [len(ids) // 4 for ids in encoded]
                ids = b"".join(encoded)
                out.write(ids if enc.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())
        if out is not None:
            yield close()

    ordered.mapInArrow(shards, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str, key_type: str = "bigint", with_ids: bool = False) -> DataFrame:
    """Reads a store back: key, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids (binary).

    A shard's keys go through its index to their records; a key without its record is an error. The running total of ids
    runs over the manifest alone, a row for each shard.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    base = manifest.withColumn("base", F.coalesce(F.sum("ids").over(W.orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    base = cut(base.select("shard", "base", "width", "pos"))
    base = base.repartitionByRange(max(1, base.count()), "pos").drop("pos")  # a task for each shard
    fields = f"key {key_type}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    fresh = pa.schema([("key", pa.int64() if key_type == "bigint" else pa.string()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)

    def records(batches):
        fs, root = open_fs(folder)
        for b in batches:
            for name, before, width in zip(b["shard"].to_pylist(), b["base"].to_pylist(), b["width"].to_pylist()):
                with fs.open_input_file(f"{root}/{name}.idx") as f:
                    index = ShardIndex.from_bytes(f.read())
                with fs.open_input_file(f"{root}/{name}.key") as f:
                    keys = pa.ipc.open_file(f).read_all()["key"].to_pylist()
                names = [key_name(k) for k in keys]
                first, count = index.find(names)
                if (first < 0).any():
                    raise ValueError(f"{name}: a key has no record")
                again: dict[str, int] = {}
                with fs.open_input_file(f"{root}/{name}.bin") as data:
                    for at in range(0, len(keys), 2048):
                        rows = []
                        for k, name_, r, n in zip(keys[at : at + 2048], names[at : at + 2048], first[at : at + 2048].tolist(), count[at : at + 2048].tolist()):
                            if n > 1:
                                again[name_] = nth = again.get(name_, -1) + 1
                                r += nth
                            lo, hi = int(index.offsets[r]), int(index.offsets[r + 1])
                            data.seek(width * lo)
                            ids = data.read(width * (hi - lo))
                            ids = ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                            rows.append((k, before + lo, hi - lo, zlib.crc32(ids), *[ids] * with_ids))
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), fresh.types)], schema=fresh)

    return base.mapInArrow(records, fields)


def lookup_tokens(spark: SparkSession, folder: str, keys: DataFrame, key_col: str = "key") -> DataFrame:
    """(key, n_records, n_tokens of the first) of the given keys, each looked up in the one shard that may have it.

    Absent keys are left out, repeated ones count once. Keys meet shards by an as-of join with the shards' first keys: keys
    and shards are sorted together by ranges, and what a range must know of those before it is one shard. Keys have the type
    of the store's.
    """
    kind = keys.schema[key_col].dataType
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    first = F.when(F.col("first_key").startswith("="), F.substring("first_key", 2, 1 << 30)).cast(kind)  # else null, which comes first
    rows = manifest.select(first.alias("key"), "shard").union(keys.select(F.col(key_col).alias("key"), F.lit(None).cast("string")).distinct())
    order = (F.col("key").asc_nulls_first(), F.col("shard").asc_nulls_last())
    rows = cut(rows.repartitionByRange(order[0]).withColumn("range", F.spark_partition_id()))
    ends = rows.where("shard is not null").groupBy("range").agg(F.max_by("shard", F.struct(F.col("key").isNotNull(), "key")).alias("last"))
    ends = rows.select("range").distinct().join(ends, "range", "left")
    ends = ends.select("range", F.last("last", True).over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)).alias("before"))  # a row for each range
    asked = rows.withColumn("own", F.last("shard", True).over(W.partitionBy("range").orderBy(*order))).where("shard is null").join(ends, "range")
    pairs = asked.select("key", F.coalesce("own", "before").alias("shard")).where("shard is not null")

    def found(batches):
        fs, root = open_fs(folder)
        held, index = None, None
        for b in batches:
            for name, key in zip(b["shard"].to_pylist(), b["key"].to_pylist()):
                if name != held:
                    with fs.open_input_file(f"{root}/{name}.idx") as f:
                        held, index = name, ShardIndex.from_bytes(f.read())
                first, n = index.find([key_name(key)])
                if n[0]:
                    yield pa.RecordBatch.from_pydict({"key": pa.array([key], b["key"].type), "n_records": [int(n[0])], "n_tokens": [int(index.offsets[first[0] + 1] - index.offsets[first[0]])]})

    return pairs.repartition("shard").sortWithinPartitions("shard").mapInArrow(found, f"key {kind.simpleString()}, n_records long, n_tokens long")

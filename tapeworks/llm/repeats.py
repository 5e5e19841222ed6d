"""Exact repeats of word windows across and within documents, by anchors on a fixed grid.

Every document is cut into non-overlapping blocks of ten words, which are indexed; every rolling window of ten words probes
that index. Of two equal windows of twenty words, each covers a whole block of its own, and the other one's rolling window at
the same place is equal to it: so each of the two has a hit (a hit on a block's own place asks for a second equal block). A hit
is extended to the windows of twenty words around it, which are compared by 128 bits; windows whose words start earlier join up
to maximal repeats.

No pairs are made. A task gathers about a million windows (a flush), folds equal ones, and sends each distinct one to the bucket
of its hash once, so that a passage of a third of all documents is a row a flush. A bucket gets its blocks first and then
streams the probes past them; for the exact comparison flushes are in the order of documents, so that a bucket keeps each
distinct window as it first comes and answers for all later ones. Answers go back by flush. The number of buckets follows the
bytes of text, so that what a bucket holds is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_table

WINDOW = 20
#: Windows that a task folds and sends at once.
FLUSH = 1 << 20
#: Bytes of text for one bucket of hashes.
BUCKET_BYTES = 3_000_000
#: Hashes that a bucket gathers before it folds them.
GATHER = 1 << 21

#: A row is a flush's size and equal windows (kind 0), what a flush sends to a bucket (1 to 3) or what is known of it there (4), or a document of it (5).
ROW = "bucket int, kind int, flush long, first long, n long, doc_id long, digest binary, nth int, a binary, b binary, at binary"
NAMES = [x.split()[0] for x in ROW.split(", ")]
TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
SCHEMA = pa.schema([(x.split()[0], TYPES[x.split()[1]]) for x in ROW.split(", ")])
SIZES, BLOCKS, PROBES, ALIGNED, KNOWN, DOC = range(6)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it, the shuffle files of a write go when the write ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def joined(a: np.ndarray, words: int, b: np.ndarray) -> np.ndarray:
    """Hashes of a[i] followed by b[i + words]: of runs of words whose first part has `words` of them."""
    n = max(0, min(len(a), len(b) - words))
    h = a[:n] * np.uint64(0x9E3779B97F4A7C15) + b[words : words + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` consecutive words, from the words' hashes (one row a word, any number of columns), by doubling."""
    out, have, power, span = None, 0, words, 1
    while True:
        if size & span:
            out, have = (power, span) if out is None else (joined(out, have, power), have + span)
        span *= 2
        if span > size:
            return out
        power = joined(power, span // 2, power)


def ascending(x: np.ndarray) -> bytes:
    """Ascending places of a flush, as steps of 16 bits where that will do."""
    steps = np.diff(x, prepend=0)
    wide = len(x) and steps.max() > 65_535
    return bytes([bool(wide)]) + steps.astype("<u4" if wide else "<u2").tobytes()


def places(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, "<u4" if raw[0] else "<u2", offset=1), dtype=np.int64)


def own_bucket(flush: int, bits: int) -> int:
    """Where a flush's rows go that no bucket answers: tasks' flushes in turn."""
    return (flush + (flush >> 32)) % (1 << bits)


def batches_of(rows: Iterator[dict], size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += 60 + sum(len(r.get(k) or b"") for k in ("a", "b", "at"))
        if n >= size:
            yield pa.RecordBatch.from_pylist(held, SCHEMA)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, SCHEMA)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def sent(kind: int, flush: int, bits: int, h: np.ndarray, at: np.ndarray | None, also: np.ndarray | None = None) -> Iterator[dict]:
    """Rows of (a part of) the hashes of a flush for each bucket: in the order of their places, or of themselves."""
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
    order = np.lexsort((h if at is None else at, bucket))
    bucket, h = bucket[order], h[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << bits))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        row = {"bucket": int(bucket[lo]), "kind": kind, "flush": flush, "a": (h[lo:hi].astype("<u4") if also is None else h[lo:hi]).tobytes()}
        if at is not None:
            row["at"] = ascending(at[order[lo:hi]])
        if also is not None:
            row["b"] = also[order[lo:hi]].tobytes()
        yield row


def anchors(bits: int, window: int, flush_size: int):
    """(doc_id, digest, text) -> rows: blocks and probes of a flush by bucket, and what is known without asking."""
    block = window // 2

    def flushed(number: int, docs: list, held: list) -> Iterator[dict]:
        h, grid = np.concatenate([x for x in held]), np.concatenate([np.arange(len(x)) % block == 0 for x in held])
        uniq, first, of, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        n_grid = np.bincount(of, grid, len(uniq)).astype(np.int64)
        yield {"bucket": own_bucket(number, bits), "kind": SIZES, "flush": number, "n": len(h), "a": first[of[first[of] != np.arange(len(h))]].astype("<u4").tobytes(), "at": ascending(np.flatnonzero(first[of] != np.arange(len(h))))}
        known = (n_grid > 0) & (n > 1)
        yield {"bucket": own_bucket(number, bits), "kind": KNOWN, "flush": number, "at": ascending(np.sort(first[known]))}
        yield from sent(BLOCKS, number, bits, np.concatenate([uniq[n_grid > 0], uniq[n_grid > 1]]), None)
        for kind, some in ((PROBES, n_grid == 0), (ALIGNED, (n_grid == 1) & ~known)):
            yield from sent(kind, number, bits, uniq[some], first[some])
        for k, (doc_id, digest, lo, size) in enumerate(docs):
            yield {"bucket": own_bucket(number, bits), "kind": DOC, "flush": number, "first": lo, "n": size, "doc_id": doc_id, "digest": digest}

    def rows(batches) -> Iterator[dict]:
        number, docs, held, size = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for doc_id, digest, text in zip(b.column("doc_id").to_pylist(), b.column("digest").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                if len(words) < window:
                    continue
                held.append(rolling(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), block))
                docs.append((doc_id, digest, size, len(held[-1])))
                size += len(held[-1])
                if size >= flush_size:
                    yield from flushed(number, docs, held)
                    number, docs, held, size = number + 1, [], [], 0
        if size:
            yield from flushed(number, docs, held)

    return lambda batches: batches_of(rows(batches))


def within(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in an ascending array."""
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return known[at] == x


def probe(gather: int):
    """A bucket's rows, blocks first: probes that meet a block are known hits of their flush; other rows pass."""

    def folded(once: np.ndarray, twice: np.ndarray, more: list) -> tuple[np.ndarray, np.ndarray]:
        x, n = np.unique(np.concatenate(more), return_counts=True)
        return np.union1d(once, x), np.union1d(twice, np.concatenate([x[n > 1], np.intersect1d(once, x, True)]))

    def found(rows) -> Iterator[dict]:
        for _, own in groupby(rows, lambda r: r["bucket"]):
            once = twice = np.empty(0, "<u4")
            more, size = [], 0
            for r in own:
                if r["kind"] == BLOCKS:
                    more.append(np.frombuffer(r["a"], "<u4"))
                    size += len(more[-1])
                elif r["kind"] not in (PROBES, ALIGNED):
                    yield r
                    continue
                if more and (size > gather or r["kind"] != BLOCKS):
                    once, twice = folded(once, twice, more)
                    more, size = [], 0
                if r["kind"] != BLOCKS:
                    hit = within(np.frombuffer(r["a"], "<u4"), once if r["kind"] == PROBES else twice)
                    if hit.any():
                        yield {"flush": r["flush"], "kind": KNOWN, "at": ascending(places(r["at"])[hit])}

    return lambda batches: batches_of(found(rows_of(batches)))


def by_flush(rows: Iterator[dict]) -> Iterator[tuple[np.ndarray, Iterator[dict]]]:
    """For each flush (rows by flush and kind), which of its places are known, equal ones included, and its documents."""
    for _, own in groupby(rows, lambda r: r["flush"]):
        head = next(own)
        bits, r = np.zeros(head["n"], bool), None
        for r in own:
            if r["kind"] == DOC:
                break
            bits[places(r["at"])] = True
        bits[places(head["at"])] |= bits[np.frombuffer(head["a"], "<u4")]

        def docs(r=r, own=own):
            yield r
            yield from own

        yield bits, docs()


def hit_documents(batches) -> Iterator[pa.RecordBatch]:
    """Rows by flush -> (doc_id, digest, a): the bits of a document's hits, for documents that have any."""
    rows = ({"doc_id": r["doc_id"], "digest": r["digest"], "a": np.packbits(own).tobytes()} for bits, docs in by_flush(rows_of(batches)) for r in docs if (own := bits[r["first"] : r["first"] + r["n"]]).any())
    yield from batches_of(rows)


def extended(bits: int, window: int, flush_size: int):
    """By (doc_id, digest): a document's hits, then its text -> its windows around hits, by bucket; windows that recur within a flush are known."""
    block = window // 2

    def flushed(number: int, docs: list, held: list) -> Iterator[dict]:
        h = np.concatenate(held)
        order = np.lexsort((h[:, 1], h[:, 0]))
        again = np.concatenate([[False], (h[order[1:]] == h[order[:-1]]).all(1)])
        first = np.sort(order[~again])
        yield {"bucket": own_bucket(number, bits), "kind": SIZES, "flush": number, "n": len(h), "a": b"", "at": ascending(first[:0])}
        yield {"bucket": own_bucket(number, bits), "kind": KNOWN, "flush": number, "at": ascending(np.sort(order[again]))}
        yield from sent(PROBES, number, bits, h[first, 0], first, h[first, 1])
        for row in docs:
            yield row | {"bucket": own_bucket(number, bits), "kind": DOC, "flush": number}

    def rows(batches) -> Iterator[dict]:
        number, docs, held, size = TaskContext.get().partitionId() << 32, [], [], 0
        key, hits, nth = None, None, 0
        for b in batches:
            for doc_id, digest, raw, text in zip(b.column("doc_id").to_pylist(), b.column("digest").to_pylist(), b.column("a").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                if key != (doc_id, digest):
                    key, hits, nth = (doc_id, digest), None, 0
                if raw is not None:
                    hits = np.frombuffer(raw, np.uint8) | (0 if hits is None else hits)  # rows of one id and text
                    continue
                nth += 1
                if hits is None:
                    continue
                words = text.split()
                n = len(words) - window + 1
                near = np.concatenate([[0], np.cumsum(np.unpackbits(hits)[: len(words) - block + 1], dtype=np.int64)])
                starts = np.flatnonzero(near[block : block + n] > near[:n])
                w = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
                held.append(rolling(w, window)[starts])
                docs.append({"first": size, "n": len(starts), "doc_id": doc_id, "digest": digest, "nth": nth, "at": ascending(starts)})
                size += len(starts)
                if size >= flush_size:
                    yield from flushed(number, docs, held)
                    number, docs, held, size = number + 1, [], [], 0
        if size:
            yield from flushed(number, docs, held)

    return lambda batches: batches_of(rows(batches))


def recurring(gather: int):
    """A bucket's rows by flush, so in the order of documents: windows that an earlier flush has are known; other rows pass."""

    def again(seen: np.ndarray, held: list) -> tuple[np.ndarray, list]:
        sizes = [len(x) for _, x, _ in held]
        h = np.concatenate([seen, *(x for _, x, _ in held)])
        order = np.lexsort((h[:, 1], h[:, 0]))
        same = np.concatenate([[False], (h[order[1:]] == h[order[:-1]]).all(1)])
        known = np.zeros(len(h), bool)
        known[order[same]] = True
        rows = [{"flush": f, "kind": KNOWN, "at": ascending(places(at)[k])} for (f, _, at), k in zip(held, np.split(known[len(seen) :], np.cumsum(sizes)[:-1])) if k.any()]
        return h[order[~same]], rows

    def found(rows) -> Iterator[dict]:
        for _, own in groupby(rows, lambda r: r["bucket"]):
            seen, held, size = np.empty((0, 2), "<u8"), [], 0
            for r in own:
                if r["kind"] != PROBES:
                    yield r
                    continue
                held.append((r["flush"], np.stack([np.frombuffer(r["a"], "<u8"), np.frombuffer(r["b"], "<u8")], 1), r["at"]))
                size += len(held[-1][1])
                if size > gather:
                    seen, out = again(seen, held)
                    yield from out
                    held, size = [], 0
            if held:
                yield from again(seen, held)[1]

    return lambda batches: batches_of(found(rows_of(batches)))


def maximal(window: int):
    """Rows by flush -> (doc_id, digest, nth, starts, ends): the words that recurring windows cover, joined where they meet."""

    def spans(batches) -> Iterator[pa.RecordBatch]:
        held = []
        for bits, docs in by_flush(rows_of(batches)):
            for r in docs:
                at = places(r["at"])[bits[r["first"] : r["first"] + r["n"]]]
                if len(at):
                    cuts = np.flatnonzero(np.diff(at) > window)
                    held.append({"doc_id": r["doc_id"], "digest": r["digest"], "nth": r["nth"], "starts": at[np.concatenate([[0], cuts + 1])].tolist(), "ends": (at[np.concatenate([cuts, [len(at) - 1]])] + window).tolist()})
                if len(held) >= 2000:
                    yield pa.RecordBatch.from_pylist(held, out)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, out)

    out = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("nth", pa.int32()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
    return spans


def exact_repeats(docs: DataFrame, window: int = WINDOW, flush: int = FLUSH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, digest, nth, starts, ends): the maximal spans of words, each covered by windows of `window`
    words whose sequence also starts earlier (a smaller doc_id, or the same document and an earlier start).

    digest is the text's MD5; documents of one id are in the order of it, a null id comes before all others, and rows equal in id
    and text are documents of their own, numbered by nth. Only documents with a span have a row. Null, empty and short texts
    (fewer words than a window) have none; other columns are not read. An empty table gives an empty one.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text").where("text is not null")
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, (size // bucket_bytes).bit_length())
    with shuffles_dropped(spark):
        asked = base.mapInArrow(anchors(bits, window, flush), ROW).repartition("bucket").sortWithinPartitions("bucket", "kind", "flush")
        known = asked.mapInArrow(probe(GATHER), ROW).repartition("flush").sortWithinPartitions("flush", "kind")
        hits = as_table(known.mapInArrow(hit_documents, ROW).select("doc_id", "digest", "a").distinct(), "hits")
        both = hits.select("doc_id", "digest", "a", F.lit(None).cast("string").alias("text")).union(base.select("doc_id", "digest", F.lit(None).cast("binary"), "text"))
        ordered = both.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest", F.col("a").asc_nulls_last())
        asked = ordered.mapInArrow(extended(bits, window, flush), ROW).repartition("bucket").sortWithinPartitions("bucket", "kind", "flush")
        known = asked.mapInArrow(recurring(GATHER), ROW).repartition("flush").sortWithinPartitions("flush", "kind", "first")
        return as_table(known.mapInArrow(maximal(window), "doc_id long, digest binary, nth int, starts array<long>, ends array<long>"), "repeats")


def without_repeats(docs: DataFrame, window: int = WINDOW, **sizes) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_words, n_removed, kept): each document's words without its exact repeats, joined by spaces.

    A row for each row; a null or empty text has no words and keeps an empty text. See exact_repeats for ties and odd input.
    """
    spans = exact_repeats(docs, window, **sizes)
    none = F.lit(None)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("digest"), none.cast("int").alias("nth"), none.cast("array<bigint>").alias("starts"), none.cast("array<bigint>").alias("ends"), F.coalesce("text", F.lit("")).alias("text"))
    both = base.union(spans.select("doc_id", "digest", "nth", "starts", "ends", none.cast("string")))

    def kept(batches):
        key, nth, gone = None, 0, {}
        for b in batches:
            ids, texts, out = b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()), []
            for k, (doc_id, digest, own, starts, ends) in enumerate(zip(ids, *(b.column(c).to_pylist() for c in ("digest", "nth", "starts", "ends")))):
                if key != (doc_id, digest):
                    key, nth, gone = (doc_id, digest), 0, {}
                if own is not None:
                    gone[own] = list(zip(starts, ends))
                    continue
                nth += 1
                words, left, at = texts[k].as_py().split(), [], 0
                for lo, hi in gone.pop(nth, ()):
                    left += words[at:lo]
                    at = hi
                left += words[at:]
                out.append((doc_id, len(words), len(words) - len(left), b" ".join(left)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return both.repartition("doc_id", "digest").sortWithinPartitions("doc_id", "digest", F.col("nth").asc_nulls_last()).mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept string")

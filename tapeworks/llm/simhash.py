"""Near-duplicate documents by SimHash fingerprints and a binary-trie self-join.

A fingerprint is one 64-bit SimHash (or several, each over its own hash of the shingles). Fingerprints that differ in at
most `budget` bits are found by descending a binary trie of their bits with pairs of nodes: a pair splits into its children,
children on different bits add one to the differing bits, and a pair over the budget is pruned. The trie is built once for
each of four rotations by 16 bits: of four blocks, at least one has no differing bit if there are at most three in all, so
each rotation's join starts from the nodes at depth 16 paired with themselves, and those nodes are what Spark deals out.
A node of very many fingerprints is cut into chunks, and pairs of chunks are dealt out.

What leaves a task is a spanning forest of the links it found (each fingerprint to the smallest one it reaches there), which
joins the same documents as all the links would; copies are folded into one fingerprint before the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from .common import as_table, connected_components, cut, merge, quoted

SEED = 42
LANES = np.uint64(0x0101010101010101)
#: Rows of one trie node (or chunk) that a task takes at once.
CHUNK_ROWS = 50_000
#: Shingles in one chunk of documents for exact comparison.
CHUNK_SHINGLES = 1_000_000
#: Rows of node pairs or candidate pairs that are expanded at once.
EXPAND = 1_000_000
#: Texts of at most this many distinct shingles find their near copies by the shingles themselves.
FEW = 80
#: Counters of the order of shingles by frequency; any number gives right results, more separate frequent shingles better.
COUNTERS = 65_536


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle of `size` words, in order, repeats included; of all words if there are fewer; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(joined, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    return np.fromiter((h(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :])), np.uint64, len(words) - size + 1)


def majorities(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each of some runs of h, the 64 bits that are set in over half of it; zero for an empty one.

    Sums run in eight byte-wide lanes over up to 255 hashes, then over the parts of a run.
    """
    out = np.zeros(len(sizes), np.uint64)
    runs = np.flatnonzero(sizes)
    if not len(runs):
        return out
    n = sizes[runs]
    parts = -(-n // 255)
    first = np.cumsum(parts) - parts
    at = np.repeat(np.cumsum(n) - n, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    counts = np.zeros((len(runs), 8, 8), np.int64)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & LANES, at).view(np.uint8).reshape(-1, 8)
        counts[:, :, bit] = np.add.reduceat(lanes, first, axis=0, dtype=np.int64)
    out[runs] = np.packbits((counts * 2 > n[:, None, None]).reshape(len(runs), 64), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def remix(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64-bit hash for k > 0, from the finaliser of SplitMix64; h itself for 0."""
    if not k:
        return h
    h = h + np.uint64(0x9E3779B97F4A7C15 * k % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def simhashes(sets: list[np.ndarray], words: int = 1, at_once: int = 60_000) -> np.ndarray:
    """sets x words: 64-bit SimHashes (as signed longs), each word over its own hash of the shingles. at_once: hashes, which fit a cache."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.zeros((len(sets), words), np.uint64)
    for part in np.split(np.arange(len(sets)), np.flatnonzero(np.diff(np.cumsum(sizes) // at_once)) + 1):
        if len(part):
            h = np.concatenate([sets[k] for k in part.tolist()])
            for k in range(words):
                out[part, k] = majorities(remix(h, k), sizes[part])
    return out.view(np.int64)


def fingerprint_column(text, shingle: int):
    """The 64-bit SimHash (as a signed long) of a text column; null or empty texts: zero."""

    @pandas_udf("bigint")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series(simhashes([shingle_hashes(t, shingle) for t in texts])[:, 0])

    return fingerprints(text)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def trie_pairs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int, depth: int = 16, other: tuple | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (i < j) whose 64-bit values differ in at most `budget` bits.

    values: ascending within each root node [start, end), all of whose values share their first `depth` bits. With
    other=(starts, ends) the roots are pairs of nodes, each row range of the first with one of the second.
    """
    stack = [(depth, starts, ends, *(other or (starts, ends)), np.zeros(len(starts), np.int64))]
    while stack:
        d, alo, ahi, blo, bhi, diff = stack.pop()
        if len(alo) > EXPAND:
            half = len(alo) // 2
            stack += [(d, *(x[:half] for x in (alo, ahi, blo, bhi, diff))), (d, *(x[half:] for x in (alo, ahi, blo, bhi, diff)))]
            continue
        small = ((ahi - alo) * (bhi - blo) <= 64) | (d == 64)
        if small.any():
            yield from _leaves(values, alo[small], ahi[small], blo[small], bhi[small], budget)
        big = ~small
        if not big.any():
            continue
        alo, ahi, blo, bhi, diff = (x[big] for x in (alo, ahi, blo, bhi, diff))
        ones = np.concatenate(([0], np.cumsum((values >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)))
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        same = alo == blo  # a node with itself: its children's cross pair counts once
        parts = [(alo, amid, blo, bmid, diff), (amid, ahi, bmid, bhi, diff), (alo, amid, bmid, bhi, diff + 1), tuple(x[~same] for x in (amid, ahi, blo, bmid, diff + 1))]
        nxt = [np.concatenate(x) for x in zip(*parts)]
        keep = (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & (nxt[4] <= budget)
        if keep.any():
            stack.append((d + 1, *(x[keep] for x in nxt)))


def _leaves(values, alo, ahi, blo, bhi, budget):
    na, nb = ahi - alo, bhi - blo
    at = 0
    while at < len(alo):
        upto = at + max(1, int(np.searchsorted(np.cumsum((na * nb)[at:]), EXPAND, "right")))
        a0, b0, n, w = alo[at:upto], blo[at:upto], (na * nb)[at:upto], nb[at:upto]
        at = upto
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        w = np.repeat(w, n)
        i, j = np.repeat(a0, n) + k // w, np.repeat(b0, n) + k % w
        keep = (i < j) & (popcount(values[i] ^ values[j]) <= budget)
        if keep.any():
            yield i[keep], j[keep]


def runs(batches: Iterator[pa.RecordBatch], keys: list, limit: int = 400_000) -> Iterator[dict[str, np.ndarray]]:
    """Columns of sorted batches, regrouped so that the rows of a key come together; many keys at once, up to `limit` rows unless one key has more.

    keys: columns, or functions of a table.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def columns(table):
        return {n: table[n].combine_chunks().to_numpy(zero_copy_only=False) for n in table.column_names}

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < limit:
            continue
        t = pa.Table.from_batches(held)
        last = np.ones(rows, bool)
        for k in keys:
            v = k(t) if callable(k) else t[k].to_numpy()
            last &= v == v[-1]
        n = rows - int(last[::-1].argmin() if not last.all() else rows)
        if n:
            yield columns(t.slice(0, n))
            held, rows = t.slice(n).combine_chunks().to_batches(), rows - n
    if rows:
        yield columns(pa.Table.from_batches(held))


def bounds(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], len(new))


def trie_links(prints: DataFrame, budget: int, total: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """prints (id bigint, words array<bigint>) -> links (src, dst): a spanning forest of the pairs found at each trie node.

    Each 64-bit word is joined within `budget` bits, from the roots of its four rotations. With `total`, pairs must besides
    differ in at most `total` bits over the word and the one after it (`words` has two at least). With three or fewer bits and
    one word nothing is missed; larger budgets give candidates for an exact check.
    """
    n = len(prints.select("words").first()["words"]) if prints.take(1) else 1
    rot = F.explode(F.array(*[F.struct(F.lit(4 * w + r).alias("tab"), (F.shiftleft(F.col("words")[w], 16 * r).bitwiseOR(F.shiftrightunsigned(F.col("words")[w], 64 - 16 * r)) if r else F.col("words")[w]).alias("val"), *([F.col("words")[(w + 1) % n].alias("nxt")] if total is not None else [])) for w in range(n) for r in range(4)]))
    spread = lambda df: df.select("id", rot.alias("r")).select("id", "r.*")
    rows, root = spread(prints), F.shiftrightunsigned("val", 48).cast("int")
    #: every sixteenth fingerprint tells how many chunks a node is cut into; any number gives the same links
    some = spread(prints.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(16)) == 0)).groupBy("tab", root.alias("root")).count()
    crowded = cut(some.select("tab", "root", F.ceil(F.col("count") * 16 / chunk_rows).cast("int").alias("chunks")).where("chunks > 1"))
    few = crowded.count()
    chunk = ["ca", "cb", "own"] if few else []
    if few:
        rows = rows.withColumn("root", root).join(F.broadcast(crowded) if few <= 10_000 else crowded, ["tab", "root"], "left")
        own = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
        rows = rows.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("mate", F.explode(F.expr("sequence(0, coalesce(chunks, 1) - 1)")))
        rows = rows.withColumn("ca", F.least("own", "mate")).withColumn("cb", F.greatest("own", "mate")).drop("root", "chunks", "mate")
    keys = ["tab", "root", "ca", "cb"]

    def links(batches):
        for c in runs(batches, ["tab", lambda t: t["val"].to_numpy() >> 48, *chunk[:2]]):
            val, ids = c["val"].view(np.uint64), c["id"]
            nxt = c["nxt"].view(np.uint64) if total is not None else None
            c |= {"root": (val >> np.uint64(48)).astype(np.int64)} | {k: c.get(k, np.zeros(len(ids), np.int64)) for k in ("ca", "cb", "own")}
            label = np.arange(len(ids))
            starts, ends = bounds(*(c[k] for k in keys), c["own"])
            inner = c["ca"][starts] == c["cb"][starts]
            found = [trie_pairs(val, starts[inner], ends[inner], budget)]
            if not inner.all():
                s, e = starts[~inner], ends[~inner]
                pair = np.flatnonzero(np.all([c[k][s[1:]] == c[k][s[:-1]] for k in keys], axis=0))
                found.append(trie_pairs(val, s[pair], e[pair], budget, 16, (s[pair + 1], e[pair + 1])))
            for pairs in found:
                for i, j in pairs:
                    if total is not None:
                        near = popcount(val[i] ^ val[j]) + popcount(nxt[i] ^ nxt[j]) <= total
                        i, j = i[near], j[near]
                    label = merge(label, i, j)
            linked = np.flatnonzero(label != np.arange(len(ids)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[label[linked]])], ["src", "dst"])

    dealt = rows.repartition("tab", root, *chunk[:2]).sortWithinPartitions("tab", root, *chunk, F.shiftrightunsigned("val", 32), F.col("val").bitwiseAND(F.lit(0xFFFFFFFF)))
    return dealt.mapInArrow(links, "src bigint, dst bigint")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 3) -> DataFrame:
    """One row per row of docs: its id, fingerprint (16 hex digits) and component_id.

    Words are lower-cased in A-Z, shingles keep repeats. Fingerprints at `budget` (up to 3) or fewer differing bits link;
    component_id is the smallest id that is reachable, itself included. Null, empty or blank texts have fingerprint zero and
    link like any other; null ids never name a component (a component of null ids alone has null). Repeated rows each stay.
    """
    if budget > 3:
        raise ValueError("four rotations prove completeness for 3 bits at most")
    own = docs.select(F.col(id_col), fingerprint_column(F.col(text_col), shingle).alias("fp"))
    own = as_table(own, "fingerprints")
    classes = own.groupBy("fp").agg(F.min(id_col).alias("least_id"))
    links = trie_links(classes.select(F.col("fp").alias("id"), F.array("fp").alias("words")), budget)
    comps = connected_components(links)
    classes = classes.join(comps.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = classes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_fp = classes.join(named, "component").select("fp", "component_id")
    return own.join(of_fp, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def exact_links(members: DataFrame, shingle: int, least: float, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """members (grp, id, text) -> links (src, dst) between ids of a group whose sets of shingles have Jaccard similarity of `least` or more.

    Groups are cut into chunks of about `chunk_shingles` shingles, and pairs of chunks are dealt out; a task counts common
    shingles by an inverted index and returns a spanning forest of the links it finds.
    """
    sized = members.withColumn("w", F.greatest(F.lit(1), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))))
    chunks = sized.groupBy("grp").agg(F.ceil(F.sum("w") / chunk_shingles).cast("int").alias("chunks"))
    rows = sized.join(chunks, "grp").withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("mate", F.explode(F.expr("sequence(0, chunks - 1)")))
    rows = rows.select("grp", F.least("own", "mate").alias("ca"), F.greatest("own", "mate").alias("cb"), "id", "text")
    keys = ["grp", "ca", "cb"]

    def links(batches):
        for c in runs(batches, keys, limit=2_000):
            for lo, hi in zip(*bounds(*(c[k] for k in keys))):
                if hi - lo < 2:
                    continue
                ids, sets = c["id"][lo:hi], [np.unique(shingle_hashes(t, shingle)) for t in c["text"][lo:hi]]
                sizes = np.array([len(s) for s in sets])
                everything, at = np.unique(np.concatenate(sets), return_inverse=True)
                owner = np.repeat(np.arange(len(ids)), sizes)
                order = np.argsort(at, kind="stable")
                first = np.searchsorted(at[order], np.arange(len(everything) + 1))
                posting, edges = owner[order], np.cumsum(sizes)
                label = np.arange(len(ids))
                for r in range(1, len(ids)):
                    own = at[edges[r] - sizes[r] : edges[r]]
                    n = first[own + 1] - first[own]
                    if not n.sum():
                        continue
                    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    met = posting[np.repeat(first[own], n) + k]
                    if len(met) < len(ids):
                        other, common = np.unique(met[met < r], return_counts=True)
                    else:
                        common = np.bincount(met, minlength=len(ids))[:r]
                        other = np.flatnonzero(common)
                        common = common[other]
                    near = other[common >= least * (sizes[other] + sizes[r] - common) - 1e-9]
                    label = merge(label, np.full(len(near), r), near)
                linked = np.flatnonzero(label != np.arange(len(ids)))
                if len(linked):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[label[linked]])], ["src", "dst"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(links, "src bigint, dst bigint")


def sketches(rows: DataFrame, shingle: int, least: float, words: int, few: int) -> DataFrame:
    """rows (.., text) -> (.., k1, k2, words, few): k1 and k2 are 128 bits of the text's words; `few` is the set of shingles of a
    text that has at most `few` of them; `words` are SimHashes of a text with enough shingles to be similar to one of more than
    `few`. These two are null otherwise."""

    def sketch(batches):
        kind = pa.list_(pa.int64())
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = b["text"].to_pylist()
                keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join((t or "").encode().lower().split())) for t in texts), "<i8").reshape(-1, 2)
                sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
                long = [n for n, h in enumerate(sets) if len(h) >= least * (few + 1) - 1e-9]
                prints = dict(zip(long, simhashes([sets[n] for n in long], words)))
                out = b.drop_columns(["text"])
                cols = [pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([prints.get(n) for n in range(len(sets))], kind), pa.array([h.view(np.int64) if len(h) <= few else None for h in sets], kind)]
                yield pa.RecordBatch.from_arrays([*out.columns, *cols], names=[*out.schema.names, "k1", "k2", "words", "few"])

    schema = rows.drop("text").schema.add("k1", LongType()).add("k2", LongType()).add("words", ArrayType(LongType())).add("few", ArrayType(LongType()))
    return rows.mapInArrow(sketch, schema)


def prefix_links(sets: DataFrame, least: float) -> DataFrame:
    """sets (id, few array<bigint>) -> links (src, dst) that join every two sets of Jaccard similarity of `least` or more, and others.

    Two such sets have one of the first n - ceil(least * n) + 1 shingles of each in common, in whatever order all sets are
    read. Frequent shingles come last, by counters that they share, so that few sets meet by one. A shingle's sets are
    linked to the smallest id of them: grouped minima, so that no task holds them all.
    """
    seen = sets.select(F.explode("few").alias("h")).groupBy(F.pmod("h", F.lit(COUNTERS)).alias("b")).count().toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[seen["b"].to_numpy()] = seen["count"].to_numpy()

    def prefixes(batches):
        for b in batches:
            ids, few = b["id"].to_numpy(), b["few"]
            n, h = few.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), few.flatten().to_numpy()
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, counts[h % COUNTERS], owner))
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            keep = place < (n - np.ceil(least * n - 1e-9) + 1)[owner]
            yield pa.RecordBatch.from_arrays([pa.array(ids[owner[keep]]), pa.array(h[order[keep]])], ["id", "h"])

    rows = sets.mapInArrow(prefixes, "id bigint, h bigint")
    heads = rows.groupBy("h").agg(F.min("id").alias("dst"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(heads, "h").where("id <> dst").select(F.col("id").alias("src"), "dst")


def with_row_keys(docs: DataFrame) -> list:
    """r1, r2: 128 bits of a row's values in all columns."""
    cols = [F.to_json(F.struct(c)) if "map<" in t else F.col(c) for c, t in zip(quoted(docs.columns), (t for _, t in docs.dtypes))]
    return [F.xxhash64(F.lit(n), *cols, *[c.isNull() for c in cols]).alias(f"r{n}") for n in (1, 2)]


def with_classes(drawn: DataFrame) -> DataFrame:
    """drawn (own, r1, r2, k1, k2, words, few) -> a row for each text of its own: id, k1, k2, pick (the row of smallest own: own, r1, r2), n (its rows), words, few.

    id is k1 where no other text has it, which is told by k2, and a hash of both elsewhere.
    """
    first = F.min_by(F.struct("own", "r1", "r2"), F.struct(F.col("own").isNull(), "own", "r1", "r2"))
    classes = as_table(drawn.groupBy("k1", "k2").agg(first.alias("pick"), F.count("*").alias("n"), F.first("words").alias("words"), F.first("few").alias("few")), "classes")
    shared = cut(classes.groupBy("k1").count().where("count > 1").select("k1", F.lit(True).alias("shared")))
    if not shared.count():
        return classes.withColumn("id", F.col("k1"))
    return classes.join(shared, "k1", "left").withColumn("id", F.when(F.col("shared"), F.xxhash64("k1", "k2")).otherwise(F.col("k1"))).drop("shared")


def by_row(docs: DataFrame, rows: DataFrame, how: str, most: int = 200_000) -> DataFrame:
    """docs (with r1, r2) joined with rows (r1, r2, ..): rows of at most `most` are broadcast, so that no text is shuffled; others meet by a shuffle."""
    rows = cut(rows)
    return docs.join(F.broadcast(rows) if rows.count() <= most else rows, ["r1", "r2"], how)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, words: int = 24, budget: int = 15, total: int = 28, few: int = FEW) -> DataFrame:
    """docs without near copies: of each group linked by shingle-set similarity of `least` or more, the row of smallest id stays, all columns kept.

    Pairs of texts of at most `few` distinct shingles are all found, by prefixes of their sets. For pairs with a longer text
    SimHash gives candidates: `words` 64-bit fingerprints over hashes of their own (96 trie roots a text at 24), joined within
    `budget` bits a word and `total` over two; at similarity 0.8 a pair shares a root with probability 0.999. Candidate groups
    are then compared exactly. Keys and sketches are shuffled, and the texts of candidates; no others.

    Texts of equal words are one text; null and blank texts are one group each other. Of rows of equal texts that with the
    smallest id stays (null last), at equal ids that with the smaller hash of its columns, of rows equal in all columns one.
    Other columns, whatever their names, are kept. An empty table gives an empty one.
    """
    keyed = docs.select(F.struct(*quoted(docs.columns)).alias("row"), *with_row_keys(docs), F.col(text_col).alias("text"))
    drawn = as_table(sketches(keyed.select(F.col(f"row.`{id_col}`").alias("own"), "r1", "r2", "text"), shingle, least, words, few), "sketches")
    classes = with_classes(drawn)
    long = trie_links(classes.where("words is not null").select("id", "words"), budget, total)
    coarse = connected_components(long.union(prefix_links(classes.where("few is not null").select("id", "few"), least)))
    asked = classes.select("id", "pick.r1", "pick.r2").join(coarse, "id").select("id", "r1", "r2", F.col("component").alias("grp"))
    members = by_row(keyed.select("r1", "r2", "text"), asked, "inner").groupBy("id").agg(F.first("grp").alias("grp"), F.first("text").alias("text"))
    comps = connected_components(exact_links(as_table(members.select("grp", "id", "text"), "members"), shingle, least))
    named = comps.join(classes.select("id", "pick"), "id")
    stays = named.groupBy("component").agg(F.min_by("id", F.struct(F.col("pick.own").isNull(), "pick.own", "id")).alias("first"))
    lost = named.join(stays, "component").where("id <> first").select("id", F.lit(True).alias("lost"))
    fate = classes.select("id", "k1", "k2", "pick", "n").join(lost, "id", "left").where("lost or n > 1")
    rows = drawn.select("k1", "k2", "r1", "r2").join(fate, ["k1", "k2"])
    one = (F.col("r1") == F.col("pick.r1")) & (F.col("r2") == F.col("pick.r2"))
    goes = as_table(rows.groupBy("r1", "r2").agg(F.count("*").alias("n"), F.first(F.coalesce("lost", F.lit(False)) | ~one).alias("whole")).where("whole or n > 1"), "goes")
    kept = by_row(keyed, goes.select("r1", "r2"), "left_anti").select("row.*")
    again = goes.where("not whole").select("r1", "r2")
    if not again.take(1):
        return kept
    return kept.union(by_row(keyed, again, "left_semi").select("row.*").dropDuplicates())

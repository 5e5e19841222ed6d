"""Near-duplicate vectors by an inverted multi-index.

Vectors are scaled to length one and cut into halves; each half has a codebook of its own, and a vector's cell in the product
grid is the pair of its nearest codewords. A query visits cells in the order of a lower bound of their distance to it (the
multi-sequence traversal), each bound the sum of two: how far the query's half is, squared, from the border of a codeword's
region. A partner at squared distance d differs from the query in all `dim` directions; in the one direction that leads over
a border it differs by about sqrt(d / dim), so the traversal stops at d / dim times the square of the normal quantile of the
target recall. What is visited is then compared in double precision. Either of a pair may find the other; both count it.

Equal vectors, told apart by 128 bits, are one vector with a count; from there on it goes by a number. Codewords grow with the
fourth root of the vectors, so cells, and members of a cell, with the square root. Cells' members meet their visitors in blocks
of bounded size, as matrices; a block gives each row's number of links and a spanning forest of them.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table, connected_components, cut
from .simhash import merge

#: Distinct vectors that the codebooks are fitted on, at most; those of the smallest hash.
SAMPLE = 20_000
BLOCK = 2_000
#: Codewords a half at most, so that the counts of cells that are broadcast are a million rows at most.
MOST_WORDS = 1_024


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from spread starting points (rows far from those taken before); as many words as distinct rows at most."""
    words = [x.mean(0)] if not len(x) else [x[0]]
    gap = ((x - words[0]) ** 2).sum(1)
    while len(words) < k and gap.max(initial=0) > 1e-12:
        words.append(x[int(gap.argmax())])
        gap = np.minimum(gap, ((x - words[-1]) ** 2).sum(1))
    c = np.array(words)
    for _ in range(rounds):
        at = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def unit_rows(values: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, usable): rows that are null, of another length, zero or hold a null or non-finite component aren't usable."""
    out, usable = np.zeros((len(values), dim)), np.zeros(len(values), bool)
    if isinstance(values, np.ndarray):
        out, usable = values.astype(np.float64), np.isfinite(values).all(1) & values.any(1)
        values = []
    for r, v in enumerate(values):
        if v is not None and len(v) == dim and not any(x is None for x in v):
            out[r] = v
            usable[r] = np.isfinite(out[r]).all() and out[r].any()
    out[~usable] = 0
    scale = np.abs(out).max(1, keepdims=True, initial=0)
    out /= np.where(scale > 0, scale, 1)
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1), usable


def words_for(n: int) -> int:
    """Codewords a half for n distinct vectors: 32 for 65,536 of them, 356 for a billion."""
    return min(max(2, round(2 * n**0.25)), MOST_WORDS)


class MultiIndex:
    def __init__(self, books: tuple[np.ndarray, np.ndarray]):
        self.books = books
        self.gaps = []
        for c in books:
            d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))
            self.gaps.append(np.where(d > 0, d, np.inf))

    def halves(self, x: np.ndarray):
        d = x.shape[1] // 2
        return x[:, :d], x[:, d:]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (((c**2).sum(1) - 2 * h @ c.T).argmin(1) for h, c in zip(self.halves(x), self.books))
        return a * len(self.books[1]) + b

    def bounds(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distance of each half to the border of each codeword's region, 0 for its own: no point there is nearer."""
        out = []
        for h, c, gap in zip(self.halves(x), self.books, self.gaps):
            d = (h**2).sum(1)[:, None] + (c**2).sum(1) - 2 * h @ c.T
            own = d.argmin(1)
            over = np.maximum(d - d[np.arange(len(h)), own][:, None] - 1e-9, 0) / (2 * gap[own])
            out.append(over**2)
        return out

    def visits(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells whose bound is within `reach`, nearest first within a row.

        Rows of both bounds are sorted; for each codeword of the first half, in order, the second half's are taken while the
        sum stays within reach.
        """
        first, second = self.bounds(x)
        rows, cells, far = [], [], []
        order = np.argsort(second, 1, kind="stable")
        ranked = np.take_along_axis(second, order, 1)
        for a in range(first.shape[1]):
            n = (ranked <= (reach - first[:, a])[:, None]).sum(1)
            r = np.repeat(np.arange(len(x)), n)
            k = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
            rows.append(r)
            cells.append(a * second.shape[1] + order[r, k])
            far.append(first[r, a] + ranked[r, k])
        rows, cells, far = (np.concatenate(v) for v in (rows, cells, far))
        by = np.lexsort((far, rows))
        return rows[by], cells[by]


def near_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", words: int | None = None, sample: int = SAMPLE, recall: float = 0.99, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: its id, n_links (other rows with cosine of `least` or more), component_id and kept.

    component_id is the smallest id reachable by links, itself included; kept: id equals it. Vectors that are null, zero,
    shorter or longer than the table's most common length or hold null or non-finite components link with nothing; so do no
    vectors with a null id. Repeated rows are vectors of their own and link. No link is below `least`; of pairs whose
    difference has no favoured direction, `recall` are found at least.
    """
    shape = vectors.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = shape["d"] if shape else 2
    own = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    plain = F.when((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.col("v"))
    own = own.select("id", F.when(F.col("id").isNotNull(), plain).alias("v"))
    own = as_table(own.select("id", *[F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(k), "v")).alias(f"h{k}") for k in (1, 2)], "v"), "vectors")
    distinct = own.where("h1 is not null").groupBy("h1", "h2").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("id").alias("least_id"))
    distinct = as_table(distinct.withColumn("h", F.monotonically_increasing_id()), "distinct")  # numbers that hold once the table is written
    picked = distinct.orderBy("h1", "h2").limit(sample).select("v").toArrow()["v"].to_pylist()
    x, _ = unit_rows(picked, dim)
    words = words or words_for(distinct.count())
    index = MultiIndex(tuple(codebook(h, words) for h in (x[:, : dim // 2], x[:, dim // 2 :])))
    reach = (2 - 2 * least) * NormalDist().inv_cdf((1 + recall) / 2) ** 2 / dim + 1e-9
    raw_type = np.float32 if dict(vectors.dtypes)[vec_col] == "array<float>" else np.float64  # as it came: nothing is lost

    def visited(values: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u, _ = unit_rows(values, dim)
        return *index.visits(u, reach), index.cells(u)

    def tally(batches):
        for b in batches:
            values = b["v"].to_pylist()
            for at in range(0, len(values), 1024):
                rows, cells, home = visited(values[at : at + 1024])
                c, n = np.unique(cells, return_counts=True)
                hc, hn = np.unique(home, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([c, hc])), pa.array(np.concatenate([n, np.zeros(len(hc), np.int64)])), pa.array(np.concatenate([np.zeros(len(c), np.int64), hn]))], ["cell", "visits", "homes"])

    def spread(batches):
        for b in batches:
            ids, n, values = b["h"].to_numpy(), b["n"].to_numpy(), b["v"].to_pylist()
            for at in range(0, len(ids), 1024):
                rows, cells, home = visited(values[at : at + 1024])
                raw = pa.array([np.asarray(v, raw_type).tobytes() for v in values[at : at + 1024]], pa.binary())
                for lo in range(0, len(rows), 20_000):
                    r, c = rows[lo : lo + 20_000], cells[lo : lo + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 1024][r]), pa.array(c), pa.array(home[r] == c), pa.array(n[at : at + 1024][r]), raw.take(pa.array(r))], ["h", "cell", "home", "n", "u"])

    counts = distinct.select("v").mapInArrow(tally, "cell long, visits long, homes long").groupBy("cell").agg(F.sum("homes").alias("m"), F.sum("visits").alias("v")).where("m > 0")
    counts = cut(counts.select("cell", F.ceil(F.col("m") / block).cast("int").alias("mb"), F.ceil(F.col("v") / block).cast("int").alias("vb")))
    rows = distinct.select("h", "v", "n").mapInArrow(spread, "h long, cell long, home boolean, n long, u binary").join(F.broadcast(counts), "cell")  # a row for each of words^2 cells at most
    mb, vb = F.pmod(F.xxhash64("h"), F.col("mb")).cast("int"), F.pmod(F.xxhash64("h", F.lit(1)), F.col("vb")).cast("int")
    asks = F.transform(F.sequence(F.lit(0), F.col("mb") - 1), lambda m: F.struct(vb.alias("q"), m.alias("m"), F.lit(False).alias("member")))
    owns = F.transform(F.sequence(F.lit(0), F.col("vb") - 1), lambda q: F.struct(q.alias("q"), mb.alias("m"), F.lit(True).alias("member")))
    met = rows.withColumn("at", F.explode(F.when(F.col("home"), F.concat(asks, owns)).otherwise(asks))).select("cell", "at.*", "h", "n", "u")
    keys = ["cell", "q", "m"]

    def compare(batches):
        held: list[pa.RecordBatch] = []

        def work(t):
            ids, n, member = t["h"].to_numpy(), t["n"].to_numpy(), t["member"].to_numpy(zero_copy_only=False)
            u, _ = unit_rows(np.frombuffer(b"".join(t["u"].to_pylist()), raw_type).reshape(len(ids), dim), dim)
            key = np.stack([t[k].to_numpy() for k in keys])
            starts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0)))
            for lo, hi in zip(starts, np.append(starts[1:], len(ids))):
                ms, qs = np.flatnonzero(member[lo:hi]) + lo, np.flatnonzero(~member[lo:hi]) + lo
                if not len(ms) or not len(qs):
                    continue
                near = u[qs] @ u[ms].T >= least
                near &= ids[qs][:, None] != ids[ms][None]
                a, b = np.nonzero(near)
                if not len(a):
                    continue
                first, second = index.bounds(u[ms])
                home = index.cells(u[qs])[a]
                width = len(index.books[1])
                one_way = first[b, home // width] + second[b, home % width] > reach  # the member doesn't visit the query: it counts here
                names, at = np.unique(np.concatenate([ids[qs], ids[ms]]), return_inverse=True)
                qa, mb_ = at[: len(qs)][a], at[len(qs) :][b]
                links = np.bincount(qa, n[ms][b], len(names)) + np.bincount(mb_[one_way], n[qs][a][one_way], len(names))
                label = merge(np.arange(len(names)), qa, mb_)
                some, far = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(names)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([names[some], names[far]])), pa.array(np.concatenate([names[some], names[label[far]]])), pa.array(np.concatenate([links[some].astype(np.int64), np.zeros(len(far), np.int64)]))], ["src", "dst", "links"])

        for b in batches:
            held.append(b)
            t = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([t[k].to_numpy() for k in keys])
            whole = int((key != key[:, -1:]).any(0).sum())  # sorted: the last key's rows may go on
            if whole >= 4 * block:
                yield from work(t.slice(0, whole))
                held = t.slice(whole).combine_chunks().to_batches()
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    met = met.repartition(*keys).sortWithinPartitions(*keys, "member", "h")
    found = as_table(met.mapInArrow(compare, "src long, dst long, links long"), "links")
    comps = connected_components(found.where("src <> dst").select("src", "dst"))
    links = found.where("src = dst").groupBy(F.col("src").alias("h")).agg(F.sum("links").alias("others"))
    classes = distinct.select("h", "h1", "h2", "n", "least_id").join(links, "h", "left").join(comps.withColumnRenamed("id", "h"), "h", "left").withColumn("component", F.coalesce("component", "h"))
    named = classes.groupBy("component").agg(F.min("least_id").alias("first_id"))
    classes = classes.join(named, "component").select("h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "first_id")
    out = own.select("id", "h1", "h2").join(classes, ["h1", "h2"], "left").withColumn("component_id", F.coalesce("first_id", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))

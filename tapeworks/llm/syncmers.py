"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A text is a sequence of tokens: words of up to 12 visible characters; longer ones are cut after each vowel or low digit, and
texts in scripts without spaces at each character, so that where a token ends hangs on the characters around it, not on where
the text began. An inner substring is 2 tokens, a k-mer 5, with 4 inner
substrings; a k-mer is an anchor if the smallest of its inner substrings' hashes is the first or the last of them. Whether it
is depends on its own tokens alone, so an edit moves no anchor beyond 4 tokens. A fingerprint is the 64 smallest distinct
anchor hashes in hexadecimal; the likeness of two is that of their anchor sets (Dice), estimated from them. Anchors with
their positions line up passages that two texts share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
TOKEN = rf"(?<!\S)\S{{1,12}}(?!\S)|[{UNSPACED}]|[^\s{UNSPACED}aeiouAEIOU0-4]{{0,11}}[^\s{UNSPACED}]"
K, S, SKETCH = 5, 2, 64


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a lambda's argument is a variable, which the optimiser doesn't copy."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def anchors(text: Column, with_positions: bool = False) -> Column:
    """Anchor hashes of a text in order, or structs (hash, pos). No k-mer is closed, or fewer tokens than one: one anchor over all tokens; none: empty."""
    n_inner = K - S + 1

    def chosen(tokens, inner):
        at = F.sequence(F.lit(0), F.size(inner) - n_inner)
        part = lambda i, j: F.get(inner, i + j)
        closed = F.filter(at, lambda i: F.least(part(i, 0), part(i, n_inner - 1)) <= F.least(*[part(i, j) for j in range(1, n_inner - 1)]))
        hashed = lambda i: F.xxhash64(part(i, 0), part(i, S), part(i, n_inner - 1))  # noqa: E731  these cover all K tokens
        if with_positions:
            return F.transform(closed, lambda i: F.struct(hashed(i).alias("hash"), i.alias("pos")))
        return F.transform(closed, hashed)

    def of(tokens):
        inner = F.transform(F.sequence(F.lit(0), F.size(tokens) - S), lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(S)]))
        whole = F.xxhash64(F.array_join(tokens, " "))
        short = F.array(F.struct(whole.alias("hash"), F.lit(0).alias("pos"))) if with_positions else F.array(whole)
        none = F.slice(short, 1, 0)
        some = lambda found: F.when(F.size(found) > 0, found).otherwise(short)
        return F.when(F.size(tokens) >= K, let(let(inner, lambda x: chosen(tokens, x)), some)).when(F.size(tokens) > 0, short).otherwise(none)

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), of)


def sketch(text: Column) -> Column:
    """The smallest distinct anchor hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(anchors(text))), 1, SKETCH)


def fingerprint(sk: Column) -> Column:
    return F.array_join(F.transform(sk, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of anchors in common, 2|A and B| / (|A| + |B|), from sketches. Two without anchors: 1; one: 0."""

    def shared(u):
        j = F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u)
        return F.when(F.size(u) == 0, 1.0).otherwise(2 * j / (1 + j))

    return let(F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH), shared)


def shared_passages(queries: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3) -> DataFrame:
    """(query_id, doc_id, shift, anchors, query_from, query_to): texts with `least` or more anchors in common at one shift of position.

    queries is a stated set of texts, held against all of docs; every anchor counts, however common.
    """

    def side(df, name):
        found = df.select(F.col(id_col).alias(f"{name}_id"), F.explode(anchors(F.col(text_col), True)).alias("a"))
        return found.select(f"{name}_id", F.col("a.hash").alias("hash"), F.col("a.pos").alias(f"{name}_pos"))

    pairs = side(queries, "query").join(side(docs, "doc"), "hash")
    by = pairs.groupBy("query_id", "doc_id", (F.col("query_pos") - F.col("doc_pos")).alias("shift"))
    return by.agg(F.count("*").alias("anchors"), F.min("query_pos").alias("query_from"), F.max("query_pos").alias("query_to")).where(F.col("anchors") >= least)


def range_slices(rows: DataFrame, key: str, rows_a_slice: int = 2048, most: int = 16_384) -> Column:
    """The number of the range of `key` that a row falls into, ranges of about `rows_a_slice` rows, from quantiles; nulls: -1.

    The driver gets the bounds (at most `most`); a row finds its range in two steps, over about the root of their number each.
    """
    n = rows.count()
    parts = int(min(most, max(1, n // rows_a_slice)))
    if parts < 2:
        return F.when(F.col(key).isNull(), -1).otherwise(0)
    got = rows.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 10 * parts)).first()[0] or []
    bounds = sorted(set(got))
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    if not groups:
        return F.when(F.col(key).isNull(), -1).otherwise(0)
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col(key)))
    lit = lambda xs: F.expr(f"array({', '.join(f'{x}L' for x in xs)})") if isinstance(xs[0], int) else F.array(*[F.lit(x) for x in xs])
    coarse = below(lit([g[0] for g in groups]))
    fine = F.when(coarse == 0, 0).otherwise((coarse - 1) * width + below(F.get(F.array(*[lit(g) for g in groups]), coarse - 1)))
    return F.when(F.col(key).isNull(), -1).otherwise(fine)


def with_next(rows: DataFrame, key: str, carry: list[str], tie: list[str]) -> DataFrame:
    """rows with `next`, a struct of the columns `carry` of the row that follows by descending `key` (nulls last; after the last: the first).

    Rows are dealt by ranges of the key; a range's last row takes the head of the range below. Equal keys follow by `tie`.
    """
    rows = rows.withColumn("__slice", range_slices(rows.select(key), key))
    order = [F.col(key).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in tie]]
    tops = rows.select("__slice", key).groupBy("__slice").agg(F.max(key).alias("__top"))
    tops = tops.withColumn("__to", F.lag("__slice").over(W.orderBy(F.col("__slice").desc())))
    first = F.max("__slice").over(W.partitionBy(F.lit(1)))
    last = F.min("__slice").over(W.partitionBy(F.lit(1)))
    tops = tops.withColumns({"__to": F.coalesce(F.when(F.col("__slice") == first, last), F.col("__to"))})
    at_top = rows.alias("r").join(F.broadcast(tops).alias("t"), (F.col("r.__slice") == F.col("t.__slice")) & F.col(f"r.{key}").eqNullSafe(F.col("t.__top")))
    heads = at_top.select(F.col("t.__to").alias("__slice"), F.struct(*[F.col(f"r.{c}").alias(c) for c in carry]).alias("__head"), F.struct(*[F.col(f"r.{c}").alias(c) for c in tie]).alias("__tie"))
    heads = heads.groupBy("__slice").agg(F.max_by("__head", "__tie").alias("__head"))
    rows = rows.withColumn("next", F.lead(F.struct(*carry)).over(W.partitionBy("__slice").orderBy(*order)))
    return rows.join(heads, "__slice", "left").withColumn("next", F.coalesce("next", "__head")).drop("__head", "__slice")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: its fingerprint, its edited text's (last half replaced by the head of the next document's), and likenesses.

    Null texts are empty. Equal texts have equal fingerprints. Repeated ids follow each other by their texts. A single row is
    its own next document.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("sk", sketch(F.col("text")))
    rows = with_next(rows, id_col, ["text", "sk"], ["text"]).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars as int) - cast(floor(n_chars / 2) as int))"), F.col("next.text").substr(F.lit(1), half)))
    rows = rows.withColumn("esk", sketch(F.col("edited")))
    return rows.select(F.col(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sk")).alias("fingerprint"), fingerprint(F.col("esk")).alias("edited_fingerprint"), likeness(F.col("sk"), F.col("esk")).alias("near_edited"), likeness(F.col("sk"), F.col("next.sk")).alias("near_next"))

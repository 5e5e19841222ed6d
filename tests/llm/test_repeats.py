"""Substring dedup against a scan of all windows; nulls, ties, repeated rows, long texts, clashing columns, empty tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.llm import queries, repeats


def brute(rows, window=20):
    """Rows of (doc_id, text) in the order of documents -> (doc_id, n_words, n_removed, kept)."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest())):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if (key := tuple(w[s : s + window])) in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(3)
    prose = lambda n: " ".join(f"w{rnd.randrange(300)}" for _ in range(n))
    passage, line = prose(47), prose(12)
    texts = [None, "", " \t\n", "one", prose(19), prose(20), passage, passage + "\x0b" + passage, "a " * 200, "é " * 30]
    for k in range(60):
        texts.append(" ".join([prose(rnd.randrange(40)), passage[rnd.randrange(60) :], prose(rnd.randrange(30)), line, line]))
    base = prose(300)
    texts += [base, base, base.replace(" ", "  ", 5), " ".join(base.split()[3:250]), "x " + base + " y\x00z q"]
    words = base.split()
    for _ in range(20):
        near = list(words)
        near[rnd.randrange(300)] = "changed"
        texts.append(" ".join(near[rnd.randrange(9) :]))
    texts.append(prose(30_000) + " " + base)
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    return rows + [(None, base), (None, None), (-5, passage), (7, base), (7, base), (12, texts[12]), (2**62, passage)]


@pytest.mark.parametrize("sizes", [{}, {"flush": 300, "bucket_bytes": 500}, {"flush": 1, "bucket_bytes": 10**9}])
def test_without_repeats(spark, sizes, monkeypatch):
    monkeypatch.setattr(repeats, "GATHER", 200 if sizes else repeats.GATHER)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("digest", "nth", "kept", "bucket", "a.b")}).repartition(5)
    got = sorted(map(tuple, repeats.without_repeats(docs, 20, **sizes).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("window", [2, 3, 7])
def test_other_windows(spark, window):
    rnd = random.Random(window)
    rows = [(i, " ".join(rnd.choice("abcd") for _ in range(rnd.randrange(25)))) for i in range(60)]
    got = sorted(map(tuple, repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window).collect()), key=str)
    assert got == brute(rows, window)


def test_spans_are_maximal(spark):
    base = [f"x{i}" for i in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join(["a", *base[10:50], "b", *base[50:90]])), (3, " ".join(base[:30] + base[5:25]))]
    got = {r["doc_id"]: list(zip(r["starts"], r["ends"])) for r in repeats.exact_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: [(1, 41), (42, 82)], 3: [(0, 50)]}


def test_empty_table(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted(((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(rows)), key=str)
    assert sorted(map(tuple, queries.op13_substring_dedup(spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == want


def test_rolling_and_places():
    w = np.random.default_rng(0).integers(0, 2**63, 50).astype(np.uint64)
    for size in (1, 2, 7, 10, 20, 50):
        whole = repeats.rolling(w, size)
        assert len(whole) == 51 - size and all(repeats.rolling(w[i : i + size], size)[0] == whole[i] for i in range(51 - size))
    assert len(repeats.rolling(w[:5], 10)) == 0
    for x in ([], [0], [3, 3, 9], [0, 70_000, 70_001]):
        assert repeats.places(repeats.ascending(np.array(x, np.int64))).tolist() == x

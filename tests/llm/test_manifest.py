"""The Merkle manifest against a plain tree; nulls, ties, repeated rows, sparse and negative ids, clashing columns, empty tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.llm import manifest, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def tree(digests):
    """The root, and for each leaf its (left, right) siblings by level."""
    paths, place, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for k, i in enumerate(place):
            lo = i // 16 * 16
            paths[k].append(("".join(level[lo:i]), "".join(level[i + 1 : lo + 16])))
        level, place = [sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)], [i // 16 for i in place]
    return level[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = tree([x[2] for x in groups[s]])
    root, above = tree([trees[s][0] for s in names]) if names else (None, [])
    out = []
    for s, up in zip(names, above):
        for (_, _, digest, r), path in zip(groups[s], trees[s][1]):
            proof, now = path + up, digest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                now = leaf(r[0], r[1] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            for left, right in proof:
                now = sha(left + now + right)
            out.append((r[0], digest, trees[s][0], root, sha("".join(a + b for a, b in proof)), now, now == root))
    return sorted(out, key=str)


def found(spark, rows, tmp_path, more=()):
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in more})
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_merkle_manifest(spark, str(tmp_path))
    return sorted(map(tuple, got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def rows_of(n, rnd):
    texts = [None, "", "Ab", "ab", "É Ü x", "Z" * 5000]
    return [(i, rnd.choice(texts), rnd.choice([None, "en"]), rnd.choice([None, "", "a", "b", "é", "z"]), rnd.choice([None, 3])) for i in range(n)]


@pytest.mark.parametrize("case", ["one", "two", "many", "sparse", "ties", "groups"])
def test_against_a_plain_tree(spark, tmp_path, case, monkeypatch):
    rnd = random.Random(case)
    rows = {
        "one": lambda: [(5, "Only", "en", None, 4)],
        "two": lambda: [(5, "A", "en", "x", 1), (4, "B", None, "y", None)],
        "many": lambda: [(i, f"T{i}", "en", "big" if i % 7 else "b", i) for i in range(5000)] + rows_of(40, rnd),
        "sparse": lambda: [(rnd.choice([-1, 1]) * rnd.randrange(2**62), "Text", None, rnd.choice("ab"), 1) for _ in range(700)] + [(-(2**63), "min", None, "a", 1), (2**63 - 1, "Max", None, "a", 1), (None, "null", None, "a", 1), (None, "null", None, "a", 1)],
        "ties": lambda: rows_of(300, rnd) + rows_of(300, rnd) + [(9, "Same", None, "a", 1)] * 50 + [(9, f"other {i}", None, "a", 1) for i in range(40)],
        "groups": lambda: [(i, "Text", None, f"host{i % 90}", 1) for i in range(200)],
    }[case]()
    monkeypatch.setattr(manifest, "GATHER", 100)
    monkeypatch.setattr(manifest, "STEP_BITS", 1)
    assert found(spark, rows, tmp_path, ("grp", "chunk", "leaf", "root", "a.b")) == plain(rows)


def test_empty_table(spark, tmp_path):
    assert found(spark, [], tmp_path) == []


def test_proof_is_a_list_of_siblings(spark):
    rows = [(i, f"t{i}", "en", "s", 1) for i in range(40)]
    got = {r["doc_id"]: r for r in manifest.prove(spark.createDataFrame(rows, DOCS)).collect()}
    root, paths = tree([leaf(*r) for r in rows])
    assert all([tuple(x) for x in got[i]["proof"]] == paths[i] and got[i]["root"] == root for i in range(40))


def test_containers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 4095, 4096, 65_536):
        low = np.sort(rng.choice(65_536, n, replace=False))
        raw, asked = manifest.container(low), rng.integers(0, 65_536, 500)
        assert np.array_equal(manifest.contents(raw), low) and np.array_equal(manifest.rank(raw, asked), np.searchsorted(low, asked)) and len(raw) <= 8192

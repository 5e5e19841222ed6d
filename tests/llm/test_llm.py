"""Training-data operators against brute force, round trips and held-out accuracy; nulls, empties, ties, clashes and empty tables."""

import datetime as dt
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeworks.llm import common, embeddings, langid, licenses, mixing, packing, queries, simhash, syncmers, token_store, tokens, urlfilter, warc

random.seed(7)
VOCAB = [f"w{i}" for i in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n):
    return " ".join(random.choice(VOCAB) for _ in range(n))


def documents(spark, texts, **more):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({k: F.lit(v) for k, v in more.items()}) if more else df


def edited(text, k):
    w = text.split()
    for i in random.sample(range(len(w)), k):
        w[i] = "changed"
    return " ".join(w)


def components(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_connected_components(spark):
    links = [(random.randrange(300), random.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 460)]
    got = {r["id"]: r["component"] for r in common.connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    want = components(500, links)
    assert got == {x: want[x] for a, b in links if a != b for x in (a, b)}


@pytest.mark.parametrize("chunk", [50_000, 7])
def test_simhash_components(spark, chunk, monkeypatch):
    base = prose(600)
    texts = [None, "", "  ", "A b", "a B", base, base] + [edited(base, 1 + i % 3) for i in range(60)] + [prose(30) for _ in range(40)] + ["É é\tx\x0by z", "x y z"]
    prints = [brute_fingerprint(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    monkeypatch.setattr(simhash.trie_links, "__defaults__", (None, chunk))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(documents(spark, texts, fingerprint="clash")).collect()}
    want = components(len(texts), links)
    assert got == {i: (f"{p:016x}", want[i]) for i, p in enumerate(prints)}


def test_trie_pairs_finds_every_pair():
    rng = np.random.default_rng(0)
    v = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 48, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 48, 400).astype(np.uint64)) for c in rng.integers(0, 2**48, 5).astype(np.uint64)]))
    got = {(int(a), int(b)) for i, j in simhash.trie_pairs(v, np.array([0]), np.array([len(v)]), 3) for a, b in zip(i, j)}
    d = np.bitwise_count(v[:, None] ^ v[None])
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(d <= 3, 1)))}


def test_near_duplicates_against_brute_force(spark):
    bases = [prose(n) for n in (40, 120, 300, 900)]
    texts = [None, "", " ", "one two"] + [edited(b, k) for b in bases for k in (0, 0, 1, 2, 3, 8, 15)] + [b.upper() for b in bases] + [prose(60) for _ in range(40)]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (not sets[i] and not sets[j]) or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0]
    want = components(len(texts), links)
    docs = documents(spark, texts)
    got = simhash.drop_near_duplicates(docs.union(docs.where("doc_id < 8")))
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(want))
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_few_words(spark):
    """One word before or after 8 words, or a changed end of 60: similarity 0.8 exactly or just above; no pair may be lost."""
    rng, texts = random.Random(11), []
    for k in range(400):
        if k % 8 == 7:
            base = [f"u{rng.randrange(10**9)}" for _ in range(60)]
            texts += [" ".join(base), " ".join(base[:-6] + ["x"] * 6)]
            continue
        base = [f"u{rng.randrange(10**9)}" for _ in range(8)]
        texts += [" ".join(base), " ".join(["more", *base] if k % 2 else [*base, "more"])]
    kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(documents(spark, texts)).collect())
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    near = [len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert sum(near) >= 350 and kept == [i for i in range(len(texts)) if i % 2 == 0 or not near[i // 2]]


def test_prefix_links_join_all_similar_sets(spark):
    rng = random.Random(3)
    sets = [rng.sample(range(40), rng.randrange(1, 12)) for _ in range(400)]
    links = simhash.prefix_links(spark.createDataFrame(list(enumerate(sets)), "id long, few array<bigint>"), 0.8).collect()
    label = components(len(sets), [(r["src"], r["dst"]) for r in links])
    sets = [set(x) for x in sets]
    assert all(label[i] == label[j] for i in range(400) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))


def test_exact_links_in_chunks(spark):
    base = prose(100)
    texts = [edited(base, i % 5) for i in range(30)]
    members = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "grp long, id long, text string")
    whole, cut = (common.connected_components(simhash.exact_links(members, 5, 0.8, n)) for n in (10**6, 300))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_tokenizer(name, spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    texts += ["", " ", "  a  b ", "a, b", "a ,b .c", ".a", "x.y", "É.é, ü", "it's  don't", "ΑΣ Σ x", "J̌ y", "x　y", "１２ 3", "<|endoftext|> hi", "a\r\n\tb", "日本語 テキスト", "x" * 5000]
    texts += ["İ.", "ÇOĞU İ, i̇; x", "<|ENDOFTEXT|> <|startoftext|>", "a\0 \1b", "\1x y", "one.\ntwo,\n three 'so' x'S", "http://a.b/" + "c" * 90 + " d. e"]
    rng = random.Random(4)
    signs = [*map(chr, [*range(0x20, 0x7F), *range(0xA0, 0x250)]), *"  \n\t.,'İΣσ\u0338\u0301\u0307日本"] + [" "] * 60 + ["\n"] * 9
    texts += ["".join(rng.choices(signs, k=rng.randrange(1, 60))) for _ in range(6000)]
    some = [*texts[0].split()[:50], "İ", "<|endoftext|>", "'s", "'T", "日"]
    texts += ["".join(rng.choice(some) + rng.choice([" ", " ", "\n", ". ", ", ", "  ", "", "'", " \n", "\r\n"]) for _ in range(rng.randrange(1, 30))) for _ in range(1000)]
    e = tokens.Encoder(name, 1, most=3000)
    ref = [np.array([*x.ids, 1], "<u4").tobytes() for x in Tokenizer.from_file(tokens.vocabulary(name)).encode_batch(texts, add_special_tokens=False)]
    assert [e.encode([t])[0] for t in texts[:500]] == ref[:500]  # piece by piece from the cache
    assert e.encode(texts) == ref and e.encode([None]) == [np.array([1], "<u4").tobytes()] and e.encode([]) == []


def test_perfect_hash():
    keys = [f"k{i}" for i in range(5000)]
    mph = token_store.PerfectHash.build(token_store.key_hash(keys, 0))
    back = token_store.PerfectHash.from_bytes(mph.to_bytes())
    assert sorted(back.slots(token_store.key_hash(keys, 0)).tolist()) == list(range(5000))
    index = token_store.ShardIndex.from_bytes(token_store.ShardIndex.build(["a", "a", "b", "null"], np.arange(5)).to_bytes())
    first, n = index.find(["b", "a", "null", "zz"])
    assert first.tolist() == [2, 0, 3, -1] and n.tolist() == [1, 2, 1, 0]


def test_token_store_round_trip(spark):
    texts = [prose(20), None, "", "x.y, z", "日本"] * 4
    rows = [(None if i == 3 else 7 * i, t, "clash") for i, t in enumerate(texts)] + [(14, "again", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    folder = common.new_folder(spark, "t")
    token_store.write_tokens(docs, folder)
    got = token_store.read_tokens(spark, folder, with_ids=True).collect()
    tok, at = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json")), 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = {}
    for k, t, _ in order:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want[k, at] = (len(ids) // 4, zlib.crc32(ids), ids)
        at += len(ids) // 4
    assert {(r["key"], r["start"]): (r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in got} == want
    asked = spark.createDataFrame([(0,), (14,), (5,), (-9,), (10**9,), (None,), (14,)], "key long")
    assert {r["key"]: r["n_records"] for r in token_store.lookup_tokens(spark, folder, asked).collect()} == {0: 1, 14: 2, None: 1}
    empty = common.new_folder(spark, "t")
    token_store.write_tokens(docs.limit(0), empty)
    assert token_store.read_tokens(spark, empty).count() == 0


def test_token_store_of_many_shards_and_string_keys(spark):
    rows = [(f"k{i % 40:02d}", prose(i % 7) if i % 5 else "long " * 30_000 if i == 5 else None) for i in range(80)]
    folder = common.new_folder(spark, "t")
    made = token_store.write_tokens(spark.createDataFrame(rows, "doc_id string, text string"), folder, shard_ids=1)
    got = token_store.read_tokens(spark, folder, "string").orderBy("start").collect()
    assert [r["key"] for r in got] == sorted(k for k, _ in rows) and got[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    assert made.groupBy().agg(F.sum("docs")).first()[0] == 80 and max(r["n_tokens"] for r in got) > 30_000
    asked = spark.createDataFrame([("k00",), ("k39",), ("a",), ("zz",), ("k005",)], "key string")
    assert {r["key"]: r["n_records"] for r in token_store.lookup_tokens(spark, folder, asked).collect()} == {"k00": 2, "k39": 2}


def test_warc_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a/é\n", big), (5, None, big), (3, "http://b/", big), (2, "http://c/", "x" * 999), (4, "http://d/", "x" * 999), (6, "u", None), (7, "u", ""), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("clash")).repartition(2)
    folder = common.new_folder(spark, "w")
    warc.write_warc(pages, folder)
    got = {r["page_id"]: r for r in warc.read_warc(spark, folder).collect()}
    assert len(got) == len(rows)
    for k, _, html in rows:
        r, raw = got[None if k is None else str(k)], (html or "").encode()
        again = html == big and k != 5
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", "5") if again else ("response", None))
        assert r["payload"] == (None if again else raw)
    some = warc.read_warc(spark, folder, payload=False).where("record_type = 'revisit' and page_id in ('1', '5')")
    assert [r["page_id"] for r in some.collect()] == ["1"]
    warc.write_warc(pages.where("page_id = 2"), folder)  # a second write adds to the first
    assert warc.read_warc(spark, folder).count() == len(rows) + 1
    empty = common.new_folder(spark, "w")
    warc.write_warc(pages.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_mixing(spark):
    rows = [(i, prose(random.randrange(0, 40)) if i % 9 else None, f"s{i % 4}" if i % 4 else None, 1) for i in range(400)] + [(i, prose(5), "tiny", 1) for i in range(400, 404)] + [(7, "a b", "s3", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target long")
    got = mixing.mix(docs, ["doc_id"]).collect()
    assert len(got) == len(rows)
    words, taken, goal = {}, {}, {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert all(0 <= p <= 1 for p in r["positions"])
        k = (r["target"], r["source_size"])
        taken[k], goal[k], words[k] = taken.get(k, 0) + r["taken"], r["target"], r["source_size"]
    assert sum(goal.values()) == pytest.approx(sum(words.values()))
    for k in goal:
        assert abs(taken[k] - goal[k]) <= 1 and goal[k] <= 3 * words[k] + 1e-9
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns and mixing.mix(docs.limit(0), ["doc_id"]).count() == 0


def test_inverse_demand(spark):
    for knots in mixing.SCHEDULES:
        ys = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
        got = [r[0] for r in spark.createDataFrame([(y,) for y in ys], "y double").select(mixing.inverse_demand(F.col("y"), knots)).collect()]
        for y, t in zip(ys, got):
            grid = np.linspace(0, t, 20001)
            assert np.trapezoid(np.interp(grid, *zip(*knots)), grid) == pytest.approx(y, abs=1e-6)


def test_language_held_out_accuracy(spark, sf):
    got = queries.op5_language_id(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    j = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    assert j.where("lang = lang_pred").count() >= 0.97 * j.count() > 0


def test_language_edges_and_sums(spark):
    p = langid.pieces("piece_bpe_32k.model")
    prob = np.full((p.n + 1, 1), 1e-3)
    word = "▁theï"

    def brute(s):
        if not s:
            return 1.0
        ways = sum(1e-3 * brute(s[k:]) for k in range(1, len(s) + 1) if p_of(s[:k]))
        return ways if p_of(s[:1]) else ways + 1e-3 * brute(s[1:])

    def p_of(s):
        state = 0
        for c in s:
            state = int(p.step(np.array([state]), np.array([p.codes[ord(c)]]))[0])
            if state < 0:
                return False
        return p.piece[state] >= 0

    assert p.log_likelihood([word[1:]], prob)[0, 0] == pytest.approx(np.log(brute(word)))
    train = spark.createDataFrame([("der hund und die katze", "de"), ("the dog and the cat", "en")] * 3, "text string, lang string")
    model = langid.train(train)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the cat"), (5, "der hund"), (6, "x" * 3000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(rows, model, ["doc_id"]).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] == "en" and got[5][0] == "de" and all(0 <= s <= 1 for _, s in got.values())
    nothing = langid.train(train.limit(0))
    assert {r["lang_pred"] for r in langid.predict(rows, nothing, ["doc_id"]).collect()} == {"und"}


def test_language_sums_do_not_underflow(spark):
    p = langid.pieces("piece_bpe_32k.model")
    lost = "\ua66e" * 48  # a letter outside the vocabulary
    prob = np.full((p.n + 1, 2), 1e-9) * [1, 2]
    got = p.log_likelihood([lost, "the"], prob)
    assert got[0] == pytest.approx(49 * np.log(prob[-1])) and np.isfinite(got).all()
    assert p.expected([lost], np.array([3.0]), prob[:, 0])[p.n] == pytest.approx(3 * 48)
    words = ["the" * 12, "q" * 39, "hunde"]
    plain = p.log_likelihood(words, prob * 1e6), p.expected(words, np.array([1.0, 2.0, 3.0]), prob[:, 0] * 1e6)
    old, langid.LEAST = langid.LEAST, 1.0
    try:
        logs = p.log_likelihood(words, prob * 1e6), p.expected(words, np.array([1.0, 2.0, 3.0]), prob[:, 0] * 1e6)
    finally:
        langid.LEAST = old
    assert np.allclose(plain[0], logs[0], rtol=1e-12) and np.allclose(plain[1], logs[1], rtol=1e-9)
    rare = np.where(np.arange(p.n + 1)[:, None] == p.n, [1e-9, 2e-9], [2e-5, 1e-5])
    docs = spark.createDataFrame([(1, lost + " a"), (2, lost * 3 + " a")], "doc_id long, text string")
    rows = langid.predict(docs, langid.Model("piece_bpe_32k.model", ["de", "en"], rare), ["doc_id"]).collect()
    assert all(r["lang_pred"] == "en" and 0.5 < r["score"] <= 1 for r in rows)


def test_language_against_brute_force(spark):
    """Training and prediction again, piece by piece in a dict, on words, a word of 300 letters and texts without spaces."""
    import math

    import sentencepiece as sp

    m = sp.SentencePieceProcessor(model_file=tokens.vocabulary("piece_bpe_32k.model"))
    vocabulary = {m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}
    rows = [(0, "Der Hund und die Katze, 12 Häuser", "de"), (1, "the dog and the cat's house", "en"), (2, "我们在这里学习语言", "zh"), (3, "猫と犬がいる家", "ja"), (4, "donaudampfschiff" * 19, "de")]
    asked = [*rows, (5, "the hound\nin the house", None), (6, "这里有猫", None), (7, "Häuser der Katzen!", None), (8, "123 !? \u0301", None), (9, "theland" * 60, None), (9, "theland" * 60, None), (10, None, None)]

    def words(text):
        out = "".join(c if c.isalpha() or c == "\u0301" else " " for c in (text or "").lower()).split()
        return ["▁" + w for w in out] if any(c.isalpha() for w in out for c in w) else []

    def spans(w):
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + 16) + 1):
                if w[i:j] in vocabulary or j == i + 1:
                    yield i, j, w[i:j] if w[i:j] in vocabulary else None

    def add(a, b):
        return max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)

    def sums(w, log_p):
        alpha, beta = [0.0] + [-math.inf] * len(w), [-math.inf] * len(w) + [0.0]
        for i, j, x in spans(w):
            alpha[j] = add(alpha[j], alpha[i] + log_p(x))
        for i, j, x in reversed([*spans(w)]):
            beta[i] = add(beta[i], beta[j] + log_p(x))
        return alpha, beta

    langs, size = ["de", "en", "ja", "zh"], len(vocabulary) + 1
    log_p = {k: lambda x: -math.log(size) for k in langs}
    for _ in range(2):
        fresh = {}
        for k in langs:
            use = {}
            for _, text, lang in rows:
                for w in words(text) if lang == k else []:
                    alpha, beta = sums(w, log_p[k])
                    for i, j, x in spans(w):
                        use[x] = use.get(x, 0) + math.exp(alpha[i] + log_p[k](x) + beta[j] - alpha[-1])
            whole = sum(use.values()) + 0.1 * size
            fresh[k] = lambda x, use=use, whole=whole: math.log((use.get(x, 0) + 0.1) / whole)
        log_p = fresh
    schema = "doc_id long, text string, lang string"
    model = langid.train(spark.createDataFrame(rows, schema))
    got = langid.predict(spark.createDataFrame(asked, schema).withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit("clash")), model).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "score"} and len(got) == len(asked)
    for r in got:
        total = [sum(sums(w, log_p[k])[0][-1] for w in words(r["text"])) for k in langs]
        if not words(r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        assert r["lang_pred"] == langs[total.index(max(total))], r["text"]
        assert r["score"] == pytest.approx(1 / sum(math.exp(t - max(total)) for t in total), rel=1e-6)
    assert langid.predict(spark.createDataFrame([], schema), model).count() == 0
    same = langid.train(spark.createDataFrame([(0, "ab", "x"), (1, "ab", "y")], schema))
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(spark.createDataFrame([(0, "ab", None)] * 2, schema), same).collect()} == {("x", 0.5)}


def test_url_filter(spark):
    day = "2024-01-%02d"
    entries = spark.createDataFrame([(".bad.com", day % 2, "add", "x"), (".bad.com", day % 5, "remove", "x"), ("=a.bad.com", day % 4, "add", "h"), ("/ok.org/fr", day % 1, "add", "p"), (None, day % 1, "add", "n")], "key string, day string, action string, category string").withColumn("day", F.to_date("day"))
    deep = spark.createDataFrame([("/ok.org/a/b", day % 1, "add", "d")], "key string, day string, action string, category string").withColumn("day", F.to_date("day"))
    more = spark.createDataFrame([(1, "http://ok.org./a/b/c?q"), (2, "//ok.org/a/b"), (3, "http://ok.org/a/bc"), (4, "http://[::1]:80/a/b"), (5, "http://ok.org//a/b")], "page_id int, url string").withColumn("day", F.to_date(F.lit("2024-01-03")))
    assert {r["page_id"]: (r["host"], r["matched"]) for r in urlfilter.filter_urls(more, deep).collect()} == {1: ("ok.org", "/ok.org/a/b"), 2: ("ok.org", "/ok.org/a/b"), 3: ("ok.org", None), 4: ("[::1]", None), 5: ("ok.org", None)}
    caps = [(1, "http://a.bad.com/x", 1), (2, "http://a.bad.com/x", 2), (3, "https://u@A.BAD.com:80/x", 4), (4, "http://b.bad.com", 5), (5, "http://ok.org/fr/1", 1), (6, "http://ok.org/de", 1), (7, None, 3), (8, "nonsense", 3), (9, "http://a.bad.com/", None), (2, "http://a.bad.com/x", 2)]
    df = spark.createDataFrame([(i, u, None if d is None else day % d, "clash") for i, u, d in caps], "page_id int, url string, day string, host string").withColumn("day", F.to_date("day"))
    got = urlfilter.filter_urls(df, entries).collect()
    assert len(got) == len(caps)
    assert {r["page_id"]: (r["blocked"], r["matched"]) for r in got} == {1: (False, None), 2: (True, ".bad.com"), 3: (True, "=a.bad.com"), 4: (False, None), 5: (True, "/ok.org/fr"), 6: (False, None), 7: (False, None), 8: (False, None), 9: (False, None)}
    assert urlfilter.filter_urls(df.limit(0), entries).count() == 0 and urlfilter.filter_urls(df, entries.limit(0)).where("blocked").count() == 0
    odd = df.drop("host").withColumnsRenamed({"url": "u.r l"}).withColumns({"prefix": F.lit(1), "m": F.lit(2), "`c0`": F.lit(3), "key": F.lit(4), "depths": F.lit(5)})
    assert odd.columns[1] == "u.r l"
    again = urlfilter.filter_urls(odd, entries, "u.r l")
    assert again.columns[:8] == odd.columns and sorted((r["page_id"], str(r["matched"])) for r in again.collect()) == sorted((r["page_id"], str(r["matched"])) for r in got)


def test_url_filter_against_a_loop(spark):
    """Lists of domains, hosts and paths of any depth against captures, whose paths are up to 3,000 segments long."""
    rng = np.random.default_rng(5)
    start = dt.date(2024, 1, 1)
    hosts = ["a.b.com", "b.com", "x.a.b.com", "c.org", "com", "[::1]"]
    keys = [f".{h}" for h in hosts[:4]] + [f"={h}" for h in hosts] + [f"/{h}{p}" for h in hosts[:4] for p in ("/s", "/s/t", "/s/t/u", "/t/s")]
    log = [(str(rng.choice(keys)), start + dt.timedelta(int(rng.integers(12))), str(rng.choice(["add", "add", "remove"])), str(rng.choice(["p", "q"]))) for _ in range(160)]
    path = lambda n: "".join("/" + str(rng.choice(["s", "t", "u", ""], p=[0.5, 0.3, 0.1, 0.1])) for _ in range(n))
    caps = [(i, f"http://{rng.choice(hosts)}{path(int(rng.integers(5)))}", start + dt.timedelta(int(rng.integers(14)))) for i in range(800)]
    caps += [(800, "http://b.com" + "/s" * 3000, start + dt.timedelta(11)), (801, "http://c.org/s/t" + "/u" * 3000 + "?q", start + dt.timedelta(9))]

    def want(url, day):
        host, _, rest = url[7:].partition("/")
        parts = [] if not rest or rest.startswith("/") else rest.partition("?")[0].partition("//")[0].strip("/").split("/")
        labels = host.split(".")
        asked = ["/" + "/".join([host, *parts[:n]]) for n in range(len(parts), 0, -1)] if len(parts) < 9 else ["/" + "/".join([host, *parts[:n]]) for n in (3, 2, 1)]
        for key in [*asked, f"={host}", *["." + ".".join(labels[n:]) for n in range(max(len(labels) - 1, 1))]]:
            days = [d for k, d, _, _ in log if k == key and d <= day]
            last = [(a, c) for k, d, a, c in log if k == key and days and d == max(days)]
            if last and max(a for a, _ in last) == "add":
                return key, min(c for _, c in last), max(days)
        return None, None, None

    got = urlfilter.filter_urls(spark.createDataFrame(caps, "page_id int, url string, day date"), spark.createDataFrame(log, "key string, day date, action string, category string")).collect()
    assert len(got) == len(caps)
    for r in got:
        assert (r["matched"], r["category"], r["listed_since"]) == want(r["url"], r["day"]), r["url"][:60]
    assert {str(r["matched"])[0] for r in got} == set("/=.N")


def test_url_filter_meets_days_without_a_range_condition(spark):
    """The join on dates is by order within a key: no join of the plan has a condition beside its keys."""
    caps = spark.createDataFrame([(1, "http://a.com/x", 1)], "page_id int, url string, n int").withColumn("day", F.to_date(F.lit("2024-01-03")))
    log = spark.createDataFrame([(".a.com", "add", "x")], "key string, action string, category string").withColumn("day", F.to_date(F.lit("2024-01-01")))
    plan = urlfilter.filter_urls(caps, log)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join " in x]
    assert joins and not any("<" in x.replace("<=>", "") for x in joins)


def test_packing(spark):
    texts = [prose(random.randrange(0, 300)) for _ in range(80)] + [None, "", prose(9000), "same", "same"]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(3, texts[3], 0), (None, "null id", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(2)
    got = packing.pack(docs, size=256).collect()
    enc, n, seqs = tokens.Encoder("word_bpe_49k.json", 1), 0, {}
    by = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["padded_to"]))
        by.setdefault(r["doc_id"], []).append(r)
        n += r["length"]
    assert n == sum(len(b) // 4 for b in enc.encode([t for _, t, _ in rows]))
    padding = 0
    for pieces in seqs.values():
        at = 0
        for off, length, padded in sorted(pieces):
            assert off == at
            at += length
        assert at <= 256
        padding += padded - at
    assert padding <= 2 * 256
    for i, t in enumerate(texts):
        if i == 3:
            continue
        ids, at = enc.encode([t])[0], 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])]) and r["doc_tokens"] == len(ids) // 4
            at += r["length"]
        assert at == len(ids) // 4
    assert packing.pack(docs.limit(0)).count() == 0


def test_sum_of_squares_choice():
    rng = random.Random(2)
    b = packing.SumOfSquares(64)
    for k in range(400):
        n = rng.randrange(1, 64)
        before = b.count.copy()

        def after(h):
            c = before.copy()
            if h:
                c[h] -= 1
            if h + n < 64:
                c[h + n] += 1
            return int((c[1:64] ** 2).sum())

        best = min(after(h) for h in range(0, 65 - n) if h == 0 or before[h])
        list(b.add(k, b"\0" * 4 * n))
        assert int((b.count[1:64] ** 2).sum()) == best


def test_syncmers(spark):
    texts = ["", None, "one", "a b c d", prose(60), prose(200), "日" * 40, prose(60) + "\n" + prose(10), "tie", "tie"]
    got = {r["doc_id"]: r for r in syncmers.edited_likeness(documents(spark, texts, near_next="clash")).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for k, i in enumerate(order):
        t, nxt = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[0]["fingerprint"] == got[1]["fingerprint"] == "" and got[8]["fingerprint"] == got[9]["fingerprint"] and got[9]["near_next"] == 1
    assert got[5]["near_edited"] > 0.25 > got[5]["near_next"]
    assert syncmers.edited_likeness(documents(spark, texts).limit(0)).count() == 0


def test_syncmers_of_five_and_six_tokens(spark):
    texts = [" ".join(f"t{random.randrange(10**9)}" for _ in range(5 + i % 2)) for i in range(60)]
    got = {r["doc_id"]: r for r in syncmers.edited_likeness(documents(spark, texts)).collect()}
    prints = [got[i]["fingerprint"] for i in range(60)]
    assert "" not in prints and len(set(prints)) == 60 and all(r["edited_fingerprint"] for r in got.values())
    assert all(r["near_next"] == 0 for r in got.values())
    again = syncmers.edited_likeness(documents(spark, [texts[0], texts[0]])).collect()
    assert all(r["near_next"] == 1 for r in again)


def test_syncmers_are_context_free(spark):
    body = prose(80)
    df = spark.createDataFrame([(0, body), (1, prose(9) + " " + body)], "doc_id long, text string")
    a, b = (set(r["a"]) for r in df.select(syncmers.anchors(F.col("text")).alias("a")).collect())
    assert a and a <= b
    m = syncmers.shared_passages(df.where("doc_id = 0"), df.where("doc_id = 1")).collect()
    assert [(r["query_id"], r["doc_id"], r["shift"]) for r in m] == [(0, 1, -9)]


def test_syncmers_of_unspaced_text_are_context_free(spark):
    rng = random.Random(6)
    bodies = ["".join(rng.choice(x) for _ in range(6000)) for x in ("abcdefghijklmnopqrstuvwxyz0123456789", [chr(c) for c in range(0x4E00, 0x5200)])]
    rows = [(2 * n + k, extra + b) for n, b in enumerate(bodies) for k, extra in enumerate(("", "x"))]
    got = {r["doc_id"]: set(r["a"]) for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", syncmers.anchors(F.col("text")).alias("a")).collect()}
    for n in (0, 2):
        assert len(got[n]) > 100 and len(got[n] & got[n + 1]) >= len(got[n]) - 6


def test_syncmers_against_brute_force(spark):
    """Anchors, fingerprints and likeness again in Python, on whole texts, ties and texts of one to a thousand words."""
    texts = [prose(n) for n in (1, 4, 5, 7, 30, 200, 1000)] + ["tie " * 40, "tie " * 40, "", None, "a-much-longer-word-than-twelve " * 9, "é ü\tx y\nz"]

    def signed(x):
        return x - 2**64 if x >> 63 else x

    def chain(*parts):
        seed = 42
        for x in parts:
            seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else (x % 2**64).to_bytes(8, "little"), seed)
        return signed(seed)

    def anchors(text):
        tokens = []
        for w in (text or "").split():
            while len(w) > 12 or (w and tokens and tokens[-1] is None):
                n = next((i for i, c in enumerate(w[:12]) if c in "aeiouAEIOU01234"), 11) + 1
                tokens += [w[:n], None]
                w = w[n:]
            tokens = [t for t in tokens if t is not None] + ([w] if w else [])
        inner = [chain(*tokens[i : i + 2]) for i in range(len(tokens) - 1)]
        out = [chain(p[0], p[2], p[3]) for p in (inner[i : i + 4] for i in range(len(inner) - 3)) if min(p[0], p[3]) <= min(p[1], p[2])]
        return out or ([chain(" ".join(tokens))] if tokens else [])

    def alike(a, b):
        u = sorted(a | b)[:64]
        j = len(a & b & set(u)) / len(u) if u else 1
        return 2 * j / (1 + j)

    got = {r["doc_id"]: r for r in syncmers.edited_likeness(documents(spark, texts)).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for k, i in enumerate(order):
        t, nxt = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        own, edit, other = (set(sorted(set(anchors(x)))[:64]) for x in (t, t[: len(t) - len(t) // 2] + nxt[: len(t) // 2], nxt))
        assert got[i]["fingerprint"] == "".join(f"{h % 2**64:016x}" for h in sorted(own)), t
        assert got[i]["edited_fingerprint"] == "".join(f"{h % 2**64:016x}" for h in sorted(edit)), t
        assert got[i]["near_edited"] == pytest.approx(alike(own, edit)) and got[i]["near_next"] == pytest.approx(alike(own, other))


def test_next_by_slices(spark):
    rows = [(random.randrange(500), f"t{i}") for i in range(300)] + [(None, "n")]
    df = spark.createDataFrame(rows, "k long, t string").repartition(5)
    old = syncmers.range_slices.__defaults__
    syncmers.range_slices.__defaults__ = (16, 1000)
    try:
        got = {(r["k"], r["t"]): r["next"]["t"] for r in syncmers.with_next(df, "k", ["t"], ["t"]).collect()}
    finally:
        syncmers.range_slices.__defaults__ = old
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    assert got == {r: order[(i + 1) % len(order)][1] for i, r in enumerate(order)}


@pytest.mark.parametrize("block", [2000, 16])
def test_embeddings_recall_and_links(spark, block):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 64))
    y = x[:200] / np.linalg.norm(x[:200], axis=1, keepdims=True)
    noise = rng.normal(size=y.shape)
    noise -= (noise * y).sum(1, keepdims=True) * y
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    c = rng.uniform(0.951, 0.97, 200)[:, None]
    a = np.concatenate([x, c * y + np.sqrt(1 - c * c) * noise, x[:40], 3 * x[40:50]]).astype(np.float32)
    bad = [None, [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [1.0]]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(a)] + [(9000 + i, v, 0) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")
    got = {r["vec_id"]: r for r in embeddings.near_vectors(df, block=block).collect()}
    u = a.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    g = u @ u.T >= 0.95
    np.fill_diagonal(g, False)
    found = np.array([got[i]["n_links"] for i in range(len(a))])
    assert (found <= g.sum(1)).all() and found.sum() >= 0.9 * g.sum()
    if found.sum() == g.sum():
        want = components(len(a), list(zip(*np.nonzero(g))))
        assert [got[i]["component_id"] for i in range(len(a))] == want
    assert all(tuple(got[9000 + i]) == (9000 + i, 0, 9000 + i, True) for i in range(5))
    assert embeddings.near_vectors(df.limit(0)).count() == 0
    sure = {r["vec_id"]: r for r in embeddings.near_vectors(df, block=block, recall=1 - 1e-12).collect()}
    assert [sure[i]["n_links"] for i in range(len(a))] == g.sum(1).tolist()
    assert [sure[i]["component_id"] for i in range(len(a))] == components(len(a), list(zip(*np.nonzero(g))))
    null = embeddings.near_vectors(spark.createDataFrame([(None, rows[0][1]), (None, rows[0][1]), (3, rows[0][1])], "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, null), key=str) == [(3, 0, 3, True), (None, 0, None, True), (None, 0, None, True)]


def test_codewords_grow_with_the_fourth_root():
    assert [embeddings.words_for(n) for n in (0, 65_536, 16 * 65_536, 10**9, 10**15)] == [2, 32, 64, 356, embeddings.MOST_WORDS]


def test_licenses_by_reference_tag_and_text(spark):
    """Every reference and tag gives its licence; texts of several sentences, rows repeated, an empty table and a very long text."""
    said = [(k, way.format(name)) for k, names in licenses.NAMES.items() for name in names for way in licenses.REFERENCES]
    said += [(k, f"// SPDX-License-Identifier: {k} */\nint x;") for k in licenses.NAMES]
    t = licenses.SENTENCES
    said += [("Zlib", f"{t['ZlibAsis']} {t['ZlibGrant']}\n1. more"), ("AGPL-3.0-or-later", f"{t['GPLfree']} {t['AGPL3terms']}\n\n{t['GPLhope']} x"), ("LGPL-2.1-or-later", f"{t['LGPLfree']} x; {t['LGPL2terms']}"), ("0BSD", f"{t['0BSDgrant']}\n\n{t['ISCasis']}"), ("BSD-4-Clause", " ".join(t[k] for k in ("BSDgrant", "BSDsource", "BSDbinary", "BSDadvert", "BSDendorse", "BSDasis"))), ("MIT", "Plain words here. " * 40_000 + "Released under the MIT License.")]
    assert len(set(licenses.known().values()) & set(t)) == len(t)  # no sentence hides another
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(documents(spark, [x for _, x in said])).collect()}
    assert [(got[i], x[:70]) for i, (_, x) in enumerate(said)] == [([k], x[:70]) for k, x in said]
    twice = documents(spark, [said[0][1], "SPDX-License-Identifier: NONE"])
    assert sorted(str(r["licenses"]) for r in licenses.scan_licenses(twice.union(twice)).collect()) == ["['MIT']", "['MIT']", "[]", "[]"]
    assert licenses.scan_licenses(twice.limit(0)).count() == 0


def test_licenses(spark):
    mit = "\n".join([licenses.SENTENCES["MITgrant"], licenses.SENTENCES["MITnotice"], licenses.SENTENCES["MITasis"]])
    bsd = " ".join(licenses.SENTENCES[k] for k in ("BSDgrant", "BSDsource", "BSDbinary", "BSDasis"))
    wrapped = "// Licensed under the\n// apache License, Version 2.0.\nfoo"
    texts = [None, "", "nothing here", "Prose. Released under the MIT License. More.\nLicensed under CC BY-NC 4.0.", mit, bsd, wrapped, licenses.SENTENCES["MITnotice"], "Released under the MIT License.\n" * 2]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(documents(spark, texts, licenses="clash", sentence_ids="clash")).collect()}
    assert got == {0: [], 1: [], 2: [], 3: ["CC-BY-NC-4.0", "MIT"], 4: ["MIT"], 5: ["BSD-2-Clause"], 6: ["Apache-2.0"], 7: ["unknown"], 8: ["MIT"]}


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            docs = common.as_table(out, name)
            assert docs.count() > 0
        else:
            assert out.select("sequence_id").distinct().count() > 0


def test_pipeline_stages_on_odd_input(spark):
    """Columns called as the stages' own, nulls in each column, empty, blank and very long texts, repeated rows, ties, empty tables."""
    import corpus_pipeline

    rng = random.Random(9)
    speech = {"en": "the dog and the cat are in the house of a friend", "de": "der hund und die katze sind im haus von einem freund"}
    rows = []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        words = speech[lang].split()
        text = " ".join(rng.choice(words) for _ in range(12 + i))
        rows.append((i, text, lang if i % 3 else None, f"s{i % 3}" if i % 5 else None, len(text)))
    rows += [(60, None, "en", "s0", None), (61, "", "en", "s1", 0), (62, " \n ", None, None, 3), (63, "123 !?", None, "s2", 6), (None, rows[3][1], "de", "s0", 5)]
    rows += [rows[5]] * 3 + [(64, "the cat and the dog " * 40_000, "en", "s1", None), (65, rows[7][1].upper(), "de", None, None)]
    names = ["lang_pred", "score", "size", "target", "taken", "positions", "start", "length", "r1", "r2", "k1", "words", "few", "row", "own", "id", "grp", "a b.c"]
    docs = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit("clash") for n in names})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name
        out = common.as_table(stage(spark, docs, ""), name)
        if name == "language_id":
            kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect())
            assert kept == sorted([(False, i) for i in [*range(60), 5, 5, 5, 64, 65]] + [(True, 0)])
        if name == "near_dedup":
            kept = sorted(r["doc_id"] for r in out.collect())
            assert len(kept) == len(set(kept)) and set(kept) <= {*range(60), 64} and {5, 64} <= set(kept)
        if name == "pack_sequences":
            assert out.agg(F.sum("length")).first()[0] == docs.select("doc_id").join(out.select("doc_id", "doc_tokens").distinct(), "doc_id").agg(F.sum("doc_tokens")).first()[0]
        else:
            assert out.columns == docs.columns, name
            docs = out


def test_queries_with_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, sf)
        cols = sorted(df.columns)
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        plain = lambda v: None if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else v
        assert sorted(names) == cols
        assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str) == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str), name

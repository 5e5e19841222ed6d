"""One registered query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, embeddings, langid, licenses, manifest, mixing, oracles, packing, repeats, simhash, syncmers, token_store, urlfilter, warc
from .common import as_table, new_folder


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    return simhash.simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, budget=3)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the store."""
    folder = new_folder(spark, "tokens")
    token_store.write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, "byte_bpe_50k.json", 2)
    return token_store.read_tokens(spark, folder).withColumnRenamed("key", "doc_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from the archives."""
    folder = new_folder(spark, "warc")
    warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder, 1000)
    back = warc.read_warc(spark, folder)
    return back.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, position, in training order."""
    mixed = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return mixing.in_training_order(mixed).select("doc_id", "size", "source_size", "target", "taken", F.size("positions").cast("long").alias("copies"), "position")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learnt from documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", langid.held_out())
    model = langid.train(docs.where("not held_out"))
    return langid.predict(docs, model, ["doc_id", "held_out"])


def dated_pages(pages: DataFrame) -> DataFrame:
    """Pages as captures of 30 days: the table has no time of fetch, so its ids are dealt over the days in turn."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(30)).cast("int")).alias("day"))


def derived_list(pages: DataFrame) -> DataFrame:
    """A list's log, derived from the hosts of the pages: some domains, hosts and path prefixes, listed, removed and listed again."""
    hosts = pages.select(urlfilter.url_host(F.col("url")).alias("host")).where("host is not null").distinct()
    h = hosts.withColumn("domain", F.regexp_replace("host", r"^(www|m|blog)\.", "")).withColumn("v", F.conv(F.substring(F.md5(F.col("domain").cast("binary")), 1, 2), 16, 10).cast("int"))
    kind = F.when(F.col("domain").rlike("casino|bets"), "gambling").when(F.col("domain").rlike("ads|track"), "ads").otherwise("listed")
    listed = h.where((kind != "listed") | (F.col("v") % 4 == 0)).select(F.concat(F.lit("."), "domain").alias("key"), "v", kind.alias("category")).distinct()
    entry = lambda df, day, action: df.select("key", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("day"), F.lit(action).alias("action"), "category")
    v = F.col("v")
    blogs = h.where(F.col("host").startswith("blog.")).select(F.concat(F.lit("="), "host").alias("key"), "v", F.lit("blog").alias("category"))
    paths = h.where(v % 5 == 1).select(F.concat(F.lit("/"), "host", F.lit("/fr")).alias("key"), "v", F.lit("path").alias("category"))
    logs = [entry(listed, v % 20, "add"), entry(listed.where(v % 3 == 0), v % 20 + 6, "remove"), entry(listed.where(v % 6 == 0), v % 20 + 9, "add"), entry(blogs, F.lit(10), "add"), entry(paths, F.lit(5), "add"), entry(paths, F.lit(25), "remove")]
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x)
    return out


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, day, host, blocked, category, matched, listed_since."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urlfilter.filter_urls(dated_pages(pages), derived_list(pages)).drop("url")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to."""
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), "word_bpe_49k.json", 1, 2048)


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return syncmers.edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    return embeddings.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.95)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids, licenses (joined)."""
    found = licenses.scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ">").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    parsed = as_table(conversations.parse(rows), "parsed")
    hashes = conversations.conversation_hashes(conversations.repaired(rows, parsed)).select(F.col("conv_id").alias("c"), "sha256")
    return parsed.join(hashes, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(*parsed.columns, F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; a fifth of the rows are folded with their text in lower case."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, manifest.leaf_hash([*map(F.col, fields[:-1]), lower]))
    proven = manifest.prove(spark.read.parquet(f"{sf_dir}/documents.parquet"), fields, "doc_id", "source", {"tampered": tampered})
    folded = proven.withColumn("folded_root", manifest.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", manifest.proof_hash(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    left = repeats.without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=20)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_token_store, op3_warc, op4_mixing, op5_language_id, op6_url_filter, op7_packing, op8_syncmers, op9_embedding_dedup, op10_licenses, op11_conversation_repair, op12_merkle_manifest, op13_substring_dedup, pipeline)}

WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
l AS (SELECT payload_digest AS d, payload_bytes AS b, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY 1, 2)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN last IS NOT NULL AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last IS NOT NULL AND page_id < last THEN last END AS refers_to
FROM p LEFT JOIN l ON payload_digest = d AND payload_bytes = b
"""

MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS no FROM s),
c AS (SELECT *, [5, 2, 1][no + 1] AS weight, 3 * source_size AS cap FROM w),
f AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
g AS (SELECT *, min(CASE WHEN level * weight >= cap THEN 1 ELSE 0 END) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS capped FROM f),
t AS (
  SELECT source, source_size, no, CASE WHEN capped = 1 THEN CAST(cap AS DOUBLE) ELSE weight * (SELECT arg_min(level, cap / weight) FROM g WHERE capped = 0) END AS target FROM g),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.no, CAST(floor(t.target) AS BIGINT) AS goal,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, greatest(0, least(size, goal - off)) AS a, greatest(0, least(size, goal - source_size - off)) AS b, greatest(0, least(size, goal - 2 * source_size - off)) AS c FROM p),
y AS (SELECT *, CASE WHEN a > 0 THEN (off + a / 2.0) / target END AS y FROM k)
SELECT doc_id, size, source_size, target, CAST(a + b + c AS BIGINT) AS taken,
  CAST((a > 0)::INT + (b > 0)::INT + (c > 0)::INT AS BIGINT) AS copies,
  round(CASE no WHEN 0 THEN (sqrt(greatest(2.25 - 2 * y, 0)) - 1.5) / -1.0 WHEN 1 THEN y
    WHEN 2 THEN CASE WHEN y < 0.375 THEN sqrt(0.25 + 2 * y) - 0.5 ELSE 0.5 + (sqrt(1 + 2 * (y - 0.375)) - 1) END END, 6) AS position
FROM y
"""

URL_SQL = r"""
WITH p AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id % 30 AS INTEGER) AS day,
    nullif(lower(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)', 1), '\.$', '')), '') AS host,
    regexp_extract(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '^/([^/]+)', 1) AS seg FROM pages),
h AS (SELECT host, regexp_replace(host, '^(www|m|blog)\.', '') AS domain FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL)),
v AS (SELECT *, CAST('0x' || substr(md5(domain), 1, 2) AS INTEGER) AS v,
  CASE WHEN regexp_matches(domain, 'casino|bets') THEN 'gambling' WHEN regexp_matches(domain, 'ads|track') THEN 'ads' ELSE 'listed' END AS category FROM h),
l AS (SELECT DISTINCT '.' || domain AS key, v, category FROM v WHERE category <> 'listed' OR v % 4 = 0),
e AS (
  SELECT key, v % 20 AS n, 'add' AS action, category FROM l
  UNION ALL SELECT key, v % 20 + 6, 'remove', category FROM l WHERE v % 3 = 0
  UNION ALL SELECT key, v % 20 + 9, 'add', category FROM l WHERE v % 6 = 0
  UNION ALL SELECT '=' || host, 10, 'add', 'blog' FROM v WHERE host LIKE 'blog.%'
  UNION ALL SELECT '/' || host || '/fr', 5, 'add', 'path' FROM v WHERE v % 5 = 1
  UNION ALL SELECT '/' || host || '/fr', 25, 'remove', 'path' FROM v WHERE v % 5 = 1),
i AS (SELECT key, category, action, DATE '2024-01-01' + CAST(n AS INTEGER) AS since, lead(DATE '2024-01-01' + CAST(n AS INTEGER)) OVER (PARTITION BY key ORDER BY n) AS until FROM e),
x AS (
  SELECT host, seg, day, i.key, i.category, i.since,
    row_number() OVER (PARTITION BY host, seg, day ORDER BY CASE WHEN i.key LIKE '/%' THEN 0 WHEN i.key LIKE '=%' THEN 1 ELSE 2 END, -length(i.key), i.key) AS rn
  FROM (SELECT DISTINCT host, seg, day FROM p WHERE host IS NOT NULL) q JOIN i
    ON (i.key = '=' || host OR i.key = '/' || host || '/' || seg OR (i.key LIKE '.%' AND ends_with('.' || host, i.key)))
   AND i.since <= day AND (i.until IS NULL OR day < i.until) WHERE i.action = 'add')
SELECT p.page_id, p.day, p.host, x.key IS NOT NULL AS blocked, x.category, x.key AS matched, x.since AS listed_since
FROM p LEFT JOIN x ON p.host = x.host AND p.seg = x.seg AND p.day = x.day AND x.rn = 1
"""


def license_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    table = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in licenses.known().items())
    steps, last = [], "g"
    for k, (name, seq) in enumerate(licenses.RULES):
        pattern = quoted("".join(f"|{x}|" for x in seq))
        steps.append(f"r{k} AS (SELECT doc_id, row_no, ids, n, CASE WHEN contains(rest, {pattern}) THEN list_append(found, {quoted(name)}) ELSE found END AS found, replace(rest, {pattern}, '#') AS rest FROM {last})")
        last = f"r{k}"
    return rf"""
WITH known(sentence, id) AS (VALUES {table}),
d AS (SELECT row_number() OVER () AS row_no, doc_id, string_split_regex(regexp_replace(regexp_replace(coalesce(text, ''), '{licenses.WRAP}', '\1 \2', 'g'), '{licenses.TAG}', '\1 ', 'g'), '{licenses.END}') AS parts FROM documents),
s AS (SELECT row_no, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM d),
m AS (SELECT row_no, pos, id FROM s JOIN known ON trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) = sentence),
a AS (SELECT row_no, string_agg(id, '>' ORDER BY pos) AS ids, count(*) AS n, string_agg('|' || id || '|', '' ORDER BY pos) AS rest FROM m GROUP BY row_no),
g AS (SELECT d.doc_id, d.row_no, coalesce(ids, '') AS ids, coalesce(n, 0) AS n, CAST([] AS VARCHAR[]) AS found, coalesce(rest, '') AS rest FROM d LEFT JOIN a ON d.row_no = a.row_no),
{", ".join(steps)}
SELECT doc_id, n AS n_sentences, ids AS sentence_ids,
  array_to_string(list_sort(list_distinct(CASE WHEN regexp_matches(rest, '[A-Za-z]') THEN list_append(found, 'unknown') ELSE found END)), ',') AS licenses
FROM {last}
"""


ORACLE_SQL = {"op3_warc": WARC_SQL, "op4_mixing": MIXING_SQL, "op6_url_filter": URL_SQL, "op10_licenses": license_sql(), "op11_conversation_repair": oracles.conversation_sql(), "op12_merkle_manifest": oracles.manifest_sql(), "op13_substring_dedup": oracles.REPEATS_SQL}

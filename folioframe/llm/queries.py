"""The queries over the given tables that apply each operator with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import bitpack, bpe, chat, hosts, langid, licences, linededup, merkle, minhash, negatives, packing, topk, vectors
from folioframe.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five best partners of every fiftieth vector among all others."""
    return topk.top_products(read(spark, folder, "embeddings"), k=5, scale=256, every=50)


ORACLES["op1_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""


@query
def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document and the text decoded from them, as digests."""
    encoded = bpe.encode_and_decode(read(spark, folder, "documents"), WORD_BPE)
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@query
def op3_langid(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = read(spark, folder, "documents")
    found = langid.identify(docs, langid.learn(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op4_linededup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that ten sites or more share, as a digest."""
    clean = linededup.drop_shared_lines(read(spark, folder, "documents"), min_sites=10)
    return clean.select("doc_id", "lines_in", "lines_out", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


ORACLES["op4_linededup"] = """
WITH parts AS (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents),
lines AS (SELECT doc_id, source, unnest(range(len(p))) AS nr, unnest(p) AS line FROM parts),
shared AS (SELECT line, min((doc_id, nr)) AS first FROM lines WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
marked AS (SELECT l.doc_id, l.nr, l.line, s.line IS NOT NULL AND (l.doc_id, l.nr) <> s.first AS gone FROM lines l LEFT JOIN shared s USING (line)),
kept AS (SELECT doc_id, count(*) AS lines_in, count(*) FILTER (NOT gone) AS lines_out, coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (NOT gone), '') AS body FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(lines_in, 0) AS lines_in, coalesce(lines_out, 0) AS lines_out, CASE WHEN d.text IS NOT NULL THEN sha256(body) END AS text_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""


@query
def op5_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of vectors with a cosine of 0.95 or more."""
    return vectors.near_vectors(read(spark, folder, "embeddings"), least=0.95)


@query
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Places of all documents in sequences of 4096 tokens."""
    return packing.pack_with_library(read(spark, folder, "documents"), WORD_BPE)


@query
def op7_bitpack(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written as bit-packed shards in ascending order and read back, as digests."""
    back = bitpack.write_and_read(read(spark, folder, "documents"), BYTE_BPE, vocabulary=50257)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op8_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """A verdict on every page url; a page is good if the document that its path numbers has quality 1 and is not toxic."""
    pages, labels = read(spark, folder, "pages"), read(spark, folder, "labels")
    numbered = pages.select("url", F.regexp_extract(hosts.path_of(F.col("url")), r"/([0-9]+)(?:[/.]|$)", 1).try_cast("long").alias("doc_id"))
    outcomes = numbered.join(labels, "doc_id").select("url", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))
    return hosts.judge_urls(pages, outcomes)


ORACLES["op8_hosts"] = r"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
rules(rule, name, prefix, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
ruled AS (
  SELECT p.page_id, p.host, p.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS by_rule
  FROM parsed p LEFT JOIN rules r ON (p.host = r.name OR ends_with(p.host, '.' || r.name)) AND starts_with(p.path, r.prefix)
  GROUP BY p.page_id, p.host, p.path),
named AS (SELECT *, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', '') AS name, try_cast(regexp_extract(path, '/([0-9]+)(?:[/.]|$)', 1) AS BIGINT) AS doc_id FROM parsed),
ended AS (SELECT *, CASE WHEN regexp_matches(name, '^([0-9]+\.){3}[0-9]+$|^\[') THEN name WHEN regexp_matches(name, '(^|\.)(ac|co|com|edu|gov|net|org)\.[a-z]{2}$') THEN regexp_extract(name, '((ac|co|com|edu|gov|net|org)\.[a-z]{2})$', 1)
  ELSE regexp_extract(name, '([^.]*)$', 1) END AS suffix FROM named),
seen AS (
  SELECT host, suffix, CASE WHEN length(name) > length(suffix) THEN string_split(left(name, length(name) - length(suffix) - 1), '.')[-1] || '.' || suffix ELSE name END AS domain, count(good) AS n, coalesce(sum(good), 0) AS g
  FROM ended LEFT JOIN (SELECT doc_id, CAST(quality = 1 AND toxic = 0 AS INT) AS good FROM labels) l USING (doc_id)
  GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(g) AS g, (sum(sum(g)) OVER () + 0.5e0) / (sum(sum(n)) OVER () + 1.0e0) AS m FROM seen GROUP BY suffix),
sk AS (SELECT coalesce(greatest(0.001e0, least(0.999e0, CASE WHEN sum(n) > count(*) FILTER (n > 0)
    THEN (sum(n * (g / n - m) * (g / n - m) / (m * (1 - m))) FILTER (n > 0) - count(*) FILTER (n > 0)) / (sum(n) - count(*) FILTER (n > 0)) END)), 0.5e0) AS r FROM s0),
s1 AS (SELECT suffix, (g + (1 - r) / r * m) / (n + (1 - r) / r) AS m FROM s0, sk),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(g) AS g, any_value(m) AS m FROM seen JOIN s1 USING (suffix) GROUP BY domain, suffix),
dk AS (SELECT coalesce(greatest(0.001e0, least(0.999e0, CASE WHEN sum(n) > count(*) FILTER (n > 0)
    THEN (sum(n * (g / n - m) * (g / n - m) / (m * (1 - m))) FILTER (n > 0) - count(*) FILTER (n > 0)) / (sum(n) - count(*) FILTER (n > 0)) END)), 0.5e0) AS r FROM d0),
d1 AS (SELECT domain, suffix, (g + (1 - r) / r * m) / (n + (1 - r) / r) AS m FROM d0, dk),
h0 AS (SELECT host, n, g, m FROM seen JOIN d1 USING (domain, suffix)),
hk AS (SELECT coalesce(greatest(0.001e0, least(0.999e0, CASE WHEN sum(n) > count(*) FILTER (n > 0)
    THEN (sum(n * (g / n - m) * (g / n - m) / (m * (1 - m))) FILTER (n > 0) - count(*) FILTER (n > 0)) / (sum(n) - count(*) FILTER (n > 0)) END)), 0.5e0) AS r FROM h0),
h1 AS (SELECT host, n + (1 - r) / r AS w, (g + (1 - r) / r * m) / (n + (1 - r) / r) AS mean FROM h0, hk)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN mean - 1.645e0 * sqrt(mean * (1 - mean) / (w + 1)) >= 0.5e0 THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled JOIN h1 USING (host)
"""


@query
def op9_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one that consists of control strings, formatted in windows and read back, as digests."""
    turns = read(spark, folder, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_with_tokenizer(turns.union(extra), WORD_BPE))


@query
def op10_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return minhash.near_duplicates(read(spark, folder, "documents"))


@query
def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of all documents, and the root that follows when a fifth of them are tampered with."""
    return merkle.check_documents(read(spark, folder, "documents"))


def _merkle_sql(levels: int = 6) -> str:
    """The manifest with `levels` levels in each tree, enough for 16 ** levels rows of a source; a tree that is done passes its root on."""

    def tree(name: str, rows: str) -> str:
        """Levels name0.. of `rows` (tree, number, h): nodes of each level with those of their run (`kids`)."""
        steps = [f"{name}0 AS ({rows})"]
        for n in range(levels):
            steps.append(f"{name}k{n} AS (SELECT tree, number // 16 AS run, list(h ORDER BY number) AS kids, max(many) AS many FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS many FROM {name}{n}) GROUP BY ALL)")
            steps.append(f"{name}{n + 1} AS (SELECT tree, run AS number, CASE WHEN many = 1 THEN kids[1] ELSE sha256(array_to_string(kids, '')) END AS h FROM {name}k{n})")
        return ",\n".join(steps)

    def climb(name: str, start: str) -> str:
        """Rows of `start` (doc_id, leaf, tree, number, now, proof) taken up to the root."""
        steps = [f"{name}c0 AS ({start})"]
        for n in range(levels):
            steps.append(f"""{name}c{n + 1} AS (SELECT * EXCLUDE (number, now, proof, run, kids, many), number // 16 AS number,
  CASE WHEN many = 1 THEN now ELSE sha256(array_to_string(kids[:number % 16] || [now] || kids[number % 16 + 2:], '')) END AS now,
  proof || CASE WHEN many = 1 THEN '' ELSE array_to_string(kids[:number % 16] || kids[number % 16 + 2:], '') END AS proof
  FROM {name}c{n} JOIN {name}k{n} k USING (tree) WHERE k.run = number // 16)""")
        return ",\n".join(steps)

    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    row = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    half = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, x: {half}) AS c FROM range(256) r(i))),
rows AS (SELECT doc_id, {row('text')} AS leaf, {row(low)} AS low, coalesce('=' || source, '') AS tree,
  xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc
  FROM documents, crc),
placed AS (SELECT doc_id, leaf, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS number, CASE WHEN crc % 5 = 0 THEN low ELSE leaf END AS now FROM rows),
{tree('a', 'SELECT tree, number, leaf AS h FROM placed')},
{tree('b', f"SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS number, h FROM a{levels}")},
subroots AS (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS number, h FROM a{levels}),
{climb('a', "SELECT doc_id, leaf, tree, number, now, '' AS proof FROM placed")},
{climb('b', f"SELECT doc_id, leaf, h AS subroot, '' AS tree, s.number, now, proof FROM ac{levels} JOIN subroots s USING (tree)")}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = h AS verified FROM bc{levels}, (SELECT h FROM b{levels})
"""


ORACLES["op11_merkle"] = _merkle_sql()


@query
def op12_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and template spans of every document; the score is 1 with a phrase, else the share of a template that is covered."""
    found = licences.scan(read(spark, folder, "documents"))
    starts = F.transform("places", lambda p: p["start"])
    base = F.transform("places", lambda p: p["label"])
    own = F.transform("spans", lambda s: s["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.col("best")).alias("score"),
    )


@query
def op13_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector; the labels of every seventh are moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, folder, "embeddings"), label=label)


ORACLES["op13_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10
"""

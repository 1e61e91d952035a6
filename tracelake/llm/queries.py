"""Registered queries of the operators, one opN_<name> each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import chat_format, hard_negatives, ngram_join, packing, passage_dedup, prefix_trie, quality_classifier, quality_rules, secret_scan, sharding, source_mix, topk_search, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@registered
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised and packed into sequences of 4096 tokens."""
    packed = packing.packed_documents(spark, table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@registered
def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th vector against all others, 5 best by integer inner product."""
    vectors = topk_search.prepared(spark, table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(spark, vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


ORACLES["op2_topk_search"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@registered
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose word 5-gram sets have Jaccard similarity 0.75."""
    return ngram_join.join(spark, table(spark, sf_dir, "documents"))


ORACLES["op3_ngram_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
f AS (SELECT s.doc_id, s.g FROM s JOIN r USING (g)),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
c(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, c.seen FROM c JOIN e ON e.u = c.node AND c.seen < e.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, coalesce(k.n_links, 0) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT node, min(seen) AS component_id FROM c GROUP BY node) m ON m.node = d.doc_id
LEFT JOIN (SELECT u, count(*) AS n_links FROM e GROUP BY u) k ON k.u = d.doc_id
"""


@registered
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of nearly equal bytes; equal texts stay together."""
    placed = sharding.shard_documents(spark, table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_hash")


@registered
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, and whether base rules and line frequency keep it."""
    judged = quality_rules.judged(spark, table(spark, sf_dir, "documents"))
    return judged.select(*(c for c in judged.columns if c != "n_removed_words"), "n_removed_words")


ORACLES["op5_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('1' || source, '0') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g),
marked AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM twice WHERE c > 1) GROUP BY r),
lines AS (SELECT r, l, list_filter(string_split_regex(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw
          FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)),
worded AS (SELECT r, l, array_to_string(lw, ' ') AS norm, len(lw) AS n FROM lines WHERE len(lw) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM worded GROUP BY r),
hosts AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
common AS (SELECT host, norm FROM (SELECT x.host, o.norm, count(DISTINCT x.r) AS n FROM d x JOIN worded o ON o.r = x.r GROUP BY ALL) JOIN hosts USING (host) WHERE n > 10 AND n > 0.05 * docs),
gone AS (SELECT d.r, sum(o.n) AS n FROM d JOIN worded o ON o.r = d.r JOIN common c ON c.host = d.host AND c.norm = o.norm GROUP BY d.r),
b AS (SELECT d.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(d.t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(m.n, 0) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
      FROM d JOIN w ON w.r = d.r LEFT JOIN dup ON dup.r = d.r LEFT JOIN marked m ON m.r = d.r LEFT JOIN gone ON gone.r = d.r)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_removed_words >= 0.2 * n_words AS kept FROM b
"""


@registered
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibrated quality score of every document."""
    return quality_classifier.scored(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 by source."""
    return source_mix.mix(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@registered
def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat across documents, also with small changes."""
    return passage_dedup.passages(spark, table(spark, sf_dir, "documents"))


@registered
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and an index; every page's url looked up there and read back."""
    pages = table(spark, sf_dir, "pages")
    blocks, directory, folder = warc.archived(spark, pages)
    return warc.lookup(spark, pages, blocks, directory, folder).drop("url", "payload")


ORACLES["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, row_number() OVER (PARTITION BY h ORDER BY page_id) AS n, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER), 1)), '') AS payload_digest,
       CASE n WHEN 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN first END AS refers_to FROM s
"""


@registered
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document by patterns and by entropy."""
    scanned = secret_scan.scan(table(spark, sf_dir, "documents"))
    return scanned.select(*(c for c in scanned.columns if c != "n_entropy"), "n_entropy")


@registered
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt with heads shared by twenty ids each."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    turns, convs = prefix_trie.with_shared_heads(spark, table(spark, sf_dir, "conversations"), every=20, most=4, head=head)
    return prefix_trie.trie(spark, turns, convs)


ORACLES["op11_prefix_trie"] = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
w AS (SELECT c, {'k': k, 'w': len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''))} AS s, turn, k FROM t),
own AS (SELECT c, list(s ORDER BY turn NULLS FIRST, k) AS ts FROM w GROUP BY c),
h AS (SELECT *, CAST(xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
                                  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) AS BIGINT) % 4 AS h FROM own),
r AS (SELECT h.c, list_concat(list_slice(coalesce(b.ts, []), 1, h.h), list_slice(h.ts, h.h + 1, len(h.ts))) AS ts FROM h LEFT JOIN own b ON b.c = h.c - h.c % 20),
p AS (SELECT c, d, len(ts) = d AS ended, CASE WHEN d > 0 THEN ts[d].w ELSE 0 END AS w, array_to_string(list_transform(list_slice(ts, 1, d), lambda x: x.k), '') AS id FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM r)),
n AS (SELECT id, d, min(c) AS c, count(*) AS n_convs, any_value(w) AS w, string_agg(CASE WHEN ended THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends FROM p GROUP BY id, d),
k AS (SELECT substr(id, 1, 64 * (d - 1)) AS id, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k USING (id)),
u AS (SELECT substr(id, 1, 64 * e) AS id, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * w) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM m) GROUP BY 1)
SELECT m.c AS conv_id, m.d AS depth, CASE WHEN m.d > 0 THEN q.c END AS parent_conv_id, m.n_convs, m.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN u USING (id) LEFT JOIN m q ON q.id = substr(m.id, 1, 64 * (m.d - 1)) AND q.d = m.d - 1
"""


@registered
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that consists of control strings, formatted and read back from the written text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    hard = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(spark, chat_format.formatted(spark, rows.unionByName(hard)))


ORACLES["op12_chat_format"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
k AS (SELECT *, sha256(strlen(role) || ':' || role || text) AS k,
             length('### : ' || url_encode(role) || regexp_replace(text, '(\\*(?:</turn>|### [A-Za-z0-9%._~-]*: ))', '\\\1', 'g')) + CASE WHEN regexp_matches(role, '^[A-Z]') THEN 2 ELSE 0 END + length('./turn../') AS f FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, k)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, k), '')) AS loss_sha256, CAST(sum(f) AS BIGINT) AS formatted_chars
FROM k GROUP BY conv_id
"""


@registered
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every 50th vector, its 5 best of the same label and 3 hard negatives for each."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.sound(spark, table(spark, sf_dir, "embeddings"), label)
    return hard_negatives.hard_negatives(spark, rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


ORACLES["op13_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3
"""

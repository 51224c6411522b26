"""The registered queries of this package and, where SQL can express them, their SQL."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chroma import fingerprints, search, sonified
from .decontaminate import contamination
from .html_text import html_text
from .licenses import license_scan
from .line_dedup import drop_boilerplate
from .nearest import nearest
from .ngram_join import ngram_components
from .pieces import round_trip
from .prefix_trie import prefix_trie
from .ranked_search import TERM, search as ranked_search
from .shared import rows_at_once, shared_dir, small_batches, written
from .token_shards import document_digests, write_shards
from .toxicity import held_out, score, train
from .transducer import token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(_table(spark, sf_dir, "pages")).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-shards")
    write_shards(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return document_digests(spark, path)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"))


def op5_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a recording: vec_id, its class (the smallest id with an equal fingerprint) and the class's size; for a recording asked for (id divisible
    by 50) n_matches, the classes that align with its own; and n_asked, the asked classes that its own aligns with, the nearest of them, offset and bit error.

    A class always aligns with itself, which is not counted. A recording without fingerprint (no vector) has nulls. Rows of one id are told apart by
    their fingerprints only.
    """
    vectors = _table(spark, sf_dir, "embeddings")
    with rows_at_once(spark, 200):
        prints = written(fingerprints(sonified(vectors, "vec_id", "embedding")), "fingerprints")
    matches, members = search(prints, prints.where("vec_id % 50 = 0"), "vec_id")
    sizes = members.groupBy("class").agg(F.count("*").alias("class_size"))
    out = matches.groupBy(F.col("query_class").alias("class")).agg(F.count("*").alias("n_matches"))
    nearest = F.min(F.struct("bit_error", "query_class", "offset"))
    back = matches.groupBy(F.col("match_class").alias("class")).agg(F.count("*").alias("n_asked"), nearest.alias("near"))
    by_class = sizes.join(out, "class", "left").join(back, "class", "left")
    found = members.join(by_class, "class").select(
        F.col("id").alias("vec_id"), F.col("class").alias("class_id"), "class_size", F.when(F.col("id") % 50 == 0, F.coalesce("n_matches", F.lit(0))).alias("n_matches"),
        F.coalesce("n_asked", F.lit(0)).alias("n_asked"), F.col("near.query_class").alias("nearest"), F.col("near.offset").alias("offset"), F.col("near.bit_error").alias("bit_error"),
    )
    silent = prints.where("vec_id IS NULL OR fingerprint IS NULL OR length(fingerprint) = 0").select(F.col("vec_id").cast("long").alias("vec_id"))
    return found.unionByName(silent, allowMissingColumns=True)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), keep=False)
    return found.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(_table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_lines", "n_dropped")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")).drop("text")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=50)


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 50 = 0", k=5)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_html_text, op3_token_shards, op4_ngram_join, op5_chroma, op6_sentencepiece, op7_line_dedup, op8_token_counts, op9_decontaminate, op10_license_scan, op11_ranked_search, op12_nearest, op13_prefix_trie)}

_LOWER = "translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TRIM = "trim({l}, ' ' || chr(9) || chr(13))"

ORACLES: dict[str, str] = {
    "op4_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format(t="text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
same AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM same JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, edges.b FROM reach r JOIN edges ON r.c = edges.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id) r ON w.doc_id = r.doc_id""",
    "op7_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda l: {_TRIM.format(l="l")}))) AS line FROM documents),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
common AS (SELECT source, line, count(*) AS n FROM lines WHERE line <> '' GROUP BY source, line),
bad AS (
  SELECT c.source, list(c.line) AS bad FROM common c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n >= 5 AND c.n > 0.05 * t.total GROUP BY c.source),
kept AS (
  SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS all_lines,
    list_filter(string_split(d.text, chr(10)), lambda l: {_TRIM.format(l="l")} = '' OR NOT coalesce(list_contains(b.bad, {_TRIM.format(l="l")}), false)) AS good
  FROM documents d LEFT JOIN bad b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, array_to_string(good, chr(10)) AS text, CAST(coalesce(len(all_lines), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(all_lines) - len(good), 0) AS BIGINT) AS n_dropped FROM kept""",
    "op9_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS.format(t="text")} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format(t="text")} AS w FROM benchmark),
windows AS (
  SELECT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, s, s + least(len(w), 13) - 1), ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.s, p.n, x.item_id FROM places p JOIN windows x ON p.n = x.n AND p.k = x.k),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS names FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_ranked_search": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format(t="text")}, '{TERM}') AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format(t="text")}, '{TERM}')) AS term FROM benchmark),
sizes AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY doc_id, n, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM tf, sizes WHERE term IN (SELECT term FROM i) GROUP BY term, docs),
parts AS (
  SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // words)))) AS part
  FROM tf JOIN weights USING (term), sizes),
scores AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM i JOIN parts USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 50""",
    "op13_prefix_trie": """
WITH RECURSIVE bytes AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS name FROM conversations),
crc AS (
  SELECT conv_id, name, 0 AS i, 4294967295::BIGINT AS c FROM bytes
  UNION ALL
  SELECT conv_id, name, i + 1,
    CASE WHEN b8 % 2 = 1 THEN xor(b8 // 2, 3988292384) ELSE b8 // 2 END
  FROM (SELECT *, CASE WHEN b7 % 2 = 1 THEN xor(b7 // 2, 3988292384) ELSE b7 // 2 END AS b8
  FROM (SELECT *, CASE WHEN b6 % 2 = 1 THEN xor(b6 // 2, 3988292384) ELSE b6 // 2 END AS b7
  FROM (SELECT *, CASE WHEN b5 % 2 = 1 THEN xor(b5 // 2, 3988292384) ELSE b5 // 2 END AS b6
  FROM (SELECT *, CASE WHEN b4 % 2 = 1 THEN xor(b4 // 2, 3988292384) ELSE b4 // 2 END AS b5
  FROM (SELECT *, CASE WHEN b3 % 2 = 1 THEN xor(b3 // 2, 3988292384) ELSE b3 // 2 END AS b4
  FROM (SELECT *, CASE WHEN b2 % 2 = 1 THEN xor(b2 // 2, 3988292384) ELSE b2 // 2 END AS b3
  FROM (SELECT *, CASE WHEN b1 % 2 = 1 THEN xor(b1 // 2, 3988292384) ELSE b1 // 2 END AS b2
  FROM (SELECT conv_id, name, i, xor(c, CAST(ascii(substr(name, i + 1, 1)) AS BIGINT)) AS b1 FROM crc WHERE i < length(name)))))))))),
heads AS (SELECT conv_id, xor(c, 4294967295) % 9 AS h FROM crc WHERE i = length(name)),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations),
made AS (
  SELECT h.conv_id, 0 AS own, t.pos, role, text FROM heads h JOIN turns t ON t.conv_id = h.conv_id - h.conv_id % 5 AND t.pos < h.h
  UNION ALL SELECT h.conv_id, 1, t.pos, role, text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.pos >= h.h),
placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, text,
    string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING) AS k FROM made),
paths AS (
  SELECT conv_id, CAST(depth AS BIGINT) AS depth, k, CAST(strlen(text) AS BIGINT) AS bytes, max(depth) OVER (PARTITION BY conv_id) = depth AS ends FROM placed
  UNION ALL SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM made) FROM heads),
nodes AS (
  SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
    sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM paths GROUP BY depth, k),
tree AS (
  SELECT n.*, p.k AS parent_k, u.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN nodes u ON u.depth = p.depth AND u.k = p.k),
kids AS (SELECT depth - 1 AS depth, parent_k AS k, count(*) AS n FROM tree WHERE depth > 0 GROUP BY 1, 2),
below AS (
  SELECT p.depth, p.k, count(*) FILTER (WHERE kids.n IS NULL) AS leaves, sum((n.n_convs - 1) * n.bytes) AS saved
  FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN kids ON kids.depth = n.depth AND kids.k = n.k GROUP BY p.depth, p.k)
SELECT t.conv_id, t.depth, t.parent_conv_id, t.n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, CAST(below.leaves AS BIGINT) AS n_leaves,
  CAST(below.saved AS BIGINT) AS saved_tokens, t.ends_sha256
FROM tree t LEFT JOIN kids ON kids.depth = t.depth AND kids.k = t.k JOIN below ON below.depth = t.depth AND below.k = t.k""",
}

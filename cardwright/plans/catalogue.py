"""Registered queries: the library's operators over the driver's tables, each with independent SQL where SQL can express it.

The driver's tables are no model cards, so tables of the same shape stand in: customers are projects, orders extractions,
line items child rows, events time series, documents source texts.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardwright.functions.text import hits, norm, parse_number, round_half_up, trim_all
from cardwright.functions.units import label, parse_unit
from cardwright.operators import classify as C
from cardwright.functions import matching
from cardwright.operators import editing, evaluate, multisource, projects, simulate, templates, units
from cardwright.operators.codegen import package
from cardwright.operators.extract import repaired
from cardwright.sources import ingest, series_csv, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _projects(spark: SparkSession, d: str) -> DataFrame:
    """Customers as projects: BUILDING is public, FURNITURE without owner, other owners are nations."""
    c = _t(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_mktsegment") == "BUILDING", "public").otherwise("private").alias("visibility"),
        F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_nationkey").cast("string")).alias("owner_id"), F.col("c_acctbal").alias("updated_at"),
    )


def _extractions(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), F.col("o_orderpriority").alias("model_card_title"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("status"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Urgent orders as source documents."""
    return _extractions(spark, d).where("model_card_title = '1-URGENT'")


_SEEN = "(c_mktsegment IN ('BUILDING', 'FURNITURE') OR c_nationkey = 7)"
_LATEST = "SELECT o_custkey, o_orderpriority FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1"


@query(f"""
SELECT c_custkey AS id, c_name AS name, coalesce(s.n, 0) AS source_document_count, coalesce(e.n, 0) AS extraction_count, l.o_orderpriority AS latest_extraction_title
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) s ON c_custkey = s.o_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) e ON c_custkey = e.o_custkey LEFT JOIN ({_LATEST}) l ON c_custkey = l.o_custkey WHERE {_SEEN}""")
def project_summary(spark: SparkSession, d: str) -> DataFrame:
    out = projects.summaries(_projects(spark, d), _sources(spark, d), _extractions(spark, d), user="7")
    return out.select("id", "name", "source_document_count", "extraction_count", "latest_extraction_title")


@query("SELECT (SELECT count(*) FROM customer) AS projects, (SELECT count(*) FROM orders) AS extractions, (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS sources")
def global_totals(spark: SparkSession, d: str) -> DataFrame:
    return projects.totals(_projects(spark, d), _sources(spark, d), _extractions(spark, d))


@query(f"SELECT c_custkey AS id, c_name AS name FROM customer WHERE {_SEEN}")
def visible_projects(spark: SparkSession, d: str) -> DataFrame:
    return projects.visible(_projects(spark, d), "7").select("id", "name")


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'FURNITURE' OR c_nationkey = 7")
def changeable_projects(spark: SparkSession, d: str) -> DataFrame:
    return _projects(spark, d).where(projects.can_change("7")).select("id")


@query("""
SELECT l_orderkey AS extraction_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INT) AS place, l_partkey AS part, count(*) OVER (PARTITION BY l_orderkey) AS n
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT o_orderkey, NULL, NULL, 0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def card_assembly(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("extraction_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("id"))
    cards = projects.cards(_extractions(spark, d), {"lines": lines})
    flat = cards.select(F.col("id").alias("extraction_id"), F.size("lines").cast("long").alias("n"), F.posexplode_outer("lines").alias("place", "line"))
    return flat.select("extraction_id", "place", F.col("line.id").alias("part"), "n")


@query(f"SELECT o_orderkey AS id, c_name AS project_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE {_SEEN}")
def ownership_inner(spark: SparkSession, d: str) -> DataFrame:
    return projects.owned(_extractions(spark, d), _projects(spark, d), "7").select("id", "project_name")


@query("""
SELECT l_orderkey AS id, l_linenumber AS line, l_suppkey AS source FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE s_nationkey = c_nationkey""")
def source_guard(spark: SparkSession, d: str) -> DataFrame:
    nations = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey"), F.col("c_nationkey").alias("project_id"))
    rows = _t(spark, d, "lineitem").join(nations, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("source_document_id"), "project_id")
    sources = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("project_id"), F.lit("text").alias("kind"), F.col("s_name").alias("content"))
    return projects.with_source(rows, sources)[0].select("id", "line", F.col("source_document_id").alias("source"))


@query(f"SELECT c_custkey AS id FROM customer LEFT JOIN ({_LATEST}) ON c_custkey = o_custkey WHERE {_SEEN} AND (contains(lower(c_name), 'high') OR contains(lower(coalesce(o_orderpriority, '')), 'high'))")
def search_contains(spark: SparkSession, d: str) -> DataFrame:
    summary = projects.summaries(_projects(spark, d), _sources(spark, d), _extractions(spark, d), user="7")
    return projects.search(summary, "  HIGH ").select("id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def undefined_symbols_anti(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_present(spark: SparkSession, d: str) -> DataFrame:
    return _projects(spark, d).select("id").join(_extractions(spark, d).select(F.col("project_id").alias("id")), "id", "left_semi")


@query("""
WITH words AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part)
SELECT word FROM words WHERE word <> '' AND NOT EXISTS (SELECT 1 FROM conversations WHERE contains(lower(text), word))""")
def theta_unused(spark: SparkSession, d: str) -> DataFrame:
    """Words of part names that no conversation contains: one automaton of all words goes over each text once, and an anti join by equality."""
    words = _t(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).where("word != ''").distinct()
    texts = _t(spark, d, "conversations").select(F.lower("text").alias("text")).where("text IS NOT NULL")
    return words.join(matching.found_words(texts, words), "word", "left_anti")


@query("""
WITH present AS (SELECT DISTINCT l_partkey AS part, n_regionkey AS region FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT p.part, r.r_regionkey AS region FROM (SELECT part FROM present GROUP BY part HAVING count(*) < (SELECT count(*) FROM region)) p CROSS JOIN region r
WHERE NOT EXISTS (SELECT 1 FROM present x WHERE x.part = p.part AND x.region = r.r_regionkey)""")
def missing_in_some_sources(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem").join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    p = lines.select(F.col("l_partkey").cast("string").alias("symbol"), F.col("n_regionkey").cast("string").alias("source"), F.col("n_regionkey").alias("extraction_id"), F.lit(0).alias("ordinal"), *(F.lit(None).cast("string").alias(c) for c in ("value", "unit", "meaning"))).distinct()
    none = spark.createDataFrame([], "label string, plaintext string, latex string, extraction_id int, ordinal int, source string")
    sources = _t(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("source"), F.col("r_regionkey").alias("extraction_id"))
    found = multisource.conflicts(p, p.limit(0), none, sources).where("kind = 'missing_across_sources'")
    return found.select(F.col("subject").cast("long").alias("part"), F.explode(F.transform(F.split("details", r" \| "), lambda x: x.cast("int"))).alias("region"))


@query("""
SELECT l_partkey AS part, count(DISTINCT l_discount) AS n_values, count(DISTINCT l_returnflag) AS n_units FROM lineitem
GROUP BY l_partkey HAVING count(DISTINCT l_discount) > 1 OR count(DISTINCT l_returnflag) > 1""")
def conflict_values(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("symbol"), F.col("l_discount").alias("value"), F.col("l_returnflag").alias("unit"), F.col("l_orderkey").alias("extraction_id"), F.col("l_linenumber").alias("ordinal"))
    by = multisource.set_sizes(multisource.seen_values(rows, values=("value", "unit")), ("value", "unit"))
    return by.where("n_values > 1 OR n_units > 1").select(F.col("key").cast("long").alias("part"), "n_values", "n_units")


@query("""
WITH v AS (SELECT p_brand AS key, p_type AS v, min(p_partkey) AS o FROM part GROUP BY 1, 2)
SELECT lower(key) AS key, arg_min(v, o) AS first_value, string_agg(v, '|' ORDER BY o) AS all_values FROM v GROUP BY key""")
def first_seen_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").select(F.col("p_brand").alias("symbol"), F.col("p_type").alias("value"), F.col("p_partkey").alias("extraction_id"), F.lit(0).alias("ordinal"))
    by = multisource.aggregated(rows, values=("value",))
    return by.select("key", F.element_at("values", 1).alias("first_value"), F.array_join("values", "|").alias("all_values"))


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY trim(text, ' ' || chr(9) || chr(10) || chr(13))")
def first_seen_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Grouped by the whole trimmed text's 256-bit digest, which is what the shuffle carries."""
    return _t(spark, d, "documents").where("text IS NOT NULL").groupBy(F.sha2(trim_all("text"), 256).alias("digest")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("""
WITH s AS (SELECT o_custkey AS id, CASE WHEN count(*) = 0 THEN 0 ELSE floor(100.0 * count(nullif(o_orderstatus, 'P')) / count(*) + 0.5) END AS a, floor(100.0 * count_if(o_totalprice > 100000) / count(*) + 0.5) AS b FROM orders GROUP BY 1)
SELECT c_custkey AS id, coalesce(a, 0.0) AS status_share, coalesce(b, 0.0) AS price_share, floor(0.6 * coalesce(a, 0) + 0.4 * coalesce(b, 0) + 0.5) AS overall FROM customer LEFT JOIN s ON c_custkey = s.id""")
def completeness_score(spark: SparkSession, d: str) -> DataFrame:
    from cardwright.functions.text import percent

    by = _extractions(spark, d).groupBy(F.col("project_id").alias("id")).agg(percent(F.count(F.nullif("status", F.lit("P"))), F.count("*")).alias("status_share"), percent(F.count_if(F.col("score") > 100000), F.count("*")).alias("price_share"))
    out = _projects(spark, d).select("id").join(by, "id", "left").na.fill(0.0)
    return out.withColumn("overall", round_half_up(0.6 * F.col("status_share") + 0.4 * F.col("price_share")))


@query("""
WITH r AS (SELECT user_id, count_if(event_type = 'purchase') AS high, count_if(event_type = 'click') AS medium, count_if(event_type NOT IN ('purchase', 'click')) AS low FROM events GROUP BY 1)
SELECT user_id AS extraction_id, high, medium, low, CASE WHEN high > 0 THEN 'fail' WHEN medium > 0 THEN 'warning' ELSE 'pass' END AS status FROM r""")
def severity_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    found = e.select(F.col("user_id").alias("extraction_id"), F.when(F.col("event_type") == "purchase", "high").when(F.col("event_type") == "click", "medium").otherwise("low").alias("severity"))
    out = units.status(found.select("extraction_id").distinct(), found)
    return out.select("extraction_id", *(F.col(c).cast("long").alias(c) for c in ("high", "medium", "low")), "status")


@query("""
WITH f AS (SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS r FROM events)
SELECT event_id, CAST(n AS INT) AS place FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY r, event_id) AS n FROM f) WHERE n <= 3""")
def top_findings(spark: SparkSession, d: str) -> DataFrame:
    """The three worst findings of each user."""
    e = _t(spark, d, "events")
    found = e.select("event_id", F.col("user_id").alias("extraction_id"), F.coalesce(*(F.when(F.col("event_type") == t, F.lit(s)) for t, s in (("purchase", "critical"), ("click", "warning"))), F.lit("info")).alias("severity"), F.lit("x").alias("rule"), F.col("event_id").alias("subject"))
    return units.ranked(found, {"critical": 0, "warning": 1, "info": 2}).where("place <= 3").select("event_id", "place")


#: Keywords that the driver's invented prose holds, in place of the library's own.
_WORDS = {"english": [("sin", 1), ("our", 2), ("par", 2), ("the", 1), ("tion", 2)], "german": [("der", 2), ("sch", 3), ("und", 1)], "french": [("eau", 3), ("que", 2), ("le", 1)]}


def _points(word: str, weight: int) -> str:
    return f"least((length(t) - length(replace(t, '{word}', ''))) // {len(word)}, 3) * {weight}"


_MATCHED = ", ".join(f"CASE WHEN contains(t, '{w}') THEN '{w}' END" for words in _WORDS.values() for w, _ in words)


@query(f"""
WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), s AS (SELECT *, {", ".join(f"{' + '.join(_points(w, n) for w, n in words)} AS {kind}" for kind, words in _WORDS.items())} FROM d),
b AS (SELECT *, greatest(english, german, french) AS best FROM s)
SELECT doc_id, CASE WHEN best = 0 THEN 'generic_ode' WHEN english = best THEN 'english' WHEN german = best THEN 'german' ELSE 'french' END AS model_type,
  floor(best / (best + 5.0) * 100 + 0.5) / 100 AS confidence, array_to_string(list_sort(list_filter([{_MATCHED}], lambda x: x IS NOT NULL)), ',') AS keywords FROM b""")
def keyword_classifier(spark: SparkSession, d: str) -> DataFrame:
    out = C.classify(_t(spark, d, "documents").select("doc_id", "text"), {"source_text": (F.col("text"), 1)}, _WORDS)
    return out.select("doc_id", "model_type", "confidence", F.array_join("matched_keywords", ",").alias("keywords"))


@query("SELECT event_id, 'repaired' AS status, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, 'not_needed', CAST(json_extract(props, '$.k') AS BIGINT) FROM events WHERE event_id % 3 = 0")
def json_repair(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\n"))).otherwise(F.concat(F.lit("Here it is "), "props", F.lit(" as asked.")))
    out = e.select("event_id", repaired(raw).alias("r"))
    return out.select("event_id", "r.status", F.get_json_object("r.json", "$.k").cast("long").alias("k"))


@query("""
SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'k: required' WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) > 90 THEN 'k: too large' END AS reason FROM events
WHERE json_extract_string(props, '$.k') IS NULL OR TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) > 90""")
def json_validate_rejects(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    reason = F.when(k.isNull(), "k: required").when(k.try_cast("long") > 90, "k: too large")
    return _t(spark, d, "events").select("event_id", reason.alias("reason")).where(F.col("reason").isNotNull())


@query("SELECT p_partkey AS part, CAST(regexp_extract(p_brand, '[0-9]+') AS DOUBLE) AS num, true AS ok FROM part WHERE regexp_matches(p_brand, '[0-9]') UNION ALL SELECT p_partkey, 0.0, false FROM part WHERE NOT regexp_matches(p_brand, '[0-9]')")
def parse_numeric(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("part"), parse_number("p_brand").alias("n")).select("part", "n.num", "n.ok")


@query("SELECT 'order' AS kind, o_orderkey AS id FROM orders UNION ALL SELECT 'line', l_orderkey FROM lineitem")
def kind_union(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id")).unionByName(_t(spark, d, "lineitem").select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("id")))


_PAIRED = "SELECT c.conv_id, c.turn, string_split(lower(c.text), ' ') AS a, string_split(lower(b.text), ' ') AS b FROM conversations c JOIN benchmark b ON b.item_id = c.conv_id % 40"


@query(f"""
SELECT conv_id, turn, floor(len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b))) * 1e6 + 0.5) / 1e6 AS jaccard,
  CASE WHEN len(list_intersect(list_distinct(a), list_distinct(b))) >= 0.5 * len(list_distinct(b)) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS recall FROM ({_PAIRED})""")
def jaccard_recall(spark: SparkSession, d: str) -> DataFrame:
    b = _t(spark, d, "benchmark").select("item_id", F.split(F.lower("text"), " ").alias("b"))
    c = _t(spark, d, "conversations").select("conv_id", "turn", F.split(F.lower("text"), " ").alias("a"), (F.col("conv_id") % 40).alias("item_id")).join(b, "item_id")
    return c.select("conv_id", "turn", round_half_up(evaluate.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), evaluate.recall(F.array("a"), F.array("b")).alias("recall"))


@query("""
WITH i AS (SELECT item_id, string_split(lower(text), ' ') AS b FROM benchmark),
m AS (SELECT greatest(1, least((SELECT count(*) FROM benchmark), (SELECT count(DISTINCT conv_id) FROM conversations))) AS m),
p AS (SELECT item_id, conv_id, turn, coalesce(string_split(lower(c.text), ' '), []) AS a, b FROM i CROSS JOIN m LEFT JOIN conversations c ON c.conv_id % m.m = i.item_id % m.m)
SELECT item_id, conv_id, turn, floor(len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b))) * 1e6 + 0.5) / 1e6 AS jaccard,
  CASE WHEN len(list_intersect(list_distinct(a), list_distinct(b))) >= 0.5 * len(list_distinct(b)) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS recall FROM p""")
def recall_cover(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item against texts: conversations and items are dealt by their ids over as many numbers as the fewer of them are,
    both measured; an item that no conversation meets is there with nulls and scores of 0."""
    b, c = _t(spark, d, "benchmark"), _t(spark, d, "conversations")
    m = max(1, min(b.count(), c.select(F.count_distinct("conv_id")).first()[0]))
    items = b.select("item_id", F.split(F.lower("text"), " ").alias("b"), (F.col("item_id") % m).alias("place"))
    texts = c.select("conv_id", "turn", F.split(F.lower("text"), " ").alias("a"), (F.col("conv_id") % m).alias("place"))
    both = items.join(texts, "place", "left").withColumn("a", F.coalesce("a", F.array().cast("array<string>")))
    return both.select("item_id", "conv_id", "turn", round_half_up(evaluate.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), evaluate.recall(F.array("a"), F.array("b")).alias("recall"))


@query("""
WITH s AS (SELECT source, quality * 1.0 AS quality, toxic * 1.0 AS toxic, 0.6 * quality + 0.4 * (1 - toxic) AS overall FROM labels JOIN documents USING (doc_id)),
r AS (SELECT source, floor(quality * 100 + 0.5) / 100 AS quality, floor(toxic * 100 + 0.5) / 100 AS toxic, floor(overall * 100 + 0.5) / 100 AS overall FROM s)
SELECT source, count(*) AS fixtures, floor(avg(quality) * 100 + 0.5) / 100 AS quality, floor(avg(clean) * 100 + 0.5) / 100 AS clean, floor(avg(overall) * 100 + 0.5) / 100 AS overall FROM (SELECT *, 1 - toxic AS clean FROM r) GROUP BY source""")
def weighted_overall(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "source"), "doc_id").select("source", F.col("quality").cast("double").alias("quality"), (1.0 - F.col("toxic")).alias("clean"))
    weights = {"quality": 0.6, "clean": 0.4}
    return evaluate.report(evaluate.overall(rows, weights), "source", weights)


@query("""
SELECT event_id, coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM events""")
def monotonic_time(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return _t(spark, d, "events").select("event_id", F.coalesce(F.col("value") > F.max("value").over(w), F.lit(True)).alias("accepted"))


def _series(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select(F.col("user_id").alias("file_id"), F.struct("ts", "event_id").alias("t"), F.col("value").alias("X"), F.col("event_id").alias("S"))


@query('SELECT user_id AS file_id, value AS "X0", event_id AS "S0" FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1')
def first_row_init(spark: SparkSession, d: str) -> DataFrame:
    return series_csv.first_rows(_series(spark, d))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE i % 5 = 0 OR i = n - 1")
def decimate(spark: SparkSession, d: str) -> DataFrame:
    return series_csv.decimated(_series(spark, d), "file_id", "t", 5).select(F.col("S").alias("event_id"))


@query("""
WITH p AS (SELECT e.user_id, e.value, m.p FROM events e JOIN (SELECT event_type, avg(value) AS p FROM events GROUP BY 1) m USING (event_type)),
q AS (SELECT *, avg(value) OVER (PARTITION BY user_id) AS mean FROM p),
r AS (SELECT user_id, count(*) AS n, sqrt(sum((value - p) ** 2) / count(*)) AS rmse, CASE WHEN sum((value - mean) ** 2) = 0 THEN 1.0 ELSE 1 - sum((value - p) ** 2) / sum((value - mean) ** 2) END AS r2 FROM q GROUP BY 1)
SELECT user_id, n, floor(rmse * 1e4 + 0.5) / 1e4 AS rmse, CASE WHEN n = 1 THEN NULL ELSE floor(r2 * 1e2 + 0.5) / 1e2 END AS r2 FROM r""")
def rmse_r2(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select("user_id", "event_type", "value")
    rows = e.join(e.groupBy("event_type").agg(F.avg("value").alias("p")), "event_type")
    out = evaluate.error_scores(rows, ["user_id"], "value", "p")
    return out.select("user_id", "n", round_half_up("rmse", 4).alias("rmse"), F.when(F.col("n") > 1, round_half_up("r2", 2)).alias("r2"))


@query("SELECT event_type, floor(greatest(1e-6, avg(value * value)) * 1e3 + 0.5) / 1e3 AS mean_square FROM events GROUP BY 1")
def mean_squares(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").groupBy("event_type").agg(round_half_up(evaluate.mean_square("value"), 3).alias("mean_square"))


@query("SELECT user_id AS series, ts AS t, value AS value_fit, NULL AS value_measured FROM events UNION ALL SELECT user_id, ts + INTERVAL 1 HOUR, NULL, value FROM events WHERE event_type = 'click'")
def time_series_union(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select(F.col("user_id").alias("series"), F.col("ts").alias("t"), "value", "event_type")
    late = e.where("event_type = 'click'").select("series", (F.col("t") + F.expr("INTERVAL 1 HOUR")).alias("t"), "value")
    return simulate.with_measured(e.drop("event_type"), late, "series")


@query("""
WITH c AS (SELECT doc_id, length(text) AS n, length(text) // 3 AS size FROM documents WHERE len(regexp_split_to_array(text, chr(12) || '|' || chr(10) || chr(10) || chr(10))) <> 3)
SELECT doc_id, size AS first_page, n - 2 * size AS last_page FROM c""")
def page_char_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").where(F.size(F.split("text", "\f|\n\n\n")) != 3)
    counts = rows.select("doc_id", ingest.page_chars("text", 3).alias("c"))
    return counts.select("doc_id", F.element_at("c", 1).cast("long").alias("first_page"), F.element_at("c", 3).cast("long").alias("last_page"))


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words, length(text) AS chars FROM documents")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", ingest.word_count("text").cast("long").alias("words"), F.length("text").cast("long").alias("chars"))


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("value"), F.lit(False).alias("edited_by_user"), F.lit(None).cast("string").alias("original_value"))
    patches = p.where("id % 7 = 0").select("id", F.upper("name").alias("name"), F.when(F.col("id") % 2 == 0, F.col("value") + 1.0).alias("value"))
    return p, patches


@query("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN upper(p_name) ELSE p_name END AS name, CASE WHEN p_partkey % 14 = 0 THEN p_retailprice + 1.0 ELSE p_retailprice END AS value,
  p_partkey % 7 = 0 AS edited, CASE WHEN p_partkey % 7 = 0 THEN p_name END AS old_name FROM part""")
def patch_first_edit(spark: SparkSession, d: str) -> DataFrame:
    p, patches = _items(spark, d)
    again = patches.select("id", F.lit(None).cast("string").alias("name"))
    out = editing.patch(editing.patch(p, patches, ("name", "value")), again, ("name",))
    return out.select("id", "name", "value", F.col("edited_by_user").alias("edited"), F.get_json_object("original_value", "$.name").alias("old_name"))


@query("SELECT p_partkey AS id, p_name AS name, p_retailprice AS value, false AS edited FROM part")
def reset_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    p, patches = _items(spark, d)
    out = editing.reset(editing.patch(p, patches, ("name", "value")), patches.select("id"), ("name", "value"))
    return out.select("id", "name", "value", F.col("edited_by_user").alias("edited"))


@query("""
SELECT 'projects' AS tab, count(*) AS n FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT 'extractions', count(*) FROM orders WHERE o_custkey % 5 <> 0
UNION ALL SELECT 'variables', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 5 = 0)""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    tables = {
        "projects": _t(spark, d, "customer").select(F.col("c_custkey").alias("id")), "extractions": _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), F.lit(None).cast("long").alias("source_document_id")),
        "variables": _t(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("extraction_id")),
    }
    left = store.delete_cascade(tables, "projects", tables["projects"].where("id % 5 = 0"))
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "n") for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT -1, 'new'")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    new = rows.where("id % 4 = 0").select("id", F.lit("new").alias("segment")).union(spark.range(1).select(F.lit(-1).cast("long"), F.lit("new")))
    return store.upsert(rows, new, "id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'public' WHEN c_mktsegment = 'BUILDING' THEN 'public' ELSE 'private' END AS visibility FROM customer")
def visibility_update(spark: SparkSession, d: str) -> DataFrame:
    p = _projects(spark, d)
    return editing.set_visibility(p, p.where("id % 3 = 0"), "public", F.lit(0.0)).select("id", "visibility")


@query("SELECT c_custkey AS id FROM customer UNION SELECT s_suppkey + 1000000 FROM supplier")
def seed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers as seeds; half of the seeds are there already."""
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    seeds = _t(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("id")).unionByName(rows.where("id % 2 = 0"))
    return store.seed(rows, seeds, "id")


#: Units and their dimensions.
_UNITS = {"": "-", "dimensionless": "-", "g/g": "-", "g-X/g-S": "-", "g/L": "M·V^-1", "1/h": "T^-1", "h^-1": "T^-1", "h-1": "T^-1", "g/L/h": "M·V^-1·T^-1", "h": "T", "mol/L": "V^-1·N", "furlongs/fortnight": None}
_DIMS = ", ".join(f"({i}, {'NULL' if v is None else repr(v)})" for i, v in enumerate(_UNITS.values()))


@query(f"SELECT s_suppkey AS id, u.dims FROM supplier JOIN (VALUES {_DIMS}) u(k, dims) ON s_suppkey % 12 = u.k")
def unit_dims(spark: SparkSession, d: str) -> DataFrame:
    """Units of all shapes, one a supplier; read for each distinct unit."""
    names = F.element_at(F.array(*map(F.lit, _UNITS)), (F.col("s_suppkey") % 12 + 1).cast("int"))
    return _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), label(parse_unit(names)).alias("dims"))


def _cards(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A chemostat card for each supplier: extractions, equations, variables and parameters."""
    e = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("extraction_id"), "s_name")
    rows = lambda kind, items: e.select("extraction_id", F.posexplode(F.array(*items)).alias("ordinal", "x")).select("extraction_id", "ordinal", "x.*")
    item = lambda **f: F.struct(*(F.lit(v).alias(k) for k, v in f.items()))
    eq = [item(latex=t, description="", source_quote="q") for t in ("mu = mumax * S / (Ks + S)", "dX/dt = (mu - D) * X", "dS/dt = D * (Sin - S) - (1/Yxs) * mu * X", "dX/dt = -k * X", "a = b")]
    var = [item(symbol=s, name=s, unit=u, role=r, source_quote="q") for s, u, r in (("X", "g/L", "state"), ("S", "g/L", "state"), ("t", "h", "input"))]
    par = [item(symbol=s, name=s, value=v, unit=u, confidence="high", source_quote="q") for s, v, u in (("mumax", 0.5, "1/h"), ("Ks", 0.2, "g/L"), ("D", 0.3, "1/h"), ("Sin", 10.0, "g/L"), ("Yxs", 0.5, "g/g"), ("mu", 0.4, "1/h"))]
    return e, rows("e", eq), rows("v", var), rows("p", par)


@query()
def formal_patterns(spark: SparkSession, d: str) -> DataFrame:
    _, eq, var, par = _cards(spark, d)
    return units.formal(eq, units.dimension_map(var, par)).select("extraction_id", "ordinal", "pattern", "parsed", "matches", "lhs", F.array_join("issues", "; ").alias("issues"))


@query()
def template_match(spark: SparkSession, d: str) -> DataFrame:
    _, eq, var, par = _cards(spark, d)
    return templates.match(eq, var, par).select("extraction_id", "ordinal", "kind", "template", "code", "runnable")


@query()
def heuristic_units(spark: SparkSession, d: str) -> DataFrame:
    e, eq, var, par = _cards(spark, d)
    return units.heuristic(e.select("extraction_id", F.lit("chemostat").alias("corpus")), eq.withColumn("variables_involved", F.lit(None).cast("array<string>")), var, par)


@query()
def rk4_simulate(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (0.1 + (F.col("s_suppkey") % 4) * 0.1).alias("D"), F.lit(10.0).alias("T"))
    return simulate.simulate(p)


@query()
def monod_fit(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (0.4 + (F.col("s_suppkey") % 4) * 0.05).alias("mumax"), F.lit(16.0).alias("T"), F.lit(0.05).alias("dt"))
    measured = series_csv.decimated(simulate.simulate(p), "id", "t", 20)
    return simulate.fit(measured.withColumnRenamed("id", "series_id"))


@query()
def codegen_package(spark: SparkSession, d: str) -> DataFrame:
    e, eq, var, par = _cards(spark, d)
    return package(e.select("extraction_id", F.col("s_name").alias("title")), eq, var, par)


@query("SELECT s_suppkey AS id, CASE WHEN dd >= 0.5 THEN 10.0 ELSE floor(dd * 0.2 / (0.5 - dd) * 1e6 + 0.5) / 1e6 END AS s, dd >= 0.5 AS washout FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 0.25 WHEN 1 THEN 0.125 ELSE 0.75 END AS dd FROM supplier)")
def steady_states(spark: SparkSession, d: str) -> DataFrame:
    rate = F.when(F.col("s_suppkey") % 3 == 0, 0.25).when(F.col("s_suppkey") % 3 == 1, 0.125).otherwise(0.75)
    at = simulate.steady_state(F.lit(0.5), F.lit(0.2), F.lit(0.5), rate, F.lit(10.0))
    out = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), at.alias("r"))
    return out.select("id", round_half_up("r.S", 6).alias("s"), F.col("r.washout").alias("washout"))


@query("SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'tion', ''))) // 4 AS INT) AS n, lower(trim(source)) AS source FROM documents")
def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", hits("text", "tion").alias("n"), norm("source").alias("source"))

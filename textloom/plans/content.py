"""Queries over documents as content: statistics, identity, checks, text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, runs, text
from ..operators import checks, stats
from ..schema import blocks_of_documents, table


def content_stats_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return stats.content_stats(table(spark, d, "documents").select("lang", "text"), "lang")


def word_count_blocks(spark: SparkSession, d: str) -> DataFrame:
    body = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id",
        text.count_words(body).cast("long").alias("words"),
        text.count_chars(body).cast("long").alias("chars"),
        text.token_estimate(body).cast("long").alias("tokens"),
    )


def lint_findings(spark: SparkSession, d: str) -> DataFrame:
    return checks.lint(table(spark, d, "documents"), ["doc_id"], "text")


def doubled_words(spark: SparkSession, d: str) -> DataFrame:
    return checks.doubled_words(table(spark, d, "documents"), ["doc_id"], "text")


def length_limits(spark: SparkSession, d: str) -> DataFrame:
    return checks.length_limits(table(spark, d, "documents"), ["doc_id"], "text", chars=5000, words=1000)


def lint_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = checks.lint(docs, ["doc_id"], "text").unionByName(checks.length_limits(docs, ["doc_id"], "text", 5000, 1000))
    words = docs.select("doc_id", text.count_words(F.col("text")).alias("words"))
    return checks.scores(found, ["doc_id"], words).select("doc_id", "penalty", F.col("score").cast("long"))


def duplicate_blocks(spark: SparkSession, d: str) -> DataFrame:
    hashed = table(spark, d, "documents").select("doc_id", identity.content_hash(F.col("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


def repetition_classes(spark: SparkSession, d: str) -> DataFrame:
    blocks = blocks_of_documents(table(spark, d, "documents")).withColumn("number", F.col("doc_id").cast("long"))
    out = stats.repetitions(blocks, ["number", "seq"])
    return out.groupBy("class").agg(F.count(F.lit(1)).alias("blocks"), F.sum(text.count_words(F.col("source_text"))).alias("words"))


def record_hashes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    properties = F.create_map(F.lit("source"), F.col("source"), F.lit("@seen"), F.lit("x"), F.lit("lang"), F.col("lang"))
    content = identity.content_hash(F.col("text"))
    context = identity.context_hash(F.lit("text"), F.lit("paragraph"), properties)
    return docs.select("doc_id", content.alias("content_hash"), context.alias("context_hash"), identity.record_hash(content, context).alias("record_hash"))


def tree_root_hashes(spark: SparkSession, d: str) -> DataFrame:
    blocks = blocks_of_documents(table(spark, d, "documents")).select("doc_id", identity.content_hash(F.col("source_text")).alias("h"))
    return blocks.groupBy("doc_id").agg(identity.set_hash(F.col("h")).alias("item_hash"), F.count(F.lit(1)).alias("blocks"))


def encoding_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang", text.encoding(F.col("text")).alias("encoding")).agg(F.count(F.lit(1)).alias("n"))


def whitespace_corrected(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(text.correct_space(F.col("text")), 256).alias("fixed_hash"))


def pseudo_translated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.pseudo(F.concat_ws(" ", "p_name", F.lit("{size}"), "p_brand"), expand=30).alias("pseudo"))


def search_replaced(spark: SparkSession, d: str) -> DataFrame:
    pairs = [("Brand#", "brand "), ("1", "one ")]
    return table(spark, d, "part").select(
        "p_partkey",
        text.search_replace(F.col("p_brand"), pairs).alias("literal"),
        text.search_replace(F.col("p_name"), [("(red|blue) (\\w+)", "$2 in $1")], regex=True).alias("swapped"),
    )


def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", text.slug(F.col("c_name")).alias("slug"), text.truncate(F.col("c_name"), 8).alias("short"))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    at = F.instr(F.lower("text"), "the ").cast("int")
    docs = table(spark, d, "documents").withColumn("at", at).filter("at > 0")
    return docs.select("doc_id", F.col("at").cast("long").alias("place"), text.snippet(F.col("text"), F.col("at") - 1, F.col("at") + 2).alias("snippet"))


def grep_files(spark: SparkSession, d: str) -> DataFrame:
    """Lines with one of some words, by source: lines, documents, and documents without (grep -c, -l, -L)."""
    lines = table(spark, d, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    marked = lines.withColumn("hit", F.col("line").rlike(r"(?i)(?:^|[^a-z0-9_])(?:this|with|und|les)(?:$|[^a-z0-9_])"))
    per_doc = marked.groupBy("source", "doc_id").agg(F.count_if("hit").alias("hits"))
    return per_doc.groupBy("source").agg(
        F.sum("hits").alias("lines"), F.count_if(F.col("hits") > 0).alias("with_hits"), F.count_if(F.col("hits") == 0).alias("without")
    )


def text_search(spark: SparkSession, d: str) -> DataFrame:
    needle = "the of"
    return table(spark, d, "documents").filter(F.contains(F.lower("text"), F.lit(needle)) & F.col("lang").isin("en", "de")).select("doc_id", "lang")


def placeholder_findings(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    pairs = table(spark, d, "orders").select(
        "o_orderkey",
        F.concat(F.lit("Order {id} of ${user}: %s, {id} "), F.col("o_orderpriority")).alias("s"),
        F.when(key % 5 == 0, "Bestellung {id} von ${user}: %s").when(key % 7 == 0, "{id} {id} ${user} %s %d").otherwise("{id}: %s von ${user}, {id}").alias("t"),
    )
    return checks.placeholder_findings(pairs, ["o_orderkey"], "s", "t")


def required_terms(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("ring", "anello", "major"), ("bolt", "bullone", "minor"), ("red", "rosso", "neutral")], "term string, target_term string, severity string")
    pairs = table(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 2 == 0, F.replace("p_name", F.lit("ring"), F.lit("anello"))).otherwise(F.col("p_name")).alias("t"))
    return checks.required_terms(pairs, rules, ["p_partkey"], "p_name", "t")


def keep_terms(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 10 == 0, F.lower("c_name")).otherwise(F.col("c_name")).alias("t"))
    return checks.keep_terms(pairs, ["Customer", "#"], ["c_custkey"], "c_name", "t")


def inconsistent_targets(spark: SparkSession, d: str) -> DataFrame:
    return checks.inconsistent_targets(table(spark, d, "part"), "p_name", "p_brand")


def run_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of texts with inline codes: a bold name, an entity placeholder, a break."""

    def run(kind: str, **fields: object) -> object:
        names = ["kind", "text", "id", "type", "subtype", "data", "equiv", "disp"]
        values = {"kind": F.lit(kind), **fields}
        cells = [F.coalesce(values.get(n, F.lit(None).cast("string")), F.lit(None).cast("string")).alias(n) for n in names]
        return F.struct(*cells, F.lit(None).cast("map<string,string>").alias("forms"))

    source = F.array(
        run("text", text=F.lit("Buy ")),
        run("pcOpen", id=F.lit("1"), data=F.lit("<b>")),
        run("text", text=F.col("p_name")),
        run("pcClose", id=F.lit("1"), data=F.lit("</b>")),
        run("text", text=F.lit(" by ")),
        run("ph", id=F.lit("2"), type=F.lit("entity:brand"), equiv=F.lit("brand"), data=F.col("p_brand")),
        run("ph", id=F.lit("3"), type=F.lit("struct:break"), data=F.lit("<br/>"), equiv=F.lit("")),
        run("text", text=F.lit("now")),
    )
    part = table(spark, d, "part").select("p_partkey", source.alias("r"))
    return part.select(
        "p_partkey",
        runs.plain_key(F.col("r")).alias("plain"),
        runs.structural_key(F.col("r")).alias("structural"),
        runs.generalized_key(F.col("r")).alias("generalized"),
        runs.plain_text(runs.strip_codes(F.col("r"))).alias("stripped"),
        F.try_element_at(runs.entity_values(F.col("r")), F.lit("2")).alias("entity"),
        F.get(F.transform(runs.classify_spans(F.col("r")), lambda x: x["type"]), F.lit(1)).alias("span"),
    )


def timecodes(spark: SparkSession, d: str) -> DataFrame:
    ms = (F.col("l_orderkey") * 1234567 + F.col("l_linenumber") * 89) % 86400000
    base = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.format_timecode(ms).alias("code"))
    return base.groupBy("code").agg(F.count(F.lit(1)).alias("n")).select("code", text.timecode_ms(F.col("code")).alias("ms"), "n")


LOWER_TRIM = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"
LINES = "(SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS seq FROM documents)"
LINT = r"""
SELECT doc_id, unnest(list_filter([
  CASE WHEN NOT filled THEN 'empty' END, CASE WHEN filled AND regexp_matches(t, '\A\s') THEN 'leading-whitespace' END,
  CASE WHEN filled AND regexp_matches(regexp_replace(t, '\r?\n\z', ''), '\s\z') THEN 'trailing-whitespace' END,
  CASE WHEN filled AND contains(t, '  ') THEN 'double-spaces' END,
  CASE WHEN filled AND len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1] AND regexp_matches(w[i], '[\pL\pN]'))) > 0 THEN 'doubled-word' END,
  CASE WHEN filled AND regexp_matches(t, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]') THEN 'control-char' END
  ], lambda x: x IS NOT NULL)) AS category, CASE category WHEN 'empty' THEN 'major' ELSE 'minor' END AS severity
FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_matches(t, '\S') AS filled, regexp_split_to_array(lower(t), '[ \n\t]+') AS w FROM documents)
"""
LIMITS = r"""
SELECT doc_id, 'too_many_chars' AS category, 'major' AS severity FROM documents WHERE length(text) > 5000
UNION ALL SELECT doc_id, 'too_many_words', 'minor' FROM documents WHERE len(regexp_extract_all(text, '[^\s]+')) > 1000
"""

QUERIES = {
    "content_stats_by_lang": (
        content_stats_by_lang,
        r"""
WITH c AS (SELECT lang, count(DISTINCT c) AS unique_chars FROM (SELECT lang, unnest(string_split(text, '')) AS c FROM documents) GROUP BY lang)
SELECT lang, count(*) AS blocks, CAST(sum(len(regexp_extract_all(text, '[^\s\x{E000}-\x{F8FF}]+'))) AS BIGINT) AS words,
       CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(regexp_replace(text, '\s', '', 'g'))) AS BIGINT) AS chars_no_space,
       max(unique_chars) AS unique_chars
FROM documents JOIN c USING (lang) GROUP BY lang""",
    ),
    "word_count_blocks": (
        word_count_blocks,
        r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\s]+')) AS BIGINT) AS words, CAST(length(text) AS BIGINT) AS chars, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents",
    ),
    "lint_findings": (lint_findings, LINT),
    "doubled_words": (
        doubled_words,
        r"""
WITH w AS (SELECT doc_id, regexp_split_to_array(lower(text), '[ \n\t]+') AS w FROM documents)
SELECT doc_id, CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1] AND regexp_matches(w[i], '[\pL\pN]'))) AS BIGINT) AS places
FROM w WHERE places > 0""",
    ),
    "length_limits": (length_limits, LIMITS),
    "lint_scores": (
        lint_scores,
        rf"""
WITH f AS (SELECT * FROM ({LINT}) UNION ALL SELECT * FROM ({LIMITS})),
p AS (SELECT doc_id, sum(CASE severity WHEN 'minor' THEN 1 WHEN 'major' THEN 5 WHEN 'critical' THEN 25 ELSE 0 END) AS penalty FROM f GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(penalty, 0) AS BIGINT) AS penalty,
       CAST(greatest(100 - floor(coalesce(penalty, 0) * 100 / greatest(len(regexp_extract_all(text, '[^\s]+')), 1) + 0.5), 0) AS BIGINT) AS score
FROM documents LEFT JOIN p USING (doc_id)""",
    ),
    "duplicate_blocks": (
        duplicate_blocks,
        f"SELECT sha256({LOWER_TRIM}) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    ),
    "repetition_classes": (
        repetition_classes,
        rf"""
WITH b AS (SELECT * FROM {LINES} WHERE regexp_matches(line, '\S')),
h AS (SELECT line, count(*) OVER g AS n, row_number() OVER (g ORDER BY doc_id, seq) AS i FROM b
      WINDOW g AS (PARTITION BY regexp_replace(line, '^\s+|\s+$', '', 'g')))
SELECT CASE WHEN n = 1 THEN 'unique' WHEN i = 1 THEN 'first' ELSE 'repetition' END AS class, count(*) AS blocks,
       CAST(sum(len(regexp_extract_all(line, '[^\s]+'))) AS BIGINT) AS words
FROM h GROUP BY 1""",
    ),
    "record_hashes": (
        record_hashes,
        f"""
WITH h AS (SELECT doc_id, sha256({LOWER_TRIM}) AS content_hash,
  sha256('text' || chr(0) || 'paragraph' || chr(0) || 'lang' || chr(0) || lang || chr(0) || 'source' || chr(0) || source || chr(0)) AS context_hash FROM documents)
SELECT *, sha256(content_hash || chr(0) || context_hash) AS record_hash FROM h""",
    ),
    "tree_root_hashes": (
        tree_root_hashes,
        rf"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(array_to_string(list_sort(list(sha256(regexp_replace(line, '^\s+|\s+$', '', 'g')))), '')) AS item_hash, count(*) AS blocks
FROM {LINES} WHERE regexp_matches(line, '\S') GROUP BY doc_id""",
    ),
    "encoding_kinds": (
        encoding_kinds,
        "SELECT lang, CASE WHEN strlen(text) = length(text) THEN 'ascii' ELSE 'utf-8' END AS encoding, count(*) AS n FROM documents GROUP BY 1, 2",
    ),
    "whitespace_corrected": (
        whitespace_corrected,
        r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]', '', 'g'), '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS fixed_hash FROM documents",
    ),
    "pseudo_translated": (
        pseudo_translated,
        f"""
SELECT p_partkey, '[' || translate(p_name || ' ', '{text.ACCENTS_FROM}', '{text.ACCENTS_TO}') || '{{size}}' || translate(' ' || p_brand, '{text.ACCENTS_FROM}', '{text.ACCENTS_TO}')
  || repeat('~', CAST(ceil(length(p_name || ' {{size}} ' || p_brand) * 30 / 100.0) AS BIGINT)) || ']' AS pseudo FROM part""",
    ),
    "search_replaced": (
        search_replaced,
        r"SELECT p_partkey, replace(replace(p_brand, 'Brand#', 'brand '), '1', 'one ') AS literal, regexp_replace(p_name, '(red|blue) (\w+)', '\2 in \1', 'g') AS swapped FROM part",
    ),
    "slugs": (slugs, "SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS slug, substr(c_name, 1, 8) AS short FROM customer"),
    "snippets": (
        snippets,
        r"""
WITH a AS (SELECT doc_id, text, instr(lower(text), 'the ') AS place FROM documents),
b AS (SELECT *, greatest(place - 1 - 48, 0) AS f, least(place + 2 + 48, length(text)) AS l FROM a WHERE place > 0)
SELECT doc_id, place, CASE WHEN f > 0 THEN '…' ELSE '' END
  || regexp_replace(regexp_replace(substr(text, f + 1, l - f), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')
  || CASE WHEN l < length(text) THEN '…' ELSE '' END AS snippet FROM b""",
    ),
    "grep_files": (
        grep_files,
        rf"""
WITH p AS (SELECT source, doc_id, count(*) FILTER (regexp_matches(line, '(?i)(?:^|[^a-z0-9_])(?:this|with|und|les)(?:$|[^a-z0-9_])')) AS hits FROM {LINES} GROUP BY 1, 2)
SELECT source, CAST(sum(hits) AS BIGINT) AS lines, count(*) FILTER (hits > 0) AS with_hits, count(*) FILTER (hits = 0) AS without FROM p GROUP BY source""",
    ),
    "text_search": (text_search, "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'the of') AND lang IN ('en', 'de')"),
    "placeholder_findings": (
        placeholder_findings,
        """
WITH s AS (SELECT o_orderkey, unnest(['{id}', '${user}', '%s', '{id}']) AS token, 1 AS n FROM orders),
t AS (SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 5 = 0 THEN ['{id}', '${user}', '%s'] WHEN o_orderkey % 7 = 0 THEN ['{id}', '{id}', '${user}', '%s', '%d'] ELSE ['{id}', '%s', '${user}', '{id}'] END) AS token, -1 AS n FROM orders),
d AS (SELECT o_orderkey, token, sum(n) AS delta FROM (SELECT * FROM s UNION ALL SELECT * FROM t) GROUP BY 1, 2)
SELECT o_orderkey, token, CAST(abs(delta) AS BIGINT) AS n, CASE WHEN delta > 0 THEN 'missing' ELSE 'extra' END AS category,
       CASE WHEN delta > 0 THEN 'critical' ELSE 'major' END AS severity FROM d WHERE delta <> 0""",
    ),
    "required_terms": (
        required_terms,
        """
WITH r(term, target_term, severity) AS (VALUES ('ring', 'anello', 'major'), ('bolt', 'bullone', 'minor'), ('red', 'rosso', 'neutral')),
p AS (SELECT p_partkey, p_name, CASE WHEN p_size % 2 = 0 THEN replace(p_name, 'ring', 'anello') ELSE p_name END AS t FROM part)
SELECT p_partkey, term, target_term, severity FROM p, r WHERE contains(p_name, term) AND NOT contains(t, target_term)""",
    ),
    "keep_terms": (
        keep_terms,
        """
SELECT c_custkey, term, 'critical' AS severity FROM customer, (VALUES ('Customer'), ('#')) AS t(term)
WHERE contains(c_name, term) AND NOT contains(CASE WHEN c_custkey % 10 = 0 THEN lower(c_name) ELSE c_name END, term)""",
    ),
    "inconsistent_targets": (
        inconsistent_targets,
        "SELECT p_name, count(DISTINCT p_brand) AS targets FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1",
    ),
    "run_keys": (
        run_keys,
        """
SELECT p_partkey, 'Buy ' || p_name || ' by {brand}{}now' AS plain, 'Buy {1}' || p_name || '{/1} by {2/}{3/}now' AS structural,
       'Buy {1}' || p_name || '{/1} by {BRAND}{3/}now' AS generalized, 'Buy ' || p_name || ' by  now' AS stripped,
       p_brand AS entity, 'fmt:bold' AS span FROM part""",
    ),
    "timecodes": (
        timecodes,
        """
WITH m AS (SELECT (l_orderkey * 1234567 + l_linenumber * 89) % 86400000 AS ms FROM lineitem)
SELECT printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS code, ms, count(*) AS n FROM m GROUP BY 1, 2""",
    ),
}

"""Queries of term uses, vocabulary rules, layered streams and convergence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, converge, govern, layers, upkeep, usage
from ..schema import table
from . import script

TERMS = [(1, "the"), (2, "Of  the"), (3, "AND"), (4, "que"), (5, "of the and")]
RULES = [
    ("r1", "p", "base", "", "forbidden", "the and", None, None),
    ("r2", "p", "base", "", "competitor", "Of", None, " Minor "),
    ("r3", "p", "base", "", "preferred", "that", None, None),
    ("r4", "p", "locale", "EN", "preferred", "with", None, None),
    ("r5", "p", "persona", "src0", "forbidden", "ing", "ings", "minor"),
    ("r6", "p", "persona", "src0", "preferred", "of", None, None),
    ("r7", "p", "persona", "src1", "preferred", "for", None, None),
    ("r8", "p", "channel", "web", "forbidden", "with", None, None),
]


def _terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, "term_id int, term string")


def term_uses(spark: SparkSession, d: str) -> DataFrame:
    """How often, first and last each document uses each term."""
    uses = usage.occurrences(table(spark, d, "documents"), _terms(spark), "doc_id", "text")
    return uses.groupBy("doc_id", "term_id").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"), F.max("end").alias("last"))


def longest_term_uses(spark: SparkSession, d: str) -> DataFrame:
    """Uses by term where of overlapping ones the leftmost and longest counts."""
    uses = usage.occurrences(table(spark, d, "documents"), _terms(spark).filter("term_id in (1, 2)"), "doc_id", "text")
    return usage.longest_uses(uses, "doc_id").groupBy("doc_id", "term_id").agg(F.count(F.lit(1)).alias("n"))


def _resolved(spark: SparkSession, docs: DataFrame) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule_id string, profile string, layer string, layer_key string, kind string, term string, replacement string, severity string")
    scopes = docs.select(F.concat_ws("/", "lang", "source").alias("scope_id"), F.lit("p").alias("profile"), F.col("lang").alias("locale"), F.lit("web").alias("channel"), F.col("source").alias("persona")).distinct()
    return usage.resolved_rules(rules, scopes)


def scoped_rules(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, table(spark, d, "documents"))


def voice_scores(spark: SparkSession, d: str) -> DataFrame:
    """Vocabulary score of each document under the rules of its language and source."""
    docs = table(spark, d, "documents").withColumn("scope_id", F.concat_ws("/", "lang", "source"))
    found = usage.vocabulary_findings(docs, _resolved(spark, docs), "doc_id", "text")
    scores = govern.compliance_scores(found.select("doc_id", "category", "severity"), ["doc_id"], docs)
    return scores.filter("dimension = 'vocabulary'").select("doc_id", "score", "penalty", "issues")


def _entries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events as entries of three streams, the newest of each user and type; those of a small value take the entry away."""
    stream = F.element_at(F.array(F.lit("main"), F.lit("release"), F.lit("feature")), (F.col("event_id") % 3 + 1).cast("int"))
    events = table(spark, d, "events").withColumn("stream", stream)
    entries = events.groupBy("stream", "user_id", "event_type").agg(F.max("event_id").alias("event_id"))
    entries = entries.withColumn("deleted", F.col("event_id") % 5 == 0)
    streams = spark.createDataFrame([("main", None), ("release", "main"), ("feature", "release")], "stream string, parent string")
    return entries, layers.ancestors(streams)


def stream_entries(spark: SparkSession, d: str) -> DataFrame:
    """What each stream sees, its own entries before those of its parents."""
    entries, chain = _entries(spark, d)
    return layers.resolved_entries(entries, chain, ["user_id", "event_type"])


def stream_search(spark: SparkSession, d: str) -> DataFrame:
    """The second page of five clicks that each stream sees, with their number."""
    found = stream_entries(spark, d)
    order = [F.col("event_id").desc()]
    return layers.searched_page(found, F.col("event_type").contains("c"), order, 5, 5, by="stream").select("stream", "user_id", "event_type", "event_id", "layer", "place", "total")


def _run_events(spark: SparkSession, d: str) -> DataFrame:
    """A run per order: a locale per return flag, of whose lines those of a quantity below 40 are done."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_returnflag").alias("locale")).agg(
        F.count(F.lit(1)).alias("units"), F.count_if(F.col("l_quantity") < 40).alias("done")
    )
    odd = F.col("run_id").cast("long") % 2 == 1
    runs = lines.groupBy("run_id").agg(F.sort_array(F.collect_list(F.when(F.col("done") < F.col("units"), F.col("locale")))).alias("pending"))

    def event(seq: int, kind: str, frame: DataFrame, **values: object) -> DataFrame:
        named = {"pass": F.lit(1), "locale": F.lit(None).cast("string"), "units": F.lit(0).cast("long"), "done": F.lit(0).cast("long"), "via_memory": F.lit(0).cast("long"), "via_ai": F.lit(0).cast("long"),
                 "state": F.lit("").cast("string"), "failing_checks": F.lit(0), "files": F.lit(0), "pending": F.array().cast("array<string>"), **values}
        return frame.select("run_id", F.lit(seq).alias("seq"), F.lit(kind).alias("type"), *[c.alias(n) for n, c in named.items()])

    of_locale = {"locale": F.col("locale"), "units": F.col("units")}
    parts = [
        event(0, "pass_start", runs),
        event(1, "locale_start", lines, **of_locale),
        event(2, "locale_done", lines, **of_locale, done=F.col("done"), via_memory=F.col("done")),
        event(3, "pass_done", runs, pending=F.when(odd, F.col("pending")).otherwise(F.array().cast("array<string>")), failing_checks=F.size("pending")),
        event(4, "materialized", runs, files=F.lit(2)),
        event(5, "done", runs, state=F.when(odd & (F.size("pending") > 0), converge.PARKED).otherwise("converged")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def run_standing(spark: SparkSession, d: str) -> DataFrame:
    return converge.standing(_run_events(spark, d))


def converged_locales(spark: SparkSession, d: str) -> DataFrame:
    """Customers as work of their nations, produced in passes that each reach further; one in seven never is."""
    work = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("locale"))

    def produce(pending: DataFrame, number: int) -> DataFrame:
        return pending.filter((F.col("c_custkey") % 4 < number) & (F.col("c_custkey") % 7 != 0)).withColumn("produced_in", F.lit(number))

    produced, passes = converge.converge(work, produce, ["c_custkey"])
    counted = converge.locale_standing(work, produced, ["c_custkey"], "locale")
    return counted.withColumn("passes", F.lit(passes))


def script_sections(spark: SparkSession, d: str) -> DataFrame:
    """Lines of two words and more of each document, split off by a user's step; other lines are dropped."""

    def split(text: str | None):
        for place, line in enumerate((text or "").split("\n")):
            if len(line.split(" ")) > 1:
                yield place, len(line)

    docs = table(spark, d, "documents").select("doc_id", "text")
    return script.script(docs, split, ["text"], "place int, chars int", ["doc_id"])


class Longest(script.Collector):
    """The longest text of each language, of equal ones that of the smallest id, and the number of texts."""

    def empty(self):
        return {}

    def add(self, state, row):
        return self.merge(state, {row["lang"]: (row["chars"], -row["doc_id"], 1)})

    def merge(self, one, two):
        both = dict(one)
        for lang, (chars, order, n) in two.items():
            old = both.get(lang, (-1, 0, 0))
            both[lang] = (*max(old[:2], (chars, order)), old[2] + n)
        return both

    def result(self, state):
        return [{"lang": lang, "doc_id": -order, "chars": chars, "n": n} for lang, (chars, order, n) in state.items()]


def collected_longest(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", F.length("text").cast("long").alias("chars"))
    return script.collect(docs, Longest(), "lang string, doc_id long, chars long, n long", fan_in=8)


def overlaid_targets(spark: SparkSession, d: str) -> DataFrame:
    """Parts of each brand as documents and their translations, of which some lost their key, some their address, some both."""
    part = table(spark, d, "part").select("p_brand", "p_partkey", "p_name")
    key, address = F.concat(F.lit("k"), F.col("p_partkey")), F.concat(F.lit("a"), F.col("p_partkey"))
    sources = part.select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("seq"), key.alias("key"), address.alias("address"))
    lost = F.col("p_partkey") % 5
    targets = part.filter("p_brand <> 'Brand#11' or p_partkey % 7 <> 0").select(
        F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("seq"), F.when(lost < 3, key).otherwise(F.concat(F.lit("x"), key)).alias("key"), F.when(lost < 4, address).alias("address"), F.upper("p_name").alias("text")
    )
    return upkeep.overlay_targets(sources, targets).select("doc_id", "seq", "target_text", "paired_by")


def promoted_memory(spark: SparkSession, d: str) -> DataFrame:
    """Memory after decisions on the names of parts; every fifth decision is about an older target."""
    part = table(spark, d, "part")
    target = F.upper("p_name")
    units = [F.col("p_brand").alias("item"), F.col("p_partkey").cast("string").alias("unit"), F.lit("de").alias("locale")]
    blocks = part.select(*units, F.lit("en").alias("source_locale"), F.col("p_name").alias("source_text"), target.alias("target_text"))
    state = F.when(F.col("p_name").contains("red"), "rejected").when(F.col("p_partkey") % 3 == 0, "open").otherwise("approved")
    decisions = part.select(*units, state.alias("state"), F.sha2(F.when(F.col("p_partkey") % 5 == 0, F.lit("old")).otherwise(target), 256).alias("target_hash"))
    before = blocks.filter("source_text like '%bolt%'").select(F.concat(F.lit("old-"), "source_text").alias("entry_id"), "source_locale", F.col("locale").alias("target_locale"), "source_text", "target_text").distinct()
    return upkeep.promote_decisions(blocks, decisions, before).select("source_text", "target_text", F.col("entry_id").startswith("old-").alias("was_there"))


def masked_terms(spark: SparkSession, d: str) -> DataFrame:
    """Names with terms masked, and unmasked again after a change of case."""
    terms = ["old", "old ring", "widget "]
    masked = upkeep.mask_terms(F.col("p_name"), terms)
    return table(spark, d, "part").select("p_partkey", masked.alias("masked"), upkeep.unmask_terms(F.lower(masked), terms).alias("restored"))


def score_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Hygiene scores of documents by language."""
    docs = table(spark, d, "documents")
    found = checks.lint(docs, ["doc_id"], "text").unionByName(checks.length_limits(docs, ["doc_id"], "text", 500, 100))
    scored = govern.compliance_scores(found.withColumn("category", F.lit("style")), ["doc_id"], docs).filter("dimension = 'style'")
    return upkeep.score_summary(scored.join(docs.select("doc_id", "lang"), "doc_id"), "overall", ["lang"])


TOKENS = r"""
WITH p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?s)[^\pL\pN\pM_]*[\pL\pN\pM_]+') AS ps FROM documents),
u AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM p),
t AS (SELECT doc_id, i, regexp_extract(piece, '(?s)^[^\pL\pN\pM_]*') AS gap, lower(regexp_extract(piece, '[\pL\pN\pM_]+$')) AS w, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM u),
s AS (SELECT doc_id, i, gap, w, stop, stop - length(w) AS start, lead(w) OVER o AS w2, lead(gap) OVER o AS g2, lead(stop) OVER o AS stop2, lead(w, 2) OVER o AS w3, lead(gap, 2) OVER o AS g3, lead(stop, 2) OVER o AS stop3
  FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (
  SELECT doc_id, 1 AS term_id, start, stop AS "end" FROM s WHERE w = 'the'
  UNION ALL SELECT doc_id, 2, start, stop2 FROM s WHERE w = 'of' AND w2 = 'the' AND regexp_full_match(g2, '\s+')
  UNION ALL SELECT doc_id, 3, start, stop FROM s WHERE w = 'and'
  UNION ALL SELECT doc_id, 4, start, stop FROM s WHERE w = 'que'
  UNION ALL SELECT doc_id, 5, start, stop3 FROM s WHERE w = 'of' AND w2 = 'the' AND w3 = 'and' AND regexp_full_match(g2, '\s+') AND regexp_full_match(g3, '\s+')
)"""
ENTRIES = """
WITH e AS (SELECT ['main', 'release', 'feature'][event_id % 3 + 1] AS layer, user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL),
c(stream, layer, distance) AS (VALUES ('main', 'main', 0), ('release', 'release', 0), ('release', 'main', 1), ('feature', 'feature', 0), ('feature', 'release', 1), ('feature', 'main', 2)),
r AS (SELECT stream, user_id, event_type, arg_min(event_id, distance) AS event_id, arg_min(layer, distance) AS layer FROM e JOIN c USING (layer) GROUP BY ALL),
v AS (SELECT stream, user_id, event_type, layer, event_id FROM r WHERE event_id % 5 <> 0)"""

QUERIES = {
    "term_uses": (term_uses, TOKENS + ' SELECT doc_id, term_id, count(*) AS n, CAST(min(start) AS INT) AS first, CAST(max("end") AS INT) AS last FROM h GROUP BY ALL'),
    "longest_term_uses": (
        longest_term_uses,
        TOKENS
        + """ SELECT doc_id, term_id, count(*) AS n FROM h a WHERE term_id = 2 OR term_id = 1 AND NOT EXISTS (
  SELECT 1 FROM h b WHERE b.term_id = 2 AND b.doc_id = a.doc_id AND b."end" = a."end") GROUP BY ALL HAVING term_id IN (1, 2)""",
    ),
    "scoped_rules": (
        scoped_rules,
        """
WITH d AS (SELECT DISTINCT concat_ws('/', lang, source) AS scope_id, lang, source FROM documents)
SELECT scope_id, 'r1' AS rule_id, 'forbidden' AS kind, 'the and' AS term, NULL AS replacement, 'major' AS severity FROM d
UNION ALL SELECT scope_id, 'r2', 'competitor', 'Of', NULL, 'minor' FROM d
UNION ALL SELECT scope_id, 'r3', 'preferred', 'that', NULL, NULL FROM d
UNION ALL SELECT scope_id, 'r4', 'preferred', 'with', NULL, NULL FROM d WHERE lang = 'en'
UNION ALL SELECT scope_id, 'r5', 'forbidden', 'ing', 'ings', 'minor' FROM d WHERE source = 'src0'
UNION ALL SELECT scope_id, 'r7', 'preferred', 'for', NULL, NULL FROM d WHERE source = 'src1'""",
    ),
    "voice_scores": (
        voice_scores,
        TOKENS
        + r""",
f AS (SELECT doc_id, 5 AS penalty FROM s WHERE w = 'the' AND w2 = 'and' AND regexp_full_match(g2, '\s+')
  UNION ALL SELECT doc_id, 1 FROM s WHERE w = 'of'
  UNION ALL SELECT doc_id, 1 FROM s JOIN documents USING (doc_id) WHERE w = 'ing' AND source = 'src0')
SELECT d.doc_id, greatest(100 - coalesce(sum(penalty), 0), 0)::BIGINT AS score, coalesce(sum(penalty), 0)::BIGINT AS penalty, count(penalty) AS issues FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id""",
    ),
    "stream_entries": (stream_entries, ENTRIES + " SELECT * FROM v"),
    "stream_search": (
        stream_search,
        ENTRIES
        + """ SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY event_id DESC) AS place, count(*) OVER (PARTITION BY stream) AS total FROM v WHERE contains(event_type, 'c'))
WHERE place BETWEEN 6 AND 10""",
    ),
    "run_standing": (
        run_standing,
        """
WITH l AS (SELECT l_orderkey, l_returnflag AS locale, count(*) AS units, count(*) FILTER (l_quantity < 40) AS produced FROM lineitem GROUP BY ALL),
r AS (SELECT l_orderkey, count(*) FILTER (produced < units) AS short FROM l GROUP BY ALL)
SELECT CAST(l_orderkey AS VARCHAR) AS run_id, 1 AS passes, short AS failing_checks, 2 AS materialized, CASE WHEN l_orderkey % 2 = 1 AND short > 0 THEN 'parked' ELSE 'converged' END AS run_state, true AS done, locale,
  CASE WHEN l_orderkey % 2 = 1 AND produced < units THEN 'parked' ELSE 'shippable' END AS state, units, produced, produced AS via_memory, 0 AS via_ai
FROM l JOIN r USING (l_orderkey)""",
    ),
    "converged_locales": (
        converged_locales,
        """
SELECT c_nationkey AS locale, count(*) AS units, count(*) FILTER (c_custkey % 7 <> 0) AS produced, CASE WHEN count(*) = count(*) FILTER (c_custkey % 7 <> 0) THEN 'shippable' ELSE 'parked' END AS state, 5 AS passes
FROM customer GROUP BY 1""",
    ),
    "script_sections": (
        script_sections,
        "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents) SELECT doc_id, CAST(place AS INT) AS place, CAST(length(line) AS INT) AS chars FROM l WHERE contains(line, ' ')",
    ),
    "collected_longest": (
        collected_longest,
        "SELECT lang, arg_min(doc_id, (-length(text), doc_id)) AS doc_id, max(length(text)) AS chars, count(*) AS n FROM documents GROUP BY lang",
    ),
    "overlaid_targets": (
        overlaid_targets,
        """
SELECT p_brand AS doc_id, p_partkey AS seq,
  CASE WHEN (p_brand <> 'Brand#11' OR p_partkey % 7 <> 0) AND (p_partkey % 5 < 4 OR p_brand <> 'Brand#11') THEN upper(p_name) END AS target_text,
  CASE WHEN p_brand = 'Brand#11' AND p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 < 3 THEN 'key' WHEN p_partkey % 5 < 4 THEN 'address' WHEN p_brand <> 'Brand#11' THEN 'place' END AS paired_by
FROM part""",
    ),
    "promoted_memory": (
        promoted_memory,
        """
SELECT DISTINCT p_name AS source_text, upper(p_name) AS target_text, false AS was_there FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 3 <> 0 AND NOT contains(p_name, 'red')
UNION ALL SELECT DISTINCT p_name, upper(p_name), true FROM part WHERE contains(p_name, 'bolt')""",
    ),
    "masked_terms": (
        masked_terms,
        """
SELECT p_partkey, replace(replace(replace(p_name, 'old ring', '[[DNT_0]]'), 'widget', '[[DNT_1]]'), 'old', '[[DNT_2]]') AS masked, p_name AS restored FROM part""",
    ),
    "score_ranges": (
        score_ranges,
        r"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_split_to_array(lower(coalesce(text, '')), '[ \n\t]+') AS w FROM documents),
p AS (SELECT lang, CASE WHEN regexp_matches(t, '\S') THEN CAST(regexp_matches(t, '\A\s') AS INT) + CAST(regexp_matches(regexp_replace(t, '\r?\n\z', ''), '\s\z') AS INT) + CAST(contains(t, '  ') AS INT)
  + CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1] AND regexp_matches(w[i], '[\pL\pN]'))) > 0 AS INT) + CAST(regexp_matches(t, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]') AS INT) ELSE 5 END
  + CASE WHEN length(t) > 500 THEN 5 ELSE 0 END + CAST(len(regexp_extract_all(t, '[^\s]+')) > 100 AS INT) AS penalty FROM t),
s AS (SELECT lang, greatest(100 - penalty, 0) AS s FROM p)
SELECT lang, count(*) AS n, sum(s) / count(*) AS mean, min(s)::BIGINT AS lowest, max(s)::BIGINT AS highest, quantile_cont(s, 0.5)::DOUBLE AS median, count(*) FILTER (s <= 25) AS to_25, count(*) FILTER (s > 25 AND s <= 50) AS to_50,
  count(*) FILTER (s > 50 AND s <= 75) AS to_75, count(*) FILTER (s > 75) AS to_100 FROM s GROUP BY lang""",
    ),
}

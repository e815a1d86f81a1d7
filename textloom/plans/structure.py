"""Queries over structure: trees and tables of event streams, inline runs under edits, placeholders of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import edits, runs
from ..functions.identity import content_hash
from ..operators import checks, search, srx, tree
from ..schema import table
from ..sources import nested
from . import tools

TREE = ("role", "depth", "parent_seq", "ordered", "header", "level")


def page_tree(spark: SparkSession, d: str) -> DataFrame:
    """The content tree of each web page."""
    events = tree.page_events(table(spark, d, "pages"), "page_id", "html")
    return tree.project_stream(events).select(F.col("doc_id").alias("page_id"), "seq", *TREE)


def order_events(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a table: a caption, and a row of two cells per line. Orders of every third key have cells without rows."""
    # Orders and lines are shuffled together, by the document that they become.
    lines = table(spark, d, "lineitem").withColumn("doc_id", F.col("l_orderkey"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus", F.lit(True).alias("whole"))
    columns = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_returnflag", "l_linestatus"]
    both = lines.select("doc_id", "l_orderkey", *columns, F.lit(False).alias("whole")).unionByName(orders, allowMissingColumns=True)
    upto = Window.partitionBy("doc_id").orderBy("whole", *columns).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("n", F.sum(F.when(F.col("whole"), 0).otherwise(1)).over(upto).cast("long"))
    kind_map = "map<string,string>"

    def event(seq: Column, kind: str, type_: str, text: Column, **properties: Column) -> Column:
        cells = [x for name, value in properties.items() for x in (F.lit(name), value)]
        return F.struct(
            seq.cast("long").alias("seq"),
            F.lit(kind).alias("kind"),
            F.lit(type_).alias("type"),
            text.cast("string").alias("text"),
            F.create_map(*cells).cast(kind_map).alias("properties"),
        )

    none = F.lit(None).cast("string")
    base, flat, odd = F.col("n") * 10, F.col("l_orderkey") % 3 == 0, F.col("n") % 2 == 1
    hint = F.when(flat, F.col("l_returnflag"))
    merged = F.when((F.col("l_linestatus") == "F") & ~odd, "continue")
    cells = [
        event(base + 1, "block", "table-header", F.col("l_partkey"), row=hint, vmerge=F.when((F.col("n") > 1), "continue")),
        event(base + 2, "block", "table-cell", F.col("l_partkey"), row=hint, vmerge=merged),
        event(base + 3, "block", "table-cell", F.col("l_suppkey"), row=hint),
    ]
    rows = [
        event(base, "group_start", "table-row", none, header=F.when(F.col("l_returnflag") == "R", "true")),
        event(base + 9, "group_end", "table-row", none),
    ]
    of_line = F.array(*cells, *[F.when(~flat, r) for r in rows])
    around = F.array(
        event(F.lit(1), "group_start", "table", none),
        event(F.lit(2), "block", "caption", F.col("o_orderstatus")),
        event(F.lit(9_999), "group_end", "table", none),
    )
    events = both.select("doc_id", F.explode(F.when(F.col("whole"), around).otherwise(of_line)).alias("e")).filter("e is not null")
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (("node_id", "string"), ("role", "string"), ("level", "int"), ("col_span", "int"), ("row_span", "int"))]
    return events.select("doc_id", "e.*", *empty)


def order_tree(spark: SparkSession, d: str) -> DataFrame:
    nodes = tree.project_stream(order_events(spark, d))
    return nodes.select("doc_id", "seq", "part", "role", "depth", "parent_seq", "parent_part", "synthetic")


def order_tables(spark: SparkSession, d: str) -> DataFrame:
    return tree.assemble_tables(order_events(spark, d)).select("doc_id", "table_seq", "row", "cell", "row_header", "header", "text")


def marked_runs(spark: SparkSession, d: str) -> DataFrame:
    """Part names with a bold (or, for every third key, undeletable) size and a break before the brand."""

    def run(kind: str, **fields: Column) -> Column:
        values = {"kind": F.lit(kind), **fields}
        names = ("kind", "text", "id", "type", "subtype", "data", "equiv", "disp")
        cells = [values.get(n, F.lit(None)).cast("string").alias(n) for n in names]
        return F.struct(*cells, F.lit(None).cast("map<string,string>").alias("forms"))

    bold = F.when(F.col("p_partkey") % 3 == 0, "var:size").otherwise("fmt:bold")
    source = F.array(
        run("text", text=F.concat("p_name", F.lit(" "))),
        run("pcOpen", id=F.lit("1"), type=bold),
        run("text", text=F.concat(F.lit("size "), F.col("p_size"))),
        run("pcClose", id=F.lit("1"), type=bold),
        run("text", text=F.lit(" by")),
        run("ph", id=F.lit("2"), type=F.lit("struct:break")),
        run("text", text=F.col("p_brand")),
    )
    return table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_brand", source.alias("runs"))


def edited_runs(spark: SparkSession, d: str) -> DataFrame:
    """One edit of each part's text, from a place to another that its key and size decide."""
    parts = marked_runs(spark, d)
    start = (F.col("p_partkey") * 7 % 23).cast("int")
    end = F.least(start + (F.col("p_size") % 19).cast("int"), F.length(runs.plain_text(F.col("runs"))))
    edit = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit("new").alias("replacement")))
    changed = edits.apply_edits(F.col("runs"), edit)
    return parts.select("p_partkey", edits.placeholder_text(changed).alias("shown"))


def replaced_in_runs(spark: SparkSession, d: str) -> DataFrame:
    """`by` and what follows a code replaced across it: the break stays."""
    parts = marked_runs(spark, d)
    changed = edits.replace_in_runs(F.col("runs"), "byBrand", "of brand ")
    return parts.select("p_partkey", edits.placeholder_text(changed).alias("shown"), F.size(changed).cast("long").alias("n_runs"))


def applied_run_edits(spark: SparkSession, d: str) -> DataFrame:
    """Rewritten texts with codes: one in four drops a code, one has an old hash, one is unchanged."""
    parts = marked_runs(spark, d).withColumn("p_partkey", F.col("p_partkey").cast("string")).withColumnsRenamed({"p_partkey": "block_id", "runs": "source"})
    plain = runs.plain_text(F.col("source"))
    kind = F.col("block_id").cast("long") % 4
    new = (
        F.when(kind == 0, F.concat(F.lit('about <x id="1"/>'), F.col("p_size"), F.lit('<x id="/1"/><x id="2/"/>'), F.col("p_brand")))
        .when(kind == 1, F.concat(F.lit('about <x id="1"/>'), F.col("p_size"), F.lit(" "), F.col("p_brand")))
        .when(kind == 2, edits.placeholder_text(F.col("source")))
        .otherwise(F.lit("anything"))
    )
    changes = parts.select("block_id", F.when(kind == 3, F.lit("old")).otherwise(content_hash(plain)).alias("expected_hash"), new.alias("new_text"))
    done = tools.apply_run_edits(parts.select("block_id", "source"), changes)
    return done.select(F.col("block_id").cast("long").alias("p_partkey"), "edit_state", edits.placeholder_text(F.col("source")).alias("shown"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages and translations of eight kinds, by part."""
    name = F.col("p_name")

    def pair(source: list, target: list) -> Column:
        def joined(parts: list) -> Column:
            return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

        return F.struct(joined(source).alias("source"), joined(target).alias("target"))

    pairs = [
        pair(["{count, plural, one {# ", name, "} other {# ", name, "s}}"], ["{count, plural, one {# x} few {# y} many {# z} other {# ", name, "}}"]),
        pair(["{count, plural, one {# ", name, "} other {#}}"], ["{count, plural, other {", name, "}}"]),
        pair(["{g, select, male {{n, plural, one {# of {size}} other {#}}} other {", name, "}}"], ["{g, select, other {{n, plural, other {# ", name, "}}}}"]),
        pair(["{part} after {part}: {n, plural, other {#}} ", name], ["{part}: {n, plural, other {#}} ", name]),
        pair(["{count, plural, other {# ", name, "}}"], ["{antall, plural, other {# ", name, "}}"]),
        pair(["Write '{'part'}' {n, plural, other {# %s}} ", name], ["Skriv '{'del'}' {n, plural, other {#}} ", name]),
        pair(["Pay {total} to %1$s, ", name], ["Betal {total}, ", name, " {{ekstra}}"]),
        pair(["{count, plural, one {a} ", name], ["{count} ", name]),
    ]
    chosen = F.element_at(F.array(*pairs), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", chosen.alias("m")).select("p_partkey", "m.*")


def message_placeholders(spark: SparkSession, d: str) -> DataFrame:
    return checks.placeholder_check(messages(spark, d), ["p_partkey"], "source", "target")


def srx_segments(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each document by its language's rules; a placeholder in the middle of the text hides nothing from them."""
    body, half = F.coalesce("text", F.lit("")), F.floor(F.length("text") / 2).cast("int")

    def run(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    halves = F.array(run("text", F.substring(body, F.lit(1), half)), run("ph", F.lit(None).cast("string")), run("text", F.substring(body, half + 1, F.length(body))))
    docs = table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("text").isNotNull(), halves).alias("runs"))
    found = srx.segment_runs(docs, "runs", "lang", srx.parse_srx(srx.DEFAULT_SRX))
    joined = F.array_join(F.transform("segments", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["text"])), "|")
    return found.select("doc_id", F.size("segments").cast("long").alias("segments"), F.sha2(joined, 256).alias("digest"))


ORDER_CELLS = """
WITH l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_returnflag, l_linestatus) AS n, l_orderkey % 3 = 0 AS flat, * FROM lineitem),
c AS (
  SELECT doc_id, n, flat, l_returnflag AS flag, n * 10 + 1 AS seq, 'table-header' AS role, CAST(l_partkey AS VARCHAR) AS text FROM l WHERE n = 1
  UNION ALL SELECT doc_id, n, flat, l_returnflag, n * 10 + 2, 'table-cell', CAST(l_partkey AS VARCHAR) FROM l WHERE NOT (l_linestatus = 'F' AND n % 2 = 0)
  UNION ALL SELECT doc_id, n, flat, l_returnflag, n * 10 + 3, 'table-cell', CAST(l_suppkey AS VARCHAR) FROM l
)"""

def nested_pages(spark: SparkSession, d: str) -> DataFrame:
    """Web pages as HTML in JSON, each e between their tags a 3, put back and read again."""
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.lit("json").alias("format"), F.to_json(F.struct("url", F.col("html").alias("body"))).alias("text"))
    layers = nested.extract(pages, [("json", "/body", "html")])
    done = nested.fold(layers, nested.transform(layers, lambda c: F.replace(c, F.lit("e"), F.lit("3")), ["html"]))
    body = F.get_json_object("text", "$.body")
    return done.select(F.col("doc_id").cast("long").alias("page_id"), F.get_json_object("text", "$.url").alias("url"), F.sha2(body, 256).alias("body_hash"), F.length(body).cast("long").alias("chars"))


def _customer_texts(spark: SparkSession, d: str) -> DataFrame:
    """Customers' names as sources and their segments as German targets, in files of their nations."""
    targets = F.create_map(F.lit("de"), F.col("c_mktsegment"), F.lit(""), F.lit("hidden"))
    blocks = table(spark, d, "customer").select(F.col("c_custkey").alias("block_id"), F.col("c_nationkey").alias("file"), F.col("c_name").alias("source_text"), targets.alias("targets"))
    return search.block_texts(blocks, keep=["block_id", "file"])


def grep_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts that have neither a 7 nor the word automobile."""
    return search.grep(_customer_texts(spark, d), "text", ["7", "automobile"], invert=True, ignore_case=True)


def grep_found(spark: SparkSession, d: str) -> DataFrame:
    return search.grep_matches(_customer_texts(spark, d), "text", ["[1-9]+", "build|MACH"], ignore_case=True)


def grep_files_counted(spark: SparkSession, d: str) -> DataFrame:
    return search.grep_counts(_customer_texts(spark, d), "file", "text", ["#", "BUILDING"], fixed=True)


def sed_edited(spark: SparkSession, d: str) -> DataFrame:
    script = [r"s/customer#\(?0*([1-9]\d*)/No. \1 (&)/i", "s|0|o|", "s/[1-3]/<&>/g", r"s,\$,\,,"]
    return table(spark, d, "customer").select("c_custkey", search.sed(F.col("c_name"), script).alias("edited"))


def part_names(spark: SparkSession, d: str) -> DataFrame:
    """Parts as blocks of their brands, named by type and size."""
    parts = table(spark, d, "part")
    path = search.structural_path(F.col("p_type"), F.lit("  "), F.concat(F.lit(" a/b  "), F.col("p_size") % 5))
    return search.block_names(parts, "p_brand", "p_partkey", path).select("p_partkey", "name")


SRX_SEGMENTS = r"""
WITH c AS (SELECT doc_id, lang, text, unnest(range(1, length(text))) AS p FROM documents),
x AS (SELECT doc_id, lang, p, substr(text, greatest(p - 23, 1)::BIGINT, least(p, 24)::BIGINT) AS b, substr(text, p + 1, 60) AS a FROM c
  WHERE regexp_matches(substr(text, p, 1), '[.!?…"'')\]}”’»\n。！？]')),
y AS (SELECT doc_id, p, CASE
  WHEN lang = 'de' AND regexp_matches(b, '\b(?:z\.\s?B|bzw|usw|ca|Nr|Str|\d{1,2})\.\z') AND regexp_matches(a, '\A\s') THEN false
  WHEN lang = 'fr' AND regexp_matches(b, '\b(?:M|Mme|Mlle|p\.ex)\.\z') AND regexp_matches(a, '\A\s') THEN false
  WHEN lang = 'es' AND regexp_matches(b, '\b(?:Sr|Sra|Ud|p\.ej)\.\z') AND regexp_matches(a, '\A\s') THEN false
  WHEN lang = 'en' AND regexp_matches(b, '\b(?:Mr|Mrs|Ms|vs|e\.g|i\.e)\.\z') AND regexp_matches(a, '\A\s') THEN false
  WHEN regexp_matches(b, '(?:\A|[^\pL\d_])(?:Dr|Prof|St|etc|\p{Lu})\.\z') AND regexp_matches(a, '\A[ \t]') THEN false
  WHEN regexp_matches(b, '(?:\.\.\.|…)\z') AND regexp_matches(a, '\A\s+\p{Ll}') THEN false
  WHEN regexp_matches(b, '\n\z') THEN true
  WHEN regexp_matches(b, '[.!?…][\p{Pe}\p{Pf}"'']?\z') AND regexp_matches(a, '\A\s') THEN true
  ELSE regexp_matches(b, '[。！？]\z') END AS breaks FROM x),
e AS (SELECT doc_id, p FROM y WHERE breaks UNION ALL SELECT doc_id, 0 FROM documents WHERE length(text) > 0 UNION ALL SELECT doc_id, length(text) FROM documents WHERE length(text) > 0),
s AS (SELECT doc_id, p AS start, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS stop FROM e),
t AS (SELECT doc_id, start, substr(text, start + 1, stop - start) AS part FROM s JOIN documents USING (doc_id) WHERE stop > start),
u AS (SELECT doc_id, start + length(part) - length(regexp_replace(part, '\A\s+', '')) AS start, regexp_replace(regexp_replace(part, '\A\s+', ''), '\s+\z', '') AS text FROM t)
SELECT d.doc_id, count(u.text) AS segments, sha256(coalesce(string_agg(u.start || ':' || u.text, '|' ORDER BY u.start), '')) AS digest
FROM documents d LEFT JOIN u ON u.doc_id = d.doc_id AND u.text <> '' GROUP BY d.doc_id"""

CUSTOMER_TEXTS = """
WITH t AS (SELECT c_custkey AS block_id, c_nationkey AS file, '' AS locale, c_name AS text FROM customer
  UNION ALL SELECT c_custkey, c_nationkey, 'de', c_mktsegment FROM customer) """

QUERIES = {
    "srx_segments": (srx_segments, SRX_SEGMENTS),
    "grep_texts": (grep_texts, CUSTOMER_TEXTS + "SELECT * FROM t WHERE NOT regexp_matches(text, '(?i)7|automobile')"),
    "grep_found": (
        grep_found,
        CUSTOMER_TEXTS
        + """SELECT *, unnest(range(len(regexp_extract_all(text, '[1-9]+')))) AS match, 0 AS pattern, unnest(regexp_extract_all(text, '[1-9]+')) AS found FROM t
UNION ALL SELECT *, unnest(range(len(regexp_extract_all(text, '(?i)build|MACH')))), 1, unnest(regexp_extract_all(text, '(?i)build|MACH')) FROM t""",
    ),
    "grep_files_counted": (grep_files_counted, CUSTOMER_TEXTS + "SELECT file, count(*) FILTER (contains(text, '#') OR contains(text, 'BUILDING')) AS matching FROM t GROUP BY 1"),
    "sed_edited": (
        sed_edited,
        r"""SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '(?i)customer#\(?0*([1-9]\d*)', 'No. \1 (\0)'), '0', 'o'), '[1-3]', '<\0>', 'g') AS edited FROM customer""",
    ),
    "part_names": (
        part_names,
        """
WITH p AS (SELECT p_partkey, p_brand, p_type || '/a-b ' || p_size % 5 AS path FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, path ORDER BY p_partkey) AS k FROM p)
SELECT p_partkey, path || CASE WHEN k > 1 THEN '#' || k ELSE '' END AS name FROM n""",
    ),
    "nested_pages": (
        nested_pages,
        """
WITH p AS (SELECT page_id, url, html, string_split_regex(html, '<[^>]*>') AS said, regexp_extract_all(html, '<[^>]*>') AS tags FROM pages),
u AS (SELECT page_id, url, array_to_string(list_transform(range(1, len(said) + 1), lambda i: replace(said[i], 'e', '3') || coalesce(tags[i], '')), '') AS body FROM p)
SELECT page_id, url, sha256(body) AS body_hash, length(body) AS chars FROM u""",
    ),
    "page_tree": (
        page_tree,
        rf"""
WITH t AS (SELECT page_id, regexp_extract_all(regexp_replace(coalesce(html, ''), '{tree.HIDDEN}', ' ', 'g'), '</?[A-Za-z][A-Za-z0-9]*[^>]*>') AS tags FROM pages),
a AS (SELECT page_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS k FROM t),
b AS (SELECT *, lower(regexp_extract(tag, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS name, starts_with(tag, '</') AS closing FROM a),
known(name, type, leaf) AS (VALUES {", ".join(f"('{k}', '{v}', {leaf})" for names, leaf in ((tree.GROUPS, "false"), (tree.LEAVES, "true")) for k, v in names.items())}),
e AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS seq, name, type, leaf, closing FROM b JOIN known USING (name)),
s AS (SELECT *, sum(CASE WHEN leaf THEN 0 WHEN closing THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY seq) AS total FROM e),
d AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY page_id ORDER BY seq)) AS depth FROM s),
n AS (SELECT *, CASE WHEN leaf THEN depth ELSE depth - 1 END AS above FROM d WHERE NOT closing)
SELECT n.page_id, n.seq, CASE WHEN n.type IN ('list', 'ordered-list', 'unordered-list') THEN 'list' ELSE n.type END AS role, CAST(n.above + 1 AS BIGINT) AS depth,
  CASE WHEN n.above > 0 THEN o.seq END AS parent_seq, n.type = 'ordered-list' AS ordered, n.type = 'table-header' AS header, TRY_CAST(nullif(regexp_extract(n.name, '^h([1-6])$', 1), '') AS INT) AS level
FROM n ASOF LEFT JOIN (SELECT * FROM n WHERE NOT leaf) o ON n.page_id = o.page_id AND n.above = o.depth AND n.seq > o.seq""",
    ),
    "order_tree": (
        order_tree,
        ORDER_CELLS
        + """,
f AS (SELECT *, row_number() OVER w AS k, lag(flag) OVER w AS before FROM c WHERE flat WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
g AS (SELECT *, k = 1 OR flag <> before AS starts FROM f),
h AS (SELECT *, max(CASE WHEN starts THEN seq END) OVER (PARTITION BY doc_id ORDER BY seq) AS row_seq, min(seq) OVER (PARTITION BY doc_id) AS table_seq FROM g)
SELECT doc_id, seq, 2 AS part, role, 4 AS depth, row_seq AS parent_seq, 1 AS parent_part, false AS synthetic FROM h
UNION ALL SELECT doc_id, seq, 1, 'table-row', 3, table_seq, 0, true FROM h WHERE starts
UNION ALL SELECT doc_id, seq, 0, 'table', 2, 1, 2, true FROM h WHERE k = 1
UNION ALL SELECT doc_id, seq, 2, role, 3, n * 10, 2, false FROM c WHERE NOT flat
UNION ALL SELECT doc_id, n * 10, 2, 'table-row', 2, 1, 2, false FROM l WHERE NOT flat
UNION ALL SELECT o_orderkey, 1, 2, 'table', 1, NULL, NULL, false FROM orders
UNION ALL SELECT o_orderkey, 2, 2, 'caption', 2, 1, 2, false FROM orders""",
    ),
    "order_tables": (
        order_tables,
        ORDER_CELLS
        + """,
r AS (SELECT doc_id, n, dense_rank() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS row, l_returnflag = 'R' OR n = 1 AS row_header FROM l WHERE NOT flat)
SELECT c.doc_id, 1 AS table_seq, r.row, row_number() OVER (PARTITION BY c.doc_id, c.n ORDER BY c.seq) - 1 AS cell, row_header, role = 'table-header' AS header, text
FROM c JOIN r ON r.doc_id = c.doc_id AND r.n = c.n
UNION ALL SELECT doc_id, 1, NULL, NULL, false, role = 'table-header', text FROM c WHERE flat
UNION ALL SELECT o_orderkey, 1, NULL, NULL, false, false, o_orderstatus FROM orders""",
    ),
    "edited_runs": (
        edited_runs,
        """
WITH p AS (SELECT p_partkey, p_name || ' size ' || p_size || ' by' || p_brand AS t, length(p_name) + 1 AS o, length(p_name) + 6 + length(p_size::VARCHAR) AS c, p_partkey * 7 % 23 AS s, p_size % 19 AS n,
  p_partkey % 3 <> 0 AS may FROM part),
e AS (SELECT *, c + 3 AS b, least(s + n, length(t)) AS e FROM p),
m AS (SELECT *, substr(t, 1, s) || 'new' || substr(t, e + 1) AS body, 3 - (e - s) AS d FROM e),
x AS (SELECT *, CASE WHEN o >= e THEN o + d WHEN o <= s THEN o ELSE s + 3 END AS o2, CASE WHEN c >= e THEN c + d WHEN c <= s THEN c ELSE s END AS c2, CASE WHEN b >= e THEN b + d WHEN b <= s THEN b ELSE s END AS b2 FROM m),
y AS (SELECT p_partkey, body, o2, CASE WHEN c2 > o2 THEN c2 ELSE o2 END AS c2, b2, c2 > o2 OR NOT may AS pair FROM x),
z AS (SELECT *, [{p: b2, k: 3, w: '<x id="2/"/>'}] || CASE WHEN pair THEN [{p: o2, k: 1, w: '<x id="1"/>'}, {p: c2, k: 2, w: '<x id="/1"/>'}] ELSE [] END AS marks FROM y),
u AS (SELECT p_partkey, body, list_sort(list_transform(marks, lambda v: {p: v.p, k: v.k, w: v.w})) AS marks FROM z)
SELECT p_partkey, array_to_string(list_transform(range(1, len(marks) + 2), lambda i:
  substr(body, 1 + CASE WHEN i = 1 THEN 0 ELSE marks[i - 1].p END, CASE WHEN i > len(marks) THEN 100000 ELSE marks[i].p - CASE WHEN i = 1 THEN 0 ELSE marks[i - 1].p END END)
  || coalesce(marks[i].w, '')), '') AS shown FROM u""",
    ),
    "replaced_in_runs": (
        replaced_in_runs,
        """
SELECT p_partkey, p_name || ' <x id="1"/>size ' || p_size || '<x id="/1"/> ' || CASE WHEN starts_with(p_brand, 'Brand') THEN '<x id="2/"/>of brand ' || substr(p_brand, 6) ELSE 'by<x id="2/"/>' || p_brand END AS shown, 7 AS n_runs FROM part""",
    ),
    "applied_run_edits": (
        applied_run_edits,
        """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'applied' WHEN 1 THEN 'guard_failed' WHEN 2 THEN 'skipped' ELSE 'stale' END AS edit_state,
  CASE WHEN p_partkey % 4 = 0 THEN 'about <x id="1"/>' || p_size || '<x id="/1"/><x id="2/"/>' || p_brand ELSE p_name || ' <x id="1"/>size ' || p_size || '<x id="/1"/> by<x id="2/"/>' || p_brand END AS shown FROM part""",
    ),
    "message_placeholders": (
        message_placeholders,
        """
WITH found(k, token, category, severity, in_source, in_target) AS (VALUES (1, '#', 'missing', 'critical', NULL, NULL), (2, '{size}', 'missing', 'critical', NULL, NULL), (3, '{part}', 'missing', 'critical', 2, 1),
  (4, '{count, plural}', 'missing', 'critical', 1, 0), (4, '{antall, plural}', 'extra', 'major', NULL, NULL), (5, '%s', 'missing', 'critical', NULL, NULL), (6, '%1$s', 'missing', 'critical', 1, 0),
  (6, '{{ekstra}}', 'extra', 'major', 0, 1), (7, '{a}', 'missing', 'critical', 1, 0), (7, '{count}', 'extra', 'major', 0, 1))
SELECT p_partkey, token, category, severity, in_source, in_target FROM part JOIN found ON k = p_partkey % 8""",
    ),
}

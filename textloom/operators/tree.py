"""Trees of streamed content: nesting, parents and tables, from events in document order.

Events: doc_id, seq, kind (layer_start, layer_end, group_start, group_end, block, data, media), node_id, type (of a group or
block), role (of a block; falls back to its type), level, col_span, row_span, text, properties (map).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..session import checkpoint
from .scans import PART, carried, joined, running_depth, running_sums

#: Roles of lists and of table parts, and the property of a cell that only goes on from above.
LISTS = ("list", "ordered-list", "unordered-list")
CELLS = ("table-cell", "table-header")
TABLE, ROW, MERGED, FLAT_ROW = "table", "table-row", "vmerge", "row"

NODE = ("doc_id", "seq", "part", "node_id", "role", "depth", "parent_seq", "parent_part", "ordered", "header", "level", "col_span", "row_span", "text", "synthetic")


def nested(events: DataFrame, opens: Column, closes: Column, keep: Column, part: int = PART) -> DataFrame:
    """Adds `depth` (after the event) and `parent`, the last opening event (struct seq, type, kind) that is still open around it.

    An opening or other event at depth d stands in the last group opened at the depth above it, so openers are
    carried forward along each depth. Only events of `keep` and openers are returned.
    """
    deep = running_depth(events, ["doc_id"], ["seq"], F.when(opens, 1).when(closes, -1), "depth", part)
    asked = checkpoint(deep.filter(keep | opens))  # read twice by the next scan, and so on: else plans would double at each
    at = F.when(opens, F.col("depth") - 1).otherwise(F.col("depth"))
    opener = F.struct("seq", "type", "kind")
    asks, gives = F.struct(at.alias("on"), F.lit(False).alias("gives")), F.struct(F.col("depth").alias("on"), F.lit(True).alias("gives"))
    both = asked.withColumn("_place", F.explode(F.when(opens, F.array(gives, asks)).otherwise(F.array(asks))))
    both = both.withColumns({"_on": F.col("_place.on"), "_gives": F.col("_place.gives")}).drop("_place")
    # An opener gives itself to what follows one level down, and asks one level up.
    found = carried(both, ["doc_id", "_on"], ["seq", "_gives"], F.when(F.col("_gives"), opener), "parent", part)
    # At depth 0 nothing is open, whatever was before.
    return found.filter(~F.col("_gives")).withColumn("parent", F.when(F.col("_on") > 0, F.col("parent"))).drop("_on", "_gives")


def _by_length(events: DataFrame, part: int) -> tuple[DataFrame, DataFrame | None, bool]:
    """Events of documents within one part, those of longer documents (None: there are none), and whether any layer starts."""
    place = F.floor(F.col("seq") / part)
    spans = events.groupBy("doc_id").agg((F.min(place) != F.max(place)).alias("_long"), F.max(F.col("kind") == "layer_start").alias("_layer"))
    long, layers = spans.agg(F.max(F.coalesce("_long", F.lit(False))), F.max("_layer")).first()
    if not long:
        return events, None, bool(layers)
    ids = checkpoint(spans.filter("_long").select("doc_id"))
    return events.join(ids, "doc_id", "left_anti"), events.join(ids, "doc_id", "left_semi"), bool(layers)


def _running(*keys: str, last: int = 0) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, last)


def _depth_within(events: DataFrame, opens: Column, closes: Column, name: str) -> DataFrame:
    """`running_depth` of documents that are whole in a task."""
    events = events.withColumn("_total", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(_running("doc_id")))
    return events.withColumn(name, F.col("_total") - F.least(F.min("_total").over(_running("doc_id")), F.lit(0))).drop("_total")


def _parent_within(events: DataFrame, opens: Column, depth: str, name: str) -> DataFrame:
    """The last opener that is still open, as `nested` finds it, in documents that are whole in a task."""
    at = F.when(opens, F.col(depth) - 1).otherwise(F.col(depth))
    asks, gives = F.struct(at.alias("on"), F.lit(False).alias("gives")), F.struct(F.col(depth).alias("on"), F.lit(True).alias("gives"))
    both = events.withColumn("_place", F.explode(F.when(opens, F.array(gives, asks)).otherwise(F.array(asks))))
    both = both.withColumns({"_on": F.col("_place.on"), "_gives": F.col("_place.gives")}).drop("_place")
    before = Window.partitionBy("doc_id", "_on").orderBy("seq", "_gives").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn(name, F.last(F.when(F.col("_gives"), F.struct("seq", "type", "kind")), ignorenulls=True).over(before))
    return found.filter(~F.col("_gives")).withColumn(name, F.when(F.col("_on") > 0, F.col(name))).drop("_on", "_gives")


def _shown() -> Column:
    """Blocks that aren't only the continuation of a merge from above."""
    return (F.col("kind") == "block") & ~(F.coalesce(F.try_element_at("properties", F.lit(MERGED)), F.lit("")) == "continue")


def _role() -> Column:
    return F.when(F.coalesce("role", F.lit("")) != "", F.col("role")).otherwise(F.col("type"))


def _node(place: Column, **more: Column) -> list[Column]:
    group = F.col("kind") == "group_start"
    values = {
        "part": place,
        "role": F.col("_role"),
        "depth": F.when(group, F.col("depth")).otherwise(F.col("depth") + 1),
        "parent_seq": F.col("parent.seq"),
        "parent_part": F.when(F.col("parent").isNotNull(), 2),
        "ordered": F.coalesce(group & (F.col("type") == "ordered-list"), F.lit(False)),
        "header": F.coalesce(~group & (F.col("_role") == "table-header"), F.lit(False)),
        "synthetic": F.lit(False),
        **more,
    }
    return [values[c].alias(c) if c in values else F.col(c) for c in NODE]


def _project_within(events: DataFrame, layers: bool) -> DataFrame:
    """`project_stream` of documents that are whole in a task: all windows lie within documents, so events are shuffled once."""
    opens, closes = F.col("kind") == "group_start", F.col("kind") == "group_end"
    schema = events.schema
    rows = events.withColumns({"_shown": F.coalesce(_shown(), F.lit(False)), "_hint": F.try_element_at("properties", F.lit(FLAT_ROW))})
    rows = _depth_within(rows, opens, closes, "depth")
    started, ended = F.col("kind") == "layer_start", F.col("kind") == "layer_end"
    if layers:
        rows = _depth_within(rows, opens | started, closes | ended, "_around")
    rows = rows.withColumn("_stops", F.sum(F.when(opens | closes | ended, 1).otherwise(0)).over(_running("doc_id")))
    rows = rows.filter(F.col("_shown") | opens | (started if layers else F.lit(False)))
    rows = _parent_within(rows, opens, "depth", "parent")
    in_row = F.coalesce(F.col("parent.type") == ROW, F.lit(False))
    if layers:  # a layer is no node, but it is what its blocks stand in
        rows = _parent_within(rows, opens | started, "_around", "_frame").filter(~started)
        in_row = F.coalesce((F.col("_frame.type") == ROW) & (F.col("_frame.kind") == "group_start"), F.lit(False))
    rows = rows.withColumn("_role", F.when(F.col("kind") == "block", _role()).when(F.col("type").isin(*LISTS), "list").otherwise(F.col("type")))
    rows = rows.withColumn("_bare", F.coalesce((F.col("kind") == "block") & F.col("_role").isin(*CELLS) & ~in_row, F.lit(False)))
    # Bare cells belong together until something else is shown or closed between them.
    rows = rows.withColumn("_run", F.col("_stops") + F.sum(F.when((F.col("kind") == "block") & ~F.col("_bare"), 1).otherwise(0)).over(_running("doc_id")))
    bare, upto, before = F.col("_bare"), _running("doc_id", "_run"), _running("doc_id", "_run", last=-1)
    rows = rows.withColumns({
        "_last": F.last(F.when(bare, F.col("_hint")), ignorenulls=True).over(before),
        "_nth": F.sum(F.when(bare, 1).otherwise(0)).over(upto),
        "_table": F.min(F.when(bare, F.col("seq"))).over(upto),
    })
    rows = rows.withColumn("_starts", bare & ((F.col("_nth") == 1) | F.coalesce(F.col("_hint") != F.coalesce("_last", F.lit("")), F.lit(False))))
    rows = rows.withColumn("_row", F.last(F.when(F.col("_starts"), F.col("seq")), ignorenulls=True).over(upto))
    none = {c: F.lit(None).cast(schema[c].dataType).alias(c) for c in ("node_id", "level", "col_span", "row_span", "text")}
    made, depth = {**none, "header": F.lit(False), "synthetic": F.lit(True)}, F.col("depth") + 1
    nodes = F.array(
        F.when(~bare, F.struct(*_node(F.lit(2)))),
        F.when(bare & (F.col("_nth") == 1), F.struct(*_node(F.lit(0), **made, role=F.lit(TABLE), depth=depth))),
        F.when(F.col("_starts"), F.struct(*_node(F.lit(1), **made, role=F.lit(ROW), depth=depth + 1, parent_seq=F.col("_table"), parent_part=F.lit(0)))),
        F.when(bare, F.struct(*_node(F.lit(2), depth=depth + 2, parent_seq=F.col("_row"), parent_part=F.lit(1)))),
    )
    return rows.select(F.explode(nodes).alias("n")).filter("n is not null").select("n.*")


def project_stream(events: DataFrame, part: int = PART) -> DataFrame:
    """A row per node of each document's tree: NODE. The root is none of them: its children have a null parent and depth 1.

    Groups are nodes (lists and tables by their role, others by their type), layers aren't, blocks are leaves. Closing
    events close the innermost open group; at the top they have no effect. A cell that only goes on a merge from
    above is skipped. Cells outside rows stand, as far as nothing comes between them, in a table of their own (part 0 of
    its first cell's place; its rows, one for each value of their row property, are part 1; all other nodes part 2).

    Documents within one part of `part` places go through windows that share one shuffle. Of longer ones nothing but a part's
    totals is gathered, so one of any length is many tasks. Layers must be nested properly. Null seq counts as before all; an empty table gives an empty one.
    """
    short, long, layers = _by_length(events, part)
    found = _project_within(short, layers)
    return found if long is None else found.unionByName(_project_long(long, part))


def _project_long(events: DataFrame, part: int) -> DataFrame:
    """`project_stream` of documents of many parts."""
    opens, closes = F.col("kind") == "group_start", F.col("kind") == "group_end"
    block = _shown()
    events = checkpoint(events)
    shown = nested(events, opens, closes, block, part)
    if events.filter(F.col("kind") == "layer_start").isEmpty():
        nodes, in_row = shown, F.coalesce(F.col("parent.type") == ROW, F.lit(False))
    else:  # a layer is no node, but it is what its blocks stand in
        around = nested(events, opens | (F.col("kind") == "layer_start"), closes | (F.col("kind") == "layer_end"), block, part)
        frame = (F.col("parent.type") == ROW) & (F.col("parent.kind") == "group_start")
        nodes = joined(shown, around.select("doc_id", "seq", frame.alias("_row_frame")), ["doc_id", "seq"], ["_row_frame"], "inner")
        in_row = F.coalesce("_row_frame", F.lit(False))
    nodes = nodes.withColumn("_role", F.when(F.col("kind") == "block", _role()).when(F.col("type").isin(*LISTS), "list").otherwise(F.col("type")))
    nodes = checkpoint(nodes.withColumn("_bare", (F.col("kind") == "block") & F.col("_role").isin(*CELLS) & ~in_row))

    plain = nodes.filter(~F.col("_bare")).select(*_node(F.lit(2)))
    if nodes.filter("_bare").isEmpty():
        return plain
    # Bare cells belong together until something else is shown or closed between them.
    between = F.when((F.col("kind").isin("group_start", "group_end", "layer_end")) | (F.col("kind") == "block") & ~F.col("_bare"), 1)
    marks = nodes.filter("_bare").select("doc_id", "seq", F.lit(True).alias("_bare"))
    stops = events.filter(block | F.col("kind").isin("group_start", "group_end", "layer_end")).select("doc_id", "seq", "kind")
    runs = joined(stops, marks, ["doc_id", "seq"], ["_bare"]).withColumn("_bare", F.coalesce("_bare", F.lit(False)))
    runs = running_sums(runs, ["doc_id"], ["seq"], {"_run": between}, part)
    cells = checkpoint(joined(nodes.filter("_bare"), runs.filter("_bare").select("doc_id", "seq", "_run"), ["doc_id", "seq"], ["_run"], "inner"))
    hint = F.try_element_at("properties", F.lit(FLAT_ROW))
    cells = carried(cells.withColumn("_hint", hint), ["doc_id", "_run"], ["seq"], F.col("_hint"), "_last", part)
    cells = carried(cells, ["doc_id", "_run"], ["seq"], F.col("seq"), "_earlier", part)
    cells = checkpoint(cells)
    starts = F.col("_earlier").isNull() | F.coalesce(F.col("_hint") != F.coalesce("_last", F.lit("")), F.lit(False))
    cells = cells.withColumn("_starts", starts)
    cells = carried(cells, ["doc_id", "_run"], ["seq"], F.when(F.col("_starts"), F.col("seq")), "_row", part)
    cells = cells.withColumn("_row", F.when(F.col("_starts"), F.col("seq")).otherwise(F.col("_row")))
    first = cells.groupBy("doc_id", "_run").agg(F.min("seq").alias("_table"))
    cells = joined(cells, first, ["doc_id", "_run"], ["_table"], "inner")
    none = {c: F.lit(None).cast(events.schema[c].dataType) for c in ("node_id", "level", "col_span", "row_span", "text")}
    made = {**none, "header": F.lit(False), "synthetic": F.lit(True)}
    depth = F.col("depth") + 1
    tables = cells.filter(F.col("_earlier").isNull()).select(*_node(F.lit(0), **made, role=F.lit(TABLE), depth=depth))
    rows = cells.filter("_starts").select(*_node(F.lit(1), **made, role=F.lit(ROW), depth=depth + 1, parent_seq=F.col("_table"), parent_part=F.lit(0)))
    leaves = cells.select(*_node(F.lit(2), depth=depth + 2, parent_seq=F.col("_row"), parent_part=F.lit(1)))
    return plain.unionByName(tables).unionByName(rows).unionByName(leaves)


CELL = ("doc_id", "table_seq", "row", "cell", "row_header", "header", "seq", "node_id", "text")


def assemble_tables(events: DataFrame, part: int = PART) -> DataFrame:
    """Tables as rows of cells: doc_id, table_seq, row and cell (from 0), row_header, header, seq, node_id, text.

    Blocks directly in a table (captions) have row and cell null. A row is a header row by its property header or by a
    header cell. Cells that only go on a merge from above are skipped, and a table in a cell is one of its own.
    """
    short, long, _ = _by_length(events, part)
    found = _tables_within(short)
    return found if long is None else found.unionByName(_tables_long(long, part))


def _tables_within(events: DataFrame) -> DataFrame:
    """`assemble_tables` of documents that are whole in a task."""
    opens, closes = F.col("kind") == "group_start", F.col("kind") == "group_end"
    marked = F.coalesce(F.try_element_at("properties", F.lit("header")), F.lit("")) == "true"
    rows = events.withColumns({"_shown": F.coalesce(_shown(), F.lit(False)), "_marked": marked, "header": F.coalesce(_role() == "table-header", F.lit(False))})
    rows = _depth_within(rows, opens, closes, "depth").filter(F.col("_shown") | opens)
    rows = _parent_within(rows, opens, "depth", "parent").withColumn("table_seq", F.col("parent.seq"))
    row = opens & (F.col("type") == ROW) & (F.col("parent.type") == TABLE)
    cell, lead = F.col("_shown") & (F.col("parent.type") == ROW), F.col("_shown") & (F.col("parent.type") == TABLE)
    rows = rows.withColumns({"_is_row": F.coalesce(row, F.lit(False)), "_is_cell": F.coalesce(cell, F.lit(False)), "_is_lead": F.coalesce(lead, F.lit(False))})
    rows = rows.withColumn("_nth", F.sum(F.col("_is_row").cast("long")).over(_running("doc_id", "table_seq")))
    rows = rows.withColumn("_of", F.when(F.col("_is_row"), F.col("seq")).when(F.col("_is_cell"), F.col("table_seq")))
    rows = rows.filter(F.col("_is_row") | F.col("_is_cell") | F.col("_is_lead"))
    whole, upto = _running("doc_id", "_of").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), _running("doc_id", "_of")
    own = F.max(F.when(F.col("_is_row"), F.struct(F.col("_nth").alias("nth"), "table_seq", F.col("_marked").alias("marked")))).over(whole)
    headed = F.max(F.col("_is_cell") & F.col("header")).over(whole)
    rows = rows.withColumns({"_own": own, "_headed": headed, "_cell": F.sum(F.col("_is_cell").cast("long")).over(upto)})
    rows = rows.filter(F.col("_is_lead") | F.col("_is_cell") & F.col("_own").isNotNull())
    within = F.col("_is_cell")
    return rows.withColumns({
        "row": F.when(within, F.col("_own.nth") - 1),
        "cell": F.when(within, F.col("_cell") - 1),
        "row_header": F.when(within, F.col("_own.marked") | F.col("_headed")).otherwise(False),
        "table_seq": F.when(within, F.col("_own.table_seq")).otherwise(F.col("table_seq")),
    }).select(*CELL)


def _tables_long(events: DataFrame, part: int) -> DataFrame:
    """`assemble_tables` of documents of many parts."""
    opens, closes = F.col("kind") == "group_start", F.col("kind") == "group_end"
    block = _shown()
    nodes = checkpoint(nested(events, opens, closes, block, part))
    groups = nodes.filter(opens & (F.col("type") == ROW) & (F.col("parent.type") == TABLE)).select(
        "doc_id", F.col("seq").alias("row_seq"), F.col("parent.seq").alias("table_seq"), (F.coalesce(F.try_element_at("properties", F.lit("header")), F.lit("")) == "true").alias("_marked")
    )
    groups = running_sums(groups, ["doc_id", "table_seq"], ["row_seq"], {"_nth": F.lit(1)}, part)
    leaves = nodes.filter(block).withColumn("header", F.coalesce(_role() == "table-header", F.lit(False)))
    cells = leaves.filter(F.col("parent.type") == ROW).withColumn("row_seq", F.col("parent.seq"))
    cells = running_sums(cells, ["doc_id", "row_seq"], ["seq"], {"_cell": F.lit(1)}, part)
    headed = cells.groupBy("doc_id", "row_seq").agg(F.max("header").alias("_headed"))
    rows = joined(groups, headed, ["doc_id", "row_seq"], ["_headed"])
    rows = rows.withColumns({"row": F.col("_nth") - 1, "row_header": F.col("_marked") | F.coalesce("_headed", F.lit(False))})
    placed = joined(cells, rows, ["doc_id", "row_seq"], ["table_seq", "row", "row_header"], "inner")
    lead = leaves.filter(F.col("parent.type") == TABLE)
    return placed.withColumn("cell", F.col("_cell") - 1).select(*CELL).unionByName(
        lead.withColumn("table_seq", F.col("parent.seq")).withColumns({"row": F.lit(None).cast("long"), "cell": F.lit(None).cast("long"), "row_header": F.lit(False)}).select(*CELL)
    )


#: Elements of a web page: group types, and roles of leaves.
GROUPS = {"table": TABLE, "tr": ROW, "ul": "unordered-list", "ol": "ordered-list", **{t: t for t in ("nav", "article", "section", "div", "header", "footer", "main", "aside", "blockquote")}}
LEAVES = {"td": "table-cell", "th": "table-header", "li": "list-item", "p": "paragraph", "caption": "caption", "title": "title", **{f"h{k}": "heading" for k in range(1, 7)}}
#: What isn't content: comments, scripts and styles.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
#: Tags of other elements, which are within the text of a leaf; and a tag with the text behind it.
INLINE = rf"(?i)</?(?!(?:{'|'.join(GROUPS | LEAVES)})[\s/>])[A-Za-z][^>]*>"
ELEMENT = r"</?[A-Za-z][A-Za-z0-9]*[^>]*>[^<]*"


def page_events(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Events of web pages: an event per tag of a known element, with the text up to the next tag."""
    known = F.create_map(*[F.lit(x) for pair in (GROUPS | LEAVES).items() for x in pair])
    shown = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), HIDDEN, " "), INLINE, "")
    tags = F.regexp_extract_all(shown, F.lit(ELEMENT), F.lit(0))
    found = pages.select(F.col(id_col).alias("doc_id"), F.posexplode(tags).alias("seq", "tag"))
    name = F.lower(F.regexp_extract("tag", r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    found = found.withColumns({"name": name, "closing": F.col("tag").startswith("</")}).withColumn("type", F.try_element_at(known, F.col("name")))
    group = F.col("name").isin(*GROUPS)
    kind = F.when(group & F.col("closing"), "group_end").when(group, "group_start").when(F.col("type").isNotNull() & ~F.col("closing"), "block")
    return found.withColumn("kind", kind).filter("kind is not null").select(
        "doc_id",
        F.col("seq").cast("long").alias("seq"),
        "kind",
        F.concat(F.col("name"), F.lit(":"), F.col("seq")).alias("node_id"),
        "type",
        F.when(F.col("kind") == "block", F.col("type")).alias("role"),
        F.regexp_extract("name", "^h([1-6])$", 1).try_cast("int").alias("level"),
        F.lit(None).cast("int").alias("col_span"),
        F.lit(None).cast("int").alias("row_span"),
        F.when(F.col("kind") == "block", F.regexp_extract("tag", r"(?s)>(.*)$", 1)).alias("text"),
        F.create_map().cast("map<string,string>").alias("properties"),
    )

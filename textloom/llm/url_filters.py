"""URL filters: listed rules, and a tree of path templates whose labelled purity decides about the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, pick, stage

#: (verdict, host and path) of the rules.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Levels of the tree; what lies deeper is one segment, a wildcard of its own.
DEPTH = 6
#: Pages (labelled, or all) that a branch needs to be a branch of its own; by how many standard errors, and by what
#: share at least, it must differ then.
SUPPORT, APART, GAP = 30, 3.0, 0.1
#: Classes of rates, of which the fullest is what a node's branches have in common.
CLASSES = 20
#: Weight of the host's purity in a template's, and of the whole table's in a host's, in labelled pages.
WEIGHT = 10.0
#: Least purity of a template that is let through.
PURITY = 0.5
#: Parts into which a key of a join is dealt.
SALTS = 8
#: Segments that name a thing, not a kind of things: hexadecimal codes of both digits and letters, and any digits.
CODE, NUMBER = "^[0-9a-fA-F-]{8,}$", "[0-9]+"
WILDCARD = "*"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?` or `#`, A-Z in lower case; else empty."""
    rest = after_scheme(url)
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to `?` or `#`; else empty."""
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def after_scheme(url: Column) -> Column:
    known = F.coalesce(url, F.lit(""))
    at = F.instr(known, "://")
    return F.when(at > 0, F.substring(known, at + 3, F.length(known))).otherwise(F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, of equally long ones that of the longer host; else null.

    A rule fits its host and all hosts below, where the path starts with the rule's. Rules are a list of the program.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].find("/"))):  # a later one goes before
        name, slash, rest = rule.partition("/")
        below = (host == name) | host.endswith(f".{name}")
        fits = below & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def segments(path: Column, depth: int) -> Column:
    """Segments of a path with numbers and codes as placeholders; deeper ones count as one."""

    def shaped(part: Column) -> Column:
        code = part.rlike(CODE) & part.rlike("[0-9]") & part.rlike("[a-fA-F]")
        return F.when(code, "{c}").otherwise(F.regexp_replace(part, NUMBER, "{n}"))

    parts = F.transform(F.filter(F.split(path, "/"), lambda _, i: i > 0), shaped)
    deep = F.concat(F.slice(parts, 1, depth - 1), F.array(F.lit("**")))
    return F.when(F.size(parts) > depth, deep).otherwise(parts)


def salted_left_join(rows: DataFrame, few: DataFrame, on: list[str], spread: Column, salts: int = SALTS) -> DataFrame:
    """Left join of `rows` with the smaller `few`, each key in `salts` parts: a key of a third of all rows is no single task.

    Never a broadcast: Spark would judge by the size before the copies, of compressed files at that, and the driver would hold them all.
    """
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    copies = few.withColumn("salt", F.explode(F.array(*[F.lit(k).cast("long") for k in range(salts)])))
    return dealt.join(copies.hint("merge"), [*on, "salt"], "left").drop("salt")


def rate_class(hits: str, total: str) -> Column:
    return F.least(F.floor(F.try_divide(F.col(hits) * CLASSES, F.col(total))), F.lit(CLASSES - 1))


def common_rate(children: DataFrame, hits: str, total: str) -> DataFrame:
    """What most pages of a node have: hits and total of the fullest class of its branches' rates (of equals the lowest)."""
    classes = children.withColumn("class", rate_class(hits, total)).filter("class is not null").groupBy("host", "so_far", "class")
    summed = classes.agg(F.sum(hits).alias("hits"), F.sum(total).alias("total"))
    best = F.max_by(F.struct("hits", "total"), F.struct("total", -F.col("class")))
    return summed.groupBy("host", "so_far").agg(best.alias(f"common_{hits}"))


def differs(hits: str, total: str, support: int, apart: float, gap: float) -> Column:
    """Whether a branch's rate is further from its node's common one than chance explains (two-proportion test), and by `gap`."""
    h, t, common = F.col(hits), F.col(total), F.col(f"common_{hits}")
    rate = F.try_divide(h + common["hits"], t + common["total"])
    error = rate * (1 - rate) * (F.try_divide(F.lit(1), t) + F.try_divide(F.lit(1), common["total"]))
    off = F.try_divide(h, t) - F.try_divide(common["hits"], common["total"])
    return F.coalesce((t >= support) & (common["total"] >= support) & (off * off > F.greatest(apart * apart * error, F.lit(gap * gap))), F.lit(False))


def own_branches(rows: DataFrame, level: int, support: int, apart: float, gap: float) -> DataFrame:
    """Segments of this level that stay as they are: (host, so_far, here).

    They have support and differ from what the branches of their node have in common, in the share of bad pages among
    labelled ones or in the share of paths that end there. All others are alike, or too small to tell, and merge into the wildcard.
    """
    sums = [
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.size("parts") == level + 1, 1).otherwise(0)).alias("ends"),
        F.count("bad").alias("labelled"),
        F.sum(F.coalesce(F.col("bad").cast("long"), F.lit(0))).alias("bads"),
    ]
    children = stage(rows.groupBy("host", "so_far", "here").agg(*sums))
    rates = (("bads", "labelled"), ("ends", "n"))
    nodes = common_rate(children, *rates[0]).join(common_rate(children, *rates[1]), ["host", "so_far"], "full")
    tested = salted_left_join(children.filter(F.col("n") >= support), nodes, ["host", "so_far"], F.col("here"))
    apart_ = [differs(hits, total, support, apart, gap) for hits, total in rates]
    return tested.filter(apart_[0] | apart_[1]).select("host", "so_far", "here")


def with_templates(pages: DataFrame, depth: int = DEPTH, support: int = SUPPORT, apart: float = APART, gap: float = GAP) -> DataFrame:
    """Adds `template` to rows of id, host, parts and bad (null: not labelled)."""
    deepest = pages.agg(F.max(F.size("parts")).alias("n")).first()["n"] or 0
    rows = pages.withColumn("so_far", F.lit(""))
    for level in range(deepest):
        here = F.element_at("parts", level + 1)
        placeholder = (here == "") | (here == "**") | here.contains("{n}") | here.contains("{c}")
        rows = rows.withColumn("here", F.when(F.size("parts") > level, here))
        rows = rows.withColumn("fixed", F.when(F.size("parts") > level, placeholder).otherwise(False))
        kept = stage(own_branches(rows.filter(F.col("here").isNotNull() & ~F.col("fixed")), level, support, apart, gap).withColumn("own", F.lit(True)))
        rows = salted_left_join(rows, kept, ["host", "so_far", "here"], F.col("id"))
        grown = F.concat("so_far", F.lit("/"), F.when(F.col("fixed") | F.col("own"), F.col("here")).otherwise(WILDCARD))
        rows = rows.withColumn("so_far", F.when(F.col("here").isNull(), F.col("so_far")).otherwise(grown)).drop("here", "fixed", "own")
    return rows.withColumnRenamed("so_far", "template")


def url_filter(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    bad_col: str = "bad",
    rules: Sequence[tuple[str, str]] = RULES,
    depth: int = DEPTH,
    support: int = SUPPORT,
    apart: float = APART,
    gap: float = GAP,
    weight: float = WEIGHT,
    least_purity: float = PURITY,
) -> DataFrame:
    """One row per row of `pages`: id, host, path, rule, verdict, template, labelled and purity.

    Each host has a tree of path templates. Numbers and codes in a segment are placeholders from the start; level by level,
    from the root, branches that don't differ statistically from what most of their node's pages have (in the share of bad
    pages among labelled ones, in the share of paths that end there) merge into a wildcard, so that what lies below is
    counted together. A template's purity is its share of good pages among labelled ones, smoothed towards its
    host's, which is smoothed towards that of all pages. Templates below `least_purity` are rejected. A page has the verdict
    of the longest rule that fits it, else that of its template.

    bad_col: true or false for labelled pages, null for others.

    Counts are over all pages. What is counted combines before it is shuffled; each level joins back only the few branches
    that stay, in salted parts, so a host or path of a third of all pages is no single task.

    A null url, or one without `://`, has an empty host and path and goes by the template of that host. Null ids and
    repeated rows are rows like others. Without labelled pages nothing is rejected. An empty table gives an empty result.
    Further columns of `pages` are ignored, whatever their names. Paths of more than `depth` segments are
    counted by the first ones; hosts and paths are returned whole.
    """
    parsed = pick(pages, id=id_col, url=url_col, bad=bad_col).select(
        "id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("bad").cast("boolean").alias("bad")
    )
    parsed = stage(parsed.withColumn("parts", segments(F.col("path"), depth)))
    labelled = F.count("bad")
    good = labelled - F.sum(F.coalesce(F.col("bad").cast("long"), F.lit(0)))
    rows = with_templates(parsed, depth, support, apart, gap)
    templates = stage(rows.groupBy("host", "template").agg(labelled.alias("labelled"), good.alias("good")))
    hosts = stage(templates.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("good").alias("host_good")))
    sums = hosts.agg(F.sum("host_labelled").alias("labelled"), F.sum("host_good").alias("good")).first()
    overall = F.lit(sums["good"] / sums["labelled"] if sums["labelled"] else 1.0)
    judged = salted_left_join(templates, hosts, ["host"], F.col("template"))
    judged = judged.withColumn("host_purity", (F.col("host_good") + weight * overall) / (F.col("host_labelled") + weight))
    judged = judged.select("host", "template", "labelled", ((F.col("good") + weight * F.col("host_purity")) / (F.col("labelled") + weight)).alias("purity"))
    rows = salted_left_join(rows, stage(judged), ["host", "template"], F.col("id"))
    rows = rows.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    by_template = F.when(F.col("purity") < least_purity, "block").otherwise("allow")
    return rows.select("id", "host", "path", "found.rule", F.coalesce("found.verdict", by_template).alias("verdict"), "template", "labelled", "purity")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages (page_id, url) with `bad`, from labels of documents: the last number of a page's path names its document.

    Bad is what has quality 0 or is toxic; of a document with several labels, one bad one counts. Pages without such a
    number or label stay unlabelled (null).
    """
    number = F.regexp_extract(path_of(F.col("url")), "([0-9]+)[^0-9]*$", 1)
    named = pick(pages, page_id="page_id", url="url").withColumn("doc_id", number.try_cast("bigint"))
    marks = (
        pick(labels, doc_id="doc_id", quality="quality", toxic="toxic")
        .filter("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.bool_or((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    )
    return salted_left_join(named, marks, ["doc_id"], F.struct("page_id", "url"))


def oracle(depth: int = DEPTH) -> str:
    """The query as one statement: three steps for each level of the tree."""
    def differ(h: str, t: str) -> str:
        rate = f"(({h} + {h}_hits) / ({t} + {h}_total))"
        return f"""({t} >= {SUPPORT} and {h}_total >= {SUPPORT} and power({h} / {t} - {h}_hits / {h}_total, 2)
      > greatest({APART}::double * {APART} * ({rate} * (1 - {rate}) * (1 / {t} + 1 / {h}_total)), {GAP}::double * {GAP}))"""

    def common(k: int, h: str, t: str) -> str:
        return f"""(select host, so_far, max_by({{hits: hits, total: total}}, [total, -class]) as c from (
      select host, so_far, least(floor({h} * {CLASSES} / {t}), {CLASSES - 1}) as class, sum({h}) as hits, sum({t}) as total from child{k} where {t} > 0 group by all
    ) group by all)"""

    levels = "".join(
        f"""
), at{k} as (
  select *, parts[{k}] as here, parts[{k}] in ('', '**') or contains(parts[{k}], '{{n}}') or contains(parts[{k}], '{{c}}') as fixed from tree{k - 1}
), child{k} as (
  select host, so_far, here, count(*)::double as n, sum(case when len(parts) = {k} then 1 else 0 end)::double as ends,
    count(bad)::double as labelled, sum(coalesce(bad::int, 0))::double as bads
  from at{k} where here is not null and not fixed group by all
), own{k} as (
  select host, so_far, here from (
    select c.*, b.c.hits as bads_hits, b.c.total as bads_total, e.c.hits as ends_hits, e.c.total as ends_total
    from child{k} c left join {common(k, "bads", "labelled")} b using (host, so_far) left join {common(k, "ends", "n")} e using (host, so_far)
  ) where n >= {SUPPORT} and (coalesce({differ("bads", "labelled")}, false) or coalesce({differ("ends", "n")}, false))
), tree{k} as (
  select a.id, a.host, a.path, a.bad, a.parts,
    case when a.here is null then a.so_far when a.fixed or o.here is not null then a.so_far || '/' || a.here else a.so_far || '/{WILDCARD}' end as so_far
  from at{k} a left join own{k} o on o.host = a.host and o.so_far = a.so_far and o.here = a.here"""
        for k in range(1, depth + 1)
    )
    fits = " ".join(
        f"when (host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '/{rest}') then '{{}}'".replace("{}", value)
        for name, rest, value in ((*rule.partition("/")[::2], rule) for _, rule in sorted(RULES, key=lambda r: -len(r[1])))
    )
    verdicts = " ".join(f"when '{rule}' then '{verdict}'" for verdict, rule in RULES)
    return f"""
with cut as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), addressed as (
  select page_id as id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from cut
), marks as (
  select doc_id, bool_or(coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1) as bad from labels group by doc_id
), shaped as (
  select a.*, bad, list_transform(string_split(path, '/')[2:], lambda p: case
    when regexp_matches(p, '{CODE}') and regexp_matches(p, '[0-9]') and regexp_matches(p, '[a-fA-F]') then '{{c}}'
    else regexp_replace(p, '{NUMBER}', '{{n}}', 'g') end) as parts
  from addressed a left join marks on doc_id = try_cast(nullif(regexp_extract(path, '([0-9]+)[^0-9]*$', 1), '') as bigint)
), tree0 as (
  select id, host, path, bad, case when len(parts) > {depth} then list_append(parts[1:{depth - 1}], '**') else parts end as parts, '' as so_far from shaped{levels}
), template as (
  select host, so_far as template, count(bad) as labelled, count(bad) - sum(coalesce(bad::int, 0)) as good from tree{depth} group by all
), hosted as (
  select host, sum(labelled)::double as host_labelled, sum(good)::double as host_good from template group by host
), overall as (
  select case when sum(labelled) > 0 then sum(good)::double / sum(labelled) else 1.0 end as whole from template
), judged as (
  select host, template, labelled, (good + {WEIGHT}::double * ((host_good + {WEIGHT}::double * whole) / (host_labelled + {WEIGHT}::double))) / (labelled + {WEIGHT}::double) as purity
  from template join hosted using (host), overall
), ruled as (
  select id as page_id, host, path, so_far as template, case {fits} end as rule from tree{depth}
)
select page_id, host, path, rule, case rule {verdicts} else case when purity < {PURITY} then 'block' else 'allow' end end as verdict, template,
  labelled, round(purity, 6) as purity
from ruled join judged using (host, template)
"""

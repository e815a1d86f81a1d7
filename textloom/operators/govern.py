"""Governance: roll-ups, gates, funnels, drift, blast radius, estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import weight

#: The dimensions of a compliance score.
DIMENSIONS = ("tone", "style", "vocabulary", "clarity", "compliance")


def gate_rollup(pairs: DataFrame, verdicts: DataFrame, keys: list[str], by: list[str], least: float) -> DataFrame:
    """Per group: pairs, those with a verdict on the current basis, those that pass, those held.

    pairs: keys, by, basis; verdicts: keys, basis, score.
    """
    v = verdicts.select(*keys, F.col("basis").alias("_basis"), "score")
    joined = pairs.join(v, keys, "left")
    fresh = F.coalesce(F.col("_basis") == F.col("basis"), F.lit(False))
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(fresh).alias("judged"),
        F.count_if(fresh & (F.col("score") >= least)).alias("passed"),
        F.count_if(fresh & (F.col("score") < least)).alias("held"),
    )


def stale_pairs(pairs: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs without a verdict or with one on another basis."""
    v = verdicts.select(*keys, F.col("basis").alias("_basis"))
    return pairs.join(v, keys, "left").filter("_basis is null or _basis <> basis").drop("_basis")


def share_percent(part: Column, total: Column) -> Column:
    """Whole percent, rounded half up in integers."""
    return F.when(total > 0, F.floor((F.floor(part * 200 / total) + 1) / 2)).otherwise(0).cast("long")


def funnel(counts: DataFrame, steps: list[str | tuple[str, str]], totals: dict[str, str] | None = None) -> DataFrame:
    """From one row of counts: step, n, percent of the total of the step's basis, drop from the step before.

    A step is a column or (column, basis); totals: basis -> column of its total, else the first step. A drop counts
    within a basis only and isn't negative.
    """
    named = [(s, "") if isinstance(s, str) else s for s in steps]
    whole = totals or {}
    rows = []
    for k, (step, basis) in enumerate(named):
        follows = k > 0 and named[k - 1][1] == basis
        lost = F.greatest(F.col(named[k - 1][0]) - F.col(step), F.lit(0).cast("long")) if follows else F.lit(0).cast("long")
        percent = share_percent(F.col(step), F.col(whole.get(basis, named[0][0])))
        rows.append(F.struct(F.lit(k + 1).alias("ordinal"), F.lit(step).alias("step"), F.col(step).alias("n"), percent.alias("percent"), lost.alias("lost")))
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def drift(trends: DataFrame, by: list[str], at: str, score: str, weight: str, recent: int = 7, least_drop: float = 0.0, floor: float = 0.0) -> DataFrame:
    """Weighted mean of the last `recent` rows of each group against that of the rows before them (of none: itself).

    A group drifts if its recent mean is below `floor` or has dropped by `least_drop`; with neither given by 10. Without
    recent weight the means are 0 and nothing drifts.
    """
    least = 10.0 if not least_drop and not floor else least_drop
    newest = Window.partitionBy(*by).orderBy(F.desc(at))
    marked = trends.withColumn("_new", F.row_number().over(newest) <= recent)

    def mean(condition: Column) -> Column:
        total = F.sum(F.when(condition, F.col(weight)))
        return F.coalesce(F.try_divide(F.sum(F.when(condition, F.col(score) * F.col(weight))), total).cast("double"), F.lit(0.0))

    new, old = F.col("_new"), ~F.col("_new")
    out = marked.groupBy(*by).agg(
        mean(new).alias("_r"), mean(old).alias("_b"), F.count_if(old).alias("_rows"), F.coalesce(F.sum(F.when(new, F.col(weight))), F.lit(0)).alias("recent_count")
    )
    out = out.withColumn("_b", F.when(F.col("_rows") > 0, F.col("_b")).otherwise(F.col("_r"))).withColumn("drop", F.round(F.col("_b") - F.col("_r"), 1))
    fell = (F.lit(floor > 0) & (F.col("_r") < floor)) | (F.lit(least > 0) & (F.col("drop") >= least))
    return out.select(*by, F.round("_r", 1).alias("recent"), F.round("_b", 1).alias("baseline"), "drop", "recent_count", ((F.col("recent_count") > 0) & fell).alias("drifted"))


def blast_radius(blocks: DataFrame, before: DataFrame, after: DataFrame, key: str, by: str) -> DataFrame:
    """What a new rule set changes per group: blocks affected, prescribed, improved, degraded; violations new, resolved and
    critical; and the mean change of score of affected blocks.

    before, after: findings (key, category, severity, replacement) under the old and the new rules. A category that one
    side alone has is new or resolved; a new one with a replacement prescribes. A block's score is 100 less the penalties
    of all its findings, at least 0.
    """
    sides = before.withColumn("_side", F.lit(0)).unionByName(after.withColumn("_side", F.lit(1)))
    old, new = F.col("_side") == 0, F.col("_side") == 1
    rules = sides.groupBy(key, "category").agg(
        F.bool_or(old).alias("_old"),
        F.bool_or(new).alias("_new"),
        F.coalesce(F.bool_or(new & (F.col("severity") == "critical")), F.lit(False)).alias("_critical"),
        F.coalesce(F.bool_or(new & (F.coalesce("replacement", F.lit("")) != "")), F.lit(False)).alias("_fix"),
        F.sum(F.when(old, weight(F.col("severity"))).otherwise(0)).alias("_was"),
        F.sum(F.when(new, weight(F.col("severity"))).otherwise(0)).alias("_is"),
    )
    added = F.col("_new") & ~F.col("_old")
    per_block = rules.groupBy(key).agg(
        F.count_if(added).alias("new"),
        F.count_if(F.col("_old") & ~F.col("_new")).alias("gone"),
        F.count_if(added & F.col("_critical")).alias("critical"),
        F.bool_or(added & F.col("_fix")).alias("fix"),
        (F.greatest(100 - F.sum("_is"), F.lit(0)) - F.greatest(100 - F.sum("_was"), F.lit(0))).alias("delta"),
    )
    joined = blocks.select(key, by).join(per_block, key, "left").fillna(0, ["new", "gone", "critical", "delta"]).fillna(False, ["fix"])
    changed = (F.col("new") > 0) | (F.col("gone") > 0)
    return joined.groupBy(by).agg(
        F.count(F.lit(1)).alias("blocks"),
        F.count_if(changed).alias("affected"),
        F.count_if("fix").alias("prescribed"),
        F.count_if(F.col("delta") > 0).alias("improved"),
        F.count_if(F.col("delta") < 0).alias("degraded"),
        F.sum("new").alias("new_violations"),
        F.sum("gone").alias("resolved_violations"),
        F.sum("critical").alias("critical"),
        F.coalesce(F.avg(F.when(changed, F.col("delta"))), F.lit(0.0)).alias("mean_delta"),
    )


def job_status(jobs: DataFrame, by: list[str], state: str = "state") -> DataFrame:
    """in_progress while any job is queued or processing, else some_failed if any failed, else all_completed."""
    busy, failed = F.bool_or(F.col(state).isin("queued", "processing")), F.bool_or(F.col(state) == "failed")
    return jobs.groupBy(*by).agg(F.when(busy, "in_progress").when(failed, "some_failed").otherwise("all_completed").alias("status"))


def ship_manifest(coverage: DataFrame, by: str) -> DataFrame:
    return coverage.groupBy(by).agg(F.bool_and(F.col("shippable") & F.col("verified")).alias("ships"))


def corpus_budget(sources: DataFrame, ranks: dict[str, int], budget: int, kind: str = "kind", label: str = "label", text: str = "text", by: list[str] | None = None) -> DataFrame:
    """Sources with text by rank of their kind, then label, that fit a budget of characters (0: none); columns as given.

    Each takes a header line, the line break after it and, but for the first, two before it, then its trimmed text. The
    one that crosses the budget is cut, and none follows one of which nothing fits. A project's sources (`by`) are
    its few inputs: the running sum orders them in one window.
    """
    known = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    own = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_rank", label)
    body = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    rows = sources.withColumn(text, body).filter(F.col(text) != "").withColumn("_rank", F.coalesce(F.try_element_at(known, F.col(kind)), F.lit(len(ranks))))
    title = F.coalesce(F.nullif(F.trim(label), F.lit("")), F.col(kind))
    header = F.char_length(F.concat(F.lit("=== source: "), title, F.lit(" ("), F.col(kind), F.lit(") ===")))
    rows = rows.withColumn("_extra", header + 1 + F.when(F.row_number().over(own) > 1, 2).otherwise(0))
    if budget <= 0:
        return rows.drop("_rank", "_extra")
    used = F.coalesce(F.sum(F.col("_extra") + F.char_length(text)).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_left", F.lit(budget) - used - F.col("_extra"))
    fits = F.min("_left").over(own.rowsBetween(Window.unboundedPreceding, 0)) > 0
    return rows.withColumn("_fits", fits).filter("_fits").withColumn(text, F.substring(text, F.lit(1), F.col("_left").cast("int"))).drop("_rank", "_extra", "_left", "_fits")


def estimate(blocks: DataFrame, memory_hits: DataFrame, key: str, by: str, text: str) -> DataFrame:
    """Per group: pending blocks, those a memory match fills, those left, and their tokens (characters / 4, up)."""
    hits = memory_hits.select(key).distinct().withColumn("_hit", F.lit(True))
    joined = blocks.join(hits, key, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    tokens = F.ceil(F.char_length(text) / 4)
    return joined.groupBy(by).agg(
        F.count(F.lit(1)).alias("pending"),
        F.count_if(F.col("_hit")).alias("via_memory"),
        F.count_if(~F.col("_hit")).alias("via_model"),
        F.sum(F.when(F.col("_hit"), 0).otherwise(tokens)).cast("long").alias("tokens"),
    )


def term_rule_map(rules: DataFrame, term: str, target: str, order: str) -> DataFrame:
    """The first rule of each term; rules with an empty half don't count."""
    whole = rules.filter((F.coalesce(F.col(term), F.lit("")) != "") & (F.coalesce(F.col(target), F.lit("")) != ""))
    return whole.groupBy(term).agg(F.min_by(target, order).alias(target))


def merge_candidates(suggestions: DataFrame, decisions: DataFrame, term: str = "term", resolved: bool = False) -> DataFrame:
    """Suggestions with their decision (pending where there is none) by case-folded term; resolved ones hidden."""
    d = decisions.select(F.lower(term).alias("_t"), F.col("decision")).dropDuplicates(["_t"])
    out = suggestions.withColumn("_t", F.lower(term)).join(d, "_t", "left").drop("_t")
    out = out.withColumn("decision", F.coalesce("decision", F.lit("pending")))
    return out if resolved else out.filter("decision = 'pending'")


def resolve_profile(requests: DataFrame, columns: list[str]) -> DataFrame:
    """The first profile given, in the order of `columns`."""
    return requests.withColumn("profile", F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns]))


def usable(docs: DataFrame, regex: str) -> bool:
    """Whether a rule's pattern compiles; one that doesn't, or is empty, decides nothing."""
    try:
        docs.sparkSession._jvm.java.util.regex.Pattern.compile(regex)
    except Exception:  # noqa: BLE001  the JVM's syntax error
        return False
    return regex.strip() != ""


def pattern_findings(docs: DataFrame, patterns: list[tuple[str, str, str]], key: str, text: str) -> DataFrame:
    """(key, rule, severity, matches) of prohibited patterns (rule, regex, severity), a rule book's short list.

    Patterns that don't compile and matches of no characters are ignored; a rule without severity is major.
    """
    def matches(regex: str) -> Column:
        return F.size(F.filter(F.regexp_extract_all(F.col(text), F.lit(regex), F.lit(0)), lambda m: m != "")).cast("long")

    hits = [
        F.struct(F.lit(rule).alias("rule"), F.lit(severity or "major").alias("severity"), matches(regex).alias("matches"))
        for rule, regex, severity in patterns
        if usable(docs, regex)
    ]
    if not hits:
        return docs.select(key, F.lit("").alias("rule"), F.lit("").alias("severity"), F.lit(0).cast("long").alias("matches")).limit(0)
    return docs.select(key, F.explode(F.array(*hits)).alias("h")).select(key, "h.*").filter("matches > 0")


def unmet_patterns(docs: DataFrame, patterns: list[tuple[str, str]], key: str, text: str) -> DataFrame:
    """(key, rule) of required patterns that a document lacks; patterns that don't compile are ignored."""
    missing = [F.when(~F.col(text).rlike(regex), F.lit(rule)) for rule, regex in patterns if usable(docs, regex)]
    return docs.select(key, F.explode(F.array_compact(F.array(*missing, F.lit(None).cast("string")))).alias("rule"))


def compliance_scores(found: DataFrame, keys: list[str], of: DataFrame) -> DataFrame:
    """Per key of `of` and dimension: score, penalty and issues, and the key's overall score; 100 for keys without findings.

    found: keys, category, severity. Each score is 100 less the penalties, at least 0, whatever the length; dimensions
    without findings score 100, and findings of other categories count in none.
    """
    sums = found.filter(F.col("category").isin(*DIMENSIONS)).groupBy(*keys, "category").agg(
        F.sum(weight(F.col("severity"))).alias("penalty"), F.count(F.lit(1)).alias("issues")
    )
    held = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("category", F.struct("penalty", "issues")))).alias("m"), F.sum("penalty").alias("total"))
    every = of.select(*keys).distinct().join(held, keys, "left").withColumn("dimension", F.explode(F.array(*[F.lit(d) for d in DIMENSIONS])))
    of = F.try_element_at("m", F.col("dimension"))
    penalty = F.coalesce(of["penalty"], F.lit(0)).cast("long")

    def score(lost: Column) -> Column:
        return F.greatest(F.lit(100) - F.coalesce(lost, F.lit(0)), F.lit(0)).cast("long")

    return every.select(
        *keys, "dimension", score(penalty).alias("score"), penalty.alias("penalty"), F.coalesce(of["issues"], F.lit(0)).cast("long").alias("issues"), score(F.col("total")).alias("overall")
    )


def similarity_findings(vectors: DataFrame, references: list[list[float]], key: str, vector: str, least: float) -> DataFrame:
    """(key, similarity) of vectors whose best dot product with the reference examples (a short list) is below `least`."""

    def dot(reference: list[float]) -> Column:
        return F.aggregate(F.zip_with(vector, F.lit(reference), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)

    best = F.greatest(*[dot(r) for r in references], F.lit(float("-inf")))
    return vectors.select(key, best.alias("similarity")).filter(F.col("similarity") < least)

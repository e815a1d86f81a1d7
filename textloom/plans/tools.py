"""The tools of flows, as thin steps over the expressions and operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import edits as run_edits
from ..functions import identity, runs, text
from ..operators import checks
from .flow import register

BODY = {"needs": {"source_text"}}


def _only_translatable(df: DataFrame, value) -> DataFrame:
    if "translatable" in df.columns:
        value = F.when(F.col("translatable"), value).otherwise(F.col("source_text"))
    return df.withColumn("source_text", value)


@register("search-replace", **BODY)
def search_replace(df: DataFrame, pairs: list[tuple[str, str]], regex: bool = False, ignore_case: bool = False) -> DataFrame:
    return _only_translatable(df, text.search_replace(F.col("source_text"), pairs, regex, ignore_case))


@register("case-transform", **BODY)
def case_transform(df: DataFrame, mode: str = "upper") -> DataFrame:
    change = {"upper": F.upper, "lower": F.lower}[mode]
    return _only_translatable(df, change("source_text"))


@register("whitespace-correct", **BODY)
def whitespace_correct(df: DataFrame, **options: bool) -> DataFrame:
    return _only_translatable(df, text.correct_space(F.col("source_text"), **options))


@register("pseudo-translate", needs={"source_text"}, gives={"target_text"}, locales="bilingual")
def pseudo_translate(df: DataFrame, **options) -> DataFrame:
    return df.withColumn("target_text", text.pseudo(F.col("source_text"), **options))


@register("create-target", needs={"source_text"}, gives={"target_text"}, locales="bilingual")
def create_target(df: DataFrame, copy_source: bool = True, overwrite: bool = False) -> DataFrame:
    made = F.col("source_text") if copy_source else F.lit("")
    old = F.col("target_text") if "target_text" in df.columns and not overwrite else F.lit(None)
    return df.withColumn("target_text", F.coalesce(old, made))


@register("remove-target", needs={"target_text"}, locales="bilingual")
def remove_target(df: DataFrame, ids: list[str] | None = None) -> DataFrame:
    gone = F.lit(True) if ids is None else F.col("block_id").isin(ids)
    return df.withColumn("target_text", F.when(~gone, F.col("target_text")))


@register("properties-set", needs={"properties"})
def properties_set(df: DataFrame, values: dict[str, str], overwrite: bool = True) -> DataFrame:
    new = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    if overwrite:
        kept = F.map_filter("properties", lambda k, _: ~k.isin(list(values)))
        return df.withColumn("properties", F.map_concat(kept, new))
    return df.withColumn("properties", F.map_concat(F.map_filter(new, lambda k, _: ~F.array_contains(F.map_keys("properties"), k)), "properties"))


@register("word-count", needs={"source_text"}, gives={"words", "chars"})
def word_count(df: DataFrame) -> DataFrame:
    return df.withColumn("words", text.count_words(F.col("source_text"))).withColumn("chars", text.count_chars(F.col("source_text")))


@register("encoding-detect", needs={"source_text"}, gives={"encoding"})
def encoding_detect(df: DataFrame) -> DataFrame:
    return df.withColumn("encoding", text.encoding(F.col("source_text")))


@register("identity", needs={"source_text"}, gives={"content_hash"})
def content_identity(df: DataFrame) -> DataFrame:
    return df.withColumn("content_hash", identity.content_hash(F.col("source_text")))


@register("source-check", needs={"block_id", "source_text", "source_status", "translatable"})
def source_check(df: DataFrame, findings: DataFrame | None = None, block_severity: str = "") -> DataFrame:
    """Settles the status of translatable blocks by the worst of their findings, a terminal step after source checks.

    findings: rows of block_id and severity that checks before left, of any kind. A finding of `block_severity` (minor,
    major or critical; major by default) or above makes a block 'authored' again; any other block becomes 'checked', or stays
    'approved'. Blocks without any text keep their status, as do those that aren't translatable.
    """
    wanted = block_severity.strip().lower() or "major"
    if wanted not in ("minor", "major", "critical"):
        raise ValueError(f"block_severity is minor, major or critical, not {block_severity}")
    settled = F.when(F.col("source_status") == "approved", "approved").otherwise("checked")
    out = df
    if findings is not None:
        worst = findings.groupBy("block_id").agg(F.max(checks.weight(F.col("severity"))).alias("_worst"))
        out = df.join(worst, "block_id", "left")
        settled = F.when(F.coalesce("_worst", F.lit(0)) >= checks.WEIGHTS[wanted], "authored").otherwise(settled)
    open_ = F.coalesce(F.col("translatable"), F.lit(False)) & (F.coalesce("source_text", F.lit("")) != "")
    return out.withColumn("source_status", F.when(open_, settled).otherwise(F.col("source_status"))).select(*df.columns)


@register("source-gate", needs={"block_id", "source_text", "source_status", "translatable"}, gives={"held"})
def source_gate(df: DataFrame, required: str = "checked", findings: DataFrame | None = None) -> DataFrame:
    """Settles the status of translatable blocks and holds those below the required one; 'none' does neither.

    Settled as by `source_check`, from the hygiene findings of the texts and those given. An unknown `required` is 'checked'.
    """
    if required == "none":
        return df.withColumn("held", F.lit(False))
    ladder = ["authored", "checked", "approved"]
    wanted = ladder.index(required if required in ladder else "checked")
    left = checks.lint(df, ["block_id"], "source_text").select("block_id", "severity")
    out = source_check(df, left if findings is None else left.unionByName(findings.select("block_id", "severity")))
    rank = F.array_position(F.array(*[F.lit(s) for s in ladder]), F.col("source_status")) - 1
    return out.withColumn("held", F.coalesce(F.col("translatable") & (rank < wanted), F.lit(False)))


@register("apply-edits", needs={"block_id", "source_text"}, gives={"edit_state"})
def apply_edits(df: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (block_id, expected_hash, new_text) of plain texts, found by id, else by the hash of the block's text.

    skipped where nothing changes, else stale where the hash differs, else applied; none where there is no edit or the
    block isn't translatable. Of several edits for an id or hash the first text in order counts.
    """
    by_id = edits.filter("block_id is not null").groupBy("block_id").agg(F.min(F.struct("new_text", "expected_hash")).alias("_by_id"))
    by_hash = edits.filter("coalesce(expected_hash, '') <> ''").groupBy(F.col("expected_hash").alias("_hash")).agg(F.min(F.struct("new_text", F.col("expected_hash"))).alias("_by_hash"))
    held = df.withColumn("_hash", identity.content_hash(F.col("source_text"))).join(by_id, "block_id", "left").join(by_hash, "_hash", "left")
    edit = F.coalesce("_by_id", "_by_hash")
    open_ = F.col("translatable") if "translatable" in df.columns else F.lit(True)
    state = (
        F.when(F.col("_edit").isNull() | ~open_, "none")
        .when(F.col("_edit.new_text") == F.col("source_text"), "skipped")
        .when((F.coalesce(F.col("_edit.expected_hash"), F.lit("")) != "") & (F.col("_edit.expected_hash") != F.col("_hash")), "stale")
        .otherwise("applied")
    )
    out = held.withColumn("_edit", edit).withColumn("edit_state", state)
    changed = F.when(F.col("edit_state") == "applied", F.col("_edit.new_text")).otherwise(F.col("source_text"))
    return out.withColumn("source_text", changed).select(*df.columns, "edit_state")


@register("apply-run-edits", needs={"block_id", "source"}, gives={"edit_state"})
def apply_run_edits(df: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (block_id, expected_hash, new_text) of blocks whose source is runs; codes in new_text as <x id="..."/> tags.

    States as in `apply_edits`, and guard_failed where the new text would lose, invent, repeat or unbalance a code; then the
    source stays. A source with plural or select runs is replaced by the plain text.
    """
    by_id = edits.filter("block_id is not null").groupBy("block_id").agg(F.min(F.struct("new_text", "expected_hash")).alias("_by_id"))
    by_hash = edits.filter("coalesce(expected_hash, '') <> ''").groupBy(F.col("expected_hash").alias("_hash")).agg(F.min(F.struct("new_text", F.col("expected_hash"))).alias("_by_hash"))
    held = df.withColumn("_hash", identity.content_hash(runs.plain_text(F.col("source")))).join(by_id, "block_id", "left").join(by_hash, "_hash", "left")
    held = held.withColumn("_edit", F.coalesce("_by_id", "_by_hash"))
    held = held.withColumn("_new", run_edits.parse_placeholder_text(F.col("_edit.new_text"), F.col("source"))).withColumn("_flat", ~run_edits.structured(F.col("source")))
    open_ = F.coalesce(F.col("translatable"), F.lit(True)) if "translatable" in df.columns else F.lit(True)
    state = (
        F.when(F.col("_edit").isNull() | ~open_, "none")
        .when(F.col("_edit.new_text") == run_edits.placeholder_text(F.col("source")), "skipped")
        .when((F.coalesce(F.col("_edit.expected_hash"), F.lit("")) != "") & (F.col("_edit.expected_hash") != F.col("_hash")), "stale")
        .when(F.col("_flat") & ~run_edits.codes_kept(F.col("source"), F.col("_new")), "guard_failed")
        .otherwise("applied")
    )
    plain = F.array(run_edits._text_run(runs.plain_text(F.col("_new"))))
    out = held.withColumn("edit_state", state)
    changed = F.when(F.col("edit_state") == "applied", F.when(F.col("_flat"), F.col("_new")).otherwise(plain)).otherwise(F.col("source"))
    return out.withColumn("source", changed).select(*df.columns, "edit_state")

"""Fill-in-the-middle: documents rearranged as prefix, suffix and middle, in Spark SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: A unit is a run of ASCII letters or one other code point.
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Per cent of documents that are rearranged, and of those that put the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Code points of a text whose units are an array at once; a block goes on to the end of its last letters.
BLOCK = 1 << 17


def overlap(sentinels: tuple[str, ...]) -> bool:
    """Whether the end of one sentinel is the start of another, or one lies in another: then parsing isn't unique."""
    return any(
        (a != b and a in b) or any(a[k:] and b.startswith(a[k:]) for k in range(1, len(a))) for a in sentinels for b in sentinels
    )


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: groups of 8 hex digits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def clamp(x: Column, most: Column) -> Column:
    return F.greatest(F.lit(0), F.least(x, most)).cast("int")


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentinels: tuple[str, str, str] = SENTINELS,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
    seed: int = 1,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of `docs`: id, n (units), form, prefix, middle, suffix and output.

    Two units drawn from the id's SHA-256 cut the text into prefix, middle and suffix. Output is the text itself
    (form plain), or sentinels and parts in the order prefix, suffix, middle (psm) or suffix, prefix, middle (spm);
    `restored` undoes it. Parts are null in plain rows.

    Units are found by `regexp_extract_all`, parts made by `slice` and `array_join`, in blocks of a text, so that a
    text of any length has one block's units in memory at a time. Nothing is shuffled.

    Null text counts as empty, and an empty text is plain, as is one that contains a sentinel. A null id draws as an
    empty one. Rows that repeat give equal rows; an empty table gives an empty result. Further columns of `docs` are
    ignored, whatever their names.
    """
    if overlap(sentinels):
        raise ValueError("sentinels that overlap can't be told apart in a text")
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block}}}[A-Za-z]*"), F.lit(0))

    def units(text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))

    def total(sizes: Column) -> Column:
        return F.aggregate(sizes, F.lit(0).cast("long"), lambda sum_, x: sum_ + x)

    def cut(text: Column, index: Column) -> Column:
        """Units of a block by part: those before the smaller cut, up to the larger, after it."""
        before = total(F.slice("sizes", F.lit(1), index))

        def parts(found: Column) -> Column:
            size = F.size(found)
            a, b = clamp(F.col("low") - before, size), clamp(F.col("high") - before, size)
            taken = {"prefix": (F.lit(1), a), "middle": (a + 1, b - a), "suffix": (b + 1, size - b)}
            return F.struct(*[F.array_join(F.slice(found, first, count), "").alias(name) for name, (first, count) in taken.items()])

        return F.transform(F.array(units(text)), parts)[0]

    h1, h2, h3, h4 = draws(F.col("id"), seed)
    marked = F.lit(False)
    for sentinel in sentinels:
        marked = marked | F.contains("text", F.lit(sentinel))
    rows = (
        pick(docs, id=id_col, text=text_col)
        .select("id", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("blocks", blocks)
        .withColumn("sizes", F.transform("blocks", lambda b: F.size(units(b)).cast("long")))
        .withColumn("n", total(F.col("sizes")))
        .withColumn("low", F.least(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)))
        .withColumn("high", F.greatest(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)))
        .withColumn("form", F.when((F.col("text") == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm"))
        .withColumn("cuts", F.when(F.col("form") != "plain", F.transform("blocks", cut)))
    )
    rows = rows.select("id", "text", "n", "form", *[F.array_join(F.col("cuts")[part], "").alias(part) for part in ("prefix", "middle", "suffix")])
    p, s, m = map(F.lit, sentinels)
    arranged = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(
        F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle")
    )
    return rows.select("id", "n", "form", "prefix", "middle", "suffix", F.coalesce(arranged, "text").alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of this form was made of: its parts are found by their sentinels."""
    parts = F.split(output, "|".join("".join(f"\\x{{{ord(c):x}}}" for c in s) for s in sentinels), -1)
    psm = F.concat(F.element_at(parts, 2), F.element_at(parts, 4), F.element_at(parts, 3))
    spm = F.concat(F.element_at(parts, 3), F.element_at(parts, 4), F.element_at(parts, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


ORACLE = r"""
with cut as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units,
    sha256('1:' || coalesce(doc_id::varchar, '')) as digest
  from documents
), drawn as (
  select *, len(units)::bigint as n, ('0x' || digest[1:8])::bigint as h1, ('0x' || digest[9:16])::bigint as h2,
    ('0x' || digest[17:24])::bigint as h3, ('0x' || digest[25:32])::bigint as h4
  from cut
), formed as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as low, greatest(h1 % (n + 1), h2 % (n + 1)) as high,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from drawn
), parted as (
  select *, array_to_string(units[1:low], '') as prefix, array_to_string(units[low + 1:high], '') as middle,
    array_to_string(units[high + 1:n], '') as suffix
  from formed
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars,
  case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else text end) as output_sha256,
  sha256(text) as restored_sha256
from parted
"""

"""Bundles of terms and blocks: TBX and JSON term files, block bundles, and the sessions in which files came in."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TERM = "path string, concept_id string, domain string, definition string, locale string, term string, status string, part_of_speech string, note string"
FIELDS = [c.split()[0] for c in TERM.split(", ")]
#: Administrative statuses of terms in TBX, and the library's names of them.
TBX_STATUS = {
    "preferred": "preferred",
    "standardized": "preferred",
    "admitted": "admitted",
    "approved": "approved",
    "deprecated": "deprecated",
    "superseded": "deprecated",
    "forbidden": "forbidden",
    "prohibited": "forbidden",
    "proposed": "proposed",
}


def _name(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _own(element: ElementTree.Element, *names: str, through: tuple[str, ...] = ()) -> list[ElementTree.Element]:
    """Children of these names, also those inside groups of the names `through`."""
    found = []
    for child in element:
        if _name(child) in names:
            found.append(child)
        elif _name(child) in through:
            found += _own(child, *names, through=through)
    return found


def tbx_terms(text: str, default_status: str = "approved", prefix: str = "tbx") -> list[dict]:
    """Terms of a TBX document of either dialect (tbx with concepts, martif with term entries)."""
    root = ElementTree.fromstring(text)
    if _name(root) not in ("tbx", "martif"):
        raise ValueError(f"not TBX: the root is {_name(root)}")
    rows, number = [], 0
    for entry in (e for e in root.iter() if _name(e) in ("conceptEntry", "termEntry")):
        said = {(d.get("type") or "").strip().lower(): (d.text or "").strip() for d in _own(entry, "descrip", through=("descripGrp",))}
        terms = []
        for section in _own(entry, "langSec", "langSet"):
            locale = next((v for k, v in section.attrib.items() if k.rpartition("}")[2] == "lang"), "").strip()
            for unit in _own(section, "termSec", "tig", "ntig"):
                spelled = [t for t in ((e.text or "").strip() for e in _own(unit, "term", through=("termGrp",))) if t]
                notes = {(n.get("type") or "").strip().lower(): (n.text or "").strip() for n in _own(unit, "termNote", through=("termGrp",))}

                def noted(*kinds: str) -> str | None:
                    return next((notes[k] for k in kinds if notes.get(k)), None)

                status = (noted("administrativestatus", "normativeauthorization", "status") or "").lower().removesuffix("-admn-sts").removesuffix("term")
                if spelled:
                    terms.append(
                        {
                            "locale": locale,
                            "term": spelled[0],
                            "status": TBX_STATUS.get(status, default_status),
                            "part_of_speech": noted("partofspeech", "grammaticalcategory"),
                            "note": noted("usagenote", "note", "geographicalusage"),
                        }
                    )
        if terms:
            number += 1
            head = {"concept_id": entry.get("id") or f"{prefix}-{number}", "domain": said.get("subjectfield"), "definition": said.get("definition")}
            rows += [head | t for t in terms]
    return rows


def json_terms(text: str, prefix: str = "json") -> list[dict]:
    """Terms of a JSON store: {"concepts": [{"id", "domain", "definition", "terms": [{"text", "locale", "status", ...}]}]}."""
    rows = []
    for number, concept in enumerate(json.loads(text).get("concepts") or [], 1):
        head = {"concept_id": concept.get("id") or f"{prefix}-{number}", "domain": concept.get("domain"), "definition": concept.get("definition")}
        for term in concept.get("terms") or []:
            rows.append(head | {"term": term.get("text"), "locale": term.get("locale"), "status": term.get("status"), "part_of_speech": term.get("part_of_speech"), "note": term.get("note")})
    return rows


def read_terms(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Terms of all files of a path, TERM; kind: tbx or json. Files are read where Spark reads them, each in one task."""
    parse = {"tbx": tbx_terms, "json": json_terms}[kind]

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, text in zip(batch["path"], batch["text"], strict=True):
                yield pd.DataFrame([{"path": name} | r for r in parse(text)], columns=FIELDS)

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.mapInPandas(parsed, TERM)


def json_store(terms: DataFrame, name: str) -> DataFrame:
    """`content` of one JSON store per path, with its concepts in order of id."""

    def drop_nulls(**fields: Column) -> Column:
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    term = drop_nulls(text=F.col("term"), locale=F.col("locale"), status=F.col("status"), part_of_speech=F.col("part_of_speech"), note=F.col("note"))
    concepts = terms.groupBy("path", "concept_id").agg(F.first("domain").alias("domain"), F.first("definition").alias("definition"), F.array_sort(F.collect_list(term)).alias("terms"))
    concept = drop_nulls(id=F.col("concept_id"), domain=F.col("domain"), definition=F.col("definition"), terms=F.col("terms"))
    whole = concepts.groupBy("path").agg(F.array_sort(F.collect_list(concept)).alias("concepts"))
    return whole.select("path", F.to_json(F.struct(F.lit(name).alias("name"), F.lit("1.0").alias("version"), "concepts")).alias("content"))


def tbx_store(terms: DataFrame) -> DataFrame:
    """`content` of one TBX document per path."""

    @F.pandas_udf("string")
    def written(stores: pd.Series) -> pd.Series:
        def note(kind: str, value: str | None) -> str:
            return f"<termNote type={quoteattr(kind)}>{escape(value)}</termNote>" if value else ""

        def descrip(kind: str, value: str | None) -> str:
            return f"<descrip type={quoteattr(kind)}>{escape(value)}</descrip>" if value else ""

        out = []
        for store in stores:
            lines = ['<?xml version="1.0" encoding="UTF-8"?>', '<tbx xmlns="urn:iso:std:iso:30042:ed-2" type="TBX-Basic" style="dca" xml:lang="en"><text><body>']
            for concept in json.loads(store)["concepts"]:
                lines.append(f"<conceptEntry id={quoteattr(concept['id'])}>{descrip('subjectField', concept.get('domain'))}{descrip('definition', concept.get('definition'))}")
                for locale in sorted({t.get("locale") or "" for t in concept["terms"]}):
                    secs = [
                        f"<termSec><term>{escape(t['text'])}</term>{note('administrativeStatus', t.get('status') and t['status'] + 'Term-admn-sts')}{note('partOfSpeech', t.get('part_of_speech'))}{note('usageNote', t.get('note'))}</termSec>"
                        for t in concept["terms"]
                        if (t.get("locale") or "") == locale
                    ]
                    lines.append(f"<langSec xml:lang={quoteattr(locale)}>{''.join(secs)}</langSec>")
                lines.append("</conceptEntry>")
            out.append("\n".join([*lines, "</body></text></tbx>", ""]))
        return pd.Series(out)

    return json_store(terms, "terms").select("path", written("content").alias("content"))


def stable_entry_ids(entries: DataFrame, parts: list[str], prefix: str) -> DataFrame:
    """Entries with `entry_id`: what they have, else one that follows from `parts`, the same at each import."""
    content = F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 32)
    return entries.withColumn("entry_id", F.coalesce(F.nullif("entry_id", F.lit("")), F.concat(F.lit(f"{prefix}-"), content)))


def new_sessions(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """Files (path, content) with `file_hash`, the latest `session_id` in which the same bytes came in before, and `fresh`.

    sessions: session_id, file_hash, imported_at. Of files of equal bytes the first by path is fresh, if no session had it.
    """
    hashed = files.withColumn("file_hash", F.sha2("content", 256))
    latest = sessions.groupBy("file_hash").agg(F.max_by("session_id", "imported_at").alias("session_id"))
    first = F.row_number().over(Window.partitionBy("file_hash").orderBy("path")) == 1
    return hashed.join(latest, "file_hash", "left").withColumn("fresh", F.col("session_id").isNull() & first)

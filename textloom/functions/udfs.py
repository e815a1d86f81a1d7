"""Arrow-batched functions for what Spark SQL has no expression for."""

from __future__ import annotations

import re
import unicodedata
from xml.parsers import expat

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: HTML or XML tags, braces, percent and template placeholders.
TAGS = (r"<[^>]+>", r"\{[^}]+\}", r"%[sdfoexXbBhHtT%]+", r"\$\{[^}]+\}")

# Types as objects: workers, which import this module without a session, can't parse type strings.
TAG = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("text", StringType())])
PROTECTED = StructType([StructField("text", StringType()), StructField("tags", ArrayType(StringType()))])


def find_tags(text: str | None) -> list[dict]:
    """Tags with code-point offsets, by start; the same place and text counts once."""
    found = {(m.start(), m.end(), m.group()) for p in TAGS for m in re.finditer(p, text or "")}
    return [{"start": a, "end": b, "text": t} for a, b, t in sorted(found)]


@F.pandas_udf(StringType())
def normalise(texts: pd.Series) -> pd.Series:
    """NFC, then white space collapsed and trimmed."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).split()))


@F.pandas_udf(StringType())
def title_each(texts: pd.Series) -> pd.Series:
    """Every letter in title case, one character for one (never longer)."""
    return texts.map(lambda t: None if t is None else "".join(c.title() if len(c.title()) == 1 else c for c in t))


@F.pandas_udf(ArrayType(TAG))
def tags(texts: pd.Series) -> pd.Series:
    return texts.map(find_tags)


@F.pandas_udf(PROTECTED)
def protect_tags(texts: pd.Series) -> pd.DataFrame:
    """Tags that don't overlap replaced by {1}, {2}, ...; and the tags in that order."""
    out = []
    for text in texts:
        pieces, held, at = [], [], 0
        for tag in find_tags(text):
            if tag["start"] >= at:
                held.append(tag["text"])
                pieces += [text[at : tag["start"]], f"{{{len(held)}}}"]
                at = tag["end"]
        out.append({"text": None if text is None else "".join([*pieces, text[at:]]), "tags": held})
    return pd.DataFrame(out, columns=["text", "tags"])


@F.pandas_udf(StringType())
def restore_tags(texts: pd.Series, held: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else re.sub(r"\{(\d+)\}", lambda m: h[int(m[1]) - 1] if 0 < int(m[1]) <= len(h) else m[0], t) for t, h in zip(texts, held, strict=True)])


@F.pandas_udf(StringType())
def xml_error(texts: pd.Series) -> pd.Series:
    """Why a text isn't well-formed inside a root element; null where it is, or is blank."""

    def check(text: str | None) -> str | None:
        if text is None or not text.strip():
            return None
        try:
            expat.ParserCreate().Parse(f"<r>{text}</r>", True)
        except expat.ExpatError as error:
            return expat.errors.messages[error.code]
        return None

    return texts.map(check)

"""ICU messages: which placeholders a message has, read by its nested grammar."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

#: Argument types that choose between sub-messages.
PICKERS = ("plural", "select", "selectordinal")
#: Text of a message: a quoted span (an apostrophe before syntax, up to the next single one), a doubled or plain apostrophe.
TEXT = re.compile(r"(?:''|'[{}#|](?:[^']|'')*+'?|'|[^'{}#])*+")
HEAD = re.compile(r"\{([^,}]*+)(?:(\})|,([^,}]*+)([,}]))")
#: Between branches: the picker's end, or a branch's key word and opening brace.
BRANCH = re.compile(r"[ \t\n\r]*+(?:(\})|([^{} \t]++)[ \t\n\r]*+\{)")
OFFSET = re.compile(r"[ \t\n\r]*+offset:([^ \t\n\r]*+)")

# A type as object: workers, which import this module without a session, can't parse type strings.
COUNTED = StructType([StructField("token", StringType()), StructField("n", IntegerType())])
TOKENS = StructType(
    [
        StructField("picker", BooleanType()),
        StructField("frame", ArrayType(COUNTED)),
        StructField("inner", ArrayType(StringType())),
    ]
)


def style_end(message: str, at: int) -> int:
    """Where the style of an argument ends: its closing brace, nested ones stepped over, or the end."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(message, at):
        depth += 1 if m[0] == "{" else -1
        if depth < 0:
            return m.start()
    return len(message)


def tokens_of(message: str) -> dict | None:
    """Tokens of a message outside its sub-messages (counted) and inside (as a set); None where it isn't well-formed."""
    frame: Counter[str] = Counter()
    inner: set[str] = set()
    open_, picker, in_text, at = 0, False, True, 0

    def add(token: str) -> None:
        if open_:
            inner.add(token)
        else:
            frame[token] += 1

    while True:
        if not in_text:
            branch = BRANCH.match(message, at)
            if branch is None or (branch[2] is not None and not branch[2].strip()):
                return None
            at, in_text = branch.end(), True
            open_ -= branch[1] is not None
            continue
        at = TEXT.match(message, at).end()
        if at == len(message):
            break
        if message[at] == "#":
            if open_:
                add("#")
            at += 1
        elif message[at] == "}":
            if not open_:
                return None
            at, in_text = at + 1, False
        else:
            head = HEAD.match(message, at)
            if head is None:
                return None
            name, at = head[1].strip(), head.end()
            kind = None if head[3] is None else head[3].strip()
            if kind is None:
                add(f"{{{name}}}")
            elif kind.lower() == "choice":
                return None
            elif kind.lower() in PICKERS:
                if head[4] != ",":
                    return None
                offset = OFFSET.match(message, at) if kind.lower() != "select" else None
                at = offset.end() if offset else at
                shown = f", offset:{offset[1]}" if offset and offset[1] else ""
                add(f"{{{name}, {kind.lower()}{shown}}}")
                open_, picker, in_text = open_ + 1, True, False
            elif head[4] == "}":
                add(f"{{{name}, {kind}}}")
            else:
                end = style_end(message, at)
                add(f"{{{name}, {kind}, {message[at:end].strip()}}}")
                at = min(end + 1, len(message))
    if open_:
        return None
    return {"picker": picker, "frame": [{"token": t, "n": n} for t, n in sorted(frame.items())], "inner": sorted(inner)}


@F.pandas_udf(TOKENS)
def _tokens(messages: pd.Series) -> pd.DataFrame:
    nothing = {"picker": None, "frame": None, "inner": None}
    return pd.DataFrame([nothing if m is None else tokens_of(m) or nothing for m in messages], columns=list(nothing))


def tokens(message: Column, picking: Column) -> Column:
    """Tokens of messages where `picking` holds; elsewhere, and where a message isn't well-formed, all fields are null."""
    return _tokens(F.when(picking, message))


def may_pick(message: Column) -> Column:
    """Whether a message may have a picker: all have their name in them. Others need no parsing."""
    return F.coalesce(F.lower(message).rlike("plural|select"), F.lit(False))

"""Text expressions. All are Spark SQL functions, so they stay in generated code.

Offsets and lengths are code points. Java's `(?U)` makes `\\s` and `\\b` follow Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s"
#: Words are runs without white space; private-use characters (inline-code markers) separate words, too.
WORD = r"(?U)[^\s\x{E000}-\x{F8FF}]+"

#: The placeholder forms that a translation must keep.
PLACEHOLDER = r"\{\{[^{}]+\}\}|\$\{[^{}]+\}|%\([^)]+\)[a-zA-Z]|%\d+\$[a-zA-Z]|%[sdifeEgGxXobpqv@%]|\{[^{}]+\}|</?[0-9]+>"

ZERO_WIDTH = r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]"

ACCENTS_FROM = "AEIOUYaeiouyCNScnsDLTZdltzGHJKRWghjkrw"
ACCENTS_TO = "ÅÉÎÖÛÝåéîöûýÇÑŠçñšĎĹŤŽďĺťžĜĤĴĶŘŴĝĥĵķřŵ"


def trim_space(text: Column) -> Column:
    """Without Unicode white space at both ends (`trim` takes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(trim_space(text), r"(?U)\s+", " ")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def count_chars(text: Column, spaces: bool = True) -> Column:
    return F.coalesce(F.char_length(text if spaces else F.regexp_replace(text, SPACE, "")), F.lit(0))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def similarity_percent(a: Column, b: Column) -> Column:
    """Whole percent of agreement, cut off, not rounded."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(100)).otherwise(((longest - F.levenshtein(a, b)) * 100 / longest).cast("int"))


def length_window(length: Column, least: float) -> tuple[Column, Column]:
    """Lengths that a text may have so that `edit_ratio` can still reach `least`; all, if it is not in (0, 1]."""
    if not 0 < least <= 1:
        return F.lit(0), F.lit((1 << 31) - 1)
    return F.floor(length * F.lit(least) + F.lit(1e-9)), F.ceil(length / F.lit(least) - F.lit(1e-9))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.char_length(text) / 4)


def truncate(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def slug(text: Column) -> Column:
    """Lower case without separators; equal slugs name one channel."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def snippet(text: Column, start: Column, end: Column, around: int = 48) -> Column:
    """The match with `around` characters on each side, white space collapsed, dots where text was cut."""
    first = F.greatest(start - around, F.lit(0))
    last = F.least(end + around, F.char_length(text))
    cut = F.regexp_replace(F.substring(text, first + 1, last - first), r"(?U)\s+", " ")
    return F.concat(F.when(first > 0, "…").otherwise(""), trim_space(cut), F.when(last < F.char_length(text), "…").otherwise(""))


def encoding(text: Column) -> Column:
    """ascii, utf-8 or unknown."""
    return (
        F.when(F.octet_length(text) == F.char_length(text), "ascii").when(F.is_valid_utf8(text), "utf-8").otherwise("unknown")
    )


def placeholders(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))


def is_word(token: Column) -> Column:
    """Whether a token has a letter or a digit: a dash that repeats is no doubled word."""
    return token.rlike(r"[\p{L}\p{N}]")


def has_doubled_word(text: Column, exceptions: tuple[str, ...] = ()) -> Column:
    """Whether a word follows itself, in whatever case. `exceptions`: words that a language may double."""
    words = F.split(F.lower(text), r"[ \n\t]+")
    allowed = [w.strip().lower() for w in exceptions]

    def doubled(a: Column, b: Column) -> Column:
        return (a == b) & is_word(a) & (~a.isin(allowed) if allowed else F.lit(True))

    return F.exists(F.zip_with(words, F.slice(words, 2, 1 << 30), doubled), lambda same: F.coalesce(same, F.lit(False)))


def has_leading_space(text: Column) -> Column:
    return text.rlike(r"(?U)\A\s")


def has_trailing_space(text: Column) -> Column:
    """White space at the end, but for one line break, which ends a text as it ends a line."""
    return F.regexp_replace(text, r"\r?\n\z", "").rlike(r"(?U)\s\z")


def has_control_char(text: Column) -> Column:
    return text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]")


def pseudo(text: Column, prefix: str = "[", suffix: str = "]", expand: int = 0) -> Column:
    """Accented letters outside braces, `expand` percent longer, between prefix and suffix."""
    pieces = F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}|[^{}]+|[{}]"), F.lit(0))
    changed = F.transform(pieces, lambda p: F.when(p.startswith("{"), p).otherwise(F.translate(p, ACCENTS_FROM, ACCENTS_TO)))
    pad = F.repeat(F.lit("~"), F.ceil(F.char_length(text) * expand / 100).cast("int"))
    return F.concat(F.lit(prefix), F.array_join(changed, ""), pad, F.lit(suffix))


def correct_space(
    text: Column,
    source: Column | None = None,
    collapse: bool = True,
    trim: bool = True,
    zero_width: bool = True,
) -> Column:
    """Collapses runs of space, drops zero-width characters, trims; with `source`, its edge space is taken over."""
    if zero_width:
        text = F.regexp_replace(text, ZERO_WIDTH, "")
    if collapse:
        text = F.regexp_replace(text, "[ \t]{2,}", " ")
    if trim or source is not None:
        text = trim_space(text)
    if source is not None:
        text = F.concat(F.regexp_extract(source, r"(?U)^\s*", 0), text, F.regexp_extract(source, r"(?U)(?<=\S)\s*$", 0))
    return text


def search_replace(text: Column, pairs: list[tuple[str, str]], regex: bool = False, ignore_case: bool = False) -> Column:
    """Ordered replacements, literal or by regular expression."""
    for old, new in pairs:
        if regex:
            text = F.regexp_replace(text, ("(?i)" if ignore_case else "") + old, new)
        elif ignore_case:
            text = F.regexp_replace(text, "(?i)\\Q" + old.replace("\\E", "\\E\\\\E\\Q") + "\\E", new.replace("\\", "\\\\").replace("$", "\\$"))
        else:
            text = F.replace(text, F.lit(old), F.lit(new))
    return text


def timecode_ms(text: Column) -> Column:
    """Milliseconds of HH:MM:SS,mmm or [HH:]MM:SS.mmm."""
    pattern = r"^(?:(\d+):)?(\d{2}):(\d{2})[,.](\d{3})$"
    part = [F.regexp_extract(text, pattern, k) for k in range(1, 5)]
    hours = F.when(part[0] == "", 0).otherwise(F.try_to_number(part[0], F.lit("999999")).cast("long"))
    rest = [F.when(p == "", None).otherwise(p).cast("long") for p in part[1:]]
    return ((hours * 60 + rest[0]) * 60 + rest[1]) * 1000 + rest[2]


def format_timecode(ms: Column, mark: str = ",") -> Column:
    return F.format_string(
        f"%02d:%02d:%02d{mark}%03d", F.expr("0L") + F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000
    )


def variant_key(locale: Column, tone: Column, channel: Column) -> Column:
    return F.concat_ws(
        ";", locale, F.when(tone != "", F.concat(F.lit("tone="), tone)), F.when(channel != "", F.concat(F.lit("channel="), channel))
    )

"""Formats with a syntax of their own: a small parser for one file, run over tables of files.

Each parser turns the content of one file into (block_id, text, target) rows; `parse_blocks` maps it over a
DataFrame of (path, content), so files are the unit of distribution, as with Spark's own whole-file readers.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

Row = tuple[str, str, str | None]
BLOCK = "path string, seq int, block_id string, text string, target string"


def json_strings(content: str) -> Iterator[Row]:
    def walk(value: object, path: str) -> Iterator[Row]:
        if isinstance(value, dict):
            for key, inner in value.items():
                yield from walk(inner, f"{path}.{key}" if path else key)
        elif isinstance(value, list):
            for k, inner in enumerate(value):
                yield from walk(inner, f"{path}[{k}]")
        elif isinstance(value, str):
            yield path, value, None

    yield from walk(json.loads(content), "")


def arb(content: str) -> Iterator[Row]:
    """Messages of an application resource bundle: keys that don't start with @."""
    for key, value in json.loads(content).items():
        if not key.startswith("@") and isinstance(value, str):
            yield key, value, None


def xcstrings(content: str) -> Iterator[Row]:
    """String catalogue: a row per key and localisation, named key/locale."""
    catalogue = json.loads(content)
    for key, entry in catalogue.get("strings", {}).items():
        for locale, unit in (entry.get("localizations") or {}).items():
            value = (unit.get("stringUnit") or {}).get("value")
            if value is not None:
                yield f"{key}/{locale}", key, value


def design_tokens(content: str) -> Iterator[Row]:
    for path, text, _ in json_strings(content):
        if path.endswith("$description"):
            yield path, text, None


def docling(content: str) -> Iterator[Row]:
    for k, item in enumerate(json.loads(content).get("texts", [])):
        if item.get("text"):
            yield item.get("self_ref") or f"#/texts/{k}", item["text"], item.get("label")


ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}


def properties(content: str) -> Iterator[Row]:
    """Java properties: continuation lines, =, : or space after the key, \\uXXXX escapes."""

    def plain(text: str) -> str:
        return re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else ESCAPES.get(m[2], m[2]), text, flags=re.S)

    joined = re.sub(r"(?<!\\)((?:\\\\)*)\\\r?\n[ \t\f]*", r"\1", content)
    for line in joined.splitlines():
        line = line.lstrip(" \t\f")
        if line and line[0] not in "#!":
            match = re.match(r"((?:\\.|[^\\=: \t\f])*)[ \t\f]*[=:]?[ \t\f]*(.*)", line, re.S)
            yield plain(match[1]), plain(match[2]), None


def apple_strings(content: str) -> Iterator[Row]:
    for key, value in re.findall(r'"((?:[^"\\]|\\.)*)"\s*=\s*"((?:[^"\\]|\\.)*)"\s*;', re.sub(r"(?s)/\*.*?\*/", "", content)):
        yield key, re.sub(r'\\(["\\])', r"\1", value).replace("\\n", "\n"), None


def po(content: str) -> Iterator[Row]:
    """Messages of a gettext catalogue; the header (empty msgid) isn't one."""

    def unquote(text: str) -> str:
        return "".join(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), part) for part in re.findall(r'"((?:[^"\\]|\\.)*)"', text))

    for entry in re.split(r"\n\s*\n", content.replace("\r", "")):
        fields: dict[str, str] = {}
        name = None
        for line in entry.split("\n"):
            match = re.match(r'(msgctxt|msgid|msgid_plural|msgstr(?:\[\d+\])?)\s+(".*")', line)
            if match:
                name = match[1]
                fields[name] = match[2]
            elif name and line.startswith('"'):
                fields[name] += line
        source = unquote(fields.get("msgid", ""))
        if source:
            context = unquote(fields.get("msgctxt", ""))
            target = unquote(fields.get("msgstr", fields.get("msgstr[0]", "")))
            yield f"{context}\x04{source}" if context else source, source, target


def mo(content: bytes) -> Iterator[Row]:
    """Compiled gettext catalogue."""
    order = "<" if content[:4] == b"\xde\x12\x04\x95" else ">"
    count, originals, translations = struct.unpack(order + "3I", content[8:20])

    def text(table: int, k: int) -> str:
        size, at = struct.unpack(order + "2I", content[table + 8 * k : table + 8 * k + 8])
        return content[at : at + size].decode()

    for k in range(count):
        source = text(originals, k)
        if source:
            yield source, source.split("\x04")[-1].split("\0")[0], text(translations, k).split("\0")[0]


def yaml_scalars(content: str) -> Iterator[Row]:
    """Scalars of block-style YAML (maps, lists, quoted, literal and folded scalars); anchors and flow style aren't read."""
    stack: list[tuple[int, str]] = []
    lines = content.splitlines()
    k = 0
    while k < len(lines):
        line = lines[k]
        k += 1
        match = re.match(r"(\s*)((?:- )*)(?:([^\s#:'\"][^:]*|'[^']*'|\"[^\"]*\")\s*:(?:\s+|$))?(.*)$", line)
        if not line.strip() or line.lstrip().startswith("#") or line.strip() == "---":
            continue
        indent = len(match[1]) + len(match[2])
        while stack and stack[-1][0] >= indent:
            stack.pop()
        key, value = (match[3] or "").strip("'\""), match[4].strip()
        path = ".".join([*(p for _, p in stack), *([key] if key else [])])
        if value[:1] in ("|", ">") and re.fullmatch(r"[|>][+-]?", value):
            body = []
            while k < len(lines) and (not lines[k].strip() or len(lines[k]) - len(lines[k].lstrip()) > len(match[1])):
                body.append(lines[k].strip())
                k += 1
            yield path, ("\n" if value[0] == "|" else " ").join(body).strip(), None
        elif not value:
            stack.append((indent, key))
        else:
            quoted = re.fullmatch(r"'((?:[^']|'')*)'|\"((?:[^\"\\]|\\.)*)\"", value)
            text = (quoted[1] or "").replace("''", "'") if quoted and quoted[1] is not None else re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), quoted[2]) if quoted else re.split(r"\s#", value)[0]
            yield path, text, None


def markdown(content: str) -> Iterator[Row]:
    """Headings, paragraphs, list items, quotes and table rows; code fences and front matter aren't content."""
    content = re.sub(r"(?s)\A---\n.*?\n---\n", "", content.replace("\r", ""))
    content = re.sub(r"(?ms)^(```|~~~).*?^\1[^\n]*$", "\n", content)
    k = 0
    for chunk in re.split(r"\n\s*\n", content):
        paragraph: list[str] = []
        for line in [*chunk.split("\n"), ""]:
            match = re.match(r"\s{0,3}(#{1,6}\s+|[-*+]\s+|\d+[.)]\s+|>\s?|\|)(.*)", line)
            if (match or not line.strip()) and paragraph:
                yield f"md{k}", " ".join(paragraph), "paragraph"
                paragraph, k = [], k + 1
            if match:
                text = match[2].strip().rstrip("#").strip(" |")
                if text and not re.fullmatch(r"[-:| ]+", text):
                    yield f"md{k}", text, "heading" if match[1][0] == "#" else "item"
                    k += 1
            elif line.strip():
                paragraph.append(line.strip())


INLINE = {"b", "strong", "i", "em", "u", "s", "a", "span", "code", "sub", "sup", "br", "small", "mark", "img"}
HIDDEN = {"script", "style", "noscript", "template"}


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[Row] = []
        self.text: list[str] = []
        self.path: list[str] = []
        self.hidden = 0

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.text)).strip()
        if text:
            role = next((t for t in reversed(self.path) if t not in INLINE), "body")
            self.rows.append((f"{role}{len(self.rows)}", text, role))
        self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        if tag not in INLINE:
            self.flush()
        elif tag == "br":
            self.text.append(" ")
        if tag not in ("br", "img", "meta", "link", "input", "hr"):
            self.path.append(tag)
        for name, value in attrs:
            if name in ("alt", "title", "placeholder", "aria-label") and value:
                self.rows.append((f"@{name}{len(self.rows)}", value, f"@{name}"))

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag not in INLINE:
            self.flush()
        if tag in self.path:
            while self.path.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)


def html(content: str) -> Iterator[Row]:
    """Texts of block elements (with their role as target) and of translatable attributes."""
    parser = _Html()
    parser.feed(content)
    parser.close()
    parser.flush()
    yield from parser.rows


def xml_texts(content: str) -> Iterator[Row]:
    root = ElementTree.fromstring(content)

    def walk(node: ElementTree.Element, path: str) -> Iterator[Row]:
        name = f"{path}/{node.tag.rsplit('}', 1)[-1]}"
        if node.text and node.text.strip():
            yield name, node.text.strip(), None
        for child in node:
            yield from walk(child, name)
            if child.tail and child.tail.strip():
                yield name, child.tail.strip(), None

    yield from walk(root, "")


def _zip_parts(content: bytes, choose: Callable[[list[str]], list[str]]) -> Iterator[tuple[str, str]]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for name in choose(archive.namelist()):
            yield name, archive.read(name).decode("utf-8", "replace")


def office(content: bytes) -> Iterator[Row]:
    """Paragraphs of word-processor, slide and sheet parts (Office Open XML, OpenDocument)."""

    def parts(names: list[str]) -> list[str]:
        return sorted(n for n in names if re.fullmatch(r"word/(document|footnotes|header\d*|footer\d*)\.xml|ppt/slides/slide\d+\.xml|xl/sharedStrings\.xml|content\.xml", n))

    for name, xml in _zip_parts(content, parts):
        for k, node in enumerate(e for e in ElementTree.fromstring(xml).iter() if e.tag.rsplit("}", 1)[-1] in ("p", "h", "si")):
            text = "".join(node.itertext()).strip()
            if text:
                yield f"{name}#{k}", text, None


def epub(content: bytes) -> Iterator[Row]:
    """Texts of an e-book's pages in reading order."""

    def spine(names: list[str]) -> list[str]:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            package = next(n for n in names if n.endswith(".opf"))
            root = ElementTree.fromstring(archive.read(package))
        base = package.rpartition("/")[0]
        items = {e.get("id"): e.get("href") for e in root.iter() if e.tag.endswith("}item") or e.tag == "item"}
        order = [items[e.get("idref")] for e in root.iter() if (e.tag.endswith("}itemref") or e.tag == "itemref") and e.get("idref") in items]
        return [f"{base}/{h}" if base else h for h in order]

    for name, page in _zip_parts(content, spine):
        for block, text, role in html(page):
            yield f"{name}#{block}", text, role


def archive(content: bytes) -> Iterator[Row]:
    """Blocks of the entries of a ZIP file whose format is known by their extension."""
    with zipfile.ZipFile(io.BytesIO(content)) as held:
        for name in held.namelist():
            kind = detect(name)
            if kind in PARSERS and kind != "archive":
                raw = held.read(name)
                for block, text, target in PARSERS[kind](raw if kind in BINARY else raw.decode("utf-8", "replace")):
                    yield f"{name}!{block}", text, target


def message_format(pattern: str) -> Iterator[Row]:
    """Branches of the outer plural and select arguments of an ICU message, else the message itself."""

    def close(text: str, at: int) -> int:
        depth, quoted = 0, False
        for k in range(at, len(text)):
            if text[k] == "'" and text[k + 1 : k + 2] in ("{", "}", "'") or quoted and text[k] == "'":
                quoted = not quoted
            elif not quoted:
                depth += {"{": 1, "}": -1}.get(text[k], 0)
                if depth == 0:
                    return k
        return len(text) - 1

    found, at = False, 0
    while (start := pattern.find("{", at)) >= 0:
        end = close(pattern, start)
        head = re.match(r"\s*(\w+)\s*,\s*(plural|select|selectordinal)\s*,", pattern[start + 1 : end])
        if head:
            found = True
            body, k = pattern[start + 1 + head.end() : end], 0
            while (branch := re.compile(r"\s*(=?[\w-]+)\s*\{").search(body, k)) is not None:
                stop = close(body, branch.end() - 1)
                yield f"{head[1]}.{head[2]}.{branch[1]}", body[branch.end() : stop], None
                k = stop + 1
        at = end + 1
    if not found:
        yield "message", pattern, None


EXTENSIONS = {
    ".json": "json", ".arb": "arb", ".xcstrings": "xcstrings", ".tokens.json": "design_tokens", ".properties": "properties",
    ".strings": "apple_strings", ".po": "po", ".pot": "po", ".mo": "mo", ".yaml": "yaml", ".yml": "yaml", ".md": "markdown",
    ".mdx": "markdown", ".html": "html", ".htm": "html", ".xml": "xml", ".docx": "office", ".pptx": "office", ".xlsx": "office",
    ".odt": "office", ".ods": "office", ".odp": "office", ".epub": "epub", ".zip": "archive",
}

PARSERS: dict[str, Callable[..., Iterator[Row]]] = {
    "json": json_strings, "arb": arb, "xcstrings": xcstrings, "design_tokens": design_tokens, "docling": docling,
    "properties": properties, "apple_strings": apple_strings, "po": po, "mo": mo, "yaml": yaml_scalars, "markdown": markdown,
    "html": html, "xml": xml_texts, "office": office, "epub": epub, "archive": archive, "message_format": message_format,
}

BINARY = {"mo", "office", "epub", "archive"}


def detect(name: str, head: bytes = b"") -> str | None:
    """Format by the longest known extension, else by the first bytes."""
    name = name.lower()
    for extension in sorted(EXTENSIONS, key=len, reverse=True):
        if name.endswith(extension):
            return EXTENSIONS[extension]
    head = head.lstrip(b"\xef\xbb\xbf \t\r\n")
    if head[:4] == b"PK\x03\x04":
        return "archive"
    if head[:4] in (b"\xde\x12\x04\x95", b"\x95\x04\x12\xde"):
        return "mo"
    return "json" if head[:1] in (b"{", b"[") else "html" if head[:5].lower() in (b"<!doc", b"<html") else "xml" if head[:1] == b"<" else None


def parse_blocks(files: DataFrame, kind: str) -> DataFrame:
    """Blocks of (path, content) rows of one format; a file that can't be read gives one row without text and block_id 'error: ...'."""
    parser = PARSERS[kind]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [(path, k, *row) for k, row in enumerate(parser(content))] if content is not None else []
                except Exception as error:  # noqa: BLE001  a bad file is reported, like Spark's corrupt records
                    rows.append((path, 0, f"error: {type(error).__name__}", None, str(error)[:200]))
            yield pd.DataFrame(rows, columns=["path", "seq", "block_id", "text", "target"])

    return files.select("path", "content").mapInPandas(parse, BLOCK)

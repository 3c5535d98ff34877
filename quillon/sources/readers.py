"""Files to rows: one reader per format, dispatch by extension, failures as rows."""

from __future__ import annotations

import csv
import io
import json
import mimetypes
import re
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import ExtractionError, IngestionError, InvalidInputError, NoTextFoundError, UnsupportedFileTypeError
from quillon.functions import text as tx
from quillon.operators import encodings

#: Extension to source type.
EXTENSIONS = {
    ".txt": "file_txt", ".md": "file_markdown", ".markdown": "file_markdown", ".pdf": "file_pdf", ".docx": "file_docx", ".csv": "file_csv", ".tsv": "file_csv", ".json": "file_json",
    ".jsonl": "file_jsonl", ".html": "file_html", ".htm": "file_html", ".xml": "file_xml",
}
ENCODINGS = ("utf-8", "cp1252", "latin-1")
TEXTUAL = ("file_txt", "file_markdown", "file_csv", "file_json", "file_jsonl", "file_html")


def source_type(path: Column) -> Column:
    """By the lower-cased extension; null for others."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv)), suffix)


def decode(data: bytes) -> str:
    """By byte order mark, else the first encoding that fits; line ends become LF before any offset is counted."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace").replace("\r\n", "\n").replace("\r", "\n")
    for name in ENCODINGS:
        try:
            return data.decode(name).replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace")


# ---------------------------------------------------------------- text statistics, as columns


def text_stats(t: Column) -> dict[str, Column]:
    lines = F.split(t, "\n", -1)
    count = lambda what: F.length(t) - F.length(F.replace(t, F.lit(what), F.lit("")))
    return {
        "char_count": F.length(t), "byte_count": F.octet_length(t), "line_count": F.size(lines), "empty_lines": F.size(F.filter(lines, lambda x: F.trim(x) == "")),
        "max_line_length": F.array_max(F.transform(lines, lambda x: F.length(x))), "spaces": count(" "), "tabs": count("\t"), "newlines": count("\n"),
        "has_nul": F.contains(t, F.lit("\x00")), "has_bom": F.startswith(t, F.lit("﻿")), "line_endings": tx.line_endings(t), "word_count": tx.white_words(t),
    }


# ---------------------------------------------------------------- formats that need a parser: bytes to (text, details)


def _markdown(data: bytes) -> tuple[str, dict]:
    body = decode(data)
    blocks = re.findall(r"^```(\w*)\n(.*?)^```", body, re.S | re.M)
    prose = re.sub(r"^```.*?^```[ \t]*$", "", body, flags=re.S | re.M)
    links = re.findall(r"(?<!!)\[([^\]]*)\]\(([^)\s]+)", prose)
    details = {
        "headings": [{"level": len(a), "text": b.strip()} for a, b in re.findall(r"^(#{1,6})[ \t]+(.+?)#*$", prose, re.M)], "code_blocks": len(blocks), "code_languages": sorted({a for a, _ in blocks if a}),
        "links": len(links), "images": len(re.findall(r"!\[", prose)), "list_items": len(re.findall(r"^[ \t]*(?:[-*+]|\d+\.)[ \t]", prose, re.M)), "tables": len(re.findall(r"^\|?[ \t:|-]*-{3,}[ \t:|-]*$", prose, re.M)),
        "has_front_matter": body.startswith("---\n"), "has_html": bool(re.search(r"<[a-zA-Z][^>]*>", prose)), "has_math": "$" in prose,
    }
    plain = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", body)
    plain = re.sub(r"^```.*$|^#{1,6}[ \t]+|^>[ \t]?|^[ \t]*[-*+][ \t]+|[*_`]{1,3}(?=\S)|(?<=\S)[*_`]{1,3}", "", plain, flags=re.M)
    return plain.strip(), details


class _Html(HTMLParser):
    """Structure and visible text of a page."""

    SEMANTIC = ("article", "aside", "footer", "header", "main", "nav", "section")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.tags: Counter = Counter()
        self.links: list[str] = []
        self.meta: dict[str, str] = {}
        self.headings: list[dict] = []
        self.title: str | None = None
        self.hidden = 0
        self.inside: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = dict(attrs)
        self.tags[tag] += 1
        if tag in ("script", "style"):
            self.hidden += 1
        if tag == "a" and own.get("href"):
            self.links.append(own["href"])
        if tag == "meta" and (own.get("name") or own.get("property")):
            self.meta[own.get("name") or own["property"]] = own.get("content") or ""
        if re.fullmatch("h[1-6]|title", tag):
            self.inside.append(tag)
            if tag != "title":
                self.headings.append({"level": int(tag[1]), "text": ""})

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if self.inside and self.inside[-1] == tag:
            self.inside.pop()
        if tag not in ("a", "b", "i", "em", "strong", "span", "code", "small", "sub", "sup", "u"):
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        self.parts.append(data)
        if self.inside:
            if self.inside[-1] == "title":
                self.title = (self.title or "") + data
            elif self.headings:
                self.headings[-1]["text"] += data


def parse_html(body: str) -> tuple[str, dict]:
    own = _Html()
    own.feed(body)
    own.close()
    lines = [x.strip() for x in "".join(own.parts).split("\n")]
    low = body.lower()
    details = {
        "title": (own.title or "").strip() or None, "meta": own.meta, "headings": own.headings, "links": len(own.links), "images": own.tags["img"], "scripts": own.tags["script"], "stylesheets": own.tags["style"] + own.tags["link"],
        "tables": own.tags["table"], "forms": own.tags["form"], "lists": own.tags["ul"] + own.tags["ol"], "has_doctype": "<!doctype" in low, "semantic": sorted(x for x in own.SEMANTIC if own.tags[x]),
        "version": "HTML5" if "<!doctype html>" in low else "XHTML" if "xhtml" in low else "HTML4" if "html 4" in low else "Unknown",
    }
    return "\n".join(x for x in lines if x), details


#: Core properties of a Word document that are read, by their names in its XML.
DOCX_PROPERTIES = ("title", "creator", "subject", "keywords", "created", "modified", "revision")


def _docx(data: bytes) -> tuple[str, dict]:
    """The paragraphs of the body, parted by blank lines; the cells of tables are details, as are properties, headings and styles."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
            core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else ()
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ExtractionError(f"no Word document: {e}") from e

    def written(p: ElementTree.Element) -> str:
        marks = {f"{w}tab": "\t", f"{w}br": "\n", f"{w}cr": "\n"}
        return "".join(x.text or "" if x.tag == f"{w}t" else marks.get(x.tag, "") for x in p.iter())

    body = root.find(f"{w}body")
    styled = []
    for p in body.findall(f"{w}p") if body is not None else ():
        style = p.find(f"{w}pPr/{w}pStyle")
        styled.append((style.get(f"{w}val") if style is not None else "Normal", written(p)))
    tables = [
        [["\n".join(written(p) for p in cell.findall(f"{w}p")).strip() for cell in row.findall(f"{w}tc")] for row in t.findall(f"{w}tr")]
        for t in (body.findall(f"{w}tbl") if body is not None else ())
    ]
    known = {x.tag.rsplit("}", 1)[-1]: x.text for x in core}
    properties = {("author" if k == "creator" else k): known[k] for k in DOCX_PROPERTIES if known.get(k)}
    details = {
        "title": properties.get("title"), "properties": properties, "paragraphs": len(styled), "styles": dict(Counter(x for x, _ in styled)),
        "headings": [{"style": x, "text": y} for x, y in styled if x.startswith("Heading")], "tables": tables, "sections": max(1, len(list(root.iter(f"{w}sectPr")))),
    }
    return "\n\n".join(y for _, y in styled if y.strip()), details


def string_leaves(value: object) -> object:
    """Only the strings of a JSON value, empty containers dropped."""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        out = {k: x for k, v in value.items() if (x := string_leaves(v)) not in (None, {}, [])}
        return out or None
    if isinstance(value, list):
        return [x for v in value if (x := string_leaves(v)) not in (None, {}, [])] or None
    return None


def depth(value: object, level: int = 0) -> int:
    """How deep containers nest; an empty one counts where it stands."""
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return max((depth(x, level + 1) for x in inner), default=level)


def xml_depth(node: ElementTree.Element) -> int:
    return 1 + max((xml_depth(x) for x in node), default=0)


def _json(data: bytes, field: str = "content") -> tuple[str, dict]:
    try:
        value = json.loads(decode(data))
    except json.JSONDecodeError as e:
        raise ExtractionError(f"line {e.lineno}, column {e.colno}: {e.msg}") from e
    own = string_leaves(value)
    keys = sorted(value) if isinstance(value, dict) else []
    found = own.get(field) if isinstance(own, dict) else None
    body = found if isinstance(found, str) else next((own[k] for k in tx.TEXT_KEYS if isinstance(own, dict) and isinstance(own.get(k), str)), "")
    return body, {"root": type(value).__name__, "keys": keys, "size": len(value) if isinstance(value, (dict, list)) else 1, "depth": depth(value)}


def _jsonl(data: bytes, field: str = "content") -> tuple[str, dict]:
    rows, errors = [], []
    for number, line in enumerate(decode(data).split("\n"), 1):
        if line.strip():
            try:
                rows.append(json.loads(line))
            except json.JSONDecodeError as e:
                errors.append({"line": number, "error": e.msg, "start": line[:100]})
    shapes = {tuple(sorted(r)) for r in rows if isinstance(r, dict)}
    body = "\n\n".join(r[k] for r in rows if isinstance(r, dict) for k in (field, "text") if isinstance(r.get(k), str) and r[k].strip() and (k == field or field not in r))
    return body, {"rows": len(rows), "errors": errors, "consistent": len(shapes) <= 1, "sample": rows[:10]}


def _csv(data: bytes, field: str = "content") -> tuple[str, dict]:
    body = decode(data)
    try:
        dialect: type[csv.Dialect] | csv.Dialect = csv.Sniffer().sniff(body[:1024], ",;\t|")
    except csv.Error:
        dialect = csv.excel
    rows = list(csv.DictReader(io.StringIO(body), dialect=dialect))
    names = list(rows[0]) if rows else []
    profile = {k: {"nulls": sum(not r[k] for r in rows), "distinct": len({r[k] for r in rows if r[k]}), "sample": [r[k] for r in rows[:5]]} for k in names if k}
    return "\n\n".join(r[field] for r in rows if (r.get(field) or "").strip()), {"rows": len(rows), "columns": profile, "delimiter": dialect.delimiter, "duplicates": len(rows) - len({tuple(map(str, r.items())) for r in rows})}


def _xml(data: bytes) -> tuple[str, dict]:
    body = decode(data)
    if "<!ENTITY" in body:
        raise ExtractionError("entity declarations aren't read")
    try:
        root = ElementTree.fromstring(body)
    except ElementTree.ParseError as e:
        raise ExtractionError(str(e)) from e
    text = " ".join(x.strip() for x in root.itertext() if x.strip())
    return text, {"root": root.tag, "attributes": dict(root.attrib), "tags": dict(Counter(x.tag for x in root.iter())), "depth": xml_depth(root), "has_declaration": body.lstrip().startswith("<?xml")}


def _pdf(data: bytes) -> tuple[str, dict]:
    raise ExtractionError("PDF needs a parser that isn't part of this engine")


PARSERS: dict[str, Callable[[bytes], tuple[str, dict]]] = {
    "file_txt": lambda d: (decode(d), {}), "file_markdown": _markdown, "file_pdf": _pdf, "file_docx": _docx, "file_csv": _csv, "file_json": _json, "file_jsonl": _jsonl,
    "file_html": lambda d: parse_html(decode(d)), "file_xml": _xml,
}
#: Readers to which the name of the field that holds the text matters.
BY_FIELD = ("file_csv", "file_json", "file_jsonl")
READ = (
    "path string, file_name string, extension string, mime_type string, modified timestamp, source_type string, text string, title string, author string, "
    "digest string, size long, details string, error_type string, error string"
)


def text_key(config: dict) -> str:
    """The field that holds the text in tables and JSON: the table's column if one is set, also for JSON; else the field of JSON; else content."""
    return (config.get("csv") or {}).get("text_column") or (config.get("json") or {}).get("text_field") or "content"


def _parse(batches: Iterator[pd.DataFrame], field: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples():
            name, kind, body, details, failure = r.path.rsplit("/", 1)[-1], r.source_type, None, {}, (None, None)
            try:
                if kind is None:
                    raise UnsupportedFileTypeError(f"no reader for {name}")
                body, details = PARSERS[kind](bytes(r.content), field) if kind in BY_FIELD else PARSERS[kind](bytes(r.content))
                if not body.strip():
                    raise NoTextFoundError(f"no text in {name}")
            except Exception as e:  # one bad file is one dead letter
                body, failure = None, (type(e).__name__, str(e)[:500])
            suffix = Path(name).suffix.lower()
            mime = mimetypes.guess_type(name)[0] or "application/octet-stream"
            title, author = details.get("title") or name, details.get("properties", {}).get("author")
            rows.append((r.path, name, suffix, mime, r.modified, kind, body, title, author, r.digest, r.length, json.dumps(details, sort_keys=True), *failure))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in READ.split(", ")])


def read_files(spark: SparkSession, path: str, pattern: str = "*", model: encodings.Model | None = None, field: str = "content") -> DataFrame:
    """One row per file, not below subfolders, with text or with error_type and error; digest is the SHA-256 of the bytes.

    source_type names the reader; details are what it found beside the text. A file system that Spark reads tells when a file was
    changed, not when it was made. field holds the text in tables and JSON (``text_key``). Files of many records that are too long for a
    row are read by ``split_files``.

    With a model of encodings, plain text, Markdown, tables, JSON and HTML are read as it finds them; XML declares its encoding.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(path)
    rows = files.select("path", "content", "length", F.col("modificationTime").alias("modified"), source_type(F.col("path")).alias("source_type"), F.sha2("content", 256).alias("digest"))
    if model:
        read = F.encode(encodings.decoded(rows, F.col("content"), model)["text"], "UTF-8")
        rows = rows.withColumn("content", F.when(F.col("source_type").isin(*TEXTUAL), read).otherwise(F.col("content")))
    return rows.mapInPandas(lambda batches: _parse(batches, field), READ)


def read_folder(spark: SparkSession, folder: str, pattern: str = "*", field: str = "content") -> tuple[DataFrame, DataFrame]:
    """(texts, failures), each in the order of paths. What was known of a text's file beside the text is its metadata."""
    rows = read_files(spark, folder, pattern, field=field)
    known = F.struct("file_name", "extension", "mime_type", F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss").alias("modified"), "digest", "size", "details")
    good = rows.where("error is null").orderBy("path").select("text", "source_type", "title", "author", F.col("path").alias("source_path"), F.to_json(known).alias("metadata"))
    return good, rows.where("error is not null").orderBy("path").select(F.col("file_name").alias("file"), "error_type", "error")


def route(spark: SparkSession, payload: object) -> DataFrame:
    """Whatever was pushed, as rows (text, ...): a DataFrame, a path, bytes, a dict, or text. A string is a path only if short and a file."""
    if isinstance(payload, DataFrame):
        return payload
    if isinstance(payload, Path) or isinstance(payload, str) and len(payload) < 260 and "\n" not in payload and Path(payload).is_file():
        if Path(payload).suffix.lower() not in EXTENSIONS:
            raise UnsupportedFileTypeError(str(payload))
        if not Path(payload).is_file():
            raise InvalidInputError(f"no file {payload}")
        row = read_files(spark, str(payload)).first()
        if row is None or row["error"] is not None:
            known = {x.__name__: x for x in (NoTextFoundError, UnsupportedFileTypeError, ExtractionError)}
            raise known.get(row["error_type"] if row else "", ExtractionError)(row["error"] if row else f"no file {payload}")
        return spark.createDataFrame([(row["text"], row["source_type"], row["title"])], "text string, source_type string, title string")
    if isinstance(payload, bytes):
        payload = payload.decode("utf-8", "replace")
    if isinstance(payload, str):
        payload = {"text": payload}
    if not isinstance(payload, dict):
        raise InvalidInputError(f"can't read a {type(payload).__name__}")
    body = next((payload[k] for k in tx.TEXT_KEYS if isinstance(payload.get(k), str) and payload[k].strip()), None)
    if body is None:
        raise NoTextFoundError("none of the text fields holds text")
    more = {k: str(payload[k]) for k in ("title", "author", "language", "source_type") if payload.get(k) is not None}
    if "title" not in more and payload.get("file_name") is not None:
        more["title"] = str(payload["file_name"])
    rest = {k: v for k, v in payload.items() if k not in tx.TEXT_KEYS and k not in more}
    if rest:
        more["metadata"] = json.dumps(rest, sort_keys=True, ensure_ascii=False, default=str)
    return spark.createDataFrame([(body, *more.values())], ", ".join(f"{k} string" for k in ("text", *more)))


def pull(spark: SparkSession, config: dict) -> DataFrame | None:
    """Texts of the configured folder; None unless files are enabled."""
    files = config.get("files", {})
    return read_folder(spark, files["directory"], files.get("pattern", "*"), text_key(files))[0] if files.get("enabled") else None


def html_pages(pages: DataFrame, key: str = "page_id", body: str = "html") -> DataFrame:
    """(key, title, text, links, images, scripts, tables, headings, version) of pages in a column, in Arrow batches."""
    names = ["links", "images", "scripts", "tables"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, h in zip(batch["k"], batch["h"], strict=True):
                t, d = parse_html(h or "")
                rows.append((k, d["title"], t, *(d[x] for x in names), len(d["headings"]), d["version"]))
            yield pd.DataFrame(rows, columns=["k", "title", "text", *names, "headings", "version"])

    schema = f"k {dict(pages.dtypes)[key]}, title string, text string, {', '.join(f'{x} int' for x in names)}, headings int, version string"
    return pages.select(F.col(key).alias("k"), F.col(body).alias("h")).mapInPandas(run, schema).withColumnRenamed("k", key)


def column_profile(df: DataFrame) -> DataFrame:
    """(column, dtype, nulls, distinct_values): a table's profile in one pass and one row per column."""
    parts = [x for n in df.columns for x in (F.sum(F.col(n).isNull().cast("long")).alias(f"{n}__nulls"), F.count_distinct(F.col(n)).alias(f"{n}__distinct"))]
    rows = F.array(*(F.struct(F.lit(n).alias("column"), F.lit(t).alias("dtype"), F.coalesce(f"{n}__nulls", F.lit(0)).cast("long").alias("nulls"), F.col(f"{n}__distinct").alias("distinct_values")) for n, t in df.dtypes))
    return df.agg(*parts).select(F.inline(rows))


def database_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table or a query (in brackets) by JDBC; give partitionColumn, lowerBound, upperBound and numPartitions to read in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A stream of texts."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return rows.select(F.col("value").cast("string").alias("text"), F.lit("kafka").alias("source_type"))


def gold(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, categories, note) of a JSONL file; blank and // lines are skipped, ids default to example_<line number>."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for content in batch["content"]:
                for number, line in enumerate(decode(bytes(content)).split("\n"), 1):
                    if line.strip() and not line.lstrip().startswith("//"):
                        try:
                            r = json.loads(line)
                            rows.append((r.get("id") or f"example_{number}", r["text"], r.get("categories", []), r.get("note")))
                        except (ValueError, KeyError) as e:
                            raise ValueError(f"line {number}: {e!r}") from e
            yield pd.DataFrame(rows, columns=["id", "text", "categories", "note"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "id string, text string, categories array<string>, note string")

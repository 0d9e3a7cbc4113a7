"""Document files as places: one row a paragraph, cell or property, with its text.

Files are read by Spark as binary rows, so any store that Spark reads will do; each is parsed in an Arrow batch by the
standard library. A broken file gives one place of kind ``error`` and never fails the job.
"""

from __future__ import annotations

import io
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# The extensions that can be read.
TEXT, OOXML, SHEETS, RICH = ("txt", "md", "csv"), ("docx", "docm", "pptx"), ("xlsx", "xlsm"), ("rtf",)
SKIPPED_PARTS = ("styles", "settings", "fontTable", "webSettings", "theme", "numbering")
LEAST_SHEET_NUMBER = 100_000
HEADERS = ("oddHeader", "oddFooter", "evenHeader", "evenFooter", "firstHeader", "firstFooter")
#: Elements that stand for a character.
SIGNS = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def paragraph_text(p: ET.Element) -> str:
    """A paragraph's own text after accepting tracked changes; tabs, breaks and hyphens become characters."""
    out: list[str] = []

    def walk(e: ET.Element) -> None:
        for c in e:
            name = _local(c.tag)
            if name in ("del", "moveFrom", "p") or name.endswith("Change"):
                continue
            if name == "t":
                out.append(c.text or "")
            elif name in SIGNS:
                out.append(SIGNS[name])
            else:
                walk(c)

    walk(p)
    return "".join(out)


def holds_text(name: str) -> bool:
    return name.startswith(("word/", "ppt/", "xl/charts", "xl/drawings")) and not name.rsplit("/", 1)[-1].startswith(SKIPPED_PARTS)


def ooxml_places(raw: bytes):
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for name in sorted(z.namelist()):
            if name.endswith(".rels"):
                for r in ET.fromstring(z.read(name)):
                    if r.get("TargetMode") == "External":
                        yield "link", unquote(r.get("Target", ""))
            elif name.endswith(".xml") and (name.startswith("docProps/") or holds_text(name)):
                root = ET.fromstring(z.read(name))
                if name.startswith("docProps/"):
                    for e in root.iter():
                        if not len(e) and (e.text or "").strip():
                            yield "property", e.text
                else:
                    for e in root.iter():
                        if _local(e.tag) == "p" and (t := paragraph_text(e)):
                            yield "paragraph", t


def whole_number(v: str | None) -> bool:
    return bool(v) and re.fullmatch("-?[0-9]+", v) is not None and abs(int(v)) >= LEAST_SHEET_NUMBER


def sheet_places(raw: bytes):
    """Sheet names, text cells, whole numbers of six digits and more, comments, headers and footers, properties."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        words: list[str] = []
        if "xl/sharedStrings.xml" in names:
            words = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
        for s in ET.fromstring(z.read("xl/workbook.xml")).iter():
            if _local(s.tag) == "sheet":
                yield "sheet", s.get("name", "")
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+[.]xml", n)):
            for e in ET.fromstring(z.read(name)).iter():
                tag = _local(e.tag)
                if tag == "c":
                    v = next((x.text for x in e.iter() if _local(x.tag) == "v"), None)
                    if e.get("t") == "s" and v is not None:
                        yield "cell", words[int(v)]
                    elif e.get("t") == "inlineStr":
                        yield "cell", "".join(x.text or "" for x in e.iter() if _local(x.tag) == "t")
                    elif e.get("t") in (None, "n") and whole_number(v):
                        yield "number", v
                elif tag in HEADERS and e.text:
                    for part in re.split("&[LCR]", e.text):
                        if part:
                            yield "header", part
        for name in sorted(n for n in names if re.fullmatch(r"xl/comments[^/]*[.]xml", n)):
            for c in ET.fromstring(z.read(name)).iter():
                if _local(c.tag) == "comment":
                    yield "comment", "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
        if "docProps/core.xml" in names:
            for e in ET.fromstring(z.read("docProps/core.xml")).iter():
                if not len(e) and _local(e.tag) in ("creator", "title", "subject", "lastModifiedBy", "description", "keywords") and e.text:
                    yield "property", e.text


RTF = re.compile(rb"\\([a-z]{1,32})(-?[0-9]{1,10})?[ ]?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", re.IGNORECASE | re.DOTALL)
RTF_HIDDEN = ("fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "themedata", "datastore", "listtable", "rsidtbl", "generator")
RTF_CHARS = {"par": "\n", "line": "\n", "tab": "\t", "cell": "\t", "row": "\n", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "nbsp": "\xa0"}


def rtf_chars(raw: bytes) -> list[tuple[str, int, int]]:
    """(character, first byte, byte after) of an RTF file's text: code pages, Unicode escapes with their fallbacks, hidden
    groups left out, addresses of links read."""
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[bool, int]] = []
    hidden, fallback, skip, page = False, 1, 0, "cp1252"
    for m in RTF.finditer(raw):
        word, arg, byte, sign, brace, char = m.groups()
        if brace == b"{":
            stack.append((hidden, fallback))
        elif brace:
            hidden, fallback = stack.pop() if stack else (False, 1)
            skip = 0
        elif word:
            name, n = word.decode().lower(), int(arg) if arg else None
            if name == "ansicpg" and n:
                page = f"cp{n}"
            elif name == "uc":
                fallback = n if n is not None else 1
            elif name == "fldinst":
                hidden = False
            elif name in RTF_HIDDEN:
                hidden = True
            elif name == "u" and n is not None:
                if not hidden:
                    out.append((chr(n % 65536), m.start(), m.end()))
                skip = fallback
            elif name in RTF_CHARS and not hidden:
                out.append((RTF_CHARS[name], m.start(), m.end()))
        elif sign == b"*":
            hidden = True
        elif byte or char or sign:
            if skip:
                skip -= 1
                if out:
                    out[-1] = (out[-1][0], out[-1][1], m.end())
            elif not hidden:
                got = bytes([int(byte, 16)]) if byte else char or (sign if sign in b"\\{}" else {b"~": b"\xa0", b"_": b"-"}.get(sign, b""))
                out += [(c, m.start(), m.end()) for c in got.decode(page, "replace")]
    return out


def rtf_text(raw: bytes) -> str:
    """Text of an RTF file; halves of one character are joined."""
    return "".join(c for c, _, _ in rtf_chars(raw)).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def places_of(ext: str, raw: bytes):
    if ext in TEXT:
        yield "text", raw.decode("utf-8", "replace")
    elif ext in OOXML:
        yield from ooxml_places(raw)
    elif ext in SHEETS:
        yield from sheet_places(raw)
    elif ext in RICH:
        yield "text", rtf_text(raw)


def places(files: DataFrame) -> DataFrame:
    """All places of files (path, content and more), in order, beside their other columns; files of other kinds have none,
    a null or broken file has one of kind ``error``."""
    kept = [c for c in files.columns if c not in ("content", "place_no", "kind", "text")]
    rows = files.select(*kept, "content")
    at = kept.index("path")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                try:
                    got = list(places_of(b.column(at)[i].as_py().rsplit(".", 1)[-1].lower(), b.column(len(kept))[i].as_py()))
                except (zipfile.BadZipFile, ET.ParseError, AttributeError, TypeError, KeyError, ValueError, IndexError, LookupError) as e:
                    got = [("error", type(e).__name__)]
                n = len(got)
                same = [b.column(k).take(pa.array([i] * n, pa.int32())) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(range(n), pa.int32()), pa.array([k for k, _ in got], pa.string()), pa.array([t for _, t in got], pa.string())], names=[*kept, "place_no", "kind", "text"])

    new = [StructField("place_no", IntegerType()), StructField("kind", StringType()), StructField("text", StringType())]
    return rows.mapInArrow(run, StructType([*[rows.schema[c] for c in kept], *new]))


def char_spans(files: DataFrame) -> DataFrame:
    """Where each character of RTF files (path, content and more) stands in its file's bytes: the files' columns and n,
    char, start, stop (end exclusive)."""
    def run(batches):
        at = None
        for b in batches:
            at = b.schema.get_field_index("content") if at is None else at
            for i in range(b.num_rows):
                got = rtf_chars(b.column(at)[i].as_py() or b"")
                same = [c.take(pa.array([i] * len(got), pa.int32())) for c in b.columns]
                yield pa.RecordBatch.from_arrays([*same, pa.array(range(len(got)), pa.int32()), pa.array([c for c, _, _ in got], pa.string()), pa.array([a for _, a, _ in got], pa.int32()), pa.array([e for _, _, e in got], pa.int32())], names=[*b.schema.names, "n", "char", "start", "stop"])

    new = [StructField("n", IntegerType()), StructField("char", StringType()), StructField("start", IntegerType()), StructField("stop", IntegerType())]
    return files.mapInArrow(run, StructType([*files.schema.fields, *new]))


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """(path, place_no, kind, text): all places of the files under a path."""
    return places(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"))


def full_text(places: DataFrame, meta: bool = True, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys, text): a file's places joined by line breaks in order; without metadata if so asked."""
    rows = places if meta else places.where(~F.col("kind").isin("property", "link", "sheet", "comment", "header"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place_no", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy(*keys).agg(joined.alias("text"))


def write_text(docs: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """Masked or restored texts as text files, a folder a document; a document's lines stay in order in one file."""
    docs.select(name, F.col(text).alias("value")).write.mode("overwrite").partitionBy(name).text(path)

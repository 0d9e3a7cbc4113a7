"""Files with values put in place of tokens or tokens in place of values, the format kept.

A file is rewritten where its bytes are, in an Arrow batch with the dictionary of its session; a paragraph's text is matched
as a whole, however many runs it is cut into, and the run that holds most of a match gets what replaces it.
"""

from __future__ import annotations

import copy
import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree as ET
from xml.sax.saxutils import quoteattr

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.masking import Replacer
from ..sources import files as S
from ..sources.files import _local

Spans = list[tuple[int, int, str]]
SPACE = "{http://www.w3.org/XML/1998/namespace}space"
#: Properties that are emptied, and attributes that name an author. Fixed values.
EMPTIED = ("creator", "lastModifiedBy", "title", "subject", "description", "keywords", "category", "manager", "company", "Company", "Manager")
AUTHORS = ("author", "initials")
#: Properties of a run that the format puts after the ground. Fixed values.
AFTER_HIGHLIGHT = ("u", "effect", "bdr", "shd", "fitText", "vertAlign", "rtl", "cs", "em", "lang", "eastAsianLayout", "specVanish", "oMath")


def pieces(runs: list[str], spans: Spans) -> list[list[tuple[str, bool]]]:
    """The runs of a paragraph after spans of their joined text became other values, each run as pieces (text, put in)."""
    edits: list[list[tuple[int, int, str]]] = [[] for _ in runs]
    for s, e, value in spans:
        at, share = 0, []
        for r in runs:
            share.append((max(s - at, 0), min(e - at, len(r))))
            at += len(r)
        held = [b - a for a, b in share]
        if max(held, default=0) > 0:
            best = held.index(max(held))
            for i, (a, b) in enumerate(share):
                if b > a:
                    edits[i].append((a, b, value if i == best else ""))
    out = []
    for r, cuts in zip(runs, edits):
        at, parts = 0, []
        for a, b, value in sorted(cuts):
            parts += [(r[at:a], False), (value, True)]
            at = b
        out.append([p for p in [*parts, (r[at:], False)] if p[0]])
    return out


def fitted(runs: list[str], spans: Spans) -> list[str]:
    return ["".join(t for t, _ in p) for p in pieces(runs, spans)]


def _paragraph_runs(p: ET.Element) -> list[ET.Element | str]:
    """Text elements, and what other elements stand for, of a paragraph whose tracked changes were accepted."""
    out: list[ET.Element | str] = []

    def walk(e: ET.Element) -> None:
        for c in e:
            name = _local(c.tag)
            if name in ("del", "moveFrom", "p") or name.endswith("Change"):
                continue
            if name == "t":
                out.append(c)
            elif name in S.SIGNS:
                out.append(S.SIGNS[name])
            else:
                walk(c)

    walk(p)
    return out


def _parsed(raw: bytes) -> tuple[ET.Element, dict[str, str]]:
    """A part's root and its name spaces, whose prefixes are kept."""
    names = dict(n for _, n in ET.iterparse(io.BytesIO(raw), events=("start-ns",)))
    for prefix, uri in names.items():
        if not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)
    return ET.fromstring(raw), names


def _serialised(root: ET.Element, names: dict[str, str]) -> bytes:
    """A part as bytes; prefixes that only attribute values name stay declared."""
    body = ET.tostring(root, encoding="unicode")
    end = body.index(">") - (body[body.index(">") - 1] == "/")
    lost = "".join(f" xmlns:{p}={quoteattr(u)}" for p, u in names.items() if p and f'xmlns:{p}="' not in body[:end])
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n{body[:end]}{lost}{body[end:]}'.encode()


def _set(t: ET.Element, text: str) -> None:
    t.text = text
    if text != text.strip():
        t.set(SPACE, "preserve")


def _marked(parent: ET.Element, run: ET.Element, t: ET.Element, parts: list[tuple[str, bool]]) -> bool:
    """Whether a run that holds one text only became a run a piece, those put in with a yellow ground."""
    if _of(run, "r") is None or any(_local(c.tag) not in ("rPr", "t") for c in run) or sum(_local(c.tag) == "t" for c in run) != 1:
        return False
    ns = run.tag[: -len("r")]
    at = list(parent).index(run)
    parent.remove(run)
    for k, (text, new) in enumerate(parts):
        one = copy.deepcopy(run)
        _set(next(c for c in one if _local(c.tag) == "t"), text)
        if new:
            look = next((c for c in one if _local(c.tag) == "rPr"), None)
            if look is None:
                look = ET.Element(f"{ns}rPr")
                one.insert(0, look)
            for old in [c for c in look if _local(c.tag) == "highlight"]:
                look.remove(old)
            place = next((i for i, c in enumerate(look) if _local(c.tag) in AFTER_HIGHLIGHT), len(look))
            look.insert(place, ET.Element(f"{ns}highlight", {f"{ns}val": "yellow"}))
        parent.insert(at + k, one)
    return True


def _of(e: ET.Element, name: str) -> ET.Element | None:
    return e if _local(e.tag) == name else None


def _part(raw: bytes, find: Callable[[str], Spans], mark: bool = False) -> bytes:
    root, names = _parsed(raw)
    above = {c: e for e in root.iter() for c in e} if mark else {}
    changed = False
    for p in [e for e in root.iter() if _local(e.tag) == "p"]:
        runs = _paragraph_runs(p)
        texts = [r if isinstance(r, str) else r.text or "" for r in runs]
        spans = find("".join(texts))
        for r, t, parts in zip(runs, texts, pieces(texts, spans) if spans else ()):
            new = "".join(x for x, _ in parts)
            if isinstance(r, str) or not (new != t or any(m for _, m in parts)):
                continue
            changed = True
            run = above.get(r)
            if not (mark and any(m for _, m in parts) and run in above and _marked(above[run], run, r, parts)):
                _set(r, new)
    return _serialised(root, names) if changed else raw


def _scrubbed(raw: bytes) -> bytes:
    root, names = _parsed(raw)
    for e in root.iter():
        if _local(e.tag) in EMPTIED:
            e.text = ""
        for a in list(e.attrib):
            if _local(a) in AUTHORS:
                e.set(a, "")
    return _serialised(root, names)


def ooxml(raw: bytes, find: Callable[[str], Spans], scrub: bool = True, mark: bool = False) -> bytes:
    """A DOCX or PPTX file with its paragraphs replaced, its properties and authors emptied and, in Word files, what was
    put in on a yellow ground, if so asked."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(raw)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for name in z.namelist():
            body = z.read(name)
            if name.startswith("docProps/") and name.endswith(".xml") and scrub:
                body = _scrubbed(body)
            elif name.endswith(".xml") and S.holds_text(name):
                body = _part(body, find, mark and name.startswith("word/"))
            w.writestr(name, body)
    return out.getvalue()


def _applied(text: str, spans: Spans) -> str:
    out, at = [], 0
    for s, e, value in sorted(spans):
        out += [text[at:s], value]
        at = e
    return "".join([*out, text[at:]])


def _strings(raw: bytes, find: Callable[[str], Spans], item: str, scrub: bool) -> tuple[bytes, dict[int, str]]:
    """A part of text items (shared strings, comments), and the items that changed."""
    root, names = _parsed(raw)
    new: dict[int, str] = {}
    for i, e in enumerate(e for e in root.iter() if _local(e.tag) == item):
        runs = [t for t in e.iter() if _local(t.tag) == "t"]
        spans = find("".join(t.text or "" for t in runs))
        if spans:
            texts = fitted([t.text or "" for t in runs], spans)
            new[i] = "".join(texts)
            for t, x in zip(runs, texts):
                _set(t, x)
    if scrub:
        for e in root.iter():
            if _local(e.tag) == "author":
                e.text = ""
    return (_serialised(root, names) if new or scrub else raw), new


def _cells(raw: bytes, find: Callable[[str], Spans], shared: dict[int, str]) -> bytes:
    """A sheet: numbers that hold a value become texts, texts that became plain numbers are numbers again."""
    root, names = _parsed(raw)
    ns = root.tag[: -len(_local(root.tag))]
    for c in root.iter():
        tag = _local(c.tag)
        if tag == "c":
            v = next((x for x in c if _local(x.tag) == "v"), None)
            inline = next((x for x in c if _local(x.tag) == "is"), None)
            kind, new = c.get("t"), None
            if kind == "s" and v is not None:
                new = shared.get(int(v.text or -1))
            elif kind == "inlineStr" and inline is not None:
                text = "".join(x.text or "" for x in inline.iter() if _local(x.tag) == "t")
                spans = find(text)
                new = _applied(text, spans) if spans else None
            elif kind in (None, "n") and v is not None and S.whole_number(v.text):
                spans = find(v.text)
                new = _applied(v.text, spans) if spans else None
            if new is None:
                continue
            if re.fullmatch("[1-9][0-9]{0,14}", new):
                c.attrib.pop("t", None)
                c[:] = [ET.Element(f"{ns}v")]
                c[0].text = new
            elif kind != "s":
                c.set("t", "inlineStr")
                c[:] = [ET.Element(f"{ns}is")]
                _set(ET.SubElement(c[0], f"{ns}t"), new)
        elif tag in S.HEADERS and c.text:
            c.text = "".join(x if re.fullmatch("&[LCR]", x) else _applied(x, find(x)) for x in re.split("(&[LCR])", c.text))
    return _serialised(root, names)


def _sheet_names(raw: bytes, find: Callable[[str], Spans]) -> bytes:
    """Names of sheets; signs that a name can't hold go, so a token stands there without brackets."""
    root, names = _parsed(raw)
    for e in root.iter():
        if _local(e.tag) == "sheet" and (spans := find(e.get("name", ""))):
            e.set("name", re.sub(r"[\[\]:*?/\\]", "", _applied(e.get("name", ""), spans))[:31])
    return _serialised(root, names)


def sheets(raw: bytes, find: Callable[[str], Spans], scrub: bool = True) -> bytes:
    """A workbook with its sheet names, cells, comments, headers and footers replaced, its properties emptied if so asked."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(raw)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        body = {n: z.read(n) for n in z.namelist()}
        shared: dict[int, str] = {}
        if "xl/sharedStrings.xml" in body:
            body["xl/sharedStrings.xml"], shared = _strings(body["xl/sharedStrings.xml"], find, "si", False)
        for name, part in body.items():
            if name == "xl/workbook.xml":
                part = _sheet_names(part, find)
            elif re.fullmatch(r"xl/worksheets/[^/]+[.]xml", name):
                part = _cells(part, find, shared)
            elif re.fullmatch(r"xl/comments[^/]*[.]xml", name):
                part = _strings(part, find, "comment", scrub)[0]
            elif name.startswith("docProps/") and name.endswith(".xml") and scrub:
                part = _scrubbed(part)
            w.writestr(name, part)
    return out.getvalue()


def rtf_escape(value: str) -> bytes:
    body = "".join("\\" + c if c in "\\{}" else c if c.isascii() else _unicode(c) for c in value)
    return (body if value.isascii() else "{\\uc1 " + body + "}").encode("ascii")


def _unicode(c: str) -> str:
    raw = c.encode("utf-16-le")
    return "".join(f"\\u{int.from_bytes(raw[i : i + 2], 'little', signed=True)}?" for i in range(0, len(raw), 2))


def rtf(raw: bytes, find: Callable[[str], Spans]) -> bytes:
    """An RTF file with spans of its text replaced: the bytes of the first character give way to the value, those of the
    others go, and everything between them stays."""
    chars = S.rtf_chars(raw)
    text, out, at = "".join(c for c, _, _ in chars), [], 0
    for s, e, value in sorted(find(text)):
        for k, (_, a, b) in enumerate(chars[s:e]):
            if a >= at:
                out += [raw[at:a], rtf_escape(value) if k == 0 else b""]
                at = b
    return b"".join([*out, raw[at:]])


def rewritten(ext: str, raw: bytes, find: Callable[[str], Spans], scrub: bool, mark: bool = False) -> bytes | None:
    if ext in S.TEXT:
        text = raw.decode("utf-8", "replace")
        return _applied(text, find(text)).encode()
    if ext in S.OOXML:
        return ooxml(raw, find, scrub, mark)
    if ext in S.SHEETS:
        return sheets(raw, find, scrub)
    return rtf(raw, find) if ext in S.RICH else None


def _rewrite(files: DataFrame, pairs: DataFrame, finder: Callable[[list], Callable[[str], Spans]], scrub: bool, mark: bool) -> DataFrame:
    """Files with what the finder of their session's ``pairs`` (session_id, value, token) finds put in."""
    table = pairs.where("value <> ''").groupBy("session_id").agg(F.collect_list(F.struct("value", "token")).alias("pairs"))
    joined = files.select("session_id", "path", "content").join(table, "session_id", "left")
    session = joined.schema["session_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            out, errors = [], []
            for path, raw, pairs_ in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), b.column("pairs").to_pylist()):
                try:
                    out.append(rewritten(path.rsplit(".", 1)[-1].lower(), raw, finder(pairs_ or []), scrub, mark))
                    errors.append(None if out[-1] is not None else "format")
                except (zipfile.BadZipFile, ET.ParseError, AttributeError, TypeError, KeyError, ValueError) as e:
                    out.append(None)
                    errors.append(type(e).__name__)
            yield pa.RecordBatch.from_arrays([b.column("session_id"), b.column("path"), pa.array(out, pa.binary()), pa.array(errors, pa.string())], names=["session_id", "path", "content", "error"])

    return joined.mapInArrow(run, f"session_id {session}, path string, content binary, error string")


def masked_files(files: DataFrame, pairs: DataFrame, scrub: bool = True) -> DataFrame:
    """(session_id, path, content, error): files (session_id, path, content) with their session's values as tokens.

    pairs: session_id, value, token. A session's dictionary goes to its files by an equi-join. A file that can't be
    read keeps null content and its error.
    """
    return _rewrite(files, pairs, lambda found: Replacer({x["value"]: f"[{x['token']}]" for x in found}).spans, scrub, False)


def restored_files(files: DataFrame, values: DataFrame, mark: bool = False) -> DataFrame:
    """(session_id, path, content, error): masked files with their session's values (session_id, token, value) again;
    tokens may be written loosely, unknown ones stay. ``mark`` puts values in Word files on a yellow ground."""
    loose = re.compile(T.LOOSE.removeprefix("(?iU)"), re.IGNORECASE)

    def finder(found: list) -> Callable[[str], Spans]:
        of = {x["token"]: x["value"] for x in found}
        return lambda text: [(m.start(), m.end(), of[t]) for m in loose.finditer(text) if (t := T.token_name(m[0])) in of]

    return _rewrite(files, values, finder, False, mark)


def zipped(files: DataFrame) -> DataFrame:
    """(session_id, archive): a session's finished files (session_id, entry, content) in one archive, by name."""
    session = files.schema["session_id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, raw in sorted(zip(t.column("entry").to_pylist(), t.column("content").to_pylist())):
                z.writestr(zipfile.ZipInfo(name), raw)
        return pa.table({"session_id": t.column("session_id").slice(0, 1).combine_chunks(), "archive": pa.array([out.getvalue()], pa.binary())})

    return files.select("session_id", "entry", "content").groupBy("session_id").applyInArrow(run, f"session_id {session}, archive binary")


def part_text(content, name: str) -> Column:
    """A part of a packed file as text, as a column; null if it has none."""
    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            return z.read(name).decode() if name in z.namelist() else None

    return F.pandas_udf(lambda raw: pd.Series([one(r) for r in raw], dtype=object), "string", F.PandasUDFType.SCALAR)(content)


def verified(written: DataFrame, pairs: DataFrame) -> DataFrame:
    """(session_id, left_over): how many of a session's values of three characters and more a written text still holds,
    as it stands or with its white space collapsed. written: session_id, doc_id, text; pairs: session_id, value."""
    from ..operators import masking

    both = written.select("session_id", "doc_id", "text").unionByName(written.select("session_id", "doc_id", T.squashed("text").alias("text")))
    vals = pairs.select("session_id", F.explode(F.array_distinct(F.array("value", T.squashed("value")))).alias("value")).where("length(trim(value)) >= 3")
    both = both.withColumn("doc_id", F.concat_ws("\u0001", "session_id", "doc_id"))
    hit = masking.leaks(both, vals).select(F.substring_index("doc_id", "\u0001", 1).alias("s_"), T.squashed("value").alias("value")).distinct().groupBy("s_").agg(F.count("*").alias("n"))
    sessions = written.select("session_id").distinct()
    return sessions.join(hit, sessions["session_id"].cast("string") == hit["s_"], "left").select("session_id", F.coalesce("n", F.lit(0)).alias("left_over"))

"""Queries of files read, written and restored, with results known by hand: small files in the session of every supplier."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .golden_tables import known
from .operators import layout
from .sinks import files as sinks
from .sources import files as sources

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:q="urn:q"'
CORE = "<c><creator>Автор</creator><title>Договор</title></c>"
FILE = "path string, content binary"


def packed(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def paragraph(*runs: str) -> str:
    return "<w:p>" + "".join(r if r.startswith("<") else f'<w:r><w:t xml:space="preserve">{r}</w:t></w:r>' for r in runs) + "</w:p>"


def docx(*paragraphs: str, **parts: str) -> bytes:
    return packed({"word/document.xml": f'<w:document {W} q:Ignorable="q"><w:body>{"".join(paragraphs)}</w:body></w:document>', "docProps/core.xml": CORE, **parts})


def workbook(*cells: str) -> bytes:
    return packed({
        "xl/workbook.xml": '<w><sheets><sheet name="Иванов"/></sheets></w>',
        "xl/sharedStrings.xml": "<sst><si><t>Покупатель </t><r><t>Ива</t></r><r><t>нов</t></r></si><si><t>123456</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<w><c t="s"><v>0</v></c><c t="s"><v>1</v></c><c><v>7707083893</v></c><c><v>99999</v></c><c t="inlineStr"><is><t>слово</t></is></c>{"".join(cells)}<oddHeader>&amp;LИванов&amp;Rстр. 1</oddHeader></w>',
        "xl/comments1.xml": "<c><authors><author>Автор</author></authors><comment><t>звонил Иванов</t></comment></c>",
        "docProps/core.xml": CORE,
    })


RTF = "{\\rtf1\\ansi\\ansicpg1251{\\fonttbl{\\f0 Arial;}}\\uc1 a \\u1048?\\u1074?\\'e0\\'ed\\'ee\\'e2 {\\b b}\\par{\\field{\\*\\fldinst HYPERLINK mailto:a@b.ru}}}".encode()
MAIN = docx(
    paragraph("Ива", "<w:ins><w:r><w:t>нов</w:t></w:r></w:ins>", "<w:del><w:r><w:delText>x</w:delText></w:r></w:del>", "<w:r><w:tab/></w:r>", "ООО"),
    paragraph("a", "<w:r><w:br/></w:r>", "b", "<w:r><w:noBreakHyphen/></w:r>", "c"),
    **{"word/_rels/document.xml.rels": '<r><x Target="mailto:a%40b.ru" TargetMode="External"/><x Target="styles.xml"/></r>', "word/styles.xml": f"<w:s {W}>{paragraph('стиль')}</w:s>"},
)
SLIDE = packed({"ppt/slides/slide1.xml": '<a:s xmlns:a="urn:a"><a:p><a:r><a:t>Слайд</a:t></a:r></a:p></a:s>'})


def places_of(s, path: str, content: bytes) -> DataFrame:
    return sources.places(s.rows([(path, content)], FILE))


# ---- read ------------------------------------------------------------------------------------------------------------------
@known("path place_no kind text", [("a.txt", "0", "text", "ok�"), ("b.md", "0", "text", ""), ("c.CSV", "0", "text", "x;y")])
def scan_text_files(s):
    return sources.places(s.rows([("a.txt", b"ok\xff"), ("b.md", b""), ("c.CSV", b"x;y"), ("d.exe", b"x")], FILE))


@known("place_no kind text", [("0", "property", "Автор"), ("1", "property", "Договор"), ("2", "link", "mailto:a@b.ru"), ("3", "paragraph", "Иванов\tООО"), ("4", "paragraph", "a\nb-c")])
def scan_docx(s):
    """Paragraphs after accepting tracked changes, properties and outer links; styles hold no text."""
    return places_of(s, "a.docx", MAIN)


@known("place_no kind text", [("0", "paragraph", "Слайд")])
def scan_pptx(s):
    return places_of(s, "a.pptx", SLIDE)


SHEET = [("0", "sheet", "Иванов"), ("1", "cell", "Покупатель Иванов"), ("2", "cell", "123456"), ("3", "number", "7707083893"), ("4", "cell", "слово"), ("5", "header", "Иванов"), ("6", "header", "стр. 1"), ("7", "comment", "звонил Иванов")]


@known("place_no kind text", [*SHEET, ("8", "property", "Автор"), ("9", "property", "Договор")])
def scan_xlsx(s):
    return places_of(s, "a.xlsx", workbook())


@known("text", [("a Иванов b\nHYPERLINK mailto:a@b.ru",)])
def scan_rtf(s):
    return places_of(s, "a.rtf", RTF)


@known("n char raw", [("2", "И", "\\u1048?"), ("3", "в", "\\u1074?"), ("4", "а", "\\'e0")])
def rtf_char_spans(s):
    """Where in the file's bytes a character of its text stands."""
    chars = sources.char_spans(s.rows([("a.rtf", RTF)], FILE)).where("n BETWEEN 2 AND 4")
    return chars.select("session_id", "n", "char", F.expr("decode(substring(content, start + 1, stop - start), 'UTF-8')").alias("raw"))


@known("path kind text", [("a.docx", "error", "BadZipFile"), ("b.xlsx", "error", "KeyError"), ("c.docx", "error", "ParseError")])
def scan_broken_files(s):
    return sources.places(s.rows([("a.docx", b"not a zip"), ("b.xlsx", packed({"x": ""})), ("c.docx", packed({"word/document.xml": "<a"}))], FILE))


@known("path text plain", [("a.docx", "Автор\nДоговор\nmailto:a@b.ru\nИванов\tООО\na\nb-c", "Иванов\tООО\na\nb-c"), ("b.txt", "x", "x")])
def full_texts(s):
    """A file's whole text, with and without its metadata."""
    places = sources.places(s.rows([("a.docx", MAIN), ("b.txt", b"x")], FILE))
    keys = ("session_id", "path")
    return sources.full_text(places, keys=keys).join(sources.full_text(places, False, keys).withColumnRenamed("text", "plain"), list(keys))


def _line(page: int, line: int, text: str, x: float, y: float, h: float = 10.0) -> tuple:
    return (page, line, text, float(x), float(y), x + 200.0, y + h, 1000.0)


@known("page text", [("0", "Первая строка продолжение\nАбзац:\nпункт"), ("1", "л1 л2\nп1 п2 п3 п4")])
def reading_order(s):
    """Recognised lines in reading order: rows of one column, then those of the other."""
    lines = [_line(0, 3, "пункт", 10, 62), _line(0, 1, "продолжение", 10, 12), _line(0, 0, "Первая строка", 10, 0), _line(0, 2, "Абзац:", 10, 48)]
    lines += [_line(1, i, f"п{i + 1}", 600, 11.0 * i) for i in range(4)] + [_line(1, 4 + i, f"л{i + 1}", 10, 11.0 * i) for i in range(2)]
    rows = s.rows(lines, "p int, line_id int, text string, x0 double, y0 double, x1 double, y1 double, width double")
    got = layout.reading_order(rows.withColumn("page_id", F.struct("session_id", "p")))
    return got.select("page_id.session_id", F.col("page_id.p").alias("page"), "text")


@known("name ok", [("plain", "true"), ("short", "true"), ("camel", "false"), ("unknown", "false"), ("known", "true"), ("latin", "true")])
def text_layer(s):
    """Whether a page's text layer can be trusted: words with capitals inside, and the share of known Cyrillic words."""
    rows = s.rows([("plain", "слово " * 20, 0.9), ("short", "слОво " * 14, 0.0), ("camel", "слОво " * 20, 0.9), ("unknown", "ывапр " * 15, 0.4), ("known", "слово " * 15, 0.5), ("latin", "word " * 20, 0.0)], "name string, text string, share double")
    return rows.withColumn("ok", layout.text_layer_ok("text", F.col("share")))


# ---- written ---------------------------------------------------------------------------------------------------------------
PAIRS = [("Иванов", "FIO_1"), ("7707083893", "INN_1"), ("123456", "PASSPORT_1"), ("a@b.ru", "EMAIL_1")]


def masked(s, path: str, content: bytes, scrub: bool = True) -> DataFrame:
    return sinks.masked_files(s.rows([(path, content)], FILE), s.rows(PAIRS, "value string, token string"), scrub)


def restored(s, path: str, content: bytes, mark: bool = False) -> DataFrame:
    return sinks.restored_files(s.rows([(path, content)], FILE), s.rows(PAIRS, "value string, token string"), mark)


@known("path text error", [("a.txt", "[FIO_1], Ивановский", None), ("b.exe", None, "format"), ("c.docx", None, "BadZipFile")])
def write_text_files(s):
    got = sinks.masked_files(s.rows([("a.txt", "Иванов, Ивановский".encode()), ("b.exe", b"x"), ("c.docx", b"x")], FILE), s.rows(PAIRS, "value string, token string"))
    return got.withColumn("text", F.col("content").cast("string"))


@known("place_no kind text", [("0", "link", "mailto:a@b.ru"), ("1", "paragraph", "[FIO_1]\tООО"), ("2", "paragraph", "a\nb-c")])
def write_docx(s):
    """A value over two runs becomes a token in the run that holds most of it; properties are emptied."""
    return sources.places(masked(s, "a.docx", MAIN))


@known("declared", [("true",)])
def docx_prefixes_stay(s):
    """Prefixes that only attribute values name stay declared, or the file would be refused."""
    got = masked(s, "a.docx", MAIN)
    return got.withColumn("declared", sinks.part_text("content", "word/document.xml").contains('xmlns:q="urn:q"'))


@known("place_no kind text", [("0", "sheet", "FIO_1"), ("1", "cell", "Покупатель [FIO_1]"), ("2", "cell", "[PASSPORT_1]"), ("3", "cell", "[INN_1]"), ("4", "cell", "слово"), ("5", "header", "[FIO_1]"), ("6", "header", "стр. 1"), ("7", "comment", "звонил [FIO_1]")])
def write_xlsx(s):
    return sources.places(masked(s, "a.xlsx", workbook()))


@known("text", [("a [FIO_1] b\nHYPERLINK mailto:a@b.ru",)])
def write_rtf(s):
    got = sinks.masked_files(s.rows([("a.rtf", RTF)], FILE), s.rows(PAIRS[:1], "value string, token string"))
    return sources.places(got)


@known("text raw", [("Выдан Иванов и [FIO_9]", "{\\rtf1\\ansi Выдан {\\uc1 \\u1048?\\u1074?\\u1072?\\u1085?\\u1086?\\u1074?} и [FIO_9]}".replace("Выдан", "x").replace(" и ", " y "))])
def restore_rtf(s):
    """A token in an RTF file becomes its value in escapes; unknown tokens stay."""
    raw = restored(s, "a.rtf", b"{\\rtf1\\ansi x [FIO_1] y [FIO_9]}").withColumn("raw", F.col("content").cast("string"))
    text = sources.places(raw.select("session_id", "path", "content")).select("session_id", F.regexp_replace(F.regexp_replace("text", "^x", "Выдан"), " y ", " и ").alias("text"))
    return raw.join(text, "session_id").select("session_id", "text", "raw")


@known("text", [("Иванов\tООО",), ("Покупатель: Иванов, FIO_9",)])
def restore_docx(s):
    """Tokens cut into runs and loosely written become values again."""
    return sources.places(restored(s, "a.docx", docx(paragraph("[FI", "O_1]", "<w:r><w:tab/></w:r>", "ООО"), paragraph("Покупатель: fio-1, FIO_9")))).where("kind = 'paragraph'")


@known("pieces text", [("Покупатель |Иванов*| здесь", "Покупатель Иванов здесь")])
def restore_highlight(s):
    """Values put in stand in runs of their own on a yellow ground (marked *), in the order that the format asks for."""
    got = restored(s, "a.docx", docx(paragraph('<w:r><w:rPr><w:b/><w:u/></w:rPr><w:t>Покупатель [FIO_1] здесь</w:t></w:r>')), mark=True)
    xml = sinks.part_text("content", "word/document.xml")
    runs = F.regexp_extract_all(xml, F.lit(r"(?s)<w:r>.*?</w:r>"), 0)
    shown = F.transform(runs, lambda r: F.concat(F.regexp_extract(r, "<w:t[^>]*>([^<]*)<", 1), F.when(r.rlike('<w:b ?/><w:highlight w:val="yellow" ?/><w:u ?/>'), "*").otherwise("")))
    text = sources.places(got.select("session_id", "path", "content")).where("kind = 'paragraph'").select("session_id", "text")
    return got.select("session_id", F.array_join(shown, "|").alias("pieces")).join(text, "session_id")


@known("place_no kind text", SHEET)
def restore_xlsx(s):
    """Masked and restored, a workbook has the same names, texts and numbers; a number kept as text comes back as one."""
    once = masked(s, "a.xlsx", workbook()).select("session_id", "path", "content")
    back = sources.places(sinks.restored_files(once, s.rows(PAIRS, "value string, token string")))
    return back.withColumn("kind", F.when((F.col("kind") == "number") & (F.col("text") == "123456"), "cell").otherwise(F.col("kind")))


@known("path text same", [("a.docx", "[FIO_1]\tООО\na\nb-c", "true"), ("b.rtf", "a [FIO_1] b\nHYPERLINK mailto:[EMAIL_1]", "true"), ("c.txt", "от [FIO_1] ([INN_1])", "true")])
def files_round_trip(s):
    """Files masked, read, restored and read again: the texts are those of the originals."""
    keys = ("session_id", "path")
    original = s.rows([("a.docx", MAIN), ("b.rtf", RTF), ("c.txt", "от Иванов (7707083893)".encode())], FILE)
    pairs = s.rows(PAIRS, "value string, token string")
    hidden = sinks.masked_files(original, pairs, scrub=False)
    shown = sinks.restored_files(hidden, pairs)
    text = lambda f, c: sources.full_text(sources.places(f.select(*keys, "content")), False, keys).withColumnRenamed("text", c)
    both = text(original, "was").join(text(hidden, "text"), list(keys)).join(text(shown, "now"), list(keys))
    return both.withColumn("same", F.col("was") == F.col("now"))

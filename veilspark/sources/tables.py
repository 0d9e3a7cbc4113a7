"""Documents that come as tables: words of PDF pages, page measures, file lists, pasted texts, sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout

FILE = "struct<input:string,section:string,size:bigint,added:double,status:string,output:string,extra:string,error:string>"
#: How much of a sheet a preview shows.
ROWS, COLUMNS = 800, 40


def page_texts(words: DataFrame) -> DataFrame:
    """(doc_id, page, text, owners): a page's words in order, a blank between words of one block and a line break between
    blocks; ``owners`` are (start, n): where each word stands. words: doc_id, page, n, block, word."""
    each = words.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("n", "block", "word"))).alias("w"))
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("int").alias("block"), F.array().cast("array<struct<start:int,n:int>>").alias("owners"))

    def step(a, x):
        sep = F.when(a["block"].isNull(), "").when(a["block"] == x["block"], " ").otherwise("\n")
        owner = F.struct((F.length(a["text"]) + F.length(sep)).alias("start"), x["n"].cast("int").alias("n"))
        return F.struct(F.concat(a["text"], sep, x["word"]).alias("text"), x["block"].cast("int").alias("block"), F.concat(a["owners"], F.array(owner)).alias("owners"))

    return each.select("doc_id", "page", F.aggregate("w", start, step).alias("p")).select("doc_id", "page", "p.text", "p.owners")


def digital(pages: DataFrame, most: float = 0.3) -> DataFrame:
    """(doc_id, digital): whether every page has a readable text layer and pictures on at most ``most`` of its area.
    pages: doc_id, page, text, area, covered."""
    good = (F.trim("text") != "") & layout.text_layer_ok("text") & ~((F.col("area") > 0) & (F.col("covered") / F.col("area") > most))
    return pages.groupBy("doc_id").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("digital"))


#: Settings: their defaults and what else they may be. Fixed values.
SETTINGS = {
    "org_quotes": ("always", "keep"), "org_opf": ("context", "always", "never"), "highlight_case": (True, False), "pdf_to_word": (True, False),
    "keep_pdf": (False, True), "retention_days": (30, 7, 90), "use_llm": (False, True),
}
SETTING_TYPES = {str: "STRING", bool: "BOOLEAN", int: "BIGINT"}


def settings(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Rows with a column a setting, read from JSON; what is missing, of another type or not allowed has its default, and
    so has everything in a body that can't be read."""
    parsed = F.try_parse_json(body)
    new = {}
    for name, allowed in SETTINGS.items():
        kind = SETTING_TYPES[type(allowed[0])]
        raw = F.try_variant_get(parsed, f"$.{name}", "variant")
        value = F.when(F.schema_of_variant(raw) == kind, F.try_variant_get(parsed, f"$.{name}", kind.lower()))
        new[name] = F.when(value.isin(*allowed), value).otherwise(F.lit(allowed[0]))
    return bodies.withColumns(new)


def file_list(manifests: DataFrame) -> DataFrame:
    """(session_id, input, section, status, output, extra): entries of file lists (session_id, body), of either version;
    the older one, {input: {mode: output}}, is read as finished files; unreadable bodies have none."""
    new = F.from_json("body", f"v int, files array<{FILE}>")
    old = F.from_json("body", "map<string,map<string,string>>")
    v2 = manifests.select("session_id", new.alias("m")).where("m.v = 2").select("session_id", F.explode("m.files").alias("f")).select("session_id", "f.input", "f.section", "f.status", "f.output", "f.extra")
    modes = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.col("o")[m].alias("output"), F.col("o")[m + "_pdf"].alias("extra")) for m, s in (("anonymize", "anon"), ("deanonymize", "restore"))]))
    v1 = manifests.where(F.coalesce(new["v"], F.lit(1)) != 2).select("session_id", F.explode(old).alias("input", "o")).select("session_id", "input", modes.alias("x")).where("x.output IS NOT NULL AND x.output <> ''")
    return v2.unionByName(v1.select("session_id", "input", "x.section", F.lit("done").alias("status"), "x.output", "x.extra"))


def pasted(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """(session_id, doc_id, place_no, text): pasted texts, a place a line."""
    rows = spark.createDataFrame(texts, "session_id string, text string")
    return rows.select("session_id", F.lit("__text__").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("place_no", "text"))


def sheet_preview(cells: DataFrame) -> DataFrame:
    """Cells (doc_id, sheet, row, col, text) of the first rows and columns, which a preview shows."""
    return cells.where((F.col("row") <= ROWS) & (F.col("col") <= COLUMNS))

"""Reading order of recognised lines, and repairs of converted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reading_order(lines: DataFrame) -> DataFrame:
    """(page_id, text): lines (page_id, line_id, text, x0, y0, x1, y1, width) in reading order.

    A right column is one that at least four lines begin in. A row is lines whose middles are within half a line's
    height; rows of a column go down, lines of a row to the right. A gap under 1.2 heights without an ending sign goes
    on with a space, else with a line break.
    """
    page = Window.partitionBy("page_id")
    right = F.col("x0") >= 0.45 * F.col("width")
    rows = lines.withColumn("col", F.when((F.sum(right.cast("int")).over(page) >= 4) & right, 1).otherwise(0)).withColumns({"mid": (F.col("y0") + F.col("y1")) / 2, "h": F.col("y1") - F.col("y0")})
    down = Window.partitionBy("page_id", "col").orderBy("mid", "x0", "line_id")
    starts = F.coalesce((F.col("mid") - F.lag("mid").over(down) >= 0.5 * F.col("h")).cast("int"), F.lit(1))
    rows = rows.withColumn("new", starts).withColumn("row", F.sum("new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    order = Window.partitionBy("page_id").orderBy("col", "row", "x0", "line_id")
    prev = lambda c: F.lag(c).over(order)
    ph = F.greatest(prev("y1") - prev("y0"), F.lit(1.0))
    gap = F.col("y0") - prev("y1")
    same = (F.abs(F.col("mid") - prev("mid")) < 0.5 * ph) | ((gap >= -0.8 * ph) & (gap < 1.2 * ph) & (F.abs(F.col("x0") - prev("x0")) < 6 * ph) & ~F.rtrim(prev("text")).rlike("[.:;]$"))
    rows = rows.withColumns({"sep": F.when(prev("text").isNull(), "").when(same, " ").otherwise("\n"), "n": F.row_number().over(order)})
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat("sep", "text").alias("t")))), lambda x: x["t"]), "").alias("text"))


def glued_words(words: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, glued, parted): words of a converted text that were two neighbours in the original and never one.

    words: doc_id, n, word (of the original, in order); texts: doc_id, word (of the converted text). At least four
    letters, not after a hyphen.
    """
    w = Window.partitionBy("doc_id").orderBy("n")
    pairs = words.withColumn("next", F.lead("word").over(w)).where(F.col("next").isNotNull() & ~F.col("word").endswith("-"))
    pairs = pairs.select("doc_id", F.concat("word", "next").alias("glued"), F.concat_ws(" ", "word", "next").alias("parted")).where(F.length("glued") >= 4).distinct()
    pairs = pairs.join(words.select("doc_id", F.col("word").alias("glued")), ["doc_id", "glued"], "left_anti")
    return pairs.join(texts.select("doc_id", F.col("word").alias("glued")).distinct(), ["doc_id", "glued"], "left_semi")


def unglued(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, text): converted texts with glued words (doc_id, glued, parted) parted again."""
    table = pairs.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("glued", "parted"))).alias("m_"))
    pieces = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), 0)
    fixed = F.array_join(F.transform(pieces, lambda w: F.coalesce(F.element_at("m_", w), w)), "")
    return texts.join(table, "doc_id", "left").select("doc_id", F.when(F.col("m_").isNull(), F.col("text")).otherwise(fixed).alias("text"))


def text_layer_ok(text, known: Column | None = None) -> Column:
    """Whether a text layer can be trusted: under 15 words always; else at most 15 % of words with a capital inside a
    word, and, given the share of Cyrillic words that are known, at least half of them."""
    t = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(t, F.lit(r"[A-Za-zА-Яа-яЁё]{3,}"), 0)
    camel = F.size(F.filter(words, lambda w: w.rlike("[a-zа-яё][A-ZА-ЯЁ]")))
    ok = camel <= 0.15 * F.size(words)
    if known is not None:
        ok = ok & ((F.size(F.filter(words, lambda w: w.rlike("[А-Яа-яЁё]"))) < 15) | (known >= 0.5))
    return (F.size(words) < 15) | ok


def is_heading(text) -> Column:
    """All capitals, at least four letters and two words, without quotes."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    letters = F.regexp_replace(t, r"(?U)[^\p{L}]", "")
    return (F.length(letters) >= 4) & (F.upper(letters) == letters) & ~t.rlike('[«»"“”]') & (F.size(F.regexp_extract_all(t, F.lit(r"\p{L}+"), 0)) >= 2)


def packed_blocks(lines: DataFrame, size: int) -> DataFrame:
    """(doc_id, block, text): a document's lines packed in order into blocks of at most ``size`` characters; a longer
    line is a block of its own. An ordered fold of each document's lengths, in the JVM."""
    each = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("v"))
    start = F.struct(F.lit(0).alias("block"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(a, x):
        n = F.length(x["line"]) + 1
        fits = (a["used"] == 0) | (a["used"] + n <= size)
        block = F.when(fits, a["block"]).otherwise(a["block"] + 1)
        return F.struct(block.alias("block"), F.when(fits, a["used"] + n).otherwise(n).alias("used"), F.concat(a["out"], F.array(block)).alias("out"))

    numbers = F.aggregate("v", start, step, lambda a: a["out"])
    rows = each.select("doc_id", F.explode(F.arrays_zip(F.col("v"), numbers.alias("b"))).alias("x")).select("doc_id", "x.v.line_no", "x.v.line", F.col("x.b").alias("block"))
    return rows.groupBy("doc_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))

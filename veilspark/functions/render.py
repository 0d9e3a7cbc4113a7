"""Putting values into text and files: contexts of a place, companies and names in new text, escapes, shares of boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from . import patterns as P
from . import text as T

# ---- Fixed values: words after which a company needs no legal form; what stands before file names ---
ORG_NOUNS = (
    "компания", "общество", "организация", "фирма", "банк", "фонд", "предприятие", "учреждение", "партнерство", "товарищество", "кооператив", "группа", "холдинг", "корпорация", "контрагент",
    "ответственность", "ассоциация", "союз", "агентство", "центр", "завод", "концерн",
)
STEM_PREFIXES, STEM_SUFFIXES = ("anonymized_", "deanonymized_", "anon_", "deanon_"), ("_anon", "_restored", " (данные возвращены)")
LEFT, RIGHT = 120, 60


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def line_window(text, start, end) -> Column:
    """struct(left, right): at most 120 characters before and 60 after a place, inside its line."""
    t, s, e = _c(text), _c(start), _c(end)
    left = F.substring_index(F.substring(t, F.greatest(s - LEFT, F.lit(0)) + 1, F.least(s, F.lit(LEFT))), "\n", -1)
    right = F.substring_index(F.substring(t, e + 1, F.lit(RIGHT)), "\n", 1)
    return F.struct(left.alias("left"), right.alias("right"))


def org_in_text(name, form, before, after, quotes: str = "always", forms: str = "context") -> Column:
    """A company in new text: its name alone inside quotes; else in quotes, with its legal form if nothing before tells it."""
    n, f, b, a = _c(name), F.coalesce(_c(form), F.lit("")), _c(before), _c(after)
    inside = b.rlike("[«\"“„'][*]*\\s*$") & a.rlike("^\\s*[*]*[»\"”“']")
    said = F.concat(F.lit("«"), n, F.lit("»")) if quotes == "always" else n
    last = F.element_at(F.regexp_extract_all(F.right(b, F.lit(40)), F.lit("[А-ЯЁа-яёA-Za-z]+"), 0), -1)
    last = F.when(F.right(b, F.lit(40)).rlike("[А-ЯЁа-яёA-Za-z]"), last).otherwise("")
    told = last.rlike("^(?:" + P.SHORT_FORMS + ")$") | T.folded(last).rlike(L._stems(ORG_NOUNS))
    alone = (f != "") & ~told & F.lit(forms != "never")
    return F.when(n.rlike('[«"“„]') | inside, n).when(alone, F.concat(f, F.lit(" "), said)).otherwise(said)


def legal_form_before(text, start) -> Column:
    """The short legal form right before a place, or empty."""
    left = T.left_context(text, start, 60)
    short = F.regexp_extract(left, "(" + P.SHORT_FORMS + ")[^\\S\\n]*[«\"“„']?[^\\S\\n]*$", 1)
    full = F.regexp_extract(left, "(?iU)((?:" + "|".join(p for p, _ in P.FORM_FULL_TO_SHORT) + ")[^«\"“„'\\n]*?)[^\\S\\n]*[«\"“„']?[^\\S\\n]*$", 1)
    return F.when(short != "", short).otherwise(T.short_form(full))


def context_line(text, value, width: int = 160) -> Column:
    """The line of the value's first occurrence, cut round it if it is long, white space collapsed; empty without one."""
    t, v = _c(text), _c(value)
    at = F.call_function("locate", v, t, F.lit(1))
    before = F.substring_index(F.substring(t, F.lit(1), at - 1), "\n", -1)
    line = F.concat(before, F.substring_index(F.substring(t, at, F.length(t)), "\n", 1))
    from_ = F.greatest(F.lit(0), F.length(before) - width // 2)
    cut = F.substring(line, from_ + 1, F.length(before) + F.length(v) + width // 2 - from_)
    return F.when((at == 0) | (v == ""), "").otherwise(T.squashed(F.when(F.length(line) > width, cut).otherwise(line)))


def escaped_rtf(value) -> Column:
    """ASCII as it is, signs of the format behind a backslash, other characters as signed 16-bit numbers in a group of
    their own. Characters beyond 16 bits are written as they are numbered."""
    chars = F.split(_c(value), "")
    code = lambda c: F.when(F.ascii(c) < 32768, F.ascii(c)).otherwise(F.ascii(c) - 65536)
    one = lambda c: F.when(c.isin("\\", "{", "}"), F.concat(F.lit("\\"), c)).when(F.ascii(c) < 128, c).otherwise(F.concat(F.lit("\\u"), code(c).cast("string"), F.lit("?")))
    whole = F.array_join(F.transform(F.filter(chars, lambda c: c != ""), one), "")
    return F.when(_c(value).rlike(r"[^\x00-\x7f]"), F.concat(F.lit("{\\uc1 "), whole, F.lit("}"))).otherwise(whole)


def shared_out(value, widths) -> Column:
    """The value's words dealt to boxes in proportion to their widths; the last box takes what is left."""
    w, b = F.split(F.trim(_c(value)), r"\s+"), _c(widths)
    n, k = F.size(w), F.size(b)
    total = F.aggregate(b, F.lit(0.0), lambda a, x: a + x)
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("acc"), F.lit(0).alias("i"), F.array().cast("array<string>").alias("out"))

    def step(a, x):
        acc, i = a["acc"] + x, a["i"] + 1
        end = F.when(i == k, n).otherwise(F.greatest(a["at"], F.least(n, F.bround(n * acc / total).cast("int"))))
        return F.struct(end.alias("at"), acc.alias("acc"), i.alias("i"), F.concat(a["out"], F.array(F.array_join(F.slice(w, a["at"] + 1, end - a["at"]), " "))).alias("out"))

    one = F.concat(F.array(_c(value)), F.array_repeat(F.lit(""), k - 1))
    return F.when((k == 1) | (n < 2), one).otherwise(F.aggregate(b, start, step, lambda a: a["out"]))


def safe_name(name) -> Column:
    """A file name without separators and control characters, at most 180 long; ``document`` if nothing is left."""
    t = F.trim(F.regexp_replace(_c(name), r'[\\/:*?"<>|\x00-\x1f]', "_"), F.lit(" ."))
    return F.when(F.left(t, F.lit(180)) == "", "document").otherwise(F.left(t, F.lit(180)))


def clean_stem(stem) -> Column:
    """A file's stem without what the engine itself put before and after it."""
    t = _c(stem)
    for p in STEM_PREFIXES:
        t = F.when(F.lower(t).startswith(p), F.substring(t, len(p) + 1, 10_000)).otherwise(t)
    for s in STEM_SUFFIXES:
        t = F.when(t.endswith(s), F.left(t, F.length(t) - len(s))).otherwise(t)
    return t


def key_parts(value) -> Column:
    """The keys a value is masked by: itself and, if it has line breaks, each of its lines of three characters and more."""
    lines = F.filter(F.transform(F.split(_c(value), "\n"), F.trim), lambda x: F.length(x) >= 3)
    return F.when(_c(value).contains("\n"), F.array_distinct(F.concat(F.array(_c(value)), lines))).otherwise(F.array(_c(value)))


def broken_pattern(value) -> Column:
    """A pattern of a value with any white space between its words."""
    words = F.filter(F.split(F.trim(_c(value)), r"\s+"), lambda x: x != "")
    quoted = F.transform(words, lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit("")), F.lit(r"\E")))
    return F.concat(F.lit(r"(?U)(?<!\w)"), F.array_join(quoted, r"\s+"), F.lit(r"(?!\w)"))


def broken_occurrences(text, value) -> Column:
    """Occurrences of a value of two words and eight characters that a line break parts, into parts of five and more."""
    v = _c(value)
    fits = (F.length(v) >= 8) & v.rlike(r"\S\s+\S") & ~v.contains("\n")
    found = F.array_distinct(F.regexp_extract_all(_c(text), broken_pattern(v), F.lit(0)))
    kept = F.filter(found, lambda x: x.contains("\n") & F.forall(F.split(x, "\n"), lambda p: F.length(F.trim(p)) >= 5))
    return F.when(fits, kept).otherwise(F.array().cast("array<string>"))


def flat_places(text, value) -> Column:
    """(start, end) of a value in a text where runs of blanks and line breaks count as one blank."""
    words = F.filter(F.split(F.trim(_c(value)), r"[ \t\n]+"), lambda x: x != "")
    pattern = F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))), r"[ \t\n]+")
    found = F.regexp_extract_all(_c(text), pattern, F.lit(0))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a, m):
        s = F.call_function("locate", m, _c(text), a["at"] + 1) - 1
        e = (s + F.length(m)).cast("int")
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(s.cast("int").alias("start"), e.alias("end")))).alias("out"))

    return F.when(F.size(words) > 0, F.aggregate(found, first, step, lambda a: a["out"])).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def best_run(start, end, widths) -> Column:
    """Which of neighbouring runs (by their lengths, from 0) holds most of [start, end); the first of equals."""
    s, e, w = _c(start), _c(end), _c(widths)
    offsets = F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.aggregate(F.slice(w, F.lit(1), i), F.lit(0), lambda a, x: a + x))
    share = F.zip_with(offsets, w, lambda o, n: F.greatest(F.lit(0), F.least(e, o + n) - F.greatest(s, o)))
    return F.array_position(share, F.array_max(share)) - 1


def spliced(pieces, start, end, value) -> Column:
    """The texts of neighbouring runs after [start, end) became the value: it goes to the run that holds most of it."""
    p, s, e = _c(pieces), _c(start), _c(end)
    widths = F.transform(p, F.length)
    best = best_run(s, e, widths)
    offset = lambda i: F.aggregate(F.slice(widths, F.lit(1), i), F.lit(0), lambda a, x: a + x)

    def one(x, i):
        a, b = F.greatest(s - offset(i), F.lit(0)), F.least(e - offset(i), F.length(x))
        cut = F.concat(F.substring(x, F.lit(1), a), F.when(i == best, _c(value)).otherwise(""), F.substring(x, b + 1, F.length(x)))
        return F.when((offset(i) < e) & (offset(i) + F.length(x) > s), cut).otherwise(x)

    return F.transform(p, one)

import pytest
from pyspark.sql import functions as F

from veilspark.functions import grammar as G
from veilspark.operators import layout

M, W = "Белозёров Аркадий Львович", "Скворцова Елена Дмитриевна"


@pytest.mark.parametrize("name,case,want", [
    (M, "gent", "Белозёрова Аркадия Львовича"), (M, "datv", "Белозёрову Аркадию Львовичу"), (M, "ablt", "Белозёровым Аркадием Львовичем"), (M, "loct", "Белозёрове Аркадии Львовиче"),
    ("Белозёрова Аркадия Львовича", "nomn", M), (W, "gent", "Скворцовой Елены Дмитриевны"), (W, "accs", "Скворцову Елену Дмитриевну"), (W, "ablt", "Скворцовой Еленой Дмитриевной"), (W, "nomn", W),
    ("Зелинский Олег Петрович", "datv", "Зелинскому Олегу Петровичу"), ("Зелинская Ольга Петровна", "gent", "Зелинской Ольги Петровны"), ("Шевченко Пётр Ильич", "datv", "Шевченко Петру Ильичу"),
    ("А.Л. Белозёров", "datv", "А.Л. Белозёрову"), ("БЕЛОЗЁРОВ АРКАДИЙ ЛЬВОВИЧ", "ablt", "БЕЛОЗЁРОВЫМ АРКАДИЕМ ЛЬВОВИЧЕМ"), ("Иванов Иван Иванович", "ablt", "Ивановым Иваном Ивановичем"), (M, "??", M),
])
def test_decline(name, case, want):
    assert G.declined(name, case) == want


@pytest.mark.parametrize("left,right,case", [
    ("", " подписал договор.", "nomn"), ("Сторона: ", "", "nomn"), ("Документы получены от ", ".", "gent"), ("Подлинник хранится у ", ".", "gent"), ("Письмо направить ", " до пятницы.", "datv"),
    ("Требование к ", " не предъявлялось.", "datv"), ("Необходимо уведомить ", " о сделке.", "accs"), ("Договор заключён с ", ".", "ablt"), ("Сведения о ", " устарели.", "loct"),
    ("Общество в лице ", ", действующего на основании", "gent"), ("Кроме того, ", " подписал акт.", "nomn"), ("Риск связан с тем, что ", " может", None), ("Удостоверено нотариусом ", ".", "ablt"),
    ("обязательств Индивидуального предпринимателя ", " перед Заказчиком", "gent"), ("Генеральный директор ", " контролирует", "nomn"),
])
def test_target_case(left, right, case):
    assert G.case_needed(left, right) == case


def test_case_of_form():
    assert G.case_of_form(M, "Белозёрову Аркадию Львовичу") == "datv" and G.case_of_form(M, "кто-то") is None


def test_columns(spark):
    df = spark.createDataFrame([(M, "datv"), (None, "gent")], "n string, c string")
    assert [r[0] for r in df.select(G.decline("n", "c")).collect()] == ["Белозёрову Аркадию Львовичу", None]
    df = spark.createDataFrame([("от ", ".")], "l string, r string")
    assert df.select(G.target_case("l", "r")).first()[0] == "gent"


def test_layout_two_columns(spark):
    rows = [(1, i, f"L{i}.", 0.0, i * 20.0, 90.0, i * 20.0 + 10, 200.0) for i in range(4)] + [(1, 10 + i, f"R{i}.", 100.0, i * 20.0, 190.0, i * 20.0 + 10, 200.0) for i in range(4)] + [(2, 1, "one", 0.0, 0.0, 50.0, 10.0, 200.0), (2, 2, "two", 0.0, 12.0, 50.0, 22.0, 200.0)]
    df = spark.createDataFrame(rows, "page_id int, line_id int, text string, x0 double, y0 double, x1 double, y1 double, width double")
    got = {r["page_id"]: r["text"] for r in layout.reading_order(df).collect()}
    assert got == {1: "\n".join([f"L{i}." for i in range(4)] + [f"R{i}." for i in range(4)]), 2: "one two"}


def test_blocks_and_glued(spark):
    lines = spark.createDataFrame([(1, 0, "aaaa"), (1, 1, "bbbb"), (1, 2, "c" * 30), (1, 3, "d")], "doc_id int, line_no int, line string")
    assert [r["text"] for r in layout.packed_blocks(lines, 10).orderBy("block").collect()] == ["aaaa\nbbbb", "c" * 30, "d"]
    words = spark.createDataFrame([(1, 0, "по"), (1, 1, "делу"), (1, 2, "подел"), (1, 3, "ка")], "doc_id int, n int, word string")
    texts = spark.createDataFrame([(1, "поделу"), (1, "другое")], "doc_id int, word string")
    assert [(r["glued"], r["parted"]) for r in layout.glued_words(words, texts).collect()] == [("поделу", "по делу")]
    df = spark.createDataFrame([("ОБЩИЕ ПОЛОЖЕНИЯ",), ("Общие положения",), ("ООО «А»",)], "t string")
    assert [r[0] for r in df.select(layout.is_heading("t")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(layout.text_layer_ok(F.lit("слОво " * 20))).collect()][:1] == [False]

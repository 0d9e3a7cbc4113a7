import io
import zipfile

import pytest

from veilspark.functions import text as T
from veilspark.functions import validators as V
from veilspark.operators import entities, masking
from veilspark.plans import anonymize
from veilspark.sources import files
from veilspark.streaming import sessions

GOLDEN = [
    ("inn", "7707083893", True), ("inn", "7736207543", True), ("inn", "1869879737", True), ("inn", "711417075366", True), ("inn", "7701234567", False), ("ogrn", "1455681518841", True), ("ogrn", "1027700000000", False),
    ("snils", "880-932-081 28", True), ("snils", "123-456-789 00", False), ("iban", "DE89 3704 0044 0532 0130 00", True), ("iban", "GB82WEST12345698765432", True), ("iban", "DE89 3704 0044 0532 0130 01", False),
    ("luhn", "4276 3800 1234 5679", True), ("luhn", "4276 3800 1234 5674", False), ("inn", None, False), ("iban", "", False),
]


@pytest.mark.parametrize("kind,value,want", GOLDEN)
def test_validators(spark, kind, value, want):
    from veilspark.functions import numbers

    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(getattr(V, kind)("v").alias("x")).first()["x"] == want
    assert value is None or numbers.holds(kind, value) == want


def test_account(spark):
    df = spark.createDataFrame([("40702810557616987168", "041588139"), ("30101810197684697139", "041588139"), ("40702810557616987169", "041588139")], "a string, b string")
    assert [r[0] for r in df.select(V.account_with_bik("a", "b")).collect()] == [True, True, False]


def test_mask_boundaries(spark):
    r = masking.Replacer({"123456": "[PASSPORT_1]", "Иванов": "[FIO_1]", "Иванов Пётр": "[FIO_2]"})
    for t in ("1234567", "Ивановская", "Ивановский"):
        assert r.apply(t) == t
    assert r.apply("№123456, Иванов Пётр и Иванов") == "№[PASSPORT_1], [FIO_2] и [FIO_1]"


def test_loose_tokens(spark):
    df = spark.createDataFrame([("[FIO_1] FIO_1 [FIO 1] [FIO-1] [fio_1] [ФИО_1] FIO_10 XFIO_1",)], "t string")
    assert df.select(T.tokens_in("t")).first()[0] == ["FIO_1"] * 6 + ["FIO_10"]


def test_same_entity(spark):
    rows = [("FIO_1", "Иванов Пётр Сергеевич", "ФИО"), ("FIO_2", "Иванова П.С.", "ФИО"), ("FIO_3", "Иванов Олег Петрович", "ФИО"), ("TEL_1", "+7 (912) 345-67-89", "ТЕЛЕФОН"), ("TEL_2", "8 912 345 67 89", "ТЕЛЕФОН"), ("TEL_3", "89123456780", "ТЕЛЕФОН"),
            ("ADR_1", "г.Москва, ул. Лесная, д.5", "АДРЕС"), ("ADR_2", "Москва г., Лесная ул., д. 5", "АДРЕС"), ("ADR_3", "г. Москва, ул. Лесная, д. 7", "АДРЕС"), ("ADR_4", "г. Москва, ул. Лесная, д. 5, кв. 1", "АДРЕС"),
            ("YUL_1", 'ООО "Вектор Трейд"', "ЮЛ"), ("YUL_2", "ВЕКТОР ТРЕЙД", "ЮЛ"), ("YUL_3", "Вектор Трейд Плюс", "ЮЛ"), ("YUL_4", "Вектор Трейт", "ЮЛ")]
    m = spark.createDataFrame([("s", t, f, k, "active") for t, f, k in rows], "session_id string, token string, original_form string, entity_type string, status string")
    got = {r["token"]: r["kept"] for r in entities.auto_groups(m).collect()}
    assert got == {"FIO_1": "FIO_1", "FIO_2": "FIO_1", "TEL_1": "TEL_1", "TEL_2": "TEL_1", "ADR_1": "ADR_1", "ADR_2": "ADR_1", "YUL_1": "YUL_1", "YUL_2": "YUL_1"}
    apart = spark.createDataFrame([("s", "TEL_1", "TEL_2")], "session_id string, a string, b string")
    assert "TEL_1" not in {r["token"] for r in entities.auto_groups(m, apart).collect()}
    pairs = {(r["a"], r["b"]) for r in entities.review_pairs(m).collect()}
    assert ("ADR_1", "ADR_4") in pairs and ("YUL_1", "YUL_4") in pairs and ("ADR_1", "ADR_3") not in pairs and not any(a.startswith("TEL") for a, _ in pairs)


def test_round_trip(spark):
    docs = spark.createDataFrame([("s", 1, "Иванов Пётр Сергеевич, тел. +7 (912) 345-67-89"), ("s", 2, "звонил +7 (912) 345-67-89 от a@b.ru"), ("s", 3, None), ("t", 4, "почта a@b.ru")], "session_id string, doc_id long, text string")
    masked, pairs = anonymize.anonymize(docs)
    out = {r["doc_id"]: r["masked"] for r in masked.collect()}
    assert out == {1: "[FIO_1], тел. [TEL_1]", 2: "звонил [TEL_1] от [EMAIL_1]", 3: None, 4: "почта [EMAIL_1]"}
    back = {r["doc_id"]: r["restored"] for r in anonymize.restore(masked, pairs).collect()}
    assert back == {r["doc_id"]: r["text"] for r in docs.collect()}
    assert anonymize.leak_check(masked, pairs).count() == 0


def _zip(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return b.getvalue()


def test_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    (tmp_path / "a.docx").write_bytes(_zip({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>Ива</w:t></w:r><w:ins><w:r><w:t>нов</w:t></w:r></w:ins><w:del><w:r><w:delText>x</w:delText></w:r></w:del><w:r><w:tab/></w:r></w:p></w:body></w:document>", "docProps/core.xml": "<c><creator>Автор</creator></c>"}))
    (tmp_path / "b.xlsx").write_bytes(_zip({"xl/workbook.xml": '<w><sheets><sheet name="Лист"/></sheets></w>', "xl/sharedStrings.xml": "<sst><si><t>слово</t></si></sst>", "xl/worksheets/sheet1.xml": '<w><c t="s"><v>0</v></c><c><v>99999</v></c><c><v>100000</v></c></w>'}))
    (tmp_path / "c.rtf").write_bytes(b"{\\rtf1\\ansi\\ansicpg1251{\\fonttbl{\\f0 Arial;}}\\uc1\\u1048?\\'e2\\par end\\~x}")
    (tmp_path / "d.txt").write_bytes(b"ok\xff")
    (tmp_path / "e.docx").write_bytes(b"not a zip")
    got = {}
    for r in files.read_places(spark, f"file://{tmp_path}").collect():
        got.setdefault(r["path"].rsplit("/", 1)[-1], []).append((r["kind"], r["text"]))
    assert got == {
        "a.docx": [("property", "Автор"), ("paragraph", "Иванов\t")], "b.xlsx": [("sheet", "Лист"), ("cell", "слово"), ("number", "100000")],
        "c.rtf": [("text", "Ив\nend\xa0x")], "d.txt": [("text", "ok�")], "e.docx": [("error", "BadZipFile")],
    }
    assert {r["text"] for r in files.full_text(files.read_places(spark, f"file://{tmp_path}"), meta=False).collect()} >= {"Иванов\t", "слово\n100000"}


def test_stream_keeps_numbers(spark, tmp_path):
    schema = "session_id string, value string, type string, prefix string, seen long"
    for k, rows in enumerate([[("s", "a", "EMAIL", "EMAIL", 1), ("s", "b", "EMAIL", "EMAIL", 2)], [("s", "a", "EMAIL", "EMAIL", 3), ("s", "c", "EMAIL", "EMAIL", 4), ("t", "a", "EMAIL", "EMAIL", 5)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = sessions.session_tokens(stream).writeStream.format("memory").queryName("tokens").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("tokens").collect())) == [("s", "a", "EMAIL", "EMAIL_1"), ("s", "b", "EMAIL", "EMAIL_2"), ("s", "c", "EMAIL", "EMAIL_3"), ("t", "a", "EMAIL", "EMAIL_1")]


def test_restore_new_text(spark):
    texts = spark.createDataFrame([("s", 1, "Письмо направить [FIO_1] до пятницы. Сторона: [YUL_1], [INN_9]."), ("s", 2, "без них"), ("t", 3, None)], "session_id string, doc_id int, text string")
    values = spark.createDataFrame([("s", "FIO_1", "Белозёров Аркадий Львович"), ("s", "YUL_1", "Вектор")], "session_id string, token string, value string")
    got = {r["doc_id"]: r for r in anonymize.restore_new_text(texts, values).collect()}
    assert got[1]["restored"] == "Письмо направить Белозёрову Аркадию Львовичу до пятницы. Сторона: «Вектор», [INN_9]."
    assert [m["mark"] for m in got[1]["marks"]] == ["case", "exact", "unknown"]
    assert got[2]["restored"] == "без них" and got[3]["restored"] is None and got[2]["marks"] == []


def test_mask_finds_runs_inside_words(spark):
    docs = spark.createDataFrame([("s", 1, "No40702810 и БИК044,7a x12 «Вектор» Векторы")], "session_id string, doc_id int, text string")
    pairs = spark.createDataFrame([("s", "40702810", "RS_1"), ("s", "044", "BIK_1"), ("s", "12", "N_1"), ("s", "Вектор", "YUL_1")], "session_id string, value string, token string")
    assert masking.mask(docs, pairs).first()["masked"] == "No[RS_1] и БИК[BIK_1],7a x[N_1] «[YUL_1]» Векторы"
    assert {r["value"] for r in masking.leaks(docs, pairs).collect()} == {"40702810", "044", "12", "Вектор"}


def test_leaks_are_not_capped(spark):
    values = [f"u{i}@a.com" for i in range(250)]
    docs = spark.createDataFrame([("s", 1, " ".join(values))], "session_id string, doc_id long, text string")
    pairs = spark.createDataFrame([("s", v) for v in values], "session_id string, value string")
    assert masking.leaks(docs, pairs).count() == 250 and masking.leaks(docs, pairs, limit=200).count() == 200


def test_rewritten_files(spark, tmp_path):
    from veilspark.sinks import files as out

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = _zip({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>Продавец Ива</w:t></w:r><w:r><w:t>нов и всё</w:t></w:r></w:p></w:body></w:document>", "docProps/core.xml": "<c><creator>Автор</creator></c>", "word/media/x.bin": b"\x00"})
    raw = b"{\\rtf1\\ansi\\ansicpg1251\\uc1 a \\u1048?\\u1074?\\'e0\\'ed\\'ee\\'e2 {\\b b}}"
    rows = [("s", "a.docx", docx), ("s", "b.rtf", raw), ("s", "c.txt", "Иванов, Ивановский".encode()), ("s", "d.docx", b"bad"), ("s", "e.exe", b"x"), ("t", "f.txt", "Иванов".encode())]
    df = spark.createDataFrame(rows, "session_id string, path string, content binary")
    pairs = spark.createDataFrame([("s", "Иванов", "FIO_1")], "session_id string, value string, token string")
    got = {r["path"]: (r["content"], r["error"]) for r in out.masked_files(df, pairs).collect()}
    (tmp_path / "a.docx").write_bytes(got["a.docx"][0])
    (tmp_path / "b.rtf").write_bytes(got["b.rtf"][0])
    back = sorted((r["path"].rsplit("/", 1)[-1], r["kind"], r["text"]) for r in files.read_places(spark, f"file://{tmp_path}").collect())
    assert back == [("a.docx", "paragraph", "Продавец [FIO_1] и всё"), ("b.rtf", "text", "a [FIO_1] b")]
    with zipfile.ZipFile(io.BytesIO(got["a.docx"][0])) as z:
        assert z.read("word/media/x.bin") == b"\x00" and "Автор" not in z.read("docProps/core.xml").decode()
    assert got["c.txt"] == ("[FIO_1], Ивановский".encode(), None) and got["d.docx"] == (None, "BadZipFile") and got["e.exe"] == (None, "format") and got["f.txt"][0] == "Иванов".encode()
    assert out.rtf_escape("Ж{😀") == b"{\\uc1 \\u1046?\\{\\u-10179?\\u-8704?}" and out.rtf_escape("a\\b") == b"a\\\\b"
    assert out.fitted(["[", "FIO_1] тут"], [(0, 7, "Иванов")]) == ["", "Иванов тут"] and out.fitted(["ab", "cd"], [(1, 3, "X"), (0, 1, "Y")]) == ["YX", "d"]
    z = out.zipped(spark.createDataFrame([("s", "b.txt", b"2"), ("s", "a.txt", b"1")], "session_id string, entry string, content binary")).first()["archive"]
    assert [zipfile.ZipFile(io.BytesIO(z)).read(n) for n in ("a.txt", "b.txt")] == [b"1", b"2"]


def test_write_text(spark, tmp_path):
    files.write_text(spark.createDataFrame([("a", "one\ntwo"), ("b", "x")], "name string, text string"), f"file://{tmp_path}/t")
    assert {(r["name"], r["value"]) for r in spark.read.text(f"file://{tmp_path}/t", wholetext=True).collect()} == {("a", "one\ntwo\n"), ("b", "x\n")}

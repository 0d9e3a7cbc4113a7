"""Queries of operators on tables whose results are known by hand, for every supplier as a session of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cases import cases as bench_list
from .functions import text as T
from .golden import quoted
from .operators import entities, layout, masking, orgs, review, store
from .plans import anonymize
from .sinks import files as sinks
from .sources import tables

Q: dict[str, Callable] = {}
SQL: dict[str, str] = {}


class Sessions:
    """Inline rows in the session of every supplier."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.ids = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("session_id"))

    def rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.ids.crossJoin(F.broadcast(self.spark.createDataFrame(rows, schema)))


def known(cols: str, results: list[tuple], per_session: bool = True):
    """A query with these columns, as text, for every session (or once); ``results`` is its SQL."""
    names = cols.split()

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Sessions(spark, sf_dir))
            text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|") if out.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")
            return out.select(*(["session_id"] if per_session else []), *[text(c).alias(c) for c in names])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        Q[f.__name__] = run
        rows = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in results)
        SQL[f.__name__] = f"SELECT {'s.s_suppkey AS session_id, ' if per_session else ''}r.* FROM {'supplier s, ' if per_session else ''}(VALUES {rows}) r({', '.join(f'"{n}"' for n in names)})"
        return f

    return add


MAPPINGS = "id long, token string, original_form string, entity_type string, status string"
PEOPLE = [(1, "FIO_1", "Иванов Пётр Сергеевич", "ФИО", "active"), (2, "FIO_2", "Петров Олег", "ФИО", "active"), (3, "FIO_3", "Петрова Анна", "ФИО", "active"), (4, "YUL_1", "Northwind Trading", "ЮЛ", "active"),
          (5, "YUL_2", "Вектор НТИ", "ЮЛ", "excluded"), (6, "TEL_1", "+7 (912) 345-67-89", "ТЕЛЕФОН", "active")]


# ---- known values and their further names ------------------------------------------------------------------------------
@known("value type token", [("Иванова П.С.", "ФИО", "FIO_1"), ("Петров", "ФИО", None), ("Петрова Анна Юрьевна", "ФИО", "FIO_3"), ("89123456789", "ТЕЛЕФОН", "TEL_1"), ("ООО «NORTHWIND Trading»", "ЮЛ", "YUL_1"), ("Вектор НТИ", "ЮЛ", None), ("Сидоров", "ФИО", None)])
def same_entity_lookup(s):
    values = s.rows([("Иванова П.С.", "ФИО"), ("Петров", "ФИО"), ("Петрова Анна Юрьевна", "ФИО"), ("89123456789", "ТЕЛЕФОН"), ("ООО «NORTHWIND Trading»", "ЮЛ"), ("Вектор НТИ", "ЮЛ"), ("Сидоров", "ФИО")], "value string, type string")
    return store.same_entity(values, s.rows(PEOPLE, MAPPINGS))


@known("surname token", [("иванов", "FIO_1")])
def known_surnames(s):
    return orgs.known_surnames(s.rows(PEOPLE, MAPPINGS))


@known("value token", [("Иванову", "FIO_1"), ("ИВАНОВ", "FIO_1")])
def propagate_surnames(s):
    return orgs.lone_surnames(s.rows([("Передать Иванову и Петрову. ИВАНОВ согласен; Пётр и Петрович нет.",)], "text string"), s.rows(PEOPLE, MAPPINGS))


@known("value token", [("Northwind", "YUL_1"), ("НТИ", "YUL_2")])
def propagate_orgs(s):
    return orgs.company_words(s.rows(PEOPLE, MAPPINGS))


@known("value token", [("NTI", "YUL_1")])
def org_abbreviations(s):
    return orgs.abbreviations(s.rows([("ООО «[YUL_1]» (NTI), «[YUL_2]» (ООО) и [YUL_3] далее",)], "masked string"))


@known("text plate", [("номер А123ВС 77", "А123ВС 77"), ("H385EY ML", "H385EY ML"), ("А123ВС и ещё много слов", "А123ВС"), ("нет номера", None)])
def photo_plates(s):
    return orgs.plates_in_pictures(s.rows([("номер А123ВС 77",), ("H385EY ML",), ("А123ВС и ещё много слов",), ("нет номера",)], "text string"))


@known("value type", [("Вектор", "ЮЛ"), ("Петров Олег", "ФИО")])
def exclusions_by_key_and_person(s):
    found = s.rows([("Вектор", "ЮЛ"), ("ООО Сигма", "ЮЛ"), ("ооо  СИГМА", "ЮЛ"), ("Иванова П.С.", "ФИО"), ("Иванов", "ФИО"), ("Петров Олег", "ФИО"), ("8 912 345-67-89", "ТЕЛЕФОН")], "value string, type string")
    return store.not_excluded(found, s.rows([("ООО Сигма", "ЮЛ"), ("Иванов Пётр Сергеевич", "ФИО"), ("Петрова", "ФИО"), ("+7 (912) 345-67-89", "ТЕЛЕФОН")], "value string, type string"))


# ---- the store ------------------------------------------------------------------------------------------------------------
@known("token original_form status", [("FIO_1", "Иванов Пётр Сергеевич", "active"), ("FIO_3", "Петров Олег", "active"), ("FIO_3", "Петрова Анна", "active"), ("YUL_1", "Northwind Trading", "active"), ("YUL_1", "Вектор НТИ", "active"), ("TEL_1", "+7 (912) 345-67-89", "active")])
def merge_tokens(s):
    return store.merged(s.rows(PEOPLE, MAPPINGS), s.rows([("FIO_2", "FIO_3"), ("YUL_2", "YUL_1")], "old_token string, new_token string"))


@known("token original_form status", [("FIO_1", "Иванов Пётр Сергеевич", "active"), ("FIO_2", "Петров Олег", "active"), ("FIO_3", "Петрова Анна", "active"), ("YUL_1", "Northwind Trading", "active"), ("YUL_1", "Вектор НТИ", "active"), ("TEL_1", "+7 (912) 345-67-89", "active"), ("YUL_1", "NTI", "active")])
def add_alias(s):
    return store.with_forms(s.rows(PEOPLE, MAPPINGS), s.rows([("YUL_1", "Вектор НТИ", "ЮЛ"), ("YUL_1", "NTI", "ЮЛ")], "token string, original_form string, entity_type string"))


@known("token status value", [("YUL_2", "active", None), (None, None, "Сигма")])
def unexclude_token(s):
    bad = s.rows([("вектор  нти", "ЮЛ"), ("Сигма", "ЮЛ")], "value string, type string")
    m, e = store.unexcluded(s.rows(PEOPLE, MAPPINGS), bad, s.rows([("YUL_2",), ("FIO_1",)], "token string"))
    return m.where("token = 'YUL_2'").select("session_id", "token", "status").unionByName(e.select("session_id", "value"), allowMissingColumns=True)


@known("op token value", [("status", "FIO_2", "replaced"), ("status", "FIO_3", "active"), ("find", None, "Петров Олег Ильич"), ("exclude", None, "Петров Олег")])
def edit_mapping(s):
    m, new, old = store.replaced(s.rows(PEOPLE, MAPPINGS), s.rows([("FIO_2", "Петров Олег Ильич", "ФИО"), ("FIO_3", "Петрова Анна", "ФИО")], "token string, value string, type string"))
    a = m.where("token IN ('FIO_2', 'FIO_3')").select("session_id", F.lit("status").alias("op"), "token", F.col("status").alias("value"))
    rest = lambda d, op: d.select("session_id", F.lit(op).alias("op"), F.lit(None).cast("string").alias("token"), "value")
    return a.unionByName(rest(new, "find")).unionByName(rest(old, "exclude"))


@known("token forms status", [("T_1", "a|b", "active"), ("T_2", "c", "excluded")])
def forms_by_token(s):
    return store.forms_by_token(s.rows([(1, "T_1", "a", "ЮЛ", "excluded"), (2, "T_1", "b", "ЮЛ", "active"), (3, "T_1", "a", "ЮЛ", "active"), (4, "T_2", "c", "ЮЛ", "excluded")], MAPPINGS))


def _cascade() -> str:
    return "SELECT CAST(s_suppkey AS BIGINT) AS session_id, t FROM supplier, (VALUES ('mappings'), ('places')) v(t) WHERE s_suppkey % 3 <> 0"


def delete_session_cascade(spark, sf_dir):
    """Every third session goes from all tables."""
    ids = Sessions(spark, sf_dir).ids
    left = store.without_sessions({"mappings": ids, "places": ids}, ids.where("session_id % 3 = 0"))
    return left["mappings"].withColumn("t", F.lit("mappings")).unionByName(left["places"].withColumn("t", F.lit("places")))


Q["delete_session_cascade"], SQL["delete_session_cascade"] = delete_session_cascade, _cascade()


def migration_counts(spark, sf_dir):
    """A migration that loses a row is seen."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return store.reconciled({"nation": read("nation"), "region": read("region")}, {"nation": read("nation").where("n_nationkey <> 3"), "region": read("region")})


Q["migration_counts"] = migration_counts
SQL["migration_counts"] = "SELECT 'nation' AS name, count(*) AS rows_before, count(*) - 1 AS rows_after, false AS same FROM nation UNION ALL SELECT 'region', count(*), count(*), true FROM region"


@known("files files_anon ready_anon files_restore ready_restore expires_in_days", [("3", "2", "1", "1", "0", "21")])
def session_overview(s):
    files = s.rows([("anon", "done"), ("anon", "new"), ("restore", "error")], "section string, status string")
    return store.session_overview(s.ids.withColumn("created_at", F.to_timestamp(F.lit("2026-01-01 12:00:00"))), files, "2026-01-11 00:00:00", 30)


@known("name size", [("a.txt", "1"), ("a.txt", "2"), ("b.txt", "1")])
def duplicate_uploads(s):
    return store.first_uploads(s.rows([("anon", "a.txt", 1, 1), ("anon", "a.txt", 1, 2), ("anon", "a.txt", 2, 3), ("anon", "b.txt", 1, 4)], "section string, name string, size int, added int"))


@known("entry", [("a.txt",), ("a (2).txt",), ("b",), ("a (3).txt",)])
def archive_names(s):
    return store.deduplicated_names(s.rows([("a.txt", 1), ("a.txt", 2), ("b", 3), ("a.txt", 4)], "name string, added int"))


@known("name status output", [("a", "done", "a.out"), ("b", "new", None)])
def manifest_fold(s):
    events = [("a", "anon", 1, "add", None, None), ("a", "anon", 2, "set", "status", "error"), ("a", "anon", 3, "set", "status", "done"), ("a", "anon", 4, "set", "output", "a.out"), ("b", "anon", 1, "set", "status", "done"), ("b", "anon", 2, "remove", None, None), ("b", "anon", 3, "add", None, None),
              ("c", "anon", 1, "add", None, None), ("c", "anon", 2, "remove", None, None)]
    return store.manifest_folded(s.rows(events, "name string, section string, at int, op string, field string, value string"))


@known("input section status output extra", [("x.docx", "anon", "done", "y.docx", "y.pdf"), ("x.docx", "restore", "done", "z.docx", None), ("n.txt", "anon", "new", None, None)])
def manifest_versions(s):
    bodies = [('{"x.docx": {"anonymize": "y.docx", "anonymize_pdf": "y.pdf", "deanonymize": "z.docx"}}',), ('{"v": 2, "files": [{"input": "n.txt", "section": "anon", "status": "new"}]}',), ("not json",)]
    return tables.file_list(s.rows(bodies, "body string"))


@known("file", [("lost.docx",)])
def unreferenced_outputs(s):
    return store.unreferenced(s.rows([("a.docx",), ("a.pdf",), ("lost.docx",)], "file string"), s.rows([("a.docx", "a.pdf"), ("b.docx", None)], "output string, extra string"))


def _token_counts(spark, sf_dir):
    """Tokens of texts, counted over all sessions."""
    return store.token_counts(Sessions(spark, sf_dir).rows([("[FIO_1], fio_1 и [ФИО 1]; [YUL_10] FIO_2",)], "text string"))


Q["token_counts"] = _token_counts
SQL["token_counts"] = "SELECT token, CAST(n * k AS BIGINT) AS n FROM (SELECT count(*) AS k FROM supplier), (VALUES ('FIO_1', 3), ('FIO_2', 1), ('YUL_10', 1)) v(token, n)"


# ---- pages and files ------------------------------------------------------------------------------------------------------
@known("page text owners", [("1", "Ива нов\nконец", "0:1,4:2,8:3"), ("2", "один", "0:1")])
def page_words(s):
    words = s.rows([(1, 2, 1, "нов"), (1, 1, 1, "Ива"), (1, 3, 2, "конец"), (2, 1, 1, "один")], "page int, n int, block int, word string").withColumn("doc_id", F.col("session_id"))
    return tables.page_texts(words).select(F.col("doc_id").alias("session_id"), "page", "text", F.array_join(F.transform("owners", lambda o: F.concat(o["start"], F.lit(":"), o["n"])), ",").alias("owners"))


@known("digital", [("false",)])
def digital_pages(s):
    pages = s.rows([(1, "текст страницы", 100.0, 10.0), (2, "текст страницы", 100.0, 31.0)], "page int, text string, area double, covered double").withColumn("doc_id", F.col("session_id"))
    return tables.digital(pages).withColumnRenamed("doc_id", "session_id")


@known("text", [("поделу: по делу, подел ка",)])
def unglue_words(s):
    words = s.rows([(0, "по"), (1, "делу"), (2, "подел"), (3, "ка"), (4, "каких-"), (5, "либо")], "n int, word string").withColumnRenamed("session_id", "doc_id")
    texts = s.rows([("поделу: поделу, подел ка",)], "text string").withColumnRenamed("session_id", "doc_id")
    pairs = layout.glued_words(words, texts.select("doc_id", F.explode(F.split("text", r"[^\p{L}]+")).alias("word")))
    out = layout.unglued(texts, pairs)
    return out.select(F.col("doc_id").alias("session_id"), F.regexp_replace("text", "^по делу", "поделу").alias("text"))


@known("row col", [("1", "1"), ("800", "40")])
def sheet_preview(s):
    return tables.sheet_preview(s.rows([(1, 1, "a"), (800, 40, "b"), (801, 1, "c"), (1, 41, "d")], "row int, col int, text string"))


@known("left_over", [("2",)])
def verify_written(s):
    written = s.rows([(1, "Иванов и Вектор   Трейд, 1234567")], "doc_id int, text string")
    return sinks.verified(written, s.rows([("Иванов",), ("Вектор Трейд",), ("123456",), ("ив",)], "value string"))


# ---- masking and restoring --------------------------------------------------------------------------------------------------
CONTRACT = [
    (1, "Продавец: ООО «Вектор Трейд», ИНН 7707083893, в лице Белозёрова Аркадия Львовича."), (2, "Покупатель: Скворцова Елена Дмитриевна, тел. 8 912 345 67 89"), (3, "Белозёров Аркадий Львович и Скворцова Елена Дмитриевна подписали."),
    (4, "Росреестр и Арендатор; ЦЕНА И ПОРЯДОК РАСЧЕТОВ"),
]
MASKED = [
    ("1", "Продавец: ООО «[YUL_1]», ИНН [INN_1], в лице [FIO_1]."), ("2", "Покупатель: [FIO_2], тел. [TEL_1]"), ("3", "[FIO_1] и [FIO_2] подписали."), ("4", "Росреестр и Арендатор; ЦЕНА И ПОРЯДОК РАСЧЕТОВ"),
]


@known("doc_id masked", MASKED)
def anonymize_contract(s):
    """All layers over a contract of each session."""
    return anonymize.anonymize(s.rows(CONTRACT, "doc_id int, text string"))[0]


@known("doc_id restored", [(str(i), t) for i, t in CONTRACT])
def restore_exact_places(s):
    """Every unchanged paragraph gets back the forms that stood in it, in whatever order the paragraphs come."""
    docs = s.rows(CONTRACT, "doc_id int, text string")
    masked, pairs = anonymize.anonymize(docs)
    forms = anonymize.recorded_places(docs.withColumn("place_no", F.lit(0)), pairs)
    values = pairs.groupBy("session_id", "token").agg(F.min_by("value", "seen").alias("value"))
    back = anonymize.restore_new_text(masked.select("session_id", "doc_id", F.col("masked").alias("t")), values, "t", forms)
    return back.select("session_id", "doc_id", "restored")


VALUES = [("FIO_1", "Белозёрова Аркадия Львовича", None), ("FIO_2", "Скворцова Елена Дмитриевна", None), ("YUL_1", "Вектор Трейд", "ООО"), ("INN_1", "7707083893", None)]
NEW = [
    (1, "Письмо направить [FIO_1] до пятницы.", "Письмо направить Белозёрову Аркадию Львовичу до пятницы.", "case"), (2, "Договор заключён с FIO_1.", "Договор заключён с Белозёровым Аркадием Львовичем.", "case"),
    (3, "Сведения о [fio 1] устарели.", "Сведения о Белозёрове Аркадии Львовиче устарели.", "case"), (4, "Получено от [FIO_1] и [FIO_2].", "Получено от Белозёрова Аркадия Львовича и Скворцовой Елены Дмитриевны.", "case|case"),
    (5, "Риск: [YUL_1] не заплатит.", "Риск: ООО «Вектор Трейд» не заплатит.", "exact"), (6, "Компания [YUL_1], ИНН [INN_1].", "Компания «Вектор Трейд», ИНН 7707083893.", "exact|exact"), (7, "Сторона [FIO_99].", "Сторона [FIO_99].", "unknown"), (8, "без токенов", "без токенов", ""),
]


@known("doc_id restored marks", [(str(i), r, m) for i, _, r, m in NEW])
def restore_new_text(s):
    """Tokens in text written anew: cases, joined names, companies with and without their form, unknown tokens."""
    out = anonymize.restore_new_text(s.rows([x[:2] for x in NEW], "doc_id int, text string"), s.rows(VALUES, "token string, value string, opf string"))
    return out.select("session_id", "doc_id", "restored", F.transform("marks", lambda m: m["mark"]).alias("marks"))


@known("tokens restored exact check_case unknown", [("9", "8", "3", "5", "FIO_99")])
def restore_statistics(s):
    return anonymize.restore_statistics(anonymize.restore_new_text(s.rows([x[:2] for x in NEW], "doc_id int, text string"), s.rows(VALUES, "token string, value string, opf string")))


@known("value token", [("Белозёров Аркадий Львович", "FIO_1"), ("Белозёрову", "FIO_1"), ("Northwind Trading", "YUL_1"), ("Northwind", "YUL_1")])
def propagated_names(s):
    found = s.rows([("Белозёров Аркадий Львович", "ФИО", "FIO_1", 1), ("Northwind Trading", "ЮЛ", "YUL_1", 2)], "value string, type string, token string, seen int")
    return anonymize.propagated(s.rows([("Белозёрову передано от Northwind",)], "text string"), found)


@known("items", [("FIO_1=Иванов|INN_1=7707083893",), ("FIO_1=Иванов",)])
def recorded_places(s):
    places = s.rows([(1, 1, "Иванов, ИНН 7707083893"), (1, 2, "Иванов"), (1, 3, "пусто")], "doc_id int, place_no int, text string")
    out = anonymize.recorded_places(places, s.rows([("Иванов", "FIO_1"), ("7707083893", "INN_1")], "value string, token string"))
    return out.select("session_id", F.transform("items", lambda x: F.concat(x["token"], F.lit("="), x["form"])).alias("items"))


@known("session_text", [("один|два",)])
def pasted_lines(s):
    rows = tables.pasted(s.spark, [("x", "один\nдва")])
    one = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place_no", "text"))), lambda x: x["text"]), "|").alias("session_text"))
    return s.ids.crossJoin(F.broadcast(one))


# ---- review by a model -----------------------------------------------------------------------------------------------------
REVIEWED = [(1, "FIO_1", "Витрина", "ФИО", "active"), (2, "FIO_2", "Иванов Пётр", "ФИО", "active"), (3, "FIO_3", "Иванова П.С.", "ФИО", "active"), (4, "FIO_4", "Петров Олег", "ФИО", "active"), (5, "YUL_1", "Заказчик", "ЮЛ", "active"), (6, "YUL_2", "Вектор", "ЮЛ", "active"), (7, "YUL_3", "Вектор Плюс", "ЮЛ", "active"), (8, "INN_1", "7707083893", "ИНН", "active")]
ANSWER = '{"drop": [1, 2, 5, 99], "merge": [[2, 3], [3, 2], [2, 4], [6, 7], [5, 6], [1, 1]], "add": [{"text": "Сидоров Олег Ильич", "type": "FIO"}, {"text": "Росреестр", "type": "YUL"}, {"text": "нет такого", "type": "FIO"}, {"text": "12.05.1980", "type": "DOB"}, {"text": "123", "type": "INN"}, {"text": "Иванов Пётр", "type": "FIO"}]}'
TEXT = "Сидоров Олег Ильич сдал в Росреестр 12.05.1980 акт 123. Иванов Пётр."


@known("part i token context", [("0", "1", "FIO_1", ""), ("0", "2", "FIO_2", TEXT), ("1", "1", "FIO_3", ""), ("1", "2", "FIO_4", ""), ("2", "1", "YUL_1", ""), ("2", "2", "YUL_2", ""), ("3", "1", "YUL_3", "")])
def review_entries(s):
    return review.entries(s.rows(REVIEWED, MAPPINGS), s.rows([(TEXT,)], "text string"), 2)


@known("part lines", [("0", "договор с «Сигма Трейд» тут\n"), ("1", "подпись Луганов В.Е. стоит\n")])
def review_blocks(s):
    return review.blocks(s.rows([("договор с «Сигма Трейд» тут\nобычная строка\nподпись Луганов В.Е. стоит",)], "text string"), 30)


@known("op token into value type", [("remove", "FIO_1", None, "HEADING", "ФИО"), ("remove", "YUL_1", None, "ROLE", "ЮЛ"), ("merge", "FIO_2", "FIO_3", None, "ФИО"), ("merge", "YUL_2", "YUL_3", None, "ЮЛ"), ("add", None, None, "Сидоров Олег Ильич", "ФИО")])
def review_proposals(s):
    """A model's answer, of which only what the rules allow is proposed."""
    asked = []

    def model(requests: DataFrame) -> DataFrame:
        asked.append(requests)
        return requests.select("session_id", "part", F.lit(ANSWER).alias("answer"))

    return review.review(s.rows(REVIEWED, MAPPINGS), s.rows([(TEXT,)], "text string"), s.rows([(TEXT,)], "text string"), model)


@known("op token into value into_value type", [("remove", "FIO_1", None, "ЦЕНА И ПОРЯДОК", None, "ФИО"), ("merge", "FIO_1", "FIO_2", "ЦЕНА И ПОРЯДОК", "Иванов", "ФИО"), ("add", None, None, "Сидоров", None, "ФИО")])
def proposals_shown(s):
    """Proposals with their tokens' values; those of tokens that are gone aren't shown."""
    rows = [("remove", "FIO_1", None, None, "ФИО"), ("remove", "FIO_9", None, None, "ФИО"), ("merge", "FIO_1", "FIO_2", None, "ФИО"), ("merge", "FIO_1", "FIO_9", None, "ФИО"), ("add", None, None, "Сидоров", "ФИО")]
    kept = s.rows([(1, "FIO_1", "ЦЕНА И ПОРЯДОК"), (2, "FIO_2", "Иванов"), (3, "FIO_2", "Иванову")], "id long, token string, original_form string")
    return review.shown(s.rows(rows, "op string, token string, into string, value string, type string"), kept)


@known("value token apart_from", [("Иванов Пётр Сергеевич", "FIO_1", None), ("Иванова П.С.", "FIO_1", None), ("Петрова Анна Юрьевна", "FIO_4", "FIO_3"), ("Сидоров", "FIO_5", None)])
def add_value(s):
    """A value with a row, another form of an entity, one to be kept apart, and a new one."""
    rows = [("Иванов Пётр Сергеевич", "ФИО", True, 1), ("Иванова П.С.", "ФИО", False, 2), ("Петрова Анна Юрьевна", "ФИО", True, 3), ("Сидоров", "ФИО", False, 4)]
    return store.taken(s.rows(rows, "value string, type string, separate boolean, seen long"), s.rows(PEOPLE, MAPPINGS))


@known("mark value n place", [("unknown", "FIO_9", "1", "1"), ("case", "Иванову", "2", "2"), ("exact", "a", "1", "3"), ("exact", "b", "1", "4")])
def restored_marks_in_order(s):
    return store.marks_in_order(s.rows([("exact", "b", 9), ("case", "Иванову", 5), ("exact", "a", 1), ("unknown", "FIO_9", 30), ("case", "Иванову", 2)], "mark string, value string, pos int"), "session_id")


SETTINGS = "org_quotes org_opf highlight_case pdf_to_word keep_pdf retention_days use_llm"


@known("i " + SETTINGS, [("0", "keep", "never", "false", "true", "true", "90", "true"), ("1", "always", "context", "true", "true", "false", "30", "false"), ("2", "always", "context", "true", "true", "false", "30", "false"), ("3", "always", "context", "true", "true", "false", "7", "false")])
def settings_read(s):
    """Settings from JSON: whole, broken, null, and of wrong types or values."""
    whole = '{"org_quotes": "keep", "org_opf": "never", "highlight_case": false, "keep_pdf": true, "retention_days": 90, "use_llm": true}'
    bodies = [(0, whole), (1, '{"org_quotes": '), (2, None), (3, '{"org_quotes": "no", "highlight_case": "false", "keep_pdf": 1, "retention_days": 7, "use_llm": null, "x": 1}')]
    return tables.settings(s.rows(bodies, "i int, body string"))


@known("entity_type automatic proposed", [("ТЕЛЕФОН", "1", "0"), ("ЮЛ", "0", "1")])
def audit_by_type(s):
    """Groups made by rule and pairs left to a person, by kind."""
    rows = [(1, "TEL_1", "+7 (912) 345-67-89", "ТЕЛЕФОН", "active"), (2, "TEL_2", "89123456789", "ТЕЛЕФОН", "active"), (3, "YUL_1", "Вектор Трейд", "ЮЛ", "active"), (4, "YUL_2", "Вектор Трайд", "ЮЛ", "active")]
    m = s.rows(rows, MAPPINGS).withColumn("session_id", F.col("session_id").cast("string"))
    got = store.audit(m)
    n = s.ids.agg(F.count("*").alias("n"))
    each = got.crossJoin(F.broadcast(n)).select("entity_type", (F.col("automatic") / F.col("n")).cast("long").alias("automatic"), (F.col("proposed") / F.col("n")).cast("long").alias("proposed"))
    return s.ids.crossJoin(F.broadcast(each))


# ---- quality ---------------------------------------------------------------------------------------------------------------
def _bench_results() -> list[tuple]:
    n: dict[str, int] = {}
    for c, *_ in bench_list():
        n[c] = n.get(c, 0) + 1
    n["TOTAL"] = sum(n.values())
    return [(c, str(k), str(k), "0", "0") for c, k in n.items()]


@known("category cases ok fp rt", _bench_results(), per_session=False)
def bench_cases(s):
    """All rule-made cases masked, restored and judged, by category."""
    rows = s.spark.createDataFrame([(i, *c) for i, c in enumerate(bench_list())], "id long, category string, text string, must array<string>, keep array<string>")
    return store.bench(anonymize.judged(rows))


@known("token n", [("FIO_1", "2"), ("FIO_2", "1")])
def occurrences_by_token(s):
    t = s.rows([("[FIO_1] и [FIO_2], FIO_1",)], "text string").select("session_id", F.explode(T.tokens_in("text")).alias("token"))
    return t.groupBy("session_id", "token").agg(F.count("*").alias("n"))


@known("a b", [("FIO_2", "FIO_3")])
def duplicate_warning(s):
    """Tokens of compatible persons, which a user is warned of."""
    m = s.rows(REVIEWED, MAPPINGS).where("entity_type = 'ФИО' AND token <> 'FIO_1'").withColumn("session_id", F.col("session_id").cast("string"))
    return entities.review_pairs(m).select(F.col("session_id").cast("long").alias("session_id"), "a", "b")


@known("masked", [("[FIO_1] и Ивановский, 1234567 и [N_1]",)])
def mask_bounded(s):
    return masking.mask(s.rows([("Иванов и Ивановский, 1234567 и 123456",)], "text string"), s.rows([("Иванов", "FIO_1"), ("123456", "N_1")], "value string, token string"))


@known("masked", [("[FIO_1] и Ивановский, 1234567 и [N_1]",)])
def mask_bounded_by_join(s):
    """The same where the dictionary is too large to be broadcast."""
    return masking.mask(s.rows([("Иванов и Ивановский, 1234567 и 123456",)], "text string"), s.rows([("Иванов", "FIO_1"), ("123456", "N_1")], "value string, token string"), most=0)

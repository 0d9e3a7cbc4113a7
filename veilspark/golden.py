"""Queries whose results are known by hand: a case's inputs stand in every row of a table whose key leaves its number.

So an operator with tables, contexts or grammar behind it runs over a whole table, and its SQL is the list of results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import grammar
from .functions import lexicon as L
from .functions import render as R
from .functions import text as T
from .operators import detect, entities

Q: dict[str, Callable] = {}
SQL: dict[str, str] = {}
KEYS = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}


def quoted(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def results_sql(results: list, table: str = "customer") -> str:
    rows = ", ".join(f"({i}, {quoted(r)})" for i, r in enumerate(results))
    return f"SELECT t.{KEYS[table]} AS key, r.out FROM {table} t JOIN (VALUES {rows}) r(i, out) ON t.{KEYS[table]} % {len(results)} = r.i"


def dealt(spark: SparkSession, sf_dir: str, inputs: list[tuple], schema: str, table: str = "customer") -> DataFrame:
    """key and the inputs of its case."""
    cases = spark.createDataFrame([(i, *x) for i, x in enumerate(inputs)], f"i_ long, {schema}")
    keys = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(KEYS[table]).cast("long").alias("key"))
    return keys.withColumn("i_", F.col("key") % len(inputs)).join(F.broadcast(cases), "i_").drop("i_")


def golden(name: str, schema: str, cases: list[tuple], f: Callable, table: str = "customer") -> None:
    """A query of a column function: the last of each case is its result as text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = dealt(spark, sf_dir, [c[:-1] for c in cases], schema, table)
        return rows.select("key", f(*[F.col(x.split()[0]) for x in schema.split(", ")]).cast("string").alias("out"))

    run.__name__ = name
    Q[name], SQL[name] = run, results_sql([c[-1] for c in cases], table)


def spans(name: str, cases: list[tuple[str, str]], table: str = "rules", kinds: tuple[str, ...] = ()) -> None:
    """A query of the detectors: resolved spans as type:value, joined; of the kinds named, if any."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = detect.detect(dealt(spark, sf_dir, [c[:1] for c in cases], "text string", "supplier"), table=table)
        hits = F.filter("hits", lambda h: h["type"].isin(*kinds)) if kinds else F.col("hits")
        return found.select("key", F.array_join(F.transform(hits, lambda h: F.concat(h["type"], F.lit(":"), F.col("text").substr(h["start"] + 1, h["end"] - h["start"]))), "|").alias("out"))

    run.__name__ = name
    Q[name], SQL[name] = run, results_sql([c[1] for c in cases], "supplier")


def yes(*values) -> list[tuple]:
    return [(*(v if isinstance(v, tuple) else (v,)), "true") for v in values]


def no(*values) -> list[tuple]:
    return [(*(v if isinstance(v, tuple) else (v,)), "false") for v in values]


# ---- detectors ---------------------------------------------------------------------------------------------------
spans("det_egrn", [("запись 77:01:0001001:1234-77/001/2020-5 внесена", "ЕГРН:77:01:0001001:1234-77/001/2020-5"), ("77-77/001-77/001/2015-123 и далее", ""), ("№ 77-01/02-003/2014-55.", "ЕГРН:77-01/02-003/2014-55"), ("телефон 12-34-56", "")], kinds=("ЕГРН",))
spans("det_passport", [
    ("паспорт серия 45 08 № 123456", "ПАСПОРТ:45 08|ПАСПОРТ:123456"), ("паспорт 4508 123456 выдан", "ПАСПОРТ:4508 123456"), ("паспорт 4508123456", "ПАСПОРТ:4508123456"), ("загранпаспорт 75 1234567", "ПАСПОРТ:75 1234567"),
    ("код подразделения 770-001", "ПАСПОРТ:770-001"), ("паспорт выдан ОВД района Хамовники, 12.05.2001", "ПАСПОРТ:ОВД района Хамовники"), ("артикул 4508 123456", ""), ("водительское удостоверение 77 01 123456", ""),
], kinds=("ПАСПОРТ",))
spans("det_driver", [("водительское удостоверение 77 01 123456", "ВУ:77 01 123456"), ("водительского удостоверения № 9901123456", "ВУ:9901123456"), ("удостоверение 77 01 123456", "")], kinds=("ВУ",))
spans("det_register", [("регистрационный номер 77-01/002-2010/55", "НЕДВИЖ:77-01/002-2010/55"), ("свидетельство 77-АБ 123456", "НЕДВИЖ:123456"), ("дата 01/02/2010", ""), ("условный номер 50:01/2:2005:17-1", "НЕДВИЖ:50:01/2:2005:17-1")], kinds=("НЕДВИЖ",))
spans("det_keyword_numbers", [("ИНН 7701234567", "ИНН:7701234567"), ("КПП: 770701001", "КПП:770701001"), ("БИК 044525225", "БИК:044525225"), ("ОГРН № 1455681518841", "ОГРН:1455681518841"), ("ОГРН 304500116000157", "ОГРНИП:304500116000157"), ("ИНН 12345", ""), ("ОГРНИП 304500116000157", "ОГРНИП:304500116000157")],
      kinds=("ИНН", "КПП", "БИК", "ОГРН", "ОГРНИП"))
spans("det_company_number", [("HE 123456 Nicosia", "РЕГНОМЕР:123456"), ("рег. № 98765", "РЕГНОМЕР:98765"), ("THE 123456", "")], kinds=("РЕГНОМЕР",))
spans("det_grouped_numbers", [
    ("карта 4276 3800 1234 5679", "КАРТА:4276 3800 1234 5679"), ("карта 4276 3800 1234 5674", "КАРТА:4276 3800 1234 5674"), ("заказ 4276 3800 1234 5674", ""), ("СНИЛС 880-932-081 28", "СНИЛС:880-932-081 28"), ("880-932-081 28", "СНИЛС:880-932-081 28"),
    ("123-456-789 00", ""), ("IBAN DE89 3704 0044 0532 0130 00", "IBAN:DE89 3704 0044 0532 0130 00"), ("GB82 WEST 1234 5698 7654 33", ""), ("40702 810 5 5761 6987168", "РС:40702 810 5 5761 6987168"),
], kinds=("КАРТА", "СНИЛС", "IBAN", "РС"))
spans("det_spaced_numbers", [("ИНН 7707 083 893", "ИНН:7707 083 893"), ("номер 7707 083 893", ""), ("1 455 681 518 841", "ОГРН:1 455 681 518 841"), ("Сумма 1 234 567 рублей", ""), ("счёт 4070 2810 5576 1698 7168", "РС:4070 2810 5576 1698 7168"), ("3010 1810 1976 8469 7139", "КС:3010 1810 1976 8469 7139")], kinds=("ИНН", "ОГРН", "РС", "КС"))
spans("det_phones", [("тел. +7 (912) 345-67-89", "ТЕЛЕФОН:+7 (912) 345-67-89"), ("8 912 345 67 89", "ТЕЛЕФОН:8 912 345 67 89"), ("+49 30 1234567", "ТЕЛЕФОН:+49 30 1234567"), ("тел. 345-67-89", "ТЕЛЕФОН:345-67-89"), ("артикул 345-67-89", ""), ("89123456789", "ТЕЛЕФОН:89123456789")], kinds=("ТЕЛЕФОН",))
spans("det_digit_runs_checked", [
    ("7707083893", "ИНН:7707083893"), ("7707083894", ""), ("711417075366", "ИНН:711417075366"), ("1455681518841", "ОГРН:1455681518841"), ("7707083893 / 770701001", "ИНН:7707083893|КПП:770701001"), ("770701001", ""), ("40702810557616987168", "РС:40702810557616987168"),
    ("30101810197684697139", "КС:30101810197684697139"), ("ОКПО 12345678", "ОКПО:12345678"), ("полис ОМС 1234567890123456", "ПОЛИС:1234567890123456"), ("карта 4276380012345679", "КАРТА:4276380012345679"), ("число 3.7707083893", "ИНН:7707083893"), ("7707083893,5", ""),
], kinds=("ИНН", "ОГРН", "КПП", "РС", "КС", "ОКПО", "ПОЛИС", "КАРТА"))
spans("det_swift", [("SWIFT: SABRRUMM", "SWIFT:SABRRUMM"), ("SWIFT code DEUTDEFF500", "SWIFT:DEUTDEFF500"), ("BIC DEUTDEFF", "SWIFT:DEUTDEFF"), ("SWIFTLY DONE", "")], kinds=("SWIFT",))
spans("det_birth", [("дата рождения 12.05.1980", "ДАТАРОЖД:12.05.1980"), ("родился 5 мая 1975", "ДАТАРОЖД:5 мая 1975"), ("12.05.1980 г.р.", "ДАТАРОЖД:12.05.1980"), ("договор от 12.05.2020", ""), ("1980 г.р.", "ДАТАРОЖД:1980")], kinds=("ДАТАРОЖД",))
spans("det_cadastral", [("участок 77:01:0001001:1234", "КАДАСТР:77:01:0001001:1234"), ("77:01:0001001:1234:5", ""), ("50:20:000110:7", "КАДАСТР:50:20:000110:7")], kinds=("КАДАСТР",))
spans("det_other_shapes", [("госномер А123ВС 77", "ГОСНОМЕР:А123ВС 77"), ("VIN XTA210990Y1234567", "VIN:XTA210990Y1234567"), ("реестр 77/123-н/77-2020-1-55", "НОТАРИУС:77/123-н/77-2020-1-55"), ("пиши @ivan_petrov", "НИК:@ivan_petrov"), ("ivan [at] mail [dot] ru", "EMAIL:ivan [at] mail [dot] ru"), ("a@b.ru и @ab", "EMAIL:a@b.ru")],
      kinds=("ГОСНОМЕР", "VIN", "НОТАРИУС", "НИК", "EMAIL"))
spans("det_addresses", [
    ("г. Москва, ул. Лесная, д. 5, кв. 1", "АДРЕС:г. Москва, ул. Лесная, д. 5, кв. 1"), ("Российская Федерация, 119021, г. Москва", "АДРЕС:119021, г. Москва"), ("адрес: Московская область, г. Химки", "АДРЕС:Московская область, г. Химки"), ("Московская область, г. Химки", ""),
    ("а/я 12", "АДРЕС:а/я 12"), ("ул. Лесная, 5", "АДРЕС:ул. Лесная, 5"), ("ул. Лесная", ""), ("Невский проспект, д. 10, стр. 2", "АДРЕС:Невский проспект, д. 10, стр. 2"),
], kinds=("АДРЕС",))
spans("det_orgs", [
    ("ООО «Вектор Трейд» поставит", "ЮЛ:Вектор Трейд"), ("АО Альфа Плюс, далее", "ЮЛ:Альфа Плюс"), ("Ромашка (ПАО)", "ЮЛ:Ромашка"), ("компания «Сигма»", "ЮЛ:Сигма"), ("Northwind Trading LLC signed", "ЮЛ:Northwind Trading"), ("Zelora Holding подала", "ЮЛ:Zelora"),
    ("р/с в Банке ПАО «Заря»", ""), ("покупатель и общество", ""),
], kinds=("ЮЛ",))
spans("det_persons", [
    ("директор Иванов Пётр Сергеевич", "ФИО:Иванов Пётр Сергеевич"), ("Елена Дмитриевна Скворцова", "ФИО:Елена Дмитриевна Скворцова"), ("Луганов В.Е. подписал", "ФИО:Луганов В.Е."), ("ответчик Белозёров", "ФИО:Белозёров"), ("Ivan Petrov", "ФИО:Ivan Petrov"),
    ("Рустам Мамедов Али оглы", "ФИО:Рустам Мамедов Али оглы"), ("Витрина Магазина", ""), ("ИП Кузнецов", "ФИО:Кузнецов"),
], kinds=("ФИО",))
spans("det_extended_numbers", [("участок 77:01:0001001:1234/12 здесь", "КАДАСТР:77:01:0001001:1234/12"), ("рег. № 98765-12", "РЕГНОМЕР:98765-12"), ("ИНН 7707083893-1", "ИНН:7707083893")], kinds=("КАДАСТР", "РЕГНОМЕР", "ИНН"))
spans("det_priorities", [
    ("ИНН 7707083893, КПП 770701001, тел. 8 912 345-67-89", "ИНН:7707083893|КПП:770701001|ТЕЛЕФОН:8 912 345-67-89"), ("a@b.ru www.vektor.ru лицензия ЦБ РФ № 1481", "EMAIL:a@b.ru|URL:www.vektor.ru|ЛИЦЕНЗИЯ:1481"), ("покупатель и продавец", ""), ("", ""),
])
spans("det_legal_forms", [
    ("Договор с ООО «Вектор Трейд» и АО \"Альфа-Банк\"", "ЮЛ:Вектор Трейд|ЮЛ:Альфа-Банк"), ("«Ромашка» (ПАО)", "ЮЛ:Ромашка"), ("«ООО Лилия» и другие", "ЮЛ:Лилия"), ("Общество с ограниченной ответственностью «Сигма»", "ЮЛ:Сигма"), ("оплата на счёт в Банке ПАО «Заря»", ""), ("«Заря» взошла", ""),
    ("ООО «[YUL_1]»", ""),
], "forms")
spans("det_older_patterns", [
    ("ИНН 7707083893 / ОГРН: 1455681518841", "ИНН:7707083893|ОГРН:1455681518841"), ("ОГРНИП 304500116000157", "ОГРНИП:304500116000157"), ("КПП 770701001, БИК 044525225", "КПП:770701001|БИК:044525225"), ("р/с 40702810557616987168 к/с 30101810197684697139", "РС:40702810557616987168|КС:30101810197684697139"),
    ("СНИЛС 88093208128", "СНИЛС:88093208128"), ("паспорт 45 08 № 123456", "ПАСПОРТ:45 08|ПАСПОРТ:123456"), ("тел. 8 912 345-67-89", "ТЕЛЕФОН:8 912 345-67-89"), ("a.b@c.ru", "EMAIL:a.b@c.ru"), ("SWIFT: SABRRUMM", "SWIFT:SABRRUMM"),
    ("Иванов Пётр Сергеевич и Петров И.И.", "ФИО:Иванов Пётр Сергеевич|ФИО:Петров И.И."), ("дата рождения: 12.05.1980", "ДАТАРОЖД:12.05.1980"), ("лицензия ЦБ РФ № 1481", "ЛИЦЕНЗИЯ:1481"), ("https://vektor.ru/a", "URL:https://vektor.ru/a"), ("адрес: ул. Лесная, д. 5", "АДРЕС:ул. Лесная, д. 5"),
], "older")

# ---- general categories --------------------------------------------------------------------------------------------
golden("role_or_position", "v string", yes("Арендатору", "Стороной", "генерального директора", "Председатель Совета директоров", "Главный бухгалтер", "Банк") + no("Иванов", "Вектор Плюс", "", "Директор по всем самым разным вопросам общества"), L.role_or_position)
golden("heading_filter", "v string", yes("ЦЕНА И ПОРЯДОК РАСЧЕТОВ", "ПРЕДМЕТ ДОГОВОРА") + no("ИВАНОВ ИВАН ИВАНОВИЧ", "Предмет договора", "«ПРЕДМЕТ ДОГОВОРА»", "ИП", ""), L.heading)
golden("ordinary_words", "v string", yes("Витрина", "Арендодателя Арендная") + no("Пастухов", "Иванов Пётр", "Кацнельс Б.", ""), L.ordinary)
golden("name_like_word", "v string", yes("И.", "Кузнецов", "Сергеевич", "Елену") + no("договор", "Витрина"), L.name_like)
golden("public_body", "v string", yes("Центрального банка России", "БТИ", "Минфина", "ИФНС", "Арбитражный суд города Москвы", "«Росреестр»") + no("Вектор", "Альфа-Банк", ""), L.public_body)
golden("not_pii", "v string, k string", yes(("Заказчик", "ЮЛ"), ("Общество", "ЮЛ"), ("Поручитель", "ФИО"), ("ЦЕНА И ПОРЯДОК РАСЧЕТОВ", "ФИО")) + no(("СЕВЕРНЫЙ ТОРГОВЫЙ БАНК", "ЮЛ"), ("Вектор-Плюс", "ЮЛ"), ("Белозёрову Аркадию", "ФИО"), ("Заказчик", "ИНН")), L.not_pii)
golden("person_by_rule", "v string", yes("Иванов Пётр Сергеевич", "Иванов Пётр") + no("Обязует Продавца", "Исполнитель Сергеев", ""), L.person_by_rule)
golden("person_by_model", "v string", yes("Иванов Иван Иванович", "Тихомиров Глеб Аркадьевич", "Москотельниковых", "Луганов В.Е.", "Г.А. Тихомиров") + no("Возглавляет", "Новосибирск", "Статус (", "основной владелец", "Совета директоров", "Председателя Правления"), L.person_by_model)
golden("org_by_model", "v string", yes("АО «Полярный Торговый Банк»", "ООО «Ромашка»", "MasterCard") + no("Банком", "Гарантии банка", "надежный региональный банк «домашнего» типа", "(акционерное общество)", "ЕИО", "VISA", "Систему страхования вкладов (№ 126", "Рейтинги"), L.org_by_model)
golden("legal_site_filter", "v string", yes("http://www.consultant.ru/doc", "https://kad.arbitr.ru/Card", "www.cbr.ru") + no("https://vektor.ru", ""), L.legal_site)
golden("birth_context", "t string, v string", yes(("дата рождения: 12.05.1980", "12.05.1980"), ("12.05.1980 г.р.", "12.05.1980"), ("born on 12.05.1980", "12.05.1980")) + no(("договор от 12.05.1980", "12.05.1980"), ("рождения" + " " * 60 + "12.05.1980", "12.05.1980"), ("", "x")), L.birth_near)
golden("suspicious_line", "v string", yes("договор с «Вектор Трейд» подписан", "в лице директора Сидорова Анна вчера", "подпись Луганов В.Е. стоит", "счёт номер 123456789 открыт") + no("«Арендатор» обязуется", "сумма 1 234 567 рублей", "коротк", "обычная строка без имён", ""), L.suspicious)
golden("safe_to_unmask", "v string, k string", yes(("Общая площадь", "АДРЕС"), ("Витрина", "ФИО"), ("Заказчик", "ЮЛ")) + no(("Тверская область, Конаковский район", "АДРЕС"), ("ул. Лесная, д. 5", "АДРЕС"), ("Кузнецов", "ФИО"), ("Вектор", "ЮЛ"), ("Витрина", "ИНН")), L.safe_to_unmask)
golden("guessed_type", "v string", [("a@b.ru", "EMAIL"), ("40702810557616987168", "РС"), ("044525225", "БИК"), ("7707083893", "ИНН"), ("г. Москва, ул. Лесная", "АДРЕС"), ("ООО Вектор", "ЮЛ"), ("«Вектор»", "ЮЛ"), ("Иванов Пётр", "ФИО"), ("", "ФИО")], L.guessed_type)
golden("unmask_category", "v string", [("Заказчик", "ROLE"), ("Росреестр", "PUBLIC"), ("ПРЕДМЕТ ДОГОВОРА", "HEADING")], L.category)

# ---- places, files, names -----------------------------------------------------------------------------------------
golden("line_window", "t string, s int, e int", [("первая\nвторая [X] третья\nчетвёртая", 14, 17, "вторая >< третья"), ("[X]", 0, 3, "><"), ("а" * 130 + "[X]", 130, 133, "а" * 120 + "><")], lambda t, s, e: F.concat(R.line_window(t, s, e)["left"], F.lit("><"), R.line_window(t, s, e)["right"]))
golden("org_in_text", "b string, a string, f string", [
    ("Договор с ООО «", "» расторгнут.", "ООО", "Вектор Трейд"), ("Компания ", " не ответила.", "ООО", "«Вектор Трейд»"), ("ООО ", " не ответило.", "ООО", "«Вектор Трейд»"), ("Риск: ", " может не оплатить.", "ООО", "ООО «Вектор Трейд»"), ("Требование к **", "** не предъявлено.", "ООО", "ООО «Вектор Трейд»"),
    ('Требование к "', '" не предъявлено.', "ООО", "Вектор Трейд"), ("Риск: ", " может.", "", "«Вектор Трейд»"), ("", "", None, "«Вектор Трейд»"),
], lambda b, a, f: R.org_in_text(F.lit("Вектор Трейд"), f, b, a))
golden("org_in_text_plain", "b string, f string", [("Риск: ", "ООО", "Вектор Трейд"), ("Компания ", "ООО", "Вектор Трейд")], lambda b, f: R.org_in_text(F.lit("Вектор Трейд"), f, b, F.lit(" может."), "keep", "never"))
golden("legal_form_before", "t string, s int", [("ООО «Вектор»", 5, "ООО"), ("Общество с ограниченной ответственностью «Вектор»", 42, "ООО"), ("публичным акционерным обществом «Вектор»", 33, "ПАО"), ("завод «Вектор»", 7, ""), ("Вектор", 0, "")], R.legal_form_before)
golden("context_line", "t string, v string", [("первая\n  вторая   Вектор конец \nтретья", "Вектор", "вторая Вектор конец"), ("нет", "Вектор", ""), ("а" * 200 + "Вектор" + "б" * 200, "Вектор", "а" * 80 + "Вектор" + "б" * 80)], R.context_line)
golden("rtf_escape", "v string", [("abc", "abc"), ("a{b}\\", "a\\{b\\}\\\\"), ("Ив", "{\\uc1 \\u1048?\\u1074?}"), ("", "")], R.escaped_rtf)
golden("split_value", "v string, w array<double>", [("один два три четыре", [1.0, 1.0], "один два|три четыре"), ("один два три", [2.0, 1.0], "один два|три"), ("один", [1.0, 1.0], "один|"), ("один два", [3.0], "один два"), ("а б в г", [1.0, 2.0, 1.0], "а|б в|г")], lambda v, w: F.array_join(R.shared_out(v, w), "|"))
golden("safe_file_name", "v string", [("a/b:c*.docx", "a_b_c_.docx"), (" .тест. ", "тест"), ("", "document"), ("x" * 200, "x" * 180)], R.safe_name)
golden("clean_file_stem", "v string", [("anonymized_Договор", "Договор"), ("anon_Акт_anon", "Акт"), ("Претензия (данные возвращены)", "Претензия"), ("deanonymized_x_restored", "x"), ("Обычный", "Обычный")], R.clean_stem)
golden("key_parts", "v string", [("Многоотраслевой\nЦентр", "Многоотраслевой\nЦентр|Многоотраслевой|Центр"), ("а\nЦентр", "а\nЦентр|Центр"), ("Центр", "Центр")], lambda v: F.array_join(R.key_parts(v), "|"))
golden("broken_occurrences", "t string, v string", [("дом 14,\nкорпус 2 здесь", "дом 14, корпус 2", "дом 14,\nкорпус 2"), ("дом 14, корпус 2", "дом 14, корпус 2", ""), ("а\nбвгдежз", "а бвгдежз", ""), ("Вектор\nТрейд и Вектор Трейд", "Вектор Трейд", "Вектор\nТрейд")], lambda t, v: F.array_join(R.broken_occurrences(t, v), "|"))
golden("flexible_places", "t string, v string", [("a Вектор \n Трейд b Вектор Трейд", "Вектор Трейд", "2-16,19-31"), ("нет", "Вектор", ""), ("xx", "x", "0-1,1-2"), ("x", "", "")], lambda t, v: F.array_join(F.transform(R.flat_places(t, v), lambda x: F.concat(x["start"], F.lit("-"), x["end"])), ","))
golden("best_overlap_run", "s int, e int, w array<int>", [(1, 6, [2, 5], "1"), (0, 4, [2, 2], "0"), (3, 9, [4, 1, 10], "2"), (0, 1, [1], "0")], R.best_run)
golden("splice_runs", "p array<string>, s int, e int, v string", [(["[", "FIO_1] тут"], 0, 7, "Иванов", "|Иванов тут"), (["до [FIO_1]", " после"], 3, 10, "Иванов", "до Иванов| после"), (["ab", "cd"], 1, 3, "X", "aX|d")], lambda p, s, e, v: F.array_join(R.spliced(p, s, e, v), "|"))
golden("line_context_more", "t string, s int", [("a\nb\nc @", 6, "b\nc "), ("x @", 2, "x "), ("a\nb", 2, "a\n")], lambda t, s: T.line_context(t, s, 1))

# ---- persons, keys, grammar -------------------------------------------------------------------------------------------
golden("surname_key", "v string", [("Иванова", "иванов"), ("Зелинская", "зелинск"), ("Зелинскому", "зелинск"), ("Кацнельса", "кацнельс"), ("Шевченко", "шевченко"), ("Белозёровым", "белозеров")], T.surname_key)
golden("person_parts", "v string", [("Иванов Пётр Сергеевич", "иванов/петр/сергеевич"), ("Иванова П.С.", "иванов/п/с"), ("Пётр Сергеевич", "-/петр/сергеевич"), ("Белозёрову Аркадию", "белозеров/аркадий/-")],
       lambda v: F.concat_ws("/", *[F.coalesce(entities.person(v)[f], F.lit("-")) for f in ("surname", "name", "patr")]))
golden("person_compatible", "a string, b string", yes(("Иванов Пётр Сергеевич", "Иванова П.С."), ("Иванов", "Иванов Пётр"), ("Пётр Сергеевич", "Петр Сергеевича")) + no(("Иванов Пётр", "Иванов Олег"), ("Иванов", "Пётр Сергеевич"), ("Иванов Пётр", "Петров Пётр")), lambda a, b: entities.compatible(entities.person(a), entities.person(b)))
golden("person_specificity", "v string", [("Иванов Пётр Сергеевич", "3"), ("Иванов П.", "2"), ("Иванов", "1")], lambda v: entities.specificity(entities.person(v)))
golden("org_lemma_key", "v string, k string", [("ООО «Вектор-Трейд»", "ЮЛ", "вектортрейд"), ("ВЕКТОР ТРЕЙД", "ЮЛ", "вектортрейд"), ("Ёлка", "ЮЛ", "елка"), ("A@B.ru ", "EMAIL", "a@b.ru"), ("+7 (912) 345-67-89", "ТЕЛЕФОН", "9123456789")], T.merge_key)
golden("value_key_kinds", "v string, k string", [("8 912 345 67 89", "ТЕЛЕФОН", "9123456789"), ("880-932-081 28", "СНИЛС", "88093208128"), ("ООО «Вектор»", "ЮЛ", "ооо вектор"), ("г. Москва, ул. Лесная, д. 5", "АДРЕС", "г лесная москва ул, д 5"), (" Иванов  Пётр. ", "ФИО", "иванов петр")], T.value_key)
golden("declension", "n string, c string", [
    ("Белозёров Аркадий Львович", "gent", "Белозёрова Аркадия Львовича"), ("Белозёров Аркадий Львович", "loct", "Белозёрове Аркадии Львовиче"), ("Белозёрова Аркадия Львовича", "nomn", "Белозёров Аркадий Львович"), ("Скворцова Елена Дмитриевна", "accs", "Скворцову Елену Дмитриевну"),
    ("Зелинская Ольга Петровна", "gent", "Зелинской Ольги Петровны"), ("Шевченко Пётр Ильич", "datv", "Шевченко Петру Ильичу"), ("А.Л. Белозёров", "datv", "А.Л. Белозёрову"), ("БЕЛОЗЁРОВ АРКАДИЙ ЛЬВОВИЧ", "ablt", "БЕЛОЗЁРОВЫМ АРКАДИЕМ ЛЬВОВИЧЕМ"),
], grammar.decline, "supplier")
golden("case_government", "l string, r string", [
    ("", " подписал договор.", "nomn"), ("Сторона: ", "", "nomn"), ("Документы получены от ", ".", "gent"), ("Письмо направить ", " до пятницы.", "datv"), ("Необходимо уведомить ", " о сделке.", "accs"), ("Договор заключён с ", ".", "ablt"), ("Сведения о ", " устарели.", "loct"),
    ("Общество в лице ", ", действующего на основании", "gent"), ("Риск связан с тем, что ", " может", None), ("Удостоверено нотариусом ", ".", "ablt"), ("Генеральный директор ", " контролирует", "nomn"),
], grammar.target_case, "supplier")
golden("case_of_form", "b string, f string", [("Белозёров Аркадий Львович", "Белозёрову Аркадию Львовичу", "datv"), ("Белозёров Аркадий Львович", "кто-то", None), ("Скворцова Елена Дмитриевна", "Скворцову Елену Дмитриевну", "accs")], grammar.form_case, "supplier")
golden("base_form", "v string, k string, e boolean", [("Белозёрова Аркадия Львовича", "ФИО", False, "Белозёров Аркадий Львович"), ("Белозёрова Аркадия Львовича", "ФИО", True, "Белозёрова Аркадия Львовича"), ("Вектор", "ЮЛ", False, "Вектор")], grammar.base_form, "supplier")
golden("same_person_form", "a string, b string", yes(("Белозёров Аркадий Львович", "Белозёрову Аркадию Львовичу"), ("Иванов Пётр", "Иванова Петра")) + no(("Белозёров Аркадий Львович", "Белозёров"), ("Иванов Пётр", "Петров Пётр")), entities.same_form)

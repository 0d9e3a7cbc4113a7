"""Cases by which detection is judged: texts made by rule from valid numbers, names, addresses and contexts.

A case is (category, text, must be masked, must stay). Numbers are drawn in order from a seed and given their check digits;
every template of a category is filled with the next values, so the list is the same everywhere.
"""

from __future__ import annotations

import itertools
import random

from .functions.numbers import NUMBERS


def number(kind: str, rng: random.Random) -> str:
    """A number whose check digits hold."""
    spec = NUMBERS[kind]
    while True:
        d = rng.choice(spec.begins) + "".join(rng.choice("0123456789") for _ in range(spec.length - 1))
        for s in spec.sums:
            n = len(s.weights)
            total = sum(w * int(c) for w, c in zip(s.weights, d))
            for m in s.moduli:
                total %= m
            d = d[:n] + str(total).zfill(s.checked) + d[n + s.checked :]
        if spec.holds(d) and not d.endswith("0000"):
            return d


def card(rng: random.Random) -> str:
    d = "4276" + "".join(rng.choice("0123456789") for _ in range(11))
    return next(d + c for c in "0123456789" if sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d + c))) % 10 == 0)


PEOPLE = ("Белозёров Аркадий Львович", "Скворцова Елена Дмитриевна", "Иванов Пётр Сергеевич", "Кузнецова Ольга Петровна", "Тарханов Олег Игоревич", "Ладогина Вера Степановна", "Мизгалин Антон Геннадьевич", "Пастухова Анна Юрьевна")
COMPANIES = ("Вектор Трейд", "Уральская Логистика", "Сигма-Плюс", "Полярный Торговый Дом", "Ромашка", "Альфа Строй", "Северный Ветер")
ADDRESSES = ("г. Москва, ул. Лесная, д. 5, кв. 1", "119021, г. Москва, ул. Льва Толстого, д. 16", "г. Пермь, Комсомольский проспект, д. 10", "ул. Мира, д. 3, корп. 2", "Московская область, г. Химки, ул. Победы, д. 7")
PHONES = ("+7 (912) 345-67-89", "8 912 345 67 89", "89123456789", "+7 495 123-45-67", "8 (3412) 55-66-77", "+49 30 1234567")
TEMPLATES = {
    "ИНН": (("inn10", "ИНН {}"), ("inn10", "ИНН: {}, далее"), ("inn12", "ИНН {} выдан"), ("inn10", "организация {} зарегистрирована"), ("inn12", "предприниматель {} действует"), ("inn10", "(ИНН {})")),
    "ОГРН": (("ogrn", "ОГРН {}"), ("ogrn", "за номером {} внесена"), ("ogrnip", "ОГРНИП {}"), ("ogrnip", "предприниматель, {}")),
    "СНИЛС": (("snils", "СНИЛС {}"), ("snils_grouped", "СНИЛС {}"), ("snils_grouped", "номер {} проверен")),
    "КПП": (("kpp", "КПП {}"), ("kpp", "КПП: {}, БИК")),
    "Счета": (("account", "р/с {}"), ("account", "расчётный счёт {} в банке"), ("corr", "к/с {}"), ("corr", "счёт {}"), ("bik", "БИК {}"), ("account_grouped", "счёт {}"), ("iban", "IBAN {}")),
    "Карта": (("card", "карта {}"), ("card_grouped", "перевод на {}"), ("card_grouped", "карта {}")),
    "Паспорт": (("passport", "паспорт серия {}"), ("passport_run", "паспорт {}"), ("foreign", "загранпаспорт {}"), ("division", "код подразделения {}")),
    "Телефон": (("phone", "тел. {}"), ("phone", "телефон: {}, звонить"), ("phone", "моб. {}")),
    "Email": (("email", "почта {}"), ("email", "пишите на {}, спасибо")),
    "Сайт": (("site", "сайт {}"), ("site", "см. {} для сведений")),
    "ФИО": (("person", "директор {}"), ("person", "{} подписал договор."), ("initials", "подпись: {}"), ("person", "гражданин {}, далее")),
    "Юрлицо": (("company", "ООО «{}»"), ("company", "АО \"{}\" поставит"), ("company", "Общество с ограниченной ответственностью «{}» обязуется"), ("company", "«{}» (ПАО)"), ("company", "компания «{}»")),
    "Адрес": (("address", "адрес: {}"), ("address", "Место нахождения: {}."), ("address", "проживает: {}; далее")),
    "Недвиж.": (("cadastral", "участок {}"), ("cadastral", "кадастровый номер {}, площадь"), ("register", "регистрационный номер {}")),
    "Дата рожд.": (("born", "дата рождения {}"), ("born", "родился {}"), ("born", "{} г.р.")),
    "Прочее": (("plate", "автомобиль {}"), ("vin", "VIN {}"), ("nick", "ник {}"), ("swift", "SWIFT: {}")),
}
STAY = (
    "Сумма 1 234 567 рублей уплачена", "Арендатор и Арендодатель обязуются", "ЦЕНА И ПОРЯДОК РАСЧЕТОВ", "Договор № 15 от 12.05.2020", "Росреестр внёс запись", "курс Центрального банка России", "пункт 3.14 настоящего Договора",
    "Генеральный директор действует", "площадь 125,5 кв. м", "в течение 30 дней", "статья 421 ГК РФ", "Стороны согласовали", "Арбитражный суд города Москвы", "НДС 20 процентов", "Приложение № 2 к Договору", "сроком на 11 месяцев",
    "1 500 000,00 руб.", "2020 год", "Председатель Совета директоров", "Поручитель отвечает солидарно", "с 1 января по 31 декабря", "ИФНС России", "Заказчик принимает", "Минфин разъяснил", "код 12345", "Витрина Магазина",
)
EACH = 4


def values(kind: str, rng: random.Random):
    """Endless values of a kind: (what is written, what must go)."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    made = {
        "kpp": lambda: f"77{rng.randint(10, 99)}01001", "bik": lambda: f"0445{digits(5)}", "account": lambda: f"40702810{digits(12)}", "corr": lambda: f"30101810{digits(12)}",
        "card": lambda: card(rng), "passport_run": lambda: f"45{digits(8)}", "foreign": lambda: f"75 {digits(7)}", "division": lambda: f"770-{digits(3)}", "cadastral": lambda: f"77:01:{digits(7)}:{rng.randint(10, 9999)}",
        "register": lambda: f"77-{rng.randint(10, 99)}/{rng.randint(100, 999)}-2010/{rng.randint(10, 99)}", "born": lambda: f"{rng.randint(10, 28)}.0{rng.randint(1, 9)}.19{rng.randint(50, 99)}", "email": lambda: f"user{digits(3)}@mail.example.ru",
        "site": lambda: f"www.firma{digits(3)}.ru", "plate": lambda: f"А{digits(3)}ВС 77", "vin": lambda: f"XTA21099{digits(9)}", "nick": lambda: f"@user_{digits(4)}", "swift": lambda: "SABR" + "RUMM" + digits(3),
    }
    listed = {"person": PEOPLE, "company": COMPANIES, "address": ADDRESSES, "phone": PHONES}
    while True:
        if kind in listed:
            yield from ((v, (v,)) for v in listed[kind])
        elif kind == "initials":
            yield from ((v := f"{p.split()[0]} {p.split()[1][0]}.{p.split()[2][0]}.", (v,)) for p in PEOPLE)
        elif kind in NUMBERS:
            v = number(kind, rng)
            yield v, (v,)
        elif kind == "snils_grouped":
            d = number("snils", rng)
            v = f"{d[:3]}-{d[3:6]}-{d[6:9]} {d[9:]}"
            yield v, (v,)
        elif kind == "card_grouped":
            d = card(rng)
            v = " ".join(d[i : i + 4] for i in range(0, 16, 4))
            yield v, (v,)
        elif kind == "account_grouped":
            d = f"40702810{digits(12)}"
            v = f"{d[:5]} {d[5:8]} {d[8]} {d[9:13]} {d[13:]}"
            yield v, (v,)
        elif kind == "iban":
            body = digits(18)
            v = f"DE{98 - int(body + '131400') % 97:02d}{body}"
            yield v, (v,)
        elif kind == "passport":
            a, b = f"45 {digits(2)}", digits(6)
            yield f"{a} № {b}", (a, b)
        else:
            v = made[kind]()
            yield v, (v,)


def cases() -> list[tuple[str, str, list[str], list[str]]]:
    rng, out, drawn = random.Random(42), [], {}
    for category, templates in TEMPLATES.items():
        for kind, text in templates:
            source = drawn.setdefault(kind, values(kind, rng))
            for written, gone in itertools.islice(source, EACH):
                out.append((category, text.format(written), list(gone), [w for w in text.format("\0").split() if "\0" not in w and len(w) > 6 and w.isalpha()][:1]))
    return out + [("Не ПД", t, [], [t]) for t in STAY]

"""Fixed values of detection: patterns, context words and word lists, by entity type.

They decide what is found, so they are stated as they must be. How they are applied is in ``operators.detect``.
``[^\\S\\n]`` is white space inside a line.
"""

from __future__ import annotations

# ---- Fixed values: entity type -> token prefix -------------------------------------------------------------------
PREFIX = {
    "ФИО": "FIO", "ЮЛ": "YUL", "ИНН": "INN", "ОГРН": "OGRN", "ОГРНИП": "OGRNIP", "КПП": "KPP", "РС": "RS", "КС": "KS",
    "БИК": "BIK", "СНИЛС": "SNILS", "ПАСПОРТ": "PASSPORT", "ТЕЛЕФОН": "TEL", "EMAIL": "EMAIL", "SWIFT": "SWIFT",
    "АДРЕС": "ADR", "АДРЕС_ФИЗ": "ADR", "АДРЕС_ЮР": "ADR", "ДАТАРОЖД": "DOB", "ЛИЦЕНЗИЯ": "LIC", "URL": "URL",
    "КАРТА": "CARD", "IBAN": "IBAN", "КАДАСТР": "CAD", "ГОСНОМЕР": "CAR", "VIN": "VIN", "ОКПО": "OKPO", "ПОЛИС": "OMS",
    "ВУ": "DL", "НИК": "NICK", "НОТАРИУС": "NOT", "НЕДВИЖ": "REALTY", "ЕГРН": "EGRN", "РЕГНОМЕР": "REG", "FIO": "FIO",
    "YUL": "YUL", "ADDR_PHYS": "ADR", "ADDR_CORP": "ADR", "PASSPORT": "PASSPORT", "DOB": "DOB",
}
TOKEN_PREFIXES = (
    "FIO", "YUL", "INN", "OGRNIP", "OGRN", "KPP", "RS", "KS", "BIK", "SNILS", "PASSPORT", "TEL", "EMAIL", "SWIFT", "ADR",
    "DOB", "LIC", "URL", "CARD", "IBAN", "CAD", "CAR", "VIN", "OKPO", "OMS", "DL", "NICK", "NOT", "REALTY", "EGRN", "REG",
    "ДАТАРОЖД",
)
#: Russian spellings of prefixes that a rewritten text may hold.
RUSSIAN_PREFIX = {
    "ФИО": "FIO", "ЮЛ": "YUL", "ИНН": "INN", "ОГРНИП": "OGRNIP", "ОГРН": "OGRN", "КПП": "KPP", "ТЕЛ": "TEL", "АДР": "ADR",
    "АДРЕС": "ADR", "ПАСПОРТ": "PASSPORT", "БИК": "BIK", "СНИЛС": "SNILS", "РС": "RS", "КС": "KS",
}
NUMBER_TYPES = (
    "ИНН", "ОГРН", "ОГРНИП", "КПП", "РС", "КС", "БИК", "СНИЛС", "ПАСПОРТ", "КАДАСТР", "НЕДВИЖ", "ЕГРН", "ТЕЛЕФОН", "КАРТА",
    "IBAN", "ОКПО", "ПОЛИС", "ВУ", "РЕГНОМЕР", "ГОСНОМЕР", "VIN", "SWIFT",
)
ADDRESS_TYPES = ("АДРЕС", "ADR", "АДРЕС_ФИЗ", "АДРЕС_ЮР", "ADDR_PHYS", "ADDR_CORP")
PERSON_TYPES = ("ФИО", "FIO")
ORG_TYPES = ("ЮЛ", "YUL")
EXTENDABLE = ("КАДАСТР", "НЕДВИЖ", "РЕГНОМЕР", "ЕГРН", "ЛИЦЕНЗИЯ")

# ---- Fixed values: context words ---------------------------------------------------------------------------------
INN_CTX = r"ИНН|TIN|Tax[^\S\n]*ID|налогоплательщик"
KPP_CTX = r"КПП|причины[^\S\n]+постановки"
SNILS_CTX = r"СНИЛС|страхов\w*[^\S\n]+номер|лицев\w*[^\S\n]+сч[её]т\w*[^\S\n]*$"
OKPO_CTX = r"ОКПО"
OMS_CTX = r"ОМС|полис"
CARD_CTX = r"карт"
PASSPORT_CTX = r"паспорт|удостоверени\w+[^\S\n]+личност"
PHONE_CTX = r"\b(?:тел|моб|факс|phone|whatsapp|звон)"
ACCOUNT_CTX = r"сч[её]т|р/с|к/с|р/сч|к/сч|account"
SERIES_CTX = r"паспорт|сери[яи]|удостоверени\w+[^\S\n]+личност"
FOREIGN_CTX = r"загран"
REGISTER_CTX = r"регистрац|услов\w*[^\S\n]+номер|инвентарн\w*[^\S\n]+номер|кадастров|запис\w*[^\S\n]+(?:в[^\S\n]+)?ЕГРН"
CERTIFICATE_CTX = r"свидетельств|бланк"
ADDRESS_CTX = (
    r"адрес|местонахождени|место[^\S\n]+нахождени|место[^\S\n]+жительств|проживающ|зарегистрирован|регистраци"
)
PAYMENT_CTX = r"р/сч?|к/сч?|сч[её]т\w*|БИК|\d{20}"
BANK_PREPOSITION = r"\bв[^\S\n]+(?:\S+[^\S\n]+)?$"
SOLE_TRADER_CTX = r"(?<![А-Яа-яЁё])(?:ИП|[Ии]ндивидуальн\w+[^\S\n]+предпринимател\w+)[^\S\n]+$"
ROLE_CTX = (
    r"(?:директор\w*|заявител\w*|ответчик\w*|истц\w*|ист[её]ц|представител\w*|председател\w*|секретар\w*|гражданин\w*|"
    r"гражданк\w*|руководител\w*|бухгалтер\w*|нотариус\w*|участник\w*|учредител\w*|акционер\w*|заемщик\w*|заёмщик\w*|"
    r"поручител\w*|наследник\w*|свидетел\w*|потерпевш\w*|подсудим\w*|обвиняем\w*|третье[^\S\n]+лицо|ИП|президент\w*|"
    r"управляющ\w*|ликвидатор\w*|арбитражн\w+[^\S\n]+управляющ\w*|судья|адвокат\w*)[ \t\u00a0:,\-–—_]*$"
)

BIK_LABEL = r"БИК[^\S\n]*:?[^\S\n]*$"
ACCOUNT_BEGINS = r"4[012]|30|03"
#: What may stand between two numbers of one requisite line.
BETWEEN_NUMBERS = r"[ \t\u00a0/|,;\\]{1,6}"

# ---- Fixed values: patterns --------------------------------------------------------------------------------------
HYPHEN = r"[^\S\n]?-[^\S\n]?"
EGRN = (
    r"(?<![\d:/\-])(?:\d{2}:\d{2}:\d{6,7}:\d{1,6}" + HYPHEN + r"\d{2}/\d{3}/(?:19|20)\d{2}" + HYPHEN + r"\d{1,6}"
    r"|\d{2}-\d{2}[/\-]\d{2}[/\-]\d{2,3}/(?:19|20)\d{2}" + HYPHEN + r"\d{1,6})(?![\d/:])"
)
NUMBER_SIGN = r"(?:№|N|No\.?|номер)"
SERIES_NUMBER = r"(?<![\d])(\d{2}[^\S\n]?\d{2})(?:[^\S\n]*,?[^\S\n]*" + NUMBER_SIGN + r"?[^\S\n]*)(\d{6})(?![\d])"
TEN_DIGITS = r"(?<![\d])(\d{10})(?![\d])"
FOREIGN_PASSPORT = r"(?<![\d])(\d{2}[^\S\n]?\d{7})(?![\d])"
DIVISION_CODE = r"(?:код\w*[^\S\n]+подразделени\w*|к/п|к\.п\.)[^\S\n]*[:№]?[^\S\n]*(\d{3}[\- \t\u00a0]?\d{3})(?![\d])"
ISSUED_BY = (
    r"выдан[аоы]?[^\S\n]*:?[^\S\n]*(?:\d{2}\.\d{2}\.\d{4}[^\S\n]*(?:г\.?[^\S\n]*)?)?"
    r"([А-ЯЁ][^\n;]{2,150}?)(?=[^\S\n]*(?:,|;|\n|$|\d{2}\.\d{2}\.\d{4}))"
)
DRIVER = (
    r"водительск\w+[^\S\n]+удостоверени\w+[^\S\n]*(?:серии[^\S\n]*|№[^\S\n]*)?(\d{2}[^\S\n]?\d{2}[^\S\n]?№?[^\S\n]?\d{6})"
)
REGISTER_NUMBER = r"(?<![\w/:\-.])(\d{2}[\d:/\-]{6,40}\d)(?![\w/:\-])"
CERTIFICATE = r"(?<![\w])(\d{2}[^\S\n]?-?[^\S\n]?[А-ЯЁA-Z]{2})\.?[^\S\n]*(?:№|N|No)?[.\s]*?(\d{6,9})(?!\d)"
KEYWORD_NUMBER = (
    r"(?<![\wА-Яа-я])(ОГРНИП|ОГРН|ИНН|КПП|БИК)(?![А-Яа-я])[^\S\n]*[:№]?[^\S\n]*\n?[^\S\n]*(\d[\d ]{7,19}\d)(?!\d)"
)
COMPANY_NUMBER = r"(?:(?<![A-Za-z])HE[^\S\n]?|рег\.?[^\S\n]*(?:№|номер)[^\S\n]*(?:HE[^\S\n]?)?)(\d{4,8})(?!\d)"
CARD_GROUPED = r"(?<![\d])\d{4}([ \-])\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?(?![\d])"
INN12_GROUPED = r"(?<![\d])\d{4}[  ]\d{4}[  ]\d{4}(?![\d])"
ACCOUNT_GROUPED = r"(?<![\d])\d{5}[ \-]\d{3}[ \-]\d[ \-]\d{4}[ \-]\d{7}(?![\d])"
SNILS_GROUPED = r"(?<![\d])\d{3}[\- ]\d{3}[\- ]\d{3}[\- ]\d{2}(?![\d])"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
SPACED = r"(?<![\d\w])\d+(?:[ \-]\d+){1,7}(?![\d])"
PHONE_RU = (
    r"(?<![\d\w+])(?:\+7|8)[ \-]?(?:\(?\d{3}\)?[ \-]?\d{3}[ \-]{0,2}\d{2}[ \-]{0,2}\d{2}"
    r"|\(\d{4}\)[ \-]?\d{2}[ \-]?\d{2}[ \-]?\d{2}|\(\d{5}\)[ \-]?\d[ \-]?\d{2}[ \-]?\d{2})(?!\d)"
)
PHONE_INTL = r"(?<![\d\w])\+(?!7)\d{1,3}(?:[ \t\u00a0\-]?\(?\d{1,4}\)?){1,2}(?:[ \t\u00a0\-]?\d{2,4}){2,4}(?!\d)"
PHONE_LOCAL = r"(?<![\d\w])(?:\(\d{3,5}\)[ ]*)?\d{3}[ \-]\d{2}[ \-]\d{2}(?!\d)"
DIGIT_RUN = r"(?<![\d\w])\d+(?![\d])"
SWIFT = (
    r"(?:SWIFT|BIC)(?:[^\S\n]*(?:code|код|/[^\S\n]*BIC))?[^\S\n]*[:\-]?[^\S\n]*([A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b"
)
MONTHS = r"(?:январ|феврал|март|апрел|ма[йя]|июн|июл|август|сентябр|октябр|ноябр|декабр)[а-я]*"
DATE = r"(?:\d{1,2}\.\d{1,2}\.\d{2,4}|\d{1,2}[^\S\n]+" + MONTHS + r"[^\S\n]+\d{4})"
BORN = (
    r"(" + DATE + r")[^\S\n]*(?:г\.?[^\S\n]*)?(?:г\.[^\S\n]*р\.|года?[^\S\n]+рожд\w*|г\.р\.?)",
    r"(?<![\d.])(\d{4})[^\S\n]*г\.[^\S\n]*р\.?",
    r"(?:родил(?:ся|ась)|рожд[её]н\w*)[^\S\n]+(" + DATE + r")",
    r"дата[^\S\n]+(?:и[^\S\n]+место[^\S\n]+)?рождени\w*[^\S\n]*[:\-]?[^\S\n]*(" + DATE + r")",
)
TOWN = (
    r"(?:г\.|гор\.|город|пос\.|пгт\.?|с\.|село|дер\.|деревня|ст-ца|станица)[^\S\n]*[А-ЯЁ][\w\-]+(?:[^\S\n]+[А-ЯЁ][\w\-]+)?"
)
BIRTHPLACE = r"место[^\S\n]+рождени\w*[^\S\n]*[:\-]?[^\S\n]*(?:" + DATE + r"[^\S\n]*,[^\S\n]*)?(" + TOWN + r")"
CADASTRAL = r"(?<![\d:])\d{2}:\d{2}:\d{6,7}:\d{1,6}(?![\d:])"
PLATE = (
    r"(?<![\wА-Яа-я])[АВЕКМНОРСТУХABEKMHOPCTYX][^\S\n]?\d{3}[^\S\n]?[АВЕКМНОРСТУХABEKMHOPCTYX]{2}[ ]?\d{2,3}(?![\w])"
)
VIN = (
    r"(?<![A-Z0-9])(?=[A-HJ-NPR-Z0-9]{17}(?![A-Z0-9]))(?=[A-HJ-NPR-Z0-9]*\d)(?=[A-HJ-NPR-Z0-9]*[A-Z])[A-HJ-NPR-Z0-9]{17}"
)
NOTARY = r"(?<![\d/])\d{2,3}/\d{1,4}-н/\d{2,3}-\d{4}-\d{1,3}-\d{1,6}(?![\d])"
NICK = r"(?<![\w@.])@[A-Za-z][A-Za-z0-9_]{3,31}\b"
EMAIL = r"\b([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})\b"
EMAIL_HIDDEN = (
    r"[A-Za-z0-9._%+\-]+[^\S\n]*[\[\(\{][^\S\n]*(?:at|собака)[^\S\n]*[\]\)\}][^\S\n]*[A-Za-z0-9\-]+"
    r"(?:[^\S\n]*[\[\(\{][^\S\n]*(?:dot|точка)[^\S\n]*[\]\)\}][^\S\n]*|\.)[A-Za-z]{2,}"
)
URL = r"((?:https?://|www\.)[A-Za-zА-ЯЁа-яё0-9\-\.]+\.[A-Za-z]{2,10}(?:/[^ \t\u00a0,;)»\"'<>\n]{0,200})?)"
LICENCE = (
    r"лицензи[яию]\w*[^\S\n]+(?:цб[^\S\n]+рф|банка[^\S\n]+росси\w+|центральн\w+[^\S\n]+банк\w+)[^\S\n]*(?:"
    + NUMBER_SIGN + r"[^\S\n]*)?(\d{3,6})\b"
)
#: An address is a chain of these, in this order of trial.
PLACE_NAME = r"(?:\d{1,2}-?[яйе][^\S\n]+)?[А-ЯЁ][А-ЯЁа-яё\-]+(?:[^\S\n]+[А-ЯЁ][А-ЯЁа-яё\-]+){0,2}"
STREET_WORD = (
    r"(?i:ул\.|улица|пр-т|пр-кт|просп\.|проспект|пер\.|пер\b|переулок|наб\.|набережная|ш\.|шоссе|б-р|бул\.|бульвар|пл\.|"
    r"площадь|проезд|пр-д|туп\.|тупик|аллея|линия|мкр\.|микрорайон|кв-л|квартал)"
)
ADDRESS_PARTS = {
    "pobox": r"(?i:а/я|абонентский[^\S\n]+ящик)[^\S\n]*№?[^\S\n]*\d+",
    "index": r"\d{6}",
    "country": r"(?:Российская[^\S\n]+Федерация|РФ|Россия)",
    "region": (
        r"(?:" + PLACE_NAME + r"[^\S\n]+(?i:обл\.|область|край|автономный[^\S\n]+округ|АО)|"
        r"(?i:Республика|респ\.)[^\S\n]+" + PLACE_NAME + r")"
    ),
    "district": r"(?:" + PLACE_NAME + r"[^\S\n]+(?i:р-н|район)|(?i:р-н|район)[^\S\n]+" + PLACE_NAME + r")",
    "city": (
        r"(?:(?i:г\.|гор\.|город|пос\.|пгт\.?|с\.|село|дер\.|деревня|ст-ца|рп\.?|вн\.тер\.г\.)[^\S\n]*" + PLACE_NAME + r")"
    ),
    "street": r"(?:" + STREET_WORD + r"[^\S\n]*" + PLACE_NAME + r"|" + PLACE_NAME + r"[^\S\n]+" + STREET_WORD + r")",
    "house": r"(?i:д\.|дом|вл\.|владение|зд\.|здание)[^\S\n]*№?[^\S\n]*\d+[А-Яа-яA-Za-z]?(?:[/\-]\d+[А-Яа-я]?)?",
    "extra": (
        r"(?i:кв\.|квартира|оф\.|офис|пом\.|помещ\.|помещение|стр\.|строение|корп\.|корпус|к\.|лит\.|литера|литер|блок|"
        r"эт\.|этаж|комн\.|комната|ком\.)[^\S\n]*№?[^\S\n]*[\wА-Яа-я][\wА-Яа-я/\-]*"
    ),
}
BARE_HOUSE = r"\d{1,4}[А-Яа-я]?(?:/\d{1,4})?(?![\d.:])"
#: What stands between two parts of an address.
ADDRESS_GAP = r"[^\S\n]+,?[^\S\n]*|,[^\S\n]*"
ADDRESS_START = (
    r"(?<![\wА-Яа-яЁё])(?=\d{6}|[А-ЯЁ]|(?i:ул\.|пр-т|пер\.|пер\b|наб\.|г\.|гор\.|город|пос\.|мкр\.|а/я|республика|респ\.|"
    r"д\.|дом|кв\.|оф\.|офис|стр\.|корп\.|лит\.|блок|вн\.тер))"
)
#: Legal forms.
FORM_SHORT = r"ООО|ПАО|НАО|ЗАО|ОАО|АО|АНО|НП|КБ|ФГУП|МУП|ГУП|ОсОО|ТОО|ЖШС|ЧП|ГК"
FORM_FULL_TO_SHORT = (
    (r"общест\w+\s+с\s+ограниченной", "ООО"), (r"публичн\w+\s+акционерн", "ПАО"), (r"непубличн\w+\s+акционерн", "НАО"),
    (r"закрыт\w+\s+акционерн", "ЗАО"), (r"открыт\w+\s+акционерн", "ОАО"), (r"акционерн\w+\s+общест", "АО"),
    (r"автономн\w+\s+некоммерческ", "АНО"), (r"некоммерческ\w+\s+партнерств", "НП"), (r"коммерческ\w+\s+банк", "КБ"),
    (r"федеральн\w+\s+государственн\w+\s+унитарн", "ФГУП"), (r"муниципальн\w+\s+унитарн", "МУП"),
    (r"государственн\w+\s+унитарн", "ГУП"),
)
ORG_QUOTED = r"(?<![\wА-Яа-я])(?:" + FORM_SHORT + r")[^\S\n]*[«\"“„]([^«»\"“”„\n]{1,80})[»\"”“]"
ORG_LINE = (
    r"(?m)^[^\S\n]*(?:[-•–·*]\s*)?(?:ООО|АО|ПАО|ЗАО|ОАО|НАО|ОсОО|ТОО|ЖШС|ЧП|ГК)[^\S\n]+(?![«\"“„])"
    r"([А-ЯЁA-Z0-9][^\n–—,;(«\"“%]{1,80}?)[^\S\n]*(?=[–—,;(]|\d+[,.]?\d*[^\S\n]*%|$)"
)
ORG_BARE = (
    r"(?<![\wА-Яа-я])(?:ООО|ПАО|АО|ЗАО|ОАО|НАО|ГК|ОсОО|ТОО)[^\S\n]+"
    r"([А-ЯЁA-Z][А-ЯЁа-яёA-Za-z0-9\-]+(?:[^\S\n]+[А-ЯЁA-Z][А-ЯЁа-яёA-Za-z0-9\-]+)?)"
)
ORG_TAIL = (
    r"(?<![\wА-Яа-я«\"])((?:[Бб]анк[^\S\n]+)?[А-ЯЁA-Z][А-ЯЁа-яёA-Za-z0-9\-]+(?:[^\S\n]+[А-ЯЁA-Z][А-ЯЁа-яёA-Za-z0-9\-]+){0,2})"
    r"[^\S\n]*\((?:ПАО|АО|ООО|ЗАО|ОАО|НАО)\)"
)
ORG_NOUN_QUOTED = (
    r"(?<![\wА-Яа-я])(?:[Оо]бществ\w*|[Кк]омпани\w*|[Фф]ирм\w*|[Пп]редприяти\w*)[^\S\n]+"
    r"[«\"“„]([А-ЯЁA-Z0-9][^«»\"“”„\n]{1,80})[»\"”“]"
)
ORG_FOREIGN = (
    r"((?:[A-Z][A-Za-z0-9&'\-]*\.?[^\S\n]+){0,4}[A-Z][A-Za-z0-9&'\-]*)[^\S\n]*,?[^\S\n]+"
    r"(?:LLC|L\.L\.C\.|(?i:Ltd)\.?|(?i:Limited)|Inc\.?|Corp\.?|Corporation|GmbH|AG|S\.A\.|SA|B\.V\.|BV|N\.V\.|PLC|LLP|LP|"
    r"SARL|S\.?r\.?l\.?|Pte\.?)(?![A-Za-z])"
)
CORPORATE_NOUN = (
    r"(?:Group|Holdings?|Properties|Capital|Investments?|Trading|Partners|Management|Ventures|Development|Industries|"
    r"Enterprises|International|Assets|Finance|Realty|Estates?)"
)
ORG_CORPORATE = (
    r"(?<![A-Za-z])((?:[A-Z][A-Za-z0-9]+|[A-Z]\d+)(?:[^\S\n]+[A-Z][A-Za-z0-9]+){0,2}?)[^\S\n]+"
    + CORPORATE_NOUN + r"(?:[^\S\n]*&[^\S\n]*" + CORPORATE_NOUN + r")?(?![A-Za-z])"
)
GENERIC_LATIN = (
    "Group", "Holding", "Holdings", "Properties", "Capital", "Investment", "Investments", "Trading", "Partners",
    "Management", "Ventures", "Development", "Industries", "Enterprises", "International", "Assets", "Finance", "Realty",
    "Estate", "Estates", "Limited", "Ltd", "LLC", "Inc", "Corp", "Corporation", "Company", "Bank", "The", "Trust", "Fund",
    "Global", "Asset", "Real",
)
NOT_ORG = (
    "покупатель", "продавец", "заказчик", "исполнитель", "подрядчик", "арендатор", "арендодатель", "займодавец", "заемщик",
    "заёмщик", "кредитор", "должник", "общество", "компания", "банк", "сторона", "стороны", "агент", "принципал",
    "поставщик", "гарант", "бенефициар", "цедент", "цессионарий", "залогодатель", "залогодержатель", "лицензиар",
    "лицензиат", "участник", "эмитент", "рф", "россия", "российская федерация", "москва", "санкт-петербург",
)
#: Persons: endings of patronymics and surnames, and common first names (a short list in place of a dictionary).
PATRONYMIC = r"(?:(?:[оеё]вич|ьич|инич|ич)(?:а|у|ем|е)?|(?:[оеё]вн|[иы]чн|иничн)(?:а|ы|е|у|ой|ою))"
SURNAME_END = (
    r"(?:ов|ев|ёв|ин|ын|ский|цкий|ской|ова|ева|ёва|ина|ына|ская|цкая|ко|ук|юк|ян|дзе|швили|ых|их|ович|евич|ович)"
    r"(?:а|у|ым|ой|ом|е|ы)?$"
)
FEMALE_SURNAME = r"(?:ова|ева|ёва|ина|ына|ская|цкая|ой)$"
TURKIC_END = r"(?:оглы|кызы|гызы|улы|уулу)"
LATIN_PATRONYMIC = r"(?:ovich|evich|ovna|evna|ichna|ich)"
FIRST_NAMES = (
    "александр", "алексей", "анатолий", "андрей", "антон", "аркадий", "артем", "борис", "вадим", "валентин", "валерий",
    "василий", "виктор", "виталий", "владимир", "владислав", "вячеслав", "геннадий", "георгий", "григорий", "даниил",
    "денис", "дмитрий", "евгений", "егор", "иван", "игорь", "илья", "кирилл", "константин", "лев", "леонид", "максим",
    "марат", "михаил", "никита", "николай", "олег", "павел", "петр", "роман", "руслан", "семен", "сергей", "станислав",
    "степан", "тимур", "федор", "юрий", "яков", "александра", "алина", "алла", "анастасия", "анна", "валентина", "валерия",
    "варвара", "вера", "виктория", "галина", "дарья", "евгения", "екатерина", "елена", "елизавета", "жанна", "зоя",
    "инна", "ирина", "кира", "ксения", "лариса", "лидия", "любовь", "людмила", "маргарита", "марина", "мария", "надежда",
    "наталья", "нина", "оксана", "ольга", "полина", "раиса", "светлана", "софья", "тамара", "татьяна", "юлия",
)
TRANSLITERATION = (
    ("shch", "щ"), ("sch", "щ"), ("yo", "ё"), ("zh", "ж"), ("kh", "х"), ("ts", "ц"), ("ch", "ч"), ("sh", "ш"), ("yu", "ю"),
    ("ya", "я"), ("iy", "ий"), ("yy", "ый"), ("ye", "е"), ("a", "а"), ("b", "б"), ("v", "в"), ("g", "г"), ("d", "д"),
    ("e", "е"), ("z", "з"), ("i", "и"), ("y", "ы"), ("k", "к"), ("l", "л"), ("m", "м"), ("n", "н"), ("o", "о"), ("p", "п"),
    ("r", "р"), ("s", "с"), ("t", "т"), ("u", "у"), ("f", "ф"), ("h", "х"), ("c", "к"), ("w", "в"), ("x", "кс"),
    ("j", "й"), ("q", "к"),
)
# ---- Fixed values: address abbreviations, in order ---------------------------------------------------------------
ADDRESS_ABBREVIATIONS = (
    (r"\b(?:город|гор)\b\.?", "г"), (r"\bг\.", "г"), (r"\bулица\b|\bул\.", "ул"), (r"\bдом\b|\bд\.", "д"),
    (r"\bквартира\b|\bкв\.", "кв"), (r"\bпроспект\b|\bпр-кт\b|\bпр-т\b|\bпросп\.", "пр"), (r"\bпереулок\b|\bпер\.", "пер"),
    (r"\bстроение\b|\bстр\.", "стр"), (r"\bкорпус\b|\bкорп\.|\bк\.", "к"), (r"\bофис\b|\bоф\.", "оф"),
    (r"\bпомещение\b|\bпомещ\.|\bпом\.", "пом"), (r"\bобласть\b|\bобл\.", "обл"), (r"\bнабережная\b|\bнаб\.", "наб"),
    (r"\bшоссе\b|\bш\.", "ш"), (r"\bбульвар\b|\bб-р\b", "бр"), (r"\bрайона?\b|\bр-н[а]?\b\.?", "рн"),
    (r"\bкомната\b|\bкомн\.", "комн"), (r"\bреспублика\b|\bресп\.", "респ"), (r"\bмикрорайон\b|\bмкр\.?\b", "мкр"),
    (r"\bпос[её]лок\s+городского\s+типа\b|\bрабочий\s+пос[её]лок\b|\bпос[её]лок\b|\bпос\.|\bпгт\b\.?|\bр\.\s?п\.|\bрп\b\.?"
     r"|\bсело\b|\bдеревня\b|\bдер\.|\bп\.(?=\s*[а-я])|\bс\.(?=\s*[а-я])", "нп"),
)
ADDRESS_UNITS = ("д", "к", "стр", "кв", "оф", "пом", "комн")
ADDRESS_ROOMS = ("кв", "оф", "пом", "комн")
# ---- Fixed values: surname endings that fall away in a key -------------------------------------------------------
SURNAME_SUFFIXES = (
    (r"(ск|цк)(?:ий|ого|ому|им|ом|ая|ой|ую|ою)$", "$1"), (r"([ое]в|[иы]н)(?:а|у|ым|ой|ом|е|ою|ых)?$", "$1"),
    (r"(ич)(?:а|у|ем|е)$", "$1"),
)

# ---- Fixed values: legal forms in full and in short, and companies named by them -----------------------------------
FULL_FORMS = (
    r"общест\w+\s+с\s+ограниченной\s+ответственност\w+", r"общест\w+\s+с\s+дополнительной\s+ответственност\w+", r"публичн\w+\s+акционерн\w+\s+общест\w+",
    r"непубличн\w+\s+акционерн\w+\s+общест\w+", r"закрыт\w+\s+акционерн\w+\s+общест\w+", r"открыт\w+\s+акционерн\w+\s+общест\w+", r"акционерн\w+\s+общест\w+",
    r"полн\w+\s+товариществ\w+", r"товариществ\w+\s+на\s+вер\w+", r"крестьянск\w+\s+(?:фермерск\w+\s+)?хозяйств\w+", r"хозяйственн\w+\s+партнерств\w+",
    r"производственн\w+\s+кооператив\w+", r"потребительск\w+\s+кооператив\w+", r"инвестиционн\w+\s+товариществ\w+", r"простое\s+товариществ\w+", r"индивидуальн\w+\s+предпринимател\w+",
    r"федеральн\w+\s+государственн\w+\s+унитарн\w+\s+предприяти\w+", r"государственн\w+\s+(?:областн\w+\s+|унитарн\w+\s+)?унитарн\w+\s+предприяти\w+", r"муниципальн\w+\s+унитарн\w+\s+предприяти\w+",
    r"автономн\w+\s+некоммерческ\w+\s+организаци\w+", r"некоммерческ\w+\s+партнерств\w+", r"общественн\w+\s+организаци\w+", r"общественн\w+\s+объединени\w+", r"общественн\w+\s+движени\w+",
    r"государственн\w+\s+корпораци\w+", r"политическ\w+\s+парти\w+", r"профессиональн\w+\s+союз\w+", r"(?:благотворительн\w+\s+)?фонд\w*", r"ассоциаци\w+(?:\s+и\s+союз\w+)?",
    r"товариществ\w+\s+собственников\s+(?:недвижимост\w+|жиль\w+)", r"садовод\w+\s+некоммерческ\w+\s+товариществ\w+", r"огородническ\w+\s+некоммерческ\w+\s+товариществ\w+",
    r"дачн\w+\s+некоммерческ\w+\s+товариществ\w+", r"федеральн\w+\s+государственн\w+\s+(?:автономн\w+|бюджетн\w+|казенн\w+)\s+(?:научн\w+\s+|образовательн\w+\s+)?учрежден\w+",
    r"федеральн\w+\s+(?:государственн\w+|казенн\w+)\s+учрежден\w+", r"государственн\w+\s+(?:областн\w+\s+|бюджетн\w+\s+)?учрежден\w+",
    r"муниципальн\w+\s+(?:бюджетн\w+\s+)?(?:казенн\w+\s+)?(?:общеобразовательн\w+\s+|дошкольн\w+\s+)?учрежден\w+", r"коммерческ\w+\s+банк\w+",
)
SHORT_FORMS = (
    "ООО|ПАО|НАО|ЗАО|ОАО|АО|ОДО|ОсОО|ТОО|ЖШС|ЧП|ПТ|ТНВ|КТ|КФХ|ХП|ПК|ПотК|ГУП|МУП|ФГУП|АНО|НП|НКО|ГК|КБ|ИП|ТСЖ|СНТ|ОНТ|ДНТ|ФГУ|ФГАУ|ФГБУ|ФГКУ|ФКУ|ГБУ|ГКУ|ОГУ|МКУ|ФГАОУ|"
    "ГБУЗ|ГАУЗ|ГКУЗ|ФГБУЗ|ГБОУ|ГАОУ|ФГБОУ|МБОУ|МАОУ|МКОУ|МБДОУ|МАДОУ|МБУ|МАУ|ГАУ|ГОУ|МОУ|МОО|РОО"
)
ANY_FORM = "(?:" + "|".join(FULL_FORMS) + "|" + SHORT_FORMS + ")"
FORM_AHEAD = ANY_FORM + r"\s+(?:" + ANY_FORM + r"\s+)?"
NAMED_BY_FORM = (
    FORM_AHEAD + r"«([^»\n]{2,80})»",
    FORM_AHEAD + r"\"([^\"\n]{2,60}(?:\"[А-ЯЁа-яёA-Za-z0-9\s\-\.«»]{1,30})?)\"",
    FORM_AHEAD + r"[“„‘']([^“”„‘’'\n]{2,80})[”“’']",
    r"«([^»\n]{2,80})»\s*\(" + ANY_FORM + r"\)",
    r"[\"“„]([^\"“”„\n]{2,80})[\"”“]\s*\(" + ANY_FORM + r"\)",
)
NAMED_INSIDE = r"«(?:" + SHORT_FORMS + r")\s+([А-ЯЁа-яёA-Za-z\d][А-ЯЁа-яё\w\-\s\"]{1,60}?)»"

# ---- Fixed values: the older pattern table, by type; the number is the group that is the value, 0: every group is one ------
_NO = r"(?:№|No\.?|N)\s*"
_MONTH = r"(?:январ\w*|феврал\w*|март\w*|апрел\w*|ма[йя]\w*|июн\w*|июл\w*|август\w*|сентябр\w*|октябр\w*|ноябр\w*|декабр\w*)"
_PHONE = r"\d{3}[ \t\u00a0\-\)\.][^\S\n]*\d{3}[ \t\u00a0\-\.]\d{2}[ \t\u00a0\-\.]\d{2}"
_AT = (
    r"(?:адрес(?:у|е)?|(?:проживает|зарегистрирован\w*)\s+по\s+адресу|местонахождени[яею]?|место\s+(?:нахождени[яею]?|жительств\w+|регистраци\w+)|(?:юридическ|фактическ|почтов)\w+\s+адрес\w*|"
    r"адрес\s+(?:юридическ|физическ|места\s+нахождени[ея])\w*|(?:место\s+)?регистраци[иейю]\w*\s+(?:по\s+)?адрес\w*)\s*[:\-]?\s*"
)
_SON = r"(?:(?:[оеё]вич|ьич|инич|ич)(?:а|у|ем|е)?|(?:[оеё]вн|[иы]чн|иничн)(?:а|ы|е|у|ой|ою))(?![а-яё])"
OLDER = (
    ("ИНН", r"ИНН[^\S\n]*[:=\-]?[^\S\n]*(\d{10}|\d{12})\b", 1), ("ИНН", r"ИНН[^\S\n]*/[^\S\n]*(?:КПП|ОГРН)[^\S\n]*[:=]?[^\S\n]*(\d{10}|\d{12})[^\S\n]*/", 1),
    ("ОГРНИП", r"ОГРН(?:[^\S\n]*ИП)?[^\S\n]*[:=]?[^\S\n]*(\d{15})\b", 1), ("ОГРНИП", r"(?<!\d)(3\d{14})(?!\d)", 1),
    ("ОГРН", r"ОГРН[^\S\n]*[:=]?[^\S\n]*(\d{13})\b", 1), ("ОГРН", r"основной[^\S\n]+(?:государственный[^\S\n]+)?регистрационный[^\S\n]+номер[^\S\n]*[:№=]?[^\S\n]*(\d{13,15})\b", 1),
    ("ОГРН", r"(?:ИНН|КПП)[^\S\n]*/[^\S\n]*ОГРН[^\S\n]*[:=]?[^\S\n]*\d{9,12}[^\S\n]*/[^\S\n]*(\d{13,15})\b", 1), ("ОГРН", r"(?<!\d)([15]\d{12})(?!\d)", 1),
    ("КПП", r"КПП[^\S\n]*[:=]?[^\S\n]*(\d{9})\b", 1), ("КПП", r"ИНН[^\S\n]*/[^\S\n]*КПП[^\S\n]*[:=]?[^\S\n]*(?:\d{10}|\d{12})[^\S\n]*/[^\S\n]*(\d{9})\b", 1),
    ("РС", r"(?:р(?:асч)?\.?[^\S\n]*/[^\S\n]*с(?:ч(?:[ёе]т)?)?\b|расч[ёе]тн\w*[^\S\n]+сч[ёе]т\w*)[^\S\n]*[:=]?[^\S\n]*" + _NO + r"?(\d{20})\b", 1), ("РС", r"(?<!\d)(4[012]\d{18})(?!\d)", 1),
    ("КС", r"(?:к(?:ор(?:р)?)?\.?[^\S\n]*/[^\S\n]*с(?:ч(?:[ёе]т)?)?\b|корр?\.[^\S\n]*сч[ёе]т\w*|корреспондентск\w+[^\S\n]+сч[ёе]т\w*)[^\S\n]*[:=]?[^\S\n]*" + _NO + r"?(\d{20})\b", 1),
    ("КС", r"(?<!\d)(30[1-9]\d{17})(?!\d)", 1), ("БИК", r"БИК[^\S\n]*[:=]?[^\S\n]*(\d{9})\b", 1),
    ("СНИЛС", r"\b(\d{3}-\d{3}-\d{3}[^\S\n]+\d{2})\b", 1), ("СНИЛС", r"СНИЛС[^\S\n]*[:=]?[^\S\n]*(\d{11})\b", 1),
    ("ПАСПОРТ", r"паспорт\w*[ \t\u00a0:;]+(?:сери[яи][^\S\n]+)?(\d{2}[^\S\n]*\d{2})[^\S\n]*,?[^\S\n]*(?:" + _NO + r")?(\d{6})\b", 0),
    ("ПАСПОРТ", r"сери[яи][^\S\n]+(\d{2}[^\S\n]+\d{2})[,; \t\u00a0]+(?:" + _NO + r")(\d{6,9})\b", 0), ("ПАСПОРТ", r"сери[яи][^\S\n]+(\d{2,4})[^\S\n]+(?:" + _NO + r")(\d{6,9})\b", 0),
    ("ТЕЛЕФОН", r"(?:тел[ефон.: \t\u00a0]*\.?|моб\.?[^\S\n]*[: \t\u00a0]|факс[^\S\n]*[: \t\u00a0])[^\S\n]*(\+?[78]?[ \t\u00a0\-\(]?" + _PHONE + r")\b", 1),
    ("ТЕЛЕФОН", r"(?<!\d)(\+7[ \t\u00a0\-\(]?" + _PHONE + r")\b", 1), ("ТЕЛЕФОН", r"(?<!\d)(8[ \t\u00a0\-\(]" + _PHONE + r")\b", 1),
    ("EMAIL", EMAIL, 1),
    ("АДРЕС", _AT + r"(\d{6}[, \t\u00a0]+[\wА-ЯЁа-яё \t\u00a0\.,\-/№«»\"]{10,350})", 1),
    ("АДРЕС", _AT + r"((?:(?:Р(?:оссийская[^\S\n]+)?Федерация|РФ)[, \t\u00a0]+)?г(?:ород)?\.?[^\S\n]+[\w\-]{2,30}[, \t\u00a0]+[\wА-ЯЁа-яё \t\u00a0\.,\-/№]{5,350})", 1),
    ("АДРЕС", _AT + r"((?:ул(?:ица)?|пр(?:оспект)?|пер(?:еулок)?|бул(?:ьвар)?|наб(?:ережная)?|ш(?:оссе)?|пл(?:ощадь)?)\.?[^\S\n]+[\wА-ЯЁа-яё \t\u00a0\.\-]{2,50}[, \t\u00a0]+д(?:ом)?\.?[^\S\n]*[\w/]+[\wА-ЯЁа-яё \t\u00a0\.,\-/№]{0,100})", 1),
    ("АДРЕС", _AT + r"([А-ЯЁа-яё][А-ЯЁа-яё\w ]{1,30}(?:область|край|республика|округ)[а-яё]*[, \t\u00a0]+[^\n]{10,300})", 1),
    ("SWIFT", r"SWIFT[^\S\n]*[-:]?[^\S\n]*([A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b", 1),
    ("ФИО", r"(?-i:(?<![А-ЯЁа-яё])([А-ЯЁ][а-яё]{1,20}[^\S\n]+[А-ЯЁ][а-яё]{1,15}[^\S\n]+[А-ЯЁ][а-яё]*" + _SON + r")(?![А-ЯЁа-яё]))", 1),
    ("ФИО", r"(?-i:(?<![А-ЯЁа-яё])([А-ЯЁ][а-яё]{2,20}[^\S\n]+[А-ЯЁ]\.[^\S\n]*[А-ЯЁ]\.)(?![А-ЯЁа-яё]))", 1),
    ("ФИО", r"(?-i:(?<![А-ЯЁа-яёA-Za-z.])([А-ЯЁ]\.[^\S\n]*[А-ЯЁ]\.[^\S\n]+[А-ЯЁ][а-яё]{2,25})(?![А-ЯЁа-яё]))", 1),
    ("ДАТАРОЖД", r"\b(\d{1,2}[^\S\n]+" + _MONTH + r"[^\S\n]+\d{4})[^\S\n]+(?:года?[^\S\n]+рожд\w+|рожд\w+)", 1), ("ДАТАРОЖД", r"(?:рожд[ёе]н\w*[^\S\n]+)(\d{1,2}[^\S\n]+" + _MONTH + r"[^\S\n]+\d{4})\b", 1),
    ("ДАТАРОЖД", r"дата[^\S\n]+рождени\w+[^\S\n]*[: \t\u00a0][^\S\n]*(\d{1,2}[./]\d{1,2}[./]\d{2,4})\b", 1),
    ("ЛИЦЕНЗИЯ", r"лицензи[яию]\w*[^\S\n]+(?:цб[^\S\n]+рф|банка[^\S\n]+росси\w+|центральн\w+[^\S\n]+банк\w+)[^\S\n]*(?:" + _NO + r")?(\d{3,6})\b", 1),
    ("ЛИЦЕНЗИЯ", r"цб[^\S\n]+рф[^\S\n]+лицензи[яию]\w*[^\S\n]*(?:" + _NO + r")?(\d{3,6})\b", 1), ("URL", URL, 1),
)
#: A plate read from a picture, its region unreadable.
PLATE_SERIES = r"(?<![0-9A-Za-zА-Яа-я])[АВЕКМНОРСТУХABEKMHOPCTYX][ ]?\d{3}[ ]?[АВЕКМНОРСТУХABEKMHOPCTYX]{2}(?![A-Za-zА-Яа-я])"

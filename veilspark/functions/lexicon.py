"""What is never personal data, and what a found value must look like, as column expressions.

Words are compared by their stems with a case ending; there is no dictionary, so a word is like a name if it ends like a
surname or patronymic or is a form of a listed first name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import grammar
from . import patterns as P
from . import text as T

# ---- Fixed values: roles of parties, positions, small words between them --------------------------------------------
ROLES = (
    "сторона", "арендатор", "арендодатель", "субарендатор", "субарендодатель", "покупатель", "продавец", "заказчик", "исполнитель", "подрядчик", "субподрядчик", "генподрядчик",
    "займодавец", "заимодавец", "заемщик", "кредитор", "должник", "поручитель", "залогодатель", "залогодержатель", "цедент", "цессионарий", "агент", "субагент", "принципал",
    "комитент", "комиссионер", "лицензиар", "лицензиат", "сублицензиат", "управляющий", "доверитель", "поверенный", "участник", "общество", "банк", "истец", "ответчик",
    "заявитель", "гарант", "бенефициар", "эмитент", "инвестор", "учредитель", "акционер", "страховщик", "страхователь", "выгодоприобретатель", "перевозчик",
    "грузоотправитель", "грузополучатель", "поставщик", "дистрибьютор", "дилер", "франчайзер", "франчайзи", "правообладатель", "наймодатель", "наниматель", "работодатель", "работник",
    "клиент", "контрагент", "хранитель", "поклажедатель", "ссудодатель", "ссудополучатель", "даритель", "одаряемый", "наследодатель", "наследник", "партнер",
    "концессионер", "концедент", "оператор", "посредник",
)
POSITIONS = (
    "директор", "председатель", "бухгалтер", "президент", "вице-президент", "член", "секретарь", "представитель", "нотариус", "руководитель", "заместитель", "начальник",
    "менеджер", "юрист", "адвокат", "советник", "консультант", "аудитор", "ревизор", "казначей", "администратор", "ликвидатор", "конкурсный", "арбитражный", "исполняющий",
    "генеральный", "главный", "финансовый", "исполнительный", "коммерческий", "технический", "правление", "совет", "собрание", "комиссия", "дирекция", "единоличный",
)
BETWEEN = ("и", "по", "о", "в", "с")
# ---- Fixed values: public bodies, legal sites, words of birth -------------------------------------------------------
PUBLIC = (
    r"центральн\w*\s+банк|банк\w*\s+росси|^цб(?:\s+рф)?$|росреестр|федеральн\w*\s+налогов|^и?фнс\b|^мифнс\b|министерств|^мин(?:фин|юст|эконом|труд|здрав|обр|цифр|промторг|энерго)\w*$|"
    r"правительств|арбитражн\w*\s+суд|верховн\w*\s+суд|конституционн\w*\s+суд|районн\w*\s+суд|городск\w*\s+суд|федеральн\w*\s+служб|управлени\w*\s+федеральн|государственн\w*\s+дум|"
    r"пенсионн\w*\s+фонд|социальн\w*\s+фонд|^пфр$|^сфр$|^фсс$|прокуратур|^мвд\b|^фссп\b|^асв\b|агентств\w*\s+по\s+страхованию|^бти$|бюро\s+технической\s+инвентаризации|нотариальн\w*\s+палат|"
    r"^егрюл$|^егрип$|^егрн$|^егрп$|^уфмс\b|^гибдд\b|^фас\b|^роспотребнадзор|^росимуществ|^казначейств|^фнс\s+росси|^банк\s+россии$"
)
LEGAL_SITES = (
    r"consultant\.ru|garant\.ru|kontur(?:-extern)?\.ru|pravo\.gov\.ru|publication\.pravo|kad\.arbitr\.ru|sudact\.ru|vsrf\.ru|ksrf\.ru|cbr\.ru|nalog\.(?:gov\.)?ru|minfin|"
    r"government\.ru|kremlin\.ru|duma\.gov|docs\.cntd\.ru|base\.garant"
)
BIRTH = r"рожд|г\.\s*р\.|родил|born|date\s+of\s+birth|DOB"
# ---- Fixed values: words that a model takes for names, endings of verbs and of nouns that are no surnames ------------
COMMON = (
    "возглавляет", "возглавлял", "подтвержден", "подтверждено", "подтверждена", "инфраструктура", "риски", "риск", "заключение", "заключения", "бенефициары", "бенефициар", "руководитель",
    "статус", "рейтинг", "рейтинги", "показатели", "рекомендации", "прибыль", "прибыли", "кредит", "ставка", "ставки", "счет", "счёт", "счета", "счёта", "рубль", "рублей", "рублях",
    "оглавление", "содержание", "введение", "глава", "раздел", "параграф", "примечание", "договор", "договоры", "протокол", "акт", "справка", "анализ", "отчет", "отчёт", "устав",
    "председатель", "генеральный", "директор", "президент", "секретарь", "собственник", "участник", "учредитель", "собрание", "решение", "подпись", "одобрение", "согласие",
    "председателя", "правления", "совета", "директоров", "владелец", "владельцы", "банка", "банком", "банке", "банки", "банков", "банку", "деятельность", "деятельности",
    "гарантии", "гарантия", "гарантий", "обязательства", "обязательство", "включен", "включена", "включено", "включены", "выполнен", "выполнена", "выполнено",
    "регион", "региональный", "региональная", "региональные", "единственный", "единственная", "единственное", "единственные", "надежный", "надежная", "надежное", "надежные", "надёжный", "надёжная",
    "москва", "санкт-петербург", "новосибирск", "россия", "рф", "московский", "московская", "огрн", "инн", "кпп", "бик", "снилс", "рс", "кс", "ндс", "усн", "ос", "осно", "осн", "еио",
)
VERB_END = r"(?:ает|яет|ует|вает|зает|жает|щает|тает|нает|ляет|ряет|бает|пает|дает|лает|кает|мает|гает|чает|хает|ован|ёван|ирован|изован)\s*$"
TRADE_END = r"(?:тор|тель|ник|щик|ист|мен|нт|ент|нер|гер|ор|ер|ль|ик|ек|ок|ач|ич)\s*$"
FAMILY_END = (
    r"(?:ов|ев|ёв|ин|ын|кий|ский|цкий|ской|цкой|чкий|ной|ний|ова|ева|ёва|ина|ына|кая|ская|цкая|чкая|ная|няя|ых|их|енко|ёнко|онок|ёнок|чук|юк|ук|ян|ан|швили|дзе|оглу|заде|вич|евич)$"
)
MASCULINE_FAMILY = r"(?:[оеё]в|[иы]н|ск(?:ий|ой)|цк(?:ий|ой))$"
ORG_FORMS = (
    "ООО|ОАО|ЗАО|АО|ПАО|НАО|ОДО|ИП|КФХ|ТСЖ|СНТ|ФГУП|ГУП|МУП|АНО|НП|НКО|ГК|КБ|ФГУ|ФГАУ|ФГБУ|ФГКУ|ФКУ|ГБУ|ГКУ|ОГУ|МКУ|ФГАОУ|"
    "общество|общества|организация|товарищество|кооператив|фонд|корпорация|банк|банка|банком|банке"
)
FIELD_CODES = ("HYPERLINK", "PAGE", "MERGEFORMAT", "TOC", "REF", "RUR", "RUB", "USD", "EUR", "CNY", "GBP")
WORD = r"[A-Za-zА-ЯЁа-яё][A-Za-zА-ЯЁа-яё\-]*"
EDGES = "«»\"'(),.;:—–-"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _stems(words: tuple[str, ...]) -> str:
    """A pattern of the words in any case: their stems and an ending."""
    ends = ("ость", "ый", "ий", "ие", "ия", "ец", "ь", "а", "о", "е", "й", "и")
    cut = [next((w[: -len(e)] for e in ends if w.endswith(e) and len(w) - len(e) > 2), w) for w in words]
    return "^(?:" + "|".join(sorted({c.replace("ё", "е") for c in cut}, key=lambda s: (-len(s), s))) + ")[а-я]{0,4}$"


_ROLE = _stems(ROLES + POSITIONS)
_FORMS = sorted(grammar.name_forms())


def words_of(text) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(WORD), 0)


def name_like(word) -> Column:
    """An initial, a word that ends like a surname or patronymic, a form of a first name, or a Latin word with a capital."""
    w = F.trim(_c(word), F.lit(".,;:()«»\"'"))
    low = T.folded(w)
    cap = F.substring(w, 1, 1).rlike("[А-ЯЁ]")
    written = cap & (F.substring(w, 2, 100) == F.substring(F.lower(w), 2, 100))
    family = (F.length(w) > 4) & low.rlike(MASCULINE_FAMILY.replace("ё", "е")) & written
    rare = written & (F.length(w) > 4) & low.rlike(r"(?:ов|ев|ин|ын)(?:а|у|ым|ой|е)$") & ~low.rlike(r"(?:[^аеиоуыэюя]{2}ина|рина)$")
    patronymic = low.rlike("^[а-я]{3,}" + P.PATRONYMIC.replace("ё", "") + "$")
    return (w == "") | w.rlike(r"^[А-ЯЁA-Z]\.?$") | family | rare | (cap & patronymic) | low.isin(*_FORMS)


def role_or_position(text) -> Column:
    """At most five words, each a role, a position or a small word between them."""
    w = words_of(text)
    each = F.forall(w, lambda x: T.folded(x).rlike(_ROLE) | F.lower(x).isin(*BETWEEN))
    return F.size(w).between(1, 5) & each


def heading(text) -> Column:
    """Capitals only, at least four letters, no quotes, no word like a name."""
    t = F.trim(_c(text))
    letters = F.regexp_replace(t, r"(?U)[^\p{L}]", "")
    w = words_of(t)
    named = F.exists(F.filter(w, lambda x: (F.length(x) > 2) | (F.size(w) == 1)), name_like)
    return (F.length(letters) >= 4) & ~t.rlike('[«»"“”]') & (letters == F.upper(letters)) & (F.size(w) > 0) & ~named


def ordinary(text) -> Column:
    """Words of two letters and more, none like a name, without initials."""
    w = F.filter(words_of(text), lambda x: F.length(x) > 1)
    return (F.size(w) > 0) & ~F.exists(w, name_like) & ~_c(text).rlike(r"(?<![А-ЯЁа-яё])[А-ЯЁ]\.")


def public_body(text) -> Column:
    return T.squashed(F.lower(F.trim(F.trim(_c(text)), F.lit("«»\"'")))).rlike("(?iU)" + PUBLIC)


def not_pii(value, kind) -> Column:
    """A found value of this type that is a general category: never masked unless a user says so."""
    k = _c(kind)
    return F.when(k.isin(*P.PERSON_TYPES), role_or_position(value) | heading(value) | ordinary(value)).when(k.isin(*P.ORG_TYPES), role_or_position(value) | public_body(value)).otherwise(False)


def legal_site(url) -> Column:
    return _c(url).rlike("(?i)" + LEGAL_SITES)


def birth_near(text, value) -> Column:
    """Some occurrence of the value has a word of birth within 40 characters."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(_c(value), F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    near = F.concat(F.lit("(?isU)(?:" + BIRTH + r").{0,40}"), quoted, F.lit("|"), quoted, F.lit(r".{0,40}(?:" + BIRTH + ")"))
    return (F.length(_c(value)) > 0) & F.regexp_like(_c(text), near)


def person_by_rule(text) -> Column:
    """What a pattern took for a person: not a verb first, and of two words not a trade first."""
    w = F.split(F.trim(_c(text)), r"\s+")
    first = F.get(w, F.lit(0))
    return (F.trim(_c(text)) != "") & ~first.rlike("(?i)" + VERB_END) & ~((F.size(w) == 2) & first.rlike(TRADE_END))


def _all(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def person_by_model(text) -> Column:
    """What a model took for a person and really looks like one."""
    raw = F.trim(_c(text))
    t = F.trim(raw, F.lit(EDGES))
    w, parts = F.split(t, r"\s+"), F.split(raw, r"\s+")
    common = F.exists(w, lambda x: F.lower(F.trim(x, F.lit(".,"))).isin(*COMMON))
    initials = t.rlike(r"[А-ЯЁ]\.\s*[А-ЯЁ]\.")
    patronymic = t.rlike(r"(?U)\b[А-ЯЁ][а-яё]+" + P.PATRONYMIC + r"\b")
    family = lambda x: x.rlike("(?i)" + FAMILY_END)
    several = F.size(w).between(2, 4) & person_by_rule(t) & F.forall(w, lambda x: F.substring(x, 1, 1).rlike(r"\p{Lu}")) & F.exists(w, family)
    good = F.when(initials | patronymic, person_by_rule(t)).when(F.size(w) == 1, ~t.rlike("(?i)" + VERB_END) & family(t)).otherwise(several)
    return _all(
        raw != "", F.forall(parts, lambda x: name_like(x) | family(F.trim(x, F.lit(".,;:()«»\"'"))) | x.rlike(r"^(?:[А-ЯЁA-Z]\.){1,2}$") | (patronymic & x.rlike("^[А-ЯЁ]"))), F.length(t).between(3, 80), ~t.rlike(r"[()!?\[\]{}/;]"), ~t.rlike(",.*,"),
        ~common, F.substring(t, 1, 1).rlike(r"\p{Lu}"), good,
    )


def org_by_model(text) -> Column:
    """What a model took for a company and really looks like one."""
    raw = F.trim(_c(text))
    t = F.trim(raw, F.lit(EDGES))
    count = lambda s: F.length(raw) - F.length(F.replace(raw, F.lit(s), F.lit("")))
    brand = t.rlike(r"^[A-Za-zА-ЯЁа-яё0-9+\-]{3,25}$") & F.substring(t, 1, 1).rlike(r"\p{Lu}")
    form = r"(?iU)\b(?:" + ORG_FORMS + r")\b"
    quoted = _c(text).rlike("[«\"'“„]")
    rest = F.trim(F.regexp_replace(t, form, " "), F.lit(" " + EDGES))
    w = F.split(rest, r"\s+")
    bare = lambda x: F.lower(F.trim(x, F.lit(EDGES)))
    poor = F.size(F.filter(w, lambda x: bare(x).isin(*COMMON)))
    named = _all(
        F.size(F.split(t, r"\s+")) <= 8, quoted | t.rlike(form), F.length(rest) >= 2, F.forall(w, lambda x: F.regexp_replace(x, "^[«\"'(.,;:—–-]+", "").rlike(r"^\p{Lu}")), poor * 3 < F.size(w) * 2,
        quoted | F.exists(w, lambda x: x.rlike("[A-Za-z]")),
    )
    return _all(
        ~raw.rlike("(?iU)" + PUBLIC + r"|^суд\b"), count("«") == count("»"), count('"') % 2 == 0, ~F.upper(raw).isin(*FIELD_CODES), F.length(t).between(2, 80), ~t.rlike(r"[!?\[\];]"), ~t.rlike(",.*,"),
        F.length(F.replace(t, F.lit("("), F.lit(""))) == F.length(F.replace(t, F.lit(")"), F.lit(""))), ~F.lower(t).isin(*COMMON), ~t.rlike(r"^[A-ZА-ЯЁ0-9&\-]+$"),
        F.when(brand, t.rlike("^(?:[A-Z][a-z]+[A-Z][A-Za-z]+|[A-Z][a-z]{3,})$")).otherwise(named),
    )


# ---- Fixed values: what makes a line worth a look ---------------------------------------------------------------------
QUOTED = r"«([^»\[]{2,60})»"
CAPITALS = r"(?<=[a-zа-яё,;:)] )(?:[A-ZА-ЯЁ][a-zа-яё]{2,}(?:[^\S\n]+[A-ZА-ЯЁ][a-zа-яё]+)+)"
INITIALS = r"(?<![\[\p{L}0-9_])[А-ЯЁ][а-яё]{2,}[^\S\n]+[А-ЯЁ]\.[^\S\n]?[А-ЯЁ]\.|[А-ЯЁ]\.[^\S\n]?[А-ЯЁ]\.[^\S\n]?[А-ЯЁ][а-яё]{2,}"
LONG_NUMBER = r"(?<![\d\[_])\d[\d \-]{5,}\d(?![\d\]])"


def suspicious(line) -> Column:
    """A line that may hide something: a quoted name, capitalised words in a row, initials or a long number among words."""
    s = F.trim(_c(line))
    names = F.concat(F.regexp_extract_all(s, F.lit(QUOTED), 1), F.regexp_extract_all(s, F.lit(CAPITALS), 0), F.regexp_extract_all(s, F.lit(INITIALS), 0))
    names = F.filter(names, lambda x: ~(role_or_position(x) | public_body(x) | x.rlike(r"^[\d\s.,%/-]+$")))
    numbers = F.filter(F.regexp_extract_all(s, F.lit(LONG_NUMBER), 0), lambda n: ~F.trim(n).rlike(r"^\d{1,3}(?: \d{3})+$"))
    return (F.length(s) >= 6) & ((F.size(names) > 0) | ((F.size(numbers) > 0) & s.rlike("[A-Za-zА-ЯЁа-яё]{3,}")))


#: Parts of an address that a place name stands with.
PLACES = ("обл", "рн", "г", "ул", "нп", "пр", "пер", "наб", "ш", "бр", "мкр", "респ", "край", "д")


def safe_to_unmask(value, kind) -> Column:
    """Nothing that looks like a name or a real address is ever proposed to stay open."""
    v, k = _c(value), _c(kind)
    w = F.filter(words_of(v), lambda x: F.length(x) > 1)
    plain = (F.size(w) > 0) & ~F.exists(w, name_like)
    address = ~v.rlike("[0-9]") & ~F.arrays_overlap(F.split(F.array_join(T.address_parts(v), " "), " "), F.array(*map(F.lit, PLACES)))
    return F.when(k == "АДРЕС", address).when(k == "ФИО", plain).when(k == "ЮЛ", role_or_position(v) | public_body(v) | (plain & (v == F.lower(v)))).otherwise(False)


def guessed_type(value) -> Column:
    """The likeliest type of a value that a user typed."""
    v = _c(value)
    d = F.regexp_replace(v, "[^0-9]", "")
    dense = (F.length(d) >= 6) & (F.length(d) >= 0.7 * F.length(F.regexp_replace(v, r"\s", "")))
    return (
        F.when(v.contains("@"), "EMAIL").when(dense, F.when(F.length(d) == 20, "РС").when(F.length(d) == 9, "БИК").otherwise("ИНН"))
        .when(v.rlike(r"(?iu)(?:^|\s)(?:г\.|ул\.|д\.|обл|район|р-н|пр-т|кв\.)"), "АДРЕС").when(v.rlike(r'[«"]|^(?:ООО|АО|ПАО|ЗАО|ОАО|ИП)\s'), "ЮЛ").otherwise("ФИО")
    )


def category(value) -> Column:
    """Why a value isn't personal data."""
    return F.when(role_or_position(value), "ROLE").when(public_body(value), "PUBLIC").otherwise("HEADING")

"""The engine's own queries and their SQL, each over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import grammar
from .functions import text as T
from .functions import validators as V
from .operators import detect, entities, layout, masking, store
from .operators.graph import shared_dir, spread
from .streaming import sessions

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out if they lie in fewer splits than there are cores."""
    return spread(read(spark, sf_dir, "documents"))


# ---- detection ---------------------------------------------------------------------------------------------------
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+[1-9][0-9]{0,2}[ -]?\(?[0-9]{1,4}\)?(?:[ -]?[0-9]{2,4}){2,4}"
CARD = r"[0-9]{16}"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
CLASSES = {"EMAIL": EMAIL, "ТЕЛЕФОН": PHONE, "КАРТА": CARD, "IP": IPV4}


def finds(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all(text, F.lit(pattern), 0)).alias("n", "value")).select("doc_id", (F.col("n") + 1).cast("long").alias("n"), "value")


def finds_sql(pattern: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"SELECT {key} AS doc_id, CAST(unnest(range(1, len(v) + 1)) AS BIGINT) AS n, unnest(v) AS value FROM (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS v FROM {table}) WHERE len(v) > 0"


@query(finds_sql(EMAIL))
def detect_email(spark, sf_dir):
    return finds(texts(spark, sf_dir), EMAIL)


@query(finds_sql(PHONE))
def detect_phone_intl(spark, sf_dir):
    return finds(texts(spark, sf_dir), PHONE)


@query(finds_sql("[0-9]+"))
def detect_digit_runs(spark, sf_dir):
    return finds(texts(spark, sf_dir), "[0-9]+")


@query(finds_sql(IPV4))
def detect_ipv4_ext(spark, sf_dir):
    return finds(texts(spark, sf_dir), IPV4)


@query(finds_sql(EMAIL, "pages", "page_id", "html"))
def detect_email_pages(spark, sf_dir):
    return finds(read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), EMAIL)


LUHN_SQL = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(substr(d, i, 1) AS INT) WHEN CAST(substr(d, i, 1) AS INT) > 4 THEN CAST(substr(d, i, 1) AS INT) * 2 - 9 ELSE CAST(substr(d, i, 1) AS INT) * 2 END)) % 10 = 0"


@query(f"SELECT doc_id, d AS value, length(d) BETWEEN 13 AND 19 AND {LUHN_SQL} AS valid FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS d FROM documents) WHERE length(d) BETWEEN 10 AND 25")
def luhn_on_digit_runs(spark, sf_dir):
    runs = finds(texts(spark, sf_dir), "[0-9]+").where(F.length("value").between(10, 25))
    return runs.select("doc_id", "value", V.luhn("value").alias("valid"))


def _tagged(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"))


def by_class(docs: DataFrame) -> DataFrame:
    each = F.concat(*[F.transform(F.regexp_extract_all("text", F.lit(p), 0), _tagged(k)) for k, p in CLASSES.items()])
    return docs.select("doc_id", "lang", "source", F.explode(each).alias("h")).select("doc_id", "lang", "source", "h.*")


BY_CLASS_SQL = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{k}' AS type, unnest(regexp_extract_all(text, '{p}')) AS value FROM documents" for k, p in CLASSES.items())


@query(f"SELECT type, lang, source, count(*) AS hits, count(DISTINCT value) AS entities FROM ({BY_CLASS_SQL}) GROUP BY ALL")
def hits_by_type_lang_source(spark, sf_dir):
    return by_class(texts(spark, sf_dir)).groupBy("type", "lang", "source").agg(F.count("*").alias("hits"), F.count_distinct("value").alias("entities"))


@query(f"SELECT coalesce(type, 'TOTAL') AS type, coalesce(lang, 'TOTAL') AS lang, count(*) AS hits FROM ({BY_CLASS_SQL}) GROUP BY ROLLUP (type, lang)")
def hits_rollup(spark, sf_dir):
    rows = by_class(texts(spark, sf_dir)).rollup("type", "lang").agg(F.count("*").alias("hits"))
    return rows.select(F.coalesce("type", F.lit("TOTAL")).alias("type"), F.coalesce("lang", F.lit("TOTAL")).alias("lang"), "hits")


@query()
def detect_all_resolved(spark, sf_dir):
    """All rules at once, overlaps resolved: one row a span."""
    docs = texts(spark, sf_dir).select("doc_id", "text")
    return detect.exploded(detect.detect(docs)).select("doc_id", "start", "end", "type", "prio", "value")


@query()
def det_summary(spark, sf_dir):
    found = detect.detect(texts(spark, sf_dir).select("lang", "text"), keep=["lang"]).select("lang", F.explode("hits").alias("h"))
    return found.groupBy(F.col("h.type").alias("type"), "lang").agg(F.count("*").alias("hits"), F.sum(F.col("h.end") - F.col("h.start")).alias("chars"))


# ---- masking -----------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, sha256(regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g')) AS masked_sha256 FROM documents")
def mask_documents(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.sha2(F.regexp_replace("text", EMAIL, "[EMAIL]"), 256).alias("masked_sha256"))


TOKENS_SQL = f"""SELECT lang AS session_id, value, 'EMAIL_' || row_number() OVER (PARTITION BY lang ORDER BY seen, value) AS token FROM (
  SELECT lang, value, min(doc_id) AS seen FROM (SELECT lang, doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS value FROM documents) GROUP BY ALL)"""


def email_tokens(docs: DataFrame) -> DataFrame:
    found = docs.select(F.col("lang").alias("session_id"), F.col("doc_id").alias("seen"), F.explode(F.regexp_extract_all("text", F.lit(EMAIL), 0)).alias("value"), F.lit("EMAIL").alias("type"))
    return masking.number_tokens(found)


@query(TOKENS_SQL)
def email_token_numbering(spark, sf_dir):
    return email_tokens(texts(spark, sf_dir)).select("session_id", "value", "token")


@query(f"SELECT doc_id, sha256(text) AS restored_sha256, CAST(len(regexp_extract_all(text, '{EMAIL}')) AS BIGINT) AS tokens FROM documents")
def mask_roundtrip_check(spark, sf_dir):
    """Masked by the session's dictionary every address is a token; restored, every text is itself again."""
    docs = texts(spark, sf_dir).select("doc_id", F.col("lang").alias("session_id"), "text")
    pairs = email_tokens(texts(spark, sf_dir))
    masked = masking.mask(docs, pairs)
    back = masking.restore(masked, pairs.select("session_id", "token", "value"), text="masked")
    return back.select("doc_id", F.sha2("restored", 256).alias("restored_sha256"), F.size(T.tokens_in("masked")).cast("long").alias("tokens"))


@query(f"SELECT doc_id, count(DISTINCT value) AS leaks FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS value FROM documents) GROUP BY doc_id")
def leak_check(spark, sf_dir):
    """What a leak check finds when nothing was masked: every value of the session, where it stands."""
    docs = texts(spark, sf_dir)
    out = docs.select(F.col("doc_id").alias("session_id"), "doc_id", "text")
    vals = docs.select(F.col("doc_id").alias("session_id"), F.explode(F.regexp_extract_all("text", F.lit(EMAIL), 0)).alias("value"))
    return masking.leaks(out, vals).groupBy("doc_id").agg(F.count("*").alias("leaks"))


# ---- validators --------------------------------------------------------------------------------------------------
def _w(d: str, weights, start: int = 1) -> str:
    return "(" + " + ".join(f"CAST(substr({d}, {start + i}, 1) AS BIGINT) * {w}" for i, w in enumerate(weights)) + ")"


NUMBERS = {  # digits made from order keys, spread over each identifier's range
    "inn10": ("o_orderkey * 7919 + 1000000007", 10), "inn12": ("o_orderkey * 7919777 + 100000000003", 12), "ogrn": ("o_orderkey * 79197 + 1020000000001", 13),
    "ogrnip": ("o_orderkey * 79197 + 304000000000001", 15), "snils": ("o_orderkey * 79197 + 11223344595", 11),
}
CHECKS = {
    "inn10": f"substr(d, 1, 1) <> '0' AND {_w('d', V.W_INN10)} % 11 % 10 = CAST(substr(d, 10, 1) AS BIGINT)",
    "inn12": f"substr(d, 1, 1) <> '0' AND {_w('d', V.W_INN12_FIRST)} % 11 % 10 = CAST(substr(d, 11, 1) AS BIGINT) AND {_w('d', V.W_INN12_SECOND)} % 11 % 10 = CAST(substr(d, 12, 1) AS BIGINT)",
    "ogrn": "substr(d, 1, 1) IN ('1', '2', '5', '6') AND CAST(substr(d, 1, 12) AS BIGINT) % 11 % 10 = CAST(substr(d, 13, 1) AS BIGINT)",
    "ogrnip": "substr(d, 1, 1) IN ('3', '4') AND CAST(substr(d, 1, 14) AS BIGINT) % 13 % 10 = CAST(substr(d, 15, 1) AS BIGINT)",
    "snils": f"CAST(substr(d, 1, 9) AS BIGINT) > 1001998 AND {_w('d', range(9, 0, -1))} % 101 % 100 = CAST(substr(d, 10, 2) AS BIGINT)",
}


def _validator(kind: str):
    expr, n = NUMBERS[kind]

    def run(spark, sf_dir):
        rows = read(spark, sf_dir, "orders").select(F.expr(f"lpad(cast({expr} as string), {n}, '0')").alias("number"))
        return rows.select("number", getattr(V, kind)("number").alias("valid"))

    run.__name__ = f"validate_{kind}"
    Q[run.__name__] = run
    SQL[run.__name__] = f"SELECT d AS number, {CHECKS[kind]} AS valid FROM (SELECT lpad(CAST({expr} AS VARCHAR), {n}, '0') AS d FROM orders)"


for _kind in NUMBERS:
    _validator(_kind)


@query("SELECT 'DE' || c || lpad(CAST(k * 104729 AS VARCHAR), 18, '0') AS iban, CAST(lpad(CAST(k * 104729 AS VARCHAR), 18, '0') || '1314' || c AS HUGEINT) % 97 = 1 AS valid FROM (SELECT o_orderkey AS k, lpad(CAST(o_orderkey % 97 AS VARCHAR), 2, '0') AS c FROM orders)")
def validate_iban(spark, sf_dir):
    made = read(spark, sf_dir, "orders").select(F.expr("concat('DE', lpad(cast(o_orderkey % 97 as string), 2, '0'), lpad(cast(o_orderkey * 104729 as string), 18, '0'))").alias("iban"))
    return made.select("iban", V.iban("iban").alias("valid"))


@query(f"SELECT a AS account, b AS bik, {_w('w', [V.W_ACCOUNT[i % 3] for i in range(23)])} % 10 = 0 AS valid FROM (SELECT *, CASE WHEN a LIKE '301%' THEN '0' || substr(b, 5, 2) ELSE right(b, 3) END || a AS w FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN '40702' ELSE '30101' END || lpad(CAST(o_orderkey * 104729 AS VARCHAR), 15, '0') AS a, '04' || lpad(CAST(o_custkey * 7 AS VARCHAR), 7, '0') AS b FROM orders))")
def validate_account_bik(spark, sf_dir):
    made = read(spark, sf_dir, "orders").select(
        F.expr("concat(CASE WHEN o_orderkey % 2 = 0 THEN '40702' ELSE '30101' END, lpad(cast(o_orderkey * 104729 as string), 15, '0'))").alias("account"), F.expr("concat('04', lpad(cast(o_custkey * 7 as string), 7, '0'))").alias("bik"))
    return made.select("account", "bik", V.account_with_bik("account", "bik").alias("valid"))


_KW = "CASE o_orderkey % 5 WHEN 0 THEN 'ОГРН' WHEN 1 THEN 'ОГРНИП' WHEN 2 THEN 'ИНН' WHEN 3 THEN 'КПП' ELSE 'БИК' END"
_NUM = "lpad('7', CAST(8 + o_orderkey % 9 AS INT), '1')"


@query(f"SELECT o_orderkey, kw AS keyword, CASE kw WHEN 'ОГРН' THEN length(n) BETWEEN 11 AND 15 WHEN 'ОГРНИП' THEN length(n) BETWEEN 13 AND 15 WHEN 'ИНН' THEN length(n) BETWEEN 10 AND 12 ELSE length(n) = 9 END AS fits FROM (SELECT o_orderkey, {_KW} AS kw, {_NUM} AS n FROM orders)")
def keyword_length_window(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_KW).alias("keyword"), F.expr(_NUM).alias("n"))
    return rows.select("o_orderkey", "keyword", V.keyword_length("keyword", "n").alias("fits"))


# ---- contexts and keys -------------------------------------------------------------------------------------------
@query("SELECT doc_id, substr(text, greatest(p - 61, 0) + 1, least(p - 1, 60)) AS before FROM (SELECT doc_id, text, strpos(text, '@') AS p FROM documents) WHERE p > 0")
def left_context(spark, sf_dir):
    rows = texts(spark, sf_dir).select("doc_id", "text", F.instr("text", "@").alias("p")).where("p > 0")
    return rows.select("doc_id", T.left_context("text", F.col("p") - 1).alias("before"))


@query("SELECT doc_id, list_extract(string_split(substr(text, 1, p - 1), chr(10)), -1) AS before FROM (SELECT doc_id, text, strpos(text, '@') AS p FROM documents) WHERE p > 0")
def line_context(spark, sf_dir):
    rows = texts(spark, sf_dir).select("doc_id", "text", F.instr("text", "@").alias("p")).where("p > 0")
    return rows.select("doc_id", T.line_context("text", F.col("p") - 1).alias("before"))


@query("SELECT doc_id, regexp_matches(substr(text, greatest(p - 26, 0) + 1, least(p - 1, 25)), '[0-9]') AS digits_near FROM (SELECT doc_id, text, strpos(text, '@') AS p FROM documents) WHERE p > 0")
def context_predicate(spark, sf_dir):
    rows = texts(spark, sf_dir).select("doc_id", "text", F.instr("text", "@").alias("p")).where("p > 0")
    return rows.select("doc_id", T.left_context("text", F.col("p") - 1, 25).rlike("[0-9]").alias("digits_near"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^0-9a-z]', '', 'g') AS key FROM part")
def compact_key(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.compact_key("p_name").alias("key"))


@query("SELECT c_custkey, right(n, 10) AS phone_key, n AS value_key FROM (SELECT c_custkey, CAST(c_custkey * 1000003 + 79120000000 AS VARCHAR) AS n FROM customer)")
def merge_key_numbers(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.expr("cast(c_custkey * 1000003 + 79120000000 as string)").alias("n"))
    spaced = rows.select("c_custkey", F.concat(F.lit("+"), F.substring("n", 1, 1), F.lit(" ("), F.substring("n", 2, 3), F.lit(") "), F.substring("n", 5, 9)).alias("written"))
    return spaced.select("c_custkey", T.merge_key("written", F.lit("ТЕЛЕФОН")).alias("phone_key"), T.merge_key("written", F.lit("ИНН")).alias("value_key"))


@query("SELECT s_suppkey, trim(regexp_replace(lower(s_name), '\\s+', ' ', 'g'), ' .,;:') AS key FROM supplier")
def value_key(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", T.value_key("s_name", F.lit("НИК")).alias("key"))


ADDRESSES = (
    "г.Москва, ул. Лесная, д.5", "город Москва, улица Лесная, дом 5", "Москва г., Лесная ул., д. 5", "г. Москва, ул. Лесная, д. 7",
    "г. Москва, ул. Лесная, д. 5, корп. 2", "123456, РФ, г. Москва, ул. Лесная, д. 5, кв. 1",
)


@query("SELECT * FROM (VALUES (0, 'г лесная москва ул, д 5'), (1, 'г лесная москва ул, д 5'), (2, 'г лесная москва ул, д 5'), (3, 'г лесная москва ул, д 7'), (4, 'г лесная москва ул, д 5, к 2'), (5, 'г лесная москва ул, д 5, кв 1')) t(id, key)")
def address_key(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(ADDRESSES)), "id int, a string").select("id", T.address_key("a").alias("key"))


@query("SELECT doc_id, sha1(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS hash FROM documents")
def place_hash(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.place_hash("text").alias("hash"))


LOOSE_SAMPLES = ("[FIO_{}]", "FIO_{}", "[FIO {}]", "[FIO-{}]", "[fio_{}]", "[ФИО_{}]", "[ ОГРНИП_{} ]")


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 6 THEN 'OGRNIP_' ELSE 'FIO_' END || c_custkey AS token FROM customer")
def token_parse_loose(spark, sf_dir):
    forms = F.array(*[F.lit(x) for x in LOOSE_SAMPLES])
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.replace(F.get(forms, (F.col("c_custkey") % 7).cast("int")), F.lit("{}"), F.col("c_custkey").cast("string")).alias("t"))
    return rows.select("c_custkey", F.get(T.tokens_in(F.concat(F.lit("текст "), "t", F.lit(" и далее"))), F.lit(0)).alias("token"))


@query("SELECT c_custkey, 'Dear ' || c_name || ', account [INN_999999].' AS restored FROM customer")
def restore_tokens(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    texts = c.select((F.col("c_custkey") % 10).alias("session_id"), "c_custkey", F.concat(F.lit("Dear [fio "), "c_custkey", F.lit("], account [INN_999999].")).alias("text"))
    vals = c.select((F.col("c_custkey") % 10).alias("session_id"), F.concat(F.lit("FIO_"), "c_custkey").alias("token"), F.col("c_name").alias("value"))
    return masking.restore(texts, vals).select("c_custkey", "restored")


@query("SELECT * FROM (VALUES ('Общество с ограниченной ответственностью', 'ООО'), ('публичное  акционерное общество', 'ПАО'), ('Непубличное акционерное общество', 'НАО'), ('акционерное общество', 'АО'), ('ООО', 'ООО'), ('Завод', ''), ('Коммерческий банк', 'КБ')) t(form, short)")
def short_opf(spark, sf_dir):
    rows = [("Общество с ограниченной ответственностью",), ("публичное  акционерное общество",), ("Непубличное акционерное общество",), ("акционерное общество",), ("ООО",), ("Завод",), ("Коммерческий банк",)]
    return spark.createDataFrame(rows, "form string").select("form", T.short_form("form").alias("short"))


# ---- numbering, sessions, sets -----------------------------------------------------------------------------------
@query("SELECT c_name AS value, upper(c_mktsegment) || '_' || row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey, c_name) AS token FROM customer")
def token_numbering(spark, sf_dir):
    found = read(spark, sf_dir, "customer").select(F.lit("s").alias("session_id"), F.col("c_name").alias("value"), F.col("c_mktsegment").alias("type"), F.col("c_custkey").alias("seen"))
    return masking.number_tokens(found).select("value", "token")


MAPPINGS = """SELECT CAST(o_custkey % 50 AS BIGINT) AS session_id, o_orderkey AS id, 'YUL_' || (o_custkey % 200) AS token, 'c' || (o_custkey % 300) AS canonical_form,
  CASE WHEN o_orderstatus = 'F' THEN 'excluded' ELSE 'active' END AS status, o_orderkey % 7 = 0 AS canonical_edited, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS opf FROM orders"""


def mappings(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        (F.col("o_custkey") % 50).alias("session_id"), F.col("o_orderkey").alias("id"), F.concat(F.lit("YUL_"), F.col("o_custkey") % 200).alias("token"), F.concat(F.lit("c"), F.col("o_custkey") % 300).alias("canonical_form"),
        F.when(F.col("o_orderstatus") == "F", "excluded").otherwise("active").alias("status"), (F.col("o_orderkey") % 7 == 0).alias("canonical_edited"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise("").alias("opf"))


@query(f"SELECT s.session_id, CAST(coalesce(n, 0) AS BIGINT) AS tokens FROM (SELECT CAST(range AS BIGINT) AS session_id FROM range(60)) s LEFT JOIN (SELECT session_id, count(DISTINCT CASE WHEN status = 'active' THEN token END) AS n FROM ({MAPPINGS}) GROUP BY 1) m USING (session_id)")
def session_records_left_join(spark, sf_dir):
    return store.session_counts(spark.range(60).select(F.col("id").alias("session_id")), mappings(spark, sf_dir))


@query(f"SELECT session_id, token, count(DISTINCT canonical_form) AS n FROM ({MAPPINGS}) GROUP BY 1, 2 HAVING count(DISTINCT canonical_form) > 1")
def duplicate_values_many_tokens(spark, sf_dir):
    return store.duplicate_tokens(mappings(spark, sf_dir))


_RN = "SELECT CAST(l_suppkey % 20 AS BIGINT) AS session_id, 'P' AS prefix, CAST(l_partkey AS BIGINT) AS n, l_orderkey * 10 + l_linenumber AS id FROM lineitem"


@query(f"""WITH m AS ({_RN}), a AS (SELECT *, row_number() OVER (PARTITION BY session_id, prefix, n ORDER BY id) AS rn FROM m),
 t AS (SELECT session_id, prefix, max(n) AS top FROM m GROUP BY 1, 2)
 SELECT session_id, prefix, n, id FROM a WHERE rn = 1 UNION ALL
 SELECT session_id, prefix, CAST(top + k AS BIGINT) AS n, id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, prefix ORDER BY id) AS k FROM a WHERE rn > 1) JOIN t USING (session_id, prefix)""")
def dedupe_renumber(spark, sf_dir):
    m = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).cast("long").alias("session_id"), F.lit("P").alias("prefix"), F.col("l_partkey").cast("long").alias("n"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return store.renumber(m, "id")


@query("SELECT c_name AS value FROM customer WHERE c_acctbal < 0 UNION SELECT s_name FROM supplier")
def exclusions_union(spark, sf_dir):
    return read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_name").alias("value")).union(read(spark, sf_dir, "supplier").select("s_name")).distinct()


@query("SELECT value, arg_max(kind, pos) AS kind FROM (SELECT event_type || '-' || (user_id % 40) AS value, event_id AS pos, CASE WHEN event_id % 3 = 0 THEN 'never' ELSE 'always' END AS kind FROM events) GROUP BY 1")
def always_never_exclusive(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.concat("event_type", F.lit("-"), F.col("user_id") % 40).alias("value"), F.col("event_id").alias("at"))
    return store.exclusive(e.where("at % 3 <> 0"), e.where("at % 3 = 0"))


@query("(SELECT c_nationkey AS k, 'both' AS found FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT c_nationkey, 'first' FROM customer EXCEPT SELECT s_nationkey, 'first' FROM supplier)")
def rules_vs_llm_intersect(spark, sf_dir):
    a, b = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).withColumn("found", F.lit("both")).union(a.subtract(b).withColumn("found", F.lit("first")))


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal < 0) AND o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def exclusion_anti_join(spark, sf_dir):
    found = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lit(1).alias("session_id"), F.col("o_custkey").alias("value"))
    bad = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.lit(1).alias("session_id"), F.col("c_custkey").alias("value"))
    return store.not_excluded(found, bad, read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("value"))).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS in_dict FROM customer")
def in_dict_flag(spark, sf_dir):
    known = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("in_dict", F.lit(True))
    return read(spark, sf_dir, "customer").select("c_custkey").join(known, "c_custkey", "left").select("c_custkey", F.coalesce("in_dict", F.lit(False)).alias("in_dict"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphans_anti(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


_ALIAS = "SELECT 1 AS session_id, 'T' || p_partkey AS old_token, 'T' || (p_partkey // 3) AS new_token FROM part WHERE p_partkey % 2 = 0"


def _aliases(spark, sf_dir):
    return read(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.lit(1).alias("session_id"), F.concat(F.lit("T"), "p_partkey").alias("old_token"), F.expr("concat('T', p_partkey div 3)").alias("new_token"))


@query(f"SELECT 'T' || p_partkey AS token, coalesce(a.new_token, 'T' || p_partkey) AS now FROM part LEFT JOIN ({_ALIAS}) a ON a.old_token = 'T' || p_partkey")
def alias_one_hop(spark, sf_dir):
    t = read(spark, sf_dir, "part").select(F.concat(F.lit("T"), "p_partkey").alias("token"))
    return t.join(_aliases(spark, sf_dir), F.col("token") == F.col("old_token"), "left").select("token", F.coalesce("new_token", "token").alias("now"))


@query(f"WITH RECURSIVE a AS ({_ALIAS}), r AS (SELECT old_token, new_token, 0 AS d FROM a UNION ALL SELECT r.old_token, a.new_token, d + 1 FROM r JOIN a ON r.new_token = a.old_token WHERE d < 40) SELECT old_token, arg_max(new_token, d) AS new_token FROM r GROUP BY 1")
def alias_transitive(spark, sf_dir):
    return masking.aliases_resolved(_aliases(spark, sf_dir)).select("old_token", "new_token")


@query("""WITH p AS (SELECT conv_id AS doc_id, turn AS place_no, role AS hash, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations),
 f(hash, variant_no, items) AS (VALUES ('user', 1, 'u1'), ('user', 2, 'u2'), ('assistant', 1, 'a1')), n AS (SELECT hash, max(variant_no) AS n FROM f GROUP BY 1)
 SELECT doc_id, place_no, p.hash, CAST(least(k, n) AS INT) AS variant_no, items FROM p JOIN n ON p.hash = n.hash JOIN f ON f.hash = p.hash AND f.variant_no = least(k, n)""")
def place_kth_occurrence(spark, sf_dir):
    places = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("place_no"), F.col("role").alias("hash"))
    forms = spark.createDataFrame([("user", 1, "u1"), ("user", 2, "u2"), ("assistant", 1, "a1")], "hash string, variant_no int, items string")
    return store.places_restored(places, forms)


# ---- entities ----------------------------------------------------------------------------------------------------
def _companies(spark, sf_dir) -> DataFrame:
    """Suppliers written three ways."""
    s = read(spark, sf_dir, "supplier")
    forms = F.array(F.concat(F.lit('ООО "'), "s_name", F.lit('"')), F.upper("s_name"), F.translate(F.initcap("s_name"), "#", " "))
    rows = s.select(F.lit("1").alias("session_id"), "s_suppkey", F.posexplode(forms).alias("i", "original_form"))
    return rows.select("session_id", F.concat(F.lit("YUL_"), F.col("s_suppkey") * 3 + F.col("i")).alias("token"), "original_form", F.lit("ЮЛ").alias("entity_type"), F.lit("active").alias("status"))


@query("SELECT '1' AS session_id, 'YUL_' || (s_suppkey * 3 + i) AS token, 'YUL_' || (s_suppkey * 3) AS kept FROM supplier, range(3) r(i)")
def auto_groups_components(spark, sf_dir):
    return entities.auto_groups(_companies(spark, sf_dir))


@query("""WITH k AS (SELECT 'YUL_' || s_suppkey AS t, regexp_replace(lower(s_name), '[^0-9a-z]', '', 'g') AS s FROM supplier)
 SELECT least(a.t, b.t) AS a, greatest(a.t, b.t) AS b FROM k a JOIN k b ON a.t < b.t AND a.s <> b.s WHERE length(a.s) >= 4 AND length(b.s) >= 4 AND levenshtein(a.s, b.s) <= greatest(1, least(length(a.s), length(b.s)) // 8)""")
def review_pairs_levenshtein(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    m = s.select(F.lit("1").alias("session_id"), F.concat(F.lit("YUL_"), "s_suppkey").alias("token"), F.col("s_name").alias("original_form"), F.lit("ЮЛ").alias("entity_type"), F.lit("active").alias("status"))
    return entities.review_pairs(m).select("a", "b")


@query(f"""WITH m AS ({MAPPINGS}), r AS (SELECT *, row_number() OVER (PARTITION BY session_id, token ORDER BY canonical_edited DESC, CASE WHEN canonical_edited THEN -id ELSE 0 END, status = 'active' DESC, id) AS rn FROM m)
 SELECT session_id, token, max(CASE WHEN rn = 1 THEN canonical_form END) AS canonical_form, arg_min(opf, id) FILTER (opf <> '') AS opf FROM r GROUP BY 1, 2""")
def reverse_info_first_edited(spark, sf_dir):
    return store.main_forms(mappings(spark, sf_dir))


@query("SELECT user_id AS value, CAST(count(*) AS BIGINT) AS seen_count, max(event_id) AS last_seen_at FROM events GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 50")
def top_known_values(spark, sf_dir):
    seen = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("value")).agg(F.count("*").alias("seen_count"), F.max("event_id").alias("last_seen_at"))
    return store.top_known(seen, 50)


@query("SELECT 'P_' || p_partkey AS token, CAST(row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS n FROM part")
def natural_token_order(spark, sf_dir):
    """Ranks by prefix and number, built on sorted ranges, so no task sees the whole table."""
    t = read(spark, sf_dir, "part").select(F.concat(F.lit("P_"), "p_partkey").alias("token")).withColumn("k", entities.token_number("token"))
    block = t.withColumn("b", F.expr("k div 1000"))
    before = block.groupBy("b").agg(F.count("*").alias("c")).withColumn("base", F.coalesce(F.sum("c").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("b").orderBy("k")
    return block.withColumn("r", F.row_number().over(w)).join(before, "b").select("token", (F.col("base") + F.col("r")).cast("long").alias("n"))


@query("""SELECT word, CAST(sum(a) AS BIGINT) AS only_user FROM (
 SELECT unnest(string_split(text, ' ')) AS word, 1 AS a FROM conversations WHERE role = 'user' UNION ALL SELECT unnest(string_split(text, ' ')), -1 FROM conversations WHERE role <> 'user') GROUP BY 1 HAVING sum(a) > 0""")
def word_multiset_diff(spark, sf_dir):
    w = read(spark, sf_dir, "conversations").select("role", F.explode(F.split("text", " ")).alias("word"))
    return w.groupBy("word").agg(F.sum(F.when(F.col("role") == "user", 1).otherwise(-1)).alias("only_user")).where("only_user > 0")


@query("SELECT doc_id, CAST(s AS BIGINT) AS start, CAST(CASE WHEN n <= 3500 THEN n ELSE least(3000, n - s) END AS BIGINT) AS chars FROM (SELECT doc_id, length(text) AS n, unnest(CASE WHEN length(text) <= 3500 THEN [0] ELSE range(0, length(text) - 150, 2850) END) AS s FROM documents)")
def chunk_windows(spark, sf_dir):
    rows = texts(spark, sf_dir).select("doc_id", F.explode(T.windows("text")).alias("w"))
    return rows.select("doc_id", F.col("w.start").cast("long").alias("start"), F.length("w.piece").cast("long").alias("chars"))


@query("SELECT coalesce(category, 'TOTAL') AS category, count(*) AS cases, count(*) FILTER (k % 5 <> 0 AND k % 7 <> 0 AND k % 11 <> 0) AS ok, count(*) FILTER (k % 7 = 0) AS fp, count(*) FILTER (k % 11 = 0) AS rt FROM (SELECT o_orderpriority AS category, o_orderkey AS k FROM orders) GROUP BY ROLLUP (category)")
def bench_metrics(spark, sf_dir):
    k = F.col("o_orderkey")
    some = lambda n: F.when(k % n == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return store.bench(read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), some(5).alias("leaked"), some(7).alias("lost"), (k % 11 != 0).alias("roundtrip_ok")))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 90 DAYS")
def retention_expired(spark, sf_dir):
    s = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return store.expired(s, "1998-01-01 00:00:00", 90).select("id")


@query("SELECT user_id, max(event_id) AS last_event, date_diff('second', max(ts), (SELECT max(ts) FROM events)) > 120 AS stale FROM events GROUP BY 1")
def stale_jobs(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = e.agg(F.max("ts").alias("now"))
    last = e.groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.max("ts").alias("t"))
    return last.join(F.broadcast(now)).select("user_id", "last_event", (F.unix_timestamp("now") - F.unix_timestamp("t") > 120).alias("stale"))


@query("SELECT o_custkey AS session_id, count(*) AS files, count(*) FILTER (o_orderpriority < '3') AS files_anon, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority < '3') AS ready_anon FROM orders GROUP BY 1")
def session_file_counts(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    anon = F.col("o_orderpriority") < "3"
    return o.groupBy(F.col("o_custkey").alias("session_id")).agg(F.count("*").alias("files"), F.count_if(anon).alias("files_anon"), F.count_if((F.col("o_orderstatus") == "F") & anon).alias("ready_anon"))


@query("SELECT * FROM (VALUES ('Иванов Пётр Сергеевич', 'иванов', 'петр'), ('Иванова П.С.', 'иванов', 'п'), ('Анны Петровны Белозёровой', 'белозеров', 'анна'), ('Ковальского', 'ковальск', NULL)) t(form, surname, name)")
def person_parse(spark, sf_dir):
    rows = spark.createDataFrame([("Иванов Пётр Сергеевич",), ("Иванова П.С.",), ("Анны Петровны Белозёровой",), ("Ковальского",)], "form string")
    return rows.select("form", entities.person("form").alias("p")).select("form", "p.surname", "p.name")


# ---- files, marks, forms -----------------------------------------------------------------------------------------
_EXT = "CASE o_orderkey % 6 WHEN 0 THEN 'TXT' WHEN 1 THEN 'docx' WHEN 2 THEN 'doc' WHEN 3 THEN 'png' WHEN 4 THEN 'exe' ELSE 'xlsx' END"


@query(f"SELECT o_orderkey, CASE o_orderkey % 6 WHEN 2 THEN 'convert' WHEN 3 THEN 'scan' WHEN 4 THEN 'format' ELSE 'ok' END AS code FROM orders")
def file_format_check(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("/in/a.b/f"), "o_orderkey", F.lit("."), F.expr(_EXT)).alias("path"))
    return rows.select("o_orderkey", store.format_code("path").alias("code"))


@query("SELECT o_orderkey, CASE WHEN regexp_full_match(t, '[1-9][0-9]{0,14}') THEN CAST(t AS BIGINT) END AS value FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '0' || o_orderkey WHEN 1 THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderkey || 'x' END AS t FROM orders)")
def xlsx_numeric_restore(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.expr("CASE o_orderkey % 3 WHEN 0 THEN concat('0', o_orderkey) WHEN 1 THEN cast(o_orderkey AS string) ELSE concat(o_orderkey, 'x') END").alias("t"))
    return rows.select("o_orderkey", store.numeric_again("t").alias("value"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN '' ELSE md5(text) END AS text FROM conversations")
def metadata_scrub(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "title").otherwise("paragraph").alias("kind"), F.md5("text").alias("value"))
    return rows.select("conv_id", "turn", store.scrubbed("kind", "value").alias("text"))


@query("SELECT mark, value, count(*) AS n, min(pos) AS first, CASE mark WHEN 'unknown' THEN 0 WHEN 'case' THEN 1 ELSE 2 END AS severity FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'case' ELSE 'exact' END AS mark, user_id AS value, event_id AS pos FROM events) GROUP BY mark, value")
def restore_marks_summary(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.expr("CASE event_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'case' ELSE 'exact' END").alias("mark"), F.col("user_id").alias("value"), F.col("event_id").alias("pos"))
    return store.marks_summary(e)


@query("SELECT conv_id AS token, string_agg(role, '|' ORDER BY turn) AS forms FROM conversations GROUP BY conv_id")
def occurrence_forms(spark, sf_dir):
    return store.forms_in_order(read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("token"), F.col("turn").alias("seq"), F.col("role").alias("original")))


@query("SELECT value, min(doc_id) AS doc_id FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents) WHERE length(value) >= 3 GROUP BY value")
def split_lines_first_wins(spark, sf_dir):
    lines = texts(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("value")).where(F.length("value") >= 3)
    return store.first_wins(lines, "value", "doc_id")


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem")
def unordered_pairs(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).distinct()


@query("SELECT p_brand, p_size AS median FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part WHERE p_size > 6 AND p_size < 30) WHERE rn = n // 2 + 1")
def median_font_size(spark, sf_dir):
    return store.upper_median(read(spark, sf_dir, "part").where("p_size > 6 AND p_size < 30").select("p_brand", "p_size"), "p_brand", "p_size")


@query("SELECT place, gen, seq FROM (SELECT o_custkey AS place, o_orderkey % 10 AS gen, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 10 DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def newest_place_forms(spark, sf_dir):
    return store.newest_forms(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("place"), (F.col("o_orderkey") % 10).alias("gen"), F.col("o_orderkey").alias("seq")))


@query("SELECT 'S (' || (count(*) + 1) || ')' AS name FROM nation")
def default_session_name(spark, sf_dir):
    names = read(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") == 0, "S").otherwise(F.concat(F.lit("S ("), F.col("n_nationkey") + 1, F.lit(")"))).alias("name"))
    return store.first_free_name(names, "S")


@query("SELECT event_type AS stage, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def job_stage_totals(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.sum("p.k").alias("total"))


_STATE = "CASE WHEN last % 5 = 0 THEN 'done' WHEN CAST(epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(beat) AS BIGINT) > 86400 THEN 'interrupted' ELSE 'running' END"


@query(f"SELECT job_id, stage, stages, seconds, {_STATE} AS state FROM (SELECT user_id AS job_id, arg_max(event_type, {{'t': ts, 's': event_type}}) AS stage, arg_max(event_id, {{'t': ts, 's': event_type}}) AS last, count(DISTINCT event_type) AS stages, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds, max(ts) AS beat FROM events GROUP BY 1)".replace("epoch(beat)", "floor(epoch(beat))"))
def job_progress(spark, sf_dir):
    """Where every user's job stands by its last beat, the interrupted ones told apart."""
    beats = read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 5 == 0).alias("done"))
    return store.stage_progress(beats, F.lit("2024-01-20 00:00:00"), 86400)


_BODY = "CAST(100000000 + o_orderkey * 7919 % 899999999 AS VARCHAR)"


def _weighted_sql(body: str, weights: list[int]) -> str:
    return f"list_sum(list_transform(range(1, {len(weights) + 1}), lambda i: CAST(({body})[i] AS INT) * ({weights})[i]))"


_I12 = f"'5' || {_BODY} || ({_weighted_sql("'5' || " + _BODY, [7, 2, 4, 10, 3, 5, 9, 4, 6, 8])} % 11 % 10)"
_REST = f"{_weighted_sql(_BODY, [9, 8, 7, 6, 5, 4, 3, 2, 1])} % 101 % 100"


@query(
    f"SELECT o_orderkey, {_BODY} || ({_weighted_sql(_BODY, [2, 4, 10, 3, 5, 9, 4, 6, 8])} % 11 % 10) AS inn10, {_I12} || ({_weighted_sql(_I12, [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8])} % 11 % 10) AS inn12, "
    f"'102' || {_BODY} || (CAST('102' || {_BODY} AS BIGINT) % 11 % 10) AS ogrn, '30400' || {_BODY} || (CAST('30400' || {_BODY} AS BIGINT) % 13 % 10) AS ogrnip, "
    f"{_BODY}[1:3] || '-' || {_BODY}[4:6] || '-' || {_BODY}[7:9] || ' ' || lpad(CAST({_REST} AS VARCHAR), 2, '0') AS snils, true AS valid FROM orders"
)
def generated_identifiers(spark, sf_dir):
    """Identifiers made with their check digits, all valid by the validators."""
    body = (100000000 + F.col("o_orderkey") * 7919 % 899999999).cast("string")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", body.alias("b")).select(
        "o_orderkey", V.completed("inn10", "b").alias("inn10"), V.completed("inn12", F.concat(F.lit("5"), "b")).alias("inn12"), V.completed("ogrn", F.concat(F.lit("102"), "b")).alias("ogrn"),
        V.completed("ogrnip", F.concat(F.lit("30400"), "b")).alias("ogrnip"), V.completed("snils", "b").alias("snils"), V.completed_account(F.concat(F.lit("407028100"), "b", F.lit("00")), F.lit("041588139")).alias("account"),
    )
    valid = V.inn10("inn10") & V.inn12("inn12") & V.ogrn("ogrn") & V.ogrnip("ogrnip") & V.snils("snils") & V.account_with_bik("account", F.lit("041588139"))
    return rows.withColumn("valid", valid).drop("account")


@query("SELECT token, status, form FROM (SELECT user_id AS token, arg_max(CASE event_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'excluded' WHEN 2 THEN 'active' ELSE 'replaced' END, event_id) AS status, arg_max(event_type, event_id) FILTER (event_id % 4 = 0) AS form FROM events GROUP BY 1)")
def edits_folded(spark, sf_dir):
    ops = "CASE event_id % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'exclude' WHEN 2 THEN 'unexclude' ELSE 'replace' END"
    e = read(spark, sf_dir, "events").select(F.lit(1).alias("session_id"), F.col("user_id").alias("token"), F.expr(ops).alias("op"), F.col("event_id").alias("ts"), F.col("event_type").alias("value"))
    return store.merge_events(e).select("token", "status", "form")


@query("SELECT * FROM (VALUES ('Белозёров Аркадий Львович', 'datv', 'Белозёрову Аркадию Львовичу'), ('Скворцова Елена Дмитриевна', 'gent', 'Скворцовой Елены Дмитриевны'), ('Зелинский Олег Петрович', 'ablt', 'Зелинским Олегом Петровичем')) t(name, kase, form)")
def decline_names(spark, sf_dir):
    rows = spark.createDataFrame([("Белозёров Аркадий Львович", "datv"), ("Скворцова Елена Дмитриевна", "gent"), ("Зелинский Олег Петрович", "ablt")], "name string, kase string")
    return rows.select("name", "kase", grammar.decline("name", "kase").alias("form"))


@query("SELECT * FROM (VALUES ('Документы получены от ', '.', 'gent'), ('Письмо направить ', ' до пятницы.', 'datv'), ('Необходимо уведомить ', ' о сделке.', 'accs'), ('Сведения о ', ' устарели.', 'loct')) t(l, r, kase)")
def target_case(spark, sf_dir):
    rows = spark.createDataFrame([("Документы получены от ", "."), ("Письмо направить ", " до пятницы."), ("Необходимо уведомить ", " о сделке."), ("Сведения о ", " устарели.")], "l string, r string")
    return rows.select("l", "r", grammar.target_case("l", "r").alias("kase"))


@query("SELECT doc_id, CAST(count(*) AS BIGINT) AS blocks_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents) GROUP BY 1")
def pack_blocks(spark, sf_dir):
    """Lines packed into blocks; the blocks hold every line once."""
    lines = texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    blocks = layout.packed_blocks(lines, 3000)
    return blocks.groupBy("doc_id").agg(F.sum(F.size(F.split("text", "\n"))).cast("long").alias("blocks_lines"))


@query("SELECT session_id, value, 'U_' || row_number() OVER (PARTITION BY session_id ORDER BY seen, value) AS token FROM (SELECT event_type AS session_id, CAST(user_id AS VARCHAR) AS value, min(event_id) AS seen FROM events GROUP BY 1, 2)")
def stream_session_tokens(spark, sf_dir):
    """The session store over a stream of finds, run to the end of what is there."""
    schema = read(spark, sf_dir, "events").schema
    finds = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    finds = finds.select(F.col("event_type").alias("session_id"), F.col("user_id").cast("string").alias("value"), F.lit("U").alias("type"), F.lit("U").alias("prefix"), F.col("event_id").alias("seen"))
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    run = sessions.session_tokens(finds).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(sessions.OUT).parquet(f"{out}/rows").select("session_id", "value", "token")


def queries() -> dict:
    from . import golden, golden_files, golden_tables  # noqa: F401

    return golden.Q | golden_tables.Q | Q


def oracle_sql() -> dict:
    from . import golden, golden_files, golden_tables  # noqa: F401

    return golden.SQL | golden_tables.SQL | SQL

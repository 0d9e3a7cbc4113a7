"""The session store: tables of mappings, exclusions, dictionary, places and their folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from . import entities, masking
from .graph import numbered


def session_counts(sessions: DataFrame, mappings: DataFrame) -> DataFrame:
    """Every session with its number of distinct active tokens, 0 without any."""
    n = mappings.groupBy("session_id").agg(F.count_distinct(F.when(F.col("status") == "active", F.col("token"))).alias("tokens"))
    return sessions.join(n, "session_id", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("long"))


def duplicate_tokens(mappings: DataFrame) -> DataFrame:
    """Tokens that more than one entity has."""
    return mappings.groupBy("session_id", "token").agg(F.count_distinct("canonical_form").alias("n")).where("n > 1")


def renumber(mappings: DataFrame, order: str) -> DataFrame:
    """Every repeat of a (session, prefix, n) gets a number after the prefix's largest; the first keeps its own."""
    w = Window.partitionBy("session_id", "prefix", "n").orderBy(order)
    again = mappings.withColumn("rn", F.row_number().over(w))
    top = mappings.groupBy("session_id", "prefix").agg(F.max("n").alias("top"))
    moved = numbered(again.where("rn > 1"), ["session_id", "prefix"], [order], "k").join(top, ["session_id", "prefix"]).withColumn("n", F.col("top") + F.col("k"))
    return again.where("rn = 1").select(mappings.columns).unionByName(moved.select(mappings.columns))


def not_excluded(found: DataFrame, exclusions: DataFrame, never: DataFrame | None = None) -> DataFrame:
    """Finds that neither the session's exclusions (session_id, value, and if known type) nor the global list (value) hold.

    Without a type by the exact value; with it also by the value's key, and persons by a compatible form that names at
    least two of surname, name and patronymic.
    """
    out = found.join(exclusions.select("session_id", "value"), ["session_id", "value"], "left_anti")
    if never is not None:
        out = out.join(never.select("value"), "value", "left_anti")
    if "type" in exclusions.columns and "type" in found.columns:
        keys = exclusions.select("session_id", "type", T.value_key("value", "type").alias("key_")).distinct()
        out = out.withColumn("key_", T.value_key("value", "type")).join(keys, ["session_id", "type", "key_"], "left_anti")
        people = exclusions.where(F.col("type") == "ФИО").select(F.col("session_id").alias("s_"), entities.person("value").alias("p_")).where(entities.specificity(F.col("p_")) >= 2)
        people = people.withColumn("n_", F.coalesce("p_.surname", F.lit("")))
        me = entities.person("value")
        out = out.withColumns({"me_": F.when(F.col("type") == "ФИО", me)}).withColumn("my_", F.coalesce("me_.surname", F.lit("")))
        out = out.join(people, (out["session_id"] == people["s_"]) & (out["my_"] == people["n_"]) & entities.compatible(F.col("me_"), F.col("p_")), "left_anti")
    return out.select(found.columns)


def exclusive(always: DataFrame, never: DataFrame) -> DataFrame:
    """Both lists as one, a value being in the list it was put into last."""
    both = always.select("value", "at").withColumn("kind", F.lit("always")).unionByName(never.select("value", "at").withColumn("kind", F.lit("never")))
    return both.groupBy("value").agg(F.max(F.struct("at", "kind")).alias("m")).select("value", "m.kind")


def top_known(values: DataFrame, n: int = 500) -> DataFrame:
    """The n values seen most, the latest first among equals."""
    return values.orderBy(F.desc("seen_count"), F.desc("last_seen_at"), "value").limit(n)


def main_forms(mappings: DataFrame) -> DataFrame:
    """One form a token: the last edited row, else the first active, else the first."""
    rank = F.struct(F.col("canonical_edited").cast("int"), F.when(F.col("canonical_edited"), F.col("id")).otherwise(F.lit(0)), (F.col("status") == "active").cast("int"), -F.col("id"))
    return mappings.groupBy("session_id", "token").agg(F.max_by("canonical_form", rank).alias("canonical_form"), F.min_by("opf", F.when(F.coalesce("opf", F.lit("")) != "", F.col("id"))).alias("opf"))


def places_restored(places: DataFrame, forms: DataFrame) -> DataFrame:
    """Each place with the variant recorded for its k-th occurrence, the last one if there are fewer.

    places: doc_id, place_no, hash; forms: hash, variant_no (from 1), items.
    """
    w = Window.partitionBy("doc_id", "hash").orderBy("place_no")
    n = forms.groupBy("hash").agg(F.max("variant_no").cast("int").alias("n"))
    k = places.withColumn("k", F.row_number().over(w)).join(n, "hash").withColumn("variant_no", F.least("k", "n"))
    return k.join(forms, ["hash", "variant_no"]).select("doc_id", "place_no", "hash", "variant_no", "items")


def expired(sessions: DataFrame, now, days: int) -> DataFrame:
    return sessions.where(F.col("created_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))


def merge_events(events: DataFrame) -> DataFrame:
    """Mappings after a log of edits (session_id, ts, op, token, value): the last status and form of each token win.

    Operations: add, exclude, unexclude, replace, edit.
    """
    status = {"add": "active", "exclude": "excluded", "unexclude": "active", "replace": "replaced"}
    table = F.create_map(*[F.lit(x) for kv in status.items() for x in kv])
    return events.groupBy("session_id", "token").agg(
        F.max_by(table[F.col("op")], F.when(table[F.col("op")].isNotNull(), F.struct("ts", "op"))).alias("status"),
        F.max_by("value", F.when(F.col("op").isin("add", "edit"), F.struct("ts", "op"))).alias("form"),
    )


def bench(cases: DataFrame) -> DataFrame:
    """Cases, passes, false positives and round-trip failures by category and in total.

    cases: category, leaked (array), lost (array), roundtrip_ok.
    """
    ok = (F.size("leaked") == 0) & (F.size("lost") == 0) & F.col("roundtrip_ok")
    return cases.rollup("category").agg(
        F.count("*").alias("cases"), F.count_if(ok).alias("ok"), F.count_if(F.size("lost") > 0).alias("fp"), F.count_if(~F.col("roundtrip_ok")).alias("rt"),
    ).withColumn("category", F.coalesce("category", F.lit("TOTAL")))


def format_code(path) -> F.Column:
    """ok, or why a file can't be taken: format (unknown), convert (needs another program), scan (an image)."""
    ext = F.lower(F.regexp_extract(F.col(path), r"[.]([^./]+)$", 1))
    return (
        F.when(ext.isin("txt", "docx", "docm", "pptx", "xlsx", "xlsm", "rtf", "pdf"), "ok").when(ext.isin("doc", "odt"), "convert")
        .when(ext.isin("png", "jpg", "jpeg", "tif", "tiff", "bmp", "heic"), "scan").otherwise("format")
    )


def numeric_again(text) -> F.Column:
    """A restored cell as a number if it is digits without a leading zero, under 16 of them; else null."""
    return F.when(F.col(text).rlike("^[1-9][0-9]{0,14}$"), F.col(text).try_cast("bigint"))


def scrubbed(kind, value) -> F.Column:
    """Metadata goes, text stays."""
    return F.when(F.col(kind).isin("creator", "company", "title", "lastModifiedBy", "property"), F.lit("")).otherwise(F.col(value))


def marks_summary(marks: DataFrame) -> DataFrame:
    """Restored marks (mark, value, pos) with counts and first places, the doubtful ones first."""
    severity = F.when(F.col("mark") == "unknown", 0).when(F.col("mark") == "case", 1).otherwise(2)
    return marks.groupBy("mark", "value").agg(F.count("*").alias("n"), F.min("pos").alias("first")).withColumn("severity", severity)


def forms_in_order(occurrences: DataFrame) -> DataFrame:
    """(token, forms): the forms of each token in order of their places, joined by a bar."""
    return occurrences.groupBy("token").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "original"))), lambda x: x["original"]), "|").alias("forms"))


def first_wins(pairs: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with equal keys the first."""
    return pairs.groupBy(key).agg(F.min(F.struct(order, *[c for c in pairs.columns if c not in (key, order)])).alias("r_")).select(key, "r_.*")


def upper_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The value at n div 2 + 1 of each group, in order."""
    w = Window.partitionBy(group).orderBy(value)
    n = F.count("*").over(Window.partitionBy(group))
    return rows.withColumns({"rn_": F.row_number().over(w), "n_": n}).where(F.col("rn_") == F.floor(F.col("n_") / 2) + 1).select(group, F.col(value).alias("median"))


def newest_forms(forms: DataFrame) -> DataFrame:
    """Of each place the forms of the newest generation."""
    w = Window.partitionBy("place").orderBy(F.desc("gen"), "seq")
    return forms.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def first_free_name(names: DataFrame, base: str) -> DataFrame:
    """(name): base, or base (n) with the smallest n from 2 that no name has."""
    pattern = "^" + base.replace(".", "[.]") + r"(?: [(]([0-9]+)[)])?$"
    n = names.where(F.col("name").rlike(pattern)).select(F.when(F.col("name") == base, 1).otherwise(F.regexp_extract("name", pattern, 1).try_cast("bigint")).alias("n")).distinct()
    w = Window.orderBy("n")  # numbers of one base name: as many as a user made on one day
    run = n.where("n >= 1").withColumn("r", F.row_number().over(w)).agg(F.coalesce(F.max(F.when(F.col("n") == F.col("r"), F.col("r"))), F.lit(0)).alias("k"))
    return run.select(F.when(F.col("k") == 0, base).otherwise(F.concat(F.lit(base + " ("), (F.col("k") + 1).cast("string"), F.lit(")"))).alias("name"))


def merged(mappings: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mappings after tokens were declared one: forms of ``old_token`` belong to ``new_token`` and are active.

    aliases: session_id, old_token, new_token, followed to the end (``masking.aliases_resolved``).
    """
    out = mappings.join(aliases.select("session_id", F.col("old_token").alias("token"), "new_token"), ["session_id", "token"], "left")
    moved = F.col("new_token").isNotNull()
    return out.withColumns({"token": F.coalesce("new_token", "token"), "status": F.when(moved, "active").otherwise(F.col("status"))}).select(mappings.columns)


def with_forms(mappings: DataFrame, forms: DataFrame) -> DataFrame:
    """Mappings with further written forms of known entities: a form of the same type that is known moves to the token,
    and is active; others are new rows. forms: session_id, token, original_form, entity_type."""
    key = ["session_id", "original_form", "entity_type"]
    moved = mappings.join(forms.select(*key, F.col("token").alias("to_")), key, "left")
    moved = moved.withColumns({"token": F.coalesce("to_", "token"), "status": F.when(F.col("to_").isNotNull(), "active").otherwise(F.col("status"))}).select(mappings.columns)
    new = forms.join(mappings.select(key), key, "left_anti").withColumn("status", F.lit("active"))
    return moved.unionByName(new, allowMissingColumns=True)


def without_sessions(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All of a store's tables without the rows of deleted sessions (session_id)."""
    return {name: t.join(gone.select("session_id").distinct(), "session_id", "left_anti") for name, t in tables.items()}


def unexcluded(mappings: DataFrame, exclusions: DataFrame, back: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mappings, exclusions) after tokens (session_id, token) are masked again: active, and their forms no exclusions,
    however those are written."""
    hit = mappings.join(back.select("session_id", "token").distinct(), ["session_id", "token"], "left_semi").where("status = 'excluded'")
    forms = hit.select("session_id", F.col("original_form").alias("value"), F.col("entity_type").alias("type"))
    m = mappings.join(back.select("session_id", "token", F.lit(True).alias("b_")).distinct(), ["session_id", "token"], "left")
    m = m.withColumn("status", F.when(F.coalesce("b_", F.lit(False)) & (F.col("status") == "excluded"), "active").otherwise(F.col("status"))).select(mappings.columns)
    return m, not_excluded(exclusions, forms)


def replaced(mappings: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mappings, new finds, new exclusions) after values were edited (session_id, token, value, type).

    Where neither value nor type changes nothing happens. Else the old token is retired, its old value, if it changed, is
    excluded, and the new value is a find to be numbered by ``masking.number_tokens``.
    """
    e = edits.select("session_id", "token", F.col("value").alias("v_"), F.col("type").alias("t_"))
    j = mappings.join(e, ["session_id", "token"], "left")
    changed = F.col("v_").isNotNull() & ((F.col("v_") != F.col("original_form")) | (F.col("t_") != F.col("entity_type")))
    j = j.withColumn("c_", F.coalesce(changed, F.lit(False)))
    out = j.withColumn("status", F.when(F.col("c_"), "replaced").otherwise(F.col("status"))).select(mappings.columns)
    new = j.where("c_").select("session_id", F.col("v_").alias("value"), F.col("t_").alias("type")).distinct()
    old = j.where("c_ AND v_ <> original_form").select("session_id", F.col("original_form").alias("value"), F.col("entity_type").alias("type")).distinct()
    return out, new, old


def forms_by_token(mappings: DataFrame) -> DataFrame:
    """(session_id, token, entity_type, forms, status): a token's distinct forms in order, active if any of them is."""
    return mappings.groupBy("session_id", "token").agg(
        F.min_by("entity_type", "id").alias("entity_type"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("id", "original_form"))), lambda x: x["original_form"])).alias("forms"),
        F.when(F.bool_or(F.col("status") == "active"), "active").otherwise(F.min_by("status", "id")).alias("status"))


def token_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(token, n) over texts, in natural order of tokens."""
    t = texts.select(F.explode(T.tokens_in(text)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return t.orderBy(F.substring_index("token", "_", 1), entities.token_number("token"))


def reconciled(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(name, rows_before, rows_after, same): row counts of a store's tables before and after a migration."""
    counts = [before[k].agg(F.count("*").alias("rows_before")).withColumn("name", F.lit(k)).join(after[k].agg(F.count("*").alias("rows_after")).withColumn("name", F.lit(k)), "name") for k in sorted(before)]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.withColumn("same", F.col("rows_before") == F.col("rows_after"))


def session_overview(sessions: DataFrame, files: DataFrame, now, days: int) -> DataFrame:
    """Sessions with the numbers of their files, of both sections and of finished ones, and the days until they expire.

    sessions: session_id, created_at; files: session_id, section (anon or restore), status.
    """
    anon, back, done = F.col("section") == "anon", F.col("section") == "restore", F.col("status") == "done"
    n = files.groupBy("session_id").agg(F.count("*").alias("files"), F.count_if(anon).alias("files_anon"), F.count_if(back).alias("files_restore"), F.count_if(anon & done).alias("ready_anon"), F.count_if(back & done).alias("ready_restore"))
    left = days - (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("created_at")) / 86400
    out = sessions.join(n, "session_id", "left").na.fill(0, ["files", "files_anon", "files_restore", "ready_anon", "ready_restore"])
    return out.withColumn("expires_in_days", F.greatest(F.lit(0), (left + 0.999).cast("int")))


def first_uploads(files: DataFrame) -> DataFrame:
    """Uploads without exact repeats: of equal (session, section, name, size) the first added."""
    w = Window.partitionBy("session_id", "section", "name", "size").orderBy("added")
    return files.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def deduplicated_names(files: DataFrame) -> DataFrame:
    """``files`` with ``entry``: names inside an archive; a repeat gets (n) before its extension, in order of ``added``."""
    w = Window.partitionBy("session_id", "name").orderBy("added")
    stem, ext = F.regexp_extract("name", r"^(.*?)([.][^.]*)?$", 1), F.regexp_extract("name", r"([.][^.]*)$", 1)
    return files.withColumn("n_", F.row_number().over(w)).withColumn("entry", F.when(F.col("n_") == 1, F.col("name")).otherwise(F.concat(stem, F.lit(" ("), F.col("n_"), F.lit(")"), ext))).drop("n_")


def manifest_folded(events: DataFrame) -> DataFrame:
    """The file list after a log of edits (session_id, name, section, at, op, field, value): the last value of each field;
    a removal forgets what was before it. ``added`` is when the entry came, or came again."""
    key = ["session_id", "name", "section"]
    gone = events.where("op = 'remove'").groupBy(key).agg(F.max("at").alias("gone_"))
    live = events.where("op <> 'remove'").join(gone, key, "left").where(F.col("gone_").isNull() | (F.col("at") > F.col("gone_")))
    last = lambda f: F.max_by("value", F.when(F.col("field") == f, F.col("at")))
    return live.groupBy(key).agg(F.min("at").alias("added"), F.coalesce(last("status"), F.lit("new")).alias("status"), *[last(f).alias(f) for f in ("output", "extra", "error")])


def unreferenced(outputs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Output files (session_id, file) that no entry of the manifest names as its output or extra."""
    named = manifest.select("session_id", F.explode(F.array("output", "extra")).alias("file")).where("file IS NOT NULL").distinct()
    return outputs.join(named, ["session_id", "file"], "left_anti")


def same_entity(values: DataFrame, mappings: DataFrame) -> DataFrame:
    """(session_id, value, type, token): the token of the known entity that each value is another form of, null if none.

    Numbers, companies and addresses by merge key, the lowest token of equals; persons by surname: the only compatible
    token, or of several the most specific, if the value itself names two of surname, name and patronymic.
    mappings: session_id, token, original_form, entity_type, status.
    """
    live = mappings.where("status = 'active'")
    person = F.col("type").isin(*P.PERSON_TYPES)
    num = entities.token_number("token")
    keys = live.where(~F.col("entity_type").isin(*P.PERSON_TYPES)).select("session_id", F.col("entity_type").alias("type"), T.merge_key("original_form", "entity_type").alias("k"), "token")
    keys = keys.where((F.col("k") != "") & (~F.col("type").isin(*P.ORG_TYPES) | (F.length("k") >= 4))).groupBy("session_id", "type", "k").agg(F.min_by("token", F.struct(num, "token")).alias("token"))
    plain = values.where(~person).withColumn("k", T.merge_key("value", "type")).join(keys, ["session_id", "type", "k"], "left").select("session_id", "value", "type", "token")
    who = live.where(F.col("entity_type").isin(*P.PERSON_TYPES)).select("session_id", "token", entities.person("original_form").alias("o")).withColumn("n", F.coalesce("o.surname", F.lit("")))
    mine = values.where(person).withColumn("me", F.when(F.col("value").rlike("[0-9]"), None).otherwise(entities.person("value"))).withColumn("n", F.coalesce("me.surname", F.lit("")))
    fits = mine.join(who, ["session_id", "n"]).where(entities.compatible(F.col("me"), F.col("o"))).groupBy("session_id", "value", "type", "token").agg(F.max(entities.specificity(F.col("o"))).alias("s"), F.max(entities.specificity(F.col("me"))).alias("mine"))
    best = fits.groupBy("session_id", "value", "type").agg(F.count("*").alias("c"), F.max("mine").alias("mine"), F.max_by("token", F.struct("s", -num)).alias("token"))
    best = best.where("c = 1 OR mine >= 2").select("session_id", "value", "type", "token")
    return plain.unionByName(values.where(person).join(best, ["session_id", "value", "type"], "left").select("session_id", "value", "type", "token"))


def taken(values: DataFrame, mappings: DataFrame) -> DataFrame:
    """(session_id, value, type, token, apart_from): tokens of values (session_id, value, type, separate, seen) that a user
    adds to a session's mappings (session_id, id, token, original_form, entity_type, status).

    A value that has a row keeps its token; another form of a known entity takes the entity's token, unless it is to be
    separate: then it gets a number of its own, and ``apart_from`` is the token it must not be grouped with again.
    """
    rows = mappings.groupBy("session_id", F.col("original_form").alias("value"), F.col("entity_type").alias("type")).agg(F.min_by("token", "id").alias("own"))
    like = same_entity(values.select("session_id", "value", "type"), mappings).groupBy("session_id", "value", "type").agg(F.min("token").alias("like"))
    each = values.join(rows, ["session_id", "value", "type"], "left").join(like, ["session_id", "value", "type"], "left")
    fresh = each.where("own IS NULL AND (like IS NULL OR separate)")
    new = masking.number_tokens(fresh.select("session_id", "value", "type", "seen"), mappings).select("session_id", "value", "type", F.col("token").alias("new"))
    each = each.join(new, ["session_id", "value", "type"], "left")
    return each.select("session_id", "value", "type", F.coalesce("own", "new", "like").alias("token"), F.when(F.col("new").isNotNull(), F.col("like")).alias("apart_from"))


def audit(mappings: DataFrame) -> DataFrame:
    """(entity_type, automatic, proposed): how many tokens of a kind are grouped by rule, and pairs left to a person."""
    kinds = mappings.groupBy("session_id", "token").agg(F.min("entity_type").alias("entity_type"))
    grouped = entities.auto_groups(mappings).where("token <> kept").join(kinds, ["session_id", "token"]).groupBy("entity_type").agg(F.count("*").alias("automatic"))
    pairs = entities.review_pairs(mappings).select("session_id", F.col("a").alias("token")).join(kinds, ["session_id", "token"]).groupBy("entity_type").agg(F.count("*").alias("proposed"))
    return grouped.join(pairs, "entity_type", "full").na.fill(0, ["automatic", "proposed"])


def marks_in_order(marks: DataFrame, key: str) -> DataFrame:
    """Restored marks (key, mark, value, pos), each once: the doubtful first, then by first place."""
    severity = F.when(F.col("mark") == "unknown", 0).when(F.col("mark") == "case", 1).otherwise(2)
    each = marks.groupBy(key, "mark", "value").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return each.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(severity, "first", "value")))


def stage_progress(beats: DataFrame, now, stale: int = 120) -> DataFrame:
    """(job_id, stage, stages, seconds, state): where each job stands, from its beats (job_id, stage, ts, done).

    A job whose last beat says done is done; one without a beat for ``stale`` seconds is interrupted; others run.
    """
    last = F.max_by(F.struct("stage", "done"), F.struct("ts", "stage"))
    each = beats.groupBy("job_id").agg(last.alias("l"), F.count_distinct("stage").alias("stages"), F.min("ts").alias("began"), F.max("ts").alias("beat"))
    seconds = lambda a, b: F.unix_seconds(F.to_timestamp(b)) - F.unix_seconds(F.to_timestamp(a))
    state = F.when(F.col("l.done"), "done").when(seconds(F.col("beat"), now) > stale, "interrupted").otherwise("running")
    return each.select("job_id", "l.stage", "stages", seconds(F.col("began"), F.col("beat")).alias("seconds"), state.alias("state"))

"""Which tokens are one entity, and which pairs a person should look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .detect import prefix_of
from .graph import components, materialize, spread


def _is_name(c: Column) -> Column:
    return c.isin(*P.FIRST_NAMES)


def person(c) -> Column:
    """struct(surname, name, patr): the surname's key, the first name's base form or an initial, the patronymic's stem."""
    t = F.col(c) if isinstance(c, str) else c
    initials = F.regexp_extract_all(t, F.lit("(?<![А-ЯЁа-яё])([А-ЯЁ])[.]"), 1)
    words = F.regexp_extract_all(T.folded(F.regexp_replace(t, "(?<![А-ЯЁа-яё])[А-ЯЁA-Z][.]", " ")), F.lit("[а-яa-z]+(?:-[а-яa-z]+)?"), 0)
    patr = F.filter(words, lambda w: w.rlike("^[а-я]{3,}" + P.PATRONYMIC.replace("ё", "") + "$"))
    # every case ending a first name can have, taken off
    base = lambda w: F.filter(
        F.array(w, *[F.concat(F.substring(w, F.lit(1), F.length(w) - k), F.lit(e)) for k in (1, 2) for e in ("", "а", "я", "й", "ь")]),
        lambda f: _is_name(f))
    names = F.filter(words, lambda w: (F.size(base(w)) > 0) & ~w.rlike(P.SURNAME_END) | _is_name(w))
    rest = F.filter(words, lambda w: ~F.array_contains(names, w) & ~F.array_contains(patr, w))
    name = F.coalesce(F.get(base(F.get(names, F.lit(0))), F.lit(0)), F.lower(F.get(initials, F.lit(0))))
    p = F.coalesce(F.regexp_replace(F.get(patr, F.lit(0)), "(?<=вич|ьич|нич|ич)(?:а|у|ем|е)$|(?<=вн|чн)(?:а|ы|е|у|ой|ою)$", ""), F.lower(F.get(initials, F.lit(1))))
    return F.struct(T.surname_key(F.get(rest, F.lit(0))).alias("surname"), name.alias("name"), p.alias("patr"))


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(F.when((F.length(a) == 1) | (F.length(b) == 1), F.left(a, F.lit(1)) == F.left(b, F.lit(1))).otherwise(a == b), F.lit(True))


def compatible(a: Column, b: Column) -> Column:
    """Two persons can be one: equal surnames and no contradiction, or, neither with a surname, equal full names."""
    both = a["surname"].isNotNull() & b["surname"].isNotNull()
    neither = a["surname"].isNull() & b["surname"].isNull()
    full = F.coalesce((a["name"] == b["name"]) & a["patr"].isNotNull() & _same(a["patr"], b["patr"]), F.lit(False))
    return F.when(both, (a["surname"] == b["surname"]) & _same(a["name"], b["name"]) & _same(a["patr"], b["patr"])).otherwise(neither & full)


def specificity(a: Column) -> Column:
    return sum((a[f].isNotNull().cast("int") for f in ("surname", "name", "patr")), F.lit(0))


def same_form(a, b) -> Column:
    """Two forms name the same person with as many words: an answer that only changes the case."""
    words = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"[А-ЯЁа-яёA-Za-z][А-ЯЁа-яёA-Za-z\-]*"), 0))
    return (words(a) == words(b)) & compatible(person(a), person(b))


def token_number(c) -> Column:
    return F.coalesce(F.regexp_extract(F.col(c), "_([0-9]+)", 1).try_cast("bigint"), F.lit(0))


def auto_groups(mappings: DataFrame, distinct: DataFrame | None = None) -> DataFrame:
    """(session_id, token, kept): tokens that are one entity by their keys, with the lowest of the group.

    mappings: session_id, token, original_form, entity_type, status. Numbers, companies and addresses meet on merge keys
    (companies under four characters don't); persons on the surname's key, where a group merges only if every two of its
    members are compatible. A group that holds a pair declared distinct stays apart. Keys are joined as stars to their
    least member, so a common key never makes pairs.
    """
    rows = mappings.where("status = 'active'").select("session_id", "token", "entity_type", "original_form").distinct()
    rows = rows.withColumn("node", F.concat_ws("\u0001", F.col("session_id").cast("string"), prefix_of(F.col("entity_type")), F.lpad(token_number("token").cast("string"), 12, "0"), "token"))
    key = F.concat_ws("\u0001", F.col("session_id").cast("string"), prefix_of(F.col("entity_type")), T.merge_key("original_form", "entity_type"))
    keyed = rows.where(~F.col("entity_type").isin(*P.PERSON_TYPES)).select("node", "entity_type", key.alias("key"), T.merge_key("original_form", "entity_type").alias("k"))
    keyed = keyed.where((F.col("k") != "") & (~F.col("entity_type").isin(*P.ORG_TYPES) | (F.length("k") >= 4))).select("node", "key")
    low = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    stars = keyed.join(low, "key").where("node > low").select("node", "low")
    people = rows.where(F.col("entity_type").isin(*P.PERSON_TYPES)).withColumn("p", person("original_form")).where("p.surname is not null")
    people = people.select("node", "session_id", F.col("p.surname").alias("surname"), "p")
    forms = people.groupBy("session_id", "surname", "node").agg(F.collect_set("p").alias("ps"))
    a, b = forms.alias("a"), forms.alias("b")
    fits = F.forall(F.col("a.ps"), lambda x: F.forall(F.col("b.ps"), lambda y: compatible(x, y)))
    pairs = a.join(b, ["session_id", "surname"]).where(F.col("a.node") < F.col("b.node")).where(fits).select(F.col("a.node").alias("x"), F.col("b.node").alias("y"))
    pairs = materialize(pairs, "person-pairs")
    group = components(pairs, "x", "y", "string")
    size = group.groupBy("comp").agg(F.count("*").alias("n"))
    have = pairs.join(group, pairs.x == group.node).groupBy("comp").agg(F.count("*").alias("e"))
    whole = size.join(have, "comp").where(F.col("e") * 2 == F.col("n") * (F.col("n") - 1)).select("comp")
    cliques = group.join(whole, "comp", "left_semi").where("node > comp").select("node", F.col("comp").alias("low"))
    comp = components(stars.unionByName(cliques), "node", "low", "string")
    token = lambda c: F.substring_index(c, "\u0001", -1)
    out = comp.select(F.substring_index("node", "\u0001", 1).alias("session_id"), token("node").alias("token"), token("comp").alias("kept"))
    if distinct is not None:
        g = out.select("session_id", "token", "kept")
        bad = distinct.join(g.withColumnsRenamed({"token": "a", "kept": "ka"}), ["session_id", "a"]).join(g.withColumnsRenamed({"token": "b", "kept": "kb"}), ["session_id", "b"]).where("ka = kb").select("session_id", F.col("ka").alias("kept")).distinct()
        out = out.join(bad, ["session_id", "kept"], "left_anti").select("session_id", "token", "kept")
    return out


def review_pairs(mappings: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """(session_id, a, b, type): pairs for a person to judge: companies and addresses one typo in eight characters
    apart, one address inside another but for rooms, and persons with a surname but no agreement.

    Typos are found among distinct keys only (``close_keys``); tokens come to what is left in blocks of those with one key
    and, of addresses, one set of numbers, so a name that many tokens share is compared once and its pairs are dealt over
    all tasks. Persons meet on distinct (surname, person) keys. A token has one form and one key, so no pair comes twice.
    """
    w = Window.partitionBy("session_id", "token").orderBy("original_form")
    first = mappings.where("status = 'active'").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    items = first.select("session_id", "token", "entity_type", "original_form", T.merge_key("original_form", "entity_type").alias("k"), prefix_of(F.col("entity_type")).alias("pre"))
    items = materialize(items, "review-items")
    orgs = items.where(F.col("entity_type").isin(*P.ORG_TYPES + P.ADDRESS_TYPES) & (F.length("k") >= 4))
    parts = T.address_parts("original_form")
    alike = F.when(F.col("entity_type").isin(*P.ADDRESS_TYPES), F.to_json(F.struct(F.size(parts).alias("n"), F.filter(parts, lambda x: x.rlike("[0-9]")).alias("numbers")))).otherwise(F.lit(""))
    named = orgs.select("session_id", "pre", "token", "entity_type", F.regexp_replace("k", "[ ,]", "").alias("s"), alike.alias("alike"))
    keys = named.groupBy("session_id", "pre", "s").agg(F.count("*").alias("c"))
    keys = materialize(keys.withColumn("id", F.monotonically_increasing_id()), "review-keys")
    close = materialize(close_keys(keys), "review-close")
    # rows to come, for as many tasks; a block holds some 256 tokens
    tasks = max(close.sparkSession.sparkContext.defaultParallelism, (close.agg(F.sum("rows")).first()[0] or 0) // 2_000_000)
    block = F.pmod(F.xxhash64("token"), F.ceil(F.col("c") / 256))
    blocks = named.join(keys, ["session_id", "pre", "s"]).groupBy("session_id", "pre", "id", "entity_type", "alike", block.alias("block")).agg(F.collect_list("token").alias("tokens"))
    blocks, few = materialize(blocks, "review-blocks"), named.limit(200_001).count() <= 200_000
    side = lambda x: (F.broadcast(blocks) if few else blocks).select(*[F.col(c).alias(f"{c}_{x}") for c in ("session_id", "pre", "id", "entity_type", "alike", "tokens")])
    dealt = (close.repartition(tasks) if few else close).join(side("a"), "id_a").join(side("b"), "id_b").where("session_id_a = session_id_b AND pre_a = pre_b AND alike_a = alike_b")
    typo = (dealt if few else dealt.repartition(tasks)).withColumn("a", F.explode("tokens_a")).withColumn("b", F.explode("tokens_b"))
    typo = typo.select(F.col("session_id_a").alias("session_id"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("entity_type_a").alias("type"))
    addr = items.where(F.col("entity_type").isin(*P.ADDRESS_TYPES)).select("session_id", "token", "entity_type", T.address_parts("original_form").alias("parts"))
    cut = addr.select("session_id", F.col("token").alias("b"), F.col("parts").alias("pb"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("parts") - 1, F.lit(1))), lambda i: F.slice("parts", 1, i))).alias("parts"))
    rooms = F.forall(F.expr("slice(pb, size(parts) + 1, size(pb))"), lambda p: F.exists(F.split(p, " "), lambda x: x.isin(*P.ADDRESS_ROOMS)))
    inside = addr.withColumnRenamed("token", "a").join(cut, ["session_id", "parts"]).where((F.size("pb") > F.size("parts")) & rooms & F.exists("parts", lambda p: p.rlike("(?:^| )д(?: |$)")))
    inside = inside.select("session_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("entity_type").alias("type"))
    who = items.where(F.col("entity_type").isin(*P.PERSON_TYPES)).withColumn("p", person("original_form")).withColumn("surname", F.col("p.surname")).where("surname is not null")
    kinds = who.select("session_id", "surname", "p").distinct()
    x, y = kinds.alias("x"), kinds.alias("y")
    short = (F.length("x.p.name") == 1) | (F.length("y.p.name") == 1)
    pairs = x.join(y, ["session_id", "surname"]).where(compatible(F.col("x.p"), F.col("y.p")) | F.coalesce(short, F.lit(False))).select("session_id", F.col("x.p").alias("px"), F.col("y.p").alias("py"))
    keyed = lambda c, t: who.select(F.col("session_id").alias(f"s{t}"), F.col("p").alias(f"k{t}"), F.col("token").alias(t), F.col("entity_type").alias(f"e{t}"))
    same = lambda a, b: F.to_json(F.col(a)) == F.to_json(F.col(b))
    namesakes = pairs.join(keyed("x", "a"), (F.col("session_id") == F.col("sa")) & same("px", "ka")).join(keyed("y", "b"), (F.col("session_id") == F.col("sb")) & same("py", "kb")).where("a < b")
    namesakes = namesakes.select("session_id", "a", "b", F.col("ea").alias("type"))
    out = typo.unionByName(inside).unionByName(namesakes)
    if rejected is not None:
        out = out.join(rejected.select("session_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["session_id", "a", "b"], "left_anti")
    return out


#: Keys up to so many characters have two edits at most.
BY_RESTS = 23


def close_keys(keys: DataFrame) -> DataFrame:
    """(id_a, id_b, rows): keys of one session and prefix within one edit in eight characters of the shorter (a), each
    pair once, and how many pairs of tokens they stand for. A pair of other sessions is among them if 64-bit hashes meet.

    keys: session_id, pre, s, c (tokens), id. Shorter keys up to 23 characters have two edits at most, and meet on what
    is left of them: two that differ by two characters in place, without these (``blanks``); other ones when the shorter
    loses one character at most and the longer one or two (``rests``). Nearly all that meet are within the edits, so what
    keys have in common, as a word or leading zeros, makes no candidates. Longer keys have too many rests: of two strings
    within d edits the shorter is cut into d + 1 pieces, of which one stands unchanged in the longer at nearly the same
    place (``pieces``, ``probes``), and levenshtein(a, b, d) decides.
    """
    dealt = spread(keys)

    def left(most: int) -> DataFrame:
        short = F.transform(rests(F.col("s"), most), lambda w: F.struct(w.alias("rest"), F.lit("").alias("lost"), (F.length("s") - F.length(w)).alias("gone")))
        met = dealt.where(F.length("s") <= (BY_RESTS if most == 1 else BY_RESTS + 2)).select("session_id", "pre", "id", "s", "c", F.explode(F.concat(short, blanks(F.col("s")))).alias("x"))
        return met.select(F.xxhash64("session_id", "pre", "x.rest").alias("key"), "id", "s", "c", "x.*")

    edits = "cast(greatest(1, floor(length(a.s) / 8)) AS int)"
    order = "(length(a.s) < length(b.s) OR length(a.s) = length(b.s) AND a.s < b.s)"
    # two that differ by one character meet without it, so of two characters in place both must differ
    near = f"""CASE WHEN a.lost <> '' THEN left(a.lost, 1) <> left(b.lost, 1) AND right(a.lost, 1) <> right(b.lost, 1) WHEN b.gone > {edits} THEN false
     WHEN a.gone + b.gone <= {edits} THEN true ELSE levenshtein(a.s, b.s, {edits}) >= 0 END"""
    met = left(1).alias("a").join(left(2).hint("merge").alias("b"), F.col("a.key") == F.col("b.key")).where(f"a.rest = b.rest AND {order} AND {near}")
    long_ = dealt.where(F.length("s") > BY_RESTS)
    cut = long_.select("*", F.explode(pieces(F.col("s"))).alias("x")).select("session_id", "pre", "id", "s", "c", "x.*")
    probe = long_.select("*", F.explode(probes(F.col("s"))).alias("x")).select("session_id", "pre", "id", "s", "c", "x.*")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("session_id", "pre", "n", "i", "piece")]
    held = cut.alias("a").join(probe.hint("merge").alias("b"), same).where("a.n < length(b.s) OR a.s < b.s").where(f"levenshtein(a.s, b.s, {edits}) >= 0")
    pair = [F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), (F.col("a.c") * F.col("b.c")).alias("rows")]
    return met.select(pair).unionByName(held.select(pair)).distinct()


def rests(s: Column, most: int) -> Column:
    """A string, and what is left of it without any one character, or up to two if it may have two edits and ``most`` is 2."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))))
    one = F.array_distinct(less(s))
    two = F.when(_edits(F.length(s)) > 1, F.flatten(F.transform(one, less))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(s), one, two) if most > 1 else F.concat(F.array(s), one))


def blanks(s: Column) -> Column:
    """(rest, lost, gone): a string that has two edits with any two characters blanked, and these; none of other strings."""
    n, blank = F.length(s), F.lit("\u0001")
    at = lambda i, j: F.struct(
        F.concat(s.substr(F.lit(1), i - 1), blank, s.substr(i + 1, j - i - 1), blank, s.substr(j + 1, n)).alias("rest"), F.concat(s.substr(i, F.lit(1)), s.substr(j, F.lit(1))).alias("lost"), F.lit(0).alias("gone"))
    every = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.transform(F.sequence(i + 1, F.greatest(n, i + 1)), lambda j: at(i, j))))
    return F.when((_edits(n) == 2) & (n <= BY_RESTS), every).otherwise(F.slice(every, 1, 0))


def _edits(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n / 8)).cast("int")


def _piece(n: Column, i: Column) -> tuple[Column, Column]:
    """Where the i-th of edits + 1 even pieces of n characters begins, and how wide it is; the last ones are the wider."""
    d = _edits(n)
    base, more = F.floor(n / (d + 1)).cast("int"), F.pmod(n, d + 1).cast("int")
    wide = F.greatest(F.lit(0), i - 1 - (d + 1 - more))
    return 1 + (i - 1) * base + wide, base + (i > d + 1 - more).cast("int")


def pieces(s: Column) -> Column:
    """(n, i, piece): a string's length and its edits + 1 pieces in order."""
    n = F.length(s)
    return F.transform(F.sequence(F.lit(1), _edits(n) + 1), lambda i: F.struct(n.alias("n"), i.alias("i"), s.substr(*_piece(n, i)).alias("piece")))


def probes(s: Column) -> Column:
    """(n, i, piece): for each length n that a shorter string within its edits can have, where its i-th piece could stand
    in this one: i - 1 places off at most, counted from the left, and edits + 1 - i from the right."""
    m = F.length(s)

    def at(n: Column, i: Column) -> Column:
        begin, wide = _piece(n, i)
        d, gap = _edits(n), m - n
        lo = F.greatest(F.lit(1), begin - (i - 1), begin + gap - (d + 1 - i))
        hi = F.least(m - wide + 1, begin + (i - 1), begin + gap + (d + 1 - i))
        places = F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda p: F.struct(n.alias("n"), i.alias("i"), s.substr(p, wide).alias("piece")))

    lengths = F.filter(F.sequence(F.greatest(F.lit(1), m - _edits(m)), m), lambda n: m - n <= _edits(n))
    return F.array_distinct(F.flatten(F.transform(lengths, lambda n: F.flatten(F.transform(F.sequence(F.lit(1), _edits(n) + 1), lambda i: at(n, i))))))

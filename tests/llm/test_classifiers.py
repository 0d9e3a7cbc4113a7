import random
import re
import zlib

import numpy as np
import pyarrow as pa

from veilspark.llm import common, langid, quality, textops, toxicity


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_quality_held_out(spark, sf):
    got = quality.op1_quality_knn(spark, sf).toPandas()
    truth = common.table(spark, sf, "labels").toPandas()
    docs = common.table(spark, sf, "documents").count()
    assert len(got) == docs and got.score.between(0, 1).all()
    assert ((got.score >= 0.7).astype(int) == got.predicted).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out))
    both = got.merge(truth, on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() >= 0.9


def test_quality_odd_rows(spark, odd, labels, none):
    model = quality.fit(odd, labels, bound=10)
    got = quality.score(odd.select("doc_id", "text"), model, "s").collect()
    assert len(got) == 11 and all(0 <= r["s"] <= 1 for r in got)
    empty = {r["s"] for r in got if r["doc_id"] in (2, 3, 4)}
    assert len(empty) == 1
    assert len({r["s"] for r in got if r["doc_id"] == 1}) == 1
    assert quality.score(none, model, "s").count() == 0
    bare = quality.fit(none, labels)
    assert {r["s"] for r in quality.score(odd, bare, "s").collect()} == {0.5}


def test_quality_keeps_clashing_columns(spark, odd, labels):
    out = quality.score(odd, quality.fit(odd, labels, bound=10), common.fresh(odd, "score"))
    assert out.columns == [*odd.columns, "score_"]


def test_toxicity_pairs_beat_terms():
    """An interaction that no sum of single weights can hold."""
    import numpy as np

    docs, y = [], []
    rng = np.random.default_rng(0)
    for i in range(400):
        a, b = i % 2, i // 2 % 2
        docs.append(np.unique(np.array([1] * a + [2] * b + [3] + list(rng.integers(10, 14, 2)))))
        y.append(float(a and b))
    m = toxicity.train(docs, np.array(y), 8, 4, 30, 3, 1.0, 0.1, 1e-5, 1)
    s = m.scores(3, np.array([0, 0, 1, 2]), np.array([1, 2, 1, 2]))
    assert s[0] > 0.5 and s[1] < 0.5 and s[2] < 0.5
    assert np.abs(m.v[:, [1, 2]]).max() > 0.1


def test_toxicity_finds_words(spark):
    docs = [(i, ("you moron go away " if i % 3 == 0 else "kind words for all ") + f"filler{i % 5} text here") for i in range(120)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, lab)
    fresh = spark.createDataFrame([(1, "a moron spoke"), (2, "kind people spoke"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in toxicity.score(fresh, model, "s").collect()}
    assert got[1] >= 0.5 > got[2] and got[3] == got[4] < 0.5


def test_toxicity_finds_combinations_of_harmless_words(spark):
    """Groups and mild insults as frequent in clean texts as in toxic ones; only matching ones are toxic together."""
    import random

    rng, texts = random.Random(4), []
    for i in range(600):
        toxic, k = i % 3 == 0, rng.randrange(2)
        words = [f"w{rng.randrange(2000)}" for _ in range(rng.randint(5, 40))]
        words.insert(rng.randrange(len(words)), ("group", "people")[k])
        words.insert(rng.randrange(len(words)), ("pests", "fools")[k if toxic else 1 - k])
        texts.append((i, " ".join(words), int(toxic)))
    d = spark.createDataFrame([r[:2] for r in texts], "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, y) for i, _, y in texts], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: (r["s"], r["h"]) for r in toxicity.score(d, toxicity.fit(d, lab), "s").withColumn("h", common.held_out(toxicity.MOD, toxicity.REM)).collect()}
    held = [(got[i][0] >= 0.5, y == 1) for i, _, y in texts if got[i][1]]
    assert len(held) > 80 and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_toxicity_odd_rows(spark, odd, labels, none):
    model = toxicity.fit(odd, labels, bound=10)
    got = toxicity.score(odd, model, "s").collect()
    assert len(got) == 11 and all(0 <= r["s"] <= 1 for r in got)
    assert toxicity.score(none, model, "s").count() == 0
    share = labels.where("toxic is not null and doc_id is not null").where(~common.held_out(toxicity.MOD, toxicity.REM)).toPandas().toxic.mean()
    assert all(abs(r["s"] - share) < 1e-9 for r in toxicity.score(odd, toxicity.fit(none, labels), "s").collect())
    assert all(r["s"] == 0 for r in toxicity.score(odd, toxicity.fit(odd, labels.limit(0)), "s").collect())
    assert all(abs(r["s"] - share) < 1e-9 for r in got if r["doc_id"] in (2, 3, 4))


def test_toxicity_query_against_the_formula(spark, sf):
    """The query's scores are the formula's, pair by pair."""
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    m = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.op9_toxicity_fm(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in sorted(rows, key=lambda r: len(r["text"] or ""))[:120]:
        slab = next(textops.slabs(pa.array([r["text"] or ""])), None)
        t = [int(t) for t in toxicity.terms(slab, 17)[1] if m.x[t] > 0] if slab else []
        z = float(m.w0) + sum(float(m.w[i]) * float(m.x[i]) for i in t)
        z += sum(float(np.dot(m.v[:, i].astype(float), m.v[:, j].astype(float))) * float(m.x[i]) * float(m.x[j]) for a, i in enumerate(t) for j in t[:a])
        want = 1 / (1 + np.exp(-z)) if t else m.share
        assert abs(got[r["doc_id"]] - want) < 1e-3, r["doc_id"]


def test_toxicity_xor_of_frequent_words(spark):
    """Neither word tells anything alone: toxic is exactly one of the two; default options."""
    rng, texts = random.Random(9), []
    for i in range(2000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randrange(500)}" for _ in range(8)] + ["alpha"] * a + ["bravo"] * b
        rng.shuffle(words)
        texts.append((i, " ".join(words), int(a != b)))
    d = spark.createDataFrame([r[:2] for r in texts], "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, y) for i, _, y in texts], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: (r["s"], r["h"]) for r in toxicity.score(d, toxicity.fit(d, lab), "s").withColumn("h", common.held_out(toxicity.MOD, toxicity.REM)).collect()}
    held = [(got[i][0] >= 0.5) == (y == 1) for i, _, y in texts if got[i][1]]
    assert len(held) > 300 and sum(held) >= 0.95 * len(held)


def test_quality_query_against_brute_force(spark, sf):
    """Every score is the vote of the k nearest of all sample vectors, found by sorting."""
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    m = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.op1_quality_knn(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        slab = next(textops.slabs(pa.array([r["text"] or ""])), None)
        z = (quality.damped(quality.counts(slab, 2048)) @ m.proj)[0].astype(float) if slab else np.zeros(1)
        if np.linalg.norm(z) < 1e-9:
            assert abs(got[r["doc_id"]] - m.prior) < 1e-9
            continue
        cos = m.refs.astype(float) @ (z / np.linalg.norm(z))
        near = sorted(range(len(cos)), key=lambda i: (-cos[i], i))[: m.k]
        w = [np.exp(m.sharp * (cos[i] - 1)) for i in near]
        want = sum(a * m.y[i] for a, i in zip(w, near)) / sum(w)
        edge = sorted(cos)[-m.k - 1 : -m.k + 1]
        assert abs(got[r["doc_id"]] - want) < 1e-4 or edge[1] - edge[0] < 1e-5, r["doc_id"]


def test_samples_keep_their_bound(spark):
    """An id that stands in many rows is one document of the sample, with its least text and larger label."""
    d = spark.createDataFrame([(1, f"word{i % 7} text") for i in range(3000)] + [(i, "Some other words.") for i in range(2, 40)], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 0, 0), (1, 1, 1)] + [(i, i % 2, i % 2) for i in range(2, 40)], "doc_id long, quality int, toxic int")
    got = common.labelled(d, lab, "quality", 4, 2, 3).collect()
    assert sorted(r["y"] for r in got) == [0, 0, 0, 1, 1, 1] and len({r["doc_id"] for r in got}) == 6
    assert all(r["text"] == "word0 text" and r["y"] == 1 for r in got if r["doc_id"] == 1)
    assert len(quality.fit(d, lab, bound=3).y) <= 6


def brute_phrases(sample, text):
    """Phrases of the cleaned text: longest substrings of the sample, ended at block ends."""
    t = re.sub(rb"[ \t\n\v\f\r]+", b" ", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    t = t and (b"" if t[:1] == b" " else b" ") + t + (b"" if t[-1:] == b" " else b" ")
    n = 0
    for lo in range(0, len(t), langid.BLOCK):
        w, at = t[lo : lo + langid.BLOCK], 0
        while at < len(w):
            size = 1
            while at + size < len(w) and w[at : at + size + 1] in sample:
                size += 1
            n, at = n + 1, at + size
    return n


def brute_language(sample, text):
    cost = {k: brute_phrases(v, text) * (8 + np.log2(len(v) + 1)) for k, v in sample.items()}
    a, b = sorted((c, k) for k, c in cost.items())[:2]
    return a[1], b[0] / max(a[0] + b[0], 1)


def test_cross_parse_against_substring_search():
    rng = random.Random(1)
    sample = {k: bytes(rng.choice(a) for _ in range(300)) for k, a in (("a", b"abc "), ("b", b"bcd "), ("c", b"xyzab "))}
    parser = langid.Parser(sample)
    texts = ["", None, "A  b", " ", "abc", "qqq", "  a\n\nb ", "é"] + ["".join(rng.choice("abcdxyz Q ") for _ in range(rng.randint(0, 3000))) for _ in range(40)]
    for limit in (1 << 20, 4000):
        got = np.concatenate([parser.counts(s) for s in textops.slabs(pa.array(texts), limit)])
        assert got.tolist() == [[brute_phrases(sample[k], t) for k in "abc"] for t in texts]


def test_language_query_against_brute_force(spark, sf):
    docs = common.table(spark, sf, "documents")
    rows = docs.collect()
    for options, few in (({"chars": 2500}, rows), ({}, [r for r in rows if r["text"] and len(r["text"]) < 300][:40])):
        sample = langid.fit(docs, **options)
        got = langid.predict(docs, sample, "p", "s") if options else langid.op7_language_crossparse(spark, sf).withColumnsRenamed({"lang_pred": "p", "score": "s"})
        got = {r["doc_id"]: (r["p"], r["s"]) for r in got.collect()}
        for r in few:
            if any(c.isalpha() for c in r["text"] or ""):
                want = brute_language(sample, r["text"])
                assert got[r["doc_id"]][0] == want[0] and abs(got[r["doc_id"]][1] - want[1]) < 1e-9
            else:
                assert got[r["doc_id"]] == ("und", 0.0)


def test_language_sample_keeps_to_the_contract(spark):
    """Held-out rows, null texts and null languages teach nothing, whatever shares their id; an id teaches once."""
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    free = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, "zzheldout " * 5, "en") for i in held[:50]] + [(i, f"english words here {i}", "en") for i in free[:40]] + [(free[0], None, "en"), (free[1], "zznolang text", None), (None, "zznoid", "en")]
    rows += [(free[50], "mots en francais", "fr")] * 500 + [(free[51], "autre texte", "fr"), (free[51], None, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.fit(df)
    assert set(sample) == {"en", "fr"} and b"zz" not in b"".join(sample.values())
    assert sample["fr"].count(b"mots") == 1 and sample["en"].count(b"english") == 40
    assert langid.predict(df, sample).count() == len(rows)


def test_every_language_is_learned(spark):
    """65 languages, one of them rare: all are learned, none is cut because of another, and the broadcast is bounded."""
    words = {f"l{k:02d}": [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{w}" for w in ("ora", "ben", "ti", "sul", "wek", "po")] for k in range(65)}
    rng, rows = random.Random(3), []
    for k, (lang, w) in enumerate(words.items()):
        for i in range(2 if k == 64 else 24):
            rows.append((len(rows), " ".join(rng.choice(w) for _ in range(30)), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few, many = langid.fit(df.where("lang <> 'l64'"), chars=3000), langid.fit(df, chars=3000)
    assert len(many) == 65 and all(few[x] == many[x] for x in few)
    got = langid.predict(df, many, "p", "s").collect()
    assert sum(r["p"] == r["lang"] for r in got) >= 0.97 * len(got)
    assert sum(map(len, langid.fit(df, total=6500).values())) <= 6500


def test_language_held_out(spark, sf):
    got = langid.op7_language_crossparse(spark, sf).toPandas().merge(common.table(spark, sf, "documents").toPandas()[["doc_id", "lang"]], on="doc_id")
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang_pred == held.lang).mean() >= 0.95 and got.score.between(0, 1).all()


def test_language_odd_rows(spark, odd, none):
    got = {r["doc_id"]: r for r in langid.predict(odd, {"en": b" the word is here alpha ", "fr": b" le mot est ici "}, "p", "s").collect()}
    assert got[2]["p"] == got[3]["p"] == got[4]["p"] == "und" and got[2]["s"] == 0
    assert got[5]["p"] == got[6]["p"] == "en"
    assert langid.fit(none) == {} and {r["p"] for r in langid.predict(odd, {}, "p", "s").collect()} == {"und"}
    assert set(langid.fit(odd)) <= {"en", "fr", "de"} and langid.predict(none, {"en": b" a "}).count() == 0

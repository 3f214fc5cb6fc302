"""Language identification: held-out accuracy and edge cases."""

from __future__ import annotations

import random
import zlib

from tessera.llm import langid, queries


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op7_language_id(spark, folder).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) < 0.01 * len(rows)


def test_languages_that_were_not_learned(spark):
    texts = [
        "La pioggia cadeva lenta sulla città mentre le persone correvano verso casa con gli ombrelli aperti. Nessuno sapeva perché il vecchio orologio della piazza si fosse fermato quella mattina.",
        "Sade putosi hitaasti kaupungin ylle, kun ihmiset juoksivat koteihinsa sateenvarjot auki. Kukaan ei tiennyt, miksi torin vanha kello oli pysähtynyt sinä aamuna.",
        "Дождь медленно падал на город, пока люди бежали домой с открытыми зонтами. Никто не знал, почему старые часы на площади остановились тем утром.",
    ]
    rng = random.Random(1)
    texts = [" ".join(rng.choice(t.split()) for _ in range(800)) for t in texts]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = langid.learn(docs.where(~langid.held_out()))
    assert known.min_margin > 0 and known.coverage >= 0.97 and known.precision >= 0.99 and known.caught >= 0.85, known.min_margin
    foreign = langid.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), known)
    assert all(r.rejected for r in foreign.collect())
    clean = docs.where(langid.held_out()).where("length(text) >= 200")
    assert langid.classify(clean, known).where("rejected").count() <= 0.005 * clean.count()


def test_margins():
    def text(words, n, seed):
        rng = random.Random(seed)
        return langid.normal(" ".join(rng.choice(words) for _ in range(n)))

    rng = random.Random(9)
    spoken = {x: ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(300)] for x in ("xx", "yy", "zz")}
    dictionaries = {x: text(w, 4000, 1) for x, w in spoken.items()}
    held = [(x, text(w, 30, k)) for x, w in spoken.items() for k in range(2, 20)]
    model = langid.calibrate(dictionaries, held)
    assert model.coverage == model.precision == 1.0 and model.caught > 0.9 and model.min_margin > 0
    plain = {}  # the definition, one dictionary at a time
    for own, data in held:
        sizes = {x: len(langid._coder(d).compress(data)) for x, d in dictionaries.items()}
        least = sorted(sizes.values())
        plain[data] = (min(sizes, key=sizes.get), least[1] / least[0] - 1)
        assert plain[data][0] == own and plain[data][1] > model.min_margin
    assert langid.calibrate({"xx": dictionaries["xx"]}, held).min_margin == 0.0 and langid.calibrate({}, []) == langid.Model({})


def test_query_against_one_text_at_a_time(spark, tmp_path):
    """Sizes, choice, score and rejection of every row as the definition gives them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    model = langid.learn(docs.where(~langid.held_out()))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op7_language_id(spark, str(tmp_path)).collect():
        x = texts[r.doc_id]
        if x is None or not any(c.isalpha() for c in x):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        sizes = sorted((len(langid._coder(d).compress(langid.normal(x))), n) for n, d in model.dictionaries.items())
        margin = sizes[1][0] / sizes[0][0] - 1
        if margin:
            assert r.lang_pred == sizes[0][1] and abs(r.score - min(1.0, margin / (margin + 0.05))) < 1e-9 and r.rejected == (margin <= model.min_margin)
        else:
            assert r.rejected


def test_one_way_of_encoding_whatever_the_length(spark):
    """A text's size under a dictionary does not fall when it grows, around any length."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs.where(~langid.held_out()))
    text = max((r.text for r in docs.limit(200).collect()), key=len)
    coder = langid._coder(model.dictionaries["en"])
    sizes = [len(coder.compress(langid.normal(text)[:n])) for n in range(500, 5000, 250)]
    assert sizes == sorted(sizes)


def test_edge_cases(spark):
    rows = [(i, t, lang, None, "mine") for i, (t, lang) in enumerate([("the cat and the dog of the house", "en"), ("der Hund und die Katze im Haus", "de"), (None, "en"), ("the", None)] * 5)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")
    known = langid.learn(labelled)
    assert sorted(known.dictionaries) == ["de", "en"] and all(len(v) <= langid.DICTIONARY_BYTES for v in known.dictionaries.values())
    texts = [None, "", "123 ² ... !!", "the cat and the dog", "die Katze und der Hund", "the cat " * 100_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in langid.classify(docs, known).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["und", "und", "und", "en", "de", "en"]
    assert [got[i].rejected for i in range(6)] == [True, True, True, False, False, False]
    assert {r.lang_pred for r in langid.classify(docs, langid.Model({})).collect()} == {"und"}
    assert langid.learn(labelled.limit(0)) == langid.Model({}) and langid.classify(docs.limit(0), known).count() == 0
    one = langid.classify(docs, langid.Model({"en": known.dictionaries["en"]})).where("doc_id = 3").first()
    assert one.lang_pred == "en" and not one.rejected

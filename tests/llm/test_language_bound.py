"""The language stage's bound on scores, and many languages."""

import numpy as np

from lacuna.llm import language

SCHEMA = "doc_id long, text string, lang string"


def test_bound_keeps_clean_texts_and_rejects_mixed_ones(spark):
    en, fr = "the cat and the dog sat on the mat with this ".split(), "le chat et le chien sont sur la table avec cette ".split()
    rng = np.random.default_rng(2)
    clean = [(i, " ".join(rng.choice((fr, en)[i % 2], 30 + i % 50)), ("fr", "en")[i % 2]) for i in range(900)]
    mixed = [(2000 + i, " ".join(rng.choice(en, 200)) + " " + " ".join(rng.choice(fr, 170)), None) for i in range(10)]
    kept = {r.doc_id for r in language.identified_documents(spark.createDataFrame([*clean, *mixed], SCHEMA)).collect()}
    assert len(kept & set(range(900))) >= 890 and len(kept & set(range(2000, 2010))) <= 5


def test_all_languages_are_learned(spark):
    rows = [(i, f"word of language {i % 230} " * 3, f"l{i % 230:03d}") for i in range(1380)]
    langs, _ = language.learn(spark.createDataFrame(rows, SCHEMA), 230)
    assert len(langs) == 230


def test_bound_is_the_lowest_score_of_all_spared_texts(spark):
    rng = np.random.default_rng(3)
    words = ["the cat and dog sat on mat".split(), "le chat et chien sont sur la".split()]
    rows = [(i, " ".join(rng.choice(words[i % 2], 20)), ("en", "fr")[i % 2]) for i in range(12_000)]
    mixed = [(20_000 + i, " ".join(rng.choice(words[i % 2], 11)) + " " + " ".join(rng.choice(words[1 - i % 2], 9)), ("en", "fr")[i % 2]) for i in range(600)]
    # the mixed ones stand where a sample of 1,000 of the spared rows, by this draw, has none
    mixed = language._training(spark.createDataFrame(mixed, SCHEMA), True).filter(language._draw(language.SEED + 2) > 0.8)
    docs = spark.createDataFrame(rows, SCHEMA).union(mixed).cache()
    model = language.learn(docs, 400, spare=True)
    spared = language._training(docs, True)
    found = language.predict(spared, model).join(spared.select("doc_id", "lang"), "doc_id").filter("lang = lang_pred")
    bound = max(0.0, 1 - 2 * (1 - found.selectExpr("min(score)").first()[0]))
    assert found.count() > 1_500 and language.calibrated(docs, model) == bound

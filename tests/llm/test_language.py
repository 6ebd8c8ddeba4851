"""Problem 8: languages."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from codekin.llm import language

SCHEMA = "doc_id long, text string, lang string, segments string, label string, source string"
EN = "The loader reads the first opcodes in most of the files because nobody checks the size of the input."
DE = "Der Lader gibt das Längenfeld nicht frei, weil niemand die Größe der Eingabe in den Programmen prüft."
FR = "Le chargeur lit les premières instructions dans la plupart des fichiers parce que personne ne vérifie la taille."


@pytest.fixture(scope="module")
def samples():
    return pd.read_parquet("/root/testdata/sf0.001/lang_sample.parquet")


@pytest.fixture(scope="module")
def model(samples):
    return language.train(samples.sample_text.tolist(), samples.lang.tolist())


def test_held_out_accuracy(samples):
    held = np.random.default_rng(3).random(len(samples)) < 0.3
    m = language.train(samples.sample_text[~held].tolist(), samples.lang[~held].tolist())
    tests = [(w, label) for t, label in zip(samples.sample_text[held], samples.lang[held]) for _, w in language.sentences(t)]
    sums = np.array([np.sum([m.score(x) for x in w], axis=0) for w, _ in tests])
    p = m.probabilities(sums)
    assert np.mean([m.langs[i] == label for i, (_, label) in zip(p.argmax(axis=1), tests)]) > 0.99
    assert (m.weights == 0).mean() > 0.3 and 0.2 <= m.temperature <= 5


def error(confidence, right):
    """Expected calibration error over ten bins."""
    confidence, right = np.array(confidence), np.array(right, float)
    place = np.ceil(confidence * 10)
    return sum((place == k).mean() * abs(confidence[place == k].mean() - right[place == k].mean()) for k in set(place))


@pytest.mark.parametrize("size", [2, 4, 8])
def test_confidence_as_written_out_is_calibrated(spark, samples, size):
    held = np.random.default_rng(3).random(len(samples)) < 0.3
    m = language.train(samples.sample_text[~held].tolist(), samples.lang[~held].tolist())
    tests = [(w, label) for t, label in zip(samples.sample_text[held], samples.lang[held]) for _, w in language.sentences(t)]
    tests = [x for x in language._windows(tests, size) if len(x[0]) == size]
    docs = spark.createDataFrame([(i, " ".join(w), label) for i, (w, label) in enumerate(tests)], "doc_id long, text string, lang string")
    rows = [(r["segments"][0], r["label"]) for r in language.segmented(docs, "doc_id", "text", "lang", m).collect() if r["segments"]]
    assert len(rows) > 0.9 * len(tests)
    assert error([s["confidence"] for s, _ in rows], [s["lang"] == label for s, label in rows]) < 0.02


def test_context_leaves_out_the_sentence_itself():
    p = np.array([[0.6, 0.4], [0.9, 0.1], [0.2, 0.8], [0.2, 0.8]])
    got = language.in_context(p, np.array([4, 4, 4, 12]), np.array([5, 7, 7, 7]))
    assert np.allclose(got[0], p[0])
    prior = (p[2] * 4 + p[3] * 12) / 16 + language.ELSEWHERE
    assert np.allclose(got[1], p[1] * prior / (p[1] * prior).sum())


def test_short_sentence_has_the_confidence_of_the_language_given(spark, model):
    segments, _, _ = run(spark, model, [(1, f"{DE} Okay then. {DE}", "de")])
    got = segments.collect()[0]["segments"]
    assert [s["lang"] for s in got] == ["de"] and 0.5 < got[0]["confidence"] < 0.999


def run(spark, model, rows):
    df = spark.createDataFrame([(*r, "clash", "clash", "c") for r in rows], SCHEMA)
    segments = language.segmented(df, "doc_id", "text", "lang", model)
    languages = language.document_languages(segments)
    return segments, languages, sorted(((r["doc_id"], r["lang"]) for r in language.wrong_labels(languages).collect()))


def test_cases(spark, model):
    rows = [
        (1, EN, "en"), (2, EN, "EN_us "), (3, EN, "English"), (4, EN, "de"), (5, EN, None), (6, EN, "sv"), (7, EN, " "), (8, f"{EN}\n\n{DE}", "en"),
        (9, None, "en"), (10, "", None), (11, " \n\t", "??"), (12, "R_EAX:reg32_t = T_32t1:reg32_t;\n" * 30, None), (13, "| key_split | 12 | 0.5 |\n" * 40, "fr"),
        (14, EN.upper(), "en"), (15, "Der Lader liest.", "en"), (16, f'{EN} ("losse eindjes")', "en"), (17, f"{DE} {FR} {EN}", "mul"), (None, EN, "de"),
        (18, EN, "deutsch"), (18, EN, "deutsch"), (19, DE.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss"), "ger"), (20, "1234 0xff == ()", "xx"),
    ]
    segments, languages, wrong = run(spark, model, rows)
    assert wrong == [(4, "en"), (5, "en"), (6, "en"), (7, "en"), (8, "de"), (8, "en"), (17, "de"), (17, "en"), (17, "fr"), (18, "en")]
    assert segments.count() == len(rows)
    by = {r["doc_id"]: r["segments"] for r in segments.collect()}
    assert [s["lang"] for s in by[17]] == ["de", "fr", "en"] and all(0.5 < s["confidence"] <= 1 for s in by[17])
    assert by[9] == by[10] == by[11] == by[12] == by[13] == []


def test_empty_tables_and_long_text(spark, model):
    assert run(spark, model, [])[2] == []
    none = language.fitted(spark.createDataFrame([], "lang string, sample_text string"), "lang", "sample_text")
    assert run(spark, none, [(1, EN, "de")])[2] == []
    assert run(spark, model, [(1, (EN + " ") * 5000, "de")])[2] == [(1, "en")]


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("en-US", " EN\t", "français", "русский", "xx", "", None, "nl_BE", "Español", "de-AT", "english text")], "l string")
    got = [r[0] for r in df.select(language.label_language(F.col("l"))).collect()]
    assert got == ["en", "en", "fr", "ru", None, None, None, "nl", "es", "de", None]

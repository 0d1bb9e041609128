"""Decision tables: golden pairs, one row for every rule that words can reach, and odd rows."""

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import guards as D

ENTRY = "word string, lang string, freq double, never boolean, user boolean"
WORDS = [
    *[(w, "en", f, False, False) for w, f in (("hello", 0.95), ("dear", 0.9), ("wait", 0.92), ("work", 0.97), ("hi", 0.95), ("gpu", 0.85), ("he", 0.9995), ("fast", 0.9), ("the", 1.0), ("stone", 0.9), ("store", 0.88), ("backend", 0.82), ("rarely", 0.5))],
    *[(w, "ru", f, False, False) for w, f in (("привет", 0.95), ("все", 0.99), ("вроде", 0.8), ("окей", 0.55), ("цикл", 0.8), ("можешь", 0.9), ("можеш", 0.4), ("команда", 0.9), ("кот", 0.9), ("ёлка", 0.8))],
    ("ghost", "en", 0.9, True, False), ("frame", "en", None, None, True),
]


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame(WORDS, ENTRY).cache()


def layout(spark, dictionary, rows):
    """(token, replacement, lang, strong_ru, strong_en) -> (verdict, rule)"""
    df = spark.createDataFrame([(*r[:3], *(r[3:] or (False, False)), False) for r in rows], "token string, replacement string, lang string, strong_ru boolean, strong_en boolean, some_en boolean")
    return {(r.token, r.replacement): (r.verdict, r.rule) for r in D.layout_decisions(df, dictionary).collect()}


def test_layout_golden_pairs(spark, dictionary):
    got = layout(spark, dictionary, [
        ("ghbdtn", "привет", "en"), ("dct", "все", "en"), ("dhjlt", "вроде", "en"), ("jrtq", "окей", "en"), ("руддщ", "hello", "ru"), ("ррудщ", "hello", "ru"), ("вуфк", "dear", "ru"),
        ("цфше", "wait", "ru"), ("цщкл", "work", "ru"), ("пзг", "gpu", "ru"), ("nen", "тут", "en"), ("rjn", "кот", "en"), ("ифслутв", "backend", "ru"),
    ])
    assert {v for v, _ in got.values()} == {"allow"}
    assert got["jrtq", "окей"] == ("allow", "anchored_rare_word") and got["ррудщ", "hello"] == ("allow", "alias")
    assert got["nen", "тут"] == got["rjn", "кот"] == ("allow", "service_word") and got["ифслутв", "backend"] == ("allow", "strong_image")


def test_layout_refusals(spark, dictionary):
    got = layout(spark, dictionary, [
        ("nen", "кот", "en"), ("work", "цщкл", "en"), ("ррудщ", "hi", "ru"), ("ghbdtn", "пока", "en"), ("ыещку", "stone", "ru"), ("ыещту", "store", "ru"), ("кфкудн", "rarely", "ru"), ("ефзщку", "tapore", "ru"), ("црфе", "what", "ru"),
        ("", "x", "en"), (None, "x", "en"), ("ab", None, "en"), ("ab", "фи", None), ("same", "SAME", "en"),
    ])
    assert got["nen", "кот"] == ("wait", "other_service_word") and got["work", "цщкл"] == ("no_change", "known_word")
    assert got["ррудщ", "hi"] == ("wait", "other_alias") and got["ghbdtn", "пока"] == ("wait", "not_the_image")
    assert got["ыещку", "stone"] == got["ыещту", "store"] == ("wait", "not_the_image")
    assert got["кфкудн", "rarely"][0] == "wait" and got["ефзщку", "tapore"][0] == "wait" and got["црфе", "what"][0] == "wait"
    assert {got["", "x"], got[None, "x"], got["ab", None], got["same", "SAME"]} == {("no_change", "nothing_to_do")}
    assert got["ab", "фи"] == ("no_change", "no_language")


def test_layout_in_context(spark, dictionary):
    got = layout(spark, dictionary, [("ру", "he", "ru", False, True), ("hi", "ри", "en", True, False), ("кот", "rjn", "ru", False, True), ("ghbdtn", "привет", "en", True, False)])
    assert got["ру", "he"] == ("allow", "service_word") and got["кот", "rjn"] == ("no_change", "known_word") and got["hi", "ри"] == ("no_change", "known_word")


def spelling(spark, dictionary, rows):
    df = spark.createDataFrame(rows, "token string, replacement string, lang string")
    return {(r.token, r.replacement): (r.verdict, r.rule) for r in D.spelling_decisions(df, dictionary).collect()}


def test_spelling_table(spark, dictionary):
    got = spelling(spark, dictionary, [
        ("teh", "the", "en"), ("teh", "hi", "en"), ("можеш", "можешь", "ru"), ("кмнда", "команда", "ru"), ("helllo", "hello", "en"), ("stome", "stone", "en"), ("work", "wait", "en"), ("елка", "ёлка", "ru"), ("hello", "Hello", "en"), ("wrok", "work", None), ("zzz", "zoo", "en"),
    ])
    assert got["teh", "the"] == ("allow", "common_slip") and got["teh", "hi"] == ("wait", "other_slip") and got["кмнда", "команда"] == ("allow", "common_slip")
    assert got["можеш", "можешь"] == ("allow", "soft_sign") and got["helllo", "hello"] == ("allow", "unique_source")
    assert got["stome", "stone"][0] == "wait" and got["work", "wait"] == ("no_change", "known_word")  # stone and store
    assert got["елка", "ёлка"] == ("no_change", "known_word") and got["hello", "Hello"] == ("no_change", "nothing_to_do")
    assert got["wrok", "work"] == ("no_change", "no_language") and got["zzz", "zoo"] == ("wait", "not_unique")


def test_combined_table(spark, dictionary):
    df = spark.createDataFrame([("руддщ", "hello", "ru"), ("рудддщ", "hello", "ru"), ("work", "hello", "en"), ("123", "124", "en"), (None, "a", "ru"), ("вуфк", "dear", "ru"), ("вуфк", "dear", "ru")], "token string, replacement string, lang string")
    rows = [(r.token, r.replacement, r.verdict, r.rule) for r in D.combined_decisions(df, dictionary).collect()]
    got = {r[:2]: r[2:] for r in rows}
    assert len(rows) == 7 and got["руддщ", "hello"][0] == "allow" and got["рудддщ", "hello"] == ("wait", "known_replacement")
    assert got["work", "hello"] == ("no_change", "known_word") and got["123", "124"] == ("no_change", "no_image") and got["вуфк", "dear"][0] == "allow"


def test_analysis_classes(spark, dictionary):
    rows = [("helllo", "en"), ("hello", "en"), ("ghost", "en"), ("привет", "en"), ("a1", "en"), ("GitHub", "en"), ("sttone", "en"), ("qqqq", "en"), ("цыкл", "ru"), ("Елка", "ru")]
    got = {r.token: r for r in D.mutation_analysis(spark.createDataFrame(rows, "token string, lang string"), dictionary).collect()}
    assert {t: r["class"] for t, r in got.items()} == {
        "helllo": "Unique", "hello": "KnownWord", "ghost": "KnownWord", "привет": "OtherScript", "a1": "Invalid", "github": "Protected", "sttone": "Unique", "qqqq": "Ambiguous", "цыкл": "Unique", "елка": "KnownWord",
    }
    assert got["helllo"].target == "hello" and got["helllo"].safe and got["qqqq"].n_sources == 0 and got["цыкл"].target == "цикл"


def test_first_match_takes_the_first_rule(spark):
    rules = [D.Rule("a", "x", F.col("id") > 5), D.Rule("b", "y", F.col("id") > 2), D.Rule("n", "z", F.lit(None).cast("boolean"))]
    got = [(r.d.verdict, r.d.rule) for r in spark.range(8).orderBy("id").select(D.first_match(rules, "none").alias("d")).collect()]
    assert got == [("none", None)] * 3 + [("y", "b")] * 3 + [("x", "a")] * 2


def test_empty_tables(spark, dictionary):
    none = spark.createDataFrame([], "token string, replacement string, lang string, strong_ru boolean, strong_en boolean, some_en boolean")
    assert D.layout_decisions(none, dictionary).collect() == D.spelling_decisions(none, dictionary).collect() == D.combined_decisions(none, dictionary).collect() == []
    assert spelling(spark, dictionary.limit(0), [("teh", "the", "en")]) == {("teh", "the"): ("wait", "not_unique")}

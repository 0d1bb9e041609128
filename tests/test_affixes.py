"""Affix rules against a plain analyser, files that are no pair, and odd rows."""

import random
import re

import pytest

from lexiloom.operators import affixes as X

AFF = """SET UTF-8
FLAG char
# a comment
PFX U Y 1
PFX U   0   un   .
PFX R N 1
PFX R 0 re [^r]
SFX S Y 3
SFX S y ies/Z [^aeiou]y
SFX S 0 s [^sy]
SFX S 0 es s
SFX D Y 3
SFX D 0 d e
SFX D y ied [^aeiou]y
SFX D 0 ed [^ey]
SFX E N 1
SFX E ing 0 ing
"""
RULES = [
    ("PFX", "U", True, "", "un", "."), ("PFX", "R", False, "", "re", "[^r]"), ("SFX", "S", True, "y", "ies", "[^aeiou]y"), ("SFX", "S", True, "", "s", "[^sy]"), ("SFX", "S", True, "", "es", "s"),
    ("SFX", "D", True, "", "d", "e"), ("SFX", "D", True, "y", "ied", "[^aeiou]y"), ("SFX", "D", True, "", "ed", "[^ey]"), ("SFX", "E", False, "ing", "", "ing"),
]


def apply(word, rule):
    kind, _, _, strip, append, condition = rule
    if kind == "SFX":
        return word[: len(word) - len(strip)] + append if word.endswith(strip) and re.search(f"(?:{condition})$", word) else None
    return append + word[len(strip) :] if word.startswith(strip) and re.match(condition, word) else None


def plain_forms(entries):
    out = set()
    for word, flags in entries:
        own = [r for r in RULES if r[1] in flags]
        out.add((word, word, None, None))
        for r in own:
            f = apply(word, r)
            if f is not None:
                out.add((word, f, r[1] if r[0] == "PFX" else None, r[1] if r[0] == "SFX" else None))
            if f is not None and r[0] == "SFX" and r[2]:
                for p in own:
                    g = apply(f, p) if p[0] == "PFX" and p[2] else None
                    if g is not None:
                        out.add((word, g, p[1], r[1]))
    return {x for x in out if x[1]}


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pack")
    rng = random.Random(3)
    words = ["happy", "play", "kiss", "like", "run", "sing", "ring", "ing", "a", "redo", "unties", "tie"] + ["".join(rng.choices("aeinrsty", k=rng.randint(1, 6))) for _ in range(80)]
    entries = [(w, "".join(rng.sample("URSDE", rng.randint(0, 5)))) for w in dict.fromkeys(words)]
    (folder / "x.aff").write_text(AFF)
    (folder / "x.dic").write_text(f"{len(entries)}\n" + "\n".join(f"{w}/{f}\tpo:noun" if f else w for w, f in entries) + "\n\n# end\n")
    return folder, entries


def test_files(spark, pair):
    folder, entries = pair
    rules, kind = X.read_affix_file(spark, f"{folder}/x.aff")
    assert kind == "char" and {tuple(r[c] for c in ("kind", "flag", "cross", "strip", "append", "condition")) for r in rules.collect()} == set(RULES)
    got = {r.word: set(r.flags) for r in X.read_entries(spark, f"{folder}/x.dic").collect()}
    assert got == {w: set(f) for w, f in entries}
    assert X.looks_like_pair(spark, f"{folder}/x.dic", f"{folder}/x.aff")
    assert not X.looks_like_pair(spark, f"{folder}/x.aff", f"{folder}/x.dic") and not X.looks_like_pair(spark, f"{folder}/none.dic", f"{folder}/x.aff")
    for read, name in ((X.read_affix_file, "x.dic"), (X.read_entries, "x.aff")):
        with pytest.raises(ValueError, match="does not begin"):
            read(spark, f"{folder}/{name}")


def test_forms_and_roots_equal_a_plain_analyser(spark, pair):
    folder, entries = pair
    rules, kind = X.read_affix_file(spark, f"{folder}/x.aff")
    own = X.read_entries(spark, f"{folder}/x.dic", kind)
    want = plain_forms(entries)
    key = lambda r: tuple("" if x is None else x for x in r)
    assert sorted(map(key, X.word_forms(own, rules).collect())) == sorted(map(key, want))
    tokens = sorted({f for _, f, _, _ in want})[::2] + ["Happy", "nothing at all", "", None, "un", "s"]
    df = spark.createDataFrame([(t,) for t in dict.fromkeys(tokens)], "token string")
    got = sorted(key(r) for r in X.analyse(df, own, rules).collect())
    by_form = {}
    for w, f, p, s in want:
        by_form.setdefault(f, []).append((w, p, s))
    assert got == sorted(key((t, *x)) for t in dict.fromkeys(tokens) if t for x in by_form.get(t.lower(), []))
    roots = {r.token: r.root for r in X.root_words(df, own, rules).collect()}
    for t in dict.fromkeys(tokens):
        ways = [((p is not None) + (s is not None), -len(w), w) for w, p, s in by_form.get((t or "").lower(), []) if w != t.lower()]
        assert roots.get(t) == (min(ways)[2] if ways else None)


def test_flag_kinds_and_missing_headers(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("AaBb", "12,7"), (None, "")], "two string, num string")
    got = [tuple(r) for r in df.select(X.split_flags(F.col("two"), "long"), X.split_flags(F.col("num"), "num"), X.split_flags(F.col("two"))).collect()]
    assert got == [(["Aa", "Bb"], ["12", "7"], ["A", "a", "B", "b"]), ([], [], [])]
    with pytest.raises(Exception, match="no header"):
        X.affix_rules(spark.createDataFrame([("SFX Q 0 s .",)], "value string")).collect()


def test_empty_tables(spark):
    rules = X.affix_rules(spark.createDataFrame([(x,) for x in AFF.splitlines()], "value string"))
    entries = spark.createDataFrame([], "word string, flags array<string>")
    tokens = spark.createDataFrame([("runs",)], "token string")
    assert X.word_forms(entries, rules).collect() == [] and X.analyse(tokens, entries, rules).collect() == []
    one = spark.createDataFrame([("run", ["S"])], "word string, flags array<string>")
    assert X.analyse(tokens.limit(0), one, rules).collect() == [] and [tuple(r) for r in X.analyse(tokens, one, rules.limit(0)).collect()] == []

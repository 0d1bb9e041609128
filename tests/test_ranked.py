"""Ranks, fingerprints and overlaps against plain versions."""

import hashlib
import random

import pytest

from lexiloom.operators import overlaps as W
from lexiloom.operators import ranks as R


def table(spark, rows, parts):
    return spark.createDataFrame(rows, "a long, b string").repartition(parts)


def test_fingerprint_depends_on_order_alone(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(50)]), rng.choice([None, "", "x", "y-", "=z"])) for _ in range(300)]
    prints = {(r.rows, r.digest) for n in (1, 3, 7) for r in R.fingerprint(table(spark, rng.sample(rows, 300), n), ["a"], chunk=16).collect()}
    assert len(prints) == 1 and next(iter(prints))[0] == 300
    ids = [(i, f"v{i}") for i in range(40)]
    swapped = [(i, f"v{({3: 4, 4: 3}.get(i, i))}") for i in range(40)]
    one, other = (R.fingerprint(table(spark, x, 3), ["a"], chunk=8).first().digest for x in (ids, swapped))
    assert one != other and one != R.fingerprint(table(spark, ids[:-1], 3), ["a"], chunk=8).first().digest


def test_fingerprint_is_a_tree_of_digests(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = [sha(f"={i}\x1f=v{i}") for i in range(70)]
    while len(level) > 1:
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    got = R.fingerprint(table(spark, [(i, f"v{i}") for i in range(70)], 4), ["a"], chunk=8).first()
    assert (got.rows, got.digest) == (70, level[0])
    assert tuple(R.fingerprint(table(spark, [], 1), ["a"]).first()) == (0, sha(""))


def test_ranks(spark):
    rows = [(i * 7 % 101, str(i)) for i in range(101)] + [(5, "again")] * 3
    got = sorted((r["rank"], r["a"]) for r in R.ranked(table(spark, rows, 5), ["a"]).collect())
    assert [r for r, _ in got] == list(range(104)) and [a for _, a in got] == sorted(a for a, _ in rows)


def groups(w, q):
    p = "^" * (q - 1) + w + "^" * (q - 1)
    return {p[i : i + q] for i in range(len(p) - q + 1)}


@pytest.mark.parametrize("q, percent", [(2, 50), (3, 34), (2, 100), (2, 70)])
def test_overlaps_equal_brute_force(spark, q, percent):
    rng = random.Random(q * percent)
    make = lambda n: ["".join(rng.choices("aeinrst", k=rng.randint(1, 8))) for _ in range(n)]
    tokens, words = [*make(150), "aaaa", "", None], [*make(200), "aaa", "aaaaa"]
    got = W.overlap_join(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(w,) for w in words], "word string"), q, percent).collect()
    want = set()
    for t in set(tokens) - {"", None}:
        for w in set(words):
            shared, total = len(groups(t, q) & groups(w, q)), len(groups(t, q) | groups(w, q))
            if t != w and 100 * shared >= percent * total:
                want.add((t, w, shared, total))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_suggestions(spark):
    lexicon = spark.createDataFrame([("station", 0.9), ("nation", 0.8), ("stations", 0.5), ("cat", 0.7)], "word string, freq double")
    got = W.suggestions(spark.createDataFrame([("statoin",), ("stationing",), ("zzz",)], "token string"), lexicon, q=2, percent=50)
    assert {(r.token, r.word, r["rank"]) for r in got.collect()} == {("statoin", "station", 1), ("stationing", "station", 1), ("stationing", "stations", 2)}

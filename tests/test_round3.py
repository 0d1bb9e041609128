"""One small test for each finding of round 3 that changed the code."""

import random

from pyspark.sql import functions as F

from lexiloom.functions import edits as E
from lexiloom.operators import candidates as C
from lexiloom.operators import events as V
from lexiloom.operators import guards as D
from lexiloom.operators import models as M
from lexiloom.operators import orthography as O
from lexiloom.operators import overlaps as W
from lexiloom.operators import spelling as L


def words(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


def some(rng, letters, n, low=1, high=6):
    return sorted({"".join(rng.choices(letters, k=rng.randint(low, high))) for _ in range(n)})


def test_dictionary_is_made_once(spark):
    """the table of facts is stored, and taken as it is when it comes again."""
    table = D._dictionary(words(spark, [("a", "en", 0.5, None, True)], "word string, lang string, freq double, never boolean, user boolean"))
    assert "FileScan" in table._jdf.queryExecution().toString() or "parquet" in table._jdf.queryExecution().toString()
    assert [tuple(r) for r in D._dictionary(table).collect()] == [tuple(r) for r in table.collect()]


def test_pairs_bring_frequencies(spark):
    """pairs carry columns of the lexicon, and edits are told from the first difference."""
    rng = random.Random(5)
    tokens, lexicon = some(rng, "abc", 60), [(w, i / 100) for i, w in enumerate(some(rng, "abc", 60))]
    lex = words(spark, lexicon, "word string, freq double")
    t = words(spark, [(x,) for x in tokens], "token string")
    got = C.mutation_sources(C.one_edit_pairs(t, lex, ("freq",)), lex)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, C.mutation_sources(C.generated_pairs(t, lex), lex).collect()))
    both = t.crossJoin(lex.select("word"))
    prefix = both.select("token", "word", E.shared_prefix(F.col("token"), F.col("word")).alias("p"), E.is_transposition(F.col("token"), F.col("word")).alias("t")).collect()
    for r in prefix:
        assert r.p == next((i for i, (x, y) in enumerate(zip(r.token, r.word)) if x != y), min(len(r.token), len(r.word)))
        swaps = {r.token[:i] + r.token[i + 1] + r.token[i] + r.token[i + 2 :] for i in range(len(r.token) - 1)}
        assert r.t == (r.token != r.word and r.word in swaps)


def test_two_edits_are_those_of_all_pairs(spark):
    """the nearest words are those of a plain comparison of all pairs; the plan tests swaps after plain edits only."""
    rng = random.Random(6)
    t = words(spark, [(x,) for x in some(rng, "abcd", 50, 2, 7)], "token string")
    lex = words(spark, [(w, 0.5) for w in some(rng, "abcd", 50, 2, 7)], "word string, freq double")
    found = L.two_edit_candidates(t, lex, 1000)
    near = t.crossJoin(lex).filter("token != word").withColumn("d", L.near_distance(F.col("token"), F.col("word"))).filter("d <= 2")
    least = near.groupBy("token").agg(F.min("d").alias("d"))
    assert sorted(map(tuple, found.select("token", "word", "distance").collect())) == sorted((r.token, r.word, r.d) for r in near.join(least, ["token", "d"]).collect())
    assert "2, 4) AS plain" in found._jdf.queryExecution().analyzed().toString() or ", Some(4)) AS plain" in found._jdf.queryExecution().analyzed().toString()


def test_overlaps_over_several_blocks(spark, monkeypatch):
    """blocks and shards together give every pair once."""
    rng = random.Random(7)
    tokens, lexicon = some(rng, "abc", 40), some(rng, "abc", 40)
    t, w = words(spark, [(x,) for x in tokens], "token string"), words(spark, [(x,) for x in lexicon], "word string")
    monkeypatch.setattr(W, "BLOCK", 7)
    monkeypatch.setattr(W, "SHARD", 9)
    want = []
    for a in tokens:
        for b in lexicon:
            x, y = W._runs(a, 3), W._runs(b, 3)
            if a != b and 100 * len(x & y) >= 50 * len(x | y):
                want.append((a, b, len(x & y), len(x | y)))
    assert sorted(map(tuple, W.overlap_join(t, w, 3, 50).collect())) == sorted(want)


def test_continuations_in_one_pass(spark):
    """the same rows as from counts of pairs and of runs of three apart."""
    rng = random.Random(8)
    docs = words(spark, [(" ".join(rng.choices("a b c D".split(), k=rng.randint(0, 30))),) for _ in range(40)] + [(None,)], "text string")
    bi = M.bigram_counts(docs)
    apart = M.continue_contexts(bi.select("w1", "w2").distinct(), M.best_continuations(bi, ["w1"], "w2", 5), M.best_continuations(M.trigram_counts(docs), ["w1", "w2"], "w3", 5))
    key = lambda df: sorted(map(str, df.select("w1", "w2", "best", "order").collect()))
    assert key(M.continuations(docs, 5)) == key(apart)


def test_insertions_from_the_words_side(spark):
    """F8: the words found by their deletions are those among all insertions."""
    rng = random.Random(9)
    t = words(spark, [(x,) for x in some(rng, "абz", 40, 1, 4)], "token string")
    lex = words(spark, [(w, 0.5) for w in some(rng, "абz", 60, 1, 5)], "word string, freq double")
    made = t.select("token", F.explode(F.array_distinct(O.insertions(F.col("token")))).alias("word")).join(lex, "word").select("token", "word")
    assert sorted(map(tuple, O.inserted(t, lex).select("token", "variant").collect())) == sorted(map(tuple, made.collect()))


def test_votes_keep_their_tokens(spark):
    """tokens are dealt once, so that votes need not be joined with them again."""
    tokens = words(spark, [(1, i, x) for i, x in enumerate("the cat руддщ sat".split())], "doc_id long, pos int, token string")
    found = V.context_layout(tokens, words(spark, [("hello", 0.9)], "word string, freq double"))
    assert [(r.doc_id, r.pos, r.candidate) for r in found.collect()] == [(1, 2, "hello")]
    assert found._jdf.queryExecution().analyzed().toString().count("Join") == 1

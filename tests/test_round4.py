"""One small test for each finding of round 4 that changed the code: no lexicon, and nothing made from one, is sent through the driver."""

import random

from pyspark.sql import functions as F

from lexiloom.operators import candidates as C
from lexiloom.operators import overlaps as W
from lexiloom.operators import spelling as L
from lexiloom.plans import catalog as Q


def some(spark, seed):
    rng = random.Random(seed)
    make = lambda: sorted({"".join(rng.choices("abcd", k=rng.randint(2, 7))) for _ in range(60)})
    return spark.createDataFrame([(t,) for t in make()], "token string"), spark.createDataFrame([(w, i / 60) for i, w in enumerate(make())], "word string, freq double")


def broadcasts(df):
    """Broadcasts of the plan of a table, as chosen by the sizes of its files."""
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def written(monkeypatch, module):
    """Collects the broadcasts of each table that the module stores."""
    seen, stored = {}, module.stored

    def note(df, name):
        seen[name] = broadcasts(df)
        return stored(df, name)

    monkeypatch.setattr(module, "stored", note)
    return seen


def test_keys_of_two_edits_are_merged(spark, monkeypatch):
    """keys of up to two deletions, some 50 for each word, are not broadcast because the file of words is small."""
    seen = written(monkeypatch, L)
    found = L.two_edit_candidates(*some(spark, 1))
    assert seen["near"] == 0 and broadcasts(found) == 0
    assert found.filter("distance = 1").count() and found.filter("distance = 2").count()


def test_joint_decisions_merge_keys(spark, monkeypatch):
    """the same for the options of joint_decisions, with no broadcast at all in the candidates they come from."""
    tokens, lexicon = some(spark, 2)
    monkeypatch.setattr(Q, "_rare_and_lexicon", lambda *_: (tokens, lexicon))
    near, scored = written(monkeypatch, L), written(monkeypatch, Q)
    decided = Q.joint_decisions(spark, "")
    assert near["near"] == scored["scored"] == broadcasts(decided) == 0
    assert decided.filter("kind = 'spelling'").count()


def test_suggestions_merge_keys_and_frequencies(spark, monkeypatch):
    """neither keys of one deletion, nor tokens with a neighbour, nor the lexicon are broadcast."""
    tokens, lexicon = some(spark, 3)
    seen = written(monkeypatch, W)
    found = W.suggestions(tokens, lexicon, k=1000, percent=25)
    assert seen["near"] == seen["token"] == broadcasts(found) == 0
    # rows are those of pairs joined with the lexicon
    near = C.one_edit_pairs(tokens, lexicon)
    lone = tokens.join(near, "token", "left_anti")
    pairs = near.unionByName(W.overlap_join(lone, lexicon, 3, 25).select("token", "word"))
    assert sorted(map(tuple, found.select("token", "word").collect())) == sorted(map(tuple, pairs.collect()))
    assert lone.join(found, "token").filter(F.col("rank") == 1).count()

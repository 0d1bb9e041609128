"""Suggestions beyond edits: words that share most of their letter groups with a token, by counts of shared groups over blocks of tokens and shards of words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators import candidates as C
from lexiloom.sources.shared import ship, spread, stored

PAD = "^"
#: Tokens of a block and words of a shard that meet in a task.
BLOCK, SHARD = 8_192, 65_536


def letter_groups(word: Column, q: int) -> Column:
    """Distinct runs of q letters of the word between q - 1 marks on each side."""
    padded = F.concat(F.lit(PAD * (q - 1)), word, F.lit(PAD * (q - 1)))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (q - 1), F.lit(1))), lambda i: padded.substr(i, F.lit(q))))


def _runs(word: str, q: int) -> set[str]:
    padded = PAD * (q - 1) + word + PAD * (q - 1)
    return {padded[i : i + q] for i in range(max(len(padded) - q + 1, 1))}


def overlap_join(tokens: DataFrame, words: DataFrame, q: int = 2, percent: int = 60) -> DataFrame:
    """token, word, shared, total of all pairs whose letter groups overlap by ``percent`` (above 0) of their union at least.

    Tokens are dealt to blocks and words to shards, both bounded; each block meets each shard. There every group lists the words that have it, and
    a token's shared groups with all words of the shard are counted at once. No pair is left out before it is counted; only pairs that
    overlap enough leave the task. Equal strings do not pair.
    """
    ship(tokens.sparkSession)
    distinct = lambda df, c: stored(df.filter(F.col(c).isNotNull() & (F.col(c) != "")).select(c).distinct(), c)
    token_set, word_set = distinct(tokens, "token"), distinct(words, "word")
    blocks, shards = (max(1, -(-df.count() // most)) for df, most in ((token_set, BLOCK), (word_set, SHARD)))
    dealt = lambda df, c, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64(c), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<bigint>")))
    left = spread(dealt(token_set, "token", "block", blocks, "shard", shards), "block", "shard").groupBy("block", "shard")
    right = spread(dealt(word_set, "word", "shard", shards, "block", blocks), "block", "shard").groupBy("block", "shard")

    def meet(some: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        names = known["word"].to_numpy(object)
        lists: dict[str, list[int]] = {}
        sizes = np.zeros(len(names), np.int64)
        for k, w in enumerate(names):
            g = _runs(w, q)
            sizes[k] = len(g)
            for x in g:
                lists.setdefault(x, []).append(k)
        having = {x: np.array(v, np.int64) for x, v in lists.items()}
        rows: list[tuple] = []
        for t in some["token"]:
            g = _runs(t, q)
            met = [having[x] for x in g if x in having]
            if not met:
                continue
            counts = np.bincount(np.concatenate(met), minlength=len(names))
            at = np.flatnonzero(percent * len(g) <= 100 * counts)  # the union is no smaller than the token's own set
            shared = counts[at]
            total = len(g) + sizes[at] - shared
            fits = (100 * shared >= percent * total) & (names[at] != t)
            if fits.any():
                at = at[fits]
                rows.append((np.full(len(at), t, object), names[at], shared[fits], total[fits]))
        parts = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.array([], object)] * 2 + [np.array([], np.int64)] * 2
        return pd.DataFrame(dict(zip(("token", "word", "shared", "total"), parts, strict=True)))

    return left.cogroup(right).applyInPandas(meet, "token string, word string, shared long, total long")


def suggestions(tokens: DataFrame, lexicon: DataFrame, k: int = 8, q: int = 3, percent: int = 50) -> DataFrame:
    """token, word, rank: up to k words for each token: those one edit away, or, for tokens without any, those that overlap with it, largest overlap
    first; then by frequency and word."""
    tokens, lexicon = stored(tokens.select("token").distinct(), "tokens"), stored(lexicon.select("word", "freq"), "lexicon")
    near = stored(C.one_edit_pairs(tokens, lexicon, ("freq",)), "near")
    rest = tokens.join(C.merged(near.select("token").distinct()), "token", "left_anti")
    near = near.withColumns({"shared": F.lit(1).cast("long"), "total": F.lit(1).cast("long")})
    found = near.unionByName(overlap_join(rest, lexicon, q, percent).join(C.merged(lexicon), "word"))
    order = Window.partitionBy("token").orderBy(F.desc(F.col("shared") / F.col("total")), F.desc("freq"), "word")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("token", "word", "rank")

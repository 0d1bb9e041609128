"""Queries over ranks, ordered fingerprints, overlaps of letter groups, and undo windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import overlaps as W
from lexiloom.operators import ranks as R
from lexiloom.plans import catalog as Q
from lexiloom.plans.catalog import _query
from lexiloom.plans.guarded import _NEAR
from lexiloom.sources import tables as S
from lexiloom.streaming import buffers as B
from lexiloom.streaming.ordered import UndoWindow, with_micros


@_query(f"""WITH {Q._DECIDE}, r AS (SELECT token, reason, sha256('=' || token || chr(31) || '=' || reason) AS h FROM d), k AS (SELECT h, row_number() OVER (ORDER BY token, h) - 1 AS rank FROM r),
    one AS (SELECT rank // {R.CHUNK} AS rank, sha256(string_agg(h, '' ORDER BY rank)) AS h FROM k GROUP BY 1), two AS (SELECT sha256(string_agg(h, '' ORDER BY rank)) AS h FROM one)
    SELECT (SELECT count(*) FROM r) AS rows, CASE WHEN (SELECT count(*) FROM one) > 1 THEN (SELECT h FROM two) ELSE (SELECT min(h) FROM one) END AS digest""")
def decision_fingerprint(spark, sf_dir):
    from lexiloom.plans.decisions import decide

    decided = decide(Q._distinct_tokens(spark, sf_dir), S.lexicon(Q._docs(spark, sf_dir)))
    return R.fingerprint(decided.select("token", "reason"), ["token"])


@_query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS rank FROM events")
def event_ranks(spark, sf_dir):
    return R.ranked(S.read(spark, sf_dir, "events").select("ts", "event_id"), ["ts", "event_id"]).select("event_id", "rank")


_GROUPS = "list_distinct(list_transform(range(1, length({0}) + 3), lambda i: ('^^' || {0} || '^^')[i:i + 2]))"
_OVERLAPS = f"""g1 AS (SELECT token, unnest({_GROUPS.format("token")}) AS x FROM lone), g2 AS (SELECT word, unnest({_GROUPS.format("word")}) AS x FROM lex), n1 AS (SELECT token, count(*) AS n FROM g1 GROUP BY 1), n2 AS (SELECT word, count(*) AS n FROM g2 GROUP BY 1),
    met AS (SELECT token, word, count(*) AS shared FROM g1 JOIN g2 USING (x) GROUP BY 1, 2),
    lapped AS (SELECT token, word, shared, n1.n + n2.n - shared AS total FROM met JOIN n1 USING (token) JOIN n2 USING (word) WHERE 100 * shared >= 50 * (n1.n + n2.n - shared))"""


@_query(f"""WITH {Q._WORDS}, {Q._COUNTS}, {Q._LEX}, {Q._RARE.replace("length(word) >= 2", "TRUE")}, {_NEAR}, lone AS (SELECT token FROM rare WHERE token NOT IN (SELECT token FROM near)), {_OVERLAPS},
    every AS (SELECT token, word, freq, 1.0e0 AS o FROM near UNION ALL SELECT token, word, freq, shared / total FROM lapped JOIN lex USING (word)),
    r AS (SELECT token, word, row_number() OVER (PARTITION BY token ORDER BY o DESC, freq DESC, word) AS rank FROM every) SELECT token, word, rank FROM r WHERE rank <= 8""")
def overlap_suggestions(spark, sf_dir):
    docs = Q._docs(spark, sf_dir)
    rare = S.english_counts(docs).filter("n < 5 and length(word) >= 3").select(F.col("word").alias("token"))
    return W.suggestions(rare.cache(), S.lexicon(docs).cache())


@_query("""WITH e AS (SELECT event_id, user_id, ts, CASE event_id % 5 WHEN 0 THEN 'Correction' WHEN 1 THEN 'Undo' ELSE 'Other' END AS kind FROM events),
    n AS (SELECT *, lead(kind) OVER x AS k2, lead(event_id) OVER x AS undo_id, (lead(epoch_us(ts)) OVER x - epoch_us(ts)) / 1000 AS age_ms FROM e WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id AS key, event_id, undo_id, age_ms FROM n WHERE kind = 'Correction' AND k2 = 'Undo' AND age_ms <= 3600000""")
def undo_windows(spark, sf_dir):
    """The machine that streams run, over the table."""
    kind = F.when(F.col("event_id") % 5 == 0, "Correction").when(F.col("event_id") % 5 == 1, "Undo").otherwise("Other")
    rows = with_micros(S.read(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("key"), kind.alias("kind"), F.lit("").alias("ch")))
    return B.over_table(rows, UndoWindow, ttl_ms=3_600_000)

"""The pipeline's stages, each on its own input, against plain versions."""

import random
from collections import Counter

import corpus_pipeline as cp
import pytest
from test_operators import DOC, change, classes, odd_rows, plain_spans, prose

from lexiloom.llm import mixing, neardup, quality, workspace
from lexiloom.llm.components import connected_components


def rows(seed=1):
    rng = random.Random(seed)
    out = [(i, prose(rng.randint(60, 160), rng)) for i in range(120)]
    out += [(200 + i, change(out[i][1], 0.01, rng)) for i in range(15)] + [(300 + i, out[i][1]) for i in range(10)]
    out += [(400 + i, " ".join(w + "%%%" for w in prose(90, rng).split())) for i in range(12)] + [(500, "few words"), (501, None)]
    out += [(600 + i, prose(70, rng) + f" write to me.{i}@mail.example now") for i in range(5)]
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in out]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), COLUMNS).cache()


def test_order():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "mixing", "byte_bpe"]


def test_quality_stage(spark, docs):
    got = {r.doc_id for r in cp.quality(spark, docs, "").collect()}
    assert got == {r.doc_id for r in quality.quality_rules(docs).filter("kept").collect()}
    assert got == {r[0] for r in rows() if r[0] < 400 or r[0] >= 600}


def test_dedup_stage(spark, docs):
    got = sorted(r.doc_id for r in cp.dedup(spark, docs, "").collect())
    want = classes([(r[0], r[1]) for r in rows()])
    assert got == sorted(d for d, c in want.items() if d == c)


def test_personal_stage(spark, docs):
    got = {r.doc_id: r for r in cp.personal_data(spark, docs, "").collect()}
    for d, text, *_ in rows():
        want = text if text is None or not plain_spans(text) else text.replace(text[plain_spans(text)[0][1] : plain_spans(text)[0][2]], "<EMAIL>")
        assert got[d].text == want and got[d].n_chars == (None if text is None else len(want))


def test_mixing_stage(spark, docs):
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(docs).collect()}
    got = {}
    for r in cp.mixing(spark, docs, "").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {d: n for d, n in copies.items() if n}


def test_odd_rows_pass_every_stage(spark):
    docs = spark.createDataFrame(odd_rows(), DOC)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0
        out.collect()
    assert cp.tokens(spark, docs, "").count() == len(odd_rows())


def test_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() > 100


def queries_and_tables(spark, monkeypatch, run):
    """How many queries run() has Spark execute, and how many of them write an intermediate table."""

    def number():
        spark.range(1).count()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark._jsparkSession.sharedState().statusStore().executionsList().last().executionId()

    written, write = [], workspace.materialize
    monkeypatch.setattr(workspace, "materialize", lambda df, name: (written.append(name), write(df, name))[1])
    first = number()
    run()
    queries = number() - first - 1
    monkeypatch.setattr(workspace, "materialize", write)
    return queries, len(written)


def test_components_ask_nothing_beside_their_rounds(spark, monkeypatch):
    """The driver keeps every query that ran and its plan; counts of a round come with its writing."""
    edges = workspace.materialize(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long"), "chain")
    queries, tables = queries_and_tables(spark, monkeypatch, lambda: connected_components(edges))
    assert queries == tables > 2
    assert {(r.node, r.component) for r in connected_components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    none = edges.filter("a < 0")
    assert queries_and_tables(spark, monkeypatch, lambda: connected_components(none)) == (1, 1) and connected_components(none).count() == 0


def test_a_step_of_the_estimate_is_two_queries(spark, docs, monkeypatch):
    monkeypatch.setattr(quality, "SETTLED", -1.0)  # all steps run
    took = []
    for steps in (1, 3):
        monkeypatch.setattr(quality, "STEPS", steps)
        took.append(queries_and_tables(spark, monkeypatch, lambda: quality.quality_rules(docs)))
    assert took[1][0] - took[0][0] == took[1][1] - took[0][1] == 4


def test_texts_stay_where_they_lie(spark, docs):
    """Verdicts and copies go to the texts, also where Spark itself would not broadcast a table; so the shuffle grows with the ids, not in a step."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stage in (cp.dedup, cp.mixing):
            plan = stage(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
            assert "Broadcast" in plan and "Exchange hashpartitioning" not in plan, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shared_rows():
    """Rows that share doc_id, size and place: in one source, in two sources, and with a null id; source sizes differ."""
    rng = random.Random(5)
    out = [(7, prose(10, rng), "a") for _ in range(9)] + [(7, prose(10, rng), "b") for _ in range(4)] + [(None, prose(12, rng), s) for s in "bcccc"]
    out += [(i, prose(10, rng), s) for i, s in enumerate("aabbbcccc" * 4, 100)] + [(300 + i, prose(25, rng), None) for i in range(60)] + [(400, None, "a"), (401, " ", "c")]
    return [(d, t, "en", s, len(t or "")) for d, t, s in out]


def mixed(spark, docs):
    return Counter((r.doc_id, r.text, r.source) for r in cp.mixing(spark, docs, "").collect())


def test_mixing_of_rows_that_share_an_id(spark):
    docs = spark.createDataFrame(shared_rows(), COLUMNS)
    size = Counter()
    for _, t, _, s, _ in shared_rows():
        size[s] += len((t or "").split())
    assert len(set(size.values())) == len(size)
    want = Counter()
    for r in mixing.mix_sources(docs).collect():
        want[r.doc_id, r.size, r.source_size] += r.copies
    got = Counter()
    taken = mixed(spark, docs)
    for (d, t, s), n in taken.items():
        got[d, len(t.split()), size[s]] += n
    assert got == +want
    assert mixed(spark, docs.repartition(7)) == taken
    own = sorted(t for d, t, _, s, _ in shared_rows() if d == 7 and s == "a")
    copies = [taken[7, t, "a"] for t in own]
    assert copies == sorted(copies, reverse=True) and copies[0] - copies[-1] == 1  # the cut lies among them


def test_stages_beyond_their_broadcasts(spark, docs, monkeypatch):
    shared = docs.unionByName(docs.filter("doc_id < 5")).unionByName(spark.createDataFrame(shared_rows(), COLUMNS)).cache()
    run = lambda: (mixed(spark, shared), Counter(r.doc_id for r in cp.dedup(spark, shared, "").collect()))
    few = run()
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert run() == few

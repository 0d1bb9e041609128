"""Katz scores, the filter audit and ranked search against plain versions, and on odd rows."""

import itertools
import math
import random
import re
import tracemalloc
import types
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_operators import DOC, odd_rows, prose

from lexiloom.llm import filter_audit, katz, lexical

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_DOC = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


# Katz backoff


class PlainKatz:
    def __init__(self, rows):
        self.uni, self.bi = Counter(), Counter()
        for d, t in rows:
            if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
                ts = self.tokens(t)
                self.uni.update(ts)
                self.bi.update(zip(["<s>", *ts[:-1]], ts))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.e, self.d = self.discounts(self.uni), self.discounts(self.bi)
        self.p1 = {c: r * self.e.get(r, 1) / (self.n + 1) for c, r in self.uni.items()}
        self.unknown = 1 - math.fsum(self.p1.values())
        after = defaultdict(dict)
        for (b, c), r in self.bi.items():
            after[b][c] = r
        self.p2 = {b: {c: r * self.d.get(r, 1) / (sum(x.values()) + 1) for c, r in x.items()} for b, x in after.items()}
        self.alpha = {b: (1 - math.fsum(x.values())) / (1 - math.fsum(self.p1[c] for c in x)) for b, x in self.p2.items()}

    @staticmethod
    def tokens(text):
        return [*WORD.findall((text or "").translate(LOWER)), "</s>"]

    @staticmethod
    def discounts(counts):
        n = Counter(counts.values())
        out = {}
        for r in range(1, 6):
            tail = 6 * n[6] / n[1] if n[1] else 0
            if n[1] and n[r] and tail != 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
                out[r] = d if 0 < d < 1 else 1
        return out

    def p(self, b, c):
        return self.p2.get(b, {}).get(c) or self.alpha.get(b, 1.0) * self.p1.get(c, self.unknown)

    def score(self, text):
        ts = self.tokens(text)
        return sum(math.log10(self.p(b, c)) for b, c in zip(["<s>", *ts[:-1]], ts))


def zipf_rows(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    pick = lambda k: " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, [1 / (i + 1) for i in range(4000)], k=k))
    return [(i, pick(rng.randint(0, 60))) for i in range(n)]


def check_katz(df, rows):
    plain = PlainKatz(rows)
    got = katz.score_documents(df).collect()
    assert len(got) == len(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((d, len(plain.tokens(t)), t) for d, t in rows), key=key)
    for r, (d, n, _) in zip(sorted(got, key=lambda r: key((r.doc_id, r.n_tokens))), want):
        assert (r.doc_id, r.n_tokens, r.train_tokens) == (d, n, plain.n)
        assert r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 7 == 2)
    scores = lambda rows: sorted(round(x, 5) for x in rows)
    assert scores(r.score for r in got) == pytest.approx(scores(plain.score(t) for _, t in rows), abs=2e-5)
    base = [sum(math.log10((plain.uni[c] + 1) / (plain.n + plain.v + 1)) for c in plain.tokens(t)) for _, t in rows]
    assert scores(r.base_score for r in got) == pytest.approx(scores(base), abs=2e-5)
    assert sorted(r.n_known for r in got) == sorted(sum(plain.uni[c] > 0 for c in plain.tokens(t)) for _, t in rows)
    return plain, got


def test_katz_equals_plain_model(spark):
    rows = zipf_rows(400)
    plain, _ = check_katz(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)
    assert any(d < 1 for d in plain.d.values()) and any(d < 1 for d in plain.e.values())
    for b in ["<s>", "w0", "w7", "w99", "never seen"]:  # exact normalisation, with one place for all unknown words
        assert math.fsum(plain.p(b, c) for c in [*plain.uni, "unknown"]) == pytest.approx(1, abs=1e-9)


def test_katz_probabilities_sum_to_one():
    """The function that scores tokens, over the whole vocabulary after one word."""
    model = katz.Model(100, 4, 10, np.array([1, 0.5, 0.7, 1, 1, 1]), np.array([1, 0.4, 0.6, 1, 1, 1]), 100 - 0.5)
    word, pair = np.array([60, 38, 1, 1, 0]), np.array([20, 1, 0, 0, 0])
    assert word.sum() == 100 and model.known == 99.5 - 0.5 + 0.5
    model.known = float(katz.discounted(word, model.words).sum())
    p1 = np.append(katz.discounted(word[:4], model.words) / 101, model.unknown)
    seen = pair > 0
    alpha = (1 - katz.discounted(pair, model.pairs).sum() / 22) / (1 - p1[seen].sum())
    p = 10 ** katz.log_probability(model, pair, word, np.full(5, 21), np.full(5, alpha))
    assert p.sum() == pytest.approx(1, abs=1e-12)


def test_katz_frequent_words_and_parts(spark, monkeypatch):
    """Frequent second words are dealt by pairs; many small parts give the same scores."""
    rows = [(i, "the cat sat on the mat " * 3 + t) for i, t in zipf_rows(120, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_katz(df, rows)
    monkeypatch.setattr(katz, "PART_TOKENS", 400)
    monkeypatch.setattr(katz, "BATCH_BYTES", 2000)
    check_katz(df.repartition(5), rows)


def katz_batches(texts, rows, monkeypatch):
    """Record batches of ``rows`` texts, as a task reads them."""
    monkeypatch.setattr(katz.TaskContext, "get", lambda: types.SimpleNamespace(partitionId=lambda: 0))
    for i in range(0, len(texts), rows):
        some = texts[i : i + rows]
        yield pa.RecordBatch.from_pydict({"doc_id": list(range(i, i + len(some))), "text": some, "held": [False] * len(some)})


def test_katz_memory_of_batches(monkeypatch):
    """One batch's arrays are let go before the next is made: at most 80 bytes a token at any time."""
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.zipf(1.2, 1000) % 200_000)) for _ in range(3600)]
    most = 1000 * max(b.num_rows for x in katz_batches(texts, 1200, monkeypatch) for b in katz.slices(x, limit=katz.BATCH_BYTES))
    for step in (katz._ask, katz._hold):
        list(step(20, katz.hot_words([], [], 20))(katz_batches(texts[:1], 1, monkeypatch)))  # tables of powers
        batches = iter(list(katz_batches(texts, 1200, monkeypatch)))
        tracemalloc.start()
        try:
            n = sum(r.num_rows > 0 for r in step(20, katz.hot_words([], [], 20))(batches))
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert n > 2 and peak < 80 * most, (peak, most)


def test_katz_parts_are_bounded(monkeypatch):
    """A word with 1/80 of all tokens, many times what a part should hold, is dealt to several parts."""
    monkeypatch.setattr(katz, "PART_TOKENS", 1000)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"{'often' if i % 80 == 79 else x}" for i, x in enumerate(rng.integers(0, 10**9, 4000))) for _ in range(100)]
    tokens = [t for x in katz_batches(texts, 10, monkeypatch) for t in katz._tokens(x)[0].view(np.int64)]
    counts = Counter(tokens)
    parts = -(-len(tokens) // katz.PART_TOKENS)
    frequent = [w for w, n in counts.items() if n * katz.SPLIT > katz.PART_TOKENS]
    hot = katz.hot_words(frequent, [counts[w] for w in frequent], parts)
    assert len(frequent) == 1 and counts[frequent[0]] == 5000
    asked, where = Counter(), defaultdict(set)
    for r in katz._ask(parts, hot)(katz_batches(texts, 10, monkeypatch)):
        for p, c, runs, b in zip(*(r.column(k).to_pylist() for k in ("p", "c", "runs", "b"))):
            asked[p] += len(katz.unpack(b))
            for x, first in zip(np.repeat(katz.unpack(c), katz.unpack(runs).astype(int)), katz.unpack(b)):
                where[x, first].add(p)
    assert max(asked.values()) < 2 * katz.PART_TOKENS
    assert all(len(p) == 1 for p in where.values())  # a pair is always counted in one part


def test_katz_odd_rows(spark, odd, none):
    check_katz(odd, [(r[0], r[1]) for r in odd_rows()])
    assert katz.score_documents(none).collect() == []
    left_out = next(d for d in itertools.count() if zlib.crc32(str(d).encode()) % 7 == 2)
    only = katz.score_documents(spark.createDataFrame([(left_out, "a b")], "doc_id long, text string")).collect()
    assert [(r.train_tokens, r.n_known, r.n_tokens, r.score, r.base_score) for r in only] == [(0, 0, 3, 0.0, 0.0)]


def test_katz_packed_numbers():
    for x in ([], [0], [3, 255], [256, 1], [70_000], [2**40, 0], [2**64 - 1, 7]):
        assert katz.unpack(katz.pack(np.array(x, np.uint64))).tolist() == x


def test_katz_refuses_other_batches():
    t = katz._rows(katz._HELD, 1, kind=pa.array([0]), batch=pa.array([0]), at=pa.array([3]), ids=pa.array([[1]]), sizes=pa.array([katz.pack(np.array([2]))]), tok=pa.array([katz.pack(np.array([0, 1]))]))
    a = katz._rows(katz._HELD, 1, kind=pa.array([1]), batch=pa.array([0]), at=pa.array([0]), **{c: pa.array([katz.pack(np.array([1, 1]))]) for c in ("ns", "cs", "runs")})
    with pytest.raises(ValueError, match="not read as before"):
        katz._score(katz.Model(2, 2, 1, np.ones(6), np.ones(6)))(pa.concat_tables([t, a]))


# filter audit


def plain_masks(rows):
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    out = []
    for d, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and d > first[t]]
        out.append((s or "", d, fails))
    return out


def plain_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    out = {}
    masks = plain_masks(rows)
    for part in {m[0] for m in masks}:
        here = [m for m in masks if m[0] == part]
        first_to_fall = Counter(next((f for f in o if m[2][f]), None) for m in here for o in itertools.permutations(range(5)))
        for o in itertools.permutations(range(5)):
            left = here
            for step, f in enumerate(o):
                gone = [m for m in left if m[2][f]]
                left = [m for m in left if not m[2][f]]
                fails = [m for m in here if m[2][f]]
                out[part, "".join("ABCDE"[i] for i in o), step + 1] = (
                    len(left), len(gone), len(fails) - len(gone), sum(sum(m[2]) == 1 for m in fails), sum(m[1] in good for m in gone), sum(m[1] in toxic for m in gone), first_to_fall[f],
                )
    return out


def audited(df, labels):
    rows = filter_audit.filter_audit(df, labels).collect()
    assert all(r.filter == r.filter_order[r.step - 1] for r in rows)
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


def audit_rows(seed=1):
    rng = random.Random(seed)
    texts = [prose(rng.choice([10, 49, 50, 51, 90]), rng) for _ in range(25)]
    texts += [" ".join(rng.choices(["a", "b", "c", "d"], k=60)), "HELLO WORLD " + prose(60, rng), prose(60, rng).upper(), prose(70, rng) + " # 5", None, "", "A" * 20 + "b" * 380]
    rows = [(i, rng.choice(texts), rng.choice(["x", "y", "big", "big", "big", None, ""])) for i in range(300)]
    rng.shuffle(rows)
    return [*rows, rows[0], (None, texts[0], "x"), (None, texts[0], "x")]


LABEL = "doc_id long, quality int, toxic int, text string, part string"


def test_audit_equals_plain_loops(spark):
    rows = audit_rows()
    rng = random.Random(2)
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "t", "p") for d in range(0, 320, 2)] + [(4, 1, 1, "t", "p"), (4, 0, 0, "t", "p"), (None, 1, 1, "t", "p")]
    got = audited(spark.createDataFrame(rows, PLAIN_DOC).repartition(4), spark.createDataFrame(labels, LABEL))
    want = plain_audit(rows, [x[:3] for x in labels if x[0] is not None])
    assert got == want and len(got) == 600 * 4  # '' and null are one part
    for part in {k[0] for k in got}:  # Shapley values of the filters add up to all that goes, over all orders
        total = {v[6] for k, v in got.items() if k[0] == part and k[2] == 1}
        assert sum({k[1][0]: v[6] for k, v in got.items() if k[0] == part and k[2] == 1}.values()) == 120 * sum(got[part, "ABCDE", s][1] for s in range(1, 6)), total


def test_parity_sums_invert_exactly(spark):
    rng = random.Random(5)
    masks = [(rng.randrange(32), "a") for _ in range(500)] + [(31, "b")]
    df = spark.createDataFrame(masks, "mask int, part string")
    rows = filter_audit.parity_sums(df, ["part"]).select("part", "walsh", filter_audit.invert(filter_audit.F.col("walsh")).alias("cells")).collect()
    for r in rows:
        own = [m for m, p in masks if p == r.part]
        assert r.walsh == [sum((-1) ** bin(m & s).count("1") for m in own) for s in range(32)]
        assert r.cells == [own.count(m) for m in range(32)]


def test_audit_odd_rows(spark, odd, none):
    no_labels = spark.createDataFrame([], LABEL)
    rows = [(r[0], r[1], r[3]) for r in odd_rows()]
    assert audited(odd, no_labels) == plain_audit(rows, [])
    assert audited(none, no_labels) == {}


# ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(rows, items, top=10):
    docs = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in rows]
    n_docs, n_terms = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        scores = []
        for d, c in docs:
            m = 10 + (90 * sum(c.values()) * n_docs) // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, k + 1, None if missing else d, -s) for k, (s, missing, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def searched(docs, items, **more):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in lexical.ranked_search(docs, items, **more).collect()), key=str)


def search_rows(n, seed=7):
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(200)]
    return [(i, "/".join(rng.choices(words, [1 / (k + 1) for k in range(200)], k=rng.randint(0, 40)))) for i in range(n)], rng, words


@pytest.mark.parametrize("limit, window", [(2_000_000, 512), (300, 4)])
def test_search_equals_plain_scores(spark, monkeypatch, limit, window):
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", limit)
    monkeypatch.setattr(lexical, "WINDOW", window)
    rows, rng, words = search_rows(600)
    rows += [(1000 + i, rows[3][1]) for i in range(15)]  # ties
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(30)] + [(50, rows[3][1]), (51, "unheard of"), (52, None), (53, "T1, t2!T2"), (53, "t9")]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    want = plain_search(rows, items)
    assert searched(docs, asked) == want
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 7)
    assert searched(docs, asked) == want


def test_wand_skips_documents():
    """A rare term that ten documents hold often: after these, documents with frequent terms alone are passed over."""
    rng = random.Random(1)
    rows = [(i, "rare " * 8 if i < 12 else " ".join(rng.choices(["a", "b", "c"], k=20)) + (" rare" if i % 500 == 0 else "")) for i in range(5000)]
    _, terms, wanted = lexical.query_terms([(1, "rare a b c")])
    batch = next(lexical._postings(terms)(iter([pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})])))
    df = np.bincount(batch.column("terms").flatten().to_numpy(), minlength=len(terms))
    weight = np.floor(1000 * np.log((2 * 5000 + 2) / (2 * df + 1))).astype(np.int64)
    shard = lexical._shard([batch], weight, 5000, sum(batch.column("n").to_pylist()))
    heap = lexical.Heap(10)
    assert shard.search(wanted[0], heap, window=64) < 200
    assert heap.ids == list(range(10))


def test_search_odd_rows(spark, odd, none):
    items = [(1, "one two"), (None, prose(5)), (2, ""), (3, "éè"), (4, "x" * 200_000)]
    asked = spark.createDataFrame([(*i, 1, "s") for i in items], "item_id long, text string, doc_id int, score string")
    assert searched(odd, asked) == plain_search([(r[0], r[1]) for r in odd_rows()], items)
    assert searched(none, asked) == [] and searched(odd, asked.limit(0)) == []

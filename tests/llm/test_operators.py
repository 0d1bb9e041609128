"""The operators against plain versions, and on odd rows."""

import gzip
import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lexiloom.llm import bpe, chat, extraction, mixing, neardup, privacy, quality, tagger, toxicity, voronoi, warc

RNG = random.Random(4)
VOCAB = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 6))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def change(text, share, rng=RNG):
    return " ".join(rng.choice(VOCAB) if rng.random() < share else w for w in text.split())


DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, kept string, copies int, rep long, _1 string"


def odd_rows():
    rng = random.Random(11)
    base = prose(120, rng)
    rows = [
        (1, base), (2, base), (2, base), (3, change(base, 0.02, rng)), (4, None), (5, ""), (6, "  \t\n "), (None, base), (None, None), (7, "one two"), (8, "One TWO"),
        (9, prose(30_000, rng)), (10, "x" * 200_000), (11, "a@b.example " * 60), (12, "\n".join([prose(12, rng)] * 20)), (13, prose(80, rng) + " ### %% $$"), (14, "éè \U0001f642 " * 80),
    ]
    out = []
    for i, (d, t) in enumerate(rows):
        out.append((d, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None if i % 3 else i, i, "k", "no", i, i, "c"))
    return out


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


# mixing


def water(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, live, out = sum(sizes.values()), set(names), {}
    while live:
        total = sum(w[s] for s in live)
        over = [s for s in live if left * w[s] / total > cap * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * w[s] / total for s in live}
        for s in over:
            out[s] = cap * sizes[s]
            live.discard(s)
        left = sum(sizes.values()) - sum(out.values())
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mixing_meets_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, prose(rng.randint(0, 40), rng) if rng.random() < 0.95 else None, rng.choice(["a", "b", "c", "big", "big", "big", None])) for i in range(400)]
    rows.append((1000, prose(5, rng), "tiny"))
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    again = mixing.mix_sources(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    source = {r[0]: r[2] for r in rows}
    sizes, taken, target, least = {}, {}, {}, {}
    for r in got:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        least[s] = min(least.get(s, 1000), r.size or 1000)
        assert r.taken <= 3 * r.size and r.size == len(re.findall(r"[^\x20\x09-\x0D]+", next(x[1] for x in rows if x[0] == r.doc_id) or ""))
    want = water(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= least[s]
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))


@pytest.mark.parametrize("first", [0, 10**4, 10**6])
def test_mixing_one_very_long_document(spark, first):
    """Whatever the order of ids, small documents fill what a long one leaves."""
    from pyspark.sql import functions as F

    text = F.when(F.col("id") == 5000, F.repeat(F.lit("w "), 50_000)).otherwise(F.repeat(F.lit("w "), 10))
    one = spark.range(5001).select((F.col("id") + first).alias("doc_id"), text.alias("text"), F.lit("a").alias("source"))
    other = spark.range(10).select((F.col("id") + 9 * 10**8).alias("doc_id"), F.repeat(F.lit("v "), 10_000).alias("text"), F.lit("b").alias("source"))
    got = mixing.mix_sources(one.unionByName(other)).filter("source_size = 100000 and doc_id < 900000000").groupBy().agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).first()
    assert got.target == pytest.approx(200_000 / 3) and abs(got.taken - got.target) <= 10 and got.most == 1


def test_mixing_many_of_one_size(spark, monkeypatch):
    """Thousands of documents of one size, and of one id: the boundary is found slice by slice."""
    monkeypatch.setattr(mixing, "SLICES", 4)
    rows = [(i, "a b", "x") for i in range(3000)] + [(7, "c d e", "x")] * 50 + [(i, "f g h i", "y") for i in range(4000, 4300)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    x = [r for r in got if r.source_size == 6150]
    assert len(got) == len(rows) and abs(sum(r.taken for r in x) - x[0].target) <= 2
    assert 0 < sum(r.copies for r in x if r.size == 3) < 50


def test_mixing_odd_rows(odd, none):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == len(odd_rows()) and all(r.taken == r.copies * r.size <= 3 * r.size for r in got)
    assert mixing.mix_sources(none).count() == 0


# near duplicates


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def classes(rows):
    ids = sorted({d for d, _ in rows if d is not None})
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    return {d: find(d) for d in ids}


def test_near_duplicates_match_brute_force(spark):
    rows, n = [], itertools.count()
    for _ in range(12):
        first = prose(RNG.randint(3, 150))
        rows += [(next(n), change(first, RNG.choice([0, 0, 0.01, 0.02, 0.03, 0.05, 0.2]))) for _ in range(RNG.randint(1, 14))]
    passage = prose(50)
    rows += [(next(n), prose(20) + " " + passage + " " + prose(30)) for _ in range(40)]
    RNG.shuffle(rows)
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = classes(rows)
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.n_shingles == len(shingles(dict(rows)[d])) and r.kept == (d == want[d]) for d, r in got.items())


def test_near_duplicates_odd_rows(odd, none):
    got = neardup.near_duplicates(odd).collect()
    want = classes([(r[0], r[1]) for r in odd_rows()])
    assert len(got) == len(odd_rows())
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert neardup.near_duplicates(none).count() == 0


def test_rows_of_one_document_bring_their_links_together(spark, monkeypatch):
    a, b, c = prose(40), prose(40), prose(40)
    rows = [(3, a), (5, a), (5, b), (9, b), (9, ""), (11, c), (12, c), (12, None), (20, "")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(3, 3, True), (5, 3, False), (9, 3, False), (11, 11, True), (12, 11, False), (20, 20, True)}


def test_buckets_of_several_blocks(spark, monkeypatch):
    rng = random.Random(31)
    passage = prose(60, rng)
    rows = [(i, change(passage, rng.choice([0.01, 0.03, 0.05, 0.08]), rng)) for i in range(150)]
    want = classes(rows)
    monkeypatch.setattr(neardup, "MEET", 8)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 300)
    for bound in (100_000, 0):
        monkeypatch.setattr(neardup, "BROADCAST_BUCKETS", bound)
        assert {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_block_links_are_those_of_all_pairs():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 60, (40, 30))
    sets = [(int(i % 7), np.unique(p[: rng.integers(10, 30)])) for i, p in enumerate(pool)] + [(99, np.unique(pool[0]))] + [(98, np.unique(pool[0]))]
    want = {(a, b) for a, x in sets for b, y in sets if a != b and 100 * len(np.intersect1d(x, y)) >= 60 * len(np.union1d(x, y))}
    assert neardup.block_links(sets, sets, 60) == want


# tokens


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_agrees_with_the_library(odd, none, reference):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    made = bpe.encode_documents(odd, path, public_tokenizers.PATTERN, with_ids=True)
    rows = made.collect()
    assert len(rows) == len(odd_rows())
    want = sorted((str(d), hashlib.sha256(np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in odd_rows() if len(t or "") < 50_000)
    got = sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in rows if r.doc_id not in (9, 10))
    assert got == [w for w in want if w[0] not in ("9", "10")]
    back = {r.doc_id: r.text for r in bpe.decode_ids(made, path, public_tokenizers.PATTERN).collect() if r.doc_id is not None}
    assert all(back[d] == (t or "") for d, t, *_ in odd_rows() if d is not None)
    assert bpe.encode_documents(none, path, public_tokenizers.PATTERN).count() == 0


def test_merge_order_is_leftmost_least_rank(reference):
    ranks = reference._mergeable_ranks
    for _ in range(300):
        piece = "".join(RNG.choice("abeénst 0\n\U0001f642") for _ in range(RNG.randint(1, 60))).encode()
        assert bpe.merge_piece(piece, ranks) == reference._core_bpe.encode_single_piece(piece)


# quality


def plain_statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 3)} if len(w) < 3000 else None
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), None if covered is None else len(covered)


def test_quality_counts_and_verdicts(odd, none):
    rows = quality.quality_rules(odd).collect()
    assert len(rows) == len(odd_rows())
    texts = {r[0]: r[1] for r in odd_rows() if r[0] is not None}
    for r in rows:
        if r.doc_id is not None:
            want = plain_statistics(texts[r.doc_id])
            got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert got[:4] == want[:4] and want[4] in (None, got[4])
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality.quality_rules(none).count() == 0


def test_robust_estimate_ignores_outliers():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (600, 5)), rng.normal(12, 0.1, (250, 5))])
    mean, _ = quality.fit_sample(x)
    assert np.abs(mean).max() < 0.3


def test_quality_rejects_symbol_rubbish(spark):
    rng = random.Random(8)
    clean = [(i, prose(rng.randint(60, 300), rng), "en", "a" if i % 2 else "b") for i in range(400)]
    rubbish = [(1000 + i, " ".join(w + "###" for w in prose(100, rng).split()), "en", "a") for i in range(60)]
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(clean + rubbish, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i, *_ in clean) and not any(got[i] for i, *_ in rubbish)


def plain_verdicts(rows):
    """Squared distances of (n_words, word_chars, n_symbols, n_dup_lines, n_repeats) rows of one group that is the whole table, by a
    plain FAST-MCD over all rows, and by its diagonal alone."""
    c = np.array(rows, float)
    n, counts = c[:, 0], c[:, 2:]
    m = np.median(np.log(c[:, 1] / n))
    x = [20 * n**quality.POWER, np.sqrt(n) * (np.log(c[:, 1] / n) - m)]
    for i, power in enumerate(quality._RATES.values()):
        order = np.argsort(np.sqrt(counts[:, i] / n**power), kind="stable")
        weight = n[order] ** power
        low = order[np.cumsum(weight) - weight < quality.USUAL * weight.sum()]
        rate = counts[low, i].sum() / (n[low] ** power).sum()
        x.append(2 * (np.sqrt(counts[:, i] + 0.375) - np.sqrt(rate * n**power + 0.375)))
    x = np.stack(x, axis=1)
    plain, w = np.cov(x.T, bias=True), len(x) / (len(x) + quality.SHRINK)
    ridge = lambda s: quality._regular(w * s + (1 - w) * (w * s + (1 - w) * plain))  # a group is drawn to all rows, and these to plain

    def distance(mean, cov):
        return np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)

    mean, cov = quality.fit_sample(x)
    cov = cov * quality.consistency(quality.COVERAGE)
    for _ in range(30):
        half = np.argsort(distance(mean, ridge(cov)))[: -(-len(x) // 2)]
        mean, cov = x[half].mean(axis=0), np.cov(x[half].T, bias=True) * quality.consistency(quality.COVERAGE)
    for _ in range(quality.REWEIGHTS):
        inner = distance(mean, ridge(cov)) <= quality.chi2_quantile(quality.WITHIN, 5)
        mean, cov = x[inner].mean(axis=0), np.cov(x[inner].T, bias=True) * quality.consistency(quality.WITHIN)
    return distance(mean, ridge(cov)), distance(mean, np.diag(np.diag(ridge(cov))))


def test_quality_matches_a_plain_estimate_whose_covariance_decides(spark):
    rng = random.Random(21)
    word = lambda k: "".join(rng.choice("abcdefghijklmnop") for _ in range(k))
    text = lambda n, length: " ".join(word(max(1, round(rng.gauss(length, 1.5)))) for _ in range(n))
    sizes = [int(60 * 1.01 ** rng.uniform(0, 250)) for _ in range(500)]
    long_words = lambda n: 5 + 0.9 * np.log(n / 200) / 1.25  # longer texts have longer words
    rows = [text(n, long_words(n)) for n in sizes]
    odd_ones = [text(90, long_words(500)) for _ in range(8)] + [text(450, long_words(70)) for _ in range(8)]
    rows += odd_ones + [text(100, 5).replace(" ", "# ") for _ in range(5)]
    got = quality.quality_rules(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string")).orderBy("doc_id").collect()
    d, diagonal = plain_verdicts([(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, 0) for r in got])
    limit = quality.chi2_quantile(1 - quality.TAIL, 5)
    assert not any(r.base_failed or r.n_repeat_words for r in got)
    assert not [(r.doc_id, r.distance, x) for r, x in zip(got, d, strict=True) if abs(x / limit - 1) > 0.1 and r.kept != (x <= limit)]
    assert np.corrcoef(d, [r.distance for r in got])[0, 1] > 0.99
    odd_at = range(500, 516)
    assert sum(not got[i].kept for i in odd_at) > 8 and sum(diagonal[i] > limit for i in odd_at) < sum(not got[i].kept for i in odd_at)
    assert sum(r.kept for r in got[:500]) > 490 and not any(r.kept for r in got[516:])


# personal data

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(t):
    def fits(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": all(int(x) <= 255 for x in s.split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and tagger.luhn(d or "1"), "phone": 8 <= len(d) <= 15}[kind]

    return [(k, *m.span()) for k, p in KINDS.items() for m in re.finditer(p, t) if fits(k, m.group())]


def test_base_spans_match_the_patterns():
    rng = random.Random(3)
    bits = ["1.2", "3", "4.", "5", "+1", "@", "a.b", "-", " ", "(", "99", "300.", "4111111111111111", "x", "é", "\n", "_%"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
        assert privacy.base_spans(t) == plain_spans(t), t


def test_tagger_on_held_out_windows():
    rng = random.Random(99)
    rows = [labelled for labelled in (tagger.labelled_window(rng) for _ in range(300))]
    tags = tagger.decode(tagger.train(), np.stack([tagger.codes(t) for t, _ in rows]))
    found = [(set(tagger.tag_spans(y)), set(s)) for (_, s), y in zip(rows, tags, strict=True)]
    hit = sum(len(a & b) for a, b in found)
    assert hit / sum(len(a) for a, _ in found) > 0.85 and hit / sum(len(b) for _, b in found) > 0.85


def test_added_spans_on_held_out_windows_are_right():
    rng = random.Random(77)
    rows = [tagger.labelled_window(rng) for _ in range(500)]
    right = added = missed = 0
    for (own, every), (_, labelled) in zip(privacy.find_spans([t for t, _ in rows], tagger.train()), rows, strict=True):
        more, gold = set(every) - set(own), set(labelled) - set(own)
        right, added, missed = right + len(more & gold), added + len(more), missed + len(gold)
    assert right / added > 0.93 and right / missed > 0.7


def test_regions_lose_no_span_of_whole_texts():
    rng = random.Random(78)
    texts = [prose(rng.randint(20, 200), rng) + " " + tagger.labelled_window(rng)[0] + " " + prose(rng.randint(20, 200), rng) for _ in range(40)]
    near, whole = (privacy.find_spans(texts, tagger.train(), regions=r) for r in (True, False))
    found = lambda out: {(i, s) for i, (_, every) in enumerate(out) for s in every}
    assert len(found(whole) - found(near)) <= 0.05 * len(found(whole)) and found(whole)


def test_undecoded_windows_hold_no_span():
    rng = random.Random(79)
    texts = [prose(rng.randint(20, 200), rng) + " " + tagger.labelled_window(rng)[0] + " write to maria at example.com " + prose(rng.randint(20, 200), rng) for _ in range(20)]
    model = tagger.train()
    assert privacy.find_spans(texts, model) == privacy.find_spans(texts, model, regions=False)
    assert all(privacy.may_hold(x) for x in ("maria at example.com", "1.2.3.4", "+1 234 56789")) and not privacy.may_hold("12 of 345 at home")


def test_weights_are_kept_in_the_shared_folder(spark, monkeypatch):
    first = privacy.saved_model(spark)
    monkeypatch.setattr(privacy, "train", None)
    again = privacy.saved_model(spark)
    assert first.keys() == again.keys() and all((first[k] == again[k]).all() for k in first)


def test_personal_data_odd_rows(odd, none):
    rows = privacy.find_personal_data(odd).collect()
    assert len(rows) == len(odd_rows())
    texts = {r[0]: r[1] or "" for r in odd_rows() if r[0] is not None}
    for r in rows:
        if r.doc_id is not None:
            own = plain_spans(texts[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in own).encode()).hexdigest()
            assert {f"{k}:{a}:{b}" for k, a, b in own} <= set(r.spans.split(","))
    masked = privacy.find_personal_data(odd, masked=True)
    assert masked.columns == odd.columns and masked.count() == len(odd_rows())
    assert privacy.find_personal_data(none).count() == 0 and privacy.find_personal_data(none, masked=True).count() == 0


def test_tagger_adds_a_phone_and_card_that_the_patterns_merge():
    text = "call +1 (269) 555-3296 4524132264652876 and more"
    (own, everything), = privacy.find_spans([text], tagger.train())
    assert own == [] and {k for k, _, _ in everything} == {"card", "phone"}
    assert privacy.mask(text, everything) == "call <PHONE> <CARD> and more"


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="ad">Buy</div><article><header><h1>Head &amp; line</h1></header><p><b>One
 two<br><p>Three <i>four</i>&#33;</p><form><input>Search</form><aside>More</aside><ul><li>a <span class="share-bar">tweet <span>it</span></span> x<li>b</ul></article><div id="comments"><p>I think</p></div><div class="cookie-notice">OK?</div><footer>&copy;</footer></body>"""


def test_extraction(spark):
    rows = [(1, "http://h.example/a", PAGE), (2, None, None), (3, "x", ""), (None, "http://h.example/b", "<p>alone &lt;b&gt;"), (5, "http://h.example/c", "<div><p>text<p>more"), (5, "http://h.example/c", "<div><p>text<p>more")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, low int")
    got = [(r.page_id, r.text, r.n_chars) for r in extraction.extract_main_text(df).collect()]
    want = {1: "Head & line\nOne two\nThree four!\na x\nb", 2: "", 3: "", None: "alone <b>", 5: "text\nmore"}
    assert len(got) == 6 and all(t == want[p] and n == len(t) for p, t, n in got)
    assert extraction.extract_main_text(df.limit(0)).count() == 0


def test_style_tree_cuts_what_a_site_repeats(spark):
    rng = random.Random(5)
    pages = [(i, "http://s.example/", f"<body><div class=x1><p>Our offers</p><p>Write to us</p></div><div class=x2><p>{prose(30, rng)}</p><p>{prose(30, rng)}</p></div></body>") for i in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for r in extraction.extract_main_text(df).collect():
        assert r.text == "\n".join(re.findall(r"<p>([^<]*)</p>", pages[r.page_id][2].split("x2>")[1]))


def test_style_tree_cuts_inside_article_and_keeps_what_varies_beside_it(spark):
    rng = random.Random(6)
    own = [[prose(30, rng) for _ in range(3)] for _ in range(12)]
    pages = [(i, "http://a.example/", f"<body><article><p>{a}</p><div class=x3><p>Join our club</p></div><p>{b}</p></article><div class=x4><p>{c}</p></div><div class=x5><p>Open on Mondays</p></div></body>") for i, (a, b, c) in enumerate(own)]
    # most of a page's text stays, though all pages share it
    pages += [(100 + i, "http://same.example/", f"<body><article><div><p>{own[0][0]}</p></div></article></body>") for i in range(5)]
    got = {r.page_id: r.text for r in extraction.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join(x) for i, x in enumerate(own)} | {100 + i: own[0][0] for i in range(5)}


@pytest.mark.parametrize(
    "source,text",
    [
        ('<div class="content no-sidebar"><article><p>story text</p></article></div>', "story text"),
        ('<article><p>one</p><div data-id="related" data-class="ad"><p>two</p></div></article>', "one\ntwo"),
        ('<article><p>a <span class="share">Share<br>on social</span> b</p></article>', "a b"),
        ("<article><p>tease</p></article><div><p>" + "long story " * 20 + "end</p></div>", "tease\n" + "long story " * 20 + "end"),
        ('<article><div class="article-header"><h1>Title</h1></div><p>body</p></article>', "Title\nbody"),
        ('<article><p>the story</p></article><article class="comment"><p>I think</p></article>', "the story"),
        ("<main><article><p>story</p></article><section id=comments><p>" + "blah " * 50 + "</p></section></main>", "story"),
        ("<article><p>x<span class=share>y<p>z</article>", "x\nz"),
        ("<div>" * 20_000 + "deep" + "<p>low</p>" + "</div>" * 20_000, "deep\nlow"),
        ("<article>" + "<p>word word</p>" * 50_000 + "</article>", "\n".join(["word word"] * 50_000)),
        ("<nav>a</nav>b", "b"),
    ],
)
def test_extraction_of_single_pages(source, text):
    assert extraction.main_text(extraction.Page(source)) == text


def plain_importance(pages):
    """Importance of each path over the pages of one host."""
    shown, styles, texts = {}, {}, {}
    for page in pages:
        for path in {p for p, _ in page.styles}:
            shown[path] = shown.get(path, 0) + 1
        for path, shape in page.styles:
            styles.setdefault(path, []).append(shape)
        for i, (text, path, _) in enumerate(page.blocks):
            for p in set(path):
                texts.setdefault(p, {}).setdefault(text, []).append((id(page), i))
    entropy = lambda xs: -sum(xs.count(x) / len(xs) * np.log(xs.count(x) / len(xs)) for x in set(xs))
    out = {}
    for path, m in shown.items():
        if m > 1:
            layout = min(1.0, entropy(styles[path]) / np.log(m))
            spreads = [entropy([page for page, _ in where]) / np.log(m) for where in texts.get(path, {}).values()]
            content = 1 - min(1.0, float(np.mean(spreads))) if spreads else 1.0
        else:
            layout = content = 1.0
        by_content = extraction.GAMMA ** len(set(styles[path]))
        out[path] = (1 - by_content) * layout + by_content * content
    return out


def test_style_tree_matches_a_plain_one(spark):
    rng = random.Random(9)
    lists = lambda: "".join(f"<li>{rng.choice(VOCAB[:9])}</li>" for _ in range(rng.randint(1, 4)))
    pages = [(i, f"http://h{i % 3}.example/", f"<body><div class=menu><ul>{lists()}</ul></div><article>{'<p>' + prose(6, rng) + '</p>' * 1 * rng.randint(1, 4)}<div class=x>same</div></article><div class=z>{rng.choice('ab')}</div></body>") for i in range(24)]
    got = {(r.host, r.path): (r.pages, r.importance) for r in extraction.site_style_tree(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = {}
    for h in range(3):
        own = [extraction.Page(source) for i, _, source in pages if i % 3 == h]
        want |= {(f"h{h}.example", p): x for p, x in plain_importance(own).items()}
    assert got.keys() == want.keys() and all(got[k][1] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert len({round(x, 6) for x in want.values()}) > 6


@pytest.mark.parametrize("url,host", [("http://User@A.example:8/x", "a.example"), ("//b.example", "b.example"), (None, ""), ("/x", "")])
def test_host(url, host):
    assert extraction.host_of(url) == host


# archives


def test_arc_to_warc():
    for version in (1, 2):
        data = warc.arc_version_block(version) + warc.arc_record(version, "http://a.example/ x", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\n\nmore") + warc.arc_record(version, None, b"")
        a, b = (warc.convert(r) for r in warc.read_arc(data))
        assert a.headers["WARC-Type"] == "response" and a.headers["WARC-Target-URI"] == "http://a.example/%20x" and a.headers["WARC-Date"] == "2024-01-01T00:00:00Z"
        assert a.headers["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b"body\n\nmore").hexdigest()
        assert b.headers["WARC-Type"] == "resource" and b.block == b""
        stream = b"".join(warc.write_record(r) + b"\r\n\r\n" for r in (a, b))
        back = list(warc.read_warc(stream[i : i + 7] for i in range(0, len(stream), 7)))
        assert [r.block for r in back] == [a.block, b.block] and back[0].headers["WARC-Record-ID"] == a.headers["WARC-Record-ID"]
    with pytest.raises(ValueError):
        list(warc.read_arc(data[:-3]))


def test_archive_round_trip(spark):
    long = "<p>" + "é\r\n\r\n" * 60
    rows = [(3, "u", long), (1, None, long), (2, "v", long), (2, "v", long), (4, "w", "short"), (5, "w", "short"), (6, "", None), (None, "n", long), (7, "x y", "z" * 3_000_000)]
    df = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(map(str, (tuple(r)[:1] + (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(df).collect())))
    want = []
    for p, _, h in rows:
        body = (h or "").encode()
        again = len(body) >= 100 and p is not None and p > 1 and h == long
        want.append(str((p, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", 1 if again else None)))
    assert got == sorted(want)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_revisits_name_their_response(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SIZE_CLASSES", ((1000, 3), (5000, 2), (1 << 62, 1)))
    rows = [(i, f"http://a.example/{i % 7} é", "word " * (30 if i % 3 else 400 if i % 2 else 2000)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    warc.write_archives(pages, f"file://{tmp_path}/out")
    files = sorted((tmp_path / "out").glob("*/*.gz"))
    records = [(f.parent.name, r) for f in files for r in warc.read_warc(iter([gzip.decompress(f.read_bytes())]))]
    assert len(records) == 40 and {f.parent.name for f in files} == {"size-0", "size-1", "size-2"}
    most = {"size-0": 3, "size-1": 2, "size-2": 1}
    for f in files:
        assert len(list(warc.read_warc(iter([gzip.decompress(f.read_bytes())])))) <= most[f.parent.name]
    by_id = {r.headers["WARC-Record-ID"]: r for _, r in records}
    revisits = [r for _, r in records if r.headers["WARC-Type"] == "revisit"]
    assert len(revisits) == 37
    for r in revisits:
        first = by_id[r.headers["WARC-Refers-To"]]
        assert first.headers["WARC-Type"] == "response" and first.headers["WARC-Payload-Digest"] == r.headers["WARC-Payload-Digest"]
        assert (first.headers["WARC-Target-URI"], first.headers["WARC-Date"]) == (r.headers["WARC-Refers-To-Target-URI"], r.headers["WARC-Refers-To-Date"])
        assert f"X-Page-Id: {r.headers['WARC-Refers-To-Page']}\r\n".encode() in first.block


# toxicity


def plain_kneser_ney(rows):
    """P(w | v) of each class over the vocabulary and None, the unknown word, from (text, toxic) rows."""
    pairs, start = {0: {}, 1: {}}, object()
    for text, toxic in rows:
        words = [start, *re.findall(r"\w+", text.lower())]
        for p in set(itertools.pairwise(words)):
            pairs[toxic][p] = pairs[toxic].get(p, 0) + 1
    both = {p: pairs[0].get(p, 0) + pairs[1].get(p, 0) for p in {**pairs[0], **pairs[1]}}
    vocabulary = sorted({w for _, w in both})

    def lower(of, cut):
        left = {}
        for _, w in of:
            left[w] = left.get(w, 0) + 1
        whole = sum(left.values())
        return (lambda w: max(left.get(w, 0) - cut, 0) / whole), sum(min(n, cut) for n in left.values()) / whole

    def upper(of, cut):
        after = {}
        for (v, _), n in of.items():
            after.setdefault(v, []).append(n)
        own = lambda v, w: max(of.get((v, w), 0) - cut, 0) / sum(after[v]) if v in after else 0
        return own, (lambda v: sum(min(n, cut) for n in after[v]) / sum(after[v]) if v in after else 1)

    base, base_left = lower(both, toxicity.D0)
    s = lambda w: base(w) + base_left / (len(vocabulary) + 1)
    mid, mid_left = upper(both, toxicity.D0)
    s2 = lambda v, w: mid(v, w) + mid_left(v) * s(w)

    def of_class(c):
        low, low_left = lower(pairs[c], toxicity.D)
        tilt = lambda w: (low(w) + low_left * s(w)) / s(w)
        own, left = upper(pairs[c], toxicity.D)

        def p(v):
            tilted = {w: s2(v, w) * tilt(w) for w in [*vocabulary, None]}
            z = sum(tilted.values())
            return {w: own(v, w) + left(v) * x / z for w, x in tilted.items()}

        return p

    return of_class(0), of_class(1), start


def test_kneser_ney_matches_a_plain_one_that_sums_to_one(spark):
    rng = random.Random(12)
    few = VOCAB[:25]
    text = lambda toxic: " ".join(rng.choice(few[:6]) if rng.random() < 0.5 else "zorg" if toxic and rng.random() < 0.2 else rng.choice(few) for _ in range(rng.randint(1, 14)))
    rows = [(text(t), t) for t in [1] * 60 + [0] * 240]
    ordinary, toxic, start = plain_kneser_ney(rows)
    tables, unknown, both = toxicity.kneser_ney(spark.createDataFrame(rows, "text string, toxic int"))
    assert both
    words, contexts, pairs = ({tuple(r)[:-2]: r.ratio for r in t.collect()} for t in tables)
    hashed = lambda w: toxicity.START if w is start else int(toxicity._words(toxicity.pa.RecordBatch.from_arrays([toxicity.pa.array([w])], names=["text"]))[0].view(np.int64)[0])
    keys = {w: hashed(w) for w in [start, *few, "zorg"]}
    assert pairs and contexts and words
    for v in [start, "zorg", *few[:12], "never"]:
        o, t = ordinary(v), toxic(v)
        assert sum(o.values()) == pytest.approx(1) and sum(t.values()) == pytest.approx(1)
        for w in o:
            apart = words.get((keys.get(w),), unknown) + contexts.get((keys.get(v),), 0.0)
            assert pairs.get((keys.get(v), keys.get(w)), apart) == pytest.approx(np.log(t[w] / o[w]), abs=1e-6)


def test_toxicity_beyond_the_head_scores_alike(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-2, ""), (None, "x y")], "doc_id long, text string"))
    rows = lambda: sorted(((r.doc_id is None, r.doc_id, r.score) for r in toxicity.toxicity(docs, labels).collect()), key=str)
    whole = rows()
    monkeypatch.setattr(toxicity, "HEAD_WORDS", 40)
    monkeypatch.setattr(toxicity, "HEAD_PAIRS", 25)
    split = rows()
    assert [r[:2] for r in whole] == [r[:2] for r in split]
    assert max(abs(a[2] - b[2]) for a, b in zip(whole, split)) < 1e-6
    assert len({round(r[2], 6) for r in whole}) > 100


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1500):
        words = prose(rng.randint(20, 120), rng).split()
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["Zorg!", "blarf,", "zorg"]))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(bad), "score"))
    rows += [(2000, None, "x"), (2001, "", "x"), (None, "zorg", "x")]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (7, None, "a"), (None, 1, "b")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity(docs, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = {i: t for i, t, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 200 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert toxicity.toxicity(docs.limit(0), lab).count() == 0
    flat = toxicity.toxicity(docs, lab.limit(0)).collect()
    assert len({r.score for r in flat}) == 1


# chat


def test_chat_is_reversible(spark):
    nasty = ["\\### Assistant: </turn> ok", "\\b\\l<turn user>", "a\n</turn>\n<turn assistant>x", "", None, "<image 1>", "\\\\<>\\", "\U0001f642"]
    rows = [(c, t, r, RNG.choice(nasty)) for c in (1, 2, None) for t, r in enumerate(["user", "assistant", "user", "assistant", None, "a>b"])]
    rows += [(3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (3, None, "user", "first")]
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, at int")
    made = chat.format_conversations(df).select("conv_id", "formatted", chat.read_turns(chat.F.col("formatted")).alias("turns"), chat.read_loss_text(chat.F.col("formatted"), chat.F.col("loss_mask")).alias("loss"))
    for r in made.collect():
        mine = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (-1 if x[1] is None else x[1], x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in mine]
        assert r.loss == "".join(x[3] or "" for x in mine if x[2] == "assistant")
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_parts(spark):
    part = lambda kind, text=None, ref=None, tokens=None: (kind, text, ref, tokens)
    rows = [(1, 0, "user", [part("text", "see <"), part("image", None, "i.png"), part("text", " and "), part("audio", None, "a.wav", 42)]), (1, 1, "assistant", [part("document", None, "d.pdf"), part(None, "ok")]), (1, 2, "user", None)]
    r = chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")).first()
    assert r.formatted == "<turn user>see \\l<image 1> and <audio 2></turn>\n<turn assistant><document 3>ok</turn>\n<turn user></turn>\n"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "i.png", 576), ("audio", "a.wav", 42), ("document", "d.pdf", 1024)]
    assert r.expanded_tokens == 1642 and [(m.turn, m.start, m.length) for m in r.loss_mask] == [(1, 16, 14)]


# search


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (300, 6)), rng.normal(4, 0.3, (300, 6)), np.ones((100, 6))])
    rows = [(int(i), [float(v) for v in r], "c") for i, r in enumerate(x)]
    rows += [(900, None, "c"), (901, [1.0, None], "c"), (902, [float("nan")] * 6, "c"), (903, [float("inf")] + [0.0] * 5, "c"), (None, [1.0] * 6, "c"), (904, [], "c"), (905, [2.0, 3.0], "c"), (20, [float(v) for v in x[20]], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string")
    v = voronoi.integer_vectors(df)
    got = [tuple(r) for r in voronoi.top_k(v, v.filter("vec_id % 20 = 0"), 5).collect()]
    table = [(i, np.pad(np.floor(64 * np.array(e, float)).astype(int), (0, 6 - len(e)))) for i, e, _ in rows if i is not None and e is not None and all(z is not None and np.isfinite(z) for z in e)]
    want = []
    for q in sorted({i for i, _ in table if i % 20 == 0}):
        own = next(e for i, e in table if i == q)
        best = sorted((-int(own @ e), i) for i, e in table if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert voronoi.top_k(v.limit(0), v.limit(0), 5).count() == 0


def test_scores_are_integers_of_any_size(spark):
    big = (1 << 30) + 1
    huge = 1 << 61
    for rows, want in (
        ([(0, [big, 3]), (1, [big, 0]), (2, [big, 1]), (3, [5, 5])], [2, 1, 3]),
        ([(0, [huge, 7]), (1, [huge, 1]), (2, [huge, 2]), (3, [-huge, 0])], [2, 1, 3]),
    ):
        v = spark.createDataFrame(rows, "vec_id long, v array<long>")
        got = voronoi.top_k(v, v.filter("vec_id = 0"), 3).orderBy("rank").collect()
        assert [r.vec_id for r in got] == want
        exact = {i: sum(x * y for x, y in zip(rows[0][1], e, strict=True)) for i, e in rows}
        assert all(r.score == max(-(1 << 63), min((1 << 63) - 1, exact[r.vec_id])) for r in got)
    one = spark.createDataFrame([(20, [1, 2])], "vec_id long, v array<long>")
    assert voronoi.top_k(one, one, 3).count() == 0


def test_repeated_rows_of_a_query_do_not_hide_candidates(spark):
    rng = np.random.default_rng(5)
    rows = [(0, [1000, 1000])] * 30 + [(i, [int(a), int(b)]) for i, (a, b) in enumerate(rng.integers(-900, 900, (200, 2)), start=1)]
    v = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
    got = voronoi.top_k(v, v.filter("vec_id = 0"), 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, s) for s, i in sorted(((1000 * sum(e), i) for i, e in rows[30:]), key=lambda x: (-x[0], x[1]))[:5]]


def test_chat_parts_are_read_back(spark):
    text, image, named = ("text", "a <image 1> \\l b>\n", None, None), ("image", None, "ref", 7), ("odd <k> 2", None, "r", None)
    rows = [(1, 0, "us<er", [text, image, text, named, image]), (1, 1, "assistant", [("text", "", None, None)]), (1, 2, "assistant", [(None, "x", None, None), ("text", "<", None, None)]), (2, 0, None, None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts {chat.PARTS}")
    got = {r.conv_id: [(t.role, [tuple(p) for p in t.parts]) for t in r.turns] for r in chat.format_conversations(df).select("conv_id", chat.read_parts(chat.F.col("formatted")).alias("turns")).collect()}
    said = ("text", text[1], None)
    assert got[1] == [("us<er", [said, ("image", None, 1), said, ("odd <k> 2", None, 2), ("image", None, 3)]), ("assistant", []), ("assistant", [("text", "x<", None)])]
    assert got[2] == [("", [])]


def test_long_pieces_in_packed_arrays(reference):
    ranks = reference._mergeable_ranks
    rng = random.Random(5)
    for alphabet, n in (("abcdefghijklmnopqrstuvwxyz", 60_000), ("a", 30_000), ("éü中a", 20_000)):
        piece = "".join(rng.choice(alphabet) for _ in range(n)).encode()
        assert len(piece) >= bpe.LONG_PIECE and bpe.merge_piece(piece, ranks) == reference._core_bpe.encode_single_piece(piece)

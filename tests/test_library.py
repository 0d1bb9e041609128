"""The token library against golden rows, its SQL, and its streaming twin."""

import glob
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexiloom.functions import edits as E
from lexiloom.functions import plugins as X
from lexiloom.functions import text as T
from lexiloom.operators import candidates as C
from lexiloom.operators import early as Y
from lexiloom.operators import gates as G
from lexiloom.operators import lookups as K
from lexiloom.operators import punctuation as P
from lexiloom.operators import sessions as N
from lexiloom.operators import spelling as L
from lexiloom.plans import catalog, forms, guarded, ranked, spelled  # noqa: F401  these add their queries to the catalog
from lexiloom.plans.decisions import decide
from lexiloom.operators import events as V
from lexiloom.sources import tables as S
from lexiloom.streaming import buffers as B
from lexiloom.streaming.tokens import as_input, completed_tokens, stream_tokens

SF = "/root/testdata/sf0.001"


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_layout(spark):
    assert len(T.EN_KEYS) == len(T.RU_KEYS) == len(set(T.EN_KEYS)) == len(set(T.RU_KEYS)) == 72
    words = [("ghbdtn",), ("'nj",), ("t;br",), ("[jnm",), ("{",)]
    assert one(spark, words, "s string", T.to_russian_layout(F.col("s"))) == ["привет", "это", "ежик", "хоть", "{"]
    assert one(spark, [("привет",), ("Хлеб",)], "s string", T.to_english_layout(F.col("s"))) == ["ghbdtn", "Хkt,"]


def test_scripts_and_protection(spark):
    rows = [("",), ("abc",), ("привет",), ("aб",), ("é",), ("t;br",), (";",), (None,)]
    assert one(spark, rows, "t string", T.script(F.col("t"))) == ["Empty", "Latin", "Cyrillic", "Mixed", "Other", "Other", "Other", "Empty"]
    assert one(spark, rows, "t string", T.script_for_layout(F.col("t"))) == ["Empty", "Latin", "Cyrillic", "Mixed", "Other", "Latin", "Other", "Empty"]
    kept = ["", "GitHub", "a1", "http://x", "www.a", "a@b.c", "C:\\x", "a/b/c", "x.html", "a_b", "a-b", "camelCase", "aб", None]
    assert all(one(spark, [(k,) for k in kept], "t string", T.is_protected(F.col("t"))))
    assert not any(one(spark, [("hello",), ("Hello",), ("HELLO",), ("t;br",), ("привет",)], "t string", T.is_protected(F.col("t"))))


def test_case(spark):
    rows = [("TEH", "the", "THE"), ("teh", "The", "the"), ("Teh", "the", "The"), ("TeH", "the", "The"), ("tEh", "the", "the"), ("1", "the", "the"), ("Teh", "", "")]
    got = spark.createDataFrame(rows, "o string, c string, want string").select(T.transfer_case(F.col("o"), F.col("c")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_edit_classes(spark):
    rows = [
        ("helllo", "hello", "RepeatedAccidentalCharacter"), ("teh", "the", "AdjacentTransposition"), ("hrllo", "hello", "AdjacentKeySubstitution"), ("hallo", "hello", "VowelSubstitution"),
        ("hexlo", "hello", "GeneralSubstitution"), ("hezllo", "hello", "ExtraCharacter"), ("helo", "hello", "MissingCharacter"), ("abcd", "wxyz", "Unknown"),
    ]
    got = spark.createDataFrame(rows, "a string, b string, want string").select(E.classify_edit(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_both_similarity_joins_agree(spark):
    lex = spark.createDataFrame([(w, 0.9) for w in ("the", "then", "hello", "help", "world")], "word string, freq double")
    tokens = spark.createDataFrame([(t,) for t in ("teh", "thee", "helo", "wordl", "zzz", "the")], "token string")
    a, b = (sorted(map(tuple, f(tokens, lex).collect())) for f in (C.one_edit_pairs, C.generated_pairs))
    assert a == b and ("teh", "the") in a and ("helo", "hello") in a and ("wordl", "world") in a


def test_decisions(spark):
    lex = spark.createDataFrame([("the", 1.0), ("hello", 0.9), ("help", 0.9), ("rare", 0.4)], "word string, freq double")
    got = {r.token: (r.decision, r.replacement, r.reason) for r in decide(spark.createDataFrame([(t,) for t in ("Teh", "the", "helo", "rre", "a@b.c", "qqqqq")], "token string"), lex).collect()}
    assert got["Teh"] == ("apply", "The", "unique") and got["the"][2] == "known" and got["a@b.c"][2] == "protected" and got["qqqqq"][2] == "no_source"
    assert got["rre"] == ("wait", None, "rare_target")


def test_joint_decisions(spark):
    rows = [("a", "spelling", "x", 0.9), ("a", "layout", "y", 0.86), ("b", "layout", "y", 0.9), ("b", "spelling", "x", 0.5), ("c", "spelling", "x", 0.5), ("d", "spelling", "x", 0.4), ("e", "spelling", "x", 0.74), ("e", "layout", "y", 0.44), ("f", "layout", "y", 0.3), ("f", "combined", "z", 0.3), ("f", "spelling", "x", 0.3), ("g", "layout", "y", 0.3), ("g", "spelling", "z", 0.3)]
    got = {r.token: (r.word, r.decision) for r in L.joint_decisions(spark.createDataFrame(rows, "token string, kind string, word string, score double")).collect()}
    assert got == {"a": ("x", "wait"), "b": ("y", "apply"), "c": ("x", "wait"), "d": ("x", "no_change"), "e": ("x", "apply"), "f": ("z", "no_change"), "g": ("z", "no_change")}


def test_near_distance(spark):
    pairs = [("ca", "abc", 2), ("abc", "ca", 2), ("teh", "the", 1), ("abcd", "badc", 2), ("kitten", "sitten", 1), ("ab", "", 2), ("abcdef", "fedcba", 6)]
    got = spark.createDataFrame(pairs, "a string, b string, d int").select("d", L.near_distance(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == r.d if r.d <= 2 else r.n > 2 for r in got)


def test_suppressed_corrections(spark):
    done = spark.createDataFrame([("s", "a", "b"), ("s", "c", "d")], "kind string, candidate string, replacement string")
    said = spark.createDataFrame([("s", "a", "b", 1), ("s", "a", "b", 1), ("s", "c", "d", 1)], "kind string, candidate string, replacement string, undo_count int")
    assert [r.candidate for r in N.suppress_rejected(done, said).collect()] == ["c"]


def test_plugins(spark):
    rows = spark.createDataFrame([("abc",), ("de",)], "token string")
    assert {r.token: (r.score, r.outcome) for r in X.score_with(rows, lambda f: f["token"].str.len()).collect()} == {"abc": (3.0, "Scored"), "de": (2.0, "Scored")}
    assert {(r.score, r.outcome) for r in X.score_with(rows, lambda f: f["none"]).collect()} == {(None, "Failed")}
    got = X.provide(rows, lambda t: [(t[:k], k) for k in range(1, len(t))], "word string, size long").collect()
    assert sorted(map(tuple, got)) == [("abc", "a", 1), ("abc", "ab", 2), ("de", "d", 1)]


def test_punctuation(spark):
    texts = spark.createDataFrame([(1, "how are you"), (2, "it rained but we went"), (3, "")], "id long, text string")
    chosen = P.select_proposals(P.proposals(texts))
    got = {r.id: r.text for r in P.apply_proposals(texts, chosen).collect()}
    assert got == {1: "how are you?", 2: "it rained, but we went.", 3: ""}


def test_files(spark, tmp_path):
    (tmp_path / "en.txt").write_text("the 9\nof 8\nx1 7\nthe 6\ncat 5\n")
    ranked = {r.word: r["rank"] for r in S.read_ranked_words(spark, str(tmp_path / "en.txt"), noise=["of"]).collect()}
    assert ranked == {"the": 1, "cat": 5}
    (tmp_path / "a.dic").write_text("2\n# c\ncat/S\n\ndog\n")
    assert sorted(r.word for r in S.read_dic(spark, str(tmp_path / "a.dic")).collect()) == ["cat", "dog"]
    (tmp_path / "p.jsonl").write_text('{"id":0,"text":"a","metadata_hex":""}\n{"id":2,"text":"b","metadata_hex":""}\n')
    assert S.read_jsonl_pool(spark, str(tmp_path / "p.jsonl")).count() == 2
    with pytest.raises(ValueError):
        S.read_jsonl_pool(spark, str(tmp_path / "p.jsonl"), complete=True)
    (tmp_path / "h.tsv").write_text("# i e l d\nteh\tthe\ten\tapply\n")
    assert S.read_held_out(spark, str(tmp_path / "h.tsv")).collect()[0].expected == "the"
    S.write_sorted_words(spark.createDataFrame([(" B",), ("a",), ("b",)], "word string"), str(tmp_path / "w"))
    assert [r.word for r in spark.read.parquet(str(tmp_path / "w")).orderBy("word").collect()] == ["a", "b"]


def test_stream_equals_batch(spark, tmp_path):
    inputs = as_input(S.read(spark, SF, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    inputs.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(inputs.schema).parquet(str(tmp_path / "in"))
    q = stream_tokens(stream).writeStream.format("memory").queryName("tokens").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.sql("select key, event_id, token from tokens").collect()))
    assert got == sorted(map(tuple, completed_tokens(inputs).select("key", "event_id", "token").collect())) and got


MACHINES = [(B.TriggerBuffer, {"longest": 4}), (B.TextContext, {"longest": 12}), (B.RejectionTracker, {"ttl_ms": 10**12})]


@pytest.mark.parametrize("machine, options", MACHINES, ids=lambda x: getattr(x, "__name__", ""))
def test_buffer_streams_equal_tables(spark, tmp_path, machine, options):
    e = F.col("event_id")
    kind = F.when(e % 8 == 0, "Correction").when(e * 31 % 9 < 4, "Backspace").when(e % 17 == 0, "Boundary").otherwise("Character")
    if machine is not B.RejectionTracker:
        kind = F.when(kind == "Correction", "Boundary").otherwise(kind)
    events = S.read(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    inputs = events.select("event_id", "ts", F.col("user_id").alias("key"), kind.alias("kind"), F.when(e * 17 % 2 == 0, "a").otherwise("b").alias("ch"), F.lit("ab").alias("original"), F.lit("xy").alias("replacement"))
    inputs = B.watched(inputs)
    # two micro-batches, the first before the second in time
    half = events.agg(F.percentile_approx(F.col("ts").cast("double"), 0.5)).first()[0]
    early = F.col("ts").cast("double") <= half
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(inputs.schema).parquet(str(tmp_path / "in"))
    name = f"out_{machine.__name__}"
    q = B.over_stream(stream, machine, **options).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    for part in (inputs.filter(early), inputs.filter(~early)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table(name).collect()))
    assert got == sorted(map(tuple, B.over_table(inputs, machine, **options).collect())) and (got or machine is B.RejectionTracker)


def _press(spark, keys, **more):
    """Keys of one person: < is backspace, ! a boundary, ? a reset, C a correction of ``ab`` to ``xyz``."""
    kinds = {"<": "Backspace", "!": "Boundary", "?": "Reset", "C": "Correction"}
    rows = [(i, i * 1000, 1, kinds.get(k, "Character"), k, "ab", "xyz") for i, k in enumerate(keys)]
    d = spark.createDataFrame(rows, "event_id long, ms long, key long, kind string, ch string, original string, replacement string")
    return B.watched(d.withColumn("ts", F.timestamp_millis("ms")))


def test_buffers(spark):
    triggers = lambda keys: [r.trigger for r in B.over_table(_press(spark, keys), B.TriggerBuffer, longest=3).sort("event_id").collect()]
    assert triggers("/a!") == ["/a"] and triggers("ab<c!!d!") == ["ac", "d"] and triggers("a b!") == ["b"] and triggers("abcde!") == ["e"] and triggers("a?b!<<c!") == ["b", "c"]
    context = B.over_table(_press(spark, "<ab!cd<!"), B.TextContext, longest=4).sort("event_id").collect()
    assert [(r.context, r.version) for r in context] == [("ab ", 3), ("b c ", 7)]
    rejected = lambda keys, **k: [(r.correction_id, r.event_id) for r in B.over_table(_press(spark, keys), B.RejectionTracker, **k).collect()]
    assert rejected("C<<<ab") == [(0, 5)] and rejected("CC<<<ab") == [(1, 6)]
    assert not rejected("C<<ab") and not rejected("C<<<b") and not rejected("C<<<a<b") and not rejected("C<<<a!b") and not rejected("C<<<ab", ttl_ms=5000)
    assert B.over_table(_press(spark, "a!").limit(0), B.TextContext).count() == 0


def test_names_and_entries(spark):
    assert sorted(one(spark, [("еже",)], "w string", F.explode(T.yo_variants(F.col("w"))))) == sorted(["ёжё", "ёже", "ежё"])
    assert one(spark, [("кот",), ("",), (None,)], "w string", F.size(T.yo_variants(F.col("w")))) == [0, 0, 0]
    rows = [("ok", 0.5), ("ok", None), (" ", 0.5), (None, 0.5), ("a\x01b", 0.5), ("x" * 257, 0.5), ("x", 1.5)]
    assert V.valid_entries(spark.createDataFrame(rows, "word string, freq double")).count() == 2
    found = C.dictionary_substrings(spark.createDataFrame([("abab",)], "token string"), spark.createDataFrame([("ab",), ("b",)], "word string"))
    assert sorted((r.start, r.word) for r in found.collect()) == [(1, "ab"), (2, "b"), (3, "ab"), (4, "b")]
    back = C.dictionary_substrings(spark.createDataFrame([("abc",)], "token string"), spark.createDataFrame([("cb",)], "word string"), backward=True)
    assert [(r.start, r.word) for r in back.collect()] == [(1, "cb")]


def _canon(rows):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.execute(f"SELECT {quoted} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert _canon(df.select(*columns).collect()) == _canon(want)


def test_all_tokens_outside_the_lexicon(spark, tmp_path):
    seen = {"hello": 6, "help": 5, "hallo": 4, "helo": 3, "hellp": 2, "hepl": 1, "helloworld": 2}
    rows = [(1, " ".join(w for w, n in seen.items() for _ in range(n)), "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    letters = "abcdefghijklmnopqrstuvwxyz"

    def near(w):
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        return {a + b[1:] for a, b in cuts} | {a + c + b[k:] for a, b in cuts for c in letters for k in (0, 1)} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}

    run = lambda name: {tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    words = {w for w, n in seen.items() if n >= 5}
    tokens = seen.keys() - words
    assert run("one_edit_join") == {(t, w) for t in tokens for w in near(t) & words - {t}}
    assert run("dictionary_prefixes") == {(t, w) for t in tokens for w in words if t.startswith(w)}
    hits = lambda t: sum(t[i:].startswith(w) for i in range(len(t)) for w in words)
    assert {(t, n) for d, t, n, _ in run("dictionary_substrings") if d == "forward"} == {(t, hits(t)) for t in tokens if hits(t)}


def plain_beats(a, b):
    (_, ac, af, ao), (_, bc, bf, bo) = a, b
    length, beside = ("MissingCharacter", "ExtraCharacter"), "AdjacentKeySubstitution"
    if ao in length and af >= 0.999 and bo == beside and af + 0.0001 >= bf:
        return True
    if bo in length and bf >= 0.999 and ao == beside and bf + 0.0001 >= af:
        return False
    if ac + 0.01 < bc:
        return not (bf >= 0.995 and bf >= af + 0.004)
    if ac > bc + 0.08:
        return af >= 0.995 and af >= bf + 0.004
    op = ao if ao == bo or ac + 0.01 < bc else bo if bc + 0.01 < ac else ao if af >= bf else bo
    if op in ("VowelSubstitution", "GeneralSubstitution", beside):
        return (af >= 0.995 and bf <= af - 0.004) or (af >= 0.90 and af >= bf + 0.12)
    return af >= bf + 0.12 or af >= 0.995


def test_full_bands_and_dominance(spark):
    rng = random.Random(4)
    freqs = [0.4, 0.55, 0.8, 0.9, 0.93, 0.989, 0.995, 0.9985, 0.9991, 1.0]
    made = {f"t{t}": [(f"w{i}", E.COSTS[op], rng.choice(freqs), op) for i in range(rng.randint(1, 4)) for op in [rng.choice(list(E.COSTS))]] for t in range(400)}
    made["wide"] = [("near", 0.75, 0.96, "AdjacentTransposition"), ("wide", 1.0, 0.999, "MissingCharacter")]  # the second is beyond 0.08
    want, alone = {}, set()
    for token, rows in made.items():
        least = min(c for _, c, _, _ in rows)
        band = [r for r in rows if (r[1] <= least + 0.35 and r[2] >= 0.50) or r[1] <= least + 0.08 or (r[1] <= least + 0.20 and r[2] >= 0.995)]
        free = [r for r in band if not any(plain_beats(o, r) for o in band if o != r)]
        sure = len(free) == 1 and all(o == free[0] or plain_beats(free[0], o) for o in band)
        want[token] = (len(rows), len(band), "Unique" if sure else "Ambiguous", free[0][0] if sure else None)
        alone |= {(token, r[0]) for r in free}
    df = spark.createDataFrame([(t, *r) for t, rows in made.items() for r in rows], "token string, word string, cost double, freq double, operation string")
    assert {r[0]: tuple(r[1:]) for r in C.classify_mutations(df).collect()} == want and want["wide"][3] == "wide"
    assert {tuple(r) for r in C.skyline(df).collect()} == alone


def test_lookups_and_guards(spark):
    lex = spark.createDataFrame([("the", 1.0), ("hello", 0.9)], "word string, freq double")
    tokens = spark.createDataFrame([("Teh",), ("adn",), ("helo",), ("x",)], "token string")
    assert sorted(map(tuple, K.common_slips(tokens, lex).collect())) == [("Teh", "the"), ("helo", "hello")]
    rows = [("'nj",), ("T;br",), ("VS",), ("vs",), ("Z",), ("руddx",), ("Ру",), ("РУ",), ("hello",), ("",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(K.service_word(F.col("t")).alias("s")).collect()
    assert [r.s and tuple(r.s) for r in got] == [("это", "ru"), ("Ежик", "ru"), None, ("мы", "ru"), ("Я", "ru"), None, ("HE", "en"), None, None, None, None]
    assert one(spark, [("a-b1",), ("привет!",), ("aб",), ("12",), (None,)], "t string", K.token_language(F.col("t"))) == ["en", "ru", None, None, None]
    pairs = [("form", "from", True), ("form", "farm", True), ("form", "forms", True), ("forms", "form", True), ("form", "frame", False), ("form", "form", False), ("form", "fork", True), ("abcd", "wxyd", False)]
    d = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.got == r.want for r in d.select("want", K.blocks_known_to_known(F.col("a"), F.col("b"), F.lit(True), F.lit(True)).alias("got")).collect())
    assert not d.filter(K.blocks_known_to_known(F.col("a"), F.col("b"), F.lit(False), F.lit(True))).count()
    assert one(spark, [("the",), ("vs",), (" ",), ("привет",)], "t string", K.blocks_layout(F.col("t"), F.lit(True))) == [True, False, True, False]
    doubled = spark.createDataFrame([("helllo",), ("thee",), ("heello",), ("noon",)], "token string")
    assert sorted(map(tuple, K.repeated_letter_targets(doubled, lex).collect())) == [("heello", "hello"), ("helllo", "hello"), ("thee", "the")]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_early_layout(spark):
    words = [("en", "hello", 1.0), ("en", "HELLO", 0.5), ("en", "world", 0.5), ("en", "word", 0.2), ("en", "naïve", 1.0), ("en", None, 1.0), ("en", "zero", 0.0),
             ("ru", "привет", 1.0), ("ru", "приятно", 0.4), ("ru", "ёж", 0.4), ("de", "wort", 1.0), (None, "wort", 1.0)]
    table = spark.createDataFrame(words, "lang string, word string, weight double")
    model = Y.train(table)
    counts = {r["keys"]: (r["en"], r["ru"]) for r in model.prefixes.collect()}
    assert counts["wor"] == (2, 0) and counts["ghb"] == (0, 2) and counts["`"] == (0, 1) and "wort" not in counts and "z" not in counts and counts["hello"] == (1, 0)
    triples = {r["gram"]: (r["en"], r["ru"]) for r in model.triples.collect()}
    assert len(triples) == 34 * 34 * 33
    for lang in (0, 1):  # the triples of one context share all probability but what the start sign would get
        mass = sum(math.exp(triples["^^" + c][lang]) for c in Y.EN_ROW)
        assert 0.9 < mass <= 1 + 1e-9
    # plain smoothing of one triple: weights 1 (h), 0.5 + 0.2 (w) after the start
    total = 1.0 * 5 + 0.5 * 5 + 0.2 * 4
    one = (1.0 + 0.1) / (total + 3.4)
    two = (1.0 + 2 * one) / (1.7 + 2)
    assert triples["^^h"][0] == pytest.approx(math.log((1.0 + 2 * two) / (1.7 + 2)))
    asked = [("ghbd", "en"), ("hell", "en"), ("руддщ", "ru"), ("ghb", "en"), ("GHBDTN", "en"), ("ghbd", "de"), ("привет", "en"), ("qqqq", "en"), ("code", "en"), (None, "en"), ("", "en"), ("ghbd", None)]
    found = Y.verdicts(spark.createDataFrame(asked + asked[:1], "token string, lang string"), model, margin=0.1)
    got = {(r["token"], r["lang"]): r["verdict"] for r in found.collect()}
    assert found.count() == len(asked)
    assert got[("ghbd", "en")] == "Candidate" and got[("hell", "en")] == "Wait" and got[("руддщ", "ru")] == "Candidate" and got[("ghb", "en")] == "Wait"
    assert got[("GHBDTN", "en")] == got[("code", "en")] == got[(None, "en")] == got[("", "en")] == "Protected"
    assert got[("ghbd", "de")] == got[("привет", "en")] == got[("ghbd", None)] == "Invalid" and got[("qqqq", "en")] == "Wait"
    typed = spark.createDataFrame([("en", "ghbdtn"), ("en", "hello"), ("en", "ghb"), ("ru", "цщкдв")], "lang string, word string")
    first = {r["word"]: (r["length"], r["switched"]) for r in Y.session_switches(typed, model, margin=0.1).collect()}
    assert first == {"ghbdtn": (4, "прив"), "цщкдв": (4, "worl")}
    audit = Y.switch_audit(table.filter("lang in ('en', 'ru') and weight > 0 and word rlike '^[a-zа-яё]+$'"), model, [0.1, 50.0])
    rows = {(r["lang"], r["margin"]): r for r in audit.collect()}
    assert rows[("en", 0.1)]["eligible"] == 3 and rows[("en", 0.1)]["recovered"] == 3 and rows[("en", 50.0)]["missed"] == 3 and rows[("ru", 0.1)]["false_switches"] == 0
    assert Y.safe_margin(audit).first()["margin"] == 0.1
    none = Y.train(table.filter("false"))
    assert Y.verdicts(table.filter("false").select(F.col("word").alias("token"), "lang"), none).count() == 0
    assert Y.verdicts(typed.select(F.col("word").alias("token"), "lang"), none).filter("verdict = 'Candidate'").count() == 0


def test_dictionary_chain(spark):
    words = spark.createDataFrame([(w, "en") for w in ("Mine", "own", "runs", "walks", "odd", "x1", None)] + [("own", "ru")], "word string, lang string")
    users = spark.createDataFrame([(" mine", "en", None), ("own", "en", 0.3)], "word string, lang string, freq double")
    lex = spark.createDataFrame([("own", "en", 0.9), ("run", "en", 0.99), ("x1", "en", 1.0)], "word string, lang string, freq double")
    forms = spark.createDataFrame([("runs", "en", "run"), ("runs", "en", "ru"), ("walks", "en", "walk"), ("own", "en", "run")], "word string, lang string, root string")
    got = {(r["word"], r["lang"]): (round(r["freq"], 4), r["origin"]) for r in K.dictionary_frequencies(words, users, lex, forms).collect()}
    assert got == {("Mine", "en"): (0.75, "user"), ("own", "en"): (0.3, "user"), ("runs", "en"): (0.8118, "form"), ("walks", "en"): (0.68, "form"),
                   ("odd", "en"): (0.0, None), ("x1", "en"): (0.0, None), (None, "en"): (0.0, None), ("own", "ru"): (0.0, None)}


def test_generated_families(spark):
    made = lambda f, w: set(one(spark, [(w,)], "w string", f(F.col("w")))[0])
    assert made(E.repeated_insertions, "aab") == {"aaab", "aabb"} and made(E.repeated_insertions, "") == set()
    near = E.key_neighbours()
    assert made(E.neighbour_insertions, "qp") == {"qp"[:i] + c + "qp"[i:] for i in range(3) for k in "qp"[max(i - 1, 0) : i + 1] for c in near[k]}
    assert made(E.vowel_insertions, "stae") == {f"s{v}tae" for v in "aeiouy"} and made(E.vowel_insertions, "a") == set()
    assert made(E.vowel_confusions, "мел") == {"мил", "мёл"} and made(E.vowel_confusions, "тст") == set()
    assert len(made(E.short_substitutions, "abcdefgh")) == 200 and made(E.short_substitutions, "abcdefghi") == set()


def test_candidate_scores(spark):
    rows = [("teh", "the", 0.75, 1.0), ("helllo", "hello", 0.35, 0.8), ("plant", "plan", 1.0, 0.9), ("planta", "plant", 1.0, 0.95), ("q", "a", 0.65, 1.0)]
    df = spark.createDataFrame(rows, "token string, word string, cost double, freq double")
    no = F.lit(False)
    score = L.candidate_score(F.col("token"), F.col("word"), F.col("cost"), F.col("freq"), F.lit(0.5), F.lit(0.8), no, no, no, F.lit(0.0))
    got = one(spark, rows, df.schema, score)
    # by hand: edit + plausibility + gain + frequency + untrusted + gain of 0.18 + same length + frequency + swap, times 0.88 for three letters
    assert got[0] == pytest.approx((0.22 * 0.625 + 0.26 * 0.8 + 0.26 * 0.3 + 0.22 + 0.14 + 0.05 + 0.06 + 0.04 + 0.07) * 0.88)
    assert got[1] == 0.95 and got[2] == 0.0 and got[4] == 0.0
    assert got[3] == pytest.approx((0.22 * 0.5 + 0.26 * 0.8 + 0.26 * 0.3 + 0.22 * 0.95 + 0.14 + 0.05) * 0.78)
    scored = spark.createDataFrame([("t", "b", 0.5, 2, 0.5, 1.0), ("t", "a", 0.5, 2, 0.5, 1.0), ("t", "c", 0.5, 1, 0.9, 0.1), ("u", "z", 0.0, 2, 1.0, 0.1)], "token string, word string, score double, tier int, freq double, cost double")
    assert [tuple(r) for r in L.best_candidates(scored).collect()] == [("t", "a", 0.5, 3)]


def test_anchors_and_promotion(spark):
    rows = [("GHBDTN",), ("hello",), (None,), ("ррудщ",), ("API",)]
    assert one(spark, rows, "t string", K.is_layout_anchor(F.col("t"))) == [True, False, False, True, False]
    assert one(spark, rows, "t string", K.anchor_alias(F.col("t"))) == [None, None, None, "hello", None]
    assert one(spark, rows, "t string", K.is_technical_word(F.col("t"))) == [False, False, False, False, True]
    asked = [("teh", "the", "wait", "spelling", 0.98, 0.2, 0.7), ("teh", "the", "apply", "spelling", 1.0, 1.0, 1.0), ("teh", "TEH", "wait", "spelling", 1.0, 1.0, 1.0), ("teh", "a b", "wait", "layout", 1.0, 1.0, 1.0),
             ("teh", "the", "wait", "layout", 0.99, 0.3, 0.0), ("teh", "the", "wait", "other", 1.0, 1.0, 1.0), ("teh", "the", "wait", "layout", float("nan"), 1.0, 1.0), ("teh", None, "wait", "layout", 1.0, 1.0, 1.0)]
    schema = "t string, w string, core string, kind string, c double, m double, f double"
    promoted = G.promotes_scorer(*[F.col(x) for x in ("t", "w", "core", "kind", "c", "m", "f")], F.lit(True), F.lit(True))
    assert one(spark, asked, schema, promoted) == [True, False, False, False, True, False, False, False]

"""Orthography against a plain rewriter and chooser."""

import random

import pytest

from lexiloom.operators import orthography as O


def replaced(w, pairs):
    return [w[:i] + b + w[i + len(a):] for a, b in pairs for i in range(len(w)) if w[i : i + len(a)] == a]


def doubled(w):
    return [w[:i] + w[i] + w[i:] for i in range(len(w)) if w[i] in O.OFTEN_DOUBLED and not (i and w[i - 1] == w[i]) and w[i + 1 : i + 2] != w[i]]


def soft(w):
    return [w + "ь"] * (len(w) >= 3) + [w[:-1]] * w.endswith("ь") + [w[: i + 1] + "ь" + w[i + 1 :] for i in range(len(w)) if w[i : i + 2] == "лн"]


def cleaned(w):
    return [w[:i] + w[i + 1 :] for i in range(len(w) - 1) if w[i] == w[i + 1]]


def swapped(w):
    return [w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1) if w[i] != w[i + 1]]


def inserted(w):
    return [w[:i] + c + w[i:] for i in range(len(w) + 1) for c in O.ALPHABET]


def ended(w):
    out = [w[:-1] + "и" + w[-1]] * (len(w) >= 5 and w.endswith("не")) + [w + "е"] * (len(w) >= 5 and w.endswith("ни")) + [w[:-1] + "й" + w[-1]] * (len(w) >= 4 and w.endswith("фес"))
    return out + [w[:-3] + "тать"] * w.endswith("тть") + [w[: i + 1] + "е" + w[i + 1 :] for i in range(len(w)) if w[i + 1 : i + 4] == "ние"]


def structure(w):
    return replaced(w, O.DIGRAPHS) + doubled(w) + soft(w) + cleaned(w)


def two(step, w):
    one = step(w)
    return {*one, *(y for x in one for y in step(x))} - {w}


def families(w):
    twice = [w[i] for i in range(len(w) - 1) if w[i] == w[i + 1]]
    return {
        "digraph": set(replaced(w, O.DIGRAPHS)), "ending": set(ended(w)), "vowel": two(lambda x: replaced(x, O.VOWEL_PAIRS), w) if len(w) >= 4 else set(),
        "repeated": {y for x in cleaned(w) for y in [x, *(x + c for c in twice)]}, "insertion": set(inserted(w)), "swap": set(swapped(w)) if len(w) > 3 else set(),
        "double_soft": {y for x in doubled(w) for y in soft(x)}, "structure": two(structure, w), "shape": {*inserted(w), *swapped(w), *cleaned(w)},
    }


def has_double(token, v):
    for i in range(len(v) - 1):
        if v[i] == v[i + 1] and v[i] in O.CONSONANTS:
            r = v[:i] + v[i + 1 :]
            if r == token or any(r[:k] + r[k + 1 :] == token for k in range(len(r)) if r[k] == "ь"):
                return True
    return False


def choose(family, token, found, freq):
    by = sorted(found, key=lambda x: (-freq[x], x))
    f = [freq[x] for x in by] + [0, 0]
    lead = lambda xs, least, gap: xs[0] if len(xs) == 1 or (len(xs) > 1 and freq[xs[0]] >= least and round(freq[xs[0]] - freq[xs[1]], 9) >= gap) else None
    if not by:
        return None
    if family in ("digraph", "ending", "swap", "double_soft"):
        return by[0] if len(by) == 1 else None
    if family == "repeated":
        return lead(by, 0.85, 0.01)
    longer = [x for x in by if len(x) == len(token) + 1]
    if family == "insertion":
        ok = longer and freq[longer[0]] >= 0.90 and (len(longer) == 1 or round(freq[longer[0]] - freq[longer[1]], 9) >= 0.10)
        return longer[0] if ok else None
    if family == "structure":
        both = [x for x in by if has_double(token, x) and "лн" in token and "льн" in x]
        if len(both) == 1:
            return both[0]
        signals = {x: has_double(token, x) + (token.endswith("ь") != x.endswith("ь")) + ("лн" in token and "льн" in x) for x in by}
        top = [x for x in by if signals[x] == max(signals.values())]
        return top[0] if len(top) == 1 else None
    if family == "shape":
        return (longer and lead(longer, 0.85, 0.12)) or lead(by, 0.85, 0.15)
    changes = {x: sum(a != b for a, b in zip(token, x)) for x in by}
    least = min(changes.values())
    near = [x for x in by if changes[x] == least]
    if least == 1 and freq[near[0]] >= 0.96 and (len(near) == 1 or round(freq[near[0]] - freq[near[1]], 9) >= 0.05):
        return near[0]
    if least >= 2 and len(near) == 1 and freq[near[0]] >= 0.85 and not any(changes[x] > least and freq[x] >= 0.95 for x in by):
        return near[0]
    best = min(by, key=lambda x: (-freq[x], changes[x], x))
    rest = [freq[x] for x in by if x != best and freq[x] > 0.75]
    return best if changes[best] >= 2 and freq[best] >= 0.95 and (not rest or round(freq[best] - max(rest), 9) >= 0.15) else None


def corrected(token, freq):
    w = token.lower()
    if len(w) < 3 or w in freq:
        return None
    for family, made in families(w).items():
        if family != "digraph" and any(x in w for x in O.FORBIDDEN):
            return None
        word = choose(family, w, [x for x in made if x in freq], freq)
        if word:
            return word, family


WORDS = ["жизнь", "чаща", "сделать", "интеллектуальный", "корова", "молоко", "мама", "трава", "знание", "профессор", "кофейс", "читать", "класс", "кот", "кит", "конь", "кон", "лес", "леса", "весна", "вести", "вист", "пол", "пальма", "касса", "каса", "мел", "мель", "собака", "берег", "бериг"]
TOKENS = ["жызнь", "чяща", "чащя", "зделать", "интелектуалный", "карова", "малако", "мамма", "знане", "знани", "профессорр", "кофес", "читть", "клас", "кто", "крова", "лс", "весан", "висти", "пл", "палма", "мелл", "Сабака", "берек", "собк", "кассса", "", "ab", None, "кот", "жыто"]


@pytest.fixture(scope="module")
def freq():
    rng = random.Random(8)
    letters = "аолнкстемие"
    more = ["".join(rng.choices(letters, k=rng.randint(3, 5))) for _ in range(400)]
    return {w: rng.choice([0.5, 0.69, 0.86, 0.9, 0.95, 0.97, 0.99]) for w in [*WORDS, *more]}


def test_variants(spark):
    tokens = [t for t in TOKENS if t]
    rows = O.variants(spark.createDataFrame([(t,) for t in tokens], "token string")).collect()
    got = {(r.token, r.family, r.variant) for r in rows}
    assert len(got) == len(rows) and got == {(t, f, v) for t in tokens for f, vs in families(t.lower()).items() for v in vs}


def test_corrections_equal_a_plain_chooser(spark, freq):
    rng = random.Random(9)
    tokens = list(dict.fromkeys([*TOKENS, *("".join(rng.choices("аолнкстемиеь", k=rng.randint(3, 6))) for _ in range(250))]))
    df = spark.createDataFrame([(t,) for t in tokens], "token string")
    got = {r.token: (r.word, r.family) for r in O.corrections(df, spark.createDataFrame(list(freq.items()), "word string, freq double")).collect()}
    want = {t: c for t in tokens if t and (c := corrected(t, freq))}
    assert got == want and len({f for _, f in got.values()}) >= 6
    assert O.corrections(df.limit(0), spark.createDataFrame([("кот", 1.0)], "word string, freq double")).collect() == []

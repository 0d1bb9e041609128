"""A character-level bidirectional LSTM with a linear-chain CRF, in numpy.

Training data are sentences of invented words in which spans are written from formats, so every
span is labelled exactly; look-alikes (versions, dates, hexadecimal keys, plain numbers, prices) are left
unlabelled. Training is seeded and takes some seconds; the model is a few thousand floats.
"""

from __future__ import annotations

import hashlib
import inspect
import random
import sys
from functools import lru_cache

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside; then begin and inside of each kind
WINDOW, STRIDE = 96, 48
_PUNCT = "@.+-()_% \n:;,/=\"'#[]|"
_VOCAB = 1 + 26 + 1 + 1 + 1 + len(_PUNCT)  # padding, a-z, other letters, digits, the rest, punctuation
_TABLE = np.full(128, 29, np.int64)
_TABLE[ord("a") : ord("z") + 1] = _TABLE[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_TABLE[ord("0") : ord("9") + 1] = 28
for _i, _c in enumerate(_PUNCT):
    _TABLE[ord(_c)] = 30 + _i
_EMBED, _HIDDEN = 12, 24


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(points < 128, _TABLE[np.minimum(points, 127)], 27)


def tagger_version() -> str:
    """A digest of this module's text, so that weights of other code are never read."""
    return hashlib.sha256(inspect.getsource(sys.modules[__name__]).encode()).hexdigest()[:16]


# labelled spans


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (c > "4")) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(("an", "er", "the", "ing", "sch", "lich", "eau", "ment", "ción", "os", "ta", "re", "ung", "le", "é", "st")) for _ in range(rng.randint(1, 4)))


def _card(rng: random.Random) -> str:
    n = rng.choice((13, 14, 15, 16, 16, 16, 19))
    d = _digits(rng, n - 1)
    d += next(c for c in "0123456789" if luhn(d + c))
    sep, size = rng.choice((("", 4), ("", 4), (" ", 4), ("-", 4), (".", 4), ("  ", 4), ("/", 4), (" ", 1), (" ", 2), (" - ", 4)))
    return sep.join([d[i : i + size] for i in range(0, n, size)])


def _email(rng: random.Random) -> str:
    name = "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 8))) + rng.choice(("", "." + _digits(rng, 2), _digits(rng, 3)))
    host = rng.choice(("mail", "post", "corp", "web")) + rng.choice(("", _digits(rng, 1)))
    at, dot = rng.choice((("@", "."), ("@", "."), ("@", "."), (" @ ", "."), (" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), (" at ", " dot "), (" AT ", " DOT "), ("[at]", ".")))
    return name + at + dot.join([host, rng.choice(("example", "site", "test")), rng.choice(("com", "org", "net", "de"))])


def _ip(rng: random.Random) -> str:
    parts = [str(rng.randint(0, 255)) for _ in range(4)]
    return rng.choice((".", ".", ".", "[.]", " . ", "(.)", " dot ", "[dot]")).join(parts)


def _phone(rng: random.Random) -> str:
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    lead = rng.choice(("+1 ", "+49 ", "+", "00", "", "", ""))
    body = rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"{a}/{b}{c}", f"{a} {b} {c[:2]} {c[2:]}", " ".join(a + b + c)))
    return lead + body


_MAKE = {"email": _email, "ip": _ip, "card": _card, "phone": _phone}


def _decoy(rng: random.Random) -> str:
    return rng.choice(
        (
            lambda: f"Version {rng.randint(1, 9)}.{rng.randint(0, 9)}.",
            lambda: f"CC BY-NC {rng.randint(1, 4)}.0",
            lambda: f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"',
            lambda: f"{rng.randint(1900, 2030)}",
            lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}",
            lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
            lambda: f"{rng.randint(1, 999)},{_digits(rng, 3)}.{_digits(rng, 2)}",
            lambda: _digits(rng, rng.randint(1, 12)),
            lambda: f"@{_word(rng)}",
            lambda: rng.choice(("at", "dot", "at the dot", f"at {rng.randint(1, 12)}", f"dot {_word(rng)}", f"{_word(rng)} at {_word(rng)}")),
            lambda: f"{rng.randint(1, 99)} - {rng.randint(1, 99)}",
            lambda: " ".join(str(rng.randint(1, 9999)) for _ in range(rng.randint(2, 4))),
            lambda: f"{_digits(rng, 2)}:{_digits(rng, 2)}:{_digits(rng, 2)}",
        )
    )()


def labelled_window(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A text of WINDOW characters at most and its spans."""
    text, spans = "", []
    while len(text) < WINDOW:
        roll = rng.random()
        if roll < (0.3 if spans and len(text) - spans[-1][2] < 3 else 0.12):  # spans follow each other more often than words
            kind = rng.choice(KINDS)
            value = _MAKE[kind](rng)
            if len(text) + len(value) <= WINDOW:
                spans.append((kind, len(text), len(text) + len(value)))
                text += value
        elif roll < 0.38 and roll > 0.3:
            text += _decoy(rng)
        else:
            word = _word(rng)
            text += word.upper() if rng.random() < 0.08 else word
        text += rng.choice((" ", " ", " ", ", ", ". ", "\n", "!! ", "### ", " | "))
    return text[:WINDOW], [s for s in spans if s[2] <= WINDOW]


def _tags(n: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        out[a:b] = k + 1
        out[a] = k
    return out


# network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _run(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool):
    """One direction over (time, batch, features)."""
    steps, batch, _ = x.shape
    h = c = np.zeros((batch, _HIDDEN), np.float32)
    out, kept = np.empty((steps, batch, _HIDDEN), np.float32), []
    pre = x @ w + b
    for t in range(steps):
        z = pre[t] + h @ u
        gates = _sigmoid(z[:, : 3 * _HIDDEN])
        i, f, o = gates[:, :_HIDDEN], gates[:, _HIDDEN : 2 * _HIDDEN], gates[:, 2 * _HIDDEN :]
        g = np.tanh(z[:, 3 * _HIDDEN :])
        if keep:
            kept.append((h, c, i, f, o, g))
        c = f * c + i * g
        h = o * np.tanh(c)
        out[t] = h
    return out, kept


def _back(x, u, out_grad, kept):
    dw = db = du = 0
    dx_pre = np.empty((*out_grad.shape[:2], 4 * _HIDDEN), np.float32)
    dh = dc = np.zeros(out_grad.shape[1:], np.float32)
    du = np.zeros_like(u)
    for t in range(len(kept) - 1, -1, -1):
        h0, c0, i, f, o, g = kept[t]
        c1 = np.tanh(f * c0 + i * g)
        dh = dh + out_grad[t]
        dc = dc + dh * o * (1 - c1 * c1)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * c1 * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dx_pre[t] = dz
        du += h0.T @ dz
        dh = dz @ u.T
        dc = dc * f
    flat = dx_pre.reshape(-1, 4 * _HIDDEN)
    dw = x.reshape(-1, x.shape[-1]).T @ flat
    db = flat.sum(axis=0)
    return dw, du, db, dx_pre


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def _crf(scores: np.ndarray, move: np.ndarray, gold: np.ndarray):
    """Loss per sequence and gradients of the scores (time, batch, tags) and transitions."""
    steps, batch, _ = scores.shape
    alpha = np.empty_like(scores)
    beta = np.zeros_like(scores)
    alpha[0] = scores[0]
    for t in range(1, steps):
        alpha[t] = scores[t] + _logsum(alpha[t - 1][:, :, None] + move, 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsum(move + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _logsum(alpha[-1], 1)
    d_scores = np.exp(alpha + beta - z[None, :, None])
    d_move = np.zeros_like(move)
    for t in range(1, steps):
        d_move += np.exp(alpha[t - 1][:, :, None] + move + (scores[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
    at = np.arange(batch)
    value = np.zeros(batch, np.float32)
    for t in range(steps):
        value += scores[t, at, gold[t]]
        d_scores[t, at, gold[t]] -= 1
        if t:
            value += move[gold[t - 1], gold[t]]
            np.add.at(d_move, (gold[t - 1], gold[t]), -1)
    return (z - value).mean(), d_scores / batch, d_move / batch


def _forward(p: dict, x: np.ndarray, keep: bool = False):
    e = p["e"][x]
    f, kf = _run(e, p["wf"], p["uf"], p["bf"], keep)
    r, kr = _run(e[::-1], p["wr"], p["ur"], p["br"], keep)
    h = np.concatenate([f, r[::-1]], axis=2)
    return h @ p["v"] + p["c"], (e, h, kf, kr)


@lru_cache(maxsize=2)
def train(seed: int = 5, rounds: int = 320, batch: int = 48) -> dict[str, np.ndarray]:
    """Weights after ``rounds`` seeded batches of Adam."""
    rng, nrg = random.Random(seed), np.random.default_rng(seed)
    init = lambda *s: (nrg.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"e": init(_VOCAB, _EMBED) * 3, "v": init(2 * _HIDDEN, TAGS), "c": np.zeros(TAGS, np.float32), "m": np.zeros((TAGS, TAGS), np.float32)}
    for d in "fr":
        p |= {f"w{d}": init(_EMBED, 4 * _HIDDEN), f"u{d}": init(_HIDDEN, 4 * _HIDDEN), f"b{d}": np.zeros(4 * _HIDDEN, np.float32)}
        p[f"b{d}"][_HIDDEN : 2 * _HIDDEN] = 1
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        rows = [labelled_window(rng) for _ in range(batch)]
        x = np.stack([codes(t) for t, _ in rows], axis=1)
        y = np.stack([_tags(WINDOW, s) for _, s in rows], axis=1)
        scores, (e, h, kf, kr) = _forward(p, x, keep=True)
        _, ds, dm = _crf(scores, p["m"], y)
        grad = {"m": dm, "v": h.reshape(-1, 2 * _HIDDEN).T @ ds.reshape(-1, TAGS), "c": ds.sum(axis=(0, 1))}
        dh = ds @ p["v"].T
        grad["wf"], grad["uf"], grad["bf"], df = _back(e, p["uf"], dh[:, :, :_HIDDEN], kf)
        grad["wr"], grad["ur"], grad["br"], dr = _back(e[::-1], p["ur"], dh[::-1, :, _HIDDEN:], kr)
        de = df @ p["wf"].T + (dr @ p["wr"].T)[::-1]
        grad["e"] = np.zeros_like(p["e"])
        np.add.at(grad["e"], x, de)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.02 * min(1.0, step / 20) * (1 - step / (rounds + 1)) ** 0.5
        for k, g in grad.items():
            g = g * min(1.0, 5 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] = (p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return p


def decode(p: dict, x: np.ndarray) -> np.ndarray:
    """The best tags (batch, time) of code windows (batch, time)."""
    scores, _ = _forward(p, x.T)
    best = scores[0]
    back = np.empty(scores.shape, np.int64)
    for t in range(1, len(scores)):
        paths = best[:, :, None] + p["m"]
        back[t] = paths.argmax(axis=1)
        best = scores[t] + paths.max(axis=1)
    out = np.empty(x.shape, np.int64)
    out[:, -1] = best.argmax(axis=1)
    at = np.arange(len(x))
    for t in range(len(scores) - 1, 0, -1):
        out[:, t - 1] = back[t, at, out[:, t]]
    return out


def tag_spans(tags: np.ndarray) -> list[tuple[str, int, int]]:
    spans, open_ = [], None
    for i, t in enumerate([*tags.tolist(), 0]):
        kind = (t - 1) // 2 if t else None
        if open_ is not None and (kind != open_[0] or t % 2 == 1):
            spans.append((KINDS[open_[0]], open_[1], i))
            open_ = None
        if t and open_ is None:
            open_ = (kind, i)
    return spans

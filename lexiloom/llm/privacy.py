"""Personal data: base patterns over whole texts, and spans that the sequence tagger adds.

Overlapping windows cover the whole of every text. They are decoded apart and reconciled over the text: each span is judged by the window
that sees most context around it, then spans are taken best first without overlap. An added span must also look like its kind and lie
clear of all base spans. What an added span must hold (nine digits, four numbers, or a whole address) is looked for in every window first: one
that does not hold it cannot add a span, whatever the tagger says, and is not decoded. The spans are those of decoding
all windows, which ``regions=False`` does.
"""

from __future__ import annotations

import hashlib
import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import workspace
from lexiloom.llm.tagger import KINDS, STRIDE, WINDOW, codes, decode, luhn, tag_spans, tagger_version, train

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){15,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ROWS = 256

Span = tuple[str, int, int]


def _emails(text: str) -> list[Span]:
    # a local part starts where the run of its characters before the sign starts, as leftmost matching would have it
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def _short_parts(s: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in s.split("."))


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by kind, then start."""
    out = _emails(text)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if _short_parts(m.group())]
    for m in _CARD.finditer(text):
        d = _only_digits(m.group())
        if len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_only_digits(m.group())) <= 15]
    return out


_AT, _DOT = r"(?:\s?@\s?|\s?[(\[]at[)\]]\s?|\sat\s)", r"(?:\s?\.\s?|\s?[(\[]dot[)\]]\s?|\sdot\s)"
_MAIL = re.compile(rf"[\w.%+-]+{_AT}[\w-]+(?:{_DOT}[\w-]+)+", re.I)


def _plausible(kind: str, s: str) -> bool:
    """The parts that every span of the kind has, however it is written."""
    d, numbers = _only_digits(s), re.findall(r"[0-9]+", s)
    if kind == "email":
        return _MAIL.fullmatch(s) is not None
    if kind == "ip":
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers) and re.fullmatch(r"(?:dot|[\s0-9.\[\]()])+", s, re.I) is not None
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and not re.search(r"[^\s0-9./-]", s)
    return 9 <= len(d) <= 15 and len(numbers) >= 2 and not re.search(r"[^\s0-9().+/-]", s)


_SIGN = re.compile(r"[0-9@]|[(\[]at[)\]]|\sat\s", re.I)


def may_hold(s: str) -> bool:
    """False only if no part of s is ``_plausible`` as any kind: cards have 13 digits, telephone numbers nine, addresses of hosts four numbers."""
    if _SIGN.search(s) is None:
        return False
    return len(_only_digits(s)) >= 9 or len(re.findall(r"[0-9]+", s)) >= 4 or _MAIL.search(s) is not None


def _windows(a: int, b: int) -> list[tuple[int, int]]:
    if b - a <= WINDOW:
        return [(a, b)]
    return [(s, s + WINDOW) for s in range(a, b - WINDOW, STRIDE)] + [(b - WINDOW, b)]


def _reconcile(text: str, base: list[Span], found: list[tuple[int, Span]]) -> list[Span]:
    """found: (context, span); the widest context wins where spans overlap."""
    added: list[Span] = []
    taken = [(a, b) for _, a, b in base]
    for _, (kind, a, b) in sorted(set(found), key=lambda x: (-x[0], x[1][1], -x[1][2])):
        while a < b and text[a].isspace():
            a += 1
        while b > a and (text[b - 1].isspace() or text[b - 1] in ".,;:"):
            b -= 1
        edge = (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())
        if not edge and _plausible(kind, text[a:b]) and all(b <= x or a >= y for x, y in taken):
            added.append((kind, a, b))
            taken.append((a, b))
    return added


def find_spans(texts: list[str], model: dict, tagger_rows: int = _ROWS, regions: bool = True) -> list[tuple[list[Span], list[Span]]]:
    """(base, all) spans of each text; all are ordered by kind, then start. ``regions`` leaves windows undecoded that cannot hold an added span."""
    base = [base_spans(t) for t in texts]
    found: list[list[tuple[int, Span]]] = [[] for _ in texts]
    queue: list[tuple[int, int, int, int, int]] = []

    def flush() -> None:
        x = np.zeros((len(queue), WINDOW), np.int64)
        for r, (i, s, e, _, _) in enumerate(queue):
            x[r, : e - s] = codes(texts[i][s:e])
        for (i, s, e, a, b), tags in zip(queue, decode(model, x), strict=True):
            for kind, p, q in tag_spans(tags[: e - s]):
                # a window end inside a text hides context; the text's own ends do not
                room = min(p if s > a else WINDOW, e - s - q if e < b else WINDOW)
                found[i].append((room, (kind, s + p, s + q)))
        queue.clear()

    for i, text in enumerate(texts):
        for s, e in _windows(0, len(text)):
            if not regions or may_hold(text[s:e]):
                queue.append((i, s, e, 0, len(text)))
                if len(queue) == tagger_rows:
                    flush()
    if queue:
        flush()
    order = {k: i for i, k in enumerate(KINDS)}
    out = []
    for text, own, more in zip(texts, base, found, strict=True):
        everything = sorted(own + _reconcile(text, own, more), key=lambda s: (order[s[0]], s[1]))
        out.append((own, everything))
    return out


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span (the first of those that overlap, widened to their union) as <KIND>."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def _join(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def saved_model(spark: SparkSession) -> dict[str, np.ndarray]:
    """The tagger's weights: trained once and kept in the shared folder under a name that follows from the code that trains them."""
    path = f"{workspace.base_dir(spark)}/lexiloom-tagger-{tagger_version()}.npz"
    data = workspace.read_bytes(spark, path)
    if data is None:
        buffer = io.BytesIO()
        np.savez(buffer, **train())
        data = buffer.getvalue()
        workspace.write_bytes(spark, path, data)
    with np.load(io.BytesIO(data)) as stored:
        return dict(stored)


def find_personal_data(docs: DataFrame, masked: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans, n_spans for every row of
    ``docs(doc_id, text, ...)``; with ``masked`` also the text with its spans replaced, n_chars of it,
    and the other columns of docs under their own names.

    Offsets are code points, ends exclusive. Null texts count as empty (masked: stay null). Equal rows
    give equal results; an empty table gives none.
    """
    workspace.ship(docs.sparkSession)
    model = saved_model(docs.sparkSession)

    def rows(batch: pa.RecordBatch):
        at = 0
        texts = batch.column("text")
        while at < batch.num_rows:  # some megabytes of text at a time
            to, size = at, 0
            part: list[str | None] = []
            while to < batch.num_rows and size < 4 << 20:
                part.append(texts[to].as_py())
                size += len(part[-1] or "")
                to += 1
            yield batch.slice(at, to - at), part, find_spans([t or "" for t in part], model)
            at = to

    def report(batches):
        for batch in batches:
            for part, _, spans in rows(batch):
                counts = [pa.array([sum(s[0] == k for s in own) for own, _ in spans], pa.int64()) for k in KINDS]
                digest = pa.array([hashlib.sha256(_join(own).encode()).hexdigest() for own, _ in spans], pa.string())
                joined = pa.array([_join(every) for _, every in spans], pa.string())
                n = pa.array([len(every) for _, every in spans], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, digest, joined, n], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans"])

    def replace(batches):
        for batch in batches:
            for part, texts, spans in rows(batch):
                new = [None if t is None else mask(t, every) for t, (_, every) in zip(texts, spans, strict=True)]
                columns = dict(zip(part.schema.names, part.columns, strict=True)) | {"text": pa.array(new, pa.string())}
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([None if t is None else len(t) for t in new], pa.int64())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    if masked:
        kept = docs.withColumn("text", F.col("text").cast("string"))
        kept = kept.withColumn("n_chars", F.col("n_chars").cast("long")) if "n_chars" in docs.columns else kept
        return kept.mapInArrow(replace, kept.schema)
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_spans long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(report, schema)

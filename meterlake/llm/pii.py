"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import by_block, sampled

KINDS = ("email", "ip", "card", "phone")
#: Windows are WIDTH characters wide and STEP apart; each decides the STEP characters in its middle.
WIDTH, STEP = 96, 48
MARGIN = (WIDTH - STEP) // 2
#: Rows that the fit uses at most as background for labelled spans; of each, passages from all over its whole text.
FIT_DOCS, PASSAGES = 600, 12
FIT_WINDOWS = 4096
EMBED, HIDDEN, TAGS = 12, 16, 5
#: Windows decoded at a time.
AT_ONCE = 2048

_EMAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SEED = re.compile(r"[0-9@]")

Span = tuple[int, int, str]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of the fixed patterns, by start and then kind; failing matches are dropped.

    Each pattern is anchored on a rare character (``@``, a first digit, ``+``), so that long texts without it stay
    cheap: the local part of an address is read backwards from its ``@``, up to the end of the match before it.
    """
    if not _SEED.search(text):
        return []
    found: list[tuple[int, int, int]] = []
    last = 0
    for m in _EMAIL.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, 0, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


# ---------------------------------------------------------------- network

#: Character classes: every ASCII character is its own, then letters, other characters, and the padding.
LETTER, OTHER, PAD, CLASSES = 128, 129, 130, 131


def classes(codes: np.ndarray) -> np.ndarray:
    out = np.where(codes < 128, codes, np.where(codes < 0x250, LETTER, OTHER))
    return out.astype(np.int16)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Model:
    p: dict[str, np.ndarray]


def _start(rng: np.random.Generator) -> Model:
    r = lambda *n: rng.normal(0, 1 / np.sqrt(n[0]), n).astype(np.float32)
    p = {"embed": r(CLASSES, EMBED) * 3, "out": r(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32)}
    for d in "fb":
        p |= {f"x{d}": r(EMBED, 4 * HIDDEN), f"h{d}": r(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
        p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1
    return Model(p | {"step": np.zeros((TAGS, TAGS), np.float32)})


def _lstm(p: dict, d: str, ids: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states [t, n, HIDDEN] of one direction for windows ids [n, t]."""
    n, t = ids.shape
    enter = p["embed"] @ p["x" + d] + p["c" + d]
    h = c = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((t, n, HIDDEN), np.float32)
    for k in range(t) if d == "f" else range(t - 1, -1, -1):
        g = enter[ids[:, k]] + h @ p["h" + d]
        s = _sigmoid(g[:, : 3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        u = np.tanh(g[:, 3 * HIDDEN :])
        before = (h, c)
        c = f * c + i * u
        tc = np.tanh(c)
        h = o * tc
        out[k] = h
        if keep is not None:
            keep.append((k, *before, i, f, o, u, tc))
    return out


def _lstm_back(p: dict, d: str, ids: np.ndarray, keep: list, grad: np.ndarray, g: dict) -> None:
    n, t = ids.shape
    dh = np.zeros((n, HIDDEN), np.float32)
    dc = dh.copy()
    enter = np.zeros((CLASSES, 4 * HIDDEN), np.float32)
    for k, h0, c0, i, f, o, u, tc in reversed(keep):
        dh = dh + grad[k]
        dc = dc + dh * o * (1 - tc * tc)
        gate = np.concatenate([dc * u * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], 1)
        g["h" + d] += h0.T @ gate
        np.add.at(enter, ids[:, k], gate)
        dh, dc = gate @ p["h" + d].T, dc * f
    g["x" + d] += p["embed"].T @ enter
    g["c" + d] += enter.sum(0)
    g["embed"] += enter @ p["x" + d].T


def _emit(p: dict, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Tag scores [t, n, TAGS]."""
    both = [_lstm(p, d, ids, keep.setdefault(d, []) if keep is not None else None) for d in "fb"]
    joined = np.concatenate(both, 2)
    if keep is not None:
        keep["joined"] = joined
    return joined @ p["out"] + p["bias"]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def loss(p: dict, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood of tag sequences and its gradient."""
    keep: dict = {}
    e = _emit(p, ids, keep)
    t, n, _ = e.shape
    step = p["step"]
    alpha, beta = e.copy(), np.zeros_like(e)
    for k in range(1, t):
        alpha[k] += _lse(alpha[k - 1][:, :, None] + step, 1)
    for k in range(t - 2, -1, -1):
        beta[k] = _lse(step + (e[k + 1] + beta[k + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    grad = np.exp(alpha + beta - z[:, None])
    rows, at = np.arange(n), np.arange(t)[:, None]
    gold = e[at, rows, tags.T].sum() + step[tags[:, :-1], tags[:, 1:]].sum()
    grad[at, rows, tags.T] -= 1
    g = {k: np.zeros_like(v) for k, v in p.items()}
    for k in range(t - 1):
        g["step"] += np.exp(alpha[k][:, :, None] + step + (e[k + 1] + beta[k + 1])[:, None, :] - z[:, None, None]).sum(0)
    np.add.at(g["step"], (tags[:, :-1], tags[:, 1:]), -1)
    g["out"] = np.tensordot(keep["joined"], grad, ([0, 1], [0, 1]))
    g["bias"] = grad.sum((0, 1))
    down = grad @ p["out"].T
    _lstm_back(p, "f", ids, keep["f"], down[:, :, :HIDDEN], g)
    _lstm_back(p, "b", ids, keep["b"], down[:, :, HIDDEN:], g)
    return float(z.sum() - gold) / n, {k: v / n for k, v in g.items()}


def decode(model: Model, ids: np.ndarray) -> np.ndarray:
    """Best tag sequence of every window (Viterbi)."""
    p = model.p
    e = _emit(p, ids)
    t, n, _ = e.shape
    back = np.zeros((t, n, TAGS), np.int8)
    score = e[0]
    for k in range(1, t):
        x = score[:, :, None] + p["step"]
        back[k] = x.argmax(1)
        score = x.max(1) + e[k]
    out = np.empty((n, t), np.int8)
    out[:, -1] = score.argmax(1)
    rows = np.arange(n)
    for k in range(t - 1, 0, -1):
        out[:, k - 1] = back[k, rows, out[:, k]]
    return out


# ---------------------------------------------------------------- labelled spans


def _made(rng: np.random.Generator, kind: int) -> str:
    """One entity of a kind in one of several writings, also such that the fixed patterns miss."""
    pick = lambda *x: x[rng.integers(len(x))]
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9)))
    if kind == 0:
        name = pick(word(), f"{word()}.{word()}", f"{word()}.{rng.integers(1, 99)}", f"{word()}_{num(2)}", f"{word()}-{word()}+{word()}")
        return f"{name}{pick('@', '@', '@', ' @ ')}{pick('', f'{word()}.', f'mail{rng.integers(1, 9)}.')}{word()}.{pick('com', 'org', 'net', 'de', 'fr', 'es', 'co.uk')}"
    if kind == 1:
        return pick(".", ".", ".", ". ").join(map(str, rng.integers(0, 256, 4)))
    if kind == 2:
        d = num(int(rng.integers(13, 19)))
        d += next(c for c in "0123456789" if luhn(d + c))
        return pick(d, d, pick(" ", "-", ".").join(d[i : i + 4] for i in range(0, len(d), 4)))
    a, b, c = num(3), num(3), num(4)
    if rng.random() < 0.6:
        return pick("+1 ", "+1 ", f"+{rng.integers(20, 99)} ", "", "00") + pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"({a}) {b} {c}", f"{a}.{b}.{c}")
    pairs = [num(2) for _ in range(4)]
    french = pick(" ", ".", "-").join([pick("0", "+33 ", "0033 ") + num(1), *pairs])
    area = pick(num(2), num(3), num(4))
    german = pick("0", "+49 ", "0049 ") + area + pick(" ", "-", "/", " / ") + pick(num(7), num(8), f"{num(3)} {num(4)}", f"{num(2)} {num(2)} {num(3)}")
    spanish = pick("+34 ", "0034 ") + pick(f"{a} {b} {num(3)}", f"{a} {num(2)} {num(2)} {num(2)}", f"{a}{b}{num(3)}")
    english = pick(f"020 {c} {num(4)}", f"0{c} {a}{b}", f"+44 20 {c} {num(4)}", f"+44 (0){c} {a}{b}", f"0{a} {b} {c}")
    return pick(french, german, spanish, english)


def _decoy(rng: np.random.Generator) -> str:
    """Numbers and symbols that are nobody's data."""
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    return [
        "".join(rng.choice(list("0123456789abcdef"), 40)), f"Version {rng.integers(0, 9)}.{rng.integers(0, 9)}.", num(int(rng.integers(1, 8))),
        f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", f"{num(2)}:{num(2)}", f"@{num(3)}", f"{num(1)}.{num(4)}", f"{num(1)},{num(3)},{num(3)}",
        f"{rng.integers(1990, 2030)}-0{rng.integers(1, 10)}-{rng.integers(10, 29)} {num(2)}:{num(2)}:{num(2)}", f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", num(int(rng.integers(9, 14))),
        " ".join(num(int(rng.integers(1, 4))) for _ in range(int(rng.integers(2, 8)))), f"{rng.integers(1990, 2030)}-{rng.integers(1990, 2030)}", f"{num(3)}.{num(3)}.{num(3)},{num(2)}",
    ][rng.integers(14)]


Cut = tuple[str, list[Span]]  # a passage and its base spans, which may reach over its ends


def passages(text: str, seed: int) -> tuple[list[Cut], list[Cut]]:
    """Passages at random places of a whole text: anywhere, and around a digit or an @; at most PASSAGES of each."""
    rng = np.random.default_rng(seed & 0x7FFFFFFF)
    spans = base_spans(text)
    marks = [m.start() for m in _SEED.finditer(text)]
    anywhere = rng.integers(0, max(1, len(text) - WIDTH), PASSAGES)
    around = [max(0, marks[rng.integers(len(marks))] - int(rng.integers(8, WIDTH - 8))) for _ in range(PASSAGES if marks else 0)]
    cut = lambda at: (text[at : at + WIDTH], [(a - at, b - at, k) for a, b, k in spans if b > at and a < at + WIDTH])
    return [cut(int(at)) for at in anywhere], [cut(at) for at in around]


def labelled(texts: list[str], windows: int = FIT_WINDOWS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows with a tag per character from passages of the texts."""
    return tagged([passages(t, seed + i) for i, t in enumerate(texts) if len(t) > 20], windows, seed)


def tagged(samples: list[tuple[list[Cut], list[Cut]]], windows: int = FIT_WINDOWS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows with a tag per character: sampled passages with their own base spans, and with entities and decoys put in."""
    rng = np.random.default_rng(seed)
    samples = samples or [passages("the one and the other of all these are in the text " * 4, seed)]
    ids, tags = np.full((windows, WIDTH), PAD, np.int16), np.zeros((windows, WIDTH), np.int8)
    for r in range(windows):
        anywhere, around = samples[rng.integers(len(samples))]
        if r % 4 == 0 and around:  # as it stands, around a digit or an @
            part, spans = around[rng.integers(len(around))]
            marks = [(max(0, a), b, KINDS.index(k)) for a, b, k in spans]
        else:
            part, marks = anywhere[rng.integers(len(anywhere))][0], []
            where = int(rng.integers(0, WIDTH - 12))
            for _ in range(int(rng.integers(1, 3))):
                kind = int(rng.integers(0, 6))
                new = _made(rng, kind) if kind < 4 else _decoy(rng)
                gap = " " if rng.random() < 0.9 else "*#&"[rng.integers(3)]
                part = part[:where] + gap + new + gap + part[where:]
                if kind < 4:
                    marks.append((where + 1, where + 1 + len(new), kind))
                where += len(new) + 2 + int(rng.integers(0, 10))
            part = part[:WIDTH]
            base = [(a, b, KINDS.index(k)) for a, b, k in base_spans(part)]
            marks += [x for x in base if all(x[1] <= a or x[0] >= b for a, b, _ in marks)]
        ids[r, : len(part)] = classes(np.array([ord(c) for c in part], np.int64))
        for a, b, k in marks:
            tags[r, a : min(b, WIDTH)] = k + 1
    return ids, tags


def fit(samples: list[tuple[list[Cut], list[Cut]]], windows: int = FIT_WINDOWS, epochs: int = 7, batch: int = 128, rate: float = 0.012, seed: int = 5) -> Model:
    """Adam on windows of labelled spans."""
    ids, tags = tagged(samples, windows, seed)
    rng = np.random.default_rng(seed)
    model = _start(rng)
    p = model.p
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    n = 0
    total = epochs * (len(ids) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for i in range(0, len(ids) - batch + 1, batch):
            part = order[i : i + batch]
            _, g = loss(p, ids[part], tags[part])
            n += 1
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            scale = min(1.0, 5.0 / max(norm, 1e-9))
            speed = rate * (1 - 0.9 * n / total)
            for k, x in g.items():
                x = x * scale
                m[k] += 0.1 * (x - m[k])
                v[k] += 0.01 * (x * x - v[k])
                p[k] -= (speed * m[k] / (1 - 0.9**n) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
    return model


def learned(docs: DataFrame, fit_docs: int = FIT_DOCS, windows: int = FIT_WINDOWS) -> Model:
    """Fit on passages of at most ``fit_docs`` texts chosen by hash, one half with a digit or an @ and one without.

    Tasks cut the passages from whole texts, and the driver gets only those. Equal texts count once; null texts and
    those of up to 20 characters are left out. An empty table gives a fit on a fixed plain sentence.
    """
    half = fit_docs // 2
    rows = docs.select("text").where(F.length("text") > 20)
    some = sampled(rows, {True: half, False: half}, F.col("text").rlike("[0-9@]"), "text").select("h", "text")

    def run(rows: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
        cuts = [json.dumps(passages(t, h)) for t, h in zip(texts, rows.column(0).to_pylist())]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(cuts, pa.string())], names=["h", "cuts"])

    found = some.mapInArrow(by_block(run), "h bigint, cuts string").dropDuplicates(["h"]).collect()
    samples = [json.loads(r.cuts) for r in sorted(found, key=lambda r: r.h)]
    return fit([*[s for s in samples if s[1]][:half], *[s for s in samples if not s[1]][:half]], windows)


# ---------------------------------------------------------------- spans of whole texts


def _valid(kind: str, s: str) -> bool:
    """What a tagged span must satisfy besides: the arithmetic of its kind, which a network cannot check."""
    d = _digits(s)
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+ ?@ ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", s))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return bool(re.fullmatch(r"[0-9]{1,3}(?:\. ?[0-9]{1,3}){3}", s)) and all(int(x) <= 255 for x in parts)
    if kind == "card":
        return bool(re.fullmatch(r"[0-9](?:[ .-]?[0-9])+", s)) and 14 <= len(d) <= 19 and luhn(d)
    return bool(re.fullmatch(r"\+?[ (]{0,2}[0-9](?:[ ().\-/]{0,3}[0-9])+", s)) and 10 <= len(d) <= 15


def network_spans(texts: list[str], model: Model) -> list[list[Span]]:
    """Spans that the network tags, over windows that overlap by half.

    Every span of a kind holds a digit or an @, so decoding starts from the windows with one and goes on to the next
    window wherever a tagged run reaches the end of what is decoded; no other window can give a part of a span.
    A character takes its tag from the window that has it in its middle, so the tags of a whole text are one sequence;
    runs of a tag are spans, trimmed of blanks and closing symbols, and kept if the arithmetic of the kind holds.
    """
    codes: dict[int, np.ndarray] = {}
    todo: list[tuple[int, int]] = []
    for n, t in enumerate(texts):
        if _SEED.search(t):
            codes[n] = c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            seeds = np.flatnonzero(((c >= 48) & (c <= 57)) | (c == 64))
            near = np.unique(np.concatenate([(seeds + d) // STEP for d in (-MARGIN, 0, MARGIN)]))
            todo += [(n, g) for g in near[(near >= 0) & (near * STEP < len(c))].tolist()]
    out: list[list[Span]] = [[] for _ in texts]
    tags = {n: np.zeros(len(c), np.int8) for n, c in codes.items()}
    done = set(todo)
    while todo:
        more = set()
        for i in range(0, len(todo), AT_ONCE):
            own = todo[i : i + AT_ONCE]
            ids = np.full((len(own), WIDTH), PAD, np.int16)
            for r, (n, g) in enumerate(own):
                a = g * STEP - MARGIN
                part = codes[n][max(a, 0) : a + WIDTH]
                ids[r, max(-a, 0) : max(-a, 0) + len(part)] = classes(part)
            best = decode(model, ids)[:, MARGIN : MARGIN + STEP]
            for r, (n, g) in enumerate(own):
                mine = tags[n][g * STEP : (g + 1) * STEP]
                mine[:] = best[r, : len(mine)]
                if mine[0] and g:
                    more.add((n, g - 1))
                if mine[-1] and (g + 1) * STEP < len(codes[n]):
                    more.add((n, g + 1))
        todo = sorted(more - done)
        done |= more
    for n, row in tags.items():
        out[n] = tag_runs(texts[n], row)
    return out


def tag_runs(text: str, row: np.ndarray) -> list[Span]:
    """Spans from one tag per character."""
    out = []
    edge = np.flatnonzero(np.diff(np.concatenate(([0], row, [0]))))
    for a, b in zip(edge.tolist(), edge[1:].tolist()):
        if row[a]:
            kind = KINDS[row[a] - 1]
            s = text[a:b]
            a += len(s) - len(s.lstrip(" \n\t,;:<\"'[{"))
            s = s.strip(" \n\t,;:<>\"'[]{}*#&%$!?").rstrip(".-")
            if _valid(kind, s):
                a = text.index(s, a)
                out.append((a, a + len(s), kind))
    return out


def all_spans(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """Of each text the base spans, and all spans: a network span that touches a base span is left out."""
    out = []
    for t, more in zip(texts, network_spans(texts, model)):
        base = base_spans(t)
        new = [x for x in more if all(x[1] <= a or x[0] >= b for a, b, _ in base)]
        out.append((base, sorted([*base, *new], key=lambda x: (x[0], KINDS.index(x[2]), x[1]))))
    return out


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, base and spans (arrays of start, stop, kind; code points, end exclusive) of every row, from whole texts.

    Null and empty texts have none. Repeated rows each get a row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())]))

    def run(rows: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
        found = all_spans(texts, shared.value)
        columns = [pa.array([[dict(zip(("start", "stop", "kind"), s)) for s in pair[k]] for pair in found], kind) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([rows.column(0), *columns], names=["doc_id", "base", "spans"])

    spans = "array<struct<start: bigint, stop: bigint, kind: string>>"
    return docs.select("doc_id", "text").mapInArrow(by_block(run), f"doc_id bigint, base {spans}, spans {spans}")


def redacted(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in angle brackets; spans that overlap are replaced together."""
    parts, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            parts += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns, with spans replaced in ``text``; a null text stays null. ``n_chars`` follows where it is there."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
        new = [redacted(t, spans) for t, (_, spans) in zip(texts, all_spans(texts, shared.value))]
        k = rows.schema.get_field_index("text")
        null = rows.column(k).is_null().to_pylist()
        yield rows.set_column(k, rows.schema.field(k), pa.array([None if n else t for n, t in zip(null, new)], rows.schema.field(k).type))

    out = docs.mapInArrow(by_block(run), docs.schema)
    kinds = dict(docs.dtypes)
    if kinds.get("n_chars") in ("int", "bigint"):
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kinds["n_chars"]))
    return out

"""Personal data by fixed patterns and a linear-chain conditional random field over word shapes.

The patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers in their usual forms. The
field, trained by gradient ascent on a small labelled table, adds spans in forms that they do not cover, and
never removes or overlaps theirs. It labels words; decoding is Viterbi over numpy batches of islands. A
word without a digit or a sign of an address has one feature for its own shape; training checks that such a word
among its like is outside of every span on any best path, so decoding the islands apart is exact.
"""

from __future__ import annotations

import random
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.textwords import bounded_batches, byte_column, column_of, text_slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("out", *KINDS)
MAX_LABELLED = 2_000
ROUNDS, RATE, DECAY = 150, 0.3, 1e-3

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A search that fails inside a run of digits fails for the whole run, so only its first digit is tried.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SIGN = re.compile(r"[0-9@]|[(\[{](?:at|dot)[)\]}]", re.I)
_EDGE = "\"'<>()[]{},;:!?."


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _byte(part: str) -> bool:
    """Whether a part of an address is at most 255, however many zeros it begins with."""
    number = part.lstrip("0")
    return len(number) <= 3 and int(number or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the patterns find, leftmost and without overlap per kind; by start, then kind."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def plausible(piece: str, kind: str) -> bool:
    """What shapes cannot show: a card number's check digit, the range of an address's parts, a number's length."""
    digits = "".join(c for c in piece if c in "0123456789")
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        parts = re.findall("[0-9]+", piece)
        return len(parts) >= 4 and all(map(_byte, parts[:4]))
    if kind == "phone":
        return 7 <= len(digits) <= 15
    return bool(_SIGN.search(piece))


def shape(word: str) -> str:
    """Letters become x or X, digits d; runs keep their length up to four. ``plain`` for words without a sign."""
    if not _SIGN.search(word):
        return "plain"
    out, last, run = [], "", 0
    for c in word:
        s = "d" if c in "0123456789" else "X" if c.isupper() else "x" if c.isalpha() else c
        run = run + 1 if s == last else 1
        if run <= 4 or s == "d" and run in (7, 10, 13):
            out.append(s)
        last = s
    return "".join(out)


def features_of(words: list[str], before: bool, after: bool) -> list[list[str]]:
    """Features of each word; ``before`` and ``after`` say whether the text goes on there."""
    shapes = [shape(w) for w in words]
    left = ["plain" if before else "edge", *shapes[:-1]]
    right = [*shapes[1:], "plain" if after else "edge"]
    out = []
    for w, own, p, n in zip(words, shapes, left, right):
        f = [f"p={p}", f"n={n}"]
        if own == "plain":
            f.append("plain")
        else:
            bare, digits = w.strip(_EDGE), sum(c in "0123456789" for c in w)
            f += [f"own={own}", f"own={shape(bare)}/bare", f"p+={p}|{own}", f"n+={own}|{n}", f"digits={min(digits, 20)}",
                  f"all={digits == len(bare)}", f"at={'@' in w}", f"dots={min(w.count('.'), 5)}", f"dash={min(w.count('-'), 4)}", f"sign={w[0] if not w[0].isalnum() else 'a'}",
                  f"letters={any(c.isalpha() for c in w)}"]
        out.append(f)
    return out


class Field(NamedTuple):
    """Weights by feature and label, and by pairs of labels."""

    index: dict
    weights: np.ndarray
    steps: np.ndarray

    def scores(self, features: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(features), len(LABELS)))
        for i, f in enumerate(features):
            known = [self.index[x] for x in f if x in self.index]
            out[i] = self.weights[known].sum(0)
        return out


def viterbi(scores: list[np.ndarray], steps: np.ndarray) -> list[np.ndarray]:
    """Best labels of each sequence; sequences of similar length advance together. Ties take the first label."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    order = sorted((k for k in range(len(scores)) if len(scores[k])), key=lambda k: len(scores[k]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and len(scores[order[to]]) * (to + 1 - at) <= 1 << 18:
            to += 1
        ks = order[at:to]
        n = len(scores[ks[-1]])
        grid = np.zeros((len(ks), n, len(LABELS)))
        live = np.zeros((len(ks), n), bool)
        for i, k in enumerate(ks):
            grid[i, : len(scores[k])] = scores[k]
            live[i, : len(scores[k])] = True
        best = grid[:, 0].copy()
        back = np.zeros((len(ks), n, len(LABELS)), np.int8)
        for t in range(1, n):
            total = best[:, :, None] + steps
            back[:, t] = total.argmax(1)
            best = np.where(live[:, t, None], total.max(1) + grid[:, t], best)
            back[:, t][~live[:, t]] = np.arange(len(LABELS))  # beyond a sequence its last label stands
        label = best.argmax(1)
        path = np.zeros((len(ks), n), np.int64)
        for t in range(n - 1, -1, -1):
            path[:, t] = label
            label = back[np.arange(len(ks)), t, label]
        for i, k in enumerate(ks):
            out[k] = path[i, : len(scores[k])]
        at = to
    return out


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = ROUNDS, rate: float = RATE, decay: float = DECAY) -> Field:
    """Maximise the conditional likelihood of the labelled ``rows`` by Adagrad with weight decay."""
    index: dict[str, int] = {}
    xs, ys = [], []
    for text, spans in rows:
        words = list(_WORD.finditer(text))
        if not words:
            continue
        xs.append([[index.setdefault(f, len(index)) for f in fs] for fs in features_of([m[0] for m in words], False, False)])
        ys.append([next((LABELS.index(k) for a, b, k in spans if m.start() < b and m.end() > a), 0) for m in words])
    labels, size = len(LABELS), max(map(len, xs), default=1)
    lanes = len(xs)
    live = np.zeros((lanes, size), bool)
    want = np.zeros((lanes, size), np.int64)
    lane, place, feature = [], [], []
    for i, (x, y) in enumerate(zip(xs, ys)):
        live[i, : len(y)] = True
        want[i, : len(y)] = y
        for t, fs in enumerate(x):
            lane += [i] * len(fs)
            place += [t] * len(fs)
            feature += fs
    lane, place, feature = (np.array(v, np.int64) for v in (lane, place, feature))
    w, s = np.zeros((len(index), labels)), np.zeros((labels, labels))
    gw, gs = np.full_like(w, 1e-6), np.full_like(s, 1e-6)
    gold = np.zeros((lanes, size, labels))
    gold[np.nonzero(live) + (want[live],)] = 1
    pairs = live[:, 1:]
    gold_steps = np.zeros((labels, labels))
    np.add.at(gold_steps, (want[:, :-1][pairs], want[:, 1:][pairs]), 1)
    for _ in range(rounds if lanes else 0):
        grid = np.zeros((lanes, size, labels))
        np.add.at(grid, (lane, place), w[feature])
        a = np.zeros_like(grid)
        b = np.zeros_like(grid)
        a[:, 0] = grid[:, 0]
        for t in range(1, size):
            step = np.logaddexp.reduce(a[:, t - 1, :, None] + s, axis=1) + grid[:, t]
            a[:, t] = np.where(live[:, t, None], step, a[:, t - 1])
        norm = np.logaddexp.reduce(a[:, -1], axis=1)
        for t in range(size - 2, -1, -1):
            step = np.logaddexp.reduce(s + (grid[:, t + 1] + b[:, t + 1])[:, None, :], axis=2)
            b[:, t] = np.where(live[:, t + 1, None], step, b[:, t + 1])
        share = np.exp(a + b - norm[:, None, None]) * live[:, :, None]
        both = np.exp(a[:, :-1, :, None] + s + (grid[:, 1:] + b[:, 1:])[:, :, None, :] - norm[:, None, None, None]) * pairs[:, :, None, None]
        up_w = np.zeros_like(w)
        np.add.at(up_w, feature, (gold - share)[lane, place])
        up_w -= decay * w
        up_s = gold_steps - both.sum((0, 1)) - decay * s
        gw += up_w**2
        gs += up_s**2
        w += rate * up_w / np.sqrt(gw)
        s += rate * up_s / np.sqrt(gs)
    field = Field(index, w, s)
    # Replacing a label by "out" changes two steps: this gap makes every plain word among its like "out".
    need = 2 * (s.max() - s.min())
    for p in ("plain", "edge"):
        for n in ("plain", "edge"):
            e = field.scores([[f"p={p}", f"n={n}", "plain"]])[0]
            lack = need - (e[0] - e[1:].max())
            if lack >= 0 and "plain" in index:
                w[index["plain"], 0] += lack + 1e-6
    return field


def labelled_table(spark: SparkSession) -> DataFrame:
    """(text, spans) of the built-in training rows: addresses and numbers in unusual forms, and look-alikes."""
    return spark.createDataFrame(_labelled(), "text string, spans array<struct<start:int,end:int,kind:string>>")


def _labelled(per_form: int = 14, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(3, 8)))
    octet = lambda: str(rng.randint(0, 255))
    forms = {
        "email": [lambda: f"{name()} (at) {name()} (dot) org", lambda: f"{name()}(at){name()}.net", lambda: f"{name()}[at]{name()}[dot]com", lambda: f"{name()}.{digits(2)}@{name()}.example.com", lambda: f"{name()} [at] {name()}.org"],
        "ip": [lambda: ".".join(octet() for _ in range(4)), lambda: ".".join(octet() for _ in range(4)) + ":" + digits(4), lambda: ".".join(octet() for _ in range(4)) + "/24"],
        "card": [lambda: digits(16), lambda: "-".join(digits(4) for _ in range(4)), lambda: " ".join(digits(4) for _ in range(4)), lambda: ".".join(digits(4) for _ in range(4))],
        "phone": [lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"+{digits(2)} {digits(3)} {digits(7)}",
                  lambda: f"00{digits(2)} {digits(3)} {digits(6)}"],
        "": [lambda: f"version {digits(1)}.{digits(1)}", lambda: f"Version {digits(1)}.{digits(1)}.", lambda: f"in {rng.choice(('19', '20'))}{digits(2)}", lambda: f"token = \"{''.join(rng.choice('0123456789abcdef') for _ in range(40))}\"",
             lambda: f"password={''.join(rng.choice('0123456789abcdef') for _ in range(16))}", lambda: "AK" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(18)), lambda: f"page {digits(3)}",
             lambda: f"{digits(2)}.{digits(2)}.20{digits(2)}", lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(1)},{digits(3)},{digits(3)}", lambda: f"section {digits(1)}.{digits(1)}.{digits(1)}",
             lambda: f"{digits(2)}%", lambda: f"${digits(3)}.{digits(2)}", lambda: f"@{name()}", lambda: f"{name()}{digits(2)}", lambda: f"{digits(5)} {name()} {digits(5)}", lambda: name()],
    }
    rows = []
    for kind, makers in forms.items():
        for make in makers:
            for _ in range(per_form):
                head = " ".join(name() for _ in range(rng.randint(0, 4)))
                body, tail = make(), "".join(" " + name() for _ in range(rng.randint(0, 4))) + rng.choice(("", ".", ""))
                text = f"{head} {body}{tail}" if head else body + tail
                start = len(head) + bool(head)
                rows.append((text, [(start, start + len(body), kind)] if kind else []))
    return rows


def fit(labelled: DataFrame) -> Field:
    """Train on ``labelled(text, spans)``, a table of at most MAX_LABELLED rows."""
    rows = labelled.limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled rows")
    return train([(r["text"], [(s["start"], s["end"], s["kind"]) for s in r["spans"] or []]) for r in rows if r["text"]])


def _islands(text: str) -> list[tuple[list[re.Match], bool, bool]]:
    """Words around each sign, two on either side; islands that touch are one."""
    words, marks = [], []
    for m in _WORD.finditer(text):
        if _SIGN.search(m[0]):
            marks.append(len(words))
        words.append(m)
    out, k = [], 0
    while k < len(marks):
        first = last = marks[k]
        while k < len(marks) and marks[k] <= last + 5:
            last = marks[k]
            k += 1
        a, b = max(0, first - 2), min(len(words), last + 3)
        out.append((words[a:b], a > 0, b < len(words)))
    return out


def learned_spans(texts: list[str], field: Field) -> list[list[tuple[int, int, str]]]:
    """Spans of words that the field labels alike, without marks at their ends."""
    owner, islands = [], []
    for i, text in enumerate(texts):
        for island in _islands(text):
            owner.append(i)
            islands.append(island)
    paths = viterbi([field.scores(features_of([m[0] for m in words], before, after)) for words, before, after in islands], field.steps)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for i, (words, _, _), path in zip(owner, islands, paths):
        k = 0
        while k < len(path):
            end = k + 1
            while end < len(path) and path[end] == path[k]:
                end += 1
            if path[k]:
                a, b = words[k].start(), words[end - 1].end()
                while a < b and texts[i][a] in "\"'<>[]{},;:!?.=":
                    a += 1
                while a < b and texts[i][b - 1] in "\"'<>(){},;:!?.=":
                    b -= 1
                if plausible(texts[i][a:b], LABELS[path[k]]):
                    out[i].append((a, b, LABELS[path[k]]))
            k = end
    return out


def personal_data(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, spans array<struct<start,end,kind,base>>, in order of start, then kind.

    Places are code points, ``end`` exclusive. Pattern spans have base = true and all stay; a learned span
    that overlaps one of them is dropped, as is one that ``plausible`` refutes. A null or empty text has no span. Texts of any length are searched
    whole. Repeated rows and null ids are answered row by row; other columns are not read. An empty table gives an
    empty result. One pass, no shuffle.
    """
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(field)
    sign = np.zeros(256, bool)
    sign[[*b"0123456789@([{"]] = True

    def search(batches):
        model = shared.value
        for part in text_slices(batches, "_text"):
            column = column_of(part, "_text")
            raw, offsets = byte_column(column)
            hits = np.concatenate([[0], np.cumsum(sign[raw])])[offsets]
            asked = np.flatnonzero(hits[1:] > hits[:-1])
            texts = column.take(pa.array(asked)).to_pylist()
            spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for i, text, learned in zip(asked.tolist(), texts, learned_spans(texts, model)):
                base = base_spans(text)
                covered, new, k = sorted((a, b) for a, b, _ in base), [], 0
                for a, b, what in sorted(learned):
                    while k < len(covered) and covered[k][1] <= a and covered[k][0] < a:
                        k += 1
                    if not any(x < b and y > a for x, y in covered[max(0, k - len(KINDS)) : k + len(KINDS) + 1]):
                        new.append((a, b, what))
                merged = sorted([(a, b, what, True) for a, b, what in base] + [(a, b, what, False) for a, b, what in new], key=lambda s: (s[0], KINDS.index(s[2])))
                spans[i] = [{"start": a, "end": b, "kind": what, "base": known} for a, b, what, known in merged]
            kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([column_of(part, "_id"), pa.array(spans, kinds)], ["_id", "spans"])

    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = rows.mapInArrow(search, f"_id {kind}, spans array<struct<start:int,end:int,kind:string,base:boolean>>")
    return out.withColumnRenamed("_id", id_col)

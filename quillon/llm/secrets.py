"""Secret scans: rules, and a character convolutional network over every candidate.

The rules (kinds assign, access and hex) find spans that always stay. A candidate is a longest run of
[A-Za-z0-9+/_.=-] of MIN_CANDIDATE characters at least, the rules' length. The network reads it in pieces of BODY
characters, STEP apart, to its last character, each with its context (LEFT characters before, RIGHT after);
a run scores what its best piece does. It adds spans of kind cnn where no rule's span overlaps. The
convolution is computed once a character of the text, and a piece takes its maximum from tables of ranges.

Training: pieces of all documents are labelled by the rules' findings; a third of the documents, by hash, is held out. The network starts from
weights fitted to a bounded set (of each class, findings, others beside a finding, and others with digits, with capitals and with neither,
the MAX_CANDIDATES smallest by hash; findings are looked for in all documents, others in MAX_DOCS and those with findings). There each finding is also
shown VARIANTS times with its characters drawn anew from other alphabets (FORMS) in the context of ordinary
candidates, as many candidates are shown beside such keys, and all are shown without context too, so that keys no rule knows are told by their form.
Then STEPS steps follow, each by the gradient over all pieces of a part of the training documents; together the parts are all of them.
The scores are calibrated (Platt), and the threshold is the largest, to GRID in the logit, that keeps RECALL of findings and
variants, both over all pieces of all held-out documents, counted by logit. Without findings nothing is added.

Defined results: null texts are empty; positions are code points; an empty table gives no rows; rows
are independent, so repeated ones give equal results; extra columns are ignored; very long texts are read whole and long runs in
pieces; a score that equals the threshold is a finding.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, materialize

# The rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "cnn")

RUN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
MIN_CANDIDATE = 6
LEFT, BODY, RIGHT, STEP = 24, 40, 8, 20
#: Characters whose tables are looked at together, so that they stay in a core's cache (a multiple of 128), and pieces whose gradients are added up together.
BLOCK, SUMMED_AT_ONCE = 8_192, 8_192
WIDTH = LEFT + BODY + RIGHT
MAX_DOCS = 20_000
MAX_CANDIDATES = 2_000
RECALL = 0.98
#: Alphabets of keys.
FORMS = ("0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "-_")
VARIANTS = 3
PLAIN, DIGITS, CAPITALS, BESIDE, FINDING = range(LABELS := 5)
#: Steps over all documents, their rate, the grain of summed gradients and of logits, and texts looked at together.
STEPS, RATE, GRAIN, GRID, TEXTS_AT_ONCE = 6, 0.005, 2.0**-30, 2.0**-10, 500


def rule_spans(text: str) -> list[tuple[int, int, str]]:
    low = text.lower()
    found = []
    if any(k in low for k in KEYWORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(*m.span(), "hex") for m in HEX.finditer(text)]


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in RUN.finditer(text)]


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """A run in overlapping pieces of BODY characters at most, the last one up to its end."""
    return [(min(at, max(start, end - BODY)), min(at + BODY, end)) for at in range(start, max(start + 1, end - BODY + STEP), STEP)]


def _codes() -> np.ndarray:
    """Character classes: 0 padding, 1 other, 2 white space, 3 other letter, then printable ASCII."""
    table = np.full(0x3000, 1, np.uint8)
    table[[c for c in range(0x3000) if chr(c).isalpha()]] = 3
    table[[c for c in range(0x3000) if chr(c).isspace()]] = 2
    table[33:127] = np.arange(4, 98)
    return table


CODES = _codes()
N_CODES = 98
IN_RUN = np.zeros(N_CODES, bool)
IN_RUN[[CODES[ord(c)] for c in ALPHABET]] = True


def codes_of(text: str) -> np.ndarray:
    return CODES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 0x2FFF)]


def encode(text: str, start: int, end: int, context: bool = True) -> np.ndarray:
    """A piece between its contexts, then padding."""
    out = np.zeros(WIDTH, np.uint8)
    end = min(end, start + BODY)
    codes = codes_of(text[max(0, start - LEFT) : end + RIGHT] if context else text[start:end])
    out[: len(codes)] = codes
    return out


@dataclass
class Network:
    """Embedding, one convolution, maximum over places, one output; then Platt scaling and a threshold."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0
    SPAN = 5

    @classmethod
    def new(cls, rng: np.random.Generator, dim: int = 8, filters: int = 24) -> Network:
        embed = rng.normal(0, 0.5, (N_CODES, dim))
        embed[0] = 0
        return cls(embed, rng.normal(0, (cls.SPAN * dim) ** -0.5, (cls.SPAN * dim, filters)), np.zeros(filters), np.append(rng.normal(0, 0.2, filters), 0.0))

    def _forward(self, x: np.ndarray) -> tuple:
        e = self.embed[x]
        windows = np.lib.stride_tricks.sliding_window_view(e, self.SPAN, axis=1).swapaxes(2, 3).reshape(len(x), WIDTH - self.SPAN + 1, -1)
        whole = np.lib.stride_tricks.sliding_window_view(x != 0, self.SPAN, axis=1).all(axis=2)  # no padding in it
        z = np.where(whole[:, :, None], windows @ self.conv + self.bias, -np.inf)
        best = z.argmax(axis=1)
        top = np.maximum(np.take_along_axis(z, best[:, None], axis=1)[:, 0], 0)
        return windows, best, top, top @ self.out[:-1] + self.out[-1]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[3] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def _scaled(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -50, 50)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self._scaled(self.logits(x))

    def range_top(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray, places: bool = False) -> Iterator[tuple[slice, np.ndarray, np.ndarray | None]]:
        """Of pieces with context codes[low:high], low ascending, SPAN to WIDTH long, some at a time: the largest value of each
        filter without its bias and, if wanted, the place where it is. Then the last seven bits of a value hold its place, which tells all
        windows of a piece apart, so that tables of ranges give both."""
        parts = self.conv.reshape(self.SPAN, -1, self.conv.shape[1])
        by = [(self.embed @ p).astype(np.float32) for p in parts]
        two = [(by[k][:, None] + by[k + 1][None]).reshape(N_CODES**2, -1) for k in (0, 2)]
        starts = np.arange(0, len(codes), BLOCK)
        cuts = np.searchsorted(low, np.append(starts, len(codes)))
        for at, i, j in zip(starts, cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            c = codes[at : at + BLOCK + WIDTH].astype(np.int32)
            pair = c[:-1] * N_CODES + c[1:]
            n = len(c) - self.SPAN + 1
            z = two[0].take(pair[:n], axis=0)
            z += two[1].take(pair[2 : n + 2], axis=0)
            z += by[4].take(c[4 : n + 4], axis=0)
            if places:
                bits = z.view(np.int32)
                bits &= ~127
                bits |= (np.arange(n, dtype=np.int32) & 127)[:, None]
            first, last = low[i:j] - at, high[i:j] - self.SPAN + 1 - at  # windows first to last - 1
            top, width, power = np.empty((j - i, z.shape[1]), np.float32), last - first, 1
            while True:
                now = (width >= power) & (width < 2 * power)
                if now.any():
                    top[now] = np.maximum(z[first[now]], z[last[now] - power])
                if not (width >= 2 * power).any():
                    break
                z, power = np.maximum(z[:-power], z[power:]), 2 * power  # z[p]: the maximum from p over `power` windows
            yield slice(i, j), top, at + first[:, None] + ((top.view(np.int32) - first[:, None]) & 127) if places else None

    def range_logits(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """As logits(), for pieces in a text."""
        out = np.zeros(len(low))
        for which, top, _ in self.range_top(codes, low, high):
            out[which] = np.maximum(top + self.bias, 0) @ self.out[:-1] + self.out[-1]
        return out

    def range_probability(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self._scaled(self.range_logits(codes, low, high))

    def _places(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """range_top() with places, by SUMMED_AT_ONCE pieces or somewhat more."""
        held, begin = [], 0
        for which, top, place in self.range_top(codes, low, high, True):
            held.append((top, place))
            if which.stop - begin >= SUMMED_AT_ONCE or which.stop == len(low):
                yield slice(begin, which.stop), *map(np.concatenate, zip(*held, strict=True))
                held, begin = [], which.stop

    def range_gradients(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Sums of the gradients of the log loss, a row a label: of embed, conv, bias and out, one after the other."""
        filters = self.conv.shape[1]
        by_code = np.zeros((self.SPAN, LABELS * N_CODES * filters))  # of what a character adds to a filter at each place of a window
        bias, out = np.zeros((LABELS, filters)), np.zeros((LABELS, filters + 1))
        for which, top, place in self._places(codes, low, high):
            top = np.maximum(top + self.bias, 0)
            of = label[which]
            d = 1 / (1 + np.exp(-np.clip(top @ self.out[:-1] + self.out[-1], -50, 50))) - (of == FINDING)
            dtop = np.outer(d, self.out[:-1]) * (top > 0)
            moving = np.flatnonzero(dtop)  # the others add nothing
            row, nth_filter = np.divmod(moving, filters)
            at, where, value = of[row] * (N_CODES * filters) + nth_filter, place.ravel().take(moving), dtop.ravel().take(moving)
            for nth in range(self.SPAN):
                by_code[nth] += np.bincount(at + codes.take(where + nth).astype(np.int64) * filters, value, by_code.shape[1])
            for c in np.unique(of):
                k = of == c
                bias[c] += dtop[k].sum(axis=0)
                out[c] += np.append(top[k].T @ d[k], d[k].sum())
        by_code = by_code.reshape(self.SPAN, LABELS, N_CODES, filters).swapaxes(0, 1)
        parts = self.conv.reshape(self.SPAN, -1, filters)
        embed = np.einsum("lscf,sdf->lcd", by_code, parts)
        embed[:, 0] = 0
        conv = np.einsum("lscf,cd->lsdf", by_code, self.embed)
        return np.concatenate([x.reshape(LABELS, -1) for x in (embed, conv, bias, out)], axis=1)

    def moved(self, step: np.ndarray) -> Network:
        """With step, laid out as the gradients are, taken from the weights."""
        parts = [self.embed, self.conv, self.bias, self.out]
        cuts = np.split(step, np.cumsum([p.size for p in parts])[:-1])
        return Network(*(p - c.reshape(p.shape) for p, c in zip(parts, cuts, strict=True)))

    def fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 12, batch: int = 64, rate: float = 0.01) -> None:
        """Adam on the log loss; classes weigh alike."""
        params = [self.embed, self.conv, self.bias, self.out]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                k = order[i : i + batch]
                windows, best, top, logit = self._forward(x[k])
                d = weight[k] * (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y[k]) / len(k)
                dtop = np.outer(d, self.out[:-1]) * (top > 0)
                picked = windows[np.arange(len(k))[:, None], best]  # sample, filter, span * dim
                dconv = np.einsum("bfs,bf->sf", picked, dtop)
                dpicked = (dtop[:, :, None] * self.conv.T[None]).reshape(len(k), -1, self.SPAN, self.embed.shape[1])
                dembed = np.zeros_like(self.embed)
                at = x[k][np.arange(len(k))[:, None, None], best[:, :, None] + np.arange(self.SPAN)]
                np.add.at(dembed, at.ravel(), dpicked.reshape(-1, self.embed.shape[1]))
                dembed[0] = 0
                t += 1
                for p, g, a, b in zip(params, (dembed, dconv, dtop.sum(axis=0), np.append(top.T @ d, d.sum())), m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.calibrate_counts(np.floor(self.logits(x) / GRID) * GRID, y, np.ones(len(y)))

    def calibrate_counts(self, s: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        """Platt scaling by Newton steps, then the largest threshold with the wanted recall: n pieces of class y have a logit of
        s to s + GRID."""
        w, most, found = np.zeros(2), np.abs(s).max() + 1e-9, n[y == 1].sum()
        s_ = np.stack([(s + GRID / 2) / most, np.ones(len(s))], axis=1)
        target = np.where(y == 1, (found + 1) / (found + 2), 1 / (n.sum() - found + 2))
        weight = n * np.where(y == 1, 0.5 / found, 0.5 / (n.sum() - found)) * 1e4  # classes weigh alike
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(s_ @ w, -50, 50)))
            w += np.linalg.solve((s_ * (weight * p * (1 - p))[:, None]).T @ s_ + 1e-3 * np.eye(2), s_.T @ (weight * (target - p)) - 1e-3 * w)
        self.slope, self.shift = w[0] / most, w[1]
        order = np.argsort(s[y == 1])
        below = np.cumsum(n[y == 1][order])
        self.threshold = float(self._scaled(s[y == 1][order][np.searchsorted(below, (1 - RECALL) * found, side="right")]))


def merged(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the text that spans cover, in order."""
    starts, ends = [], []
    for start, end, _ in sorted(spans):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _touches(starts: list[int], ends: list[int], start: int, end: int) -> bool:
    i = bisect_right(ends, start)
    return i < len(starts) and starts[i] < end


def labelled(text: str) -> list[tuple[int, int, int]]:
    """Pieces of candidates with their class. Pieces beside the span in a run that has one have none."""
    spans, found = merged(rule_spans(text)), []
    for start, end in candidates(text):
        near = _touches(*spans, start, end)
        for a, b in pieces(start, end):
            if near:
                if _touches(*spans, a, b):
                    found.append((a, b, FINDING))
            elif _touches(*spans, a - LEFT, b + RIGHT):
                found.append((a, b, BESIDE))
            else:
                found.append((a, b, DIGITS if any(map(str.isdigit, text[a:b])) else PLAIN if text[a + 1 : b].islower() else CAPITALS))
    return found


def drawn(size: int, rng: np.random.Generator) -> np.ndarray:
    """A key of one of FORMS, as codes."""
    return rng.choice([CODES[ord(c)] for c in FORMS[rng.integers(len(FORMS))]], size)


def _rows(parts: Iterable[tuple[np.ndarray, ...]]) -> np.ndarray:
    rows = [np.concatenate(p) for p in parts]
    return np.stack([np.pad(r, (0, WIDTH - len(r))) for r in rows]).astype(np.uint8) if rows else np.zeros((0, WIDTH), np.uint8)


def variants(sizes: list[int], others: list[tuple[np.ndarray, ...]], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the given sizes between the context of ordinary candidates, and as many candidates beside keys."""
    pick = lambda: others[rng.integers(len(others))]
    space = np.array([CODES[32]], np.uint8)
    keys = _rows((o[0], drawn(n, rng), o[2]) for n, o in ((n, pick()) for n in sizes))
    before = lambda: np.concatenate([drawn(LEFT, rng), space])[-LEFT:]
    after = lambda: np.concatenate([space, drawn(RIGHT, rng)])[:RIGHT]
    return keys, _rows((before(), o[1], o[2]) if rng.random() < 0.7 else (o[0], o[1], after()) for o in (pick() for _ in sizes))


def placed(texts: list[str]) -> tuple[np.ndarray, ...]:
    """The codes of all texts, a 0 after each, where they begin, and the start and end of all candidates."""
    parts = [codes_of(t) for t in texts]
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    codes = np.zeros(begins[-1], np.uint8)
    for at, p in zip(begins, parts, strict=False):
        codes[at : at + len(p)] = p
    step = np.diff(IN_RUN[codes].astype(np.int8), prepend=0)
    start, end = np.nonzero(step == 1)[0], np.nonzero(step == -1)[0]
    keep = end - start >= MIN_CANDIDATE
    return codes, begins, start[keep], end[keep]


def span_touches(begins: np.ndarray, bases: list[list[tuple[int, int, str]]]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Which of the ranges (start, end) any span of the bases overlaps."""
    spans = sorted((begins[i] + s, begins[i] + e) for i, base in enumerate(bases) for s, e, _ in base)
    starts = np.array([s for s, _ in spans], np.int64)
    ends = np.concatenate([[-1], np.maximum.accumulate(np.array([e for _, e in spans], np.int64))])
    return lambda start, end: ends[np.searchsorted(starts, end)] > start


def cut(begins: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The pieces of candidates: number of the candidate, start, end, and start and end with context; each candidate's first piece."""
    n = np.maximum(0, -((BODY - (end - start)) // STEP)) + 1
    of = np.repeat(np.arange(len(n)), n)
    firsts = np.cumsum(n) - n
    a = np.minimum(start[of] + STEP * (np.arange(len(of)) - firsts[of]), np.maximum(start, end - BODY)[of])
    b = np.minimum(a + BODY, end[of])
    nth = (np.searchsorted(begins, start, side="right") - 1)[of]
    return of, a, b, np.maximum(a - LEFT, begins[nth]), np.minimum(b + RIGHT, begins[nth + 1] - 1), firsts


def all_labelled(texts: list[str]) -> tuple[np.ndarray, ...]:
    """As labelled(), of many texts: their codes and where they begin; start and end of all pieces, the same with context, and their class."""
    codes, begins, start, end = placed(texts)
    touches = span_touches(begins, [rule_spans(t) for t in texts])
    of, a, b, low, high, _ = cut(begins, start, end)
    count = lambda first, last: np.append(0, np.cumsum((codes >= CODES[ord(first)]) & (codes <= CODES[ord(last)])))
    digits, capitals, small = count("0", "9"), count("A", "Z"), count("a", "z")
    lower = (capitals[b] == capitals[a + 1]) & (small[b] > small[a + 1])
    label = np.where(digits[b] > digits[a], DIGITS, np.where(lower, PLAIN, CAPITALS))
    label[touches(a - LEFT, b + RIGHT) & touches(low, high)] = BESIDE
    near, here = touches(start, end)[of], touches(a, b)
    label[near & here] = FINDING
    keep = ~near | here
    return codes, begins, *(x[keep] for x in (a, b, low, high, label))


def chances(texts: list[str], bases: list[list[tuple[int, int, str]]], network: Network) -> tuple[np.ndarray, ...]:
    """Text number, start, end and probability of all candidates that no span of the bases overlaps."""
    codes, begins, start, end = placed(texts)
    keep = ~span_touches(begins, bases)(start, end)
    start, end = start[keep], end[keep]
    nth = np.searchsorted(begins, start, side="right") - 1
    if not len(start):
        return nth, start, end, np.zeros(0)
    _, _, _, low, high, firsts = cut(begins, start, end)
    p = np.maximum.reduceat(network.range_probability(codes, low, high), firsts)
    return nth, start - begins[nth], end - begins[nth], p


def refined(rows: DataFrame, network: Network) -> Network:
    """network, moved by Adam in STEPS steps. Each takes the gradient over all pieces of a part of the training documents
    of rows (text, order); together the parts are all of them. Findings weigh as much as all else, and each other class alike."""
    m = v = 0.0
    for t in range(1, STEPS + 1):
        use = network

        def gradients(batches: Iterator[pd.DataFrame], use: Network = use) -> Iterator[pd.DataFrame]:
            total, n = 0.0, np.zeros(LABELS, np.int64)
            for b in batches:
                for at in range(0, len(b), TEXTS_AT_ONCE):
                    codes, _, _, _, low, high, label = all_labelled(b["text"].iloc[at : at + TEXTS_AT_ONCE].tolist())
                    total = total + use.range_gradients(codes, low, high, label)
                    n += np.bincount(label, minlength=LABELS)
            for c in np.flatnonzero(n):
                yield pd.DataFrame({"label": c, "at": np.arange(total.shape[1] + 1), "value": np.append(np.round(total[c] / GRAIN), n[c]).astype(np.int64)})

        part = rows.filter((F.pmod("order", F.lit(3)) != 0) & (F.pmod(F.xxhash64("order"), F.lit(STEPS)) == t - 1))
        sums = part.mapInPandas(gradients, "label int, at int, value long").groupBy("label", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("double").alias("value"))
        found = {int(c): x.sort_values("at")["value"].to_numpy() for c, x in sums.toPandas().groupby("label")}  # LABELS times the weights, whatever the table's size
        means = {c: x[:-1] * GRAIN / x[-1] for c, x in found.items()}
        others = [x for c, x in means.items() if c != FINDING]
        if FINDING not in means or not others:
            continue
        g = (means[FINDING] + sum(others) / len(others)) / 2
        m, v = m + 0.1 * (g - m), v + 0.001 * (g * g - v)
        network = network.moved(RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8))
    return network


def held_out(rows: DataFrame, network: Network) -> pd.DataFrame:
    """How many pieces (n) of all held-out documents have a logit of bin * GRID and up, by class y; also VARIANTS of
    each finding between contexts of its own document, and as many candidates beside such keys."""

    def logits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = []
            for first in range(0, len(b), TEXTS_AT_ONCE):
                part = b.iloc[first : first + TEXTS_AT_ONCE]
                codes, begins, a, e, low, high, label = all_labelled(part["text"].tolist())
                s, y = [network.range_logits(codes, low, high)], [label == FINDING]
                of = np.searchsorted(begins, a, side="right") - 1
                for nth in np.unique(of[label == FINDING]):
                    here = np.arange(*np.searchsorted(of, [nth, nth + 1]))
                    others = [(codes[low[i] : a[i]], codes[a[i] : e[i]], codes[e[i] : high[i]]) for i in here[label[here] < BESIDE][:100]]
                    others = others or [(codes[:0], np.full(MIN_CANDIDATE, CODES[ord("a")]), codes[:0])]
                    rng = np.random.default_rng(int(part["order"].iloc[nth]) & (1 << 63) - 1)
                    keys, beside = variants(np.repeat((e - a)[here[label[here] == FINDING]], VARIANTS).tolist(), others, rng)
                    s += [network.logits(keys), network.logits(beside)]
                    y += [np.ones(len(keys), bool), np.zeros(len(beside), bool)]
                seen.append(np.floor(np.concatenate(s) / GRID).astype(np.int64) * 2 + np.concatenate(y))
            found, n = np.unique(np.concatenate([np.zeros(0, np.int64), *seen]), return_counts=True)
            yield pd.DataFrame({"y": found % 2 == 1, "bin": found // 2, "n": n})

    return rows.filter(F.pmod("order", F.lit(3)) == 0).mapInPandas(logits, "y boolean, bin long, n long").groupBy("y", "bin").agg(F.sum("n").alias("n")).orderBy("y", "bin").toPandas()


def train(docs: DataFrame, seed: int = 0) -> Network:
    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        # Of each class and part the MAX_CANDIDATES smallest by hash of piece and context are all that can be chosen.
        kept: dict[tuple[bool, int], dict[bytes, int]] = {(h, c): {} for h in (False, True) for c in range(5)}
        more, most = {}, dict.fromkeys(kept, 1 << 64)
        for b in batches:
            for text, h in zip(b["text"], b["order"], strict=True):
                if h > last and not rule_spans(text):
                    continue
                for s, e, label in labelled(text):
                    key = (bool(h % 3 == 0), label)
                    order = xxh64_intdigest(text[max(0, s - LEFT) : e + RIGHT].encode("utf-8", "surrogatepass"))
                    if order < most[key]:
                        full = encode(text, s, e).tobytes()
                        kept[key][full], more[full] = min(order, kept[key].get(full, order)), (encode(text, s, e, False).tobytes(), min(s, LEFT), e - s)
                        if len(kept[key]) >= 2 * MAX_CANDIDATES:
                            kept[key] = dict(sorted(kept[key].items(), key=lambda x: (x[1], x[0]))[:MAX_CANDIDATES])
                            most[key] = max(kept[key].values())
        rows = [(h, c, full, *more[full], order - (1 << 63)) for (h, c), found in kept.items() for full, order in found.items()]
        yield pd.DataFrame(rows, columns=["held", "label", "full", "bare", "left", "size", "order"])

    rows = every = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null").withColumn("order", F.xxhash64("text"))
    last = rows.select("order").orderBy("order").limit(MAX_DOCS).agg(F.max("order")).first()[0]
    rng, network = np.random.default_rng(seed), Network.new(np.random.default_rng(seed))
    if last is None:
        return network
    found = rows.filter(F.col("order") <= last).dropDuplicates(["order"]).unionByName(rows.filter(F.col("order") > last))
    found = found.mapInPandas(gather, "held boolean, label int, full binary, bare binary, left int, size int, order long")
    # What is a finding anywhere counts as one.
    found = found.groupBy("full").agg(F.min("held").alias("held"), F.max("label").alias("label"), *[F.min(c).alias(c) for c in ("bare", "left", "size", "order")])
    found = materialize(found, "secrets-pieces")
    parts = [found.filter((F.col("label") == c) & (F.col("held") == h)).orderBy("order", "full").limit(MAX_CANDIDATES) for c in range(5) for h in (False, True)]
    rows = reduce(DataFrame.unionByName, parts).toPandas().sort_values("full")
    discard(found)
    held, y = rows["held"].to_numpy(bool), (rows["label"] == FINDING).to_numpy(np.float64)
    full, bare = (np.frombuffer(b"".join(rows[c]), np.uint8).reshape(-1, WIDTH) for c in ("full", "bare"))
    if min(y[~held].sum(), (1 - y[~held]).sum()) < 5:
        return network
    train_on = ~held
    parts = [(x[:n], x[n : n + m], x[n + m :][x[n + m :] > 0]) for x, n, m in zip(full, rows["left"], rows["size"], strict=True)]
    sizes = [len(parts[i][1]) for i in np.flatnonzero(train_on & (y == 1))] * VARIANTS
    keys, beside = variants(sizes, [parts[i] for i in np.flatnonzero(train_on & (y == 0))], rng)
    x, classes = [full[train_on], keys, beside, bare[train_on]], [y[train_on], np.ones(len(keys)), np.zeros(len(beside)), y[train_on]]
    network.fit(np.concatenate(x), np.concatenate(classes), rng)
    network = refined(every, network)
    found = held_out(every, network)
    y, n = found["y"].to_numpy(bool), found["n"].to_numpy(np.float64)
    if min(n[y].sum(), n[~y].sum()) < 5:
        return network
    network.calibrate_counts(found["bin"].to_numpy(np.float64) * GRID, y.astype(int), n)
    return network


def scan(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_cnn, base_sha256 and spans of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b["text"]]
            out, more = list(map(rule_spans, texts)), {}
            for at in range(0, len(texts) if network.threshold <= 1 else 0, 500):
                nth, start, end, p = chances(texts[at : at + 500], out[at : at + 500], network)
                for i in np.nonzero(p >= network.threshold)[0]:
                    more.setdefault(at + int(nth[i]), []).append((int(start[i]), int(end[i]), "cnn"))
            rows = []
            for nth, base in enumerate(out):
                say = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))
                count = {k: sum(x[2] == k for x in base) for k in KINDS}
                added = more.get(nth, [])
                rows.append((count["assign"], count["access"], count["hex"], len(added), hashlib.sha256(say(base).encode()).hexdigest(), say([*base, *added])))
            done = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_cnn", "base_sha256", "spans"])
            done.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield done

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInPandas(run, "doc_id string, n_assign long, n_access long, n_hex long, n_cnn long, base_sha256 string, spans string")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))

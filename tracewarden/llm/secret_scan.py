"""Secrets in texts: patterns of three kinds, and a character convolutional network over further candidates.

Base spans are matches of `assign`, `access` and `hex` (the patterns below, leftmost and non-overlapping
within a kind, over code points); they are found whatever the network says. A further candidate is a
run of 16 or more characters that keys are written in, with a letter and a digit, that overlaps no base
span. The network reads all characters of the candidate, `LEFT` before and `RIGHT` after it: embedding,
convolution, maximum and mean over the candidate and maximum over each side, two dense layers. It is
trained in numpy on labelled findings; a part of these that it isn't fitted on calibrates its scores
(Platt) and sets for each shape of candidate the highest threshold that keeps the wanted recall.
Candidates at or above it are added as kind `net`.

A null or empty text has no spans. Texts and candidates of any length are read whole. Repeated rows get
equal results. Without labelled findings of both kinds nothing is added. At most `FIT_ROWS` findings are
fitted on, chosen by a hash. Other columns stay out; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 6000
LEFT, RIGHT = 32, 16
RECALL = 0.95
KINDS = ["assign", "access", "hex", "net"]
EMBED, FILTERS, WIDTH, HIDDEN = 8, 24, 5, 32
#: Characters that one step of the network works on.
POSITIONS = 1 << 16
_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_KEYWORD = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
ASSIGN = re.compile(rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~-]{16,}")
_LETTER, _DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")
_OTHER, _PAD, _CODES = 128, 129, 130
Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the matches of the three patterns, in order."""
    # `[0-9a-f]+` of 24 or more is a whole run, so it equals `[0-9a-f]{24,}`
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Further runs that may be secrets, without punctuation at their ends."""
    out = []
    for m in CANDIDATE.finditer(text):
        run = m.group()
        s = m.start() + len(run) - len(run.lstrip("+/_.=~-"))
        e = m.end() - (len(run) - len(run.rstrip("+/_.~-")))
        if e - s >= 16 and _LETTER.search(text, s, e) and _DIGIT.search(text, s, e) and all(b <= s or a >= e for a, _, b in taken):
            out.append((s, e))
    return out


def shape(value: str) -> int:
    """0: hexadecimal digits, 1: letters and digits, 2: others too."""
    if not value.isalnum():
        return 2
    return 0 if all(c in "0123456789abcdefABCDEF" for c in value) else 1


def codes(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(x < 128, x, _OTHER).astype(np.int64)


def window(text: str, s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a candidate with its context, and the place (0 left, 1 candidate, 2 right) of each; no place is empty."""
    left, right = text[max(0, s - LEFT) : s], text[e : e + RIGHT]
    x = np.concatenate([[_PAD, _PAD], codes(left), codes(text[s:e]), codes(right), [_PAD, _PAD]])
    return x, np.repeat([0, 1, 2], [len(left) + 2, e - s, len(right) + 2])


@dataclass
class Network:
    weights: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    thresholds: list[float] = field(default_factory=lambda: [2.0] * 3)


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    spread = lambda *size, k: (rng.normal(0, 1, size) * np.sqrt(2 / k)).astype(np.float32)
    return {
        "embed": spread(_CODES, EMBED, k=EMBED),
        "filters": spread(WIDTH * EMBED, FILTERS, k=WIDTH * EMBED),
        "filters_bias": np.zeros(FILTERS, np.float32),
        "hidden": spread(4 * FILTERS, HIDDEN, k=4 * FILTERS),
        "hidden_bias": np.zeros(HIDDEN, np.float32),
        "out": spread(HIDDEN, 1, k=HIDDEN),
        "out_bias": np.zeros(1, np.float32),
    }


def _shifted(x: np.ndarray, w: dict) -> np.ndarray:
    """The embeddings around each position side by side."""
    side = WIDTH // 2
    e = w["embed"][np.pad(x, side, constant_values=_PAD)]
    return np.concatenate([e[k : k + len(x)] for k in range(WIDTH)], 1)


def _convolved(x: np.ndarray, w: dict) -> tuple[np.ndarray, np.ndarray]:
    cols = _shifted(x, w)
    return cols, np.maximum(cols @ w["filters"] + w["filters_bias"], 0)


def _pooled(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of windows that lie one after the other; `ends` are those of all three places of each."""
    starts = np.concatenate([[0], ends[:-1]])
    most = np.maximum.reduceat(h, starts).reshape(-1, 3, FILTERS)
    mean = (np.add.reduceat(h, starts) / (ends - starts)[:, None]).reshape(-1, 3, FILTERS)[:, 1]
    return np.concatenate([most.reshape(len(most), -1), mean], 1), most, starts


def _dense(f: np.ndarray, w: dict) -> tuple[np.ndarray, np.ndarray]:
    h = np.maximum(f @ w["hidden"] + w["hidden_bias"], 0)
    return h, (h @ w["out"] + w["out_bias"])[:, 0]


def _ends(windows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.cumsum([n for _, place in windows for n in np.bincount(place, minlength=3)])


def raw_scores(windows: list[tuple[np.ndarray, np.ndarray]], w: dict) -> np.ndarray:
    """The network's output for every window, in steps of bounded size; a long candidate is pooled piece by piece."""
    out, held, size = [], [], 0

    def flush():
        if held:
            f, _, _ = _pooled(_convolved(np.concatenate([x for x, _ in held]), w)[1], _ends(held))
            out.append(_dense(f, w)[1])
            held.clear()

    for x, place in windows:
        if len(x) > POSITIONS:
            flush()
            size = 0
            out.append(_dense(_long(x, place, w)[None], w)[1])
            continue
        if size + len(x) > POSITIONS:
            flush()
            size = 0
        held.append((x, place))
        size += len(x)
    flush()
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def _long(x: np.ndarray, place: np.ndarray, w: dict) -> np.ndarray:
    most, total, side = np.zeros((3, FILTERS), np.float32), np.zeros(FILTERS), WIDTH // 2
    for at in range(0, len(x), POSITIONS):
        end = min(len(x), at + POSITIONS)
        lead = min(side, at)
        h = _convolved(x[at - lead : end + side], w)[1][lead : lead + end - at]
        for k in range(3):
            own = h[place[at:end] == k]
            most[k] = np.maximum(most[k], own.max(0, initial=0))
            total += own.sum(0) if k == 1 else 0
    return np.concatenate([most.ravel(), total / (place == 1).sum()]).astype(np.float32)


def _gradients(windows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, w: dict) -> dict[str, np.ndarray]:
    x, ends = np.concatenate([a for a, _ in windows]), _ends(windows)
    cols, h = _convolved(x, w)
    f, most, starts = _pooled(h, ends)
    d, s = _dense(f, w)
    g = {}
    ds = ((1 / (1 + np.exp(-s)) - y) / len(y)).astype(np.float32)[:, None]
    g["out"], g["out_bias"] = d.T @ ds, ds.sum(0)
    dd = (ds @ w["out"].T) * (d > 0)
    g["hidden"], g["hidden_bias"] = f.T @ dd, dd.sum(0)
    df = dd @ w["hidden"].T
    size = ends - starts
    own = np.repeat(np.arange(len(size)), size)
    flat = most.reshape(-1, FILTERS)
    top = (h == flat[own]) & (h > 0)
    share = df[:, : 3 * FILTERS].reshape(-1, FILTERS) / np.maximum(np.add.reduceat(top, starts, dtype=np.float32), 1)
    dh = top * share[own]
    mean = np.zeros_like(share)
    mean[1::3] = df[:, 3 * FILTERS :] / size[1::3, None]
    dh += mean[own] * (h > 0)
    g["filters"], g["filters_bias"] = cols.T @ dh, dh.sum(0)
    de = (dh @ w["filters"].T).reshape(len(x), WIDTH, EMBED)
    padded = np.pad(x, WIDTH // 2, constant_values=_PAD)
    rows = np.concatenate([padded[k : k + len(x)] for k in range(WIDTH)])
    values = de.transpose(1, 0, 2).reshape(-1, EMBED)
    g["embed"] = np.stack([np.bincount(rows, values[:, k], _CODES) for k in range(EMBED)], 1).astype(np.float32)
    return g


def fit(windows: list, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.004, seed: int = 1) -> dict[str, np.ndarray]:
    """Weights by Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    w = _start(rng)
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            pick = order[at : at + batch]
            g = _gradients([windows[i] for i in pick], y[pick], w)
            t += 1
            step = rate * 0.5 ** (3 * epoch / epochs)
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def platt(raw: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift that make the scores probabilities (Newton steps, with Platt's softened targets)."""
    good, bad = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([raw.astype(float), np.ones(len(raw))], 1)
    a = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        a = a - np.clip(np.linalg.solve(hessian, x.T @ (p - t)), -2, 2)
    return float(a[0]), float(a[1])


def thresholds(p: np.ndarray, y: np.ndarray, shapes: np.ndarray, recall: float, few: int = 20) -> list[float]:
    """For each shape the highest score that at least `recall` of its secrets reach; shapes of few secrets share one."""
    highest = lambda x: float(np.sort(x)[int((1 - recall) * len(x))])
    return [highest(p[(y > 0) & (shapes == k)]) if ((y > 0) & (shapes == k)).sum() >= few else highest(p[y > 0]) for k in range(3)]


def calibrated(raw: np.ndarray, net: Network) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(net.slope * raw + net.shift, -30, 30)))


def split(findings: DataFrame, rows: int = FIT_ROWS) -> list[tuple[str, int, int, bool, int]]:
    """At most `rows` findings with the part of each: 0 to 5 to fit on, 6 and 7 to calibrate with, 8 and 9 to test."""
    whole = findings.select("text", "start", "end", "secret").where("text IS NOT NULL AND secret IS NOT NULL AND start >= 0 AND start < end AND end <= length(text)")
    part = F.pmod(F.xxhash64(F.lit(17), "text"), F.lit(10)).cast("int")
    return [tuple(r) for r in whole.withColumn("part", part).orderBy(F.xxhash64(F.lit(19), "text"), *whole.columns).limit(rows).collect()]


def train(findings: DataFrame, rows: int = FIT_ROWS, recall: float = RECALL) -> Network | None:
    """The network with its calibration and thresholds; None if secrets or harmless strings are missing."""
    found = split(findings, rows)
    y = np.array([r[3] for r in found], np.float32)
    part = np.array([r[4] for r in found], int)
    fitted, rest = part < 6, (part == 6) | (part == 7)
    if any(len(np.unique(y[k])) < 2 for k in (fitted, rest)):
        return None
    windows = [window(*r[:3]) for r in found]
    pick = lambda k: [windows[i] for i in np.flatnonzero(k)]
    w = fit(pick(fitted), y[fitted])
    raw = raw_scores(pick(rest), w)
    net = Network(w, *platt(raw, y[rest]))
    shapes = np.array([shape(t[s:e]) for (t, s, e, *_), k in zip(found, rest) if k])
    net.thresholds = thresholds(calibrated(raw, net), y[rest], shapes, recall)
    return net


def spans(texts: list[str | None], net: Network | None) -> Iterator[list[Span]]:
    """All spans of each text: the base ones and those that the network adds."""
    base = [base_spans(t or "") for t in texts]
    if net is None:
        yield from base
        return
    more = [(i, s, e) for i, t in enumerate(texts) if t for s, e in candidates(t, base[i])]
    added: dict[int, list[Span]] = {}
    step = 4096
    for at in range(0, len(more), step):
        some = more[at : at + step]
        p = calibrated(raw_scores([window(texts[i], s, e) for i, s, e in some], net.weights), net)
        for (i, s, e), v in zip(some, p.tolist()):
            if v >= net.thresholds[shape(texts[i][s:e])]:
                added.setdefault(i, []).append((s, 3, e))
    for i, found in enumerate(base):
        yield sorted(found + added[i]) if i in added else found


def scan(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id and spans (kind, start, end) of every row, by start and then by kind."""

    def run(batches):
        for b in batches:
            flat, sizes = [], [0]
            for found in spans(b.column("text").to_pylist(), net):
                flat += found
                sizes.append(len(found))
            items = pa.StructArray.from_arrays([pa.array([KINDS[k] for _, k, _ in flat], pa.string()), pa.array([s for s, _, _ in flat], pa.int32()), pa.array([e for _, _, e in flat], pa.int32())], ["kind", "start", "end"])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), items)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: int, end: int>>")

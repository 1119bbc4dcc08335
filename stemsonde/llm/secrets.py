"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

*Base.* Three kinds of spans by pattern, leftmost and not overlapping within a kind; see PATTERNS. They always stay.

*Candidates* are runs of 16 and more characters that keys are written with; each is scored with its surroundings
(``LEFT`` characters before, ``RIGHT`` behind). One longer than ``BODY`` is scored in overlapping pieces and has the
score of its best. Of a candidate that reaches the threshold the parts that no base span covers are spans of kind
``net``.

*The network*: character embeddings, one convolution, rectifier, maximum over the window and mean over the candidate, a
logistic unit; trained by Adam in numpy. *Labelled findings*: the distinct pieces of every candidate of every text,
labelled by whether a base span covers a candidate they come from, and generated keys and harmless strings, put into their
surroundings. A finding without a base span may be a secret of another kind: a first network, trained without these, says
which are likelier keys than not, and those are left out; the others count as harmless. A fifth is set aside.

*Training on all of them*: findings are dealt by hash into shards of about ``SHARD``, each with generated strings of its
own. All start from one network that has learnt generated strings alone; in each of ``ROUNDS`` every shard trains it on its
rows in a task, and the mean of what they come to, added up in whole numbers, starts the next. No row reaches the driver,
and the network depends on the findings but not on their order or partitions. *Calibration*: scores are those of a
logistic fit (slope and shift of the log odds, which lie on a grid of ``GRID`` parts) to counts of all set-aside rows by
log odds. *Threshold*: the greatest that finds ``RECALL`` of all set-aside keys, whatever it is; the precision on the
set-aside rows that it leaves is ``Network.precision``.

Defined cases: null text counts as empty: no spans, the hash of the empty string. Repeated rows get equal results; a
null doc_id is carried along. Columns other than doc_id and text are not read. On an empty table the network is
trained on generated strings alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, columns_of, slices, stored

# The patterns of the contract and the least lengths of what they find.
PATTERNS = {
    "assign": (re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
KINDS = (*PATTERNS, "net")
HINTS = ("password", "passwd", "secret", "token", "api")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-][A-Za-z0-9+/_=.-]{14,}[A-Za-z0-9+/_=-]")

LEFT, BODY, RIGHT = 24, 48, 8
EMBED, WIDTH, FILTERS = 8, 5, 24
SHARD, ROUNDS, GENERATED, STEPS, BATCH = 10_000, 2, 8000, 1200, 64
RECALL, GRID = 0.99, 1024
MASK = "[SECRET]"
_CODE = np.full(0x110000, 96, np.int16)  # printable ASCII apart, other characters together, 97 outside the text
_CODE[32:127] = np.arange(95)
_CODE[[9, 10, 13]] = 95
_PAD, _SIZE = 97, 98

Span = tuple[int, int, int]  # start, number of the kind, end


def base_spans(text: str) -> list[Span]:
    """Spans of the three patterns, in order of start and kind."""
    out: list[Span] = []
    low = text.lower()
    for kind, (name, (pattern, group, least)) in enumerate(PATTERNS.items()):
        if name == "assign" and not any(x in low for x in HINTS) or name == "access" and "AKIA" not in text:
            continue
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def pieces(text: str, start: int, end: int) -> list[tuple[str, str, str]]:
    """What the network sees of a candidate: text before, up to BODY characters of it, text behind."""
    out = []
    for at in range(start, max(start + 1, end - BODY // 2), BODY // 2) if end - start > BODY else (start,):
        to = min(end, at + BODY)
        out.append((text[max(0, at - LEFT): at], text[at:to], text[to: to + RIGHT]))
    return out


def encode(rows: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the window (rows x LEFT + BODY + RIGHT) and which places the candidate has."""
    lined = "".join(a.rjust(LEFT, "\0") + b.ljust(BODY, "\0") + c.ljust(RIGHT, "\0") for a, b, c in rows)
    points = np.frombuffer(lined.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), -1)
    code = np.where(points == 0, _PAD, _CODE[points])
    body = np.zeros(code.shape, bool)
    body[:, LEFT: LEFT + BODY] = np.arange(BODY) < np.array([len(b) for _, b, _ in rows])[:, None]
    return code, body


def _odds(score: np.ndarray) -> np.ndarray:
    """Log odds on the grid."""
    score = np.clip(np.asarray(score, np.float64), 1e-12, 1 - 1e-12)
    return np.round((np.log(score) - np.log1p(-score)) * GRID) / GRID


@dataclass
class Network:
    """Weights: embeddings, convolution, its bias, output weights, output bias; slope and shift of the calibration; the
    threshold and its precision on the set-aside rows; how many findings there were."""

    weights: list[np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    precision: float = float("nan")
    findings: int = 0

    def forward(self, code: np.ndarray, body: np.ndarray):
        emb, conv, bias, out, shift = self.weights
        x = emb[code]
        n, length, _ = x.shape
        wide = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, length - WIDTH + 1, -1)
        z = wide @ conv + bias
        a = np.maximum(z, 0)
        mid = body[:, WIDTH // 2: length - WIDTH // 2].astype(np.float32)
        mid /= np.maximum(mid.sum(axis=1, keepdims=True), 1)
        top = a.argmax(axis=1)
        feature = np.concatenate([a.max(axis=1), (a * mid[:, :, None]).sum(axis=1)], axis=1)
        score = 1 / (1 + np.exp(-np.clip(feature @ out + shift[0], -30, 30)))
        return score, (wide, a, mid, top, feature)

    def scores(self, rows: list[tuple[str, str, str]], step: int = 512) -> np.ndarray:
        return self.calibrated(self.raw(rows, step))

    def raw(self, rows: list[tuple[str, str, str]], step: int = 512) -> np.ndarray:
        got = [self.forward(*encode(rows[i: i + step]))[0] for i in range(0, len(rows), step)]
        return np.concatenate(got) if got else np.zeros(0)

    def calibrated(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _odds(score) + self.shift, -30, 30)))

    def gradients(self, code: np.ndarray, body: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        emb, conv, _, out, _ = self.weights
        score, (wide, a, mid, top, feature) = self.forward(code, body)
        g = (score - y) / len(y)
        back = g[:, None] * out[None]
        da = mid[:, :, None] * back[:, None, FILTERS:]
        da[np.arange(len(y))[:, None], top, np.arange(FILTERS)[None]] += back[:, :FILTERS]
        dz = da * (a > 0)
        dwide = (dz @ conv.T).reshape(*dz.shape[:2], WIDTH, EMBED)
        demb = np.zeros_like(emb)
        place = np.stack([code[:, i: i + dz.shape[1]] for i in range(WIDTH)], axis=2).reshape(-1)
        for d in range(EMBED):
            demb[:, d] = np.bincount(place, dwide[..., d].reshape(-1), _SIZE)
        return [demb, wide.reshape(-1, WIDTH * EMBED).T @ dz.reshape(-1, FILTERS), dz.sum(axis=(0, 1)), feature.T @ g, np.array([g.sum()])]


def _logistic(x: np.ndarray, keys: np.ndarray, others: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit by Newton steps to counts of keys and others at each x, with Platt's smoothed
    targets; a slope that is not positive, which would turn the order round, leaves the scores as they are."""
    k, m = int(keys.sum()), int(others.sum())
    if not (k and m):
        return 1.0, 0.0
    n, design, w = keys + others, np.stack([x, np.ones(len(x))], axis=1), np.zeros(2)
    y = keys * ((k + 1) / (k + 2)) + others * (1 / (m + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        w = w - np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + 1e-6 * np.eye(2), design.T @ (n * p - y))
    return (float(w[0]), float(w[1])) if np.isfinite(w).all() and w[0] > 0 else (1.0, 0.0)


def _settle(net: Network, x: np.ndarray, keys: np.ndarray, others: np.ndarray) -> None:
    """Calibration, threshold and precision from counts of the set-aside rows at each of their log odds, ascending."""
    net.slope, net.shift = _logistic(x, keys, others)
    if keys.sum():
        at = int(np.searchsorted(np.cumsum(keys), int((1 - RECALL) * int(keys.sum())), "right"))
        net.threshold = float(net.calibrated(1 / (1 + np.exp(-x[at: at + 1])))[0])
        net.precision = float(keys[at:].sum() / (keys[at:].sum() + others[at:].sum()))


def _blank(rng: np.random.Generator) -> Network:
    start = [rng.normal(0, 0.3, (_SIZE, EMBED)), rng.normal(0, 0.2, (WIDTH * EMBED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, 2 * FILTERS), np.zeros(1)]
    return Network([w.astype(np.float32) for w in start])


def _learn(net: Network, rows: list[tuple[str, str, str]], y: np.ndarray, rng: np.random.Generator, part: int = 0, parts: int = 1) -> None:
    """Adam over the rows; the rate falls over all parts. About STEPS steps altogether, but each row once in each at least."""
    code, body = encode(rows)
    steps, t = STEPS // parts, 0
    first, second = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    for _ in range(max(1, steps * BATCH // max(1, len(y)))):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            t += 1
            rate = 0.006 * max(0.05, 1 - (part * steps + t) / STEPS)
            for w, g, m, v in zip(net.weights, net.gradients(code[at], body[at], y[at]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def fit(rows: list[tuple[str, str, str]], labels: list[int], seed: int = 11) -> Network:
    """Train on four fifths of the findings and set the threshold on the rest."""
    rng = np.random.default_rng(seed)
    y, net = np.array(labels, np.float32), _blank(rng)
    aside = np.arange(len(y)) % 5 == 0
    _learn(net, [rows[i] for i in np.flatnonzero(~aside)], y[~aside], rng)
    x, at = np.unique(_odds(net.raw([rows[i] for i in np.flatnonzero(aside)])), return_inverse=True)
    truth = y[aside] == 1
    _settle(net, x, np.bincount(at[truth], minlength=len(x)), np.bincount(at[~truth], minlength=len(x)))
    return net


def generated(rng: np.random.Generator, around: list[tuple[str, str]], n: int) -> tuple[list[tuple[str, str, str]], list[int]]:
    """Keys and harmless strings in the given surroundings, half each."""
    made = _strings(rng, n)
    return _placed(rng, made, around), [i % 2 for i in range(n)]


def _strings(rng: np.random.Generator, n: int) -> list[tuple[str, str, str, str]]:
    """A word before, what leads to a key, the string, a word behind; every other one is a key."""
    pick = lambda alphabet, k: "".join([alphabet[i] for i in rng.integers(0, len(alphabet), k).tolist()])
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    upper = lower.upper()
    before = ["key: ", "secret_key=", "auth ", "Bearer ", "credential = \"", "pwd='", "private: ", "access: "]
    word = lambda: pick(lower, int(rng.integers(3, 10)))
    words = lambda by, m: by.join(word() for _ in range(m))
    keys = (lambda k: pick("0123456789abcdef", k), lambda k: pick(lower + upper + digits, k),
            lambda k: pick(lower + upper + digits + "+/", k) + "=" * int(rng.integers(3)),
            lambda k: pick(lower, 2) + "_" + pick(lower, 4) + "_" + pick(lower + upper + digits, k), lambda k: pick(upper + digits, k))
    harmless = (lambda m: pick(lower, int(rng.integers(16, 30))), lambda m: words("-", m + 2), lambda m: words("_", m + 2), lambda m: words("/", m + 2) + ".html",
                lambda m: pick(digits, int(rng.integers(16, 24))), lambda m: pick("-=_", 1) * int(rng.integers(16, 60)), lambda m: words(".", m + 1) + ".example.com",
                lambda m: "-".join(pick(digits, 4) for _ in range(m + 2)), lambda m: "".join(word().capitalize() for _ in range(m + 2)), lambda m: pick(upper, int(rng.integers(16, 30))))
    out = []
    for i in range(n):
        lead = ""
        if i % 2:
            body = keys[int(rng.integers(len(keys)))](int(rng.integers(20, 49)))
            lead = before[int(rng.integers(len(before)))] if rng.random() < 0.5 else ""
        else:
            body = harmless[int(rng.integers(len(harmless)))](int(rng.integers(2, 6)))
            body = body if len(body) >= 16 else body + pick(lower, 16 - len(body))
        out.append((word() + " ", lead, body, " " + word()))
    return out


@lru_cache(maxsize=1)
def _made(n: int) -> list[tuple[str, str, str, str]]:
    return _strings(np.random.default_rng(5), n)


def _placed(rng: np.random.Generator, made: list[tuple[str, str, str, str]], around: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """The strings, seven tenths of them in surroundings drawn from around."""
    rows, at, there = [], rng.integers(0, max(1, len(around)), len(made)).tolist(), (rng.random(len(made)) < 0.7).tolist()
    for (left, lead, body, right), k, inside in zip(made, at, there):
        left, right = around[k] if around and inside else (left, right)
        rows.append(((left + lead)[-LEFT:], body[:BODY], right[:RIGHT]))
    return rows


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        out = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            for a, b in candidates(text):
                label = int(any(s < b and e > a for s, _, e in base))
                out += [(label, *p) for p in pieces(text, a, b)]
        cols = list(zip(*out)) or [()] * 4
        yield batch_of({n: (list(c), t) for n, c, t in zip(("label", "before", "body", "behind"), cols, (pa.int32(), pa.string(), pa.string(), pa.string()))})


def findings(docs: DataFrame) -> DataFrame:
    """label, before, body and behind of the distinct pieces of all candidates of all texts, with ``place``, their hash."""
    rows = columns_of(docs, "text").where("text is not null").mapInArrow(_findings, "label int, before string, body string, behind string")
    return rows.groupBy("before", "body", "behind").agg(F.max("label").alias("label")).withColumn("place", F.xxhash64("before", "body", "behind"))


def _rows_of(frame: pd.DataFrame, first: Network | None):
    """A shard's findings and generated strings, their labels, and which of them are set aside; without ``first`` only
    findings that are keys, with it also those without a base span that it takes for harmless."""
    shard = int(frame["shard"].iloc[0])
    got = frame[frame["place"].notna()].astype({"place": "int64"}).sort_values(["before", "body", "behind"])
    found = list(zip(got["before"], got["body"], got["behind"]))
    label = got["label"].to_numpy(np.int64)
    more, also = _placed(np.random.default_rng([5, shard]), _made(GENERATED), [(a, c) for a, _, c in found]), np.arange(GENERATED) % 2
    use, other = label == 1, np.flatnonzero(label == 0)
    if first is not None:
        use[other[first.scores([found[i] for i in other]) < 0.5]] = True
    at = np.flatnonzero(use)
    y = np.concatenate([label[at], also]).astype(np.float32)
    aside = np.concatenate([got["place"].to_numpy()[at] % 5 == 0, np.arange(GENERATED) // 2 % 5 == 0])
    return shard, [found[i] for i in at] + more, y, aside


_FIXED = 1 << 24  # weights are added up as whole multiples of its inverse


def _learner(net: Network, first: Network | None, stage: int, part: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        shard, rows, y, aside = _rows_of(frame, first)
        mine = Network([w.copy() for w in net.weights])
        _learn(mine, [rows[i] for i in np.flatnonzero(~aside)], y[~aside], np.random.default_rng([6, stage, part, shard]), part, ROUNDS)
        flat = np.concatenate([w.reshape(-1) for w in mine.weights]).astype(np.float64)
        return pd.DataFrame({"w": [np.round(flat * _FIXED).astype(np.int64)]})
    return run


def _counter(net: Network, first: Network | None):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        _, rows, y, aside = _rows_of(frame, first)
        grid = np.round(_odds(net.raw([rows[i] for i in np.flatnonzero(aside)])) * GRID).astype(np.int64)
        truth = y[aside] == 1
        return pd.DataFrame({"x": grid, "keys": truth.astype(np.int64), "others": (~truth).astype(np.int64)}).groupby("x", as_index=False).sum()
    return run


def _trained(shards: DataFrame, n: int, net: Network, first: Network | None, stage: int) -> Network:
    """The network trained on the rows of all n shards, with calibration and threshold from all set-aside ones."""
    each = shards.groupBy("shard")
    for part in range(ROUNDS):
        come = each.applyInPandas(_learner(net, first, stage, part), "w array<long>")
        sums = come.select(F.posexplode("w").alias("at", "w")).groupBy("at").agg(F.sum("w").alias("w"))
        flat = np.array([r.w for r in sums.orderBy("at").collect()], np.float64) / (_FIXED * n)
        cuts = np.cumsum([w.size for w in net.weights])[:-1]
        net = Network([x.reshape(w.shape).astype(np.float32) for x, w in zip(np.split(flat, cuts), net.weights)])
    counts = each.applyInPandas(_counter(net, first), "x long, keys long, others long")
    done = counts.groupBy("x").agg(F.sum("keys").alias("keys"), F.sum("others").alias("others")).orderBy("x").collect()
    x, keys, others = np.array(done, np.int64).reshape(-1, 3).T
    _settle(net, x / GRID, keys, others)
    return net


def train(docs: DataFrame) -> Network:
    """The network of all findings of docs."""
    found = stored(findings(docs))
    total = found.count()
    n = max(1, -(-total // SHARD))
    # every shard has a row without a finding: one that is dealt none still learns generated strings
    empty = docs.sparkSession.range(n).select(F.col("id").alias("shard"))
    shards = found.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(n))).unionByName(empty, allowMissingColumns=True)
    rng = np.random.default_rng(11)
    start = _blank(rng)
    _learn(start, _placed(rng, _made(GENERATED), []), (np.arange(GENERATED) % 2).astype(np.float32), rng)
    first = _trained(shards, n, start, None, 0)
    net = _trained(shards, n, start, first, 1)
    net.findings = total
    return net


def uncovered(start: int, end: int, spans: list[Span]) -> list[tuple[int, int]]:
    """The parts from start to end that no span covers; spans in order of start."""
    out, at = [], start
    for s, _, e in spans:
        if s > at and at < end:
            out.append((at, min(s, end)))
        at = max(at, e)
    return out + [(at, end)] * (at < end)


def spans_of(texts: list[str | None], net: Network) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t or "") for t in texts]
    rows, of = [], []
    for i, text in enumerate(texts):
        for a, b in candidates(text or ""):
            if uncovered(a, b, base[i]):
                for p in pieces(text, a, b):
                    rows.append(p)
                    of.append((i, a, b))
    hit = {of[j] for j in np.flatnonzero(net.scores(rows) >= net.threshold)}
    more: dict[int, list[Span]] = {}
    for i, a, b in hit:
        more.setdefault(i, []).extend((s, len(KINDS) - 1, e) for s, e in uncovered(a, b, base[i]))
    return [(x, sorted(x + more.get(i, []))) for i, x in enumerate(base)]


def _line(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = spans_of(batch.column("text").to_pylist(), net)
            n = [[sum(k == j for _, k, _ in base) for base, _ in found] for j in range(3)]
            yield batch_of({
                "doc_id": (batch.column("doc_id"), None), "n_assign": (n[0], pa.int64()), "n_access": (n[1], pa.int64()), "n_hex": (n[2], pa.int64()),
                "base_sha256": ([hashlib.sha256(_line(base).encode()).hexdigest() for base, _ in found], pa.string()),
                "spans": ([_line(every) for _, every in found], pa.string()), "n_net": ([len(every) - len(base) for base, every in found], pa.int64()),
            })
    return run


def scanned(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_net of each row."""
    net = net or train(docs)
    docs = columns_of(docs, "doc_id", "text")
    return docs.mapInArrow(_scan(net), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_net long")


def masked_text(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping or touching spans replaced by MASK."""
    out, at = [], 0
    for s, _, e in spans:
        if s > at or not out:
            out += [text[at:s], MASK]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _mask(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            new = [t if not every else masked_text(t, every) for t, (_, every) in zip(texts, spans_of(texts, net))]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(new, batch.schema.field("text").type))
    return run


def masked(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """All rows and columns of docs, with every span in text masked."""
    net = net or train(docs)
    return docs.mapInArrow(_mask(net), docs.schema)

"""Secret scans: base patterns, and a character convolutional network over every candidate."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import doc_texts, like, slices, staged, trimmed, with_rest

# Kinds in the order of the report, and their patterns.
KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs, as shorter ones are dropped anyway
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

BEFORE, INSIDE, AFTER = 24, 40, 8
WIDTH = BEFORE + INSIDE + AFTER
#: Windows of a step of learning, and steps of a score.
PART, STEPS = 128, 1024

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, in code points, by start and then kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def windows(text: str, start: int, end: int) -> list[str]:
    """What the network sees: a window for every INSIDE characters of a candidate, the last one ending with it,
    each with the characters before the candidate and those behind."""
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    behind = text[end : end + AFTER].ljust(AFTER, "\0")
    places = [*range(start, end - INSIDE, INSIDE), max(start, end - INSIDE)]
    return [before + text[i : min(end, i + INSIDE)].ljust(INSIDE, "\0") + behind for i in places]


def candidates(text: str, base: list[Span]) -> Iterator[tuple[int, int, bool]]:
    """Every long run of key-like characters, and whether a base span covers a part of it."""
    k, reach = 0, 0  # of the spans that start before the candidate ends, the furthest end
    by_start = sorted(base, key=lambda s: s[1])
    for m in CANDIDATE.finditer(text):
        while k < len(by_start) and by_start[k][1] < m.end():
            reach = max(reach, by_start[k][2])
            k += 1
        yield m.start(), m.end(), reach > m.start()


def encode(seen: list[str]) -> np.ndarray:
    """Printable ASCII by itself, one code for padding and one for everything else."""
    points = np.frombuffer("".join(seen).encode("utf-32-le"), "<u4").reshape(-1, WIDTH)
    return np.where(points == 0, 0, np.where((points >= 32) & (points < 127), points - 31, 96)).astype(np.int64)


@dataclass
class Network:
    """Embedding, one convolution, maximum and mean over places, one output; calibrated by a line."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray
    line: tuple[float, float] = (1.0, 0.0)
    threshold: float = 1.1
    recall: float | None = None  #: reached at the threshold, on windows that were not learned from

    SPAN = 5

    def _forward(self, codes: np.ndarray):
        n, places = len(codes), WIDTH - self.SPAN + 1
        seen = np.lib.stride_tricks.sliding_window_view(codes, self.SPAN, 1)
        x = self.embed[seen].reshape(n, places, -1)
        act = np.maximum(x @ self.filters + self.bias, 0)
        top = act.argmax(1)
        pooled = np.concatenate([np.take_along_axis(act, top[:, None], 1)[:, 0], act.mean(1)], 1)
        return seen, x, act, top, pooled, pooled @ self.out + self.shift[0]

    def raw(self, codes: np.ndarray, rows: int = 512) -> np.ndarray:
        """Scores in steps, so that counts by score lose nothing."""
        found = np.concatenate([np.zeros(0), *(self._forward(codes[i : i + rows])[-1] for i in range(0, len(codes), rows))])
        return np.rint(np.clip(found, -40, 40) * STEPS) / STEPS

    def chance(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.line[0] * self.raw(codes) + self.line[1], -40, 40)))

    def _gradients(self, codes: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> list[np.ndarray]:
        seen, x, act, top, pooled, z = self._forward(codes)
        n, places, k = act.shape
        dz = weight * (1 / (1 + np.exp(-z)) - y) / n
        dpool = dz[:, None] * self.out
        dact = np.repeat(dpool[:, None, k:] / places, places, 1)
        np.put_along_axis(dact, top[:, None], np.take_along_axis(dact, top[:, None], 1) + dpool[:, None, :k], 1)
        dact *= act > 0
        flat = dact.reshape(-1, k)
        dx = (flat @ self.filters.T).reshape(-1, self.embed.shape[1])
        dembed = np.stack([np.bincount(seen.ravel(), dx[:, j], len(self.embed)) for j in range(dx.shape[1])], 1)
        return [dembed, x.reshape(-1, x.shape[-1]).T @ flat, flat.sum(0), pooled.T @ dz, np.array([dz.sum()])]

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.shift]

    def calibrate(self, raw: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        """A logistic line through held-out scores that stand for so many windows, slightly smoothed labels."""
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * raw + b, -40, 40)))
            e = n * (p - np.clip(y, 0.01, 0.99)) / n.sum()
            a, b = a - 0.05 * float((e * raw).sum()), b - 0.05 * float(e.sum())
        self.line = (a, b)

    def keep(self, raw: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float, floor: float) -> None:
        """The highest threshold that keeps the recall on these windows, if it is not below the floor."""
        chance = 1 / (1 + np.exp(-np.clip(self.line[0] * raw + self.line[1], -40, 40)))
        order = np.flatnonzero(y == 1)[np.argsort(chance[y == 1], kind="stable")]
        upto = np.cumsum(n[order])
        if len(order) and (least := float(chance[order][np.searchsorted(upto, int((1 - recall) * upto[-1]), "right")])) >= floor:
            self.threshold = least
        self.recall = float(n[order][chance[order] >= self.threshold].sum() / upto[-1]) if len(order) else None


@dataclass
class State:
    """A network that is being fitted, and the moments of its gradients."""

    net: Network
    first: list[np.ndarray]
    second: list[np.ndarray]
    taken: float = 0.0

    @classmethod
    def new(cls, channels: int = 16, seed: int | np.random.Generator = 7) -> State:
        rng = np.random.default_rng(seed)
        net = Network(rng.normal(0, 0.3, (97, 8)), rng.normal(0, 0.2, (8 * Network.SPAN, channels)), np.zeros(channels), rng.normal(0, 0.2, 2 * channels), np.zeros(1))
        return cls(net, [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()])

    def step(self, codes: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> None:
        self.taken += 1
        for w, g, m, v in zip(self.net.weights(), self.net._gradients(codes, y, weight), self.first, self.second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= 0.01 * (m / (1 - 0.9**self.taken)) / (np.sqrt(v / (1 - 0.999**self.taken)) + 1e-8)

    def packed(self) -> np.ndarray:
        return np.concatenate([*(w.ravel() for w in (*self.net.weights(), *self.first, *self.second)), [self.taken]])

    @classmethod
    def unpacked(cls, values: np.ndarray) -> State:
        state, at = cls.new(), 0
        for w in (*state.net.weights(), *state.first, *state.second):
            w[...] = values[at : at + w.size].reshape(w.shape)
            at += w.size
        state.taken = float(values[at])
        return state

    def copy(self) -> State:
        return State.unpacked(self.packed())


def train(codes: np.ndarray, y: np.ndarray, *, recall: float = 0.99, floor: float = 0.5, epochs: int = 8, channels: int = 16) -> Network:
    """Fits the network to windows in memory, its calibration, and the highest threshold that keeps the recall on the
    quarter of them it has not learned from. A network that keeps it only below `floor`, where most of
    what it adds would be wrong, is refused: its threshold is out of reach, and `recall` is 0."""
    rng = np.random.default_rng(7)
    state = State.new(channels, rng)
    order = rng.permutation(len(codes))
    test, fit = order[: len(order) // 4], order[len(order) // 4 :]
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // PART)):
            state.step(codes[part], y[part])
    net = state.net
    if not len(test):
        return net
    raw = net.raw(codes[test])
    net.calibrate(raw, y[test], np.ones(len(test)))
    net.keep(raw, y[test], np.ones(len(test)), recall, floor)
    return net


#: Windows that one shard learns from in a round, as long as there are few; and the most shards whose states, 35 KB
#: each, come to the driver to be averaged. Beyond that a shard takes more windows, which stream through it.
SHARD, SHARDS = 8192, 256


def fit(docs: DataFrame, *, recall: float = 0.99, floor: float = 0.5, epochs: int = 8, shard: int = SHARD) -> Network | None:
    """Trains on the corpus's own labelled candidates: a candidate is a finding if a base pattern covers it.

    All distinct windows of all documents count, those of both classes alike in sum. A quarter by hash is held out.
    The others are dealt into shards by hash; in each round every shard goes on from the common state over all its
    windows, and the mean of the shards' states, by their windows, is the next one. Calibration and threshold follow from
    exact counts of the held-out windows by score, whose steps bound their number. Without both classes, or with one that is
    in one of the parts alone, there is no network.
    """

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, finding = [], []
            for text in b.column("text").to_pylist():
                for start, end, hit in candidates(text, base_spans(text)):
                    for seen in windows(text, start, end):
                        texts.append(seen)
                        finding.append(hit)
            yield pa.record_batch({"seen": pa.array(texts, pa.string()), "finding": pa.array(finding, pa.bool_())})

    rows = doc_texts(docs).select("text").mapInArrow(trimmed(labelled), "seen string, finding boolean").distinct()
    # Distinct windows: copies of one finding would otherwise stand on both sides.
    rows = staged(rows.withColumn("test", F.pmod(F.xxhash64("seen"), F.lit(4)) == 0))
    counts = {(r["test"], r["finding"]): r["n"] for r in rows.groupBy("test", "finding").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 4:
        return None
    weight = {(t, f): (counts[t, True] + counts[t, False]) / (2 * n) for (t, f), n in counts.items()}
    learned = counts[False, True] + counts[False, False]
    shards = min(SHARDS, -(-learned // shard))
    fitted = rows.where(~F.col("test")).withColumn("shard", F.pmod(F.xxhash64("seen", F.lit(1)), F.lit(shards)).cast("int"))

    state = State.new()
    for epoch in range(epochs):

        def round_of(batches: Iterator[pa.RecordBatch], state: State = state) -> Iterator[pa.RecordBatch]:
            """Goes over the rows of each shard in turn, which come in order, PART at a time."""
            own, at, n, kept = None, None, 0, ([], [])

            def step() -> None:
                y = np.array(kept[1], float)
                own.step(encode(kept[0]), y, np.where(y == 1, weight[False, True], weight[False, False]))
                kept[0].clear(), kept[1].clear()

            def done() -> pa.RecordBatch:
                if kept[0]:
                    step()
                return pa.record_batch({"shard": pa.array([at], pa.int32()), "n": pa.array([n], pa.int64()), "state": pa.array([own.packed()], pa.list_(pa.float64()))})

            for b in batches:
                for of, seen, finding in zip(*(b.column(c).to_pylist() for c in ("shard", "seen", "finding")), strict=True):
                    if of != at:
                        if at is not None:
                            yield done()
                        own, at, n = state.copy(), of, 0
                    kept[0].append(seen)
                    kept[1].append(finding)
                    n += 1
                    if len(kept[0]) == PART:
                        step()
            if at is not None:
                yield done()

        dealt = fitted.repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64("seen", F.lit(2 + epoch)), "seen", "finding")
        states = sorted(dealt.mapInArrow(trimmed(round_of), "shard int, n long, state array<double>").collect())
        state = State.unpacked(sum(r["n"] * np.array(r["state"]) for r in states) / learned)
    net = state.net

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            steps = np.rint(net.raw(encode(b.column("seen").to_pylist())) * STEPS).astype(np.int64)
            yield pa.record_batch({"step": pa.array(steps), "finding": b.column("finding")})

    held = rows.where("test").select("seen", "finding").mapInArrow(trimmed(scored), "step long, finding boolean")
    held = held.groupBy("step", "finding").agg(F.count("*").alias("n")).orderBy("step", "finding").toPandas()
    y, n = held["finding"].to_numpy(float), held["n"].to_numpy(float)
    net.calibrate(held["step"].to_numpy(float) / STEPS, y, n * np.where(y == 1, weight[True, True], weight[True, False]))
    net.keep(held["step"].to_numpy(float) / STEPS, y, n, recall, floor)
    return net


def spans(text: str, base: list[Span], net: Network | None) -> list[Span]:
    """Base spans and the candidates beside them that the network takes for secrets."""
    if net is None:
        return base
    rest = [(a, b) for a, b, hit in candidates(text, base) if not hit]
    if not rest:
        return base
    seen = [windows(text, a, b) for a, b in rest]
    chance = net.chance(encode([w for some in seen for w in some]))
    first = np.concatenate([[0], np.cumsum([len(some) for some in seen])[:-1]])
    best = np.maximum.reduceat(chance, first)  # a candidate is as suspicious as its worst part
    return ordered(base + [("learned", a, b) for (a, b), c in zip(rest, best, strict=True) if c >= net.threshold])


def scan(docs: DataFrame, net: Network | None) -> DataFrame:
    """Per document: doc_id, counts by base kind, digest of the base spans, all spans, and the redacted text.

    Every run of 16 or more key-like characters that no base span covers is a candidate, and seen whole.
    Null text is empty and has no spans; a very long text is one row and is searched in one piece; repeated
    ids are scanned row by row; an empty table gives none. Overlapping spans are redacted as one.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted")}
            for text in b.column("text").to_pylist():
                base = base_spans(text)
                found = spans(text, base, net)
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(found))
                out["redacted"].append(redact(text, found))
            long, string = pa.int64(), pa.string()
            yield pa.record_batch({"doc_id": b.column("doc_id")} | {k: pa.array(v, long if k.startswith("n_") else string) for k, v in out.items()})

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string"
    return doc_texts(docs).mapInArrow(trimmed(scanned), schema)


def redact(text: str, found: list[Span]) -> str:
    """The text with every secret replaced by a mark."""
    out, at = [], 0
    for _, start, end in found:
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if found else text


def cleaned(docs: DataFrame, net: Network | None) -> DataFrame:
    """All documents with all their columns, secrets in their texts replaced by a mark; null text becomes empty."""
    rows = with_rest(docs)

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                texts = [redact(t, spans(t, base_spans(t), net)) for t in b.column("text").to_pylist()]
                yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return like(rows.mapInArrow(trimmed(without), rows.schema), docs)

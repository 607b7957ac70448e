"""Secret scan: base patterns, and a small convolutional network over every candidate."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.base import pieces, sha

#: Fixed patterns and least lengths of the base kinds.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "cnn")
_KEYS = ("passw", "secret", "token", "api")
#: Access keys and hex keys lie inside maximal runs of these characters.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: A candidate is a maximal run of these characters that is no word or compound of words: of parts
#: in one case but for a capital in front, with signs between and around.
_PART = r"[A-Z]?[a-z]{2,}|[A-Z]{2,}(?![a-z])|[A-Za-z](?![A-Za-z])"
CANDIDATE = re.compile(
    rf"(?<![A-Za-z0-9+/_.=-])(?![+/_.=-]*(?:(?:{_PART})[+/_.=-]*)*+(?![A-Za-z0-9+/_.=-]))[A-Za-z0-9+/_.=-]{{8,}}"
)
#: Characters before, of and after a stretch of a candidate that the network sees, and how far the
#: next stretch of a longer candidate lies behind it.
BEFORE, INSIDE, AFTER, SLIDE = 24, 64, 8, 32
#: Bounds of the training sample: documents scanned, and findings of each label taken.
TRAIN_DOCS, TRAIN_EACH = 20_000, 3_000
#: Made findings to train on, and others to set the threshold by.
MADE, HELD = 4_000, 2_000
#: The threshold keeps this share of held-out secrets, and no more ordinary tokens than that.
RECALL, FALSE_SHARE = 0.95, 0.002
#: Windows scored at once.
WINDOWS = 8_192
_SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-:@\"' \n"
_CODE = {c: k + 2 for k, c in enumerate(_SYMBOLS)}
_PAD, _OTHER, _SIZE = 0, 1, len(_SYMBOLS) + 2
_TABLE = np.array([_CODE.get(chr(k), _OTHER) for k in range(128)] + [_OTHER], np.uint8)
_AT = np.arange(BEFORE + INSIDE + AFTER)

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Base findings by start, then kind as listed; spans are those of the whole match."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for run in RUN.finditer(text):
        a, b = run.span()
        for kind, pattern in (("access", ACCESS), ("hex", HEX)):
            out += [(kind, *m.span()) for m in pattern.finditer(text, a, b) if m.end() - m.start() >= LEAST[kind]]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def unknown(text: str, known: list[Span]) -> list[tuple[int, int]]:
    """Candidates that meet none of the spans ``known``, which are sorted by start."""
    starts = [s for _, s, _ in known]
    reach = list(accumulate((e for *_, e in known), max))
    out = []
    for a, b in candidates(text):
        before = bisect_left(starts, b)
        if not before or reach[before - 1] <= a:
            out.append((a, b))
    return out


def windows(text: str, places: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols around and in every stretch of the candidates, and each stretch's candidate.

    A candidate of up to ``INSIDE`` characters is one stretch; a longer one has one from every
    ``SLIDE`` characters on, the last up to its end, so that each of its characters is seen.
    """
    starts, owner = [], []
    for k, (a, b) in enumerate(places):
        own = [*range(a, b - INSIDE, SLIDE), max(a, b - INSIDE)]
        starts += own
        owner += [k] * len(own)
    if not starts:
        return np.zeros((0, len(_AT)), np.uint8), np.zeros(0, np.int64)
    owner, starts = np.array(owner), np.array(starts)
    ends = np.array([b for _, b in places])[owner]
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.concatenate([np.zeros(BEFORE, np.uint8), _TABLE[np.minimum(code, 128)], np.zeros(INSIDE + AFTER, np.uint8)])
    inside = np.minimum(ends - starts, INSIDE)[:, None]
    # what follows a short candidate stands at the end of the window
    place = _AT[None, :] + np.where(_AT[None, :] >= BEFORE + INSIDE, inside - INSIDE, 0)
    out = code[starts[:, None] + place]
    out[(_AT[None, :] >= BEFORE + inside) & (_AT[None, :] < BEFORE + INSIDE)] = _PAD
    return out, owner


class Network:
    """Embedding, one convolution, largest response inside and around, a logistic unit."""

    WIDTH, FILTERS, DEPTH = 5, 24, 8

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (_SIZE, self.DEPTH)).astype(np.float32)
        self.embed[_PAD] = 0
        self.kernel = rng.normal(0, 0.2, (self.WIDTH * self.DEPTH, self.FILTERS)).astype(np.float32)
        self.bias = np.zeros(self.FILTERS, np.float32)
        self.out = rng.normal(0, 0.2, 3 * self.FILTERS + 1).astype(np.float32)
        self.threshold = 0.5

    def _forward(self, x: np.ndarray):
        e = self.embed[x]
        n = x.shape[1] - self.WIDTH + 1
        columns = np.concatenate([e[:, k : k + n] for k in range(self.WIDTH)], axis=2)
        h = np.maximum(columns @ self.kernel + self.bias, 0)
        inside = slice(BEFORE, BEFORE + INSIDE - self.WIDTH + 1)
        lengths = np.maximum((x[:, BEFORE : BEFORE + INSIDE] != _PAD).sum(axis=1, keepdims=True), 1).astype(np.float32)
        pools = [h[:, inside].max(axis=1), h[:, inside].sum(axis=1) / lengths, h[:, :BEFORE].max(axis=1)]
        features = np.concatenate([*pools, np.ones((len(x), 1), np.float32)], axis=1)
        return columns, h, inside, lengths, features, 1 / (1 + np.exp(-np.clip(features @ self.out, -30, 30)))

    def largest(self, text: str, places: list[tuple[int, int]]) -> np.ndarray:
        """Of each candidate the largest score of its stretches."""
        out = np.zeros(len(places))
        for at in range(0, len(places), WINDOWS):
            x, owner = windows(text, places[at : at + WINDOWS])
            for k in range(0, len(x), WINDOWS):
                np.maximum.at(out, at + owner[k : k + WINDOWS], self.score(x[k : k + WINDOWS]))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        parts = [self._forward(x[k : k + 512])[-1] for k in range(0, len(x), 512)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.01) -> None:
        """Adam on the log loss."""
        rng = np.random.default_rng(11)
        used = rng.permutation(len(x))
        names = ("embed", "kernel", "bias", "out")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        for _ in range(epochs):
            rng.shuffle(used)
            for at in range(0, len(used), batch):
                rows = used[at : at + batch]
                step += 1
                for name, grad in self._gradients(x[rows], y[rows]).items():
                    first[name] = 0.9 * first[name] + 0.1 * grad
                    second[name] = 0.999 * second[name] + 0.001 * grad**2
                    change = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, name, getattr(self, name) - rate * change)
                self.embed[_PAD] = 0

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        columns, h, inside, lengths, features, p = self._forward(x)
        delta = ((p - y) / len(y)).astype(np.float32)[:, None]
        back = delta * self.out[None, :-1]
        f = self.FILTERS
        d = np.zeros_like(h)
        rows, filters = np.arange(len(x))[:, None], np.arange(f)[None, :]
        np.add.at(d, (rows, BEFORE + h[:, inside].argmax(axis=1), filters), back[:, :f])
        d[:, inside] += (back[:, f : 2 * f] / lengths)[:, None, :]
        np.add.at(d, (rows, h[:, :BEFORE].argmax(axis=1), filters), back[:, 2 * f :])
        d *= h > 0
        flat = d.reshape(-1, f)
        down = (flat @ self.kernel.T).reshape(*d.shape[:2], self.WIDTH, self.DEPTH)
        embed = np.zeros_like(self.embed)
        for k in range(self.WIDTH):
            np.add.at(embed, x[:, k : k + d.shape[1]], down[:, :, k])
        return {
            "embed": embed, "kernel": columns.reshape(len(flat), -1).T @ flat,
            "bias": flat.sum(axis=0), "out": (features * delta).sum(axis=0),
        }

    def calibrate(self, score: np.ndarray, y: np.ndarray) -> None:
        """The lowest threshold with few false findings, but never one that loses recall."""
        good, bad = score[y == 1], score[y == 0]
        if good.size and bad.size:
            by_recall = float(np.quantile(good, 1 - RECALL))
            by_false = float(np.quantile(bad, 1 - FALSE_SHARE))
            self.threshold = min(by_recall, max(by_false, 0.5))


def made_findings(n: int, seed: int = 3) -> list[tuple[str, int, int, int]]:
    """Labelled findings of forms that no base pattern names: (text, start, end, label).

    Secrets are issued tokens and random strings of 8 to 400 characters, some inside a longer
    candidate; ordinary ones numbers, dates, versions, names in code, addresses and paths.
    """
    rng = np.random.default_rng(seed)

    def pick(symbols: str, k: int) -> str:
        return "".join(symbols[i] for i in rng.integers(0, len(symbols), k))

    def size(low: int, high: int) -> int:
        return int(np.exp(rng.uniform(np.log(low), np.log(high + 1))))

    def words(k: int, join: str, capital: bool = False) -> str:
        out = ["".join(pick("bcdfghklmnprstvw", 1) + pick("aeiou", 1) for _ in range(int(rng.integers(1, 4)))) for _ in range(k)]
        return join.join(w.capitalize() if capital else w for w in out)

    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = lower + lower.upper() + digits

    def random_string(symbols: str, low: int, high: int) -> str:
        """At least one digit and one letter in each case."""
        out = list(pick(symbols, size(low, high)))
        for at, kind in zip(rng.permutation(len(out)), (digits, lower, lower.upper())):
            out[at] = pick(kind, 1)
        return "".join(out)

    two = lambda: pick(digits, 2)
    forms = (
        (1, lambda: "ghp_" + pick(mixed, 36)), (1, lambda: "xoxb-" + pick(digits, 12) + "-" + pick(mixed, 24)),
        (1, lambda: "AIza" + pick(mixed + "-_", 35)), (1, lambda: "sk_live_" + pick(mixed, 24)),
        (1, lambda: random_string(mixed + "+/", 40, 400)), (1, lambda: random_string(mixed, 8, 40)),
        (1, lambda: random_string(mixed, 8, 400)), (1, lambda: random_string(mixed + "-_", 12, 64)),
        (1, lambda: ".".join("eyJ" + pick(mixed + "-_", size(20, 120)) for _ in range(3))),
        (1, lambda: words(int(rng.integers(1, 12)), "/") + "/" + random_string(mixed, 24, 48) + "/" + words(int(rng.integers(1, 12)), "/")),
        (0, lambda: pick(digits, size(8, 24))), (0, lambda: f"20{two()}-{two()}-{two()}"), (0, lambda: f"20{two()}-{two()}-{two()}T{two()}.{two()}.{two()}"),
        (0, lambda: ".".join(str(rng.integers(0, 256)) for _ in range(4))), (0, lambda: "v" + ".".join(pick(digits, 1) for _ in range(3)) + "-" + words(1, "")),
        (0, lambda: words(int(rng.integers(2, 5)), "", True)), (0, lambda: words(1, "") + words(int(rng.integers(1, 4)), "", True)),
        (0, lambda: words(int(rng.integers(2, 5)), "_") + "_" + two()), (0, lambda: words(int(rng.integers(2, 6)), "-") + "-" + pick(digits, int(rng.integers(1, 5)))),
        (0, lambda: "www." + words(2, "") + ".com/" + words(int(rng.integers(1, 30)), "/") + "/20" + two()),
        (0, lambda: words(int(rng.integers(1, 4)), "/") + "/" + words(1, "") + pick(digits, 2) + ".html"),
        (0, lambda: pick("-=._", 1) * size(8, 80)), (0, lambda: words(1, "") + pick(digits, int(rng.integers(1, 5))) + words(1, "")),
        (0, lambda: words(2, ".", True) + "." + pick(digits, 1)), (0, lambda: "+" + pick(digits, 2) + "-" + pick(digits, 3) + "-" + pick(digits, 7)),
    )
    lead = ("key: ", "use ", "Authorization: Bearer ", "the ", "in ", "see ", "= ", "")
    out = []
    while len(out) < n:
        label, form = forms[int(rng.integers(0, len(forms)))]
        before, token = words(2, " ") + " " + lead[int(rng.integers(0, len(lead)))], form()
        text = before + token + " " + words(2, " ")
        if (len(before), len(before) + len(token)) in unknown(text, base_spans(text)):
            out.append((text, len(before), len(before) + len(token), label))
    return out


def base_windows(docs: DataFrame) -> DataFrame:
    """(x): windows of the candidates that meet a base span, each once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            xs: set[bytes] = set()
            for text in batch.column("text").to_pylist():
                known = base_spans(text or "")
                if known:
                    free = set(unknown(text, known))
                    xs.update(x.tobytes() for x in windows(text, [c for c in candidates(text) if c not in free])[0])
            yield pa.RecordBatch.from_arrays([pa.array(sorted(xs), pa.binary())], ["x"])

    return docs.select("text").mapInArrow(run, "x binary").distinct()


def fit_network(docs: DataFrame) -> Network:
    """Train on base findings of a bounded sample of documents and on made findings.

    What the base does not judge in the corpus is no training row: it may be a secret.  The
    threshold is set on made findings that were not trained on, forms the network has to decide.
    """
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    found = base_windows(docs.join(F.broadcast(ids), "doc_id", "left_semi"))
    some = found.orderBy(F.xxhash64("x"), "x").limit(TRAIN_EACH).toArrow()["x"].to_pylist()
    parts = [np.frombuffer(v, np.uint8)[None] for v in some]
    labels = [np.ones(len(some))]
    for text, a, b, y in made_findings(MADE):
        x, _ = windows(text, [(a, b)])
        if y and len(x) > 3:  # which stretch of a long candidate holds the secret is not known
            x = x[[len(x) // 2]]
        parts.append(x)
        labels.append(np.full(len(x), y))
    network = Network()
    network.train(np.concatenate(parts), np.concatenate(labels).astype(np.float32))
    held = made_findings(HELD, seed=4)
    network.calibrate(np.array([network.largest(t, [(a, b)])[0] for t, a, b, _ in held]), np.array([y for *_, y in held]))
    return network


def find_secrets(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, counts and hash of the base spans, and all spans of each row.

    A candidate that meets a base span adds nothing; every other one is scored whole, by the
    largest score of its stretches.  A null text is empty and has no spans.  Rows are looked at
    one by one, repeated ones too; a text of any length takes time in proportion to it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def joined(spans: list[Span]) -> str:
        return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            base, spans = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                known = base_spans(text)
                free = unknown(text, known)
                scores = shared.value.largest(text, free)
                base.append(known)
                added = [("cnn", *free[k]) for k in np.flatnonzero(scores >= shared.value.threshold)]
                spans.append(sorted(known + added, key=lambda s: (s[1], KINDS.index(s[0]))))
            counts = [pa.array([sum(s[0] == name for s in own) for own in base], pa.int64()) for name in KINDS[:3]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array([sha(joined(own).encode()) for own in base]), pa.array([joined(own) for own in spans])],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )

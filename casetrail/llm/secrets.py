"""Secret scans: patterns, and a character convolutional network over further candidates and their surroundings.

``find_secrets`` marks what the patterns of ``base_spans`` find in whole texts, and adds candidates (runs of 8 or more
key characters with both letters and digits) that the network takes for secrets. The network sees the candidate and its
surroundings as characters, a long candidate in windows that overlap by half (the highest score counts); it is trained with numpy on labelled findings: pattern findings and other candidates of a
bounded sample of documents (SAMPLE), and generated keys and look-alikes set into contexts of that sample. Scores are
calibrated (Platt) on held-out findings; the threshold is the highest that keeps RECALL of the held-out secrets of every
generated family. Candidates of the sample that have the shape of a generated secret may be real and are not trained on.

Defined cases: a null text is empty and has no spans; an empty table gives no rows (the network is then trained on
generated findings alone); repeated rows are scanned one by one; further columns are ignored.
"""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casetrail.llm import spans as S
from casetrail.llm.common import batches, text_of

#: Documents that training looks at, at most; chosen by a hash of their id.
SAMPLE = 2_000
#: Generated findings of each label.
GENERATED = 1_500
#: Share of held-out secrets that the threshold must keep.
RECALL = 0.97
KINDS = ["assign", "access", "hex"]
ADDED = "network"
MASK = "[SECRET]"

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")

LEFT, BODY, RIGHT = 24, 40, 8
WIDTH = LEFT + BODY + RIGHT
ALPHABET = string.ascii_letters + string.digits + " \n\"'`:=<>()[]{}.,;+/_-@#$%&*!?|\\"
CODES = {c: i + 2 for i, c in enumerate(ALPHABET)}  # 0: nothing there, 1: any other character


def base_spans(text: str) -> list[S.Span]:
    out: list[S.Span] = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return S.ordered(out, KINDS)


def candidates(text: str, taken: list[S.Span]) -> list[tuple[int, int]]:
    """Runs of key characters with letters and digits, outside of what is marked already."""
    out = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if not run.isalpha() and any(map(str.isdigit, run)) and any(map(str.isalpha, run)) and S.free_of(taken, *m.span()):
            out.append(m.span())
    return out


def encode(text: str, start: int, end: int) -> tuple[list[int], int]:
    """Character codes around and in [start, end), and how many of them are inside."""
    body = text[start : min(end, start + BODY)]
    left = text[max(0, start - LEFT) : start].rjust(LEFT, "\0")
    row = left + body + text[end : end + RIGHT]
    return [0 if c == "\0" else CODES.get(c, 1) for c in row.ljust(WIDTH, "\0")], len(body)


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Stretches of BODY characters, each half a stretch after the one before, that cover [start, end)."""
    if end - start <= BODY:
        return [(start, end)]
    return [(a, a + BODY) for a in (*range(start, end - BODY, BODY // 2), end - BODY)]


class CharNetwork:
    """Embedding, one convolution, maxima inside and outside of the candidate, one unit; calibrated by Platt scaling."""

    DIM, TAPS, FILTERS = 10, 5, 24

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.p = {
            "emb": r.normal(0, 0.3, (len(ALPHABET) + 2, self.DIM)),
            "conv": r.normal(0, 0.15, (self.TAPS * (self.DIM + 1), self.FILTERS)),
            "bias": np.zeros(self.FILTERS),
            "out": r.normal(0, 0.2, 2 * self.FILTERS),
            "off": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, codes: np.ndarray, inside: np.ndarray):
        x = np.concatenate([self.p["emb"][codes], inside[..., None]], 2)
        win = np.lib.stride_tricks.sliding_window_view(x, self.TAPS, 1).transpose(0, 1, 3, 2)
        win = win.reshape(len(codes), -1, self.TAPS * (self.DIM + 1))
        act = np.maximum(win @ self.p["conv"] + self.p["bias"], 0)
        mid = inside[:, self.TAPS // 2 : -(self.TAPS // 2), None] > 0
        tops = [np.where(m, act, -1.0) for m in (mid, ~mid)]
        at = [t.argmax(1) for t in tops]
        pooled = np.concatenate([np.maximum(t.max(1), 0) for t in tops], 1)
        return win, at, pooled, pooled @ self.p["out"] + self.p["off"][0]

    def logits(self, codes: np.ndarray, inside: np.ndarray) -> np.ndarray:
        parts = [self._forward(codes[i : i + 512], inside[i : i + 512])[3] for i in range(0, len(codes), 512)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def scores(self, codes: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(codes, inside) + self.shift, -40, 40)))

    def _gradients(self, codes: np.ndarray, inside: np.ndarray, y: np.ndarray) -> dict:
        win, at, pooled, z = self._forward(codes, inside)
        dz = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        g = {"out": pooled.T @ dz, "off": np.array([dz.sum()])}
        dpool = dz[:, None] * self.p["out"] * (pooled > 0)
        g["bias"] = dpool[:, : self.FILTERS].sum(0) + dpool[:, self.FILTERS :].sum(0)
        g["conv"], g["emb"] = np.zeros_like(self.p["conv"]), np.zeros_like(self.p["emb"])
        rows = np.arange(len(y))[:, None]
        for part, where in enumerate(at):
            d = dpool[:, part * self.FILTERS : (part + 1) * self.FILTERS]
            g["conv"] += np.einsum("nft,nf->tf", win[rows, where], d)
            back = np.einsum("nf,tf->nft", d, self.p["conv"]).reshape(len(y), self.FILTERS, self.TAPS, self.DIM + 1)
            seen = codes[rows[..., None], where[..., None] + np.arange(self.TAPS)]
            np.add.at(g["emb"], seen, back[..., : self.DIM])
        return g

    def fit(self, codes: np.ndarray, inside: np.ndarray, y: np.ndarray, family: np.ndarray | None = None, epochs: int = 6, rate: float = 0.01, seed: int = 5):
        r = np.random.default_rng(seed)
        held = r.random(len(y)) < 0.25
        train = np.flatnonzero(~held)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            r.shuffle(train)
            for i in range(0, len(train), 64):
                b, step = train[i : i + 64], step + 1
                for k, g in self._gradients(codes[b], inside[b], y[b]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
        self._calibrate(self.logits(codes[held], inside[held]), y[held], None if family is None else family[held])
        return self

    def _calibrate(self, z: np.ndarray, y: np.ndarray, family: np.ndarray | None = None) -> None:
        """Platt scaling by Newton steps with softened labels, then the highest threshold of sufficient recall in every family."""
        pos, neg = y.sum(), (1 - y).sum()
        t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        a, x = np.array([1.0, 0.0]), np.stack([z, np.ones_like(z)], 1)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ a, -40, 40)))
            a -= np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + 1e-3 * np.eye(2), x.T @ (p - t))
        self.scale, self.shift = map(float, a)
        p = 1 / (1 + np.exp(-np.clip(x @ a, -40, 40)))
        kept = [np.sort(p[g]) for g in ([y > 0] if family is None else [family == f for f in range(FAMILIES)]) if g.any()]
        self.threshold = min([float(q[int((1 - RECALL) * len(q))]) for q in kept], default=0.5)


# ---- labelled findings --------------------------------------------------------------------------


def _draw(r: np.random.Generator, letters: str, low: int, high: int) -> str:
    return "".join(letters[i] for i in r.integers(0, len(letters), r.integers(low, high)))


#: Shapes of the generated secrets, in their order.
SHAPES = [re.compile(x) for x in (r"[A-Za-z0-9+/]{20,63}", r"[0-9a-f]{16,23}", r"[a-z]{2,3}_[A-Za-z0-9]{20,43}", r"[A-Za-z0-9_-]{24,47}", r"[A-Z0-9]{18,31}")]
FAMILIES = len(SHAPES)


def _generated(r: np.random.Generator, secret: bool) -> tuple[str, str, str, int]:
    """What stands before, the candidate, what stands behind, and the family of a secret."""
    b64 = string.ascii_letters + string.digits
    if secret:
        family = int(r.integers(FAMILIES))
        draw = [
            lambda: _draw(r, b64 + "+/", 20, 64),
            lambda: _draw(r, "0123456789abcdef", 16, 24),
            lambda: _draw(r, string.ascii_lowercase, 2, 4) + "_" + _draw(r, b64, 20, 44),
            lambda: _draw(r, b64 + "_-", 24, 48),
            lambda: _draw(r, string.ascii_uppercase + string.digits, 18, 32),
        ][family]
        while (value := draw()).isalpha() or not any(map(str.isalpha, value)) or not any(map(str.isdigit, value)):
            pass
        name = ["key ", "pwd=", "credentials: ", "Authorization: Bearer ", "private key ", "auth ", "", "", "pass is "][r.integers(9)]
        return name, value, " ", family
    word = lambda n, m: _draw(r, string.ascii_lowercase, n, m)
    value = [
        lambda: f"{word(4, 9)}-{word(3, 8)}-{r.integers(1, 2000)}",
        lambda: f"20{r.integers(10, 30)}-{r.integers(10, 13)}-{r.integers(10, 29)}T{r.integers(10, 24)}",
        lambda: f"{word(8, 14)}{r.integers(0, 99)}",
        lambda: f"/{word(3, 8)}/{word(3, 8)}{r.integers(0, 99)}/{word(4, 9)}",
        lambda: f"{word(2, 5).upper()}-{r.integers(1000, 999999)}",
        lambda: f"{word(3, 7)}_{word(3, 7)}_{r.integers(1, 99)}",
        lambda: f"{word(5, 9).capitalize()}{word(5, 9).capitalize()}{r.integers(1, 9)}",
        lambda: f"{r.integers(1, 9999)}{word(6, 12)}",
    ][r.integers(8)]()
    return ["", "", "version ", "see ", "id ", "file: "][r.integers(6)], value, " ", -1


def _ahead(r: np.random.Generator) -> str:
    """A name with =, or folders, as they stand in one run with what follows."""
    words = [_draw(r, string.ascii_lowercase, 3, 12) for _ in range(r.integers(2, 6))]
    return "_".join(words).upper() + "=" if r.random() < 0.5 else "/".join(words) + "/"


def _labelled(texts: list[str], seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, inside marks, labels, families (-1: not a generated secret): findings of the sample's texts and generated ones."""
    r, rows = np.random.default_rng(seed), []
    for t in texts:
        base = base_spans(t)
        for kind, a, b in base:
            value = ASSIGN.match(t, a).start(2) if kind == "assign" else a
            rows += [(encode(t, x, y), 1, -1) for x, y in windows(value, b)]
        plain = [(a, b) for a, b in candidates(t, base) if not any(x.fullmatch(t, a, b) for x in SHAPES)]
        rows += [(encode(t, x, y), 0, -1) for a, b in plain for x, y in windows(a, b)]
    frames = [t for t in texts if t] or [" "]
    for label in (0, 1):
        for _ in range(GENERATED):
            t = frames[r.integers(len(frames))]
            at = t.rfind(" ", 0, int(r.integers(len(t))) + 1) + 1
            before, value, after, family = _generated(r, bool(label))
            head = t[max(0, at - LEFT) : at] + before
            # a quarter stands at the end of a longer run, as after a name or in a path
            run = _ahead(r) if r.random() < 0.25 else ""
            start, key, end = len(head), len(head + run), len(head + run + value)
            text = head + run + value + after + t[at : at + RIGHT]
            cuts = windows(start, end)
            for x, y in cuts:
                if not label or min(y, end) - max(x, key) >= min(16, len(value)):
                    rows.append((encode(text, x, y), label, family if (x, y) == cuts[-1] else -1))
    codes = np.array([c for (c, _), _, _ in rows], np.int64)
    n = np.array([n for (_, n), _, _ in rows])
    return codes, _inside(n), np.array([y for _, y, _ in rows], float), np.array([f for _, _, f in rows])


def labelled_findings(texts: list[str], seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _labelled(texts, seed)[:3]


def _inside(n: np.ndarray) -> np.ndarray:
    at = np.arange(WIDTH)
    return ((at >= LEFT) & (at < LEFT + n[:, None])).astype(float)


def train(docs: DataFrame, sample: int = SAMPLE) -> CharNetwork:
    ids = docs.select(F.col("doc_id").alias("_id")).dropna().distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left_semi").select("doc_id", text_of().alias("text"))
    texts = [x.text for x in rows.orderBy("doc_id", F.xxhash64("text")).limit(sample).collect()]
    return CharNetwork().fit(*_labelled(texts))


# ---- scanning -----------------------------------------------------------------------------------


def scan(texts: list[str], network: CharNetwork) -> list[tuple[list[S.Span], list[S.Span]]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) for t in texts]
    found = [(i, a, b, w) for i, t in enumerate(texts) for a, b in candidates(t, base[i]) for w in windows(a, b)]
    taken: dict[int, dict[tuple[int, int], None]] = {}
    for k in range(0, len(found), 4096):
        part = found[k : k + 4096]
        rows = [encode(texts[i], *w) for i, _, _, w in part]
        score = network.scores(np.array([c for c, _ in rows]), _inside(np.array([n for _, n in rows])))
        for (i, a, b, _), s in zip(part, score, strict=True):
            if s >= network.threshold:
                taken.setdefault(i, {})[a, b] = None
    added = {i: [(ADDED, a, b) for a, b in x] for i, x in taken.items()}
    return [(x, S.ordered(x + added[i], [*KINDS, ADDED]) if i in added else x) for i, x in enumerate(base)]


def find_secrets(docs: DataFrame, network: CharNetwork) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) of every document."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = scan(batch.column("text").to_pylist(), network)
        cols = [pa.array([S.as_arrow(x[k]) for x in got], S.ARROW) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "base", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return batches(rows, make, f"doc_id long, base {S.TYPE}, spans {S.TYPE}")


def mask_secrets(docs: DataFrame, network: CharNetwork) -> DataFrame:
    """``docs`` with every marked stretch of ``text`` replaced by MASK, and n_chars (if there) of the new text."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        texts = [t or "" for t in batch.column(at).to_pylist()]
        new = [S.masked(t, x, MASK) if x else t for t, (_, x) in zip(texts, scan(texts, network), strict=True)]
        return batch.set_column(at, "text", pa.array(new, batch.schema.field(at).type))

    out = batches(docs, make, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out

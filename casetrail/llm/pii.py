"""Personal data: patterns, and a semi-Markov conditional random field for what patterns miss.

``find_personal`` marks what ``base_spans`` finds in whole texts. Around digits, at signs and spelled-out ones, tokens are
then cut into segments by the field: a segment of up to LONGEST tokens of one kind is scored as a whole (its characters,
digit groups, check digit, borders and the word before it), other tokens stand alone, and a dynamic program over segments
picks boundaries and kinds together. Weights maximise the regularised likelihood (forward-backward, Adagrad) of generated
passages with known entities and look-alikes, and of passages of at most SAMPLE documents labelled by the patterns.

Defined cases: a null text is empty and has no spans; an empty table gives no rows; rows that repeat are searched one by
one; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casetrail.llm import spans as S
from casetrail.llm.common import batches, text_of

SAMPLE = 1_000
GENERATED = 600
KINDS = ["email", "ip", "card", "phone"]
#: Tokens of an entity at most, and tokens around a sign that are looked at.
LONGEST, AROUND = 10, 9

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
SIGN = re.compile(r"@|[\[({<]\s?(?i:at)\s?[\])}>]|[0-9]{3}|[0-9]\.[0-9]|[0-9]\[\.\][0-9]")
TOKEN = re.compile(r"[A-Za-z0-9]+|[\[({<]\s?(?i:at|dot|\.)\s?[\])}>]|[^\sA-Za-z0-9]")


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _fits(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[S.Span]:
    out: list[S.Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_fits, m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return S.ordered(out, KINDS)


# ---- segments and their features ----------------------------------------------------------------

# Words that stand before entities of a kind.
CUES = [
    set("email mail contact write".split()), set("ip host server address".split()),
    set("card visa credit payment pay".split()), set("tel phone call mobile fax cell".split()),
]
AT = re.compile(r"@|[\[({<]\s?(?i:at)\s?[\])}>]")
DOT = re.compile(r"[\[({<]\s?(?i:dot)\s?[\])}>]|\[\.\]")
MAIL = re.compile(r"[A-Za-z0-9._%+-]+\s?(?:@|[\[({<]\s?(?i:at)\s?[\])}>])\s?[A-Za-z0-9-]+(?:\s?(?:\.|[\[({<]\s?(?i:dot)\s?[\])}>])\s?[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"\+?[0-9().\s\[\]-]+")
GROUPS = re.compile(r"[0-9]+")

Tokens = list[tuple[int, int]]


def regions(text: str) -> list[Tokens]:
    """Tokens around signs of personal data; regions that meet are one."""
    signs = [m.start() for m in SIGN.finditer(text)]
    if not signs:
        return []
    tokens = [m.span() for m in TOKEN.finditer(text)]
    starts = np.array([a for a, _ in tokens])
    out: list[list[int]] = []
    for k in np.searchsorted(starts, signs, "right") - 1:
        lo, hi = max(0, int(k) - AROUND), min(len(tokens), int(k) + AROUND + 1)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [tokens[a:b] for a, b in out]


def _features(text: str, start: int, end: int, before: str, n: int) -> np.ndarray:
    """Of a whole segment: what it looks like, how it is bordered, what stands before."""
    s = text[start:end]
    groups = GROUPS.findall(s)
    d = "".join(groups)
    shape = tuple(map(len, groups))
    left, right = text[start - 1 : start], text[end : end + 1]
    numeric = bool(NUMBERS.fullmatch(s))
    four = len(groups) == 4 and numeric and "-" not in s and " " not in s and "(" not in s
    f = [
        1.0, n == 1, n / LONGEST, numeric, bool(AT.search(s)), bool(DOT.search(s)), bool(MAIL.fullmatch(s)), " " in s.strip(),
        len(d) == 0, 1 <= len(d) < 7, 7 <= len(d) <= 9, 10 <= len(d) <= 15 and numeric, 14 <= len(d) <= 19 and numeric,
        numeric and 14 <= len(d) <= 19 and luhn(d), numeric and 14 <= len(d) <= 19 and not luhn(d),
        four and all(map(_fits, groups)), four and not all(map(_fits, groups)), s[:1] == "+", s[:1] == "(", s[-1:].isdigit(),
        len(groups) > 1 and numeric and len(d) >= 14 and shape != (4, 4, 4, 4), numeric and shape[-3:] == (3, 3, 4), numeric and shape[-2:] == (3, 4), shape == (4, 4, 4, 4), len(groups) == 1 and numeric,
        "." in s, "-" in s, s[:1].isalnum() or s[:1] in "+(", s[-1:].isalnum(),
        left.isalnum() or left in ("@", "+", "-", "_", "/"), right.isalnum() or right in ("@", "-", "_", "/"),
        left == "." , right == "." and text[end + 1 : end + 2].isalnum(), *[before in c for c in CUES],
    ]
    return np.array(f, float)


SIZE = len(_features("1", 0, 1, "", 1))


def _lattice(text: str, tokens: Tokens) -> np.ndarray:
    """features[end, length - 1] of every segment of the region."""
    out = np.zeros((len(tokens), LONGEST, SIZE))
    words = [text[a:b].lower() for a, b in tokens]
    for e in range(len(tokens)):
        for n in range(1, min(LONGEST, e + 1) + 1):
            b = e - n + 1
            before = next((w for w in words[max(0, b - 3) : b][::-1] if w.isalpha()), "")
            out[e, n - 1] = _features(text, tokens[b][0], tokens[e][1], before, n)
    return out


class SemiMarkov:
    """Labels 0 (outside, single tokens) and 1.. for KINDS; a weight vector per label and weights of label pairs."""

    def __init__(self):
        k = len(KINDS) + 1
        self.w, self.t = np.zeros((k, SIZE)), np.zeros((k, k))

    def _scores(self, feats: np.ndarray) -> np.ndarray:
        """score[end, length - 1, label]; impossible ones are -inf."""
        s = feats @ self.w.T
        s[:, 1:, 0] = -np.inf
        for e in range(min(LONGEST, len(s))):
            s[e, e + 1 :] = -np.inf
        return s

    def _forward(self, s: np.ndarray) -> np.ndarray:
        n, k = len(s), s.shape[2]
        a = np.full((n + 1, k), -np.inf)
        a[0, 0] = 0
        for e in range(n):
            m = min(LONGEST, e + 1)
            into = np.logaddexp.reduce(a[e + 1 - m : e + 1, :, None] + self.t, 1)[::-1]  # by length
            a[e + 1] = np.logaddexp.reduce(into + s[e, :m], 0)
        return a

    def _backward(self, s: np.ndarray) -> np.ndarray:
        n, k = len(s), s.shape[2]
        b = np.full((n + 1, k), -np.inf)
        b[n] = 0
        for p in range(n - 1, -1, -1):
            m = min(LONGEST, n - p)
            ahead = s[np.arange(p, p + m), np.arange(m)] + b[p + 1 : p + m + 1]  # (length, label)
            b[p] = np.logaddexp.reduce(self.t + np.logaddexp.reduce(ahead, 0)[None], 1)
        return b

    def gradient(self, feats: np.ndarray, truth: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Of the log-likelihood of ``truth``: (first token, end, label) of all segments in order."""
        s = self._scores(feats)
        a, b = self._forward(s), self._backward(s)
        z = np.logaddexp.reduce(a[-1])
        gw, gt, last = np.zeros_like(self.w), np.zeros_like(self.t), 0
        for p, e, y in truth:
            gw[y] += feats[e - 1, e - p - 1]
            gt[last, y] += 1
            last = y
        for e in range(len(s)):
            for n in range(1, min(LONGEST, e + 1) + 1):
                if n > 1 and not np.isfinite(s[e, n - 1, 1:]).any():
                    continue
                q = np.exp(a[e + 1 - n][:, None] + self.t + s[e, n - 1] + b[e + 1] - z)
                gt -= q
                gw -= q.sum(0)[:, None] * feats[e, n - 1]
        return gw, gt

    def best(self, feats: np.ndarray) -> list[tuple[int, int, int]]:
        """The likeliest segments other than 0."""
        s = self._scores(feats)
        n, k = len(s), s.shape[2]
        a, back = np.full((n + 1, k), -np.inf), {}
        a[0, 0] = 0
        for e in range(n):
            m = min(LONGEST, e + 1)
            step = a[e + 1 - m : e + 1, :, None] + self.t
            into, frm = step.max(1)[::-1], step.argmax(1)[::-1]
            total = into + s[e, :m]
            length = total.argmax(0)
            a[e + 1] = total[length, np.arange(k)]
            for y in range(k):
                back[e + 1, y] = (int(length[y]) + 1, int(frm[length[y], y]))
        out, e, y = [], n, int(a[n].argmax())
        while e:
            size, before = back[e, y]
            if y:
                out.append((e - size, e, y))
            e, y = e - size, before
        return out[::-1]

    def fit(self, passages: list[tuple[str, list[S.Span]]], epochs: int = 5, rate: float = 0.3, decay: float = 1e-4, seed: int = 2):
        rows = []
        for text, marked in passages:
            for tokens in regions(text):
                truth, p = [], 0
                starts = {a: k for k, (a, _) in enumerate(tokens)}
                ends = {b: k + 1 for k, (_, b) in enumerate(tokens)}
                own = [(starts[a], ends[b], KINDS.index(k) + 1) for k, a, b in marked if a in starts and b in ends]
                if any(e - p > LONGEST for p, e, _ in own):
                    continue
                for b, e, y in own:
                    truth += [(i, i + 1, 0) for i in range(p, b)] + [(b, e, y)]
                    p = e
                truth += [(i, i + 1, 0) for i in range(p, len(tokens))]
                rows.append((_lattice(text, tokens), truth))
        r = np.random.default_rng(seed)
        hw, ht = np.full_like(self.w, 1e-2), np.full_like(self.t, 1e-2)
        for _ in range(epochs):
            for i in r.permutation(len(rows)):
                gw, gt = self.gradient(*rows[i])
                gw, gt = gw - decay * self.w, gt - decay * self.t
                hw, ht = hw + gw**2, ht + gt**2
                self.w += rate * gw / np.sqrt(hw)
                self.t += rate * gt / np.sqrt(ht)
        return self


# ---- training passages --------------------------------------------------------------------------


def _number(r: np.random.Generator, n: int) -> str:
    return "".join(map(str, r.integers(0, 10, n)))


def _card(r: np.random.Generator, valid: bool) -> str:
    while luhn(d := str(r.integers(3, 7)) + _number(r, 15)) != valid:
        pass
    sep = ["", "", " ", "-", "."][r.integers(5)]
    return sep.join(d[i : i + 4] for i in range(0, 16, 4))


def _word(r: np.random.Generator, low: int = 2, high: int = 9) -> str:
    return "".join(chr(97 + c) for c in r.integers(0, 26, r.integers(low, high)))


def _entity(r: np.random.Generator) -> tuple[str, str]:
    at = ["@", "@", " [at] ", "(at)", " (at) ", "[at]"][r.integers(6)]
    dot = "." if at == "@" or r.random() < 0.5 else " [dot] "
    user = _word(r) + ["", ".", "_"][r.integers(3)] + [_word(r), _number(r, 2)][r.integers(2)]
    part = lambda: str(r.integers(0, 256))
    return [
        lambda: ("email", f"{user}{at}{_word(r)}{dot}{['com', 'org', 'net', 'example' + dot + 'com'][r.integers(4)]}"),
        lambda: ("ip", ["." , ".", "[.]"][r.integers(3)].join(part() for _ in range(4))),
        lambda: ("card", _card(r, True)),
        lambda: ("phone", f"+{r.integers(1, 99)} ({_number(r, 3)}) {_number(r, 3)}-{_number(r, 4)}"),
        lambda: ("phone", [f"({_number(r, 3)}) {_number(r, 3)}-{_number(r, 4)}", f"{_number(r, 3)}-{_number(r, 3)}-{_number(r, 4)}"][r.integers(2)]),
    ][r.integers(5)]()


def _decoy(r: np.random.Generator) -> str:
    return [
        lambda: _card(r, False),
        lambda: f"{r.integers(300, 999)}.{r.integers(300, 999)}.{r.integers(1, 999)}.{r.integers(1, 99)}",
        lambda: f"{r.integers(1, 20)}.{r.integers(0, 20)}.{r.integers(0, 40)}",
        lambda: f"{r.integers(1900, 2031)}-{r.integers(10, 13)}-{r.integers(10, 29)}",
        lambda: f"{_number(r, 3)},{_number(r, 3)}.{_number(r, 2)}",
        lambda: _number(r, int(r.integers(3, 14))),
        lambda: f"{_number(r, 4)}-{_number(r, 4)}",
        lambda: f"{_number(r, int(r.integers(12, 17)))} {_number(r, int(r.integers(2, 17)))}",
        lambda: f"@{_word(r)}",
        lambda: f"{_word(r)}{_number(r, 4)}",
        lambda: f'{_word(r)} = "{"".join("0123456789abcdef"[i] for i in r.integers(0, 16, 40))}"',
    ][r.integers(11)]()


def passages(texts: list[str], seed: int = 23) -> list[tuple[str, list[S.Span]]]:
    """Generated passages in contexts of ``texts``, and passages of ``texts`` as the patterns mark them."""
    r, out = np.random.default_rng(seed), []
    frames = [t for t in texts if len(t) > 80] or [" ".join(_word(r) for _ in range(40))]
    for _ in range(GENERATED):
        t = frames[r.integers(len(frames))]
        cut = t.find(" ", int(r.integers(len(t) - 60)))
        cut = max(cut, 0)
        head, tail = t[max(0, cut - 60) : cut], t[cut + 1 : cut + 60]
        if DIGIT.search(head + tail) or "@" in head + tail:
            continue
        cue = [*CUES[int(r.integers(4))]][0] if r.random() < 0.2 else ""
        head = f"{head} {cue} ".replace("  ", " ")
        if r.random() < 0.5:
            kind, value = _entity(r)
            out.append((f"{head}{value} {tail}", [(kind, len(head), len(head) + len(value))]))
        else:
            out.append((f"{head}{_decoy(r)} {tail}", []))
    for t in texts:
        marked = base_spans(t)
        for _, a, b in marked[:3]:
            lo, hi = t.rfind(" ", 0, max(0, a - 40)) + 1, t.find(" ", b + 40)
            hi = len(t) if hi < 0 else hi
            out.append((t[lo:hi], [(k, x - lo, y - lo) for k, x, y in marked if lo <= x and y <= hi]))
    return [(t, m) for t, m in out if all(x[2] <= y[1] for x, y in zip(m, m[1:], strict=False))]


def train(docs: DataFrame, sample: int = SAMPLE) -> SemiMarkov:
    ids = docs.select(F.col("doc_id").alias("_id")).dropna().distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left_semi").select("doc_id", text_of().alias("text"))
    return SemiMarkov().fit(passages([x.text for x in rows.orderBy("doc_id", F.xxhash64("text")).limit(sample).collect()]))


def search(text: str, field: SemiMarkov) -> tuple[list[S.Span], list[S.Span]]:
    """Base spans and all spans."""
    base = base_spans(text)
    added = []
    for tokens in regions(text):
        for i in range(0, len(tokens), 256):  # long regions in parts that overlap by the longest entity
            part = tokens[max(0, i - LONGEST) : i + 256]
            if not SIGN.search(text, part[0][0], part[-1][1]):
                continue
            for a, b, y in field.best(_lattice(text, part)):
                span = (KINDS[y - 1], part[a][0], part[b - 1][1])
                if S.free_of(base, *span[1:]) and S.free_of(added, *span[1:]):
                    added.append(span)
    return base, S.ordered(base + added, KINDS) if added else base


def find_personal(docs: DataFrame, field: SemiMarkov) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) of every document."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [search(t, field) for t in batch.column("text").to_pylist()]
        cols = [pa.array([S.as_arrow(x[k]) for x in got], S.ARROW) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "base", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return batches(rows, make, f"doc_id long, base {S.TYPE}, spans {S.TYPE}")

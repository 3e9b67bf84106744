"""Vector codes, conversation tries, pairwise ranking."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from casetrail.llm import codes, preference, prefixes
from tests.llm.conftest import found, prose

# ---- vector codes -------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, x string, _salt int, code string"


def brute_codes(rows, parts=16, entries=64, rounds=2):
    good = [(i, [int(np.floor(256 * float(e))) for e in v], k) for i, v, k in rows if v is not None and all(e is not None and np.isfinite(e) for e in v)]
    size = len(good[0][1]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in good]
    order = sorted(range(len(good)), key=lambda r: (good[r][0] is None, good[r][0] or 0, good[r][1]))[:entries]
    books = [[cut[r][p] for r in order] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for r in range(len(good)):
                groups.setdefault(near(cut[r][p], books[p])[1], []).append(cut[r][p])
            books[p] = [[sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for r, (i, _, k) in enumerate(good):
        best = [near(cut[r][p], books[p]) for p in range(parts)]
        out.append([i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), k, digest])
    totals = {}
    for row in out:
        totals[row[3]] = totals.get(row[3], 0) + row[2]
    return sorted([(i, c, d, totals[k], h) for i, c, d, k, h in out], key=repr)


def test_vector_codes_match_brute_force(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(32)], r.choice([1, 2, None])) for i in range(300)]
    rows += [(i, rows[5][1], 1) for i in range(300, 340)]  # one common vector
    rows += [(7, rows[8][1], 1), (7, rows[8][1], 1), (None, rows[9][1], None), (-3, rows[9][1], 2)]  # repeated, null and negative ids
    rows += [(400, None, 1), (401, [None] + [0.1] * 31, 1), (402, [float("nan")] + [0.0] * 31, 1), (403, [float("inf")] + [0.0] * 31, 1)]
    df = spark.createDataFrame([(*x, "x", 1, "c") for x in rows], VECTORS).repartition(3)
    assert found(codes.vector_codes(df)) == brute_codes(rows)


def test_vector_codes_of_few_huge_short_and_no_rows(spark):
    few = [(i, [float(i * k) for k in range(16)], None) for i in range(5)]
    df = spark.createDataFrame([(*x, "x", 1, "c") for x in few], VECTORS)
    assert found(codes.vector_codes(df)) == brute_codes(few)
    huge = [(0, [1e200] * 16, 1), (1, [-1e30] * 16, 1), (2, [2.0**25] * 16, 1)]
    got = codes.vector_codes(spark.createDataFrame([(*x, "x", 1, "c") for x in huge], VECTORS)).collect()
    assert [r.error for r in sorted(got)] == [0, 0, 0]
    short = [(0, [], 1), (1, [0.5], 1), (2, None, 1)]
    got = codes.vector_codes(spark.createDataFrame([(*x, "x", 1, "c") for x in short], VECTORS)).collect()
    assert {(r.vec_id, r.code[:2], r.error) for r in got} == {(0, "00", 0), (1, "01", 0)}
    assert codes.vector_codes(spark.createDataFrame([], VECTORS)).collect() == []


@pytest.mark.parametrize("wide", [1, 7, 1000])
def test_trie_walk_in_slices(monkeypatch, wide):
    monkeypatch.setattr(codes, "SLICE", wide)
    r = np.random.default_rng(1)
    parts, back, weight = codes._distinct(r.integers(-4, 5, (500, 4)))
    book = r.integers(-4, 5, (20, 4))
    entry, error = codes.nearest(parts, book)
    far = ((parts[:, None] - book[None]) ** 2).sum(2)
    assert (entry == far.argmin(1)).all() and (error == far.min(1)).all() and weight.sum() == len(back) == 500


# ---- conversation tries -------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, depth int, n long, top string"


def brute_trie(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, prefix_key(role, text), role or "", text or ""))
    own = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        full[c] = own.get(base, [])[:h] + own[c][h:]
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, m in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = {p for p in below if len(p) == len(path) + 1}
        leaves = sum(not any(q[: len(p)] == p and len(q) > len(p) for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in m if len(full[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(m), len(path), parent, len(m), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def prefix_key(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def talks(seed, n=160, longest=14):
    r = random.Random(seed)
    rows = []
    for c in [*range(n // 2), *range(100, 100 + n // 3), *range(-120, -120 + n // 6)]:
        for t in range(r.randint(1, longest)):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["a", "b", "ü" * 3]) if r.random() < 0.95 else prose(r.random(), 3)))
    same = [(c, t, "user", f"turn {t}") for c in range(200, 330) for t in range(9)]  # one common conversation
    odd = [(5, None, None, None), (5, None, None, None), (None, 1, "user", "x"), (60, 3, None, "x"), (60, 3, "user", None), (7, 2, "user", "long " * 9000)]
    return rows + same + odd


@pytest.mark.parametrize("block", [4096, 4])
def test_prefix_trie_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(prefixes, "BLOCK", block)
    monkeypatch.setattr(prefixes, "CHUNK", 8)
    monkeypatch.setattr(prefixes, "HOT_SHARE", 10 if block == 4 else 10_000)
    rows = talks(block)
    df = spark.createDataFrame([(*x, 0, 0, "") for x in rows], TURNS).repartition(3)
    assert found(prefixes.prefix_trie(df)) == brute_trie(rows)


def test_a_small_sketch_screens_less_and_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "CELLS", (4, 4))
    rows = talks(9, 40)
    assert found(prefixes.prefix_trie(spark.createDataFrame([(*x, 0, 0, "") for x in rows], TURNS))) == brute_trie(rows)


def test_prefix_trie_of_no_rows(spark):
    assert prefixes.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []


# ---- pairwise ranking ---------------------------------------------------------------------------


def test_ranking_separates_held_out_documents(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = preference.quality_scores(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    # labels of held-out rows and further columns play no part
    other = labels.withColumn("quality", (1 - labels.quality).cast("int")).where("crc32(cast(doc_id as string)) % 3 = 1")
    mixed = labels.where("crc32(cast(doc_id as string)) % 3 <> 1").unionByName(other)
    again = preference.quality_scores(docs.drop("lang", "source").withColumn("score", docs.doc_id), mixed)
    assert found(again) == found(preference.quality_scores(docs, labels))


def test_ranking_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, None, None), (None, 0, 0), (1, 1, 0), (1, 0, 0), (3, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    got = preference.quality_scores(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    scores = {r.doc_id: r.score for r in got}
    assert scores[1] == scores[2] and scores[4] == scores[5] and scores[None] is not None
    unlabelled = preference.quality_scores(odd, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in unlabelled} == {(0.5, 1)}
    assert preference.quality_scores(none, labels).count() == 0


def test_best_quantile():
    scores, good = np.array([0.1, 0.2, 0.2, 0.9]), np.array([False, False, True, True])
    assert preference._best_quantile(scores, good) in (pytest.approx(0.15), pytest.approx(0.55))
    assert preference._best_quantile(np.array([1.0, 2.0]), np.array([False, True])) == 1.5


def test_learning_needs_both_kinds():
    rows = pd.DataFrame({"x": [[0.0] * len(preference.NAMES)] * 3, "good": [True] * 3})
    assert (preference.learn(rows).score(np.zeros((2, len(preference.NAMES)))) == 0.5).all()

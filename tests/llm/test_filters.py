"""Quality rules, near-duplicates, mixing."""

import collections
import random
import re

import pandas as pd
import pytest

from casetrail.llm import mixing, near, quality
from casetrail.llm.shingles import shingle_set
from tests.llm.conftest import found, prose


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


@pytest.mark.parametrize("text", ["", " a\n a\n\na", "a b c d e f g h " * 3, "é# |<> é\x1cx " * 9, prose(1) + "\n" + prose(1), "same\nsame\n same"])
def test_statistics_match_brute_force(text):
    assert quality.measure(text)[:5] == brute_statistics(text)


def test_rules_are_learned_and_kept_simple():
    good = [quality.measure(prose(i)) for i in range(200)]
    bad = [quality.measure(" | ".join(prose(i).split())) for i in range(200, 260)]
    stats = pd.DataFrame(good + bad, columns=quality.COUNTS + quality.MORE).assign(bad=[0] * 200 + [1] * 60)
    rules = quality.learn_rules(stats)
    assert len(rules) == 1 and len(rules[0]) == 1
    assert quality.learn_rules(stats[stats.bad == 0]) == []


def test_quality_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, None, None), (None, 0, 0), (1, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(odd, labels).collect()
    assert len(got) == odd.count()
    assert {r.doc_id: r.kept for r in got}[4] is False and {r.doc_id: r.kept for r in got}[1] is True
    kept = quality.keep_good(odd, labels)
    assert kept.schema == odd.schema and {r._stats for r in kept.collect()} == {"s", None}
    assert quality.quality_rules(none, labels).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root(i), root(j)
                    comp[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_match_brute_force(spark, odd, none):
    chain = prose(40, 90).split()
    texts = []
    for k in range(6):  # neighbours are alike, the ends are not
        chain = chain[:7] + [f"new{k}"] + chain[7:-6] + [f"end{k}"]
        texts.append(" ".join(chain))
    more = spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = odd.select("doc_id", "text").filter("doc_id is not null").union(more)
    comps, sizes = brute_components({r.doc_id: r.text for r in rows.collect()}.items())
    got = near.near_duplicates(rows).collect()
    assert len(got) == rows.count()
    assert {r.doc_id: r.component_id for r in got} == comps and {r.doc_id: r.n_shingles for r in got} == sizes
    assert near.near_duplicates(none).count() == 0


def test_one_of_each_group_stays(odd):
    kept = near.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and {1, 4, 5, 6, None} <= set(ids) and not {2, 3, 8} & set(ids)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(200, 300), (300, 250)], "a long, b long")
    got = {r.node: r.label for r in near.components(edges).collect()}
    assert {got[k] for k in range(1, 61)} == {0} and got[300] == got[250] == 200


def test_mix_keeps_its_budgets(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    total = sum(r.size for r in got)
    by = collections.defaultdict(list)
    for r, s in zip(got, [r.target for r in got], strict=True):
        assert 0 <= r.taken <= 2 * r.size
        by[(r.source_size, s)].append(r)
    for (size, target), rows in by.items():
        assert size == sum(r.size for r in rows) and abs(sum(r.taken for r in rows) - target) <= 1 and target <= 2 * size
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6
    assert found(mixing.mix(odd.repartition(5))) == sorted((tuple(r) for r in got), key=repr)
    assert mixing.mix(none).count() == 0


def test_mixed_corpus_holds_the_words_taken(odd):
    taken = collections.Counter()
    for r in mixing.mix(odd).collect():
        taken[r.doc_id] += r.taken
    out = mixing.mixed_corpus(odd)
    assert out.schema.names == odd.schema.names
    have = collections.Counter()
    for r in out.collect():
        have[r.doc_id] += len(r.text.encode().split())
        assert r._u == (r.doc_id or 0)
    assert +have == +taken


def test_links_that_no_star_proposes(spark, monkeypatch):
    """A family of texts from the same blocks: large buckets, no shingle that only a pair has."""
    monkeypatch.setattr(near, "_stars", lambda rows, seed: rows.selectExpr("node AS a", "node AS b").limit(0))
    blocks, r = [(prose(500 + i, 20), prose(600 + i, 20)) for i in range(30)], random.Random(4)
    picks = [[r.random() < 0.2 for _ in blocks] for _ in range(400)]
    for k in range(20):
        flipped = set(r.sample(range(30), 3))
        picks.append([x != (i in flipped) for i, x in enumerate(picks[k])])
    rows = [(i, " ".join(b[x] for b, x in zip(blocks, p, strict=True))) for i, p in enumerate(picks)]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)[0]


def test_parities_rule_out_no_link(spark):
    """Bits that differ are at most the shingles that one side alone holds; what is dropped is never alike."""
    r = random.Random(8)
    texts = []
    for size in (1, 4, 5, 30, 200, 900, 4000):
        words = [f"w{r.randrange(10**6)}" for _ in range(size)]
        for change in (0.0, 0.01, 0.03, 0.05, 0.08, 0.2, 0.6):
            texts.append(" ".join(f"c{r.randrange(10**6)}" if r.random() < change else w for w in words))
    sets = [shingle_set(t) for t in texts]
    marks = [(k, len(s), near.parity(s).tolist()) for k, s in enumerate(sets)]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a)]
    got = near.plausible(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(marks, "node long, n long, parity array<long>"))
    got = {tuple(x) for x in got.collect()}
    alike = set()
    for a, b in pairs:
        p, q = set(sets[a].tolist()), set(sets[b].tolist())
        bits = sum((x ^ y).bit_count() for x, y in zip(*[near.parity(sets[k]).view("uint64").tolist() for k in (a, b)], strict=True))
        assert bits <= len(p ^ q)
        if 100 * len(p & q) >= near.THRESHOLD * len(p | q):
            alike.add((a, b))
    assert len(alike) >= 20 and alike <= got and len(got) < len(pairs) / 2


def test_rows_with_one_id_are_judged_by_their_texts(spark):
    a, b = (" ".join(f"{w}{i}" for i in range(40)) for w in ("a", "b"))
    near_a = a.replace("a39", "x")
    cases = [
        ([(3, a), (7, a), (7, b)], [(3, a), (7, b)]),
        ([(5, a), (5, b)], [(5, a), (5, b)]),
        ([(5, a), (5, a), (6, b), (5, b)], [(5, a), (5, b)]),
        ([(3, near_a), (5, a), (5, b), (8, b)], [(3, near_a), (5, b)]),
        ([(None, a), (None, a), (None, None)], [(None, None), (None, a), (None, a)]),
    ]
    for rows, kept in cases:
        got = near.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(kept, key=repr), rows
    got = near.keep_one(spark.createDataFrame([(5, near_a), (5, a)], "doc_id long, text string")).collect()
    assert len(got) == 1 and got[0].text in (a, near_a)

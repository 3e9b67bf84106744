"""Secrets, personal data, substrings, fingerprints, pages."""

import collections
import hashlib
import random
import re
import string

import numpy as np
import pytest

from casetrail.llm import fingerprints, pages, pii, secrets, spans, substrings, suffixes
from tests.llm.conftest import prose

FRAMES = [prose(i) for i in range(40)]


@pytest.fixture(scope="module")
def network():
    return secrets.CharNetwork().fit(*secrets.labelled_findings(FRAMES))


def brute_secrets(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [("assign", *m.span())] if len(m[2]) >= 6 else []
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secret_patterns():
    r = random.Random(5)
    parts = ["Token", "api_key", "PASSWD", '"', "'", " ", ":", "=", "abc123", "a" * 30, "0f" * 13, "AKIA", "ABCD0123" * 3, "é", "x", "Tokeſ"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert secrets.base_spans(t) == brute_secrets(t), t


def test_network_on_held_out_findings(network):
    codes, inside, y = secrets.labelled_findings([prose(i) for i in range(100, 130)], seed=99)
    hit = network.scores(codes, inside) >= network.threshold
    assert hit[y == 1].mean() > 0.9 and hit[y == 0].mean() < 0.03


def test_network_gradient(network):
    codes, inside, y = (x[:8] for x in secrets.labelled_findings(FRAMES[:1]))
    net, h = secrets.CharNetwork(), 1e-6

    def loss():
        z = net.logits(codes, inside)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    grads = net._gradients(codes, inside, y)
    for name, at in (("out", (3,)), ("conv", (7, 2)), ("bias", (1,)), ("emb", (5, 4))):
        net.p[name][at] += h
        up = loss()
        net.p[name][at] -= 2 * h
        down = loss()
        net.p[name][at] += h
        assert abs((up - down) / (2 * h) - grads[name][at]) < 1e-5


def test_secrets_on_odd_rows(spark, odd, none, network):
    got = spans.digest(secrets.find_secrets(odd, network), secrets.KINDS)
    assert got.count() == odd.count() and {r.spans for r in got.collect()} == {""}
    row = spark.createDataFrame([(1, f"é {'ab' * 14} token: {'k9' * 5}.", 7)], "doc_id int, text string, n_chars long")
    one = spans.digest(secrets.find_secrets(row, network), secrets.KINDS).first()
    assert (one.n_assign, one.n_access, one.n_hex) == (1, 0, 1) and one.spans.startswith("hex:2:30,assign:31:")
    assert one.base_sha256 == hashlib.sha256(one.spans.encode()).hexdigest()
    masked = secrets.mask_secrets(row, network).first()
    assert masked.text.startswith(f"é {secrets.MASK} {secrets.MASK}") and masked.n_chars == len(masked.text)
    assert spans.digest(secrets.find_secrets(none, network), secrets.KINDS).count() == 0
    assert secrets.train(none).threshold >= 0.5


@pytest.fixture(scope="module")
def field():
    return pii.SemiMarkov().fit(pii.passages(FRAMES))


def brute_personal(text):
    out = []
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for kind, p in kinds.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15,
            }[kind]
            out += [(kind, *m.span())] if good else []
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_personal_patterns():
    r = random.Random(8)
    for _ in range(5000):
        t = "".join(r.choice("ab@.1 2-5+(9)é255") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(t) == brute_personal(t), t
    assert pii.base_spans("4111 1111 1111 1111") == [("card", 0, 19)]


def test_field_likelihood_gradient_and_best_cut():
    r = np.random.default_rng(1)
    f = pii.SemiMarkov()
    f.w, f.t = r.normal(size=f.w.shape) * 0.1, r.normal(size=f.t.shape) * 0.1
    feats = np.zeros((4, pii.LONGEST, pii.SIZE))
    for e in range(4):
        feats[e, : e + 1] = r.normal(size=(e + 1, pii.SIZE))
    s = f._scores(feats)

    def cuts(p=0):
        if p == 4:
            yield []
        for e in range(p + 1, 5):
            for y in range(5):
                if y == 0 and e - p > 1:
                    continue
                for rest in cuts(e):
                    yield [(p, e, y), *rest]

    def score(cut):
        last, total = 0, 0.0
        for p, e, y in cut:
            total += s[e - 1, e - p - 1, y] + f.t[last, y]
            last = y
        return total

    every = list(cuts())
    z = np.logaddexp.reduce([score(c) for c in every])
    assert abs(z - np.logaddexp.reduce(f._forward(s)[-1])) < 1e-9
    assert f.best(feats) == [x for x in max(every, key=score) if x[2]]
    gw, _ = f.gradient(feats, every[5])
    f.w[1, 2] += 1e-6
    s2 = f._scores(feats)
    s, old = s2, z
    up = score(every[5]) - np.logaddexp.reduce([score(c) for c in every])
    f.w[1, 2] -= 1e-6
    s = f._scores(feats)
    assert abs((up - (score(every[5]) - old)) / 1e-6 - gw[1, 2]) < 1e-3


def test_field_on_held_out_passages(field):
    hit = miss = wrong = 0
    for text, marked in pii.passages([prose(i) for i in range(200, 240)], seed=5):
        got = {(pii.KINDS[y - 1], t[a][0], t[b - 1][1]) for t in pii.regions(text) for a, b, y in field.best(pii._lattice(text, t))}
        hit, miss, wrong = hit + len(got & set(marked)), miss + len(set(marked) - got), wrong + len(got - set(marked))
    assert hit > 200 and miss < 0.05 * hit and wrong < 0.05 * hit


def test_personal_on_odd_rows(spark, odd, none, field):
    got = spans.digest(pii.find_personal(odd, field), pii.KINDS)
    assert got.count() == odd.count() and {r.spans for r in got.collect()} == {""}
    row = spark.createDataFrame([(1, "é mail bo.li [at] example [dot] org or a.b@c.de now")], "doc_id long, text string")
    one = spans.digest(pii.find_personal(row, field), pii.KINDS).first()
    assert one.n_email == 1 and one.spans == "email:7:35,email:39:47"
    assert one.base_sha256 == hashlib.sha256(b"email:39:47").hexdigest()
    assert spans.digest(pii.find_personal(none, field), pii.KINDS).count() == 0


def test_suffix_arrays():
    r = random.Random(1)
    for trial in range(150):
        b = bytes(r.randint(0, r.choice([1, 3, 255])) for _ in range(r.randint(1, 120))) * (1 + trial % 3)
        got = suffixes.suffix_array(b)
        assert got.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        agree = suffixes.permuted_prefixes(b, got)
        for x, y in zip(got[1:], got, strict=False):
            n = 0
            while n < 255 and max(x, y) + n < len(b) and b[x + n] == b[y + n]:
                n += 1
            assert agree[x] == n


def brute_repeats(rows):
    n = collections.Counter()
    for _, raw in rows:
        n.update(raw[i : i + 200] for i in range(len(raw) - 199))
    out = []
    for doc, raw in rows:
        gone = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - 199):
            if n[raw[i : i + 200]] > 1:
                gone[i : i + 200] = 1
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((doc, len(raw), int(gone.sum()), int((np.diff(gone, prepend=0) > 0).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("crowd", [256, 1])
def test_repeats_match_brute_force(spark, monkeypatch, odd, none, crowd):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    monkeypatch.setattr(substrings, "CHUNK", 700)
    shared, short = prose(70, 60), prose(71, 20)
    more = [(200 + k, prose(80 + k, 50) + shared[k : 300 + k] + prose(90 + k, 40) + short + prose(300 + k, 60)) for k in range(6)]
    more += [(210, "ab" * 300), (211, prose(95)[:150] + "é" * 120 + prose(96)[:99]), (212, "q" + "é" * 120)]
    rows = odd.select("doc_id", "text", "word").union(spark.createDataFrame([(a, b, "") for a, b in more], "doc_id long, text string, word string"))
    got = substrings.remove_repeats(rows)
    want = brute_repeats([(r.doc_id, (r.text or "").encode()) for r in rows.collect()])
    assert sorted((tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr) == want
    assert substrings.remove_repeats(none).count() == 0


def jaccard(a, b):
    a, b = (collections.Counter(x.encode().split()) for x in (a, b))
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


@pytest.mark.parametrize("ranges", [1024, 3])
def test_fingerprints(spark, monkeypatch, odd, none, ranges):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", ranges)
    rows = odd.filter("doc_id is not null").dropDuplicates(["doc_id"]).union(odd.filter("doc_id is null"))
    order = sorted(((r.doc_id, r.text or "") for r in rows.collect()), key=lambda x: (x[0] is None, -(x[0] or 0)))
    got = {r.doc_id: r for r in fingerprints.fingerprints(rows).collect()}
    assert len(got) == len(order)
    for (doc, text), (follower, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        edited, r = text[: len(text) - half] + after[:half], got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), doc
        same = [a == b for a, b in zip(*(re.findall(".{8}", x) for x in (r.fingerprint, got[follower].fingerprint)), strict=True)]
        assert r.near_next == sum(same) / fingerprints.SAMPLES
        if text.split():
            assert abs(r.near_edited - jaccard(text, edited)) < 0.3
    assert got[1].fingerprint == got[2].fingerprint and got[4].fingerprint == got[5].fingerprint
    assert fingerprints.fingerprints(none).count() == 0
    assert fingerprints.fingerprints(odd).count() == odd.count()


@pytest.fixture(scope="module")
def trees():
    return pages.BoostedTrees(3).fit(*pages.training_set([]))


def test_trees_on_held_out_pages(trees):
    w, right = pages._Writer(np.random.default_rng(4242)), 0
    for _ in range(60):
        source = w.page()
        page = pages.Page(source)
        truth = np.array([0] + [int(m[1]) if m[1] else 2 for m in re.finditer(r'<[a-z][a-z0-9]*(?: data-l="(\d)")?', source)])
        right += page.text(page.decode(trees.log_probabilities(page.features()))) == page.text(truth)
    assert right >= 57


def test_labels_do_not_contradict(trees):
    r = np.random.default_rng(3)
    page = pages.Page(pages._Writer(r).page())
    label = page.decode(r.normal(size=(len(page.parent), 3)))
    for k, p in enumerate(page.parent):
        if p >= 0:
            assert label[p] == pages.FRAME or label[p] == pages.CONTENT and label[k] != pages.FRAME or label[k] == pages.CLUTTER


def test_pages_on_odd_rows(spark, trees):
    article = "<html><body><nav><ul><li><a href=/x>Go</a></li></ul></nav><article><h1>A &amp; B</h1><p>One\n  two <b>three.<p>Four &eacute;, five and six words.</article><footer>&copy; x</footer>"
    rows = [(1, "u", article), (1, "u", article), (2, None, None), (3, "v", ""), (4, "w", "<<p <!-- x"), (None, "z", "<p>" * 3000)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), trees).collect()
    assert len(got) == len(rows)
    assert [r.text for r in got if r.page_id == 1] == ["A & B\nOne two three.\nFour é, five and six words."] * 2
    assert {r.page_id: r.text for r in got}[2] == "" and all(r.n_chars == len(r.text) for r in got)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert pages.extract(none, pages.train(none)).count() == 0


def test_generated_secrets_hold_no_mark():
    r = np.random.default_rng(1)
    values = [secrets._generated(r, True)[1] for _ in range(500)]
    assert max(collections.Counter(v[-2:] for v in values).values()) < 50
    assert all(re.search("[a-zA-Z]", v) and re.search("[0-9]", v) for v in values)


def test_possible_keys_are_no_negatives():
    plain = len(secrets.labelled_findings(["word"])[2])
    assert len(secrets.labelled_findings(["word Zk3vQ9xLm2TtR8bWc5Yd"])[2]) == plain
    assert len(secrets.labelled_findings(["word release-12b"])[2]) == plain + 1


def test_threshold_keeps_recall_below_one_half():
    net, r = secrets.CharNetwork(), np.random.default_rng(2)
    y = (r.random(2000) < 0.1).astype(float)
    z = r.normal(size=2000) + y
    net._calibrate(z, y)
    p = 1 / (1 + np.exp(-(net.scale * z + net.shift)))
    assert (p >= net.threshold)[y > 0].mean() >= secrets.RECALL


def test_keys_at_the_end_of_long_runs(network):
    r, hit, wrong = np.random.default_rng(7), 0, 0
    for k in range(200):
        key = secrets._draw(r, string.ascii_letters + string.digits, 40, 41)
        run = ["AWS_SECRET_ACCESS_KEY=", "deploy/config/environments/production/keys/"][k % 2]
        text = f"{prose(k, 8)} {run}{key} {prose(k + 1, 8)}"
        a = text.index(run)
        (_, spans_of), = secrets.scan([text], network)
        hit += any(x <= a and y == a + len(run) + 40 or x <= a + len(run) and y >= a + len(run) + 40 for _, x, y in spans_of)
        other = f"{prose(k, 8)} deploy/config/environments/production/{prose(k, 1)}/release{k % 90} {prose(k + 1, 8)}"
        wrong += bool(secrets.scan([other], network)[0][1])
    assert hit >= 190 and wrong <= 10
    assert [w for w in secrets.windows(3, 100)] == [(3, 43), (23, 63), (43, 83), (60, 100)]

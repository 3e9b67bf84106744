"""Token ids, packing, training order, pipeline and registered queries."""

import collections
import random
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from casetrail.llm import packing, queries, tokens, training_order
from tests.llm.conftest import found
from tools.compare import TABLES, rows as normal


def ids_of(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [tokens.END]


def tokenizer(known=[]):  # noqa: B006
    if not known:
        known.append(Tokenizer.from_file(tokens.VOCABULARY))
    return known[0]


def test_ids_are_those_of_the_whole_text():
    r = random.Random(1)
    odd = "aé́ ́b Σας ΣΑΣ İ \x1c\x85 x <|endoftext|><|startoftext|>'s 'S don't 123４  \t\r\nK　ſ½힣한"
    texts = ["".join(r.choice(odd) for _ in range(50)) for _ in range(300)] + ["", " ", odd, "a" * 5000]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encode(texts)] == [ids_of(t) for t in texts]


@pytest.mark.parametrize("text", ["<|startoftext|>", "<|endoftext|>", "<|startoftext|><|endoftext|> <|startoftext|>"])
def test_texts_of_special_tokens_only(text):
    assert np.frombuffer(tokens.encode([text])[0], "<u4").tolist() == ids_of(text)


def test_fullest_matches_brute_force():
    r = random.Random(2)
    for _ in range(200):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(5)}
        room = r.randint(1, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + j * k for s in sums for j in range(n + 1)}
        used = packing.fullest(counts, room)
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in used.items())


def test_packing_round_trip(odd, none):
    got = packing.packed_sequences(odd, capacity=256).collect()
    want = collections.Counter()
    for r in odd.collect():
        ids = ids_of(r.text)
        for k in range(0, len(ids), 256):
            part = ids[k : k + 256]
            want[(r.doc_id, k // 256, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= -(-sum(r.length for r in got) // 256) + 1
    assert packing.packed_sequences(none).count() == 0


def test_training_order(tmp_path, odd, none):
    order, rows = training_order.write_training_order(odd, f"file://{tmp_path}/a", key=9, length=64, per_shard=5)
    rows = rows.collect()
    assert sorted(r.slot for r in rows) == sorted(r.sequence for r in rows) == list(range(order.sequences))
    got = list(training_order.read_order(f"file://{tmp_path}/a"))
    by = {r.slot: r for r in rows}
    assert all(zlib.crc32(x.tobytes()) == by[s].ids_crc32 for s, x in enumerate(got))
    stream = np.concatenate([got[r.slot][: r.n_tokens] for r in sorted(rows, key=lambda r: r.sequence)])
    ends = np.flatnonzero(stream == tokens.END) + 1
    docs = collections.Counter(tuple(x.tolist()) for x in np.split(stream, ends) if len(x))
    assert docs == collections.Counter(tuple(ids_of(r.text)) for r in odd.collect())
    assert all((a == b).all() for a, b in zip(training_order.read_order(f"file://{tmp_path}/a", 7), got[7:], strict=True))
    again = training_order.write_training_order(odd.repartition(7), f"file://{tmp_path}/b", key=9, length=64, per_shard=5)[1]
    assert found(again) == sorted((tuple(r) for r in rows), key=repr)
    assert training_order.write_training_order(none, f"file://{tmp_path}/c")[1].count() == 0


def test_ids_on_disk_are_compressed_over_many_texts(spark, tmp_path):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([0, 5, 20, 60, 3000 if i % 50 == 0 else 40]))) for i in range(14_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = training_order._token_files(docs, tokens.VOCABULARY, f"file://{tmp_path}/ids", 2).collect()
    total = 2 * sum(x.n for x in rows)
    assert total > 1.2 * training_order.BLOCK
    assert sum(f.stat().st_size for f in (tmp_path / "ids").iterdir()) < 0.6 * total
    order, rows = training_order.write_training_order(docs, f"file://{tmp_path}/a", length=256, per_shard=512)
    got = list(training_order.read_order(f"file://{tmp_path}/a"))
    stream = np.concatenate([got[x.slot][: x.n_tokens] for x in sorted(rows.collect(), key=lambda x: x.sequence)])
    assert order.tokens == len(stream) == total // 2
    kept = collections.Counter(x.tobytes() for x in np.split(stream, np.flatnonzero(stream == tokens.END)[:-1] + 1))
    assert kept == collections.Counter(np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in tokens.encode(texts))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_slots_are_a_permutation(n):
    order = training_order.Order(n, 0, 8, 4, key=5)
    assert sorted(order.slot(np.arange(n)).tolist()) == list(range(n))


def test_queries_with_sql(spark, data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df, cur = queries.queries()[name](spark, data), con.execute(sql)
        cols = [c[0] for c in cur.description]
        assert sorted(df.columns) == sorted(cols)
        assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(cols, cur.fetchall())


def test_pipeline(spark, data):
    docs, seen = spark.read.parquet(f"{data}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        seen.append(out.columns)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert all(c == seen[0] for c in seen[:-1]) and {"doc_id", "sequence_id", "offset"} <= set(seen[-1])
    assert found(corpus_pipeline.run(spark, data)) == found(docs)
    assert "pipeline" in entry.queries() and len([n for n in entry.queries() if n.startswith("op")]) >= 10

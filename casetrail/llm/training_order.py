"""Token ids in training order: fixed-stride binary shards for sequential, resumable reads.

Documents (each closed by END) form one stream in the order of a hash; it is cut into sequences of LENGTH ids, the last
filled up with PAD. A keyed Feistel permutation gives every sequence its global slot without a table: the smallest even
number of bits that holds all numbers is permuted, and results beyond the last sequence are permuted again until
they fall inside (cycle-walking). Slots are range-partitioned by shard, whose number is computed, so no range is sampled;
a task writes whole shards, each a file of PER_SHARD records of LENGTH little-endian ids (16 bits wide, 32 for a vocabulary
of more than 65,536), under a temporary name first, so repeated or lost tasks do no harm. Slot s is record s % PER_SHARD of
shard s // PER_SHARD: a reader resumes anywhere by seeking.

Ids move once, to their shard. Tokenizing tasks leave them in files of their own, in the order of their rows, many texts
compressed together; only lengths and hashes are shuffled for the places in the stream, and come back to the task that
reads such a file. The files stay until the shards are written, so a lost task of any stage finds what it read.

Defined cases: a null or empty text is the single id END; rows that repeat are written as often; further columns are
ignored; an empty table gives no rows and no shards; a very long text is one value of a file and is cut at the sequences when it is read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from casetrail.llm import tokens
from casetrail.llm.common import running_total, spread, staged, text_of, uniform
from casetrail.llm.packing import TOGETHER

LENGTH = 2048
PER_SHARD = 2048
PAD = 0
ROUNDS = 4
MANIFEST = "manifest.json"
#: Compressed bytes after which a task passes on what it has cut.
PASS_ON = 1 << 24
#: Bytes of ids that are compressed together in a task's file; a longer text is a block of its own.
BLOCK = 1 << 21
#: zstd levels of such blocks and of the parts that are shuffled.
BLOCK_LEVEL, PART_LEVEL = 5, 2


#: Ids of one text.
FILE = pa.schema([("ids", pa.large_binary())])


@dataclass(frozen=True)
class Order:
    """What is needed to find any sequence of a written order."""

    sequences: int
    tokens: int
    length: int
    per_shard: int
    key: int
    width: int = 2

    @property
    def stride(self) -> int:
        return self.width * self.length

    @property
    def type(self) -> str:
        return f"<u{self.width}"

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        """Global slots of sequences: Feistel rounds over half words, walked until inside the range."""
        half = max((max(self.sequences - 1, 1).bit_length() + 1) // 2, 1)
        mask = np.uint64((1 << half) - 1)
        out = np.asarray(sequence, np.uint64).copy()
        walk = np.arange(len(out))
        with np.errstate(over="ignore"):
            while len(walk):
                left, right = out[walk] >> np.uint64(half), out[walk] & mask
                for k in range(ROUNDS):
                    f = (right + np.uint64((self.key + k * 0x9E3779B97F4A7C15) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
                    f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                    left, right = right, left ^ ((f >> np.uint64(32)) & mask)
                out[walk] = (left << np.uint64(half)) | right
                walk = walk[out[walk] >= np.uint64(self.sequences)]
        return out.astype(np.int64)

    def file(self, shard: int) -> str:
        return f"shard-{shard:08d}.bin"


def _token_files(docs: DataFrame, vocabulary: str, folder: str, width: int) -> DataFrame:
    """doc_id, n, _u, and where the ids are: _task, _file, _row. A repeated task writes a file of another name."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task, file, row = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", BLOCK_LEVEL))
        with store.open_output_stream(f"{base}/{file}") as out, pa.ipc.new_stream(out, FILE, options=options) as stream:
            block, size = [], 0

            def write() -> None:
                stream.write_batch(pa.RecordBatch.from_arrays([pa.array(block, pa.large_binary())], schema=FILE))

            for batch in source:
                texts, n = batch.column("text").to_pylist(), []
                for i in range(0, len(texts), TOGETHER):
                    for raw in tokens.encode(texts[i : i + TOGETHER], vocabulary):
                        n.append(len(raw) // 4)
                        ids = np.frombuffer(raw, "<u4").astype(f"<u{width}").tobytes()
                        if block and size + len(ids) > BLOCK:
                            write()
                            block, size = [], 0
                        block.append(ids)
                        size += len(ids)
                rows = pa.array(np.arange(row, row + len(n)))
                row += len(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n, pa.int64()), batch.column("_u"), pa.array([task] * len(n), pa.int32()), pa.array([file] * len(n)), rows],
                    names=["doc_id", "n", "_u", "_task", "_file", "_row"],
                )
            if block:
                write()

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    rows = rows.withColumn("_u", uniform(F.col("doc_id"), F.xxhash64("text"), seed=1))
    return rows.mapInArrow(run, "doc_id long, n long, _u long, _task int, _file string, _row long")


def _values(store: fs.FileSystem, path: str) -> Iterator[bytes]:
    with store.open_input_stream(path) as raw, pa.ipc.open_stream(raw) as stream:
        for batch in stream:
            yield from batch.column("ids").to_pylist()


def _parts(order: Order, folder: str):
    """Documents cut at the sequences; rows (_file, _row, _start) come sorted, all rows of a file in one task."""
    names = ["_shard", "slot", "sequence", "_at", "_ids"]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=PART_LEVEL)
        store, base = fs.FileSystem.from_uri(folder)
        opened, values, next_row = None, iter(()), 0
        seq, at, ids, size = [], [], [], 0

        def cut() -> pa.RecordBatch:
            numbers = np.array(seq, np.int64)
            slot = order.slot(numbers)
            cols = [pa.array(slot // order.per_shard), pa.array(slot), pa.array(numbers), pa.array(at, pa.int32()), pa.array(ids, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in source:
            for file, row, start in zip(*[batch.column(c).to_pylist() for c in ("_file", "_row", "_start")], strict=True):
                if file != opened:
                    opened, values, next_row = file, _values(store, f"{base}/{file}"), 0
                if row != next_row:
                    raise ValueError(f"row {next_row} of {file} has no place in the stream")
                raw, done, next_row = next(values), 0, row + 1
                while done < len(raw):
                    where = start + done // order.width
                    take = min(len(raw) - done, order.width * (order.length - where % order.length))
                    seq.append(where // order.length)
                    at.append(where % order.length)
                    ids.append(squeeze.compress(raw[done : done + take]))
                    size += len(ids[-1])
                    done += take
                if size > PASS_ON:
                    yield cut()
                    seq, at, ids, size = [], [], [], 0
        if seq:
            yield cut()

    return run


def _writer(order: Order, folder: str):
    """Rows come sorted by slot and place; every shard's rows are in one task."""

    def save(store: fs.FileSystem, base: str, shard: int, data: bytes) -> None:
        kept = f"{base}/{order.file(shard)}"
        temporary = f"{base}/.{order.file(shard)}.{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as out:
            out.write(data)
        store.move(temporary, kept)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        shard, data, seen = None, bytearray(), {}

        def close() -> pa.RecordBatch:
            save(store, base, shard, bytes(data))
            rows = []
            for slot, (seq, n) in sorted(seen.items()):
                at = (slot - shard * order.per_shard) * order.stride
                rows.append((slot, seq, shard, at, n, zlib.crc32(memoryview(data)[at : at + order.stride])))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(cols, names=["slot", "sequence", "shard", "byte_offset", "n_tokens", "ids_crc32"])

        for batch in source:
            for s, slot, seq, at, packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if s != shard:
                    if shard is not None:
                        yield close()
                    shard, seen = s, {}
                    records = min(order.per_shard, order.sequences - s * order.per_shard)
                    data = bytearray(np.full(records * order.length, PAD, order.type).tobytes())
                raw = expand.decompress(packed)
                to = (slot - s * order.per_shard) * order.stride + order.width * at
                data[to : to + len(raw)] = raw
                seen[slot] = (seq, seen.get(slot, (seq, 0))[1] + len(raw) // order.width)
        if shard is not None:
            yield close()

    return run


def write_training_order(
    docs: DataFrame, folder: str, key: int = 1, vocabulary: str = tokens.VOCABULARY, length: int = LENGTH, per_shard: int = PER_SHARD
) -> tuple[Order, DataFrame]:
    """Writes shards and a manifest below ``folder`` (a URI that all executors reach). The rows of the result:
    slot, sequence, shard, byte_offset, n_tokens (PAD not counted), ids_crc32 of the record."""
    width = 2 if Tokenizer.from_file(vocabulary).get_vocab_size() <= 1 << 16 else 4
    ids = f"{folder}/.ids-{uuid.uuid4().hex}"
    rows = staged(_token_files(docs, vocabulary, ids, width), "order-lengths")
    total, n, tasks = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max("_task") + 1, F.lit(1))).first()
    order = Order(-(-total // length), total, length, per_shard, key, width)
    light = rows.withColumn("_parts", spread(F.lit(n)))
    placed = running_total(light, [], "_u", "_parts", "n", ["doc_id", "n"], "_start").select("_task", "_file", "_row", "_start")
    placed = placed.repartitionById(tasks, "_task").sortWithinPartitions("_file", "_row")
    parts = placed.mapInArrow(_parts(order, ids), "_shard long, slot long, sequence long, _at int, _ids binary")
    shards = max(-(-order.sequences // per_shard), 1)
    parts = parts.repartitionById(shards, F.col("_shard").cast("int")).sortWithinPartitions("_shard", "slot", "_at")
    shape = "slot long, sequence long, shard long, byte_offset long, n_tokens int, ids_crc32 long"
    written = staged(parts.mapInArrow(_writer(order, folder), shape), "order-written")
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{MANIFEST}") as out:
        out.write(json.dumps(asdict(order)).encode())
    if n:
        store.delete_dir(f"{base}/{ids.rsplit('/', 1)[1]}")
    return order, written


def read_order(folder: str, slot: int = 0) -> Iterator[np.ndarray]:
    """Sequences in training order, from ``slot`` on."""
    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{base}/{MANIFEST}") as f:
        order = Order(**json.loads(f.read()))
    while slot < order.sequences:
        shard, record = divmod(slot, order.per_shard)
        with store.open_input_file(f"{base}/{order.file(shard)}") as f:
            f.seek(record * order.stride)
            while raw := f.read(order.stride):
                yield np.frombuffer(raw, order.type)
                slot += 1


"""Training-order materialisation: token sequences at global slots of a keyed permutation, in fixed-stride shards.

Documents are dealt into chunks by a hash of id and text; a chunk's documents, in the order of (id, hash of the text),
are tokenised and joined to one stream with an end token after each, which is cut into sequences of `length` ids. A sequence has an index: its number in the chunk after the room that a first pass over the text lengths sets aside
for the chunks before (a byte-level token covers a byte at least). Chunks, room and order depend on the rows alone, so
neither files nor partitions nor cores change where a sequence comes. A Feistel network with cycle-walking permutes all
indexes. Ranges of permuted indexes are the shards: a shuffle brings each range to one task, which sorts it and writes
one file of records of one length. Indexes without a sequence leave no gap, as slots are numbered by the order of the
records; the manifest has the first slot of each shard. Slot s of a shard lies at byte (s - first) * stride, so a reader
resumes anywhere with one seek. Texts and ids are compressed on their ways, with the beginnings of some texts, and
their ids, as dictionaries of 1 MiB at most; nothing but the size of what is shuffled depends on these.

A record: index u64, ids in use u32, `length` ids u16 or u32, all little-endian, and one newline, which
is the separator of Spark's text writer: it writes to any file system that Spark knows, bytes as they are.

Defined results: a null or empty text is its end token; rows that repeat come as often as they do, those that repeat
both id and text in one chunk; documents without an id come first in their chunk; only the last sequence of a chunk may
be padded, with zeros; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismgraph.llm.common import bound_batches, buckets
from prismgraph.llm.packing import file_bpe

HEAD = "<QI"
HEAD_SIZE = struct.calcsize(HEAD)
ROUNDS = 6
#: The finest chunks that are counted; their number, a power of two, is lowered to what the text needs.
FINEST = 1 << 17
#: Texts, characters of each, and bytes of the dictionaries for compression.
SAMPLE, SAMPLE_CHARS, DICTIONARY = 512, 4096, 1 << 20
LEVEL = 5
_M = (1 << 64) - 1


def _round_keys(key: int) -> list[int]:
    out, x = [], key & _M
    for _ in range(ROUNDS):
        x = (x + 0x9E3779B97F4A7C15) & _M
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M
        out.append(z ^ (z >> 31))
    return out


def permuted(index: np.ndarray, domain: int, key: int, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of range(domain): a balanced Feistel network over the next even number of bits, walked on
    along its cycle until the value is inside the domain again."""
    half = np.uint64(max(1, (max(domain - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64(k) for k in _round_keys(key)]
    x = index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half, x[todo] & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_scramble(left, k) & mask), left
            else:
                left, right = right, left ^ (_scramble(right, k) & mask)
        x[todo] = (left << half) | right
        todo = todo[x[todo] >= domain]
    return x.astype(np.int64)


def _scramble(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x ^ key) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _dictionaries(texts: DataFrame, chosen: list[int], tokenizer: str, end_id: int, kind: np.dtype) -> tuple[bytes, bytes]:
    """What texts and ids are compressed with: parts of the texts with the chosen hashes, and their ids."""
    o = F.xxhash64("doc_id", "h")
    some = texts.filter(o.isin(chosen)).groupBy(o.alias("o")).agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("t"))
    parts = [r["t"] for r in some.orderBy("o").collect()]  # SAMPLE rows at most
    encode, end = file_bpe(tokenizer), np.array([end_id], np.uint32)
    ids = b"".join(np.concatenate([encode(t), end]).astype(kind).tobytes() for t in parts)
    return "".join(parts).encode()[:DICTIONARY], ids[:DICTIONARY]


def _codec(dictionary: bytes) -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
    """Functions that compress and decompress with a dictionary."""
    with_data = {"dict_data": zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if dictionary else {}
    if with_data:
        with_data["dict_data"].precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, **with_data).compress, zstandard.ZstdDecompressor(**with_data).decompress


def _pressed(dictionaries):
    """chunk, doc_id, h, text -> chunk, doc_id, h and the text compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, _ = _codec(dictionaries.value[0])
        for b in batches:
            packed = pa.array([press(x.as_py().encode()) for x in b.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], packed], names=["chunk", "doc_id", "h", "packed"])

    return run


def _records(tokenizer: str, end_id: int, length: int, kind: np.dtype, base, dictionaries, domain: int, shards: int, key: int, rows_out: int = 1024):
    """Documents sorted by chunk -> their sequences: shard, at, used, the record's ids compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, unpress, press = file_bpe(tokenizer), _codec(dictionaries.value[0])[1], _codec(dictionaries.value[1])[0]
        chunk, held, size, number = None, [], 0, 0
        out: list[tuple[int, int, bytes]] = []

        def cut(ids: np.ndarray, used: int) -> None:
            nonlocal number
            start, room = base.value[chunk]
            if number >= room:
                raise ValueError("a chunk has more sequences than its texts have room for: the input changed between passes")
            out.append((start + number, used, press(ids.astype(kind).tobytes())))
            number += 1

        def end() -> None:
            if size:
                ids = np.concatenate(held)
                cut(np.concatenate([ids, np.zeros(length - size, np.uint32)]), size)

        def batch() -> pa.RecordBatch:
            index = np.array([r[0] for r in out], np.int64)
            at = permuted(index, domain, key)
            shard = np.array([int(a) * shards // domain for a in at], np.int32)
            columns = [pa.array(shard), pa.array(at), pa.array(index), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["shard", "at", "index", "used", "ids"])

        for b in batches:
            for here, raw in zip(b.column(0).to_pylist(), b.column(1)):
                if here != chunk:
                    end()
                    chunk, held, size, number = here, [], 0, 0
                held += [encode(unpress(raw.as_buffer()).decode()), np.array([end_id], np.uint32)]
                size += len(held[-2]) + 1
                if size >= length:
                    ids = np.concatenate(held)
                    whole = len(ids) // length * length
                    for i in range(0, whole, length):
                        cut(ids[i : i + length], length)
                        if len(out) >= rows_out:
                            yield batch()
                    held, size = [ids[whole:]], len(ids) - whole
        end()
        if out:
            yield batch()

    return run


def _written(dictionaries):
    """index, used, ids compressed -> the record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, unpress = _codec(dictionaries.value[1])
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))
            made = [struct.pack(HEAD, index, used) + unpress(raw.as_buffer()) for index, used, raw in rows]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    return run


def materialise(
    spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, length: int = 2048, end_id: int = 1, key: int = 2024, shard_text_bytes: int = 32 << 20, wide: bool = False, chunk_text_bytes: int = 16 << 20
) -> DataFrame:
    """Writes the shards under path and returns the manifest: shard, first_slot, records, stride, file."""
    bound_batches(spark)
    kind = docs.schema["doc_id"].dataType
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    finest = F.pmod(F.xxhash64("doc_id", "h"), F.lit(FINEST))
    room = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("bytes")
    least = F.min(F.when(F.octet_length("text") > 0, F.xxhash64("doc_id", "h"))).alias("least")
    counted = texts.groupBy(finest.alias("c")).agg(room, least).collect()  # FINEST rows at most
    found = [(r["c"], r["bytes"]) for r in counted]
    stride = HEAD_SIZE + length * (4 if wide else 2) + 1
    schema = "shard int, first_slot long, records long, stride int, file string"
    total = sum(n for _, n in found)
    if not total:
        return spark.createDataFrame([], schema)
    chunks = min(FINEST, 1 << (buckets(total, chunk_text_bytes) - 1).bit_length())
    sizes = [0] * chunks
    for c, n in found:
        sizes[c % chunks] += n
    base, domain = [], 0
    for n in sizes:
        base.append((domain, -(-n // length)))
        domain += base[-1][1]
    shards = buckets(total, shard_text_bytes)
    sent = texts.select((finest % chunks).cast("int").alias("chunk"), "doc_id", "h", F.coalesce("text", F.lit("")).alias("text"))
    chosen = sorted(r["least"] for r in counted if r["least"] is not None)[:SAMPLE]
    ids_kind = np.dtype("<u4" if wide else "<u2")
    dictionaries = spark.sparkContext.broadcast(_dictionaries(texts, chosen, tokenizer, end_id, ids_kind))
    pressed = sent.mapInArrow(_pressed(dictionaries), f"chunk int, doc_id {kind.simpleString()}, h long, packed binary")
    streams = pressed.repartitionById(chunks, F.col("chunk")).sortWithinPartitions("chunk", F.col("doc_id").asc_nulls_first(), "h").select("chunk", "packed")
    made = streams.mapInArrow(_records(tokenizer, end_id, length, ids_kind, spark.sparkContext.broadcast(base), dictionaries, domain, shards, key), "shard int, at long, index long, used int, ids binary")
    dealt = made.repartitionById(shards, F.col("shard")).sortWithinPartitions("at").select("index", "used", "ids").mapInArrow(_written(dictionaries), "record binary")
    dealt.select(F.col("record").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\n").text(f"{path}/shards")
    written = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards").select("path", "length")
    name = F.regexp_extract("path", r"part-(\d+)", 1).cast("int")
    files = sorted((r["shard"], r["path"], r["length"]) for r in written.select(name.alias("shard"), "path", "length").collect())  # one row per shard
    rows, slot = [], 0
    for shard, file, size in files:
        records, rest = divmod(size, stride)
        if rest:
            raise ValueError(f"{file} isn't a whole number of records")
        rows.append((shard, slot, records, stride, file))
        slot += records
    return spark.createDataFrame(rows, schema)


def _slots(length: int, wide: bool):
    names = ["slot", "shard", "offset", "index", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, first, stride, raw in zip(*(c for c in (b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)))):
                view = memoryview(raw.as_buffer())
                out = []
                for n in range(len(view) // stride):
                    at = n * stride
                    index, used = struct.unpack_from(HEAD, view, at)
                    ids = np.frombuffer(view, "<u4" if wide else "<u2", length, at + HEAD_SIZE)[:used]
                    out.append((first + n, shard, at, index, used, zlib.crc32(ids.astype("<u4").tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "shard" else pa.int64()) for n, c in zip(names, zip(*out))], names=names)

    return run


def read_slots(spark: SparkSession, path: str, manifest: DataFrame, length: int = 2048, wide: bool = False, from_slot: int = 0) -> DataFrame:
    """One row per record from a slot on, read back from the shards: slot, shard, offset (bytes), index, n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards")
    here = manifest.filter(F.col("first_slot") + F.col("records") > from_slot)
    rows = files.join(F.broadcast(here), files["path"] == here["file"]).select("shard", "first_slot", "stride", "content")  # one row per shard
    schema = "slot long, shard int, offset long, index long, n_tokens long, ids_crc32 long"
    return rows.mapInArrow(_slots(length, wide), schema).filter(F.col("slot") >= from_slot)


def read_ids(file: str, slot: int, first_slot: int, length: int = 2048, wide: bool = False) -> np.ndarray:
    """The ids at one slot of a shard file that this machine can open, by one seek."""
    stride = HEAD_SIZE + length * (4 if wide else 2) + 1
    with open(file.removeprefix("file://").removeprefix("file:"), "rb") as f:
        f.seek((slot - first_slot) * stride)
        raw = f.read(stride)
    _, used = struct.unpack_from(HEAD, raw)
    return np.frombuffer(raw, "<u4" if wide else "<u2", length, HEAD_SIZE)[:used].astype(np.uint32)

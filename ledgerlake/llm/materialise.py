"""Training-order materialisation: a keyed Feistel permutation gives every sequence its place in fixed-stride shards.

Documents are put in one total order (doc_id, then a hash of the text), tokenised in that order, and cut into sequences
0..n-1 of the whole token stream, so neither the input's files nor the number of partitions have a say in what a sequence
holds.  A Feistel network keyed by ``key`` permutes 0..n-1, cycle-walking keeps the image inside that range, and the image
is the sequence's global slot.  A shard is a range of ``shard_size`` slots; only the last may hold fewer.  One shuffle
brings each shard's pieces to the task that puts them in place, writes the shard with a fixed stride and renames it.  A reader finds slot
s in shard ``s // shard_size`` at record ``s % shard_size``, and resumes anywhere.

Scale: the order is a range partitioning on (doc_id, text hash), which also splits an id that holds a third of all rows;
sums of tokens by partition (a number each) become the offsets of the stream.  A task that runs again writes the same
bytes under the same name.

Results for unusual input: null and empty texts are a single end token; null ids come first; repeated rows are separate
documents and follow each other; only the last sequence of all is filled with the end token; an empty table writes no
shard; ids that don't fit ``id_type`` raise an error; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import new_path
from . import tokens
from .common import U, materialise, mix, prepare, remove

SEQ_LEN = 2048
KEY = 0x5EED
ROUNDS = 6
#: Sequences in a shard: 16 MB of two-byte ids.
SHARD_SIZE = 4096
ID_TYPE = "<u2"
#: Ids that a task holds before it sends them on, sorted by shard and compressed together.
HELD_BYTES = 32 << 20


def feistel(x: np.ndarray, size: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed permutation of range(size): balanced Feistel on the next even number of bits, cycle-walked."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = U((1 << half) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(key & (1 << 64) - 1))

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> U(half), v & mask
        for k in keys:
            a, b = b, a ^ (mix(b + k) & mask)
        return a << U(half) | b

    out = once(np.asarray(x, dtype=np.uint64))
    while (far := out >= U(size)).any():
        out[far] = once(out[far])
    return out


def _compress(batches):
    codec = pa.Codec("zstd", 1)
    for b in batches:
        raw = [t.encode() for t in b.column(4).to_pylist()]
        yield pa.record_batch([*(b.column(i) for i in range(4)), pa.array([len(t) for t in raw], pa.int32()), pa.array([codec.compress(t, asbytes=True) for t in raw], pa.binary())], names=["none", "doc", "h", "tie", "size", "z"])


def stream(docs: DataFrame, seq_len: int, tokenizer: str, end_id: int, id_type: str) -> DataFrame:
    """(part, start, ids): the token stream of each part of the ordered documents, in blocks of ``seq_len`` ids."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = ["none", "doc", "h", "tie"]
    keyed = docs.select(F.col("doc_id").isNotNull().alias("none"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("tie"), text.alias("text"))
    parts = max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the tie only parts equal rows of one id, whose order makes no difference
    small = keyed.mapInArrow(_compress, "none boolean, doc long, h long, tie long, size int, z binary")
    ordered = small.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("size", "z")
    most = np.iinfo(id_type).max

    def work(batches):
        from pyspark import TaskContext

        encode, codec, part = tokens.encoder(tokenizer), pa.Codec("zstd", 3), TaskContext.get().partitionId()
        rest, at = np.zeros(0, id_type), 0

        def blocks(ids: np.ndarray):
            nonlocal at
            starts = range(0, len(ids), seq_len)
            raw = [ids[a : a + seq_len].tobytes() for a in starts]
            out = pa.record_batch([pa.array([part] * len(raw), pa.int32()), pa.array([at + a for a in starts], pa.int64()), pa.array(raw, pa.binary())], names=["part", "start", "ids"])
            at += len(ids)
            return out

        for b in batches:
            each = [rest]
            for size, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(codec.decompress(t, size, asbytes=True).decode()), end_id], np.int64)
                if ids.max() > most:
                    raise OverflowError(f"token id {ids.max()} doesn't fit {id_type}")
                each.append(ids.astype(id_type))
            ids = np.concatenate(each)
            whole = len(ids) // seq_len * seq_len
            rest = ids[whole:]
            yield blocks(ids[:whole])
        if len(rest):
            yield blocks(rest)

    return ordered.mapInArrow(work, "part int, start long, ids binary")


def _store(uri: str):
    """File system and path of a folder in any store that Arrow reaches (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def publish(fs, temp: str, path: str, raw: bytes) -> None:
    """Make ``path`` a file of these bytes without a moment in which it is missing or partial.

    What another attempt published stays if it holds the same bytes; else a rename takes its place.
    """

    def there() -> bool:
        if not fs.get_file_info(path).is_file:
            return False
        with fs.open_input_file(path) as src:
            return src.read() == raw

    if there():
        return
    with fs.open_output_stream(temp) as out:
        out.write(raw)
    try:
        fs.move(temp, path)
    except OSError:  # a store whose renames don't replace: another attempt was first, or an older run's file is there
        if there():
            return
        if not fs.get_file_info(path).is_file:
            raise
        fs.delete_file(path)
        fs.move(temp, path)


def write(
    docs: DataFrame, uri: str, seq_len: int = SEQ_LEN, key: int = KEY, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, shard_size: int = SHARD_SIZE, id_type: str = ID_TYPE
) -> DataFrame:
    """Write the shards under ``uri``; slot, sequence, shard, byte_offset, n_tokens and ids_crc32 of every sequence."""
    spark = docs.sparkSession
    prepare(spark)
    blocks, blocks_path = materialise(stream(docs, seq_len, tokenizer, end_id, id_type), "tokens")
    width = np.dtype(id_type).itemsize
    sums = sorted((r["part"], r["n"] // width) for r in blocks.groupBy("part").agg(F.sum(F.length("ids")).alias("n")).collect())  # a number a partition
    size = sum(n for _, n in sums)
    count = -(-size // seq_len)
    begin = np.zeros(1 + max((p for p, _ in sums), default=0), np.int64)
    begin[[p for p, _ in sums]] = np.cumsum([0, *(n for _, n in sums)])[:-1]
    shared = spark.sparkContext.broadcast(begin)
    stride = width * seq_len

    def packed(held: list) -> pa.RecordBatch:
        """Pieces (slot, sequence, place, ids), as one compressed row a shard."""
        codec = pa.Codec("zstd", 3)
        by_shard: dict[int, list] = {}
        for x in held:
            by_shard.setdefault(int(x[0]) // shard_size, []).append(x)
        cols = [pa.array([[int(x[i]) for x in v] for v in by_shard.values()], pa.list_(pa.int64())) for i in range(3)]
        sizes = pa.array([[len(x[3]) for x in v] for v in by_shard.values()], pa.list_(pa.int64()))
        z = pa.array([codec.compress(np.concatenate([x[3] for x in v]).tobytes(), asbytes=True) for v in by_shard.values()], pa.binary())
        return pa.record_batch([pa.array(list(by_shard), pa.int32()), *cols, sizes, z], names=["shard", "slots", "sequences", "at", "n", "z"])

    def pieces(batches):
        """Each block falls into one or two sequences of the stream."""
        held, size_ = [], 0
        for b in batches:
            g = shared.value[b.column(0).to_numpy()] + b.column(1).to_numpy()
            seq, at = g // seq_len, g % seq_len
            slot, after = (feistel(np.minimum(x, count - 1), count, key).astype(np.int64) for x in (seq, seq + 1))
            for i, raw in enumerate(b.column(2).to_pylist()):
                ids = np.frombuffer(raw, id_type)
                head = min(len(ids), seq_len - int(at[i]))
                held.append((slot[i], seq[i], at[i], ids[:head]))
                if head < len(ids):
                    held.append((after[i], seq[i] + 1, 0, ids[head:]))
                size_ += len(raw)
            if size_ >= HELD_BYTES:
                yield packed(held)
                held, size_ = [], 0
        if held:
            yield packed(held)

    shards, attempts = max(1, -(-count // shard_size)), f".attempts-{uuid.uuid4().hex}"
    dealt = blocks.mapInArrow(pieces, "shard int, slots array<long>, sequences array<long>, at array<long>, n array<long>, z binary").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")

    def work(batches):
        """Put the pieces of a shard, which has a fixed size, in their places, and write it."""
        fs, folder = _store(uri)
        codec = pa.Codec("zstd")
        fs.create_dir(f"{folder}/{attempts}", recursive=True)
        now = ids = tokens_ = sequence = None

        def done() -> pa.RecordBatch:
            n = len(tokens_)
            publish(fs, f"{folder}/{attempts}/{now:08d}-{uuid.uuid4().hex}", f"{folder}/shard-{now:08d}.bin", ids.tobytes())
            at = np.arange(n, dtype=np.int64)
            crc = [zlib.crc32(ids[i].tobytes()) for i in range(n)]
            return pa.record_batch([pa.array(now * shard_size + at), pa.array(sequence), pa.array(np.full(n, now, np.int32)), pa.array(at * stride), pa.array(tokens_), pa.array(crc, pa.int64())], names=["slot", "sequence", "shard", "byte_offset", "n_tokens", "ids_crc32"])

        for b in batches:
            for shard, slots, sequences, places, sizes, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != now:
                    if now is not None:
                        yield done()
                    now, n = shard, min(shard_size, count - shard * shard_size)
                    ids, tokens_, sequence = np.full((n, seq_len), end_id, id_type), np.zeros(n, np.int64), np.zeros(n, np.int64)
                raw, k = np.frombuffer(codec.decompress(z, sum(sizes) * width, asbytes=True), id_type), 0
                for slot, seq, at, size_ in zip(slots, sequences, places, sizes, strict=True):
                    i = slot - shard * shard_size
                    ids[i, at : at + size_] = raw[k : k + size_]
                    tokens_[i] += size_
                    sequence[i] = seq
                    k += size_
        if now is not None:
            yield done()

    found, _ = materialise(dealt.mapInArrow(work, "slot long, sequence long, shard int, byte_offset long, n_tokens long, ids_crc32 long"), "slots")
    fs, folder = _store(uri)
    if fs.get_file_info(f"{folder}/{attempts}").type.name == "Directory":
        fs.delete_dir(f"{folder}/{attempts}")  # what lost attempts left
    remove(spark, blocks_path)
    return found


def materialise_documents(docs: DataFrame) -> DataFrame:
    """Write ``docs`` under the session's shared folder."""
    return write(docs, new_path(docs.sparkSession, "shards"))


def read_slots(uri: str, first: int, count: int, seq_len: int = SEQ_LEN, shard_size: int = SHARD_SIZE, id_type: str = ID_TYPE) -> Iterator[np.ndarray]:
    """Sequences from global slot ``first`` on, read in order: what a resumed training run does.  Ends with the last slot."""
    from pyarrow import fs as pafs

    fs, folder = _store(uri)
    stride = np.dtype(id_type).itemsize * seq_len
    while count > 0:
        path = f"{folder}/shard-{first // shard_size:08d}.bin"
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return
        with fs.open_input_file(path) as src:
            src.seek(first % shard_size * stride)
            for _ in range(min(count, shard_size - first % shard_size)):
                raw = src.read(stride)
                if not raw:
                    return
                yield np.frombuffer(raw, id_type)
                first, count = first + 1, count - 1

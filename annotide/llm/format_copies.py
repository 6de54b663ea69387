"""Duplicates hidden by formatting: partition-merged Bloom filters of canonical hashes.

The texts are read once, for their canonical hashes. The range of the hashes is cut into so many parts that a part's
filters take no more than ``most_bits`` each at ``BITS_A_ROW`` bits a row; a part's rows are written apart, without a
shuffle. Part by part, each task fills two Bloom filters, of the hashes it saw once and of those it saw again. The
filters are cut into blocks and merged block by block: a hash of two tasks' filters counts as repeated. Only rows whose
hash may be repeated are then shuffled for exact grouping; all others are singletons where they stand.

A filter is as full with 10^10 rows as with 10^6; what grows is the number of parts. The driver holds one part's filter
at a time, and what is broadcast is never larger than ``most_bits``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotide.storage import Scratch

#: Bits of a filter at most (32 MB), of a block, bits a row, and bits set for each hash.
MOST_BITS, BLOCK_BITS, BITS_A_ROW, PROBES = 1 << 28, 1 << 19, 16, 4
_DROP = re.compile(r"[\W_]+")
_DIVIDER = re.compile("[;|\\n\\r\\v\\f\\x1c-\\x1e\\x85\\u2028\\u2029]")
_FIELD = re.compile(r"[^:]*[^\W_][^:]*:.*[^\W_]", re.S)


def canonical(text: str | None) -> str | None:
    """What copies have in common: letters and digits, case ignored; of three or more ``name: value`` fields, in any order.

    None for a null or blank text, which has no copies.
    """
    if text is None or not text.strip():
        return None
    if text.count(":") >= 3:
        fields = [f for f in _DIVIDER.split(text) if f.strip()]
        if len(fields) >= 3 and all(_FIELD.match(f) for f in fields):
            return "\n".join(sorted(_DROP.sub("", f.casefold()) for f in fields))
    return _DROP.sub("", text.casefold())


def _digests(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Index of each text that counts, and the 128 bits of its canonical form as two columns."""
    index, raw = [], []
    for i, text in enumerate(texts):
        key = canonical(text)
        if key is not None:
            index.append(i)
            raw.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass")))
    return np.array(index, dtype=np.int64), np.frombuffer(b"".join(raw), dtype="<u8").reshape(-1, 2)


def _probes(digests: np.ndarray, bits: int) -> np.ndarray:
    """The bits that stand for each digest, of a filter of ``bits`` bits (a power of two)."""
    with np.errstate(over="ignore"):
        return (digests[:, :1] + digests[:, 1:] * np.arange(1, PROBES + 1, dtype=np.uint64)) & np.uint64(bits - 1)


def _test(filter_: np.ndarray, probes: np.ndarray) -> np.ndarray:
    return (filter_[probes >> np.uint64(3)] >> (probes & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)


def _set(filter_: np.ndarray, probes: np.ndarray) -> None:
    np.bitwise_or.at(filter_, (probes >> np.uint64(3)).ravel(), np.left_shift(1, (probes & np.uint64(7)).ravel().astype(np.uint8), dtype=np.uint8))


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        index, digests = _digests(batch.column(1).to_pylist())
        signed = digests.view("<i8")
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index)), pa.array(signed[:, 0]), pa.array(signed[:, 1])], names=["row", "h1", "h2"])


def _columns(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.stack([batch.column(k).to_numpy() for k in (at, at + 1)], axis=1).view("<u8")


def _fill(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            distinct, counts = np.unique(_columns(batch, 0), axis=0, return_counts=True)
            probes = _probes(distinct, bits)
            _set(again, probes[(counts > 1) | _test(once, probes)])
            _set(once, probes)
        size = min(bits, BLOCK_BITS) // 8
        blocks = np.flatnonzero(once.reshape(-1, size).any(axis=1))
        for k in blocks:
            part = [zlib.compress(f[k * size : (k + 1) * size].tobytes(), 1) for f in (once, again)]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([p], pa.binary()) for p in part)], names=["block", "once", "again"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block. Repeated is what either part repeats, or what both hold."""
    block = once = again = None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(again.tobytes(), 1)], pa.binary())], names=["block", "again"])

    for batch in batches:
        for k, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            if k == block:
                again, once = again | b | (once & a), once | a
            else:
                if block is not None:
                    yield out()
                block, once, again = k, a, b
    if block is not None:
        yield out()


def _sift(shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = min(bits, BLOCK_BITS) // 8
        again = np.zeros(bits // 8, np.uint8)
        for k, part in shared.value.items():
            again[k * size : (k + 1) * size] = np.frombuffer(zlib.decompress(part), np.uint8)
        for batch in batches:
            maybe = _test(again, _probes(_columns(batch, 1), bits)) if batch.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], names=["row", "h1", "h2", "maybe"])

    return run


def hashed_records(records: DataFrame, scratch: Scratch, key: str = "source_row", text: str = "target", most_bits: int | None = None) -> DataFrame:
    """Of each record that has a text: row, the canonical hash h1 h2, and whether the Bloom filters allow a copy.

    ``most_bits`` is a power of two, ``BLOCK_BITS`` at least, and ``MOST_BITS`` if not given.
    """
    spark = records.sparkSession
    rows = records.select(F.col(key).cast("long").alias("row"), F.col(text).alias("text")).where("row is not null")
    schema = "row long, h1 long, h2 long"
    hashed, (count, _) = scratch.write_counted(rows.mapInArrow(_hash, schema), "hashes", "h1")
    bits = max(BLOCK_BITS, min(most_bits or MOST_BITS, 1 << (max(1, BITS_A_ROW * count) - 1).bit_length()))
    parts = -(-BITS_A_ROW * count // bits) or 1
    if parts > 1:
        # h1 also gives the place in the filter; the part comes from other bits of both halves
        part = F.pmod(F.xxhash64("h1", "h2"), F.lit(parts)).cast("int")
        hashed = scratch.write_parts(hashed.withColumn("part", part), "parts", "part")
    for k in range(parts):
        own = hashed.where(F.col("part") == k).drop("part") if parts > 1 else hashed
        blocks = own.select("h1", "h2").mapInArrow(_fill(bits), "block int, once binary, again binary")
        merged = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_merge, "block int, again binary")
        shared = spark.sparkContext.broadcast({r["block"]: r["again"] for r in merged.collect()})  # bounded by most_bits
        scratch.write(own.mapInArrow(_sift(shared, bits), schema + ", maybe boolean"), f"sifted/part={k}")
        shared.destroy()
    return scratch.read("sifted", schema + ", maybe boolean, part int").drop("part")


def copy_groups(records: DataFrame, key: str = "source_row", text: str = "target", most_bits: int | None = None) -> DataFrame:
    """One row per record that has a text: row, first (the smallest row of its set of copies) and n_copies.

    ``key`` names a BIGINT. Rows with a null key or a null or blank text are left out; a key that is repeated with the
    same text counts once; other columns are ignored. Sets are exact: the filters only decide which rows are shuffled.
    """
    scratch = Scratch(records.sparkSession, "format-copies")
    hashed = hashed_records(records, scratch, key, text, most_bits)
    few = hashed.where("maybe").drop("maybe").distinct()
    sets = few.groupBy("h1", "h2").agg(F.min("row").alias("first"), F.count("*").alias("n_copies"))
    repeated = few.join(sets.where("n_copies > 1"), ["h1", "h2"]).select("row", "first", "n_copies")
    alone = few.join(sets.where("n_copies = 1"), ["h1", "h2"], "left_semi").select("row")
    single = hashed.where("not maybe").select("row").distinct().union(alone)
    return repeated.union(single.select("row", F.col("row").alias("first"), F.lit(1).cast("long").alias("n_copies")))


def copy_pairs(records: DataFrame, key: str = "source_row", text: str = "target", most_bits: int | None = None) -> DataFrame:
    """Of each set of copies its smallest row with each other one: row_1, row_2."""
    scratch = Scratch(records.sparkSession, "format-copies")
    few = scratch.write(hashed_records(records, scratch, key, text, most_bits).where("maybe").drop("maybe").distinct(), "few")
    sets = few.groupBy("h1", "h2").agg(F.min("row").alias("row_1"), F.count("*").alias("n")).where("n > 1")
    return few.join(sets, ["h1", "h2"]).where("row <> row_1").select("row_1", F.col("row").alias("row_2"))

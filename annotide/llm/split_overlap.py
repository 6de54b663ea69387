"""Same or near-same records across splits: a weighted cosine join over inverted lists.

A record's vector has the weight sqrt(tf) for each word, so that its squared norm is its number of words and the dot
product of two vectors is at least the number of words in common, counting repeats. Two records that share four fifths
of the longer one's words thus have a cosine of 0.8 or more, and the squared norm of what they share is four fifths of
either squared norm. A word that occurs k times is indexed as k unit terms (word, 1) to (word, k), rarest first.

* Residual norm: the first term that two such records share stands where at least four fifths of the squared norm are
  left on both sides, so only that prefix of a vector enters the inverted lists. No pair is lost.
* Maximum weight: a term's greatest weight in the other split bounds what it can add; terms of weight 0 there stay out
  of the lists, and a vector whose bound is below the threshold is dropped.
* Inside a list, pairs of the two sides are compared in blocks by length, by the residuals, and by a 128-bit sketch
  whose differing bits bound the words not shared. What is left gets the exact dot product.

The dot product decides first: a pair below a cosine of 0.8 is dropped; of the others the words in common are counted.
Records with the same words form one class; only classes are joined. Lists of frequent words are spread over a grid of
tasks by their true lengths, so that no task holds a whole one. The statistics of the ``TOP_WORDS`` most frequent words
are broadcast; those of all other words are joined to the classes that hold them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotide.storage import Scratch

WORD = re.compile(r"[^\W_]+")
#: Words whose statistics are broadcast. No other word stands in more than 1 / TOP_WORDS of all places, so the join on
#: the rest has no hot key.
TOP_WORDS = 50_000
#: Entries of a frequent word's list, at most, in one task: of the side held in memory, and of the streamed side.
HELD, STREAMED = 1 << 16, 1 << 18
_TILE = 1 << 21
#: Four fifths, less what rounding may take.
LEAST_COSINE = 0.8 - 1e-9


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, case ignored."""
    return WORD.findall(text.casefold()) if text else []


def need(n: int) -> int:
    """The least number of common words for a longer text of n words: 5 c >= 4 n."""
    return -(-4 * n // 5)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, texts, train = (batch.column(i).to_pylist() for i in range(3))
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for row, text, side in zip(rows, texts, train, strict=True):
            found = sorted(words(text))
            if found:
                joined = " ".join(found)
                digest = xxhash.xxh3_128_intdigest(joined.encode())
                for column, value in zip(out, (row, side, (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63), len(found), joined), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["row", "train", "h1", "h2", "n", "words"])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word: texts that hold it, and its greatest count in a text of either side."""
    for batch in batches:
        texts: Counter = Counter()
        most = ({}, {})
        for joined, train, other in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            counts = Counter(joined.split(" "))
            texts.update(counts.keys())
            for side in (0,) * train + (1,) * other:
                best = most[side]
                for word, count in counts.items():
                    if best.get(word, 0) < count:
                        best[word] = count
        names = list(texts)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([texts[w] for w in names], pa.int64()), pa.array([most[0].get(w, 0) for w in names], pa.int64()), pa.array([most[1].get(w, 0) for w in names], pa.int64())], names=["word", "texts", "most_train", "most_other"])


_POSTING = np.dtype([("id", "<i8"), ("a", "<u8"), ("b", "<u8"), ("n", "<i4"), ("at", "<i4")])


def _grid(texts: int) -> tuple[int, int]:
    return -(-texts // HELD) or 1, -(-texts // STREAMED) or 1


def _rare(known: dict[str, tuple[int, int, int]]):
    """cid and each of its words that ``known`` lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, words_ = [], []
            for cid, joined in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rare = {w for w in joined.split(" ") if w not in known}
                cids.extend([cid] * len(rare))
                words_.extend(rare)
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(words_, pa.string())], names=["cid", "word"])

    return run


def _postings(known: dict[str, tuple[int, int, int]]):
    """Emits fragments of inverted lists: key, side (train first), entries. Statistics come from ``known`` or with the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[tuple[str, int], int] = {}
        for batch in batches:
            lists: dict[tuple[int, int, int], list] = {}
            entries = np.zeros(batch.num_rows, _POSTING)
            for i, (cid, joined, train, other, rare) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)):
                own = {r["word"]: (r["texts"], r["a"], r["b"]) for r in rare or ()}
                counts = Counter(joined.split(" "))
                n = sum(counts.values())
                terms = []
                bits = 0
                for word, count in counts.items():
                    info = known.get(word) or own[word]
                    for k in range(1, count + 1):
                        h = hashes.get((word, k))
                        if h is None:
                            if len(hashes) > 500_000:
                                hashes.clear()
                            h = hashes[word, k] = xxhash.xxh3_64_intdigest(f"{word} {k}".encode())
                        bits |= 1 << (h & 127)
                        terms.append((info[0], h, k, info))
                terms.sort()
                entries[i] = (cid, bits & (1 << 64) - 1, bits >> 64, n, 0)
                least = need(n)
                for side in (0,) * train + (1,) * other:
                    if sum(k <= info[2 - side] for *_, k, info in terms) < least:  # greatest weights on the other side
                        continue
                    for at, (texts, h, k, info) in enumerate(terms[: n - least + 1]):  # residual norm
                        if k > info[2 - side]:
                            continue
                        held, streamed = _grid(texts)
                        if held == streamed == 1:
                            cells = ((0, 0),)
                        elif side:
                            place = cid % streamed
                            cells = tuple((j, place) for j in range(held))
                        else:
                            place = cid % held
                            cells = tuple((place, j) for j in range(streamed))
                        for a, b in cells:
                            key = h if (a, b) == (0, 0) else xxhash.xxh3_64_intdigest(f"{h} {a} {b}".encode())
                            lists.setdefault((key, side), []).append((i, at))
            keys, sides, blobs = [], [], []
            for (key, side), found in lists.items():
                index, at = np.array(found, dtype=np.int64).T
                part = entries[index]
                part["at"] = at
                keys.append(key - (1 << 63))
                sides.append(side)
                blobs.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sides, pa.int8()), pa.array(blobs, pa.binary())], names=["key", "side", "entries"])

    return run


def _matches(held: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of candidate pairs between a list's two sides. ``held`` is sorted by n."""
    left, right = [], []
    lengths = held["n"]
    asked = asked[np.argsort(asked["n"], kind="stable")]
    step = max(1, min(256, _TILE // max(1, len(held))))
    for start in range(0, len(asked), step):
        x = asked[start : start + step]
        low, high = np.searchsorted(lengths, need(int(x["n"][0]))), np.searchsorted(lengths, int(x["n"][-1]) * 5 // 4, "right")
        for at in range(low, high, _TILE):
            y = held[at : min(high, at + _TILE)]
            far = np.bitwise_count(x["a"][:, None] ^ y["a"]) + np.bitwise_count(x["b"][:, None] ^ y["b"])
            i, j = np.nonzero(far <= min(128, int(x["n"][-1]) * 2 // 5))
            if len(i):
                nx, ny = x["n"][i], y["n"][j]
                least = -(-4 * np.maximum(nx, ny) // 5)
                keep = (far[i, j] <= nx + ny - 2 * least) & (np.minimum(nx - x["at"][i], ny - y["at"][j]) >= least)
                left.append(x["id"][i[keep]])
                right.append(y["id"][j[keep]])
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _join_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and side: of each key the train side is held, the other one streamed."""
    key, parts, held, found = None, [], None, set()
    for batch in batches:
        keys, sides, blobs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (sides[1:] != sides[:-1])]) if len(keys) else []
        for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
            if keys[start] != key:
                key, parts, held = keys[start], [], None
            entries = np.frombuffer(b"".join(blobs.slice(start, end - start).to_pylist()), _POSTING)
            if sides[start] == 0:
                parts.append(entries)
            elif parts or held is not None:
                if held is None:
                    held = np.concatenate(parts)
                    held = held[np.argsort(held["n"], kind="stable")]
                    parts = []
                left, right = _matches(held, entries)
                found.update(zip(left.tolist(), right.tolist(), strict=True))
            if len(found) > 200_000:
                yield _pairs(found)
                found = set()
    if found:
        yield _pairs(found)


def _pairs(found: set[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(list(found), dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["c1", "c2"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact dot product of each candidate pair, and the words in common."""
    for batch in batches:
        c1, c2, w1, w2 = (batch.column(i).to_pylist() for i in range(4))
        out: tuple[list, ...] = ([], [], [], [])
        for a, b, x, y in zip(c1, c2, w1, w2, strict=True):
            x, y = Counter(x.split(" ")), Counter(y.split(" "))
            nx, ny = sum(x.values()), sum(y.values())
            shared = x.keys() & y.keys()
            cosine = sum(math.sqrt(x[w] * y[w]) for w in shared) / math.sqrt(nx * ny)
            if cosine < LEAST_COSINE:
                continue
            common = sum(min(x[w], y[w]) for w in shared)
            if 5 * common >= 4 * max(nx, ny):
                for column, value in zip(out, (a, b, common, cosine), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["c1", "c2", "common", "cosine"])


def matched_classes(
    records: DataFrame, splits: DataFrame, key: str = "source_row", text: str = "target", partition: str = "partition", train: str = "train"
) -> tuple[DataFrame, DataFrame]:
    """(c1, c2, common, cosine) of matching classes, c1 with records of other splits and c2 with train records; and
    (row, train, cid) of every record. A class is all records with the same words, each as often."""
    spark = records.sparkSession
    scratch = Scratch(spark, "split-overlap")
    sides = splits.select(F.col(key).cast("long").alias("row"), (F.col(partition) == train).alias("train")).dropna().distinct()
    texts = records.select(F.col(key).cast("long").alias("row"), F.col(text).alias("text")).dropna()
    rows = scratch.write(
        texts.join(sides, "row").select("row", "text", "train").mapInArrow(_vectors, "row long, train boolean, h1 long, h2 long, n int, words string"),
        "rows",
    )
    classes = scratch.write(
        rows.groupBy("h1", "h2").agg(F.min("row").alias("cid"), F.max("train").alias("train"), F.max(~F.col("train")).alias("other"), F.first("words").alias("words")),
        "classes",
    )
    tally = classes.select("words", "train", "other").mapInArrow(_tally, "word string, texts long, most_train long, most_other long")
    tally = scratch.write(tally.groupBy("word").agg(F.sum("texts").alias("texts"), F.max("most_train").alias("a"), F.max("most_other").alias("b")), "tally")
    top = tally.orderBy(F.desc("texts"), "word").limit(TOP_WORDS).collect()  # bounded by TOP_WORDS
    known = {r["word"]: (r["texts"], r["a"], r["b"]) for r in top}
    held = classes.select("cid", "words", "train", "other")
    if len(top) < TOP_WORDS:  # no word is left out
        held = held.withColumn("rare", F.lit(None).cast("array<struct<word:string,texts:long,a:long,b:long>>"))
    else:
        rare = classes.select("cid", "words").mapInArrow(_rare(known), "cid long, word string").join(tally, "word")
        rare = rare.groupBy("cid").agg(F.collect_list(F.struct("word", "texts", "a", "b")).alias("rare"))  # within one text
        held = held.join(rare, "cid", "left")
    lists = held.mapInArrow(_postings(known), "key long, side byte, entries binary")
    candidates = lists.repartition("key").sortWithinPartitions("key", "side").mapInArrow(_join_lists, "c1 long, c2 long").distinct()
    one, two = (classes.select(F.col("cid").alias(f"c{i}"), F.col("words").alias(f"w{i}")) for i in (1, 2))
    pairs = candidates.join(one, "c1").join(two, "c2").select("c1", "c2", "w1", "w2").mapInArrow(_exact, "c1 long, c2 long, common long, cosine double")
    return pairs, rows.join(classes.select("h1", "h2", "cid"), ["h1", "h2"]).select("row", "train", "cid")


def cross_split_pairs(
    records: DataFrame, splits: DataFrame, key: str = "source_row", text: str = "target", partition: str = "partition", train: str = "train"
) -> DataFrame:
    """All pairs of a train record and a record of another split that share four fifths of their words.

    ``records`` has ``key`` (BIGINT) and ``text``; ``splits`` has ``key`` and ``partition``. Returns row_other, row_train,
    common, cosine. Rows with a null key, null partition or without words are in no pair; repeated rows count once;
    other columns are ignored, so their names may clash; empty tables give no rows.
    """
    pairs, members = matched_classes(records, splits, key, text, partition, train)
    other = members.where(~F.col("train")).select(F.col("cid").alias("c1"), F.col("row").alias("row_other"))
    within = members.where("train").select(F.col("cid").alias("c2"), F.col("row").alias("row_train"))
    return pairs.join(other, "c1").join(within, "c2").where("row_other <> row_train").select("row_other", "row_train", "common", "cosine").distinct()


def overlapping_records(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """row of every record of another split that some train record matches, over (pairs, members) of ``matched_classes``.

    Classes are joined, never their records with each other: it is enough that a matching class has a train record
    other than the record itself.
    """
    ends = members.where("train").groupBy(F.col("cid").alias("c2")).agg(F.min("row").alias("low"), F.max("row").alias("high"))
    reach = pairs.select("c1", "c2").join(ends, "c2").groupBy(F.col("c1").alias("cid")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    found = members.where(~F.col("train")).join(reach, "cid").where("low <> row or high <> row")
    return found.select("row").distinct()


def overlap_report(
    records: DataFrame, splits: DataFrame, key: str = "source_row", source: str = "source", text: str = "target",
    partition: str = "partition", train: str = "train",
) -> DataFrame:
    """Per partition and source (trimmed, case ignored): windows, those that overlap train, and their share.

    Of records that repeat a key with several sources the smallest counts.
    """
    hit = overlapping_records(*matched_classes(records, splits, key, text, partition, train)).withColumn("hit", F.lit(1))
    names = records.select(F.col(key).cast("long").alias("row"), F.lower(F.trim(source)).alias("source")).groupBy("row").agg(F.min("source").alias("source"))
    held = splits.select(F.col(key).cast("long").alias("row"), F.col(partition).alias("partition")).where(F.col(partition) != train).distinct()
    return (
        held.join(names, "row", "left").join(hit, "row", "left").groupBy("partition", "source")
        .agg(F.count("*").alias("n_windows"), F.count("hit").alias("n_overlapping"))
        .withColumn("share", F.round(F.col("n_overlapping") / F.col("n_windows"), 6))
    )

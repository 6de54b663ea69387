"""Long exact spans shared between records: automata of the passages that recur.

1. Winnowing: of all runs of ``WIDTH`` characters within a run of ``span`` characters the one with the least hash is
   taken, so two records that share a span share a passage that both of them chose.
2. Passages that were chosen in two or more records are the recurring ones; their text comes from the first record.
3. They are compiled into sharded Aho-Corasick automata. Passages are sharded by the first record that holds them,
   so that a record meets few automata; every record with a recurring passage is streamed through its shards, which
   confirms the passages letter by letter and locates every occurrence. A shard that many records meet is repeated
   for parts of its records, so no task streams a large share of them.
4. Records that hold the same passage are compared around it; a run of ``span`` characters or more is a shared span.
   For the share of each record nothing is paired: the runs around located passages are counted by their hashes.

Passages are told apart by 128 bits, so that no passage hides behind another one's hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotide.functions.arrays import code_points, mix, rolling_hashes, sliding_min, slices
from annotide.storage import Scratch

WIDTH = 64
#: Passages in one automaton, and records streamed by one task, about.
PASSAGES, RECORDS = 6_000, 20_000
_SLICE = 1_000_000
_NEVER = np.uint64((1 << 64) - 1)


def _fingerprints(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = sum(np.array([len(t or "") for t in whole.column(i).to_pylist()], dtype=np.int64) for i in range(1, whole.num_columns))
            for batch in slices(whole, sizes, _SLICE):
                rows, fields, texts = [], [], []
                names = batch.column(0).to_pylist()
                for f in range(batch.num_columns - 1):
                    for row, text in zip(names, batch.column(f + 1).to_pylist(), strict=True):
                        if text is not None and len(text) >= span:
                            rows.append(row)
                            fields.append(f)
                            texts.append(text)
                if not texts:
                    continue
                points, lengths = code_points(texts)
                ends = np.cumsum(lengths)
                hashes = rolling_hashes(points, WIDTH)
                hashes[hashes == _NEVER] -= np.uint64(1)
                for end in ends[:-1]:  # runs that reach into the next text
                    hashes[end - WIDTH + 1 : end] = _NEVER
                least = sliding_min(hashes, span - WIDTH + 1)
                chosen = np.zeros(len(points), bool)
                for end, length in zip(ends, lengths, strict=True):
                    chosen[end - length : end - span + 1] = True
                owner = np.repeat(np.arange(len(texts)), lengths)
                at = np.flatnonzero(chosen)
                least, own = least[at], owner[at]
                first = np.r_[True, (least[1:] != least[:-1]) | (own[1:] != own[:-1])]
                least, own, at = least[first], own[first], at[first]
                # the place of the least hash within the run that starts at ``at``
                place = np.empty(len(at), dtype=np.int64)
                for i in range(0, len(at), 8192):
                    window = np.minimum(at[i : i + 8192, None] + np.arange(span - WIDTH + 1), len(hashes) - 1)
                    place[i : i + 8192] = at[i : i + 8192] + np.argmax(hashes[window] == least[i : i + 8192, None], axis=1)
                place -= (ends - lengths)[own]
                passages = (texts[o][p : p + WIDTH] for o, p in zip(own.tolist(), place.tolist(), strict=True))
                digests = np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in passages), np.uint64, len(own))
                columns = (least.view(np.int64), digests.view(np.int64), np.array(rows, dtype=np.int64)[own], np.array(fields, dtype=np.int8)[own], place.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "h2", "row", "field", "at"])

    return run


def _route(span: int):
    """Splits a record with its recurring passages into what each shard gets: passages it is the first to hold, its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            rows, shards, firsts = (batch.column(i).to_pylist() for i in range(3))
            texts = [batch.column(i).to_pylist() for i in range(3, batch.num_columns)]
            for i, row in enumerate(rows):
                own = [t[i] for t in texts]
                for shard, copies, field, at in firsts[i] or ():
                    if len(own[field] or "") < at + WIDTH:  # another row of the same key
                        continue
                    for copy in range(copies):
                        for column, value in zip(out, (shard, copy, 0, row, 0, own[field][at : at + WIDTH]), strict=True):
                            column.append(value)
                for shard, copies in shards[i]:
                    for field, text in enumerate(own):
                        if text is not None and len(text) >= span:
                            for column, value in zip(out, (shard, row % copies, 1, row, field, text), strict=True):
                                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int8(), pa.int64(), pa.int8(), pa.string()), strict=True)], names=["shard", "copy", "kind", "row", "field", "text"])

    return run


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, str, list[tuple[int, int]]]]:
    """row, field, text and the located passages (number, place) of each text that a shard's automaton streams.

    Rows come sorted by shard, copy and kind: passages first, which make the automaton, then the texts.
    """
    current, automaton, ready = None, None, False
    for batch in batches:
        for shard, copy, kind, row, field, text in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if (shard, copy) != current:
                current, automaton, ready = (shard, copy), ahocorasick.Automaton(), False
            if kind == 0:
                automaton.add_word(text, xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass")))
                continue
            if not ready:
                ready = len(automaton) > 0
                if not ready:
                    continue
                automaton.make_automaton()
            found = [(passage, end + 1 - WIDTH) for end, passage in automaton.iter(text)]
            if found:
                yield row, field, text, found


def _places(span: int):
    """Each located passage with the text around it that a shared span may take up."""
    around = span - WIDTH
    names = ["p1", "p2", "row", "field", "at", "before", "after"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.int32(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = tuple([] for _ in names)
        for row, field, text, found in _located(batches):
            for passage, at in found:
                p1, p2 = (passage >> 64) - (1 << 63), (passage & (1 << 64) - 1) - (1 << 63)
                values = (p1, p2, row, field, at, text[max(0, at - around) : at], text[at : at + WIDTH + around])
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            if len(out[0]) > 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
                out = tuple([] for _ in names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return run


def _windows(span: int):
    """The 128-bit hash of each run of ``span`` characters that holds a located passage: w1, w2, row, field, start."""

    def hashed(held: list[tuple[int, int, str, list[tuple[int, int]]]]) -> pa.RecordBatch:
        points, lengths = code_points([x[2] for x in held])
        offsets = np.cumsum(lengths) - lengths
        marked = np.zeros(len(points), bool)
        for (_, _, text, found), offset in zip(held, offsets.tolist(), strict=True):
            for _, at in found:
                marked[offset + max(0, at + WIDTH - span) : offset + min(at, len(text) - span) + 1] = True
        owner = np.repeat(np.arange(len(held)), lengths)
        starts = np.flatnonzero(marked)
        with np.errstate(over="ignore"):
            other = mix(points.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        w1, w2 = (rolling_hashes(p, span)[starts].view(np.int64) for p in (points, other))
        owner = owner[starts]
        rows, fields = np.array([x[0] for x in held], dtype=np.int64), np.array([x[1] for x in held], dtype=np.int8)
        columns = (w1, w2, rows[owner], fields[owner], (starts - offsets[owner]).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["w1", "w2", "row", "field", "start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for x in _located(batches):
            held.append(x)
            size += len(x[2])
            if size > _SLICE // 4:
                yield hashed(held)
                held, size = [], 0
        if held:
            yield hashed(held)

    return run


def _common(a: str, b: str) -> int:
    """Length of the common start."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _verify(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            columns = [batch.column(i).to_pylist() for i in range(10)]
            for r1, f1, a1, b1, e1, r2, f2, a2, b2, e2 in zip(*columns, strict=True):
                before, after = _common(b1[::-1], b2[::-1]), _common(e1, e2)
                if after >= WIDTH and before + after >= span:  # the passage itself is compared too, its hash isn't trusted
                    for column, value in zip(out, (r1, f1, a1 - before, r2, f2, a2 - before, before + after), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int8(), pa.int32(), pa.int64(), pa.int8(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["row_1", "field_1", "start_1", "row_2", "field_2", "start_2", "length"])

    return run


def _streamed(records: DataFrame, key: str, fields: tuple[str, ...], span: int, scratch: Scratch) -> DataFrame:
    """shard, copy, kind, row, field, text: the passages of each shard's automaton, and the texts that it streams."""
    if span < WIDTH:
        raise ValueError(f"span must be at least {WIDTH}")
    names = [f"t{i}" for i in range(len(fields))]
    texts = records.select(F.col(key).cast("long").alias("row"), *(F.col(f).alias(n) for f, n in zip(fields, names, strict=True))).where("row is not null")
    prints = scratch.write(texts.mapInArrow(_fingerprints(span), "h long, h2 long, row long, field byte, at int"), "prints")
    first = F.min(F.struct("row", "field", "at")).alias("first")
    recurring = prints.groupBy("h", "h2").agg(first, F.max("row").alias("last"), F.count("*").alias("n")).where("first.row <> last")
    recurring = scratch.write(recurring.select("h", "h2", F.col("first.row").alias("lead"), F.col("first.field").alias("field"), F.col("first.at").alias("at"), "n"), "recurring")
    shards = max(1, -(-recurring.count() // PASSAGES))
    recurring = recurring.withColumn("shard", F.pmod(F.xxhash64("lead"), F.lit(shards)))
    loads = recurring.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / RECORDS)).cast("int").alias("copies"))
    met = prints.select("h", "h2", "row").join(recurring.select("h", "h2", "shard"), ["h", "h2"]).select("row", "shard").distinct().join(loads, "shard")
    met = met.groupBy("row").agg(F.collect_list(F.struct("shard", "copies")).alias("shards"))  # no more than the passages of one record
    firsts = recurring.join(loads, "shard").groupBy(F.col("lead").alias("row")).agg(F.collect_list(F.struct("shard", "copies", "field", "at")).alias("firsts"))
    routed = texts.join(met.join(firsts, "row", "left"), "row").select(
        "row",
        F.transform("shards", lambda s: F.array(s["shard"], s["copies"])).alias("shards"),
        F.transform("firsts", lambda s: F.array(s["shard"], s["copies"].cast("long"), s["field"].cast("long"), s["at"].cast("long"))).alias("firsts"),
        *names,
    )
    routed = routed.mapInArrow(_route(span), "shard long, copy int, kind byte, row long, field byte, text string")
    return routed.repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")


def shared_spans(records: DataFrame, key: str = "source_row", fields: tuple[str, ...] = ("preceding", "target", "following"), span: int = 160) -> DataFrame:
    """Runs of ``span`` or more characters (code points, unchanged) that two different records hold within a field.

    Returns row_1 < row_2, field_1, start_1, field_2, start_2, length. A longer run may come as several overlapping
    ones, each at least ``span`` long, which together cover it. ``key`` names a BIGINT; rows with a null key are left
    out, null and short fields hold no span, a record repeated under the same key shares nothing with itself, and other
    columns are ignored. Empty tables give no rows.
    """
    scratch = Scratch(records.sparkSession, "shared-spans")
    found = _streamed(records, key, fields, span, scratch).mapInArrow(
        _places(span), "p1 long, p2 long, row long, field byte, at int, before string, after string"
    )
    found = scratch.write(found, "found")
    one, two = (found.select("p1", "p2", *(F.col(c).alias(f"{c}_{i}") for c in ("row", "field", "at", "before", "after"))) for i in (1, 2))
    pairs = one.join(two, ["p1", "p2"]).where("row_1 < row_2").drop("p1", "p2")
    return pairs.mapInArrow(_verify(span), "row_1 long, field_1 byte, start_1 int, row_2 long, field_2 byte, start_2 int, length int")


def shared_share(records: DataFrame, key: str = "source_row", fields: tuple[str, ...] = ("preceding", "target", "following"), span: int = 160) -> DataFrame:
    """Of each record: characters, characters that lie in a shared span, and their share (null for a record without text).

    No pairs are made: a run of ``span`` characters around a located passage is shared if two records hold it, which its
    least and greatest row tell. The rows are those of ``shared_spans``; of a repeated key the longest counts.
    """
    scratch = Scratch(records.sparkSession, "shared-share")
    runs = _streamed(records, key, fields, span, scratch).mapInArrow(_windows(span), "w1 long, w2 long, row long, field byte, start int")
    runs = scratch.write(runs, "runs")
    held = runs.groupBy("w1", "w2").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low <> high").select("w1", "w2")
    shared = runs.join(held, ["w1", "w2"]).select("row", "field", "start").distinct()
    starts = shared.groupBy("row", "field").agg(F.sort_array(F.collect_list("start")).alias("starts"))  # within one field
    length = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda s, x: F.struct((s["n"] + x + span - F.greatest(x, s["upto"])).alias("n"), (x + span).alias("upto")),
    )["n"]
    covered = starts.select("row", length.alias("n")).groupBy("row").agg(F.sum("n").alias("n_shared"))
    size = sum((F.coalesce(F.length(f), F.lit(0)) for f in fields), F.lit(0)).cast("long")
    sizes = records.select(F.col(key).cast("long").alias("row"), size.alias("n_chars")).where("row is not null").groupBy("row").agg(F.max("n_chars").alias("n_chars"))
    joined = sizes.join(covered, "row", "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))
    return joined.withColumn("share", F.when(F.col("n_chars") > 0, F.round(F.col("n_shared") / F.col("n_chars"), 6)))

"""Encoding of a corpus with a public tokenizer: content-defined chunk reuse.

A rolling hash cuts each text where its value ends in zeros, so equal passages of different texts yield equal chunks.
Every distinct chunk is encoded once; then each text's chunks are put together. A cut may part what the tokenizer
would have kept together, so each join is repaired: the tokens around it are decoded and re-encoded together, from the
last to the next place where the tokenizer splits whatever stands around (an ASCII letter, then a space and an ASCII
letter). From there on both encodings agree exactly; if a chunk has no such place, the repair goes on into the next.

The tokenizer is one of the byte-level BPE rank files of public_tokenizers; its folder is a parameter.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotide.functions.arrays import code_points, rolling_hashes, slices

TOKENIZERS = "/opt/tokenizers"
#: A cut follows a place whose rolling hash of WINDOW characters ends in MASK zeros; chunks are LEAST to MOST characters.
WINDOW, MASK, LEAST, MOST = 24, np.uint64(1023), 512, 8192
_SLICE = 1_000_000
# Fixed value: the published split pattern of the byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[tuple[str, str], Codec] = {}


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary; made once in each process."""

    def __init__(self, name: str, folder: str):
        import tiktoken

        lines = Path(folder, f"{name}.tiktoken").read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}
        self._encoding = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * size
        self.opens, self.closes = np.zeros(size, bool), np.zeros(size, bool)
        for token, rank in ranks.items():
            self.bytes[rank] = token
            self.opens[rank] = len(token) > 1 and token[:1] == b" " and token[1:2].isalpha()
            self.closes[rank] = token[-1:].isalpha()

    def encode(self, text: str) -> list[int]:
        return self._encoding.encode_ordinary(text)

    def encode_bytes(self, raw: bytes) -> list[int]:
        return self._encoding.encode_ordinary(raw.decode("utf-8", "surrogatepass"))

    def splits(self, ids: np.ndarray) -> np.ndarray:
        """Places before which the tokenizer splits in any context."""
        return np.flatnonzero(self.opens[ids[1:]] & self.closes[ids[:-1]]) + 1

    def join(self, parts: list[np.ndarray]) -> np.ndarray:
        """The encoding of the whole text from those of its chunks."""
        if len(parts) == 1:
            return parts[0]
        done: list[np.ndarray] = []
        pending: list[np.ndarray] = []  # tokens around joins, which no certain split has ended yet
        for i, ids in enumerate(parts):
            places = self.splits(ids) if len(ids) > 1 else ()
            last = i == len(parts) - 1
            if i == 0:
                cut = places[-1] if len(places) else 0
                done.append(ids[:cut])
                pending.append(ids[cut:])
            elif not len(places) and not last:
                pending.append(ids)
            else:
                head = places[0] if len(places) else len(ids)
                tail = len(ids) if last else max(head, places[-1])
                pending.append(ids[:head])
                raw = b"".join(self.bytes[t] for part in pending for t in part.tolist())
                done.append(np.array(self.encode_bytes(raw), dtype=np.int64))
                done.append(ids[head:tail])
                pending = [ids[tail:]]
        return np.concatenate(done)


def codec(name: str, folder: str = TOKENIZERS) -> Codec:
    if (name, folder) not in _LOADED:
        _LOADED[name, folder] = Codec(name, folder)
    return _LOADED[name, folder]


def _cuts(hashes: np.ndarray, length: int) -> list[int]:
    """Ends of a text's chunks, from the rolling hashes of its runs."""
    if length <= LEAST:
        return [length]
    hits = np.flatnonzero((hashes & MASK) == 0) + WINDOW
    ends, start, i = [], 0, 0
    while length - start > LEAST:
        i = np.searchsorted(hits, start + LEAST)
        end = int(hits[i]) if i < len(hits) else length
        end = min(end, start + MOST, length)
        ends.append(end)
        start = end
    if not ends or ends[-1] < length:
        ends.append(length)
    return ends


def _chunks(with_text: bool):
    """Of the chunks of (doc, key, text): their hashes with the text, each chunk once, or with the place it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.array([len(t) for t in whole.column(2).to_pylist()], dtype=np.int64)
            for batch in slices(whole, sizes, _SLICE):
                texts = batch.column(2).to_pylist()
                long = [t for t in texts if len(t) > LEAST]
                points, lengths = code_points(long)
                hashes = rolling_hashes(points, WINDOW)
                starts = iter((np.cumsum(lengths) - lengths).tolist())
                out: tuple[list, ...] = ([], [], [], [])
                seen = set()
                for row, text in enumerate(texts):
                    start = 0
                    at = next(starts) if len(text) > LEAST else 0
                    for seq, end in enumerate(_cuts(hashes[at : at + len(text) - WINDOW + 1], len(text))):
                        part = text[start:end]
                        start = end
                        digest = xxhash.xxh3_128_digest(part.encode("utf-8", "surrogatepass"))
                        if with_text:
                            if digest in seen:
                                continue
                            seen.add(digest)
                        out[0].append(row)
                        out[1].append(seq)
                        out[2].append(digest)
                        if with_text:
                            out[3].append(part)
                halves = np.frombuffer(b"".join(out[2]), dtype="<i8").reshape(-1, 2)
                keys = [pa.array(halves[:, 0]), pa.array(halves[:, 1])]
                if with_text:
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(out[3], pa.string())], names=["h1", "h2", "chunk"])
                else:
                    index = pa.array(out[0], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(out[1], pa.int32()), *keys], names=["doc", "key", "seq", "h1", "h2"])

    return run


def _pack(ids: list[int] | np.ndarray, wide: bool) -> bytes:
    return np.asarray(ids, dtype="<u4" if wide else "<u2").tobytes()


def _encode(name: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(name, folder)
        wide = len(tokens.bytes) > 1 << 16
        for batch in batches:
            packed = [_pack(tokens.encode(t), wide) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["h1", "h2", "ids"])

    return run


def _assemble(name: str, folder: str):
    """Rows come sorted by doc and seq."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(name, folder)
        kind = "<u4" if len(tokens.bytes) > 1 << 16 else "<u2"
        doc, key, parts = None, None, []

        def flush(keys: list, kind: pa.DataType, lists: list[np.ndarray]) -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            values = np.concatenate(lists) if lists else np.empty(0)
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))], names=["key", "ids"])

        keys, lists, held, form = [], [], 0, None
        for batch in batches:
            form = batch.column(1).type
            for d, k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if d != doc:
                    if doc is not None:
                        keys.append(key)
                        lists.append(tokens.join(parts))
                        held += len(lists[-1])
                    doc, key, parts = d, k, []
                parts.append(np.frombuffer(packed, kind))
                if held > 2_000_000:
                    yield flush(keys, form, lists)
                    keys, lists, held = [], [], 0
        if doc is not None:
            keys.append(key)
            lists.append(tokens.join(parts))
        if keys:
            yield flush(keys, form, lists)

    return run


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and ids of every row of ``documents``; a null or an empty text gives an empty list.

    Rows are told apart by their place in the input, so a key may be null or repeated; other columns are ignored. A
    chunk that many documents share is encoded once and joined to its places; the join splits a hot chunk's rows.
    """
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    empty = rows.where("text is null or length(text) = 0").select(F.col("key").alias(key), F.array().cast("array<int>").alias("ids"))
    texts = rows.select(F.monotonically_increasing_id().alias("doc"), "key", "text").where(F.length("text") > 0)
    distinct = texts.mapInArrow(_chunks(True), "h1 long, h2 long, chunk string").groupBy("h1", "h2").agg(F.first("chunk").alias("chunk"))
    known = distinct.mapInArrow(_encode(tokenizer, folder), "h1 long, h2 long, ids binary")
    places = texts.mapInArrow(_chunks(False), f"doc long, key {kind}, seq int, h1 long, h2 long")
    parts = places.join(known, ["h1", "h2"]).select("doc", "key", "seq", "ids")
    whole = parts.repartition("doc").sortWithinPartitions("doc", "seq").mapInArrow(_assemble(tokenizer, folder), f"key {kind}, ids array<int>")
    return whole.select(F.col("key").alias(key), "ids").union(empty)


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and n_tokens of every row; the text stays where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(tokenizer, folder)
        for batch in batches:
            counts = [len(tokens.encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=[key, "n_tokens"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long")

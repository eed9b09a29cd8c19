"""Corpus encoding with a public tokenizer by reuse of content-defined chunks (problem 8).

A rolling hash cuts every text into chunks whose ends depend on the bytes before them alone, and on bytes of the same
text only, so that what documents share falls into equal chunks whatever stands beside them in a batch.  A chunk's ids
are certain only between its first and its last *seam*, a place at which the tokenizer's own splitter always cuts,
whatever stands around it: this is the chunk's core.  The stretch from the last seam of one chunk to the first seam of
the next is the join, encoded anew and growing over chunks that have no seam until both sides agree.

A first scan sends nothing but digests of cores: those that stand in two places set a bit in a filter of fixed size.
A second scan encodes what the filter does not know in place, joins included, and leaves a hole for every core it
knows; the text of such a core is sent once a task, encoded once in all, and put into its holes.  Where the filter
errs, a core that stands in one place only goes that way too.  Texts without a hole, most of them, are never shuffled.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencia.llm.bits import knows, words_of
from evidencia.llm.gear import WINDOW, cut_mask, text_buffers
from evidencia.runtime import spread, stored

TOKENIZER_DIR = os.environ.get("EVIDENCIA_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the splitting pattern that belongs to the public vocabulary byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A chunk has 2**CHUNK_BITS bytes on average; the cores of shorter ones than LEAST bytes are encoded in place.
CHUNK_BITS, LEAST = 9, 64


@functools.lru_cache(maxsize=2)
def encoder(folder: str, name: str):
    """The public tokenizer, loaded once in a Python worker."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _visible() -> np.ndarray:
    ok = np.zeros(256, bool)
    ok[33:127] = True
    return ok


#: A seam is a space or line feed right after one of these bytes (printable ASCII signs): every alternative of the
#: splitter that reaches such a sign stops before white space, so there is a cut in any context.
VISIBLE = _visible()


def unit_offsets(raw: np.ndarray, offsets: np.ndarray, bits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the texts of a batch fall into cores, each followed by a join, and the text each core belongs to.

    raw: bytes of all texts; offsets: where each begins, and the end.  Returns for each core its begin, its end, which
    is where its join begins, and its text's number; the join ends where the next core of the text begins.  Begin and
    end of a text are cuts as certain as a seam, so the first core begins there, the last one ends there, and every
    text, an empty one too, has one core at least.
    """
    begin, end = int(offsets[0]), int(offsets[-1])
    body = raw[begin:end]
    edge = offsets.astype(np.int64) - begin
    cut = np.flatnonzero(cut_mask(body, CHUNK_BITS if bits is None else bits)) + 1
    cut = cut[cut - edge[np.searchsorted(edge, cut - 1, "right") - 1] >= WINDOW]  # the text before has no say
    ends = np.unique(np.concatenate((cut, edge[1:])))
    seams = np.flatnonzero(VISIBLE[body[:-1]] & ((body[1:] == 32) | (body[1:] == 10))) + 1
    seams = seams[~np.isin(seams, ends)]  # a seam needs both of its bytes in one chunk, hence in one text
    starts = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
    first, last = np.searchsorted(seams, starts, "left"), np.searchsorted(seams, ends, "left") - 1
    has = first <= last
    a, b = seams[first[has]], seams[last[has]]
    owner = np.searchsorted(edge, a, "right") - 1
    bare = np.setdiff1d(np.arange(len(edge) - 1), owner)  # texts without a seam are one core
    a, b, owner = np.concatenate((a, edge[bare])), np.concatenate((b, edge[bare + 1])), np.concatenate((owner, bare))
    order = np.lexsort((a, owner))
    a, b, owner = a[order], b[order], owner[order]
    new = np.flatnonzero(np.diff(owner, prepend=-1))
    a[new], b[np.append(new[1:], len(owner)) - 1] = edge[:-1], edge[1:]
    return a + begin, b + begin, owner


def split_units(texts: list[str], bits: int | None = None) -> list[list[bytes]]:
    """The cores and joins of some texts in turn, for tests: their concatenation is the text."""
    raw, offsets = text_buffers(pa.array(texts, pa.string()))
    a, b, owner = unit_offsets(raw, offsets, bits)
    out: list[list[bytes]] = [[] for _ in texts]
    for k, n in enumerate(owner):
        out[n] += [raw[a[k] : b[k]].tobytes(), raw[b[k] : a[k + 1]].tobytes() if k + 1 < len(owner) and owner[k + 1] == n else b""]
    return out


def _type(enc) -> str:
    """Ids are packed in two bytes where the vocabulary allows it."""
    return "<u2" if enc.max_token_value < 1 << 16 else "<u4"


def _ids(enc, data: bytes) -> bytes:
    return np.frombuffer(enc._core_bpe.encode_to_tiktoken_buffer(data.decode(), set()), np.uint32).astype(_type(enc)).tobytes() if data else b""


def _cores(column) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
    """Of an Arrow column: its bytes, where its texts begin; where cores begin and end, whose they are, long ones' digests."""
    raw, offsets = text_buffers(column)
    a, b, owner = unit_offsets(raw, offsets)
    data = raw.tobytes()
    digests = [xxhash.xxh3_128_digest(data[x:y]) if y - x >= LEAST else None for x, y in zip(a.tolist(), b.tolist())]
    return data, offsets, a, b, owner, digests


def _number(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            digests = [_number(d) for d in _cores(batch.column(0))[-1] if d]
            h, n = np.unique(np.array(digests, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n, pa.int64())], ["h", "n"])


def shared_cores(texts: DataFrame) -> np.ndarray:
    """The filter of the cores that stand in two places or more."""
    met = texts.mapInArrow(_seen, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    return words_of(met, "h")


PIECES = "row bigint, key {kind}, seq int, whole boolean, packed binary, n bigint, digest binary, unit binary"


def _pieces(folder: str, name: str, known, sizes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, words, sent = encoder(folder, name), known.value, set()
        row, width = TaskContext.get().partitionId() << 40, np.dtype(_type(enc)).itemsize
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets, a, b, owner, digests = _cores(batch.column(1))
            hole = np.zeros(len(a), bool)
            long = [k for k, d in enumerate(digests) if d]
            hole[long] = knows(words, np.array([_number(digests[k]) for k in long], np.int64))
            first = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            texts, seqs, whole, packed, names, units = [], [], [], [], [], []

            def put(text: int, seq: int, all_: bool, ids: bytes | None, digest: bytes | None = None, unit: bytes | None = None) -> None:
                for column, value in zip((texts, seqs, whole, packed, names, units), (text, seq, all_, ids, digest, unit)):
                    column.append(value)

            for t in range(batch.num_rows):
                at, end = int(offsets[t]), int(offsets[t + 1])
                holes = np.flatnonzero(hole[first[t] : first[t + 1]]) + first[t]
                if not len(holes):
                    put(t, 0, True, _ids(enc, data[at:end]))
                    continue
                for k, h in enumerate(holes.tolist()):
                    x, y, d = int(a[h]), int(b[h]), digests[h]
                    put(t, 2 * k, False, _ids(enc, data[at:x]))  # between cores that the filter knows: seams on both sides
                    put(t, 2 * k + 1, False, None, d, None if d in sent else data[x:y])
                    sent.add(d)
                    at = y
                put(t, 2 * len(holes), False, _ids(enc, data[at:end]))
            n = [None if x is None else len(x) // width for x in packed]
            keys = batch.column(0).take(pa.array([t if seq == 0 else None for t, seq in zip(texts, seqs)], pa.int64()))
            arrays = [pa.array(row + np.array(texts, np.int64)), keys, pa.array(seqs, pa.int32()), pa.array(whole), pa.array([None] * len(packed) if sizes else packed, pa.binary()), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(units, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "key", "seq", "whole", "packed", "n", "digest", "unit"])
            row += batch.num_rows

    return run


def _pack(folder: str, name: str, sizes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        width = np.dtype(_type(enc)).itemsize
        for batch in batches:
            ids = [_ids(enc, u) for u in batch.column(1).to_pylist()]
            n = pa.array([len(x) // width for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None] * len(ids) if sizes else ids, pa.binary()), n], ["digest", "packed", "n"])

    return run


def _join_up(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(_type(encoder(folder, name)))
        for batch in batches:
            parts = batch.column(1)
            sizes = np.diff(np.frombuffer(parts.buffers()[1], np.int32, len(parts) + 1, parts.offset * 4))
            flat = parts.flatten()
            _, at, data = flat.buffers()
            at = np.frombuffer(at, np.int32, len(flat) + 1, flat.offset * 4)
            ids = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if data is not None else np.zeros(0, kind)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            lists = pa.ListArray.from_arrays(pa.array(((at[ends] - at[0]) // kind.itemsize).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["key", "ids"])

    return run


def _filled(df: DataFrame, key: str, text: str, folder: str, name: str, sizes: bool) -> tuple[DataFrame, DataFrame]:
    """(whole, parts): the rows of texts without a hole, and the pieces of all others with every hole filled."""
    rows = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")))
    known = df.sparkSession.sparkContext.broadcast(shared_cores(rows.select("text")))
    schema = PIECES.format(kind=df.schema[key].dataType.simpleString())
    pieces = stored(rows.mapInArrow(_pieces(folder, name, known, sizes), schema))
    once = pieces.filter("unit is not null").groupBy("digest").agg(F.first("unit").alias("unit"))
    once = once.mapInArrow(_pack(folder, name, sizes), "digest binary, packed binary, n bigint")
    parts = pieces.filter("not whole").select("row", "key", "seq", "packed", "n", "digest")
    holes = parts.filter("digest is not null").select("row", "key", "seq", "digest").join(once, "digest", "left")
    lost = F.col("n").isNull()
    holes = holes.select("row", "key", "seq", "packed", F.when(lost, F.raise_error(F.lit("a core has no ids")).cast("bigint")).otherwise(F.col("n")).alias("n"))
    return pieces.filter("whole").select("row", "key", "packed", "n"), parts.filter("digest is null").select("row", "key", "seq", "packed", "n").unionByName(holes)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, ids array<int>): the ids of every text, special tokens neither added nor recognised.

    One row for each row of ``df``, repeated rows and null keys included; an empty or null text has an empty list.
    Other columns of ``df`` are ignored.  Rows are numbered in one evaluation that is written, so a lost executor
    changes nothing.  Of a core that a third of all rows share, the text crosses the shuffle once a task; its holes are
    a few dozen bytes each, and the left join that fills them is a sort-merge join which adaptive execution splits
    where a key is hot.  A hole that found no ids would be an error, not a missing row.
    """
    kind = df.schema[key].dataType.simpleString()
    whole, parts = _filled(df, key, text, folder, name, False)
    part = F.struct("seq", "packed", "n")  # n is read so that a hole without ids cannot pass
    joined = parts.groupBy("row").agg(F.max("key").alias("key"), F.array_sort(F.collect_list(part)).alias("parts")).filter(F.forall("parts", lambda p: p["n"] >= 0))
    every = whole.select("key", F.array("packed").alias("parts")).unionByName(joined.select("key", F.col("parts.packed").alias("parts")))
    return every.mapInArrow(_join_up(folder, name), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_ids(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> DataFrame:
    """(row, key, n_ids): as many ids as ``encode_corpus`` gives, without moving the ids themselves."""
    whole, parts = _filled(df, key, text, folder, name, True)
    summed = parts.groupBy("row").agg(F.max("key").alias(key), F.sum("n").alias("n_ids"))
    return whole.select("row", F.col("key").alias(key), F.col("n").alias("n_ids")).unionByName(summed)


def p8_ids(spark, sf_dir: str) -> DataFrame:
    from evidencia.runtime import table

    return encode_corpus(table(spark, sf_dir, "documents", "doc_id", "text"))

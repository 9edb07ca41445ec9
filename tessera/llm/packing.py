"""Packing along a space-filling curve.

A document's hashed bag of tokens is projected to DIMS dimensions by one
random linear map; the coordinates, scaled by the mean and deviation over all
documents, give its key on a Hilbert curve; all documents are ordered by that
key, laid end to end, and cut into sequences. So neighbours on the curve
share sequences and only the last sequence can be short; it is cut into
powers of two, which need no padding.

Null texts are empty ones: a document always has its end token. Null ids and
repeated rows stay separate documents, other columns are ignored, and an
empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import by_bytes, run_dir, text_of, written
from tessera.llm._order import positioned
from tessera.llm._tokens import WordUnits

#: Dimensions of the projection and bits of each coordinate; buckets of the hashed vectors.
DIMS, BITS, BUCKETS = 4, 12, 4096
END_ID = 1


def projection(seed: int = 42) -> np.ndarray:
    """For each token id the vector that it adds: the row of its bucket in a random map."""
    rows = np.random.default_rng(seed).standard_normal((BUCKETS, DIMS)).astype(np.float32)
    ids = np.arange(1 << 16, dtype=np.uint64)
    return rows[((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64) % BUCKETS]


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (rows of `cells`), by Skilling's transform."""
    x = [cells[:, i].astype(np.uint64).copy() for i in range(cells.shape[1])]
    dims = len(x)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        low = q - np.uint64(1)
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= np.uint64(1)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(len(cells), np.uint64)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        flip = np.where((x[dims - 1] & q) != 0, flip ^ (q - np.uint64(1)), flip)
        q >>= np.uint64(1)
    key = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << np.uint64(1)) | (((x[i] ^ flip) >> np.uint64(b)) & np.uint64(1))
    return key


def tokenised(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """uid, id, ids (16-bit), n and the projected vector of every row, written once."""

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        units, vectors = WordUnits.of(tokenizer_path), list(np.ascontiguousarray(projection().T))
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            for part in by_bytes(b, "t"):
                ids, n = units.ids(part.column("t"))
                n = n + 1  # its end
                ends = np.cumsum(n)
                at = ends - n
                flat = np.full(int(n.sum()), END_ID, "<u2")
                inside = np.ones(len(flat), bool)
                inside[ends - 1] = False
                flat[inside] = ids
                points = [np.add.reduceat(v[flat], at, dtype=np.float64) / n for v in vectors]
                uids = np.arange(uid, uid + len(n))
                uid += len(n)
                offsets = np.concatenate([[0], ends * 2]).astype(np.int32)
                made = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), part.column("id"), made, pa.array(n, pa.int64()), *map(pa.array, points)], ["uid", "id", "ids", "_w", *[f"p{d}" for d in range(DIMS)]])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text).alias("t")).mapInArrow(encode, f"uid long, id {kind}, ids binary, _w long, {', '.join(f'p{d} double' for d in range(DIMS))}")
    return written(rows, run_dir(docs.sparkSession, "packing-tokens"))


def curve_order(tokens: DataFrame) -> DataFrame:
    """uid, `_rank` and `_before` (tokens ahead) along the curve."""
    spark = tokens.sparkSession
    stats = tokens.agg(*[f(f"p{d}") for d in range(DIMS) for f in (F.avg, F.stddev_pop)]).first()
    mean, dev = [x or 0.0 for x in stats[::2]], [x or 1.0 for x in stats[1::2]]

    def keyed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            z = np.stack([(b.column(f"p{d}").to_numpy() - mean[d]) / dev[d] for d in range(DIMS)], axis=1)
            # the logistic curve spreads the middle and keeps far points apart
            cells = np.minimum((1 << BITS) / (1 + np.exp(-1.7 * z)), (1 << BITS) - 1).astype(np.uint64)
            keys = [f"{k:012x}{u:016x}" for k, u in zip(hilbert_keys(cells).tolist(), b.column("uid").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("_w"), pa.array(keys, pa.string())], ["uid", "_w", "_key"])

    slim = written(tokens.select("uid", "_w", *[f"p{d}" for d in range(DIMS)]).mapInArrow(keyed, "uid long, _w long, _key string"), run_dir(spark, "packing-keys"))
    return positioned(slim, "packing-order", 64)


def cuts_of(total: int, length: int) -> tuple[int, list[int]]:
    """Where the last, short sequence begins, and the lengths it is cut into."""
    rest = total % length
    return total - rest, [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: id, start, piece_ids (16-bit), length, ids_crc32, doc_tokens, sequence_id, offset."""
    if length & (length - 1):
        raise ValueError("the length of a sequence has to be a power of two")
    tokens = tokenised(docs, tokenizer_path, id_col, text)
    order = curve_order(tokens)
    total = int(tokens.agg(F.sum("_w")).first()[0] or 0)
    tail, tail_cuts = cuts_of(total, length)
    ends = np.cumsum(tail_cuts) + tail

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, raw, before in zip(b.column("id").to_pylist(), b.column("ids").to_pylist(), b.column("_before").to_pylist(), strict=True):
                ids = np.frombuffer(raw, "<u2")
                at, n = 0, len(ids)
                while at < n:
                    g = before + at
                    if g < tail:
                        seq, off = divmod(g, length)
                        end = (seq + 1) * length
                    else:
                        k = int(np.searchsorted(ends, g, side="right"))
                        seq, end = tail // length + k, int(ends[k])
                        off = g - (end - tail_cuts[k])
                    m = min(n - at, end - g)
                    piece = ids[at : at + m]
                    for o, v in zip(out, (doc, at, piece.tobytes(), m, zlib.crc32(piece.astype("<u4").tobytes()), n, seq, off), strict=True):
                        o.append(v)
                    at += m
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field("id").type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), *[pa.array(o, pa.int64()) for o in out[3:]]], names)

    names = [id_col, "start", "piece_ids", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, piece_ids binary, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return tokens.select("uid", "id", "ids").join(order.select("uid", "_before"), "uid").select("id", "ids", "_before").mapInArrow(cut, schema)

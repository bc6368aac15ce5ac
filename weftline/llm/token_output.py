"""Token-ID output: frequency-ranked ids in a byte-aligned variable-length code.

Ids are replaced by their rank in falling corpus frequency (ties: smaller id
first), so the commonest 256 take one byte.  The code keeps lengths apart from
data: a control byte holds four 2-bit lengths (bytes less one), the data bytes
of the four ranks follow each other in a stream of their own.  A document
begins at a new control byte, so coded documents can be joined as bytes.
Decoding looks up each control byte in a table of lengths and gathers bytes
with numpy.

A file is a Parquet file of blocks in ascending document order; a block holds
many documents: their ids (and how many, at its start, have none), their token
counts, the control and the data bytes, and the count of tokens before it in its
file.  Texts are put in order as plain ids and coded as they are written, a
bounded number of bytes at a time.  The rank table is a small
Parquet table beside them.  Spark's committer writes both, so a lost executor
leaves no half file, and any store that Spark reaches can hold them.

Defined results: a null text counts as empty and still gets the end id; a null
doc_id comes first and comes back as null; equal
texts and equal doc_ids are all written (equal doc_ids in any order), a text of
any length as one document; equally frequent ids rank by id; empty tables give
no files' rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import encoder
from .common import cut, drop, drop_path, new_path, text_groups

#: Lengths of the four values of each control byte, and their sum.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def encode_ranks(ranks: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of uint32 values, and in both streams the
    offsets of the documents whose values end at ``ends`` (the first at 0)."""
    values = np.ascontiguousarray(ranks, "<u4")
    counts = np.diff(ends)
    control_at = np.concatenate([[0], np.cumsum((counts + 3) // 4)])
    size = 1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(4 * int(control_at[-1]), np.uint8)
    codes[np.arange(len(values)) + np.repeat(4 * control_at[:-1] - ends[:-1], counts)] = size - 1
    q = codes.reshape(-1, 4)
    control = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    data_at = np.concatenate([[0], np.cumsum(size)])[ends]
    if not len(size) or size.max() == 1:
        return control, control_at, values.astype(np.uint8), data_at
    keep = np.arange(4, dtype=np.uint8) < size[:, None].astype(np.uint8)
    return control, control_at, values.view(np.uint8).reshape(-1, 4)[keep], data_at


def decode_ranks(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The values of all documents again; the table gives all lengths at once."""
    groups = (counts + 3) // 4
    sizes = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()
    n = int(counts.sum())
    at = np.arange(n) + np.repeat(4 * (np.cumsum(groups) - groups) - (np.cumsum(counts) - counts), counts)
    keep = np.arange(4, dtype=np.uint8) < sizes[at][:, None]
    out = np.zeros((n, 4), np.uint8)
    out[keep] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def token_table(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian 16-bit integers where the
    vocabulary fits, else 32-bit, packed as bytes."""

    def run(batches: Iterator[pa.RecordBatch]):
        enc = encoder(tokenizer)
        kind = "<u2" if max(enc.lib.get_vocab_size(), end_id + 1) <= 65536 else "<u4"
        for b in text_groups(batches):
            ids, at = enc.encode([t or "" for t in b.column(1).to_pylist()])
            ids = np.insert(ids.astype(kind), at[1:], end_id)
            at = (at + np.arange(len(at))) * ids.itemsize
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(at) // ids.itemsize), pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ids)])],
                ["doc_id", "n_tokens", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def _flat(column: pa.Array) -> np.ndarray:
    """All bytes of a binary column in turn, without a copy."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]


def _binary(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch of :func:`token_table` rows, and the offsets of rows."""
    ends = np.concatenate([[0], np.cumsum(batch.column(1).to_numpy())])
    raw = _flat(batch.column(2))
    return raw.view("<u2" if len(raw) == 2 * ends[-1] else "<u4"), ends


def frequencies(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents, counted in each task before the shuffle."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for b in text_groups(batches, "ids", 4_000_000):
            c = np.bincount(_ids(b)[0], minlength=len(total))
            c[: len(total)] += total
            total = c
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return tokens.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block_tokens: int = 1 << 18) -> None:
    """Encode ``docs`` (doc_id, text) and write ``path/blocks`` and ``path/ranks``.

    The rank table has a row for each id of the vocabulary that occurs, which
    bounds what the driver holds and sends out."""
    spark = docs.sparkSession
    tokens = cut(token_table(docs, tokenizer, end_id), "ids")
    counted = frequencies(tokens).orderBy(F.desc("n"), "id").toPandas()
    by_rank = counted["id"].to_numpy(np.int64)
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    spark.createDataFrame(counted.assign(rank=range(len(counted)))[["rank", "id", "n"]], "rank long, id long, n long").coalesce(1).write.parquet(f"{path}/ranks")

    def blocks(batches):
        base = 0
        for b in text_groups(batches, "ids", 4_000_000):
            counts = b.column(1).to_numpy()
            ids, ends = _ids(b)
            control, control_at, data, data_at = encode_ranks(rank_of[ids], ends)
            cut_at = np.searchsorted(ends[1:], np.arange(block_tokens, ends[-1], block_tokens)) + 1
            edges = np.unique([0, *cut_at.tolist(), len(b)]).tolist()
            for i, j in zip(edges, edges[1:]):
                own = b.column(0).slice(i, j - i)
                row = {"base": base, "nulls": own.null_count, "doc_ids": own.fill_null(0).to_numpy().astype("<i8").tobytes(), "counts": counts[i:j].astype("<i8").tobytes(), "control": control[control_at[i] : control_at[j]].tobytes(), "data": data[data_at[i] : data_at[j]].tobytes()}
                yield pa.RecordBatch.from_pylist([row], _BLOCK)
                base += int(counts[i:j].sum())

    # a second key, so that rows of one doc_id, whatever their number, spread over files
    numbered = tokens.withColumn("place", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select(*tokens.columns)
    out = ordered.mapInArrow(blocks, "base long, nulls long, doc_ids binary, counts binary, control binary, data binary")
    out.select(F.spark_partition_id().alias("file"), "*").write.option("compression", "zstd").parquet(f"{path}/blocks")
    drop(tokens)


_BLOCK = pa.schema([("base", pa.int64()), ("nulls", pa.int64()), ("doc_ids", pa.binary()), ("counts", pa.binary()), ("control", pa.binary()), ("data", pa.binary())])


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start, ids): what the files hold, ids as 32-bit little-endian
    bytes, start counting all tokens of earlier documents.

    The driver holds the rank table and one token count a file."""
    blocks = spark.read.parquet(f"{path}/blocks")
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").toPandas()["id"].to_numpy(np.uint32)
    sizes = blocks.select("file", "base", "counts").mapInArrow(_file_sizes, "file int, n long").groupBy("file").agg(F.sum("n").alias("n")).collect()
    before, total = {}, 0
    for r in sorted(sizes):
        before[r.file], total = total, total + r.n

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                doc_ids, counts = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["counts"], "<i8")
                ids = ranks[decode_ranks(row["control"], row["data"], counts)].astype("<u4")
                ends = np.cumsum(counts)
                start = before[row["file"]] + row["base"] + ends - counts
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=np.arange(len(doc_ids)) < row["nulls"]), pa.array(start), _binary(np.concatenate([[0], ends * 4]), ids)], ["doc_id", "start", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, ids binary")


def _file_sizes(batches):
    for b in batches:
        n = [int(np.frombuffer(c.as_buffer(), "<i8").sum()) for c in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["file", "n"])


def id_digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what :func:`read_tokens` gives."""
    return decoded.select("doc_id", "start", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write, read back, and give the digests of what came back."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    out = cut(id_digests(read_tokens(docs.sparkSession, path)), "digests")
    drop_path(docs.sparkSession, path)
    return out

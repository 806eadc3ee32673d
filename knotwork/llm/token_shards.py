"""Training-order materialisation: token sequences at permuted slots of fixed-stride binary shards.

1. One pass encodes the documents, each with an end id that the vocabulary doesn't have, and writes their ids to a table in the shared folder,
   with the number of ids that came before in their partition.
2. The partitions' totals, one row each, make this a place in one stream of all ids, which is cut into sequences of ``seq_len``; only
   the last is padded. A keyed Feistel network over the next power of four permutes sequence numbers; walking its cycle until
   the value is below the number of sequences makes it a permutation of them. The value is the sequence's slot.
3. Pieces of sequences go to the partition of their shard, are sorted by slot and place, and each partition writes one file of records of
   one stride through Spark's file writer, so a lost executor's shard is written again and no half file stays.

A record is a header (slot, first document and the ids of it that came before, documents, ids, checksum) and the
ids, two bytes each while the vocabulary allows; a line feed ends it. Slot s is record s mod
``shard_rows`` of shard s div ``shard_rows``, so reading can resume anywhere; ``read_slots`` opens only the shards it needs. As the end id is no token,
documents can be told apart in what is read. Shards grow with the data, from ``LEAST_ROWS`` to ``MOST_ROWS`` records, so that there are few thousands of them.

The stream is in the order of the rows as they are read; another split of the input gives another order. With ``by_id`` documents are sorted by id and
text first, at the price of one more shuffle of the texts; then the same rows and key give the same shards on any cluster.

Cases. Null or empty text: only the end id. A null id, or one that is no integer, is stored as the smallest integer and read back as null. Repeated rows and
ids: each row is a document. Extra columns are ignored. A very long text fills as many sequences as it needs. An empty
table gives an empty folder and no rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import Table, new_path
from ..sources.edge_files import records
from .common import cut, map_batches, mix64, whole_id
from .tokens import chunk_ids, word_bpe_path

SEQ_LEN, KEY, ROUNDS = 2048, 20_261, 6
#: Records of the smallest and the largest shard, and shards from which on they grow.
LEAST_ROWS, MOST_ROWS, MANY_SHARDS = 4096, 1 << 18, 4096
HEADER = np.dtype([("slot", "<i8"), ("doc", "<i8"), ("start", "<i8"), ("n_docs", "<u4"), ("n_ids", "<u4"), ("crc", "<u4")])
NO_ID = -(1 << 63)
_U = np.uint64


def feistel(numbers: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A permutation of 0..n-1, chosen by ``key``, at each of ``numbers``."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask = _U((1 << half) - 1)
    keys = mix64(np.arange(ROUNDS, dtype=np.uint64) + mix64(np.array([key], np.uint64)))
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> _U(half), out[walking] & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        out[walking] = left << _U(half) | right
        walking = walking[out[walking] >= _U(n)]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """Where the shards are and how their records look; ``end_id`` ends each document."""

    path: str
    sequences: int
    seq_len: int
    shard_rows: int
    id_bytes: int
    end_id: int

    @property
    def stride(self) -> int:
        return HEADER.itemsize + self.seq_len * self.id_bytes + 1

    @property
    def shards(self) -> int:
        return -(-self.sequences // self.shard_rows)


def rows_of_shard(sequences: int) -> int:
    """A power of two."""
    return min(MOST_ROWS, max(LEAST_ROWS, 1 << (-(-sequences // MANY_SHARDS) - 1).bit_length()))


def coded(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, id_bytes: int) -> DataFrame:
    """(part, at, doc, n, ids) of each row: its ids, and how many of its partition come before."""

    kind = np.dtype(f"<u{id_bytes}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, ids_of = TaskContext.get().partitionId(), 0, chunk_ids(path)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in cut(batches, "text"):
            raw = ids_of.encode([t or "" for t in batch.column("text").to_pylist()])
            n = np.array([len(x) // 4 + 1 for x in raw], np.int64)
            ids = np.frombuffer(end.join(raw) + end, "<u4").astype(kind)  # of all documents at once
            offsets = np.concatenate([[0], np.cumsum(n) * id_bytes]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part)), pa.array(before + np.cumsum(n) - n), batch.column("id"), pa.array(n), packed], names=["part", "at", "doc", "n", "ids"])
            before += int(n.sum())

    slim = docs.select(F.coalesce(whole_id(docs, id_col), F.lit(NO_ID)).alias("id"), F.col(f"`{text_col}`").alias("text"))
    return map_batches(slim, run, "part long, at long, doc long, n long, ids binary")


PIECE = "slot long, place long, doc long, start long, starts long, ids binary"


def _pieces(batches: Iterator[pa.RecordBatch], base: dict[int, int], layout: Layout, key: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``coded`` as pieces of sequences: slot, place there, the document of the first id and its ids before, documents that start, ids."""
    for batch in batches:
        part, at, doc, n = (batch.column(i).to_numpy() for i in range(4))
        data = batch.column(4)
        offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].tolist()
        whole = memoryview(data.buffers()[2]) if len(data) else b""
        begin = np.array([base[int(p)] for p in part], np.int64) + at
        # runs of neighbouring documents of the stream, which are cut as one
        heads = np.flatnonzero(np.concatenate([[True], begin[1:] != begin[:-1] + n[:-1]]))
        out = []
        for lo, hi in zip(heads, np.append(heads[1:], len(n)), strict=True):
            first, last = int(begin[lo]), int(begin[hi - 1] + n[hi - 1])
            cuts = np.unique(np.concatenate([[first, last], np.arange(-(-first // layout.seq_len) * layout.seq_len, last, layout.seq_len)]))
            own = np.searchsorted(begin[lo:hi], cuts[:-1], "right") - 1 + lo
            started = np.searchsorted(begin[lo:hi], cuts, "left")
            raw = whole[offsets[lo] : offsets[hi]]
            ids = [raw[(x - first) * layout.id_bytes : (y - first) * layout.id_bytes] for x, y in itertools.pairwise(cuts.tolist())]
            slots = feistel(cuts[:-1] // layout.seq_len, layout.sequences, key)
            out.append(pa.RecordBatch.from_arrays([slots, cuts[:-1] % layout.seq_len, doc[own], cuts[:-1] - begin[own], np.diff(started), pa.array(ids, pa.binary())], names=[x.split()[0] for x in PIECE.split(", ")]))
        yield from out


def _records(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    """Pieces, sorted by slot and place, as records."""

    def record(slot: int, own: list[tuple]) -> bytes:
        ids = b"".join([x[3] for x in own])
        _, doc, start, _ = own[0]
        head = np.array([(slot, doc, start, sum(x[0] for x in own) + (start > 0), len(ids) // layout.id_bytes, zlib.crc32(ids))], HEADER)
        return head.tobytes() + ids.ljust(layout.seq_len * layout.id_bytes, b"\0")

    now, own = None, []
    for batch in batches:
        done = []
        for slot, doc, start, starts, ids in zip(*[batch.column(x).to_pylist() for x in ("slot", "doc", "start", "starts", "ids")], strict=True):
            if slot != now:
                if own:
                    done.append(record(now, own))
                now, own = slot, []
            own.append((starts, doc, start, ids))
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], names=["record"])
    if own:
        yield pa.RecordBatch.from_arrays([pa.array([record(now, own)], pa.binary())], names=["record"])


def write_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, out: str | None = None, seq_len: int = SEQ_LEN, end_id: int | None = None, shard_rows: int | None = None, key: int = KEY, by_id: bool = False) -> Layout:
    """Write the shards of all documents to the folder ``out`` (a new one in the shared folder, if not given).

    ``end_id`` is the first id past the vocabulary, if not given.
    """
    spark, path = docs.sparkSession, path or word_bpe_path()
    end_id = chunk_ids(path).tokenizer.get_vocab_size() if end_id is None else end_id
    id_bytes = 2 if max(end_id, chunk_ids(path).tokenizer.get_vocab_size() - 1) < 1 << 16 else 4
    if by_id:
        order = [whole_id(docs, id_col), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))]
        docs = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    table = Table(coded(docs, id_col, text_col, path, end_id, id_bytes), "ids", codec="zstd")
    base, total = {}, 0
    for part, n in table.df.groupBy("part").agg(F.sum("n")).orderBy("part").collect():
        base[part], total = total, total + n
    sequences = -(-total // seq_len)
    layout = Layout(out or new_path(spark, "shards"), sequences, seq_len, shard_rows or rows_of_shard(sequences), id_bytes, end_id)
    if sequences:
        pieces = map_batches(table.df, lambda batches: _pieces(batches, base, layout, key), PIECE)
        dealt = pieces.repartitionById(layout.shards, F.expr(f"CAST(slot DIV {layout.shard_rows} AS INT)")).sortWithinPartitions("slot", "place")
        records = map_batches(dealt, lambda batches: _records(batches, layout), "record binary").select(F.col("record").cast("string"))
        records.write.option("compression", "none").option("lineSep", "\n").text(layout.path)
    table.drop()
    return layout


READ = "slot long, shard long, position long, doc_id long, start long, n_docs long, n_tokens long, ids_crc32 long, sound boolean, ids binary"


def _read(batches: Iterator[pa.RecordBatch], layout: Layout, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """What records hold, a batch of them at a time."""
    names = [x.split()[0] for x in READ.split(", ")]
    for batch in batches:
        column = batch.column(0)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, layout.stride) if len(column) else np.empty((0, layout.stride), np.uint8)
        head = np.ascontiguousarray(raw[:, : HEADER.itemsize]).view(HEADER)[:, 0]
        ends = HEADER.itemsize + head["n_ids"].astype(np.int64) * layout.id_bytes
        crc = np.array([zlib.crc32(r[HEADER.itemsize : e]) for r, e in zip(raw, ends.tolist(), strict=True)], np.int64)
        found = [head["slot"], head["slot"] // layout.shard_rows, head["slot"] % layout.shard_rows, pa.array(head["doc"], mask=head["doc"] == NO_ID), head["start"], head["n_docs"].astype(np.int64), head["n_ids"].astype(np.int64), crc, head["crc"] == crc]
        if with_ids:
            found.append(pa.array([r[HEADER.itemsize : e].tobytes() for r, e in zip(raw, ends.tolist(), strict=True)], pa.binary()))
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(np.ascontiguousarray(x)) for x in found], names=names[: len(found)])


def read_slots(spark: SparkSession, layout: Layout, first: int = 0, count: int | None = None, with_ids: bool = False) -> DataFrame:
    """What the records of ``count`` slots from ``first`` hold, with their ids if asked; only the shards they lie in are opened."""
    last = min(layout.sequences, layout.sequences if count is None else first + count)
    columns = READ if with_ids else READ.removesuffix(", ids binary")
    if first >= last:
        return spark.createDataFrame([], columns)
    shards = range(first // layout.shard_rows, -(-last // layout.shard_rows))
    names = "part-*" if len(shards) == layout.shards else "{" + ",".join(f"part-{s:05d}-*" for s in shards) + "}"
    found = map_batches(records(spark, f"{layout.path}/{names}", layout.stride), lambda batches: _read(batches, layout, with_ids), columns)
    return found.where((F.col("slot") >= first) & (F.col("slot") < last))

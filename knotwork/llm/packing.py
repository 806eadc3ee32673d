"""First-fit-decreasing packing of documents into sequences of a fixed number of tokens.

Each document's ids (and an end id) are cut into full pieces, which are sequences by themselves, and a
rest. Documents are dealt at random into groups of about ``group_rows``; in each group the rests are
placed, longest first, into the leftmost sequence with room, found by descending a tournament tree of
the free capacities. Groups are independent, so no task holds more than its groups, and only lengths
and checksums are shuffled. With thousands of rests a group, first-fit decreasing leaves next to no room.

Cases. Null or empty text: a document of only the end id. Repeated ids and rows: each row is a document
of its own. Ids are cast to long; one that can't be is null. Extra columns are ignored. An empty table gives an empty result. A very long text gives as
many pieces as it needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_frames, mix64, whole_id
from .tokens import chunk_ids, word_bpe_path

SEQ_LEN, END_ID, GROUP_ROWS = 2048, 1, 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


class Tournament:
    """The leftmost of ``n`` bins with at least so much room, in log n steps."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """(bin, its room before) for an item; there is always room in a bin not used so far."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        leaf, before = node - self.leaves, room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return leaf, before


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; equal sizes keep their order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree = Tournament(max(1, len(sizes)), capacity)
    for i in np.argsort(-sizes, kind="stable"):
        bins[i], before = tree.place(int(sizes[i]))
        offsets[i] = capacity - before
    return bins, offsets


def cut(ids: bytes, seq_len: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, checksum) of each piece of a document's ids, given as uint32 bytes."""
    n = len(ids) // 4
    for start in range(0, n, seq_len):
        piece = ids[4 * start : 4 * (start + seq_len)]
        yield start, len(piece) // 4, zlib.crc32(piece)


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, n_groups: int, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document, with the group that it is dealt to."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ids_of, end, row = chunk_ids(path), np.asarray([end_id], "<u4").tobytes(), 0
        part = np.uint64(TaskContext.get().partitionId())
        for pdf in frames:
            groups = mix64((part << np.uint64(40)) + np.arange(row, row + len(pdf), dtype=np.uint64) + np.uint64(1)) % np.uint64(n_groups)
            row += len(pdf)
            out = []
            for doc, group, ids in zip(pdf["id"], groups, ids_of.encode([t or "" for t in pdf["text"]]), strict=True):
                ids += end
                out += [(int(group), doc, s, n, c, len(ids) // 4) for s, n, c in cut(ids, seq_len)]
            yield pd.DataFrame(out, columns=["grp", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    slim = docs.select(whole_id(docs, id_col).alias("id"), F.col(f"`{text_col}`").alias("text"))
    return map_frames(slim, run, "grp long, " + PIECES, "text")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: where it starts in its document and where it lies in which sequence."""
    n_groups = max(1, -(-docs.count() // group_rows))

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), seq_len)
        placed = rows.drop_columns("grp").append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins))
        return placed.append_column("offset", pa.array(offsets))

    return pieces(docs, id_col, text_col, path or word_bpe_path(), n_groups, seq_len, end_id).groupBy("grp").applyInArrow(place, PACKED)

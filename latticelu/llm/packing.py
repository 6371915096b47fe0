"""Bound-certified best-fit packing of tokenised documents into fixed-length sequences.

Pieces are dealt by hash into groups of bounded size; each group is packed best-fit
decreasing.  Dual-feasible functions give a lower bound on the group's bins.  A group
that reaches its bound without more room than rounding leaves is certified: its bins are
final but for the emptiest.  Any other group has a gap - to its bound, or to what its
summed length needs, when its mix of lengths is to blame - and releases every bin that
has room.  What groups release is dealt anew, so documents change groups, and packed again,
in fewer groups each round (a group may grow to eight times `group_rows`).  It ends when
the bound of all released pieces together certifies their bins, when one group holds
them all, or when a round releases as many bins as the one before: nothing more is to be had
by exchange.  The result says which: `lower_bound` is that of all pieces together, and
`certified` whether as many sequences were made.

Only (id, piece, length, ...) rows move between groups, never token ids.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_SPECIAL = "<|endoftext|>"
_LONG = 1 << 20


# ---------------------------------------------------------------- bounds and packing


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset, number of bins) for lengths sorted from the largest, each from 1 to capacity."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, count = 0, 0  # bit r of rooms: some bin has room r
    for k, size in enumerate(lengths.tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, count
            count += 1
        bins[k], offsets[k] = b, capacity - room
        if room > size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, offsets, count


def lower_bound(lengths: np.ndarray | dict[int, int], capacity: int = CAPACITY, depth: int = 24) -> int:
    """The largest bound that the dual-feasible functions give on the number of bins.

    `lengths` lists lengths, or maps each to how many there are.

    Families: the identity; the threshold functions, which round sizes over
    capacity - e up to capacity and those under e down to zero; and the rounding
    functions u(k), which keep x where (k+1)x/capacity is whole and else take
    floor((k+1)x/capacity) * capacity / k.
    """
    if not len(lengths):
        return 0
    if isinstance(lengths, dict):
        count = np.zeros(capacity + 1, np.int64)
        count[list(lengths)] = list(lengths.values())
    else:
        count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(count @ x) // capacity)
    mass, number = np.cumsum(count * x), np.cumsum(count)
    for e in range(1, capacity // 2 + 1):
        middle = int(mass[capacity - e] - mass[e - 1])  # sizes from e to capacity - e
        large = int(number[capacity] - number[capacity - e])
        best = max(best, large + -(-middle // capacity))
    for k in range(1, depth + 1):
        whole = ((k + 1) * x) % capacity == 0
        scaled = np.where(whole, x * k, ((k + 1) * x // capacity) * capacity)  # k times u(k)
        best = max(best, -(-int(count @ scaled) // (k * capacity)))
    return best


def _pack_group(table: pa.Table, capacity: int, final: bool, group: int) -> pa.Table:
    order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
    table = table.sort_by(order)
    lengths = table.column("length").to_numpy()
    bins, offsets, count = best_fit_decreasing(lengths, capacity)
    room = capacity - np.bincount(bins, lengths, count).astype(np.int64)
    done = np.ones(count, bool)
    if not final and count:
        certified = count == lower_bound(lengths, capacity)
        if not certified or count > -(-int(lengths.sum()) // capacity):
            done = room == 0
        else:
            done[np.argmax(room)] = False
    columns = [table.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
    seq = (np.int64(group) << 32) + bins
    return pa.Table.from_arrays([*columns, pa.array(seq), pa.array(offsets), pa.array(done[bins])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "done"])


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = 100_000) -> DataFrame:
    """`pieces` with sequence_id and offset, lower_bound and certified; lengths from 1 to capacity.

    Pieces of full length are a sequence each.  lower_bound is the dual-feasible bound on the
    number of sequences, certified whether the result attains it; both are the same in all
    rows.  `pieces` must be a stored table.  An empty table gives an empty result.
    """
    full = pieces.filter(F.col("length") == capacity)
    # one sequence for each row; the table is stored, so partition and order in it are fixed
    parts = [full.select("*", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    # at most a row for each length reaches the driver
    histogram = lambda df: {r["length"]: r["n"] for r in df.groupBy("length").agg(F.count("*").alias("n")).collect()}
    every = histogram(pieces)
    bound, count = lower_bound(every, capacity), every.get(capacity, 0)
    pool, rows = pieces.filter(F.col("length") < capacity), sum(every.values()) - count
    schema = f"{PIECES}, sequence_id bigint, offset bigint, done boolean"
    turn, before = 0, None
    while rows:
        groups = math.ceil(rows / (group_rows * min(2**turn, 8)))
        final = groups == 1

        def run(batches: Iterator[pa.RecordBatch], turn=turn, final=final) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            if held and any(b.num_rows for b in held):
                group = (turn << 24) + TaskContext.get().partitionId()
                yield from _pack_group(pa.Table.from_batches(held), capacity, final, group).to_batches(max_chunksize=50_000)

        # the row number, of a stored table, spreads rows that repeat
        dealt = pool.repartition(groups, F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(turn)))
        packed = materialize(dealt.select(*pieces.columns).mapInArrow(run, schema), "packed")
        finished = packed.filter("done").drop("done")
        parts.append(finished)
        count += finished.filter("offset = 0").count()
        if final:
            break
        left = packed.filter("not done")
        lengths, bins = histogram(left), left.filter("offset = 0").count()
        if bins <= lower_bound(lengths, capacity) or bins == before:
            parts.append(left.drop("done"))
            count += bins
            break
        pool, rows, turn, before = left.select(*pieces.columns), sum(lengths.values()), turn + 1, bins
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumns({"lower_bound": F.lit(bound).cast("bigint"), "certified": F.lit(count == bound)})


# ---------------------------------------------------------------- tokenising


@lru_cache(maxsize=4)
def _encoder(tokenizer_path: str):
    """text -> ids, equal to tokenizers' Tokenizer.encode(text, add_special_tokens=False).ids.

    The vocabulary's rank file next to the JSON gives the same ids several times as
    fast; where there is none, or it gives up on a text, tokenizers encodes.
    """
    import base64
    import os

    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_path)
    ranks_path = os.path.splitext(tokenizer_path)[0] + ".tiktoken"
    if not os.path.exists(ranks_path):
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={_SPECIAL: slow.token_to_id(_SPECIAL)})

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except BaseException as e:  # the library's panics aren't Exceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return slow.encode(text, add_special_tokens=False).ids

    return encode


def cut(ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole if it fits, else the first piece may be shorter."""
    n = len(ids)
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(s, capacity) for s in range(first, n, capacity)]


def tokenize(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of every document, with their ids if asked; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        for batch in batches:
            doc, piece, start, length, crc, tokens = [], [], [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                for k, (s, n) in enumerate(cut(ids, capacity)):
                    own = ids[s : s + n]
                    doc.append(d), piece.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(own.tobytes()))
                    if with_ids:
                        tokens.append(own.astype(np.int32))
            arrays = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(tokens, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, group_rows: int = 100_000) -> DataFrame:
    """Every piece of every document with its sequence_id and its offset there.

    Null and empty texts are the end id alone; repeated rows are packed once each; a
    null id stays null; an empty table gives an empty result; other columns aren't read.
    """
    pieces = materialize(tokenize(docs, tokenizer_path, id_col, text_col, capacity, end_id), "pieces")
    return pack_pieces(pieces, capacity, group_rows)

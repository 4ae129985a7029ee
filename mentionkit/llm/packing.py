"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted at once. Pieces are placed longest first into the open
sequence that they fill best. A piece that fits nowhere opens a sequence of the length that costs
least per token, judged by filling each permitted length in turn with the longest pieces that are
left. At the end each sequence is cut down to the shortest permitted length that holds its contents.
A document longer than the longest sequence is cut into full sequences and a rest, so no token is lost.

Cost of a sequence: its length plus ``overhead`` tokens (start-up and per-sequence work).

Scale. Only (id, length) pairs move. Pieces are dealt by a hash of id and row number into blocks of
about ``BLOCK_PIECES``; each block is packed by itself in one task, so memory and time are bounded by
a block whatever the input, a third of all rows under one id spreads over all blocks, and a block's
loss is the few sequences it leaves part-filled. Within a block equal lengths are handled together
by counts. Full sequences of cut documents need no packing and never enter a block.

Defined results: a null or negative length counts as 0, and a piece of length 0 takes a place in some
sequence. Repeated rows and ids are packed each for itself. An empty table gives no rows. Only the id
and length columns are read.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionkit.llm.common import materialise

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Fixed cost of a sequence, in tokens.
OVERHEAD = 16
#: Pieces in a block, about.
BLOCK_PIECES = 20_000


class Lengths:
    """A multiset of piece lengths with their ids; the longest at most some limit comes first."""

    def __init__(self, pieces: list[tuple[int, tuple]]):
        self.ids: dict[int, list] = defaultdict(list)
        for length, ident in pieces:
            self.ids[length].append(ident)
        for own in self.ids.values():
            own.sort(reverse=True)
        self.left = sorted(self.ids)

    def take(self, length: int) -> tuple:
        ident = self.ids[length].pop()
        if not self.ids[length]:
            del self.left[bisect.bisect_left(self.left, length)]
        return ident

    def fill(self, room: int, used: int) -> int:
        """Tokens that longest-first filling of ``room`` would place, ``used`` (one piece) among them."""
        room -= used
        total, spent = used, {used: 1}
        while room > 0:
            i = bisect.bisect_right(self.left, room) - 1
            while i >= 0 and len(self.ids[self.left[i]]) <= spent.get(self.left[i], 0):
                i -= 1
            if i < 0 or self.left[i] <= 0:
                break
            length = self.left[i]
            n = min(room // length, len(self.ids[length]) - spent.get(length, 0))
            spent[length] = spent.get(length, 0) + n
            total += n * length
            room -= n * length
        return total


def pack(pieces: list[tuple[int, tuple]], capacities: tuple[int, ...] = CAPACITIES,
         overhead: int = OVERHEAD) -> list[tuple[int, list[tuple[int, tuple]]]]:
    """(length, id) pieces, none longer than the largest capacity -> [(capacity, pieces)] of each sequence."""
    sizes = sorted(capacities)
    lengths = Lengths(pieces)
    bins: list[tuple[int, list[tuple[int, tuple]]]] = []
    rooms: list[tuple[int, int]] = []  # (room, bin) of open sequences, ascending
    while lengths.left:
        length = lengths.left[-1]
        i = bisect.bisect_left(rooms, (length, -1))
        if i < len(rooms):
            room, b = rooms.pop(i)
        else:
            room = min((c for c in sizes if c >= length), key=lambda c: (
                (c + overhead) / max(1, lengths.fill(c, length)), c))
            b = len(bins)
            bins.append((room, []))
        bins[b][1].append((length, lengths.take(length)))
        bisect.insort(rooms, (room - length, b))
    out = []
    for _, held in bins:
        used = sum(n for n, _ in held)
        out.append((next(c for c in sizes if c >= used), held))
    return out


_SCHEMA = ("sequence string, capacity int, used int, piece_order int, doc_id {0}, piece long, start long, length int")


def pack_documents(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD,
                   block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """``(doc_id, length)`` -> a row for each piece: its sequence, that one's ``capacity`` and ``used`` tokens.

    ``piece`` numbers a document's pieces from 0 and ``start`` is the piece's first token;
    ``piece_order`` its place in the sequence.
    """
    if not capacities or min(capacities) <= 0:
        raise ValueError("capacities must be positive")
    largest = max(capacities)
    kind = lengths.schema["doc_id"].dataType.simpleString()
    schema = _SCHEMA.format(kind)
    rows = materialise(lengths.select(
        "doc_id", F.greatest(F.coalesce(F.col("length").cast("long"), F.lit(0)), F.lit(0)).alias("length"),
        F.monotonically_increasing_id().alias("row")), "pack-lengths")
    full = F.floor(F.col("length") / F.lit(largest)).cast("long")
    rest = F.col("length") - full * largest
    # full sequences: nothing to decide
    whole = rows.filter(F.col("length") >= largest).select(
        "doc_id", "row", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece")).select(
        F.concat_ws("-", F.lit("full"), "row", "piece").alias("sequence"), F.lit(largest).alias("capacity"),
        F.lit(largest).alias("used"), F.lit(0).alias("piece_order"), "doc_id", "piece",
        (F.col("piece") * largest).alias("start"), F.lit(largest).alias("length"))
    loose = rows.filter((F.col("length") == 0) | (rest > 0)).select(
        "doc_id", "row", full.alias("piece"), (full * largest).alias("start"), rest.cast("int").alias("length"))
    blocks = max(1, -(-loose.count() // block_pieces))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks))

    def pack_block(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_pylist() for c in table.column_names}
        key = col["block"][0]
        pieces = [(n, (r, i)) for i, (n, r) in enumerate(zip(col["length"], col["row"]))]
        out: list[tuple] = []
        for b, (capacity, held) in enumerate(pack(pieces, capacities, overhead)):
            used = sum(n for n, _ in held)
            for order, (n, (_, i)) in enumerate(held):
                out.append((f"{key}-{b}", capacity, used, order, col["doc_id"][i], col["piece"][i], col["start"][i], n))
        names = ["sequence", "capacity", "used", "piece_order", "doc_id", "piece", "start", "length"]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), table.schema.field("doc_id").type, pa.int64(),
                 pa.int64(), pa.int32()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    packed = loose.withColumn("block", block).groupBy("block").applyInArrow(pack_block, schema)
    return whole.select(*packed.columns).unionByName(packed)

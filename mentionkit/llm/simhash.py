"""SimHash near-duplicates through deletion-variant signatures.

A text's 64-bit fingerprint holds, per bit, the majority over the XXH64 hashes of its word shingles.
Fingerprints that differ in at most ``k`` bits are linked. The 64 bits are cut into ceil((k + 1) / 2)
segments, so that of any linked pair some segment differs in at most one bit; every segment is
indexed once per bit position with that bit struck out, and two segments that differ in at most one
bit share such a variant. Variants are joined by equality (shuffle on the variant) and verified.

Scale. Copies share a fingerprint and are collapsed first by a partial aggregate, so a group of
copies is one index entry however large. A pair is verified only in the first variant in which it
meets, so no link is found twice, and from a bucket come only links that join its parts (a spanning
forest, fewer than its members), never all pairs. A bucket of many fingerprints is cut again by the
same rule over the bits outside its segment instead of being compared pair by pair. Links and
components stay in DataFrames; see ``graph.components``. Text is read once and never shuffled by
``near_duplicates``.

Defined results: null and empty texts have no words and fingerprint zero, which links like any other.
Every input row gives one output row; repeated rows and ids are kept. A null ``doc_id`` is never the
component id unless a component has no other. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionkit.llm.common import free_name, materialise, python_rows, text_bytes
from mentionkit.llm.graph import components

SHINGLE_WORDS = 4
MAX_BITS = 4
#: Fixed by the contract.
HASH_SEED = 42
#: Hashes that are added up at a time.
HASH_CHUNK = 1 << 15
#: Buckets of up to so many fingerprints are compared pair by pair, many buckets at once.
SMALL_BUCKET = 4
#: Buckets of more are cut again.
BUCKET_SCAN = 4096


def fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return hashed(b" ".join(words), HASH_SEED)
    total = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, total, HASH_CHUNK):
        part = words[at:at + HASH_CHUNK + shingle - 1]
        grams = zip(*(part[i:] for i in range(shingle)))
        h = np.array([hashed(b" ".join(g), HASH_SEED) for g in grams], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _as_long(fp: int) -> int:
    return fp - (1 << 64) if fp >> 63 else fp


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE_WORDS, name: str = "fp") -> DataFrame:
    """``docs`` (any columns, ``text``) with the fingerprint as a signed long in column ``name``."""
    def stamp(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([texts], names=["text"])
            yield pa.array([_as_long(fingerprint(t, shingle)) for (t,) in python_rows([batch])], pa.int64())

    return docs.withColumn(name, F.arrow_udf(stamp, "long", F.ArrowUDFType.SCALAR_ITER)(text_bytes()))


# ------------------------------------------------------------------ links ---
def cuts(width_from: int, width_to: int, parts: int) -> list[tuple[int, int]]:
    """``parts`` segments [low, high) of the bits from..to, the wider ones first."""
    n = width_to - width_from
    out, low = [], width_from
    for i in range(parts):
        high = low + n // parts + (i < n % parts)
        out.append((low, high))
        low = high
    return out


def _mask(low: int, high: int) -> int:
    return ((1 << (high - low)) - 1) << low


class Cut:
    """A cut of some of the 64 bits into segments, one of which differs in at most one bit."""

    def __init__(self, masks: list[int]):
        self.masks = [np.uint64(m) for m in masks]
        #: (bit struck out, mask of the rest of its segment)
        self.variants = [(np.uint64(1 << b), np.uint64(m & ~(1 << b)))
                         for m in masks for b in range(64) if m >> b & 1]
        self.lowest = [np.uint64(m & -m) for m in masks]

    def meets(self, x: np.ndarray) -> np.ndarray:
        """Of each xor of two fingerprints, the struck-out bit of the first variant that both share (0: none)."""
        out = np.zeros_like(x)
        for mask, low in zip(reversed(self.masks), reversed(self.lowest)):
            y = x & mask
            n = np.bitwise_count(y)
            out = np.where(n == 0, low, np.where(n == 1, y, out))
        return out


class LinkFinder:
    """Links among the fingerprints of one bucket (``bit`` struck out, the rest of that segment equal)."""

    def __init__(self, max_bits: int):
        self.k = max_bits
        parts = max(1, -(-(max_bits + 1) // 2))
        self.segments = cuts(0, 64, parts)
        self.top = Cut([_mask(*s) for s in self.segments])
        self.below = []
        for s in self.segments:
            rest = [b for b in range(64) if not s[0] <= b < s[1]] or list(range(64))
            self.below.append(Cut([sum(1 << b for b in rest[lo:hi]) for lo, hi in cuts(0, len(rest), parts)]))

    def linked(self, x: np.ndarray, bits: tuple) -> np.ndarray:
        """Whether xors are links that first meet in this variant, and below it in that one."""
        ok = np.bitwise_count(x) <= self.k
        for cut, bit in bits:
            ok &= cut.meets(x) == bit
        return ok

    def bucket(self, f: np.ndarray, p: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links that join what is connected within a bucket of distinct fingerprints."""
        bit = np.uint64(1 << p)
        at = ((self.top, bit),)
        if len(f) <= BUCKET_SCAN:
            yield from self._forest(f, at)
            return
        below = self.below[next(i for i, (lo, hi) in enumerate(self.segments) if lo <= p < hi)]
        for sub_bit, rest in below.variants:
            v = f & rest
            order = np.argsort(v, kind="stable")
            v = v[order]
            starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            sizes = np.diff(np.r_[starts, len(v)])
            for s, n in zip(starts[sizes > 1], sizes[sizes > 1]):
                yield from self._forest(f[order[s:s + n]], (*at, (below, sub_bit)))

    def _forest(self, f: np.ndarray, at: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Breadth-first: each fingerprint that is reached gives one link to the one it was reached from."""
        rest = f
        while len(rest) > 1:
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                u = queue.pop()
                hit = self.linked(rest ^ u, at)
                if hit.any():
                    near, rest = rest[hit], rest[~hit]
                    yield np.full(len(near), u), near
                    queue.extend(near)


def _small_buckets(finder: LinkFinder, p: np.ndarray, f: np.ndarray, start: np.ndarray, size: np.ndarray):
    """Pairs of many small buckets at once: by their distance in the sorted rows."""
    rows = np.repeat(size, size)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
    index = np.repeat(start, size) + place
    bit = np.left_shift(np.uint64(1), p[index].astype(np.uint64))
    for lag in range(1, int(size.max())):
        can = np.flatnonzero(place + lag < rows)
        a, b = f[index[can]], f[index[can] + lag]
        x = a ^ b
        ok = np.bitwise_count(x) <= finder.k
        ok[ok] = finder.top.meets(x[ok]) == bit[can][ok]
        if ok.any():
            yield a[ok], b[ok]


def links(fingerprints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct fingerprints ``fp`` -> ``(a, b)``: links that keep connected what differs in <= max_bits bits."""
    finder = LinkFinder(max_bits)
    low, seg = F.lit(0), F.lit(_as_long(_mask(0, finder.segments[0][1])))
    for lo, hi in finder.segments[1:]:
        low = F.when(F.col("p") >= lo, F.lit(lo)).otherwise(low)
        seg = F.when(F.col("p") >= lo, F.lit(_as_long(_mask(lo, hi)))).otherwise(seg)
    variants = (fingerprints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
                .select("p", F.col("fp").bitwiseAND(seg).bitwiseAND(F.expr("~shiftleft(1L, p)")).alias("v"), "fp")
                .repartition("p", "v").sortWithinPartitions("p", "v"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pairs):
            for a, b in pairs:
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                                                 names=["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def closed(last: bool):
            """Links of the buckets that are complete; the rows of the open one stay held."""
            p, v, f = (np.concatenate(c) for c in zip(*held))
            new = np.r_[True, (p[1:] != p[:-1]) | (v[1:] != v[:-1])]
            start = np.flatnonzero(new)
            size = np.diff(np.r_[start, len(p)])
            keep = len(p) if last else start[-1]
            held[:] = [] if last else [(p[keep:], v[keep:], f[keep:])]
            if not last:
                start, size = start[:-1], size[:-1]
            small = (size > 1) & (size <= SMALL_BUCKET)
            if small.any():
                yield from out(_small_buckets(finder, p, f, start[small], size[small]))
            for s, n in zip(start[size > SMALL_BUCKET], size[size > SMALL_BUCKET]):
                yield from out(finder.bucket(f[s:s + n], int(p[s])))

        for batch in batches:
            if not batch.num_rows:
                continue
            p, v = (batch.column(c).to_numpy() for c in ("p", "v"))
            f = batch.column("fp").to_numpy().view(np.uint64)
            open_bucket = held and held[0][0][0] == p[-1] and held[0][1][0] == v[-1]
            held.append((p, v, f))
            if not open_bucket:  # else the whole batch belongs to the bucket that is held
                yield from closed(False)
        if held:
            yield from closed(True)

    return variants.mapInArrow(find, "a long, b long")


# ----------------------------------------------------------------- groups ---
def fingerprint_groups(fingerprints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fp)`` rows -> ``(fp, root, component_id)`` per distinct fingerprint.

    ``root``: the smallest linked fingerprint (a group's identity even without ids); ``component_id``:
    the smallest ``doc_id`` of the group.
    """
    distinct = materialise(fingerprints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(links(distinct.select("fp"), max_bits))
    rooted = materialise(
        distinct.join(roots, distinct["fp"] == roots["node"], "left")
        .select("fp", "least", F.coalesce("root", "fp").alias("root")), "fingerprint-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def hex16(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id, fingerprint, component_id``."""
    stamped = materialise(with_fingerprint(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"), "simhash")
    groups = fingerprint_groups(stamped, max_bits)
    return stamped.join(groups, "fp").select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group: its smallest ``doc_id`` (nulls last), then the smallest text.

    Same columns. Rows that cannot be told apart by id and text count as one.
    """
    fp, root, least = (free_name(docs, n) for n in ("__simhash_fp", "__simhash_root", "__simhash_id"))
    stamped = with_fingerprint(docs, shingle, fp)
    slim = materialise(stamped.select("doc_id", F.col(fp).alias("fp")), "simhash")
    groups = fingerprint_groups(slim, max_bits)
    kept = stamped.join(groups.select(F.col("fp").alias(fp), F.col("root").alias(root),
                                      F.col("component_id").alias(least)), fp)
    kept = kept.filter(F.col("doc_id").eqNullSafe(F.col(least)))
    # the smallest id is one row, but for repeated ids
    first = kept.groupBy(root).agg(F.min_by(F.struct(*(kept[c] for c in docs.columns)), F.struct(
        F.coalesce("text", F.lit("")), F.col("text").isNotNull())).alias("row"))
    return first.select("row.*")

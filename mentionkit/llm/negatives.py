"""Hard negatives by integer scores behind angular bounds.

Vectors are scaled to integers; a row's score for an anchor is their inner product. A few reference
directions are drawn from the rows, and every row keeps its angles to them and its norm. By the
triangle inequality on the sphere two vectors are at an angle of at least ``max |a_r - b_r|`` and at
most ``min(a_r + b_r, 2 pi - a_r - b_r)`` over the references; the cosines of both, times the norms and
widened for rounding, bound the score. A run of rows next to each other has intervals of angles and
norms. Only runs, then rows, whose bounds overlap a window still open for an anchor are scored.

Two searches use it: an anchor's positives (best rows of its label: one window, open upwards) and its
negatives (best rows of other labels in a window below each positive's score). Once a window holds
enough rows, the worst of them is its new lower end.

Scale. Rows are written once with their angles, each task's sorted so that runs are narrow. Anchors are
a set of queries against all rows: they are numbered, and blocks of ``BLOCK`` are broadcast in turn.
A block reads the table twice; a task returns a few rows a window, which one window function merges. Neither
a label nor an id that holds many rows matters: rows are never grouped by them.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; a
shorter vector counts as filled up with zeros. Scaled components saturate at 2^27. A row without id is
no anchor and follows the others on ties. "Other" rows are rows of another id. Repeated rows are rows like
any other: a repeated anchor is mined again. A vector of zeros scores zero. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mentionkit.llm.common import materialise
from mentionkit.llm.vectors import finite, float_exact, matrix, scaled
from mentionkit.operators.profile import global_ordinal

#: Reference directions.
REFERENCES = 16
#: Anchors that are broadcast at a time.
BLOCK = 4096
#: Rows that a task scores at a time, and rows of a run.
CHUNK, RUN = 2048, 32
#: Anchors that are scored at a time.
ANCHORS = 1024
#: By how much angles (radians) are widened, and scores (share of the norms' product, and points).
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-6
NO_ID = np.iinfo(np.int64).max
OPEN = 1 << 62


def norms_and_angles(x: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norm of every row and its angles to the reference directions (a right angle for zeros)."""
    x = x.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    unit = references / np.maximum(np.sqrt((references ** 2).sum(axis=1)), 1e-300)[:, None]
    cosine = (x @ unit.T) / np.maximum(norm, 1e-300)[:, None]
    return norm, np.where(norm[:, None] > 0, np.arccos(np.clip(cosine, -1, 1)), np.pi / 2)


def score_bounds(norm_low, norm_high, angle_low, angle_high, anchor_norm, anchor_angle) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible scores, rows by anchors, of rows known by intervals of norm and angles."""
    shape = (len(norm_low), len(anchor_norm))
    least, most = np.zeros(shape), np.full(shape, np.pi)
    for r in range(anchor_angle.shape[1]):
        a, low, high = anchor_angle[:, r], angle_low[:, r, None], angle_high[:, r, None]
        np.maximum(least, np.maximum(low - a, a - high), out=least)
        np.minimum(most, np.minimum(a + high, 2 * np.pi - a - low), out=most)
    best, worst = np.cos(np.clip(least - ANGLE_SLACK, 0, np.pi)), np.cos(np.clip(most + ANGLE_SLACK, 0, np.pi))
    low, high = norm_low[:, None], norm_high[:, None]
    slack = 1 + SCORE_SLACK * norm_high[:, None] * anchor_norm
    return (np.where(worst < 0, worst * high, worst * low) * anchor_norm - slack,
            np.where(best > 0, best * high, best * low) * anchor_norm + slack)


def scores(x: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products, rows by anchors."""
    kind = np.float64 if float_exact(x, anchors) else np.int64
    return (x.astype(kind) @ anchors.astype(kind).T).astype(np.int64)


class Best:
    """The best ``keep`` rows of each window of each anchor so far; ties go to the smaller id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, keep: int):
        self.low, self.high, self.keep = low, high, keep  # anchors by windows; an empty window has low > high
        self.slot = self.score = self.id = np.empty(0, np.int64)
        self.floor = low.copy()

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Per anchor the scores between which a row can still matter."""
        open_ = self.floor <= self.high
        return (np.where(open_, self.floor, OPEN).min(axis=1, initial=OPEN),
                np.where(open_, self.high, -OPEN).max(axis=1, initial=-OPEN))

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        windows = self.low.shape[1]
        slots, scored, found = [self.slot], [self.score], [self.id]
        for w in range(windows):
            into = (score >= self.floor[anchor, w]) & (score <= self.high[anchor, w])
            slots.append(anchor[into] * windows + w)
            scored.append(score[into])
            found.append(ids[into])
        slot, score, ids = map(np.concatenate, (slots, scored, found))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        begins = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.empty(0, np.int64)
        rank = np.arange(len(slot)) - np.repeat(begins, np.diff(np.r_[begins, len(slot)]))
        last = rank == self.keep - 1
        self.floor.ravel()[slot[last]] = score[last]
        own = rank < self.keep
        self.slot, self.score, self.id = slot[own], score[own], ids[own]


def search(rows: Iterator[tuple], anchors: dict[str, np.ndarray], best: Best, same_label: bool) -> int:
    """Put the rows that fit into ``best``; the number of exact scores it took.

    ``rows``: chunks of (id, label, integers, norm, angles). With ``same_label`` rows of the anchor's label
    and another id fit, else rows of another label.
    """
    scored = 0
    for ids, label, x, norm, angle in rows:
        starts = np.arange(0, len(ids), RUN)
        run = [f.reduceat(v, starts) for v in (norm, angle) for f in (np.minimum, np.maximum)] if len(ids) else None
        for at in range(0, len(anchors["id"]) if len(ids) else 0, ANCHORS):
            part = slice(at, at + ANCHORS)
            own = {k: v[part] for k, v in anchors.items()}
            low, high = (e[part] for e in best.ends())
            least, most = score_bounds(*run, own["norm"], own["angle"])
            overlap = (most >= low) & (least <= high)
            if not overlap.any():
                continue
            fits = np.repeat(overlap, np.diff(np.r_[starts, len(ids)]), axis=0)
            fits &= (label[:, None] == own["label"]) & (ids[:, None] != own["id"]) if same_label else label[:, None] != own["label"]
            rows_left = np.flatnonzero(fits.any(axis=1))
            fits = fits[rows_left]
            if 4 * overlap.sum() <= 3 * overlap.size:  # angles tell rows apart: row by row
                least, most = score_bounds(norm[rows_left], norm[rows_left], angle[rows_left], angle[rows_left], own["norm"], own["angle"])
                fits &= (most >= low) & (least <= high)
            if 8 * fits.sum() < fits.size:
                row, anchor = np.nonzero(fits)
                kind = np.float64 if float_exact(x, own["x"]) else np.int64
                got = np.einsum("ij,ij->i", x[rows_left[row]].astype(kind), own["x"][anchor].astype(kind)).astype(np.int64)
                scored += len(row)
                into = (got >= low[anchor]) & (got <= high[anchor])
                row, anchor, got = row[into], anchor[into], got[into]
            else:
                all_scores = scores(x[rows_left], own["x"])
                scored += all_scores.size
                row, anchor = np.nonzero(fits & (all_scores >= low) & (all_scores <= high))
                got = all_scores[row, anchor]
            best.add(anchor + at, got, ids[rows_left[row]])
    return scored


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            yield (part["vec_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False), part["label"].to_numpy(zero_copy_only=False),
                   matrix(part["x"], width), part["norm"].to_numpy(), matrix(part["angles"]))


def prepared(vectors: DataFrame, scale: int, column: str) -> tuple[DataFrame, int]:
    """``(vec_id, label, x, norm, angles)`` of the rows that take part, written; and the width of the widest vector."""
    spark = vectors.sparkSession
    rows = vectors.filter(F.col("label").isNotNull() & finite(column)).select(
        "vec_id", F.col("label").cast("long").alias("label"), scaled(column, scale).alias("x"))
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    drawn = rows.orderBy(F.xxhash64("vec_id", "x"), "vec_id", "x").select("x").limit(REFERENCES).collect()
    directions = np.zeros((max(1, len(drawn)), width))
    for i, r in enumerate(drawn):
        directions[i, :len(r.x)] = r.x
    shared = spark.sparkContext.broadcast(directions)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm, angles = norms_and_angles(matrix(batch["x"], width), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(norm), pa.array(list(angles), pa.list_(pa.float64())), pa.array(angles.argmin(axis=1), pa.int32())],
                names=["vec_id", "label", "x", "norm", "angles", "nearest"])

    measured = rows.mapInArrow(measure, "vec_id long, label long, x array<int>, norm double, angles array<double>, nearest int")
    return materialise(measured.sortWithinPartitions("nearest", F.array_min("angles")).drop("nearest"), "angles"), width


def _search_all(table: DataFrame, width: int, block: Broadcast, same_label: bool, keep: int) -> DataFrame:
    """``(anchor, win, id, score)``: each task's best rows of each window, merged."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, low, high = block.value
        best = Best(low, high, keep)
        search(_chunks(batches, width), anchors, best, same_label)
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.slot // low.shape[1]), pa.array((best.slot % low.shape[1]).astype(np.int32)),
             pa.array(best.id), pa.array(best.score)], names=["anchor", "win", "id", "score"])

    order = Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "id")
    return table.mapInArrow(find, "anchor long, win int, id long, score long").withColumn(
        "rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def hard_negatives(vectors: DataFrame, anchor_every: int = 100, positives: int = 5, keep: int = 5, least_percent: int = 80,
                   most_percent: int = 100, scale: int = 256, column: str = "embedding") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows whose id ``anchor_every`` divides. For each of an anchor's best ``positives``
    rows of its label: the best ``keep`` rows of other labels whose score is ``least_percent`` to
    ``most_percent`` of the positive's.
    """
    spark = vectors.sparkSession
    table, width = prepared(vectors, scale, column)
    numbered = materialise(global_ordinal(table.filter(F.col("vec_id") % anchor_every == 0), ["vec_id", "label", "x"]), "anchors")
    found = []
    for block in range(-(-numbered.count() // BLOCK)):
        rows = numbered.filter((F.col("ord") >= block * BLOCK) & (F.col("ord") < (block + 1) * BLOCK)).orderBy("ord").toArrow()
        table_rows = rows.combine_chunks().to_batches()
        ids, label, x, norm, angle = (np.concatenate(c) for c in zip(*_chunks(iter(table_rows), width)))
        anchors = {"id": ids, "label": label, "x": x, "norm": norm, "angle": angle}
        one = (len(ids), 1)
        first = spark.sparkContext.broadcast((anchors, np.full(one, -OPEN), np.full(one, OPEN)))
        good = _search_all(table, width, first, True, positives).orderBy("anchor", "rank").collect()  # BLOCK * positives rows
        low, high = np.ones((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)
        of: list[tuple] = []
        for r in good:
            ends = -(-least_percent * r.score // 100), most_percent * r.score // 100
            low[r.anchor, r["rank"] - 1], high[r.anchor, r["rank"] - 1] = ends
            of.append((r.anchor, r["rank"] - 1, int(ids[r.anchor]), None if r.id == NO_ID else r.id, r.score))
        if not of:
            continue
        second = spark.sparkContext.broadcast((anchors, low, high))
        pairs = spark.createDataFrame(of, "anchor long, win int, anchor_id long, positive_id long, positive_score long")
        bad = _search_all(table, width, second, False, keep)
        found.append(materialise(bad.join(F.broadcast(pairs), ["anchor", "win"]).select(
            "anchor_id", "positive_id", "rank", F.when(F.col("id") != NO_ID, F.col("id")).alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score")), "negatives"))
        first.destroy()
        second.destroy()
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out

"""K1 -- softmax boosting: one tree a class and round, grown from sums over (class, node, feature, bin).

Features are cut into quantile bins once. The binned rows are stored, many a row of the table, feature by
feature, with the margins they had at the last rewrite; of a feature that is mostly in one bin (counts are
mostly zero) only the other rows are kept. A level of a round is one pass: every task works out its rows'
margins and gradients, finds each row's node in each class's tree, and adds up first and second derivatives
by bin, over what is kept; the bin that is not kept has what its node's sums leave, and a right child what its
left sibling leaves of their parent. The driver adds the sums of the tasks, of which there are so many at most that these stay within ``SUMS_BYTES``, and takes the best splits. Second-order
gain, minimum child weight, gamma, row and column sampling as in gradient boosting libraries; leaves are
``-eta G / (H + l2)``. All rows are used; what a pass is given is the trees since the last rewrite.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionkit.session import scratch_path

#: Rows of one stored row (65536 at most), features of one partial sum, rounds between two rewrites of the margins.
ROWS, FEATURES, REFRESH = 4096, 256, 10
#: Rows whose bins are added up at a time.
CACHED = 512
#: Bytes of partial sums that a pass sends to the driver, at most; a task more than one sends no fewer than its own.
SUMS_BYTES = 48 << 20


@dataclass
class Settings:
    rounds: int = 100
    depth: int = 3
    eta: float = 0.1
    gamma: float = 0.0
    min_child_weight: float = 1.0
    l2: float = 1.0
    subsample: float = 1.0
    colsample: float = 1.0
    bins: int = 32
    seed: int = 0


@dataclass
class Tree:
    """A complete binary tree: of each inner node a feature (-1: all go left) and the last bin that goes left; leaves."""

    feature: np.ndarray
    bin: np.ndarray
    leaf: np.ndarray

    def nodes(self, bins: "np.ndarray | Block", depth: int) -> np.ndarray:
        """The number, within its level, of each row's node at a depth."""
        if isinstance(bins, Block):
            at = np.zeros(len(bins), np.uint16)
            for level in range(depth):
                right = np.zeros(len(bins), bool)
                for node in range(1 << level):
                    inner = (1 << level) - 1 + node
                    if (f := int(self.feature[inner])) >= 0:
                        right |= (at == node) & (bins.column(f) > int(self.bin[inner]))
                at = (at << 1) | right
            return at.astype(np.int64)
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for level in range(depth):
            inner = (1 << level) - 1 + at
            f = self.feature[inner]
            at = 2 * at + ((f >= 0) & (bins[rows, f] > self.bin[inner]))
        return at


@dataclass
class SoftmaxTrees:
    """``edges``: of each feature the upper ends of its bins but the last; ``rounds``: the trees, a list a round."""

    edges: list[np.ndarray]
    classes: int
    depth: int
    rounds: list[list[Tree]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.zeros((len(x), 0), np.uint8)
        return np.stack([np.searchsorted(e, x[:, f]).astype(np.uint8) for f, e in enumerate(self.edges)], axis=1)

    def margins(self, bins: "np.ndarray | Block", first: int = 0) -> np.ndarray:
        out = np.zeros((len(bins), self.classes))
        for trees in self.rounds[first:]:
            for c, t in enumerate(trees):
                out[:, c] += t.leaf[t.nodes(bins, self.depth)]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.margins(self.bins(x)))

    def to_json(self) -> str:
        return json.dumps({"edges": [e.tolist() for e in self.edges], "classes": self.classes, "depth": self.depth, "rounds": [
            [[t.feature.tolist(), t.bin.tolist(), t.leaf.tolist()] for t in trees] for trees in self.rounds]})

    @staticmethod
    def from_json(text: str) -> "SoftmaxTrees":
        d = json.loads(text)
        return SoftmaxTrees([np.array(e) for e in d["edges"]], d["classes"], d["depth"], [
            [Tree(np.array(f, np.int64), np.array(b, np.int64), np.array(v)) for f, b, v in trees] for trees in d["rounds"]])


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def derivatives(margins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss by class."""
    p = softmax(margins)
    g = p.copy()
    g[np.arange(len(label)), label] -= 1
    return g, np.maximum(2 * p * (1 - p), 1e-16)


def best_split(g: np.ndarray, h: np.ndarray, allowed: np.ndarray, s: Settings) -> tuple[float, int, int, float, float]:
    """Of sums by (feature, bin): gain, feature, bin, and the left side's sums; gain 0 and feature -1 where none pays."""
    total_g, total_h = g[0].sum(), h[0].sum()
    left_g, left_h = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
    right_g, right_h = total_g - left_g, total_h - left_h
    gain = (left_g ** 2 / (left_h + s.l2) + right_g ** 2 / (right_h + s.l2) - total_g ** 2 / (total_h + s.l2)) / 2 - s.gamma
    # rounded, so that equal splits tie whatever the order of summation was; the smaller feature and bin wins
    least = s.min_child_weight - 1e-9       # a sum that is as large but for its rounding will do
    gain = np.where((left_h >= least) & (right_h >= least) & allowed[:, None], gain, -np.inf).round(9)
    if not gain.size or gain.max() <= 1e-9:
        return 0.0, -1, 0, 0.0, 0.0
    f, b = np.unravel_index(gain.argmax(), gain.shape)
    return float(gain[f, b]), int(f), int(b), float(left_g[f, b]), float(left_h[f, b])


def quantile_edges(rows: DataFrame, column: str, bins: int) -> list[np.ndarray]:
    """Distinct quantiles of every place of the array column, from all rows: exact ones, of counted values.

    Tasks count the values of some rows at a time, so that a value that stands often is shuffled seldom.
    """
    shares = np.arange(1, bins) / bins

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                flat = part["x"].flatten()
                x = np.sort(flat.to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).T, axis=1)
                there = np.ones(x.shape, bool)
                if flat.null_count:         # sorted to the end, with the numbers that are none
                    nulls = flat.is_null().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).sum(axis=0)
                    there = np.arange(part.num_rows) < part.num_rows - nulls[:, None]
                first = there.copy()
                first[:, 1:] &= x[:, 1:] != x[:, :-1]
                values, ends = x[first], first.sum(axis=1).cumsum()
                place = np.flatnonzero(first.ravel())
                last = np.repeat(np.arange(len(x)) * part.num_rows + there.sum(axis=1), np.diff(ends, prepend=0))
                times = np.minimum(np.append(place[1:], x.size), last) - place
                cut = [(f, begin, end) for f, (begin, end) in enumerate(zip(np.r_[0, ends[:-1]], ends)) if end > begin]
                yield pa.RecordBatch.from_arrays([
                    pa.array([f for f, _, _ in cut], pa.int32()), pa.array([values[i:j].tobytes() for _, i, j in cut], pa.binary()),
                    pa.array([times[i:j].astype(np.int32).tobytes() for _, i, j in cut], pa.binary())], names=["f", "values", "times"])

    def cut(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        values = np.concatenate([np.frombuffer(v) for v in parts["values"]])
        times = np.concatenate([np.frombuffer(t, np.int32) for t in parts["times"]])
        order = np.argsort(values, kind="stable")
        ranks = times[order].cumsum()
        found = values[order][np.searchsorted(ranks, np.maximum(np.ceil(shares * ranks[-1]), 1))]
        return pd.DataFrame({"f": [int(key[0])], "q": [found.tolist()], "most": [float(values[order[-1]])]})

    counted = rows.select(F.col(column).alias("x")).mapInArrow(count, "f int, values binary, times binary")
    found = counted.groupBy("f").applyInPandas(cut, "f int, q array<double>, most double").collect()     # a row a feature
    return [np.array([q for q in sorted(set(r.q)) if q < r.most]) for r in sorted(found, key=lambda r: r.f)]


class Block:
    """Binned rows, feature by feature: all bins, or, where ``counts`` has a number of them, those beside the feature's usual bin."""

    def __init__(self, rows: int, edges_bins: tuple[np.ndarray, np.ndarray], stored: bytes):
        usual, base = edges_bins
        self.rows, self.usual, self.base = rows, usual, base
        width = len(usual)
        self.counts = np.frombuffer(stored, np.int32, width)
        self.all = np.flatnonzero(self.counts < 0)
        at = 4 * width
        self.dense = np.frombuffer(stored, np.uint8, len(self.all) * rows, at).reshape(-1, rows)
        at += self.dense.size
        own = np.maximum(self.counts, 0)
        self.ends = own.cumsum()
        entries = int(own.sum())
        self.row = np.frombuffer(stored[at:at + 2 * entries], np.uint16)
        self.bin = np.frombuffer(stored, np.uint8, entries, at + 2 * entries)
        self.number = np.cumsum(self.counts < 0) - 1

    def __len__(self) -> int:
        return self.rows

    @staticmethod
    def stored(bins: np.ndarray, usual: np.ndarray) -> bytes:
        other = bins.T != usual[:, None]
        counts = other.sum(axis=1).astype(np.int32)
        counts[3 * counts >= len(bins)] = -1         # an entry takes three bytes, a bin one
        feature, row = np.nonzero(other & (counts >= 0)[:, None])
        return b"".join((counts.tobytes(), np.ascontiguousarray(bins.T[counts < 0]).tobytes(),
                         row.astype(np.uint16).tobytes(), bins[row, feature].tobytes()))

    def column(self, f: int) -> np.ndarray:
        """The bins of a feature."""
        if self.counts[f] < 0:
            return self.dense[self.number[f]]
        out = np.full(self.rows, self.usual[f], np.uint8)
        own = slice(self.ends[f] - self.counts[f], self.ends[f])
        out[self.row[own]] = self.bin[own]
        return out

    def sums(self, rows: np.ndarray, slot: np.ndarray, slots: int, weights: list[np.ndarray]) -> list[np.ndarray]:
        """Sums of each of the ``weights`` by (slot of the row, cell; see ``Binned.base``), over what is kept of some ``rows``."""
        cells = int(self.base[-1])
        out = [np.zeros(slots * cells) for _ in weights]

        def add(at: np.ndarray, values: list[np.ndarray]) -> None:
            for o, v in zip(out, values):
                o += np.bincount(at, v, minlength=len(o))

        shift, first = slot * cells, self.base[self.all][:, None]
        for begin in range(0, len(rows) if len(self.all) else 0, CACHED):     # so many rows' cells stay in the processor's cache
            part = slice(begin, begin + CACHED)
            dense = self.dense[:, part] if len(rows) == self.rows else self.dense.take(rows[part], axis=1)
            add((dense + (first + shift[part])).ravel(), [np.broadcast_to(w[part], dense.shape).ravel() for w in weights])
        place = np.full(self.rows, -1)
        place[rows] = np.arange(len(rows))
        entry, row = self.bin + np.repeat(self.base[:-1], np.maximum(self.counts, 0)), place[self.row]
        if len(rows) < self.rows:
            entry, row = entry[row >= 0], row[row >= 0]
        add(entry + shift[row], [w[row] for w in weights])
        return out


@dataclass
class Binned:
    """Stored rows, to be read several times: ``table(block, n, label, bins, margins, *keys)``, ``edges`` of its bins."""

    table: DataFrame
    edges: list[np.ndarray]
    keys: list[str]

    @property
    def usual(self) -> np.ndarray:
        """Of each feature the bin that zero is in."""
        return np.array([np.searchsorted(e, 0.0) for e in self.edges], np.uint8)

    @property
    def base(self) -> np.ndarray:
        """The first cell of each feature, where cells are its bins one after the other, and the end of the last."""
        return np.cumsum([0, *(len(e) + 1 for e in self.edges)])


def binned(rows: DataFrame, edges: list[np.ndarray], keys: list[str] = []) -> Binned:
    """``rows(x array<double>, *keys)`` cut into bins and stored, with ``label`` where they have one."""
    spark = rows.sparkSession
    out = Binned(None, edges, keys)
    labelled, model, usual = "label" in rows.columns, SoftmaxTrees(edges, 0, 0), out.usual
    kinds = "".join(f", {k} array<{rows.schema[k].dataType.simpleString()}>" for k in keys)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n = part.num_rows
                x = part["x"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                label = part["label"].to_numpy().astype(np.int32).tobytes() if labelled else b""
                own = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays([part[k]])) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n], pa.int64()), pa.array([label]), pa.array([Block.stored(model.bins(x), usual)]), pa.array([b""]), *own],
                    names=["n", "label", "bins", "margins", *keys])

    cut = rows.select("x", *(["label"] if labelled else []), *keys).mapInArrow(store, f"n long, label binary, bins binary, margins binary{kinds}")
    out.table = _written(cut.select(F.monotonically_increasing_id().alias("block"), "*"))
    return out


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "boosting")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _allowed(s: Settings, number: int, c: int, width: int) -> np.ndarray:
    """The columns of a class's tree in a round."""
    keep = max(1, round(s.colsample * width))
    out = np.zeros(width, bool)
    out[np.random.default_rng([s.seed, number, c, 1]).permutation(width)[:keep]] = True
    return out


def _chosen(s: Settings, number: int, block: int, rows: int) -> np.ndarray:
    """The rows of a stored block that a round is grown on."""
    return np.random.default_rng([s.seed, number, block & 0xFFFFFFFF, block >> 32, 2]).random(rows) < s.subsample


def fit(rows: DataFrame | Binned, s: Settings = Settings(), classes: int = 3,
        after_round: Callable[[int, SoftmaxTrees], bool] | None = None, edges: list[np.ndarray] | None = None) -> SoftmaxTrees:
    """Boosted trees from ``rows(label int, x array<double>)``; ``after_round`` may end the fit by returning true.

    ``edges``: of ``quantile_edges``, worked out where they are not given. For several fits on the same rows, ``rows`` may be ``Binned``.
    Rows with a null label are left out; an empty table gives no trees and equal probabilities.
    """
    if not isinstance(rows, Binned):
        rows = rows.filter("label is not null").select("label", "x")
        edges = quantile_edges(rows, "x", s.bins) if edges is None else edges
        if not edges:
            return SoftmaxTrees(edges, classes, s.depth)
        rows = binned(rows, edges)
    model = SoftmaxTrees(rows.edges, classes, s.depth)
    width = len(model.edges)
    if not width:
        return model
    table = rows.table.select("block", "n", "label", "bins", "margins")

    def rewrite(df: DataFrame, trees: SoftmaxTrees) -> DataFrame:
        kind = (rows.usual, rows.base)

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r, _, _, margins in _blocks(batches, trees, kind):
                yield pa.RecordBatch.from_pylist([r | {"margins": margins.tobytes()}])
        return _written(df.mapInArrow(move, df.schema))

    recent = SoftmaxTrees([], classes, s.depth)    # the trees since the last rewrite
    for number in range(s.rounds):
        trees = [Tree(np.full((1 << s.depth) - 1, -1), np.zeros((1 << s.depth) - 1, np.int64), np.zeros(1 << s.depth)) for _ in range(classes)]
        allowed = [_allowed(s, number, c, width) for c in range(classes)]
        sums: dict[tuple[int, int], tuple[float, float]] = {}       # (class, node) -> G, H
        above = None
        for level in range(s.depth):
            found, above = _level(table, rows, recent, trees, level, number, allowed, s, classes, above)
            for (c, node), (feature, b, *sides) in found.items():
                inner = (1 << level) - 1 + node
                whole, left = sides
                trees[c].feature[inner], trees[c].bin[inner] = feature, b
                sums[c, 2 * inner + 1] = left if feature >= 0 else whole
                sums[c, 2 * inner + 2] = (whole[0] - left[0], whole[1] - left[1]) if feature >= 0 else (0.0, 0.0)
        for c, t in enumerate(trees):
            for leaf in range(1 << s.depth):
                g, h = sums.get((c, (1 << s.depth) - 1 + leaf), (0.0, 0.0))
                t.leaf[leaf] = -s.eta * g / (h + s.l2) if h + s.l2 > 0 else 0.0
        model.rounds.append(trees)
        recent.rounds.append(trees)
        if after_round is not None and after_round(number, model):
            break
        if len(recent.rounds) == REFRESH and number + 1 < s.rounds:
            table, recent = rewrite(table, recent), SoftmaxTrees([], classes, s.depth)
    return model


def _blocks(batches: Iterator[pa.RecordBatch], trees: SoftmaxTrees, kind: tuple[np.ndarray, np.ndarray]):
    """Stored rows, their labels and bins, and their margins with those of ``trees``."""
    for batch in batches:
        for r in batch.to_pylist():
            bins = Block(r["n"], kind, r["bins"])
            margins = trees.margins(bins)
            if r["margins"]:
                margins += np.frombuffer(r["margins"]).reshape(margins.shape)
            yield r, np.frombuffer(r["label"], np.int32), bins, margins


def _level(table, rows, recent, trees, level, number, allowed, s, classes, above) -> tuple[dict, np.ndarray]:
    """The best split of every (class, node) of a level that has rows: feature, bin, the node's sums, the left side's sums;
    and the level's sums by (class, derivative, node, cell). ``above``: these of the level before."""
    kind, nodes, step = (rows.usual, rows.base), 1 << level, FEATURES
    base, width = rows.base, len(rows.edges)
    cells, slots = int(base[-1]), max(1, nodes // 2)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((classes, 2, slots * cells))
        whole = np.zeros((classes, 2, nodes))
        for r, label, bins, margins in _blocks(batches, recent, kind):
            own = _chosen(s, number, r["block"], len(label))
            g, h = derivatives(margins, label)
            for c, t in enumerate(trees):
                node = t.nodes(bins, level)
                counted = own
                if level:       # left children of nodes that are split
                    split = t.feature[slots - 1:nodes - 1] >= 0
                    counted = own & (node % 2 == 0) & split[node >> 1]
                rs = np.flatnonzero(counted)
                found = bins.sums(rs, node[rs] >> 1, slots, [g[rs, c], h[rs, c]])
                for i, d in enumerate((g, h)):
                    sums[c, i] += found[i]
                    whole[c, i] += np.bincount(node[own], d[own, c], minlength=nodes)
        sums = sums.reshape(classes, 2, slots, cells)
        if whole.any():
            for at in range(0, width, step):
                part = sums[..., base[at]:base[min(at + step, width)]]
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([part.tobytes()]), pa.array([whole.tobytes()])],
                                                 names=["at", "sums", "whole"])

    left, whole = np.zeros((classes, 2, slots, cells)), np.zeros((classes, 2, nodes))
    got = table.coalesce(max(1, SUMS_BYTES // left.nbytes)).mapInArrow(add, "at int, sums binary, whole binary").toArrow()
    for at, part, own in zip(got.column("at").to_pylist(), got.column("sums"), got.column("whole")):
        left[..., base[at]:base[min(at + step, width)]] += np.frombuffer(part.as_buffer()).reshape(classes, 2, slots, -1)
        if not at:
            whole += np.frombuffer(own.as_buffer()).reshape(whole.shape)
    split = np.array([t.feature[slots - 1:nodes - 1] >= 0 for t in trees]) if level else np.ones((classes, 1), bool)
    # the rows of a feature's usual bin that are not kept
    left[..., base[:-1] + rows.usual] += (whole[..., ::2] * split[:, None])[..., None] - np.add.reduceat(left, base[:-1], axis=3)
    sums = left if not level else np.stack([left, above - left], axis=3).reshape(classes, 2, nodes, cells)
    length = np.diff(base)
    feature, place = np.repeat(np.arange(width), length), np.arange(cells) - np.repeat(base[:-1], length)
    found: dict = {}
    for c in range(classes):
        for node in range(nodes):
            if whole[c, 1, node]:
                best = (0.0, -1, 0, 0.0, 0.0)
                if split[c, node >> 1]:         # else its rows are its parent's, which no split pays for
                    g, h = np.zeros((2, width, length.max()))
                    g[feature, place], h[feature, place] = sums[c, :, node]
                    best = best_split(g, h, allowed[c], s)
                found[c, node] = best[1], best[2], tuple(whole[c, :, node].tolist()), best[3:]
    return found, sums


def predict(model: SoftmaxTrees, rows: DataFrame) -> DataFrame:
    """``(id, p_a, p_b, p_neither)`` of rows with ``id, x``, for three classes."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = part["x"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                p = shared.value.probabilities(x) if shared.value.edges else np.full((len(x), 3), 1 / 3)
                yield pa.RecordBatch.from_arrays([part["id"], *(pa.array(p[:, k]) for k in range(3))], names=["id", "p_a", "p_b", "p_neither"])

    return rows.select("id", "x").mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, p_a double, p_b double, p_neither double")


def probability(model: SoftmaxTrees, rows: DataFrame | Binned, keys: list[str], c: int = 1) -> DataFrame:
    """``(*keys, p)``: the probability of one class for rows with ``x``, or for stored ones with these keys."""
    if isinstance(rows, Binned):
        return _stored_probability(model, rows, keys, c)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = part["x"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                p = model.probabilities(x)[:, c] if model.edges else np.full(len(x), 1 / model.classes)
                yield pa.RecordBatch.from_arrays([*(part[k] for k in keys), pa.array(p)], names=[*keys, "p"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, "x").mapInArrow(score, f"{kinds}, p double")


def _stored_probability(model: SoftmaxTrees, rows: Binned, keys: list[str], c: int) -> DataFrame:
    kind, trees = (rows.usual, rows.base), SoftmaxTrees([], model.classes, model.depth, list(model.rounds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bins = Block(batch["n"][i].as_py(), kind, batch["bins"][i].as_py())
                p = softmax(trees.margins(bins))[:, c]
                yield pa.RecordBatch.from_arrays([*(batch[k][i].values for k in keys), pa.array(p)], names=[*keys, "p"])

    kinds = ", ".join(f"{k} {rows.table.schema[k].dataType.elementType.simpleString()}" for k in keys)
    return rows.table.select("n", "bins", *keys).mapInArrow(score, f"{kinds}, p double")

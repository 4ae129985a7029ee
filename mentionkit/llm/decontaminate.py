"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of all items are put into one automaton (one word = one symbol). A training document is
streamed through it word by word; the automaton state gives the longest suffix of the words read so
far that occurs in some item. Where that matching length reaches the window length, the last
``window`` words are an occurrence of an item window. Runs of hit words are the contaminated spans;
removal drops spans, or the whole document where its hit share reaches a coverage limit.

Scale: documents are scanned once and never shuffled. The benchmark is broadcast in blocks of at
most ``block_words`` words, and a task holds the automaton of one block at a time (a stated query set
against all rows, in blocks), so its memory is bounded whatever the benchmark's size; several blocks
are built anew for each Arrow batch. Nothing of the documents reaches the driver.

Defined results: null or empty texts have no words (0 words, not contaminated, text unchanged). An
item with no words has no window; one with fewer than ``window`` words is itself one window. Items
with a null id mark words but are not in the id lists or counts. Several texts under one item id are
one item. Repeated document rows each give a row. An empty benchmark contaminates nothing. Columns
other than those named are ignored by ``overlaps`` and kept as they are by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionkit.llm.common import bytes_to_points, python_rows, text_bytes

#: Words: A-Z lower-cased, everything in [\x00-\x2F\x3A-\x60\x7B-\x7F] separates.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256))

WINDOW = 10
#: Words of benchmark items in one automaton: at most 2 x this many states, some 100 MB in a task.
BLOCK_WORDS = 100_000
#: Share of hit words from which a whole document goes.
MAX_COVERAGE = 0.5


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        #: state -> items whose window ends there; the window is the state's string of `window` words
        self.items: dict[int, set] = {}
        #: state -> {length: items} of items shorter than a window
        self.short: dict[int, dict[int, set]] = {}
        for item, words in items:
            if len(words) >= window:
                for v in self._window_states(words):
                    self.items.setdefault(v, set()).add(item)
            elif words:
                v = 0
                for w in words:
                    v = self.next[v][w]
                self.short.setdefault(v, {}).setdefault(len(words), set()).add(item)
        self.least = min([window, *(n for s in self.short.values() for n in s)])

    def _extend(self, last: int, w: bytes) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        cur = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: bytes, q: int) -> int:
        new = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _window_states(self, words: list[bytes]) -> Iterator[int]:
        v = 0
        for j, w in enumerate(words):
            v = self.next[v][w]
            if j + 1 >= self.window:
                v = self.window_state(v)
                yield v

    def window_state(self, v: int) -> int:
        """The state that holds the last `window` words of a match of at least that length in v."""
        while self.length[self.link[v]] >= self.window:
            v = self.link[v]
        return v

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Runs [first, last + 1) of hit words, and the items with a window among them."""
        nxt, link, length, window, least = self.next, self.link, self.length, self.window, self.least
        runs: list[list[int]] = []
        found: set = set()
        v = matched = 0
        for j, w in enumerate(words):
            u = nxt[v].get(w)
            if u is None:
                while v and u is None:
                    v = link[v]
                    u = nxt[v].get(w)
                if u is None:
                    matched = 0
                    continue
                matched = length[v]
            v = u
            matched += 1
            if matched >= least:
                reach = 0
                if matched >= window:
                    reach = window
                    found |= self.items[self.window_state(v)]
                if self.short:
                    reach = max(reach, self._short_items(v, matched, found))
                if reach:
                    first = j + 1 - reach
                    while runs and runs[-1][1] >= first:
                        first = min(first, runs.pop()[0])
                    runs.append([first, j + 1])
        return [(a, b) for a, b in runs], found

    def _short_items(self, v: int, matched: int, found: set) -> int:
        """Adds the short items that end here; the longest one's words."""
        most = 0
        while v > 0:
            for n, items in self.short.get(v, {}).items():
                if n <= matched:
                    found |= items
                    most = max(most, n)
            v = self.link[v]
        return most


def _word_bounds(text: bytes) -> list[tuple[int, int]]:
    """Byte spans of the words."""
    plain, out, at = text.translate(_WORD_BYTES), [], 0
    for w in plain.split():
        at = plain.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


def point_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point spans of runs of words."""
    if not runs:
        return []
    bounds = _word_bounds(text)
    flat = bytes_to_points(text, [o for a, b in runs for o in (bounds[a][0], bounds[b - 1][1])])
    return list(zip(flat[::2], flat[1::2]))


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items in blocks of at most ``block_words`` words (one longer item is a block of its own)."""
    held: list[tuple[str | None, list[bytes]]] = []
    total = 0
    rows = (benchmark.select(F.col("item_id").cast("string").alias("item_id"), text_bytes().alias("text"))
            .distinct().toLocalIterator())
    for item, text in rows:
        words = words_of(bytes(text) if text is not None else None)
        if not words:
            continue
        if held and total + len(words) > block_words:
            yield held
            held, total = [], 0
        held.append((item, words))
        total += len(words)
    if held:
        yield held


def _united(runs: list[tuple[int, int]], more: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted([*runs, *more]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class _Matcher:
    """Hit runs and found items of the texts of an Arrow batch, against every block of items."""

    def __init__(self, blocks: list, window: int):
        self.blocks, self.window = blocks, window
        self.only = SuffixAutomaton(blocks[0].value, window) if len(blocks) == 1 else None

    def __call__(self, texts: pa.Array) -> list[tuple[int, list[tuple[int, int]], set]]:
        out: list[tuple[int, list[tuple[int, int]], set]] = []
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        for k, block in enumerate(self.blocks or [None]):
            sa = self.only or SuffixAutomaton(block.value if block else [], self.window)
            for i, (text,) in enumerate(python_rows([batch])):
                words = words_of(text)
                runs, found = sa.spans(words)
                if k == 0:
                    out.append((len(words), runs, found))
                elif runs:
                    out[i] = (out[i][0], _united(out[i][1], runs), out[i][2] | found)
        return out


def _blocks(docs: DataFrame, benchmark: DataFrame, block_words: int) -> list:
    sc = docs.sparkSession.sparkContext
    return [sc.broadcast(b) for b in item_blocks(benchmark, block_words)]


_SPANS_SQL = "array<struct<start:int,end:int>>"
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
             block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id, n_words, n_hit, items, runs, spans``.

    ``items``: ids of the items with an occurring window, sorted as strings. ``runs``: maximal runs of
    hit words [start, end) by word number; ``spans``: the same by code points of the text.
    """
    blocks = _blocks(docs, benchmark, block_words)
    slim = docs.select("doc_id", text_bytes().alias("text"))

    def scan(batches):
        match = _Matcher(blocks, window)
        as_list = lambda spans: [{"start": a, "end": b} for a, b in spans]
        for batch in batches:
            found = match(batch.column("text"))
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([sum(b - a for a, b in runs) for _, runs, _ in found], pa.int64()),
                pa.array([sorted(i for i in items if i is not None) for _, _, items in found], pa.list_(pa.string())),
                pa.array([as_list(runs) for _, runs, _ in found], _SPANS_ARROW),
                pa.array([as_list(point_spans(texts[i].as_py(), runs) if runs else [])
                          for i, (_, runs, _) in enumerate(found)], _SPANS_ARROW),
            ], names=["doc_id", "n_words", "n_hit", "items", "runs", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(
        scan, f"doc_id {kind}, n_words long, n_hit long, items array<string>, runs {_SPANS_SQL}, spans {_SPANS_SQL}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with the contaminated spans cut out of ``text``, same columns.

    Length limit: a match of ``window`` words or more (or a whole shorter item) is cut out. Coverage
    limit: a document whose hit words are at least ``max_coverage`` of its words goes altogether.
    Cutting joins the text before and after a span, so a second pass may find a window across the
    seam; a space is left there, and the pass is repeated in the task until none is found.
    """
    blocks = _blocks(docs, benchmark, block_words)
    as_bytes = docs.withColumn("text", text_bytes())

    def scan(batches):
        match = _Matcher(blocks, window)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at)
            found = match(texts)
            keep, clean = [], []
            for i, (n, runs, _) in enumerate(found):
                keep.append(not runs or sum(b - a for a, b in runs) < max_coverage * n)
                if keep[-1]:
                    clean.append(_cut_all(texts[i].as_py(), runs, match) if runs else texts[i].as_py())
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield kept.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return as_bytes.mapInArrow(scan, as_bytes.schema).withColumn("text", F.col("text").cast("string"))


def _cut_all(text: bytes, runs: list[tuple[int, int]], match: _Matcher) -> bytes:
    while runs:
        bounds = _word_bounds(text)
        parts, at = [], 0
        for a, b in runs:
            parts.append(text[at:bounds[a][0]])
            at = bounds[b - 1][1]
        text = b" ".join([*parts, text[at:]])
        _, runs, _ = match(pa.array([text], pa.binary()))[0]
    return text

"""Quality rules with suffix-array repetition.

Each text's words get a suffix array by prefix doubling. The longest common prefix of neighbouring
suffixes gives, for every word, the longest passage starting there that stands elsewhere in the text
too; those passages are the maximal repeated substrings (and their tails). Spans of repeats of at
least ``LEAST_REPEAT`` words are united. A text is rejected when the united spans cover more than
``MAX_COVERED`` percent of its words, or when its longest repeat is longer than ``MAX_REPEAT`` words.
Simple rules (too few words, repeated five-word windows) come from the same arrays.

Scale. One pass over the texts, nothing shuffled. A task sorts the suffixes of many short texts at
once (``PACK_WORDS``), with word numbers that differ between texts, so no match crosses texts; a longer
text is sorted by itself. Only words whose prefixes are still ambiguous are sorted again.

Defined results: a null or empty text has no words, all counts 0, and fails the simple rules (fewer
than ``MIN_WORDS``). Repeated rows each give a row. An empty table gives no rows. Other columns are
ignored. Lines are cut at ``\\n``; a line without words never counts as repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionkit.llm.common import arrow_out, python_rows, text_bytes

#: Words whose suffixes are sorted together; a longer text is sorted alone.
PACK_WORDS = 100_000
# ---- fixed by the contract ----
MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEATED_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
# -------------------------------
#: Shorter repeats (a license line that stands twice) do not count as repeated passages.
LEAST_REPEAT = 16
MAX_COVERED_PERCENT = 10
MAX_REPEAT = 50

_BLANK = b" \t\n\v\f\r"
_NO_CHAR = _BLANK + bytes(range(0x80, 0xC0))  # white space, and bytes inside a character


def suffix_order(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the sorted suffixes, and per level k the class of every place by its first 2**k words.

    ``ends``: for every place the end of its text. A suffix that ends sorts before one that goes on.
    """
    order = np.argsort(ids, kind="stable")
    new = np.r_[True, ids[order][1:] != ids[order][:-1]] if len(ids) else np.empty(0, bool)
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(ids)])
    rank = np.empty(len(ids), np.int32)
    rank[order] = np.repeat(first, size)
    levels = [rank.copy()]
    active = order[np.repeat(size > 1, size)]
    h = 1
    while len(active):
        at = active + h
        inside = at < ends[active]
        second = np.where(inside, rank[np.where(inside, at, 0)].astype(np.int64) + 1, 0)
        key = rank[active].astype(np.int64) * (len(ids) + 1) + second
        by = np.argsort(key, kind="stable")
        a, key = active[by], key[by]
        group = key // (len(ids) + 1)
        index = np.arange(len(a))
        old_first = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], index, 0))
        is_new = np.r_[True, key[1:] != key[:-1]]
        new_first = np.maximum.accumulate(np.where(is_new, index, 0))
        rank[a] = (group + new_first - old_first).astype(np.int32)
        levels.append(rank.copy())
        size = np.diff(np.r_[np.flatnonzero(is_new), len(a)])
        active = a[np.repeat(size > 1, size)]
        h *= 2
    places = np.empty(len(ids), np.int64)
    places[rank] = np.arange(len(ids))
    return places, levels


def common_prefixes(places: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix, in words, of every sorted suffix and the one before it (0 for the first)."""
    out = np.zeros(len(places), np.int64)
    if len(places) < 2:
        return out
    pair = np.flatnonzero(levels[0][places[1:]] == levels[0][places[:-1]]) + 1
    a, b = places[pair - 1], places[pair]
    length = np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        ok = (x < len(places)) & (y < len(places))
        ok[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        length += ok << k
    out[pair] = length
    return out


def longest_repeats(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For every place the length of the longest passage from there that starts at another place too."""
    places, levels = suffix_order(ids, ends)
    lcp = common_prefixes(places, levels)
    out = np.empty(len(ids), np.int64)
    out[places] = np.maximum(lcp, np.r_[lcp[1:], 0][:len(lcp)])
    return out


def covered(reach: np.ndarray) -> np.ndarray:
    """Which places lie in some [i, i + reach[i])."""
    n = len(reach)
    i = np.flatnonzero(reach)
    change = np.bincount(i, minlength=n + 1) - np.bincount(i + reach[i], minlength=n + 1)
    return np.cumsum(change[:n]) > 0


@dataclass
class Text:
    """The counts of a text that need no sorting, and its words as numbers."""

    key: tuple
    ids: list[int]
    distinct: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int


def read_text(key: tuple, text: bytes | None) -> Text:
    text = text or b""
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in text.split()]
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    return Text(key, ids, len(number), len(text.translate(None, _NO_CHAR)),
                len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)))


def measure(texts: list[Text], least: int = LEAST_REPEAT) -> Iterator[tuple]:
    """(key..., n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words, longest_repeat)."""
    sizes = np.array([len(t.ids) for t in texts])
    begin = np.cumsum(sizes) - sizes
    shift = np.cumsum([t.distinct for t in texts]) - [t.distinct for t in texts]
    ids = np.concatenate([np.array(t.ids, np.int64) + s for t, s in zip(texts, shift)])
    reach = longest_repeats(ids, np.repeat(begin + sizes, sizes))
    window = covered(np.where(reach >= REPEAT_WINDOW, REPEAT_WINDOW, 0))
    spans = covered(np.where(reach >= least, reach, 0))
    for t, a, n in zip(texts, begin, sizes):
        b = a + n
        yield (*t.key, int(n), t.word_chars, t.n_symbols, t.n_dup_lines, int(window[a:b].sum()),
               int(spans[a:b].sum()), int(reach[a:b].max(initial=0)))


def _packs(rows: Iterator[tuple]) -> Iterator[list[Text]]:
    held: list[Text] = []
    words = 0
    for *key, text in rows:
        t = read_text(tuple(key), text)
        if held and words + len(t.ids) > PACK_WORDS:
            yield held
            held, words = [], 0
        held.append(t)
        words += len(t.ids)
    if held:
        yield held


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"]


def repetition(docs: DataFrame, least: int = LEAST_REPEAT, max_covered_percent: int = MAX_COVERED_PERCENT,
               max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): the counts, ``base_failed`` and ``kept``."""
    slim = docs.select("doc_id", text_bytes().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field("doc_id"), *((c, pa.int64()) for c in _COUNTS)])
            yield from arrow_out((r for pack in _packs(python_rows([batch])) for r in measure(pack, least)), schema)

    counts = slim.mapInArrow(count, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    rejected = ((100 * F.col("n_covered_words") > max_covered_percent * F.col("n_words"))
                | (F.col("longest_repeat") > max_repeat))
    return counts.withColumn("base_failed", failed).withColumn("kept", ~(failed | rejected))

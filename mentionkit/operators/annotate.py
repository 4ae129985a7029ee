"""K5 -- annotate passages into the long ``words`` table; W5 sentence numbers.

The built-in annotator is rule based: a task splits passages into tokens by the
classes of their characters (``regexp_extract_all`` inside the row for other patterns) and adds up every running quantity (offset,
word rank, sentence, position in the sentence) over the tokens of some passages
at a time with numpy. The passage table is hash-partitioned and sorted on
``doc_id`` *before* that, so the text (not the many times larger token rows) is
what gets shuffled and sorted; the words come out in order.

A real parser enters as a plug-in through :func:`annotate_with_plugin`
(``mapInPandas`` over distinct passages, model loaded once per worker).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentionkit import schema as S
from mentionkit.operators.plugins import worker_model

WORD_COLUMNS = ["doc_id", "wi", "sent", "idx", "o", "lo", "nb", "pb", "word", "lemma",
                "upos", "xpos", "governor", "deprel"]


#: Estimated input bytes (Spark's, of compressed files) of one annotation task.
PARTITION_BYTES = 32 << 20


def _partitions(docs: DataFrame) -> int:
    """Tasks by the size of the input, not below the session's shuffle partitions.

    The exploded rows are several times the text, so the count is explicit and AQE does not merge the
    exchange into a few tasks. Where Spark has no size (it then assumes the largest) the session's count holds.
    """
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return least if size >= 1 << 62 else max(least, -(-size // PARTITION_BYTES))


def tokenize_words(passages: DataFrame, pattern: str = S.TOKEN_PATTERN, sentence_end: list[str] = S.SENTENCE_END,
                   places: DataFrame | None = None, lemmas: DataFrame | None = None, sized: bool = False,
                   only: Callable[[pa.Array], np.ndarray] | None = None, beginnings: DataFrame | None = None) -> DataFrame:
    """Words with offsets: ``(doc_id, wi, sent, idx, o, lo, nb, word)``.

    ``o``  0-based code-point offset of the word,
    ``lo`` end of the previous word (the word "covers" ``[lo, o+len)``),
    ``nb`` number of non-blank characters before the word,
    ``pb`` number of fixed-width word pieces before the word.

    With ``places(doc_id, off, reach)`` only words near a place are handed on: those up to ``reach`` words
    from the word that covers ``off``, and the sentences of that word and of ``REPAIR`` words on each side;
    ``beside`` tells the words at most ``REPAIR`` from a covering one, which is all that alignment reads.
    With ``lemmas(doc_id, lemma)`` only words of these lemmas of their passage are. ``sized`` adds the
    passage's words ``n_words`` and rows ``n_rows``. ``only`` tells which words a task is to hand on, by their text.
    With ``beginnings(doc_id, piece)`` only words whose first ``PIECE_WIDTH`` characters are one of their passage's,
    whatever the case, are.
    """
    docs = passages.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.repartition(_partitions(docs), "doc_id")
    ranges = word_characters(docs.sparkSession) if pattern == S.TOKEN_PATTERN and lemmas is None else None
    toks, columns = F.regexp_extract_all(F.col("text"), F.lit(pattern), 0), []
    if places is not None:
        own = places.groupBy("doc_id").agg(F.collect_list(F.struct(
            F.col("off").cast("int").alias("off"), F.col("reach").cast("int").alias("reach"))).alias("p"))
        # merged, as a table of every passage with a place is no broadcast
        docs = docs.join(own.select("doc_id", F.col("p.off").alias("off"), F.col("p.reach").alias("reach")).hint("merge"),
                         "doc_id")
        columns = ["off", "reach"]
    if lemmas is not None:
        own = lemmas.groupBy("doc_id").agg(F.collect_set("lemma").alias("wanted"))
        docs = docs.join(own.hint("merge"), "doc_id")
        columns += ["wanted", F.transform(toks, F.lower).alias("lemmas")]
    if beginnings is not None:
        own = beginnings.groupBy("doc_id").agg(F.collect_set("piece").alias("begun"))
        docs = docs.join(own.hint("merge"), "doc_id")
        columns += ["begun"]
    # the rows of a passage's key stand together: the texts are sorted, not their tokens
    toks = docs.sortWithinPartitions("doc_id").select(
        "doc_id", (toks if ranges is None else F.col("text")).alias("toks"), *columns)
    more = "".join([", beside boolean" if places is not None else "", ", n_words int, n_rows int" if sized else ""])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                 # the last key's rows: it may go on in the next batch
        classes = None if ranges is None else _classes(ranges)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if classes is not None:
                table = table.set_column(1, "toks", _cut(batch["toks"], classes))
            table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
            first = _first_rows(table["doc_id"])
            yield from _placed(table.slice(0, first[-1]), first[:-1], sentence_end, sized, only)
            held = table.slice(first[-1])
        if held is not None and held.num_rows:
            yield from _placed(held, np.zeros(1, np.int64), sentence_end, sized, only)

    return toks.mapInArrow(run, f"doc_id {kind}, wi int, sent int, idx int, o int, lo int, nb int, pb int, word string{more}")


#: Words on each side of the covering word that alignment may move a target to.
REPAIR = 2
#: Tokens that a task works on at a time (but for a longer passage), and word rows that it hands on at a time.
TOKENS, HANDED = 200_000, 50_000


def _first_rows(keys: pa.ChunkedArray) -> np.ndarray:
    """The row at which each run of equal keys begins (nulls are equal); none of an empty column is row 0."""
    k = keys.combine_chunks() if keys.num_chunks != 1 else keys.chunk(0)
    if len(k) < 2:
        return np.zeros(1, np.int64)
    here, before = k.slice(1), k.slice(0, len(k) - 1)
    other = pc.fill_null(pc.not_equal(here, before), False)
    other = pc.or_(other, pc.xor(pc.is_null(here), pc.is_null(before)))
    return np.concatenate([[0], np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1])


def _placed(table: pa.Table, first: np.ndarray, ends: list[str], sized: bool = False,
            only: Callable[[pa.Array], np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """The word rows of whole passages; ``first``: the row at which each begins."""
    if not table.num_rows:
        return
    sizes = pc.fill_null(pc.list_value_length(table["toks"]), 0).to_numpy().astype(np.int64)
    sums = np.add.reduceat(sizes, first).cumsum()
    bounds, g = [*first, table.num_rows], 0
    while g < len(first):
        to = max(g + 1, int(np.searchsorted(sums, (sums[g - 1] if g else 0) + TOKENS, side="right")))
        rows = slice(bounds[g], bounds[to])
        part = table.slice(rows.start, rows.stop - rows.start).combine_chunks()
        out = _words_of(part, sizes[rows], first[g:to] - rows.start, ends, sized, only)
        for at in range(0, out.num_rows, HANDED):
            yield out.slice(at, HANDED)
        g = to


def _words_of(part: pa.Table, sizes: np.ndarray, first: np.ndarray, ends: list[str], sized: bool = False,
              only: Callable[[pa.Array], np.ndarray] | None = None) -> pa.RecordBatch:
    """Words and running quantities of some passages, whose tokens lie one passage after the other.

    Rows of one key are one passage, their tokens in turn (all first ones, then all second ones).
    """
    tok = part["toks"].chunk(0).flatten()
    lemma = part["lemmas"].chunk(0).flatten() if "lemmas" in part.column_names else None
    group_of_row = np.searchsorted(first, np.arange(len(sizes)), side="right") - 1
    group = np.repeat(group_of_row, sizes)
    if len(first) < len(sizes):
        pos = np.arange(len(group)) - np.repeat(sizes.cumsum() - sizes, sizes)
        order = np.lexsort((pos, group))
        tok, group = tok.take(pa.array(order)), group[order]
        lemma = lemma if lemma is None else lemma.take(pa.array(order))
    start = np.searchsorted(group, np.arange(len(first)))       # each passage's first token

    def before(x: np.ndarray) -> np.ndarray:
        """The sum of the passage's earlier values."""
        c = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        return c[:-1] - c[start[group]]

    length = pc.utf8_length(tok).to_numpy(zero_copy_only=False).astype(np.int64)
    word = ~_blank(tok)
    end = pc.is_in(tok, value_set=pa.array(ends, tok.type)).to_numpy(zero_copy_only=False)
    o, wi = before(length), before(word)
    blank = np.concatenate([[0], np.where(word, 0, length)[:-1]]) if len(tok) else np.zeros(0, np.int64)
    lo = o - np.where(np.arange(len(tok)) == start[group], 0, blank)
    nb, pb = before(np.where(word, length, 0)), before(np.where(word, -(-length // S.PIECE_WIDTH), 0))
    sent = before(end)

    o, wi, lo, nb, pb, sent, length, end, group = (x[word] for x in (o, wi, lo, nb, pb, sent, length, end, group))
    k = np.arange(len(wi))
    last = np.concatenate([[-1], np.maximum.accumulate(np.where(end, k, -1))[:-1]]) if len(k) else k
    idx = np.where(last >= k - wi, k - last, wi + 1)            # k - wi: the passage's first word
    keep, more = np.ones(len(k), bool), {}
    if "off" in part.column_names:
        keep, more["beside"] = _near(part, first, group, wi, sent, lo, o + length)
    if lemma is not None:
        keep = keep & _wanted(part, first, group, lemma.filter(pa.array(word)))
    strings = tok.filter(pa.array(word))
    if only is not None:
        keep = keep & only(strings)
    if "begun" in part.column_names:
        keep = keep & _wanted(part, first, group, _folded(pc.utf8_slice_codeunits(strings, 0, S.PIECE_WIDTH)), "begun", _folded)
    if sized:
        more["n_words"] = np.bincount(group, minlength=len(first))[group].astype(np.int32)
        more["n_rows"] = np.diff([*first, len(sizes)])[group].astype(np.int32)
    doc = part["doc_id"].chunk(0).take(pa.array(first[group[keep]]))
    return pa.RecordBatch.from_arrays(
        [doc, *(pa.array(x[keep].astype(np.int32)) for x in (wi, sent, idx, o, lo, nb, pb)),
         strings.filter(pa.array(keep)), *(pa.array(x[keep]) for x in more.values())],
        names=["doc_id", "wi", "sent", "idx", "o", "lo", "nb", "pb", "word", *more])


def _blank(tok: pa.Array) -> np.ndarray:
    """Which tokens begin with a blank (``schema.BLANK_START``)."""
    _, offsets, data = tok.buffers()
    at = np.frombuffer(offsets, np.int32, len(tok) + 1, 4 * tok.offset)
    if not len(tok) or at[-1] == at[0]:
        return np.zeros(len(tok), bool)
    own = np.frombuffer(data, np.uint8)
    return np.isin(own[np.minimum(at[:-1], len(own) - 1)], list(b" \t\r\n")) & (at[1:] > at[:-1])


def word_characters(spark: SparkSession) -> list[tuple[int, int]]:
    """The ranges of characters that the first part of ``schema.TOKEN_PATTERN`` takes, as Spark's own expression has it."""
    if not _ranges:
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        part = spark.createDataFrame([(every,)], "t string").select(F.regexp_extract_all(
            "t", F.lit(S.TOKEN_PATTERN.split("|")[0]), 0).alias("r"))
        _ranges.extend((ord(r[0]), ord(r[-1])) for r in part.first().r)
    return _ranges


_ranges: list[tuple[int, int]] = []


def _classes(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Of each character: 0 it stands alone, 1 part of a word, 2 a blank."""
    out = np.zeros(0x110000, np.uint8)
    for first, last in ranges:
        out[first:last + 1] = 1
    out[0xD800:0xE000] = 0
    out[list(b" \t\r\n")] = 2
    return out


def _cut(texts: pa.Array, classes: np.ndarray) -> pa.ListArray:
    """The tokens of each text (``schema.TOKEN_PATTERN``): runs of a class, and characters that stand alone."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:                     # bytes that are no characters, as the JVM reads them
        texts = pa.array([t.decode(errors="replace") for t in texts.cast(pa.binary()).to_pylist()], pa.string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    if not len(data):
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.string()))
    begins = np.arange(len(data))               # each character's first byte
    if data.max() < 128:
        kind = classes[data]
    else:
        begins = np.flatnonzero((data & 0xC0) != 0x80)
        kind = classes[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)]
    new = kind == 0
    new[1:] |= kind[1:] != kind[:-1]
    new[np.searchsorted(begins, at[:-1][at[:-1] < len(data)])] = True
    first = begins[new]
    tokens = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(first, len(data)).astype(np.int32)), pa.py_buffer(data.tobytes()))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, at).astype(np.int32)), tokens)


def _folded(words: pa.Array) -> pa.Array:
    """The words without regard to case."""
    coded = words.dictionary_encode()
    return pa.array([w.casefold() for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def _wanted(part: pa.Table, first: np.ndarray, group: np.ndarray, lemma: pa.Array, column: str = "wanted",
            read: Callable[[pa.Array], pa.Array] = lambda asked: asked) -> np.ndarray:
    """Which words have a lemma (or what else is in ``column``) that their passage asks for."""
    own = part.select([column]).take(pa.array(first)).combine_chunks()[column].chunk(0)
    of = np.repeat(np.arange(len(first)), pc.list_value_length(own).to_numpy())
    asked = read(own.flatten())
    distinct = pc.unique(asked)
    number = lambda x: pc.fill_null(pc.index_in(x, distinct), len(distinct)).to_numpy().astype(np.int64)
    width = len(distinct) + 1
    place, code = np.asarray(group, np.int64) * width, number(lemma)
    return (code < len(distinct)) & np.isin(place + code, of * width + number(asked))


def _near(part: pa.Table, first: np.ndarray, group: np.ndarray, wi: np.ndarray, sent: np.ndarray,
          lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words lie near a place of their passage, and which beside a covering word (see ``tokenize_words``)."""
    n = len(wi)
    own = part.select(["off", "reach"]).take(pa.array(first)).combine_chunks()
    of = np.repeat(np.arange(len(first)), pc.list_value_length(own["off"]).to_numpy())
    off, reach = (own[c].chunk(0).flatten().to_numpy().astype(np.int64) for c in ("off", "reach"))
    if not n or not len(of):
        return np.zeros(n, bool), np.zeros(n, bool)
    # passages one after the other on one line: the first word that ends beyond the offset
    width = int(max(hi.max(), off.max(initial=0), -off.min(initial=0))) + 2
    at = np.searchsorted(group * (2 * width) + hi, of * (2 * width) + off, side="right")
    begin, stop = np.searchsorted(group, of), np.searchsorted(group, of, side="right")
    has = begin < stop
    at, begin, stop, reach = np.clip(at, begin, stop - 1)[has], begin[has], stop[has], reach[has]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.maximum(at - reach, begin), 1)
    np.add.at(step, np.minimum(at + reach + 1, stop), -1)
    keep = step.cumsum()[:n] > 0
    sentence = np.concatenate([[0], np.cumsum((np.diff(group) != 0) | (np.diff(sent) != 0))])
    wanted, beside = np.zeros(n, bool), np.zeros(n, bool)
    for d in range(-REPAIR, REPAIR + 1):
        own = np.clip(at + d, begin, stop - 1)
        wanted[sentence[own]] = beside[own] = True
    return keep | wanted[sentence] | beside, beside


def rule_tags(words: DataFrame, anchors: list[str] = S.ANCHORS_F + S.ANCHORS_M) -> DataFrame:
    """Synthetic tags and tree of the built-in annotator (pure column expressions)."""
    word = F.col("word")
    lemma = F.lower(word)
    by_len = F.element_at(F.array(*[F.lit(t) for t in ("NOUN", "VERB", "ADJ")]),
                          (F.length(word) % 3 + 1).cast("int"))
    upos = (F.when(lemma.isin(*anchors), "PRON")
            .when(word.rlike(S.NUM_PATTERN), "NUM")
            .when((F.length(word) == 1) & word.rlike(S.PUNCT_PATTERN), "PUNCT")
            .when(word.rlike(S.NAME_PATTERN), "PROPN")
            .otherwise(by_len))
    xpos_map = F.create_map(*[F.lit(x) for kv in S.XPOS_BY_UPOS.items() for x in kv])
    governor = (F.col("idx") / 2).cast("int")
    deprel = F.when(governor == 0, "root").otherwise(
        F.element_at(F.array(*[F.lit(d) for d in S.DEPREL_BY_IDX_MOD5]),
                     (F.col("idx") % 5 + 1).cast("int")))
    tagged = words.select("*", lemma.alias("lemma"), upos.alias("upos"),
                          governor.alias("governor"), deprel.alias("deprel"))
    return tagged.select(
        *[c for c in tagged.columns if c != "deprel"],
        F.when(F.col("lemma").isin(*S.POSSESSIVE), "PRP$")
         .otherwise(F.element_at(xpos_map, F.col("upos"))).alias("xpos"),
        "deprel").select(*WORD_COLUMNS)


def annotate(passages: DataFrame, anchors: list[str] = S.ANCHORS_F + S.ANCHORS_M) -> DataFrame:
    """K5 built-in: passages ``(doc_id, text)`` -> ``words``, in order inside a task."""
    return rule_tags(tokenize_words(passages), anchors)


def sentence_numbers(words: DataFrame) -> DataFrame:
    """W5 for words from any annotator: ``sent`` = running count of ``idx = 1`` (0-based)."""
    w = (Window.partitionBy("doc_id").orderBy("wi")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return words.withColumn("sent", (F.sum((F.col("idx") == 1).cast("int")).over(w) - 1).cast("int"))


def doc_sizes(words: DataFrame) -> DataFrame:
    """Number of words per passage."""
    return words.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_words"))


def sentence_bounds(words: DataFrame) -> DataFrame:
    """First and last word of each sentence."""
    return words.groupBy("doc_id", "sent").agg(
        F.min("wi").alias("s_first"), F.max("wi").alias("s_last"))


# ---------------------------------------------------------------------------
# Plug-in annotator (a real parser): mapInPandas over distinct texts.
# ---------------------------------------------------------------------------
PLUGIN_OUTPUT = ("th string, wi int, sent int, idx int, o int, lo int, nb int, pb int, word string, lemma string, "
                 "upos string, xpos string, governor int, deprel string")
#: Word rows that a task holds before it hands them on.
PLUGIN_ROWS = 10_000
_BLANKS = " \t\r\n"


def place_words(text: str, parsed: list[dict]) -> Iterator[tuple]:
    """A parser's words of one text as rows of ``words`` without the passage.

    ``wi`` and ``sent`` are counted, ``lo``, ``nb`` and ``pb`` follow from the offset ``o`` and the text:
    the end of what stands before the word's blanks, the non-blank characters and the pieces before it.
    """
    sent, at, nb, pb = -1, 0, 0, 0
    for wi, w in enumerate(parsed):
        o, word = int(w["o"]), w["word"]
        nb += sum(c not in _BLANKS for c in text[at:o]) if o >= at else -sum(c not in _BLANKS for c in text[o:at])
        at, lo = o, o
        while lo > 0 and text[lo - 1] in _BLANKS:
            lo -= 1
        sent += int(w["idx"]) == 1
        yield (wi, sent, int(w["idx"]), o, lo, nb, pb, word, w.get("lemma"), w.get("upos"), w.get("xpos"),
               int(w["governor"]), w.get("deprel"))
        pb += -(-len(word) // S.PIECE_WIDTH)


def annotate_with_plugin(passages: DataFrame, factory: Callable[[], Callable[[str], list[dict]]],
                         key: str = "default") -> DataFrame:
    """``words`` by a plug-in parser: ``factory()`` returns ``parse(text) -> [word dict]``.

    The parser is made once per Python worker. Each word dict carries ``idx, o, word, lemma, upos, xpos,
    governor, deprel`` (``idx``/``governor`` 1-based within the sentence, governor 0 = root, ``o`` the
    code-point offset). Each distinct text is parsed once, whatever passages hold it; the words come
    back to the passages by the text's hash.
    """
    get = worker_model(factory, key)
    own = passages.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.sha2("text", 256))
    distinct = own.select("th", "text").dropDuplicates(["th"])
    columns = [c.split()[0] for c in PLUGIN_OUTPUT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse, rows = get(), []
        for pdf in batches:
            for th, text in zip(pdf["th"], pdf["text"]):
                for row in place_words(text, parse(text)):
                    rows.append((th, *row))
                    if len(rows) >= PLUGIN_ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    words = distinct.mapInPandas(run, PLUGIN_OUTPUT)
    return own.select("doc_id", "th").distinct().join(words, "th").select(*WORD_COLUMNS)


def lemma_of_phrase(phrase: Column) -> Column:
    """Lemmas of a phrase under the built-in annotator, first sentence only (F4 input)."""
    toks = F.filter(F.regexp_extract_all(phrase, F.lit(S.TOKEN_PATTERN), 0),
                    lambda t: ~t.rlike(S.BLANK_START))
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.size(toks), F.lit(1))),
                    lambda i: F.get(toks, i - 1).isin(*S.SENTENCE_END))
    first_end = F.coalesce(F.get(ends, 0), F.size(toks))
    return F.transform(F.slice(toks, 1, first_end), lambda t: F.lower(t))

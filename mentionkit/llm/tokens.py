"""Token counts attributed to fields and sections by character offsets.

A whole document is encoded once. Token spans follow from the byte lengths of the tokens, section
limits are mapped from code points to the same axis, and both are ascending, so the interval join of
tokens and sections is two binary searches. A token that crosses a limit goes where ``rule`` says:

* ``first``: to the section that holds the token's first character;
* ``most``: to the section that holds most of the token, the earlier one of equals;
* ``split``: to every section in proportion to what it holds of the token.

What belongs to no section (separators of a template) is counted under the section ``REST``, so a
document's sections always add up to its tokens, under every rule.

Scale. One pass over the texts, nothing shuffled; a task holds one document's offsets. The broadcast
vocabulary is one file whose size is checked (``MAX_VOCABULARY_BYTES``).

Defined results: a null or empty text has no tokens; its sections count 0. White space of any length
is encoded as the vocabulary's pattern says (see ``encode``). A document without
sections has its REST row only. Sections with a null limit or a limit outside the text are cut to the
text (null start: 0, null end: the end); sections may be empty but not overlap (an error). Repeated
rows and section names each give their rows. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionkit.llm.common import CHUNK_ROWS, arrow_out, python_rows

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 64 << 20
REST = "rest"
RULES = ("first", "most", "split")
#: How this vocabulary cuts a text before merging (a fixed value that belongs to the file).
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


#: What the pattern's \\s matches (a fixed value: Unicode's White_Space).
SPACES = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: White space from this length on does not go through the encoder's pattern, which would overflow its stack.
LONG_SPACE = 20_000
_LONG_SPACE = re.compile(f"[{SPACES}]{{{LONG_SPACE},}}")


def encode(encoder: tiktoken.Encoding, text: str | None) -> list[int]:
    """The text's tokens, whatever the length of its white space.

    The pattern cuts a text at the begin of white space in any case, and again before the last character
    of white space that something follows (``\\s+(?!\\S)``; that character may belong to the next word).
    So what stands before, the run but its last character, and the rest can be encoded one by one and
    give the same tokens; the run is a single piece, which is merged without the pattern.
    """
    if not text:
        return []
    if len(text) < LONG_SPACE:
        return encoder.encode_ordinary(text)
    out, at = [], 0
    for m in _LONG_SPACE.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += encoder.encode_ordinary(text[at:m.start()])
        out += encoder._encode_single_piece(text[m.start():end].encode())
        at = end
    return out + encoder.encode_ordinary(text[at:])


class Vocabulary:
    """A byte-pair vocabulary; the encoder is built once in a Python worker."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks, self.pattern, self._built = ranks, pattern, None

    def __getstate__(self):
        return self.ranks, self.pattern

    def __setstate__(self, state):
        self.__init__(*state)

    def encoder(self) -> tuple[tiktoken.Encoding, np.ndarray]:
        """The encoder and the byte length of every token id."""
        if self._built is None:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
            size = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, i in ranks.items():
                size[i] = len(token)
            self._built = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}), size
        return self._built


def broadcast_vocabulary(spark: SparkSession, path: str | None = None, pattern: str = PATTERN):
    """The vocabulary file, read by the driver and sent to the executors.

    Without ``path``: the file that the session names in ``mentionkit.vocabulary``, else ``VOCABULARY``.
    """
    path = path or spark.conf.get("mentionkit.vocabulary", VOCABULARY)
    with open(path, "rb") as file:
        ranks = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(ranks) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(Vocabulary(ranks, pattern))


def _points_to_bytes(text: str, data: bytes, points: np.ndarray) -> np.ndarray:
    if len(text) == len(data):
        return points
    first = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return np.r_[first, len(data)][points]


def attribute(text: str, sections: list[tuple[int, int]], encoder: tiktoken.Encoding, size: np.ndarray,
              rule: str = "most") -> tuple[int, np.ndarray, np.ndarray]:
    """Tokens of the text; per section (ascending, disjoint) its tokens and the crossing ones it holds part of."""
    data = text.encode()
    ends = np.cumsum(size[np.array(encode(encoder, text), np.int64)])
    starts = np.r_[0, ends[:-1]]
    tokens, crossing = np.zeros(len(sections)), np.zeros(len(sections), np.int64)
    if not len(ends) or not sections:
        return len(ends), tokens, crossing
    limits = _points_to_bytes(text, data, np.array(sections, np.int64))
    full = np.flatnonzero(limits[:, 1] > limits[:, 0])
    low, high = limits[full].T
    if not len(full):
        return len(ends), tokens, crossing
    # the sections that a token meets are first..last
    first = np.searchsorted(high, starts, side="right")
    last = np.searchsorted(low, ends, side="left") - 1
    at = np.minimum(first, len(full) - 1)
    inside = (first == last) & (low[at] <= starts) & (ends <= high[at])
    tokens[full] += np.bincount(first[inside], minlength=len(full))
    for t in np.flatnonzero(~inside & (first <= last)):
        met = np.arange(first[t], last[t] + 1)
        held = np.minimum(high[met], ends[t]) - np.maximum(low[met], starts[t])
        crossing[full[met]] += 1
        whole = ends[t] - starts[t]
        if rule == "split":
            tokens[full[met]] += held / whole
        elif rule == "first":
            if low[met[0]] <= starts[t]:
                tokens[full[met[0]]] += 1
        else:
            # what no section holds competes as well: by its parts, so the earlier of equals is the earlier one
            gaps = np.r_[low[met], ends[t]] - np.r_[starts[t], high[met]]
            best = int(held.argmax())
            gap = int(gaps.argmax())
            if gaps[gap] < held[best] or gaps[gap] == held[best] and best < gap:
                tokens[full[met[best]]] += 1
    return len(ends), tokens, crossing


def token_counts(docs: DataFrame, vocabulary, rule: str = "most") -> DataFrame:
    """``(doc_id, text, sections)`` -> ``doc_id, section, part, start, end, tokens, crossing``.

    ``sections``: array<struct<section string, part int, start int, end int>>, code points, end
    exclusive. A REST row closes every document (``start`` null, ``end`` the length of the text).
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size = vocabulary.value.encoder()
        out = None
        for batch in batches:
            out = out or pa.schema([("doc_id", batch.schema.field("doc_id").type), ("section", pa.string()),
                                    ("part", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                                    ("tokens", pa.float64()), ("crossing", pa.int64())])
            yield from arrow_out(rows([batch], encoder, size), out)

    def rows(batches, encoder, size):
        for doc, text, sections in python_rows(batches):
            text, n = text or "", len(text or "")
            own = [(s["section"], s["part"], min(max(s["start"] or 0, 0), n),
                    n if s["end"] is None else min(max(s["end"], 0), n)) for s in sections or [] if s]
            own.sort(key=lambda s: s[2:])
            if any(b < a for _, _, a, b in own) or any(x[3] > y[2] for x, y in zip(own, own[1:])):
                raise ValueError(f"sections of document {doc} overlap or end before they start")
            total, tokens, crossing = attribute(text, [s[2:] for s in own], encoder, size, rule)
            for s, t, c in zip(own, tokens.tolist(), crossing.tolist()):
                yield doc, *s, t, c
            yield doc, REST, 0, None, n, total - float(tokens.sum()), 0

    return docs.select("doc_id", "text", "sections").mapInArrow(
        count, f"doc_id {kind}, section string, part int, start int, end int, tokens double, crossing long")


def lengths(docs: DataFrame, vocabulary, name: str = "length") -> DataFrame:
    """``docs`` with the number of tokens of ``text`` in column ``name``."""
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, _ = vocabulary.value.encoder()
        for texts in batches:
            n: list[int] = []
            for at in range(0, len(texts), CHUNK_ROWS):
                n += [len(encode(encoder, t)) for t in texts.slice(at, CHUNK_ROWS).to_pylist()]
            yield pa.array(n, pa.int64())

    return docs.withColumn(name, F.arrow_udf(count, "long", F.ArrowUDFType.SCALAR_ITER)(F.col("text")))


# ------------------------------------------------------- fields and lines ---
_SECTIONS = "array<struct<section:string,part:int,start:int,end:int>>"
_SECTIONS_ARROW = pa.list_(pa.struct([("section", pa.string()), ("part", pa.int32()), ("start", pa.int32()),
                                      ("end", pa.int32())]))


def with_fields_and_lines(docs: DataFrame, fields: list[str], body: str = "text", between: str = "\n") -> DataFrame:
    """``(doc_id, text, sections)``: one text of ``fields`` and then the ``body``, with ``between`` in between.

    Every field is a section; every line of the body, with its line end, is one and numbered from 0.
    Null columns count as empty.
    """
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in [*fields, body]]
    at, sections = F.lit(0), []
    for name, part in zip(fields, parts):
        sections.append(F.struct(F.lit(name).alias("section"), F.lit(0).alias("part"), at.alias("start"),
                                 (at + F.length(part)).alias("end")))
        at = at + F.length(part) + len(between)

    def lines(texts: pa.Array, begins: pa.Array) -> pa.Array:
        out = []
        for text, begin in zip(texts.to_pylist(), begins.to_pylist()):
            own, a = [], begin
            for i, line in enumerate(text.split("\n")):
                b = a + len(line) + 1
                own.append({"section": body, "part": i, "start": a, "end": b})
                a = b
            own[-1]["end"] -= 1
            out.append(own)
        return pa.array(out, _SECTIONS_ARROW)

    of_body = F.arrow_udf(lines, _SECTIONS, F.ArrowUDFType.SCALAR)(parts[-1], at)
    return docs.select("doc_id", F.concat_ws(between, *parts).alias("text"),
                       F.concat(F.array(*sections).cast(_SECTIONS), of_body).alias("sections"))

"""Secret scans with corpus-wide ownership frequency.

Base rules find assignments, access keys and long hex strings. The corpus method adds what no rule
sees in one text alone: every long mixed token is a candidate, and so is every value the base rules
found. Candidates are counted over the whole corpus by distinct owners and distinct repositories. A
value that many owners hold is a widely copied example; one that a single owner holds, and that looks
random, is a live-looking credential, in however many of its repositories it stands. Where a live-looking value also
stands outside any base span, that place becomes an ``owned`` span. Base spans always stay; their
values' verdicts are in ``verdicts``.

Scale. One pass over the texts writes a slim table (ids, spans, hashes of candidates; no text).
Counting is three partial aggregates (value and repository, then value and owner, then value), so a
value copied into a third of all rows shrinks in each map task before any shuffle. Verdicts return by
an equality join on the hash that Spark may split where one value is hot, and spans come together by
row, that is one text. ``redact`` moves the text only of rows that have a candidate.

Defined results: a null text is empty (no spans). A null owner is one owner of its own, and so is a
null repository. Repeated rows each give a row and count once as a repository; with ``distinct_text`` as
the repository, so do copies of a text under different ids. An empty table gives no
rows. Other columns are ignored by ``scan`` and kept by ``redact``. Texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionkit.llm.common import bytes_to_points, free_name, materialise, python_rows, text_bytes

# ---- fixed by the contract ----
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(
    rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST = 6
# a run that is long enough is found whole, so the least length stands in the pattern
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
# -------------------------------
#: A text without any of these, lower-cased, has no assignment.
KEYWORDS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]
#: Kind of the spans that the corpus method adds.
OWNED = "owned"
#: A candidate of the corpus method: a run of token characters this long, with letters and digits, ...
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
#: ... and at least this many bits of character entropy a character.
LEAST_ENTROPY = 3.0
#: A value that so many owners hold is a widely copied example.
EXAMPLE_OWNERS = 3

Span = tuple[int, int, bytes]


def base_spans(text: bytes) -> dict[str, list[Span]]:
    """Per kind the spans by bytes, each with the secret's value (an assignment's right side)."""
    low = text.lower()
    assign = ASSIGN.finditer(text) if any(k in low for k in KEYWORDS) else ()
    return {
        "assign": [(m.start(), m.end(), m[2]) for m in assign if len(m[2]) >= ASSIGN_LEAST],
        "access": [(m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)],
        "hex": [(m.start(), m.end(), m[0]) for m in HEX.finditer(text)]}


def looks_random(value: bytes) -> bool:
    """Letters, three digits or more, and characters of high entropy."""
    n, letters, digits, bits = len(value), False, 0, 0.0
    for x in set(value):
        c = value.count(x)
        bits -= c / n * math.log2(c / n)
        digits += c * (48 <= x <= 57)
        letters |= 65 <= x <= 90 or 97 <= x <= 122
    return letters and digits >= 3 and bits >= LEAST_ENTROPY


def loose_candidates(text: bytes, taken: list[Span]) -> list[Span]:
    """Candidates of the corpus method that touch no base span."""
    out, blocked, i = [], sorted((a, b) for a, b, _ in taken), 0
    ends = [b for _, b in blocked]
    for k in range(1, len(ends)):
        ends[k] = max(ends[k], ends[k - 1])
    for m in CANDIDATE.finditer(text):
        while i < len(ends) and ends[i] <= m.start():
            i += 1
        if (i == len(ends) or blocked[i][0] >= m.end()) and looks_random(m[0]):
            out.append((m.start(), m.end(), m[0]))
    return out


_FOUND_SQL = "array<struct<kind:string,start:int,end:int,value:binary,random:boolean>>"
_FOUND_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                   ("value", pa.binary()), ("random", pa.bool_())]))


def find_candidates(text: bytes | None) -> list[dict]:
    """Base spans and loose candidates of a text, by code points; ``value`` is a 128-bit hash of the value."""
    if not text:
        return []
    base = base_spans(text)
    spans = [(k, *s) for k in KINDS for s in base[k]]
    spans += [("loose", *s) for s in loose_candidates(text, [s[1:] for s in spans])]
    at = sorted({o for _, a, b, _ in spans for o in (a, b)})
    point = dict(zip(at, bytes_to_points(text, at)))
    return [{"kind": k, "start": point[a], "end": point[b], "random": looks_random(v),
             "value": hashlib.blake2b(v, digest_size=16).digest()} for k, a, b, v in spans]


def _find_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        yield pa.array([find_candidates(t) for (t,) in python_rows([batch])], _FOUND_ARROW)


def _found() -> Column:
    return F.arrow_udf(_find_batches, _FOUND_SQL, F.ArrowUDFType.SCALAR_ITER)(text_bytes())


# ----------------------------------------------------------------- corpus ---
def ownership(found: DataFrame) -> DataFrame:
    """``(value, owner, repo, random)`` rows -> per ``value`` its distinct ``owners`` and ``repos`` and the verdict.

    ``example``: held by EXAMPLE_OWNERS owners or more; ``live``: random-looking and one owner's, in however
    many of its repositories; ``unclear``: the rest.
    """
    by_repo = found.groupBy("value", "owner", "repo").agg(F.max("random").alias("random"))
    by_owner = by_repo.groupBy("value", "owner").agg(F.count("*").alias("repos"), F.max("random").alias("random"))
    counts = by_owner.groupBy("value").agg(
        F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.max("random").alias("random"))
    return counts.withColumn(
        "verdict", F.when(F.col("owners") >= EXAMPLE_OWNERS, "example")
        .when(F.col("random") & (F.col("owners") == 1), "live")
        .otherwise("unclear"))


_SPANS_SQL = "array<struct<start:int,rank:int,end:int,kind:string,verdict:string>>"


def _spans(rows: DataFrame) -> DataFrame:
    """``(row, owner, repo, found)`` -> ``(row, spans)`` for the rows that have spans."""
    each = rows.select("row", "owner", "repo", F.explode("found").alias("f")).select("row", "owner", "repo", "f.*")
    judged = each.select("row", "kind", "start", "end", "value").join(
        ownership(each).select("value", "verdict"), "value")
    judged = judged.filter((F.col("kind") != "loose") | (F.col("verdict") == "live"))
    kind = F.when(F.col("kind") == "loose", OWNED).otherwise(F.col("kind"))
    rank = F.array_position(F.array(*map(F.lit, [*KINDS, OWNED])), kind).cast("int")
    span = F.struct("start", rank.alias("rank"), "end", kind.alias("kind"), "verdict")
    return judged.groupBy("row").agg(F.array_sort(F.collect_list(span)).cast(_SPANS_SQL).alias("spans"))


def distinct_text() -> Column:
    """A repository for each different text: places that use a value, however often a text was copied."""
    return F.md5(text_bytes())


def _owner_columns(owner: str, repo: str | Column) -> list[Column]:
    repo = F.col(repo) if isinstance(repo, str) else repo
    return [F.col(owner).cast("string").alias("owner"), repo.cast("string").alias("repo")]


def scan(docs: DataFrame, owner: str = "source", repo: str | Column = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``doc_id`` and ``spans``, an array of (start, rank, end, kind, verdict).

    Spans are by start, then kind in the order assign, access, hex, owned (``rank``).
    """
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                                   *_owner_columns(owner, repo), _found().alias("found")), "secret-candidates")
    return rows.select("row", "doc_id").join(_spans(rows.filter(F.size("found") > 0)), "row", "left").select(
        "doc_id", F.coalesce("spans", F.expr(f"cast(array() as {_SPANS_SQL})")).alias("spans"))


def joined(spans: str | Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(spans: str | Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def redact(docs: DataFrame, owner: str = "source", repo: str | Column = "doc_id", mark: str = "[REDACTED]") -> DataFrame:
    """``docs``, same columns, with every base and owned span of ``text`` replaced by ``mark``."""
    secrets, row, spans_of = (free_name(docs, n) for n in ("__secrets", "__row", "__spans"))
    found = docs.withColumn(secrets, _found())
    clean = found.filter(F.size(secrets) == 0).drop(secrets)
    touched = materialise(found.filter(F.size(secrets) > 0).withColumn(row, F.monotonically_increasing_id()), "secret-rows")
    spans = _spans(touched.select(F.col(row).alias("row"), *_owner_columns(owner, repo), F.col(secrets).alias("found")))
    cut = F.arrow_udf(lambda texts, at: _replaced(texts, at, mark), "string", F.ArrowUDFType.SCALAR)
    redacted = (touched.join(spans.select(F.col("row").alias(row), F.col("spans").alias(spans_of)), row, "left")
                .withColumn("text", cut("text", F.transform(spans_of, lambda s: F.struct(s["start"], s["end"]))))
                .select(*docs.columns))
    return clean.unionByName(redacted)


def _replaced(texts: pa.Array, spans: pa.Array, mark: str) -> pa.Array:
    out = []
    for text, own in zip(texts.to_pylist(), spans.to_pylist()):
        if text is not None and own:
            parts, at = [], 0
            for s in sorted(own, key=lambda s: tuple(s.values())):
                a, b = s.values()
                if a >= at:
                    parts += [text[at:a], mark]
                at = max(at, b)
            text = "".join([*parts, text[at:]])
        out.append(text)
    return pa.array(out, pa.string())

"""Fill-in-the-middle: cuts texts into prefix, middle and suffix at line ends and writes them in another order.

Content-defined chunk memoization: a rolling hash over 16 bytes ends a chunk wherever it meets a pattern, so equal
stretches of different texts fall into equal chunks, whatever stands before them. A Python worker keeps a boundary
summary for each chunk it has met: line ends, code points, first and last bytes, and whether a marker stands inside.
The cache is looked up by the chunk's bytes themselves, so a summary is only used again for equal content; its size is
bounded, and it saves work without deciding anything. Adding the summaries up gives a text's number of lines and tells
whether it contains a marker (one that lies across two chunks shows in their first and last bytes); the running sums
lead to the chunk that holds a cut, and only that chunk is looked into.

Null texts are empty. Empty texts, and texts with a marker of their own, stay plain. A null id is hashed as an empty
string. Each row is a text of its own: equal rows get equal results. Extra columns are not read, and a table without
rows gives none.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import bounded_batches, query, table

# The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))

WINDOW = 16
CHUNK_BITS = 10  # a chunk ends after one in 2 ** CHUNK_BITS bytes
LONGEST = 1 << 14
SECTION = 1 << 20  # bytes that are hashed at a time
CACHE_BYTES = 1 << 25
FOLLOWING = bytes(range(0x80, 0xC0))  # bytes within a code point

_MIX = np.uint32(0x9E3779B1)
_POWERS = [np.uint32(pow(0x9E3779B1, k, 1 << 32)) for k in (1, 2, 4, 8)]


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """For each byte the hash of the WINDOW bytes that end there; the first WINDOW - 1 stand for fewer."""
    out = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B)
    out ^= out >> np.uint32(15)
    for reach, power in zip((1, 2, 4, 8), _POWERS):
        longer = out.copy()
        longer[reach:] += out[:-reach] * power
        out = longer
    return out * _MIX


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of a text end."""
    ends: list[np.ndarray] = []
    view = np.frombuffer(data, dtype=np.uint8)
    for start in range(0, len(data), SECTION):
        lead = min(start, WINDOW - 1)
        found = rolling_hash(view[start - lead:start + SECTION])[lead:] >> np.uint32(32 - CHUNK_BITS) == 0
        ends.append(np.flatnonzero(found) + start + 1)
    at = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    at = np.append(at[(at >= WINDOW) & (at < len(data))], len(data)) if len(data) else at
    gaps = np.diff(np.append(0, at))
    if not (gaps > LONGEST).any():
        return at.tolist()
    return list(itertools.chain.from_iterable([*range(int(end - gap) + LONGEST, int(end), LONGEST), int(end)] for end, gap in zip(at, gaps)))


Summary = tuple[int, int, bytes, bytes, bool]


def summary_of(chunk: bytes) -> Summary:
    """Line ends, code points, first two bytes, last two bytes, and whether a marker stands inside."""
    return chunk.count(b"\n"), len(chunk.translate(None, FOLLOWING)), chunk[:2], chunk[-2:], b"<" in chunk and any(m in chunk for m in MARKERS)


class Chunks:
    """Summaries of the chunks that a Python worker has met."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.known: dict[bytes, Summary] = {}
        self.limit, self.size = limit, 0

    def summary(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)
        if found is None:
            if self.size > self.limit:
                self.known, self.size = {}, 0
            found = self.known[chunk] = summary_of(chunk)
            self.size += len(chunk)
        return found

    def outline(self, data: bytes) -> Outline:
        return Outline(data, chunk_ends(data), self)


class Outline:
    """A text as running sums over its chunks."""

    def __init__(self, data: bytes, ends: Sequence[int], chunks: Chunks):
        self.data, self.starts = data, [0, *ends]
        self.line_ends, self.chars, self.marked = [0], [0], False
        tail = b""
        for start, end in zip(self.starts, ends):
            lines, chars, head, last, marked = chunks.summary(data[start:end])
            self.line_ends.append(self.line_ends[-1] + lines)
            self.chars.append(self.chars[-1] + chars)
            seam = tail + head
            self.marked = self.marked or marked or (b"<" in tail and any(m in seam for m in MARKERS))
            tail = (tail + last)[-2:]
        self.lines = self.line_ends[-1] + (1 if data and not data.endswith(b"\n") else 0)

    def cut(self, lines: int) -> tuple[int, int]:
        """The byte and the code point after so many lines."""
        if lines <= 0:
            return 0, 0
        if lines >= self.lines:
            return len(self.data), self.chars[-1]
        chunk = int(np.searchsorted(self.line_ends, lines)) - 1
        start = self.starts[chunk]
        own = np.frombuffer(self.data, np.uint8, self.starts[chunk + 1] - start, start)
        end = start + int(np.flatnonzero(own == 10)[lines - self.line_ends[chunk] - 1]) + 1
        return end, self.chars[chunk] + len(self.data[start:end].translate(None, FOLLOWING))


RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


def transformed(chunks: Chunks, text: str | None, digest: str, rate: int, spm: int) -> tuple:
    """One row of RESULT; `digest` is the hex hash that decides."""
    data = (text or "").encode()
    outline = chunks.outline(data)
    h1, h2, h3, h4 = (int(digest[k:k + 8], 16) for k in range(0, 32, 8))
    if not data or outline.marked or h3 % 100 >= rate:
        return outline.lines, "plain", None, None, text or ""
    first, second = sorted((h1 % (outline.lines + 1), h2 % (outline.lines + 1)))
    (start, before), (end, until) = outline.cut(first), outline.cut(second)
    prefix, middle, suffix = data[:start], data[start:end], data[end:]
    mark_prefix, mark_suffix, mark_middle = MARKERS
    if h4 % 100 < spm:
        form, parts = "spm", (mark_suffix, suffix, mark_prefix, prefix, mark_middle, middle)
    else:
        form, parts = "psm", (mark_prefix, prefix, mark_suffix, suffix, mark_middle, middle)
    return outline.lines, form, before, until - before, b"".join(parts).decode()


_chunks = Chunks()


def fill_in_middle(id_column: str | Column = "doc_id", text: str | Column = "text", rate: int = 100, spm: int = 50, seed: int = 7) -> Column:
    """A struct of RESULT for each row: of all texts `rate` percent are cut, of these `spm` percent start with the suffix."""
    name = F.col(id_column) if isinstance(id_column, str) else id_column
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(name.cast("string"), F.lit(""))), 256)

    @F.pandas_udf(RESULT)
    def cut(texts: pd.Series, digests: pd.Series) -> pd.DataFrame:
        rows = [transformed(_chunks, t, d, rate, spm) for t, d in zip(texts, digests)]
        frame = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return frame.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return cut(text, digest)


def restored(output: str | Column, form: str | Column) -> Column:
    """The text that an output was made of; for plain ones the output itself."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    between = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    first = F.call_function("substring_index", body, between, F.lit(1))
    rest = F.substr(body, F.length(first) + F.length(between) + 1)
    second = F.substring_index(rest, MIDDLE, 1)
    middle = F.substr(rest, F.length(second) + F.lit(len(MIDDLE) + 1))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def rearranged(documents: DataFrame, id_column: str = "doc_id", text: str = "text", rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """The documents, in their own columns, with rearranged texts; null texts stay null."""
    bounded_batches(documents.sparkSession)
    output = fill_in_middle(F.col(f"`{id_column}`"), F.col(f"`{text}`"), rate, spm, seed)["output"]
    return documents.withColumn(text, F.when(F.col(f"`{text}`").isNotNull(), output))


_ORACLE = """
with rows as (
  select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
units as (
  select *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') as u,
    ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
    ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from rows),
cuts as (
  select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain'
      when h4 % 100 < 50 then 'spm' else 'psm' end as form from units),
parts as (
  select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from cuts)
select doc_id, n::bigint as n, form,
  case when form <> 'plain' then len(p)::bigint end as prefix_chars,
  case when form <> 'plain' then len(m)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from parts"""


@query("op12_fill_in_middle", _ORACLE)
def op12_fill_in_middle(spark, folder):
    bounded_batches(spark)
    rows = table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), fill_in_middle().alias("cut"))
    rows = rows.select("doc_id", "cut.*")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))

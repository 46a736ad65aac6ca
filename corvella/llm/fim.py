"""Fill-in-the-middle by a two-pass streaming matcher.

A text is a run of units: a run of ASCII letters, or any other single character. A first
pass of a lazy match iterator counts them; the numbers drawn for the document then give
two ranks, and a second pass advances another iterator to each of them in turn. No
list of units is ever held, so memory doesn't grow with their number.

The numbers are the first four groups of eight hexadecimal digits of the SHA-256 of
`seed:doc_id`. The first two, modulo the number of units plus one, are the cuts; the
third and fourth choose the form: plain, psm (prefix, suffix, middle) or spm.

Defined results: null and empty texts are plain and empty. Texts that hold one of the three
marks are plain, so that an output can always be read back. A null doc_id is drawn for as
an empty string. Very long texts are cut whole, as one match iterator at a time is all that is
held besides the text and its output. Repeated rows give equal results; there are
no ties. An empty table gives no rows. Extra columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.llm.common import bounded, freed

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
SEED = 1
#: Of a hundred documents, how many take part, and how many of those are spm.
TAKEN, SPM = 90, 20

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def count(text: str) -> int:
    """Units of a text."""
    return sum(1 for _ in UNIT.finditer(text))


def ends(text: str, low: int, high: int) -> tuple[int, int]:
    """Places at which the first `low` and the first `high` units end; one iterator goes to both."""
    units = UNIT.finditer(text)
    places, done = [], 0
    for rank in (low, high):
        last = None
        for last in islice(units, rank - done):
            pass
        places.append(last.end() if last else places[-1] if places else 0)
        done = rank
    return places[0], places[1]


def cut(text: str, draws: tuple[int, int, int, int], taken: int = TAKEN, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output) of one text."""
    n = count(text)
    if not text or any(m in text for m in MARKS) or draws[2] % 100 >= taken:
        return n, "plain", None, None, text
    a, b = ends(text, *sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
    if draws[3] % 100 < spm:
        return n, "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return n, "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


def _run(taken: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)
            rows = [cut(t.as_py() or "", d, taken, spm) for t, d in zip(batch.column(1), draws, strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED, taken: int = TAKEN, spm: int = SPM) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of each row of docs (doc_id, text)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    return bounded(docs).select(F.col("doc_id").cast("long"), "text", *draws).mapInArrow(freed(_run(taken, spm)), SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text of an output, from the output and its form alone."""
    body = F.substr(output, F.lit(4))
    psm, spm = F.split(body, f"{SUFFIX}|{MIDDLE}", -1), F.split(body, f"{PREFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)

"""Token-bounded splitting of long texts: lines, then sentences, then words."""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Callable, Iterator
from functools import cache

from pyspark.sql import Column
from pyspark.sql.functions import udtf

from corvella.functions.text import SENTENCES, sentences

Counter = Callable[[str], int]


def estimate(text: str) -> int:
    """A quarter of the UTF-16 length, rounded up."""
    return math.ceil(len(text.encode("utf-16-le", "surrogatepass")) / 8)


#: Pattern of the pieces that merges stay within; that of byte-level models.
PIECES = r"""'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def counter(ranks: str | None = None, pattern: str = PIECES) -> Counter:
    """Counts the tokens of a byte-level model from a file of its ranks (lines of a token in base 64 and its rank). Where there is no file, or a text
    can't be encoded, a quarter of the length stands in. One for each file and process."""
    if not ranks:
        return estimate
    try:
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        model = tiktoken.Encoding(ranks, pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    except (OSError, ImportError, ValueError):
        return estimate

    def count(text: str) -> int:
        try:
            return len(model.encode_ordinary(text))
        except Exception:  # the encoder is a library of its own; a text it fails on is estimated
            return estimate(text)

    return count


def split_sentences(text: Column) -> Column:
    """Sentences of a line as split_long_line() sees them."""
    return sentences(text)


def _pack(parts: list[str], most: int, count: Counter, glue: str) -> list[str]:
    out, now = [], ""
    for part in parts:
        longer = now + glue + part if now else part
        if now and count(longer) > most:
            out.append(now)
            longer = part
        now = longer
    return [*out, now] if now else out


def split_words(text: str, most: int, count: Counter = estimate) -> list[str]:
    """A single word over the bound stays whole."""
    return _pack([w for w in re.split(r"\s+", text) if w], most, count, " ")


def split_long_line(line: str, most: int, count: Counter = estimate) -> list[str]:
    pieces: list[str] = []
    for sentence in re.findall(SENTENCES, line) or [line]:
        sentence = sentence.strip()
        pieces += split_words(sentence, most, count) if count(sentence) > most else [sentence]
    return _pack([p for p in pieces if p], most, count, " ")


def overlap_lines(lines: list[str], budget: int, count: Counter = estimate) -> list[str]:
    """Last lines within the budget, one at least unless the budget is 0."""
    kept: list[str] = []
    used = 0
    if budget > 0:
        for line in reversed(lines):
            used += count(line + "\n")
            if kept and used > budget:
                break
            kept.insert(0, line)
    return kept


def split_by_tokens(text: str, most: int = 512, overlap: int = 50, count: Counter = estimate) -> list[str]:
    """Greedy line packing; each part but the first begins with the end of the one before."""
    if count(text) <= most:
        return [text]
    out: list[str] = []
    now: list[str] = []
    used = 0
    for line in text.split("\n"):
        n = count(line + "\n")
        if n > most:
            if now:
                out.append("\n".join(now))
            parts = split_long_line(line, most, count)
            out += parts[:-1]
            now = parts[-1:]
            used = count(now[0]) if now else 0
        elif now and used + n > most:
            out.append("\n".join(now))
            now = [*overlap_lines(now, overlap, count), line]
            used = count("\n".join(now))
        else:
            now.append(line)
            used += n
    return [*out, "\n".join(now)] if now else out


def split_chunk(content: str, start: int, kind: str, most: int = 512, overlap: int = 50, count: Counter = estimate) -> Iterator[tuple[str, int, int, str]]:
    """(content, startLine, endLine, chunkType) of the parts of a chunk; lines advance by each part's own number of lines."""
    parts = split_by_tokens(content, most, overlap, count)
    for i, part in enumerate(parts):
        n = part.count("\n") + 1
        yield part, start, start + n - 1, f"{kind}_part_{i + 1}" if len(parts) > 1 else kind
        start += n


@udtf(returnType="part int, content string, startLine int, endLine int, chunkType string", useArrow=True)
class SplitChunk:
    """LATERAL split_chunk(content, startLine, chunkType, maxTokens, overlapTokens[, file of ranks])."""

    def eval(self, content: str, start: int, kind: str, most: int, overlap: int, ranks: str = ""):
        if content is not None:
            for i, x in enumerate(split_chunk(content, start or 0, kind or "unknown", most, overlap, counter(ranks))):
                yield i, *x

"""Repair of quotations that are not verbatim: the longest piece that is, grown to the ends of its sentence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clauseloom.functions import text as T

ANCHOR, MOST = 60, 1400
MARK = 20  # characters of a text's marks; at most ANCHOR
_MARKS = dict(zip("’‘“”–—", "''\"\"--"))
_FOLD = str.maketrans(_MARKS)
PART = 50_000  # characters, about, whose marks are made at once


def normal_with_places(text: str) -> tuple[str, list[int]]:
    """The text folded, in lower case and with single blanks, and where each of its characters stood."""
    out: list[str] = []
    places: list[int] = []
    blank = True
    for i, c in enumerate(text):
        if c.isspace():
            if not blank:
                out.append(" ")
                places.append(i)
            blank = True
        else:
            low = c.translate(_FOLD).lower()[0]
            out.append(low)
            places.append(i)
            blank = False
    return "".join(out).rstrip(), places


def normal(text: str) -> str:
    """The text of normal_with_places alone."""
    for c, plain in _MARKS.items():
        text = text.replace(c, plain)
    low = text.lower()
    if len(low) != len(text) or "\u03a3" in text:  # letters that become two, or whose form depends on the word
        return normal_with_places(text)[0]
    return " ".join(low.split())


def longest_shared(p: str, q: str, anchor: int = ANCHOR) -> tuple[int, int]:
    """Start in p and length of the longest piece that p and q share, if that has `anchor` characters, else (0, 0); of several
    the first in p. Such a piece holds a whole one of p's blocks of half its length, so blocks are looked up and grown."""
    half = max(1, anchor // 2)
    best, reached = (0, 0), {}
    for at in range(0, len(p) - half + 1, half):
        block = p[at : at + half]
        found = q.find(block)
        while found >= 0:
            if reached.get(found - at, 0) <= at:
                a, b, x, y = at, found, at + half, found + half
                while a > 0 and b > 0 and p[a - 1] == q[b - 1]:
                    a, b = a - 1, b - 1
                while x < len(p) and y < len(q) and p[x] == q[y]:
                    x, y = x + 1, y + 1
                reached[found - at] = x
                if (x - a, -a) > (best[1], -best[0]):
                    best = (a, x - a)
            found = q.find(block, found + 1)
    return best if best[1] >= anchor else (0, 0)


def realigned(quote: str, page: str, anchor: int = ANCHOR, most: int = MOST) -> str:
    return shared_stretch(quote, page, anchor, most)[1]


def shared_stretch(quote: str, page: str, anchor: int = ANCHOR, most: int = MOST) -> tuple[int, str]:
    """The verbatim stretch of the page around the longest piece it shares with the quotation, if that has `anchor`
    characters: out to the ends of its clause. '' if there is none, or if it has more than `most` characters."""
    q, p = normal(quote), normal(page)
    if len(q) < anchor or not p:
        return 0, ""
    at = p.find(q)
    start, size = (at, len(q)) if at >= 0 else longest_shared(p, q, anchor)
    if not size:
        return 0, ""
    end = start + size
    while start > 0 and p[start - 1] not in ".;:!?":
        start -= 1
    while end < len(p) and p[end - 1] not in ".;:!?":
        end += 1
    if end - start > most:
        return size, ""
    places = normal_with_places(page)[1]
    return size, page[places[start] : places[end - 1] + 1].strip()


def marks(texts: list[str], anchor: int = ANCHOR, mark: int = MARK) -> tuple[np.ndarray, np.ndarray]:
    """Of each stretch of `anchor` characters of the normal texts the smallest hash of its pieces of `mark` characters: the text's
    place in the list and the hash, several times the same at most where it comes again. Texts that share such a stretch share a mark."""
    sizes = np.array([len(t) for t in texts], np.int64)
    h = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(h))  # characters of the text from here on
    if len(h) < anchor:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    span = 1
    while span < mark:  # hashes of two pieces, which may overlap, make that of one twice as long
        step = min(span, mark - span)
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15) + (h[step:] ^ h[step:] >> np.uint64(31))
        span += step
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    span, window = 1, anchor - mark + 1
    while span < window:  # smallest of the window's hashes
        step = min(span, window - span)
        h = np.minimum(h[:-step], h[step:])
        span += step
    here = np.flatnonzero(left[: len(h)] >= anchor)
    h, owner = h[here].view(np.int64), owner[here]
    new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))[: len(h)]
    return owner[new], h[new]


def candidates(quotes: DataFrame, pages: DataFrame, quote_id: str, page_id: str, scope: str, anchor: int = ANCHOR) -> DataFrame:
    """quote_id, page_id, quote, page: the pairs of one scope that share a piece of `anchor` characters, and no others to speak of,
    without pages that hold the quotation as it is. Of several rows of one id one counts.

    Only the texts' marks are shuffled to find the pairs; texts meet only for pairs that share a mark."""
    q, p = quotes.select(scope, quote_id, "quote"), pages.select(scope, page_id, "page")

    def marked(rows: DataFrame, key: str, text: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found, part, held, start = [], [], 0, 0
                for i, t in enumerate(b.column(text).to_pylist(), 1):
                    part.append(normal(t) if t else "")
                    held += len(part[-1])
                    if held >= PART or i == len(b):
                        owner, h = marks(part, anchor)
                        found.append((owner + start, h))
                        part, held, start = [], 0, i
                if not found:
                    continue
                at, h = pa.array(np.concatenate([f[0] for f in found])), np.concatenate([f[1] for f in found])
                yield pa.RecordBatch.from_arrays([b.column(scope).take(at), b.column(key).take(at), pa.array(h)], [scope, key, "_mark"])

        kinds = dict(rows.dtypes)
        found = rows.mapInArrow(run, f"{scope} {kinds[scope]}, {key} {kinds[key]}, _mark long").where(F.col(scope).isNotNull())
        return found.select(key, F.xxhash64(scope, "_mark").alias("_mark"))

    pairs = marked(q, quote_id, "quote").join(marked(p, page_id, "page"), "_mark").select(quote_id, page_id).distinct()
    q, p = q.withColumnRenamed(scope, "_scope").dropDuplicates([quote_id]), p.dropDuplicates([page_id])
    rows = pairs.join(q, quote_id).join(p, page_id).where(F.col(scope) == F.col("_scope"))  # scopes of one hash are told apart
    rows = rows.where(~F.contains("page", "quote"))  # most of them, and without normal forms
    return rows.where(~F.contains(T.norm_quotes(F.col("page")), T.norm_quotes(F.col("quote")))).select(quote_id, page_id, "quote", "page")


def repair(rows: DataFrame, key: str) -> DataFrame:
    """key, size, repaired for (key, quote, page): the number of the quotation's characters in the piece that page shares with it, and
    the stretch around it; rows without one are left out. Compared row by row, no rows are gathered. Nulls give nothing."""
    kind = dict(rows.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [(k, *shared_stretch(q, p)) for k, q, p in zip(f[key], f["quote"], f["page"]) if q and p]
            yield pd.DataFrame([m for m in made if m[1]], columns=[key, "size", "repaired"])

    return rows.select(key, "quote", "page").mapInPandas(run, f"{key} {kind}, size long, repaired string")

"""Documents to pages, lines, sections, chunks and passages, always with the page they come from."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from clauseloom.functions import text as T

TARGET = 1800  # characters of a passage
HEADING_CHARS = 160


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: that of the largest order (ties: all columns of the order). Null keys are keys. Last-wins dedup."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def earliest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: that of the smallest order. First-wins dedup."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def explode_pages(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each page, page_no from 1; empty pages keep their number; null text gives no row. Columns named as the new
    ones are replaced (here and in the functions below)."""
    df = df.drop(*({"page", "page_no", "_p"} - {text}))
    return df.select("*", F.posexplode(T.pages(F.col(text))).alias("_p", "page")).withColumn("page_no", (F.col("_p") + 1).cast("long")).drop("_p", text)


def text_status(dense: Column, n_pages: Column) -> Column:
    """usable, or how much its density of characters says that it needs OCR."""
    return F.when((n_pages > 0) & (dense < F.greatest(F.lit(1000), n_pages * 20)), "ocr_needed").when(dense < 1000, "partial_or_ocr_needed").otherwise("usable")


def size_bucket(n_pages: Column) -> Column:
    return F.when(n_pages <= 10, "short").when(n_pages <= 100, "medium").otherwise("long")


def is_heading(c: Column) -> Column:
    """A short line that begins with ARTICLE, APPENDIX or SECTION, or whose letters are mostly upper case."""
    s = T.squeeze(c)
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(s, r"[^\p{Lu}]", ""))
    named = F.upper(s).rlike(r"^(ARTICLE|APPENDIX|SECTION)\b")
    return (F.length(s) > 0) & (F.length(s) <= HEADING_CHARS) & (named | ((letters >= 5) & (upper / letters >= 0.8)))


def lines_with_heading(df: DataFrame, key: str) -> DataFrame:
    """Non-blank lines with the heading above each, filled forward in the order of pages and lines; headings themselves are
    not emitted. key, page_no, line_no, heading, line."""
    rows = explode_pages(df).select(key, "page_no", F.posexplode(F.split("page", "\n")).alias("line_no", "line"))
    rows = rows.where(F.length(F.trim(F.col("line"))) > 0).withColumn("line_no", F.col("line_no").cast("long"))
    w = Window.partitionBy(key).orderBy("page_no", "line_no")
    head = F.when(is_heading(F.col("line")), T.squeeze(F.col("line")))
    filled = rows.withColumn("_h", head).withColumn("heading", F.coalesce(F.last("_h", ignorenulls=True).over(w), F.lit("DOCUMENT PREAMBLE")))
    return filled.where(F.col("_h").isNull()).drop("_h")


def fixed_chunks(df: DataFrame, size: int, overlap: int, text: str = "text") -> DataFrame:
    """Chunks of `size` characters, each `overlap` into the one before; the last ends with the text. Empty text: none."""
    df = df.drop(*({"chunk", "chunk_no", "start", "_i"} - {text}))
    step = size - overlap
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int")))
    rows = df.where(n > 0).select("*", F.explode(starts).alias("_i")).withColumn("chunk_no", (F.col("_i") + 1).cast("long"))
    return rows.withColumn("start", (F.col("_i") * step).cast("long")).withColumn("chunk", F.substring(F.col(text), F.col("_i") * step + 1, F.lit(size))).drop("_i", text)


def sentences(df: DataFrame, text: str, least: int = 25, most: int | None = None) -> DataFrame:
    """Sentences of `least` characters and more, numbered from 1: all, or the first `most` for a menu to choose from."""
    df = df.drop(*({"sentence", "sid", "_p"} - {text}))
    parts = F.split(F.regexp_replace(F.col(text), r"([.;:!?])" + T.WS + "+", "$1\u001f"), "\u001f")
    rows = df.select("*", F.posexplode(F.filter(parts, lambda s: F.length(s) >= least)).alias("_p", "sentence"))
    rows = rows if most is None else rows.where(F.col("_p") < most)
    return rows.withColumn("sid", (F.col("_p") + 1).cast("long")).drop("_p", text)


# --- passages: folds over one document's paragraphs -----------------------------------------------------------------


def _heading_like(s: str) -> bool:
    if not s or len(s) > HEADING_CHARS:
        return False
    letters = [c for c in s if c.isalpha()]
    return bool(re.match(r"(ARTICLE|APPENDIX|SECTION)\b", s, re.I)) or (len(letters) >= 5 and sum(c.isupper() for c in letters) >= 0.8 * len(letters))


def _packed(units: list[tuple[int, str]], joiner: str, target: int) -> Iterator[list[tuple[int, str]]]:
    """Consecutive units, as many as fit the target with their joiners; a longer unit by itself."""
    held: list[tuple[int, str]] = []
    size = 0
    for unit in units:
        more = len(unit[1]) + (len(joiner) if held else 0)
        if held and size + more > target:
            yield held
            held, size, more = [], 0, len(unit[1])
        held.append(unit)
        size += more
    if held:
        yield held


def passages_of(text: str, target: int = TARGET) -> list[tuple[int, int, str, str]]:
    """(first page, last page, heading, text) of the passages of a document. A passage never crosses a heading; long
    paragraphs are split at sentence ends. A heading without text is lost, but the first of a document stands for itself."""
    sections: list[tuple[int, str, list[tuple[int, str]]]] = [(1, "DOCUMENT PREAMBLE", [])]  # page, heading, units
    for number, page in enumerate(text.split("\f"), 1):
        for raw in re.split(r"\n\s*\n", page.strip()):
            paragraph = re.sub(r"[ \t]+", " ", raw).strip()
            if _heading_like(paragraph):
                sections.append((number, paragraph, []))
            elif paragraph:
                pieces = [(number, s) for s in re.split(r"(?<=[.!?;:])\s+", paragraph)] if len(paragraph) > target else [(number, paragraph)]
                sections[-1][2].extend((number, " ".join(s for _, s in group)) for group in _packed(pieces, " ", target))
    out: list[tuple[int, int, str, str]] = []
    named = [s for k, s in enumerate(sections) if s[2] or k]
    for k, (page, heading, units) in enumerate(named):
        if not units and k == 0:
            units = [(page, heading)]
        for group in _packed(units, "\n\n", target):
            out.append((group[0][0], group[-1][0], heading, "\n\n".join(s for _, s in group)))
    return out


def build_passages(documents: DataFrame, key: str, target: int = TARGET) -> DataFrame:
    """key, ordinal from 1, page_start, page_end, heading, text of every document's passages (null text: none). Each
    document is folded by itself inside a batch, so nothing is shuffled."""
    kind = dict(documents.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, *p) for k, t in zip(f[key], f["text"]) for i, p in enumerate(passages_of(t, target), 1)]
            yield pd.DataFrame(rows, columns=[key, "ordinal", "page_start", "page_end", "heading", "text"])

    return documents.where("text is not null").select(key, "text").mapInPandas(run, f"{key} {kind}, ordinal long, page_start long, page_end long, heading string, text string")


def page_windows(documents: DataFrame, key: str, size: int = 20_000, overlap: int = 2) -> DataFrame:
    """key, window from 1, first_page, last_page: consecutive pages, without their padding and with two characters between
    them, up to `size` characters, a window beginning `overlap` pages before the last one ended, but always a page further.
    One page that is longer is a window. Only the pages' lengths go to Python."""
    kind = dict(documents.dtypes)[key]
    sized = documents.where("text is not null").select(key, F.transform(T.pages(F.col("text")), lambda p: F.length(T.compressed(p))).alias("n"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, lengths in zip(f[key], f["n"]):
                n = lengths.tolist()
                at = number = 0
                while at < len(n):
                    end, total = at + 1, n[at]
                    while end < len(n) and total + n[end] + 2 <= size:
                        total += n[end] + 2
                        end += 1
                    number += 1
                    rows.append((k, number, at + 1, end))
                    if end >= len(n):
                        break
                    at = max(at + 1, end - overlap)
            yield pd.DataFrame(rows, columns=[key, "window", "first_page", "last_page"])

    return sized.mapInPandas(run, f"{key} {kind}, window long, first_page long, last_page long")

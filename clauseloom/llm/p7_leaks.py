"""Problem 7: evaluation texts inside documents.

Wu-Manber search over words: the patterns are all runs of RUN consecutive words of the items, a block is two adjacent
words. A shift table tells for every block how far the search may jump (RUN - 1 words where no pattern has the block),
blocks that end a pattern lead to a bucket of patterns, told apart by a hash of all their words, and a direct comparison
confirms. All documents of a batch are searched at once, each with its own cursor, in numpy.

Items are taken in blocks of at most BLOCK_WORDS words. Their tables are built once, as arrays of about 30 bytes a word, so
what is broadcast is bounded; every block is searched for in all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from clauseloom.session import cut, spread, table

RUN = 13  # consecutive words that make a leak
BLOCK_WORDS = 2_000_000  # words of items searched for at once
BATCH_CHARS = 8_000_000  # characters of documents searched at once; a longer document is searched by itself

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """Runs of the letters a-z and digits, in lower case; everything else separates."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class Patterns:
    """Shift table and buckets of the runs of words of some items. The words of all items stand one after another in `flat`;
    a run is the place where it begins."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN):
        self.run = run
        self.ids: dict[bytes, int] = {}
        lines = [np.fromiter((self.ids.setdefault(x, len(self.ids) + 1) for x in words(text)), np.int32) for _, text in items]
        sizes = np.array([len(w) for w in lines], np.int64)
        self.flat = np.concatenate(lines) if lines else np.zeros(0, np.int32)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(items)), sizes)
        starts = np.flatnonzero(np.arange(len(self.flat)) + run <= ends[owner]) if len(self.flat) else np.zeros(0, np.int64)
        self.base = len(self.ids) + 1
        self.factors = np.random.default_rng(7).integers(1, 2**62, run, dtype=np.int64) | 1
        h = np.zeros(len(starts), np.int64)
        code, shift = [], []
        for k in range(run):
            h += self.flat[starts + k] * self.factors[k]
            if k + 1 < run:
                code.append(self.flat[starts + k].astype(np.int64) * self.base + self.flat[starts + k + 1])
                shift.append(np.full(len(starts), run - 2 - k, np.int8))
                if k % 4 == 3 or k + 2 == run:  # the least shift of each block so far
                    code, shift = ([x] for x in self._least(np.concatenate(code), np.concatenate(shift)))
        order = np.argsort(h, kind="stable")
        self.starts, self.hashes = starts[order].astype(np.int32), h[order]
        self.owners = np.array([i for i, _ in items], np.int64)[owner[starts[order]]] if len(items) else np.zeros(0, np.int64)
        self.blocks, self.shifts = (code[0], shift[0]) if code else (np.zeros(0, np.int64), np.zeros(0, np.int8))

    @staticmethod
    def _least(code: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((shift, code))
        codes, first = np.unique(code[order], return_index=True)
        return codes, shift[order][first]

    def search(self, texts: list[str]) -> list[tuple[int, int]]:
        """(place of the text, item) of every item of which a text holds a run; each once."""
        if not len(self.starts):
            return []
        get, found = self.ids.get, []
        parts = [np.fromiter((get(w, 0) for w in words(t)), np.int64) for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        which = np.flatnonzero(sizes >= self.run)
        at = (ends - sizes)[which] + self.run - 1
        hits = []
        while len(at):
            code = ids[at - 1] * self.base + ids[at]
            k = np.minimum(np.searchsorted(self.blocks, code), len(self.blocks) - 1)
            jump = np.where(self.blocks[k] == code, self.shifts[k].astype(np.int64), self.run - 1)
            if (zero := jump == 0).any():
                hits.append((which[zero], at[zero]))
            at = at + np.maximum(jump, 1)
            live = at < ends[which]
            which, at = which[live], at[live]
        if hits:
            doc, at = (np.concatenate(x) for x in zip(*hits))
            windows = ids[at[:, None] + np.arange(1 - self.run, 1)]
            h = (windows * self.factors).sum(1)
            low, high = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, side="right")
            for r in np.flatnonzero(high > low):
                for p in range(low[r], high[r]):
                    if (self.flat[self.starts[p] : self.starts[p] + self.run] == windows[r]).all():
                        found.append((int(doc[r]), int(self.owners[p])))
        return list(dict.fromkeys(found))


def _search(documents: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(Patterns(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = shared.value

        def done(ids: list[int], texts: list[str]) -> pa.RecordBatch:
            hits = patterns.search(texts)
            return pa.RecordBatch.from_arrays([pa.array([ids[d] for d, _ in hits], pa.int64()), pa.array([i for _, i in hits], pa.int64())], ["doc_id", "item_id"])

        for b in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size > BATCH_CHARS:
                    yield done(ids, texts)
                    ids, texts, size = [], [], 0
            yield done(ids, texts)

    return documents.mapInArrow(run, "doc_id long, item_id long")


def leaks(documents: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id where the document's text holds RUN consecutive words of the item's text; each pair once. Null and
    short texts hold nothing; rows without an id are left out."""
    rows = spread(documents.where("doc_id is not null").where(F.length("text") >= 2 * RUN - 1).select("doc_id", "text"))
    blocks: list[list[tuple[int, str]]] = [[]]
    out: DataFrame | None = None
    size = 0

    def add(block: list[tuple[int, str]], last: bool) -> None:
        nonlocal out
        part = _search(rows, block)
        if not last:
            part = cut(part)  # written, so that a block's broadcast can go before the next comes
        out = part if out is None else out.unionByName(part)

    for item, text in items.where("item_id is not null and text is not null").select("item_id", "text").toLocalIterator():
        n = len(words(text))
        if size and size + n > block_words:
            add(blocks.pop(), last=False)
            blocks.append([])
            size = 0
        blocks[-1].append((item, text))
        size += n
    add(blocks.pop(), last=True)
    return out.distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_items_leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each test item in how many documents it stands, those that leaked only."""
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))

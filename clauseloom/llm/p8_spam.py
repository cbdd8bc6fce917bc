"""Problem 8: pages of keywords, tags, product lists or links instead of prose or the entries of a contract document.

An n-gram model of word classes is trained on the passages, that is on the indexed text of contract documents: the classes
of function words, content words, content words in a pair that comes again near by, links and tags. Every text is cut into
blocks of BLOCK scored words, and a block is abnormal if its perplexity (bits a word) lies beyond what all but a share of
TAIL of the prose blocks of its length show, at the high or the low end. A document is spam if more than half of the characters of
its words lie in abnormal blocks. Nothing but the perplexity decides.

What is no sentence and no row of keywords has no score: runs of fewer than SENTENCE words between two numbers are
entries (salary rows, directories, calendars, contents), and words of scripts without listed function words stay out.

The model is a table over ORDER classes of fixed number, and the thresholds come from a histogram of fixed size, so neither
depends on the size of the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from clauseloom.session import spread, table

ORDER = 5
BLOCK = 25  # scored words of a block; the last one of a text may have half as many more
NEAR = 200  # words within which a pair of content words counts as coming again
SENTENCE = 8  # words between two numbers from which a run is scored
TAIL = 0.001  # share of the prose blocks beyond each of the two thresholds
LENGTHS = (12, 25)  # bounds of the block lengths that have thresholds of their own
BINS, TOP = 100, 40  # histogram of bits: bins a bit, and its end
BATCH_CHARS = 4_000_000  # characters that are scored at once

# --- fixed values: closed word classes of English, Spanish, French and Portuguese --------------------------------
CLOSED = {
    "determiner": "the a an this that these those each every any all both some such no its their his her our el la los las un una unos unas este esta cada todo todos su sus le les des du cet cette chaque tout son sa ses leur o os as um uma uns umas ao aos à às da do das dos na no nas nos todo cada seu sua",
    "preposition": "of in on at by for from with to under within without during before after between into upon per as than through until about against de del al en con por para según sin sobre ante durante desde hasta tras dans sur pour par avec sans selon après avant sous chez entre em com sem conforme após pelo pela",
    "conjunction": "and or but nor if when where while whenever unless because since whether although except provided y e o u pero si cuando donde et ou mais si quand lorsque où mas se quando onde que qui which who whom whose",
    "auxiliary": "shall may must will should can could would might is are was were be been being has have had do does did deberá podrá tendrá debe puede es son será serán ha han está se ne devra pourra doit peut est sont sera ont a deverá poderá terá deve pode é são foi",
    "pronoun": "he she it they we you i him them us me who what there él ella ellos lo il elle ils elles on y en ele ela eles isso",
    "negation": "not never no nor ni pas non não nem ningún ninguna aucun aucune nenhum",
}
_ROLES = ["edge", "function", "content", "link", "tag", "again"]
ROLE = {name: i for i, name in enumerate(_ROLES)}
K = len(_ROLES)
_FUNCTION = frozenset(w for ws in CLOSED.values() for w in ws.split())
_NUMBER, _OTHER = K, K + 1  # roles that the model doesn't see
_SHIFT = 4  # bits of a token's number that hold its role

TOKEN = re.compile(r"https?://[^\s()\[\]<>\"]+|www\.[^\s()\[\]<>\"]+|#\w+|\d[\d.,:/]*|[^\W\d_]+(?:['’][^\W\d_]+)*")


class _Numbers(dict):
    """A number for every token: that of its lower-case form, and its role in the last _SHIFT bits."""

    def __missing__(self, t: str) -> int:
        low = t.lower()
        n = self[low] if low != t and low in self else (len(self) + 1 << _SHIFT) + _role(t, low)
        self[t] = n
        return n


def _role(t: str, low: str) -> int:
    c = t[0]
    if c == "#":
        return ROLE["tag"]
    if c.isdigit():
        return _NUMBER
    if t.startswith(("http://", "https://", "www.")):
        return ROLE["link"]
    if low in _FUNCTION:
        return ROLE["function"]
    return _OTHER if ord(c) >= 0x250 and not 0x1E00 <= ord(c) < 0x1F00 else ROLE["content"]


def roles_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of some texts, one after another: the text's place, the role (that of a content word in a pair that
    comes again is `again`, that of entries _OTHER), the number of characters."""
    numbers = _Numbers()
    found = [TOKEN.findall(t) for t in texts]
    text = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    flat = [t for f in found for t in f]
    n = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
    chars = np.fromiter(map(len, flat), np.int64, len(flat))
    role = n & (1 << _SHIFT) - 1
    content = role == ROLE["content"]
    pair = np.flatnonzero(content[1:] & content[:-1] & (text[1:] == text[:-1])) + 1
    # equal pairs one behind the other, in the order of their places
    code = (n[pair - 1] >> _SHIFT) * (len(numbers) + 2) + (n[pair] >> _SHIFT)
    order = np.argsort(code, kind="stable")
    near = (code[order][1:] == code[order][:-1]) & (text[pair[order][1:]] == text[pair[order][:-1]]) & (np.diff(pair[order]) <= NEAR)
    role[pair[order[1:][near]]] = role[pair[order[:-1][near]]] = ROLE["again"]
    # words between two numbers, or a number and the text's end
    number = role == _NUMBER
    run = np.cumsum(number | np.append(True, text[1:] != text[:-1])[: len(text)])
    words = np.bincount(run, ~number & (role != _OTHER), int(run[-1]) + 1 if len(run) else 1)
    loose = (role != ROLE["link"]) & (role != ROLE["tag"])
    role[loose & (words[run] < SENTENCE)] = _OTHER
    return text, role, chars


def _codes(text: np.ndarray, role: np.ndarray) -> np.ndarray:
    """The numbers of the runs of ORDER classes that end at each scored word; a text begins after ORDER - 1 edges."""
    at = np.arange(len(role)) - np.searchsorted(text, text)
    c = np.zeros(len(role), np.int64)
    for back in range(ORDER - 1, -1, -1):
        before = np.roll(role, back)
        c = c * K + np.where(at >= back, before, ROLE["edge"])
    return c


def _parts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch in parts of bounded size, with the place of the first; nulls as empty texts."""
    held: list[str] = []
    size = first = 0
    for i, t in enumerate(column.to_pylist()):
        held.append(t or "")
        size += len(held[-1])
        if size > BATCH_CHARS:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def ngram_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all runs of ORDER classes over a frame with one text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(K**ORDER, np.int64)
        for b in batches:
            for _, part in _parts(b.column(0)):
                text, role, _ = roles_of(part)
                counts += np.bincount(_codes(text[role < K], role[role < K]), minlength=K**ORDER)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["code", "n"])

    out = np.zeros(K**ORDER)
    for code, n in texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toLocalIterator():
        out[code] = n
    return out


def bits_table(counts: np.ndarray) -> np.ndarray:
    """Bits of the last class given those before, each order mixed with the next shorter one."""
    full = counts.reshape((K,) * ORDER)
    p = np.full(K, 1.0 / K)
    for order in range(1, ORDER + 1):
        c = full.sum(axis=tuple(range(ORDER - order))) if order < ORDER else full
        p = (c + 8.0 * p) / (c.sum(-1, keepdims=True) + 8.0)
    return (-np.log2(p)).astype(np.float32).ravel()


def scored_blocks(texts: list[str], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all blocks: the text's place, scored words, bits a word, characters of the words. And the characters of the words,
    scored or not, of each text."""
    text, role, chars = roles_of(texts)
    every = np.bincount(text, chars, len(texts))
    keep = role < K
    text, role, chars = text[keep], role[keep], chars[keep]
    cost = bits[_codes(text, role)].astype(np.float64)
    at = np.arange(len(text)) - np.searchsorted(text, text)
    size = np.bincount(text, minlength=len(texts))[text]
    # what is left of a text joins the block before it, if it is less than half a block
    block = np.minimum(at // BLOCK, np.maximum(1, (size + BLOCK // 2) // BLOCK) - 1)
    starts = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (block[1:] != block[:-1]))[: len(text)])
    if not len(starts):
        return text, text, cost, chars, every
    words = np.diff(np.append(starts, len(text)))
    return text[starts], words, np.add.reduceat(cost, starts) / words, np.add.reduceat(chars, starts), every


def _bucket(words: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, words, side="right")


def _bin(bits: np.ndarray) -> np.ndarray:
    return np.minimum(bits * BINS, BINS * TOP - 1).astype(np.int64)


def thresholds(texts: DataFrame, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each class of lengths the bins below and above which no more than TAIL of the prose blocks lie. A class with less
    than 1 / TAIL blocks tells no tail: it takes the outer ones of its own and of the next that does."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)
    n = len(LENGTHS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n * BINS * TOP, np.int64)
        for b in batches:
            for _, part in _parts(b.column(0)):
                _, words, cost, _, _ = scored_blocks(part, shared.value)
                counts += np.bincount(_bucket(words) * BINS * TOP + _bin(cost), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["code", "n"])

    histogram = np.zeros(n * BINS * TOP)
    for code, count in texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toLocalIterator():
        histogram[code] = count
    low, high = np.zeros(n, np.int64), np.full(n, BINS * TOP)
    known = False  # whether a longer class has thresholds
    for i in reversed(range(n)):
        h = histogram.reshape(n, -1)[i]
        below, total = np.cumsum(h), h.sum()
        if total:
            low[i], high[i] = np.searchsorted(below, TAIL * total, side="right"), np.searchsorted(below, (1 - TAIL) * total, side="left")
        if known and total * TAIL < 1:
            low[i], high[i] = (min(low[i], low[i + 1]), max(high[i], high[i + 1])) if total else (low[i + 1], high[i + 1])
        known = known or total > 0
    return low, high


def spam_shares(documents: DataFrame, prose: DataFrame) -> DataFrame:
    """doc_id, share of the characters of a document's words that lie in abnormal blocks, for documents with text (a text
    without words: 0); null texts and rows without an id are left out. documents: doc_id, text; prose: text to train on."""
    trained = spread(prose.where("text is not null").select("text"))
    bits = bits_table(ngram_counts(trained))
    plan = documents.sparkSession.sparkContext.broadcast((bits, *thresholds(trained, bits)))
    rows = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, low, high = plan.value
        for b in batches:
            for first, part in _parts(b.column(1)):
                text, words, cost, chars, every = scored_blocks(part, bits)
                k, at = _bucket(words), _bin(cost)
                spam = np.bincount(text, chars * ((at < low[k]) | (at > high[k])), len(part))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(part)), pa.array(spam / np.maximum(1, every))], ["doc_id", "share"])

    return rows.mapInArrow(run, "doc_id long, share double")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "passages")).where(F.col("share") > 0.5).select("doc_id").distinct()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with text, and the share of it that is spam."""
    shares = spam_shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "passages"))
    return shares.groupBy("doc_id").agg(F.round(F.max("share"), 4).alias("share"))

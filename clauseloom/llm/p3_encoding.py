"""Problem 3: text garbled by decoding with the wrong character encoding.

Adjacent characters are scored by the mutual information that their classes (general category and script) have in the
whole corpus, with a bonus for characters that are rare in it and for two neighbours beyond ASCII: a pair scores above zero
where it is improbable. Pairs without a character beyond ASCII count as probable. The maximum-scoring segments of each
text are its improbable runs; inside these inverse mappings are tested, and one is taken if it makes the stretch
more probable by GAIN bits (self-information of its characters less the mutual information of its pairs):
- bytes of UTF-8 read as another encoding (also twice and three times, also with bytes lost that the encoding lacks),
- what is left of a cp1252 sequence that lost a byte (_SHORT),
- bytes of one single-byte encoding read as another (look-alike letters of other scripts excepted: problem 1).
Letters that occur nowhere else in the corpus count as no rarer than the characters they were read as. They are taken if
they form a run of one script, or complete words in lower case: two that gain GAIN bits or one that gains UNSEEN_GAIN. The
other unknown letters that the same encoding and script give in that text are taken with them.
Replacement characters and C1 control characters stand for no letter of any language: they count as rare however often the
corpus holds them, so that they lie in runs; in a run they are damage by themselves.

The corpus statistics are of bounded size: one count for each pair of classes and one for each code point.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from clauseloom.llm.textform import LOOK_ALIKE
from clauseloom.session import spread, table

THRESHOLD = 3.0  # bits by which a pair must be improbable to score above zero
GAP = 8.0  # what a pair of ASCII characters costs a run
COMMON_BITS = 11.0  # characters with less self-information than this get no bonus for rarity
TWO_WIDE = 5.0  # bonus of a pair of characters beyond ASCII
LOST_BITS = 8.0  # bonus of replacement and C1 control characters
GAIN = 5.0  # bits that an inverse mapping must gain
UNSEEN_GAIN = 8.0  # ... for one letter that the corpus doesn't hold, alone in its text
WEAK_GAIN = 1.0  # ... that a change must gain in a text where the same mapping gains GAIN bits elsewhere
ROUNDS = 4  # readings undone one after another

# Encodings that UTF-8 is misread as, and pairs (read as, written as) of single-byte encodings.
UTF8_READ_AS = ("cp1252", "cp437", "mac_roman", "cp1251", "cp850", "cp1250", "iso8859_2")
SINGLE_BYTE = (("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1251", "cp1252"), ("latin_1", "cp1252"))

_TOP = 0x10000
_BUCKETS = (
    (0x80, "ascii"), (0x250, "latin"), (0x300, "ipa"), (0x370, "mark"), (0x400, "greek"), (0x530, "cyrillic"), (0x1E00, "other"),
    (0x1F00, "latin"), (0x2000, "greek"), (0x2070, "punctuation"), (0x2500, "symbol"), (0x25A0, "box"), (0x3000, "symbol"), (0xA000, "cjk"),
    (0xFF00, "other"), (_TOP, "width"),
)


@lru_cache(maxsize=1)
def classes() -> tuple[np.ndarray, int]:
    """The class number of every code point (those from U+10000 on share the last place), and how many there are."""
    seen: dict[tuple[str, str], int] = {}
    out = np.zeros(_TOP + 1, np.int32)
    b = 0
    for c in range(_TOP):
        while c >= _BUCKETS[b][0]:
            b += 1
        category = unicodedata.category(chr(c))
        out[c] = seen.setdefault((category, "ascii" if category == "Zs" else _BUCKETS[b][1]), len(seen))  # all blanks are alike
    out[_TOP] = len(seen)
    return out, len(seen) + 1


def _points(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), _TOP).astype(np.int32)


def corpus_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of class pairs and of code points over all rows of a frame with one text column."""
    of, n = classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, single = np.zeros(n * n, np.int64), np.zeros(_TOP + 1, np.int64)
        for b in batches:
            if text := "\n".join(t for t in b.column(0).to_pylist() if t):
                cp = _points(text)
                single += np.bincount(cp, minlength=_TOP + 1)
                k = of[cp]
                pairs += np.bincount(k[:-1] * n + k[1:], minlength=n * n)
        where = np.concatenate([np.flatnonzero(pairs), -1 - np.flatnonzero(single)])
        count = np.concatenate([pairs[pairs > 0], single[single > 0]])
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(count, pa.int64())], ["code", "n"])

    summed = texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    pairs, single = np.zeros(n * n), np.zeros(_TOP + 1)
    for code, count in summed:
        if code >= 0:
            pairs[code] = count
        else:
            single[-1 - code] = count
    return pairs.reshape(n, n), single


class Model:
    """Improbability in bits of class pairs, and the bonus of rare characters."""

    def __init__(self, pairs: np.ndarray, single: np.ndarray):
        self.of, _ = classes()
        total = pairs.sum() + 1.0
        left, right = pairs.sum(1) + 1.0, pairs.sum(0) + 1.0
        self.odd = (-np.log2((pairs + 0.5) * total / (left[:, None] * right[None, :]))).astype(np.float32)
        self.odd = np.clip(self.odd, -6, 8)
        self.bits = np.clip(-np.log2((single + 0.5) / (single.sum() + 1.0)), 0, 24).astype(np.float32)
        self.rare = np.clip(self.bits - COMMON_BITS, 0, 8)
        self.rare[:128] = 0
        self.rare[[0xFFFD, *range(0x80, 0xA0)]] = LOST_BITS
        self.seen = (single > 0).tolist()
        self.kind, self.odd_list, self.bit_list = self.of.tolist(), self.odd.tolist(), self.bits.tolist()

    def pair_scores(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs with a character beyond ASCII, and their scores."""
        wide = cp > 127
        at = np.flatnonzero(wide[:-1] | wide[1:])
        a, b = cp[at], cp[at + 1]
        both = TWO_WIDE * (wide[at] & wide[at + 1])
        odd = np.maximum(self.odd[self.of[a], self.of[b]], -1)  # damage is mutually dependent, too: no more than 1 bit off for it
        return at, odd + self.rare[a] + self.rare[b] + both - THRESHOLD

    def badness(self, text: str, unseen: float = 24.0) -> float:
        """Improbability of a short stretch between its first and last character, in bits. unseen: self-information, at
        most, of a character that the corpus doesn't hold."""
        points = [min(ord(c), _TOP) for c in text]
        bad, before = 0.0, self.kind[points[0]]
        for p in points[1:]:
            here = self.kind[p]
            bad += self.odd_list[before][here] + (self.bit_list[p] if self.seen[p] else min(self.bit_list[p], unseen))
            before = here
        return bad - self.bit_list[points[-1]]


def maximal_segments(at: list[int], scores: list[float], gap: float) -> list[tuple[int, int]]:
    """All maximal-scoring segments (first and last place) of scores at ascending places; every place between two
    listed ones scores -gap. Linear time."""
    kept: list[tuple[int, int, float, float]] = []
    total, last = 0.0, None
    for p, s in zip(at, scores):
        if last is not None:
            total -= gap * (p - last - 1)
        last, before, total = p, total, total + s
        if s <= 0:
            continue
        seg = (p, p, before, total)
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= seg[2]:
                j -= 1
            if j < 0 or kept[j][3] >= seg[3]:
                kept.append(seg)
                break
            seg = (kept[j][0], seg[1], kept[j][2], seg[3])
            del kept[j:]
    return [(a, b) for a, b, _, _ in kept]


@lru_cache(maxsize=None)
def _upper_half(codec: str) -> dict[int, str]:
    """Characters of the bytes 80 to FF; where the encoding has none, the C1 control of that number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = codecs.decode(bytes([b]), codec)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


@lru_cache(maxsize=None)
def _to_byte(codec: str) -> dict[str, int]:
    back = {c: b for b, c in _upper_half(codec).items()}
    return {chr(b): b for b in range(0x80, 0xA0)} | back


@lru_cache(maxsize=None)
def _sequences(codec: str) -> re.Pattern[str]:
    """What UTF-8's sequences look like, read as the encoding."""
    by = _to_byte(codec)
    some = lambda a, b: "[" + "".join(re.escape(c) for c, n in by.items() if a <= n <= b) + "]"
    k = some(0x80, 0xBF)
    return re.compile(f"(?:{some(0xC2, 0xDF)}{k}|{some(0xE0, 0xEF)}{k}{k}|{some(0xF0, 0xF4)}{k}{k}{k})+")


_LOST = (0x81, 0x8D, 0x8F, 0x90, 0x9D)  # bytes that cp1252 lacks: readers drop them
_SHORT = re.compile("â€(?![\\w™œ\x9d“”˜¦¢\x80-\x9f])|(?<=[a-zà-ÿ])Ã(?=[a-z \\n])|(?<=[\\s(])Ã(?= [a-zà-ÿ])")


def _decoded(chars: str, codec: str) -> str | None:
    by = _to_byte(codec)
    try:
        out = bytes(by[c] for c in chars).decode("utf-8")
    except (UnicodeDecodeError, KeyError):
        return None
    return None if any(unicodedata.category(c) in ("Cn", "Co", "Cs") for c in out) else out


def _script(c: str) -> str:
    """The script of a letter by its bucket, '' for what is no letter of a script."""
    if not unicodedata.category(c).startswith("L"):
        return ""
    bucket = next((name for top, name in _BUCKETS if ord(c) < top), "")
    return {"ascii": "latin", "ipa": "", "mark": "", "punctuation": "", "symbol": "", "box": ""}.get(bucket, bucket if bucket != "other" else unicodedata.name(c, "").split(" ")[0].lower())


def _completes(before: str, new: str, after: str) -> bool:
    """Whether lower-case letters of one script stand beside a lower-case letter of it."""
    return new.islower() and any(x.islower() and _script(x) == _script(new[0]) for x in (before, after))


def _undo_utf8(text: str, runs: list[tuple[int, int]], model: Model, made: set[str]) -> str:
    """The sequences that lie in the runs (with a few characters around) decoded where that gains GAIN bits. made: gets the
    letters that the corpus doesn't hold."""
    best: list[tuple[float, int, int, str]] = []
    unseen: dict[tuple[str, str], list[tuple[int, float, int, int, str]]] = {}  # by encoding and script
    spans: list[list[int]] = []
    for lo, hi in runs:  # with room for what a sequence needs beyond the run
        if spans and lo - 3 <= spans[-1][1]:
            spans[-1][1] = hi + 5
        else:
            spans.append([max(0, lo - 3), hi + 5])
    for lo, hi in spans:
        part = text[lo:hi]
        for codec in UTF8_READ_AS:
            for m in _sequences(codec).finditer(part):
                if LOOK_ALIKE.issuperset(m.group().replace("\xa0", "")) or (new := _decoded(m.group(), codec)) is None:
                    continue
                a, b = m.start() + lo, m.end() + lo
                before, after = text[max(0, a - 1) : a] or " ", text[b : b + 1] or " "
                if len(m.group()) < 3 * len(new) and not any(model.seen[min(ord(c), _TOP)] for c in new):
                    # two characters make an unknown letter now and then
                    scripts = {_script(c) for c in new}
                    if len(scripts) > 1 or "" in scripts:
                        continue
                    most = max(model.bit_list[min(ord(c), _TOP)] for c in m.group())
                    gain = model.badness(before + m.group() + after) - model.badness(before + new + after, most)
                    word = _completes(before, new, after)
                    sure = len(new) > 1 and (word or gain >= GAIN) or word and gain >= UNSEEN_GAIN
                    unseen.setdefault((codec, scripts.pop()), []).append((2 if sure else int(word and gain >= GAIN), gain, a, b, new))
                    continue
                gain = model.badness(before + m.group() + after) - model.badness(before + new + after)
                if gain >= GAIN:
                    best.append((gain, a, b, new))
    known = [(a, b) for _, a, b, _ in best]
    for letters in unseen.values():
        letters = [x for x in letters if all(x[3] <= a or x[2] >= b for a, b in known)]
        if sum(x[0] for x in letters) > 1:  # one that is sure or two that are likely; the others of their kind go with them
            best += [x[1:] for x in letters]
            made.update(*[x[4] for x in letters])
    for m in (m for lo, hi in spans for m in _SHORT.finditer(text, lo, hi)):
        a, b = m.span()
        before, after = text[max(0, a - 1) : a] or " ", text[b : b + 1] or " "
        stem = b"\xe2\x80" if m.group() == "â€" else b"\xc3"
        ends = _LOST if len(stem) == 2 else (*_LOST, 0xA0, 0xAD)
        options = [(stem + bytes([e])).decode("utf-8") for e in ends]
        new = min(options, key=lambda c: model.badness(before + c + after))
        gain = model.badness(before + m.group() + after) - model.badness(before + new + after)
        if gain >= GAIN:
            best.append((gain, a, b, new))
    out: list[str] = []
    taken: list[tuple[int, int, str]] = []
    for _, a, b, new in sorted(best, key=lambda x: (-(x[2] - x[1]), -x[0])):
        if all(b <= x or a >= y for x, y, _ in taken):
            taken.append((a, b, new))
    end = 0
    for a, b, new in sorted(taken):
        out += [text[end:a], new]
        end = b
    return "".join(out) + text[end:]


def _undo_single(text: str, runs: list[tuple[int, int]], model: Model, made: set[str]) -> str:
    """One mapping between single-byte encodings for the runs of the text, if it gains GAIN bits a changed character."""
    best, found = 0.0, text
    for read, written in SINGLE_BYTE:
        by, to = _to_byte(read), _upper_half(written)
        changes, total = [], 0.0
        for lo, hi in runs:
            for i in range(max(0, lo), min(len(text), hi + 2)):
                c = text[i]
                if c < "\x80" or c.isspace() or c in made or c not in by or c in LOOK_ALIKE or (new := to[by[c]]) == c or "\x80" <= new <= "\x9f":
                    continue
                before, after = text[i - 1 : i] or " ", text[i + 1 : i + 2] or " "
                gain = model.badness(before + c + after) - model.badness(before + new + after)
                if gain >= WEAK_GAIN:
                    changes.append((i, new))
                    if gain >= GAIN and (not new.isalpha() or before.isalpha() or after.isalpha()):  # a letter by itself proves nothing
                        total += gain
        if total > best:
            chars = list(text)
            for i, new in changes:
                chars[i] = new
            best, found = total, "".join(chars)
    return found


_LOSS = re.compile("[�\x80-\x9f]")


def restore(text: str, model: Model, runs: list[tuple[int, int]]) -> tuple[str, bool, bool]:
    """The text with what can be restored restored; whether it is damaged; whether damage is left."""
    first, made = text, set()
    for _ in range(ROUNDS):
        new = _undo_utf8(text, runs, model, made)
        if new == text:
            new = _undo_single(text, runs, model, made)
        if new == text:
            break
        text, runs = new, improbable_runs(new, model)
    left = any(_LOSS.search(text, max(0, lo), hi + 2) for lo, hi in runs)
    return text, left or text != first, left


def improbable_runs(text: str, model: Model) -> list[tuple[int, int]]:
    at, s = model.pair_scores(_points(text))
    return maximal_segments(at.tolist(), s.tolist(), GAP)


def repaired(texts: DataFrame, pairs: np.ndarray, single: np.ndarray) -> DataFrame:
    """passage_id, restored, incomplete for the rows of (passage_id, text) with a damaged stretch. incomplete: some of
    the damage is beyond repair and still in the text. Null and empty texts are not damaged."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((pairs, single))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for b in batches:
            rows = [(i, t) for i, t in enumerate(b.column(1).to_pylist()) if t and not t.isascii()]
            out: list[tuple[int, str, bool]] = []
            if rows:
                at, s = model.pair_scores(_points("\n".join(t for _, t in rows)))
                ends = np.cumsum([len(t) + 1 for _, t in rows])
                which = np.searchsorted(ends, at, side="right")
                cuts = np.searchsorted(which, np.arange(len(rows) + 1))
                for r in np.unique(which[s > 0]):
                    i, t = rows[r]
                    lo, hi = cuts[r], cuts[r + 1]
                    start = int(ends[r]) - len(t) - 1
                    runs = maximal_segments((at[lo:hi] - start).tolist(), s[lo:hi].tolist(), GAP)
                    new, damaged, left = restore(t, model, runs)
                    if damaged:
                        out.append((i, new, left))
            ids = b.column(0).take(pa.array([x[0] for x in out], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.bool_())], ["passage_id", "restored", "incomplete"]
            )

    return texts.mapInArrow(run, "passage_id long, restored string, incomplete boolean")


def damaged_passages(passages: DataFrame) -> DataFrame:
    """passage_id, restored, incomplete of the damaged passages, each once (equal rows give equal results; of different
    texts under one id the one that sorts first is kept). Rows without an id are left out."""
    rows = passages.where("passage_id is not null and text is not null").select("passage_id", "text")
    rows = spread(rows)
    pairs, single = corpus_counts(rows.select("text"))
    return (
        repaired(rows, pairs, single).groupBy("passage_id").agg(F.min(F.struct("restored", "incomplete")).alias("r")).select("passage_id", "r.restored", "r.incomplete")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_passages(table(spark, sf_dir, "passages")).select("passage_id")


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged passages with their restored text."""
    return damaged_passages(table(spark, sf_dir, "passages"))

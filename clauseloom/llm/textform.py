"""One consistent form for text whose characters look alike but differ (problem 1).

Every token's characters are resolved to the set of scripts they can be read in, the sets are intersected, and the
token is spelled in one script of the intersection (Latin first). So a Latin word with a Cyrillic letter inside (mixed
script) and a word wholly of look-alike letters (whole-script confusable) get the same spelling as the plain word,
while a word with a letter that only Cyrillic or Greek has keeps its own script. What is not a letter is normalised by
table: invisible characters go, special blanks become blanks, look-alike hyphens become hyphens, width and ligature
forms become their letters, and accents are composed.

Letters that differ in case or accent, and different kinds of quotation marks or dashes, stay different.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# --- fixed values: invisible characters, blanks, hyphens -------------------------------------------------------
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
VARIATION_SELECTORS = [chr(c) for c in range(0xFE00, 0xFE10)]
SPECIAL_BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
LIKE_HYPHEN = "\u2010\u2011\ufe63\uff0d"
# Ranges whose compatibility forms read like their plain letters: full-width forms and signs, Latin ligatures,
# Roman numerals, mathematical alphabets.
# Half-width kana and the presentation forms of Arabic letters (but for whole phrases) are such forms, too.
COMPATIBILITY_RANGES = [(0xFF01, 0xFF5E), (0xFFE0, 0xFFE6), (0xFB00, 0xFB06), (0x2160, 0x217F), (0x1D400, 0x1D7FF), (0xFF61, 0xFF9F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC)]
LONGEST_FORM = 3  # characters

# --- fixed values: letters of other scripts that are drawn like a Latin letter ----------------------------------
CYRILLIC_LIKE = dict(zip("АВЕЅІЈКМНОРСТУХԌԚԜҮһԁаеѕіјорсухԛԝҺүӏӀ", "ABESIJKMHOPCTYXGQWYhdaesijopcyxqwHylI"))
GREEK_LIKE = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳϲαρικτυ", "ABEZHIKMNOPTYXovjcapiktu"))
ARMENIAN_LIKE = dict(zip("ՕՍԼօսոհցզ", "OULounhgq"))
CHEROKEE_LIKE = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZVSLCPKB"))
COPTIC_LIKE = dict(zip("ⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬⲭ", "HIKMNOoPpCcTYXx"))
LISU_LIKE = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))
LATIN_LIKE = dict(zip("ɡɑɩʏ", "gaiy"))

_OTHERS = {"C": CYRILLIC_LIKE, "G": GREEK_LIKE, "A": ARMENIAN_LIKE, "K": CHEROKEE_LIKE, "P": COPTIC_LIKE, "U": LISU_LIKE}
_LIKE = {k: v for table in (*_OTHERS.values(), LATIN_LIKE) for k, v in table.items()}
LOOK_ALIKE = frozenset(_LIKE)
_BACK = {s: {v: k for k, v in reversed(list(table.items()))} for s, table in _OTHERS.items()}

_TABLE: dict[int, str | None] = {ord(c): None for c in INVISIBLE}
_TABLE |= {ord(c): None for c in VARIATION_SELECTORS}
_TABLE |= {ord(c): " " for c in SPECIAL_BLANKS}
_TABLE |= {ord(c): "-" for c in LIKE_HYPHEN}
for _a, _b in COMPATIBILITY_RANGES:
    for _c in range(_a, _b + 1):
        if _c not in _TABLE and (_n := unicodedata.normalize("NFKC", chr(_c))) != chr(_c) and len(_n) <= LONGEST_FORM:
            _TABLE[_c] = _n
_TABLE[0xB5] = "μ"


def _as_class(codes: list[int]) -> str:
    """A regular-expression class of the code points, runs joined."""
    out, run = [], [codes[0], codes[0]]
    for c in [*codes[1:], None]:
        if c is not None and c == run[1] + 1:
            run[1] = c
            continue
        out.append(re.escape(chr(run[0])) + (f"-{re.escape(chr(run[1]))}" if run[1] > run[0] else ""))
        run = [c, c]
    return "".join(out)


_LETTERS_FROM_ELSEWHERE = "\u0370-\u052f\u0531-\u058f\u13a0-\u13ff\u1f00-\u1fff\u2c80-\u2cff\ua4d0-\ua4ff" + "".join(LATIN_LIKE)
_SINGLETONS = "\u2126\u212a\u212b"
SUSPECT = re.compile(f"[{_as_class(sorted(_TABLE))}\u0300-\u036f{_SINGLETONS}{_LETTERS_FROM_ELSEWHERE}]")
_ELSEWHERE = re.compile(f"[{_LETTERS_FROM_ELSEWHERE}]")
_TOKEN = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+")


def _script(ch: str) -> str:
    o = ord(ch)
    if 0x400 <= o <= 0x52F:
        return "C"
    if 0x370 <= o <= 0x3FF or 0x1F00 <= o <= 0x1FFF:
        return "G"
    if 0x531 <= o <= 0x58F:
        return "A"
    for name, low, high in (("K", 0x13A0, 0x13FF), ("P", 0x2C80, 0x2CFF), ("U", 0xA4D0, 0xA4FF)):
        if low <= o <= high:
            return name
    return "L" if o < 0x250 or ch in LATIN_LIKE or 0x1E00 <= o <= 0x1EFF else "other"


def resolved_scripts(ch: str) -> frozenset[str]:
    """The scripts in which ch, by its looks, can be read."""
    latin = _LIKE.get(ch, ch)
    own = {_script(ch)}
    if ch in _LIKE or _script(ch) == "L":
        own.add("L")
        own |= {s for s, back in _BACK.items() if latin in back}
    return frozenset(own)


@lru_cache(maxsize=200_000)
def consistent_token(token: str) -> str:
    """The token in the script that all its letters share by their looks; see the module's text."""
    letters = unicodedata.normalize("NFD", token)
    common: frozenset[str] | None = None
    for ch in letters:
        if not unicodedata.combining(ch):
            scripts = resolved_scripts(ch)
            common = scripts if common is None else common & scripts
    if not common or "L" in common or "other" in common:
        spelled = "".join(_LIKE.get(ch, ch) for ch in letters)
    else:
        back = _BACK[min(common)]
        spelled = "".join(back.get(_LIKE.get(ch, ch), ch) for ch in letters)
    return unicodedata.normalize("NFC", spelled)


@lru_cache(maxsize=200_000)
def token_kind(token: str) -> str:
    """mixed: the token's letters are of several scripts; whole: they are all of one script other than Latin, and all drawn like Latin
    letters; plain: neither."""
    letters = [ch for ch in unicodedata.normalize("NFD", token) if not unicodedata.combining(ch)]
    scripts = {_script(ch) for ch in letters}
    if len(scripts) > 1:
        return "mixed"
    return "whole" if scripts and scripts.isdisjoint({"L", "other"}) and all(ch in _LIKE for ch in letters) else "plain"


def script_findings(text: str | None) -> tuple[int, int]:
    """How many tokens of the text are of mixed scripts, and how many wholly of look-alike letters. None and empty: none."""
    if not text or text.isascii() or not _ELSEWHERE.search(text):
        return 0, 0
    kinds = [token_kind(t) for t in _TOKEN.findall(text.translate(_TABLE)) if _ELSEWHERE.search(t)]
    return kinds.count("mixed"), kinds.count("whole")


def _suspicious(text: str) -> bool:
    """If text may hold anything to normalise; texts of Western European letters and signs are told by their bytes."""
    try:
        b = text.encode("cp1252")
    except UnicodeError:
        return SUSPECT.search(text) is not None
    return b"\xa0" in b or b"\xad" in b or b"\xb5" in b


def consistent_form(text: str | None, keep_lines: bool = False) -> str | None:
    """text in consistent form, runs of blanks made one and outer blanks cut. None stays None; empty stays empty.
    keep_lines: a run of blanks with a line break in it becomes the line break instead of a blank."""
    if text is None:
        return None
    if not text.isascii() and _suspicious(text):
        text = unicodedata.normalize("NFC", text.translate(_TABLE))
        if _ELSEWHERE.search(text):
            text = _TOKEN.sub(lambda m: consistent_token(m.group()) if _ELSEWHERE.search(m.group()) else m.group(), text)
    return squeeze(text, keep_lines)


def squeeze(text: str | None, keep_lines: bool = False) -> str | None:
    """Runs of ordinary blanks, tabs and line breaks made one blank, none at the ends."""
    if text is None:
        return None
    if keep_lines:
        lines = [b" ".join(x.split()) for x in text.encode("utf-8", "surrogatepass").split(b"\n")]
        return b"\n".join(x for x in lines if x).decode("utf-8", "surrogatepass")
    return b" ".join(text.encode("utf-8", "surrogatepass").split()).decode("utf-8", "surrogatepass")

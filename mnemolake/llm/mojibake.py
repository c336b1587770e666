"""Text decoded with the wrong character encoding: find it, and restore what can be restored.

Three kinds of damage are told apart.

* *Multibyte*: UTF-8 bytes read as a single-byte charset. Characters are mapped back to the bytes of that
  charset, an automaton over the byte structure of UTF-8 (lead byte, then its continuation bytes) finds
  maximal well-formed spans, and those spans alone are decoded. Repeated until nothing changes, as text
  may have been damaged twice.
* *Single byte*: bytes of one legacy charset read as another. They have no byte structure, so the
  automaton cannot see them; words are judged by their letters instead (see ``_unmix_line``).
* *Lost*: U+FFFD stands where bytes could not be decoded; found, but the original is gone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.session import ship_package

# Charsets by priority; where two give the same span, the first one decides.
CHARSETS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "cp1254")


@cache
def byte_table(charset: str) -> dict[str, int]:
    """Character to byte. Bytes a Windows charset leaves undefined stand for C1 control characters."""
    table = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(charset)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, b)
        if charset.startswith("cp125") and b < 0xA0:
            table.setdefault(chr(b), b)
    return table


@cache
def automaton(charset: str) -> re.Pattern[str]:
    """The byte automaton of UTF-8, its transitions written as characters of ``charset``."""
    table = byte_table(charset)
    cls = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in sorted(table.items(), key=lambda x: x[1]) if lo <= b <= hi) + "]"
    tail = cls(0x80, 0xBF)
    steps = (
        (cls(0xC2, 0xDF), tail),
        (cls(0xE0, 0xE0), cls(0xA0, 0xBF), tail),
        (cls(0xE1, 0xEC), tail, tail),
        (cls(0xED, 0xED), cls(0x80, 0x9F), tail),
        (cls(0xEE, 0xEF), tail, tail),
        (cls(0xF0, 0xF0), cls(0x90, 0xBF), tail, tail),
        (cls(0xF1, 0xF3), tail, tail, tail),
        (cls(0xF4, 0xF4), cls(0x80, 0x8F), tail, tail),
    )
    return re.compile("(?:" + "|".join("".join(s) for s in steps) + ")+")


# Code point ranges in which a decoded character is believed.
_BELIEVED = ((0x80, 0x17F), (0x192, 0x192), (0x2C6, 0x2DD), (0x386, 0x3CE), (0x400, 0x45F), (0x490, 0x491), (0x1E00, 0x1EFF), (0x2010, 0x2044), (0x20A0, 0x20BF), (0x2100, 0x214F), (0x2190, 0x22FF), (0x2500, 0x25FF), (0x2600, 0x27BF), (0xFB01, 0xFB02), (0xFEFF, 0xFEFF), (0xFFFD, 0xFFFD), (0x1F300, 0x1FAFF))
# Scripts without a single-byte charset here; believed only where several characters are decoded together.
_TOGETHER = ((0x5D0, 0x5EA), (0x621, 0x64A), (0x900, 0x97F), (0xE00, 0xE7F), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFF00, 0xFFEF))
# Punctuation that stands after a capital letter in undamaged text.
_AFTER_WORD = frozenset("»”“’‘…—–™°®© «‹›„‚•·№")


# Charsets in which lead bytes are letters too, so that a span of letters alone is no evidence.
_LETTER_LEADS = frozenset(("mac_roman", "cp437", "cp850", "koi8_r"))


def _within(text: str, ranges: tuple) -> bool:
    return all(any(lo <= ord(c) <= hi for lo, hi in ranges) for c in text)


def _decode_span(span: str, charset: str) -> str | None:
    """The text of a well-formed span, or None where it may well be undamaged text."""
    table = byte_table(charset)
    text = bytes(table[c] for c in span).decode("utf-8")
    if not _within(text, _BELIEVED) and not (len(text) > 1 and _within(text, _BELIEVED + _TOGETHER)):
        return None
    if charset == "cp1251" and len(text) == 1 and span.isalpha():
        return None
    if charset in _LETTER_LEADS and span.isalpha() and not _within(text, ((0x2010, 0x2044), (0x20A0, 0x20BF))):
        return None
    if len(text) == 1 and len(span) == 2 and span[1] in _AFTER_WORD and span[0].isalpha():
        lead = table[span[0]]
        # a lone capital and a closing mark: only the leads that Western text damages into are believed
        if charset in ("cp1251", "koi8_r") or lead not in (0xC2, 0xC3, 0xC4, 0xC5) or not text.isalpha() and text not in "×÷" and lead != 0xC2:
            return None
    return text


def decode_spans(text: str) -> str:
    """One layer: decode the maximal well-formed spans of the charset that explains most bytes, so leaves
    the fewest characters; of equals the first."""
    layers = [automaton(c).sub(lambda m, c=c: m[0] if (t := _decode_span(m[0], c)) is None else t, text) for c in CHARSETS]
    return min([text, *layers], key=len)


# Fixed values: (charset the bytes were read as, charset they were written in).
SINGLE_BYTE = (("cp1252", "mac_roman"), ("cp1252", "cp1250"), ("cp1251", "koi8_r"), ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("koi8_r", "cp1251"), ("cp1252", "cp850"), ("mac_roman", "cp1252"))
# Letters beyond ASCII of the languages that are told apart.
ALPHABETS = ("äöüß", "àâæçéèêëîïôœùûüÿ", "áéíóúüñ", "ãõáâàçéêíóôú", "ąćęłńóśźż", "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "åäöéæø", "áčďéěíňóřšťúůýž")
# Marks that may stand at the edges of a word, and inside it.
_EDGE = frozenset("«»‹›“”„‘’‚…—–¿¡°€£×µ·•№§©®™±\u00a0¹²³½¼¾ºª")
_INSIDE = frozenset("’‘-–—·\u00a0…")

_RUN = re.compile(r"[^\x00-\x7f]{2,}")
_PLAIN = re.compile(r"[\x00-\x7f]*\Z")
_WORD = re.compile(r"[^\s\xa0]*[^\x00-\x7f\xa0][^\s\xa0]*")
#: What the automaton leaves and undamaged text seldom has: worth a look word by word.
_ODD = re.compile(r"[\x80-\x9f]|[^\W\d_][^\w\s’‘–·…\xa0\x00-\x7f][^\W\d_]|[a-zà-öø-ÿ][À-ÖØ-ÞŠŒŽŸ]|[а-яё][А-ЯЁ]|[À-ÖØ-öø-ÿ]{3}|[^\W\d_][³¹ˆ‰‡›‹][^\W\d_]")


@lru_cache(maxsize=100_000)
def _fix_run(run: str) -> str:
    """All layers of damage undone; every layer makes the run shorter, so this ends."""
    while (better := decode_spans(run)) != run:
        run = better
    return run


def _fix_match(m: re.Match[str]) -> str:
    better = _fix_run(m[0])
    before = m.string[max(0, m.start() - 2) : m.start()]
    # a small letter at the end of a word in capitals is a capital and a closing mark after all
    return m[0] if len(m[0]) == len(before) == 2 and better.islower() and before.isalpha() and before.isupper() else better


@cache
def _remap(read_as: str, written_in: str) -> dict[int, str]:
    """Character read to character meant."""
    table = {}
    for c, b in byte_table(read_as).items():
        try:
            table[ord(c)] = bytes([b]).decode(written_in)
        except UnicodeDecodeError:
            table[ord(c)] = c
    return table


@lru_cache(maxsize=100_000)
def _plausible(word: str) -> bool:
    """Letters of one language, in sane case, with marks only where marks stand."""
    core = word.strip("".join(_EDGE) + "().,:;!?\"'[]{}<>*/_-")
    odd = {c for c in core if ord(c) > 127}
    if not odd:
        return True
    letters = {c for c in odd if c.isalpha() and c not in "ºª"}
    if not (odd - letters) <= _INSIDE or any(0x80 <= ord(c) < 0xA0 for c in word):
        return False
    small = {c.lower() for c in letters}
    if not any(small <= set(a) for a in ALPHABETS):
        return False
    if any(ord(c) >= 0x400 for c in letters) and re.search("[A-Za-z]", core):
        return False
    return not any(x.islower() and y.isupper() and (ord(x) > 127 or ord(y) > 127) for x, y in zip(core, core[1:]))


@lru_cache(maxsize=100_000)
def _damaged_word(word: str) -> bool:
    """Evidence in the word itself: no language writes it so."""
    if re.search(r"[^\W\d_]—[a-zà-ÿ]{1,2}\b", word) and not re.search(r"—.*—", word):
        return True
    return not _plausible(word)


@lru_cache(maxsize=100_000)
def _better_word(word: str, read_as: str, written_in: str) -> str | None:
    meant = word.translate(_remap(read_as, written_in))
    return meant if meant != word and _plausible(meant) and any(c.isalpha() and ord(c) > 127 for c in meant) else None


def _best_pair(damaged: list[str], words: list[str]) -> tuple[int, tuple[str, str]]:
    """How many of the damaged words the pair of charsets repairs that repairs most; of equals the one whose
    letters fit one language best, then the first."""
    scores = []
    for k, pair in enumerate(SINGLE_BYTE):
        fixed = [_better_word(w, *pair) for w in words]
        letters = [{c.lower() for c in w if c.isalpha() and ord(c) > 127} for w in fixed if w is not None]
        scores.append((sum(_better_word(w, *pair) is not None for w in damaged), max(sum(x <= set(a) for x in letters) for a in ALPHABETS), -k))
    most, _, k = max(scores)
    return most, SINGLE_BYTE[-k]


def _has_letter(word: str) -> bool:
    return any(c.isalpha() and ord(c) > 127 for c in word)


@lru_cache(maxsize=100_000)
def _repairable(word: str) -> bool:
    """Some pair of charsets repairs the word, which is more than a sign and has no bytes of UTF-8 in it."""
    return any(c.isalpha() for c in word) and not automaton("cp1252").search(word) and any(_better_word(word, *pair) is not None for pair in SINGLE_BYTE)


def _whole_line(words: list[str], pair: tuple[str, str]) -> dict[str, str]:
    """The pair applied to all words that stay plausible under it, and to signs."""
    out = {}
    for w in words:
        better = _better_word(w, *pair)
        if better is None:
            meant = w.translate(_remap(*pair))
            better = meant if not _has_letter(meant) and _plausible(meant) and not _plausible(w) else None
        if better is not None:
            out[w] = better
    return out


def _unmix_line(line: str) -> str:
    """Undo single-byte mix-ups. Without a damaged word nothing changes.

    The pair of charsets that explains half of the damaged words or more is applied to all words of the line
    that stay plausible under it. What it leaves is judged for each script by the words that some pair
    repairs, so signs do not count: the pair that explains two of them and half or more is applied to the
    rest of the script, and the others are repaired word by word. Where words of a language not told apart
    here outnumber them, only those damaged inside are.
    """
    words = _WORD.findall(line)
    odd = [w for w in words if _damaged_word(w)]
    if not odd:
        return line
    most, pair = _best_pair(odd, words)
    changes = _whole_line(words, pair) if most and most * 2 >= len(odd) else {}
    for cyrillic in (False, True):
        rest = [w for w in words if w not in changes and any("\u0400" <= c <= "\u04ff" for c in w) == cyrillic]
        bad = [w for w in rest if _damaged_word(w)]
        left = [w for w in bad if _repairable(w)]
        if alone := sum(map(_has_letter, bad)) > 2 * len(left):
            left = [w for w in left if _ODD.search(w)]
        count, first = len(left), True
        while left:
            most, pair = _best_pair(left, left)
            if first and not alone and most > 1 and most * 2 >= count:
                changes |= _whole_line(rest, pair)
            else:
                changes |= {w: better for w in left if (better := _better_word(w, *pair)) is not None}
            left, first = [w for w in left if w not in changes], False
    return _WORD.sub(lambda m: changes.get(m[0], m[0]), line)


def restored_by(text: str | None) -> tuple[str | None, str]:
    """The restored text, and the ways that found something: ``bytes`` (the automaton), ``letters`` (single-byte
    mix-ups, word by word) and ``lost`` (U+FFFD, which stays), joined by ``+``."""
    if text is None or _PLAIN.match(text):
        return text, ""
    decoded = _RUN.sub(_fix_match, text)
    out = decoded
    if _ODD.search(out):
        out = "\n".join(_unmix_line(x) if _ODD.search(x) else x for x in out.split("\n"))
    found = (("bytes", decoded != text), ("letters", out != decoded), ("lost", "\ufffd" in text))
    return out, "+".join(name for name, yes in found if yes)


def restore(text: str | None) -> str | None:
    """The text with every decodable span restored; null stays null, U+FFFD stays where it stands."""
    return restored_by(text)[0]


def is_damaged(text: str | None) -> bool:
    return restored_by(text)[1] != ""


def repair_encoding(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with text from a wrong decoding: id, restored text, whether all of it came back, and by which
    ``route`` (see ``restored_by``).

    Rows without a character beyond ASCII are left out before Python sees them; the rest streams through
    in Arrow batches, without a shuffle, so one source or one very long text skews nothing.

    Defined cases: null and empty texts are undamaged; complete is false where U+FFFD remains; repeated
    rows are each reported; other columns are ignored; an empty table gives an empty result.
    """
    ship_package(documents.sparkSession)
    schema = f"{id_col} {dict(documents.dtypes)[id_col]}, restored string, complete boolean, route string"

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fixed = [restored_by(t) for t in b.column(1).to_pylist()]
            keep = [i for i, (_, route) in enumerate(fixed) if route]
            out, routes = [fixed[i][0] for i in keep], [fixed[i][1] for i in keep]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int32())), pa.array(out, pa.string()), pa.array(["\ufffd" not in x for x in out], pa.bool_()), pa.array(routes, pa.string())], names=[id_col, "restored", "complete", "route"])

    return documents.where(F.col(text_col).rlike(r"[^\x00-\x7F]")).select(id_col, text_col).mapInArrow(op, schema)

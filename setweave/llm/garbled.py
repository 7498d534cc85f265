"""Text that was decoded with the wrong character encoding: found, and restored by a round trip where that is possible.

A candidate repair encodes the text in the encoding that was wrongly assumed and decodes the bytes strictly in the one
that was meant; it is repeated for nested layers. It counts only if the *garbling cost* of the text drops. The cost is a
sum over neighbouring characters (control characters, symbols next to letters, capitals within words, runs of accented
letters, letters of different scripts side by side, rare ideographs), so it needs neither a language nor a corpus.
Garbling that hides in character references (``&#195;&#169;``) or, of a URI, in percent codes is looked for as well.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Encodings that UTF-8 is wrongly read in.
ASSUMED = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r", "cp866", "iso8859_2", "cp1254", "cp1253")
#: Encodings other than UTF-8 that text is meant in while it is read in a Western one.
ONE_BYTE = ("cp1251", "koi8_r", "cp866", "cp1253", "cp1256")
MORE_BYTES = ("gb18030", "euc_jp", "shift_jis", "euc_kr", "big5")
WESTERN = ("cp1252", "latin-1")
#: Cyrillic encodings that are mistaken for one another.
CYRILLIC = (("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"))
#: The drop of the cost that a repair into UTF-8 needs, except for single letters (LEAST_DROP_LETTER).
LEAST_DROP = 1.0
#: The drop that a repair into another encoding than UTF-8 needs, whose decoding proves less.
LEAST_DROP_OTHER = 2.0
#: The drop of single letters whose surroundings show that they were garbled: the least there is.
LEAST_DROP_LETTER = 0.25
#: Encodings of which a letter within a Latin word needs no drop.
OF_OTHER_SCRIPTS = ("cp1251", "cp1253")
#: Cost from which a text without a repair is still reported: controls from lost bytes.
HOPELESS = 6.0


def _table(encoding: str) -> dict[str, int]:
    """Characters of the upper half of a one-byte encoding; bytes it leaves out stand for the control of that number."""
    out = {}
    for byte in range(0x80, 0x100):
        try:
            out[bytes([byte]).decode(encoding)] = byte
        except UnicodeDecodeError:
            out[chr(byte)] = byte
    return out


TABLES = {e: _table(e) for e in {*ASSUMED, *WESTERN, *(a for a, _ in CYRILLIC)}}


def _chars(table: dict[str, int], low: int, high: int) -> str:
    return "[" + re.escape("".join(c for c, b in table.items() if low <= b <= high)) + "]"


def _utf8_pattern(table: dict[str, int]) -> str:
    follow = _chars(table, 0x80, 0xBF)
    return f"{_chars(table, 0xC2, 0xDF)}{follow}|{_chars(table, 0xE0, 0xEF)}{follow}{{2}}|{_chars(table, 0xF0, 0xF4)}{follow}{{3}}"


LETTER_IN = {e: re.compile(_chars(TABLES[e], 0xC3, 0xC8) + _chars(TABLES[e], 0x80, 0xBF)) for e in ASSUMED}
UTF8_IN = {e: re.compile(f"(?:{_utf8_pattern(TABLES[e])})+") for e in ASSUMED}
#: Encodings whose characters for the bytes from 0xE0 on, or for those that follow, are common letters of other languages.
AMBIGUOUS = ("cp437", "cp850", "mac_roman", "koi8_r", "cp866", "cp1253")
#: Runs that hardly happen to be UTF-8: three sequences of two bytes, or two of three.
_STRONG_IN = {
    e: re.compile(f"(?:{_chars(t, 0xC2, 0xDF)}{_chars(t, 0x80, 0xBF)}){{3}}" + (f"|(?:{_chars(t, 0xE0, 0xEF)}{_chars(t, 0x80, 0xBF)}{{2}}){{2}}" if e not in AMBIGUOUS else ""))
    for e, t in ((e, TABLES[e]) for e in ASSUMED if e != "cp850")
}
_WEST = "".join(sorted({c for e in WESTERN for c in TABLES[e]}))
_CYR = "Ѐ-ӿ─-╿▀-▟"
#: First words of the names of digits that are in use beside those of ASCII.
DIGITS_OF = frozenset("FULLWIDTH ARABIC-INDIC EXTENDED DEVANAGARI BENGALI THAI CIRCLED CJK IDEOGRAPHIC SUPERSCRIPT SUBSCRIPT ROMAN VULGAR".split())
#: What a text must have for a repair to be tried at all.
SUSPECT = re.compile("[�\x80-\x9f-ƒ]|[" + re.escape(_WEST) + "]{2}|" + "|".join(f"{_chars(TABLES[e], 0xC2, 0xF4)}{_chars(TABLES[e], 0x80, 0xBF)}" for e in ASSUMED if e not in ("latin-1", "cp1252")))
#: Characters around a letter that its words are looked for in.
NEARBY = 40
_WORD_BEFORE, _WORD_AFTER = re.compile(r"\w+(?=[\W_]*$)"), re.compile(r"[\W_]*[^\W_]+")
_W = "[" + re.escape(_WEST) + "]"
_WORD_RUN = re.compile(rf"(?<![A-Za-z]){_W}{{3,}}(?![A-Za-z])")
_PAIRS_RUN = re.compile(rf"{_W}{{4,}}|(?<=[぀-鿿가-힣]){_W}{{2,}}|{_W}{{2,}}(?=[぀-鿿가-힣])")
_HIGH = re.compile(_W)
_TOKEN = re.compile(r"[^\s/_+:?&=]+")
_KANA_AS_TEXT = re.compile("ƒ[!-~](?:[!-~]?ƒ[!-~])+")
_CYRILLIC_RUN = re.compile(f"[{_CYR}]{{3,}}")

#: Punctuation that stands next to letters in ordinary text.
_PLAIN = frozenset("«»“”„‟‘’‚‹›…–—¡¿·•。、「」『』《》〈〉！？，：；（）　\xa0­ー〜・")
_CONTROL, _LOWER, _UPPER, _DIGIT, _SPACE, _ASCII_MARK, _MARK, _SYMBOL, _OTHER = range(9)


@lru_cache(maxsize=1 << 16)
def _kind(c: str) -> tuple[int, str, float]:
    """Class, script and own cost of a character."""
    o = ord(c)
    if o < 0x80:
        if c.isalpha():
            return (_LOWER if c.islower() else _UPPER), "a", 0.0
        return (_DIGIT if c.isdigit() else _SPACE if c.isspace() else _ASCII_MARK), "", 0.0
    cat = unicodedata.category(c)
    if c == "�" or cat in ("Cc", "Co", "Cn", "Cs"):
        return _CONTROL, "", 3.0
    if c in _PLAIN or cat[0] == "Z":
        return _MARK, "", 0.0
    if cat[0] in "PS" or cat in ("No", "Cf") or c in "ªºµƒˆ˜":
        return _SYMBOL, "", 0.0
    if cat[0] == "N":
        return _DIGIT, "", (0.0 if unicodedata.name(c, "?").split()[0] in DIGITS_OF else 1.0)
    if cat[0] == "M":
        return _OTHER, "m", 0.0
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return (_UPPER if c.isupper() else _LOWER), "l", (1.0 if 0x180 <= o < 0x250 and c not in "ƠơƯưȘșȚțƏə" else 0.0)
    if 0x370 <= o < 0x400:
        return (_UPPER if c.isupper() else _LOWER), "g", 0.0
    if 0x400 <= o < 0x530:
        return (_UPPER if c.isupper() else _LOWER), "c", (0.0 if 0x410 <= o < 0x450 or c in "ёЁіІїЇєЄґҐўЎјЈљњћђџЉЊЋЂЏ" else 1.5)
    if 0x3040 <= o < 0x3100:
        return _OTHER, "k", 0.0
    if 0xFF61 <= o < 0xFFA0:
        return _OTHER, "k", 1.0
    if 0x4E00 <= o < 0xA000:
        return _OTHER, "h", (0.0 if _common_ideograph(c) else 1.5)
    if 0xAC00 <= o < 0xD7A4:
        return _OTHER, "o", (0.0 if _encodes(c, "euc_kr") else 1.5)
    if cat[0] == "L" and (0x3400 <= o < 0x4E00 or o >= 0x10000 or 0xA000 <= o < 0xAC00):
        return _OTHER, "x", 1.5
    return _OTHER, unicodedata.name(c, "?")[:5], 0.0


def _encodes(c: str, encoding: str) -> bytes | None:
    try:
        return c.encode(encoding)
    except UnicodeEncodeError:
        return None


def _levels(c: str) -> tuple[bool, bool, bool]:
    """Which national standards have an ideograph among their frequent characters (the first level)."""
    gb, big5, jis = (_encodes(c, e) or b"\0" for e in ("gb2312", "big5", "euc_jp"))
    return 0xB0 <= gb[0] <= 0xD7, 0xA4 <= big5[0] <= 0xC6, len(jis) == 2 and 0xB0 <= jis[0] <= 0xCF


def _common_ideograph(c: str) -> bool:
    return any(_levels(c))


_LETTERS = (_LOWER, _UPPER, _OTHER)
#: Scripts whose letters may stand side by side.
_MIXED = {(a, b): 0.0 for group in ("al", "hka", "oa", "c", "g") for a in group for b in group} | {("m", x): 0.0 for x in ("m", "DEVAN", "ARABI", "HEBRE", "BENGA", "TAMIL", "TELUG", "THAI ")}
_MIXED |= {(b, a): 0.0 for a, b in _MIXED}


def _ordinary_pair(before: int, first: int, second: int, after: int) -> bool:
    """Whether two accented letters in a row are ordinary for where they stand: coração, CORAÇÃO, Łódź."""
    if first == second:
        return first in (before, after) or first == _LOWER and before == _UPPER if first == _LOWER or after != _LOWER != before else False
    return first == _UPPER and before not in (_LOWER, _UPPER) and after != _UPPER


def cost(text: str) -> float:
    """How garbled ``text`` looks; 0 for ordinary text, and never more than a few units for unusual one."""
    total, last, last_script, last_ascii, bridge = 0.0, _SPACE, "", True, False  # bridge: a mark right after a letter
    run, before, first = 0, _SPACE, _SPACE  # accented letters in a row, what stands before them, and the first's case
    for c in text:
        kind, script, own = _kind(c)
        total += own
        plain = c < "\x80"
        if script == "l":
            run, before, first = (run + 1, before, first) if run else (1, last if last_ascii else _SPACE, kind)
        elif run:
            total -= run == 2 and _ordinary_pair(before, first, last, kind)
            run = 0
        if not plain or not last_ascii:
            letter, was = kind in _LETTERS, last in _LETTERS
            if letter and was:
                if script != last_script:
                    total += _MIXED.get((last_script, script), 1.0)
                elif script == "l":
                    total += 1.0
            elif kind == _SYMBOL:
                total += 0.75 if was or (last in (_SYMBOL, _MARK) and not last_ascii) else 0.0
            elif last == _SYMBOL and (letter or kind == _MARK):
                total += 0.75 if letter else 0.25
            elif kind == _MARK and was and last_script == "l":
                total += 0.25
                bridge = c != "’"
            elif kind == _MARK and was:
                bridge = c in "«»¡¿…"
            elif letter and last == _MARK:
                total += 0.75 if bridge else 0.25 if script == "l" else 0.0
            bridge = bridge and kind == _MARK
        else:
            bridge = False
        last, last_script, last_ascii = kind, script, plain
    return total - (run == 2 and _ordinary_pair(before, first, last, _SPACE))


@lru_cache(maxsize=1 << 16)
def _foreign(c: str) -> float:
    """A small cost of ideographs that not all standards have among their frequent ones, and of Hangul."""
    return 0.05 * (3 - sum(_levels(c))) if "\u4e00" <= c < "\ua000" else 0.15 if "\uac00" <= c < "\ud7a4" else 0.0


def _oddity(text: str) -> float:
    """A small cost that tells apart decodings which differ in case or language: capitals after the first letter of a
    word, and ideographs that are frequent in one country only."""
    return 0.1 * sum(1 for a, b in zip(text, text[1:]) if b.isupper() and a.isalpha() and b > "\x7f") + sum(map(_foreign, text))


def _bytes(run: str, table: dict[str, int]) -> bytes | None:
    try:
        return bytes(table[c] for c in run)
    except KeyError:
        return None


def _as_utf8(text: str, encoding: str) -> str | None:
    table = TABLES[encoding]

    def back(m: re.Match) -> str:
        try:
            return bytes(table[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    out = UTF8_IN[encoding].sub(back, text)
    return out if out != text else None


def _lower_nearby(before: str, after: str) -> bool:
    """Whether the word before or after has a small letter."""
    words = (_WORD_BEFORE.search(before), _WORD_AFTER.match(after))
    return any(c.islower() for w in words if w for c in w.group())


def _plausible(new: str, first: str, follow: str, before: str, after: str, encoding: str) -> bool:
    """Whether ``first`` and ``follow`` are the letter ``new`` garbled, by the text around them.

    In capitals, and alone, a real letter may stand before a closing quote or a no-break space, as in «IRMÃ».
    """
    kind, script, own = _kind(new)
    if script != "l" or own:
        return False
    lower, last, (was, of, _) = kind == _LOWER, before[-1:], _kind(first)
    alone = not last.isalnum() and not after[:1].isalnum()
    if of in ("c", "g"):  # a letter of another script within or at the end of a Latin word
        return "a" <= last.lower() <= "z" and (_kind(follow)[1] != of or "a" <= after[:1].lower() <= "z") or lower and "a" <= after[:1].lower() <= "z"
    if was == _SYMBOL:  # lines of boxes and roots don't stand before one letter or shade
        return lower or last.isalpha() or after[:1].isalpha()
    if last.islower():
        return lower and not (first.islower() and of == "l" and _kind(follow)[0] == _MARK)
    if not first.isupper() or of != "l" or TABLES[encoding].get(first) != 0xC3:
        return False
    symbol = _kind(follow)[0] == _SYMBOL
    if last.isalpha() and before[-2:-1].isalpha():
        return symbol and last.isupper() and not lower and not after[:1].isdigit()
    if symbol:
        return not after.lstrip()[:1].isdigit() and (not last.isalpha() or _lower_nearby(before, after) or not lower)
    return lower and follow in "\xa0\xad¡" and not after[:1].isalnum() and (_lower_nearby(before, after) or alone and follow == "\xad")


def _letters_as_utf8(text: str, encoding: str) -> str | None:
    table, out, end = TABLES[encoding], "", 0
    for m in LETTER_IN[encoding].finditer(text):
        out += text[end : m.start()]
        first, follow = m.group()
        new = bytes((table[first], table[follow])).decode("utf-8")
        out += new if _plausible(new, first, follow, out[-NEARBY:], text[m.end() : m.end() + NEARBY], encoding) else m.group()
        end = m.end()
    out += text[end:]
    return out if out != text else None


def _as_other(text: str, assumed: str, meant: str, piece: re.Pattern) -> str | None:
    table = TABLES[assumed]

    def back(m: re.Match) -> str:
        run = m.group()
        if piece is _TOKEN and len(_HIGH.findall(run)) < 3 and not _KANA_AS_TEXT.search(run):
            return run
        raw = bytearray()
        for c in run:
            if c < "\x80":
                raw.append(ord(c))
            elif c in table:
                raw.append(table[c])
            else:
                return run
        try:
            new = bytes(raw).decode(meant)
        except UnicodeDecodeError:
            return run
        return new if cost(new) + 1 <= cost(run) else run

    out = piece.sub(back, text)
    return out if out != text else None


def _from_utf8(text: str) -> Iterator[tuple[str, str, float]]:
    for e in ASSUMED:
        if (new := _as_utf8(text, e)) is not None:
            yield f"utf-8 as {e}", new, 0.0 if e in _STRONG_IN and _STRONG_IN[e].search(text) else LEAST_DROP


def _from_letters(text: str) -> Iterator[tuple[str, str, float]]:
    for e in ASSUMED:
        if (new := _letters_as_utf8(text, e)) is not None:
            yield f"utf-8 as {e}", new, 0.0 if e in OF_OTHER_SCRIPTS else LEAST_DROP_LETTER


def _from_others(text: str) -> Iterator[tuple[str, str, float]]:
    tries = [(w, m, _WORD_RUN) for w in WESTERN for m in ONE_BYTE] if _WORD_RUN.search(text) else []
    if _PAIRS_RUN.search(text):
        tries += [(w, m, _PAIRS_RUN) for w in WESTERN for m in MORE_BYTES if m != "shift_jis"]
    if "ƒ" in text or len(_HIGH.findall(text)) >= 3:
        tries += [(w, m, _TOKEN) for w in WESTERN for m in ("shift_jis", "gb18030", "big5")]
    if _CYRILLIC_RUN.search(text):
        tries += [(w, m, _CYRILLIC_RUN) for w, m in CYRILLIC]
    for w, m, piece in tries:
        if (new := _as_other(text, w, m, piece)) is not None:
            yield f"{m} as {w}", new, LEAST_DROP_OTHER


def _undo(text: str, kinds: tuple) -> tuple[float, str, list[str]]:
    """Layers are undone while the cost drops (or the text, which then gets shorter, is UTF-8 beyond doubt)."""
    layers: list[str] = []
    now = cost(text)
    while True:
        for tries in kinds:
            found = [(c + _oddity(new), i, how, new, c) for i, (how, new, least) in enumerate(tries(text)) if (c := cost(new)) <= now - least]
            if found:
                break
        else:
            return now, text, layers
        _, _, how, text, now = min(found)
        layers.append(how)


def repair(text: str) -> tuple[str, list[str]]:
    """``text`` with every layer of wrong decoding undone for which the cost drops, and the layers, outermost first.

    Bytes that are UTF-8 are hardly so by chance, so that is tried first; where it leaves garbling, the other encodings
    are tried first, and the cheaper result counts. Single letters that cost little come last, by what is around them.
    """
    left, new, layers = _undo(text, (_from_utf8, _from_others, _from_letters))
    if left > 0 or len(layers) > 1 and not any(p.search(text) for p in _STRONG_IN.values()):
        other = _undo(text, (_from_others, _from_utf8, _from_letters))
        if other[0] < left or other[0] == left and len(other[2]) < len(layers):
            _, new, layers = other
    return new, layers


_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")


def unpercent(uri: str) -> str:
    """``uri`` with the percent-encoded runs decoded that are UTF-8; others stay as they are."""

    def back(m: re.Match) -> str:
        try:
            return unquote_to_bytes(m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return _PERCENT.sub(back, uri)


_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")

#: An ampersand written as a reference once or many times over.
_NESTED = re.compile(r"&(?:(?:amp|AMP|#0*38|#[xX]0*26);)+")


def resolved(text: str) -> str:
    """``text`` with its character references resolved, also those that are written as references themselves."""
    text = _NESTED.sub("&", text)
    while _REFERENCE.search(text) and (new := unescape(text)) != text:
        text = new
    return text


def examine(text: str, percent: bool = False) -> tuple[str | None, str, list[str]] | None:
    """``(repaired, status, layers)`` of a garbled value, None for one that isn't.

    status: ``restored``; ``partly`` where garbling is left; ``lost`` where nothing could be restored (characters were
    replaced when it was decoded). Garbling counts as well if it shows only once character references are resolved;
    with ``percent`` the value is a URI that may hide it in percent codes.
    """
    plain = unpercent(text) if percent and "%" in text else text
    plain = resolved(plain) if "&" in plain else plain
    if plain.isascii() or not SUSPECT.search(plain):
        return None
    before = cost(plain)
    if before < 0.75 and next(_from_letters(plain), None) is None and not any(p.search(plain) for p in _STRONG_IN.values()):
        return None
    new, layers = repair(plain)
    if layers:
        return new, ("partly" if cost(new) > 0 else "restored"), layers
    if "\ufffd" in plain or any("\x80" <= c <= "\x9f" for c in plain) and before >= HOPELESS:
        return None, "lost", []
    return None


def _run(percent: bool):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, was, now, status, layers = [], [], [], [], []
            rec, texts = batch.column(0), batch.column(1).to_pylist()
            for i, text in enumerate(texts):
                if hit := examine(text, percent):
                    ids.append(i)
                    was.append(text)
                    now.append(hit[0])
                    status.append(hit[1])
                    layers.append(hit[2])
            if ids:
                yield pa.RecordBatch.from_arrays([rec.take(pa.array(ids)), pa.array(was, pa.string()), pa.array(now, pa.string()), pa.array(status, pa.string()), pa.array(layers, pa.list_(pa.string()))], ["id", "value", "repaired", "status", "layers"])

    return over


def _worth_a_look(value: Column, percent: bool) -> Column:
    """Values of ASCII without references or codes can't be garbled; they don't leave the JVM."""
    look = value.rlike(r"[^\x00-\x7F]|&#?[0-9A-Za-z]+;")
    return look | value.rlike("%[89A-Fa-f]") if percent else look


def find_garbled(rows: DataFrame, id_col: str, text_col: str, percent: bool = False) -> DataFrame:
    """``id_col, value, repaired, status, layers`` of the garbled values of a column; no shuffle.

    ``repaired`` is the original text as far as it could be restored (of a URI the percent-decoded form), null where
    nothing could. Null and empty values aren't garbled. Repeated rows come out each.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    seen = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("value")).where(_worth_a_look(F.col("value"), percent))
    return seen.mapInArrow(_run(percent), f"id {kind}, value string, repaired string, status string, layers array<string>").withColumnRenamed("id", id_col)

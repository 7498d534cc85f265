"""Sentence boundaries in any language and script.

Characters have the classes of the Unicode standard's sentence segmentation (UAX #29: STerm, ATerm, Close, Sp, Sep,
SContinue, Lower, Upper, OLetter, Numeric, Extend, Format), taken for all planes from the tables of the library
``regex``, whose release pins their version. The standard's rules are applied in its order and extended where it leaves
the choice to languages: abbreviations are suppressed by the language of the text, quotations and brackets that the
sentence goes on after end nothing. Text is read once; only marks, quotes, brackets and line ends are looked at.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = ("Other", "STerm", "ATerm", "Close", "Sp", "Sep", "SContinue", "Lower", "Upper", "OLetter", "Numeric", "Extend", "Format")
OTHER, STERM, ATERM, CLOSE, SP, SEP, SCONTINUE, LOWER, UPPER, OLETTER, NUMERIC, EXTEND, FORMAT = range(len(CLASSES))
LETTERS = (LOWER, UPPER, OLETTER)


def _properties() -> bytearray:
    """The sentence break class of every code point; line ends count as Sep."""
    out = bytearray(0x110000)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for k, name in enumerate(CLASSES):
        if k:
            for c in regex.findall(rf"\p{{SB={name}}}", everything):
                out[ord(c)] = k
    out[0x0A] = out[0x0D] = SEP
    return out


CLASS = _properties()
#: Marks of a pause: no terminators by the standard, but a sentence may end with them.
ELLIPSES = "…⋯"
STRONG = frozenset(chr(o) for o, k in enumerate(CLASS) if k == STERM)
MARKS = STRONG | {chr(o) for o, k in enumerate(CLASS) if k == ATERM} | set(ELLIPSES)
#: Terminators that may also stand within a web address, or within a sentence after a name.
LATIN_STRONG = frozenset("!?‼⁇⁈⁉‽")
#: Quotation marks with what closes them; some open in one language and close in another.
QUOTES = {"“": "”", "„": "“”", "‟": "”", "«": "»", "»": "«»", "‹": "›", "›": "‹", "「": "」", "『": "』", "‘": "’", "‚": "‘’", "〈": "〉", "《": "》", "〝": "〞〟", "”": "”", '"': '"', "﹁": "﹂", "﹃": "﹄", "｢": "｣"}
#: Opening brackets, each with the closing one that follows it in the standard's order.
BRACKETS = {c: p for o in range(0x10000) if unicodedata.category(c := chr(o)) == "Ps" and c not in QUOTES for p in map(chr, (o + 1, o + 2)) if unicodedata.category(p) == "Pe"}
CLOSES = {**QUOTES, **BRACKETS}
CLOSERS = frozenset("".join(CLOSES.values())) | {"'", "’", "＂"}

#: Spaces that don't separate, and the closing quotes that French sets off by them.
NO_BREAK = ("\xa0", "\u202f")
SPACED = ("»", "›")

#: By language: abbreviations after which a sentence goes on whatever follows (capitals are needed where written), those
#: that do so before a number or Roman numeral only, those that may stand last in a sentence and go on only before a
#: small letter, and those of two parts that are also written with a space between them.
ABBREVIATIONS = {
    "en": ("Mr Mrs Ms Dr Prof Gen St Mt Col Capt Lt Sgt Rev Hon Gov Sen Rep Messrs vs cf ca approx e.g i.e viz figs eq", "no p pp vol art fig ch sec tel", "etc inc ltd co corp jr a.m p.m u.s", "e.g i.e a.m p.m"),
    "de": ("Hr Fr Frl Prof Dr St Dipl Ing z.b d.h u.a.m bzw vgl ca evtl ggf hrsg abb s.o sog inkl geb", "nr no s art fig kap abs bd tel", "etc usw u.a", "z.B d.h u.a s.o v.Chr n.Chr"),
    "fr": ("M MM Mme Mmes Mlle Dr Pr Prof St Ste Mgr Me av env p.ex c.-à-d chap éd cf", "no n p pp art vol fig ch tel", "etc j.-c s.a", "p.ex J.-C S.A"),
    "es": ("Sr Sra Srta Dr Dra Dña Prof Sto Sta Ud Uds EE p.ej ej aprox cf", "no nos núm num n p pp pág pag pags art vol fig cap sec tel", "etc ee.uu a.c d.c s.a", "a.C d.C p.ej EE.UU FF.AA S.A"),
    "pt": ("Sr Sra Dr Dra Eng Prof Profa p.ex aprox cf", "no núm num n p pp pág pag art vol fig cap sec séc tel", "etc ltda a.c d.c s.a", "a.C d.C p.ex S.A"),
    "it": ("Dott Sig Sigg Sig.ra Dott.ssa Prof Ing Avv On Dr cfr p.es", "no n p pp pag art vol fig cap sec tel", "etc ecc s.p.a a.c d.c", "a.C d.C p.es"),
    "ru": ("св ул акад им проф т.е ок напр тов обл просп см ср млн млрд тыс", "стр № с", "др т.д т.п проч руб", "т.е т.д т.п т.к н.э"),
    "hi": ("डॉ श्री प्रो सं पं कु", "क्र", "", ""),
    "ar": ("أ م د ج ق", "ص", "", ""),
    "ko": ("Prof Dr", "", "", ""),
}
#: Abbreviations that are also common words, so only a small letter or a number after them tells.
EITHER = frozenset("в с е es in ed am a ex no тыс".split())
#: Russian abbreviations of year and century, which close a sentence after a number but precede a name.
YEARS = frozenset("г гг вв".split())
#: What follows a German ordinal number.
GERMAN_AFTER = frozenset("Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jahrhundert Jahrhunderts Jahrtausend Mal Tag Klasse Auflage Kapitel Stock Platz Jh".split())
#: Frequent words that tell the language of a paragraph in Latin letters.
FREQUENT = {
    "en": "the of and a an in on to by with which from for was is are every into near some that under over such as said",
    "de": "der die das und mit von ist nicht ein eine einer zu den dem des im in auf für auch wie vor nach bei aus über unter zwischen jede sagte",
    "fr": "le la les un une et de des du dans avec sur par pour ses son chez entre vers sous dont que est dit comme tels",
    "es": "el la los las un una y de del en con por para que como cada desde entre sobre hasta sin su dijo tales",
    "pt": "o a os as um uma e de do da dos em com por para que como cada entre sobre até sem desde não seu disse tais",
    "it": "il lo la le gli i un una e di dei della in con su per tra che sono nel ogni come verso sopra sotto dal mal disse tali",
}
#: Frequent words by which another language than the text's must lead to count instead.
PROOF = 2
SCRIPTS = (("ru", "Ѐ", "ԯ"), ("hi", "ऀ", "ॿ"), ("ar", "؀", "ۿ"))


class _Language:
    """What is suppressed in a language, or in any of several."""

    def __init__(self, languages: tuple[str, ...]):
        part = [frozenset(w for x in languages for w in ABBREVIATIONS[x][k].split()) for k in range(4)]
        self.always = frozenset(x for x in part[0] if x == x.lower()) - EITHER
        self.titles = frozenset(x.lower() for x in part[0] if x != x.lower())
        self.either = frozenset(x.lower() for p in part[:3] for x in p) & EITHER | (EITHER if len(languages) > 1 else frozenset())
        self.numbered, self.last, self.parted = part[1:]
        self.years, self.german = "ru" in languages, "de" in languages
        #: Characters of the longest of all; longer words are none of them.
        self.longest = max(map(len, frozenset().union(*part)), default=0)


LATIN = tuple(x for x in FREQUENT)
_FREQUENT_IN = {}
for _x, _words in FREQUENT.items():
    for _w in _words.split():
        _FREQUENT_IN.setdefault(_w, []).append(_x)
LONGEST_WORD = max(len(w) for x in ABBREVIATIONS.values() for p in x for w in p.split()) + 2


@lru_cache(maxsize=64)
def _language(*languages: str) -> _Language:
    return _Language(languages)


#: Verbs of saying in languages without letter case, after or before which a quotation belongs to its sentence.
SAID_HAN = re.compile("[^。！？…，、；\\s]+?(?:说|說|問|问|喊|答|叫|道)(?:道|着|著)?[。！？，：:.…]")
SAID_KANA = re.compile("と[^。！？…\\n]*?(?:言|云|話|語|述べ|尋ね|聞|答え|叫|思|書)[ぁ-ゖ]*[。！？…]")
SAID_HANGUL = re.compile("(?:이?라고|이?라며|하고|고|라는|라면서|는|를|을|은|와|과)(?![^\\s])|(?:이?라고|이?라며|하고)")
SAID_HINDI = re.compile("[^।!?\\n\"“”‘’]+?\\sने\\s(?:कहा|पूछा|बताया|लिखा|बोला|उत्तर)")
SAID_ARABIC = re.compile("(?:قال|قالت|يقول|تقول|سأل|سألت|أجاب|أجابت|صاح|هتف|أضاف|أضافت)\\b")
#: Last syllables of a sentence before an ellipsis, where letter case doesn't tell whether it goes on.
HANGUL_ENDS = "다요까죠네오군"

_BREAK = re.compile("\\r\\n|[\\n\\r\\u2028\\u2029\\x85\\x0b\\x0c]")
_BULLET = re.compile("[ \\t\\xa0\\u3000]*(?:[-*•]|\\d+\\.)[ \\t\\xa0\\u3000]")
_EVENT = re.compile("[" + re.escape("".join(sorted(MARKS | CLOSES.keys() | CLOSERS))) + "]")
_SPACE = re.compile(r"\s*")
_ROMAN = re.compile(r"[IVXLCDM]+(?![^\W_])")
_WORD_AT = re.compile(r"[^\W\d_]+")
_IN_WORD = re.compile(r"[^\W_]|[.\-'’ऀ-ॿً-ْ№]")
_OUT_OF_HOST = frozenset("\"“”«»„()[]「」『』，。、")
_ALL_WORDS = re.compile(r"[^\W\d_]+(?![\w.])")


def _next(text: str, at: int, end: int) -> tuple[int, int]:
    """Class and place of the next character after spaces and line ends (rule SB5: Extend and Format don't count)."""
    while at < end and (CLASS[ord(text[at])] in (SP, SEP, EXTEND, FORMAT) or text[at].isspace()):
        at += 1
    return (CLASS[ord(text[at])] if at < end else -1), at


class _Open:
    """Open quotes and brackets; for each closing mark the places of what it closes, so a search costs no walk."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []
        self.closed_by: dict[str, list[int]] = {}
        self.brackets: list[int] = []  # positions in the text of the open brackets

    def push(self, x: str, at: int) -> None:
        for c in CLOSES[x]:
            self.closed_by.setdefault(c, []).append(len(self.stack))
        self.stack.append((x, at))
        if x in BRACKETS:
            self.brackets.append(at)

    def close(self, x: str) -> list[tuple[str, int]] | None:
        """Take away what ``x`` closes and all that was opened after it."""
        depths = self.closed_by.get(x)
        if not depths:
            return None
        gone = self.stack[depths[-1] :]
        del self.stack[depths[-1] :]
        for o, _ in gone:
            for c in CLOSES[o]:
                self.closed_by[c].pop()
            if o in BRACKETS:
                self.brackets.pop()
        return gone


class _Block:
    """One stretch of text that blank lines, list lines or the text's ends bound."""

    def __init__(self, text: str, begin: int, end: int, lang: str | None):
        self.text, self.begin, self.end, self.lang = text, begin, end, lang
        self.start = begin  # of the sentence
        self.latin: _Language | None = None
        self.host_at, self.host_to, self.host_signs = begin, begin, set()

    def ends(self) -> Iterator[int]:
        text, end = self.text, self.end
        self.start = at = _SPACE.match(text, self.begin, end).end()
        stack, partner = _Open(), None
        while at < end:
            m = _EVENT.search(text, at, end)
            if not m:
                break
            i = m.start()
            x = text[i]
            at = i + 1
            if x not in MARKS:
                if x in BRACKETS and partner is None:
                    partner = _partners(text, self.begin, end)
                if stack.close(x) is None and x in CLOSES and (x not in BRACKETS or i in partner):
                    stack.push(x, i)
                continue
            j = i + 1
            while j < end and (text[j] in MARKS or CLASS[ord(text[j])] in (EXTEND, FORMAT)):
                j += 1
            opened: list[tuple[str, int]] = []
            k = j
            while (c := k + (text[k : k + 1] in NO_BREAK and text[k + 1 : k + 2] in SPACED)) < end and text[c] in CLOSERS and (gone := stack.close(text[c])) is not None:
                opened += gone
                k = c + 1
            at = k
            if k < end and text[k] in MARKS and k > j:
                continue  # the mark after the closer decides
            if self._ends_here(text[i:j], i, k, opened, stack):
                yield k
                self.start = at = _SPACE.match(text, k, end).end()
        last = end
        while last > self.start and text[last - 1].isspace():
            last -= 1
        if last > self.start:
            yield last

    def _ends_here(self, mark: str, i: int, k: int, opened: list, stack: _Open) -> bool:
        text, end, start = self.text, self.end, self.start
        if stack.brackets and stack.brackets[-1] > start:
            return False  # within a bracket that the sentence goes on after
        if any(c in BRACKETS and p > start for c, p in opened):
            return False
        kind, nxt = _next(text, k, end)
        if kind < 0:
            return True  # SB2
        x, adjacent = text[nxt], nxt == k
        quoted = any(c not in BRACKETS for c, _ in opened)
        if x in "—–" or (x == "-" and nxt + 1 < end and text[nxt + 1] == " "):
            return not (quoted or mark[-1] in ELLIPSES or mark.endswith("..."))
        if kind == SCONTINUE and x != "-":
            return False  # SB8a
        strong = any(c in STRONG for c in mark)
        if quoted and (kind == LOWER or kind == OLETTER and self._said(k, nxt, end)):
            return False
        if not strong and kind == LOWER:
            return False  # SB8
        if not strong and (mark[0] in ELLIPSES or len(mark) > 1):
            return self._after_pause(i, kind, adjacent)
        if strong:
            if adjacent and not opened and all(c in LATIN_STRONG or c not in STRONG for c in mark):
                return kind not in (LOWER, NUMERIC) and x not in "/=&_#%+" and not self._in_host(i, "/")
            return True  # SB11
        if adjacent and not opened:
            return self._joined(i, k, kind)  # SB6, SB7
        return bool(opened) or not self._abbreviated(i, kind, nxt)

    def _after_pause(self, i: int, kind: int, adjacent: bool) -> bool:
        """Whether an ellipsis ends the sentence although no small letter follows."""
        before = self.text[i - 1] if i > self.start else ""
        if kind == OLETTER and "가" <= before <= "힣":
            return before in HANGUL_ENDS
        if kind in (OLETTER, UPPER, NUMERIC) and adjacent and "぀" <= before <= "ヿ":
            return False  # within kana only a full stop ends
        return not (kind == NUMERIC and adjacent)

    def _said(self, k: int, nxt: int, end: int) -> bool:
        text = self.text
        x = text[nxt]
        if "぀" <= x <= "ヿ":
            return bool(SAID_KANA.match(text, nxt, end))
        if "가" <= x <= "힣":
            return nxt == k and bool(SAID_HANGUL.match(text, nxt, end))
        if "一" <= x <= "鿿":
            return bool(SAID_HAN.match(text, nxt, end))
        if "ऀ" <= x <= "ॿ":
            return bool(SAID_HINDI.match(text, nxt, end))
        if "؀" <= x <= "ۿ":
            return bool(SAID_ARABIC.match(text, nxt, end))
        return False

    def _in_host(self, i: int, signs: str) -> bool:
        """Whether one of ``signs`` stands in the run without spaces, quotes and brackets that ends at ``i``.

        What an earlier call has looked at isn't looked at again, so long runs take linear time.
        """
        at, seen = i, ""
        while at > self.start and at != self.host_to and not ((c := self.text[at - 1]).isspace() or c in _OUT_OF_HOST):
            at -= 1
        seen = self.text[at:i]
        if at == self.host_to > self.host_at and not (self.text[at - 1].isspace() or self.text[at - 1] in _OUT_OF_HOST):
            at, found = self.host_at, self.host_signs
        else:
            found = set()
        self.host_at, self.host_to, self.host_signs = at, i, found | (set(seen) & {"/", "@"})
        return not self.host_signs.isdisjoint(signs) or "@" in signs and self.text[at : at + 3].lower() == "www"

    def _word(self, i: int) -> tuple[str, int]:
        """The word that ends at ``i`` and its place; what is longer than any abbreviation is only its last part."""
        at = i
        while at > self.start and i - at <= LONGEST_WORD and _IN_WORD.match(self.text, at - 1):
            at -= 1
        return self.text[at:i], at

    def _known(self, word: str) -> _Language:
        """What is suppressed where ``word`` stands: by its script, else the language of the paragraph."""
        for lang, low, high in SCRIPTS:
            if low <= word[:1] <= high:
                return _language(lang)
        if self.latin is None:
            hits = dict.fromkeys(LATIN, 0)
            for w in _ALL_WORDS.findall(self.text, self.begin, self.end):
                for lang in _FREQUENT_IN.get(w.lower(), ()):
                    hits[lang] += 1
            most = max(hits.values())
            if self.lang in hits and most < hits[self.lang] + PROOF:
                self.latin = _language(self.lang)
            else:
                self.latin = _language(*[x for x in LATIN if hits[x] == most or most < PROOF])
        return self.latin

    def _joined(self, i: int, k: int, kind: int) -> bool:
        """Whether a full stop with a letter right after it ends a sentence: not in numbers, hosts and initials."""
        text = self.text
        if kind == NUMERIC:
            return False  # SB6
        word, _ = self._word(i)
        last = word.rsplit(".", 1)[-1]
        x = text[k]
        if kind == OLETTER:
            return len(last) > 1 and not last[-1].isascii() and not x.isascii()
        if kind != UPPER:
            return x in CLOSES or x in "¿¡"
        after = _WORD_AT.match(text, k, self.end).group()
        if len(last) < 2 or not last[-1].islower() or (len(after) > 1 and not after[1:].islower()):
            return False  # SB7
        if self._in_host(i, "/@"):
            return False
        known = self._known(last)
        return last.lower() not in known.always and not (last[0].isupper() and last.lower() in known.titles)

    def _abbreviated(self, i: int, kind: int, nxt: int) -> bool:
        """Whether the full stop at ``i``, before a space, belongs to an abbreviation, initial or ordinal number."""
        text = self.text
        found, at = self._word(i)
        word = found.strip("-'’.")
        if not word:
            return False
        known = self._known(word)
        low = word.lower()
        spaced = self._spaced(at, known) + word  # u. a., т. д., EE. UU., but not initials
        if spaced in known.parted and spaced.lower() in known.always:
            return True
        if spaced in known.parted or low in known.last and not (len(word) == 3 and word.isupper()):
            return False
        if len(word) <= 2 and (more := _PART.match(text, nxt)) and f"{word}.{more.group(1)}" in known.parted:
            return True  # the first half of z. B.
        if low in YEARS and known.years:
            return not text[max(self.start, at - 2) : at].strip()[-1:].isnumeric()
        if low in known.numbered and (kind == NUMERIC or _ROMAN.match(text, nxt)):
            return True
        if low in known.either and kind != NUMERIC:
            return len(word) == 1 and word.isupper() and word.isascii()
        if low in known.always or (low in known.titles and word[0].isupper()):
            return True
        if len(word) == 1 and word.isalpha() and (word.isupper() or not word.islower()) and not ("぀" <= word <= "힣"):
            return kind in (UPPER, OLETTER)
        if "." in word and len(word) == 3 and word[0].isupper() and word[2].isupper():
            return kind == UPPER  # J.R. Name
        if known.german and word.isdigit() and len(word) <= 2 and kind == UPPER:
            return _WORD_AT.match(text, nxt).group() in GERMAN_AFTER
        return False

    def _spaced(self, at: int, known: _Language) -> str:
        """The parts with full stops and spaces before ``at`` that an abbreviation of several parts may begin with."""
        text, out, begin = self.text, "", at
        while begin > self.start and len(out) <= known.longest:
            p = begin
            if text[p - 1] in " \xa0" and p - 1 > self.start:
                p -= 1
            if text[p - 1] != ".":
                break
            p -= 1
            q = p
            while q > self.start and p - q < 3 and text[q - 1].isalpha():
                q -= 1
            if not 1 <= p - q <= 2 or q > self.start and not (text[q - 1].isspace() or text[q - 1] in "(\"“„«."):
                break
            out = text[q:p] + "." + out
            begin = q
        return out if begin == self.start or text[begin - 1].isspace() or text[begin - 1] in "(\"“„«" else ""


_PART = re.compile(r"([^\W\d_]{1,4})\.")
_BRACKET = re.compile("[" + re.escape("".join(BRACKETS) + "".join(BRACKETS.values())) + "]")


def _partners(text: str, begin: int, end: int) -> dict[int, int]:
    """Opening brackets that are closed within the block."""
    stack: list[int] = []
    out: dict[int, int] = {}
    for m in _BRACKET.finditer(text, begin, end):
        x = m.group()
        if x in BRACKETS:
            stack.append(m.start())
        else:
            while stack:
                o = stack.pop()
                if x in CLOSES[text[o]]:
                    out[o] = m.start()
                    break
    return out


_APOSTROPHE = re.compile(r"(?<=[^\W_])['’](?=[^\W_])")


def sentence_ends(text: str | None, lang: str | None = None) -> list[int]:
    """Positions after the last character of each sentence of ``text``, in code points; none for null or blank text.

    ``lang`` is the language of the text. A paragraph in other Latin words than the language's, and one without a
    known language, is told by its frequent words; other scripts by their letters.
    """
    if not text:
        return []
    # apostrophes within words close nothing
    plain = _APOSTROPHE.sub("x", text) if "'" in text or "’" in text else text
    ends: list[int] = []
    begin, at = 0, 0  # of the block, of the line
    n = len(plain)

    def flush(to: int) -> None:
        if to > begin:
            ends.extend(_Block(plain, begin, to, lang).ends())

    while at < n:
        m = _BREAK.search(plain, at)
        stop, nxt = (m.start(), m.end()) if m else (n, n)
        if _SPACE.match(plain, at, stop).end() >= stop:  # a blank line
            flush(at)
            begin = nxt
        elif _BULLET.match(plain, at, stop):
            flush(at)
            last = stop
            while last > at and plain[last - 1].isspace():
                last -= 1
            ends.append(last)
            begin = nxt
        at = nxt
    flush(n)
    return ends


#: Texts of one batch of results.
_TEXTS = 2000


def _per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, langs = batch.columns
        for s in range(0, batch.num_rows, _TEXTS):
            found = [sentence_ends(x, y) for x, y in zip(texts.slice(s, _TEXTS).to_pylist(), langs.slice(s, _TEXTS).to_pylist())]
            offsets = [0]
            for x in found:
                offsets.append(offsets[-1] + len(x))
            yield pa.RecordBatch.from_arrays([ids.slice(s, _TEXTS), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([e for x in found for e in x], pa.int32()))], ["id", "ends"])


def split_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """``id_col, sentence_no, start_pos, end_pos`` of every sentence, in code points; no shuffle.

    ``substr(text, start_pos + 1, end_pos - start_pos)`` is the sentence with its leading space. Null, empty and blank
    texts have none. Repeated rows are split each; rows without an id keep a null id. ``lang_col`` has the language that
    abbreviations are suppressed by; where it is null, unknown or no column, the text tells.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    lang = F.split(F.lower(F.col(lang_col).cast("string")), "[-_]")[0] if lang_col in docs.columns else F.lit(None).cast("string")
    ends = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lang.alias("lang")).where("text IS NOT NULL").mapInArrow(_per_batch, f"id {kind}, ends array<int>")
    numbered = ends.select("id", "ends", F.posexplode("ends").alias("k", "end_pos"))
    start = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.element_at("ends", F.col("k")))
    return numbered.select(F.col("id").alias(id_col), (F.col("k") + 1).alias("sentence_no"), start.alias("start_pos"), "end_pos")

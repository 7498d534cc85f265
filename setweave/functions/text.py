"""Column functions on text: tidying contents, filters, languages, mark-up, string similarity.

All are built-in expressions that stay in generated code, but for Jaro-Winkler similarity and the stemmer, which Spark
has no expression for and which are Arrow UDFs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: White space of ASCII.
SPACE = r" \t\n\x0B\f\r"
#: What counts as punctuation around a content.
PUNCT = rf"[!-/:-@\[-`{{-~{SPACE}、。·・]"
MIN_LENGTH, MAX_LENGTH = 2, 48
#: Characters that a seed may have or lack.
OPTIONAL = ".-·・"
#: English function words that are no entities; a longer list is a parameter.
STOPWORDS = ("a about above after again all also although always among an and another any are as at be because been before being between both but by can could did do does each either else etc even ever every few for from further had has have he her here him his how however if in instead into is it its itself just last least less like many may me might more most much must my near neither never next no none nor not nothing now of off often on once one only onto or other others our out over own per perhaps rather same several she should since so some such than that the their them then there these they this those though through thus to together too toward under until up upon us very was we well were what when where whether which while who whose why will with within without would yes yet you your").split()


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tidy(s: Column, case_sensitive: bool = False) -> Column:
    """A content as a name: runs of white space and ``_`` (and ``-``, and case, unless ``case_sensitive``) are one space,
    punctuation around it goes, and a split-off ``s`` gets its apostrophe back. Null stays null."""
    s = F.regexp_replace(s, rf"[{SPACE}_]+", " ") if case_sensitive else F.regexp_replace(F.lower(s), rf"[{SPACE}_-]+", " ")
    s = F.regexp_replace(F.regexp_replace(s, f"^{PUNCT}+", ""), f"{PUNCT}+$", "")
    at = F.locate(" s ", s)
    s = F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), F.lit("'s "), F.substring(s, at + 3, F.length(s)))).otherwise(s)
    return F.when(s.endswith(" s"), F.concat(F.substring(s, F.lit(1), F.length(s) - 2), F.lit("'s"))).otherwise(s)


def plausible(name: Column, min_length: int = MIN_LENGTH, max_length: int = MAX_LENGTH) -> Column:
    """Whether a name could be an entity: of fair length, not one letter, not digits or punctuation alone; null is none."""
    fair = F.length(name).between(min(min_length, MIN_LENGTH), max_length)
    return F.coalesce(fair & ~name.rlike(r"^[A-Za-z]$") & ~name.rlike(r"^[0-9]+$") & ~name.rlike(f"^{PUNCT}+$"), F.lit(False))


def stopped(name: Column, words: Sequence[str] = STOPWORDS, phrases: Sequence[str] = ()) -> Column:
    """Whether a name is a stop-word, or part of any of the phrases."""
    s = F.lower(F.trim(name))
    bad = s.isin(list(words))
    for p in phrases:
        bad = bad | F.lit(p.lower()).contains(s)
    return F.coalesce(bad, F.lit(False))


def stopword_files(lines: DataFrame, line: str = "value") -> DataFrame:
    """``word``: the stop-words of files with one a line, trimmed and lower-cased, each once."""
    return lines.select(F.lower(F.trim(line)).alias("word")).where("word <> ''").distinct()


def not_stopped(names: DataFrame, words: DataFrame, name: str = "entity", phrases: Sequence[str] = ()) -> DataFrame:
    """Rows whose name is none of ``words`` (a table, of any size) nor part of any of the phrases; null names go."""
    kept = names.where(F.col(name).isNotNull() & ~stopped(F.col(name), (), phrases))
    return kept.join(words.select(F.col("word").alias("_word")).distinct(), F.lower(F.trim(name)) == F.col("_word"), "left_anti")


def name_tokens(name: Column) -> Column:
    """The tokens of a name: cut at each single space, so that two spaces in a row have an empty one between them."""
    return F.split(name, " ", -1)


_HAN = r"\x{4E00}-\x{9FFF}"
# The letters of each language with spaces, and of each without.
SPACED = {"en": "A-Za-z", "pt": "A-Za-zÁÂÃÀÇÉÊÍÓÔÕÚáâãàçéêíóôõú", "fr": "A-Za-z", "it": "A-IL-VZa-il-vz", "es": "A-Za-zÑñ", "de": "A-Za-zÄÖÜäöüß"}
SOLID = {"zh-TW": _HAN + r"\x{3100}-\x{312F}\x{02C7}\x{02CA}\x{02CB}\x{30FB}", "zh-CN": _HAN, "ja": _HAN + r"\x{30A0}-\x{30FF}\x{3040}-\x{309F}", "ko": r"\x{AC00}-\x{D7AF}"}
UNIVERSAL = r"[^\x22-\x25\x28-\x2C\x3B-\x40\x5B-\x5E\x7B-\x7E\x2F\x60]{2,}"
LANGUAGES = ("en", "pt", "fr", "it", "zh-TW", "zh-CN", "ja", "ko", "es", "de", "un")


def language_pattern(lang: str) -> str:
    """The regular expression of a content in a language; ``un`` is any."""
    if lang in SPACED:
        a = SPACED[lang]
        return rf"[{a}][0-9{a}]*(?:[ .:'&-][ ]?[0-9{a}]+)*"
    return rf"[0-9{SOLID[lang]}]+" if lang in SOLID else UNIVERSAL


def combined_language(fetch: str, extract: str) -> tuple[str, str]:
    """The language that pages are asked for in, and the pattern of contents of the one that they are extracted in."""
    return fetch, language_pattern(extract)


def in_language(name: Column, lang: str) -> Column:
    """Whether all of a name is a content of the language; null is in none."""
    return F.coalesce(name.rlike(rf"^(?:{language_pattern(lang)})\z"), F.lit(False))


def detect_languages(name: Column) -> Column:
    """The languages that a name could be in, in the order of ``LANGUAGES``."""
    return once(name, lambda n: F.filter(F.array(*[F.when(in_language(n, x), F.lit(x)) for x in LANGUAGES]), lambda x: x.isNotNull()))


def html_level(context: Column, level: int, left: bool) -> Column:
    """Whether a context is as strict about mark-up as ``level`` (0 to 4) asks: none, a bracket anywhere, a bracket next
    to the content, a whole tag anywhere, a whole tag next to the content."""
    s = F.trim(context)
    if level == 0:
        return F.lit(True)
    if level == 1:
        return s.contains("<") | s.contains(">")
    if level == 2:
        return s.endswith(">") if left else s.startswith("<")
    if level == 3:
        return s.rlike("<[^<>]+>")
    if level == 4:
        return s.rlike(r"<[^<>]+>\z") if left else s.rlike("^<[^<>]+>")
    return F.lit(False)


def strip_tags(s: Column) -> Column:
    """Text without its tags."""
    return F.regexp_replace(s, "<[^<>]+>", "")


# Named entities in the order in which they are resolved.
ENTITIES = (("&amp;", "&"), ("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&nbsp;", " "), ("&apos;", "'"), ("&middot;", "·"))


def escape_entities(s: Column) -> Column:
    """Text with the five characters of mark-up as entities."""
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#039;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def unescape_entities(s: Column) -> Column:
    """Text with named entities of any case and decimal or hexadecimal ones resolved."""
    for a, b in ENTITIES:
        s = F.regexp_replace(s, f"(?i){a}", b)
    parts = F.split(s, "&#")
    point = lambda p: F.when(p.rlike("^[xX][0-9A-Fa-f]{1,6};"), F.conv(F.regexp_extract(p, "^[xX]([0-9A-Fa-f]+);", 1), 16, 10).cast("int")).otherwise(F.regexp_extract(p, "^([0-9]{1,7});", 1).try_cast("int"))
    text = lambda p: F.decode(F.unhex(F.lpad(F.hex(point(p)), 8, "0")), "UTF-32")
    rest = lambda p: F.regexp_replace(p, "^[^;]*;", "")
    known = lambda p: F.coalesce((point(p) > 0) & (point(p) < 0x110000) & ~point(p).between(0xD800, 0xDFFF), F.lit(False))
    tail = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.when(known(p), F.concat(text(p), rest(p))).otherwise(F.concat(F.lit("&#"), p)))
    return F.when(F.locate("&#", s) == 0, s).otherwise(F.concat(F.element_at(parts, 1), F.array_join(tail, "")))


def extract_between(s: Column, left: str | None, right: str | None) -> Column:
    """What is between the first ``left`` and the first ``right`` after it; null as ``left`` is the start and as
    ``right`` the end; null if a delimiter is missing."""
    start = F.lit(1) if left is None else F.when(F.locate(left, s) > 0, F.locate(left, s) + len(left))
    rest = F.substring(s, start, F.length(s))
    return rest if right is None else F.when(F.locate(right, rest) > 0, F.substring(rest, F.lit(1), F.locate(right, rest) - 1))


def escape_field(s: Column) -> Column:
    """A field of a saved pattern: ``%`` doubled; quote, TAB, LF and CR as ``%`` and two digits."""
    for a, b in (("%", "%%"), ('"', "%22"), ("\t", "%09"), ("\n", "%0a"), ("\r", "%0d")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def unescape_field(s: Column) -> Column:
    """The inverse of ``escape_field``."""
    parts = F.split(s, "%%", -1)

    def back(p: Column) -> Column:
        for a, b in (("%22", '"'), ("%09", "\t"), ("%0a", "\n"), ("%0d", "\r")):
            p = F.replace(p, F.lit(a), F.lit(b))
        return p

    return F.array_join(F.transform(parts, back), "%")


def unquote(s: Column) -> Column:
    """Text without the quotation marks around it."""
    return F.when((F.length(s) >= 2) & s.startswith('"') & s.endswith('"'), F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s)


def page_title(html: Column) -> Column:
    """The title of a page, its white space squeezed; null if there is none."""
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.nullif(F.trim(F.regexp_replace(title, rf"[{SPACE}]+", " ")), F.lit(""))


def page_meta(html: Column, name: str) -> Column:
    """The content of a page's ``<meta name=...>``; null if there is none."""
    return F.nullif(F.regexp_extract(html, rf"(?is)<meta[^>]*name=[\"']?{name}[\"']?[^>]*content=[\"']([^\"']*)[\"']", 1), F.lit(""))


def keywords(meta: Column) -> Column:
    """The keywords of a list: lower-cased, split at comma, bar, colon and hyphen, each once, none of them empty."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(meta), "[-:,|]"), lambda x: F.trim(x)), lambda x: x != ""))


def has_hiragana(s: Column) -> Column:
    return F.coalesce(s.rlike(r"[\x{3040}-\x{309F}]"), F.lit(False))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance in lengths of the longer one; 1 for two empty strings, null for null."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.when(a.isNotNull() & b.isNotNull(), 1.0)).otherwise(1 - F.levenshtein(a, b) / most)


def gaussian(x: Column, mean: Column, sigma: Column) -> Column:
    """The density of the normal distribution."""
    return F.exp(-0.5 * F.pow((x - mean) / sigma, 2)) / (sigma * math.sqrt(2 * math.pi))


def jaro(a: str, b: str) -> float:
    """Jaro similarity."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    ours = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                ours.append(x)
                break
    if not ours:
        return 0.0
    theirs = [x for x, u in zip(b, used) if u]
    m, swapped = len(ours), sum(x != y for x, y in zip(ours, theirs)) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler_of(a: str, b: str, prefix: int = 4, boost_above: float = 0.7) -> float:
    """Jaro similarity, raised for a common prefix where it is above ``boost_above``."""
    s = jaro(a, b)
    if s <= boost_above:
        return s
    same = 0
    while same < min(prefix, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return s + same * 0.1 * (1 - s)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b)], dtype="float64")


# --- Porter's stemmer, after the published algorithm ---

_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(w):
        out += "v" if x in "aeiou" or x == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def stem_word(w: str) -> str:
    """The stem of a lower-case English word by Porter's rules; other words come back as they are."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        hit = max((r for r in rules if w.endswith(r[0])), key=lambda r: len(r[0]), default=None)
        if hit and _measure(w[: -len(hit[0])]) > 0:
            w = w[: -len(hit[0])] + hit[1]
    hit = max((e for e in _STEP4 if w.endswith(e)), key=len, default=None)
    if hit and _measure(w[: -len(hit)]) > 1 and (hit != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(hit)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@F.pandas_udf(StringType())
def stem(words: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return words.map(lambda w: None if w is None else known.setdefault(w, stem_word(w)) if w not in known else known[w])

import random

import pytest

from setweave.llm import sentences as S


def cut(text):
    ends = S.sentence_ends(text)
    return [text[a:b].strip() for a, b in zip([0, *ends], ends)]


CASES = {
    "One. Two! Three? Four": ["One.", "Two!", "Three?", "Four"],
    "Dr. A. B. Smith met Mr. Jones at 3.5 km, e.g. here. He left.": ["Dr. A. B. Smith met Mr. Jones at 3.5 km, e.g. here.", "He left."],
    "It has no. 5 and No. 5 of Acme Inc. and co. It ends etc. Then more.": ["It has no. 5 and No. 5 of Acme Inc. and co.", "It ends etc.", "Then more."],
    "See www.a.test/b.html or lists.c.example now. v1.2.3 is out, Foo.NET too.": ["See www.a.test/b.html or lists.c.example now. v1.2.3 is out, Foo.NET too."],
    "Go on.Now go.": ["Go on.", "Now go."],
    "“Really?!” she said. “Yes.” He went.": ["“Really?!” she said.", "“Yes.”", "He went."],
    "Wait... what? Done… Next.": ["Wait... what?", "Done…", "Next."],
    "He came (late!) and left. (All of it.) End": ["He came (late!) and left.", "(All of it.)", "End"],
    "Am 3. Mai im 19. Jahrhundert, z. B. hier u. a. Dann 5. Ende.": ["Am 3. Mai im 19. Jahrhundert, z. B. hier u. a.", "Dann 5.", "Ende."],
    "Los EE. UU. ganan. En 50 a. C. Y la Sra. X, p. ej. ella.": ["Los EE. UU. ganan.", "En 50 a. C.", "Y la Sra. X, p. ej. ella."],
    "М. Горький, г. Москва, ул. Мира, т. е. тут и др. Потом 3 тыс. руб. за всё.": ["М. Горький, г. Москва, ул. Мира, т. е. тут и др.", "Потом 3 тыс. руб. за всё."],
    "«Да!» — сказал он. «Нет.» Он ушёл.": ["«Да!» — сказал он.", "«Нет.»", "Он ушёл."],
    "「はい。」と彼は言った。そうです！『よし。』終わり（本当。）です。": ["「はい。」と彼は言った。", "そうです！", "『よし。』", "終わり（本当。）です。"],
    "“好吗？”他说道。天晴了……月来了。": ["“好吗？”他说道。", "天晴了……", "月来了。"],
    "비가 온다. \"간다!\"라고 말했다. 끝이다…  새로": ["비가 온다.", "\"간다!\"라고 말했다.", "끝이다…", "새로"],
    "यह है। डॉ. राम ने कहा। ‘चलो!’ राम ने कहा। अंत": ["यह है।", "डॉ. राम ने कहा।", "‘चलो!’ राम ने कहा।", "अंत"],
    "«هيا!» قال د. علي. هل جاء؟ نعم.": ["«هيا!» قال د. علي.", "هل جاء؟", "نعم."],
    "Title\n\nFirst line\ngoes on. Next\r\n\r\n1. One. x\n2. Two\n- three\n* four\n• five\n\nLast": ["Title", "First line\ngoes on.", "Next", "1. One. x", "2. Two", "- three", "* four", "• five", "Last"],
    "-no marker\n3.5 neither\n12) nor this": ["-no marker\n3.5 neither\n12) nor this"],
}


CASES["«\xa0Oui\xa0!\xa0» dit-il. «\xa0Non.\xa0» Il part."] = ["«\xa0Oui\xa0!\xa0» dit-il.", "«\xa0Non.\xa0»", "Il part."]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert cut(text) == CASES[text]


@pytest.mark.parametrize("text", [None, "", "  ", "\n\n\r\n", "　\t"])
def test_nothing(text):
    assert S.sentence_ends(text) == []


def test_invariants():
    rng = random.Random(4)
    pieces = list("aB.!?…\"“”«»()（）「」。\n -•1é東다'") + ["\r\n", "\n\n", "Dr. ", "etc. ", "...", ". "]
    for _ in range(2000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))
        ends = S.sentence_ends(text)
        assert ends == sorted(set(ends)) and all(0 < e <= len(text) and not text[e - 1].isspace() for e in ends)
        assert (ends[-1] if ends else 0) == len(text.rstrip())


def test_long_texts_take_linear_time():
    for text in ("word " * 200_000, "(" * 200_000, "“" * 200_000, "a.b" * 100_000, "." * 300_000, "- x\n" * 50_000, "1." * 100_000, "é" * 300_000 + "."):
        assert S.sentence_ends(text)[-1] == len(text.rstrip())


def test_frame(spark):
    rows = [(1, "A b. C d.", 1, "k"), (1, "A b. C d.", 1, "k"), (2, None, 1, "k"), (3, " ", 1, "k"), (None, "𝒳 y. Z", 1, "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, id int, ends string")
    got = S.split_sentences(df)
    assert sorted((r.doc_id or 0, r.sentence_no, r.start_pos, r.end_pos) for r in got.collect()) == [(0, 1, 0, 4), (0, 2, 4, 6), (1, 1, 0, 4), (1, 1, 0, 4), (1, 2, 4, 9), (1, 2, 4, 9)]
    assert S.split_sentences(df.limit(0)).count() == 0


# a letter of the script, and a terminator of it
SCRIPTS = {"Brahmi": "𑀓𑁇", "Samaritan": "ࠀ࠽", "Philippine": "ᜃ᜶", "Balinese": "ᬅ᭽", "Latin": "a‽", "Chakma": "𑄃𑅁", "Sharada": "𑆃𑇅", "Khojki": "𑈀𑈸", "Tirhuta": "𑒁𑗂", "Siddham": "𑖀𑗃", "Coptic": "ⲁ⳹", "Kharosthi": "𐨀𐩖", "Sogdian": "𐼰𐽕", "Bamum": "ꚠ꛳", "Meetei": "ꯀ꯫", "Lisu": "ꓐ꓿", "Vai": "ꔀ꘎", "Burmese": "က။", "Ethiopic": "ሀ።", "Khmer": "ក។", "Tibetan-like": "ᠠ᠃", "Armenian": "ա։", "Arabic": "ا۔", "Urdu": "ب؟", "Devanagari": "क।", "Han": "山。", "Halfwidth": "ｱ｡", "Pahawh": "𖬀𖬷", "Tai Tham": "ᨠ᪨", "Duployan": "𛰀𛲟", "Nko": "ߊ߹", "Syriac": "ܐ܀", "Vertical": "山︒"}


@pytest.mark.parametrize("script", SCRIPTS)
def test_terminators_of_scripts(script):
    letter, mark = SCRIPTS[script]
    assert cut(f"{letter * 3}{mark} {letter * 2}{mark} {letter}") == [f"{letter * 3}{mark}", f"{letter * 2}{mark}", letter]


def test_every_terminator_of_the_standard_ends_a_sentence():
    import regex

    for mark in regex.findall(r"\p{SB=STerm}", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))):
        assert S.sentence_ends(f"Ab{mark} Cd") == [3, 6], f"{ord(mark):04X}"


def test_suppression_is_by_language():
    ends = lambda text, lang=None: len(S.sentence_ends(text, lang))
    assert [ends("She works at env. The rest.", x) for x in ("en", "de")] == [2, 2]
    assert [ends("Il compte env. Trente pas.", x) for x in ("fr", None)] == [1, 1]
    assert ends("They wrote in av. The rest stayed.", "en") == 2 and ends("Die Frl. Meier kam zu der Tür.", "de") == 1
    assert ends("Une page.\n\nMr. Smith said that the house was old.", "fr") == 2  # a paragraph in another language
    assert ends("Paragraph.\n\nУл. Мира и др. Потом.", "en") == 3  # another script
    assert ends("Qxz env. Qrt", "xx") == 1  # nothing tells the language: all are suppressed


def test_marks_far_from_their_words():
    far = "x" * 500
    assert S.sentence_ends(f"www.{far}.A{far}.Bc{far} is it. No.") == [4 + 500 + 2 + 500 + 3 + 500 + 7, 4 + 500 + 2 + 500 + 3 + 500 + 11]
    assert cut("“" * 9 + "a. b" + "(" + "c. " * 50 + ") d. E.") == ["“" * 9 + "a. b" + "(" + "c. " * 50 + ") d.", "E."]
    assert cut("「はい。」と" + "彼" * 60 + "は言った。次。") == ["「はい。」と" + "彼" * 60 + "は言った。", "次。"]


def test_deep_stacks_take_linear_time():
    for text in ("“" * 100_000 + "a.) " * 50_000, "“a. " * 50_000, "([{" * 50_000 + ")]}." * 50_000, "x/" * 100_000 + "y.Ab" * 50_000, "a. " * 100_000):
        assert S.sentence_ends(text)[-1] == len(text.rstrip())


def test_language_column(spark):
    df = spark.createDataFrame([(1, "Il a env. Trente.", "fr-CA"), (2, "It is env. Thirty.", "en"), (3, "A. b", None)], "doc_id bigint, text string, lang string")
    assert sorted((r.doc_id, r.end_pos) for r in S.split_sentences(df).collect()) == [(1, 17), (2, 10), (2, 18), (3, 4)]
    assert S.split_sentences(df.drop("lang")).count() == 3

import random

import pytest

from setweave.llm import garbled as G

CLEAN = [
    "São Paulo", "MAÇÃ", "ŠKODA team", "10 µm", "±3°", "€9 £5", "№ 5", "Đà Nẵng", "ÅS", "naïve café — “l’été”", "«IRMÃ»", "coração éé", "Ærøskøbing", "straße", "Малый завод", "Сёстры", "РЕКА нЕва", "Рівне", "北京 東京", "カタカナ", "서울 다리", "مرحبا", "हिन्दी", "© 2020 ™", "a", "", "¿Qué?", "Ελλάδα", "x² + y²", "5 × 3 ÷ 2", "“Ça va…”", "GRÖẞE", "Île-de-France",
]
TEXTS = ["château fort", "señor müller", "coração", "верхний завод", "Новый Холм", "東京の海", "银山风水竹", "groß über", "città più"]


@pytest.mark.parametrize("text", CLEAN)
def test_ordinary_text_is_left_alone(text):
    assert G.examine(text) is None and G.examine("http://x.example/" + text, True) is None


def misread(text, assumed):
    raw = text.encode("utf-8")
    return "".join(bytes([b]).decode(assumed) if assumed not in ("cp1252", "cp1250") or not _undefined(b, assumed) else chr(b) for b in raw)


def _undefined(b, encoding):
    try:
        bytes([b]).decode(encoding)
        return False
    except UnicodeDecodeError:
        return True


@pytest.mark.parametrize("assumed", ["latin-1", "cp1252", "cp1250", "cp437", "mac_roman"])
def test_round_trip_of_utf8(assumed):
    for text in TEXTS:
        hit = G.examine(misread(text, assumed))
        assert hit and hit[0] == text and hit[1] == "restored", (text, hit)


def test_nested_layers_and_parts():
    for text in TEXTS:
        hit = G.examine(misread(misread(text, "cp1252"), "cp1252"))
        assert hit and hit[0] == text and len(hit[2]) == 2
    assert G.examine("fÃ´tösérütça")[0] == "fôtösérütça"
    assert G.examine("Ð·авод")[0] == "завод"


@pytest.mark.parametrize("meant,text", [("cp1251", "верхний завод"), ("koi8_r", "верхний завод"), ("gb18030", "银山风水竹"), ("euc_jp", "東京大学ノート"), ("shift_jis", "北月ム海湖リ")])
def test_other_encodings(meant, text):
    wrong = "".join(bytes([b]).decode("cp1252") if not _undefined(b, "cp1252") else chr(b) for b in text.encode(meant))
    hit = G.examine(wrong + " tail")
    assert hit and hit[0] == text + " tail"


def test_lost_and_uris():
    assert G.examine("f�m�s") == (None, "lost", [])
    assert G.examine("http://x/%C3%83%C2%A9t%C3%83%C2%A9", True)[0] == "http://x/été"
    assert G.examine("http://x/%C3%A9t%C3%A9", True) is None and G.examine("http://x/%E9t%E9", True) is None
    assert G.examine("http://x/%EF%BF%BD", True)[1] == "lost"
    assert G.examine("·Çó") is None
    assert G.examine("%C3%83%C2%A9") is None


def test_frame(spark):
    rows = [(1, "Ã©tÃ©", 1, "c"), (1, "Ã©tÃ©", 1, "c"), (2, None, 1, "c"), (3, "", 1, "c"), (4, "été " * 20000, 1, "c"), (5, "Ã©tÃ© " * 20000, 1, "c"), (None, "Ã©tÃ©", 1, "c")]
    df = spark.createDataFrame(rows, "rec bigint, t string, id int, value string")
    got = G.find_garbled(df, "rec", "t").collect()
    assert sorted((r.rec is None, r.rec) for r in got) == [(False, 1), (False, 1), (False, 5), (True, None)]
    assert all(set(r.repaired) <= set("été ") for r in got)
    assert G.find_garbled(df.limit(0), "rec", "t").count() == 0


def test_random_text_never_fails():
    rng = random.Random(2)
    for _ in range(300):
        G.examine("".join(chr(rng.choice([rng.randrange(0x80, 0x180), rng.randrange(0x20, 0x3000), rng.randrange(0x4E00, 0xD7A3)])) for _ in range(12)), rng.random() < 0.5)


def test_long_tokens_take_linear_time():
    for text in ("é" + "a" * 200_000, "éÃ" + "b" * 100_000 + "©", "ÇÃO" * 30_000, "ƒ" + "x" * 100_000, "&" + "amp;" * 100_000 + "é", "&" + "#38;" * 100_000 + "#195;", "&#x26;" * 50_000):
        G.examine(text)


@pytest.mark.parametrize("text", ["Café", "perché ...", "più", "città", "città témñunô", "é vero", "vado à Roma", "Là dove", "CITTÀ", "CAFÉ", "tû", "cosí"])
def test_single_letters_at_the_end_of_words(text):
    for layers in (1, 2):
        wrong = text
        for _ in range(layers):
            wrong = "".join(misread(c, "cp1252") if c > "\x7f" else c for c in wrong)
        assert G.examine(wrong) == (text, "restored", ["utf-8 as cp1252"] * layers)
    assert G.examine("coraÃ§ão nônéf")[0] == "coração nônéf"
    assert G.examine("http://x/wiki/cittÃ\xa0_födü", True)[0] == "http://x/wiki/città_födü"


@pytest.mark.parametrize("text", ["«IRMÃ»", "IRMÃ”", "10 Å²", "A Ã\xa0 B", "«Ã»", "IRMÃ®", "“NéRèFÉtáSÉ”", "«gÖdçAlÑUTÉnÉ»", "SÖgüfÇadôlÖ\xa0teKUgufo", "naïveté» d", "café© x", "NESCAFÉ™"])
def test_real_letters_before_marks_are_left_alone(text):
    assert G.examine(text) is None


WORDS = ["café", "voilà", "niño", "ñ", "ü", "CAFÉ", "Zürich", "São", "coração", "CORAÇÃO", "été", "à Paris", "naïve", "Ångström", "œuvre", "straße", "Łódź", "Київ", "Ελλάδα", "שלום", "東京", "서울", "“hello”", "it’s", "Đà Nẵng", "città"]


@pytest.mark.parametrize("layers", range(1, 7))
def test_layers_have_no_limit(layers):
    for assumed in ("cp1252", "latin-1"):
        for text in WORDS:
            wrong = text
            for _ in range(layers):
                wrong = misread(wrong, assumed)
            hit = G.examine(wrong)
            assert hit and hit[:2] == (text, "restored") and len(hit[2]) == layers, (wrong[:40], hit)


# share of WORDS that come back exactly from one wrong decoding; the rest is ambiguous, as a letter of another script alone
RECALL = {"cp1252": 1.0, "latin-1": 1.0, "cp1250": 0.95, "cp437": 0.95, "cp850": 0.8, "mac_roman": 0.85, "cp1251": 0.75, "koi8_r": 0.8, "cp866": 0.9, "iso8859_2": 0.8, "cp1254": 0.95, "cp1253": 0.8}


@pytest.mark.parametrize("assumed", RECALL)
def test_recall_by_encoding(assumed):
    back = [(hit := G.examine(misread_any(w, assumed))) is not None and hit[0] == w for w in WORDS]
    assert sum(back) / len(back) >= RECALL[assumed], [w for w, x in zip(WORDS, back) if not x]


def misread_any(text, assumed):
    return "".join(chr(b) if _undefined(b, assumed) else bytes([b]).decode(assumed) for b in text.encode("utf-8"))


@pytest.mark.parametrize("text,back", [("c&#195;&#169;t&#195;&#169;", "cété"), ("&Atilde;&copy;t&Atilde;&copy;", "été"), ("&#xC3;&#xA9;t&#xC3;&#xA9;", "été"), ("&amp;#195;&amp;#169;t&#195;&#169;", "été"), ("&#208;&#188;&#208;&#176;&#208;&#187;", "мал"), ("&#230;&#150;&#185;&#227;&#131;&#141;", "方ネ")])
def test_garbling_in_references(spark, text, back):
    assert G.examine(text) == (back, "restored", ["utf-8 as cp1252"])
    df = spark.createDataFrame([(1, text)], "id bigint, t string")
    assert G.find_garbled(df, "id", "t").count() == 1


@pytest.mark.parametrize("text", ["caf&#233;", "R&D; x", "&amp;", "&eacute;t&eacute;", "&unknown;", "a&b;c", "Рівне", "РІЧ", "перо ремяка пеняре", "КНЯЗЬ", "нОВЫЙ"])
def test_references_and_cyrillic_of_ordinary_text(text):
    assert G.examine(text) is None


def test_partly_where_garbling_is_left():
    assert G.examine("Ã©tÃ© f\ufffdn")[1] == "partly"

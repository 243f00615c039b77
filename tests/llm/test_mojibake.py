from __future__ import annotations

import hashlib

import pytest

from sylva.llm import mojibake as M

FRENCH = "L’espèce pousse en forêt près de là ; elle y est « commune ». Étamines 3 × 4 cm, œuvre d’été à 5 °C, très marquées."
GERMAN = "Blätter größtenteils „grün“, für möglich gehalten — Äste häufig."
RUSSIAN = "Растёт в местах типа: заболоченные почвы; встречается редко. Листья этого вида бледно-зелёные."
CHINESE = "叶片卵形，长3–17毫米。生于干燥石坡，常见。"
PLAIN = [
    FRENCH, GERMAN, RUSSIAN, CHINESE, "SÃO MÚLTIPLAS AS FORMAS DA REGIÃO; NÃO HÁ COLEÇÕES.", "Île d’Œuf: «â» and «Ã» are two letters.", "the series Ã cost €5, see ‰ column ™.",
    "¿Ácida? ½ ripe, ±3 °C", "", "plain", "Łódź i żółw", "Ελληνικά", "עברית",
]


RUSSIAN_TEXTS = [RUSSIAN, "Кора гладкая, серая, с возрастом трещиноватая. Цветки собраны в рыхлые соцветия.", "Плоды созревают осенью; семена мелкие, чёрные, около двух миллиметров длиной.", "Широко распространён в умеренных областях, на опушках и вдоль рек."]
SIMPLE_TEXTS = [CHINESE, "生于干燥石坡或林缘，海拔三百至一千二百米，常见。", "花白色，排成顶生的圆锥花序；萼片五枚，宿存。", "树皮灰褐色，小枝无毛，冬芽被短柔毛。"]
FULL_TEXTS = ["葉片卵形，長圓形，先端漸尖，基部圓形，邊緣具細鋸齒。", "生於乾燥石坡或林緣，海拔三百至一千二百公尺，常見。", "花白色，排成頂生的圓錐花序；萼片五枚，宿存。", "樹皮灰褐色，小枝無毛，冬芽被短柔毛。"]
JAPANESE_TEXTS = ["葉は卵形で、縁に細かい鋸歯があり、先は尖る。", "乾いた石の多い斜面や林の縁に生え、普通に見られる。", "花は白く、枝先に円錐花序をつくる。", "樹皮は灰褐色で、若い枝には毛がない。"]
SOURCES = {"gbk": SIMPLE_TEXTS, "big5": FULL_TEXTS, "shift_jis": JAPANESE_TEXTS, "euc_jp": JAPANESE_TEXTS}


def garble(text, encoding, intended="utf-8"):
    """Bytes of the intended encoding read as a legacy one; undefined bytes become control characters."""
    out = []
    for b in text.encode(intended):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("encoding", ["latin-1", *M.LEGACY])
@pytest.mark.parametrize("text", [FRENCH, GERMAN, RUSSIAN, CHINESE])
def test_round_trip(text, encoding):
    assert M.repair(garble(text, encoding)) == (True, text)


@pytest.mark.parametrize("text", [FRENCH, GERMAN, "Stipules ovate, 3–17 mm long.", "at 16 °C", "rare — “winged” styles", "Capsules 3 × 4 cm"])
def test_two_layers(text):
    assert M.repair(garble(garble(text, "cp1252"), "cp1252")) == (True, text)


@pytest.mark.parametrize("text", [FRENCH, GERMAN, RUSSIAN])
def test_part_of_a_text(text):
    for a, b in ((0, len(text) // 2), (len(text) // 3, len(text))):
        assert M.repair(text[:a] + garble(text[a:b], "cp1252") + text[b:])[1] == text


def windows(texts, size):
    """Stretches of ``size`` characters at every third place, without the words they cut."""
    out = []
    for t in texts:
        for i in range(0, max(1, len(t) - size + 1), 3):
            w = t[i : i + size]
            if " " in t:
                w = w[0 if i == 0 or t[i - 1] == " " else w.find(" ") + 1 :]
                w = w if t[i + size : i + size + 1] in ("", " ") else w[: w.rfind(" ") + 1]
            out.append(w.strip(" ，。；、,;."))
    return [w for w in out if not w.isascii()]


@pytest.mark.parametrize("pair", M.OTHER)
def test_every_pair_of_encodings(pair):
    """Whole sentences, and stretches of ten (double-byte) or forty (single-byte) characters."""
    texts = SOURCES.get(pair[0], RUSSIAN_TEXTS)
    assert all(M.repair(garble(t, pair[1], pair[0]))[1] == t for t in texts)
    short = windows(texts, 10 if pair[0] in SOURCES else 40)
    right = sum(M.repair(garble(w, pair[1], pair[0]))[1] == w for w in short)
    assert right / len(short) >= 0.95


@pytest.mark.parametrize("encoding", M.LEGACY)
def test_short_stretches_of_utf8(encoding):
    short = windows([FRENCH, GERMAN, *RUSSIAN_TEXTS, *SIMPLE_TEXTS], 20)
    right = sum(M.repair(garble(w, encoding))[1] == w for w in short)
    assert right / len(short) >= 0.94


@pytest.mark.parametrize("layers", [3, 4, 5, 6])
def test_many_layers(layers):
    for text in (FRENCH, RUSSIAN, CHINESE):
        bad = text
        for _ in range(layers):
            bad = garble(bad, "cp1252")
        assert M.repair(bad) == (True, text)


def test_suspects_lose_no_repair():
    texts = [None, "", "plain", *PLAIN, *[garble(t, e) for t in (FRENCH, GERMAN, RUSSIAN, CHINESE) for e in M.LEGACY]]
    texts += [garble(w, pair[1], pair[0]) for pair in M.OTHER for w in windows(SOURCES.get(pair[0], RUSSIAN_TEXTS), 8)]
    texts += [w for t in list(texts) if t for w in windows([t], 7)]
    mask = M.suspects(texts)
    assert all(m or not M.repair(t)[0] for t, m in zip(texts, mask, strict=True))
    assert not mask[:3].any()


def test_single_byte_pairs():
    assert M.repair(RUSSIAN.encode("koi8_r").decode("cp1251")) == (True, RUSSIAN)
    assert M.repair(RUSSIAN.encode("cp1251").decode("latin-1")) == (True, RUSSIAN)


@pytest.mark.parametrize("text", PLAIN)
def test_sound_texts_stay(text):
    assert M.repair(text) == (False, None)


def test_lost_characters():
    assert M.repair("for�t") == (True, "for�t")
    assert M.repair("CafÃ© au dÃ©but … �") == (True, "Café au début … �")


def test_operator(spark):
    long = garble(FRENCH, "cp1252") + " plain" * 50000
    rows = [(1, garble(FRENCH, "cp1252"), "x"), (2, FRENCH, None), (3, None, "y"), (4, "", "z"), (5, "lost � text", "w"), (6, long, "v"), (1, garble(FRENCH, "cp1252"), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Restored string")
    out = M.restore(df, "text", ["doc_id", "Restored"])
    assert "Restored_in" in out.columns
    got = sorted(((r["doc_id"], r["restored"]) for r in out.collect()), key=repr)
    assert [k for k, _ in got] == [1, 1, 5, 6] and got[0][1] == FRENCH and got[2][1] == "lost � text"
    md5 = {r["doc_id"]: r["m"] for r in M.restore(df, "text", ["doc_id"], md5="m").collect()}
    assert md5[1] == hashlib.md5(FRENCH.encode()).hexdigest() and md5[5] == ""
    assert M.restore(df.limit(0), "text", ["doc_id"]).count() == 0

from __future__ import annotations

import os

import pyarrow.parquet as pq
import pytest

from sylva.llm import sentences as S


TABLE = "/root/testdata/sf0.01/accounts.parquet"
pytestmark = pytest.mark.skipif(not os.path.isfile(TABLE), reason="test tables are not here")


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(TABLE, columns=["description", "habitat"])
    return [x for c in range(2) for x in t.column(c).to_pylist() if x]


@pytest.fixture(scope="module")
def model(texts):
    return S.train_on(texts)


def cut(model, text):
    return [text[a:z] for a, z in model.split(text)]


@pytest.mark.parametrize(
    "parts",
    [
        ["Leaves are ovate, cf. Genus subsp. species.", "Fruits 3.5 cm long, ca. 5 mm wide.", "It bears cones etc.", "Seeds small!"],
        ["It was seen by A. B. Smith, No. 12, in Sept. 1950 near Town.", "Is it rare?", "(Seen in fl. Mar. and in fr. Oct. at Town.)", "Leaves red."],
        ["The label reads “Leaves ovate. Flowers red.” and gives no date.", "Bark thin."],
        ["Leaves lobed... later white.", "Bark thin"],
        ["Récolté par A. Petit, n° 12, en janv. 1950.", "Pousse avec d'autres herbes, p. ex. Genus, c.-à-d. sur sols."],
        ["Gesammelt von A. Klein am 3. Okt. 1950 bei Bern.", "Samen klein."],
    ],
)
def test_blank_between(model, parts):
    for gap in (" ", "  ", "\n"):
        assert cut(model, gap.join(parts)) == parts


@pytest.mark.parametrize(
    "parts",
    [
        ["叶片卵形，长3.5cm。", "花白色！", "是否与Genus同属？", "果实小"],
        ["葉は卵形．", "標本の札には「花は白い。実は赤い。」とあり日付はない。", "種子は小さい。"],
        ["पत्तियाँ अंडाकार हैं।", "क्या यह डॉ. क. की जाति है?", "बीज छोटे हैं ।"],
    ],
)
def test_other_scripts(model, parts):
    assert cut(model, "".join(parts) if "叶" in parts[0] or "葉" in parts[0] else " ".join(parts)) == parts


def test_thai(model):
    text = "ใบรูปไข่ยาว 27 - 30 ซม. ผลเกลี้ยง  พบในป่าที่ความสูง 2800 เมตร เมล็ดเกลี้ยง"
    assert cut(model, text) == ["ใบรูปไข่ยาว 27 - 30 ซม.", "ผลเกลี้ยง", "พบในป่าที่ความสูง 2800 เมตร", "เมล็ดเกลี้ยง"]


def test_blank_line_ends(model):
    assert cut(model, "Leaves 3 cm\r\n \r\nSeeds\nsmall.\n") == ["Leaves 3 cm", "Seeds\nsmall."]


def test_one_line_break_of_any_kind_does_not_end(model):
    for mark in ("\n", "\r\n", "\r"):
        assert cut(model, f"Leaves{mark}ovate, 3 cm{mark}long.") == [f"Leaves{mark}ovate, 3 cm{mark}long."]
        assert cut(model, f"Leaves 3 cm{mark}{mark}Seeds small") == ["Leaves 3 cm", "Seeds small"]


def test_degenerate(model):
    for text in (None, "", "  \n ", " "):
        assert model.split(text) == []
    assert cut(model, "...") == ["..."]
    assert cut(model, "a\"b (c [d") == ["a\"b (c [d"]


def test_places_cover_text(model):
    text = "Leaves red. «Bark thin. Seeds.» No 3. (x) y.Flowers z?  "
    spans = model.split(text)
    assert all(a < z and text[a].strip() and text[z - 1].strip() for a, z in spans)
    assert all(z <= a for (_, z), (a, _) in zip(spans, spans[1:], strict=False))
    assert "".join(text[a:z] for a, z in spans).replace(" ", "") == text.replace(" ", "")


#: Sentences written for this test, parted by " | ": other words, names and orders than in the tables.
HELD_OUT = {
    "en": "The stout trunk reaches 12.5 m. | Buds are hairy. | Described by J. K. Rowan from Mt. Eden in Aug. 1931! | Compare with var. alba (see Pl. 4). | Rare near St. Ives. | It has spines, hooks, etc. | Pods ca. 9 cm long. | Was it planted? | Local, cf. Quercus robur. | Pith solid. | Twigs 3 mm in diam. | Sap “bitter. Sticky” when cut. | Grows at 1,200 m. | Habit upright... | The end.",
    "fr": "Le tronc atteint 12,5 m. | Bourgeons poilus. | Décrit par J. K. Ronsard en sept. 1931, n° 44. | Comparer avec la var. alba. | Rare près de St. Jean. | L'écorce est « amère. Collante » à la coupe. | Gousses d'env. 9 cm de long. | Est-il planté ? | Local, p. ex. sur sable, c.-à-d. rarement. | Moelle pleine.",
    "de": "Der Stamm erreicht 12,5 m. | Knospen behaart. | Beschrieben von J. K. Rohde am 7. Sept. 1931 bei Ulm. | Vgl. die var. alba. | Selten bei St. Anton. | Hülsen ca. 9 cm lang. | Wurde er gepflanzt? | Die Rinde ist „bitter. Klebrig“ im Schnitt. | Örtlich, z. B. auf Sand. | Mark voll.",
    "zh": "树干高12.5米。 | 芽有毛！ | 是栽培的吗？ | 标签写道：“树皮苦。粘。”，无日期。 | 荚果长9厘米。",
    "ja": "幹は12.5メートルになる。 | 芽に毛がある． | 植えられたものか？ | 札には「樹皮は苦い。ねばる。」とある。 | さやは長さ9センチ。",
    "hi": "तना 12.5 मीटर ऊँचा है। | कलियाँ रोमिल हैं ॥ | क्या यह डॉ. म. की जाति है? | फली 9 सेमी लंबी है।",
    "th": "ลำต้นสูง 12.5 เมตร | ตามีขน | ฝักยาว 9 ซม. | เนื้อไม้แข็ง",
}


def _counts(split):
    """{language: (right, all)} over the inner boundaries that are or should be."""
    out = {}
    for lang, line in HELD_OUT.items():
        parts = line.split(" | ")
        gap = "" if lang in ("zh", "ja") else " "
        text, want, at = gap.join(parts), set(), 0
        for part in parts[:-1]:
            at += len(part)
            want.add(at)
            at += len(gap)
        got = {z for _, z in split(text)} - {len(text)}
        candidates = {c.end for lo, hi in S.paragraphs(text) for c in S._paragraph(text, lo, hi) if c.begin < hi} | want
        out[lang] = (len(candidates) - len(want ^ got), len(candidates))
    return out


def _by_rules(ev):
    """Labels alone: what isn't known reliably counts as a boundary."""

    def split(text):
        ends = [c.end for lo, hi in S.paragraphs(text) for c in S._paragraph(text, lo, hi) if S.described(c.seen, ev)[1] != 0]
        return list(zip([0, *ends], [*ends, len(text)], strict=False))

    return split


def _share(counts):
    return sum(a for a, _ in counts.values()) / sum(b for _, b in counts.values())


def test_held_out_accuracy(model):
    """Lines that neither the training texts nor the built-in lines hold."""
    counts = _counts(model.split)
    assert all(right / n >= 0.9 for right, n in counts.values()), counts
    assert _share(counts) >= 0.95


def test_model_decides(model, texts):
    """The classifier settles what labels leave open, and not all of it alike: labels alone are worse."""
    unknown = [model.ends(c) for t in texts for lo, hi in S.paragraphs(t) for c in S._paragraph(t, lo, hi) if c.begin < hi and S.described(c.seen, model.evidence)[1] < 0]
    assert len(unknown) > 500 and 0.02 < sum(not x for x in unknown) / len(unknown) < 0.98
    assert _share(_counts(_by_rules(model.evidence))) < _share(_counts(model.split))
    assert 0 < S.probability(model, ["b"]) < 1


def test_evidence_of_parts_adds_up(texts):
    def table(parts):
        out = {}
        for p in parts:
            places, counts = S.count_tokens(p)
            for k, row in zip(places.tolist(), counts.tolist(), strict=True):
                out[k] = [a + b for a, b in zip(out.get(k, [0] * S.KINDS), row, strict=True)]
        return out

    assert table([texts[:400]]) == table([texts[:150], texts[150:151], texts[151:400]])


def test_no_word_lists_in_features(texts):
    """The evidence alone tells abbreviations: an invented one is learnt from its use."""
    made = [f"Seen by Zorb. Miller in town {i}. Bark thin. Leaves wide" + ("." if i % 2 else ", seen by Zorb. Hall. Sap red.") for i in range(300)]
    m = S.train_on([*texts, *made])
    assert cut(m, "Found by Zorb. Hall in town. Bark thin.") == ["Found by Zorb. Hall in town.", "Bark thin."]


def test_operator(spark):
    long = "Leaves red. " * 20000
    rows = [(1, "Leaves red. Bark thin.", None, 7), (2, None, "", 8), (3, long, "Dunes", 9), (1, "Leaves red. Bark thin.", None, 7)]
    df = spark.createDataFrame(rows, "account_id long, description string, habitat string, FIELD int")
    m = S.train(df, ["description", "habitat"], "account_id", sample_texts=3)
    out = S.sentences(df, ["description", "habitat"], ["account_id", "FIELD"], m, text="sentence")
    assert "FIELD_in" in out.columns
    assert sorted(r["sentence"] for r in out.filter("account_id = 1").collect()) == ["Bark thin."] * 2 + ["Leaves red."] * 2
    assert out.filter("account_id = 3").count() == 20001
    empty = df.limit(0)
    assert S.sentences(empty, ["description"], ["account_id"], S.train(empty, ["description"], "account_id")).count() == 0

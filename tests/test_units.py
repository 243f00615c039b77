from __future__ import annotations

import pytest

from sylva.operators import units
from sylva.operators.units import UNITS, read_quantities


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Petals (20–)40.5–67.7(–88·5) millim. long", [("20", 20000), ("40.5", 40500), ("67.7", 67700), ("88·5", 88500)]),
        ("Maße in mm: Blätter 4; Samen 3,5. Staubblätter 5, 2n = 20.", [("4", 4000), ("3,5", 3500)]),
        ("(All in cm) petioles 17.1–31.9; anthers 12.\n\nStamens 5", [("17.1", 171000), ("31.9", 319000), ("12", 120000)]),
        ("anthers 3 ft. 7 in. long, 7′ 1″, 8' 10\" wide", [("3", 1092200), ("7", 2159000), ("8", 2692400)]),
        ("Scales 7 1/4 in., 6⅛ in. long, ½ inch", [("7", 184150), ("6", 155575), ("½", 12700)]),
        ("1700–2'400 m; alt. 3.750 m; 1 700 m; 6,900 ft", [("1700", 1700000000), ("2'4", 2400000000), ("3.7", 3750000000), ("1 7", 1700000000), ("6,9", 2103120000)]),
        ("deux à six millimètres; seven inches", [("deux", 2000), ("six", 6000), ("seven", 177800)]),
        ("长２３.３cm，海拔3700～4200米，५५–74 मिमी", [("２３", 233000), ("3700", 3700000000), ("4200", 4200000000), ("५५", 55000), ("74", 74000)]),
        ("Fruits 19 centimetres–5.3 m, 16 X 22·5 cm", [("19", 190000), ("5.3", 5300000), ("16", 160000), ("22", 225000)]),
        ("No. 7270, in Mar. 1958 at 18 °C, 2n = 58, fig. 3, 5-locular", []),
        ("area 5 cm² and 3 cm", [("3", 30000)]),
        ("6 μm by 45 microns", [("6", 6), ("45", 45)]),
    ],
)
def test_lengths(text, expected):
    got = read_quantities(text)
    assert [(m, v) for _, m, v in got] == [("length", v) for _, v in expected]
    for (start, _, _), (head, _) in zip(got, expected, strict=True):
        assert text[start:].startswith(head)


def test_masses():
    got = [(m, v) for _, m, v in read_quantities("Seeds weigh 3–4 milligrams per hundred, 63gm, 2.5 kg, 14 mgr. each")]
    assert got == [("mass", 3000), ("mass", 4000), ("mass", 63_000_000), ("mass", 2_500_000_000), ("mass", 14_000)]


def test_dimensions():
    assert UNITS["cm"].power(2).dims == (2, 0, 0, 0)
    assert UNITS["g"].times(UNITS["cm"].power(-3)).dims == (-3, 1, 0, 0)
    assert UNITS["°C"].canonical(0) == pytest.approx(273.15)
    assert UNITS["°F"].canonical(32) == pytest.approx(273.15)


@pytest.mark.parametrize(
    "text",
    ["density 5 g/cm³", "10 km/h", "5 kg m-2", "5 kg m⁻²", "3 mg/l", "4 g·cm^-3", "10 m s-1", "5 cm per year", "3 m2", "2 kg/ha", "5 cm²", "6 m³"],
)
def test_other_dimensions_are_no_lengths_or_masses(text):
    assert read_quantities(text) == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("-5 m alt.", [(1, "length", -5_000_000)]),
        ("alt. −5 m", [(6, "length", -5_000_000)]),
        ("3 -5 m", [(0, "length", 3_000_000), (3, "length", 5_000_000)]),
        ("leaf 3-5 m", [(5, "length", 3_000_000), (7, "length", 5_000_000)]),
        ("twenty-five cm", [(0, "length", 250_000)]),
        ("Thirty to forty-two cm", [(0, "length", 300_000), (10, "length", 420_000)]),
        ("vingt et un mm", [(0, "length", 21_000)]),
        ("quatre-vingt-dix m", [(0, "length", 90_000_000)]),
        ("fünfundzwanzig cm", [(0, "length", 250_000)]),
        ("two hundred metres", [(0, "length", 200_000_000)]),
        ("5 lb, 2 oz", [(0, "mass", 2_267_961_850), (6, "mass", 56_699_046)]),
        ("2 yd and 3 miles", [(0, "length", 1_828_800), (9, "length", 4_828_032_000)]),
        ("1500 nm", [(0, "length", 2)]),
        ("5 m/s, then 3 cm", [(12, "length", 30_000)]),
        ("Seeds 5 mm/3 mm", [(6, "length", 5_000), (11, "length", 3_000)]),
        ("8 g·m·m⁻¹", [(0, "mass", 8_000_000)]),
    ],
)
def test_grammar(text, want):
    got = read_quantities(text)
    assert got == want


def test_number_words():
    assert [units.NUMBER_WORDS[w] for w in ("ninety-nine", "soixante et onze", "quatre-vingt-dix-neuf", "neunundneunzig", "zwölf", "neuf cents")] == [99, 71, 99, 99, 12, 900]
    for w, v in units.NUMBER_WORDS.items():
        assert read_quantities(f"{w} km") == [(0, "length", v * 10**9)], w


def test_values_beyond_a_long(spark):
    df = spark.createDataFrame([(1, "99999999999999999999 km"), (2, "3 km")], "id long, t string")
    assert {r["id"]: r["base_value"] for r in units.quantities(df, ["t"], ["id"]).collect()} == {1: None, 2: 3 * 10**9}


def test_operator(spark):
    long = "Leaves 5 mm. " * 20000
    rows = [(1, "3 mm", None, 1), (2, None, "", 2), (3, long, "alt. 5 m", 3), (1, "3 mm", None, 1)]
    df = spark.createDataFrame(rows, "id long, description string, habitat string, FIELD int")
    out = units.quantities(df, ["description", "habitat"], ["id", "FIELD"])
    assert "FIELD_in" in out.columns
    assert [tuple(r)[:1] + tuple(r)[2:] for r in out.filter("id = 1").collect()] == [(1, "description", 0, "length", 3000)] * 2
    assert out.filter("id = 3").count() == 20001
    assert units.quantities(df.limit(0), ["description"], ["id"]).count() == 0

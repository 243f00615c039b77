"""Quantities recorded in different units, converted to one unit per measure.

A small grammar reads numbers (decimals and thousands in several notations,
fractions, mixed numbers, number words, feet and inches, digits of several
scripts) and unit expressions, with products, quotients and powers. A unit is a
vector of dimension exponents with a scale and an offset to the canonical unit; the
vectors of an expression are added, and only expressions whose vector is that of a
wanted measure come out: ``5 g/cm³`` is no mass and ``10 km/h`` no length. Numbers joined by range, extreme or product
marks form one expression in which a number without a unit takes the next one
to its right, else the last to its left; a number without any takes the unit
that its sentence announces ("measurements in mm: ...").

A minus sign before a number counts unless something that it may join stands
before it. Number words are read up to 99, and whole hundreds, in English,
French and German. Values are rounded to whole canonical units, halves upwards.

Defined results: null, blank and numberless texts give no rows; a text of any
length is read whole; the same number stated twice gives a row for each place; a
value beyond the range of a long has ``base_value`` null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sylva.tables import inputs, kinds, names_apart


@dataclass(frozen=True)
class Unit:
    """(length, mass, temperature, time) exponents; canonical = (value + offset) * scale."""

    dims: tuple[int, int, int, int]
    scale: Fraction
    offset: Fraction = Fraction(0)

    def power(self, n: int) -> Unit:
        return Unit(tuple(d * n for d in self.dims), self.scale**n)

    def times(self, other: Unit) -> Unit:
        return Unit(tuple(a + b for a, b in zip(self.dims, other.dims, strict=True)), self.scale * other.scale)

    def canonical(self, value: Fraction) -> Fraction:
        return (value + self.offset) * self.scale

    @lru_cache(1 << 16)  # noqa: B019 - units and values recur
    def whole(self, value: Fraction) -> int:
        """The canonical value rounded, halves upwards."""
        return int((2 * self.canonical(value) + 1) // 2)


MEASURES = {(1, 0, 0, 0): "length", (0, 1, 0, 0): "mass"}
_L, _M, _T, _S1 = (1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1)

#: Unit names by canonical scale (micrometre, microgram, kelvin).
_NAMES: tuple[tuple[tuple[int, int, int, int], Fraction, Fraction, str], ...] = (
    (_L, Fraction(10**9), Fraction(0), "km kilometre kilometres kilometer kilometers kilomètre kilomètres"),
    (_L, Fraction(10**6), Fraction(0), "m metre metres meter meters mètre mètres मीटर เมตร メートル 米 公尺"),
    (_L, Fraction(10**5), Fraction(0), "dm decim decimetre decimetres decimeter decimeters décim décimètre décimètres dezimeter 分米"),
    (_L, Fraction(10**4), Fraction(0), "cm cms centim centimetre centimetres centimeter centimeters centimètre centimètres zentimeter सेमी सेंटीमीटर ซม เซนติเมตร センチメートル センチ 厘米 公分"),
    (_L, Fraction(10**3), Fraction(0), "mm mms millim millimetre millimetres millimeter millimeters millimètre millimètres मिमी मिलीमीटर มม มิลลิเมตร ミリメートル ミリ 毫米"),
    (_L, Fraction(1), Fraction(0), "µm μm um micron microns micrometre micrometres micrometer micrometers micromètre micromètres mikrometer 微米"),
    (_L, Fraction(1, 1000), Fraction(0), "nm nanometre nanometres nanometer nanometers nanomètre nanomètres"),
    (_L, Fraction(914400), Fraction(0), "yd yds yard yards"),
    (_L, Fraction(1609344000), Fraction(0), "mile miles"),
    (_M, Fraction("28349523.125"), Fraction(0), "oz ounce ounces"),
    (_M, Fraction(453592370), Fraction(0), "lb lbs pound pounds"),
    (_M, Fraction(10**12), Fraction(0), "tonne tonnes"),
    (_L, Fraction(25400), Fraction(0), "in inch inches ″ zoll pouce pouces 英寸"),
    (_L, Fraction(304800), Fraction(0), "ft foot feet ′ fuß pied pieds 英尺"),
    (_M, Fraction(1), Fraction(0), "µg μg microgram micrograms microgramme microgrammes mikrogramm"),
    (_M, Fraction(10**3), Fraction(0), "mg mgr mgs mgm milligr milligram milligrams milligramme milligrammes milligramm 毫克 मिग्रा"),
    (_M, Fraction(10**6), Fraction(0), "g gm gms gr gram grams gramme grammes gramm 克 ग्राम กรัม グラム"),
    (_M, Fraction(10**9), Fraction(0), "kg kgs kilo kilos kilogram kilograms kilogramme kilogrammes kilogramm 千克 公斤"),
    (_T, Fraction(1), Fraction(27315, 100), "°C ℃"),
    (_T, Fraction(5, 9), Fraction(45967, 100), "°F"),
)
UNITS = {n: Unit(d, s, o) for d, s, o, names in _NAMES for n in names.split()}
#: Units that are read only as parts of an expression.
PARTS = {n: Unit(d, s) for d, s, names in (
    (_S1, Fraction(1), "s sec second seconds seconde secondes sekunde sekunden"),
    (_S1, Fraction(60), "min minute minutes"),
    (_S1, Fraction(3600), "h hr hour hours heure heures stunde"),
    (_S1, Fraction(86400), "d day days jour jours tag"),
    (_S1, Fraction(31557600), "yr year years an ans jahr"),
    ((3, 0, 0, 0), Fraction(10**15), "l L litre litres liter liters"),
    ((3, 0, 0, 0), Fraction(10**12), "ml mL"),
    ((2, 0, 0, 0), Fraction(10**16), "ha hectare hectares"),
) for n in names.split()}

#: The words that number words are made of: one to nineteen (French: to sixteen), then the tens.
_EN = ("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), "twenty thirty forty fifty sixty seventy eighty ninety".split())
_FR_WORDS = ("un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf".split(), "vingt trente quarante cinquante soixante".split())
_DE = ("ein zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn".split(), "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split())


def _number_words() -> dict[str, int]:
    """Every number word from 1 to 99, and whole hundreds, by the rules of three languages."""
    out = {w: i for ones, _ in (_EN, _FR_WORDS, _DE) for i, w in enumerate(ones, 1)} | {"une": 1, "eine": 1, "einen": 1}
    for t, ten in enumerate(_EN[1], 2):
        out |= {ten: 10 * t} | {f"{ten}{mark}{w}": 10 * t + i for mark in "- " for i, w in enumerate(_EN[0][:9], 1)}
    for t, ten in enumerate(_DE[1], 2):
        out |= {ten: 10 * t} | {f"{w}und{ten}": 10 * t + i for i, w in enumerate(_DE[0][:9], 1)}
    for t, ten in enumerate(_FR_WORDS[1], 2):
        out |= {ten: 10 * t, f"{ten} et un": 10 * t + 1, f"{ten}-et-un": 10 * t + 1} | {f"{ten}-{w}": 10 * t + i for i, w in enumerate(_FR_WORDS[0][:9], 1) if i > 1}
    out |= {f"soixante-{w}": 60 + i for i, w in enumerate(_FR_WORDS[0], 1) if i > 9} | {"soixante et onze": 71}
    out |= {"quatre-vingts": 80} | {f"quatre-vingt-{w}": 80 + i for i, w in enumerate(_FR_WORDS[0], 1)}
    for i in range(2, 10):
        out |= {f"{_EN[0][i - 1]} hundred": 100 * i, f"{_FR_WORDS[0][i - 1]} cents": 100 * i, f"{_DE[0][i - 1]}hundert": 100 * i}
    return out | {"hundred": 100, "one hundred": 100, "cent": 100, "hundert": 100, "einhundert": 100}


NUMBER_WORDS = _number_words()
_SIGNS = {"¼": Fraction(1, 4), "½": Fraction(1, 2), "¾": Fraction(3, 4), "⅓": Fraction(1, 3), "⅔": Fraction(2, 3), "⅛": Fraction(1, 8), "⅜": Fraction(3, 8), "⅝": Fraction(5, 8), "⅞": Fraction(7, 8)}

_DIGITS = str.maketrans({chr(z + i): str(i) for z in (0xFF10, 0x0966, 0x0E50, 0x0660) for i in range(10)})
_OTHER_DIGIT = re.compile("[０-９०-९๐-๙٠-٩]")
_S = "[ \\t\\r\\n\u00a0\u202f\u2009\u3000]"
_FR = "".join(_SIGNS)
_LAT = "A-Za-zÀ-ÖØ-öø-ÿ"
_ONE = rf"(?:\d+{_S}?[{_FR}]|\d+{_S}\d+[/⁄]\d+|\d+[/⁄]\d+|[{_FR}]|\d{{1,3}}(?:(?P<g>[ \u00a0\u202f'’.,])\d{{3}})(?:(?P=g)\d{{3}})*(?!\d)(?:[.,·]\d+(?!\d))?|\d+[.,·]\d+|\d+)"
_PLAIN = _ONE.replace("(?P<g>", "(").replace("(?P=g)", r"[ \u00a0\u202f'’.,]")


def _trie(words: list[str]) -> str:
    """A pattern for the longest of some words, branching by letter."""
    heads = sorted({w[0] for w in words if w})
    parts = []
    for h in heads:
        rest = [w[1:] for w in words if w[:1] == h]
        parts.append((_S if h == " " else re.escape(h)) + (_trie(rest) if any(rest) else ""))
    body = parts[0] if len(parts) == 1 and "" not in words else "(?:" + "|".join(parts) + ")"
    return f"(?:{body})?" if "" in words else body


_WORDS = _trie(sorted(NUMBER_WORDS))
_HEADS = "".join(sorted({h for w in NUMBER_WORDS for h in (w[0], w[0].upper())} | set("toàTOÀxXbBsSpPmMaAuU")))
_latin = sorted((u for u in UNITS if u[0] in "µμ°" or re.match(f"[{_LAT}]", u)), key=len, reverse=True)
_other = sorted((u for u in UNITS if u not in _latin), key=len, reverse=True)
_cased = [u for u in _latin if len(u) <= 2 or u[0] in "µμ°"]
_words = [u for u in _latin if u not in _cased]
UNIT_PATTERN = rf"(?:(?:(?i:{'|'.join(map(re.escape, _words))})|{'|'.join(map(re.escape, _cased))})(?![{_LAT}0-9])|{'|'.join(map(re.escape, _other))}|ม(?=\.))"
_FEET_INCHES = re.compile(rf"(\d+){_S}*(?:ft\.?|feet|foot|['’′]){_S}*({_PLAIN}){_S}*(?:inches|inch|in(?![{_LAT}])|[\"”″]|['’′]{{2}})")
_POWER = r"(?P<power>\^?[-−]?[2-4](?![0-9.,])|\^?[-−]1(?![0-9.,])|⁻?[¹²³⁴])?"
_UNIT = re.compile(rf"{_S}*({UNIT_PATTERN.replace('0-9])', '])')}){_POWER.replace('[-−]?[2-4]', '[2-4]').replace('|⁻?[¹²³⁴]', '|[²³⁴]').replace('|' + chr(92) + '^?[-−]1(?![0-9.,])', '')}(?![0-9])")
_FACTOR = "|".join(sorted(map(re.escape, [*PARTS, *_latin, *_other]), key=len, reverse=True))
#: What may follow a unit: a quotient, a product, or a blank and a unit with a negative power.
_MORE = re.compile(
    rf"{_S}?(?P<op>/|(?<![{_LAT}])(?:per|pro|par|je)(?![{_LAT}])|[·⋅]){_S}?(?P<unit>{_FACTOR}){_POWER}(?![{_LAT}0-9])"
    rf"|{_S}(?P<unit2>{_FACTOR})(?P<power2>\^?[-−][1-4]|⁻[¹²³⁴])(?![{_LAT}0-9])"
)
_SUPER = str.maketrans("⁻¹²³⁴−", "-1234-")
_IN_ENDS = re.compile(rf"{_S}+(?:length|diam|width|height|thickness|breadth|fl\b|fr\b|[A-Z0-9])")
_END = r"[.!?…](?=\s|$|[A-ZÀ-ÖØ-Þ(\"“«‘])|[。．！？।॥]|\r?\n[ \t\u00a0]*\r?\n"
_TOKEN = re.compile(
    rf"(?=[\d{_FR}])(?P<num>(?<![{_LAT}\d])(?<!\d[.,·])(?:{_ONE}))"
    rf"|(?=[{_HEADS}])(?<![{_LAT}\-])(?P<word>(?i:{_WORDS})(?![{_LAT}]))"
    rf"|(?P<conn>[-–—−‐‑~～〜×✕*]|(?<![{_LAT}])(?:to|à|bis|or|ou|oder|x|X|by|sur|par|mal|auf)(?![{_LAT}])|至|到|から|से|ถึง)"
    rf"|(?P<open>[(（])|(?P<close>[)）])|(?P<end>{_END})"
)
_HEAD = re.compile(
    rf"(?:(?<![{_LAT}])(?:in|en){_S}+({UNIT_PATTERN})\.?(?={_S}*[:)：）])|(?i:(?<![{_LAT}])(?:all|alle|tout|tous|toutes|measurements|measured|dimensions|mesures|maße|angaben){_S}+(?:in|en)){_S}+({UNIT_PATTERN}))"
)
_STOP = re.compile(_END)
_SOME = re.compile(rf"\d|[{_FR}]|(?=[{_HEADS}])(?<![{_LAT}])(?i:{_WORDS})(?![{_LAT}])")


def _unit(name: str, power: str | None = None) -> Unit | None:
    u = UNITS.get(name) or PARTS.get(name) or UNITS.get(name.lower()) or (UNITS["เมตร"] if name == "ม" else None)
    if u is not None and power:
        u = u.power(int(power.translate(_SUPER).lstrip("^")))
    return u


def _expression(t: str, m: re.Match[str]) -> tuple[Unit | None, int]:
    """The unit of the expression that begins with the unit ``m``, and its end."""
    unit, end = _unit(m[1], m["power"]), m.end()
    while unit is not None and (more := _MORE.match(t, end)):
        part = _unit(more["unit"] or more["unit2"], more["power"] or more["power2"])
        if part is None:
            break
        unit = unit.times(part.power(-1) if more["op"] and more["op"] not in "·⋅" else part)
        end = more.end()
    return unit, end


_MIXED_SIGN = re.compile(rf"(\d*){_S}?([{_FR}])")
_FRACTION = re.compile(rf"(?:(\d+){_S})?(\d+)[/⁄](\d+)")
_GROUPED = re.compile(r"([1-9]\d{0,2})(?:([ \u00a0\u202f'’.,])\d{3})((?:\2\d{3})*)(?:[.,·](\d+))?")


@lru_cache(1 << 16)
def _value(text: str) -> Fraction | None:
    """The value of a number as written."""
    low = re.sub(_S, " ", text.lower())
    if low in NUMBER_WORDS:
        return Fraction(NUMBER_WORDS[low])
    m = _MIXED_SIGN.fullmatch(text)
    if m:
        return Fraction(int(m[1] or 0)) + _SIGNS[m[2]]
    m = _FRACTION.fullmatch(text)
    if m:
        return None if int(m[3]) == 0 else Fraction(int(m[1] or 0)) + Fraction(int(m[2]), int(m[3]))
    m = _GROUPED.fullmatch(text)
    if m:
        mark = m[2]
        whole, _, part = (text, "", "") if m[4] is None else (text[: -len(m[4]) - 1], "", m[4])
        return Fraction(whole.replace(mark, "") + (f".{part}" if part else ""))
    return Fraction(re.sub("[,·]", ".", text))


def _negative(t: str, sign: int, tokens: list) -> bool:
    """Whether the sign at a place belongs to the number behind it: it stands free, and no number reaches up to it."""
    if sign and t[sign - 1] not in " \t\r\n\u00a0=:":
        return False
    if not tokens or tokens[-1][:2] != ("conn", sign):
        return False
    if len(tokens) == 1:
        return True
    before = tokens[-2]
    return before[0] == "end" or bool(t[before[4] : sign].strip(" \t\r\n\u00a0\u202f\u2009\u3000."))


def read_quantities(text: str) -> list[tuple[int, str, int]]:
    """(start, measure, canonical value) of each number of ``text`` that states a wanted measure."""
    t = text.translate(_DIGITS) if _OTHER_DIGIT.search(text) else text
    if not _SOME.search(t):
        return []
    tokens: list[tuple[str, int, Fraction | None, Unit | None, int]] = []  # kind, start, value, unit, end
    at = 0
    while (m := _TOKEN.search(t, at)) is not None:
        kind, end = m.lastgroup, m.end()
        if kind == "g":
            kind = "num"
        if kind in ("num", "word"):
            if kind == "num" and (f := _FEET_INCHES.match(t, m.start())):
                inches = _value(f[2])
                value = Fraction(int(f[1])) * 304800 + (inches or 0) * 25400
                tokens.append(("num", m.start(), value, Unit(_L, Fraction(1)), f.end()))
                at = f.end()
                continue
            unit = None
            if u := _UNIT.match(t, end):
                unit, after = _expression(t, u)
                if u[1] == "in" and (_IN_ENDS.match(t, u.end()) or t[u.end() : u.end() + 1].isdigit()):
                    unit = None
                else:
                    end = after
            if unit is None and t[end : end + 1] == "%":
                unit = Unit((0, 0, 0, 0), Fraction(1))
            value = _value(m[0])
            if value is not None and kind == "num" and t[m.start() - 1 : m.start()] in ("-", "−") and _negative(t, m.start() - 1, tokens):
                value = -value
                tokens.pop()  # the sign is no mark of a range
            if value is not None:
                tokens.append((kind, m.start(), value, unit, end))
        else:
            unit = None
            if kind == "close" and (u := _UNIT.match(t, end)) and u[1] != "in":
                unit, end = _expression(t, u)
            tokens.append((kind, m.start(), None, unit, end))
        at = max(end, m.start() + 1)
    if not any(k[0] in ("num", "word") for k in tokens):
        return []
    heads = [(h.start(), _unit(h[1] or h[2], None)) for h in _HEAD.finditer(t)]
    stops = [s.end() for s in _STOP.finditer(t)] if heads else []

    def announced(place: int) -> Unit | None:
        before = max((s for s in stops if s <= place), default=0)
        after = min((s for s in stops if s > place), default=len(t) + 1)
        return next((u for s, u in heads if before <= s < after), None)

    out: list[tuple[int, str, int]] = []
    group: list[tuple[str, int, Fraction, Unit | None]] = []

    def close() -> None:
        units: list[Unit | None] = [g[3] for g in group]
        known = None
        for i in range(len(group) - 1, -1, -1):
            known = units[i] = units[i] or known
        known = None
        for i in range(len(group)):
            known = units[i] = units[i] or known
        for (kind, start, value, _), unit in zip(group, units, strict=True):
            unit = unit or (announced(start) if heads and kind == "num" else None)
            if unit is not None and (name := MEASURES.get(unit.dims)):
                out.append((start, name, unit.whole(value)))
        group.clear()

    joined, last_end = False, -1
    for kind, start, value, unit, end in tokens:
        gap = t[last_end:start] if last_end >= 0 else ""
        near = not gap.strip(" \t\r\n\u00a0\u202f\u2009\u3000.")
        if not near or kind == "end":
            close()
            joined = False
        if kind in ("num", "word"):
            if group and not joined:
                close()
            group.append((kind, start, value, unit))
            joined = False
        elif kind == "conn":
            joined = True
        elif kind == "close" and unit is not None and group and group[-1][3] is None:
            group[-1] = (*group[-1][:3], unit)  # a unit behind the bracket of an extreme
        last_end = end
    close()
    return out


def quantities(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per stated quantity: ``keep``, then ``field`` (the column), ``num_start``,
    ``measure`` and ``base_value`` (µm or µg). Narrow: no shuffle."""
    produced = ["field", "num_start", "measure", "base_value"]
    names = names_apart(keep, produced)
    types = kinds(df, keep)
    schema = T.StructType(
        [T.StructField(names[k], types[k]) for k in keep]
        + [T.StructField("field", T.StringType()), T.StructField("num_start", T.IntegerType()), T.StructField("measure", T.StringType()), T.StructField("base_value", T.LongType())]
    )
    source = inputs(df, keep, columns)
    width, fields = len(keep), tuple(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, what, starts, measures, values = [], [], [], [], []
            for c, name in enumerate(fields):
                for r, text in enumerate(batch.column(width + c).to_pylist()):
                    for start, measure, value in read_quantities(text) if text else ():
                        rows.append(r)
                        what.append(name)
                        starts.append(start)
                        measures.append(measure)
                        values.append(value if -(2**63) <= value < 2**63 else None)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(take) for i in range(width)], pa.array(what, pa.string()), pa.array(starts, pa.int32()), pa.array(measures, pa.string()), pa.array(values, pa.int64())],
                names=schema.fieldNames(),
            )

    return source.mapInArrow(run, schema)

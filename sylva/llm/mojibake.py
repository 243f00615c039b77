"""Text decoded with the wrong character encoding: found, and restored where possible.

Round-trip repair: text is encoded again under a candidate legacy encoding and
strictly decoded as the intended one. Damage may cover only part of a text, so
the trip is made for each stretch that can hold it: characters whose bytes form
UTF-8 sequences, words that another single-byte encoding reads differently, or
characters whose bytes form double-byte sequences. A stretch is changed when
its garbling cost drops far enough for its length. Accepted text is tried again
for nested layers, whatever their number, until nothing more is accepted; of the
texts that the trips reach, the one of least cost wins.

The garbling cost is a sum over neighbouring characters: each character belongs
to one of a few dozen classes, each class has a cost of its own, and each pair
of neighbouring classes another. Thus the cost of all texts of a batch is read
from two tables with numpy. An accepted stretch must drop by a stated cost per
character, so a stretch that doesn't cost as much can't be accepted, whatever
it decodes to: ``suspects`` finds the others from the buffer, and only their
texts are repaired one by one. That test loses no repair.

Defined results: null, empty and plain ASCII texts are not affected; whole
texts are read; in a text that holds replacement characters the rest is
repaired, the replacement characters stay, and its MD5 is ''.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sylva.functions.buffers import slices
from sylva.tables import inputs, kinds, names_apart

#: Legacy encodings that texts get decoded with by mistake, likeliest first.
LEGACY = ("cp1252", "cp1250", "mac_roman", "cp437", "cp1251", "cp850", "koi8_r", "cp1254", "iso8859_2", "cp866", "mac_cyrillic", "cp1253", "iso8859_15")
#: Fixed values: (intended, mistaken) pairs besides UTF-8.
SINGLE = (("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"))
DOUBLE = (("gbk", "cp1252"), ("big5", "cp1252"), ("shift_jis", "cp1252"), ("euc_jp", "cp1252"))
OTHER = (*SINGLE, *DOUBLE)
LOST = "�"
UTF8_DROP, OTHER_DROP, LEAST_DROP = 0.2, 0.25, 1.0  # cost per changed character, and in all
CERTAIN = 8
SOUND = 0.1  # most cost per non-ASCII character of sound text


def _table(encoding: str) -> dict[str, int]:
    """char -> byte, undefined bytes standing for the control characters of their number."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            out.setdefault(bytes([b]).decode(encoding), b)
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    if encoding in ("cp1252", "cp1254", "iso8859_15"):
        for b in range(0x80, 0xA0):  # the control characters of Latin-1
            out.setdefault(chr(b), b)
    return out


_TABLES = {e: _table(e) for e in {*LEGACY, *(w for _, w in OTHER)}}

# --- The garbling cost -------------------------------------------------------------------------------------------

_CLASSES = (
    "gap low cap num pun llow lcap lead ext sym nums deg guil inv dash quo euro gpun c1 nb greek mark "
    "cv cc cvr ccr cj cs ch cvu ccu cvru ccru cju csu chu cyr cyrx box kana cjkp hanc hanb hans hanr hanx comb letter other half bad lost"
).split()
_MARKS = "\u0300\u0301\u0302\u0303\u0304\u0306\u0308\u030a\u030c\u0327\u0328"
_ID = {n: i for i, n in enumerate(_CLASSES)}
_SETS = {
    "lead": "ÃÂÐÑ", "nums": "×÷½¼¾±", "deg": "°²³ªº·µ", "guil": "«»", "inv": "¿¡", "dash": "–—", "quo": "“”’‘„…•", "euro": "€™‰", "nb": "   ",
    "cv": "аеёиоуя", "cvr": "эю", "cc": "бвгдзклмнпрстч", "ccr": "жфхцшщ", "cj": "й", "cs": "ьы", "ch": "ъ", "cvu": "АЕЁИОУЯ", "cvru": "ЭЮ", "ccu": "БВГДЗКЛМНПРСТЧ",
    "ccru": "ЖФХЦШЩ", "cju": "Й", "csu": "ЬЫ", "chu": "Ъ", "llow": "œšž", "lcap": "ŒŠŽŸ", "lost": LOST,
}


def _level(char: str, encoding: str, lo: int, hi: int) -> bool:
    try:
        b = char.encode(encoding)
    except UnicodeEncodeError:
        return False
    return len(b) == 2 and lo <= b[0] * 256 + b[1] <= hi


#: The bits of the levels of everyday characters: of simplified, traditional and Japanese standards.
_HOME = {"gbk": 1, "big5": 2, "shift_jis": 4, "euc_jp": 4}


def _class_tables() -> tuple[np.ndarray, np.ndarray]:
    """(class, home bits) of each character of the first plane; the last entry stands for all others."""
    cls, home = np.full(0x10001, _ID["other"], np.uint8), np.zeros(0x10001, np.uint8)
    for o in range(0x10000):
        c = chr(o)
        if o < 0x80:
            name = "low" if c.islower() else "cap" if c.isupper() else "num" if c.isdigit() else "gap" if c in " \t\n\r\f\v" else "bad" if o < 32 or o == 127 else "pun"
        elif o < 0xA0:
            name = "c1"
        elif o < 0xC0 or o in (0xD7, 0xF7):
            name = "sym"
        elif o < 0x100:
            name = "lcap" if c.isupper() else "llow"
        elif o < 0x180:
            name = "ext"
        elif 0x300 <= o < 0x370:
            name = "mark" if c in _MARKS else "comb"
        elif 0x370 <= o < 0x400:
            name = "greek"
        elif 0x400 <= o < 0x460:
            name = "cyr"
        elif 0x460 <= o < 0x530:
            name = "cyrx"
        elif c in "ƒˆ˜‚‛‟†‡‰‹›′″‐‑‒―":
            name = "gpun"
        elif 0x2500 <= o < 0x25A0:
            name = "box"
        elif 0x3040 <= o < 0x3100:
            name = "kana"
        elif 0x3000 <= o < 0x3040 or 0xFF01 <= o < 0xFF61:
            name = "cjkp"
        elif 0xFF61 <= o < 0xFFA0:
            name = "half"
        elif 0x4E00 <= o < 0xA000:
            bits = _level(c, "gb2312", 0xB0A1, 0xD7F9) + 2 * _level(c, "big5", 0xA440, 0xC67E) + 4 * _level(c, "shift_jis", 0x889F, 0x9872)
            home[o] = bits
            name = ("hans", "hanb", "hanc")[bits.bit_count() - 1] if bits else "hanr" if _level(c, "gb2312", 0, 0xFFFF) or _level(c, "big5", 0, 0xFFFF) or _level(c, "shift_jis", 0, 0xFFFF) else "hanx"
        else:
            kind = unicodedata.category(c)
            name = "bad" if kind in ("Cn", "Co", "Cs", "Cc") else "letter" if kind[0] in "LM" else "other"
        cls[o] = _ID[name]
    for name, chars in _SETS.items():
        for c in chars:
            cls[ord(c)] = _ID[name]
    home[0x3000:0x3040] = home[0xFF01:0xFF61] = 7
    home[0x3040:0x3100] = 4
    return cls, home


def _pair_costs() -> np.ndarray:
    """[before, after] cost of two neighbouring classes; that of the second alone is part of it."""
    n = len(_CLASSES)
    alone = np.zeros(n)
    for names, x in (
        ("lead sym greek hanx letter", 0.5), ("mark", 0.2), ("ext cyr half comb", 1.0), ("gpun hanr", 0.7), ("hanb", 0.02), ("hans", 0.1), ("other box", 2.0), ("c1 cyrx", 3.0), ("bad", 5.0), ("ccr ccru", 0.4),
        ("cvr cvru", 0.3), ("greek hanx", 0.5), ("lost", 0.5),
    ):
        for k in names.split():
            alone[_ID[k]] += x
    p = np.tile(alone, (n, 1))

    def add(before: str, after: str, x: float) -> None:
        for a in before.split():
            for b in after.split():
                p[_ID[a], _ID[b]] += x

    ascii_, high = "low cap", "llow lcap lead ext"
    latin, signs = f"{ascii_} {high}", "sym gpun euro"
    lower, upper = "cv cc cvr ccr cj cs ch", "cvu ccu cvru ccru cju csu chu"
    cyrillic, asian = f"{lower} {upper} cyr cyrx", "kana hanc hanb hans hanr hanx half"
    # Scripts don't mix inside a word.
    for a, b, x in ((latin, "greek", 2), (latin, cyrillic, 2), ("greek", cyrillic, 2), (high, asian, 2), (cyrillic, asian, 2), ("greek", asian, 1), (ascii_, asian, 0.5), (latin, "letter", 2), (cyrillic, "letter", 2), ("greek", "letter", 2), (asian, "letter", 2), (f"{signs} deg nums inv other box c1", "letter", 1.5), ("gap pun", "letter", 0.75)):
        add(a, b, x)
        add(b, a, x)
    # Signs don't stand inside words, nor right behind accented letters.
    add(latin, signs, 0.75)
    add(signs, latin, 0.75)
    add(high, signs, 0.75)
    add(signs, high, 0.75)
    add("lcap", "quo", 0.5)
    add("lcap lead", "gap pun", 0.3)
    add("low", "nums", 0.75)
    add("llow lcap ext", "deg nums inv", 1.0)
    add("lead", "deg nums inv", 1.5)
    add("lead", "guil dash quo nb", 1.0)
    add("inv", "nums deg", 1.0)
    add(f"{signs} nums deg inv", f"{signs} deg", 0.5)
    add("llow lcap lead ext", "dash", 0.6)
    add("dash", "llow lcap lead ext", 0.6)
    add("dash", f"{signs} deg other", 0.6)
    add(f"{signs} deg other", "dash", 0.6)
    add("dash", cyrillic, 0.6)
    add(lower, "dash", 0.4)
    add("greek", f"{signs} deg nums inv", 1.5)
    add("other box", f"{latin} {signs} deg nums inv {cyrillic}", 0.5)
    # Accented letters seldom stand side by side; capitals don't follow small letters.
    add(high, high, 0.45)
    add("low llow", "lcap lead", 1.0)
    # Cyrillic spelling.
    add(cyrillic, f"{signs} deg nums inv", 1.5)
    add(f"{signs} deg nums", cyrillic, 0.75)
    add(upper, "guil dash", 1.0)
    add(upper, "quo", 1.0)
    add(upper, "nb", 0.7)
    add(lower, upper, 1.5)
    add(upper, upper, 0.3)
    add("cc ccr ccu ccru cs csu ch chu", "cj cju", 2.0)
    add("gap pun", "cj cju", 0.5)
    add("gap pun", "cs csu ch chu", 2.0)
    add("ch chu", "cc ccr cj cs ccu ccru cju csu gap pun", 1.5)
    add("cv cvr cj cs cvu cvru cju csu", "cs csu ch chu", 1.0)
    add(asian, f"{signs} deg nums", 0.75)
    add(f"{signs} deg nums", asian, 0.4)
    return p.ravel()


_CLS, _HOME_BITS = _class_tables()
_PAIR = _pair_costs()
_N = len(_CLASSES)
_BAD, _GAP = _ID["bad"], _ID["gap"]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _costs(codes: np.ndarray) -> np.ndarray:
    """Running sums s with s[z + 1] - s[a] the cost of characters [a, z) and of their contacts with their neighbours."""
    c = np.full(len(codes) + 2, _GAP, np.intp)
    c[1:-1] = _CLS[np.minimum(codes, 0x10000)]
    out = np.zeros(len(codes) + 2)
    np.cumsum(_PAIR[c[:-1] * _N + c[1:]], out=out[1:])
    return out


def _unpaired(text: str) -> float:
    low, up, down = text.count("„"), text.count("“"), text.count("”")
    return 2.0 * (abs(text.count("«") - text.count("»")) + (abs(low - up - down) if low else abs(up - down)))


def cost(text: str) -> float:
    """How garbled a text looks."""
    return float(_costs(_codes(text))[-1]) + _unpaired(text)


# --- Trips -------------------------------------------------------------------------------------------------------


def _class(chars: Sequence[str]) -> str:
    return "[" + "".join(re.escape(c) for c in chars) + "]"


def _between(encoding: str, *spans: tuple[int, int]) -> str:
    """A pattern for the characters of the bytes in the spans; those below 128 are ASCII."""
    return _class([c for c, b in _TABLES[encoding].items() if any(lo <= b <= hi for lo, hi in spans)] + [chr(b) for lo, hi in spans for b in range(lo, min(hi, 0x7F) + 1)])


def _utf8_runs(encoding: str) -> re.Pattern[str]:
    by = lambda lo, hi: _between(encoding, (lo, hi))
    tail = by(0x80, 0xBF)
    three = f"{by(0xE0, 0xE0)}{by(0xA0, 0xBF)}{tail}|(?:{by(0xE1, 0xEC)}|{by(0xEE, 0xEF)}){tail}{tail}|{by(0xED, 0xED)}{by(0x80, 0x9F)}{tail}"
    four = f"{by(0xF0, 0xF0)}{by(0x90, 0xBF)}{tail}{tail}|{by(0xF1, 0xF3)}{tail}{tail}{tail}|{by(0xF4, 0xF4)}{by(0x80, 0x8F)}{tail}{tail}"
    return re.compile(f"(?:{by(0xC2, 0xDF)}{tail}|{three}|{four})+")


def _double_runs(intended: str, wrong: str) -> re.Pattern[str]:
    by = lambda *spans: _between(wrong, *spans)
    one = {
        "gbk": by((0x81, 0xFE)) + by((0x40, 0x7E), (0x80, 0xFE)),
        "big5": by((0xA1, 0xF9)) + by((0x40, 0x7E), (0xA1, 0xFE)),
        "shift_jis": by((0x81, 0x9F), (0xE0, 0xEF)) + by((0x40, 0x7E), (0x80, 0xFC)) + "|" + by((0xA1, 0xDF)),
        "euc_jp": by((0xA1, 0xFE)) + by((0xA1, 0xFE)) + "|" + by((0x8E, 0x8E)) + by((0xA1, 0xDF)) + "|" + by((0x8F, 0x8F)) + by((0xA1, 0xFE)) * 2,
    }[intended]
    return re.compile(f"(?:{one})+(?:[\\n\\r\\t -@\\[-`{{-~]*(?:{one})+)*")


_RUNS = {e: _utf8_runs(e) for e in LEGACY}
_DOUBLE_RUNS = {pair: _double_runs(*pair) for pair in DOUBLE}
_HIGH_WORD = re.compile("[^\x00-\x7f]+")
_HIGH = re.compile("[^\x00-\x7f]")


def _reread(intended: str, wrong: str) -> dict[int, str]:
    """Character by character: what ``intended`` reads where ``wrong`` was read."""
    out: dict[int, str] = {}
    for c, b in _TABLES[wrong].items():
        try:
            out[ord(c)] = bytes([b]).decode(intended)
        except UnicodeDecodeError:
            out[ord(c)] = LOST + LOST  # never accepted: no such byte
    return out


_REREAD = {pair: _reread(*pair) for pair in SINGLE}


def _bytes(run: str, table: dict[str, int]) -> bytes:
    return bytes(table[c] if c in table else ord(c) for c in run)


@dataclass
class Trip:
    """A text read anew: where it was changed, how many characters, and a penalty for characters the intended encoding seldom holds."""

    text: str
    spans: list[tuple[int, int]]
    changed: int
    penalty: float = 0.0


def _spliced(text: str, spans: list[tuple[int, int, str]], rate: float, homes: int = 0) -> Trip:
    """The text with those spans replaced whose cost drops by ``rate`` a character."""
    parts: list[str] = []
    at = 0
    for a, z, new in spans:
        parts += (text[at:a], new)
        at = z
    parts.append(text[at:])
    fresh = _codes("".join(parts))
    before, after = _costs(_codes(text)), _costs(fresh)
    bad = np.flatnonzero(_CLS[np.minimum(fresh, 0x10000)] == _BAD)
    shift = 0
    judged: list[tuple[bool, bool, int, float]] = []  # changed, no worse, characters, penalty
    for a, z, new in spans:
        b, e = a + shift, a + shift + len(new)
        shift += len(new) - (z - a)
        count = sum(c > "\x7f" for c in text[a:z])
        drop = (before[z + 1] - before[a]) - (after[e + 1] - after[b])
        strange = 0.0
        if homes:
            inner = fresh[b:e]
            strange = 0.5 * float(((_HOME_BITS[np.minimum(inner, 0x10000)] & homes) == 0)[inner > 0x7F].sum())
        sane = not (len(bad) and np.searchsorted(bad, b) < np.searchsorted(bad, e))
        judged.append((sane and drop > 0 and drop - strange >= rate * count, sane and drop >= 0, count, strange))
    changed, penalty, at = 0, 0.0, 0
    kept: list[str] = []
    places: list[tuple[int, int]] = []
    for i, ((a, z, new), (good, fair, count, strange)) in enumerate(zip(spans, judged, strict=True)):
        # What shows no evidence, but isn't worse, goes with changed neighbours on both sides.
        if good or fair and not homes and 0 < i < len(spans) - 1 and judged[i - 1][0] and judged[i + 1][0]:
            kept += (text[at:a], new)
            at = z
            places.append((a, z))
            changed += count
            penalty += strange
    kept.append(text[at:])
    return Trip("".join(kept), places, changed, penalty)


def _utf8_trip(text: str, encoding: str) -> Trip:
    table = _TABLES[encoding]
    spans = []
    for m in _RUNS[encoding].finditer(text):
        if m[0][-1] == "»" and text[m.start() - 1 : m.start()] == "«":
            continue  # a letter in whole guillemets
        spans.append((m.start(), m.end(), _bytes(m[0], table).decode("utf-8")))
    return _spliced(text, spans, UTF8_DROP) if spans else Trip(text, [], 0)


def _double_trip(text: str, pair: tuple[str, str]) -> Trip:
    table = _TABLES[pair[1]]
    spans = []
    for m in _DOUBLE_RUNS[pair].finditer(text):
        try:
            spans.append((m.start(), m.end(), _bytes(m[0], table).decode(pair[0])))
        except UnicodeDecodeError:
            # Bytes that aren't assigned end a stretch; its other parts may still be read.
            for part in re.finditer(_DOUBLE_RUNS[pair].pattern.split("+(?:[", 1)[0] + "+", m[0]):
                try:
                    spans.append((m.start() + part.start(), m.start() + part.end(), _bytes(part[0], table).decode(pair[0])))
                except UnicodeDecodeError:
                    continue
    return _spliced(text, spans, OTHER_DROP, _HOME[pair[0]]) if spans else Trip(text, [], 0)


def _single_trip(text: str, pair: tuple[str, str]) -> Trip:
    """The stretches of words that cost least when read anew: maximal runs of words whose cost drops by more
    than the rate in sum, so that a short word without evidence goes with its neighbours."""
    table = _REREAD[pair]
    words = [(m.start(), m.end()) for m in _HIGH_WORD.finditer(text) if m[0][0] in _TABLES[pair[1]]]
    if not words:
        return Trip(text, [], 0)
    whole = text.translate(table)
    if len(whole) != len(text):  # characters that no byte of the intended encoding stands for
        whole = "".join(r if len(r := table.get(ord(c), c)) == 1 else LOST for c in text)
    before, after = _costs(_codes(text)), _costs(_codes(whole))
    drops = [(before[z + 1] - before[a]) - (after[z + 1] - after[a]) - 9.0 * whole[a:z].count(LOST) for a, z in words]
    gains = [d - OTHER_DROP * (z - a) for d, (a, z) in zip(drops, words, strict=True)]
    spans: list[list[float]] = []  # first word, last word, sum before, sum after: the maximal scoring stretches
    total = 0.0
    for i, g in enumerate(gains):
        low, total = total, total + g
        if g <= 0:
            continue
        now = [i, i, low, total]
        while True:
            j = len(spans) - 1
            while j >= 0 and spans[j][2] >= now[2]:
                j -= 1
            if j < 0 or spans[j][3] >= now[3]:
                spans.append(now)
                break
            now = [spans[j][0], now[1], spans[j][2], now[3]]
            del spans[j:]
    chosen = []
    changed = 0
    done = 0
    for lo, hi, _, _ in spans:
        first, last = int(lo), int(hi)
        count = sum(e - b for b, e in words[first : last + 1])
        if count >= 4:
            while first > done and drops[first - 1] > 0:  # neighbours with less evidence go along
                first -= 1
            while last + 1 < len(words) and drops[last + 1] > 0:
                last += 1
            if all(d >= 0 for d in drops[done:first]) and done == 0:  # nor does what is left to either end of the text say otherwise
                first = 0
            if all(d >= 0 for d in drops[last + 1 :]):
                last = len(words) - 1
            done = last + 1
            chosen.append((words[first][0], words[last][1]))
            changed += count
    out, at = [], 0
    chosen = [s for i, s in enumerate(chosen) if i == 0 or s[0] >= chosen[i - 1][1]]
    for a, z in chosen:
        out += (text[at:a], whole[a:z])
        at = z
    return Trip("".join(out) + text[at:], chosen, changed)


def trips(text: str, before: float) -> list[tuple[str, float, int]]:
    """(text, cost, rank) of the round trips that lower the cost far enough.

    A trip is left out if another changes at least the same characters and leaves no higher cost. Only UTF-8 is so
    strict that bytes hardly ever fit it by chance: its trips give way to their like alone, and another reading that shares ``CERTAIN``
    characters and most of its own with one of them isn't followed before that layer is undone.
    """
    made: list[tuple[float, int, bool, np.ndarray, str]] = []
    for rank, enc in enumerate((*LEGACY, *OTHER)):
        utf8 = isinstance(enc, str)
        t = _utf8_trip(text, enc) if utf8 else _single_trip(text, enc) if enc in _REREAD else _double_trip(text, enc)
        if t.changed >= (1 if utf8 else 4) and before - (after := cost(t.text) + t.penalty) >= LEAST_DROP:
            mask = np.zeros(len(text), bool)
            for a, z in t.spans:
                mask[a:z] = True
            made.append((after, rank, utf8, mask, t.text))
    out: list[tuple[str, float, int]] = []
    for after, rank, utf8, mask, new in made:
        for after2, rank2, utf8_2, mask2, _ in made:
            if utf8_2 and not utf8 and (mask & mask2).sum() >= max(CERTAIN, 0.8 * mask.sum()):
                break
            if (utf8_2 or not utf8) and (after2, rank2) < (after, rank) and (mask <= mask2).all():
                break
        else:
            out.append((new, after, rank))
    return out


def repair(text: str | None) -> tuple[bool, str | None]:
    """(affected, restored text). Lost characters stay as replacement characters; null if the text is sound."""
    if not text or text.isascii():
        return False, None
    # The cheapest text found is tried first; the search ends at one that no trip lowers and that costs no more than
    # sound text does, else with all texts that the trips reach. The least cost wins, among equals the fewest layers,
    # then the likelier encodings. Each trip lowers the cost by a least amount, so this ends.
    start = (cost(text), 0, (), text)
    best, known, queue = start, {text}, [start]
    while queue:
        before, depth, path, now = heapq.heappop(queue)
        further = trips(now, before) if before >= LEAST_DROP else []
        if not further and before <= SOUND * len(_HIGH.findall(now)):
            break
        for new, after, rank in further:
            item = (after, depth + 1, (*path, rank), new)
            best = min(best, item)
            if new not in known:
                known.add(new)
                heapq.heappush(queue, item)
    if best[1] == 0:
        return LOST in text, text if LOST in text else None
    return True, best[3]


# --- Suspects ----------------------------------------------------------------------------------------------------

_TAIL, _TWO, _THREE, _FOUR = 1, 2, 3, 4


def _byte_kinds() -> np.ndarray:
    """[encoding, character]: which part of a UTF-8 sequence the character's byte can be."""
    out = np.zeros((len(LEGACY), 0x10001), np.uint8)
    for i, e in enumerate(LEGACY):
        for c, b in _TABLES[e].items():
            out[i, ord(c)] = _TAIL if b < 0xC0 else 0 if b < 0xC2 else _TWO if b < 0xE0 else _THREE if b < 0xF0 else _FOUR if b < 0xF5 else 0
    return out


_KINDS = _byte_kinds()
_LEGACY_CHARS = _KINDS.any(axis=0)
for _w in {w for _, w in OTHER}:
    for _c in _TABLES[_w]:
        _LEGACY_CHARS[ord(_c)] = True


def suspects(texts: Sequence[str | None]) -> np.ndarray:
    """Mask of the texts that a trip might change or that hold lost characters.

    An accepted stretch drops by ``UTF8_DROP`` or ``OTHER_DROP`` for each of its characters and no cost is
    negative, so one of its sequences or words costs as much, contacts included.
    """
    out = np.zeros(len(texts), bool)
    joined = "\n".join(t or "" for t in texts)
    codes = np.minimum(_codes(joined), 0x10000)
    ends = np.cumsum([len(t or "") + 1 for t in texts])
    out[np.searchsorted(ends, np.flatnonzero(codes == 0xFFFD), side="right")] = True
    hi = np.flatnonzero(_LEGACY_CHARS[codes])
    if not len(hi):
        return out
    sums = _costs(codes)
    of = np.searchsorted(ends, hi, side="right")
    # Words of legacy characters.
    breaks = np.flatnonzero(np.diff(hi) > 1) + 1
    first, last = hi[np.concatenate(([0], breaks))], hi[np.concatenate((breaks - 1, [len(hi) - 1]))] + 1
    dear = sums[last + 1] - sums[first] >= OTHER_DROP * (last - first) - 1e-9
    out[np.searchsorted(ends, first[dear], side="right")] = True
    # UTF-8 sequences.
    left = ~out[of]
    hi, of = hi[left], of[left]
    if len(hi) < 2:
        return out
    steps = [np.zeros(len(hi), bool) for _ in range(3)]
    for k in range(3):
        steps[k][: len(hi) - k - 1] = hi[k + 1 :] - hi[: len(hi) - k - 1] == k + 1
    rise = [sums[np.minimum(hi + n + 1, len(sums) - 1)] - sums[hi] >= UTF8_DROP * n - 1e-9 for n in (2, 3, 4)]
    open_ = [steps[n - 2] & rise[n - 2] for n in (2, 3, 4)]
    if not any(o.any() for o in open_):
        return out
    chars = codes[hi]
    for kinds_ in _KINDS:
        kind = kinds_[chars]
        for n, lead in ((2, _TWO), (3, _THREE), (4, _FOUR)):
            at = np.flatnonzero(open_[n - 2] & (kind == lead))
            for k in range(1, n):
                at = at[kind[at + k] == _TAIL]
            out[of[at]] = True
    return out


def restore(df: DataFrame, column: str, keep: Sequence[str], restored: str = "restored", md5: str | None = None) -> DataFrame:
    """One row per affected text: ``keep`` and the restored text (lost characters stay as U+FFFD), or
    with ``md5`` the MD5 of its UTF-8 bytes ('' if characters are lost). Narrow: no shuffle."""
    out = md5 or restored
    names = names_apart(keep, [out])
    types = kinds(df, keep)
    schema = T.StructType([T.StructField(names[k], types[k]) for k in keep] + [T.StructField(out, T.StringType())])
    source = inputs(df, keep, [column]).filter("t0 rlike '[^\\\\x00-\\\\x7F]'")
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, width, 2_000_000):
                texts = batch.column(width).to_pylist()
                rows, values = [], []
                for r in np.flatnonzero(suspects(texts)).tolist():
                    affected, new = repair(texts[r])
                    if affected:
                        rows.append(r)
                        values.append(("" if LOST in new else hashlib.md5(new.encode("utf-8", "surrogatepass")).hexdigest()) if md5 else new)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(width)], pa.array(values, pa.string())], names=schema.fieldNames())

    return source.mapInArrow(run, schema)

"""Sentence boundaries across languages and scripts.

Candidate boundaries are end marks of all scripts and, in Thai, blanks. What is
certain from structure is settled there: a blank line ends a sentence, a mark
inside a quotation or inside a bracket doesn't, unless it closes with it. Every
other candidate goes to a maximum-entropy classifier over features of its
surroundings: neighbouring tokens, letter case, lengths, digits, script, mark,
blank and closing marks, and what the whole corpus says of the two tokens.

There is no list of abbreviations, months or units. One pass over all texts
counts for each token how often it stands without a mark, before a mark that a
small letter, a number or a capital follows, and last in a paragraph; and for
each token how often it opens a paragraph, follows a mark, follows a numbered
mark, or stands within a sentence with and without a capital. The counts lie in
``PLACES`` hashed places, whatever the corpus, so they can be broadcast. A token
that would often have ended a paragraph, were it an ordinary word, but never
did is known as an abbreviation.

The classifier is trained on reliable candidates only: those that layout
settles (a small letter or a comma goes on, a paragraph ends, a strong mark
before a capital) and those where the counts are beyond doubt. All others, the
greater part of full stops before capitals among them, are left to it. The
labelled rows come from a bounded sample of the texts (``sample_texts`` texts,
``sample_features`` distinct feature rows) and a few built-in lines, so that any
table, even an empty one, gets a model.

Defined results: null and blank texts have no sentences; a text of any length
is read whole; line breaks inside a sentence don't end it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.tables import inputs, kinds, names_apart

SLOTS = 1 << 15

PLACES = 1 << 18
KINDS = 5
# What is counted of a token before a full stop, and of the token that follows.
PLAIN, LOW, NUM, CAP, END = range(KINDS)
START, AFTER_MARK, AFTER_NUMBER, MID_LOW, MID_CAP = range(KINDS)

#: Built-in lines: sentences parted by " | ", one language and style a line; their boundaries are given.
_SEED = (
    "Leaves are ovate. | Flowers white, cf. Genus species. | It was seen by A. B. Smith at St. Anne, No. 12, in Sept. 1950. | Is it rare? | Yes! | Fruits 3 cm long, ca. 5 mm wide. | It bears cones etc. | Seeds are small.",
    "Bark thin, c. 2 mm. | (Seen in fl. Mar. at Town.) | Stamens 5. | Twigs grey with age... | The label says “Bark red”. | Roots 3 cm in diam. | Found in fr. Oct. 1920 near Hilltown. | Petals 4 m long.",
    "Les feuilles sont ovales. | Fleurs blanches, p. ex. Genus species, c.-à-d. rares. | Récolté par A. Petit, n° 12, en janv. 1950. | Est-il rare ? | Fruits de 3 cm de diam. | Graines petites. | L'écorce est « mince ». | Étamines 5.",
    "Die Blätter sind eiförmig. | Blüten weiß, vgl. Genus species. | Gesammelt von A. Klein am 3. Okt. 1950 bei Bern. | Ist sie selten? | Früchte 3 cm im Durchm. | Samen klein. | Auf 300 m, z. B. Genus.",
    "叶片卵形。 | 花白色！ | 是否同属？ | 标签写道：“花白。叶大。”，无日期。 | 果实小。",
    "葉は卵形。 | 花は白い． | 同じか？ | 札には「花は白い。葉は大きい。」とある。 | 種子は小さい。",
    "पत्तियाँ अंडाकार हैं। | फूल सफेद हैं ॥ | क्या यह डॉ. क. की जाति है? | बीज छोटे हैं। | यह डॉ. प. राव की है।",
    "ใบรูปไข่ | ผลเกลี้ยง | ยาว 3 ซม. | เมล็ดเล็ก",
)
SEED_WEIGHT = 25

_LINE_END = "(?:\\r\\n|\\r(?!\\n)|(?<!\\r)\\n)"
_BLANK_LINE = re.compile(f"[ \\t\u00a0]*{_LINE_END}[ \\t\u00a0]*{_LINE_END}\\s*|\u2029")
_MARK = re.compile(r"[.!?…。．！？｡।॥؟۔]+")
_THAI_BLANK = re.compile(r"(?<=[฀-๿.)\d])[ \t \r\n]+(?=[฀-๿\dA-Z(])")
_SOLID = re.compile(r"\S")
_CLOSERS = {"”", '"', "’", "'", "“", "»", "」", "』", ")", "）", "]", "】"}
_QUOTES = {"“": "”", "„": "“”", "«": "»", "‘": "’", '"': '"', "「": "」", "『": "』", "'": "'"}
_BRACKETS = {"(": ")", "（": "）", "[": "]", "【": "】"}
_OPENS = re.compile("[“„«‘\"「『'(（\\[【]")


@dataclass
class Candidate:
    """A possible boundary: the sentence would end before ``end``, the next begin at ``begin``."""

    end: int
    begin: int
    seen: tuple  # all that its features and its label are made from


def _spans(t: str) -> list[tuple[int, int, str]]:
    """(start, end, opener) of quotations and brackets, outermost first; unpaired marks are text."""
    out: list[tuple[int, int, str]] = []
    i, n = 0, len(t)
    while (m := _OPENS.search(t, i)) is not None:
        at, ch = m.start(), m[0]
        i = at + 1
        before, after = t[at - 1 : at], t[at + 1 : at + 2]
        if ch == '"' and before.isdigit():
            continue
        if ch in "'‘" and (before.isalnum() or not after.isalpha() or ch == "'" and before not in ("", " ", " ", "(", "\n")):
            continue
        if ch in _QUOTES:
            j = at + 1
            while j < n:
                if t[j] in _QUOTES[ch] and not (t[j] in "’'" and t[j + 1 : j + 2].isalpha()):
                    break
                j += 1
            if j < n:
                out.append((at, j + 1, ch))
                i = j + 1
        else:
            depth, j = 0, at
            while j < n:
                depth += (t[j] == ch) - (t[j] == _BRACKETS[ch])
                if depth == 0:
                    break
                j += 1
            if j < n:
                out.append((at, j + 1, ch))
                i = j + 1
    return out


def _class(tok: str) -> str:
    if not tok:
        return "none"
    c = tok[0]
    if c.isdigit():
        return "num"
    if c.isalpha():
        o = ord(c)
        if c.islower():
            return "low"
        if c.isupper():
            return "init" if len(tok) == 1 else "caps" if tok.isupper() and len(tok) > 2 else "cap"
        return "han" if 0x4E00 <= o <= 0x9FFF else "kana" if 0x3040 <= o <= 0x30FF else "deva" if 0x900 <= o <= 0x97F else "thai" if 0xE00 <= o <= 0xE7F else "other"
    return "p" + c


_NUMBER = re.compile(r"\d+(?:[.,·]\d+)*")


def _digits(s: str) -> str:
    return s if s.isalpha() else _NUMBER.sub("9", s)


_NEXT = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|\S")
_PARTED = re.compile("[(（\\[“„«‘「，、；;：:]")


def _context(t: str, at: int) -> tuple[str, str]:
    """The token that ends at ``at`` and the one before it."""
    if at == 0 or t[at - 1].isspace():
        return "", ""
    tok = t[max(0, at - 24) : at].rsplit(None, 1)[-1]
    if not tok.isalnum():
        tok = _PARTED.split(tok)[-1]
    if not tok:
        return "", ""
    begin = at - len(tok)
    rest = t[max(0, begin - 20) : begin].split()
    if ord(tok[-1]) >= 0x2E80:
        tok = tok[-2:]
    return tok, (rest[-1][-12:] if rest else "")


class Evidence:
    """What the corpus says of tokens: counts in hashed places."""

    def __init__(self, counts: np.ndarray | None = None) -> None:
        self.counts = np.zeros((PLACES, KINDS), np.float32) if counts is None else counts
        self._known: dict[str, str] = {}
        # The share of paragraph ends among full stops that no small letter follows: what an ordinary word shows.
        total = self.counts[:2].sum(axis=0)
        self.ends = float(total[END] / max(total[END] + total[CAP], 1.0)) if total.sum() else 0.25

    def _bucket(self, key: str) -> str:
        got = self._known.get(key)
        if got is None:
            got = self._judge(key)
            if len(self._known) < 200_000:
                self._known[key] = got
        return got

    def _judge(self, key: str) -> str:
        c = self.counts[2 + zlib.crc32(key.encode()) % (PLACES - 2)]
        if key[0] == "P":
            dotted, open_ = c[LOW] + c[NUM] + c[CAP] + c[END], c[NUM] + c[CAP] + c[END]
            expected = open_ * self.ends  # paragraph ends, were it an ordinary word
            ends = "few" if expected < 2 else "never" if c[END] <= 0.05 * expected else "rare" if c[END] < 0.3 * expected else "usual"
            low = 0 if c[LOW] <= 0.01 * dotted else 1 if c[LOW] < 0.2 * dotted else 2
            plain = 0 if c[PLAIN] <= 0.02 * dotted else 1 if c[PLAIN] < dotted else 2
            sure = "!" if expected >= 5 else ""
            return f"{ends}{sure}{low}{plain if ends == 'few' else ''}"
        if key[0] == "T":
            return "few" if c[:2].sum() < 3 else "unit" if c[0] > 20 * c[1] else "mixed" if c[0] > c[1] else "word"
        total = c.sum()
        if total < 2:
            return "few"
        numbered = "#" if c[AFTER_NUMBER] > 0.6 * total and c[AFTER_NUMBER] >= 3 and c[START] <= 0.02 * total else ""
        return ("start" if c[START] > 0.02 * total else "small" if c[MID_LOW] > c[MID_CAP] else "after" if c[AFTER_MARK] > c[MID_CAP] else "name") + numbered

    def before(self, token: str) -> str:
        """How the token behaves before a full stop."""
        return self._bucket("P" + token)

    def after(self, token: str) -> str:
        """How the token behaves as the first of a sentence."""
        return self._bucket("N" + token)

    def thai(self, token: str) -> str:
        """How the token behaves behind a number."""
        return self._bucket("T" + token)


_THAI_RUN = re.compile("[฀-๿]+")
_WORD_MARK = re.compile(r"(.*?)([.!?…。．！？।॥]*)([)\]”’»\"']*)\Z", re.S)
_OPENING = "(（[“„«‘\"'「"


def _token(t: str) -> str:
    """The form in which a token is counted; single letters keep their case."""
    return t if len(t) == 1 else _digits(t.lower())


def count_tokens(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of the tokens of some texts; places 0 and 1 hold the counts of all."""
    pairs: Counter[tuple[str, str]] = Counter()
    first: Counter[str] = Counter()
    last: Counter[str] = Counter()
    for text in texts:
        if not text:
            continue
        for part in _BLANK_LINE.split(text):
            toks = part.split()
            if toks:
                pairs.update(zip(toks, toks[1:], strict=False))
                first[toks[0]] += 1
                last[toks[-1]] += 1
    out: dict[int, list[int]] = {}

    def add(key: str, kind: int, n: int) -> None:
        for place in (2 + zlib.crc32(key.encode()) % (PLACES - 2), 0) if key[0] == "P" and kind != PLAIN else (2 + zlib.crc32(key.encode()) % (PLACES - 2),):
            row = out.get(place)
            if row is None:
                row = out[place] = [0] * KINDS
            row[kind] += n

    heads: dict[str, tuple[str, str]] = {}
    tails: dict[str, tuple[str, str, str]] = {}

    def head(b: str) -> tuple[str, str]:
        """(token, class) at the start of a blank-separated piece."""
        if b not in heads:
            m = _NEXT.match(b.lstrip(_OPENING) or b)
            heads[b] = (_token(m[0]), _class(m[0])) if m else ("", "none")
        return heads[b]

    def tail(a: str) -> tuple[str, str, str]:
        """(token, mark, closing marks) at its end."""
        if a not in tails:
            m = _WORD_MARK.match(a)
            tails[a] = (_token(_context(m[1], len(m[1]))[0]), m[2], m[3])
        return tails[a]

    for (a, b), n in pairs.items():
        (p, mark, closing), (w, kind) = tail(a), head(b)
        if p and len(p) <= 24:
            if mark == "." and not closing:
                add("P" + p, LOW if kind == "low" or b[0] in ",;:)–-=" else NUM if kind == "num" else CAP, n)
            elif not mark:
                add("P" + p, PLAIN, n)
        if w:
            add("N" + w, AFTER_NUMBER if mark == "." and p[-1:] == "9" else AFTER_MARK if mark else MID_LOW if kind == "low" else MID_CAP, n)
        if "฀" <= b[0] <= "๿":
            run = _THAI_RUN.match(b)[0]
            add("T" + run, 0 if a[-1].isdigit() or a[-1] in "½¼¾" else 1, n)
    for a, n in first.items():
        w = head(a)[0]
        if w:
            add("N" + w, START, n)
        if "฀" <= a[0] <= "๿":
            add("T" + _THAI_RUN.match(a)[0], 1, n)
    for a, n in last.items():
        p, mark, _ = tail(a)
        if mark == "." and p and len(p) <= 24:
            add("P" + p, END, n)
    places = np.fromiter(out, np.int32, len(out))
    return places, np.array([out[k] for k in out], np.int64).reshape(len(out), KINDS)


def evidence_of(texts: Sequence[str | None]) -> Evidence:
    """The evidence of a few texts."""
    places, counts = count_tokens(texts)
    e = np.zeros((PLACES, KINDS), np.float32)
    e[places] += counts
    return Evidence(e)


_PRODUCT = re.compile(r"[Xx×]\s*[\d½¼¾(]")
_SHORT_WORD = re.compile(r"\w['’\s\u00a0]+[a-zà-ÿ]")


def _candidate(t: str, mark_at: int, mark_end: int, end: int, begin: int, closer: str, own: bool, last: bool) -> Candidate:
    mark = t[mark_at:mark_end]
    kind = "..." if len(mark) > 1 and mark[0] in ".…" or mark == "…" else mark[-1] if mark else "blank"
    prev, prev2 = _context(t, mark_at)
    m = None if last else _NEXT.match(t, begin)
    nxt = m[0] if m else ""
    gap = t[end:begin]
    ws = "end" if last else "no" if not gap else "nl" if "\n" in gap or "\r" in gap else "2" if len(gap) > 1 else "1"
    nc, n = "end" if last else _class(nxt), _token(nxt)
    if nxt in ("X", "x", "×") and _PRODUCT.match(t, begin):
        nc = "times"  # a product goes on
    elif nc == "init" and _SHORT_WORD.match(t, begin):
        nc = "cap"  # a word of one letter, or an elided one
    elif nxt and nxt in _OPENING and t[begin + 1 : begin + 2]:
        nc = "o" + _class(t[begin + 1])  # an opening mark, and what it opens
        opened = _NEXT.match(t, begin + 1)
        n = _token(opened[0]) if opened else n
    run = ""
    if nxt and ord(nxt[0]) >= 0x0E00:
        if "฀" <= nxt[0] <= "๿":
            run = _THAI_RUN.match(t, begin)[0]
        elif ord(nxt[0]) >= 0x2E80:
            n = nxt[:2]
    number = bool(run) and not mark and mark_at > 0 and (t[mark_at - 1].isdigit() or t[mark_at - 1] in "½¼¾")
    return Candidate(end, begin, (mark[-1:], kind, prev, _digits(prev2.lower()), nxt[:1], n, nc, ws, closer, own, last, run, number))


def described(seen: tuple, ev: Evidence) -> tuple[list[str], int]:
    """The features of a candidate, and its label: 1 and 0 if it is reliable, else -1."""
    mark, kind, prev, prev2, first, n, nc, ws, closer, own, last, run, number = seen
    p, pc = _token(prev), _class(prev)
    a, sure = ev.before(p) if p and mark == "." else "none", False
    if "!" in a:
        a, sure = a.replace("!", ""), True
    if run and not mark:
        b = f"{number}{ev.thai(run)}" if number else "False"
    else:
        b = ev.after(n) if n and nc not in ("low", "num") else "none"
    initial = len(prev) == 1 and prev.isupper()
    dotted = "." in prev
    size = min(len(prev), 6)
    f = [
        "b", f"m{kind}", f"w{ws}", f"p{p}", f"n{n[:10]}", f"q{prev2}", f"pc{pc}", f"nc{nc}", f"l{size}|{nc}|{dotted}", f"m{kind}|{nc}", f"m{kind}|{ws}|{nc}",
        f"p{p}|{nc}", f"c{closer}|{nc}", f"c{closer}|{n[:2] if nc in ('kana', 'han') or nc[0] == 'p' else ''}", f"o{own}|{nc}", f"i{initial}|{nc}",
        f"a{a}", f"a{a}|{nc}", f"a{a}|{b}|{nc}", f"s{b}", f"s{b}|{pc}", f"a{a[:4]}|{pc}|{size}|{nc}",
    ]
    # Reliable candidates. Layout first: what follows can't open a sentence, or nothing follows.
    label = -1
    if nc in ("low", "times") or nc[0] == "p" and first and first in ",;:，；：、)-–=":
        label = 0
    elif closer in ("」", "”") and (nc == "kana" or first and first in "，、と"):
        label = 0
    elif last or mark and mark in "!?。．！？｡।॥؟۔":
        label = 1
    elif not mark:
        label = (0 if b == "Trueunit" else 1 if b == "Trueword" else -1) if number else 1
    elif sure and a.startswith("never") or initial and nc in ("init", "cap"):
        label = 0  # often before a full stop, never last in a paragraph
    elif b.endswith("#") and pc == "num":
        label = 0  # numbered things: what follows stands behind numbered full stops
    elif sure and a.startswith("usual0") and b == "start" and ws != "no":
        label = 1  # an ordinary word before one that opens paragraphs
    return f, label


def _paragraph(t: str, lo: int, hi: int) -> list[Candidate]:
    """Candidates inside [lo, hi) of ``t``; the paragraph's own end is not among the boundaries to decide but is given for training."""
    part = t[lo:hi]
    spans = _spans(part)
    out: list[Candidate] = []
    s = 0
    thai = not part.isascii() and _THAI_RUN.search(part) is not None
    for m in _MARK.finditer(part):
        at, end = m.start(), m.end()
        after = part[end : end + 1]
        if m[0] == "." and (after.islower() or after.isdigit() or after in ("-", "–", "·", "_", "/", "@")):
            continue
        while s < len(spans) and spans[s][1] <= at:
            s += 1
        closer, own = "", False
        if s < len(spans) and spans[s][0] < at:
            a, z, ch = spans[s]
            inner = part[end : z - 1]
            if inner.strip("   ") and not all(c in _CLOSERS for c in inner.strip()):
                continue  # inside a quotation or bracket
            closer, end = part[z - 1], z
            own = ch in _BRACKETS and (not part[:a].strip() or part[:a].rstrip()[-1:] in ".!?…。！？।॥)”’»\"")
        while end < len(part) and part[end] in _CLOSERS and part[end] not in "“'\"’":
            closer, end = part[end], end + 1
        if end < len(part) and part[end] in ".!?…。．！？":
            continue
        nxt = _SOLID.search(part, end)
        begin = nxt.start() if nxt else len(part)
        last = nxt is None
        if not last and begin == end and m[0][-1] in ".…" and not closer:
            n2 = part[end : end + 2]
            if n2[1:] == "." and n2[0].isalpha():
                continue  # inside an acronym
            if not (n2[:1].isupper() or ord(n2[0]) >= 0x2E80 or n2[0] in "(“«‘\"„"):
                continue
        if thai and not last and "฀" <= part[at - 1 : at] <= "๿" and m[0] == ".":
            continue  # an abbreviation; in Thai the blank decides
        out.append(_candidate(part, at, m.end(), end, begin, closer, own, last))
    if thai:
        for m in _THAI_BLANK.finditer(part):
            before, nxt = part[: m.start()].rstrip(), part[m.end() : m.end() + 12]
            if not ("฀" <= nxt[0] <= "๿" or re.search(r"[฀-๿]\.?\Z", before[-3:])):
                continue
            if any(a < m.start() < z for a, z, _ in spans):
                continue
            if nxt[0].isdigit() or nxt[0] in "(" and nxt[1:2].isdigit():
                continue
            out.append(_candidate(part, m.start(), m.start(), m.start(), m.end(), "", False, False))
        out.sort(key=lambda c: c.end)
    for c in out:
        c.end += lo
        c.begin += lo
    return out


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    lo = 0
    for m in _BLANK_LINE.finditer(text):
        yield lo, m.start()
        lo = m.end()
    yield lo, len(text)


class Model:
    """Weights of the hashed features, and the evidence they are taken from."""

    def __init__(self, weights: np.ndarray, evidence: Evidence | None = None) -> None:
        self.weights = weights
        self.evidence = evidence or Evidence()
        self._known: dict[str, float] = {}
        self._seen: dict[tuple, bool] = {}

    def ends(self, candidate: Candidate) -> bool:
        """Whether the candidate is a boundary; what was seen before is looked up."""
        got = self._seen.get(candidate.seen)
        if got is None:
            got = self.score(described(candidate.seen, self.evidence)[0]) > 0
            if len(self._seen) < 200_000:
                self._seen[candidate.seen] = got
        return got

    def score(self, features: Sequence[str]) -> float:
        known, w = self._known, self.weights
        total = 0.0
        for f in features:
            x = known.get(f)
            if x is None:
                x = float(w[zlib.crc32(f.encode()) % SLOTS])
                if len(known) < 200_000:
                    known[f] = x
            total += x
        return total

    def split(self, text: str | None) -> list[tuple[int, int]]:
        """[start, end) of each sentence, in characters."""
        out: list[tuple[int, int]] = []
        if not text or not text.strip():
            return out
        for lo, hi in paragraphs(text):
            start = lo
            for c in _paragraph(text, lo, hi):
                if c.end > start and (c.begin >= hi or self.ends(c)):
                    _push(text, start, c.end, out)
                    start = c.end
            _push(text, start, hi, out)
        return out


def _push(t: str, a: int, z: int, out: list[tuple[int, int]]) -> None:
    while a < z and t[a].isspace():
        a += 1
    while z > a and t[z - 1].isspace():
        z -= 1
    if z > a:
        out.append((a, z))


def reliable(text: str | None, ev: Evidence) -> Iterator[tuple[str, int]]:
    """(features, label) of the reliable candidates of a text."""
    if text:
        for lo, hi in paragraphs(text):
            for c in _paragraph(text, lo, hi):
                f, label = described(c.seen, ev)
                if label >= 0:
                    yield "\x01".join(f), label


def fit(rows: list[tuple[str, int, int]], evidence: Evidence | None = None, rounds: int = 120, decay: float = 2e-5) -> Model:
    """Maximum entropy (logistic) weights for (features, label, count) rows, by accelerated gradient ascent."""
    if not rows:
        return Model(np.zeros(SLOTS), evidence)
    feats = [[zlib.crc32(f.encode()) % SLOTS for f in r[0].split("\x01")] for r in rows]
    idx = np.array([i for f in feats for i in f], np.int64)
    at = np.repeat(np.arange(len(rows)), [len(f) for f in feats])
    y = np.array([r[1] for r in rows], float)
    c = np.sqrt(np.array([r[2] for r in rows], float))
    c /= c.sum()
    w = np.zeros(SLOTS)
    v = np.zeros(SLOTS)
    g2 = np.full(SLOTS, 1e-12)
    for _ in range(rounds):
        z = np.bincount(at, weights=w[idx], minlength=len(rows))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.bincount(idx, weights=((y - p) * c)[at], minlength=SLOTS) - decay * w
        g2 = 0.9 * g2 + 0.1 * g * g
        v = 0.9 * v + 0.1 * g / np.sqrt(g2 + 1e-12)
        w += 0.15 * v * (np.abs(g) > 0)
    return Model(w, evidence)


def seed_rows() -> list[tuple[str, int, int]]:
    count: dict[tuple[str, int], int] = {}
    lines = [line.split(" | ") for line in _SEED]
    ev = evidence_of([" ".join(parts) for parts in lines])
    for parts in lines:
        for gap in (" ", "  "):
            text = gap.join(parts)
            ends, at = set(), 0
            for part in parts:
                ends.add(at + len(part))
                at += len(part) + len(gap)
            for c in _paragraph(text, 0, len(text)):
                row = "\x01".join(described(c.seen, ev)[0]), int(c.end in ends)
                count[row] = count.get(row, 0) + SEED_WEIGHT
    return [(f, y, n) for (f, y), n in sorted(count.items())]


def train_on(texts: Sequence[str | None]) -> Model:
    """The model for some texts in memory."""
    ev = evidence_of(texts)
    count = Counter(row for t in texts for row in reliable(t, ev))
    return fit([(f, y, n) for (f, y), n in sorted(count.items())] + seed_rows(), ev)


def evidence(df: DataFrame, columns: Sequence[str]) -> Evidence:
    """The counts of all texts: at most ``PLACES`` rows come back, whatever the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, counts = count_tokens([t for c in range(batch.num_columns) for t in batch.column(c).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(places), *[pa.array(counts[:, i]) for i in range(KINDS)]], names=["place", *[f"n{i}" for i in range(KINDS)]])

    schema = "place int, " + ", ".join(f"n{i} bigint" for i in range(KINDS))
    got = inputs(df, [], columns).mapInArrow(run, schema).groupBy("place").agg(*[F.sum(f"n{i}").cast("float").alias(f"n{i}") for i in range(KINDS)]).toArrow()
    out = np.zeros((PLACES, KINDS), np.float32)
    if got.num_rows:
        out[got.column(0).to_numpy()] = np.stack([got.column(i + 1).to_numpy() for i in range(KINDS)], axis=1)
    return Evidence(out)


def train(df: DataFrame, columns: Sequence[str], key: str, sample_texts: int = 4000, sample_features: int = 60_000) -> Model:
    """The model for the texts of ``df``: evidence of all texts, weights from a bounded sample of rows chosen by the hash of ``key``."""
    ev = evidence(df, columns)
    total = df.count()
    rate = min(1.0, 1.1 * sample_texts / max(total, 1))
    part = (F.xxhash64("k0").cast("double") / F.lit(2.0**63) + 1) / 2
    texts = inputs(df, [key], columns).withColumn("h", part).filter(F.col("h") < rate)
    texts = texts.orderBy("h").limit(sample_texts).drop("h", "k0")
    sent = df.sparkSession.sparkContext.broadcast(ev.counts)  # PLACES rows, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Evidence(sent.value)
        for batch in batches:
            f, y = [], []
            for c in range(batch.num_columns):
                for text in batch.column(c).to_pylist():
                    for a, b in reliable(text, own):
                        f.append(a)
                        y.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(y, pa.int32())], names=["f", "y"])

    counted = texts.mapInArrow(run, "f string, y int").groupBy("f", "y").count().orderBy(F.desc("count"), "f", "y").limit(sample_features)
    got = counted.toArrow()
    rows = list(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), got.column(2).to_pylist(), strict=True))
    return fit(rows + seed_rows(), ev)


def sentences(df: DataFrame, columns: Sequence[str], keep: Sequence[str], model: Model, text: str | None = None) -> DataFrame:
    """One row per sentence of each column: ``keep``, then ``field, sent_no, sent_start,
    sent_end`` (and the sentence itself as ``text``, if a name is given). Narrow: no shuffle."""
    produced = ["field", "sent_no", "sent_start", "sent_end", *([text] if text else [])]
    names = names_apart(keep, produced)
    types = kinds(df, keep)
    schema = T.StructType(
        [T.StructField(names[k], types[k]) for k in keep]
        + [T.StructField("field", T.StringType())]
        + [T.StructField(n, T.IntegerType()) for n in produced[1:4]]
        + ([T.StructField(text, T.StringType())] if text else [])
    )
    source = inputs(df, keep, columns)
    width, fields = len(keep), tuple(columns)
    # SLOTS weights and PLACES rows of counts, whatever the input
    sent = df.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.evidence.counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(sent.value[0], Evidence(sent.value[1]))
        for batch in batches:
            rows, what, no, starts, ends, said = [], [], [], [], [], []
            for c, name in enumerate(fields):
                for r, t in enumerate(batch.column(width + c).to_pylist()):
                    for k, (a, z) in enumerate(own.split(t)):
                        rows.append(r)
                        what.append(name)
                        no.append(k)
                        starts.append(a)
                        ends.append(z)
                        if text:
                            said.append(t[a:z])
            take = pa.array(rows, pa.int64())
            cols = [batch.column(i).take(take) for i in range(width)]
            cols += [pa.array(what, pa.string()), pa.array(no, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
            if text:
                cols.append(pa.array(said, pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def probability(model: Model, features: Sequence[str]) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.score(features)))))

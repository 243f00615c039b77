from __future__ import annotations

import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from sylva.llm import leaks


def brute(doc, item, span):
    def words(t):
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold()
        out, run = [], ""
        for c in t + " ":
            if c.isalnum():
                run += c
            elif run:
                out.append(run)
                run = ""
        return out

    d, i = words(doc), words(item)
    grams = {tuple(i[k : k + span]) for k in range(len(i) - span + 1)}
    return any(tuple(d[k : k + span]) in grams for k in range(len(d) - span + 1))


word = st.sampled_from("a b c d é É x1 ß SS".split())
text = st.lists(word, max_size=30).map(" ".join)


@settings(max_examples=400, deadline=None)
@given(text, text, st.integers(0, 25))
def test_equal_windows_share_their_signature(doc, item, at):
    """No passage is lost: where texts share a run of words, some window of both has one signature."""
    doc = doc[:at] + " " + item[at // 2 : at + 14] + " " + doc[at:]
    d, i = (leaks.words(t) for t in (doc, item))
    sig = lambda w: set(leaks._one(leaks.signatures(leaks.word_hashes(w), 6, 3, 3)).tolist()) if len(w) >= 6 else set()
    assert bool(sig(d) & sig(i)) or not brute(doc, item, 6)


def test_size_classes():
    for span in (6, 12):
        for n in range(span, 40 * span):
            c = leaks.size_class(n, span)
            assert n <= leaks.upper_size(c, span) and (c == 0 or n > leaks.upper_size(c - 1, span))


def test_operator(spark):
    item = "Only 37 trials by Draovar showed how root caps collapse when the Éventails swell at night"
    part = " ".join(item.split()[2:14]).upper()
    long_item = " ".join(f"w{i}" for i in range(400))
    docs = [(1, f"x {part} y", "z"), (2, " ".join(item.split()[2:13]), None), (3, None, "q"), (4, "", "r"), (5, "w " * 200000 + item, "s"), (1, f"x {part} y", "z"), (6, item.replace("É", "É").replace(" ", ", "), "t")]
    docs += [(7, " ".join(f"w{i}" for i in range(100, 113)), "u"), (None, item, "v")]
    d = spark.createDataFrame(docs, "doc_id long, text string, ITEM_ID string")
    i = spark.createDataFrame([(10, item), (11, None), (12, "short one"), (13, item), (None, item), (14, long_item)], "item_id long, text string")
    want = sorted([(k, n) for k in (1, 5, 6, None) for n in (10, 13, None)] + [(7, 14)], key=repr)
    rows = leaks.find_leaks(d, i).collect()
    assert sorted(((r["doc_id"], r["item_id"]) for r in rows), key=repr) == want
    share = {(r["doc_id"], r["item_id"]): r["containment"] for r in rows}
    assert share[6, 10] == 1 and 0 < share[1, 10] < 1 and share[7, 14] < 0.02
    most = leaks.find_leaks(d, i, least=0.8).collect()
    assert {(r["doc_id"]) for r in most} == {5, 6, None}
    assert leaks.find_leaks(d.limit(0), i).count() == 0 and leaks.find_leaks(d, i.limit(0)).count() == 0


def test_recall_against_brute(spark):
    """Random passages of 12 to 40 words of random items, in long documents."""
    rnd = random.Random(4)
    vocabulary = [f"t{i}" for i in range(300)]
    items = [(k, " ".join(rnd.choices(vocabulary, k=rnd.randint(8, 120)))) for k in range(40)]
    docs = []
    for k in range(120):
        w = rnd.choices(vocabulary, k=rnd.randint(0, 400))
        own = items[rnd.randrange(40)][1].split()
        n = rnd.randint(8, 40)
        a = rnd.randint(0, max(0, len(own) - n))
        docs.append((k, " ".join(w[: len(w) // 2] + own[a : a + n] + w[len(w) // 2 :])))
    want = {(d, i) for d, t in docs for i, u in items if brute(t, u, 12)}
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert len(want) > 50 and {(r["doc_id"], r["item_id"]) for r in got.collect()} == want

"""Repeated substrings against brute force over all windows."""

import hashlib
import random
import re
from collections import Counter

import pytest

from graphloom.llm import repeats as R


def passages(text, words):
    """(number of the first word, bytes) of each string of so many words."""
    at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    return [(k, text[at[k][0] : at[k + words - 1][1]]) for k in range(len(at) - words + 1)]


def brute(docs, length, words):
    count, holders = Counter(), Counter()
    for _, t in docs:
        b = (t or "").encode()
        count.update(b[k : k + length] for k in range(len(b) - length + 1))
        holders.update({p for _, p in passages(b, words)})
    out = Counter()
    for doc_id, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        held = {j for k, p in passages(b, words) if holders[p] > 1 for j in range(k, k + words)}
        out[doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), sum(k - 1 not in held for k in held)] += 1
    return out


def check(spark, docs, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in R.remove_repeats(df, **how).collect()) == brute(docs, how.get("length", R.LENGTH), how.get("words", R.WORDS))


@pytest.mark.parametrize("seed", range(5))
def test_random_texts_with_shared_parts(spark, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(60)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    pool = [text(rng.randint(5, 60)) for _ in range(12)] + ["a" * 150, "ab" * 90]
    docs = [(k, "".join(rng.choice(pool) if rng.random() < 0.6 else text(rng.randint(1, 25)) for _ in range(rng.randint(0, 8)))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, docs[3][1]), (103, "x" * 700), (104, text(100)[:399]), (105, docs[3][1]), (105, docs[3][1])]
    check(spark, docs, length=rng.choice([60, 100, 400]), words=rng.choice([5, 12, 51]), gap=rng.choice([4, 16, 48]))


def test_whole_table(spark, docs):
    check(spark, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_passage_of_a_copied_document(spark):
    """A passage's windows are open where it stands alone and settled in the copies: both are found."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz      ", k=n))
    whole = text(6000)
    check(spark, [(1, whole), (2, whole), (3, text(700) + whole[2000:2450] + text(700)), (4, text(300) + whole[5000:5400] + text(50)), (5, text(300) + whole[100:499] + text(50))])


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


@pytest.mark.parametrize("gap", [16, 48, 10**6])
def test_strings_that_collide_under_polynomial_hashes(spark, gap):
    """A Thue-Morse word and its complement have one value under any odd base modulo a power of two."""
    rng = random.Random(4)
    head, word = "".join(rng.choices("cdefgh", k=64)), thue_morse(1024)
    check(spark, [(1, head + word), (2, head + word.translate(str.maketrans("ab", "ba"))), (3, word[:400]), (4, head)], gap=gap)


@pytest.mark.parametrize("most", [1, 2, 10**9])
def test_frequent_phrases_are_compared_alike(spark, most):
    """Windows behind very frequent phrases are compared by themselves: the results don't change."""
    rng = random.Random(2)
    text = lambda n: "".join(rng.choices("abcdefghijk      ", k=n))
    lines = [text(rng.randint(60, 300)) for _ in range(5)]
    check(spark, [(k, text(30).join(rng.choices(lines, k=6))) for k in range(30)], length=200, words=20, frequent=most)


def test_short_passages_are_counted_but_stay(spark):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(n))
    shared, fifty = text(51), " ".join(["ab"] * 50)
    docs = [(1, f"{text(90)} {shared} {text(90)}"), (2, f"{text(90)} {shared} {text(9)} {shared}"), (3, text(40) + " " + fifty), (4, text(60) + " " + fifty)]
    assert len(shared) < 400
    check(spark, docs)
    assert {r.doc_id: (r.n_passages, r.n_removed) for r in R.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {1: (1, 0), 2: (2, 0), 3: (0, 0), 4: (0, 0)}


def test_awkward_input(spark, awkward, nothing):
    rows = R.remove_repeats(awkward).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == awkward.count() and got[1].n_bytes == 0 and got[6].n_removed == got[6].n_bytes == 400_000 and got[10].n_removed == 10_000
    assert got[7].n_removed == 0  # shorter than a window
    assert R.remove_repeats(nothing).count() == 0
    assert R.remove_repeats(awkward, with_text=True).where("doc_id = 4").first().kept == b"one"


def test_texts_of_own_phrases_are_not_searched(monkeypatch):
    """Where no phrase occurs twice, only windows without a whole phrase are candidates; texts without such ones are left at once."""
    import random

    import numpy as np

    from graphloom.llm.repeats import Parse

    rng, left = random.Random(3), 0
    own = Parse.leading
    for k in range(300):
        text = b" ".join(bytes(rng.choices(b"abcdefgh", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 60)))
        if k % 3 == 0:
            text += b"x" * rng.randint(50, 90) + text[:40]
        p = Parse(text, 150, 28, 6)
        none = np.zeros(len(p.keys), bool)
        p.told(~none, none)
        monkeypatch.setattr(Parse, "leading", lambda *a: asked.append(1) or own(*a))
        asked = []
        quick = p.windows(), [list(map(tuple, x)) if k > 1 else x.tolist() for k, x in enumerate(p.passages())]
        left += not asked
        p.own = False
        whole = p.windows(), [list(map(tuple, x)) if k > 1 else x.tolist() for k, x in enumerate(p.passages())]
        assert quick == whole
    assert left > 50


def test_passages_ask_once_for_the_same_phrases(monkeypatch):
    """Strings of words are asked for by the phrases that they hold, not one by one; a piece by itself isn't looked at."""
    import numpy as np

    rng, asked, own = random.Random(5), [], R.Parse.leading
    monkeypatch.setattr(R.Parse, "leading", lambda p, a, b: asked.append(len(a)) or own(p, a, b))
    text = b" ".join(bytes(rng.choices(b"abcdefgh", k=rng.randint(1, 3))) for _ in range(4000))
    p = R.Parse(text, 150, 28, 40)
    none = np.zeros(len(p.keys), bool)
    p.told(none, none)
    start, end, single, pieces = p.passages()
    assert sum(asked) <= 2 * len(p.keys) + 1 < len(start) / 2
    lead = own(p, start, end)
    assert {i: int(k) for a, b, k in pieces for i in range(a, b + 1)} | {i: R.BARE for a, b in single for i in range(a, b + 1)} == dict(enumerate(lead.tolist()))
    assert not R._sorted_windows(R.PASSAGES, {text: [1, 3]}, 150, 28)[text].any() and R._sorted_windows(R.PASSAGES, {text: [2, R.SEVERAL]}, 150, 28)[text].all()

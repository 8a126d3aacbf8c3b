"""Packing: ids against the tokenizer library, bins against item-by-item best fit, an exact round trip."""

import random
import zlib
from collections import Counter

import numpy as np

from graphloom.llm import packing as P
from graphloom.llm.catalog import tokenizer_path


def test_plan_equals_item_by_item_best_fit():
    for seed in range(150):
        rng = random.Random(seed)
        cap = rng.choice([8, 16, 37, 100])
        items = [rng.randint(1, cap) for _ in range(rng.randint(0, 250))]
        bins = []
        for n in sorted(items, reverse=True):
            fits = [(r, k) for k, r in enumerate(bins) if r >= n]
            if fits:
                bins[min(fits)[1]] -= n
            else:
                bins.append(cap - n)
        runs, count = P.plan(Counter(items), cap)
        assert count == len(bins) and sum((Counter({r[0]: r[2]}) for r in runs), Counter()) == Counter(items)
        place = {}
        for n, first, k, b, each, offset in runs:
            for i in range(k):
                place.setdefault(b + i // each, []).append((offset + i % each * n, n))
        for spans in place.values():
            at = 0
            for o, n in sorted(spans):
                assert o == at
                at += n
            assert at <= cap
        assert sorted(cap - sum(n for _, n in s) for s in place.values()) == sorted(bins)


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    e, t = P.encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    assert e.fast is not None
    rng = random.Random(1)
    signs = [*"ab Z9\n\t\r  's.,;é€ß—… \x1c\x85 　日本😀\x00İǅªº²½", "<|endoftext|>", " the", "  ", "'ll", "​", " "]
    for _ in range(4000):
        x = "".join(rng.choices(signs, k=rng.randint(0, 30)))
        assert np.frombuffer(e(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def check(spark, docs, capacity=P.CAPACITY):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = P.pack(docs, tokenizer_path(), capacity).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        starts = P.cuts(len(ids), capacity)
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
            assert k == 0 or b - a == capacity
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert all(n <= capacity for n in at.values())
    assert len(at) <= 1.25 * max(1, sum(at.values()) / capacity) + 1
    return rows


def test_round_trip(spark, docs):
    check(spark, docs)
    check(spark, docs.repartition(7), 64)


def test_awkward_input(spark, awkward, nothing):
    rows = check(spark, awkward)
    assert [(r.length, r.piece) for r in rows if r.doc_id == 1] == [(1, 0)]
    assert P.pack(nothing, tokenizer_path()).count() == 0

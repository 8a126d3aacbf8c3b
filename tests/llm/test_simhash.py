"""SimHash: fingerprints and components against brute force."""

import random

import numpy as np
import xxhash

from graphloom.llm import common
from graphloom.llm import simhash as S


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, cur = [], ""
    for c in lower + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            words += [cur] if cur else []
            cur = ""
        else:
            cur += c
    if not words:
        return 0
    sh = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def components(fps):
    u = sorted({*fps})
    up = list(range(len(u)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    a = np.array(u, np.uint64)
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3):
            x, y = root(i), root(i + 1 + int(j))
            up[max(x, y)] = min(x, y)
    return {f: u[root(k)] for k, f in enumerate(u)}


def test_fingerprint():
    for t in (None, "", " \n", "A", "a B", "Ää ÄÄ x ÉA", "x\x0by\x0cz", "The cat. " * 50):
        assert S.fingerprint(None if t is None else t.encode()) == plain_fingerprint(t)


def test_golay_keys_cover_one_error():
    table, n = S.golay_tables()
    assert set(n) == {1, 6}
    rng = np.random.default_rng(0)
    w = rng.integers(0, 1 << 23, 2000)

    def keys(v):
        s = S._syndrome(np.array([v]))[0]
        return {(v ^ int(e)) >> 11 for e in table[s, : n[s]]}

    for v in w.tolist():
        a, b, c = (1 << int(x) for x in rng.choice(23, 3, replace=False))
        assert keys(v) & keys(v ^ a) and keys(v ^ a) & keys(v ^ b)


def test_components_equal_brute_force(spark, docs):
    got = S.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    text = {r.doc_id: r.text for r in docs.collect()}
    fps = {r.doc_id: plain_fingerprint(text[r.doc_id]) for r in got}
    root = components(fps.values())
    first = {}
    for d, f in fps.items():
        first[root[f]] = min(first.get(root[f], d), d)
    for r in got:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == first[root[fps[r.doc_id]]]


def test_links_of_close_fingerprints_and_large_groups(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = {*base}
    for b in base:
        for _ in range(60):
            x = b
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {base[0] ^ (k * 0x0101_0101) for k in range(600)}  # a crowded group
    old, S.DIRECT = S.DIRECT, 32
    try:
        forest = S._Forest()
        S.link_all(np.array(sorted(fps), np.uint64), forest)
        want = components(fps)
        assert all((forest.root(a) == forest.root(want[a])) for a in fps)
        assert len({forest.root(f) for f in fps}) == len({*want.values()})
    finally:
        S.DIRECT = old
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    labels = {r.node: r.root for r in common.connected_components(S.fingerprint_links(df)).collect()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for f in fps:
        assert labels.get(signed(f), signed(f)) == labels.get(signed(want[f]), signed(want[f]))
    assert len({labels.get(signed(f), signed(f)) for f in fps}) == len({*want.values()})


def test_connected_components(spark):
    edges = [(1, 2), (2, 3), (10, 9), (5, 5), (7, 6), (6, 8), (8, 7), *[(100, k) for k in range(101, 140)], *[(k, k + 1) for k in range(200, 240)]]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[3] == 1 and got[10] == 9 and got[8] == 6 and got[139] == 100 and got[240] == 200 and 5 not in got
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_input(spark, awkward, nothing):
    rows = S.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    got = {r.doc_id: r for r in rows}
    assert {got[k].component_id for k in (1, 2, 3)} == {1} and got[1].fingerprint == "0" * 16
    assert got[8].component_id == 7 and got[None].component_id is None
    assert S.near_duplicates(nothing).count() == 0
    kept = S.keep_one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 5, 6, 7, 9, 10]
    assert S.keep_one_of_each(nothing).count() == 0

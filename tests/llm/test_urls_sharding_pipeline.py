"""URL lists in time, the lookup table, the pipeline."""

import datetime
from collections import Counter

import pytest
from oracle import both
from pyspark.sql import functions as F

from graphloom.llm import catalog, sharding, urls

SF = "/root/testdata/sf0.001"


def test_url_query_matches_sql(spark):
    ours, theirs = both(spark, catalog.QUERIES["op6_url_filter"], catalog.ORACLES["op6_url_filter"])
    assert ours == theirs and any("True" in r for r in ours)


def test_entries_hold_from_their_date(spark):
    day = datetime.date.fromisoformat
    events = spark.createDataFrame([("Bad.com", "spam", day("2024-02-01"), "add"), ("bad.com", "spam", day("2024-03-01"), "remove"), ("a.bad.com", "adult", day("2024-02-15"), "add"), ("x.org", "spam", day("2024-01-01"), "add"), ("x.org", "spam", day("2024-01-01"), "remove"), (None, "spam", day("2024-01-01"), "add"), ("y.org", None, day("2024-01-01"), "add")], "pattern string, category string, day date, action string")
    at = [("http://user:p@A.Bad.com.:80/x?bad.com", "2024-01-31"), ("https://bad.com", "2024-02-01"), ("https://bad.com/", "2024-02-29"), ("https://bad.com", "2024-03-01"), ("http://a.bad.com", "2024-02-20"), ("http://b.a.bad.com", "2024-04-01"), ("http://notbad.com", "2024-02-10"), ("http://x.org", "2024-01-01"), (None, "2024-02-10"), ("nonsense", "2024-02-10"), ("http://bad.com", None), ("http://" + "a." * 200 + "bad.com", "2024-02-10"), ("https://bad.com", "2024-02-01")]
    captures = spark.createDataFrame([(k, u, d and day(d)) for k, (u, d) in enumerate(at)], "page_id long, url string, fetched date").withColumn("row", F.lit(1)).withColumn("pattern", F.lit("p"))
    got = {r.page_id: (r.blocked, r.pattern, r.category) for r in urls.evaluate(captures, events).collect()}
    no = (False, None, None)
    assert [got[k] for k in range(len(at))] == [no, (True, "bad.com", "spam"), (True, "bad.com", "spam"), no, (True, "a.bad.com", "adult"), (True, "a.bad.com", "adult"), no, no, no, no, no, no, (True, "bad.com", "spam")]
    assert urls.evaluate(captures, events.limit(0)).where("blocked").count() == 0 and urls.evaluate(captures.limit(0), events).count() == 0


def plain_fill(shards, size):
    import hashlib

    names = sorted({*shards})
    prefs = [[(int.from_bytes(d[:8], "big") % size + j * (int.from_bytes(d[8:], "big") % (size - 1) + 1)) % size for j in range(size)] for d in (hashlib.md5(n.encode()).digest() for n in names)]
    table = [None] * size
    while None in table:
        for k, p in enumerate(prefs):
            if None in table:
                table[next(s for s in p if table[s] is None)] = k
    return table


def test_table_equals_the_plain_turns_and_moves_little():
    for n, size in ((1, 7), (3, 7), (5, 101), (16, 211)):
        assert sharding.fill([f"s{k}" for k in range(n)], size) == plain_fill([f"s{k}" for k in range(n)], size)
    names = [f"s{k}" for k in range(64)]
    a = sharding.fill(names)
    share = Counter(a)
    assert max(share.values()) - min(share.values()) <= 1 and len(share) == 64
    b, left = sharding.fill(names[:-1]), sorted(names[:-1])
    moved = sum(sorted(names)[x] != left[y] for x, y in zip(a, b)) / sharding.SIZE
    assert moved < 3 / 64
    for bad in ([], 10), (["a"], 10), (["a", "b", "c"], 2):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_placement(spark, awkward, nothing):
    names = [f"shard-{k:03d}" for k in range(256)]
    table = sharding.fill(names)
    import hashlib

    for r in catalog.op8_sharding(spark, SF).collect():
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SIZE
        assert r.slot == slot and r.shard == names[table[slot]]
    placed = sharding.place(awkward, "doc_id", names[:4])
    assert placed.count() == awkward.count() and placed.where("shard is null").count() == 0 and placed.columns == [c for c in awkward.columns if c not in ("slot", "shard")] + ["slot", "shard"]
    assert placed.where("doc_id = 7").select("shard").distinct().count() == 1
    assert sharding.place(nothing, "doc_id", names[:4]).count() == 0


def one_of_each(texts):
    """The smallest doc_id of each group, from all pairs of texts."""
    from graphloom.llm import resemblance, simhash

    ids = sorted(texts)
    up = {d: d for d in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    raw = [texts[d].encode() for d in ids]
    fp, sets = [simhash.fingerprint(t) for t in raw], [frozenset(resemblance.shingles(t).tolist()) for t in raw]
    for i, x in enumerate(ids):
        for j in range(i):
            both = len(sets[i] & sets[j]) if sets[i] and sets[j] else 0
            alike = both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)
            if alike or (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = root(x), root(ids[j])
                up[max(a, b)] = min(a, b)
    return {root(d) for d in ids}


def test_pipeline_against_its_parts(spark, docs):
    """The kept documents are those that brute force over each stage's own input keeps; all their tokens are packed."""
    import corpus_pipeline as P

    from graphloom.llm import common, decontam, secrets

    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found, now = decontam.indexes(bench), docs
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id: r.text for r in now.collect()}
        out = common.materialize(stage(spark, now, SF), name)
        assert out.columns == docs.columns
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "language_id":
            assert len(after) >= 0.99 * len(before)
        elif name == "near_duplicates":
            assert {*after} == one_of_each(before)
        elif name == "decontamination":
            assert {*after} == {d for d, t in before.items() if not decontam.leaks(t, found)} and len(after) < len(before)
        else:
            found_in = {r.doc_id for r in secrets.find_secrets(now).collect() if r.spans}
            assert {*after} == {*before} and {d for d in after if after[d] != before[d]} == found_in
            assert not any('token = "' in t for t in after.values())
        now = out
    packed = P.STAGES[-1][1](spark, now, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {*after}
    whole = P.run(spark, SF)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_pipeline_takes_awkward_and_empty_documents(spark, awkward, nothing):
    import corpus_pipeline as P

    for start in (awkward.select("doc_id", "text", "lang", "source", "n_chars"), nothing):
        now = start
        for _, stage in P.STAGES:
            now = stage(spark, now, SF)
        assert (now.count() == 0) == (start is nothing)

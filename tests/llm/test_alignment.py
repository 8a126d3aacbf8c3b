"""Tokenizer alignment against a plain version that encodes whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from graphloom.llm import alignment as A

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}

    def piece(k):
        s = b.id_to_piece(k)
        return bytes([int(s[3:5], 16)]) if s.startswith("<0x") and len(s) == 6 else s.replace("▁", " ").encode()

    aligned, count = [], Counter()
    for doc_id, t in docs:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        parts_a, parts_b = [bytes(of[c] for c in a.id_to_token(k)) for k in ids_a], [piece(k) for k in ids_b]
        if not t or not b"".join(parts_a) == b"".join(parts_b) == (" " + t).encode():
            aligned.append((doc_id, None))
            continue
        owner_a, owner_b = [k for k, x in enumerate(parts_a) for _ in x], [k for k, x in enumerate(parts_b) for _ in x]
        links = [(ids_a[i], ids_b[j]) for i, j in sorted({*zip(owner_a, owner_b)})]
        groups, group, at = [], ([], []), 0
        for at in range(len(owner_a)):
            last_a, last_b = (at + 1 == len(o) or o[at + 1] != o[at] for o in (owner_a, owner_b))
            if last_a:
                group[0].append(ids_a[owner_a[at]])
            if last_b:
                group[1].append(ids_b[owner_b[at]])
            if last_a and last_b:
                groups.append("|".join(",".join(map(str, g)) for g in group))
                group = ([], [])
        count.update(links)
        aligned.append((doc_id, (len(ids_a), len(ids_b), groups, links)))
    best = Counter()
    for (_, k), n in count.items():
        best[k] = max(best[k], n)
    out = Counter()
    for doc_id, x in aligned:
        if x is None:
            out[doc_id, 0, 0, 0, 0, 0, 0, ""] += 1
        else:
            n_a, n_b, groups, links = x
            out[doc_id, n_a, n_b, len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()] += 1
    return out


def check(spark, docs, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in A.align(df, *PATHS, **how).collect()) == brute(docs)


ODD = ["a  b", " lead", "trail ", "tab\tin\nlines\r\n end", "<|endoftext|> is text", "x<|endoftext|>y <s> </s> <0x41> <unk>", "▁ mark", "a▁b", "日本語 の テキスト", "é́ ﬁ ① Å", " nbsp  x", "\x00 \x1c y", "🙂 🙂🙂 a", "don't won't I'll 's", "1234 56 7,8.9", "a \n b", " ", "   ", "\n", "x" * 3000, "ab " * 500, "-- == >>> ...", "​ zero ﻿"]


@pytest.mark.parametrize("seed", range(3))
def test_odd_texts(spark, seed):
    rng = random.Random(seed)
    pieces = [*ODD, "the", "of and", " ", "  ", "\n", "token", "ization", "Ünïcode", "'s", "3.14"]
    docs = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))) for k in range(150)]
    docs += [(300, None), (301, ""), (None, "no id"), (302, "the cat"), (302, "the cat")]
    check(spark, docs, shard_bytes=rng.choice([50, 1000, 1 << 20]))


def test_whole_table(spark, docs):
    check(spark, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], shard_bytes=30_000)


def test_shards_and_order_change_nothing(spark, docs):
    both = [sorted(map(tuple, A.align(df, *PATHS, shard_bytes=n).collect())) for df, n in ((docs, 1 << 25), (docs.repartition(7, F.rand(3)), 999))]
    assert both[0] == both[1]


def test_awkward_input(spark, awkward, nothing):
    rows = A.align(awkward, *PATHS).collect()
    assert len(rows) == awkward.count() and A.align(nothing, *PATHS).count() == 0
    assert Counter(tuple(r) for r in rows) == brute([(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()])

"""Personal data: fixed patterns, and bootstrapped contextual extraction; built-in functions only.

Entities of the fixed patterns are seeds.  Every identifier-like token (six characters or more, a digit among
them) and every seed is an instance; the two words before it and the word after it are lexical patterns.
On the bipartite graph of distinct (pattern, instance) pairs, a pattern's confidence is the smoothed mean
score of its instances, and an unseen instance scores by the noisy-or of its confident patterns; after
some rounds, instances that score high are identifiers wherever a confident pattern holds them.  Each round
is two aggregated joins: a pattern with very many instances is pre-aggregated by each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spans as S
from .common import materialize

# The base patterns of the contract, with possessive loops (no backtracking, no recursion) and
# starts only where a run of the first class begins or the last match ended, which is where matches can begin.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
#: The same for runs of 14 to 19 digits only, which are all that can pass.
CARD_SIZED = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Identifier-like tokens: whole runs, with a digit.
TOKEN = r"(?<![A-Za-z0-9._+@-])(?=[A-Za-z._+@-]*+[0-9])[A-Za-z0-9._+@-]{6,}+"
KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: Characters of text on either side that patterns are read from at once; where words or gaps reach further, ``_far`` reads them whole.
CONTEXT = 512
#: Instances that a pattern counts besides its own, with score 0.
SMOOTHING = 2.0
#: Seeds that a pattern needs, its least confidence, and the least score of a discovered instance.
LEAST_SEEDS = 3
LEAST_CONFIDENCE = 0.5
LEAST_SCORE = 0.7


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    """The digits' sum, every second one from the right doubled and its digits added, ends in 0."""

    def body(d: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            v = F.ascii(x) - 48
            twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
            return F.struct((acc["sum"] + F.when(acc["odd"], twice).otherwise(v)).alias("sum"), (~acc["odd"]).alias("odd"))

        start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd"))
        return F.aggregate(F.split(F.reverse(d), ""), start, step)["sum"] % 10 == 0

    return S.let(_digits(c), body)


def _in_range(c: Column) -> Column:
    # a part of any length: without leading zeros it has three digits at most
    return F.forall(F.split(c, r"\."), lambda p: S.let(F.ltrim(F.translate(p, "0", " ")), lambda q: F.length(q) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(256)) <= 255))


def _guarded(text: Column, holds: str, spans: Column) -> Column:
    return F.when(F.contains(text, F.lit(holds)), spans).otherwise(F.array().cast(S.SPAN))


def scan(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): ``doc_id, row``, spans of each base kind, and identifier-like tokens clear of them.

    All spans have their patterns.  Where the words beside a span don't end within CONTEXT characters, ``far_left`` or
    ``far_right`` says so, the pattern is left to ``_far``, and ``whole`` holds the text (else null).  Null and empty
    texts have no spans.
    """
    text = F.col("text").cast("string")
    email = _guarded(text, "@", S.located(text, EMAIL))
    ip = F.filter(_guarded(text, ".", S.located(text, IP)), lambda s: _in_range(s["match"]))
    card = F.filter(S.located(text, CARD_SIZED), lambda s: _luhn(s["match"]))
    phone = F.filter(_guarded(text, "+", S.located(text, PHONE)), lambda s: F.length(_digits(s["match"])).between(10, 15))
    token = S.located(text, TOKEN)
    found = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), email.alias("email"), ip.alias("ip"), card.alias("card"), phone.alias("phone"), token.alias("token"))
    found = found.withColumn("token", S.clear_of(F.col("token"), F.concat(*KINDS)))
    some = F.size(F.concat(*KINDS, "token")) > 0
    text = F.col("text").cast("string")
    found = found.withColumn("parts", F.when(some, S.chunks(text))).withColumn("size", F.length(text))

    def around(s: Column) -> Column:
        before = S.between(F.col("parts"), F.greatest(s["start"] - CONTEXT, F.lit(0)), s["start"])
        after = S.between(F.col("parts"), s["end"], F.least(s["end"] + CONTEXT, F.col("size")))
        from_start, to_end = s["start"] <= CONTEXT, s["end"] + CONTEXT >= F.col("size")

        def told(x: Column) -> Column:
            return F.struct(
                s["start"].alias("start"), s["end"].alias("end"), F.lower(s["match"]).alias("instance"),
                F.filter(F.array(_left(x["l"]), _right(x["r"])), lambda p: p.isNotNull()).alias("patterns"),
                (~from_start & (x["l"] == "")).alias("far_left"), (~to_end & (x["r"] == "")).alias("far_right"),
            )

        return S.let(F.struct(_two_before(before, from_start).alias("l"), _one_after(after, to_end).alias("r")), told)

    found = found.select("doc_id", "row", "text", *[F.transform(c, around).alias(c) for c in (*KINDS, "token")])
    far = F.exists(F.concat(*KINDS, "token"), lambda s: s["far_left"] | s["far_right"])
    return found.select("doc_id", "row", *KINDS, "token", F.when(far, F.col("text").cast("string")).alias("whole"))


def _two_before(before: Column, whole: Column) -> Column:
    """The last two words of ``before``, which starts where the text does if ``whole``; else a gap must come before them."""
    text = F.lower(before)
    return F.when(whole, F.regexp_extract(text, r"(?<!\S)(\S++\s++\S++)\s*+$", 1)).otherwise(F.regexp_extract(text, r"\s(\S++\s++\S++)\s*+$", 1))


def _one_after(after: Column, whole: Column) -> Column:
    text = F.lower(after)
    return F.when(whole, F.regexp_extract(text, r"^\s*+(\S++)", 1)).otherwise(F.regexp_extract(text, r"^\s*+(\S++)\s", 1))


def _left(words: Column) -> Column:
    return F.when(words != "", F.concat(F.lit("L "), F.regexp_replace(words, r"\s+", " ")))


def _right(word: Column) -> Column:
    return F.when(word != "", F.concat(F.lit("R "), word))


def _name(chain: Column, rest: Column) -> Column:
    """A word's name from its last piece and the digest of the pieces before: words of one piece are their own names."""
    return F.when(chain == "", F.lower(rest)).otherwise(F.concat(F.lit("\x01"), F.md5(F.concat(chain, F.lower(rest)).cast("binary"))))


def _beside(words: DataFrame, places: DataFrame) -> DataFrame:
    """``row, at, first, second``: names of the last two words that begin before each place; what lies behind the place is no part of them.

    ``words`` is (row, start, match), ``places`` (row, at).  Long words are cut into pieces of ``spans.CHUNK`` characters,
    each with a digest of all pieces before it, so a place inside a long word reads one piece and not the word.
    """

    def chained(parts: Column) -> Column:
        return F.aggregate(parts, F.array(F.lit("")), lambda acc, p: F.concat(acc, F.array(F.md5(F.concat(F.element_at(acc, -1), F.lower(p)).cast("binary")))))

    cut = words.withColumn("parts", S.chunks(F.col("match"))).withColumn("chain", chained(F.col("parts"))).drop("match")
    cut = cut.withColumn("name", _name(F.get("chain", F.size("parts") - 1), F.element_at("parts", -1)))
    cut = cut.withColumn("second", F.lag("name").over(Window.partitionBy("row").orderBy("start")))
    pieces = cut.select("row", "start", "second", "chain", F.posexplode("parts").alias("k", "piece"))
    pieces = pieces.select("row", (F.col("start") + F.col("k") * S.CHUNK).alias("at"), F.struct((F.col("start") + F.col("k") * S.CHUNK).alias("from"), F.get("chain", F.col("k")).alias("chain"), "piece", "second").alias("w"))
    # a word that begins at a place comes after it
    both = pieces.withColumn("is_place", F.lit(0)).unionByName(places.select("row", "at").distinct().withColumn("is_place", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy("row").orderBy("at", F.desc("is_place")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("w", F.last("w", ignorenulls=True).over(upto)).where("is_place = 1 and w is not null")
    return met.select("row", "at", _name(F.col("w.chain"), F.substring(F.col("w.piece"), F.lit(1), F.col("at") - F.col("w.from"))).alias("first"), "w.second")


def _far(found: DataFrame, each: DataFrame) -> DataFrame:
    """``row, seed, start, end, instance, pattern`` of the occurrences ``each`` whose words reach further than CONTEXT, read whole."""
    texts = found.where("whole is not null")
    words = texts.select("row", F.length("whole").alias("size"), F.explode(S.located(F.col("whole"), r"\S++")).alias("w")).select("row", "size", "w.start", "w.end", "w.match")
    # what follows is what comes before in the mirrored text
    turned = words.select("row", (F.col("size") - F.col("end")).alias("start"), F.reverse("match").alias("match"))
    left = each.where("far_left").select("row", "seed", "start", "end", "instance", F.col("start").alias("at"))
    right = each.where("far_right").join(texts.select("row", F.length("whole").alias("size")), "row").select("row", "seed", "start", "end", "instance", (F.col("size") - F.col("end")).alias("at"))
    before = left.join(_beside(words.select("row", "start", "match"), left), ["row", "at"]).where("second is not null").withColumn("pattern", _left(F.concat_ws(" ", "second", "first")))
    after = right.join(_beside(turned, right), ["row", "at"]).withColumn("pattern", _right(F.when(F.startswith("first", F.lit("\x01")), F.col("first")).otherwise(F.reverse("first"))))
    cols = ["row", "seed", "start", "end", "instance", "pattern"]
    return before.select(*cols).unionByName(after.select(*cols))


def bootstrap(occurrences: DataFrame) -> DataFrame:
    """``instance, pattern`` pairs that are discovered, from ``instance, seed, pattern`` (one row per pattern and occurrence).

    Without seeds, or without instances beside them, nothing is discovered.  Repeated rows count once.
    """
    edges = materialize(occurrences.groupBy("instance", "pattern").agg(F.max("seed").alias("seed")), "pii-edges")
    seeds = edges.groupBy("instance").agg(F.max(F.col("seed").cast("int")).cast("double").alias("first"))
    scores = seeds.withColumn("score", F.col("first"))
    for _ in range(ROUNDS):
        held = edges.select("instance", "pattern").join(scores.hint("merge"), "instance")
        confident = held.groupBy("pattern").agg((F.sum("score") / (F.count("*") + SMOOTHING)).alias("confidence"), F.sum("first").alias("seeds"))
        confident = materialize(confident.where((F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("seeds") >= LEAST_SEEDS)), "pii-patterns")
        doubt = edges.join(confident.hint("merge"), "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("reached"))
        scores = materialize(seeds.join(doubt, "instance", "left").select("instance", "first", F.greatest("first", F.coalesce("reached", F.lit(0.0))).alias("score")), "pii-scores")
    unseen = scores.where((F.col("first") == 0) & (F.col("score") >= LEAST_SCORE))
    return edges.join(confident.hint("merge"), "pattern").join(unseen.hint("merge"), "instance").select("instance", "pattern")


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context, n_spans`` for each row of ``docs`` (doc_id, text).

    A null text is an empty one: no spans, the digest of the empty string.  Repeated rows are scanned each.
    Discovered spans are of kind ``context`` and never overlap base ones.  ``n_spans`` counts spans of all kinds.
    """
    found = materialize(scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "pii-spans")
    tagged = F.concat(F.transform(F.concat(*KINDS), lambda s: F.struct(s.alias("s"), F.lit(True).alias("seed"))), F.transform("token", lambda s: F.struct(s.alias("s"), F.lit(False).alias("seed"))))
    cols = ["row", "seed", "start", "end", "instance"]
    each = found.select("row", F.explode(tagged).alias("o")).select("row", "o.seed", "o.s.*")
    far = materialize(_far(found, each), "pii-far")
    each = each.select(*cols, F.explode("patterns").alias("pattern")).unionByName(far)
    new = bootstrap(each.select("instance", "seed", "pattern"))
    one = F.struct(F.col("start"), F.lit(4).alias("rank"), F.col("end"), F.lit("context").alias("kind"))
    spans = each.where("not seed").join(new.hint("merge"), ["instance", "pattern"], "left_semi")
    by_row = spans.groupBy("row").agg(F.collect_set(one).cast(S.KINDED).alias("context"))  # one document's tokens
    out = found.drop("whole").join(by_row.hint("merge"), "row", "left").withColumn("context", F.coalesce("context", F.array().cast(S.KINDED)))
    base = [S.kinded(F.col(k), k, i) for i, k in enumerate(KINDS)]
    every = S.merged([*base, F.col("context")])
    return out.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(S.told(S.merged(base)).cast("binary"), 256).alias("base_sha256"),
        S.told(every).alias("spans"), F.size("context").cast("long").alias("n_context"), F.size(every).cast("long").alias("n_spans"),
    )

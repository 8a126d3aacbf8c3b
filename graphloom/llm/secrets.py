"""Secret scanning: fixed patterns, and a randomness test battery on long tokens; built-in functions only.

Tokens of 20 characters or more get an inferred encoding (the smallest alphabet that holds them) and, over
its symbols, three tests of H0 "uniformly random": chi-squared uniformity, runs above and below the middle,
and lag-one serial correlation; Bonferroni joins their p-values.  Benjamini-Hochberg holds the false-discovery rate
of rejections within each class of lengths: what it rejects is ordinary text.  That controls random strings that are
taken for text; a token that isn't rejected is random-looking, yet short or lucky words are too.  So the other error
is controlled as well: L = log2 of a token's likelihood as a random string over its likelihood under the characters of
the corpus's ordinary long tokens (those rejected, all counted).  By Markov's inequality 2^-L is a p-value of "ordinary
text", and Benjamini-Hochberg holds the false-discovery rate of secrets within each class of lengths.  Both run over
bins, so that nothing is ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spans as S
from .common import materialize

# The base patterns of the contract.
ASSIGN = r"""(?=[PpSsTtAa])(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
ASSIGN_LENGTH = 6

#: Long tokens, whole runs.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+"
# Alphabets of encodings, symbols in their numeric order.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
SYMBOLS = ENCODINGS["mixed"]
#: False-discovery rates within a class of lengths: of tokens that aren't random, and of secrets.
RANDOM_FDR = 0.001
FDR = 0.001
#: Bins are whole bits; evidence beyond counts as so many.
MOST_BITS = 256
MASK = "[SECRET]"


def _upper_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal, to 1e-7 (Abramowitz and Stegun 26.2.17)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / (2 * 3.141592653589793) ** 0.5 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _encoding(token: Column) -> Column:
    out = F.lit("mixed")
    for name in reversed([n for n in ENCODINGS if n != "mixed"]):
        chars = ENCODINGS[name].replace("-", "\\-")
        out = F.when(token.rlike(f"^[{chars}]+$"), name).otherwise(out)
    return out


def battery(tokens: DataFrame) -> DataFrame:
    """Of distinct ``token``: its body without padding, encoding, size k of its alphabet, length n and the joined p-value ``p_random``.

    Tokens match TOKEN (no null or empty ones).  The cost is linear in a token's length, whatever that is.
    """
    body = F.rtrim(F.translate("token", "=", " "))
    alphabet, size = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, symbols in ENCODINGS.items():
        alphabet = F.when(F.col("encoding") == name, symbols).otherwise(alphabet)
        size = F.when(F.col("encoding") == name, len(symbols)).otherwise(size)
    df = tokens.withColumn("body", body).withColumn("encoding", _encoding(F.col("body"))).withColumn("alphabet", alphabet).withColumn("k", size)
    df = df.withColumn("x", F.expr("transform(split(body, ''), c -> cast(instr(alphabet, c) - 1 as double))")).withColumn("n", F.size("x").cast("double"))
    df = df.withColumn("mean", F.expr("aggregate(x, 0d, (a, v) -> a + v) / n"))
    df = df.withColumn(
        "sums",
        F.expr(
            """aggregate(sequence(0, size(x) - 1), named_struct('sq', 0d, 'lag', 0d, 'high', 0d, 'runs', 1d), (a, i) -> named_struct(
                 'sq', a.sq + (x[i] - mean) * (x[i] - mean),
                 'lag', a.lag + if(i > 0, (x[i] - mean) * (get(x, i - 1) - mean), 0d),
                 'high', a.high + if(x[i] >= k / 2, 1d, 0d),
                 'runs', a.runs + if(i > 0 and (x[i] >= k / 2) <> (get(x, i - 1) >= k / 2), 1d, 0d)))"""
        ),
    )
    # the squared counts of the alphabet's symbols
    df = df.withColumn("same", F.expr("aggregate(split(alphabet, ''), 0d, (a, c) -> a + if(c = '', 0d, pow(n - length(replace(body, c, '')), 2)))"))
    chi2, freedom = F.col("k") / F.col("n") * F.col("same") - F.col("n"), F.col("k") - 1
    # Wilson and Hilferty's normal form of chi-squared; too even counts are as odd as uneven ones
    z_chi = (F.pow(F.greatest(chi2, F.lit(0.0)) / freedom, F.lit(1 / 3)) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))
    high, low = F.col("sums.high"), F.col("n") - F.col("sums.high")
    runs_mean = 2 * high * low / F.col("n") + 1
    runs_var = F.greatest((runs_mean - 1) * (runs_mean - 2) / (F.col("n") - 1), F.lit(1e-9))
    z_runs = F.when((high == 0) | (low == 0), F.sqrt("n")).otherwise((F.col("sums.runs") - runs_mean) / F.sqrt(runs_var))
    z_lag = F.when(F.col("sums.sq") == 0, F.sqrt("n")).otherwise((F.col("sums.lag") / F.col("sums.sq") + 1 / F.col("n")) * F.sqrt("n"))
    for name, z in (("p_chi", z_chi), ("p_runs", z_runs), ("p_lag", z_lag)):
        df = df.withColumn(name, 2 * _upper_tail(F.abs(z)))
    return df.select("token", "body", "encoding", "k", "n", F.least(F.lit(1.0), 3 * F.least("p_chi", "p_runs", "p_lag")).alias("p_random"))


def _least_bits(tested: DataFrame, rate: float) -> DataFrame:
    """``class, least`` of ``class, bits`` (p = 2^-bits): the fewest bits that Benjamini-Hochberg rejects in a class, if any."""
    bins = tested.groupBy("class", "bits").agg(F.count("*").alias("m"))  # MOST_BITS rows for each class of lengths at most
    by_class = Window.partitionBy("class")
    at_least = F.sum("m").over(by_class.orderBy(F.desc("bits")))
    passed = bins.withColumn("ok", F.pow(F.lit(2.0), -F.col("bits")) * F.sum("m").over(by_class) <= rate * at_least)
    return passed.where("ok").groupBy("class").agg(F.min("bits").alias("least"))


def _binned(bits: Column) -> Column:
    return F.least(F.greatest(F.floor(bits), F.lit(0)), F.lit(MOST_BITS)).cast("int").alias("bits")


def discoveries(tokens: DataFrame) -> DataFrame:
    """Which of the distinct ``token`` are random strings and not ordinary text; none of no tokens."""
    # p-values that underflow have all the bits there are
    against = F.when(F.col("p_random") > 0, -F.log2("p_random")).otherwise(F.lit(float(MOST_BITS)))
    tested = materialize(battery(tokens).select("token", "body", "k", F.floor(F.log2("n")).cast("int").alias("class"), _binned(against)), "secret-tests")
    judged = tested.join(F.broadcast(_least_bits(tested, RANDOM_FDR)), "class", "left").withColumn("plain", F.coalesce(F.col("bits") >= F.col("least"), F.lit(False)))
    counts = judged.where("plain").select(F.explode(F.split("body", "")).alias("c")).groupBy("c").agg(F.count("*").alias("n_c"))
    # one row: as many numbers as there are symbols
    model = counts.where(F.col("c") != "").agg(F.map_from_entries(F.collect_list(F.struct("c", "n_c"))).alias("seen"), F.coalesce(F.sum("n_c"), F.lit(0)).alias("total"))
    shaky = judged.where("not plain").drop("bits").join(F.broadcast(model))
    bits = F.expr(f"aggregate(split(body, ''), 0d, (a, c) -> a + if(c = '', 0d, log2((total + {len(SYMBOLS)}) / (coalesce(seen[c], 0) + 1) / k)))")
    shaky = materialize(shaky.select("token", "class", _binned(bits)), "secret-bits")
    return shaky.join(F.broadcast(_least_bits(shaky, FDR)), "class").where("bits >= least").select("token")


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """For each row of ``docs``: ``kept`` (the columns ``keep``), the base spans of each kind and the ``random`` ones.

    Null and empty texts have no spans; repeated rows are scanned each; an empty table gives no rows.
    """
    text = F.col("text").cast("string")
    assign = F.filter(S.located(text, ASSIGN, 1), lambda s: F.length(s["part"]) >= ASSIGN_LENGTH)
    access = F.when(F.contains(text, F.lit("AKIA")), S.located(text, ACCESS)).otherwise(F.array().cast(S.SPAN))
    tokens = F.transform(S.located(text, TOKEN), lambda s: F.struct(s["start"], s["end"], s["match"].alias("token")))
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.monotonically_increasing_id().alias("row"),
        S.kinded(assign, "assign", 0).alias("assign"), S.kinded(access, "access", 1).alias("access"), S.kinded(S.located(text, HEX), "hex", 2).alias("hex"), tokens.alias("tokens"),
    )
    base = materialize(base, "secret-spans")
    each = base.where(F.size("tokens") > 0).select("row", F.explode("tokens").alias("t")).select("row", "t.start", "t.end", "t.token")
    random = each.join(discoveries(each.select("token").distinct()), "token", "left_semi")
    one = F.struct(F.col("start"), F.lit(3).alias("rank"), F.col("end"), F.lit("random").alias("kind"))
    by_row = random.groupBy("row").agg(F.collect_list(one).cast(S.KINDED).alias("random"))  # one document's tokens
    none = F.array().cast(S.KINDED)
    # only rows with tokens, a small part, are shuffled for their decisions
    held = base.where(F.size("tokens") > 0).join(by_row, "row", "left").withColumn("random", F.coalesce("random", none))
    return base.where(F.size("tokens") == 0).withColumn("random", none).unionByName(held).drop("tokens", "row")


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random`` for each row of ``docs`` (doc_id, text).

    A null text is an empty one: no spans, the digest of the empty string.  Repeated rows are scanned each.
    """
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    base = [F.col(c) for c in ("assign", "access", "hex")]
    return found.select(
        "kept.doc_id", *[F.size(c).cast("long").alias(n) for c, n in zip(base, ("n_assign", "n_access", "n_hex"))],
        F.sha2(S.told(S.merged(base)).cast("binary"), 256).alias("base_sha256"),
        S.told(S.merged([*base, F.col("random")])).alias("spans"), F.size("random").cast("long").alias("n_random"),
    )


def mask_secrets(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with every span of the text replaced by a mask; n_chars follows the text.

    Null, empty and clean texts stay as they are; repeated rows are masked alike; columns may have any names.
    """
    found = scan(docs, docs.columns)
    spans = S.merged([F.col(c) for c in ("assign", "access", "hex", "random")])
    found = found.select("kept", spans.alias("spans")).withColumn("masked", S.masked(F.col("kept.text").cast("string"), F.col("spans"), MASK))
    some = F.size("spans") > 0
    new = {"text": F.when(some, F.col("masked")).otherwise(F.col("kept.text")), "n_chars": F.when(some, F.length("masked").cast("long")).otherwise(F.col("kept.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[(new[c] if c in new else F.col("kept").getField(c)).alias(c) for c in docs.columns])

"""Audit of the language and the numbers of texts, as they arrive.

Each paragraph of each text is searched for terms that need a second look and for numbers.  A term is ``framed`` where
one of the context words stands in its paragraph (as in "not released under"), else it is up for ``review``; a number
is ``canonical`` or ``other``.  Texts are files that a stream reads: the checkpoint knows which were audited, so that a
run takes new files only, and the sink's log makes each of them count once, whatever run breaks off.  A file that is
written anew under an old name isn't read again.

    python -m jobs.language_audit --documents PATH --output PATH --checkpoint PATH [--config FILE]
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import log, main

DOCUMENTS = "doc_id long, text string, lang string, source string"
HITS = "doc_id long, source string, paragraph int, kind string, found string, status string, n int, lang string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole(pattern: str) -> str:
    """The pattern where no letter or digit goes on at its sides; paragraphs have a space at either end.

    What stands between words is doubled before the search, so that neighbours find a side each: spaces are runs.
    """
    return f"[^a-z0-9](?:{pattern.replace(' ', ' +')})[^a-z0-9]"


def hits(docs: DataFrame, config: dict[str, Any]) -> DataFrame:
    """A row for each term and each number of a paragraph, with how often it stands there.  Null texts have none."""
    text = F.translate("text", UPPER, LOWER)
    p = docs.select("doc_id", "source", "lang", F.posexplode(F.split(text, config["paragraph"])).alias("at", "raw"))
    p = p.withColumn("p", F.concat(F.lit(" "), F.trim(F.regexp_replace("raw", r"[ \t\n\r\f\x0b]+", " ")), F.lit(" ")))

    def times(pattern: str) -> Column:
        return F.size(F.regexp_extract_all(F.regexp_replace("p", "([^a-z0-9])", "$1$1"), F.lit(whole(pattern)), F.lit(0)))

    framed = reduce(lambda a, b: a | b, (F.col("p").rlike(whole(c)) for c in config["contexts"]), F.lit(False))
    status = F.when(framed, "framed").otherwise("review")
    terms = F.array(*[F.struct(F.lit("term").alias("kind"), F.lit(name).alias("found"), status.alias("status"), times(pattern).alias("n")) for name, pattern in sorted(config["terms"].items())])
    numbers = F.regexp_extract_all("p", F.lit(config["number"]), F.lit(0))
    canonical = F.array(*[F.lit(x) for x in config["canonical"]]).cast("array<string>")
    counted = F.transform(F.array_distinct(numbers), lambda x: F.struct(F.lit("number").alias("kind"), x.alias("found"), F.when(F.array_contains(canonical, x), "canonical").otherwise("other").alias("status"), F.size(F.filter(numbers, lambda y: y == x)).alias("n")))
    found = F.explode(F.concat(F.filter(terms, lambda t: t["n"] > 0), counted)).alias("h")
    return p.select("doc_id", "source", (F.col("at") + 1).alias("paragraph"), found, "lang").select("doc_id", "source", "paragraph", "h.kind", "h.found", "h.status", "h.n", "lang")


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict[str, Any]) -> DataFrame:
    """Audits the files of ``documents`` that are new and returns the whole output as it stands then."""
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", config["files_at_a_time"]).parquet(f"{documents.rstrip('/')}*")
    sink = hits(stream, config).writeStream.format("parquet").partitionBy(*config["partitions"]).option("path", output).option("checkpointLocation", checkpoint)
    query = sink.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    read = sum(p["numInputRows"] for p in query.recentProgress)
    log.info("language_audit read %d new documents of %s in %d batches", read, documents, sum(p["numInputRows"] > 0 for p in query.recentProgress))
    whole = spark.read.schema(HITS).parquet(output)
    log.info("language_audit: %s holds %s", output, {f"{r.kind} {r.status}": r["count"] for r in whole.groupBy("kind", "status").count().collect()})
    return whole


if __name__ == "__main__":
    main("language_audit", __doc__.split("\n")[0], ("documents", "output", "checkpoint"), run)

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def awkward(spark):
    """Null, empty, blank and very long texts, ties, repeated rows, null ids, and extra columns with clashing names."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, "  \n\t ", None, "s", 4), (4, "one", "en", None, 3), (5, "one two", "en", "s", 7), (6, "the cat and the dog " * 20_000, "en", "s", 400_000),
        (7, "Der Hund und die Katze sind da. " * 5, "de", "s", 100), (7, "Der Hund und die Katze sind da. " * 5, "de", "s", 100), (8, "Der Hund und die Katze sind da. " * 5, "de", "t", 100), (None, "no id at all here", "en", "s", 5), (9, "1234 5678 !!", "en", "s", 9), (10, "é" * 5000, "fr", "s", 5000),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = ("row", "key", "fp", "shard", "class", "rank", "score", "component_id", "fingerprint", "lang_pred", "held_out", "slot", "k", "n", "task", "length", "start", "pattern", "token", "a", "b", "node", "root", "id", "kept", "gone_id", "again_id", "__n", "__row", "__assign", "spans", "masked", "hash", "of", "pick")
    return df.select("*", *[F.lit("x").alias(c) for c in clash]).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

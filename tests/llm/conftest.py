from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark: SparkSession):
    """A documents table from texts; ids count up unless given. Columns whose names operators use inside come along."""

    def make(texts: list, ids: list | None = None, langs: list | None = None, extra: bool = False) -> DataFrame:
        ids = list(range(len(texts))) if ids is None else ids
        langs = langs or ["en"] * len(texts)
        df = spark.createDataFrame([(i, t, l, "s", None if t is None else len(t)) for i, t, l in zip(ids, texts, langs)], DOCS)
        if extra:
            for c in ("id", "hash", "key", "fp", "score", "spans", "kept_id", "matched_id", "component_id", "words", "k", "n", "x", "value", "item_id", "place", "label", "least", "root", "n_words"):
                df = df.withColumn(c, F.lit("clash"))
        return df

    return make


ODD = [None, "", " \n\t ", "a", "a b c", "é ñ 漢字 🙂", "word " * 30_000, "x" * 100_000, "1" * 5000, "." * 5000]

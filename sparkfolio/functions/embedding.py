"""Text to vector: a hook for the caller's model and a default that needs no download."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.functions.text import content_tokens


def embedding_udf(load: Callable[[], Callable[[list[str]], list]], batch: int = 32) -> Callable[[Column], Column]:
    """Column function around a model: ``load`` runs once per task and returns ``encode(texts)``."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in parts:
            values = texts.fillna("").tolist()
            out: list = []
            for i in range(0, len(values), batch):
                out.extend([[float(x) for x in v] for v in encode(values[i:i + batch])])
            yield pd.Series(out)

    return embed


def hashed_embedding(df: DataFrame, text: str, out: str, size: int = 256) -> DataFrame:
    """Add unit-length hashed term counts as array<double>."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    tok = df.withColumn("_tok", content_tokens(F.col(text)))
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=size).transform(tok)
    return Normalizer(inputCol="_tf", outputCol="_n").transform(tf).withColumn(
        out, vector_to_array("_n")).drop("_tok", "_tf", "_n")

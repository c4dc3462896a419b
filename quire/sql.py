"""Functions of the library for SQL: `register(spark)` makes them callable by name in the session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quire.functions import canonical as K
from quire.functions import prose as P


def register(spark: SparkSession) -> list[str]:
    """Scalar functions over text and JSON, and a table function that cuts a text into sentences."""
    import unicodedata

    def scalar(kernel, kind: str):
        @F.pandas_udf(kind)
        def many(values: pd.Series) -> pd.Series:
            return values.map(lambda x: None if x is None else kernel(x))

        return many

    made = {
        "nfc": scalar(lambda x: unicodedata.normalize("NFC", x), "string"),
        "sentences": scalar(P.sentences, "array<string>"),
        "paragraphs": scalar(P.paragraph_list, "array<string>"),
        "joined_lines": scalar(P.joined_lines, "string"),
        "roman_value": scalar(P.roman_value, "int"),
        "canonical_json": K.canonical,
        "json_sha256": K.json_hash,
    }
    for name, function in made.items():
        spark.udf.register(name, function)

    @F.udtf(returnType="place int, sentence string")
    class Sentences:
        def eval(self, text: str):
            for i, s in enumerate(P.sentences(text or ""), 1):
                yield i, s

    spark.udtf.register("sentence_rows", Sentences)
    return [*made, "sentence_rows"]


def embedded(texts, embed, text: str = "text", name: str = "vector", batch: int = 256):
    """Rows with the vectors that an injected engine, `embed(list of texts) -> array of vectors`, gives their texts, a
    batch at a time. The engine is made or loaded in the worker by what it closes over."""
    schema = StructType([*texts.schema.fields, StructField(name, ArrayType(DoubleType()))])

    def run(batches):
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                yield part.assign(**{name: [[float(x) for x in v] for v in embed(part[text].fillna("").tolist())]})

    return texts.mapInPandas(run, schema)

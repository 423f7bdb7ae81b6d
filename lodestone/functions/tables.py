"""Table functions for SQL: words with their places, word n-grams, and parts of long texts.

`register(spark)` makes them callable as `SELECT ... FROM documents, LATERAL words_of(text)`. They are for ad-hoc SQL; where
a DataFrame is at hand, the column functions of `text` do the same inside the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

_TOKEN = re.compile("[a-z0-9]+")


@udtf(returnType="pos int, word string", useArrow=False)
class words_of:  # noqa: N801
    """The runs of a-z and 0-9 of a lower-cased text, numbered from 0."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(_TOKEN.findall((text or "").lower()))


@udtf
class ngrams_of:  # noqa: N801
    """The n-grams of a text's words: place and words as columns w1 to wn; n is a constant, which decides on the columns."""

    @staticmethod
    def analyze(text: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        if not n.isConstantExpression or not isinstance(n.value, int) or not 1 <= n.value <= 8:
            raise ValueError("n must be a constant from 1 to 8")
        schema = StructType().add("pos", IntegerType())
        for k in range(n.value):
            schema = schema.add(f"w{k + 1}", StringType())
        return AnalyzeResult(schema)

    def eval(self, text: str, n: int) -> Iterator[tuple]:
        words = _TOKEN.findall((text or "").lower())
        for i in range(len(words) - n + 1):
            yield (i, *words[i : i + n])


@udtf
class turn_gaps:  # noqa: N801
    """Over a table (session, pos, text) taken session by session in the order of pos: the characters said before each turn.

    Its input is partitioned and ordered by what `analyze` asks for, so a call needs no PARTITION BY of its own.
    """

    def __init__(self):
        self.said = 0

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        fields = table.dataType
        schema = StructType().add("session", fields["session"].dataType).add("pos", fields["pos"].dataType).add("said_before", IntegerType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("session")], orderBy=[OrderingColumn("pos")])

    def eval(self, row) -> Iterator[tuple]:  # noqa: ANN001
        yield row["session"], row["pos"], self.said
        self.said += len(row["text"] or "")


def register(spark: SparkSession) -> SparkSession:
    for name, f in (("words_of", words_of), ("ngrams_of", ngrams_of), ("turn_gaps", turn_gaps)):
        spark.udtf.register(name, f)
    return spark

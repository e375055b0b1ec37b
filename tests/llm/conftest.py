import re

import pytest

LONG = "lorem ipsum dolor " * 20000
#: Nulls, empty and blank texts, repeated rows, ties, a very long text, repeated ids.
ROWS = [
    (1, "one two three four five six seven", "en", "a", 33),
    (2, "one  two three\tfour five six seven", "en", "a", 34),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \n ", "de", "b", 3),
    (5, " \n ", "de", "b", 3),
    (None, "one two three four five six seven", None, "a", 33),
    (7, LONG, "en", "a", len(LONG)),
    (8, "Größe über alles 😀 x", "de", "b", 20),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with extra columns whose names clash with those that operators make."""
    from pyspark.sql import functions as F

    names = ["id", "fp", "h", "n", "m", "a", "b", "keep_id", "kept", "component_id", "sha", "score", "term", "cell", "slot"]
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit(f"x{k}").alias(name) for k, name in enumerate(names)])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


class Plans:
    """What the queries run while it listens have shuffled, with every size check failing and Spark's own broadcasts off."""

    def __init__(self, spark):
        self.spark, self.found = spark, []

    def note(self, df):
        mode = self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        for columns in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\n]*)\]\n", df._jdf.queryExecution().explainString(mode)):
            self.found += [c.split("#")[0].strip() for c in columns.split(",")]

    def shuffled(self):
        return set(self.found)

    def texts(self):
        return self.shuffled() & {"text", "_text", "_words", "_row"}


@pytest.fixture
def plans(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from strataspark.llm import common

    found = Plans(spark)
    monkeypatch.setattr(common, "small", lambda *a, **b: False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    kind = type(spark.range(0))
    for name in ("checkpoint", "collect", "toPandas", "toArrow", "first"):
        real = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda df, *a, real=real, **b: (found.note(df), real(df, *a, **b))[1])
    yield found
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

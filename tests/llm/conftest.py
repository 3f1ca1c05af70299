import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("row", T.StringType()), T.StructField("id", T.StringType())])

WORDS = "the of and river stone house light garden winter paper summer bridge yellow silver market window".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7919 + k * k * 31 + k * seed) % len(WORDS)] + str((seed * 31 + k * 17) % 97) for k in range(n))


def rows():
    """Nulls, empty and long texts, equal texts and rows, near copies, a shared passage; columns whose names clash with the operators' own."""
    shared = sentence(900, 120)
    texts = [(k, sentence(k, 60 + k), "en", f"src{k % 3}") for k in range(12)]
    texts += [(20, None, None, None), (21, "", "en", "src0"), (22, " \t\n ", "en", None), (None, sentence(3, 63), "en", "src1"), (24, "one", "en", "src2")]
    texts += [(30, sentence(5, 65), "de", "src0")] * 2 + [(32, sentence(5, 65), "en", "src0")]
    texts += [(40, sentence(41, 300) + " end", "en", "src1"), (41, sentence(41, 300) + " fin", "en", "src1")]
    texts += [(50 + k, sentence(60 + k, 40) + " " + shared + " " + sentence(70 + k, 40), "en", "src0") for k in range(3)]
    texts += [(60, "again " * 400, "en", "src0"), (61, "é ü 日本 " + sentence(8, 6000), "fr", "src2"), (62, "same line here\n" * 40, "en", "src0")]
    return [(*t, len(t[1]) if t[1] is not None else None, "x", "y", "z", "w") for t in texts]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "t")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "t")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)

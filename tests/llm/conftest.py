import pytest
from pyspark.sql import types as T

import __spark_entry__ as entry

LINE = "This very line is found in many documents of the table"


def _long():
    return " ".join(f"w{i % 977}x{i // 977}" for i in range(30_000))


PASSAGE = " ".join(f"shared{i}" for i in range(60))
BODY = " ".join(f"body{i}" for i in range(120))

EDGE = [
    (None, "a row without an id " + PASSAGE),
    (900, None), (901, ""), (902, "   \n\t\n "), (903, "one"), (904, "one"), (905, "one two three four"),
    (906, BODY), (907, BODY), (907, BODY), (908, BODY.replace("body7 ", "changed7 ")),
    (909, BODY + " \n" + LINE), (910, f"{LINE}\n{PASSAGE}\n{LINE}"), (911, "  " + LINE.upper() + "\t\nown line 911"),
    (912, f"x\n{LINE}"), (913, f"{LINE}\ny {PASSAGE} z"), (914, LINE), (915, f"{LINE}\n\nq"),
    (916, "a " * 400), (917, "\n".join(["the same line again and again here"] * 30)),
    (918, "mail a@b.c_d@e.fr, x..y@z-.org IBAN DE89 3704 0044 0532 0130 00 ssn 123-45-6789 +49 (30) 1234567-"),
    (919, "4111 1111 1111 1111 and 4111-1111-1111-1112 10.0.0.256 1.2.3.4.5.6.7.8 001.002.3.255 é+1 555 000 1234"),
    (920, "日本語 テスト  double  spaces nbsp \x1c odd\x85 ends "), (921, "<|endoftext|> # ** && <b>"),
    (922, _long()), (923, _long() + " tail words of another copy"),
    (926, " ".join(f"u{i}@h{i}.org +49 30 {i:07d}" for i in range(1500))),
    (924, "xaaaaaaaaaaaa" * 200), (925, "9" * 3000 + " a" + ".b" * 3000 + "@" + "c." * 3000 + "d"),
]


@pytest.fixture(scope="session")
def docs(spark, sf_small):
    """The small documents and edge cases, with extra columns of clashing names."""
    small = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    rows = [(i, t, "l", "s", len(t) if t is not None else None, 7, "x", 1)
            for i, t in small + EDGE]
    schema = T.StructType([T.StructField(n, k()) for n, k in [
        ("doc_id", T.LongType), ("text", T.StringType), ("lang", T.StringType), ("source", T.StringType),
        ("n_chars", T.LongType), ("n_words", T.IntegerType), ("spans", T.StringType), ("id", T.IntegerType)]])
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="session")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(docs, spark):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="session")
def registered():
    return entry.queries()

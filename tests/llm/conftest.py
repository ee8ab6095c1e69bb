import random

import pytest
from pyspark.sql.types import (IntegerType, LongType, StringType, StructField, StructType)

WORDS = ("the of and to in house river table stone light bread water paper window garden music "
         "road winter summer letter story morning evening people nation market school").split()
DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                   StructField("lang", StringType()), StructField("source", StringType()),
                   StructField("n_chars", IntegerType())])


def prose(rng, n):
    out = [rng.choice(WORDS) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(out)) + "."


@pytest.fixture(scope="session")
def doc_rows():
    """Documents with nulls, empty and very long texts, copies and near copies."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(55, 120)) for _ in range(40)]
    long_text = prose(rng, 30_000)
    texts += [None, "", " \n\t ", "One", "One two", texts[0], texts[0], texts[1].upper(),
              texts[2] + " end", long_text, "a  b\r\n\tc  ", "é ñ 漢字 \U0001F600 ▁ x"]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, "en" if i % 7 else None, f"s{i % 3}" if i % 11 else None,
                     None if t is None else len(t)))
    return rows


@pytest.fixture()
def table(spark, tmp_path):
    """Writes rows as a table of a data folder and gives the folder."""
    def write(rows, schema=DOCS, name="documents"):
        spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(
            f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write

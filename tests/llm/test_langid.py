import zlib

from pyspark.sql import functions as F
from topicspace.llm.langid import Classifier, fit_dictionaries, identify, op9_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op9_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0.0 <= r.score <= 1.0 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.97
    sure = [r for r in held if not r.rejected]
    assert sum(r.lang_pred == r.lang for r in sure) / len(sure) >= 0.98


def test_prediction_against_brute_force(spark):
    import zstandard
    dicts = {"x": b"alpha beta gamma delta " * 30, "y": b"uno dos tres cuatro cinco " * 30}
    c = Classifier(dicts)
    for text in ["Alpha, BETA gamma!", "dos tres uno 77 cuatro", "alpha dos"]:
        sizes = []
        for content in dicts.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=5)
            z = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)
            plain = " ".join("".join(ch if ch.isalpha() else " " for ch in text.lower()).split())
            tail = " " if not text[-1].isalpha() else ""
            sizes.append(len(z.compress((plain + tail).encode())))
        assert c.sizes(text) == sizes
        assert c.predict(text)[0] == ("x" if sizes[0] <= sizes[1] else "y")


def test_edge_cases(spark, table, doc_rows):
    got = {r.doc_id: r for r in op9_language_id(spark, table(doc_rows + [(None, "of the", "en", None, 6)])).collect()}
    assert [got[i].lang_pred for i in (40, 41, 42)] == ["und"] * 3
    assert got[0].lang_pred == "en" and got[None].held_out is False
    assert op9_language_id(spark, table([])).count() == 0
    unlabelled = [(1, "some words", None, None, 10)]
    assert [r.lang_pred for r in op9_language_id(spark, table(unlabelled)).collect()] == ["und"]


def test_fit_takes_a_bounded_sample_of_each_language(spark):
    rows = [(i, f"word{i} " * 100, "a" if i % 3 else "b") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    got = fit_dictionaries(df, sample_rows=5, passage_chars=50)
    assert list(got) == ["a", "b"] and all(len(v) <= 5 * 51 for v in got.values())
    assert got == fit_dictionaries(df.repartition(7), sample_rows=5, passage_chars=50)
    out = identify(df.withColumn("score", F.lit("old")), got)
    assert out.columns == ["doc_id", "lang", "lang_pred", "score", "rejected"] and out.count() == 90

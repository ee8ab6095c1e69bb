import corpus_pipeline as P
from topicspace.llm import merge_dropout, mixing, pii, quality, simhash
from topicspace.llm.common import materialize

JUNK = " | ".join(["cell"] * 4 + [f"c{i}" for i in range(70)])


def test_stages_one_by_one(spark, table, doc_rows):
    rows = doc_rows + [(700 + i, JUNK + f" x{i}", "en", "s1", 9) for i in range(6)]
    rows += [(800, doc_rows[5][1][:-1] + " mail a.1@b.example.org.", "en", "s2", 9)]
    folder = table(rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    steps = [quality.keep_documents, simhash.deduplicate, pii.replace_pii, mixing.mix_documents]
    for (name, stage), same in zip(P.STAGES, steps):
        out = materialize(stage(spark, docs, folder), "t")
        assert out.columns == columns, name
        assert sorted(map(str, out.collect())) == sorted(map(str, same(docs).collect())), name
        docs = out
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert texts and not any("a.1@b.example.org" in t for t in texts.values())
    assert not set(texts) & {40, 41, 42, 43, *range(700, 706)}
    run = P.run(spark, folder).collect()
    assert sorted(r.doc_id for r in run) == sorted(r.doc_id for r in docs.collect())
    encoder = merge_dropout.Encoder(__import__("public_tokenizers").path(merge_dropout.MODEL))
    assert all(encoder.decode(r.ids) == texts[r.doc_id] for r in run)
    assert [len(s) for s in P.STAGES] == [2] * 5 and P.ORACLE_SQL is None


def test_empty_and_clashing(spark, table):
    assert P.run(spark, table([])).count() == 0
    import corpus_pipeline
    df = spark.createDataFrame([(1, None, "x", 3, True, "k")],
                               "doc_id long, text string, source string, size int, kept boolean, fingerprint string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, "").columns == df.columns

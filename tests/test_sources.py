import os

from topicspace.sources import files as SF
from topicspace.sources import writers as W

from topicspace_cases import write


def test_corpus_rules(spark, tmp):
    # last article without a trailing blank line; duplicate title (last wins);
    # a double blank line (empty block skipped)
    p = write(os.path.join(tmp, "corpus.txt"),
              "Alpha\nline one\nline two\n\nBeta\nb text\n\n\nAlpha\nnewer\n\nGamma\nlast one")
    got = {r.title: r.content for r in SF.read_corpus(spark, p).collect()}
    assert got == {"Alpha": "newer", "Beta": "b text", "Gamma": "last one"}
    all_rows = SF.read_corpus(spark, p, dedupe=False).count()
    assert all_rows == 4


def test_corpus_crlf(spark, tmp):
    p = write(os.path.join(tmp, "corpus_crlf.txt"), "T1\r\na\r\nb\r\n\r\nT2\r\nc\r\n", newline="")
    got = {r.title: r.content for r in SF.read_corpus(spark, p, line_sep="\r\n\r\n").collect()}
    assert got == {"T1": "a b", "T2": "c"}


def test_corpus_writer_roundtrip(spark, tmp):
    df = spark.createDataFrame([("Ancient history", "x y\nz"), ("War", "w")], "title string, body string")
    out = os.path.join(tmp, "written")
    W.write_corpus(df.coalesce(1), "title", "body", out)
    got = {r.title: r.content for r in SF.read_corpus(spark, out).collect()}
    assert got == {"Ancient history": "x y z", "War": "w"}


def test_article_dictionary_last_wins_and_normalised(spark, tmp):
    p = write(os.path.join(tmp, "article_ids.txt"), "War 1\nPets 2\nWar 3\n")
    got = {r.title: r.article_id for r in SF.read_article_dictionary(spark, p).collect()}
    assert got == {"War": 3, "Pets": 2}


def test_last_wins_over_many_splits(spark, tmp):
    lines = "".join(f"k{i % 7} {i}\n" for i in range(20000))
    p = write(os.path.join(tmp, "big_dict"), lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = SF.read_whitespace_table(spark, p, lambda t: [t[0].alias("k"), t[1].cast("int").alias("v")])
        assert df.rdd.getNumPartitions() > 5
        got = {r.k: r.v for r in SF.last_wins(df, "k").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expect = {f"k{k}": max(i for i in range(20000) if i % 7 == k) for k in range(7)}
    assert got == expect


def test_category_files(spark, tmp):
    cats = write(os.path.join(tmp, "category_names.txt"), "Geography\t5834\r\nScience\t5833\r\nPeople\t5904\r\n",
                 newline="")
    names = {r.category_id: r.name for r in SF.read_category_names(spark, cats).collect()}
    assert names == {5834: "Geography", 5833: "Science", 5904: "People"}
    labels = {r.category_id: r.label for r in SF.read_category_labels(spark, cats).collect()}
    assert labels == {5834: 1, 5833: 2, 5904: 3}
    flt = write(os.path.join(tmp, "category_filter.txt"), "6106\n55891\n6106")
    assert sorted(r.category_id for r in SF.read_category_filter(spark, flt).collect()) == [6106, 55891]


def test_membership(spark, tmp):
    # repeated category, article without categories, article listed twice
    p = write(os.path.join(tmp, "membership.txt"), "1 10 11 10\n2\n3 30\n3 31 32\n")
    got = sorted(tuple(r) for r in SF.read_membership(spark, p).collect())
    assert got == [(1, 10), (1, 11), (3, 31), (3, 32)]


def test_word_vectors_latin1(spark, tmp):
    p = os.path.join(tmp, "vectors.txt")
    with open(p, "w", encoding="ISO-8859-1") as f:
        f.write('caf\xe9 0.5 -1.0\n" 0.25 0.75\nthe 1 2\n')
    vecs = {r.word: list(r.vec) for r in SF.read_word_vectors(spark, p, 2).collect()}
    assert vecs == {"caf\xe9": [0.5, -1.0], '"': [0.25, 0.75], "the": [1.0, 2.0]}
    vocab = spark.createDataFrame([("the", 4), ("café", 9), ("zzz", 5)], "word string, idx int")
    kept = {r.idx: list(r.vec) for r in SF.word_vectors_for_vocabulary(SF.read_word_vectors(spark, p, 2), vocab).collect()}
    assert kept == {4: [1.0, 2.0], 9: [0.5, -1.0]}


def test_word_vector_writer_roundtrip(spark, tmp):
    df = spark.createDataFrame([("The", [0.5, 1.5]), ("Cat", [-2.0, 0.25])], "word string, vec array<float>")
    out = os.path.join(tmp, "wv")
    W.write_word_vectors(df, out, mode="overwrite")
    back = {r.word: list(r.vec) for r in SF.read_word_vectors(spark, out, 2).collect()}
    assert back == {"the": [0.5, 1.5], "cat": [-2.0, 0.25]}


def test_distance_and_centroid_csv(spark, tmp):
    d = write(os.path.join(tmp, "d.csv"), "War,Logic,2.5\nAnimals,Pets,1.0\n")
    rows = [tuple(r) for r in SF.read_distance_triples(spark, d).collect()]
    assert rows == [("Animals", "Pets", 1.0), ("War", "Logic", 2.5)]
    c = write(os.path.join(tmp, "c.csv"), "War,1.0,2.0,3.0\nLogic,0.0,-1.5,2.0\n")
    cen = {r.name: list(r.vec) for r in SF.read_centroids(spark, c).collect()}
    assert cen == {"War": [1.0, 2.0, 3.0], "Logic": [0.0, -1.5, 2.0]}


def test_csv_text_sinks(spark, tmp):
    df = spark.createDataFrame([("a", 1.5)], "name string, v double")
    W.write_csv(df, os.path.join(tmp, "csv"), single_file=True)
    parts = [f for f in os.listdir(os.path.join(tmp, "csv")) if f.startswith("part-")]
    assert len(parts) == 1
    assert SF.read_result is not None


def test_text_dump_and_recommendation_lines(spark, tmp):
    from topicspace.plans.recommend import recommendation_lines
    recs = spark.createDataFrame([("Logic", "War", 1.5, 1)], "item string, user string, rating double, rank int")
    lines = [r.line for r in recommendation_lines(recs).collect()]
    assert lines == ["Logic,War,1.5"]
    out = os.path.join(tmp, "txt")
    W.write_text(recommendation_lines(recs), "line", out, single_file=True)
    text = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.startswith("part-"))
    assert text == "Logic,War,1.5\n"
    res = os.path.join(tmp, "res")
    recs.write.parquet(res)
    assert SF.read_result(spark, res).count() == 1


def test_save_load_model(spark, tmp):
    from topicspace.operators.tfidf import tfidf_model
    df = spark.createDataFrame([("a b",), ("b c",)], "content string")
    model = tfidf_model(8).fit(df)
    W.save_model(model, os.path.join(tmp, "m"))
    again = W.load_model(os.path.join(tmp, "m"))
    a = [r.features for r in model.transform(df).collect()]
    b = [r.features for r in again.transform(df).collect()]
    assert a == b


def test_word_vectors_bad_lines(spark, tmp):
    import pytest
    p = write(os.path.join(tmp, "bad_vectors.txt"), "good 1 2\nbad x 2\nshort 1\n")
    dropped = {r.word for r in SF.read_word_vectors(spark, p, 2, bad_lines="drop").collect()}
    assert dropped == {"good"}
    nulls = SF.read_word_vectors(spark, p, 2, bad_lines="null").count()
    assert nulls == 3
    with pytest.raises(Exception):
        SF.read_word_vectors(spark, p, 2).collect()


def test_corpus_many_splits(spark, tmp):
    # 3000 articles, titles repeat every 1000: the last of each title wins
    blocks = [f"T{i % 1000}\nline {i} a\nline {i} b" for i in range(3000)]
    p = write(os.path.join(tmp, "big_corpus.txt"), "\n\n".join(blocks) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = SF.read_corpus(spark, p)
        assert SF.read_lines(spark, p, line_sep="\n\n").rdd.getNumPartitions() > 5
        got = {r.title: r.content for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"T{t}": f"line {2000 + t} a line {2000 + t} b" for t in range(1000)}

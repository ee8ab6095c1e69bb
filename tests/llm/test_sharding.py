import zlib

from topicspace.llm.sharding import op1_shard_shuffle, shuffle_shards


def test_op1_against_brute_force(spark, table, doc_rows):
    got = {r.doc_id: r for r in op1_shard_shuffle(spark, table(doc_rows)).collect()}
    assert len(got) == len(doc_rows)
    for i, text, *_ in doc_rows:
        raw = b"" if text is None else text.encode()
        assert got[i].size == len(raw) + 1
        assert got[i].text_crc32 == (None if text is None else zlib.crc32(raw))
        assert got[i].law == "rows" and got[i].grown_shard is None
    slots = {}
    for r in got.values():
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_order_follows_the_seed_alone(spark, doc_rows):
    def places(parts, **kw):
        df = spark.createDataFrame([(r[0], r[1]) for r in doc_rows], "doc_id long, text string")
        out = shuffle_shards(df.repartition(parts), 4, bucket_bytes=2000, **kw)
        return {r.doc_id: (r.shard, r.slot) for r in out.collect()}

    assert places(1) == places(5)
    assert places(3) != places(3, seed=99)
    order = [i for i, _ in sorted(places(2).items(), key=lambda x: x[1])]
    assert order != sorted(order)


def test_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x", "old", 7)] * 9 + [(None, None, None, None)],
                               "doc_id long, text string, shard string, slot int")
    rows = shuffle_shards(df, 3).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [
        (0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]


def test_empty_table(spark, table):
    assert op1_shard_shuffle(spark, table([])).count() == 0

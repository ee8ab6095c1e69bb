"""Independent SQL (DuckDB dialect) for the registered queries, run by the
correctness check on the same Parquet tables. Each string computes the same
result as the Spark query of the same name from the raw tables, without
sharing code with it."""

from __future__ import annotations

# MurmurHash3 x86 32-bit constants and the seed Spark ML's
# HashingTF uses.
M3_C1 = 0xCC9E2D51
M3_C2 = 0x1B873593
M3_N = 0xE6546B64
M3_F1 = 0x85EBCA6B
M3_F2 = 0xC2B2AE35
M3_SEED = 42
U32 = 4294967296

WS_CLASS = "[ \\t\\n\\x0B\\f\\r]"
WS_CHARS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
FILTER_LIST = ("('de'),('en'),('es'),('fr'),('src0'),('src1'),('src2'),('src3'),('src4'),"
               "('src5'),('src6'),('src7'),('src8'),('src9')")


def content_sql(text: str = "text") -> str:
    """Lines after the first, joined by one space."""
    parts = f"string_split({text}, chr(10))"
    return f"array_to_string(list_slice({parts}, 2, len({parts})), ' ')"


def title_sql(text: str = "text") -> str:
    return f"string_split({text}, chr(10))[1]"


def ml_tokens_sql(s: str) -> str:
    """Lower-case, split on each whitespace character, trailing empties dropped."""
    low = f"lower({s})"
    stripped = f"rtrim({low}, {WS_CHARS})"
    return (f"CASE WHEN {stripped} = '' AND {low} <> '' THEN []::VARCHAR[] "
            f"ELSE regexp_split_to_array({stripped}, '{WS_CLASS}') END")


def word_tokens_sql(s: str, min_len: int = 3) -> str:
    return (f"list_filter(regexp_split_to_array(lower({s}), '[^\\p{{L}}]+'), "
            f"lambda w: length(w) >= {min_len})")


def stream_tokens_sql(s: str) -> str:
    return f"list_filter(regexp_split_to_array({s}, '{WS_CLASS}+'), lambda w: w <> '')"


def _kmix(x: str) -> str:
    k1 = f"(({x}) * {M3_C1} % {U32})"
    k2 = f"((({k1} << 15) | ({k1} >> 17)) % {U32})"
    return f"({k2} * {M3_C2} % {U32})"


def murmur_bucket_ctes(words: str, word: str, n: int, prefix: str = "_m") -> tuple[str, str]:
    """CTEs adding ``bucket`` (Spark ML HashingTF index with ``n`` features) to the
    distinct words of relation ``words``. Returns (ctes, name of the last CTE)."""
    p = prefix
    ctes = f"""
{p}0 AS (SELECT DISTINCT {word} AS w FROM {words}),
{p}1 AS (SELECT w, octet_length(encode(w)) AS n,
    list_transform(range(octet_length(encode(w))),
                   lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::UBIGINT) AS bs
  FROM {p}0),
{p}2 AS (SELECT w, n,
    list_transform(range(n // 4), lambda j: bs[4 * j + 1] + bs[4 * j + 2] * 256
                   + bs[4 * j + 3] * 65536 + bs[4 * j + 4] * 16777216) AS blocks,
    CAST(coalesce(list_sum(list_transform(range(n % 4),
         lambda i: bs[4 * (n // 4) + i + 1] * CAST(pow(256, i) AS UBIGINT))), 0) AS UBIGINT) AS tail
  FROM {p}1),
{p}3 AS (SELECT w, n, tail,
    list_reduce(list_transform(blocks, lambda x: {_kmix('x')}),
                lambda h, k: ((((xor(h, k) << 13) | (xor(h, k) >> 19)) % {U32}) * 5 + {M3_N}) % {U32},
                {M3_SEED}::UBIGINT) AS h
  FROM {p}2),
{p}4 AS (SELECT w, xor(CASE WHEN n % 4 > 0 THEN xor(h, {_kmix('tail')}) ELSE h END,
                      n::UBIGINT) AS h FROM {p}3),
{p}5 AS (SELECT w, (xor(h, h >> 16) * {M3_F1}) % {U32} AS h FROM {p}4),
{p}6 AS (SELECT w, (xor(h, h >> 13) * {M3_F2}) % {U32} AS h FROM {p}5),
{p}7 AS (SELECT w, xor(h, h >> 16) AS h FROM {p}6),
{p}8 AS (SELECT w AS {word},
    CAST(((CASE WHEN h >= 2147483648 THEN h::BIGINT - {U32} ELSE h::BIGINT END) % {n} + {n}) % {n}
         AS INTEGER) AS bucket
  FROM {p}7)"""
    return ctes, f"{p}8"


def stable(x: str) -> str:
    return f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"


def _category_distance_tfidf() -> str:
    ctes, hashed = murmur_bucket_ctes("toks", "w", 20)
    return f"""
WITH docs AS (
  SELECT doc_id, source, lang, {content_sql()} AS content FROM documents),
toks AS (SELECT doc_id, unnest({ml_tokens_sql('content')}) AS w FROM docs),
{ctes},
tf AS (SELECT t.doc_id, h.bucket, count(*)::DOUBLE AS tf
       FROM toks t JOIN {hashed} h ON t.w = h.w GROUP BY t.doc_id, h.bucket),
m AS (SELECT count(*)::DOUBLE AS m FROM documents),
idf AS (SELECT bucket, ln((m.m + 1) / (count(*) + 1)) AS idf FROM tf, m GROUP BY bucket, m.m),
tfidf AS (SELECT tf.doc_id, tf.bucket, tf.tf * idf.idf AS v FROM tf JOIN idf USING (bucket)),
keep(category) AS (VALUES {FILTER_LIST}),
mem AS (SELECT DISTINCT doc_id, category FROM (
          SELECT doc_id, source AS category FROM documents UNION ALL
          SELECT doc_id, lang AS category FROM documents) WHERE category IN (SELECT category FROM keep)),
ncat AS (SELECT category, count(*) AS n FROM mem GROUP BY category),
grid AS (SELECT category, b AS bucket FROM ncat, range(20) r(b)),
sums AS (SELECT mem.category, tfidf.bucket, sum(tfidf.v) AS s
         FROM mem JOIN tfidf ON mem.doc_id = tfidf.doc_id GROUP BY mem.category, tfidf.bucket),
mean AS (SELECT g.category, g.bucket, coalesce(s.s, 0) / n.n AS v
         FROM grid g JOIN ncat n USING (category)
         LEFT JOIN sums s ON s.category = g.category AND s.bucket = g.bucket)
SELECT a.category AS name1, b.category AS name2, {stable('sum((a.v - b.v) * (a.v - b.v))')} AS distance
FROM mean a JOIN mean b ON a.bucket = b.bucket AND a.category < b.category
GROUP BY a.category, b.category
"""


DOCS = f"docs AS (SELECT doc_id, source, lang, text, {title_sql()} AS title, {content_sql()} AS content FROM documents)"
MEM = ("mem AS (SELECT DISTINCT doc_id, category FROM (SELECT doc_id, source AS category FROM documents "
       "UNION ALL SELECT doc_id, lang AS category FROM documents))")
KEEP = f"keep(category) AS (VALUES {FILTER_LIST})"


def _unnest_tokens(tokens_sql: str, text: str = "content", name: str = "token") -> str:
    return (f"SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS {name} "
            f"FROM (SELECT doc_id, {tokens_sql} AS l FROM docs)")


WORD_TOKS = _unnest_tokens(word_tokens_sql("content"), name="word")
ML_TOKS = _unnest_tokens(ml_tokens_sql("content"), name="term")
STREAM_TOKS = _unnest_tokens(stream_tokens_sql("text"), text="text", name="word")

TRIMMED = f"""{DOCS},
toks AS ({WORD_TOKS}),
wc AS (SELECT word, count(*) AS cnt FROM toks GROUP BY word),
vocab AS (SELECT word, cnt, CAST(r - 10 AS INTEGER) AS idx FROM (
  SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, word ASC) AS r FROM wc)
  WHERE r > 10 AND r <= 2000)"""

UNK_VOCAB = f"""{DOCS},
toks AS ({STREAM_TOKS}),
wc AS (SELECT word, count(*) AS cnt FROM toks GROUP BY word),
top AS (SELECT word, cnt, CAST(r AS INTEGER) AS idx FROM (
  SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, word ASC) AS r FROM wc) WHERE r <= 999),
vocab AS (SELECT word, cnt, idx FROM top UNION ALL
  SELECT 'UNK', CAST((SELECT sum(cnt) FROM wc) - coalesce((SELECT sum(cnt) FROM top), 0) AS BIGINT), 0)"""

EMB = ("emb AS (SELECT vec_id, label, CAST(unnest(range(len(embedding))) AS INTEGER) AS dim, "
       "CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)")

SEQ = f"""{TRIMMED},
enc AS (SELECT t.doc_id, t.pos, v.idx FROM toks t JOIN vocab v ON t.word = v.word),
seqs AS (SELECT doc_id, list(idx ORDER BY pos) AS l FROM enc GROUP BY doc_id)"""

TF = f"""{DOCS},
toks AS ({ML_TOKS}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY doc_id, term),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, df, ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1.0)) AS idf FROM dfq)"""

CENTROIDS = f"""{EMB},
cen AS (SELECT label, dim, avg(x) AS v FROM emb GROUP BY label, dim),
pairs AS (SELECT a.label AS cat1, b.label AS cat2, sum((a.v - b.v) * (a.v - b.v)) AS distance
  FROM cen a JOIN cen b ON a.dim = b.dim AND a.label < b.label GROUP BY a.label, b.label),
named AS (SELECT 'label' || cat1 AS name1, 'label' || cat2 AS name2, distance FROM pairs)"""

LABELS = [f"label{i}" for i in range(10)]


def _distance_matrix() -> str:
    cols = ",\n  ".join(
        f"coalesce(max(s.distance) FILTER (WHERE s.name2 = '{x}'), 0.0) AS {x}" for x in LABELS)
    return f"""WITH {CENTROIDS},
sd AS (SELECT name1, name2, {stable('distance')} AS distance FROM named),
s AS (SELECT name1, name2, distance FROM sd UNION ALL SELECT name2, name1, distance FROM sd),
names AS (SELECT DISTINCT 'label' || label AS name FROM embeddings)
SELECT n.name,
  {cols}
FROM names n LEFT JOIN s ON s.name1 = n.name GROUP BY n.name"""


def _category_distance_embedding() -> str:
    return f"""WITH {DOCS},
toks AS ({WORD_TOKS}),
wc AS (SELECT word, count(*) AS cnt FROM toks GROUP BY word),
vocab AS (SELECT word, CAST(r - 10 AS INTEGER) % (SELECT count(*) FROM embeddings) AS idx FROM (
  SELECT word, row_number() OVER (ORDER BY cnt DESC, word ASC) AS r FROM wc)
  WHERE r > 10 AND r <= 20000),
{EMB},
times AS (SELECT t.doc_id, v.idx, count(*) AS n FROM toks t JOIN vocab v ON t.word = v.word
          GROUP BY t.doc_id, v.idx),
dv AS (SELECT t.doc_id, e.dim, sum(e.x * t.n) AS v FROM times t
       JOIN emb e ON e.vec_id = t.idx GROUP BY t.doc_id, e.dim),
{MEM}, {KEEP},
cv AS (SELECT m.category, dv.dim, sum(dv.v) AS v FROM dv JOIN mem m ON m.doc_id = dv.doc_id
       WHERE m.category IN (SELECT category FROM keep) GROUP BY m.category, dv.dim)
SELECT a.category AS name1, b.category AS name2, {stable('sum((a.v - b.v) * (a.v - b.v))')} AS distance
FROM cv a JOIN cv b ON a.dim = b.dim AND a.category < b.category GROUP BY a.category, b.category"""


def _hashing_tf(n: int = 20) -> str:
    ctes, hashed = murmur_bucket_ctes("toks", "term", n)
    return f"""WITH {DOCS},
toks AS ({ML_TOKS}),{ctes}
SELECT t.doc_id AS article_id, h.bucket, CAST(count(*) AS DOUBLE) AS tf
FROM toks t JOIN {hashed} h ON t.term = h.term GROUP BY t.doc_id, h.bucket"""


def _rating_triples() -> str:
    return f"""WITH c1 AS ({_category_distance_tfidf()}),
{MEM},
dict AS (SELECT category, CAST(row_number() OVER (ORDER BY category) AS INTEGER) AS id
         FROM (SELECT DISTINCT category FROM mem))
SELECT coalesce(a.id, 0) AS "user", coalesce(b.id, 0) AS item, c1.distance AS rating
FROM c1 LEFT JOIN dict a ON a.category = c1.name1 LEFT JOIN dict b ON b.category = c1.name2"""


KEY_HASH = "('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT"


def hash_bound(fraction: float) -> int:
    """The end of a share of the 60-bit hash range."""
    return round(fraction * (1 << 60))


#: The part of each document: shares 0.8, 0.1 and 0.1 of the hash range.
SPLIT = (f"CASE WHEN {KEY_HASH} < {hash_bound(0.8)} THEN 0 "
         f"WHEN {KEY_HASH} < {hash_bound(0.8 + 0.1)} THEN 1 ELSE 2 END")

#: Labelled articles: (doc_id, label) for the categories of the filter list.
LABELLED = f"""{MEM}, {KEEP},
lab AS (SELECT category, CAST(row_number() OVER (ORDER BY category) AS INTEGER) AS label FROM keep),
labelled AS (SELECT DISTINCT m.doc_id, lab.label FROM mem m JOIN lab ON lab.category = m.category)"""

#: Kept categories that occur, and how many.
RATED = f"""{MEM}, {KEEP},
rated AS (SELECT DISTINCT category FROM mem WHERE category IN (SELECT category FROM keep)),
size AS (SELECT count(*) AS n, min(category) AS first, max(category) AS last FROM rated)"""


def _checked_recommendations(missing: str) -> str:
    """Every rated pair has its smaller name first, so one name is on no right (or left)
    side; the others each get up to five."""
    return f"""WITH {RATED}
SELECT category AS name, CAST(least(5, size.n - 1) AS INTEGER) AS n_recs,
  true AS ranked, true AS falling, true AS known
FROM rated, size WHERE category <> size.{missing}"""


def _explained_variance() -> str:
    """First eigenvalue of the centroids' Gram matrix by power iteration, over its trace."""
    return f"""WITH RECURSIVE {EMB},
cen AS (SELECT label, dim, avg(x) AS v FROM emb GROUP BY label, dim),
mid AS (SELECT c.label, c.dim, c.v - m.v AS v
        FROM cen c JOIN (SELECT dim, avg(v) AS v FROM cen GROUP BY dim) m ON m.dim = c.dim),
gram AS (SELECT a.label AS i, list(g ORDER BY b) AS row FROM (
           SELECT a.label, b.label AS b, sum(a.v * b.v) AS g
           FROM mid a JOIN mid b ON a.dim = b.dim GROUP BY a.label, b.label) a GROUP BY a.label),
mat AS (SELECT list(row ORDER BY i) AS m, list(CAST(1 + i * i AS DOUBLE) ORDER BY i) AS start FROM gram),
it AS (SELECT 0 AS k, start AS v, m FROM mat
       UNION ALL
       SELECT k + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))), m
       FROM (SELECT k, m, list_transform(m, lambda r: list_dot_product(r, v)) AS w FROM it)
       WHERE k < 2000),
top AS (SELECT v, m FROM it WHERE k = 2000)
SELECT (SELECT count(*) FROM gram) AS n,
  round(list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v)))
        / (SELECT sum(v * v) FROM mid), 5) AS explained_variance FROM top"""


def oracle_sql() -> dict[str, str]:
    word_count = f"WITH {DOCS}, toks AS ({WORD_TOKS}) SELECT word, count(*) AS cnt FROM toks GROUP BY word"
    return {
        "corpus_articles": f"SELECT doc_id AS article_id, {title_sql()} AS title, {content_sql()} AS content FROM documents",
        "corpus_file_roundtrip": f"WITH {DOCS} SELECT title, arg_max(content, doc_id) AS content FROM docs GROUP BY title",
        "title_normalize": f"WITH {DOCS} SELECT doc_id AS article_id, replace(title, ' ', '_') AS title FROM docs",
        "article_dictionary_roundtrip": f"""WITH {DOCS}
SELECT replace(title, ' ', '_') AS title, CAST(max(doc_id) AS INTEGER) AS article_id FROM docs GROUP BY 1""",
        "membership_file_roundtrip": f"""WITH {MEM},
dict AS (SELECT category, CAST(row_number() OVER (ORDER BY category) AS INTEGER) AS id
         FROM (SELECT DISTINCT category FROM mem))
SELECT CAST(m.doc_id AS INTEGER) AS article_id, d.id AS category_id FROM mem m JOIN dict d USING (category)""",
        "word_vectors_roundtrip": f"WITH {EMB} SELECT CAST(vec_id AS INTEGER) AS idx, dim, x AS value FROM emb",
        "membership_explode": f"WITH {MEM} SELECT doc_id AS article_id, category FROM mem",
        "dictionary_last_wins": """SELECT user_id,
  arg_max(event_type, row(ts, event_id)) AS event_type,
  arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY user_id""",
        "dense_category_labels": f"""WITH {MEM} SELECT category,
  CAST(row_number() OVER (ORDER BY category) AS INTEGER) AS label FROM (SELECT DISTINCT category FROM mem)""",
        "lookup_with_default": """SELECT d.doc_id, coalesce(l.quality, -1) AS quality
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
        "filter_categories": f"""WITH {MEM}, {KEEP}
SELECT doc_id AS article_id, category FROM mem WHERE category IN (SELECT category FROM keep)""",
        "labelled_articles": f"""WITH {MEM}, {KEEP},
lab AS (SELECT category, CAST(row_number() OVER (ORDER BY category) AS INTEGER) AS label FROM keep)
SELECT DISTINCT m.doc_id AS article_id, lab.label FROM mem m JOIN lab ON lab.category = m.category""",
        "tokenize_words": f"WITH {DOCS} SELECT doc_id AS article_id, pos, word AS token FROM ({WORD_TOKS})",
        "tokenize_whitespace": f"WITH {DOCS} SELECT doc_id AS article_id, pos, term AS token FROM ({ML_TOKS})",
        "word_count": word_count,
        "vocabulary_trimmed": f"WITH {TRIMMED} SELECT word, cnt, idx FROM vocab",
        "vocabulary_unk": f"WITH {UNK_VOCAB} SELECT word, cnt, idx FROM vocab",
        "unk_count": f"""WITH {UNK_VOCAB}
SELECT CAST(count(*) AS BIGINT) AS unk_count FROM toks t LEFT JOIN top v ON t.word = v.word WHERE v.word IS NULL""",
        "token_index_sequence": f"""WITH {SEQ}
SELECT doc_id AS article_id, array_to_string(l, ' ') AS seq FROM seqs""",
        "pad_or_truncate": f"""WITH {SEQ}
SELECT doc_id AS article_id, array_to_string(list_concat(list_slice(l, 1, 1000),
  list_transform(range(greatest(1000 - len(l), 0)), lambda x: 0)), ' ') AS seq FROM seqs""",
        "word_vector_lookup": f"""WITH {TRIMMED}, {EMB}
SELECT v.word, v.idx, e.dim, e.x AS value FROM vocab v JOIN emb e ON e.vec_id = v.idx""",
        "document_vector_sum": f"""WITH {TRIMMED}, {EMB}
SELECT t.doc_id AS article_id, e.dim, {stable('sum(e.x)')} AS value
FROM toks t JOIN vocab v ON t.word = v.word JOIN emb e ON e.vec_id = v.idx GROUP BY t.doc_id, e.dim""",
        "term_frequency": f"WITH {TF} SELECT doc_id AS article_id, term, tf FROM tf",
        "document_frequency": f"WITH {TF} SELECT term, df FROM dfq",
        "idf_weights": f"WITH {TF} SELECT term, df, {stable('idf')} AS idf FROM idf",
        "tfidf_exact": f"""WITH {TF}
SELECT tf.doc_id AS article_id, tf.term, {stable('tf.tf * idf.idf')} AS tfidf FROM tf JOIN idf ON tf.term = idf.term""",
        "hashing_tf": _hashing_tf(),
        "hashing_tf_sparse": _hashing_tf(1 << 18),
        "category_centroid_mean": f"WITH {EMB} SELECT label, dim, {stable('avg(x)')} AS value FROM emb GROUP BY label, dim",
        "category_centroid_sum": f"WITH {EMB} SELECT label, dim, {stable('sum(x)')} AS value FROM emb GROUP BY label, dim",
        "category_pair_distance": f"WITH {CENTROIDS} SELECT cat1, cat2, {stable('distance')} AS distance FROM pairs",
        "named_distances_sorted": f"""WITH {CENTROIDS}
SELECT CAST(row_number() OVER (ORDER BY distance, name1, name2) AS INTEGER) AS position,
  name1, name2, {stable('distance')} AS distance FROM named""",
        "category_distance_tfidf": _category_distance_tfidf(),
        "category_distance_embedding": _category_distance_embedding(),
        "blocked_pair_distance": f"""WITH {EMB}
SELECT a.vec_id AS id1, b.vec_id AS id2, {stable('sum((a.x - b.x) * (a.x - b.x))')} AS distance
FROM emb a JOIN emb b ON a.dim = b.dim AND a.vec_id < b.vec_id GROUP BY a.vec_id, b.vec_id""",
        "distance_matrix": f"""WITH {CENTROIDS}
SELECT name1, name2, {stable('distance')} AS distance FROM named
UNION ALL SELECT name2, name1, {stable('distance')} FROM named
UNION ALL SELECT DISTINCT 'label' || label, 'label' || label, 0.0 FROM embeddings""",
        "distance_matrix_wide": _distance_matrix(),
        "nearest_categories": f"""WITH {CENTROIDS},
s AS (SELECT name1, name2, distance FROM named UNION ALL SELECT name2, name1, distance FROM named),
r AS (SELECT name1, name2, distance,
      CAST(row_number() OVER (PARTITION BY name1 ORDER BY distance, name2) AS INTEGER) AS rank FROM s)
SELECT name1, name2, {stable('distance')} AS distance, rank FROM r WHERE rank <= 3""",
        "rating_triples": _rating_triples(),
        "l2_normalize": f"""WITH {EMB},
n AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM emb GROUP BY vec_id)
SELECT e.vec_id, e.dim, {stable('CASE WHEN n.norm = 0 THEN 0.0 ELSE e.x / n.norm END')} AS value
FROM emb e JOIN n ON n.vec_id = e.vec_id""",
        "embedding_text_rows": f"""WITH {EMB}
SELECT 'w' || vec_id || ' ' || string_agg(CAST(CAST(round(x * 1e6) AS BIGINT) AS VARCHAR), ' ' ORDER BY dim) AS line
FROM emb GROUP BY vec_id""",
        "skipgram_pairs": f"""WITH {DOCS},
t AS (SELECT doc_id, l, unnest(range(len(l))) AS i FROM (SELECT doc_id, {stream_tokens_sql('text')} AS l FROM docs))
SELECT doc_id AS article_id, CAST(i AS INTEGER) AS pos, l[i + 1] AS center, l[i + 1 + o] AS context
FROM t, (VALUES (-1), (1)) v(o) WHERE i + o >= 0 AND i + o < len(l)""",
        "hash_split": f"""SELECT doc_id AS article_id,
  CAST({SPLIT} AS INTEGER) AS split FROM documents""",
        "hash_sample": f"SELECT doc_id AS article_id FROM documents WHERE {KEY_HASH} < {hash_bound(0.2)}",
        "topk_accuracy": f"""WITH {EMB},
cen AS (SELECT label, dim, avg(x) AS v FROM emb GROUP BY label, dim),
d AS (SELECT e.vec_id, e.label AS true_label, c.label, sum((e.x - c.v) * (e.x - c.v)) AS dist
      FROM emb e JOIN cen c ON c.dim = e.dim GROUP BY e.vec_id, e.label, c.label),
r AS (SELECT vec_id, true_label, label,
      row_number() OVER (PARTITION BY vec_id ORDER BY dist ASC, label ASC) AS rk FROM d)
SELECT 5 AS k, {stable('avg(CASE WHEN rk <= 5 THEN 1.0 ELSE 0.0 END)')} AS accuracy, count(*) AS n
FROM r WHERE label = true_label""",
        "materialize_once": word_count,
        "corpus_title_join": f"""WITH {DOCS}, {LABELLED},
titles AS (SELECT title, replace(title, ' ', '_') AS key FROM docs GROUP BY title),
ids AS (SELECT replace(title, ' ', '_') AS key, max(doc_id) AS id FROM docs GROUP BY 1)
SELECT ids.id AS article_id, labelled.label FROM titles JOIN ids USING (key)
JOIN labelled ON labelled.doc_id = ids.id""",
        "vectorized_sequences": f"""WITH {SEQ}, {EMB},
pos AS (SELECT doc_id, unnest(list_slice(l, 1, 1000)) AS idx,
  unnest(range(1, least(len(l), 1000) + 1)) AS w FROM seqs),
dims AS (SELECT DISTINCT dim FROM emb),
sums AS (SELECT p.doc_id, e.dim, sum(p.w * e.x) AS v FROM pos p JOIN emb e ON e.vec_id = p.idx
         WHERE p.idx > 0 GROUP BY p.doc_id, e.dim)
SELECT s.doc_id AS article_id, CAST(500500 AS BIGINT) AS weights, d.dim,
  {stable('coalesce(t.v, 0.0)')} AS value
FROM seqs s, dims d LEFT JOIN sums t ON t.doc_id = s.doc_id AND t.dim = d.dim""",
        "skipgram_stream": f"""WITH {DOCS}, toks AS ({STREAM_TOKS}),
s AS (SELECT word, row_number() OVER (ORDER BY doc_id, pos) - 1 AS pos FROM toks),
n AS (SELECT word AS center, pos, lag(word) OVER w AS a, lead(word) OVER w AS b
      FROM s WINDOW w AS (ORDER BY pos))
SELECT pos, center, context FROM (
  SELECT pos, center, a AS context FROM n UNION ALL SELECT pos, center, b FROM n)
WHERE context IS NOT NULL""",
        "category_geometric_median": f"""WITH RECURSIVE {EMB},
cols AS (SELECT label, dim, list(x ORDER BY vec_id) AS col, avg(x) AS m FROM emb GROUP BY label, dim),
start AS (SELECT label, list(col ORDER BY dim) AS cols, list(m ORDER BY dim) AS m,
          any_value(len(col)) AS n, count(*) AS dims FROM cols GROUP BY label),
it AS (SELECT 0 AS k, label, cols, m, n, dims FROM start
       UNION ALL
       SELECT k + 1, label, cols, list_transform(range(1, dims + 1),
         lambda j: list_dot_product(w, cols[j]) / list_sum(w)), n, dims
       FROM (SELECT k, label, cols, n, dims, list_transform(range(1, n + 1), lambda i:
               1.0 / sqrt(list_sum(list_transform(range(1, dims + 1),
                 lambda j: (cols[j][i] - m[j]) * (cols[j][i] - m[j]))))) AS w FROM it WHERE k < 8))
SELECT label, CAST(unnest(range(dims)) AS INTEGER) AS dim, CAST(CAST(unnest(m) AS FLOAT) AS DOUBLE) AS value
FROM it WHERE k = 8""",
        "rejected_membership_lines": """WITH l AS (SELECT doc_id, text FROM documents)
SELECT 'read' AS kind, CAST(doc_id AS VARCHAR) AS line FROM l
WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND text IS NOT NULL
UNION ALL
SELECT 'rejected', concat_ws(' ', doc_id, CASE WHEN doc_id % 3 = 0 THEN 'x' END,
  CASE WHEN doc_id % 5 = 0 THEN '1.5' END, length(text)) FROM l
WHERE doc_id % 3 = 0 OR doc_id % 5 = 0""",
        "single_file_output": f"""WITH {MEM}
SELECT category, count(*) AS n, CAST(1 AS INTEGER) AS files FROM mem GROUP BY category""",
        "category_midrange": f"""WITH {EMB}
SELECT label, dim, {stable('(min(x) + max(x)) / 2')} AS value FROM emb GROUP BY label, dim""",
        "close_pairs_checked": f"""WITH {EMB}, p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM emb a JOIN emb b ON a.dim = b.dim AND a.vec_id < b.vec_id
  GROUP BY a.vec_id, b.vec_id HAVING sqrt(sum((a.x - b.x) * (a.x - b.x))) <= 1.15)
SELECT count(*) AS n, true AS recalled, true AS sound FROM p""",
        "nearest_vectors": f"""WITH {EMB}, p AS (
  SELECT a.vec_id AS id1, b.vec_id AS id2, sum((a.x - b.x) * (a.x - b.x)) AS distance
  FROM emb a JOIN emb b ON a.dim = b.dim AND a.vec_id <> b.vec_id GROUP BY a.vec_id, b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id1 ORDER BY distance, id2) AS INTEGER) AS rank FROM p)
SELECT id1, id2, {stable('distance')} AS distance, rank FROM r WHERE rank <= 3""",
        "centroid_csv_roundtrip": f"""WITH {EMB}
SELECT 'label' || label AS name, dim, {stable('avg(x)')} AS value FROM emb GROUP BY label, dim""",
        "category_files_roundtrip": f"""WITH {MEM}, {KEEP},
dict AS (SELECT category, CAST(row_number() OVER (ORDER BY category) AS INTEGER) AS id
         FROM (SELECT DISTINCT category FROM mem))
SELECT id AS category_id, category AS name FROM dict WHERE category IN (SELECT category FROM keep)""",
        "distance_csv_roundtrip": f"""WITH {CENTROIDS}
SELECT CAST(row_number() OVER (ORDER BY name1, name2) AS INTEGER) AS position,
  name1, name2, {stable('distance')} AS distance FROM named""",
        "reversed_dictionary": f"""WITH {MEM}
SELECT CAST(row_number() OVER (ORDER BY category) AS INTEGER) AS category_id, category AS name
FROM (SELECT DISTINCT category FROM mem)""",
        "recommend_users_for_items_checked": _checked_recommendations("first"),
        "recommend_items_for_users_checked": _checked_recommendations("last"),
        "recommendation_lines_checked": f"""WITH {RATED}
SELECT CAST((size.n - 1) * least(5, size.n - 1) AS BIGINT) AS n, true AS three_fields FROM size""",
        "classifier_predictions_checked": f"""WITH {LABELLED}
SELECT doc_id AS article_id, label, true AS known, true AS best, true AS probable
FROM labelled WHERE {SPLIT} = 2""",
        "classifier_topk_checked": f"""WITH {LABELLED}
SELECT 5 AS k, count(*) AS n, true AS beats_majority, true AS loss_fell,
  CAST(4 AS BIGINT) AS validated_epochs
FROM labelled WHERE {SPLIT} = 2""",
        "learned_embeddings_checked": f"""WITH {UNK_VOCAB.replace("r <= 999", "r <= 9999")},
counts AS (SELECT d.lang, t.word, count(*) AS n FROM toks t JOIN docs d ON d.doc_id = t.doc_id
           GROUP BY d.lang, t.word),
own AS (SELECT word, any_value(lang) AS lang FROM counts GROUP BY word
        HAVING count(*) = 1 AND sum(n) >= 100 AND any_value(lang) IS NOT NULL)
SELECT own.lang, count(*) AS words, true AS grouped,
  (SELECT count(*) FROM vocab WHERE cnt > 0) AS vocabulary, true AS "full"
FROM own JOIN vocab v ON v.word = own.word GROUP BY own.lang HAVING count(*) >= 10""",
        "pca_centroids_checked": _explained_variance(),
        "topk_accuracy_ranks": f"""WITH {EMB},
cen AS (SELECT label, dim, avg(x) AS v FROM emb GROUP BY label, dim),
d AS (SELECT e.vec_id, e.label AS true_label, c.label, sum((e.x - c.v) * (e.x - c.v)) AS dist
      FROM emb e JOIN cen c ON c.dim = e.dim GROUP BY e.vec_id, e.label, c.label),
r AS (SELECT vec_id, true_label, label,
      row_number() OVER (PARTITION BY vec_id ORDER BY dist ASC, label ASC) AS rk FROM d)
SELECT 5 AS k, {stable('avg(CASE WHEN rk <= 5 THEN 1.0 ELSE 0.0 END)')} AS accuracy, count(*) AS n
FROM r WHERE label = true_label""",
        "category_distance_tfidf_pipeline": _category_distance_tfidf(),
        "category_pair_cosine": f"""WITH {EMB},
cen AS (SELECT label, dim, avg(x) AS v FROM emb GROUP BY label, dim),
nrm AS (SELECT label, sqrt(sum(v * v)) AS n FROM cen GROUP BY label),
dots AS (SELECT a.label AS cat1, b.label AS cat2, sum(a.v * b.v) AS dot
         FROM cen a JOIN cen b ON a.dim = b.dim AND a.label < b.label GROUP BY a.label, b.label)
SELECT cat1, cat2, {stable('CASE WHEN n1.n * n2.n = 0 THEN 1.0 ELSE 1.0 - dot / (n1.n * n2.n) END')} AS distance
FROM dots JOIN nrm n1 ON n1.label = cat1 JOIN nrm n2 ON n2.label = cat2""",
        "document_vector_mean": f"""WITH {TRIMMED}, {EMB}
SELECT t.doc_id AS article_id, e.dim, {stable('avg(e.x)')} AS value
FROM toks t JOIN vocab v ON t.word = v.word JOIN emb e ON e.vec_id = v.idx GROUP BY t.doc_id, e.dim""",
    }

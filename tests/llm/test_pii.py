import re

from pyspark.sql import functions as F
from topicspace.llm import pii
from topicspace.llm.pii import assign_surrogates, op3_pii_surrogates, replace_pii

LUHN_OK = "4539148803436467"


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def texts(spark, values, **kw):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id int, text string")
    return [r.text for r in replace_pii(df, **kw).orderBy("doc_id").collect()]


def test_every_type_keeps_its_format(spark):
    mail, phone, ip, card = "und.34@mail7.example.com", "+1 (017) 555-7713", "97.51.17.173", LUHN_OK
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    line = f'A {mail} b {phone} c {ip}*** d {card[:4]} {card[4:8]} {card[8:12]} {card[12:]}, token = "{secret}"### end'
    again = f"{card} and {mail.upper()} or {phone.replace(' ', '')}."
    one, two = texts(spark, [line, again])
    for value in (mail, phone, ip, secret, card):
        assert value not in one and value not in two
    m = re.fullmatch(r'A (\w+\.\d\d@\w+\.\w+\.example) b (\+1 \(\d{3}\) \d{3}-\d{4}) c '
                     r'((?:\d+\.){3}\d+)\*\*\* d (\d{4} \d{4} \d{4} \d{4}), token = "([0-9a-f]{40})"### end', one)
    assert m and luhn(m[4]) and all(0 <= int(x) <= 255 for x in m[3].split("."))
    assert two == f"{m[4].replace(' ', '')} and {m[1].upper()} or {m[2].replace(' ', '')}."


def test_clean_texts_stay(spark):
    clean = ["No 4539148803436468 card, no 300.1.2.3 address, 12.5 and 2024-10-12.",
             "version 1.2.3 of token rings; a@b; Mr smith; 1,000,000", "", None, "  x\n\n y\t"]
    assert texts(spark, clean) == clean


def test_names_by_gender_script_and_coreference(spark):
    a, b, c = texts(spark, ["Mr. John Smith met Mrs. Anna Smith. Later Smith left; SMITHY stayed.",
                            "Dr. Smith wrote to Mr. John Brown", "Господин Иванов и г-жа Иванов"])
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+)\. Later (\w+) left; SMITHY stayed\.", a)
    assert m and m[2] == m[4] == m[5] != "Smith"
    assert m[1] in pii.NAMES["given_m_latin"] and m[3] in pii.NAMES["given_f_latin"]
    n = re.fullmatch(r"Dr\. (\w+) wrote to Mr\. (\w+) (\w+)", b)
    assert n[1] == m[2] and n[2] == m[1] and n[3] not in (m[2], "Brown")
    k = re.fullmatch(r"Господин (\w+) и г-жа (\w+)", c)
    assert k[1] == k[2] in pii.NAMES["family_cyrillic"]


def test_more_names_than_the_lists_hold(spark):
    rows = [("family_latin", f"name{chr(97 + i // 26)}{chr(97 + i % 26)}") for i in range(120)]
    rows += [("family_latin", "becker"), ("ip", "1.2.3.4")]
    got = assign_surrogates(spark.createDataFrame(rows, "type string, norm string")).collect()
    assert len(got) == len(rows)
    news = {(r.type, r.new) for r in got}
    assert len(news) == len(rows) and not news & set(rows)


def test_other_columns_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, "mail x.1@mail2.example.com", "k")] * 2 + [(None, None, None)],
                               "doc_id int, text string, norm string")
    out = replace_pii(df, entities="n").collect()
    assert [r.n for r in out if r.text] == [1, 1] and len({r.text for r in out if r.text}) == 1
    assert [r.n for r in out if r.text is None] == [0] and all(r.norm == "k" for r in out if r.text)


def test_main_path_is_native(spark, table, doc_rows):
    df = op3_pii_surrogates(spark, table([*doc_rows, (900, "ip 9.8.7.6", "en", "s", 10)]))
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    rows = {r.doc_id: r for r in df.collect()}
    assert len(rows) == len(doc_rows) + 1 and rows[900].n_replaced == 1
    assert all(rows[r[0]].text == r[1] for r in doc_rows)
    assert op3_pii_surrogates(spark, table([])).count() == 0


def test_units_join_to_the_text(spark):
    text = "x 9.8.7.6 Mr. A B y z.1@q.example.org, w"
    df = spark.createDataFrame([(text,)], "text string").select(pii.find_units(F.col("text")).alias("u"))
    assert "".join(u["raw"] for u in df.first().u) == text


def test_usual_phone_numbers(spark):
    numbers = ["+33 6 12 34 56 78", "+33612345678", "06 12 34 56 78", "0612345678", "06.12.34.56.78", "06\u00a012\u00a034\u00a056\u00a078", "030 1234567",
               
               "030/1234567", "(030) 1234567", "0151 23456789", "91 123 45 67", "612 34 56 78", "555 123 4567",
               "1-555-123-4567", "+49 (0)30 1234567", "+49 151 23456789", "+44 20 7946 0958", "+34 612 345 678"]
    for number, text in zip(numbers, texts(spark, [f"Call {n}, now" for n in numbers])):
        shape = "".join(r"\d" if c.isdigit() else re.escape(c) for c in number)
        assert re.fullmatch(f"Call {shape}, now", text) and number not in text, (number, text)
    clean = ["on 01.02.2024 10:30 and 2024-10-12", "in 1990 2000 2010", "pages 100 200 300", "1 000 000 and 0.12345678",
             "EUR 1.234.567.890,12"]
    assert texts(spark, clean) == clean


def test_usual_secrets(spark):
    held = [("password: ", "hunter2", ". Bye"), ('password = "', "correcthorsebattery", '" ok'),
            ('secret = "', "p@ssw0rd!2024xyz", '";'), ("token: Bearer ", "abc123def", " x"), ("passwd='", "a b c", "'."),
            ("API_KEY=", "Abcdef123456!xyz", "\nnext"), ("token=", "04dbebab91ab85687d33", "$$$ end"),
            ('{"password": "', "x", '"}')]
    for (head, value, tail), text in zip(held, texts(spark, ["".join(h) for h in held])):
        assert text.startswith(head) and text.endswith(tail) and text != head + value + tail, text
        assert len(text) == len(head + value + tail)
    clean = ['password = "***"', "the token was lost", "secret: ...", "password="]
    assert texts(spark, clean) == clean


def test_small_shapes_do_not_run_out(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [("email", f"{a}@{b}.{c}") for a in letters for b in letters for c in ("com", "de")]
    rows += [("secret", c) for c in letters + "0123456789"]
    rows += [("given_x_cyrillic", f"имя{i}") for i in range(12_000)]
    got = assign_surrogates(spark.createDataFrame(rows, "type string, norm string")).collect()
    news = {(r.type, r.new) for r in got}
    assert len(got) == len(rows) == len(news) and not news & set(rows)
    assert all(re.fullmatch(r"[a-z]+@[a-z]\.example", r.new) for r in got if r.type == "email")


def test_patterns_on_long_repeats(spark):
    """No pattern recurses or backtracks along a long text."""
    import time
    n = 4_000
    texts = ["x@" + "a." * n + "com", "a" * n + "@" + "b" * n, "+1" + " 22" * n, "1" * n, "1.1." * n,
             "Mr A" + " Bb" * n, "password=" * n, 'secret="' * n, "token: '" + "k" * n, "0 12" * n,
             "x@a.b " * n, "(0" * n, "a.b-c_d" * n + "@", "Mr. " * n]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    start = time.time()
    units = {r.doc_id: r.u for r in docs.select("doc_id", F.size(pii.find_units(F.col("text")))
                                                .alias("u")).collect()}
    assert time.time() - start < 120 and len(units) == len(texts)
    # an email with so many labels is one entity, replaced as a whole
    got = replace_pii(docs.where("doc_id = 0"), entities="n").first()
    assert got.n == 1 and got.text.endswith(".example")


def test_full_shapes_get_longer_surrogates(spark):
    """More entities than their shape has room for all get different replacements."""
    from pyspark.sql import functions as F
    from topicspace.llm.pii import assign_surrogates
    ents = spark.range(0, 1000).select(F.lit("ssn").alias("type"), F.concat(
        F.lit("90000"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("norm"))
    got = assign_surrogates(ents.unionByName(spark.range(0, 12).select(
        F.lit("phone").alias("type"), F.col("id").cast("string").alias("norm")))).collect()
    assert len(got) == 1012 and len({(r.type, r.new) for r in got}) == 1012
    assert not {r.new for r in got} & {r.norm for r in got}

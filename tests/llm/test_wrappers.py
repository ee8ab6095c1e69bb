from topicspace.llm.wrappers import (align, expression, extract_main_text, infer_wrappers, main_of, op6_wrapper_extraction,
                                     parse, stream)
from pyspark.sql.types import LongType, StringType, StructField, StructType

PAGES = StructType([StructField("page_id", LongType()), StructField("url", StringType()),
                    StructField("html", StringType())])


def page(blocks, extra="", close="</body></html>"):
    return ("<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{x:1}</style>"
            "<script>var t=\"</p>\";go(1<2);</script></head><body><nav><ul><li><a href=\"/a\">Menu</a></li>"
            "<li><a href='/b'>B</a></li></ul></nav><!-- ad > 1 --><div class=\"ad\">Buy <b>now</b></div>"
            f"<article><h1>Head</h1>{blocks}</article>{extra}<footer>&copy; x &middot; y.\nz</footer>{close}")


CASES = {
    1: (page("<p>One &lt;b&gt; two\n  three</p><p>Four</p>"), "Head\n\nOne <b> two three\n\nFour"),
    2: (page("<p><b>Open one.<br><p>Five &amp; six<p>Seven <i>eight</i>nine</p>"),
        "Head\n\nOpen one.\n\nFive & six\n\nSeven eightnine"),
    3: (page("<p>A</p><form><input name=q>Search</form><ul><li>x<li>y</ul><aside>Side</aside>",
             "<div id=\"comments\"><p>Reader says</p></div>", ""), "Head\n\nA\n\nx\n\ny"),
    4: (page("<p>Q</p><div class='cookie-notice'>We use</div><table><tr><td>1<td>2</table>"), "Head\n\nQ\n\n1\n\n2"),
    5: (None, ""), 6: ("", ""), 7: ("just < text & more", ""), 8: ("<html><body><nav>m</nav>", ""),
    9: (page("<p>Cut off <b>in the mid")[:-60], None),
}


def test_op6_against_the_known_texts(spark, table):
    rows = [(i, "https://u@News.example.org:80/a/%d" % i, h) for i, (h, _) in CASES.items()]
    rows += [(1, "https://news.example.org/a/1", CASES[1][0])]
    got = op6_wrapper_extraction(spark, table(rows, PAGES, "pages")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = CASES[r.page_id][1]
        if want is not None:
            assert r.text == want, r.page_id
        assert r.n_chars == len(r.text)
    assert op6_wrapper_extraction(spark, table([], PAGES, "pages")).count() == 0


def test_a_wrapper_has_groups_for_what_differs():
    a = stream(parse("<div><h1>A</h1><p>x</p><p>y</p><hr><div class=ad>z</div></div>"))
    b = stream(parse("<div><h1>B</h1><p>x</p><ul><li>1</li><li>2</li></ul></div>"))
    assert expression(align(a, b)) == ("<div><h1>(.*)</h1>(?:<p>(.*)</p>)+(?:<div.ad>(.*)</div>)?"
                                       "(?:<ul>(?:<li>(.*)</li>)+</ul>)?</div>")
    dl = stream(parse("<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd><dt>e</dt><dd>f</dd></dl>"))
    assert expression(dl) == "<dl>(?:(?:<dt>(.*)</dt><dd>(.*)</dd>))+</dl>"
    assert expression(align(a, a)) == expression(a)


def test_hosts_without_an_article(spark):
    rows = [(i, "http://h.example/x", f"<body><div class='menu'>m</div><div class='post-content'><p>Text {i}</p></div>"
             "<div>Other</div></body>") for i in range(3)]
    rows += [(9, "http://plain.example/", "<body><h1>T</h1><p>Only this</p><footer>f</footer></body>"),
             (10, None, "<body><p>no address</p></body>")]
    df = spark.createDataFrame(rows, PAGES)
    got = {r.page_id: r.text for r in extract_main_text(df).collect()}
    assert got == {0: "Text 0", 1: "Text 1", 2: "Text 2", 9: "T\n\nOnly this", 10: "no address"}
    hosts = {r.host: r.stream for r in infer_wrappers(df).collect()}
    assert set(hosts) == {"h.example", "plain.example", ""}


def test_one_wrapper_for_all_pages_of_a_host():
    streams = [stream(parse(h)) for h, _ in CASES.values() if h]
    wrapper = streams[0]
    for s in streams[1:]:
        wrapper = align(wrapper, s)
    assert main_of(wrapper) == "tag"
    for s in streams:
        assert align(wrapper, s) == wrapper, expression(s)


def texts(spark, rows):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], PAGES)
    return [r.text for r in extract_main_text(df).orderBy("page_id").collect()]


def test_template_text_is_no_main_text(spark):
    one = "<body><div><h1>Day {0}</h1><p>Text {0}</p><p>Read more on our site</p></div><div>Made by us</div></body>"
    two = "<body><article><p>Text {0}</p><p>All rights</p></article></body>"
    rows = [("http://a.example/", one.format(i)) for i in range(8)]
    rows += [("http://b.example/", two.format(i)) for i in range(8)]
    rows += [("http://c.example/", two.format(0))] * 9  # copies are no template
    rows += [("http://d.example/", two.format(i)) for i in range(2)]  # too few to tell
    got = texts(spark, rows)
    assert got[:8] == [f"Day {i}\n\nText {i}" for i in range(8)]
    assert got[8:16] == [f"Text {i}" for i in range(8)]
    assert got[16:25] == ["Text 0\n\nAll rights"] * 9
    assert got[25:] == [f"Text {i}\n\nAll rights" for i in range(2)]


def test_main_part_of_each_page(spark):
    own = "A text of this page that is much longer than any teaser"
    rows = [("http://a.example/1", f"<body><article><p>{own} 1</p></article></body>"),
            ("http://a.example/2", f"<body><div class=content><p>{own} 2</p></div><div>x</div></body>"),
            ("http://a.example/3", f"<body><p>{own} 3</p></body>"),
            ("http://a.example/4", f"<body><div class=content><p>{own} 4</p><article>Teaser</article></div></body>"),
            (None, f"<body><article>{own} 5</article></body>"), (None, f"<body><p>{own} 6</p></body>")]
    assert texts(spark, rows) == [f"{own} {i}" if i != 4 else f"{own} 4\n\nTeaser" for i in range(1, 7)]


def test_side_words_on_what_holds_the_page(spark):
    own = "A text of this page that is much longer than its notice"
    pages = ["<body class='no-sidebar'><article><p>{}</p></article></body>",
             "<body><div id='search-page'><div class=notice>n</div><p>{}</p></div></body>",
             "<body><main class='has-banner'><p>{}</p><div class=ad>Buy</div></main></body>",
             "<body><article class='share-enabled'><p>{}</p></article></body>",
             "<body><form id=aspnet><p>{}</p></form></body>",
             "<body><article><p>{}</p></article><div id=comments>" + own * 9 + "</div></body>"]
    assert texts(spark, [(f"http://{i}.example/", p.format(own)) for i, p in enumerate(pages)]) == [own] * 6

from glyphstream.llm import extract


def test_a_slot_of_one_page_is_no_template(spark):
    """A block that one page of a host has, and a lone page of another layout, are content."""
    page = lambda i: f"<body><div><p>Site of things</p></div><section><p>story {i}</p></section></body>"
    rows = [(i, f"http://h.net/{i}", page(i)) for i in range(40)]
    rows += [(50, "http://h.net/50", page(50).replace("</section>", "<blockquote>said once</blockquote></section>"))]
    rows += [(51, "http://h.net/51", "<body><table><tr><td>a lone layout</td></tr></table></body>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract.extract(d).collect()}
    assert got[5] == "story 5" and got[50] == "story 50\n\nsaid once" and got[51] == "a lone layout"
    assert {r.page_id: r.text for r in extract.extract(d.repartition(7)).collect()} == got


def test_attributes_are_read_by_name():
    kept = ['style="overflow:hidden"', 'title="hidden gems"', 'data-hidden="false"', 'data-role="search"', "href=/c?id=ad", 'class="layout no-sidebar"', "class=has-sidebar", "data-x='class=ad'"]
    for a in kept:
        assert [t for _, t, _ in extract.parse(f"<div {a}><p>text</p></div>")[1]] == ["text"], a
    for a in ["hidden", "HIDDEN=''", "role=search", "data-x=1 id=main-ad", 'class="wide sidebar"', 'class="no-margin sidebar"', "aria-hidden='true'", 'title="a"class="ad"']:
        assert extract.parse(f"<div {a}><p>text</p></div>")[1] == [], a

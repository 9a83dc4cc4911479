"""Wrappers decide the blocks of every page, by tag or not."""

from sparkloom.llm import wrapper


def induced(pages):
    w = None
    for p in pages:
        s = wrapper.skeleton(wrapper.parse(p))
        w = wrapper.merge(w, s) if w else s
    return w


def test_template_in_an_article_is_removed():
    pages = [f"<body><article><h1>T {i}</h1><p>text {i}</p><p>more {i * i}</p><p>Send this to friends</p></article><footer>f</footer></body>" for i in range(4)]
    assert wrapper.extract(pages[2], induced(pages)) == "T 2\n\ntext 2\n\nmore 4"
    # Copies of a page are one page, and two pages are not enough.
    assert wrapper.extract(pages[2], induced([pages[1], *pages[1:3] * 3])).endswith("Send this to friends")
    assert wrapper.extract(pages[2], induced([pages[2]] * 5)).startswith("T 2\n\ntext 2")


def test_slots_decide_where_the_article_is():
    pages = [f"<body><article><p>Always the same teaser</p></article><div class=x><h2>h {i}</h2><p>text {i} goes on</p></div><div class=comments><p>{'c' * 99 * i}</p></div></body>" for i in range(4)]
    assert wrapper.extract(pages[3], induced(pages)) == "h 3\n\ntext 3 goes on"


def test_hosts_are_the_same_on_both_paths(spark):
    pages = spark.createDataFrame([(i, u, f"<body><div><p>always here</p></div><div><p>text {i}</p><p>more {i * i}</p></div></body>") for i, u in enumerate(["//a.b/x", "//a.b/y", "//u@A.B:80/z", "//a.b/w"])], "page_id long, url string, html string")
    want = [(i, f"text {i}\n\nmore {i * i}") for i in range(4)]
    for limit in (0, 32 << 20):
        assert sorted((r.page_id, r.text) for r in wrapper.main_text(pages, broadcast_bytes=limit).collect()) == want


def test_what_stands_deep_is_judged_as_elsewhere():
    for depth in (5, 195, 199, 200, 201, 250, 3000):
        inside = "<p>one <b>two</b> three<br>four</p>tail <div class=advert>buy <p>now</p> more</div><section>five<p>six</p>seven <i>eight</i></section> end"
        page = "<div>" * depth + inside + "</div>" * depth + "<p>after</p>"
        assert wrapper.extract(page, None) == "one two three four\n\ntail\n\nfive\n\nsix\n\nseven eight\n\nend\n\nafter", depth

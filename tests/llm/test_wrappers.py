import pytest

from corrag.llm.pagetree import Page, aligned, match_trees
from corrag.llm.wrappers import extract_host, extract_pages

SHELL = """<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Menu {i}</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="wrap"><div class="main-col">{article}</div><div class="sidebar"><p>Hot {i}</p></div></div><div id="comments"><p>reader {i}</p></div>
<form><p>Sign up</p></form><!-- ad --><div class="ad">Buy {i}</div><footer>&copy; Site</footer></body></html>"""


def page(i, body, tag="article"):
    return SHELL.format(i=i, article=f"<{tag}>{body}</{tag}>" if tag else body)


def test_article_without_its_surroundings():
    body = "<h1>Head &amp; more</h1><p><b>one\n two&nbsp;three<br>four<p>five <i>six</i></p><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>"
    assert extract_host([page(1, body)]) == ["Head & more\n\none two three four\n\nfive six\n\na\n\nb\n\nc d"]


def test_pages_without_an_article_element_use_what_varies():
    bodies = [f"<h2>Title {i}</h2><p>Long text number {i} {'word ' * (20 + i)}</p><p>More {i} {'x' * i}</p><p>Subscribe to us today</p>" for i in range(12)]
    texts = extract_host([page(i, b, tag=None) for i, b in enumerate(bodies)])
    for i, text in enumerate(texts):
        assert text == f"Title {i}\n\nLong text number {i} {('word ' * (20 + i)).strip()}\n\nMore {i} {'x' * i}".strip()


def test_copies_and_versions_of_one_article_stay_whole():
    body = "<h1>Same</h1>" + "".join(f"<p>paragraph {k} of the article</p>" for k in range(6))
    want = "Same\n\n" + "\n\n".join(f"paragraph {k} of the article" for k in range(6))
    assert extract_host([page(7, body)] * 20) == [want] * 20
    versions = [page(i, body + f"<p>edit {i}</p>") for i in range(20)]
    assert extract_host(versions) == [f"{want}\n\nedit {i}" for i in range(20)]


def test_broken_markup_loses_no_text():
    deep = "<article>" + "<div><span>" * 5000 + "deep" + "<p>after</article>"
    assert extract_host([deep, None, "", "<p", "plain & simple", "a < b <article>c<p>d", "<article><p>x</article"]) == [
        "deep\n\nafter", "", "", "<p", "plain & simple", "c\n\nd", "x</article"]


def test_table_of_pages(spark):
    rows = [(i, "http://Host.example/a" if i % 2 else None, page(i, f"<p>text {i}</p>"), "x") for i in range(6)]
    frame = spark.createDataFrame(rows + rows[:1] + [(9, "odd", None, None)], "page_id long, url string, html string, text string")
    found = sorted((r.page_id, r.url, r.text, r.n_chars) for r in extract_pages(frame).collect() if r.url)
    assert found == [(1, rows[1][1], "text 1", 6), (3, rows[1][1], "text 3", 6), (5, rows[1][1], "text 5", 6), (9, "odd", "", 0)]
    assert extract_pages(frame).count() == 8 and extract_pages(frame.limit(0)).count() == 0


def test_tree_matching_is_the_largest_ordered_match():
    a = Page("<div><p>1</p><ul><li>x</li><li>y</li></ul><p>2</p></div>").nodes[0]
    b = Page("<div><ul><li>x</li></ul><h2>h</h2><p>2</p></div>").nodes[0]
    assert match_trees(a, b)[0] == 5  # root, div, ul, li, p
    assert len(aligned(a, b)) == 5


def test_a_name_inside_the_article_does_not_drop_text():
    body = ('<section id="related-work"><h2 id="search">Search</h2><p id="notice-of-meeting">Meeting</p></section>'
            '<p title="the hidden door">Door</p><div class="notice">Dear reader {i}</div><p hidden>Gone</p>')
    for shell in ('<div class="content-sidebar-wrap">{}</div>', '<div class="no-sidebar">{}</div>', '<div class="widget">{}</div>'):
        pages = [page(i, shell.format("<article>" + body.format(i=i) + "</article>"), tag=None) for i in range(3)]
        assert extract_host(pages) == [f"Search\n\nMeeting\n\nDoor\n\nDear reader {i}" for i in range(3)]


def test_a_constant_name_inside_the_article_goes():
    pages = [page(i, f"<p>Text {i} {'word ' * (20 + i)}</p><div class='promo'>Subscribe</div>") for i in range(12)]
    assert extract_host(pages) == [f"Text {i} {'word ' * (20 + i)}".strip() for i in range(12)]


def test_no_text_goes_behind_drawings_and_formulas():
    bodies = {
        '<p>a <svg viewBox="0 0 1 1"/> b<p>c': "a b\n\nc",
        "<p>a <svg><text>t</text></svg> b<p>c": "a b\n\nc",
        "<p>a <svg><path d=1><p>b<p>c <svg></svg>d": "a\n\nb\n\nc d",
        "<div>a<svg></div><p>b</p><p>c</svg>": "a\n\nb\n\nc",
        "<p>a <math/> b <math><mi>x</mi><annotation>\\x</annotation></math> c": "a b x c",
        "<p>a <object data=o><p>b<template><p>c": "a\n\nb\n\nc",
        "<div>a<template><p>t</p></template><iframe src=x /> b<noscript><img></noscript></div><iframe>c": "a b\n\nc",
        "a<script src=x /><p>b<script>t</script>": "a\n\nb",
    }
    for body, text in bodies.items():
        assert extract_host([f"<article>{body}</article>"]) == [text], body


def test_sibling_articles_and_a_body_beside_a_teaser():
    words = [f"Part {k} of {{i}} {'word ' * 9}".strip() for k in range(3)]
    several = [page(i, "".join(f"<article><p>{w.format(i=i)}</p></article>" for w in words), tag=None) for i in range(12)]
    assert extract_host(several) == ["\n\n".join(w.format(i=i) for w in words) for i in range(12)]
    assert extract_host(several[:1]) == ["\n\n".join(w.format(i=0) for w in words)]
    body = "<article><p>Read {i}</p></article><div class='text'><p>Body {i}</p><p>" + "long text " * 40 + "{i}</p></div>"
    want = ["Body {i}\n\n".format(i=i) + "long text " * 40 + str(i) for i in range(12)]
    assert extract_host([page(i, body.format(i=i), tag=None) for i in range(12)]) == want
    assert want[0] in extract_host([page(0, body.format(i=0), tag=None)])[0]


def test_long_lists_and_deep_trees_are_matched_exactly():
    long = Page("<ul>" + "<li>a</li><p>b</p>" * 300 + "<h2>new</h2>" + "<li>a</li><p>b</p>" * 300 + "</ul>").nodes[0]
    other = Page("<ul>" + "<li>a</li><p>b</p>" * 600 + "</ul>").nodes[0]
    assert match_trees(long, other)[0] == 1202
    deep = [Page("<div>" * 3000 + f"{x}<p>leaf</p>").nodes[0] for x in ("", "<h2>x</h2>")]
    assert match_trees(*deep)[0] == 3002 and len(aligned(*deep)) == 3002


def test_matching_equals_the_plain_recursion():
    import random

    def plain(a, b):
        if a.sign != b.sign:
            return 0
        table = [[0] * (len(b.children) + 1)]
        for u in a.children:
            row = [0]
            for j, v in enumerate(b.children):
                w = plain(u, v)
                row.append(max(table[-1][j] + w if w else 0, table[-1][j + 1], row[j]))
            table.append(row)
        return 1 + table[-1][-1]

    rng = random.Random(3)

    def some(depth):
        return "".join(f"<{t}>{some(depth - 1) if depth else 'x'}</{t}>" for t in rng.choices(["div", "ul", "section"], k=rng.randint(0, 4)))

    for _ in range(200):
        a, b = (Page(some(3)).nodes[0] for _ in range(2))
        size, pairs = match_trees(a, b)
        assert size == plain(a, b) == len(pairs) and all(u.sign == v.sign for u, v in pairs)
        assert all((u.index < x.index) == (v.index < y.index) for u, v in pairs for x, y in pairs if u is not x)


def test_constants_of_a_second_layout_and_of_places_missing_on_the_median_page():
    def one(i, notice=True):
        lead = "<aside></aside><div class='lead'><blockquote>Please read our terms</blockquote></div>" if notice else ""
        return f"<body><div class='a'>{lead}<p>First {i} {'word ' * (20 + i % 7)}</p></div></body>"

    def two(i):
        return (f"<body><table class='t'><tr><td><div class='b'><h3>Constant head</h3><p>Second {i} {'word ' * (20 + i)}</p>"
                "<h4>Constant end</h4></div></td></tr></table></body>")

    def text(start, n):
        return f"{start} {'word ' * n}".strip()

    pages = [one(i) for i in range(30)] + [two(i) for i in range(10)]
    assert extract_host(pages) == [text(f"First {i}", 20 + i % 7) for i in range(30)] + [text(f"Second {i}", 20 + i) for i in range(10)]
    # The larger half of the pages lacks some nodes, so the median page does.
    mixed = [one(i, i % 2 == 0).replace("<p>First", "<p>x</p>" * (0 if i % 2 == 0 else 5) + "<p>First") for i in range(31)]
    assert not any("terms" in t for t in extract_host(mixed))


NAMES = ("comments", "comments-area", "comment-list", "sidebar", "related-posts", "share-buttons", "ad-slot", "widget-area",
         "cookie-bar", "advert", "newsletter-box", "discussion", "reply-list")


def prose(seed, n):
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


def furniture(name, i, entries=8, words=25):
    parts = "".join(f'<div class="entry"><h4>{prose(f"{name}{i}{k}", 2)}</h4><p>{prose(f"{i}{name}{k}", words)}</p></div>' for k in range(entries))
    return f'<div class="{name}">{parts}</div>'


@pytest.mark.parametrize("pages", [20, 3])
@pytest.mark.parametrize("name", NAMES)
def test_furniture_goes_inside_and_beside_the_article_however_long(name, pages):
    inner = [f"<h1>{prose(i, 4)}</h1><p>{prose(-i, 35)}</p>" for i in range(pages)]
    want = [f"{prose(i, 4)}\n\n{prose(-i, 35)}" for i in range(pages)]
    for shell in ("<article>{0}</article>{1}", "<article>{0}{1}</article>", '<div class="content">{0}{1}</div>',
                  '<div class="content">{0}</div>{1}', "<main><article>{0}</article>{1}</main>"):
        made = [f"<html><body><nav>Menu</nav>{shell.format(a, furniture(name, i, 4 + i % 5))}<footer>f</footer></body></html>"
                for i, a in enumerate(inner)]
        assert extract_host(made) == want, shell


def test_an_unnamed_list_beside_a_headed_article_does_not_win():
    made = [f"<body><article><h1>{prose(i, 4)}</h1><p>{prose(-i, 35)}</p></article>{furniture('talk', i)}</body>" for i in range(20)]
    assert extract_host(made) == [f"{prose(i, 4)}\n\n{prose(-i, 35)}" for i in range(20)]


@pytest.mark.parametrize("words", [160, 80, 40, 20])
def test_a_legal_notice_goes_whatever_the_length_of_the_article(words):
    legal = f"<p>{prose('legal', 40)}</p>"
    made = [f"<body><article><h1>{prose(i, 4)}</h1><p>{prose(-i, words)}</p>{legal}</article></body>" for i in range(20)]
    assert extract_host(made) == [f"{prose(i, 4)}\n\n{prose(-i, words)}" for i in range(20)]


def test_notices_of_prose_and_odd_names_stay_in_the_article():
    body = ('<h1>{0}</h1><div class="notice"><p>{1}</p></div><div class="no-sidebar"><p>{2}</p></div><p class="search">{3}</p>'
            '<section id="comments"><h2>{4}</h2></section><div class="commentary"><p>{5}</p></div>')
    parts = [[prose(f"{i}/{k}", 12) for k in range(6)] for i in range(12)]
    made = [f"<body><article>{body.format(*p)}</article></body>" for p in parts]
    assert extract_host(made) == ["\n\n".join(p) for p in parts]


def test_chunks_are_bounded_by_bytes_and_null_ids_are_spread(spark, monkeypatch):
    from corrag.llm import wrappers

    monkeypatch.setattr(wrappers, "CHUNK_BYTES", 8000)
    rows = [(None, "http://h.example/a", page(i, f"<h1>{prose(i, 3)}</h1><p>{prose(-i, 60)}</p>"), None) for i in range(60)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, extra string")
    dealt = wrappers.dealt_pages(frame).groupBy("_host", "_chunk").agg({"html": "count"}).collect()
    assert len(dealt) >= 4 and max(r[2] for r in dealt) <= 20
    found = sorted(r.text for r in extract_pages(frame).collect())
    assert found == sorted(f"{prose(i, 3)}\n\n{prose(-i, 60)}" for i in range(60))

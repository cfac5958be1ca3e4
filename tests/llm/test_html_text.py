from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm.html_text import extract_pages, main_text, smooth, threshold

PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">Cookies!</div>
<article><header><h1>Head &amp; line</h1></header><p>First <b>bold</b>&nbsp;text<br>goes   on<p>Short.<div class="ad">Buy</div>
<ul><li>one<li>two</ul><form>Mail <input></form><!-- hidden --><blockquote>Said &#x41;</blockquote></article>
<aside>Aside</aside><section class="comments"><p>Nice post</p></section><footer>Foot</footer></body></html>"""


def test_article():
    assert main_text(PAGE) == "Head & line\nFirst bold text goes on\nShort.\none\ntwo\nSaid A"


def test_without_article():
    page = "<body><nav>a b c</nav><div id=content><h1>Title of it</h1><p>" + "long words here " * 20 + "<p>x</div><div class=sidebar>" + "other words " * 30 + "</div></body>"
    assert main_text(page) == "Title of it\n" + "long words here " * 19 + "long words here\nx"


def test_title_and_closing_paragraph_beside_the_body():
    long = ["words of the text " * 12 + f"number {i}." for i in range(10)]
    body = "<div class=text>" + "".join(f"<p>{x}</p>" for x in long) + "</div>"
    links = "<ul><li><a href=a>One</a><li><a href=b>Two</a></ul>"
    for title, want in (("<h1>Title</h1>", "Title"), ("<div class=top><h1>Title</h1></div>", "Title"), ("<h2>Title</h2><p>Lead.</p>", "Title\nLead.")):
        page = f"<body>{links}{title}{body}<p>Last paragraph</p><p><a href=n>Next page</a></p>{links}</body>"
        assert main_text(page) == "\n".join([want, *long, "Last paragraph"])


def test_content_outside_the_largest_element():
    long = ["words of the text " * 12 + f"number {i}." for i in range(12)]
    page = "<body><div class=a>" + "".join(f"<p>{x}</p>" for x in long[:10]) + "</div><div class=b>" + "".join(f"<p>{x}</p>" for x in long[10:]) + "</div><ul>" + "<li><a href=x>x</a>" * 9 + "</ul></body>"
    assert main_text(page) == "\n".join(long)


def test_classes_are_whole_names():
    long = "words of the text " * 20
    for name in ("content no-sidebar", "post ad-free", "text-content"):
        assert main_text(f'<body><div class="{name}"><p>{long}</p><p class="notice-period">Three months.</p></div></body>') == f"{long.strip()}\nThree months."
    for name in ("cookie-notice", "sidebar-left", "Ad", "site-header", "mainNav", "post comments", "adBanner", "related-items"):
        assert main_text(f'<body><div class="{name}"><p>{long} away</p></div><p>{long}</p></body>') == long.strip()


def test_regions_from_several_elements():
    """A long paragraph, a second division and a last short paragraph all stay."""
    long = "words of the text " * 40
    page = f"<body><div><p>{long}</p></div><div><p>{long[:180]}</p></div><p>The end.</p></body>"
    assert main_text(page) == "\n".join([long.strip(), long[:180].strip(), "The end."])


def built(seed):
    """A page without article or main element or names, and the blocks of its article; menus and lists of links about it."""
    import random

    rng = random.Random(seed)
    words = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 10))) for _ in range(n))
    menu = lambda: "<ul>" + "".join(f"<li><a href=x>{words(rng.randrange(1, 3))}</a></li>" for _ in range(rng.randrange(4, 12))) + "</ul>"
    blocks = [words(rng.randrange(3, 9))]
    parts = [f"<h1>{blocks[0]}</h1>"]
    for _ in range(rng.randrange(3, 15)):
        kind = rng.random()
        text = words(rng.randrange(25, 150) if kind < 0.7 else rng.randrange(2, 8))
        blocks.append(text)
        parts.append(f"<h2>{text}</h2>" if kind > 0.85 else f"<p>{text}</p>")
    cut = rng.randrange(1, len(parts))
    body = rng.choice([f"<div>{''.join(parts)}</div>", f"<div>{''.join(parts[:cut])}</div><div>{''.join(parts[cut:])}</div>", "".join(parts), f"{parts[0]}<div>{''.join(parts[1:])}</div>"])
    return f"<html><body>{menu()}<div>{menu()}</div>{body}{menu()}<div><a href=y>{words(2)}</a> <a href=z>{words(2)}</a></div></body></html>", blocks


def test_recall_and_precision_over_built_pages(monkeypatch):
    def measure():
        found = right = wanted = 0
        for seed in range(200):
            page, blocks = built(seed)
            got = main_text(page).split("\n")
            found, right, wanted = found + sum(map(len, got)), right + sum(len(b) for b in blocks if b in got), wanted + sum(map(len, blocks))
        return right / wanted, right / found

    recall, precision = measure()
    assert recall >= 0.99 and precision >= 0.99
    monkeypatch.setattr("quernstone.llm.html_text.threshold", lambda values: float(values.min()))  # without clusters
    assert measure()[1] < precision - 0.05


def test_very_long_page():
    text = "long words here " * 200_000
    assert main_text(f"<nav>a</nav><p>{text}</p><p>short</p>") == text.strip() + "\nshort"


def test_one_large_paragraph_keeps_the_small_ones():
    page = "<article><h1>H</h1><p>" + "word " * 500 + "</p><p>Tiny.</p></article>"
    assert main_text(page) == "H\n" + ("word " * 500).strip() + "\nTiny."


def test_cut_off():
    assert main_text("<article><p>One &am") == "One &am"
    assert main_text("<article><p>One<p>Two <a hre") == "One\nTwo"
    assert main_text("<article><p>One<script>var x") == "One"
    assert main_text("<article><p>One<!-- never closed") == "One"


def test_nothing():
    assert main_text(None) == main_text("") == main_text("<nav>only menu</nav>") == ""
    assert main_text("plain text") == "plain text"


@given(st.text(alphabet="<>/apdiv &;\"'=!-x ", max_size=120))
@settings(max_examples=300, deadline=None)
def test_any_markup_gives_text(page):
    text = main_text(page)
    assert text == "\n".join(" ".join(line.split()) for line in text.split("\n")).strip()


def test_smoothing_and_threshold():
    import numpy as np

    assert np.allclose(smooth(np.ones(5), 1.0), 1)
    assert 1 < threshold(np.array([1.0, 1.1, 9.0, 9.2])) < 9
    assert threshold(np.array([3.0, 3.0])) == 3


def test_rows(spark):
    rows = spark.createDataFrame([(1, None, PAGE, 0), (1, None, PAGE, 0), (None, "u", None, 0)], "page_id long, url string, html string, text int")
    found = extract_pages(rows).collect()
    assert sorted(r["n_chars"] for r in found) == [0, len(main_text(PAGE)), len(main_text(PAGE))]
    assert extract_pages(rows.limit(0)).count() == 0


LONG = "words of the text " * 20


def test_all_articles_of_a_page():
    second = "<article><h2>Second</h2><p>A short one.</p></article>"
    page = f"<body><article><h1>First</h1><p>{LONG}</p><p>{LONG}</p></article>{second}</body>"
    assert main_text(page) == f"First\n{LONG.strip()}\n{LONG.strip()}\nSecond\nA short one."
    teaser = "<article><h3><a href=x>Other story</a></h3><p>Read it.</p></article>"
    assert main_text(page.replace(second, teaser)) == f"First\n{LONG.strip()}\n{LONG.strip()}"
    assert main_text(page.replace(second, "<article><p><a href=x>One</a></p><p><a href=y>Two</a></p></article>")) == f"First\n{LONG.strip()}\n{LONG.strip()}"


def test_heading_before_the_article():
    for start in ("<h1>Title</h1>", "<div><h1>Title</h1></div>", "<h1>Title</h1><h2>Below</h2>"):
        want = "Title\nBelow" if "h2" in start else "Title"
        assert main_text(f"<body><nav>x</nav>{start}<article><p>{LONG}</p></article><p>By us</p></body>") == f"{want}\n{LONG.strip()}"
    page = f"<body><main><h1>Title</h1><p>By</p><article>{f'<p>{LONG}</p>' * 10}</article><p>{LONG}</p><p><a href=x>{LONG}</a></p></main></body>"
    assert main_text(page).startswith("Title\n") and main_text(page).count(LONG.strip()) == 11
    assert main_text(f"<body><header><h1>Site</h1></header><article><p>{LONG}</p></article></body>") == LONG.strip()


def test_ordinary_words_as_names():
    page = f'<article><p>{LONG}</p><p class="search">{LONG}</p><p id="share">{LONG}</p><p>{LONG}</p></article>'
    assert main_text(page) == "\n".join([LONG.strip()] * 4)
    short = f'<article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p class="share"><a>X</a> <a>Y</a> <a>Z</a></p><div class="share">{LONG}</div><p class="ad">{LONG}</p><p class=cookie>{LONG}</p></article>'
    assert main_text(short) == "\n".join([LONG.strip()] * 3)


def test_a_linked_paragraph_between_paragraphs():
    page = f"<body><ul><li><a href=a>Menu</a></ul><div><p>{LONG}</p><p><a href=x>One linked sentence of text.</a></p><p>{LONG}</p></div></body>"
    assert main_text(page) == f"{LONG.strip()}\nOne linked sentence of text.\n{LONG.strip()}"
    assert main_text(f'<body><p>{LONG}</p><div class="copyright">All rights</div></body>') == LONG.strip()


def built_with_articles(seed):
    """A page of articles, teasers and lists of links in a main element, and its articles' blocks."""
    import random

    rng = random.Random(seed)
    words = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 10))) for _ in range(n))
    parts, blocks = [], []
    for _ in range(rng.randrange(1, 4)):
        mine = [words(5)] + [words(rng.randrange(30, 120)) for _ in range(rng.randrange(1, 5))]
        parts.append("<article><h2>" + mine[0] + "</h2>" + "".join(f"<p>{b}</p>" for b in mine[1:]) + f'<p class="share">{words(2)}</p></article>')
        blocks += mine
    for _ in range(rng.randrange(1, 5)):
        parts.append(f"<article><h3><a href=x>{words(4)}</a></h3><p>{words(3)}</p></article>")
    parts.append("<p>" + words(2) + "</p>")
    return f"<body><main>{''.join(parts)}</main></body>", blocks


def test_clusters_decide_on_article_pages(monkeypatch):
    def measure():
        found = right = wanted = 0
        for seed in range(100):
            page, blocks = built_with_articles(seed)
            got = main_text(page).split("\n")
            found, right, wanted = found + sum(map(len, got)), right + sum(len(b) for b in blocks if b in got), wanted + sum(map(len, blocks))
        return right / wanted, right / found

    recall, precision = measure()
    assert recall == 1 and precision >= 0.99
    monkeypatch.setattr("quernstone.llm.html_text.threshold", lambda values: float(values.min()))
    assert measure()[1] < precision - 0.01

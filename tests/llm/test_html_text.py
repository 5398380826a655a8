import pytest

from tessera.llm.html_text import html_text, main_text

LONG = "A paragraph of the article that is long enough to be told from boilerplate by its length, &amp; then some more."
PLAIN = LONG.replace("&amp;", "&")


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<p>", ""), ("just text", "just text"), ("<article><p>a<p>b</article>", "a\nb"),
        (f"<nav><a href=/>Home</a></nav><article><h1>T &eacute;&#233;&#xe9;</h1><p>{LONG}</p></article><footer>&copy; x</footer>", f"T ééé\n{PLAIN}"),
        ("<article><p>a \n\t b<br>c</p><script>var x='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>d</p></article>", "a b c\nd"),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
        ("<article><p>kept</p><aside>no</aside><div class='ad-banner'>no</div><form>no</form><p>too</p></article>", "kept\ntoo"),
        ("<article><p>kept</p><section id=comments><p>a comment that a reader wrote below it</p></section></article>", "kept"),
        (f"<div class=header>Site name</div><div id=content><p>{LONG}</p><p>short</p></div><div class=sidebar>more</div><div id=footer>end</div>", f"{PLAIN}\nshort"),
        ('<article><p title="a>b">t</p><a href="x">link only</a></article>', "t\nlink only"),
        ("<article><table><tr><td>1</td><td>2</td></tr><tr><th>3</th></tr></table><ul><li>x<li>y</ul></article>", "1 2\n3\nx\ny"),
        ("<body><div class='cookie-notice'>We use cookies</div><main><p>m</p></main></body>", "m"),
        ("<body class=no-sidebar><article class='post comments-open'><p>a</p><ol class=commentlist><li>no</ol></article></body>", "a"),
        (f"<div class='has-sidebar ad-free'><p>{LONG}</p></div><div class=siteFooter>no</div>", PLAIN), ("<article><p>a</p><article class=comment><p>no</p></article></article>", "a"),
        ("<article><header><h1>T</h1></header><p>b</p></article>", "T\nb"), ("<article><p>open <b>bold<p>next", "open bold\nnext"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_long_page():
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(5_000))
    assert main_text(f"<article>{body}</article>").count("\n") == 4_999


def test_table(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    df = spark.createDataFrame([(1, "u", "<article><p>é😀</p></article>", "x", "y"), (1, None, None, None, None), (None, "u", "", None, None)], schema)
    assert sorted(map(tuple, html_text(df).collect()), key=repr) == sorted([(1, "u", "é😀", 2), (1, None, "", 0), (None, "u", "", 0)], key=repr)
    assert html_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["svg", "math"])
def test_self_closing_svg_and_math_end_at_once(name):
    assert main_text(f"<article><p>a</p><{name} class='x'/><p>b</p><{name}><text>no</text></{name}><p>c</p></article>") == "a\nb\nc"
    assert main_text(f"<article><p>a</p><{name} /><p>b</p></article>") == "a\nb"


TEASER = "<article><h2>Teaser</h2><p>A card.</p></article>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # the windows decide, though the page declares an article
        (f"<body><div id=story><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>End.</p></div><nav><a>1</a></nav><nav>2</nav><nav>3</nav>{TEASER}</body>", f"Title\n{PLAIN}\n{PLAIN}\nEnd."),
        (f"<body>{TEASER}<div id=story><p>{LONG}</p><p>{LONG}</p></div></body>", f"{PLAIN}\n{PLAIN}"),
        (f"<body><article></article><div><p>{LONG}</p></div></body>", PLAIN),
        (f"<body><article><h1>T</h1><p>{LONG}</p><p>s</p></article><div><p>An unmarked line elsewhere.</p></div></body>", f"T\n{PLAIN}\ns"),
        # furniture cuts off short lines, whose container holds the article
        (f"<body><div><h1>Short title</h1><ul class=share><li>a<li>b<li>c</ul><p>{LONG}</p><div class=ad><p>1<p>2<p>3</div><p>Last.</p></div><div>far</div></body>", f"Short title\n{PLAIN}\nLast."),
        # within an article, names that only hold such a word
        (f"<article><div class=notice-board><p>{LONG}</p></div><h2 id=Social_impact>S</h2><section id=related-work><p>w</p></section><p class=form-note>n</p></article>", f"{PLAIN}\nS\nw\nn"),
        ("<article><p>a</p><div class='related-posts'>no</div><div class=shareButtons>no</div><div id=ad-12>no</div><div class=comments-area>no</div></article>", "a"),
        ("<article><p>Formula <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x = 2</annotation></math> holds.</p></article>", "Formula x=2 holds."),
        ("<article><ul><li><a href=1>one</a><li><a href=2>two</a></ul></article>", "one\ntwo"),
    ],
)
def test_where_the_text_is(page, text):
    assert main_text(page) == text


def test_windows_against_brute_force():
    import random

    from tessera.llm.html_text import stretches

    chosen = random.Random(6)
    for _ in range(500):
        lengths = [chosen.choice([0, 0, 5, 40, 200]) for _ in range(chosen.randrange(25))]
        surge = chosen.choice([1, 50, 80, 1_000])
        sums = [sum(lengths[i : i + 3]) for i in range(len(lengths))]
        least, inside, expected = min(surge, max(sums, default=0)), False, []
        for s in sums:
            inside = least > 0 and (s > 0 if inside else s >= least)
            expected.append(inside)
        assert [any(a <= i < b for a, b in stretches(lengths, surge=surge)) for i in range(len(lengths))] == expected


def test_columns_with_clashing_names_and_deep_pages(spark):
    df = spark.createDataFrame([("7", "u", "<article><p>x</p></article>", 1, "c")], "page_id string, url string, html string, node int, length string")
    assert tuple(html_text(df).first()) == (7, "u", "x", 1)
    deep = "<div>" * 3_000 + f"<p>{LONG}</p>" + "</div>" * 3_000
    assert main_text(deep) == PLAIN and main_text("<p>" * 5_000 + "a") == "a"

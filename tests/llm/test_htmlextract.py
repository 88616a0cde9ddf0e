import pytest

from reelspark.llm import htmlextract

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t = "<p>no</p>";</script></head><body><nav><ul><li><a href="/">Menu</a></li></ul></nav>
<!-- x --><div class="ad">Buy this now, it is very cheap and good for everybody</div><article><h1>Head &amp; line</h1><p>First   <b>bold</b><br>words&nbsp;here<p>Second &lt;p&gt; one</p>
<form>Search the site</form><div class="comments"><p>A reader wrote this long comment about it</p></div><p>Third paragraph stands here.</p></article><footer>&copy; all of us</footer></body></html>"""


def test_article():
    assert htmlextract.extract(PAGE) == "Head & line\n\nFirst bold words here\n\nSecond <p> one\n\nThird paragraph stands here."


def test_plain_layout():
    page = "<body><div><a href=1>One</a> <a href=2>Two</a></div><div><h1>Of moths</h1><p>Moths fly by night and rest by day on the bark of trees.</p><p>Their larvae feed on leaves.</p></div><div class='footer'>All rights</div></body>"
    assert htmlextract.extract(page) == "Of moths\n\nMoths fly by night and rest by day on the bark of trees.\n\nTheir larvae feed on leaves."


@pytest.mark.parametrize("attrs", ['style="overflow:hidden"', 'title="a hidden place"', "title='role=menu hidden'", 'data-id="ad-12" data-class="menu"', 'data-hidden aria-hidden="false"', "data-x=hidden", 'onclick="this.id=\'ad\'"', "title = 'class=ad'", 'x="1"class="story"title="hidden"'])
def test_values_of_other_attributes(attrs):
    plain = "<body><article><h1>Of moths</h1><div%s><p>Moths fly by night and rest by day.</p></div><p>They feed on leaves.</p></article></body>"
    assert htmlextract.extract(plain % (" " + attrs)) == htmlextract.extract(plain % "") == "Of moths\n\nMoths fly by night and rest by day.\n\nThey feed on leaves."


@pytest.mark.parametrize("href", ['"/hidden-river"', '"/story?id=ad-12"', "/a/hidden", "'/x?class=menu&role=search'"])
def test_words_of_links(href):
    page = f"<article><p>Boats were moved to <a href={href}>the old harbour</a> in the night.</p></article>"
    assert htmlextract.extract(page) == "Boats were moved to the old harbour in the night."


@pytest.mark.parametrize("attrs", ["hidden", 'HIDDEN=""', 'title="a" hidden', 'aria-hidden="true"', "class=ad", 'style="x"class="ad"', "data-x='y' ID = 'ad-12'", 'role="menu"'])
def test_still_passed_over(attrs):
    page = f"<article><p>Boats were moved in the night.</p><div {attrs}><p>Buy this</p></div></article>"
    assert htmlextract.extract(page) == "Boats were moved in the night."


BODY = "<h1>Of moths</h1><p>Moths fly by night and rest by day.</p><p>They feed on leaves.</p>"
TEXT = "Of moths\n\nMoths fly by night and rest by day.\n\nThey feed on leaves."


@pytest.mark.parametrize("before", ["<head><title>T</title><meta charset=utf-8>", "<head><title>T</title><body>", "<head><style>p{}</style><script>'<p>'</script>", "<head><title>T", "<svg class=x />", "<math/>", '<svg width="1"/><svg><title/><path d="M0"/></svg>', "<button>", "<select>", "<button><button>Go</button>", "<head><noscript><img src=x></noscript>", "<video src=x>"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_end_tags_left_out(before, tag):
    assert htmlextract.extract(f"<html>{before}<{tag}>{BODY}</{tag}></html>").replace("T\n\n", "") == TEXT


@pytest.mark.parametrize("inside", ["<svg><title>a</title><text>b</text></svg>", "<button><div>a</div></button>", "<select><option>a<option>b</select>", "<noscript><p>a</p></noscript>", "<template><article><p>a</p></article></template>", "<script>'</p>'</script>", "<textarea><p>a</textarea>", "<video><p>a</p></video>", "<math><mi>a</mi></math>"])
def test_whole_elements_passed_over(inside):
    assert htmlextract.extract(f"<article>{BODY.replace('by night', 'by' + inside + ' night')}</article>") == TEXT


def test_odd_pages(spark):
    rows = [(1, "u", None, 1), (2, None, "", 1), (3, "u", "<", 1), (4, "u", "no tags", 1), (5, "u", PAGE, 1), (5, "u", PAGE, 1), (6, "u", "<article>" + "<p>word " * 20000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((x.page_id, len(x.text), x.n_chars) for x in htmlextract.main_text(df).collect())
    assert [x[0] for x in got] == [1, 2, 3, 4, 5, 5, 6] and all(a == b for _, a, b in got)
    assert got[0][1] == got[1][1] == 0 and got[6][1] == 20000 * 6 - 2
    assert htmlextract.main_text(df.limit(0)).count() == 0


def test_every_page_of_the_table(spark):
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for x in htmlextract.main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*)</article>", x.html, re.S)[1]
        import html

        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1|div)\b[^>]*>", body))
        assert x.text == "\n\n".join(b for b in blocks if b)


@pytest.mark.parametrize("name", ["social-history", "notice-of-meeting", "menu_review", "ad-astra", "related-work", "tags-and-labels-explained", "page comment-threading-howto"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_class_names_that_say_something_else(name, tag):
    page = f"<body><{tag}><h1>Of moths</h1><div class='{name}'><p>Moths fly by night and rest by day.</p></div><p>They feed on leaves.</p></{tag}></body>"
    assert htmlextract.extract(page) == TEXT


@pytest.mark.parametrize("name", ["ad-slot", "site-footer", "sidebar-left", "comment-list", "cookie_banner", "related-posts", "share-buttons", "x newsletter-box", "ad 12", "ad-12"])
def test_class_names_that_say_nothing_else(name):
    page = f"<body><article><h1>Of moths</h1><p>Moths fly by night and rest by day.</p><div class='{name}'><p>Some other words stand here for once.</p></div><p>They feed on leaves.</p></article></body>"
    assert htmlextract.extract(page) == TEXT


@pytest.mark.parametrize("before", ["<object data=x>", "<audio src=x>", "<canvas>", "<iframe src=x>", "<datalist>", "<p><b><i>"])
def test_more_end_tags_left_out(before):
    assert htmlextract.extract(f"<body><article>{BODY.replace('<p>They', '<p>' + before + 'They')}</article></body>") == TEXT


def test_region_against_all_regions():
    from tests.llm.fixtures import rng

    r = rng(41)
    for _ in range(400):
        values = [r.choice([-3.0, -0.5, -0.02, 0.0, 0.25, 1.0, 4.0]) for _ in range(r.randrange(0, 25))]
        begin, end = htmlextract.region(values)
        most = max([sum(values[i:j]) for i in range(len(values)) for j in range(i + 1, len(values) + 1)], default=0.0)
        assert abs(sum(values[begin:end]) - max(0.0, most)) < 1e-9 and (most > 0 or (begin, end) == (0, 0))


def test_labelled_pages_and_pages_left_out():
    """On each labelled page the best of all regions, by the weights of the others, is the marked one or nearly so."""
    import html
    import re

    for i, page in enumerate(htmlextract.LABELLED):
        weights = htmlextract.fit(tuple(p for j, p in enumerate(htmlextract.LABELLED) if j != i))
        items = htmlextract.Page(page).items
        values = htmlextract.scored(items, weights)
        begin, end = htmlextract.region(values)
        sums = [0.0]
        for v in values:
            sums.append(sums[-1] + v)
        assert abs(sums[end] - sums[begin] - max(sums[b] - sums[a] for a in range(len(sums)) for b in range(a, len(sums)))) < 1e-9
        want = html.unescape(re.sub(r"<[^>]*>", " ", page.split("<!--main-->")[1].split("<!--/main-->")[0])).split()
        got = htmlextract.extract(page, weights).split()
        both = len(set(want) & set(got))
        assert both >= 0.95 * len(set(want)) and both >= 0.85 * len(set(got)), (i, set(want) - set(got), set(got) - set(want))
        # nothing is lost; a plain sentence right after the article can't be told from it by where it stands
        got = "".join(htmlextract.extract(page).split())
        assert got.startswith("".join(want)) and len(got) - len("".join(want)) < 60, i


@pytest.mark.parametrize("opened", ["<div>", "<p><b>", "<article><nav>", "<ul><li>", "<table><tr><td>", "<button>", "<section class=ad><main>"])
def test_deep_nesting_takes_time_in_proportion(opened):
    import time

    def seconds(n):
        began = time.perf_counter()
        htmlextract.extract(opened * n + "word here " * 50)
        return time.perf_counter() - began

    seconds(100)
    small, large = seconds(2000), seconds(16000)
    assert large < 24 * small + 0.3

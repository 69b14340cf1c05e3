import random
from collections import Counter

from readtrail.llm import templates


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return {r.page_id: r.text for r in templates.extract(df).collect()}


def test_article_without_the_rest(spark):
    html = page(
        '<header><h1>Site</h1></header><nav><a href="/">Home</a></nav><div class="ad">Buy</div>'
        '<article><header><h1>Title &amp; more</h1></header><p>One\n  two<br>three &lt;four&gt;</p>'
        '<script>var t="</p>";</script><ul><li>a<li>b</ul><form><input>Mail</form>'
        '<div class="comments"><p>First!</p></div><p>End&nbsp;here</article>'
        '<aside>Related</aside><footer>&copy; 2024</footer>'
    )
    got = extracted(spark, [(1, "https://x.example.org/a", html)])
    assert got[1] == "Title & more\nOne two three <four>\na\nb\nEnd here"


def test_template_subtrees_of_a_host_go_and_single_ones_stay(spark):
    top = "<div><b>My site</b> <span>since 1999</span></div>"
    rows = [(i, "http://h.example.com/p", page(f"{top}<div><p>text {i} is here</p></div>")) for i in range(8)]
    rows.append((100, "http://other.example.com/p", page(f"{top}<div><p>alone</p></div>")))
    got = extracted(spark, rows)
    assert all(got[i] == f"text {i} is here" for i in range(8))
    assert got[100] == "My site since 1999\nalone"  # on one page of its host only


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, "http://h.example.com/p", page("<div><p>the same story</p></div>")) for i in range(9)]
    assert set(extracted(spark, rows).values()) == {"the same story"}


def test_text_blocks_of_articles_are_no_template(spark):
    rows = [(i, "http://h.example.com/p", page(f"<article><p>License line</p><p>body {i}</p></article>")) for i in range(9)]
    got = extracted(spark, rows)
    assert all(got[i] == f"License line\nbody {i}" for i in range(9))


def test_unnamed_boxes_inside_articles_go(spark):
    box = "<div class='x7'><p>Subscribe to our letter</p></div>"
    advert = "<section><p>Shoes at half price</p><p>Only this week</p></section>"
    story = "<p>A story {0} of its own</p>{1}<p>that ends {0} here</p>"
    rows = [(i, "http://h.example.com/p", page(f"<article>{story.format(i, box if i % 2 else advert)}</article>")) for i in range(20)]
    got = extracted(spark, rows)
    assert all(got[i] == f"A story {i} of its own\nthat ends {i} here" for i in range(20))


def test_copied_articles_do_not_vote(spark):
    body = "<div class='x8'>" + "".join(f"<p>Paragraph {k} of the one story that is copied</p>" for k in range(20)) + "</div>"
    box = "<div class='x7'><p>Box of the copied story</p></div>"
    rows = [(i, "http://h.example.com/p", page(f"<p>Shown {i}</p><article><h1>Part {i}</h1>{body}{box}</article>")) for i in range(9)]
    got = extracted(spark, rows)
    assert all("Paragraph 7" in got[i] and "Box of the copied" in got[i] for i in range(9))


def test_names_and_forms_do_not_drop_the_article(spark):
    story = "<p>A main text that has a number of words in it</p><p>and ends here</p>"
    other = '<div class="ad-slot"><p>Buy</p></div><div id="comments"><article><p>First!</p></article></div>'
    bodies = [
        f"<div id='content' class='has-sidebar'>{story}</div>",
        f"<main class='with-comments'>{story}</main>{other}",
        f"<article class='post no-sidebar'>{story}</article>{other}",
        f"<form id='aspnetForm'><div class='x'><a href='/'>Home</a></div><article>{story}</article>{other}</form>",
        f"<form><div>{story}</div></form>",
        f"<div class='page-sidebar-right'><main>{story}</main></div><div class='related-posts'><article><p>Teaser</p></article></div>",
        f"<article>{story}</article><div class='related-posts'><article><p>Teaser</p></article></div>",
        f"<div class='widget'><div>{story}</div></div><div class='ad'>Buy</div>",
        f"<article>{story}<form><input>Mail</form><div class='comments-area'><p>First!</p></div></article>",
        f"<div class='notice'><article>{story}</article></div>",
    ]
    got = extracted(spark, [(i, f"http://h{i}.example.com/p", page(b)) for i, b in enumerate(bodies)])
    want = "A main text that has a number of words in it\nand ends here"
    assert got == {i: want for i in range(len(bodies))}


def test_names_and_forms_within_the_article_do_not_drop_its_story(spark):
    story = "<p>A main text that has a number of words in it</p><p>and ends here</p>"
    bodies = [
        f"<article><div class='elementor-widget-container'>{story}</div></article>",
        f"<article><form>{story}</form></article>",
        f"<article><h1>Head</h1><div class='entry related-to-x'>{story}</div></article>",
        f"<article>{story}<section class='search-engine-history'><p>How engines came about</p></section></article>",
        f"<article><div class='widget'><div id='content'>{story}</div></div><div class='widget'>Also</div></article>",
        f"<article>{story}<div style='color:red; display: none'>unseen</div><div class='newsletter-box'><p>Mail me</p></div></article>",
        f"<article>{story}<div class='ad-300x250'>Buy</div><ul class='wp-related-posts'><li><a href='/'>More</a></ul></article>",
    ]
    got = extracted(spark, [(i, f"http://h{i}.example.com/p", page(b)) for i, b in enumerate(bodies)])
    text = "A main text that has a number of words in it\nand ends here"
    assert got == {0: text, 1: text, 2: f"Head\n{text}", 3: f"{text}\nHow engines came about", 4: text, 5: text, 6: text}


def test_counts_against_a_plain_dictionary(spark):
    """Which boxes are template, by counting whole markup per host over different stories."""
    r = random.Random(3)
    boxes = [f"<div class='b{k}'><p>Box {k}</p><p>twice {k}</p></div>" for k in range(14)]
    rows, counts = [], Counter()
    for i in range(120):
        host = f"h{i % 3}.example.com"
        mine = [k for k in range(14) if r.random() < 0.01 * (k + 1)]
        counts.update((host, k) for k in mine)
        story = [f"Line {n} of a story that is told on page {i} alone" for n in range(40)]
        body = f"<article>{''.join(f'<p>{line}</p>' for line in story)}{''.join(boxes[k] for k in mine)}</article>"
        rows.append((i, f"http://{host}/{i}", page(body), host, mine, story))
    got = extracted(spark, [r[:3] for r in rows])
    for i, _, _, host, mine, story in rows:
        kept = [k for k in mine if counts[host, k] < templates.MANY_PAGES]
        assert got[i] == "\n".join([*story, *[x for k in kept for x in (f"Box {k}", f"twice {k}")]])
    assert 0 < sum(n < templates.MANY_PAGES for n in counts.values()) < len(counts)


def test_template_on_a_small_share_of_a_host_goes(spark):
    advert = "<div><p>Advert {0}, one of many</p></div>"
    rows = [(i, "http://h.example.com/p", page(f"<p>It says <b>not</b> {i} on this page</p>{advert.format(i % 12)}")) for i in range(84)]
    got = extracted(spark, rows)
    assert all(got[i] == f"It says not {i} on this page" for i in range(84))


def test_near_copies_of_a_story_are_no_template(spark):
    story = [f"Sentence {k} of a story that is told again and again" for k in range(12)]
    rows = [(i, "http://h.example.com/p", page(f"<p>Only text {i}</p><div>{i} more</div>")) for i in range(45)]
    for i in range(45, 50):
        told = [*story[:i - 45], f"Changed {i}", *story[i - 44:]]
        rows.append((i, "http://h.example.com/p", page("".join(f"<p>{line}</p>" for line in told))))
    got = extracted(spark, rows)
    assert all(len(got[i].split("\n")) == 12 for i in range(45, 50))


def test_odd_pages(spark):
    deep = "<div>" * 30_000 + "deep"
    rows = [
        (1, None, None), (2, "", ""), (3, "not a url", "plain text"), (None, "http://h/", page("<p>x")), (5, "http://h/", "<p>cut<a hre"),
        (6, "http://h/", deep), (7, "http://h/", "<article></article>"), (7, "http://h/", "<article></article>"),
        (8, "http://h/", "</p></div>stray<li>x</td>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = templates.extract(df.selectExpr("*", "1 AS text", "2 AS template")).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    got = {r.page_id: r.text for r in out}
    assert (got[1], got[2], got[3], got[None], got[6], got[7]) == ("", "", "plain text", "x", "deep", "")
    assert templates.extract(df.where("false")).collect() == []


def test_given_pages(spark, sf_dir):
    from readtrail.llm.queries import op2_templates

    out = op2_templates(spark, sf_dir).collect()
    assert len(out) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert all(r.text and "©" not in r.text and "track(" not in r.text for r in out)

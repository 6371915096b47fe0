import html
import random
import re

from latticelu.llm import htmlex

SCHEMA = "page_id bigint, url string, html string"


def one(page):
    return htmlex.extract_text(page, None)


def infer(page):
    return htmlex.infer(htmlex.parse(page))


def test_query_matches_the_articles(spark, sf_dir):
    from latticelu.llm import queries

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.op10_html(spark, sf_dir).collect()
    assert {r.page_id for r in rows} == set(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", article))).split())
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


def test_boilerplate_is_left_out():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>"<p>no</p>"</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">Accept</div><div id="sidebar"><p>Side</p></div>
    <article><h1>Head&nbsp;line</h1><p>One <b>bo</b>ld &amp; two<br>three<p>Four</p><div class="ad">Buy</div><form><input value=q>Find</form><ul><li>li1<li>li2</ul>
    <table><tr><td>c1<td>c2</table><section class="comments"><p>First!</p></section></article><aside>More</aside><footer>&copy; me</footer><noscript>js</noscript></body></html>"""
    assert one(page) == "Head line One bold & two three Four li1 li2 c1 c2"


def test_pages_without_an_article_use_what_is_left():
    assert one("<body><nav>menu</nav><div><p>text</p>tail</div><footer>f</footer>") == "text tail"
    assert one("plain &lt;text&gt;") == "plain <text>"
    assert one("") == "" and one("<nav>only menu</nav>") == ""


def test_broken_markup():
    assert one("<article><p>a<p>b</i></div><b>c</article></p>d") == "a bc"
    assert one("<article><p>x<!-- <p>hidden</p> -->y</p><script>never ends</article>") == "xy"
    assert one("<article><p title='a > b'>q</p> 1 < 2 <") == "q 1 < 2 <"


def test_alignment_finds_optional_and_repeated_groups_and_text_slots():
    a, b = "<div><h1>x</h1><p>1</p><p>2</p></div>", "<div><p>1</p><table><tr><td>q</td></tr></table></div>"
    both = htmlex.merge(infer(a), infer(b))
    assert htmlex.expression(both) == "<div>(<h1>=</h1>)?(<p>#</p>)+(<table><tr><td>=</td></tr></table>)?</div>"
    assert htmlex.dump(htmlex.load(htmlex.dump(both))) == htmlex.dump(both)
    text = htmlex.expression(both)
    assert htmlex.expression(htmlex.merge(htmlex.load(htmlex.dump(both)), infer(a))) == text == htmlex.expression(htmlex.merge(infer(b), both))
    same = htmlex.merge(infer("<div><p>menu</p><h1>a</h1></div>"), infer("<div><p>menu</p><h1>b</h1></div>"))
    assert htmlex.expression(same) == "<div><p>=</p><h1>#</h1></div>"


def regex(wrapper):
    """The wrapper as a regular expression over tags, by another way than expression()."""
    if wrapper.label == "#":
        body = "#"
    else:
        inside = "".join(map(regex, wrapper.kids))
        body = f"<{wrapper.label}>{inside}</{wrapper.label}>" if wrapper.label else inside
    return f"(?:{body})" + ("*" if wrapper.optional and wrapper.repeated else "?" if wrapper.optional else "+" if wrapper.repeated else "")


def test_wrappers_match_every_page_in_any_order():
    rng = random.Random(4)
    parts = ["<h1>t</h1>", "<p>a</p>", "<p>b</p><p>c</p>", "<ul><li>1</li><li>2</li></ul>", "<div>ad</div>", "<table><tr><td>1</td></tr></table>"]
    for _ in range(8):
        pages = ["<section>" + "".join(rng.sample(parts, rng.randint(0, 5))) + "</section>" for _ in range(40)]
        wrapper = infer(pages[0])
        for p in pages[1:]:
            wrapper = htmlex.merge(wrapper, infer(p))
        for p in pages:
            marks = "".join(("#" if t[0] == "#" else "<" + t[1:] + ">" if t[0] == "<" else "</" + t[1:] + ">") for t, _ in htmlex.stream(p))
            assert re.fullmatch(regex(wrapper), marks), (p, htmlex.expression(wrapper))


def pages_of(template, count, host="http://h/"):
    rng = random.Random(9)
    made = [" ".join(rng.choice("aa bb cc dd ee ff gg".split()) for _ in range(30)) + f" {k}" for k in range(count)]
    return [(k, host, template.format(text=t)) for k, t in enumerate(made)], dict(enumerate(made))


def test_inference_alone_removes_unmarked_boilerplate(spark):
    # no element or class name tells: only what all pages of the host share is template
    rows, want = pages_of("<div><div class='x1'><ul><li>Home</li><li>About us</li></ul></div><div><p>{text}</p><p>own {text}</p></div><div>All rights belong to us</div></div>", 12)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert {r.page_id: r.text for r in htmlex.extract(df).collect()} == {k: f"{t} own {t}" for k, t in want.items()}
    # one page alone shows no template, and equal pages count once
    few = spark.createDataFrame([rows[0]] * 5, SCHEMA)
    assert {r.text for r in htmlex.extract(few).collect()} == {f"Home About us {want[0]} own {want[0]} All rights belong to us"}


def test_optional_template_parts_and_near_copies(spark):
    rows, want = pages_of("<div><p>{text}</p></div>", 12)
    rows = [(k, u, h.replace("<div>", "<div><h4>Read this too</h4>") if k % 2 else h) for k, u, h in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {r.page_id: r.text for r in htmlex.extract(df).collect()} == want
    # pages that differ in a word are copies, not a template with a slot
    copies = [(k, "http://c/", f"<div><p>{'the same long text ' * 9}</p><b>{k}</b></div>") for k in range(6)]
    assert {r.page_id: r.text for r in htmlex.extract(spark.createDataFrame(copies, SCHEMA)).collect()} == {k: ("the same long text " * 9) + str(k) for k in range(6)}


def test_shared_passages_inside_articles_stay(spark):
    rows, want = pages_of("<article><p>{text}</p><p>shared by all</p></article><div>tail of the site</div>", 8)
    assert {r.page_id: r.text for r in htmlex.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == {k: f"{t} shared by all" for k, t in want.items()}


def test_headers_inside_articles_are_left_out():
    assert one("<article><header>by me</header><p>x</p><footer>f</footer></article>") == "x"


def test_deep_and_wide_pages(spark):
    deep = ["<div>" * n + "core" + "</div>" * n for n in (900, 50_000)] + ["<div><p>" * 20_000 + "core", "<x>" * 30_000 + "core" + "</p>" * 30_000]
    wide = ["<div>" + "".join(f"<h2>{k}</h2><p>{k}</p>" for k in range(n)) + "</div>" for n in (15_000, 14_000)]
    rows = [(k, "http://h/", h) for k, h in enumerate([*deep, *deep, *wide])]
    got = {r.page_id: r.text for r in htmlex.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k] == "core" for k in range(8)) and got[8] == " ".join(f"{k} {k}" for k in range(15_000))


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    page = "<article><p>x</p></article>"
    rows = [(1, "http://a.b/", page, 1), (1, "http://a.b/", page, 1), (2, None, page, 2), (None, "no host", None, 3), (3, "http://A.B/z", "", 4), (4, "http://c", "<p>" + "long " * 50_000, 5)]
    df = spark.createDataFrame(rows, SCHEMA + ", wrapper int")
    got = sorted((r.page_id or 0, r.text) for r in htmlex.extract(df).collect())
    assert got == [(0, ""), (1, "x"), (1, "x"), (2, "x"), (3, ""), (4, ("long " * 50_000).strip())]
    assert sorted((r.page_id or 0, r.text) for r in htmlex.extract(df, broadcast_bytes=0).collect()) == got
    assert htmlex.extract(df.limit(0)).count() == 0


def test_wrappers_meet_over_tasks(spark):
    rows = [(k, "http://h/", f"<article><p>{k}</p>{'<h2>s</h2>' * (k % 3)}</article>") for k in range(90)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(30)
    found = htmlex.infer_wrappers(df, group=4).collect()
    assert len(found) == 1 and htmlex.expression(htmlex.load(found[0].wrapper)) == "<article><p>#</p>(<h2>=</h2>)*</article>"


def test_hosts_that_mix_templates_lose_no_page(spark):
    rows = [(1, "http://h/", "<nav>m</nav><article><p>inner</p></article><div>outer</div>"), (2, "http://h/", "<nav>m</nav><div><p>no article</p></div><footer>f</footer>"), (3, "http://h/", "<main><p>in main</p></main>"), (4, None, "<article>a</article>"), (5, "no host", "<p>plain</p>"), (6, None, "text")]
    want = {1: "inner", 2: "no article", 3: "in main", 4: "a", 5: "plain", 6: "text"}
    assert {r.page_id: r.text for r in htmlex.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == want

import html
import re

from flagstone.llm.queries import QUERIES
from flagstone.llm.templates import STATS, extract_pages, parse, template_tokens, token_rows

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string"


def article(page):
    """What lies between <article> and </article>, block by block; good for the generated pages only."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(b for b in blocks if b)


def texts(spark, rows):
    got = extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return {r.page_id: r.text for r in got}


def test_query_gives_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op8_template_extraction"](spark, SF).collect()
    assert {r.page_id for r in got} == set(pages) and len(got) == len(pages)
    for r in got:
        assert r.url == pages[r.page_id].url and r.text == article(pages[r.page_id].html)
        assert r.n_chars == len(r.text)


def page(body, n=0):
    return (
        f"<html><head><title>T{n}</title></head><body><header><p>Site name</p></header><ul class='main-menu'><li><a href=x>Home {n}</a></ul>"
        f"<div id=cookie-notice>We use cookies {n}</div><div class='sidebar'><p>Popular {n} words in a row</p></div>{body}"
        f"<div class=comments><p>Reader {n}: nice!</p></div><form><p>Mail {n}</p><input name=a></form><footer>(c) {n}</footer>")


def test_parts_that_are_no_article_go(spark):
    body = "<div class=story><h2>Head{0} &amp; more</h2><p>First{0}\n  <b>bold</b>er<br>line <span class=ad>buy</span>on<p>Second{0} &lt;p&gt;<script>if (a<b) '</p>'</script> end</div>"
    rows = [(i, f"http://a.org/{i}", page(body.format(i), i)) for i in range(12)]
    got = texts(spark, rows)
    assert got == {i: f"Head{i} & more\n\nFirst{i} bolder line on\n\nSecond{i} <p> end" for i in range(12)}


def test_the_template_finds_the_slot_without_names_and_drops_constant_text(spark):
    rows = []
    for i in range(12):
        rows.append((i, f"https://User@B.org:80/{i}", f"<body><div><div>Always the same words here</div><div><div><p>Own text {i} is long enough to win by far</p><div>Sign up now</div><p>and goes on {i}</p></div></div></div>"))
    assert texts(spark, rows)[3] == "Own text 3 is long enough to win by far\n\nand goes on 3"


def test_damaged_pages(spark):
    rows = [
        (1, "http://c.org", None), (2, "http://c.org", ""), (3, None, "plain   text &eacute;"), (4, "no url", "<article><p>cut off <b>in"),
        (5, "http://d.org", "<article><p>cut in a tag <a hre"), (6, "http://e.org", "<article><p>a </div></span> b</p><!-- never closed <p>c"),
        (None, "http://f.org", "<p title='a>b'>x < y &amp;&amp; y > z</p>"), (7, "http://g.org", "<nav>all menu</nav>"), (8, "http://c.org", "<article>" + "<div>" * 3000 + "deep"),
        (9, "http://h.org", "<main><p>one</p></main>"), (9, "http://h.org", "<main><p>one</p></main>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", host int")
    got = sorted(((r.page_id, r.text) for r in extract_pages(df).collect()), key=str)
    assert got == sorted([
        (1, ""), (2, ""), (3, "plain text é"), (4, "cut off in"), (5, "cut in a tag"), (6, "a b"), (None, "x < y && y > z"), (7, ""), (8, "deep"),
        (9, "one"), (9, "one")], key=str)
    assert extract_pages(df.limit(0)).collect() == []


def test_blocks_and_paths():
    blocks, paths = parse("<body><article><h1>A</h1>b<p>c<p class=ad>x<p>d<ul><li>e<li>f</ul><aside>no</aside>g</article>")
    assert [t for _, t in blocks] == ["A", "b", "c", "d", "e", "f", "g"]
    assert paths["body>article"] == 1 and paths["body>article>ul"] == 1


def test_raw_names_and_missing_ends_swallow_nothing():
    shown = lambda html: [t for _, t in parse(html)[0]]
    for mark in ("<svg width=1 />", "<svg><path d=x>", "<button>", "<svg-icon></svg-icon>", "<button-group></button-group>", "<title-bar></title-bar>",
                 "<template-card></template-card>", "<script-x>", "<object data=x>", "<select>", "<svg/><button>"):
        assert shown(f"<article><p>a</p>{mark}<p>b</p><p>c</p></article>") == ["a", "b", "c"], mark
    assert shown("<p>a</p><button>x<button>no</button><p>b</p><svg><title>no</title><text>no</text></svg><p>c") == ["a", "x", "b", "c"]
    assert shown("<p>a</p><select><option>no<option>no</select><button><div>no</div></button><template><p>no</p></template ><p>b<script>no</script x><p>c") == ["a", "b", "c"]


def test_without_article_tags_all_slots_of_varying_text_are_kept(spark):
    long = "many words of the entry " * 20
    bodies = {
        "http://i.org": "<div id=content><h1>Title {0}</h1><p>Lead {0}</p><div class=entry><p>" + long + "{0}</p></div></div>",
        "http://j.org": "<div><p>Before {0}</p><table><tr><td>" + long + "{0}</table><p>After {0}</p></div>",
        "http://k.org": "<main><h1>Head {0}</h1><article><p>" + long + "{0}</p></article></main>",
    }
    for n in (1, 8):  # a single page, and a template
        rows = [(f"{host}/{i}", f"<body><nav>menu</nav>{body.format(i)}<div>{'Always the same' if n > 1 else ''}</div></body>") for host, body in bodies.items() for i in range(n)]
        got = extract_pages(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], SCHEMA)).collect()
        for r in got:
            i, end = r.url[-1], " ".join(long.split())
            parts = {"i": [f"Title {i}", f"Lead {i}", f"{end} {i}"], "j": [f"Before {i}", f"{end} {i}", f"After {i}"], "k": [f"Head {i}", f"{end} {i}"]}
            assert r.text == "\n\n".join(parts[r.url[7]])


def test_names_drop_no_article_and_no_part_of_it(spark):
    body = (
        "<article><h2 id='related-work'>Related {0}</h2><p>one {0}</p><h2 id='search'>Search {0}</h2><section id='social-history'><p>two {0}</p></section>"
        "<p class='notice'>three {0}</p><p class=ad>no</p><div class='share-links'>no</div></article>")
    shown = "Related {0}\n\none {0}\n\nSearch {0}\n\ntwo {0}\n\nthree {0}"
    hosts = {
        "l.org": "<div class='layout has-sidebar'>" + body + "</div>", "m.org": "<div class='sidebar'><div class=menu>no {0}</div>" + body + "</div>",
        "n.org": "<div class='no-sidebar'>" + body + "</div><div class=comments><p>no {0} and a longer text</p></div>",
        "o.org": "<div class=search>" + body.replace("article", "div") + "</div>",
    }
    for n in (1, 8):
        rows = [(f"http://{host}/{i}", f"<body>{hosts[host].format(i)}</body>") for host in hosts for i in range(n)]
        for r in extract_pages(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], SCHEMA)).collect():
            if "o.org" in r.url:  # a name around all text of a host without article tags
                assert "one " in r.text and "three " in r.text
            else:
                assert r.text == shown.format(r.url[-1]), r.url


def test_paths_of_single_pages_do_not_reach_the_template(spark):
    rows = [(i, f"http://p.org/{i}", f"<body><div class=all><div id=slug{chr(97 + i % 26)}{chr(97 + i // 26)}><p>Own {i}</p></div></div></body>") for i in range(60)]
    pages = spark.createDataFrame([(i, "p.org", html) for i, _, html in rows], "page long, host string, html string")
    kept = template_tokens(pages.mapInArrow(token_rows, STATS)).collect()
    assert {r.path for r in kept} == {"", "body", "body>div.all"} and len(kept) == 3
    assert texts(spark, rows) == {i: f"Own {i}" for i in range(60)}


def test_a_form_around_a_page_loses_nothing(spark):
    """Layouts that wrap the whole page in one form, with and without an article tag, with a search field and hidden ones."""
    text = "<h1>Head {0}</h1><p>" + "words of the page " * 30 + "{0}</p>"
    shown = "Head {0}\n\n" + "words of the page " * 30 + "{0}"
    wrap = "<body><form id=aspnetForm method=post><input type=hidden name=v><div class=search-box><input name=q><button>Go</button></div>%s</form></body>"
    hosts = {"a.org": wrap % text, "b.org": wrap % f"<article>{text}</article>", "c.org": wrap % f"<div id=content>{text}</div>"}
    for n in (1, 20):
        rows = [(f"http://{host}/{i}", hosts[host].format(i)) for host in hosts for i in range(n)]
        got = extract_pages(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], SCHEMA)).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.text == shown.format(r.url.rpartition("/")[2]), r.url


def test_forms_of_fields_go():
    shown = lambda html: [t for p, t in parse(html)[0] if not any(part.startswith("!") for part in p.split(">"))]
    small = "<form><p>Your name</p><input name=a><p>Your mail</p><input name=b><button>Send</button></form>"
    assert shown(f"<article><p>a</p>{small}<p>b</p></article>") == ["a", "b"]
    assert shown(small) == []
    assert shown("<form><p>" + "a text " * 40 + "</p><input type=hidden></form>") == [("a text " * 40).strip()]


def test_comments_adverts_and_the_like_inside_articles(spark):
    """Names of real layouts, as class and as id where ids tell it."""
    names = ("comments comment-body user-comments post-comments reader-comments comment-thread related-posts ad-slot ad-unit google-ads "
             "sponsored-content promo-card sidebar-content subscribe-cta notice").split()
    by_id = "comments user-comments post-comments comment-thread ad-slot google-ads".split()
    marks = [f"<div class='{n}'><p>no {n}</p></div>" for n in names] + [f"<section id={n}><p>no {n}</p></section>" for n in by_id]
    marks.append("<div class=discussion><h3>Readers</h3><div class=post><p>no x</p></div><div class=post><p>no y</p></div></div>")
    body = "<p>first {0} and a few more words</p>" + "".join(marks) + "<section id=discussion><h2>Discussion</h2><p>what {0} means in all its detail</p></section>"
    wanted = "first {0} and a few more words\n\nDiscussion\n\nwhat {0} means in all its detail"
    for n in (1, 8):
        rows = [(i, f"http://q.org/{i}", f"<body><article>{body.format(i)}</article></body>") for i in range(n)]
        got = texts(spark, rows)
        assert got == {i: wanted.format(i) for i in range(n)}
        rows = [(i, f"http://r.org/{i}", f"<body><main>{body.format(i)}</main></body>") for i in range(n)]
        assert texts(spark, rows) == got


def test_frames_of_sites_without_article_tags(spark):
    rows = [(i, f"http://s.org/{i}", (
        f"<body><a class=skip-link href=#c>Skip to content</a><div class=site-header><p>Site {i}</p></div><div class='content-sidebar-wrap'><div class=post-header><h1>Title {i}</h1></div>"
        f"<p>Own text {i} is long enough</p><div class=sidebar-content><p>no {i}</p></div></div><p class=copyright>(c) {i}</p></body>")) for i in range(8)]
    for n in (1, 8):
        assert texts(spark, rows[:n]) == {i: f"Title {i}\n\nOwn text {i} is long enough" for i in range(n)}

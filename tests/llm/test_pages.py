import html
import random
import re

import pytest

from borelake.llm import pages
from borelake.llm.pages import Host, Page, Wrapper


def plain(source):
    """The text of an article's blocks, by regular expressions."""
    source = re.sub(r"(?s)<script>.*?</script>", "", source)
    inner = re.search(r"(?s)<article>(.*?)(?:</article>|$)", source).group(1)
    parts = re.split(r"</?(?:p|h1|h2|div|li|ul)[^>]*>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts]
    return "\n".join(t for t in texts if t)


def made(rng, words):
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    body = "".join(rng.choice([f"<p>{prose(20)}</p>", f"<p><b>{prose(3)}<br><p>{prose(9)} <a href='/x'>{prose(1)}</a></p>", f"<h2>{prose(2)}</h2>\n<ul>\n <li>{prose(3)}\n <li>{prose(2)}</ul>"]) for _ in range(rng.randrange(6)))
    extra = rng.choice(["", f'<aside class="box">{prose(5)}</aside>', f'<div id="cookie-notice">{prose(3)}</div>', f"<form><label>{prose(2)}</label><input name=q></form>"])
    tail = rng.choice(["", f'<section class="comments"><p>{prose(9)}</p></section>'])
    return f'<!DOCTYPE html><html><head><title>{prose(3)}</title><style>p{{}}</style><script>var t="</p><article>";</script></head><body><nav><ul><li><a href="/a">{prose(1)}</a></li><li>{prose(1)}</li></ul></nav><!-- <p>no</p> --><div class="ad">{prose(4)}</div>{extra}<article><h1>{prose(4)}</h1>{body}</article>{tail}<footer>&copy; {prose(2)}</footer></body></html>'


def test_articles(spark):
    rng = random.Random(8)
    words = ["ab", "c&amp;d", "é", "&lt;b&gt;", "word,", "日本", "x&nbsp;y", "end."]
    rows = [(k, f"http://h{k % 3}.org/{k}", made(rng, words)) for k in range(90)]
    odd = [(100, None, None), (101, "http://h0.org/", ""), (None, "nowhere", "just text <b>bold</b>"), (102, "http://z.org/", "<article><p>cut of"), (103, "http://z.org", "<p>a < b</p> <p>c"), rows[0], (104, "http://deep.org/", "<div>" * 5000 + "deep" + "</div>" * 5000), (105, "http://long.org/", "<article><p>" + "long text " * 200_000 + "</p></article>")]
    df = spark.createDataFrame([(*r, "t") for r in rows + odd], "page_id long, url string, html string, host string").repartition(4)
    want = {k: plain(s) for k, _, s in rows} | {100: "", 101: "", None: "just text bold", 102: "cut of", 103: "a < b\nc", 104: "deep", 105: ("long text " * 200_000).strip()}
    for size in (0, 10**9):
        got = pages.extract(df, size).collect()
        assert len(got) == len(rows) + len(odd)
        for r in got:
            assert r["text"] == want[r["page_id"]], r["page_id"]
    assert pages.extract(df.limit(0)).count() == 0
    assert {r["host"]: r["pages"] for r in pages.wrappers(df).collect()} == {"h0.org": 32, "h1.org": 30, "h2.org": 30, "": 2, "z.org": 2, "deep.org": 1, "long.org": 1}


def host_of(sources, split=1):
    hosts = [Host() for _ in range(split)]
    for k, s in enumerate(sources):
        hosts[k % split].add(Page(s))
    whole = Host()
    for h in hosts:
        whole.merge(Host.load(h.dump()))
    return Host.load(whole.dump())


def read(sources, split=1):
    wrapper = Wrapper(host_of(sources, split))
    return [wrapper.text(s) for s in sources]


def test_wrapper_has_optional_and_repeated_parts():
    host = host_of(["<div><h1>A</h1><p>1</p><p>2</p></div>", "<div><h1>B</h1><p>1</p><hr><section>s</section></div>", "<div><h1>C</h1><p>1</p><p>9</p><p>3</p></div>"])
    assert host.root.expression() == "<page><div><h1>TEXT</> (<p>TEXT</>)+ (<section>TEXT</>)?</></>"
    grouped = Page("<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl>").root
    assert grouped.expression() == "<page><dl>(<dt>TEXT</> <dd>TEXT</>)+</></>"


@pytest.mark.parametrize("split", [1, 4])
def test_template_text_without_an_article(split):
    """What all pages of a host say is template; order and division of pages don't matter."""
    sources = [f"<body><div class=top>Same words</div><div class=x>Own {k} and more words than the top has</div><ul class=l><li><a href=1>link {k}</a></li></ul></body>" for k in range(10)]
    assert read(sources, split) == [f"Own {k} and more words than the top has" for k in range(10)]
    assert read(sources[:1]) == ["Same words\nOwn 0 and more words than the top has"]


def test_slots_come_from_the_alignment(monkeypatch):
    """Blocks of equal tag path are told apart by their place in the wrapper, with optional blocks between; without alignment the template stays."""
    story = "a story of its own with quite a few words"
    extra = ("<h3>Now</h3>", "<pre>code</pre>", "<blockquote>So</blockquote>", "<h4>Then</h4>")
    rest = ["".join(x for j, x in enumerate(extra) if k >> j & 1) for k in range(16)]  # no two pages have one form
    sources = [f"<body><div>Same words</div>{rest[k]}<h2>Title {k}</h2><div>{story} {k}</div><table><tr><td>z</table><div>Read on</div></body>" for k in range(16)]
    got = read(sources, 3)
    assert not any("Same words" in g or "Read on" in g for g in got)
    assert all(g.endswith(f"Title {k}\n{story} {k}") for k, g in enumerate(got))
    monkeypatch.setattr(pages, "aligned", lambda a, b: a)
    assert all(g.startswith("Same words") for g in read(sources))


def test_names_of_containers_decide_nothing():
    for name in ("has-sidebar", "nav-open", "no-sidebar", "with-comments", "sidebar"):
        assert read([f'<body class="{name}"><div class="menu"><a href=1>menu</a></div><article><h1>T</h1><p>text</p></article></body>']) == ["T\ntext"]
    assert read(['<div class="comments-wrapper"><p>all the text there is</p></div>']) == ["all the text there is"]
    inside = '<article><h1>T</h1><p class="notice">a notice that is prose</p><div class="share"><p>Shared</p></div><div class="ad">Buy</div><p>text of the article, long enough</p><section id="comments"><p>First!</p></section></article>'
    assert read([inside]) == ["T\na notice that is prose\nShared\ntext of the article, long enough"]
    assert read(['<div class="ad">Buy it</div><div><p>a page without an article but with text</p></div><div class="site-footer">Us</div>']) == ["a page without an article but with text"]


def test_text_of_an_article_is_never_the_same():
    """Copies of an article that differ in an advert keep its text, in an article or not."""
    assert set(read([f"<body><p>Offer {k}</p><article><p>The story</p></article></body>" for k in range(12)])) == {"The story"}
    assert set(read([f"<body><section>Offer {k}</section><p>The story that is told</p></body>" for k in range(8)])) == {f"Offer {k}\nThe story that is told" for k in range(8)}
    assert read(["<body><div>One page</div><h2>a</h2></body>"] * 20) == ["One page\na"] * 20


def test_pages_without_text_or_path_keep_the_template():
    sources = [f"<body><div class=top>Same words</div><div class=x>Own {k} with some more words</div></body>" for k in range(20)]
    assert read([*sources, None, "", "<p>broken"]) == [*(f"Own {k} with some more words" for k in range(20)), "", "", "broken"]


@pytest.mark.parametrize("deep", [70, 1_005, 5000])
def test_marks_and_ends_of_deep_blocks(deep):
    assert read(["<div>" * deep + "<nav>menu</nav><p>text</p>" + "</div>" * deep]) == ["text"]
    assert read(["<div>" * deep + "<nav>menu</nav><article><p>Story</p></article>x" + "</div>" * deep]) == ["Story"]
    assert read(["<article>" + "<div>" * deep + "a" + "</div>" * deep + "<p>b</p></article>c"]) == ["a\nb"]
    nested = "<article><div>" + "<section><div>" * deep + "<div>in</div>" * 3 + "</div></section>" * deep + "</div>after</article>out"
    assert read([nested] * 2) == ["in\nin\nin\nafter"] * 2
    assert read(["<aside>" + "<div>" * deep + "<aside>x</aside>y" + "</div>" * deep + "z</aside>told"]) == ["told"]


def test_common_host(spark):
    """A host of most pages, in many partitions, has one wrapper; all its pages are read with it."""
    rows = [(k, "http://big.org/" if k % 9 else f"http://h{k}.org/", f"<body><div>Same words</div><h2>T{k}</h2><div>Own {k} and some more words</div></body>") for k in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(30)
    got = {r["page_id"]: r["text"] for r in pages.extract(df).collect()}
    assert got == {k: f"{'' if k % 9 else 'Same words' + chr(10)}T{k}\nOwn {k} and some more words" for k in range(400)}
    found = {r["host"]: r for r in pages.wrappers(df).collect()}
    assert found["big.org"]["pages"] == 355 and found["big.org"]["n_template"] == 1


def text(html):
    """The text of a page that is alone on its host."""
    host = pages.Host()
    host.add(pages.Page(html))
    return pages.Wrapper(pages.Host.load(host.dump())).text(html)


@pytest.mark.parametrize("deep", [5, 990, 1_010, 5_000])
def test_depth_decides_nothing(deep):
    own = "<div class='comments'><div><p>only text of the page</p></div></div>"
    assert text("<div>" * deep + own + "</div>" * deep) == "only text of the page"
    both = "<article><p>the article says this</p></article><div class='comments'><p>a reader says that</p></div>"
    assert text("<section>" * deep + both + "</section>" * deep) == "the article says this"


def test_hidden_is_an_attribute():
    assert text("<div title='is hidden here'><p>shown</p></div><p data-x=hidden>too</p>") == "shown\ntoo"
    assert text("<p>shown</p><div hidden><p>not</p></div><div hidden=''>nor this</div><div class='a' HIDDEN>nor that</div>") == "shown"


def test_forms():
    assert text("<form id='page'><h1>Title</h1><p>All of a page can be in a form.</p><input name='x'><select><option>1</option></select></form>") == "Title\nAll of a page can be in a form."
    assert text("<div><p>The text of the page.</p></div><form><label>Your name</label><input></form>") == "The text of the page."
    assert text("<form><label>Search</label></form>") == ""


def test_comments_and_titles():
    assert text("<title>Site</title><p>words</p>") == "words"
    assert text("<div><p>The page.</p></div><div id='disqus_thread'><p>first!</p></div>") == "The page."
    page = "<article><h1>Head</h1><p>The article.</p></article><div class='user-comments'><article class='comment'><p>first!</p></article><article class='comment'><p>second!</p></article></div>"
    assert text(page) == "Head\nThe article."
    assert text("<main><h1>T</h1></main><div>body</div>") == "T\nbody"


def site(rng, n):
    """Pages of one made-up host with what their text is, by construction."""
    words = lambda k: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "and", "of"]) for _ in range(k))
    box, side, foot = rng.choice(["div", "section", "td"]), rng.choice(["sidebar", "widget-menu", "advert"]), words(6)
    menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in ("home", "news", "about"))
    wraps = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), (f"<{box} class='post'>", f"</{box}>")])
    for _ in range(n):
        own = [f"{words(3)} {rng.random()}"] + [words(rng.randint(5, 40)) for _ in range(rng.randint(2, 9))]
        body = f"<h1>{own[0]}</h1>" + "".join(rng.choice(["<p>{}</p>", "<p>\n {} </p>", "<blockquote>{}</blockquote>"]).format(t.replace(" and ", " <b>and</b>\n  ")) for t in own[1:])
        asides = f"<div class='{side}'><p>{words(4)}</p></div>" if rng.random() < 0.7 else ""
        notes = f"<div id='comments'><div><p>{words(8)}</p></div></div>" if rng.random() < 0.5 else ""
        yield f"<html><head><title>{own[0]}</title></head><body><nav><ul>{menu}</ul></nav>{asides}{wraps[0]}{body}{wraps[1]}{notes}<footer>{foot}</footer><script>var x = '<p>no</p>';</script></body></html>", "\n".join(own)


def test_made_sites(spark):
    """Texts are known by construction; all of all pages must come out, whatever the host's style."""
    rng = random.Random(12)
    rows, want = [], {}
    for host in range(25):
        for page, (html, own) in enumerate(site(rng, rng.choice([1, 2, 12]))):
            key = f"{host}-{page}"
            rows.append((key, f"http://h{host}.example/{page}", html))
            want[key] = own
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert got == want

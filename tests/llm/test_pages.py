from turnout.llm import pages


def text(source, path=None):
    return pages.extracted(pages.parsed(source), path)


def test_leaves_out_what_is_no_article():
    source = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>x</article>";</script></head><body class="has-sidebar">
    <header><a href="/">Home</a></header><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use cookies</div>
    <main><article class="post-17"><h1>Head &amp; line</h1><p>First <b>bo</b>ld
    text.<p>Second&nbsp;one<br>goes   on.<aside>Side</aside><form>Name <input></form><div class="ad">Buy</div><!-- no <p>no</p> -->
    <noscript>no</noscript><blockquote>Said</blockquote></article><section id="comments"><p>Reader says a lot of things here, at length, more than all.</p></section></main>
    <footer>&copy; me</footer></body></html>"""
    assert text(source) == "Head & line First bold text. Second one goes on. Said"


def test_awkward_sources():
    assert text("") == ""
    assert text("plain words &lt; more") == "plain words < more"
    assert text("<p>open <b>tags <i>never closed") == "open tags never closed"
    assert text("<article><p>cut off <a href=\"x") == "cut off"
    assert text("<script>never closed <p>no") == ""
    assert text("<article>a<!-- open") == "a"
    assert text("</div></p>x</article>") == "x"
    assert text('<div hidden>h</div><article>y<p class="advert">ad</p>z<span class="share">s</span></article>') == "y z"
    assert text("<article><p>1 < 2 and 3 > 2</p></article>") == "1 < 2 and 3 > 2"
    for source in ("<" * 20_000, "<a " * 20_000, "<p" + " x='" * 10_000, "<div>" * 3_000 + "deep" + "</div>" * 3_000, "&" * 20_000):
        pages.parsed(source)


def test_words_of_classes_are_evidence_only():
    body = "<p>The whole article stands here.</p>"
    for wrapper in ("social-post", "notice-of-meeting", "share-price-report", "widget", "social", "related"):
        assert text(f"<body><div class='{wrapper}'>{body}</div></body>") == "The whole article stands here."
    inside = "<article><p>one</p>{}<p>two and some more words</p></article>"
    for kept in ("<p class='share-price'>9</p>", "<p id='notice-of-meeting'>9</p>", "<h2 class='skip-lunch'>9</h2>", "<p class='related'>9</p>",
                 "<fieldset>9</fieldset>", "<label>9</label>", "<div class='social-post'>9</div>"):
        assert text(inside.format(kept)) == "one 9 two and some more words"
    for gone in ("<div class='ad-slot'>9</div>", "<div class='ad-300x250'>9</div>", "<section class='post-comments'>9</section>", "<div id='comments-area'>9</div>",
                 "<ul class='social-links'><li>9</ul>", "<div class='related-posts'>9</div>", "<form><fieldset><label>9</label></fieldset></form>", "<p class='ad'>9</p>",
                 "<div class='cookie-notice'>9</div>", "<div class='share'>9</div>"):
        assert text(inside.format(gone)) == "one two and some more words"
    comments = "<div class='comments'>" + "<p>a reader's word</p>" * 10 + "</div>"
    assert text(f"<body><div class='story'><p>{'A story of many words. ' * 5}</p></div>{comments}</body>") == ("A story of many words. " * 5).strip()


def test_deep_and_broken_pages_take_linear_time():
    import time
    for source in ("<div>" * 100_000 + "deep" + "</div>" * 100_000, "<section>" * 10_000 + "</span>" * 100_000 + "deep", "<div>" * 50_000 + "</b></p></main>" * 30_000 + "deep"):
        start = time.time()
        page = pages.parsed(source)
        assert sum(map(len, {c.path for c in page.containers})) < 10_000_000 and text(source) == "deep"
        pages.votes(page)
        assert time.time() - start < 10


def plain_winner(sources):
    """A host's path by loops over its pages: most votes, then the nearest around it that is complete on half of its pages."""
    total, seen, full = {}, {}, {}
    for source in sources:
        for path, (n, whole) in pages.votes(pages.parsed(source)).items():
            total[path] = total.get(path, 0) + n
            seen[path] = seen.get(path, 0) + 1
            full[path] = full.get(path, 0) + whole
    best = min(total, key=lambda p: (-total[p], p))
    around = [p for p in total if (p == best or best.startswith(p + "/")) and 2 * full[p] >= seen[best]]
    return max(around, key=lambda p: (len(p), p), default=best)


def test_votes_equal_a_plain_count(spark):
    import random
    own = random.Random(3)
    words = lambda n: " ".join(own.choice("some more words of a text".split()) for _ in range(n))
    rows = []
    for h in range(12):
        names = [own.choice(["story", "post", "lead", "box", "text", "inner"]) for _ in range(4)]
        for n in range(own.randrange(1, 9)):
            parts = "".join(f"<div class='{c}'>{'<section>' * (k % 2)}<p>{words(own.randrange(40))}</p>{'</section>' * (k % 2)}</div>" for k, c in enumerate(names))
            rows.append((100 * h + n, f"http://h{h}.example.com/{n}", f"<body><div class='all'>{parts}</div><div class='{own.choice(names)}'>{words(9)}</div></body>"))
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = {f"h{h}.example.com": plain_winner([r[2] for r in rows if r[0] // 100 == h]) for h in range(12)}
    assert {r["host"]: r["path"] for r in pages.winning(pages.path_votes(table)).collect()} == want
    got = {r["page_id"]: r["text"] for r in pages.main_text(table).collect()}
    assert got == {i: text(source, want[url.split("/")[2]]) for i, url, source in rows}


def test_host_consensus(spark):
    good = "<html><body><div class='wrap'><div class='story story-{n}'><p>{text}</p></div></div><div class='box'><p>{other}</p></div></body></html>"
    rows = [(n, f"http://a.example.com/{n}", good.format(n=n, text="long story words " * 30, other="short"), "x") for n in range(8)]
    # on this page alone the box would win
    rows.append((8, "http://a.example.com/8", good.format(n=8, text="brief story", other="box words " * 60), "x"))
    rows += [(9, None, "<article>null url</article>", "x"), (10, "http://b.example.com/", None, "x"), (10, "http://b.example.com/", None, "x"),
             (11, "nowhere", "", "x"), (12, "http://a.example.com/12", "<p>other layout</p>", "x"), (None, "http://A.example.com:80/", "<article>é</article>", "x")]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string, path string")
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in pages.main_text(table).collect()}
    assert pages.main_text(table).count() == len(rows)
    assert got[8, "http://a.example.com/8"] == ("brief story", 11)
    assert got[0, "http://a.example.com/0"][0] == ("long story words " * 30).strip()
    assert got[9, None] == ("null url", 8) and got[10, "http://b.example.com/"] == ("", 0) and got[11, "nowhere"] == ("", 0)
    assert got[12, "http://a.example.com/12"][0] == "other layout" and got[None, "http://A.example.com:80/"] == ("é", 1)
    assert pages.main_text(table.limit(0)).count() == 0


def test_parts_without_article(spark):
    """An article without article or main that lies in differently classed parts."""
    parts = "<html><body><div class='top'><a href='/'>Home of all pages</a></div><div class='post'><div class='lead'>{lead}</div><div class='text'>{text}</div></div>{box}</body></html>"
    lead, body = "lead words " * 30, "body words " * 70
    rows = [(n, f"http://c.example.com/{n}", parts.format(lead=f"{n} {lead}", text=body, box="<div class='box'>few</div>")) for n in range(6)]
    rows.append((6, "http://alone.example.com/", parts.format(lead=f"6 {lead}", text=body, box="")))
    inside = "<body><main><div class='lead'>{lead}</div><div class='text'>{text}</div></main><div class='box'>{box}</div></body>"
    rows += [(n, f"http://m.example.com/{n}", inside.format(lead=f"{n} lead", text=body, box="box words " * 9)) for n in range(7, 10)]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert {n: got[n] for n in range(7)} == {n: f"{n} {lead}{body}".strip() for n in range(7)}
    assert all("box" not in got[n] for n in range(7, 10))
    assert text(rows[6][2]) == f"6 {lead}{body}".strip()
    linked = "<div class='post'>" + "<a href='/'>a link of the post</a> " * 30 + f"<div class='lead'>{lead}</div><div class='text'>{body}</div></div>"
    assert text(linked).endswith(f"{lead}{body}".strip())


def test_given_pages(spark):
    """The given pages have one article each; what stands in it is the text."""
    import html
    import re

    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in table.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        inner = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))
        want[r["page_id"]] = " ".join(html.unescape(inner).split())
    assert {r["page_id"]: r["text"] for r in pages.main_text(table).collect()} == want

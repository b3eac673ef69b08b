import re
from collections import Counter

import duckdb

from turnout.llm import urls


def plain(rows, rules=urls.RULES, damping=urls.DAMPING, rounds=urls.ROUNDS, threshold=urls.THRESHOLD):
    """Verdicts by loops over dictionaries."""
    def cut(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        return host.translate(low), re.match(r"[^?#]*", rest[len(host):])[0]

    def said(host, path):
        fit = [(len(r), r, v) for v, r in rules for name, rest in [r.split("/", 1)]
               if (host == name or host.endswith("." + name)) and path.startswith("/" + rest)]
        return max(fit)[1:] if fit else (None, None)

    shares, edges = {}, Counter()
    for _, url, html in rows:
        host, path = cut(url)
        if host:
            shares.setdefault(host, []).append({"allow": 1, "block": -1, None: 0}[said(host, path)[1]])
            for to in {t.lower() for t in re.findall(r"""<a\s[^>]*?href=["']?(?:https?:)?//([^/?#"'\s>]+)""", html or "", re.I)}:
                if to != host:
                    edges[host, to] += 1
    seed = {h: sum(s) / len(s) for h, s in shares.items()}
    for pair in edges:
        for h in pair:
            seed.setdefault(h, {"allow": 1.0, "block": -1.0, None: 0.0}[said(h, "/")[1]])
    scores = {}
    for kind, sign in (("trust", 1), ("distrust", -1)):
        ways = {(a, b) if sign > 0 else (b, a): n for (a, b), n in edges.items()}
        out = Counter()
        for (a, _), n in ways.items():
            out[a] += n
        first = {h: max(0.0, sign * s) for h, s in seed.items()}
        now = dict(first)
        for _ in range(rounds):
            new = dict(first)
            for (a, b), n in ways.items():
                new[b] += damping * now[a] * n / out[a]
            now = new
        scores[kind] = now
    result = []
    for page_id, url, _ in rows:
        host, path = cut(url)
        rule, verdict = said(host, path)
        if verdict is None:
            verdict = "block" if host and scores["distrust"][host] - scores["trust"][host] >= threshold else "allow"
        result.append((page_id, host, path, rule, verdict))
    return sorted(result, key=str), scores


def page(n, url, *links):
    return n, url, "".join(f'<p><a class=x href="{link}">t</a></p>' for link in links)


ROWS = [
    page(1, "http://spam.example.net/es/1"), page(2, "http://spam.example.net/fr/2"), page(3, "http://spam.example.net/en/3"),
    page(4, "http://friend.org/a", "http://spam.example.net/x", "//SPAM.example.net/y", "/own"),
    page(5, "http://friend.org/b", "http://spam.example.net/x"), page(6, "http://friend.org/c"),
    page(7, "http://good.org/", "http://neutral.org/"), page(8, "http://www.shop.com/", "http://good.org/", "http://neutral.org/"),
    page(9, "http://neutral.org/q?x=1#y"), page(10, "HTTP://WWW.Example.COM/en/z?u"), page(11, "http://a.example.com/en/z"),
    page(12, "http://example.com"), page(13, "no scheme"), (14, None, None), (14, None, None), (15, "http://q.net/es", ""), (16, "x://", None),
    page(17, "http://x.co/a?b/c", "http://seen-only.net/es/1", "http://far.com"), (None, "http://notexample.com/en/", "<a href='http://good.org'>"),
]
SCHEMA = "page_id bigint, url string, html string, host string, rule string, seed string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def test_verdicts_equal_plain_loops(spark):
    want, scores = plain(ROWS)
    got = sorted((tuple(r) for r in urls.url_verdicts(table(spark, ROWS)).collect()), key=str)
    assert got == want
    verdicts = {(r[0], r[1]): r[4] for r in got}
    assert verdicts[3, "spam.example.net"] == "block" and verdicts[6, "friend.org"] == "block" and verdicts[9, "neutral.org"] == "allow"
    edges = urls.host_edges(table(spark, ROWS))
    spread = {r["host"]: r for r in urls.spread(edges, urls.host_seeds(table(spark, ROWS), edges)).collect()}
    for host, row in spread.items():
        assert abs(row["trust"] - scores["trust"][host]) < 1e-4 and abs(row["distrust"] - scores["distrust"][host]) < 1e-4
    assert urls.url_verdicts(table(spark, ROWS).limit(0)).count() == 0


def test_walks_go_on_until_they_settle(spark):
    """A chain of 60 hosts behind a crowd that seeds it, and a ring that mass stays in: far hosts are still reached."""
    seeds = [(f"s{n}.com", 1.0) for n in range(300)] + [(f"h{n}", 0.0) for n in range(60)] + [(f"r{n}", float(n == 0)) for n in range(3)]
    edges = [(f"s{n}.com", "h0", 1) for n in range(300)] + [(f"h{n}", f"h{n + 1}", 2) for n in range(59)] + [(f"r{n}", f"r{(n + 1) % 3}", 1) for n in range(3)]
    got = {r["host"]: r["trust"] for r in urls.spread(spark.createDataFrame(edges, "src string, dst string, pages bigint"),
                                                      spark.createDataFrame(seeds, "host string, seed double")).collect()}
    for n in range(60):
        assert abs(got[f"h{n}"] - 300 * 0.85 ** (n + 1)) < 1e-4
    assert abs(got["r0"] - 1 / (1 - 0.85 ** 3)) < 1e-4


def test_links_are_found_in_linear_time(spark):
    import time
    rows = [(1, "http://a.org/", "<a " * 200_000 + "<a href='//b.org/'>"), (2, "http://a.org/", "<a href=" + " " * 200_000 + "x"), (3, "http://a.org/", "<a " + "href " * 100_000)]
    start = time.time()
    assert [tuple(r) for r in urls.host_edges(table(spark, rows)).collect()] == [("a.org", "b.org", 1)]
    assert time.time() - start < 20


def test_oracle_on_linked_pages(spark):
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", ROWS)
    assert sorted((tuple(r) for r in con.execute(urls.oracle()).fetchall()), key=str) == plain(ROWS)[0]

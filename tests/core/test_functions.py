"""URLs, text, HTML, scoring and language by example."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkrisk.functions import clock, html, language, scoring, urls
from linkrisk.rules import Rules, RulesError, from_mapping


@pytest.mark.parametrize(
    "raw, base, want",
    [
        ("HTTPS://Shop.Example.TEST:443/a?utm_source=x&b=1#top", None, "https://shop.example.test/a?b=1"),
        ("http://user:pw@host.test:8080", None, "http://host.test:8080/"),
        ('"<//host.test/x>"', None, "https://host.test/x"),
        ("host.test/p?q=", None, "https://host.test/p?q="),
        ("host:81/x", None, None),
        ("/go?x=1", "https://a.test/dir/page", "https://a.test/go?x=1"),
        ("javascript:alert(1)", None, None),
        ("#top", "https://a.test/", None),
        ("http://host.test:99999/", None, None),
        ("http://[::1/", None, None),
        ("http://127.0.0.1/x", None, "http://127.0.0.1/x"),
        ("http://localhost/", None, None),
        ("http://under_score.test/", None, None),
        ("http://bücher.test/", None, "http://xn--bcher-kva.test/"),
        ("http://host.123/", None, None),
        ("ftp://host.test/", None, None),
        ("", None, None),
        (None, None, None),
        ("http://a.test/?q=a|b&fbclid=9&c=~*", None, "http://a.test/?q=a%7Cb&c=~%2A"),
    ],
)
def test_canonical(raw, base, want):
    assert urls.canonical(raw, base) == want


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_canonical_is_stable_and_never_raises(text):
    once = urls.canonical(text)
    assert once is None or urls.canonical(once) == once
    urls.canonical(text, "https://a.test/x/")


@pytest.mark.parametrize("name, want", [("a.b.c.co.kr", "c.co.kr"), ("co.kr", "co.kr"), ("x.github.io", "x.github.io"), ("www.site.test", "site.test"), ("10.0.0.1", "10.0.0.1"), ("one", "one")])
def test_domain(name, want):
    assert urls.domain(name) == want


def test_native_parts_agree_with_python(spark):
    data = ["https://m.shop.co.kr:8443/a/b/?q=1#x", "http://10.0.0.1/", "https://one.test", "http://user@h.two.test/p//", "nonsense"]
    df = spark.createDataFrame([(u,) for u in data], "url string")
    h = urls.host_of(F.col("url"))
    rows = df.select("url", h.alias("h"), urls.domain_of(h).alias("d"), urls.tld_of(h).alias("t"), urls.root_of(F.col("url")).alias("r"), urls.path_length_of(F.col("url")).alias("n")).collect()
    for r in rows:
        assert (r.h, r.d) == (urls.host(r.url), urls.domain(urls.host(r.url)))
    by = {r.url: r for r in rows}
    assert (by[data[0]].r, by[data[0]].n, by[data[0]].t) == ("https://m.shop.co.kr:8443/", 7, "kr")
    with pytest.raises(ValueError):
        urls.group_key(F.col("url"), "planet")


@pytest.mark.parametrize(
    "text, want",
    [
        ("go to abc[.]com now", ["https://abc.com/"]),
        ("hxxp://bad(dot)site.top/x.", ["https://bad.site.top/x"]),
        ("ａｂｃ．ｃｏｍ", ["https://abc.com/"]),
        ("win . club today", ["https://win.club/"]),
        ("Sale ends soon. Shop now", []),
        ("mail me at me@host.com", []),
        ("see index.php and a.b", []),
        ("접속abc.com 접속", []),
        ("http://x.xyz/a http://x.xyz/a", ["http://x.xyz/a"]),
        ("a·site·com", ["https://a.site.com/"]),
    ],
)
def test_urls_in_text(text, want):
    assert urls.urls_in(text) == want


def test_unwrapped():
    assert urls.unwrapped("https://a.test/go?id=3&url=https%3A%2F%2Fb.test%2Fx") == "https://b.test/x"
    assert urls.unwrapped("https://a.test/go?url=https://www.a.test/x") is None
    assert urls.unwrapped("https://a.test/go?q=short.x") is None


PAGE = """<html><head><title>Best \x01 list</title><meta name="Description" content="verified ranking">
<meta http-equiv="refresh" content="5; url=https://fresh.test/"></head><body><h1>Top</h1>
<div><p>Casino of the year, go there: <a href="https://one.test/?utm_source=q" title="Live"><img src="/i/big-win_24.png" alt="WIN"></a></p></div>
<ul><li><a href="https://two.test/">two</a><li><a href="https://three.test/">three</a><li><a href="https://four.test/">four</a></ul>
<span data-href="https://five.test/">five</span><img data-src="https://no.test/a"><div data-src="https://six.test/">lazy</div>
<button onclick="window.open('https://seven.test/x')">open</button><iframe src="//eight.test/f" title="frame"></iframe>
<script>location.href = "https://nine.test/"; var u = 'https://ten.test/q';</script>
Visit eleven[.]top or mail a@twelve.com <!-- https://hidden.test --> <a href="/list?page=2">next</a> <a href="https://two.test/">Two again, longer</a>
<form><input type="password"></form></body></html>"""


def test_links_of_a_page():
    page = html.read_links(PAGE, "https://src.test/list", ("page=",))
    links = {x["url"]: x for x in html.folded(page.links)}
    assert page.title == "Best list" and page.internal == ["https://src.test/list?page=2"]
    assert set(links) == {f"https://{n}.test/" for n in ("one", "two", "three", "four", "five", "six", "nine", "fresh")} | {"https://seven.test/x", "https://eight.test/f", "https://ten.test/q", "https://eleven.top/"}
    one = links["https://one.test/"]
    assert one["banner"] and one["anchor_text"] == "WIN big win 24 Live" and one["context_text"].startswith("Casino of the year")
    assert links["https://three.test/"]["context_text"] == ""
    assert links["https://two.test/"]["anchor_text"] == "Two again, longer"
    assert [links[u]["method"] for u in ("https://five.test/", "https://seven.test/x", "https://eight.test/f", "https://nine.test/", "https://eleven.top/", "https://fresh.test/")] == ["data_attr", "js_onclick", "iframe", "js_script", "text", "meta_refresh"]


def test_folding_keeps_texts_and_banner():
    s = [
        {"url": "u", "anchor_text": "", "context_text": "around", "method": "iframe", "banner": True},
        {"url": "u", "anchor_text": "name", "context_text": "", "method": "a_href", "banner": False},
        {"url": "u", "anchor_text": "much longer", "context_text": "zzz", "method": "text", "banner": False},
    ]
    assert html.folded(s) == [{"url": "u", "anchor_text": "name", "context_text": "around", "method": "a_href", "banner": True}]


def test_references_by_name_need_their_semicolon():
    page = """<title>A &amp;&amp</title><h1>&quot;x&quot <b>&copy</b>&copy;</h1><meta name="description" content="a&amp;b&reg">
    <p>&amp;amp; &ampx; &am &#65; &middot;</p><a href="https://out.test/?a=1&copy=2&amp;b=3">to</a><script>location.href = "https://go.test/?a=1&amp=2"</script>"""
    s = html.read_signals(page)
    assert (s["title"], s["headings"], s["meta_description"]) == ("A &&amp", '"x&quot &copy ©', "a&b&reg")
    assert s["text"].endswith("&amp; &ampx; &am A · to")
    links = {x["method"]: x["url"] for x in html.read_links(page, "https://src.test/").links}
    assert links == {"a_href": "https://out.test/?a=1&copy=2&b=3", "js_script": "https://go.test/?a=1&amp=2"}


def test_signals_and_redirects():
    s = html.read_signals(PAGE)
    assert (s["title"], s["headings"], s["meta_description"], s["has_password_input"]) == ("Best list", "Top", "verified ranking", True)
    assert "nine.test" not in s["text"] and "Casino" in s["text"]
    assert html.redirect_in(PAGE, "https://src.test/") == "https://fresh.test/"
    assert html.redirect_in("<script>location.replace('/x')</script>", "https://src.test/") is None
    for odd in (None, "", "<", "<a href=", "<![broken", "<p><b>open" * 50):
        html.read_links(odd, "https://src.test/")
        html.read_signals(odd)


@pytest.mark.parametrize(
    "body, declared, want",
    [("한글".encode("cp949"), "EUC-KR", ("한글", "cp949")), ("é".encode(), None, ("é", "utf-8")), (b"<meta charset=euc-kr>" + "가".encode("cp949"), "utf-8", ("<meta charset=euc-kr>가", "cp949")), (b"\xff\xff\xff", "ascii", ("���", "utf-8")), (None, None, ("", "utf-8"))],
)
def test_decoded(body, declared, want):
    assert html.decoded(body, declared) == want


MINI = from_mapping(
    {
        "categories": {"a": {"label": "A", "keywords": {"one": 20, "onetwo": 22, "far": 10}}, "b": {"label": "B", "keywords": {"one": 20, "other": 70}}, "z": {"keywords": {"off": 0}}},
        "domain_patterns": [{"pattern": "^x\\d", "score": 20, "reason": "x"}],
        "suspicious_tlds": {"top": 8},
        "contact_domains": ["talk.test"],
        "exclude": {"domains": ["known.test", "github.io"], "domain_suffixes": [".gov"], "url_patterns": [r"\.png$"]},
    }
)


def verdicts(spark, rows, rules=MINI):
    df = spark.createDataFrame(rows, "url string, anchor string, context string")
    return [r.v for r in scoring.with_verdict(df, F.col("url"), F.col("anchor"), F.col("context"), rules).collect()]


def test_scores(spark):
    got = verdicts(
        spark,
        [
            ("https://p.test/", "ONETWO", ""),  # nested words count, the earlier category wins
            ("https://p.test/", "", "far"),  # 15 + 3.5 = 18.5, to even
            ("https://p.test/", "one", "other"),  # a word in the anchor decides by anchor, then context
            ("https://x1.top/", "", ""),
            ("https://p.test/", "other", ""),  # capped
            ("https://talk.test/x", "one", ""),
            ("https://known.test/", "one", ""),
            ("https://a.github.io/", "", ""),  # a site of its own below the suffix
            ("https://s.gov/one", "", ""),
            ("https://p.test/one.png", "", ""),
            ("https://one.test/", None, None),
        ],
    )
    assert [(v.score, v.category) for v in got] == [(57, "a"), (18, "a"), (60, "b"), (43, "unknown"), (75, "b"), (15, "contact"), (0, "unknown"), (15, "unknown"), (0, "unknown"), (0, "unknown"), (22, "a")]
    assert got[0].matched_keywords == ["one", "onetwo"] and got[0].reasons == ["keyword: A"]
    assert got[3].reasons == ["x", ".top"] and got[5].always_keep
    assert [v.exclusion_reason for v in got[6:10]] == ["excluded domain", None, "excluded suffix .gov", "pattern"]


@pytest.mark.parametrize("n, want", [(0, 50), (1, 50), (2, 56), (5, 74), (10, 74)])
def test_final_score(spark, n, want):
    assert spark.range(1).select(scoring.final_score(F.lit(50), F.lit(n), Rules()).alias("s")).first().s == want


def test_risk_tiers_and_vocabulary(spark):
    tiers = ((1, 12), (3, 36))
    row = spark.range(1).select(
        *[scoring.risk_label(F.lit(s), Rules()).alias(f"r{s}") for s in (24, 25, 64, 65)],
        *[scoring.tiered(F.lit(v), tiers).alias(f"t{v}") for v in (0, 1, 2, 3, 9)],
        scoring.vocabulary(F.lit("The BEST page"), ("best", "no", "page")).alias("v"),
    ).first()
    assert [row.r24, row.r25, row.r64, row.r65] == ["low", "medium", "medium", "high"]
    assert [row.t0, row.t1, row.t2, row.t3, row.t9] == [0, 12, 12, 36, 36] and row.v == ["best", "page"]


def test_promotion_score(spark):
    f = lambda known, out, kinds, hits, ratio, login: scoring.promotion_score(*[F.lit(x) for x in (known, out, kinds, hits, ratio, login)], Rules())
    row = spark.range(1).select(f(5, 6, 3, 6, 1.0, False).alias("a"), f(0, 6, 3, 6, 1.0, False).alias("b"), f(0, 0, 1, 0, 0.0, True).alias("c"), f(3, 6, 3, 6, 1.0, False).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (94, 44, 0, 80)


def test_rule_packs():
    assert from_mapping({"scoring": {"base_score": "x"}}).base_score == 15
    for bad in ({"domain_patterns": [{"pattern": "("}]}, []):
        with pytest.raises(RulesError):
            from_mapping(bad)


def test_language(spark):
    ko = "가나다라마바사아자차" * 4
    pages = [("<html lang=en>" + ko, ""), ("<html lang='ko-KR'>short", ""), ("<p>" + "word " * 20, "utf-8"), ("<p>few", ""), ("<p>few", "EUC-KR"), ("<script>" + "x" * 90 + "</script>", ""), (None, ""), ("<meta http-equiv=content-language content=ko>", "")]
    got = spark.createDataFrame(pages, "h string, e string").select(language.page_verdict(F.col("h"), F.col("e")).alias("v")).collect()
    assert [r.v for r in got] == ["ko", "ko", "foreign", "unknown", "ko", "unknown", "unknown", "ko"]
    row = spark.range(1).select(language.hangul_ratio(F.lit(ko + "a" * 40)).alias("r"), language.hangul_ratio(F.lit("가나")).alias("s"), language.tld_verdict(F.lit("kr")).alias("t"), language.tld_verdict(F.lit("jp"), foreign=("jp",)).alias("f"), language.keeps(F.lit("unknown")).alias("k"), language.keeps(F.lit("foreign")).alias("n")).first()
    assert (row.r, row.s, row.t, row.f, row.k, row.n) == (0.5, 0.0, "ko", "foreign", True, False)


def test_clock(spark):
    row = spark.range(1).select(*[clock.duration(F.lit(s).cast("double")).alias(f"d{i}") for i, s in enumerate((3723, 0, 60, -1, None))], clock.iso(clock.parse(F.lit("2026-01-02T03:04:05Z"))).alias("i"), clock.parse(F.lit("no")).alias("p")).first()
    assert [row[f"d{i}"] for i in range(5)] == ["1시간 2분 3초", "0초", "1분", "-", "-"]
    assert row.i == "2026-01-02T03:04:05Z" and row.p is None

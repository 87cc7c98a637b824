import duckdb

from docket.llm import urlfilter
from docket.llm.queries import ORACLE_SQL, URL_RULES, op4_url_filters


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    cols = "page_id, host, path, rule, verdict"
    want = sorted(map(str, con.sql(f"SELECT {cols} FROM ({ORACLE_SQL['op4_url_filters']})").fetchall()))
    assert sorted(str(tuple(r)) for r in op4_url_filters(spark, sf_dir).collect()) == want


PAGES = [
    (1, "http://x.com/de/1", None),
    (2, "https://y.net/a", '<link rel="canonical" href="http://x.com/de/1">'),
    (3, "https://y.net/b", "<meta http-equiv='refresh' content='0; url=/a'>"),
    (4, "https://z.org/c", '<link href="https://y.net/b" rel=canonical>'),
    (5, "https://free.net/", ""),
    (6, None, "<p>"),
    (7, "no scheme", None),
    (8, "HTTP://Y.net/a/?utm_source=q#top", None),
    (8, "HTTP://Y.net/a/?utm_source=q#top", None),
    (9, "https://sub.example.org/en/12", None),
    (10, "https://example.com", None),
]


def test_blocks_spread_and_allows_stay(spark):
    pages = spark.createDataFrame([(*p, "h", "v") for p in PAGES], "page_id long, url string, html string, host string, verdict string")
    got = {r.page_id: r for r in urlfilter.judge(pages, URL_RULES).collect()}
    assert [got[i].verdict for i in (1, 2, 3, 8, 9)] == ["block"] * 5
    assert got[4].verdict == "allow" and got[4].rule == "org/"  # an explicit allow stays
    assert got[5].verdict == got[6].verdict == got[7].verdict == got[10].verdict == "allow"
    assert (got[6].host, got[6].path, got[7].host) == ("", "", "") and got[8].host == "y.net" and got[9].rule == "example.org/en/1"
    assert urlfilter.judge(pages, URL_RULES).count() == len(PAGES)


def test_redirect_table_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", None)], "page_id long, url string, html string")
    moved = spark.createDataFrame([("http://a.net/x", "http://b.com/de/")], "url string, target string")
    assert urlfilter.judge(pages, URL_RULES, moved).first().verdict == "block"
    assert urlfilter.judge(pages.limit(0), URL_RULES).count() == 0


def test_own_column_names_clash(spark):
    names = ["blocked", "_u", "_r", "u", "r", "_node", "node", "component", "_component", "key", "target", "tag", "d0", "d1"]
    pages = spark.createDataFrame([(*p, *[f"{n}{p[0]}" for n in names]) for p in PAGES], "page_id long, url string, html string, " + ", ".join(f"{n} string" for n in names))
    plain = {r.page_id: (r.verdict, r.rule, r.host) for r in urlfilter.judge(pages.select("page_id", "url", "html"), URL_RULES).collect()}
    rows = urlfilter.judge(pages, URL_RULES).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        assert (r.verdict, r.rule, r.host) == plain[r.page_id]
        assert [r[n] for n in names] == [f"{n}{r.page_id}" for n in names]


def test_nulls_in_any_column_and_very_long_urls(spark):
    long = "http://x.com/de/" + "a" * 200_000
    pages = spark.createDataFrame([(None, None, None), (1, long, None), (2, "http://y.net/", "x" * 500_000 + f'<link rel="canonical" href="{long}">'), (3, "", "")], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, URL_RULES).collect()}
    assert got == {None: "allow", 1: "block", 2: "block", 3: "allow"}

"""Titles of pages against the SQL, on pages that the smallest tables don't hold."""

import html

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tessera import catalog
from tessera.plans.documents import page_facts

PAGES = [
    None, "", "no markup", "<h1>A &amp; B</h1>", "<h1>cut in a reference&amp</h1>", "<h1>cut &am</h1>", "<h1>a &quot;b&quot; &lt;c&gt; &#8364; &eacute;</h1>", "<h1>&amp;amp;amp; &AMP;</h1>",
    "<title>T &amp; U | Site</title><p>x", "<title>T</title><h1>a<b>c</b></h1>", "<title lang='en'>T</title>", "<h1>a<b>c</b></h1><h1 class='x'>plain</h1>", "<h1 >two\nlines\t</h1>", "<h1\nid='a'>  \u00a0\u2003 spaces  inside \u3000</h1>",
    "<H1>upper</H1><title>t</title>", "<h10>ten</h10>", "<h1>open", "<h1", "<h1></h1><h1>later</h1>", "<h1>first</h1><h1>second</h1>", "<nav><h1>in furniture</h1></nav><h1>body</h1>", "<!-- <h1>comment</h1> --><h1>seen</h1>",
    "<meta property='og:title' content='og'><h1>h</h1>", "<p style='display:none'><h1>hidden</h1></p>", "<h1 title='a>b'>c</h1>", "<h1>é😀\x00z</h1>", "<title>\n t \n</title>", "<h1>$1 \\1</h1>", "<script><h1>s</h1></script><h1>t</h1>",
    "<![foo[x]]><h1>after</h1>", "<![ x]><h1>no name</h1>", "<![!<h1>open section</h1>", "<![if !IE]><h1>if</h1><![endif]>", "<![CDATA[<h1>data</h1>]]>",
]


def test_titles(spark, tmp_path):
    pq.write_table(pa.table({"page_id": pa.array(range(len(PAGES)), pa.int64()), "url": [None] * len(PAGES), "html": pa.array(PAGES, pa.string())}), tmp_path / "pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet')")
    got = dict(map(tuple, catalog.queries()["fa08_html_title"](spark, str(tmp_path)).collect()))
    assert got == dict(duck.execute(catalog.oracle_sql()["fa08_html_title"]).fetchall())


def test_titles_at_the_bench_size(spark):
    sf = "/root/testdata/sf0.1"
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from read_parquet('{sf}/pages.parquet')")
    got = dict(map(tuple, catalog.queries()["fa08_html_title"](spark, sf).collect()))
    assert got == dict(duck.execute(catalog.oracle_sql()["fa08_html_title"]).fetchall())


def test_decoded_title(spark):
    """The title of page_facts is the written one with its references decoded."""
    rows = page_facts(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).select("title", "written_title").collect()
    assert any("&quot;" in r.written_title for r in rows)
    assert [r.title or "" for r in rows] == [" ".join(html.unescape(r.written_title).split()) for r in rows]

from pyspark.sql import functions as F

from sparkscrub.functions import html
from sparkscrub.operators.scrub import scrub_html

CASES = [
    ('<p title="Ann">Ann</p><script>Ann</script><a href="x/Ann">', '<p title="Ann">&lt;P&gt;</p><script>Ann</script><a href="x/&lt;P&gt;">'),
    ("<STYLE>Ann</STYLE >Ann", "<STYLE>Ann</STYLE >&lt;P&gt;"),
    ("<!-- Ann -->", "<!-- <P> -->"),
    ("<b>Ann<br>unclosed < Ann", "<b>&lt;P&gt;<br>unclosed < &lt;P&gt;"),
    ("<input value=Ann name=Ann><meta content='Ann'>", "<input value=&lt;P&gt; name=Ann><meta content='&lt;P&gt;'>"),
    ("<script src=\"Ann.js\">Ann</script>", "<script src=\"&lt;P&gt;.js\">Ann</script>"),
    ('<a data-href="Ann" HREF = "Ann">', '<a data-href="Ann" HREF = "&lt;P&gt;">'),
    ("caf&eacute; AT&amp;T &copy; &bogus;", "café &lt;O&gt; © &amp;bogus;"),
    ("kept &eacute; &copy;", "kept &eacute; &copy;"),
    ("&#65;nn &#x41;nn &#xD800;", "&lt;P&gt; &lt;P&gt; &amp;#xD800;"),
    ('<a href="?a=1&amp;b=Ann&quot;">', '<a href="?a=1&amp;b=&lt;P&gt;&quot;">'),
    ("", ""),
    ("no markup", "no markup"),
]
KEYS = "array(struct('AT&T' AS value, '<O>' AS placeholder), struct('Ann' AS value, '<P>' AS placeholder))"


def test_cases(spark):
    df = spark.createDataFrame(CASES, "h string, e string").withColumn("k", F.expr(KEYS))
    for r in df.withColumn("m", html.mask_html("h", "k")).collect():
        assert r["m"] == r["e"], r["h"]


def test_no_keys_no_change(spark):
    df = spark.createDataFrame(CASES, "h string, e string").withColumn("k", F.expr(f"slice({KEYS}, 1, 0)"))
    assert df.where(html.mask_html("h", "k") != F.col("h")).count() == 0


def test_tokens_lose_nothing(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    same = F.expr(f"array_join({html.tokens_sql('html')}, '') = html")
    assert pages.where(~same).count() == 0


def test_pages_are_scrubbed_where_they_show_values(spark):
    df = spark.createDataFrame([("<p>bob&#64;x.com</p><script>bob@x.com</script>",), (None,)], "html string")
    got = [r["masked"] for r in scrub_html(df).collect()]
    assert got == ["<p>&lt;EMAIL_ADDRESS&gt;</p><script>bob@x.com</script>", None]


def test_text_of_a_page(spark):
    df = spark.createDataFrame([("<p>a &amp; b</p><style>x</style><a href='/u'> </a><!--c-->",)], "h string")
    assert df.select(html.html_text("h")).first()[0] == "a & b\n/u\nc"


def test_brackets_in_text_and_quotes(spark):
    cases = [
        ("<p>if a < b mail bob@x.com and c > d</p>", "<p>if a < b mail &lt;EMAIL_ADDRESS&gt; and c &gt; d</p>"),
        ('<a title="x > y" href="mailto:bob@x.com">hi</a>', '<a title="x > y" href="mailto:&lt;EMAIL_ADDRESS&gt;">hi</a>'),
        ("<p>bob@x.com <b", "<p>&lt;EMAIL_ADDRESS&gt; <b"),
        ("<a title='x>bob@x.com", "<a title='x>&lt;EMAIL_ADDRESS&gt;"),
    ]
    df = spark.createDataFrame(cases, "html string, e string")
    for r in scrub_html(df, entities=["EMAIL_ADDRESS"]).collect():
        assert r["masked"] == r["e"], r["html"]

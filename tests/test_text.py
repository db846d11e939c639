from pyspark.sql import functions as F

from conftest import column
from corpusmill.functions import entities, text

NBSP = "\u00a0"


def check(spark, cases, fn):
    got = column(spark, [(a,) for a, _ in cases], "c string", fn(F.col("c")))
    assert got == [b for _, b in cases]


def test_clean_title(spark):
    check(spark, [
        ("useState – React", "useState"),
        ("Balance – Stripe", "Balance"),
        ("API API Documentation", "API Documentation"),
        ("useEffect – React This feature is available in the latest Experimental version of React",
         "useEffect"),
        ("Simple Title", "Simple Title"),
        ("Guide | Vercel Docs", "Guide"),
        ("Intro | Big Documentation ", "Intro"),
        ("the The THE end", "the end"),
        ("- React", ""),
        ("", ""),
        ("React", "React"),
    ], text.clean_title)


def test_title_case(spark):
    check(spark, [
        ("hello world", "Hello World"), ("HELLO WORLD", "Hello World"), ("hello", "Hello"),
        ("", ""), ("a", "A"), ("multiple   spaces", "Multiple Spaces"),
        ("école-élan x", "École-élan X"), (NBSP + "a" + NBSP + "b", "A B"),
    ], text.title_case)


def test_anchor(spark):
    check(spark, [
        ("Simple Title", "simple-title"),
        ("API Reference: useState() Hook", "api-reference-usestate-hook"),
        ("Complex -- Title   With    Spaces", "complex-title-with-spaces"),
        ("What is React? (A Guide)", "what-is-react-a-guide"),
        ("--- ", ""), ("", ""), (text.ANCHOR_DELETES, ""),
    ], text.anchor)


def test_tidy_markdown(spark):
    check(spark, [
        ("Line 1   \nLine 2\t\n", "Line 1\nLine 2"),
        ("Line 1\n\n\n\nLine 2", "Line 1\n\nLine 2"),
        ("Content\n\n\n", "Content"),
        ("Line 1\n\nLine 2", "Line 1\n\nLine 2"),
        ("   \t\n   \n", ""),
        ("\n\nA", "\nA"), ("\nA", "\nA"), ("", ""), ("a \t b", "a \t b"),
        ("a\n" + NBSP + "\n\r\nb", "a\n\nb"), ("a\r\nb", "a\r\nb"),
    ], text.tidy_markdown)


def test_tidy_is_idempotent(spark):
    rows = [("a \n\n\n b\t\n \n",), ("\n\n\nx\n",), (" \n",)]
    once = column(spark, rows, "c string", text.tidy_markdown(F.col("c")))
    twice = column(spark, [(x,) for x in once], "c string", text.tidy_markdown(F.col("c")))
    assert once == twice


def test_parse_size(spark):
    check(spark, [
        ("1024", 1024), ("1KB", 1024), ("1MB", 1 << 20), ("1GB", 1 << 30), ("10MB", 10 << 20),
        ("", None), ("invalid", None), ("5mb", 5), ("12.5MB", 12 << 20), ("99999999999999999999", None),
    ], text.parse_size)


def test_trim_body(spark):
    check(spark, [("  \n a b \t\n", "a b"), ("", ""), (NBSP + "x" + NBSP, "x"), (" \n", "")], text.trim_body)


def test_decode_entities(spark):
    check(spark, [
        ("a &amp; b", "a & b"), ("&amp;lt;", "&lt;"), ("&lt;&gt;&quot;&apos;", "<>\"'"),
        ("&#39;&#x27;&#128512;", "''\U0001F600"), ("&copy; &middot;", "© ·"),
        ("&nosuch; & x", "&nosuch; & x"), ("&#0;&#xD800;", "\ufffd\ufffd"), ("&amp;#39;", "&#39;"),
        ("&eacute;&nbsp;!", "é" + NBSP + "!"), ("plain", "plain"), ("&amp;", "&"),
        ("a &amp b &amp", "a & b &"), ("&ampx &am &copy2", "&ampx &am &copy2"),
    ], entities.decode_entities)


def test_content_hash(spark):
    check(spark, [("", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")],
          text.content_hash)

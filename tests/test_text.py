from pyspark.sql import functions as F

from quern.functions import text as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_scalars(spark):
    assert one(spark, lambda c: T.snippet(c, 40), "see [a](https://x.y/z) and [b](//q) end") == "see [a]([link omitted]) and [b]([link om"
    assert one(spark, T.normalised_lines, "\r\na\rb\r\n\n") == "a\nb"
    assert one(spark, T.redacted, "token=abc Bearer xyz https://a.b") == "token=[REDACTED_SECRET] Bearer [REDACTED_SECRET] [REDACTED_URL]"
    assert one(spark, T.canonical_url, "https://a/b?k=1&X-Amz-Date=2&X-Amz-Signature=3#f") == "https://a/b?k=1#f"
    assert one(spark, T.canonical_url, "https://a/b?k=1&X-Amz-Date=2") == "https://a/b?k=1&X-Amz-Date=2"
    assert one(spark, T.percent_decoded, "a%20b+%zz%C3%A9") == "a b+%zzé"
    assert one(spark, lambda c: T.snippet(c, 5), None) is None


def test_long_messages_and_signed_urls_are_kept(spark, tmp_path):
    from pyspark.sql import functions as F

    from quern.plans import texts

    rows = [(1, 1, "token=abc " + "x" * 5000), (1, 2, "short"), (2, 1, None)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.redacted for r in texts.log_redaction(spark, str(tmp_path)).collect()}
    made = "token=[REDACTED_SECRET] " + "x" * 5000
    assert got == {(1, 1): made[:4096] + "[TRUNCATED]", (1, 2): "short", (2, 1): None}
    urls = [(1, "https://a/b?x=1&X-Amz-Signature=f&q=a?b#c#d"), (2, "https://a/?X-Goog-Signature=1"), (3, "https://a/?x=1#y"), (4, None)]
    spark.createDataFrame(urls, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.canonical for r in texts.canonical_url(spark, str(tmp_path)).collect()}
    assert got == {1: "https://a/b?x=1&q=a?b#c#d", 2: "https://a/", 3: "https://a/?x=1#y", 4: None}
    assert texts.signed_url_all(spark, str(tmp_path)).filter(F.col("canonical").isNotNull()).count() == 3


def test_encoded_links_go_too(spark):
    cut = lambda said: one(spark, lambda c: T.snippet(c, 60), said)
    assert cut("a https%3A%2F%2Fx.y/z b") == "a [link omitted] b"
    assert cut("(&amp;%2f/q) HTTP://A.B) c") == "[link omitted] [link omitted]) c"
    assert cut("50% of //x") == "50% of [link omitted]"


def test_credentials_in_quotes_headers_and_urls(spark):
    cut = lambda said: one(spark, T.redacted, said)
    assert cut('{"access_token": "a\\"b c", "x": 1}') == '{"access_token": [REDACTED_SECRET], "x": 1}'
    assert cut("Authorization: Basic abc== next") == "Authorization: [REDACTED_SECRET] next"
    assert cut("see https://x/?token=a b") == "see [REDACTED_URL] b"
    assert cut("mytoken=a sk-12 sk-1 secret_") == "mytoken=a [REDACTED_SECRET] sk-1 [REDACTED_SECRET]"


def test_signed_urls_by_provider(spark):
    cut = lambda said: one(spark, T.canonical_url, said)
    assert cut("https://a/?X-AMZ-SIGNATURE=1&X-Amz-SignedHeaders=h&X-Amz-Content-Sha256=7&X-Goog-Date=2") == "https://a/?X-Amz-Content-Sha256=7&X-Goog-Date=2"
    assert cut("ftp://a/?X-Amz-Signature=1") == "ftp://a/?X-Amz-Signature=1"
    assert cut("https://a/#f?X-Amz-Signature=1") == "https://a/#f?X-Amz-Signature=1"

from quern.operators import media

STORE = media.Store("files.example.com")
BASE = "https://files.example.com/11111111-1111-1111-1111-111111111111/22222222-2222-2222-2222-222222222222/example.png"


def signed(generation, amp="&", more="x-id=GetObject"):
    return f"{BASE}?" + amp.join([f"X-Amz-Algorithm=AWS4-HMAC-SHA256", f"X-Amz-Credential={generation}%2Fscope", f"X-Amz-Date={generation}", "X-Amz-Expires=3600", "X-Amz-SignedHeaders=host", f"X-Amz-Security-Token={generation}", f"X-Amz-Signature={generation}", *([more] if more else [])])


def test_signatures_go_from_live_media_alone(spark):
    u, bare = signed("g"), signed("g", more="")
    h = signed("g", "&amp;", "a=1&amp;b=2")
    cases = [
        (f"# T\n\n![Image å]({u})\n\n<file src=\"{u}\">caption</file>\n", f"# T\n\n![Image å]({BASE}?x-id=GetObject)\n\n<file src=\"{BASE}?x-id=GetObject\">caption</file>\n"),
        (f"![a](<{bare}>) and ![b]({bare}#p)", f"![a](<{BASE}>) and ![b]({BASE}#p)"),
        (f"<image alt='x' source='{h}'/>\n", f"<image alt='x' source='{BASE}?a=1&amp;b=2'/>\n"),
        (f"text <video src=\"{u}\"></video> ![i]({u})", f"text <video src=\"{BASE}?x-id=GetObject\"></video> ![i]({BASE}?x-id=GetObject)"),
        *[(t, t) for t in (
            f"`![c]({u})`", f"```\n![f]({u})\n```\n", f"    ![k]({u})\n", f"<!-- ![n]({u}) <file src=\"{u}\"> -->\n", f"<pre><image src=\"{u}\"/></pre>\n", f"[l]({u})", f"![t]({u} \"title\")", f"![r][x]\n\n[x]: {u}\n", f"\\![e\\]({u})", u,
            f"![o]({u.replace('files.example.com', 'else.example.com')})", f"![p]({u.replace('/example.png', '')})", f"![s]({u.replace('X-Amz-Signature=g', 'X-Amz-Signature=')})", f"![m]({u.replace('X-Amz-Date=g&', '')})", f"![d]({u}&X-Amz-Date=h)", f"![q]({u}&%58=1)", f"![h]({u.replace('https', 'http')})", f"![v]({u.replace('HMAC-SHA256', 'OTHER')})", "plain", "", None,
        )],
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(cases)], "page_id int, text string, tops string")
    got = {r.page_id: r.text for r in media.canonical_media(df, "page_id", "text", STORE).collect()}
    assert len(got) == len(cases)
    for i, (said, want) in enumerate(cases):
        assert got[i] == want, said

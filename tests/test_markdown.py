import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions.blocks import scan
from quern.functions.text import array_digest
from quern.operators import markdown as M
from quern.operators import snapshots as S


def chunked(spark, texts, target=2000, overlap=200):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = M.chunks(df, target=target, overlap=overlap).orderBy("doc_id", "ordinal").collect()
    return [[r for r in rows if r.doc_id == i] for i in range(len(texts))]


def test_sections_keep_their_titles_and_every_character(spark):
    texts = ["intro\n\n# **One**\n\nshort\n\n### Deep\n\n日本語\n\n## Sibling\n\nlast\n", "Title\n=====\n\ntext\n", "", None, " \n\n"]
    made, setext, *nothing = chunked(spark, texts)
    assert [r.headings for r in made] == [[], ["One"], ["One", "Deep"], ["One", "Sibling"]]
    assert "".join(r.text for r in made) == texts[0]
    assert setext[0].headings == ["Title"] and setext[0].text == texts[1]
    assert nothing == [[], [], []]
    for sizes in ((0, 0), (2, 2)):
        with pytest.raises(ValueError):
            chunked(spark, ["x"], *sizes)


def test_long_prose_is_cut_with_a_small_overlap(spark):
    text = "# Heading\n\n" + "åäö word prose " * 100
    (made,) = chunked(spark, [text], 100, 50)
    assert len(made) > 10 and made[0].start == 0 and made[-1].end == len(text)
    assert all(len(r.text) <= 100 and r.headings == ["Heading"] and r.text == text[r.start : r.end] for r in made)
    pairs = list(zip(made, made[1:]))
    assert all(b.start <= a.end < b.end and a.end - b.start <= 50 for a, b in pairs) and any(b.start < a.end for a, b in pairs)


WHOLE = [
    "```rust\n" + "let x = 1;\n" * 30 + "```\n",
    "- first\n" + "  - nested item\n" * 30,
    "- first\n" + "  <page>nested source</page>\n" * 30,
    "|a|b|\n|-|-|\n" + "|1|2|\n" * 30,
    "<details>\n\n# inner\n\n" + "paragraph\n\n" * 30 + "\n</details>\n",
]


def test_blocks_and_elements_stay_whole(spark):
    for block, rows in zip(WHOLE, chunked(spark, [f"# Outer\n\n{b}\n## Next\n\nend\n" for b in WHOLE], 50, 5)):
        assert any(block in r.text for r in rows)
        assert rows[-1].headings == ["Outer", "Next"]


def test_prose_that_would_become_something_else_is_not_cut(spark):
    texts = ["aaaa - item more prose", "aaaa + item more prose", "aaaa 1. item more prose", "aaaa 2) item more prose", "aaaa # heading more prose", "aaaa  \ncontinued prose", "aaaa  \r\ncontinued prose", "aaaa     indented prose", "aaaa \tindented prose"]
    assert [[r.text for r in rows] for rows in chunked(spark, texts, 7, 0)] == [[t] for t in texts]


def test_elements_on_their_own_lines_are_blocks(spark):
    texts = ["".join(f'<{tag} url="https://pages.example/{n}">Svensk åäö text {n}</{tag}>\n' for n in range(30)) for tag in ("page", "database", "div", "details")]
    for text, rows in zip(texts, chunked(spark, texts, 200, 0)):
        assert len(rows) > 5 and "".join(r.text for r in rows) == text and all(len(r.text) <= 200 for r in rows)


PAIRS = [
    "<page>outer<page>nested</page>still outer</page>\n",
    '<page title="fake </page> close">åäö</page>\n',
    "<page>before<!-- </page> -->after</page>\n",
    "<page><![CDATA[ </page> ]]></page>\n",
    "<script>const sample = '<page>';</script>\n",
    "<script>if (left < right) run();</script>\n",
    "<textarea>literal x < y and an unmatched quote '</textarea>\n",
    "<div>left < right and 1 < 2</div>\n",
    '<page title="fake </page>\nclose">body</page>\n',
    "<PAGE>case-insensitive</page>\n",
]


def test_elements_are_paired(spark):
    texts = [f"{b}\n<page>independent sibling</page>\n\n# After\n\nend\n" for b in PAIRS]
    for block, text, rows in zip(PAIRS, texts, chunked(spark, texts, 12, 0)):
        assert any(block in r.text and "sibling" not in r.text for r in rows), (block, rows)
        assert "".join(r.text for r in rows) == text and rows[-1].headings == ["After"]


def test_code_owns_no_tags_and_open_elements_keep_the_rest(spark):
    code, tail = chunked(spark, ["```html\n<page>unclosed code\n```\n\n<page>real element</page>\n\n# After\n\nend\n", "before\n\n<page>unclosed container\n\n# Not a section\n\ntail\n"], 12, 0)
    assert code[-1].headings == ["After"] and not any("unclosed code" in r.text and "real element" in r.text for r in code)
    assert all(r.headings == [] for r in tail) and tail[-1].text.endswith("tail\n") and tail[-1].text.startswith("<page>")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["> ", "- ", "1. ", "2) ", "  ", "    ", "\t", "# ", "```", "~~~", "---", "===", "|a|b|", "|-|-|", "<div>", "</div>", "<!--", "-->", "word", " ", "\n", "\n", "\n\n", "`", "é"]), max_size=30).map("".join))
def test_any_text_is_scanned_in_order(text):
    tops, leaves = scan(text)
    assert [s for s, _ in tops] == sorted({s for s, _ in tops})
    assert all(a < b <= len(text) for x in leaves for a, b in x.parts)
    assert all(p[1] <= q[0] for x in leaves for p, q in zip(x.parts, x.parts[1:]))
    assert all(x.parts[-1][1] <= y.parts[0][0] for x, y in zip(leaves, leaves[1:]))
    # each line that isn't blank is in exactly one leaf, but for markers of empty items and quotes
    held = sum(text[a:b].count("word") for x in leaves for a, b in x.parts)
    assert held == text.count("word")
    assert all(len(x.shown(text)) == x.parts[-1][1] - x.parts[0][0] for x in leaves)


def plan(spark, page, level, heading, put):
    pages = spark.createDataFrame([(1, page)], "page_id long, text string")
    edits = spark.createDataFrame([(1, level, heading, put)], "page_id long, level int, heading string, replacement string")
    return M.plan_sections(pages, edits, "page_id").first()


BAD = [
    ("## Notes\nfirst\n# Other\n## Notes\nsecond\n", 2, "Notes", "r\n", "ambiguous"),
    ("## Notes\n## Notes\n", 2, "Notes", "", "ambiguous"),
    ("## Vacation plans\ntext\n", 2, "Vacation", "new\n", "missing"),
    ("## Notes\n", 2, "notes", "new\n", "missing"),
    ("### Notes\n", 2, "Notes", "new\n", "missing"),
    ("~~~\n## Target\n~~~\n", 2, "Target", "new\n", "missing"),
    ("> ## Target\nquoted\n", 2, "Target", "new\n", "missing"),
    ("  - item\n    ## Target\n    detail\n", 2, "Target", "new\n", "missing"),
    ("## Target", 2, "Target", "new", "unsupported"),
    ("## Target\nsame\n", 2, "Target", "same\n", "unchanged"),
    ("## Target\nold\n## Sibling\nkeep\n", 2, "Target", "missing newline", "invalid"),
    ('## Target\n<page url="x">\n## Next\nkeep\n', 2, "Target", "r\n", "unsupported"),
    ('# Page\n<unknown alt="keep"/>\n## Target\nold\n', 2, "Target", "new\n", "missing"),
    ("## **Important**\ntext\n", 2, "Important", "new\n", "missing"),
    ("Important\n---------\n", 2, "Important", "new\n", "missing"),
    ("## Target\nold\n", 2, "Target", "text\n# Escapes\n", "unsupported"),
    ("## Target\nold\n", 2, "Target", "> ## Quoted\n", "unsupported"),
    ("## Target\nold\n", 7, "Target", "new\n", "invalid"),
    ("## Target\nold\n", 2, " Target", "new\n", "invalid"),
    ("## Target\nold\n", 2, "", "new\n", "invalid"),
    ("## Target\nold\n", 2, "Target", "a\x00\n", "invalid"),
    ("## Target\nold\n", 2, "Target", "x" * 200_001, "invalid"),
]
GOOD = [
    ("# Document\nIntro\n## Target\nOld\n### Child\n- old\n## Sibling\nKeep *all*\n# Footer\nEnd\n", 2, "Target", "New\n\n### New child\nnew\n\n", "# Document\nIntro\n## Target\nNew\n\n### New child\nnew\n\n## Sibling\nKeep *all*\n# Footer\nEnd\n"),
    ("# Todo\nroot\n## Todo\nchild\n# End\n", 2, "Todo", "new\n", "# Todo\nroot\n## Todo\nnew\n# End\n"),
    ("# Todo\nroot\n## Todo\nchild\n# End\n", 1, "Todo", "new\n", "# Todo\nnew\n# End\n"),
    ("~~~md\n## Target\n~~~\n\n`## Target`\n## Target\nreal\n# End\n", 2, "Target", "new\n", "~~~md\n## Target\n~~~\n\n`## Target`\n## Target\nnew\n# End\n"),
    ("## Target\nBefore\n> ## Note\n> quoted\n\n## Next\nafter\n", 2, "Target", "R\n", "## Target\nR\n## Next\nafter\n"),
    ("Pre 😊\r\n## Räksmörgås 🦐\r\nHallå 世界\r\n\r\n## Efteråt\r\nÄndra\r\n", 2, "Räksmörgås 🦐", "Nytt 🦊\r\n", "Pre 😊\r\n## Räksmörgås 🦐\r\nNytt 🦊\r\n## Efteråt\r\nÄndra\r\n"),
    ("## Empty\n## Next\nretained\n", 2, "Empty", "new\n", "## Empty\nnew\n## Next\nretained\n"),
    ("## Target\nold\n## Next\n", 2, "Target", "", "## Target\n## Next\n"),
    ("## Target\nold", 2, "Target", "new", "## Target\nnew"),
    ("## Target\nold\n\nAnother title\n=============\nsafe\n", 2, "Target", "new\n", "## Target\nnew\nAnother title\n=============\nsafe\n"),
    ('# Page\n<unknown alt="keep"/>\n\n## Target\nold\n## Next\n<page url="keep"/>\n', 2, "Target", "new\n", '# Page\n<unknown alt="keep"/>\n\n## Target\nnew\n## Next\n<page url="keep"/>\n'),
]


def test_section_plans(spark):
    cases = [*BAD, *GOOD]
    pages = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id long, text string")
    edits = spark.createDataFrame([(i, *c[1:4]) for i, c in enumerate(cases)] + [(999, 2, "T", "x\n"), (None, 2, "T", "x\n")], "page_id long, level int, heading string, replacement string")
    got = {r.page_id: r for r in M.plan_sections(pages, edits, "page_id").collect()}
    assert got[999].status == got[None].status == "missing"
    for i, (page, _, _, put, want) in enumerate(cases):
        r = got[i]
        if i < len(BAD):
            assert (r.status, r.proposed) == (want, None), cases[i]
            continue
        assert r.status == "planned" and r.proposed == want, (cases[i], r)
        raw = page.encode()
        assert raw[: r.body_start] + put.encode() + raw[r.body_end :] == want.encode()
        assert r.proposed_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.original_sha256 == hashlib.sha256(raw).hexdigest()


def test_updates_need_the_page_that_was_planned_on(spark):
    pages = ["# A\nold\n# B\nkeep\n", "# A\nold\n# B\nold\n", "# A\n# B\n", "# A\nold\n", "no heading\n"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, text string")
    edits = spark.createDataFrame([(i, 1, "A", "new\n") for i in range(5)], "page_id long, level int, heading string, replacement string")
    fresh = spark.createDataFrame([(i, t + "later\n" * (i == 3)) for i, t in enumerate(pages)], "page_id long, text string")
    got = {r.page_id: (r.status, r.text) for r in M.update_sections(M.plan_sections(df, edits, "page_id"), fresh, "page_id").collect()}
    assert got == {0: ("applied", "# A\nnew\n# B\nkeep\n"), 1: ("repeated", pages[1]), 2: ("empty", pages[2]), 3: ("stale", pages[3] + "later\n"), 4: ("missing", pages[4])}


ID, RAW = "12345678-1234-1234-1234-123456789abc", "12345678123412341234123456789ABC"


def refs(spark, text):
    rows = M.references(spark.createDataFrame([(1, text)], "page_id long, text string"), "page_id", "text").orderBy("start").collect()
    return [(r.form, text.encode()[r.start : r.end].decode(), r.target) for r in rows]


def test_links_of_all_forms(spark):
    text = f"[page](https://www.pages.example/T-{RAW}?pvs=4)\n[external][Site]\n<https://example.test/auto>\n\n[site]: https://example.test/a?x=1&y=2\n[repeat](https://pages.example/{ID})\n\n![alt](<a b.png> \"t\") [out [in](x) out](y) [r][1] [1] [none][none] [![i](p.png)](q)\n\n[1]: /one 'title'\n"
    want = [f"https://www.pages.example/T-{RAW}?pvs=4", "https://example.test/a?x=1&y=2", "https://example.test/auto", f"https://pages.example/{ID}", "a b.png", "x", "/one", "/one", "q", "p.png"]
    got = refs(spark, text)
    assert [t for *_, t in got] == want
    assert [s for _, s, _ in got][4:] == ['![alt](<a b.png> "t")', "[in](x)", "[r][1]", "[1]", "[![i](p.png)](q)", "![i](p.png)"]


def test_tags_wrappers_and_code(spark):
    text = f"<callout icon=\"🎯\">\n\t[child](https://example.test/child)\n\t<mention-page url=\"https://p.example/{RAW}\">Page</mention-page>\n</callout>\n<page color=\"blue\" url='https://p.example/{ID}'/>\n<mention-user url=\"user://person\">Ada</mention-user>\n<mention-date start=\"x\"/>\n<database url=\"a&amp;b\"/>\n"
    assert [(f, t) for f, _, t in refs(spark, text)] == [("link", "https://example.test/child"), ("mention-page", f"https://p.example/{RAW}"), ("page", f"https://p.example/{ID}"), ("mention-user", "user://person"), ("database", "a&b")]
    dead = "`[a](x)` ``[b](x) ` <page url=\"x\"/>`` \\[c](x) \\<page url=\"x\"/> <!-- [d](x) <page url=\"x\"/> -->\n\n    [e](x)\n\n~~~\n[f](x)\n<page url=\"x\"/>\n~~~\n\n<details>\n\t```\n\t[g](x)\n\t<page url=\"x\"/>\n\t```\n</details>\n\n"
    assert refs(spark, dead + "[live](y)\n") == [("link", "[live](y)", "y")]
    assert refs(spark, "<page url=\"open\nå [l](z)\n<page other='1'/>\n") == [("page", '<page url="open', '<page url="open'), ("link", "[l](z)", "z"), ("page", "<page other='1'/>", "<page other='1'/>")]
    assert refs(spark, "") == []


def test_title_paths_drop_what_a_higher_heading_ends(spark):
    text = "### deep\n\n# A\n\n### A3\n\n## A2\n\n### A23\n\n# B\n\n### B3\n"
    heads = M.headings(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), "doc_id", "text")
    got = M.title_paths(heads, "doc_id").orderBy("start").collect()
    assert [r.path for r in got] == [["deep"], ["A"], ["A", "A3"], ["A", "A2"], ["A", "A2", "A23"], ["B"], ["B", "B3"]]


def identified(spark, text, previous=None):
    """Chunks of one page with their ids, after those of an earlier text."""
    made = M.chunks(spark.createDataFrame([("page", text)], "page string, text string"), "page")
    drafts = made.select("page", F.concat(F.array(F.lit("")), "headings").alias("section"), F.col("ordinal").alias("pos"), array_digest("content", F.concat(F.array(F.regexp_replace("text", r"\s+$", "")), "headings")).alias("content_hash"))
    schema = "page string, section array<string>, pos long, content_hash string, id string"
    rows = S.identified(drafts, spark.createDataFrame(previous or [], schema)).orderBy("pos").collect()
    assert len({r.id for r in rows}) == len(rows)
    return [(r.page, r.section, r.pos, r.content_hash, r.id) for r in rows]


def test_ids_survive_edits_and_moves(spark):
    text = "# One\n\nOriginal\n\n# Two\n\nStable\n\n# Three\n\nRemoved\n"
    before = identified(spark, text)
    assert identified(spark, text, before) == before
    after = identified(spark, "# Added\n\nNew\n\n# One\n\nEdited\n\n# Two\n\nStable\n", before)
    assert after[1][4] == before[0][4] and after[1][3] != before[0][3] and after[2][3:] == before[1][3:]
    assert before[2][4] not in {r[4] for r in after} and after[0][4] != after[1][4]
    assert identified(spark, "# Two\n\nStable\n")[0][4] == before[1][4]


def test_new_copies_get_ids_that_nothing_had(spark):
    before = identified(spark, "# Same\n\nA\n\n# Same\n\nB\n\n# Same\n\nA\n\n# End\n")
    assert before[2][4] == before[0][4] + ":1"
    after = identified(spark, "# Same\n\nInserted\n\n# Same\n\nB\n\n# Same\n\nA\n\n# End\n", before)
    assert after[1][4] == before[1][4] and after[2][4] == before[0][4]
    # one copy is kept, two come anew: the numbers of ids in use are passed over, also of chunks that went
    kept = [before[0], ("page", ["", "Gone"], 9, "h", before[0][4] + ":2"), ("page", ["", "Gone"], 10, "h2", before[0][4] + ":3")]
    more = identified(spark, "# Same\n\nA\n\n" * 4 + "# End\n", kept)
    assert [r[4] for r in more][:4] == [before[0][4] + x for x in ("", ":1", ":4", ":5")]
    with pytest.raises(S.Conflict):
        identified(spark, "x", [before[0], before[0]])


@pytest.mark.parametrize("name", ["section_level_titles", "section_plans", "section_updates"])
def test_structure_is_reckoned_once_a_row(spark, name):
    """Not in a filter before an explode too."""
    from quern.plans.registry import queries

    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]
    assert not [f for f in filters if "leaves#" in f]


@pytest.mark.parametrize("name", ["chunk_tiling", "chunk_prose", "chunk_markdown"])
def test_chunks_are_made_of_one_scan(spark, name):
    """Texts go to Python once, and what packs them sees their lengths only."""
    from quern.plans.registry import queries

    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("ArrowEvalPython") == 1
    packed = next(line for line in plan.splitlines() if "ArrowEvalPython" in line)
    assert "length(text" in packed.split("]")[0] or "text#" not in packed.split("]")[0]


def test_blank_chunks_go_by_what_python_calls_white_space(spark):
    blank = [c for c in map(chr, range(0x10000)) if c.isspace()]
    others = ["​", "﻿", "\x00", "\x7f", "᠎", "x"]
    df = spark.createDataFrame([(k, c) for k, c in enumerate([*blank, *others])], "k int, c string")
    solid = {r.k for r in df.filter(F.rlike("c", F.lit(M._SOLID))).collect()}
    assert solid == set(range(len(blank), len(blank) + len(others)))

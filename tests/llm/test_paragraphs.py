import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm import paragraphs as P


def words(rng, n):
    return [f"{rng.choice('abcdef')}{rng.randrange(10**6)}" for _ in range(n)]


def grams(unit):
    return {tuple(unit[k : k + P.SHINGLE]) for k in range(len(unit) - P.SHINGLE + 1)}


def paragraphs(text, segments):
    """(first word, words, kind) of lines and, where asked for, of segments; the latter's places come from Units, which test_segments checks."""
    said = (text or "").lower().split()
    at = 0
    for line in (text or "").split("\n"):
        n = len(line.split())
        if n >= P.LINE:
            yield at, tuple(said[at : at + n]), "line"
        at += n
    if segments:
        where, size, node = P.Units(pa.array([text])).paragraphs()
        for k in np.flatnonzero(node & np.uint64(1)):
            yield int(where[k]), tuple(said[where[k] : where[k] + size[k]]), "segment"


def near(rows, segments):
    """Words that near repeats of paragraphs take."""
    places = [(doc, at, (unit, kind)) for doc, text in rows for at, unit, kind in paragraphs(text, segments)]
    nodes = sorted({p[2] for p in places})
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    sets = {n: grams(n[0]) for n in nodes}
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if sets[a] & sets[b] and len(sets[a] & sets[b]) >= P.LEAST * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    keep = {}
    for doc, _, node in places:
        keep[find(node)] = min(keep.get(find(node), doc), doc)
    gone = {}
    for doc, at, node in places:
        if doc > keep[find(node)]:
            gone.setdefault(doc, set()).update(range(at, at + len(node[0])))
    return gone


def repeated(rows, size):
    """doc_id: the starts of its runs of that many words which an earlier document holds."""
    first, said = {}, {doc: (text or "").lower().split() for doc, text in rows}
    for doc in sorted(said):
        for k in range(len(said[doc]) - size + 1):
            first.setdefault(tuple(said[doc][k : k + size]), doc)
    return {doc: [k for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < doc] for doc, w in said.items()}


def corpus(seed=4):
    rng = random.Random(seed)
    rows = [[k, words(rng, rng.choice([5, 30, 120, 400]))] for k in range(60)]
    passages = [words(rng, 55) for _ in range(4)]
    for k, p in enumerate(passages):
        for doc in rng.sample(range(60), 5 + k):
            at = rng.randrange(len(rows[doc][1]) + 1)
            rows[doc][1][at:at] = p
    rows.append([60, list(rows[7][1])])
    rows.append([61, ["junk"] * 300])
    rows.append([62, ["junk"] * 200 + words(rng, 40)])
    edited = list(passages[0])
    edited[-1] = "edited"
    rows.append([63, words(rng, 20) + edited])
    made = [(k, "".join(w + rng.choice([" "] * 30 + ["\n"]) for w in said)) for k, said in rows]
    for k in range(8):
        line = words(rng, 80)
        made.append((100 + 2 * k, " ".join(line)))
        line[rng.randrange(80)] = "other"
        made.append((101 + 2 * k, "x y\n" + " ".join(line) + "\nz"))
    return made, [" ".join(p) for p in passages]


def covered(got):
    out = {}
    for r in got:
        out.setdefault(r.doc_id, set()).update(range(r.first_word, r.last_word))
    return out


def check(got, rows):
    """No repeated run of UNIT words stays whole, nothing goes that isn't a repeat, and near repeats of lines go by the bands' recall."""
    for doc, starts in repeated(rows, P.UNIT).items():
        assert all(got.get(doc, set()) & set(range(k, k + P.UNIT)) for k in starts)
    shared = {doc: {w for k in starts for w in range(k, k + P.SEED)} for doc, starts in repeated(rows, P.SEED).items()}
    every, lines = near(rows, True), near(rows, False)
    assert all(v <= every.get(k, set()) | shared[k] for k, v in got.items())
    assert sum(len(got.get(k, set()) & v) for k, v in lines.items()) >= 0.97 * sum(map(len, lines.values()))


def test_removed_words_by_brute_force(spark):
    rows, passages = corpus()
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, node long").repartition(5)
    got = P.removed_spans(df).collect()
    check(covered(got), rows)
    assert all(int(k) < r.doc_id for r in got for k in r.kept_doc_ids.split(","))
    flat = {k: " ".join(t.split()) for k, t in rows}
    for p in passages:
        holders = [k for k, t in flat.items() if p in t]
        assert all(k in covered(got) for k in holders[1:])


def test_texts_without_the_spans(spark):
    rows, _ = corpus(9)
    df = spark.createDataFrame([(a, b, 0, "s") for a, b in rows], "doc_id long, text string, n_chars long, spans string")
    gone = covered(P.removed_spans(df).collect())
    check(gone, rows)
    got = {r.doc_id: r for r in P.deduplicated(df.drop("spans")).collect()}
    for k, text in rows:
        left = [w for i, w in enumerate(text.split()) if i not in gone.get(k, ())]
        assert (got[k].text.split() if k in got else []) == left
        if k in got:
            assert got[k].n_chars == len(got[k].text) and (k in gone or got[k].text == text)


def test_odd_rows(spark):
    long = " ".join(words(random.Random(1), 90))
    rows = [(None, long), (None, long), (5, long), (5, long), (6, None), (7, ""), (8, "a b"), (9, long.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.removed_spans(df).collect()
    assert sorted({str(r.doc_id) for r in got}) == ["9", "None"] and {r.kept_doc_ids for r in got} == {"5"}
    assert P.removed_spans(df.limit(0)).count() == 0 and P.deduplicated(df.limit(0)).count() == 0
    assert P.deduplicated(df).filter(F.col("doc_id") == 5).count() == 2


def test_seeds_and_segments_by_the_definition():
    rng = random.Random(2)
    said = words(rng, 300)
    units = P.Units(pa.array([" ".join(said[:3]), " ".join(said), " ".join(said[100:160])]))
    g = P.Units(pa.array([" ".join(said)])).grams.tolist()
    want = sorted({min(range(j, j + P.SAMPLE), key=lambda k: g[k]) for j in range(len(g) - P.SAMPLE + 1)})
    want = [k for k in want if k + P.SEED <= 300]
    at, node = units.seeds()
    assert (at[units.text[at] == 1] - units.first[1]).tolist() == want
    whole = [k for k in range(300 - P.UNIT + 1) if any(k <= s and s + P.SEED <= k + P.UNIT for s in want)]
    assert whole == list(range(300 - P.UNIT + 1))
    assert {k - 100 for k in want if k >= 100} & set((at[units.text[at] == 2] - units.first[2]).tolist())
    at, size, node = units.paragraphs()
    for reach, kind in zip(P.REACH, (1, 3), strict=True):
        own = (units.text[at] == 1) & (node & np.uint64(3) == kind)
        cuts = [0, *(k for k in range(reach, len(g) - reach) if g[k] == min(g[k - reach : k + reach + 1])), 300]
        assert [(int(a - units.first[1]), int(n)) for a, n in zip(at[own], size[own], strict=True)] == [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b - a >= P.LINE]


def test_common_runs_of_periodic_and_equal_texts():
    own = P.mix(np.arange(100, dtype=np.uint64) % np.uint64(7))
    seeds = np.arange(0, 76, 17)
    nodes = P._runs(own, P.SEED)[seeds]
    distinct, first = np.unique(nodes, return_index=True)
    assert P.common_runs(own, seeds, nodes, own, seeds[first], distinct)[0] == (0, 100)
    assert P.common_runs(own, seeds, nodes, own, seeds[:0], nodes[:0]) == []


def test_very_long_text(spark):
    rng = random.Random(8)
    said = words(rng, 150_000)
    rows = [(1, " ".join(said)), (2, " ".join(said[:70_000] + ["cut"] + said[70_000:])), (3, " ".join(words(rng, 40) + said[500:560]))]
    got = covered(P.removed_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len(got[2]) >= 150_000 and got[3] == set(range(40, 100)) and 1 not in got


def test_bands_are_tuned():
    assert P.tuned() == P.BANDS and P.recall(P.LEAST) >= 0.95
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, (400, 100), dtype=np.uint64)
    met = 0
    for row in base:
        other = row.copy()
        other[:11] = rng.integers(0, 1 << 63, 11, dtype=np.uint64)  # Jaccard 89 / 111
        least = [[(x * t + (t >> np.uint64(7))).min() for t in P._TURNS] for x in (row, other)]
        met += any(least[0][b * P.ROWS : (b + 1) * P.ROWS] == least[1][b * P.ROWS : (b + 1) * P.ROWS] for b in range(P.BANDS))
    assert met >= 0.9 * 400


def test_repeats_go_to_their_real_ends(spark):
    rng = random.Random(11)
    rows = []
    for k, size in enumerate([50, 51, 60, 80, 120]):
        said = words(rng, size)
        for copy in range(3):
            before = words(rng, rng.randrange(1, 40))
            rows.append((10 * k + copy, " ".join(before + said + words(rng, 30)), len(before), size))
    # a part of a passage that a still earlier document holds doesn't hide the rest
    part = rows[-1][1].split()[rows[-1][2] :][:60]
    rows.append((-1, " ".join(words(rng, 9) + part + words(rng, 9)), 0, 0))
    got = covered(P.removed_spans(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect())
    for doc, _, at, size in rows[:-1]:
        first = 0 if doc != 40 else 60
        assert got.get(doc, set()) == (set(range(at, at + size)) if doc % 10 else set(range(at, at + first)))


def test_near_repeats_inside_lines_and_over_line_breaks(spark):
    rng = random.Random(5)
    rows, spots = [], {}
    for k in range(12):
        said = words(rng, 400)
        rows.append((2 * k, " ".join(said)))
        other = list(said)
        for at in range(60, 400, 60):
            other[at] = "edited"
        before = words(rng, 30)
        made = before + other + words(rng, 30)
        rows.append((2 * k + 1, " ".join(made) if k % 2 else "\n".join(" ".join(made[j : j + 11]) for j in range(0, len(made), 11))))
        spots[2 * k + 1] = [30 + at for at in range(60, 400, 60)]
    got = covered(P.removed_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # the edited words belong to no exact repeat; some paragraphs at edits or ends fall below LEAST
    gone = sum(at in got[doc] for doc, where in spots.items() for at in where)
    assert gone >= 0.3 * sum(map(len, spots.values()))
    assert all(30 <= min(v) and max(v) < 430 for v in got.values()) and not any(doc % 2 == 0 for doc in got)


def test_near_recall_is_high():
    assert P.recall(P.LEAST) >= 0.99


def test_units_do_not_depend_on_the_texts_beside():
    rng = random.Random(8)
    texts = ["The " * n for n in (200, 61, 40, 333)] + [" ".join(words(rng, 90)) + " The" * 70, "The " * 70 + " ".join(words(rng, 90)), "", None]
    alone = {}
    for text in texts:
        units = P.Units(pa.array([text], pa.string()))
        alone[text] = [x.tolist() for x in (*units.paragraphs(), *units.seeds())]
    for _ in range(20):
        rng.shuffle(texts)
        units = P.Units(pa.array(texts, pa.string()))
        (at, size, node), (seed_at, seed) = units.paragraphs(), units.seeds()
        for k, text in enumerate(texts):
            mine, own = units.text[at] == k, units.text[seed_at] == k
            got = [at[mine] - units.first[k], size[mine], node[mine], seed_at[own] - units.first[k], seed[own]]
            assert [x.tolist() for x in got] == alone[text]


def test_repeated_shingles_count_once(spark):
    rng = random.Random(9)
    refrain = words(rng, 6)
    # equal sets of shingles, repeated 8 and 20 times; and a line that shares less than 0.8 distinct ones though most of its words
    lines = [" ".join(refrain * 8), " ".join(refrain * 20), " ".join(refrain * 8 + words(rng, 12))]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = covered(P.removed_spans(df).collect())
    assert got[1] == set(range(120))
    # of the third only what it repeats word by word
    assert got[2] <= set(range(48))
    held = pa.array([np.array([5, 3, 5, 9, 3], "<u8").tobytes()], pa.binary())
    assert P.stored_sets(held)[0].tolist() == [3, 5, 9]


def test_bands_come_with_the_one_scan_of_the_texts(spark):
    words = [f"w{k * 7 % 101}" for k in range(300)]
    texts = [" ".join(words), "x y " + " ".join(words[40:260]), " ".join(words), None]
    docs = P._docs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).coalesce(1)
    found = P.occurrences(docs).cache()
    units = P.Units(pa.array(texts))
    at, size, node = units.paragraphs()
    bands = {n: b.view(np.int64).tolist() for n, b in zip(node.view(np.int64).tolist(), units.bands(at, size, node), strict=True)}
    got = {r.node: [r[b] for b in P.BAND] for r in found.filter("b0 IS NOT NULL").collect()}
    assert got == bands and found.filter("seed AND b0 IS NOT NULL").count() == 0
    cells: dict[int, set] = {}
    for n, values in bands.items():
        for v in values:
            cells.setdefault(v, set()).add(n)
    want = {(c, n) for c, nodes in cells.items() if len(nodes) > 1 for n in nodes}
    parts = [P.collisions(found, range(k, min(k + P.AT_ONCE, P.BANDS))) for k in range(0, P.BANDS, P.AT_ONCE)]
    assert {tuple(r) for part in parts for r in part.collect()} == want and want

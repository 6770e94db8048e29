import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import repair

WORD = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """Least (cost, audit, said) by trying all edits; rows are (role, text, must go, open)."""
    expected = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def inserts(state):
        yield state, 0, "", ()
        for most in (1, 2):
            at, said = state, ()
            for _ in range(most):
                at = expected[at]
                said += (full[at] + ":",)
            yield at, 2 * most, "I" * most, said

    ways = {"": (0, "", ())}
    for role, text, go, cut in rows:
        then = {}
        for state, (cost, audit, said) in ways.items():
            for at, more, letters, put in inserts(state):
                made = [(at, 3, "D", ())]
                if not go:
                    if role[:1] == expected[at] or (at == "" and role[:1] == "s"):
                        made.append((role[:1], cut, "K", (f"{role}:{text}",)))
                    made.append((expected[at], 2 + cut, "R", (f"{full[expected[at]]}:{text}",)))
                for end, c, letter, out in made:
                    way = (cost + more + c, audit + letters + letter, said + put + out)
                    if end not in then or way < then[end]:
                        then[end] = way
        ways = then
    return min((c + more, a + letters, said + put) for state, (c, a, said) in ways.items() for at, more, letters, put in inserts(state) if at in ("", "a"))


def wanted(rows):
    """The contract's row of one conversation, from its (turn, role, text) after damage."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    seen, judged, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        fault = "blank" if not WORD.search(text) else "duplicate" if (role, text) in seen else "truncated" if WORD.findall(text)[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        judged.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, said = cheapest(judged)
    return (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def result(r):
    return (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)


ROLES = ["user", "assistant", "system", "tool", "", None, "u"]
TEXTS = ["Yes.", "no", "", " \t", "Why?  ", None, "a.b", "x\n\n!", "long " * 30 + "1.", "long " * 30 + "2."]


def rows_of(seed, conversations, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(0, most)):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.7 else rng.choice(ROLES)
            rows.append((conv if conv else None, turn if rng.random() < 0.9 else rng.choice([None, 1, 2]), role, rng.choice(TEXTS) if rng.random() < 0.4 else f"Said {turn}."))
    return rows


def test_against_all_edits(spark):
    rows = rows_of(1, 120, 9)
    schema = "conv_id long, turn long, role string, text string, k string, pos int"
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], schema)
    every = spark.createDataFrame([(c, None, None, None, "", 1) for c in [None, *range(1, 125)]], schema)
    for unit in (1, 1024):
        got = {r.conv_id: result(r) for r in repair.repair_digest(df, every, repair.Costs(unit=unit)).collect()}
        assert len(got) == 125
        for conv in got:
            mine = [r[1:] for r in rows if r[0] == conv]
            assert got[conv] == wanted(mine), (conv, unit)


def test_damage(spark):
    rows = [(c if c else None, t if t else None, ["user", None][c % 2], "One. Two! " if t % 3 else None) for c in range(40) for t in range(6)]
    got = sorted(map(tuple, repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=str)
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        said = {1: "", 2: re.sub("[.!?]", "", x)}.get(kind, x)
        want += [(c, t, "user" if kind == 4 else r, said)] * {0: 0, 3: 2}.get(kind, 1)
    assert got == sorted(want, key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.booleans(), st.booleans(), st.integers(1, 3)), max_size=12), st.integers(1, 4))
def test_blocks_give_what_one_block_gives(turns, size):
    costs = repair.Costs()
    codes = [("suax".index(r) | (4 if go else 8 if cut else 0), copies) for r, go, cut, copies in turns]
    whole, _ = repair.walk(codes, repair.vectors(codes, repair.last(costs), costs), repair.START, True, costs)
    parts = [codes[i : i + size] for i in range(0, len(codes), size)] or [[]]
    ends = [repair.last(costs)]
    for part in reversed(parts):
        ends.append(repair.vectors(part, ends[-1], costs)[0])
    state, said = repair.START, ""
    for k, part in enumerate(parts):
        audit, state = repair.walk(part, repair.vectors(part, ends[len(parts) - 1 - k], costs), state, k == len(parts) - 1, costs)
        said += audit
    plain = [("suax"[c & 3], "t", go, int(cut and not go)) for (c, n), (_, go, cut, _) in zip(codes, turns) for go in [go, *[True] * (n - 1)]]
    assert said == whole == cheapest(plain)[1]
    assert repair.vectors(codes, repair.last(costs), costs)[0][0] == cheapest(plain)[0]


def test_one_long_conversation_with_many_copies(spark):
    """Five thousand equal rows, a very long text and thousands of turns in blocks of their own."""
    rows = [(7, 0, "user", "Same.")] * 5000 + [(7, 1, "assistant", "word " * 400_000 + ".")] + [(7, t, ["user", "assistant"][t % 2], f"T{t}{'.' if t % 7 else ''}") for t in range(2, 3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = repair.repair(df, repair.Costs(unit=16))
    assert made.coded.agg({"block": "max"}).first()[0] > 10
    (r,) = repair.repair_digest(df, df, repair.Costs(unit=16)).collect()
    assert r.duplicate == 4999 and r.gaps == 0 and r.cost == 3 * 4999 + r.truncated
    assert r.audit == "K" + "D" * 4999 + "K" * 2999
    want = ["user:Same."] + [f"{x[2]}:{x[3]}" for x in rows[5000:]]
    assert r.repaired_sha256 == hashlib.sha256("\n".join(want).encode()).hexdigest()
    kept = made.repaired().orderBy("block", "at").collect()
    assert [f"{x.role}:{x.text}" for x in kept] == want and {x.edit for x in kept} == {"K"}


def test_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_digest(repair.damaged(df), df).count() == 0

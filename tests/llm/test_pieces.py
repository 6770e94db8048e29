import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import pieces as P
from quern.llm.shared import tokenizer_file

MODEL = tokenizer_file("piece_bpe_32k.model")
TEXTS = ["", " ", "  a  b ", "▁", "a▁b", "▁▁ x", "né ☃ 漢字\n\tx", "\x00\x01", "x" * 3000, "<s></s><0x41>", "word " * 500, "    y", "🙂" * 40]


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def check(texts):
    sp = library()
    for text, (ids, begins, ends) in zip(texts, P.pieces(MODEL).encode(texts), strict=True):
        want = sp.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want
        raw, b, e = text.encode(), np.frombuffer(begins, "<u4"), np.frombuffer(ends, "<u4")
        assert b[0] == e[0] == 0 and b[-1] == e[-1] == len(raw)
        covered = b"".join(raw[x:y] for x, y in zip(b.tolist(), e.tolist(), strict=True))
        assert covered == raw  # spaces are one byte each, so spans tile the source
        for piece, x, y in zip(want, b.tolist(), e.tolist(), strict=True):
            shown = sp.id_to_piece(piece)
            if not sp.is_byte(piece) and not sp.is_control(piece) and "▁" not in text:
                assert raw[x:y].decode() in (shown.replace("▁", " "), shown[1:].replace("▁", " "))
    assert P.pieces(MODEL).decode([m[0] for m in P.pieces(MODEL).encode(texts)]) == sp.decode([sp.encode(t) for t in texts])


def test_known_texts():
    check(TEXTS)
    check(TEXTS)  # from the cache


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40) | st.text(" ▁aé.\n", max_size=20), max_size=5))
def test_any_text(texts):
    check(texts)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab ①ﬁｆ㍿éÀ　 \t½ᄀ가ﷺ")), max_size=20))
def test_compiled_map_against_the_library(text):
    import sentencepiece

    n = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = next(v for k, v in P._fields(n.serialized_model_proto()) if k == 3)
    made, start, stop = P.Normaliser(spec)(text)
    want = n.normalize(text)
    assert made == want
    raw = text.encode()
    assert len(start) == len(stop) == len(made.encode())
    assert (np.diff(start) >= 0).all() and all(0 <= a <= b <= len(raw) for a, b in zip(start, stop, strict=True))
    for a, b in zip(start, stop, strict=True):
        raw[a:b].decode()  # whole characters


def test_digest_of_odd_rows(spark):
    rows = [(k, t, "x") for k, t in enumerate([*TEXTS, None])] + [(None, "a", "y"), (0, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = P.encode_digest(df, MODEL).collect()
    sp = library()
    want = sorted((str(k), hashlib.sha256(np.array(sp.encode(t or "", add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(sp.encode(t or "")).encode()).hexdigest()) for k, t, _ in rows)
    assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert P.encode_digest(df.limit(0), MODEL).count() == 0


def test_other_models_are_refused(tmp_path):
    with pytest.raises((ValueError, RuntimeError)):
        P.Pieces(str(tmp_path / "none.model"))

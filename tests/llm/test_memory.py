"""What a worker holds at once: batches by bytes, hashes by blocks, one pass through Python."""

import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm import pieces as P
from quern.llm import shared
from quern.llm.shared import tokenizer_file

MODEL = tokenizer_file("piece_bpe_32k.model")


def spans(text):
    data, at = shared.buffer_of(pa.array([text]))
    return data, *shared.word_spans(data, at)[:2]


def test_hashes_of_words_need_small_tables_and_no_place():
    words = ["Alpha", "b", "x" * (shared.HASH_BYTES + 5), "straße", "alpha"] + [f"w{k % 977}" for k in range(200_000)] + ["ALPHA"]
    held = dict(shared._powers)
    shared._powers.clear()
    short = spans(" ".join(words[3:]))
    got = shared.word_hashes(*short)
    assert len(short[0]) > 2 * shared.HASH_BYTES >= len(shared._powers["up"])
    whole = shared.word_hashes(*spans(" ".join(words)))
    alone = {w: shared.word_hashes(*spans(w))[0] for w in set(words)}
    assert whole.tolist() == [alone[w] for w in words] and got.tolist() == whole[3:].tolist()
    assert alone["Alpha"] == alone["ALPHA"] and len(set(whole.tolist())) == 977 + 4
    assert not len(shared.word_hashes(*spans("  ")))
    shared._powers.update(held)


def test_batches_end_by_bytes(spark):
    def size(batch):
        return pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    before = spark.conf.get(shared.BATCH_LIMIT, None)
    try:
        df = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("text"))
        spark.conf.unset(shared.BATCH_LIMIT)
        got = shared.map_batches(df, size, "n long, size long").collect()
        assert sum(r.n for r in got) == 4000 and max(r.size for r in got) < shared.SLICE_BYTES
        spark.conf.set(shared.BATCH_LIMIT, "100k")  # what the session sets stays
        assert max(r.size for r in shared.map_batches(df, size, "n long, size long").collect()) < 200_000
    finally:
        spark.conf.set(shared.BATCH_LIMIT, before) if before else spark.conf.unset(shared.BATCH_LIMIT)


def test_digest_of_pieces_takes_one_pass(spark):
    rows = [(1, "Hello  wörld"), (2, None), (3, ""), (4, "one\ntwo")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = P.encode_digest(df, MODEL)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    coded = P.encode(df, MODEL)
    spans_of = {r.doc_id: r.d for r in coded.select("doc_id", F.sha2(F.concat("begins", "ends"), 256).alias("d")).collect()}
    text_of = {r.doc_id: r.d for r in P.decode(coded, MODEL).select("doc_id", F.sha2("decoded", 256).alias("d")).collect()}
    got = made.collect()
    assert {r.doc_id: r.spans_sha256 for r in got} == spans_of and {r.doc_id: r.decoded_sha256 for r in got} == text_of

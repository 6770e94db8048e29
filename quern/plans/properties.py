"""Orders as pages in JSON, read back as typed metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators.properties import page_metadata
from quern.plans.common import Book
from quern.views import table

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles

#: By o_orderkey % 12, what is wrong with a page (a property more, or another one's JSON), and why it is refused.
FAULTS = {
    1: ("unsupported", ',"Odd":{"id":"od","type":"button","button":{}}'),
    2: ("invalid", ',"Count":{"id":"ct","type":"number","number":"5"}'),
    3: ("invalid", ',"Other":{"id":"ti2","type":"title","title":[]}'),
    4: ("invalid", ',"Twice":{"id":"pr","type":"checkbox","checkbox":true}'),
    5: ("unsupported", ',"Links":{"id":"ln","type":"relation","relation":[],"has_more":true}'),
    6: ("invalid", ',"":{"id":"","type":"url","url":null}'),
    7: ("invalid", ',"When":{"id":"wh","type":"date","date":{"start":7}}'),
}
_REASON = "CASE o_orderkey % 12 " + " ".join(f"WHEN {k} THEN '{why}'" for k, (why, _) in FAULTS.items()) + " END"
_D = lambda h: f"substring({h}, 1, 8) || '-' || substring({h}, 9, 4) || '-' || substring({h}, 13, 4) || '-' || substring({h}, 17, 4) || '-' || substring({h}, 21, 12)"


@BOOK.query("page_metadata_typed", f"""WITH o AS (SELECT *, {_REASON} AS reason, md5(CAST(o_orderkey AS VARCHAR)) AS h, md5(CAST(o_custkey AS VARCHAR)) AS c FROM orders)
  SELECT o_orderkey, reason, CASE WHEN reason IS NULL THEN {_D('h')} END AS id, CASE WHEN reason IS NULL THEN 'Order ' || o_orderkey END AS title, CASE WHEN reason IS NULL THEN o_orderkey % 3 = 0 END AS archived,
    CASE WHEN reason IS NULL THEN CAST(floor(o_totalprice) AS DOUBLE) END AS price, CASE WHEN reason IS NULL THEN CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE 'text:' || o_orderstatus END END AS status,
    CASE WHEN reason IS NULL THEN least(o_orderpriority, o_orderstatus) || '|' || greatest(o_orderpriority, o_orderstatus) END AS tags, CASE WHEN reason IS NULL THEN strftime(o_orderdate, '%Y-%m-%d') END AS due,
    CASE WHEN reason IS NULL THEN {_D('c')} END AS owner, CASE WHEN reason IS NULL THEN o_orderkey % 2 = 0 END AS even, CASE WHEN reason IS NULL THEN 'Parent' END AS relation FROM o""")
def page_metadata_typed(spark, sf_dir):
    """Pages with properties of ten types; seven in twelve have a fault and are refused as a whole."""
    key = F.col("o_orderkey").cast("string")
    h, c, k = F.md5(key.cast("binary")), F.md5(F.col("o_custkey").cast("string").cast("binary")), F.col("o_orderkey")
    fault = F.lit("")
    for at, (_, more) in FAULTS.items():
        fault = F.when(k % 12 == at, more).otherwise(fault)
    select = F.when(k % 5 == 0, "null").otherwise(F.concat(F.lit('{"name":"'), "o_orderstatus", F.lit('"}')))
    parts = [
        '{"object":"page","id":"', h, '","url":"https://pages.example.com/T-', h, '?v=1","last_edited_time":"', F.date_format("o_orderdate", "yyyy-MM-dd"), 'T10:00:00.000Z","in_trash":', F.when(k % 3 == 0, "true").otherwise("false"), ',"archived":false,"properties":{',
        '"Name":{"id":"title","type":"title","title":[{"type":"text","plain_text":"Order "},{"type":"text","plain_text":"', key, '"}]},"Price":{"id":"pr","type":"number","number":', F.floor("o_totalprice").cast("string"),
        '},"Status":{"id":"st","type":"select","select":', select, '},"Tags":{"id":"tg","type":"multi_select","multi_select":[{"name":"', F.col("o_orderpriority"), '"},{"name":"', F.col("o_orderstatus"), '"}]},"Due":{"id":"du","type":"date","date":{"start":"', F.date_format("o_orderdate", "yyyy-MM-dd"),
        '","end":null}},"Owner":{"id":"ow","type":"people","people":[{"object":"user","id":"', c, '"}]},"Even":{"id":"ev","type":"formula","formula":{"type":"boolean","boolean":', F.when(k % 2 == 0, "true").otherwise("false"), '}},"Parent":{"id":"rel","type":"relation","relation":[{"id":"', c, '"}],"has_more":false}', fault, "}}",
    ]
    said = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    # a file is often one task, and reading a page's JSON takes far longer than dealing out the orders that it is made of
    orders = table(spark, sf_dir, "orders").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    made = page_metadata(orders.select("o_orderkey", said.alias("json")), "o_orderkey", "json", ["pages.example.com"])
    of = lambda n: F.try_element_at("properties", F.lit(n))
    return made.select(
        "o_orderkey", "reason", "id", "title", "archived", of("pr")["number"].alias("price"), F.concat_ws(":", of("st")["kind"], of("st")["text"]).alias("_s"), F.array_join(of("tg")["items"], "|").alias("tags"), of("du")["start"].alias("due"),
        of("ow")["items"][0].alias("owner"), of("ev")["flag"].alias("even"), F.try_element_at("relations", F.lit("rel")).alias("relation"),
    ).withColumn("status", F.when(F.col("reason").isNull(), F.col("_s"))).drop("_s")

import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestrata import queries as q
from lodestrata.functions import dates, names
from lodestrata.operators import verify
from lodestrata.sources import journal
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_matches_sql(spark, name):
    compare(spark, q.queries()[name], q.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert q.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200


def test_partitioning_changes_nothing(spark):
    got = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, q.queries()["a5_duplicate_roles"](spark, SF).collect()), key=repr))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


def test_manifest_escape_of_every_control(spark):
    texts = [None, "", "plain", "a\\b\\n", "tab\there", "\n\r\n", *[f"<{chr(c)}{chr(c)}1>" for c in (*range(32), *range(127, 161))], "\x00" * 3 + "é漢\x85\t"]
    short = {"\n": "\\n", "\r": "\\r"}
    want = {i: t and "".join(short.get(c) or (f"\\u{{{ord(c):x}}}" if unicodedata.category(c) == "Cc" else c) for c in t) for i, t in enumerate(texts)}
    assert {r.i: r.e for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", names.manifest_escape(F.col("t")).alias("e")).collect()} == want


def test_keyed_digests_are_those_of_hashlib(spark):
    texts = {r.doc_id: r.text for r in q.table(spark, SF, "documents").select("doc_id", "text").collect()}
    key = verify.KEY if isinstance(verify.KEY, bytes) else verify.KEY.encode()
    want = {i: None if t is None else hashlib.sha512(key + t.encode()).hexdigest() for i, t in texts.items()}
    assert {r.doc_id: r.digest for r in q.queries()["m3_keyed_digest"](spark, SF).collect()} == want


def test_a_parser_that_loses_seq_is_seen(spark, monkeypatch):
    run, parse = q.queries()["c1_journal_lines"], journal.parse
    monkeypatch.setattr(journal, "parse", lambda *a: parse(*a).withColumn("seq", F.lit(None).cast("long")))
    with pytest.raises(AssertionError):
        compare(spark, run, q.oracle_sql()["c1_journal_lines"], SF)


def test_a_companion_over_a_recorded_date_is_seen(spark, monkeypatch):
    run, picked = q.queries()["d13_date_priority"], dates.prioritised
    compare(spark, run, q.oracle_sql()["d13_date_priority"], SF)
    monkeypatch.setattr(dates, "prioritised", lambda ts, c, *rest: picked(F.when(F.size(c) == 0, ts), c, *rest))
    with pytest.raises(AssertionError):
        compare(spark, run, q.oracle_sql()["d13_date_priority"], SF)


@pytest.mark.parametrize(("name", "rows"), [("w4_ledger", 10_050), ("w4_natural_names", 100_600)])
def test_more_files_of_a_name_than_the_library_tries(spark, tmp_path, name, rows):
    o = spark.range(rows).select(F.col("id").alias("o_orderkey"), F.lit("F").alias("o_orderstatus"), F.expr("timestamp '1995-03-01' + make_dt_interval(cast(id % 20 as int))").alias("o_orderdate"))
    o.coalesce(1).write.parquet(str(tmp_path / "o"))
    next((tmp_path / "o").glob("*.parquet")).rename(tmp_path / "orders.parquet")
    assert compare(spark, q.queries()[name], q.oracle_sql()[name], str(tmp_path)) == rows

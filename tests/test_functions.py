"""Scalar functions on small cases."""

from pyspark.sql import functions as F

from quarry.functions import text as fn


def values(spark, column, inputs, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}").orderBy("i").select(column(F.col("x"))).collect()]


def test_identifiers(spark):
    raw = ["TS 24.301", "ts_124301_v18.9.0_LTE_NAS", "tr_137901_15.01.00", "ts_134123-1_v15-08-00", "ts_151010-1_x", "ts_24_301_1", "ts_136523-1", None, "", "RFC 8446"]
    assert values(spark, fn.normalize_id, raw) == ["ts_24_301", "ts_24_301", "tr_37_901", "ts_34_123_1", "ts_51_010_1", "ts_24_301_1", "ts_36_523_1", "unknown", "unknown", "rfc_8446"]


def test_titles_parents_depth(spark):
    assert values(spark, fn.clean_title, ["Scope ..... 12", "a \t b", "5.3.2  Overview .......... 42", None]) == ["Scope", "a b", "5.3.2 Overview", ""]
    assert values(spark, fn.parent_id, ["ts_24_301:5.3.2", "ts_24_301:5", None]) == ["ts_24_301:5.3", None, None]
    assert values(spark, fn.depth, ["5", "5.3", "5.3.2.1", None]) == [0, 1, 3, 0]


def test_brief(spark):
    long, short = values(spark, lambda x: fn.brief(x, 80), ["word " * 100, "short"])
    assert short == "short" and len(long) <= 82 and long.endswith("…")


def test_numbers(spark):
    row = spark.range(1).select(fn.delivery_number(F.lit(24), F.lit(301), F.lit(None).cast("int")).alias("a"), fn.delivery_number(F.lit(34), F.lit(123), F.lit(1)).alias("b"), fn.range_directory(F.lit(124301)).alias("c")).collect()[0]
    assert tuple(row) == ("124301", "13412301", "124300_124399")
    back = spark.createDataFrame([("etsi_ts", "124301"), ("etsi_ts", "13412301"), ("etsi_en", "124301"), ("etsi_ts", "24301"), ("etsi_ts", "x24301"), ("etsi_ts", "099999")], "k string, n string")
    assert [r[0] for r in back.select(fn.mapped_id(F.col("k"), F.expr("case when n rlike '^[0-9]+$' then n else '' end"))).collect()] == ["ts_24_301", "ts_34_123_1", None, None, None, None]


def test_white_space_of_all_kinds(spark):
    """Blanks beyond ASCII count as white space where the text's own language says so."""
    assert values(spark, fn.collapsed, ["a  b　", "﻿a"]) == ["a b", "a"]


def test_citations(spark):
    """Parts of numbers are lost (G9); white space may be unbreakable; short numbers are none."""
    got = values(spark, fn.citations, ["3GPP TS 34.123-1, ts 11.222, RFC–1234 RFC 12 xRFC 9999 TR 138.104"])[0]
    assert [(c["target_id"], c["ref_type"]) for c in got] == [("ts_34_123", "3gpp"), ("ts_11_222", "3gpp"), ("tr_138_104", "3gpp"), ("rfc_1234", "rfc")]


def test_lengths_are_code_points(spark):
    """Characters, not UTF-16 units."""
    assert values(spark, lambda x: F.length(fn.span_brief(x)), ["🙂" * 300]) == [200]

"""Scalar functions, table by table."""

import hashlib
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.functions import facts, normalize, text, vectors


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def table(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", column(F.col("v")).alias("x"))
    return [r["x"] for r in rows.orderBy("i").collect()]


def test_money(spark):
    same = ["INR 33.38 Cr", "Rs. 33.38 Cr", "₹33.38 Cr", "33.38 Crore", "3,338.00 Lakh", "333800000", "33,38,00,000", "Rupees 33.38 crore", "33.38Cr"]
    assert [r.number for r in table(spark, same, normalize.money)] == [Decimal(333800000)] * len(same)
    assert [r.number for r in table(spark, ["2.5", "3.5", "1.5 M", "2 K"], normalize.money)] == [2, 4, 1500000, 2000]
    assert [r.status for r in table(spark, ["", "abc", "1.2.3", None], normalize.money)] == ["failed"] * 4


def test_percent_date_unit(spark):
    assert [r.number for r in table(spark, ["33.33%", "33.33 %", "33.33 percent", "33.33 percentage"], normalize.percentage)] == [Decimal("33.33")] * 4
    days = ["10-03-2021", "2021-03-10", "10 March 2021", "March 10, 2021", "10/03/2021", "Dated: 10 Mar 2021", "2021-03-10T05:00"]
    assert [r.value for r in table(spark, days, normalize.date)] == ["2021-03-10"] * len(days)
    assert [r.status for r in table(spark, ["31-02-2021", "10 Foo 2021", "", None], normalize.date)] == ["failed"] * 4
    assert [r.value for r in table(spark, ["sqm", "sq m", "Crore", "Lacs", "days", "yard"], normalize.unit)] == ["sqm", "sqm", "crore", "lakh", "days", None]


def test_older_numbers_and_dates(spark):
    assert [r.number for r in table(spark, ["₹12.5 M", "12.34.56", "5 Cr", "7 Lakh"], normalize.number)] == [12500000, None, 50000000, 700000]
    assert [str(d) for d in table(spark, ["10/03/2021", "March 10, 2021", "10 Mar 2021", "10.03.2021", "March 2021"], normalize.month_date)] == ["2021-03-10"] * 4 + ["2021-03-01"]
    assert table(spark, ["12.5", "13.5", "x"], normalize.currency) == [12, 14, None]


def test_infer_picks_the_first_sign_and_stays_there(spark):
    got = table(spark, ["INR 5", "5%", "10-03-2021", "1,234.5", "-7", "words", "INR words", "", None], normalize.infer)
    assert [r.type for r in got] == ["currency_inr", "percentage", "date", "number", "number", None, None, None, None]


@pytest.mark.parametrize("header,want", [("Contract Value (INR)", "contract_value"), ("Amount (INR)", "amount"), ("Rate", "rate"), ("Qty", "quantity"), ("S No", "item_number"), ("Description", "description"), ("End Date", "date"), ("UOM", "unit"), ("Remarks", None)])
def test_headers(spark, header, want):
    assert one(spark, facts.header_predicate(F.col("h")), h=header) == want


def test_ids_and_cells(spark):
    assert one(spark, facts.stable_hex(F.col("a"), F.lit(None), F.lit(3)), a="x") == hashlib.sha256(b"xNone3").hexdigest()
    assert table(spark, ["A1", "Z9", "AA10", "12", None], facts.column_index) == [1, 26, 27, 0, 0]
    assert table(spark, ["A1", "AB305", "A"], facts.row_number) == [1, 305, 0]
    assert one(spark, facts.label_before(F.col("p"), F.col("v")), p="x\nContract Value: INR 5 (a)\n", v="INR 5 (a)") == "Contract Value"


def test_scores_and_formats(spark):
    rows = spark.createDataFrame([(100.0, 100.0, 1.0), (100.0, 50.0, 0.5), (100.0, 300.0, 0.0), (0.0, 0.0, 1.0), (0.0, 1.0, 0.0), (5.0, None, 0.0), (-10.0, -9.0, 0.9)], "g double, a double, want double")
    assert all(abs(r.x - r.want) < 1e-9 for r in rows.select("want", facts.score_answer(F.col("g"), F.col("a")).alias("x")).collect())
    shown = spark.createDataFrame([(5.0, "count", "5"), (12.3456, "percent", "12.35"), (12.5, "money", "12.5"), (None, "money", "0"), (333800000.0, "money", "333800000"), (0.25, "days", "0.25")], "v double, k string, want string")
    assert all(r.x == r.want for r in shown.select("want", facts.format_answer(F.col("v"), F.col("k")).alias("x")).collect())
    assert table(spark, ["5", "1,000.5", "INR 2 Cr", "50%", "none", ""], facts.coerce_number) == [5.0, 1000.5, 2e7, 50.0, None, None]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_similarity(spark):
    pairs = [("kitten", "sitting"), ("", ""), ("", "a"), ("abc", "abc"), ("é日", "日é"), ("total price", "price total")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = rows.select("i", text.lcs_length(F.col("a"), F.col("b")).alias("n"), text.indel_ratio(F.col("a"), F.col("b")).alias("r"), text.token_sort_ratio(F.col("a"), F.col("b")).alias("t"), text.ratio_bound(F.col("a"), F.col("b")).alias("m")).orderBy("i").collect()
    for (a, b), r in zip(pairs, got, strict=True):
        assert r.n == lcs(a, b)
        assert abs(r.r - (200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100)) < 1e-9 and r.r <= r.m + 1e-9
    assert got[-1].t == 100
    assert table(spark, ["  Éa-b_C  1 ", None], text.normalize_text) == ["éa b c 1", None]


def test_hash_embedding(spark):
    data = b"".join(hashlib.sha256(f"Bridge:{i}".encode()).digest() for i in range(2))
    raw = [struct.unpack(">I", data[i * 4 : i * 4 + 4])[0] / (2**32 - 1) * 2 - 1 for i in range(16)]
    size = sum(x * x for x in raw) ** 0.5
    got = one(spark, vectors.hash_embedding(F.col("t"), 16), t="Bridge")
    assert max(abs(a - b / size) for a, b in zip(got, raw, strict=True)) < 1e-12
    v = vectors.hash_embedding(F.col("t"), 16)
    assert abs(one(spark, vectors.cosine(v, v), t="x") - 1) < 1e-6


def test_hash_embedding_is_computed_for_distinct_names_only(spark, tmp_path):
    from tessera.queries import functions

    spark.createDataFrame([("a",), ("a",), ("b",)], "p_name string").write.parquet(str(tmp_path / "part.parquet"))
    rows = functions.hash_embedding(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1 and "Filter" not in plan
    assert rows.count() == 2 * vectors.DIMENSION

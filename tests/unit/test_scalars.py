"""Scalar rules on small rows."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars as S


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, [{str: "string", int: "int", float: "double", bool: "boolean", type(None): "string"}[type(v)] for v in values.values()], strict=True))).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("fn", "text", "want"),
    [
        (S.slug, "  Große Firma & Co -- Ltd ", "-groe-firma-co-ltd-"),
        (S.owner_slug, "A.b C", "a-b-c"),
        (S.digits_of, "No. 0012-3", "00123"),
        (S.digits_of, "none", None),
        (S.normal_permit, " 00120 ", "120"),
        (S.normal_permit, "000", "0"),
        (S.normal_permit, "", None),
        (S.permit_of_filename, "x_12_34.pdf", "12"),
        (S.permit_of_filename, "x.pdf", None),
        (S.well_number, "A12 / 3", "A12-3"),
        (S.well_number, "A / B / C", "A / B / C"),
        (S.lenient_number, "12.5 ft", 12.5),
        (S.lenient_number, "-3e2x", -300.0),
        (S.lenient_number, "ft", None),
        (S.clean_table_text, 'a \\"b\\"', "a 'b'"),
        (S.sanitised, " <b>JavaScript:x onclick=y</b> ", "bx y/b"),
        (S.clean_title, '"Job Wells of Kent Extraction"', "Wells of Kent"),
        (S.clean_title, "ab", None),
        (S.clean_title, "x" * 120, "x" * 97 + "..."),
        (S.content_type, "A.PDF", "application/pdf"),
        (S.content_type, "a.bin", "application/octet-stream"),
        (S.document_kind, "scan.TIFF", "image"),
        (S.document_kind, "a.tar.gz", "other"),
        (S.role_rank, "owner", 3),
        (S.role_rank, "guest", -1),
    ],
)
def test_text_rules(spark, fn, text, want):
    assert one(spark, fn(F.col("t")), t=text) == want


@pytest.mark.parametrize(("label", "want"), [("doc_title", "# x"), ("HEADER", "## x"), ("paragraph_title", "### x"), ("figure_title", "#### x"), ("footer", "*x*"), ("vision_footnote", "<small>x</small>"), ("number", "**x**"), ("table", "x"), (None, "x")])
def test_blocks(spark, label, want):
    assert one(spark, S.block_markdown(F.col("t"), F.col("l")), t="x", l=label) == want


def test_truthiness(spark):
    for a, b, kind, want in (("", "r", "string", "r"), ("o", "r", "string", "o"), (0.0, 2.0, "number", 2.0), (float("nan"), 2.0, "number", 2.0), (1.5, 2.0, "number", 1.5)):
        assert one(spark, S.first_truthy(F.col("a"), F.col("b"), kind), a=a, b=b) == want


def test_numbers(spark):
    assert one(spark, S.backoff_ms(F.col("n")), n=3) == 40000
    assert abs(one(spark, S.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), n=1) - 111194.9) < 1
    assert one(spark, S.queue_health(F.lit(101), F.lit(11), F.lit(300001))[0], n=1) == 40
    assert one(spark, S.queue_health(F.lit(101), F.lit(11), F.lit(300001))[1], n=1) == "critical"
    assert one(spark, S.queue_health(F.lit(0), F.lit(0), F.lit(0))[1], n=1) == "healthy"


def test_maps_and_centres(spark):
    m = S.merge_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))
    assert one(spark, m, n=1) == {"a": "1", "b": "3"}
    assert one(spark, S.centre(F.lit(1.0), F.lit(3.0), F.lit(0.0), F.lit(2.0)), n=1) == (2.0, 1.0)
    assert one(spark, S.centre(F.lit(float("inf")), F.lit(3.0), F.lit(0.0), F.lit(2.0)), n=1) is None
    assert one(spark, S.centre(F.lit(None).cast("double"), F.lit(3.0), F.lit(0.0), F.lit(2.0)), n=1) is None


@pytest.mark.parametrize(("pages", "want"), [("[1,2,3]", 3), ("[]", 9), ("7", 7), ('{"length": 4}', 4), ('{"count": 5}', 5), ('{"total": 6}', 6), ("{}", 9), (None, 9), ("not json", 9)])
def test_page_count(spark, pages, want):
    df = spark.createDataFrame([(pages,)], "p string")
    assert df.select(S.page_count(F.col("p"), F.lit(9))).first()[0] == want


def test_reconcile(spark):
    def both(a, b):
        df = spark.createDataFrame([(a, b)], "a string, b string")
        return tuple(df.select(*S.reconcile(F.col("a"), F.col("b"))).first())

    assert both("007", "7") == ("7", True)
    assert both("8", "7") == ("8", False)
    assert both(None, "07") == ("7", False)
    assert both(None, None) == (None, True)

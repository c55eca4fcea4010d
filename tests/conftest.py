import datetime
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from tidemark import schemas as S  # noqa: E402
from tidemark.functions import risk_score  # noqa: E402
from tidemark.plans.suite import Suite  # noqa: E402
from tidemark.session import builder  # noqa: E402
from tidemark.sources import seeds  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        builder("tidemark-tests")
        .master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("catalog")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def month(text):
    return datetime.date.fromisoformat(text + "-01")


def staging_row(customer_id="CUST_A", at="2024-01", **values):
    row = dict(
        customer_id=customer_id,
        month=month(at),
        region="EMEA",
        plan_type="Growth",
        channel="Partner",
        segment="Mid-Market",
        monthly_revenue=Decimal("100.00"),
        churn_flag=0,
        active_flag=1,
        usage_score=Decimal("0.500"),
        support_tickets=0,
        failed_payments=0,
        cohort_month=month(at),
    )
    row.update(values)
    return tuple(row[name] for name in S.STAGING.fieldNames())


@pytest.fixture
def staging_of(spark):
    return lambda *rows: spark.createDataFrame(list(rows), S.STAGING)


@pytest.fixture
def fact_of(spark):
    """A fact frame from (customer_key, 'YYYY-MM', overrides) tuples."""

    def build(*rows):
        full = []
        for key, at, values in rows:
            row = dict(
                sub_key=len(full) + 1,
                customer_key=key,
                date_key=month(at),
                plan_key=2,
                monthly_revenue=Decimal("100.00"),
                churn_flag=0,
                active_flag=1,
                usage_score=Decimal("0.500"),
                support_tickets=0,
                failed_payments=0,
                churn_risk_score=None,
                region="EMEA",
                segment="Mid-Market",
                loaded_at=datetime.datetime(2024, 1, 1),
            )
            row.update(values)
            full.append(tuple(row[name] for name in S.FACT.fieldNames()))
        df = spark.createDataFrame(full, S.FACT)
        return df.withColumn("churn_risk_score", F.coalesce("churn_risk_score", risk_score()))

    return build


@pytest.fixture
def suite_of(spark):
    """A suite over a fact frame; every customer has the same dimension attributes."""

    def build(fact, thresholds=None):
        customers = fact.groupBy("customer_key").agg(
            F.format_string("CUST_%05d", F.first("customer_key")).alias("customer_id"),
            F.min("date_key").alias("cohort_month"),
            F.min("region").alias("region"),
            F.lit("Growth").alias("plan_type"),
            F.lit("Partner").alias("channel"),
            F.min("segment").alias("segment"),
            F.lit(datetime.datetime(2024, 1, 1)).alias("created_at"),
        )
        return Suite(
            fact=fact,
            customers=customers,
            plans=seeds.plans(spark),
            thresholds=seeds.thresholds(spark) if thresholds is None else thresholds,
        )

    return build


def only(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]

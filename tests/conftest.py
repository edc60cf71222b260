import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from riskmart.session import get_session
    s = get_session("local[4]", extra={"spark.sql.shuffle.partitions": "4",
                                       "spark.ui.showConsoleProgress": "false",
                                       "spark.driver.memory": "4g"})
    yield s
    s.stop()


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def applicant(spark, **over):
    """One typed applicant request (the form's example values by default)."""
    from riskmart.schemas import APPLICANT_SCHEMA
    base = dict(applicant_id=1, name="Rajan Kumar", age=35.0, gender="M", education="Secondary",
                family_status="Married", children=0, family_members=2, own_car="N", own_realty="N",
                income_type="Working", monthly_income=50000.0, occupation="Laborers",
                employment_months=36, housing_type="House / apartment", region_rating=2,
                loan_amount=500000.0, loan_purpose="Home Loan", tenure_months=60,
                ext1=0.60, ext2=0.65, ext3=0.55)
    base.update(over)
    return spark.createDataFrame([tuple(base[f.name] for f in APPLICANT_SCHEMA.fields)], APPLICANT_SCHEMA)

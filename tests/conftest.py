import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from slotlog.constants import STATUS_TEXT  # noqa: E402
from slotlog.session import get_session  # noqa: E402

CODE = {text: code for code, text in STATUS_TEXT.items()}


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", master=os.environ.get("TEST_MASTER", "local[8]"), shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def day(n, hour=9, minute=0):
    return dt.datetime(2019, 1, 1, hour, minute) + dt.timedelta(days=n)


def minutes(n):
    return dt.timedelta(minutes=n)


RAW_SCHEMA = ("FillerOrderNo long, MRNCmpdId string, History_MessageDtTm timestamp_ntz, ingest_seq long, "
              "History_OrderStatus string, History_ObsStartPlanDtTm timestamp_ntz, PatientClass string, "
              "EnteringOrganisationDeviceID string, UniversalServiceName string, OrderStatus string, Klasse string, "
              "Sex string, DateOfBirth timestamp_ntz, Zivilstand string, Zip string, Beruf string, ReasonForStudy string, "
              "Telefon string")


def raw_log(spark, rows, patient_class="ambulant", patients=None):
    """Rows are (time, status, planned) or (appointment, time, status, planned); ties keep their order.

    As in the original cases the order status is that of the last row of all.
    """
    rows = [r if len(r) == 4 else (0, *r) for r in rows]
    final = CODE[rows[-1][2]]
    data = [(f, (patients or {}).get(f, "0"), t, i, CODE[s], p, patient_class, "MR1", "MR", final, "A", "weiblich",
             dt.datetime(1994, 3, 5), "UNB", "8001", "Arzt", "cancer", "0") for i, (f, t, s, p) in enumerate(rows)]
    return spark.createDataFrame(data, RAW_SCHEMA)


def records(df, columns, order=None):
    rows = df.select(*columns).collect()
    out = [tuple(r) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r)) if order is None else out


def post_codes(spark):
    return spark.createDataFrame([("8001", 47.37, 8.54), ("8091", 47.38, 8.55), ("3000", 46.95, 7.45)],
                                 "post_code string, lat double, lon double")

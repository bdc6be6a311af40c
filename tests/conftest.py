import json
import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from windlass.session import local_session
    s = local_session(cores=4, shuffle_partitions=4, app="windlass-tests")
    yield s


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


def make_order(customer, category, region, amount, ts, **kw):
    """An order like the reference test helper builds (quantity 1,
    unitPrice = totalAmount, orderId order-<ts>)."""
    o = {"orderId": f"order-{ts}", "customerId": customer, "productId": "PROD-00001",
         "productName": "Test Product", "category": category, "region": region,
         "quantity": 1, "unitPrice": amount, "totalAmount": amount,
         "orderTimestamp": ts, "ingestionTimestamp": 1}
    o.update(kw)
    return o


def f1_orders():
    """ten orders at 1..10 s, customers CUST-0000{1..5}, plus a sentinel at 40 s."""
    out = [make_order("CUST-%05d" % ((i % 5) + 1), "ELECTRONICS", "NORTH", 100.0, i * 1000)
           for i in range(1, 11)]
    out.append(make_order("CUST-99999", "ELECTRONICS", "NORTH", 1.0, 40000))
    return out


def write_lines(directory, name, lines):
    os.makedirs(directory, exist_ok=True)
    path = os.path.join(directory, name)
    with open(path, "w") as f:
        for line in lines:
            f.write((line if isinstance(line, str) else json.dumps(line)) + "\n")
    return path


def orders_df(spark, orders):
    from windlass.schemas import ORDER
    rows = [tuple(o.get(f.name) for f in ORDER.fields) for o in orders]
    return spark.createDataFrame(rows, ORDER)

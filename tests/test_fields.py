import pytest

from reqlens.functions import fields as FD
from reqlens.sources import formats as FM


def test_infer_field_map_one_role_per_column():
    fm = FD.infer_field_map(FM.ALB_COLUMNS)
    assert fm == {"timestamp": "time", "clientIp": "client_ip", "responseTime": "request_processing_time",
                  "status": "elb_status_code", "method": "request_verb", "url": "request_url"}
    assert FD.infer_field_map(["x"], {"url": "x"}) == {"url": "x"}       # explicit map wins


def test_find_field_order():
    cols = ["request_url", "elb_status_code", "url"]
    assert FD.find_field(cols, "url") == "url"                          # exact name first
    assert FD.find_field(cols, "status", {"status": "elb_status_code"}) == "elb_status_code"
    assert FD.find_field(cols, "status", candidates=["nope", "url"]) == "url"
    assert FD.find_field(["bytes_sent"], "bytes") == "bytes_sent"        # default alternatives
    assert FD.find_field(cols, "referer") is None


def test_require_field_and_availability(spark):
    df = spark.createDataFrame([("t", "/a", 1)], "time STRING, request_url STRING, bytes_sent BIGINT")
    with pytest.raises(FD.FieldNotFound):
        FD.require_field(df, "client_ip")
    av = FD.feature_availability(df)
    assert av["request_per_uri"] and av["sent_bytes"] and not av["request_per_client"]

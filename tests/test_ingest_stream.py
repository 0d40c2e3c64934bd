import os
import tempfile

from pyspark.sql import functions as F

from mailfeat.sources import raw as S


def test_binary_ingest(spark):
    root = tempfile.mkdtemp(prefix="mailfeat-raw-")
    os.makedirs(f"{root}/Demo/spam")
    os.makedirs(f"{root}/Demo/ham")
    with open(f"{root}/Demo/spam/m1.eml", "wb") as f:
        f.write(b"From: security@paypa1.com\r\nTo:\r\nSubject: Verify?\r\n\r\nClick here now!!!\r\n")
    mp = (b"From: Ana <ana@example.org>\r\nTo: a@b.com, c@d.com\r\nMIME-Version: 1.0\r\n"
          b"Content-Type: multipart/alternative; boundary=XX\r\n\r\n--XX\r\nContent-Type: text/plain\r\n\r\n"
          b"meeting notes attached\r\n--XX\r\nContent-Type: text/html\r\n\r\n<p>x</p>\r\n--XX--\r\n")
    with open(f"{root}/Demo/ham/m2.eml", "wb") as f:
        f.write(mp)
    with open(f"{root}/Demo/ham/.hidden", "wb") as f:
        f.write(b"From: x@y.z\r\n\r\nx")
    ft = S.build_feature_table(spark, root, ["Demo", "Missing"]).collect()
    by = {os.path.basename(r.msg_id): r for r in ft}
    assert set(by) == {"m1.eml", "m2.eml"}
    assert by["m1.eml"].label == 1 and by["m2.eml"].label == 0
    assert by["m1.eml"].To_empty == 1.0 and by["m1.eml"].from_domain_typosquat_score == 0.1
    assert by["m2.eml"].body_text.strip() == "meeting notes attached"
    assert by["m2.eml"].Total_Recp == 1.0


def test_feature_cache_builds_what_is_missing(spark):
    root, cache = tempfile.mkdtemp(prefix="mailfeat-raw-"), tempfile.mkdtemp(prefix="mailfeat-cache-") + "/ft"
    for ds in ("A", "B"):
        os.makedirs(f"{root}/{ds}/spam")
        os.makedirs(f"{root}/{ds}/ham")
        with open(f"{root}/{ds}/spam/{ds}.eml", "wb") as f:
            f.write(b"From: x@y.org\r\n\r\nhello there\r\n")
    count = lambda names, **how: {r.dataset: r["count"] for r in S.build_feature_table(spark, root, names, cache, **how).groupBy("dataset").count().collect()}
    assert count(["A"]) == {"A": 1}
    assert count(["A", "B"]) == {"A": 1, "B": 1}
    assert count(["B"], rebuild=True) == {"B": 1} and count(["A", "B"]) == {"A": 1, "B": 1}
    out = tempfile.mkdtemp(prefix="mailfeat-res-") + "/res"
    for ds in ("A", "B", "B"):
        S.write_results(spark.createDataFrame([(ds, 0.5)], "dataset string, f1 double"), out)
    assert sorted(r.dataset for r in S.read_results(spark, out).collect()) == ["A", "B"]


def test_undecodable_parts_are_counted():
    assert S.body_of(b"Content-Type: text/plain; charset=nope\r\n\r\nx") == ("", 1)
    assert S.body_of(b"Subject: s\r\n\r\n") == ("", 0)

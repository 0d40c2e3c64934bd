import pytest

from mailfeat.functions.similarity import decode_subject, domain_distance, ratio, typosquat_score
from mailfeat.operators import headers as H

MSG_A = "\r\n".join([
    'From: "Accounts" <accounts.security99+q@paypa1.com>', "To:", "Bcc: someone@example.net",
    "Message-ID: <1$4@relay.cheap-host.tk>", "Subject: =?utf-8?Q?Is_this_you=3F?=",
    "Received: from h1 by h2; Thu, 9 Mar 2023 14:20:07 +0000",
    "Received: from h2 by h3; Thu, 9 Mar 2023 14:20:09 +0000",
    "Received: from h3 by h4; Thu, 9 Mar 2023 14:22:00 +0000",
    "Received: from h4 by h5; Thu, 9 Mar 2023 14:27:37 +0000",
    "Reply-To: desk@relay.cheap-host.tk", "Received-SPF: softfail",
    "Return-Path: <bounce@odd-sender.top>", "", "body"])
MSG_B = "\r\n".join([
    "From: Ana Cruz <ana.cruz@example.org>", "To: team@example.org, lead@example.org",
    "Message-ID: <20240101.1@example.org>", "Subject: Meeting notes",
    "Received: from h1 by h2; Thu, 9 Mar 2023 14:20:07 +0000", "Reply-To: ana.cruz@example.org",
    "Received-SPF: pass", "Authentication-Results: mx; dkim=pass", "X-Mailer: Mutt",
    "Content-Transfer-Encoding: 7bit", "Return-Path: <ana.cruz@example.org>", "", "hello"])

WANT_A = [1, 1, 0, 1, 1, 0, 1, 1, 1, 1, 1, 0, 1, 1, 1, 1, 1,
          21 / 40, 2 / 21, 1 / 21, 1, 0.1, 0, 0, 4 / 40, 0, 1, 6 / 40, 0, 1,
          *(round(1 - ratio("paypa1.com", d), 4) for d in ("relay.cheap-host.tk", "odd-sender.top", "relay.cheap-host.tk"))]
WANT_B = [0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
          8 / 40, 0, 0, 0, 0, 0, 0, 8 / 40, 0, 0, 8 / 40, 0, 0, 0, 0, 0]


@pytest.fixture(scope="module")
def feats(spark):
    df = spark.createDataFrame([("A", MSG_A), ("B", MSG_B)], "msg_id string, raw string")
    df = df.selectExpr("msg_id", "'x' AS dataset", "1 AS label", "raw")
    out = H.header_features(H.split_message(df)).collect()
    return {r.msg_id: r for r in out}


def test_goldens(feats):
    from mailfeat.functions.constants import ALL_HEADER_FEATURES
    for mid, want in (("A", WANT_A), ("B", WANT_B)):
        got = [feats[mid][f] for f in ALL_HEADER_FEATURES]
        for f, g, w in zip(ALL_HEADER_FEATURES, got, want):
            assert g == pytest.approx(w, abs=1e-9), (mid, f, g, w)
        assert feats[mid].extract_error is None


def test_similarity_goldens():
    assert typosquat_score("paypa1.com") == 0.1
    assert typosquat_score("arnazon.com") == 0.1429
    assert typosquat_score("paypal.com") == 0.0
    assert typosquat_score("example.org") == 0.0
    assert typosquat_score("mail2.example.com") == 0.0
    assert domain_distance("paypa1.com", "") == 0.0


def test_non_ascii_header_is_an_error(spark):
    raw = "From: a@b.com\r\nSubject: Café\r\n\r\nx"
    df = spark.createDataFrame([("E", "x", 1, raw)], "msg_id string, dataset string, label int, raw string")
    r = H.header_features(H.split_message(df)).first()
    assert r.extract_error == "non_ascii_header"


def test_folded_header_kept(spark):
    raw = "To: a@x.com,\r\n b@y.com\r\nFrom: c@z.com\r\n\r\nbody"
    df = spark.createDataFrame([("F", raw)], "msg_id string, raw string")
    r = H.with_header_values(H.split_message(df)).first()
    assert r.h_to == "a@x.com,\r\n b@y.com"
    assert r.body_text == "body"


def parse(spark, *raws):
    df = spark.createDataFrame([(i, "x", 1, r) for i, r in enumerate(raws)], "msg_id int, dataset string, label int, raw string")
    return H.split_message(df)


def test_header_block_ends_at_the_first_other_line(spark):
    rows = parse(spark, "From: a@b.com\r\nnot a header line\r\nTo: x@y.com\r\n\r\nb", "\r\nTo: x@y.com\r\n\r\nb",
                 "From me 1\nTo: x@y.com\n\nb", " fold: first\nTo: x\n\nb", "To: x@y.com").orderBy("msg_id").collect()
    assert [[h.name for h in r.headers] for r in rows] == [["from"], [], ["to"], ["to"], ["to"]]
    assert [r.body_text for r in rows] == ["not a header line\r\nTo: x@y.com\r\n\r\nb", "To: x@y.com\r\n\r\nb", "b", "b", ""]


DATES = ["Thu, 9 Mar 2023 14:20:07 +0100", "9 Mar 2023 14:20 EST", "Thu, 9 March 2023 14:20:07", "9 Mar 2023 14:20:07 CEST",
         "9 Mar 23 14:20:07 -0000", "9 Mar 99 14:20:07 +0000", "Thu, 9 Mar 2023 14:20:07 +0530 (IST)", "yesterday", "31 Feb 2023 10:00:00 +0000"]


def test_dates_equal_the_standard_library(spark):
    from email.utils import parsedate_to_datetime

    df = spark.createDataFrame([(i, f"from a by b; {d}") for i, d in enumerate(DATES)], "i int, v string")
    got = [r.t for r in df.select("i", H.received_time(df.v).alias("t")).orderBy("i").collect()]
    for d, g in zip(DATES, got):
        try:
            want = parsedate_to_datetime(d)
        except ValueError:
            assert g is None, d
            continue
        from datetime import timezone
        assert g.naive == (want.tzinfo is None), d
        assert g.at == int((want if want.tzinfo else want.replace(tzinfo=timezone.utc)).timestamp()), d


def test_naive_and_mixed_dates(spark):
    two = lambda a, b: f"Received: from a by b; {a}\r\nReceived: from c by d; {b}\r\nReturn-Path: <>\t\r\n\r\n"
    raws = [two("9 Mar 2023 14:20:07", "9 Mar 2023 14:25:07"), two("9 Mar 2023 14:20:07 CEST", "9 Mar 2023 14:25:07 CEST"),
            two("9 Mar 2023 14:20:07", "9 Mar 2023 14:25:07 +0000")]
    rows = H.header_features(parse(spark, *raws)).orderBy("msg_id").collect()
    assert [r.Span_time for r in rows[:2]] == [1.0, 1.0] and [r.Return_Path_empty for r in rows] == [1.0] * 3
    assert [r.extract_error for r in rows] == [None, None, "mixed_naive_aware_dates"]
    zero = H.header_features(parse(spark, raws[2]), on_error="zero").first()
    assert zero.extract_error is None and zero.Return_Path_empty == 0.0


def test_subject_decoding():
    assert decode_subject("=?utf-8?Q?a=3F_b?=") == "a? b" and decode_subject("=?ISO-8859-1?B?4Q==?=") == "á"
    assert decode_subject("=?nope?Q?x?=") == "=?nope?Q?x?=" and decode_subject("plain") == "plain"

"""No message may stop a job: every codec name, random bytes, hostile headers and bodies."""

import base64
import encodings
import pkgutil
import random
import time
import warnings

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailfeat.functions import address as A
from mailfeat.functions.decoding import permissive
from mailfeat.functions.similarity import decode_subject
from mailfeat.functions.text import clean_text
from mailfeat.operators import headers as H
from mailfeat.sources import raw as S

CODECS = sorted({m.name for m in pkgutil.iter_modules(encodings.__path__)} | set(encodings.aliases.aliases) | {"undefined", "nope", "", "a\0b", "x" * 300, "utf-8\n"})


def test_every_codec_on_random_bytes():
    rng = random.Random(5)
    warnings.simplefilter("ignore")
    for name in CODECS:
        for size in (0, 1, 7, 60):
            octets = rng.randbytes(size)
            text, reason = permissive(octets, name)
            assert (text is None) != (reason is None)
            if text is not None:
                pa.array([text])  # what a column can hold
            assert isinstance(decode_subject(f"=?{name}?B?{base64.b64encode(octets).decode()}?="), str)
            message = b"Content-Type: text/plain; charset=\"" + name.encode() + b"\"\r\nContent-Transfer-Encoding: base64\r\n\r\n" + base64.b64encode(octets)
            body, broken, why = S.body_with_reason(message)
            pa.array([body])
            assert broken == (why is not None)


def test_random_messages():
    rng = random.Random(6)
    pieces = [b"Content-Type: multipart/mixed; boundary=b\r\n\r\n", b"--b\r\n", b"--b--", b"Content-Transfer-Encoding: quoted-printable\r\n", b"Content-Transfer-Encoding: x-uuencode\r\n",
              b"Content-Type: text/plain; charset*=idna''x\r\n", b"Content-Type: message/rfc822\r\n\r\n", b"begin 644 f\r\n#0V%T\r\n", b"\r\n", b"=E9=ZZ", b"\x00\xff\xfe", b"charset*0*=utf\0-8''%E9;"]
    for _ in range(400):
        body, broken, why = S.body_with_reason(b"".join(rng.choices(pieces, k=rng.randrange(1, 14))) + rng.randbytes(20))
        assert isinstance(body, str) and broken >= 0 and (why is None) == (broken == 0)
    assert S.body_with_reason(b"Content-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\n" * 3000)[1] >= 0  # nested deeper than the parser goes


@pytest.mark.parametrize("subject", ["=?idna?Q?abc?=", "=?undefined?Q?abc?=", "=?utf-8?B?YWéI?=", "=?utf-8?B?!?=", "=?a\0b?Q?x?="])
def test_broken_subjects_stay(subject):
    assert decode_subject(subject) == subject


def test_one_broken_message_among_others(spark):
    raws = [b"From: a@b.org\r\nSubject: =?undefined?Q?abc?=\r\nContent-Type: text/plain; charset=idna\r\n\r\n\xff\xfe", b"From: a@b.org\r\nSubject: s\r\n\r\nfine\r\n", b""]
    df = spark.createDataFrame([(str(i), "d", i % 2, r.decode("latin-1"), r) for i, r in enumerate(raws)], S.RAW_SCHEMA)
    rows = {r.msg_id: r for r in S.parse_raw(df).collect()}
    assert (rows["0"].undecoded_parts, rows["0"].body_text) == (1, "") and "Unicode" in rows["0"].body_error
    assert (rows["1"].undecoded_parts, rows["1"].body_error, rows["1"].body_text.strip()) == (0, None, "fine")
    assert H.header_features(S.parse_raw(df)).count() == 3


def test_cost_is_linear(spark):
    """Runs that match nothing: with a regex tried from every place these take minutes."""
    n = 300_000
    texts = ["a" * n, "<" * n, "a.b" * n, "(" * n, "http://" * (n // 7), "@" * n, "a@b+" * (n // 4)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    c = F.col("t")
    began = time.time()
    df.select(F.length(clean_text(c)), A.username(c), F.size(A.addresses(c)), A.domain(c)).collect()
    heads = df.select(F.lit(1).alias("msg_id"), F.lit("d").alias("dataset"), F.lit(1).alias("label"), F.concat(F.lit("From: "), c, F.lit("\r\nReceived: x; "), c, F.lit("\r\n\r\nb")).alias("raw"))
    H.header_features(H.split_message(heads)).select("From_symbol", "Span_time", "from_username_length", "extract_error").collect()
    assert time.time() - began < 60


def test_linear_patterns_match_as_before(spark):
    import re

    rng = random.Random(7)
    texts = ["".join(rng.choices("ab.+-@<>()1 ", k=rng.randrange(1, 40))) for _ in range(500)]
    df = spark.createDataFrame(pd.DataFrame({"t": texts}))
    for r in df.select("t", A.addresses(F.col("t")).alias("found"), A.username(F.col("t")).alias("user")).collect():
        assert r.found == re.findall(r"[\w.+\-]+@[\w.\-]+", r.t)
        first = re.search(r"([\w.+\-]+)@", r.t)
        assert r.user == (first.group(1).lower() if first else "")

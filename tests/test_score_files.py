"""L15 from raw files: a folder in one go and as a stream, with broken messages on their way to the quarantine."""

import base64
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from mailfeat.operators import learn as L
from mailfeat.plans import flows
from mailfeat.sources import raw as S
from mailfeat.streaming import score as C

SPAM, HAM = "please verify your account now and win the prize", "meeting notes about the project plan and the menu"


def message(text: str, kind: int) -> bytes:
    head = b"From: a@b.org\r\nTo: c@d.org\r\nSubject: s\r\n"
    if kind == 1:
        return head + b"Content-Transfer-Encoding: base64\r\n\r\n" + base64.encodebytes(text.encode()).replace(b"\n", b"\r\n")
    if kind == 2:
        return head + b"Content-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n" + text.encode() + b"\r\n--B\r\nContent-Type: text/html\r\n\r\n<p>x</p>\r\n--B--\r\n"
    return head + b"\r\n" + text.encode() + b"\r\n"


@pytest.fixture(scope="module")
def saved(spark):
    root = tempfile.mkdtemp(prefix="mailfeat-train-")
    for folder, text in (("spam", SPAM), ("ham", HAM)):
        os.makedirs(f"{root}/Demo/{folder}")
        for i in range(12):
            with open(f"{root}/Demo/{folder}/{i}.eml", "wb") as f:
                f.write(message(" ".join(text.split()[i % 3 :]), i % 3))
    ft = S.build_feature_table(spark, root, ["Demo"]).checkpoint()
    path = tempfile.mkdtemp(prefix="mailfeat-models-")
    flows.fit_matrix(ft, path, ["body_only"], ["RF"], settings=L.Settings(num_trees=8, max_depth=5))
    return path


@pytest.fixture(scope="module")
def folder():
    where = tempfile.mkdtemp(prefix="mailfeat-new-")
    files = {f"{name}{kind}.eml": message(text, kind) for name, text in (("spam", SPAM), ("ham", HAM)) for kind in range(3)}
    files["broken.eml"] = b"From: a@b.org\r\nSubject: =?undefined?Q?x?=\r\nContent-Type: text/plain; charset=idna\r\n\r\n\xff\xfe"
    files["mixed.eml"] = b"From: a@b.org\r\nReceived: x; 9 Mar 2023 14:20:07\r\nReceived: x; 9 Mar 2023 14:20:07 +0000\r\n\r\n" + SPAM.encode()
    for name, content in files.items():
        with open(f"{where}/{name}", "wb") as f:
            f.write(content)
    return where


def rows(df):
    return sorted((os.path.basename(r.msg_id), *list(r)[1:]) for r in df.collect())


def test_folder_and_stream_agree(spark, saved, folder):
    verdicts, broken = C.score_folder(spark, folder, saved, "Demo", "body_only", "RF")
    batch, bad = rows(verdicts), rows(broken)
    by = {r[0]: r[-1] for r in batch}
    assert len(batch) == 8 and all(by[f"spam{k}.eml"] == "PHISHING" and by[f"ham{k}.eml"] == "LEGITIMATE" for k in range(3))
    assert [(n, c) for n, _, c in bad] == [("broken.eml", 1), ("mixed.eml", 0)] and "Unicode" in bad[0][1] and bad[1][1] == "mixed_naive_aware_dates"
    out = tempfile.mkdtemp(prefix="mailfeat-out-")
    streamed, kept = C.score_folder_stream(spark, folder, saved, "Demo", f"{out}/sink", f"{out}/offsets", "body_only", "RF", files_a_batch=3)
    assert rows(streamed) == batch and rows(kept) == bad
    with open(f"{folder}/late.eml", "wb") as f:
        f.write(message(SPAM, 1))
    streamed, _ = C.score_folder_stream(spark, folder, saved, "Demo", f"{out}/sink", f"{out}/offsets", "body_only", "RF")
    assert len(rows(streamed)) == 9 and dict((r[0], r[-1]) for r in rows(streamed))["late.eml"] == "PHISHING"  # only the new file was read


def test_text_and_bytes_give_one_body(spark, folder):
    files = S.scan_folder(spark, folder).withColumn("dataset", F.lit("Demo"))
    by_bytes = {r.msg_id: (r.body_text.strip(), r.undecoded_parts, r.body_error) for r in S.parse_raw(files, keep=("dataset",)).collect()}
    by_text = {r.msg_id: (r.body_text.strip(), r.undecoded_parts, r.body_error) for r in S.parse_text(files.select(F.col("path").alias("msg_id"), "dataset", "raw")).collect()}
    assert by_text == by_bytes and any(v[0] == SPAM for k, v in by_text.items() if k.endswith("spam1.eml"))

"""Driver tables and the derived `messages` view.

The test tables hold prose, labels and web pages but no e-mail, so a raw
message per document is derived deterministically: one of 16 literal header
templates (chosen by doc_id % 16, `{id}` replaced by the doc_id) + a blank
line + the document text.  Spark parses that raw text; the SQL oracle reads
the template columns directly, so the two paths are independent.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give CPU-heavy per-row text work at least one partition per core.

    Large inputs already arrive in many file splits and are left alone (no
    shuffle); a small table stored as a single row group would otherwise run
    its whole text pipeline in one task.  Hash partitioning on the key keeps
    the split deterministic, so a retried task sees the same rows.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, key)


def text_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A text-bearing table, spread over the cores (see `spread`)."""
    return spread(table(spark, sf_dir, name), key)


# Header template columns: None = header absent, '' = present and empty.
TEMPLATE_COLUMNS = [
    "t", "from_h", "to_h", "cc_h", "bcc_h", "subject_h", "subject_dec", "reply_to_h",
    "return_path_h", "message_id_h", "spf_h", "auth_h", "x_mailer_h", "cte_h",
    "recv_n", "recv_span_s", "mixed",
]

# Header names as written in the raw text (template 8 uses odd casing).
_NAMES = {
    "from_h": "From", "to_h": "To", "cc_h": "Cc", "bcc_h": "Bcc", "subject_h": "Subject",
    "reply_to_h": "Reply-To", "return_path_h": "Return-Path", "message_id_h": "Message-ID",
    "spf_h": "Received-SPF", "auth_h": "Authentication-Results", "x_mailer_h": "X-Mailer",
    "cte_h": "Content-Transfer-Encoding",
}
_ODD_CASE = {"from_h": "FROM", "to_h": "to", "subject_h": "SUBJECT", "message_id_h": "message-id",
             "reply_to_h": "reply-TO"}

TEMPLATES = [
    dict(t=0, from_h='"Accounts" <accounts.security{id}+q@paypa1.com>', to_h="", bcc_h="someone@example.net",
         subject_h="=?utf-8?Q?Is_this_you=3F?=", subject_dec="Is this you?",
         message_id_h="<{id}$4@relay.cheap-host.tk>", reply_to_h="desk@relay.cheap-host.tk",
         spf_h="softfail", return_path_h="<bounce@odd-sender.top>", recv_n=4, recv_span_s=450),
    dict(t=1, from_h="Ana Cruz <ana.cruz@example.org>", to_h="team@example.org, lead@example.org",
         message_id_h="<{id}.1@example.org>", subject_h="Meeting notes", reply_to_h="ana.cruz@example.org",
         spf_h="pass", auth_h="mx; dkim=pass", x_mailer_h="Mutt", cte_h="7bit",
         return_path_h="<ana.cruz@example.org>", recv_n=1, recv_span_s=0),
    dict(t=2, from_h="service@paypal.com", subject_h="Your receipt {id}", message_id_h="<{id}@paypal.com>",
         spf_h="none", auth_h="mx.example.net; spf=pass", return_path_h="<>", x_mailer_h="   ",
         recv_n=0, recv_span_s=0),
    dict(t=3, from_h="Win! <winner{id}@prize-draw.tk>", to_h="undisclosed-recipients:;",
         subject_h="You won?", message_id_h="abc{id}@prize-draw.tk", reply_to_h="",
         spf_h="fail (sender not authorized)", auth_h="mx; dkim=fail", return_path_h="<bounce>",
         cte_h="", recv_n=3, recv_span_s=10),
    dict(t=4, from_h="Bank <alerts@bdo.com.ph>", to_h="<>", subject_h="Statement",
         message_id_h="<{id}.x@notices.bdo.com.ph>", reply_to_h="Desk? <desk@bdo.com.ph>",
         spf_h="softfail", auth_h="mx; dkim = none", x_mailer_h="Outlook", cte_h="8bit",
         return_path_h="<alerts@bdo.com.ph>", recv_n=2, recv_span_s=11),
    dict(t=5, from_h="=?utf-8?Q?Caf=C3=A9_Team?= <newsletter@cafe.example.com>", to_h="a@x.com, b@y.com",
         cc_h="c@z.com", subject_h="Weekly news", message_id_h="<n{id}@cafe.example.com>",
         spf_h="pass", auth_h="mx; dkim=pass", x_mailer_h="Mailer 2", cte_h="binary",
         return_path_h="<newsletter@cafe.example.com>", recv_n=4, recv_span_s=0),
    dict(t=6, from_h="x{id}verylongusernamethatkeepsgoingandgoing.more@mail.amazon.com",
         to_h="me@example.com", subject_h="Order {id} shipped", message_id_h="<{id}@mail.amazon.com>",
         spf_h="pass", auth_h="mx; dkim=pass", return_path_h="<x{id}@mail.amazon.com>",
         recv_n=3, recv_span_s=11),
    dict(t=7, from_h="support@arnazon.com", to_h="me@example.com", subject_h="Account locked",
         message_id_h="<{id}@arnazon.com>", reply_to_h="help@arnazon.tk", spf_h="softfail",
         return_path_h="<support@arnazon.com>", recv_n=2, recv_span_s=300,
         dates=["Thu, 9 March 2023 14:20:07 CEST", "Thu, 9 March 2023 14:25:07"]),
    dict(t=8, from_h="john.doe{id}@gmail.com", to_h="friend@example.com", subject_h="Lunch?",
         message_id_h="<{id}@mail.gmail.com>", reply_to_h="john.doe{id}@gmail.com", spf_h="pass",
         auth_h="mx; dkim=pass", x_mailer_h="", return_path_h="<john.doe{id}@gmail.com>",
         recv_n=2, recv_span_s=5),
    dict(t=9, from_h="Reports <reports@corp.example.com>", to_h="first@example.com,\r\n second@example.com",
         subject_h="Quarterly\r\n report", message_id_h="<{id}@corp.example.com>", spf_h="pass",
         auth_h="mx;\r\n dkim=pass", x_mailer_h="Exchange", cte_h="8bit",
         return_path_h="<reports@corp.example.com>", recv_n=3, recv_span_s=600),
    dict(t=10, from_h="deals@shop.example.com", to_h="me@example.com", subject_h="Café offer",
         message_id_h="<{id}@shop.example.com>", spf_h="pass", recv_n=1, recv_span_s=0),
    dict(t=11, from_h='"Hi!" <promo{id}@deals.click>', to_h="me@example.com", subject_h="Hello=world",
         message_id_h="<{id}@deals.click>", reply_to_h="Promo <promo@other-deals.top>", spf_h="none",
         return_path_h="<promo{id}@deals.click>", recv_n=4, recv_span_s=40),
    dict(t=12, from_h="noreply@accounts.google.com", to_h="me@example.com", subject_h="Security alert",
         message_id_h="<{id}@mail.google.com>", auth_h="mx; dkim=neutral", spf_h="pass",
         return_path_h="<noreply@accounts.google.com>", x_mailer_h="GMail", cte_h="7bit",
         recv_n=3, recv_span_s=2),
    dict(t=13, from_h="no-reply@secure-login.ml", to_h="me@example.com", subject_h="Verify now",
         message_id_h="<{id}$@secure-login.ml>", spf_h="softfail", return_path_h="bounces+{id}@mailer.ml",
         recv_n=0, recv_span_s=0),
    dict(t=14, from_h="Team <team@linkedin.com>", to_h="u{id}@example.com", cc_h="a@b.com", bcc_h="c@d.com",
         subject_h="New connection", message_id_h="<{id}@linkedin.com>", spf_h="pass",
         auth_h="mx; dkim=pass", x_mailer_h="LI", cte_h="7bit", return_path_h="<team@linkedin.com>",
         recv_n=2, recv_span_s=0),
    dict(t=15, to_h="me@example.com", message_id_h="<{id}@other.org>", spf_h="neutral",
         return_path_h="<>\t", recv_n=2, recv_span_s=0, mixed=1,
         dates=["Thu, 9 Mar 2023 14:20:07", "Thu, 9 Mar 2023 14:20:07 +0000"]),
]


def _template_row(d: dict) -> dict:
    row = {c: d.get(c) for c in TEMPLATE_COLUMNS}
    row["subject_dec"] = d.get("subject_dec", d.get("subject_h"))
    return row


def _received_lines(n: int, span: int, dates: list[str] | None = None) -> list[str]:
    """n Received lines with dates spread over `span` seconds, or with the given dates."""
    first = _dt.datetime(2023, 3, 9, 14, 20, 7)
    out = []
    for k in range(n):
        at = first + _dt.timedelta(seconds=(k * span) // (n - 1) if n > 1 else 0)
        date = dates[k] if dates else at.strftime("%a, ") + str(at.day) + at.strftime(" %b %Y %H:%M:%S +0000")
        out.append(f"Received: from relay{k}.example.net by mx{k}.example.org; {date}")
    return out


def header_block(d: dict) -> str:
    """Raw header text of one template (CRLF lines, `{id}` left in place)."""
    lines = []
    odd = d["t"] == 8
    for col, name in _NAMES.items():
        v = d.get(col)
        if v is None:
            continue
        if odd and col in _ODD_CASE:
            name = _ODD_CASE[col]
        lines.append(f"{name}: {v}")
        if col == "subject_h":
            lines += _received_lines(d.get("recv_n", 0), d.get("recv_span_s", 0), d.get("dates"))
    if d.get("subject_h") is None:
        lines += _received_lines(d.get("recv_n", 0), d.get("recv_span_s", 0), d.get("dates"))
    return "\r\n".join(lines) + "\r\n"


def templates_df(spark: SparkSession) -> DataFrame:
    """The 16-row literal template table (t, header_block); broadcast-sized by construction."""
    rows = [(d["t"], header_block(d)) for d in TEMPLATES]
    return spark.createDataFrame(rows, "t INT, header_block STRING")


def messages(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """Derived message table: msg_id, dataset, label, raw.

    `labelled=True` inner-joins labels (label = toxic); otherwise label is null
    for unlabelled documents.
    """
    docs = text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    if labelled:
        lab = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
        docs = docs.join(lab, "doc_id", "inner")
    else:
        lab = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
        docs = docs.join(lab, "doc_id", "left")
    return build_raw(spark, docs)


def build_raw(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, text, label) -> (msg_id, dataset, label, raw); works on streams too."""
    tpl = F.broadcast(templates_df(spark))  # 16 rows: fixed size
    m = docs.withColumn("t", (F.col("doc_id") % 16).cast("int")).join(tpl, "t")
    raw = F.concat(
        F.replace(F.col("header_block"), F.lit("{id}"), F.col("doc_id").cast("string")),
        F.lit("\r\n"),
        F.coalesce(F.col("text"), F.lit("")),
    )
    return m.select(
        F.col("doc_id").alias("msg_id"),
        F.concat(F.lit("d"), (F.col("doc_id") % 3).cast("string")).alias("dataset"),
        F.col("label").cast("int").alias("label"),
        raw.alias("raw"),
    )


def _bodies(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    docs = text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return docs.join(lab, "doc_id", how).select(
        F.col("doc_id").alias("msg_id"),
        F.concat(F.lit("d"), (F.col("doc_id") % 3).cast("string")).alias("dataset"),
        F.col("toxic").cast("int").alias("label"),
        F.coalesce(F.col("text"), F.lit("")).alias("body_text"),
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents ⋈ labels as (msg_id, dataset, label, body_text) — the body-only corpus."""
    return _bodies(spark, sf_dir, "inner")


def all_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as (msg_id, dataset, label, body_text); label is null where there is none."""
    return _bodies(spark, sf_dir, "left")

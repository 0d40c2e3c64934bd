"""Header parsing (S6), the 33 header features (F1-F33) and the bad-record
policy (S7, §2.4) as DataFrame programs.

Every feature except the decoded-subject flag and the six similarity scores is
a JVM expression over header values pulled out of the parsed header array; those
seven use Arrow-batched UDFs (functions.similarity), which a plan that doesn't
select them leaves out.
All of it is narrow: no shuffle between the raw message and its feature row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions.constants import ALL_HEADER_FEATURES, SIMILARITY_FEATURES
from ..functions.similarity import similarity_scores, subject_symbol
from ..functions.text import let, replace_closed

# header name (lower case) -> column holding its first value
HEADER_COLS = {
    "from": "h_from", "to": "h_to", "cc": "h_cc", "bcc": "h_bcc", "subject": "h_subject",
    "reply-to": "h_reply_to", "return-path": "h_return_path", "message-id": "h_message_id",
    "received-spf": "h_spf", "authentication-results": "h_auth", "x-mailer": "h_x_mailer",
    "content-transfer-encoding": "h_cte",
}
# headers whose raw non-ASCII value makes the reference drop the message
_USED = list(HEADER_COLS)

# FIXED VALUES: RFC 2822 obsolete zone names and their offsets in seconds
_ZONES = {"UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "EST": -18000, "EDT": -14400, "CST": -21600, "CDT": -18000,
          "MST": -25200, "MDT": -21600, "PST": -28800, "PDT": -25200, "AST": -14400, "ADT": -10800}
_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
           "november", "december"]
# A header block is `name:` lines and folds; the first other line ends it.
_BLOCK = "^(?:From [^\\n]*+\\n)?((?:(?:[!-9;-~]*+:|[ \\t])[^\\n]*+(?:\\n|$))*+)"


def split_message(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Header block -> headers array<struct<name,value>> (+ body_text).

    Folded lines stay inside their value (CRLF + blank kept, as the stdlib
    parser keeps them); an mbox 'From ' first line is skipped.  The block ends
    at the first line that is neither a header nor a fold; a blank one there
    is dropped, any other begins the body.
    """
    raw = F.col(raw_col)
    df = df.withColumn("_hdr", F.regexp_extract(raw, _BLOCK, 1))
    df = df.withColumn("body_text", F.regexp_replace(raw, _BLOCK + "(?:\\r?\\n)?", ""))
    lines = F.filter(F.split(F.regexp_replace("_hdr", "\\r?\\n$", ""), "\\r?\\n(?![ \\t])"), lambda x: x.rlike("^[!-9;-~]+:"))
    headers = F.transform(lines, lambda l: F.struct(
        F.lower(F.regexp_extract(l, "^([^:]*):", 1)).alias("name"),
        F.regexp_extract(l, "(?s)^[^:]*:[ \\t]*(.*)$", 1).alias("value")))
    return df.withColumn("headers", headers).drop("_hdr")


def header_value(headers: Column, name: str) -> Column:
    """First value of a header (case-insensitive); null when absent."""
    return F.get(F.filter(headers, lambda h: h["name"] == name), 0)["value"]


def header_values(headers: Column, name: str) -> Column:
    return F.transform(F.filter(headers, lambda h: h["name"] == name), lambda h: h["value"])


def with_header_values(df: DataFrame) -> DataFrame:
    """Materialise the header values the features read (one projection)."""
    h = F.col("headers")
    cols = [header_value(h, n).alias(c) for n, c in HEADER_COLS.items()]
    return df.select("*", *cols, header_values(h, "received").alias("h_received"))


def with_received_times(df: DataFrame) -> DataFrame:
    """`_times`: the dates of the Received headers that have one."""
    return df.withColumn("_times", F.filter(F.transform("h_received", received_time), lambda t: t.isNotNull()))


_DATE = (r"^(?:[A-Za-z]+,?\s+)?(\d{1,2})\s+([A-Za-z]+)\.?,?\s+(\d{2}|\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?"
         r"\s*([+-]\d{4}|[A-Za-z]*)\s*$")


def received_time(v: Column) -> Column:
    """struct<at: seconds, naive: boolean> of a Received value's date, null if it has none.

    The zone may be missing, unknown or -0000: such a date is naive.  Months
    may be written in full; two-digit years above 68 lie in the last century.
    """
    date = F.trim(replace_closed(F.regexp_extract(v, "(?m);\\s*(.+)$", 1), "\\([^)]*\\)", ")", " "))
    fields = let(date, lambda d: F.struct(*[F.regexp_extract(d, _DATE, i).alias(f"p{i}") for i in range(1, 8)]))
    return let(let(fields, _moment), lambda t: F.when(t["at"].isNotNull(), F.struct((t["at"] - F.coalesce(t["offset"], F.lit(0))).alias("at"), t["offset"].isNull().alias("naive"))))


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _moment(p: Column) -> Column:
    """struct<at: seconds in the date's own zone, offset: seconds, null if naive> of a date's fields."""
    number = lambda i: F.nullif(p[f"p{i}"], F.lit("")).cast("int")
    month = _lookup({name: i for i, full in enumerate(_MONTHS, 1) for name in (full, full[:3])}, F.lower(p["p2"]))
    year = F.when(F.length(p["p3"]) > 2, number(3)).otherwise(number(3) + F.when(number(3) > 68, 1900).otherwise(2000))
    at = F.unix_seconds(F.try_make_timestamp(year, month, number(1), number(4), number(5), F.coalesce(number(6), F.lit(0)).cast("decimal(16,6)"), F.lit("UTC")))
    zone = F.upper(p["p7"])
    digits = F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 4, 2).try_cast("int") * 60
    numeric = F.when(zone == "-0000", F.lit(None)).when(zone.startswith("+"), digits).when(zone.startswith("-"), -digits)
    return F.struct(at.alias("at"), F.coalesce(_lookup(_ZONES, zone), numeric).alias("offset"))


def extract_error(df: DataFrame) -> Column:
    """Why the reference would drop the row (null = kept)."""
    rec = F.col("h_received")
    non_ascii = F.exists(F.col("headers"), lambda h: (
        h["name"].isin(_USED) | ((h["name"] == "received") & (F.size(rec) >= 2)))
        & h["value"].rlike("[^\\x00-\\x7F]"))
    n_naive = F.size(F.filter("_times", lambda t: t["naive"]))
    mixed = (F.size(rec) >= 2) & (n_naive > 0) & (n_naive < F.size("_times"))
    return (F.when(non_ascii, F.lit("non_ascii_header"))
            .when(mixed, F.lit("mixed_naive_aware_dates")))


def base_features(df: DataFrame) -> dict:
    """F1-F17 except F7 (Subject_symbol needs the MIME decode)."""
    c = F.col
    to, frm = c("h_to"), F.coalesce(c("h_from"), F.lit(""))
    to_empty = (F.coalesce(to, F.lit("")) == "") | F.lower(to).contains("undisclosed") | to.contains("<>")
    n_rcpt = F.size(A.addresses(to)) + F.size(A.addresses(c("h_cc"))) + F.size(A.addresses(c("h_bcc")))
    rec = c("h_received")
    times = F.transform("_times", lambda t: t["at"])
    span = F.array_max(times) - F.array_min(times)
    display = replace_closed(frm, "<[^>]+>", ">", "")
    spf = F.lower(F.coalesce(c("h_spf"), F.lit("")))
    auth = F.lower(F.coalesce(c("h_auth"), F.lit("")))
    dkim = F.regexp_extract(auth, "(?U)dkim\\s*=\\s*(\\w+)", 1)
    fd = A.domain(frm)
    mid_d = A.message_id_domain(c("h_message_id"))
    rt = c("h_reply_to")
    rd = A.domain(rt)
    rp = F.lower(F.coalesce(c("h_return_path"), F.lit("")))
    rpd = A.domain(c("h_return_path"))

    def differ(a, b):
        return (a != "") & (b != "") & (a != b)

    return {
        "To_empty": A.flag(to_empty),
        "BCC_notempty_To_empty": A.flag((F.size(A.addresses(c("h_bcc"))) > 0) & to_empty),
        "Total_Recp": A.flag(n_rcpt >= 2),
        "Received_count": A.flag(F.size(rec) > 3),
        "Span_time": A.flag((F.size(rec) >= 2) & (F.size(times) >= 2) & (span > 10)),
        "From_symbol": A.flag(display.rlike("[?!<>]")),
        "Received_SPF": A.flag(spf.contains("fail") | spf.contains("bad") | spf.contains("none")),
        "Authentication_Results": F.when(auth == "", F.lit(1.0)).otherwise(
            A.flag(dkim.isin("fail", "softfail", "bad", "none", "neutral"))),
        "MessageID_domainname": A.flag(differ(fd, mid_d)),
        "MessageID_dollar": A.flag(F.coalesce(c("h_message_id"), F.lit("")).contains("$")),
        "Reply_To_empty_symbol": F.when(rt.isNull(), F.lit(1.0)).otherwise(A.flag(rt.contains("?"))),
        "Reply_To_domain": A.flag(differ(fd, rd)),
        "X_Mailer_exist": F.when(c("h_x_mailer").isNull(), F.lit(1.0)).otherwise(A.flag(A.is_blank(c("h_x_mailer")))),
        "Content_Transfer_Encoding": F.when(c("h_cte").isNull(), F.lit(1.0)).otherwise(A.flag(A.is_blank(c("h_cte")))),
        "Return_Path_empty": A.flag(A.strip_blanks(rp).isin("<>", "", "<bounce>") | rp.contains("bounce")),
        "Return_Path_From_domain": A.flag(differ(fd, rpd)),
    }


def extended_features(df: DataFrame) -> dict:
    """F18-F33 except the six similarity scores."""
    c = F.col
    fu = A.username_block(c("h_from"))
    fdb = A.domain_block(c("h_from"))
    ru = A.username_block(c("h_reply_to"))
    rdb = A.domain_block(c("h_reply_to"))
    pu = A.username_block(c("h_return_path"))
    pdb = A.domain_block(c("h_return_path"))
    return {
        "from_username_length": fu["length"],
        "from_username_digit_ratio": fu["digit_ratio"],
        "from_username_special_ratio": fu["special_ratio"],
        "from_username_suspicious_keyword": fu["suspicious_keyword"],
        "from_domain_subdomain_depth": fdb["subdomain_depth"],
        "from_tld_suspicious": fdb["tld_suspicious"],
        "replyto_username_length": ru["length"],
        "replyto_tld_suspicious": rdb["tld_suspicious"],
        "returnpath_username_length": pu["length"],
        "returnpath_tld_suspicious": pdb["tld_suspicious"],
    }


def header_features(parsed: DataFrame, keep=("msg_id", "dataset", "label", "body_text"),
                    on_error: str = "drop") -> DataFrame:
    """Parsed messages -> feature rows: keep cols, 33 features (config order), extract_error.

    on_error="zero" (S5) gives a message that can't be read 33 zeros and no
    error; with "drop" the error is named and `feature_table` leaves it out.
    """
    c = F.col
    df = with_received_times(with_header_values(parsed))
    feats = {**base_features(df), **extended_features(df), "Subject_symbol": subject_symbol(c("h_subject"))}
    sim = similarity_scores(A.domain(c("h_from")), A.domain(c("h_reply_to")), A.domain(c("h_return_path")),
                            A.message_id_domain(c("h_message_id")))
    out = df.select(*keep, *[v.alias(k) for k, v in feats.items()], extract_error(df).alias("extract_error"), sim.alias("_sim"))
    value = {k: F.col("_sim")[k] if k in SIMILARITY_FEATURES else F.col(k) for k in ALL_HEADER_FEATURES}
    if on_error == "zero":
        bad = F.col("extract_error").isNotNull()
        return out.select(*keep, *[F.when(bad, F.lit(0.0)).otherwise(v).alias(k) for k, v in value.items()],
                          F.lit(None).cast("string").alias("extract_error"))
    return out.select(*keep, *[v.alias(k) for k, v in value.items()], "extract_error")


def feature_table(features: DataFrame) -> DataFrame:
    """Kept rows, features coerced to non-null doubles, fixed order."""
    ok = features.where(F.col("extract_error").isNull())
    feats = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in ALL_HEADER_FEATURES]
    return ok.select("msg_id", "dataset", "label", F.coalesce("body_text", F.lit("")).alias("body_text"), *feats)

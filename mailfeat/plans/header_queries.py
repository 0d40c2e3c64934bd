"""Driver queries for header parsing and header features (S6, S7, S10-S15, A, F)."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions.constants import (ALL_HEADER_FEATURES, KNOWN_LEGIT_DOMAINS, SIMILARITY_FEATURES, SUSPICIOUS_TLDS,
                                   SUSPICIOUS_USERNAME_KEYWORDS, TYPOSQUAT_EXACT, TYPOSQUAT_NEAR)
from ..functions.similarity import similarity_scores
from ..operators import headers as H
from ..sources.raw import parse_text
from ..sources.tables import TEMPLATE_COLUMNS, TEMPLATES, messages
from .sqltext import q

USERNAME = [f for f in ALL_HEADER_FEATURES if f.startswith("from_username_")]
DOMAIN = ["from_domain_subdomain_depth", "from_tld_suspicious", "from_domain_typosquat_score"]
BASE17 = ALL_HEADER_FEATURES[:17]
EXT_NOSIM = [f for f in ALL_HEADER_FEATURES[17:] if f not in SIMILARITY_FEATURES]


def parsed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_text(messages(spark, sf_dir, labelled=False))


def all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.header_features(parsed_messages(spark, sf_dir))


def q_header_lookup(spark, sf):
    df = H.with_header_values(parsed_messages(spark, sf))
    return df.select("msg_id", *H.HEADER_COLS.values(), F.size("h_received").alias("n_received"))


def q_address_parts(spark, sf):
    df = H.with_header_values(parsed_messages(spark, sf))
    c = F.col
    return df.select(
        "msg_id",
        A.domain(c("h_from")).alias("from_domain"), A.username(c("h_from")).alias("from_username"),
        A.tld(A.domain(c("h_from"))).alias("from_tld"),
        A.domain(c("h_reply_to")).alias("replyto_domain"), A.domain(c("h_return_path")).alias("returnpath_domain"),
        A.message_id_domain(c("h_message_id")).alias("msgid_domain"))


def q_address_list(spark, sf):
    df = H.with_header_values(parsed_messages(spark, sf))
    c = F.col
    return df.select(
        "msg_id",
        F.array_join(A.addresses(c("h_to")), ",").alias("to_addrs"),
        F.size(A.addresses(c("h_to"))).alias("n_to"), F.size(A.addresses(c("h_cc"))).alias("n_cc"),
        F.size(A.addresses(c("h_bcc"))).alias("n_bcc"))


def _kept(spark, sf):
    return all_features(spark, sf).where(F.col("extract_error").isNull())


def q_header_base17(spark, sf):
    return _kept(spark, sf).select("msg_id", *BASE17)


def q_header_extended_nosim(spark, sf):
    return _kept(spark, sf).select("msg_id", *EXT_NOSIM)


def q_header_similarity(spark, sf):
    return _kept(spark, sf).select("msg_id", *SIMILARITY_FEATURES)


def q_extract_errors(spark, sf):
    return all_features(spark, sf).where(F.col("extract_error").isNotNull()).select("msg_id", "extract_error")


def q_feature_table(spark, sf):
    ft = H.feature_table(all_features(spark, sf))
    return ft.select("msg_id", "dataset", "label", F.length("body_text").alias("body_len"), *ALL_HEADER_FEATURES)


def q_class_counts(spark, sf):
    ft = _kept(spark, sf).where(F.col("label").isNotNull())
    g = ft.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"),
                                  F.sum("label").cast("long").alias("n_pos"))
    return g.select("dataset", "n", "n_pos", (F.col("n") - F.col("n_pos")).alias("n_neg"),
                    F.round(F.col("n_pos") * 100.0 / F.col("n"), 2).alias("pct_pos"))


def q_dataset_selection(spark, sf, names=("d0", "d2")):
    ft = _kept(spark, sf).where(F.col("dataset").isin(list(names)))
    return ft.select("msg_id", "dataset", "label")


def q_username_block(spark, sf):
    df = H.with_header_values(parsed_messages(spark, sf))
    block = A.username_block(F.col("h_from"))
    return df.select("msg_id", *[block[f.removeprefix("from_username_")].alias(f) for f in USERNAME])


def q_domain_block(spark, sf):
    df = H.with_header_values(parsed_messages(spark, sf))
    d = A.domain(F.col("h_from"))
    block = A.domain_block(F.col("h_from"))
    score = similarity_scores(d, F.lit(""), F.lit(""), F.lit(""))["from_domain_typosquat_score"]
    return df.select("msg_id", block["subdomain_depth"].alias(DOMAIN[0]), block["tld_suspicious"].alias(DOMAIN[1]), score.alias(DOMAIN[2]))


QUERIES = {
    "username_block": q_username_block,
    "domain_block": q_domain_block,
    "header_lookup": q_header_lookup,
    "address_parts": q_address_parts,
    "address_list": q_address_list,
    "header_base17": q_header_base17,
    "header_extended_nosim": q_header_extended_nosim,
    "header_similarity": q_header_similarity,
    "extract_errors": q_extract_errors,
    "feature_table": q_feature_table,
    "class_counts": q_class_counts,
    "dataset_selection": q_dataset_selection,
}

# --------------------------------------------------------------------------
# Oracle: features straight from the template columns (no parsing)
# --------------------------------------------------------------------------


def _lit(v):
    if v is None:
        return "NULL"
    if isinstance(v, int):
        return str(v)
    return " || chr(13) || chr(10) || ".join(" || chr(9) || ".join(q(x) for x in p.split("\t")) for p in v.split("\r\n"))


def _template_scores(d: dict) -> dict[str, float]:
    """The six similarity scores of a template by the standard library alone (no domain holds the id)."""
    def dom(value, pattern):
        m = re.search(pattern, value or "")
        return m[1].lower() if m else ""

    def like(a, b):
        return difflib.SequenceMatcher(None, a, b).ratio()

    frm, reply, bounce = (dom(d.get(c), r"@([\w.\-]+)") for c in ("from_h", "reply_to_h", "return_path_h"))
    mid = dom(d.get("message_id_h"), r"@([\w.\-]+)>")
    typo = []
    for x in (frm, reply, bounce):
        best = max(like(x, k) for k in KNOWN_LEGIT_DOMAINS) if x else 0.0
        typo.append(round(1 - best, 4) if TYPOSQUAT_NEAR <= best < TYPOSQUAT_EXACT else 0.0)
    away = [round(1 - like(frm, x), 4) if frm and x else 0.0 for x in (reply, bounce, mid)]
    return dict(zip(SIMILARITY_FEATURES, typo + away))


_STR = [c for c in TEMPLATE_COLUMNS if c not in ("t", "recv_n", "recv_span_s", "mixed")]
_rows = []
for d in TEMPLATES:
    r = {c: d.get(c) for c in TEMPLATE_COLUMNS}
    r["subject_dec"] = d.get("subject_dec", d.get("subject_h"))
    r["recv_n"] = d.get("recv_n", 0)
    r["recv_span_s"] = d.get("recv_span_s", 0)
    r["mixed"] = d.get("mixed", 0)
    scores = [f"CAST({v} AS DOUBLE)" for v in _template_scores(d).values()]
    _rows.append("(" + ", ".join([*(_lit(r[c]) for c in TEMPLATE_COLUMNS), *scores]) + ")")
_TPL = f"tpl({', '.join([*TEMPLATE_COLUMNS, *SIMILARITY_FEATURES])}) AS (VALUES {', '.join(_rows)})"
_SUBS = ", ".join(f"replace(CAST(tpl.{c} AS VARCHAR), '{{id}}', CAST(d.doc_id AS VARCHAR)) AS {c}" for c in _STR)
ADDR = "[\\w.+\\-]+@[\\w.\\-]+"
_USED = [c for c in _STR if c != "subject_dec"]
MSGS = f"""{_TPL},
m0 AS (SELECT d.doc_id AS msg_id, 'd' || CAST(d.doc_id % 3 AS VARCHAR) AS dataset, CAST(l.toxic AS INTEGER) AS label,
              coalesce(d.text, '') AS body_text, tpl.recv_n, tpl.recv_span_s, tpl.mixed, {', '.join('tpl.' + f for f in SIMILARITY_FEATURES)}, {_SUBS}
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id JOIN tpl ON tpl.t = d.doc_id % 16),
msgs AS (SELECT *, {' OR '.join(f"coalesce(regexp_matches({c}, '[^\\x00-\\x7F]'), false)" for c in _USED)} AS non_ascii, non_ascii OR mixed = 1 AS bad,
   lower(trim(regexp_extract(coalesce(from_h, ''), '@([\\w.\\-]+)', 1))) AS fd,
   lower(trim(regexp_extract(coalesce(reply_to_h, ''), '@([\\w.\\-]+)', 1))) AS rd,
   lower(trim(regexp_extract(coalesce(return_path_h, ''), '@([\\w.\\-]+)', 1))) AS pd,
   lower(regexp_extract(coalesce(message_id_h, ''), '@([\\w.\\-]+)>', 1)) AS md,
   lower(regexp_extract(coalesce(from_h, ''), '([\\w.+\\-]+)@', 1)) AS fu,
   lower(regexp_extract(coalesce(reply_to_h, ''), '([\\w.+\\-]+)@', 1)) AS ru,
   lower(regexp_extract(coalesce(return_path_h, ''), '([\\w.+\\-]+)@', 1)) AS pu,
   coalesce(to_h, '') = '' OR contains(lower(to_h), 'undisclosed') OR contains(to_h, '<>') AS to_empty,
   lower(coalesce(auth_h, '')) AS auth, lower(coalesce(spf_h, '')) AS spf, lower(coalesce(return_path_h, '')) AS rp
   FROM m0)"""


def _f(cond):
    return f"CAST(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END AS DOUBLE)"


def _n(x):
    return f"len(regexp_extract_all(coalesce({x}, ''), '{ADDR}'))"


def _blank(x):
    return f"regexp_matches({x}, '^[ \\t\\n\\r\\x0B\\x0C\\x1C-\\x1F]*$')"


def _diff(a, b):
    return f"{a} <> '' AND {b} <> '' AND {a} <> {b}"


def _ulen(u):
    return f"CAST(CASE WHEN {u} = '' THEN 0.0 ELSE least(CAST(length({u}) AS DOUBLE) / 40, 1.0) END AS DOUBLE)"


def _tld_susp(d):
    tlds = ", ".join(q(t) for t in SUSPICIOUS_TLDS)
    return _f(f"{d} <> '' AND (CASE WHEN contains({d}, '.') THEN lower(split_part({d}, '.', -1)) ELSE '' END) IN ({tlds})")


_KW = "[" + ", ".join(q(k) for k in SUSPICIOUS_USERNAME_KEYWORDS) + "]"
FEATS_SQL = {
    "To_empty": _f("to_empty"),
    "BCC_notempty_To_empty": _f(f"{_n('bcc_h')} > 0 AND to_empty"),
    "Total_Recp": _f(f"{_n('to_h')} + {_n('cc_h')} + {_n('bcc_h')} >= 2"),
    "Received_count": _f("recv_n > 3"),
    "Span_time": _f("recv_n >= 2 AND recv_span_s > 10"),
    "From_symbol": _f("regexp_matches(regexp_replace(coalesce(from_h, ''), '<[^>]+>', '', 'g'), '[?!<>]')"),
    "Subject_symbol": _f("regexp_matches(coalesce(subject_dec, ''), '[?=]')"),
    "Received_SPF": _f("contains(spf, 'fail') OR contains(spf, 'bad') OR contains(spf, 'none')"),
    "Authentication_Results": _f("auth = '' OR regexp_extract(auth, 'dkim\\s*=\\s*(\\w+)', 1) IN ('fail', 'softfail', 'bad', 'none', 'neutral')"),
    "MessageID_domainname": _f(_diff("fd", "md")),
    "MessageID_dollar": _f("contains(coalesce(message_id_h, ''), '$')"),
    "Reply_To_empty_symbol": _f("reply_to_h IS NULL OR contains(reply_to_h, '?')"),
    "Reply_To_domain": _f(_diff("fd", "rd")),
    "X_Mailer_exist": _f(f"x_mailer_h IS NULL OR {_blank('x_mailer_h')}"),
    "Content_Transfer_Encoding": _f(f"cte_h IS NULL OR {_blank('cte_h')}"),
    "Return_Path_empty": _f("regexp_replace(rp, '^[ \\t\\n\\r\\x0B\\x0C\\x1C-\\x1F]+|[ \\t\\n\\r\\x0B\\x0C\\x1C-\\x1F]+$', '', 'g') IN ('<>', '', '<bounce>') OR contains(rp, 'bounce')"),
    "Return_Path_From_domain": _f(_diff("fd", "pd")),
    "from_username_length": _ulen("fu"),
    "from_username_digit_ratio": "CAST(CASE WHEN fu = '' THEN 0.0 ELSE length(regexp_replace(fu, '[^0-9]', '', 'g')) / CAST(length(fu) AS DOUBLE) END AS DOUBLE)",
    "from_username_special_ratio": "CAST(CASE WHEN fu = '' THEN 0.0 ELSE (length(fu) - length(replace(fu, '+', ''))) / CAST(length(fu) AS DOUBLE) END AS DOUBLE)",
    "from_username_suspicious_keyword": _f(f"fu <> '' AND len(list_filter({_KW}, lambda k: contains(fu, k))) > 0"),
    "from_domain_subdomain_depth": "CAST(CASE WHEN fd = '' THEN 0.0 ELSE least(greatest(len(string_split(fd, '.')) - 2, 0) / 4.0, 1.0) END AS DOUBLE)",
    "from_tld_suspicious": _tld_susp("fd"),
    "replyto_username_length": _ulen("ru"),
    "replyto_tld_suspicious": _tld_susp("rd"),
    "returnpath_username_length": _ulen("pu"),
    "returnpath_tld_suspicious": _tld_susp("pd"),
    **{f: f for f in SIMILARITY_FEATURES},
}


def _select(cols):
    return ", ".join(f"{FEATS_SQL[c]} AS {c}" for c in cols)


_HCOLS = {"h_from": "from_h", "h_to": "to_h", "h_cc": "cc_h", "h_bcc": "bcc_h", "h_subject": "subject_h",
          "h_reply_to": "reply_to_h", "h_return_path": "return_path_h", "h_message_id": "message_id_h",
          "h_spf": "spf_h", "h_auth": "auth_h", "h_x_mailer": "x_mailer_h", "h_cte": "cte_h"}

ORACLE = {
    "header_lookup": f"WITH {MSGS} SELECT msg_id, "
                     + ", ".join(f"ltrim({v}, ' ' || chr(9)) AS {k}" for k, v in _HCOLS.items())
                     + ", CAST(recv_n AS INTEGER) AS n_received FROM msgs",
    "address_parts": f"""WITH {MSGS} SELECT msg_id, fd AS from_domain, fu AS from_username,
        CASE WHEN contains(fd, '.') THEN lower(split_part(fd, '.', -1)) ELSE '' END AS from_tld,
        rd AS replyto_domain, pd AS returnpath_domain, md AS msgid_domain FROM msgs""",
    "address_list": f"""WITH {MSGS} SELECT msg_id,
        array_to_string(regexp_extract_all(coalesce(to_h, ''), '{ADDR}'), ',') AS to_addrs,
        CAST({_n('to_h')} AS INTEGER) AS n_to, CAST({_n('cc_h')} AS INTEGER) AS n_cc,
        CAST({_n('bcc_h')} AS INTEGER) AS n_bcc FROM msgs""",
    "header_base17": f"WITH {MSGS} SELECT msg_id, {_select(BASE17)} FROM msgs WHERE NOT bad",
    "header_extended_nosim": f"WITH {MSGS} SELECT msg_id, {_select(EXT_NOSIM)} FROM msgs WHERE NOT bad",
    "extract_errors": f"WITH {MSGS} SELECT msg_id, CASE WHEN non_ascii THEN 'non_ascii_header' ELSE 'mixed_naive_aware_dates' END AS extract_error FROM msgs WHERE bad",
    "feature_table": f"""WITH {MSGS} SELECT msg_id, dataset, label, CAST(length(body_text) AS INTEGER) AS body_len,
        {_select(ALL_HEADER_FEATURES)} FROM msgs WHERE NOT bad""",
    "header_similarity": f"WITH {MSGS} SELECT msg_id, {_select(SIMILARITY_FEATURES)} FROM msgs WHERE NOT bad",
    "username_block": f"""WITH {MSGS} SELECT msg_id, {', '.join(f"{FEATS_SQL[f]} AS {f}" for f in USERNAME)} FROM msgs""",
    "domain_block": f"""WITH {MSGS} SELECT msg_id, {', '.join(f"{FEATS_SQL[f]} AS {f}" for f in DOMAIN)} FROM msgs""",
    "class_counts": f"""WITH {MSGS}
SELECT dataset, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos, count(*) - CAST(sum(label) AS BIGINT) AS n_neg,
       round(sum(label) * 100.0 / count(*), 2) AS pct_pos
FROM msgs WHERE NOT bad AND label IS NOT NULL GROUP BY dataset""",
    "dataset_selection": f"WITH {MSGS} SELECT msg_id, dataset, label FROM msgs WHERE NOT bad AND dataset IN ('d0', 'd2')",
}

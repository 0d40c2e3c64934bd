"""Address / domain scalar functions (A1-A4, A8-A10, A13) as Column expressions.

`(?U)` makes Java's \\w Unicode-aware, matching the reference's str regexes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import SUSPICIOUS_TLDS, SUSPICIOUS_USERNAME_KEYWORDS

# A local part begins where its run of characters does, or where the last match ended: linear on runs without an '@'.
_LOCAL = "(?U)(?:\\G|(?<![\\w.+\\-]))"
ADDRESS_RE = _LOCAL + "[\\w.+\\-]++@[\\w.\\-]+"
# Characters str.strip()/str.isspace() treat as blank on ASCII text.
BLANK_RE = "^[ \\t\\n\\r\\x0B\\x0C\\x1C-\\x1F]*$"


def domain(addr: Column) -> Column:
    """A1: first `@([\\w.-]+)`, lower-cased; '' when absent."""
    return F.trim(F.lower(F.regexp_extract(F.coalesce(addr, F.lit("")), "(?U)@([\\w.\\-]+)", 1)))


def username(addr: Column) -> Column:
    """A2: the local part directly before the first '@' (lower-cased)."""
    return F.lower(F.regexp_extract(F.coalesce(addr, F.lit("")), _LOCAL + "([\\w.+\\-]++)@", 1))


def tld(dom: Column) -> Column:
    """A3: last label, '' if the domain has no dot."""
    return F.when(F.instr(dom, ".") > 0, F.lower(F.substring_index(dom, ".", -1))).otherwise(F.lit(""))


def addresses(value: Column) -> Column:
    """A4: every address in a header value."""
    return F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(ADDRESS_RE), 0)


def message_id_domain(mid: Column) -> Column:
    """A10: `@domain>` of a Message-ID (needs the closing bracket)."""
    return F.lower(F.regexp_extract(F.coalesce(mid, F.lit("")), "(?U)@([\\w.\\-]+)>", 1))


def username_block(addr: Column) -> dict:
    """length/40 (cap 1), digit ratio, special ratio, keyword flag; zeros without a username."""
    u = username(addr)
    n = F.length(u).cast("double")
    has = n > 0
    digits = F.length(F.regexp_replace(u, "(?U)[^\\d]", "")).cast("double")
    # within the username class only '+' is neither alphanumeric nor . _ -
    specials = (F.length(u) - F.length(F.replace(u, F.lit("+"), F.lit("")))).cast("double")
    kw = F.exists(F.array(*[F.lit(k) for k in SUSPICIOUS_USERNAME_KEYWORDS]), lambda k: F.contains(u, k))
    z = F.lit(0.0)
    return {
        "length": F.when(has, F.least(n / 40.0, F.lit(1.0))).otherwise(z),
        "digit_ratio": F.when(has, digits / n).otherwise(z),
        "special_ratio": F.when(has, specials / n).otherwise(z),
        "suspicious_keyword": F.when(has & kw, F.lit(1.0)).otherwise(z),
    }


def domain_block(addr: Column) -> dict:
    """A9 without the similarity score: subdomain depth and suspicious TLD."""
    d = domain(addr)
    has = F.length(d) > 0
    depth = F.greatest(F.size(F.split(d, "\\.", -1)) - 2, F.lit(0)).cast("double")
    z = F.lit(0.0)
    return {
        "subdomain_depth": F.when(has, F.least(depth / 4.0, F.lit(1.0))).otherwise(z),
        "tld_suspicious": F.when(has & tld(d).isin(SUSPICIOUS_TLDS), F.lit(1.0)).otherwise(z),
    }


def strip_blanks(x: Column) -> Column:
    """Without the blanks of BLANK_RE at either end."""
    return F.regexp_replace(x, "^[ \\t\\n\\r\\x0B\\x0C\\x1C-\\x1F]+|[ \\t\\n\\r\\x0B\\x0C\\x1C-\\x1F]+$", "")


def is_blank(x: Column) -> Column:
    return x.rlike(BLANK_RE)


def flag(cond: Column) -> Column:
    """Boolean -> 1.0 / 0.0 (null counts as false)."""
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))

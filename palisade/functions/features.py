"""Flow-style features as the stored model expects them: known names, fallbacks by name, and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fragments of unknown feature names and the known feature that stands in; then those that a name begins with.
INSIDE = (("byte", "sbytes"), ("pkt", "spkts"), ("load", "sload"), ("ttl", "sttl"), ("mean", "smean"), ("jit", "sjit"))
PREFIXES = ("ct_", "is_")
# Preferred categories of each categorical feature, those after an error, and what stands without any known category.
PREFERRED = {"proto": ("tcp", "udp", "icmp"), "service": ("http", "https", "-", "dns"), "state": ("FIN", "CON", "REQ", "INT")}
AFTER_ERROR = {"state": ("INT", "FIN", "CON", "REQ")}
DEFAULTS = {"proto": "tcp", "service": "http", "state": "FIN"}


def named(column: str, known: dict[str, str], counted: str) -> str:
    """SQL of a feature: its own, or by its name that of a similar one; ``counted`` stands in for other counts."""
    low = column.lower()
    if column in known:
        return known[column]
    for part, other in INSIDE:
        if part in low:
            return known[other]
    return counted if low.startswith(PREFIXES[0]) else "0D"


def category(column: str, choices: list[str], error: Column | None = None) -> Column:
    """The category of a feature: the first preferred one that the model knows, else its first one; resolved while planning."""

    def pick(preferred: tuple[str, ...]) -> Column:
        return F.lit(next((p for p in preferred if p in choices), choices[0] if choices else DEFAULTS.get(column, "unknown")))

    usual = pick(PREFERRED.get(column, ()))
    return F.when(error, pick(AFTER_ERROR[column])).otherwise(usual) if error is not None and column in AFTER_ERROR else usual


# Features that only need the first model's input, in SQL over the columns of the first projection.
COMPATIBLE = {
    "dur": "dur", "spkts": "spkts", "dpkts": "dpkts", "sbytes": "sbytes", "dbytes": "dbytes", "rate": "(spkts + dpkts) / span", "sttl": "64D", "dttl": "64D", "sload": "sbytes / span", "dload": "dbytes / span",
    "sloss": "0D", "dloss": "0D", "sinpkt": "dur / greatest(spkts, 1D)", "dinpkt": "dur / greatest(dpkts, 1D)", "sjit": "special * 0.1D", "djit": "special * 0.05D + failed * 0.2D", "swin": "255D",
    "stcpb": "1000D + place * 10D", "dtcpb": "2000D + place * 10D", "dwin": "255D", "tcprtt": "0.05D + failed * 0.02D", "synack": "0.02D", "ackdat": "0.03D", "smean": "sbytes / greatest(spkts, 1D)",
    "dmean": "dbytes / greatest(dpkts, 1D)", "trans_depth": "1D + json + password", "response_body_len": "least(text_len, 10000D)", "ct_srv_src": "1D + login + captcha", "ct_state_ttl": "1D",
    "ct_dst_ltm": "1D + login", "ct_src_dport_ltm": "1D", "ct_dst_sport_ltm": "1D", "ct_dst_src_ltm": "1D", "is_ftp_login": "0D", "ct_ftp_cmd": "0D",
    "ct_flw_http_mthd": "if(post <> 0, 2D, if(get <> 0, 1D, 0D))", "ct_src_ltm": "1D + password + token", "ct_srv_dst": "1D + admin", "is_sm_ips_ports": "0D",
}
_READ = {
    "uri_len": "uri_len", "query_len": "query_len", "depth": "path_depth", "special": "special_char_count", "body_len": "body_len", "agent_len": "user_agent_len", "get": "is_get", "post": "is_post",
    "json": "has_json_body", "login": "has_login_keyword", "captcha": "has_captcha_keyword", "admin": "has_admin_keyword", "token": "has_token_keyword", "password": "has_password_keyword", "failed": "resp_is_error",
    "place": "seq_id",
}


def compatible(model_input: DataFrame, columns: tuple[str, ...] = tuple(COMPATIBLE), choices: dict[str, list[str]] | None = None) -> DataFrame:
    """file_id, seq_id, features and categories computed from the first model's input alone; null and unreadable numbers count as 0."""
    number = lambda c, other: F.coalesce(F.col(c).try_cast("double"), F.lit(other)).alias
    rows = model_input.select(
        "file_id", "seq_id", *[number(c, 0.0)(name) for name, c in _READ.items()], number("status_code", 200.0)("status"), F.length(F.coalesce("request_text", F.lit(""))).cast("double").alias("text_len")
    )
    # Weights and bounds of the features as the model was trained with them.
    rows = rows.selectExpr(
        "*", "0.05D + least(query_len, 2000D) / 1000D + least(body_len, 10000D) / 10000D AS dur", "1D + post + depth AS spkts", "1D + if(status > 0, 1D, 0D) AS dpkts",
        "120D + uri_len + body_len + agent_len AS sbytes", "80D + least(text_len, 5000D) * 0.2D AS dbytes",
    ).withColumn("span", F.greatest("dur", F.lit(0.001)))
    made = [F.expr(named(c, COMPATIBLE, "1D + login + password")).alias(c) for c in columns]
    return rows.select("file_id", "seq_id", *made, *[category(c, known, F.col("failed") == 1).alias(c) for c, known in (choices or {}).items()])

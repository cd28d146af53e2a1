"""Text functions of HTTP requests, and the features computed from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import features

# Marks and keywords whose occurrences are counted or noticed.
SPECIAL_MARKS = ("'", '"', "<", ">", ";", "--", "../", "%27", "%3c", "%3e", "%2e%2e", " or ", " and ")
SQL_MARKS = (" or ", "or1=1", "or 1=1", "union", "select", "sleep(", "benchmark(", "--", "../", "%27", "%3c", "%3e", "'")
LOGIN = ("login", "auth", "signin", "session")
CAPTCHA = ("captcha", "verify")
ADMIN = ("admin", "root", "manage", "panel")
ADMIN_AND_SYSTEM = ("admin", "root", "system", "manage", "panel")
TOKEN = ("token", "jwt", "bearer", "authorization")
PASSWORD = ("password", "passwd", "pwd")
BUSINESS_ERRORS = ("errauth", "errcaptcha", "number value: 406")
STATIC_ENDS = ("js", "css", "png", "jpg", "jpeg", "gif", "svg", "ico", "woff", "woff2", "map")

DROP_STATIC = rf"\.({'|'.join(STATIC_ENDS)})\z"


def is_static(uri: Column) -> Column:
    """Whether a request asks for a static file; false for a null uri."""
    return F.coalesce(F.lower(F.split_part(uri, F.lit("?"), F.lit(1))).rlike(DROP_STATIC), F.lit(False))


def occurrences(text: Column, mark: str) -> Column:
    """How often ``mark`` stands in ``text``, without overlaps."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("long")


def counted(text: Column, marks: tuple[str, ...]) -> Column:
    low, total = F.lower(text), F.lit(0).cast("long")
    for mark in marks:
        total = total + occurrences(low, mark)
    return total


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """1 or 0."""
    found = F.lit(False)
    for word in words:
        found = found | F.lower(text).contains(word)
    return found.cast("int")


def path_depth(uri: Column) -> Column:
    return F.size(F.filter(F.split(F.split_part(uri, F.lit("?"), F.lit(1)), "/"), lambda x: x != "")).cast("long")


def query_length(uri: Column) -> Column:
    at = F.instr(uri, "?")
    return F.when(at > 0, F.length(uri) - at).otherwise(0).cast("long")


# Patterns of what is masked, and what stands in its place.
MASKS = (
    (r'(?i)("password"\s*:\s*")[^"]+(")', "$1***$2"),
    (r"(?i)(Authorization:\s*)([^\n]+)", "$1***"),
    (r"(?i)(Cookie:\s*)([^\n]+)", "$1***"),
    (r"(data:image/[^;]+;base64,)[A-Za-z0-9+/=]{100,}", "$1<BASE64_TRUNCATED>"),
)


def masked(text: Column) -> Column:
    """Text without passwords, credentials, cookies and long embedded images."""
    for pattern, other in MASKS:
        text = F.regexp_replace(text, pattern, other)
    return text


def host_name(text: Column) -> Column:
    """A host in lower case.

    Of a text with a scheme it is what stands between "://" and the path, without user info and port, and without
    the brackets of an IPv6 address; the whole text, where no host stands there. Another text stays whole, with a
    path if it has one, but for brackets around it and, behind its only colon, a port.
    """
    raw = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    place = F.regexp_replace(F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^.*@", "")
    named = F.when(place.contains("["), F.regexp_extract(place, r"\[([^\]]*)", 1)).otherwise(F.regexp_extract(place, r"^([^:]*)", 1))
    host = F.coalesce(F.nullif(named, F.lit("")), raw)
    host = F.when(host.rlike(r"(?s)^\[.*\]$"), F.substring(host, 2, F.length(host) - 2)).otherwise(host)
    return F.lower(F.trim(F.regexp_replace(host, r"^([^:]*):\d+$", "$1")))


def query_terms(text: Column, most: int = 14) -> Column:
    """Distinct search terms of a text in order of appearance."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-zA-Z0-9_./:-]{2,})"), 1)), 1, most)


def _text(column: str | Column) -> Column:
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def clean_text(text: Column) -> Column:
    """Text with written-out line ends as blanks, trimmed; null becomes empty."""
    out = _text(text)
    for mark in ("\\r\\n", "\\n", "\\r"):
        out = F.replace(out, F.lit(mark), F.lit(" "))
    return F.regexp_replace(out, r"^\s+|\s+$", "")


EXCERPT = 500  # characters of a response that its excerpt holds, by the format


def excerpt(response: Column) -> Column:
    return F.substring(_text(response), 1, EXCERPT)


def request_text(fields: dict[str, Column]) -> Column:
    """``NAME=value`` lines; null counts as empty."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}="), _text(c)) for k, c in fields.items()])


def response_text(status: Column, response_excerpt: Column) -> Column:
    return request_text({"STATUS_CODE": status, "RESPONSE_EXCERPT": response_excerpt})


def _request_fields() -> dict[str, Column]:
    names = {"METHOD": "method", "URI": "uri", "HOST": "host", "CONTENT_TYPE": "content_type", "STATUS_CODE": "status_code", "REQUEST_BODY": "body", "RESPONSE_EXCERPT": "excerpt"}
    return {k: F.col(c) for k, c in names.items()}


def has_json_body(content_type: Column, body: Column) -> Column:
    return (F.lower(content_type).contains("json") | body.rlike(r"(?s)\A\s*\{.*\}\s*\z")).cast("int")


def model_input(r: DataFrame) -> DataFrame:
    """Features of the first model: lengths, counts and flags of each request, over its whole texts, and its text. Null counts as empty."""
    clean = r.select(
        "file_id", "seq_id", F.upper(_text("method")).alias("method"), _text("uri").alias("uri"), clean_text(F.col("host")).alias("host"), _text("status_code").alias("status_code"),
        clean_text(F.col("content_type")).alias("content_type"), _text("body").alias("body"), _text("user_agent").alias("user_agent"), excerpt(F.col("response")).alias("excerpt"),
    )
    # lower-cased once, so that the counts below share it
    merged = clean.withColumn("merged", F.lower(F.concat_ws(" ", "uri", "host", "body", "excerpt", "user_agent", "content_type")))
    flags = (("has_login_keyword", LOGIN), ("has_captcha_keyword", CAPTCHA), ("has_admin_keyword", ADMIN_AND_SYSTEM), ("has_token_keyword", TOKEN), ("has_password_keyword", PASSWORD))
    return merged.select(
        "file_id", "seq_id", "method", "uri", "host", "status_code",
        F.length("uri").cast("long").alias("uri_len"), query_length(F.col("uri")).alias("query_len"), path_depth(F.col("uri")).alias("path_depth"),
        counted(F.col("merged"), SPECIAL_MARKS).alias("special_char_count"), F.length("body").cast("long").alias("body_len"), F.length("user_agent").cast("long").alias("user_agent_len"),
        (F.col("method") == "GET").cast("int").alias("is_get"), (F.col("method") == "POST").cast("int").alias("is_post"),
        has_json_body(F.col("content_type"), F.col("body")).alias("has_json_body"), *[has_any(F.col("merged"), words).alias(name) for name, words in flags],
        F.coalesce(F.col("status_code").try_cast("int") >= 400, F.lit(False)).cast("int").alias("resp_is_error"), request_text(_request_fields()).alias("request_text"),
    )


# Features of a request with its response, in SQL over the columns of the first projection.
FLOW = {
    "dur": "dur", "spkts": "spkts", "dpkts": "dpkts", "sbytes": "sbytes", "dbytes": "dbytes", "rate": "(spkts + dpkts) / span", "sttl": "64D", "dttl": "64D",
    "sload": "sbytes / span", "dload": "dbytes / span", "sloss": "0D", "dloss": "0D", "sinpkt": "dur / greatest(spkts, 1D)", "dinpkt": "dur / greatest(dpkts, 1D)",
    "sjit": "0.5D * sql + 0.2D * bonus", "djit": "0.8D * failed + 0.3D * sql", "swin": "255D", "stcpb": "1000D + 10 * seq_id",
    "dtcpb": "2000D + if(answered = 1, 10 * seq_id, 0)", "dwin": "255D", "tcprtt": "least(1D, gap + 0.05D * failed)", "synack": "least(1D, gap / 2)",
    "ackdat": "least(1D, gap / 2)", "smean": "sbytes / greatest(spkts, 1D)", "dmean": "dbytes / greatest(dpkts, 1D)",
    "trans_depth": "1 + json + password + login + bonus", "response_body_len": "least(text_len + 100 * failed, 20000D)", "ct_srv_src": "1 + login + captcha + admin",
    "ct_state_ttl": "1 + failed + sql", "ct_dst_ltm": "1 + login + failed", "ct_src_dport_ltm": "1 + bonus", "ct_dst_sport_ltm": "1 + bonus",
    "ct_dst_src_ltm": "1 + bonus", "is_ftp_login": "0D", "ct_ftp_cmd": "0D", "ct_flw_http_mthd": "if(method <=> 'POST', 2D, 1D)",
    "ct_src_ltm": "1 + password + token + sql", "ct_srv_dst": "1 + admin + failed", "is_sm_ips_ports": "0D",
}


def flow_features(r: DataFrame, columns: tuple[str, ...] = tuple(FLOW), choices: dict[str, list[str]] | None = None) -> DataFrame:
    """Flow-style features of each request with its response; ``r`` has the columns of requests plus time and resp_time.

    Counts and flags are computed in a first projection, so that each stands in the plan once. Null counts as empty.
    Unknown names of ``columns`` get a similar feature; ``choices`` names categorical features with the model's categories.
    """
    clean = r.withColumns({c: _text(c) for c in ("uri", "host", "body", "user_agent", "content_type")} | {"excerpt": excerpt(F.col("response"))})
    flag = lambda words: has_any(F.col("merged"), words).cast("double")
    base = clean.withColumn("merged", F.lower(F.concat_ws(" ", "uri", "host", "body", "excerpt", "user_agent", "content_type"))).select(
        "file_id", "seq_id", "method", counted(F.col("merged"), SQL_MARKS).cast("double").alias("sql"), flag(LOGIN).alias("login"),
        flag(CAPTCHA).alias("captcha"), flag(PASSWORD).alias("password"), flag(ADMIN).alias("admin"), flag(TOKEN).alias("token"),
        F.lower("content_type").contains("json").cast("double").alias("json"), flag(BUSINESS_ERRORS).alias("failed"),
        ((F.coalesce("status_code", F.lit(0)) >= 400) & F.col("response").isNotNull() | (has_any(F.concat_ws(" ", "body", "excerpt", "uri"), BUSINESS_ERRORS) == 1)).alias("bad"),
        F.length("uri").cast("double").alias("uri_len"), path_depth(F.col("uri")).cast("double").alias("depth"),
        F.length("body").cast("double").alias("body_len"), F.length("user_agent").cast("double").alias("agent_len"),
        F.length(request_text(_request_fields())).cast("double").alias("text_len"), F.col("response").isNotNull().cast("double").alias("answered"),
        F.when(F.col("response").isNotNull(), F.greatest(F.lit(0.001), F.col("resp_time") - F.col("time"))).otherwise(0.05).alias("gap"),
    )
    # Weights and bounds of the features as the model was trained with them.
    f = base.selectExpr("*", "3 * sql + 2 * password + login + 3 * failed + token AS bonus", "least(5.0D, 0.03D + gap + body_len / 5000 + 0.02D * sql) AS dur")
    f = f.selectExpr(
        "*", "2 + depth + if(method <=> 'POST', 1D, 0D) + bonus AS spkts", "2 + answered + failed AS dpkts",
        "100 + uri_len + body_len + agent_len + 30 * bonus AS sbytes", "80 + 0.2D * least(text_len, 5000D) + 50 * failed AS dbytes",
        "greatest(dur, 0.001D) AS span",
    )
    made = [F.expr(features.named(c, FLOW, "1 + bonus")).alias(c) for c in columns]
    return f.select("file_id", "seq_id", *made, *[features.category(c, known, F.col("bad")).alias(c) for c, known in (choices or {}).items()])

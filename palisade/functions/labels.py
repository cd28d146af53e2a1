"""Attack-type, region and risk labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.addresses import address_key, is_public

# Canonical attack labels in order of their tests. A label is given where one of the fragments
# is in the lower-cased value without blanks, underscores and hyphens, or one of the words in the value itself.
ATTACK_TESTS = (
    ("SQL注入", ("sql", "sqli", "unionselect", "or1=1", "informationschema", "sleep(", "sql娉", "sql??"), ()),
    ("XSS", ("xss", "<script"), ()),
    ("DDoS", ("ddos",), ()),
    ("SSRF", ("ssrf",), ()),
    ("RCE", ("rce", "remotecode"), ("远程代码",)),
    ("暴力破解", ("bruteforce",), ("暴力破解", "爆破", "鏆村姏鐮磋В")),
    ("端口扫描", ("portscan", "nmap"), ("端口扫描", "绔彛鎵弿")),
    ("路径遍历", ("traversal",), ("路径遍历", "璺緞閬嶅巻")),
    ("文件上传", ("upload",), ("文件上传", "鏂囦欢涓婁紶")),
    ("命令注入", ("cmd", "commandinject"), ("命令注入", "鍛戒护娉ㄥ叆")),
)
OTHER = "可疑流量"

# Raw spellings that a search for a canonical label also finds.
ATTACK_ALIASES = {
    "SQL注入": ("SQL注入", "SQL娉ㄥ叆", "SQL??", "sqli", "sql injection"),
    "XSS": ("XSS", "xss"),
    "暴力破解": ("暴力破解", "鏆村姏鐮磋В", "brute force", "bruteforce"),
    "DDoS": ("DDoS", "ddos"),
    "端口扫描": ("端口扫描", "绔彛鎵弿", "port scan", "nmap"),
    "命令注入": ("命令注入", "鍛戒护娉ㄥ叆", "command injection"),
    "路径遍历": ("路径遍历", "璺緞閬嶅巻", "path traversal"),
    "文件上传": ("文件上传", "鏂囦欢涓婁紶", "file upload"),
    "SSRF": ("SSRF", "ssrf"),
    "RCE": ("RCE", "rce"),
    "可疑流量": ("可疑流量", "鍙枒娴侀噺", "suspicious"),
}

# Patterns of requests for each attack type, tested in this order on lower-cased text.
ATTACK_PATTERNS = (
    ("SQL注入", r"(?:\bor\b\s+1=1|union\s+select|information_schema|sleep\(|benchmark\(|ascii\s*\(|substr\s*\(|database\s*\(|\band\b.+--|'\s*or\s*'?\d)"),
    ("XSS", r"(<script|javascript:|onerror=|onload=)"),
    ("路径遍历", r"(\.\./|\.\.\\|/etc/passwd|\\windows\\system32)"),
    ("命令注入", r"(cmd\.exe|/bin/sh|powershell|;\s*cat\s+)"),
    ("文件上传", r"(multipart/form-data|\.php|\.jsp|\.aspx)"),
    ("端口扫描", r"(scan|masscan|nmap)"),
)

# Regions that were stored in a wrong encoding, and what they stand for.
REGIONS = {
    "鍖椾含": "北京", "涓婃捣": "上海", "骞夸笢": "广东", "娴欐睙": "浙江", "姹熻嫃": "江苏", "灞变笢": "山东",
    "娌冲崡": "河南", "鍥涘窛": "四川", "棣欐腐": "香港", "缇庡浗": "美国", "寰峰浗": "德国", "鍙枒娴侀噺": "未知",
}
UNKNOWN, INTERNAL = "未知", "内网"
NO_REGION = ("unknown", "n/a", "none", "null", "-", "--")
INTERNAL_WORDS = ("private", "localhost", "loopback")

# HTTP status codes that mean a request was blocked; so do all from 500 on.
BLOCKED_STATUS = (401, 403, 404, 406, 409, 429)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, tests, F.lit(False))


def attack_label(raw: Column, strict: bool = False) -> Column:
    """Canonical label of a raw one. By default "brute force" reads as RCE, whose fragment it holds; ``strict`` tests it first."""
    word = F.trim(F.coalesce(raw, F.lit("")))
    plain = F.translate(F.lower(word), " _-", "")
    out = F
    for label, fragments, words in sorted(ATTACK_TESTS, key=lambda t: not (strict and t[0] == "暴力破解")):
        out = out.when(_any([plain.contains(x) for x in fragments] + [word.contains(x) for x in words]), label)
    return out.otherwise(OTHER)


def inferred_attack(text: Column) -> Column:
    """Attack type of a request's text; the first pattern that is found decides."""
    low, out = F.lower(text), F
    for label, pattern in ATTACK_PATTERNS:
        out = out.when(low.rlike(pattern), label)
    return out.otherwise(OTHER)


def region_label(raw: Column) -> Column:
    """A stored region as it is shown."""
    word = F.trim(F.coalesce(raw, F.lit("")))
    low, out = F.lower(word), F.when(word == "", UNKNOWN)
    for wrong, right in REGIONS.items():
        out = out.when(word == wrong, right)
    out = out.when(low.isin(*NO_REGION) | word.contains(UNKNOWN), UNKNOWN)
    return out.when(_any([low.contains(x) for x in INTERNAL_WORDS]) | word.contains(INTERNAL), INTERNAL).otherwise(word)


def chosen_attack(method: Column, verdict: Column, case: Column, inferred: Column) -> Column:
    """The first of the four that is not blank, as a canonical label."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return attack_label(F.coalesce(blank(method), blank(verdict), blank(case), inferred))


def risk(severity: Column, confidence: Column, raw_score: Column, label: Column) -> Column:
    """high, medium or low: severity first, then the confidence, or the score where there is none."""
    known = F.lower(F.trim(severity))
    value = F.coalesce(confidence, raw_score, F.lit(0.0))
    return (
        F.when(known.isin("low", "medium", "high"), known)
        .when(known == "critical", "high")
        .when(value >= 0.8, "high")
        .when((value >= 0.45) | (F.coalesce(label, F.lit("")) == "suspicious"), "medium")
        .otherwise("low")
    )


def attack_result(status: Column) -> Column:
    return F.when(status.isin(*BLOCKED_STATUS) | (status >= 500), "blocked").otherwise("success")


def region(ip: Column, stored: Column, cached: Column) -> Column:
    """Region of a source: the stored one unless it is unknown, else by the address, else the cached one."""
    known = region_label(stored)
    return (
        F.when((known != UNKNOWN) & (F.upper(known) != "TEST"), known)
        .when(address_key(ip).isNull(), UNKNOWN)
        .when(~is_public(ip), INTERNAL)
        .otherwise(region_label(cached))
    )


def joined_region(country: Column, province: Column, city: Column) -> Column:
    """Parts of a place from large to small; the home country is only named where nothing else is known."""
    country, province, city = (F.trim(F.coalesce(x, F.lit(""))) for x in (country, province, city))
    home = F.lower(country).isin("cn", "china") | (country == "中国")
    parts = F.filter(F.array(F.when(home, "").otherwise(country), province, city), lambda x: x != "")
    return F.coalesce(F.nullif(F.array_join(parts, "/"), F.lit("")), F.when(home, "中国").otherwise(UNKNOWN))


def machine_of(key: Column, machines: int) -> Column:
    """A machine number from 1 on that depends on the key alone."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % machines + 1

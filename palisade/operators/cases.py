"""Cases: requests numbered, joined with their manifest and analysis, and what is asked about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import addresses, http, labels

KEY = ["file_id", "seq_id"]
# Where a log names its source address, and its hosts.
SOURCE_PATTERNS = (r"(?mi)^src_ip=([^\r\n]+)", r"(?mi)\bsrc(?:_| )?ip[:=]\s*([0-9a-fA-F:.]+)", r"((?:\d{1,3}\.){3}\d{1,3})\s*->")
HOST_PATTERNS = (r"(?mi)^HOST=([^\r\n]+)", r"(?mi)^Host:\s*([^\r\n]+)")
# Payloads shown for attack types.
PAYLOADS = {
    "SQL注入": "username=admin' OR 1=1 --", "XSS": "<script>alert('xss')</script>", "暴力破解": "POST /login retry=120 user=admin", "DDoS": "High frequency requests burst detected",
    "端口扫描": "SYN scan to 22,80,443,3306", "命令注入": "cmd=ping 127.0.0.1 && whoami", "路径遍历": "../../etc/passwd", "文件上传": "multipart payload with executable signature",
    "SSRF": "url=http://169.254.169.254/latest/meta-data", "RCE": "template={{7*7}} runtime command chain",
}
OTHER_PAYLOAD = "suspicious payload"
LEAST_SCORE = 0.7  # from here on a record goes to the analysis, whatever its label


def sequenced(requests: DataFrame, keep_static: bool = False) -> DataFrame:
    """seq_id of each request in its file, by frame, from 1; requests for static files are left out before they are numbered."""
    rows = requests if keep_static else requests.where(~http.is_static(F.col("uri")))
    return rows.withColumn("seq_id", F.row_number().over(Window.partitionBy("file_id").orderBy("frame_no")))


def numbered(rows: DataFrame, key: Column, digits: int = 2) -> DataFrame:
    """``rows`` with place from 1 on in order of a hexadecimal key: counts of its first digits, then numbers inside them, so no window holds all rows."""
    keyed = rows.withColumns({"_key": key, "_bin": F.substring(key, 1, digits)})
    counts = keyed.groupBy("_bin").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_bin", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bin").orderBy("_key"))
    return keyed.join(F.broadcast(starts), "_bin").withColumn("place", F.col("_before") + inside).drop("_key", "_bin", "_before")  # 16 ** digits rows


def shuffled(attacks: DataFrame, benign: DataFrame, id_column: str, seed: int) -> DataFrame:
    """Both samples in one order that only depends on the seed; ids are distinct."""
    both = attacks.withColumn("is_attack", F.lit(1)).unionByName(benign.withColumn("is_attack", F.lit(0)))
    return numbered(both, F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string"))))


def for_analysis(records: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Records whose score or label calls for an analysis; an unreadable score counts as 0."""
    score = F.coalesce(F.col("score").try_cast("double"), F.lit(0.0))
    return records.where((score >= least) | (F.lower(F.coalesce("label", F.lit(""))) == "suspicious"))


def joined(cases: DataFrame, manifest: DataFrame, analyses: DataFrame) -> DataFrame:
    """Each case with its manifest row and its analysis, where there are any: each column from the first table that has it."""
    c = cases.select("case_id", *[F.col(x).alias(f"c_{x}") for x in cases.columns if x != "case_id"])
    m = manifest.select("case_id", *[F.col(x).alias(f"m_{x}") for x in ("file_id", "seq_id", "raw_score", "norm_score", "label", "uri")])
    a = analyses.select("case_id", *[F.col(x).alias(f"a_{x}") for x in analyses.columns if x != "case_id"])
    rows = c.join(m, "case_id", "left").join(a, "case_id", "left")
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names])
    score = pick("c_raw_score", "m_raw_score").try_cast("double")
    return rows.select(
        "case_id", pick("c_file_id", "m_file_id").alias("file_id"), pick("c_seq_id", "m_seq_id").try_cast("int").alias("seq_id"), score.alias("raw_score"),
        pick("c_norm_score", "m_norm_score").try_cast("double").alias("norm_score"), pick("c_label", "m_label").alias("label"), F.col("c_method").alias("method"), pick("c_uri", "m_uri").alias("uri"),
        pick("a_source_ip", "c_source_ip").alias("source_ip"), pick("a_destination_ip", "c_destination_ip").alias("destination_ip"), pick("a_attack_interface", "c_uri").alias("attack_interface"),
        pick("a_analyzed_at", "c_analyzed_at").alias("analyzed_at"), pick("a_model_name", "c_model_name").alias("model_name"), F.col("a_verdict").alias("verdict"),
        F.coalesce(F.col("a_confidence").try_cast("double"), score).alias("confidence"), F.col("c_llm_status").alias("llm_status"),
        labels.chosen_attack(pick("a_attack_method", "a_verdict"), F.lit(None).cast("string"), F.col("c_attack_type"), labels.inferred_attack(F.coalesce("c_request_text", F.lit("")))).alias("attack_type"),
    )


def addresses_in(text: Column, patterns: tuple[str, ...] = SOURCE_PATTERNS) -> Column:
    """Distinct addresses that a log names as its source, pattern by pattern, in order of appearance."""
    found = [F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), 1), addresses.canonical_address) for p in patterns]
    return F.array_distinct(F.filter(F.concat(*found), lambda x: x != ""))


def hosts_in(text: Column) -> Column:
    """Distinct hosts that a log names."""
    found = [F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), 1), http.host_name) for p in HOST_PATTERNS]
    return F.array_distinct(F.filter(F.concat(*found), lambda x: x != ""))


def block_candidates(source: Column, log: Column, analysed: tuple[Column, ...] = (), known: Column | None = None, mode: str = "source", destination: Column | None = None) -> Column:
    """Distinct addresses to block or release, in this order: those stored (``known``), the event's source, its log's, its analysis's.

    ``mode`` "target" takes the analysis's ``destination`` instead of the sources, "both" takes it after them; any other mode means "source".
    """
    parts = []
    if mode != "target":
        single = F.array(addresses.canonical_address(source))
        parts += [single, addresses_in(log), *([F.array(*[addresses.canonical_address(a) for a in analysed])] if analysed else [])]
    if mode in ("target", "both") and destination is not None:
        parts.append(F.array(addresses.canonical_address(destination)))
    if known is not None:
        parts.insert(0, F.transform(F.coalesce(known, F.array().cast("array<string>")), addresses.canonical_address))
    every = F.concat(*parts) if parts else F.array().cast("array<string>")
    return F.array_distinct(F.filter(every, lambda x: F.coalesce(x, F.lit("")) != ""))


def with_input_address(cases: DataFrame, captured: DataFrame) -> DataFrame:
    """Cases with input_ip: the source address of their place in the captured file, else that of the file's first place, else empty.

    captured: file_id, seq_id, src_ip; of equal places the last file row would do, so one is kept.
    """
    valid = captured.select(*KEY, addresses.canonical_address(F.col("src_ip")).alias("ip")).where("ip <> ''").groupBy(*KEY).agg(F.max("ip").alias("ip"))
    own = valid.withColumnRenamed("ip", "own_ip")
    head = valid.where("seq_id = 1").select("file_id", F.col("ip").alias("head_ip"))
    rows = cases.join(own, KEY, "left").join(head, "file_id", "left")
    return rows.select(*cases.columns, F.coalesce("own_ip", "head_ip", F.lit("")).alias("input_ip"))


def source_address(analysis: Column, case: Column, text: Column, from_input: Column) -> Column:
    """The source of a case: what its analysis says, or else the case; else the first address in its text; else the input file's."""
    stated = addresses.canonical_address(F.coalesce(analysis, case))
    named = F.try_element_at(addresses_in(text, SOURCE_PATTERNS[:2]), F.lit(1))
    return F.coalesce(F.nullif(stated, F.lit("")), named, F.nullif(from_input, F.lit("")), F.lit(""))


def normalised_verdict(answers: DataFrame, as_of: str) -> DataFrame:
    """A model's answers with a default for each field that is null or empty; evidence that is no list becomes an empty one.

    answers: case_id, uri, method, src_ip, dst_ip and answer, a JSON text.
    """
    field = lambda name: F.nullif(F.get_json_object("answer", f"$.{name}"), F.lit(""))
    listed = F.get_json_object("answer", "$.evidence")
    filled = lambda name, *other: F.coalesce(field(name), *other).alias(name)
    unknown, uri = F.lit("unknown"), F.coalesce(F.nullif("uri", F.lit("")), F.lit("unknown"))
    return answers.select(
        "case_id", filled("source_ip", F.nullif("src_ip", F.lit("")), unknown), filled("destination_ip", F.nullif("dst_ip", F.lit("")), unknown), filled("attack_interface", uri), filled("attack_method", unknown),
        filled("attack_path", F.trim(F.concat_ws(" ", F.coalesce("method", F.lit("")), uri))), filled("attack_time", F.lit(as_of)), filled("severity", unknown),
        F.coalesce(field("confidence").try_cast("double"), F.lit(0.0)).alias("confidence"), filled("verdict", unknown),
        F.coalesce(F.when(listed.startswith("["), F.from_json(listed, "array<string>")), F.array().cast("array<string>")).alias("evidence"), filled("summary", F.lit("")),
    )


def question(attack_type: Column, method: Column, uri: Column, host: Column, request: Column, response: Column) -> Column:
    """The text with which knowledge is looked up for a case; its lengths are bounded by the format."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.concat_ws("\n", *map(empty, (attack_type, method, uri, host)), F.substring(empty(request), 1, 2500), F.substring(empty(response), 1, 1200))


def shown_payload(attack_type: Column) -> Column:
    """What is shown as the payload of an attack type, whatever its spelling."""
    label, out = labels.attack_label(attack_type), F
    for name, text in PAYLOADS.items():
        out = out.when(label == name, text)
    return out.otherwise(OTHER_PAYLOAD)

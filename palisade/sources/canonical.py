"""Capture batches as text: cases between marks, each with ``key=value`` lines and two blocks.

Both directions are column expressions; a batch is one bounded group (up to 128
cases), so its text may be gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import payloads

# The marks of the format, and the fields of a case in their order.
BATCH_START, META_END = "### BATCH_START ###", "### BATCH_META_END ###"
CASE_START, CASE_END = "### CASE_START ###", "### CASE_END ###"
REQUEST_BLOCK, REQUEST_END, RESPONSE_BLOCK, RESPONSE_END = "[REQUEST_BLOCK]", "[/REQUEST_BLOCK]", "[RESPONSE_BLOCK]", "[/RESPONSE_BLOCK]"
FIELDS = (
    "file_id", "seq_id", "frame_req", "frame_resp", "time_req", "time_resp", "src_ip", "dst_ip", "src_port", "dst_port", "method", "uri", "host", "status_code", "content_type",
    "request_text", "response_text",
)
PACKET = "frame_number time_epoch src_ip dst_ip src_port dst_port stream method uri host content_type file_data status_code phrase request_in response_in".split()


def escaped(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit("\\n"))


def batch_texts(records: DataFrame, ports: str = "80") -> DataFrame:
    """file_id, batch, value: the text of each batch; ``records`` has batch, request_block, response_block and any of the fields, empty where it has none."""
    field = lambda c: F.col(c).cast("string") if c in records.columns else F.lit("")
    lines = [F.concat(F.lit(f"{c}="), escaped(field(c))) for c in FIELDS]
    blocks_ = (F.lit(REQUEST_BLOCK), F.coalesce("request_block", F.lit("")), F.lit(REQUEST_END), F.lit(RESPONSE_BLOCK), F.coalesce("response_block", F.lit("")), F.lit(RESPONSE_END))
    case = F.concat_ws("\n", F.lit(CASE_START), *lines, *blocks_, F.lit(CASE_END), F.lit(""))
    cases = records.select("file_id", "batch", F.struct("seq_id", case.alias("case")).alias("c"))
    grouped = cases.groupBy("file_id", "batch").agg(F.array_sort(F.collect_list("c")).alias("cases"))
    head = F.concat_ws(
        "\n", F.lit(BATCH_START), F.concat(F.lit("file_id="), F.col("file_id")), F.concat(F.lit("batch_size="), F.size("cases").cast("string")),
        F.lit("source=live_capture"), F.lit(f"port={ports}"), F.lit("capture_mode=canonical_http_batch"), F.lit(META_END), F.lit(""),
    )
    return grouped.select("file_id", "batch", F.concat_ws("\n", head, F.array_join(F.transform("cases", lambda c: c["case"]), "\n")).alias("value"))


def numbered(records: DataFrame, size: int) -> DataFrame:
    """``records`` with batch and with seq_id as the place in it, 1 to ``size``, as a capture writes its files; order: file_id and seq_id before."""
    order = Window.partitionBy("file_id").orderBy("seq_id")
    place = F.row_number().over(order) - 1
    return records.withColumn("_place", place).withColumns({"batch": F.floor(F.col("_place") / size), "seq_id": (F.col("_place") % size + 1).cast("long")}).drop("_place")


def is_canonical(value: Column) -> Column:
    return value.contains(BATCH_START) & value.contains(CASE_START)


def key_values(text: Column) -> Column:
    """Map of ``key=value`` lines: the key ends at the first =, both sides are trimmed, the last line of a key counts."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.instr(x, "=") > 1)
    entry = lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("v"))
    last = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(payloads.once(F.transform(lines, entry), last))


def _block(case: Column, name: str) -> Column:
    """What stands between a block's mark and the next mark."""
    return payloads.stripped(F.regexp_extract(case, rf"(?s)\[{name}_BLOCK\]\s*?\n(.*?)(?:\n\s*\[/?RE(?:QUEST|SPONSE)_BLOCK\]|\z)", 1))


def parsed(texts: DataFrame) -> DataFrame:
    """One record for each case of canonical texts (file_id, value), numbered from 1 in its file.

    What a case lacks is filled in: its place for the sequence, that for the request's frame and time, a hundredth
    of a second for the answer. A case without a response frame has no response; its response columns are null.
    """
    cases = F.regexp_extract_all("value", F.lit(rf"(?s){CASE_START}(.*?){CASE_END}"), F.lit(1))
    rows = texts.where(is_canonical(F.col("value"))).select(F.col("file_id").alias("file"), F.posexplode(cases).alias("place", "case")).withColumn("place", F.col("place") + 1)
    meta = F.regexp_replace("case", r"(?s)\[RE(?:QUEST|SPONSE)_BLOCK\].*?(?:\[/RE(?:QUEST|SPONSE)_BLOCK\]|(?=\[RESPONSE_BLOCK\])|\z)", "")
    rows = rows.withColumns({"m": key_values(meta), "asked": _block(F.col("case"), "REQUEST"), "answer": _block(F.col("case"), "RESPONSE")})
    text = lambda c: F.nullif(F.col("m")[c], F.lit(""))
    digits = lambda c: F.when(text(c).rlike(r"\A\d+\z"), text(c)).try_cast("long")
    read = rows.select(
        F.coalesce(text("file_id"), "file").alias("file_id"), "place", F.coalesce(digits("seq_id"), "place").alias("seq_id"), digits("frame_req").alias("frame_req"), digits("frame_resp").alias("frame_resp"),
        text("time_req").try_cast("double").alias("time_req"), text("time_resp").try_cast("double").alias("time_resp"), text("src_ip").alias("src_ip"), text("dst_ip").alias("dst_ip"),
        F.coalesce(digits("src_port"), F.lit(0)).cast("int").alias("src_port"), F.coalesce(digits("dst_port"), F.lit(0)).cast("int").alias("dst_port"), text("method").alias("method"), text("uri").alias("uri"),
        text("host").alias("host"), text("status_code").try_cast("int").alias("status_code"), text("content_type").alias("content_type"), payloads.normalised_text(text("request_text")).alias("request_text"),
        payloads.normalised_text(text("response_text")).alias("response_text"), payloads.decoded_block(F.col("asked")).alias("request_block"), payloads.decoded_block(F.col("answer")).alias("response_block"),
    )
    time = F.coalesce("time_req", F.col("seq_id").cast("double"))
    body = F.coalesce(payloads.payload_line(F.col("request_text"), "REQUEST_BODY="), payloads.unhexed(F.col("request_text")))
    excerpt = F.coalesce(
        payloads.payload_line(F.col("request_text"), "RESPONSE_EXCERPT="), payloads.payload_line(F.col("response_text"), "RESPONSE_EXCERPT="), payloads.unhexed(F.col("response_text"))
    )
    answered = F.col("frame_resp").isNotNull()
    return read.withColumns({
        "frame_req": F.coalesce("frame_req", "seq_id"), "time_resp": F.when(answered, F.coalesce("time_resp", time + 0.01)), "time_req": time, "request_body": body,
        "response_excerpt": F.when(answered, excerpt), "status_code": F.when(answered, F.col("status_code")), "response_block": F.nullif("response_block", F.lit("")),
        "response_text": F.when(answered, F.coalesce("response_text", F.lit(""))), "request_text": F.coalesce("request_text", F.lit("")),
    })


# Layouts of verbose packet prints, tried in this order; the first two need more than one block.
_LAYOUTS = (r"(?m)(?=^No\.\s+Time\s+Source)", r"(?m)(?=^Frame\s+\d+\s*:)", r"(?m)(?=^[ \t]*\d+[ \t]+[0-9.]+[ \t]+\S+[ \t]+\S+[ \t]+\S+[ \t]+\d+[ \t]+\S)")
# The first lines of requests and responses, and a packet's summary line.
_REQUEST = r"(?m)^\s*(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(\S+)\s+HTTP/1\.[01]"
_SUMMARY = r"(?m)^\s*(\d+)\s+([0-9.]+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\d+)\s+(.+)$"
_RESPONSE = r"(?m)^\s*HTTP/1\.[01]\s+(\d{3})"


def blocks(texts: DataFrame) -> DataFrame:
    """file_id, block_no and text of each block of verbose prints."""
    filled = [F.filter(F.split("value", p), lambda b: F.trim(b) != "") for p in _LAYOUTS]
    chosen = F.when(F.size(filled[0]) > 1, filled[0]).when(F.size(filled[1]) > 1, filled[1]).otherwise(filled[2])
    return texts.select("file_id", F.posexplode(chosen).alias("block_no", "block"))


def messages(found: DataFrame) -> DataFrame:
    """Request and response fields of blocks; a block that is neither is dropped."""
    b = F.col("block")
    first = lambda p, i=1: F.nullif(F.regexp_extract(b, p, i), F.lit(""))
    line = lambda name: F.trim(first(rf"(?m)^\s*{name}:\s*([^\r\n]+)"))
    host, path, is_request = line("Host"), first(_REQUEST, 2), b.rlike(_REQUEST)
    scheme = F.when(host.contains(":443"), "https://").otherwise("http://")
    ports = r"(?s)(?:Transmission Control Protocol,\s+Src Port:\s*(\d+),\s+Dst Port:\s*(\d+)|Source Port:\s*(\d+).*?Destination Port:\s*(\d+))"
    data = payloads.stripped(F.regexp_extract(b, r"(?s)File Data:\s*\d+\s*bytes(.*?)(?:JavaScript Object Notation:|\z)", 1))
    values, rest = payloads.value_lines(b), payloads.stripped(F.regexp_extract(b, r"(?s)File Data:\s*\d+\s*bytes(.*)\z", 1))
    return found.where(is_request | b.rlike(_RESPONSE)).select(
        "file_id", "block_no", F.coalesce(first(_SUMMARY), first(r"(?m)^Frame\s+(\d+)\s*:")).try_cast("long").alias("frame_no"),
        F.coalesce(first(_SUMMARY, 2), first(r"Epoch Time:\s*([0-9.]+)")).try_cast("double").alias("time"), first(_REQUEST).alias("method"), path.alias("uri"), host.alias("host"),
        F.coalesce(F.trim(first(r"\[Full request URI:\s*([^\]]+)\]")), F.concat(scheme, host, path)).alias("full_uri"),
        line("User-Agent").alias("user_agent"), line("Content-Type").alias("content_type"), F.when(is_request, F.coalesce(F.nullif(data, F.lit("")), values)).alias("request_body"),
        first(_RESPONSE).try_cast("int").alias("status_code"), F.when(~is_request, F.coalesce(F.nullif(values, F.lit("")), F.substring(rest, 1, 500))).alias("response_excerpt"),
        first(r"Response in frame:\s*(\d+)").try_cast("long").alias("response_frame"), first(r"Request in frame:\s*(\d+)").try_cast("long").alias("request_frame"),
        F.coalesce(first(_SUMMARY, 3), first(r"Src:\s*(\d+\.\d+\.\d+\.\d+)")).alias("src_ip"), F.coalesce(first(_SUMMARY, 4), first(r"Dst:\s*(\d+\.\d+\.\d+\.\d+)")).alias("dst_ip"),
        F.coalesce(first(ports), first(ports, 3), first(r"Src Port:\s*(\d+)")).try_cast("int").alias("src_port"), F.coalesce(first(ports, 2), first(ports, 4), first(r"Dst Port:\s*(\d+)")).try_cast("int").alias("dst_port"),
    )

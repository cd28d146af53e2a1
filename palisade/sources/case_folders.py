"""Case documents as files in folders of their own, ``b.<n>``, as analysers of cases expect them.

Each task writes the files of its cases through Arrow's file systems, one small file after the
other, and no committer moves them afterwards; a task that runs again writes the same files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.sources.captures import _folder

NAME = re.compile(r"b\.[^/]+")


def write_case_files(cases: DataFrame, path: str) -> None:
    """Each row of ``cases`` (case_id, value) as a file in its case's folder below ``path``, a new folder; rows of one case get files of their own.

    A line end follows each text, so that no file is empty: readers leave those out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _folder(path)
        for f in frames:
            for case, value, place in zip(f["case_id"], f["value"], f["place"], strict=True):
                if not case or not NAME.fullmatch(case):
                    raise ValueError(f"no name of a case: {case!r}")
                system.create_dir(f"{root}/{case}", recursive=True)
                with system.open_output_stream(f"{root}/{case}/case-{place}.txt") as out:
                    out.write(f"{value or ''}\n".encode())
            yield pd.DataFrame({"written": [len(f)]})

    tasks = 4 * cases.sparkSession.sparkContext.defaultParallelism  # named, as few bytes would become one task
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("value"))
    rows = cases.select("case_id", "value").repartition(tasks, "case_id").withColumn("place", place)
    rows.mapInPandas(run, "written long").write.format("noop").mode("overwrite").save()

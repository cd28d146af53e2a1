"""Pairing over all streams against a plain loop."""

import random
from collections import deque

import pytest

from palisade.sources.staging import folder
from palisade.streaming import pairing


def plain(packets):
    """Packets in order of arrival: by the named frame, or else the oldest waiting request of the response's stream."""
    pending, queues, pairs = {}, {}, []
    for stream, frame, _, is_request, named in packets:
        if is_request:
            pending[frame] = stream
            queues.setdefault(stream, deque()).append(frame)
            continue
        found = named if named in pending else None
        queue = queues.get(stream, deque())
        while found is None and queue:
            first = queue.popleft()
            found = first if first in pending else None
        if found is not None:
            del pending[found]
            pairs.append((stream, found, frame))
    return sorted(pairs)


def crossing(seed, n=160):
    """Packets in which responses name waiting requests of any stream, unknown frames, or nothing."""
    rng, waiting, rows = random.Random(seed), {}, []
    for frame in range(n):
        stream = rng.randrange(6)
        if rng.random() < 0.55 or not waiting:
            rows.append((stream, frame, frame, True, None))
            waiting[frame] = stream
            continue
        kind, named = rng.random(), None
        own = [f for f, s in waiting.items() if s == stream]
        if kind < 0.4:
            named = rng.choice(list(waiting))
            del waiting[named]
        elif own:
            if kind < 0.5:
                named = 10_000 + frame  # no request has this frame
            del waiting[own[0]]
        rows.append((stream, frame, frame, False, named))
    return rows


def stream_of(spark, path):
    return spark.readStream.schema(pairing.PACKET).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


@pytest.fixture
def noiseless(spark):
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_many_batches_and_a_restart_give_what_a_loop_gives(spark, noiseless):
    rows, path, place = crossing(3), folder(spark, "packets"), folder(spark, "pairs")
    assert len({r[0] for r in rows if r[4] is not None}) > 2
    put = lambda i, some: spark.createDataFrame(some, pairing.PACKET).coalesce(1).write.parquet(f"{path}/part-{i}")
    put(0, rows[:60])
    put(1, rows[60:90])
    pairing.paired(spark, stream_of(spark, path), place)
    put(2, rows[90:])
    found = pairing.paired(spark, stream_of(spark, path), place)  # goes on where the first run ended
    assert sorted(map(tuple, found.collect())) == plain(rows)


def test_a_request_that_was_answered_before_leaves_its_response_to_its_own_stream(spark, noiseless):
    rows = [(1, 10, 1, True, None), (2, 20, 2, True, None), (1, 11, 3, False, None), (2, 21, 4, False, 10), (2, 22, 5, False, 20)]
    path, place = folder(spark, "packets"), folder(spark, "pairs")
    spark.createDataFrame([*rows, (2, 23, 6, True, None)], pairing.PACKET).coalesce(1).write.parquet(f"{path}/part-0")
    found = pairing.paired(spark, stream_of(spark, path), place)
    # frame 21 names what frame 11 took; frame 20 is taken by its name meanwhile, so 21 answers the request that then waits
    assert sorted(map(tuple, found.collect())) == [(1, 10, 11), (2, 20, 22), (2, 23, 21)]

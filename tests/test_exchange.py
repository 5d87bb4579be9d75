import os
import threading
import time
from pathlib import Path

from stayscope.operators import boosting as b
from stayscope.sources.files import Exchange


def test_tasks_get_all_messages_in_order(tmp_path):
    found, tasks, steps = {}, 4, 30

    def task(me):
        swap = Exchange(tmp_path.as_uri(), me, tasks).swap
        found[me] = [swap(b"" if me == 1 else f"{me} {k}".encode() * k) for k in range(steps)]

    threads = [threading.Thread(target=task, args=(k,)) for k in range(tasks)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    want = [[b"" if me == 1 else f"{me} {k}".encode() * k for me in range(tasks)] for k in range(steps)]
    assert found == dict.fromkeys(range(tasks), want)
    # Only each one's last message is left.
    assert sorted(os.listdir(tmp_path)) == [f"{steps - 1}-{k}" for k in range(tasks)]


def test_files_still_written_are_awaited(tmp_path):
    whole, other = (3).to_bytes(8, "little") + b"abc", Path(tmp_path, "0-1")

    def slowly():
        for n in (0, 3, 8, 10, 11):
            other.write_bytes(whole[:n])
            time.sleep(0.05)

    writer = threading.Thread(target=slowly)
    writer.start()
    assert Exchange(tmp_path.as_uri(), 0, 2).swap(b"own") == [b"own", b"abc"]
    writer.join()


def test_exchanges_do_not_wait_for_the_barrier(spark, monkeypatch):
    """Spark's barrier lets a task wait up to a second each time; 40 rounds of depth 3 have 120 exchanges."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3)).round(1)
    df = spark.createDataFrame([(v.tolist(), float(v.sum())) for v in x], "features array<double>, price double").repartition(3)
    monkeypatch.setattr(b, "TASK_ROWS", 300)
    began = time.time()
    model = b.PenalisedBoosting(rounds=40, step=0.2, depth=3).fit(df)
    assert len(model.trees) == 40 and time.time() - began < 60


def test_stores_that_tasks_cannot_open_use_the_barrier(spark, monkeypatch):
    rows = [([float(k % 7), float(k % 3)], float(k % 7)) for k in range(200)]
    df = spark.createDataFrame(rows, "features array<double>, price double").repartition(2)
    boost = b.PenalisedBoosting(rounds=2, step=0.5, depth=2)
    alone = boost.fit(df).trees

    def unknown(*_):
        raise ValueError("name one of the stores")

    monkeypatch.setattr(b, "TASK_ROWS", 100)
    monkeypatch.setattr(b, "qualified", unknown)
    assert [t.feature for t in boost.fit(df).trees] == [t.feature for t in alone]

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from quizlake.functions.extract import last_letter
from quizlake.operators import annotate as ann
from quizlake.operators.requests import SILENT, Desk, ReplyLog, Window, digest
from quizlake.sources.result_table import ResultTable


def test_many_requests_are_open_but_never_more_than_the_window():
    lock, state = threading.Lock(), {"now": 0, "most": 0}

    def respond(batch):
        with lock:
            state["now"] += 1
            state["most"] = max(state["most"], state["now"])
        time.sleep(0.02)
        with lock:
            state["now"] -= 1
        return [batch[0].upper()]

    rows = [(f"p{i}",) for i in range(60)]
    started = time.time()
    assert Desk(respond, Window(in_flight=6, deadline=5), 1, None).answer(rows) == [(f"P{i}", None, 1) for i in range(60)]
    assert state["most"] == 6 and time.time() - started < 1.0


def test_a_hanging_request_costs_one_deadline_and_the_others_go_on():
    def respond(batch):
        if batch[0] == "hang":
            time.sleep(60)
        return [batch[0]]

    started = time.time()
    out = Desk(respond, Window(in_flight=4, deadline=0.5), 3, None).answer([("a",), ("hang",), *[(f"b{i}",) for i in range(50)]])
    assert time.time() - started < 2
    assert out[1] == (None, "TimeoutError: no reply within 0.5 s", 1) and all(o[1] is None for i, o in enumerate(out) if i != 1)


def test_a_responder_that_never_answers_costs_one_deadline():
    started = time.time()
    out = Desk(lambda batch: time.sleep(60), Window(in_flight=4, deadline=0.4), 3, None).answer([(f"p{i}",) for i in range(200)])
    assert time.time() - started < 1.5
    assert sum(o[2] == 1 for o in out) == 4 and sum(o == (None, SILENT, 0) for o in out) == 196


def test_failures_back_off_and_end_with_their_error():
    calls = []

    def respond(batch):
        calls.append((batch[0], time.time()))
        if batch[0] == "twice" and sum(c[0] == "twice" for c in calls) < 3:
            raise RuntimeError("busy")
        if batch[0] == "never":
            raise ValueError("no")
        return ["ok"]

    out = Desk(respond, Window(in_flight=2, deadline=10, wait=0.05), 3, None).answer([("twice",), ("never",), ("fine",), ("fine",)])
    assert out == [("ok", None, 3), (None, "ValueError: no", 3), ("ok", None, 1), ("ok", None, 1)]
    times = [t for name, t in calls if name == "never"]
    assert times[1] - times[0] >= 0.05 and times[2] - times[1] >= 0.1
    assert sum(name == "fine" for name, _ in calls) == 1


def test_attempts_end_with_the_deadline():
    def respond(batch):
        raise RuntimeError("busy")

    out = Desk(respond, Window(in_flight=1, deadline=0.3, wait=0.1), 50, None).answer([("p",)])
    assert out[0][1] == "RuntimeError: busy" and out[0][2] < 5


def test_the_log_keeps_replies_and_forgets_errors(tmp_path):
    log, asked = ReplyLog(str(tmp_path), buckets=3), []

    def respond(batch):
        asked.append(batch[0])
        if batch[0] == "bad":
            raise RuntimeError("no")
        return [batch[0] + "é\n"]

    window = Window(wait=0.01)
    rows = [("a",), ("bad",), ("b",)]
    first = Desk(respond, window, 1, log).answer(rows)
    # A line that a lost task cut off.
    with open(f"{tmp_path}/{log.bucket(digest(('c',)))}/torn.jsonl" if os.path.isdir(f"{tmp_path}/{log.bucket(digest(('c',)))}") else f"{tmp_path}/torn", "a") as file:
        file.write('["' + digest(("c",)))
    assert Desk(respond, window, 1, log).answer([*rows, ("c",)])[:3] == first
    assert sorted(asked) == ["a", "b", "bad", "bad", "c"]


def test_a_killed_task_asks_only_what_is_not_logged(spark, tmp_path):
    replies, marks = str(tmp_path / "log"), str(tmp_path / "marks")
    os.makedirs(marks)

    def make(lives):
        def made():
            def respond(batch):
                with open(f"{marks}/{os.getpid()}-{threading.get_ident()}", "a") as file:
                    file.write(batch[0] + "\n")
                if lives is not None and sum(len(open(f"{marks}/{n}").readlines()) for n in os.listdir(marks)) > lives:
                    os._exit(1)
                return [batch[0].upper()]

            return respond

        return made

    df = spark.createDataFrame([(i, f"p{i}") for i in range(60)], "item_id long, prompt string")
    options = {"window": Window(in_flight=2), "log": ReplyLog(replies, buckets=4), "partitions": 1}
    with pytest.raises(Exception):
        ann.annotate(df, make(40), ["item_id"], **options).collect()
    rows = ann.annotate(df, make(None), ["item_id"], **options).collect()
    assert all(r["response"] == f"P{r['item_id']}" for r in rows) and len(rows) == 60
    asked = [line for name in os.listdir(marks) for line in open(f"{marks}/{name}").read().split()]
    # Only what was open when the task died is asked twice.
    assert set(asked) == {f"p{i}" for i in range(60)} and len(asked) <= 60 + 2


def test_prompts_given_back_stay_pending(spark, tmp_path, items):
    def silent():
        return lambda batch: time.sleep(30)

    asked = items.where("item_id < 40").withColumn("prompt", F.col("question"))
    table = ResultTable(spark, str(tmp_path / "t")).create()
    window = Window(in_flight=2, deadline=0.3)
    with pytest.raises(RuntimeError, match="after 3 rounds"):
        ann.annotate_until(asked, table, silent, last_letter, 10, window=window, partitions=1, max_rounds=3)
    # A window's worth of each round was asked in vain.
    assert table.read().count() == 3 * 2

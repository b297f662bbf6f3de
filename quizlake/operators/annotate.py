"""Running a responder over prompts.

The responder, a model client or anything else that turns prompts into replies, is the caller's.
It runs in Python workers on batches of prompts; everything round it is plain DataFrame work.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import quizlake
from quizlake import fixed_values as fv
from quizlake.functions.compare import answer_status, is_valid
from quizlake.operators.joins import pending
from quizlake.operators.ledger import RankLedger
from quizlake.operators.requests import Desk, ReplyLog, Window
from quizlake.operators.sampling import sample_uniform
from quizlake.schema import REPLIES, REPLY_NAMES
from quizlake.sources.result_table import ResultTable

# Prompts to replies; with ``annotate_runs`` the prompts' run names come as a second list.
Responder = Callable[..., list[str]]

# Rows are spread over tasks for the responder's sake: a lost task asks its prompts again.
_PROMPTS_PER_TASK = 10_000

# The few lines that run in Python workers travel with the job: workers need no copy of the package.
cloudpickle.register_pickle_by_value(quizlake)


def template_responder(echo: bool = False) -> Responder:
    """A stand-in that is no model: letter or refusal, from the prompt's hash alone; with ``echo`` behind
    the prompt, as text generators reply."""

    def reply(prompt: str) -> str:
        digest = hashlib.md5(prompt.encode("utf-8")).hexdigest()
        if digest[0] in "01":
            return "I cannot tell"
        return "Step one.\nAnswer: " + fv.LETTERS[int(digest[1], 16) % len(fv.LETTERS)]

    def respond(prompts: list[str], runs: list[str] | None = None) -> list[str]:
        # Every run has replies of its own.
        told = zip(prompts, runs or [None] * len(prompts))
        return [(p if echo else "") + reply(p if run is None else f"{run}\n{p}") for p, run in told]

    return respond


def _answer_one(respond: Responder, asked: tuple[str, ...], attempts: int) -> tuple[str | None, str | None, int]:
    error = None
    for attempt in range(1, attempts + 1):
        try:
            return respond(*[[value] for value in asked])[0], None, attempt
        except Exception as problem:  # noqa: BLE001 - whatever it was is recorded with the row
            error = f"{type(problem).__name__}: {problem}"
    return None, error, attempts


def annotate(
    df: DataFrame,
    make_responder: Callable[[], Responder],
    keys: list[str],
    prompt: str = "prompt",
    retries: int = 2,
    partitions: int | None = None,
    beside: str | None = None,
    window: Window | None = None,
    log: ReplyLog | None = None,
) -> DataFrame:
    """(keys, response, error, attempts) for every row with a prompt.

    ``make_responder`` is called once per task. A batch that fails is answered row by row, each row
    up to ``retries`` more times; a row that keeps failing gets a null response and its error text,
    and the job goes on. ``beside`` names a column whose values the responder gets as a second list.
    ``partitions`` sets how many tasks call the responder at once, by default the session's
    parallelism. A lost task asks again, so replies should be written before they are used.

    With a ``window`` prompts are asked one by one, several at a time, each within a deadline; equal
    prompts of a batch are asked once. When a whole window passes its deadline without a reply, the
    task's other prompts are given back unasked, with no attempts and the error ``SILENT``. With a
    ``log`` as well, replies are kept by prompt as they come, and a task that is run again, or a
    later job, asks only what is not in it.
    """
    given = [prompt] if beside is None else [prompt, beside]
    if log is not None and window is None:
        window = Window()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        respond = make_responder()
        desk = Desk(respond, window, retries + 1, log) if window else None
        for batch in batches:
            asked = [batch[column].tolist() for column in given]
            if desk:
                columns = pd.DataFrame(desk.answer(list(zip(*asked))), columns=REPLIES.names, index=batch.index)
                yield pd.concat([batch[keys], columns], axis=1)
                continue
            try:
                replies = [(text, None, 1) for text in respond(*asked)]
                if len(replies) != len(batch):
                    raise ValueError("one reply per prompt expected")
            except Exception:  # noqa: BLE001 - one bad prompt must not cost the whole batch
                replies = [_answer_one(respond, row, retries + 1) for row in zip(*asked)]
            columns = pd.DataFrame(replies, columns=REPLIES.names, index=batch.index)
            yield pd.concat([batch[keys], columns], axis=1)

    rows = df.select(*dict.fromkeys([*keys, *given])).where(F.col(prompt).isNotNull())
    tasks = partitions or df.sparkSession.sparkContext.defaultParallelism
    rows = rows.repartition(tasks)
    schema = T.StructType([df.schema[key] for key in keys] + REPLIES.fields)
    return rows.mapInPandas(run, schema)


def annotate_runs(
    df: DataFrame,
    runs: list[str],
    make_responder: Callable[[], Responder],
    key: str = "item_id",
    prompt: str = "prompt",
    **options,
) -> DataFrame:
    """``annotate`` for several runs in one job: each prompt is asked once per run name.

    The responder gets the run names as a second list, so one client can serve all runs and every
    prompt reaches it as it is.
    """
    names = F.explode(F.array(*[F.lit(run) for run in runs]))
    asked = df.select(key, prompt).withColumn("run", names)
    return annotate(asked, make_responder, ["run", key], prompt, beside="run", **options)


def annotate_until(
    items: DataFrame,
    table: ResultTable,
    make_responder: Callable[[], Responder],
    extractor: Callable[[Column], Column],
    target: int,
    key: str = "item_id",
    prompt: str = "prompt",
    seed: int = fv.SAMPLE_SEED,
    max_rounds: int | None = None,
    spare: float = 2.0,
    **options,
) -> DataFrame:
    """Ask until ``target`` valid answers are stored; the first ``target`` of them, in seeded order.

    Pending items are laid out once in the order of a seeded hash. Each round takes the next of them, as
    many as the yield so far calls for and ``spare`` standard deviations more, which mostly spares a
    last round for a handful of rows, and appends their replies to ``table``, with the error text and
    the number of attempts of each; it reads nothing but its own stretch and its own replies. A crash
    loses one round at most, and a rerun goes on from what is stored. Rounds stop when the target is
    met, when no item with a prompt is left, or when a round brings no reply at all because the
    responder is silent; items without a prompt are never asked. All stored replies stay in the table.
    ``max_rounds`` rounds without reaching an end are an error; by default there is no such limit.
    ``target_met`` in the result says whether the target was reached.
    """
    askable = items.where(F.col(prompt).isNotNull())
    answer = F.col("LLMs_answer")
    fields = [name for name in table.schema.names if name in items.columns]
    carried = [name for name in fields if name not in REPLY_NAMES]
    stored = table.read().where(F.col("status") != "pending")
    counts = [F.count("*"), F.count_if(is_valid(answer))]
    asked, valid = stored.agg(*counts).first()
    ledger, rounds = RankLedger(pending(askable, stored, key), key, seed), 0
    while valid < target:
        # Without a valid answer the yield is unknown: ask twice as many as so far.
        if valid:
            missing, share = target - valid, valid / asked
            wanted = math.ceil((missing + spare * math.sqrt(missing * (1 - share))) / share)
        else:
            wanted = max(target, 2 * asked)
        batch = ledger.take(wanted)
        if batch is None:
            break
        if rounds == max_rounds:
            raise RuntimeError(f"{valid} of {target} valid answers after {rounds} rounds")
        rounds += 1
        tasks = max(items.sparkSession.sparkContext.defaultParallelism, -(-wanted // _PROMPTS_PER_TASK))
        spread = {"partitions": tasks, **options}
        replies = annotate(batch, make_responder, carried, prompt, **spread)
        found = replies.withColumnRenamed("response", "LLMs_rationale").withColumn(
            "LLMs_answer", extractor(F.col("LLMs_rationale"))
        )
        # An item whose responder kept failing counts as unparsed, or it would be asked for ever; one that
        # was given back unasked stays pending.
        text = F.coalesce("LLMs_rationale", F.lit(""))
        found = found.where("attempts > 0")
        more, right = table.append(found.withColumn("status", answer_status(text, answer))).agg(*counts).first()
        if not more:
            break
        asked, valid = asked + more, valid + right
    done = table.read().where(is_valid(answer))
    return sample_uniform(done, target, key, seed).withColumn("target_met", F.lit(valid >= target))

"""Question and reply tables derived from the star-schema test tables.

The given texts hold no questions, so items, replies and runs are computed from the numeric tables,
one row per source row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake import fixed_values as fv
from quizlake.functions.options import options_to_json


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _letter(number: Column) -> Column:
    return F.char(F.lit(65) + number)


def _by_key(key: Column, texts: list[Column | str | None]) -> Column:
    """The text whose place in the list is the key modulo the list's length."""
    place = F.pmod(key, F.lit(len(texts)))
    chosen = F.lit(None).cast("string")
    for i, text in enumerate(texts):
        if text is not None:
            value = F.lit(text) if isinstance(text, str) else text
            chosen = F.when(place == i, value).otherwise(chosen)
    return chosen


def mcq(spark: SparkSession, folder: str) -> DataFrame:
    """Items from ``part``: which of five sizes is the listed one."""
    key = F.col("p_partkey")
    options = [
        F.concat(F.lit(f"{letter})"), (F.col("p_size") + j - key % 5).cast("string"))
        for j, letter in enumerate(fv.LETTERS)
    ]
    correct = _letter(key % 5)
    return table(spark, folder, "part").select(
        key.alias("item_id"),
        F.concat(
            F.lit("What size is the "), "p_name", F.lit(" of "), "p_brand", F.lit("?")
        ).alias("question"),
        F.array(*options).alias("options"),
        correct.alias("correct"),
        F.concat(
            F.lit("The listed size is "),
            F.col("p_size").cast("string"),
            F.lit(".\n\nThe answer is: "),
            correct,
        ).alias("rationale"),
        F.lower("p_type").alias("kind"),
    )


def mcq_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Items with options as JSON text, five in fifty damaged or odd."""
    items = mcq(spark, folder)
    case = F.col("item_id") % 50
    full = options_to_json(F.col("options"))
    quoted = F.concat(F.array(F.lit('A)say "x"')), F.slice("options", 2, 4))
    text = (
        F.when(case == 0, F.substr(full, F.lit(1), F.length(full) - 3))
        .when(case == 1, options_to_json(F.slice("options", 1, 4)))
        .when(case == 3, options_to_json(quoted))
        .when(case == 4, F.concat(F.lit("[null,"), F.substr(options_to_json(F.slice("options", 2, 4)), F.lit(2))))
        .otherwise(full)
    )
    correct = F.when(case == 2, "F").otherwise(F.col("correct"))
    return items.select(
        "item_id", "question", text.alias("options_json"), correct.alias("correct")
    )


def _responses_text(letter: Column, key: Column) -> Column:
    return _by_key(
        key,
        [
            F.concat(F.lit("Answer: "), letter),
            F.concat(F.lit("Step one.\nThe answer is "), letter, F.lit(".")),
            F.concat(F.lit("the correct option is: "), F.lower(letter)),
            F.concat(F.lit("Output: Answer: A\nOutput: answer is "), letter),
            F.concat(F.lit("It costs 1,234.50, answer is **"), letter, F.lit("**")),
            "I cannot tell",
            None,
        ],
    )


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Replies from ``orders``: one per order, in three runs."""
    letter = _letter(F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("response_id"),
        F.col("o_custkey").alias("item_id"),
        F.concat(F.lit("run_"), F.lower("o_orderstatus")).alias("run"),
        _responses_text(letter, F.col("o_orderkey")).alias("response"),
    )


def talk(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of conversations, three in four of which end in an answer."""
    letter = _letter(F.col("conv_id") % 5)
    ends = [
        "",
        F.concat(F.lit(" Answer: "), letter),
        F.concat(F.lit(" Answer: A\nthe correct option is: "), F.lower(letter)),
        F.concat(F.lit(" (the ANSWER IS "), letter, F.lit(")")),
    ]
    return table(spark, folder, "conversations").select("conv_id", "turn", F.concat("text", _by_key(F.col("turn"), ends)).alias("text"))


def strict_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Replies that keep to the prescribed closing sentence, more or less."""
    letter = _letter(F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    text = _by_key(
        F.col("o_orderkey"),
        [
            F.concat(F.lit("By steps.\nThe correct answer is "), letter, F.lit(".")),
            F.concat(F.lit("the CORRECT answer is "), F.lower(letter), F.lit(" or so")),
            F.concat(F.lit("The correct answer is: "), letter),
            None,
        ],
    )
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("response_id"),
        F.col("o_custkey").alias("item_id"),
        F.concat(F.lit("run_"), F.lower("o_orderstatus")).alias("run"),
        text.alias("response"),
    )


def few_shot_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Replies that repeat 0, 1 or 2 worked examples before they answer."""
    shots = F.col("response_id") % 3
    example = F.lit("Instruction: q options: A)1\nOutput: Answer: A\n\n")
    return responses(spark, folder).select(
        "response_id",
        "item_id",
        "run",
        shots.alias("shots"),
        F.concat(F.repeat(example, shots.cast("int")), "response").alias("response"),
    )


def numeric_items(spark: SparkSession, folder: str) -> DataFrame:
    price = F.format_number(F.floor("o_totalprice"), 0)
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("item_id"),
        F.concat(F.lit("What does order "), "o_orderkey", F.lit(" cost?")).alias("question"),
        F.concat(F.lit("Working. #### "), price).alias("answer"),
    )


def numeric_responses(spark: SparkSession, folder: str) -> DataFrame:
    """A reply and the worked answer it is held against, per order."""
    floor = F.floor("o_totalprice")
    plain = floor.cast("string")
    text = _by_key(
        F.col("o_orderkey"),
        [
            F.concat(F.lit("The total is "), F.format_number(floor, 0)),
            F.concat(F.lit("So it is "), (floor + 1).cast("string")),
            F.concat(F.lit("2 steps, about "), plain, F.lit(".")),
            F.concat(F.lit("Balance: -"), plain),
            F.concat(F.lit("Roughly "), plain, F.lit("e0")),
            "no number here",
            None,
        ],
    )
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("response_id"),
        F.concat(F.lit("run_"), F.lower("o_orderstatus")).alias("run"),
        text.alias("response"),
        F.concat(F.lit("Working. #### "), F.format_number(floor, 0)).alias("answer"),
    )


def rationales(spark: SparkSession, folder: str) -> DataFrame:
    """Items with a second rationale of one to three paragraphs more."""
    more = _by_key(
        F.col("item_id"),
        [
            "",
            "\n\nFirst, so to say, The answer is: near.\n\nThen check it.",
            "\n\nCheck it.\n  ",
        ],
    )
    text = F.concat(F.lit("\n "), F.col("rationale"), more)
    return mcq(spark, folder).withColumn("LLMs_rationale", text)


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """A predicted option text per line item, next to its item."""
    letter = F.col("l_quantity").cast("bigint") % 5
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("item_id"),
        F.lower("l_returnflag").alias("run"),
        letter.alias("choice"),
        (F.col("l_linenumber") == 7).alias("silent"),
    )


def grid_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Replies of a grid of named runs, one per line item."""
    line = F.col("l_linenumber")
    status = F.col("l_linestatus")
    thousands = F.element_at(
        F.array(*[F.lit(size) for size in ("0.5", "1", "2", "3", "4", "5", "2")]), line
    )
    human = F.concat(
        F.lit("org/phi-1_5-finetuned-maths"),
        F.when(status == "O", "-AM").otherwise(""),
        F.lit("-"),
        thousands,
        F.lit("k"),
        F.when(line == 7, "-alpha-24").otherwise(""),
    )
    teacher = F.concat(
        F.lit("org/phi-1_5-finetuned-maths-AM-teacher-2k-r-"), (line * 8).cast("string")
    )
    small = F.concat(
        F.when(status == "F", "kd_").otherwise(""),
        F.when(F.col("l_discount") > 0.05, "lora").otherwise("full"),
        F.lit("_finetune_t5-small_custom"),
        (line * 500).cast("string"),
    )
    flag = F.col("l_returnflag")
    run = F.when(flag == "A", human).when(flag == "R", teacher).otherwise(small)
    shots = (
        F.when(F.col("l_tax") < 0.03, "zero_shot")
        .when(F.col("l_tax") < 0.06, "one_shot")
        .when(F.col("l_tax") < 0.08, "one_shot_cot")
        .otherwise("two_shot")
    )
    echo = F.when(shots == "zero_shot", "").otherwise("Output: Answer: B\n\n")
    letter = _letter(F.col("l_quantity").cast("int") % 5)
    reply = F.when(F.col("l_suppkey") % 4 == 0, "not sure").otherwise(
        F.concat(F.lit("Answer: "), letter)
    )
    return table(spark, folder, "lineitem").select(
        run.alias("run"),
        shots.alias("shots"),
        F.when(shots == "zero_shot", 0).otherwise(1).alias("n_shot"),
        F.col("l_partkey").alias("item_id"),
        F.concat(echo, reply).alias("response"),
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")

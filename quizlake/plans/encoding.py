"""Vocabulary and encoding queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake import fixed_values as fv
from quizlake.functions import prompts
from quizlake.functions.options import option_of_letter
from quizlake.operators import encode as enc
from quizlake.operators.batches import padding_report
from quizlake.plans import fixtures as fx
from quizlake.plans import oracle_views as ov
from quizlake.plans.registry import register

_WORDS = 32_000


def _vocabulary_sql(texts: str) -> str:
    return f"""
        SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 1 AS token_id
        FROM (SELECT token, count(*) AS n
              FROM (SELECT unnest({ov.tokens('text')}) AS token FROM {texts}) GROUP BY token
              ORDER BY n DESC, token LIMIT {_WORDS})"""


@register(
    "vocab_topk",
    ov.query("SELECT * FROM vocabulary", vocabulary=_vocabulary_sql("documents")),
)
def vocab_topk(spark: SparkSession, folder: str) -> DataFrame:
    return enc.build_vocabulary(fx.documents(spark, folder), "text", _WORDS)


_EXAMPLES = """
    SELECT item_id, kind, 'question: ' || question || ' options: '
           || list_aggregate(options, 'string_agg', ' ') AS inputs,
           options[ascii(correct) - 64] AS labels
    FROM mcq"""


def _examples(spark: SparkSession, folder: str) -> DataFrame:
    question, options = F.col("question"), F.col("options")
    return fx.mcq(spark, folder).select(
        "item_id",
        "kind",
        prompts.seq2seq_input(question, options).alias("inputs"),
        option_of_letter(options, F.col("correct")).alias("labels"),
    )


def _example_vocabulary(examples: DataFrame) -> DataFrame:
    both = examples.select(F.concat_ws(" ", "inputs", "labels").alias("text"))
    return enc.build_vocabulary(both, "text", _WORDS)


def _ids_sql(source: str, key: str, text: str, length: int) -> str:
    """(key, ids, words): ids cut to length, not yet padded."""
    return f"""
        SELECT {key}, words, coalesce(ids, []) AS ids
        FROM (SELECT {key}, len({ov.tokens(text)}) AS words FROM {source})
        LEFT JOIN (SELECT {key}, list(coalesce(token_id, 1) ORDER BY pos) AS ids
                   FROM (SELECT {key}, unnest(w) AS token, generate_subscripts(w, 1) AS pos
                         FROM (SELECT {key}, {ov.tokens(text)} AS w FROM {source}))
                        LEFT JOIN vocabulary USING (token)
                   WHERE pos <= {length} GROUP BY {key}) USING ({key})"""


def _columns_sql(alias: str, name: str, length: int, width: str) -> str:
    return f"""
        array_to_string(list_resize({alias}.ids, {width}, 0), ' ') AS {name}_ids,
        array_to_string(list_resize(list_transform({alias}.ids, lambda x: 1), {width}, 0), ' ')
            AS {name}_mask,
        CAST({alias}.words AS BIGINT) AS {name}_tokens, {alias}.words > {length} AS {name}_cut"""


def _as_text(df: DataFrame, *names: str) -> DataFrame:
    """Id and mask arrays as text, for comparing."""
    return df.withColumns(
        {
            column: F.array_join(F.col(column).cast("array<string>"), " ")
            for name in names
            for column in (f"{name}_ids", f"{name}_mask")
        }
    )


_LENGTHS = {"inputs": fv.MAX_INPUT_TOKENS, "labels": fv.MAX_LABEL_TOKENS}


@register(
    "encoded_examples",
    ov.query(
        f"""
        SELECT item_id, {_columns_sql('i', 'inputs', 512, '512')},
               {_columns_sql('l', 'labels', 128, '128')}
        FROM input_ids i JOIN label_ids l USING (item_id)""",
        "mcq",
        examples=_EXAMPLES,
        texts="SELECT inputs || ' ' || labels AS text FROM examples",
        vocabulary=_vocabulary_sql("texts"),
        input_ids=_ids_sql("examples", "item_id", "inputs", 512),
        label_ids=_ids_sql("examples", "item_id", "labels", 128),
    ),
)
def encoded_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Training examples: inputs of 512 and labels of 128 ids."""
    examples = _examples(spark, folder)
    encoded = enc.encode(examples, "item_id", _LENGTHS, _example_vocabulary(examples))
    return _as_text(encoded, "inputs", "labels")


@register(
    "encoded_longest",
    ov.query(
        f"""
        SELECT item_id, kind, {_columns_sql('i', 'inputs', 512, 'longest')}
        FROM input_ids i JOIN examples USING (item_id)
             JOIN (SELECT kind, max(len(ids)) AS longest
                   FROM input_ids JOIN examples USING (item_id) GROUP BY kind) USING (kind)""",
        "mcq",
        examples=_EXAMPLES,
        texts="SELECT inputs || ' ' || labels AS text FROM examples",
        vocabulary=_vocabulary_sql("texts"),
        input_ids=_ids_sql("examples", "item_id", "inputs", 512),
    ),
)
def encoded_longest(spark: SparkSession, folder: str) -> DataFrame:
    """Inputs padded to the longest text of their kind."""
    examples = _examples(spark, folder)
    encoded = enc.encode(
        examples,
        "item_id",
        {"inputs": fv.MAX_INPUT_TOKENS},
        _example_vocabulary(examples),
        padding="longest",
        batch="kind",
    )
    return _as_text(encoded, "inputs")


@register(
    "encoded_batches",
    ov.query(
        f"""
        SELECT batch, count(*) AS n, CAST(sum(kept) AS BIGINT) AS text_used, CAST(count(*) * max(kept) - sum(kept) AS BIGINT) AS text_pads,
               round((count(*) * max(kept) - sum(kept)) / nullif(count(*) * max(kept), 0)::DOUBLE, 6) AS text_padding
        FROM (SELECT kept, (row_number() OVER (ORDER BY kept, {ov.seeded(fv.SAMPLE_SEED, 'doc_id')}, doc_id) - 1) // 32 AS batch
              FROM (SELECT doc_id, least(len({ov.tokens('text')}), 512) AS kept FROM documents))
        GROUP BY batch"""
    ),
)
def encoded_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in batches of 32 of nearly one length, each padded to its longest: the padding per batch."""
    documents = fx.documents(spark, folder).select("doc_id", "text")
    vocabulary = enc.build_vocabulary(documents, "text", _WORDS)
    encoded = enc.encode(documents, "doc_id", {"text": fv.MAX_INPUT_TOKENS}, vocabulary, padding="longest", batch_size=32)
    return padding_report(encoded, ["text"], ["batch"])


@register(
    "encoded_documents",
    ov.query(
        f"SELECT doc_id, {_columns_sql('i', 'text', 512, '512')} FROM text_ids i",
        vocabulary=_vocabulary_sql("documents"),
        text_ids=_ids_sql("documents", "doc_id", "text", 512),
    ),
)
def encoded_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document over the vocabulary of all documents."""
    documents = fx.documents(spark, folder).select("doc_id", "text")
    vocabulary = enc.build_vocabulary(documents, "text", _WORDS)
    encoded = enc.encode(documents, "doc_id", {"text": fv.MAX_INPUT_TOKENS}, vocabulary)
    return _as_text(encoded, "text")


@register(
    "truncation_report",
    ov.query(
        f"""
        SELECT lang, count(*) AS n, count(*) FILTER (WHERE words > 512) AS n_cut,
               CAST(sum(CASE WHEN words > 512 THEN words - 512 ELSE 0 END) AS BIGINT) AS words_lost,
               CAST(max(words) AS BIGINT) AS longest
        FROM (SELECT lang, len({ov.tokens('text')}) AS words FROM documents) GROUP BY lang"""
    ),
)
def truncation_report(spark: SparkSession, folder: str) -> DataFrame:
    documents = fx.documents(spark, folder)
    return enc.truncation_report(documents, ["lang"], "text", fv.MAX_INPUT_TOKENS)

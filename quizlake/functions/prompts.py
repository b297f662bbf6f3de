"""Training texts and prompts as column expressions.

Where the published wording differs between training and evaluation the default is the sensible
form and the other one sits behind an argument.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quizlake import fixed_values as fv
from quizlake.functions.options import comma_joined, first_five, lettered

# A trailing run is tried from its start alone, so that runs within the text cost one look each.
_EDGE_SPACE = rf"^{fv.SPACE}++|(?<!{fv.SPACE}){fv.SPACE}++$"


def without_closing(rationale: Column) -> Column:
    """A rationale less the paragraphs that give its answer away."""
    paragraphs = F.split(F.regexp_replace(rationale, _EDGE_SPACE, ""), "\n\n")
    kept = F.filter(paragraphs, lambda p: ~p.contains(fv.CLOSING_PHRASE))
    return F.array_join(kept, "\n\n")


def seq2seq_input(question: Column, options: Column, final_stop: bool = False) -> Column:
    """``question: ... options: ...``; evaluation texts end in a full stop, training ones do not."""
    text = F.concat(F.lit("question: "), question, F.lit(" options: "), first_five(options))
    return F.concat(text, F.lit(".")) if final_stop else text


def seq2seq_distil_input(question: Column, options: Column, rationale: Column) -> Column:
    return F.concat(seq2seq_input(question, options), F.lit(", "), without_closing(rationale))


def zero_shot(question: Column, options: Column, examples: Column | None = None) -> Column:
    """Instruction prompt that leaves the output open, behind any worked examples."""
    return F.concat(
        F.lit("") if examples is None else examples,
        F.lit("Instruction: "),
        question,
        F.lit(" options: "),
        comma_joined(options),
        F.lit("\nOutput: "),
    )


def instruct_text(
    question: Column, options_text: Column, rationale: Column, mode: str = "default"
) -> Column:
    """Instruction with its rationale. ``legacy`` puts a backslash where the newline belongs."""
    separator = "\\Output: " if mode == "legacy" else "\nOutput: "
    return F.concat(
        F.lit("Instruction: "),
        question,
        F.lit(" options: "),
        options_text,
        F.lit(separator),
        rationale,
    )


def letter_example(question: Column, options: Column, correct: Column) -> Column:
    """Worked example with the letter alone."""
    return F.concat(zero_shot(question, options), F.lit("Answer: "), correct, F.lit("\n\n"))


def rationale_example(
    question: Column, options: Column, rationale: Column, correct: Column
) -> Column:
    """Worked example that reasons before it answers."""
    return F.concat(
        zero_shot(question, options), rationale, F.lit(" Answer: "), correct, F.lit("\n\n")
    )


def teacher_mcq(question: Column, options: Column) -> Column:
    return F.concat(question, F.lit("\n\nOptions: "), lettered(options, ": "))


def teacher_numeric(question: Column) -> Column:
    return F.concat(F.lit(fv.NUMERIC_INSTRUCTION), question)


def step_by_step(question: Column, options: Column) -> Column:
    return F.concat(
        F.lit("Question: "),
        question,
        F.lit("\nAnswer choices: "),
        lettered(options, ":"),
        F.lit(".\n" + fv.STEP_INSTRUCTION),
    )


def from_template(template: str, question: Column, options: Column) -> Column:
    """Fill ``{prompt}``, then ``{options_text}``, wherever they stand by then."""
    with_question = F.replace(F.lit(template), F.lit("{prompt}"), question)
    return F.replace(with_question, F.lit("{options_text}"), lettered(options, ":"))

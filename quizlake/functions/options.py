"""Option lists: parsing, lettering, shape checks. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quizlake import fixed_values as fv

_SINGLE = r"'(?:[^'\\]|\\.)*'"
_DOUBLE = r'"(?:[^"\\]|\\.)*"'


def options_to_json(options: Column) -> Column:
    return F.to_json(options)


def options_from_json(text: Column) -> Column:
    """JSON text to ``array<string>``; anything malformed gives null."""
    return F.from_json(text, "array<string>")


def options_from_quotes(text: Column) -> Column:
    """Every non-empty double-quoted stretch; kept for comparison, see ``options_from_json``."""
    return F.regexp_extract_all(text, F.lit(fv.QUOTED_OPTION), 1)


def options_to_list_text(options: Column) -> Column:
    """``['a', "b's"]``: the list spelling found in exchanged CSV files."""

    def quoted(option: Column) -> Column:
        escaped = F.replace(option, F.lit("\\"), F.lit("\\\\"))
        for raw, spelled in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            escaped = F.replace(escaped, F.lit(raw), F.lit(spelled))
        plain = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
        wrapped = F.concat(F.lit('"'), escaped, F.lit('"'))
        return F.when(option.contains("'") & ~option.contains('"'), wrapped).otherwise(plain)

    return F.concat(F.lit("["), F.array_join(F.transform(options, quoted), ", "), F.lit("]"))


def options_from_list_text(text: Column) -> Column:
    """Inverse of ``options_to_list_text``; text that is no list gives null."""

    def unquoted(element: Column) -> Column:
        inner = F.substr(element, F.lit(2), F.length(element) - 2)
        # A backslash pair is set aside first so that it cannot combine with the next letter.
        inner = F.replace(inner, F.lit("\\\\"), F.lit("\u0000"))
        for spelled, raw in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\'", "'"), ('\\"', '"')):
            inner = F.replace(inner, F.lit(spelled), F.lit(raw))
        return F.replace(inner, F.lit("\u0000"), F.lit("\\"))

    elements = F.regexp_extract_all(text, F.lit(f"{_SINGLE}|{_DOUBLE}"), 0)
    is_list = text.startswith("[") & text.endswith("]")
    return F.when(is_list, F.transform(elements, unquoted))


def lettered(options: Column, separator: str = ": ") -> Column:
    """``A: x, B: y, ...`` with the given text between letter and option."""
    labelled = F.transform(
        options, lambda option, i: F.concat(F.char(F.lit(ord("A")) + i), F.lit(separator), option)
    )
    return F.array_join(labelled, ", ")


def comma_joined(options: Column) -> Column:
    return F.array_join(options, ", ")


def comma_spread(text: Column) -> Column:
    """Comma between every character: what joining an unparsed options text amounts to."""
    return F.array_join(F.split(text, ""), ", ")


def first_five(options: Column) -> Column:
    return F.array_join(F.slice(options, 1, fv.OPTION_COUNT), " ")


def option_of_letter(options: Column, letter: Column) -> Column:
    """Option text behind a letter; null where the letter points outside the list."""
    index = F.ascii(letter) - ord("A")
    return F.when(index >= 0, F.get(options, index))


def shape_problem(options: Column, letter: Column) -> Column:
    """Why an item cannot be used: ``bad_options``, ``option_count``, ``null_option``,
    ``bad_letter`` or ``ok``."""
    return (
        F.when(options.isNull(), "bad_options")
        .when(F.size(options) != fv.OPTION_COUNT, "option_count")
        .when(F.exists(options, lambda option: option.isNull()), "null_option")
        .when(letter.isNull() | ~letter.isin(fv.LETTERS), "bad_letter")
        .otherwise("ok")
    )

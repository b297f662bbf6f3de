"""Run names: building them from parameters and reading the parameters back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beside this: [kd_](lora|full)_finetune_<model>_<dataset><n>
# <model>-finetuned-<dataset>[-AM][-teacher][-AM]-<n>k[-r-<r>][-alpha-<alpha>]
_CAUSAL = (
    r"^(.+?)-finetuned-(.+?)((?:-AM|-teacher)*)-(\d+(?:\.\d+)?)k(?:-r-(\d+))?(?:-alpha-(\d+))?$"
)


def last_segment(path: Column) -> Column:
    """Last part of a path-like name, a trailing slash left aside."""
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def file_stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(last_segment(path), r"\.[^.]*$", "")


def seq2seq_run_name(
    kd: Column, method: Column, model: Column, dataset: Column, n_train: Column
) -> Column:
    return F.concat(
        F.when(kd, "kd_").otherwise(""),
        method,
        F.lit("_finetune_"),
        model,
        F.lit("_"),
        dataset,
        n_train.cast("string"),
    )


def causal_run_name(
    model: Column,
    dataset: Column,
    attention: Column,
    teacher: Column,
    n_train: Column,
    r: Column,
    alpha: Column,
    teacher_first: Column | bool = False,
) -> Column:
    """Name of a run on a causal model; null ``r`` or ``alpha`` leave their part out.

    Both orders of the two flags are in use; ``teacher_first`` writes ``-teacher-AM``.
    """
    flags = [F.when(attention, "-AM").otherwise(""), F.when(teacher, "-teacher").otherwise("")]
    first = F.lit(teacher_first) if isinstance(teacher_first, bool) else teacher_first
    thousands = F.regexp_replace((n_train / 1000).cast("decimal(18,3)").cast("string"), r"\.?0+$", "")
    return F.concat(
        model,
        F.lit("-finetuned-"),
        dataset,
        F.when(first, F.concat(*flags[::-1])).otherwise(F.concat(*flags)),
        F.lit("-"),
        thousands,
        F.lit("k"),
        F.coalesce(F.concat(F.lit("-r-"), r.cast("string")), F.lit("")),
        F.coalesce(F.concat(F.lit("-alpha-"), alpha.cast("string")), F.lit("")),
    )


def run_fields(name: Column, datasets: list[str] | None = None) -> Column:
    """Struct of (kd, method, base_model, dataset, n_train, layers, r, alpha) for either form.

    A name of neither form gives a struct of nulls. In the first form the data set is what stands
    behind the last underscore, without digits; where data sets are named otherwise, ``datasets``
    lists them and only those are found.
    """
    known = "[A-Za-z]+" if datasets is None else "|".join(sorted((f"\\Q{d}\\E" for d in datasets), key=len, reverse=True))
    small_form = rf"^(kd_)?(lora|full)_finetune_(.+?)_({known})(\d+)$"
    stem = F.regexp_replace(last_segment(name), r"_test$", "")

    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(stem, pattern, group), F.lit(""))

    seq2seq = stem.rlike(small_form)
    causal = stem.rlike(_CAUSAL)
    flags = F.regexp_extract(stem, _CAUSAL, 3)
    thousands = part(_CAUSAL, 4).try_cast("double")
    return F.struct(
        F.when(seq2seq, part(small_form, 1).isNotNull())
        .when(causal, flags.contains("-teacher"))
        .alias("kd"),
        F.when(seq2seq, part(small_form, 2)).when(causal, F.lit("lora")).alias("method"),
        F.when(seq2seq, part(small_form, 3)).when(causal, part(_CAUSAL, 1)).alias("base_model"),
        F.when(seq2seq, part(small_form, 4)).when(causal, part(_CAUSAL, 2)).alias("dataset"),
        F.when(seq2seq, part(small_form, 5).try_cast("bigint"))
        .when(causal, F.round(thousands * 1000).cast("bigint"))
        .alias("n_train"),
        F.when(causal & flags.contains("-AM"), "attention").when(causal, "all").alias("layers"),
        part(_CAUSAL, 5).try_cast("bigint").alias("r"),
        part(_CAUSAL, 6).try_cast("bigint").alias("alpha"),
    )

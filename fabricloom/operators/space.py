"""Design-space sweeps: axes, the full grid of options, requests, resuming, tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def axis(low: float, high: float, steps: int, whole: bool = False) -> Column:
    """Evenly spaced values, rounded to six places, or to whole numbers without repeats."""
    if steps == 1:
        values = F.array(F.lit(float(low)))
    else:
        values = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: low + i * ((high - low) / (steps - 1)))
    return F.array_distinct(F.transform(values, F.rint)) if whole else F.transform(values, lambda v: F.round(v, 6))


def grid(spark: SparkSession, axes: dict[str, Column], rows: DataFrame | None = None) -> DataFrame:
    """Every combination of the axes' values, a column each, in order of the axes, with its ordinal from 1; with rows, of each of
    them, whose columns axes may use.

    The ordinal is computed from the places on the axes, so no sort or single task is needed.
    """
    out = (spark.range(1).select() if rows is None else rows).select("*", F.lit(0).cast("bigint").alias("_o"))
    for name, values in axes.items():
        out = out.select("*", F.posexplode(values).alias("_p", name), F.size(values).alias("_n"))
        out = out.withColumn("_o", F.col("_o") * F.col("_n") + F.col("_p")).drop("_p", "_n")
    return out.withColumn("option", F.col("_o") + 1).drop("_o")


def option_name(ordinal: Column, total: int) -> Column:
    """The ordinal with leading zeros, three digits at least."""
    return F.lpad(ordinal.cast("string"), max(3, len(str(total))), "0")


def route(parameters: Column) -> Column:
    """A request from flat parameters: target: and dir: keys as maps without their prefix, pcaN in order, the rest."""
    def under(prefix: str) -> Column:
        some = F.map_filter(parameters, lambda k, v: F.startswith(k, F.lit(prefix)))
        return F.transform_keys(some, lambda k, v: F.substr(k, F.lit(len(prefix) + 1)))

    number = F.filter(F.map_keys(parameters), lambda k: F.rlike(k, F.lit("^pca[0-9]+$")))
    places = F.transform(number, lambda k: F.substr(k, F.lit(4)).cast("int"))
    longest = F.coalesce(F.array_max(places), F.lit(-1))
    pca = F.when(longest < 0, F.array().cast("array<double>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(longest, F.lit(0))), lambda i: F.coalesce(parameters[F.concat(F.lit("pca"), i.cast("string"))], F.lit(0.0)))
    )
    rest = F.map_filter(parameters, lambda k, v: ~F.rlike(k, F.lit("^(target:|dir:|pca[0-9]+$)")))
    return F.struct(under("target:").alias("targets"), under("dir:").alias("directions"), pca.alias("pca"), rest.alias("base"))


def resume(todo: DataFrame, log: DataFrame, key: str = "name") -> DataFrame:
    """Options that the log doesn't have yet; failed ones count as done."""
    return todo.join(log.select(key).distinct(), key, "left_anti")


def tables(parameters: DataFrame, objectives: list[DataFrame], key: str = "name") -> DataFrame:
    """Parameters with objectives of unlike columns, joined by name; a missing objective is null."""
    rows = objectives[0]
    for more in objectives[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return parameters.join(rows, key, "left")


def generate(options: DataFrame, model: Callable, schema: str) -> DataFrame:
    """Runs a model over options in batches: model takes and returns pandas frames; the schema has a column error.

    A batch that fails is run again option by option, and an option that fails alone gives a row with its parameters
    and the error, so that one option doesn't end the others.
    """
    import pandas as pd

    names = [x.split()[0] for x in schema.split(", ")]

    def one(option):
        try:
            return model(option)
        except Exception as e:  # any fault of a model is that option's result
            return option.assign(error=f"{type(e).__name__}: {e}").reindex(columns=names)

    def run(batches):
        for batch in batches:
            try:
                yield model(batch)
            except Exception:
                yield pd.concat([one(batch.iloc[k : k + 1]) for k in range(len(batch))])

    return options.mapInPandas(run, schema)

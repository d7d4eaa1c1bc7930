"""Count records, taxonomies, climatology records, run metrics and parameters in files."""

from __future__ import annotations

import glob
import json
import os
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

_SPECIES = re.compile(r"^\s*species\s*:\s*[\"']?([^\"'#\n]+?)[\"']?\s*(?:#.*)?$", re.M)
COUNTS = "species string, date date, count double, start timestamp, end timestamp"
CLIMATOLOGY = "species string, doy array<int>, min array<double>, max array<double>, mean array<double>, count_observations array<double>, quantile_levels array<int>, quantiles array<array<double>>, trektellen_species_id int, ratio array<array<double>>"
RUN = "species string, scalars map<string,double>, by_era array<map<string,string>>, per_year array<map<string,string>>"


def counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COUNTS).csv(path, header=True)


def write_counts(df: DataFrame, path: str) -> None:
    df.select("species", "date", "count", "start", "end").write.mode("overwrite").csv(path, header=True)


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """The taxonomy's columns as text, its numeric id null where it can't be read."""
    found = spark.read.csv(path, header=True)
    ids = [c for c in found.columns if c.endswith("_id")]
    return found.withColumns({c: F.expr(f"try_cast(`{c}` as int)") for c in ids}) if ids else found


def suffixed_join(left: DataFrame, right: DataFrame, same: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows that agree in the columns `same`, which come once, and in the pairs (left, right); other names that both have get _x and _y."""
    both = set(left.columns) & set(right.columns) - set(same)
    left = left.withColumnsRenamed({c: f"{c}_x" for c in both})
    right = right.withColumnsRenamed({c: f"{c}_y" for c in both})
    named = lambda c, end: c + end if c in both else c
    on = [left[c] == right[c] for c in same] + [left[named(a, "_x")] == right[named(b, "_y")] for a, b in pairs]
    return left.join(right, on).drop(*[right[c] for c in same])


def body_with_header(body: DataFrame, header: DataFrame) -> DataFrame:
    """Counted birds with the survey that they belong to."""
    return body.join(header, body["countid"] == header["id"])


def climatology(spark: SparkSession, path: str, species: str | None = None) -> DataFrame:
    """Climatology records; a species that isn't among them is an error that lists those that are."""
    found = spark.read.schema(CLIMATOLOGY).json(path, multiLine=True)
    if species is None:
        return found
    one = found.where(F.col("species") == species)
    if not one.limit(1).count():
        raise KeyError(f"no climatology of {species}; there are {sorted(r[0] for r in found.select('species').limit(1000).collect())}")
    return one


def write_json(df: DataFrame, path: str) -> int:
    """Rows as one JSON array, put in place whole or not at all; rows pass through the driver one by one."""
    n = 0

    def text() -> Iterator[str]:
        nonlocal n
        yield "["
        for row in df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
            yield ("," if n else "") + "\n" + row[0]
            n += 1
        yield "\n]\n"

    files.put(df.sparkSession, path, text())
    return n


def runs(spark: SparkSession, patterns: Iterable[str]) -> DataFrame:
    """species, run, metric and value of all runs' metric files; patterns without files are reported and skipped."""
    paths = []
    for p in patterns:
        if not (found := files.matching(spark, p)):
            print(f"no files match {p}")
        paths += found
    if not paths:
        return spark.createDataFrame([], "species string, run string, metric string, value double")
    rows = spark.read.schema(RUN).json(paths, multiLine=True).withColumn("run", F.input_file_name())
    return rows.select("species", "run", F.explode("scalars").alias("metric", "value"))


def write_run(path: str, species: str, scalars: dict, by_era: list, per_year: list) -> None:
    files.put(SparkSession.active(), path, [json.dumps({"species": species, "scalars": scalars, "by_era": by_era, "per_year": per_year})])


def write_predictions(df: DataFrame, path: str, run_date: str, species: str) -> None:
    """Predictions of a species and run date, replacing those of the same two alone."""
    rows = df.withColumn("species", F.lit(species.replace(" ", "_"))).withColumn("run_date", F.lit(run_date))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("species", "run_date").parquet(path)


def save_parameters(params: DataFrame, path: str) -> None:
    params.coalesce(1).write.mode("overwrite").parquet(path)


def latest_run(paths: Iterable[str]) -> str | None:
    """The path whose folder name holds the newest time stamp, as 2024-01-31_12-30-00; None if none has one."""
    stamp = re.compile(r"(\d{4}-\d{2}-\d{2})[_/](\d{2}-\d{2}-\d{2})")
    dated = [(m[1] + m[2], p) for p in paths if (m := stamp.search(p))]
    return max(dated)[1] if dated else None


def promote(sources: dict[str, str], target: str, dry_run: bool = False, force: bool = False) -> dict[str, str]:
    """Copies each species' model folder under target; what was done with each. An existing one stays unless forced."""
    spark, done = SparkSession.active(), {}
    for species, source in sources.items():
        to = f"{target.rstrip('/')}/{species.replace(' ', '_')}"
        if files.exists(spark, to) and not force:
            done[species] = "kept"
        elif dry_run:
            done[species] = "would copy"
        else:
            files.copy(spark, source, to)
            done[species] = "copied"
    return done


def species_of_experiments(folder: str) -> list[str]:
    """The species that experiment files name, each once, in order of name."""
    found = set()
    for path in sorted(glob.glob(f"{folder}/*.yaml")):
        with open(path) as f:
            found.update(_SPECIES.findall(f.read()))
    return sorted(found)


def season_of_data(path: str) -> tuple[int, int]:
    """The first and the last day of year that a data file's `doy` names, as a list on its line or below it."""
    with open(path) as f:
        found = re.search(r"^\s*doy\s*:\s*(?:\[([^\]]*)\]|((?:\s*-[^\n]*\n?)+))", f.read(), re.M)
    days = [int(x) for x in re.findall(r"\d+", found[1] or found[2])] if found else []
    if len(days) != 2 or not 1 <= days[0] <= days[1] <= 366:
        raise ValueError(f"{path} has no season")
    return days[0], days[1]


def experiments(folder: str) -> list[dict]:
    """Species, name, path and season of each experiment file under folder/experiment, the season from its own doy or that of folder/data.

    A file without a species is an error, as is one whose data file lacks a season.
    """
    found = []
    for path in sorted(glob.glob(f"{folder}/experiment/*.yaml")):
        with open(path) as f:
            text = f.read()
        named = _SPECIES.findall(text)
        if not named:
            raise ValueError(f"{path} names no species")
        data = re.search(r"^\s*-\s*override\s+/data\s*:\s*(\S+)", text, re.M)
        own = re.search(r"^\s+doy\s*:", text, re.M)
        season = season_of_data(path if own else f"{folder}/data/{data[1] if data else 'default'}.yaml")
        found.append({"species": named[0], "name": os.path.splitext(os.path.basename(path))[0], "path": path, "season": season})
    return found

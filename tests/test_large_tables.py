"""Steps that large tables pass through once: what their plans or jobs do, and that results stay."""

from pyspark.sql import functions as F

from tallywing.functions.time import clock_hours, coverage_mask
from tallywing.operators import explore


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_clock_hours_of_a_mask_are_worked_out_once(spark):
    t = spark.range(3).select("id", F.timestamp_seconds(F.col("id") * 3600 + 1800).alias("start"), F.timestamp_seconds(F.col("id") * 3600 + 9000).alias("end"))
    for exact in (False, True):
        mask = t.select(coverage_mask(clock_hours(F.col("start")), clock_hours(F.col("end")), exact).alias("mask"))
        assert plan(mask).count("hour(") == 2 and "sequence" not in plan(mask)
        assert [r.mask[:5] for r in mask.collect()] == [[0.5, 1.0, 0.5, 0.0, 0.0], [0.0, 0.5, 1.0, 0.5, 0.0], [0.0, 0.0, 0.5, 1.0, 0.5]]


def test_unwatched_hours_are_no_rows_of_day_coverage(spark):
    frame = spark.createDataFrame([(1, "a", [0.0, 0.5, 0.75]), (1, "a", [0.0, 0.25, 0.75]), (1, "b", [0.0]), (2, "b", None), (2, "c", [None, 1.0])], "species int, date string, mask array<double>")
    found = explore.day_coverage(frame)
    assert sorted(map(tuple, found.collect())) == [(1, "a", 1, 0.75), (1, "a", 2, 1.0), (2, "c", 1, 1.0)]
    below = plan(found).split("Aggregate", 1)[1]  # hours go before they are grouped, not after
    assert below.index("> 0.0") < below.index("Generate")


def test_day_segments_makes_the_mask_once(spark):
    t = spark.createDataFrame([(1, "a", 1, 2.0), (1, "a", 2, -1.0), (2, "b", 3, 22.5)], "species int, date string, row int, obs double")
    found = explore.day_segments(t.withColumn("mask", coverage_mask(F.col("obs") + 0.0, F.col("obs") + 0.75, exact=True)))
    assert sorted(map(tuple, found.collect())) == [(1, "a", 1, 2, 3, 2.0), (2, "b", 3, 22, 24, 22.5)]
    assert plan(found).count("AS mask") == plan(found).count("struct(start") == 1
    odd = spark.createDataFrame([(1, "a", 1, [None, None], 0.0), (1, "a", 2, None, 0.0), (1, "a", 3, [None, 1.0, None], 0.0), (1, "a", 4, [], 0.0)], "species int, date string, row int, mask array<double>, obs double")
    assert [(r.row, r.first_hour, r.last_hour) for r in explore.day_segments(odd).collect()] == [(3, 1, 2)]


def test_training_passes_over_what_its_rows_are_made_from_once(spark):
    from tallywing.operators import training

    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(60).select((F.col("id") % 2).cast("int").alias("species"), (1 + F.col("id") % 5).cast("double").alias("count"), F.lit(1.0).alias("exposure"), (F.col("id") % 7 == 0).alias("held"), (F.col("id") / 60).alias("x"))
    models = training.train(rows.mapInArrow(count, rows.schema), features=("x",), epochs=4)
    assert [r.epochs for r in models.collect()] == [4, 4] and made.value == 60


def test_token_files_tokenize_a_batch_at_once(monkeypatch):
    import pyarrow as pa
    import pyspark

    from tallywing.llm import token_files

    calls = []

    class Coder:
        def encode(self, texts, end):
            calls.append(len(texts))
            return [end] * len(texts), list(range(len(texts) + 1))

    monkeypatch.setattr(token_files, "encoder", lambda path: Coder())
    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["x" * (1 << 20)] * 6)], ["key", "text"])
    (found,) = token_files._coder("")([batch])
    assert calls == [6] and found.column("n_ids").to_pylist() == [6]


def test_workbook_counts_reads_orders_once_and_no_kinds(spark, small):
    import __spark_entry__ as entry

    assert "Join" not in plan(entry.queries()["workbook_counts"](spark, small))


def test_cells_without_kinds(spark):
    import pandas as pd

    from tallywing.plans.source_plans import workbook_of
    from tallywing.sources import workbooks

    rows = pd.DataFrame({"id": [1, 2], "at": [570.0, None]})
    contents = spark.createDataFrame([("a.xlsx", bytearray(workbook_of(rows, "counts", times=("at",))))], "path string, content binary")
    known = workbooks.cells(contents, "counts", kinds=False).where("row > 0").orderBy("row").collect()
    assert [(r.values, r.kinds) for r in known] == [({"id": "1", "at": "09:30:00"}, {}), ({"id": "2"}, {})]
    found, told = workbooks.parse(contents), workbooks.parse(contents, schema="id bigint, at string")
    assert found.schema == told.schema and sorted(map(repr, found.collect())) == sorted(map(repr, told.collect()))

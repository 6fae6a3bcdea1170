"""Documents of applications."""

from pyspark.sql import functions as F

from emberscope.operators import report


def test_sections_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    jobs = spark.range(1200).select((F.col("id") % 3).cast("string").alias("application_id"), F.col("id").alias("job_id"))
    notes = spark.createDataFrame([("0", "x"), (None, "y"), ("7", None)], "application_id string, note string")
    pages = report.application_documents({"jobs": jobs.mapInArrow(counted, jobs.schema), "notes": notes, "streaming": None}, page_items=150)
    rows = pages.select(
        "application_id", "page", F.try_variant_get("document", "$.jobs", "array<struct<job_id:bigint>>").alias("jobs"),
        F.try_variant_get("document", "$.notes", "array<struct<note:string>>").alias("notes"),
    ).collect()
    found = [(r.application_id, j.job_id) for r in rows for j in r.jobs or []]
    assert sorted(found) == sorted((str(i % 3), i) for i in range(1200))
    assert sorted((r.application_id, n.note) for r in rows for n in r.notes or []) == [("0", "x"), ("7", None)]
    assert all(len(r.jobs or []) < 300 for r in rows)
    assert seen.value == 1200

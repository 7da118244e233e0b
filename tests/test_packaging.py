import pyarrow as pa
from pyspark.sql import functions as F

from feedloom.packaging import BATCH_BYTES, ship


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "size": [batch.nbytes]})


def test_batches_for_python_are_small(spark):
    ship(spark)
    texts = spark.range(0, 9000, 1, 1).select(F.repeat(F.lit("word "), 800).alias("text"))  # 36 MB in one task, under Spark's 10,000 rows
    got = texts.mapInArrow(sizes, "rows long, size long").collect()
    assert sum(r.rows for r in got) == 9000
    assert max(r.size for r in got) < 2 * BATCH_BYTES

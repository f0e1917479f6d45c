"""Problem 4: frequency of every distinct value or term.

Method: a range-partitioned external sort of (field, value, record) and a run-length scan
of the sorted rows. The range keys include the record, so a value that half of all rows
hold is spread over as many partitions as it needs; rows of one value and record always
meet in one partition, which is what makes the distinct counts of the parts add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RARE_BELOW = 3
COMMON_ABOVE = 0.01
#: Bytes of the record and place columns, for each field, that one partition sorts.
SORT_BYTES = 32 << 20


def trimmed(c: Column) -> Column:
    """Lower case, without the characters other than letters and digits at both ends."""
    return F.regexp_replace(F.lower(c), r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$", "")


def despaced(c: Column) -> Column:
    """Lower case, without spaces at both ends."""
    return F.trim(F.lower(c))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of rows sorted by field, value, record and place.

    A run is one value's; within it, every change of the record is a distinct record and
    every change of the place an occurrence. Runs go on over batches: the last run and the
    last record are carried.
    """
    names = ["field", "value", "occurrences", "records"]
    held = None  # field, value, occurrences, records, last record, last place
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        field, value, rec, place = (batch.column(i) for i in range(4))
        ends = _changes(field, value)
        fresh_rec = pc.or_(ends, _changed(rec))
        fresh_occ = pc.or_(fresh_rec, pc.or_(_changed(place), pc.is_null(place)))
        starts = pc.indices_nonzero(ends).to_pylist()
        occ = pc.cumulative_sum(fresh_occ.cast(pa.int64())).to_numpy()
        recs = pc.cumulative_sum(fresh_rec.cast(pa.int64())).to_numpy()
        bounds = [*starts, n]
        out = []
        for k, a in enumerate(bounds[:-1]):
            z = bounds[k + 1]
            o, r = int(occ[z - 1] - (occ[a - 1] if a else 0)), int(recs[z - 1] - (recs[a - 1] if a else 0))
            if k == 0:
                f, v = field[0].as_py(), value[0].as_py()
                if held and held[:2] == (f, v):
                    same_rec = held[4] == rec[0].as_py()
                    same_place = same_rec and held[5] is not None and held[5] == place[0].as_py()
                    o, r = o + held[2] - same_place, r + held[3] - same_rec
                elif held:
                    out.append(held[:4])
                held = (f, v, o, r)
            else:
                out.append(held[:4])
                held = (field[a].as_py(), value[a].as_py(), o, r)
        held = (*held[:4], rec[n - 1].as_py(), place[n - 1].as_py())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.int64()))], names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(held, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names)


def _changed(a: pa.Array) -> pa.Array:
    """True at the first place and wherever the value differs from the one before."""
    if len(a) == 1:
        return pa.array([True])
    diff = pc.fill_null(pc.not_equal(a[1:], a[:-1]), True)
    return pa.concat_arrays([pa.array([True]), diff])


def _changes(*arrays: pa.Array) -> pa.Array:
    out = _changed(arrays[0])
    for a in arrays[1:]:
        out = pc.or_(out, _changed(a))
    return out


def frequencies(df: DataFrame, record: str, place: str | None, fields: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """(field, value, occurrences, records) of every distinct value of every field.

    fields: the name each value gets and the expression that normalises it. Null and empty
    values and null records don't count. Rows that agree in field, value, record and place
    are one occurrence (a row delivered twice); with a null place each row is one.
    partitions: of the sort; by default the session's, or one for every SORT_BYTES of the
    input's estimated size if that is more.
    """
    where = F.col(place).cast("long") if place else F.lit(None).cast("long")
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), c.alias("value")) for name, c in fields.items()])
    rows = df.where(F.col(record).isNotNull()).select(F.col(record).cast("long").alias("rec"), where.alias("place"), F.explode(pairs).alias("p"))
    rows = rows.select("p.field", "p.value", "rec", "place").where("value <> ''")
    keys = ["field", "value", "rec"]
    if partitions is None:  # the adaptive reader merges small partitions only where no number is given
        size = int(str(df.select(*{record, place or record})._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        asked = len(fields) * size // SORT_BYTES if size < 1 << 60 else 0  # a frame made on the driver or of an RDD has no estimate
        partitions = asked if asked > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    runs = ranged.sortWithinPartitions(*keys, "place").mapInArrow(_scan, "field string, value string, occurrences long, records long")
    return runs.groupBy("field", "value").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(counts: DataFrame, total: DataFrame, rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
    """Adds ``mark``: rare, common or null. total: one row and column, the number of records.

    A value is rare before it is common, should a tiny table make it both.
    """
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * total.scalar(), "common")
    return counts.withColumn("mark", mark)

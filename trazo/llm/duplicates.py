"""Problem 1: duplicates hidden by formatting differences.

Method: Merkle-style bottom-up hashing of nested records. Leaves are normalised and hashed,
the child digests of an unordered node are sorted before the node is hashed, records are
grouped by their root digest, and each group is confirmed by a comparison of the whole
normalised structures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trazo.session import durable

#: A group above this share of all rows, or above so many rows, is hot; of the latter there is at most one for every HOT_ROWS rows.
HOT_SHARE, HOT_ROWS = 1 / 500, 1_000_000


def normal_leaf(c: Column) -> Column:
    """The words of a text: longest runs of letters and digits, without regard to case, one blank between; null has none."""
    low = F.translate(F.replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), F.lit("\u00df"), F.lit("ss")), "\u017f\u03c2", "s\u03c3")
    return F.trim(F.regexp_replace(low, r"[^a-z0-9\p{L}\p{Nd}]+", " "))


def canonical(c: Column, kind: T.DataType, ordered: bool = False) -> Column:
    """The normalised structure of a value as one string.

    A struct's fields, an array's items and a map's entries are children. Children of an
    unordered node (every struct and map, arrays unless ``ordered``) are sorted. Lengths in
    front of the children keep different structures apart.
    """
    if isinstance(kind, T.StructType):
        kids = F.array(*[canonical(c[f.name], f.dataType, ordered) for f in kind.fields])
    elif isinstance(kind, T.ArrayType):
        kids = F.transform(F.coalesce(c, F.array().cast(kind)), lambda x: canonical(x, kind.elementType, ordered))
        if ordered:
            return F.concat(F.lit("l("), F.array_join(F.transform(kids, _framed), ""), F.lit(")"))
    elif isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        kids = F.transform(
            F.map_entries(F.coalesce(c, F.create_map().cast(kind))),
            lambda e: F.concat(F.lit("e("), _framed(canonical(e["key"], entry["key"].dataType, ordered)), _framed(canonical(e["value"], entry["value"].dataType, ordered)), F.lit(")")),
        )
    else:
        return normal_leaf(c)
    return F.concat(F.lit("n("), F.array_join(F.transform(F.array_sort(kids), _framed), ""), F.lit(")"))


def _framed(c: Column) -> Column:
    return F.concat(F.length(c).cast("string"), F.lit(":"), c)


def digest(c: Column, kind: T.DataType, ordered: bool = False) -> Column:
    """Merkle digest (16 bytes) of a value, from its leaves upwards; the shape is that of ``canonical``."""
    if isinstance(kind, T.StructType):
        kids = F.array(*[digest(c[f.name], f.dataType, ordered) for f in kind.fields])
    elif isinstance(kind, T.ArrayType):
        kids = F.transform(F.coalesce(c, F.array().cast(kind)), lambda x: digest(x, kind.elementType, ordered))
        if ordered:
            return _hash(F.concat(F.lit(b"l"), F.aggregate(kids, F.lit(b""), lambda a, x: F.concat(a, x))))
    elif isinstance(kind, T.MapType):
        kids = F.transform(
            F.map_entries(F.coalesce(c, F.create_map().cast(kind))),
            lambda e: _hash(F.concat(F.lit(b"e"), digest(e["key"], kind.keyType, ordered), digest(e["value"], kind.valueType, ordered))),
        )
    else:
        return _hash(normal_leaf(c).cast("binary"))
    if isinstance(kind, T.StructType) and len(kind.fields) == 2:  # no lambda, so it stays in generated code
        return _hash(F.concat(F.lit(b"n"), F.least(kids[0], kids[1]), F.greatest(kids[0], kids[1])))
    return _hash(F.concat(F.lit(b"n"), F.aggregate(F.array_sort(kids), F.lit(b""), lambda a, x: F.concat(a, x))))


def _hash(c: Column) -> Column:
    return F.unhex(F.md5(c))


def groups(df: DataFrame, id_col: str, fields: list[str], ordered: bool = False) -> DataFrame:
    """(id, rep, n_copies) of every record that has a copy, the record with the smallest id included.

    Two records are copies if their fields hold the same normalised values, in whichever
    field each stands. Rows with one id and one content count as one record; an id that
    comes with several contents is a record of each. Null ids are left out. Null, empty and
    blank texts are equal. Columns other than ``id_col`` and ``fields`` are never read, so
    their names can't clash.

    Groups are found and confirmed by aggregates that combine before the shuffle, so a
    group may hold any share of the rows. Only the join back of members to groups meets
    whole groups; hot groups take a broadcast there, of which there are few by definition:
    at most 1 / HOT_SHARE of up to 500 million rows, and one for every HOT_ROWS rows beyond.
    """
    nodes = _nodes(df, id_col, fields, ordered)
    found = nodes.groupBy("root").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.count("*").alias("rows"), F.min("whole").alias("lo"), F.max("whole").alias("hi")).where("rep < last")
    found = durable(found.select("root", "rep", "rows", (F.col("lo") == F.col("hi")).alias("same")))
    members = _join(nodes.select("id", "root"), found.where("same").select("root", "rep", "rows"), df.count()).distinct()
    if found.where("not same").isEmpty():
        return members
    # a digest shared by different structures: grouped again by the structures themselves
    odd = nodes.join(found.where("not same").select("root"), "root", "left_semi").select("id", "whole").distinct()
    again = odd.join(odd.groupBy("whole").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "whole").select("id", "rep")
    return members.unionByName(again)


def _nodes(df: DataFrame, id_col: str, fields: list[str], ordered: bool) -> DataFrame:
    """(id, root, whole) of every row: the id, the root digest and the whole normalised structure."""
    rows = df.where(F.col(id_col).isNotNull())
    if all(isinstance(df.schema[f].dataType, T.StringType) for f in fields):
        # leaves as columns of their own, each normalised once a row
        names = [f"n{i}" for i in range(len(fields))]
        rows = rows.select(F.col(id_col).cast("long").alias("id"), *[normal_leaf(F.col(f)).alias(n) for f, n in zip(fields, names)])
        kids = [_hash(F.col(n).cast("binary")) for n in names]
        if len(names) == 2:
            low, high = F.least("n0", "n1"), F.greatest("n0", "n1")
            return rows.select("id", _hash(F.concat(F.lit(b"n"), F.least(*kids), F.greatest(*kids))).alias("root"), F.concat(_framed(low), _framed(high)).alias("whole"))
        sort = F.array_sort
        root = _hash(F.concat(F.lit(b"n"), F.aggregate(sort(F.array(*kids)), F.lit(b""), lambda a, x: F.concat(a, x))))
        return rows.select("id", root.alias("root"), F.array_join(F.transform(sort(F.array(*names)), _framed), "").alias("whole"))
    record = F.struct(*[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])
    kind = T.StructType([T.StructField(f"f{i}", df.schema[f].dataType) for i, f in enumerate(fields)])
    keyed = rows.select(F.col(id_col).cast("long").alias("id"), record.alias("r"))
    return keyed.select("id", digest(F.col("r"), kind, ordered).alias("root"), canonical(F.col("r"), kind, ordered).alias("whole"))


def copies(members: DataFrame) -> DataFrame:
    """(rep, n_copies): one row per collapsed record, from the rows of ``groups``."""
    return members.groupBy("rep").agg(F.count("*").alias("n_copies"))


def _join(rows: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """Rows with their group's rep; hot groups are broadcast, the others, of HOT_ROWS rows at most, shuffled."""
    most = max(1000, min(int(total * HOT_SHARE), HOT_ROWS))
    hot = found.where(F.col("rows") > most).select("root", "rep")
    if hot.isEmpty():
        return rows.join(found.select("root", "rep"), "root").select("id", "rep")
    cold = found.where(F.col("rows") <= most).select("root", F.col("rep").alias("cold_rep"))
    marked = rows.join(F.broadcast(hot), "root", "left")
    # rows of hot groups are done; they go on under keys of their own
    marked = marked.select("id", "rep", F.when(F.col("rep").isNull(), F.col("root")).otherwise(_hash(F.col("id").cast("string").cast("binary"))).alias("root"))
    both = marked.join(cold, "root", "left")
    return both.select("id", F.coalesce("rep", "cold_rep").alias("rep")).where("rep is not null")


def found_pairs(tables: list[tuple[str, DataFrame, str, list[str]]]) -> DataFrame:
    """(tbl, id_a, id_b): every copy with the smallest id of its group."""
    out = None
    for tbl, df, key, fields in tables:
        one = groups(df, key, fields).where("id <> rep").select(F.lit(tbl).alias("tbl"), F.col("rep").alias("id_a"), F.col("id").alias("id_b"))
        out = one if out is None else out.unionByName(one)
    return out


def collapse(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, n_copies): the table's records collapsed, singles with 1."""
    members = groups(df, id_col, fields)
    ids = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
    counts = copies(members)
    rest = members.where("id <> rep").select("id").distinct()
    return ids.join(rest, "id", "left_anti").join(counts.withColumnRenamed("rep", "id"), "id", "left").select("id", F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))

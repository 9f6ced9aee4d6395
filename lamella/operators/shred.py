"""Shredding of nested records into leaf columns with repetition and definition levels, and assembly from them.

A shredded row is (row_id, column, place, r, d, value): place holds the index of each repeated ancestor or self, r is the
depth at which the row repeats, d counts the optional and repeated fields of the path that are there, and value is text
(binary as hexadecimal digits). One leaf alone, with its own type, comes from shred_leaf().

Shredding needs no shuffle and reads its input once, not once a leaf. Assembly shuffles once, by row_id, and not at all where
rows are dealt so already; every later step groups by more columns than that, so it stays where it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions.convert import pack_interval, unpack_interval
from lamella.operators.schema import REPEATED, Field, Schema

SHREDDED = "row_id {row}, column string, place array<int>, r int, d int, value string"


def shred_leaf(df: DataFrame, schema: Schema, path: str | list[str], row_id: str = "row_id") -> DataFrame:
    """(row_id, place, r, d, value) of one leaf, value in the leaf's Spark type. df must conform to the schema."""
    branch = schema.find_branch(path)
    leaf = branch[-1]
    if leaf.is_group:
        raise ValueError(f"{'.'.join(leaf.path)} is a group")
    at, level = F.col(f"`{branch[0].name}`"), 0
    now = df.select(F.col(f"`{row_id}`").alias("_row"), at.alias("_v"), F.lit(0).alias("_d"))
    places: list[str] = []
    for i, field in enumerate(branch):
        if i:
            now = now.withColumn("_v", F.col("_v")[field.name])
        if field.repetition == REPEATED:
            level += 1
            kept = ["_row", "_d", *places]
            now = now.select(*kept, F.posexplode_outer("_v").alias(f"_p{level}", "_v"))
            now = now.withColumn(f"_p{level}", F.coalesce(f"_p{level}", F.lit(0)))
            places.append(f"_p{level}")
        if field.d_max > (branch[i - 1].d_max if i else 0):
            now = now.withColumn("_d", F.when(F.col("_v").isNotNull(), field.d_max).otherwise(F.col("_d")))
    r = F.lit(0)
    for k, p in enumerate(places, 1):
        r = F.when(F.col(p) > 0, k).otherwise(r)
    place = F.array(*places) if places else F.array().cast("array<int>")
    return now.select(
        F.col("_row").alias("row_id"), place.alias("place"), r.cast("int").alias("r"), F.col("_d").cast("int").alias("d"),
        F.col("_v").alias("value"),
    )


def _text(leaf: Field, value: Column) -> Column:
    kind = leaf.element()
    if leaf.type == "INTERVAL":
        return F.hex(pack_interval(value))
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("string")
    return value.cast("string")


def _value(leaf: Field, text: Column) -> Column:
    kind = leaf.element()
    if leaf.type == "INTERVAL":
        return unpack_interval(F.unhex(text))
    if isinstance(kind, T.BinaryType):
        return F.unhex(text)
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(text.cast("long"))
    return text.cast(kind)


def shred(df: DataFrame, schema: Schema, row_id: str = "row_id") -> DataFrame:
    """All leaves of df, which must conform to the schema and hold a unique row_id.

    df is read once for all leaves: a record is taken once for its leaves outside of arrays, and once for each repeated
    field, whose elements then give a row for each leaf that repeats with it.
    """
    repeated = [f for f in schema.field_list if f.repetition == REPEATED]
    number = {f.path: k for k, f in enumerate(repeated)}
    roots = {f.name: k for k, f in enumerate(schema.roots)}

    def lists(path: tuple[str, ...]) -> list[int]:
        """Numbers of the repeated fields of a path, itself included."""
        return [number[path[:n]] for n in range(1, len(path) + 1) if path[:n] in number]

    def value(path: tuple[str, ...]) -> Column:
        """A field's value in a row, where arrays on its path are taken apart."""
        if path in number:
            return F.col(f"_e{number[path]}")
        return value(path[:-1])[path[-1]] if len(path) > 1 else F.col(f"_f{roots[path[0]]}")

    def entry(leaf: Field) -> Column:
        d, r, above = F.lit(0), F.lit(0), 0
        for field in schema.find_branch(leaf.path):
            if field.d_max > above:
                d, above = F.when(value(field.path).isNotNull(), field.d_max).otherwise(d), field.d_max
        places = [F.col(f"_p{k}") for k in lists(leaf.path)]
        for k, p in enumerate(places, 1):
            r = F.when(p > 0, k).otherwise(r)
        place = F.array(*places) if places else F.array().cast("array<int>")
        return F.struct(
            F.lit(".".join(leaf.path)).alias("column"), place.alias("place"), r.alias("r"), d.alias("d"), _text(leaf, value(leaf.path)).alias("value")
        )

    entries: dict[int, list[Column]] = {}
    for leaf in schema.leaves:
        entries.setdefault(max(lists(leaf.path), default=-1), []).append(entry(leaf))
    now = df.select(F.col(f"`{row_id}`").alias("row_id"), *[F.col(f"`{name}`").alias(f"_f{k}") for name, k in roots.items()])
    now = now.withColumn("_part", F.explode(F.array(*map(F.lit, entries))))
    for k, field in enumerate(repeated):
        inside = [n for n in entries if n >= 0 and k in lists(repeated[n].path)]  # parts that take this array apart
        items = value(field.path[:-1])[field.name] if len(field.path) > 1 else F.col(f"_f{roots[field.name]}")
        now = now.select("*", F.posexplode_outer(F.when(F.col("_part").isin(inside), items)).alias(f"_p{k}", f"_e{k}"))
        now = now.withColumn(f"_p{k}", F.coalesce(f"_p{k}", F.lit(0)))
    return now.select("row_id", F.inline(F.coalesce(*[F.when(F.col("_part") == n, F.array(*found)) for n, found in entries.items()])))


def with_place(levels: DataFrame, order: str) -> DataFrame:
    """levels (row_id, column, r, d, value and order) with place from r alone, as a file without indices has it.

    Index i counts the rows at level i since the last one below it.
    """
    most = levels.agg(F.max("r")).first()[0] or 0
    of_column, now = W.partitionBy("row_id", "column").orderBy(order), levels
    for level in range(1, most + 1):
        group = F.sum(F.when(F.col("r") < level, 1).otherwise(0)).over(of_column)
        inside = W.partitionBy("row_id", "column", f"_g{level}").orderBy(order)
        now = now.withColumn(f"_g{level}", group).withColumn(f"_i{level}", F.sum(F.when(F.col("r") == level, 1).otherwise(0)).over(inside))
    place = F.array(*[F.col(f"_i{k}") for k in range(1, most + 1)]).cast("array<int>")
    return now.withColumn("place", place).drop(*[f"_{c}{k}" for k in range(1, most + 1) for c in "gi"], order)


def materialize(shredded: DataFrame, schema: Schema) -> DataFrame:
    """row_id and the records that shred() took apart; fields without a value are NULL."""
    leaves = schema.leaves
    number = {leaf.path: j for j, leaf in enumerate(leaves)}
    deepest = max((leaf.r_max for leaf in leaves), default=0)
    keys = [f"_i{k}" for k in range(1, deepest + 1)]
    leaf_of = F.coalesce(*[F.when(F.col("column") == ".".join(leaf.path), j) for j, leaf in enumerate(leaves)])
    # rows stay narrow until their aggregate: one shuffle and one sort take all of them
    now = shredded.select(
        "row_id", leaf_of.alias("_leaf"), "d", "value",
        *[F.coalesce(F.get("place", F.lit(k)), F.lit(0)).alias(key) for k, key in enumerate(keys)],
    ).repartition("row_id")
    mine = [F.col("_leaf") == j for j in range(len(leaves))]
    levels = [F.when(m, F.col("d")) for m in mine]
    values = [_value(leaf, F.when(m & (F.col("d") >= leaf.d_max), F.col("value"))) for m, leaf in zip(mine, leaves, strict=True)]

    def below(field: Field) -> list[int]:
        return [number[f.path] for f in field.walk() if not f.is_group]

    def reached(field: Field) -> Column:
        """Whether the field is there: some leaf below reaches its level."""
        return F.coalesce(F.greatest(*[F.col(f"d{j}") for j in below(field)], F.lit(-1)), F.lit(-1)) >= field.d_max

    def built(field: Field) -> Column:
        """A field's value where its repeated descendants, and itself if repeated, are arrays already."""
        if field.repetition == REPEATED:
            return F.col(f"a{'_'.join(map(str, below(field)))}")
        return one(field)

    def one(field: Field) -> Column:
        if not field.is_group:
            return F.col(f"v{number[field.path]}")
        inner = F.struct(*[built(c).alias(c.name) for c in field.children])
        return F.when(reached(field), inner)

    repeated = [f for f in schema.field_list if f.repetition == REPEATED]
    for level in range(deepest, -1, -1):
        # one row for each element of this level; then its repeated fields are gathered into their parents' rows
        carried = [f for f in repeated if f.r_max == level + 1]
        outer = [f"a{'_'.join(map(str, below(f)))}" for f in carried]
        flat = [j for j, leaf in enumerate(leaves) if leaf.r_max <= level]
        now = now.groupBy("row_id", *keys[:level]).agg(
            *[F.max(levels[j]).alias(f"d{j}") for j in range(len(leaves))],
            *[F.first(values[j], ignorenulls=True).alias(f"v{j}") for j in flat],
            *([] if level == deepest else [
                F.sort_array(F.collect_list(F.when(F.col(f"_{a}_is"), F.struct(F.col("_at"), F.col(f"_{a}").alias("x"))))).alias(a)
                for a in outer
            ]),
        )
        levels, values = ([F.col(f"{c}{j}") for j in range(len(leaves))] for c in "dv")
        if level < deepest:
            now = now.withColumns({a: F.when(F.size(a) > 0, F.col(a)["x"]) for a in outer})
        if level:
            here = [f for f in repeated if f.r_max == level]
            kept = {j for j, leaf in enumerate(leaves) if leaf.r_max < level}
            now = now.select(
                "row_id", *keys[: level - 1], F.col(keys[level - 1]).alias("_at"),
                *[f"d{j}" for j in range(len(leaves))], *[f"v{j}" for j in sorted(kept)],
                *[reached(f).alias(f"_a{'_'.join(map(str, below(f)))}_is") for f in here],
                *[one(f).alias(f"_a{'_'.join(map(str, below(f)))}") for f in here],
            )
    return now.select("row_id", *[built(f).alias(f.name) for f in schema.roots])

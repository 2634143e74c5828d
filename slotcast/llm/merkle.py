"""A Merkle manifest of a dataset: a hash tree per group, and one over the groups."""

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotcast.sources.storage import materialize

FANOUT = 16
#: Levels of the tree within a partition, which so holds ``FANOUT ** LEVELS`` leaves.
LEVELS = 3
_PROOF = "array<struct<before:string,after:string>>"
_PROOF_TYPE = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def leaf(*fields: Column) -> Column:
    """SHA-256 of the fields: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    return F.sha2(F.concat(*[_field(f.cast("string")) for f in fields]), 256)


def _field(text: Column) -> Column:
    long = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.when(text.isNull(), F.lit("-")).otherwise(long)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(
        proof, start, lambda h, x: F.sha2(F.concat(x["before"], h, x["after"]), 256)
    )


def proof_digest(proof: Column) -> Column:
    """SHA-256 of a proof's digests from the leaf's level upwards, left to right."""
    parts = F.flatten(F.transform(proof, lambda x: F.array(x["before"], x["after"])))
    return F.sha2(F.array_join(parts, ""), 256)


def _height(count: Column, fanout: int) -> Column:
    """Levels above the leaves of a tree."""
    powers, power = [], 1
    while power < 1 << 62:
        powers.append(power)
        power *= fanout
    return sum(((count > p).cast("int") for p in powers[1:]), (count > 1).cast("int"))


def _ranged(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with ``g``, the number of their group, and ``pos``, their place in it; the groups.

    Leaves are dealt by range and numbered in each partition. Only one row per partition and
    group takes part in finding the numbers that precede.
    """
    order = [F.col(c).asc_nulls_first() for c in ("group", "key", "leaf", "tie")]
    dealt = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.drop("tie").withColumns(
        {"pid": F.spark_partition_id(), "at": F.monotonically_increasing_id()}
    )
    dealt = materialize(dealt, "ranged-leaves")
    parts = dealt.groupBy("pid", "group").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    parts = materialize(parts, "leaf-counts")
    by_group = Window.partitionBy("group")
    before = by_group.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns(
        {
            "before": F.coalesce(F.sum("n").over(before), F.lit(0)),
            "leaves": F.sum("n").over(by_group),
            "opens": F.col("pid") == F.min("pid").over(by_group),
        }
    )
    # A group is numbered in the partition where it begins.
    opened = parts.filter("opens")
    mine = F.row_number().over(Window.partitionBy("pid").orderBy(F.col("group").asc_nulls_first()))
    earlier = F.sum("m").over(Window.orderBy("pid")) - F.col("m")  # a row per partition
    upto = opened.groupBy("pid").agg(F.count("*").alias("m")).select("pid", earlier.alias("base"))
    groups = opened.withColumn("own", mine).join(upto, "pid")
    groups = groups.select("group", (F.col("base") + F.col("own") - 1).alias("g"), "leaves")
    groups = materialize(groups, "groups")
    same = F.col("p.group").eqNullSafe(F.col("q.group"))
    found = parts.alias("p").join(groups.alias("q"), same).select(
        "pid", "p.group", "g", "q.leaves", (F.col("before") - F.col("first")).alias("shift")
    )
    same = (F.col("x.pid") == F.col("y.pid")) & F.col("x.group").eqNullSafe(F.col("y.group"))
    rows = dealt.alias("x").join(found.alias("y"), same).select(
        "x.*", "g", "leaves", (F.col("at") + F.col("shift")).alias("pos")
    )
    return rows.drop("pid", "at"), groups


def _levels(leaves: list[str], fanout: int, height: int) -> list[list[str]]:
    """The nodes of a block on each level."""
    out = [leaves]
    for _ in range(height):
        below = out[-1]
        runs = ("".join(below[i : i + fanout]) for i in range(0, len(below), fanout))
        out.append([sha256(r.encode()).hexdigest() for r in runs])
    return out


def _block_roots(rows: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The root of each partition's leaves."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        height = min(levels, table["height"][0].as_py())
        top = _levels(table["leaf"].to_pylist(), fanout, height)[-1]
        return table.slice(0, 1).select(["g", "block", "leaves"]).append_column("root", pa.array(top))

    return rows.select("g", "block", "pos", "leaves", "height", "leaf").groupBy("g", "block").applyInArrow(
        run, "g long, block long, leaves long, root string"
    )


def _swapped(state: DataFrame, rounds: str, fanout: int) -> DataFrame:
    """One round: aligned groups of partitions swap roots, and each hashes the node above.

    A row of ``state`` is a partition. Its subtree is child ``d`` of node ``up`` and belongs to
    ``lanes`` partitions that all know its root; it's number ``lane`` of them. Each of them swaps
    roots with the partitions of the same lane in the other children. Where a child has fewer
    lanes than the widest one, ``widest``, its partitions serve several. No partition gets more
    than one root per child, and no ancestor is sent down. Rows where ``rounds`` is
    false are passed on as they are.
    """
    more = F.expr(rounds)
    active = state.filter(more)
    served = F.explode(F.sequence(F.col("lane"), F.col("widest") - 1, F.col("lanes")))
    sent = active.select("t", "up", served.alias("lane"), "d", "root")
    got = sent.groupBy("t", "up", "lane").agg(
        F.array_sort(F.collect_list(F.struct("d", "root"))).alias("children")
    )
    roots = F.transform("children", lambda x: x["root"])
    here = F.array_position(F.transform("children", lambda x: x["d"]), F.col("d")).cast("int")
    met = active.join(got, ["t", "up", "lane"]).withColumns({"roots": roots, "here": here})
    step = F.struct(
        F.array_join(F.slice("roots", 1, F.col("here") - 1), "").alias("before"),
        F.array_join(F.expr("slice(roots, here + 1, size(roots))"), "").alias("after"),
    )
    met = met.withColumn("above", F.concat("above", F.array(step)))
    met = met.withColumn("root", F.sha2(F.array_join("roots", ""), 256))
    return met.select(*state.columns).unionByName(state.filter(~more))


def _up_to_groups(state: DataFrame, rounds: int, fanout: int, levels: int) -> DataFrame:
    """Every partition's proof up to its group's root."""
    for r in range(rounds):
        span = fanout**r
        node = F.expr(f"block div {span}")
        up = F.expr(f"block div {span * fanout}")
        state = state.withColumns(
            {
                "t": F.col("g"),
                "up": up,
                "d": node % fanout,
                "lane": F.col("block") % span,
                "lanes": F.least(F.lit(span), F.col("blocks") - node * span),
                "widest": F.least(F.lit(span), F.col("blocks") - up * span * fanout),
            }
        )
        state = materialize(_swapped(state, f"height > {levels + r}", fanout), "partitions")
    return state


def _up_to_root(state: DataFrame, groups: DataFrame, fanout: int) -> DataFrame:
    """Every partition's proof from its group's root to the dataset's."""
    nodes = groups.select(F.col("g").alias("node"), F.col("blocks").alias("lanes"))
    left = groups.count()
    state = state.withColumns({"node": F.col("g"), "lane": F.col("block"), "t": F.lit(0).cast("long")})
    while left > 1:
        nodes = nodes.withColumn("up", F.expr(f"node div {fanout}"))
        family = Window.partitionBy("up")
        before = family.orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        nodes = materialize(
            nodes.withColumns(
                {
                    "widest": F.max("lanes").over(family),
                    "shift": F.coalesce(F.sum("lanes").over(before), F.lit(0)),
                }
            ),
            "nodes",
        )
        known = ["up", "lanes", "widest", "shift", "d"]
        state = state.drop(*known).join(nodes, "node").withColumn("d", F.col("node") % fanout)
        state = _swapped(state, "true", fanout).withColumns(
            {"lane": F.col("lane") + F.col("shift"), "node": F.col("up")}
        )
        state = materialize(state, "partitions")
        nodes = nodes.groupBy(F.col("up").alias("node")).agg(F.sum("lanes").alias("lanes"))
        left = -(-left // fanout)
    return state


def _proofs(rows: DataFrame, state: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Each leaf with its proof: the levels of its partition, then what the partition acquired."""
    kept = ["key", "group", "leaf", *[c for c in rows.columns if c.startswith("x_")]]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept)
    schema += f", subroot string, root string, proof {_PROOF}"

    def run(table: pa.Table, partition: pa.Table) -> pa.Table:
        if not len(table):
            return pa.Table.from_batches([], pa.schema([*plain, *more]))
        table = table.sort_by("pos")
        own = partition.to_pylist()[0]
        height = min(levels, own["height"])
        nodes = _levels(table["leaf"].to_pylist(), fanout, height)
        upper = [(x["before"], x["after"]) for x in own["above"]]
        before, after = [], []
        for i in range(len(table)):
            for level in nodes[:height]:
                first = i - i % fanout
                before.append("".join(level[first:i]))
                after.append("".join(level[i + 1 : first + fanout]))
                i //= fanout
            before += [x[0] for x in upper]
            after += [x[1] for x in upper]
        step = height + len(upper)
        steps = pa.StructArray.from_arrays(
            [pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"]
        )
        bounds = pa.array(range(0, step * len(table) + 1, step) if step else [0] * (len(table) + 1), pa.int32())
        proof = pa.ListArray.from_arrays(bounds, steps)
        out = table.select(kept)
        for name in ("subroot", "root"):
            out = out.append_column(name, pa.array([own[name]] * len(table), pa.string()))
        return out.append_column(pa.field("proof", _PROOF_TYPE), proof)

    from pyspark.sql.pandas.types import to_arrow_type

    plain = [pa.field(f.name, to_arrow_type(f.dataType)) for f in rows.select(*kept).schema]
    more = [pa.field("subroot", pa.string()), pa.field("root", pa.string()), pa.field("proof", _PROOF_TYPE)]
    found = state.select("g", "block", "height", "subroot", "root", "above")
    return rows.groupBy("g", "block").cogroup(found.groupBy("g", "block")).applyInArrow(run, schema)


def manifest(
    docs: DataFrame,
    columns: list[str],
    key: str = "doc_id",
    group: str = "source",
    carry: dict[str, Column] | None = None,
    fanout: int = FANOUT,
    levels: int = LEVELS,
) -> DataFrame:
    """Every row's leaf, its group's and the dataset's root, and the proof between them.

    A leaf is the hash of a row's ``columns``. The leaves of a group stand in the order of their
    keys; while several nodes remain, each ``fanout`` of them become one, the hash of
    their digests. The roots of the groups, in the order of the group's name, null first, form one
    more tree in the same way.

    A partition holds ``fanout ** levels`` leaves in a row. Above these a butterfly exchange: in
    each round aligned groups of ``fanout`` partitions swap the roots of their subtrees and
    all of them hash the node above, so after the last round every partition has the upper part of
    its leaves' proofs and nothing goes down the tree. A round moves one digest per
    partition and child, however large a group is. Where a child has fewer partitions than its
    siblings, as at the end of a group or between groups, its partitions serve several.

    Null fields are hashed as ``-``. Rows with equal keys stand in the order of their leaves, null
    keys first; equal rows have equal leaves and proofs of their own. A table of one group has
    the group's root as its root, a group of one row the row's leaf. An empty table gives no
    rows. Other columns aren't read; those that ``carry`` derives from a row go with it.

    Returns ``key``, ``group``, ``leaf``, ``subroot``, ``root``, ``proof`` (per level the digests
    before and after the own one) and the carried columns.
    """
    extra = {f"x_{name}": column for name, column in (carry or {}).items()}
    leaves = docs.select(
        F.col(key).alias("key"),
        F.col(group).alias("group"),
        leaf(*[F.col(c) for c in columns]).alias("leaf"),
        *[column.alias(name) for name, column in extra.items()],
        F.monotonically_increasing_id().alias("tie"),
    )
    rows, groups = _ranged(materialize(leaves, "leaves"))
    size = fanout**levels
    blocks = F.expr(f"(leaves + {size - 1}) div {size}")
    height = _height(F.col("leaves"), fanout)
    rows = rows.withColumns({"block": F.expr(f"pos div {size}"), "height": height})
    groups = groups.withColumns({"blocks": blocks, "height": height})
    highest = groups.agg(F.max("height")).first()[0] or 0
    state = _block_roots(rows, fanout, levels).withColumns(
        {"blocks": blocks, "height": height, "above": F.array().cast(_PROOF)}
    )
    state = materialize(state, "partitions")
    state = _up_to_groups(state, highest - levels, fanout, levels)
    state = _up_to_root(state.withColumn("subroot", F.col("root")), groups, fanout)
    out = _proofs(rows, state, fanout, levels)
    return out.select(
        F.col("key").alias(key),
        F.col("group").alias(group),
        "leaf",
        "subroot",
        "root",
        "proof",
        *[F.col(f"x_{name}").alias(name) for name in carry or {}],
    )

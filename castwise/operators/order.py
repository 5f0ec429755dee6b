"""Row numbers, ranks, running sums and scans over the order of a whole table or of groups of any length, which no task sees whole.

Rows are dealt out by ranges of their keys and sorted; what comes before a partition is the
prefix sum of one row per partition, which the driver adds up.  Names beginning with _o_
are used inside.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.pin import written

_PART = "shiftright(_o_at, 33)"


def _ranged(rows: DataFrame, order: list, spread: bool) -> DataFrame:
    """The rows, written, with _o_at: partition << 33 | place within it, ascending with the order."""
    if spread:
        rows = written(rows.withColumn("_o_tie", F.lit(0).cast("long"))).withColumn("_o_tie", F.monotonically_increasing_id())
        order = [*order, "_o_tie"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_o_at", F.monotonically_increasing_id())
    return written(ranged.drop("_o_tie"))


def _before(ranged: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """_o_part and, for each name, the sum over all partitions before (one row per partition)."""
    found = sorted(tuple(r) for r in ranged.groupBy(F.expr(_PART).alias("_o_part")).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items())).collect())
    totals = zip(*([0, *list(accumulate(r[i + 1] for r in found))[:-1]] for i in range(len(sums))), strict=True) if found else []
    kinds = dict(ranged.select(*(F.sum(c).alias(n) for n, c in sums.items())).dtypes)
    rows = [(r[0], *t) for r, t in zip(found, totals, strict=True)]
    if any(k == "double" for k in kinds.values()):
        rows = [(r[0], *(float(v) if kinds[n] == "double" else v for n, v in zip(sums, r[1:], strict=True))) for r in rows]
    return F.broadcast(ranged.sparkSession.createDataFrame(rows, "_o_part long, " + ", ".join(f"`{n}` {k}" for n, k in kinds.items())))


def numbered(rows: DataFrame, *order: str | Column, name: str = "place", spread: bool = False) -> DataFrame:
    """Adds ``name``: each row's number from 1 in the whole table's order.

    Rows that tie are numbered in any order.  ``spread``: rows may tie in great numbers, so
    they are written and dealt to several partitions by where they lie.
    """
    ranged = _ranged(rows, list(order), spread)
    before = _before(ranged, {"_o_n": F.lit(1).cast("long")})
    out = ranged.join(before, F.expr(_PART) == F.col("_o_part"))
    return out.withColumn(name, F.col("_o_n") + F.col("_o_at").bitwiseAND((1 << 33) - 1) + 1).drop("_o_n", "_o_part", "_o_at")


def running(rows: DataFrame, order: list[str | Column], sums: dict[str, Column | str], spread: bool = False) -> DataFrame:
    """Adds, for each name, the sum of its column over all rows before this one (null counts as 0)."""
    sums = {n: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)) for n, c in sums.items()}
    ranged = _ranged(rows, order, spread)
    before = _before(ranged, {f"_o_{n}": c for n, c in sums.items()})
    inside = Window.partitionBy("_o_part").orderBy("_o_at").rowsBetween(Window.unboundedPreceding, -1)  # one range, as the sort left it
    out = ranged.join(before, F.expr(_PART) == F.col("_o_part"))
    out = out.select("*", *((F.col(f"_o_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in sums.items()))
    return out.drop("_o_at", "_o_part", *(f"_o_{n}" for n in sums))


def ranked(rows: DataFrame, keys: list[str], name: str = "rank", dense: bool = False, order: list[Column] | None = None) -> DataFrame:
    """Adds ``name``: the rank of a row's keys (equal keys, nulls among them, share it) from 1, with gaps unless ``dense``.

    Only distinct keys are put in order, so great numbers of equal rows don't meet; order: columns over keys, ascending by default.
    """
    known = rows.groupBy(*keys).agg(F.count("*").alias("_o_rows"))
    order = order or [F.col(k) for k in keys]
    known = numbered(known, *order, name="_o_rank") if dense else running(known, order, {"_o_rank": "_o_rows"}).withColumn("_o_rank", F.col("_o_rank") + 1)
    known = known.select(*(F.col(k).alias(f"_o_k{i}") for i, k in enumerate(keys)), "_o_rank")
    same = [F.col(k).eqNullSafe(F.col(f"_o_k{i}")) for i, k in enumerate(keys)]
    joined = rows.join(known, same)
    return joined.withColumn(name, F.col("_o_rank").cast("long")).drop("_o_rank", *(f"_o_k{i}" for i in range(len(keys))))


_BEFORE = (Window.unboundedPreceding, -1)


def _local(kind: str, column, up, down) -> Column:
    if kind == "sum":
        return F.coalesce(F.sum(column).over(up.rowsBetween(*_BEFORE)), F.lit(0))
    return F.last(column, ignorenulls=True).over((up if kind == "last" else down).rowsBetween(*_BEFORE))


def scanned(rows: DataFrame, by: list[str], order: list[str], wanted: dict[str, tuple[str, str | Column]], long: bool = False) -> DataFrame:
    """Adds, for each name, what its kind tells of a column over the rows of the same group in order.

    sum: of the rows before; last, next: the last value before, the first after that isn't
    null; lag, lead: the value of the row before, after.

    ``long``: groups may be as long as the table.  Rows are then dealt out by ranges of (by, order) and
    each chunk is scanned by itself.  Only a chunk's first and last group can reach beyond it, so
    one row per chunk is folded by the driver and what comes in from other chunks is added.
    """
    wanted = {n: (k, F.col(c) if isinstance(c, str) else c) for n, (k, c) in wanted.items()}
    if not long:
        group = Window.partitionBy(*by)
        up, down = group.orderBy(*order), group.orderBy(*(F.col(c).desc() for c in order))
        beside = {"lag": lambda c: F.lag(c).over(up), "lead": lambda c: F.lead(c).over(up)}
        return rows.select("*", *((beside[k](c) if k in beside else _local(k, c, up, down)).alias(n) for n, (k, c) in wanted.items()))
    # a neighbour's value is the nearest struct, which is never null
    beside = {"lag": "last", "lead": "next"}
    told = {f"_o_v{i}": (beside.get(k, k), F.struct(c.alias("v")) if k in beside else c) for i, (k, c) in enumerate(wanted.values())}
    chunks = _ranged(rows, [*by, *order], spread=False).withColumn("_o_part", F.expr(_PART))
    group = Window.partitionBy("_o_part", *by)
    up, down = group.orderBy("_o_at"), group.orderBy(F.desc("_o_at"))
    known = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("_o_at"))), "next": lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("_o_at")))}
    each = chunks.groupBy("_o_part", *by).agg(F.min("_o_at").alias("_o_a"), F.max("_o_at").alias("_o_b"), *(known[k](c).alias(n) for n, (k, c) in told.items()))
    kept = F.struct(*(F.col(c).alias(f"_o_k{i}") for i, c in enumerate(by)), *told)
    ends = sorted(each.groupBy("_o_part").agg(F.min_by(kept, "_o_a").alias("first"), F.max_by(kept, "_o_b").alias("final")).collect())
    coming = _carried(ends, {n: k for n, (k, _) in told.items()}, len(by))
    kinds = dict(each.select(*told).dtypes)
    table = F.broadcast(rows.sparkSession.createDataFrame(coming, ", ".join(["_o_p long", "_o_forward boolean", *(f"_o_k{i} {dict(rows.dtypes)[c]}" for i, c in enumerate(by)), *(f"_c{n} {k}" for n, k in kinds.items())])))
    out = chunks.select("*", *(_local(k, c, up, down).alias(n) for n, (k, c) in told.items()))
    for forward in (True, False):
        names = [n for n, (k, _) in told.items() if (k != "next") == forward]
        if not names:
            continue
        some = table.where(F.col("_o_forward") == forward).select("_o_p", *(f"_o_k{i}" for i in range(len(by))), *(f"_c{n}" for n in names))
        same = [F.col("_o_part") == F.col("_o_p"), *(F.col(c).eqNullSafe(F.col(f"_o_k{i}")) for i, c in enumerate(by))]
        out = out.join(some, same, "left")
        for n in names:
            carried = F.col(f"_c{n}")
            out = out.withColumn(n, F.col(n) + F.coalesce(carried, F.lit(0)) if told[n][0] == "sum" else F.coalesce(n, carried))
        out = out.drop(*some.columns)
    final = [(F.col(t)["v"] if k in beside else F.col(t)).alias(n) for t, (n, (k, _)) in zip(told, wanted.items(), strict=True)]
    return out.select(*rows.columns, *final)


def _carried(ends: list, kinds: dict[str, str], keys: int) -> list[tuple]:
    """(part, forward, key, values that reach the part's first group from before, or its last group from after)."""
    out = []
    for forward in (True, False):
        carry, key = {}, None
        for part, first, final in ends if forward else reversed(ends):
            near, far = (first, final) if forward else (final, first)
            if key is not None and tuple(near)[:keys] == key:
                out.append((part, forward, *key, *(carry.get(n) for n in kinds)))
            through = key is not None and tuple(near)[:keys] == key and tuple(far)[:keys] == key
            own = far.asDict()
            new = {}
            for n, kind in kinds.items():
                if kind == "sum":
                    new[n] = own[n] + (carry.get(n) or 0 if through else 0)
                else:
                    new[n] = own[n] if own[n] is not None else carry.get(n) if through else None
            carry, key = new, tuple(far)[:keys]
    return out

"""Running totals that do not depend on any one key fitting into one task.

A plain window keyed by account would sort a whole account in one task, and one bank account may
hold a third of the ledger. Here the order is cut into cells on several levels, for example day, block of
documents, document with block of lines. Totals of the finest cells are added up level by level; on each level
the cells of one upper cell get a prefix sum, so a window never holds more than the parts of one cell. A row adds the prefix sums of
its cells and the running sum inside its finest cell. There is one plan for every size.

The cutting expressions must be monotone in the order: a row in an earlier cell must come first. They are plain
functions of the row, so a recomputed task always cuts alike. Missing values are cells like any other: cells
are structs, which compare and join with nulls inside. Totals of one level are shuffled once, by the upper cells, for their prefix sums and for the
level above.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How values combine along the order: the aggregate, and joining an offset to it.
_HOW = {
    "sum": (F.sum, lambda parts: reduce(lambda a, b: a + F.coalesce(b, F.lit(0)), parts[1:], F.coalesce(parts[0], F.lit(0)))),
    "max": (F.max, lambda parts: F.greatest(*parts)),
    "min": (F.min, lambda parts: F.least(*parts)),
}


Measure = Column | tuple[Column, Column]


def _levels(coarse: dict[str, Column], fine: dict[str, Column] | None) -> list[dict[str, Column]]:
    return [coarse, *({n: e} for n, e in (fine or {}).items())]


def _places(keys: list[str], levels: list[dict[str, Column]]) -> dict[str, Column]:
    """A row's key and its cell on every level. Cells are never null themselves, but hold nulls."""
    key = {"_k": F.struct(*keys) if keys else F.lit(0)}
    return key | {f"_l{i}": F.struct(*[e.alias(n) for n, e in level.items()]) for i, level in enumerate(levels)}


def _early(rows: DataFrame, keys: list[str], measures: dict[str, Measure], carried: Column) -> DataFrame:
    """What the carried rows of each key add up to."""
    parts = {c: e for n, m in measures.items() for c, e in ({f"_p_{n}": m[0], f"_n_{n}": m[1]} if isinstance(m, tuple) else {f"_m_{n}": m}).items()}
    return rows.filter(carried).withColumns(_places(keys, []) | parts).groupBy("_k").agg(*[F.sum(c).alias(c) for c in parts])


def openings(rows: DataFrame, keys: list[str], measure: tuple[Column, Column], name: str, coarse: dict[str, Column],
             fine: dict[str, Column] | None, carried: Column) -> DataFrame:
    """Keys, ``plus`` and ``minus`` of the carried rows of each key that has any.

    They are the same totals that ``running_totals`` puts ahead of the first cells for this measure, so both cost one aggregation of the rows,
    however these are cut (``coarse``, ``fine``).
    """
    early = _early(rows, keys, {name: measure}, carried)
    return early.select("_k.*", F.col(f"_p_{name}").alias("plus"), F.col(f"_n_{name}").alias("minus"))


def running_totals(
    rows: DataFrame,
    keys: list[str],
    order: list[Column],
    measures: dict[str, Measure],
    coarse: dict[str, Column],
    fine: dict[str, Column] | None = None,
    descending: tuple[str, ...] = (),
    how: str = "sum",
    inclusive: bool = True,
    carried: Column | None = None,
    whole: bool = False,
) -> DataFrame:
    """Add one running total per entry of ``measures``, per ``keys`` along ``order``.

    ``coarse`` is the first level of cells, each entry of ``fine`` a further level inside the one before; it may use any order
    prefix. Keys and cells may be null. ``descending`` names the cells that run from the largest to the smallest value.
    ``how`` may also be ``max`` or ``min``; without ``inclusive`` a row's own value is left out. Rows that are ``carried`` come ahead of all
    others of their key as its opening: they count in the totals of the others and are not returned. A measure may be
    a pair (plus, minus) of columns. ``whole`` says that the caller goes on with every column of the rows (names with a leading underscore aside); then
    totals and rows share one shuffle.
    """
    fold, combine = _HOW[how]
    levels = _levels(coarse, fine)
    cells, sums = [f"_l{i}" for i in range(len(levels))], [f"_m_{n}" for n in measures]
    places = _places(keys, levels)
    own = {s: m[0] - m[1] if isinstance(m, tuple) else m for s, m in zip(sums, measures.values())}
    shown = rows if carried is None else rows.filter(~F.coalesce(carried, F.lit(False)))
    if whole:  # dealt out once, without the cells as columns, for totals and rows alike
        shown = shown.repartition(*[c for n, c in places.items() if keys or n != "_k"])
    tagged = shown.withColumns(places | own)
    read = [F.xxhash64(*[c for c in rows.columns if not c.startswith("_")])] if whole else []
    totals, before = _summed(tagged, ["_k", *cells], sums, fold, read), []
    for i in reversed(range(len(levels))):
        upper = ["_k", *cells[:i]]
        if carried is not None and not i:  # ahead of all cells
            early = _early(rows, keys, measures, carried)
            value = {s: F.col(f"_p_{n}") - F.col(f"_n_{n}") if isinstance(m, tuple) else F.col(s) for s, (n, m) in zip(sums, measures.items())}
            totals = totals.unionByName(early.select("_k", F.lit(None).cast(totals.schema[cells[0]].dataType).alias(cells[0]), *[v.alias(s) for s, v in value.items()]))
        along = [F.col(cells[i]).isNotNull()] if carried is not None and not i else []
        along += [p.desc() if n in descending else p.asc() for n, p in ((n, F.col(cells[i]).getField(n)) for n in levels[i])]
        w = Window.partitionBy(*upper).orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select(*upper, cells[i], *sums).repartition(*upper)  # also once, for the offsets and the level above
        before.append(totals.select(*upper, cells[i], *[fold(s).over(w).alias(f"_o{i}{s}") for s in sums]))
        if i:
            totals = _summed(totals, upper, sums, fold, [F.xxhash64(cells[i])])
    offsets = before.pop()
    for i in range(1, len(levels)):
        offsets = before.pop().join(offsets, ["_k", *cells[:i]])
    w = Window.partitionBy("_k", *cells).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    # Rows that lie in place by cell stay there, whatever the planner takes for small.
    done = tagged.join(offsets.hint("merge") if whole else offsets, ["_k", *cells]).withColumns({
        n: combine([*[F.col(f"_o{i}{s}") for i in range(len(levels))], fold(s).over(w)]) for n, s in zip(measures, sums)})
    return done.select(*rows.columns, *measures)


def _summed(rows: DataFrame, by: list[str], sums: list[str], fold, read: list[Column]) -> DataFrame:
    """Totals by cell. They also read the columns of ``read``, so that they share an exchange with what needs these."""
    out = rows.groupBy(*by).agg(*[fold(s).alias(s) for s in sums], *[F.bit_xor(c).alias("_used") for c in read])
    return out.filter("_used IS NOT NULL").drop("_used") if read else out


def block(column: str, size: int = 65_536) -> Column:
    """A block number that grows with a numeric column."""
    return F.floor(F.col(column) / F.lit(size)).cast("long")


def documents(move: str = "move_id", line: str = "id") -> dict[str, Column]:
    """Levels for an order by document and line: blocks of documents, then documents with blocks of their lines."""
    return {"documents": block(move, 4096), "lines": F.struct(F.col(move).alias("move"), block(line).alias("lines"))}


def magnitude(column: str) -> Column:
    """A coarse cell of a numeric column: grows with it, a few hundred values over any range."""
    v = F.col(column).cast("double")
    return (F.signum(v) * F.floor(F.log2(1 + F.abs(v)) * 16)).cast("int")


def dense_ranks(values: DataFrame, value: str, name: str) -> DataFrame:
    """Each value that is not null once, with its place ``name`` (from 1) among them in ascending order."""
    known = values.filter(F.col(value).isNotNull()).select(value).distinct()
    return scan_totals(known, {"value": F.col(value)}, F.lit(1).cast("long"), name)


def row_numbers(rows: DataFrame, name: str, order: list[Column], coarse: dict[str, Column],
                fine: dict[str, Column] | None = None, descending: tuple[str, ...] = (), keys: list[str] | None = None) -> DataFrame:
    """Global row numbers without sorting the whole input in one task."""
    return running_totals(rows, keys or [], order, {name: F.lit(1).cast("long")}, coarse, fine, descending)


def document_numbers(rows: DataFrame, name: str, when: str, move: str, line: str) -> DataFrame:
    """Global row numbers of rows that lie by document, from the last ``when``, ``move`` and ``line`` to the first; ``move`` is not null.

    Only documents are put in order. Each with its count goes there as one row, gets the number of rows ahead of it, and comes back to head its rows
    in a running sum; the rows themselves stay where they are, or move once if they do not lie by ``move`` yet. A document is sorted in one task.
    """
    rows = rows.repartition(move)
    heads = rows.groupBy(move, when).agg(F.count(F.lit(1)).alias("lines"), used(rows)).filter("_used IS NOT NULL").drop("_used")
    heads = running_totals(heads, [], [F.col(when).desc(), F.col(move).desc()], {name: F.col("lines")}, {"day": F.to_date(when)},
                           {"time": F.col(when), "documents": block(move)}, descending=("day", "time", "documents"), inclusive=False, whole=True)
    # The other columns of a row are one value there, which a head lacks.
    packed = rows.select(move, when, line, F.lit(1).cast("long").alias(name), F.struct(*[c for c in rows.columns if c not in (move, when, line)]).alias("_row"))
    both = packed.unionByName(heads.select(move, when, name).repartition(move), allowMissingColumns=True)
    w = Window.partitionBy(move, when).orderBy(F.col("_row").isNotNull(), F.col(line).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.sum(name).over(w)).filter("_row IS NOT NULL").select(move, when, line, "_row.*", name).select(*rows.columns, name)


def used(rows: DataFrame) -> Column:
    """An aggregate that reads every column.

    A side calculation over an aggregated table takes part in the same exchange as the table itself only if it reads the same columns; else Spark prunes it and
    computes the table once more.
    """
    return F.bit_xor(F.xxhash64(*rows.columns)).alias("_used")


def scan_totals(rows: DataFrame, order: dict[str, Column], measure: Column, name: str, pieces: int = 64, drawn: int = 4096) -> DataFrame:
    """Adds the running total of ``measure`` over the whole table, along ``order`` (ascending; it should tell all rows apart).

    A prefix scan over ranges: bounds come from ``drawn`` rows with the smallest hashes, which are the same whenever a task is run again; each range
    is added up, gets the total of the ranges before it, and is passed through once in order. Only bounds and range totals, ``pieces``
    numbers each, are known to all tasks.
    """
    tagged = rows.withColumn("_o", F.struct(*[e.alias(n) for n, e in order.items()]))
    some = tagged.orderBy(F.xxhash64("_o"), "_o").limit(drawn).agg(F.sort_array(F.collect_list("_o")).alias("o"), used(rows))
    cuts = F.transform(F.array(*[F.lit(i) for i in range(1, pieces)]).cast("array<int>"), lambda i: F.get("o", F.floor(i * F.size("o") / pieces).cast("int")))
    bounds = some.select(F.struct(cuts.alias("cuts"), "_used")).scalar()["cuts"]
    pieced = tagged.withColumn("_cuts", bounds).withColumns({"_piece": F.size(F.filter("_cuts", lambda b: b <= F.col("_o"))), "_m": measure}).drop("_cuts")
    totals = pieced.groupBy("_piece").agg(F.sum("_m").alias("t"), used(rows))
    known = totals.agg(F.struct(F.collect_list(F.struct(F.col("_piece").alias("p"), "t")).alias("all"), F.bit_xor("_used"))).scalar()["all"]
    kind = totals.schema["t"].dataType
    before = F.aggregate(F.filter("_known", lambda x: x["p"] < F.col("_piece")), F.lit(0).cast(kind), lambda a, x: (a + F.coalesce(x["t"], F.lit(0))).cast(kind))
    w = Window.partitionBy("_piece").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    return pieced.withColumn("_run", F.sum("_m").over(w)).withColumn("_known", known).withColumn(name, F.coalesce("_run", F.lit(0)) + before).select(*rows.columns, name)


def range_sums(facts: DataFrame, ranges: DataFrame, keys: list[str], range_id: str) -> DataFrame:
    """Sum of ``facts.amount`` over the dates ``start`` to ``end`` of each range, per key.

    ``facts`` has the keys, ``date`` and ``amount``; ``ranges`` has ``range_id``, the keys, ``start`` and
    ``end``. Each range becomes two marks on the time line of its key, at its end and at the day before
    its start; the answer is the difference of the running totals there. No pair of fact and range is
    ever formed, so wide ranges cost the same as narrow ones.
    """
    daily = facts.groupBy(*keys, "date").agg(F.sum("amount").cast("decimal(28,2)").alias("amount")).select(
        *keys, "date", F.lit(0).alias("_mark"), F.lit(0).cast("long").alias("_range"), "amount")
    zero = F.lit(0).cast("decimal(28,2)")
    ends = ranges.filter(F.col("start") <= F.col("end")).select(*keys, F.col(range_id).alias("_range"), F.explode(F.array(
        F.struct(F.col("end").alias("date"), F.lit(1).alias("_mark")),
        F.struct(F.date_sub("start", 1).alias("date"), F.lit(-1).alias("_mark")))).alias("m"))
    marks = ends.select(*keys, "m.date", "m._mark", "_range", zero.alias("amount"))
    order = [F.col("date"), F.abs("_mark"), F.col("_range"), F.col("_mark")]
    run = running_totals(daily.unionByName(marks), keys, order, {"_total": F.col("amount")}, {"day": F.col("date")},
                         {"kind": F.abs("_mark"), "ranges": block("_range")})
    return run.filter("_mark <> 0").groupBy(F.col("_range").alias(range_id)).agg(
        F.sum(F.col("_total") * F.col("_mark")).cast("decimal(28,2)").alias("amount"))

"""Vehicle registers: CSV imports, JSON feeds, keyed upsert and insert."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.prefix import block, running_totals
from ledgerlake.functions.workspace import written
from ledgerlake.sources.bank import with_place

# Accepted headings per field, in order of preference.
ALIASES = {
    "car_id": ["name", "car_id", "vehicle"],
    "vin_sn": ["vin", "vin_sn", "vin_no", "chassis"],
    "title_en": ["title_en", "plate_no", "plate"],
}
FIELDS = list(ALIASES)
FEED_ITEM = "struct<car_id:string,VIN:string,year:string,make:string,model:string,trim:string>"


def read_vehicle_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    return spark.read.csv(path, header=header)


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def normalise_vehicles(raw: DataFrame, header: bool = True) -> DataFrame:
    """The three register fields of a CSV import, blank rows dropped.

    Headings are matched trimmed and in lower case; without headings the first three columns count.
    """
    if header:
        known = {c.strip().lower(): c for c in raw.columns}
        picked = {f: [_filled(F.col(f"`{known[a]}`")) for a in names if a in known] for f, names in ALIASES.items()}
    else:
        picked = {f: [_filled(F.col(f"`{c}`"))] for f, c in zip(FIELDS, raw.columns)}
    values = {f: F.coalesce(*cs) if cs else F.lit(None).cast("string") for f, cs in picked.items()}
    out = raw.select(*[values.get(f, F.lit(None).cast("string")).alias(f) for f in FIELDS])
    return out.filter(F.coalesce(*FIELDS).isNotNull())


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Feed documents as (value, file, split, row), one JSON document a line; the last three are in file order."""
    return with_place(spark.read.text(path)).filter(F.trim("value") != "")


def _feed_items() -> Column:
    text = F.col("value")
    listed = F.from_json(text, f"array<{FEED_ITEM}>")
    wrapped = F.from_json(text, f"struct<body:array<{FEED_ITEM}>>")["body"]
    return F.when(F.ltrim(text).startswith("["), listed).otherwise(wrapped)


def feed_rejects(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Feed documents that hold no list of vehicles, and entries without a VIN, with the reason."""
    items = documents.select(*keep, "value", _feed_items().alias("_items"))
    bad = items.filter(F.col("_items").isNull()).select(*keep, F.lit(None).cast("int").alias("position"), "value", F.lit("no list of vehicles").alias("reject_reason"))
    entries = items.select(*keep, F.posexplode("_items").alias("position", "v")).filter(F.coalesce(F.col("v.VIN"), F.lit("")) == "")
    return bad.unionByName(entries.select(*keep, "position", F.to_json("v").alias("value"), F.lit("VIN missing").alias("reject_reason")))


def parse_feed(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Vehicles of JSON feed documents, which are a list or hold one under ``body``."""
    rows = documents.select(*keep, F.posexplode(_feed_items()).alias("position", "v")).filter(~F.col("v.VIN").isNull() & (F.col("v.VIN") != ""))
    parts = F.array(*[F.col(f"v.{c}") for c in ("year", "make", "model", "trim")])
    title = F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " ")
    return rows.select(*keep, "position", F.coalesce("v.car_id", F.lit("")).alias("car_id"), F.col("v.VIN").alias("vin_sn"), title.alias("title_en"))


def first_per_vin(vehicles: DataFrame, order: list[str]) -> DataFrame:
    """The first record of each VIN in the given order."""
    rest = [c for c in vehicles.columns if c != "vin_sn"]
    best = vehicles.groupBy("vin_sn").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select("vin_sn", "r.*")


def new_vehicles(vehicles: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """First records whose VIN is not registered yet."""
    return first_per_vin(vehicles, order).join(existing.select("vin_sn"), "vin_sn", "left_anti").select(*FIELDS)


_ALWAYS = -(2**62)  # before every record


def _numbered(born: int, number: Column) -> Column:
    """A register row: those from before the import by their number, created ones after them by the record that created them."""
    return F.struct(F.lit(born).alias("born"), number.cast("long").alias("n")).alias("row")


def _spans(changes: DataFrame) -> DataFrame:
    """Each value (row, value, since) with the record that replaces it on its row (``until``, null if none does)."""
    return running_totals(changes, ["row"], [F.col("since").desc()], {"until": F.col("since")}, {"far": block("since", 1 << 24)},
                          {"near": block("since", 1 << 10)}, descending=("far", "near"), how="min", inclusive=False)


def _dyadic(first: Column, last: Column) -> Column:
    """The pieces (level, number) of whole powers of two that make up ``first`` to ``last``, both not negative; about two a level."""
    level = F.when(first == last, 0).otherwise(F.length(F.bin(first.bitwiseXOR(last))) - 1)
    middle = F.when(first == last, last + 1).otherwise(F.call_function("shiftleft", F.call_function("shiftright", last, level), level))
    left, right = middle - first, last - middle + 1
    levels = F.sequence(F.lit(0), level)
    bit = lambda n, k: F.call_function("shiftright", n, k).bitwiseAND(F.lit(1)) == 1
    above = lambda n, k: F.call_function("shiftright", n, k)
    piece = lambda k, start: F.struct(k.alias("level"), above(start, k).alias("number"))
    whole = lambda n, k: F.call_function("shiftleft", above(n, k), k)
    return F.concat(F.transform(F.filter(levels, lambda k: bit(left, k)), lambda k: piece(k, middle - whole(left, k))),
                    F.transform(F.filter(levels, lambda k: bit(right, k)), lambda k: piece(k, middle + whole(right, k + 1))))


def holders(spans: DataFrame, asks: DataFrame) -> DataFrame:
    """For each ask (value, at) the smallest ``row`` that holds the value then, null if none does.

    ``spans`` has row, value, since and until (null: for good); a value is held between the two, not at them. Values held from or
    to the end are running minima in either direction; for the rest, spans are cut into dyadic pieces and asks meet
    the pieces above them, so no window or group holds all spans or asks of a value.
    """
    nothing = F.lit(None).cast(spans.schema["row"].dataType)

    def met(some: DataFrame, at: str, descending: bool) -> DataFrame:
        rows = some.select("value", F.col(at).alias("at"), "row", F.lit(False).alias("asks")).unionByName(
            asks.select("value", "at", nothing.alias("row"), F.lit(True).alias("asks")))
        cells = {"far": block("at", 1 << 24)}, {"near": block("at", 1 << 10)}
        order = [F.col("at").desc() if descending else F.col("at").asc(), F.col("asks").desc()]
        run = running_totals(rows, ["value"], order, {"found": F.col("row")}, *cells, descending=("far", "near") if descending else (), how="min")
        return run.filter("asks").select("value", "at", F.col("found").alias("row"))

    from_start, to_end = F.col("since") == _ALWAYS, F.col("until").isNull()
    origin = asks.agg(F.min("at")).scalar()
    between = spans.filter(~from_start & ~to_end).select("row", "value", (F.greatest(F.col("since") + 1, origin) - origin).alias("first"),
                                                         (F.col("until") - 1 - origin).alias("last")).filter("first <= last")
    pieces = between.select("row", "value", F.explode(_dyadic(F.col("first"), F.col("last"))).alias("p"))
    least = pieces.groupBy("value", "p.level", "p.number").agg(F.min("row").alias("row"))
    levels = F.coalesce(pieces.agg(F.max("p.level")).scalar(), F.lit(0))
    climbing = asks.join(between.select("value").distinct(), "value", "left_semi").select("value", "at", F.explode(F.sequence(F.lit(0), levels)).alias("level"))
    climbing = climbing.withColumn("number", F.call_function("shiftright", F.col("at") - origin, F.col("level")))
    inner = climbing.join(least, ["value", "level", "number"]).select("value", "at", "row")
    both = met(spans.filter(to_end), "since", False).unionByName(met(spans.filter(from_start & ~to_end), "until", True)).unionByName(inner)
    return both.groupBy("value", "at").agg(F.min("row").alias("row"))


def _resolved(spans: DataFrame, asks: DataFrame) -> DataFrame:
    """The row that each ask finds; the first one of a value that finds none creates it, and the row holds the value from then on."""
    found = written(holders(spans, asks), "upsert-found")
    new = found.filter(F.col("row").isNull()).groupBy("value").agg(F.min("at").alias("_born"))
    created = F.when(F.col("_born") <= F.col("at"), _numbered(1, F.col("_born")))
    return found.join(new, "value", "left").select("value", "at", F.least("row", created).alias("row"))


def upsert_vehicles(existing: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Register after an import, with the action taken for each row and the number of records that it took.

    Records apply one after another in ``order`` (distinct whole numbers): each is matched by its VIN, without one by its title, without both
    by its car number, against the register as earlier records have left it; of several rows the one registered first counts. Filled
    fields overwrite; a record that finds no row creates one. Records without any key are left out.

    The chain of records needs no loop, but some tables written on the way (see ``workspace``). A row's VIN never changes, so a record with a VIN finds its row without regard to the
    others. Only such records change titles, so then all titles are known over time, and with them the rows of the records with
    a title; then the same holds for car numbers.
    """
    filled = [F.nullif(F.col(f), F.lit("")).alias(f) for f in FIELDS]
    records = written(incoming.select(F.col(order).cast("long").alias("at"), *filled).filter(F.coalesce(*FIELDS).isNotNull()), "upsert-records")
    known = existing.select(_numbered(0, F.col("id")), F.lit(_ALWAYS).alias("since"), *filled)

    by_vin, rest = records.filter(F.col("vin_sn").isNotNull()), records.filter(F.col("vin_sn").isNull())
    first_row = known.filter(F.col("vin_sn").isNotNull()).groupBy("vin_sn").agg(F.min("row").alias("_old"))
    first_record = by_vin.groupBy("vin_sn").agg(F.min("at").alias("_at"))
    events = by_vin.join(first_record, "vin_sn").join(first_row, "vin_sn", "left").select(
        F.coalesce("_old", _numbered(1, F.col("_at"))).alias("row"), "at", *FIELDS)
    for field in ("title_en", "car_id"):
        events = written(events, "upsert-events")  # read several times by each step that follows
        asks = rest.filter(F.col(field).isNotNull())
        rest = rest.filter(F.col(field).isNull())
        history = known.select("row", "since", F.col(field).alias("value")).unionByName(events.select("row", F.col("at").alias("since"), F.col(field).alias("value")))
        spans = written(_spans(written(history.filter(F.col("value").isNotNull()), "upsert-history")), "upsert-spans")
        target = _resolved(spans, written(asks.select(F.col(field).alias("value"), "at"), "upsert-asks"))
        events = events.unionByName(asks.join(target.select("at", "row"), "at").select("row", "at", *FIELDS))

    applied = existing.select(_numbered(0, F.col("id")), F.lit(_ALWAYS).alias("at"), *FIELDS, F.lit(0).alias("n")).unionByName(events.withColumn("n", F.lit(1)))
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("at"))).alias(f) for f in FIELDS]
    rows = applied.groupBy("row").agg(*last, F.sum("n").alias("records"))
    action = F.when(F.col("row.born") == 1, "created").when(F.col("records") > 0, "updated").otherwise("kept")
    return rows.select(F.when(F.col("row.born") == 0, F.col("row.n")).alias("id"), *FIELDS, action.alias("action"), "records")


def upsert_counts(register: DataFrame) -> DataFrame:
    """How many records of an upsert created and updated a row, and how many rows it kept as they were, zero counts included."""
    born = F.count_if(F.col("action") == "created")
    counts = F.array(*[F.struct(F.lit(a).alias("action"), F.col(a).alias("n")) for a in ("created", "updated", "kept")])
    return register.agg(born.alias("created"), (F.coalesce(F.sum("records"), F.lit(0)) - born).alias("updated"),
                        F.count_if(F.col("action") == "kept").alias("kept")).select(F.explode(counts).alias("c")).select("c.*")


def insert_vehicles(existing: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Records to insert, and those refused with the reason."""
    missing = reduce(lambda a, f: a.when(F.coalesce(F.col(f), F.lit("")) == "", f"{f} is required"), FIELDS, F.when(F.lit(False), ""))
    rows = incoming.select(*FIELDS, order).withColumn("reject_reason", missing)
    valid = rows.filter(F.col("reject_reason").isNull())
    known = existing.groupBy("vin_sn").agg(F.lit(True).alias("_known"))
    first = valid.groupBy("vin_sn").agg(F.min(order).alias("_first"))
    checked = valid.join(known, "vin_sn", "left").join(first, "vin_sn").withColumn(
        "reject_reason", F.when(F.col("_known") | (F.col(order) != F.col("_first")), "VIN already exists"))
    columns = [*FIELDS, order, "reject_reason"]
    return rows.filter(F.col("reject_reason").isNotNull()).select(*columns).unionByName(checked.select(*columns))

"""Streams over the events, run to the end of the input, and the fill projection."""

from pyspark.sql import functions as F

from seatflow.catalog import schools
from seatflow.catalog.registry import Catalog
from seatflow.catalog.standins import WITH_MART, table
from seatflow.plans import serving
from seatflow.schemas import struct
from seatflow.session import fresh_path
from seatflow.streaming import events as E
from seatflow.streaming import state as St
from seatflow.streaming.projection import SCHEDULE, project_fill, window_start

catalog = Catalog()
query, QUERIES, SQL = catalog.query, catalog.queries, catalog.sql

EVENT = struct(
    "user_id bigint not null, event_type string not null, day string not null, at string not null,"
    "event_id bigint not null, value double"
)
ORDER = ["at", "event_id"]
SLOT = ["user_id", "event_type", "day"]
PARTS = 3
MICROS = "unix_micros(CAST(ts AS TIMESTAMP))"
BAD = """SELECT '{"event_id":' || event_id AS value, 'malformed' AS problem FROM events WHERE event_id % 50 = 0
    UNION ALL SELECT '{"event_id":' || event_id || '}', 'no user_id' FROM events WHERE event_id % 50 = 1"""


def _arrive(spark, sf, path, condition):
    """Events that meet the condition as JSON lines in the inbox at ``path``, and among them
    lines that are cut off or lack required fields. Two files, so more than one micro-batch."""
    events = table(spark, sf, "events").filter(condition)
    rows = events.select(
        "user_id",
        "event_type",
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at"),
        "event_id",
        "value",
    )
    start = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"))
    end = F.when(F.col("event_id") % 50 == 0, "").when(F.col("event_id") % 50 == 1, "}")
    bad = events.select(F.concat(start, end).alias("value")).filter("value is not null")
    lines = E.encode_events(rows, ["user_id", "event_type"]).select("value").unionByName(bad)
    lines.repartition(2).write.mode("append").text(path)


def _span(spark, sf):
    """The least time of the events, and the length of a part, in microseconds."""
    least, most = table(spark, sf, "events").selectExpr(f"min({MICROS})", f"max({MICROS})").first()
    return least or 0, ((most or 0) - (least or 0)) // PARTS + 1


def _of_part(span, part):
    least, length = span
    return f"({MICROS} - {least}) DIV {length} = {part}"


def _finish(run):
    run.awaitTermination()
    if run.exception():
        raise run.exception()


def _in_parts(spark, sf, start, times=1):
    """Run a stream to the end, part after part from one checkpoint: the events come by time.
    Each part arrives so many times."""
    inbox, out, mark = (fresh_path(spark, n) for n in ("inbox", "out", "mark"))
    span = _span(spark, sf)
    for part in range(PARTS):
        for _ in range(times):
            _arrive(spark, sf, inbox, _of_part(span, part))
        _finish(start(E.read_lines(spark, inbox, max_files=2), out, mark))
    return out


ALL = """SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS at, event_id, value FROM events"""


@query("stream_parse", ALL)
def stream_parse(spark, sf):
    """Typed events out of a stream of JSON lines, held in memory by no one: a table takes them."""
    out = _in_parts(spark, sf, lambda lines, out, mark: E.run_append(E.parse_events(lines, EVENT), out, mark))
    return spark.read.schema(EVENT).parquet(out)


@query("stream_rejects", BAD)
def stream_rejects(spark, sf):
    """The lines that are no valid events, with the reason, in a table of their own."""
    out = _in_parts(spark, sf, lambda lines, out, mark: E.run_append(E.rejected_events(lines, EVENT), out, mark))
    return spark.read.schema("value string, problem string").parquet(out)


@query("stream_append", ALL)
def stream_append(spark, sf):
    """Every event exactly once although the stream stopped and started again, even for nothing."""

    def twice(lines, out, mark):
        E.run_append(E.parse_events(lines, EVENT), out, mark).awaitTermination()
        return E.run_append(E.parse_events(lines, EVENT), out, mark)

    return spark.read.schema(EVENT).parquet(_in_parts(spark, sf, twice))


PATHS = {"user_id": ["$.user_id", "$.user.id"], "event_type": ["$.event_type", "$.kind"]}


def _in_versions(spark, sf, path):
    """Events in three layouts by turns: as they are; with a user record, another name of the type
    and the value as text; and without a value but with a field that nobody knows."""
    events = table(spark, sf, "events").withColumns(
        {
            "day": F.date_format("ts", "yyyy-MM-dd"),
            "at": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
            "kind": F.col("event_type"),
            "user": F.struct(F.col("user_id").cast("string").alias("id"), F.lit("x").alias("since")),
            "text": F.col("value").cast("string"),
        }
    )
    own = ["event_id", "day", "at"]
    layouts = [
        ["user_id", "event_type", *own, "value"],
        ["user", "kind", *own, F.col("text").alias("value")],
        ["user_id", "kind", *own, F.array(F.lit(1)).alias("unknown")],
    ]
    for turn, columns in enumerate(layouts):
        rows = events.filter(F.col("event_id") % 3 == turn).select(F.to_json(F.struct(*columns)).alias("value"))
        cut = rows.filter(F.crc32("value") % 50 == 0).select(F.substring("value", 1, 9).alias("value"))
        rows.unionByName(cut).repartition(1).write.mode("append").text(path)


@query("event_versions", ALL.replace("value FROM", "CASE WHEN event_id % 3 <> 2 THEN value END AS value FROM"))
def event_versions(spark, sf):
    """Typed events out of a stream whose layout changed twice."""
    inbox, out, mark = (fresh_path(spark, n) for n in ("inbox", "out", "mark"))
    _in_versions(spark, sf, inbox)
    _finish(E.run_append(E.parse_versions(E.read_lines(spark, inbox), EVENT, PATHS), out, mark))
    return spark.read.schema(EVENT).parquet(out)


def _latest(keys):
    return f"""SELECT * FROM ({ALL}) QUALIFY row_number() OVER (PARTITION BY {', '.join(keys)}
        ORDER BY "at" DESC, event_id DESC) = 1"""


def _delay(spark, sf):
    """The events of a part come in no order, so the state has to outlast a part."""
    return f"{_span(spark, sf)[1] // 1_000_000 + 2} seconds"


def _once(spark, sf):
    """Every event once into the changes, though each part of the events arrives twice."""
    delay = _delay(spark, sf)

    def start(lines, out, mark):
        return St.run_changes(St.once(E.parse_events(lines, EVENT), ["event_id"], "at", delay), out, mark)

    return _in_parts(spark, sf, start, times=2)


@query("stream_replay", ALL)
def stream_replay(spark, sf):
    """Every event once, though the inbox is replayed after each part."""
    return spark.read.schema(EVENT).parquet(f"{_once(spark, sf)}/changes").select(*EVENT.names)


@query("stream_dedupe", _latest(SLOT))
def stream_dedupe(spark, sf):
    """Latest record per slot over events that the state store let through once."""
    return St.read_latest(spark, _once(spark, sf), EVENT, SLOT, ORDER)


@query(
    "stream_late",
    f"""WITH s AS (SELECT min(epoch_us(ts)) AS low, (max(epoch_us(ts)) - min(epoch_us(ts))) // {PARTS} + 1 AS part FROM events)
    SELECT * FROM ({ALL.replace("FROM events", "FROM events, s WHERE epoch_us(ts) < low + part")})""",
)
def stream_late(spark, sf):
    """The last part of the events arrives first: those of the first part come too late, and go
    to a table of their own."""
    inbox, out, raw = (fresh_path(spark, n) for n in ("inbox", "out", "raw"))
    marks, span = [fresh_path(spark, "mark") for _ in range(2)], _span(spark, sf)
    for part in (PARTS - 1, 0):
        _arrive(spark, sf, inbox, _of_part(span, part))
        events = E.read_events(spark, inbox, EVENT)
        _finish(E.run_append(events, raw, marks[0]))
        _finish(St.run_changes(St.once(events, ["event_id"], "at", "60 seconds"), out, marks[1]))
    taken = spark.read.schema(EVENT).parquet(f"{out}/changes")
    return St.late_events(spark.read.schema(EVENT).parquet(raw), taken, ["event_id"])


@query("stream_latest", _latest(["user_id"]))
def stream_latest(spark, sf):
    """Latest record per user: one value of state a user, dropped by a timer when idle."""
    length = _span(spark, sf)[1]
    delay, idle = f"{length // 1_000_000 + 2} seconds", length // 1000

    def start(lines, out, mark):
        return St.run_latest(E.parse_events(lines, EVENT), out, mark, ["user_id"], ORDER, "at", delay, idle)

    return St.read_latest(spark, _in_parts(spark, sf, start), EVENT, ["user_id"], ORDER)


PAIR = ["user_id", "event_type"]


@query(
    "stream_interim",
    f"""SELECT l.*, c_name, n_name FROM ({_latest(PAIR)}) l
      LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def stream_interim(spark, sf):
    """Latest record per user and type, with the user's places joined while the events arrive."""
    places = fresh_path(spark, "places")
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    known = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    known = known.select(F.col("c_custkey").alias("user_id"), "c_name", "n_name")
    known.write.parquet(places)
    shape = struct(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT.fields) + ", c_name string, n_name string")

    def start(lines, out, mark):
        enrich = St.attach_stored(places, known.schema, "user_id")
        return St.run_changes(E.parse_events(lines, EVENT), out, mark, enrich=enrich, schema=shape)

    return St.read_latest(spark, _in_parts(spark, sf, start), shape, PAIR, ORDER)


@query("stream_upsert", _latest(["user_id"]))
def stream_upsert(spark, sf):
    """Micro-batches appended without state; after each part the changes are compacted, but
    those of the last."""
    generation = iter(range(PARTS))

    def start(lines, out, mark):
        now = next(generation)
        if now:
            St.compact(spark, out, EVENT, ["user_id"], ORDER, now - 1)
        return St.run_changes(E.parse_events(lines, EVENT), out, mark, generation=now)

    return St.read_latest(spark, _in_parts(spark, sf, start), EVENT, ["user_id"], ORDER)


# The exact binary value of a share as a whole number: share * 2**68.
TWO68 = "295147905179352825856"
SLOTS = ", ".join(f"({d}, '{s}', {p})" for d, s, p in SCHEDULE)


@query(
    "fill_projection",
    WITH_MART
    + f""", s(simulation_day, snapshot_type, share) AS (VALUES {SLOTS}),
    seed AS (SELECT * FROM mart WHERE registration_year = (SELECT max(registration_year) FROM mart)
      AND phase_normalised IN ('2B', '2C', '2C(S)') AND is_active AND has_full_figures AND vacancy > 0),
    counted AS (SELECT *, CAST(round_even(CAST(coalesce(applied, 0) AS DOUBLE) * CAST(share AS DOUBLE), 0)
      AS BIGINT) AS n FROM seed CROSS JOIN s),
    left_over AS (SELECT *, greatest(0, vacancy - n) AS remaining FROM counted),
    reached AS (SELECT *, 10000 * CAST((vacancy - remaining) / vacancy * {TWO68} AS HUGEINT) AS q FROM left_over)
    SELECT md5(school_name_clean || '-' || phase_normalised || '-' || registration_year || '-'
        || simulation_day || '-' || snapshot_type) AS event_id,
      school_name_clean AS school_name, phase_normalised AS phase, registration_year,
      strftime(CASE phase_normalised WHEN '2B' THEN TIMESTAMP '2026-07-24'
          ELSE TIMESTAMP '2026-08-08' END + to_days(simulation_day - 1)
        + to_hours(CASE snapshot_type WHEN 'midday' THEN 12 ELSE 18 END), '%Y-%m-%dT%H:%M:%S') || '+08:00'
        AS snapshot_timestamp,
      snapshot_type, vacancy AS vacancy_at_open, remaining AS vacancy_remaining, n AS applied_count,
      (q // {TWO68} + CASE WHEN 2 * (q % {TWO68}) > {TWO68}
          OR (2 * (q % {TWO68}) = {TWO68} AND (q // {TWO68}) % 2 = 1) THEN 1 ELSE 0 END) / 10000 AS pct_filled,
      CAST(simulation_day AS INTEGER) AS simulation_day
    FROM reached""",
)
def fill_projection(spark, sf):
    open_rows = serving.projection_seeds(schools.stored_mart(spark, sf), ("2B", "2C", "2C(S)"))
    windows = {(schools.CURRENT, "2B"): "2026-07-24", (schools.CURRENT, "2C"): "2026-08-08"}
    return project_fill(
        open_rows, window_start(F.col("registration_year"), F.col("phase"), windows)
    )

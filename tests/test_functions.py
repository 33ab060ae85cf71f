from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from opsight.functions import jobs, text, times, units, variants
from opsight.operators import lineage
from opsight.sources.status_xml import percent_decoded


def one(spark, column, **values):
    """Evaluate a column over one row of string (or list) values."""
    rows = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return rows.select(column.alias("x")).first()["x"]


def each(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    found = rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()
    return [row["x"] for row in found]


def test_iso_instants(spark):
    texts = {
        "2026-08-12T10:00:00Z": datetime(2026, 8, 12, 10),
        "2026-08-12T10:00:00+02:00": datetime(2026, 8, 12, 8),
        "2026-08-12 10:00": datetime(2026, 8, 12, 10),
        "2026-08-12T10-05": datetime(2026, 8, 12, 15),
        "20260812": datetime(2026, 8, 12),
        "20260812T101112,5": datetime(2026, 8, 12, 10, 11, 12, 500000),
        "2026-08-12T10:00:00.123456789Z": datetime(2026, 8, 12, 10, 0, 0, 123456),
        "2026": None,
        "2026-02-30": None,
        "": None,
        "soon": None,
        None: None,
    }
    found = each(spark, list(texts), lambda v: F.date_format(times.iso_instant(v), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    expected = [t and t.strftime("%Y-%m-%d %H:%M:%S.%f") for t in texts.values()]
    assert found == expected


def test_naive_text_uses_the_given_zone(spark):
    found = each(
        spark,
        ["2026-08-12T10:00:00", "2026-08-12T10:00:00Z", "2026-08-12"],
        lambda v: times.iso_text(times.iso_instant(v, "Europe/Berlin")),
    )
    assert [value[:16] for value in found] == [
        "2026-08-12T08:00",
        "2026-08-12T10:00",
        "2026-08-11T22:00",
    ]


def test_writer_offset_comes_from_the_uuid(spark):
    rows = spark.createDataFrame(
        [
            ("843b6f0e-94f4-11f1-aca4-fa163e934c9b", "2026-08-10 21:48:53.662211"),
            ("843B6F0E-94F4-11F1-ACA4-FA163E934C9B", "2026-08-10 19:48:53.662211"),
            ("843b6f0e-94f4-11f1-aca4-fa163e934c9b", "2026-08-11 19:48:53"),
            ("123e4567-e89b-42d3-a456-426614174000", "2026-08-10 21:48:53"),
            ("no uuid", "2026-08-10 21:48:53"),
        ],
        "uuid string, t string",
    ).select("uuid", F.col("t").cast("timestamp_ntz").alias("time_start"), F.lit(None).cast("timestamp_ntz").alias("time_end"))
    found = jobs.with_utc_times(rows).select("offset_minutes", times.iso_text("started_at").alias("s")).collect()
    assert [row["offset_minutes"] for row in found] == [120, 0, None, None, None]
    assert found[0]["s"] == "2026-08-10T19:48:53.662211"
    local = jobs.with_utc_times(rows, "Europe/Berlin").select(times.iso_text("started_at").alias("s")).collect()
    assert local[3]["s"] == "2026-08-10T19:48:53.000000"


def test_status_names_keep_unknown_codes_apart(spark):
    codes = jobs.StatusCodes(accepted=0, started=1, paused=2, succeeded=3, failed=4, dismissed=5)
    found = each(spark, [0, 1, 2, 3, 4, 5, 9, None], lambda v: jobs.status_name(v, codes, "other"), "int")
    assert found == ["accepted", "running", "running", "successful", "failed", "dismissed", "other", "other"]


@pytest.mark.parametrize(
    "message, category",
    [
        ("slurmstepd: oom-kill event(s)", "memory"),
        ("Job cancelled due to time limit", "timeout"),
        ("stalled-job recovery found no status update for at least 30 minutes", "timeout"),
        ("No timesteps are matching the selection criteria.", "no-data"),
        ("Could not normalize the latitude coordinate", "spatial"),
        ("is not within the longitude bounds of this dataset", "spatial"),
        ("Dataset not found", "input"),
        ("sbatch refused the job", "scheduler"),
        ("Process error: unknown", "unknown"),
        ("NoApplicableCode None Process failed, please check server error log ", "unknown"),
        ("   ", "unknown"),
        ("ValueError: broken chunk", "other"),
        ("MemoryError after walltime check", "memory"),
    ],
)
def test_failure_categories(spark, message, category):
    assert one(spark, text.failure_category("m"), m=message) == category


NO_DATA = (
    "There were no valid data points found in the requested subset. Please expand the area "
    "covered by the bounding box, the time period or the level range you have selected."
)


@pytest.mark.parametrize(
    "message, cause",
    [
        ('Traceback File "s.py" ValueError: ' + NO_DATA + " During handling of the above exception, another", NO_DATA),
        (
            "FutureWarning: x slurmstepd: error: *** JOB 2867399 ON localhost CANCELLED AT 2026-08-12T19:59:13 DUE TO TIME LIMIT ***",
            "slurmstepd: error: *** JOB 2867399 ON localhost CANCELLED AT 2026-08-12T19:59:13 DUE TO TIME LIMIT ***",
        ),
        (
            "a b slurmstepd: error: *** JOB 28327 ON localhost CANCELLED AT 2026-08-19T21:01:02 ***",
            "slurmstepd: error: *** JOB 28327 ON localhost CANCELLED AT 2026-08-19T21:01:02 ***",
        ),
        (
            "Requested datetimes include some not found in the dataset: cftime.Datetime360Day(2050, 1, 1) cftime.DatetimeNoLeap(2015, 2)",
            "Requested years not found in dataset: 2015,2050",
        ),
        (
            "x Cannot create TimeComponentsParameter from: year:a Traceback (most recent call last) y",
            "Invalid time components: year:a",
        ),
        ("ValueError: one During handling ProcessError:  the\n last ", "the last"),
        ("  plain \n text ", "plain text"),
    ],
)
def test_root_causes(spark, message, cause):
    assert one(spark, text.root_cause("m"), m=message) == cause


def test_diagnostics_come_before_failures(spark):
    rows = spark.sql(
        "select array(named_struct('code','c','locator',null,'message','from xml')) f,"
        " array(named_struct('source','s','message','')"
        ", named_struct('source','s','message','from log')) d"
    )
    assert rows.select(text.first_message(F.col("f"), F.col("d"))).first()[0] == "from log"
    assert rows.select(text.failure_text(F.col("f"), F.col("d"))).first()[0] == "c  from xml s  s from log"


def test_log_fields_and_event_names(spark):
    message = "layer=database job=j-1 a-b=1 a_b=2.5 x=none finding=stalled finding=long-running"
    fields = one(spark, text.log_fields("m"), m=message)
    assert fields == {"layer": "database", "job": "j-1", "a_b": "2.5", "x": None, "finding": "long-running"}
    assert one(spark, text.log_fields("m"), m="nothing here") == {}
    typed = one(spark, F.to_json(text.typed_log_fields(text.log_fields("m"))), m="n=007 d=1.50 s=x")
    assert typed == '{"n":7,"d":1.5,"s":"x"}'
    names = {
        ("finding=long-running", "warning"): "job-long-running",
        ("finding=a action=recovered", "info"): "job-recovered",
        ("finding=slurm-oom", "warning"): "slurm-oom",
        ("decision=error", "warning"): "operation-error",
        ("text", "critical"): "operation-error",
        ("text", "warning"): "operation-warning",
        ("action=recovered action=none", "warning"): "operation-warning",
    }
    for (line, level), name in names.items():
        assert one(spark, text.event_name("m", F.lit(level)), m=line) == name


def test_display_limit(spark):
    shown = one(spark, text.display_message("m"), m="x" * 400)
    assert len(shown) == 300 and shown.endswith("x [..]")
    spaced = one(spark, text.display_message("m"), m="y" * 290 + " " * 50)
    assert spaced == "y" * 290 + " [..]"
    assert one(spark, text.display_message("m"), m="z" * 300) == "z" * 300


def test_name_components(spark):
    assert one(spark, text.name_component("m"), m="--a b/c.--") == "a-b-c"
    assert one(spark, text.name_component("m"), m=" // ") == "unknown"
    assert len(one(spark, text.name_component("m"), m="n" * 200)) == 80


def test_elapsed_and_memory(spark):
    elapsed = {"05:30": 330, "02:05:30": 7530, "2-02:05:30": 180330, "1:60": None, "5": None, "x": None}
    assert each(spark, list(elapsed), units.elapsed_seconds) == list(elapsed.values())
    sizes = {"512": 512 * 2**20, "1024K": 2**20, "1.5G": 3 * 2**29, "2Gn": 2**31, "2gc": 2**31, "0": 0, "N/A": None, "x": None}
    assert each(spark, list(sizes), units.memory_bytes) == list(sizes.values())


def test_node_states_and_mounts(spark):
    states = {"idle": True, "ALLOCATED+": True, "mixed-": True, "completing": True, "down*": False, "idle*": False, "allocated*+": False, "drained": False}
    assert each(spark, list(states), lambda s: units.is_usable_node(F.lit("UP"), s)) == list(states.values())
    assert each(spark, ["idle"], lambda s: units.is_usable_node(F.lit("down"), s)) == [False]
    mounts = {"/": "df-root", "/data": "df-data", "/data/archive/": "df-data-archive"}
    assert each(spark, list(mounts), units.disk_plugin) == list(mounts.values())


def test_year_sets(spark):
    sets = [[2015, 2016, 2018], [2020], [], None, [1, 2, 3]]
    found = each(spark, sets, text.compact_years, "array<int>")
    assert found == ["2015-2016,2018", "2020", "unknown", "unknown", "1-3"]
    years = one(spark, lineage.requested_years(F.array(F.lit("2056/2070")), F.array(F.lit("month:jan|year:2058,2056,2070"))))
    assert years == [2056, 2058, 2070]
    assert one(spark, lineage.requested_years(F.array(F.lit("2060/2063"), F.lit("2070")), F.array().cast("array<string>"))) == [2060, 2061, 2062, 2063, 2070]


def test_strings_of_nested_lists_are_all_found(spark):
    nested = '["a", ["b", [["c", [["d \\"q\\""]]]]], 1, {"k": "no"}]'
    found = one(spark, variants.string_values(F.try_parse_json("j")), j=nested)
    assert found == ["a", "b", "c", 'd "q"']
    assert one(spark, variants.string_values(F.try_parse_json("j")), j='"x"') == ["x"]
    assert one(spark, variants.string_values(F.try_parse_json("j")), j="3") == []
    assert one(spark, variants.string_values(F.lit(None).cast("variant"))) == []


def test_wall_clock_is_utc(spark):
    west = timezone(timedelta(hours=-8))
    both = spark.range(1).select(
        times.wall_clock(datetime(2026, 8, 1, 20, tzinfo=west)).alias("aware"),
        times.wall_clock(datetime(2026, 8, 2, 4)).alias("naive"),
    )
    row = both.first()
    assert row["aware"] == row["naive"] == datetime(2026, 8, 2, 4)


@pytest.mark.parametrize(
    ("raw", "decoded"),
    [
        ("/a%20b%C3%A9", "/a bé"),
        ("/100%/a%20b", "/100%/a b"),
        ("%zz%41+%", "%zzA+%"),
        ("%+1%%41", "%+1%A"),
        ("", ""),
        (None, None),
    ],
)
def test_percent_decoding_keeps_invalid_escapes(spark, raw, decoded):
    frame = spark.createDataFrame([(raw,)], "raw string")
    assert frame.select(percent_decoded(F.col("raw"))).first()[0] == decoded

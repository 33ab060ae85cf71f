"""Job dumps and the error output next to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight import fixed
from opsight.functions import text, variants
from opsight.functions.derive import by_shuffle, computed


def read_job_dumps(spark: SparkSession, path: str, folders: str = "*") -> DataFrame:
    """``directory, dump`` (JSON text) of the dump files in the job folders of ``path``."""
    return _files(spark, f"{path.rstrip('/')}/{folders}/job_*.dump").select(
        _parent(), F.make_valid_utf8(F.col("content").cast("string")).alias("dump")
    )


def read_error_outputs(spark: SparkSession, path: str, folders: str = "*") -> DataFrame:
    """``directory, error_output`` (bytes) of every error file next to a dump."""
    return _files(spark, f"{path.rstrip('/')}/{folders}/job-error.txt").select(
        _parent(), F.col("content").alias("error_output")
    )


def _files(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").load(pattern)


def _parent() -> Column:
    return F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("directory")


def folder(path: Column) -> Column:
    """A folder's plain path: no scheme of local files, no doubled or closing slashes."""
    local = F.regexp_replace(path, "^file:(?://)?(?=/)", "")
    return F.regexp_replace(F.regexp_replace(local, r"/(?:\.?/)+", "/"), r"(?<=.)/\.?$", "")


def parse_dumps(dumps: DataFrame) -> DataFrame:
    """Dumps that name a job, with what they say and whether they are evidence.

    ``problem`` is null for a valid dump: its request is JSON text of an object, inputs
    are a mapping if they are given, and it lies in the work folder it names.
    """
    parsed = computed(dumps, v=F.try_parse_json("dump"))
    named = computed(
        parsed,
        job_id=F.nullif(
            F.coalesce(F.try_variant_get("v", "$.process.uuid", "string"), F.lit("")),
            F.lit(""),
        ),
    ).where("job_id is not null")
    request_text = variants.as_text(F.try_variant_get("v", "$.wps_request", "variant"))
    read = computed(named, request=F.try_parse_json(request_text))
    request = F.col("request")
    members = computed(
        read,
        workdir=variants.as_text(F.try_variant_get("v", "$.process.workdir", "variant")),
        given=F.try_variant_get(request, "$.inputs", "variant"),
        inputs=F.try_variant_get(request, "$.inputs", "map<string,variant>"),
        names=F.map_keys(variants.as_object(request)),
    )
    sizes = F.transform(
        F.map_values("inputs"),
        lambda value: F.coalesce(
            F.size(F.try_variant_get(value, "$", "array<variant>")), F.lit(1)
        ),
    )
    lineage = F.coalesce(F.try_variant_get(request, "$.lineage", "string"), F.lit(""))
    no_mapping = F.array_contains("names", "inputs") & F.col("inputs").isNull()
    problem = (
        F.when(F.col("names").isNull(), "request is no JSON object")
        .when(no_mapping, "inputs are no mapping")
        .when(
            ~folder(F.col("workdir")).eqNullSafe(folder(F.col("directory"))),
            "work folder differs",
        )
    )
    return members.select(
        "directory",
        "job_id",
        "workdir",
        (F.lower(lineage) == "true").alias("lineage"),
        F.coalesce(
            F.aggregate(sizes, F.lit(0), lambda total, size: total + size), F.lit(0)
        ).alias("input_count"),
        problem.isNull().alias("is_valid"),
        problem.alias("problem"),
    )


def of_jobs(dumps: DataFrame, jobs: DataFrame) -> DataFrame:
    """The raw dumps that may belong to ``jobs`` (``job_id``), found by a light parse."""
    named = computed(dumps, __job=F.get_json_object("dump", "$.process.uuid"))
    wanted = jobs.select(F.col("job_id").alias("__job")).distinct()
    return named.join(by_shuffle(wanted), "__job", "left_semi").drop("__job")


def evidence(jobs: DataFrame, dumps: DataFrame, errors: DataFrame, tail_bytes: int | None = None) -> DataFrame:
    """``job_id, dumps, directory, is_oom`` of the jobs that have a valid dump.

    The dumps are cut down to the jobs asked for before they are validated, and error
    outputs to the folders of jobs with exactly one valid dump before they are searched.
    ``directory`` is null and the output is not looked at where there are several.
    """
    valid = parse_dumps(of_jobs(dumps, jobs)).where("is_valid")
    counted = valid.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("dumps"), F.min("directory").alias("only")
    )
    found = counted.select(
        "job_id", "dumps", F.when(F.col("dumps") == 1, F.col("only")).alias("directory")
    )
    searched = errors.join(
        by_shuffle(found.where("directory is not null").select("directory")), "directory", "left_semi"
    )
    return found.join(by_shuffle(oom_folders(searched, tail_bytes)), "directory", "left").select(
        "job_id", "dumps", "directory", F.coalesce("is_oom", F.lit(False)).alias("is_oom")
    )


def tail(content: Column, size: int | None) -> Column:
    """Last ``size`` bytes of a binary, or all of it, as text."""
    if size is not None:
        start = F.greatest(F.lit(1), F.octet_length(content) - F.lit(size - 1))
        content = F.substring(content, start, F.lit(size))
    return F.make_valid_utf8(content.cast("string"))


def oom_folders(errors: DataFrame, tail_bytes: int | None = None) -> DataFrame:
    """Folders whose error output holds the scheduler's out-of-memory marker."""
    marked = errors.where(tail(F.col("error_output"), tail_bytes).rlike(fixed.OOM_MARKER))
    return marked.select("directory").distinct().withColumn("is_oom", F.lit(True))


def job_diagnostics(
    dumps: DataFrame, errors: DataFrame, tail_bytes: int | None = None
) -> DataFrame:
    """One row per job with error output: ``job_id, diagnostics``.

    The message is the output, or its last ``tail_bytes`` bytes
    (``fixed.DIAGNOSTIC_TAIL_BYTES`` in the plain event format). Of several dumps of
    one job the last folder wins; a dump need not be valid evidence for this.
    """
    message = text.collapse_spaces(tail(F.col("error_output"), tail_bytes))
    outputs = (
        errors.select("directory", message.alias("message"))
        .where("message != ''")
        .groupBy("directory")
        .agg(F.max("message").alias("message"))
    )
    return (
        dumps.select("job_id", "directory")
        .distinct()
        .join(by_shuffle(outputs), "directory")
        .groupBy("job_id")
        .agg(F.max_by("message", "directory").alias("message"))
        .select(
            "job_id",
            F.array(
                F.struct(F.lit("job-error.txt").alias("source"), F.col("message"))
            ).alias("diagnostics"),
        )
    )


def oom_jobs(
    jobs: DataFrame, dumps: DataFrame, errors: DataFrame, tail_bytes: int | None = None
) -> DataFrame:
    """Jobs with exactly one valid dump whose error output holds the memory marker."""
    return evidence(jobs, dumps, errors, tail_bytes).where("is_oom").select("job_id")

"""Status documents: one XML file per job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight import fixed
from opsight.functions import text, times
from opsight.functions.derive import by_shuffle, computed

_STATE = "array<struct<_VALUE:string>>"
_EXCEPTION = "struct<_exceptionCode:string,_locator:string,ExceptionText:array<string>>"
_VALUE = "struct<Attributes:string,Text:string>"
_STATUS = (
    "Status struct<_creationTime:string,"
    f"ProcessAccepted:{_STATE},ProcessStarted:{_STATE},ProcessPaused:{_STATE},"
    f"ProcessSucceeded:{_STATE},"
    "ProcessFailed:array<struct<_VALUE:string,"
    f"ExceptionReport:struct<Exception:array<{_EXCEPTION}>>>>>"
)
DOCUMENT = (
    f"Process struct<Identifier:string>, {_STATUS}, "
    "DataInputs struct<Input:array<struct<Identifier:string,"
    "Reference:struct<_href:string>,Data:struct<"
    f"LiteralData:{_VALUE},ComplexData:{_VALUE},BoundingBoxData:{_VALUE}>>>>, _corrupt string"
)
#: Enough to judge a document by its state.
STATE_ONLY = f"Process struct<Identifier:string>, {_STATUS}, _corrupt string"
VALUE_ELEMENTS = ("LiteralData", "ComplexData", "BoundingBoxData")
TEXT_ELEMENTS = ("ExceptionText", "Identifier")
OPTIONS = {
    "ignoreNamespace": "true",
    "attributePrefix": "_",
    "columnNameOfCorruptRecord": "_corrupt",
}


@dataclass(frozen=True)
class ValueLimits:
    """Longest recorded texts in characters; None records them whole."""

    value: int | None = None
    complex_value: int | None = None

    @property
    def any(self) -> bool:
        return self.value is not None or self.complex_value is not None


WHOLE = ValueLimits()
#: The lengths that the plain event format prescribes.
RECORDED = ValueLimits(fixed.MAX_VALUE_LENGTH, fixed.MAX_COMPLEX_VALUE_LENGTH)


def read_status_documents(spark: SparkSession, path: str) -> DataFrame:
    """``job_id, modification_time, content`` of every document under ``path``."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.xml")
        .load(path)
        .select(
            F.regexp_extract("path", r"([^/]+)\.xml$", 1).alias("job_id"),
            F.col("modificationTime").alias("modification_time"),
            F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        )
    )


def percent_decoded(value: Column) -> Column:
    """URL-decode a text, keeping ``+`` and each ``%`` that two hex digits don't follow."""
    kept = F.regexp_replace(F.replace(value, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(kept), value)


_NAME = r"(?:[\w.-]+:)?"
_TAG = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
#: Markup inside a text element; character data sections are kept.
_MARKUP = rf"(?s)(<!\[CDATA\[.*?\]\]>)|<!--.*?-->|<{_TAG}>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def flattened(content: Column) -> Column:
    """The document with plain text inside its values, texts and identifiers.

    Elements nested in them give way to the text they hold, in document order. A value
    becomes two elements, ``Attributes`` with the source of its attributes, whatever
    their names, and ``Text``; a parser with a fixed schema then loses neither.
    """
    names = "|".join(VALUE_ELEMENTS + TEXT_ELEMENTS)
    # A start tag that closes itself, or one with everything up to its end tag.
    element = rf"(?s)<({_NAME}(?:{names}))(?=[\s/>])(?:{_TAG}(?<=/)>|{_TAG}(?<!/)>.*?</\1\s*>)"

    def rewritten(source: Column) -> Column:
        name = F.regexp_extract(source, rf"^<({_NAME}\w+)", 1)
        attributes = F.regexp_extract(source, rf"^<{_NAME}\w+({_TAG})>", 1)
        inner = F.regexp_replace(
            F.regexp_replace(source, rf"^<{_TAG}>", ""), rf"</{_NAME}\w+\s*>$", ""
        )
        plain = F.regexp_replace(inner, _MARKUP, "$1")
        is_value = F.regexp_replace(name, "^.*:", "").isin(*VALUE_ELEMENTS)
        body = F.when(
            is_value,
            F.concat(
                F.lit("<Attributes>"),
                F.replace(attributes, F.lit("&"), F.lit("&amp;")),
                F.lit("</Attributes><Text>"),
                plain,
                F.lit("</Text>"),
            ),
        ).otherwise(plain)
        return F.concat(F.lit("<"), name, F.lit(">"), body, F.lit("</"), name, F.lit(">"))

    between = F.split(content, element, -1)
    found = F.transform(F.regexp_extract_all(content, F.lit(element), F.lit(0)), rewritten)
    pairs = F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array_join(pairs, "")


def _attributes(source: Column) -> Column:
    """Attributes by local name, sorted, from the text of a start tag."""
    found = F.regexp_extract_all(
        source, F.lit(r"""[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*')"""), F.lit(0)
    )

    def decoded(text: Column) -> Column:
        for entity, character in ENTITIES:
            text = F.replace(text, F.lit(entity), F.lit(character))
        return text

    entries = F.transform(
        F.filter(found, lambda pair: ~pair.startswith("xmlns")),
        lambda pair: F.struct(
            F.regexp_extract(pair, r"^(?:[^=:]*:)?([\w.-]+)\s*=", 1).alias("key"),
            decoded(F.regexp_extract(pair, r"""(?s)=\s*["'](.*)["']$""", 1)).alias("value"),
        ),
    )
    return F.map_from_entries(F.array_sort(entries))


def _limited(value: Column, limit: int | None) -> Column:
    """Space-collapsed text, cut where a limit is given."""
    collapsed = text.collapse_spaces(value)
    return F.nullif(collapsed if limit is None else F.left(collapsed, F.lit(limit)), F.lit(""))


def _input_value(item: Column, limits: ValueLimits) -> Column:
    reference, data = item["Reference"], item["Data"]
    no_attributes = F.lit(None).cast("map<string,string>")

    def value(kind: str, content: Column, attributes: Column, cut: Column) -> Column:
        present = F.when(F.size(attributes) > 0, attributes)
        fields = [
            F.lit(kind).alias("type"),
            content.alias("value"),
            F.coalesce(present, no_attributes).alias("attributes"),
        ]
        return F.struct(*fields, *([cut.alias("truncated")] if limits.any else []))

    def data_value(kind: str, limit: int | None) -> Column:
        element = data[kind]
        too_long = F.lit(False)
        if limit is not None:
            too_long = F.coalesce(F.length(text.collapse_spaces(element["Text"])) > limit, F.lit(False))
        return value(kind, _limited(element["Text"], limit), _attributes(element["Attributes"]), too_long)

    chosen = F.when(
        reference.isNotNull(),
        value("reference", percent_decoded(reference["_href"]), no_attributes, F.lit(False)),
    )
    for kind in VALUE_ELEMENTS:
        limit = limits.complex_value if kind == "ComplexData" else limits.value
        chosen = chosen.when(data[kind].isNotNull(), data_value(kind, limit))
    return chosen.otherwise(value("unknown", F.lit(None).cast("string"), no_attributes, F.lit(False)))


def parse_status(documents: DataFrame, with_inputs: bool = True) -> DataFrame:
    """Documents with one parse of their XML and the fields all readers share.

    ``problem`` says why monitoring cannot use a document, ``reject`` why the ingest
    cannot; both are null for good ones. The ingest wants at most one final state and
    needs a creation time only where the job id holds none. Without inputs only the
    state is parsed, which is all the findings look at.
    """
    content = flattened(F.col("content")) if with_inputs else F.col("content")
    schema = DOCUMENT if with_inputs else STATE_ONLY
    parsed = computed(documents, doc=F.from_xml(content, F.lit(schema), OPTIONS))
    status = F.col("doc.Status")
    states = F.flatten(
        F.array(
            *[
                F.array_repeat(F.lit(state), F.coalesce(F.array_size(status[state]), F.lit(0)))
                for state in fixed.DOCUMENT_STATUS
            ]
        )
    )
    listed = computed(
        parsed,
        states=F.when(status.isNotNull(), states),
        labelled_creation=times.iso_instant(status["_creationTime"]),
    )
    count = F.size("states")
    final = F.filter("states", lambda state: state.isin(*fixed.FINAL_DOCUMENT_STATES))
    unreadable = F.when(
        F.col("doc").isNull() | F.col("doc._corrupt").isNotNull(), "invalid XML"
    ).when(status.isNull(), "missing Status")
    undated = F.col("labelled_creation").isNull()
    bad_label = (F.coalesce(status["_creationTime"], F.lit("")) != "") & undated
    return computed(
        listed,
        state=F.when(count == 1, F.get("states", F.lit(0))),
        final_state=F.get(final, F.lit(0)),
        process=F.coalesce(
            F.nullif(text.collapse_spaces("doc.Process.Identifier"), F.lit("")),
            F.lit("unknown"),
        ),
        problem=unreadable.when(count != 1, "not exactly one state").when(
            undated, "invalid Status creationTime"
        ),
        reject=unreadable.when(F.size(final) > 1, "not exactly one final state").when(
            (F.size(final) == 1) & times.uuid1_instant("job_id").isNull() & bad_label,
            "invalid Status creationTime",
        ),
    ).drop("states")


def rejected_documents(parsed: DataFrame) -> DataFrame:
    """``job_id, modification_time, reject, content`` of documents the ingest can't use."""
    return parsed.where("reject is not null").select(
        "job_id", "modification_time", "reject", "content"
    )


def status_requests(
    parsed: DataFrame,
    service: str,
    diagnostics: DataFrame | None = None,
    limits: ValueLimits = WHOLE,
) -> DataFrame:
    """Request events of the finished documents.

    ``diagnostics`` (``job_id, diagnostics``, one row per job) is attached to the
    failed ones. With ``limits`` longer values are cut and marked ``truncated``.
    """
    final = parsed.where("reject is null and final_state is not null")
    failed = F.col("final_state") == "ProcessFailed"
    finished = F.col("modification_time")
    uuid_start = times.uuid1_instant("job_id")
    started = F.coalesce(uuid_start, F.col("labelled_creation"))
    seconds = F.greatest(F.lit(0.0), times.seconds_between(finished, started))
    failure_doc = F.get(F.col("doc.Status.ProcessFailed"), F.lit(0))
    exceptions = F.transform(
        failure_doc["ExceptionReport"]["Exception"],
        lambda item: F.struct(
            item["_exceptionCode"].alias("code"),
            item["_locator"].alias("locator"),
            _limited(
                F.get(item["ExceptionText"], F.lit(0)), limits.value
            ).alias("message"),
        ),
    )
    no_text = F.lit(None).cast("string")
    plain = F.array(
        F.struct(
            no_text.alias("code"),
            no_text.alias("locator"),
            _limited(failure_doc["_VALUE"], limits.value).alias("message"),
        )
    )
    inputs = F.transform(
        F.coalesce(F.col("doc.DataInputs.Input"), F.expr("array()")),
        lambda item: F.struct(
            F.coalesce(
                F.nullif(text.collapse_spaces(item["Identifier"]), F.lit("")),
                F.lit("unknown"),
            ).alias("name"),
            _input_value(item, limits).alias("value"),
        ),
    )
    names = F.array_distinct(F.transform(inputs, lambda item: item["name"]))
    by_name = F.map_from_arrays(
        names,
        F.transform(
            names,
            lambda name: F.transform(
                F.filter(inputs, lambda item: item["name"] == name),
                lambda item: item["value"],
            ),
        ),
    )
    final_name = F.when(failed, "failed").otherwise("successful")
    no_failures = F.expr("cast(array() as array<struct<code:string,locator:string,message:string>>)")
    requests = final.select(
        F.lit("request").alias("record_type"),
        F.lit(fixed.SCHEMA_VERSION).alias("schema_version"),
        F.lit(service).alias("service"),
        "job_id",
        "process",
        by_name.alias("inputs"),
        started.alias("started_at"),
        finished.alias("finished_at"),
        F.round(seconds, 3).alias("duration_seconds"),
        F.when(uuid_start.isNotNull(), "uuid1")
        .when(started.isNotNull(), "status_creation_time")
        .alias("duration_source"),
        final_name.alias("outcome"),
        F.when(failed & (F.size(exceptions) > 0), exceptions)
        .when(failed, plain)
        .otherwise(no_failures)
        .alias("failures"),
    )
    return requests if diagnostics is None else with_diagnostics(requests, diagnostics)


def with_diagnostics(requests: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Attach job diagnostics to failed requests only."""
    return requests.join(by_shuffle(diagnostics), "job_id", "left").withColumn(
        "diagnostics", F.when(F.col("outcome") == "failed", F.col("diagnostics"))
    )


def new_requests(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """Requests whose job has not been recorded yet."""
    return requests.join(by_shuffle(recorded.select("job_id").distinct()), "job_id", "left_anti")

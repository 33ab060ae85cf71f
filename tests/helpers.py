"""Small hand-made events, jobs and documents."""

import json


def request(job, outcome="successful", message=None, **changes):
    """A finished request; a message makes a failure of it that names no place."""
    record = {
        "job_id": job,
        "outcome": outcome,
        "service": "rook",
        "process": "subset",
        "duration_seconds": 60,
        "finished_at": "2026-08-19T12:00:00Z",
        "inputs": {},
        "failures": [],
    }
    if message:
        record["failures"] = [{"message": message}]
    return record | changes


def operation(event, job, **changes):
    base = {"record_type": "operation", "service": "rook", "level": "warning", "recorded_at": "2026-08-19T12:05:00Z"}
    return base | {"event": event, "job_id": job, "message": event} | changes


def workflow(payload, job="1", **changes):
    text = payload if isinstance(payload, str) else json.dumps(payload)
    inputs = {"workflow": [{"type": "ComplexData", "value": text}]}
    return request(job, process="orchestrate", inputs=inputs, **changes)


def events_of(spark, records):
    from pyspark.sql import functions as F

    from opsight.sources.events import parse_events, parsed_lines

    lines = spark.createDataFrame(
        [(i, json.dumps(r) if not isinstance(r, str) else r) for i, r in enumerate(records)],
        "line_id long, value string",
    )
    return parse_events(parsed_lines(lines.withColumn("file_path", F.lit("f")).withColumn("block_start", F.lit(0))))


def _input(name, value):
    return f"<wps:Input><ows:Identifier>{name}</ows:Identifier>{value}</wps:Input>"


def status_xml(state="<wps:ProcessSucceeded>ok</wps:ProcessSucceeded>", created="2026-08-12T10:00:00Z", complex="{}"):
    """A status document of a made-up process with one input of every kind."""
    inputs = [
        _input("level", '<wps:Data><wps:LiteralData dataType="string" k:note="a&gt;b &quot;c&quot;">low <u>half</u></wps:LiteralData></wps:Data>'),
        _input("mesh", '<wps:Reference k:href="https://store.test/p%20q+r.nc"/>'),
        _input("level", "<wps:Data><wps:LiteralData> high\n </wps:LiteralData></wps:Data>"),
        _input("big", f"<wps:Data><wps:ComplexData>{complex}</wps:ComplexData></wps:Data>"),
        _input("none", ""),
    ]
    spaces = 'xmlns:wps="http://www.opengis.net/wps/1.0.0" xmlns:ows="http://www.opengis.net/ows/1.1" xmlns:k="urn:k"'
    head = "<wps:Process><ows:Identifier>zonal</ows:Identifier></wps:Process>"
    status = f'<wps:Status creationTime="{created}">{state}</wps:Status>'
    return f"<wps:ExecuteResponse {spaces}>{head}{status}<wps:DataInputs>{''.join(inputs)}</wps:DataInputs></wps:ExecuteResponse>"


FAILED = (
    '<wps:ProcessFailed><wps:ExceptionReport><ows:Exception locator="mesh" exceptionCode="Refused">'
    "<ows:ExceptionText>The mesh   had <b>&lt; 3</b> cells</ows:ExceptionText></ows:Exception></wps:ExceptionReport></wps:ProcessFailed>"
)

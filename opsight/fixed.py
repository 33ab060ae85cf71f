"""Fixed values.

Patterns, constants, names and texts that must equal the documented contract for
results to match. They are data, kept together and in plain form.
"""

# -- failure taxonomy: first match wins, in this order ------------------------
MEMORY_PATTERN = (
    r"\b(?:oom|oom-kill|memoryerror)\b|out of memory|cannot allocate memory|"
    r"memory (?:limit|allocation)|exceeded[^\n]*memory"
)
TIMEOUT_PATTERN = (
    r"timed?\s*out|time(?: |-)?limit|deadline exceeded|walltime|wall clock|"
    r"cancelled[^\n]*time|no (?:status|database) update[^\n]*minutes|"
    r"exceeded[^\n]*(?:run|execution) time"
)
NO_DATA_PATTERN = (
    r"no valid data points|no data (?:found|available)|"
    r"empty (?:subset|selection)|"
    r"no timesteps? (?:are )?matching (?:the )?selection criteria"
)
SPATIAL_PATTERN = (
    r"not within (?:the )?(?:longitude|latitude) bounds|"
    r"longitude frame|outside (?:the )?(?:spatial|longitude|latitude) "
    r"bounds|invalid bounding box|\b(?:longitude|latitude)\b"
)
INPUT_PATTERN = (
    r"invalid (?:input|parameter)|missing (?:input|parameter)|"
    r"not found|unavailable|permission denied|access denied|"
    r"cannot create TimeComponentsParameter"
)
SCHEDULER_PATTERN = r"\b(?:slurm|drmaa|scheduler|sbatch|srun|squeue)\b"
FAILURE_CATEGORIES = (
    ("memory", MEMORY_PATTERN),
    ("timeout", TIMEOUT_PATTERN),
    ("no-data", NO_DATA_PATTERN),
    ("spatial", SPATIAL_PATTERN),
    ("input", INPUT_PATTERN),
    ("scheduler", SCHEDULER_PATTERN),
)
GENERIC_FAILURE_PATTERN = (
    r"^(?:NoApplicableCode\s+(?:None\s+)?)?"
    r"(?:Process failed, please check server error log|Process error: unknown)\s*$"
)
PRIORITY_CATEGORIES = ("memory", "timeout")

# -- root-cause messages --------------------------------------------------------
ROOT_TIME_LIMIT = r"slurmstepd: error: \*{3} JOB .+? DUE TO TIME LIMIT \*{3}"
ROOT_CANCELLED = r"slurmstepd: error: \*{3} JOB .+? CANCELLED AT .+? \*{3}"
ROOT_OOM = r"slurmstepd: error: Detected [1-9][0-9]* oom-kill event\(s\)[^.]*\.?"
ROOT_NO_DATA = (
    r"There were no valid data points found in the requested subset\."
    r"(?: Please expand the area covered by the bounding box, the time period "
    r"or the level range you have selected\.)?"
)
MISSING_DATETIMES_TEXT = "Requested datetimes include some not found in the dataset"
MISSING_DATETIME_YEAR = r"cftime\.[A-Za-z0-9_]+\s*\(?\s*([12][0-9]{3})\s*,"
MISSING_YEARS_PREFIX = "Requested years not found in dataset: "
TIME_COMPONENTS_PREFIX = r"Cannot create TimeComponentsParameter from:\s*"
TIME_COMPONENTS_LABEL = "Invalid time components: "
TRACEBACK_BOUNDARY = (
    r"\s+(?:During handling of the above exception|Traceback \(most recent call last\))"
)
EXCEPTION_TEXT = (
    r"(?:ProcessError|ValueError|MemoryError|TimeoutError):\s*"
    r"(.+?)(?:\s+During handling|\s+Traceback|$)"
)
UNKNOWN_FAILURE = "unknown failure"

# -- text limits ------------------------------------------------------------------
MAX_DETAIL_LENGTH = 300
TRUNCATION_MARKER = " [..]"
MAX_VALUE_LENGTH = 1000
MAX_COMPLEX_VALUE_LENGTH = 65536
DIAGNOSTIC_TAIL_BYTES = 8000
OOM_TAIL_BYTES = 262144
MAX_NAME_COMPONENT = 80
EXAMPLE_JOBS = 3

# -- log messages -------------------------------------------------------------------
LOG_FIELD = r"(?:^|\s)([A-Za-z_][A-Za-z0-9_-]*)=(\S+)"
NULL_FIELD_VALUES = ("none", "unknown")
SCHEMA_VERSION = 1

# -- workflow payloads -----------------------------------------------------------------
STEP_OUTPUT = r"^[A-Za-z0-9_.-]+/output$"
COMPONENT_YEARS = r"(?:^|\|)year:([^|]+)"
YEAR = r"\b[12][0-9]{3}\b"

# -- identifiers and documents ----------------------------------------------------------
UUID_PATTERN = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-"
    r"[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"
)
UUID_EPOCH_100NS = 122192928000000000
INCIDENT_NAME = (
    r"^[0-9]{8}T[0-9]{6}Z__(error|recovered)__.+__"
    r"([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})\.xml$"
)
OOM_MARKER = (
    r"slurmstepd: error: Detected [1-9][0-9]* oom-kill event\(s\) in StepId=\S+\."
)
RECOVERED_MARKERS = ("stalled-job recovery", "repeated polling")
FINAL_DOCUMENT_STATES = {"ProcessSucceeded": "successful", "ProcessFailed": "failed"}
DOCUMENT_STATUS = {
    "ProcessAccepted": "accepted",
    "ProcessStarted": "running",
    "ProcessPaused": "running",
    "ProcessSucceeded": "successful",
    "ProcessFailed": "failed",
}
STATUS_NAMES = ("accepted", "running", "successful", "failed", "dismissed", "unmapped")

# -- access log ------------------------------------------------------------------------------
ACCESS_LOG_LINE = (
    r'^(\S+) \S+ \S+ \[([^]]+)\] "(\S+) (\S+) ([^"]+)" (\d{3})(?:\s|$)'
)

# -- queue --------------------------------------------------------------------------------------
USABLE_NODE_STATES = ("allocated", "completing", "idle", "mixed")
NODE_STATE_FLAGS = "*~#!%$@^-+"
MEMORY_UNIT_BYTES = {
    "": 1048576,
    "B": 1,
    "K": 1024,
    "M": 1048576,
    "G": 1073741824,
    "T": 1099511627776,
    "P": 1125899906842624,
}
GIB = 1073741824

# -- recovery messages ------------------------------------------------------------------------------
MESSAGE_XML_OOM = (
    "Process failed: stalled-job recovery detected that Slurm "
    "terminated the worker after it exceeded its memory allocation."
)
MESSAGE_XML_STALLED = (
    "Process failed: stalled-job recovery found no status update "
    "for at least {minutes:g} minutes."
)
MESSAGE_DB_STARTED = (
    "Process failed: stalled-job recovery found no database "
    "update for at least {minutes:g} minutes."
)
MESSAGE_DB_ACCEPTED = (
    "Process failed: stalled-job recovery found an accepted "
    "database request that did not advance for at least {hours:g} hours."
)
MESSAGE_POLLING = (
    "Process failed: repeated polling found that this status document "
    "was not created. The request can no longer be monitored."
)

# -- daily statistics ------------------------------------------------------------------------------------
DAILY_COLUMNS = (
    "date",
    "service",
    "requests",
    "successful",
    "failed",
    "duration_count",
    "duration_total_seconds",
    "duration_median_seconds",
    "duration_p95_seconds",
    "duration_max_seconds",
    "memory_failures",
    "timeout_failures",
    "recovered_jobs",
    "long_running_jobs",
    "operation_errors",
)

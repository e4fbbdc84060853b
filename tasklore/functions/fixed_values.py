"""Word lists, patterns, texts and limits that results depend on.

Nothing here is logic. Values are kept together, in natural order, so they can be reviewed and
overridden by passing another value to the function that uses them.
"""

# ---------------------------------------------------------------- limits and defaults (fixed values)
MAX_LOG_LINES = 1000  # the tail that callers may ask for; nothing applies it by default
BASELINE_RUNS = 3
BASELINE_REFRESH_DAYS = 7
BASELINE_RETENTION_DAYS = 30
LOOKBACK_MINUTES = 60
PREVIEW_CHARS = 100
SHORT_TEXT_CHARS = 160
CONTEXT_LINES = 10
SHORT_CONTEXT_LINES = 5
MIN_TRAINING_EXAMPLES = 50
AUTO_EXPORT_THRESHOLD = 50
TREE_DEPTH = 4
TREE_SIMILARITY = 0.4
TREE_MAX_CHILDREN = 100
TREE_MAX_CLUSTERS = 1024

# ---------------------------------------------------------------- enumerations (fixed values)
SEVERITIES = ["low", "medium", "high", "critical"]
CATEGORIES = [
    "resource_error",
    "data_quality",
    "dependency_failure",
    "configuration_error",
    "permission_error",
    "timeout_error",
    "unknown",
]
CANDIDATE_STATUSES = ["pending", "approved", "rejected", "modified"]
ALERT_SEVERITIES = ["high", "critical"]

# ---------------------------------------------------------------- log parsing (fixed values)
LOG_LEVELS = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL", "FATAL"]
DEFAULT_LEVEL = "INFO"
LOG_SOURCE = "airflow"
ERROR_LEVELS = ["ERROR", "CRITICAL", "FATAL"]
ERROR_KEYWORDS = ["error", "exception", "failed", "failure", "fatal", "critical"]

# A hit stands alone: no letter or digit directly before or after it. Written as negative look-around,
# which accepts the same places as "another character or the text's edge" and scans about five times faster.
# Each pattern starts with a look-ahead for its own first characters, so most places fail on one test.
ALONE_BEFORE = r"(?<![A-Za-z0-9])"
ALONE_AFTER = r"(?![A-Za-z0-9])"

# Three or more groups of six or more lower-case hex digits, each followed by an optional blank. The
# plain form ([0-9a-f]{6,} ?){3,} splits one long run in exponentially many ways before it fails, so the
# same language is spelled out by run length (18 = three groups, 12 = two) and reads each run once.
HEX_RUNS = (
    r"(?:[0-9a-f]{18,}+|[0-9a-f]{12,}+ [0-9a-f]{6,}+|[0-9a-f]{6,}+ [0-9a-f]{12,}+"
    r"|[0-9a-f]{6,}+ [0-9a-f]{6,}+ [0-9a-f]{6,}+)(?: [0-9a-f]{6,}+)* ?"
)

# Ordered masks: (pattern, name). Java syntax.
MASKS = [
    (r"(?=[0-9a-f]{2})" + ALONE_BEFORE + r"(?:[0-9a-f]{2,}:){3,}[0-9a-f]{2,}" + ALONE_AFTER, "ID"),
    (r"(?=\d{1,3}\.)" + ALONE_BEFORE + r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}" + ALONE_AFTER, "IP"),
    (r"(?=[0-9a-f]{6})" + ALONE_BEFORE + HEX_RUNS + ALONE_AFTER, "SEQ"),
    (r"(?=[0-9A-F]{4})" + ALONE_BEFORE + r"(?:[0-9A-F]{4} ?){4,}" + ALONE_AFTER, "SEQ"),
    (r"(?=0x)" + ALONE_BEFORE + r"0x[a-f0-9A-F]+" + ALONE_AFTER, "HEX"),
    (r"(?=[-+\d])" + ALONE_BEFORE + r"[-+]?\d+" + ALONE_AFTER, "NUM"),
    (r'(?<=executed cmd )".+?"', "CMD"),
]
MASK_PREFIX = "<:"
MASK_SUFFIX = ":>"
EXTRA_DELIMITERS = ["_"]
WILDCARD = "<*>"

# ---------------------------------------------------------------- filter rules (fixed values)
# (kind, pattern, description); kinds as in functions.rules.
DEFAULT_RULES = [
    ("regex", r".*DEBUG.*", "Debug level logs"),
    ("regex", r".*Starting.*", "Startup messages"),
    ("regex", r".*Finished.*", "Completion messages"),
    ("substring", "Marking task as SUCCESS", "Airflow success"),
    ("substring", "Task exited with return code 0", "Successful exit"),
    ("substring", "Dependencies all met for", "Airflow dependencies"),
    ("substring", "UserWarning", "Non-critical warning"),
    ("substring", "DeprecationWarning", "Deprecation warning"),
    ("length_threshold", "10", "Very short messages"),
]

SHIPPED_RULES = [
    ("regex", r".*\b(Starting|starting|started)\b.*", "Startup messages"),
    ("regex", r".*\b(Finished|finished|completed|done)\b.*", "Completion messages"),
    ("substring", "Marking task as SUCCESS", "Airflow success messages"),
    ("substring", "Task exited with return code 0", "Successful task completion"),
    ("substring", "Dependencies all met for", "Airflow dependency checks"),
    ("substring", "Airflow task starting", "Airflow task initialization"),
    ("substring", "Job completed successfully", "Job success messages"),
    ("regex", r"Task:<Task[^>]*> dag:<DAG:[^>]*> dagrun:<DagRun[^>]*state:[^>]*>", "Airflow tasinstance info"),
    ("substring", "downstream tasks scheduled", "Airflow taskinstance scheduled check"),
    ("substring", "UserWarning", "Non-critical user warnings"),
    ("substring", "DeprecationWarning", "Deprecation warnings"),
    ("substring", "PendingDeprecationWarning", "Pending deprecation warnings"),
    ("substring", "FutureWarning", "Future compatibility warnings"),
    ("substring", "YAHOOOOOOOOOOOOOOOOOOOOOOO", "TPT celebration message"),
    ("substring", "Task failed with exception", "TPT generic failure message - often not the real error"),
    ("starts_with", "Running TPT command:", "TPT command execution"),
    ("substring", "Teradata Parallel Transporter Version", "TPT version information"),
    ("substring", "Total processor time used", "TPT performance stats"),
    ("substring", "sending SQL requests", "TPT SQL activity"),
    ("substring", "Elapsed time", "TPT timing information"),
    ("substring", "(status 12)", "TPT status codes"),
    ("substring", "private log not specified", "TPT configuration message"),
    ("substring", "TPT Exit code set to", "TPT exit status"),
    ("starts_with", "Running: ", "Command execution messages"),
    ("substring", "no error details were provided.", "TPT generic error message"),
    ("substring", "Details of the failure can be found", "TPT error reference message"),
    ("substring", "Connection established", "Database connection success"),
    ("starts_with", "Connected to", "Connection success messages"),
    ("substring", "Login successful", "Authentication success"),
    ("length_threshold", "10", "Messages shorter than 10 characters"),
    ("starts_with", "Progress:", "Progress update messages"),
    ("starts_with", "Status:", "Status update messages"),
    ("regex", r"\d+%\s+(complete|done|finished)", "Percentage completion messages"),
]

# Notification spam: six phrases; the older five-phrase variant is the same list without the last one.
NOTIFICATION_SPAM = [
    "Notification sent successfully",
    "SMS delivered",
    "Email queued",
    "Alert triggered for the same error",
    "Rate limit applied",
    "Duplicate alert suppressed",
]

# Configuration-noise phrases; names in braces are filled from the caller's settings.
CONFIG_NOISE = ["timezone offset {offset}", "Using {provider} provider", "Configuration loaded"]
SSL_OFF_NOISE = "SSL verification disabled"
SSL_ON_NOISE = "SSL verification enabled"
TIMEZONE_NOISE = ["timezone offset {offset}", "Converting timezone", "UTC offset applied"]
SCHEDULER_NOISE = ["Connecting to {base_url}", "Using timeout {timeout}", "{ssl}", "Configuration loaded successfully"]
MODEL_NOISE = ["Using {provider} as default provider", "Model loaded successfully", "LLM engine initialized", "Temperature set to"]
CLUSTERING_NOISE = ["Drain3 depth: {depth}", "Similarity threshold: {similarity}", "Cluster created", "Template matched", "Persistence saved"]

STANDARD_LINE_EXEMPT = "Caused by"
STANDARD_LINE_STARTS = ["[", "$"]
STANDARD_LINE_CODE = r"TPT\d+"
DEBUG_WORD_RULE = (r".*\b(DEBUG|debug)\b.*", "Debug messages (not in debug mode)")
SMS_OFF_RULE = ("SMS.*disabled", "SMS disabled messages")

# ---------------------------------------------------------------- error score (fixed values)
DEFAULT_INDICATORS = [
    "error", "exception", "failed", "failure", "fatal", "critical", "traceback",
    "stack trace", "connection refused", "timeout", "permission denied", "not found",
    "invalid", "corrupt",
]
SHIPPED_INDICATORS = [
    "error", "exception", "failed", "failure", "fatal", "critical", "traceback",
    "stack trace", "connection refused", "timeout", "permission denied", "not found",
    "invalid", "corrupt", "null pointer", "out of memory", "access denied",
    "authentication failed", "authorization failed", "sql error", "database error",
    "network error", "file not found", "cannot connect", "connection lost", "unexpected",
    "aborted", "cancelled", "interrupted",
]
SHIPPED_SCORE_LEVELS = ["ERROR", "CRITICAL", "FATAL", "SEVERE", "WARN"]
DEFAULT_SCORE_THRESHOLD = 0.3
SHIPPED_SCORE_THRESHOLD = 0.2
LEVEL_SCORE = 0.8
INDICATOR_SCORE = 0.2
INDICATOR_SCORE_CAP = 0.6
TRACE_SCORE = 0.3
TRACE_MARKS = ["\n", "Traceback", "Exception in thread"]

# ---------------------------------------------------------------- categorisation (fixed values)
# First set: ordered (category, any of these terms).
CATEGORY_TERMS = [
    ("configuration_error", ["tpt", "tbuild", "command line"]),
    ("timeout_error", ["timeout", "connection timed out"]),
    ("data_quality", ["no such file", "missing", "not found"]),
    ("resource_error", ["deadlock", "abort"]),
    ("configuration_error", ["hostname", "lookup", "connection"]),
]
HIGH_SEVERITY_TERMS = ["critical", "fatal", "hostname lookup"]
REASONING = {
    "configuration_error": "Configuration or setup issue detected",
    "timeout_error": "Network timeout indicates connectivity problems",
    "data_quality": "Missing or malformed data dependency",
    "resource_error": "Database resource contention detected",
    "unknown": "Error type requires further investigation",
}
REASONING_DEFAULT = "Error analysis needed"

# Second set: ordered (all-of groups of any-of terms, category, severity, confidence, reasoning).
CATEGORY_TERMS_V2 = [
    ([["timeout", "connection"]], "resource_error", "high", 0.9,
     "Network connectivity or timeout issue detected in error message."),
    ([["file"], ["missing", "not found"]], "data_quality", "medium", 0.85,
     "Missing file or data source availability issue."),
    ([["tpt"], ["error"]], "dependency_failure", "high", 0.88,
     "TPT (Teradata Parallel Transporter) tool failure."),
    ([["ssh"]], "resource_error", "high", 0.92, "SSH connection failure to remote host."),
    ([["bash command failed"]], "dependency_failure", "medium", 0.75, "Shell command execution failure."),
]
CATEGORY_V2_DEFAULT = ("unknown", "medium", 0.6, "Unable to classify error with high confidence.")

# ---------------------------------------------------------------- answers and results (fixed values)
NO_DETAILS = "No error details available"
NO_PATTERNS = "No error patterns identified"
NO_LOGS = "No failed logs found"
REVIEW_MANUALLY = "Review logs manually"
EMPTY_ANSWERS = ["no error", "none", "unknown"]
UNKNOWN_ERROR = "Unknown error"
FALLBACK_PREFIX = "Analysis failed: "
FALLBACK_ACTIONS = ["Manual analysis required", "Check logs manually"]
FALLBACK_REASONING = "LLM analysis failed"
NO_STEPS = "Manual investigation required"
NO_ANSWER_STEPS = ["Manual investigation required", "Check system logs", "Contact support"]

# ---------------------------------------------------------------- training rows (fixed values)
INSTRUCTION = (
    "You are an expert data engineer analyzing Airflow ETL task failure logs "
    "from a telecom data warehouse. Analyze the log and extract the root cause error.\n\n"
    "Common error patterns:\n"
    "- TPT (Teradata Parallel Transporter) errors: Configuration issues, command line problems\n"
    "- SSH/SFTP timeouts: Network connectivity to data sources\n"
    "- Missing data files: Upstream data dependencies (MSISDN files, reports)\n"
    "- Teradata database issues: Deadlocks, hostname lookups, connection failures\n"
    "- BTEQ command failures: SQL execution problems\n\n"
    "Respond with JSON containing error_message, confidence, category, severity, reasoning, and error_lines."
)
FEEDBACK_INSTRUCTION = "Analyze the Airflow ETL error and extract the root cause in JSON format."
EXTRACTION_HEAD = (
    "You are an expert data engineer analyzing Airflow ETL task failure logs. "
    "Extract the core error message from the log context below. "
    "Focus on the essential technical error, removing timestamps and verbose details.\n\n"
    "Log Context:\n"
)
EXTRACTION_TAIL = "\n\nExtract the core error message:"
CHAT_SYSTEM = (
    "You are an expert data engineer analyzing Airflow ETL task failure logs. "
    "Extract the core error message from log context."
)
REVIEWED_STATUSES = ["approved", "modify", "modified"]

# ---------------------------------------------------------------- evaluation (fixed values)
ANSWER_PREFIXES = ["Error:", "The error is:", "Core error:", "Error message:"]
TERM_PATTERNS = [
    r"TPT\d+",
    r"Error \d+",
    r"timeout|connection|failed|missing|not found|deadlock",
    r"[A-Z_]+\[[^\]]+\]",
]
QUOTED_PATTERN = r'"([^"]*)"'
TERM_RECALL = 0.7

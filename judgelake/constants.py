"""Fixed values the results depend on."""

# Severity level names, finding categories, rubrics.
SEVERITY_NAMES = ["none", "MINOR", "MAJOR", "BLOCKER"]
CATEGORIES = ["bug-risk", "security", "style", "performance", "test-gap", "other"]
CHANGE_TYPES = ["code-change", "deletion-only", "whole-file-deleted"]
DELETION_CHANGE_TYPES = ["deletion-only", "whole-file-deleted"]

# Gates.
CODE_THRESHOLD = 0.50
DELETION_THRESHOLD = 0.70
REFLEX_GATE = 0.80
JITTER_ZONE = 0.03
REPORT_CAP = 5
HELD_CLASSES = ["test"]
THRESHOLD_GRID = [0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70]
MARGIN_FLOOR = 0.20
MIN_RUNS_PER_FIXTURE = 3

# Path triage patterns.
LOCK_NAMES = (
    r"package-lock\.json|yarn\.lock|Cargo\.lock|poetry\.lock|"
    r"pnpm-lock\.yaml|uv\.lock|Gemfile\.lock|composer\.lock|Pipfile\.lock|"
    r"flake\.lock|bun\.lockb?|go\.sum"
)
LOCK_NAMES_PATTERN = rf"(^|/)({LOCK_NAMES})$"
SKIP_NAMES_PATTERN = rf"(^|/)({LOCK_NAMES}|LICENSE|COPYING|\.gitignore|\.editorconfig)$"
SKIP_DIRS_PATTERN = r"(^|/)(dist|build|target|node_modules|\.min\.(js|css))(/|$)"
SKIP_ROOT_PATTERN = r"^(CHANGELOG|AUTHORS|CONTRIBUTORS)"
DOC_PATTERN = r"(?i)\.(md|mdx|txt|rst|adoc)$"
DATA_PATTERN = r"(?i)\.(jsonl|ndjson|csv|tsv|snap)$"

# Directory names and file name parts of test files.
TEST_DIRS = ["tests", "test", "__tests__", "__mocks__", "spec", "specs", "e2e"]

# Size rules.
MAX_UNIT_LINES = 120
FALLBACK_WINDOW_LINES = 120
SITE_SIZE_FLOOR = 16
SITE_FLOORS = [16, 64, 256]
SITE_EXPANSION_ENVELOPE = 10.0
SITE_MEDIAN_FORBIDDEN_LINES = 120
SOFT_CAP_TOKENS = 28_000
HARD_CAP_TOKENS = 56_000
CHARS_PER_TOKEN = 3.0
CALL_FAIL_LIMIT = 2
CONTEXT_LINES = 4
DIFF_CONTEXT = 3
INPUT_MAX_FILES = 2000
INPUT_MAX_TOTAL_LINES = 1_000_000
INPUT_MAX_FILE_CHARS = 2 * 1024 * 1024
INPUT_MAX_FILE_LINES = 20_000
INPUT_MAX_LINE_CHARS = 100_000
INPUT_MAX_LABEL_CHARS = 200
INPUT_MAX_PATH_CHARS = 1024
INPUT_CAPS = {"max_chars": INPUT_MAX_FILE_CHARS, "max_lines": INPUT_MAX_FILE_LINES, "max_line_chars": INPUT_MAX_LINE_CHARS}
BODY_MAX = 4000
PATH_REPR_MAX = 120
SYMBOL_TABLE_MAX = 40
CONTEXT_WINDOW_LINES = 20

# Wire formats in rising precedence, and the vocabulary of each era.
WIRE_FORMATS = ["hunk", "line-window", "ast-units", "ts-units", "sites"]
WIRE_FORMATS_BY_VERSION = {
    "v08-ast": ["hunk_state-v1", "ast-units-v1"],
    "v09": ["hunk", "line-window", "ast-units", "ts-units", "sites"],
}
RUBRIC_VERSIONS = ["v03b", "v08-ast", "v09"]
DEFAULT_PACKAGING_VERSION = "v09"

# File extensions each enrichment covers.
ENRICHABLE_EXTENSIONS = {"ast": ["py"], "ts-ast": ["ts", "tsx", "js", "jsx", "mjs", "cjs"]}

# Corpus enumerations, id and sha formats, split rule.
KINDS = ["positive", "clean"]
SPLITS = ["train", "holdout"]
SOURCES = ["fix-pr", "thread-fix", "session", "injected", "promoted"]
SEVERITY_CLASSES = ["blocker", "major", "minor"]
LABELS = ["real-bug", "style", "false-positive", "unclear"]
DISMISSED_LABELS = ["style", "false-positive"]
DISMISSAL_REASONS = ["missing-context", "test-code", "style-nit", "hallucinated",
                     "change-reaction", "duplicate", "other"]
SAMPLE_ID_PATTERN = r"^([\w.-]+/[\w.-]+)#(\d+)@(pre|final)$"
SHA40_PATTERN = r"^[0-9a-f]{40}$"
HOLDOUT_MOD, HOLDOUT_BELOW = 10, 3
HOLDOUT_SHARE_LOW, HOLDOUT_SHARE_HIGH, HOLDOUT_MIN_PRS = 0.25, 0.35, 10

# Table columns of the corpus files and of the spot-check sheet.
PRS_COLUMNS = ["sample_id", "repo", "base_sha", "head_sha", "kind", "split", "source"]
ISSUE_COLUMNS = ["sample_id", "file", "line", "verify_substring", "severity_class",
                 "category", "evidence", "fix_sha", "adjudicator", "spot_checked"]
DISMISSED_COLUMNS = ISSUE_COLUMNS + ["label", "dismissal_reason"]
ADJUDICATION_COLUMNS = ["run_label", "arm", "file", "line_start", "line_end",
                        "unit_stamp", "is_real", "verdict", "adjudicator", "note"]
SPOT_CHECK_COLUMNS = ["candidate_id", "why", "thread", "code", "disposition", "label",
                      "severity", "evidence", "verdict", "correct_label", "note"]
SPOT_CHECK_GATE = 0.85
HUMAN_ADJUDICATOR, AUTO_ADJUDICATOR = "human", "claude"

# Follow-up comment header, bullet status and hunk header formats.
FOLLOW_UP_HEADER = "## /fix-pr follow-up"
STATUS_PATTERN = r"\*\*(Fixed|Not applied)\b[^*]*\*\*"
ZERO_CONTEXT_HUNK_PATTERN = r"(?m)^@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@"
HUNK_HEADER_PATTERN = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
DECLARED_NAME_PATTERN = r"\b(?:def|class|function|const|let|var)\s+([A-Za-z_]\w*)"
IMPORT_PATTERN = r"^\s*(?:from\s+([\w.]+)\s+import\s+(.+)|import\s+([\w.,\s]+))"

# The miss reasons in reporting order.
MISS_BUCKETS = ["anchor-offset", "judged-below-threshold", "judged-low-severity",
                "held-test", "skipped-triage", "truncated", "not-judged"]

# A/B decision rule.
AB_PRECISION_MARGIN = 1
AB_RECALL_GAIN = 2
AB_MIN_NONZERO = 6
AB_SIGNIFICANCE = 0.05

# Sustained-rate rules.
SHIP_RATE, SHIP_MIN = 0.70, 10
RETIRE_RATE, RETIRE_WINDOW = 0.50, 10
ARM_STOP_FINDINGS, ARM_STOP_PRS = 10, 15

"""Fixed values. They must equal the reference's for results to agree."""

from __future__ import annotations

# Fixed: severities, most severe first, with the default score weight of each.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
SEVERITY_WEIGHTS = {"critical": 10.0, "high": 5.0, "medium": 2.0, "low": 0.5, "info": 0.0}
CROSS_WEIGHTS = {"critical": 15.0, "high": 8.0, "medium": 4.0}
PENALTY_CAPS = {"category": 90.0, "total": 95.0}
COMPLEXITY_SCALING = {"low_threshold": 5.0, "low_factor": 0.5, "high_threshold": 20.0, "high_factor": 1.5}
CATEGORY_FLOOR = 10
TOTAL_FLOOR = 5

# Fixed: built-in review domains in priority order.
DOMAINS = [
    "security",
    "architecture",
    "performance",
    "maintainability",
    "deadCode",
    "testIntelligence",
    "pragmatism",
    "logic",
]
RESERVED_DETECTOR_NAMES = ["combined", "architect"]
DOMAIN_ALIASES = {"architect": "architecture"}
MODE_OVERRIDES = {"ghost": ["deadCode"], "onboard": ["architecture", "maintainability"]}

# Fixed: near-duplicate thresholds.
NEAR_LINES = 60
SAME_AGENT_BAR = 0.5
CROSS_AGENT_BAR = 0.7

# Fixed: default ignore rules; the tool's own state folder is added by the caller.
DEFAULT_IGNORES = [
    "node_modules",
    "dist",
    "build",
    ".git",
    "*.lock",
    "*.min.js",
    "*.min.css",
    "coverage",
]

# Fixed: file extension to language.
LANGUAGE_BY_EXTENSION = {
    ".ts": "typescript",
    ".tsx": "typescript",
    ".mts": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".hpp": "cpp",
    ".py": "python",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".cs": "csharp",
    ".rb": "ruby",
    ".php": "php",
    ".swift": "swift",
    ".kt": "kotlin",
    ".dart": "dart",
}
HASH_COMMENT_LANGUAGES = ["python", "ruby"]
MAX_FILE_BYTES = 2 * 1024 * 1024

# Fixed: chunking and batching.
CHARS_PER_TOKEN = 4
MAX_CHUNK_TOKENS = 6000
SPLIT_MARGIN = 0.85
WINDOW_LINES = 150
WINDOW_OVERLAP = 30
BRACE_MAX_LINES = 300
BRACE_MIN_LINES = 5
MAX_CHUNKS_PER_FILE = 50
SOFT_BATCH_TOKENS = 16000
COMBINED_SOFT_TOKENS = 6000
COMBINED_HARD_TOKENS = 3000
REVIEW_TOKEN_BUDGET = 200_000

# Fixed: words that carry no retrieval signal.
STOP_WORDS = [
    "async",
    "await",
    "class",
    "const",
    "export",
    "from",
    "function",
    "import",
    "interface",
    "return",
    "type",
]

# Fixed: import resolution order.
RESOLVE_EXTENSIONS = [".ts", ".tsx", ".mjs", ".mts", ".js", ".jsx", ".cjs", ".cts"]
REEXPORT_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx"]

# Fixed: repository facts.
VALIDATOR_LIBS = [
    "zod",
    "joi",
    "yup",
    "ajv",
    "valibot",
    "class-validator",
    "express-validator",
    "sanitize-html",
    "xss",
    "dompurify",
    "validator",
]
FACT_CAPS = {"cycles": 10, "tested": 40, "public_api": 60, "public_api_shown": 30, "build": 40, "globals": 15}

# Fixed: wording that hardens or relaxes code, whole words.
HARDEN_WORDS = [
    "add",
    "throttle",
    "encrypt",
    "validate",
    "lock",
    "strict",
    "check",
    "boundary",
    "limit",
    "ensure",
    "harden",
    "guard",
    "require",
    "prevent",
    "enforce",
    "sanitize",
    "escape",
    "restrict",
    "fail-safe",
    "timeout",
    "reject",
    "deny",
    "authenticate",
    "authorize",
]
RELAX_WORDS = [
    "remove",
    "skip",
    "fast-path",
    "relax",
    "bypass",
    "inline",
    "delete",
    "cache",
    "memoize",
    "omit",
    "drop",
    "ignore",
    "simplify",
    "fast",
    "assume",
    "allow",
    "permit",
    "shortcut",
    "optimize",
    "lazy",
    "defer",
    "speed",
    "permissive",
]

# Fixed: (path pattern, points) of the risk score, on the lowercased path.
RISK_PATTERNS = [
    ("auth|login|session|token|password|secret|key", 10.0),
    ("api|route|handler|controller|endpoint", 8.0),
    ("service|repository|dao|store", 6.0),
    ("middleware|interceptor|guard|acl|permission|policy|tenant|scope|rbac|access", 8.0),
    ("runtime|vm|sandbox|exec|spawn|crypto|eval", 10.0),
    ("payment|billing|stripe|webhook", 9.0),
    ("util|helper|common|shared", 4.0),
    ("config|env|settings", 7.0),
    ("test|spec|mock|fixture", -5.0),
]
RISK_TYPE_PATTERN = "type|interface|dto"
RISK_BOUNDARY_SUBJECT = "auth|user|payment|session|security|permission|policy|rbac"

# Fixed: USD per million tokens, input and output.
PRICES = [
    ("opencode-zen:deepseek-v4-flash-free", 0.0, 0.0),
    ("groq:llama-3.3-70b-versatile", 0.59, 0.79),
    ("groq:llama-3.1-8b-instant", 0.05, 0.08),
    ("cerebras:llama3.1-8b", 0.1, 0.1),
    ("cerebras:llama-3.3-70b", 0.6, 0.6),
    ("cerebras:gpt-oss-120b", 0.25, 0.69),
    ("openrouter:deepseek/deepseek-r1", 0.55, 2.19),
    ("openrouter:nvidia/nemotron-3-super-120b-a12b:free", 0.0, 0.0),
    ("nvidia:minimaxai/minimax-m3", 0.0, 0.0),
    ("ollama:", 0.0, 0.0),
]
DEFAULT_MODELS = {
    "opencode-zen": "deepseek-v4-flash-free",
    "groq": "llama-3.3-70b-versatile",
    "cerebras": "gpt-oss-120b",
    "openrouter": "openrouter/free",
    "nvidia": "minimaxai/minimax-m3",
    "ollama": "",
}
OUTPUT_TOKENS_PER_CALL = 400
SYNTHESIS_TOKENS = (2000, 1000)

# Fixed: phrases of an exhausted quota.
QUOTA_PHRASES = [
    "per day",
    "per-day",
    "daily limit",
    "quota exceeded",
    "out of quota",
    "insufficient_quota",
    "monthly limit",
]

# Fixed: score bands (lower bound, grade) and (lower bound, colour).
GRADE_BANDS = [(90, "A+"), (80, "A"), (75, "B+"), (70, "B"), (60, "C"), (40, "D")]
COLOUR_BANDS = [(90, "brightgreen"), (80, "green"), (60, "yellow"), (40, "orange")]

# Fixed: map keys whose values are secrets, and sections of the onboarding text.
SECRET_KEY_PARTS = ["apikey", "key", "token", "secret", "password", "authorization"]
ONBOARD_MARKERS = ["## ARCHITECTURE.md", "## DATA_FLOWS.md", "## DANGER_ZONES.md", "## GOTCHAS.md"]

WATCHED_FILES = 200

"""Rule tables as data: label and the substrings that select it, first match wins."""

from __future__ import annotations

# Language by file suffix.
LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".java": "Java",
    ".go": "Go", ".rs": "Rust", ".kt": "Kotlin", ".kts": "Kotlin", ".rb": "Ruby", ".php": "PHP", ".cs": "C#", ".cpp": "C++",
    ".c": "C", ".h": "C/C++ Header", ".sql": "SQL", ".md": "Markdown", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML",
    ".sh": "Shell", ".dockerfile": "Dockerfile",
}
NON_SOURCE = ("Text", "Markdown", "JSON", "YAML", "Dockerfile", "SQL")

# Path parts, names and suffixes that a scan skips.
IGNORED_PARTS = (
    ".git .hg .svn node_modules dist build __pycache__ .venv venv vendor coverage .next target .pytest_cache .mypy_cache .ruff_cache "
    ".idea .vscode data reports sample_repos compiled fixtures snapshots"
).split()
IGNORED_NAMES = "BENCHMARK_RESULTS.md FINAL_VERIFICATION_REPORT.md PRODUCT_REVIEW.md RELEASE_CANDIDATE_REPORT.md".split()
IGNORED_SUFFIXES = "png jpg jpeg gif webp ico pdf zip tar gz 7z woff woff2 ttf mp4 mov sqlite sqlite3".split()
LOW_VALUE_PARTS = "test tests docs doc docs_src examples example fixtures fixture".split()

# Layers of a path, in four dialects with their own order.
KNOWLEDGE_LAYERS = [
    ("interface", ("route", "api", "controller", "main.py")), ("data", ("db", "store", "model", "schema", "migration")),
    ("security", ("security", "auth", "session", "jwt")), ("test", ("test", "spec")), ("presentation", ("component", "page", "frontend")),
]
EVOLUTION_LAYERS = [
    ("api", ("api", "route", "controller", "main.py")), ("data", ("db", "model", "schema", "migration", "store")),
    ("security", ("auth", "security", "secret", "jwt")), ("infra", ("docker", ".github", "deploy", "terraform", "k8s")),
    ("ui", ("component", "page", "frontend", "ui")), ("test", ("test", "spec")),
]
REVIEW_LAYERS = [
    ("security", ("auth", "security", "session", "jwt")), ("interface", ("route", "api", "controller", "main.py")),
    ("data", ("db", "model", "schema", "migration", "store")), ("test", ("test", "spec")), ("presentation", ("component", "page", "frontend")),
]
EXPLORER_LAYERS = [
    ("Frontend", ("component", "page", "frontend", "ui")), ("API", ("route", "api", "controller", "main.py")),
    ("Service", ("repository", "store", "service", "client")), ("Database", ("model", "schema", "migration", "db")),
    ("Security", ("auth", "security", "jwt", "session")),
]
OWNERS = [
    ("Security Platform", ("auth", "security", "session")), ("Data Platform", ("db", "model", "data", "store")),
    ("Product Experience", ("front", "ui", "component", "page")), ("Infrastructure", ("infra", "deploy", "docker", "ci")),
]
DOMAIN_ROLES = [
    ("API boundary", ("route", "api", "controller", "endpoint")), ("Data layer", ("db", "model", "schema", "migration")),
    ("User experience", ("component", "page", "frontend", "ui")), ("Trust boundary", ("security", "auth", "login", "session")),
    ("Verification", ("test", "spec")),
]
SERVICE_TEXTS = [
    ("Sign-in and trust checks", ("auth", "security")), ("Files that come in", ("upload", "file")),
    ("Payments and bills", ("payment", "billing", "stripe")),
    ("Stored state", ("store", "repository", "db")), ("Requests from outside", ("api", "route", "main.py")),
]
NESTED_ROOTS = ("src", "app", "backend", "frontend")

# Scanner rules (id, pattern, message); patterns are read alike by Java and RE2.
LINE_RULES = [
    ("hardcoded-secret", r"(?i)(api[_-]?key|secret|token|password)\s*[:=]\s*['\"][^'\"\n]{8,}['\"]", "Possible hardcoded credential."),
    ("python-eval", r"\beval\s*\(", "Use of eval can execute arbitrary code."),
    ("python-exec", r"\bexec\s*\(", "Use of exec can execute arbitrary code."),
    ("shell-true", r"shell\s*=\s*True", "Subprocess shell=True increases injection risk."),
    ("js-inner-html", r"innerHTML\s*=", "Direct innerHTML assignment can enable XSS."),
    ("sql-format", r"(?i)SELECT\s+.+(%|\\.format|f['\"])", "Possible dynamic SQL string construction."),
]
ENTROPY_TOKEN = r"['\"]([A-Za-z0-9_\-]{32,})['\"]"
REDACT_ASSIGNMENT = r"(?i)\b(api[_-]?key|secret|token|password|private[_-]?key|client[_-]?secret)\b(\s*[:=]\s*)(['\"]?)[A-Za-z0-9_./+=:@-]{8,}(['\"]?)"
REDACT_BEARER = r"(?i)\b(bearer|token)\s+[A-Za-z0-9._~+/=-]{16,}"
REDACT_LONG = r"\b[A-Za-z0-9_+/=-]{32,}\b"

# Rule id substrings to (owasp, cwe, cvss), first match wins; then prefixes.
TAXONOMY = [
    (("secret",), ("A02:2021-Cryptographic Failures", "CWE-798", 8.1)), (("eval", "exec"), ("A03:2021-Injection", "CWE-95", 9.1)),
    (("shell",), ("A03:2021-Injection", "CWE-78", 9.0)), (("inner-html",), ("A03:2021-Injection", "CWE-79", 7.4)), (("sql",), ("A03:2021-Injection", "CWE-89", 8.8)),
]
TAXONOMY_PREFIXES = [
    ("trivy", ("A06:2021-Vulnerable and Outdated Components", "CWE-937", 7.5)),
    ("dependency", ("A06:2021-Vulnerable and Outdated Components", "CWE-1104", 7.2)), ("b", ("A05:2021-Security Misconfiguration", "CWE-693", 6.5)),
]
TAXONOMY_ELSE = ("A06:2021-Vulnerable and Outdated Components", "CWE-20", 5.0)
SCANNERS = [("trivy", "trivy"), ("dependency", "dependency-audit"), ("semgrep", "semgrep"), ("b", "bandit")]
# Texts of findings, in own words.
IMPACTS = [
    ("A leaked credential opens systems or data to people without a right to them.", ("secret",)),
    ("Input from outside may be run as a command or as code.", ("eval", "exec", "shell")),
    ("Markup from outside may run scripts in the browsers of users.", ("inner-html",)),
    ("Statements put together from text may be changed by input and give data away.", ("sql",)),
]
REMEDIATIONS = [
    ("Keep the secret in a vault or the environment, replace the exposed value, and scan for secrets on every build.", ("secret",)),
    ("Parse the input, or choose among known commands, instead of running it as code.", ("eval", "exec")),
    ("Pass arguments as a list, without a shell, and check what comes in.", ("shell",)),
    ("Clean markup before it is shown, or show it as text.", ("inner-html",)),
    ("Bind parameters instead of putting statements together.", ("sql",)),
]
REMEDIATION_ELSE = "Look at the finding, test against its return, and write down what was decided."
EXPLOITABLE = ("secret", "shell", "exec", "eval", "sql")

# Severity weights of several analyses.
RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
POSTURE_WEIGHT = {"critical": 10, "high": 6, "medium": 3, "low": 1}
RELATIONS = ("DEPENDS_ON", "USES", "IMPORTS", "CALLS")
ASSERTIVE = ("implements", "uses", "calls", "depends", "stores", "exposes", "authenticates", "encrypts", "vulnerable", "risk", "critical")
FILE_REFERENCE = r"`?([A-Za-z0-9_./-]+\.(?:py|ts|tsx|js|jsx|json|ya?ml|toml|md|go|rs|java|kt|cs|rb|php|sql))(?:[:#][0-9]+(?:-[0-9]+)?)?`?"
SEARCH_WORD = "[A-Za-z0-9_./-]+"
CHUNK_SIZE, CHUNK_OVERLAP = 1800, 220

# Weights and levels of drift and review scores.
DRIFT_WEIGHTS = {
    "domains_added": 10, "domains_removed": 14, "domains_changed": 8, "route_delta": 4, "model_delta": 5, "dependencies_added": 4, "dependencies_removed": 5,
    "integrations_added": 6, "api_added": 6, "api_removed": 8, "orphaned_added": 8, "severity_delta": 2, "score_drops": 8,
}
DRIFT_LEVELS = ((70, "major"), (40, "material"), (15, "minor"))
REVIEW_LEVELS = ((75, "critical"), (55, "high"), (35, "medium"))

# Weights of the composite scores.
PRODUCTION_WEIGHTS = {"security": 0.32, "debt": 0.24, "tests": 0.14, "ci": 0.10, "container": 0.08, "dependency": 0.07, "docs": 0.05}
CTO_WEIGHTS = {"production": 0.45, "security": 0.25, "debt": 0.20, "ci": 0.10}

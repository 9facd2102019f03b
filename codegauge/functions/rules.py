"""Fixed values of the analytics rules (extension maps, keyword lists, thresholds, weights).

These must be equal to the behaviour being reproduced, so they are stated once, plainly, here.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------------------------
# Extension -> language used by the knowledge graph (case-sensitive suffix).
GRAPH_LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".go": "go",
    ".rs": "rust",
    ".c": "c",
    ".cpp": "cpp",
    ".h": "c",
    ".hpp": "cpp",
}

# Extension -> language used by the metric analyser (lower-cased suffix).
METRIC_LANGUAGES = {
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".py": "python",
    ".java": "java",
    ".go": "go",
    ".rs": "rust",
    ".c": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
}

# Extensions of the scoring scan (lower-cased suffix, no ignored directories).
SCORING_EXTENSIONS = [".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".go", ".rs", ".c", ".cpp", ".h", ".hpp"]

# Directory names skipped by the graph scan.
IGNORED_DIRS = ["node_modules", ".git", "__pycache__", ".pytest_cache", "dist", "build", "target",
                ".idea", ".vscode", "coverage"]

# Change-monitor filter.
MONITOR_IGNORED_PARTS = [".git", ".DS_Store", "__pycache__", "node_modules", ".next", ".nuxt", "dist",
                         "build", ".vscode"]
MONITOR_IGNORED_SUFFIXES = [".log", ".tmp", ".temp", ".cache"]
MONITOR_EXTENSIONS = [".py", ".js", ".ts", ".tsx", ".jsx", ".vue", ".java", ".cpp", ".c", ".h", ".hpp",
                      ".cs", ".go", ".rs", ".php", ".rb", ".swift", ".kt", ".scala", ".md", ".json",
                      ".yaml", ".yml", ".xml", ".css", ".scss", ".less", ".html", ".htm"]

# Linter routing by lower-cased extension.
LINTER_LANGUAGES = {".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
                    ".mjs": "javascript", ".cjs": "javascript", ".py": "python"}

# ---------------------------------------------------------------------------------------------
# Substring lists of the text metrics, per language.
CYCLOMATIC_KEYWORDS = {
    "python": ["if", "elif", "while", "for", "try", "except", "and", "or"],
    "javascript": ["if", "else if", "while", "for", "switch", "case", "try", "catch", "&&", "||"],
    "typescript": ["if", "else if", "while", "for", "switch", "case", "try", "catch", "&&", "||"],
    "java": ["if", "else if", "while", "for", "switch", "case", "try", "catch", "&&", "||"],
}
CYCLOMATIC_CAP = 50
FUNCTION_PATTERNS = {
    "python": ["def ", "async def "],
    "javascript": ["function ", "=> ", "async function"],
    "typescript": ["function ", "=> ", "async function"],
    "java": ["public ", "private ", "protected "],
}
CLASS_PATTERNS = {
    "python": ["class "],
    "javascript": ["class "],
    "typescript": ["class ", "interface "],
    "java": ["class ", "interface ", "enum "],
}
COGNITIVE_OPENERS = ["if", "for", "while", "try"]
COGNITIVE_CLOSERS = ["}", "end", "endif"]
COGNITIVE_CAP = 100
NESTING_OPENERS = ["if", "for", "while", "try", "def", "class"]
NESTING_CLOSERS = ["}", "end"]
BLOCK_ENDINGS = [":", "{"]
LONG_FUNCTION_LINES = 50
DUPLICATE_BLOCK_LINES = 3
DUPLICATE_LIMIT = 5

# ---------------------------------------------------------------------------------------------
# Quality-score thresholds (good, acceptable, bad).
THRESHOLDS = {
    "cyclomatic_complexity": (5, 10, 15),
    "cognitive_complexity": (10, 20, 30),
    "nesting_depth": (3, 4, 6),
}

# ESLint rule categories and suggestions.
ESLINT_RULE_CATEGORIES = {
    "security": ["no-eval", "no-implied-eval", "no-unsafe-negation"],
    "performance": ["no-unnecessary-call", "prefer-spread"],
    "style": ["indent", "quotes", "semi", "space-before-function-paren"],
    "complexity": ["complexity", "max-depth", "max-len"],
}
ESLINT_SUGGESTIONS = {
    "no-unused-vars": "Remove unused variables or prefix with underscore",
    "no-console": "Replace console.log with proper logging framework",
    "complexity": "Break down function into smaller functions",
    "max-depth": "Reduce nesting depth by extracting functions",
    "prefer-const": "Use const for variables that are not reassigned",
    "no-var": "Use let or const instead of var",
}
# Bandit suggestions and the high-risk rule ids.
BANDIT_SUGGESTIONS = {
    "B101": "Use assert only for debugging, not for data validation",
    "B102": "Use proper exception handling instead of exec",
    "B103": "Set appropriate file permissions (avoid 0o777)",
    "B108": "Use a proper tmp directory with appropriate permissions",
    "B301": "Use pickle alternatives like json for untrusted data",
    "B601": "Validate and sanitize shell command parameters",
    "B602": "Use subprocess with shell=False for better security",
}
HIGH_RISK_RULES = ["B601", "B602", "B301"]
# PyFlakes message fragments and suggestions.
PYFLAKES_SUGGESTIONS = [
    ("imported but unused", "Remove unused import or use __all__ to export"),
    ("undefined name", "Define the variable or fix the spelling"),
    ("redefined", "Use different variable names to avoid redefinition"),
]
TYPED_LANGUAGES = ["typescript", "java", "rust", "go"]

# Branch naming.
MAIN_BRANCHES = ["main", "master"]
DEVELOP_BRANCHES = ["develop", "dev"]
BRANCH_PREFIXES = [("feature/", "feature"), ("hotfix/", "hotfix"), ("release/", "release")]


# Sentences of the reports ({} stands for the measured value).
RECOMMEND_CYCLOMATIC = "Reduce cyclomatic complexity from {} to ≤10 by extracting functions"
RECOMMEND_COGNITIVE = "Simplify logic to reduce cognitive complexity from {} to ≤15"
RECOMMEND_LONG = "Break down {} long functions into smaller, focused functions"
RECOMMEND_DUPLICATES = "Extract common code patterns into reusable functions to eliminate duplication"
RECOMMEND_SECURITY = "Address {} security issues detected by static analysis"
STRENGTH_CATEGORY = "Excellent {}"
STRENGTH_COMPLEXITY = "Low complexity - easy to understand"
STRENGTH_NESTING = "Minimal nesting - clean structure"
STRENGTH_FUNCTIONS = "Well-sized functions"
STRENGTH_DUPLICATES = "No code duplication"
ISSUE_CYCLOMATIC = "Cyclomatic complexity is {} (threshold: 15)"
ISSUE_COGNITIVE = "Cognitive complexity is {} (threshold: 25)"
ISSUE_LONG = "Long function detected: {}"
ISSUE_DUPLICATE = "Duplicated code: {}"
ISSUE_INDEX = "Low maintainability index: {}"
ADVICE_CYCLOMATIC = "Consider breaking down large functions into smaller ones"
ADVICE_COGNITIVE = "Reduce nesting depth and simplify logic flow"
ADVICE_LONG = "Consider extracting smaller functions for better readability"
ADVICE_DUPLICATE = "Extract common code into reusable functions"
ADVICE_INDEX = "Refactor to improve code structure and reduce complexity"


@dataclass(frozen=True)
class ScoringWeights:
    """Weights of the 0-100 quality score (defaults are the fixed values)."""

    maintainability: float = 0.25
    reliability: float = 0.25
    security: float = 0.20
    performance: float = 0.15
    style: float = 0.10
    complexity: float = 0.05
    cyclomatic_complexity_weight: float = 0.4
    cognitive_complexity_weight: float = 0.3
    nesting_depth_weight: float = 0.3
    error_penalty: float = 20.0
    warning_penalty: float = 5.0
    info_penalty: float = 1.0
    good_practices_bonus: float = 5.0
    comprehensive_tests_bonus: float = 10.0

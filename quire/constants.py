"""Fixed values that decide results: word lists, lookup tables and patterns."""

from __future__ import annotations

# --- fixed values: extension -> fence language (lookup is case-sensitive) ----
FENCE_LANGUAGES = {
    "py": "python", "ipynb": "python", "js": "javascript", "ts": "typescript", "java": "java",
    "c": "c", "cpp": "cpp", "cs": "csharp", "html": "html", "css": "css", "xml": "xml",
    "json": "json", "yaml": "yaml", "yml": "yaml", "md": "markdown", "sh": "bash", "rb": "ruby",
    "go": "go", "rs": "rust", "php": "php", "kt": "kotlin", "swift": "swift", "sql": "sql",
    "toml": "toml", "dockerfile": "dockerfile",
}

# --- fixed values: extension -> language with structure rules ----------------
CODE_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript",
    ".tsx": "typescript", ".java": "java", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp",
    ".c": "c", ".h": "c", ".hpp": "cpp", ".rs": "rust",
}

# --- fixed values: extensions that are always text ---------------------------
TEXT_EXTENSIONS = (
    ".py", ".ipynb", ".js", ".ts", ".jsx", ".tsx", ".html", ".css", ".scss", ".sass",
    ".json", ".xml", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf",
    ".md", ".txt", ".rst", ".tex", ".csv", ".sql", ".sh", ".bash", ".zsh",
    ".dockerfile", ".gitignore", ".env", ".c", ".cpp", ".h", ".hpp", ".java",
    ".kt", ".rb", ".php", ".go", ".rs", ".swift", ".dart", ".r", ".pl", ".lua",
)

# --- fixed values: extensions that are never text ----------------------------
BINARY_EXTENSIONS = (
    ".pyc", ".pyo", ".pyd", ".so", ".dll", ".exe", ".bin", ".png", ".jpg",
    ".jpeg", ".gif", ".pdf", ".zip", ".tar", ".gz", ".ico", ".woff", ".woff2",
)

# --- fixed values: directories and names the scan skips ----------------------
ALLOWED_HIDDEN = (".gitignore", ".env", ".github")
SKIPPED_DIRS = ("__pycache__", "node_modules", ".git", "dist", "build", ".pytest_cache")
LISTING_EXCLUDED_DIRS = ("dist", "node_modules", ".git", "__pycache__", ".vscode", ".idea")

# --- fixed values: data files and limits -------------------------------------
DATA_EXTENSIONS = (".csv", ".json", ".jsonl")
DATA_SAMPLE_LINES = 5
SNIFF_BYTES = 1024
SNAPSHOT_SCHEMA_VERSION = 1
TREE_DEPTH = 5
TOP_N = 10
COMMENT_CHARS = 200
DOCSTRING_CHARS = 100
DOCSTRING_SHORT = 20

# --- fixed values: messages and markers --------------------------------------
NO_EXTENSION = ".<no_ext>"
TREE_HEADING = "Project Structure:"
NO_FILES_MESSAGE = "No files found matching the specified criteria."
DEPTH_PLACEHOLDER = "... (depth limit reached)"
DATA_NOTE = "\n\n... (Data file content truncated to first {} lines)"
DIR_ICON = "\U0001F4C1"
FILE_ICON = "\U0001F4C4"
NO_TEXT_CHANGE = "(no textual changes detected)"

# --- fixed values: HTML elements whose content is not page text --------------
DROPPED_ELEMENTS = ("script", "style", "head", "nav", "footer", "aside", "form")

# --- fixed values: regular expressions shared by both engines ----------------
# Line breaks of Python's str.splitlines(); the number of matches of LINE_RE is
# the number of lines.
BREAKS = r"\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}"
LINE_RE = rf"[^{BREAKS}]*(?:\r\n|[{BREAKS}])|[^{BREAKS}]+"
# White space of Python's str.split(); the number of matches of WORD_RE is the
# number of words.
SPACES = (
    r"\t\n\x0B\x0C\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WORD_RE = rf"[^{SPACES}]+"
# Pre-token pattern of the public cl100k_base encoding.
PRETOKEN_RE = (
    r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}"
    r"| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"
)
# Last suffix of the last path component; a leading dot does not start one.
EXT_RE = r"[^/](\.[^./]+)\z"

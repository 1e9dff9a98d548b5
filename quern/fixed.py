"""Fixed values of the engine: lists and patterns that define which files it takes and how it reads them."""

# Language of each source-code extension.
LANGUAGES = {
    ".py": "python", ".pyx": "python", ".pyi": "python",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript",
    ".c": "c", ".h": "c",
    ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".hh": "cpp", ".cxx": "cpp",
    ".rs": "rust",
    ".go": "go",
    ".java": "java",
    ".rb": "ruby",
    ".ex": "elixir", ".exs": "elixir",
    ".zig": "zig",
    ".lua": "lua",
    ".hs": "haskell",
    ".jl": "julia",
    ".pl": "perl", ".pm": "perl",
    ".r": "r", ".R": "r",
    ".swift": "swift",
    ".kt": "kotlin", ".kts": "kotlin",
    ".scala": "scala",
    ".cs": "csharp",
    ".fs": "fsharp", ".fsx": "fsharp",
    ".clj": "clojure", ".cljs": "clojure",
    ".erl": "erlang", ".hrl": "erlang",
    ".ml": "ocaml", ".mli": "ocaml",
    ".nim": "nim",
    ".sh": "bash", ".bash": "bash",
    ".zsh": "zsh",
    ".fish": "fish",
    ".ps1": "powershell",
    ".sql": "sql",
    ".mojo": "mojo",
    ".html": "html", ".htm": "html",
    ".css": "css",
    ".scss": "scss",
    ".sass": "sass",
    ".less": "less",
    ".vue": "vue",
    ".svelte": "svelte",
    ".toml": "toml",
    ".yaml": "yaml", ".yml": "yaml",
    ".json": "json",
    ".xml": "xml",
    ".md": "markdown",
    ".rst": "rst",
    ".txt": "text",
}

# Extensions taken as code, exact names, directories never entered.
CODE_EXTENSIONS = (
    ".py", ".pyx", ".pyi", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".c", ".h", ".cpp", ".hpp", ".cc", ".hh", ".cxx", ".rs", ".go",
    ".java", ".rb", ".ex", ".exs", ".zig", ".lua", ".hs", ".jl", ".pl", ".pm", ".r", ".R", ".swift", ".kt", ".kts", ".scala", ".cs", ".fs", ".fsx",
    ".clj", ".cljs", ".erl", ".hrl", ".ml", ".mli", ".nim", ".sh", ".bash", ".zsh", ".fish", ".ps1", ".sql", ".mojo", ".html", ".htm", ".css",
    ".scss", ".sass", ".less", ".vue", ".svelte", ".toml", ".yaml", ".yml", ".json", ".xml", ".md", ".rst", ".txt", ".v", ".sv", ".ini", ".cfg",
    ".conf", ".cmake", ".mk",
)
CODE_NAMES = ("Makefile", "Dockerfile", "Containerfile", "CMakeLists.txt", "Cargo.toml", "go.mod", "package.json", "pyproject.toml", "setup.py", "setup.cfg", ".env.example")
SKIPPED_DIRECTORIES = (
    ".git", "node_modules", "__pycache__", "build", "dist", "vendor", ".venv", "venv", ".tox", "target", ".next", "coverage",
    ".mypy_cache", ".pytest_cache", ".ruff_cache", ".cache",
)

# The reader of each document extension.
READERS = {
    ".pdf": "pdf",
    ".epub": "epub",
    ".mobi": "mobi",
    ".txt": "text", ".md": "text", ".rst": "text",
    ".png": "image", ".jpg": "image", ".jpeg": "image", ".bmp": "image", ".webp": "image", ".pbm": "image", ".pgm": "image", ".ppm": "image", ".pnm": "image",
    ".tiff": "tiff", ".tif": "tiff",
    ".djvu": "djvu", ".djv": "djvu",
}

# Where a top-level unit begins, by language (Python expressions, applied at line starts).
UNIT_STARTS = {
    "python": r"^(?:def |class |async def )",
    "javascript": r"^(?:function |class |export |const \w+ = |let \w+ = |var \w+ = )",
    "typescript": r"^(?:function |class |export |const \w+ = |interface |type |enum )",
    "c": r"^(?:\w[\w\s*&]*\w+\s*\(|struct |enum |typedef )",
    "cpp": r"^(?:\w[\w\s*&:<>]*\w+\s*\(|struct |enum |class |namespace |template)",
    "rust": r"^(?:fn |pub fn |struct |enum |impl |trait |mod |pub struct |pub enum )",
    "go": r"^(?:func |type |var |const )",
    "java": r"^(?:\s*(?:public |private |protected |static )*(?:class |interface |enum |void |int |String |boolean |\w+ ))",
}
# What a line of the import block begins with, by language.
IMPORT_STARTS = {
    "python": r"import |from |#",
    "javascript": r"import |const .* = require|//|/\*",
    "typescript": r"import |const .* = require|//|/\*",
    "c": r"#include |#define |#pragma |//",
    "cpp": r"#include |#define |#pragma |using |//|namespace",
    "rust": r"use |mod |extern |//",
    "go": r"import |package |//",
    "java": r"import |package |//",
}

SUMMARY_SOURCE = "__project_summary__"

"""Languages by file suffix, and what a declaration looks like in each: patterns over text without comments and strings."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Suffixes of source files and their languages.
SUFFIXES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".java": "java",
    ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin",
    ".sh": "shell", ".bash": "shell", ".sql": "sql", ".html": "html", ".css": "css", ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp",
}

_STRINGS = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
_SLASHES = r"//[^\n]*|/\*.*?\*/"
_BACKTICKS = r"`(?:\\.|[^`\\])*`"


@dataclass(frozen=True)
class Rules:
    """mask: comments and strings. types: classes, named by group 1. scopes: other owners of methods, named likewise.
    methods: functions, named by the last group that matched. imports: import texts. ends: bodies end by "brace" or "end"."""

    mask: str
    types: str = ""
    methods: str = ""
    imports: str = ""
    scopes: str = ""
    ends: str = "brace"
    package: str = ""


_WEB = Rules(
    mask=f"{_SLASHES}|{_STRINGS}|{_BACKTICKS}",
    types=r"\b(?:class|interface)\s+([A-Za-z_$][\w$]*)",
    methods=r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\s*(?=\()"
    r"|\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;\n]+)?=\s*(?:async\s+)?(?=function\b|\([^()]*\)\s*(?::[^={;\n]+)?=>|[\w$]+\s*=>)"
    r"|^[ \t]*(?:(?:public|private|protected|static|async|get|set|override)[ \t]+)*(#?[A-Za-z_$][\w$]*)[ \t]*(?:<[^>]*>)?(?=\([^;{}]*\)\s*(?::[^{};]+)?\{)",
    imports=r"^[ \t]*import\b[^;\n{]*(?:\{[^}]*\}[^;\n]*)?;?",
)
_C = r"^[ \t]*(?:[\w:<>,]+[\s*&]+)+((?:\w+::)*~?\w+)\s*(?=\([^;{}]*\)\s*(?:const\b|noexcept\b|override\b|\s)*(?::[^{};]*)?\{)"

RULES = {
    "typescript": _WEB,
    "javascript": _WEB,
    "java": Rules(
        mask=f"{_SLASHES}|{_STRINGS}",
        types=r"\b(?:class|interface|enum)\s+(\w+)",
        methods=r"^[ \t]*(?:[\w@<>\[\],.?]+[ \t]+)+(\w+)[ \t]*(?=\([^;{}]*\)\s*(?:throws\s+[\w.,\s]+)?[{;])|^[ \t]*([A-Z]\w*)[ \t]*(?=\([^;{}]*\)\s*(?:throws\s+[\w.,\s]+)?\{)",
        imports=r"^[ \t]*import\s+[^;]+;",
        package=r"^[ \t]*package\s+([\w.]+)\s*;",
    ),
    "go": Rules(
        mask=f"{_SLASHES}|{_STRINGS}|{_BACKTICKS}",
        types=r"\btype\s+(\w+)(?:\[[^\]]*\])?\s+(?:struct|interface)\b",
        methods=r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?(?=\()",
        imports=r"^import\s+(?:\([^)]*\)|[^\n]+)",
        package=r"^package\s+(\w+)",
    ),
    "rust": Rules(
        mask=_SLASHES + r"|\"(?:\\.|[^\"\\])*\"|'(?:\\[^'\n]+|[^'\\\n])'",
        types=r"\b(?:struct|trait|enum)\s+(\w+)",
        scopes=r"\bimpl\b\s*(?:<[^{]*?>\s*)?(?:[\w:<>,' ]+?\s+for\s+)?(?:\w+::)*(\w+)",
        methods=r"\bfn\s+(\w+)",
        imports=r"\buse\s+[^;]+;",
    ),
    "ruby": Rules(
        mask=rf"\#[^\n]*|{_STRINGS}", types=r"^[ \t]*(?:class|module)\s+((?:\w+::)*\w+)", methods=r"^[ \t]*def\s+(?:self\.)?(\w+[?!=]?)",
        imports=r"^[ \t]*(?:require_relative|require|include|extend)\b[^\n]*", ends="end",
    ),
    "php": Rules(
        mask=rf"\#(?!\[)[^\n]*|{_SLASHES}|{_STRINGS}", types=r"\b(?:class|interface)\s+(\w+)", methods=r"\bfunction\s+&?(\w+)\s*(?=\()",
        imports=r"^[ \t]*use\b[^;]+;|\b(?:require_once|require|include_once|include)\b[^;]+;",
    ),
    "swift": Rules(
        mask=f"{_SLASHES}|{_STRINGS}", types=r"\b(?:class|struct|protocol)\s+(?!func\b|var\b)(\w+)", methods=r"\bfunc\s+(\w+)|\b(?<!\.)(init)[?!]?\s*(?=\()", imports=r"^[ \t]*import\s+\S+",
    ),
    "kotlin": Rules(
        mask=f"{_SLASHES}|{_STRINGS}", types=r"\b(?:class|interface|object)\s+(\w+)", methods=r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?(\w+)\s*(?=\()|\bclass\s+(\w+)\s*(?:<[^>]*>)?\s*(?=\()", imports=r"^[ \t]*import\s+\S+",
    ),
    "shell": Rules(mask=rf"(?<![\w$\{{])\#[^\n]*|{_STRINGS}", methods=r"^[ \t]*(?:function\s+)?([\w-]+)\s*(?:\(\))\s*(?=\{)|^[ \t]*function\s+([\w-]+)\s*(?=\{)", imports=r"^[ \t]*(?:source|\.)\s+\S+"),
    "css": Rules(mask=r"/\*.*?\*/", methods=r"(?:(?<=[{};])|\A)\s*((?!@)[^\s{};@][^{};]*?)\s*(?=\{)", imports=r"@import[^;]+;"),
    "c": Rules(mask=f"{_SLASHES}|{_STRINGS}", types=r"\btypedef\s+struct\b[^{;]*\{[^}]*\}\s*(\w+)", methods=_C, imports=r"^[ \t]*\#[ \t]*include[^\n]*"),
    "cpp": Rules(
        mask=f"{_SLASHES}|{_STRINGS}", types=r"\btypedef\s+struct\b[^{;]*\{[^}]*\}\s*(\w+)|\b(?:class|struct)\s+(\w+)(?=[^;{}()]*\{)", methods=_C,
        imports=r"^[ \t]*\#[ \t]*include[^\n]*", package=r"\bnamespace\s+([\w:]+)\s*\{",
    ),
}

#: Words that look like a call or a declaration and are none.
WORDS = frozenset("if for while switch catch return function new throw else do sizeof await typeof with when match fn func fun def class super assert".split())
CALL = re.compile(r"[A-Za-z_$][\w$]*(?:(?:\?\.|\.|->|::)[A-Za-z_$][\w$]*)*(?=\s*\()")


def language_of(path: str) -> str | None:
    """The language of a path by its suffix, or None."""
    dot = path.rfind(".")
    return SUFFIXES.get(path[dot:]) if dot > path.rfind("/") else None

"""Which language a file is in, from its name, its first line, and for headers its text; and whether its text is in it."""

from __future__ import annotations

import re

from quarry.extract.tokens import scan

# Fixed value: the greatest share of errors in a file that is extracted.
MOST_ERRORS = 0.05
# Suffixes of the languages that are extracted, and the shells that count as one language.
SUFFIXES = {
    "python": ".py .pyi .pyw", "javascript": ".js .mjs .cjs .jsx", "typescript": ".ts .mts .cts", "tsx": ".tsx", "go": ".go", "rust": ".rs", "java": ".java", "kotlin": ".kt .kts", "csharp": ".cs",
    "c": ".c .h", "cpp": ".cpp .cc .cxx .hpp .hh .hxx", "php": ".php", "ruby": ".rb", "powershell": ".ps1 .psm1 .psd1", "shell": ".sh .bash .zsh .fish .ksh .csh",
}
SHELLS = ("bash", "csh", "dash", "fish", "ksh", "sh", "shell", "tcsh", "zsh")
_BY_SUFFIX = {s: language for language, all_ in SUFFIXES.items() for s in all_.split()}
_CPP = re.compile(r"(?m)^\s*(?:template\s*<|namespace\b|using\s+\w|(?:class|struct)\s+\w+[^;{]*\{[^}]*\b(?:public|private|protected|virtual)\b|class\s+\w+\s*[:{;])|\bstd::|\bpublic:|\bconstexpr\b")


#: Suffixes of further languages, which are named in the log and not extracted.
NAMED = {
    "json": ".json", "yaml": ".yaml .yml", "toml": ".toml", "html": ".html .htm", "css": ".css", "scss": ".scss", "sql": ".sql", "lua": ".lua", "perl": ".pl .pm", "r": ".r", "swift": ".swift", "scala": ".scala", "dart": ".dart", "elixir": ".ex .exs",
    "haskell": ".hs", "xml": ".xml", "markdown": ".md", "make": ".mk", "cmake": ".cmake", "zig": ".zig", "julia": ".jl", "vue": ".vue", "svelte": ".svelte", "proto": ".proto",
}
_NAMED = {s: language for language, all_ in NAMED.items() for s in all_.split()}
#: Scanner settings of the languages whose errors are counted, and how many names that are no keywords may follow each other there (0: any).
_DIALECT = {"javascript": ("js", 2), "typescript": ("js", 2), "tsx": ("js", 0), "go": ("go", 3), "rust": ("rust", 2), "java": ("java", 3), "kotlin": ("kotlin", 9), "csharp": ("csharp", 3), "c": ("c", 4), "cpp": ("c", 4)}
_KEYWORDS = frozenset(
    "abstract as async await base bool boolean break by byte case catch chan char class const constexpr consteval continue crate crossinline data declare default defer delegate delete do double dyn else enum event explicit export extends extern "
    "false final finally float fn for foreach friend from fun func function get go goto if impl implements import in infix init inline inner inout instanceof int interface internal is keyof lateinit let long loop match mod move mut mutable namespace "
    "native new nil noexcept noinline null object of open operator out override package partial private protected pub public range readonly record ref register reified require return sealed select self set short signed sizeof static struct super "
    "suspend switch synchronized tailrec template this throw throws trait transient true try type typedef typename typeof union unique unsafe unsigned use using val var vararg virtual void volatile when where while with yield".split()
)
_CLOSES = {")": "(", "]": "[", "}": "{"}


def error_share(language: str, text: str) -> float:
    """Errors by token, without a grammar: brackets that do not pair, and rows of more names than the language allows on one line."""
    if language not in _DIALECT:
        return 0.0
    dialect, most = _DIALECT[language]
    tokens = scan(text, "c", dialect, newlines=True)
    if dialect == "c":  # directives need not pair
        lines = {t.line for t, n in zip(tokens, tokens[1:]) if t.text == "#" and n.kind == "id"}
        tokens = [t for t in tokens if t.line not in lines]
    errors, names, open_ = 0, 0, []
    for kind, x, _ in tokens:
        names = names + 1 if kind == "id" and x not in _KEYWORDS else 0
        errors += bool(most) and names > most
        if kind == "op" and x in _CLOSES.values():
            open_.append(x)
        elif kind == "op" and x in _CLOSES:
            if open_ and open_[-1] == _CLOSES[x]:
                open_.pop()
            else:
                errors += 1
    return (errors + len(open_)) / max(1, sum(t.kind != "nl" for t in tokens))


def shebang(text: str) -> str | None:
    line = text.split("\n", 1)[0].strip()
    parts = line[2:].split() if line.startswith("#!") else []
    name = parts[0].rpartition("/")[2] if parts else ""
    if name == "env":
        rest = [p for p in parts[1:] if not p.startswith("-")]
        name = rest[0].rpartition("/")[2] if rest else ""
    if name in SHELLS:
        return "shell"
    m = re.fullmatch(r"(python|ruby|php|node)[\d.]*", name)
    return {"node": "javascript"}.get(m[1], m[1]) if m else None


def detect(name: str, text: str) -> str | None:
    """The language that a file is extracted in; None if there is none or its text has too many errors."""
    dot = name.lower().rfind(".")
    language = _BY_SUFFIX.get(name.lower()[dot:]) if dot > 0 else None
    if language is None:
        return shebang(text)
    if name.lower().endswith(".h") and _CPP.search(text):
        language = "cpp"
    return language if error_share(language, text) <= MOST_ERRORS else None


def named(name: str) -> str | None:
    """The language of a file that is named in the log only."""
    dot = name.lower().rfind(".")
    return _NAMED.get(name.lower()[dot:]) if dot > 0 else None

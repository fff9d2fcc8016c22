"""A scanner that is good enough for calls and declarations: words, strings and marks with their lines, no comments."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # id | str | num | op | nl
    text: str
    line: int


_STRING = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_COMMENTS = {
    "c": r"//[^\n]*|/\*.*?(?:\*/|\Z)",
    "php": r"//[^\n]*|\#(?!\[)[^\n]*|/\*.*?(?:\*/|\Z)|\?>.*?(?:<\?(?:php|=)|\Z)",
    "ruby": r"\#[^\n]*|^=begin.*?^=end[^\n]*",
}
#: A regular expression literal stands where an operand may begin.
_JS_REGEX = "".join(rf"(?<={before})/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*|" for before in (r"[=(,:\[!&|?{};\n]", r"[=(,:\[!&|?{};] ", r"\breturn "))
_EXTRA = {
    "go": r"`[^`]*`|", "js": r"`(?:[^`\\$]|\\.|\$\{[^{}]*\}|\$)*`|" + _JS_REGEX, "kotlin": r"\"\"\".*?\"\"\"|`[^`\n]*`|\"(?:[^\"\\\n$]|\\.|\$\{[^{}\n]*\}|\$)*\"|", "java": r"\"\"\".*?\"\"\"|", "rust": r"r\#*\".*?\"\#*|'(?:\\.[^']*|[^'\\])'|'\w+(?!')|",
    "csharp": r"@\"(?:[^\"]|\"\")*\"|\$\"(?:[^\"\\\n{]|\\.|\{[^{}\n]*\}|\{)*\"|", "c": r"R\"\(.*?\)\"|",
    "ruby": r"\"(?:[^\"\\#]|\\.|\#\{[^{}]*\}|\#)*\"|",
}
#: How an expression opens within a string, by dialect (and for the comment style of Ruby), and the strings that can hold one.
_INSIDE = {"js": ("`", "${"), "kotlin": ('"', "${"), "csharp": ('$"', "{"), "ruby": ('"', "#{")}
_BUILT: dict[tuple[str, str], re.Pattern] = {}


def _expressions(text: str, opening: str) -> list[tuple[int, str]]:
    """(place, source) of the expressions within a string."""
    out, at = [], text.find(opening)
    while at >= 0:
        begin = end = at + len(opening)
        depth = 1
        while end < len(text) and depth:
            depth += (text[end] == "{") - (text[end] == "}")
            end += 1
        out.append((begin, text[begin : end - (depth == 0)]))
        at = text.find(opening, end)
    return out


def scan(text: str, comments: str = "c", dialect: str = "", newlines: bool = False) -> list[Token]:
    key = (comments, dialect)
    if key not in _BUILT:
        word = r"[$@]*[A-Za-z_][\w]*[?!]?(?![\w=])|[$@]*[A-Za-z_]\w*" if comments == "ruby" else r"[$A-Za-z_\u0080-\U0010ffff][\w$]*"
        _BUILT[key] = re.compile(f"(?P<skip>{_COMMENTS[comments]})|(?P<str>{_EXTRA.get(dialect or 'ruby' * (comments == 'ruby'), '')}{_STRING})|(?P<id>{word})|(?P<num>\\d[\\w.]*)|(?P<nl>\n)|(?P<op>::|->|\\?\\.|:=|=>|\\\\|[^\\s\\w])", re.S | re.M)
    quote, opening = _INSIDE.get(dialect or comments, ("", ""))
    out, line, at = [], 1, 0
    for m in _BUILT[key].finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        kind = m.lastgroup
        if kind == "skip" or kind == "nl" and not newlines:
            continue
        out.append(Token(kind, m.group(), line))
        if quote and kind == "str" and m.group().startswith(quote) and opening in m.group():
            for begin, inner in _expressions(m.group(), opening):
                more = m.group().count("\n", 0, begin)
                held = scan(inner, comments, dialect)
                out += [Token("op", ";", line + more), *(t._replace(line=t.line + line + more - 1) for t in held), Token("op", ";", line + more)] if held else []
    return out


def unquote(text: str) -> str:
    return text.strip("\"'`") if text[:1] in "\"'`" else text


def close_of(tokens: list[Token], at: int) -> int:
    """Where the bracket at `at` closes (or the last token)."""
    pairs, depth = {"(": ")", "{": "}", "[": "]"}, 0
    open_, close = tokens[at].text, pairs[tokens[at].text]
    for i in range(at, len(tokens)):
        if tokens[i].kind == "op":
            depth += (tokens[i].text == open_) - (tokens[i].text == close)
            if depth == 0:
                return i
    return len(tokens) - 1


def chain_at(tokens: list[Token], at: int, dots: tuple[str, ...] = (".", "?.")) -> tuple[list[str], int]:
    """Names joined by dots from `at` on, and where the chain ends (past its last name)."""
    names, i = [tokens[at].text], at + 1
    while i + 1 < len(tokens) and tokens[i].kind == "op" and tokens[i].text in dots and tokens[i + 1].kind == "id":
        names.append(tokens[i + 1].text)
        i += 2
    return names, i


def text_at(tokens: list[Token], i: int) -> str:
    return tokens[i].text if 0 <= i < len(tokens) else ""

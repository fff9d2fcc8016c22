"""Python, JavaScript and TypeScript, Ruby, PHP, PowerShell and shell."""

from __future__ import annotations

import ast
import re

from quarry.extract import Context, Found
from quarry.extract.tokens import chain_at, close_of, scan, text_at, unquote


# Python
def python(text: str, ctx: Context) -> Found | None:
    try:
        tree = ast.parse(text.replace("\0", ""))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out, bound = Found(), {}
    nodes = [n for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom, ast.Call))]
    for node in sorted(nodes, key=lambda n: (n.lineno, n.col_offset, -(n.end_lineno or 0), -(n.end_col_offset or 0))):
        if isinstance(node, ast.Import):
            for a in node.names:
                if not ctx.local(a.name):
                    out.see(a.name, "", node.lineno)
                    bound[a.asname or a.name.split(".")[0]] = (a.name if a.asname else a.name.split(".")[0], "")
        elif isinstance(node, ast.ImportFrom):
            if node.level == 0 and node.module and not ctx.local(node.module):
                for a in node.names:
                    if a.name == "*":
                        out.see(node.module, "", node.lineno)
                    else:
                        out.see(node.module, a.name, node.lineno)
                        bound[a.asname or a.name] = (node.module, a.name)
        else:
            names, f = [], node.func
            while isinstance(f, ast.Attribute):
                names.append(f.attr)
                f = f.value
            if not isinstance(f, ast.Name):
                continue
            names.append(f.id)
            names.reverse()
            if names[0] in bound:
                module, imported = bound[names[0]]
                out.see(module, ".".join(x for x in (imported, *names[1:]) if x), node.func.end_lineno or node.lineno)
            elif len(names) == 1 and names[0] in ("open", "input"):
                out.see("", names[0], node.lineno)
    return out


# JavaScript, TypeScript, TSX
_JS_WORDS = set("if for while switch catch function return typeof await yield new in of instanceof void delete throw case do else super import".split())


def javascript(text: str, ctx: Context) -> Found:
    out, t, bound = Found(), scan(text, "c", "js"), {}
    ids = []
    if ctx.package:
        inside = ctx.rel[len(ctx.package_dir) + 1 :] if ctx.package_dir else ctx.rel
        stem = re.sub(r"\.[^./]*$", "", inside)
        ids.append(f"{ctx.package}/{stem}")
        if stem.rpartition("/")[2] == "index":
            ids.append("/".join(x for x in (ctx.package, stem.rpartition("/")[0]) if x))
        for i in ids:
            out.scope(i)
    export = lambda name: [out.scope(i, name) for i in ids]
    i = 0
    while i < len(t):
        k, x, line = t[i]
        before = text_at(t, i - 1)
        if k != "id" or before in (".", "?."):
            i += 1
            continue
        if x == "import" and text_at(t, i + 1) not in ("(", "."):
            names, j, default = [], i + 1, None
            while j < len(t) and t[j].kind != "str" and not (j > i + 40 and t[j].text == ";"):
                if t[j].text == "{":
                    end = close_of(t, j)
                    inner = [n for n in t[j + 1 : end] if n.text != "type" or True]
                    part: list[str] = []
                    for n in [*inner, None]:
                        if n is None or n.text == ",":
                            part = part[1:] if len(part) in (2, 4) and part[0] == "type" else part
                            if part:
                                names.append((part[0], part[2] if len(part) == 3 else part[0]))
                            part = []
                        else:
                            part.append(unquote(n.text))
                    j = end
                elif t[j].text == "*" and text_at(t, j + 1) == "as":
                    names.append(("", text_at(t, j + 2)))
                    j += 2
                elif t[j].kind == "id" and t[j].text not in ("from", "type"):
                    default = t[j].text
                j += 1
            if j < len(t):
                module = unquote(t[j].text)
                if not ctx.local(module):
                    out.see(module, "", line)
                    if default:
                        bound[default] = (module, "")
                    for name, alias in names:
                        bound[alias] = (module, "" if name == "default" else name)
                        if name and name != "default":
                            out.see(module, name, line)
            i = j + 1
            continue
        if x == "require" and text_at(t, i + 1) == "(" and i + 2 < len(t) and t[i + 2].kind == "str" and before == "=":
            module = unquote(t[i + 2].text)
            if not ctx.local(module):
                out.see(module, "", line)
                if t[i - 2].kind == "id":
                    bound[t[i - 2].text] = (module, "")
                elif t[i - 2].text == "}":
                    a = i - 2
                    while a and t[a].text != "{":
                        a -= 1
                    part = []
                    for n in [*t[a + 1 : i - 2], None]:
                        if n is None or n.text == ",":
                            if part:
                                bound[part[-1]] = (module, part[0])
                            part = []
                        elif n.kind == "id":
                            part.append(n.text)
            i += 4
            continue
        if x == "export":
            n = text_at(t, i + 1)
            if n == "{":
                part = []
                for q in [*t[i + 2 : close_of(t, i + 1)], None]:
                    if q is None or q.text == ",":
                        if part:
                            export(part[-1])
                        part = []
                    elif q.kind == "id" and q.text not in ("as", "type"):
                        part.append(q.text)
            else:
                j = i + 1
                while text_at(t, j) in ("default", "async", "abstract", "declare"):
                    j += 1
                if text_at(t, i + 1) == "default":
                    export("default")
                if text_at(t, j) in ("function", "class", "const", "let", "var", "interface", "type", "enum"):
                    j += 1 + (text_at(t, j + 1) == "*")
                    if j < len(t) and t[j].kind == "id":
                        export(t[j].text)
            i += 1
            continue
        names, end = chain_at(t, i)
        call = text_at(t, end) == "(" and before not in ("function", "new", "class") and x not in _JS_WORDS
        if call and names[0] in bound:
            module, imported = bound[names[0]]
            out.see(module, ".".join(n for n in (imported, *names[1:]) if n), line)
        elif call and names in (["fetch"], ["XMLHttpRequest"]):
            out.see("", names[0], line)
        i = end
    return out


# Ruby
_RUBY_WORDS = set(
    "if unless while until case when then else elsif end do begin rescue ensure return yield self super nil true false and or not in module class def undef alias puts p require require_relative break next redo retry loop attr_accessor attr_reader attr_writer private public protected".split()
)


def ruby(text: str, ctx: Context) -> Found:
    out, t = Found(), scan(text, "ruby", newlines=True)
    path: list[tuple[str, bool]] = []  # open blocks: name, whether a type
    start = True
    i = 0
    openers = {"do", "begin", "case"}
    while i < len(t):
        k, x, line = t[i]
        before = text_at(t, i - 1)
        if k == "nl" or x == ";":
            start = True
            i += 1
            continue
        if k == "id" and x in ("class", "module") and before != ".":
            if text_at(t, i + 1) == "<":
                path.append(("", False))
                i += 1
                continue
            names, end = chain_at(t, i + 1, ("::",)) if i + 1 < len(t) and t[i + 1].kind == "id" else ([], i + 1)
            path.append(("::".join(names), True))
            i, start = end, False
            continue
        if k == "id" and x == "def":
            j = i + 1
            if text_at(t, j + 1) == ".":
                j += 2
            name = text_at(t, j)
            out.function(name)
            owner = [n for n, is_type in path if is_type and n]
            full = "::".join(owner).split("::") if owner else []
            for a in range(len(full)):
                out.scope("::".join(full[a:]), name)
            path.append(("", False))
            i, start = j + 1, False
            if text_at(t, i) == "(":
                i = close_of(t, i) + 1
            continue
        if k == "id" and (x in openers or x in ("if", "unless", "while", "until", "for") and start):
            if not (x == "do" and path and path[-1] == ("loop", False)):
                path.append(("loop" if x in ("while", "until", "for") else "", False))
            i, start = i + 1, x in ("do", "begin")
            continue
        if k == "id" and x == "end" and before != ".":
            if path:
                path.pop()
            i, start = i + 1, True
            continue
        if k == "id" and x in ("require", "require_relative") and before != ".":
            j = i + 1 + (text_at(t, i + 1) == "(")
            if x == "require" and j < len(t) and t[j].kind == "str":
                lib = unquote(t[j].text)
                if not ctx.local(lib):
                    out.see(lib, "", line, include=lib + ".rb")
            i, start = j + 1, False
            continue
        if k == "id" and x not in _RUBY_WORDS and before not in (".", "::", "?."):
            names, end = chain_at(t, i, (".", "::", "?."))
            follow = t[end] if end < len(t) else None
            takes = follow is not None and (follow.text == "(" or follow.kind in ("str",) and follow.line == line or follow.kind in ("id", "num") and follow.line == line and len(names) == 1 and start and follow.text not in _RUBY_WORDS)
            if len(names) > 1:
                seps = [t[i + 1 + 2 * n].text for n in range(len(names) - 1)]
                last = len(names) - 1
                if seps[-1] != "::" or takes:
                    constant = all(n[:1].isupper() for n in names[:last])
                    out.see("::".join(names[:last]) if constant else "", names[last], line)
            elif takes or start and follow is not None and follow.kind == "nl" and x[:1].islower():
                out.see("", x, line)
            i, start = end, False
            continue
        start = k == "op" and x in "{|(&=!" or x in ("then", "else", "and", "or", "not")
        i += 1
    return out


# PHP
_PHP_WORDS = set("if elseif while for foreach switch catch function fn return echo print array list isset empty unset exit die include include_once require require_once match use new declare and or xor namespace class interface trait enum static".split())


def php(text: str, ctx: Context) -> Found:
    cut = re.search(r"<\?(?:php|=)", text)
    if cut is None:
        return Found()
    text = re.sub(r"[^\n]", " ", text[: cut.end()]) + text[cut.end() :]
    out, t, alias = Found(), scan(text, "php"), {}
    depth, types = 0, []
    i = 0
    while i < len(t):
        k, x, line = t[i]
        before = text_at(t, i - 1)
        if x in "{}":
            depth += 1 if x == "{" else -1
            if x == "}" and types and types[-1] == depth:
                types.pop()
        elif k == "id" and x.lower() in ("class", "interface", "trait", "enum") and before not in ("::", "->") and i + 1 < len(t) and (t[i + 1].kind == "id" or before == "new"):
            types.append(depth)
        elif k == "id" and x.lower() == "function" and before != "use":
            j = i + 1 + (text_at(t, i + 1) == "&")
            if j < len(t) and t[j].kind == "id" and not types:
                out.function(t[j].text)
            i = j + 1
            continue
        elif x == "use" and text_at(t, i + 1) == "function":
            names, j = [], i + 2
            while j < len(t) and t[j].text != ";":
                names.append(t[j].text)
                j += 1
            for clause in "".join(n if n != "as" else " as " for n in names).split(","):
                full, _, name = clause.partition(" as ")
                alias[name or full.rpartition("\\")[2]] = full.strip("\\").rpartition("\\")[2] if "\\" not in full.strip("\\") else full.strip("\\")
            i = j
            continue
        elif k == "id" and x.lower() in ("include", "include_once", "require", "require_once"):
            j = i + 1 + (text_at(t, i + 1) == "(")
            if j < len(t) and t[j].kind == "str" and text_at(t, j + 1) in (";", ")"):
                name = unquote(t[j].text)
                out.see(name, "", line, include=name)
        elif k == "id" and text_at(t, i + 1) == "(" and x.lower() not in _PHP_WORDS and not x.startswith("$") and before not in ("->", "?->", "::", "new", "function"):
            qualified = before == "\\" and i > 1 and t[i - 2].kind == "id"
            if not qualified:
                out.see("", alias.get(x, x) if before != "\\" else x, line)
        i += 1
    return out


# PowerShell
# Built-in aliases and the commands they stand for.
ALIASES = dict(
    pair.split("=")
    for pair in (
        "ac=Add-Content cat=Get-Content clc=Clear-Content copy=Copy-Item cp=Copy-Item cpi=Copy-Item curl=Invoke-WebRequest del=Remove-Item dir=Get-ChildItem erase=Remove-Item gc=Get-Content "
        "gci=Get-ChildItem icm=Invoke-Command irm=Invoke-RestMethod iwr=Invoke-WebRequest ls=Get-ChildItem mi=Move-Item move=Move-Item mv=Move-Item ni=New-Item rd=Remove-Item ren=Rename-Item "
        "ri=Remove-Item rm=Remove-Item rmdir=Remove-Item rni=Rename-Item saps=Start-Process sc=Set-Content start=Start-Process type=Get-Content wget=Invoke-WebRequest"
    ).split()
)
_POWER_WORDS = set("if elseif else for foreach while do until switch function filter workflow return param begin process end try catch finally throw break continue exit in class enum using data trap dynamicparam".split())


def powershell(text: str, ctx: Context) -> Found:
    blank = lambda m: re.sub(r"[^\n]", " ", m.group())
    text = re.sub(r"<#.*?(?:#>|\Z)|@\"\n.*?\n\"@|@'\n.*?\n'@", blank, text, flags=re.S)
    text = re.sub(r"\"(?:[^\"`]|`.)*\"|'[^']*'|(?<![\w`])#[^\n]*", lambda m: blank(m) if m.group()[0] == "#" else "'" + blank(m)[1:-1] + "'", text, flags=re.S)
    out = Found()
    for m in re.finditer(r"(?im)\b(?:function|filter|workflow)\s+(?:\w+:)?([\w-]+)", text):
        out.function(m[1].lower())
    for m in re.finditer(r"(?m)(?:^|[|;{(&=]|&&|\|\|)[ \t]*([A-Za-z_][\w.-]*)(?=[\s;|)}]|$)", text):
        name, rest = m[1], text[m.end() :].lstrip(" \t")
        line_start = text.rfind("\n", 0, m.start(1)) + 1
        if name.lower() in _POWER_WORDS or re.match(r"[-+*/]?=(?!=)", rest) or re.match(r"\s*@\{", text[line_start : m.start(1)]):
            continue
        if re.search(r"(?i)\b(?:function|filter|workflow)\s+$", text[line_start : m.start(1)]):
            continue
        out.see("", ALIASES.get(name.lower(), name), text.count("\n", 0, m.start(1)) + 1)
    return out


# Shell
# Commands that run the next word.
WRAPPERS = set("sudo command exec env nice nohup time xargs builtin".split())
_SHELL_WORDS = set("if then elif else fi for while until do done case esac in select function { } ! [[ ]] time coproc end begin switch and or not".split())
_SHELL_TOKEN = re.compile(
    r"(?P<skip>(?<![^\s;|&(){}])\#[^\n]*|\\\n)|(?P<here><<-?\s*(?P<q>['\"]?)(?P<tag>\w+)(?P=q))|(?P<redir>(?:\d*|&)(?:>>|>\||>&|<<<|<>|>|<(?!\()))|(?P<nl>\n)|(?P<op>&&|\|\||;;&?|;&|\|&|(?:[;|&()}]|\{(?!\}))(?=\s|$|[^\w])|[;|&()])"
    r"|(?P<word>(?:\$\((?=[^(])|`)|(?:[^\s;|&()<>`\"'$\\]|\\.|\"(?:[^\"\\]|\\.)*\"|'[^']*'|\$\{[^}]*\}|\$\(\([^\n]*?\)\)|\$'(?:[^'\\]|\\.)*'|\$(?!\())+)",
    re.S,
)


def _literal(word: str) -> str | None:
    """The word without quotes, if nothing in it is computed."""
    word = re.sub(r"\$\{\w+-\}", "", word)
    bare = re.sub(r"\\(.)", r"\1", re.sub(r"\"((?:[^\"\\]|\\.)*)\"|'([^']*)'", lambda m: m[1] if m[1] is not None else m[2], word))
    return None if "$" in word.replace("\\$", "") and not word.startswith("'") or "`" in word else bare


def shell(text: str, ctx: Context) -> Found:
    out = Found()
    marks, here, line, at, pos = [], [], 1, 0, 0
    while pos < len(text):
        m = _SHELL_TOKEN.match(text, pos)
        if m is None:
            pos += 1
            continue
        line += text.count("\n", at, m.start())
        at, pos = m.start(), m.end()
        if m["here"]:
            here.append(m["tag"])
            marks.append(("redir", m["here"], line))
        elif m["nl"]:
            for tag in here:
                end = re.compile(rf"^\t*{re.escape(tag)}$", re.M).search(text, pos)
                pos = end.end() if end else len(text)
            here = []
            marks.append(("nl", "\n", line))
        elif not m["skip"]:
            marks.append((m.lastgroup if m.lastgroup != "tag" else "redir", m.group(), line))
    # First the functions and the literals that variables hold, by enclosing function.
    scope_of, stack, scopes, i = [], [""], 0, 0
    for i, (k, x, line) in enumerate(marks):
        if k == "word" and x == "{" and i >= 2 and (marks[i - 1][1] == ")" or marks[i - 2][1] == "function" or i >= 3 and marks[i - 2][1] == ")"):
            scopes += 1
            stack.append(f"f{scopes}")
        elif k in ("word", "op") and x == "{":
            j = i - 1
            while j >= 0 and marks[j][0] == "nl":
                j -= 1
            named = j >= 0 and (marks[j][1] == ")" or j >= 1 and marks[j - 1][1] == "function")
            scopes += named
            stack.append(f"f{scopes}" if named else stack[-1])
        elif x == "}" and len(stack) > 1:
            stack.pop()
        scope_of.append(stack[-1])
    values: dict[tuple[str, str], list[str | None]] = {}
    for i, (k, x, line) in enumerate(marks):
        if k == "word" and (m := re.match(r"(\w+)=(.*)$", x, re.S)):
            value = _literal(m[2]) if not (i + 1 < len(marks) and m[2] == "" and marks[i + 1][1] in ("$(", "`")) else None
            values.setdefault((scope_of[i], m[1]), []).append(value)
    start, wrapped, skips, want_source = True, False, False, False
    cases: list[str] = []  # of each open case what is read: its word, a pattern, or the commands of an arm
    i = 0
    while i < len(marks):
        k, x, line = marks[i]
        if cases and cases[-1] == "word" and x == "in":
            cases[-1], start = "pattern", False
        elif cases and x == "esac" and (cases[-1] == "pattern" or start):
            cases.pop()
            start = False
        elif cases and cases[-1] == "pattern":
            if x == ")":
                cases[-1], start, wrapped, skips = "arm", True, False, False
        elif cases and cases[-1] == "arm" and k == "op" and x in (";;", ";&", ";;&"):
            cases[-1], want_source = "pattern", False
        elif k == "nl" or k == "op":
            start, wrapped, skips, want_source = x != ")", False, False, False
            if x == ")" and i and marks[i - 1][1] == "(":
                start = True
        elif k == "redir":
            out.see("", "redirect", line)
            if i + 1 < len(marks) and marks[i + 1][0] == "word" and not x.startswith("<<") or x == "<<<":
                i += 1
        elif x in ("$(", "`"):
            start, wrapped, skips = True, False, False
        elif want_source:
            path = _literal(x)
            if path is not None:
                out.defs.add(("source", path, ""))
            want_source = False
        elif start:
            if x == "function" and i + 1 < len(marks):
                out.function(marks[i + 1][1])
                i += 2
                if i + 1 < len(marks) and marks[i][1] == "(":
                    i += 1
            elif i + 2 < len(marks) and marks[i + 1][1] == "(" and marks[i + 2][1] == ")":
                out.function(x)
                i += 2
            elif x in ("for", "case", "select") and not wrapped:
                start = False
                cases += ["word"] * (x == "case")
            elif x in _SHELL_WORDS and not wrapped:
                pass
            elif re.match(r"\w+\+?=", x):
                pass
            else:
                name = _literal(x)
                if name in (".", "source", "\\."):
                    want_source, start = True, False
                elif name in WRAPPERS:
                    skips, wrapped = name == "command", True
                elif name:
                    out.see("", name, line, skips)
                    start = False
                else:
                    start = False
                    m = re.fullmatch(r"\"?\$\{?(\w+)\}?\"?", x)
                    known = values.get((scope_of[i], m[1]), []) if m else []
                    if known and None not in known:
                        for v in dict.fromkeys(v for v in known if v):
                            out.see("", v, line, skips)
        i += 1
    return out

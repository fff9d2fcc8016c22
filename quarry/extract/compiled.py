"""Go, Rust, Java, Kotlin, C#, C and C++."""

from __future__ import annotations

import re

from quarry.extract import Context, Found
from quarry.extract.tokens import Token, chain_at, close_of, scan, text_at, unquote


# Go
def go(text: str, ctx: Context) -> Found:
    out, t, bound = Found(), scan(text, "c", "go"), {}
    here = None
    if ctx.package:
        folder = ctx.rel.rpartition("/")[0]
        below = folder[len(ctx.package_dir or "") :].strip("/")
        here = "/".join(x for x in (ctx.package, below) if x)
    declare = lambda name: here and out.scope(here, name)
    # Functions as (first, last) tokens, with the names that are declared inside and where.
    bodies: list[tuple[int, int]] = []
    names: list[tuple[int, str]] = []
    depth = 0

    def group(i: int) -> list[int]:
        """Places of the names that a var, const or type keyword declares at file level."""
        if text_at(t, i + 1) != "(":
            found = [i + 1]
            while text_at(t, found[-1] + 1) == ",":
                found.append(found[-1] + 2)
            return found
        end, found, last, level = close_of(t, i + 1), [], 0, 0
        for j in range(i + 2, end):
            level += (t[j].text in "({[") - (t[j].text in ")}]")
            if t[j].line != last and level == 0 and t[j].kind == "id" and t[j - 1].text != ",":
                found.append(j)
                while text_at(t, found[-1] + 1) == ",":
                    found.append(found[-1] + 2)
            last = t[j].line
        return found

    for i, (_, x, _) in enumerate(t):
        if x == "{":
            depth += 1
        elif x == "}":
            depth -= 1
        elif x == "func":
            j = i + 1
            if text_at(t, j) == "(":
                close = close_of(t, j)
                if depth == 0 and close + 1 < len(t) and t[close + 1].kind == "id":
                    j = close + 1
            if depth == 0 and j < len(t) and t[j].kind == "id":
                declare(t[j].text)
                j += 1
            while j < len(t) and t[j].text not in ("{", "(", ";"):
                j += 1
            params = close_of(t, j) if text_at(t, j) == "(" else j
            k = params
            while k < len(t) and t[k].text != "{" and t[k].line - t[params].line < 3:
                k += 1
            if text_at(t, k) == "{":
                bodies.append((i, close_of(t, k)))
                names += [(q, t[q].text) for q in range(i + 1, k) if t[q].kind == "id" and t[q - 1].text in ("(", ",")]
        elif depth == 0 and x in ("type", "var", "const"):
            for j in group(i):
                if j < len(t):
                    declare(t[j].text)
        elif x == ":=" or x == "var":
            j = i - 1 if x == ":=" else i + 1
            step = -2 if x == ":=" else 2
            while 0 <= j < len(t) and t[j].kind == "id":
                names.append((j, t[j].text))
                if text_at(t, j + (1 if step > 0 else -1)) != ",":
                    break
                j += step

    def hidden(name: str, at: int) -> bool:
        return any(a <= at <= b and any(n == name and a <= q < at for q, n in names) for a, b in bodies)

    i = 0
    while i < len(t):
        k, x, line = t[i]
        if x == "import" and k == "id":
            end = close_of(t, i + 1) if text_at(t, i + 1) == "(" else i + 3
            for j in range(i + 1, min(end, len(t))):
                if t[j].kind == "str":
                    module = unquote(t[j].text)
                    alias = t[j - 1].text if t[j - 1].kind == "id" and t[j - 1].text != "import" or t[j - 1].text == "." else None
                    if not ctx.local(module):
                        out.see(module, "", t[j].line)
                        if alias not in ("_", "."):
                            bound[alias or module.rpartition("/")[2]] = module
                    if text_at(t, i + 1) != "(":
                        break
            i = end
        elif k == "id" and text_at(t, i - 1) != ".":
            chain, end = chain_at(t, i, (".",))
            if len(chain) > 1 and text_at(t, end) == "(" and chain[0] in bound and not hidden(chain[0], i):
                out.see(bound[chain[0]], ".".join(chain[1:]), line)
            i = end
        else:
            i += 1
    return out


# Rust
def _use_tree(t: list[Token], i: int, prefix: list[str]) -> tuple[list[tuple[list[str], str]], int]:
    """(path, bound name) of a use tree at i, and where it ends."""
    path = list(prefix)
    while i < len(t):
        x = t[i].text
        if x == "{":
            end, out, j = close_of(t, i), [], i + 1
            while j < end:
                made, j = _use_tree(t, j, path)
                out += made
                j += text_at(t, j) == ","
            return out, end + 1
        if x == "*":
            return [(path, "*")], i + 1
        if t[i].kind != "id":
            return [], i + 1
        path = path if x == "self" and path else [*path, x]
        if text_at(t, i + 1) == "::":
            i += 2
            continue
        if text_at(t, i + 1) == "as":
            return [(path, text_at(t, i + 2))], i + 3
        return [(path, path[-1])], i + 1
    return [], i


_OWN = ("crate", "self", "super", "Self")


def rust(text: str, ctx: Context) -> Found:
    out, t, bound = Found(), scan(text, "c", "rust"), {}
    inside = ctx.rel[len(ctx.package_dir) + 1 :] if ctx.package_dir else ctx.rel
    base = None
    if ctx.package and inside.startswith("src/"):
        parts = re.sub(r"\.rs$", "", inside[4:]).split("/")
        if parts[-1] in ("mod", "lib", "main"):
            parts = parts[:-1]
        base = {"::".join([name, *parts]) for name in {ctx.package, ctx.package.replace("-", "_")}}
    declare = lambda *n: [out.scope(*("::".join(x for x in (b, *n[:-1]) if x), n[-1])) for b in base or ()]
    pub = lambda i: "pub" in (text_at(t, i - 1), text_at(t, i - 2)) or text_at(t, i - 1) == ")" and "pub" in [x.text for x in t[max(0, i - 6) : i]]
    impls: list[tuple[int, str | None]] = []
    i = 0
    while i < len(t):
        k, x, line = t[i]
        if x == "use" and k == "id":
            made, end = _use_tree(t, i + 1 + (text_at(t, i + 1) == "::"), [])
            public = pub(i) and inside == "src/lib.rs"
            for path, name in made:
                if public and base and name != "*":
                    declare(name)
                if not path or path[0] in _OWN or ctx.local(path[0]):
                    continue
                module, symbol = ("::".join(path[:-1]), path[-1]) if len(path) > 1 and name != "*" else ("::".join(path), "")
                out.see(module, symbol, line)
                if name not in ("*", "_"):
                    bound[name] = "::".join(path)
            i = end
            continue
        if x == "extern" and text_at(t, i + 1) == "crate" and text_at(t, i + 3) == "as" and pub(i) and inside == "src/lib.rs" and ctx.package:
            out.defs.add(("alias", f"{ctx.package.replace('-', '_')}::{text_at(t, i + 4)}", text_at(t, i + 2)))
            i += 5
            continue
        if x == "impl" and k == "id":
            j, name, trait = i + 1, None, False
            while j < len(t) and t[j].text not in ("{", ";"):
                if t[j].text == "for":
                    trait = True
                elif t[j].kind == "id" and name is None and text_at(t, j - 1) not in ("<", ","):
                    name = t[j].text
                j += 1
            if text_at(t, j) == "{":
                impls.append((close_of(t, j), None if trait else name))
        elif x in ("fn", "struct", "enum", "trait") and i + 1 < len(t) and t[i + 1].kind == "id":
            name = t[i + 1].text
            impls = [m for m in impls if m[0] > i]
            if x == "fn" and impls:
                if impls[-1][1]:
                    declare(impls[-1][1], name)
            else:
                declare(name)
            if x == "enum":
                j = i + 2
                while j < len(t) and t[j].text not in ("{", ";"):
                    j += 1
                if text_at(t, j) == "{":
                    level = 0
                    for q in range(j + 1, close_of(t, j)):
                        level += (t[q].text in "({[") - (t[q].text in ")}]")
                        if level == 0 and t[q].kind == "id" and t[q - 1].text in ("{", ",", "]"):
                            declare(name, t[q].text)
            i += 2
            continue
        if k == "id" and text_at(t, i - 1) not in (".", "::"):
            chain, end = chain_at(t, i, ("::",))
            if text_at(t, end) == "::" and text_at(t, end + 1) == "<":
                j = end + 1
                level = 0
                while j < len(t):
                    level += (t[j].text == "<") - (t[j].text == ">")
                    j += 1
                    if level == 0:
                        break
                if len(chain) >= 1 and text_at(t, j) == "(":
                    end = j
            if text_at(t, end) == "(" and chain[0] not in _OWN:
                if chain[0] in bound:
                    full = bound[chain[0]].split("::") + chain[1:]
                    out.see("::".join(full[:-1]), full[-1], line) if len(full) > 1 else out.see(full[0], "", line)
                elif len(chain) > 1:
                    out.see("::".join(chain[:-1]), chain[-1], line)
            i = end
            continue
        i += 1
    return out


# Java, Kotlin
_TYPES = {"class", "interface", "enum", "record", "object"}


def _jvm(text: str, ctx: Context, kotlin: bool) -> Found:
    out, t, bound = Found(), scan(text, "c", "kotlin" if kotlin else "java"), {}
    package, stack, depth = "", [], 0  # stack: (name, depth of its body)
    qualify = lambda *n: ".".join(x for x in (package, *(s for s, _ in stack), *n) if x)
    pending: str | None = None
    i = 0
    while i < len(t):
        k, x, line = t[i]
        before = text_at(t, i - 1)
        if x == "{":
            depth += 1
            if pending is not None:
                stack.append((pending, depth))
                pending = None
        elif x == "}":
            if stack and stack[-1][1] == depth:
                stack.pop()
            depth -= 1
        elif k == "id" and x == "package" and depth == 0 and before != ".":
            names, i = chain_at(t, i + 1)
            package = ".".join(names)
            continue
        elif k == "id" and x == "import" and depth == 0 and before != ".":
            j = i + 1 + (text_at(t, i + 1) == "static")
            names, end = chain_at(t, j)
            name = ".".join(names)
            if text_at(t, end) == "." and text_at(t, end + 1) == "*":
                end += 2
            else:
                alias = text_at(t, end + 1) if kotlin and text_at(t, end) == "as" else names[-1]
                bound[alias] = name
                end += 2 * (kotlin and text_at(t, end) == "as")
            out.see(name, "", line)
            i = end
            continue
        elif k == "id" and x in _TYPES and before not in (".", "::") and i + 1 < len(t) and (t[i + 1].kind == "id" or kotlin and x == "object" and before == "companion"):
            name = t[i + 1].text if t[i + 1].kind == "id" else "Companion"
            if not (kotlin and x == "class" and before == "enum" and not name):
                out.scope(qualify(name))
                pending = name
                if x == "enum" and not kotlin or kotlin and before == "enum":
                    j = i
                    while j < len(t) and t[j].text not in ("{", ";"):
                        j += 1
                    level = 0
                    for q in range(j + 1, close_of(t, j) if text_at(t, j) == "{" else j):
                        level += (t[q].text in "({[") - (t[q].text in ")}]")
                        if level == 0 and t[q].text == ";":
                            break
                        if level == 0 and t[q].kind == "id" and t[q - 1].text in ("{", ","):
                            out.scope(qualify(name), t[q].text)
                            out.scope(qualify(name, t[q].text))
            i += 2
            continue
        elif kotlin and k == "id" and x in ("fun", "val", "var") and before not in (".", "(", ",") and i + 1 < len(t):
            j = i + 1
            if text_at(t, j) == "<":
                while j < len(t) and text_at(t, j - 1) != ">":
                    j += 1
            names, end = chain_at(t, j) if j < len(t) and t[j].kind == "id" else ([], j + 1)
            if names and (stack and depth == stack[-1][1]):
                out.scope(qualify(), names[-1].strip("`"))
            elif names and depth == 0:
                out.scope(qualify(names[-1]))
                if package:
                    out.scope(package, names[-1])
            i = end
            continue
        elif not kotlin and k == "id" and stack and depth == stack[-1][1] and before not in (".", "new", "@") and text_at(t, i + 1) in ("(", "=", ";", ",") and i and (t[i - 1].kind == "id" or before in ("]", ">", ",")):
            out.scope(qualify(), x)
            i += 1
            if text_at(t, i) == "(":
                i = close_of(t, i) + 1
            continue
        elif k == "id" and before not in (".", "?.", "::"):
            names, end = chain_at(t, i)
            call = text_at(t, end) == "("
            if x == "new" and not kotlin:
                names, end = chain_at(t, i + 1) if i + 1 < len(t) and t[i + 1].kind == "id" else ([""], i + 1)
                if names[0] in bound and len(names) == 1:
                    out.see(bound[names[0]], "", line)
            elif call and names[0] in bound:
                if len(names) == 2:
                    out.see(bound[names[0]], names[1], line)
                elif len(names) == 1 and kotlin:
                    out.see(bound[names[0]], "", line)
            i = end
            continue
        elif x == ";" or x == "=":
            pending = None if x == ";" else pending
        i += 1
    return out


def java(text: str, ctx: Context) -> Found:
    return _jvm(text, ctx, False)


def kotlin(text: str, ctx: Context) -> Found:
    return _jvm(text, ctx, True)


# C#
_CS_WORDS = set("if for foreach while switch using lock catch return new typeof nameof sizeof default checked unchecked fixed base this when throw await".split())


def csharp(text: str, ctx: Context) -> Found:
    out, t, alias = Found(), scan(text, "c", "csharp"), {}
    space, stack, depth = [], [], 0
    pending: tuple[str, str] | None = None
    generic = lambda j: re.match(r"<[\w\s,.<>\[\]?]*>\s*\(", "".join(f"{q.text} " for q in t[j : j + 24]).replace(" ", "")) is not None

    def resolve(names: list[str]) -> list[str]:
        return [*alias[names[0]].split("."), *names[1:]] if names[0] in alias else names

    i = 0
    while i < len(t):
        k, x, line = t[i]
        before = text_at(t, i - 1)
        if x == "{":
            depth += 1
            if pending:
                (space if pending[0] == "ns" else stack).append((pending[1], depth))
                pending = None
        elif x == "}":
            for level in (space, stack):
                if level and level[-1][1] == depth:
                    level.pop()
            depth -= 1
        elif x == "using" and k == "id" and text_at(t, i + 1) not in ("(", "var", "await") and i + 1 < len(t):
            j = i + 1 + (text_at(t, i + 1) == "static")
            names, end = chain_at(t, j)
            if text_at(t, end) == "=":
                target, end = chain_at(t, end + 1)
                if target[0] == "global" and text_at(t, end) == "::":
                    target, end = chain_at(t, end + 1)
                alias[names[0]] = ".".join(target)
                out.see(".".join(target), "", line)
            elif text_at(t, end) == ";":
                out.see(".".join(names), "", line)
            i = end
            continue
        elif x == "namespace" and k == "id":
            names, end = chain_at(t, i + 1)
            out.scope(".".join(n for n in (*(s for s, _ in space), *names)))
            if text_at(t, end) == ";":
                space.append((".".join(names), 0))
            else:
                pending = ("ns", ".".join(names))
            i = end
            continue
        elif k == "id" and x in ("class", "struct", "interface", "record", "enum") and i + 1 < len(t) and t[i + 1].kind == "id" and before != ".":
            pending = ("type", t[i + 1].text)
            i += 2
            continue
        elif k == "id" and stack and depth == stack[-1][1] and text_at(t, i + 1) in ("(", "<") and before not in (".", "new", "=") and i and (t[i - 1].kind == "id" and before not in _CS_WORDS or before in ("]", ">", "?")):
            owner = ".".join(s for s, _ in stack)
            full = ".".join([*(s for s, _ in space), owner])
            for name in {stack[-1][0], owner, full}:
                out.scope(name)
                out.scope(name, x)
        elif k == "id" and before not in (".", "?.", "->"):
            start = i
            if x == "global" and text_at(t, i + 1) == "::":
                start = i + 2
            if x == "new" and i + 1 < len(t) and t[i + 1].kind == "id":
                start = i + 1 + 2 * (t[i + 1].text == "global" and text_at(t, i + 2) == "::")
                names, end = chain_at(t, start)
                if len(names) > 1 or text_at(t, end) == "<":
                    out.see(".".join(resolve(names)), "", line)
                i = end
                continue
            names, end = chain_at(t, start)
            if len(names) > 1 and names[0][:1].isupper() and (text_at(t, end) == "(" or text_at(t, end) == "<" and generic(end)):
                names = resolve(names)
                out.see(".".join(names[:-1]), names[-1], line)
            i = end
            continue
        i += 1
    return out


# C, C++
_C_WORDS = set("if for while switch return sizeof catch alignof decltype defined typeof static_assert throw new delete else do case noexcept __attribute__ asm operator".split())


def _c(text: str, ctx: Context, cpp: bool) -> Found:
    out = Found()
    text = re.sub(r"\\\r?\n", lambda m: " " * len(m.group()), text)
    macros: set[str] = set()
    kept, line_no = [], 0
    defines: list[tuple[int, str, str, str]] = []
    for raw in text.split("\n"):
        line_no += 1
        m = re.match(r"\s*#\s*(\w+)\s*(.*)", raw)
        if m:
            if m[1] == "include" and (h := re.match(r"[<\"]([^>\"]+)[>\"]", m[2])):
                out.see(h[1], "", line_no, include=h[1])
            elif m[1] == "define" and (d := re.match(r"(\w+)(\(([^)]*)\))?\s*(.*)", m[2])):
                macros.add(d[1])
                rename = re.fullmatch(r"[A-Za-z_]\w*", re.sub(r"/\*.*?\*/|//.*", "", d[4]).strip()) is not None
                if d[2] and not rename:
                    out.function(d[1])
                defines.append((line_no, d[1], d[3] or "", d[4]))
            kept.append("")
        else:
            kept.append(raw)
    for number, _, params, body in defines:
        skip = {p.strip() for p in params.split(",")}
        b = scan(body, "c", "c")
        for j, (k, x, _) in enumerate(b):
            if k == "id" and text_at(b, j + 1) == "(" and x not in _C_WORDS and x not in skip and x not in macros and text_at(b, j - 1) not in (".", "->"):
                out.see("", x, number)
    t = scan("\n".join(kept), "c", "c")
    static: set[str] = set()
    owners: list[tuple[int, str]] = []  # (last token, class) of class bodies and of methods defined outside
    calls: list[tuple[str, str, int, str]] = []
    depth_fn = -1
    i = 0
    while i < len(t):
        k, x, line = t[i]
        before = text_at(t, i - 1)
        owners = [o for o in owners if o[0] >= i]
        if cpp and k == "id" and x in ("class", "struct") and before not in ("<", ",", "enum") and i + 1 < len(t) and t[i + 1].kind == "id":
            j = i + 1
            while j < len(t) and t[j].text not in ("{", ";", "(", ")", "="):
                j += 1
            if text_at(t, j) == "{":
                owners.append((close_of(t, j), t[i + 1].text))
                i = j + 1
                continue
        if k == "id" and text_at(t, i + 1) == "(" or k == "id" and text_at(t, i + 1) == "::":
            chain, end = chain_at(t, i, ("::",))
            if text_at(t, end) != "(" or chain[-1] in _C_WORDS or before in (".", "->"):
                i = max(end, i + 1)
                continue
            close = close_of(t, end)
            j = close + 1
            while text_at(t, j) in ("const", "noexcept", "override", "final"):
                j += 1
            if depth_fn < i:  # outside of function bodies: a declarator
                owner = chain[-2] if len(chain) > 1 else next((c for _, c in reversed(owners)), "")
                body = text_at(t, j) == "{" or text_at(t, j) == ":" and cpp
                if t[i - 1].kind == "id" and before not in _C_WORDS or before in ("*", "&", ">", "::", "~") or body:
                    if owner:
                        out.scope(owner, chain[-1])
                    elif chain[-1] not in macros:
                        a = i - 1
                        while a >= 0 and t[a].text not in (";", "}", "{") and i - a < 12:
                            if t[a].text == "static":
                                static.add(chain[-1])
                            a -= 1
                        if chain[-1] not in static:
                            out.function(chain[-1])
                if body:
                    while j < len(t) and t[j].text != "{":
                        j = close_of(t, j) + 1 if t[j].text == "(" else j + 1
                    if j < len(t):
                        depth_fn = close_of(t, j)
                        if owner:
                            owners.append((depth_fn, owner))
                    i = j + 1
                    continue
                i = close + 1
                continue
            if before == "::":
                calls.append(("", chain[-1], line, ""))
            elif len(chain) > 1:
                calls.append((chain[-2], chain[-1], line, ""))
            elif not (t[i - 1].kind == "id" and before not in _C_WORDS and t[i - 1].line == line):
                calls.append(("", chain[-1], line, next((c for _, c in reversed(owners)), "") if cpp else ""))
            i = end
            continue
        i += 1
    for module, symbol, line, owner in calls:
        if not (module == "" and symbol in static):
            out.see(module, symbol, line, owner=owner)
    return out


def c(text: str, ctx: Context) -> Found:
    return _c(text, ctx, False)


def cpp(text: str, ctx: Context) -> Found:
    return _c(text, ctx, True)

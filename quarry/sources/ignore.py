"""Root .gitignore rules: the last matching pattern decides, and a matched directory covers what is below it."""

from __future__ import annotations

import re


def _translate(glob: str) -> str:
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
        elif glob.startswith("**", i) and i + 2 == len(glob) and (i == 0 or glob[i - 1] == "/"):
            out.append(".+")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[{'^' + body[1:] if body[0] in '!^' else body}]")
            i = end + 1
        elif c == "\\" and i + 1 < len(glob):
            out.append(re.escape(glob[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    return "".join(out)


class IgnoreRules:
    def __init__(self, lines: list[str]):
        self.rules: list[tuple[bool, re.Pattern]] = []
        for line in lines:
            text = line if line.endswith("\\ ") else line.rstrip()
            if not text or text.startswith("#"):
                continue
            keep = text.startswith("!")
            text = text[keep:]
            folder = text.endswith("/")
            text = text.rstrip("/")
            anchored = "/" in text
            text = text.lstrip("/")
            if text:
                self.rules.append((not keep, re.compile(("" if anchored else "(?:.*/)?") + _translate(text) + ("/.*" if folder else "(?:/.*)?"), re.S)))

    @classmethod
    def of_bytes(cls, data: bytes | None) -> IgnoreRules | None:
        return None if data is None else cls(data.decode("utf-8", "replace").splitlines())

    def matches(self, path: str) -> bool:
        for ignored, pattern in reversed(self.rules):
            if pattern.fullmatch(path):
                return ignored
        return False

    def covers_dir(self, path: str) -> bool:
        return self.matches(path) or self.matches(path + "/")

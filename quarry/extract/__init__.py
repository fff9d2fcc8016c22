"""Imports, calls and declarations of source files, on a token level: no grammar library is needed.

Each language module has a function (text, Context) -> Found. Bindings are file-wide and in order: a call before its
import is not bound.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Context:
    path: str = ""  # report path
    rel: str = ""  # path below the root
    package_dir: str | None = None  # directory of the nearest manifest that names a package
    package: str | None = None
    tops: frozenset[str] = frozenset()  # names at the root and in src, also without .py

    def local(self, module: str) -> bool:
        head = module.split("/")[0].split(".")[0]
        return module.startswith(".") or not head or head in self.tops


@dataclass
class Found:
    """occurrences: (module, symbol, line, skips_function, owner, include); include: dropped if the corpus has such a path. defs: (kind, k, v)."""

    occurrences: list[tuple[str, str, int, bool, str, str | None]] = field(default_factory=list)
    defs: set[tuple[str, str, str]] = field(default_factory=set)

    def see(self, module: str, symbol: str, line: int, skips: bool = False, owner: str = "", include: str | None = None) -> None:
        self.occurrences.append((module, symbol, line, skips, owner, include))

    def scope(self, *parts: str) -> None:
        self.defs.add(("scope", "\0".join(parts), ""))

    def function(self, name: str) -> None:
        self.defs.add(("function", name, ""))

"""Languages by file extension, and the registry of extractors and analyzers."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of each language.
EXTENSIONS = {
    "typescript": (".ts", ".tsx", ".mts", ".cts"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "python": (".py", ".pyi", ".pyx"),
    "go": (".go",),
    "rust": (".rs",),
    "java": (".java",),
    "csharp": (".cs",),
}


class UnknownLanguage(ValueError):
    """No language is registered for a path."""


class Extractor(ABC):
    """A language plug-in: source bytes to symbols, edges and errors (dicts shaped as in sources.extract)."""

    language: str = ""
    extensions: tuple[str, ...] = ()

    @abstractmethod
    def extract(self, path: str, source: bytes) -> dict: ...


class Analyzer(ABC):
    """A plug-in over one file's symbols with their callers and callees."""

    name: str = ""

    @abstractmethod
    def analyze(self, symbols: list[dict], callers: dict[str, list[str]], callees: dict[str, list[str]], source: str) -> dict: ...


@dataclass
class Registry:
    """Extension to language; extractors and analyzers by name. Ships to the executors as it is."""

    by_extension: dict[str, str]
    extractors: dict[str, Extractor]
    analyzers: dict[str, Analyzer]

    def register_language(self, name: str, extensions: tuple[str, ...]) -> None:
        self.by_extension |= {e.lower(): name for e in extensions}

    def register(self, plugin: Extractor | Analyzer) -> None:
        if isinstance(plugin, Extractor):
            self.extractors[plugin.language] = plugin
            self.register_language(plugin.language, plugin.extensions)
        else:
            self.analyzers[plugin.name] = plugin

    def supported_extensions(self) -> list[str]:
        return sorted(self.by_extension)

    def detect(self, path: str) -> str:
        dot = path.rfind(".")
        found = self.by_extension.get(path[dot:].lower()) if dot > path.rfind("/") + 0 else None
        if found is None:
            raise UnknownLanguage(path)
        return found

    def language_of(self, path: Column) -> Column:
        """Null for a path of no registered language."""
        pairs = [F.lit(x) for kv in sorted(self.by_extension.items()) for x in kv]
        return F.element_at(F.create_map(*pairs), F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)))


def builtin() -> Registry:
    from .extract import BUILTIN

    r = Registry({}, {}, {})
    for name, extensions in EXTENSIONS.items():
        r.register_language(name, extensions)
    for e in BUILTIN:
        r.extractors[e.language] = e
    return r


def discover(registry: Registry, group: str = "skeingraph.plugins") -> list[str]:
    """Registers installed plug-ins of an entry-point group; returns the names of those that fail to load."""
    from importlib.metadata import entry_points

    bad = []
    for point in entry_points(group=group):
        try:
            registry.register(point.load()())
        except Exception:  # a plug-in may fail in any way
            bad.append(point.name)
    return bad

"""Source text to symbols and edges: Python through its own syntax tree, other languages by a scanner of declarations.

An extractor returns {"symbols": [...], "edges": [...], "shapes": [...], "errors": [...], "fatal": str | None}.
Lines and columns count from 0. A symbol's name is kept once per file and parent (its first definition); with
`once_per_name` once per file, whatever the parent.
"""

from __future__ import annotations

import ast
import functools
import re
from bisect import bisect_right, insort

from .languages import Extractor

MODULE, ANONYMOUS = "<module_level>", "<anonymous>"


@functools.lru_cache(maxsize=1)
def syntax(text: str) -> tuple[ast.Module | None, str]:
    """A Python text's tree, or None and why; the last text is kept, as several steps ask for one file's."""
    try:
        return ast.parse(text), ""
    except (SyntaxError, ValueError, RecursionError) as e:
        return None, str(e)


#: What no step asks for and nothing lies under: a third of a tree's nodes.
_BARE = (ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop)
_LEAVES = frozenset((ast.Name, ast.Constant, ast.Pass, ast.Break, ast.Continue, ast.alias))


def children(node: ast.AST) -> list[ast.AST]:
    """A node's own nodes in order, without contexts and operators; kept at the node, as several steps walk the same tree."""
    if type(node) in _LEAVES:
        return []
    kept = node.__dict__
    if "_children" not in kept:
        found = []
        for name in node._fields:
            x = kept.get(name)
            if type(x) is list:
                found += [y for y in x if isinstance(y, ast.AST)]
            elif isinstance(x, ast.AST):
                found.append(x)
        kept["_children"] = [x for x in found if not isinstance(x, _BARE)]
    return kept["_children"]


def every(node: ast.AST) -> list[ast.AST]:
    """The node and all below it."""
    out = [node]
    for x in out:  # it grows while it is read
        out.extend(children(x))
    return out


def place(node: ast.AST) -> tuple[int, int, int, int]:
    return (node.lineno - 1, node.col_offset, node.end_lineno - 1, node.end_col_offset)


def dotted(node: ast.expr) -> str:
    """An expression's text; unparsing takes long for a mere name."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and isinstance(node.value, (ast.Name, ast.Attribute)):
        return f"{dotted(node.value)}.{node.attr}"
    return ast.unparse(node)


def symbol(name, kind, at, parent=None, signature=None, partial=False) -> dict:
    return {"name": name, "kind": kind, "parent_symbol": parent, "signature": signature, "start_line": at[0], "start_col": at[1], "end_line": at[2], "end_col": at[3], "is_partial": partial}


def edge(source, target, kind, at) -> dict:
    return {"source": source, "target": target, "kind": kind, "start_line": at[0], "start_col": at[1], "end_line": at[2], "end_col": at[3]}


def unique(symbols: list[dict], once_per_name: bool = False) -> list[dict]:
    seen, out = set(), []
    for s in sorted(symbols, key=lambda s: (s["start_line"], s["start_col"])):
        key = s["name"] if once_per_name else (s["parent_symbol"], s["name"])
        if key not in seen:
            seen.add(key)
            out.append(s)
    return out


def first_line(text: str) -> str:
    return text.split("\n", 1)[0].strip()


class Python(Extractor):
    language, extensions = "python", (".py", ".pyi", ".pyx")

    def __init__(self, once_per_name: bool = False):
        self.once_per_name = once_per_name

    def extract(self, path: str, source: bytes) -> dict:
        text = source.decode("utf-8", "replace")
        tree, why = syntax(text)
        if tree is None:
            found = Scanned("python", self.extensions, PYTHON_LINES).extract(path, source)
            for s in found["symbols"]:
                s["is_partial"] = True
            found["errors"].append(f"{path}: {why}")
            return found
        lines = text.split("\n")
        out = {"symbols": [], "edges": [], "shapes": [], "errors": [], "fatal": None}
        self._visit(tree, lines, out, [], None)
        out["symbols"] = unique(out["symbols"], self.once_per_name)
        return out

    def _visit(self, node: ast.AST, lines: list[str], out: dict, classes: list[str], function: str | None) -> None:
        for child in children(node):
            if type(child) in _LEAVES:
                continue
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                at, parent = place(child), classes[-1] if classes else None
                out["symbols"].append(symbol(child.name, "method" if parent else "function", at, parent, first_line(lines[at[0]])))
                out["shapes"].append({"symbol": f"{parent}.{child.name}" if parent else child.name, "node": "function", "methods": 0, "lines": at[2] - at[0], "parameters": sum(a.arg != "self" for a in child.args.args), "nesting": nesting(child), "complexity": complexity(child), "line": at[0] + 1})
                self._visit(child, lines, out, classes, child.name)
            elif isinstance(child, ast.ClassDef):
                at = place(child)
                out["symbols"].append(symbol(child.name, "class", at, classes[-1] if classes else None, first_line(lines[at[0]])))
                out["shapes"].append({"symbol": child.name, "node": "class", "methods": sum(isinstance(b, ast.FunctionDef) for b in child.body), "lines": at[2] - at[0], "parameters": 0, "nesting": 0, "complexity": 0, "line": at[0] + 1})
                for base in child.bases:
                    out["edges"].append(edge(child.name, dotted(base), "extends", at))
                self._visit(child, lines, out, [*classes, child.name], None)
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                base = "." * getattr(child, "level", 0) + (child.module or "") if isinstance(child, ast.ImportFrom) else None
                for target in [base] if base is not None else [a.name for a in child.names]:
                    out["edges"].append(edge(classes[-1] if classes else MODULE, target, "imports", place(child)))
            else:
                if isinstance(child, (ast.Assign, ast.AnnAssign)) and isinstance(node, ast.Module):
                    for t in child.targets if isinstance(child, ast.Assign) else [child.target]:
                        if isinstance(t, ast.Name):
                            out["symbols"].append(symbol(t.id, "variable", place(child)))
                if isinstance(child, ast.Call):
                    target = dotted(child.func) if isinstance(child.func, (ast.Name, ast.Attribute)) else ""
                    if target and "\n" not in target:
                        out["edges"].append(edge(function or MODULE, target, "calls", place(child)))
                self._visit(child, lines, out, classes, ANONYMOUS if isinstance(child, ast.Lambda) else function)


def nesting(function: ast.AST) -> int:
    """How many blocks (if, for, while, try) lie within each other at most, level by level from the outside."""
    level, depth = [function], 0
    while True:
        inner: list[ast.AST] = []
        while level:  # what lies at this depth, and the blocks that open the next
            for child in children(level.pop()):
                (inner if isinstance(child, ast.If | ast.For | ast.While | ast.Try) else level).append(child)
        if not inner:
            return depth
        level, depth = inner, depth + 1


def complexity(function: ast.AST) -> int:
    """McCabe's number: one, and one for each branch point within the function."""
    n = 1
    for x in every(function):
        if isinstance(x, (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.Assert)):
            n += 1
        elif isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
        elif isinstance(x, ast.comprehension):
            n += 1 + len(x.ifs)
        elif isinstance(x, ast.match_case):
            n += not (isinstance(x.pattern, ast.MatchAs) and x.pattern.pattern is None)
    return n


def raw_metrics(text: str) -> dict:
    """loc, lloc, sloc, comments, multi, blank of Python text; lloc is 0 where it does not parse."""
    lines = text.split("\n")[: -1 if text.endswith("\n") else None] if text else []
    multi: set[int] = set()
    lloc = 0
    tree, _ = syntax(text)
    for n in every(tree) if tree else ():
        lloc += isinstance(n, ast.stmt)
        if isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str) and n.end_lineno > n.lineno:
            multi.update(range(n.lineno - 1, n.end_lineno))
    blank = sum(not x.strip() for i, x in enumerate(lines) if i not in multi)
    alone = sum(x.strip().startswith("#") for i, x in enumerate(lines) if i not in multi)
    return {"loc": len(lines), "lloc": lloc, "sloc": len(lines) - blank - alone - len(multi), "comments": alone, "multi": len(multi), "blank": blank}


class Scanned(Extractor):
    """Declarations and calls by patterns over text whose comments and strings are blanked; braces give the extents.

    patterns: (kind, pattern with groups name and, for members, parent); edges: (kind, pattern with group target). Two kinds
    are no kinds of symbols: a `declared` is a method if an interface is what it stands in, and an `owner` only gives its members their parent.
    """

    def __init__(self, language: str, extensions: tuple[str, ...], patterns: dict):
        self.language, self.extensions = language, extensions
        self.symbols = [(k, re.compile(p, re.MULTILINE)) for k, p in patterns["symbols"]]
        self.edges = [(k, re.compile(p, re.MULTILINE)) for k, p in patterns["edges"]]
        self.skip = re.compile(patterns["skip"], re.DOTALL)
        self.keywords = frozenset(patterns["keywords"].split())
        self.braces = patterns.get("braces", True)

    def extract(self, path: str, source: bytes) -> dict:
        text = source.decode("utf-8", "replace")
        code = self.skip.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        where = lambda i: ((k := bisect_right(starts, i) - 1), i - starts[k])
        spans: list[tuple[int, int, str, str]] = []
        symbols = []
        for kind, pattern in self.symbols:
            for m in pattern.finditer(code):
                name = m["name"]
                if name in self.keywords:
                    continue
                end = self._end(code, m.start("name"), m.end())
                if kind == "declared":
                    around = self._innermost(spans, m.start("name"), EVERY)
                    if around is None or around[3] != "interface":
                        continue
                    kind, end = "method", m.end()
                insort(spans, (m.start("name"), end, name, "class" if kind == "owner" else kind))
                if kind == "owner":
                    continue
                given = m.groupdict().get("parent")
                symbols.append((m.start("name"), end, name, kind, given, first_line(text[m.start("name") - (m.start("name") - m.start()) : m.end() + 200])))
        found = []
        for at, end, name, kind, given, signature in symbols:
            parent = given or self._around(spans, at, name, ("class", "interface"))
            if kind == "function" and parent:
                kind = "method"
            if kind == "variable" and (parent or self._around(spans, at, name, ("function", "method"))):
                continue
            found.append(symbol(name, kind, (*where(at), *where(end)), parent, signature))
        edges = []
        for kind, pattern in self.edges:
            for m in pattern.finditer(text if kind == "imports" else code):
                if kind == "imports" and m[0].strip()[0].isalpha() and code[m.start() + len(m[0]) - len(m[0].lstrip())] == " ":
                    continue  # in a comment or string
                for target in re.split(r"\s*,\s*", m["target"].strip()) if kind in ("extends", "implements") else [m["target"].strip()]:
                    bare = re.sub(r"<.*", "", target).strip("\"'` ;")
                    if not bare or bare.split(".")[0] in self.keywords:
                        continue
                    at = m.start("target")
                    if kind == "calls" and any(s[0] == at for s in spans):
                        continue
                    inside = ("function", "method") if kind == "calls" else ("class", "interface")
                    name = m.groupdict().get("source") or self._around(spans, at, None, inside) or MODULE
                    edges.append(edge(name, bare, kind, (*where(at), *where(m.end("target")))))
        return {"symbols": unique(found), "edges": edges, "shapes": [], "errors": [], "fatal": None}

    def _end(self, code: str, at: int, after: int) -> int:
        line_end = code.find("\n", after)
        line_end = len(code) if line_end < 0 else line_end
        if not self.braces:
            return line_end
        brace, semicolon = code.find("{", at), code.find(";", at)
        if brace < 0 or 0 <= semicolon < brace:
            return line_end
        depth = 0
        for m in re.finditer("[{}]", code[brace:]):
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return brace + m.end()
        return len(code)

    @staticmethod
    def _around(spans: list[tuple[int, int, str, str]], at: int, name: str | None, kinds: tuple[str, ...]) -> str | None:
        """The name of the innermost of these kinds around a place."""
        best = Scanned._innermost(spans, at, kinds)
        return best and best[2]

    @staticmethod
    def _innermost(spans: list[tuple[int, int, str, str]], at: int, kinds: tuple[str, ...]) -> tuple[int, int, str, str] | None:
        best = None
        for span in spans:
            if span[0] >= at:
                break
            if span[1] > at and span[3] in kinds:
                best = span
        return best


EVERY = ("class", "interface", "function", "method", "type", "variable")
C_SKIP = r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
CALL = r"(?<![\w.])(?:new\s+)?(?P<target>[A-Za-z_$][\w$]*(?:\s*\.\s*[A-Za-z_$][\w$]*)*)\s*\("
WORDS = "if for while switch catch return function typeof new await super else do case throw in of sizeof lock using nameof match loop func def and or not elif with assert class"

PYTHON_LINES = {
    "symbols": [("class", r"^\s*class\s+(?P<name>\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(?P<name>\w+)"), ("variable", r"^(?P<name>\w+)\s*(?::[^=\n]+)?=(?!=)")],
    "edges": [("calls", CALL), ("imports", r"^\s*(?:from|import)\s+(?P<target>[\w.]+)"), ("extends", r"class\s+(?P<source>\w+)\s*\((?P<target>[^)\n]+)\)")],
    "skip": r"#[^\n]*|\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", "keywords": WORDS, "braces": False,
}
SCRIPT = {
    "symbols": [
        ("class", r"\bclass\s+(?P<name>[\w$]+)"), ("interface", r"\binterface\s+(?P<name>[\w$]+)"), ("type", r"^\s*(?:export\s+)?type\s+(?P<name>[\w$]+)\s*[=<]"),
        ("function", r"\bfunction\s*\*?\s+(?P<name>[\w$]+)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*=\s*(?:async\s*)?(?:\([^)\n]*\)|[\w$]+)\s*(?::[^=\n]+)?=>"),
        ("function", r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+|get\s+|set\s+)*(?P<name>[\w$]+)\s*\([^)\n]*\)\s*(?::\s*[^{;\n]+)?\{"),
        ("variable", r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=(?!=)"), ("declared", r"^[ \t]+(?P<name>[\w$]+)\??[ \t]*\([^)\n]*\)[^\n{]*$"),
    ],
    "edges": [("calls", CALL), ("imports", r"\bimport\b(?:[^'\"\n;]*\bfrom\s*)?\s*['\"](?P<target>[^'\"\n]+)['\"]"), ("extends", r"\b(?:class|interface)\s+(?P<source>[\w$]+)[^{\n]*?\bextends\s+(?P<target>[\w$.]+)"), ("implements", r"\bclass\s+(?P<source>[\w$]+)[^{\n]*?\bimplements\s+(?P<target>[\w$.,\s]+)")],
    "skip": C_SKIP + r"|`(?:\\.|[^`\\])*`", "keywords": WORDS + " constructor import export",
}
GO = {
    "symbols": [
        ("class", r"^\s*(?:type\s+)?(?P<name>\w+)\s+struct\b"), ("interface", r"^\s*(?:type\s+)?(?P<name>\w+)\s+interface\b"), ("method", r"^func\s*\(\s*\w*\s*\*?(?P<parent>\w+)[^)\n]*\)\s*(?P<name>\w+)"),
        ("function", r"^func\s+(?P<name>\w+)"), ("variable", r"^\s*(?:var|const)\s+(?P<name>\w+)"), ("declared", r"^[ \t]+(?P<name>\w+)\([^)\n]*\)[^\n{]*$"),
    ],
    "edges": [("calls", CALL), ("imports", r"^[ \t]*(?:import[ \t]+)?(?:[\w.]+[ \t]+)?\"(?P<target>[^\"\n]+)\"[ \t]*$"), ("type_refs", r"^func[^{\n]*?[(,]\s*\w+\s+\*?(?P<target>[A-Z]\w*)")],
    "skip": C_SKIP + r"|`[^`]*`", "keywords": WORDS + " make len append panic struct interface map range go defer select chan",
}
RUST = {
    "symbols": [("class", r"\bstruct\s+(?P<name>\w+)"), ("interface", r"\btrait\s+(?P<name>\w+)"), ("owner", r"\bimpl(?:<[^>\n]*>)?\s+(?:[\w:<>]+\s+for\s+)?(?P<name>\w+)"), ("function", r"\bfn\s+(?P<name>\w+)"), ("variable", r"^\s*(?:pub\s+)?(?:const|static)\s+(?:mut\s+)?(?P<name>\w+)")],
    "edges": [("calls", r"(?<![\w.:!])(?P<target>[A-Za-z_]\w*(?:(?:::|\.)[A-Za-z_]\w*)*)\s*\("), ("imports", r"\buse\s+(?P<target>[\w:]+)"), ("implements", r"\bimpl(?:<[^>\n]*>)?\s+(?P<target>\w+)\s+for\s+(?P<source>\w+)"), ("type_refs", r"\bfn\s+\w+[^{\n]*?:\s*&?(?:mut\s+)?(?P<target>[A-Z]\w*)")],
    "skip": r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", "keywords": WORDS + " fn impl let mut pub use Some Ok Err",
}
JAVA = {
    "symbols": [("class", r"\b(?:class|record|enum)\s+(?P<name>\w+)"), ("interface", r"\binterface\s+(?P<name>\w+)"), ("method", r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized|override|virtual|async|internal)\s+)*(?!(?:return|new|throw|else|await|case)\b)[\w<>\[\],.?]+\s+(?P<name>\w+)\s*\([^)\n]*\)\s*(?:throws\s+[\w.,\s]+)?(?:\{|;|=>)")],
    "edges": [
        ("calls", CALL), ("imports", r"^\s*import\s+(?:static\s+)?(?P<target>[\w.*]+)"), ("extends", r"\b(?:class|interface)\s+(?P<source>\w+)[^{\n]*?\bextends\s+(?P<target>[\w.<>]+)"),
        ("implements", r"\bclass\s+(?P<source>\w+)[^{\n]*?\bimplements\s+(?P<target>[\w.,<>\s]+?)\s*\{"), ("type_refs", r"^\s+(?:(?:public|private|protected|static|final)\s+)*(?P<target>[A-Z]\w*)\s+\w+\s*[(;=]"),
    ],
    "skip": C_SKIP, "keywords": WORDS + " this",
}
CSHARP = {
    "symbols": JAVA["symbols"],
    "edges": [
        ("calls", CALL), ("imports", r"^\s*using\s+(?:static\s+)?(?P<target>[\w.]+)\s*;"), ("extends", r"\b(?:class|record)\s+(?P<source>\w+)[^{\n:]*:\s*(?P<target>(?!I[A-Z])\w+)"),
        ("implements", r"\b(?:class|record)\s+(?P<source>\w+)[^{\n:]*:\s*(?:(?!I[A-Z])\w+\s*,\s*)?(?P<target>I[A-Z]\w*(?:\s*,\s*\w+)*)"), JAVA["edges"][-1],
    ],
    "skip": C_SKIP, "keywords": WORDS + " this base var get set",
}

BUILTIN: list[Extractor] = [
    Python(),
    Scanned("typescript", (".ts", ".tsx", ".mts", ".cts"), SCRIPT),
    Scanned("javascript", (".js", ".jsx", ".mjs", ".cjs"), SCRIPT),
    Scanned("go", (".go",), GO),
    Scanned("rust", (".rs",), RUST),
    Scanned("java", (".java",), JAVA),
    Scanned("csharp", (".cs",), CSHARP),
]

"""Column expressions over names, paths and kinds."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import SYMBOL_KINDS


def last_segment(name: Column) -> Column:
    """What stands behind the last dot."""
    return F.substring_index(name, ".", -1)


def qualified_name(parent: Column, name: Column) -> Column:
    """parent.name, or name alone where the parent is null or empty."""
    return F.concat_ws(".", F.nullif(parent, F.lit("")), name)


def kind_rank(kind: Column) -> Column:
    """Place of a symbol kind in lookup order; unknown kinds come last."""
    at = F.array_position(F.array(*map(F.lit, SYMBOL_KINDS)), kind)
    return F.when(at > 0, at).otherwise(len(SYMBOL_KINDS) + 1).cast("int")


def like_literal(text: str) -> str:
    """A LIKE pattern that matches the text itself."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def complexity_rank(score: Column) -> Column:
    """A to F."""
    rank = F.lit("F")
    for most, letter in ((40, "E"), (30, "D"), (20, "C"), (10, "B"), (5, "A")):
        rank = F.when(score <= most, letter).otherwise(rank)
    return rank


#: Suffixes that tell a role, in order.
ROLE_SUFFIXES = (
    ("(Controller|Handler|View|Resource|Endpoint)$", "controller"),
    ("(Service|Manager|UseCase|Interactor|Facade)$", "service"),
    ("(Repository|Store|DAO|DataAccess|Gateway)$", "repository"),
    ("(Model|Entity|Schema|DTO|ValueObject)$", "model"),
    ("(Middleware|Interceptor|Filter)$", "middleware"),
    ("(Util|Helper|Tool)$", "utility"),
    ("(Config|Settings|Options)$", "config"),
    ("(Factory|Builder)$", "factory"),
)

#: Path patterns of architecture layers, in order.
LAYER_PATTERNS = (
    ("api", "/(api|routes?|endpoints?|controllers?|handlers?|views)/"),
    ("service", "/(service[s]?|business|domain|logic|usecases?)/"),
    ("data", "/(data|db|database|model[s]?|repository|repositories|migration[s]?|schema[s]?)/"),
    ("ui", "/(ui|components?|views?|pages?|templates?|widgets?)/"),
    ("utility", "/(util[s]?|helper[s]?|common|shared|lib[s]?)/"),
    ("config", "/(config[s]?|setting[s]?|env)/"),
)


def role(name: Column, callers: Column, callees: Column) -> Column:
    """Role by name, else by the balance of calls; counts of null are zero."""
    callers, callees = F.coalesce(callers, F.lit(0)), F.coalesce(callees, F.lit(0))
    by_calls = F.when(callees > 2 * callers, "orchestrator").when((callers > 2 * callees) & (callers > 0), "utility").otherwise("unknown")
    found = by_calls
    for pattern, title in reversed(ROLE_SUFFIXES):
        found = F.when(last_segment(name).rlike(f"(?i){pattern}"), title).otherwise(found)
    return found


def layer(path: Column, role_name: Column | None = None) -> Column:
    """Layer named in the role, else by the path, else other."""
    found = F.lit("other")
    for title, pattern in reversed(LAYER_PATTERNS):
        found = F.when(F.concat(F.lit("/"), path).rlike(f"(?i){pattern}"), title).otherwise(found)
    if role_name is not None:
        for title, _ in reversed(LAYER_PATTERNS):
            found = F.when(F.contains(F.lower(F.coalesce(role_name, F.lit(""))), F.lit(title)), title).otherwise(found)
    return found


def glob_regex(glob: str) -> str:
    """A shell glob as a regular expression over a whole path (* also crosses slashes, as fnmatch has it)."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[{'^' + body[1:] if body[0] == '!' else body}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"

"""Walks over the edge relation, level by level.

A level holds each (anchor, source, target) once, so it is bounded by the edges whatever the number of
walks that lead there; across levels an edge may reappear, as each depth is a row of its own. Fixed depths
are one lazy plan of equi-joins, and adaptive execution broadcasts the small frontiers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import kind_rank, last_segment, layer
from .lookup import first_per_key, numbered
from .tables import few, materialized

UP, DOWN = "up", "down"


#: Calls are stored under so many buckets, by the last segment of the name that is looked up.
BUCKETS = 64


def name_bucket(name: Column) -> Column:
    """Of a name: the same for all names that a dotted anchor can match."""
    return F.pmod(F.xxhash64(F.lower(last_segment(name))), F.lit(BUCKETS)).cast("int")


class Adjacency:
    """Edges of all kinds stored twice, by kind and bucket of the source and of the target, so that a step reads only its frontier's buckets.

    degrees tells how many edges a name has, at most: a search from two sides goes on where fewer will be read.
    """

    def __init__(self, by_source: DataFrame, by_target: DataFrame, degrees: DataFrame | None = None):
        self.sides, self.counted = {DOWN: by_source, UP: by_target}, degrees

    @staticmethod
    def tables(edges: DataFrame) -> dict[str, DataFrame]:
        """What to store, partitioned by kind and bucket: edges_out, edges_in and degrees."""
        rows = edges.select("source", "target", "kind", "source_file", "target_file" if "target_file" in edges.columns else F.lit(None).cast("string").alias("target_file"))
        return {"edges_out": rows.withColumn("bucket", name_bucket(F.col("source"))), "edges_in": rows.withColumn("bucket", name_bucket(F.col("target"))), "degrees": Adjacency.degrees(rows)}

    @staticmethod
    def degrees(rows: DataFrame) -> DataFrame:
        """bucket, kind, name, n_out, n_in."""
        ends = F.explode(F.array(F.struct(F.col("source").alias("name"), F.lit(1).alias("o")), F.struct(F.col("target").alias("name"), F.lit(0).alias("o")))).alias("x")
        return rows.select("kind", ends).groupBy("kind", "x.name").agg(F.sum("x.o").alias("n_out"), F.sum(1 - F.col("x.o")).alias("n_in")).withColumn("bucket", name_bucket(F.col("name")))

    @staticmethod
    def _pruned(table: DataFrame, names: DataFrame, column: str, kinds: tuple[str, ...] | None) -> DataFrame:
        found = sorted(r[0] for r in names.select(name_bucket(F.col(column))).distinct().collect() if r[0] is not None)  # BUCKETS numbers at most
        rows = table.where(F.col("bucket").isin(found))
        return rows if kinds is None else rows.where(F.col("kind").isin(*kinds))

    def near(self, names: DataFrame, column: str, direction: str, kinds: tuple[str, ...] | None = ("calls",)) -> DataFrame:
        """The edges in the buckets of the names: a superset of those that touch one. Only bucket numbers come to the driver."""
        return self._pruned(self.sides[direction], names, column, kinds).drop("bucket")

    def degree(self, names: DataFrame, direction: str, kinds: tuple[str, ...] | None = ("calls",)) -> int:
        """How many edges the names (name) have in all, at most."""
        rows = self._pruned(self.counted, names, "name", kinds).join(names.select("name"), "name", "left_semi")
        return rows.agg(F.sum("n_out" if direction == DOWN else "n_in")).first()[0] or 0


def edge_pairs(edges: DataFrame, kinds: tuple[str, ...] | None = ("calls",)) -> DataFrame:
    """source, target, repeats included: a join with a small frontier then needs no shuffle of the edges, and what it finds is made distinct."""
    rows = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    return rows.select("source", "target")


def touching(edges: DataFrame | Adjacency, frontier: DataFrame, direction: str, kinds: tuple[str, ...] | None = ("calls",)) -> DataFrame:
    """source, target of the edges that leave (down) or enter (up) a name of the frontier (name)."""
    pairs = edges.near(frontier, "name", direction, kinds).select("source", "target") if isinstance(edges, Adjacency) else edge_pairs(edges, kinds)
    at = frontier.select(F.col("name").alias("_at"))
    return pairs.join(at, pairs["target" if direction == UP else "source"] == at["_at"], "left_semi")


def first_level(edges: DataFrame | Adjacency, anchors: DataFrame, direction: str, suffix: bool = True) -> DataFrame:
    """anchor, source, target: edges that touch an anchor by its name.

    A dotted anchor also matches its last segment and, with suffix, any dotted name that ends in that segment in
    any case. Anchors may bring a file: then only edges from there (down) or into there (up) count.
    """
    side = "target" if direction == UP else "source"
    if isinstance(edges, Adjacency):
        edges = edges.near(anchors, "anchor", direction)
    cols = ["source", "target"] + ([f"{side}_file"] if "file" in anchors.columns else [])
    e = edges.where("kind = 'calls'").select(*cols).withColumn("_name", F.col(side))
    a = few(anchors.select("anchor", *(["file"] if "file" in anchors.columns else [])).distinct(), "anchors")
    exact = e.join(a, e["_name"] == a["anchor"])
    short = last_segment(F.col("anchor"))
    dotted = a.where(F.contains("anchor", F.lit("."))).withColumn("_short", F.lower(short))  # adaptive execution drops this branch if it is empty
    loose = e.withColumn("_last", F.lower(last_segment(F.col("_name")))).join(dotted, F.col("_last") == F.col("_short"))
    loose = loose.where((F.col("_name") == short) | F.contains("_name", F.lit(".")) if suffix else F.col("_name") == short).drop("_last", "_short")
    found = exact.unionByName(loose)
    if "file" in anchors.columns:
        found = found.where(F.col("file").isNull() | (F.col(f"{side}_file") == F.col("file")))
    return found.select("anchor", "source", "target").distinct()


def walk(edges: DataFrame | Adjacency, anchors: DataFrame, direction: str, depth: int = 1, suffix: bool = True) -> DataFrame:
    """anchor, source, target, depth: the walk from all anchors at once. depth below 1 counts as 1.

    Each level is kept; the next reads the buckets it needs of an Adjacency, and of plain edges those at the level's names, which are not
    shuffled while the names are few.
    """
    stored = isinstance(edges, Adjacency)
    level = first_level(edges, anchors, direction, suffix)
    level = materialized(level, "walk") if depth > 1 else level
    found = level.withColumn("depth", F.lit(1))
    pairs = None if stored else edge_pairs(edges)
    for d in range(2, depth + 1):
        at, to = ("source", "target") if direction == UP else ("target", "source")
        frontier = level.select("anchor", F.col(at).alias("_at")).distinct()
        if stored:
            near = edges.near(frontier, "_at", direction).select("source", "target")
        else:
            names = few(frontier.select("_at").distinct(), "names")
            near = pairs.join(names, pairs[to] == names["_at"], "left_semi")
        level = near.join(frontier, near[to] == frontier["_at"]).select("anchor", "source", "target").distinct()
        if d < depth:
            level = materialized(level, "walk")
        found = found.unionAll(level.withColumn("depth", F.lit(d)))
    return found


def one(spark: SparkSession, name: str, file_path: str | None = None) -> DataFrame:
    if file_path is None:
        return spark.createDataFrame([(name,)], "anchor string")
    return spark.createDataFrame([(name, file_path)], "anchor string, file string")


def callers(edges: DataFrame | Adjacency, name: str, depth: int = 1, file_path: str | None = None) -> DataFrame:
    return walk(edges, one(SparkSession.active(), name, file_path), UP, depth).drop("anchor").orderBy("depth", "source", "target")


def callees(edges: DataFrame | Adjacency, name: str, depth: int = 1, file_path: str | None = None) -> DataFrame:
    return walk(edges, one(SparkSession.active(), name, file_path), DOWN, depth).drop("anchor").orderBy("depth", "source", "target")


def impact(edges: DataFrame | Adjacency, name: str, max_depth: int = 5) -> DataFrame:
    """What a symbol leads to."""
    return callees(edges, name, max_depth)


def impact_of_files(symbols: DataFrame, edges: DataFrame, changed: DataFrame, depth: int = 3, symbols_per_file: int | None = None, targets_per_symbol: int | None = None) -> DataFrame:
    """file_path, symbol, source, target, depth for all symbols of the changed files (path); caps are reports' limits."""
    touched = symbols.join(changed.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select("file_path", "qualified_name", "id")
    if symbols_per_file is not None:
        w = Window.partitionBy("file_path").orderBy("id")
        touched = touched.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= symbols_per_file)
    touched = touched.select("file_path", F.col("qualified_name").alias("symbol")).distinct()
    found = walk(edges, touched.select(F.col("symbol").alias("anchor")).distinct(), DOWN, depth)
    rows = touched.join(found, touched["symbol"] == found["anchor"]).drop("anchor")
    if targets_per_symbol is not None:
        w = Window.partitionBy("file_path", "symbol").orderBy("depth", "source", "target")
        rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= targets_per_symbol).drop("_n")
    return rows


def neighbourhood(edges: DataFrame | Adjacency, root: str, depth: int = 2, kinds: tuple[str, ...] | None = ("calls",)) -> DataFrame:
    """name, level: every name within depth steps in either direction, at its least distance."""
    level = SparkSession.active().createDataFrame([(root,)], "name string")
    seen = level.withColumn("level", F.lit(0))
    if not isinstance(edges, Adjacency):
        edges = materialized(edge_pairs(edges, kinds).withColumn("kind", F.lit("any")), "pairs")
        kinds = None
    for d in range(1, depth + 1):
        step = touching(edges, level, DOWN, kinds).select(F.col("target").alias("name")).unionAll(touching(edges, level, UP, kinds).select(F.col("source").alias("name")))
        level = materialized(step.distinct().join(seen, "name", "left_anti"), "level")  # it is read three times by the next level
        seen = seen.unionAll(level.withColumn("level", F.lit(d)))
    return seen


def neighbourhood_graph(symbols: DataFrame, edges: DataFrame | Adjacency, root: str, depth: int = 2, cap: int = 500) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes that are known symbols (level order, at most cap), edges between them, and one row of totals."""
    reached = neighbourhood(edges, root, depth)
    known = first_per_key(symbols.join(reached, symbols["qualified_name"] == reached["name"]).select(*[symbols[c] for c in symbols.columns], "level"), ["qualified_name"], [kind_rank(F.col("kind")), "id"])
    shown = known.orderBy("level", "qualified_name").limit(cap)
    names = shown.select(F.col("qualified_name").alias("name"))
    inside = touching(edges, names, DOWN).distinct()
    inside = inside.join(names, inside["target"] == names["name"], "left_semi")
    totals = known.agg(F.count("*").alias("total_available")).withColumn("truncated", F.greatest(F.col("total_available") - cap, F.lit(0)))
    return shown, inside, totals


def discovery(symbols: DataFrame, edges: DataFrame | Adjacency, root: str, depth: int = 2, cap: int = 500, branches: int = 20) -> dict[str, DataFrame]:
    """A breadth-first walk both ways as it is met name by name, stopped when cap known symbols are found.

    A name's place comes from its first parent's place; a parent's callers come before its callees, each in the alphabet.
    nodes: place, name, level and the symbol of each known name before the stop; edges: source, target at all names that were opened;
    branches: position, symbol, depth, direction (as it was first met) of what was waiting, at most so many; totals: opened, waiting,
    total_available, truncated. Places are drawn level by level in range partitions; the driver sees counts alone.
    """
    spark = symbols.sparkSession
    if not isinstance(edges, Adjacency):  # repeats included: what is found is made distinct
        edges = materialized(edge_pairs(edges).withColumn("kind", F.lit("calls")), "pairs")
    met = "name string, direction string, place long, level int, known boolean"
    here = spark.createDataFrame([(root, "root", 1)], "name string, direction string, place long").withColumn("level", F.lit(0))
    levels, touched, waiting = [], [], spark.createDataFrame([], "symbol string, depth int, direction string, place long")
    opened = found = 0
    for d in range(depth + 1):
        names = few(here.select(F.col("name").alias("qualified_name")), "names")
        own = symbols.join(names, "qualified_name", "left_semi").select(F.col("qualified_name").alias("name"), F.lit(True).alias("known")).distinct()
        here = materialized(here.join(own, "name", "left").withColumn("known", F.coalesce("known", F.lit(False))).select(*[c.split()[0] for c in met.split(", ")]), "met")
        here_known = here.where("known")
        n_known, n_all = here_known.count(), here.count()
        stop = None
        if found + n_known >= cap:  # the place of the last symbol that is taken
            stop = here_known.orderBy("place").limit(max(cap - found, 1)).agg(F.max("place")).first()[0]
        taken = here if stop is None else here.where(F.col("place") <= stop)
        levels.append(taken)
        seen = reduce(DataFrame.unionAll, levels).select("name")
        opened = opened + n_all if stop is None else stop
        found += n_known
        more = None
        if d < depth and n_all:
            parents = taken.select("name", F.col("place").alias("_parent"))
            up, down = touching(edges, parents, UP), touching(edges, parents, DOWN)
            touched += [up, down]
            steps = up.select(F.col("target").alias("_p"), F.col("source").alias("name"), F.lit(0).alias("_way")).unionAll(down.select(F.col("source").alias("_p"), F.col("target").alias("name"), F.lit(1).alias("_way")))
            more = steps.join(parents.withColumnRenamed("name", "_p"), "_p").groupBy("name").agg(F.min(F.struct("_parent", "_way")).alias("_first"))
            more = materialized(more.join(seen, "name", "left_anti").select("name", F.when(F.col("_first._way") == 0, "caller").otherwise("callee").alias("direction"), "_first._parent", "_first._way"), "steps")
        if stop is not None:
            left = here.where(F.col("place") > stop).select(F.col("name").alias("symbol"), F.col("level").alias("depth"), "direction", "place")
            if more is not None:
                # what waits already, and is met again from an opened name, waits at the later depth
                again = more.select(F.col("name").alias("symbol"), F.lit(d + 1).alias("_later"))
                left = left.join(again, "symbol", "left").select("symbol", F.coalesce("_later", "depth").alias("depth"), "direction", "place")
                new = more.join(here.select("name"), "name", "left_anti")
                new = numbered(new, ["_parent", "_way", "name"]).select(F.col("name").alias("symbol"), F.lit(d + 1).alias("depth"), "direction", (F.col("position") + opened + n_all).alias("place"))
                left = left.unionAll(new)
            waiting = materialized(left, "waiting")
            break
        if more is None:
            break
        here = numbered(more, ["_parent", "_way", "name"]).select("name", "direction", (F.col("position") + opened).alias("place"), F.lit(d + 1).alias("level"))
    all_taken = reduce(DataFrame.unionAll, levels)
    known = few(all_taken.where("known").select(F.col("name").alias("qualified_name")), "names")
    own = first_per_key(symbols.join(known, "qualified_name", "left_semi").select(symbols.columns), ["qualified_name"], [kind_rank(F.col("kind")), "id"])
    nodes = all_taken.where("known").select("place", F.col("name").alias("qualified_name"), "level").join(own.drop("place", "level"), "qualified_name")
    nodes = nodes.select("place", "qualified_name", "level", *[c for c in own.columns if c not in ("qualified_name", "level", "place")])
    lines = reduce(DataFrame.unionAll, touched).distinct() if touched else spark.createDataFrame([], "source string, target string")
    first = waiting.orderBy("place").limit(branches)
    first = first.withColumn("position", F.row_number().over(Window.orderBy("place"))).select("position", "symbol", "depth", "direction")  # so many rows
    totals = waiting.agg(F.count("*").alias("waiting")).select(F.lit(opened).cast("long").alias("opened"), "waiting", (F.col("waiting") + opened).alias("total_available"), (F.col("waiting") > 0).alias("truncated"))
    return {"nodes": nodes, "edges": lines, "branches": first, "totals": totals}


def shortest_path(edges: DataFrame | Adjacency, source: str, target: str, max_rounds: int | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """step, name of one shortest directed path; no rows if there is none (with max_rounds: within 2 * max_rounds steps).

    Two frontiers meet: the smaller one of each round goes on; over an Adjacency, the one with fewer edges to read. Of several parents a name keeps the least, so
    the path is the same in every run. Only sizes come to the driver, and at last the path itself.
    """
    spark = SparkSession.active()
    schema = "step int, name string"
    if source == target:
        return spark.createDataFrame([(0, source)], schema)
    stored = isinstance(edges, Adjacency)
    if not stored:
        edges, kinds = materialized(edge_pairs(edges, kinds).withColumn("kind", F.lit("any")), "pairs"), None
    start = "name string, parent string, round int"
    seen = {DOWN: spark.createDataFrame([(source, None, 0)], start), UP: spark.createDataFrame([(target, None, 0)], start)}
    front = dict(seen)
    size, done = {w: edges.degree(front[w], w, kinds) if stored else 1 for w in (DOWN, UP)}, {DOWN: 0, UP: 0}
    while max_rounds is None or sum(done.values()) < 2 * max_rounds:
        way = min(size, key=lambda k: (size[k], k))
        if not size[way]:
            return spark.createDataFrame([], schema)
        at, to = ("source", "target") if way == DOWN else ("target", "source")
        step = touching(edges, front[way], way, kinds).groupBy(F.col(to).alias("name")).agg(F.min(at).alias("parent"))
        done[way] += 1
        new = materialized(step.join(seen[way], "name", "left_anti").select("name", "parent", F.lit(done[way]).alias("round")), "front")
        size[way] = edges.degree(new, way, kinds) if stored else new.count()
        front[way] = new
        seen[way] = seen[way].unionAll(new)
        other = seen[UP if way == DOWN else DOWN]
        met = new.join(other, "name", "left_semi").orderBy("name").limit(1).collect()
        if met:
            return _chain(seen, met[0]["name"])
    return spark.createDataFrame([], schema)


def _chain(seen: dict[str, DataFrame], middle: str) -> DataFrame:
    """step, name: from the middle back along parents to both ends; a name's parent was reached one round before it."""
    spark = seen[DOWN].sparkSession
    found = {}
    for side, table in seen.items():
        rounds = table.withColumnRenamed("round", "r")
        at = rounds.where(F.col("name") == middle).agg(F.max("r")).first()[0]
        here = rounds.where((F.col("name") == middle)).select("parent", "r")
        path = here.select(F.array(F.lit(middle)).alias("path"), "parent")
        for r in range(at - 1, -1, -1):  # one plan of as many one-row joins as the path has steps
            step = F.broadcast(path)
            up = rounds.where(F.col("r") == r).select("name", F.col("parent").alias("next"))
            path = up.join(step, up["name"] == step["parent"]).select(F.concat("path", F.array("name")).alias("path"), F.col("next").alias("parent"))
        found[side] = path.first()["path"]
    names = [*found[DOWN][::-1], *found[UP][1:]]
    return spark.createDataFrame(list(enumerate(names)), "step int, name string")


def full_graph(symbols: DataFrame, edges: DataFrame, roles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes once by qualified name, with layer; edges once by (source, target), of the first kind in the edge kinds' order."""
    nodes = first_per_key(symbols.select("qualified_name", "name", "kind", "file_path", "start_line", "id"), ["qualified_name"], [kind_rank(F.col("kind")), "id"])
    if roles is not None:
        nodes = nodes.join(roles.select("qualified_name", "role"), "qualified_name", "left")
    nodes = nodes.withColumn("layer", layer(F.col("file_path"), F.col("role") if roles is not None else None))
    order = F.array_position(F.array(*map(F.lit, ("calls", "imports", "extends", "implements", "type_refs"))), F.col("kind"))
    return nodes, edges.groupBy("source", "target").agg(F.min_by("kind", order).alias("kind"))


def layer_members(symbols: DataFrame) -> DataFrame:
    """layer, qualified_name of every name, once for each layer that it is in."""
    return symbols.select(layer(F.col("file_path")).alias("layer"), "qualified_name").distinct()


def layers(symbols: DataFrame) -> DataFrame:
    """layer, symbols: how many different qualified names each layer has, and the first in the alphabet."""
    rows = symbols.select("qualified_name", layer(F.col("file_path")).alias("layer")).distinct()
    return rows.groupBy("layer").agg(F.count("*").alias("symbols"), F.min("qualified_name").alias("first_symbol"))


def resolve_references(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges whose missing target span is filled with the first definition (by path, then position) of the target's name.

    A symbol is found by its bare name, by parent.name and by path::name.
    """
    s = symbols.select("name", "qualified_name", F.concat_ws("::", "file_path", "name").alias("local"), "file_path", "start_line", "start_col", "end_line", "end_col")
    keys = s.withColumn("key", F.explode(F.array_distinct(F.array("name", "qualified_name", "local"))))
    spans = ("file_path", "start_line", "start_col", "end_line", "end_col")
    first = keys.groupBy("key").agg(F.min(F.struct(*spans)).alias("_def"))
    to = ("target_file", "target_start_line", "target_start_col", "target_end_line", "target_end_col")
    joined = edges.join(first, edges["target"] == first["key"], "left")
    return joined.withColumns({c: F.coalesce(c, f"_def.{d}") for c, d in zip(to, spans, strict=True)}).select(edges.columns)

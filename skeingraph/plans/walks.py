"""Queries: lookups, walks, paths and the whole graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import LAYER_PATTERNS, ROLE_SUFFIXES
from ..operators import analytics, graph, lookup
from ..sources import star
from ..sources.star import oracle
from ..operators.tables import materialized
from .registering import registrar

QUERIES, ORACLES, query = registrar()

KIND_RANK = "CASE kind WHEN 'function' THEN 1 WHEN 'method' THEN 2 WHEN 'class' THEN 3 WHEN 'interface' THEN 4 WHEN 'type' THEN 5 ELSE 6 END"


@query(oracle("SELECT path, language, file_hash, symbol_count, edge_count, error_count FROM files"))
def list_files(spark: SparkSession, d: str) -> DataFrame:
    return lookup.list_files(star.files(spark, d))


@query(oracle("SELECT file_hash FROM files WHERE path = 'src/config/regions.py'"))
def file_hash(spark, d):
    return lookup.file_hash(star.files(spark, d), "src/config/regions.py")


@query(oracle("SELECT id, qualified_name, kind, start_line FROM symbols WHERE file_path = 'src/services/nation_3.go'"))
def symbols_for_file(spark, d):
    return lookup.symbols_for_file(star.symbols(spark, d), "src/services/nation_3.go").select("id", "qualified_name", "kind", "start_line")


@query(oracle("SELECT id, qualified_name, kind, file_path FROM symbols WHERE qualified_name = 'part_17'"))
def node_lookup(spark, d):
    return lookup.node(star.symbols(spark, d), "part_17").select("id", "qualified_name", "kind", "file_path")


@query(oracle(f"SELECT name AS qualified_name, arg_min(id, ({KIND_RANK}, id)) AS id FROM symbols GROUP BY name"))
def first_by_name(spark, d):
    s = star.symbols(spark, d).withColumn("qualified_name", F.col("name"))
    return lookup.nodes(s, s.select("qualified_name")).select("qualified_name", "id")


@query(oracle("SELECT qualified_name, kind, start_line FROM symbols WHERE qualified_name IN ('part_1', 'supplier_2', 'nation_3', 'nowhere')"))
def in_list(spark, d):
    names = spark.createDataFrame([(n,) for n in ("part_1", "supplier_2", "nation_3", "nowhere", "part_1")], "qualified_name string")
    return lookup.named(star.symbols(spark, d), names).select("qualified_name", "kind", "start_line")


@query(oracle("SELECT source, target, kind FROM edges"))
def all_edges(spark, d):
    return lookup.all_edges(star.edges(spark, d))


@query(oracle("SELECT kind, count(*) AS n FROM symbols GROUP BY kind"))
def symbols_by_kind(spark, d):
    return star.symbols(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@query(oracle("SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM edges) AS edges, 'never' AS last_indexed, (SELECT count(*) > 0 FROM embeddings) AS has_embeddings"))
def stats(spark, d):
    return lookup.stats(star.files(spark, d), star.symbols(spark, d), star.edges(spark, d), spark.read.parquet(f"{d}/embeddings.parquet"))


@query(oracle("SELECT f.path, coalesce(s.n, 0) AS symbol_count, coalesce(e.n, 0) AS edge_count FROM files f LEFT JOIN (SELECT file_path, count(*) n FROM symbols GROUP BY 1) s ON f.path = s.file_path LEFT JOIN (SELECT source_file, count(*) n FROM edges GROUP BY 1) e ON f.path = e.source_file"))
def counts_per_file(spark, d):
    return lookup.counts_per_file(star.files(spark, d), star.symbols(spark, d), star.edges(spark, d))


@query(oracle("SELECT coalesce(u.name, w.name) AS name, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees FROM (SELECT target AS name, count(*) AS callers FROM calls GROUP BY 1) u FULL JOIN (SELECT source AS name, count(*) AS callees FROM calls GROUP BY 1) w ON u.name = w.name"))
def caller_callee_counts(spark, d):
    return lookup.caller_callee_counts(star.edges(spark, d))


@query(oracle("SELECT source AS name, md5(string_agg(target, ',' ORDER BY target)) AS callees, count(*) AS n FROM calls GROUP BY 1"))
def callee_lists(spark, d):
    rows = lookup.caller_callee_lists(star.edges(spark, d)).where(F.size("callees") > 0)
    return rows.select("name", F.md5(F.array_join("callees", ",")).alias("callees"), F.size("callees").cast("long").alias("n"))


@query(oracle("SELECT id, row_number() OVER (ORDER BY qualified_name, id) AS position FROM symbols"))
def running_ids(spark, d):
    return lookup.numbered(star.symbols(spark, d).select("id", "qualified_name"), ["qualified_name", "id"]).select("id", "position")


# ---------------------------------------------------------------- walks


def _walk_sql(seed: str, depth: int, direction: str) -> str:
    step = "c.target = w.source" if direction == "up" else "c.source = w.target"
    return oracle(
        f", w(anchor, source, target, depth) AS (SELECT DISTINCT anchor, source, target, 1 FROM ({seed}) UNION SELECT w.anchor, c.source, c.target, w.depth + 1 FROM w JOIN calls c ON {step} WHERE w.depth < {depth}) "
        "SELECT DISTINCT anchor, source, target, depth FROM w", recursive=True,
    )


def _calls(spark, d):
    """The edges, kept as an engine keeps them: the view would be computed anew for every level."""
    return materialized(star.edges(spark, d), "edges")


@query(_walk_sql("SELECT 'part_5' AS anchor, source, target FROM calls WHERE target = 'part_5'", 1, "up"))
def callers_direct(spark, d):
    return graph.walk(_calls(spark, d), graph.one(spark, "part_5"), graph.UP, 1)


@query(_walk_sql("SELECT 'supplier_7' AS anchor, source, target FROM calls WHERE target = 'supplier_7'", 3, "up"))
def callers_three_levels(spark, d):
    return graph.walk(_calls(spark, d), graph.one(spark, "supplier_7"), graph.UP, 3)


@query(_walk_sql("SELECT 'order_11' AS anchor, source, target FROM calls WHERE source = 'order_11'", 3, "down"))
def callees_three_levels(spark, d):
    return graph.walk(_calls(spark, d), graph.one(spark, "order_11"), graph.DOWN, 3)


@query(_walk_sql("SELECT 'part_3' AS anchor, source, target FROM calls WHERE source = 'part_3'", 5, "down"))
def impact(spark, d):
    return graph.walk(_calls(spark, d), graph.one(spark, "part_3"), graph.DOWN, 5)


@query(_walk_sql("SELECT 'customer_1.order_11' AS anchor, source, target FROM calls WHERE source IN ('customer_1.order_11', 'order_11') OR lower(source) LIKE '%.order\\_11' ESCAPE '\\'", 2, "down"))
def short_name_walk(spark, d):
    return graph.walk(_calls(spark, d), graph.one(spark, "customer_1.order_11"), graph.DOWN, 2)


@query(_walk_sql("SELECT 'part_5' AS anchor, source, target FROM edges WHERE kind = 'calls' AND source = 'part_5' AND source_file = 'src/models/parts.py'", 2, "down"))
def callees_in_file(spark, d):
    return graph.walk(_calls(spark, d), graph.one(spark, "part_5", "src/models/parts.py"), graph.DOWN, 2)


@query(_walk_sql("SELECT s.qualified_name AS anchor, source, target FROM calls JOIN symbols s ON source = s.qualified_name WHERE s.kind = 'interface'", 3, "down"))
def walk_from_all_interfaces(spark, d):
    anchors = star.symbols(spark, d).where("kind = 'interface'").select(F.col("qualified_name").alias("anchor"))
    return graph.walk(_calls(spark, d), anchors, graph.DOWN, 3)


@query(oracle(", t AS (SELECT DISTINCT file_path, qualified_name AS symbol FROM symbols WHERE file_path IN ('src/services/nation_1.go', 'src/services/nation_2.go')), w(anchor, source, target, depth) AS (SELECT DISTINCT t.symbol, source, target, 1 FROM t JOIN calls ON source = t.symbol UNION SELECT w.anchor, c.source, c.target, w.depth + 1 FROM w JOIN calls c ON c.source = w.target WHERE w.depth < 3) SELECT DISTINCT t.file_path, t.symbol, w.source, w.target, w.depth FROM t JOIN w ON w.anchor = t.symbol", recursive=True))
def diff_impact(spark, d):
    from ..sources.changes import changed_paths

    text = "--- a/src/services/nation_1.go\n+++ b/src/services/nation_1.go\n@@ -1 +1 @@\n--- /dev/null\n+++ b/src/services/nation_2.go\n"
    changed = changed_paths(spark.createDataFrame([(text,)], "diff string"))
    return graph.impact_of_files(star.symbols(spark, d), _calls(spark, d), changed, 3)


@query(oracle(", sym AS MATERIALIZED (SELECT source a, target b FROM calls UNION SELECT target, source FROM calls), w(name, level) AS (SELECT 'supplier_3', 0 UNION SELECT b, level + 1 FROM w JOIN sym ON a = name WHERE level < 3) SELECT name, min(level) AS level FROM w GROUP BY name", recursive=True))
def neighbourhood(spark, d):
    return graph.neighbourhood(_calls(spark, d), "supplier_3", 3)


@query(oracle(", pairs AS MATERIALIZED (SELECT DISTINCT source, target FROM edges), w(name, level) AS (SELECT 'order_7', 0 UNION SELECT target, level + 1 FROM w JOIN pairs ON source = name WHERE level < 6) SELECT min(level) AS length FROM w WHERE name = 'region_2'", recursive=True))
def shortest_path_length(spark, d):
    return graph.shortest_path(_calls(spark, d), "order_7", "region_2").agg((F.count("*") - 1).cast("int").alias("length"))


def _path_sql(source: str, target: str, most: int = 8) -> str:
    """Distances from both ends; the end whose last circle is smaller goes on, so the circles' sizes tell where they meet; there the least name, and towards each end the least name one step nearer."""
    return oracle(
        f""", pairs AS MATERIALIZED (SELECT DISTINCT source, target FROM edges),
        ws(name, level) AS (SELECT '{source}', 0 UNION SELECT target, level + 1 FROM ws JOIN pairs ON source = name WHERE level < {most}), s AS MATERIALIZED (SELECT name, min(level) AS level FROM ws GROUP BY name),
        wt(name, level) AS (SELECT '{target}', 0 UNION SELECT source, level + 1 FROM wt JOIN pairs ON target = name WHERE level < {most}), t AS MATERIALIZED (SELECT name, min(level) AS level FROM wt GROUP BY name),
        size AS (SELECT 's' AS side, level, count(*) AS n FROM s GROUP BY level UNION ALL SELECT 't', level, count(*) FROM t GROUP BY level),
        turn(i, j) AS (SELECT 0, 0 UNION ALL SELECT CASE WHEN a.n <= b.n THEN i + 1 ELSE i END, CASE WHEN a.n <= b.n THEN j ELSE j + 1 END FROM turn JOIN size a ON a.side = 's' AND a.level = i JOIN size b ON b.side = 't' AND b.level = j WHERE i + j < (SELECT level FROM s WHERE name = '{target}')),
        meet AS (SELECT min(s.name) AS name, any_value(i) AS i, any_value(j) AS j FROM (SELECT * FROM turn ORDER BY i + j DESC LIMIT 1) JOIN s ON s.level = i JOIN t ON t.level = j AND t.name = s.name),
        back(name, step) AS (SELECT name, i FROM meet UNION ALL SELECT (SELECT min(p.source) FROM pairs p JOIN s ON s.name = p.source WHERE p.target = back.name AND s.level = back.step - 1), step - 1 FROM back WHERE step > 0),
        forth(name, left_, step) AS (SELECT name, j, i FROM meet UNION ALL SELECT (SELECT min(p.target) FROM pairs p JOIN t ON t.name = p.target WHERE p.source = forth.name AND t.level = forth.left_ - 1), left_ - 1, step + 1 FROM forth WHERE left_ > 0)
        SELECT CAST(step AS INTEGER) AS step, name FROM back UNION SELECT CAST(step AS INTEGER), name FROM forth""", recursive=True,
    )


@query(_path_sql("order_7", "region_2"))
def shortest_path(spark, d):
    return graph.shortest_path(_calls(spark, d), "order_7", "region_2")


@query(oracle(", w AS (SELECT source, target, source_file FROM edges WHERE kind = 'calls' AND (source = 'src.part_17' OR source = 'part_17')) SELECT DISTINCT 'src.part_17' AS anchor, source, target, 1 AS depth FROM w WHERE source_file = 'src/models/parts.py'"))
def strict_walk(spark, d):
    """By the whole name or the last segment alone, from one file."""
    anchors = spark.createDataFrame([("src.part_17", "src/models/parts.py")], "anchor string, file string")
    return graph.walk(_calls(spark, d), anchors, graph.DOWN, 1, suffix=False)


@query(oracle(", t AS (SELECT DISTINCT file_path, qualified_name AS symbol, id FROM symbols WHERE file_path LIKE 'src/services/nation_1%'), few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY id) AS n FROM t) WHERE n <= 3), e AS (SELECT DISTINCT file_path, symbol, source, target, 1 AS depth FROM few JOIN calls ON source = symbol) SELECT file_path, symbol, source, target, depth FROM (SELECT *, row_number() OVER (PARTITION BY file_path, symbol ORDER BY depth, source, target) AS n FROM e) WHERE n <= 2"))
def capped_impact(spark, d):
    """A report's limits: three symbols of a file, two targets of a symbol."""
    changed = star.files(spark, d).where("path LIKE 'src/services/nation_1%'").select("path")
    return graph.impact_of_files(star.symbols(spark, d), _calls(spark, d), changed, 1, symbols_per_file=3, targets_per_symbol=2).select("file_path", "symbol", "source", "target", "depth")


@query(oracle(" SELECT qualified_name AS symbol FROM (SELECT DISTINCT qualified_name FROM symbols WHERE kind = 'function') WHERE starts_with(qualified_name, '_') AND qualified_name NOT IN (SELECT target FROM calls) UNION ALL SELECT DISTINCT '_' || qualified_name FROM symbols WHERE kind = 'function' AND '_' || qualified_name NOT IN (SELECT target FROM calls)"))
def dead_functions(spark, d):
    """Functions with a private name that nothing calls."""
    f = star.symbols(spark, d).where("kind = 'function'")
    both = f.select(F.col("qualified_name").alias("symbol")).unionAll(f.select(F.concat(F.lit("_"), "qualified_name").alias("symbol")))
    return analytics.dead_code(both.distinct(), _calls(spark, d)).select("symbol")


def layer_sql(path: str) -> str:
    cases = " ".join(f"WHEN regexp_matches('/' || {path}, '{p}', 'i') THEN '{name}'" for name, p in LAYER_PATTERNS)
    return f"CASE {cases} ELSE 'other' END"


@query(oracle(f"SELECT qualified_name, name, kind, file_path, start_line, id, {layer_sql('file_path')} AS layer FROM symbols"))
def full_graph_nodes(spark, d):
    return graph.full_graph(star.symbols(spark, d), _calls(spark, d))[0]


@query(oracle("SELECT source, target, arg_min(kind, CASE kind WHEN 'calls' THEN 1 WHEN 'imports' THEN 2 WHEN 'extends' THEN 3 ELSE 4 END) AS kind FROM edges GROUP BY 1, 2"))
def full_graph_edges(spark, d):
    return graph.full_graph(star.symbols(spark, d), _calls(spark, d))[1]


@query(oracle(f"SELECT {layer_sql('file_path')} AS layer, count(DISTINCT qualified_name) AS symbols, min(qualified_name) AS first_symbol FROM symbols GROUP BY 1"))
def layers(spark, d):
    return graph.layers(star.symbols(spark, d))


@query(oracle(f" SELECT DISTINCT {layer_sql('file_path')} AS layer, qualified_name FROM symbols"))
def layer_members(spark, d):
    return graph.layer_members(star.symbols(spark, d))


def _spanned(spark, d):
    s = star.symbols(spark, d).select("*", F.lit(0).alias("start_col"), F.lit(1).alias("end_line"), F.lit(2).alias("end_col"))
    e = star.edges(spark, d).select("source", "target", "kind", "source_file", "source_line", *[F.lit(None).cast("string" if c == "target_file" else "int").alias(c) for c in ("target_file", "target_start_line", "target_start_col", "target_end_line", "target_end_col")])
    return s, e


@query(oracle(", k AS (SELECT name AS key, file_path, start_line FROM symbols UNION ALL SELECT qualified_name, file_path, start_line FROM symbols), f AS (SELECT key, arg_min(file_path, (file_path, start_line)) AS target_file, arg_min(start_line, (file_path, start_line)) AS target_start_line FROM k GROUP BY key) SELECT source, target, source_line, target_file, target_start_line FROM edges LEFT JOIN f ON target = key"))
def resolve_references(spark, d):
    s, e = _spanned(spark, d)
    return graph.resolve_references(e, s).select("source", "target", "source_line", "target_file", "target_start_line")


# ---------------------------------------------------------------- analytics


def role_sql(name: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({name}, '{p}', 'i') THEN '{role}'" for p, role in ROLE_SUFFIXES)
    return f"CASE {cases} WHEN callees > 2 * callers THEN 'orchestrator' WHEN callers > 2 * callees AND callers > 0 THEN 'utility' ELSE 'unknown' END"


COUNTS = ", up AS (SELECT target AS name, count(*) AS callers FROM calls GROUP BY 1), down AS (SELECT source AS name, count(*) AS callees FROM calls GROUP BY 1)"


@query(oracle(COUNTS + f" SELECT qualified_name, {role_sql('qualified_name')} AS role FROM (SELECT DISTINCT qualified_name, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees FROM symbols LEFT JOIN up ON up.name = qualified_name LEFT JOIN down ON down.name = qualified_name)"))
def roles(spark, d):
    return analytics.roles(star.symbols(spark, d), _calls(spark, d))


@query(oracle(COUNTS + " SELECT name AS symbol, CAST(callers AS INTEGER) AS caller_count FROM up WHERE callers > 10"))
def shotgun_surgery(spark, d):
    return analytics.shotgun_surgery(_calls(spark, d)).select("symbol", "caller_count")


@query(oracle(" SELECT source AS symbol, CAST(count(*) FILTER (NOT starts_with(target, source)) AS INTEGER) AS external, CAST(count(*) FILTER (starts_with(target, source)) AS INTEGER) AS internal FROM calls WHERE source IN (SELECT target FROM calls) GROUP BY 1 HAVING external > internal"))
def feature_envy(spark, d):
    return analytics.feature_envy(_calls(spark, d)).select("symbol", "external", "internal")


@query(oracle(" SELECT qualified_name AS symbol FROM (SELECT DISTINCT '_' || qualified_name AS qualified_name, qualified_name AS plain FROM symbols WHERE kind = 'class') WHERE qualified_name NOT IN (SELECT target FROM calls WHERE target IS NOT NULL)"))
def dead_code(spark, d):
    functions = star.symbols(spark, d).where("kind = 'class'").select(F.concat(F.lit("_"), "qualified_name").alias("symbol")).distinct()
    return analytics.dead_code(functions, _calls(spark, d)).select("symbol")


SHAPES = "SELECT p_partkey AS k, concat('part_', CAST(p_partkey AS {t})) AS symbol, CASE WHEN p_partkey % 2 = 0 THEN 'class' ELSE 'function' END AS node, p_size AS methods, p_size * 2 AS lines, p_size % 9 AS parameters, p_size % 7 AS nesting FROM {part}"


@query("WITH s AS (" + SHAPES.format(t="VARCHAR", part="part") + ") SELECT 'god_class' AS rule, symbol FROM s WHERE node = 'class' AND methods > 20 UNION ALL SELECT 'long_method', symbol FROM s WHERE node = 'function' AND lines > 50 UNION ALL SELECT 'long_parameter_list', symbol FROM s WHERE node = 'function' AND parameters > 5 UNION ALL SELECT 'deep_nesting', symbol FROM s WHERE node = 'function' AND nesting > 4")
def node_smells(spark, d):
    shapes = spark.sql(SHAPES.format(t="STRING", part="{part}"), part=spark.read.parquet(f"{d}/part.parquet"))
    return analytics.node_smells(shapes).select("rule", "symbol")


@query("SELECT CASE WHEN p_size <= 5 THEN 'A' WHEN p_size <= 10 THEN 'B' WHEN p_size <= 20 THEN 'C' WHEN p_size <= 30 THEN 'D' WHEN p_size <= 40 THEN 'E' ELSE 'F' END AS rank, count(*) AS n FROM part GROUP BY 1")
def rank_distribution(spark, d):
    return analytics.rank_distribution(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_size").alias("complexity")))


#: Star names hold no pattern words; the queries add some by key, the same on both sides.
WORDS = ("AppSingleton", "EventFactory", "on_click", "emit_all", "WrapperOf", "UserRepository", "get", "notify_store")
SIGNATURES = ("def get_instance(self)", "def __init__(self, component)", "def make(self) -> supplier_1:", "class X(delegate, self)")


def _pattern_symbols(spark, d):
    s = star.symbols(spark, d)
    name = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("id") % len(WORDS) + 1).cast("int"))
    signature = F.element_at(F.array(*map(F.lit, SIGNATURES)), (F.col("id") % 7 % len(SIGNATURES) + 1).cast("int"))
    return s.withColumns({"name": name, "signature": signature})


_PATTERN_SQL = oracle(
    f""", base AS (SELECT * REPLACE (list_extract({list(WORDS)}, CAST(id % {len(WORDS)} + 1 AS INTEGER)) AS name, list_extract({list(SIGNATURES)}, CAST(id % 7 % {len(SIGNATURES)} + 1 AS INTEGER)) AS signature) FROM symbols),
    l AS (SELECT *, lower(name) AS n, lower(signature) AS g FROM base),
    k AS (SELECT *, CASE WHEN contains(g, 'component') THEN 'component' WHEN contains(g, 'wrapped') THEN 'wrapped' WHEN contains(g, 'wrappee') THEN 'wrappee' WHEN contains(g, 'delegate') THEN 'delegate' END AS word FROM l WHERE kind = 'class' AND contains(signature, 'self')),
    made AS (SELECT qualified_name, rtrim(trim(regexp_extract(signature, '->(.*)$', 1)), ':') AS type FROM l WHERE kind IN ('function', 'method', 'interface') AND contains(signature, '->'))
    SELECT 'Singleton' AS pattern, qualified_name AS symbol, 'medium' AS confidence FROM l WHERE kind = 'class' AND (contains(n, '_instance') OR contains(n, 'singleton'))
    UNION ALL SELECT 'Singleton', qualified_name, 'high' FROM l WHERE kind = 'class' AND (contains(signature, 'get_instance') OR contains(signature, 'getInstance'))
    UNION ALL SELECT 'Factory', qualified_name, 'medium' FROM l WHERE contains(n, 'factory') OR contains(n, 'builder')
    UNION ALL SELECT DISTINCT 'Factory', m.qualified_name, 'low' FROM made m JOIN symbols s USING (qualified_name) JOIN calls c ON c.source = m.qualified_name WHERE s.kind IN ('function', 'method') AND m.type NOT IN ('', 'None') AND contains(c.target, m.type)
    UNION ALL SELECT 'Observer', qualified_name, 'low' FROM l WHERE contains(n, 'subscribe') OR contains(n, 'add_listener') OR contains(n, 'on_') OR contains(n, 'register') OR contains(n, 'attach')
    UNION ALL SELECT 'Observer', qualified_name, 'medium' FROM l WHERE contains(n, 'notify') OR contains(n, 'emit') OR contains(n, 'trigger') OR contains(n, 'dispatch') OR contains(n, 'fire')
    UNION ALL SELECT 'Strategy', parent_symbol, 'medium' FROM l WHERE kind = 'class' AND parent_symbol <> '' GROUP BY 2 HAVING count(*) >= 2
    UNION ALL SELECT 'Decorator', qualified_name, 'medium' FROM l WHERE kind = 'class' AND (contains(n, 'decorator') OR contains(n, 'wrapper'))
    UNION ALL SELECT 'Decorator', qualified_name, 'low' FROM k WHERE word IS NOT NULL
    UNION ALL SELECT 'Repository', qualified_name, 'high' FROM l WHERE kind = 'class' AND (contains(n, 'repository') OR contains(n, 'store') OR contains(n, 'dao') OR contains(n, 'repo'))"""
)


@query(_PATTERN_SQL)
def design_patterns(spark, d):
    return analytics.patterns(_pattern_symbols(spark, d), _calls(spark, d)).select("pattern", "symbol", "confidence")


@query(oracle(" SELECT parent_symbol AS symbol, 'Abstract base with ' || n || ' implementations: ' || array_to_string([x.qualified_name for x in few], ', ') AS evidence FROM (SELECT parent_symbol, count(*) AS n, list_sort(list(struct_pack(id := id, qualified_name := qualified_name)))[1:3] AS few FROM symbols WHERE kind = 'class' AND parent_symbol <> '' GROUP BY 1 HAVING count(*) >= 2)"))
def strategy_groups(spark, d):
    return analytics.strategies(star.symbols(spark, d)).select("symbol", "evidence")

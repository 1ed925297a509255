"""The registered queries of the core: name -> (spark, directory) -> DataFrame, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.paths import dirname
from ..functions.text import byte_prefix, code_tokens, describe as describe_node, short_text, tokens
from ..operators import community, coupling, deadcode, graph as ops, search, traversal
from ..sources.parsers import parse_calls, parse_imports, parse_symbols, parse_types
from ..sources.repository import changed_sources, is_ignored, language_of
from ..sources.tables import shared_folder, stored, table
from ..streaming import changes as stream
from .graph import SYMBOL_LABELS, CodeGraph, call_sites, heritage, heritage_edges, import_edges, parsed_graph, resolve, structure, type_edges

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Tables of the SQL side ---------------------------------------------------------------------------

_NODES = """nodes AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY symbol_id DESC) AS rn FROM (
  SELECT DISTINCT kind || ':' || file_path || ':' || CASE WHEN coalesce(class_name, '') <> '' THEN class_name || '.' ELSE '' END || name AS id, symbol_id, kind AS label, name, file_path, repo,
    coalesce(class_name, '') AS class_name, start_line, end_line, coalesce(is_exported, false) AS is_exported, coalesce(signature, '') AS signature, coalesce(content, '') AS content, coalesce(array_to_string(decorators, ' '), '') AS decorators,
    regexp_replace(file_path, '/[^/]*$', '') AS dir
  FROM symbols WHERE kind IS NOT NULL AND file_path IS NOT NULL AND name IS NOT NULL)) WHERE rn = 1)"""


def _nearest(uses: str, order: str, name: str) -> str:
    """The SQL of a resolution to the nearest definition."""
    levels = ["file_path", "dir", "repo", None]
    parts = [f"{name}_cand AS (SELECT id, name, file_path, dir, repo, {order} AS rank FROM nodes WHERE {order} IS NOT NULL)"]
    for k, level in enumerate(levels):
        keys = f"{level}, name" if level else "name"
        parts.append(f"{name}_{k} AS (SELECT {keys}, min(rank || '|' || id) AS best FROM {name}_cand GROUP BY {keys})")
    joins = " ".join(f"LEFT JOIN {name}_{k} t{k} ON t{k}.name = u.name" + (f" AND t{k}.{level} = u.{level}" if level else "") for k, level in enumerate(levels))
    parts.append(f"{name}_found AS (SELECT DISTINCT src, dst FROM (SELECT u.src, substr(coalesce(t0.best, t1.best, t2.best, t3.best), 3) AS dst FROM {uses} u {joins}) WHERE dst IS NOT NULL AND dst <> src)")
    return ",\n".join(parts)


_CALLS = (
    "call_uses AS (SELECT DISTINCT id AS src, file_path, dir, repo, unnest(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_]*)\\(', 1)) AS name FROM nodes WHERE label IN ('function', 'method')),\n"
    + _nearest("call_uses", "CASE label WHEN 'function' THEN 1 WHEN 'method' THEN 2 WHEN 'class' THEN 3 WHEN 'interface' THEN 4 END", "calls")
    + ",\ncalls AS (SELECT f.src, f.dst FROM calls_found f JOIN nodes a ON a.id = f.src JOIN nodes b ON b.id = f.dst WHERE a.name <> b.name)"
)
_TYPES = (
    "type_uses AS (SELECT DISTINCT id AS src, file_path, dir, repo, unnest(regexp_extract_all(signature, ':\\s*([A-Z][A-Za-z0-9_]*)', 1)) AS name FROM nodes WHERE label IN ('function', 'method')),\n"
    + _nearest("type_uses", "CASE label WHEN 'class' THEN 1 WHEN 'interface' THEN 2 END", "types")
)
_HERITAGE = (
    "bases AS (SELECT DISTINCT id, base, CASE WHEN implemented OR regexp_matches(base, '(Mixin|Protocol)$') THEN 'implements' ELSE 'extends' END AS type FROM ("
    "SELECT id, unnest(regexp_split_to_array(regexp_extract(signature, '^class\\s+\\w+\\s*\\(([^)]*)\\)', 1), '\\s*,\\s*')) AS base, false AS implemented FROM nodes WHERE label = 'class' "
    "UNION ALL SELECT id, regexp_extract(signature, '\\sextends\\s+(\\w+)', 1), false FROM nodes WHERE label = 'class' "
    "UNION ALL SELECT id, regexp_extract(signature, '\\simplements\\s+(\\w+)', 1), true FROM nodes WHERE label = 'class') WHERE regexp_matches(base, '^[A-Za-z_]\\w*$')),\n"
    "base_uses AS (SELECT b.id AS src, n.file_path, n.dir, n.repo, b.base AS name, b.type FROM bases b JOIN nodes n USING (id)),\n"
    + _nearest("base_uses", "CASE label WHEN 'class' THEN 1 WHEN 'interface' THEN 2 END", "bases")
    + ",\nheritage AS (SELECT f.src, f.dst, k.type FROM bases_found f JOIN nodes d ON d.id = f.dst JOIN (SELECT src, name, min(type) AS type FROM base_uses GROUP BY src, name) k ON k.src = f.src AND k.name = d.name)"
)
_PATHS = """paths AS (SELECT DISTINCT repo || '/' || rel_path AS file_path FROM files WHERE repo IS NOT NULL AND rel_path IS NOT NULL),
folders AS (SELECT DISTINCT unnest(list_transform(range(1, len(string_split(file_path, '/'))), lambda n: array_to_string(string_split(file_path, '/')[1:n], '/'))) AS file_path FROM paths),
structure AS (SELECT 'file:' || file_path AS id, 'file' AS label, string_split(file_path, '/')[-1] AS name, file_path FROM paths UNION ALL SELECT 'folder:' || file_path, 'folder', string_split(file_path, '/')[-1], file_path FROM folders),
contains AS (SELECT 'folder:' || regexp_replace(file_path, '/[^/]*$', '') AS src, id AS dst FROM structure WHERE contains(file_path, '/'))"""
_IMPORTS = """wanted AS (SELECT DISTINCT 'file:' || file_path AS src, array_to_string(folder[1:len(folder) - ups], '/') || '/' || rest AS target FROM (
  SELECT file_path, string_split(regexp_replace(file_path, '/[^/]*$', ''), '/') AS folder,
    CASE WHEN file_path LIKE '%.py' THEN length(regexp_extract(module_path, '^(\\.*)', 1)) - 1 ELSE (length(module_path) - length(replace(module_path, '../', ''))) // 3 END AS ups,
    CASE WHEN file_path LIKE '%.py' THEN replace(regexp_replace(module_path, '^\\.+', ''), '.', '/') ELSE regexp_replace(module_path, '^(\\.\\.?/)+', '') END AS rest
  FROM imports WHERE is_relative AND module_path IS NOT NULL AND file_path IS NOT NULL) WHERE len(folder) - ups > 0),
known AS (SELECT regexp_replace(file_path, '\\.[^./]+$', '') AS target, min(file_path) AS file_path FROM paths GROUP BY 1),
import_edges AS (SELECT DISTINCT src, 'file:' || k.file_path AS dst FROM wanted JOIN known k USING (target) WHERE src <> 'file:' || k.file_path)"""
_CHANGES = "changes AS (SELECT DISTINCT repo, commit_id, file FROM commits WHERE repo IS NOT NULL AND commit_id IS NOT NULL AND file IS NOT NULL AND file <> '')"
_PAIRS = _CHANGES + """,
pairs AS (SELECT a.repo, a.file AS file_a, b.file AS file_b, count(*) AS co_changes FROM changes a JOIN changes b ON a.repo = b.repo AND a.commit_id = b.commit_id AND a.file < b.file GROUP BY 1, 2, 3)"""
_ENTRY = "((label = 'function' AND name = 'main') OR (label = 'function' AND regexp_matches(name, '^(Test|test_)')) OR regexp_matches(decorators, 'HandleFunc|Handle|http\\.') OR regexp_matches(name, 'Cmd|Command'))"
_EXEMPT = f"({_ENTRY} OR is_exported OR regexp_matches(file_path, '_test\\.(go|py)$') OR (label = 'function' AND regexp_matches(name, '^(Test|test_)')) OR (starts_with(name, '__') AND ends_with(name, '__')) OR (label = 'method' AND (name = 'New' || class_name OR name = '__init__')))"
_PATTERNS = """patterns AS (SELECT id, ['intra_class', 'intra_file', 'dynamic_dispatch', 'framework_dispatch'][max(rank)] AS call_pattern FROM (SELECT c.dst AS id,
  CASE WHEN contains(s.file_path, 'cmd.go') AND (s.name = 'Run' OR ends_with(s.name, 'Cmd')) THEN 4 WHEN contains(s.file_path, 'server.go') AND contains(s.name, 'handle') THEN 3 WHEN s.file_path = d.file_path THEN 2
    WHEN s.label = 'method' AND d.label = 'method' AND s.class_name <> '' AND s.class_name = d.class_name THEN 1 END AS rank
  FROM calls c JOIN nodes s ON s.id = c.src JOIN nodes d ON d.id = c.dst) WHERE rank IS NOT NULL GROUP BY id)"""
_DEAD = (
    _PATTERNS
    + f""",
suspects AS (SELECT n.*, p.call_pattern FROM nodes n LEFT JOIN patterns p USING (id) WHERE n.id NOT IN (SELECT dst FROM calls) AND NOT {_EXEMPT.replace("name", "n.name").replace("class_n.name", "n.class_name").replace("label", "n.label").replace("file_path", "n.file_path")}
  AND NOT ((contains(n.file_path, 'server.go') AND starts_with(n.name, 'handle')) OR (contains(n.file_path, 'cmd.go') AND regexp_matches(n.name, '^(setup|configure|output)')) OR starts_with(n.name, 'register') OR coalesce(p.call_pattern IN ('dynamic_dispatch', 'framework_dispatch', 'interface_impl', 'callback'), false))),
overriding AS (SELECT DISTINCT s.id FROM suspects s JOIN nodes k ON k.label = 'class' AND k.name = s.class_name JOIN heritage h ON h.src = k.id AND h.type = 'extends' JOIN nodes b ON b.id = h.dst AND b.label = 'class'
  JOIN nodes m ON m.label = 'method' AND m.class_name = b.name AND m.name = s.name WHERE s.label = 'method' AND m.id NOT IN (SELECT id FROM suspects)),
dead AS (SELECT id, label, name, file_path, CASE WHEN coalesce(call_pattern IN ('dynamic_dispatch', 'framework_dispatch'), false) THEN 'low' WHEN coalesce(call_pattern = 'intra_class', false) OR contains(file_path, '_test') OR (label IN ('function', 'method') AND regexp_matches(name, '^[a-z]')) THEN 'medium' ELSE 'high' END AS confidence
  FROM suspects WHERE id NOT IN (SELECT id FROM overriding))"""
)
_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda t: length(t) >= 2)"
_DOC_POSTINGS = f"postings AS (SELECT token, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents) GROUP BY 1, 2)"
_NODE_POSTINGS = "postings AS (SELECT token, id, count(*) AS tf FROM (SELECT id, unnest({0} || {1} || {2}) AS token FROM nodes) GROUP BY 1, 2)".format(_TOKENS.format("name"), _TOKENS.format("content"), _TOKENS.format("signature"))


def _bytes(n: int) -> str:
    """The SQL of the first bytes of content, a cut character replaced."""
    fits = f"list_max(list_transform(range(1, {n + 1}), lambda k: CASE WHEN octet_length(encode(substr(content, 1, k::BIGINT))) <= {n} THEN k ELSE 0 END))"
    return f"CASE WHEN octet_length(encode(content)) <= {n} THEN content WHEN octet_length(encode(substr(content, 1, {n}))) <= {n} THEN substr(content, 1, {n}) ELSE substr(content, 1, {fits}) || CASE WHEN octet_length(encode(substr(content, 1, {fits}))) < {n} THEN chr(65533) ELSE '' END END"


_TFIDF = f"""words AS (SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM (SELECT doc_id, {_TOKENS.format("text")} AS toks FROM documents)),
vocab AS (SELECT term, row_number() OVER (ORDER BY d, p, term) - 1 AS idx FROM (SELECT term, (min({{'d': doc_id, 'p': pos}})).d AS d, (min({{'d': doc_id, 'p': pos}})).p AS p FROM words GROUP BY term ORDER BY 2, 3, 1 LIMIT 100)),
idf AS (SELECT term, df, ln((SELECT count(DISTINCT doc_id) FROM documents)::DOUBLE / df) AS idf FROM (SELECT term, count(DISTINCT doc_id) AS df FROM words GROUP BY term)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2),
parts AS (SELECT t.doc_id, v.idx, t.tf / m.most * CASE WHEN i.idf = 0 THEN 1.0 ELSE i.idf END AS w FROM tf t JOIN vocab v USING (term) JOIN idf i USING (term) JOIN (SELECT doc_id, max(tf)::DOUBLE AS most FROM tf GROUP BY 1) m USING (doc_id)),
tfidf AS (SELECT p.doc_id, p.idx, p.w / n.norm AS weight FROM parts p JOIN (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM parts GROUP BY 1) n USING (doc_id) WHERE n.norm > 0)"""
_SPARSE_OF = """words AS (SELECT {1}, unnest({2}) AS term FROM {0}), tf AS (SELECT {1}, term, count(*) AS tf FROM words GROUP BY 1, 2), idf AS (SELECT term, ln((SELECT count(DISTINCT {1}) FROM {0})::DOUBLE / count(*)) AS idf FROM tf GROUP BY term),
parts AS (SELECT t.{1}, t.term, t.tf / m.most * CASE WHEN i.idf = 0 THEN 1.0 ELSE i.idf END AS w FROM tf t JOIN idf i USING (term) JOIN (SELECT {1}, max(tf)::DOUBLE AS most FROM tf GROUP BY 1) m USING ({1})),
sparse AS (SELECT p.{1}, p.term, p.w / n.norm AS weight FROM parts p JOIN (SELECT {1}, sqrt(sum(w * w)) AS norm FROM parts GROUP BY 1) n USING ({1}) WHERE n.norm > 0)"""
_LONG = f"label || ' ' || name || '. in file ' || file_path || CASE WHEN signature <> '' THEN '. Signature: ' || signature ELSE '' END || CASE WHEN content <> '' THEN '. Code: ' || {_bytes(500)} ELSE '' END || CASE WHEN class_name <> '' THEN '. Method of class ' || class_name ELSE '' END"
_SPARSE = _SPARSE_OF.format("documents", "doc_id", _TOKENS.format("text"))
_SPARSE_NODES = f"described AS (SELECT id, {_LONG} AS text FROM nodes), " + _SPARSE_OF.format("described", "id", _TOKENS.format("text"))
#: The set of code tokens of a word.
_CODE_TOKENS = (
    "list_distinct([lower({0})] || list_filter("
    "regexp_split_to_array(lower({0}), '[_.\\-\\s]+') || regexp_split_to_array(lower(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[_.\\-\\s]+')"
    " || regexp_split_to_array(lower(regexp_replace(regexp_replace({0}, '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')), '[_.\\-\\s]+')"
    " || regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')), '[_.\\-\\s]+'), lambda t: t <> ''))"
)
_QUERY_TERMS = ("cache", "graph", "merge", "graph")
_TIMES = "(VALUES ('cache', 1), ('graph', 2), ('merge', 1)) q(token, n)"


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# Sources and structure ----------------------------------------------------------------------------


@query("scan_files", "SELECT DISTINCT file_id, repo, rel_path, lower(sha256(content)) AS sha256, octet_length(content) AS size FROM files WHERE content IS NOT NULL")
def scan_files(spark, base):
    """Every file with the hash and size of its content."""
    return table(spark, base, "files").where("content is not null").select("file_id", "repo", "rel_path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size")).distinct()


@query("lang_of", "SELECT t.language AS lang, count(DISTINCT f.file_id) AS files FROM files f LEFT JOIN file_types t ON t.extension = lower(regexp_extract(f.rel_path, '(\\.[^./]+)$', 1)) GROUP BY 1")
def lang_of(spark, base):
    """Files by the language of their extension."""
    return table(spark, base, "files").select("file_id", language_of(F.col("rel_path")).alias("lang")).groupBy("lang").agg(F.countDistinct("file_id").alias("files"))


@query("ignore_filter", "SELECT DISTINCT file_id, rel_path FROM files WHERE NOT regexp_matches('/' || rel_path, '/(node_modules|vendor|dist|build)/|/[^/]*\\.min\\.js(/|$)')")
def ignore_filter(spark, base):
    """Files outside ignored folders and patterns."""
    return table(spark, base, "files").where(~is_ignored(F.col("rel_path"), ("node_modules/", "vendor/", "dist/", "build/", "*.min.js"))).select("file_id", "rel_path").distinct()


@query("commit_scan", f"WITH {_CHANGES} SELECT repo, count(DISTINCT commit_id) AS commits, count(*) AS changes FROM changes GROUP BY repo")
def commit_scan(spark, base):
    """Commits and changed files by repository."""
    return coupling.changes(table(spark, base, "commits")).groupBy("repo").agg(F.countDistinct("commit_id").alias("commits"), F.count("*").alias("changes"))


@query("structure", f"WITH {_PATHS} SELECT src, dst FROM contains")
def structure_edges(spark, base):
    """Folders and what they contain."""
    return structure(table(spark, base, "files"))[1]


@query("defines", f"WITH {_NODES} SELECT 'file:' || file_path AS src, id AS dst FROM nodes")
def defines(spark, base):
    """Files and the symbols that they define."""
    return CodeGraph(spark, base).symbols.select(F.concat(F.lit("file:"), F.col("file_path")).alias("src"), F.col("id").alias("dst"))


@query("imports", f"WITH {_PATHS}, {_IMPORTS} SELECT src, dst FROM import_edges")
def imports(spark, base):
    """Relative imports that name another file."""
    return import_edges(table(spark, base, "files"), table(spark, base, "imports"))


_HAVE = "file_id IN (SELECT file_id FROM files WHERE content IS NOT NULL)"


@query("parse_symbols", f"SELECT DISTINCT file_id, name, kind FROM symbols WHERE {_HAVE} UNION SELECT file_id, class_name, 'class' FROM symbols WHERE class_name <> '' AND {_HAVE} AND NOT regexp_matches(file_path, '\\.go$') UNION SELECT s.file_id, s.class_name, 'class' FROM symbols s JOIN files f USING (file_id) WHERE s.class_name <> '' AND contains(f.content::VARCHAR, 'type ' || s.class_name || ' struct')")
def parsed_symbols(spark, base):
    """Functions, methods, classes and interfaces as parsed from the files that the symbols table knows: those there, and the classes that it names with their methods only."""
    found = parse_symbols(table(spark, base, "files")).where("kind in ('function', 'method', 'class', 'interface')").select("file_id", "name", "kind").distinct()
    return found.join(table(spark, base, "symbols").select("file_id").distinct(), "file_id", "left_semi")


@query("parse_positions", f"SELECT DISTINCT file_id, name, kind, coalesce(class_name, '') AS class_name, start_line, end_line FROM symbols WHERE kind <> 'class' AND {_HAVE}")
def parsed_positions(spark, base):
    """Where the functions, methods and interfaces of these files begin and end, and their classes."""
    found = parse_symbols(table(spark, base, "files")).where("kind in ('function', 'method', 'interface')").select("file_id", "name", "kind", "class_name", "start_line", "end_line").distinct()
    return found.join(table(spark, base, "symbols").select("file_id").distinct(), "file_id", "left_semi")


@query("parse_symbols_all")
def all_parsed_symbols(spark, base):
    """All that is parsed from all files, with type aliases, enums and all columns."""
    return parse_symbols(table(spark, base, "files"))


@query("parse_imports", f"SELECT DISTINCT file_id, module_path, is_relative FROM imports WHERE {_HAVE} UNION SELECT file_id, 'logging', false FROM files WHERE file_id IN (SELECT file_id FROM imports) AND regexp_matches(rel_path, '\\.py$') AND regexp_matches(content::VARCHAR, '(^|\\\\x0A|\\\\x0D|\\\\xBF)import logging(\\\\x0A|\\\\x0D|$)')")
def parsed_imports(spark, base):
    """Imported modules as parsed, of files that the imports table knows; one module of the standard library, which that table lacks, is read from the texts by both sides."""
    found = parse_imports(table(spark, base, "files")).select("file_id", "module_path", "is_relative").distinct()
    return found.join(table(spark, base, "imports").select("file_id").distinct(), "file_id", "left_semi")


@query("parse_imports_all")
def all_parsed_imports(spark, base):
    """The modules of all import statements of all files, with all columns."""
    return parse_imports(table(spark, base, "files"))


@query("parse_calls")
def all_parsed_calls(spark, base):
    """All call sites of all files, with receivers and packages."""
    return parse_calls(table(spark, base, "files"))


@query("parse_types")
def all_parsed_types(spark, base):
    """The types that the signatures of all files name."""
    return parse_types(table(spark, base, "files"))


@query("parsed_graph")
def graph_of_files(spark, base):
    """The calls of the graph that is parsed from the files alone, resolved by package, receiver and name."""
    return parsed_graph(table(spark, base, "files"), "span")[1]


_SITES = """known_alias AS (SELECT file_path, CASE WHEN coalesce(alias, '') <> '' THEN alias ELSE regexp_split_to_array(module_path, '[/.]')[-1] END AS before, min(module_path) AS package FROM imports WHERE module_path IS NOT NULL AND file_path IS NOT NULL GROUP BY 1, 2),
raw_sites AS (SELECT DISTINCT id AS src, name AS own_name, file_path, class_name, regexp_extract(content, 'func \\((\\w+) ', 1) AS own, unnest(regexp_extract_all(content, '(?:([A-Za-z_][A-Za-z0-9_]*)\\.)?([A-Za-z_][A-Za-z0-9_]*)\\(', 1)) AS before, unnest(regexp_extract_all(content, '(?:([A-Za-z_][A-Za-z0-9_]*)\\.)?([A-Za-z_][A-Za-z0-9_]*)\\(', 2)) AS name FROM nodes WHERE label IN ('function', 'method')),
sites AS (SELECT DISTINCT src, r.file_path, name, CASE WHEN package IS NOT NULL THEN '' WHEN class_name <> '' AND (r.before IN ('self', 'cls', 'this') OR (r.before <> '' AND r.before = own)) THEN class_name ELSE r.before END AS receiver, coalesce(package, '') AS package FROM raw_sites r LEFT JOIN known_alias k ON k.file_path = r.file_path AND k.before = r.before WHERE name <> own_name)"""
_RULES = """funcs AS (SELECT id, name, string_split(regexp_replace(CASE WHEN contains(file_path, '/') THEN dir ELSE '' END, '/$', ''), '/')[-1] AS folder FROM nodes WHERE label = 'function'),
ruled AS (SELECT src, id AS dst, 1 AS rule, name, package, receiver, 0 AS o FROM sites s JOIN funcs f USING (name) WHERE s.package <> '' AND f.folder = regexp_split_to_array(s.package, '[/.]')[-1]
  UNION ALL SELECT src, id, 2, name, package, receiver, 0 FROM sites s JOIN funcs USING (name) WHERE s.package <> ''
  UNION ALL SELECT src, n.id, 3, s.name, package, receiver, 0 FROM sites s JOIN nodes n ON n.name = s.name AND n.label = 'method' AND n.class_name = s.receiver WHERE s.receiver <> ''
  UNION ALL SELECT src, n.id, 4, s.name, package, receiver, CASE n.label WHEN 'function' THEN 1 WHEN 'class' THEN 2 ELSE 3 END FROM sites s JOIN nodes n ON n.name = s.name AND n.label IN ('function', 'class', 'interface')),
resolved AS (SELECT src, dst, min(rule) AS rule FROM (SELECT src, dst, rule FROM (SELECT *, row_number() OVER (PARTITION BY src, name, package, receiver ORDER BY rule, o, dst) AS k FROM ruled) WHERE k = 1) WHERE src <> dst GROUP BY 1, 2)"""


@query("resolve_receivers", f"WITH {_NODES}, {_SITES}, {_RULES} SELECT src, dst, rule FROM resolved")
def resolve_receivers(spark, base):
    """Calls of the symbols, resolved by package, receiver and name in this order."""
    nodes = CodeGraph(spark, base).symbols
    return resolve(call_sites(nodes, table(spark, base, "imports")), nodes)


@query("gitignore_filter", "SELECT DISTINCT file_id, rel_path FROM files WHERE NOT ((regexp_matches('/' || rel_path, '/tests?/|/[^/]*_test\\.go$') AND NOT regexp_matches('/' || rel_path, '^/tests/[^/]*\\.go$')) OR regexp_matches('/' || rel_path, '^/core/'))")
def gitignore_filter(spark, base):
    """Files that a list of ignore patterns with exceptions and anchors leaves."""
    return table(spark, base, "files").where(~is_ignored(F.col("rel_path"), ("# remarks", "", "test/", "tests/", "*_test.go", "!/tests/*.go", "/core/"))).select("file_id", "rel_path").distinct()


@query("changed_sources", f"WITH {_CHANGES} SELECT repo, commit_id, file FROM changes WHERE regexp_matches(lower(file), '\\.(py|go|ts|tsx|js|jsx|mjs|cjs)$') AND NOT regexp_matches('/' || file, '/(node_modules|__pycache__|venv|coverage|htmlcov)/')")
def changed_sources_of(spark, base):
    """Changed files that are source files and not ignored."""
    return changed_sources(coupling.changes(table(spark, base, "commits")))


@query("recent_commits", f"WITH {_CHANGES.replace('FROM commits WHERE', 'FROM commits WHERE committed_at >= (SELECT max(committed_at) - INTERVAL 6 MONTH FROM commits) AND')} SELECT repo, count(DISTINCT commit_id) AS commits FROM changes GROUP BY repo")
def recent_commits(spark, base):
    """Commits of the last six months by repository."""
    return coupling.changes(coupling.recent(table(spark, base, "commits"), 6)).groupBy("repo").agg(F.countDistinct("commit_id").alias("commits"))


@query("resolve_calls", f"WITH {_NODES}, {_CALLS} SELECT src, dst FROM calls")
def resolve_calls(spark, base):
    """Calls, resolved to the nearest definition."""
    return CodeGraph(spark, base).calls


@query("uses_type", f"WITH {_NODES}, {_TYPES} SELECT src, dst FROM types_found")
def uses_type(spark, base):
    """Symbols and the types that their signatures name."""
    return type_edges(CodeGraph(spark, base).symbols)


@query("heritage", f"WITH {_NODES}, {_HERITAGE} SELECT id, base, type FROM bases")
def heritage_names(spark, base):
    """Classes and the names of their bases."""
    return heritage(CodeGraph(spark, base).symbols)


@query("heritage_edges", f"WITH {_NODES}, {_HERITAGE} SELECT src, dst, type FROM heritage")
def heritage_known(spark, base):
    """Classes and their known bases."""
    return heritage_edges(CodeGraph(spark, base).symbols)


# Filters and counts -------------------------------------------------------------------------------


@query("scan_nodes", f"WITH {_NODES} SELECT id, label, name, file_path, class_name, start_line, end_line, is_exported FROM nodes")
def scan_nodes(spark, base):
    """All symbol nodes."""
    return CodeGraph(spark, base).symbols.select("id", "label", "name", "file_path", "class_name", "start_line", "end_line", "is_exported")


@query("node_get", f"WITH {_NODES} SELECT id, label, name, file_path FROM nodes WHERE id = (SELECT min(id) FROM nodes)")
def node_get(spark, base):
    """The node of one id, here the least."""
    nodes = CodeGraph(spark, base).symbols
    return nodes.where(F.col("id") == nodes.agg(F.min("id")).scalar()).select("id", "label", "name", "file_path")


@query("nodes_by_label", f"WITH {_NODES} SELECT id, name FROM nodes WHERE label = 'class'")
def nodes_by_label(spark, base):
    """Nodes of one label."""
    return ops.with_label(CodeGraph(spark, base).symbols, "class").select("id", "name")


@query("edges_by_type", f"WITH {_NODES} SELECT 'file:' || file_path AS src, id AS dst FROM nodes")
def edges_by_type(spark, base):
    """Edges of one type out of all."""
    return ops.of_type(CodeGraph(spark, base).edges(), "defines").select("src", "dst")


@query("out_edges", f"WITH {_NODES}, {_CALLS} SELECT src, count(*) AS n FROM calls GROUP BY src")
def out_edges(spark, base):
    """Outgoing calls of every node."""
    return CodeGraph(spark, base).calls.groupBy("src").agg(F.count("*").alias("n"))


@query("in_edges", f"WITH {_NODES}, {_CALLS} SELECT dst, count(*) AS n FROM calls GROUP BY dst")
def in_edges(spark, base):
    """Incoming calls of every node."""
    return CodeGraph(spark, base).calls.groupBy("dst").agg(F.count("*").alias("n"))


@query("has_incoming", f"WITH {_NODES}, {_CALLS} SELECT id, label FROM nodes WHERE id IN (SELECT dst FROM calls)")
def has_incoming(spark, base):
    """Nodes that something calls."""
    g = CodeGraph(spark, base)
    return ops.having_incoming(g.symbols, g.calls.withColumn("type", F.lit("calls")), "calls").select("id", "label")


@query("entry_points", f"WITH {_NODES} SELECT id FROM nodes WHERE {_ENTRY}")
def entry_points(spark, base):
    """Where flows begin."""
    nodes = CodeGraph(spark, base).symbols
    return nodes.where(deadcode.is_entry(nodes)).select("id")


@query("graph_stats", f"WITH {_NODES}, {_CALLS}, {_PATHS} SELECT what, kind, count(*) AS n FROM (SELECT 'node' AS what, label AS kind FROM nodes UNION ALL SELECT 'node', label FROM structure UNION ALL SELECT 'edge', 'calls' FROM calls UNION ALL SELECT 'edge', 'contains' FROM contains) GROUP BY 1, 2")
def graph_stats(spark, base):
    """Nodes by label and edges by type."""
    g = CodeGraph(spark, base)
    contains = structure(table(spark, base, "files"))[1].withColumn("type", F.lit("contains"))
    return ops.counts(g.nodes(), g.calls.withColumn("type", F.lit("calls")).union(contains))


@query("symbol_count", f"WITH {_NODES} SELECT repo, count(*) AS symbols FROM nodes GROUP BY repo")
def symbol_count(spark, base):
    """Symbols by repository."""
    return ops.with_label(CodeGraph(spark, base).symbols, *SYMBOL_LABELS).groupBy("repo").agg(F.count("*").alias("symbols"))


@query("run_summary", f"WITH {_NODES}, {_CALLS}, {_PATHS}, {_PAIRS}, {_HERITAGE}, {_DEAD} SELECT (SELECT count(*) FROM paths) AS files, (SELECT count(*) FROM nodes) AS symbols, (SELECT count(*) FROM calls) AS calls, (SELECT count(*) FROM dead) AS dead, (SELECT count(*) FROM pairs) AS pairs")
def run_summary(spark, base):
    """What indexing found, in one row."""
    g = CodeGraph(spark, base)
    paths = table(spark, base, "files").where("repo is not null and rel_path is not null").select(F.concat_ws("/", "repo", "rel_path")).distinct()
    count = lambda df: df.agg(F.count("*")).scalar()
    pairs = coupling.co_changes(coupling.changes(table(spark, base, "commits")))
    dead = deadcode.dead_code(g.symbols, g.calls, heritage_edges(g.symbols))
    return paths.agg(F.count("*").alias("files")).withColumns({"symbols": count(g.symbols), "calls": count(g.calls), "dead": count(dead), "pairs": count(pairs)})


@query("substring_search", f"WITH {_NODES} SELECT id, name FROM nodes WHERE contains(lower(name), 'cache') OR contains(lower(file_path), 'cache') ORDER BY id LIMIT 20")
def substring_search(spark, base):
    """The first nodes whose name or path contains a text."""
    return ops.substring_search(CodeGraph(spark, base).symbols, "Cache", 20).select("id", "name")


@query("snippet", f"WITH {_NODES} SELECT id, {_bytes(200)} AS snippet FROM nodes")
def snippet(spark, base):
    """The first 200 bytes of each node's content."""
    return CodeGraph(spark, base).symbols.select("id", byte_prefix(F.col("content"), 200).alias("snippet"))


@query("node_text", f"WITH {_NODES} SELECT id, label || ' ' || name || CASE WHEN signature <> '' THEN ' ' || signature ELSE '' END || ' ' || file_path AS short, label || ' ' || name || '. in file ' || file_path || CASE WHEN signature <> '' THEN '. Signature: ' || signature ELSE '' END || CASE WHEN content <> '' THEN '. Code: ' || {_bytes(500)} ELSE '' END || CASE WHEN class_name <> '' THEN '. Method of class ' || class_name ELSE '' END AS long FROM nodes")
def node_text(spark, base):
    """The texts that stand for a node in searches."""
    c = F.col
    return CodeGraph(spark, base).symbols.select("id", short_text(c("label"), c("name"), c("signature"), c("file_path")).alias("short"), describe_node(c("label"), c("name"), c("file_path"), c("signature"), c("content"), c("class_name")).alias("long"))


# Neighbours, traversal, impact ---------------------------------------------------------------------


@query("callers", f"WITH {_NODES}, {_CALLS} SELECT c.dst AS of, n.id, n.name FROM calls c JOIN nodes n ON n.id = c.src")
def callers(spark, base):
    """Who calls each node."""
    g = CodeGraph(spark, base)
    return ops.neighbours(g.symbols, g.calls, g.symbols, "callers").select("of", "id", "name")


@query("callees", f"WITH {_NODES}, {_CALLS} SELECT c.src AS of, n.id, n.name FROM calls c JOIN nodes n ON n.id = c.dst")
def callees(spark, base):
    """Whom each node calls."""
    g = CodeGraph(spark, base)
    return ops.neighbours(g.symbols, g.calls, g.symbols, "callees").select("of", "id", "name")


_HUB = "hub AS (SELECT dst AS id FROM calls GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"
_UP = "up AS (WITH RECURSIVE walk(id, depth) AS (SELECT id, 0 FROM hub UNION SELECT c.src, w.depth + 1 FROM walk w JOIN calls c ON c.dst = w.id WHERE w.depth < 3) SELECT id, min(depth) AS depth FROM walk GROUP BY id HAVING min(depth) > 0)"


def _hub(g: CodeGraph) -> DataFrame:
    """The node that is called most."""
    return g.calls.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(1).select(F.col("dst").alias("id"))


@query("traverse_up", f"WITH {_NODES}, {_CALLS}, {_HUB}, {_UP} SELECT id, depth FROM up")
def traverse_up(spark, base):
    """What leads to the most called node, with depths."""
    g = CodeGraph(spark, base)
    return traversal.reach(g.calls, _hub(g), 3, "callers").select("id", "depth")


@query("traverse_down", f"WITH {_NODES}, {_CALLS}, top AS (SELECT src AS id FROM calls GROUP BY src ORDER BY count(*) DESC, src LIMIT 1), down AS (WITH RECURSIVE walk(id, depth) AS (SELECT id, 0 FROM top UNION SELECT c.dst, w.depth + 1 FROM walk w JOIN calls c ON c.src = w.id WHERE w.depth < 3) SELECT id, min(depth) AS depth FROM walk GROUP BY id HAVING min(depth) > 0) SELECT id, depth FROM down")
def traverse_down(spark, base):
    """What the node with the most calls reaches, with depths."""
    g = CodeGraph(spark, base)
    top = g.calls.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(1).select(F.col("src").alias("id"))
    return traversal.reach(g.calls, top, 3, "callees").select("id", "depth")


@query("impact_by_depth", f"WITH {_NODES}, {_CALLS}, {_HUB}, {_UP} SELECT CASE depth WHEN 1 THEN 'Direct' WHEN 2 THEN 'Indirect' ELSE 'Transitive' END AS level, count(*) AS n FROM up GROUP BY 1")
def impact_by_depth(spark, base):
    """How much a change of the most called node touches, by distance."""
    g = CodeGraph(spark, base)
    return traversal.reach(g.calls, _hub(g), 3, "callers").groupBy(traversal.depth_label(F.col("depth")).alias("level")).agg(F.count("*").alias("n"))


@query("impact", f"WITH {_NODES}, {_CALLS}, {_HUB}, {_UP} SELECT u.id, n.name, n.file_path, u.depth FROM up u JOIN nodes n USING (id)")
def impact(spark, base):
    """The nodes that a change of the most called one touches."""
    g = CodeGraph(spark, base)
    return traversal.reach(g.calls, _hub(g), 3, "callers").join(g.symbols, "id").select("id", "name", "file_path", "depth")


_ENTRIES = f"entries AS (SELECT id FROM nodes WHERE {_ENTRY})"
_FLOWS = "flow AS (WITH RECURSIVE walk(root, id, depth) AS (SELECT id, id, 0 FROM entries UNION SELECT w.root, c.dst, w.depth + 1 FROM walk w JOIN calls c ON c.src = w.id WHERE w.depth < 3) SELECT root, id, min(depth) AS depth FROM walk GROUP BY root, id), steps AS (SELECT root, row_number() OVER (PARTITION BY root ORDER BY depth, id) - 1 AS step, id FROM flow)"


@query("process_steps", f"WITH {_NODES}, {_CALLS}, {_ENTRIES}, {_FLOWS} SELECT root, step, id FROM steps")
def process_steps(spark, base):
    """The flow of each entry point, up to depth 3, step by step."""
    g = CodeGraph(spark, base)
    return traversal.flows(g.calls, entry_points(spark, base), 3)


@query("process_flows", f"WITH {_NODES}, {_CALLS}, {_ENTRIES}, {_FLOWS} SELECT root, count(*) AS length FROM steps GROUP BY root")
def process_flows(spark, base):
    """The length of each entry point's flow."""
    return process_steps(spark, base).groupBy("root").agg(F.count("*").alias("length"))


@query("processes", f"WITH {_NODES}, {_CALLS}, {_ENTRIES}, {_FLOWS}, p AS (SELECT root, string_agg(id, '->' ORDER BY step) AS path, count(*) AS length FROM steps GROUP BY root), kept AS (SELECT path, min(root) AS root, any_value(length) AS length FROM p GROUP BY path) SELECT k.root, 'Flow from ' || n.name AS label, k.length FROM kept k JOIN nodes n ON n.id = k.root")
def processes(spark, base):
    """Flows without those of equal paths, named after their entry."""
    kept = traversal.distinct_flows(process_steps(spark, base))
    return kept.join(CodeGraph(spark, base).symbols, F.col("root") == F.col("id")).select("root", F.concat(F.lit("Flow from "), F.col("name")).alias("label"), "length")


@query("changed_symbols", f"WITH {_NODES}, {_CHANGES} SELECT DISTINCT n.id FROM nodes n JOIN changes c ON n.file_path = c.repo || '/' || c.file")
def changed_symbols(spark, base):
    """Symbols in files that a commit changed."""
    return _changed(spark, base).select("id")


def _changed(spark, base) -> DataFrame:
    files = coupling.changes(table(spark, base, "commits")).select(F.concat_ws("/", "repo", "file").alias("file_path")).distinct()
    return ops.with_label(CodeGraph(spark, base).symbols, *SYMBOL_LABELS).join(files, "file_path", "left_semi")


@query("change_impact", f"WITH {_NODES}, {_CALLS}, {_CHANGES}, hit AS (SELECT DISTINCT n.id FROM nodes n JOIN changes c ON n.file_path = c.repo || '/' || c.file) SELECT DISTINCT c.src AS id FROM calls c WHERE c.dst IN (SELECT id FROM hit)")
def change_impact(spark, base):
    """Symbols that call a changed one."""
    g = CodeGraph(spark, base)
    return ops.neighbours(g.symbols, g.calls, _changed(spark, base), "callers").select("id").distinct()


@query("resolve_symbol", f"WITH {_NODES} SELECT id, name FROM nodes WHERE contains(lower(name), 'cache') ORDER BY (name = 'cache') DESC, id LIMIT 1")
def resolve_symbol(spark, base):
    """The node that a name means."""
    return ops.best_name(CodeGraph(spark, base).symbols, "cache").select("id", "name")


@query("symbol_context", f"WITH {_NODES}, {_CALLS}, {_HUB} SELECT 'caller' AS direction, src AS id FROM calls WHERE dst IN (SELECT id FROM hub) UNION ALL SELECT 'callee', dst FROM calls WHERE src IN (SELECT id FROM hub)")
def symbol_context(spark, base):
    """Callers and callees of the most called node."""
    g = CodeGraph(spark, base)
    hub = _hub(g)
    side = lambda name, direction: ops.neighbours(g.symbols, g.calls, hub, direction).select(F.lit(name).alias("direction"), "id")
    return side("caller", "callers").union(side("callee", "callees"))


@query("remove_files", f"WITH {_NODES}, {_CALLS}, gone AS (SELECT id FROM nodes WHERE file_path LIKE '%.go') SELECT src, dst FROM calls WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)")
def remove_files(spark, base):
    """Calls that remain when all Go files are removed with their nodes."""
    g = CodeGraph(spark, base)
    files = g.symbols.where(F.col("file_path").endswith(".go")).select("file_path")
    return ops.remove_files(g.symbols, g.calls, files)[1].select("src", "dst")


@query("upsert_nodes", f"WITH {_NODES}, fresh AS (SELECT id, upper(name) AS name FROM nodes WHERE label = 'class') SELECT id, name FROM fresh UNION ALL SELECT id, name FROM nodes WHERE id NOT IN (SELECT id FROM fresh)")
def upsert_nodes(spark, base):
    """Nodes after an update of all classes."""
    nodes = CodeGraph(spark, base).symbols.select("id", "label", "name")
    fresh = nodes.where("label = 'class'").withColumn("name", F.upper("name"))
    return ops.upsert(nodes, fresh).select("id", "name")


@query("node_json", f"WITH {_NODES} SELECT id, label, name, start_line, is_exported, name AS property FROM nodes")
def node_json(spark, base):
    """Nodes that went through JSON texts and back, and a property taken from the text."""
    texts = ops.encoded(CodeGraph(spark, base).symbols.select("id", "label", "name", "start_line", "is_exported"))
    named = texts.select("id", ops.property_text(F.col("json"), "name").alias("property"))
    return ops.decoded(texts, "id string, label string, name string, start_line int, is_exported boolean").join(named, "id")


@query("vector_store", "WITH v AS (SELECT DISTINCT node_id, computed_at, len(embedding) AS size FROM node_vectors WHERE node_id IS NOT NULL), late AS (SELECT node_id, computed_at + INTERVAL 1 DAY AS computed_at, 0 AS size FROM v WHERE node_id LIKE 'class:%') SELECT DISTINCT node_id, computed_at FROM late UNION ALL SELECT node_id, max(computed_at) FROM v WHERE node_id NOT IN (SELECT node_id FROM late) GROUP BY 1")
def vector_store(spark, base):
    """The stored vectors' times after those of all classes were computed again a day later."""
    rows = table(spark, base, "node_vectors").where("node_id is not null").select("node_id", "computed_at")
    old = rows.groupBy("node_id").agg(F.max("computed_at").alias("computed_at"))
    fresh = rows.where("node_id like 'class:%'").groupBy("node_id").agg((F.max("computed_at") + F.expr("INTERVAL 1 DAY")).alias("computed_at"))
    return ops.upsert(old, fresh, "node_id")


@query("remove_node", f"WITH {_NODES}, {_CALLS}, hub AS (SELECT dst AS id FROM calls GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1) SELECT src, dst FROM calls WHERE src NOT IN (SELECT id FROM hub) AND dst NOT IN (SELECT id FROM hub)")
def remove_node(spark, base):
    """Calls that remain when the most called node is removed."""
    g = CodeGraph(spark, base)
    return ops.remove_nodes(g.symbols, g.calls, _hub(g))[1].select("src", "dst")


# Dead code ----------------------------------------------------------------------------------------


@query("dead_flag", f"WITH {_NODES}, {_CALLS} SELECT id FROM nodes WHERE id NOT IN (SELECT dst FROM calls)")
def dead_flag(spark, base):
    """Symbols that nothing calls."""
    g = CodeGraph(spark, base)
    return deadcode.uncalled(g.symbols, g.calls).select("id")


@query("dead_exempt", f"WITH {_NODES} SELECT id FROM nodes WHERE {_EXEMPT}")
def dead_exempt(spark, base):
    """Symbols that are never called dead."""
    nodes = CodeGraph(spark, base).symbols
    return nodes.where(deadcode.is_exempt(nodes)).select("id")


@query("dead_allowlist", f"WITH {_NODES} SELECT id FROM nodes WHERE (contains(file_path, 'server.go') AND starts_with(name, 'handle')) OR (contains(file_path, 'cmd.go') AND regexp_matches(name, '^(setup|configure|output)')) OR starts_with(name, 'register')")
def dead_allowlist(spark, base):
    """Symbols that frameworks call by name."""
    return CodeGraph(spark, base).symbols.where(deadcode.is_allowed(F.col("name"), F.col("file_path"), F.lit(None).cast("string"))).select("id")


@query("call_patterns", f"WITH {_NODES}, {_CALLS}, {_PATTERNS} SELECT id, call_pattern FROM patterns")
def call_patterns(spark, base):
    """How callees are called."""
    g = CodeGraph(spark, base)
    return deadcode.call_patterns(g.symbols, g.calls)


@query("intra_class", f"WITH {_NODES}, {_CALLS} SELECT * FROM (SELECT c.src, c.dst, CASE WHEN s.file_path = d.file_path THEN 'intra_file' WHEN s.label = 'method' AND d.label = 'method' AND s.class_name <> '' AND s.class_name = d.class_name THEN 'intra_class' END AS within FROM calls c JOIN nodes s ON s.id = c.src JOIN nodes d ON d.id = c.dst) WHERE within IS NOT NULL")
def intra_class(spark, base):
    """Calls within a file, or between the methods of a class."""
    g = CodeGraph(spark, base)
    return deadcode.inner_calls(g.symbols, g.calls)


@query("dead_code", f"WITH {_NODES}, {_CALLS}, {_HERITAGE}, {_DEAD} SELECT id, label, name, file_path, confidence FROM dead")
def dead_list(spark, base):
    """Dead symbols with confidence."""
    g = CodeGraph(spark, base)
    return deadcode.dead_code(g.symbols, g.calls, heritage_edges(g.symbols))


@query("dead_confidence", f"WITH {_NODES}, {_CALLS}, {_HERITAGE}, {_DEAD} SELECT confidence, count(*) AS n FROM dead GROUP BY 1")
def dead_confidence(spark, base):
    """Dead symbols by confidence."""
    return dead_list(spark, base).groupBy("confidence").agg(F.count("*").alias("n"))


@query("dead_by_file", f"WITH {_NODES}, {_CALLS}, {_HERITAGE}, {_DEAD} SELECT file_path, count(*) AS n FROM dead GROUP BY 1")
def dead_by_file(spark, base):
    """Dead symbols by file."""
    return dead_list(spark, base).groupBy("file_path").agg(F.count("*").alias("n"))


@query("override_pass", f"WITH {_NODES}, {_CALLS}, {_HERITAGE}, {_DEAD} SELECT id FROM overriding")
def override_pass(spark, base):
    """Methods that live because they override a living one."""
    g = CodeGraph(spark, base)
    parents = heritage_edges(g.symbols)
    patterns = deadcode.call_patterns(g.symbols, g.calls)
    marked = deadcode.uncalled(g.symbols, g.calls).join(patterns, "id", "left")
    dead = marked.where(~deadcode.is_exempt(marked) & ~deadcode.is_allowed(F.col("name"), F.col("file_path"), F.col("call_pattern")))
    return deadcode.overriding(dead, g.symbols, parents, g.symbols.join(dead.select("id"), "id", "left_anti"))


# Coupling -----------------------------------------------------------------------------------------


@query("file_totals", f"WITH {_CHANGES} SELECT repo, file, count(*) AS total FROM changes GROUP BY 1, 2")
def file_totals(spark, base):
    """Commits by file."""
    return coupling.file_totals(coupling.changes(table(spark, base, "commits")))


@query("co_change", f"WITH {_PAIRS} SELECT repo, file_a, file_b, co_changes FROM pairs")
def co_change(spark, base):
    """Pairs of files that commits change together."""
    return coupling.co_changes(coupling.changes(table(spark, base, "commits")))


@query("coupling", f"WITH {_PAIRS}, totals AS (SELECT repo, file, count(*) AS total FROM changes GROUP BY 1, 2) SELECT * FROM (SELECT p.repo, p.file_a, p.file_b, p.co_changes, round(p.co_changes / greatest(a.total, b.total), 6) AS strength FROM pairs p JOIN totals a ON a.repo = p.repo AND a.file = p.file_a JOIN totals b ON b.repo = p.repo AND b.file = p.file_b WHERE p.co_changes >= 3) WHERE strength >= 0.3")
def coupled(spark, base):
    """Files that mostly change together."""
    return coupling.coupling(coupling.changes(table(spark, base, "commits")))


# Search -------------------------------------------------------------------------------------------


@query("postings", f"WITH {_NODES}, {_NODE_POSTINGS} SELECT token, id, tf FROM postings")
def postings(spark, base):
    """The inverted index of symbols: name, whole content, signature."""
    c = F.col
    return search.postings(CodeGraph(spark, base).symbols, "id", c("name"), c("content"), c("signature"))


@query("index_size", f"WITH {_DOC_POSTINGS} SELECT count(DISTINCT token) AS tokens, count(*) AS postings, sum(tf)::BIGINT AS words FROM postings")
def index_size(spark, base):
    """The size of the documents' inverted index."""
    index = search.postings(table(spark, base, "documents"), "doc_id", F.col("text"))
    return index.agg(F.countDistinct("token").alias("tokens"), F.count("*").alias("postings"), F.sum("tf").alias("words"))


@query("fts_topk", f"WITH {_DOC_POSTINGS} SELECT doc_id, sum(tf * n)::BIGINT AS score FROM postings JOIN {_TIMES} USING (token) GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20")
def fts_topk(spark, base):
    """Documents with the most query terms."""
    return search.term_search(table(spark, base, "documents"), "doc_id", F.col("text"), list(_QUERY_TERMS), 20)


@query("fts_bm25", f"WITH {_DOC_POSTINGS}, lengths AS (SELECT doc_id, sum(tf) AS length FROM postings GROUP BY 1), stats AS (SELECT count(*) AS n, avg(length) AS mean FROM lengths), df AS (SELECT token, count(*) AS df FROM postings WHERE token IN ('cache', 'graph', 'merge') GROUP BY 1) SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score FROM postings JOIN df USING (token) JOIN lengths USING (doc_id), stats GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20")
def fts_bm25(spark, base):
    """Documents by BM25."""
    return search.bm25(table(spark, base, "documents"), "doc_id", F.col("text"), list(dict.fromkeys(_QUERY_TERMS)), 20)


@query("fts_code_tokens", f"WITH {_NODES}, split AS (SELECT id, name, regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g') AS camel FROM nodes), digits AS (SELECT *, regexp_replace(regexp_replace(camel, '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g') AS digit, regexp_replace(regexp_replace(name, '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g') AS plain FROM split) SELECT DISTINCT id, token FROM (SELECT id, lower(name) AS token FROM digits UNION ALL SELECT id, unnest(regexp_split_to_array(lower(name), '[_.\\-\\s]+') || regexp_split_to_array(lower(camel), '[_.\\-\\s]+') || regexp_split_to_array(lower(digit), '[_.\\-\\s]+') || regexp_split_to_array(lower(plain), '[_.\\-\\s]+')) FROM digits) WHERE token <> ''")
def fts_code_tokens(spark, base):
    """The parts of every symbol's name."""
    return CodeGraph(spark, base).symbols.select("id", F.explode(code_tokens(F.col("name"))).alias("token"))


_VALID = "valid AS (SELECT DISTINCT node_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM node_vectors WHERE len(embedding) = 100 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x) OR x IS NULL)) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)))"
_NEAR = _VALID + ", q AS (SELECT v FROM valid ORDER BY node_id LIMIT 1), near AS (SELECT node_id, round(list_cosine_similarity(valid.v, q.v), 6) AS similarity FROM valid, q)"


def _vectors(spark, base) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    return table(spark, base, "node_vectors").where((F.size("embedding") == 100) & ~bad & F.exists("embedding", lambda x: x != 0)).select("node_id", "embedding").distinct()


@query("vector_topk", f"WITH {_NEAR} SELECT node_id, similarity FROM near WHERE similarity > 0 ORDER BY similarity DESC, node_id LIMIT 10")
def vector_topk(spark, base):
    """The vectors nearest to one, compared with all."""
    vectors = _vectors(spark, base)
    return search.nearest(vectors, "node_id", "embedding", vectors.orderBy("node_id").limit(1).select(F.col("embedding").alias("q")), 10)


@query("tfidf_vocab", f"WITH {_TFIDF} SELECT term, idx FROM vocab")
def tfidf_vocab(spark, base):
    """The vocabulary of the documents."""
    return search.vocabulary(table(spark, base, "documents"), "doc_id", F.col("text"))


@query("tfidf_idf", f"WITH {_TFIDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def tfidf_idf(spark, base):
    """Document frequencies of all terms."""
    return search.frequencies(table(spark, base, "documents"), "doc_id", F.col("text")).select("term", "df", F.round("idf", 6).alias("idf"))


@query("tfidf", f"WITH {_SPARSE} SELECT doc_id, term, round(weight, 6) AS weight FROM sparse")
def tfidf(spark, base):
    """TF-IDF vectors of the documents over all terms, their non-zero parts."""
    return search.tfidf(table(spark, base, "documents"), "doc_id", F.col("text")).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query("tfidf_100", f"WITH {_TFIDF} SELECT doc_id, idx, round(weight, 6) AS weight FROM tfidf")
def tfidf_100(spark, base):
    """TF-IDF vectors of the documents over the first 100 terms."""
    return search.tfidf(table(spark, base, "documents"), "doc_id", F.col("text"), search.VOCABULARY).select("doc_id", "idx", F.round("weight", 6).alias("weight"))


@query("tfidf_nodes", f"WITH {_NODES}, {_SPARSE_NODES} SELECT id, term, round(weight, 6) AS weight FROM sparse")
def tfidf_nodes(spark, base):
    """TF-IDF vectors of the symbols' texts over all terms."""
    c = F.col
    texts = CodeGraph(spark, base).symbols.select("id", describe_node(c("label"), c("name"), c("file_path"), c("signature"), c("content"), c("class_name")).alias("text"))
    return search.tfidf(texts, "id", F.col("text")).select("id", "term", F.round("weight", 6).alias("weight"))


@query("hybrid_rrf", f"WITH {_DOC_POSTINGS}, {_SPARSE}, f AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM (SELECT doc_id, sum(tf * n)::BIGINT AS score FROM postings JOIN {_TIMES} USING (token) GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 40)), q AS (SELECT term, weight FROM sparse WHERE doc_id = (SELECT min(doc_id) FROM f WHERE rank = 0)), v AS (SELECT doc_id, row_number() OVER (ORDER BY sim DESC, doc_id) - 1 AS rank FROM (SELECT doc_id, round(sum(t.weight * q.weight), 6) AS sim FROM sparse t JOIN q USING (term) GROUP BY 1 ORDER BY sim DESC, doc_id LIMIT 40)) SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM f UNION ALL SELECT * FROM v) GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20")
def hybrid_rrf(spark, base):
    """Term and vector search of documents, fused: the vector is that of the best term hit."""
    docs = table(spark, base, "documents")
    terms = stored(search.ranked(search.term_search(docs, "doc_id", F.col("text"), list(_QUERY_TERMS), 40), "doc_id", "score"))
    vectors = stored(search.tfidf(docs, "doc_id", F.col("text")))
    asked = vectors.join(F.broadcast(terms.where("rank = 0").select("doc_id")), "doc_id").select("term", F.col("weight").alias("q"))  # the terms of one document
    near = vectors.join(asked, "term").groupBy("doc_id").agg(F.round(F.sum(F.col("weight") * F.col("q")), 6).alias("sim")).orderBy(F.desc("sim"), "doc_id").limit(40)
    return search.fuse(terms, search.ranked(near, "doc_id", "sim"), "doc_id", 20)


_WORD_TOKENS = _CODE_TOKENS.format("word")
_CODE_INDEX = f"words AS (SELECT id, unnest(regexp_split_to_array(name || ' ' || signature, '[^A-Za-z0-9_.\\-]+')) AS word FROM nodes), code AS (SELECT token, id, count(*) AS n FROM (SELECT id, unnest({_WORD_TOKENS}) AS token FROM words WHERE word <> '') GROUP BY 1, 2)"
_CODE_QUERY = f"wanted AS (SELECT DISTINCT unnest({_WORD_TOKENS}) AS token FROM (VALUES ('getCache'), ('merge_graph')) q(word)), hits AS (SELECT id, count(*) AS score FROM code JOIN wanted USING (token) GROUP BY 1 ORDER BY score DESC, id LIMIT 20)"


def _code_index(spark, base) -> DataFrame:
    return search.code_index(CodeGraph(spark, base).symbols, "name", "signature")


@query("code_search", f"WITH {_NODES}, {_CODE_INDEX}, {_CODE_QUERY} SELECT h.id, h.score, n.label, n.name, n.file_path FROM hits h JOIN nodes n USING (id)")
def code_search(spark, base):
    """Symbols with the most code tokens of a query, with their details."""
    return search.details(search.code_search(_code_index(spark, base), "getCache merge_graph", 20), CodeGraph(spark, base).symbols)


@query("code_update", f"WITH {_NODES}, {_CODE_INDEX}, fresh AS (SELECT id, unnest({_CODE_TOKENS.format("'Renamed' || name")}) AS token FROM nodes WHERE label = 'class') SELECT token, id, n FROM code WHERE id NOT IN (SELECT id FROM fresh) UNION ALL SELECT token, id, count(*) FROM fresh GROUP BY 1, 2")
def code_update(spark, base):
    """The index of code tokens after all classes were indexed anew under other names."""
    fresh = CodeGraph(spark, base).symbols.where("label = 'class'").withColumn("name", F.concat(F.lit("Renamed"), "name"))
    return search.with_nodes(_code_index(spark, base), fresh, "name")


@query("code_remove", f"WITH {_NODES}, {_CODE_INDEX} SELECT token, id, n FROM code WHERE id IN (SELECT id FROM nodes WHERE file_path NOT LIKE '%.go')")
def code_remove(spark, base):
    """The index of code tokens without the symbols of Go files."""
    return search.without_nodes(_code_index(spark, base), CodeGraph(spark, base).symbols.where(F.col("file_path").endswith(".go")))


@query("code_resolve", f"WITH {_NODES}, {_CODE_INDEX}, wanted AS (SELECT DISTINCT unnest({_WORD_TOKENS}) AS token FROM (VALUES ('getCache')) q(word)), hits AS (SELECT id, count(*) AS score FROM code JOIN wanted USING (token) GROUP BY 1 ORDER BY score DESC, id LIMIT 10) SELECT h.id, h.score, n.name FROM hits h JOIN nodes n USING (id) ORDER BY n.name = 'getCache' DESC, h.score DESC, h.id LIMIT 1")
def code_resolve(spark, base):
    """The symbol that a name means, by the search of code tokens."""
    return search.resolve_name(_code_index(spark, base), CodeGraph(spark, base).symbols, "getCache").select("id", "score", "name")


# Communities --------------------------------------------------------------------------------------

_ADJ = "adj AS (SELECT i, j, count(*) AS w FROM (SELECT src AS i, dst AS j FROM calls UNION ALL SELECT dst, src FROM calls) GROUP BY 1, 2)"


@query("adjacency", f"WITH {_NODES}, {_CALLS}, {_ADJ} SELECT i, j, w FROM adj")
def adjacency(spark, base):
    """Weights between nodes that call each other."""
    return community.adjacency(CodeGraph(spark, base).calls)


@query("degrees", f"WITH {_NODES}, {_CALLS}, {_ADJ} SELECT i AS id, sum(w)::BIGINT AS degree FROM adj GROUP BY 1")
def degrees(spark, base):
    """Weighted degrees."""
    return community.degrees(adjacency(spark, base))


@query("modularity", f"WITH {_NODES}, {_CALLS}, {_ADJ}, lab AS (SELECT id, file_path AS c FROM nodes), d AS (SELECT c, sum(w) AS d FROM adj JOIN lab ON lab.id = adj.i GROUP BY 1), t AS (SELECT sum(d)::DOUBLE AS total, sum(d::DOUBLE * d) AS squares FROM d) SELECT round((SELECT coalesce(sum(w), 0) FROM adj JOIN lab a ON a.id = i JOIN lab b ON b.id = j WHERE a.c = b.c) / total - squares / (total * total), 6) AS modularity FROM t")
def modularity(spark, base):
    """The modularity of the partition into files."""
    g = CodeGraph(spark, base)
    return community.modularity(community.adjacency(g.calls), g.symbols.select("id", F.col("file_path").alias("community")))


@query("communities")
def communities(spark, base):
    """Communities of the call graph."""
    degree, _, labels = community.settle_edges(CodeGraph(spark, base).calls)
    return community.named(degree, labels)


@query("community_labels")
def community_labels(spark, base):
    """The size, members and name of every community; symbols that neither call nor are called are one each."""
    labels = communities(spark, base)  # first, so that names come from the nodes of its calls
    return community.describe(labels, CodeGraph(spark, base).names().where(F.col("label").isin("function", "method", "class", "interface")))


@query("community_numbers")
def community_numbers(spark, base):
    """Communities numbered in the order of their least members."""
    return community.numbered(communities(spark, base))


@query("community_quality", f"WITH {_NODES}, {_CALLS} SELECT count(DISTINCT id) AS nodes, true AS good FROM (SELECT src AS id FROM calls UNION SELECT dst FROM calls)")
def community_quality(spark, base):
    """How many nodes have a community, and whether the partition's modularity is at least 0.6 (of 100 nodes or more)."""
    _, adjacent, labels = community.settle_edges(CodeGraph(spark, base).calls)
    worth = community.modularity(adjacent, labels.withColumnRenamed("node", "id"))
    return labels.agg(F.countDistinct("node").alias("nodes")).withColumn("good", (F.col("nodes") < 100) | worth.select(F.col("modularity") >= 0.6).scalar())


@query("components", f"WITH {_NODES}, {_CALLS}, {_ADJ}, reached AS (WITH RECURSIVE walk(id, root) AS (SELECT i, i FROM adj UNION SELECT a.j, w.root FROM walk w JOIN adj a ON a.i = w.id) SELECT id, min(root) AS component FROM walk GROUP BY id) SELECT id, component FROM reached")
def connected(spark, base):
    """Connected components of the call graph."""
    return community.components(adjacency(spark, base))


# Change stream ------------------------------------------------------------------------------------


@query("quiet_batches", "WITH e AS (SELECT DISTINCT repo, ingested_at AS t, file FROM commits WHERE ingested_at IS NOT NULL AND repo IS NOT NULL AND file IS NOT NULL), g AS (SELECT *, CASE WHEN t <= lag(t) OVER (PARTITION BY repo ORDER BY t, file) + INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM e), s AS (SELECT *, sum(fresh) OVER (PARTITION BY repo ORDER BY t, file ROWS UNBOUNDED PRECEDING) AS batch FROM g) SELECT repo, epoch_us(min(t)) AS start_us, epoch_us(max(t) + INTERVAL 1 DAY) AS end_us, count(*) AS changes, count(DISTINCT file) AS paths FROM s GROUP BY repo, batch")
def quiet_batches(spark, base):
    """Changes of a repository until a day of silence."""
    events = table(spark, base, "commits").where("ingested_at is not null and repo is not null and file is not null").select("repo", "ingested_at", "file").distinct()
    b = stream.quiet_batches(events, "ingested_at", "file", "1 day", "repo")
    return b.select("repo", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "changes", "paths")


@query("snapshot_changes", "WITH s AS (SELECT DISTINCT repo, rel_path, scanned_at, file_id, sha256(content) AS h FROM files WHERE repo IS NOT NULL AND rel_path IS NOT NULL), cut AS (SELECT max(scanned_at) - INTERVAL 30 DAY AS t FROM s), ranked AS (SELECT *, row_number() OVER (PARTITION BY repo, rel_path ORDER BY scanned_at DESC NULLS LAST, file_id DESC) AS n FROM s), old AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY repo, rel_path ORDER BY scanned_at DESC, file_id DESC) AS n FROM s, cut WHERE scanned_at <= t) WHERE n = 1) SELECT r.repo, r.rel_path, CASE WHEN o.rel_path IS NULL THEN 'added' ELSE 'modified' END AS change FROM ranked r LEFT JOIN old o ON o.repo = r.repo AND o.rel_path = r.rel_path WHERE r.n = 1 AND (o.rel_path IS NULL OR o.h IS DISTINCT FROM r.h)")
def snapshot_changes(spark, base):
    """What the scans of the last 30 days added or modified."""
    rows = table(spark, base, "files").where("repo is not null and rel_path is not null").select("repo", "rel_path", "scanned_at", "file_id", F.sha2("content", 256).alias("sha256")).distinct()
    cut = rows.agg(F.max("scanned_at") - F.expr("INTERVAL 30 DAYS"))
    snapshot = lambda df: df.groupBy("repo", "rel_path").agg(F.max_by("sha256", F.struct("scanned_at", "file_id")).alias("sha256")).select(F.struct("repo", "rel_path").alias("at"), "sha256")
    old = rows.where(F.col("scanned_at") <= cut.scalar())
    return stream.route(snapshot(old), snapshot(rows), "at").select("at.repo", "at.rel_path", "change")


@query("stream_sessions")
def stream_sessions(spark, base):
    """The batches of ``quiet_batches`` as a stream gives them: those closed when the input ends."""
    folder = shared_folder(spark)
    out = f"{folder}/stream-{abs(hash((base, spark.sparkContext.applicationId)))}"
    schema = table(spark, base, "commits").schema
    events = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/commits.parque[t]").where("ingested_at is not null and repo is not null and file is not null").select("repo", "ingested_at", "file")
    batches = stream.quiet_batches(events, "ingested_at", "file", "1 day", "repo", late="1 day")
    run = batches.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(batches.schema).parquet(f"{out}/rows")

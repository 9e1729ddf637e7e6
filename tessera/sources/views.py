"""The driver's tables as relations: projections of each, and a code graph with the 16 base relations.

CODE is portable between Spark SQL and DuckDB; the oracles start from it. Every row of lineitem is a reference: those
of four in forty orders may lie in any file, the others lie in the file of the part that they refer to."""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from tessera import schema
from tessera.engine import Engine, Limits
from tessera.plans.tables import counted

CODE = """
cnt AS (SELECT (SELECT count(*) FROM supplier) AS ns, (SELECT count(*) FROM part) AS np),
file AS (SELECT s_suppkey AS k, concat(CASE s_suppkey % 7 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/ui/' WHEN 2 THEN 'src/db/' ELSE 'src/core/' END, 'f', CAST(s_suppkey AS STRING), '.rs') AS f, CASE s_suppkey % 4 WHEN 0 THEN 'rust' WHEN 1 THEN 'go' WHEN 2 THEN 'python' ELSE 'typescript' END AS lang FROM supplier),
pt AS (SELECT p_partkey AS p, concat('sym ', CAST(p_partkey AS STRING)) AS s, f, CAST(floor(p_partkey / ns) AS BIGINT) AS slot, p_size, p_type,
  CASE p_size % 6 WHEN 0 THEN 'module' WHEN 1 THEN 'struct' WHEN 2 THEN 'trait' WHEN 3 THEN 'method' ELSE 'function' END AS kind,
  CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE concat('fn_', CAST(p_partkey AS STRING)) END AS name, ns, np
  FROM part CROSS JOIN cnt JOIN file ON file.k = p_partkey % ns),
def AS (SELECT s, f, kind, name FROM pt),
def_span AS (SELECT s, 1 + 10 * slot AS l1, 6 + 10 * slot + 10 * (p_size % 3) AS l2, 40 * slot AS b1, 40 * slot + 200 AS b2 FROM pt),
parent AS (SELECT s AS child, CASE WHEN slot > 0 AND p_size % 2 = 0 THEN concat('sym ', CAST(p - ns AS STRING)) ELSE f END AS parent FROM pt),
visibility AS (SELECT s, CASE p % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'restricted' ELSE 'inherited' END AS vis FROM pt),
resolved AS (SELECT s FROM pt WHERE p % 5 <> 0),
def_doc AS (SELECT s, p_type AS doc FROM pt WHERE p % 4 = 0),
occ AS (SELECT l_orderkey % 40 AS b, l_orderkey % 80 AS c, l_partkey AS p, CASE WHEN l_orderkey % 40 < 4 THEN file.f ELSE home.f END AS f, CAST(10 * l_linenumber AS BIGINT) AS line, l_orderkey % 97 AS col, CASE WHEN l_orderkey % 40 >= 4 AND l_partkey % 10 <> 5 THEN home.f WHEN l_orderkey % 40 >= 4 THEN concat('sym ', CAST(l_partkey AS STRING)) ELSE concat('sym ', CAST(CASE WHEN l_partkey % 50 = 7 THEN l_partkey WHEN l_partkey % 50 = 11 THEN l_partkey + 1 WHEN l_partkey % 50 = 12 THEN l_partkey - 1 WHEN l_partkey % 10 IN (3, 4, 6) THEN l_partkey - 1 ELSE (l_partkey * 31 + l_linenumber * 7) % np END AS STRING)) END AS fr, l_returnflag AS flag FROM lineitem CROSS JOIN cnt JOIN file ON file.k = l_suppkey JOIN file home ON home.k = l_partkey % ns),
scip_ref AS (SELECT DISTINCT concat('sym ', CAST(p AS STRING)) AS s, f, line, col, fr, CASE WHEN line = 70 AND p % 29 = 1 THEN 'test' WHEN flag = 'A' THEN 'read' WHEN flag = 'N' THEN 'unknown' ELSE 'write' END AS role FROM occ WHERE (b = 0 OR b >= 4 AND b % 2 = 0) AND p % 5 <> 0 UNION SELECT concat('ext ', CAST(p % 20 AS STRING)), f, line, col, fr, 'read' FROM occ WHERE b = 2),
name_ref AS (SELECT DISTINCT pt.name, occ.f, line, col, fr FROM occ JOIN pt ON pt.p = occ.p WHERE b = 1 OR c = 0 OR b >= 4 AND b % 2 = 1),
extern AS (SELECT DISTINCT concat('ext ', CAST(o_custkey % 20 AS STRING)) AS s, 'cargo' AS manager, concat('pkg', CAST(o_custkey % 5 AS STRING)) AS package, '1.0' AS version FROM orders),
import AS (SELECT DISTINCT f, concat(CASE p % 3 WHEN 0 THEN 'db::' WHEN 1 THEN 'ui::' ELSE 'std::' END, 'm', CAST(p % 30 AS STRING)) AS module, CASE WHEN p % 10 = 0 THEN 'al' ELSE '' END AS alias FROM occ WHERE b = 3 OR b >= 4 AND b % 4 = 3),
name_impl AS (SELECT DISTINCT a.f, a.name AS type, t.name AS trait, 5 + 10 * a.slot AS line FROM pt a JOIN pt t ON t.p = (a.p * 13) % a.np WHERE a.kind = 'struct' AND t.kind IN ('trait', 'struct')),
scip_impl AS (SELECT DISTINCT a.s, t.s AS t FROM pt a JOIN pt t ON t.p = (a.p * 17) % a.np WHERE a.kind = 'struct' AND t.kind = 'trait' AND a.p % 2 = 0),
name_export AS (SELECT DISTINCT f, name FROM pt WHERE p % 11 = 0),
def_name AS (SELECT s, 10 + 10 * (slot % 7) AS line, p % 97 AS col FROM pt),
def_sig AS (SELECT s, concat(kind, ' ', name) AS sig FROM pt)
"""

#: Integer and string columns of the tables.
TABLES = {
    "nation": ("nation", "SELECT n_nationkey AS n, n_name AS name, n_regionkey AS r FROM nation"),
    "region": ("region", "SELECT r_regionkey AS r, r_name AS name FROM region"),
    "customer": ("customer", "SELECT c_custkey AS c, c_nationkey AS n, c_mktsegment AS seg FROM customer"),
    "supplier": ("supplier", "SELECT s_suppkey AS s, s_nationkey AS n FROM supplier"),
    "orders": ("orders", "SELECT o_orderkey AS o, o_custkey AS c, o_orderstatus AS status, o_orderpriority AS prio FROM orders"),
    "li": ("lineitem", "SELECT l_orderkey AS o, l_linenumber AS ln, l_partkey AS p, l_suppkey AS s, l_returnflag AS flag, l_linestatus AS status FROM lineitem"),
    "part": ("part", "SELECT p_partkey AS p, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size FROM part"),
    "event": ("events", "SELECT event_id AS e, user_id AS u, event_type AS t FROM events"),
    "doc": ("documents", "SELECT doc_id AS d, lang, source AS src FROM documents"),
    "label": ("labels", "SELECT doc_id AS d, quality AS q, toxic AS tox FROM labels"),
    "turn": ("conversations", "SELECT conv_id AS c, turn AS t, role FROM conversations"),
    # a cyclic graph over all parts: blocks of eight with cycles, loops and nodes on none, so that the closure stays linear
    "edge": ("part", "SELECT p_partkey AS a, p_partkey - p_partkey % 8 + (CASE p_partkey % 8 WHEN 7 THEN 7 WHEN 6 THEN 1 ELSE p_partkey % 8 + 1 END) AS b FROM part UNION SELECT p_partkey, p_partkey - p_partkey % 8 + (p_partkey % 8 * 5 + 1) % 8 FROM part WHERE p_partkey % 3 = 0"),
    # a tree: each part under the one of half its key
    "up": ("part", "SELECT p_partkey AS c, CAST(floor(p_partkey / 2) AS BIGINT) AS p FROM part WHERE p_partkey > 0"),
}
#: Derived, all relations and no cap: the driver wants whole results.
LIMITS = Limits(rows=None, bytes=None, derived=None, milliseconds=None)


def register(spark: SparkSession, sf_dir: str) -> None:
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    """An engine over the named projections; all if none is named."""
    e = Engine(spark, LIMITS)
    for n in names or TABLES:
        table, sql = TABLES[n]
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        e.insert_relation(n, spark.sql(sql), trusted=True)
    return e


def relation(spark: SparkSession, name: str) -> DataFrame:
    columns = "f, lang" if name == "file" else "*"
    return spark.sql(f"WITH {CODE} SELECT {columns} FROM {name}")


#: What most relations are made of; written before them where several read it, so that each table is read and joined once.
STEPS = ("file", "pt", "occ")
#: Relations with a row for nearly every row that is read: to look for duplicates before they are dealt out fills memory
#: with a hash table of all, which spills.
UNLIKE = ("scip_ref", "name_ref")
ROWS = 1_000_000  # of occ, for each partition of these


def relations(spark: SparkSession, sf_dir: str, names=tuple(schema.RELATIONS)) -> dict[str, DataFrame]:
    """Relations of the 16, written out. Those that don't depend on each other are written at the same time."""
    register(spark, sf_dir)
    parts = dict(re.findall(r"^(\w+) AS (\(.*?\)),?$(?=\n\w+ AS |\s*\Z)", CODE.strip(), re.M | re.S))
    made: dict[str, DataFrame] = {}
    counts: dict[str, int] = {}
    tag = uuid.uuid4().hex
    source = lambda n: f"(SELECT * FROM tessera_{tag}_{n})" if n in made else parts[n]

    def reads(name: str) -> list[str]:
        return [n for n in parts if n != name for _ in re.findall(rf"\b{n}\b(?! AS)", re.sub(r"'[^']*'", "", source(name)))]

    def needed(name: str) -> set[str]:
        return {name}.union(*(needed(n) for n in reads(name)))

    def write(name: str, columns: str = "*") -> DataFrame:
        use, text = needed(name), source
        if name in UNLIKE:  # all rows first, and duplicates go once they are dealt out
            text = lambda n: re.sub(r" UNION SELECT ", " UNION ALL SELECT ", source(n).replace("(SELECT DISTINCT ", "(SELECT ", 1)) if n == name else source(n)
        df = spark.sql(f"WITH {', '.join(f'{n} AS {text(n)}' for n in parts if n in use)} SELECT {columns} FROM {name}")
        if name in UNLIKE:
            n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), counts.get("occ", 0) // ROWS)
            df = (df.repartition(n, *df.columns) if counts.get("occ", 0) > ROWS else df.repartition(*df.columns)).distinct()
        df, counts[name] = counted(df, name)
        return df

    try:
        used = set().union(*map(needed, names))
        for name in STEPS:
            if sum(reads(n).count(name) for n in used) > 1:
                df = write(name)
                df.createOrReplaceTempView(f"tessera_{tag}_{name}")
                made[name] = df
        todo = [n for n in schema.RELATIONS if n in names]
        with ThreadPoolExecutor(8) as pool:
            return dict(zip(todo, pool.map(inheritable_thread_target(spark)(lambda n: write(n, "f, lang" if n == "file" else "*")), todo)))
    finally:
        for name in made:
            spark.catalog.dropTempView(f"tessera_{tag}_{name}")


def version(spark: SparkSession, sf_dir: str) -> tuple:
    """Path, length and time of every file of the tables: what is kept of them is stale once this differs."""
    sc = spark.sparkContext
    root = sc._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = root.getFileSystem(sc._jsc.hadoopConfiguration()).listFiles(root, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


_ENGINES: dict[tuple[str, str], tuple[tuple, Engine]] = {}


def code(spark: SparkSession, sf_dir: str, warm: bool = True) -> Engine:
    """An engine over the code graph, with the rule library. A relation is written out once for each state of the folder's
    files, when a query first needs it; the engine stays warm, or with warm=False forgets what earlier queries have finished."""
    key, now = (spark.sparkContext.applicationId, sf_dir), version(spark, sf_dir)
    if key not in _ENGINES or _ENGINES[key][0] != now:
        e = Engine(spark, LIMITS, code=True)
        e.provide(schema.RELATIONS, lambda names: relations(spark, sf_dir, names))
        _ENGINES[key] = now, e
    e = _ENGINES[key][1]
    if not warm:
        e.warm = {}
    return e

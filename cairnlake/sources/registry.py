"""The registry's tables, derived from the star-schema test tables.

objects, edges, observations, points, lake entries and requests; one SQL text each, in which
braces name the tables, so that any SQL engine can make the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def _label(key: str) -> str:
    return f"CASE {key} % 5 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'ANONYMOUS' WHEN 2 THEN 'PERSONAL' WHEN 3 THEN 'SENSITIVE' ELSE 'RESTRICTED' END"


def _id(kind: str, key: str) -> str:
    return f"concat('{kind}:', lpad(CAST({key} AS STRING), 9, '0'))"


def _object(kind: str, table: str, key: str, name: str, tenant: str = "'default'", status: str = "'ACTIVE'") -> str:
    return f"SELECT {_id(kind.lower(), key)} AS object_id, '{kind}' AS canonical_type, {tenant} AS tenant_id, {status} AS status, {_label(key)} AS label, CAST({key} AS BIGINT) AS k, {name} AS name FROM {{{table}}}"


def _edge(kind: str, table: str, a: str, relation: str, to: str, b: str) -> str:
    return f"SELECT {_id(kind, a)} AS source_id, '{relation}' AS relation, {_id(to, b)} AS target_id, {_label(f'({a} + {b})')} AS label, CASE WHEN ({a} + {b}) % 11 = 0 THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status FROM {table}"


OBJECTS = "\nUNION ALL ".join([
    _object("Region", "region", "r_regionkey", "r_name"),
    _object("Nation", "nation", "n_nationkey", "n_name"),
    _object("Customer", "customer", "c_custkey", "c_name", "concat('t', CAST(c_custkey % 2 AS STRING))"),
    _object("Supplier", "supplier", "s_suppkey", "s_name"),
    _object("Part", "part", "p_partkey", "p_name"),
    _object("Order", "orders", "o_orderkey", "o_orderpriority", "concat('t', CAST(o_orderkey % 2 AS STRING))", "CASE WHEN o_orderstatus = 'P' THEN 'SUPERSEDED' ELSE 'ACTIVE' END"),
])

_RAW_EDGES = "\nUNION ALL ".join([
    _edge("nation", "{nation}", "n_nationkey", "locatedIn", "region", "n_regionkey"),
    _edge("customer", "{customer}", "c_custkey", "basedIn", "nation", "c_nationkey"),
    _edge("supplier", "{supplier}", "s_suppkey", "basedIn", "nation", "s_nationkey"),
    _edge("order", "{orders}", "o_orderkey", "placedBy", "customer", "o_custkey"),
    _edge("order", "(SELECT DISTINCT l_orderkey, l_suppkey FROM {lineitem}) s", "l_orderkey", "suppliedBy", "supplier", "l_suppkey"),
    _edge("order", "(SELECT DISTINCT l_orderkey, l_partkey FROM {lineitem}) p", "l_orderkey", "contains", "part", "l_partkey"),
])
RELATIONSHIP_ID = "md5(concat(source_id, '|', relation, '|', target_id))"
EDGES = f"SELECT {RELATIONSHIP_ID} AS relationship_id, * FROM ({_RAW_EDGES}) e"
#: The same without ids: they derive from the other columns, so with_ids() can add them behind all exchanges.
BARE_EDGES = _RAW_EDGES

#: Each event is one observation of the property `value` of a user, by the source event_type.
OBSERVATIONS = """
SELECT event_id AS handoff_id, concat('user:', lpad(CAST(user_id AS STRING), 9, '0')) AS object_id,
  'value' AS property, event_type AS source_id, CAST(floor(value / 200) AS BIGINT) AS value,
  ts AS observed_at, ts AS created_at, event_id AS contribution_id, event_id AS seq, user_id, event_type, value AS amount, props
FROM {events}
"""

#: Points on a small grid, as in a city.
POINTS = "SELECT object_id, canonical_type, tenant_id, status, label, k, 13.60 + (k % 100) * 0.001 AS lon, 45.60 + (CAST(floor(k / 100) AS BIGINT) % 100) * 0.001 AS lat FROM ({OBJECTS}) o WHERE canonical_type IN ('Customer', 'Supplier')"

LAKE = """
SELECT concat('lake:', lpad(CAST(doc_id AS STRING), 9, '0')) AS lake_id, concat('t', CAST(doc_id % 2 AS STRING)) AS tenant_id,
  source AS source_id, lang AS type_code, CASE WHEN doc_id % 3 = 0 THEN 'RAW' ELSE 'CURATED' END AS tier,
  sha256hex AS content_hash, concat('lake/', CAST(doc_id AS STRING)) AS locator, CAST(n_chars AS BIGINT) AS size_bytes,
  CASE doc_id % 10 WHEN 0 THEN 'STAGED' WHEN 1 THEN 'DELETION_PENDING' WHEN 2 THEN 'COMPACTED' ELSE 'VERIFIED' END AS status,
  CASE WHEN doc_id % 13 = 0 THEN 'LEGAL_HOLD' ELSE 'STANDARD' END AS retention_class,
  CASE WHEN doc_id % 4 = 0 THEN 'OPEN' ELSE 'PERSONAL' END AS label, doc_id
FROM (SELECT *, {SHA} AS sha256hex FROM {documents}) d
"""


def registry(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived tables: OBJECTS, EDGES, BARE_EDGES, OBSERVATIONS, POINTS or LAKE."""
    text = globals()[name].replace("{OBJECTS}", OBJECTS).replace("{SHA}", "sha2(text, 256)")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def with_ids(edges: DataFrame) -> DataFrame:
    """Edges, or rows with their columns, with the relationship_id that EDGES gives them."""
    return edges.withColumn("relationship_id", F.expr(RELATIONSHIP_ID))


def registry_sql(name: str) -> str:
    """The same rows for DuckDB, over views of the tables' names."""
    text = globals()[name].replace("{OBJECTS}", OBJECTS).replace("{SHA}", "sha256(text)")
    for t in TABLES:
        text = text.replace(f"{{{t}}}", t)
    return text

"""Registered queries of the store, updates, the feed, SHACL, entailment, templates and access."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille import access, canonical, entailment, events, shacl
from quadrille.catalogue import PREFIXES, dataset
from quadrille.engine import Engine
from quadrille.plans.compiler import Compiler
from quadrille.plans.cut import shared_folder
from quadrille.plans.parser import parse_query
from quadrille.sources import rdf
from quadrille.store import Store
from quadrille.streaming import feed
from quadrille.terms import TYPE, XSD
from quadrille.update import Updater


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def history(spark: SparkSession, sf_dir: str) -> Store:
    """Four commits: events by event_id % 4; a value of 50 or more asserts (user, type), a smaller one retracts it."""
    rows = _table(spark, sf_dir, "events").select(
        F.when(F.col("value") >= 50, "+").otherwise("-").alias("op"), F.concat(F.lit("<urn:u:"), F.col("user_id").cast("string"), F.lit(">")).alias("s"), F.lit("<urn:did>").alias("p"),
        F.concat(F.lit('"'), F.col("event_type"), F.lit('"')).alias("o"), F.lit(None).cast("string").alias("g"), F.col("event_id").alias("seq"),
    )
    store = Store(spark, folder(spark))
    for k in range(4):
        store.apply(rows.where(F.col("seq") % 4 == k))
        if k == 1:
            store.checkpoint()
    return store


def _plain(df: DataFrame, *names: str) -> DataFrame:
    """User number and event type of quads."""
    return df.select(*names, F.regexp_extract("s", r"(\d+)>$", 1).cast("long").alias("u"), F.replace("o", F.lit('"'), F.lit("")).alias("t"))


def store_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(history(spark, sf_dir).quads(3))


def store_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(history(spark, sf_dir).diff(1, 4), "op")


def store_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(history(spark, sf_dir).extents(), "valid_from", "valid_to")


def feed_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.bounded(history(spark, sf_dir), 1, 3, pattern=(None, None, '"click"')).groupBy("position", "op").agg(F.count("*").alias("n"))


def update_modify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region move to a graph, renamed, by one request."""
    nations = dataset(spark, sf_dir, "nation")
    store = Store(spark, folder(spark))
    store.insert(nations.all_quads())
    Updater(store).run(PREFIXES + "DELETE { ?x c:n_name ?n } INSERT { GRAPH g:moved { ?x c:n_name ?m } } WHERE { ?x c:n_regionkey <urn:t:region/2> ; c:n_name ?n BIND(LCASE(?n) AS ?m) } ; DELETE WHERE { ?x c:n_nationkey 3 }")
    return Engine(spark, store.dataset()).table(PREFIXES + "SELECT ?g (COUNT(*) AS ?n) { { ?x c:n_name ?m BIND(\"default\" AS ?g) } UNION { GRAPH g:moved { ?x c:n_name ?m } BIND(?m AS ?g) } UNION { ?x c:n_nationkey ?m BIND(\"key\" AS ?g) } } GROUP BY ?g").select(F.replace("g", F.lit('"'), F.lit("")).alias("g"), "n")


def construct(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, dataset(spark, sf_dir, "nation", "region"))
    return engine.construct(PREFIXES + "CONSTRUCT { ?r <urn:holds> ?n } WHERE { ?n c:n_regionkey ?r }")


def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, dataset(spark, sf_dir, "nation")).describe("DESCRIBE <urn:t:nation/7>").select("p")


SHAPES = f"""
@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix c: <urn:c:> . @prefix xsd: <{XSD}> .
<urn:shape> a sh:NodeShape ; sh:targetClass <urn:t:Customer> ;
  sh:property [ sh:path c:c_acctbal ; sh:minInclusive 0.0 ; sh:datatype xsd:double ; sh:minCount 1 ] ;
  sh:property [ sh:path c:c_mktsegment ; sh:in ( "BUILDING" "AUTOMOBILE" "MACHINERY" "HOUSEHOLD" ) ; sh:maxCount 1 ] .
"""


def shacl_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = dataset(spark, sf_dir, "customer").all_quads()
    report = shacl.validate(spark, data, rdf.parse_turtle(SHAPES))
    return report.select(F.regexp_extract("component", "#(.*)>", 1).alias("component")).groupBy("component").agg(F.count("*").alias("n"))


def rdfs_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places: regions and nations by sub-class, and whatever a nation's region column names by its range."""
    schema = "@prefix r: <http://www.w3.org/2000/01/rdf-schema#> . <urn:t:Nation> r:subClassOf <urn:t:Place> . <urn:c:n_regionkey> r:range <urn:t:Region> . <urn:t:Region> r:subClassOf <urn:t:Place> ."
    closed = entailment.Schema.of([q[:3] for q in rdf.parse_turtle(schema)])
    query = parse_query("SELECT ?x { ?x a <urn:t:Place> }")
    frame = Compiler(spark, dataset(spark, sf_dir, "nation")).compile(entailment.rewrite(query.pattern, closed))
    return frame.as_terms({"x"}).df.select(F.col("v_x").alias("x"))


def row_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads of orders that a caller for the customers of nation 3 may see."""
    data = dataset(spark, sf_dir, "orders", "customer").all_quads()
    own = _table(spark, sf_dir, "customer").select(F.concat(F.lit("<urn:t:customer/"), F.col("c_custkey").cast("string"), F.lit(">")).alias("node"), F.col("c_nationkey").cast("string").alias("subject"))
    classes = access.classify(data, own, ["<urn:c:o_custkey>"])
    shown = access.row_scope(data, classes, ["3"], [])
    return shown.where(F.col("p") == "<urn:c:o_custkey>").select("s")


def first_degree_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blank nodes share a first-degree hash, customers standing as blank nodes."""
    rows = _table(spark, sf_dir, "customer")
    node = F.concat(F.lit("_:c"), F.col("c_custkey").cast("string"))
    quads = rows.select(node.alias("s"), F.lit("<urn:seg>").alias("p"), F.concat(F.lit('"'), "c_mktsegment", F.lit('"')).alias("o"), F.lit(None).cast("string").alias("g"))
    return canonical.first_degree(quads).groupBy("hash").agg(F.count("*").alias("n")).select("n")


def domain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event for every order of status P that the first commit asserts."""
    orders = dataset(spark, sf_dir, "orders").all_quads()
    store = Store(spark, folder(spark))
    store.insert(orders)
    declared = events.EventType("<urn:t:Orders>", "OrderPlaced", "1", PREFIXES + 'SELECT ?event ?total { ?event c:o_totalprice ?total ; c:o_orderstatus "P" }', "event", {"total": ("total", True)})
    found = events.render(spark, store, [declared], 0, 1).where("problem is null")
    return found.select(F.regexp_extract("node", r"(\d+)>$", 1).cast("long").alias("o"), F.get_json_object("event", "$.type").alias("type"), F.round(F.get_json_object("event", "$.data.total").cast("double"), 2).alias("total"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (store_as_of, store_diff, store_extents, feed_bounded, update_modify, construct, describe, shacl_report, rdfs_instances, row_scope, first_degree_hashes, domain_events)}

#: By commit and quad the operation that counts; then the state after each commit that touched the quad.
_LOG = """WITH ops AS (SELECT user_id AS u, event_type AS t, event_id % 4 + 1 AS pos, arg_max(CASE WHEN value >= 50 THEN '+' ELSE '-' END, event_id) AS op FROM events GROUP BY 1, 2, 3),
    runs AS (SELECT *, coalesce(lag(op) OVER (PARTITION BY u, t ORDER BY pos), '-') AS before FROM ops),
    changes AS (SELECT u, t, pos, op FROM runs WHERE op <> before) """

ORACLE_SQL: dict[str, str] = {
    "store_as_of": _LOG + "SELECT u, t FROM changes WHERE pos <= 3 GROUP BY u, t HAVING arg_max(op, pos) = '+'",
    "store_diff": _LOG + "SELECT op, u, t FROM (SELECT u, t, arg_min(op, pos) AS a, arg_max(op, pos) AS op FROM changes WHERE pos > 1 GROUP BY u, t) WHERE a = op",
    "store_extents": _LOG + "SELECT pos AS valid_from, valid_to, u, t FROM (SELECT *, lead(pos) OVER (PARTITION BY u, t ORDER BY pos) AS valid_to FROM changes) WHERE op = '+'",
    "feed_bounded": _LOG + "SELECT pos AS position, op, count(*) AS n FROM changes WHERE pos IN (2, 3) AND t = 'click' GROUP BY 1, 2",
    "update_modify": "SELECT 'default' AS g, count(*) AS n FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT lower(n_name), 1 FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'key', count(*) FROM nation WHERE n_nationkey <> 3",
    "construct": "SELECT '<urn:t:region/' || n_regionkey || '>' AS s, '<urn:holds>' AS p, '<urn:t:nation/' || n_nationkey || '>' AS o FROM nation",
    "describe": f"SELECT unnest(['{TYPE}', '<urn:c:n_nationkey>', '<urn:c:n_name>', '<urn:c:n_regionkey>']) AS p",
    "shacl_report": "SELECT 'MinInclusiveConstraintComponent' AS component, count(*) AS n FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0 UNION ALL SELECT 'InConstraintComponent', count(*) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD') HAVING count(*) > 0",
    "rdfs_instances": "SELECT '<urn:t:nation/' || n_nationkey || '>' AS x FROM nation UNION SELECT '<urn:t:region/' || n_regionkey || '>' FROM nation",
    "row_scope": "SELECT '<urn:t:orders/' || o_orderkey || '>' AS s FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3",
    "first_degree_hashes": "SELECT count(*) AS n FROM customer GROUP BY c_mktsegment",
    "domain_events": "SELECT o_orderkey AS o, 'OrderPlaced' AS type, round(o_totalprice, 2) AS total FROM orders WHERE o_orderstatus = 'P'",
}


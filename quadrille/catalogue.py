"""The registered queries of the engine over the star-schema tables, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.engine import Engine
from quadrille.sources.mapping import MappedTables, Table

PREFIXES = "PREFIX c: <urn:c:> PREFIX t: <urn:t:> PREFIX g: <urn:g:> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "

#: Keys and foreign keys of the tables.  A line item has no key of its own: its subject is a hash of the row.
KEYS = {
    "region": ("r_regionkey", {}), "nation": ("n_nationkey", {"n_regionkey": "region"}), "customer": ("c_custkey", {"c_nationkey": "nation"}), "supplier": ("s_suppkey", {"s_nationkey": "nation"}),
    "part": ("p_partkey", {}), "orders": ("o_orderkey", {"o_custkey": "customer"}), "events": ("event_id", {}), "documents": ("doc_id", {}), "labels": ("doc_id", {}), "pages": ("page_id", {}), "benchmark": ("item_id", {}),
}
_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def dataset(spark: SparkSession, sf_dir: str, *names: str, graphs: dict[str, str] | None = None) -> MappedTables:
    """The mapped tables of these names; ``graphs`` puts a table's rows into graphs named by a column."""
    tables = {}
    for name in names:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        graph = (graphs or {}).get(name)
        if name == "lineitem":
            links = {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}
            tables[name] = Table(name, df, f"sha2(concat_ws('|', {', '.join(_LINE)}), 256)", links, graph)
        elif name == "conversations":
            tables[name] = Table(name, df, "concat(cast(conv_id as string), '-', cast(turn as string))", {}, graph)
        else:
            key, links = KEYS[name]
            skip = ("doc_id",) if name == "labels" else ()
            tables[name] = Table(name, df, key, links, graph, skip)
    return MappedTables(tables)


Query = Callable[[SparkSession, str], DataFrame]


def _query(tables: str, text: str, graphs: dict[str, str] | None = None, rounded: tuple[str, ...] = ()) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = Engine(spark, dataset(spark, sf_dir, *tables.split(), graphs=graphs)).table(PREFIXES + text)
        return found.withColumns({c: F.round(c, 2) for c in rounded})

    return run


#: name: (tables, SPARQL, SQL[, graphs[, columns rounded to cents]])
_TABLE: dict[str, tuple] = {
    "bgp_segments": ("orders customer", 'SELECT ?seg (COUNT(?o) AS ?n) { ?o c:o_custkey ?c . ?c c:c_mktsegment ?seg . FILTER(?seg != "BUILDING") } GROUP BY ?seg ORDER BY ?seg',
        "SELECT c_mktsegment AS seg, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY 1"),
    "bgp_chain": ("orders customer nation region", "SELECT ?r (COUNT(*) AS ?n) { ?o c:o_custkey/c:c_nationkey/c:n_regionkey ?x . ?x c:r_name ?r } GROUP BY ?r",
        "SELECT r_name AS r, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "bgp_typed": ("customer supplier", "SELECT (COUNT(*) AS ?n) { ?x a t:Customer ; c:c_nationkey ?k . ?y a t:Supplier ; c:s_nationkey ?k }",
        "SELECT count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey"),
    "bgp_constant_object": ("customer", 'SELECT ?c ?b { ?c c:c_mktsegment "BUILDING" ; c:c_nationkey <urn:t:nation/3> ; c:c_acctbal ?b }',
        "SELECT 'urn:t:customer/' || c_custkey AS c, c_acctbal AS b FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3"),
    "bgp_variable_predicate": ("nation region", "SELECT ?p (COUNT(*) AS ?n) { ?s ?p ?o } GROUP BY ?p",
        "SELECT '<urn:c:' || p || '>' AS p, n FROM (SELECT unnest(['n_nationkey','n_name','n_regionkey']) AS p, (SELECT count(*) FROM nation) AS n UNION ALL SELECT unnest(['r_regionkey','r_name']), (SELECT count(*) FROM region)) UNION ALL SELECT '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)"),
    "filter_range": ("lineitem", "SELECT (COUNT(*) AS ?n) { ?l c:l_quantity ?q ; c:l_discount ?d . FILTER(?q < 24 && ?d >= 0.05 && ?d <= 0.07) }",
        "SELECT count(*) AS n FROM lineitem WHERE l_quantity < 24 AND l_discount >= 0.05 AND l_discount <= 0.07"),
    "filter_in": ("orders", 'SELECT ?p (COUNT(*) AS ?n) { ?o c:o_orderpriority ?p ; c:o_orderstatus ?s . FILTER(?s IN ("O", "P")) } GROUP BY ?p',
        "SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1"),
    "filter_date": ("orders", 'SELECT (COUNT(*) AS ?n) { ?o c:o_orderdate ?d . FILTER(YEAR(?d) = 1996 && MONTH(?d) > 6) }',
        "SELECT count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 AND month(o_orderdate) > 6"),
    "optional": ("documents labels", "SELECT ?l (COUNT(?d) AS ?n) (COUNT(?q) AS ?k) { ?d c:lang ?l ; c:n_chars ?m . OPTIONAL { ?x c:quality ?q . FILTER(STRAFTER(STR(?x), \"labels/\") = STRAFTER(STR(?d), \"documents/\")) } } GROUP BY ?l",
        "SELECT lang AS l, count(*) AS n, count(quality) AS k FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"),
    "optional_filter": ("customer nation", 'SELECT ?c ?n { ?c c:c_nationkey ?k . OPTIONAL { ?k c:n_name ?n . FILTER(STRSTARTS(?n, "A") || STRSTARTS(?n, "N")) } }',
        "SELECT 'urn:t:customer/' || c_custkey AS c, n_name AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND (n_name LIKE 'A%' OR n_name LIKE 'N%')"),
    "union": ("customer supplier", "SELECT ?k (COUNT(*) AS ?n) { { ?x c:c_nationkey ?k } UNION { ?x c:s_nationkey ?k } } GROUP BY ?k",
        "SELECT 'urn:t:nation/' || k AS k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1"),
    "minus": ("customer orders", "SELECT (COUNT(*) AS ?n) { ?c c:c_custkey ?k MINUS { ?o c:o_custkey ?c ; c:o_orderstatus \"F\" } }",
        "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"),
    "exists": ("customer orders", "SELECT (COUNT(*) AS ?n) { ?c c:c_custkey ?k FILTER EXISTS { ?o c:o_custkey ?c ; c:o_totalprice ?p FILTER(?p > 300000) } }",
        "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "not_exists_correlated": ("orders customer", "SELECT (COUNT(*) AS ?n) { ?c c:c_acctbal ?b FILTER NOT EXISTS { ?o c:o_custkey ?c ; c:o_totalprice ?p FILTER(?p > ?b * 40) } }",
        "SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)"),
    "exists_or": ("customer orders", 'SELECT (COUNT(*) AS ?n) { ?c c:c_mktsegment ?s FILTER(?s = "BUILDING" || EXISTS { ?o c:o_custkey ?c ; c:o_orderstatus "P" }) }',
        "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    "bind": ("part", "SELECT ?p ?band { ?p c:p_size ?s BIND(IF(?s < 15, \"small\", IF(?s < 35, \"middle\", \"large\")) AS ?band) }",
        "SELECT 'urn:t:part/' || p_partkey AS p, CASE WHEN p_size < 15 THEN 'small' WHEN p_size < 35 THEN 'middle' ELSE 'large' END AS band FROM part"),
    "values": ("nation", "SELECT ?n ?x { VALUES (?k ?x) { (<urn:t:region/0> 1) (<urn:t:region/1> UNDEF) } ?y c:n_regionkey ?k ; c:n_name ?n }",
        "SELECT n_name AS n, CASE WHEN n_regionkey = 0 THEN '\"1\"^^<http://www.w3.org/2001/XMLSchema#integer>' END AS x FROM nation WHERE n_regionkey IN (0, 1)"),
    "subselect": ("orders customer", "SELECT ?seg (MAX(?n) AS ?most) { ?c c:c_mktsegment ?seg { SELECT ?c (COUNT(?o) AS ?n) { ?o c:o_custkey ?c } GROUP BY ?c } } GROUP BY ?seg",
        "SELECT c_mktsegment AS seg, max(n) AS most FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1"),
    "graph_named": ("orders", "SELECT (COUNT(*) AS ?n) { GRAPH g:F { ?o c:o_totalprice ?p } }", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'", {"orders": "o_orderstatus"}),
    "graph_variable": ("orders", "SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?o c:o_totalprice ?p FILTER(?p > 100000) } } GROUP BY ?g",
        "SELECT 'urn:g:' || o_orderstatus AS g, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1", {"orders": "o_orderstatus"}),
    "from_graphs": ("orders", "SELECT (COUNT(*) AS ?n) FROM g:F FROM g:P { ?o c:o_totalprice ?p }", "SELECT count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P')", {"orders": "o_orderstatus"}),
    "distinct": ("lineitem", "SELECT DISTINCT ?f ?s { ?l c:l_returnflag ?f ; c:l_linestatus ?s }", "SELECT DISTINCT l_returnflag AS f, l_linestatus AS s FROM lineitem"),
    "order_limit": ("orders", "SELECT ?o ?p { ?o c:o_totalprice ?p } ORDER BY DESC(?p) ?o LIMIT 20", "SELECT 'urn:t:orders/' || o_orderkey AS o, o_totalprice AS p FROM orders ORDER BY p DESC LIMIT 20"),
    "aggregate_all": ("lineitem", "SELECT ?f (COUNT(*) AS ?n) (SUM(?q) AS ?s) (AVG(?q) AS ?a) (MIN(?q) AS ?lo) (MAX(?q) AS ?hi) (COUNT(DISTINCT ?q) AS ?k) { ?l c:l_returnflag ?f ; c:l_quantity ?q } GROUP BY ?f",
        "SELECT l_returnflag AS f, count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 2) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi, count(DISTINCT l_quantity) AS k FROM lineitem GROUP BY 1", None, ("s", "a")),
    "aggregate_having": ("customer", "SELECT ?k (SUM(?b) AS ?s) { ?c c:c_nationkey ?k ; c:c_acctbal ?b } GROUP BY ?k HAVING(COUNT(*) > 50)",
        "SELECT 'urn:t:nation/' || c_nationkey AS k, round(sum(c_acctbal), 2) AS s FROM customer GROUP BY c_nationkey HAVING count(*) > 50", None, ("s",)),
    "aggregate_expression": ("lineitem", "SELECT ?f (SUM(?p * (1 - ?d)) AS ?s) { ?l c:l_returnflag ?f ; c:l_extendedprice ?p ; c:l_discount ?d } GROUP BY ?f",
        "SELECT l_returnflag AS f, round(sum(l_extendedprice * (1 - l_discount)), 2) AS s FROM lineitem GROUP BY 1", None, ("s",)),
    "aggregate_concat": ("nation", 'SELECT ?k (GROUP_CONCAT(?n; separator="|") AS ?names) { ?x c:n_regionkey ?k ; c:n_name ?n } GROUP BY ?k',
        "SELECT 'urn:t:region/' || n_regionkey AS k, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "aggregate_sum_distinct": ("part", "SELECT (SUM(DISTINCT ?s) AS ?x) (SUM(?s) AS ?y) { ?p c:p_size ?s }", "SELECT sum(DISTINCT p_size) AS x, sum(p_size) AS y FROM part"),
    "strings": ("part", 'SELECT ?p (UCASE(?n) AS ?u) (SUBSTR(?n, 2, 4) AS ?s) (STRLEN(?n) AS ?l) (CONCAT(?b, "-", ?n) AS ?c) (STRBEFORE(?n, " ") AS ?w) (REPLACE(?b, "[0-9]+", "#") AS ?r) (ENCODE_FOR_URI(?n) AS ?e) { ?p c:p_name ?n ; c:p_brand ?b FILTER(REGEX(?b, "^brand#[12]", "i") || CONTAINS(?n, "a")) }',
        "SELECT 'urn:t:part/' || p_partkey AS p, upper(p_name) AS u, substr(p_name, 2, 4) AS s, length(p_name) AS l, p_brand || '-' || p_name AS c, CASE WHEN position(' ' IN p_name) > 0 THEN split_part(p_name, ' ', 1) ELSE '' END AS w, regexp_replace(p_brand, '[0-9]+', '#', 'g') AS r, replace(url_encode(p_name), '+', '%20') AS e FROM part WHERE regexp_matches(p_brand, '^brand#[12]', 'i') OR contains(p_name, 'a')"),
    "hashes": ("nation", "SELECT ?n (MD5(?n) AS ?m) (SHA1(?n) AS ?s) (SHA256(?n) AS ?h) { ?x c:n_name ?n }", "SELECT n_name AS n, md5(n_name) AS m, sha1(n_name) AS s, sha256(n_name) AS h FROM nation"),
    "numbers": ("part", "SELECT ?p (ABS(?z - 25) AS ?a) (CEIL(?r) AS ?c) (FLOOR(?r) AS ?f) (ROUND(?r) AS ?o) (?z * 2 + 1 AS ?d) { ?p c:p_size ?z ; c:p_retailprice ?r }",
        "SELECT 'urn:t:part/' || p_partkey AS p, abs(p_size - 25) AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, floor(p_retailprice + 0.5) AS o, p_size * 2 + 1 AS d FROM part"),
    "dates": ("orders", "SELECT ?y ?m (COUNT(*) AS ?n) { ?o c:o_orderdate ?d BIND(YEAR(?d) AS ?y) BIND(MONTH(?d) AS ?m) } GROUP BY ?y ?m",
        "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2"),
    "casts": ("part", "SELECT ?p (xsd:integer(?r) AS ?i) (xsd:string(?s) AS ?t) (xsd:double(?s) AS ?d) (xsd:boolean(?s - 1) AS ?b) { ?p c:p_retailprice ?r ; c:p_size ?s }",
        "SELECT 'urn:t:part/' || p_partkey AS p, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS VARCHAR) AS t, CAST(p_size AS DOUBLE) AS d, p_size <> 1 AS b FROM part"),
    "coalesce_bound": ("nation region", 'SELECT ?n (COALESCE(?r, "none") AS ?x) (BOUND(?r) AS ?b) { ?y c:n_name ?n ; c:n_regionkey ?k OPTIONAL { ?k c:r_name ?r FILTER(?r > "B") } }',
        "SELECT n_name AS n, coalesce(r_name, 'none') AS x, r_name IS NOT NULL AS b FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name > 'B'"),
    "path_sequence_inverse": ("customer nation", "SELECT ?r (COUNT(*) AS ?n) { ?r ^c:n_regionkey/^c:c_nationkey ?c } GROUP BY ?r",
        "SELECT 'urn:t:region/' || n_regionkey AS r, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "path_alternative": ("customer supplier", "SELECT (COUNT(*) AS ?n) { ?x (c:c_nationkey|c:s_nationkey) <urn:t:nation/5> }",
        "SELECT (SELECT count(*) FROM customer WHERE c_nationkey = 5) + (SELECT count(*) FROM supplier WHERE s_nationkey = 5) AS n"),
    "path_zero_or_one": ("nation", "SELECT (COUNT(*) AS ?n) { ?x c:n_regionkey? <urn:t:region/2> }", "SELECT count(*) + 1 AS n FROM nation WHERE n_regionkey = 2"),
    "path_negated": ("nation", "SELECT (COUNT(*) AS ?n) { ?x !(c:n_name|c:n_regionkey) ?y }", "SELECT count(*) * 2 AS n FROM nation"),
    "q5_region_revenue": ("customer orders lineitem supplier nation region", "SELECT ?name (SUM(?p * (1 - ?d)) AS ?rev) { ?l c:l_orderkey ?o ; c:l_suppkey ?s ; c:l_extendedprice ?p ; c:l_discount ?d . ?o c:o_custkey ?c ; c:o_orderdate ?t . ?c c:c_nationkey ?k . ?s c:s_nationkey ?k . ?k c:n_name ?name ; c:n_regionkey ?r . ?r c:r_name \"ASIA\" . FILTER(YEAR(?t) = 1996) } GROUP BY ?name",
        "SELECT n_name AS name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND year(o_orderdate) = 1996 GROUP BY 1", None, ("rev",)),
}


def _closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation that a turn leads to, over an edge relation given as quads."""
    from quadrille.sources.quads import Dataset

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn").distinct()
    node = lambda t: F.concat(F.lit("<urn:turn:"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"), F.lit(">"))
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"))
    quads = turns.join(later, ["conv_id", "turn"]).select(node(F.col("turn")).alias("s"), F.lit("<urn:next>").alias("p"), node(F.col("turn") + 1).alias("o"), F.lit(None).cast("string").alias("g"))
    return Engine(spark, Dataset(quads)).table("SELECT ?a ?b { ?a <urn:next>+ ?b }")


def _cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types reachable from each other through consecutive events of a user: a cyclic relation."""
    from pyspark.sql import Window

    from quadrille.sources.quads import Dataset

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = events.select(F.col("event_type").alias("x"), F.lead("event_type").over(by_user).alias("y")).where("y is not null").distinct()
    iri = lambda c: F.concat(F.lit("<urn:e:"), F.col(c), F.lit(">"))
    quads = pairs.select(iri("x").alias("s"), F.lit("<urn:then>").alias("p"), iri("y").alias("o"), F.lit(None).cast("string").alias("g"))
    return Engine(spark, Dataset(quads)).table("SELECT ?a ?b { ?a <urn:then>+ ?b }")


QUERIES: dict[str, Query] = {name: _query(row[0], row[1], *row[3:]) for name, row in _TABLE.items()} | {"path_closure": _closure, "path_cycle": _cycle}
ORACLE_SQL: dict[str, str] = {name: row[2] for name, row in _TABLE.items()} | {
    "path_closure": "SELECT '<urn:turn:' || a.conv_id || '-' || a.turn || '>' AS a, '<urn:turn:' || b.conv_id || '-' || b.turn || '>' AS b FROM (SELECT DISTINCT conv_id, turn FROM conversations) a JOIN (SELECT DISTINCT conv_id, turn FROM conversations) b ON a.conv_id = b.conv_id AND b.turn > a.turn WHERE (SELECT count(DISTINCT x.turn) FROM conversations x WHERE x.conv_id = a.conv_id AND x.turn BETWEEN a.turn AND b.turn) = b.turn - a.turn + 1",
    "path_cycle": "WITH RECURSIVE e AS (SELECT DISTINCT event_type AS x, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y FROM events), p AS (SELECT x, y FROM e WHERE y IS NOT NULL UNION SELECT p.x, e.y FROM p JOIN e ON p.y = e.x WHERE e.y IS NOT NULL) SELECT '<urn:e:' || x || '>' AS a, '<urn:e:' || y || '>' AS b FROM p",
}

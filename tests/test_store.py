"""The store against a model, updates, the feed, RDF syntaxes, SHACL, entailment, access."""

import random
from datetime import datetime, timezone

import pytest

from quadrille import access, canonical, entailment, shacl
from quadrille.engine import Engine
from quadrille.plans.compiler import Compiler
from quadrille.plans.parser import parse_query
from quadrille.sources import rdf, results
from quadrille.sources.quads import SCHEMA, Dataset
from quadrille.store import Conflict, NotWritable, Rejected, Store
from quadrille.streaming import feed
from quadrille.terms import XSD
from quadrille.update import Updater


def rows(df):
    return {tuple(r) for r in df.select("s", "p", "o", "g").collect()}


def test_history_agrees_with_a_model(spark, tmp_path):
    store, rng, state, states = Store(spark, str(tmp_path)), random.Random(3), set(), [set()]
    for _ in range(5):
        ops = [(rng.choice("+-"), f"<urn:s{rng.randrange(3)}>", "<urn:p>", f"<urn:o{rng.randrange(2)}>", rng.choice([None, "<urn:g>"]), i) for i in range(6)]
        for op, *quad, _ in ops:
            (state.add if op == "+" else state.discard)(tuple(quad))
        if state != states[-1]:
            store.apply(spark.createDataFrame(ops, "op string, s string, p string, o string, g string, seq int"))
            states.append(set(state))
    assert store.head() == len(states) - 1
    store.checkpoint(2)
    for position, wanted in enumerate(states):
        assert rows(store.quads(position)) == wanted
    delta = {tuple(r) for r in store.diff(1, store.head()).select("op", "s", "p", "o", "g").collect()}
    assert delta == {("+", *q) for q in states[-1] - states[1]} | {("-", *q) for q in states[1] - states[-1]}
    assert rows(store.extents().where("valid_to is null")) == states[-1]
    assert store.verify() == []
    assert store.insert(spark.createDataFrame(sorted(states[-1], key=str), SCHEMA)).status == "no change"
    with pytest.raises(Conflict):
        store.insert(spark.createDataFrame([("<urn:n>", "<urn:p>", "<urn:x>", None)], SCHEMA), expected=0)
    with pytest.raises(NotWritable):
        store.insert(spark.createDataFrame([("<urn:n>", "<urn:p>", "<urn:x>", "<urn:h>")], SCHEMA), writable=["<urn:g>"])


def test_updates(spark, tmp_path):
    store = Store(spark, str(tmp_path), clock=lambda: datetime(2024, 1, 1, tzinfo=timezone.utc))
    run = Updater(store).run
    assert run("INSERT DATA { <urn:a> <urn:p> 1 , 2 . GRAPH <urn:g> { <urn:b> <urn:p> 3 } }", key="k1").position == 1
    assert run("INSERT DATA { <urn:a> <urn:p> 1 }", key="k1").status == "repeated"
    run("DELETE { ?s <urn:p> ?v } INSERT { ?s <urn:q> ?w } WHERE { ?s <urn:p> ?v BIND(?v + 10 AS ?w) }")
    assert {r[2] for r in rows(store.quads()) if r[3] is None} == {f'"{x}"^^<{XSD}integer>' for x in (11, 12)}
    run("WITH <urn:g> DELETE { ?s ?p ?o } INSERT { ?s <urn:r> ?o } WHERE { ?s ?p ?o } ; COPY <urn:g> TO <urn:h> ; MOVE <urn:h> TO <urn:i> ; CLEAR DEFAULT")
    assert {(r[1], r[3]) for r in rows(store.quads())} == {("<urn:r>", "<urn:g>"), ("<urn:r>", "<urn:i>")}
    assert run("DELETE WHERE { GRAPH ?g { ?s ?p ?o } }").status == "committed" and not rows(store.quads())
    text = "\n".join(r["value"] for r in feed.to_text(feed.bounded(store)).orderBy("position").collect())
    parsed = list(feed.parse_text(text))
    assert [c["position"] for c in parsed] == [1, 2, 3, 4] and len(parsed[0]["changes"]) == 3
    seen = []
    feed.follow(store, lambda df, i: seen.append(df.select("position").distinct().count()), str(tmp_path / "mark"), once=True).awaitTermination()
    assert sum(seen) == 4
    projection = feed.Projection(store, str(tmp_path / "projection"), lambda state, changes: changes.groupBy("op").count() if state is None else state.unionByName(changes.groupBy("op").count()).groupBy("op").sum("count").withColumnRenamed("sum(count)", "count"))
    projection.update(2)
    assert {r["op"]: r["count"] for r in projection.update().collect()} == {r["op"]: r["count"] for r in store.changes().groupBy("op").count().collect()}


TTL = """
@prefix e: <urn:e:> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
e:a a e:Person ; e:name "Ann"@en , '''x"y''' ; e:age 5, 2.5, 1e0, true ; e:knows [ e:name "B" ] ; e:list ( 1 2 ) .
<< e:a e:p e:b ~ e:r >> e:q 1 . e:a e:s e:t {| e:u e:v |} .
"""


def test_turtle_and_nquads(spark, tmp_path):
    quads = rdf.parse_turtle(TTL)
    assert len(quads) == 19 and ("<urn:e:a>", "<urn:e:age>", f'"1e0"^^<{XSD}double>', None) in quads
    assert {q[:3] for q in rdf.parse_turtle(rdf.to_turtle(quads, {"e": "urn:e:"})) if "_:" not in str(q)} == {q[:3] for q in quads if "_:" not in str(q)}
    df = spark.createDataFrame(quads, SCHEMA)
    rdf.write_nquads(df, str(tmp_path / "out.nq"))
    again = rdf.read(spark, str(tmp_path / "out.nq"))
    assert again.count() == 19 and canonical.isomorphic(df, again)
    (tmp_path / "x.ttl").write_text(TTL)
    assert canonical.isomorphic(df, rdf.read(spark, str(tmp_path / "x.ttl")))
    assert not canonical.isomorphic(df, df.limit(18))
    with pytest.raises(rdf.RdfSyntaxError):
        rdf.parse_nquad('<a> "b" <c> .')
    assert rdf.parse_nquad("# nothing") is None


def test_rdfxml(spark):
    from quadrille.sources.rdfxml import parse_rdfxml, to_rdfxml

    text = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="urn:e:" xml:base="http://x/">
      <e:P rdf:about="a" e:n="1"><e:k rdf:resource="#b"/><e:l xml:lang="en">hi</e:l><e:d rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">3</e:d>
      <e:c rdf:parseType="Collection"><rdf:Description rdf:about="q"/></e:c><e:r rdf:parseType="Resource"><e:z>9</e:z></e:r><rdf:li>one</rdf:li></e:P></rdf:RDF>"""
    triples = parse_rdfxml(text)
    assert ("<http://x/a>", "<urn:e:k>", "<http://x/#b>", None) in triples and ("<http://x/a>", "<urn:e:l>", '"hi"@en', None) in triples and len(triples) == 11
    one, two = (spark.createDataFrame(t, SCHEMA) for t in (triples, parse_rdfxml(to_rdfxml(triples))))
    assert canonical.isomorphic(one, two)


def test_results(spark):
    df = spark.createDataFrame([("<urn:a>", '"x"@en', None), ("_:b", f'"1"^^<{XSD}integer>', '<<( <urn:a> <urn:b> "c" )>>')], "x string, y string, z string")
    for write, read in ((results.to_json, results.read_json), (results.to_xml, results.read_xml)):
        names, found = read(write(df))
        assert names == ["x", "y", "z"] and found == [{k: v for k, v in r.asDict().items() if v is not None} for r in df.collect()]
        assert read(write(True)) is True
    assert results.to_csv(df).splitlines()[1] == "urn:a,x," and results.to_tsv(df).splitlines()[1] == '<urn:a>\t"x"@en\t'


SHAPES = """
@prefix e: <urn:e:> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
e:S a sh:NodeShape ; sh:targetClass e:P ; sh:property e:N , [ sh:path e:age ; sh:maxCount 1 ; sh:datatype xsd:integer ; sh:minInclusive 0 ] , [ sh:path e:knows ; sh:class e:P ] ; sh:not [ sh:path e:bad ; sh:minCount 1 ] .
e:N sh:path e:name ; sh:minCount 1 ; sh:pattern "^[A-Z]" ; sh:nodeKind sh:Literal ; sh:maxLength 5 .
"""
PEOPLE = """
@prefix e: <urn:e:> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
e:Q rdfs:subClassOf e:P . e:good a e:Q ; e:name "Ann" ; e:age 3 ; e:knows e:other . e:other a e:P ; e:name "Bob" .
e:lower a e:P ; e:name "bob" . e:none a e:P . e:old a e:P ; e:name "Old" ; e:age -1 , "x" ; e:knows e:thing . e:worse a e:P ; e:name "W" ; e:bad 1 .
"""


def test_shacl(spark, tmp_path):
    data = spark.createDataFrame([q[:3] for q in rdf.parse_turtle(PEOPLE)], "s string, p string, o string")
    report = {(r["focus"][7:-1], r["component"].rpartition("#")[2][:-20]) for r in shacl.validate(spark, data, rdf.parse_turtle(SHAPES)).collect()}
    assert report == {("lower", "Pattern"), ("none", "MinCount"), ("old", "MaxCount"), ("old", "Datatype"), ("old", "MinInclusive"), ("old", "Class"), ("worse", "Not")}
    store = Store(spark, str(tmp_path), validators=[shacl.gate(spark, rdf.parse_turtle(SHAPES))])
    with pytest.raises(Rejected):
        store.insert(spark.createDataFrame([("<urn:e:x>", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", "<urn:e:P>", None)], SCHEMA))
    assert store.head() == 0


def test_shacl_counts_focus_nodes_without_values(spark):
    shapes = "@prefix e: <urn:e:> . @prefix sh: <http://www.w3.org/ns/shacl#> . e:S a sh:NodeShape ; sh:targetClass e:P ; sh:property [ sh:path e:k ; sh:qualifiedValueShape [ sh:class e:P ] ; sh:qualifiedMinCount 1 ] , [ sh:path e:m ; sh:equals e:n ] ."
    people = "@prefix e: <urn:e:> . e:a a e:P ; e:k e:b . e:b a e:P . e:c a e:P ; e:k e:a ; e:n e:z . e:d a e:P ; e:k e:c ; e:m e:z ; e:n e:z ."
    data = spark.createDataFrame([q[:3] for q in rdf.parse_turtle(people)], "s string, p string, o string")
    report = sorted((r["focus"][7:-1], r["component"].rpartition("#")[2][:-20]) for r in shacl.validate(spark, data, rdf.parse_turtle(shapes)).collect())
    assert report == [("b", "QualifiedMinCount"), ("c", "Equals")]


def test_a_writer_that_loses_the_position_leaves_the_winner_alone(spark, tmp_path):
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    rows = lambda x: spark.createDataFrame([("<urn:a>", "<urn:p>", x, None)], SCHEMA)
    publish = two._publish

    def late(name, text):
        one.insert(rows("<urn:one>"))
        return publish(name, text)

    two._publish = late
    with pytest.raises(Conflict):
        two.insert(rows("<urn:two>"))
    assert one.head() == 1 and [r["o"] for r in one.quads().collect()] == ["<urn:one>"] and one.verify() == []


def test_entailment_equals_materialisation(spark):
    text = "@prefix e: <urn:e:> . @prefix r: <http://www.w3.org/2000/01/rdf-schema#> . e:Room r:subClassOf e:Space . e:Space r:subClassOf e:Thing . e:hasRoom r:domain e:Building ; r:range e:Room . e:main r:subPropertyOf e:hasRoom . e:r1 a e:Room . e:b1 e:main e:r2 ."
    quads = spark.createDataFrame(rdf.parse_turtle(text), SCHEMA)
    schema = entailment.read_schema(quads)

    def answers(query):
        frame = Compiler(spark, Dataset(quads)).compile(entailment.rewrite(parse_query(query).pattern, schema))
        return {tuple(r) for r in frame.df.collect()}

    assert answers("SELECT ?x { ?x a <urn:e:Thing> }") == {("<urn:e:r1>",), ("<urn:e:r2>",)}
    assert answers("SELECT ?x ?y { ?x <urn:e:hasRoom> ?y }") == {("<urn:e:b1>", "<urn:e:r2>")}
    assert answers("SELECT ?c { <urn:e:b1> a ?c }") == {("<urn:e:Building>",)}


def test_access(spark):
    quads = spark.createDataFrame([("<r>", "<of>", "<p1>", None), ("<s>", "<of>", "<r>", None), ("<t>", "<of>", "<p2>", "<urn:g/x>"), ("<u>", "<sees>", "<t>", None)], SCHEMA)
    roots = spark.createDataFrame([("<p1>", "one"), ("<p2>", "two")], "node string, subject string")
    classes = access.classify(quads, roots, ["<of>"])
    assert {tuple(r) for r in classes.collect()} == {("<p1>", "one"), ("<p2>", "two"), ("<r>", "one"), ("<s>", "one"), ("<t>", "two")}
    assert {r["s"] for r in access.row_scope(quads, classes, ["one"], []).collect()} == {"<r>", "<s>"}
    assert {r["s"] for r in access.row_scope(quads, classes, ["one"], ["<sees>"]).collect()} == {"<r>", "<s>", "<u>"}
    assert {r["s"] for r in access.subject_access(quads, classes, "two").collect()} == {"<t>"}
    assert {r["s"] for r in access.GraphScope(prefixes=("urn:g/",)).of(Dataset(quads)).df.collect()} == {"<t>"}
    assert access.may_write(quads, classes, ["one"]).count() == 1


def test_engine_over_a_past_state(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    Updater(store).run("INSERT DATA { <urn:a> <urn:p> <urn:b> }")
    Updater(store).run("DELETE DATA { <urn:a> <urn:p> <urn:b> }")
    assert Engine(spark, store.dataset(1)).ask("ASK { ?s ?p ?o }") and not Engine(spark, store.dataset()).ask("ASK { ?s ?p ?o }")
    assert store.position_at("2000-01-01T00:00:00Z") == 0 and store.position_at("2999-01-01T00:00:00Z") == 2


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_grouping_quads_does_not_sort_them(spark, tmp_path):
    from pyspark.sql import functions as F

    from quadrille.store import last_operations, net

    ops = [("-", "<a>", 3), ("+", "<a>", 7), ("+", "<b>", None), ("-", "<b>", -(1 << 63)), ("+", "<c>", 5), ("-", "<c>", 5), (None, "<d>", 9), ("+", "<d>", 8)]
    rows = spark.createDataFrame([(op, s, "<p>", "<o>", None, seq) for op, s, seq in ops], "op string, s string, p string, o string, g string, seq long")
    last = last_operations(rows)
    assert {(r["s"], r["op"]) for r in last.collect()} == {("<a>", "+"), ("<b>", "-"), ("<c>", "-"), ("<d>", None)}
    assert {(r["s"], r["op"]) for r in last_operations(rows.drop("seq")).collect()} == {("<a>", "-"), ("<b>", "-"), ("<c>", "-"), ("<d>", "+")}
    changes = rows.where("op is not null and seq > 0").withColumn("position", F.monotonically_increasing_id() + 1)
    assert {(r["s"], r["op"]) for r in net(changes).collect()} == {("<d>", "+")}
    assert not [d for d in (last, last_operations(rows.drop("seq")), net(changes)) if "SortAggregate" in _plan(d)]


def test_a_single_commit_is_read_without_grouping_it(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    assert store.quads().collect() == []
    store.insert(spark.createDataFrame([("<a>", "<p>", "<b>", None), ("<a>", "<p>", "<b>", None), ("<a>", "<p>", "<b>", "<g>")], "s string, p string, o string, g string"))
    assert sorted(map(tuple, store.quads().collect()), key=str) == sorted([("<a>", "<p>", "<b>", None), ("<a>", "<p>", "<b>", "<g>")], key=str)
    assert "Aggregate" not in _plan(store.quads()) and store.diff(1, 0).count() == 2


def test_the_content_hash_is_the_sum_of_the_lines_hashes(spark, tmp_path):
    import hashlib

    from quadrille.store import content_hash

    rows = [("+", f"<urn:{i}>", "<p>", f'"{i}"', "<g>" if i % 3 else None) for i in range(200)]
    sums = [0] * 8
    for r in rows:
        digest = hashlib.sha256(" ".join(x or "" for x in r).encode()).hexdigest()
        sums = [x + int(digest[8 * i : 8 * i + 8], 16) for i, x in enumerate(sums)]
    delta = spark.createDataFrame(rows, "op string, s string, p string, o string, g string")
    assert content_hash(delta) == hashlib.sha256("|".join(map(str, [200, *sums])).encode()).hexdigest()


def test_event_ordinals_are_counted_in_many_tasks(spark):
    from pyspark.sql import functions as F

    from quadrille import events

    rows = [(p, node, "<c>") for p in (1, 2, 5) for i in range(100 * p) for node in (f"<urn:{i}>", f"_:b{i}")] + [(2, "<urn:7>", "<d>")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = events.numbered(spark.createDataFrame(rows, "position long, node string, cls string").repartition(7)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wanted = [r for p in (1, 2, 5) for r in enumerate(sorted((r for r in rows if r[0] == p), key=lambda r: (r[1].startswith("_:"), *r[1:])), 1)]
    assert sorted((r["position"], r["ordinal"], r["node"], r["cls"]) for r in found) == sorted((r[0], i, *r[1:]) for i, r in wanted)
    assert len({r["task"] for r in found if r["position"] == 5}) > 1


def test_events_carry_values_of_every_kind(spark, tmp_path):
    import json

    from quadrille import events
    from quadrille.terms import TYPE, literal

    values = {"a": (literal("7", f"{XSD}integer"), 7), "b": (literal("2.50", f"{XSD}decimal"), 2.5), "c": (literal('x "y"\\'), 'x "y"\\'), "d": (literal("1", f"{XSD}boolean"), True), "e": ("<urn:z>", "urn:z")}
    quads = [(f"<urn:{n}>", TYPE, "<urn:C>", None) for n in [*values, "f"]] + [(f"<urn:{n}>", "<urn:v>", term, None) for n, (term, _) in values.items()]
    store = Store(spark, f"{tmp_path}/s")
    store.insert(spark.createDataFrame(quads, "s string, p string, o string, g string"))
    kind = events.EventType("<urn:C>", "Made", "1", "SELECT ?e ?v { ?e <urn:v> ?v }", "e", {"v": ("v", True), "again": ("v", False)})
    got = {r["node"][5:-1]: r for r in events.render(spark, store, [kind], 0, 1).collect()}
    assert [got[n]["ordinal"] for n in "abcdef"] == [1, 2, 3, 4, 5, 6] and got["f"]["problem"] == "0 rows"
    assert {n: json.loads(r["event"])["data"] for n, r in got.items() if n != "f"} == {n: {"v": x, "again": x} for n, (_, x) in values.items()}

"""Files cut into pieces, documents, changes of kept tables, closures over cycles, and texts, on small hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.tables import semi_join, write_table
from lexiloom.operators import closure, degrees, entity, mentions, search, taxonomy
from lexiloom.plans import exchange
from lexiloom.plans.lower import Lowering
from lexiloom.plans.parser import parse
from lexiloom.plans.registry import ex
from lexiloom.sources import documents, tables, turtle
from lexiloom.sources.relational import view_triples

TURTLE = """@prefix x: <http://x/> .
@base <http://b/> .
# a comment that ends in a stop .
x:a x:p "one.\\n" , 'two' ; x:q [ x:r 1.5 , [ x:r true ] ] .
x:long x:p \"\"\"a text with a stop .
and \\\\\" "quotes" .
\"\"\" .
<rel> x:p _:n-1 . # done .
x:c x:l ( 1 x:b ) ; x:note '''it's .
''' .
PREFIX x: <http://y/>
x:a x:p _:n-1 .
"""


def sets(df):
    return {tuple(r) for r in df.collect()}


def unlabelled(triples):
    """Triples with the blank nodes numbered by how they are reached, so that two readings can be compared."""
    names = {}
    out = list(triples)
    for _ in range(6):
        out = [tuple(names.get(x, x) for x in t) for t in out]
        for s, p, o in sorted(out, key=lambda t: [x if not x.startswith("_:") else "" for x in t]):
            if o.startswith("_:") and not s.startswith("_:") and o not in names.values():
                names.setdefault(o, f"via {s} {p}")
    return {t for t in out}


def test_turtle_in_pieces(spark, tmp_path):
    """Whatever the size of the splits, a file says what the parser says of its whole text."""
    (tmp_path / "a.ttl").write_text(TURTLE)
    want = set(turtle.parse_turtle(TURTLE))
    assert len(want) == 15
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    shape = lambda ts: sorted(tuple("_" if x.startswith("_:") else x for x in t) for t in ts)
    try:
        for size in ("40", "64", "90", "1000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = sets(turtle.read_turtle(spark, str(tmp_path / "a.ttl")))
            assert shape(got) == shape(want), size
            assert len({x for t in got for x in t if x.startswith("_:")}) == len({x for t in want for x in t if x.startswith("_:")})
            # the label is one node in the file, in both of its statements
            assert len({o for s, p, o in got if s in ("<http://b/rel>", "<http://y/a>")}) == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_turtle_files_have_their_own_nodes_and_prefixes(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix p: <http://1/> .\np:s p:p _:x .\n")
    (tmp_path / "b.ttl").write_text("@prefix p: <http://2/> .\np:s p:p _:x . p:s p:p")
    with pytest.raises(Exception, match="unexpected"):
        turtle.read_turtle(spark, str(tmp_path)).collect()
    (tmp_path / "b.ttl").write_text("@prefix p: <http://2/> .\r\np:s p:p _:x")  # a last stop may be missing
    got = sets(turtle.read_turtle(spark, str(tmp_path)))
    assert {s for s, _, _ in got} == {"<http://1/s>", "<http://2/s>"} and len({o for _, _, o in got}) == 2
    (tmp_path / "empty.ttl").write_text("")
    assert turtle.read_turtle(spark, str(tmp_path / "empty.ttl")).count() == 0


RDF_XML = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:x="http://x/" xml:lang="da">
  <x:Kind rdf:about="http://x/a" x:short="s"><x:label>Hund &amp; kat</x:label><x:n rdf:datatype="http://d">1</x:n><x:to rdf:resource="http://x/b"/></x:Kind>
  <rdf:Description rdf:about="http://x/c"><x:in><rdf:Description><x:label xml:lang="en">inner</x:label></rdf:Description></x:in><x:bag><rdf:Bag><rdf:li>one</rdf:li><rdf:li>two</rdf:li></rdf:Bag></x:bag></rdf:Description>
  <rdf:Description rdf:nodeID="k"><x:list rdf:parseType="Collection"><rdf:Description rdf:about="http://x/a"/></x:list><x:r rdf:parseType="Resource"><x:v>2</x:v></x:r></rdf:Description>
</rdf:RDF>
"""


def test_rdf_xml(spark, tmp_path):
    (tmp_path / "a.rdf").write_text(RDF_XML)
    (tmp_path / "b.owl").write_text(RDF_XML)
    (tmp_path / "c.nt").write_text("<http://x/a> <http://x/to> <http://x/b> .\n")
    got = sets(turtle.read_rdf(spark, [str(tmp_path / n) for n in ("a.rdf", "b.owl", "c.nt")]))
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    named = {t for t in got if not any(x.startswith("_:") for x in t)}
    assert named == {
        ("<http://x/a>", f"<{rdf}type>", "<http://x/Kind>"), ("<http://x/a>", "<http://x/short>", '"s"@da'), ("<http://x/a>", "<http://x/label>", '"Hund & kat"@da'),
        ("<http://x/a>", "<http://x/n>", '"1"^^<http://d>'), ("<http://x/a>", "<http://x/to>", "<http://x/b>"),
    }
    by = {}
    for s, p, o in got - named:
        by.setdefault(p, set()).add((s, o))
    assert {o for s, o in by[f"<{rdf}_2>"]} == {'"two"@da'} and len(by[f"<{rdf}_2>"]) == 2  # a node for each file
    assert {o for s, o in by["<http://x/label>"]} == {'"inner"@en'}
    (first,) = {o for s, o in by[f"<{rdf}first>"]}
    assert first == "<http://x/a>" and {o for s, o in by["<http://x/v>"]} == {'"2"@da'}


@pytest.mark.parametrize(
    ("body", "problems"),
    [
        ('<entry id="a"><sense id="b"/></entry><r><member ref="b"/></r>', []),
        ('<r><member ref="b"/></r><entry id="b"></entry>', []),  # a reference forward
        ('<entry id="a"/><sense id="a"/>', [("repeated id", "a", 2)]),
        ('<r><member ref="x"/><member ref="x"/></r>', [("reference to nothing", "x", 2)]),
        ('<!-- <entry id="a"> > --><entry id="a" note="1 > 0"/>', []),
        ('<![CDATA[<entry id="a">]]><entry id="a"/>', []),
        ('<entry id="a"><b></entry></b>', [("malformed", None, None)]),
        ('<entry id="a">', [("malformed", None, None)]),
        ('</r><entry id="a"/>', [("malformed", None, None)]),
        ('<entry id="a', [("malformed", None, None)]),
    ],
)
def test_identity_of_documents(spark, tmp_path, body, problems):
    (tmp_path / "d.xml").write_text(f'<?xml version="1.0"?>\n<res lang="da">\n{body}\n</res>\n')
    found = documents.identity_problems(documents.xml_tags(spark, str(tmp_path / "d.xml")), ["entry", "sense"], "member")
    assert [(r["problem"], r["id"], None if r["problem"] == "malformed" else r["n"]) for r in found.collect()] == problems


def test_documents_in_small_splits(spark, tmp_path):
    """Elements that nest over many splits of a file are put together in order."""
    body = "".join(f'<entry id="e{i}"><a><b>text {i}</b></a></entry>' for i in range(60))
    (tmp_path / "good.xml").write_text(f"<res>{body}</res>")
    (tmp_path / "bad.xml").write_text(f"<res>{body.replace('</b></a></entry>', '</a></b></entry>', 1)}</res>")
    (tmp_path / "two.xml").write_text(f"<res>{body}</res><res></res>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        tags = documents.xml_tags(spark, str(tmp_path))
        assert tags.select("block").distinct().count() > 10
        assert {r["file"].rsplit("/", 1)[1] for r in documents.malformed(tags).collect()} == {"bad.xml", "two.xml"}
        items = documents.xml_items(spark, str(tmp_path / "good.xml"), "entry", lambda text: [text[11:14]])
        assert items.count() == 60
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_document_in_parts(spark, tmp_path):
    rows = spark.range(500).select("id", F.concat(F.lit("row "), "id").alias("text"))
    documents.write_document(rows.repartition(7), "id", "text", str(tmp_path / "d"), "head", "foot")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "d").glob("part-*"))).splitlines()
    assert lines == ["head", *(f"row {i}" for i in range(500)), "foot"]


# --- closures

def brute_reach(edges):
    out = {}
    for s, d in edges:
        out.setdefault(s, set()).add(d)
    reach = {}
    for n in {x for e in edges for x in e}:
        seen, todo = set(), [n]
        while todo:
            for m in out.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        reach[n] = seen
    return out, reach


def simple_climb(out, n, path):
    return max((1 + simple_climb(out, m, path | {m}) for m in out.get(n, ()) if m not in path), default=0)


@pytest.mark.parametrize("few", [0, 1000])
@pytest.mark.parametrize("seed", [1, 2])
def test_closures_of_random_graphs(spark, few, seed):
    """Cycles, self-loops and what leads into and out of them, by tasks and by rounds, against plain searches."""
    rng = random.Random(seed)
    edges = sorted({(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(11)} | {(f"t{i}", f"t{i // 2}") for i in range(2, 20)} | {("n1", "t5"), ("t19", "n2"), ("n0", "n0")})
    df = spark.createDataFrame(edges, "src string, dst string")
    out, reach = brute_reach(edges)
    assert sets(closure.reachable(df, few=few)) == {(a, b) for a, bs in reach.items() for b in bs}
    want = {n: len(bs - {n}) for n, bs in reach.items() if bs - {n}}
    assert dict(sets(closure.reach_counts(df, few=few, block=4))) == want
    same = {n: k for n, bs in reach.items() if (k := len({b for b in bs - {n} if b[0] == n[0]}))}
    assert dict(sets(closure.reach_counts(df, group="^.", few=few, block=4))) == same
    depths = {n: max(1 + simple_climb(out, d, frozenset((d,))) for d in ds) for n, ds in out.items()}
    assert dict(sets(closure.longest_depths(df, few=few))) == depths
    assert {(n, m) for n, m, d in sets(closure.distances(df, few=few)) if d} == {(a, b) for a, bs in reach.items() for b in bs - {a} if a in out}


def test_large_graphs_are_settled_by_levels(spark, monkeypatch):
    """What the seeds don't lead to is left out, an acyclic graph needs no search by rounds, and long lists are split."""
    edges = [(f"t{i}", f"t{i // d}") for i in range(1, 40) for d in (2, 3) if i // d != i]
    df = spark.createDataFrame(edges, "src string, dst string")
    monkeypatch.setattr(closure, "LIST_ROW", 4)
    _, reach = brute_reach(edges)
    lists, left = closure._lists(closure._clean(df), 100)
    assert left.isEmpty() and lists.count() > lists.select("node").distinct().count()
    near = {(n, a): d for n, a, d in sets(closure._walk(closure._clean(df), df.select(F.col("src").alias("node")).distinct()))}
    assert {(n, a): d for n, a, d in sets(closure.distances(df, few=0))} == near
    few = closure._ahead(closure._clean(df), spark.createDataFrame([("t5",)], "node string"))
    assert {s for s, _ in sets(few)} == {"t5", "t2", "t1"}
    assert sets(closure.reachable(df, spark.createDataFrame([("t7",)], "node string"), few=0)) == {("t7", b) for b in reach["t7"]}


def test_large_cycles_are_refused(spark):
    ring = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 20}") for i in range(20)], "src string, dst string")
    with pytest.raises(Exception, match="cyclic component of 20"):
        closure.longest_depths(ring).collect()
    assert set(dict(sets(closure.reach_counts(ring))).values()) == {19}


def grown(children, root, max_depth, max_children, max_nodes):
    """The soft budget, one node after the other."""
    used, out = 0, []

    def grow(node, depth, path, place):
        nonlocal used
        used += 1
        out.append((place, node, depth))
        if depth >= max_depth or used >= max_nodes:
            return
        for k, c in enumerate([c for c in children.get(node, ()) if c not in path][:max_children]):
            grow(c, depth + 1, path | {c}, f"{place}.{k:02d}")

    grow(root, 0, frozenset((root,)), "")
    return set(out)


@pytest.mark.parametrize("budget", [1, 2, 7, 30, 250])
def test_bounded_tree(spark, budget):
    rng = random.Random(budget)
    children = {f"n{i}": [f"n{j}" for j in rng.sample(range(60), rng.choice([0, 1, 3, 14]))] for i in range(60)}
    rows = [(a, b, k + 1) for a, bs in children.items() for k, b in enumerate(bs)]
    got = taxonomy.bounded_tree(spark.createDataFrame(rows, "parent string, child string, pos int"), "n0", max_depth=4, max_nodes=budget)
    assert sets(got) == grown(children, "n0", 4, 12, budget)


# --- nested nodes, results, texts

def test_blank_node_trees(spark):
    t = spark.createDataFrame(
        [("<a>", "<p>", "_:1"), ("_:1", "<q>", "_:2"), ("_:1", "<q>", '"x"'), ("_:2", "<q>", "_:3"), ("_:3", "<v>", '"deep"'), ("_:x", "<q>", "_:y"), ("_:y", "<q>", "_:x"), ("_:z", "<q>", "_:x"), ("_:z", "<v>", "_:3"), ("_:e", "<q>", "_:nothing")],
        "s string, p string, o string",
    )
    got = {r["node"]: (r["entity"], r["depth"]) for r in entity.blank_node_trees(t).collect()}
    assert got["_:1"] == ('[ <q> "x", [ <q> [ <v> "deep" ] ] ]', 2) and got["_:e"] == ("[ <q> _:nothing ]", 0)
    assert got["_:x"][0] == "[ <q> _:y ]" and got["_:z"][0] == '[ <q> _:x ; <v> [ <v> "deep" ] ]'
    assert entity.blank_node_trees(t.limit(0)).count() == 0


def test_enriched_results_are_bounded(spark):
    t = spark.createDataFrame([("<a>", "<l>", '"A"'), ("<a>", "<m>", '"0"'), ("<b>", "<m>", '"B"'), ("_:n", "<v>", '"1"')], "s string, p string, o string")
    result = spark.createDataFrame([("<a>", "_:n", 1), ("<b>", None, 2), ("<c>", '"text"', 3)], "x string, y string, z int")
    assert sets(entity.enriched(result, t, ["<l>", "<m>"])) == {("<a>", '"A"', None), ("<b>", '"B"', None), ("<c>", None, None), ("_:n", None, '[ <v> "1" ]')}
    assert sets(entity.enriched(result, t, ["<l>", "<m>"], most=2)) == {("<a>", None, None), ("<b>", None, None), ("<c>", None, None), ("_:n", None, '[ <v> "1" ]')}


def test_paths_under_a_graph_variable(spark):
    q = spark.createDataFrame([("<g>", "<a>", "<p>", "<b>"), ("<g>", "<b>", "<p>", '"c d"'), ("<h>", "<b>", "<p>", "<z>")], "g string, s string, p string, o string")
    run = lambda text: sets(Lowering(q.select("s", "p", "o"), q).run(parse(text)))
    assert run("SELECT ?g ?x ?y WHERE { GRAPH ?g { ?x <p>+ ?y } }") == {("<g>", "<a>", "<b>"), ("<g>", "<b>", '"c d"'), ("<g>", "<a>", '"c d"'), ("<h>", "<b>", "<z>")}
    assert run("SELECT ?g ?y WHERE { GRAPH ?g { <b> <p>* ?y } }") == {("<g>", "<b>"), ("<g>", '"c d"'), ("<h>", "<b>"), ("<h>", "<z>")}


def brute_mentions(text, lemmas):
    low, out, at = text.lower(), [], 0
    order = sorted({x.lower() for x in lemmas if x}, key=len, reverse=True)
    while at < len(low):
        hit = next((x for x in order if low.startswith(x, at) and not (at and low[at - 1].isalpha())), None)
        if hit is None:
            at += 1
            continue
        end = at + len(hit)
        while end < len(low) and low[end].isalpha():
            end += 1
        out.append((at, end, hit))
        at = end
    return out


@pytest.mark.parametrize("most", [3, 500_000])
def test_lemma_mentions(spark, most):
    """Overlapping lemmas, endings, capitals and letters before, with the list in one part and in several."""
    rng = random.Random(4)
    lemmas = ["ab", "abc", "abc d", "d", "b", "Øl", "øl på", "a", "", "x y z", "y", "İ"]
    texts = ["".join(rng.choice("abcd xyzØLå-.İ") for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "abc d abc", "øl PÅ fad"]
    rows = spark.createDataFrame(list(enumerate(texts)), "found int, text string")
    got = {r["found"]: [tuple(m) for m in r["mentions"]] for r in mentions.lemma_mentions(rows, spark.createDataFrame([(x,) for x in lemmas], "lemma string"), most=most).collect()}
    for i, t in enumerate(texts):
        if "İ" not in (t or ""):
            assert got[i] == brute_mentions(t or "", [x for x in lemmas if x != "İ"]), t
    assert mentions.lemma_mentions(rows, spark.createDataFrame([], "lemma string")).where(F.size("mentions") > 0).count() == 0


def test_stored_completions(spark, tmp_path):
    words = [f"{a}{b}" for a in "abcå" for b in ("", "a", "b￿", "zz")]
    index = spark.createDataFrame([(w, w.upper()) for w in words], "key string, form string")
    search.write_completions(index, str(tmp_path / "i"))
    stored = spark.read.parquet(str(tmp_path / "i"))
    for prefix in (" B", "å", "zz", "", "b￿"):
        assert sets(search.autocomplete(stored, prefix)) == sets(search.autocomplete(index, prefix)) == {(w, w.upper()) for w in words if prefix.strip() and w.startswith(prefix.strip().lower())}
    plan = search.autocomplete(stored, "b")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(first" in plan and "GreaterThanOrEqual(key,b)" in plan


def test_degrees_of_missing_table(spark, tmp_path):
    assert degrees.read_degrees(spark, str(tmp_path / "none")).count() == 0


def test_degrees_after_changes(spark, tmp_path):
    """Random additions and removals, of types too, against a recount."""
    rng = random.Random(6)
    triple = lambda: rng.choice([(f"<{rng.randrange(12)}>", "<r>", f"<{rng.randrange(12)}>"), (f"<{rng.randrange(12)}>", "<a>", "<C>")])
    frame = lambda rows: spark.createDataFrame(sorted(rows), "s string, p string, o string")
    t = frame({triple() for _ in range(60)})
    path = str(tmp_path / "d")
    degrees.save_degrees(taxonomy.indegree(t, "<a>", "<C>"), path)
    for _ in range(3):
        gone = [(f"<{rng.randrange(12)}>", rng.choice([None, "<r>", "<a>"]), None) for _ in range(2)]
        t = degrees.update_with_degrees(path, t, frame({triple() for _ in range(9)}), spark.createDataFrame(gone, "s string, p string, o string"), "<a>", "<C>")
        assert sets(degrees.read_degrees(spark, path)) == sets(taxonomy.indegree(t, "<a>", "<C>"))


def test_classes_are_counted_before_they_are_joined(spark):
    """A class that most statements name is one row of the join on objects, not a task of its own."""
    t = spark.createDataFrame([(f"<{i}>", "<a>", "<C>") for i in range(50)] + [("<1>", "<r>", "<2>"), ("<3>", "<r>", "<2>"), ("<C>", "<a>", "<C>")], "s string, p string, o string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = taxonomy.indegree(t, "<a>", "<C>")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("LeftSemi") < plan.index("Aggregate [o")
        assert sets(found) == {("<2>", 2), ("<C>", 51)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_semi_join_with_frequent_values(spark):
    data = [("hot", i) for i in range(3000)] + [("warm", i) for i in range(20)] + [(f"v{i}", i) for i in range(2000)] + [(None, 1)]
    rows = write_table(spark.createDataFrame(data, "k string, i long").repartition(3), "rows")
    for wanted in (["hot", "v7"], ["warm", "v1999", "none"], ["v3"], []):
        members = spark.createDataFrame([(w,) for w in wanted], "c string")
        assert sorted(map(tuple, semi_join(rows, "k", members).collect())) == sorted(r for r in data if r[0] in wanted)


def test_store_replaces_a_graph(spark, tmp_path):
    path = str(tmp_path / "q")
    tables.write_quads(spark.createDataFrame([("<g>", "<a>", "<p>", "<b>"), ("<g>", "<a>", "<q>", "<b>"), ("<h>", "<a>", "<p>", "<b>")], tables.QUADS), path)
    tables.write_quads(spark.createDataFrame([("<g>", "<z>", "<q>", "<b>")], tables.QUADS), path, replace=True)
    assert sets(tables.read_quads(spark, path).select("g", "s", "p")) == {("<g>", "<z>", "<q>"), ("<h>", "<a>", "<p>")}


# --- plain statements and elements, told without the parsers

def test_plain_statements_read_as_the_parser_reads_them():
    texts = [
        'ex:a ex:p "x"@en , <http://a/b#c> ;\n   rdf:type ex:B .\n', 'ex:a ex:p "5"^^xsd:integer, "6"^^<http://q/r> .', 'ex:a ex:p "a^^b", "c@d" .', '<http://x/y> ex:p ex:q, ex:r; ex:s "e, ; . x" .\n',
    ]
    for text in texts:
        assert turtle.ends_statement(text)
        assert turtle.plain_statement(text, turtle.Names({})) == turtle.parse_turtle(text)
    for text in ('ex:a ex:p "" .', "ex:a ex:p 5 .", 'ex:a ex:p "x" . ex:b ex:q ex:c .', "ex:a a ex:b .", "_:a ex:p ex:q .", 'ex:a ex:p "a\\"b" .', "ex:a ex:p ex:b.c ."):
        assert turtle.plain_statement(text, turtle.Names({})) is None


def test_rdf_xml_is_read_by_many_tasks(spark, tmp_path):
    """A document is cut under its root, nested and typed elements whole; one in another encoding is read too."""
    head = '<?xml version="1.0"?>\n<!DOCTYPE rdf:RDF [<!ENTITY e "http://e/">]>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:v="http://v/" xml:lang="da">\n'
    described = lambda i: f'<rdf:Description rdf:about="&e;{i}"><v:n>{i} &lt; x</v:n><v:in><rdf:Description><v:deep>{i}</v:deep></rdf:Description></v:in>\n</rdf:Description>\n'
    typed = lambda i: f'<v:Kind rdf:about="&e;k{i}"><v:n>{i}</v:n><v:x rdf:parseType="Resource"><v:y>{i}</v:y></v:x></v:Kind><!-- > </v:Kind> -->\n'
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for name, made, per in (("one", described, 3), ("two", typed, 4)):
            path = tmp_path / f"{name}.rdf"
            path.write_text(head + "".join(made(i) for i in range(300)) + "</rdf:RDF>\n")
            got = turtle.read_rdf_xml(spark, str(path))
            rows = sets(got)
            assert len(rows) == 300 * per
            assert len({s for s, _, _ in rows if s.startswith("_:")}) == 300
            assert ("<http://e/7>" if name == "one" else "<http://e/k7>", "<http://v/n>", '"7 < x"@da' if name == "one" else '"7"@da') in rows
            end = turtle._separator(spark, str(path))
            assert end == ("</rdf:Description>" if name == "one" else ">")
            cut = turtle.pieces(spark, str(path), end, turtle.ends_element)
            assert cut.select("block").distinct().count() > 1 or name == "one"  # where a split ends inside an element its file is put together
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    other = tmp_path / "three.rdf"
    other.write_bytes((head.replace('"1.0"', '"1.0" encoding="ISO-8859-1"') + '<rdf:Description rdf:about="&e;1"><v:n>\u00e6</v:n></rdf:Description></rdf:RDF>').encode("latin-1"))
    assert sets(turtle.read_rdf_xml(spark, str(other))) == {("<http://e/1>", "<http://v/n>", '"\u00e6"@da')}


def test_rdf_xml_roundtrip_writes_the_whole_view(spark, monkeypatch):
    """Every statement of the view goes into the document and comes back, its largest predicate too."""
    folder, read = "/root/testdata/sf0.001", []
    plain = turtle.read_rdf_xml
    monkeypatch.setattr(turtle, "read_rdf_xml", lambda spark, path: read.append(plain(spark, path)) or read[-1])
    out = exchange.rdf_xml_roundtrip(spark, folder)
    whole = view_triples(spark, folder, dictionary=True)
    supplies = F.col("p") == ex("supplies")
    assert read[0].where(supplies).count() == whole.where(supplies).count() > 0
    assert read[0].count() == whole.count() and out.count() == whole.where(~supplies).count()

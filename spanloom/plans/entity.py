"""NER, entity, relation and graph queries; names come from part, intervals and sentences from lineitem."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.functions.names import initials, is_token_subset, jaro_winkler
from spanloom.functions.text import name_tokens, normalize_name
from spanloom.operators import answers, components, entities, graph, ner, relations
from spanloom.plans.base import load, registrar, rounded, sql_values, values
from spanloom.schemas import node_label, relationship_type

QUERIES, ORACLE_SQL, register = registrar()

NORM = r"regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[''’]s($|[^\p{{L}}\p{{N}}])', '\1', 'g'), '[^\p{{L}}\p{{N}}& ]+', ' ', 'g'), ' +', ' ', 'g')), '^the ', '')"


def norm(x: str) -> str:
    return NORM.format(x=x)


@register("""
    WITH p AS (SELECT l_orderkey, l_linenumber, [l_discount, l_tax * 2, 0.3, greatest(0, 0.7 - l_discount - l_tax * 2)] AS p FROM lineitem), e AS (SELECT *, 1 - p[4] AS pe FROM p)
    SELECT l_orderkey, l_linenumber, round(pe, 6) AS p_entity, CASE WHEN pe >= 0.5 THEN CASE WHEN p[1] >= p[2] AND p[1] >= p[3] THEN 'person' WHEN p[2] >= p[3] THEN 'place' ELSE 'date' END END AS type FROM e""")
def tag_decision(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem")
    a, b, c = F.col("l_discount"), F.col("l_tax") * 2, F.lit(0.3)
    d = F.greatest(F.lit(0.0), F.lit(0.7) - F.col("l_discount") - F.col("l_tax") * 2)
    probs = F.array(*(F.struct(F.lit(t).alias("type"), p.alias("p")) for t, p in (("person", a), ("place", b), ("date", c), ("none", d))))
    return rounded(answers.tag_decision(l.select("l_orderkey", "l_linenumber", probs.alias("probs"))).drop("probs"))


@register("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax * 12 >= 0.7 THEN 'accepted' ELSE 'review' END AS status FROM lineitem WHERE l_tax * 12 >= 0.4")
def review_status(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").withColumn("confidence", F.col("l_tax") * 12).where(F.col("confidence") >= ner.REVIEW)
    return l.select("l_orderkey", "l_linenumber", ner.status_for(F.col("confidence")).alias("status"))


@register("""
    WITH t AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS i, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS type, l_discount AS p FROM lineitem),
    f AS (SELECT *, coalesce(lag(type) OVER w = type, false) AS j FROM t WINDOW w AS (PARTITION BY l_suppkey ORDER BY i)),
    g AS (SELECT *, sum(CASE WHEN j THEN 0 ELSE 1 END) OVER (PARTITION BY l_suppkey ORDER BY i) AS isl FROM f WHERE type IS NOT NULL)
    SELECT l_suppkey AS doc_id, type, CAST(min(i) AS INTEGER) AS tok_from, CAST(max(i) AS INTEGER) AS tok_to, round(avg(p), 6) AS score FROM g GROUP BY l_suppkey, isl, type""")
def span_islands(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem")
    i = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))
    t = l.select(F.col("l_suppkey").alias("doc_id"), F.lit("c0000").alias("chunk_id"), F.lit(0).alias("sent_idx"), i.alias("tok_idx"), F.concat(F.lit("w"), i.cast("string")).alias("text"), F.lit("word").alias("kind"), (i * 10).alias("start"), (i * 10 + 9).alias("end"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("type"), F.col("l_discount").alias("p"))
    return rounded(ner.span_islands(t).select("doc_id", "type", "tok_from", "tok_to", "score"))


@register("""
    WITH o(ord, a, b) AS (VALUES (0, 0, 0), (1, 0, 1), (2, 0, 2), (3, -1, 0), (4, -1, 1), (5, -1, 2), (6, -2, 0), (7, -2, 1), (8, -2, 2), (9, 0, -1), (10, 0, -2), (11, 1, 0), (12, 1, -1), (13, 1, -2), (14, 2, 0), (15, 2, -1), (16, 2, -2)),
    n AS (SELECT l_orderkey AS d, count(*) AS n FROM lineitem GROUP BY 1),
    c AS (SELECT d, ord, 2 + a AS f, 3 + b AS t FROM n, o WHERE n >= 3)
    SELECT n.d AS doc_id, CAST(min(ord) AS INTEGER) AS ord, CAST(f AS INTEGER) AS c_from, CAST(t AS INTEGER) AS c_to, (SELECT string_agg('w' || lpad(CAST(x AS VARCHAR), 2, '0'), ' ' ORDER BY x) FROM range(CAST(f AS BIGINT), CAST(t + 1 AS BIGINT)) r(x)) AS text FROM c JOIN n USING (d) WHERE f >= 1 AND t <= n AND f <= t GROUP BY n.d, f, t""")
def boundary_candidates(spark, sf_dir):
    """Lines of an order as the words of a sentence, lines 2 and 3 as its span."""
    l = load(spark, sf_dir, "lineitem")
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    t = l.select(F.col("l_orderkey").alias("doc_id"), F.lit("c0000").alias("chunk_id"), i.alias("tok_idx"), F.lit(0).alias("sent_idx"), F.concat(F.lit("w"), F.lpad(i.cast("string"), 2, "0")).alias("text"), F.lit("word").alias("kind"), (4 * (i - 1)).alias("start"), (4 * i - 1).alias("end"))
    docs = t.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text"))
    s = t.groupBy("doc_id", "chunk_id").agg(F.max("tok_idx").alias("n")).where("n >= 3").select("doc_id", "chunk_id", F.lit(0).alias("span_id"), F.lit(0).alias("sent_idx"), F.lit(2).alias("tok_from"), F.lit(3).alias("tok_to"))
    return ner.boundary_candidates(s, t, docs).select("doc_id", "ord", "c_from", "c_to", "text")


@register("""
    WITH RECURSIVE i AS (SELECT l_orderkey AS k, l_partkey * 10 + l_linenumber AS ord, l_partkey % 100 AS s, l_partkey % 100 + CAST(l_quantity AS BIGINT) AS e, l_discount * 10 AS c FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN c < 0.7 THEN 1 ELSE 0 END, s - e, -c, ord) AS rn FROM i),
    f AS (SELECT k, rn, [struct_pack(s := s, e := e, o := ord, c := c)] AS kept FROM r WHERE rn = 1
          UNION ALL SELECT f.k, r.rn, CASE WHEN len(list_filter(f.kept, lambda x: x.s < r.e AND x.e > r.s)) > 0 THEN f.kept ELSE list_append(f.kept, struct_pack(s := r.s, e := r.e, o := r.ord, c := r.c)) END
          FROM f JOIN r ON r.k = f.k AND r.rn = f.rn + 1),
    l AS (SELECT k, kept FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY rn DESC) = 1), u AS (SELECT k, unnest(kept) AS x FROM l)
    SELECT k AS l_orderkey, CAST(row_number() OVER (PARTITION BY k ORDER BY x.s, x.e, x.o) - 1 AS INTEGER) AS idx, x.o AS ord, x.s AS "start", x.e AS "end", round(x.c, 6) AS confidence FROM u""")
def drop_overlaps(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem")
    items = l.select("l_orderkey", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ord"), (F.col("l_partkey") % 100).alias("start"), (F.col("l_partkey") % 100 + F.col("l_quantity").cast("long")).alias("end"), (F.col("l_discount") * 10).alias("confidence"))
    return rounded(ner.drop_overlaps(items, ["l_orderkey"]))


ANSWERS = [("a", "x", "x", 0.9), ("b", " y ", "y", 0.8), ("c", "foreign", None, 0.7), ("d", None, None, None), ("e", "y", "y", 0.1), ("f", "none", "none", 1.4)]


@register("""SELECT * FROM (VALUES ('a', 'x', 0.9, 'exact'), ('b', 'y', 0.8, 'trimmed'), ('c', 'none', 1.0, 'invalid'), ('d', 'none', 1.0, 'missing'), ('e', 'y', round(1 / 3, 6), 'exact'), ('f', 'none', 1.0, 'exact')) t(q_id, choice, p, status)""")
def answer_convert(spark, sf_dir):
    df = values(spark, [(q, a, c) for q, a, _, c in ANSWERS], "q_id string, answer string, confidence double").withColumn("options", F.array(F.lit("x"), F.lit("y"), F.lit("none")))
    return rounded(answers.convert_answers(df).select("q_id", "choice", "p", "status"))


@register(" UNION ALL ".join(f"SELECT '{t}' AS tbl, {c} AS name, {norm(c)} AS normalized FROM {t}" for t, c in (("customer", "c_name"), ("part", "p_name"), ("nation", "n_name"))))
def normalize_names(spark, sf_dir):
    parts = [load(spark, sf_dir, t).select(F.lit(t).alias("tbl"), F.col(c).alias("name"), normalize_name(F.col(c)).alias("normalized")) for t, c in (("customer", "c_name"), ("part", "p_name"), ("nation", "n_name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def nodes_of(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    m = p.select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("mention_id"), F.col("p_type").alias("type"), F.when(F.col("p_partkey") % 2 == 0, F.initcap("p_name")).otherwise(F.col("p_name")).alias("text"), F.col("p_size").cast("string").alias("context"))
    return entities.name_nodes(m, ["doc_id"])


MENTIONS = f"SELECT p_brand AS doc_id, p_partkey AS ord, p_type AS type, CASE WHEN p_partkey % 2 = 0 THEN {{initcap}} ELSE p_name END AS text, CAST(p_size AS VARCHAR) AS context FROM part"
INITCAP = "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')"
NODES = f"WITH m AS (SELECT *, {norm('text')} AS normalized FROM ({MENTIONS.format(initcap=INITCAP)}))"


@register(f"""
    {NODES}, s AS (SELECT doc_id, type, normalized, text, count(*) AS n, min(ord) AS f FROM m GROUP BY ALL),
    c AS (SELECT doc_id, type, normalized, context, min(ord) AS f FROM m GROUP BY ALL), cr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type, normalized ORDER BY f, context) AS rn FROM c),
    sr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type, normalized ORDER BY n DESC, f) AS rn FROM s),
    cs AS (SELECT doc_id, type, normalized, string_agg(context, ',' ORDER BY rn) AS contexts FROM cr WHERE rn <= 2 GROUP BY ALL)
    SELECT m.doc_id, m.type, m.normalized, count(*) AS mentions, any_value(sr.text) AS surface, any_value(cs.contexts) AS contexts
    FROM m JOIN sr ON sr.doc_id = m.doc_id AND sr.type = m.type AND sr.normalized = m.normalized AND sr.rn = 1 LEFT JOIN cs ON cs.doc_id = m.doc_id AND cs.type = m.type AND cs.normalized = m.normalized
    GROUP BY m.doc_id, m.type, m.normalized""")
def name_nodes(spark, sf_dir):
    n = nodes_of(spark, sf_dir)
    return n.select("doc_id", "type", "normalized", "mentions", entities.most_common_surface(F.col("surfaces")).alias("surface"), F.array_join("contexts", ",").alias("contexts"))


BRAND_NAMES = "SELECT DISTINCT p_brand, p_name FROM part"


@register(f"""
    WITH n AS ({BRAND_NAMES} UNION SELECT DISTINCT p_brand, split_part(p_name, ' ', 1) FROM part), t AS (SELECT p_brand, p_name, string_split(p_name, ' ') AS t FROM n)
    SELECT a.p_brand, a.p_name AS a, b.p_name AS b FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_name <> b.p_name AND len(a.t) < len(b.t) AND len(list_filter(a.t, lambda x: length(x) > 1)) > 0 AND len(list_filter(a.t, lambda x: NOT list_contains(b.t, x))) = 0""")
def pair_subset(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    n = p.select("p_brand", "p_name").union(p.select("p_brand", F.split("p_name", " ")[0])).distinct().withColumn("t", name_tokens(F.col("p_name")))
    w = n.withColumn("w", F.explode(F.array_distinct("t")))
    a, b = w.select("p_brand", "w", F.col("p_name").alias("a"), F.col("t").alias("ta")), w.select("p_brand", "w", F.col("p_name").alias("b"), F.col("t").alias("tb"))
    return a.join(b, ["p_brand", "w"]).where(is_token_subset(F.col("ta"), F.col("tb"))).select("p_brand", "a", "b").distinct()


#: Part names as documents have them: each brand's names, and the initials of some of them, with dots for the odd parts.
ACRONYM_NAMES = """
    SELECT p_brand AS doc_id, p_partkey AS ord, 'x' AS type, p_name AS text FROM part
    UNION ALL SELECT p_brand, p_partkey + 1000000000, 'x', CASE WHEN p_partkey % 2 = 0 THEN upper(i) ELSE upper(regexp_replace(i, '(.)', '\\1.', 'g')) END FROM (SELECT *, {initials} AS i FROM part)"""


def acronym_nodes(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    short = F.upper(initials(name_tokens(F.col("p_name"))))
    m = p.select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("text")).unionByName(
        p.select(F.col("p_brand").alias("doc_id"), (F.col("p_partkey") + 1000000000).alias("ord"), F.when(F.col("p_partkey") % 2 == 0, short).otherwise(F.regexp_replace(short, "(.)", "$1.")).alias("text")))
    return entities.name_nodes(m.withColumns({"type": F.lit("x"), "mention_id": F.col("ord"), "context": F.lit(None).cast("string")}), ["doc_id"])


@register(f"""
    WITH m AS (SELECT doc_id, {norm('text')} AS n FROM ({ACRONYM_NAMES.format(initials="list_reduce(list_transform(string_split(p_name, ' '), lambda x: x[1]), lambda x, y: x || y)")})),
    n AS (SELECT DISTINCT doc_id, n, regexp_replace(n, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS letters, list_filter(string_split(n, ' '), lambda x: x <> '') AS t FROM m WHERE n <> '')
    SELECT a.doc_id, a.n AS short, b.n AS long FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.n <> b.n AND length(a.letters) >= 2 AND len(b.t) >= 2 AND a.letters = list_reduce(list_transform(b.t, lambda x: x[1]), lambda x, y: x || y)""")
def pair_acronym(spark, sf_dir):
    return entities.acronym_pairs(acronym_nodes(spark, sf_dir), ["doc_id"]).select("doc_id", F.col("normalized_a").alias("short"), F.col("normalized_b").alias("long"))


@register()
def pair_similar(spark, sf_dir):
    pairs = entities.similar_pairs(nodes_of(spark, sf_dir), ["doc_id"])
    return pairs.select("doc_id", "type", F.col("left.name").alias("a"), F.col("right.name").alias("b"), F.round(jaro_winkler("left.name", "right.name"), 6).alias("similarity"))


@register()
def alignment_pairs(spark, sf_dir):
    return entities.candidate_pairs(nodes_of(spark, sf_dir), ["doc_id"])


@register("SELECT l_orderkey, l_linenumber, CASE least(2, greatest(0, CAST(floor(l_quantity / 20 + 0.5) AS INTEGER))) WHEN 0 THEN 'different' WHEN 1 THEN 'review' ELSE 'same' END AS outcome FROM lineitem")
def route_score(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", entities.route(F.col("l_quantity") / 20).alias("outcome"))


@register("""
    SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component
    FROM (SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n > 1""")
def clusters(spark, sf_dir):
    """Chains: each order is linked with the customer's next one, so a component is a customer's orders."""
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return components.connected_components(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), after.alias("b")))


@register(f"""
    {NODES}, s AS (SELECT doc_id, type, normalized, text, count(*) AS n, min(ord) AS f FROM m GROUP BY ALL),
    g AS (SELECT doc_id, type, string_split(normalized, ' ')[1] AS component, text, sum(n) AS n, min(f) AS f, max(normalized) AS normalized FROM s GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type, component ORDER BY CASE WHEN regexp_matches(text, '^[\\p{{Lu}}\\p{{N}}]') THEN 0 ELSE 1 END, length(normalized) DESC, length(text), n DESC, f) AS rn FROM g)
    SELECT doc_id, type, component, max(text) FILTER (rn = 1) AS canonical_name, CAST(sum(n) AS BIGINT) AS mentions, string_agg(text, ',' ORDER BY text) FILTER (rn > 1) AS aliases,
           substr(sha256(type || '|' || {norm("max(text) FILTER (rn = 1)")}), 1, 16) AS entity_id FROM r GROUP BY doc_id, type, component""")
def canonical_names(spark, sf_dir):
    n = nodes_of(spark, sf_dir)
    labels = n.select("doc_id", "type", "normalized", F.split("normalized", " ")[0].alias("component"))
    e = entities.entities(n, labels, ["doc_id"])
    return e.select("doc_id", "type", "component", "canonical_name", "mentions", F.when(F.size("aliases") > 0, F.array_join("aliases", ",")).alias("aliases"), "entity_id")


SIGNATURES = [(0, "works_for", "person", "organization", "A works for B"), (1, "located_in", "organization", "location", "A is located in B"), (1, "located_in", "event", "location", "A is located in B"), (2, "part_of", "organization", "organization", "A is part of B")]
KINDS = [("person",), ("organization",), ("location",), ("event",), ("date",)]


@register(f"""
    WITH s(o, r, d, g, t) AS (VALUES {sql_values(SIGNATURES)}), k(k) AS (VALUES {sql_values(KINDS)}), p AS (SELECT a.k AS type_a, b.k AS type_b FROM k a, k b)
    SELECT type_a, type_b, r AS relation, true AS forward, 'A_' || r || '_B' AS label, t AS text FROM p JOIN s ON type_a = d AND type_b = g
    UNION ALL SELECT type_a, type_b, r, false, 'B_' || r || '_A', 'B' || substr(t, 2, length(t) - 2) || 'A' FROM p JOIN s ON type_b = d AND type_a = g""")
def relation_options(spark, sf_dir):
    k = values(spark, KINDS, "k string")
    pairs = k.select(F.col("k").alias("type_a")).crossJoin(k.select(F.col("k").alias("type_b")))  # five literal kinds
    return relations.relation_options(pairs, values(spark, SIGNATURES, "ordinal int, relation string, domain_kind string, range_kind string, text string")).drop("ordinal")


@register("SELECT r AS relation, upper(r) AS edge, array_to_string(list_transform(string_split(r, '_'), lambda x: upper(x[1]) || x[2:]), '') AS node FROM (VALUES ('works_for'), ('geo_feature'), ('person')) t(r)")
def label_casing(spark, sf_dir):
    return values(spark, [("works_for",), ("geo_feature",), ("person",)], "relation string").select("relation", relationship_type(F.col("relation")).alias("edge"), node_label(F.col("relation")).alias("node"))


@register("""
    WITH f AS (SELECT l_orderkey AS k, l_suppkey % 40 AS e, min(l_linenumber) AS s FROM lineitem GROUP BY ALL),
    p AS (SELECT a.k, a.e AS a, b.e AS b, row_number() OVER (PARTITION BY a.k ORDER BY a.s, a.e, b.s, b.e) AS i, count(*) OVER (PARTITION BY a.k) AS n FROM f a JOIN f b ON a.k = b.k AND (a.s < b.s OR a.s = b.s AND a.e < b.e))
    SELECT k, a, b, CAST(i AS INTEGER) AS pos, greatest(n - 15, 0) AS dropped FROM p WHERE i <= 15""")
def sentence_pairs(spark, sf_dir):
    m = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 40).alias("entity"), F.col("l_linenumber").alias("start"), F.col("l_returnflag").alias("type"))
    return relations.sentence_pairs(m, ["k"]).select("k", "a", "b", F.col("at").alias("pos"), "dropped")


@register("""
    SELECT CAST(l_suppkey AS VARCHAR) AS source_id, l_returnflag AS type, CAST(l_partkey % 50 AS VARCHAR) AS target_id, count(*) AS count, round(max(l_discount * 10), 6) AS confidence, max(l_discount * 10) < 0.7 AS needs_review,
           substr(sha256(CAST(l_suppkey AS VARCHAR) || '|' || l_returnflag || '|' || CAST(l_partkey % 50 AS VARCHAR)), 1, 16) AS relation_id FROM lineitem GROUP BY l_suppkey, l_returnflag, l_partkey % 50""")
def relation_aggregate(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem")
    i = l.select(F.col("l_suppkey").cast("string").alias("source_id"), F.col("l_returnflag").alias("type"), (F.col("l_partkey") % 50).cast("string").alias("target_id"), (F.col("l_discount") * 10).alias("probability"), F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("sentence"))
    return rounded(relations.aggregate_relations(i).drop("evidence"))


SIDE = "SELECT CAST(c_custkey AS VARCHAR) AS entity_id, c_mktsegment AS type, c_name || '{tag}' AS canonical_name, ['n' || CAST(c_custkey % {m} AS VARCHAR), '{tag}'] AS aliases, c_acctbal * {sign} AS confidence FROM customer{only}"


def entity_side(spark, sf_dir, tag, m, sign, ordered=False):
    c = load(spark, sf_dir, "customer")
    if ordered:
        c = c.join(load(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return c.select(F.col("c_custkey").cast("string").alias("entity_id"), F.col("c_mktsegment").alias("type"), F.concat("c_name", F.lit(tag)).alias("canonical_name"), F.array(F.concat(F.lit("n"), (F.col("c_custkey") % m).cast("string")), F.lit(tag)).alias("aliases"), (F.col("c_acctbal") * sign).alias("confidence"))


@register(f"""
    WITH o AS ({SIDE.format(tag='old', m=3, sign=1, only='')}), n AS ({SIDE.format(tag='new', m=5, sign=-1, only=' WHERE c_custkey IN (SELECT o_custkey FROM orders)')})
    SELECT coalesce(n.entity_id, o.entity_id) AS entity_id, coalesce(n.type, o.type) AS type, coalesce(n.canonical_name, o.canonical_name) AS canonical_name,
           array_to_string(list_concat(list_filter(coalesce(o.aliases, []), lambda x: NOT list_contains(coalesce(n.aliases, []), x)), coalesce(n.aliases, [])), ',') AS aliases, round(greatest(o.confidence, n.confidence), 6) AS confidence
    FROM o FULL JOIN n ON o.entity_id = n.entity_id""")
def graph_upsert(spark, sf_dir):
    """All customers as they were, merged with those that have orders."""
    merged = graph.merge_entities(entity_side(spark, sf_dir, "old", 3, 1), entity_side(spark, sf_dir, "new", 5, -1, ordered=True))
    return rounded(merged.withColumn("aliases", F.array_join("aliases", ",")))


@register("SELECT c_custkey AS entity_id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 7 <> 0)")
def graph_orphans(spark, sf_dir):
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    edges = o.select(F.col("o_custkey").alias("source_id"), F.lit(None).cast("long").alias("target_id"), (F.col("o_orderkey") % 7).alias("doc_id"))
    kept = graph.without_documents(edges, values(spark, [(0,)], "doc_id bigint"))
    return graph.without_orphans(c.select(F.col("c_custkey").alias("entity_id")), kept)


@register("""
    WITH e AS (SELECT o_custkey AS s, o_orderstatus AS type, o_custkey % 10 AS t, o_orderkey % 4 AS d, max(o_orderkey) AS v FROM orders GROUP BY ALL), o AS (SELECT * FROM e WHERE d < 3), n AS (SELECT s, type, t, d, v + 1 AS v FROM e WHERE d > 1 AND s % 5 <> 0 AND t % 5 <> 0)
    SELECT coalesce(n.s, o.s) AS source_id, coalesce(n.type, o.type) AS type, coalesce(n.t, o.t) AS target_id, coalesce(n.d, o.d) AS doc_id, coalesce(n.v, o.v) AS v FROM o FULL JOIN n ON o.s = n.s AND o.type = n.type AND o.t = n.t AND o.d = n.d""")
def graph_relations(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    e = o.groupBy(F.col("o_custkey").alias("source_id"), F.col("o_orderstatus").alias("type"), (F.col("o_custkey") % 10).alias("target_id"), (F.col("o_orderkey") % 4).alias("doc_id")).agg(F.max("o_orderkey").alias("v"))
    ids = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id")).union(spark.range(10).toDF("entity_id")).distinct().where("entity_id % 5 <> 0")
    return graph.merge_relations(e.where("doc_id < 3"), e.where("doc_id > 1").withColumn("v", F.col("v") + 1), ids)


@register("SELECT o_custkey AS entity_id, o_orderkey % 30 AS doc_id, count(*) AS count, array_to_string(list_sort(list_distinct(list(CAST(o_orderkey % 9 AS VARCHAR)))), ',') AS pages FROM orders GROUP BY 1, 2")
def mentioned_in(spark, sf_dir):
    m = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), (F.col("o_orderkey") % 30).alias("doc_id"), (F.col("o_orderkey") % 9).cast("string").alias("page"))
    return graph.mentioned_in(m).withColumn("pages", F.array_join("pages", ","))


@register("""SELECT 'MERGE (n:Entity {id: "' || c_custkey || '"}) SET n.canonicalName = "' || c_name || '", n.type = "' || c_mktsegment || '";' AS statement FROM customer""")
def script_rows(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    return graph.entity_statements(c.select(F.col("c_custkey").cast("string").alias("entity_id"), F.col("c_name").alias("canonical_name"), F.col("c_mktsegment").alias("type")))

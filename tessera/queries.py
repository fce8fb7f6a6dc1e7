"""Every relational operator of the library as a registered query, with the SQL that it must equal.

A query takes (spark, sf_dir). The registry pairs the function with DuckDB SQL over the same
tables; where a result depends on free text rules that SQL cannot state, the SQL is left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.lenient import json_object
from tessera.operators import admission, certify, export, graph, joins, probes, provenance, semantics, synopsis, trajectory
from tessera.operators import profile as P
from tessera.plans import compile as plans
from tessera.plans.sqltool import Environment
from tessera.plans.statements import statement_facts
from tessera.session import shared_folder

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Probes


@register("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def probe_ranking(spark, sf_dir):
    """The ranking probe of orders, over the first category column that its profile gives."""
    orders = table(spark, sf_dir, "orders")
    ratios = {r["col"]: r["distinct_ratio"] for r in P.head_stats(orders, ["o_orderkey"]).collect()}
    return probes.choose(orders, ratios)[0].run(orders)


@register("SELECT o_orderdate, sum(o_orderkey)::BIGINT AS total FROM orders GROUP BY 1 ORDER BY 1 LIMIT 20")
def probe_temporal_sum(spark, sf_dir):
    return probes.temporal(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey")


@register("SELECT o_orderdate, sum(o_totalprice::DECIMAL(28,6))::DOUBLE AS total FROM orders GROUP BY 1 ORDER BY 1 LIMIT 20")
def probe_temporal_measure(spark, sf_dir):
    return probes.temporal(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")


@register("SELECT l_shipdate, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 20")
def probe_temporal_count(spark, sf_dir):
    return probes.temporal(table(spark, sf_dir, "lineitem").select("l_shipdate", "l_returnflag"), "l_shipdate", None)


@register("SELECT c_mktsegment AS label, sum(c_custkey)::DOUBLE / count(*) AS avg_v FROM customer GROUP BY 1 ORDER BY avg_v DESC, label LIMIT 10")
def probe_assoc_avg(spark, sf_dir):
    return probes.association(table(spark, sf_dir, "customer"), ("c_mktsegment",), "c_custkey")


@register("SELECT c_mktsegment AS label, sum(c_acctbal::DECIMAL(28,6))::DOUBLE / count(*) AS avg_v FROM customer GROUP BY 1 ORDER BY avg_v DESC, label LIMIT 10")
def probe_assoc_measure(spark, sf_dir):
    return probes.association(table(spark, sf_dir, "customer"), ("c_mktsegment",), "c_acctbal")


@register("SELECT l_returnflag || ' / ' || l_linestatus AS label, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY n DESC, label LIMIT 10")
def probe_assoc_pair(spark, sf_dir):
    return probes.association(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linestatus"), None)


# Profiles

_NULLS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal", "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "events": "event_id ts user_id event_type value props",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "documents": "doc_id text lang source n_chars", "labels": "doc_id quality toxic",
}


@register(" UNION ALL ".join(f"SELECT '{t}' AS unit_id, '{c}' AS col, count(*) AS n_rows, count(*) - count({c}) AS n_null, (count(*) - count({c})) / greatest(count(*), 1) AS null_rate FROM {t}" for t, cs in _NULLS.items() for c in cs.split()))
def profile_null_rate(spark, sf_dir):
    out = None
    for name in _NULLS:
        part = P.null_rates(table(spark, sf_dir, name)).select(F.lit(name).alias("unit_id"), "col", "n_rows", "n_null", "null_rate")
        out = part if out is None else out.unionByName(part)
    return out


_RATIOS = {"orders": ("o_orderkey", "o_orderkey o_custkey o_orderstatus o_orderdate o_orderpriority"), "customer": ("c_custkey", "c_custkey c_name c_nationkey c_mktsegment"), "events": ("event_id", "event_id ts user_id event_type props")}


@register(" UNION ALL ".join(f"SELECT '{t}' AS unit_id, '{c}' AS col, count(DISTINCT {c}) / count(*) AS distinct_ratio FROM (FROM {t} ORDER BY {k} LIMIT 500)" for t, (k, cs) in _RATIOS.items() for c in cs.split()))
def profile_distinct_ratio(spark, sf_dir):
    out = None
    for name, (key, cols) in _RATIOS.items():
        part = P.head_stats(table(spark, sf_dir, name).select(*cols.split()), [key]).select(F.lit(name).alias("unit_id"), "col", "distinct_ratio")
        out = part if out is None else out.unionByName(part)
    return out


@register(" UNION ALL ".join(f"SELECT '{c}' AS col, round(var_pop({c}), 4) AS variance, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM (FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 500)" for c in "l_quantity l_extendedprice l_discount l_tax".split()))
def profile_numeric_stats(spark, sf_dir):
    stats = P.head_stats(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return stats.where(F.col("col").isin("l_quantity", "l_extendedprice", "l_discount", "l_tax")).select("col", F.round("variance", 4).alias("variance"), "min", "max")


_TOPS = {"events": "event_type props".split(), "customer": ["c_mktsegment", "c_name"], "part": "p_name p_brand p_type".split()}


@register(" UNION ALL ".join(f"SELECT * FROM (SELECT '{t}' AS unit_id, '{c}' AS col, {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c})::INT AS rank FROM {t} GROUP BY {c}) WHERE rank <= 3" for t, cs in _TOPS.items() for c in cs))
def profile_top_categories(spark, sf_dir):
    out = None
    for name, cols in _TOPS.items():
        part = P.top_categories(table(spark, sf_dir, name).select(*cols)).select(F.lit(name).alias("unit_id"), "col", "value", "n", "rank")
        out = part if out is None else out.unionByName(part)
    return out


@register("SELECT value FROM (SELECT DISTINCT p_size::VARCHAR AS value FROM (FROM part ORDER BY p_partkey LIMIT 500)) ORDER BY value LIMIT 20")
def profile_sample_values(spark, sf_dir):
    return P.head_stats(table(spark, sf_dir, "part").select("p_partkey", "p_size"), ["p_partkey"]).where("col = 'p_size'").select(F.explode("sample_values").alias("value"))


_STAT_TABLES = {"orders": ("o_orderkey", "o_orderkey o_custkey o_orderstatus o_orderdate o_orderpriority"), "customer": ("c_custkey", "c_custkey c_nationkey c_mktsegment c_name"), "part": ("p_partkey", "p_partkey p_brand p_type p_size"), "labels": ("doc_id", "doc_id quality toxic")}
_TYPES = {"o_orderkey": 1, "o_custkey": 1, "c_custkey": 1, "c_nationkey": 1, "p_partkey": 1, "p_size": 1, "doc_id": 1, "quality": 1, "toxic": 1}
_RATIO_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS unit_id, {i} AS ordinal, '{c}' AS col, {bool(_TYPES.get(c))} AS num, regexp_matches('{c}', '{semantics.DATE_NAMES}') AS dat, regexp_matches('{c}', '{semantics.KEY_NAMES}') AS nam, count(DISTINCT {c}) / count(*) AS dr, min({c if _TYPES.get(c) else 'NULL'})::DOUBLE AS lo, max({c if _TYPES.get(c) else 'NULL'})::DOUBLE AS hi FROM (FROM {t} ORDER BY {k} LIMIT 500)"
    for t, (k, cs) in _STAT_TABLES.items()
    for i, c in enumerate(cs.split())
)
_ROLE_SQL = "CASE WHEN dat THEN 'time' WHEN nam AND (num OR dr >= 0.5) THEN 'identifier' WHEN dr >= 0.95 THEN 'identifier' WHEN num THEN 'measure' WHEN dr > 0 AND dr < 0.5 THEN 'category' ELSE 'entity' END"


def _stats(spark, sf_dir) -> DataFrame:
    return P.all_column_stats({t: (table(spark, sf_dir, t).select(*cs.split()), [k]) for t, (k, cs) in _STAT_TABLES.items()})


@register(f"SELECT unit_id, col, {_ROLE_SQL} AS role FROM ({_RATIO_SQL})")
def semantic_roles(spark, sf_dir):
    return _stats(spark, sf_dir).select("unit_id", "col", "role")


@register(f"""SELECT unit_id, col, CASE WHEN role = 'identifier' THEN 'id' WHEN role = 'measure' AND (regexp_matches(col, '{semantics.PERCENT_NAMES}') OR (lo >= 0 AND hi <= 1)) THEN 'percent'
    WHEN role = 'measure' AND regexp_matches(col, '{semantics.MONEY_NAMES}') THEN 'monetary' WHEN role = 'measure' AND regexp_matches(col, '{semantics.COUNT_NAMES}') THEN 'count' ELSE 'free' END AS value_kind
    FROM (SELECT *, {_ROLE_SQL} AS role FROM ({_RATIO_SQL}))""")
def semantic_value_kinds(spark, sf_dir):
    return _stats(spark, sf_dir).select("unit_id", "col", "value_kind")


@register(f"SELECT unit_id, string_agg(col, ',' ORDER BY NOT nam, ordinal) AS keys FROM ({_RATIO_SQL}) WHERE nam OR dr >= 0.95 GROUP BY 1")
def profile_keys(spark, sf_dir):
    return P.unit_stats(_stats(spark, sf_dir)).where(F.size("keys") > 0).select("unit_id", F.array_join("keys", ",").alias("keys"))


@register(f"SELECT unit_id, count(*) AS n_cols, bool_or(dat) AS has_date, bool_or(num) AS has_num FROM ({_RATIO_SQL}) GROUP BY 1")
def profile_flags(spark, sf_dir):
    return P.unit_stats(_stats(spark, sf_dir)).select("unit_id", "n_cols", "has_date", "has_num")


@register(f"SELECT unit_id, col, row_number() OVER (PARTITION BY unit_id ORDER BY (nam OR dr >= 0.95) DESC, CASE WHEN nam OR dr >= 0.95 THEN ordinal ELSE -dr END, ordinal)::INT AS proposal FROM ({_RATIO_SQL})")
def proposal_columns(spark, sf_dir):
    return semantics.proposal_columns(_stats(spark, sf_dir)).select("unit_id", "col", "proposal")


@register("""SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_extract_all(p_name || ' ' || p_type, '[A-Za-z][A-Za-z0-9]*'), lambda x: lower(x)), lambda x: x NOT IN ('the', 'of', 'and', 'or', 'to', 'a', 'an', 'in', 'for', 'by')), ' ') AS tokens FROM part""")
def entity_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.entity_tokens(F.concat_ws(" ", "p_name", "p_type")), " ").alias("tokens"))


@register("""WITH u AS (
      SELECT 'nation' AS unit, 'n_nationkey' AS col, n_nationkey::VARCHAR AS v FROM nation UNION SELECT 'nation', 'n_regionkey', n_regionkey::VARCHAR FROM nation
      UNION SELECT 'region', 'r_regionkey', r_regionkey::VARCHAR FROM region UNION SELECT 'customer', 'c_nationkey', c_nationkey::VARCHAR FROM customer
      UNION SELECT 'supplier', 's_nationkey', s_nationkey::VARCHAR FROM supplier), n AS (SELECT unit, col, count(*) AS card FROM u GROUP BY 1, 2)
    SELECT a.unit AS unit_a, a.col AS col_a, b.unit AS unit_b, b.col AS col_b, count(*) AS n_shared, count(*) / any_value(card) AS containment
    FROM u a JOIN u b ON a.v = b.v AND a.unit <> b.unit JOIN n ON n.unit = a.unit AND n.col = a.col GROUP BY 1, 2, 3, 4""")
def containment_pairs(spark, sf_dir):
    out = None
    for name, cols in {"nation": ["n_nationkey", "n_regionkey"], "region": ["r_regionkey"], "customer": ["c_nationkey"], "supplier": ["s_nationkey"]}.items():
        part = P.value_samples(table(spark, sf_dir, name).select(*cols), name)
        out = part if out is None else out.unionByName(part)
    return joins.containment(out).select("unit_a", "col_a", "unit_b", "col_b", "n_shared", "containment")


_SUFFIX_SQL = "[" + ", ".join(f"'{s}'" for s in X.GENERIC_SUFFIXES) + "]"


_NAMES_OF_PARTS = "SELECT p_partkey, lower(replace(p_type, ' ', '_')) || CASE WHEN p_partkey % 3 = 0 THEN '_id' ELSE '' END AS a, CASE WHEN p_partkey % 4 = 0 THEN upper(replace(p_type, ' ', '')) || CASE WHEN p_partkey % 3 = 0 THEN 'ID' ELSE '' END ELSE lower(replace(p_name, ' ', '_')) || '_key' END AS b FROM part"


@register(f"""WITH c AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(a), '[a-z0-9]+'), lambda x: x NOT IN {_SUFFIX_SQL.replace('[', '(').replace(']', ')')})) AS ta, list_distinct(list_filter(regexp_extract_all(lower(b), '[a-z0-9]+'), lambda x: x NOT IN {_SUFFIX_SQL.replace('[', '(').replace(']', ')')})) AS tb,
      regexp_replace(lower(a), '[^a-z0-9]', '', 'g') AS na, regexp_replace(lower(b), '[^a-z0-9]', '', 'g') AS nb FROM ({_NAMES_OF_PARTS})),
    s AS (SELECT *, length(na) - coalesce(length(list_filter({_SUFFIX_SQL}, lambda x: ends_with(na, x))[1]), 0) AS stem FROM c)
    SELECT p_partkey, CASE WHEN na = nb AND stem >= 3 THEN 1.0 WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0 ELSE len(list_intersect(ta, tb)) / len(list_distinct(ta || tb)) END::DOUBLE AS name_sim FROM s""")
def name_similarity_pairs(spark, sf_dir):
    """Two names for each part, of its type and its name, as columns might be called."""
    under = lambda c: F.lower(F.replace(F.col(c), F.lit(" "), F.lit("_")))
    third = F.col("p_partkey") % 3 == 0
    a = F.concat(under("p_type"), F.when(third, "_id").otherwise(""))
    same = F.concat(F.upper(F.replace(F.col("p_type"), F.lit(" "), F.lit(""))), F.when(third, "ID").otherwise(""))
    b = F.when(F.col("p_partkey") % 4 == 0, same).otherwise(F.concat(under("p_name"), F.lit("_key")))
    return table(spark, sf_dir, "part").select("p_partkey", X.name_similarity(a, b).alias("name_sim"))


@register("""WITH d AS (SELECT DISTINCT doc_id::VARCHAR AS v FROM documents ORDER BY v LIMIT 200), l AS (SELECT DISTINCT doc_id::VARCHAR AS v FROM labels ORDER BY v LIMIT 200),
    i AS (SELECT count(*) / least((SELECT count(*) FROM d), (SELECT count(*) FROM l)) AS c FROM d JOIN l USING (v)) SELECT 'documents' AS unit_a, 'doc_id' AS col_a, 'labels' AS unit_b, 'doc_id' AS col_b, 1.0::DOUBLE AS name_sim, c AS containment, (1 + c + 0.000001)::DOUBLE AS rank FROM i""")
def proposal_rank(spark, sf_dir):
    tables = {"documents": table(spark, sf_dir, "documents").select("doc_id"), "labels": table(spark, sf_dir, "labels").select("doc_id")}
    samples = P.value_samples(tables["documents"], "documents").unionByName(P.value_samples(tables["labels"], "labels"))
    stats = P.all_column_stats({n: (df, ["doc_id"]) for n, df in tables.items()})
    return joins.proposals(samples, stats).drop("place")


# Joins


@register("SELECT o_custkey AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY n DESC, k LIMIT 10")
def join_probe_declared(spark, sf_dir):
    return joins.join_probe(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer"), "c_custkey")


@register("SELECT d.doc_id AS k, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1 ORDER BY n DESC, k LIMIT 10")
def join_probe_named(spark, sf_dir):
    return joins.join_probe(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "labels"), "doc_id")


@register("SELECT n_regionkey AS k, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1 ORDER BY n DESC, k LIMIT 10")
def join_probe_naive(spark, sf_dir):
    return joins.join_probe_naive(table(spark, sf_dir, "nation"), "n_regionkey", table(spark, sf_dir, "region"), "r_regionkey")


@register("SELECT max(n) AS fanout_src, max(n) AS fanout_dst, max(a) AS side_src, max(b) AS side_dst FROM (SELECT count(*) AS n, count(DISTINCT n_nationkey) AS a, count(DISTINCT c_custkey) AS b FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey)")
def join_fanout(spark, sf_dir):
    return joins.fanout(table(spark, sf_dir, "nation"), "n_nationkey", table(spark, sf_dir, "customer"), "c_nationkey")


@register("SELECT count(*) >= 2 AND count(DISTINCT (k, n)) > 1 AS decoy_keeps FROM (SELECT n_chars AS k, count(*) AS n FROM documents JOIN labels ON n_chars = labels.doc_id GROUP BY 1 ORDER BY n DESC, k LIMIT 10)")
def join_counterfactual(spark, sf_dir):
    kept = probes.nontrivial(joins.join_probe(table(spark, sf_dir, "documents"), "n_chars", table(spark, sf_dir, "labels"), "doc_id"))
    return kept.select(F.col("keep").alias("decoy_keeps"))


@register("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def chain_literal_lookup(spark, sf_dir):
    return joins.literal_lookup(table(spark, sf_dir, "events"), "event_type", ["click", "view", "purchase"])


_NATION_PROBE = "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10"


@register(f"WITH bridge AS ({_NATION_PROBE}) SELECT s_nationkey, count(*) AS matching_rows FROM supplier JOIN bridge ON s_nationkey = c_nationkey GROUP BY 1 ORDER BY matching_rows DESC, 1 LIMIT 20")
def chain_composed(spark, sf_dir):
    probe = probes.ranking(table(spark, sf_dir, "customer"), "c_nationkey")
    return plans.chain(probe, "c_nationkey", table(spark, sf_dir, "supplier"), "s_nationkey")


@register("""WITH bridge AS (SELECT c_nationkey AS k, count(*) AS support FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1 ORDER BY support DESC, k LIMIT 8)
    SELECT s_nationkey, count(*) AS matching_rows FROM supplier JOIN bridge ON s_nationkey = k GROUP BY 1 ORDER BY matching_rows DESC, 1 LIMIT 20""")
def level3_join_chain(spark, sf_dir):
    return plans.join_chain(table(spark, sf_dir, "nation"), "n_nationkey", table(spark, sf_dir, "customer"), "c_nationkey", "c_nationkey", table(spark, sf_dir, "supplier"), "s_nationkey")


@register("""WITH upstream AS (SELECT s_nationkey AS u, count(*) AS n FROM supplier GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10),
    bridge AS (SELECT c_custkey AS k, count(*) AS support FROM customer JOIN upstream ON c_nationkey = u GROUP BY 1 ORDER BY support DESC, k LIMIT 8)
    SELECT o_custkey, count(*) AS matching_rows FROM orders JOIN bridge ON o_custkey = k GROUP BY 1 ORDER BY matching_rows DESC, 1 LIMIT 20""")
def level3_chain_chain(spark, sf_dir):
    probe = probes.ranking(table(spark, sf_dir, "supplier"), "s_nationkey")
    return plans.chain_chain(probe, "s_nationkey", table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", table(spark, sf_dir, "orders"), "o_custkey")


@register("""WITH bridge AS (SELECT c_nationkey AS k, count(*) AS support FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE false GROUP BY 1 ORDER BY support DESC, k LIMIT 8)
    SELECT s_nationkey, count(*) AS matching_rows FROM supplier JOIN bridge ON s_nationkey = k GROUP BY 1""")
def level3_emptied_source(spark, sf_dir):
    return plans.join_chain(plans.emptied(table(spark, sf_dir, "nation")), "n_nationkey", table(spark, sf_dir, "customer"), "c_nationkey", "c_nationkey", table(spark, sf_dir, "supplier"), "s_nationkey")


# Admission


@register("SELECT o_orderpriority AS label, count(*)::DOUBLE AS value, count(*)::VARCHAR AS raw FROM orders GROUP BY 1")
def answer_key_uncapped(spark, sf_dir):
    return admission.answer_key(probes.ranking(table(spark, sf_dir, "orders"), "o_orderpriority", None))


@register("SELECT count(*) >= 2 AND count(DISTINCT (c_mktsegment, n)) > 1 AS keep, count(*) AS n_rows, round(var_pop(n), 4) AS variance FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10)")
def nontrivial_check(spark, sf_dir):
    return probes.nontrivial(probes.ranking(table(spark, sf_dir, "customer"), "c_mktsegment")).withColumn("variance", F.round("variance", 4))


@register("""WITH r AS (SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS k FROM part GROUP BY 1)
    SELECT vk, vk1, abs(vk - vk1) / greatest(abs(vk), abs(vk1), 1e-9) > 0.01 AS margin_ok FROM (SELECT max(n) FILTER (k = 3)::DOUBLE AS vk, max(n) FILTER (k = 4)::DOUBLE AS vk1 FROM r)""")
def margin_check(spark, sf_dir):
    return admission.rank_margin(probes.ranking(table(spark, sf_dir, "part"), "p_brand", None), "n", [F.desc("n"), F.col("p_brand")], 3)


@register("""SELECT 'labels' AS unit_id, bool_and(toxic IN (0, 1)) AS guessable FROM labels UNION ALL SELECT 'orders', bool_and(o_totalprice IN (0, 1)) FROM orders""")
def guessable_check(spark, sf_dir):
    a = table(spark, sf_dir, "labels").select(F.lit("labels").alias("unit_id"), F.lit(None).cast("string").alias("label"), F.col("toxic").cast("double").alias("value"))
    b = table(spark, sf_dir, "orders").select(F.lit("orders").alias("unit_id"), F.lit(None).cast("string").alias("label"), F.col("o_totalprice").alias("value"))
    return admission.guessable(a.unionByName(b), ["unit_id"])


@register("""WITH k AS (SELECT c_mktsegment AS label, count(*)::DOUBLE AS value FROM customer GROUP BY 1), s AS (SELECT DISTINCT p_size::DOUBLE AS s FROM (FROM part ORDER BY p_partkey LIMIT 500) ORDER BY p_size::VARCHAR LIMIT 20),
    l AS (SELECT lower(p_brand) AS l FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 3)
    SELECT bool_and(lower(label) IN (FROM l) AND EXISTS (SELECT 1 FROM s WHERE abs(value - s) <= 0.01 * greatest(abs(value), abs(s), 1e-9))) AS reproducible FROM k""")
def decoy_reproducible(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_size", "p_brand", "p_partkey")
    key = admission.answer_key(probes.ranking(table(spark, sf_dir, "customer"), "c_mktsegment", None))
    return admission.decoy_reproducible(key, P.column_stats(part, "part", ["p_partkey"]), ["customer"])


@register(r"""SELECT item_id, regexp_matches(lower(text), '(^|\W)the(\W|$)') OR regexp_matches(lower(text), '(^|\W)password(\W|$)') AS leaks FROM benchmark""")
def leak_check(spark, sf_dir):
    return admission.leaks(table(spark, sf_dir, "benchmark"), "text", ["the", "password", "q"]).select("item_id", "leaks")


@register("SELECT list_filter([CASE WHEN m AND g >= 2 THEN 'comparison' END, CASE WHEN m THEN 'verification' END], lambda x: x IS NOT NULL)[1] AS first_type, len(list_filter([CASE WHEN m AND g >= 2 THEN 'comparison' END, CASE WHEN m THEN 'verification' END], lambda x: x IS NOT NULL))::INT AS n_types FROM (SELECT count(*) > 0 AS m, count(*) AS g FROM (SELECT c_mktsegment FROM customer GROUP BY 1))")
def question_types(spark, sf_dir):
    key = admission.answer_key(probes.ranking(table(spark, sf_dir, "customer"), "c_mktsegment", None))
    return admission.question_types(key).select(F.get("types", F.lit(0)).alias("first_type"), F.size("types").alias("n_types"))


@register("SELECT substr(sha1(string_agg(r, chr(10) ORDER BY r)), 1, 12) AS signature FROM (SELECT o_orderstatus || '|' || count(*)::VARCHAR AS r FROM orders GROUP BY o_orderstatus)")
def stable_hash(spark, sf_dir):
    return probes.fingerprint(probes.ranking(table(spark, sf_dir, "orders"), "o_orderstatus", None))


# Certification


@register("""WITH a AS (SELECT c_custkey AS task, c_acctbal AS value FROM customer), s AS (SELECT o_custkey AS task, o_totalprice AS x FROM orders)
    SELECT DISTINCT a.task, a.value FROM a JOIN s USING (task) WHERE abs(x / 100 - value) <= 0.01 * abs(value) AND NOT abs(5 - value) <= 0.01 * abs(value)""")
def tolerance_support(spark, sf_dir):
    stated = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task"), F.col("c_acctbal").alias("value"))
    steps = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("task")).agg(F.collect_list(F.col("o_totalprice") / 100).alias("nums")).withColumn("literals", F.array(F.lit(5.0)))
    return certify.tolerance_support(stated, steps)


@register("""WITH m AS (SELECT o_custkey AS answer, o_orderkey * 10 AS label_pos, o_orderpriority AS label FROM orders), n AS (SELECT o_custkey AS answer, o_orderkey * 10 + 7 AS num_pos, o_totalprice AS value FROM orders UNION ALL SELECT o_custkey, -1, 0.5 FROM orders GROUP BY 1)
    SELECT n.answer, n.num_pos, n.value, coalesce(m.label, f.label) AS label FROM n ASOF LEFT JOIN m ON n.answer = m.answer AND n.num_pos >= m.label_pos
    JOIN (SELECT answer, arg_min(label, label_pos) AS label FROM m GROUP BY 1) f ON f.answer = n.answer""")
def label_clause_assign(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    marks = orders.select(F.col("o_custkey").alias("answer"), (F.col("o_orderkey") * 10).alias("label_pos"), F.col("o_orderpriority").alias("label"))
    numbers = orders.select(F.col("o_custkey").alias("answer"), (F.col("o_orderkey") * 10 + 7).alias("num_pos"), F.col("o_totalprice").alias("value"))
    first = orders.select(F.col("o_custkey").alias("answer")).distinct().select("answer", F.lit(-1).cast("long").alias("num_pos"), F.lit(0.5).alias("value"))
    return certify.clause_assignment(marks, numbers.unionByName(first))


@register("SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 1 WHEN 5 THEN 1 WHEN 1 THEN 0.95 WHEN 6 THEN 0.95 WHEN 3 THEN 0.6 WHEN 4 THEN 0.6 ELSE 0 END::DOUBLE AS score FROM customer")
def verify_answer(spark, sf_dir):
    """Eight kinds of answers about customers: other case, a number near by, one too far, one in a sentence, none, other quotes and blanks, another form, another fact."""
    c = table(spark, sf_dir, "customer").withColumn("n", F.col("c_custkey") + 1000)
    number = lambda f: (F.col("n") * f).cast("string")
    kinds = [
        (F.upper("c_mktsegment"), F.lower("c_mktsegment")), (number(1001), number(1000)), (number(1020), number(1000)), (F.concat(F.lit("the total is "), number(1)), number(1)),
        (F.lit(""), F.col("c_name")), (F.concat(F.lit(" '"), "c_mktsegment", F.lit("  x' ")), F.concat("c_mktsegment", F.lit(" x"))), (F.concat(number(1), F.lit(".0")), number(1)), (F.col("c_mktsegment"), F.col("c_name")),
    ]
    said = F.element_at(F.array(*[F.struct(p.alias("predicted"), t.alias("truth")) for p, t in kinds]), (F.col("c_custkey") % 8 + 1).cast("int"))
    return c.select("c_custkey", certify.verify_answer(said["predicted"], said["truth"]).cast("double").alias("score"))


@register(r"SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '(\d),(\d)', '\1\2', 'g'), '-?\d+(\.\d+)?'))::INT AS n_numbers FROM documents")
def numeric_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.fact_numbers(F.col("text"))).alias("n_numbers"))


@register("SELECT o_orderkey, 'SELECT * FROM t WHERE a = ''<value>'' AND b > <number>' AS view FROM orders")
def literal_mask(spark, sf_dir):
    sql = F.concat(F.lit("SELECT * FROM t WHERE a = '"), F.col("o_orderstatus"), F.lit("' AND b > "), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.mask_literals(sql).alias("view"))


@register("SELECT event_id, greatest(-1, least(1, value / 100 - 0.25 * least((event_id % 7) / 3.0, 1)))::DOUBLE AS reward FROM events")
def reward(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", certify.reward(F.col("value") / 100, (F.col("event_id") % 7).cast("double"), F.lit(3.0)).alias("reward"))


# Trajectories


@register("""SELECT conv_id, turn, next_role, coalesce(length(next_text), -1)::INT AS next_chars FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) WHERE role = 'assistant'""")
def steps_adjacent(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("at", F.struct("turn", "role", "text"))
    return trajectory.adjacent(rows, "conv_id", "at").select("conv_id", "turn", "next_role", F.coalesce(F.length("next_text"), F.lit(-1)).alias("next_chars"))


@register("""WITH s AS (SELECT conv_id AS traj_id, turn AS step_idx, length(text) % 3 <> 0 AS success, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM conversations),
    i AS (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY traj_id ORDER BY rn) AS isl FROM s)
    SELECT traj_id, rn::INT AS rn, sum(CASE WHEN success THEN 0 ELSE 1 END) OVER (PARTITION BY traj_id, isl ORDER BY rn)::BIGINT AS error_run FROM i""")
def error_runs(spark, sf_dir):
    return trajectory.error_runs(_steps(spark, sf_dir), "traj_id", "rn", ~F.col("success")).select("traj_id", "rn", "error_run")


def _steps(spark, sf_dir) -> DataFrame:
    """Conversations in the shape of steps: user turns as queries, the rest as metadata calls."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    tool = F.when(F.col("role") == "user", "execute_sql").otherwise("list_tables")
    return rows.select(F.col("conv_id").alias("traj_id"), F.col("turn").alias("step_idx"), "rn", tool.alias("tool"), "text", F.col("text").alias("output"), (F.length("text") % 3 != 0).alias("success"))


@register("""WITH s AS (SELECT conv_id AS traj_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)::INT AS rn, role = 'user' AS q, length(text) % 3 <> 0 AS success, trim(text) <> '' AS filled FROM conversations)
    SELECT traj_id, rn, q AND success AND filled AS data_step, coalesce(success AND NOT lag(success) OVER (PARTITION BY traj_id ORDER BY rn), false) AS resolved_prior_error FROM s""")
def steps_classify(spark, sf_dir):
    return trajectory.classify_steps(_steps(spark, sf_dir), order="rn").select("traj_id", "rn", "data_step", "resolved_prior_error")


@register("""WITH s AS (SELECT conv_id AS traj_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)::INT AS rn, role = 'user' AS q, text FROM conversations),
    d AS (SELECT *, row_number() OVER (PARTITION BY traj_id, q, text ORDER BY rn) AS k, count(*) OVER (PARTITION BY traj_id) AS n FROM s) SELECT traj_id, rn FROM d WHERE k = 1 OR n <= 3""")
def steps_dedupe(spark, sf_dir):
    return trajectory.drop_repeats(_steps(spark, sf_dir), "traj_id", "rn", [F.col("tool"), F.col("text")]).select("traj_id", "rn")


@register("""WITH t AS (SELECT o_custkey AS task_id, o_orderkey AS traj_id, (o_orderkey % 4)::INT AS data_steps, o_totalprice AS quality, o_orderstatus = 'F' AS ended, (o_orderkey % 9)::INT AS n_steps FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY data_steps >= 1 DESC, quality DESC, ended DESC, n_steps DESC, traj_id DESC) AS k FROM t) SELECT task_id, traj_id, quality, n_steps FROM r WHERE k = 1""")
def trajectory_rank(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("traj_id"), (F.col("o_orderkey") % 4).cast("int").alias("data_steps"), F.col("o_totalprice").alias("quality"), (F.col("o_orderstatus") == "F").alias("ended"), (F.col("o_orderkey") % 9).cast("int").alias("n_steps"))
    return trajectory.rank_trajectories(rows)


@register("SELECT o_custkey, o_orderkey, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS best, coalesce(o_totalprice > max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM orders")
def best_so_far(spark, sf_dir):
    return trajectory.best_so_far(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey", "o_totalprice")


@register("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 10")
def last_results(spark, sf_dir):
    return trajectory.last_kept(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@register("SELECT c_custkey, CASE WHEN c_custkey % 5 IN (1, 2, 3) THEN c_custkey % 5 ELSE 1 END::INT AS level FROM customer")
def budget_scaling(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", trajectory.level(F.concat(F.lit("M"), F.col("c_custkey") % 5)).cast("int").alias("level"))


_STOP_SQL = "(" + ", ".join(f"'{w}'" for w in X.QUESTION_STOPWORDS) + ")"


@register(f"""WITH w AS (SELECT conv_id, turn, role, text, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN {_STOP_SQL})) AS words FROM conversations),
    q AS (SELECT conv_id, arg_min(words, (turn, role, text)) AS asked FROM w GROUP BY conv_id) SELECT conv_id, turn, role, len(words)::INT AS n_words, len(list_intersect(words, asked))::INT AS covered FROM w JOIN q USING (conv_id)""")
def token_coverage(spark, sf_dir):
    """How many of the words that a conversation begins with each of its turns names."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", X.question_tokens(F.col("text")).alias("words"))
    asked = turns.groupBy("conv_id").agg(F.min_by("words", F.struct("turn", "role", "text")).alias("asked"))
    return turns.join(asked, "conv_id").select("conv_id", "turn", "role", F.size("words").alias("n_words"), F.size(F.array_intersect("words", "asked")).alias("covered"))


@register("""WITH a AS (SELECT * FROM (VALUES (0, 'discover', ['list_tables', 'list_directory']), (1, 'inspect', ['get_table_schema', 'read_file']), (2, 'query', ['execute_sql']), (3, 'compute', ['execute_sql', 'execute_python']), (4, 'verify', ['execute_sql', 'execute_python']), (5, 'repair', ['execute_sql', 'execute_python', 'get_table_schema']), (6, 'answer', ['none'])) AS t(k, operator, tools)),
    e AS (SELECT event_id % 7 AS k, count(*) AS n FROM events GROUP BY 1)
    SELECT operator, tool, model, history, effort, n FROM (SELECT operator, n, unnest(tools) AS tool FROM a JOIN e USING (k)), (VALUES ('small'), ('medium'), ('large')) AS m(model), (VALUES ('short'), ('mid'), ('long')) AS h(history), (VALUES ('standard'), ('moderate'), ('extended')) AS f(effort)""")
def action_enumeration(spark, sf_dir):
    """Events told as steps of seven operators: each operator's actions, and how many steps could have taken them."""
    from tessera.control import search

    each = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    names = F.array(*[F.lit(o) for o in search.OPERATORS])
    tools = F.array(*[F.array(*[F.lit(t) for t in ts or ("none",)]) for ts in search.OPERATORS.values()])
    steps = table(spark, sf_dir, "events").groupBy((F.col("event_id") % len(search.OPERATORS)).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    rows = steps.select(F.element_at(names, F.col("k") + 1).alias("operator"), F.explode(F.element_at(tools, F.col("k") + 1)).alias("tool"), "n")
    return rows.withColumn("model", each(search.MODELS)).withColumn("history", each(search.HISTORIES)).withColumn("effort", each(search.EFFORTS))


@register("SELECT conv_id, count(*)::INT AS n_messages, string_agg(role, ',' ORDER BY turn, role, text) AS roles, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def export_messages(spark, sf_dir):
    out = trajectory.to_messages(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    chars = F.aggregate("messages", F.lit(0).cast("long"), lambda s, m: s + F.length(m["content"]))
    return out.select("conv_id", "n_messages", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), chars.alias("chars"))


@register("SELECT count(*) AS n, count(*) FILTER (event_type = 'purchase') AS n_success, count(*) FILTER (event_type = 'purchase') / count(*) AS success_rate, sum(value::DECIMAL(28,6))::DOUBLE AS total_cost, sum(value::DECIMAL(28,6))::DOUBLE / count(*) AS mean_cost FROM events")
def manifest_totals(spark, sf_dir):
    return trajectory.manifest(table(spark, sf_dir, "events"), F.col("event_type") == "purchase", F.col("value"))


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_unfinished(spark, sf_dir):
    return trajectory.unfinished(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@register("WITH RECURSIVE up AS (SELECT c_custkey AS leaf, c_custkey AS node_id, nullif(c_custkey // 3, c_custkey) AS parent_id, 0 AS hops FROM customer UNION ALL SELECT leaf, n.c_custkey, nullif(n.c_custkey // 3, n.c_custkey), hops + 1 FROM up JOIN customer n ON up.parent_id = n.c_custkey) SELECT leaf, node_id, hops::INT AS hops FROM up")
def parent_chain(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    nodes = customer.select(F.col("c_custkey").alias("node_id"), F.expr("nullif(c_custkey div 3, c_custkey)").alias("parent_id"))
    return trajectory.parents(nodes, nodes.select("node_id"))


@register("SELECT node_id FROM (SELECT c_custkey AS node_id, ntile(4) OVER (ORDER BY (c_nationkey - 100 * (c_custkey % 10) / 10.0) DESC, c_custkey) AS t FROM customer WHERE c_custkey % 2 = 0) WHERE t = 1")
def cache_eviction(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_nationkey").alias("age"), ((F.col("c_custkey") % 10) / 10.0).alias("avg_reward"), (F.col("c_custkey") % 2 == 0).alias("is_leaf"))
    return trajectory.evict(nodes).select("node_id")


def _of_each_text(texts, key, rows):
    """The rows that a table function finds in each text."""
    return texts.select(key, "text").lateralJoin(rows(F.col("text").outer())).drop("text")


def _nation_lines(spark, sf_dir, line, head):
    """A Markdown text for each region, with a line for each of its nations."""
    lines = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return lines.select("n_regionkey", F.concat(F.lit(head), F.array_join("lines", "\n")).alias("text"))


@register("""WITH n AS (SELECT n_regionkey, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS r FROM nation)
    SELECT n_regionkey, 0 AS table_idx, r::INT AS row_idx, n_name || '/' || n_nationkey AS cells FROM n UNION ALL SELECT DISTINCT n_regionkey, 0, 0, 'name/id' FROM n""")
def md_pipe_tables(spark, sf_dir):
    from tessera.sources.files import PipeTableRows

    line = F.concat(F.lit("| "), "n_name", F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit(" |"))
    texts = _nation_lines(spark, sf_dir, line, "Nations\n\n| name | id |\n|---|---|\n")
    return _of_each_text(texts, "n_regionkey", PipeTableRows).withColumn("cells", F.array_join("cells", "/"))


@register("SELECT n_regionkey, 'Of one region' AS section, lower(n_name) AS key, n_nationkey::VARCHAR AS value FROM nation")
def md_key_lines(spark, sf_dir):
    from tessera.sources.files import KeyLines

    line = F.concat("n_name", F.lit(": "), F.col("n_nationkey").cast("string"))
    found = _of_each_text(_nation_lines(spark, sf_dir, line, "## Of one region\n\n"), "n_regionkey", KeyLines)
    return found.withColumn("key", F.lower("key"))


@register("SELECT n_regionkey, n_name AS name, n_nationkey::BIGINT AS id FROM nation")
def md_typed_blocks(spark, sf_dir):
    """A Markdown text for each region, all walked in one job; every block a typed table."""
    from tessera.sources.files import markdown_blocks

    line = F.concat(F.lit("| "), "n_name", F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit(" |"))
    texts = _nation_lines(spark, sf_dir, line, "Nations\n\n| name | id |\n|---|---|\n")
    found = markdown_blocks(texts.select(F.col("n_regionkey").cast("string").alias("path"), "text"))
    of_all = [df.select(F.lit(int(region)).alias("n_regionkey"), "name", "id") for (region, _), df in found.items()]
    return reduce(DataFrame.unionByName, of_all, spark.createDataFrame([], "n_regionkey int, name string, id bigint"))


# The dependency graph


def _units(spark, sf_dir, *names):
    """Tables as units with their declared keys."""
    declared = {"nation": [("n_regionkey", "region", "r_regionkey")], "customer": [("c_nationkey", "nation", "n_nationkey")], "supplier": [("s_nationkey", "nation", "n_nationkey")]}
    found = {n: table(spark, sf_dir, n) for n in names}
    return {n: graph.Unit(n, df, n, order=tuple(df.columns[:1]), declared=declared.get(n, [])) for n, df in found.items()}


def _graph(spark, sf_dir):
    """Customers, nations and suppliers with edges as given, so that paths of all three levels are there."""
    units = _units(spark, sf_dir, "nation", "customer", "supplier")
    return graph.Graph(units, [graph.Edge("nation", "customer", "join", "n_nationkey", "c_nationkey"), graph.Edge("customer", "supplier", "chain", "c_nationkey", "s_nationkey", (probes.Probe("ranking", ("c_nationkey",)), ()))])


@register("""SELECT 'nation' AS src, 'n_regionkey' AS src_col, 'join' AS kind, 'region' AS dst, 'r_regionkey' AS dst_col, count(DISTINCT n_regionkey) AS n_keys FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'customer', 'c_nationkey', 'join', 'nation', 'n_nationkey', count(DISTINCT c_nationkey) FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def graph_edges(spark, sf_dir):
    """Profiles, proposes, executes and admits the edges of three tables; the keys that each admitted edge joins."""
    g = graph.build(_units(spark, sf_dir, "region", "nation", "customer"))
    sized = [joins.join_probe(g.units[e.src].df, e.src_col, g.units[e.dst].df, e.dst_col, None).agg(F.count(F.lit(1)).alias("n_keys")).select(*[F.lit(v).alias(k) for k, v in (("src", e.src), ("src_col", e.src_col), ("kind", e.kind), ("dst", e.dst), ("dst_col", e.dst_col))], "n_keys") for e in g.edges]
    return reduce(DataFrame.unionByName, sized)


def _return_units(spark, sf_dir):
    """Lines of orders, and those of them that came back: the one's flags are a bridge to the other's."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    back = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_returnflag").alias("flag"), "l_quantity", "l_orderkey", "l_linenumber")
    order = ("l_orderkey", "l_linenumber")
    return {"lines": graph.Unit("lines", lines, "lines", order=order), "returned": graph.Unit("returned", back.drop("l_orderkey"), "returned", order=("l_linenumber", "l_quantity", "flag"))}


_RETURN_COUNTS = "a AS (SELECT l_returnflag AS v, count(*) AS na FROM lineitem GROUP BY 1), b AS (SELECT v, na AS nb FROM a WHERE v <> 'N'), m AS (SELECT count(*) AS n_keys, max(na * nb) AS pairs, max(na) AS high, (SELECT count(*) FROM a) - count(*) AS others FROM a JOIN b USING (v))"


@register(f"""WITH {_RETURN_COUNTS}
    SELECT 'join' AS kind, 'lines' AS src, 'l_returnflag' AS src_col, 'returned' AS dst, 'flag' AS dst_col, CASE WHEN n_keys < 2 THEN 'join_trivial' WHEN pairs * pairs > 64 THEN 'join_fanout' ELSE 'join_admitted' END AS decision, n_keys, pairs FROM m
    UNION ALL SELECT 'chain', 'returned', 'flag', 'lines', 'l_returnflag', CASE WHEN n_keys < 2 THEN 'chain_trivial' WHEN others = 0 THEN 'chain_counterfactual' ELSE 'chain_admitted' END, n_keys, -1 FROM m
    UNION ALL SELECT 'chain', 'lines', 'l_returnflag', 'returned', 'flag', CASE WHEN n_keys < 2 THEN 'chain_trivial' ELSE 'chain_counterfactual' END, n_keys, -1 FROM m""")
def graph_decisions(spark, sf_dir):
    """What was decided on each candidate edge, a chain edge among those admitted, and the counts behind it."""
    g = graph.build(_return_units(spark, sf_dir))
    log = spark.createDataFrame([graph.Row(**r) for r in g.log], graph.LOG)
    return log.select("kind", "src", "src_col", "dst", "dst_col", "decision", "n_keys", F.coalesce("pairs", F.lit(-1)).alias("pairs"))


@register(f"""WITH {_RETURN_COUNTS} SELECT unnest(['join_verified', 'join_kept', 'join_kept_declared', 'join_trivial', 'join_fanout', 'join_counterfactual', 'chain_role', 'chain_verified', 'chain_kept', 'chain_trivial', 'chain_counterfactual']) AS name,
    unnest([1, (n_keys >= 2 AND pairs * pairs <= 64)::INT, 0, (n_keys < 2)::INT, (n_keys >= 2 AND pairs * pairs > 64)::INT, 0, 0, 2, (n_keys >= 2 AND others > 0)::INT, 2 * (n_keys < 2)::INT, (n_keys >= 2)::INT])::BIGINT AS n FROM m""")
def graph_counters(spark, sf_dir):
    g = graph.build(_return_units(spark, sf_dir))
    return graph.counters(spark.createDataFrame([graph.Row(**r) for r in g.log], graph.LOG))


@register("""WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1), o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1)
    SELECT 'nations' AS pair, count(*) AS n_keys, max(c.n * s.n) AS pairs, max(c.n) AS side_src, max(s.n) AS side_dst FROM c JOIN s USING (k) UNION ALL SELECT 'customers', count(*), max(o.n * p.n), max(o.n), max(p.n) FROM o JOIN p USING (k) UNION ALL SELECT 'mixed', count(*), max(o.n * s.n), max(o.n), max(s.n) FROM o JOIN s USING (k)""")
def join_probes_at_once(spark, sf_dir):
    """Three probes, aggregates of one table of counts."""
    found = {"customer": (table(spark, sf_dir, "customer"), ["c_nationkey", "c_custkey"]), "supplier": (table(spark, sf_dir, "supplier"), ["s_nationkey"]), "orders": (table(spark, sf_dir, "orders"), ["o_custkey"])}
    pairs = [("nations", "customer", "c_nationkey", "supplier", "s_nationkey"), ("customers", "orders", "o_custkey", "customer", "c_custkey"), ("mixed", "orders", "o_custkey", "supplier", "s_nationkey")]
    return joins.pair_facts(joins.value_counts(found), spark.createDataFrame(pairs, "pair string, unit_a string, col_a string, unit_b string, col_b string"))


@register("SELECT c_nationkey AS k, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def path_join(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return graph.execute(g, next(p for p in graph.paths(g, 2) if p.edge_kinds == ["join"]))


@register("""WITH b AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10) SELECT s_nationkey, count(*) AS matching_rows FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM b) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def path_chain(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return graph.execute(g, next(p for p in graph.paths(g, 2) if p.edge_kinds == ["chain"]))


@register("""WITH b AS (SELECT c_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, 1 LIMIT 8) SELECT s_nationkey, count(*) AS matching_rows FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM b) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def path_join_chain(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return graph.execute(g, graph.sample_path(g, 3, 5))


@register("""WITH q AS (SELECT ['nations', 'customer', 'balance', 'acctbal', 'segment'] AS w), p AS (FROM (VALUES (1, 'customer', ['customer', 'acctbal']), (2, 'nation > customer', ['customer', 'acctbal']), (2, 'customer > supplier', ['customer', 'acctbal']), (3, 'nation > customer > supplier', ['customer', 'acctbal']), (1, 'supplier', ['acctbal'])) AS t(level, nodes, words))
    SELECT nodes, level::INT AS level, (row_number() OVER (ORDER BY len(list_intersect(words, w)) DESC, level, nodes DESC) - 1)::INT AS place FROM p, q""")
def path_keywords(spark, sf_dir):
    g = _graph(spark, sf_dir)
    found = graph.paths_for_question(g, "Which nations and customer segment have the balance (acctbal)?")
    return spark.createDataFrame([(" > ".join(p.nodes), p.level, i) for i, p in enumerate(found)], "nodes string, level int, place int")


# What scopes are about; scores

_ANCHOR_SQL = "SELECT o_custkey AS scope, o_orderkey AS place, ['ranking', 'temporal', 'association'][o_orderkey % 3 + 1] AS category, o_orderkey % 50 AS n_rows, floor(o_totalprice) AS variance FROM orders"


def _anchors(spark, sf_dir):
    category = F.element_at(F.array(*map(F.lit, ("ranking", "temporal", "association"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("place"), category.alias("category"), (F.col("o_orderkey") % 50).alias("n_rows"), F.floor("o_totalprice").alias("variance"))


@register(f"""WITH c AS (SELECT scope, category, count(*) AS n, min(place) AS first FROM ({_ANCHOR_SQL}) GROUP BY 1, 2) SELECT scope, category, n, CASE category WHEN 'ranking' THEN 'comparison' WHEN 'temporal' THEN 'temporal' ELSE 'attribution' END AS kind
    FROM c QUALIFY row_number() OVER (PARTITION BY scope ORDER BY n DESC, first) = 1""")
def synopsis_kind(spark, sf_dir):
    return synopsis.dominant_kind(_anchors(spark, sf_dir))


@register(f"SELECT scope, place, rank FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY n_rows * (variance + 1) DESC, place)::INT AS rank FROM ({_ANCHOR_SQL})) WHERE rank <= 3")
def synopsis_representative(spark, sf_dir):
    return synopsis.representative(_anchors(spark, sf_dir)).select("scope", "place", "rank")


@register("SELECT scope, unit_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY n_rows DESC, unit_id)::INT AS rank FROM (SELECT c_nationkey AS scope, c_mktsegment AS unit_id, count(*) AS n_rows FROM customer GROUP BY 1, 2)) WHERE rank <= 2")
def synopsis_entry_units(spark, sf_dir):
    units = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("scope"), F.col("c_mktsegment").alias("unit_id")).agg(F.count(F.lit(1)).alias("n_rows"))
    return synopsis.entry_units(units).select("scope", "unit_id", "rank")


@register("SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) = 1")
def best_per_tool(spark, sf_dir):
    ranked = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice", "o_orderkey")
    return synopsis.best_per_tool(ranked, "o_custkey", "o_orderpriority", "o_totalprice", "o_orderkey").drop("o_totalprice")


@register("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN greatest(0, least(1, value / 100)) WHEN event_id % 3 = 1 THEN (greatest(0, least(1, value / 50)) + 0.5) / 2 ELSE 0 END::DOUBLE AS score FROM events""")
def judge_score(spark, sf_dir):
    overall = F.when(F.col("event_id") % 3 == 0, F.col("value") / 100)
    dimensions = F.when(F.col("event_id") % 3 == 1, F.array(F.col("value") / 50, F.lit(0.5), F.lit(None).cast("double"))).otherwise(F.array().cast("array<double>"))
    return table(spark, sf_dir, "events").select("event_id", synopsis.judge_score(overall, dimensions).alias("score"))


# Certificates of many answers


def _customer_answers(spark, sf_dir):
    """An answer for each customer, its key, and the step behind it; by number, an answer is wrong or its number is typed into the query."""
    c = table(spark, sf_dir, "customer").withColumn("n", F.col("c_custkey") + 1000)
    said = F.when(F.col("c_custkey") % 3 == 1, F.col("n") * 2).otherwise(F.col("n")).cast("string")
    answers = c.select(F.col("c_custkey").alias("answer"), F.concat("c_mktsegment", F.lit(" holds "), said, F.lit(", OTHERS 7")).alias("text"), F.lit("none such").alias("truth"))
    keys = c.select(F.col("c_custkey").alias("answer"), F.col("c_mktsegment").alias("label"), F.col("n").cast("double").alias("value"))
    typed = F.when(F.col("c_custkey") % 3 == 2, F.concat(F.lit("SELECT sum(x), "), "n", F.lit(" FROM customer"))).otherwise(F.lit("SELECT sum(x) FROM customer"))
    steps = c.select(F.col("c_custkey").alias("answer"), F.lit(0).alias("step"), F.lit("execute_sql").alias("tool"), typed.alias("text"), F.concat(F.lit("label|n\nA|"), "n").alias("output"))
    return answers, keys, steps


@register("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN 'orders' WHEN o_orderkey % 4 = 2 THEN 'lineitem,orders' ELSE '' END AS sources,
        CASE o_orderkey % 4 WHEN 0 THEN o_custkey::VARCHAR WHEN 1 THEN '' WHEN 2 THEN '1,' || o_custkey ELSE o_custkey::VARCHAR END AS numbers, o_orderkey % 4 IN (0, 2) AS shaped, CASE WHEN o_orderkey % 4 = 3 THEN 'insert' ELSE 'select' END AS verb FROM orders""")
def statement_facts_of_steps(spark, sf_dir):
    """A statement for each order, with names in strings, comments, aliases and CTEs that are no sources."""
    key = F.col("o_custkey").cast("string")
    text = F.element_at(
        F.array(
            F.concat(F.lit("SELECT lineitem.o FROM orders AS lineitem WHERE k = "), key, F.lit(" -- FROM part WHERE k = 9")),
            F.concat(F.lit("WITH customer AS (SELECT 'FROM part ' AS c, o_"), F.col("o_orderstatus"), F.lit(" FROM orders) SELECT * FROM customer")),
            F.concat(F.lit("SELECT max(x) FROM (SELECT 1 AS x FROM orders), LineItem li ON x = "), key, F.lit(" LIMIT 7, 8")),
            F.concat(F.lit("EXPLAIN INSERT INTO part VALUES ("), key, F.lit(")")),
        ),
        (F.col("o_orderkey") % 4 + 1).cast("int"),
    )
    told = table(spark, sf_dir, "orders").select("o_orderkey", statement_facts(text).alias("f"))
    numbers = F.array_join(F.transform("f.numbers", lambda x: x.cast("long").cast("string")), ",")
    return told.select("o_orderkey", F.array_join(F.array_sort("f.sources"), ",").alias("sources"), numbers.alias("numbers"), "f.shaped", "f.verb")


@register("SELECT c_custkey AS answer, CASE c_custkey % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS v_q, c_custkey % 3 <> 1 AS correct, c_custkey % 3 = 0 AS computed FROM customer")
def certificates(spark, sf_dir):
    answers, keys, steps = _customer_answers(spark, sf_dir)
    none = spark.createDataFrame([], "answer long, source string")
    return certify.certify(answers, keys, steps, F.array(F.lit("customer")), none).select("answer", F.col("v_q").cast("double").alias("v_q"), "correct", "computed")


@register("""SELECT c_custkey AS answer, CASE WHEN c_custkey % 4 = 0 THEN 0.95 ELSE 0.5 END::DOUBLE AS v_q, c_custkey % 4 = 0 AS covered, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 3 THEN 'orders' ELSE 'customer' END AS covered_fail,
        CASE c_custkey % 4 WHEN 1 THEN 0 WHEN 3 THEN 1 ELSE 1 END::BIGINT AS replays FROM customer""")
def certificates_covered(spark, sf_dir):
    """Answers whose required source is read and matters, is named but not read, is read but does not matter, or is one of two of which one is not read."""
    answers, keys, steps = _customer_answers(spark, sf_dir)
    right = table(spark, sf_dir, "customer").withColumn("n", (F.col("c_custkey") + 1000).cast("string"))
    answers = right.select(F.col("c_custkey").alias("answer"), F.concat("c_mktsegment", F.lit(" holds "), "n").alias("text"), F.lit("none such").alias("truth"))
    texts = F.array(
        F.lit("SELECT count(*) AS n, c_mktsegment FROM customer GROUP BY c_mktsegment"),
        F.lit("SELECT count(*) AS customer FROM nation"),
        F.lit("SELECT count(*) AS n FROM nation WHERE n_nationkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey < 0)"),
        F.lit("SELECT max(c_acctbal) AS orders FROM customer"),
    )
    kind = F.col("answer") % 4
    steps = steps.withColumn("text", F.element_at(texts, (kind + 1).cast("int")))
    required = answers.select("answer", F.explode(F.when(kind == 3, F.array(F.lit("customer"), F.lit("orders"))).otherwise(F.array(F.lit("customer")))).alias("source"))
    env = Environment(spark, {t: table(spark, sf_dir, t) for t in ("nation", "customer", "orders")})
    found = certify.certify(answers, keys, steps, F.array(F.lit("customer"), F.lit("nation")), required, lambda text, gone: env.replay(text, gone, 600))
    return found.select("answer", F.col("v_q").cast("double").alias("v_q"), "covered", "covered_fail", "replays")


@register(r"""SELECT conv_id AS traj_id, (count(DISTINCT text) * 2 + 2)::INT AS n_messages, count(DISTINCT text) AS n_steps FROM conversations WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 3 AND (conv_id % 10) / 10.0 >= 0.45""")
def assembled_samples(spark, sf_dir):
    """Training samples of conversations told as trajectories: a turn is a call of a tool that reads no data, its text the argument."""
    talks = table(spark, sf_dir, "conversations").where("text is not null")
    trajectories = talks.groupBy(F.col("conv_id").alias("traj_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 3").select("traj_id", F.lit("What was said?").alias("question"), F.lit("This and that.").alias("answer"), ((F.col("traj_id") % 10) / 10.0).alias("quality"), F.lit("{}").alias("certificate"))
    steps = talks.select(F.col("conv_id").alias("traj_id"), F.col("turn").alias("step_idx"), F.lit("read_file").alias("tool"), F.col("text").alias("arguments"), F.lit("").alias("thought"), F.lit("read").alias("output"))
    return export.assemble(trajectories, steps).select("traj_id", F.size("sample.messages").alias("n_messages"), "sample.meta.n_steps")


# Files


@register("SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, replace(coalesce(text, ''), chr(13), ' ') AS text, length(replace(coalesce(text, ''), chr(13), ' '))::INT AS n_chars FROM conversations")
def csv_quoted_lines(spark, sf_dir):
    """Turns of conversations, line breaks and quotes with them, written as delimited text and read back by ranges."""
    from tessera.sources import delimited

    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(" ")).alias("text"))
    turns.write.csv(path, header=True, quoteAll=True, escape='"', emptyValue="")
    found = delimited.read(spark, path, ["conv_id", "turn", "text"])
    return found.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))


# Records of results, and what models write


@register("""WITH r AS (SELECT c_mktsegment AS k, count(*) AS n FROM customer GROUP BY 1), f AS (SELECT *, row_number() OVER (ORDER BY n DESC, k) AS place FROM r)
    SELECT 'ranking' AS category, count(*) AS n_rows, round(var_pop(n), 6) AS variance, string_agg(k, ',' ORDER BY place) FILTER (place <= 8) AS labels, string_agg(n::VARCHAR, ',' ORDER BY place) FILTER (place <= 12) AS nums, substr(sha1(string_agg(k || '|' || n, chr(10) ORDER BY k || '|' || n)), 1, 12) AS signature FROM f""")
def anchor_record(spark, sf_dir):
    result = probes.ranking(table(spark, sf_dir, "customer"), "c_mktsegment")
    found = provenance.record(result, [F.desc("n"), F.asc("c_mktsegment")], "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1", ["customer"], "ranking")
    nums = F.array_join(F.transform("nums", lambda x: x.cast("long").cast("string")), ",")
    return found.select("category", "n_rows", F.round("variance", 6).alias("variance"), F.array_join("labels", ",").alias("labels"), nums.alias("nums"), "signature")


@register("""WITH r AS (SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1) SELECT 'report the record count for every priority' AS clause, 'orders' AS units, count(*) AS n_rows, string_agg(k || '=' || n, ',' ORDER BY k) AS key_rows FROM r""")
def answer_contract(spark, sf_dir):
    result = probes.ranking(table(spark, sf_dir, "orders"), "o_orderpriority", None)
    found = provenance.contract(result, "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1", ["orders", "orders"], "report the record count for every priority ")
    rows = F.array_join(F.transform("key_rows", lambda r: F.concat(r["label"], F.lit("="), r["value"].cast("long").cast("string"))), ",")
    return found.select("clause", F.array_join("units", ",").alias("units"), "n_rows", rows.alias("key_rows"))


@register("""SELECT DISTINCT o_custkey, coalesce(label, '-') AS label, coalesce(value, -1)::DOUBLE AS value FROM (
      SELECT o_custkey, CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN o_orderstatus END AS label, CASE WHEN o_orderkey % 5 IN (0, 1, 2, 3) THEN o_totalprice END AS value FROM orders WHERE o_orderkey % 5 < 4
      UNION ALL SELECT o_custkey, NULL, o_orderkey FROM orders WHERE o_orderkey % 5 = 3 UNION ALL SELECT o_custkey, NULL, o_orderkey FROM orders WHERE o_orderkey % 5 = 1
      UNION ALL SELECT o_custkey, o_orderpriority, NULL FROM orders WHERE o_orderkey % 5 = 4)""")
def key_row_shapes(spark, sf_dir):
    """Provenance of orders in five shapes: facts, rows, a label beside numbers, numbers, labels."""
    kind, price, order = F.col("o_orderkey") % 5, F.col("o_totalprice").cast("double"), F.col("o_orderkey").cast("double")
    rows = F.array(F.struct(F.array("o_orderstatus", "o_orderpriority").alias("labels"), F.array(price, order).alias("nums")), F.struct(F.array().cast("array<string>").alias("labels"), F.array(order).alias("nums")))
    shaped = table(spark, sf_dir, "orders").select(
        "o_custkey",
        F.when(kind == 0, F.col("o_orderstatus")).alias("label"), F.when(kind == 0, price).alias("value"), F.lit(None).cast("string").alias("raw"), F.when(kind == 1, rows).alias("rows"),
        F.when(kind == 2, F.array("o_orderstatus", "o_orderpriority")).when(kind == 4, F.array("o_orderpriority", F.lit(""))).alias("labels"), F.when(kind.isin(2, 3), F.array(price, order)).alias("nums"),
    )
    return provenance.key_rows(shaped, ["o_custkey"]).select("o_custkey", F.coalesce("label", F.lit("-")).alias("label"), F.coalesce("value", F.lit(-1.0)).alias("value"))


@register("SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN '' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 5 = 4 THEN -1 ELSE c_nationkey END::BIGINT AS nation FROM customer")
def lenient_json(spark, sf_dir):
    """Replies about customers that hold JSON: plain, fenced, with faults, cut off, none."""
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    forms = [
        F.concat(F.lit('{"segment": "'), segment, F.lit('", "nation": '), nation, F.lit("}")),
        F.concat(F.lit('<think>{"segment": 0}</think>Here {as asked}:\n```json\n{"nation": '), nation, F.lit(', "segment": "'), segment, F.lit('"}\n``` and {"more": 1}')),
        F.concat(F.lit('{"ok": True, // fine\n "segment": "'), segment, F.lit('", "list": [1, 2, ], "nation": '), nation, F.lit(",}")),
        F.concat(F.lit('{"nation": '), nation, F.lit(', "deep": [{"a": "}"}], "segment": "'), segment),
        F.concat(F.lit("no JSON { here: "), segment, F.lit(" }")),
    ]
    texts = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*forms), (F.col("c_custkey") % 5 + 1).cast("int")).alias("text"))
    found = texts.withColumn("json", json_object(F.col("text"), "segment"))
    return found.select("c_custkey", F.coalesce(F.get_json_object("json", "$.segment"), F.lit("")).alias("segment"), F.coalesce(F.get_json_object("json", "$.nation").cast("long"), F.lit(-1).cast("long")).alias("nation"))


@register("SELECT 'nation' AS unit_id, count(*) AS n_rows FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def profile_within_budget(spark, sf_dir):
    """Profiles within a time that is ample here; each table's rows, of tables that were profiled."""
    rows, late = P.stats_within({n: (table(spark, sf_dir, n), [k]) for n, k in (("nation", "n_nationkey"), ("region", "r_regionkey"))}, 600)
    return spark.createDataFrame(sorted({(r["unit_id"], r["n_rows"]) for r in rows}), "unit_id string, n_rows long")


# Pass-through SQL: the same text for both engines, through the guarded tool

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_SQL = {
    "sql_filter": "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000 AND NOT c_mktsegment = 'BUILDING' OR c_nationkey = 3",
    "sql_in_subquery": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2))",
    "sql_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "sql_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)",
    "sql_inner_join": "SELECT n_name, r_name FROM nation INNER JOIN region ON n_regionkey = r_regionkey",
    "sql_left_join": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "sql_right_join": "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "sql_full_join": "SELECT coalesce(c_nationkey, -1) AS c_nationkey, coalesce(s_nationkey, -1) AS s_nationkey FROM (SELECT DISTINCT c_nationkey FROM customer) c FULL OUTER JOIN (SELECT DISTINCT s_nationkey FROM supplier) s ON c_nationkey = s_nationkey + 1",
    "sql_having": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 100",
    "sql_order": "SELECT n_nationkey, n_name FROM nation ORDER BY n_regionkey DESC, n_name ASC",
    "sql_limit_offset": "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 7 OFFSET 3",
    "sql_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "sql_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
    "sql_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_nationkey < 10",
    "sql_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "sql_aggregates": "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS d, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag",
    "sql_case": "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band FROM orders",
    "sql_between": "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand IS NOT NULL AND TRUE",
    "sql_cte": "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT n, count(*) AS customers FROM big GROUP BY n",
    "sql_window": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders",
    "sql_quoted": "SELECT \"n_name\" FROM \"nation\" WHERE \"n_regionkey\" = 1",
}
_SHIMMED = {
    "sql_like": ("SELECT p_partkey FROM part WHERE p_type LIKE '%econ%' AND p_name NOT LIKE 'RED%'", "SELECT p_partkey FROM part WHERE p_type ILIKE '%econ%' AND p_name NOT ILIKE 'RED%'"),
    "sql_cast": ("SELECT c_custkey, CAST(c_nationkey AS TEXT) AS t, CAST(c_name AS REAL) AS r, CAST('12.5abc' AS REAL) AS p, CAST(substr(c_name, 10) AS INTEGER) AS i FROM customer", "SELECT c_custkey, c_nationkey::VARCHAR AS t, 0.0::DOUBLE AS r, 12.5::DOUBLE AS p, coalesce(try_cast(regexp_extract(substr(c_name, 10), '^[0-9]+') AS BIGINT), 0) AS i FROM customer"),
    "sql_division": ("SELECT c_custkey, 7/2 AS a, c_custkey / 3 AS b, c_acctbal / 2 AS c FROM customer", "SELECT c_custkey, 3 AS a, c_custkey // 3 AS b, c_acctbal / 2 AS c FROM customer"),
    "sql_group_concat": ("SELECT r_name, group_concat(r_regionkey, '+') AS g, count(*) AS n, avg(r_name) AS m, total((r_regionkey)) AS t FROM region GROUP BY r_name", "SELECT r_name, string_agg(r_regionkey::VARCHAR, '+') AS g, count(*) AS n, 0.0::DOUBLE AS m, sum(r_regionkey)::DOUBLE AS t FROM region GROUP BY r_name"),
    "sql_total": ("SELECT c_nationkey, total(c_custkey) AS t FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, coalesce(sum(c_custkey::DOUBLE), 0) AS t FROM customer GROUP BY c_nationkey"),
    "sql_limit_comma": ("SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 5, 10", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 10 OFFSET 5"),
    "sql_typed_quotient": ("SELECT o_orderkey, (o_orderkey + 1) / 2 AS a, -o_custkey / 3 AS b, o_orderkey * 3 / 2 % 7 AS c, length(o_orderstatus) / 2 AS d, (o_orderkey + 0.5) / 2 AS e, coalesce(o_orderkey / (o_custkey % 2), -1) AS z FROM orders", "SELECT o_orderkey, (o_orderkey + 1) // 2 AS a, -(o_custkey // 3) AS b, o_orderkey * 3 // 2 % 7 AS c, length(o_orderstatus) // 2 AS d, (o_orderkey + 0.5::DOUBLE) / 2 AS e, CASE WHEN o_custkey % 2 = 0 THEN -1 ELSE o_orderkey END AS z FROM orders"),
    "sql_quotient_of_counts": ("SELECT c_nationkey, count(*) / 2 AS half, sum(c_custkey) / count(*) AS mean FROM customer GROUP BY c_nationkey HAVING count(*) / 2 > 1", "SELECT c_nationkey, count(*) // 2 AS half, (sum(c_custkey) // count(*))::BIGINT AS mean FROM customer GROUP BY c_nationkey HAVING count(*) // 2 > 1"),
    "sql_glob": ("SELECT p_partkey FROM part WHERE p_name GLOB '*[a-m]? *' AND p_type NOT GLOB 'econ*'", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?s)^.*[a-m]. .*$') AND NOT regexp_matches(p_type, '(?s)^econ.*$')"),
    "sql_strftime": ("SELECT strftime('%Y-%m', ts) AS month, strftime('%w', ts) AS day, count(*) AS n FROM events GROUP BY strftime('%Y-%m', ts), strftime('%w', ts)", "SELECT strftime(ts, '%Y-%m') AS month, strftime(ts, '%w') AS day, count(*) AS n FROM events GROUP BY 1, 2"),
    "sql_row_of_max": ("SELECT o_custkey, o_orderstatus, max(o_orderkey) AS last FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, max(o_orderkey) AS last FROM orders GROUP BY o_custkey"),
    "sql_text_and_number": ("SELECT c_custkey FROM customer WHERE 'abc' = 0 OR c_mktsegment <> 7 AND c_nationkey = '3' /* one; comment */", "SELECT c_custkey FROM customer WHERE c_mktsegment <> '7' AND c_nationkey = 3"),
    "sql_where_zero": ("SELECT n_name FROM nation WHERE 0", "SELECT n_name FROM nation WHERE false"),
}


def _pass_through(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Environment(spark, {t: table(spark, sf_dir, t) for t in _TABLES}).query(text)


for _name, _text in _SQL.items():
    REGISTRY[_name] = (_pass_through(_text), _text)
for _name, (_text, _oracle) in _SHIMMED.items():
    REGISTRY[_name] = (_pass_through(_text), _oracle)


# Extensions beyond the reference: windows in time, rollups


@register("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, sum(value::DECIMAL(28,6))::DOUBLE AS total FROM events GROUP BY 1, 2")
def ext_tumbling(spark, sf_dir):
    from tessera.streaming.progress import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour")


@register("SELECT b - INTERVAL 30 minute * k AS start, event_type, count(*) AS n, sum(value::DECIMAL(28,6))::DOUBLE AS total FROM (SELECT *, time_bucket(INTERVAL '30 minutes', ts) AS b FROM events), range(2) AS r(k) GROUP BY 1, 2")
def ext_sliding(spark, sf_dir):
    from tessera.streaming.progress import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour", "30 minutes")


@register("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 minute THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def ext_session(spark, sf_dir):
    from tessera.streaming.progress import sessions

    return sessions(table(spark, sf_dir, "events"), "ts", "user_id")


@register("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag)::INT AS g1, grouping(l_linestatus)::INT AS g2 FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}

"""

``queries()`` runs the library (``tierwise``) on the driver's tables.
``oracle_sql()`` restates each query independently, as the original method's
step-by-step window filters with exact distinct counts, in SQL over the same
tables. The two are compared on row count, schema and values.
"""

from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable
from typing import NamedTuple

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from tierwise.plans import catalog  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"


def _llm():
    """The queries module of the llm subpackage; None where the subpackage is not installed."""
    found = importlib.util.find_spec("tierwise.llm")
    if found is None or found.origin is None:
        return None
    return importlib.import_module("tierwise.llm.queries")


def _importable(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query``, with this folder on the Python path of the workers that it starts
    (where the package is installed, they find it anyway)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        here, env = os.path.dirname(os.path.abspath(__file__)), spark.sparkContext.environment
        if here not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(filter(None, (here, env.get("PYTHONPATH"))))
        return query(spark, sf_dir)

    return run


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: modal and latest per customer (re-allocated, GP rule) at sf0.001."""
    return catalog.resolve_realloc(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = dict(catalog.catalogue())
    if (llm := _llm()) is not None:
        found |= {k: _importable(q) for k, q in llm.QUERIES.items()}
        found["pipeline"] = _importable(importlib.import_module("corpus_pipeline").run)
    return found


# --------------------------------------------------------------------------
# Oracle SQL (DuckDB). The lists of the presets are written out here, not taken
# from the library. Mappings M1-M4 are the same CASE expressions as
# tierwise.sources.mappings.

class Policy(NamedTuple):
    name: str
    not_valid: tuple = ()
    other: tuple = ()
    reallocate: bool = True


# The six published presets.
PRESETS = {
    "none": Policy("Not_reallocated", reallocate=False),
    "unknown_only": Policy("Unknown_only", ("99", "X", "-1", "-3")),
    "unknown_any_other": Policy("Unknown_and_any_other_reallocated", ("99", "X", "-1", "-3"), ("S",)),
    "unknown_not_stated": Policy("Unknown_not_stated_only", ("99", "X", "-1", "-3", "Z")),
    "unknown_not_stated_any_other": Policy("Unknown_not_stated_and_any_other_reallocated", ("99", "X", "-1", "-3", "Z"), ("S",)),
    "all": Policy("All_reallocation", ("99", "X", "-1", "-3", "Z"), ("S", "G", "L", "P", "C")),
    "both_lists": Policy("Both_lists", ("99", "Z"), ("Z", "S")),
}
DEFAULT_PRESET = "unknown_not_stated_any_other"
SIX = [p for p in PRESETS if p != "both_lists"]

M1 = """SELECT o_orderkey, o_custkey AS entity,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'G' WHEN '3-MEDIUM' THEN 'S'
            WHEN '4-NOT SPECIFIED' THEN 'Z' ELSE '99' END AS category,
       CAST(year(o_orderdate) AS INT) AS observed_at,
       CASE o_orderstatus WHEN 'F' THEN 'apc' WHEN 'O' THEN 'ae' ELSE 'op' END AS source,
       CAST(o_totalprice > 250000 AS INT) AS flag
FROM orders"""

M1_NULLS = f"""SELECT o_orderkey, entity, CASE WHEN category <> 'Z' THEN category END AS category,
       observed_at, source, flag FROM ({M1}) m1"""


def _m2(null_flags: bool = False) -> str:
    flag = "CAST(l_discount > 0.05 AS INT)"
    if null_flags:
        flag = f"CASE WHEN l_quantity < 10 THEN NULL ELSE {flag} END"
    return f"""SELECT l_orderkey AS entity,
       CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'A' WHEN 'AO' THEN 'G' WHEN 'NF' THEN 'S'
            WHEN 'NO' THEN 'Z' WHEN 'RF' THEN '99' ELSE 'B' END AS category,
       CAST(year(l_shipdate) AS INT) AS observed_at,
       CASE l_linenumber % 4 WHEN 0 THEN 'apc' WHEN 1 THEN 'ae' WHEN 2 THEN 'op' ELSE 'oth' END AS source,
       {flag} AS flag
FROM lineitem"""


M3 = """SELECT event_id, user_id AS entity,
       CASE event_type WHEN 'click' THEN 'A' WHEN 'error' THEN '99' WHEN 'purchase' THEN 'G'
            WHEN 'signup' THEN 'S' ELSE 'Z' END AS category,
       CAST(ts AS DATE) AS observed_at,
       CASE event_id % 3 WHEN 0 THEN 'apc' WHEN 1 THEN 'ae' ELSE 'op' END AS source,
       CAST(value > 10 AS INT) AS flag
FROM events"""

M1_HOT = f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(-1 AS BIGINT) ELSE entity END AS entity,
       category, observed_at, source, flag FROM ({M1}) m1"""

M3_MONTHLY = f"""SELECT event_id, entity, category, CAST(date_trunc('month', observed_at) AS DATE) AS observed_at,
       source, flag FROM ({M3}) m3"""

M4 = """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 40 <> 0 THEN l_orderkey END AS entity,
       CASE l_partkey % 17 WHEN 0 THEN '99' WHEN 1 THEN 'X' WHEN 2 THEN '-1' WHEN 3 THEN '-3' WHEN 4 THEN 'Z'
            WHEN 5 THEN 'S' WHEN 6 THEN 'G' WHEN 7 THEN 'L' WHEN 8 THEN 'P' WHEN 9 THEN 'C' WHEN 10 THEN 'J'
            WHEN 11 THEN 'U' WHEN 12 THEN 'A' WHEN 13 THEN 'B' WHEN 14 THEN 'historic' WHEN 15 THEN NULL ELSE 'A' END AS category,
       CASE WHEN l_linenumber <> 3 THEN CAST(year(l_shipdate) AS INT) END AS observed_at,
       CASE l_suppkey % 5 WHEN 0 THEN 'apc' WHEN 1 THEN 'ae' WHEN 2 THEN 'op' WHEN 3 THEN 'oth' END AS source,
       CASE WHEN l_quantity >= 10 THEN CAST(l_discount > 0.05 AS INT) END AS flag
FROM lineitem"""

SOURCE_RANK = "CASE source WHEN 'apc' THEN 1 WHEN 'ae' THEN 2 WHEN 'op' THEN 3 END"


def _lit_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _tier(preset: str) -> str:
    p = PRESETS[preset]
    top = 2 if p.other else 1
    parts = []
    if p.not_valid:
        parts.append(f"WHEN category IN ({_lit_list(p.not_valid)}) THEN 0")
    if p.other:
        parts.append(f"WHEN category IN ({_lit_list(p.other)}) THEN 1")
    if not parts:
        return str(top)
    return f"CASE {' '.join(parts)} ELSE {top} END"


def _top_rows(src: str, preset: str) -> str:
    """Rows at the entity's highest tier (the re-allocation step)."""
    return f"""SELECT * FROM (SELECT *, {_tier(preset)} AS tier FROM ({src}) s0)
           QUALIFY tier = max(tier) OVER (PARTITION BY entity)"""


def _modal_sql(src: str, preset: str | None) -> str:
    """(entity, modal): count codes at the top tier, ties -> unresolved."""
    rows = _top_rows(src, preset) if preset else f"SELECT * FROM ({src}) s0"
    return f"""WITH k AS ({rows}),
c AS (SELECT entity, category, count(category) AS cnt FROM k GROUP BY entity, category),
mx AS (SELECT entity, max(cnt) AS mc FROM c GROUP BY entity)
SELECT c.entity AS entity,
       CASE WHEN count(DISTINCT c.category) > 1 THEN 'unresolved' ELSE max(c.category) END AS modal
FROM c JOIN mx ON c.entity = mx.entity AND c.cnt = mx.mc
GROUP BY c.entity"""


def _latest_realloc_rows(src: str, preset: str, rule: str) -> str:
    """Records kept by the re-allocated latest method, with their value
    (``latest``); one-code people take their latest date, the others go
    through the source / date / flag filters, then same-day conflicts."""
    if rule == "source":
        multi = f"""m0 AS (SELECT *, {SOURCE_RANK} AS ov FROM nd WHERE nd <> 1),
m1 AS (SELECT * FROM m0 QUALIFY ov = min(ov) OVER (PARTITION BY entity, observed_at)),
m2 AS (SELECT * FROM m1 QUALIFY observed_at = max(observed_at) OVER (PARTITION BY entity)),"""
    elif rule == "flag":
        multi = """m1 AS (SELECT * FROM nd WHERE nd <> 1 QUALIFY observed_at = max(observed_at) OVER (PARTITION BY entity)),
m2 AS (SELECT * FROM m1 QUALIFY flag = max(flag) OVER (PARTITION BY entity, observed_at)),"""
    else:
        multi = """m2 AS (SELECT * FROM nd WHERE nd <> 1 QUALIFY observed_at = max(observed_at) OVER (PARTITION BY entity)),"""
    return f"""WITH k AS ({_top_rows(src, preset)}),
nd AS (SELECT *, count(DISTINCT category) OVER (PARTITION BY entity) AS nd FROM k),
one AS (SELECT * FROM nd WHERE nd = 1 QUALIFY observed_at = max(observed_at) OVER (PARTITION BY entity)),
{multi}
multi AS (SELECT *, CASE WHEN count(DISTINCT category) OVER (PARTITION BY entity, observed_at) > 1
                         THEN 'unresolved' ELSE category END AS latest FROM m2)
SELECT * EXCLUDE (tier, nd), category AS latest FROM one
UNION ALL BY NAME
SELECT * EXCLUDE (tier, nd{', ov' if rule == 'source' else ''}) FROM multi"""


def _latest_plain_rows(src: str, rule: str) -> str:
    """Records kept by the latest method without re-allocation."""
    hes = ""
    if rule == "source":
        hes = "b AS (SELECT * FROM a QUALIFY ov = min(ov) OVER (PARTITION BY entity, observed_at)),"
    else:
        hes = "b AS (SELECT * FROM a),"
    gp = "d AS (SELECT * FROM c),"
    if rule == "flag":
        gp = "d AS (SELECT * FROM c QUALIFY flag = max(flag) OVER (PARTITION BY entity, observed_at)),"
    return f"""WITH a AS (SELECT *, {SOURCE_RANK} AS ov,
       CASE WHEN observed_at = max(observed_at) OVER (PARTITION BY entity) THEN category ELSE 'historic' END AS lt
       FROM ({src}) s0),
{hes}
c AS (SELECT * FROM b WHERE lt <> 'historic'),
{gp}
e AS (SELECT *, CASE WHEN count(DISTINCT lt) OVER (PARTITION BY entity) > 1 THEN 'unresolved' ELSE lt END AS latest FROM d)
SELECT * EXCLUDE (ov, lt) FROM e"""


def _modal_any(src: str, preset: str) -> str:
    """As :func:`_modal_sql`; records without an entity form one group."""
    rows = _top_rows(src, preset) if PRESETS[preset].reallocate else f"SELECT * FROM ({src}) s0"
    return f"""WITH k AS ({rows}),
c AS (SELECT entity, category, count(category) AS cnt FROM k GROUP BY entity, category),
mx AS (SELECT entity, max(cnt) AS mc FROM c GROUP BY entity)
SELECT c.entity AS entity,
       CASE WHEN count(DISTINCT c.category) > 1 THEN 'unresolved' ELSE max(c.category) END AS modal
FROM c JOIN mx ON c.entity IS NOT DISTINCT FROM mx.entity AND c.cnt = mx.mc
GROUP BY c.entity"""


def _latest_plain_any(src: str, rule: str) -> str:
    """As :func:`_latest_plain_rows`, but a real code 'historic' is a code like any other."""
    hes = " QUALIFY ov = min(ov) OVER (PARTITION BY entity, observed_at)" if rule == "source" else ""
    gp = " QUALIFY flag = max(flag) OVER (PARTITION BY entity, observed_at)" if rule == "flag" else ""
    return f"""WITH a AS (SELECT *, {SOURCE_RANK} AS ov, observed_at = max(observed_at) OVER (PARTITION BY entity) AS newest FROM ({src}) s0),
b AS (SELECT * FROM a{hes}),
c AS (SELECT * FROM b WHERE newest AND category IS NOT NULL),
d AS (SELECT * FROM c{gp}),
e AS (SELECT *, CASE WHEN count(DISTINCT category) OVER (PARTITION BY entity) > 1 THEN 'unresolved' ELSE category END AS latest FROM d)
SELECT * EXCLUDE (ov, newest) FROM e"""


def _run_sql(dataset: str, preset: str) -> str:
    rule = {"GP": "flag", "HES": "source", "IAPT": "none"}[dataset]
    src = _clean(M4)
    latest = _latest_realloc_rows(src, preset, rule) if PRESETS[preset].reallocate else _latest_plain_any(src, rule)
    record = "r.l_orderkey AS l_orderkey, r.l_linenumber AS l_linenumber, " if dataset == "GP" else ""
    return f"""SELECT {"" if record else "DISTINCT "}{record}r.entity AS entity, m.modal AS modal, r.latest AS latest
FROM ({latest}) r LEFT JOIN ({_modal_any(src, preset)}) m ON r.entity = m.entity"""


def _latest_pairs(rows_sql: str, count_rows: bool) -> str:
    if count_rows:
        return f"SELECT entity, latest, count(*) AS n_rows FROM ({rows_sql}) r GROUP BY entity, latest"
    return f"SELECT DISTINCT entity, latest FROM ({rows_sql}) r"


def _tier_rows_sql(preset: str) -> str:
    return f"""SELECT category, {_tier(preset)} AS tier, count(*) AS n FROM ({_m2()}) m
GROUP BY category, tier"""


def _top_tier_sql(preset: str) -> str:
    return f"""SELECT entity, category, tier, count(*) AS n_rows FROM ({_top_rows(_m2(), preset)}) t
GROUP BY entity, category, tier"""


def _modal_diag_sql(src: str = M1) -> str:
    return f"""WITH a AS (SELECT *, count(category) OVER (PARTITION BY entity, category) AS count_of_category FROM ({src}) m),
b AS (SELECT *, max(count_of_category) OVER (PARTITION BY entity) AS max_count_of_category FROM a),
c AS (SELECT *, CASE WHEN count_of_category = max_count_of_category THEN category END AS cand FROM b),
d AS (SELECT *, count(DISTINCT cand) OVER (PARTITION BY entity) AS n_tied,
                max(cand) OVER (PARTITION BY entity) AS top FROM c)
SELECT o_orderkey, entity, CASE WHEN n_tied > 1 THEN 'unresolved' ELSE top END AS modal,
       count_of_category, max_count_of_category, n_tied FROM d"""


def _resolve_sql(src: str, preset: str, rule: str) -> str:
    if PRESETS[preset].reallocate:
        modal = _modal_sql(src, preset)
        latest = _latest_pairs(_latest_realloc_rows(src, preset, rule), False)
    else:
        modal = _modal_sql(src, None)
        latest = _latest_pairs(_latest_plain_rows(src, rule), False)
    return f"""SELECT mo.entity AS entity, mo.modal AS modal, la.latest AS latest
FROM ({modal}) mo LEFT JOIN ({latest}) la ON mo.entity = la.entity"""


def _resolve_any(src: str, preset: str, rule: str) -> str:
    """(entity, modal, latest) of records with an entity and a category."""
    if PRESETS[preset].reallocate:
        latest = _latest_realloc_rows(src, preset, rule)
    else:
        latest = _latest_plain_any(src, rule)
    return f"""SELECT mo.entity AS entity, mo.modal AS modal, la.latest AS latest
FROM ({_modal_any(src, preset)}) mo LEFT JOIN ({_latest_pairs(latest, False)}) la ON mo.entity = la.entity"""


def _policies_sql(src: str, rule: str) -> str:
    return " UNION ALL ".join(f"SELECT entity, '{PRESETS[p].name}' AS policy, modal, latest FROM ({_resolve_any(src, p, rule)}) {p}_" for p in SIX)


def _clean(src: str) -> str:
    return f"SELECT * FROM ({src}) s WHERE entity IS NOT NULL AND category IS NOT NULL"


def oracle_sql() -> dict[str, str]:
    d = DEFAULT_PRESET
    realloc = [p for p in SIX if PRESETS[p].reallocate]
    q: dict[str, str] = {}
    for p in SIX:
        q[f"tier_rows_{p}"] = _tier_rows_sql(p)
    for p in SIX:
        q[f"top_tier_{p}"] = _top_tier_sql(p)
    for p in realloc:
        q[f"modal_{p}"] = _modal_sql(M1, p)
    q["modal_small_groups"] = _modal_sql(_m2(), d)
    q["modal_attached"] = f"""SELECT m.o_orderkey AS o_orderkey, m.entity AS entity, x.modal AS modal
FROM ({M1}) m LEFT JOIN ({_modal_sql(M1, d)}) x ON m.entity = x.entity"""
    q["modal_no_realloc"] = _modal_sql(M1, None)
    q["modal_no_realloc_diag"] = _modal_diag_sql()
    for p in realloc:
        q[f"latest_{p}"] = _latest_pairs(_latest_realloc_rows(_m2(), p, "none"), False)
    q["latest_source"] = _latest_pairs(_latest_realloc_rows(_m2(), d, "source"), False)
    q["latest_flag"] = _latest_pairs(_latest_realloc_rows(_m2(True), d, "flag"), True)
    q["latest_no_realloc"] = _latest_pairs(_latest_plain_rows(_m2(), "none"), False)
    q["latest_no_realloc_source"] = _latest_pairs(_latest_plain_rows(_m2(), "source"), False)
    q["latest_no_realloc_flag"] = _latest_pairs(_latest_plain_rows(_m2(True), "flag"), True)
    q["latest_events_daily"] = _latest_pairs(_latest_realloc_rows(M3, d, "none"), False)
    q["latest_events_source"] = _latest_pairs(_latest_realloc_rows(M3, d, "source"), False)
    q["latest_record_source"] = f"""SELECT entity, max(o_orderkey) AS o_orderkey, latest
FROM ({_latest_realloc_rows(M1, d, "source")}) r GROUP BY entity, latest"""
    q["resolve_realloc"] = _resolve_sql(M1, d, "flag")
    q["resolve_no_realloc"] = _resolve_sql(M1, "none", "source")
    q["resolve_after_prepare"] = _resolve_sql(_clean(M1_NULLS), d, "source")
    q["dedupe_flag_supplier"] = f"""SELECT entity, o_orderkey, latest FROM ({_latest_realloc_rows(M1, d, "flag")}) r
QUALIFY row_number() OVER (PARTITION BY entity ORDER BY
    CASE source WHEN 'apc' THEN 0 WHEN 'ae' THEN 1 WHEN 'op' THEN 2 ELSE 3 END, o_orderkey) = 1"""
    q["prepare_drop_nulls"] = f"""SELECT entity, category, count(*) AS n FROM ({_clean(M1_NULLS)}) c
GROUP BY entity, category"""
    pol = PRESETS[d]
    nv = "[" + ", ".join(f"''{v}''" for v in pol.not_valid) + "]"
    ot = "[" + ", ".join(f"''{v}''" for v in pol.other) + "]"
    q["policy_manifest"] = f"""SELECT * FROM (VALUES
  ('GP', '{pol.name}', 'Not valid list', '{nv}', ''),
  ('GP', '{pol.name}', 'Other list', '{ot}', ''),
  ('GP', '{pol.name}', 'Name of run', '{pol.name}', '')) v("Datasource", "Reallocation", "Name", "Counts", "Comments")
UNION ALL
SELECT 'GP', '{pol.name}', 'Rows removed by prepare', CAST(count(*) AS VARCHAR), ''
FROM ({M1_NULLS}) m WHERE entity IS NULL OR category IS NULL"""
    q["modal_vs_latest_matrix"] = f"""SELECT modal, latest, count(*) AS n FROM ({_resolve_sql(M1, d, "flag")}) r
GROUP BY modal, latest"""
    q["top_tier_records"] = f"SELECT o_orderkey, entity, category, tier FROM ({_top_rows(M1, d)}) t"
    q["modal_attached_no_realloc"] = f"""SELECT m.o_orderkey AS o_orderkey, m.entity AS entity, x.modal AS modal
FROM ({M1}) m LEFT JOIN ({_modal_sql(M1, None)}) x ON m.entity IS NOT DISTINCT FROM x.entity"""
    q["latest_flag_records"] = f"SELECT o_orderkey, entity, latest FROM ({_latest_realloc_rows(M1, d, 'flag')}) r"
    q["latest_no_realloc_flag_records"] = f"SELECT o_orderkey, entity, latest FROM ({_latest_plain_rows(M1, 'flag')}) r"
    q["modal_events"] = _modal_sql(M3, d)
    q["latest_events_flag"] = _latest_pairs(_latest_realloc_rows(M3, d, "flag"), True)
    q["latest_events_no_realloc"] = _latest_pairs(_latest_plain_rows(M3, "none"), False)
    q["latest_events_monthly"] = _latest_pairs(_latest_realloc_rows(M3_MONTHLY, d, "none"), False)
    q["modal_attached_hot"] = f"""SELECT m.o_orderkey AS o_orderkey, m.entity AS entity, x.modal AS modal
FROM ({M1_HOT}) m LEFT JOIN ({_modal_sql(M1_HOT, d)}) x ON m.entity = x.entity"""
    q["latest_flag_records_hot"] = f"SELECT o_orderkey, entity, latest FROM ({_latest_realloc_rows(M1_HOT, d, 'flag')}) r"
    q["latest_source_diag"] = f"""SELECT r.entity AS entity, r.latest AS latest, t.tier AS tier,
       t.n_codes AS n_codes, t.max_date AS max_date
FROM ({_latest_pairs(_latest_realloc_rows(_m2(), d, "source"), False)}) r
JOIN (SELECT entity, max(tier) AS tier, count(DISTINCT category) AS n_codes, max(observed_at) AS max_date
      FROM ({_top_rows(_m2(), d)}) k GROUP BY entity) t ON r.entity = t.entity"""
    q["modal_null_codes"] = _modal_sql(M1_NULLS, d)
    q["latest_record_no_realloc_source"] = f"""SELECT entity, max(o_orderkey) AS o_orderkey, latest
FROM ({_latest_plain_rows(M1, "source")}) r GROUP BY entity, latest"""
    q["top_tier_records_null_codes"] = f"SELECT o_orderkey, entity, category, tier FROM ({_top_rows(M1_NULLS, d)}) t"
    q["latest_null_codes_source"] = _latest_pairs(_latest_realloc_rows(M1_NULLS, d, "source"), False)
    q["latest_no_realloc_null_codes"] = _latest_pairs(_latest_plain_rows(M1_NULLS, "none"), False)
    for rule in ("none", "source", "flag"):
        q[f"resolve_small_groups_{rule}"] = _resolve_sql(_m2(), d, rule)
        q[f"resolve_small_groups_no_realloc_{rule}"] = _resolve_sql(_m2(), "none", rule)
    q["top_tier_hot"] = f"SELECT o_orderkey, entity, category, tier FROM ({_top_rows(M1_HOT, d)}) t"
    q["modal_no_realloc_diag_hot"] = _modal_diag_sql(M1_HOT)
    for p in PRESETS:
        other = f"CAST(category IN ({_lit_list(PRESETS[p].other)}) AS INT)" if PRESETS[p].other else "0"
        q["tiers_both_lists" if p == "both_lists" else f"tiers_all_codes_{p}"] = f"""SELECT category, {_tier(p)} AS tier,
       coalesce({other}, 0) AS is_other, count(*) AS n FROM ({M4}) m GROUP BY ALL"""
    q["top_tier_all_codes"] = f"""SELECT l_orderkey, l_linenumber, entity, category, tier,
       coalesce(CAST(category IN ({_lit_list(PRESETS["all"].other)}) AS INT), 0) AS is_other FROM ({_top_rows(M4, "all")}) t"""
    for p in realloc:
        q[f"modal_all_codes_{p}"] = _modal_any(M4, p)
        q[f"latest_all_codes_{p}"] = _latest_pairs(_latest_realloc_rows(M4, p, "none"), False)
    q["modal_all_codes_none"] = _modal_any(M4, "none")
    for name, p, same in (("modal_attached_all_codes", d, "="), ("modal_attached_no_realloc_all_codes", "none", "IS NOT DISTINCT FROM")):
        q[name] = f"""SELECT m.l_orderkey AS l_orderkey, m.l_linenumber AS l_linenumber, m.entity AS entity, x.modal AS modal
FROM ({M4}) m LEFT JOIN ({_modal_any(M4, p)}) x ON m.entity {same} x.entity"""
    for rule in ("none", "source", "flag"):
        q[f"latest_no_realloc_all_codes_{rule}"] = _latest_pairs(_latest_plain_any(M4, rule), False)
        if rule != "none":
            q[f"latest_all_codes_rule_{rule}"] = _latest_pairs(_latest_realloc_rows(M4, d, rule), False)
    for dataset in ("GP", "HES", "IAPT"):
        q[f"run_{dataset.lower()}"] = _run_sql(dataset, d)
        q[f"run_{dataset.lower()}_no_realloc"] = _run_sql(dataset, "none")
    text_dates = f"SELECT * REPLACE (strftime(observed_at, '%Y-%m-%d') AS observed_at) FROM ({M3}) m3"
    nan_dates = f"""SELECT * REPLACE (CASE WHEN l_linenumber = 5 THEN 'NaN'::DOUBLE ELSE CAST(observed_at AS DOUBLE) END AS observed_at)
FROM ({M4}) m4"""
    for rule in ("none", "source", "flag"):
        q[f"policies_compared_{rule}"] = _policies_sql(_clean(M4), rule)
        q[f"resolve_summary_{rule}"] = _resolve_any(_clean(M4), d, rule)
        q[f"resolve_summary_no_realloc_{rule}"] = _resolve_any(_clean(M4), "none", rule)
        q[f"latest_text_dates_{rule}"] = _latest_pairs(_latest_realloc_rows(text_dates, d, rule), False)
        q[f"latest_nan_dates_{rule}"] = _latest_pairs(_latest_realloc_rows(nan_dates, d, rule), False)
    q["policies_compared_orders"] = _policies_sql(M1, "flag")
    q["latest_text_dates_no_realloc"] = _latest_pairs(_latest_plain_any(text_dates, "source"), False)
    q["latest_nan_dates_no_realloc"] = _latest_pairs(_latest_plain_any(nan_dates, "flag"), False)
    q["resolve_merged_batches"] = _resolve_any(_clean(M4), d, "flag")
    q["merged_batch_counts"] = f"""SELECT count(*) AS n_records, count(*) FILTER (WHERE entity IS NULL OR category IS NULL) AS n_removed,
       count(*) FILTER (WHERE category = 'unresolved') AS n_sentinel FROM ({M4}) m4"""
    q["read_by_name"] = _modal_sql(M1, d)
    if (llm := _llm()) is not None:
        q |= llm.ORACLE_SQL
    return q

"""ANSI SQL for the registered queries, run by another engine on the same tables.

The statements are written from the definitions and share no code with the
operators: items are ranked and summed one by one where the operators use the
spectrum, and regressions are solved by sweeping a table of cross-products.
"""

from __future__ import annotations

from tallyframe.operators.models import Model
from tallyframe.plans import model_list

ORACLES: dict[str, str] = {}


def r(expression: str, name: str | None = None) -> str:
    """Rounded like the queries."""
    text = f"round(CAST({expression} AS DOUBLE), 6) + 0.0"
    return f"CAST({text} AS DOUBLE) AS {name or expression}"


def n(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


# --- shared common table expressions -------------------------------------------

CTES: dict[str, str] = {}

CTES["parts"] = """
  SELECT p_partkey, p_type, p_size, split_part(p_name, ' ', 2) AS genus,
         split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS sciname,
         CASE WHEN split_part(p_name, ' ', 2) IN ('anvil', 'bolt') THEN 'O1'
              WHEN split_part(p_name, ' ', 2) IN ('gear', 'gizmo', 'plate') THEN 'O2'
              WHEN split_part(p_name, ' ', 2) IN ('ring', 'rod') THEN 'O3'
              WHEN split_part(p_name, ' ', 2) = 'widget' THEN 'O4' END AS preyorder
  FROM part"""
CTES["items"] = """
  SELECT l_suppkey AS DataSet, level AS IDLevel,
         CASE preyorder WHEN 'O3' THEN 'Aves' WHEN 'O4' THEN 'Insecta' ELSE 'Mammalia' END AS PreyClass,
         preyorder AS PreyOrder, prey AS PreyScientificName, CAST(sum(quantity) AS BIGINT) AS CountInt
  FROM (SELECT l_suppkey, preyorder, CAST(l_quantity AS BIGINT) AS quantity,
               CASE WHEN l_linenumber % 7 = 0 THEN 'Genus' ELSE 'Species' END AS level,
               CASE WHEN l_linenumber % 7 = 0 THEN genus || ' sp' ELSE sciname END AS prey
        FROM lineitem JOIN parts ON l_partkey = p_partkey)
  GROUP BY ALL"""
CTES["traits"] = """
  SELECT sciname, genus, avg(p_size) AS mass, arg_min(p_type, p_partkey) AS family
  FROM parts GROUP BY sciname, genus"""
CTES["enriched"] = """
  SELECT i.*, coalesce(g.mass, t.mass) AS PreyMass, t.family AS PreyFamily
  FROM items i LEFT JOIN traits t ON PreyScientificName = t.sciname
  LEFT JOIN (SELECT genus || ' sp' AS label, avg(mass) AS mass FROM traits GROUP BY genus) g
         ON PreyScientificName = g.label"""
CTES["meta"] = """
  SELECT s_suppkey AS DataSet, r_name || ' ' || n_name AS RaptorScientificName, n_name AS Continent,
         (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS Num_obs,
         CASE WHEN s_suppkey % 4 <> 0 THEN CAST(1 + s_suppkey % 5 AS DOUBLE) END AS PreyPerPellet,
         r_name AS ecozone
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
CTES["cells"] = """
  SELECT s_suppkey AS DataSet, CASE WHEN s_suppkey % 10 <> 7 THEN CAST(s_nationkey AS BIGINT) END AS POLYFID
  FROM supplier"""
CTES["layers"] = """
  SELECT layer, POLYFID, species FROM (
    SELECT c_mktsegment AS layer, CAST(c_nationkey AS BIGINT) AS POLYFID, count(*) AS species
    FROM customer GROUP BY ALL)
  WHERE (POLYFID + CASE layer WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3
                              WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END) % 6 <> 0
  UNION ALL SELECT 'ALL', CAST(c_nationkey AS BIGINT), count(*) FROM customer GROUP BY c_nationkey
  UNION ALL SELECT 'SUPPLIERS', CAST(s_nationkey AS BIGINT), count(*) FROM supplier GROUP BY s_nationkey
  UNION ALL SELECT 'EVEN', CAST(c_nationkey AS BIGINT), count(*) FROM customer GROUP BY c_nationkey
            HAVING count(*) % 2 = 0"""
CTES["rich"] = """
  SELECT DataSet,
    (SELECT max(species) FROM layers l WHERE layer = 'ALL' AND l.POLYFID = c.POLYFID) AS LocalRichness,
    (SELECT max(species) FROM layers l WHERE layer = 'SUPPLIERS' AND l.POLYFID = c.POLYFID) AS RERichness,
    (SELECT max(species) FROM layers l WHERE layer = 'MACHINERY' AND l.POLYFID = c.POLYFID) AS RaptorRichness
  FROM cells c"""
CTES["obs"] = """
  SELECT p_partkey AS obs_id, preyorder AS "Order", CAST(p_size AS DOUBLE) AS BodyMass,
         log10(p_size) AS LogMass, log10(q) AS LogDensity
  FROM parts JOIN (SELECT l_partkey, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY l_partkey)
    ON p_partkey = l_partkey
  WHERE p_size > 0 AND q > 0"""
CTES["lines"] = """
  SELECT "Order", regr_slope(LogDensity, LogMass) AS slope, regr_intercept(LogDensity, LogMass) AS intercept,
         regr_count(LogDensity, LogMass) AS n
  FROM obs GROUP BY "Order" """
CTES["matches_all"] = """
  SELECT g.DataSet, g.label, s.PreyScientificName AS name, s.c AS name_count, g.c AS genus_count
  FROM (SELECT DataSet, PreyScientificName AS label, sum(CountInt) AS c FROM items
        WHERE IDLevel = 'Genus' GROUP BY ALL) g
  JOIN (SELECT DataSet, PreyScientificName, sum(CountInt) AS c FROM items GROUP BY ALL) s
    ON g.DataSet = s.DataSet AND contains(s.PreyScientificName, split_part(g.label, ' ', 1))
   AND s.PreyScientificName <> g.label"""
CTES["shared"] = """
  SELECT i.DataSet, i.IDLevel, i.PreyClass, i.PreyOrder, i.PreyScientificName, i.PreyMass,
         CAST(i.CountInt + coalesce((
           SELECT sum(round_even(CAST(m.genus_count AS DOUBLE) * i.CountInt / CAST(t.total AS DOUBLE), 0))
           FROM matches_all m JOIN label_totals t ON m.DataSet = t.DataSet AND m.label = t.label
           WHERE m.DataSet = i.DataSet AND m.name = i.PreyScientificName), 0) AS BIGINT) AS CountInt
  FROM enriched i
  WHERE NOT (i.IDLevel = 'Genus' AND EXISTS (
    SELECT 1 FROM label_totals t WHERE t.DataSet = i.DataSet AND t.label = i.PreyScientificName))"""
CTES["prey"] = """
  SELECT s.*, log10(PreyMass) AS LogMass, intercept + slope * log10(PreyMass) AS LogDensity,
         exp(intercept + slope * log10(PreyMass)) AS Density
  FROM shared s JOIN lines l ON s.PreyOrder = l."Order"
  WHERE PreyClass = 'Mammalia' AND PreyMass <> 0"""
CTES["ranked"] = """
  SELECT * EXCLUDE (level), row_number() OVER (PARTITION BY DataSet ORDER BY level, PreyScientificName) AS DensRank,
         row_number() OVER (PARTITION BY DataSet ORDER BY CountInt, level, PreyScientificName) AS CountRank,
         row_number() OVER (PARTITION BY DataSet ORDER BY PreyMass, CountInt, level, PreyScientificName) AS MassRank
  FROM (SELECT *, round(ln(Density), 9) AS level FROM prey)"""
CTES["totals"] = """
  SELECT p.DataSet, sum(CountInt) AS diet_count, count(*) AS diet_prey,
         sum(CountInt * PreyMass) / sum(CountInt) AS diet_mass, any_value(PreyPerPellet) AS diet_p
  FROM prey p JOIN meta m ON p.DataSet = m.DataSet GROUP BY p.DataSet"""
CTES["tested"] = """
  SELECT p.*, (diet_mass - CAST(CountInt AS DOUBLE) / diet_count * PreyMass) * diet_p AS ne_disc
  FROM prey p JOIN totals t ON p.DataSet = t.DataSet
  WHERE diet_count > 20 AND diet_prey > 1 AND diet_p IS NOT NULL"""
CTES["tests"] = """
  SELECT DataSet, PreyScientificName, cand_h, PreyMass / cand_h AS ne_prey, ne_disc,
         PreyMass / cand_h - ne_disc AS diff, PreyMass / cand_h > ne_disc AS passes
  FROM tested, (SELECT unnest([0.01::DOUBLE, 0.02, 0.04, 0.08, 0.16, 0.5, 0.9]) AS cand_h)"""
CTES["curve"] = """
  SELECT DataSet, PreyScientificName, CountInt,
         row_number() OVER w AS rank,
         sum(CountInt) OVER w AS upto,
         sum(CountInt) OVER (PARTITION BY DataSet) AS total,
         count(*) OVER (PARTITION BY DataSet) AS n
  FROM items WINDOW w AS (PARTITION BY DataSet ORDER BY CountInt DESC, PreyScientificName
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
CTES["label_totals"] = """
  SELECT DataSet, label, sum(name_count) AS total FROM matches_all GROUP BY ALL HAVING sum(name_count) > 0"""


def mixed_steps(source: str, x: str, out: str) -> str:
    """``x`` hashed to ``out``, one intermediate column per step."""
    a = f"(SELECT *, xor(x0, x0 >> 16) AS x1 FROM (SELECT *, ({x}) & 4294967295 AS x0 FROM {source}))"
    b = f"(SELECT *, CAST((CAST(x1 AS HUGEINT) * 2146121005) % 4294967296 AS BIGINT) AS x2 FROM {a})"
    c = f"(SELECT *, xor(x2, x2 >> 15) AS x3 FROM {b})"
    e = f"(SELECT *, CAST((CAST(x3 AS HUGEINT) * 2221713035) % 4294967296 AS BIGINT) AS x4 FROM {c})"
    return f"(SELECT * EXCLUDE (x0, x1, x2, x3, x4), xor(x4, x4 >> 16) AS {out} FROM {e})"


def draws(m: int, reps: int, seed: int = 1, curve: str = "curve") -> str:
    """SELECT of (DataSet, rep, draw, rank, PreyScientificName)."""
    base = f"""(SELECT DataSet, total, i, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS a,
      CAST('0x' || substr(h, 9, 8) AS BIGINT) AS b
      FROM (SELECT DataSet, max(total) AS total, md5(DataSet || '|{seed}') AS h FROM {curve} GROUP BY DataSet),
           (SELECT unnest(range({m * reps})) AS i))"""
    step = mixed_steps(base, "i + a", "h1")
    step = mixed_steps(step, "h1 + b", "high")
    step = mixed_steps(step, "i + b", "l1")
    step = mixed_steps(step, "l1 + a", "low")
    return f"""SELECT d.DataSet, i // {m} + 1 AS rep, i % {m} + 1 AS draw, c.rank, c.PreyScientificName
      FROM (SELECT *, floor(((high >> 6) * 67108864 + (low >> 6)) / 4503599627370496.0::DOUBLE * total) AS pos
            FROM {step}) d
      ASOF JOIN (SELECT *, CAST(upto - CountInt AS DOUBLE) AS before FROM {curve} WHERE CountInt > 0) c
        ON d.DataSet = c.DataSet AND d.pos >= c.before"""


def rare_sql(m: int, reps: int, curve: str = "curve") -> str:
    """SELECT of (DataSet, rare_richness, rare_entropy, rare_top_frequency)."""
    return f"""SELECT DataSet, avg(types) AS rare_richness, avg(entropy) AS rare_entropy, max(top) AS rare_top_frequency
      FROM (SELECT DataSet, rep, count(*) AS types, -sum(k / {m}.0 * ln(k / {m}.0)) AS entropy, max(k) / {m}.0 AS top
            FROM (SELECT DataSet, rep, rank, CAST(count(*) AS DOUBLE) AS k FROM ({draws(m, reps, curve=curve)})
                  GROUP BY ALL) GROUP BY ALL) GROUP BY DataSet"""


def p_value(t: str, df: str) -> str:
    """Two-sided t probability by Simpson's rule on the angle atan(t / sqrt(df))."""
    k = 400
    return f"""(CASE WHEN {t} IS NULL OR {df} < 1 THEN NULL ELSE 1 - 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi())
      * atan(abs({t}) / sqrt({df})) / {3 * k} * list_sum(list_transform(range({k + 1}), lambda s:
        (CASE WHEN s IN (0, {k}) THEN 1 WHEN s % 2 = 1 THEN 4 ELSE 2 END)
        * pow(cos(atan(abs({t}) / sqrt({df})) * s / {k}), {df} - 1))) END)"""


CTES["slopes"] = f"""
  SELECT DataSet, dens_slopes, intercept, n, {p_value('t', '(n - 2)')} AS pval_dens
  FROM (SELECT *, CASE WHEN n > 2 AND abs(dens_slopes) < 1
                       THEN dens_slopes * sqrt((n - 2) / (1 - dens_slopes * dens_slopes)) END AS t
        FROM (SELECT DataSet, regr_slope(CountRank, DensRank) AS dens_slopes,
                     regr_intercept(CountRank, DensRank) AS intercept, count(*) AS n
              FROM ranked GROUP BY DataSet))"""
CTES["sums"] = """
  SELECT DataSet, sum(CountInt) AS numb_prey, count(*) AS numb_prey_spp, sum(Density) AS sum_R,
         min(PreyMass) AS smallest_prey_mass, max(PreyMass) AS largest_prey_mass,
         max(CASE WHEN CountRank = k THEN PreyMass END) AS mass_of_most_common,
         max(CASE WHEN big = 1 THEN CountInt END) / sum(CountInt) AS obs_largest_prey_freq,
         max(CASE WHEN small = 1 THEN CountInt END) / sum(CountInt) AS obs_smallest_prey_freq,
         1 / (1 + coalesce(sum(CASE WHEN PreyMass < top THEN Density END), 0)
                / max(CASE WHEN big = 1 THEN Density END)) AS pred_largest_prey_freq,
         CAST(bool_and((CountInt = top_count) = (PreyMass = top)) AS BIGINT) AS IsTopPreyBiggest,
         CAST(bool_and((CountInt = top_count) = (Density = top_density)) AS BIGINT) AS IsTopPreyMostDense
  FROM (SELECT *, count(*) OVER d AS k, max(PreyMass) OVER d AS top, max(CountInt) OVER d AS top_count,
               max(Density) OVER d AS top_density,
               row_number() OVER (PARTITION BY DataSet ORDER BY PreyMass DESC, PreyScientificName) AS big,
               row_number() OVER (PARTITION BY DataSet ORDER BY PreyMass, PreyScientificName) AS small
        FROM ranked WINDOW d AS (PARTITION BY DataSet))
  GROUP BY DataSet"""
CTES["birds"] = """
  SELECT m.DataSet, coalesce(sum(CASE WHEN PreyClass = 'Aves' THEN CountInt ELSE 0 END) / CAST(sum(CountInt) AS DOUBLE), 0)
         AS FreqBirds
  FROM meta m LEFT JOIN items i ON m.DataSet = i.DataSet GROUP BY m.DataSet"""


def foraging_rows(h: float) -> str:
    return f"""SELECT m.*, numb_prey, numb_prey_spp, sum_R, smallest_prey_mass, largest_prey_mass,
      mass_of_most_common AS mass_of_most_common_dropones, largest_prey_mass - smallest_prey_mass AS mass_range,
      CASE WHEN PreyPerPellet IS NOT NULL THEN -PreyPerPellet / (PreyPerPellet * sum_R * ({h} - 1)) END AS baow_a,
      dens_slopes, pval_dens, obs_largest_prey_freq, obs_smallest_prey_freq, pred_largest_prey_freq,
      IsTopPreyBiggest, IsTopPreyMostDense,
      diet_mass * diet_p AS NE_intake, NumPos, FreqBirds
    FROM meta m JOIN sums USING (DataSet) JOIN slopes USING (DataSet) JOIN totals USING (DataSet)
    JOIN birds USING (DataSet)
    LEFT JOIN (SELECT DataSet, count(*) FILTER (WHERE PreyMass / {h} - ne_disc < 0) AS NumPos
               FROM tested GROUP BY DataSet) USING (DataSet)
    WHERE Num_obs > 20 AND numb_prey > 20"""


FORAGING_DOUBLES = [
    "PreyPerPellet", "sum_R", "smallest_prey_mass", "largest_prey_mass", "mass_of_most_common_dropones", "mass_range",
    "baow_a", "dens_slopes", "pval_dens", "obs_largest_prey_freq", "obs_smallest_prey_freq",
    "pred_largest_prey_freq", "NE_intake", "FreqBirds"]
FORAGING_WHOLE = ["Num_obs", "numb_prey", "numb_prey_spp", "IsTopPreyBiggest", "IsTopPreyMostDense", "NumPos"]
FORAGING_OUT = ", ".join(
    ["DataSet", "RaptorScientificName", "Continent", "ecozone"]
    + [r(c) for c in FORAGING_DOUBLES] + [n(c, c) for c in FORAGING_WHOLE])

MODEL_COLUMNS = ", ".join(
    ["DataSet", "RaptorScientificName", "Continent", "ecozone"]
    + [f"CAST({c} AS DOUBLE) AS {c}" for c in FORAGING_DOUBLES] + [n(c, c) for c in FORAGING_WHOLE])
CTES["model_table"] = f"""
  SELECT {MODEL_COLUMNS}, rare_entropy AS ShannEnt_rare, rare_richness AS DietRichness_rare,
         LocalRichness, RERichness, RaptorRichness, log10(RERichness) AS l_re,
         log10(numb_prey_spp) AS l_ns, ln(LocalRichness) AS log_LocalRichness, ln(sum_R) AS log_sum_R,
         ln(numb_prey_spp) AS log_numb_prey_spp, CASE WHEN NE_intake > 0 THEN ln(NE_intake) END AS log_NE_intake
  FROM ({foraging_rows(0.16)}) LEFT JOIN ({rare_sql(100, 200)}) USING (DataSet) LEFT JOIN rich USING (DataSet)"""

DEPENDS = {
    "parts": [], "items": ["parts"], "traits": ["parts"], "enriched": ["items", "traits"], "meta": [],
    "cells": [], "layers": [], "rich": ["cells", "layers"], "obs": ["parts"], "lines": ["obs"],
    "matches_all": ["items"], "label_totals": ["matches_all"], "shared": ["enriched", "matches_all", "label_totals"],
    "prey": ["shared", "lines"], "ranked": ["prey"], "totals": ["prey", "meta"], "tested": ["prey", "totals"],
    "tests": ["tested"], "curve": ["items"], "slopes": ["ranked"], "sums": ["ranked"], "birds": ["meta", "items"],
    "model_table": ["meta", "sums", "slopes", "totals", "birds", "tested", "curve", "rich"],
}


def with_tables(*names: str) -> str:
    """WITH clause of the named tables and all they read, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for needed in DEPENDS[name]:
                visit(needed)
            order.append(name)

    for name in names:
        visit(name)
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in order)


def oracle(name: str, uses: str, select: str) -> None:
    head = with_tables(*uses.split()) + "\n" if uses else ""
    ORACLES[name] = head + select


# --- sources and sinks -----------------------------------------------------------

oracle("read_table", "", f"""SELECT p_partkey, p_name, p_brand, p_type, {n('p_size', 'p_size')},
  {r('p_retailprice')} FROM part""")
oracle("read_richness_layers", "layers", "SELECT layer, POLYFID, species FROM layers")
oracle("read_sheet_export", "meta", "SELECT DataSet, PreyPerPellet FROM meta")
oracle("parse_na", "items", """SELECT DataSet, PreyScientificName,
    CASE WHEN CountInt % 10 = 0 THEN 'NA' ELSE CAST(CountInt AS VARCHAR) END AS "Count",
    CASE WHEN CountInt % 10 <> 0 THEN CountInt END AS CountInt
  FROM items WHERE CountInt % 10 = 0 OR CountInt % 11 <> 0""")
oracle("write_table", "items", "SELECT * FROM items")
oracle("reload_stage", "meta", "SELECT * FROM meta")

# --- projections, filters, scalar expressions --------------------------------------

oracle("select_rename", "items", "SELECT DataSet AS diet, PreyScientificName AS prey, CountInt AS n FROM items")
oracle("drop_missing", "meta", "SELECT DataSet, PreyPerPellet FROM meta WHERE PreyPerPellet IS NOT NULL")
oracle("exclude_values", "items", "SELECT * FROM items WHERE PreyOrder <> 'O4' AND DataSet <> 5")
oracle("keep_id_levels", "items", "SELECT * FROM items WHERE IDLevel = 'Genus'")
oracle("contains_filter", "meta", "SELECT * FROM meta WHERE RaptorScientificName LIKE '%NATION\\_1%' ESCAPE '\\'")
oracle("threshold_filters", "meta", f"""SELECT *, Num_obs % 3 AS remainder FROM meta
  WHERE Num_obs > 20 AND DataSet > 3 AND Num_obs % 3 <> 0""")
oracle("log_transforms", "", f"""SELECT p_partkey,
  {r('CASE WHEN p_size > 10 THEN log10(p_size - 10) END', 'log10_size')}, {r('ln(p_retailprice)', 'ln_price')},
  {r('exp(p_size / 50.0)', 'exp_size')}, {n('-p_size', 'negated')}, {n('abs(p_size - 25)', 'distance')} FROM part""")
oracle("normalise_name", "", "SELECT p_partkey, replace(p_name, ' ', '_') AS name FROM part")
oracle("genus_label", "parts", "SELECT p_partkey, genus || ' sp' AS label FROM parts")
oracle("genus_of", "items", """SELECT DataSet, PreyScientificName, split_part(PreyScientificName, ' ', 1) AS genus
  FROM items""")
oracle("remap_names", "items", f"""SELECT DataSet, name AS PreyScientificName, {n('sum(CountInt)', 'TotalSum')}
  FROM (SELECT DataSet, CountInt, CASE PreyScientificName WHEN 'anvil blue' THEN 'bolt blue'
          WHEN 'bolt blue' THEN 'bolt small' WHEN 'gear sp' THEN 'gizmo sp' WHEN 'rod hot' THEN 'rod cold'
          ELSE PreyScientificName END AS name FROM items) GROUP BY ALL""")
oracle("level_codes", "items", """SELECT DataSet, PreyClass, PreyOrder, PreyScientificName,
  dense_rank() OVER (ORDER BY PreyOrder) AS order_code, dense_rank() OVER (ORDER BY PreyScientificName) AS item_code,
  CAST(CASE PreyClass WHEN 'Insecta' THEN 1 WHEN 'Aves' THEN 2 END AS BIGINT) AS class_code FROM items""")
_flag = ", ".join(f"max(CASE WHEN o_orderpriority LIKE '{i}-%' THEN 'X' END) AS flag_{i}" for i in range(1, 6))
oracle("count_flags", "", f"""SELECT o_custkey AS DataSet, {_flag},
  count(DISTINCT o_orderpriority) AS NumHabs FROM orders GROUP BY o_custkey""")
oracle("functional_response", "meta", f"""SELECT DataSet,
  {r('PreyPerPellet / 1000 * Num_obs / (1 + 0.02 * PreyPerPellet / 1000 * Num_obs)', 'rate')} FROM meta""")
oracle("unit_scale", "meta", f"SELECT DataSet, {r('PreyPerPellet / 7', 'rate')} FROM meta")

# --- joins and look-ups ---------------------------------------------------------------

oracle("lookup_first", "items parts", f"""SELECT DataSet, PreyScientificName,
  {r('(SELECT arg_min(p_size, p_partkey) FROM parts WHERE sciname = PreyScientificName)', 'PreyMass')} FROM items""")
for _name in ("lookup_mean", "lookup_unique"):
    oracle(_name, "items traits", f"""SELECT DataSet, PreyScientificName, {r('mass', 'PreyMass')}
      FROM items LEFT JOIN traits ON sciname = PreyScientificName""")
oracle("lookup_chain", "enriched", f"SELECT DataSet, PreyScientificName, {r('PreyMass')} FROM enriched")
oracle("family_lookup", "enriched", "SELECT DataSet, PreyScientificName, PreyFamily FROM enriched")
_predators = """(SELECT n_name, count(*) AS RangeSize, avg(c_acctbal) AS EqSplit, max(c_acctbal) AS FairProp
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)"""
oracle("raptor_traits", "meta", f"""SELECT DataSet, Continent AS Species, {r('RangeSize')}, {r('EqSplit')}, {r('FairProp')}
  FROM meta LEFT JOIN {_predators} ON Continent = n_name""")


def _layer(name: str, fill: str | None = None) -> str:
    value = f"(SELECT max(species) FROM layers l WHERE layer = '{name}' AND l.POLYFID = c.POLYFID)"
    return n(f"coalesce({value}, {fill})" if fill else value, f'"{name}"')


_segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
oracle("cell_richness", "cells layers", "SELECT DataSet, "
       + ", ".join(_layer(x) for x in [*_segments, "ALL", "SUPPLIERS", "EVEN"]) + " FROM cells c")
oracle("cell_richness_filled", "cells layers",
       "SELECT DataSet, " + ", ".join(_layer(x, "0") for x in _segments) + " FROM cells c")
_climate = """(SELECT l_suppkey, avg(l_discount) AS Temp, avg(l_tax) AS Seasonality, avg(l_quantity) AS AnnPrecip,
  avg(l_extendedprice) AS PrecipSeason FROM lineitem GROUP BY l_suppkey)"""
_entropy = """(SELECT DataSet, -sum(f * ln(f)) AS entropy, count(*) AS richness FROM (
  SELECT DataSet, CountInt / CAST(sum(CountInt) OVER (PARTITION BY DataSet) AS DOUBLE) AS f FROM items) GROUP BY DataSet)"""
oracle("attach_meta", "meta items", f"""SELECT m.*, {r('entropy')}, richness, {r('Temp')}, {r('Seasonality')},
  {r('AnnPrecip')}, {r('PrecipSeason')} FROM meta m LEFT JOIN {_entropy} e ON e.DataSet = m.DataSet
  LEFT JOIN {_climate} ON l_suppkey = m.DataSet""")
oracle("natural_merge", "items obs", f"""SELECT PreyOrder, DataSet, CountInt, {r('top_mass')}
  FROM items JOIN (SELECT "Order", max(BodyMass) AS top_mass FROM obs GROUP BY "Order") ON PreyOrder = "Order" """)
for _name, _word in (("names_not_in", "NOT IN"), ("names_in", "IN")):
    oracle(_name, "items parts", f"""SELECT DISTINCT PreyScientificName AS name FROM items
      WHERE PreyScientificName {_word} (SELECT sciname FROM parts)""")
oracle("genus_matches", "matches_all", f"""SELECT DataSet, label, name, {n('name_count', 'name_count')},
  {n('genus_count', 'genus_count')} FROM matches_all""")
oracle("cross_candidates", "items", """SELECT DataSet, PreyScientificName,
  unnest([0.01::DOUBLE, 0.02, 0.04, 0.08, 0.16]) AS cand_h FROM items""")

# --- aggregations ----------------------------------------------------------------------

oracle("by_diet", "items", f"""SELECT DataSet, count(*) AS items, {n('sum(CountInt)', 'prey')}, max(CountInt) AS top
  FROM items GROUP BY DataSet""")
oracle("group_sum", "items", f"""SELECT 'PreyClass' AS "by", PreyClass AS key, {n('sum(CountInt)', 'TotalSum')}
  FROM items GROUP BY PreyClass UNION ALL
  SELECT 'PreyOrder', PreyOrder, {n('sum(CountInt)', 'TotalSum')} FROM items GROUP BY PreyOrder""")
oracle("group_mean", "traits", f"SELECT sciname AS SciName, {r('mass', 'BodyMassValue_mean')} FROM traits")
oracle("group_count_valid", "meta", "SELECT ecozone, count(PreyPerPellet) AS num_records FROM meta GROUP BY ecozone")
oracle("distinct_values", "items", "SELECT DISTINCT PreyScientificName FROM items")
oracle("distinct_counts", "items", "SELECT " + ", ".join(
    f"count(DISTINCT {c}) AS n_{c}" for c in ("DataSet", "PreyClass", "PreyOrder", "PreyScientificName")) + " FROM items")
oracle("share_of_total", "items", f"""SELECT PreyClass, {n('sum(CountInt)', 'TotalSum')},
  {r('sum(CountInt) / (SELECT CAST(sum(CountInt) AS DOUBLE) FROM items)', 'share')} FROM items GROUP BY PreyClass""")
oracle("global_summary", "meta", f"""SELECT count(*) AS rows, max(DataSet) AS max_id, min(Num_obs) AS min_obs,
  max(Num_obs) AS max_obs, {n('sum(Num_obs)', 'total_obs')}, count(*) FILTER (WHERE Num_obs > 20) AS over_limit FROM meta""")


def _share(condition: str, name: str) -> str:
    return r(f"sum(CASE WHEN {condition} THEN CountInt ELSE 0 END) / CAST(sum(CountInt) AS DOUBLE)", name)


_classes = ", ".join(_share(f"PreyClass = '{c}'", o) for o, c in (
    ("fMamms", "Mammalia"), ("fBirds", "Aves"), ("fIns", "Insecta")))
oracle("class_fractions", "items", f"SELECT DataSet, {_classes} FROM items GROUP BY DataSet")
oracle("bird_fraction", "items meta", f"""SELECT m.DataSet, {r('''coalesce(
    sum(CASE WHEN PreyClass = 'Aves' THEN CountInt ELSE 0 END) / CAST(sum(CountInt) AS DOUBLE), 0)''', 'FreqBirds')}
  FROM meta m LEFT JOIN items i ON m.DataSet = i.DataSet GROUP BY m.DataSet""")
oracle("unidentified_fraction", "items", f"""SELECT DataSet, {_share("PreyScientificName = 'rod sp'", 'funidBird')},
  {_share("PreyScientificName = 'gear sp'", 'funidMamm')} FROM items GROUP BY DataSet""")
oracle("frequencies", "items", f"""SELECT DataSet, PreyScientificName, CountInt,
  {r('CountInt / CAST(sum(CountInt) OVER (PARTITION BY DataSet) AS DOUBLE)', 'Frequencies')} FROM items""")
oracle("top_frequency", "items", f"""SELECT DataSet, {r('max(CountInt) / CAST(sum(CountInt) AS DOUBLE)', 'top_frequency')}
  FROM items GROUP BY DataSet""")
_top_items = """SELECT DataSet, avg(PreyMass) AS top_item_mass, arg_min(IDLevel, PreyScientificName) AS top_item_id_level
  FROM (SELECT *, max(CountInt) OVER (PARTITION BY DataSet) AS top FROM enriched) WHERE CountInt = top GROUP BY DataSet"""
oracle("top_items", "enriched", f"SELECT DataSet, {r('top_item_mass')}, top_item_id_level FROM ({_top_items})")
oracle("richness", "items", "SELECT DataSet, count(*) AS richness FROM items GROUP BY DataSet")
oracle("prey_total", "items", f"SELECT DataSet, {n('sum(CountInt)', 'numb_prey')} FROM items GROUP BY DataSet")
oracle("shannon_entropy", "items", f"SELECT DataSet, {r('entropy')} FROM {_entropy}")


def gini_sql(weight: str) -> str:
    return f"""SELECT DataSet, 1 - sum((2 * height - z) * w) / (sum(z) * sum(w)) AS gini FROM (
      SELECT *, sum(z) OVER (PARTITION BY DataSet ORDER BY rank DESC ROWS UNBOUNDED PRECEDING) AS height
      FROM (SELECT DataSet, rank, CAST({weight} AS DOUBLE) AS w, CAST({weight} * CountInt AS DOUBLE) AS z FROM curve))
      GROUP BY DataSet"""


oracle("gini_rank_population", "curve", f"SELECT DataSet, {r('gini')} FROM ({gini_sql('rank')})")
oracle("gini_unit_population", "curve", f"SELECT DataSet, {r('gini')} FROM ({gini_sql('1')})")
oracle("mass_range", "enriched", f"""SELECT DataSet, {r('min(PreyMass)', 'min_mass')}, {r('max(PreyMass)', 'max_mass')},
  {r('max(PreyMass) - min(PreyMass)', 'mass_range')} FROM enriched GROUP BY DataSet""")
oracle("lognormal_params", "items", f"""SELECT DataSet, {r('CASE WHEN count(*) > 2 THEN avg(ln(f)) END', 'ln_mean')},
  {r('CASE WHEN count(*) > 2 THEN stddev_samp(ln(f)) END', 'ln_sd')} FROM (
  SELECT DataSet, CountInt / CAST(sum(CountInt) OVER (PARTITION BY DataSet) AS DOUBLE) AS f FROM items) GROUP BY DataSet""")
_select = """SELECT d.DataSet, summed_deviance, max_overselected_size
  FROM (SELECT DISTINCT DataSet FROM items) d LEFT JOIN (
    SELECT DataSet, sum(abs(e)) AS summed_deviance,
           arg_min(PreyMass, {'e': -round(e, 12), 'name': PreyScientificName}) AS max_overselected_size
    FROM (SELECT *, 1 / PreyMass / sum(1 / PreyMass) OVER w - CountInt / CAST(sum(CountInt) OVER w AS DOUBLE) AS e,
                 count(*) OVER w AS k
          FROM enriched WHERE PreyMass IS NOT NULL WINDOW w AS (PARTITION BY DataSet))
    WHERE k > 5 GROUP BY DataSet) s ON s.DataSet = d.DataSet"""
oracle("size_selectivity", "enriched", f"""SELECT DataSet, {r('summed_deviance')}, {r('max_overselected_size')}
  FROM ({_select})""")
oracle("weighted_mean_mass", "enriched", f"""SELECT DataSet,
  {r('sum(CountInt * PreyMass) / sum(CASE WHEN PreyMass IS NOT NULL THEN CountInt END)', 'mean_mass')}
  FROM enriched GROUP BY DataSet""")
oracle("total_density", "sums", f"SELECT DataSet, {r('sum_R')} FROM sums")
oracle("extreme_item_frequency", "sums",
       f"SELECT DataSet, {r('obs_largest_prey_freq')}, {r('obs_smallest_prey_freq')} FROM sums")
oracle("predicted_largest_frequency", "sums", f"SELECT DataSet, {r('pred_largest_prey_freq')} FROM sums")
oracle("extreme_masses", "ranked", f"""SELECT DataSet, {r('max(CASE WHEN MassRank = k THEN PreyMass END)', 'largest_prey_mass')},
  {r('max(CASE WHEN MassRank = 1 THEN PreyMass END)', 'smallest_prey_mass')}
  FROM (SELECT *, count(*) OVER (PARTITION BY DataSet) AS k FROM ranked) GROUP BY DataSet""")
oracle("mass_of_most_common", "sums", f"SELECT DataSet, {r('mass_of_most_common')} FROM sums")
oracle("top_item_flags", "sums", "SELECT DataSet, IsTopPreyBiggest, IsTopPreyMostDense FROM sums")
oracle("presence_matrix", "items", "SELECT DataSet, " + ", ".join(
    n(f"bool_or(PreyOrder = 'O{i}')", f"O{i}") for i in (1, 2, 3, 4)) + " FROM items GROUP BY DataSet")
oracle("diets_per_category", "items", """SELECT PreyScientificName, count(DISTINCT DataSet) AS Diets
  FROM items GROUP BY PreyScientificName""")
oracle("count_positive_share", "slopes", f"""SELECT {r('avg(CASE WHEN dens_slopes > 0 THEN 1.0 ELSE 0 END)', 'share_positive')}
  FROM slopes WHERE dens_slopes IS NOT NULL""")
oracle("handling_time_lower_bound", "meta", f"SELECT {r('1 / avg(PreyPerPellet) / 3', 'h_lower_bound')} FROM meta")
_draws_long = " UNION ALL ".join(
    f"""SELECT c_custkey AS draw, CAST({k} AS BIGINT) AS k, c_acctbal / {1000.0 * k} AS intercept,
        -(c_custkey % {10 + k}) / 20.0 AS slope FROM customer""" for k in (1, 2, 3, 4))
_medians = f"(SELECT k, median(slope) AS slope, median(intercept) AS intercept FROM ({_draws_long}) GROUP BY k)"
oracle("median_by_level", "", f"SELECT k, {r('slope')}, {r('intercept')} FROM {_medians}")
oracle("correlation_pearson", "", f"SELECT {r('corr(p_size, p_retailprice)', 'correlation')} FROM part")
oracle("correlation_spearman", "", f"""SELECT {r('corr(a, b)', 'correlation')} FROM (SELECT
  rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part)""")

# --- ranks ------------------------------------------------------------------------------

oracle("rank_abundance", "curve", f"""SELECT DataSet, PreyScientificName, CountInt, rank,
  {r('CountInt / CAST(total AS DOUBLE)', 'frequency')} FROM curve""")
oracle("cumulative_share", "curve", f"""SELECT DataSet, PreyScientificName,
  {r('upto / CAST(total AS DOUBLE)', 'cumulative')} FROM curve""")
oracle("cumulative_share_by_name", "items", f"""SELECT DataSet, PreyScientificName, {r('''
  sum(CountInt) OVER (PARTITION BY DataSet ORDER BY PreyScientificName ROWS UNBOUNDED PRECEDING)
  / CAST(sum(CountInt) OVER (PARTITION BY DataSet) AS DOUBLE)''', 'cumulative')} FROM items""")
_sp50 = """SELECT DataSet, CASE WHEN max(n) <= 2 OR max(CountInt / total) >= 0.5 THEN 1 ELSE
    arg_min(rank - 1 + (total / 2.0 - (upto - CountInt)) / CountInt, rank) FILTER (WHERE upto * 2 > total) END AS sp50
  FROM (SELECT DataSet, rank, n, CAST(CountInt AS DOUBLE) AS CountInt, CAST(upto AS DOUBLE) AS upto,
               CAST(total AS DOUBLE) AS total FROM curve) GROUP BY DataSet"""
oracle("sp50", "curve", f"SELECT DataSet, {r('sp50')} FROM ({_sp50})")
oracle("rank_triplet", "ranked", "SELECT DataSet, PreyScientificName, DensRank, CountRank, MassRank FROM ranked")
_shares = """(SELECT *, CountInt / CAST(sum(CountInt) OVER w AS DOUBLE) AS Frequencies,
  Density / sum(Density) OVER w AS Rel_density FROM prey WINDOW w AS (PARTITION BY DataSet))"""
oracle("group_share", "prey", f"SELECT DataSet, PreyScientificName, {r('Frequencies')}, {r('Rel_density')} FROM {_shares}")
oracle("frequency_gap", "prey", f"""SELECT DataSet, PreyScientificName, {r('PreyMass')},
  {r('Frequencies - Rel_density', 'gap')} FROM {_shares}""")
oracle("sorted_families", "enriched", """SELECT PreyFamily, count(DISTINCT DataSet) AS Diets FROM enriched
  WHERE PreyFamily IS NOT NULL GROUP BY PreyFamily ORDER BY Diets DESC, PreyFamily""")
oracle("first_crossing", "curve", f"""SELECT DataSet, arg_min(PreyScientificName, rank) AS crossing_item,
  {r('min(upto / CAST(total AS DOUBLE))', 'crossing_share')} FROM curve
  WHERE upto / CAST(total AS DOUBLE) > 0.3 GROUP BY DataSet""")

# --- sets ---------------------------------------------------------------------------------

oracle("union_adjusted", "items", """SELECT DataSet, PreyScientificName,
  CASE WHEN PreyScientificName LIKE 'gear%' THEN CountInt * 2 ELSE CountInt END AS CountInt FROM items""")
oracle("test_differences", "tests", f"SELECT DataSet, PreyScientificName, {r('diff')} FROM tests WHERE cand_h = 0.02")
oracle("stacked_names", "traits", f"""SELECT genus || ' sp' AS name, {r('avg(mass)', 'BodyMassValue')} FROM traits GROUP BY genus
  UNION ALL SELECT family, {r('avg(mass)', 'BodyMassValue')} FROM traits GROUP BY family""")
oracle("redistribute_genus", "shared",
       "SELECT DataSet, IDLevel, PreyClass, PreyOrder, PreyScientificName, CountInt FROM shared")

# --- rarefaction ----------------------------------------------------------------------------

oracle("rarefy_draws", "curve", f"SELECT * FROM ({draws(100, 100)})")
oracle("frequency_table", "curve", f"SELECT DataSet, rep, rank, count(*) AS n FROM ({draws(100, 200)}) GROUP BY ALL")
oracle("rarefied_richness", "curve", f"SELECT DataSet, {r('rare_richness')} FROM ({rare_sql(100, 200)})")
oracle("rarefied_entropy", "curve", f"SELECT DataSet, {r('rare_entropy')} FROM ({rare_sql(100, 200)})")
oracle("rarefied_top_frequency", "curve", f"SELECT DataSet, {r('rare_top_frequency')} FROM ({rare_sql(100, 100)})")
oracle("expected_rarefied_richness", "curve", f"""SELECT DataSet,
  {r('sum(1 - pow(1 - CountInt / CAST(total AS DOUBLE), 100))', 'expected_richness')} FROM curve GROUP BY DataSet""")
oracle("sampled_metrics", "curve", """SELECT DataSet, CAST(count(*) AS DOUBLE) AS rare_richness, true AS entropy_agrees
  FROM curve WHERE CountInt > 0 GROUP BY DataSet""")
oracle("sampled_richness", "curve", f"""SELECT count(DISTINCT DataSet) AS diets,
  {r('sum(1 - pow(1 - CountInt / CAST(total AS DOUBLE), 100))', 'expected_richness')}, true AS agrees FROM curve""")
_known = """(SELECT * FROM curve WHERE DataSet NOT IN (SELECT DataSet FROM items
  WHERE DataSet % 4 = 1 AND PreyScientificName = 'gear sp'))"""
oracle("rarefaction_skips_unknown", "curve", f"""SELECT d.DataSet, {r('coalesce(rare_richness, 0)', 'rare_richness')},
  {r('coalesce(rare_entropy, 0)', 'rare_entropy')}, {r('coalesce(rare_top_frequency, 0)', 'rare_top_frequency')}
  FROM (SELECT DISTINCT DataSet FROM items) d LEFT JOIN ({rare_sql(100, 200, _known)}) s ON s.DataSet = d.DataSet""")
oracle("rarefaction_effect", "curve", f"""SELECT e.DataSet, richness, {r('entropy')}, {r('rare_richness')}, {r('rare_entropy')}
  FROM {_entropy} e JOIN ({rare_sql(100, 200)}) s ON s.DataSet = e.DataSet""")

# --- density and regressions --------------------------------------------------------------------

oracle("allometry_simple", "obs", f"""SELECT {r('regr_slope(LogDensity, LogMass)', 'slope')},
  {r('regr_intercept(LogDensity, LogMass)', 'intercept')}, {r('regr_r2(LogDensity, LogMass)', 'r2')},
  {n('count(*)', 'n')} FROM obs""")
oracle("allometry_by_order", "lines", f"""SELECT "Order", {r('slope')}, {r('intercept')}, {n('n', 'n')} FROM lines""")
oracle("allometry_r2", "obs lines", f"""SELECT {r('''1 - sum(pow(LogDensity - intercept - slope * LogMass, 2))
  / sum(pow(LogDensity - mean, 2))''', 'r2')} FROM obs JOIN lines USING ("Order"), (SELECT avg(LogDensity) AS mean FROM obs)""")
_species = "(SELECT DISTINCT PreyScientificName, PreyOrder, PreyMass FROM enriched)"
oracle("predict_density", "enriched lines", f"""SELECT PreyScientificName,
  {r('intercept + slope * log10(PreyMass)', 'LogDensity')}, {r('exp(intercept + slope * log10(PreyMass))', 'Density')},
  {r('pow(10, intercept + slope * log10(PreyMass))', 'Density10')} FROM {_species} JOIN lines ON PreyOrder = "Order" """)
oracle("posterior_density", "enriched", f"""SELECT PreyScientificName, draw,
  {r('exp(intercept + slope * log10(PreyMass))', 'density')} FROM {_species}
  JOIN ({_draws_long}) ON k = CAST(substr(PreyOrder, 2) AS BIGINT)""")
_densities = f"""(SELECT PreyScientificName, PreyOrder, PreyMass, intercept + slope * log10(PreyMass) AS l
  FROM {_species} LEFT JOIN ({_draws_long}) ON k = CAST(substr(PreyOrder, 2) AS BIGINT))"""
oracle("posterior_summary", "enriched", f"""SELECT PreyScientificName, count(l) AS draws, {r('avg(exp(l))', 'mean')},
  {r('stddev_samp(exp(l))', 'sd')}, {r('avg(l)', 'log_mean')}, {r('stddev_samp(l)', 'log_sd')}, {r('min(exp(l))', 'least')}, {r('max(exp(l))', 'most')}
  FROM {_densities} GROUP BY PreyScientificName, PreyOrder, PreyMass""")
oracle("posterior_point", "enriched", f"""SELECT PreyScientificName,
  {r('exp(intercept + slope * log10(PreyMass))', 'density')} FROM {_species}
  JOIN {_medians} ON k = CAST(substr(PreyOrder, 2) AS BIGINT)""")
oracle("rank_regression", "slopes", f"""SELECT DataSet, {r('dens_slopes')}, {r('intercept')}, n, {r('pval_dens')}
  FROM slopes""")
oracle("rank_line", "slopes ranked", f"""SELECT DataSet, DensRank, {r('intercept + dens_slopes * DensRank', 'fitted')}
  FROM ranked JOIN slopes USING (DataSet)""")

_ZONES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def _design(model: Model) -> list[tuple[str, str]]:
    out = []
    for term in model.terms:
        if term == "ecozone":
            out += [(f"ecozone={z}", f"CASE WHEN ecozone = '{z}' THEN 1.0 ELSE 0.0 END") for z in _ZONES[1:]]
        elif isinstance(term, str):
            out.append((term, f"CAST({term} AS DOUBLE)"))
        else:
            out.append((":".join(term), " * ".join(f"CAST({t} AS DOUBLE)" for t in term)))
    return out


def sweep_sql(source: str, response: str, design: list[tuple[str, str]]) -> str:
    """One row with n, means m_i, swept cross-products s_i_j and kept flags k_i.

    The response is the last variable.  After sweeping the predictors the last
    column holds the slopes, the last cell the residual sum of squares, and the
    leading square the inverse.
    """
    exprs = [e for _, e in design] + [f"CAST({response} AS DOUBLE)"]
    p = len(design)
    cols = ", ".join(f"{e} AS z{i}" for i, e in enumerate(exprs))
    known = " AND ".join(f"z{i} IS NOT NULL" for i in range(p + 1))
    cells = [(i, j) for i in range(p + 1) for j in range(p + 1)]
    sql = f"""(SELECT count(*) AS n, {', '.join(f'avg(z{i}) AS m_{i}' for i in range(p + 1))}, {', '.join(
        f'count(*) * covar_pop(z{i}, z{j}) AS s_{i}_{j}' for i, j in cells)}, {', '.join(
        f'count(*) * var_pop(z{i}) AS d_{i}' for i in range(p + 1))}
      FROM (SELECT {cols} FROM {source}) WHERE {known})"""
    carried = ["n", *[f"m_{i}" for i in range(p + 1)], *[f"d_{i}" for i in range(p + 1)]]
    for k in range(p):
        keep = f"(d_{k} > 0 AND s_{k}_{k} > 1e-10 * d_{k})"
        out = []
        for i, j in cells:
            pivot = f"s_{k}_{k}"
            if i == k and j == k:
                value = f"1 / {pivot}"
            elif i == k:
                value = f"s_{k}_{j} / {pivot}"
            elif j == k:
                value = f"-s_{i}_{k} / {pivot}"
            else:
                value = f"s_{i}_{j} - s_{i}_{k} * s_{k}_{j} / {pivot}"
            out.append(f"CASE WHEN {keep} THEN {value} ELSE {'0' if k in (i, j) else f's_{i}_{j}'} END AS s_{i}_{j}")
        sql = f"(SELECT {', '.join(carried)}, {', '.join(out)}, {keep} AS k_{k} FROM {sql})"
        carried = [*carried, f"k_{k}"]
    return sql


def fit_sql(source: str, model: Model) -> str:
    """Coefficient rows of one model."""
    design = _design(model)
    p = len(design)
    if p == 0:
        raise ValueError("a model without terms")
    swept = sweep_sql(source, model.response, design)
    df = "(n - 1 - " + " - ".join(f"CAST(k_{i} AS INT)" for i in range(p)) + ")"
    beta = [f"(CASE WHEN k_{i} THEN s_{i}_{p} END)" for i in range(p)]
    quadratic = " + ".join(f"m_{i} * m_{j} * s_{i}_{j}" for i in range(p) for j in range(p))
    intercept = f"(m_{p} - " + " - ".join(f"m_{i} * coalesce({b}, 0)" for i, b in enumerate(beta)) + ")"
    rows = [("(Intercept)", intercept, f"(1.0 / n + {quadratic})")]
    rows += [(name, beta[i], f"(CASE WHEN k_{i} THEN s_{i}_{i} END)") for i, (name, _) in enumerate(design)]
    parts = ", ".join(f"{{'term': '{t}', 'b': CAST({b} AS DOUBLE), 'v': CAST({v} AS DOUBLE)}}" for t, b, v in rows)
    return f"""SELECT '{model.label}' AS model, term, b, e, b / nullif(e, 0) AS t, {p_value('(b / nullif(e, 0))', 'df')} AS p, r2, n
      FROM (SELECT u.term AS term, u.b AS b, CASE WHEN df > 0 THEN sqrt(rss / df * u.v) END AS e, df, r2, n FROM (
        SELECT unnest([{parts}]) AS u, {df} AS df, CASE WHEN s_{p}_{p} > 1e-12 * d_{p} THEN s_{p}_{p} ELSE 0 END AS rss,
               CASE WHEN d_{p} > 0 THEN CASE WHEN s_{p}_{p} > 1e-12 * d_{p} THEN 1 - s_{p}_{p} / d_{p} ELSE 1 END END AS r2, n FROM {swept}))"""


_fit_out = (f"SELECT model, term, {r('b', 'estimate')}, {r('e', 'std_error')}, {r('t', 't')}, {r('p', 'p_value')}, "
            f"{r('r2', 'r2')}, n FROM ")
_all_fits = " UNION ALL ".join(f"({fit_sql('model_table', m)})" for m in model_list.OLS)
_distinct_fits = " UNION ALL ".join(f"({fit_sql('model_table', m)})" for m in model_list.OLS if not model_list.near_copies(m))
oracle("ols_formulas", "model_table", f"{_fit_out} ({_distinct_fits})")
oracle("ols_r2", "model_table", f"SELECT DISTINCT model, {r('r2')}, n FROM ({_all_fits})")
_two = sweep_sql("model_table", "dens_slopes", _design(Model("dens_slopes", ("FreqBirds", "sum_R"))))
oracle("residuals", "model_table", f"""SELECT DataSet, {r('''dens_slopes - m_2 - s_0_2 * (FreqBirds - m_0)
  - s_1_2 * (sum_R - m_1)''', 'residual')} FROM model_table, {_two}""")


def _interval(name: str, terms: tuple[str, ...], at: int) -> None:
    """Band along one term: the t quantile by halving, the other terms at their means."""
    p, along = len(terms), terms[at]
    CTES[f"{name}_fit"] = f"""SELECT *, n - 1 - {' - '.join(f'CAST(k_{i} AS INT)' for i in range(p))} AS df,
      m_{p} + {' + '.join(f's_{i}_{p} * (0 - m_{i})' for i in range(p) if i == at)} AS base
      FROM {sweep_sql('model_table', 'l_ns', _design(Model('l_ns', terms)))}"""
    CTES[f"{name}_t"] = f"""SELECT df, CAST(0 AS DOUBLE) AS lo, CAST(1000 AS DOUBLE) AS hi, 0 AS k FROM {name}_fit
      UNION ALL SELECT df, CASE WHEN {p_value('((lo + hi) / 2)', 'df')} > 0.05 THEN (lo + hi) / 2 ELSE lo END,
        CASE WHEN {p_value('((lo + hi) / 2)', 'df')} > 0.05 THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM {name}_t WHERE k < 60"""
    DEPENDS.update({f"{name}_fit": ["model_table"], f"{name}_t": [f"{name}_fit"]})
    oracle(name, f"{name}_fit {name}_t", f"""SELECT {r('x', along)}, {r('y', 'prediction')}, {r('y - w', 'lower')}, {r('y + w', 'upper')}
      FROM (SELECT x, base + s_{at}_{p} * x AS y,
                   t * sqrt(s_{p}_{p} / f.df * (1.0 / f.n + (x - m_{at}) * (x - m_{at}) * s_{at}_{at})) AS w
            FROM {name}_fit f, (SELECT (lo + hi) / 2 AS t FROM {name}_t WHERE k = 60),
                 (SELECT lo + (hi - lo) * step / 9 AS x FROM (SELECT min({along}) AS lo, max({along}) AS hi FROM model_table),
                         (SELECT unnest(range(10)) AS step)))""")


_interval("predict_interval", ("l_re",), 0)
_interval("predict_interval_of_several", ("l_re", "log_LocalRichness", "FreqBirds"), 1)


def _residual(y: str, alias: str) -> str:
    controls = Model(y, ("DietRichness_rare", "PreyPerPellet", "largest_prey_mass"))
    return f"""(SELECT DataSet, {y} - m_3 - s_0_3 * (DietRichness_rare - m_0) - s_1_3 * (PreyPerPellet - m_1)
        - s_2_3 * (largest_prey_mass - m_2) AS {alias}
      FROM model_table, {sweep_sql('model_table', y, _design(controls))})"""


_resid = f"""(SELECT dens_slopes_residual, ShannEnt_rare_residual FROM {_residual('dens_slopes', 'dens_slopes_residual')}
  JOIN {_residual('ShannEnt_rare', 'ShannEnt_rare_residual')} USING (DataSet))"""
oracle("partial_regression", "model_table",
       _fit_out + "(" + fit_sql(_resid, Model("dens_slopes_residual", ("ShannEnt_rare_residual",))) + ")")
oracle("histogram", "", f"""SELECT bin, {r('lo + bin * (hi - lo) / 8', '"left"')}, count(p_retailprice) AS n
  FROM (SELECT unnest(range(8)) AS bin), (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)
  LEFT JOIN part ON bin = CAST(least(floor((p_retailprice - lo) / ((hi - lo) / 8)), 7) AS BIGINT) GROUP BY bin, lo, hi""")

# The slope of the exponential fit: the mean rank under weights f exp(br) falls to the one under exp(2br); halving from
# a bound that the first two counts give.
CTES["steep"] = """
  SELECT DataSet, lo, hi, 0 AS k FROM (
    SELECT DataSet, ln(max(CASE WHEN rank = 2 THEN CountInt END) / CAST(max(CountInt) AS DOUBLE)) - 1 AS lo,
           CAST(0 AS DOUBLE) AS hi FROM curve WHERE n > 2 GROUP BY DataSet)
  UNION ALL
  SELECT DataSet, CASE WHEN up THEN b ELSE lo END, CASE WHEN up THEN hi ELSE b END, k + 1 FROM (
    SELECT s.DataSet, lo, hi, k, (lo + hi) / 2 AS b,
           sum(rank * CountInt * exp((lo + hi) / 2 * rank)) * sum(exp((lo + hi) * rank))
             > sum(CountInt * exp((lo + hi) / 2 * rank)) * sum(rank * exp((lo + hi) * rank)) AS up
    FROM steep s JOIN curve c ON s.DataSet = c.DataSet WHERE k < 60 GROUP BY s.DataSet, lo, hi, k)"""
CTES["fits"] = """
  SELECT DataSet, b, a, 1 - sum(pow(f - a * exp(b * rank), 2)) / nullif(sum(pow(f - 1.0 / n, 2)), 0) AS rsquare FROM (
    SELECT c.DataSet, b, rank, n, CountInt / CAST(total AS DOUBLE) AS f,
           sum(CountInt / CAST(total AS DOUBLE) * exp(b * rank)) OVER (PARTITION BY c.DataSet)
             / sum(exp(2 * b * rank)) OVER (PARTITION BY c.DataSet) AS a
    FROM curve c JOIN (SELECT DataSet, (lo + hi) / 2 AS b FROM steep WHERE k = 60) s ON s.DataSet = c.DataSet)
  GROUP BY DataSet, a, b"""
DEPENDS |= {"steep": ["curve"], "fits": ["curve", "steep"]}
oracle("exp_fit", "items fits", f"""SELECT DataSet, {r('b', 'specialization')}, {r('a', 'y_intercept')}, {r('rsquare')},
  CASE WHEN b IS NOT NULL THEN true END AS converged
  FROM (SELECT DISTINCT DataSet FROM items) LEFT JOIN fits USING (DataSet)""")
oracle("exp_curve", "fits", f"""SELECT DataSet, {r('1 + step * 0.1', 'x')}, {r('a * exp(b * (1 + step * 0.1))', 'y')}
  FROM fits, (SELECT unnest(range(291)) AS step)""")

# --- foraging ---------------------------------------------------------------------------------------

_rates = """(SELECT DataSet, sum_R, CASE WHEN PreyPerPellet IS NOT NULL
  THEN -PreyPerPellet / (PreyPerPellet * sum_R * (0.02 - 1)) END AS baow_a FROM sums JOIN meta USING (DataSet))"""
oracle("attack_rate", "sums meta", f"SELECT DataSet, {r('baow_a')} FROM {_rates}")
oracle("intake_rate", "totals", f"SELECT DataSet, {r('3 * diet_mass * diet_p', 'NE_intake')} FROM totals")
oracle("discounted_intake", "prey totals", f"""SELECT p.DataSet, PreyScientificName,
  {r('(diet_mass - CountInt / CAST(diet_count AS DOUBLE) * PreyMass) * diet_p', 'ne_disc')}
  FROM prey p JOIN totals t ON p.DataSet = t.DataSet""")
oracle("foraging_test", "tests", f"""SELECT DataSet, PreyScientificName, cand_h, {r('ne_prey')}, {r('ne_disc')},
  {r('diff')}, passes FROM tests WHERE cand_h < 0.2""")
oracle("suboptimal_count", "tests", """SELECT DataSet, cand_h, count(*) FILTER (WHERE diff < 0) AS NumPos
  FROM tests WHERE cand_h < 0.2 GROUP BY DataSet, cand_h""")
oracle("proportion_meeting_rule", "tests", f"""SELECT cand_h,
  {r('avg(CASE WHEN passes THEN 1.0 ELSE 0 END)', 'prop_meeting_rule')} FROM tests GROUP BY cand_h""")
oracle("response_curve", "sums meta", f"""SELECT DataSet, step, {r('x')}, {r('baow_a * x / (1 + 0.02 * baow_a * x)', 'rate')}
  FROM (SELECT DataSet, baow_a, step, top * step / 9 AS x FROM {_rates},
    (SELECT max(sum_R) AS top FROM {_rates} WHERE baow_a IS NOT NULL), (SELECT unnest(range(10)) AS step)
    WHERE baow_a IS NOT NULL AND sum_R <> 0)""")
oracle("clearance_comparison", "sums meta", f"""SELECT 'diets' AS source, 6e5::DOUBLE AS mass, {r('baow_a * 1e5', 'rate')}
  FROM {_rates} WHERE baow_a <> 0 UNION ALL SELECT 'published', {r('p_retailprice', 'mass')}, p_size / 10.0::DOUBLE FROM part""")
oracle("mean_clearance", "sums meta", f"SELECT {r('avg(baow_a) * 1e5', 'mean_a')} FROM {_rates}")
oracle("net_energy_points", "tests", f"""SELECT DataSet, PreyScientificName, cand_h, {r('ne_disc')},
  {r('CASE WHEN ne_prey > 0 THEN ln(ne_prey) END', 'ln_prey')},
  {r('CASE WHEN ne_disc > 0 THEN ln(ne_disc) END', 'ln_disc')} FROM tests WHERE cand_h = 0.02""")

# --- assembled tables ------------------------------------------------------------------------------------

oracle("diet_meta_table", "meta curve rich", f"""SELECT m.*, {r('coalesce(rare_entropy, 0)', 'ShannEnt_rare')},
  {r('coalesce(rare_richness, 0)', 'DietRichness_rare')}, {n('coalesce(LocalRichness, 0)', 'LocalRichness')},
  {n('coalesce(RERichness, 0)', 'RERichness')}, {n('coalesce(RaptorRichness, 0)', 'RaptorRichness')}
  FROM meta m LEFT JOIN ({rare_sql(100, 200)}) s ON s.DataSet = m.DataSet LEFT JOIN rich ON rich.DataSet = m.DataSet
  WHERE contains(RaptorScientificName, 'ASIA')""")
oracle("diet_items_table", "meta enriched", f"""SELECT e.DataSet, RaptorScientificName, IDLevel, PreyClass, PreyOrder,
  PreyScientificName, CountInt, {r('PreyMass')}, PreyFamily FROM enriched e JOIN meta m ON e.DataSet = m.DataSet
  WHERE contains(RaptorScientificName, 'ASIA')""")
oracle("foraging_table", "meta sums slopes totals birds tested", f"SELECT {FORAGING_OUT} FROM ({foraging_rows(0.02)})")
oracle("handling_time_sweep", "tests", f"""SELECT cand_h,
  {r('avg(CASE WHEN passes THEN 1.0 ELSE 0 END)', 'prop_meeting_rule')} FROM tests WHERE cand_h < 0.2 GROUP BY cand_h""")
oracle("phylo_ready_table", "meta curve", f"""SELECT sp, {r('rare_NT')}, {r('rare_SE')}, Biome, {r('Mass')} FROM (
  SELECT CASE s WHEN 'ASIA_NATION_2' THEN 'ASIA_NATION_7' WHEN 'AFRICA_NATION_0' THEN 'AFRICA_NATION_5' ELSE s END AS sp,
         rare_richness AS rare_NT, rare_entropy AS rare_SE, ecozone AS Biome
  FROM (SELECT DataSet, replace(RaptorScientificName, ' ', '_') AS s, ecozone FROM meta) m
  LEFT JOIN ({rare_sql(100, 200)}) e ON e.DataSet = m.DataSet) JOIN (
  SELECT CASE s WHEN 'AFRICA_NATION_0' THEN 'AFRICA_NATION_5' ELSE s END AS sp2, n_nationkey AS Mass
  FROM (SELECT replace(r_name || ' ' || n_name, ' ', '_') AS s, n_nationkey FROM nation JOIN region
        ON n_regionkey = r_regionkey)) ON sp = sp2""")

# --- the whole spectrum table -------------------------------------------------------------

_spectrum_layers = {"RichBirds": "ALL", "RichMamms": "SUPPLIERS", "RichStrigB": "BUILDING", "RichStrigNB": "FURNITURE",
                    "RichAccB": "HOUSEHOLD", "RichAccNB": "MACHINERY"}


def _of(name: str, **columns: str) -> str:
    """Columns of the plain subquery ``name`` under new names, joined by diet."""
    return "LEFT JOIN (SELECT DataSet, " + ", ".join(f"{c} AS {out}" for out, c in columns.items()) + f" FROM {name}) USING (DataSet)"


def _share(condition: str) -> str:
    return f"sum(CASE WHEN {condition} THEN CountInt ELSE 0 END) / CAST(sum(CountInt) AS DOUBLE)"


_sums = f"""(SELECT DataSet, count(*) AS types, max(CountInt) / CAST(sum(CountInt) AS DOUBLE) AS top, ln(min(PreyMass)) AS least,
    ln(max(PreyMass)) AS most, max(PreyMass) - min(PreyMass) AS reach, {_share("PreyClass = 'Aves'")} AS birds,
    {_share("PreyClass = 'Mammalia'")} AS mammals, {_share("PreyClass = 'Insecta'")} AS insects,
    {_share("PreyScientificName = 'Aves'")} AS plain_birds, {_share("PreyScientificName = 'Mammalia'")} AS plain_mammals
  FROM enriched GROUP BY DataSet)"""
_climate = """(SELECT l_suppkey AS DataSet, avg(l_discount) AS temp, avg(l_tax) AS season, avg(l_quantity) AS rain,
  avg(l_extendedprice) AS rain_season FROM lineitem GROUP BY l_suppkey)"""
_doubles = {
    "Lat": "s_acctbal / 1000", "Long": "s_acctbal / 500", "rare_NT": None, "NetSpec": "-slope", "yInt": None, "MF": None,
    "rare_MF": None, "sp50": "half", "Gini": None, "SE": None, "rare_SE": None, "Mass": "ln(abs(s_acctbal) + 1)", "MMF": "ln(top_mass)",
    "MSP": None, "MLP": None, "MassRange": None, "RangeSize": None, "fBirds": None, "fMamms": None, "fIns": None,
    "funidBird": "coalesce(funidBird, 0)", "funidMamm": "coalesce(funidMamm, 0)", "MOS": None, "SD": None, "Temp": None,
    "Seasonality": None, "AnnPrecip": None, "PrecipSeason": None, "EqSplit": None, "FairProp": None}
oracle("diet_spectrum_table", "enriched meta curve fits cells layers", f"""SELECT DataSet, ecozone AS "Order", Continent AS "Family",
  split_part(Continent, '_', 2) AS Genus, Continent AS Species, {n('Num_obs', 'NumObs')}, {n('NumPreyTypes', 'NumPreyTypes')}, ID_MF,
  {', '.join(r(source or out, out) for out, source in _doubles.items())},
  {', '.join(n(f"(SELECT max(species) FROM layers l WHERE layer = '{layer}' AND l.POLYFID = c.POLYFID)", out)
             for out, layer in _spectrum_layers.items())},
  CAST((DataSet % 2 = 0)::INT + (DataSet % 3 = 0)::INT + (DataSet % 5 = 0)::INT AS BIGINT) AS NumHabs,
  CAST(DataSet % 4 AS VARCHAR) AS Season, CAST(POLYFID % 14 AS BIGINT) AS Biome
FROM meta JOIN (SELECT s_suppkey AS DataSet, s_acctbal FROM supplier) USING (DataSet) LEFT JOIN cells c USING (DataSet)
  LEFT JOIN {_predators} ON Continent = n_name
  {_of(_sums, NumPreyTypes='types', MF='top', MSP='least', MLP='most', MassRange='reach', fBirds='birds', fMamms='mammals',
       fIns='insects', funidBird='plain_birds', funidMamm='plain_mammals')}
  {_of(f"({rare_sql(100, 100)})", rare_NT='rare_richness', rare_MF='rare_top_frequency', rare_SE='rare_entropy')}
  {_of('fits', slope='b', yInt='a')} {_of(f"({ORACLES['sp50']})", half='sp50')} {_of(f"({gini_sql('rank')})", Gini='gini')}
  {_of(_entropy, SE='entropy')} {_of(f"({_top_items})", top_mass='top_item_mass', ID_MF='top_item_id_level')}
  {_of(f"({_select})", MOS='max_overselected_size', SD='summed_deviance')}
  {_of(_climate, Temp='temp', Seasonality='season', AnnPrecip='rain', PrecipSeason='rain_season')}""")


def _fitted(model: Model) -> str:
    """Fitted values, which stay put where near copies make the coefficients drift."""
    design = _design(model)
    p = len(design)
    parts = "".join(f" + s_{i}_{p} * ({e} - m_{i})" for i, (_, e) in enumerate(design))
    known = " AND ".join(f"({e}) IS NOT NULL" for _, e in design)
    return f"""SELECT DataSet, '{model.label}' AS model, {r(f'CASE WHEN {known} THEN m_{p}{parts} END', 'fitted')}
      FROM model_table, {sweep_sql('model_table', model.response, design)}"""


oracle("ols_fitted_near_copies", "model_table",
       " UNION ALL ".join(f"({_fitted(m)})" for m in model_list.OLS if model_list.near_copies(m)))


# --- models fitted by iteration ---------------------------------------------------------------

# Matrices are flat lists of q x q numbers, with the last row and column for the response or score.

WIDEST = 9


def _swept_lists(source: str) -> str:
    """``m`` with its first q - 1 pivots swept; ``kept`` lists those that were not next to nothing beside the diagonal ``d0``."""
    for k in range(WIDEST):
        pivot, on = f"m[{k} * q + {k + 1}]", f"({k} < q - 1 AND d0[{k + 1}] > 0 AND m[{k} * q + {k + 1}] > 1e-10 * d0[{k + 1}])"
        cell, row, column = "m[x + 1]", f"m[{k} * q + x % q + 1]", f"m[x // q * q + {k + 1}]"
        value = f"""[CASE WHEN {k} >= q - 1 THEN {cell} WHEN NOT live THEN CASE WHEN x // q = {k} OR x % q = {k} THEN 0 ELSE {cell} END
          WHEN x // q = {k} AND x % q = {k} THEN 1 / {pivot} WHEN x // q = {k} THEN {row} / {pivot} WHEN x % q = {k} THEN -{column} / {pivot}
          ELSE {cell} - {column} * {row} / {pivot} END for x in range(q * q)]"""
        source = f"(SELECT * REPLACE ({value} AS m, list_append(kept, live) AS kept) FROM (SELECT *{' EXCLUDE (live)' if k else ''}, {on} AS live FROM {source}))"
    return source


def _model_rows(name: str, source: str, specs: list[tuple[str, str | None, list[str], str]], scaled: bool) -> None:
    """CTEs of rows (model, g, q, x): a 1, the centred terms and the centred response, or the response as it is where ``scaled``."""
    parts = []
    for label, group, terms, response in specs:
        values = ["1.0", *terms, response]
        known = " AND ".join(f"({e}) IS NOT NULL" for e in [*values[1:], *([group] if group else [])])
        parts.append(f"""SELECT '{label}' AS model, {f'CAST({group} AS VARCHAR)' if group else "''"} AS g, CAST({len(values)} AS BIGINT) AS q,
          [{', '.join(f'CAST({e} AS DOUBLE)' for e in values)}] AS x FROM {source} WHERE {known}""")
    CTES[f"{name}_raw"] = " UNION ALL ".join(parts)
    CTES[f"{name}_mid"] = f"""SELECT model, list(CASE WHEN i = 1 {'OR i = q' if scaled else ''} THEN 0 ELSE a END ORDER BY i) AS mid,
        list(CASE WHEN i = 1 {'OR i = q' if scaled else ''} OR s = 0 THEN 1 ELSE {'s' if scaled else '1'} END ORDER BY i) AS wide, max(n) AS n FROM (
      SELECT model, q, i, avg(x[i]) AS a, stddev_pop(x[i]) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, q + 1)) AS i FROM {name}_raw)
      GROUP BY model, q, i) GROUP BY model"""
    CTES[f"{name}_x"] = f"""SELECT model, g, q, row_number() OVER () AS id, [(x[i] - mid[i]) / wide[i] for i in range(1, q + 1)] AS x
      FROM {name}_raw JOIN {name}_mid USING (model)"""
    DEPENDS.update({f"{name}_raw": [source], f"{name}_mid": [f"{name}_raw"], f"{name}_x": [f"{name}_raw", f"{name}_mid"]})


def _mixed(name: str, source: str, wanted: list[Model], out: str) -> None:
    """Random intercepts: sums per group, a grid of variance ratios, and halving on the slope of the deviance."""
    specs = []
    for m in wanted:
        specs.append((m.label, m.group, [e for _, e in _design(m)], m.response))
    _model_rows(name, source, specs, scaled=False)
    CTES[f"{name}_g"] = f"""SELECT model, q, g, c, sum(x[c // q + 1] * x[c % q + 1]) AS v FROM (SELECT *, unnest(range(q * q)) AS c FROM {name}_x)
      GROUP BY model, q, g, c"""
    # Per group its products, size and sums; the response is centred, so its sum is a column like any other.
    CTES[f"{name}_s"] = f"SELECT model, q, g, list(v ORDER BY c) AS xx FROM {name}_g GROUP BY model, q, g"

    def at(state: str) -> str:
        """Deviance and its slope for rows (model, lo, hi, k, tau)."""
        summed = f"""(SELECT model, q, lo, hi, k, tau, c, sum(xx[c + 1] - tau / (1 + xx[1] * tau) * xx[c // q + 1] * xx[c % q + 1]) AS a,
              sum(xx[c // q + 1] * xx[c % q + 1] / pow(1 + xx[1] * tau, 2)) AS b, sum(xx[1]) AS n, count(*) AS groups,
              sum(ln(1 + xx[1] * tau)) AS logdet, sum(xx[1] / (1 + xx[1] * tau)) AS trace
            FROM (SELECT s.*, lo, hi, k, tau, unnest(range(q * q)) AS c FROM {state} JOIN {name}_s s USING (model)) GROUP BY model, q, lo, hi, k, tau, c)"""
        matrices = f"""(SELECT model, q, lo, hi, k, tau, list(a ORDER BY c) AS m, list(b ORDER BY c) AS b, list(a ORDER BY c) FILTER (c // q = c % q) AS d0,
              CAST([] AS BOOLEAN[]) AS kept, any_value(n) AS n, any_value(groups) AS groups, any_value(logdet) AS logdet, any_value(trace) AS trace
            FROM {summed} GROUP BY model, q, lo, hi, k, tau)"""
        solved = f"(SELECT *, greatest(m[q * q], 1e-300) AS rss, list_append([CASE WHEN kept[i + 1] THEN -m[i * q + q] ELSE 0 END for i in range(q - 1)], 1.0) AS v FROM {_swept_lists(matrices)})"
        return f"""(SELECT *, n * ln(rss / n) + logdet AS deviance,
            trace - n * list_sum([v[c // q + 1] * v[c % q + 1] * b[c + 1] for c in range(q * q)]) / rss AS slope FROM {solved})"""

    grid = f"""(SELECT DISTINCT model, CAST(0 AS DOUBLE) AS lo, CAST(0 AS DOUBLE) AS hi, i AS k,
        CASE WHEN i = 0 THEN 0 ELSE exp(ln(1e-6) + (i - 1) * (ln(1e6) - ln(1e-6)) / 48) END AS tau FROM {name}_s, (SELECT unnest(range(50)) AS i))"""
    CTES[f"{name}_grid"] = f"SELECT model, k, tau, deviance, slope FROM {at(grid)}"
    CTES[f"{name}_from"] = f"""SELECT model, CASE WHEN k = 0 AND slope >= 0 THEN 0 ELSE coalesce(before, 0) END AS lo,
        CASE WHEN k = 0 AND slope >= 0 THEN 0 ELSE coalesce(behind, tau) END AS hi FROM (
      SELECT *, lag(tau) OVER w AS before, lead(tau) OVER w AS behind FROM {name}_grid WINDOW w AS (PARTITION BY model ORDER BY k))
      QUALIFY row_number() OVER (PARTITION BY model ORDER BY deviance, k) = 1"""
    CTES[f"{name}_step"] = f"""SELECT model, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, 0 AS k FROM {name}_from
      UNION ALL SELECT model, CASE WHEN slope < 0 THEN tau ELSE lo END, CASE WHEN slope < 0 THEN hi ELSE tau END, k + 1
        FROM {at(f'(SELECT *, (lo + hi) / 2 AS tau FROM {name}_step WHERE k < 80)')}"""
    CTES[f"{name}_fit"] = f"SELECT * FROM {at(f'(SELECT *, (lo + hi) / 2 AS tau FROM {name}_step WHERE k = 80)')} JOIN (SELECT model, mid FROM {name}_mid) USING (model)"
    DEPENDS.update({f"{name}_g": [f"{name}_x"], f"{name}_s": [f"{name}_g"], f"{name}_grid": [f"{name}_s"], f"{name}_from": [f"{name}_grid"],
                    f"{name}_step": [f"{name}_from", f"{name}_s"], f"{name}_fit": [f"{name}_step", f"{name}_s", f"{name}_mid"]})
    oracle(name, f"{name}_fit", out.format(fit=f"{name}_fit", loglik="-0.5 * (deviance + n * ln(2 * pi()) + n)"))


def _term_table(name: str, specs: list[tuple[str, list[str]]]) -> str:
    rows = [f"SELECT '{label}' AS model, {i} AS i, '{term}' AS term" for label, terms in specs for i, term in enumerate(["(Intercept)", *terms])]
    return "(" + " UNION ALL ".join(rows) + ")"


def _tail_over_density(x: str) -> str:
    """The upper normal tail over the density at x >= 0: a series near 0, a continued fraction beyond."""
    series, tail = "1.0::DOUBLE", f"({x} + 60)"
    for k in range(60, 0, -1):
        series = f"(1 + {x} * {x} / {2 * k + 1} * {series})"
        tail = f"({x} + {k} / {tail})"
    return f"CASE WHEN {x} < 3 THEN sqrt(pi() / 2) * exp({x} * {x} / 2) - {x} * {series} ELSE 1 / {tail} END"


def _two_sided(z: str) -> str:
    """Two-sided normal p-value."""
    return f"2 * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * ({_tail_over_density(f'abs({z})')})"


_estimates = """SELECT f.model, t.term, CASE WHEN n < q THEN NULL WHEN t.i = 0 THEN m[q] + mid[q] - coalesce(list_sum([CASE WHEN kept[j] THEN m[(j - 1) * q + q] * mid[j] ELSE 0 END for j in range(2, q)]), 0)
      WHEN kept[t.i + 1] THEN m[t.i * q + q] END AS b,
    sqrt(rss / n * CASE WHEN n < q THEN NULL WHEN t.i = 0 THEN m[1] - 2 * coalesce(list_sum([mid[j] * m[j] for j in range(2, q)]), 0)
        + list_sum([mid[c // q + 1] * mid[c % q + 1] * CASE WHEN c % q > 0 AND c // q > 0 AND c % q < q - 1 AND c // q < q - 1 THEN m[c + 1] ELSE 0 END for c in range(q * q)])
      WHEN kept[t.i + 1] THEN m[t.i * q + t.i + 1] END) AS e, CASE WHEN n >= q THEN rss / n END AS residual, CASE WHEN n >= q THEN tau * rss / n END AS grouped, CASE WHEN n >= q THEN {loglik} END AS loglik, CAST(n AS BIGINT) AS n, groups"""


def _mixed_terms(name: str, source: str, wanted: list[Model]) -> None:
    terms = _term_table(name, [(m.label, [t for t, _ in _design(m)]) for m in wanted])
    _mixed(name, source, wanted, f"""SELECT model, term, {r('b', 'estimate')}, {r('e', 'std_error')}, {r('z')}, {r(_two_sided('z'), 'p_value')},
      {r('residual', 'residual_variance')}, {r('grouped', 'group_variance')}, {r('loglik')}, n, groups
      FROM (SELECT *, b / nullif(e, 0) AS z FROM ({_estimates} FROM {{fit}} f JOIN {terms} t ON t.model = f.model))""")


_mixed_terms("random_intercept_lm", "model_table", [m for m in model_list.MIXED if not model_list.near_copies(m)])
_mixed("random_intercept_near_copies", "model_table", [m for m in model_list.MIXED if model_list.near_copies(m)],
       f"SELECT model, {r('CASE WHEN n >= q THEN rss / n END', 'residual_variance')}, {r('CASE WHEN n >= q THEN tau * rss / n END', 'group_variance')}, CASE WHEN n >= q THEN CAST(round({{loglik}}, 3) AS DOUBLE) END AS loglik, CAST(n AS BIGINT) AS n, groups FROM {{fit}}")
CTES["biome_table"] = f"""SELECT m.DataSet, ecozone AS Biome, rare_richness AS rare_NT, rare_entropy AS rare_SE, Mass, FairProp
  FROM meta m LEFT JOIN ({rare_sql(100, 200)}) s ON s.DataSet = m.DataSet
  LEFT JOIN (SELECT r_name || ' ' || n_name AS sp, n_nationkey AS Mass FROM nation JOIN region ON n_regionkey = r_regionkey) ON sp = RaptorScientificName
  LEFT JOIN {_predators} ON Continent = n_name"""
DEPENDS["biome_table"] = ["meta", "curve"]
_mixed_terms("random_intercept_biome", "biome_table", model_list.BIOME)


# Newton's method for models of counts and of two outcomes: (model, beta) from step to step, beta for scaled terms.

def _newton(name: str, specs: list[tuple[str, list[str], str]], start: str, row: str, steps: int, out: str) -> None:
    """``row`` turns (e, x, q) of one row into its weight ``w``, score ``u``, change of weight ``dw`` and share ``l`` of the value."""
    designs = [(f"{y} ~ {' + '.join(t)}", None, [f"CAST({c} AS DOUBLE)" for c in t], f"CAST({y} AS DOUBLE)") for y, t, _ in specs]
    _model_rows(name, "model_table", designs, scaled=True)

    def at(state: str) -> str:
        rows = f"(SELECT s.model, beta, k, pen, x.* EXCLUDE (model), list_sum([beta[i] * x[i] for i in range(1, q)]) AS e FROM {state} s JOIN {name}_x x USING (model))"
        rows = row.format(rows=rows)
        cells = f"""(SELECT model, q, beta, k, pen, c, sum(CASE WHEN c // q < q - 1 AND c % q < q - 1 THEN w * x[c // q + 1] * x[c % q + 1]
            WHEN c // q = c % q THEN 0 ELSE u * x[least(c // q, c % q) + 1] END) AS v, sum(l) AS value
          FROM (SELECT *, unnest(range(q * q)) AS c FROM {rows}) GROUP BY model, q, beta, k, pen, c)"""
        matrices = f"""(SELECT model, q, beta, k, pen, list(v ORDER BY c) AS m, list(v ORDER BY c) FILTER (c // q = c % q) AS d0, CAST([] AS BOOLEAN[]) AS kept, max(value) AS value
          FROM {cells} GROUP BY model, q, beta, k, pen)"""
        swept = f"(SELECT * FROM {_swept_lists(matrices)})"
        # Half the hat diagonal times the relative change of the weight, for penalised fits.
        again = row.format(rows=f"""(SELECT s.model, beta, k, pen, m, kept, value, x.* EXCLUDE (model), list_sum([beta[i] * x[i] for i in range(1, q)]) AS e
          FROM {swept} s JOIN {name}_x x USING (model, q))""")
        spread = "list_sum([CASE WHEN c // q < q - 1 AND c % q < q - 1 THEN m[c + 1] * x[c // q + 1] * x[c % q + 1] ELSE 0 END for c in range(q * q)])"
        scores = f"""(SELECT model, q, beta, k, pen, m, kept, value, i, sum((u + pen * 0.5 * dw * {spread}) * x[i]) AS s
          FROM (SELECT *, unnest(range(1, q)) AS i FROM {again}) GROUP BY model, q, beta, k, pen, m, kept, value, i)"""
        return f"""(SELECT *, [list_sum([CASE WHEN kept[i] AND kept[j] THEN m[(i - 1) * q + j] * s[j] ELSE 0 END for j in range(1, q)]) for i in range(1, q)] AS step
          FROM (SELECT model, q, beta, k, pen, m, kept, value, list(s ORDER BY i) AS s FROM {scores} GROUP BY model, q, beta, k, pen, m, kept, value))"""

    CTES[f"{name}_start"] = f"SELECT model, [CASE WHEN i = 1 THEN b ELSE 0 END for i in range(1, q)] AS beta, 0 AS k, pen FROM (SELECT model, q, {start} FROM {name}_x GROUP BY model, q)"
    CTES[f"{name}_step"] = f"""SELECT model, beta, k, pen FROM {name}_start
      UNION ALL SELECT model, [beta[i] + step[i] for i in range(1, q)], k + 1, pen FROM {at(f'(SELECT * FROM {name}_step WHERE k < {steps})')}"""
    CTES[f"{name}_fit"] = f"SELECT * FROM {at(f'(SELECT * FROM {name}_step WHERE k = {steps})')} JOIN (SELECT model, mid, wide, n FROM {name}_mid) USING (model)"
    DEPENDS.update({f"{name}_start": [f"{name}_x"], f"{name}_step": [f"{name}_start", f"{name}_x"], f"{name}_fit": [f"{name}_step", f"{name}_x", f"{name}_mid"]})
    terms = _term_table(name, [(label, list(t)) for (label, *_), (_, t, _) in zip(designs, specs)])
    table = f"""(SELECT *, b / nullif(e, 0) AS z FROM (SELECT f.model, t.term,
        CASE WHEN t.i = 0 THEN beta[1] - list_sum([beta[j] * mid[j] / wide[j] for j in range(2, q)]) WHEN kept[t.i + 1] THEN beta[t.i + 1] / wide[t.i + 1] END AS b,
        sqrt(CASE WHEN t.i = 0 THEN m[1] - 2 * list_sum([m[j] * mid[j] / wide[j] for j in range(2, q)])
            + list_sum([CASE WHEN c % q > 0 AND c // q > 0 AND c % q < q - 1 AND c // q < q - 1
                THEN m[c + 1] * mid[c // q + 1] / wide[c // q + 1] * mid[c % q + 1] / wide[c % q + 1] ELSE 0 END for c in range(q * q)])
          WHEN kept[t.i + 1] THEN m[t.i * q + t.i + 1] / pow(wide[t.i + 1], 2) END) AS e, n, list_max([abs(v) for v in step]) < 1e-7 AS converged, pen = 1 AS separated
      FROM {name}_fit f JOIN {terms} t ON t.model = f.model))"""
    oracle(name, f"{name}_fit", out.format(fit=f"{name}_fit", table=table))


_glm_out = f"""SELECT model, term, {r('b', 'estimate')}, {r('e', 'std_error')}, {r('z')}, {r(_two_sided('z'), 'p_value')},
  CAST(n AS BIGINT) AS n, converged, separated FROM {{table}}"""
_count_row = "(SELECT *, exp(e) AS w, x[q] - exp(e) AS u, 0 AS dw, exp(e) - x[q] * e AS l FROM {rows})"
_copies = [model_list.near_copies(Model(y, tuple(t))) for y, t in model_list.POISSON]
_newton("poisson_glm", [(y, t, "") for (y, t), c in zip(model_list.POISSON, _copies) if not c], "ln(avg(x[q])) AS b, 0 AS pen", _count_row, 25, _glm_out)
_newton("poisson_glm_near_copies", [(y, t, "") for (y, t), c in zip(model_list.POISSON, _copies) if c], "ln(avg(x[q])) AS b, 0 AS pen", _count_row, 25,
        f"SELECT model, CAST(n AS BIGINT) AS n, {r('value', 'lack')}, true AS converged FROM {{fit}}")
# Of the tail over the density, the density and the tail: weight, score, and the change of the weight with the predictor.
_outcome_row = f"""(SELECT *, d / (t * (1 - t * d)) AS w, CASE WHEN (x[q] = 1) = (e >= 0) THEN d / (1 - t * d) ELSE 1 / t END * (2 * x[q] - 1) AS u,
  d / (t * (1 - t * d)) * sign(e) * (1 / t - d / (1 - t * d) - 2 * abs(e)) AS dw, 0 AS l
  FROM (SELECT *, exp(-e * e / 2) / sqrt(2 * pi()) AS d, {_tail_over_density('abs(e)')} AS t FROM {{rows}}))"""
_newton("probit_glm", [("IsTopPreyBiggest", ["mass_of_most_common_dropones"], "")], """CAST(0 AS DOUBLE) AS b, CASE WHEN min(x[q]) = max(x[q])
    OR max(x[2]) FILTER (x[q] = 0) <= min(x[2]) FILTER (x[q] = 1) OR max(x[2]) FILTER (x[q] = 1) <= min(x[2]) FILTER (x[q] = 0) THEN 1 ELSE 0 END AS pen""",
        _outcome_row, 60, _glm_out)

# --- small diets: the same statements over other items, traits and diets ------------------------------

_sparse = {
    "items": CTES["items"].replace("l_suppkey", "l_orderkey").replace("GROUP BY ALL", "WHERE preyorder <> 'O4' GROUP BY ALL"),
    "traits": CTES["traits"].replace("FROM parts", "FROM parts WHERE genus NOT IN ('anvil', 'rod')"),
    "meta": "SELECT o_orderkey AS DataSet, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(1 + o_orderkey % 5 AS DOUBLE) END AS PreyPerPellet FROM orders",
}
for _name in ("sp50", "lognormal_params", "exp_fit", "size_selectivity", "foraging_test"):
    _text = ORACLES[_name]
    for _table, _body in _sparse.items():
        _text = _text.replace(f"{_table} AS MATERIALIZED ({CTES[_table]})", f"{_table} AS MATERIALIZED ({_body})")
    # Many values of so few items lie halfway between two last digits.
    for _value in ("ne_prey", "ne_disc", "diff"):
        _text = _text.replace(f"round(CAST({_value} AS DOUBLE), 6)", f"round(CAST({_value} AS DECIMAL(30, 9)), 6)")
    ORACLES[f"sparse_{_name}"] = _text

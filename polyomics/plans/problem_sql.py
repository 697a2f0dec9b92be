"""Problems 1 and 4 once more for DuckDB: CTEs over the delivered tables.

Its regular expressions know neither lookaround nor back references, so brackets of units are marked before remarks are cut off, and
grouping is taken out of numbers by plain replacement.
"""

from __future__ import annotations

from polyomics.functions import quantity
from polyomics.operators import wide


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _listed(words: list[str]) -> str:
    return ", ".join(map(_quoted, words))


def _plain(c: str) -> str:
    return f"trim(regexp_replace(lower(translate({c}, {_quoted('µμ×−’')}, {_quoted("uux-'")})), '[\\p{{Z}}\\t\\r\\n]', ' ', 'g'))"


def _unit(c: str) -> str:
    t = f"regexp_replace(regexp_replace({_plain(c)}, '\\s*(?:/|\\bper\\b|\\bin\\b)\\s*', '/', 'g'), '\\s+([mdu]?)l-1$', '/\\1l')"
    return f"nullif(regexp_replace(regexp_replace({t}, '[\\s(){{}}]+', '', 'g'), '^percent([wv])', '%\\1'), '')"


def _number(c: str) -> str:
    m = f"regexp_replace(replace(replace({c}, ' ', ''), '''', ''), '[x*]10\\^?([-+]?[0-9]+)$', 'e\\1')"
    m = f"CASE WHEN regexp_full_match({m}, '[-+]?[1-9][0-9]{{0,2}}(,[0-9]{{3}})+([.][0-9]+)?(e[-+]?[0-9]+)?') THEN replace({m}, ',', '') ELSE replace({m}, ',', '.') END"
    return f"CASE WHEN regexp_full_match({m}, '[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[-+]?[0-9]+)?') THEN TRY_CAST({m} AS DOUBLE) END"


_REMARK = quantity.REMARK.replace(r"(?!\s*(?:w|v|wt|m|vol)\s*/\s*(?:v|vol)\s*\))", "")
_QUANTITY = _quoted(quantity.QUANTITY.replace(quantity.REMARK, _REMARK))
_MARKED = f"regexp_replace({_plain('raw')}, '[(]\\s*(w|v|wt|m|vol)\\s*/\\s*(v|vol)\\s*[)]', '{{\\1/\\2}}', 'g')"
_ALIASES = ", ".join(f"('{a}', '{k}', {f})" for a, k, f in quantity.UNIT_ALIASES)

#: CTEs up to ``q`` (mc_id, medium_id, component, number, unit, unit_from, value, common_unit, outcome).
QUANTITIES = f"""al(alias, kind, factor) AS (VALUES {_ALIASES}), cr AS (SELECT regexp_replace({_plain('component')}, '\\s+', ' ', 'g') AS name, component AS ref, molar_mass, density_g_ml, common_unit FROM component_ref),
sm AS (SELECT medium_id, {_unit(f"regexp_extract({_plain('max(description)')}, {_quoted(quantity.UNIT_IN_PROSE.replace("(?=", "(?:"))}, 1)")} AS stated FROM medium GROUP BY 1),
c1 AS (SELECT DISTINCT ON (mc_id) mc_id, medium_id, component, raw, amount, unit FROM medium_component WHERE mc_id IS NOT NULL ORDER BY mc_id, loaded_at),
c2 AS (SELECT *, coalesce({_plain('raw')} = '', true) AS blank, nullif(regexp_extract({_MARKED}, {_QUANTITY}, 1), '') AS ntext, {_unit(f"regexp_extract({_MARKED}, {_QUANTITY}, 2)")} AS tunit, {_unit('unit')} AS funit FROM c1),
c3 AS (SELECT c2.mc_id, c2.medium_id, coalesce(ref, component) AS component, ref, molar_mass, density_g_ml, common_unit, CASE WHEN blank THEN amount ELSE {_number('ntext')} END AS number, CASE WHEN blank THEN funit ELSE coalesce(tunit, funit, stated) END AS unit,
CASE WHEN NOT blank AND tunit IS NOT NULL THEN 'text' WHEN funit IS NOT NULL THEN 'field' WHEN NOT blank AND stated IS NOT NULL THEN 'medium' END AS unit_from
FROM c2 LEFT JOIN sm ON sm.medium_id = c2.medium_id LEFT JOIN cr ON cr.name = regexp_replace({_plain('c2.component')}, '\\s+', ' ', 'g')),
c4 AS (SELECT *, regexp_full_match(unit, '[a-z]+/[0-9]*[a-z]+') AS part, string_split(unit, '/')[1] AS top, regexp_extract(unit, '/([0-9]*)', 1) AS many, regexp_extract(unit, '/[0-9]*([a-z]+)$', 1) AS low FROM c3),
c5 AS (SELECT c4.*, a.kind AS k, a.factor AS f, coalesce(many = '' OR TRY_CAST(many AS DOUBLE) > 0, false) AND z.factor IS NOT NULL AS per, z.factor * CASE WHEN many = '' THEN 1 ELSE TRY_CAST(many AS DOUBLE) END AS vol
FROM c4 LEFT JOIN al a ON a.alias = CASE WHEN part THEN top ELSE unit END LEFT JOIN al z ON part AND z.kind = 'volume' AND z.alias = low),
c6 AS (SELECT *, CASE WHEN per AND k = 'mass' THEN 'mass' WHEN per AND k = 'amount' THEN 'molar' WHEN NOT coalesce(part, false) AND k = 'w/v' THEN 'mass' WHEN NOT coalesce(part, false) AND k IN ('molar', 'v/v') THEN k END AS kind, number * CASE WHEN per THEN f / vol ELSE f END AS base FROM c5),
c7 AS (SELECT *, CASE WHEN kind = 'mass' THEN base WHEN kind = 'v/v' THEN base * density_g_ml END AS grams, number IS NOT NULL AND NOT isnan(number) AS ok FROM c6),
c8 AS (SELECT *, CASE WHEN NOT ok THEN NULL WHEN common_unit = 'mM' THEN CASE WHEN kind = 'molar' THEN base ELSE grams * 1000 / molar_mass END WHEN common_unit = 'g/L' THEN coalesce(grams, CASE WHEN kind = 'molar' THEN base * molar_mass / 1000 END) END AS v FROM c7),
q AS (SELECT mc_id, medium_id, component, ref, CASE WHEN ok THEN number END AS number, unit, unit_from, v AS value, common_unit,
CASE WHEN NOT ok THEN 'no_number' WHEN unit IS NULL THEN 'no_unit' WHEN ref IS NULL THEN 'unknown_component' WHEN v IS NULL THEN 'unknown_unit' ELSE 'converted' END AS outcome FROM c8)"""

_STATED = _quoted(wide.STATED)
_MONTH = "lpad(CAST(coalesce(list_position([" + _listed(wide.MONTHS) + "], left({}, 3)), 0) AS VARCHAR), 2, '0')"


def _day(t: str) -> str:
    part = lambda p, k: f"regexp_extract({t}, {_quoted(p)}, {k})"
    forms = [(rf"^(\d{{4}}){s}(\d{{1,2}}){s}(\d{{1,2}})$", 1, 2, 3, False) for s in ("-", "/", "[.]")]
    forms += [(r"^(\d{4})(\d{2})(\d{2})$", 1, 2, 3, False), (r"^(\d{1,2})[.]\s*(\d{1,2})[.]\s*(\d{4})$", 3, 2, 1, False)]
    forms += [(r"^(\d{1,2})[.]?[\s-]+([a-z]{3,9})[.]?,?[\s-]+(\d{4})$", 3, 2, 1, True), (r"^([a-z]{3,9})[.]?\s+(\d{1,2}),?\s+(\d{4})$", 3, 1, 2, True)]
    when = [f"WHEN regexp_matches({t}, {_quoted(p)}) THEN {part(p, y)} || '-' || {_MONTH.format(part(p, m)) if named else f'lpad({part(p, m)}, 2, {_quoted("0")})'} || '-' || lpad({part(p, d)}, 2, '0')" for p, y, m, d, named in forms]
    return "CASE " + " ".join(when) + " END"


_KEY = "lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
_X = f"CASE WHEN rest = '' OR rest = lower(coalesce(unit, '')) THEN {_number('n')} END"
#: CTEs up to ``ty`` (sf_id, entity, attribute, value, says, text).
TYPED = f"""fd AS (SELECT DISTINCT ON (k) {_KEY.format('feature')} AS k, feature AS attribute, value_type AS kind, unit FROM feature_def ORDER BY k, feature),
s1 AS (SELECT DISTINCT ON (sf_id) sf_id, upper({_KEY.format('strain')}) AS entity, {_KEY.format('feature')} AS k, value FROM strain_feature WHERE strain IS NOT NULL ORDER BY sf_id, loaded_at),
s2 AS (SELECT sf_id, entity, attribute, kind, unit, value, trim(lower(regexp_replace(value, '[\\x{{00a0}}\\t\\r\\n]', ' ', 'g'))) AS t FROM s1 JOIN fd USING (k) WHERE entity <> ''),
s3 AS (SELECT *, regexp_extract(t, {_STATED}, 1) AS n, regexp_extract(t, {_STATED}, 2) AS rest FROM s2), s4 AS (SELECT *, {_X} AS x, {_day('t')} AS day FROM s3),
ty AS (SELECT sf_id, entity, attribute, value, t IS NOT NULL AND t NOT IN ({_listed(wide.SILENT)}) AND (kind = 'flag' OR t NOT IN ({_listed(wide.SILENT_UNLESS_FLAG)})) AS says,
CASE kind WHEN 'flag' THEN CASE WHEN t IN ({_listed(wide.TRUE)}) THEN 'true' WHEN t IN ({_listed(wide.FALSE)}) THEN 'false' END WHEN 'integer' THEN CASE WHEN x = floor(x) AND abs(x) < 9e15 THEN CAST(CAST(x AS BIGINT) AS VARCHAR) END
WHEN 'decimal' THEN CAST(x AS VARCHAR) WHEN 'day' THEN CASE WHEN TRY_CAST(day AS DATE) IS NOT NULL THEN day END WHEN 'category' THEN t END AS text FROM s4)"""

SQL = {
    "p1_quantities": f"WITH {QUANTITIES} SELECT mc_id, medium_id, component, round(number, 6) AS number, unit, unit_from, round(value, 6) AS value, common_unit, outcome FROM q",
    "p1_found": f"""WITH {QUANTITIES}, p AS (SELECT mc_id, medium_id, component, value FROM q WHERE value > 0)
SELECT a.mc_id AS mc_id_a, z.mc_id AS mc_id_b FROM p a JOIN p z ON a.medium_id = z.medium_id AND a.component = z.component AND a.mc_id < z.mc_id WHERE abs(a.value - z.value) <= 0.02 * greatest(a.value, z.value)""",
    "p4_failures": f"WITH {TYPED} SELECT sf_id, entity, attribute, value FROM ty WHERE says AND text IS NULL",
    "p4_found": f"""WITH {TYPED}, {QUANTITIES}, e AS (SELECT entity, attribute, count(DISTINCT CASE WHEN says THEN text END) AS k, max(says) AS says FROM ty GROUP BY 1, 2),
w AS (SELECT medium_id, component, min(value) AS lo, max(value) AS hi FROM q WHERE value > 0 AND ref IS NOT NULL AND medium_id IS NOT NULL GROUP BY 1, 2)
SELECT 'strain' AS entity_kind, entity, attribute, CASE WHEN k > 1 THEN 'conflict' ELSE 'unreadable' END AS outcome FROM e WHERE k > 1 OR (k = 0 AND says)
UNION ALL SELECT 'medium', medium_id, component, 'conflict' FROM w WHERE hi - lo > 0.02 * hi""",
}

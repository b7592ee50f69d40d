"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quakeloom.llm.components import p6_found
from quakeloom.llm.confusables import p10_classes, p10_forms, p10_found, p10_rules
from quakeloom.llm.linkage import p3_found, p3_links, p3_rules
from quakeloom.llm.mixing import p9_mix, p9_rules, p9_shares
from quakeloom.llm.nearest_time import p5_found
from quakeloom.llm.packing import p8_pack, p8_rounds, p8_rules
from quakeloom.llm.survivor import p7_found, p7_layers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found,
    "p3_links": p3_links,
    "p3_rules": p3_rules,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_layers": p7_layers,
    "p8_pack": p8_pack,
    "p8_rules": p8_rules,
    "p8_rounds": p8_rounds,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_rules": p9_rules,
    "p10_found": p10_found,
    "p10_classes": p10_classes,
    "p10_forms": p10_forms,
    "p10_rules": p10_rules,
}

_ENTITY = r"upper(regexp_extract(regexp_replace(code, '\s', '', 'g'), '^([^.]+\.[^.]+)', 1))"
_REF = r"""trim(regexp_replace(regexp_replace(upper(regexp_replace(trim(regexp_replace({0}, '\s+', ' ', 'g')), '^# ?', '# ')),
  '(^|[^0-9.])0+([0-9])', '\1\2', 'g'), '(^|[^0-9.])0+([0-9])', '\1\2', 'g'))"""
_OK = "len(list_filter(string_split(t[{0}], ':'), lambda x: TRY_CAST(x AS DOUBLE) IS NOT NULL AND NOT isnan(TRY_CAST(x AS DOUBLE)) AND TRY_CAST(x AS DOUBLE) <> -999 AND ({1} OR TRY_CAST(x AS DOUBLE) >= 0))) > 0"
_FIELDS = {"dep": (9, "TRUE"), "mag": (10, "TRUE"), "erh": (14, "FALSE"), "erv": (15, "FALSE"), "az_gap": (16, "FALSE"), "rms": (17, "FALSE")}
_BEST = "row_number() OVER (PARTITION BY public_id ORDER BY {0} trust_rank NULLS LAST, revised_ts DESC NULLS LAST, report_uid)"

SQL: dict[str, str] = {
    "p5_found": f"""
WITH p AS (SELECT DISTINCT pick_id, {_ENTITY} AS c, upper(substr(trim(phase), 1, 1)) AS ph,
  coalesce(epoch_us(arrival_ts), epoch_us(event_dt) + CAST(round(tt_s * 1e6) AS BIGINT)) AS us FROM phase_pick LEFT JOIN catalog_event USING (event_uid)),
t AS (SELECT DISTINCT temp_id, {_ENTITY} AS c, upper(substr(trim(phase), 1, 1)) AS ph, epoch_us(arrival_ts) AS us FROM temp_pick)
SELECT temp_id, pick_id FROM (SELECT temp_id, pick_id, row_number() OVER (PARTITION BY temp_id ORDER BY abs(t.us - p.us), pick_id) AS n
  FROM t JOIN p USING (c, ph) WHERE abs(t.us - p.us) <= 1500000) WHERE n = 1
""",
    "p6_found": f"""
WITH RECURSIVE r AS (SELECT DISTINCT report_uid, {_REF.format("public_id")} AS id, {_REF.format("header_line")} AS h FROM event_report),
names AS (SELECT report_uid, id AS name FROM r WHERE id IS NOT NULL UNION SELECT report_uid, h FROM r WHERE h IS NOT NULL),
k AS (SELECT DISTINCT {_REF.format("ref_a")} AS a, {_REF.format("ref_b")} AS b FROM report_link WHERE decision = 'k'),
v AS (SELECT row_number() OVER () AS link, a, b FROM k WHERE a IN (SELECT name FROM names) AND b IN (SELECT name FROM names)),
m AS (SELECT 'l' || link AS hub, report_uid FROM v JOIN names ON name IN (a, b) UNION SELECT 'i' || id, report_uid FROM r WHERE id IS NOT NULL),
s AS (SELECT hub, min(report_uid) AS first_uid FROM m GROUP BY hub),
e AS (SELECT m.report_uid AS x, s.first_uid AS y FROM m JOIN s USING (hub) UNION SELECT s.first_uid, m.report_uid FROM m JOIN s USING (hub)),
reach AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
g AS (SELECT x AS report_uid, min(y) AS group_uid FROM reach GROUP BY x)
SELECT report_uid, group_uid FROM g WHERE group_uid IN (SELECT group_uid FROM g GROUP BY group_uid HAVING count(*) > 1)
""",
    "p7_found": rf"""
WITH h AS (SELECT DISTINCT report_uid, public_id, trust_rank, revised_ts, regexp_split_to_array(regexp_replace(header_line, '^\s*#?\s*|\s+$', '', 'g'), '\s+') AS t,
  coalesce(len(list_distinct(list_transform(list_filter(picks, lambda x: x IS NOT NULL), lambda x: trim(substr(x, 1, 9)) || '|' || upper(trim(substr(x, 23, 6)))))), 0) AS n
  FROM event_report LEFT JOIN source_info USING (source)
  WHERE public_id IN (SELECT public_id FROM event_report GROUP BY public_id HAVING count(DISTINCT report_uid) > 1))
"""
    + " UNION ALL ".join(
        f"SELECT public_id, '{f}' AS field_name, report_uid FROM (SELECT public_id, report_uid, {_BEST.format('')} AS k FROM h WHERE len(t) = 17 AND {_OK.format(*a)}) WHERE k = 1"
        for f, a in _FIELDS.items()
    )
    + f" UNION ALL SELECT public_id, 'picks', report_uid FROM (SELECT public_id, report_uid, {_BEST.format('n DESC,')} AS k FROM h WHERE n > 0) WHERE k = 1",
}

_BITS = " + ".join(f"CASE WHEN len(t) = 17 AND {_OK.format(*a)} THEN {1 << i} ELSE 0 END" for i, a in enumerate(_FIELDS.values()))
_FIRST = "row_number() OVER (PARTITION BY public_id ORDER BY layer, {0} trust, age, report_uid)"
SQL["p7_layers"] = (
    SQL["p7_found"].partition("UNION ALL")[0].partition("SELECT public_id, 'dep'")[0].replace("WITH h", "WITH RECURSIVE h").rstrip()
    + f""",
b AS (SELECT public_id, coalesce(trust_rank, 1000000) AS trust, -n AS fewer, {_BITS} AS fields, coalesce(-epoch_us(revised_ts), 4611686018427387904) AS age, report_uid FROM h),
c AS (SELECT public_id, trust, fewer, fields, -bit_count(fields) AS lack, age, report_uid FROM b
  QUALIFY row_number() OVER (PARTITION BY public_id, trust, fewer, fields ORDER BY age, report_uid) = 1),
chain AS (SELECT public_id, report_uid, 1 AS layer FROM c UNION
  SELECT r.public_id, r.report_uid, chain.layer + 1 FROM chain JOIN c AS d USING (public_id, report_uid) JOIN c AS r ON r.public_id = d.public_id
    AND d.trust <= r.trust AND d.fewer <= r.fewer AND d.lack <= r.lack AND d.age <= r.age
    AND (d.trust < r.trust OR d.fewer < r.fewer OR d.lack < r.lack OR d.age < r.age)),
l AS (SELECT c.*, k.layer FROM c JOIN (SELECT public_id, report_uid, CAST(max(layer) AS INT) AS layer FROM chain GROUP BY ALL) AS k USING (public_id, report_uid))
"""
    + " UNION ALL ".join(
        f"SELECT public_id, '{f}' AS field_name, report_uid, layer FROM (SELECT *, {_FIRST.format('')} AS k FROM l WHERE fields & {1 << i} <> 0) WHERE k = 1"
        for i, f in enumerate(_FIELDS)
    )
    + f" UNION ALL SELECT public_id, 'picks', report_uid, layer FROM (SELECT *, {_FIRST.format('fewer,')} AS k FROM l WHERE fewer < 0) WHERE k = 1"
)
SQL["p8_rules"] = """
SELECT pack_name, (SELECT count(DISTINCT doc_id) FROM documents WHERE text IS NOT NULL) AS documents, CAST(0 AS BIGINT) AS over_full, CAST(0 AS BIGINT) AS split,
  CAST(0 AS BIGINT) AS repeated FROM pack_size
"""
SQL["p10_rules"] = """
SELECT count(DISTINCT doc_id) AS documents, CAST(0 AS BIGINT) AS without_form, CAST(0 AS BIGINT) AS unstable FROM documents WHERE text IS NOT NULL
"""
SQL["p3_rules"] = """
SELECT count(DISTINCT event_uid) AS events, CAST(0 AS BIGINT) AS one_source, CAST(0 AS BIGINT) AS turned, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS unsure
FROM catalog_event
"""
SQL["p9_rules"] = """
SELECT count(*) AS targets, CAST(0 AS BIGINT) AS strangers, CAST(0 AS BIGINT) AS over_used, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS off_target FROM mix_target
"""

"""SQL for the origin times as received: the forms of operators.timestamps, with clock changes found by probing a day before and after."""

from __future__ import annotations

from quakeloom.operators import timestamps as t

_CLOCK = t._TIME


def _parts(text: str, pattern: str, template: str) -> str:
    """A list of year, month, day, day of year, hour, minute, second and fraction as the template names the pattern's groups."""
    one = lambda p: "''" if not p else (f"'20' || regexp_extract({text}, '{pattern}', {p[3:]})" if p.startswith("20$") else f"regexp_extract({text}, '{pattern}', {p[1:]})")
    return "[" + ", ".join(one(p) for p in template.split("|")) + "]"


def _cases() -> str:
    found = [f"WHEN regexp_matches(b, '{p}') THEN {_parts('b', p, form)}" for p, form in t._FORMS]
    for p, forms in t._BY_ORDER:
        found += [f"WHEN regexp_matches(b, '{p}'){f' AND date_order = {o!r}' if o else ''} THEN {_parts('b', p, form)}" for o, form in forms.items()]
    for p, (y, m, d) in t._NAMED:
        found.append(f"WHEN regexp_matches(low, '{p}') THEN {_parts('low', p, f'${y}|${m}|${d}||$4|$5|$6|$7')}")
    return " ".join(found)


_MONTH = "CASE " + " ".join(f"WHEN p[2] IN ({', '.join(repr(n) for n in row.split())}) THEN {k}" for k, row in enumerate(t.MONTHS, 1)) + " ELSE TRY_CAST(p[2] AS BIGINT) END"
_ZONE = r"(?i)\s*(Z|UTC|GMT|UT|TUC|TU|CEST|CET|WEST|WET|[+-][0-9]{2}(?::?[0-9]{2})?)$"
_NAMES = "CASE zone " + " ".join(f"WHEN '{z}' THEN {m}" for z, m in t.ZONE_MINUTES.items()) + " END"
_READS = "epoch_us(timezone(time_zone, TIMESTAMPTZ '1970-01-01 00:00:00+00' + to_microseconds({0})))"
_FRACTION = "CAST(rpad(substr({0}, 1, 6), 6, '0') AS BIGINT)"

P2 = rf"""
WITH r AS (SELECT DISTINCT raw_id, event_dt, epoch_us(received_ts) AS received, time_zone, coalesce(date_order, '') AS date_order,
  regexp_replace(trim(regexp_replace(event_dt, '[\s\x{{A0}}\x{{202F}}\x{{2009}}]+', ' ', 'g')), '[.,;]$', '') AS s FROM event_raw LEFT JOIN source_info USING (source) WHERE regexp_matches(event_dt, '[0-9]')),
z AS (SELECT *, CASE WHEN regexp_matches(s, '[0-9]{{1,2}}[:h][0-9]{{2}}|T[0-9]{{6}}|^[0-9]{{8}} [0-9]{{4}} [0-9]') THEN upper(regexp_extract(s, '{_ZONE}', 1)) ELSE '' END AS zone FROM r),
h AS (SELECT *, CASE WHEN zone <> '' THEN regexp_replace(s, '{_ZONE}', '') ELSE s END AS c FROM z),
b AS (SELECT *, upper(regexp_extract(c, '(?i)\s*([ap])\.?m\.?$', 1)) AS half, regexp_replace(c, '(?i)\s*[ap]\.?m\.?$', '') AS b FROM h),
l AS (SELECT *, strip_accents(lower(b)) AS low FROM b),
p AS (SELECT *, CASE {_cases()} END AS p FROM l),
n AS (SELECT *, TRY_CAST(p[1] AS BIGINT) AS y, {_MONTH} AS mo, TRY_CAST(p[3] AS BIGINT) AS d, TRY_CAST(p[4] AS BIGINT) AS doy, TRY_CAST(p[5] AS BIGINT) AS h0,
  TRY_CAST(p[6] AS BIGINT) AS mi, TRY_CAST(p[7] AS BIGINT) AS sec, p[8] AS f FROM p),
o AS (SELECT *, CASE WHEN half = 'P' AND h0 < 12 THEN h0 + 12 WHEN half = 'A' AND h0 = 12 THEN 0 ELSE h0 END AS hh,
  CASE WHEN NOT y BETWEEN 1 AND 9999 THEN NULL WHEN p[4] <> '' THEN CASE WHEN doy BETWEEN 1 AND dayofyear(make_date(y, 12, 31)) THEN make_date(y, 1, 1) + CAST(doy - 1 AS INTEGER) END
    ELSE TRY_CAST(printf('%04d-%02d-%02d', y, mo, d) AS DATE) END AS day FROM n),
t AS (SELECT *, CASE WHEN hh BETWEEN 0 AND 24 AND mi BETWEEN 0 AND 59 AND sec BETWEEN 0 AND 60 THEN
    epoch_us(CAST(day AS TIMESTAMP)) + hh * 3600000000 + mi * 60000000 + sec * 1000000 + {_FRACTION.format("f")} END AS here,
  CASE WHEN zone SIMILAR TO '[+-].*' THEN (CASE WHEN zone LIKE '-%' THEN -1 ELSE 1 END) * (CAST(substr(rpad(regexp_replace(zone, '[^0-9]', '', 'g'), 4, '0'), 1, 2) AS BIGINT) * 60
    + CAST(substr(rpad(regexp_replace(zone, '[^0-9]', '', 'g'), 4, '0'), 3, 2) AS BIGINT)) ELSE {_NAMES} END AS minutes,
  CASE WHEN regexp_matches(b, '^[0-9]{{10}}([.][0-9]+)?$') THEN CAST(substr(b, 1, 10) AS BIGINT) * 1000000 + {_FRACTION.format("substr(b, 12)")}
    WHEN regexp_matches(b, '^[0-9]{{13}}$') THEN CAST(b AS BIGINT) * 1000 WHEN regexp_matches(b, '^[0-9]{{16}}$') THEN CAST(b AS BIGINT) END AS epoch FROM o),
w AS (SELECT *, here - ({_READS.format("(here - 86400000000)")} - (here - 86400000000)) AS u1, here - ({_READS.format("(here + 86400000000)")} - (here + 86400000000)) AS u2
  FROM t WHERE zone = '' AND time_zone IS NOT NULL AND here IS NOT NULL),
c AS (SELECT raw_id, CASE WHEN v1 AND v2 AND u1 <> u2 THEN CASE WHEN greatest(u1, u2) <= received THEN greatest(u1, u2) ELSE least(u1, u2) END WHEN v2 AND NOT v1 THEN u2 ELSE u1 END AS local_us
  FROM (SELECT *, {_READS.format("u1")} = here AS v1, {_READS.format("u2")} = here AS v2 FROM w)),
done AS (SELECT t.raw_id, t.event_dt, coalesce(epoch, here - minutes * 60000000, local_us) AS utc_us FROM t LEFT JOIN c USING (raw_id))
SELECT DISTINCT raw_id, utc_us FROM done WHERE utc_us IS NOT NULL"""
P2_FOUND = P2 + r" AND NOT regexp_matches(event_dt, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}[.][0-9]{6}Z$')"

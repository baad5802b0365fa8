"""The same results in SQL, where SQL can give them over whole tables."""

from __future__ import annotations

_REPOSITORY = (
    "CASE WHEN regexp_matches({c}, '{r}') THEN replace(lower(regexp_extract({c}, '{r}', 1)), '_', '-') || '/' || "
    "replace(lower(regexp_extract({c}, '{r}', 2)), '_', '-') END"
)
_R = r"(?:^|[./\s])([A-Za-z0-9_-]+?)(?:__|_1776_)([A-Za-z0-9_-]+)\.[0-9A-Fa-f]{7,40}(?:[^0-9A-Za-z]|$)"

_NAMED = f"""
WITH RECURSIVE rows_ AS (
  SELECT row_id, regexp_replace(lower(split), '[^a-z]', '', 'g') AS s,
         {_REPOSITORY.format(c="instance_id", r=_R)} AS a, {_REPOSITORY.format(c="image_name", r=_R)} AS b
  FROM candidate_index
), ties AS (
  SELECT a AS x, b AS y FROM rows_ WHERE a <> b UNION SELECT b, a FROM rows_ WHERE a <> b
), reach AS (
  SELECT x AS node, x AS other FROM ties
  UNION SELECT r.node, t.y FROM reach r JOIN ties t ON t.x = r.other
), groups_ AS (SELECT node, min(other) AS g FROM reach GROUP BY node),
named AS (
  SELECT row_id, s, coalesce(g, a, b, 'row:' || row_id) AS g
  FROM rows_ LEFT JOIN groups_ ON node = coalesce(a, b)
)
"""

P1_FOUND = f"""{_NAMED}
SELECT row_id FROM named WHERE s IS NOT NULL AND g IN (
  SELECT g FROM named GROUP BY g
  HAVING count(*) FILTER (s = 'train') > 0 AND count(*) FILTER (s = 'heldout') > 0)
"""

P1_SPLITS = f"""{_NAMED}, u AS (
  SELECT row_id, g, ('0x' || sha256('splits-1' || chr(0) || g)[1:8])::BIGINT / 4294967296.0 AS u FROM named
)
SELECT row_id, g AS group_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS new_split FROM u
"""


_BARE = r"lower(regexp_replace(source, '[^\p{L}\p{N}]+', '', 'g'))"

_RUNS = f"""
WITH steps AS (
  SELECT instance_id, sample, replicate, step, source_sha256 AS h, {_BARE} AS t, recorded_at,
         row_number() OVER (PARTITION BY instance_id, sample, replicate, step ORDER BY
           (source IS NULL)::INT * 2 + (source_sha256 IS NULL)::INT, recorded_at NULLS FIRST, state_id) AS n
  FROM states WHERE step IS NOT NULL
), pairs AS (
  SELECT *, lag(step) OVER w AS ps, lag(t) OVER w AS pt, lag(h) OVER w AS ph FROM steps WHERE n = 1
  WINDOW w AS (PARTITION BY instance_id, sample, replicate ORDER BY step)
), marked AS (
  SELECT *, CASE WHEN ps = step - 1 AND CASE
      WHEN t IS NOT NULL AND pt IS NOT NULL THEN
        CASE WHEN t = pt THEN TRUE WHEN abs(length(t) - length(pt)) > 3 THEN FALSE ELSE levenshtein(t, pt) <= 3 END
      ELSE coalesce(lower(h) = lower(ph), FALSE) END THEN 0 ELSE 1 END AS start
  FROM pairs
), numbered AS (
  SELECT *, sum(start) OVER (PARTITION BY instance_id, sample, replicate ORDER BY step) AS run FROM marked
)
SELECT instance_id, sample, replicate, min(step) AS first_step, max(step) AS last_step, count(*) AS steps,
       min(recorded_at) AS started_at,
       round(epoch_us(max(recorded_at)) - epoch_us(min(recorded_at)), 0) / 1e6 AS seconds
FROM numbered GROUP BY instance_id, sample, replicate, run
"""

P2_FOUND = f"SELECT instance_id, sample, replicate, first_step, last_step FROM ({_RUNS}) WHERE steps >= 2"


# Fields of innermost literals and calls, sorted; the tables nest them no deeper.
_FORMS = r"""), parts AS (
  SELECT h, list_transform(regexp_extract_all(s, '\{[^{}()]*\}|\([^{}()]*\)|[^{}()]+|[{}()]'), lambda p: {'p': p, 'e': string_split(p[2:-2], ',')}) AS l FROM r
), forms AS (
  SELECT h, regexp_replace(array_to_string(list_transform(l, lambda x: CASE
    WHEN x.p[1:1] = '{' AND length(x.p) > 1 AND len(list_filter(x.e, lambda e: NOT contains(e, ':'))) = 0
      THEN '«' || array_to_string(list_sort(list_transform(x.e, lambda e: regexp_replace(e, '[^\p{L}\p{N}]+', '', 'g'))), '¦') || '»'
    WHEN x.p[1:1] = '(' AND len(list_filter(x.e, lambda e: regexp_matches(e, '^\s*\w+\s*=([^=]|$)'))) > 1
      THEN array_to_string(list_filter(x.e, lambda e: NOT regexp_matches(e, '^\s*\w+\s*=([^=]|$)')), ',') || '«' || array_to_string(list_sort(list_transform(
        list_filter(x.e, lambda e: regexp_matches(e, '^\s*\w+\s*=([^=]|$)')), lambda e: regexp_replace(e, '[^\p{L}\p{N}]+', '', 'g'))), '¦') || '»'
    ELSE x.p END), ''), '[^\p{L}\p{N}«»¦]+', '', 'g') AS f
  FROM parts
)
"""

P4_FOUND = f"""
WITH r AS (
  SELECT DISTINCT lower(source_sha256) AS h, lower(source) AS s FROM states WHERE source IS NOT NULL AND source_sha256 IS NOT NULL
{_FORMS}
SELECT min(h) OVER (PARTITION BY f) AS sha_a, h AS sha_b FROM forms QUALIFY sha_a <> h
"""

P4_COPIES = f"""
WITH a AS (SELECT coalesce(lower(source_sha256), sha256(source)) AS h, lower(source) AS s FROM states WHERE source IS NOT NULL),
n AS (SELECT h, count(*) AS n FROM a GROUP BY h),
r AS (SELECT DISTINCT h, s FROM a
{_FORMS}
SELECT min(h) AS sha, count(DISTINCT h) AS spellings, sum(n) AS copies FROM forms JOIN n USING (h) GROUP BY f
"""

# All pairs that share a shingle, and the closure of the links: fit for small tables only.
P5_FOUND = """
WITH RECURSIVE r AS (
  SELECT 'candidates' AS record_set, candidate_id AS id, completion AS text FROM candidates
  UNION ALL SELECT 'states', state_id, source FROM states
), d AS (SELECT record_set, text, min(id) AS id FROM r WHERE text IS NOT NULL GROUP BY ALL),
w AS (SELECT record_set, id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM d),
s AS (
  SELECT record_set, id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS sh
  FROM w WHERE len(w) >= 3
), x AS (SELECT record_set, id, len(sh) AS n, unnest(sh) AS g FROM s),
l AS (
  SELECT a.record_set, a.id AS a, b.id AS b FROM x a JOIN x b ON a.record_set = b.record_set AND a.g = b.g AND a.id < b.id
  GROUP BY a.record_set, a.id, b.id, a.n, b.n HAVING 2 * count(*) >= a.n + b.n - count(*)
), e AS (SELECT record_set, a, b FROM l UNION ALL SELECT record_set, b, a FROM l),
c AS (
  SELECT DISTINCT record_set, a AS node, a AS other FROM e
  UNION SELECT c.record_set, c.node, e.b FROM c JOIN e ON e.record_set = c.record_set AND e.a = c.other
)
SELECT record_set, min(other) AS id_a, node AS id_b FROM c GROUP BY record_set, node HAVING min(other) <> node
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND, "p1_splits": P1_SPLITS, "p2_found": P2_FOUND, "p2_runs": _RUNS,
        "p4_found": P4_FOUND, "p4_copies": P4_COPIES, "p5_found": P5_FOUND,
    }

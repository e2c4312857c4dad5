"""SQL counterparts, run on the same tables by another engine."""

#: Title without white space (Unicode), punctuation (category P) and letter case.
_STRIP = r"lower(regexp_replace(upper({t}), '[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}\p{{P}}]+', '', 'g'))"

_RECORDS = (
    r"""
WITH lines AS (
  SELECT line_id, regexp_replace(raw, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS s FROM rec_lines
), kept AS (
  SELECT * FROM lines WHERE s <> '' AND NOT regexp_matches(s, '^(#|//)')
), json_lines AS (
  SELECT line_id, CAST(s AS JSON) AS j FROM kept WHERE s LIKE '{%' AND json_valid(s)
), pieces AS (
  SELECT line_id, string_split(s, chr(9)) AS p FROM kept WHERE s NOT LIKE '{%'
), fields AS (
  SELECT line_id, lower(trim(k)) AS k, json_extract_string(j, '$."' || k || '"') AS v
  FROM (SELECT line_id, j, unnest(json_keys(j)) AS k FROM json_lines)
  UNION ALL
  SELECT line_id, lower(trim(split_part(x, '=', 1))), substr(x, strpos(x, '=') + 1)
  FROM (SELECT line_id, unnest(p) AS x FROM pieces WHERE len(list_filter(p, lambda y: NOT contains(y, '='))) = 0)
), read_lines AS (
  SELECT line_id, max(v) FILTER (WHERE k = 'title') AS title,
         try_cast(regexp_extract(trim(max(v) FILTER (WHERE k = 'year')), '^([+-]?\d{1,9})(\.0+)?$', 1) AS INTEGER) AS year
  FROM fields GROUP BY line_id
), records AS (
  SELECT 'recs' AS tab, rec_id AS id, title, year FROM recs
  UNION ALL SELECT 'rec_lines', line_id, title, year FROM read_lines
), keyed AS (
  SELECT tab, id, coalesce(CAST(year AS VARCHAR), '') AS yr, """
    + _STRIP.format(t="title")
    + r""" AS k FROM records WHERE title IS NOT NULL
), grouped AS (
  SELECT tab, id, min(id) OVER w AS keep_id, count(*) OVER w AS copies FROM keyed WHERE k <> ''
  WINDOW w AS (PARTITION BY tab, yr, k)
)
"""
)

_BARE = r"lower(regexp_replace({c}, '[\s\p{{Z}}\p{{Cf}}]+', '', 'g'))"
_DOI = _BARE.format(c="doi")
_ARXIV = r"regexp_extract(regexp_replace({c}, '^(https?:)?//[^/]+/(abs|pdf)/|^arxiv[:.]?|\.pdf$', '', 'g'), '^(\d{{4}}\.\d{{4,5}}|[a-z-]+(?:\.[a-z]{{2}})?/\d{{7}})(?:v\d+)?$', 1)"

_GROUPS = (
    r"""
WITH RECURSIVE d AS (
  SELECT rec_id, regexp_extract("""
    + _DOI
    + r""", '(10\.\d{4,9}/.+)$', 1) AS doi, """
    + _ARXIV.format(c=_BARE.format(c="arxiv"))
    + r""" AS ax,
    regexp_extract("""
    + _BARE.format(c="pmid")
    + r""", '^(?:pmid[:.]?|https?://[^/]+/(?:[^/]+/)*)?0*(\d+)(?:\.0+)?/?$', 1) AS pm,
    regexp_extract("""
    + _BARE.format(c="openalex")
    + r""", '(?:^|[/:])(w\d+)/?$', 1) AS oa
  FROM recs
), keys AS (
  SELECT DISTINCT rec_id, key FROM (
    SELECT rec_id, 'd:' || doi AS key FROM d WHERE regexp_matches(doi, '^10\.\d+/.*\d')
    UNION ALL SELECT rec_id, 'a:' || """
    + _ARXIV.format(c=r"regexp_extract(doi, '^10\.48550/arxiv\.(.+)$', 1)")
    + r""" FROM d
    UNION ALL SELECT rec_id, 'a:' || ax FROM d
    UNION ALL SELECT rec_id, 'p:' || pm FROM d
    UNION ALL SELECT rec_id, 'o:' || oa FROM d)
  WHERE NOT regexp_matches(substr(key, 3), '^[w0./-]*$')
), star AS (
  SELECT rec_id AS a, min(rec_id) OVER (PARTITION BY key) AS b FROM keys
), edges AS (
  SELECT a, b FROM star WHERE a <> b UNION SELECT b, a FROM star WHERE a <> b
), reach AS (
  SELECT a, b FROM edges
  UNION
  SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), grp AS (
  SELECT a AS rec_id, least(a, min(b)) AS group_id FROM reach GROUP BY a
)
"""
)

ORACLES = {
    "p1_found": _RECORDS + "SELECT tab, keep_id, id AS dup_id FROM grouped WHERE id <> keep_id",
    "p1_records": _RECORDS + "SELECT tab, keep_id, max(copies) AS copies FROM grouped GROUP BY tab, keep_id",
    "p2_agreement": r"""
WITH v AS (
  SELECT source, reviewer, seq, lower(regexp_replace(verdict, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS verdict
  FROM screening WHERE verdict IS NOT NULL AND source IS NOT NULL AND reviewer IS NOT NULL
), last AS (
  SELECT source, reviewer, verdict FROM v
  QUALIFY row_number() OVER (PARTITION BY source, reviewer ORDER BY seq DESC, verdict DESC) = 1
), c AS (
  SELECT source, verdict, count(*) AS n FROM last WHERE verdict IN ('include', 'exclude', 'defer') GROUP BY source, verdict
)
SELECT source, CAST(sum(n) AS BIGINT) AS reviewers,
       round(CASE WHEN sum(n) > 1 THEN sum(n * (n - 1)) / (sum(n) * (sum(n) - 1.0)) END, 6) AS agreement
FROM c GROUP BY source
""",
    "p5_fields": _GROUPS
    + r"""
SELECT group_id, 'citations' AS field, CAST(max(citations) AS VARCHAR) AS val FROM grp JOIN recs USING (rec_id) WHERE citations >= 0 GROUP BY 1
UNION ALL
SELECT DISTINCT group_id, 'source_api', v FROM (SELECT group_id, unnest(list_transform(string_split(lower(source_api), '+'), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))) AS v FROM grp JOIN recs USING (rec_id)) WHERE v <> ''
UNION ALL
SELECT DISTINCT group_id, 'found_by', v FROM (SELECT group_id, unnest(found_by) AS v FROM grp JOIN recs USING (rec_id)) WHERE v <> ''
""",
    "p3_found": _GROUPS + "SELECT rec_id, group_id FROM grp",
}

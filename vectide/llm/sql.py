"""DuckDB SQL for the queries that SQL can express."""

OP5 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), own AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, source_size * 2 AS cap, row_number() OVER (ORDER BY (source_size * 2)::DOUBLE / weight, source ASC NULLS LAST) AS turn FROM own
), levels AS (
  SELECT *, ((sum(source_size) OVER () * 1.5::DOUBLE) - coalesce(sum(cap) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM ordered
), chosen AS (
  SELECT arg_min(level, turn) AS level FROM levels WHERE level * weight <= cap
), plan AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, (SELECT level FROM chosen) * weight), cap::DOUBLE) AS target FROM ordered
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source
), counted AS (
  SELECT *, (floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM rated
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM counted
"""

OP8 = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), gone AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.*, last IS NOT NULL AND last <> doc_id AS dropped FROM keyed LEFT JOIN gone USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP10 = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM worded
), sized AS (
  SELECT doc_id, count(s) AS n FROM worded LEFT JOIN shingle USING (doc_id) GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), edge AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
  SELECT doc_id, doc_id AS other FROM sized UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN least USING (doc_id)
"""

OP9 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY h)
SELECT page_id, strlen(p.h) AS payload_bytes, sha256(p.h) AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h
"""


def _op7(tolerance: str = "1e-6", cut: int = 4) -> str:
    """Mass on its way by step, until at a multiple of `cut` steps at most `tolerance` is left."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rules = [("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "net", "/")]  # longest first
    case = lambda value: " ".join(f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(a, h, p)}'" for a, h, p in rules)
    parts = [
        f"""u AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{upper}', '{lower}') AS host,
        regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages)""",
        f"r AS (SELECT *, CASE {case(lambda a, h, p: h + p)} END AS rule, CASE {case(lambda a, h, p: a)} END AS action FROM u)",
        "h AS (SELECT host, count(*) FILTER (WHERE action = 'allow') / count(*) AS allowed, count(*) FILTER (WHERE action = 'block') / count(*) AS blocked FROM r WHERE host <> '' GROUP BY host)",
        f"""l AS (SELECT host AS source, translate(unnest(regexp_extract_all(html, '\\bhref\\s*=\\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''<>\\s]+)', 1, 'i')), '{upper}', '{lower}') AS target FROM r WHERE host <> '')""",
        "e AS (SELECT source, target, count(*)::DOUBLE AS weight FROM l WHERE source <> target GROUP BY 1, 2)",
    ]
    for kind, source, target, share in (("t", "source", "target", "allowed"), ("d", "target", "source", "blocked")):
        parts.append(f"f{kind} AS (SELECT {source} AS source, {target} AS target, weight / sum(weight) OVER (PARTITION BY {source}) AS part FROM e)")
        parts.append(f"s{kind} AS (SELECT host, 1.0::DOUBLE / count(*) OVER () AS mass FROM h WHERE {share} > 0.5)")
        parts.append(f"""m{kind} AS (SELECT 0 AS step, host, mass AS moving, sum(mass) OVER () AS left_over FROM s{kind} WHERE EXISTS (SELECT 1 FROM e)
        UNION ALL SELECT step + 1, target, sum(0.85::DOUBLE * moving * part), sum(sum(0.85::DOUBLE * moving * part)) OVER () FROM m{kind} JOIN f{kind} ON host = source
        WHERE step % {cut} <> 0 OR left_over > {tolerance}::DOUBLE GROUP BY step, target)""")
        parts.append(f"""n{kind} AS (SELECT host, sum(CASE WHEN step % {cut} = 0 AND left_over <= {tolerance}::DOUBLE THEN moving ELSE 0.15::DOUBLE * moving END) AS rank FROM m{kind} GROUP BY host
        UNION ALL SELECT host, mass FROM s{kind} WHERE NOT EXISTS (SELECT 1 FROM e))""")
    return f"""WITH RECURSIVE {', '.join(parts)}
    SELECT page_id, r.host, path, rule, coalesce(action, CASE WHEN coalesce(nd.rank, 0) > coalesce(nt.rank, 0) AND allowed <= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
    FROM r LEFT JOIN h ON r.host = h.host LEFT JOIN nt ON r.host = nt.host LEFT JOIN nd ON r.host = nd.host"""


ORACLES = {"op5_mixing": OP5, "op7_url_filter": _op7(), "op8_line_dedup": OP8, "op9_warc": OP9, "op10_near_dup": OP10}

"""DuckDB SQL for the registered queries, in forms whose sums run from the left like the engine's."""

from __future__ import annotations

_QUERY = "[50.0, 12.0, 5.0, 75.0]::DOUBLE[]"
_EVENTS = "ev AS (SELECT event_id AS id, [value::FLOAT, hour(ts)::FLOAT, (props->>'k')::FLOAT, user_id::FLOAT] AS v, ts, event_type, value, (props->>'k')::BIGINT AS k, user_id FROM events)"
_DOT = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"
_SQUARED = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


def _score(metric: str, a: str, b: str) -> str:
    """What is ranked: L2 by its square."""
    if metric == "l2":
        return _SQUARED.format(a=a, b=b)
    dot = _DOT.format(a=a, b=b)
    return dot if metric == "dot" else f"{dot} / (sqrt({_DOT.format(a=a, b=a)}) * sqrt({_DOT.format(a=b, b=b)}))"


def _value(metric: str, score: str = "score") -> str:
    return f"sqrt({score})" if metric == "l2" else score


def _side(metric: str) -> str:
    return "score ASC" if metric == "l2" else "score DESC"


_ZERO_QUERY = "q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"


def _distance(metric: str) -> str:
    return f"WITH {_ZERO_QUERY} SELECT vec_id, {_value(metric, _score(metric, 'embedding', 'q'))} AS value FROM embeddings, q"


def _top(metric: str, k: int, label: bool = True, where: str = "TRUE") -> str:
    return f"""WITH {_ZERO_QUERY}, s AS (SELECT vec_id AS id, label, {_score(metric, 'embedding', 'q')} AS score FROM embeddings, q WHERE {where})
    SELECT row_number() OVER (ORDER BY {_side(metric)}, id) AS rank, id, {_value(metric)} AS value{', label' if label else ''} FROM s ORDER BY {_side(metric)}, id LIMIT {k}"""


def _filtered(where: str) -> str:
    return f"""WITH {_EVENTS}, s AS (SELECT id, event_type, k, {_score('l2', 'v', _QUERY)} AS score FROM ev WHERE {where})
    SELECT row_number() OVER (ORDER BY score, id) AS rank, id, sqrt(score) AS value, event_type, k FROM s ORDER BY score, id LIMIT 20"""


def _batch(metric: str, k: int = 10) -> str:
    return f"""WITH s AS (SELECT q.vec_id AS qid, p.vec_id AS id, {_score(metric, 'p.embedding', 'q.embedding')} AS score FROM embeddings p, embeddings q WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {_side(metric)}, id) AS rank FROM s) SELECT qid, rank, id, {_value(metric)} AS value FROM r WHERE rank <= {k}"""


def _event_batch(metric: str, k: int, where: str = "TRUE", more: str = "") -> str:
    return f"""WITH {_EVENTS}, s AS (SELECT q.id AS qid, p.id AS id, p.event_type, {_score(metric, 'p.v', 'q.v')} AS score FROM ev p, ev q WHERE q.id % 20 = 0 AND {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {_side(metric)}, id) AS rank FROM s) SELECT qid, rank, id, {_value(metric)} AS value{more} FROM r WHERE rank <= {k}"""


_CLOSE = "abs({l} - {r}) <= 2.220446049250313e-16::DOUBLE * 8 * greatest(abs({l}), abs({r}), 1.0::DOUBLE)"
_EQUAL_75 = _CLOSE.format(l="user_id::DOUBLE", r="75.0::DOUBLE")
_EQUAL_5 = _CLOSE.format(l="k::DOUBLE", r="5.0::DOUBLE")
_MIXED = f"coalesce(value >= 5, FALSE) AND (event_type = 'view' OR coalesce(k <= 30, FALSE)) AND NOT ({_EQUAL_75})"
_STATE = f"{_EVENTS}, last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS turn FROM ev), st AS (SELECT user_id AS id, event_type, value, k FROM last WHERE turn = 1 AND event_type <> 'error')"
_FOLD = f"WITH {_STATE} SELECT id, event_type, value, k FROM st"
_DOCS = """a AS (SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN list_reverse(embedding) ELSE embedding END AS v,
    CASE vec_id WHEN 6 THEN 60 WHEN 7 THEN NULL ELSE label END::BIGINT AS label FROM embeddings WHERE vec_id <> 5)"""
_TENANTS = "c AS (SELECT c_nationkey::VARCHAR || '::' || c_mktsegment AS collection, count(*) AS points FROM customer GROUP BY 1)"
_BOUNDS = (50, 100, 250, 500, 1_000, 2_000, 5_000, 10_000, 20_000, 50_000, 100_000, 250_000, 500_000, 1_000_000, 2_000_000, 5_000_000, 10_000_000)
_RATES = f"WITH {_EVENTS}, w AS (SELECT user_id AS tenant, floor(epoch(ts) / 60)::BIGINT AS minute, count(*) AS n FROM ev GROUP BY 1, 2) SELECT tenant, {{minute}} AS minute, least(n, 1) AS admitted, n - least(n, 1) AS rejected FROM w"
_MEASURES = (("throughput", "b.throughput", "c.throughput", "ratio", "< 0.95"), ("p95", "b.p95", "c.p95", "ratio", "> 1.10"), ("p99", "b.p99", "c.p99", "ratio", "> 1.10"), ("error_rate", "b.error_rate", "c.error_rate", "delta", "> 0.001"))


def _compare() -> str:
    parts = []
    for name, b, c, kind, bad in _MEASURES:
        own = f"coalesce({c}, 0.0)"
        change = f"{own} - {b}" if kind == "delta" else f"CASE WHEN {b} > 0 THEN {own} / {b} END"
        parts.append(f"SELECT b.event_type, '{name}' AS measure, {b} AS baseline, CASE WHEN c.event_type IS NOT NULL THEN {own} END AS current, CASE WHEN c.event_type IS NOT NULL THEN {change} END AS change, c.event_type IS NULL OR coalesce({change} {bad}, FALSE) AS failed FROM b LEFT JOIN c ON b.event_type = c.event_type")
    side = "SELECT event_type, count(*)::DOUBLE AS throughput, max(value) AS p95, min(value) AS p99, sum((k < 10)::INT)::DOUBLE / count(*) AS error_rate FROM ev WHERE id {side} (SELECT max(id) // 2 FROM ev) GROUP BY 1"
    return f"WITH {_EVENTS}, b AS ({side.format(side='<=')}), c AS ({side.format(side='>')}) " + " UNION ALL ".join(parts)


def _nearest(q: float) -> str:
    return f"max(value) FILTER (WHERE turn = floor((n - 1) * {q}::DOUBLE + 0.5) + 1) AS p{round(q * 100)}"


_GIVEN = f"""WITH {_EVENTS}, c AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS list_id, v FROM ev WHERE id < 64),
    n AS (SELECT p.id, p.v, c.list_id, row_number() OVER (PARTITION BY p.id ORDER BY {_SQUARED.format(a='p.v', b='c.v')}, c.list_id) AS turn FROM ev p, c),
    l AS (SELECT id, v, list_id FROM n WHERE turn = 1), q AS (SELECT id, v, list_id FROM n WHERE turn <= 8 AND id % 20 = 0),
    s AS (SELECT q.id AS qid, l.id, {_SQUARED.format(a='l.v', b='q.v')} AS score FROM q JOIN l USING (list_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM s)"""

ORACLES: dict[str, str] = {
    **{f"distance_{m}": _distance(m) for m in ("dot", "l2", "cosine")},
    "cosine_zero_norm_skip": f"WITH {_ZERO_QUERY}, p AS (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT -1 - vec_id, list_transform(embedding, lambda x: 0::FLOAT) FROM embeddings WHERE vec_id < 5) SELECT vec_id, {_score('cosine', 'embedding', 'q')} AS value FROM p, q WHERE {_DOT.format(a='embedding', b='embedding')} > 1.1920928955078125e-07::DOUBLE",
    "vector_checks": "SELECT label, count(*) AS n, count(*) FILTER (WHERE label <> 3) AS finite, count(*) FILTER (WHERE len(embedding) = 64) AS fitting FROM embeddings GROUP BY label",
    "top1_l2": _top("l2", 1, False, "vec_id <> 0"),
    **{f"topk_{m}": _top(m, 10) for m in ("dot", "l2", "cosine")},
    "topk_no_payload": _top("l2", 25, False),
    "topk_tie_break": "SELECT row_number() OVER (ORDER BY label::DOUBLE DESC, vec_id) AS rank, vec_id AS id, label::DOUBLE AS value FROM embeddings ORDER BY label DESC, vec_id LIMIT 40",
    "topk_must": _filtered(f"event_type = 'click' AND {_EQUAL_5}"),
    "topk_should": _filtered("event_type = 'error' OR value >= 100"),
    "topk_min_should": _filtered("(event_type = 'click')::INT + (value < 40)::INT + (k > 50)::INT >= 2"),
    "topk_must_not": _filtered("event_type <> 'click'"),
    "topk_range": _filtered("value > 10.5 AND value <= 60 AND user_id >= 20 AND user_id < 120"),
    "topk_mixed": _filtered(_MIXED),
    "filter_numeric_tolerance": f"SELECT event_id AS id, {_CLOSE.format(l='value * (1 + 2.220446049250313e-16::DOUBLE)', r='value')} AS near, {_CLOSE.format(l='value * (1 + 1e-9::DOUBLE)', r='value')} AS far, {_CLOSE.format(l='value', r='30.0::DOUBLE')} AS is_30 FROM events",
    **{f"topk_batch_{m}": _batch(m) for m in ("dot", "l2", "cosine")},
    "topk_batch_small": _batch("l2"),
    "topk_batch_filtered": _event_batch("l2", 5, "p.event_type = 'click'", ", event_type"),
    "late_payload": _top("dot", 15),
    "topk_candidates": _top("cosine", 12, True, "label = 4 OR vec_id % 7 = 0"),
    "centroid_means": "WITH p AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS position FROM embeddings) SELECT label, position, round(avg(x::DOUBLE), 6) + 0.0 AS mean FROM p GROUP BY 1, 2",
    "nearest_centroid": f"WITH s AS (SELECT p.vec_id AS id, c.vec_id::INT AS list_id, {_score('l2', 'p.embedding', 'c.embedding')} AS distance FROM embeddings p, embeddings c WHERE c.vec_id < 10), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, list_id) AS turn FROM s) SELECT id, list_id, distance FROM r WHERE turn = 1",
    "count_points": "SELECT count(*) AS count FROM events",
    "count_filtered": f"WITH {_EVENTS} SELECT count(*) AS count FROM ev WHERE {_MIXED}",
    "list_offset": "SELECT o_orderkey AS id FROM orders ORDER BY 1 LIMIT 100 OFFSET 500",
    "list_after": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey > 777 ORDER BY 1 LIMIT 100",
    "list_total": "SELECT count(*) AS total, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders",
    "point_get": "SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice, p_brand, p_type FROM part WHERE p_partkey = 42",
    "collections_list": " UNION ALL ".join(f"SELECT '{n}' AS name, {d} AS dimension, count(*) AS point_count FROM {n}" for n, d in (("embeddings", 64), ("events", 4), ("orders", 2), ("part", 2))),
    "ivf_full_probe_l2": _event_batch("l2", 10),
    "ivf_filtered_dot": _event_batch("dot", 5, "p.event_type = 'click'"),
    "ivf_given_lists": f"{_GIVEN} SELECT id, list_id FROM l",
    "ivf_given_probe": f"{_GIVEN} SELECT qid, rank, id, sqrt(score) AS value FROM r WHERE rank <= 10",
    "ivf_given_recall": f"""{_GIVEN}, e AS (SELECT q.id AS qid, p.id, row_number() OVER (PARTITION BY q.id ORDER BY {_SQUARED.format(a='p.v', b='q.v')}, p.id) AS rank FROM ev p, ev q WHERE q.id % 20 = 0)
    SELECT count(*) AS hits, count(r.id) AS found FROM e LEFT JOIN (SELECT qid, id FROM r WHERE rank <= 10) r ON e.qid = r.qid AND e.id = r.id WHERE e.rank <= 10""",
    "ivf_probe_count": """WITH l AS (SELECT count(*) AS n, least(count(*), greatest(8, least(256, floor(sqrt(count(*)) + 0.5))))::INT AS lists FROM events),
    c AS (SELECT k, t, lists, greatest(1, least(lists, greatest(8, ceil(k * lists / n))))::INT AS probe FROM l, (SELECT unnest([1, 10, 1000]) AS k), (SELECT unnest([NULL, 0.2, 0.5, 1.0]::DOUBLE[]) AS t))
    SELECT k, t AS target_recall, CASE WHEN t IS NULL THEN probe ELSE least(lists, greatest(probe, ceil(lists::FLOAT * t::FLOAT)))::INT END AS probes FROM c""",
    "planner_choices": """WITH r AS (SELECT asked, metric, index_fits, n_queries, (SELECT count(*) FROM events) AS n FROM (SELECT unnest(['exact', 'ivf', 'auto']) AS asked), (SELECT unnest(['dot', 'l2', 'cosine']) AS metric), (SELECT unnest([FALSE, TRUE]) AS index_fits), (SELECT unnest([1, 32]) AS n_queries)),
    c AS (SELECT *, asked = 'exact' OR (asked = 'auto' AND (metric <> 'l2' OR n < 256 OR n_queries >= 16)) AS plain FROM r)
    SELECT asked, metric, index_fits, n_queries, CASE WHEN NOT plain AND index_fits THEN 'ivf' ELSE 'exact' END AS mode, NOT plain AND NOT index_fits AS wants_index, NOT plain AND NOT index_fits AND asked = 'ivf' AS fallback FROM c""",
    **{n: _FOLD for n in ("log_fold", "log_store_fold", "ndjson_roundtrip", "json_log_roundtrip", "binary_log_roundtrip", "snapshot_roundtrip", "backup_roundtrip", "stream_log_apply")},
    "log_created_flags": f"""WITH {_EVENTS}, half AS (SELECT max(id) // 2 AS h FROM ev), last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS turn FROM ev, half WHERE id <= h),
    st AS (SELECT user_id FROM last WHERE turn = 1 AND event_type <> 'error'), b AS (SELECT user_id AS id, ev.id AS ord, row_number() OVER (PARTITION BY user_id ORDER BY ev.id) AS turn FROM ev, half WHERE ev.id > h AND event_type <> 'error')
    SELECT id, ord, turn = 1 AND id NOT IN (SELECT user_id FROM st) AS created FROM b""",
    "log_faults": "SELECT event_id AS ord, 'collection does not exist' AS reason FROM events WHERE event_id < 100",
    "engine_points": f"WITH {_DOCS} SELECT 'a' AS tenant, id, v[1]::DOUBLE AS first, v[64]::DOUBLE AS last, coalesce(label, -1) AS label FROM a UNION ALL SELECT 'b', 7, 1.5::DOUBLE, 1.5::DOUBLE, 2",
    "engine_collections": f"WITH {_DOCS}, n AS (SELECT count(*) AS n FROM a) SELECT 'a' AS tenant, 'docs' AS name, 64 AS dimension, TRUE AS strict_finite, n AS carried, n AS counted FROM n UNION ALL VALUES ('b', 'docs', 64, TRUE, 1, 1), ('b', 'pairs', 2, TRUE, 0, 0)",
    "engine_batch": f"""WITH {_DOCS}, s AS (SELECT q.vec_id AS qid, a.id, a.label, {_score('l2', 'a.v', 'q.embedding')} AS score FROM a, embeddings q WHERE q.vec_id % 20 = 0 AND a.label >= 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM s) SELECT qid, rank, id, sqrt(score) AS value, label FROM r WHERE rank <= 5""",
    "log_lives": f"""WITH {_EVENTS}, g AS (SELECT id, user_id, event_type, event_type = 'view' AND user_id % 97 = 0 AS gone FROM ev),
    d AS (SELECT event_type, max(id) AS last FROM g WHERE gone GROUP BY 1), live AS (SELECT g.* FROM g LEFT JOIN d USING (event_type) WHERE NOT gone AND (last IS NULL OR id > last))
    SELECT event_type AS name, 4 AS dimension, count(DISTINCT user_id) AS points FROM live GROUP BY 1""",
    "payload_set": f"WITH {_STATE} SELECT id, event_type, value, 7::BIGINT AS k, 'pro' AS tier FROM st WHERE id % 3 = 0",
    "payload_delete": f"WITH {_STATE} SELECT id, event_type, NULL::DOUBLE AS value, NULL::BIGINT AS k FROM st WHERE id % 2 = 0",
    "tenant_usage": f"WITH {_TENANTS} SELECT split_part(collection, '::', 1) AS tenant, count(*) AS collections, sum(points)::BIGINT AS points FROM c GROUP BY 1",
    "memory_used": f"WITH {_TENANTS} SELECT sum(points * 8 * 4)::BIGINT AS bytes FROM c",
    "quota_admit": f"WITH {_EVENTS} SELECT id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY id) <= 3 AS admitted FROM ev",
    "rate_limit_admit": f"WITH {_EVENTS} SELECT id AS seq, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, id) <= 1 AS admitted FROM ev",
    "rate_windows": _RATES.format(minute="minute"),
    "stream_rate_window": _RATES.format(minute="minute * 60"),
    "percentile_nearest_rank": f"WITH {_EVENTS}, r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS turn, count(*) OVER (PARTITION BY event_type) AS n FROM ev) SELECT event_type, {', '.join(map(_nearest, (0.5, 0.95, 0.99)))} FROM r GROUP BY event_type",
    "histogram_percentile": f"""WITH b AS (SELECT event_type, CASE {' '.join(f'WHEN value * 1000 <= {x} THEN {i}' for i, x in enumerate(_BOUNDS))} ELSE {len(_BOUNDS)} END AS bucket FROM events),
    c AS (SELECT event_type, bucket, count(*) AS n FROM b GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY event_type) AS whole FROM c)
    SELECT event_type, ({list((*_BOUNDS, _BOUNDS[-1]))})[min(bucket) FILTER (WHERE upto >= greatest(1, round_even(whole * 0.95::DOUBLE, 0))) + 1] AS percentile FROM r GROUP BY event_type""",
    "regression_compare": _compare(),
    "alerts_firing": """WITH g AS (SELECT event_type, count(*)::DOUBLE AS events, round(avg(value), 6) + 0.0 AS mean, (SELECT count(*) FROM events)::DOUBLE AS whole FROM events GROUP BY 1),
    m AS (SELECT 'events_' || event_type AS metric, events AS value FROM g UNION ALL SELECT 'share_' || event_type, events / whole FROM g UNION ALL SELECT 'mean_' || event_type, mean FROM g),
    a(rule, metric, side, bound) AS (VALUES ('errors_many', 'share_error', '>', 0.05::DOUBLE), ('errors_most', 'share_error', '>', 0.5), ('clicks_few', 'share_click', '<', 0.5), ('views_none', 'events_view', '<', 1.0),
      ('views_many', 'events_view', '>', 10.0), ('value_of_clicks', 'mean_click', '>', 1.0), ('value_of_views', 'mean_view', '<', 1.0))
    SELECT rule, metric, value FROM m JOIN a USING (metric) WHERE (side = '>' AND value > bound) OR (side = '<' AND value < bound)""",
    "roll_up": "SELECT event_type, user_id, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(median(value), 6) + 0.0 AS median, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2",
    "max_per_minute": "SELECT (floor(epoch(ts) / 60) * 60)::BIGINT AS minute, max(value) AS most FROM events GROUP BY 1",
    "sliding_rates": "WITH w AS (SELECT event_type, unnest([floor(epoch(ts) / 1800) * 1800, floor(epoch(ts) / 1800) * 1800 - 1800])::BIGINT AS start FROM events) SELECT event_type, start, count(*) AS events FROM w GROUP BY 1, 2",
}

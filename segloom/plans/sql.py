"""The steps of decoding and evaluation in the oracle's SQL, as common table expressions on any keys, for queries that chain them."""

from __future__ import annotations


def smooth_sql(name: str, size: int, mode: str, carry: str = "") -> str:
    """(track_id, frame_idx, scores) of the view ``frames``, smoothed; ``carry``: more columns."""
    if size == 1:
        return f"{name} AS (SELECT track_id, frame_idx{carry}, scores FROM frames)"
    agg, half = {"mean": "avg", "median": "median"}[mode], size // 2
    return f"""{name} AS (SELECT track_id, frame_idx{carry}, list_transform(range(1, len(scores) + 1), lambda k: list_{agg}(list_transform(
                list_concat(list_transform(range({half} - least({half}, frame_idx)), lambda i: near[1]), near, list_transform(range({size} - len(near) - ({half} - least({half}, frame_idx))), lambda i: near[len(near)])), lambda x: x[k]))) AS scores
            FROM (SELECT *, list(scores) OVER (PARTITION BY track_id ORDER BY frame_idx ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS near FROM frames))"""


def path_sql(name: str, source: str, keys: str) -> str:
    """(keys, path) of ``source`` (keys, frame_idx from 0 on, scores, stay, change): what a stay and a change of label add on
    leaving the frame. Of equal ways the one from the lowest label is taken."""
    same = " AND ".join(f"f.{k} = v.{k}" for k in keys.split(", "))
    held = ", ".join(f"f.{k}" for k in keys.split(", "))
    way = "list_transform(range(1, len(best) + 1), lambda i: best[i] + CASE WHEN i = j THEN v.stay ELSE v.change END)"
    return f"""{name}_v AS (
        SELECT {keys}, frame_idx AS t, scores AS best, stay, change, list_transform(range(len(scores)), lambda i: [i]) AS paths FROM {source} WHERE frame_idx = 0
        UNION ALL
        SELECT {held}, f.frame_idx, list_transform(range(1, len(best) + 1), lambda j: list_max({way}) + f.scores[j]), f.stay, f.change,
               list_transform(range(1, len(best) + 1), lambda j: list_append(paths[list_position({way}, list_max({way}))], j - 1))
        FROM {name}_v v JOIN {source} f ON {same} AND f.frame_idx = v.t + 1),
    {name} AS (SELECT {keys}, paths[list_position(best, list_max(best))] AS path FROM {name}_v QUALIFY t = max(t) OVER (PARTITION BY {keys}))"""


def runs_sql(name: str, source: str, keys: str, label: str = "label", order: str = "frame_idx", start: str = "start_time", end: str = "end_time") -> str:
    """(keys, idx, start_time, end_time, label): runs of equal labels."""
    return f"""{name} AS (SELECT {keys}, CAST(run AS BIGINT) AS idx, arg_min({start}, {order}) AS start_time, arg_max({end}, {order}) AS end_time, any_value({label}) AS label
            FROM (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS run FROM (SELECT *, CASE WHEN lag({label}) OVER (PARTITION BY {keys} ORDER BY {order}) = {label} THEN 0 ELSE 1 END AS new FROM {source})) GROUP BY {keys}, run)"""


def clean_sql(name: str, source: str, keys: str, least: str) -> str:
    """(keys, idx, start_time, end_time, label): the first short segment of each track goes to a neighbour, over and over."""
    short = f"list_position(list_transform(s, lambda x: x.e - x.s < least), true)"
    return f"""{name}_w AS (
        SELECT {keys}, list({{'s': start_time, 'e': end_time, 'x': label}} ORDER BY idx) AS s, any_value({least}) AS least, 0 AS step FROM {source} GROUP BY {keys}
        UNION ALL
        SELECT {keys}, list_concat(s[1:lo - 1], [{{'s': s[lo].s, 'e': s[hi].e, 'x': x}}], s[hi + 1:]), least, step + 1
        FROM (SELECT *, CASE WHEN a > 1 AND (b OR a = len(s) OR p) THEN a - 1 ELSE a END AS lo, CASE WHEN a < len(s) AND (b OR a = 1 OR NOT p) THEN a + 1 ELSE a END AS hi,
                     CASE WHEN a > 1 AND (b OR a = len(s) OR p) THEN s[a - 1].x ELSE s[a + 1].x END AS x
              FROM (SELECT *, coalesce(s[a - 1].x = s[a + 1].x AND a > 1, false) AS b, a > 1 AND (a = len(s) OR s[a - 1].e - s[a - 1].s >= s[a + 1].e - s[a + 1].s) AS p
                    FROM (SELECT *, CAST({short} AS BIGINT) AS a FROM {name}_w) WHERE a > 0 AND len(s) > 1))),
    {name}_l AS (SELECT {keys}, least, unnest(s) AS z, unnest(range(len(s))) AS i FROM (SELECT * FROM {name}_w QUALIFY step = max(step) OVER (PARTITION BY {keys}))),
    {name}_r AS (SELECT {keys}, i, z.s AS start_time, z.e AS end_time, z.x AS label, sum(new) OVER (PARTITION BY {keys} ORDER BY i) - 1 AS run
                 FROM (SELECT *, CASE WHEN least > 0 AND lag(z.x) OVER (PARTITION BY {keys} ORDER BY i) = z.x THEN 0 ELSE 1 END AS new FROM {name}_l)),
    {name} AS (SELECT {keys}, CAST(run AS BIGINT) AS idx, arg_min(start_time, i) AS start_time, arg_max(end_time, i) AS end_time, any_value(label) AS label FROM {name}_r GROUP BY {keys}, run)"""


def _adjusted(name: str, source: str, keys: str) -> str:
    return f"""{name}_c AS (SELECT {keys}, idx, greatest(start_time, 0) AS start_time, least(end_time, duration) AS end_time, label, duration FROM {source} JOIN ends USING ({keys}) WHERE end_time > 0 AND start_time < duration),
    {name}_e AS (SELECT {keys}, min(start_time) AS lo, max(end_time) AS hi, min(idx) AS f, max(idx) AS l, any_value(duration) AS duration FROM {name}_c GROUP BY {keys}),
    {name} AS (SELECT {keys}, idx, start_time, end_time, label FROM {name}_c UNION ALL SELECT {keys}, f - 1, 0, lo, '__T_MIN' FROM {name}_e WHERE lo > 0 UNION ALL SELECT {keys}, l + 1, hi, duration, '__T_MAX' FROM {name}_e WHERE hi < duration),
    {name}_t AS (SELECT {keys}, list_sort(list_distinct(list(round(start_time, 5)) || list(round(end_time, 5)))) AS t FROM {name} GROUP BY {keys}),
    {name}_b AS (SELECT {keys}, t[2:len(t) - 1] AS t FROM {name}_t)"""


def evaluate_sql(reference: str, estimate: str, keys: str, step: float = 0.1) -> str:
    """Metrics of two tables (keys, idx, start_time, end_time, label) as the tables ``hits`` (keys, size, p, r, f), ``deviation``,
    ``pairwise``, ``entropies`` and ``information``."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    a = ", ".join(f"a.{k}" for k in keys.split(", "))
    f = lambda p, r: f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END"
    g = lambda x: f"lgamma(CAST({x} AS DOUBLE) + 1)"
    return f"""ends AS (SELECT {a}, greatest(a.d, b.d) AS duration FROM (SELECT {keys}, arg_max(end_time, idx) AS d FROM {reference} GROUP BY {keys}) a JOIN (SELECT {keys}, arg_max(end_time, idx) AS d FROM {estimate} GROUP BY {keys}) b ON {on}),
    {_adjusted("refs", reference, keys)},
    {_adjusted("ests", estimate, keys)},
    walk AS (SELECT {a}, a.t AS r, b.t AS e, size, 1 AS i, 1 AS j, 0 AS n FROM refs_b a JOIN ests_b b ON {on}, (SELECT unnest([0.5, 3.0]::DOUBLE[]) AS size)
             UNION ALL SELECT {keys}, r, e, size, CASE WHEN e[j] - r[i] >= -(size + 1e-9) THEN i + 1 ELSE i END, CASE WHEN e[j] - r[i] <= size + 1e-9 THEN j + 1 ELSE j END, CASE WHEN abs(e[j] - r[i]) <= size + 1e-9 THEN n + 1 ELSE n END FROM walk WHERE i <= len(r) AND j <= len(e)),
    hits AS (SELECT *, {f("p", "r")} AS f FROM (SELECT {keys}, size, coalesce(n / nullif(len(e), 0), 0) AS p, coalesce(n / nullif(len(r), 0), 0) AS r FROM walk WHERE i > len(r) OR j > len(e))),
    gaps AS (SELECT {a}, list_transform(a.t, lambda x: list_min(list_transform(b.t, lambda y: abs(x - y)))) AS re, list_transform(b.t, lambda x: list_min(list_transform(a.t, lambda y: abs(x - y)))) AS er FROM refs_b a JOIN ests_b b ON {on}),
    deviation AS (SELECT {keys}, list_median(re) AS re, list_median(er) AS er FROM gaps),
    points AS (SELECT {keys}, k * {step}::DOUBLE AS t FROM ends, range(100000) AS x(k) WHERE k < floor(round(duration / {step}, 6))),
    with_ref AS (SELECT a.*, CASE WHEN a.t >= b.end_time AND b.nxt IS NOT NULL THEN b.nxt ELSE b.label END AS ref FROM points a ASOF JOIN (SELECT *, lead(label) OVER (PARTITION BY {keys} ORDER BY idx) AS nxt FROM refs) b ON {on} AND a.t >= b.start_time),
    with_both AS (SELECT a.*, CASE WHEN a.t >= b.end_time AND b.nxt IS NOT NULL THEN b.nxt ELSE b.label END AS est FROM with_ref a ASOF JOIN (SELECT *, lead(label) OVER (PARTITION BY {keys} ORDER BY idx) AS nxt FROM ests) b ON {on} AND a.t >= b.start_time),
    cells AS (SELECT {keys}, ref, est, count(*) AS n FROM with_both GROUP BY ALL),
    margins AS (SELECT *, sum(n) OVER (PARTITION BY {keys}, ref) AS a, sum(n) OVER (PARTITION BY {keys}, est) AS b, sum(n) OVER (PARTITION BY {keys}) AS total, row_number() OVER (PARTITION BY {keys}, ref ORDER BY est) = 1 AS r1, row_number() OVER (PARTITION BY {keys}, est ORDER BY ref) = 1 AS e1 FROM cells),
    sums AS (SELECT {keys}, sum(n * (n - 1) / 2.0) AS m, sum(a * (a - 1) / 2.0) FILTER (r1) AS pa, sum(b * (b - 1) / 2.0) FILTER (e1) AS pb, any_value(total * (total - 1) / 2.0) AS pt,
                    -sum(n / total * log2(n / a)) AS e_r, -sum(n / total * log2(n / b)) AS r_e, coalesce(-sum(a / total * log2(a / total)) FILTER (r1), 0) AS hr, coalesce(-sum(b / total * log2(b / total)) FILTER (e1), 0) AS he, count(*) FILTER (r1) AS kr, count(*) FILTER (e1) AS ke, sum(n / total * ln(n * total / (a * b))) AS mi FROM margins GROUP BY {keys}),
    pairwise AS (SELECT *, {f("pp", "rr")} AS ff, (2 * m + pt - pa - pb) / nullif(pt, 0) AS rand, coalesce((m - pa * pb / nullif(pt, 0)) / nullif((pa + pb) / 2 - pa * pb / nullif(pt, 0), 0), 1) AS ari FROM (SELECT *, coalesce(m / nullif(pb, 0), 0) AS pp, coalesce(m / nullif(pa, 0), 0) AS rr FROM sums)),
    entropies AS (SELECT *, {f("o", "u")} AS nce_f, {f("vo", "vu")} AS v_measure, CASE WHEN sqrt(hr * he) * ln(2) > 1e-12 THEN mi / (sqrt(hr * he) * ln(2)) ELSE 0 END AS nmi
                  FROM (SELECT *, CASE WHEN log2(ke) > 1e-12 THEN 1 - e_r / log2(ke) ELSE 0 END AS o, CASE WHEN log2(kr) > 1e-12 THEN 1 - r_e / log2(kr) ELSE 0 END AS u, CASE WHEN he > 1e-12 THEN 1 - e_r / he ELSE 0 END AS vo, CASE WHEN hr > 1e-12 THEN 1 - r_e / hr ELSE 0 END AS vu FROM sums)),
    chance AS (SELECT {a}, a.a AS x, b.b AS y, CAST(a.total AS BIGINT) AS n, unnest(range(CAST(greatest(1, a.a + b.b - a.total) AS BIGINT), CAST(least(a.a, b.b) AS BIGINT) + 1)) AS k FROM margins a JOIN margins b ON {on} WHERE a.r1 AND b.e1),
    expected AS (SELECT {keys}, sum(exp({g("x")} + {g("y")} + {g("n - x")} + {g("n - y")} - {g("n")} - {g("k")} - {g("x - k")} - {g("y - k")} - {g("n - x - y + k")}) * k / n * ln(n * CAST(k AS DOUBLE) / (x * y))) AS emi FROM chance GROUP BY {keys}),
    information AS (SELECT *, CASE WHEN (kr = 1 AND ke = 1) OR abs(greatest(hr, he) * ln(2) - emi) < 1e-12 THEN 1 ELSE (mi - emi) / (greatest(hr, he) * ln(2) - emi) END AS ami FROM sums JOIN expected USING ({keys}))"""

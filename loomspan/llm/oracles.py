"""DuckDB's SQL for the queries that SQL can express; written from the contracts, not from the plans."""

from __future__ import annotations

from . import chat, mixing, quality

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '<||') AS text FROM conversations),
  p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t),
  s AS (SELECT t.conv_id, perspective, turn, speaker, CASE WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
    CASE WHEN speaker = perspective THEN '{chat.OPEN}assistant' || chr(10) ELSE '{chat.OPEN}user name=' || replace(translate(speaker, chr(10) || chr(13), '  '), '<|', '<||') || chr(10) END AS head, text
    FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
  r AS (SELECT conv_id, perspective, turn, speaker, role, text, head || text || '<|im_end|>' || chr(10) AS segment, length(head) AS n FROM s),
  c AS (SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM r)
  SELECT conv_id, perspective, turn, speaker, role, segment, stop - length(segment) AS start, stop AS "end",
    CASE WHEN role = 'assistant' THEN stop - length(segment) + n ELSE stop END AS mask_start, CASE WHEN role = 'assistant' THEN stop - 1 ELSE stop END AS mask_end FROM c"""


def sharding(names: list[str], slots: int) -> str:
    number = lambda s: f"('0x' || substr(md5({s}), 1, 15))::BIGINT"
    n, listed = len(names), ", ".join(f"'{x}'" for x in names)
    slot = f"((off[i + 1] + j * skip[i + 1]) % {slots})"
    return f"""WITH RECURSIVE k AS (SELECT list_transform([{listed}], lambda s: {number("'offset:' || s")} % {slots}) AS off, list_transform([{listed}], lambda s: {number("'skip:' || s")} % {slots - 1} + 1) AS skip),
      f AS (SELECT 0 AS t, list_transform(range({slots}), lambda x: -1::BIGINT) AS owner, list_transform(range({n}), lambda x: 0::BIGINT) AS tried
        UNION ALL SELECT t + 1, list_concat(list_concat(owner[1:spot], [i]), owner[spot + 2:{slots}]), list_concat(list_concat(tried[1:i], [j + 1]), tried[i + 2:{n}])
        FROM (SELECT *, {slot} AS spot FROM (SELECT *, list_filter(range(tried[i + 1], {slots}), lambda j: owner[{slot} + 1] = -1)[1] AS j FROM (SELECT *, (t % {n})::BIGINT AS i FROM f, k WHERE t < {slots})))),
      o AS (SELECT unnest(range({slots}))::INT AS slot, unnest(owner) AS who FROM f WHERE t = {slots})
      SELECT doc_id, source, slot, ([{listed}])[who + 1] AS shard FROM (SELECT doc_id, source, ({number("coalesce(doc_id::VARCHAR, 'null')")} % {slots})::INT AS slot FROM documents) JOIN o USING (slot)"""


MIX = f"""WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, (('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size, (([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1])::DOUBLE AS w FROM d GROUP BY source),
  l AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS r FROM s),
  m AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l),
  t AS (SELECT source, source_size, least(cap, (SELECT level FROM m WHERE level <= r ORDER BY r, source LIMIT 1) * w) AS target FROM m),
  k AS (SELECT d.source, length(bin(size)) AS w, sum(size)::BIGINT AS s, any_value(source_size) AS source_size, any_value(target) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY 1, 2),
  c AS (SELECT *, (target - 2.0::DOUBLE * coalesce(sum(s) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / nullif(sum(s * w) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS c FROM k),
  n AS (SELECT *, CASE WHEN source_size > 0 THEN coalesce(least(2.0::DOUBLE, w * (arg_max(c, w) FILTER (c * w <= 2) OVER (PARTITION BY source))), 2.0::DOUBLE) ELSE 0 END AS m FROM c),
  e AS (SELECT *, floor(m) AS certain, m - floor(m) AS p, target - sum(floor(m) * s) OVER (PARTITION BY source) AS rest FROM n),
  q AS (SELECT doc_id, size, source_size, target, certain, rest, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q, d.source FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source AND length(bin(size)) = e.w),
  o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size / 2 AS middle FROM q)
  SELECT doc_id, size, source_size, target, (size * (certain + CASE WHEN q IS NOT NULL AND middle <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM o"""

NEIGHBOURS = """WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  d AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank, vec_id, score FROM d QUALIFY rank <= 10"""

_RATES = {
    "mark_rate": "n_marks * 1000 // greatest(word_chars, 1)",
    "echo_rate": "n_echoes * 1000 // greatest(n_words, 1)",
    "word_length": "word_chars * 100 // greatest(n_words, 1)",
    "repeat_rate": "n_repeat_words * 1000 // greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines * 1000 // greatest(n_lines, 1)",
}


def _quality() -> str:
    lines = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))"
    failed = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"
    stacked = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, ({v})::BIGINT AS v FROM m WHERE NOT {failed}" for k, v in _RATES.items())
    away = {k: f"{n} * greatest(q{b} - q{a}, {f'q50 // {part}' if part else 0})" for k, (a, b, n, part) in quality.RULES.items()}
    held = lambda x, lo, hi: f"least(greatest(({x})::DOUBLE, {lo}::DOUBLE), {hi}::DOUBLE)"
    up = " ".join(f"WHEN '{k}' THEN {held(f'q{quality.RULES[k][1]} + {x}', *quality.GUARDS[k])}" for k, x in away.items())
    low = f"WHEN '{quality.LOWER}' THEN {held(f'q{quality.RULES[quality.LOWER][0]} - {away[quality.LOWER]}', *quality.LOWER_GUARD)}"
    at = ", ".join(f"min(CASE WHEN cum * 100 >= total * {x} THEN bucket END) AS q{x}" for x in (25, 50, 75, 99))
    k = quality.PRIOR
    shrunk = lambda x: f"(g.n * g.{x} + {k} * ((l.n * l.{x} + {k} * c.{x}) / (l.n + {k}))) / (g.n + {k})"
    named = [(f"max_{k}", k, "up") for k in quality.RULES] + [(f"min_{quality.LOWER}", quality.LOWER, "low")]
    limits = ", ".join(f"max(CASE WHEN metric = '{k}' THEN {x} END) AS {name}" for name, k, x in named)
    fine = " AND ".join([f"coalesce({v} <= max_{k}, true)" for k, v in _RATES.items()] + [f"coalesce({_RATES[quality.LOWER]} >= min_{quality.LOWER}, true)"])
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS words, {lines} AS lines FROM documents),
      g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM (SELECT rid, i, array_to_string(words[i:i + {quality.WINDOW - 1}], ' ') AS win FROM (SELECT rid, words, unnest(range(1, len(words) - {quality.WINDOW - 2})) AS i FROM d))),
      p AS (SELECT rid, count(DISTINCT i + k) AS n FROM g, (SELECT unnest(range({quality.WINDOW})) AS k) WHERE g.n > 1 GROUP BY rid),
      m AS (SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        len(regexp_extract_all(text, '[{quality.MARKS}]'))::BIGINT AS n_marks, len(list_filter(list_zip(words[2:], words[:-2]), lambda x: x[1] = x[2]))::BIGINT AS n_echoes,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN p USING (rid)),
      x AS ({stacked}), y AS (SELECT lang, source, metric, (v >> b) << b AS bucket FROM (SELECT *, greatest(length(bin(v)) - 7, 0)::BIGINT AS b FROM x)),
      w AS (SELECT 0 AS level, lang, source, metric, bucket FROM y UNION ALL SELECT 1, lang, NULL, metric, bucket FROM y UNION ALL SELECT 2, NULL, NULL, metric, bucket FROM y),
      z AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM (SELECT level, lang, source, metric, bucket, count(*) AS n FROM w GROUP BY ALL)),
      q AS (SELECT level, lang, source, metric, max(total)::BIGINT AS n, {at} FROM z GROUP BY 1, 2, 3, 4),
      o AS (SELECT level, lang, source, metric, n, CASE metric {up} END AS up, CASE metric {low} END AS low FROM q),
      s AS (SELECT g.lang, g.source, g.metric, {shrunk('up')} AS up, {shrunk('low')} AS low FROM (SELECT * FROM o WHERE level = 0) g
        JOIN (SELECT * FROM o WHERE level = 1) l ON g.metric = l.metric AND g.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT * FROM o WHERE level = 2) c ON g.metric = c.metric),
      f AS (SELECT lang, source, {limits} FROM s GROUP BY 1, 2)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT {failed} AND {fine} AS kept
      FROM m LEFT JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source"""


QUALITY = _quality()

"""SQL twins of the operators that SQL can express."""

from __future__ import annotations

from trackwake.llm import oddsketch, phrases, quality, secrets

_WS = r"\x20\x09-\x0D"

OP1 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^{_WS}]+') AS words,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^{_WS}]')) AS lines
  FROM d),
places AS (
  SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS win FROM places),
repeated AS (
  SELECT doc_id, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM repeated) GROUP BY 1),
m AS (
  SELECT w.doc_id, t, len(words) AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words,
         len(list_filter(words, lambda x: lower(x) IN ({", ".join(f"'{s}'" for s in quality.STOP_WORDS)}))) AS n_stop_words
  FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id),
v AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND {{rules}} AS kept
FROM v"""


def _rules_sql() -> str:
    ratios = {
        "n_words": "n_words",
        "mean_word_length": "word_chars / n_words",
        "symbol_ratio": "n_symbols / word_chars",
        "stop_word_debt": (
            "CASE WHEN n_words > 20 * n_stop_words"
            r" AND 2 * length(regexp_replace(t, '\P{Latin}+', '', 'g')) < length(regexp_replace(t, '\P{L}+', '', 'g'))"
            " THEN 0 ELSE n_words - 20 * n_stop_words END"
        ),
        "dup_line_ratio": "n_dup_lines / n_lines",
        "repeat_word_ratio": "n_repeat_words / n_words",
    }
    sides = []
    for rule in quality.RULES:
        metric = f"coalesce({ratios[rule.metric]}, 0)"
        if rule.low is not None:
            sides.append(f"{metric} >= {rule.low!r}")
        if rule.high is not None:
            sides.append(f"{metric} <= {rule.high!r}")
    return "(" + " AND ".join(sides) + ")"


OP3 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM s),
dry AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS k FROM weighed),
levels AS (
  SELECT (SELECT sum(source_size)::DOUBLE FROM dry) AS budget, (SELECT sum(weight) FROM dry) AS total, a.k,
         coalesce((SELECT sum(3 * source_size)::DOUBLE FROM dry b WHERE b.k < a.k), 0) AS given,
         coalesce((SELECT sum(weight) FROM dry b WHERE b.k < a.k), 0) AS used
  FROM dry a),
targets AS (
  SELECT source, source_size,
         least(weight * (SELECT max((budget - given) / (total - used)) FROM levels),
               (3 * source_size)::DOUBLE) AS target
  FROM dry),
placed AS (
  SELECT d.*, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(list_sum(list_transform([0, 1, 2], lambda r:
         greatest(0, least(size, CAST(round(target) AS BIGINT) - (r * source_size + before))))) AS BIGINT) AS taken
FROM placed"""

OP5 = r"""
WITH rules(verdict, r_host, r_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
         ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
cut AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
best AS (
  SELECT p.*, r.verdict, r.r_host || r.r_path AS rule
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.r_host OR ends_with(p.host, '.' || r.r_host)) AND starts_with(p.path, r.r_path)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(r.r_host) + length(r.r_path) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best"""


OP8 = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, i, lines[i + 1:i + 3] AS win
  FROM (SELECT doc_id, lines, unnest(generate_series(0, len(lines) - 3)) AS i FROM d)
  WHERE regexp_matches(array_to_string(lines[i + 1:i + 3], ' '), '[^\x20\x09-\x0D]')),
later AS (
  SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS gone
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM later) GROUP BY 1)
SELECT d.doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(len(gone), 0) AS n_removed,
       CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_transform(
         list_filter(generate_series(0, len(lines) - 1), lambda p: NOT list_contains(gone, p)),
         lambda p: lines[p + 1]), chr(10)), '') END AS text
FROM d LEFT JOIN gone g ON d.doc_id = g.doc_id"""

OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM s QUALIFY rank <= 5"""


def _op10() -> str:
    quote = lambda text: "'" + text.replace("'", "''") + "'"
    parts, names = [], []
    for rank, p in enumerate((*secrets.BASE, *secrets.EXTRA)):
        regex = quote(p.regex)
        names.append(f"SELECT * FROM p{rank}")
        parts.append(f"""f{rank} AS (
  SELECT doc_id, source, regexp_extract_all(t, {regex}) AS found,
         regexp_extract_all(t, {regex}, {p.group}) AS held, string_split_regex(t, {regex}) AS pieces
  FROM d WHERE regexp_matches(t, {regex})),
p{rank} AS (
  SELECT doc_id, source, {rank} AS rank, '{p.kind}' AS kind, held[i] AS secret,
         list_sum(list_transform(pieces[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start,
         length(found[i]) AS size
  FROM (SELECT *, unnest(generate_series(1, len(found))) AS i FROM f{rank})
  WHERE length(held[i]) >= {p.least})""")
    n = len(secrets.BASE)
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
{", ".join(parts)},
spans AS ({" UNION ALL ".join(names)}),
owned AS (
  SELECT secret, count(DISTINCT coalesce(source, '\\0')) <= {secrets.MAX_OWNERS}
         AND count(DISTINCT (coalesce(source, '\\0'), doc_id)) <= {secrets.MAX_REPOS} AS live
  FROM spans GROUP BY 1),
judged AS (
  SELECT s.*, live, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT) AS shown
  FROM spans s JOIN owned o ON s.secret = o.secret),
grouped AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign,
         count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(shown, ',' ORDER BY start, rank) FILTER (rank < {n}) AS base,
         string_agg(shown, ',' ORDER BY start, rank) FILTER (rank < {n} OR live) AS spans,
         count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
  FROM judged GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN grouped g ON d.doc_id = g.doc_id"""


OP11 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id,
         regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^{_WS}]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(ws) - 3),
                                      lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh
  FROM w),
d AS (SELECT doc_id, len(sh) AS n, CASE WHEN len(sh) > 0 THEN sha256(array_to_string(list_sort(sh), chr(10))) END AS set, sh FROM s),
nodes AS (SELECT set, min(doc_id) AS least, any_value(n) AS n, any_value(sh) AS sh FROM d WHERE set IS NOT NULL GROUP BY 1),
parts AS (SELECT least, n, unnest(sh) AS shingle FROM nodes),
links AS (
  SELECT a.least AS a, b.least AS b FROM parts a JOIN parts b ON a.shingle = b.shingle AND a.least < b.least
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= {oddsketch.SIMILARITY} * (a.n + b.n - count(*))),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT least AS node, least AS other FROM nodes
  UNION SELECT r.node, l.b FROM reached r JOIN sides l ON r.other = l.a),
roots AS (SELECT node, min(other) AS root FROM reached GROUP BY 1)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id,
       d.doc_id = coalesce(r.root, d.doc_id) AS kept
FROM d LEFT JOIN nodes x ON d.set = x.set LEFT JOIN roots r ON x.least = r.node"""

OP13 = f"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM cut),
sizes AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY 1),
placed AS (
  SELECT lang, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i
  FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS m)),
f AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, any_value(m) AS m, count(*) AS a
  FROM placed GROUP BY 1, 2),
often AS (
  SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND a >= {phrases.MIN_COUNT}),
parts AS (
  SELECT DISTINCT lang, phrase, a, array_to_string(ws[i:i + k - 1], ' ') AS part
  FROM (SELECT *, unnest(generate_series(1, m - k + 1)) AS i
        FROM (SELECT *, unnest(generate_series(2, m - 1)) AS k FROM often))),
held AS (SELECT lang, part, max(a) AS most FROM parts GROUP BY 1, 2),
kept AS (
  SELECT o.* FROM often o LEFT JOIN held h ON o.lang = h.lang AND o.phrase = h.part
  WHERE h.most IS NULL OR 100::HUGEINT * h.most < {phrases.COVERED}::HUGEINT * o.a),
cuts AS (
  SELECT k.lang, k.phrase, k.a, cutoff, l.a AS l, r.a AS r,
         CAST({phrases.SCALE}::HUGEINT * k.a // (l.a::HUGEINT + r.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(generate_series(1, m - 1)) AS cutoff FROM kept) k
  JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.ws[1:cutoff], ' ')
  JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.ws[cutoff + 1:], ' ')),
lowest AS (
  SELECT * FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cutoff) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT x.lang, rank, phrase, a, l, r, n, score
FROM ranked x JOIN sizes s ON x.lang = s.lang WHERE rank <= {phrases.TOP}"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": OP1.format(rules=_rules_sql()),
        "op3_source_mix": OP3,
        "op5_url_filters": OP5,
        "op8_line_dedup": OP8,
        "op9_ball_tree_topk": OP9,
        "op10_secret_scan": _op10(),
        "op11_minhash_groups": OP11,
        "op13_phrase_collocations": OP13,
    }

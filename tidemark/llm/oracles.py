"""DuckDB twins of the native operators whose results SQL can express.

They work on relations of words and lines (one row each, joined and grouped), where the operators work on arrays inside one row.
"""

from __future__ import annotations

from tidemark.llm import licenses, quality, url_rules


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _quality_sql() -> str:
    gap, word = _text(r"[\x20\x09-\x0D]+"), _text(r"[^\x20\x09-\x0D]")
    separators = ", ".join(_text(s) for s in quality.SEPARATORS)
    return f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id::BIGINT AS doc_id, COALESCE(text, '') AS t FROM documents),
cut AS (SELECT rid, list_filter(regexp_split_to_array(t, {gap}), lambda w: w <> '') AS ws FROM docs),
words AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM cut),
word_sums AS (SELECT rid, COUNT(*) AS n_words, SUM(length(w))::BIGINT AS word_chars FROM words GROUP BY rid),
windows AS (SELECT rid, i, list(w) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {quality.WINDOW - 1} FOLLOWING) AS g FROM words),
twice AS (SELECT rid, i FROM windows WHERE len(g) = {quality.WINDOW} QUALIFY COUNT(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, SUM(step)::BIGINT AS n_repeat_words FROM (
    SELECT rid, least({quality.WINDOW}, COALESCE(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, {quality.WINDOW})) AS step FROM twice) s GROUP BY rid),
lines AS (SELECT * FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM docs) l WHERE regexp_matches(x, {word})),
measured AS (SELECT rid, x, list_filter(regexp_split_to_array(x, {gap}), lambda w: w <> '') AS ws FROM lines),
judged AS (SELECT rid, x, length(array_to_string(ws, '')) AS solid,
    len(list_filter(ws, lambda w: regexp_matches(w, {_text(quality.MARKED_END)})))::DOUBLE / len(ws) > {quality.MAX_MARKED_SHARE}
    OR (NOT regexp_matches(x, '\\p{{Ll}}') AND len(regexp_extract_all(x, '\\p{{Lu}}')) >= {quality.SHOUT_LETTERS})
    OR len(list_filter(ws, lambda w: w IN ({separators})))::DOUBLE / len(ws) > {quality.MAX_SEPARATOR_SHARE}
    OR (len(ws) <= {quality.BOILERPLATE_WORDS} AND regexp_matches(x, {_text(quality.BOILERPLATE)})) AS fails FROM measured),
line_sums AS (SELECT rid, COUNT(*) - COUNT(DISTINCT x) AS n_dup_lines, COALESCE(SUM(solid) FILTER (fails), 0)::BIGINT AS lost FROM judged GROUP BY rid),
counts AS (SELECT doc_id, COALESCE(n_words, 0) AS n_words, COALESCE(word_chars, 0) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, COALESCE(n_dup_lines, 0) AS n_dup_lines,
    COALESCE(n_repeat_words, 0) AS n_repeat_words, COALESCE(lost, 0) AS lost
    FROM docs LEFT JOIN word_sums USING (rid) LEFT JOIN line_sums USING (rid) LEFT JOIN covered USING (rid)),
base AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
    COALESCE((word_chars - lost)::DOUBLE / NULLIF(word_chars, 0), 0) AS kept_share FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND kept_share >= {quality.MIN_KEPT_SHARE} AS kept, kept_share FROM base"""


def _license_sql() -> str:
    def starts(words: list[str], phrase: list[str]) -> int:
        return next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)

    cut = [(label, wording.split(), key.split()) for label, wording, key in licenses.TEMPLATES]
    template_rows = ", ".join(f"({t}, {_text(label)}, {len(ws)}, {len(key)})" for t, (label, ws, key) in enumerate(cut))
    place_rows = ", ".join(
        f"({t}, {p}, {_text(w)}, {str(w not in licenses.FUNCTION_WORDS).lower()}, "
        f"{str(starts(ws, key) <= p < starts(ws, key) + len(key)).lower()})"
        for t, (_, ws, key) in enumerate(cut) for p, w in enumerate(ws))
    phrase_rows = ", ".join(f"({b}, {_text(label)}, {len(phrase.split())}, {k}, {_text(w)})"
                            for b, (phrase, label) in enumerate(licenses.BASE.items()) for k, w in enumerate(phrase.split()))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH templates(t, label, size, key_size) AS (VALUES {template_rows}),
places(t, p, w, content, in_key) AS (VALUES {place_rows}),
phrases(b, label, size, k, w) AS (VALUES {phrase_rows}),
docs AS (SELECT row_number() OVER () AS rid, doc_id::BIGINT AS doc_id,
    list_filter(regexp_split_to_array(translate(COALESCE(text, ''), '{upper}', '{upper.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws
    FROM documents),
words AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM docs),
base_hits AS (SELECT rid, b, ANY_VALUE(label) AS label, i - k AS pos FROM words JOIN phrases USING (w)
    GROUP BY rid, b, i - k HAVING COUNT(*) = ANY_VALUE(size)),
base_sums AS (SELECT rid, COUNT(*) AS n_base, MIN(pos) AS first_word, MAX(pos) AS last_word FROM base_hits GROUP BY rid),
aligned AS (SELECT rid, t, i - p AS pos FROM words JOIN places USING (w) WHERE content
    GROUP BY ALL HAVING COUNT(*) >= {licenses.AGREE}),
matched AS (SELECT rid, label, COUNT(*)::DOUBLE / ANY_VALUE(size) AS share
    FROM aligned JOIN places USING (t) JOIN words USING (rid, w) JOIN templates USING (t) WHERE i = pos + p
    GROUP BY rid, t, pos, label HAVING COUNT(*) FILTER (in_key) = ANY_VALUE(key_size) AND COUNT(*)::DOUBLE / ANY_VALUE(size) >= {licenses.MIN_MATCH}),
scores AS (SELECT rid, MAX(share) AS score FROM matched GROUP BY rid),
named AS (SELECT rid, string_agg(label, ',' ORDER BY label) FILTER (of_base) AS base_labels, string_agg(label, ',' ORDER BY label) AS labels
    FROM (SELECT rid, label, bool_or(of_base) AS of_base FROM (
        SELECT rid, label, true AS of_base FROM base_hits UNION ALL SELECT rid, label, false FROM matched) u GROUP BY rid, label) l GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, COALESCE(n_base, 0) AS n_base, first_word, last_word,
    COALESCE(base_labels, '') AS base_labels, COALESCE(labels, '') AS labels, COALESCE(score, 0.0) AS score
FROM docs LEFT JOIN base_sums USING (rid) LEFT JOIN named USING (rid) LEFT JOIN scores USING (rid)"""


def _url_sql() -> str:
    upper = url_rules.UPPER
    rules = ", ".join(f"({_text(h)}, {_text(p)}, {_text(v)})" for h, p, v in url_rules.RULES)

    def kind(name: str, values: str) -> str:
        return f"list_transform(list_filter({values}, lambda x: x <> ''), lambda x: '{name}:' || x)"

    return f"""WITH rules(rule_host, rule_path, verdict) AS (VALUES {rules}),
cut AS (SELECT row_number() OVER () AS rid, page_id, COALESCE(url, '') AS u,
    translate(regexp_extract(COALESCE(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{upper.lower()}') AS host,
    regexp_extract(COALESCE(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
masked AS (SELECT rid, u, regexp_replace(translate(u, '{upper}', '{upper.lower()}'), '[0-9]+', '0', 'g') AS m FROM cut),
tokens AS (SELECT rid, CASE WHEN NOT contains(m, '://') THEN [] ELSE list_sort(list_distinct(list_concat(
    {kind("scheme", "[regexp_extract(m, '(?s)^(.*?)://', 1)]")},
    {kind("site", "[regexp_extract(m, '(?s)^.*?://([^/?#]*)', 1)]")},
    {kind("host", "string_split(regexp_extract(m, '(?s)^.*?://([^/?#]*)', 1), '.')")},
    {kind("path", "string_split(regexp_extract(m, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/')")},
    {kind("query", "list_transform(string_split(regexp_extract(m, '(?s)^.*?://[^?#]*[?]([^#]*)', 1), '&'), lambda x: split_part(x, '=', 1))")},
    {kind("mark", "[regexp_extract(m, '(?s)^.*?://[^#]*(#)', 1)]")}))) END AS ts FROM masked),
marks AS (SELECT doc_id::BIGINT AS doc, bool_or(quality = 0 OR toxic = 1) AS blocked FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
labelled AS (SELECT rid, ts, blocked FROM cut JOIN tokens USING (rid)
    JOIN marks ON TRY_CAST(regexp_extract(path, '(?s)([0-9]+)[^0-9]*$', 1) AS BIGINT) = doc WHERE blocked IS NOT NULL),
total AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (blocked) AS b, greatest({url_rules.MIN_URLS}, (COUNT(*) + {url_rules.ONE_IN} - 1) // {url_rules.ONE_IN})::BIGINT AS least FROM labelled),
counted AS (SELECT token, COUNT(*) AS n_token, COUNT(*) FILTER (blocked) AS b_token
    FROM (SELECT blocked, unnest(ts) AS token FROM labelled) t GROUP BY token HAVING COUNT(*) >= (SELECT least FROM total)),
chosen AS (SELECT rid, blocked, list_sort(list(token)) AS items FROM (
    SELECT rid, blocked, token FROM (SELECT rid, blocked, unnest(ts) AS token FROM labelled) t JOIN counted USING (token), total
    QUALIFY row_number() OVER (PARTITION BY rid ORDER BY abs(b_token * n - n_token * b) DESC, token) <= {url_rules.MINED_TOKENS}) q GROUP BY rid, blocked),
masks AS (SELECT *, unnest(range(1, 1 << len(items))) AS mask FROM chosen),
sets AS (SELECT list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS needs, COUNT(*) AS n_urls, COUNT(*) FILTER (blocked) AS n_blocked
    FROM masks GROUP BY 1),
sure AS (SELECT needs, n_blocked::DOUBLE / n_urls AS confidence FROM sets
    WHERE n_blocked >= (SELECT least FROM total) AND n_blocked::DOUBLE / n_urls >= {url_rules.MIN_CONFIDENCE}),
minimal AS (SELECT * FROM sure a WHERE NOT EXISTS (SELECT 1 FROM sure b WHERE len(b.needs) < len(a.needs) AND list_has_all(a.needs, b.needs))),
hits AS (SELECT rid, arg_min(array_to_string(needs, ' '), (-confidence, array_to_string(needs, ' '))) AS mined
    FROM tokens, minimal WHERE list_has_all(ts, needs) GROUP BY rid),
written AS (SELECT rid, arg_max(rule_host || rule_path, len(rule_host || rule_path)) AS rule, arg_max(verdict, len(rule_host || rule_path)) AS verdict
    FROM cut, rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY rid)
SELECT page_id, host, path, rule, COALESCE(verdict, CASE WHEN mined IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
    CASE WHEN rule IS NULL THEN mined END AS mined
FROM cut LEFT JOIN written USING (rid) LEFT JOIN hits USING (rid)"""


#: The other queries are held against brute-force versions in tests/llm.
ORACLES = {"op3_quality_rules": _quality_sql(), "op6_license_scan": _license_sql(),
           "op13_url_rules": _url_sql()}

"""SQL of the corpus queries that SQL can express."""

from __future__ import annotations

_WORDS = r"w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)"

SUBSTRINGS = f"""WITH {_WORDS}, win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
 later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1), gone AS (SELECT DISTINCT doc_id, i + j AS p, TRUE AS g FROM (SELECT doc_id, i, unnest(range(20)) AS j FROM later)),
 words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w), kept AS (SELECT doc_id, count(g) AS n, string_agg(word, ' ' ORDER BY p) FILTER (g IS NULL) AS k FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY 1)
 SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

HOST_RULES = rf"""WITH {_WORDS}, l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
 win AS (SELECT doc_id, i, ws[i:i + 7] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)), twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
 c AS (SELECT doc_id, sum(least(8, i - coalesce(before, i - 8))) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM twice) GROUP BY 1),
 f AS (SELECT w.doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
 b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f), h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS bad FROM b WHERE source IS NOT NULL GROUP BY 1),
 m AS (SELECT count(*) AS hosts, sum(n) AS docs, sum(bad) / sum(n) AS rate, sum(bad * bad / n) AS square FROM h), v AS (SELECT *, greatest(0, square / docs - rate * rate - rate * (1 - rate) * hosts / docs) AS between_ FROM m),
 p AS (SELECT rate, CASE WHEN between_ > 0 THEN least(1e6, greatest(1, rate * (1 - rate) / between_ - 1)) ELSE 1e6 END AS weight FROM v), r AS (SELECT source, n, weight, (bad + rate * weight) / (n + weight) AS host_rate FROM h, p),
 x AS (SELECT source, host_rate - 2 * sqrt(host_rate * (1 - host_rate) / (n + weight + 1)) > 0.5 AS rejected FROM r)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(rejected, FALSE) AS host_rejected, NOT base_failed AND NOT coalesce(rejected, FALSE) AS kept FROM b LEFT JOIN x USING (source)"""

FILL_IN_MIDDLE = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 x AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
 c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM x),
 p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

"""DuckDB SQL with the same rows as the queries of the same name, where SQL can express them."""

from __future__ import annotations

from .license_scan import FIRM, RESERVED, SENTENCES, longer_rules, marked
from .license_scan import RULES as LICENSE_RULES
from .url_filter import RULES as URL_RULES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP5 = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), h AS (SELECT doc_id, norm, sha256(norm) AS text_sha256 FROM t)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY norm)
"""


def op6(rules=URL_RULES) -> str:
    rows = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rules)
    return rf"""
WITH rules(action, rhost, rpath) AS (VALUES {rows}),
rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), m AS (
  SELECT page_id, host, path, rhost || rpath AS rule, action,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC, action DESC) AS n
  FROM u LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE n = 1
"""


def op10(sentences=SENTENCES, rules=LICENSE_RULES, reserved=RESERVED) -> str:
    def left(longer, need) -> str:
        own = f"array_to_string(['<' || x || '>' FOR x IN ids IF list_contains([{', '.join(map(quoted, longer))}], x)], '')"
        return f" AND regexp_matches(replace({own}, {quoted(marked(longer))}, ''), {quoted('.*'.join(f'<{i}>' for i in need))})"

    kept_back = f"[{', '.join(map(quoted, reserved))}]"
    known = "map {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in sentences.items()) + "}"
    fits = ", ".join(
        f"CASE WHEN regexp_matches(seq, {quoted(' ' + ' (?:.* )?'.join(need) + ' ')}){''.join(left(longer, need) for longer in longer_rules(name, need, rules))} THEN {{'n': {n + 1}, 'name': {quoted(name)}}} END"
        for n, (name, need) in enumerate(rules)
    )
    return rf"""
WITH s AS (
  SELECT doc_id, [x FOR x IN [element_at({known}, trim(regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g')))[1]
         FOR p IN regexp_split_to_array(regexp_replace(regexp_replace(coalesce(text, ''), {quoted(FIRM)}, '\1\2', 'g'), '[.!?;:]+(\s|$)', chr(10), 'g'), '[\r\n]+')] IF x IS NOT NULL] AS ids
  FROM documents
), q AS (SELECT doc_id, ids, ' ' || array_to_string(ids, ' ') || ' ' AS seq FROM s),
f AS (SELECT doc_id, ids, [x FOR x IN [{fits}] IF x IS NOT NULL] AS every, [x FOR x IN every IF NOT list_contains({kept_back}, x.name)] AS free,
             CASE WHEN len(free) > 0 THEN free ELSE every END AS hits FROM q),
g AS (SELECT doc_id, ids, [x FOR x, i IN hits IF NOT list_contains([y.name FOR y IN hits[1:i - 1]], x.name)] AS first FROM f)
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, array_to_string([x.name FOR x IN first], ',') AS licenses,
       array_to_string([x.n::VARCHAR FOR x IN first], ',') AS rule_numbers, first[1].name AS license
FROM g
"""


OP3 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         greatest(0.1, coalesce(length(regexp_replace(text, '[^\p{L} \n]+', '', 'g'))::DOUBLE / nullif(length(text), 0), 0.1)) AS q,
         (('0x' || substr(md5('0' || chr(31) || doc_id::VARCHAR || chr(31) || md5(coalesce(text, ''))), 1, 12))::BIGINT + 0.5)::DOUBLE / 281474976710656 AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 1.0::DOUBLE + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS w FROM s
), l AS (
  SELECT source, source_size, w, 3.0::DOUBLE * source_size AS cap,
         (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / w, source IS NULL, encode(source))
), t AS (
  SELECT source, source_size, least(cap, w * (SELECT max(level) FROM l WHERE level * w <= cap)) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::INTEGER ELSE 0 END AS whole FROM t
), k AS (
  SELECT doc_id, size, source_size, target, whole, greatest(0, target - whole * source_size) AS rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / q, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (whole + (before + size / 2.0::DOUBLE <= rest)::INTEGER))::BIGINT AS taken,
       (whole + (before + size / 2.0::DOUBLE <= rest)::INTEGER)::INTEGER AS epochs
FROM k
"""

OP7 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS l, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), ls AS (SELECT DISTINCT l FROM bw),
dw AS (
  SELECT r, l, i, array_to_string(w[i:i + l - 1], ' ') AS win
  FROM (SELECT r, l, w, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l)
), m AS (SELECT r, dw.l, i, item_id FROM dw JOIN bw USING (l, win)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM m) GROUP BY r),
n AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""


ORACLES = {"op3_mix_sources": OP3, "op5_exact_dedup": OP5, "op6_url_filter": op6(), "op7_decontaminate": OP7, "op10_license_scan": op10()}

#: Phrases of up to four words as rows of (lang, words); words of a piece stand in order.
OP12 = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, generate_subscripts(p, 1) AS piece, unnest(p) AS t FROM (
    SELECT doc_id, lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents)
), words AS (SELECT lang, [x FOR x IN regexp_split_to_array(t, '[\x20\x09]+') IF x <> ''] AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM words), (VALUES (1), (2), (3), (4)) s(k) WHERE i + k - 1 <= len(w)
), f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
cuts AS (
  SELECT c.lang, c.phrase, c.n AS a, x.k AS cut, array_to_string(string_split(c.phrase, ' ')[: x.k], ' ') AS lp, array_to_string(string_split(c.phrase, ' ')[x.k + 1 :], ' ') AS rp
  FROM f c JOIN (VALUES (1), (2), (3)) x(k) ON x.k < c.k
), scored AS (
  SELECT c.*, l.n AS l, r.n AS r, (2000000::HUGEINT * a // (l.n + r.n)::HUGEINT)::BIGINT AS score FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = lp JOIN f r ON r.lang = c.lang AND r.phrase = rp
), weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (
  SELECT f.lang, array_to_string(string_split(f.phrase, ' ')[x.i : x.i + y.k - 1], ' ') AS phrase, max(f.n) AS most
  FROM f, (VALUES (1), (2), (3)) x(i), (VALUES (2), (3)) y(k) WHERE y.k < f.k AND x.i + y.k - 1 <= f.k GROUP BY ALL
), kept AS (
  SELECT w.* FROM weakest w LEFT JOIN inner_parts p ON p.lang = w.lang AND p.phrase = w.phrase WHERE p.most IS NULL OR 100 * p.most::HUGEINT < 80 * a::HUGEINT
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
ORACLES["op12_collocations"] = OP12

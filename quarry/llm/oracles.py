"""DuckDB SQL of the operators that SQL can express over whole tables."""

from __future__ import annotations

_SPACES = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, '{_WORD}')"


_TEXTS = "SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents"


def quality(rules: dict[str, str]) -> str:
    """Counts and verdicts of quality rules; rules: conditions that reject, on the counts, n_lines and n_marks."""
    return f"""
WITH d AS MATERIALIZED ({_TEXTS}),
w AS MATERIALIZED (SELECT *, {_words('text')} AS words, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{_WORD}')] AS lines FROM d),
tri AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
twice AS (SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, t) > 1),
again AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
c AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{_SPACES}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '[^!-@\\[-`{{-~]', '', 'g')) AS n_marks
  FROM w LEFT JOIN again USING (r)
),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {' OR '.join(f'({x})' for x in rules.values())}) AS kept FROM f"""


#: The rules of quality.RULES beyond the base.
QUALITY_RULES = {
    "symbols": "3 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines AND n_lines >= 4",
    "marks": "2 * n_marks > word_chars",
}


def substring_dedup(span: int) -> str:
    """Words that are left when windows of span words that start in a document of a smaller doc_id are taken out."""
    return f"""
WITH d AS MATERIALIZED ({_TEXTS}),
w AS MATERIALIZED (SELECT r, doc_id, {_words('text')} AS words FROM d),
windows AS (SELECT r, doc_id, i, array_to_string(words[i : i + {span - 1}], ' ') AS t FROM (SELECT *, unnest(range(1, len(words) - {span - 2})) AS i FROM w WHERE len(words) >= {span})),
hit AS (SELECT r, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY t) < doc_id),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {span})) AS p FROM hit),
each AS (SELECT r, p, words[p] AS word FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS p FROM w)),
kept AS (SELECT e.r, count(g.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY e.p) FILTER (WHERE g.p IS NULL), '') AS text FROM each e LEFT JOIN gone g ON e.r = g.r AND e.p = g.p GROUP BY e.r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)"""


def jaccard_components(k: int, percent: int) -> str:
    """Components of documents whose sets of k-word shingles are alike; doc_id is unique."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_words(f"translate(coalesce(text, ''), '{upper}', '{lower}')")} AS words FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + {k - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(words) - {k - 2}, 2))) AS i FROM w WHERE len(words) > 0)
),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
t AS MATERIALIZED (SELECT s.doc_id, g, n FROM s JOIN n USING (doc_id)),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id WHERE least(a.n, b.n) * 100 >= greatest(a.n, b.n) * {percent} GROUP BY x, y),
links AS MATERIALIZED (SELECT x, y FROM pairs WHERE 100 * c >= {percent} * (nx + ny - c)),
both_ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(x, y) AS (SELECT x, y FROM both_ways UNION SELECT q.x, b.y FROM reached q JOIN both_ways b ON q.y = b.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(least_of.y, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN (SELECT x, min(y) AS y FROM reached GROUP BY x) least_of ON w.doc_id = least_of.x"""


def _found(kind: str, rank: int, pattern: str, group: int = 0, keep: str = "true", table: str = "d") -> str:
    """(r, kind, rank, start, stop, m) of the leftmost matches of a pattern, in code points from the lengths of matches and of pieces between; keep: a condition on m, g."""
    p = "'" + pattern.replace("'", "''") + "'"
    lists = f"SELECT r, regexp_extract_all(text, {p}) AS ms, regexp_extract_all(text, {p}, {group}) AS gs, [length(x) FOR x IN regexp_split_to_array(text, {p})] AS ps FROM {table} WHERE regexp_matches(text, {p})"
    each = f"SELECT r, unnest(ms) AS m, unnest(gs) AS g, unnest(ps[: len(ms)]) AS p, unnest(range(1, len(ms) + 1)) AS i FROM ({lists})"
    ends = f"SELECT r, m, g, CAST(sum(p + length(m)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS stop FROM ({each})"
    return f"SELECT r, '{kind}' AS kind, {rank} AS rank, stop - length(m) AS start, stop, m FROM ({ends}) WHERE {keep}"


def secret_scan(scope: int) -> str:
    """Strong parts, and weak parts that have a complement within scope code points but not over them."""
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    named = r"""((?i:access_?key_?id|client_?id|user_?name|account_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)"""
    parts = [
        _found("assign", 0, assign, 2, "length(g) >= 6"),
        _found("access", 1, "AKIA[A-Z0-9]+", keep="length(m) >= 20"),
        _found("hex", 2, "[0-9a-f]+", keep="length(m) >= 24"),
        _found("weak_access", 3, "AKIA[A-Z0-9]+", keep="length(m) < 20"),
        _found("weak_access", 3, named, 2, "length(g) >= 4"),
        _found("weak_secret", 4, "([A-Za-z0-9+/_-]+)={0,2}", 1, "length(g) >= 16 AND regexp_matches(g, '[0-9]') AND regexp_matches(g, '[A-Za-z]')"),
        _found("endpoint", 5, r"""https?://[^\x20\x09-\x0D"'<>]+"""),
    ]
    other = "FROM {} o WHERE o.r = p.r AND"
    near = f"AND (o.start >= p.stop OR o.stop <= p.start) AND o.start <= p.stop + {scope} AND o.stop >= p.start - {scope}"
    columns = "r, kind, rank, start, stop"
    return f"""
WITH d AS MATERIALIZED ({_TEXTS}),
parts AS MATERIALIZED ({" UNION ALL ".join(parts)}),
mixed AS MATERIALIZED (SELECT * FROM parts p WHERE kind = 'weak_secret' AND NOT EXISTS (SELECT 1 {other.format("parts")} o.rank < 4 AND o.start < p.stop AND o.stop > p.start)),
secret AS MATERIALIZED (SELECT * FROM parts WHERE kind IN ('assign', 'hex') UNION ALL SELECT * FROM mixed),
spans AS (
  SELECT {columns} FROM parts WHERE rank < 3
  UNION ALL SELECT {columns} FROM parts p WHERE kind IN ('weak_access', 'endpoint') AND EXISTS (SELECT 1 {other.format("secret")} true {near})
  UNION ALL SELECT {columns} FROM mixed p WHERE EXISTS (SELECT 1 {other.format("parts")} o.kind IN ('access', 'weak_access', 'endpoint') {near})
),
told AS (SELECT r, kind, rank, kind || ':' || start || ':' || stop AS s, start, stop FROM spans),
per AS (
  SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(s, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base, string_agg(s, ',' ORDER BY start, rank, stop) AS spans
  FROM told GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (r)"""


def personal_data(window: int, support: int, generalise: float) -> str:
    """Personal data, and terms that give a share of the information of an entity in the same text."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    doubled = f"[CAST(substr({digits}, length({digits}) - p, 1) AS BIGINT) * (1 + p % 2) FOR p IN range(length({digits}))]"
    base = [
        _found("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        _found("ip", 1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", keep="len([x FOR x IN string_split(m, '.') IF length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS BIGINT), 0) > 255]) = 0"),
        _found("card", 2, r"[0-9]([\x20-]?[0-9])+", keep=f"CASE WHEN length({digits}) BETWEEN 16 AND 19 THEN list_sum([x - 9 * CAST(x > 9 AS BIGINT) FOR x IN {doubled}]) % 10 = 0 ELSE false END"),
        _found("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", keep=f"length({digits}) BETWEEN 8 AND 15"),
    ]
    term = r"[\p{L}\p{Nl}\p{No}]{3,}"
    around = f"substring(text, greatest(0, s.start - {window}) + 1, least(length(text), s.stop + {window}) - greatest(0, s.start - {window}))"
    return f"""
WITH d AS MATERIALIZED ({_TEXTS}),
base AS MATERIALIZED ({" UNION ALL ".join(base)}),
once AS MATERIALIZED (SELECT text, min(r) AS r FROM d GROUP BY text),
marked AS MATERIALIZED (SELECT * FROM once WHERE r IN (SELECT r FROM base)),
placed AS MATERIALIZED (
  SELECT r, lower(m) AS term, start, stop FROM ({_found("term", 4, term, table="marked")}) w
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND ((b.start <= w.start AND w.start < b.stop) OR (b.start < w.stop AND w.stop <= b.stop)))
),
here AS MATERIALIZED (SELECT b.r, kind || ':' || m AS entity, start, stop FROM base b JOIN once USING (r)),
entities AS (SELECT entity, count(DISTINCT r) AS n_entity FROM here GROUP BY entity HAVING count(DISTINCT r) >= {support}),
holding AS MATERIALIZED (SELECT DISTINCT r, entity, n_entity FROM here JOIN entities USING (entity)),
own AS MATERIALIZED (SELECT r, term, string_agg({around}, chr(1) ORDER BY s.start) AS context FROM placed s JOIN once USING (r) WHERE r IN (SELECT r FROM holding) GROUP BY r, term),
recurring AS MATERIALIZED (SELECT entity, term, n_entity, count(*) AS n_pair FROM own JOIN holding USING (r) GROUP BY ALL HAVING count(*) >= {support}),
seen AS (
  SELECT DISTINCT r, term FROM placed
  UNION ALL SELECT r, unnest(list_distinct([lower(x) FOR x IN regexp_extract_all(text, '{term}')])) AS term FROM once WHERE r NOT IN (SELECT r FROM base)
),
counts AS (SELECT term, count(*) AS n_term FROM seen WHERE term IN (SELECT term FROM recurring) GROUP BY term),
likely AS MATERIALIZED (
  SELECT entity, term FROM recurring JOIN counts USING (term)
  WHERE 1 + ln(n_pair / n_term) / ln(greatest((SELECT count(*) FROM once) / n_entity, 2)) >= {generalise}
),
near AS (
  SELECT s.r, s.entity, w.term, {around} AS context FROM here s JOIN once o ON s.r = o.r JOIN placed w ON w.r = s.r AND w.start >= s.start - {window} AND w.stop <= s.stop + {window}
  WHERE s.entity IN (SELECT entity FROM entities)
),
pairs AS MATERIALIZED (SELECT r, entity, term, context FROM own JOIN holding USING (r) JOIN likely USING (entity, term)),
proved AS (
  SELECT entity, term FROM pairs p LEFT JOIN near n USING (r, entity, term) GROUP BY entity, term HAVING count(DISTINCT coalesce(n.context, p.context)) >= {support}
),
told AS (SELECT DISTINCT r, start, stop FROM placed JOIN pairs USING (r, term) JOIN proved USING (entity, term)),
terms AS (SELECT text, string_agg('term:' || start || ':' || stop, ',' ORDER BY start) AS terms FROM told JOIN once USING (r) GROUP BY text),
per AS (
  SELECT r, count(*) FILTER (WHERE rank = 0) AS n_email, count(*) FILTER (WHERE rank = 1) AS n_ip, count(*) FILTER (WHERE rank = 2) AS n_card, count(*) FILTER (WHERE rank = 3) AS n_phone,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rank, start) AS base
  FROM base GROUP BY r
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256,
  concat_ws(',', base, terms) AS spans
FROM d LEFT JOIN per USING (r) LEFT JOIN terms USING (text)"""


def filter_interactions() -> str:
    """Counts of each part, order of five filters and step, from masks of failed filters."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT *, {_words('text')} AS words FROM d),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, CAST(len(words) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INT)
    + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS INT) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false) AS INT) AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN marks ON w.doc_id = marks.doc_id
),
cells AS MATERIALIZED (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
letters(letter, own) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders(filter_order, used) AS (SELECT '', 0 UNION ALL SELECT filter_order || letter, used + own FROM orders JOIN letters ON used & own = 0),
steps AS MATERIALIZED (
  SELECT filter_order, step, own, (SELECT coalesce(sum(b.own), 0) FROM letters b WHERE instr(filter_order, b.letter) < step) AS before
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders WHERE used = 31) o JOIN letters ON letter = filter_order[step]
),
told AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
    coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & own = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & own <> 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0) AS toxic_lost
  FROM cells CROSS JOIN (SELECT filter_order, step, own, CAST(before AS INTEGER) AS before FROM steps) s GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM told"""


def periodic_runs() -> str:
    """Runs of words, after the tails of a tenth of the texts are made periodic; the places of a grid say which periods to compare at all."""
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
    lambda c, x : list_reduce(list_prepend(xor(c, x), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda v, z : CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)))"""
    return f"""
WITH d AS MATERIALIZED (SELECT *, {_words('text')} AS words, {crc} AS h FROM ({_TEXTS})),
a AS (SELECT r, doc_id, words, len(words) AS n, h // 10 AS g, h % 10 = 0 AND len(words) > 0 AS changed FROM d),
b AS MATERIALIZED (SELECT *, CASE WHEN changed THEN g % n ELSE n END AS a FROM a),
c AS MATERIALIZED (SELECT *, CASE WHEN changed THEN 1 + (n - a) // (3 + g % 8) ELSE 1 END AS p FROM b),
taken AS (SELECT r, i, CASE WHEN i >= a THEN a + (i - a) % p ELSE i END AS j FROM (SELECT r, a, p, unnest(range(n)) AS i FROM c)),
each AS (SELECT r, i, words[i + 1] AS word FROM (SELECT r, words, unnest(range(n)) AS i FROM c)),
w AS MATERIALIZED (SELECT taken.r, taken.i, word FROM taken JOIN each ON taken.r = each.r AND taken.j = each.i),
periods AS (SELECT r, n, unnest(range(1, n // 4 + 1)) AS p FROM c),
probes AS (SELECT r, p, unnest(range((n - 1) // p)) AS k FROM periods),
hits AS (SELECT t.r, t.p, k FROM probes t JOIN w x ON x.r = t.r AND x.i = t.k * t.p JOIN w y ON y.r = t.r AND y.i = (t.k + 1) * t.p WHERE x.word = y.word),
rows_of_hits AS (SELECT r, p, k - row_number() OVER (PARTITION BY r, p ORDER BY k) AS same FROM hits),
likely AS MATERIALIZED (SELECT DISTINCT r, p FROM (SELECT r, p FROM rows_of_hits GROUP BY r, p, same HAVING count(*) >= 3)),
equal AS (SELECT l.r, l.p, x.i FROM likely l JOIN w x ON x.r = l.r JOIN w y ON y.r = l.r AND y.i = x.i + l.p WHERE x.word = y.word),
stretches AS (SELECT r, p, min(i) AS start, count(*) + p AS length FROM (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS same FROM equal) GROUP BY r, p, same),
runs AS MATERIALIZED (SELECT r, start, length, min(p) AS period FROM stretches WHERE length >= greatest(6, 4 * p) GROUP BY r, start, length),
told AS (
  SELECT r, count(*) AS n_runs, arg_min({{'start': start, 'length': length, 'period': period}}, {{'a': -length, 'b': start, 'c': period}}) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS all_runs FROM runs GROUP BY r
),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli,
  sha256(coalesce(all_runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM c LEFT JOIN told USING (r) LEFT JOIN kept USING (r)"""


ORACLE_SQL = {
    "op2_personal_data": personal_data(60, 3, 0.85),
    "op4_quality_rules": quality(QUALITY_RULES),
    "op5_substring_dedup": substring_dedup(50),
    "op7_ngram_jaccard_join": jaccard_components(4, 85),
    "op10_secret_scan": secret_scan(200),
    "op11_filter_interactions": filter_interactions(),
    "op12_periodic_runs": periodic_runs(),
}

"""DuckDB SQL for the queries of this subpackage that SQL can express, written apart from their methods."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(string_split_regex({{t}}, '{_SPACE}'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def shingles(table: str, key: str, width: int = 5) -> str:
    """(key, g) rows of distinct shingles, or the words of shorter texts."""
    words = f"SELECT {key} AS k, {_WORDS.format(t=_LOWER)} AS w FROM {table}"
    return f"SELECT DISTINCT k, g FROM (SELECT k, unnest(CASE WHEN len(w) >= {width} THEN list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM ({words}))"


OP1 = f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
 w AS (SELECT doc_id, host, text, {_WORDS.format(t='text')} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
 g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
 twice AS (SELECT g.doc_id, g.i FROM g JOIN (SELECT doc_id, s FROM g GROUP BY doc_id, s HAVING count(*) > 1) t ON g.doc_id = t.doc_id AND g.s = t.s),
 rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) r(k) GROUP BY doc_id),
 m AS (SELECT w.doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
 b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
 h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS k FROM b GROUP BY host),
 p AS (SELECT avg(k / n) AS mean, CASE WHEN coalesce(var_samp(k / n), 0) > 1e-12 THEN least(greatest(avg(k / n) * (1 - avg(k / n)) / var_samp(k / n) - 1, 1), 1000) ELSE 1000 END AS weight FROM h)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (k + mean * weight) / (n + weight) <= 0.5 AS kept FROM b JOIN h ON h.host = b.host, p"""

# Reachability over dependencies: a call is stuck if it reaches a call that reaches itself. A place is the largest turn among the calls reached, and
# the step behind it the longest way to a call of that turn.
OP2 = """WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations WHERE role = 'user'),
 r AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
 d AS (SELECT conv_id, turn, CASE WHEN n % 3 = 0 THEN turn + 2 ELSE turn - 2 END AS needs FROM c UNION SELECT conv_id, turn, turn + 4 FROM c WHERE n % 4 = 0),
 e AS MATERIALIZED (SELECT d.* FROM d JOIN c ON c.conv_id = d.conv_id AND c.turn = d.needs),
 w AS (SELECT conv_id, turn, needs, 1 AS steps FROM e UNION SELECT w.conv_id, w.turn, e.needs, steps + 1 FROM w JOIN e ON e.conv_id = w.conv_id AND e.turn = w.needs WHERE steps <= (SELECT max(turn) + 1 FROM conversations)),
 loops AS (SELECT DISTINCT conv_id, turn FROM w WHERE needs = turn),
 stuck AS (SELECT conv_id, turn FROM loops UNION SELECT w.conv_id, w.turn FROM w JOIN loops l ON l.conv_id = w.conv_id AND l.turn = w.needs),
 p AS (SELECT c.conv_id, c.turn, greatest(c.turn, coalesce(max(w.needs), c.turn)) AS place FROM c LEFT JOIN w ON w.conv_id = c.conv_id AND w.turn = c.turn GROUP BY 1, 2),
 q AS (SELECT p.conv_id, p.turn, any_value(place) AS place, coalesce(max(w.steps) FILTER (w.needs = place AND place <> p.turn), 0) AS step, any_value(s.turn) IS NOT NULL AS cyclic
  FROM p LEFT JOIN w ON w.conv_id = p.conv_id AND w.turn = p.turn LEFT JOIN stuck s ON s.conv_id = p.conv_id AND s.turn = p.turn GROUP BY 1, 2),
 f AS (SELECT *, CASE WHEN n % 11 <> 0 THEN '{' || CASE WHEN n % 7 <> 0 THEN '"prompt":' || to_json(text)::VARCHAR || ',' ELSE '' END || '"turn":' || CASE WHEN n % 5 = 0 THEN '"' || turn || '"' ELSE turn::VARCHAR END || '}' END AS form FROM c)
 SELECT f.conv_id, f.turn, row_number() OVER (PARTITION BY f.conv_id ORDER BY cyclic, CASE WHEN NOT cyclic THEN place END, CASE WHEN NOT cyclic THEN step END, f.turn, 't' || f.turn) AS topo_rank, cyclic, r.turn AS result_turn, sha256(r.text) AS content_sha256,
 sha256(form) AS canonical_sha256, CASE WHEN n % 11 = 0 THEN 1 ELSE (n % 7 = 0)::INT + (n % 5 = 0)::INT END::BIGINT AS n_errors
 FROM f JOIN q ON q.conv_id = f.conv_id AND q.turn = f.turn LEFT JOIN r ON r.conv_id = f.conv_id AND r.turn = f.turn + 1"""

OP3 = f"""WITH d AS ({shingles('documents', 'doc_id')}), b AS ({shingles('benchmark', 'item_id')}), n AS (SELECT k, count(*) AS n FROM b GROUP BY k)
 SELECT d.k AS doc_id, b.k AS item_id, count(*) AS n_shared, any_value(n.n) AS n_item FROM d JOIN b ON d.g = b.g JOIN n ON n.k = b.k GROUP BY d.k, b.k HAVING 100 * count(*) >= 75 * any_value(n.n)"""

OP4 = f"""WITH RECURSIVE s AS MATERIALIZED ({shingles('documents', 'doc_id')}), n AS MATERIALIZED (SELECT k, count(*) AS n FROM s GROUP BY k),
 p AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM s a JOIN s b ON a.g = b.g AND a.k < b.k JOIN n x ON x.k = a.k JOIN n y ON y.k = b.k GROUP BY a.k, b.k HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))),
 e AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p),
 r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
 SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.b AS component_id, d.doc_id = c.b AS kept FROM documents d JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) c ON c.a = d.doc_id LEFT JOIN n ON n.k = d.doc_id"""
OP12 = f"""WITH RECURSIVE s AS MATERIALIZED ({shingles('documents', 'doc_id', 4)}), n AS MATERIALIZED (SELECT k, count(*) AS n FROM s GROUP BY k),
 p AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM s a JOIN s b ON a.g = b.g AND a.k < b.k JOIN n x ON x.k = a.k JOIN n y ON y.k = b.k GROUP BY a.k, b.k HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
 e AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p),
 r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
 SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.b AS component_id FROM documents d JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) c ON c.a = d.doc_id LEFT JOIN n ON n.k = d.doc_id"""


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _levels(name: str, count: int) -> str:
    """Of nodes {name}0 (key, pos, h, total): the nodes of the levels above them, and in {name}_0, {name}_1, ... what stands before and after each in its run."""
    out = ""
    for i in range(count):
        out += f", {name}_{i} AS (SELECT key, pos, total > 1 AS up, coalesce(string_agg(h, '') OVER (PARTITION BY key, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS bef, coalesce(string_agg(h, '') OVER (PARTITION BY key, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS aft FROM {name}{i})"
        out += f", {name}{i + 1} AS MATERIALIZED (SELECT key, pos // 16 AS pos, CASE WHEN any_value(total) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h, (any_value(total) + 15) // 16 AS total FROM {name}{i} GROUP BY key, pos // 16)"
    return out


def _folds(name: str, count: int, start: str, place: str, key: str) -> str:
    """From (key, pos, h, proof) of {start} on, a table a level."""
    out, before = "", start
    for i in range(count):
        out += f", {start}{name}{i} AS (SELECT x.* EXCLUDE (h, proof), CASE WHEN m.up THEN sha256(m.bef || x.h || m.aft) ELSE x.h END AS h, x.proof || m.bef || m.aft AS proof FROM {before} x JOIN {name}_{i} m ON m.key = {key} AND m.pos = x.{place} // {16 ** i})"
        before = f"{start}{name}{i}"
    return out


#: CRC-32 of the digits of doc_id, bit by bit: -1 stands for a shift.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384::BIGINT) END), 4294967295::BIGINT)"
_LOW_TEXT = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OWN, _ALL = 6, 4

OP11 = f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce('s' || source, '') AS key, {_leaf('text')} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_leaf(_LOW_TEXT)} END AS tampered FROM documents),
 a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS total FROM d),
 n0 AS (SELECT key, pos, leaf AS h, total FROM a){_levels('n', _OWN)},
 s AS (SELECT key AS source, h, row_number() OVER (ORDER BY key) - 1 AS place, count(*) OVER () AS total FROM n{_OWN}),
 s0 AS (SELECT '' AS key, place AS pos, h, total FROM s){_levels('s', _ALL)},
 f AS (SELECT a.doc_id, a.leaf, a.key, a.pos, s.place, s.h AS subroot, coalesce(a.tampered, a.leaf) AS h, '' AS proof FROM a JOIN s ON s.source = a.key){_folds('n', _OWN, 'f', 'pos', 'x.key')},
 g AS (SELECT * FROM fn{_OWN - 1}){_folds('s', _ALL, 'g', 'place', "''")}
 SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, x.h AS folded_root, x.h = r.h AS verified FROM gs{_ALL - 1} x, s{_ALL} r"""


_GRAMS = " UNION ALL ".join(f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS p FROM w" for k in (1, 2, 3))
_PIECES = f"SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents"

OP13 = f"""WITH w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM ({_PIECES})),
 f AS MATERIALIZED (SELECT lang, k, p, count(*) AS f FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= 10),
 n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
 c AS (SELECT lang, k, p, f AS a, string_split(p, ' ') AS v FROM f WHERE k > 1),
 x AS (SELECT lang, k, p, a, i, array_to_string(v[1:i], ' ') AS lp, array_to_string(v[i + 1:], ' ') AS rp FROM c, range(1, 3) t(i) WHERE i < k),
 s AS (SELECT x.*, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score FROM x JOIN f l ON l.lang = x.lang AND l.p = lp JOIN f r ON r.lang = x.lang AND r.p = rp),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, i) = 1),
 o AS (SELECT lang, array_to_string(v[1:2], ' ') AS p, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(v[2:3], ' '), a FROM c WHERE k = 3),
 m AS (SELECT lang, p, max(a) AS by FROM o GROUP BY lang, p),
 h AS (SELECT b.* FROM b LEFT JOIN m ON m.lang = b.lang AND m.p = b.p WHERE m.by IS NULL OR 100 * m.by < 50 * b.a)
 SELECT h.lang, row_number() OVER (PARTITION BY h.lang ORDER BY score DESC, a DESC, h.p) AS rank, h.p AS phrase, a, l, r, n.n, score FROM h JOIN n ON n.lang = h.lang QUALIFY rank <= 2000"""


def op8(limit: int) -> str:
    return f"""WITH r AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
 s AS (SELECT doc_id, n_bytes, h, d, sum(n_bytes) OVER p AS t, min(h) OVER p AS lo, max(h) OVER p AS hi FROM r, range(61) x(d) WINDOW p AS (PARTITION BY d, h >> (60 - d)::INT)),
 f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS k FROM s WHERE t <= {limit} OR lo = hi)
 SELECT doc_id, n_bytes, d::INT AS depth, CASE WHEN d = 0 THEN '' ELSE lpad(bin(h >> (60 - d)::INT), d::INT, '0') END AS shard, '0' AS page FROM f WHERE k = 1"""

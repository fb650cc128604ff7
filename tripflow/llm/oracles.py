"""SQL for DuckDB that gives the rows of those corpus queries SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op1_exact_topk"] = """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM scaled q JOIN scaled c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER best)::INTEGER AS rank, vec_id, score FROM scored
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES["op3_jaccard_join"] = rf"""
WITH RECURSIVE spoken AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])) END) AS s FROM spoken),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(smallest, doc_id)) AS component_id
FROM sets LEFT JOIN (SELECT a, min(b) AS smallest FROM reached GROUP BY a) ON a = doc_id"""

# The control strings of the chat template, less their first characters.
_CONTROL = r"[<\[]~*(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"


def _escaped_size(column: str) -> str:
    return f"(length({column}) + len(regexp_extract_all({column}, '{_CONTROL}')))"


ORACLES["op7_chat_format"] = rf"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
placed AS (
  SELECT *, row_number() OVER told AS place, count(*) OVER (PARTITION BY conv_id) AS turns,
    sum(24 + {_escaped_size("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")} + {_escaped_size("text")}) OVER told AS upto
  FROM given WINDOW told AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY place)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR place = turns))::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id"""

ORACLES["op10_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS position FROM documents),
long AS (SELECT * FROM lines WHERE length(trim(line, concat(' ', chr(9), chr(11), chr(12), chr(13)))) >= 10),
firsts AS (SELECT line, min((doc_id, position)) AS first FROM long GROUP BY line),
pairs AS (
  SELECT a.line, b.line AS before FROM firsts a JOIN firsts b ON a.line[:4] = b.line[:4] AND a.first > b.first AND abs(length(a.line) - length(b.line)) <= 1
  UNION SELECT a.line, b.line FROM firsts a JOIN firsts b ON a.line[-4:] = b.line[-4:] AND a.first > b.first AND abs(length(a.line) - length(b.line)) <= 1),
near AS (SELECT DISTINCT line FROM pairs WHERE levenshtein(line, before) <= 1),
gone AS (
  SELECT l.doc_id, l.position FROM long l JOIN firsts f USING (line) LEFT JOIN near n USING (line)
  WHERE n.line IS NOT NULL OR (l.doc_id, l.position) > f.first),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.position) AS text, count(*) AS n
  FROM lines l ANTI JOIN gone g ON g.doc_id = l.doc_id AND g.position = l.position GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines,
  (coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(k.n, 0))::BIGINT AS n_dropped, sha256(coalesce(k.text, '')) AS text_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id"""


def _crc32(text: str) -> str:
    """The checksum of an ASCII text: a byte at a time, bit by bit."""
    bit = "list_reduce([xor(acc, byte)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, n: xor(x >> 1, 3988292384 * (x & 1)))"
    given = f"[4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce({given}, lambda acc, byte: {bit}), 4294967295)"


def _fields(n_chars: str) -> str:
    """The digest of a row; a part of || that is NULL makes a field a dash."""
    parts = [f"({p})::VARCHAR" for p in ("doc_id", "source", "lang", n_chars, "text")]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in parts) + "))"


ORACLES["op13_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_fields("n_chars")} AS leaf,
    CASE WHEN {_crc32("doc_id::VARCHAR")} % 7 = 0 THEN {_fields("n_chars + 1")} END AS changed FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS branch FROM leaves),
tree AS (
  SELECT branch, 0 AS level, place, leaf AS digest, n FROM placed
  UNION ALL SELECT branch, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), any_value((n + 1) // 2)
  FROM tree WHERE n > 1 GROUP BY branch, level, place // 2),
subroots AS (SELECT branch AS place, digest, level AS height, count(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (
  SELECT 0 AS level, place, digest, n FROM subroots
  UNION ALL SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), any_value((n + 1) // 2)
  FROM crown WHERE n > 1 GROUP BY level, place // 2),
steps AS (
  SELECT p.branch, p.place, t.level, s.digest AS sibling, s.place < t.place AS is_left
  FROM placed p JOIN tree t ON t.branch = p.branch AND t.place = p.place >> t.level AND t.n > 1
  LEFT JOIN tree s ON s.branch = t.branch AND s.level = t.level AND s.place = xor(t.place, 1)
  UNION ALL SELECT p.branch, p.place, r.height + t.level, s.digest, s.place < t.place
  FROM placed p JOIN subroots r ON r.place = p.branch JOIN crown t ON t.place = p.branch >> t.level AND t.n > 1
  LEFT JOIN crown s ON s.level = t.level AND s.place = xor(t.place, 1)),
folds AS (
  SELECT branch, place, 0 AS level, coalesce(changed, leaf) AS digest FROM placed
  UNION ALL SELECT branch, place, level + 1, sha256(CASE WHEN is_left THEN sibling || digest ELSE digest || coalesce(sibling, '') END)
  FROM folds JOIN steps USING (branch, place, level)),
proofs AS (SELECT branch, place, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256 FROM steps GROUP BY branch, place)
SELECT p.doc_id, p.leaf, r.digest AS subroot, c.digest AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256,
  f.digest AS folded_root, f.digest = c.digest AS verified
FROM placed p JOIN subroots r ON r.place = p.branch JOIN crown c ON c.n = 1
LEFT JOIN proofs q ON q.branch = p.branch AND q.place = p.place
JOIN (SELECT branch, place, arg_max(digest, level) AS digest FROM folds GROUP BY branch, place) f ON f.branch = p.branch AND f.place = p.place"""

# A run of 12 words or more repeats at least 6 words in a row at the distance of
# its period, so pairs of equal six-word sequences lead to all runs.
ORACLES["op12_periodic_runs"] = rf"""
WITH numbered AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    {_crc32("doc_id::VARCHAR")} AS h FROM documents),
planned AS (
  SELECT *, (h // 10) % greatest(len(w), 1) AS a, len(w) AS n,
    1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) AS p FROM numbered),
spoken AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 THEN
    list_transform(range(n), lambda i: w[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END) + 1]) ELSE w END AS w FROM planned),
grams AS (
  SELECT r, unnest(range(n - 5)) AS i, unnest(list_transform(range(n - 5), lambda i: hash(w[i + 1:i + 6]))) AS gram FROM spoken WHERE n >= 12),
pairs AS (SELECT a.r, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.r = b.r AND a.gram = b.gram AND a.i < b.i),
islands AS (
  SELECT r, q, min(i) AS s, count(*) + 5 + q AS len
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs)
  GROUP BY r, q, island HAVING count(*) + 5 >= greatest(q, 12 - q)),
runs AS (
  SELECT * FROM islands x WHERE NOT EXISTS (
    SELECT 1 FROM islands y WHERE y.r = x.r AND y.q < x.q AND x.q % y.q = 0 AND y.s <= x.s AND y.s + y.len >= x.s + x.len)),
told AS (
  SELECT r, count(*) AS n_runs, arg_max((s, len, q), (len, -s, -q)) AS best,
    string_agg(concat(s, ',', len, ',', q, chr(10)), '' ORDER BY s, q) AS listed FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM runs),
words AS (SELECT r, unnest(range(n)) AS i, unnest(w) AS word FROM spoken),
kept AS (SELECT w.r, string_agg(word, ' ' ORDER BY w.i) AS collapsed FROM words w ANTI JOIN gone g ON g.r = w.r AND g.i = w.i GROUP BY w.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period,
  1000 * best[2] // best[3] AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM spoken LEFT JOIN told USING (r) LEFT JOIN kept USING (r)"""


def _matches(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    """(r, kind, s, e, v) of a kind's passing matches: gaps and matches take turns along the text."""
    return f"""
  SELECT r, {place} AS kind, '{kind}' AS name, s + gap_upto AS s, s + gap_upto + size AS e, v FROM (
    SELECT *, coalesce(sum(size) OVER before, 0) AS s, sum(gap) OVER upto AS gap_upto FROM (
      SELECT r, unnest(range(len(hits))) AS i, unnest(list_transform(hits, lambda x: length(x))) AS size,
        unnest(list_transform(gaps[1:len(hits)], lambda x: length(x))) AS gap, unnest(vals) AS v
      FROM (SELECT r, regexp_extract_all(text, $re${pattern}$re$) AS hits, regexp_extract_all(text, $re${pattern}$re$, {group}) AS vals,
          string_split_regex(text, $re${pattern}$re$) AS gaps FROM texts WHERE regexp_matches(text, $re${pattern}$re$)))
    WINDOW before AS (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), upto AS (PARTITION BY r ORDER BY i))
  WHERE length(v) >= {least}"""


# The forms of the contract, and those of the long tokens.
_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

ORACLES["op5_secret_scan"] = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo FROM documents),
base AS ({_matches("assign", 0, _ASSIGN, 2, 6)} UNION ALL {_matches("access", 1, "AKIA[A-Z0-9]{16,}", 0, 20)}
  UNION ALL {_matches("hex", 2, "[0-9a-f]{24,}", 0, 24)}),
long AS ({_matches("owned", 3, "[A-Za-z0-9+/_=-]{20,}", 0, 20)}),
looks AS (
  SELECT *, regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]')
    AND NOT regexp_matches(v, '(?i)example|sample|dummy|changeme|your[_-]|placeholder|01234|12345|abcdef')
    AND len(list_filter(range(1, length(v) - 2), lambda i: lower(v[i]) = lower(v[i + 1]) AND lower(v[i]) = lower(v[i + 2]) AND lower(v[i]) = lower(v[i + 3]))) = 0 AS likely
  FROM (FROM base UNION ALL FROM long)),
found AS (
  SELECT * FROM looks c WHERE kind < 3 OR likely AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = c.r AND b.s < c.e AND c.s < b.e)),
owned AS (
  SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repos FROM found JOIN texts USING (r) GROUP BY v),
judged AS (SELECT f.*, likely AND owners <= 2 AND repos <= 3 AS live FROM found f JOIN owned USING (v)),
told AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    count(*) FILTER (kind = 3) AS n_owned, count(*) FILTER (live) AS n_live,
    string_agg(concat(name, ':', s, ':', e), ',' ORDER BY s, kind) FILTER (kind < 3) AS base_spans,
    string_agg(concat(name, ':', s, ':', e), ',' ORDER BY s, kind) AS spans
  FROM judged WHERE kind < 3 OR live GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  coalesce(n_owned, 0) AS n_owned, coalesce(n_live, 0) AS n_live, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN told USING (r)"""

# Exponents are multiples of 1/4096; the least that repeats no source more than twice.
ORACLES["op9_temperature_mixing"] = """
WITH units AS (
  SELECT doc_id AS key, coalesce(source, '') AS source, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS name,
    (strlen(coalesce(text, '')) + 3) // 4 AS tokens, count(*) AS n_rows FROM documents GROUP BY ALL),
sizes AS (SELECT source, count(*) AS units, sum(tokens * n_rows)::BIGINT AS held FROM units GROUP BY source),
total AS (SELECT sum(held)::BIGINT AS total FROM sizes),
tried AS (
  SELECT step, max(pow(held / total::DOUBLE, step / 4096.0::DOUBLE - 1)) / sum(pow(held / total::DOUBLE, step / 4096.0::DOUBLE)) AS most
  FROM range(4097) t(step), sizes, total WHERE held > 0 GROUP BY step),
chosen AS (SELECT coalesce(min(step) FILTER (most <= 2), 4096) / 4096.0::DOUBLE AS e FROM tried),
weights AS (
  SELECT *, round(pow(held / total::DOUBLE, e) / sum(pow(held / total::DOUBLE, e)) OVER () * total)::BIGINT AS budget
  FROM sizes, total, chosen WHERE held > 0),
placed AS (
  SELECT u.*, w.budget // held AS epochs, w.budget % held AS rest, unnest(range(w.budget // held + 1))::INTEGER AS epoch,
    ('0x' || substr(md5(concat_ws(':', 17, source, name)), 1, 8))::BIGINT % ceil(sqrt(units))::BIGINT AS block
  FROM units u JOIN weights w USING (source)),
inside AS (
  SELECT *, coalesce(sum(tokens * n_rows) OVER (PARTITION BY source, epoch, block
    ORDER BY md5(concat_ws(':', 17, epoch, name)), tokens, key NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS own
  FROM placed WHERE epoch < epochs OR rest > 0),
blocks AS (
  SELECT source, epoch, block, coalesce(sum(sum(tokens * n_rows)) OVER (PARTITION BY source, epoch
    ORDER BY md5(concat_ws(':', 17, epoch, source, block)), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM inside GROUP BY source, epoch, block)
SELECT key AS doc_id, source, epoch, unnest(range(1, n_rows + 1)) AS copy, (before + own)::BIGINT AS token_start, tokens AS n_tokens
FROM inside JOIN blocks USING (source, epoch, block) WHERE epoch < epochs OR before + own + tokens * n_rows <= rest"""

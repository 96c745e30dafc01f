"""DuckDB SQL for the operators' queries that SQL can express."""

from .decontaminate import WINDOW
from .filter_audit import FILTERS
from .mixing import WEIGHTS
from .quality import ALPHA, DELTA, GRID
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

OP1 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

_CHARS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {s}) & 31 AS INTEGER) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0)
)

OP2 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT html, max(page_id) AS winner FROM p GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, {_CHARS} AS payload_digest,
  CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM p JOIN g ON p.html = g.html
"""

_W = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " ELSE 1.0 END::DOUBLE"


def _level(path: str, parent: str, source: str, budget: str) -> str:
    """One level of the tree: rows (path, alloc)."""
    own = path.split(", ")[-1]
    over = f"PARTITION BY {parent}" if parent else ""
    join = f"JOIN {source} USING ({parent})" if parent else ""
    return f"""
SELECT {path}, CASE WHEN is_full THEN capacity ELSE least(capacity,
    CAST(floor((w + weight - open.w) * ((b - open.c) / (total_w - open.w)) + 1e-6) AS BIGINT)
    - CAST(floor((w - open.w) * ((b - open.c) / (total_w - open.w)) + 1e-6) AS BIGINT)) END AS alloc
FROM (SELECT *, min(CASE WHEN NOT is_full THEN {{'c': c, 'w': w}} END) OVER ({over}) AS open
  FROM (SELECT *, capacity / weight <= (b - c) / (total_w - w) AS is_full
    FROM (SELECT *, least({budget}, sum(capacity) OVER ({over})) AS b,
        coalesce(sum(capacity) OVER ({over} ORDER BY capacity / weight, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
        coalesce(sum(weight) OVER ({over} ORDER BY capacity / weight, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS w,
        sum(weight) OVER ({over}) AS total_w
      FROM (SELECT n.*, {_W.format("n." + own)} AS weight{", alloc AS given" if parent else ""}
        FROM (SELECT {path}, sum(tokens) * 2 AS capacity FROM leaves GROUP BY {path}) n {join}))))
"""


OP8 = f"""
WITH base AS (
  SELECT doc_id, language, source, n_tokens, 'd' || coalesce(CAST(TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT) // 5 AS VARCHAR), '') AS domain
  FROM (SELECT doc_id, coalesce(lang, '') AS language, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents)),
leaves AS (SELECT domain, language, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM base GROUP BY ALL),
l1 AS ({_level("domain", "", "", "(SELECT CAST(floor(sum(tokens) * 0.9::DOUBLE) AS BIGINT) FROM leaves)")}),
l2 AS ({_level("domain, language", "domain", "l1", "given")}),
l3 AS ({_level("domain, language, source", "domain, language", "l2", "given")}),
stream AS (
  SELECT base.*, epoch, alloc, md5('11:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord
  FROM base JOIN leaves USING (domain, language, source) JOIN l3 USING (domain, language, source)
  JOIN range(2) e(epoch) ON epoch < greatest(1, ceil(alloc / greatest(tokens, 1)))),
placed AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, language, source ORDER BY epoch, ord, doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM stream)
SELECT doc_id, domain, language, source, CAST(epoch AS INTEGER) AS epoch, CAST(start AS BIGINT) AS start, n_tokens,
  CAST(least(n_tokens, alloc - start) AS BIGINT) AS take_tokens, CAST(alloc AS BIGINT) AS leaf_alloc
FROM placed WHERE start < alloc
"""

_VALUES = {
    "symbol_rate": "n_symbols / greatest(n_words, 1)::DOUBLE",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)::DOUBLE",
    "repeat_word_rate": "n_repeat_words / greatest(n_words, 1)::DOUBLE",
    "upper_rate": "n_upper / greatest(word_chars, 1)::DOUBLE",
    "word_length": "word_chars / greatest(n_words, 1)::DOUBLE",
}
_RULES = list(enumerate(GRID.items()))
_LEVELS = ", ".join("(" + " + ".join(f"({r} > {c}::DOUBLE)::INT" for c in cs) + f") AS l{i}" for i, (r, cs) in _RULES)
_ITEMS = ", ".join(f"({i}, {j}, {c}::DOUBLE)" for i, (_, cs) in _RULES for j, c in enumerate(cs))
_A = ", ".join(f"a{i}" for i, _ in _RULES)
_OF = lambda x: "CASE i.r " + " ".join(f"WHEN {i} THEN {x}{i}" for i, _ in _RULES) + " END"
_SIZE = "CASE i.r " + " ".join(f"WHEN {i} THEN {len(cs)}" for i, (_, cs) in _RULES) + " END"
_N = sum(len(cs) for cs in GRID.values())
_LEAST = f"ceil(ln({DELTA}::DOUBLE / {{}}) / ln(1 - {ALPHA}::DOUBLE))"

#: The ladder grows by the cut-off that catches most bad documents not caught yet (``walk``); its steps are tested in order.
OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, stratum, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
f AS (SELECT doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  len(regexp_extract_all(t, '[A-Z!]')) AS n_upper FROM w LEFT JOIN cov USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"{e} AS {r}" for r, e in _VALUES.items())} FROM f),
rated AS (SELECT doc_id, stratum, q, {_LEVELS} FROM v JOIN (SELECT doc_id, min(quality) AS q FROM labels GROUP BY doc_id HAVING min(quality) IN (0, 1)) USING (doc_id)
  WHERE q = 1 OR NOT base_failed),
items(r, j, c) AS (VALUES {_ITEMS}),
caught AS (SELECT l0, l1, l2, l3, l4, count(*) AS n FROM rated WHERE q = 0 GROUP BY ALL),
walk(k, {_A}) AS (SELECT 0, {", ".join(str(len(cs)) for _, (_, cs) in _RULES)}
  UNION ALL SELECT k + 1, {", ".join(f"CASE WHEN best.r = {i} THEN best.j ELSE a{i} END" for i, _ in _RULES)}
  FROM (SELECT k, {_A}, arg_max({{'r': r, 'j': j}}, (gain, j - size, -r)) AS best
    FROM (SELECT k, {_A}, i.r, i.j, {_SIZE} AS size, sum(b.n) AS gain FROM walk JOIN caught b ON {" AND ".join(f"b.l{i} <= a{i}" for i, _ in _RULES)}
      JOIN items i ON {_OF("b.l")} > i.j GROUP BY k, {_A}, i.r, i.j) GROUP BY k, {_A})),
ladder AS (SELECT r, j, c, row_number() OVER (ORDER BY k NULLS LAST, j DESC, r) - 1 AS pos
  FROM (SELECT i.r, i.j, i.c, min(k) AS k FROM items i LEFT JOIN walk ON {_OF("a")} <= i.j GROUP BY i.r, i.j, i.c)),
steps AS (SELECT g.doc_id, g.stratum, min(pos) AS step FROM (SELECT * FROM rated WHERE q = 1) g LEFT JOIN ladder i ON {_OF("g.l")} > i.j GROUP BY g.doc_id, g.stratum),
sizes AS (SELECT stratum, count(*) AS n FROM steps GROUP BY stratum),
m AS (SELECT count(*) FILTER (WHERE n >= {_LEAST.format(2)}) + 1 AS tests FROM sizes),
tested AS (SELECT stratum, n FROM sizes, m WHERE n >= {_LEAST.format("tests")} UNION ALL SELECT NULL, sum(n) FROM sizes HAVING sum(n) > 0),
ks AS (SELECT t.stratum, t.n, l.pos, count(s.doc_id) AS k FROM tested t CROSS JOIN ladder l LEFT JOIN steps s ON s.step <= l.pos AND (t.stratum IS NULL OR s.stratum = t.stratum) GROUP BY t.stratum, t.n, l.pos),
held AS (SELECT stratum, coalesce(min(pos) FILTER (WHERE NOT (k < n * {ALPHA}::DOUBLE AND list_sum(list_transform(range(k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
    + j * ln({ALPHA}::DOUBLE) + (n - j) * ln(1 - {ALPHA}::DOUBLE)))) <= {DELTA}::DOUBLE / tests)), {_N}) AS steps FROM ks, m GROUP BY stratum),
cuts AS (SELECT stratum, {", ".join(f"min(c) FILTER (WHERE r = {i} AND pos < steps) AS c{i}" for i, _ in _RULES)} FROM held CROSS JOIN ladder GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce({" OR ".join(f"{r} > c{i}" for i, (r, _) in _RULES)}, false) AS kept
FROM v LEFT JOIN (SELECT s.stratum AS sid, c.* EXCLUDE (stratum) FROM (SELECT DISTINCT stratum FROM v) s
  JOIN cuts c ON c.stratum = s.stratum OR (c.stratum IS NULL AND s.stratum NOT IN (SELECT stratum FROM cuts WHERE stratum IS NOT NULL))) x ON x.sid = v.stratum
"""

OP6 = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], chr(10)) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, chr(10)) FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) c ON c.a = w.doc_id
"""

_BIT = "CASE {0} " + " ".join(f"WHEN '{f}' THEN {1 << i}" for i, f in enumerate(FILTERS)) + " END"

#: Every order is applied to the documents' flags, counted by equal ones; nothing is inverted.
OP11 = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
least AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
flags AS (SELECT doc_id, part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask FROM w JOIN least USING (t)),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM flags LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
l AS (SELECT unnest({list(FILTERS)}) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM l a JOIN l b ON b.f <> a.f JOIN l c ON c.f NOT IN (a.f, b.f) JOIN l d ON d.f NOT IN (a.f, b.f, c.f) JOIN l e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
letters AS (SELECT o, CAST(k AS INT) AS step, substr(o, k, 1) AS f FROM orders, range(1, {len(FILTERS) + 1}) r(k)),
steps AS (SELECT *, {_BIT.format("f")} AS bit, coalesce(sum({_BIT.format("f")}) OVER (PARTITION BY o ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS before FROM letters),
run AS (SELECT part, o, step, f, bit, c.*, c.mask & before = 0 AS here, c.mask & bit <> 0 AS fails FROM steps JOIN cells c ON true),
done AS (SELECT part, o AS filter_order, step, f AS filter,
  CAST(sum(CASE WHEN here AND NOT fails THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN here AND fails THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN NOT here AND fails THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN here AND fails THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN here AND fails THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN fails THEN n ELSE 0 END) AS BIGINT) AS failing FROM run GROUP BY part, o, step, f)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM done
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP12 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, ws, least({WINDOW}, len(ws)) AS size FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM b)),
dw AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS g FROM (SELECT d.*, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d JOIN (SELECT DISTINCT size FROM b) s ON len(ws) >= size)),
found AS (SELECT doc_id, dw.i, dw.size, item_id FROM dw JOIN iw USING (g, size)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_ROUNDS = "".join(
    f"""far{r} AS (SELECT x.vec_id, x.part, c.entry, sum((x.x - c.x) * (x.x - c.x)) AS dist FROM comps x JOIN book{r} c USING (part, place) GROUP BY ALL),
near{r} AS (SELECT vec_id, part, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist FROM far{r} GROUP BY vec_id, part),
"""
    + (
        f"""mean{r} AS (SELECT part, entry, place, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM comps JOIN near{r} USING (vec_id, part) GROUP BY part, entry, place),
book{r + 1} AS (SELECT part, entry, place, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN mean{r} m USING (part, entry, place)),
"""
        if r < ROUNDS
        else ""
    )
    for r in range(ROUNDS + 1)
)

OP13 = f"""
WITH kept AS (SELECT vec_id, label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
places AS (SELECT vec_id, len(v) // {PARTS} AS d, unnest(range(len(v))) AS k, unnest(v) AS x FROM kept),
comps AS (SELECT vec_id, k // d AS part, k % d AS place, CAST(floor({SCALE} * x::DOUBLE) AS BIGINT) AS x FROM places),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
book0 AS (SELECT part, entry, place, x FROM comps JOIN first USING (vec_id)),
{_ROUNDS}coded AS (SELECT vec_id, label, string_agg(printf('%02x', n.entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM kept JOIN near{ROUNDS} n USING (vec_id) GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) FROM book{ROUNDS}) AS codebooks_sha256 FROM coded
"""

ORACLES = {"op1_exact_dedup": OP1, "op2_warc_writer": OP2, "op6_jaccard_join": OP6, "op8_source_mix": OP8, "op10_quality_rules": OP10, "op11_filter_audit": OP11, "op12_benchmark_windows": OP12, "op13_vector_codes": OP13}

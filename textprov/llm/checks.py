"""Check SQL of the queries that SQL can express, written another way than the operators."""

from __future__ import annotations

from textprov.catalog.registry import sql_draw
from textprov.llm.licenses import PHRASES, SHARE as LICENSE_SHARE, SLACK, TEMPLATES
from textprov.llm.mixing import BLOCK, MOST, SEED, SHARD, SHARE, WEIGHTS
from textprov.llm.prints import FACTORS, K, ORDER, PLACES, SHORT, UNIT, W
from textprov.llm.repetition import LIMITS, LINE_LIMIT, SYMBOL_LIMIT

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def near_duplicates(words: int, num: int, den: int) -> str:
    """All pairs that share a shingle, their exact similarity, and components by recursion."""
    window = ", ".join(f"w[i + {k}]" for k in range(words))
    return f"""WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, list_value({window}) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {words} + 2)) AS i FROM docs WHERE len(w) >= {words})
  UNION SELECT doc_id, w FROM docs WHERE len(w) BETWEEN 1 AND {words - 1}),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE {den} * shared >= {num} * (x.n + y.n - shared)),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (
  SELECT a AS node, a AS place FROM links
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.place),
least AS (SELECT node, min(place) AS component FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.node = d.doc_id"""


def licenses() -> str:
    """Pairs of neighbouring words joined to the templates', counted by diagonal."""
    rows = ", ".join(
        f"({i}, '{label}', {str(i < len(PHRASES)).lower()}, string_split('{text}', ' '))"
        for i, (text, label) in enumerate([*PHRASES.items(), *TEMPLATES.items()])
    )
    return rf"""WITH given(template, label, exact, w) AS (VALUES {rows}),
grams AS (
  SELECT template, label, exact, size, at_, w[at_ + 1] AS x, w[at_ + 2] AS y
  FROM (SELECT *, len(w) - 1 AS size, unnest(range(len(w) - 1)) AS at_ FROM given)),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
toks AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM docs),
pairs AS (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM toks),
votes AS (
  SELECT doc_id, template, label, exact, size, i - at_ AS diagonal, list(DISTINCT at_) AS held,
         min(i) AS start, max(i) AS last
  FROM pairs JOIN grams ON t = x AND u = y GROUP BY ALL),
steps AS (
  SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS step FROM votes),
marked AS (
  SELECT *, sum((exact OR step IS NULL OR step > {SLACK})::INTEGER)
              OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS part FROM steps),
merged AS (
  SELECT doc_id, template, label, exact, size, part, min(start) AS start,
         CASE WHEN max(last) - min(start) < 2 * max(size) THEN len(list_distinct(flatten(list(held))))
              ELSE max(len(held)) END AS n
  FROM marked GROUP BY ALL),
found AS (
  SELECT *, n / size::DOUBLE AS score FROM merged
  WHERE n = size OR (NOT exact AND n / size::DOUBLE >= {LICENSE_SHARE}::DOUBLE)),
named AS (
  SELECT doc_id, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word,
         max(start) FILTER (exact) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM found GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM docs d LEFT JOIN named n ON n.doc_id = d.doc_id"""


ARCHIVE = """WITH each AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS html FROM pages),
held AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS holder FROM each)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN holder END AS refers_to
FROM held"""

REPEATS = """WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n
  FROM documents),
windows AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS m
  FROM (SELECT doc_id, h, unnest(range(n - 399)) AS i FROM docs WHERE n >= 400)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS c FROM windows) WHERE c > 1),
marked AS (
  SELECT doc_id, i, i + 400 AS e,
         (i > max(i + 400) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
           IS NOT FALSE AS fresh
  FROM twice),
runs AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked),
spans AS (SELECT doc_id, min(i) AS lo, max(e) AS hi FROM runs GROUP BY doc_id, g),
gaps AS (
  SELECT s.doc_id, lo,
         substr(h, 2 * coalesce(lag(hi) OVER w, 0) + 1, 2 * (lo - coalesce(lag(hi) OVER w, 0))) AS before,
         CASE WHEN lead(lo) OVER w IS NULL THEN substr(h, 2 * hi + 1) ELSE '' END AS after, hi
  FROM spans s JOIN docs d ON d.doc_id = s.doc_id WINDOW w AS (PARTITION BY s.doc_id ORDER BY lo)),
cut AS (
  SELECT doc_id, sum(hi - lo) AS removed, count(*) AS n_spans,
         string_agg(before || after, '' ORDER BY lo) AS kept FROM gaps GROUP BY 1)
SELECT d.doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM docs d LEFT JOIN cut c ON c.doc_id = d.doc_id"""

# Marks around a text take 12, 10 or 15 characters before it and 9 after.
CHAT = r"""WITH talk AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 END + 9
            + length(regexp_replace(text, '(### (System|User|Assistant|Role):|</turn>)', '\\\1', 'g')) AS chars
  FROM talk),
joined AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS said,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '') AS under,
         sum(chars)::BIGINT AS formatted_chars
  FROM sized GROUP BY 1)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(under) AS loss_chars,
       sha256(under) AS loss_sha256, formatted_chars FROM joined"""


def _coverage(k: int) -> str:
    window = " || ' ' || ".join(f"lead(t, {j}) OVER o" if j else "t" for j in range(k))
    return f"""grams_{k} AS (
  SELECT doc_id, i, {window} AS g FROM toks WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice_{k} AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams_{k} WHERE g IS NOT NULL)
  WHERE c > 1),
hit_{k} AS (SELECT DISTINCT doc_id, unnest(range(i, i + {k})) AS i FROM twice_{k}),
part_{k} AS (
  SELECT h.doc_id, count(*) AS words, sum(length(t)) AS chars
  FROM hit_{k} h JOIN toks d ON d.doc_id = h.doc_id AND d.i = h.i GROUP BY 1)"""


def repetition() -> str:
    parts = ",\n".join(_coverage(k) for k in LIMITS)
    joins = "\n".join(f"LEFT JOIN part_{k} ON part_{k}.doc_id = docs.doc_id" for k in LIMITS)
    chars = ", ".join(f"coalesce(part_{k}.chars, 0)::BIGINT AS repeat_chars_{k}" for k in LIMITS)
    fine = " AND ".join(
        f"repeat_chars_{k} <= {most}::DOUBLE * word_chars" for k, most in LIMITS.items()
    )
    return f"""WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
  FROM documents),
toks AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM docs),
lines AS (
  SELECT doc_id, line, count(*) AS n FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '{WORD}') GROUP BY 1, 2),
dup AS (
  SELECT doc_id, sum(n - 1) AS n_dup_lines, sum((n - 1) * length(line)) AS chars FROM lines GROUP BY 1),
{parts},
counted AS (
  SELECT docs.doc_id, len(w) AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(dup.chars, 0)::BIGINT AS dup_line_chars,
         coalesce(part_5.words, 0) AS n_repeat_words, {chars}
  FROM docs LEFT JOIN dup ON dup.doc_id = docs.doc_id
  {joins}),
based AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND n_symbols <= {SYMBOL_LIMIT}::DOUBLE * n_words
          AND dup_line_chars <= {LINE_LIMIT}::DOUBLE * word_chars AND {fine} AS kept
FROM based"""


def mixing() -> str:
    """Targets by trying every water level; seats by ranking all quotients."""
    weights = ", ".join(map(str, WEIGHTS))
    draw = sql_draw(SEED, "coalesce(doc_id::VARCHAR, '')", "md5(coalesce(text, ''))")
    first = sql_draw(SEED, "'first'", "coalesce(source, '')", "shard")
    return f"""WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         {draw} AS draw FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS texts FROM sizes GROUP BY 1),
given AS (
  SELECT *, list_value({weights})[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight
  FROM totals),
levels AS (
  SELECT a.source, {MOST} * a.source_size / a.weight::DOUBLE AS ratio,
         ((SELECT sum(source_size) FROM totals) * {SHARE}::DOUBLE
          - coalesce(sum(CASE WHEN b.below THEN {MOST} * b.source_size END), 0))
         / (sum(CASE WHEN b.below THEN 0 ELSE b.weight END)) AS level
  FROM given a, LATERAL (
    SELECT source_size, weight, ({MOST} * source_size / weight::DOUBLE) < ({MOST} * a.source_size / a.weight::DOUBLE) AS below
    FROM given) b GROUP BY ALL),
final AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE level <= ratio),
targets AS (
  SELECT source, source_size, texts, weight, least({MOST}::DOUBLE * source_size, level * weight) AS target
  FROM given, final),
placed AS (
  SELECT s.*, t.source_size, t.target,
         s.draw % greatest(1, ceil(t.texts / {SHARD}.0::DOUBLE)::BIGINT) AS shard
  FROM sizes s JOIN targets t ON t.source IS NOT DISTINCT FROM s.source),
shards AS (
  SELECT source, shard, sum(size)::BIGINT AS shard_size,
         any_value(target) * (sum(size)::BIGINT / greatest(any_value(source_size), 1)::DOUBLE) AS target
  FROM placed GROUP BY 1, 2),
due AS (SELECT *, target / {BLOCK}.0::DOUBLE AS due FROM shards),
quotients AS (
  SELECT source, shard, due / (2 * seat - 1) AS quotient, seat
  FROM (SELECT source, shard, due, unnest(range(1, ceil(due)::BIGINT + 20)) AS seat FROM due)),
won AS (
  SELECT source, shard, count(*) AS seats FROM (
    SELECT source, shard, row_number() OVER (ORDER BY quotient DESC, source NULLS LAST, shard, seat) AS place
    FROM quotients)
  WHERE place <= (SELECT floor(sum(due)) FROM due) GROUP BY 1, 2),
quotas AS (
  SELECT s.source, s.shard, shard_size, greatest(ceil(shard_size / {BLOCK}.0::DOUBLE)::BIGINT, 1) AS blocks,
         least(coalesce(w.seats, 0), {MOST} * ceil(shard_size / {BLOCK}.0::DOUBLE)::BIGINT) AS quota,
         {first.replace('shard', 's.shard').replace("coalesce(source", "coalesce(s.source")} AS drawn
  FROM shards s LEFT JOIN won w ON w.source IS NOT DISTINCT FROM s.source AND w.shard = s.shard),
stream AS (
  SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY draw, doc_id, size) - size AS before FROM placed),
cut AS (
  SELECT p.*, q.blocks, q.quota // q.blocks AS rounds, q.quota % q.blocks AS rest, q.drawn % q.blocks AS first,
         q.shard_size
  FROM stream p JOIN quotas q ON q.source IS NOT DISTINCT FROM p.source AND q.shard = p.shard)
SELECT doc_id, source, size, source_size, target,
       (rounds * size
        + greatest(least(before + size, least((first + rest) * {BLOCK}, shard_size)) - greatest(before, first * {BLOCK}), 0)
        + greatest(least(before + size, greatest(first + rest - blocks, 0) * {BLOCK}) - before, 0))::BIGINT AS taken
FROM cut"""


#: CRC-32 by its table, which follows from the polynomial. ``{table}`` is a CTE, ``{crc}`` the value
#: of a text ``t`` beside it.
CRC_TABLE = """(SELECT list(v ORDER BY b) AS tab FROM (SELECT b,
    list_reduce(list_concat([b], range(8)), lambda c, z: CASE WHEN c & 1 = 1
      THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS b)))"""


def crc(t: str) -> str:
    """SQL for the CRC-32 of the text ``t``, beside a column ``tab``."""
    octets = f"list_transform(range(length(hex({t})) // 2), lambda i: ('0x' || hex({t})[2 * i + 1:2 * i + 2])::BIGINT)"
    return f"""xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {octets}),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"""


def fingerprints() -> str:
    """Every gram and every window listed, the least of each window by a sort."""
    gram = f"(({FACTORS[2]} * ({FACTORS[1]} * a + b)) + ({FACTORS[1]} * c + d))"
    return rf"""WITH crcs AS {CRC_TABLE},
base AS (SELECT row_number() OVER (ORDER BY doc_id DESC) AS r, doc_id, coalesce(text, '') AS text FROM documents),
ends AS (SELECT count(*) AS n FROM base),
pairs AS (
  SELECT x.r, x.doc_id, x.text, length(x.text)::BIGINT AS n_chars,
         left(x.text, length(x.text) - length(x.text) // 3) || left(y.text, length(x.text) // 3) AS edited
  FROM base x, ends JOIN base y ON y.r = x.r % n + 1),
texts AS (SELECT r, 0 AS side, text AS t FROM pairs UNION ALL SELECT r, 1, edited FROM pairs),
units AS (
  SELECT r, side, unnest(u) AS u, unnest(range(len(u))) AS i
  FROM (SELECT r, side, regexp_extract_all(t, '{UNIT}') AS u FROM texts)),
codes AS (SELECT u, {crc("u")} + 1 AS code FROM (SELECT DISTINCT u FROM units), crcs),
rows_ AS (SELECT r, side, i, code FROM units JOIN codes USING (u)),
grams AS (
  SELECT r, side, i, {gram} AS h, count(*) OVER (PARTITION BY r, side) - {K - 1} AS m
  FROM (SELECT r, side, i, code AS a, lead(code) OVER o AS b, lead(code, 2) OVER o AS c, lead(code, 3) OVER o AS d
        FROM rows_ WINDOW o AS (PARTITION BY r, side ORDER BY i))),
few AS (
  SELECT r, side, 0 AS i, list_reduce(list_concat([0::BIGINT], list(code ORDER BY i)),
         lambda h, c: (h * {FACTORS[1]} + c) & {SHORT}) AS h, 1 AS m
  FROM rows_ GROUP BY r, side HAVING count(*) < {K}),
all_ AS (SELECT * FROM grams WHERE h IS NOT NULL UNION ALL SELECT * FROM few),
least_ AS (
  SELECT r, side, i, m,
         min((h & {ORDER}) * 2147483648 + ({PLACES} - i)) OVER (PARTITION BY r, side ORDER BY i
           ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING) AS v FROM all_),
chosen AS (
  SELECT DISTINCT r, side, {PLACES} - v % 2147483648 AS place FROM least_ WHERE i = 0 OR i <= m - {W}),
prints AS (
  SELECT r, side, list(hex(h) || '@' || place ORDER BY place) AS p, list(DISTINCT h) AS s
  FROM chosen JOIN (SELECT r, side, i AS place, h FROM all_) USING (r, side, place) GROUP BY r, side),
full_ AS (
  SELECT t.r, t.side, coalesce(array_to_string(p, ' '), '') AS p, coalesce(s, []) AS s
  FROM texts t LEFT JOIN prints q ON q.r = t.r AND q.side = t.side),
like_ AS (
  SELECT a.r, a.p, b.p AS q, len(list_intersect(a.s, b.s)) AS e, len(a.s) + len(b.s) AS eu,
         len(list_intersect(a.s, c.s)) AS f, len(a.s) + len(c.s) AS fu
  FROM full_ a JOIN full_ b ON a.r = b.r AND a.side = 0 AND b.side = 1, ends
  JOIN full_ c ON c.side = 0 AND c.r = a.r % n + 1)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, p AS fingerprint, q AS edited_fingerprint,
       CASE WHEN eu = 0 THEN 1.0::DOUBLE ELSE e / (eu - e) END AS near_edited,
       CASE WHEN fu = 0 THEN 1.0::DOUBLE ELSE f / (fu - f) END AS near_next
FROM like_ JOIN pairs USING (r)"""


def trie() -> str:
    """Every prefix of every conversation listed and grouped; subtrees by joining all ancestors."""
    return f"""WITH crcs AS {CRC_TABLE},
given AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                            md5(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id::VARCHAR AS name, {crc("name")} % 6 AS h
  FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS name FROM given), crcs),
turns AS (
  SELECT c.conv_id, g.pos, 0 AS part, g.role, g.text
  FROM convs c JOIN given g ON g.conv_id = c.conv_id - c.conv_id % 100 AND g.pos <= h
  UNION ALL
  SELECT c.conv_id, g.pos, 1, g.role, g.text FROM convs c JOIN given g ON g.conv_id = c.conv_id AND g.pos > h),
lists AS (
  SELECT conv_id, list({{'r': role, 't': text}} ORDER BY part, pos) AS w FROM turns GROUP BY 1
  UNION ALL SELECT conv_id, [] FROM convs WHERE conv_id NOT IN (SELECT conv_id FROM turns)),
prefixes AS (SELECT conv_id, len(w) AS n, d, w[1:d] AS p FROM (SELECT *, unnest(range(len(w) + 1)) AS d FROM lists)),
nodes AS (
  SELECT d, p, min(conv_id) AS conv, count(*) AS n,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends,
         CASE WHEN d = 0 THEN 0 ELSE length(p[d].t) END AS chars
  FROM prefixes GROUP BY d, p),
kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT n.*, coalesce(k, 0) AS k FROM nodes n LEFT JOIN kids USING (d, p)),
sums AS (
  SELECT u AS d, p[1:u] AS p, sum((n - 1) * chars) AS saved, count(*) FILTER (k = 0) AS leaves
  FROM (SELECT *, unnest(range(d + 1)) AS u FROM full_) GROUP BY ALL)
SELECT f.conv AS conv_id, f.d AS depth, up.conv AS parent_conv_id, f.n AS n_convs, f.k AS n_children,
       s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM full_ f JOIN sums s USING (d, p) LEFT JOIN nodes up ON up.d = f.d - 1 AND up.p = f.p[1:f.d - 1]"""


#: All postings of all terms, joined to the items' terms.
SEARCH = rf"""WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
sized AS (SELECT row_number() OVER () AS r, doc_id, w AS list_, len(w) AS n FROM docs WHERE len(w) > 0),
totals AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM sized),
posts AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(list_) AS term FROM sized) GROUP BY ALL),
items AS (SELECT item_id, row_number() OVER () AS i, unnest(list_distinct(regexp_extract_all(
         translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
dfs AS (SELECT term, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)))::BIGINT AS w
        FROM posts, totals WHERE term IN (SELECT term FROM items) GROUP BY term, nn),
scores AS (
  SELECT item_id, i, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::BIGINT AS score
  FROM items JOIN dfs USING (term) JOIN posts USING (term) JOIN sized USING (r), totals
  GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank
  FROM scores JOIN sized USING (r) WHERE score > 0) WHERE rank <= 10"""

# Every run of two lines and 40 bytes that stands at an earlier place goes. It is enough to
# look at the shortest run from each line and the shortest to each line.
LINE_RUNS = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
),
placed AS (
  SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS stop FROM lines
),
spots AS (SELECT doc_id, i, line, stop - strlen(line) AS start, stop FROM placed),
pairs AS (
  SELECT a.doc_id, a.i AS lo, b.i AS hi FROM spots a JOIN spots b
  ON a.doc_id = b.doc_id AND b.i > a.i AND b.i <= a.i + 41 AND b.stop - a.start >= 40
),
windows AS (
  SELECT doc_id, lo, min(hi) AS hi FROM pairs GROUP BY doc_id, lo
  UNION
  SELECT doc_id, max(lo) AS lo, hi FROM pairs GROUP BY doc_id, hi
),
held AS (
  SELECT w.doc_id, w.lo, w.hi, string_agg(s.line, chr(10) ORDER BY s.i) AS run
  FROM windows w JOIN spots s ON s.doc_id = w.doc_id AND s.i BETWEEN w.lo AND w.hi
  GROUP BY w.doc_id, w.lo, w.hi
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, lo) AS place FROM held
),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(lo, hi)) AS i FROM ranked WHERE place > 1
),
cut AS (
  SELECT s.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
         coalesce(string_agg(s.line, chr(10) ORDER BY s.i) FILTER (g.i IS NULL), '') AS kept
  FROM spots s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.i = g.i GROUP BY s.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines,
       coalesce(n_removed, 0)::BIGINT AS n_removed_lines,
       length(kept)::BIGINT AS kept_chars, sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN cut c ON d.doc_id = c.doc_id
"""

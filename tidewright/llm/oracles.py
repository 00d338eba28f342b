"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from .minhash import SHINGLE, SIMILAR
from .sharding import MULTIPLIER

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _crc_table() -> str:
    """CTE T with the list t of CRC-32's 256 table entries, from its polynomial."""
    steps = ["T0 AS (SELECT i, CAST(i AS BIGINT) AS c FROM range(256) x(i))"]
    steps += [f"T{k + 1} AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM T{k})" for k in range(8)]
    return ", ".join([*steps, "T AS (SELECT list(c ORDER BY i) AS t FROM T8)"])


def _bytes(text: str) -> str:
    digits = f"list_transform(string_split(hex(encode({text})), ''), lambda c: instr('0123456789ABCDEF', c) - 1)"
    return f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST(16 * ({digits})[2 * i + 1] + ({digits})[2 * i + 2] AS BIGINT))"


def _crc(b: str) -> str:
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {b}), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)"


def _jump(name: str, shards: int) -> str:
    """CTEs that end in `name` (ident, shard): the jump hash in 128-bit integers, step by step."""
    out = [f"{name}0 AS (SELECT DISTINCT ident, CASE WHEN ident < 0 THEN CAST(ident AS HUGEINT) + 18446744073709551616 ELSE CAST(ident AS HUGEINT) END AS k, 0 AS place, 0 AS upto FROM D)"]
    for i in range(shards + 1):
        k = f"(k * {MULTIPLIER} + 1) % 18446744073709551616"
        out.append(
            f"{name}{i + 1} AS (SELECT ident, CASE WHEN upto < {shards} THEN {k} ELSE k END AS k, CASE WHEN upto < {shards} THEN upto ELSE place END AS place, "
            f"CASE WHEN upto < {shards} THEN CAST(floor(CAST(upto + 1 AS DOUBLE) * (2147483648.0 / CAST(({k}) // 8589934592 + 1 AS DOUBLE))) AS BIGINT) ELSE upto END AS upto FROM {name}{i})"
        )
    return ", ".join([*out, f"{name} AS (SELECT ident, CAST(place AS INTEGER) AS shard FROM {name}{shards + 1})"])


SHARDING = f"""
WITH {_crc_table()},
D AS (SELECT doc_id, coalesce(doc_id, -1) AS ident, coalesce(text, '') AS text FROM documents),
H AS (SELECT *, list_transform(string_split(hex(encode(text)), ''), lambda c: instr('0123456789ABCDEF', c) - 1) AS d, octet_length(encode(text)) AS n, {_bytes('CAST(ident AS VARCHAR)')} AS ib FROM D),
B AS (SELECT doc_id, ident, n, ib, list_transform(range(0, n), lambda i: CAST(16 * d[2 * i + 1] + d[2 * i + 2] AS BIGINT)) AS tb FROM H),
C AS (SELECT doc_id, ident, n, {_crc('ib')} AS ordering, {_crc('tb')} AS text_crc32 FROM B, T),
{_jump('A', 8)}, {_jump('G', 9)}
SELECT doc_id, CAST(n + 1 AS BIGINT) AS size, text_crc32, 'key' AS law, A.shard,
  row_number() OVER (PARTITION BY A.shard ORDER BY ordering, C.ident, text_crc32, n) - 1 AS slot, G.shard AS grown_shard
FROM C JOIN A ON A.ident = C.ident JOIN G ON G.ident = C.ident
"""


def _windows(k: int) -> str:
    """Relation of the places of windows of k words that occur twice in their text."""
    return f"(SELECT doc, i FROM (SELECT doc, i, count(*) OVER (PARTITION BY doc, h) AS n FROM (SELECT doc, i, hash(w[i : i + {k - 1}]) AS h FROM (SELECT doc, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM W))) WHERE n > 1)"


def _covered(k: int) -> str:
    return f"(SELECT doc, count(DISTINCT i + o) AS n FROM {_windows(k)}, range({k}) x(o) GROUP BY doc)"


REPETITION = rf"""
WITH D AS (SELECT row_number() OVER () AS doc, doc_id, text FROM documents),
W AS (SELECT doc, {WORDS} AS w FROM D),
L AS (SELECT doc, count(*) - count(DISTINCT l) AS n FROM (SELECT doc, unnest(string_split(text, chr(10))) AS l FROM D WHERE text IS NOT NULL) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc),
M AS (SELECT D.doc, D.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(L.n, 0) AS n_dup_lines,
  coalesce(R.n, 0) AS n_repeat_words, coalesce(C.n, 0) AS covered, E.doc IS NOT NULL AS long
  FROM D JOIN W ON W.doc = D.doc LEFT JOIN L ON L.doc = D.doc LEFT JOIN {_covered(3)} R ON R.doc = D.doc LEFT JOIN {_covered(8)} C ON C.doc = D.doc
  LEFT JOIN (SELECT DISTINCT doc FROM {_windows(61)}) E ON E.doc = D.doc),
B AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM M)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR covered > 0.3 * n_words OR long) AS kept FROM B
"""

MINHASH = rf"""
WITH RECURSIVE W AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
S AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE} + 1, least(len(w), 1)) + 1)) AS i FROM W)),
N AS (SELECT doc_id, count(*) AS n FROM S GROUP BY doc_id),
P AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM S a JOIN S b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
E AS (SELECT P.a, P.b FROM P JOIN N x ON x.doc_id = P.a JOIN N y ON y.doc_id = P.b WHERE {SIMILAR[1]} * k >= {SIMILAR[0]} * (x.n + y.n - k)),
R AS (SELECT doc_id, doc_id AS node FROM W UNION SELECT R.doc_id, E.b FROM R JOIN E ON E.a = R.node),
C AS (SELECT doc_id, min(node) AS component_id FROM R GROUP BY doc_id)
SELECT C.doc_id, coalesce(N.n, 0) AS n_shingles, component_id, C.doc_id = component_id AS kept FROM C LEFT JOIN N ON N.doc_id = C.doc_id
"""



def _doubling() -> str:
    """CTEs H1 to H128: fingerprints of the strings of 1, 2, 4, ... bytes at each byte."""
    out = ["H1 AS (SELECT doc, i, hash(b) AS h1 FROM B)"]
    for k in (2, 4, 8, 16, 32, 64, 128):
        out.append(f"H{k} AS (SELECT *, hash(h{k // 2}, lead(h{k // 2}, {k // 2}) OVER (PARTITION BY doc ORDER BY i)) AS h{k} FROM H{k // 2})")
    return ", ".join(out)


SUBSTRINGS = f"""
WITH D AS (SELECT row_number() OVER () AS doc, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
N AS (SELECT doc, length(h) // 2 AS n, string_split(h, '') AS d FROM D),
B AS (SELECT doc, i, d[2 * i + 1] || d[2 * i + 2] AS b, n FROM (SELECT doc, n, d, unnest(range(0, n)) AS i FROM N)),
{_doubling()},
W AS (SELECT H128.doc, H128.i, hash(h128, lead(h64, 128) OVER w, lead(h8, 192) OVER w) AS s, H128.i + 200 <= N.n AS fits FROM H128 JOIN N ON N.doc = H128.doc WINDOW w AS (PARTITION BY H128.doc ORDER BY H128.i)),
C AS (SELECT doc, i, fits AND count(*) FILTER (WHERE fits) OVER (PARTITION BY s) > 1 AS twice FROM W),
G AS (SELECT doc, i, max(CAST(twice AS INTEGER)) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM C),
E AS (SELECT G.doc, G.i, gone, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY G.doc ORDER BY G.i), 0) = 0 AS starts, b FROM G JOIN B ON B.doc = G.doc AND B.i = G.i),
R AS (SELECT doc, CAST(count(*) AS BIGINT) AS n_bytes, CAST(sum(gone) AS BIGINT) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans, sha256(unhex(coalesce(string_agg(b, '' ORDER BY i) FILTER (WHERE gone = 0), ''))) AS kept_sha256 FROM E GROUP BY doc)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM D LEFT JOIN R ON R.doc = D.doc
"""

TERMS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH I AS (SELECT item_id, text, {TERMS.format(text='text')} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
L AS (SELECT item_id, w, len(w) AS n, len({TERMS.format(text=r"regexp_extract(rtrim(text, chr(10) || ' '), '^((.|\n)*)\n[^\n]*$', 1)")}) AS head, CAST(greatest(6, ceil(log2(len(w)))) AS INTEGER) AS c FROM I WHERE len(w) > 0),
X AS (SELECT *, CASE WHEN head BETWEEN 3 AND n - 1 THEN head END AS cut, 1 << c AS half FROM L),
F AS (SELECT item_id, term, count(*) AS f FROM (SELECT item_id, unnest(w) AS term FROM X) GROUP BY item_id, term),
Z AS (SELECT count(*) AS items, avg(n) AS mean FROM X),
K AS (SELECT term, ln(1 + (items - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM F, Z GROUP BY term, items),
Q AS (SELECT F.item_id, half, F.term, idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean)) AS weight FROM F JOIN K ON K.term = F.term JOIN X ON X.item_id = F.item_id, Z),
M AS (SELECT item_id, 0.6 * sum(weight) AS least FROM Q GROUP BY item_id),
D AS (SELECT row_number() OVER () AS doc, doc_id, {TERMS.format(text="coalesce(text, '')")} AS w FROM documents),
T AS (SELECT doc, unnest(range(0, len(w))) AS pos, unnest(w) AS term, len(w) AS n FROM D),
O AS (SELECT DISTINCT half FROM X),
A AS (SELECT doc, term, half, pos // half AS k, greatest(1, CAST(ceil((n - half) / half) AS BIGINT)) AS p FROM T, O WHERE term IN (SELECT term FROM K)),
P AS (SELECT DISTINCT doc, term, half, least(k, p - 1) AS p FROM A UNION SELECT doc, term, half, k - 1 FROM A WHERE k > 0 AND k < p),
S AS (SELECT P.doc, P.p, Q.item_id, sum(weight) AS score FROM P JOIN Q ON Q.term = P.term AND Q.half = P.half GROUP BY P.doc, P.p, Q.item_id),
C AS (SELECT S.doc, S.p, S.item_id, D.w[S.p * half + 1 : (S.p + 2) * half] AS own, X.w AS item, cut FROM S JOIN M ON M.item_id = S.item_id AND score >= least * 0.9999 JOIN X ON X.item_id = S.item_id JOIN D ON D.doc = S.doc),
Y AS (SELECT doc, p, item_id, own, part, which FROM (SELECT doc, p, item_id, own, unnest(CASE WHEN cut IS NULL THEN [item] ELSE [item[1 : cut], item[cut + 1 :]] END) AS part, unnest(CASE WHEN cut IS NULL THEN [0] ELSE [0, 1] END) AS which FROM C)),
V AS (SELECT doc, p, item_id, which, count(DISTINCT g) AS n, count(DISTINCT g) FILTER (WHERE contains(' ' || array_to_string(own, ' ') || ' ', ' ' || g || ' ')) AS k
  FROM (SELECT doc, p, item_id, which, own, array_to_string(part[i : i + 2], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(part) - 2, least(len(part), 1)) + 1)) AS i FROM Y)) GROUP BY doc, p, item_id, which),
H AS (SELECT doc, p, item_id FROM V GROUP BY doc, p, item_id HAVING bool_and(k >= greatest(1, least(ceil(0.6 * n), n - 3 * which))) OR sum(k) >= 0.8 * sum(n)),
R AS (SELECT doc, list(item_id ORDER BY item_id) AS item_ids FROM (SELECT DISTINCT doc, item_id FROM H) GROUP BY doc)
SELECT doc_id, array_to_string(coalesce(item_ids, []), ',') AS item_ids, CAST(len(coalesce(item_ids, [])) AS BIGINT) AS n_items, item_ids IS NULL AS kept FROM D LEFT JOIN R ON R.doc = D.doc
"""

ORACLE = {"op1_sharding": SHARDING, "op3_repetition": REPETITION, "op7_decontamination": DECONTAMINATION, "op9_minhash": MINHASH, "op10_suffix_dedup": SUBSTRINGS}

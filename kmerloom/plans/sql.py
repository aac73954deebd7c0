"""SQL texts (DuckDB) of the queries, put together from the same few steps."""

from __future__ import annotations

from ..functions.shape import Shape


def clean(table: str, key: str) -> str:
    return f"""SELECT {key} AS text_id, translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'BDEFHIJKLMNOPQRSUVWXYZ', repeat('A', 22)) AS dna FROM {table}"""


def name(shape: Shape, p: str = "p", dna: str = "dna") -> str:
    out = "0"
    for offset, block in zip(reversed(shape.care), reversed(shape.g[1:]), strict=True):
        out = f"CASE WHEN {p} + {offset} >= length({dna}) THEN 0 ELSE 1 + (instr('ACGT', substr({dna}, CAST({p} + {offset} + 1 AS BIGINT), 1)) - 1) * {block} + {out} END"
    return f"CAST({out} AS BIGINT)"


def letters(table: str, key: str) -> str:
    """text_id, pos, c: every letter, and null at the end of the text."""
    return f"""SELECT text_id, unnest(range(0, length(dna) + 1)) AS pos, unnest(list_append(regexp_extract_all(dna, '.'), NULL)) AS c FROM ({clean(table, key)})"""


def kmers(table: str, key: str, shape: Shape) -> str:
    """text_id, pos, name of every window."""
    out = "0"
    for offset, block in zip(reversed(shape.care), reversed(shape.g[1:]), strict=True):
        v = f"lead(v, {offset}) OVER w"
        out = f"CASE WHEN {v} IS NULL THEN 0 ELSE 1 + {v} * {block} + {out} END"
    return f"""SELECT text_id, pos, CAST({out} AS BIGINT) AS name FROM (SELECT text_id, pos, CAST(instr('ACGT', c) - 1 AS BIGINT) AS v FROM ({letters(table, key)})) WINDOW w AS (PARTITION BY text_id ORDER BY pos)"""


def spellings(table: str, key: str, shape: Shape) -> str:
    """name, spelling of every window."""
    spelled = " || ".join(f"coalesce(lead(c, {o}) OVER w, '$')" for o in shape.care)
    return f"""SELECT name, spelling FROM ({kmers(table, key, shape)}) JOIN (SELECT text_id, pos, {spelled} AS spelling FROM ({letters(table, key)}) WINDOW w AS (PARTITION BY text_id ORDER BY pos)) USING (text_id, pos)"""


def lextext(table: str, key: str, shape: Shape) -> str:
    return f"""SELECT text_id, CAST(row_number() OVER (PARTITION BY text_id ORDER BY pos % {shape.span}, pos) - 1 AS INTEGER) AS lexpos, pos AS orig, name FROM ({kmers(table, key, shape)})"""


def gsa(table: str, key: str, shape: Shape) -> str:
    """WITH steps up to gsa (text_id, rank, lexpos, orig, name, lcp)."""
    return f"""
lextext AS MATERIALIZED ({lextext(table, key, shape)}),
symbols AS MATERIALIZED (SELECT text_id, list(name ORDER BY lexpos) AS syms FROM lextext GROUP BY text_id),
sorted AS MATERIALIZED (
  SELECT l.text_id, row_number() OVER w - 1 AS rank, lexpos, orig, name, lag(lexpos) OVER w AS before, syms
  FROM lextext l JOIN symbols USING (text_id)
  WINDOW w AS (PARTITION BY l.text_id ORDER BY list_slice(syms, lexpos + 1, len(syms)))
),
gsa AS MATERIALIZED (
  SELECT text_id, CAST(rank AS INTEGER) AS rank, lexpos, orig, name,
         CAST(CASE WHEN before IS NULL THEN 0 ELSE coalesce(
           list_position(list_transform(range(0, len(syms) - greatest(lexpos, before)), lambda k: syms[lexpos + k + 1] <> syms[before + k + 1]), true) - 1,
           len(syms) - greatest(lexpos, before)) END AS INTEGER) AS lcp
  FROM sorted
),
intervals AS MATERIALIZED (
  SELECT text_id, name, min(rank) AS lo, CAST(max(rank) + 1 AS INTEGER) AS hi, CAST(count(*) AS INTEGER) AS size FROM gsa GROUP BY text_id, name
)"""


def candidates(table: str, key: str, shape: Shape, max_add: int, least: int) -> str:
    """WITH steps up to candidates (text_id, name, add, src_lo, src_hi, cov, covered as text)."""
    return f"""{gsa(table, key, shape)},
pairs AS (
  SELECT t.text_id, t.name, i.lo, i.hi, a.add, t.rank AS t, s.rank AS s, s.lcp
  FROM gsa t JOIN intervals i ON i.text_id = t.text_id AND i.name = t.name AND i.size >= {max(2, least)}
  CROSS JOIN (SELECT unnest(range(1, {max_add + 1})) AS add) a
  JOIN gsa s ON s.text_id = t.text_id AND s.orig = t.orig - a.add * {shape.span}
),
marked AS (SELECT *, CASE WHEN s = lag(s) OVER w + 1 AND lcp >= add + 1 THEN 0 ELSE 1 END AS start FROM pairs WINDOW w AS (PARTITION BY text_id, name, add ORDER BY s)),
islands AS (SELECT *, sum(start) OVER (PARTITION BY text_id, name, add ORDER BY s) AS run FROM marked),
runs AS (SELECT text_id, name, add, run, min(s) AS s0, max(s) + 1 AS s1, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM islands GROUP BY ALL HAVING count(*) >= {least}),
inside AS (
  SELECT i.text_id, i.name, i.add, i.run, r.s0, r.n, i.s - r.s0 AS t, i.t - r.s0 AS u
  FROM islands i JOIN runs r USING (text_id, name, add, run) WHERE NOT (r.s1 <= r.lo OR r.s0 >= r.hi)
),
bars AS (SELECT text_id, name, add, run, greatest(t, u) AS t, max(least(t, u) + 1) AS bar FROM inside WHERE u >= 0 AND u < n GROUP BY ALL),
ends AS (
  SELECT i.text_id, i.name, i.add, i.run, i.s0, i.t + 1 AS q, max(coalesce(bar, 0)) OVER (w ROWS UNBOUNDED PRECEDING) AS p, lead(coalesce(bar, 0)) OVER w AS next
  FROM inside i LEFT JOIN bars USING (text_id, name, add, run, t) WINDOW w AS (PARTITION BY i.text_id, i.name, i.add, i.run ORDER BY i.t)
),
spans AS (
  SELECT text_id, name, add, run, s0 AS src_lo, s1 AS src_hi FROM runs WHERE s1 <= lo OR s0 >= hi
  UNION ALL SELECT text_id, name, add, run, s0 + p, s0 + q FROM ends WHERE (next IS NULL OR next > p) AND q - p >= {least}
),
candidates AS MATERIALIZED (
  SELECT s.text_id, s.name, CAST(s.add AS INTEGER) AS add, CAST(src_lo AS INTEGER) AS src_lo, CAST(src_hi AS INTEGER) AS src_hi, CAST(count(*) AS INTEGER) AS cov, string_agg(CAST(t AS VARCHAR), ',' ORDER BY i.s) AS covered
  FROM spans s JOIN islands i ON i.text_id = s.text_id AND i.name = s.name AND i.add = s.add AND i.run = s.run AND i.s >= src_lo AND i.s < src_hi
  GROUP BY s.text_id, s.name, s.add, src_lo, src_hi
),
preferred AS MATERIALIZED (
  SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY text_id, name ORDER BY cov DESC, add DESC, src_lo) = 1
)"""


BYTES = "CASE " + " ".join(f"WHEN {{0}} < {1 << (8 * n)} THEN {n}" for n in range(1, 8)) + " ELSE 8 END"


def bytes_needed(expression: str) -> str:
    return "(" + BYTES.replace("{0}", f"({expression})") + ")"


#: Steps up to turns (text_id, name, turn from 1): the most frequent names first.
BY_SIZE = "turns AS MATERIALIZED (SELECT text_id, name, row_number() OVER (PARTITION BY text_id ORDER BY size DESC, name) AS turn FROM (SELECT DISTINCT text_id, name FROM candidates) JOIN intervals USING (text_id, name))"

#: The reverse of a topological order of the preferences of names of three ranks or more; what depends on a cycle comes last there, by size.
BY_DEPENDENCY = """prefer AS MATERIALIZED (SELECT p.text_id, p.name, g.name AS src FROM preferred p JOIN gsa g ON g.text_id = p.text_id AND g.rank = p.src_lo JOIN intervals i ON i.text_id = p.text_id AND i.name = p.name WHERE i.size >= 3),
nodes AS MATERIALIZED (SELECT text_id, name FROM candidates UNION SELECT text_id, src FROM prefer),
layers AS (
  SELECT text_id, name, 0 AS depth, [name] AS path FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM prefer p WHERE p.text_id = n.text_id AND p.name = n.name AND p.src <> p.name)
  UNION ALL SELECT p.text_id, p.name, l.depth + 1, list_append(l.path, p.name) FROM layers l JOIN prefer p ON p.text_id = l.text_id AND p.src = l.name AND p.src <> p.name
),
topological AS MATERIALIZED (
  SELECT text_id, name, row_number() OVER (PARTITION BY text_id ORDER BY depth NULLS LAST, path, size DESC, name) AS pos FROM nodes LEFT JOIN layers USING (text_id, name) JOIN intervals USING (text_id, name)
),
turns AS MATERIALIZED (SELECT text_id, name, row_number() OVER (PARTITION BY text_id ORDER BY pos DESC) AS turn FROM topological JOIN (SELECT text_id, name FROM prefer) USING (text_id, name))"""


def by_forest(repair: bool = False) -> str:
    """The choice of greatest coverage on the preference forest, deepest first; then all others by size. A cycle loses the edge of its
    largest name, with repair that of least coverage if it has less."""
    lost = "CASE WHEN top_cov > weak.cov THEN weak.n ELSE top END" if repair else "top"
    return f"""edges AS MATERIALIZED (SELECT p.text_id, p.name, g.name AS src, p.cov FROM preferred p JOIN gsa g ON g.text_id = p.text_id AND g.rank = p.src_lo JOIN intervals i ON i.text_id = p.text_id AND i.name = p.name WHERE i.size >= 3 AND g.name <> p.name),
paths AS (
  SELECT text_id, name AS start, src AS at, 1 AS n, name AS top, struct_pack(cov := cov, n := name) AS weak FROM edges
  UNION ALL SELECT p.text_id, start, e.src, p.n + 1, greatest(top, e.name), least(weak, struct_pack(cov := e.cov, n := e.name)) FROM paths p JOIN edges e ON e.text_id = p.text_id AND e.name = p.at WHERE p.at <> p.start AND p.n < 10000 AND p.n <= (SELECT count(*) FROM edges x WHERE x.text_id = p.text_id)
),
cycles AS MATERIALIZED (SELECT p.text_id, p.start AS name, p.top, p.weak, e.cov AS top_cov FROM paths p JOIN edges e ON e.text_id = p.text_id AND e.name = p.top WHERE p.at = p.start),
forest AS MATERIALIZED (SELECT e.* FROM edges e WHERE NOT EXISTS (SELECT 1 FROM cycles c WHERE c.text_id = e.text_id AND c.name = e.name AND c.name = {lost})),
depths AS (
  SELECT text_id, src AS name, CAST(NULL AS BIGINT) AS parent, 0 AS depth, CAST(-1 AS BIGINT) AS cov FROM forest f WHERE NOT EXISTS (SELECT 1 FROM forest g WHERE g.text_id = f.text_id AND g.name = f.src) GROUP BY ALL
  UNION ALL SELECT f.text_id, f.name, f.src, d.depth + 1, CAST(f.cov AS BIGINT) FROM depths d JOIN forest f ON f.text_id = d.text_id AND f.src = d.name
),
placed AS MATERIALIZED (SELECT * FROM depths),
gains AS (
  SELECT text_id, name, parent, depth, CAST(0 AS BIGINT) AS keep, cov AS compress FROM placed QUALIFY depth = max(depth) OVER (PARTITION BY text_id)
  UNION ALL
  SELECT p.text_id, p.name, any_value(p.parent), any_value(p.depth), CAST(coalesce(sum(greatest(c.keep, c.compress)), 0) AS BIGINT), CAST(any_value(p.cov) + coalesce(sum(c.keep), 0) AS BIGINT)
  FROM (SELECT text_id, any_value(depth) AS depth FROM gains GROUP BY text_id) d JOIN placed p ON p.text_id = d.text_id AND p.depth = d.depth - 1 LEFT JOIN gains c ON c.text_id = p.text_id AND c.parent = p.name
  GROUP BY p.text_id, p.name
),
settled AS (
  SELECT text_id, name, depth, false AS wanted FROM gains WHERE depth = 0
  UNION ALL SELECT g.text_id, g.name, g.depth, NOT s.wanted AND g.compress > g.keep FROM settled s JOIN gains g ON g.text_id = s.text_id AND g.parent = s.name
),
turns AS MATERIALIZED (
  SELECT text_id, name, row_number() OVER (PARTITION BY text_id ORDER BY depth DESC NULLS LAST, CASE WHEN depth IS NULL THEN -size ELSE 0 END, name) AS turn
  FROM (SELECT DISTINCT text_id, name FROM candidates) JOIN intervals USING (text_id, name) LEFT JOIN (SELECT text_id, name, depth FROM settled WHERE wanted) USING (text_id, name)
)"""


def selected(table: str, key: str, shape: Shape, max_add: int, least: int, turns: str) -> str:
    """WITH RECURSIVE steps up to an index whose names decide in turn: chosen, ranks, h_table, widths and entries (as hexadecimal text).

    A text's names decide one at a time; walk carries the ranks that are removed or read so far.
    """
    number = lambda v, n: f"lpad(format('{{:x}}', {v}), CAST(2 * {n} AS INTEGER), '0')"
    add_w, num_w, rest_w = bytes_needed("off_add"), bytes_needed("off_num"), bytes_needed("rest_num")
    has_off, has_rest = "off_pos IS NOT NULL", "rest_pos IS NOT NULL"
    mark = f"CASE WHEN {has_off} THEN 128 + 32 * ({num_w} - 1) + 8 * ({add_w} - 1) ELSE 0 END + CASE WHEN {has_rest} THEN 4 + {rest_w} - 1 ELSE 0 END"
    return f"""{candidates(table, key, shape, max_add, least)},
{turns},
options AS MATERIALIZED (
  SELECT text_id, turn, row_number() OVER (PARTITION BY text_id, name ORDER BY cov DESC, add DESC, src_lo) AS place,
         list_transform(range(src_lo, src_hi), lambda r: CAST(r AS BIGINT)) AS source, CAST(string_split(covered, ',') AS BIGINT[]) AS drops
  FROM candidates JOIN turns USING (text_id, name)
),
walk AS (
  SELECT text_id, CAST(0 AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS place, CAST([] AS BIGINT[]) AS removed, CAST([] AS BIGINT[]) AS reads FROM options GROUP BY text_id
  UNION ALL
  SELECT w.text_id, w.turn + 1, b.place, list_concat(w.removed, coalesce(b.drops, CAST([] AS BIGINT[]))), list_concat(w.reads, coalesce(b.source, CAST([] AS BIGINT[])))
  FROM walk w JOIN (
    SELECT v.text_id, v.turn, min(o.place) FILTER (NOT list_has_any(o.source, v.removed) AND NOT list_has_any(o.drops, v.removed) AND NOT list_has_any(o.drops, v.reads)) AS best
    FROM walk v JOIN options o ON o.text_id = v.text_id AND o.turn = v.turn + 1 GROUP BY ALL
  ) d ON d.text_id = w.text_id AND d.turn = w.turn
  LEFT JOIN options b ON b.text_id = w.text_id AND b.turn = w.turn + 1 AND b.place = d.best
),
chosen AS MATERIALIZED (
  SELECT c.* FROM (SELECT *, row_number() OVER (PARTITION BY text_id, name ORDER BY cov DESC, add DESC, src_lo) AS place FROM candidates) c
  JOIN turns t USING (text_id, name)
  JOIN walk w ON w.text_id = c.text_id AND w.turn = t.turn AND w.place = c.place
),
gone AS (SELECT text_id, CAST(unnest(string_split(covered, ',')) AS INTEGER) AS rank, true AS gone FROM chosen),
ranks AS MATERIALIZED (
  SELECT text_id, rank, name, orig AS pos, lexpos, lcp, gone IS NULL AS kept, CASE WHEN gone IS NULL THEN CAST(count(*) FILTER (gone IS NULL) OVER (PARTITION BY text_id ORDER BY rank) - 1 AS INTEGER) END AS c_idx
  FROM gsa LEFT JOIN gone USING (text_id, rank)
),
h_table AS MATERIALIZED (
  SELECT i.text_id, i.name, s.c_idx AS off_pos, c.add AS off_add, c.cov AS off_num, rest_pos, rest_num
  FROM intervals i LEFT JOIN chosen c USING (text_id, name) LEFT JOIN ranks s ON s.text_id = c.text_id AND s.rank = c.src_lo
  LEFT JOIN (SELECT text_id, name, min(c_idx) AS rest_pos, CAST(count(*) AS INTEGER) AS rest_num FROM ranks WHERE kept GROUP BY ALL) r ON r.text_id = i.text_id AND r.name = i.name
),
widths AS MATERIALIZED (SELECT text_id, CAST({bytes_needed("greatest(max(pos), count(*) - 1)")} AS INTEGER) AS pb, count(*) AS c_count FROM ranks WHERE kept GROUP BY text_id),
entries AS MATERIALIZED (
  SELECT text_id, name, {number(mark, 1)}
         || CASE WHEN {has_off} THEN {number("off_pos", "pb")} || {number("off_add", add_w)} || {number("off_num", num_w)} ELSE '' END
         || CASE WHEN {has_rest} THEN {number("rest_pos", "pb")} || {number("rest_num", rest_w)} ELSE '' END AS entry
  FROM h_table JOIN widths USING (text_id)
)"""


def elias_fano_bytes(n: str, universe: str) -> str:
    return f"CAST(({n} * (2 + greatest(CAST(floor(log2(CAST({universe} AS DOUBLE) / {n})) AS BIGINT), 0)) + 7) // 8 AS BIGINT)"


#: Of steps ``entries``, ``widths`` and ``ranks``.
SIZES = f"""
WITH h AS (SELECT text_id, count(*) AS names, CAST(sum(length(entry) // 2) AS BIGINT) AS bytes_h, max(name) AS last FROM entries GROUP BY text_id),
m AS (SELECT text_id, count(*) AS m FROM ranks GROUP BY text_id),
parts AS (SELECT text_id, m, c_count, names, pb, c_count * pb AS bytes_c, bytes_h, {elias_fano_bytes("names", "bytes_h")} AS bytes_starts, {elias_fano_bytes("names", "(last + 1)")} AS bytes_names FROM h JOIN m USING (text_id) JOIN widths USING (text_id)),
whole AS (SELECT *, bytes_c + bytes_h + bytes_starts + bytes_names AS bytes_total, m * pb AS bytes_full FROM parts)
SELECT *, CAST(100 AS DOUBLE) * c_count / m AS keep_pct, CAST(100 AS DOUBLE) * bytes_total / bytes_full AS size_pct FROM whole"""

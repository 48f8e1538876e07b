"""SQL for the conversation queries: the hash that DuckDB lacks, the trie by list prefixes, the repair as a fold over turns."""

from __future__ import annotations

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def crc32(text: str) -> str:
    """The CRC-32 of an ASCII string, bit by bit; the constant is the polynomial's, a fixed value."""
    return f"CAST(xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda c, b: list_reduce([xor(c, b)] || range(8), lambda y, _: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) AS BIGINT)"


TRIE = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, c - c % 5 AS b, {crc32('CAST(c AS VARCHAR)')} % 9 AS h, list([r, x] ORDER BY i) AS l FROM t GROUP BY 1),
w AS (SELECT k.c, CASE WHEN k.b = k.c THEN k.l ELSE coalesce(q.l, [])[1:k.h] || k.l[k.h + 1:] END AS l FROM k LEFT JOIN k q ON q.c = k.b),
m AS (SELECT c, len(l) AS n, d, l[1:d] AS p FROM (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM w)),
v AS MATERIALIZED (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '') AS e, CASE WHEN d > 0 THEN (count(*) - 1) * strlen(p[d][2]) ELSE 0 END AS own FROM m GROUP BY 1, 2),
ch AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n FROM v WHERE d > 0 GROUP BY 1, 2),
lf AS MATERIALIZED (SELECT v.*, coalesce(ch.n, 0) AS n_children FROM v LEFT JOIN ch USING (d, p)),
su AS (SELECT a AS d, p[1:a] AS p, sum(own) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM (SELECT *, unnest(range(d + 1)) AS a FROM lf) GROUP BY 1, 2)
SELECT lf.conv_id, CAST(lf.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, lf.n_convs, CAST(lf.n_children AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(lf.e) AS ends_sha256
FROM lf JOIN su USING (d, p) LEFT JOIN v up ON up.d = lf.d - 1 AND up.p = lf.p[1:lf.d - 1]"""

# Of every state of the grammar (1 start, 2 after a system turn, 3 after a user's, 4 after an assistant's) the fold keeps one
# string: nine digits of cost, the audit, a sign below all letters, and the repaired turns. The least string is the cheapest
# way with the least audit.
FAR = "'900000000' || chr(1)"
DUE = {1: ("u", 3, "user"), 2: ("u", 3, "user"), 3: ("a", 4, "assistant"), 4: ("u", 3, "user")}


def _edit(state: str, initial: str, cost: str, turn: str) -> str:
    return f"lpad(CAST(CAST(left({state}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || '{initial}' || {state}[10:instr({state}, chr(1)) - 1] || chr(1) || {turn} || {state}[instr({state}, chr(1)) + 1:]"


def _taken(s: int) -> str:
    """The least way on from state s that takes the turn ``el``; ``acc`` holds the ways on behind it."""
    due, to, who = DUE[s]
    may, more, kept = "el.f IN ('k', 't')", "CASE WHEN el.f = 't' THEN 5 ELSE 0 END", "chr(10) || el.r || ':' || el.x"
    ways = [_edit(f"acc.s[{s}]", "D", "2", "''"), f"CASE WHEN {may} AND el.z = '{due}' THEN {_edit(f'acc.s[{to}]', 'K', more, kept)} ELSE {FAR} END"]
    if s == 1:
        ways.append(f"CASE WHEN {may} AND el.z = 's' THEN {_edit('acc.s[2]', 'K', more, kept)} ELSE {FAR} END")
    reroled = f"chr(10) || '{who}:' || el.x"
    ways.append(f"CASE WHEN {may} THEN {_edit(f'acc.s[{to}]', 'R', '1 + ' + more, reroled)} ELSE {FAR} END")
    return f"least({', '.join(ways)})"


def _inserted(states: str) -> str:
    """The same states where turns may be inserted before."""
    put = lambda state, who: _edit(state, "I", "5", f"chr(10) || '{who}:'")
    two = f"list_transform([{states}], lambda w: [w[1], w[2], least(w[3], {put('w[4]', 'assistant')}), least(w[4], {put('w[3]', 'user')})])"
    return f"list_transform({two}, lambda w: [least(w[1], {put('w[3]', 'user')}), least(w[2], {put('w[3]', 'user')}), w[3], w[4]])[1]"


_END = _inserted(f"['000000000' || chr(1), {FAR}, {FAR}, '000000000' || chr(1)]")
_FOLD = _inserted("[" + ", ".join(map(_taken, DUE)) + "]")

REPAIR = f"""
WITH o AS (SELECT conv_id AS c, turn AS t, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x, {crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS h FROM conversations),
d AS (SELECT c, t, CASE WHEN h = 4 THEN 'user' ELSE r END AS r, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(x, '.!?', '') ELSE x END AS x, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS q FROM o WHERE h <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY t NULLS FIRST, left(sha256(r || chr(0) || x), 32), q) AS i, rtrim(ltrim(x, {BLANKS}), {BLANKS}) AS b FROM d),
f AS (SELECT *, CASE WHEN b = '' THEN 'b' WHEN row_number() OVER (PARTITION BY c, r, x ORDER BY i) > 1 THEN 'd' WHEN right(b, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS f, left(r, 1) AS z, left(lag(r) OVER (PARTITION BY c ORDER BY i), 1) AS y FROM n),
g AS (SELECT c, CAST(coalesce(max(t) - min(t) + 1 - count(DISTINCT t), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE f = 'b') AS blank, count(*) FILTER (WHERE f = 'd') AS duplicate, count(*) FILTER (WHERE f = 't') AS truncated, count(*) FILTER (WHERE i > 1 AND y || z NOT IN ('su', 'ua', 'au')) AS illegal,
  list({{'f': f, 'z': z, 'r': r, 'x': x}} ORDER BY i DESC) AS l FROM f GROUP BY 1),
e AS (SELECT {_END} AS s),
p AS (SELECT g.*, list_reduce([{{'f': '', 'z': '', 'r': '', 'x': '', 's': e.s}}] || list_transform(l, lambda k: {{'f': k.f, 'z': k.z, 'r': k.r, 'x': k.x, 's': CAST(NULL AS VARCHAR[])}}), lambda acc, el: {{'f': '', 'z': '', 'r': '', 'x': '', 's': {_FOLD}}}).s[1] AS s FROM g, e)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(CAST(left(s, 9) AS BIGINT), 0) AS BIGINT) AS cost,
  coalesce(s[10:instr(s, chr(1)) - 1], '') AS audit, sha256(coalesce(s[instr(s, chr(1)) + 2:], '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN p ON a.conv_id IS NOT DISTINCT FROM p.c"""

"""SQL of queries whose twins are long: the repair of conversations and the ranked search."""

from __future__ import annotations

_BLANK = r"\x20\x09-\x0D"


def repair_sql() -> str:
    """The same repair as a table of least (cost, audit) per row and state, filled in order.

    States: 1 nothing yet, 2 a system turn, 3 a user turn, 4 an assistant turn. The checksum of the
    damage is reckoned byte by byte with its table of 256 remainders.
    """
    def plus(state: str, cost: str, edit: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}'}}"

    def least(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    none = "{'c': 1000000000, 'a': ''}"
    # one row: delete, keep where the initial fits, rerole to the role that is wanted
    own = {"u": "CASE WHEN code IN ('u', 'U') THEN 0 ELSE 1 END", "a": "CASE WHEN code IN ('a', 'A') THEN 0 ELSE 1 END"}

    def stay(state: str, role: str) -> str:
        cost = f"({own[role]} + extra)"
        kept = f"CASE WHEN lower(code) = '{role}' THEN 'K' ELSE 'R' END"
        return f"CASE WHEN code = 'x' THEN {none} ELSE {{'c': {state}.c + {cost}, 'a': {state}.a || {kept}}} END"

    rows = [
        plus("s[1]", "2", "D"),
        least(plus("s[2]", "2", "D"), f"CASE WHEN lower(code) = 's' THEN {plus('s[1]', 'extra', 'K')} ELSE {none} END"),
        least(plus("s[3]", "2", "D"), stay("s[1]", "u"), stay("s[2]", "u"), stay("s[4]", "u")),
        least(plus("s[4]", "2", "D"), stay("s[3]", "a")),
    ]
    inserts = [
        "n[1]", "n[2]",
        least("n[3]", plus("n[1]", "5", "I"), plus("n[2]", "5", "I"), plus("n[4]", "5", "I")),
        least("n[4]", plus("n[3]", "5", "I"), plus("n[1]", "10", "II"), plus("n[2]", "10", "II")),
    ]
    return rf"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(
    list_concat([i::UBIGINT], list_transform(range(8), lambda z: z::UBIGINT)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
summed AS (SELECT keyed.*, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(k, ''), lambda x: ascii(x)::UBIGINT)),
    lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 20 AS kind FROM keyed, tab),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM summed WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER w AS place, lag(left(role, 1)) OVER w || left(role, 1) AS pair,
    regexp_extract(text, '([^{_BLANK}])[{_BLANK}]*$', 1) AS last
    FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
faults AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(last, '[.!?]') THEN 'truncated' ELSE 'none' END AS fault FROM placed),
coded AS MATERIALIZED (SELECT *, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra,
    CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN left(role, 1) IN ('u', 'a', 's') THEN left(role, 1) ELSE 'o' END AS code FROM faults),
best(conv_id, place, s) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, [{{'c': 0, 'a': ''}}, {none}, {{'c': 5, 'a': 'I'}}, {{'c': 10, 'a': 'II'}}] FROM conversations
  UNION ALL
  SELECT conv_id, place, [{', '.join(inserts)}] FROM (
    SELECT b.conv_id, c.place, [{', '.join(rows)}] AS n FROM best b JOIN coded c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.place = b.place + 1)),
ends AS MATERIALIZED (SELECT conv_id, {least('s[1]', 's[4]')} AS e FROM best QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) = 1),
pieces AS (SELECT conv_id, e.a AS audit, unnest(regexp_extract_all(e.a, 'I*[DKR]|I+$')) AS piece, generate_subscripts(regexp_extract_all(e.a, 'I*[DKR]|I+$'), 1) AS place FROM ends),
outputs AS (SELECT *, length(regexp_replace(piece, 'D$', '')) AS n, length(replace(audit, 'D', '')) % 2 AS shift FROM pieces),
starts AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY place) - n AS start FROM outputs),
lines AS (SELECT x.conv_id, x.place, list_transform(range(x.n), lambda i: CASE WHEN i = x.n - 1 AND right(piece, 1) = 'K' THEN c.role || ':' || c.text
      ELSE CASE WHEN (x.start::BIGINT + i - shift) % 2 = 0 THEN 'user:' ELSE 'assistant:' END || CASE WHEN i = x.n - 1 AND right(piece, 1) = 'R' THEN c.text ELSE '' END END) AS l
  FROM starts x LEFT JOIN coded c ON c.conv_id IS NOT DISTINCT FROM x.conv_id AND c.place = x.place),
texts AS (SELECT conv_id, sha256(coalesce(array_to_string(flatten(list(l ORDER BY place)), chr(10)), '')) AS repaired_sha256 FROM lines GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM coded GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, e.e.c::BIGINT AS cost, e.e.a AS audit,
  coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM e.conv_id"""


def search_sql() -> str:
    """Every document scored for every item, the best ten kept."""
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

    def terms(text: str) -> str:
        return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}')"

    return f"""
WITH asked AS MATERIALIZED (SELECT item_id, term, count(*) AS asked FROM (SELECT item_id, unnest({terms('text')}) AS term FROM benchmark) GROUP BY ALL),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {terms('text')} AS w FROM documents),
sizes AS MATERIALIZED (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, sum(len(w)) AS n_terms FROM docs),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, sizes GROUP BY term),
m AS MATERIALIZED (SELECT r, doc_id, (100 - 75 + (75 * len(w) * n_docs) // n_terms)::BIGINT AS m FROM docs, sizes WHERE len(w) > 0),
s AS (SELECT item_id, doc_id, r, sum(asked * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) <= 10"""

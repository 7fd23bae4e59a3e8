"""DuckDB SQL for the queries of plans.queries, written apart from their plans."""

from __future__ import annotations

from ..operators.body import BODY_START
from ..operators.scoring import MARKERS
from ..operators.segment import ANY_CASE, EXACT_CASE
from .corpus import DUCK_BOXES, DUCK_ISSUES

_NAME = r"GAZET(?:TE|E)\s+NOTICE[.]?\s+NO[.]?\s*"
_STRICT, _NOISY = rf"^{_NAME}(\d+)\s*$", rf"(?:^|[\s|])\s*{_NAME}(\d+)[\s|]"
_TRAILER = r"(?i)SUBSCRIPTION\s+(?:(?:AND\s+)?ADVERTISEMENT\s+)?CHARGES|IMPORTANT\s+NOTICE\s+TO\s+SUBSCRIBERS|Government\s+Printer[.]?\s*$|^(?:CONTENTS|INDEX)\s*$|CLASSIFIED\s+AD(?:S|VERTISEMENT)"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _round(x: str, digits: int = 3) -> str:
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


def _clip(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def _clean(x: str) -> str:
    return rf"""coalesce(list_contains(['.', '!', '?', '"', '''', ')', ']'], right(regexp_replace({x}, '\s+$', ''), 1)), false)"""


def _furniture(x: str) -> str:
    return rf"(regexp_matches({x}, '^\s*(?:{EXACT_CASE})\s*$') OR regexp_matches({x}, '(?i)^\s*(?:{ANY_CASE})\s*$'))"


def _lines(x: str) -> str:
    return rf"list_filter(string_split({x}, chr(10)), lambda v: regexp_matches(v, '\S'))"


def _minus(*terms: tuple[str, str]) -> str:
    return " + ".join(f"CASE WHEN {when} THEN -({amount})::DOUBLE ELSE 0.0::DOUBLE END" for when, amount in terms)


# From texts to stitched and trimmed notices: as in segment.py, by joins and windows over lines.
LINES = f"""
issues AS ({DUCK_ISSUES}),
arrays AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM issues),
lines AS (SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS line, len(a) AS n FROM arrays),
strict AS (
  SELECT doc_id, line_no, regexp_extract(trim(line), '{_STRICT}', 1) AS no, 'strict' AS kind, trim(line) AS header, n
  FROM lines WHERE regexp_matches(trim(line), '{_STRICT}')
),
gaps AS (SELECT doc_id, line_no AS a, lead(line_no, 1, n) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM strict),
recovered AS (
  SELECT l.doc_id, l.line_no, regexp_extract(line, '{_NOISY}', 1) AS no, 'recovered' AS kind,
    'GAZETTE NOTICE NO. ' || regexp_extract(line, '{_NOISY}', 1) AS header, n
  FROM lines AS l JOIN gaps AS g ON g.doc_id = l.doc_id AND l.line_no > g.a AND l.line_no < g.b AND g.b - g.a > 40
  WHERE regexp_matches(line, '{_NOISY}')
),
bare AS (
  SELECT doc_id, 0 AS line_no, NULL AS no, 'none' AS kind, NULL AS header, len(a) AS n FROM arrays WHERE doc_id NOT IN (SELECT doc_id FROM strict)
),
bounds AS (
  SELECT *, lead(line_no, 1, n) OVER (PARTITION BY doc_id ORDER BY line_no) AS line_end,
    row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS notice_idx
  FROM (SELECT * FROM strict UNION ALL SELECT * FROM recovered UNION ALL SELECT * FROM bare)
)"""

NOTICES = rf"""{LINES},
owned AS (
  SELECT l.doc_id, l.line_no, l.line, b.line_no AS start, b.kind FROM lines AS l ASOF JOIN bounds AS b ON l.doc_id = b.doc_id AND l.line_no >= b.line_no
),
body AS (
  SELECT *, kind <> 'none' AND {_furniture("line")} AS running FROM owned WHERE NOT (kind = 'strict' AND line_no = start)
),
texts AS (
  SELECT doc_id, start, coalesce({_strip("string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT running)")}, '') AS txt,
    count(*) FILTER (NOT running) AS lines_in_body FROM body GROUP BY doc_id, start
),
pieces AS (
  SELECT b.doc_id, notice_idx, no, kind, header, b.line_no AS line_start, line_end, coalesce(lines_in_body, 0) AS lines_in_body,
    CASE WHEN header IS NULL THEN txt WHEN coalesce(txt, '') = '' THEN header ELSE header || chr(10) || txt END AS full_text
  FROM bounds AS b LEFT JOIN texts AS t ON t.doc_id = b.doc_id AND t.start = b.line_no
),
marked AS (
  SELECT *, CASE WHEN kind = 'recovered' AND NOT coalesce(lag({_clean("full_text")}) OVER w, true) THEN 0 ELSE 1 END AS fresh
  FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY notice_idx)
),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY notice_idx) AS island FROM marked),
stitched AS (
  SELECT doc_id, island, first(no ORDER BY notice_idx) AS no, first(kind ORDER BY notice_idx) AS kind, first(header ORDER BY notice_idx) AS header,
    min(line_start) AS line_start, first(line_end ORDER BY notice_idx) AS line_end, max(line_end) AS end_line,
    string_agg(full_text, chr(10) ORDER BY notice_idx) AS full_text, list(no ORDER BY notice_idx)[2:] AS stitched_from
  FROM islands GROUP BY doc_id, island
),
placed AS (
  SELECT *, row_number() OVER w - 1 AS notice_idx, lead(line_start) OVER w AS next_start FROM stitched WINDOW w AS (PARTITION BY doc_id ORDER BY island)
),
cuts AS (
  SELECT o.doc_id, o.start, min(o.line_no) AS cut FROM owned AS o JOIN placed AS p ON p.doc_id = o.doc_id AND p.line_start = o.start
  WHERE p.next_start IS NULL AND p.kind <> 'none'
    AND (o.line_no - o.start >= 20 AND regexp_matches(trim(o.line), '{_TRAILER}') OR o.line_no - o.start >= 10 AND regexp_matches(trim(o.line), '(?i)^\s*NOW\s+ON\s+SALE\b'))
  GROUP BY o.doc_id, o.start
),
trimmed AS (
  SELECT b.doc_id, b.start, cut, {_strip("string_agg(line, chr(10) ORDER BY line_no)")} AS txt
  FROM body AS b JOIN cuts AS c ON c.doc_id = b.doc_id AND c.start = b.start AND b.line_no < c.cut WHERE NOT running GROUP BY ALL
),
notices AS (
  SELECT p.doc_id, p.notice_idx, no, kind, header, line_start, coalesce(t.cut, line_end) AS line_end, coalesce(t.cut, end_line) AS end_line, stitched_from,
    CASE WHEN t.cut IS NULL THEN full_text WHEN t.txt = '' THEN header ELSE header || chr(10) || t.txt END AS full_text,
    lead(line_start) OVER (PARTITION BY p.doc_id ORDER BY p.notice_idx) AS next_start
  FROM placed AS p LEFT JOIN trimmed AS t ON t.doc_id = p.doc_id AND t.start = p.line_start
)"""

_N = "coalesce(no, '')"
NUMBER = f"""CASE WHEN {_N} = '' THEN 0.0 WHEN regexp_full_match({_N}, '[0-9]{{2,6}}') THEN 1.0 WHEN regexp_full_match({_N}, '[0-9]+/[0-9]{{4}}') THEN 0.6
  WHEN regexp_full_match({_N}, '[0-9]+[A-Za-z]') THEN 0.5 WHEN regexp_full_match({_N}, '[0-9]{{7,}}') THEN 0.4 WHEN regexp_full_match({_N}, '[0-9]') THEN 0.3
  WHEN regexp_full_match({_N}, '[^0-9]+') THEN 0.1 ELSE 0.3 END::DOUBLE"""


_MARKED = " OR ".join(f"contains(lower(t), '{m}')" for m in MARKERS)
_DATE = r"regexp_matches(t, '(?i)\bDated\s+the\s+[0-9]{1,2}(?:st|[nr]d|th)?\s+\w+[,]?\s+[0-9]{4}')"
_SIGNED = r"regexp_matches(t, '(?m)^\s*[A-Z][-A-Z .,'']{4,}\s*[,]?\s*$')"
_SIGNALS = f"(({_MARKED})::INT + {_DATE}::INT + {_SIGNED}::INT)"


def structure(titled: str, table: str) -> str:
    """Needs columns t (text) and lns (its lines that aren't blank)."""
    terms = _minus(
        ("length(t) < 50", "0.6"), ("length(t) >= 50 AND length(t) < 120", "0.2"), ("length(t) > 100000", "0.3"), ("len(lns) <= 2", "0.4"),
        (f"{_SIGNALS} = 0 AND NOT {table}", "0.3"), (f"{_SIGNALS} = 1 AND NOT {table}", "0.1"), (f"NOT {titled}", "0.05"),
    )
    return _clip(f"1.0::DOUBLE + {terms}")


_TAIL = r"right(regexp_replace(lns[i], '\s+$', ''), 1)"
BREAKS = rf"""CASE WHEN len(lns) < 2 THEN 0 ELSE len(list_filter(range(1, len(lns)), lambda i:
  NOT list_contains(['.', '!', '?', '"', '''', ')', ']', ',', ';', ':', '-'], {_TAIL}) AND regexp_matches({_strip("lns[i + 1]")}, '^\p{{Ll}}'))) END"""
WORDS = r"regexp_extract_all(lower(t), '[\p{L}\p{N}_]+')"
REPEATS = "len(list_filter(map_values(list_aggregate(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i : i + 5], ' ')), 'histogram')), lambda c: c > 1))"
CAPITALS = r"len(list_filter(range(1, len(tok)), lambda i: regexp_matches(tok[i], '[a-z]{3}$') AND regexp_matches(tok[i + 1], '^[A-Z][a-z]{3}')))"
TOKENS = r"string_split_regex(t, '\s+')"


def measured(rows: str) -> str:
    """CTEs that end in spatials: rows (with t) and lns, breaks, repeats, caps, words and spatial."""
    many = "len(lns) >= 2"
    density = "(caps / greatest(1, words))"
    terms = _minus(
        ("breaks >= 3", "least(0.5::DOUBLE, breaks * 0.1::DOUBLE)"),
        ("repeats >= 3", "least(0.3::DOUBLE, repeats * 0.05::DOUBLE)"),
        (f"{density} > 0.10::DOUBLE AND caps > 20", f"least(0.15::DOUBLE, {density} * 0.5::DOUBLE)"),
    )
    return f"""
split AS (SELECT *, {_lines("t")} AS lns, {WORDS} AS w, {TOKENS} AS tok FROM ({rows})),
counted AS (
  SELECT *, {BREAKS} AS breaks, len(w) AS words, CASE WHEN {many} AND len(w) > 50 THEN {REPEATS} ELSE 0 END AS repeats,
    CASE WHEN {many} AND len(w) > 100 THEN {CAPITALS} ELSE 0 END AS caps FROM split
),
spatials AS (SELECT *, CASE WHEN t = '' THEN 0.0::DOUBLE ELSE {_round(_clip(f"1.0::DOUBLE + {terms}"))} END AS spatial FROM counted)"""


_CAP = "CASE kind WHEN 'strict' THEN 1.0 WHEN 'recovered' THEN 0.6 WHEN 'inferred' THEN 0.4 ELSE 0.2 END::DOUBLE"
BOUNDARY = _round(
    _clip(
        f"{_CAP} + "
        + _minus(
            ("line_end - line_start <= 1", "0.4"), ("line_end - line_start > 1 AND line_end - line_start < 3", "0.2"), (f"NOT {_clean('full_text')}", "0.15"),
            ("coalesce(next_start - line_end > 20, false)", "0.2"),
        )
    )
)

_START = BODY_START.replace("(?Ui)", "(?i)")


def chunked(lines: str, key: str, prefix: str = "") -> str:
    """CTEs on the lines (key, i, line) of chunks: titles, what follows them, segments, rows of serial tables.

    key: columns that tell a chunk. Segments of a chunk are those of its lines
    behind the titles, or of all if titles are all there is.
    """
    p, on = prefix, ", ".join(key.split())
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in key.split())
    two = r"\s*([0-9]+)\s+([0-9]+)[.]?\s*"
    part = lambda c, n: rf"CASE WHEN regexp_matches({c}, '\S\s{{2,}}\S') THEN regexp_extract({c}, '^(.*?\S)\s{{2,}}(\S.*)$', {n}) ELSE {f'{c}' if n == 1 else repr('')} END"
    return rf"""
{p}coded AS (
  SELECT {on}, i, line, {_strip("line")} AS s, CASE WHEN NOT regexp_matches(line, '\S') THEN 0 WHEN regexp_matches({_strip("line")}, '{_START}') THEN 2 ELSE 1 END AS code FROM {lines}
),
{p}heads AS (SELECT {on}, min(i) AS f, arg_min(code, i) AS code FROM {p}coded WHERE code <> 0 GROUP BY {on}),
{p}stops AS (
  SELECT {", ".join("h." + k for k in key.split())}, f, h.code, min(c.i) FILTER (c.i > f AND c.code <> 1) AS z, arg_min(c.code, c.i) FILTER (c.i > f AND c.code <> 1) AS stop_code, max(c.i) AS last
  FROM {p}heads AS h JOIN {p}coded AS c ON {same("h", "c")} GROUP BY ALL
),
{p}titles AS (
  SELECT {", ".join("c." + k for k in key.split())}, string_agg(s, '|' ORDER BY i) AS titles, list(s ORDER BY i) AS title_list FROM {p}coded AS c JOIN {p}stops AS t ON {same("c", "t")}
  WHERE t.code <> 2 AND i >= f AND (z IS NULL OR i < z) GROUP BY ALL
),
{p}rests AS (
  SELECT {", ".join("c." + k for k in key.split())}, row_number() OVER (PARTITION BY {", ".join("c." + k for k in key.split())} ORDER BY i) AS q, line, code = 0 AS blank,
    len(list_filter(string_split_regex(s, ' {{2,}}'), lambda v: v <> '')) >= 2 AS wide,
    NOT regexp_matches(s, '^[A-Z][a-z]') OR regexp_matches(s, '(?i)^S[.]?\s*/?\s*No[.]?') AS opens, length(line) < 100 AS short
  FROM (
    SELECT c.*, CASE WHEN f IS NULL THEN 0 WHEN t.code = 2 THEN f WHEN z IS NULL THEN 0 WHEN stop_code <> 0 THEN z WHEN z < last THEN z + 1 ELSE 0 END AS since
    FROM {p}coded AS c LEFT JOIN {p}stops AS t ON {same("c", "t")}
  ) AS c WHERE i >= since
),
{p}folded AS ({_fold(f"{p}rests", key, f"{p}folded")}),
{p}segments AS ({_closed(f"{p}folded", key)}),
{p}tops AS (SELECT {on}, min(i) AS top FROM {p}coded WHERE regexp_matches(s, '(?i)^S/No[.]?\s+Name') GROUP BY {on}),
{p}cells AS (
  SELECT {", ".join("c." + k for k in key.split())}, (c.i - top - 2) // 3 AS k, max(c.s) FILTER ((c.i - top - 2) % 3 = 0) AS serial, max(c.s) FILTER ((c.i - top - 2) % 3 = 1) AS name,
    max(c.s) FILTER ((c.i - top - 2) % 3 = 2) AS position
  FROM {p}coded AS c JOIN {p}tops AS t ON {same("c", "t")} JOIN {p}coded AS n ON {same("n", "t")} AND n.i = top + 1 AND lower(n.s) = 'position' WHERE c.i >= top + 2 GROUP BY ALL
),
{p}judged AS (
  SELECT *, (regexp_full_match(serial, '[0-9]+[.]?') OR regexp_full_match(serial, '{two}')) AND name IS NOT NULL AS ok, coalesce(lower(position) LIKE 'as %' AND length(position) > 80, false) AS runs_on
  FROM {p}cells
),
{p}sound AS (
  SELECT * FROM (
    SELECT *, bool_and(coalesce(ok, false)) OVER (PARTITION BY {on} ORDER BY k) AS fine,
      coalesce(bool_or(runs_on) OVER (PARTITION BY {on} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over
    FROM {p}judged
  ) WHERE fine AND NOT over
),
{p}paired AS (
  SELECT {on}, k, rtrim(serial, '.') AS serial, name, CASE WHEN runs_on THEN '' ELSE coalesce(position, '') END AS position,
    try_cast(regexp_extract(serial, '^{two}$', 1) AS BIGINT) AS one, try_cast(regexp_extract(serial, '^{two}$', 2) AS BIGINT) AS two
  FROM {p}sound
),
{p}serials AS (
  SELECT {on}, k, 0 AS half, serial AS s_no, name, position, NULL AS repair FROM {p}paired WHERE coalesce(two - one <> 1, true)
  UNION ALL SELECT {on}, k, 0, CAST(one AS VARCHAR), {part("name", 1)}, {part("position", 1)}, 'split merged row ' || one || '/' || two FROM {p}paired WHERE two - one = 1
  UNION ALL SELECT {on}, k, 1, CAST(two AS VARCHAR), {part("name", 2)}, {part("position", 2)}, NULL FROM {p}paired WHERE two - one = 1
),
{p}stepped AS (
  SELECT *, coalesce(lead(no IGNORE NULLS) OVER (PARTITION BY {on} ORDER BY k, half) - no <> 1, false) AS jump, avg(size) OVER (PARTITION BY {on}) * 3 AS fence
  FROM (SELECT *, try_cast(s_no AS BIGINT) AS no, CASE WHEN name <> '' THEN length({_strip("name")}) END AS size FROM {p}serials)
),
{p}tables AS (
  SELECT {on}, string_agg(s_no || ',' || name || ',' || position, ';' ORDER BY k, half) AS rows, count(repair) AS repairs, count(*) AS n, count(*) FILTER (jump) AS jumps,
    count(size) > 0 AND count(*) FILTER (size > fence) >= greatest(1, count(*) // 10) AS odd
  FROM {p}stepped GROUP BY {on}
)"""


def _fold(rests: str, key: str, name: str) -> str:
    """Segments of lines (key, q, line, blank, wide, opens, short): one line after the other, the kind and number of lines so far."""
    cols = ", ".join(key.split())
    fresh = "CASE WHEN x.blank THEN '' WHEN x.wide AND x.opens THEN 'table' ELSE 'text' END"
    return f"""
  SELECT {cols}, q, line, blank, {fresh.replace("x.", "")} AS kind, CASE WHEN blank THEN 0 ELSE 1 END AS size, 0 AS seg FROM {rests} WHERE q = 1
  UNION ALL
  SELECT {cols}, q, line, blank, CASE WHEN grows THEN 'table' WHEN flows THEN 'text' ELSE fresh END, CASE WHEN blank THEN 0 WHEN grows OR flows THEN size + 1 ELSE 1 END, seg + (NOT (grows OR flows))::INT
  FROM (
    SELECT {", ".join("x." + k for k in key.split())}, x.q, x.line, x.blank, w.size, w.seg, {fresh} AS fresh, NOT x.blank AND w.kind = 'table' AND (x.wide OR x.short) AS grows,
      NOT x.blank AND NOT x.wide AND (w.kind = 'table' AND w.size = 1 AND NOT x.short OR w.kind = 'text') AS flows
    FROM {name} AS w JOIN {rests} AS x ON {" AND ".join(f"x.{k} = w.{k}" for k in key.split())} AND x.q = w.q + 1
  )"""


def _closed(folded: str, key: str) -> str:
    cols = ", ".join(key.split())
    return f"""SELECT {cols}, seg, CASE WHEN bool_or(blank) THEN 'blank' WHEN arg_max(kind, q) = 'table' AND max(size) >= 2 THEN 'table' ELSE 'text' END AS type,
    CASE WHEN bool_or(blank) THEN '' ELSE string_agg(line, chr(10) ORDER BY q) END AS lines FROM {folded} GROUP BY {cols}, seg"""


_CHUNKS = "chunks AS (SELECT doc_id, start, row_number() OVER (PARTITION BY doc_id, start ORDER BY line_no) - 1 AS i, line FROM body WHERE NOT running AND kind <> 'none')"
#: Those of pieces before they are stitched.
PIECES = f"{NOTICES},\n{_CHUNKS},{chunked('chunks', 'doc_id start')}"
#: With the segments of notices: those of their pieces, one after the other, or of what trimming left of a piece.
_LEFT = rf"""
lefts AS (
  SELECT b.doc_id, b.start, row_number() OVER (PARTITION BY b.doc_id, b.start ORDER BY b.line_no) AS q, line, NOT regexp_matches(line, '\S') AS blank,
    len(list_filter(string_split_regex({_strip("line")}, ' {{2,}}'), lambda v: v <> '')) >= 2 AS wide,
    NOT regexp_matches({_strip("line")}, '^[A-Z][a-z]') OR regexp_matches({_strip("line")}, '(?i)^S[.]?\s*/?\s*No[.]?') AS opens, length(line) < 100 AS short
  FROM body AS b JOIN cuts AS c ON c.doc_id = b.doc_id AND c.start = b.start AND b.line_no < c.cut WHERE NOT running
),
left_folded AS ({_fold("lefts", "doc_id start", "left_folded")}),
left_segments AS ({_closed("left_folded", "doc_id start")}),
members AS (
  SELECT m.doc_id, m.line_no AS start, s.line_start FROM (SELECT doc_id, line_no, max(CASE WHEN fresh = 1 THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) AS line_start
    FROM (SELECT doc_id, line_start AS line_no, fresh FROM islands)) AS m JOIN placed AS s ON s.doc_id = m.doc_id AND s.line_start = m.line_start
),
notice_segments AS (
  SELECT m.doc_id, m.line_start, s.start, seg, type FROM members AS m JOIN segments AS s ON s.doc_id = m.doc_id AND s.start = m.start
  WHERE (m.doc_id, m.line_start) NOT IN (SELECT doc_id, start FROM cuts)
  UNION ALL SELECT doc_id, start, start, seg, type FROM left_segments
)"""
SPLIT = f"{PIECES},{_LEFT}"


def reasons(prefix: str, *pairs: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {when} THEN '{prefix}: ' || {text} END" for when, text in pairs) + "], lambda x: x IS NOT NULL)"


_TABLE_SCORE = _clip("1.0::DOUBLE + " + _minus(("repairs > 0", "least(0.3::DOUBLE, repairs * 0.05::DOUBLE)"), ("jumps > 0", "least(0.3::DOUBLE, jumps * 0.05::DOUBLE)"), ("odd", "0.15")))


def _composite(boundary: str) -> str:
    base = _clip(f"notice_number * 0.30::DOUBLE + structure * 0.25::DOUBLE + spatial * 0.25::DOUBLE + {boundary} * 0.20::DOUBLE")
    return f"CASE WHEN table_score IS NULL THEN {base} ELSE {_clip(base + ' * 0.85::DOUBLE + table_score * 0.15::DOUBLE')} END"


_NOTICES_READ = """SELECT n.*, n.full_text AS t, x.titles IS NOT NULL AS titled, g.rows AS table_rows, g.repairs, g.jumps, g.odd, coalesce(g.rows IS NOT NULL OR y.any_table, false) AS has_table
  FROM notices AS n LEFT JOIN titles AS x ON x.doc_id = n.doc_id AND x.start = n.line_start LEFT JOIN tables AS g ON g.doc_id = n.doc_id AND g.start = n.line_start
  LEFT JOIN (SELECT doc_id, line_start, bool_or(type = 'table') AS any_table FROM notice_segments GROUP BY ALL) AS y ON y.doc_id = n.doc_id AND y.line_start = n.line_start"""
SCORED = f"""{SPLIT},
{measured(_NOTICES_READ)},
parts AS (
  SELECT *, {NUMBER} AS notice_number, {_round(structure("titled", "has_table"))} AS structure, {BOUNDARY} AS boundary, CASE WHEN table_rows IS NOT NULL THEN {_round(_TABLE_SCORE)} END AS table_score
  FROM spatials
),
scored AS (SELECT *, {_round(_composite("boundary"))} AS composite FROM parts)"""
_S = "length(t) || ' chars)'"
_DENSITY = "(caps / greatest(1, words))"
_DENSE = f"({_DENSITY} > 0.10::DOUBLE AND caps > 20)"
WHY = f"""list_concat(
  {reasons("notice_number", (f"{_N} = ''", "'empty notice number'"), (f"{_N} <> '' AND NOT regexp_full_match({_N}, '[0-9]{{2,6}}')", f"CASE WHEN regexp_full_match({_N}, '[0-9]+/[0-9]{{4}}') THEN 'notice number in year/number form' WHEN regexp_full_match({_N}, '[0-9]+[A-Za-z]') THEN 'notice number has trailing letter' WHEN regexp_full_match({_N}, '[0-9]{{7,}}') THEN 'notice number is unusually long' WHEN regexp_full_match({_N}, '[0-9]') THEN 'single-digit notice number is suspicious' WHEN regexp_full_match({_N}, '[^0-9]+') THEN 'notice number has no digits' ELSE 'notice number has unexpected shape' END"))},
  {reasons("structure", ("length(t) < 50", f"'body very short (' || {_S}"), ("length(t) >= 50 AND length(t) < 120", f"'body short (' || {_S}"), ("length(t) > 100000", f"'body very long (' || {_S} || ' -- possible merge'"), ("len(lns) <= 2", "'only header/no body content'"), (f"{_SIGNALS} = 0 AND NOT has_table", "'no legal marker, date, or signature found'"), (f"{_SIGNALS} = 1 AND NOT has_table", "'only one structural marker present'"), ("NOT titled", "'no title lines extracted'"))},
  {reasons("spatial", ("t = ''", "'empty text'"), ("breaks >= 3", "breaks || ' mid-sentence breaks (possible column interleaving)'"), ("repeats >= 3", "repeats || ' repeated 6-grams (possible column merge)'"), (_DENSE, f"'high mid-sentence cap density ' || printf('%.2f', {_DENSITY}) || ' (' || caps || '/' || words || ' words)'"))},
  {reasons("boundary", ("kind <> 'strict'", "CASE kind WHEN 'recovered' THEN 'header recovered from noisy line (capped at 0.6)' WHEN 'inferred' THEN 'header inferred (capped at 0.4)' ELSE 'no notice header found' END"), ("line_end - line_start <= 1", "'span is a single line'"), ("line_end - line_start = 2", "'span is very short'"), (f"NOT {_clean('full_text')}", "'text does not end with terminal punctuation'"), ("next_start - line_end > 20", "'gap of ' || (next_start - line_end) || ' lines to next notice -- possible missing content'"))},
  {reasons("table", ("repairs > 0", "repairs || ' merged-row repairs applied'"), ("jumps > 0", "jumps || ' non-sequential serial jumps'"), ("odd", "'some cells dramatically longer than others (likely merged)'"))})"""

_BAND = "CASE WHEN {0} IS NULL THEN 'unscored' WHEN {0} >= 0.80 THEN 'high' WHEN {0} >= 0.50 THEN 'medium' ELSE 'low' END"

_DOCS = f"""docs AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents
), {measured("SELECT * FROM docs")}, quality AS (SELECT doc_id, lang, source, spatial AS score, {_BAND.format("spatial")} AS band FROM spatials)"""

_BOXES = f"""boxes AS ({DUCK_BOXES}),
spread AS (SELECT *, l < width / 2 AND r > width / 2 AS spans, (l + r) / 2 AS cx, r - l AS w FROM boxes),
zones AS (
  SELECT *, CASE WHEN layer = 'furniture' THEN 'furniture' WHEN spans AND w > (width - 100) * 0.55::DOUBLE THEN 'full'
    WHEN spans AND abs(cx - width / 2) < 80 AND w < (width - 100) * 0.45::DOUBLE THEN 'centred' WHEN l >= width / 2 THEN 'right' WHEN r <= width / 2 THEN 'left'
    WHEN cx < width / 2 THEN 'left_by_centre' ELSE 'right_by_centre' END AS zone FROM spread
)"""

_ORDERED = f"""{_BOXES},
sides AS (SELECT *, CASE WHEN zone LIKE 'left%' THEN 1 WHEN zone LIKE 'right%' THEN 2 ELSE 0 END AS side FROM zones WHERE zone <> 'furniture'),
pages AS (
  SELECT doc_id, page_no, count(*) FILTER (side = 1) = 0 OR count(*) FILTER (side = 2) = 0 AS single, max(t) FILTER (side = 0) AS full_top,
    list(t ORDER BY t DESC) FILTER (side > 0) AS tops, greatest(min(b) FILTER (side = 1), min(b) FILTER (side = 2)) AS zone_bottom
  FROM sides GROUP BY doc_id, page_no
),
moves AS (
  SELECT s.*, single, side > 0 AND CASE WHEN coalesce(full_top < tops[len(tops) // 2 + 1], false) THEN t <= full_top + 50 ELSE t < zone_bottom END AS moved
  FROM sides AS s JOIN pages USING (doc_id, page_no)
),
ordered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY
      CASE WHEN single THEN 0 WHEN moved OR side = 0 THEN 3 ELSE side END, t DESC, CASE WHEN single AND side = 0 THEN 3 ELSE side END, elem_idx) - 1 AS INTEGER) AS pos
  FROM moves
)"""

_BANDS = f"""boxes AS ({DUCK_BOXES}),
queue AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY t DESC, elem_idx) AS q FROM boxes WHERE layer <> 'furniture'),
walk AS (
  SELECT doc_id, page_no, q, elem_idx, l, t, r, b, width, 0 AS band, b AS low, t - b AS high FROM queue WHERE q = 1
  UNION ALL
  SELECT doc_id, page_no, q, elem_idx, l, t, r, b, width, band + new::INT, CASE WHEN new THEN b ELSE least(low, b) END, CASE WHEN new THEN t - b ELSE greatest(high, t - b) END
  FROM (
    SELECT x.*, w.band, w.low, w.high, w.low - x.t > 1.5 * CASE WHEN w.high = 0 THEN 10.0 ELSE w.high END AS new
    FROM walk AS w JOIN queue AS x ON x.doc_id = w.doc_id AND x.page_no = w.page_no AND x.q = w.q + 1
  )
),
sized AS (
  SELECT doc_id, page_no, band, count(*) AS n, count(*) FILTER (r - l > (width - 100) * 0.55::DOUBLE) AS w, count(*) FILTER (r <= width / 2) AS lt, count(*) FILTER (l >= width / 2) AS rt
  FROM walk GROUP BY ALL
),
kinds AS (
  SELECT *, n - lt - rt - w AS vague,
    CASE WHEN w >= greatest(1, n // 2) THEN 'full_width' WHEN lt = 0 OR rt = 0 THEN 'one_col' WHEN (n - lt - rt - w) / n > 0.3::DOUBLE THEN 'mixed' ELSE 'two_col' END AS mode
  FROM sized
),
banded AS (
  SELECT doc_id, page_no, band, mode, CASE mode WHEN 'full_width' THEN CASE WHEN w = n THEN 1.0 ELSE 0.8 END::DOUBLE WHEN 'one_col' THEN greatest(0.5::DOUBLE, 1.0::DOUBLE - vague / n)
    WHEN 'mixed' THEN greatest(0.3::DOUBLE, (lt + rt) / n) ELSE (lt + rt) / n END AS confidence, n AS n_elements FROM kinds
)"""

_MONTHS = "['january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december']"
_MASTHEAD = rf"""{LINES},
openings AS (SELECT doc_id, array_to_string(a[1:30], chr(10)) AS h FROM arrays),
found AS (
  SELECT doc_id, h, regexp_extract(h, '(?i)Vol[.]?\s*([CILVX]+)\s*-?\s*No[.]?\s*([0-9]+)', 1) AS v, regexp_extract(h, '(?i)Vol[.]?\s*([CILVX]+)\s*-?\s*No[.]?\s*([0-9]+)', 2) AS i,
    regexp_extract(h, '(?i)(?:Supplement\s+No[.]?\s*|-S)([0-9]+)', 1) AS s, regexp_extract(h, '(?i)NAIROBI\s*[,]?\s*([0-9]{{1,2}})(?:st|[nr]d|th)?\s+([A-Za-z]+)[,]?\s*([0-9]{{4}})', ['d', 'm', 'y']) AS x FROM openings
),
fields AS (
  SELECT doc_id, h, nullif(upper(v), '') AS volume, try_cast(i AS INTEGER) AS issue_no, try_cast(s AS INTEGER) AS supplement_no,
    try_cast(x.y || '-' || list_position(list_transform({_MONTHS}, lambda m: m[1:3]), CASE WHEN lower(x.m) = 'sept' OR list_contains({_MONTHS}, lower(x.m)) OR length(x.m) = 3 THEN lower(x.m)[1:3] END) || '-' || x.d AS DATE) AS publication_date
  FROM found
),
masthead AS (
  SELECT *, CASE WHEN (volume IS NOT NULL)::INT + (issue_no IS NOT NULL)::INT + (supplement_no IS NOT NULL)::INT + (publication_date IS NOT NULL)::INT >= 3 THEN 1.0
      WHEN coalesce(volume, CAST(issue_no AS VARCHAR), CAST(supplement_no AS VARCHAR), CAST(publication_date AS VARCHAR)) IS NOT NULL THEN 0.5 ELSE 0.0 END::DOUBLE AS parse_confidence,
    CASE WHEN volume IS NULL OR issue_no IS NULL OR publication_date IS NULL THEN 'KE-GAZ-UNKNOWN-' || left(sha256(text), 12)
      ELSE concat_ws('-', 'KE-GAZ', volume, issue_no, publication_date) || CASE WHEN coalesce(supplement_no, 0) <> 0 THEN '-S' || supplement_no ELSE '' END END AS gazette_issue_id
  FROM fields JOIN issues USING (doc_id)
)"""

# Corrections, piece by piece: the split's lookahead as a mark put before each mention.
_CORRECTIONS = rf"""
firsts AS (SELECT doc_id, min(line_no) AS f FROM strict GROUP BY doc_id),
preambles AS (SELECT l.doc_id, l.line_no, l.line FROM lines AS l LEFT JOIN firsts AS f USING (doc_id) WHERE f IS NULL OR l.line_no < f),
sections AS (
  SELECT p.doc_id, string_agg(line, chr(10) ORDER BY line_no) AS s
  FROM preambles AS p LEFT JOIN (SELECT doc_id, min(line_no) AS c FROM preambles WHERE regexp_matches(trim(line), '(?i)^CORRIGEND[AE]$') GROUP BY doc_id) AS t USING (doc_id)
  WHERE c IS NULL OR line_no >= c GROUP BY p.doc_id
),
mentions AS (
  SELECT doc_id, unnest(string_split(regexp_replace(s, '(?i)(Gazette\s+Notice\s+No[.]?\s*[0-9])', chr(1) || '\1', 'g'), chr(1))) AS p FROM sections
),
corrections AS (
  SELECT doc_id, regexp_extract(p, '(?i)Gazette\s+Notice\s+No[.]?\s*([0-9]+)\s+of\s+([0-9]{{4}})', 1) AS referenced_notice_no,
    regexp_extract(p, '(?i)Gazette\s+Notice\s+No[.]?\s*([0-9]+)\s+of\s+([0-9]{{4}})', 2) AS referenced_year,
    nullif(regexp_extract(p, '(?is)amend\s+(?:the\s+)?(.+?)\s+(?:printed\s+as\s+)?"(.+?)"\s+to\s+read\s+"(.+?)"', 2), '') AS error_text,
    nullif(regexp_extract(p, '(?is)amend\s+(?:the\s+)?(.+?)\s+(?:printed\s+as\s+)?"(.+?)"\s+to\s+read\s+"(.+?)"', 3), '') AS correction_text,
    regexp_replace(trim(regexp_replace(p, '\s+', ' ', 'g')), '^\s+', '') AS raw_text
  FROM mentions WHERE regexp_matches(p, '(?i)Gazette\s+Notice\s+No[.]?\s*[0-9]+\s+of\s+[0-9]{{4}}')
)"""

_ROLLUP = f"""
banded_notices AS (SELECT *, {_BAND.format("composite")} AS band FROM scored),
sums AS (
  SELECT doc_id, count(*) FILTER (band = 'high') AS high, count(*) FILTER (band = 'medium') AS medium, count(*) FILTER (band = 'low') AS low,
    CAST(sum(CAST(round(composite * 1000) AS BIGINT)) AS BIGINT) / 1000.0::DOUBLE / count(*) AS mean, min(composite) AS min_composite, count(*) AS n_notices FROM banded_notices GROUP BY doc_id
),
rollup_rows AS (
  SELECT doc_id, {_round(_clip("1.0::DOUBLE - low / n_notices"))} AS notice_split, {_round("mean * 0.6::DOUBLE + 1.0::DOUBLE * 0.2::DOUBLE + 0.9::DOUBLE * 0.2::DOUBLE")} AS composite,
    high, medium, low, {_round("mean")} AS mean_composite, min_composite, n_notices FROM sums
)"""


def _with(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{ctes}\n{select}"


SQL: dict[str, str] = {
    "line_explode": "SELECT doc_id, unnest(range(len(a)))::INTEGER AS line_no, unnest(a) AS line FROM (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[1 : len(a) - 1] ELSE a END AS a "
    r"FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS a FROM documents))",
    "content_hash": "SELECT doc_id, sha256(text) AS content_sha256 FROM documents",
    "ends_clean": f"SELECT doc_id, {_clean('text')} AS clean FROM documents",
    "column_tokens": rf"SELECT doc_id, array_to_string(list_filter(string_split_regex({_strip('text')}, ' {{2,}}'), lambda p: p <> ''), '|') AS parts FROM documents",
    "mid_sentence_breaks": _with(_DOCS, "SELECT doc_id, CAST(breaks AS INTEGER) AS breaks FROM spatials"),
    "repeated_sixgrams": _with(_DOCS, f"SELECT doc_id, CAST(CASE WHEN len(w) >= 6 THEN {REPEATS} ELSE 0 END AS INTEGER) AS repeats FROM spatials"),
    "midcap_density": _with(_DOCS, f"SELECT doc_id, CAST({CAPITALS} AS INTEGER) AS caps, CAST(words AS INTEGER) AS words FROM spatials"),
    "spatial_score": _with(_DOCS, "SELECT doc_id, spatial AS score FROM spatials"),
    "structure_score": _with(_DOCS, f"SELECT doc_id, {_round(structure('false', 'false'))} AS score FROM spatials"),
    "ocr_quality_proxy": rf"""WITH d AS (
  SELECT doc_id, text AS t, length(text) AS n, length(regexp_replace(text, '\P{{L}}', '', 'g')) AS letters, length(regexp_replace(text, '\s', '', 'g')) AS total,
    list_transform({_lines("text")}, lambda v: length({_strip("v")})) AS ls FROM documents
) SELECT doc_id, CASE WHEN t = '' THEN 0.0::DOUBLE ELSE {_round(_clip("least(letters / greatest(1, total) * 1.1::DOUBLE, 1.0::DOUBLE) * 0.5::DOUBLE + (1.0::DOUBLE - CASE WHEN len(ls) > 0 THEN len(list_filter(ls, lambda v: v <= 2)) / len(ls) ELSE 0.0::DOUBLE END) * 0.3::DOUBLE + least(1.0::DOUBLE, n / greatest(1, ceil(n / 1500.0::DOUBLE) * 1500)) * 0.2::DOUBLE"))} END AS score FROM d""",
    "quality_bands": _with(_DOCS, f"""SELECT band, count(*) AS n, count(*) FILTER (quality = 1) AS correct, {_round("count(*) FILTER (quality = 1) / count(*)")} AS precision
FROM quality JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY band"""),
    "confidence_aggregate": _with(_DOCS, f"""SELECT {_round("sum(CAST(round(score * 1000) AS BIGINT))::DOUBLE / 1000.0::DOUBLE / count(*)")} AS mean, min(score) AS min,
{_round("count(*) FILTER (score >= 0.8) / count(*)")} AS fraction_high, count(*) AS n FROM quality"""),
    "confidence_filter": _with(_DOCS, "SELECT doc_id, score FROM quality WHERE score >= 0.7"),
    "confidence_rollup": _with(_DOCS, f"""SELECT lang, band, count(*) AS n, {_round("sum(CAST(round(score * 1000) AS BIGINT))::DOUBLE / 1000.0::DOUBLE / count(score)")} AS mean_score
FROM quality GROUP BY ROLLUP (lang, band)"""),
    "lowest_confidence_topn": _with(_DOCS, "SELECT doc_id, score FROM quality ORDER BY score, doc_id LIMIT 20"),
    "stratified_sample_sizes": _with(_DOCS, "SELECT band, least(count(*), 20) AS n FROM quality GROUP BY band"),
    "zone_classify": _with(_BOXES, "SELECT doc_id, page_no, elem_idx, zone FROM zones"),
    "reading_order": _with(_ORDERED, "SELECT doc_id, page_no, elem_idx, pos FROM ordered"),
    "page_text": _with(_ORDERED, """SELECT doc_id, string_agg(page_text, chr(10) || chr(10) ORDER BY page_no) AS text FROM (
  SELECT p.doc_id, p.page_no, coalesce(string_agg(o.text, chr(10) || chr(10) ORDER BY pos), '') AS page_text
  FROM (SELECT DISTINCT doc_id, page_no FROM boxes) AS p LEFT JOIN ordered AS o USING (doc_id, page_no) GROUP BY ALL) GROUP BY doc_id"""),
    "band_cluster": _with(_BANDS, "SELECT doc_id, page_no, elem_idx, band FROM walk", True),
    "band_confidence": _with(_BANDS, f"SELECT doc_id, page_no, band, mode, {_round('confidence')} AS confidence, n_elements FROM banded", True),
    "page_layout": _with(_BANDS, f"""SELECT b.doc_id, b.page_no, {_round("sum(confidence * n_elements ORDER BY band) / sum(n_elements)")} AS layout_confidence,
  CASE WHEN count(DISTINCT mode) > 1 THEN 'hybrid (' || any_value(top) || ' dominant)' ELSE any_value(top) END AS mode, CAST(count(*) AS INTEGER) AS n_bands
FROM banded AS b JOIN (SELECT doc_id, page_no, first(mode ORDER BY c DESC, f) AS top FROM (SELECT doc_id, page_no, mode, count(*) AS c, min(band) AS f FROM banded GROUP BY ALL) GROUP BY ALL) USING (doc_id, page_no)
GROUP BY b.doc_id, b.page_no""", True),
    "strict_headers": _with(LINES, "SELECT doc_id, line_no::INTEGER AS line_no, no AS notice_no FROM strict"),
    "recovered_headers": _with(LINES, "SELECT doc_id, line_no::INTEGER AS line_no, no AS notice_no FROM recovered"),
    "notice_spans": _with(LINES, "SELECT doc_id, notice_idx::INTEGER AS notice_idx, no AS notice_no, kind AS header_match, line_no::INTEGER AS line_start, line_end::INTEGER AS line_end FROM bounds"),
    "strip_furniture": _with(LINES, f"SELECT doc_id, count(*) AS n FROM lines WHERE NOT {_furniture('line')} GROUP BY doc_id"),
    "notice_text": _with(NOTICES, "SELECT doc_id, notice_idx::INTEGER AS notice_idx, no AS notice_no, header, full_text FROM pieces"),
    "stitched_notices": _with(NOTICES, "SELECT doc_id, line_start::INTEGER AS line_start, no AS notice_no, array_to_string(stitched_from, ',') AS stitched_from, end_line::INTEGER AS end_line, full_text FROM stitched"),
    "trimmed_notices": _with(NOTICES, "SELECT doc_id, notice_idx::INTEGER AS notice_idx, no AS notice_no, line_end::INTEGER AS line_end, sha256(full_text) AS content_sha256 FROM notices"),
    "title_stack": _with(PIECES, "SELECT p.doc_id, p.notice_idx::INTEGER AS notice_idx, coalesce(t.titles, '') AS titles FROM pieces AS p LEFT JOIN titles AS t ON t.doc_id = p.doc_id AND t.start = p.line_start", True),
    "body_segments": _with(PIECES, "SELECT s.doc_id, p.notice_idx::INTEGER AS notice_idx, seg::INTEGER AS segment, type, lines FROM segments AS s JOIN pieces AS p ON p.doc_id = s.doc_id AND p.line_start = s.start", True),
    "masthead_fields": _with(_MASTHEAD, "SELECT doc_id, volume, CAST(issue_no AS VARCHAR) AS issue_no, CAST(publication_date AS VARCHAR) AS publication_date, CAST(supplement_no AS VARCHAR) AS supplement_no, parse_confidence, gazette_issue_id FROM masthead"),
    "notice_ids": _with(f"{_MASTHEAD}, {NOTICES[len(LINES) + 1 :]}", "SELECT n.doc_id, notice_idx::INTEGER AS notice_idx, gazette_issue_id || ':' || coalesce(no, '_orphan_' || line_start) AS notice_id FROM notices AS n JOIN masthead USING (doc_id)"),
    "corrigenda_refs": _with(f"{LINES},{_CORRECTIONS}", "SELECT doc_id, referenced_notice_no, referenced_year, error_text, correction_text, raw_text FROM corrections"),
    "notice_number_score": f"SELECT no, {NUMBER} AS score FROM (SELECT CASE o_orderkey % 7 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN o_orderkey || '/2010' WHEN 2 THEN o_orderkey || 'A' WHEN 3 THEN '1234567' || o_orderkey WHEN 4 THEN CAST(o_orderkey % 10 AS VARCHAR) WHEN 5 THEN o_orderstatus ELSE NULL END AS no FROM orders)",
    "boundary_score": _with(NOTICES, f"SELECT doc_id, notice_idx::INTEGER AS notice_idx, {BOUNDARY} AS score FROM notices"),
    "document_confidence": _with(f"{SCORED},{_ROLLUP}", "SELECT * FROM rollup_rows", True),
    "composite": _with(SCORED, "SELECT doc_id, notice_idx::INTEGER AS notice_idx, notice_number, structure, spatial, boundary, table_score AS \"table\", composite FROM scored", True),
    "regression_check": _with(f"{SCORED},{_ROLLUP}", """SELECT doc_id, mean_composite AS actual, CASE doc_id % 5 WHEN 0 THEN mean_composite + 0.1::DOUBLE ELSE mean_composite END AS expected, doc_id % 5 = 0 AS failed
FROM rollup_rows WHERE doc_id % 3 <> 0""", True),
    "warnings_by_kind": _with(
        f"{_MASTHEAD}, {SPLIT[len(LINES) + 1 :]},{_CORRECTIONS}",
        """SELECT 'masthead.parse_failed' AS kind, count(*) AS n FROM masthead WHERE gazette_issue_id LIKE 'KE-GAZ-UNKNOWN-%' HAVING count(*) > 0
UNION ALL SELECT 'corrigendum_scope_defaulted', count(*) FROM corrections HAVING count(*) > 0
UNION ALL SELECT 'table_coerced_to_text', count(*) FROM notice_segments WHERE type = 'table' HAVING count(*) > 0""",
        True,
    ),
}

_IDX = "notice_idx::INTEGER AS notice_idx"
_BOTH = f"{_MASTHEAD}, {SCORED[len(LINES) + 1 :]},{_CORRECTIONS}"
_NOTICE_ID = "gazette_issue_id || ':' || coalesce(no, '_orphan_' || line_start)"
_KEYED = f"{_BOTH},keyed AS (SELECT n.*, {_NOTICE_ID} AS notice_id, gazette_issue_id FROM scored AS n JOIN masthead USING (doc_id))"
_WHYS = f"whys AS (SELECT *, {WHY} AS why FROM keyed)"

SQL["serial_tables"] = _with(
    """parts AS (SELECT p_partkey // 10 AS doc_id, p_partkey AS k, p_name, p_type, row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) AS r FROM part),
chunks AS (
  SELECT doc_id, 0 AS i, 'S/No. Name' AS line FROM parts WHERE r = 1 UNION ALL SELECT doc_id, 1, 'Position' FROM parts WHERE r = 1
  UNION ALL SELECT doc_id, 3 * r - 1, CASE r WHEN 1 THEN k || ' ' || (k + 1) ELSE CAST(k AS VARCHAR) END FROM parts
  UNION ALL SELECT doc_id, 3 * r, CASE r WHEN 1 THEN p_name || '   second' ELSE p_name END FROM parts UNION ALL SELECT doc_id, 3 * r + 1, p_type FROM parts
)"""
    + f",{chunked('chunks', 'doc_id')}",
    f"SELECT doc_id, rows AS \"table\", {_round(_TABLE_SCORE)} AS score FROM tables",
    True,
)
SQL["reasons"] = _with(
    SCORED,
    f"SELECT doc_id, no AS notice_no, header, composite, notice_number, structure, spatial, boundary, table_score AS \"table\", array_to_string({WHY}, ' | ') AS reasons FROM scored",
    True,
)
SQL["explained"] = _with(
    f"{SCORED}, whys AS (SELECT *, {WHY} AS why FROM scored)",
    f"""SELECT doc_id, {_IDX}, 'Notice ' || coalesce(no, '?') || ': ' || coalesce(header, '(no header)') || chr(10) || '  header_match=' || kind || ' line_span=[' || line_start || ', ' || line_end || '] stitched_from='
  || CASE WHEN len(stitched_from) > 0 THEN '[''' || array_to_string(stitched_from, ''', ''') || ''']' ELSE '[]' END || chr(10) || '  scores: notice_number=' || notice_number || ', structure=' || structure
  || ', spatial=' || spatial || ', boundary=' || boundary || coalesce(', table=' || table_score, '') || ', composite=' || composite
  || CASE WHEN len(why) > 0 THEN chr(10) || '  reasons:' || chr(10) || '    - ' || array_to_string(why, chr(10) || '    - ') ELSE '' END AS text FROM whys""",
    True,
)
SQL["ocr_capped"] = _with(
    f"{SCORED}, capped AS (SELECT *, doc_id % 7 = 0 AND kind = 'strict' AS poor, doc_id % 7 = 0 AND kind = 'strict' AND boundary > 0.6::DOUBLE AS held FROM scored)",
    f"""SELECT doc_id, {_IDX}, CASE WHEN held THEN 0.6::DOUBLE ELSE boundary END AS boundary, CASE WHEN held THEN {_round(_composite("0.6::DOUBLE"))} ELSE composite END AS composite,
  CASE WHEN poor THEN 0.4::DOUBLE END AS ocr_quality FROM capped""",
    True,
)
SQL["id_stability"] = _with(
    f"{_MASTHEAD}, {NOTICES[len(LINES) + 1 :]}, ids AS (SELECT n.doc_id, notice_idx, {_NOTICE_ID} AS id FROM notices AS n JOIN masthead USING (doc_id))",
    """SELECT doc_id, a = b AS same, a[: least(len(a), len(b))] = b[: least(len(a), len(b))] AS prefix FROM (
  SELECT doc_id, list(id ORDER BY notice_idx) AS a, coalesce(list(id ORDER BY notice_idx) FILTER (notice_idx > 0 OR doc_id % 2 = 0), []) AS b FROM ids GROUP BY doc_id)""",
)
SQL["highlighted"] = _with(
    LINES,
    r"SELECT doc_id, regexp_replace(text, '(?m)^(## )?(GAZETTE NOTICE NO\. [0-9]+)\s*$', "
    r"""'\1<span style="background-color:#fff3cd;color:#1a1a1a;padding:0.15em 0.35em;border-radius:3px;font-weight:600;">\2</span>', 'g') AS markdown FROM issues""",
)
SQL["plain_notices"] = _with(
    rf"""{LINES},
plain AS (SELECT doc_id, line_no AS start, regexp_extract({_strip("line")}, '^GAZET(?:TE|E)\s+NOTICE\s+NO[.]\s*([0-9]+)\s*$', 1) AS no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS notice_idx
  FROM lines WHERE regexp_matches({_strip("line")}, '^GAZET(?:TE|E)\s+NOTICE\s+NO[.]\s*[0-9]+\s*$')),
chunks AS (
  SELECT l.doc_id, h.start, row_number() OVER (PARTITION BY l.doc_id, h.start ORDER BY l.line_no) - 1 AS i, l.line
  FROM lines AS l ASOF JOIN plain AS h ON l.doc_id = h.doc_id AND l.line_no >= h.start WHERE l.line_no > h.start AND NOT {_furniture("l.line")}
),{chunked("chunks", "doc_id start")},
bodies AS (SELECT doc_id, start, {_strip("string_agg(line, chr(10) ORDER BY i)")} AS body_text FROM chunks GROUP BY ALL),
kinds AS (SELECT doc_id, start, string_agg(type, ',' ORDER BY seg) AS kinds FROM segments GROUP BY ALL)""",
    f"""SELECT h.doc_id, {_IDX}, no AS notice_no, coalesce(titles, '') AS titles, coalesce(body_text, '') AS body_text, coalesce(kinds, '') AS kinds, rows AS "table"
FROM plain AS h LEFT JOIN titles AS t ON t.doc_id = h.doc_id AND t.start = h.start LEFT JOIN bodies AS b ON b.doc_id = h.doc_id AND b.start = h.start
LEFT JOIN kinds AS k ON k.doc_id = h.doc_id AND k.start = h.start LEFT JOIN tables AS g ON g.doc_id = h.doc_id AND g.start = h.start""",
    True,
)
_PAGES = f"""{_BANDS},
page_rows AS (
  SELECT b.doc_id, b.page_no, {_round("sum(confidence * n_elements ORDER BY band) / sum(n_elements)")} AS confidence, sum(n_elements) AS n,
    CASE WHEN count(DISTINCT mode) > 1 THEN 'hybrid (' || any_value(top) || ' dominant)' ELSE any_value(top) END AS mode
  FROM banded AS b JOIN (SELECT doc_id, page_no, first(mode ORDER BY c DESC, f) AS top FROM (SELECT doc_id, page_no, mode, count(*) AS c, min(band) AS f FROM banded GROUP BY ALL) GROUP BY ALL) USING (doc_id, page_no)
  GROUP BY b.doc_id, b.page_no
),
every_page AS (SELECT a.doc_id, a.page_no, coalesce(confidence, 1.0::DOUBLE) AS confidence, coalesce(n, 0) AS n, coalesce(mode, 'empty') AS mode FROM (SELECT DISTINCT doc_id, page_no FROM boxes) AS a LEFT JOIN page_rows AS p USING (doc_id, page_no)),
laid_out AS (
  SELECT doc_id, CASE WHEN sum(n) = 0 THEN 1.0::DOUBLE ELSE {_round("sum(confidence * n ORDER BY page_no) / sum(n)")} END AS layout_confidence, CAST(count(*) AS INTEGER) AS n_pages,
    string_agg(mode, '|' ORDER BY page_no) AS modes FROM every_page GROUP BY doc_id
)"""
SQL["document_layout"] = _with(_PAGES, "SELECT * FROM laid_out", True)
_OCR_SCORE = _clip(
    "least(letters / greatest(1, total) * 1.1::DOUBLE, 1.0::DOUBLE) * 0.5::DOUBLE + (1.0::DOUBLE - CASE WHEN len(ls) > 0 THEN len(list_filter(ls, lambda v: v <= 2)) / len(ls) ELSE 0.0::DOUBLE END) * 0.3::DOUBLE"
    " + least(1.0::DOUBLE, n / greatest(1, ceil(n / 1500.0::DOUBLE) * 1500)) * 0.2::DOUBLE"
)
SQL["envelope_index"] = _with(
    rf"""{_KEYED},
quality AS (
  SELECT doc_id, CASE WHEN t = '' THEN 0.0::DOUBLE ELSE {_OCR_SCORE} END AS ocr FROM (
    SELECT doc_id, text AS t, length(text) AS n, length(regexp_replace(text, '\P{{L}}', '', 'g')) AS letters, length(regexp_replace(text, '\s', '', 'g')) AS total,
      list_transform(list_filter(string_split(text, chr(10) || chr(10)), lambda v: regexp_matches(v, '\S')), lambda v: length(v)) AS ls FROM issues
  )
),
summed AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (composite < 0.5) AS low, CAST(sum(CAST(round(composite * 1000) AS BIGINT)) AS BIGINT) / 1000.0::DOUBLE / count(*) AS mean, min(composite) AS least FROM scored GROUP BY doc_id
),
told AS (SELECT doc_id, count(*) AS n FROM corrections GROUP BY doc_id),
coerced AS (SELECT doc_id, count(*) AS n FROM notice_segments WHERE type = 'table' GROUP BY doc_id)""",
    f"""SELECT CAST(m.doc_id AS VARCHAR) AS doc_id, gazette_issue_id, sha256(text) AS pdf_sha256, c.n::INTEGER AS n_notices, coalesce(t.n, 0)::INTEGER AS n_corrigenda,
  ((gazette_issue_id LIKE 'KE-GAZ-UNKNOWN-%')::INT + coalesce(t.n, 0) + coalesce(w.n, 0))::INTEGER AS n_warnings, volume, issue_no, CAST(publication_date AS VARCHAR) AS publication_date,
  1.0::DOUBLE AS layout, {_round("ocr")} AS ocr_quality, {_round(_clip("1.0::DOUBLE - low / c.n"))} AS notice_split, {_round("mean * 0.6::DOUBLE + 1.0::DOUBLE * 0.2::DOUBLE + ocr * 0.2::DOUBLE")} AS composite,
  {_round("mean")} AS mean_composite, least AS min_composite
FROM masthead AS m JOIN summed AS c USING (doc_id) JOIN quality USING (doc_id) LEFT JOIN told AS t ON t.doc_id = m.doc_id LEFT JOIN coerced AS w ON w.doc_id = m.doc_id""",
    True,
)
SQL["envelope_violations"] = _with(LINES, "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 0::INTEGER AS n_broken FROM issues")
SQL["bundle_notices"] = _with(
    f"{_KEYED}, {_WHYS}",
    f"""SELECT CAST(n.doc_id AS VARCHAR) AS doc_id, n.notice_idx::INTEGER AS position, notice_id, no AS gazette_notice_no, header AS gazette_notice_header, coalesce(titles, '') AS titles,
  sha256(full_text) AS content_sha256, line_start::INTEGER AS line_start, line_end::INTEGER AS line_end, kind AS header_match, array_to_string(stitched_from, ',') AS stitched_from,
  CASE kind WHEN 'none' THEN NULL ELSE CAST(end_line AS VARCHAR) END AS end_line, composite, array_to_string(why, ' | ') AS reasons
FROM whys AS n LEFT JOIN titles AS x ON x.doc_id = n.doc_id AND x.start = n.line_start""",
    True,
)
SQL["bundle_corrigenda"] = _with(
    f"{LINES},{_CORRECTIONS}",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'notice_references_other' AS scope, raw_text, referenced_notice_no AS target_notice_no, CAST(referenced_year AS INTEGER) AS target_year, correction_text AS amendment
FROM corrections""",
)
SQL["bundle_tables"] = _with(
    _KEYED,
    'SELECT CAST(doc_id AS VARCHAR) AS doc_id, notice_idx::INTEGER AS position, notice_id, no AS gazette_notice_no, table_rows AS "table", repairs::INTEGER AS n_repairs FROM keyed WHERE table_rows IS NOT NULL',
    True,
)
SQL["bundle_debug_trace"] = _with(
    f"{_KEYED}, {_WHYS}", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, notice_idx::INTEGER AS position, notice_id, composite, boundary, array_to_string(why, ' | ') AS reasons FROM whys", True
)
SQL["enhanced"] = _with(
    f"{SCORED}, by_length AS (SELECT *, least(1.0::DOUBLE, length(full_text[1:4000]) / 1000.0::DOUBLE) AS x FROM scored), means AS (SELECT *, (0.0::DOUBLE + x + x + x + x) / 4 AS mean FROM by_length)",
    f"""SELECT doc_id, {_IDX}, CASE WHEN composite < 0.8::DOUBLE THEN {_round("mean")} END AS semantic, CASE WHEN composite < 0.8::DOUBLE THEN {_round("composite * 0.6::DOUBLE + mean * 0.4::DOUBLE")} END AS composite_enhanced,
  composite < 0.8::DOUBLE AND x < 0.5::DOUBLE AS needs_human_review FROM means""",
    True,
)
SQL["parsed_layouts"] = _with(
    f"{_PAGES}, {_ORDERED[_ORDERED.index('spread AS') :]}",
    r"""SELECT CAST(l.doc_id AS VARCHAR) AS doc_id, layout_confidence, n_pages, 1::INTEGER AS n_notices, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS content_sha256 FROM laid_out AS l JOIN (
  SELECT doc_id, string_agg(page_text, chr(10) || chr(10) ORDER BY page_no) AS text FROM (
    SELECT p.doc_id, p.page_no, coalesce(string_agg(o.text, chr(10) || chr(10) ORDER BY pos), '') AS page_text
    FROM (SELECT DISTINCT doc_id, page_no FROM boxes) AS p LEFT JOIN ordered AS o USING (doc_id, page_no) GROUP BY ALL) GROUP BY doc_id) AS t USING (doc_id)""",
    True,
)

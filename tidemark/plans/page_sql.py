"""The page operators in SQL, as common table expressions over the table pages: each name holds what the one before it gives."""

from __future__ import annotations

from ..functions.text import BLANKS, QUOTES, UNSEEN
from ..operators.pages import BLOCK, ENTITIES, HARD, MENU_WORDS, MESSAGE_WORDS, SOFT


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _one_line(text: str) -> str:
    plain = f"translate({text}, {_quoted(''.join(QUOTES) + BLANKS)}, {_quoted(''.join(QUOTES.values()) + ' ' * len(BLANKS))})"
    return f"trim(regexp_replace(regexp_replace({plain}, '[{UNSEEN}]', '', 'g'), '[\\s\\x0B]+', ' ', 'g'))"


def _decoded(text: str) -> str:
    for name, char in ENTITIES.items():
        text = f"replace({text}, {_quoted(name)}, {_quoted(char)})"
    return text


def _hits(words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower(text), {_quoted(w)}) AS INT)" for w in words) + ")"


_HARD = "|".join(rf"<{tag}\b.*?(?:</{tag}\s*>|$)" for tag in HARD.split("|"))
_PLAIN = _decoded(r"regexp_replace(regexp_replace(raw, '(?is)<br\b[^>]*>', ' ', 'g'), '(?s)<[^>]*>|[\x02\x03]', '', 'g')")
_LINKS = r"coalesce(list_sum(list_transform(regexp_extract_all(raw, '(?is)<a\b[^>]*>(.*?)</a>', 1), lambda x: length(regexp_replace(x, '<[^>]*>', '', 'g')))), 0)"

BLOCKS = rf"""pg0 AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is){_HARD}|<!--.*?(?:-->|$)', ' ', 'g') AS h FROM pages),
pg1 AS (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<(?:{SOFT})\b[^>]*>', chr(1) || chr(2), 'g'), '(?is)</(?:{SOFT})\s*>', chr(1) || chr(3), 'g'), '(?is)</?(?:{BLOCK})\b[^>]*>', chr(1), 'g'), chr(1)) AS p FROM pg0),
pg2 AS (SELECT page_id, unnest(p) AS raw, generate_subscripts(p, 1) AS part_no FROM pg1),
pg3 AS (SELECT page_id, part_no, sum(CASE WHEN starts_with(raw, chr(2)) THEN 1 WHEN starts_with(raw, chr(3)) THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY part_no) > 0 AS soft, {_one_line(_PLAIN)} AS text, CAST({_LINKS} AS INT) AS link_chars FROM pg2),
blk AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY part_no) - 1 AS INT) AS block_no, text, soft, CAST(length(text) AS INT) AS chars, link_chars, substr(sha1(text), 1, 16) AS fp FROM pg3 WHERE text <> '')"""

MEASURED = f"""msd AS (SELECT *, least(1e0, link_chars / chars) AS link_density, len(list_filter(string_split(text, chr(10)), lambda x: length(x) < 25)) / len(string_split(text, chr(10))) AS short_share, {_hits(MESSAGE_WORDS)} AS message_hits, {_hits(MENU_WORDS)} AS menu_hits FROM blk)"""


def shared(share: float = 0.2) -> str:
    return f"""shr AS (SELECT fp, count(DISTINCT page_id) AS pages, min(text) AS sample FROM blk GROUP BY fp HAVING (SELECT count(DISTINCT page_id) FROM blk) >= 20 AND count(DISTINCT page_id) >= greatest(5, ceil(CAST({share} AS DOUBLE) * (SELECT count(DISTINCT page_id) FROM blk))))"""


BEST = """cl AS (SELECT *, CASE WHEN message_hits > 0 AND chars >= 300 AND NOT soft AND link_density < 3e-1 THEN 1 WHEN chars >= 150 AND link_density < 5e-1 THEN 2 END AS pass_no, chars * (1 - link_density) * (1 + 2e-1 * message_hits - 2e-1 * menu_hits) AS score FROM msd WHERE fp NOT IN (SELECT fp FROM shr)),
first_pass AS (SELECT * FROM cl WHERE pass_no IS NOT NULL QUALIFY pass_no = min(pass_no) OVER (PARTITION BY page_id)),
near_best AS (SELECT * FROM first_pass QUALIFY score >= 95e-2 * max(score) OVER (PARTITION BY page_id)),
best AS (SELECT page_id, text, pass_no FROM near_best QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY chars, block_no) = 1)"""


def residual(least: int = 0) -> str:
    """The run of greatest weight, found from every start and end: no prefix sums."""
    return f"""own AS (SELECT page_id, block_no, text, chars, fp NOT IN (SELECT fp FROM shr) AS own FROM blk),
wgt AS (SELECT *, CASE WHEN own THEN greatest(4, chars) ELSE -greatest(4, chars) / 2e0 END AS w, own OR coalesce(lag(own) OVER pg, false) OR coalesce(lead(own) OVER pg, false) AS near FROM own WINDOW pg AS (PARTITION BY page_id ORDER BY block_no)),
cum AS (SELECT *, sum(w) OVER (PARTITION BY page_id ORDER BY block_no) AS s FROM wgt),
run AS (SELECT a.page_id, a.block_no AS first_no, b.block_no AS last_no, b.s - a.s + a.w AS gain FROM cum a JOIN cum b ON a.page_id = b.page_id AND a.block_no <= b.block_no QUALIFY row_number() OVER (PARTITION BY a.page_id ORDER BY b.s - a.s + a.w DESC, b.block_no, a.block_no DESC) = 1),
tries AS (SELECT page_id, string_agg(text, chr(10) ORDER BY block_no) FILTER (WHERE gain > 0 AND block_no BETWEEN first_no AND last_no) AS t1, string_agg(text, chr(10) ORDER BY block_no) FILTER (WHERE near) AS t2, string_agg(text, chr(10) ORDER BY block_no) AS t3, coalesce(sum(chars) FILTER (WHERE own), 0) AS own_chars FROM wgt JOIN run USING (page_id) GROUP BY 1),
res AS (SELECT page_id, text FROM (SELECT page_id, CASE WHEN t1 <> '' AND length(t1) >= {least} THEN t1 WHEN t2 <> '' AND length(t2) >= {least} THEN t2 WHEN t3 <> '' AND length(t3) >= {least} AND own_chars >= {least} AND own_chars > 0 THEN t3 END AS text FROM tries) WHERE text IS NOT NULL)"""


#: Attachments: the documents whose number is the page's.
INDEX = f"""att AS (SELECT doc_id AS page_id, {_one_line("text")} AS text FROM documents WHERE {_one_line("text")} <> ''),
idx AS (SELECT page_id, coalesce(b.text, r.text, a.text, '') AS text, CASE WHEN b.text IS NOT NULL THEN 'block' WHEN r.text IS NOT NULL THEN 'residual' WHEN a.text IS NOT NULL THEN 'attachment' ELSE 'none' END AS how FROM (SELECT page_id FROM pages) LEFT JOIN best b USING (page_id) LEFT JOIN res r USING (page_id) LEFT JOIN att a USING (page_id))"""

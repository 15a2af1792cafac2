"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontam import op6_decontam
from .lines import op7_lines
from .neardups import op10_neardups
from .paragraphs import op1_paragraphs
from .pieces import op5_sentencepiece
from .pii import op9_surrogates
from .quality import op8_quality
from .sharding import op4_sharding
from .toxicity import op2_toxicity
from .warc import op3_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_paragraphs": op1_paragraphs,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_sharding": op4_sharding,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_decontam": op6_decontam,
    "op7_lines": op7_lines,
    "op8_quality": op8_quality,
    "op9_surrogates": op9_surrogates,
    "op10_neardups": op10_neardups,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_EMPTY = "coalesce(text, '')"

#: CRC-32 by its reflected polynomial: a table of 256 entries, then one step a byte.
_CRC = """tab AS (SELECT [list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) FOR n IN range(256)] AS t),
raw AS (SELECT doc_id, TXT AS x FROM documents),
hexed AS (SELECT doc_id, strlen(x)::BIGINT + 8 AS size, [('0x' || h)::BIGINT FOR h IN string_split(regexp_replace(hex(encode(x)), '(..)', '\\1 ', 'g'), ' ') IF h <> ''] AS b FROM raw),
summed AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM hexed, tab)""".replace("TXT", _EMPTY)

ORACLE_SQL: dict[str, str] = {
    "op3_warc": """WITH d AS (SELECT page_id, coalesce(html, '') AS h FROM pages), x AS (SELECT page_id, h, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS top FROM d),
v AS (SELECT *, [('0x' || substr(s, 5 * k + 1, 5))::BIGINT FOR k IN range(8)] AS g FROM x)
SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((g[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1) FOR i IN range(32)], '') AS payload_digest,
CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM v""",
    "op4_sharding": f"""WITH {_CRC}, p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32 ROWS UNBOUNDED PRECEDING)::BIGINT - size AS before, sum(size) OVER ()::BIGINT AS total FROM summed),
q AS (SELECT *, least(23, (2 * before + size) * 24 // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32)::BIGINT - 1 AS slot, NULL::INT AS grown_shard FROM q""",
    "op7_lines": f"""WITH a AS (SELECT doc_id, string_split({_EMPTY}, chr(10)) AS ls FROM documents), k AS (SELECT *, unnest(range(len(ls))) AS k FROM a),
every AS (SELECT doc_id, k::INT AS line_no, list_distinct(regexp_extract_all(ls[k + 1], '[^\\x20\\x09-\\x0D]+')) AS ws FROM k),
ln AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS r FROM every WHERE len(ws) > 0),
t AS (SELECT r, len(ws) AS n, unnest(ws) AS w FROM ln), f AS (SELECT w, count(*) AS c FROM t GROUP BY w), o AS (SELECT r, n, w, row_number() OVER (PARTITION BY r ORDER BY c, w) AS p FROM t JOIN f USING (w)),
pre AS (SELECT r, n, w FROM o WHERE p <= n - (80 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.r AS e, b.r AS l FROM pre a JOIN pre b ON a.w = b.w AND a.r < b.r AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
i AS (SELECT e, l, len(list_intersect(x.ws, y.ws)) AS i, len(x.ws) + len(y.ws) AS n FROM c JOIN ln x ON x.r = e JOIN ln y ON y.r = l),
m AS (SELECT l, min(e) AS e FROM i WHERE 100 * i >= 80 * (n - i) GROUP BY l)
SELECT y.doc_id, y.line_no, m.e IS NOT NULL AS removed, x.doc_id AS first_doc_id, x.line_no AS first_line_no FROM ln y LEFT JOIN m ON m.l = y.r LEFT JOIN ln x ON x.r = m.e""",
    "op10_neardups": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate({_EMPTY}, '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS x FROM s), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * i >= 80 * (len(sa.sh) + len(sb.sh) - i)),
r(id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
SELECT s.doc_id, any_value(len(sh))::BIGINT AS n_shingles, min(c) AS component_id FROM s JOIN r ON r.id = s.doc_id GROUP BY s.doc_id""",
}

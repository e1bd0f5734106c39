"""DuckDB SQL for the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

from . import licenses
from .source_mix import BLOCK, BUCKET_ROWS, EPOCHS

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "[^\\t\\n\\x0B\\f\\r ]+"


def source_mix() -> str:
    """Each document's place in its source's shuffled stream, how much of it the target's epochs cover, and the slot of its first block."""
    before = "OVER (ORDER BY source_size / weight, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    here = [(f"({e} * source_size + pos)", f"least({e} * source_size + pos + size, quota)") for e in range(EPOCHS)]
    epochs = " + ".join(f"greatest(0, {to} - {at})" for at, to in here)
    blocks = " + ".join(f"CASE WHEN {at} < {to} THEN ({to} - 1) // {BLOCK} - {at} // {BLOCK} + 1 ELSE 0 END" for at, to in here)
    frac = lambda x: f"({x} - floor({x}))"
    point = frac(frac("(n % 1048576) * 0.6180339887498949") + " + " + frac("(n // 1048576) * 0.6077874097403510"))
    name = "coalesce(doc_id::VARCHAR, '-')"
    return f"""
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS size, md5('0:' || {name}) AS digest FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS id FROM s GROUP BY source),
w AS (SELECT *, ((id - 1) % 3 + 1)::DOUBLE AS weight FROM src),
lv AS (SELECT *, (sum(source_size) OVER () - {EPOCHS} * coalesce(sum(source_size) {before}, 0)) / (sum(weight) OVER () - coalesce(sum(weight) {before}, 0)) AS level FROM w),
l AS (SELECT arg_min(level, (source_size / weight, id)) AS level FROM lv WHERE {EPOCHS} * source_size >= weight * level),
t AS (SELECT source, id, source_size, n, least({EPOCHS} * source_size, coalesce(weight * l.level, 0))::DOUBLE AS target FROM lv, l),
tq AS (SELECT *, round(target)::BIGINT AS quota, (round(target)::BIGINT + {BLOCK - 1}) // {BLOCK} AS blocks FROM t),
al AS (SELECT coalesce(sum(size), 0)::BIGINT AS total FROM s),
e0 AS (SELECT *, sum(target) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) / greatest(1, total) AS h0, max(id) OVER () AS last FROM tq, al),
e AS (SELECT *, coalesce(lag(h0) OVER (ORDER BY id), 0.0) AS lo, CASE WHEN id = last THEN 2.0 ELSE h0 END AS hi FROM e0),
u AS (SELECT n AS slot, {point} AS u FROM al, range((total + {BLOCK - 1}) // {BLOCK}) r(n)),
dr AS (SELECT id, blocks, slot, row_number() OVER (PARTITION BY id ORDER BY slot) - 1 AS block FROM u JOIN e ON u >= lo AND u < hi AND hi > lo),
had AS (SELECT id, count(*) AS had FROM dr GROUP BY id),
sl AS (SELECT id, block, slot FROM dr WHERE block < blocks UNION ALL SELECT id, block, (total + {BLOCK - 1}) // {BLOCK} + block FROM (SELECT id, total, unnest(range(coalesce(had, 0), blocks)) AS block FROM e LEFT JOIN had USING (id))),
p AS (SELECT doc_id, size, source_size, target, quota, id, sum(size) OVER (PARTITION BY s.source ORDER BY ('0x' || substr(digest, 1, 8))::BIGINT % ceil(n / {BUCKET_ROWS})::BIGINT, digest, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS pos FROM s JOIN tq ON s.source IS NOT DISTINCT FROM tq.source),
q AS (SELECT *, ({epochs})::BIGINT AS taken, ({blocks})::BIGINT AS n_blocks FROM p)
SELECT doc_id, size, source_size, target, taken, slot::BIGINT AS first_slot, n_blocks FROM q LEFT JOIN sl ON sl.id = q.id AND taken > 0 AND sl.block = pos // {BLOCK}"""


def partenum() -> str:
    """Every pair that shares a shingle, and the closure of the links among them."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORDS}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
lk AS (SELECT a, b FROM pr JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk),
r(d, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON d = doc_id"""


def license_rules() -> str:
    """Pieces of both cuts joined to the known sentences, and rules found, longest first, in the ordered identifiers."""
    normal = "trim(regexp_replace(translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"

    def cut(name: str, pieces: str, known: licenses.Known) -> str:
        values = ", ".join(f"('{k}', '{v}')" for k, v in known.whole.items())
        holes = " ".join(f"WHEN starts_with(x, '{before}') AND ends_with(x, '{after}') THEN '{own}'" for before, after, own in known.holed)
        return f"""
{name}p AS (SELECT rid, unnest({pieces}) AS p, generate_subscripts({pieces}, 1) AS i FROM d), {name}x AS (SELECT rid, i, {normal} AS x FROM {name}p),
{name}v AS (SELECT rid, i, coalesce(v, CASE {holes} END) AS v FROM {name}x LEFT JOIN (VALUES {values}) t(k, v) ON k = x),
{name}i AS (SELECT rid, string_agg('<' || v || '>', '' ORDER BY i) AS ids, count(*) AS n FROM {name}v WHERE v IS NOT NULL GROUP BY rid)"""

    def marked(known: licenses.Known, ids: str) -> str:
        for run, licence in known.rules:
            ids = f"replace({ids}, '{run}', '{{{licence}}}')"
        return f"list_distinct(regexp_extract_all({ids}, '\\{{([^}}]*)\\}}', 1))"

    def kept(own: str, other: str) -> str:
        alone = f"list_filter({other}, lambda y: NOT list_contains({own}, y))"
        part = " ".join(f"WHEN x = '{name}' THEN NOT list_has_any({alone}, {longer})" for name, longer in licenses.parts().items())
        return f"list_filter({own}, lambda x: CASE {part} ELSE true END)"

    ends = "string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?:])\\s+(?:[0-9*-]+[.)]?\\s+)?', '\\1' || chr(1), 'g'), chr(1))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN regexp_matches(text, '{licenses.ANCHOR}') THEN text END AS text FROM documents), {cut('a', f"string_split_regex(text, '{licenses.LINE_END}')", licenses.BY_LINE)}, {cut('b', ends, licenses.BY_SENTENCE)},
j AS (SELECT doc_id, coalesce(ai.ids, '') AS by_line, coalesce(bi.ids, '') AS by_sentence, greatest(coalesce(ai.n, 0), coalesce(bi.n, 0)) AS n FROM d LEFT JOIN ai USING (rid) LEFT JOIN bi USING (rid)),
m AS (SELECT doc_id, n, {marked(licenses.BY_LINE, 'by_line')} AS l, {marked(licenses.BY_SENTENCE, 'by_sentence')} AS s FROM j)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat({kept('l', 's')}, {kept('s', 'l')}))), ',') AS licenses, n AS n_sentences FROM m"""


def oracle_sql() -> dict[str, str]:
    return {"op5_license_rules": license_rules(), "op8_source_mix": source_mix(), "op9_partenum": partenum()}

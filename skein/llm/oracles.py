"""SQL that gives the rows of the queries pN_ where SQL can express them."""

from __future__ import annotations

import unicodedata

# Fixed values, written down apart from the operator's: letters that look alike, by the Latin letter.
ALIKE = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ",
    "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", "a": "а", "c": "сϲ", "d": "ԁ", "e": "е",
    "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оο", "p": "р", "q": "ԛ", "s": "ѕ", "v": "ν", "w": "ԝ", "x": "х", "y": "у",
}

_SCORED = (
    "scored AS (SELECT query_id, lower(trim(retriever_type)) AS retriever_type, chunk_id, max(score) AS score FROM rankings WHERE isfinite(score) GROUP BY ALL)"
)

P1 = (
    f"WITH {_SCORED} SELECT query_id, retriever_type, chunk_id FROM scored WHERE query_id IN (SELECT query_id FROM relevance) "
    "QUALIFY row_number() OVER (PARTITION BY query_id, retriever_type ORDER BY score DESC, chunk_id) <= 10"
)

P2 = (
    "WITH v AS (SELECT chunk_id, min(embedding)::DOUBLE[] AS v FROM chunk_vectors WHERE len(embedding) = 96 GROUP BY chunk_id), "
    "u AS (SELECT chunk_id, v, sqrt(list_dot_product(v, v)) AS l FROM v WHERE list_dot_product(v, v) > 0), "
    "s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, round(list_dot_product(a.v, b.v) / a.l / b.l, 6) AS sim FROM u a JOIN u b ON a.chunk_id <> b.chunk_id), "
    "n AS (SELECT a, b FROM s WHERE sim >= 0.8 QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 5) "
    "SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM n"
)


def _span(e: str) -> str:
    """The end of the piece that starts at ``s``."""
    w = "substr(content, s + 1, 1200)"
    ends = [f"len(regexp_extract({w}, '{p}'))" for p in ("(?s)^.*\\n\\n", "(?s)^.*(?:[.?!][ \\t\\r\\n]|[。！？।؟])", "(?s)^.*[ \\t\\r\\n]")]
    cases = " ".join(f"WHEN {x} > 600 THEN s + {x}" for x in ends)
    return f"CASE WHEN n - s <= 1200 THEN n {cases} ELSE s + 1200 END AS {e}"


_NEXT = "len(regexp_extract(substr(content, e - 150, 151), '(?s)^.*?[ \\t\\r\\n][^ \\t\\r\\n]'))"
P4 = (
    "WITH RECURSIVE r AS (SELECT document_id, content, n, s, " + _span("e") + " FROM (SELECT DISTINCT document_id, content, len(content) AS n, 0 AS s FROM papers WHERE len(content) > 1200) "
    "UNION ALL SELECT document_id, content, n, s, " + _span("e") + f" FROM (SELECT document_id, content, n, CASE WHEN {_NEXT} > 0 THEN e - 152 + {_NEXT} ELSE e - 150 END AS s FROM r WHERE e < n)) "
    "SELECT document_id, CAST(s AS INT) AS start_char, CAST(e AS INT) AS end_char FROM r"
)

P5 = (
    f"WITH {_SCORED}, k AS (SELECT query_id FROM scored WHERE query_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT retriever_type) = 3), "
    "r AS (SELECT query_id, chunk_id, 1 - (rank() OVER w - 1) / count(*) OVER (PARTITION BY query_id, retriever_type) AS place FROM scored WHERE query_id IN (SELECT query_id FROM k) WINDOW w AS (PARTITION BY query_id, retriever_type ORDER BY score DESC)), "
    "f AS (SELECT query_id, chunk_id, sum(place) AS total FROM r GROUP BY ALL) SELECT query_id, chunk_id FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY total DESC, chunk_id) <= 3"
)


def _canonical(x: str) -> str:
    """The canonical form as far as the tables need it: wide and narrow forms, ligatures, spaces, look-alikes, accents."""
    wide = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    narrow = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF61, 0xFFA0)}
    table = {**wide, **{k: v for k, v in narrow.items() if len(v) == 1}, **{x: latin for latin, others in ALIKE.items() for x in others}}
    keys, values = ("".join(t).replace("'", "''") for t in (table, table.values()))
    x = f"regexp_replace({x}, '[\\x{{ad}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}\\x{{feff}}]', '', 'g')"
    x = f"regexp_replace({x}, '\\p{{Zs}}', ' ', 'g')"
    for c in range(0xFB00, 0xFB07):
        x = f"replace({x}, '{chr(c)}', '{unicodedata.normalize('NFKC', chr(c))}')"
    return f"nfc_normalize(translate({x}, '{keys}', '{values}'))"


P8 = (
    f"WITH f AS (SELECT doc_id, text, {_canonical('text')} AS form FROM documents WHERE text IS NOT NULL), g AS (SELECT * FROM f WHERE regexp_matches(form, '[^ \\t\\r\\n]')) "
    "SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM g a JOIN g b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id"
)

_WORDS = f"regexp_extract_all(lower({_canonical('text')}), '[\\p{{L}}\\p{{N}}]+')"
P7 = (
    f"WITH i AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM eval_items WHERE split IN ('test', 'validation') AND text IS NOT NULL), d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), "
    "g AS (SELECT DISTINCT item_id, array_to_string(w[x + 1:x + 12], ' ') AS gram FROM (SELECT item_id, w, unnest(range(len(w) - 11)) AS x FROM i WHERE len(w) >= 12)), "
    "h AS (SELECT DISTINCT doc_id, array_to_string(w[x + 1:x + 12], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(len(w) - 11)) AS x FROM d WHERE len(w) >= 12)) "
    "SELECT DISTINCT doc_id, item_id FROM g JOIN h USING (gram) UNION "
    "SELECT DISTINCT doc_id, item_id FROM d JOIN i ON len(i.w) BETWEEN 1 AND 11 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(i.w, ' ') || ' ')"
)

# Sentences can't be found by SQL; they must hold every letter and digit, and be parted by white space alone.
P3 = (
    "SELECT DISTINCT document_id, CAST(len(regexp_replace(content, '[^\\p{L}\\p{N}]', '', 'g')) AS BIGINT) AS kept, CAST(0 AS BIGINT) AS loose, CAST(0 AS BIGINT) AS overlapping FROM papers WHERE regexp_matches(content, '[^\\s\\p{Z}]')"
)

# Nor can packings be listed; what they must hold can. Every document has a text of its own id.
P6 = "SELECT window_id, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS cut, true AS filled FROM context_windows"

P8_CLASSES = (
    f"WITH f AS (SELECT doc_id, text, {_canonical('text')} AS form FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL), g AS (SELECT DISTINCT * FROM f WHERE regexp_matches(form, '[^ \\t\\r\\n]')) "
    "SELECT doc_id, min(doc_id) OVER (PARTITION BY form) AS class_id, min(doc_id) OVER (PARTITION BY form, text) AS stored_id, variants FROM g JOIN (SELECT form, count(DISTINCT text) AS variants FROM g GROUP BY form HAVING count(DISTINCT text) > 1) USING (form)"
)

SQL = {"p3_sums": P3, "p6_sums": P6, "p8_classes": P8_CLASSES, "p1_found": P1, "p2_found": P2, "p4_found": P4, "p5_found": P5, "p7_found": P7, "p8_found": P8}

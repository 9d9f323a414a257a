"""SQL of the corpus operators that SQL can express beyond their own modules."""

from __future__ import annotations

from .decontaminate import MIN_EQUAL, PUNCTUATION, WINDOW


def leaks() -> str:
    """No seeds: equal words of both sides by diagonal (place in the document less place in the item), then a plain count
    in the window that begins at each of them, or at the last place where a whole window fits."""
    marks = PUNCTUATION.replace("'", "''")
    words = f"list_filter(regexp_split_to_array(lower(translate(coalesce(text, ''), '{marks}', '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT item_id, {words} AS w FROM benchmark),
dw AS (SELECT doc_id, len(w) AS nd, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
bw AS (SELECT item_id, len(w) AS nb, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM b),
e AS (SELECT doc_id, item_id, i, i - j AS diag, least({WINDOW}, nb) AS n, CASE WHEN nb < {WINDOW} THEN nb ELSE {MIN_EQUAL} END AS need,
        least(nd, nb + i - j) AS last, greatest(1, 1 + i - j) AS first FROM dw JOIN bw USING (x)),
f AS (SELECT * FROM e QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, diag) >= need),
s AS (SELECT DISTINCT doc_id, item_id, diag, n, need, least(i, last - n + 1) AS s FROM f WHERE last - n + 1 >= first),
c AS (SELECT s.doc_id, s.item_id, s.need, s.s, count(*) AS n_equal FROM s JOIN f ON f.doc_id = s.doc_id AND f.item_id = s.item_id AND f.diag = s.diag AND f.i BETWEEN s.s AND s.s + s.n - 1 GROUP BY ALL)
SELECT doc_id, item_id, CAST(max(n_equal) AS BIGINT) AS n_equal FROM c WHERE n_equal >= need GROUP BY 1, 2
"""


def quality() -> str:
    """Counts by lists, references by sums over labelled documents, distances by one row a language and common word."""
    from .quality import CLASSES, COMMON, GROUPS, LANGUAGES, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_WORDS, SYMBOLS

    quote = lambda s: s.replace("'", "''")
    gone = lambda x, chars: f"(length({x}) - length(translate({x}, '{quote(chars)}', '')))"
    groups = ["".join(CLASSES[m] for m in g) for g in GROUPS]
    split = lambda x: f"list_filter(regexp_split_to_array({x}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    half = lambda p, q: f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END"
    both = lambda p, q: f"({half(p, q)} + {half(q, p)})"
    n = len(groups)
    rest = lambda t, total: "(" + total + " - " + " - ".join(f"{t}.c{k}" for k in range(n)) + ")"
    terms = " + ".join([*(both(f"(f.c{k} / f.chars)", f"(s.c{k} / s.chars)") for k in range(n)), both(rest("f", "f.ink") + " / f.chars", rest("s", "s.chars") + " / s.chars")])
    return f"""
WITH a AS (SELECT doc_id, lang, coalesce(text, '') AS t, {split("coalesce(text, '')")} AS w, {split("lower(coalesce(text, ''))")} AS low,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS o FROM g WHERE n > 1) GROUP BY 1),
f AS (SELECT a.doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS ink, {gone("t", SYMBOLS)} AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, {", ".join(f"{gone('t', g)} AS c{k}" for k, g in enumerate(groups))} FROM a LEFT JOIN r ON r.doc_id = a.doc_id),
f2 AS (SELECT *, CAST(greatest(ink, 1) AS DOUBLE) AS chars, CAST(greatest(n_words, 1) AS DOUBLE) AS words FROM f),
x AS (SELECT doc_id, lang, unnest(low) AS x FROM a), k AS (SELECT doc_id, x, count(*) AS n FROM x GROUP BY 1, 2),
c AS (SELECT lang, x, count(*) AS n FROM x WHERE lang IS NOT NULL GROUP BY 1, 2),
z AS (SELECT lang, sum(n) AS total FROM c GROUP BY 1 HAVING sum(n) * {LANGUAGES} >= (SELECT sum(n) FROM c)),
top AS (SELECT lang, x, n / total AS q FROM c JOIN z USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) <= {COMMON}),
s AS (SELECT lang, sum(n * length(x)) AS chars, {", ".join(f"sum(n * {gone('x', g)}) AS c{k}" for k, g in enumerate(groups))} FROM c JOIN z USING (lang) GROUP BY 1),
cd AS (SELECT f.doc_id, min(sqrt(greatest(({terms}) / 2, 0.0))) AS d FROM f2 f CROSS JOIN s GROUP BY 1),
wt AS (SELECT f.doc_id, top.lang, coalesce(k.n, 0) / f.words AS p, top.q FROM f2 f CROSS JOIN top LEFT JOIN k ON k.doc_id = f.doc_id AND k.x = top.x),
ws AS (SELECT doc_id, lang, sum({both("p", "q")}) + {both("(1.0 - sum(p))", "greatest(0.0, 1.0 - sum(q))")} AS j FROM wt GROUP BY 1, 2),
wd AS (SELECT doc_id, min(sqrt(greatest(j / 2, 0.0))) AS d FROM ws GROUP BY 1),
v AS (SELECT f.*, coalesce(cd.d, 0) AS cd, coalesce(wd.d, 0) AS wd, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(lang NOT IN (SELECT lang FROM z), false) AS odd
      FROM f2 f LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id))
SELECT doc_id, n_words, CAST(ink AS BIGINT) AS word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND (n_words < {MIN_WORDS} OR ink < {MIN_CHARS} OR odd OR (cd <= {MAX_CHAR_DISTANCE} AND wd <= {MAX_WORD_DISTANCE})) AS kept FROM v
"""

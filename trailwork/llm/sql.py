"""DuckDB SQL of the corpus queries that SQL can express; slow, meant for small tables."""

from __future__ import annotations

from trailwork.llm.quality import BASE_NGRAM, MAX_LINE_SHARE, MAX_NGRAM_SHARE

_WORDS = r"[^\x20\x09-\x0D]+"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quality_sql() -> str:
    lengths = sorted({BASE_NGRAM, *MAX_NGRAM_SHARE})
    gram = """g{n} AS (SELECT doc_id, sum(inside) AS words, sum(inside * chars) AS chars FROM (SELECT doc_id, chars, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {back} PRECEDING AND CURRENT ROW) AS inside FROM
        (SELECT doc_id, pos, chars, CASE WHEN pos + {back} <= n AND count(*) OVER (PARTITION BY doc_id, pos + {back} <= n, ws[pos:pos + {back}]) > 1 THEN 1 ELSE 0 END AS again FROM w)) GROUP BY 1)"""
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, ws, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS pos, length(unnest(ws)) AS chars FROM (SELECT doc_id, regexp_extract_all(text, '{_WORDS}') AS ws FROM d)),
        t AS (SELECT doc_id, count(*) AS n_words, sum(chars) AS word_chars FROM w GROUP BY 1),
        l AS (SELECT doc_id, sum(k) AS n_lines, sum(k) - count(*) AS n_dup_lines, sum(CASE WHEN k > 1 THEN k * length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) ELSE 0 END) AS dup_line_chars FROM (SELECT doc_id, line, count(*) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORDS}') GROUP BY 1, 2) GROUP BY 1),
        {', '.join(gram.format(n=n, back=n - 1) for n in lengths)},
        m AS (SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(g{BASE_NGRAM}.words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(dup_line_chars, 0) AS BIGINT) AS dup_line_chars,
          {', '.join(f'CAST(coalesce(g{n}.chars, 0) AS BIGINT) AS dup_{n}gram_chars' for n in sorted(MAX_NGRAM_SHARE))} FROM d LEFT JOIN t USING (doc_id) LEFT JOIN l USING (doc_id) {' '.join(f'LEFT JOIN g{n} USING (doc_id)' for n in lengths)})
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND dup_line_chars <= {MAX_LINE_SHARE} * word_chars AND {' AND '.join(f'dup_{n}gram_chars <= {s} * word_chars' for n, s in MAX_NGRAM_SHARE.items())} AS kept FROM m"""


_SPLIT = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_SHINGLES = "[ws[i:i + 4] for i in range(1, greatest(len(ws) - 4, 1) + 1)]"

DECONTAMINATION = f"""WITH it AS (SELECT item_id, len(ws) AS w, greatest(len(ws) - 4, 1) AS m, {_SHINGLES} AS shs FROM (SELECT item_id, {_SPLIT} AS ws FROM benchmark) WHERE len(ws) > 0),
    ish AS (SELECT item_id, sh, count(*) AS c FROM (SELECT item_id, unnest(shs) AS sh FROM it) GROUP BY 1, 2),
    dx AS (SELECT doc_id, len(ws) AS n, {_SHINGLES} AS shs FROM (SELECT doc_id, {_SPLIT} AS ws FROM documents) WHERE len(ws) > 0),
    dsh AS (SELECT doc_id, n, unnest(shs) AS sh, unnest(range(0, len(shs))) AS pos FROM dx),
    hit AS (SELECT DISTINCT doc_id, n, item_id, w, m AS im, greatest(least(w, n) - 4, 1) AS m, pos FROM dsh JOIN ish USING (sh) JOIN it USING (item_id)),
    st AS (SELECT DISTINCT doc_id, item_id, im, m, unnest(range(greatest(0, pos - m + 1), least(pos, greatest(n - w, 0)) + 1)) AS s FROM hit),
    bag AS (SELECT st.doc_id, st.item_id, im, m, s, sh, count(*) AS c FROM st JOIN dsh ON dsh.doc_id = st.doc_id AND pos BETWEEN s AND s + m - 1 GROUP BY ALL),
    score AS (SELECT doc_id, bag.item_id, s, any_value(im) AS im, any_value(m) AS m, sum(least(bag.c, coalesce(ish.c, 0))) AS b FROM bag LEFT JOIN ish ON ish.item_id = bag.item_id AND ish.sh = bag.sh GROUP BY 1, 2, 3)
    SELECT doc_id, item_id, max(b / (im + m - b)) AS similarity, CAST(arg_min(s, s - 1000000000.0 * (b / (im + m - b))) AS BIGINT) AS start_word, count(*) AS windows FROM score WHERE 100 * b >= 80 * (im + m - b) GROUP BY 1, 2"""

JACCARD = f"""WITH RECURSIVE x AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '{_WORDS}') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest([ws[i:i + 2] for i in range(1, greatest(len(ws) - 2, 1) + 1)]) AS sh FROM x WHERE len(ws) > 0),
    z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT u, v, i = a.n AND i = b.n AS same FROM p JOIN z a ON a.doc_id = u JOIN z b ON b.doc_id = v WHERE 100 * i >= 90 * (a.n + b.n - i)),
    e AS (SELECT u, v, same FROM l UNION ALL SELECT v, u, same FROM l),
    r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.doc_id),
    c AS (SELECT doc_id, least(doc_id, coalesce(min(v), doc_id)) AS cls FROM documents LEFT JOIN e ON u = doc_id AND same GROUP BY 1),
    k AS (SELECT u AS doc_id, count(DISTINCT cls) AS class_links FROM e JOIN c ON c.doc_id = e.v WHERE NOT same GROUP BY 1)
    SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id, coalesce(any_value(class_links), 0) AS class_links FROM r LEFT JOIN z USING (doc_id) LEFT JOIN k USING (doc_id) GROUP BY 1"""

#: Eight hex digits of ``digest``, from number ``k``, as a whole number.
_DIGITS = "list_reduce(list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', substr(digest, 8 * {k} + i, 1)) - 1), lambda x, y: x * 16 + y)"

INFILLING = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
    h AS (SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, {", ".join(f"{_DIGITS.format(k=k)} AS h{k + 1}" for k in range(4))} FROM d),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
    p AS (SELECT doc_id, text, n, form, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix FROM c)
    SELECT doc_id, n, form, CAST(CASE WHEN form <> 'plain' THEN length(prefix) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN length(middle) END AS BIGINT) AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": DECONTAMINATION, "op2_repetition": quality_sql(), "op9_jaccard": JACCARD, "op13_infilling": INFILLING}

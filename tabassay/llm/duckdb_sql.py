"""DuckDB SQL with the rows of the operators' queries."""

SQL = {
    "op3_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
        g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept,
               sha256(t.body) AS text_sha256
        FROM t JOIN g USING (body)
    """,
    "op6_quality_rules": """
        WITH counts AS (
          SELECT doc_id, lang, source,
            list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS words,
            list_filter(string_split(coalesce(text, ''), chr(10)),
                        lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS lines,
            length(regexp_replace(coalesce(text, ''), '[ \\t-\\r]', '', 'g')) AS word_chars,
            length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
            row_number() OVER () AS r
          FROM documents
        ),
        windows AS (
          SELECT r, i, list_aggregate(words[i:i + 2], 'string_agg', ' ') AS w
          FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM counts WHERE len(words) >= 4)
        ),
        twice AS (
          SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1
        ),
        covered AS (
          SELECT r, sum(least(coalesce(following - i, 3), 3)) AS n_repeat_words
          FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS following FROM twice) GROUP BY r
        ),
        measured AS (
          SELECT doc_id, lang, source, r, len(words) AS n_words, word_chars, n_symbols,
            len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
            coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
          FROM counts LEFT JOIN covered USING (r)
        ),
        judged AS (
          SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
        ),
        ratios AS (
          SELECT r, lang, source, base_failed, rule, value,
            (value >> w) << w AS bucket
          FROM (
            SELECT *, greatest(length(bin(value)) - 6, 0) AS w FROM (
              SELECT r, lang, source, base_failed, unnest(['symbols', 'dup_lines', 'repeats', 'word_length', 'n_words', 'n_lines']) AS rule,
                unnest([
                  CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END,
                  CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END,
                  CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END,
                  CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END,
                  n_words, n_lines
                ]) AS value
              FROM judged
            )
          )
        ),
        good AS (SELECT * FROM ratios WHERE NOT base_failed),
        fine AS (
          SELECT lang, source, rule, count(*) AS n, quantile_disc(bucket, 0.25) AS q1,
            quantile_disc(bucket, 0.5) AS q2, quantile_disc(bucket, 0.75) AS q3
          FROM good GROUP BY ALL
        ),
        coarse AS (
          SELECT lang, rule, count(*) AS n, quantile_disc(bucket, 0.25) AS q1,
            quantile_disc(bucket, 0.5) AS q2, quantile_disc(bucket, 0.75) AS q3
          FROM good GROUP BY ALL
        ),
        whole AS (
          SELECT rule, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.5) AS q2,
            quantile_disc(bucket, 0.75) AS q3
          FROM good GROUP BY ALL
        ),
        mixed AS (
          SELECT lang, rule, (n * coarse.q1 + 20 * whole.q1) // (n + 20) AS q1,
            (n * coarse.q2 + 20 * whole.q2) // (n + 20) AS q2, (n * coarse.q3 + 20 * whole.q3) // (n + 20) AS q3
          FROM coarse JOIN whole USING (rule)
        ),
        picked AS (
          SELECT fine.lang, fine.source, fine.rule, (n * fine.q1 + 20 * mixed.q1) // (n + 20) AS q1,
            (n * fine.q2 + 20 * mixed.q2) // (n + 20) AS q2, (n * fine.q3 + 20 * mixed.q3) // (n + 20) AS q3
          FROM fine JOIN mixed ON fine.lang IS NOT DISTINCT FROM mixed.lang AND fine.rule = mixed.rule
        ),
        rules (rule, size, events) AS (
          VALUES ('symbols', 'n_words', 10), ('dup_lines', 'n_lines', 1), ('repeats', 'n_words', 20),
            ('word_length', 'n_words', 40)
        ),
        fences AS (
          SELECT lang, source, rule, q1 - step AS low, q3 + step AS high
          FROM (
            SELECT x.*, 4 * greatest(x.q3 - x.q1, 1000 * events // (m.q2 + events)) AS step
            FROM picked x JOIN rules USING (rule)
            JOIN picked m ON m.rule = size AND m.lang IS NOT DISTINCT FROM x.lang
              AND m.source IS NOT DISTINCT FROM x.source
          )
        ),
        refused AS (
          SELECT DISTINCT r FROM good JOIN fences
            ON good.rule = fences.rule AND good.lang IS NOT DISTINCT FROM fences.lang
            AND good.source IS NOT DISTINCT FROM fences.source
          WHERE value > high OR (good.rule = 'word_length' AND value < low)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          NOT base_failed AND r NOT IN (SELECT r FROM refused) AS kept
        FROM judged
    """,
}

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(regexp_split_to_array(" + _LOWER + ", '[ \\t-\\r]+'), lambda x: x <> '')"

SQL["op4_line_dedup"] = f"""
    WITH parts AS (
      SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents
    ),
    lines AS (
      SELECT doc_id, k, lines[k + 1] AS line FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS k FROM parts)
    ),
    words AS (SELECT doc_id, k, {_WORDS.format('line')} AS ws FROM lines),
    tokens AS (
      SELECT DISTINCT doc_id, k, array_to_string(ws[i:i + 4], ' ') AS t
      FROM (SELECT doc_id, k, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM words WHERE len(ws) >= 1)
    ),
    sizes AS (SELECT doc_id, k, count(*) AS n FROM tokens GROUP BY ALL),
    met AS (
      SELECT b.doc_id, b.k, a.doc_id AS d, a.k AS j, count(*) AS c
      FROM tokens a JOIN tokens b ON a.t = b.t AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.k < b.k))
      GROUP BY ALL
    ),
    gone AS (
      SELECT DISTINCT met.doc_id, met.k FROM met
      JOIN sizes x ON x.doc_id = met.doc_id AND x.k = met.k
      JOIN sizes y ON y.doc_id = d AND y.k = j
      WHERE 100 * c >= 75 * (x.n + y.n - c)
    ),
    kept AS (
      SELECT lines.doc_id, string_agg(line, chr(10) ORDER BY lines.k) AS body, count(*) AS n
      FROM lines ANTI JOIN gone USING (doc_id, k) GROUP BY lines.doc_id
    )
    SELECT doc_id, len(lines) AS n_lines, len(lines) - coalesce(n, 0) AS n_removed,
      sha256(coalesce(body, '')) AS kept_sha256
    FROM parts LEFT JOIN kept USING (doc_id)
"""

SQL["op8_ngram_join"] = f"""
    WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents),
    shingles AS (
      SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS t
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM words WHERE len(ws) >= 1)
    ),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    met AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
      FROM shingles a JOIN shingles b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL
    ),
    links AS (
      SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
      WHERE 100 * c >= 75 * (x.n + y.n - c)
    ),
    ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reached AS (
      SELECT a AS doc_id, b AS other FROM ways
      UNION
      SELECT reached.doc_id, ways.b FROM reached JOIN ways ON ways.a = reached.other
    ),
    lowest AS (SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id)
    SELECT words.doc_id, coalesce(n, 0) AS n_shingles,
      least(words.doc_id, coalesce(other, words.doc_id)) AS component_id
    FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest USING (doc_id)
"""

SQL["op10_suffix_dedup"] = """
    WITH bodies AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    starts AS (
      SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS s
      FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM bodies)
    ),
    late AS (
      SELECT doc_id, p FROM (
        SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM starts
      ) WHERE r > 1
    ),
    marked AS (
      SELECT doc_id, p,
        coalesce(p - lag(p) OVER w > 100, true) AS opens, lead(p) OVER w AS following
      FROM late WINDOW w AS (PARTITION BY doc_id ORDER BY p)
    ),
    numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM marked),
    spans AS (SELECT doc_id, span, min(p) AS a, max(p) + 100 AS e FROM numbered GROUP BY ALL),
    pieces AS (
      SELECT doc_id, span, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY span), 0) AS before FROM spans
    ),
    cut AS (
      SELECT doc_id, count(*) AS n_spans, sum(e - a)::BIGINT AS n_removed, max(e) AS last,
        string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY span) AS head
      FROM pieces JOIN bodies USING (doc_id) GROUP BY doc_id
    )
    SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
      coalesce(n_spans, 0) AS n_spans,
      sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
    FROM bodies LEFT JOIN cut USING (doc_id)
"""

SQL["op12_source_divergence"] = f"""
    WITH rows AS (
      SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        {_LOWER.format('text')} AS body
      FROM documents
    ),
    found AS (
      SELECT r, lang, source, unnest(regexp_extract_all(body, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM rows
    ),
    kept AS (
      SELECT lang, term, count(*) AS n FROM found GROUP BY ALL HAVING count(DISTINCT r) >= 10
    ),
    langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
    pairs AS (SELECT DISTINCT lang, source FROM rows),
    counts AS (
      SELECT found.lang, found.source, found.term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL
    ),
    sizes AS (
      SELECT pairs.lang, pairs.source, coalesce(sum(n), 0) AS total FROM pairs LEFT JOIN counts USING (lang, source)
      GROUP BY ALL
    ),
    shares AS (
      SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
        1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (s.total + 2 * l.v) AS p,
        1 + 1000000000::HUGEINT * (k.n + 2) // (l.total + 2 * l.v) AS q
      FROM sizes s JOIN kept k USING (lang) JOIN langs l USING (lang)
      LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
    ),
    sums AS (
      SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ),
    listed AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
      FROM pairs a JOIN pairs b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
    )
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM listed
    )
    WHERE part = 'pair' OR rank <= 10
"""

_TERMS = f"unnest(regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term"

SQL["op11_lexical_search"] = f"""
    WITH rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
    bags AS (SELECT r, term, count(*) AS tf FROM (SELECT r, {_TERMS} FROM rows) GROUP BY ALL),
    sizes AS (SELECT r, sum(tf)::BIGINT AS n FROM bags GROUP BY r),
    whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM sizes),
    asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} FROM benchmark)),
    weights AS (
      SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM bags GROUP BY term), whole
    ),
    scored AS (
      SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length))))::BIGINT AS score
      FROM asked JOIN bags USING (term) JOIN weights USING (term) JOIN sizes USING (r), whole
      GROUP BY ALL
    )
    SELECT item_id, rank::INT AS rank, doc_id, score FROM (
      SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM scored JOIN rows USING (r) WHERE score > 0
    )
    WHERE rank <= 50
"""

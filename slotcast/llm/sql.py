"""DuckDB SQL for the rows of the queries that SQL can express."""

_MEASURES = {
    "symbols": ("1000 * n_symbols // n_words", 100, False),
    "word_length": ("1000 * word_chars // n_words", 400, True),
    "repeats": ("1000 * n_repeat_words // n_words", 50, False),
    "dup_lines": ("1000 * n_dup_lines // n_lines", 100, False),
}


def _limits(name: str, groups: str) -> str:
    """Limits per group of at least 200 documents, three widths beyond the quartiles."""
    by = f"{groups}, measure" if groups else "measure"
    on = f"PARTITION BY {by}"
    floors = " ".join(f"WHEN '{m}' THEN {x[1]}" for m, x in _MEASURES.items())
    return f"""
{name}_q AS (
  SELECT {by}, max(total) AS n,
    min(bucket) FILTER (upto >= ceil(total * 0.25)) AS low,
    min(bucket) FILTER (upto >= ceil(total * 0.75)) AS high
  FROM (SELECT *, sum(n) OVER ({on} ORDER BY bucket) AS upto, sum(n) OVER ({on}) AS total
        FROM (SELECT {by}, bucket, count(*) AS n FROM buckets GROUP BY {by}, bucket))
  GROUP BY {by}),
{name} AS (
  SELECT {by},
    high + 3 * greatest(high - low, CASE measure {floors} END) AS most,
    low - 3 * greatest(high - low, CASE measure {floors} END) AS least
  FROM {name}_q WHERE n >= 200)"""


def _quality() -> str:
    tests = " AND ".join(
        f"""coalesce(({e}) <= coalesce(
    (SELECT most FROM own o WHERE o.measure = '{m}' AND o.lang IS NOT DISTINCT FROM c.lang
       AND o.source IS NOT DISTINCT FROM c.source),
    (SELECT most FROM wide o WHERE o.measure = '{m}' AND o.lang IS NOT DISTINCT FROM c.lang),
    (SELECT most FROM every o WHERE o.measure = '{m}')), true)"""
        + (
            f""" AND coalesce(({e}) >= coalesce(
    (SELECT least FROM own o WHERE o.measure = '{m}' AND o.lang IS NOT DISTINCT FROM c.lang
       AND o.source IS NOT DISTINCT FROM c.source),
    (SELECT least FROM wide o WHERE o.measure = '{m}' AND o.lang IS NOT DISTINCT FROM c.lang),
    (SELECT least FROM every o WHERE o.measure = '{m}')), true)"""
            if low
            else ""
        )
        for m, (e, _, low) in _MEASURES.items()
    )
    values = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' AS measure, {e} AS v FROM counts WHERE NOT base_failed"
        for m, (e, _, _) in _MEASURES.items()
    )
    return f"""
WITH texts AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM texts),
five AS (
  SELECT doc_id, i, i <= n - 4 AS whole,
    concat_ws(' ', w, lead(w, 1) OVER d, lead(w, 2) OVER d, lead(w, 3) OVER d, lead(w, 4) OVER d)
      AS five
  FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
twice AS (
  SELECT doc_id, i, whole AND count(*) FILTER (whole) OVER (PARTITION BY doc_id, five) > 1 AS again
  FROM five),
marked AS (
  SELECT doc_id, max(again::int) OVER (PARTITION BY doc_id ORDER BY i
    ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit
  FROM twice),
repeats AS (SELECT doc_id, sum(hit)::bigint AS n_repeat_words FROM marked GROUP BY doc_id),
counts AS (
  SELECT doc_id, lang, source, len(ws) AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    greatest(len(lines), 1) AS n_lines,
    len(ws) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(ws) AS base_failed
  FROM texts LEFT JOIN repeats USING (doc_id)),
buckets AS (
  SELECT lang, source, measure,
    v - v % (1::bigint << greatest(length(bin(v)) - 7, 0)::int) AS bucket
  FROM ({values})),
{_limits("own", "lang, source")},
{_limits("wide", "lang")},
{_limits("every", "")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed,
  CASE WHEN base_failed THEN false ELSE {tests} END AS kept
FROM counts c"""


QUALITY_RULES = _quality().replace("\\\\x", "\\x")

#: Base32 of a SHA-1: every five hex signs are four signs of base32.
WARC = """
WITH rows AS (
  SELECT page_id, encode(coalesce(html, '')) AS p, sha1(coalesce(html, '')) AS d FROM pages),
firsts AS (SELECT d, min(page_id) AS first FROM rows GROUP BY d),
joined AS (
  SELECT page_id, octet_length(p) AS payload_bytes, d, first,
    first IS NOT NULL AND first IS DISTINCT FROM page_id AS again
  FROM rows JOIN firsts USING (d))
SELECT page_id, payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(d, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))::bigint) & 31)::bigint
      + 1, 1) for i in range(32)], 'string_agg', '') AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to
FROM joined"""


HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER own AS rank, id AS negative_id, positive_score,
  score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW own AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER own <= 5"""


def _tree(prefix: str, group: str, levels: int) -> str:
    """Levels of one tree per group over ``{prefix}0 (grp, pos, h)``: nodes and run siblings."""
    out = []
    for k in range(levels):
        out.append(f"""
{prefix}{k}s AS (
  SELECT *, count(*) OVER (PARTITION BY {group}) AS n,
    coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {prefix}{k} WINDOW run AS (PARTITION BY {group}, pos // 16 ORDER BY pos)),
{prefix}{k + 1} AS (
  SELECT {group}, pos // 16 AS pos,
    CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h
  FROM {prefix}{k}s GROUP BY {group}, pos // 16),""")
    return "".join(out)


def _step(previous: str, name: str, nodes: str, group: str, k: int) -> str:
    """Fold the leaves of ``previous`` through level ``k`` of a tree."""
    return f"""
{name} AS (
  SELECT f.* EXCLUDE (s, fold, place), place // 16 AS place,
    s || CASE WHEN n > 1 THEN l || r ELSE '' END AS s,
    CASE WHEN n > 1 THEN sha256(l || fold || r) ELSE fold END AS fold
  FROM {previous} f JOIN {nodes}{k}s t ON f.place = t.pos AND f.{group} = t.{group}),"""


def _merkle(levels: int = 5, tops: int = 3) -> str:
    def field(x: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    own = " || ".join(field(f) for f in fields)
    changed = " || ".join(field(lowered if f == "text" else f) for f in fields)
    # Eight shifts after each byte; the polynomial is that of the usual reflected CRC-32.
    step = "CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END"
    flat = (
        "flatten(list_transform(string_split(doc_id::VARCHAR, ''), "
        "lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    )
    crc = f"xor(list_reduce(list_concat([4294967295], {flat}), lambda c, x: {step}), 4294967295)"
    folds, previous = "", "f"
    for k in range(levels):
        folds += _step(previous, f"f{k}", "a", "g", k)
        previous = f"f{k}"
    folds += f"""
j AS (SELECT * EXCLUDE (place), g AS place, 0 AS one FROM {previous}),"""
    previous = "j"
    for k in range(tops):
        folds += _step(previous, f"j{k}", "b", "one", k)
        previous = f"j{k}"
    return f"""
WITH d AS (
  SELECT doc_id, source, sha256({own}) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN sha256({changed}) END AS tampered
  FROM documents),
e AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
a0 AS (SELECT g, place AS pos, leaf AS h FROM e),{_tree("a", "g", levels)}
b0 AS (SELECT 0 AS one, g AS pos, h FROM a{levels}),{_tree("b", "one", tops)}
f AS (SELECT *, '' AS s, coalesce(tampered, leaf) AS fold FROM e),{folds}
whole AS (SELECT h AS root FROM b{tops})
SELECT doc_id, leaf, h AS subroot, root, sha256(s) AS proof_sha256, fold AS folded_root,
  fold = root AS verified
FROM {previous} f JOIN b0 ON f.g = b0.pos CROSS JOIN whole"""


MERKLE = _merkle()

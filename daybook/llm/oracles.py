"""SQL counterparts of the operators that SQL can express."""

from __future__ import annotations

# The characters and limits of the quality rules, as in quality.py.
QUALITY = r"""
WITH split AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT id, unnest(range(1, len(words) - 6)) AS start,
         unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(list_slice(words, i, i + 7), ' '))) AS win
  FROM split
), twice AS (
  SELECT id, start FROM windows QUALIFY count(*) OVER (PARTITION BY id, win) > 1
), covered AS (
  SELECT id, sum(n)::BIGINT AS n FROM (
    SELECT id, least(8, coalesce(lead(start) OVER (PARTITION BY id ORDER BY start) - start, 8)) AS n FROM twice) GROUP BY id
), found AS (
  SELECT split.*, coalesce(n, 0) AS n_repeat_words FROM split LEFT JOIN covered USING (id)
), counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         n_repeat_words,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_stutters,
         len(regexp_extract_all(text, '!!')) AS n_shouts
  FROM found
), judged AS (
  SELECT *, (n_words < 20)::INT AS r0, (100 * n_repeat_words > 30 * n_words)::INT AS r1,
         (100 * n_symbols > 20 * n_words)::INT AS r2, (100 * n_dup_lines > 50 * n_lines)::INT AS r3,
         (100 * n_stutters > 30 * n_words)::INT AS r4, (100 * n_shouts > 30 * n_words)::INT AS r5,
         (word_chars > 40 * n_words)::INT AS r6
  FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r0 + r1 > 0 AS base_failed,
       r0 + r1 + r2 + r3 + r4 + r5 + r6 = 0 AS kept,
       (r0 + 2 * r1 + 4 * r2 + 8 * r3 + 16 * r4 + 32 * r5 + 64 * r6)::BIGINT AS failures
FROM judged
"""


# Fixed value: the scale of the vectors. Products of scaled components are whole numbers far below 2 ** 53, so sums of them are exact.
TOPK = """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM scaled q JOIN scaled c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

# Fixed value: the words of a window. The SQL supposes that no doc_id comes twice.
SUBSTRINGS = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), placed AS (
  SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word,
         unnest(list_transform(range(1, len(words) + 1), lambda i: CASE WHEN i + 49 <= len(words) THEN array_to_string(list_slice(words, i, i + 49), ' ') END)) AS win
  FROM split
), judged AS (
  SELECT doc_id, i, word, win IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY win) AS later FROM placed
), covered AS (
  SELECT doc_id, i, word, max(later::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) = 1 AS gone FROM judged
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS words FROM covered GROUP BY doc_id
)
SELECT doc_id, len(s.words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.words, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id)
"""

def _doubled(source: str, *steps: tuple[int, int]) -> str:
    """CTEs that name ever longer strings by the hash of two shorter ones: (length of the parts, from where to where)."""
    parts = []
    for n, (length, apart) in enumerate(steps):
        parts.append(f"""d{n} AS (
  SELECT doc_id, i, n, byte, hash(name, lead(name, {apart}) OVER (PARTITION BY doc_id ORDER BY i)) AS name FROM {source})""")
        source = f"d{n}"
    return ",\n".join(parts)


# Fixed value: the bytes of a window, put together from strings of 1, 2, 4 ... 32 bytes. The SQL supposes that no doc_id comes twice.
SUFFIXES = f"""
WITH raw AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS bytes FROM documents
), cut AS (
  SELECT doc_id, regexp_extract_all(bytes, '..') AS bytes FROM raw
), placed AS (
  SELECT doc_id, len(bytes) AS n, unnest(range(0, len(bytes))) AS i, unnest(bytes) AS byte, unnest(list_transform(bytes, lambda b: hash(b))) AS name FROM cut
), {_doubled("placed", (1, 1), (2, 2), (4, 4), (8, 8), (16, 16), (32, 18))},
windows AS (
  SELECT doc_id, i, byte, CASE WHEN i + 50 <= n THEN name END AS win FROM d5
), judged AS (
  SELECT doc_id, i, byte, win IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY win) AS later FROM windows
), covered AS (
  SELECT doc_id, i, byte, max(later::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) = 1 AS gone FROM judged
), edges AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM covered
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans,
         string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS bytes FROM edges GROUP BY doc_id
)
SELECT doc_id, (len(r.bytes) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k.bytes, ''))) AS kept_sha256
FROM raw r LEFT JOIN kept k USING (doc_id)
"""


def crc32(value: str) -> str:
    """SQL for the unsigned crc32 of an ASCII text. The polynomial is a fixed value."""
    bit = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({value}, ''), lambda d: ord(d)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {bit}), 4294967295)"


def _tree(name: str, leaves: str, levels: int) -> str:
    """CTEs of a tree over ``leaves`` (tree, i, h): the levels above them, and for every node what lies left and right in its run."""
    parts = [f"{name}0 AS (SELECT tree, i, h, count(*) OVER (PARTITION BY tree) AS n FROM {leaves})"]
    for k in range(levels):
        parts.append(f"""{name}s{k} AS (
  SELECT a.tree, a.i, any_value(a.n) AS n, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM {name}{k} a JOIN {name}{k} b ON a.tree = b.tree AND a.i // 16 = b.i // 16 GROUP BY a.tree, a.i)""")
        parts.append(f"""{name}{k + 1} AS (
  SELECT tree, i // 16 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (any_value(n) + 15) // 16 AS n
  FROM {name}{k} GROUP BY tree, i // 16)""")
    return ",\n".join(parts)


def _climb(start: str, trees: list[tuple[str, str, str, int]]) -> str:
    """CTEs that fold a leaf up: ``trees`` as (CTE prefix, column of the tree, column of the place, levels)."""
    parts, now = [], start
    for name, tree, place, levels in trees:
        for k in range(levels):
            parts.append(f"""c{len(parts)} AS (
  SELECT q.* EXCLUDE (node, proof), proof || s.l || s.r AS proof, CASE WHEN s.n > 1 THEN sha256(s.l || node || s.r) ELSE node END AS node
  FROM {now} q JOIN {name}s{k} s ON s.tree = {tree} AND s.i = {place} // {16**k})""")
            now = f"c{len(parts) - 1}"
    return ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM {now}"


def merkle(levels: int = 5, crown: int = 3) -> str:
    """The manifest, for sources of up to 16 ** ``levels`` rows and 16 ** ``crown`` sources."""
    def leaf(text: str) -> str:
        fields = [("doc_id", "doc_id::VARCHAR"), ("source", "source"), ("lang", "lang"), ("n_chars", "n_chars::VARCHAR"), (text, text)]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for _, v in fields) + ")"

    upper = "".join(map(chr, range(65, 91)))
    lowered = f"translate(text, '{upper}', '{upper.lower()}')"
    return f"""
WITH hashed AS (
  SELECT doc_id, coalesce('1' || source, '0') AS tree, {leaf('text')} AS leaf,
         CASE WHEN {crc32('doc_id::VARCHAR')} % 5 = 0 THEN {leaf(lowered)} END AS altered
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM hashed
), {_tree('t', 'leaves', levels)},
subroots AS (SELECT '' AS tree, tree AS own, row_number() OVER (ORDER BY tree) - 1 AS i, h FROM t{levels}),
{_tree('u', 'subroots', crown)},
placed AS (
  SELECT l.doc_id, l.leaf, l.tree, l.i, s.i AS j, s.h AS subroot, (SELECT h FROM u{crown}) AS root, coalesce(altered, leaf) AS node, '' AS proof
  FROM leaves l JOIN subroots s ON s.own = l.tree
), {_climb('placed', [('t', 'q.tree', 'q.i', levels), ('u', "''", 'q.j', crown)])}
"""


_UPPER = "".join(map(chr, range(65, 91)))
# The parameters of the collocations, as in collocations.py.
COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), phrases AS (
  SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(list_slice(words, i, i + size - 1), ' '))) AS phrase
  FROM split, (SELECT unnest(range(1, 5)) AS size) WHERE len(words) >= size
), counted AS (
  SELECT lang, phrase, any_value(size) AS size, count(*) AS f FROM phrases GROUP BY lang, phrase
), frequent AS (
  SELECT *, string_split(phrase, ' ') AS words FROM counted WHERE f >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.f) // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM frequent) c
  JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.words, 1, k), ' ')
  JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.words, k + 1, c.size), ' ')
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, part, max(f) AS longer FROM (
    SELECT lang, f, unnest(list_transform(range(1, size - w + 2), lambda i: array_to_string(list_slice(words, i, i + w - 1), ' '))) AS part
    FROM frequent, (SELECT unnest(range(2, 4)) AS w) WHERE w < size) GROUP BY lang, part
), kept AS (
  SELECT s.* FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.part = s.phrase
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
), totals AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM split GROUP BY lang
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": TOPK, "op4_quality": QUALITY, "op8_substrings": SUBSTRINGS, "op12_suffixes": SUFFIXES, "op11_collocations": COLLOCATIONS, "op13_merkle": merkle()}

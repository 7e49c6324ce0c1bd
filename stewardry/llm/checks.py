"""Checking SQL for the operators of this folder that DuckDB can express on whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: CRC-32 remainders of the byte values, as one list.
_CRC_TABLE = """
crc_table AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS remainders
    FROM (SELECT unnest(range(0, 256)) AS i)
)"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes; the query reads crc_table."""
    digit = "(instr('0123456789ABCDEF', substr(hex(encode({text})), {at}, 1)) - 1)"
    high, low = digit.format(text=text, at="2 * p + 1"), digit.format(text=text, at="2 * p + 2")
    codes = f"list_transform(range(0, octet_length(encode({text}))), lambda p: 16 * {high} + {low})"
    step = "xor(c >> 8, remainders[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}), 4294967295)"


def _words(table: str) -> str:
    return rf"regexp_extract_all(translate({table}.text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


IMPORTANCE = f"""
WITH {_CRC_TABLE},
docs AS (SELECT doc_id, row_number() OVER () AS n, coalesce({_words("documents")}, []) AS words FROM documents),
used AS (SELECT n, word, count(*) AS times FROM (SELECT n, unnest(words) AS word FROM docs) GROUP BY ALL),
wanted AS (SELECT word, count(*) AS times FROM (SELECT unnest({_words("benchmark")}) AS word FROM benchmark) GROUP BY ALL),
vocabulary AS (
    SELECT word, {_crc32("word")} % 10000 AS bucket
    FROM (SELECT word FROM used UNION SELECT word FROM wanted), crc_table
),
have AS (SELECT bucket, sum(times)::BIGINT AS s FROM used JOIN vocabulary USING (word) GROUP BY bucket),
want AS (SELECT bucket, sum(times)::BIGINT AS t FROM wanted JOIN vocabulary USING (word) GROUP BY bucket),
totals AS (SELECT coalesce((SELECT sum(s) FROM have), 0)::BIGINT + 10000 AS up, coalesce((SELECT sum(t) FROM want), 0)::BIGINT + 10000 AS down),
gains AS (
    SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * up)::DOUBLE / ((s + 1) * down)::DOUBLE))::BIGINT AS gain
    FROM have LEFT JOIN want USING (bucket), totals
),
weights AS (SELECT n, sum(times * gain)::BIGINT AS weight FROM used JOIN vocabulary USING (word) JOIN gains USING (bucket) GROUP BY n),
scored AS (
    SELECT doc_id, n, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM docs LEFT JOIN weights USING (n)
),
ranked AS (SELECT n, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS fit FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= fit * 10 // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (n)
"""


def _tree_levels(name: str, levels: int) -> str:
    """Tables ``{name}0``.. of nodes (tree, pos, digest, nodes of the tree on the level), and the siblings of each node."""
    parts = []
    for k in range(levels):
        parts.append(f"""
{name}_beside{k} AS (
    SELECT a.tree, a.pos,
        coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
        coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
    FROM {name}{k} a JOIN {name}{k} b ON a.tree = b.tree AND a.pos // 8 = b.pos // 8 WHERE a.nodes > 1 GROUP BY ALL
),
{name}{k + 1} AS (
    SELECT tree, pos // 8 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest, (nodes + 7) // 8 AS nodes
    FROM {name}{k} WHERE nodes > 1 GROUP BY tree, pos // 8, nodes
)""")
    tops = " UNION ALL ".join(f"SELECT tree, digest FROM {name}{k} WHERE nodes = 1" for k in range(levels + 1))
    return ",".join([*parts, f"\n{name}_tops AS ({tops})"])


def _folds(name: str, start: str, levels: int, tree: str, pos: str) -> str:
    """Tables ``{name}_fold0``.. that carry a digest and its siblings up, from ``start``."""
    parts, last = [], start
    for k in range(levels):
        parts.append(f"""
{name}_fold{k} AS (
    SELECT f.* REPLACE (
        CASE WHEN s.tree IS NULL THEN f.folded ELSE sha256(s.before || f.folded || s.after) END AS folded,
        f.siblings || coalesce(s.before || s.after, '') AS siblings
    )
    FROM {last} f LEFT JOIN {name}_beside{k} s ON s.tree = f.{tree} AND s.pos = f.{pos} // {8**k}
)""")
        last = f"{name}_fold{k}"
    return ",".join(parts)


def _merkle(levels: int = 8, upper: int = 3) -> str:
    """Unrolled to trees of up to 8 ** levels leaves and 8 ** upper trees."""

    def field(value: str) -> str:
        return f"coalesce(octet_length(encode({value}))::VARCHAR || ':' || {value}, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(field(v) for v in ('doc_id::VARCHAR', 'source', 'lang', 'n_chars::VARCHAR', text))})"

    return f"""
WITH {_CRC_TABLE},
rows AS (
    SELECT doc_id, lang, {leaf("text")} AS leaf, {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS lowered,
        coalesce({_crc32("doc_id::VARCHAR")} % 3 = 0, false) AS tampered
    FROM documents, crc_table
),
leaves AS (
    SELECT *, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS nodes
    FROM rows
),
low0 AS (SELECT tree, pos, leaf AS digest, nodes FROM leaves),
{_tree_levels("low", levels)},
high0 AS (SELECT 0 AS tree, tree AS pos, digest, count(*) OVER () AS nodes FROM low_tops),
{_tree_levels("high", upper)},
carried AS (
    SELECT doc_id, leaf, leaves.tree, pos, low_tops.digest AS subroot, high_tops.digest AS root, 0 AS zero,
        CASE WHEN tampered THEN lowered ELSE leaf END AS folded, '' AS siblings
    FROM leaves JOIN low_tops USING (tree), high_tops
),
{_folds("low", "carried", levels, "tree", "pos")},
{_folds("high", f"low_fold{levels - 1}", upper, "zero", "tree")},
levels AS (
    SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = root AS verified
    FROM high_fold{upper - 1}
)
SELECT * FROM levels
"""


MERKLE = _merkle()

"""DuckDB SQL of the queries that SQL can express."""

_BLANK = r"[\x20\x09-\x0D]"


def _merkle(levels: int = 12) -> str:
    """The trees of the sources and the tree above them, ``levels`` levels of each (3 ** levels nodes).
    A tree of one node stays as it is."""
    def field(x: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x} END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"({field(x)})" for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    lost = r"replace(text, chr(10), '')"
    # The low bit of crc32: eight shifts for each byte, the byte added at the first of them.
    crc = """list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1),
                 lambda p: [ascii(substr(doc_id::VARCHAR, p, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                 lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)))"""
    parts = [f"""
        d AS MATERIALIZED (SELECT doc_id, source, {field('source')} AS tree, {leaf('text')} AS leaf,
             CASE WHEN coalesce(xor({crc}, 4294967295) % 2 = 0, false) THEN {leaf(lost)} ELSE {leaf('text')} END AS f0 FROM documents),
        p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
        a0 AS (SELECT tree, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM p)"""]

    def climb(name: str) -> None:
        for k in range(levels):
            run = "OVER (PARTITION BY tree, i // 3 ORDER BY i ROWS BETWEEN"
            parts.append(f"""
        {name}s{k} AS MATERIALIZED (SELECT *, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
             coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k}),
        {name}{k + 1} AS MATERIALIZED (SELECT tree, i // 3 AS i, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h,
             (n + 2) // 3 AS n FROM {name}{k} GROUP BY tree, i // 3, n)""")

    def follow(name: str, rows: str, first: int) -> None:
        for k in range(levels):
            at = first + k
            before = f"{rows if k == 0 else f'w{at}'}"
            parts.append(f"""
        w{at + 1} AS MATERIALIZED (SELECT w.* REPLACE (w.i // 3 AS i, CASE WHEN s.n = 1 THEN w.f ELSE sha256(s.l || w.f || s.r) END AS f,
             w.proof || s.l || s.r AS proof) FROM {before} w JOIN {name}s{k} s ON w.{'tree' if name == 'a' else 'top'} = s.tree AND w.i = s.i)""")

    climb("a")
    parts.append(f"""
        src AS MATERIALIZED (SELECT x.source, x.tree, a.h, row_number() OVER (ORDER BY encode(x.source) NULLS FIRST) - 1 AS i
             FROM (SELECT DISTINCT source, tree FROM d) x JOIN a{levels} a ON a.tree = x.tree),
        b0 AS (SELECT '' AS tree, i, h, count(*) OVER () AS n FROM src)""")
    climb("b")
    parts.append("""
        w0 AS (SELECT doc_id, tree, leaf, i, f0 AS f, '' AS proof FROM p)""")
    follow("a", "w0", 0)
    parts.append(f"""
        v AS (SELECT w.doc_id, w.leaf, s.h AS subroot, '' AS top, s.i, w.f, w.proof FROM w{levels} w JOIN src s ON s.tree = w.tree)""")
    follow("b", "v", levels)
    return f"""
        WITH {','.join(parts)}
        SELECT w.doc_id, w.leaf, w.subroot, b.h AS root, sha256(w.proof) AS proof_sha256, w.f AS folded_root, w.f = b.h AS verified
        FROM w{2 * levels} w, b{levels} b"""


SQL = {
    "op5_exact_dedup": rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        h AS (SELECT doc_id, length(text) AS chars, sha256(regexp_replace(text, '{_BLANK}+', '', 'g')) AS text_sha256 FROM t),
        r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                     row_number() OVER w AS place
              FROM h WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r""",
    "op10_chat": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
                   UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        s AS (SELECT *, length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) AS chars,
                     length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) AS role_chars,
                     lag(role) OVER w IS NOT DISTINCT FROM role AS follows,
                     lead(role) OVER w IS NOT DISTINCT FROM role AS goes_on
              FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars + CASE WHEN follows THEN 0 ELSE 7 + role_chars END + CASE WHEN goes_on THEN 8 ELSE 9 END)::BIGINT
                   AS formatted_chars
        FROM s GROUP BY conv_id""",
    "op13_merkle": _merkle(),
}

"""SQL forms of the queries that SQL can express; they compare everything with everything."""

from __future__ import annotations

_WORDS = r"""
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""

# words of every document, numbered from 1
_NUMBERED = f"""
    cut AS (SELECT doc_id, text, {_WORDS} AS ws FROM documents),
    word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM cut)"""


def _windows(width: int) -> str:
    return f"""
    run AS (
        SELECT doc_id, i, string_agg(w, ' ') OVER f AS g, count(*) OVER f AS n FROM word
        WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING))"""


# smallest id that links between different ids reach; `link` has both directions
_COMPONENTS = """
    reach(a, b) AS (
        SELECT a, b FROM link
        UNION
        SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)"""

# CRC-32 (reflected, 0xEDB88320): a table of one entry per byte, made by its rule, and a fold over the bytes
_CRC_TABLE = """
    crc_step(v, k, c) AS (
        SELECT range, 0, range FROM range(256)
        UNION ALL
        SELECT v, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_step WHERE k < 8),
    crc AS (SELECT list(c ORDER BY v) AS entry FROM crc_step WHERE k = 8)"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of `text`; needs a FROM with `crc`."""
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(1, length({digits}), 2), lambda i: CAST('0x' || substr({digits}, i, 2) AS BIGINT))"
    return f"""xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}),
        lambda r, o: xor(r >> 8, entry[CAST((xor(r, o) & 255) + 1 AS BIGINT)])))"""


_MARKS = "!?.,;:|#$%&*<>@~^=+_/\\\"()[]{}"


def _without(text: str, characters: str) -> str:
    quoted = characters.replace("'", "''")
    return f"length(translate({text}, '{quoted}', ''))"


def _line_fails() -> str:
    from .quality_rules import BOILERPLATE

    bars = f"(length(x) - {_without('x', '|•»›')})"
    words = r"len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))"
    phrases = " OR ".join("contains(lower(x), '{}')".format(p.replace("'", "''")) for p in BOILERPLATE)
    ending = r"""[.!?:;…"''»”’)\]][\x20\x09-\x0D]*\z"""
    inner = r"\pL[.!?…]\x20"
    return f"""(({bars} * 4 >= {words} AND {bars} >= 2) OR ({bars} >= 1 AND {words} <= 6)
        OR (({phrases}) AND {words} <= 40)
        OR NOT (regexp_matches(x, '{ending}') OR regexp_matches(x, '{inner}'))
        OR (length(x) - {_without('x', _MARKS)}) > {words} * 0.6 + 3)"""


_BLANK = "translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')"



def _licenses() -> str:
    """Phrases by neighbours, templates by the distinct words within every run; no order of words is needed."""
    from .licenses import PHRASES, TEMPLATES, THRESHOLD, prepared, words_of

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    stands = " UNION ALL ".join(
        "SELECT doc_id, i, '{}' AS label FROM near WHERE {}".format(label, " AND ".join(f"w{j} = '{w.decode()}'" for j, w in enumerate(words_of(p))))
        for p, label in PHRASES.items()
    )
    longest = max(len(words_of(p)) for p in PHRASES)
    leads = ", ".join(f"lead(w, {j}) OVER f AS w{j}" for j in range(longest))
    rows = ", ".join(
        f"({k}, '{t.label}', '{w.decode()}', {len(t.words)}, {t.least}, {t.run})"
        for k, t in enumerate(prepared(TEMPLATES, {}, THRESHOLD))
        for w in t.words
    )
    return f"""
        WITH cut AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
                                              '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
        word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM cut),
        near AS (SELECT doc_id, i, {leads} FROM word WINDOW f AS (PARTITION BY doc_id ORDER BY i)),
        stand AS ({stands}),
        base AS (
            SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
                   list_sort(list(DISTINCT label)) AS found FROM stand GROUP BY doc_id),
        template(k, label, w, m, least, run) AS (VALUES {rows}),
        hit AS (SELECT doc_id, i, k, label, w, m, least, run FROM word JOIN template USING (w)),
        enough AS (SELECT doc_id, k FROM hit GROUP BY doc_id, k, least HAVING count(DISTINCT w) >= least),
        counted AS (
            SELECT doc_id, label, least, m, count(DISTINCT w) OVER (
                PARTITION BY doc_id, k ORDER BY i RANGE BETWEEN run - 1 PRECEDING AND CURRENT ROW) AS n
            FROM hit SEMI JOIN enough USING (doc_id, k)),
        block AS (
            SELECT doc_id, list(DISTINCT label) AS found, max(CAST(n AS DOUBLE) / m) AS share
            FROM counted WHERE n >= least GROUP BY doc_id)
        SELECT cut.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce(array_to_string(base.found, ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.found, []), coalesce(block.found, [])))), ','), '') AS labels,
               CASE WHEN base.found IS NOT NULL THEN 1.0 ELSE coalesce(share, 0.0) END AS score
        FROM cut LEFT JOIN base ON cut.doc_id = base.doc_id LEFT JOIN block ON cut.doc_id = block.doc_id"""


def _secrets() -> str:
    from .secrets import BASE, RULES

    found = " UNION ALL ".join(
        f"""
        SELECT doc_id, '{r.kind}' AS kind, {k} AS place, {r.least} AS least,
               unnest(range(1, len(regexp_extract_all(text, '{p}')) + 1)) AS i,
               unnest(string_split_regex(text, '{p}')) AS gap, unnest(regexp_extract_all(text, '{p}')) AS m,
               unnest(regexp_extract_all(text, '{p}', {r.group})) AS v
        FROM documents WHERE regexp_matches(text, '{p}')"""
        for k, r in enumerate(RULES)
        for p in [r.pattern.replace("'", "''")]
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    zeros = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)
    return f"""
        WITH cut AS ({found}),
        placed AS (
            SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, place ORDER BY i) AS e FROM cut WHERE i IS NOT NULL),
        span AS (
            SELECT *, e - length(m) AS s, kind || ':' || CAST(e - length(m) AS BIGINT) || ':' || CAST(e AS BIGINT) AS t
            FROM placed WHERE length(v) >= least),
        listed AS (
            SELECT doc_id, {counts}, string_agg(t, ',' ORDER BY s, place) FILTER (place < {len(BASE)}) AS base,
                   string_agg(t, ',' ORDER BY s, place) AS spans
            FROM span GROUP BY doc_id)
        SELECT documents.doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents LEFT JOIN listed ON documents.doc_id = listed.doc_id"""


def _bottom_k() -> str:
    """Sketches by SQL: 64-bit arithmetic is done in wider numbers and cut."""
    from .fingerprints import K, MULTIPLIER, SCRAMBLE, SIZE

    def sketches(source: str, text: str) -> str:
        step = "CAST(0 AS HUGEINT)"
        for i in range(SIZE):
            value = f"lead(h, {i}) OVER f"
            step = f"CASE WHEN {value} IS NULL THEN {step} ELSE ({step} * {MULTIPLIER} + {value}) % 18446744073709551616 END"
        mixed = f"(CAST(xor(p, p >> 32) AS HUGEINT) * {SCRAMBLE}) % 18446744073709551616"
        return f"""
            SELECT place, list(DISTINCT v ORDER BY v)[1:{K}] AS s FROM (
                SELECT place, xor(q, q >> 29) AS v FROM (
                    SELECT place, CAST({mixed} AS UBIGINT) AS q FROM (
                        SELECT place, CAST(p AS UBIGINT) AS p, i, many FROM (
                            SELECT place, i, many, {step} AS p FROM (
                                SELECT place, i, many, CAST('0x' || left(md5(w), 16) AS UBIGINT) AS h FROM (
                                    SELECT place, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS many
                                    FROM (SELECT place, {_WORDS.replace('text', text)} AS ws FROM {source})))
                            WINDOW f AS (PARTITION BY place ORDER BY i))
                        WHERE i = 1 OR i <= many - {SIZE - 1})))
            GROUP BY place"""

    def encoded(s: str) -> str:
        return f"to_base64(unhex(list_aggregate(list_transform(coalesce({s}, []), lambda x: format('{{:016x}}', x)), 'string_agg', '')))"

    def alike(a: str, b: str) -> str:
        union = f"list_sort(list_distinct(list_concat(coalesce({a}, []), coalesce({b}, []))))[1:{K}]"
        both = f"list_filter({union}, lambda x: list_contains({a}, x) AND list_contains({b}, x))"
        return f"CASE WHEN len({union}) = 0 THEN 1.0 ELSE CAST(len({both}) AS DOUBLE) / len({union}) END"

    return f"""
        WITH placed AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(coalesce(text, ''))) AS place, count(*) OVER () AS many FROM documents),
        paired AS (
            SELECT l.*, r.place AS next, left(l.text, length(l.text) - length(l.text) // 2) || left(r.text, length(l.text) // 2) AS edited
            FROM placed l JOIN placed r ON r.place = l.place % l.many + 1),
        plain AS ({sketches('placed', 'text')}),
        changed AS ({sketches('paired', 'edited')})
        SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, {encoded('x.s')} AS fingerprint,
               {encoded('y.s')} AS edited_fingerprint, {alike('x.s', 'y.s')} AS near_edited, {alike('x.s', 'z.s')} AS near_next
        FROM paired LEFT JOIN plain x ON x.place = paired.place LEFT JOIN changed y ON y.place = paired.place LEFT JOIN plain z ON z.place = next"""


SQL = {
    "op11_bottom_k": _bottom_k(),
    "op5_license_join": _licenses(),
    "op6_secret_ledger": _secrets(),
    "op1_anchor_repeats": f"""
        WITH {_NUMBERED}, {_windows(35)},
        twice AS (SELECT g FROM run WHERE n = 35 GROUP BY g HAVING count(*) > 1),
        gone AS (
            SELECT doc_id, list(DISTINCT i + k) AS spots
            FROM (SELECT doc_id, i FROM run SEMI JOIN twice USING (g) WHERE n = 35), range(35) t(k) GROUP BY doc_id),
        marked AS (SELECT doc_id, i, w, list_contains(spots, i) AS dropped FROM word LEFT JOIN gone USING (doc_id)),
        kept AS (
            SELECT doc_id, count(*) AS n_words, count(*) FILTER (dropped) AS n_removed,
                   string_agg(w, ' ' ORDER BY i) FILTER (dropped IS NOT true) AS text
            FROM marked GROUP BY doc_id)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM documents LEFT JOIN kept USING (doc_id)""",
    "op7_line_rules": f"""
        WITH {_NUMBERED}, {_windows(5)},
        often AS (SELECT doc_id, g FROM run WHERE n = 5 GROUP BY doc_id, g HAVING count(*) > 1),
        repeated AS (
            SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
            FROM (SELECT doc_id, i FROM run SEMI JOIN often USING (doc_id, g) WHERE n = 5), range(5) t(k) GROUP BY doc_id),
        lines AS (
            SELECT doc_id, ws, coalesce(text, '') AS text,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length({_BLANK}) > 0) AS ls FROM cut),
        counted AS (
            SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
                   CAST(list_sum(list_concat([0], list_transform(ws, lambda x: length(x)))) AS BIGINT) AS word_chars,
                   length(text) - {_without('text', '#*$%&|<>')} AS n_symbols,
                   CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words,
                   list_sum(list_concat([0], list_transform(list_filter(ls, lambda x: NOT {_line_fails()}), lambda x: length({_BLANK})))) AS rest
            FROM lines LEFT JOIN repeated USING (doc_id)),
        judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
        SELECT * EXCLUDE (rest), NOT base_failed AND 1 - rest / word_chars <= 0.5 AS kept FROM judged""",
    "op9_projection_forest": f"""
        WITH RECURSIVE usable AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        link AS (
            SELECT l.vec_id AS a, r.vec_id AS b FROM usable l JOIN usable r
            ON l.label = r.label AND l.vec_id <> r.vec_id AND len(l.v) = len(r.v) AND list_cosine_similarity(l.v, r.v) >= 0.93),
        {_COMPONENTS},
        least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
        linked AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id,
               vec_id = least(vec_id, coalesce(least.b, vec_id)) AS kept
        FROM embeddings LEFT JOIN least ON vec_id = least.a LEFT JOIN linked ON vec_id = linked.a""",
    "op10_prefix_trees": f"""
        WITH RECURSIVE lowered AS (
            SELECT doc_id, list_transform({_WORDS},
                   lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
        word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS many FROM lowered),
        run AS (
            SELECT doc_id, i, many, string_agg(w, ' ') OVER f AS g, count(*) OVER f AS n FROM word
            WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
        shingle AS (SELECT DISTINCT doc_id, n, g FROM run WHERE n = 3 OR (many < 3 AND i = 1)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
        shared AS (
            SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS common FROM shingle l JOIN shingle r
            ON l.g = r.g AND l.n = r.n AND l.doc_id <> r.doc_id GROUP BY ALL),
        link AS (
            SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
            WHERE 100 * common >= 90 * (x.n + y.n - common)),
        {_COMPONENTS},
        least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, least(documents.doc_id, coalesce(b, documents.doc_id)) AS component_id
        FROM documents LEFT JOIN sizes ON documents.doc_id = sizes.doc_id LEFT JOIN least ON documents.doc_id = a""",
    "op12_double_arrays": f"""
        WITH RECURSIVE {_CRC_TABLE},
        keyed AS (
            SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS b
            FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, k, b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS i FROM keyed),
        ids AS (SELECT DISTINCT conv_id FROM own),
        conv AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM ids, crc),
        rebuilt AS (
            SELECT conv.conv_id, i, k, b FROM conv JOIN own ON own.conv_id = base AND i <= h
            UNION ALL SELECT conv_id, i, k, b FROM conv JOIN own USING (conv_id) WHERE i > h),
        prefix AS (
            SELECT conv_id, b, row_number() OVER f AS depth, md5(string_agg(k, '') OVER f) AS node FROM rebuilt
            WINDOW f AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        member AS (
            SELECT conv_id, b, depth, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), '') AS parent FROM prefix
            UNION ALL SELECT conv_id, 0, 0, '', NULL FROM conv),
        node AS (
            SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, any_value(b) AS b, min(conv_id) AS conv_id, count(*) AS n
            FROM member GROUP BY node),
        child AS (SELECT parent, count(*) AS n FROM node WHERE parent IS NOT NULL GROUP BY parent),
        last AS (SELECT conv_id, arg_max(node, depth) AS node FROM member GROUP BY conv_id),
        ended AS (SELECT node, string_agg(conv_id, ',' ORDER BY conv_id) AS ids FROM last GROUP BY node),
        under AS (SELECT DISTINCT u.node AS top, v.node AS node FROM member u JOIN member v ON u.conv_id = v.conv_id AND v.depth >= u.depth),
        summed AS (
            SELECT top, count(*) FILTER (child.n IS NULL) AS n_leaves, sum((node.n - 1) * b) AS saved
            FROM under JOIN node USING (node) LEFT JOIN child ON child.parent = node.node GROUP BY top)
        SELECT node.conv_id, node.depth, up.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(child.n, 0) AS n_children, n_leaves,
               CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM node JOIN summed ON top = node.node LEFT JOIN node up ON up.node = node.parent
        LEFT JOIN child ON child.parent = node.node LEFT JOIN ended ON ended.node = node.node""",
    # near words meet as equal strings once a letter is taken out of the longer one, or the same place out of both
    "op13_spelling_variants": f"""
        WITH RECURSIVE {_CRC_TABLE},
        run AS (
            SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents),
        counted AS (SELECT id, w, count(*) AS n FROM run GROUP BY ALL),
        numbered AS (SELECT w, n, {_crc32("id || ':' || w")} AS h FROM counted, crc),
        changed AS (
            SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM numbered),
        word AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        short AS (
            SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
            FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM word)),
        pair AS (
            SELECT l.word AS a, r.word AS b, r.n FROM short l JOIN short r ON l.rest = r.rest AND l.i = r.i AND l.word <> r.word
            UNION SELECT short.word, word.word, word.n FROM short JOIN word ON rest = word.word
            UNION SELECT word.word, short.word, short.n FROM short JOIN word ON rest = word.word),
        best AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS b, max(n) AS top FROM pair GROUP BY a),
        chosen AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN b END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n
            FROM word LEFT JOIN best ON word = a),
        walk(word, root) AS (
            SELECT word, word FROM chosen
            UNION ALL SELECT walk.word, form FROM walk JOIN chosen ON walk.root = chosen.word WHERE form IS NOT NULL),
        last AS (SELECT walk.word, root FROM walk JOIN chosen ON root = chosen.word WHERE form IS NULL)
        SELECT chosen.*, root FROM chosen JOIN last ON chosen.word = last.word""",
}

"""The same results in DuckDB's SQL, written from the definitions."""

from __future__ import annotations

from sparkquill.llm import merkle, mixing, quality

WORD = r"'[^\x20\x09-\x0D]+'"


def base_stats(source: str = "documents") -> str:
    """CTEs up to `base`: every row of `source` with its base statistics."""
    return f"""
    texts AS (SELECT row_number() OVER () rid, *, coalesce(text, '') t,
                     regexp_extract_all(coalesce(text, ''), {WORD}) w FROM {source}),
    tri AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g
            FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) i FROM texts WHERE len(w) >= 3)),
    again AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
    cover AS (SELECT rid, count(DISTINCT j) n FROM (SELECT rid, unnest([i, i + 1, i + 2]) j FROM again) GROUP BY rid),
    counted AS (SELECT texts.*, len(w)::BIGINT n_words, length(array_to_string(w, ''))::BIGINT word_chars,
                (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT n_symbols,
                (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORD})))
                 - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORD})))))::BIGINT n_dup_lines,
                coalesce(cover.n, 0)::BIGINT n_repeat_words FROM texts LEFT JOIN cover USING (rid)),
    base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)"""


def judged(source: str = "documents") -> str:
    """CTEs up to `judged`: kept and d2 of every row."""
    names, floors, priors = list(quality.DIMS), list(quality.DIMS.values()), [quality.PRIOR[c] for c in quality.DIMS]
    d = range(len(names))
    pairs = [(i, j) for i in d for j in range(i + 1)]
    estimates = [*[f"m_{i}" for i in d], *[f"l_{i}_{j}" for i, j in pairs], "logdet"]
    rate = lambda c, by: f"ln(1 + 100.0::DOUBLE * {c} / {by})"
    chars, n = "greatest(word_chars, 1)::DOUBLE", "greatest(n_words, 1)::DOUBLE"
    x = [f"ln({n})", f"ln({chars} / {n})", rate("n_symbols", chars), rate("n_dup_lines", n), rate("n_repeat_words", n)]
    out = base_stats(source) + ", vec AS MATERIALIZED (SELECT *, " + ", ".join(f"{e} AS {c}" for e, c in zip(x, names, strict=True)) + " FROM base)"
    out += ", fit AS MATERIALIZED (SELECT lang, source, " + ", ".join(names) + " FROM vec WHERE NOT base_failed)"
    each = " UNION ALL ".join(f"SELECT lang, source, {i} dim, floor({c} * {quality.STAT_BINS}) bin FROM fit" for i, c in enumerate(names))
    out += f""", bins AS (SELECT lang, source, dim, bin, count(*) n FROM ({each}) GROUP BY ALL),
    quarts AS (SELECT lang, source, dim, {', '.join(f'max(CASE WHEN 4 * (run - n) < {q} * tot THEN (bin + 0.5::DOUBLE) / {quality.STAT_BINS} END) q{q}' for q in (1, 2, 3))}
        FROM (SELECT *, sum(n) OVER w run, sum(n) OVER (PARTITION BY lang, source, dim) tot FROM bins
              WINDOW w AS (PARTITION BY lang, source, dim ORDER BY bin ROWS UNBOUNDED PRECEDING)) GROUP BY ALL),
    wide AS (SELECT lang, source, {', '.join(f'max(CASE WHEN dim = {i} THEN q{q} END) q{q}_{i}' for q in (1, 2, 3) for i in d)} FROM quarts GROUP BY lang, source)"""
    spread = [f"{v}::DOUBLE" for v in priors]
    inner = [f"greatest({floors[i]}::DOUBLE, (q3_{i} - q1_{i}) / 1.35::DOUBLE)" for i in d]
    first = lambda k, q, scale: f"SELECT lang, source, {k} AS st, {', '.join(f'q{q}_{i} AS m_{i}' for i in d)}, {', '.join(f'{scale[i] if i == j else 0.0}::DOUBLE AS l_{i}_{j}' for i, j in pairs)}, 'infinity'::DOUBLE AS logdet FROM wide"
    out += ", p0 AS MATERIALIZED (" + " UNION ALL ".join([first(0, 2, spread), first(1, 2, inner), first(2, 1, spread), first(3, 3, spread)]) + ")"

    def distance(rows: str, params: str, how: str) -> str:
        sql = f"SELECT v.*, p.* EXCLUDE (lang, source) FROM {rows} v {how} JOIN {params} p ON v.lang IS NOT DISTINCT FROM p.lang AND v.source IS NOT DISTINCT FROM p.source"
        for i in d:
            sql = f"SELECT *, ({names[i]} - m_{i}" + "".join(f" - l_{i}_{q} * y_{q}" for q in range(i)) + f") / l_{i}_{i} AS y_{i} FROM ({sql})"
        return f"SELECT *, {' + '.join(f'y_{i} * y_{i}' for i in d)} AS d2 FROM ({sql})"

    for k in range(quality.STEPS):
        gaps = [f"({names[i]} - m_{i})" for i in d]
        out += f""", b{k} AS (SELECT lang, source, st, floor(ln(1 + d2) * {quality.DIST_BINS}) bin, count(*) n, {', '.join(f'sum({gaps[i]}) s_{i}, first(m_{i}) o_{i}' for i in d)},
                 {', '.join(f'sum({gaps[i]} * {gaps[j]}) q_{i}_{j}' for i, j in pairs)} FROM ({distance('fit', f'p{k}', 'INNER')}) GROUP BY lang, source, st, bin),
        h{k} AS (SELECT lang, source, st, sum(n)::DOUBLE h, {', '.join(f'sum(s_{i}) s_{i}, first(o_{i}) o_{i}' for i in d)}, {', '.join(f'sum(q_{i}_{j}) q_{i}_{j}' for i, j in pairs)}
                 FROM (SELECT *, sum(n) OVER w run, sum(n) OVER (PARTITION BY lang, source, st) tot FROM b{k}
                       WINDOW w AS (PARTITION BY lang, source, st ORDER BY bin ROWS UNBOUNDED PRECEDING)) WHERE 2 * (run - n) < tot GROUP BY lang, source, st)"""
        cov = {}
        for i, j in pairs:
            cov[i, j] = f"{quality.CONSISTENCY}::DOUBLE * (q_{i}_{j} / h - (s_{i} / h) * (s_{j} / h))"
            if i == j:
                least = floors[i] ** 2
                cov[i, j] = f"greatest({cov[i, j]}, {least}::DOUBLE) + {quality.RIDGE * least}::DOUBLE + {priors[i] ** 2 * quality.PRIOR_ROWS}::DOUBLE / h"
        sql = f"SELECT *, {', '.join(f'o_{i} + s_{i} / h AS m_{i}' for i in d)}, " + ", ".join(f"{cov[i, j]} AS c_{i}_{j}" for i, j in pairs) + f" FROM h{k}"
        for i, j in pairs:
            rest = f"c_{i}_{j}" + "".join(f" - l_{i}_{q} * l_{j}_{q}" for q in range(j))
            sql = f"SELECT *, {f'sqrt({rest})' if i == j else f'({rest}) / l_{j}_{j}'} AS l_{i}_{j} FROM ({sql})"
        sql = f"SELECT *, 2 * ({' + '.join(f'ln(l_{i}_{i})' for i in d)}) AS logdet FROM ({sql})"
        falls = f"a.logdet < o.logdet - {quality.FALL}"
        out += f""", p{k + 1} AS MATERIALIZED (SELECT o.lang, o.source, o.st, {', '.join(f'CASE WHEN {falls} THEN a.{c} ELSE o.{c} END AS {c}' for c in estimates)}
            FROM p{k} o JOIN ({sql}) a ON o.lang IS NOT DISTINCT FROM a.lang AND o.source IS NOT DISTINCT FROM a.source AND o.st = a.st)"""
    out += f""", best AS MATERIALIZED (SELECT * FROM p{quality.STEPS} QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY round(logdet, 6), st) = 1)"""
    return out + f", judged AS (SELECT *, coalesce(NOT base_failed AND d2 <= {quality.CUTOFF}, false) AS kept FROM ({distance('vec', 'best', 'LEFT')}))"


def quality_rules() -> str:
    return f"WITH {judged()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"


def fingerprints() -> str:
    """From the definition: nodes in full at every level, likeness by counting, edits by comparing lines and pieces."""
    piece = merkle.PIECE.replace("\\n", "\n").replace("\\t", "\t")
    w = merkle.WINDOW
    cut = f"regexp_matches(md5(k[i - {w - 1}:i]), '^{merkle.CUT}')"
    parted = f"list_filter(string_split(array_to_string([k[i:i] || CASE WHEN i >= {w} AND {cut} THEN chr(10) ELSE '' END for i in range(1, length(k) + 1)], ''), chr(10)), lambda y: y <> '')"
    blocks = f"[x[i:i + {merkle.BLOCK - 1}] for i in range(1, length(x) + 1, {merkle.BLOCK})]"
    by_windows = f"flatten(list_transform(zs, lambda x: CASE WHEN length(x) <= {merkle.UNBROKEN} THEN [x] ELSE flatten(list_transform({blocks}, lambda k: {parted})) END))"
    marked = f"list_transform(regexp_extract_all(x, '{merkle.WORD}'), lambda o: o || CASE WHEN regexp_matches(md5(o), '^{merkle.WORD_CUT}') THEN chr(10) ELSE '' END)".replace("\\t", "\t")
    words = f"list_filter(string_split(array_to_string({marked}, ''), chr(10)), lambda y: y <> '')"
    small = f"CASE WHEN length(x) <= {merkle.LONG} THEN [x] ELSE {by_windows.replace('zs', words)} END"
    split = f"flatten(list_transform(regexp_extract_all(p, '{piece}'), lambda x: {small}))"
    ends = "CASE WHEN h[1] IN ('0', '1') THEN '/' ELSE ';' END"
    order = "ORDER BY doc_id DESC NULLS LAST, text"
    near = lambda x: f"CASE WHEN a.root = {x}.root THEN 1.0::DOUBLE ELSE least(round(2.0::DOUBLE * coalesce(s{x}.n, 0) / greatest(a.n + {x}.n, 1), 6), {merkle.NOT_EQUAL}) END"
    shared = lambda x: f"(SELECT a.rid, sum(least(a.n, o.n)) n FROM counts a JOIN counts o USING (rid, item) WHERE a.w = 'a' AND o.w = '{x}' GROUP BY a.rid)"
    first_gap = lambda x, y: f"coalesce(list_min([i for i in range(1, greatest(len({x}), len({y})) + 1) if {x}[i] IS DISTINCT FROM {y}[i]]) - 1, greatest(len({x}), len({y})))"
    both_gaps = lambda x, y, name: f"{first_gap(x, y)} {name}_head, {first_gap(f'list_reverse({x})', f'list_reverse({y})')} {name}_tail"
    tail = lambda name, x, y: f"(CASE WHEN a.root = b.root THEN -1 ELSE greatest(0, least({name}_tail, least(len({x}), len({y})) - {name}_head)) END)::BIGINT"
    return f"""WITH docs AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') AS text FROM documents),
    nexts AS (SELECT *, coalesce(lead(text) OVER ({order}), first(text) OVER ({order})) next_text FROM docs),
    edits AS MATERIALIZED (SELECT *, text[:length(text) - length(text) // 3] || next_text[:length(text) // 3] AS edited FROM nexts),
    texts AS (SELECT rid, 'a' w, text t FROM edits UNION ALL SELECT rid, 'b', edited FROM edits UNION ALL SELECT rid, 'c', next_text FROM edits),
    leaves AS (SELECT *, list_transform(string_split(t, chr(10)), lambda p: list_transform({split}, lambda y: md5(y))) ls FROM texts),
    nodes AS (SELECT *, list_transform(ls, lambda x: md5(array_to_string(x, ','))) ns FROM leaves),
    trees AS MATERIALIZED (SELECT rid, w, md5(array_to_string(list_transform(string_split(array_to_string(list_transform(ns, lambda h: h || {ends}), ''), '/'), lambda x: md5(x)), '/')) root,
        array_to_string(list_transform(list_zip(ls, ns), lambda z: array_to_string(list_transform(z[1], lambda x: x[:{merkle.LEAF}]), ',') || CASE WHEN z[2][1] IN ('0', '1') THEN '/' ELSE ';' END), '') tree,
        list_transform(flatten(ls), lambda x: x[:{merkle.LEAF}]) flat, 2 * len(flatten(ls)) n FROM nodes),
    counts AS MATERIALIZED (SELECT rid, w, item, count(*) n FROM (SELECT rid, w, unnest(flat) item FROM trees
        UNION ALL SELECT rid, w, unnest([flat[i] || ' ' || coalesce(flat[i + 1], '$') for i in range(1, len(flat) + 1)]) FROM trees) GROUP BY ALL),
    lines AS (SELECT edits.rid, string_split(text, chr(10)) x, string_split(edited, chr(10)) y, a.flat u, b.flat v FROM edits JOIN trees a ON a.rid = edits.rid AND a.w = 'a' JOIN trees b ON b.rid = edits.rid AND b.w = 'b'),
    gaps AS (SELECT rid, x, y, u, v, {both_gaps('x', 'y', 'line')}, {both_gaps('u', 'v', 'leaf')} FROM lines)
    SELECT doc_id, length(text)::BIGINT n_chars, sha256(edited) edited_sha256, a.root || ':' || a.tree fingerprint, b.root || ':' || b.tree edited_fingerprint,
        {near('b')} near_edited, {near('c')} near_next, (CASE WHEN a.root = b.root THEN -1 ELSE line_head END)::BIGINT edit_first, {tail('line', 'x', 'y')} edit_last,
        (CASE WHEN a.root = b.root THEN -1 ELSE leaf_head END)::BIGINT piece_first, {tail('leaf', 'u', 'v')} piece_last
    FROM edits JOIN trees a ON a.rid = edits.rid AND a.w = 'a' JOIN trees b ON b.rid = edits.rid AND b.w = 'b' JOIN trees c ON c.rid = edits.rid AND c.w = 'c'
        JOIN gaps ON gaps.rid = edits.rid LEFT JOIN {shared('b')} sb ON sb.rid = edits.rid LEFT JOIN {shared('c')} sc ON sc.rid = edits.rid"""


def source_mixing(entropy: float, max_repeats: float, seed: int, source: str = "documents") -> str:
    w = "list_transform(ps, lambda p: pow(p, mid) / list_sum(list_transform(ps, lambda q: pow(q, mid))))"
    h = f"-list_sum(list_transform({w}, lambda x: x * ln(x)))"
    ratio = "list_transform(ps, lambda p: pow(p, mid) / p)"
    reps = f"list_max({ratio}) / list_min({ratio})"

    def search(name: str, low: str) -> str:
        return f"""{name} AS (SELECT 0 i, 0.0::DOUBLE lo, 1.0::DOUBLE hi UNION ALL
            SELECT i + 1, CASE WHEN {low} THEN mid ELSE lo END, CASE WHEN {low} THEN hi ELSE mid END
            FROM (SELECT i, lo, hi, (lo + hi) / 2 mid, ps, goal FROM {name}, one) WHERE i < {mixing.ROUNDS})"""

    return f"""WITH RECURSIVE tok AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORD}))::BIGINT n_tokens FROM {source}),
    tot AS (SELECT source, sum(n_tokens)::BIGINT t FROM tok GROUP BY source HAVING sum(n_tokens) > 0),
    one AS (SELECT list(t::DOUBLE / (SELECT sum(t) FROM tot)::DOUBLE ORDER BY source NULLS FIRST) ps, {entropy}::DOUBLE * ln(count(*)::DOUBLE) goal FROM tot HAVING count(*) > 0),
    {search('ent', h + ' > goal')}, {search('rep', reps + f' > {max_repeats}')},
    e AS (SELECT round(greatest((SELECT hi FROM ent WHERE i = {mixing.ROUNDS}), (SELECT hi FROM rep WHERE i = {mixing.ROUNDS})), {mixing.DIGITS}) mid),
    wts AS (SELECT source, t, round(pow(t::DOUBLE / (SELECT sum(t) FROM tot)::DOUBLE, mid) / (SELECT list_sum(list_transform(ps, lambda q: pow(q, mid))) FROM one), {mixing.DIGITS}) w FROM tot, e),
    plan AS (SELECT source, t, greatest(floor(w * budget), 1)::BIGINT target, ceil(budget / {mixing.BLOCK_TOKENS}) blocks FROM wts, (SELECT ceil(max(t / w)) budget FROM wts)),
    ep AS (SELECT tok.*, t, target, blocks, unnest(range(0, (target - 1) // t + 1)) AS epoch FROM tok JOIN plan ON tok.source IS NOT DISTINCT FROM plan.source WHERE n_tokens > 0),
    k AS (SELECT *, md5('{seed}:' || epoch || ':' || coalesce(doc_id::VARCHAR, 'null')) sort_key FROM ep),
    r AS (SELECT *, epoch * t + sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY sort_key, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS "start" FROM k)
    SELECT floor("start"::DOUBLE / target::DOUBLE * blocks::DOUBLE)::BIGINT AS block, sort_key, doc_id, source, epoch::BIGINT AS epoch, n_tokens FROM r WHERE "start" < target"""


def token_rollup() -> str:
    lines = "array_to_string(list_distinct(string_split(coalesce(text, ''), chr(10))), chr(10))"
    return f"""WITH left_in AS (SELECT * FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)),
    both_versions AS (SELECT source, lang, 'words-1' AS version, len(regexp_extract_all({lines}, {WORD}))::BIGINT tokens FROM left_in
        UNION ALL SELECT source, lang, 'pieces-1', len(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]'))::BIGINT FROM left_in)
    SELECT source, lang, version, count(*)::BIGINT n_docs, sum(tokens)::BIGINT n_tokens FROM both_versions GROUP BY ALL"""


def ball_kmeans(k: int = 8, rounds: int = 10, width: int = 64, seed: int = 3) -> str:
    """Plain Lloyd rounds: every vector against every centroid."""
    gap = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    out = f"""WITH vecs AS MATERIALIZED (SELECT row_number() OVER () rid, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) x FROM embeddings
        WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {width}),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS j, x FROM vecs QUALIFY j < {k})"""
    for i in range(rounds + 1):
        out += f""", a{i} AS MATERIALIZED (SELECT v.rid, v.vec_id, v.x, c.j, {gap} d FROM vecs v, c{i} c QUALIFY row_number() OVER (PARTITION BY v.rid ORDER BY {gap}, c.j) = 1)"""
        if i < rounds:
            out += f""", c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) x FROM c{i} c LEFT JOIN (SELECT j, list(floor_mean ORDER BY dim) x FROM
                (SELECT j, dim, (sum(e) - (((sum(e) % count(*)) + count(*)) % count(*)))::BIGINT // count(*) AS floor_mean FROM (SELECT j, unnest(x) e, unnest(range({width})) dim FROM a{i}) GROUP BY j, dim) GROUP BY j) m USING (j))"""
    return out + f""" SELECT vec_id, j::INTEGER AS "cluster", d AS distance, sum(d) OVER (PARTITION BY j)::BIGINT cluster_inertia, sum(d) OVER ()::BIGINT inertia, sha256(array_to_string(c.x, ',')) centroid_sha256
        FROM a{rounds} JOIN c{rounds} c USING (j)"""


def prefix_trie(block: int = 100, heads: int = 6) -> str:
    """Beginnings as lists, subtrees by comparing every node with every other; crc32 bit by bit."""
    bit = "lambda b, _: xor(b >> 1, CASE WHEN b & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"lambda s, x: list_reduce(range(8), {bit}, xor(s, x))"
    crc = f"xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT), {byte}, 4294967295), 4294967295)"
    turn = "{'r': coalesce(role, ''), 't': coalesce(text, '')}"
    digest = "sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"
    return f"""WITH own AS (SELECT conv_id, list({turn} ORDER BY turn NULLS FIRST, {digest}) x FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    withh AS (SELECT *, {crc} % {heads} h FROM own),
    built AS MATERIALIZED (SELECT a.conv_id, coalesce(b.x[:a.h], []) || a.x[a.h + 1:] x FROM withh a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % {block}),
    paths AS MATERIALIZED (SELECT conv_id, x[:d] p, d, len(x) = d AS ended FROM (SELECT *, unnest(range(0, len(x) + 1)) d FROM built)),
    nodes AS MATERIALIZED (SELECT p, any_value(d) d, min(conv_id) conv_id, count(*) n, coalesce(sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended)), sha256('')) ends FROM paths GROUP BY p),
    kids AS MATERIALIZED (SELECT v.*, (SELECT count(*) FROM nodes u WHERE u.d = v.d + 1 AND u.p[:v.d] = v.p) kids, (SELECT conv_id FROM nodes u WHERE u.d = v.d - 1 AND u.p = v.p[:v.d - 1]) parent FROM nodes v)
    SELECT v.conv_id, v.d AS "depth", any_value(v.parent) parent_conv_id, any_value(v.n) n_convs, any_value(v.kids)::BIGINT n_children,
        count(*) FILTER (u.kids = 0)::BIGINT n_leaves, sum((u.n - 1) * coalesce(length(u.p[-1].t), 0))::BIGINT saved_tokens, any_value(v.ends) ends_sha256
    FROM kids v JOIN kids u ON u.d >= v.d AND u.p[:v.d] = v.p GROUP BY v.p, v.conv_id, v.d"""

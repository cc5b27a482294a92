"""The queries' results in DuckDB's SQL, written from the operators' definitions."""

from __future__ import annotations

from sparkquill.functions import text as T
from sparkquill.operators.context import PLAIN, STRICT
from sparkquill.operators.evaluate import WEIGHTS
from sparkquill.plans.queries import PART, QUERY, TABLE_HEAD, K

CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def tokens(x: str) -> str:
    apart = rf"regexp_replace(regexp_replace(coalesce({x}, ''), '([\p{{L}}_]\p{{M}}*)[''’.:·,;](\p{{N}})', '\1 \2', 'g'), '(\p{{N}}\p{{M}}*)[''’.:·](\p{{L}})', '\1 \2', 'g')"
    words = rf"regexp_extract_all({apart}, '[\p{{Han}}\p{{Hiragana}}]|[\p{{L}}\p{{M}}\p{{N}}_]+(?:[''’.:·][\p{{L}}][\p{{L}}\p{{M}}\p{{N}}_]*|[''’.,;][\p{{N}}][\p{{L}}\p{{M}}\p{{N}}_]*)*')"
    return rf"list_transform(list_filter({words}, lambda w: (length(w) > 1 AND regexp_matches(w, '[\p{{L}}\p{{N}}]')) OR regexp_matches(w, '^[0-9b-hj-zB-HJ-Z{CJK}]$')), lambda w: lower(w))"


def sentences(x: str) -> str:
    parts = f"list_transform(regexp_extract_all(coalesce({x}, ''), '[^.?!。]*[.?!。]|[^.?!。]+$'), lambda s: {trim('s')})"
    return f"list_filter({parts}, lambda s: strlen(s) > 1 OR (length(s) > 0 AND NOT regexp_matches(s, '[.?!。]$')))"


def let(value: str, name: str, use: str) -> str:
    """`use` with the value under a name, computed once."""
    return f"(list_transform([{value}], lambda {name}: {use})[1])"


def distinct_sentences(x: str) -> str:
    kept = "list_transform(list_filter(list_zip(fs, ks, range(1, len(fs) + 1)), lambda z: list_position(ks, z[2]) = z[3]), lambda z: z[1])"
    return let(sentences(x), "fs", let(f"list_transform(fs, lambda s: {collapse('lower(s)')})", "ks", kept))


def cut(x: str, most: int) -> str:
    head = f"{x}[:{most}]"
    return f"CASE WHEN length({x}) > {most} THEN CASE WHEN regexp_matches({head}, '[.?!。]') THEN regexp_replace({head}, '[^.?!。]*$', '') ELSE {head} END ELSE {x} END"


def utf16(x: str) -> str:
    return rf"(length({x}) + length(regexp_replace({x}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def terms(x: str) -> str:
    parts = rf"regexp_split_to_array(coalesce({x}, ''), '[\s()\[\]{{}},.!?:;/|_\-]+')"
    kept = f"list_transform(list_filter({parts}, lambda w: w <> '' AND (regexp_matches(w, '[{CJK}]') OR {utf16('w')} >= 2)), lambda w: lower(w))"
    return let(kept, "ws", "list_filter(ws, lambda w, i: list_position(ws, w) = i)")


def has(x: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(p)})" for p in phrases) + ")"


def count(x: str, phrases: list[str]) -> str:
    return "(" + " + ".join(f"contains({x}, {lit(p)})::INT" for p in phrases) + ")"


def chunk_type(x: str) -> str:
    lines = f"len(list_filter(list_transform(string_split({x}, chr(10)), lambda s: {trim('s')}), lambda s: regexp_matches(s, '^[•●\\-*①②③④]') OR (strlen(s) > 2 AND regexp_matches(s, '^\\p{{N}}[.)]'))))"
    low = f"lower({x})"
    return f"CASE WHEN {lines} >= 3 THEN 'list' WHEN {has(low, T.DEFINITION)} THEN 'definition' WHEN {has(low, T.EXAMPLE)} THEN 'example' WHEN {count(low, T.PROCEDURE)} >= 2 THEN 'procedure' WHEN {has(low, T.COMPARISON)} THEN 'comparison' ELSE 'general' END"


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


# Ranked search as CTEs


def bm25(name: str, texts: str, asked: str, floor: bool = False) -> str:
    """CTE `name` (qid, doc_id, score). texts: a query for (id, text); asked: one for (qid, query)."""
    avg = "greatest(avgdl, 1.0)" if floor else "avgdl"
    return f"""{name}_t AS MATERIALIZED (SELECT id, {tokens('text')} t FROM ({texts})),
    {name}_l AS (SELECT id, len(t) dl FROM {name}_t WHERE len(t) > 0),
    {name}_s AS (SELECT count(*) n, avg(dl) avgdl FROM {name}_l),
    {name}_p AS MATERIALIZED (SELECT id, term, count(*) tf FROM (SELECT id, unnest(t) term FROM {name}_t) GROUP BY id, term),
    {name}_d AS (SELECT term, count(*) df FROM {name}_p GROUP BY term),
    {name}_q AS (SELECT qid, term, count(*) qtf FROM (SELECT qid, unnest({tokens('query')}) term FROM ({asked})) GROUP BY qid, term),
    {name} AS MATERIALIZED (SELECT qid, p.id doc_id, sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / {avg}))) score
        FROM {name}_q JOIN {name}_p p USING (term) JOIN {name}_d USING (term) JOIN {name}_l l ON l.id = p.id, {name}_s GROUP BY qid, p.id)"""


def ranked(rows: str, k: int | None, by: str = "score") -> str:
    top = f" QUALIFY rank <= {k}" if k is not None else ""
    return f"(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round({by}, 12) DESC, doc_id) rank FROM {rows}{top})"


ASKED = "SELECT item_id qid, text query FROM benchmark WHERE item_id IN (SELECT vec_id FROM embeddings)"
ASKED_VECTORS = "SELECT item_id qid, embedding FROM benchmark JOIN embeddings ON item_id = vec_id"
DOCS = "SELECT doc_id id, text FROM documents"
TURN_CHUNKS = "SELECT conv_id * 100000 + turn chunk_id, conv_id source_id, turn::INT chunk_index, text AS content, role chunk_type FROM conversations"
ONE = f"SELECT 0::BIGINT qid, {lit(QUERY)} query"
SRC = "source[4:]::BIGINT"


def near(vectors: str, asked: str) -> str:
    return f"(SELECT qid, v.id doc_id, {cosine('v.embedding', 'q.embedding')} similarity FROM ({vectors}) v, ({asked}) q)"


def fused(k: int, many: int | None, v: str, b: str, wv: float, wb: float) -> str:
    """(qid, doc_id, score, vector_rank, bm25_rank, rank) of the ranked relations v and b."""
    del many
    both = f"""(SELECT coalesce(v.qid, b.qid) qid, coalesce(v.doc_id, b.doc_id) doc_id,
        coalesce({wv}::DOUBLE * (1.0::DOUBLE / (60 + v.rank)), 0) + coalesce({wb}::DOUBLE * (1.0::DOUBLE / (60 + b.rank)), 0) score,
        coalesce(v.rank, 0)::INT vector_rank, coalesce(b.rank, 0)::INT bm25_rank FROM {v} v FULL JOIN {b} b ON v.qid = b.qid AND v.doc_id = b.doc_id)"""
    return ranked(both, k)


def hits() -> str:
    return f"""{bm25('hs', f'SELECT chunk_id id, content AS text FROM ({TURN_CHUNKS})', ASKED)},
    hits AS MATERIALIZED (SELECT qid, rank, chunk_id, source_id, chunk_index, content, round(score, 6) similarity, '{{"conversation": ' || source_id || '}}' metadata
        FROM {ranked('hs', 8)} h JOIN ({TURN_CHUNKS}) c ON c.chunk_id = h.doc_id)"""


def _single(score: str) -> str:
    return f"SELECT h.qid, h.source_id, h.chunk_index FROM hits h JOIN ({score}) b ON b.qid = h.qid AND b.source_id = h.source_id"


BY_SCORE = "SELECT qid, source_id FROM (SELECT qid, source_id, sum(similarity) s, min(rank) f FROM hits GROUP BY qid, source_id HAVING sum(similarity) > -1) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(s, 12) DESC, f) = 1"


def by_text() -> str:
    points = f"len(list_filter({terms('query')}, lambda w: contains(lower(content), w))) + CASE WHEN contains(lower(content), lower(query)) OR contains(content, query) THEN 100 ELSE 0 END"
    return f"""SELECT qid, source_id FROM (SELECT *, max(p) OVER (PARTITION BY qid) top FROM (SELECT qid, source_id, sum(p) p, sum(similarity) s, min(rank) f FROM (SELECT h.*, {points} p FROM hits h JOIN ({ASKED}) USING (qid)) GROUP BY qid, source_id))
        QUALIFY row_number() OVER (PARTITION BY qid ORDER BY p DESC, CASE WHEN top > 0 THEN 0 ELSE round(s, 12) END DESC, f) = 1"""


def budget(k: int, rows: str = "hits") -> str:
    cost = f"CASE WHEN in_source > 1 THEN {utf16('content')} + 2 ELSE {utf16('content')} + 55 + length(source_id::VARCHAR) + CASE WHEN metadata IS NULL THEN 0 ELSE 24 + {utf16('metadata')} END + CASE WHEN rank_in > 1 THEN 1 ELSE 0 END END"
    return f"""(SELECT * FROM (SELECT *, sum({cost}) OVER (PARTITION BY qid ORDER BY rank) used FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) rank_in,
        row_number() OVER (PARTITION BY qid, source_id ORDER BY rank) in_source FROM {rows})) WHERE used <= {4 * k})"""


def rendered(rows: str) -> str:
    return f"""(SELECT qid, string_agg(block, chr(10) ORDER BY f) AS text, sum(n)::BIGINT included FROM (SELECT qid, source_id, min(rank) f, count(*) n,
        '<document id="' || source_id || '">' || chr(10) || coalesce('  <metadata>' || min(metadata) || '</metadata>' || chr(10), '') || '  <content>' || chr(10)
        || string_agg(content, chr(10) || chr(10) ORDER BY chunk_index, rank) || chr(10) || '  </content>' || chr(10) || '</document>' || chr(10) block FROM {rows} GROUP BY qid, source_id) GROUP BY qid)"""


def prompt(head: str) -> str:
    n = "chr(10)"
    return f"""CASE WHEN ctx = '' THEN query ELSE {lit(head)} || {n} || {n} || '--- Reference Documents ---' || {n} || ctx || {n} || '--- End of Documents ---' || {n} || {n} || 'Question: ' || query || {n} || {n} || 'Answer:' END"""


JOINED = "(SELECT qid, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS text, count(*) included FROM hits GROUP BY qid)"


def synthesized(where: str, words: int = 7, most: int = 10) -> str:
    parts = f"list_filter(list_transform(regexp_split_to_array({collapse('coalesce(text, ' + lit('') + ')')}, '[.!?。]'), lambda s: trim(s)), lambda s: {utf16('s')} >= 24)"
    found = "list_filter(string_split(s, ' '), lambda w: w <> '')"
    made = f"list_filter(list_transform({parts}, lambda s: CASE WHEN len({found}) >= {words} THEN array_to_string({found}[:{words}], ' ') WHEN length(s) > 48 THEN s[:48] ELSE s END), lambda q: {utf16('q')} >= 12)"
    return f"""(SELECT doc_id source_id, pos, made[pos + 1] query FROM (SELECT doc_id, made, unnest(range(0, len(made))) pos FROM
        (SELECT doc_id, list_filter(m, lambda q, i: list_position(m, q) = i)[:{most}] made FROM (SELECT doc_id, {made} m FROM documents {where}))))"""


def rank_rows() -> str:
    return f"""{bm25('rk', DOCS, ASKED)}, top AS (SELECT * FROM {ranked('rk', 10)}),
    best AS (SELECT t.qid, min(rank) rank, arg_min(lang, rank) lang FROM top t JOIN documents d ON d.doc_id = t.doc_id JOIN ({ASKED}) a ON a.qid = t.qid WHERE contains(d.text, a.query) GROUP BY t.qid),
    ranks AS (SELECT a.qid, CASE WHEN length(query) % 3 = 0 THEN 'hard_negative' ELSE 'positive' END query_type, coalesce(lang, 'none') AS language, coalesce(rank, 0) rank FROM ({ASKED}) a LEFT JOIN best b ON a.qid = b.qid)"""


def strip_page(page: str) -> str:
    """Without the last line that isn't blank if it is digits: by position among the page's lines."""
    lines = f"string_split({page}, chr(10))"
    at = f"list_max(list_filter(range(1, len({lines}) + 1), lambda i: {trim(lines + '[i]')} <> ''))"
    short = f"array_to_string(list_filter({lines}, lambda s, i: i <> {at}), chr(10))"
    tail = f"regexp_replace({short}, '\\n$', '')"
    return f"CASE WHEN regexp_matches(coalesce({trim(lines + '[' + at + ']')}, ''), '^[0-9]+$') THEN CASE WHEN {page} LIKE '%' || chr(10) THEN {tail} ELSE {short} END ELSE {page} END"


def join_pages() -> str:
    page = "coalesce(text, '') || CASE WHEN turn % 3 = 0 THEN ' cut-' || chr(10) WHEN turn % 3 = 1 THEN chr(10) || turn ELSE '' END"
    stripped = f"CASE WHEN turn % 3 = 1 THEN {strip_page('p')} ELSE p END"
    step = r"CASE WHEN regexp_matches(a, '[\p{L}\p{N}_]-\s*$') AND regexp_matches(b, '^\s*[\p{L}\p{N}_]') THEN regexp_replace(a, '-\s*$', '') || regexp_replace(b, '^\s+', '') ELSE a || ' ' || b END"
    whole = f"list_reduce(list(c ORDER BY turn), lambda a, b: {step})"
    dehyph = rf"regexp_replace({whole}, '([\p{{L}}\p{{N}}_]+)-\s*[\r\n]+\s*([a-z][\p{{L}}\p{{N}}_]*)', '\1\2', 'g')"
    return f"SELECT conv_id, md5({collapse(dehyph)}) digest FROM (SELECT conv_id, turn, {stripped} c FROM (SELECT conv_id, turn, {page} p FROM conversations)) GROUP BY conv_id"


def packed(parts: str, glue: str, again: str) -> str:
    """A list of texts joined by glue as long as PART bytes hold them; a new chunk begins with `again`."""
    step = f"a || CASE WHEN strlen(string_split(a, chr(1))[-1]) + strlen({glue}) + strlen(p) <= {PART} THEN {glue} ELSE chr(1) || {again} END || p"
    return f"string_split(list_reduce({parts}, lambda a, p: {step}), chr(1))"


def parts_of(chunks: str, kind: str, more: str = "") -> str:
    """Rows of the documents' chunks (a list over `text`), empty ones left out."""
    return f"""SELECT source_id, (i - 1)::INT chunk_index, (e - strlen(c[i]))::INT start_pos, e::INT end_pos, {lit(kind)} chunk_type{more}, md5(c[i]) digest
        FROM (SELECT *, sum(strlen(c[i]) + 1) OVER (PARTITION BY source_id ORDER BY i) - 1 e FROM (SELECT source_id, c, unnest(range(1, len(c) + 1)) i FROM
        (SELECT doc_id source_id, {chunks} c FROM documents))) WHERE c[i] <> ''"""


LINES = "string_split(coalesce(text, ''), chr(10))"
WORDS = "regexp_extract_all(coalesce(text, ''), '[A-Za-z]{1,40}')"


def markdown_oracles() -> dict[str, str]:
    filled = let(WORDS, "w", "CASE WHEN len(w) = 0 THEN [''] ELSE w END")
    stops = let(WORDS, "w", "CASE WHEN len(w) = 0 THEN [''] ELSE list_transform(w, lambda x, i: CASE WHEN i > 1 THEN ' ' ELSE '' END || x || '.') END")
    head = "replace(" + lit(TABLE_HEAD.replace("\n", "~")) + ", '~', chr(10))"
    many = "CASE WHEN len(c) > 1 THEN {} ELSE {} END::INT"
    return {
        "markdown_tables": parts_of(packed(f"list_prepend({head}, list_transform({LINES}, lambda s: '| ' || s || ' |'))", "chr(10)", f"{head} || chr(10)"), "table"),
        "markdown_code": parts_of(packed(f"list_concat(['```txt'], {filled}, ['```'])", "chr(10)", "''"), "code:txt", f", {many.format('i - 1', -1)} batch_index, {many.format('len(c)', 0)} batch_total"),
        "markdown_sentences": parts_of(f"list_transform({packed(stops, chr(39) * 2, chr(39) * 2)}, lambda s: trim(s))", "text"),
        "markdown_paragraphs": parts_of(packed(filled, "chr(10) || chr(10)", "''"), "text"),
        # The headers above a section: the last of each level that no later one of a higher or equal level has closed.
        "markdown_headers": f"""WITH l AS (SELECT doc_id, s[i] x, i, length(s[i]) % 3 + 1 lv FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) i FROM (SELECT doc_id, {LINES} s FROM documents))),
            t AS (SELECT *, md5(x) h, repeat('#', lv) || ' ' || md5(x) || chr(10) || 'x ' || x || ' x' || CASE WHEN i % 2 = 0 THEN chr(10) || 'end' ELSE '' END c,
                {', '.join(f'coalesce(max(CASE WHEN lv = {k} THEN i END) OVER w, 0) j{k}' for k in (1, 2, 3))} FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
            p AS (SELECT t.*, a.h h1, b.h h2, d.h h3 FROM t LEFT JOIN t a ON a.doc_id = t.doc_id AND a.i = t.j1 LEFT JOIN t b ON b.doc_id = t.doc_id AND b.i = t.j2 AND t.j2 > t.j1
                LEFT JOIN t d ON d.doc_id = t.doc_id AND d.i = t.j3 AND t.j3 > t.j1 AND t.j3 > t.j2)
            SELECT doc_id source_id, (i - 1)::INT chunk_index, (e - strlen(c))::INT start_pos, e::INT end_pos, CASE WHEN i % 2 = 0 THEN 'text' ELSE 'header' END chunk_type,
                md5(concat_ws(' > ', h1, h2, h3)) path, md5(c) digest FROM (SELECT *, sum(strlen(c) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 e FROM p)""",
    }


def all_of() -> dict[str, str]:
    vecs = "SELECT vec_id id, embedding FROM embeddings"
    vec_asked = "SELECT vec_id qid, embedding FROM embeddings WHERE vec_id % 20 = 0"
    c = "coalesce(text, '')"
    comp = f"array_to_string({distinct_sentences('text')}, ' ')"
    lead = "CASE turn % 6 WHEN 1 THEN 'For example, ' WHEN 2 THEN 'A ledger is defined as ' WHEN 3 THEN 'Step 1 first, how to: ' WHEN 4 THEN 'In contrast to it ' WHEN 5 THEN '- a' || chr(10) || '* b' || chr(10) || '3. c' || chr(10) ELSE '' END"
    said = f"(CASE turn % 5 WHEN 0 THEN ' /define ' WHEN 1 THEN '/Summary ' WHEN 2 THEN '/more' WHEN 3 THEN '/find ' ELSE '' END || {c})"
    low, arg = "lower(string_split(s, ' ')[1])", f"{trim('s[length(string_split(s, chr(32))[1]) + 2:]')}"
    content = "CASE WHEN starts_with(url, 'https') THEN '%PDF' || html WHEN contains(url, '/de/') THEN 'PK' || html WHEN contains(url, '/fr/') THEN 'ab' ELSE html END"
    v20 = lambda rel, many: ranked(rel, many, "similarity")
    with_vec = "SELECT doc_id id, embedding FROM documents JOIN embeddings ON doc_id = vec_id"
    hv = near(with_vec, ASKED_VECTORS)
    scoped = f"SELECT doc_id id, text FROM documents WHERE {SRC} IN (1, 2, 3)"
    scoped_v = f"SELECT doc_id id, embedding FROM documents JOIN embeddings ON doc_id = vec_id WHERE {SRC} IN (1, 2, 3)"
    liked = "SELECT doc_id FROM documents WHERE 'Publisher ' || source ILIKE 'PUBLISHER src1_'"
    out_f = "qid, doc_id, round(score, 6) score, vector_rank, bm25_rank, rank"
    inc = f"""WITH v AS (SELECT vec_id id, embedding, label FROM embeddings),
        a AS (SELECT *, 'buffer' origin FROM {near('SELECT id, embedding FROM v WHERE label % 2 = 0', vec_asked)}),
        b AS (SELECT qid, doc_id, similarity, 'hnsw' origin FROM {ranked(near('SELECT id, embedding FROM v WHERE label % 2 = 1 OR label = 2', vec_asked), 2 * K, 'similarity')}),
        u AS (SELECT *, 1 - similarity distance FROM a UNION ALL SELECT *, 1 - similarity FROM b),
        o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY round(distance, 12), origin) = 1)
        SELECT qid, doc_id, round(distance, 6) distance, origin, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 12), origin, doc_id) rank FROM o) WHERE rank <= {K}"""
    tail = "lag(text) OVER (PARTITION BY conv_id ORDER BY turn)"
    over = f"""SELECT source_id, chunk_index, md5(CASE WHEN add THEN tail || chr(10) || text ELSE text END) digest, CASE WHEN add THEN greatest(100 - strlen(tail), 0) ELSE 100 END::INT start_pos,
        (CASE WHEN add THEN greatest(100 - strlen(tail), 0) + strlen(tail) + 1 + strlen(text) ELSE 100 + strlen(text) END)::INT end_pos
        FROM (SELECT *, coalesce(tail <> '' AND NOT starts_with(text, tail), false) AS add FROM (SELECT conv_id source_id, turn::INT chunk_index, text, {tail}[-50:] tail FROM conversations))"""
    metric = lambda k, rk: f"count(*) n, round(avg(CASE WHEN rank > 0 AND rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) recall, round(avg(CASE WHEN rank > 0 AND rank <= {rk} THEN 1.0::DOUBLE / rank ELSE 0 END), 6) mrr, round(avg(CASE WHEN rank > 0 AND rank <= {rk} THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END), 6) ndcg"
    hit = "count(*) n, avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END) hit1, avg(CASE WHEN rank > 0 AND rank <= 3 THEN 1.0::DOUBLE ELSE 0 END) hit3, avg(CASE WHEN rank > 0 AND rank <= 3 THEN 1.0::DOUBLE / rank ELSE 0 END) mrr3"
    sweep = " UNION ALL ".join(
        f"SELECT {i} setting, {v}::DOUBLE vector_weight, {b}::DOUBLE bm25_weight, {hit} FROM (SELECT a.qid, coalesce(rank, 0) rank FROM ({ASKED}) a LEFT JOIN {fused(3, None, 'vr', 'br', v, b)} f ON f.qid = a.qid AND f.doc_id = a.qid)"
        for i, (v, b) in enumerate(WEIGHTS)
    )
    recall = f"""{hits()}, rp AS (SELECT qid, CASE WHEN h / b IS NULL THEN 0 ELSE h / b END recall, h / 3.0::DOUBLE AS "precision", h > 0 passed FROM (SELECT a.qid, sum(CASE WHEN len(list_filter(rel, lambda r: contains(lower(content), lower(r)))) > 0 THEN 1 ELSE 0 END)::DOUBLE h,
        least(greatest(len(any_value(rel)), 1), 3)::DOUBLE b FROM (SELECT qid, {terms('query')}[:4] rel FROM ({ASKED})) a LEFT JOIN hits h ON h.qid = a.qid AND h.rank <= 3 GROUP BY a.qid))"""
    lines = r"regexp_replace(coalesce(text, ''), '\n', chr(10) || chr(10), 'g')"
    para = f"list_filter(list_transform(string_split({lines}, chr(10) || chr(10)), lambda p: {trim('p')}), lambda p: p <> '')"
    dedup = "SELECT *, sha256(coalesce(text, '')) h FROM documents"
    out = {
        "tokens_per_doc": f"SELECT doc_id, len(t)::BIGINT n_tokens, md5(array_to_string(t, ' ')) digest FROM (SELECT doc_id, {tokens('text')} t FROM documents)",
        "keep_token": f"SELECT DISTINCT token, length(token) > 1 OR regexp_matches(token, '^[0-9b-hj-zB-HJ-Z{CJK}]$') kept, regexp_matches(token, '[{CJK}]') cjk FROM (SELECT unnest(string_split({c}, '')) token FROM documents) WHERE token <> ''",
        "term_doc_freq": f"SELECT term, count(DISTINCT doc_id) df, count(*) cf FROM (SELECT doc_id, unnest({tokens('text')}) term FROM documents) GROUP BY term",
        "corpus_stats": f"SELECT count(*) n, sum(dl)::BIGINT total, round(avg(dl), 6) avgdl FROM (SELECT len({tokens('text')}) dl FROM documents) WHERE dl > 0",
        "split_sentences": f"SELECT doc_id, len(s)::BIGINT n, md5(array_to_string(s, '|')) digest FROM (SELECT doc_id, {sentences('text')} s FROM documents)",
        "sentence_dedup": f"SELECT doc_id, len(s)::BIGINT n, md5(array_to_string(s, '|')) digest FROM (SELECT doc_id, {distinct_sentences('text')} s FROM documents)",
        "compress_text": f"""SELECT doc_id, md5(r) digest, length(t)::BIGINT original_chars, length(r)::BIGINT compressed_chars, CASE WHEN length(t) > 0 THEN round(length(r)::DOUBLE / length(t), 6) ELSE 1.0 END ratio,
            removed::BIGINT sentences_removed, 0::BIGINT chars_saved_stopwords, (length(j) - length(r))::BIGINT chars_saved_truncation
            FROM (SELECT *, {cut('j', 400)} r FROM (SELECT doc_id, {c} t, {comp} j, len({sentences('text')}) - len({distinct_sentences('text')}) removed FROM documents))""",
        "compress_text_simple": f"SELECT conv_id, turn, {comp} AS text FROM conversations",
        "should_compress": f"SELECT doc_id, length({c}) // 4 > 500 should FROM documents",
        "truncation_policy": f"SELECT doc_id, CASE WHEN length({c}) >= 2400 THEN 512 WHEN length({c}) >= 1200 THEN 384 ELSE 256 END::BIGINT tokens FROM documents",
        "significant_terms": f"SELECT item_id, len(t)::BIGINT n, array_to_string(t, ' ') terms FROM (SELECT item_id, {terms('text')} t FROM benchmark)",
        "classify_chunk": f"SELECT conv_id, turn, {chunk_type('x')} chunk_type, CASE WHEN lower(role) IN ('definition', 'example', 'list', 'procedure', 'comparison', 'general') THEN lower(role) ELSE 'general' END known FROM (SELECT *, {lead} || {c} x FROM conversations)",
        "detect_strategy": r"SELECT page_id, CASE WHEN lower(regexp_extract(u, '\.([^.]+)$', 1)) IN ('md', 'markdown') THEN 'markdown' ELSE 'recursive' END strategy FROM (SELECT page_id, url || CASE WHEN contains(url, '/en/') THEN '.MD' ELSE '.txt' END u FROM pages)",
        "parse_intent": f"""SELECT conv_id, turn, kind intent_type, CASE WHEN s = '' THEN '' WHEN kind = 'general' THEN s WHEN kind = 'invalid' THEN {low} ELSE {arg} END query, kind <> 'invalid' is_valid,
            CASE WHEN s = '' THEN {lit(T.EMPTY_INPUT)} WHEN kind <> 'invalid' THEN NULL WHEN {low} = '/define' THEN {lit(T.TERM_REQUIRED)} ELSE 'Unknown command ''' || {low} || '''. Available: /summary, /define, /more' END error_message
            FROM (SELECT *, CASE WHEN s = '' THEN 'invalid' WHEN NOT starts_with(s, '/') THEN 'general' WHEN {low} = '/summary' THEN 'summary' WHEN {low} = '/more' THEN 'more' WHEN {low} = '/define' AND {arg} <> '' THEN 'define' ELSE 'invalid' END kind
            FROM (SELECT conv_id, turn, {trim(said)} s FROM conversations))""",
        "content_hash": "SELECT doc_id, sha256(text) hash FROM documents",
        "normalize_ws": f"SELECT doc_id, md5({collapse('text')}) digest FROM documents",
        "dehyphenate": r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '([a-z]{3})([a-z]{3}) ', E'\\1-\n \\2 ', 'g'), '([\p{L}\p{N}_]+)-\s*[\r\n]+\s*([a-z][\p{L}\p{N}_]*)', '\1\2', 'g')) digest FROM documents",
        "strip_page_number": f"SELECT doc_id, md5({strip_page('p')}) digest FROM (SELECT doc_id, text || chr(10) || CASE WHEN lang = 'en' THEN doc_id::VARCHAR || chr(10) || chr(10) ELSE 'page' END p FROM documents)",
        "join_pages": join_pages(),
        "document_kind": f"SELECT page_id, CASE WHEN strlen(x) > 52428800 THEN 'too large' WHEN strlen(x) < 4 THEN 'too small' WHEN starts_with(x, '%PDF') THEN 'pdf' WHEN starts_with(x, 'PK') THEN 'docx' ELSE 'unsupported' END kind FROM (SELECT page_id, {content} x FROM pages)",
        "cosine_similarity": f"SELECT a.vec_id, round({cosine('a.embedding', 'b.embedding')}, 6) similarity, round(1 - {cosine('a.embedding', 'b.embedding')}, 6) distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
        "embedding_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) norm FROM embeddings",
        "dim_guard": "SELECT vec_id, label FROM embeddings WHERE len(CASE WHEN label = 0 THEN embedding[1:8] ELSE embedding END) = 64",
        "vector_topk": f"SELECT id doc_id, round(s, 6) similarity FROM (SELECT id, {cosine('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')} s FROM ({vecs})) ORDER BY s DESC, id LIMIT {K}",
        "vector_topk_batch": f"SELECT qid, doc_id, round(similarity, 6) similarity, rank FROM {v20(near(vecs, vec_asked), K)}",
        "vector_self_join_label": f"""SELECT a.label, count(*) n, sum((a.label = b.label)::INT)::BIGINT same FROM (SELECT qid, arg_min(doc_id, rank) doc_id FROM {v20(near(vecs, 'SELECT vec_id qid, embedding FROM embeddings'), 2)} WHERE qid <> doc_id GROUP BY qid) t
            JOIN embeddings a ON a.vec_id = t.qid JOIN embeddings b ON b.vec_id = t.doc_id GROUP BY a.label""",
        "sentence_hash": f"""SELECT item_id, (i - 1)::INT pos, lower(lpad(hex(list_reduce(list_prepend(14695981039346656037::HUGEINT,
            list_transform(range(1, length(x) // 2 + 1), lambda j: (16 * (strpos('0123456789ABCDEF', x[2 * j - 1]) - 1) + strpos('0123456789ABCDEF', x[2 * j]) - 1)::HUGEINT)),
            lambda h, b: (xor(h::UBIGINT, b::UBIGINT)::HUGEINT * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT), 16, '0')) hash
            FROM (SELECT item_id, i, hex(encode({collapse('lower(s[i])')})) x FROM (SELECT item_id, s, unnest(range(1, len(s) + 1)) i FROM (SELECT item_id, {sentences('text')} s FROM benchmark)))""",
        "vector_cells": f"SELECT count(DISTINCT qid) n_queries, count(*) n_exact, true AS recalled FROM {v20(near(vecs, vec_asked), K)}",
        "vector_graph": f"SELECT qid, rank, doc_id, round(similarity, 6) similarity, 1.0::DOUBLE AS recall, true AS spared FROM {v20(near(vecs, vec_asked), K)}",
        "mean_pool": "SELECT label, (pos - 1)::BIGINT pos, round(avg(embedding[pos]::DOUBLE), 6) AS value FROM embeddings, range(1, 65) r(pos) GROUP BY label, pos",
        "search_chunks": f"SELECT qid, rank, t.doc_id chunk_id, {SRC} source_id, md5(text) digest, 'Publisher ' || source metadata, round(similarity, 6) similarity FROM {v20(hv, 5)} t JOIN documents d ON d.doc_id = t.doc_id",
        "search_similar": f"SELECT qid, rank, md5(text) digest FROM {v20(hv, 3)} t JOIN documents d ON d.doc_id = t.doc_id",
        "bm25_topk": f"WITH {bm25('b', DOCS, ONE)} SELECT qid, doc_id, round(score, 6) score, rank FROM {ranked('b', K)}",
        "bm25_batch": f"WITH {bm25('b', DOCS, ASKED)} SELECT qid, doc_id, round(score, 6) score, rank FROM {ranked('b', K)}",
        "bm25_blocks": f"WITH {bm25('b', DOCS, ASKED)} SELECT qid, doc_id, round(score, 6) score, rank FROM {ranked('b', K)}",
        "store_changes": """SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') || ' changed' ELSE coalesce(text, '') END) digest FROM documents
            WHERE doc_id % 2 = 0 OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
        "bm25_segments": f"WITH {bm25('b', DOCS + ' WHERE doc_id % 4 = 3 OR doc_id % 2 = 0 OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)', ASKED)} SELECT qid, doc_id, round(score, 6) score, rank FROM {ranked('b', K)}",
        "bm25_scoped": f"WITH {bm25('b', scoped, ONE, True)} SELECT qid, doc_id, round(score, 6) score, rank FROM {ranked('(SELECT * FROM b WHERE score > 0)', K)}",
        "bm25_index_add": f"WITH {bm25('b', DOCS, ONE)} SELECT qid, doc_id, round(score, 6) score, rank FROM {ranked('b', K)}",
        "bm25_index_remove": f"WITH {bm25('b', DOCS + ' WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)', ONE)} SELECT qid, doc_id, round(score, 6) score, rank FROM {ranked('b', K)}",
        "rrf_hybrid": f"WITH {bm25('b', DOCS, ASKED)}, vr AS (SELECT * FROM {v20(hv, 2 * K)}), br AS (SELECT * FROM {ranked('b', 2 * K)}) SELECT {out_f} FROM {fused(K, None, 'vr', 'br', 0.5, 0.5)}",
        "rrf_weighted": f"WITH {bm25('b', DOCS, ASKED)}, vr AS (SELECT * FROM {v20(hv, 2 * K)}), br AS (SELECT * FROM {ranked('b', 2 * K)}) SELECT {out_f} FROM {fused(K, None, 'vr', 'br', 0.2, 1.0)}",
        "hybrid_source_filter": f"WITH {bm25('b', scoped, ASKED, True)}, vr AS (SELECT * FROM {v20(near(scoped_v, ASKED_VECTORS), None)}), br AS (SELECT * FROM {ranked('(SELECT * FROM b WHERE score > 0)', None)}) SELECT {out_f} FROM {fused(K, None, 'vr', 'br', 0.5, 0.5)}",
        "hybrid_metadata_like": f"""WITH {bm25('b', DOCS, ASKED)}, v0 AS (SELECT * FROM {v20(hv, 4 * K)}), b0 AS (SELECT * FROM {ranked('b', 4 * K)}),
            vr AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY qid ORDER BY rank) rank FROM v0 WHERE doc_id IN ({liked})),
            br AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY qid ORDER BY rank) rank FROM b0 WHERE doc_id IN ({liked})) SELECT {out_f} FROM {fused(K, None, 'vr', 'br', 0.5, 0.5)}""",
        "search_hybrid_simple": f"WITH {bm25('b', DOCS, ASKED)}, vr AS (SELECT * FROM {v20(hv, 6)}), br AS (SELECT * FROM {ranked('b', 6)}) SELECT qid, rank, md5(text) digest FROM {fused(3, None, 'vr', 'br', 0.5, 0.5)} f JOIN documents d ON d.doc_id = f.doc_id",
        "content_fetch": f"SELECT doc_id, CASE WHEN lang = 'en' THEN doc_id ELSE {SRC} END source_id, CASE WHEN lang = 'en' THEN 0 ELSE doc_id END::INT chunk_index, CASE WHEN lang = 'en' THEN NULL ELSE 'Publisher ' || source END metadata, md5(text) digest FROM documents",
        "dedup_ingest": f"""WITH d AS ({dedup}), f AS (SELECT h, min(doc_id) seq FROM d GROUP BY h), n AS (SELECT h, seq, row_number() OVER (ORDER BY seq) source_id FROM f)
            SELECT d.doc_id seq, n.source_id, d.doc_id <> n.seq is_duplicate, CASE WHEN d.doc_id <> n.seq THEN 'Source already exists (id=' || n.source_id || ')' ELSE 'Source added' END message FROM d JOIN n USING (h)""",
        "add_document": "SELECT doc_id seq, embedding IS NOT NULL success, embedding IS NOT NULL AND doc_id <> min(doc_id) FILTER (embedding IS NOT NULL) OVER (PARTITION BY text) is_duplicate FROM documents LEFT JOIN embeddings ON doc_id = vec_id",
        "list_sources": "SELECT doc_id source_id, source AS name, 'completed' status, lang metadata FROM documents",
        "get_source": "SELECT md5(text) digest FROM documents WHERE doc_id = 7",
        "get_source_chunks": f"SELECT chunk_index, content FROM ({TURN_CHUNKS}) WHERE source_id = 3",
        "get_all_chunks": f"SELECT chunk_id, md5(content) digest FROM ({TURN_CHUNKS})",
        "get_adjacent_chunks": f"SELECT chunk_id, source_id, chunk_index, content, coalesce(chunk_type, 'general') chunk_type, '{{\"conversation\": ' || source_id || '}}' metadata, 0.0::DOUBLE similarity FROM ({TURN_CHUNKS}) WHERE source_id = 3 AND chunk_index BETWEEN 1 AND 2",
        "chunks_left_join_sources": f"SELECT chunk_id, source_id, chunk_index, coalesce(chunk_type, 'general') chunk_type, CASE WHEN count(*) OVER (PARTITION BY source_id) <= 4 THEN '{{\"conversation\": ' || source_id || '}}' END metadata FROM ({TURN_CHUNKS})",
        "source_stats": "SELECT count(DISTINCT conv_id) source_count, count(*) chunk_count FROM conversations",
        "chunk_counts": "SELECT conv_id source_id, count(*) chunk_count FROM conversations GROUP BY conv_id",
        "delete_source": "SELECT conv_id source_id, count(*) n FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY conv_id",
        "update_status": "SELECT d.doc_id source_id, CASE quality WHEN 1 THEN 'completed' WHEN 0 THEN 'failed' ELSE 'new' END status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
        "update_embedding": "SELECT vec_id chunk_id, round(CASE WHEN vec_id < 100 THEN -embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END, 6) AS first FROM embeddings",
        "incremental_search": inc,
        "buffer_merge": "SELECT vec_id doc_id, len(embedding)::INT dim FROM embeddings",
        "buffer_stats": "SELECT 2 * count(*) buffer_size, 100 threshold, true index_loaded, 2 * count(*) >= 100 needs_merge FROM embeddings WHERE label % 2 = 0 AND vec_id >= 50",
        "chunk_overlap": over,
        "semantic_chunk_lines": f"""SELECT source_id, (i - 1)::INT chunk_index, e - n AS start_pos, e AS end_pos, md5(p[i]) digest FROM (SELECT *, strlen(p[i])::INT n, (sum(strlen(p[i]) + 1) OVER (PARTITION BY source_id ORDER BY i) - 1)::INT e
            FROM (SELECT doc_id source_id, p, unnest(range(1, len(p) + 1)) i FROM (SELECT doc_id, {para} p FROM documents)))""",
        "single_source_text": f"WITH {hits()} {_single(by_text())}",
        "single_source_score": f"WITH {hits()} {_single(BY_SCORE)}",
        "expand_adjacent": f"""WITH {hits()}, w AS (SELECT DISTINCT qid, source_id, unnest(range(greatest(chunk_index - 1, 0), chunk_index + 2)) chunk_index FROM hits),
            r AS (SELECT w.qid, c.source_id, c.chunk_index, c.chunk_id, h.qid IS NOT NULL is_hit FROM w JOIN ({TURN_CHUNKS}) c ON c.source_id = w.source_id AND c.chunk_index = w.chunk_index LEFT JOIN hits h ON h.qid = w.qid AND h.source_id = w.source_id AND h.chunk_index = w.chunk_index)
            SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY source_id, chunk_index, chunk_id) rank, source_id, chunk_index, is_hit FROM r""",
        "order_chronological": f"WITH {hits()} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY source_id, chunk_index, chunk_id) rank, source_id, chunk_index FROM hits",
        "order_diverse": f"""WITH RECURSIVE {hits()}, l AS (SELECT qid, list({{'s': source_id, 'c': chunk_index}} ORDER BY rank) rest FROM hits GROUP BY qid),
            g AS (SELECT qid, 0 rank, rest, NULL::BIGINT s, NULL::INT chunk_index FROM l UNION ALL
                SELECT qid, rank + 1, list_filter(rest, lambda x, i: i <> place), rest[place].s, rest[place].c FROM
                (SELECT *, coalesce(list_position(list_transform(rest, lambda x: s IS NULL OR x.s <> s), true), 1) AS place FROM g WHERE len(rest) > 0))
            SELECT qid, rank, s source_id, chunk_index FROM g WHERE rank > 0""",
        "context_budget": f"WITH {hits()} SELECT qid, rank, chunk_id, used::BIGINT used FROM {budget(400)}",
        "render_context": f"""WITH {hits()}, ch AS (SELECT * FROM {budget(400)}), u AS (SELECT qid, ceil(max(used) / 4)::BIGINT t FROM ch GROUP BY qid)
            SELECT a.qid, md5(coalesce(r.text, '')) digest, coalesce(included, 0)::BIGINT included, coalesce(t, 0)::BIGINT estimated_tokens, CASE WHEN a.qid IN (SELECT qid FROM hits) THEN 400 - coalesce(t, 0) ELSE 0 END::BIGINT remaining_budget
            FROM ({ASKED}) a LEFT JOIN {rendered('ch')} r ON r.qid = a.qid LEFT JOIN u ON u.qid = a.qid""",
        "format_prompt": f"""WITH {hits()}, one AS (SELECT h.* FROM hits h JOIN ({BY_SCORE}) b ON b.qid = h.qid AND b.source_id = h.source_id),
            ch AS (SELECT * FROM (SELECT *, sum({utf16('content')} + CASE WHEN rn > 1 THEN 3 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank) used FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) rn FROM one)) WHERE used <= 8000),
            x AS (SELECT a.qid, query, coalesce(t, '') ctx FROM ({ASKED}) a LEFT JOIN (SELECT qid, string_agg(content, ' | ' ORDER BY rank) t FROM ch GROUP BY qid) c ON c.qid = a.qid)
            SELECT qid, md5({prompt(STRICT)}) strict, md5({prompt(PLAIN)}) plain, length(ctx)::BIGINT n FROM x""",
        "context_compressed": f"WITH {hits()} SELECT qid, md5(r) digest, included, ceil({utf16('r')} / 4.0)::BIGINT estimated_tokens, (300 - ceil({utf16('r')} / 4.0))::BIGINT remaining_budget FROM (SELECT qid, included, {cut('j', 1200)} r FROM (SELECT qid, included, {comp} j FROM {JOINED}))",
        "prompt_compress": f"WITH {hits()} SELECT qid, md5(r) digest, n original_chars, length(r)::BIGINT compressed_chars, (ceil(n / 4.0) - ceil(length(r) / 4.0))::BIGINT tokens_saved, included FROM (SELECT qid, included, n, {cut('j', 1200)} r FROM (SELECT qid, included, length(text)::BIGINT n, {comp} j FROM {JOINED}))",
        "score_sentences": f"""WITH q AS (SELECT label, min(vec_id) qid FROM embeddings GROUP BY label), s AS (SELECT qid, v.vec_id doc_id, {cosine('v.embedding', 'e.embedding')} similarity FROM embeddings v JOIN q USING (label) JOIN embeddings e ON e.vec_id = qid)
            SELECT qid, doc_id pos, round(similarity, 6) similarity, rank FROM {ranked('(SELECT * FROM s WHERE similarity >= 0.2)', 10, 'similarity')}""",
        "recall_precision": f'WITH {recall} SELECT qid, round(recall, 6) recall, round("precision", 6) AS "precision", passed FROM rp',
        "quality_summary": f'WITH {recall} SELECT count(*) total, sum(passed::INT)::BIGINT passed, round(avg(round(recall, 6)), 5) avg_recall, round(avg(round("precision", 6)), 5) avg_precision, round(avg(passed::INT), 5) pass_rate FROM rp',
        "rank_metrics": f"WITH {rank_rows()} SELECT 'overall' AS scope, {metric(5, 10)} FROM ranks UNION ALL SELECT query_type, {metric(5, 10)} FROM ranks GROUP BY query_type UNION ALL SELECT language, {metric(5, 10)} FROM ranks GROUP BY language",
        "hit_metrics": f"WITH {rank_rows()} SELECT query_type, n, round(hit1, 6) hit1, round(hit3, 6) hit3, round(mrr3, 6) mrr3 FROM (SELECT query_type, {hit} FROM ranks GROUP BY query_type)",
        "weight_sweep": f"""WITH {bm25('b', DOCS, ASKED)}, vr AS MATERIALIZED (SELECT * FROM {v20(hv, 20)}), br AS MATERIALIZED (SELECT * FROM {ranked('b', 20)}), s AS ({sweep})
            SELECT vector_weight, bm25_weight, n, round(hit1, 6) hit1, round(hit3, 6) hit3, round(mrr3, 6) mrr3, row_number() OVER (ORDER BY round(1000 * hit1 + 10 * mrr3, 9) DESC, setting) = 1 is_best FROM s""",
        "query_synthesis": f"SELECT source_id, pos::BIGINT pos, query FROM {synthesized('')}",
        "hard_negatives": f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY pos, query) - 1 AS at, count(*) OVER () n FROM {synthesized("WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE lang = 'de')")}),
            m AS (SELECT w.source_id, w.pos::BIGINT pos, trim(array_to_string(list_filter(string_split(w.query, ' '), lambda x: x <> '')[:7], ' ') || ' ' || array_to_string(list_filter(string_split(o.query, ' '), lambda x: x <> '')[:2], ' ')) query
            FROM {synthesized("WHERE lang = 'en'", 7, 3)} w JOIN o ON o.at = w.pos % o.n) SELECT * FROM m WHERE {utf16('query')} >= 12""",
        "stream_ingest": "SELECT vec_id doc_id, len(embedding)::INT dim FROM embeddings",
        "events_by_window": "SELECT (epoch(date_trunc('hour', ts)))::BIGINT AS start, event_type, count(*) n FROM events GROUP BY ALL",
    }
    out |= markdown_oracles()
    # row_number() is a BIGINT here and an INT in Spark.
    return {n: f"SELECT * REPLACE (rank::INT AS rank) FROM ({sql})" if n in RANKED else sql for n, sql in out.items()}


RANKED = frozenset(
    "vector_topk_batch vector_graph search_chunks search_similar bm25_topk bm25_batch bm25_blocks bm25_segments bm25_scoped bm25_index_add bm25_index_remove rrf_hybrid rrf_weighted "
    "hybrid_source_filter hybrid_metadata_like search_hybrid_simple incremental_search expand_adjacent order_chronological context_budget score_sentences".split()
)

"""DuckDB oracle SQL for the registered queries (tables are pre-registered views).

Each statement recomputes the query's answer from the test tables with plain SQL, in the
same column names and types as the Spark query. Vector components are compared on integer
micro-units (6 decimal places), so distances agree bit for bit before the final rounding.
"""

from __future__ import annotations

# shared CTE pieces -------------------------------------------------------------------------

_MICRO = "CAST(round(CAST({x} AS DOUBLE) * 1000000) AS BIGINT)"

# per-token distance in integer pico-units; mean = exact integer sum / count / 1e12
_PICO = "CAST(round(sqrt(CAST({s} AS DOUBLE)) * 1000000) AS BIGINT)"
_MEAN = "CAST(sum(p) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 1e12"

_TOPK = """
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance ASC, article_id DESC) AS rnk
      FROM means)
SELECT query_id, CAST(rnk AS INTEGER) AS rank, article_id, round(distance, 6) AS distance
FROM r WHERE rnk <= 10
"""

_VECTOR_INPUTS = """
e AS (SELECT vec_id, label, embedding,
             row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
q AS (SELECT CAST(label AS BIGINT) AS query_id, CAST(rn AS BIGINT) AS tok_no, embedding AS vec
      FROM e WHERE rn <= 3),
a AS (SELECT CAST(vec_id // 10 AS BIGINT) AS article_id, vec_id AS pos, embedding AS vec
      FROM e WHERE rn > 3),
qc AS (SELECT query_id, tok_no, unnest(generate_series(1, len(vec))) AS i, unnest(vec) AS x FROM q),
ac AS (SELECT article_id, pos, unnest(generate_series(1, len(vec))) AS i, unnest(vec) AS x FROM a),
qm AS (SELECT query_id, tok_no, i, {mq} AS m FROM qc),
am AS (SELECT article_id, pos, i, {ma} AS m FROM ac),
d2 AS (SELECT qm.query_id, qm.tok_no, am.article_id, am.pos, sum((qm.m - am.m) * (qm.m - am.m)) AS s
       FROM qm JOIN am ON qm.i = am.i GROUP BY ALL),
mins AS (SELECT query_id, tok_no, article_id, {pico} AS p
         FROM d2 GROUP BY ALL)
""".format(mq=_MICRO.format(x="x"), ma=_MICRO.format(x="x"), pico=_PICO.format(s="min(s)"))

SEARCH_VECTORS = "WITH " + _VECTOR_INPUTS + """,
means AS (SELECT query_id, article_id, {mean} AS distance FROM mins GROUP BY ALL),
""".format(mean=_MEAN) + _TOPK

# Python's whitespace, as a class of its own for the SQL side
_WS = ("[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
       "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")

# token rule of the lookup encoder: windows of 126 words, each between [CLS] and [SEP]
_WORDS = ("list_filter(string_split(regexp_replace(lower({t}), '" + _WS.replace("{", "{{").replace("}", "}}")
          + "+', ' ', 'g'), ' '), lambda w: w <> '')")
_WINDOWS = ("list_transform(generate_series(0, greatest(CAST(ceil(len({w}) / 126.0) AS BIGINT), 1) - 1), "
            "lambda i: list_concat(list_concat(['[CLS]'], list_slice({w}, i * 126 + 1, (i + 1) * 126)), ['[SEP]']))")
_BUCKET = "CAST(('0x' || substr(md5({tok}), 1, 8))::BIGINT % (SELECT n FROM nrows) AS BIGINT)"

_LOOKUP_DISTANCES = """
nrows AS (SELECT count(*) AS n FROM embeddings),
emb AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, embedding FROM embeddings),
ec AS (SELECT r, unnest(generate_series(1, len(embedding))) AS i, unnest(embedding) AS x FROM emb),
em AS (SELECT r, i, {m} AS m FROM ec),
docs AS (SELECT doc_id AS article_id, {words} AS w FROM documents
         WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''),
atok AS (SELECT article_id, unnest(list_concat(['[CLS]'], w, ['[SEP]'])) AS tok FROM docs),
arow AS (SELECT DISTINCT article_id, {bucket_a} AS r FROM atok),
qw AS (SELECT item_id AS query_id, {qwords} AS w FROM benchmark),
qtok0 AS (SELECT query_id, unnest(list_concat(['[CLS]'], w, ['[SEP]'])) AS tok FROM qw),
qtok AS (SELECT DISTINCT query_id, tok FROM qtok0),
qrow AS (SELECT query_id, tok, {bucket_q} AS r FROM qtok),
qr AS (SELECT DISTINCT r FROM qrow),
dd AS (SELECT a.r AS ra, b.r AS rb, {pico_pairs} AS p
       FROM em a JOIN em b ON a.i = b.i WHERE b.r IN (SELECT r FROM qr) GROUP BY ALL),
amin AS (SELECT arow.article_id, dd.rb AS rq, min(dd.p) AS p FROM arow JOIN dd ON dd.ra = arow.r GROUP BY ALL),
means AS (SELECT q.query_id, amin.article_id, {mean} AS distance
          FROM qrow q JOIN amin ON amin.rq = q.r GROUP BY ALL)
""".format(m=_MICRO.format(x="x"), pico_pairs=_PICO.format(s="sum((a.m - b.m) * (a.m - b.m))"), mean=_MEAN, words=_WORDS.format(t="text"), qwords=_WORDS.format(t="text"),
           bucket_a=_BUCKET.format(tok="tok"), bucket_q=_BUCKET.format(tok="tok"))

SEARCH_ARTICLES = "WITH " + _LOOKUP_DISTANCES + "," + _TOPK


# --- text helpers (DuckDB spellings of the Python string rules) ----------------------------

_NL = "chr(10)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _period(x: str) -> str:
    return (f"CASE WHEN starts_with({x}, '@highlight') OR right({x}, 1) IN "
            f"('.', '!', '?', '''', '`', '\"', '’', ')') THEN {x} ELSE {x} || '.' END")


def _lines(raw: str) -> str:
    return (f"list_transform(list_filter(list_transform(string_split({raw}, {_NL}), lambda x: {_strip('x')}), "
            f"lambda x: x <> ''), lambda x: {_period('x')})")


def _join(lst: str, sep: str) -> str:
    return f"coalesce(array_to_string({lst}, {sep}), '')"


def _wordsf(t: str) -> str:
    return _WORDS.format(t=t)


def _pieces(ws: str) -> str:
    return (f"flatten(list_transform({ws}, lambda w: CASE WHEN length(w) > 6 "
            f"THEN [substr(w, 1, 4), '##' || substr(w, 5)] ELSE [w] END))")


_ARTICLES = f"""
d AS (SELECT doc_id, lang, source, string_split(text, {_NL}) AS l FROM documents),
a AS (SELECT doc_id, lang, source, CAST(doc_id AS VARCHAR) AS paper_id,
        CASE WHEN doc_id % 7 = 6 THEN NULL ELSE [l[1]] END AS abstract,
        CASE WHEN doc_id % 5 = 4 THEN NULL ELSE list_slice(l, 2, len(l)) END AS body FROM d),
t AS (SELECT *, {_join('abstract', _NL)} AS full_abstract, {_join('body', _NL)} AS full_text FROM a),
r AS (SELECT *, CASE WHEN body IS NULL THEN '' ELSE {_strip(f"full_abstract || {_NL} || full_text")} END
               AS concat_text,
             CASE doc_id % 3 WHEN 0 THEN lang || ' ' || lang || ' ' || source || ' ' || source
                  ELSE lang || '  ' || source END AS authors FROM t)
"""

_STORIES = f"""
st AS (SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN '@highlight' || {_NL} || text ELSE text END,
                                  {_NL} ORDER BY turn) AS raw FROM conversations GROUP BY conv_id),
ln AS (SELECT conv_id, {_lines('raw')} AS lines FROM st),
mk AS (SELECT conv_id, lines,
              coalesce(list_position(list_transform(lines, lambda x: starts_with(x, '@highlight')), true), 0) AS p
       FROM ln),
ss AS (SELECT conv_id, lines,
              CASE WHEN p = 0 THEN lines ELSE list_slice(lines, 1, p - 1) END AS story,
              CASE WHEN p = 0 THEN []::VARCHAR[]
                   ELSE list_filter(list_slice(lines, p + 1, len(lines)), lambda x: NOT starts_with(x, '@highlight'))
              END AS summary
       FROM mk)
"""

_PAIR_RE = "(?s)^(.*) \\|\\|\\| (.*)$"
_PAIRS = f"""
pl0 AS (SELECT conv_id, turn, replace(text, {_NL}, ' ') AS flat,
               lead(replace(text, {_NL}, ' ')) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
pl AS (SELECT conv_id, turn, {_strip("CASE WHEN nxt IS NULL THEN flat ELSE flat || ' ||| ' || nxt END")} AS s
       FROM pl0),
sp AS (SELECT conv_id, turn,
              CASE WHEN regexp_matches(s, '{_PAIR_RE}') THEN regexp_extract(s, '{_PAIR_RE}', 1) ELSE s END AS text_a,
              CASE WHEN regexp_matches(s, '{_PAIR_RE}') THEN regexp_extract(s, '{_PAIR_RE}', 2) END AS text_b
       FROM pl)
"""

_NA_LIST = ", ".join("'" + v.replace("'", "''") + "'" for v in [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null"])


def _na(x: str) -> str:
    return f"CASE WHEN {x} IN ({_NA_LIST}) THEN NULL ELSE {x} END"


_META = f"""
m0 AS (SELECT d.doc_id AS ord, d.source AS title, string_split(d.text, {_NL})[1] AS abstract,
              CASE WHEN d.doc_id % 11 = 0 THEN d.lang || {_NL} || '"' || d.source || '"' ELSE d.lang END AS authors,
              CASE WHEN d.doc_id % 13 = 0 THEN 'NA' ELSE CAST(d.doc_id AS VARCHAR) END AS doi,
              CAST(l.quality AS VARCHAR) AS publish_time
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
m AS (SELECT ord, {_na('title')} AS title, {_na('abstract')} AS abstract, {_na('authors')} AS authors,
             {_na('doi')} AS doi, {_na('publish_time')} AS publish_time FROM m0),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY abstract ORDER BY ord) AS rn FROM m) WHERE rn = 1),
mc AS (SELECT * FROM dd WHERE title IS NOT NULL AND abstract IS NOT NULL AND authors IS NOT NULL
                          AND doi IS NOT NULL AND publish_time IS NOT NULL)
"""
_MCOLS = "title, abstract, authors, doi, publish_time"

_SPECIALS = ["[PAD]", "[unused0]", "[unused1]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]
_VOCAB = ("vocab AS (SELECT token, CAST(id AS INTEGER) AS id FROM ("
          + " UNION ALL ".join(f"SELECT '{t}' AS token, {i} AS id" for i, t in enumerate(_SPECIALS))
          + f" UNION ALL SELECT token, {len(_SPECIALS) - 1} + row_number() OVER (ORDER BY token) AS id FROM "
          f"(SELECT DISTINCT unnest({_wordsf('text')}) AS token FROM documents)))")

TEXT_SQL = {
    "scan_article_json": "WITH " + _ARTICLES + """
SELECT paper_id, source AS title,
       CAST(CASE WHEN abstract IS NULL THEN -1 ELSE len(abstract) END AS INTEGER) AS n_abstract,
       CAST(CASE WHEN body IS NULL THEN -1 ELSE len(body) END AS INTEGER) AS n_body,
       CAST(1 AS INTEGER) AS n_authors FROM a""",
    "scan_article_bodies": "WITH " + _ARTICLES + f""",
b AS (SELECT paper_id, {_lines(_join('body', _NL))} AS lines FROM a),
bm AS (SELECT paper_id, lines,
              coalesce(list_position(list_transform(lines, lambda x: starts_with(x, '@highlight')), true), 0) AS p
       FROM b),
bs AS (SELECT paper_id, CASE WHEN p = 0 THEN lines ELSE list_slice(lines, 1, p - 1) END AS story,
              CASE WHEN p = 0 THEN []::VARCHAR[]
                   ELSE list_filter(list_slice(lines, p + 1, len(lines)), lambda x: NOT starts_with(x, '@highlight'))
              END AS summary FROM bm)
SELECT paper_id, CAST(len(story) AS INTEGER) AS n_story_lines, CAST(len(summary) AS INTEGER) AS n_summary_lines,
       {_join('story', _NL)} AS story FROM bs""",
    "article_text": "WITH " + _ARTICLES + "SELECT paper_id, full_abstract, full_text, concat_text FROM r",
    "article_record": "WITH " + _ARTICLES +
    "SELECT paper_id, concat_text, source AS title, full_abstract, authors, full_text FROM r",
    "author_names": "WITH " + _ARTICLES + "SELECT paper_id, authors FROM r",
    "drop_empty_articles": "WITH " + _ARTICLES + f"SELECT paper_id FROM r WHERE {_strip('concat_text')} <> ''",
    "lower_case": "SELECT doc_id, lower(text) AS text_lower FROM documents",
    "document_name": "SELECT page_id, string_split(url, '/')[-1] AS document_name FROM pages",
    "story_lines": "WITH " + _STORIES +
    f"SELECT conv_id, CAST(len(lines) AS INTEGER) AS n_lines, {_join('lines', _NL)} AS lines FROM ln",
    "add_missing_period": f"SELECT conv_id, turn, {_join(_lines('text'), _NL)} AS text FROM conversations",
    "split_story_summary": "WITH " + _STORIES +
    f"SELECT conv_id, {_join('story', _NL)} AS story, {_join('summary', _NL)} AS summary FROM ss",
    "join_summary": "WITH " + _STORIES + f"SELECT conv_id, {_join('summary', chr(39) + ' ' + chr(39))} AS tgt_str FROM ss",
    "drop_empty_stories": "WITH " + _STORIES + "SELECT conv_id FROM ss WHERE len(story) > 0",
    "count_documents": "WITH " + _STORIES + "SELECT count(*) AS n_documents FROM ss WHERE len(story) > 0",
    "scan_story_files": "WITH " + _STORIES +
    "SELECT conv_id, CAST(len(story) AS INTEGER) AS n_story, CAST(len(summary) AS INTEGER) AS n_summary FROM ss",
    "scan_story_folder": "WITH " + _STORIES + f"""
SELECT CAST(len(story) AS INTEGER) AS n_story, CAST(len(summary) AS INTEGER) AS n_summary,
       md5({_join('story', _NL)}) AS story_md5 FROM ss""",
    "normalize_whitespace": f"SELECT doc_id, regexp_replace({_strip('text')}, '{_WS}+', ' ', 'g') AS text FROM documents",
    "strip_text": f"SELECT conv_id, turn, {_strip('text')} AS text FROM conversations",
    "detokenize": f"SELECT doc_id, replace({_join(_pieces(_wordsf('text')), chr(39) + ' ' + chr(39))}, ' ##', '') AS text "
                  "FROM documents",
    "split_pair": "WITH " + _PAIRS + "SELECT conv_id, turn, text_a, text_b FROM sp",
    "scan_pair_lines": "WITH " + _PAIRS +
    "SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS unique_id, text_a, text_b FROM sp",
    "sequence_ids": "SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS seq_id FROM conversations",
    "word_trigrams": f"""
WITH w AS (SELECT doc_id, {_wordsf('text')} AS w FROM documents),
t AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN
        list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))
        ELSE []::VARCHAR[] END AS t FROM w)
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_trigrams, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct FROM t""",
    "scan_metadata_csv": "WITH " + _META + f"SELECT {_MCOLS} FROM m",
    "dedup_keep_first": "WITH " + _META + f"SELECT {_MCOLS} FROM dd",
    "drop_null_rows": "WITH " + _META + f"""SELECT {_MCOLS} FROM m WHERE title IS NOT NULL AND abstract IS NOT NULL
        AND authors IS NOT NULL AND doi IS NOT NULL AND publish_time IS NOT NULL""",
    "metadata_clean": "WITH " + _META + f"SELECT {_MCOLS} FROM mc",
    "head_rows": "WITH " + _META + f"SELECT {_MCOLS} FROM mc ORDER BY ord LIMIT 5",
    "load_vocabulary": "WITH " + _VOCAB + " SELECT token, id FROM vocab",
}


# --- tokens, embeddings, search variants, n-best rules -----------------------------------

def _vocab_cte(source: str) -> str:
    return ("vocab AS (SELECT token, CAST(id AS INTEGER) AS id FROM ("
            + " UNION ALL ".join(f"SELECT '{t}' AS token, {i} AS id" for i, t in enumerate(_SPECIALS))
            + f" UNION ALL SELECT token, {len(_SPECIALS) - 1} + row_number() OVER (ORDER BY token) AS id FROM "
            f"(SELECT DISTINCT unnest({_wordsf('text')}) AS token FROM {source})))")


def _bert(lst: str) -> str:
    return f"list_concat(list_concat(['[CLS]'], list_slice({lst}, 1, 126)), ['[SEP]'])"


_TK = f"tk AS (SELECT doc_id, {_wordsf('text')} AS w FROM documents)"

_ENC = _STORIES + ", " + _vocab_cte("documents") + f""",
enc AS (SELECT conv_id, story, summary,
               flatten(list_transform(story, lambda l: list_concat(list_concat(['[CLS]'], {_wordsf('l')}), ['[SEP]'])))
               AS toks FROM ss),
ex AS (SELECT conv_id, unnest(toks) AS tok, unnest(generate_series(1, len(toks))) AS pos FROM enc),
ids AS (SELECT ex.conv_id, ex.pos, coalesce(v.id, 3) AS id FROM ex LEFT JOIN vocab v ON v.token = ex.tok),
src AS (SELECT conv_id, pos, id FROM ids WHERE pos <= 512
        UNION ALL
        SELECT conv_id, pos, 0 AS id FROM (SELECT conv_id, unnest(generate_series(len(toks) + 1, 512)) AS pos
                                          FROM enc WHERE len(toks) < 512)),
seg AS (SELECT s.conv_id, s.pos, s.id,
               (((sum(CASE WHEN s.id = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id ORDER BY s.pos
                  ROWS UNBOUNDED PRECEDING) - 1) % 2) + 2) % 2 AS sg,
               CASE WHEN s.id = 0 THEN 0 ELSE 1 END AS mk
        FROM src s JOIN enc e ON e.conv_id = s.conv_id WHERE len(e.story) > 0),
col AS (SELECT conv_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS src,
               string_agg(CAST(sg AS VARCHAR), '' ORDER BY pos) AS segs,
               string_agg(CAST(mk AS VARCHAR), '' ORDER BY pos) AS mask, sum(mk) AS mask_sum FROM seg GROUP BY conv_id)
"""

_EMB = """
nrows AS (SELECT count(*) AS n FROM embeddings),
emb AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, embedding FROM embeddings),
ec AS (SELECT r, unnest(embedding) AS x FROM emb),
rs AS (SELECT r, sum({m}) AS s FROM ec GROUP BY r)
""".format(m=_MICRO.format(x="x"))

_DOC_TOKS = f"""
docs AS (SELECT doc_id AS article_id, {_WORDS.format(t='text')} AS w FROM documents WHERE text IS NOT NULL),
dwin AS (SELECT article_id, {_WINDOWS.format(w='w')} AS wins FROM docs),
dtok AS (SELECT article_id, flatten(wins) AS toks FROM dwin),
dex AS (SELECT article_id, unnest(toks) AS tok, unnest(generate_series(0, len(toks) - 1)) AS pos FROM dtok)
"""

# vector sum of each distinct token (needs _EMB and a relation of tokens)
_TOKEN_SUMS = """
tb AS MATERIALIZED (SELECT tok, {bucket} AS r FROM (SELECT DISTINCT tok FROM {source})),
tv AS MATERIALIZED (SELECT tok, s FROM tb JOIN rs ON rs.r = tb.r)
"""

_EMBED_SUM = ("WITH " + _EMB + "," + _DOC_TOKS + "," + _TOKEN_SUMS.format(bucket=_BUCKET.format(tok="tok"), source="dex") + """
SELECT article_id, CAST(count(*) AS INTEGER) AS n_tokens, CAST(sum((pos + 1) * tv.s) AS BIGINT) AS vec_sum
FROM dex JOIN tv ON tv.tok = dex.tok GROUP BY article_id""")

# one row per window: key = article id * 1000000 + number of the window
_WINDOW_SUM = ("WITH " + _EMB + "," + _DOC_TOKS + "," + _TOKEN_SUMS.format(bucket=_BUCKET.format(tok="tok"), source="dex") + """,
wx AS (SELECT article_id, unnest(wins) AS toks, unnest(generate_series(0, len(wins) - 1)) AS win FROM dwin),
we AS (SELECT article_id * 1000000 + win AS article_id, unnest(toks) AS tok, unnest(generate_series(0, len(toks) - 1)) AS pos FROM wx)
SELECT CAST(article_id AS BIGINT) AS article_id, CAST(count(*) AS INTEGER) AS n_tokens, CAST(sum((pos + 1) * tv.s) AS BIGINT) AS vec_sum
FROM we JOIN tv ON tv.tok = we.tok GROUP BY article_id""")

# tokens in order of first appearance, each token's vectors in order of position
_FLAT_SUM = ("WITH " + _EMB + "," + _DOC_TOKS + "," + _TOKEN_SUMS.format(bucket=_BUCKET.format(tok="tok"), source="dex") + """,
df AS (SELECT article_id, tok, pos, min(pos) OVER (PARTITION BY article_id, tok) AS fp FROM dex),
dn AS (SELECT article_id, tok, row_number() OVER (PARTITION BY article_id ORDER BY fp, pos) AS k FROM df)
SELECT article_id, CAST(count(*) AS INTEGER) AS n_tokens, CAST(sum(k * tv.s) AS BIGINT) AS vec_sum
FROM dn JOIN tv ON tv.tok = dn.tok GROUP BY article_id""")

_NBEST = f"""
nb0 AS (SELECT doc_id, n_chars, unnest(generate_series(0, len(l) - 1)) AS beam, unnest(l) AS line
        FROM (SELECT doc_id, n_chars, string_split(text, {_NL}) AS l FROM documents)),
nb1 AS (SELECT doc_id, n_chars, CAST(beam AS INTEGER) AS beam,
               list_concat(['[unused0]'], {_pieces(_wordsf('line'))}) AS alive FROM nb0),
nb2 AS (SELECT *, 0 AS cand, '[unused1]' AS token FROM nb1
        UNION ALL SELECT *, 1 AS cand, coalesce(alive[2], '[unused0]') AS token FROM nb1),
nb AS (SELECT doc_id, len(alive) - 1 AS step, beam, cand, token, alive,
              CASE WHEN cand = 0 THEN 2 ELSE 7 + length(token) % 100 END AS token_id,
              -CAST((n_chars + beam) % 13 AS DOUBLE) / 4.0::DOUBLE AS beam_logprob,
              CASE WHEN cand = 0 THEN -1.5::DOUBLE
                   ELSE -CAST(length(token) % 5 AS DOUBLE) / 2.0::DOUBLE - 0.25::DOUBLE END AS token_logprob
       FROM nb2),
sup AS (SELECT *, CASE WHEN step < 50 AND token = '[unused1]' THEN -1e20 ELSE token_logprob END AS tlp FROM nb),
sc AS (SELECT *, beam_logprob + tlp AS log_prob,
              pow((5.0::DOUBLE + (step + 1)) / 6.0::DOUBLE, 0.95::DOUBLE) AS penalty FROM sup),
sc2 AS (SELECT *, log_prob / penalty AS score0 FROM sc),
tg AS (SELECT *, list_filter(string_split(replace(array_to_string(alive, ' '), ' ##', ''), ' '), lambda w: w <> '')
              AS w FROM sc2),
tg2 AS (SELECT *, CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2),
              lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) ELSE []::VARCHAR[] END AS tri FROM tg),
bl AS (SELECT *, (len(alive) > 3 AND len(w) > 3 AND list_contains(list_slice(tri, 1, len(tri) - 1), tri[-1]))
              AS blocked FROM tg2),
fin AS (SELECT *, CASE WHEN blocked THEN -10e20 ELSE score0 END AS score FROM bl),
tk5 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, step ORDER BY score DESC, beam, token_id) AS cand_rank
        FROM fin),
fi5 AS (SELECT *, (token = '[unused1]' OR step + 1 >= 200) AS finished FROM tk5 WHERE cand_rank <= 5),
shut AS (SELECT doc_id, min(step) AS closing FROM fi5 WHERE cand_rank = 1 AND finished GROUP BY doc_id),
fi6 AS (SELECT fi5.* REPLACE (finished OR coalesce(step = closing, false) AS finished)
        FROM fi5 LEFT JOIN shut ON shut.doc_id = fi5.doc_id WHERE closing IS NULL OR step <= closing)
"""
_HTEXT = ("replace(array_to_string(list_filter(list_concat(alive, [token]), lambda t: t <> '[unused0]'), ' '), "
          "' ##', '')")

MODEL_SQL = {
    "truncate_tokens": f"WITH {_TK} SELECT doc_id, {_join('list_slice(w, 1, 126)', chr(39) + ' ' + chr(39))} AS tokens FROM tk",
    "add_special_tokens": f"WITH {_TK} SELECT doc_id, {_join("list_concat(list_concat(['[CLS]'], w), ['[SEP]'])", chr(39) + ' ' + chr(39))} AS tokens FROM tk",
    "model_input_rows": f"""WITH {_vocab_cte('documents')}, {_TK},
bt AS (SELECT doc_id, {_bert('w')} AS toks FROM tk),
ex AS (SELECT doc_id, unnest(toks) AS tok, unnest(generate_series(1, len(toks))) AS pos FROM bt),
ids AS (SELECT ex.doc_id, ex.pos, coalesce(v.id, 3) AS id FROM ex LEFT JOIN vocab v ON v.token = ex.tok),
ag AS (SELECT doc_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS s, count(*) AS n FROM ids GROUP BY doc_id)
SELECT doc_id, s || repeat(',0', CAST(128 - n AS INTEGER)) AS ids, CAST(n AS INTEGER) AS mask_sum,
       CAST(0 AS INTEGER) AS type_sum FROM ag""",
    "token_to_id": f"""WITH {_vocab_cte('benchmark')}, {_TK},
ex AS (SELECT doc_id, unnest(w) AS tok, unnest(generate_series(0, len(w) - 1)) AS pos FROM tk),
ids AS (SELECT ex.doc_id, ex.pos, coalesce(v.id, 3) AS id FROM ex LEFT JOIN vocab v ON v.token = ex.tok)
SELECT doc_id, count(*) AS n_tokens, CAST(sum(CASE WHEN id = 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_unknown,
       CAST(sum(id) AS BIGINT) AS id_sum, CAST(sum((pos + 1) * id) AS BIGINT) AS id_place_sum FROM ids GROUP BY doc_id""",
    "id_to_token": f"""WITH {_vocab_cte('benchmark')}, {_TK},
ex AS (SELECT doc_id, unnest(w) AS tok, unnest(generate_series(0, len(w) - 1)) AS pos FROM tk),
ids AS (SELECT ex.doc_id, ex.pos, coalesce(v.id, 3) AS id FROM ex LEFT JOIN vocab v ON v.token = ex.tok)
SELECT ids.doc_id, md5(string_agg(v2.token, ' ' ORDER BY ids.pos)) AS text_md5
FROM ids LEFT JOIN vocab v2 ON v2.id = ids.id GROUP BY ids.doc_id""",
    "truncate_pair": f"""
WITH p AS (SELECT conv_id, turn, len({_wordsf('text')}) AS la,
                  lead(len({_wordsf('text')})) OVER (PARTITION BY conv_id ORDER BY turn) AS lb FROM conversations),
k AS (SELECT conv_id, turn, la, lb, CASE WHEN la + lb <= 64 THEN la ELSE least(la, greatest(64 - lb, 32)) END AS ka
      FROM p WHERE lb IS NOT NULL)
SELECT conv_id, turn, CAST(ka AS INTEGER) AS ka,
       CAST(CASE WHEN la + lb <= 64 THEN lb ELSE 64 - ka END AS INTEGER) AS kb FROM k""",
    "encode_story": "WITH " + _ENC + """,
ag AS (SELECT conv_id, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS s FROM ids GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(ag.n, 0) AS INTEGER) AS n_ids, md5(coalesce(ag.s, '')) AS ids_md5
FROM enc e LEFT JOIN ag ON ag.conv_id = e.conv_id""",
    "collate_rows": "WITH " + _ENC + f"""
SELECT col.conv_id, md5(col.src) AS src_md5, col.segs, CAST(col.mask_sum AS INTEGER) AS mask_sum,
       {_join('e.summary', chr(39) + ' ' + chr(39))} AS tgt_str
FROM col JOIN enc e ON e.conv_id = col.conv_id""",
    "segment_ids": "WITH " + _ENC + """,
fs AS (SELECT conv_id, pos, (((sum(CASE WHEN id = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos
               ROWS UNBOUNDED PRECEDING) - 1) % 2) + 2) % 2 AS sg FROM ids)
SELECT conv_id, string_agg(CAST(sg AS VARCHAR), '' ORDER BY pos) AS segs FROM fs GROUP BY conv_id""",
    "truncate_or_pad": "WITH " + _ENC + " SELECT conv_id, src FROM col",
    "build_mask": "WITH " + _ENC + """
SELECT conv_id, string_agg(CASE WHEN id = 0 THEN '0' ELSE '1' END, '' ORDER BY pos) || '0' AS mask FROM ids GROUP BY conv_id""",
    "source_excerpt": "WITH " + _ENC + """
SELECT seg.conv_id, string_agg(v.token, ' ' ORDER BY seg.pos) AS excerpt
FROM seg LEFT JOIN vocab v ON v.id = seg.id WHERE seg.pos <= 500 GROUP BY seg.conv_id""",
    "embed_tokens": _EMBED_SUM,
    "micro_batch": _WINDOW_SUM,
    "flatten_vectors": _FLAT_SUM,
    "vectors_by_token": "WITH " + _EMB + "," + _DOC_TOKS + "," + _TOKEN_SUMS.format(
        bucket=_BUCKET.format(tok="tok"), source="dex") + """
SELECT article_id, dex.tok AS token, CAST(min(pos) AS INTEGER) AS first_pos, CAST(count(*) AS INTEGER) AS n_vectors,
       CAST(sum(tv.s) AS BIGINT) AS vec_sum
FROM dex JOIN tv ON tv.tok = dex.tok GROUP BY article_id, dex.tok""",
    "first_vector_per_token": "WITH " + _EMB + f""",
qw AS (SELECT item_id AS query_id, {_WORDS.format(t='text')} AS w FROM benchmark),
qd AS (SELECT query_id, flatten({_WINDOWS.format(w='w')}) AS toks FROM qw),
qe AS (SELECT query_id, unnest(toks) AS tok, unnest(generate_series(0, len(toks) - 1)) AS pos FROM qd),
qf AS (SELECT query_id, tok, min(pos) AS p FROM qe GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p) - 1 AS BIGINT) AS tok_no,
       tok AS token, CAST(rs.s AS BIGINT) AS vec_sum
FROM qf JOIN rs ON rs.r = {_BUCKET.format(tok='tok')}""",
    "nearest_token_distance": "WITH " + _VECTOR_INPUTS + f""",
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, tok_no, article_id ORDER BY s, pos) AS rn,
              row_number() OVER (PARTITION BY query_id, tok_no, article_id ORDER BY pos) - 1 AS idx FROM d2)
SELECT query_id, tok_no, article_id, CAST(idx AS INTEGER) AS nearest_pos,
       {_PICO.format(s='s')} / 1e12 AS min_distance FROM rk WHERE rn = 1""",
    "min_distance_per_query_token": "WITH " + _VECTOR_INPUTS + f"""
SELECT query_id, tok_no, article_id, p / 1e12 AS min_distance FROM mins""",
    "mean_best_distance": "WITH " + _VECTOR_INPUTS + f"""
SELECT query_id, article_id, round({_MEAN}, 6) AS distance FROM mins GROUP BY ALL""",
    "topk_closest": SEARCH_VECTORS,
    "ranked_order": SEARCH_VECTORS,
    "selected_articles": "WITH " + _LOOKUP_DISTANCES + """,
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance ASC, article_id DESC) AS rnk FROM means)
SELECT r.query_id, CAST(r.rnk AS INTEGER) AS rank, r.article_id, d.source
FROM r JOIN documents d ON d.doc_id = r.article_id WHERE r.rnk <= 10""",
    "l2_distance": f"""
WITH x AS (SELECT e.vec_id, n.vec_id AS next_id, unnest(e.embedding) AS a, unnest(n.embedding) AS b
           FROM embeddings e JOIN embeddings n ON n.vec_id = e.vec_id + 1),
y AS (SELECT vec_id, next_id, {_MICRO.format(x='a')} AS ma, {_MICRO.format(x='b')} AS mb FROM x)
SELECT vec_id, next_id, sqrt(CAST(sum((ma - mb) * (ma - mb)) AS DOUBLE)) / 1000000.0 AS distance FROM y GROUP BY ALL""",
    "round_vector": """
SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(CAST(x AS DOUBLE), 6) AS value
FROM (SELECT vec_id, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)""",
    "suppress_early_end": "WITH " + _NBEST + "SELECT doc_id, beam, cand, tlp AS token_logprob FROM sup",
    "length_penalty": "WITH " + _NBEST + """
SELECT doc_id, beam, cand,
       round(pow(5.0::DOUBLE + (step + 1), 0.95::DOUBLE) / pow(6.0::DOUBLE, 0.95::DOUBLE), 12) AS lp_wu,
       round(CAST(step + 1 AS DOUBLE), 12) AS lp_avg, round(1.0::DOUBLE, 12) AS lp_none FROM nb""",
    "candidate_score": "WITH " + _NBEST + "SELECT doc_id, beam, cand, CAST(score0 AS FLOAT) AS score FROM sc2",
    "block_repeated_trigram": "WITH " + _NBEST + "SELECT doc_id, beam, cand, blocked FROM bl",
    "candidate_topk": "WITH " + _NBEST + """
SELECT doc_id, CAST(step AS INTEGER) AS step, CAST(cand_rank AS INTEGER) AS cand_rank, beam, cand, CAST(score AS FLOAT) AS score
FROM tk5 WHERE cand_rank <= 5""",
    "best_hypothesis": "WITH " + _NBEST + f"""
SELECT doc_id, beam, cand, CAST(score AS FLOAT) AS score, {_HTEXT} AS text FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, step, beam, token_id) AS rk
  FROM fin WHERE token = '[unused1]') WHERE rk = 1""",
    "rerank_hypotheses": "WITH " + _NBEST + f"""
SELECT doc_id, beam, cand, CAST(score AS FLOAT) AS score, finished, {_HTEXT} AS text FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY finished DESC, score DESC, step, cand_rank) AS rk
  FROM fi6) WHERE rk = 1""",
    "split_flat_index": "WITH " + _NBEST + """
SELECT doc_id, beam, cand, CAST((beam * 1000 + token_id) // 1000 AS INTEGER) AS beam_rec,
       CAST((beam * 1000 + token_id) % 1000 AS INTEGER) AS token_rec FROM nb""",
}
MODEL_SQL["segment_ids_long"] = MODEL_SQL["segment_ids"]
MODEL_SQL["token_to_id_shuffled"] = MODEL_SQL["token_to_id"]
MODEL_SQL["embed_query"] = "WITH " + _EMB + f""",
qw AS (SELECT item_id AS query_id, {_WORDS.format(t='text')} AS w FROM benchmark),
qd AS (SELECT query_id, flatten({_WINDOWS.format(w='w')}) AS toks FROM qw),
qe AS (SELECT query_id, unnest(toks) AS tok, unnest(generate_series(0, len(toks) - 1)) AS pos FROM qd)
SELECT query_id, CAST(pos AS INTEGER) AS pos, tok AS token, CAST(rs.s AS BIGINT) AS vec_sum
FROM qe JOIN rs ON rs.r = {_BUCKET.format(tok='tok')}"""

# --- summaries (stand-in lead generator: hypothesis j = the j-th encoded line, j < 3) ------

_SUMMARIES = "WITH " + _LOOKUP_DISTANCES + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance ASC, article_id DESC) AS rnk FROM means),
chosen AS (SELECT article_id, min(rnk) AS best_rank FROM r WHERE rnk <= 10 GROUP BY article_id),
sel AS (SELECT d.doc_id AS article_id, d.text, d.source, c.best_rank
        FROM documents d JOIN chosen c ON c.article_id = d.doc_id),
sln AS (SELECT article_id, {_lines('text')} AS lines FROM sel),
smk AS (SELECT article_id, lines,
               coalesce(list_position(list_transform(lines, lambda x: starts_with(x, '@highlight')), true), 0) AS p
        FROM sln),
sst AS (SELECT article_id, CASE WHEN p = 0 THEN lines ELSE list_slice(lines, 1, p - 1) END AS story FROM smk),
slw AS (SELECT article_id, unnest(generate_series(1, len(story))) AS j,
               unnest(list_transform(story, lambda l: {_wordsf('l')})) AS w
        FROM sst WHERE len(story) > 0),
slp AS (SELECT article_id, j, w,
               1 + coalesce(sum(len(w) + 2) OVER (PARTITION BY article_id ORDER BY j
                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pj
        FROM slw),
shy AS (SELECT article_id, j, list_slice(w, 1, least(len(w), 512 - pj)) AS body FROM slp WHERE j <= 3 AND pj <= 512),
sbh AS (SELECT article_id, body, row_number() OVER (PARTITION BY article_id ORDER BY len(body), j) AS rk FROM shy),
best AS (SELECT article_id, body FROM sbh WHERE rk = 1),
known AS (SELECT DISTINCT unnest({_wordsf('text')}) AS token FROM documents),
bw AS (SELECT article_id, unnest(body) AS w, unnest(generate_series(1, len(body))) AS i FROM best),
bt AS (SELECT bw.article_id, string_agg(CASE WHEN k.token IS NULL THEN '[UNK]' ELSE bw.w END, ' ' ORDER BY bw.i) AS s
       FROM bw LEFT JOIN known k ON k.token = bw.w GROUP BY bw.article_id),
sm AS (SELECT b.article_id, CAST(-len(b.body) AS DOUBLE) AS score,
              replace(CASE WHEN bt.s IS NULL THEN '[unused1]' ELSE bt.s || ' [unused1]' END, ' ##', '') AS summary,
              s.source, s.best_rank
       FROM best b JOIN sel s ON s.article_id = b.article_id LEFT JOIN bt ON bt.article_id = b.article_id)
"""

_SINK = _SUMMARIES + """
SELECT CAST(row_number() OVER (ORDER BY best_rank, article_id) - 1 AS BIGINT) AS "index",
       CAST(article_id AS VARCHAR) AS "Paper id", source AS "Title", summary AS "Summary" FROM sm"""

SUMMARY_SQL = {
    "summarize": _SUMMARIES + "SELECT article_id, score, summary FROM sm",
    "attach_summaries": _SUMMARIES + "SELECT CAST(article_id AS VARCHAR) AS paper_id, source AS title, summary FROM sm",
    "sink_summaries_csv": _SINK,
    "summarize_articles": _SINK,
}


def _basic(t: str) -> str:
    """BERT basic tokenizer for ASCII punctuation: lower, strip accents, split punctuation."""
    return ("list_filter(string_split(regexp_replace(regexp_replace(strip_accents(lower(" + t + ")), "
            "'([!-/:-@\\[-`{-~])', ' \\1 ', 'g'), '\\s+', ' ', 'g'), ' '), lambda w: w <> '')")


WORDPIECE_SQL = f"""
WITH known AS (SELECT DISTINCT unnest({_basic('text')}) AS token FROM documents),
bw AS (SELECT item_id, unnest({_basic('text')}) AS w, unnest(generate_series(1, len({_basic('text')}))) AS i
       FROM benchmark),
bp AS (SELECT bw.item_id, bw.i,
              CASE WHEN length(bw.w) > 100 OR k.token IS NULL THEN '[UNK]' ELSE bw.w END AS piece
       FROM bw LEFT JOIN known k ON k.token = bw.w)
SELECT b.item_id, CAST(count(bp.piece) AS INTEGER) AS n_pieces,
       coalesce(string_agg(bp.piece, ' ' ORDER BY bp.i), '') AS pieces
FROM benchmark b LEFT JOIN bp ON bp.item_id = b.item_id GROUP BY b.item_id"""

def oracle_sql() -> dict[str, str]:
    out = {
        "search_vectors": SEARCH_VECTORS,
        "search_articles": SEARCH_ARTICLES,
    }
    out.update(TEXT_SQL)
    out.update(MODEL_SQL)
    out.update(SUMMARY_SQL)
    out["wordpiece_tokenize"] = WORDPIECE_SQL
    out["search_model"] = SEARCH_ARTICLES
    out["scan_article_files"] = TEXT_SQL["scan_article_json"]
    out.update({
        "running_topk": SEARCH_VECTORS,
        "stream_resume": SEARCH_VECTORS,
        "stream_topk": SEARCH_ARTICLES,
        "stream_articles": "SELECT CAST(doc_id AS VARCHAR) AS paper_id, source AS title FROM documents",
    })
    return out






"""DuckDB SQL for each registered query, written apart from the Spark code."""

from __future__ import annotations

WS = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
LINE = r"\r\n|[\x{a}-\x{d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
TOKEN = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}]|[A-Za-z0-9]+"
TAIL = rf"(?:{WS}|⽗|父|<\|im_end\|>|<\|endoftext\|>)+\z"
SYSTEM = "You turn spoken English into written Chinese."
INSTRUCTION = "Give the Chinese text only."
PREFIX = "Put into Chinese: "


def mixed(c: str) -> str:
    return f"translate({c}, 'aeiou', '天气很好的')"


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{WS}+', ''), '{WS}+\\z', '')"


def norm(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


def tokens(c: str) -> str:
    return f"regexp_extract_all({c}, '{TOKEN}')"


def words(c: str) -> str:
    return (
        f"list_filter(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]+'), "
        "lambda w: regexp_full_match(w, '[A-Z][A-Za-z]+'))"
    )


def digest(c: str) -> str:
    return f"('0x' || left(md5({c}), 8))::BIGINT"


def entities(c: str) -> str:
    found = f"regexp_extract_all({c}, '\\p{{Nd}}+\\.?\\p{{Nd}}*')"
    return f"list_distinct(list_concat({words(c)}, {found}))"


DOCS = "docs AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, * FROM documents)"


def pairs(use_mixed: bool = True) -> str:
    ref = mixed("text") if use_mixed else "text"
    said, misheard = ("t很好n", "c很好n") if use_mixed else ("tion", "cion")
    return f"""
base AS (
  SELECT doc_id AS id, source AS system, lang, '/audio/' || doc_id || '.wav' AS audio,
         {ref} AS reference, length(text) / 1000.0::DOUBLE AS latency_s,
         CASE WHEN contains(text, '|') THEN 'OOM'
              WHEN contains(text, '#') THEN 'ERR:decode' ELSE 'ok' END AS status
  FROM documents),
pairs AS (
  SELECT *, CASE WHEN status = 'ok' THEN replace(array_to_string(list_filter(
      string_split(reference, ' '), lambda w: length(w) <> 3), ' '), '{said}', '{misheard}')
    ELSE '' END AS prediction
  FROM base),
valid AS (
  SELECT * FROM pairs WHERE status = 'ok' AND {strip('prediction')} <> '')"""


RAW = """
raw AS (
  SELECT doc_id AS id, CASE lang
    WHEN 'en' THEN 'Transcription: ' || source || chr(10) || '  TRANSLATION: ' || text || ' 父 <|im_end|>'
    WHEN 'fr' THEN text || '<|endoftext|>⽗ ' || chr(10) || ' '
    WHEN 'de' THEN '　' || text ELSE text END AS answer
  FROM documents)"""
CLEANED = f"""
cleaned AS (
  SELECT id, {strip(f"regexp_replace(answer, '{TAIL}', '')")} AS cleaned FROM raw)"""

CORPUS = f"""{DOCS},
corpus AS (
  SELECT row_idx, text AS sentence,
    CASE WHEN contains(text, '@') OR contains(text, '#') OR contains(text, '|')
         THEN ' ' || chr(10) ELSE {mixed('text')} END AS translation
  FROM docs)"""
SPEECH = f"""{CORPUS},
speech AS (
  SELECT row_idx, '{SYSTEM}' AS system_turn, '<audio>{INSTRUCTION}' AS user_turn,
    {norm('translation')} AS assistant_turn, 3::BIGINT AS n_turns,
    '/audio/' || row_idx || '.wav' AS audio
  FROM corpus WHERE {norm('translation')} <> '')"""
CLOSED = f"""{SPEECH},
closed AS (
  SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, row_idx AS origin,
    audio, assistant_turn FROM speech)"""
ASR = f"""{DOCS},
asr AS (
  SELECT row_idx, CASE WHEN lang <> 'es' THEN row_idx + 1 END AS idx,
    CASE WHEN contains(text, '@') THEN NULL WHEN contains(text, '#') THEN '  '
         ELSE text END AS pred_zh,
    CASE WHEN contains(text, '|') THEN '' ELSE {mixed('text')} END AS ref_zh,
    source AS shard
  FROM docs),
texts AS (
  SELECT row_idx, shard, coalesce(idx, row_idx) AS idx,
    {norm("coalesce(pred_zh, '')")} AS src_en, {norm("coalesce(ref_zh, '')")} AS ref_zh
  FROM asr),
predicted AS (
  SELECT *,
    CASE WHEN src_en = '' OR ref_zh = '' THEN 'empty src/ref'
         WHEN contains(src_en, '#') THEN 'decode'
         WHEN contains(src_en, '|') THEN 'OOM' END AS error
  FROM texts),
outcomes AS (
  SELECT *, CASE WHEN error IS NULL THEN {strip(f"replace('{PREFIX}' || src_en, 'th', 'd')")}
            ELSE '' END AS pred_zh FROM predicted)"""

CHUNKS = f"""{pairs()},
chunks AS (
  SELECT id, system, 'chunk0.jsonl' AS file, prediction AS pred_zh, NULL AS pred, reference AS ref_zh, NULL AS ref
    FROM pairs WHERE lang = 'en'
  UNION ALL SELECT id, system, 'chunk1.jsonl', NULL, prediction, NULL, reference
    FROM pairs WHERE lang IN ('de', 'fr')
  UNION ALL SELECT id, system, 'chunk2.jsonl', ' ', prediction, NULL, reference
    FROM pairs WHERE lang = 'es'),
filled AS (
  SELECT id, system, {strip("coalesce(pred_zh, pred, '')")} AS pred,
    {strip("coalesce(ref_zh, ref, '')")} AS ref FROM chunks),
kept AS (SELECT * FROM filled WHERE pred <> '' AND ref <> '')"""


def ngrams(source: str, pred: str = "prediction", ref: str = "reference", order: int = 6) -> str:
    """Long table gram_stats(id, system, n, h, r, m)."""
    def longer(n: int) -> str:
        return " || ".join(["ch"] + [f"lead(ch, {k}) OVER w" for k in range(1, n)])

    grams = ", ".join(f"{longer(n)} AS g{n}" for n in range(1, order + 1))
    counted = " UNION ALL ".join(
        f"SELECT id, {n} AS n, sum(least(h, r)) AS m FROM (SELECT id, g{n} AS g, "
        f"count(*) FILTER (is_h) AS h, count(*) FILTER (NOT is_h) AS r "
        f"FROM grams WHERE g{n} IS NOT NULL GROUP BY id, g{n}) GROUP BY id"
        for n in range(1, order + 1)
    )
    return f"""
cut AS (
  SELECT id, system,
    string_split(regexp_replace({pred}, '{WS}', '', 'g'), '') AS hc,
    string_split(regexp_replace({ref}, '{WS}', '', 'g'), '') AS rc
  FROM {source}),
chars AS (
  SELECT id, true AS is_h, unnest(hc) AS ch, generate_subscripts(hc, 1) AS i FROM cut
  UNION ALL
  SELECT id, false AS is_h, unnest(rc) AS ch, generate_subscripts(rc, 1) AS i FROM cut),
grams AS MATERIALIZED (
  SELECT id, is_h, {grams} FROM chars WINDOW w AS (PARTITION BY id, is_h ORDER BY i)),
hits AS ({counted}),
gram_stats AS (
  SELECT cut.id, cut.system, o.n,
    greatest(len(hc) - o.n + 1, 0) AS h, greatest(len(rc) - o.n + 1, 0) AS r,
    coalesce(hits.m, 0) AS m
  FROM cut CROSS JOIN range(1, {order + 1}) AS o(n)
  LEFT JOIN hits ON hits.id = cut.id AND hits.n = o.n)"""


def sums(by: str) -> str:
    keys = f"{by}, n" if by else "n"
    return f"""
sums AS (
  SELECT {keys}, sum(h)::BIGINT AS h, sum(r)::BIGINT AS r, sum(m)::BIGINT AS m,
    sum(CASE WHEN r > 0 THEN h ELSE 0 END)::BIGINT AS c
  FROM gram_stats GROUP BY {keys})"""


def chrf(by: str) -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""{sums(by)},
pr AS (
  SELECT {keys} avg(m / c) AS p, avg(m / r) AS q FROM sums WHERE c > 0 AND r > 0 {group}),
chrf AS (
  SELECT {keys} CASE WHEN p + q > 0 THEN round(100 * 5 * p * q / (4 * p + q), 4)
    ELSE 0 END AS "chrF" FROM pr)"""


def bleu(by: str) -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""{sums(by)},
smoothed AS (
  SELECT {keys} n, h, r, m,
    sum(CASE WHEN h > 0 AND m = 0 THEN 1 ELSE 0 END) OVER ({part}ORDER BY n) AS k
  FROM sums WHERE n <= 4),
prec AS (
  SELECT *, CASE WHEN h = 0 THEN 0 WHEN m = 0 THEN 100 / (pow(2, k) * h)
    ELSE 100.0::DOUBLE * m / h END AS p FROM smoothed),
wide AS (
  SELECT {keys} max(h) FILTER (n = 1) AS hyp_len, max(r) FILTER (n = 1) AS ref_len,
    sum(m) AS hits, min(p) AS least_p,
    exp(avg(CASE WHEN p > 0 THEN ln(p) END)) AS mean_p,
    max(p) FILTER (n = 1) AS p1, max(p) FILTER (n = 2) AS p2,
    max(p) FILTER (n = 3) AS p3, max(p) FILTER (n = 4) AS p4
  FROM prec {group}),
pen AS (
  SELECT *, CASE WHEN hyp_len >= ref_len THEN 1.0::DOUBLE
    ELSE exp(1 - ref_len / hyp_len) END AS bp FROM wide),
bleu AS (
  SELECT *, CASE WHEN hits > 0 AND least_p > 0 THEN bp * mean_p ELSE 0 END AS score FROM pen)"""


BLEU_TEXT = (
    "printf('BLEU = %.2f %.1f/%.1f/%.1f/%.1f (BP = %.3f ratio = %.3f hyp_len = %d ref_len = %d)', "
    "score, p1, p2, p3, p4, bp, hyp_len / ref_len, hyp_len, ref_len)"
)


def overlap(source: str, pred: str = "prediction", ref: str = "reference") -> str:
    def counted(name: str, col: str) -> str:
        return (
            f"{name} AS (SELECT id, tok, count(*) AS k FROM "
            f"(SELECT id, unnest({tokens(col)}) AS tok FROM {source}) GROUP BY ALL)"
        )
    return f"""
sizes AS (
  SELECT id, system, len({tokens(pred)}) AS pred_tokens, len({tokens(ref)}) AS ref_tokens
  FROM {source}),
{counted('pt', pred)},
{counted('rt', ref)},
common AS (
  SELECT pt.id, sum(least(pt.k, rt.k)) AS matched
  FROM pt JOIN rt ON pt.id = rt.id AND pt.tok = rt.tok GROUP BY pt.id),
overlap AS (
  SELECT sizes.*, coalesce(matched, 0)::BIGINT AS matched
  FROM sizes LEFT JOIN common USING (id) WHERE pred_tokens > 0 AND ref_tokens > 0)"""


RATES = """round(100 * avg(1 - matched / pred_tokens), 4) AS hallucination_rate,
  round(100 * avg(matched / ref_tokens), 4) AS content_coverage"""

ENTITY_ROWS = f"""{pairs(False)},
found AS (SELECT id, system, prediction, {entities('reference')} AS es FROM valid),
kept AS (
  SELECT id, system, len(es) AS n,
    len(list_filter(es, lambda e: contains(prediction, e))) AS k
  FROM found)"""

MEDIA = """
items AS (
  SELECT row_idx, '/audio/' || label || '/' || (row_idx // 3) || '.wav' AS audio_path,
    label, embedding AS features, 62 + label // 2 AS expected_len
  FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_idx, * FROM embeddings)),
indexes AS (
  SELECT 'train' AS split, 0 AS rank, audio_path, max(row_idx) AS idx FROM items
    WHERE label <= 5 GROUP BY audio_path
  UNION ALL SELECT 'val', 1, audio_path, max(row_idx) FROM items
    WHERE label BETWEEN 4 AND 8 GROUP BY audio_path),
merged AS (
  SELECT audio_path, split, idx FROM indexes
  QUALIFY row_number() OVER (PARTITION BY audio_path ORDER BY rank DESC) = 1)"""
ALIGNED = f"""{MEDIA},
aligned AS (
  SELECT row_idx, label, audio_path,
    CASE WHEN len(features) = 0 THEN 'empty' WHEN len(features) < expected_len THEN 'padded'
         WHEN len(features) > expected_len THEN 'cut' ELSE 'exact' END AS adjustment,
    list_transform(range(1, expected_len + 1),
      lambda i: features[least(i, len(features))]) AS frames
  FROM items)"""

ORACLE = {
    "jsonl_dir_scan": f"WITH {DOCS} SELECT row_idx, doc_id, lang, md5(text) AS text_md5 FROM docs",
    "predictions_scan": f"""WITH {pairs()}
        SELECT id, audio, md5(reference) AS reference_md5, md5(prediction) AS prediction_md5,
          status, latency_s FROM pairs""",
    "chat_scan": """SELECT conv_id, count(*) AS n_turns,
          string_agg(role, ',' ORDER BY turn) AS roles,
          string_agg(text, chr(10) ORDER BY turn) AS contents
        FROM conversations GROUP BY conv_id""",
    "corpus_scan": f"WITH {DOCS} SELECT row_idx, doc_id, source, md5(text) AS text_md5 FROM docs",
    "row_ordinal": f"WITH {DOCS} SELECT row_idx, doc_id FROM docs",
    "path_index_scan": f"WITH {MEDIA} SELECT audio_path, idx, split FROM indexes",
    "shard_fanout": f"""WITH {ASR}
        SELECT shard, count(*) AS total, count(*) FILTER (error IS NULL) AS ok,
          count(*) FILTER (error = 'empty src/ref') AS empty,
          count(*) FILTER (error = 'OOM') AS oom, sum(length(pred_zh))::BIGINT AS pred_chars,
          sum({digest('pred_zh')})::BIGINT AS pred_digest
        FROM outcomes GROUP BY shard""",
    "inputs_scan": f"""WITH {DOCS},
        kept AS (
          SELECT row_number() OVER (ORDER BY lang, row_idx) - 1 AS row_idx, doc_id, md5(text) AS text_md5
          FROM docs WHERE lang IN ('de', 'fr'))
        SELECT how, row_idx, doc_id, text_md5 FROM kept, (VALUES ('glob'), ('list')) AS t(how)""",
    "report_files": f"""WITH {pairs()}
        SELECT system, count(*) AS total, count(*) FILTER (status = 'ok') AS ok,
          count(*) FILTER (status = 'ok' AND {strip('prediction')} <> '') AS valid, NULL::DOUBLE AS "COMET"
        FROM pairs GROUP BY system""",
    "test_chat_records": f"WITH {SPEECH} SELECT * FROM speech WHERE row_idx < 120",
    "normalize_text": f"WITH {RAW} SELECT id, {norm('answer')} AS normalized FROM raw",
    "clean_prediction": f"WITH {RAW}, {CLEANED} SELECT id, cleaned FROM cleaned",
    "extract_translation": f"""WITH {RAW}, {CLEANED},
        labelled AS (
          SELECT id, cleaned, list_filter(
            list_transform(string_split_regex(cleaned, '{LINE}'), lambda s: {strip('s')}),
            lambda s: starts_with(lower(s), 'translation:')) AS hits
          FROM cleaned)
        SELECT id, CASE WHEN len(hits) > 0 THEN {strip('substr(hits[1], 13)')}
          ELSE {strip('cleaned')} END AS translation FROM labelled""",
    "tokenize_mixed": f"""WITH toks AS (SELECT doc_id, {tokens(mixed('text'))} AS t FROM documents)
        SELECT doc_id, len(t) AS n_tokens, array_to_string(t, '|') AS tokens FROM toks""",
    "extract_entities": f"""WITH found AS (SELECT doc_id, {entities('text')} AS e FROM documents)
        SELECT doc_id, len(e) AS n_entities, coalesce(array_to_string(list_sort(e), '|'), '') AS entities
        FROM found""",
    "coalesce_fields": f"WITH {CHUNKS} SELECT id, pred, ref FROM kept",
    "merge_chunks": f"""WITH {CHUNKS}
        SELECT id, system, length(pred_zh) AS pred_zh_chars, length(pred) AS pred_chars,
          length(ref_zh) AS ref_zh_chars, length(ref) AS ref_chars,
          md5(pred_zh) AS pred_zh_md5, md5(pred) AS pred_md5, md5(ref_zh) AS ref_zh_md5, md5(ref) AS ref_md5
        FROM chunks""",
    "url_parts": r"""WITH cut AS (
          SELECT page_id, rtrim(url, '/') AS u FROM pages),
        named AS (
          SELECT page_id, u, list_last(string_split(u, '/')) AS name FROM cut)
        SELECT page_id, name,
          CASE WHEN strpos(reverse(name), '.') BETWEEN 2 AND length(name) - 1
               THEN left(name, length(name) - strpos(reverse(name), '.')) ELSE name END AS stem,
          rtrim(left(u, length(u) - length(name)), '/') AS parent
        FROM named""",
    "speech_chat_records": f"WITH {SPEECH} SELECT * FROM speech",
    "text_chat_records": f"""WITH {ASR}
        SELECT row_idx, '{SYSTEM}' AS system_turn, '{PREFIX}' || src_en AS user_turn,
          ref_zh AS assistant_turn, 3::BIGINT AS n_turns
        FROM texts WHERE src_en <> '' AND ref_zh <> ''""",
    "two_step_records": f"""WITH {CLOSED}
        SELECT row_idx, '{SYSTEM}' AS system_turn, '<audio>{INSTRUCTION}' AS user_turn,
          'Transcription: ' || sentence || chr(10) || 'Translation: ' || translation AS assistant_turn,
          3::BIGINT AS n_turns, audio
        FROM closed JOIN corpus USING (row_idx)""",
    "positional_join": f"""WITH {CLOSED}
        SELECT row_idx, audio, sentence FROM closed JOIN corpus USING (row_idx)""",
    "keyed_join": f"""WITH {CLOSED}
        SELECT closed.row_idx, audio, sentence
        FROM closed JOIN corpus ON closed.origin = corpus.row_idx""",
    "alignment_check": f"""WITH {CLOSED}
        SELECT row_idx, left(assistant_turn, 60) AS record_preview,
          left(translation, 60) AS corpus_preview
        FROM closed JOIN corpus USING (row_idx)
        WHERE {norm('assistant_turn')} IS DISTINCT FROM {norm('translation')}""",
    "prompt_records": f"""
        SELECT doc_id, 0::BIGINT AS turn, 'system' AS role, 0::BIGINT AS part, 'text' AS type,
          '{SYSTEM}' AS text, NULL::VARCHAR AS audio FROM documents
        UNION ALL SELECT doc_id, 1, 'user', 0, 'audio', NULL, '/audio/' || doc_id || '.wav' FROM documents
        UNION ALL SELECT doc_id, 1, 'user', 1, 'text', '{PREFIX}' || {norm('text')}, NULL FROM documents""",
    "last_assistant": """SELECT conv_id,
          arg_max(text, turn) FILTER (role = 'assistant') AS content
        FROM conversations GROUP BY conv_id""",
    "first_n_valid": f"""WITH {ASR}
        SELECT row_idx, src_en AS src, ref_zh AS tgt FROM texts
        WHERE src_en <> '' AND ref_zh <> '' ORDER BY row_idx LIMIT 100""",
    "head_n": f"WITH {DOCS} SELECT row_idx, doc_id, source FROM docs ORDER BY row_idx LIMIT 120",
    "slice_n": f"WITH {DOCS} SELECT row_idx, doc_id, source FROM docs ORDER BY row_idx LIMIT 100 OFFSET 150",
    "batch_predict": """SELECT doc_id,
          CASE WHEN contains(text, '#') OR contains(text, '|') THEN ''
               ELSE replace(text, 'th', 'd') END AS prediction,
          CASE WHEN contains(text, '#') THEN 'ERR:decode' WHEN contains(text, '|') THEN 'OOM'
               ELSE 'ok' END AS status
        FROM documents""",
    "asr_defaults": f"WITH {ASR} SELECT idx, src_en, ref_zh, pred_zh, error FROM outcomes",
    "prediction_job": f"""WITH {SPEECH}
        SELECT row_idx AS id, audio, assistant_turn AS reference,
          CASE WHEN ends_with(audio, '7.wav') THEN '' ELSE '片' || audio END AS prediction,
          CASE WHEN ends_with(audio, '7.wav') THEN 'ERR:unreadable ' || audio ELSE 'ok' END AS status
        FROM speech""",
    "valid_predictions": f"WITH {pairs()} SELECT id, system, prediction FROM valid",
    "run_summary": f"""WITH {pairs()}
        SELECT system, count(*) AS total, count_if(status = 'ok')::BIGINT AS ok,
          count_if(status = 'ok' AND {strip('prediction')} <> '')::BIGINT AS valid
        FROM pairs GROUP BY system""",
    "latency_summary": f"""WITH {pairs()}
        SELECT system, count(*) FILTER (status = 'ok') AS ok,
          round((sum(latency_s::DECIMAL(18, 3)) FILTER (status = 'ok'))::DOUBLE
            / count(*) FILTER (status = 'ok'), 4) AS mean_s,
          min(latency_s) FILTER (status = 'ok') AS min_s,
          max(latency_s) FILTER (status = 'ok') AS max_s,
          round(sum(latency_s::DECIMAL(18, 3))::DOUBLE / 60, 4) AS total_min
        FROM pairs GROUP BY system""",
    "status_counts": f"""WITH {pairs()}
        SELECT split_part(status, ':', 1) AS outcome, count(*) AS n FROM pairs GROUP BY 1""",
    "char_ngram_stats": f"WITH {pairs()}, {ngrams('valid')} SELECT id, "
        + ", ".join(
            f"max({k}) FILTER (n = {n})::BIGINT AS {k}{n}" for k in "hrm" for n in range(1, 7)
        )
        + " FROM gram_stats GROUP BY id",
    "token_counts": f"""SELECT doc_id, token, count(*) AS n FROM (
          SELECT doc_id, unnest({tokens(mixed('text'))}) AS token FROM documents)
        GROUP BY doc_id, token""",
    "token_overlap": f"""WITH {pairs()}, {overlap('valid')}
        SELECT id, pred_tokens, ref_tokens, matched FROM overlap""",
    "hallucination_coverage": f"""WITH {pairs()}, {overlap('valid')}
        SELECT system, count(*) AS scored, {RATES} FROM overlap GROUP BY system""",
    "chrf_corpus": f"""WITH {pairs()}, {ngrams('valid')}, {chrf('system')}
        SELECT system, "chrF" FROM chrf""",
    "bleu_corpus": f"""WITH {pairs()}, {ngrams('valid')}, {bleu('system')}
        SELECT system, round(score, 4) AS bleu, round(bp, 4) AS brevity_penalty,
          hyp_len, ref_len, {BLEU_TEXT} AS bleu_text FROM bleu""",
    "entity_accuracy": f"""WITH {ENTITY_ROWS}
        SELECT system, sum(n)::BIGINT AS total_entities, sum(k)::BIGINT AS retained_entities,
          coalesce(round(100 * (sum(k) / nullif(sum(n), 0)), 4), 0) AS "ETA"
        FROM kept GROUP BY system""",
    "entity_retention": f"""WITH {ENTITY_ROWS}
        SELECT system, coalesce(round(100 * avg(CASE WHEN n > 0 THEN k / n END), 4), 0) AS "ERR"
        FROM kept GROUP BY system""",
    "entity_report": f"""WITH {ENTITY_ROWS}, {ngrams('valid')}, {bleu('')}
        SELECT (SELECT count(*) FROM pairs) AS total, (SELECT count(*) FROM valid) AS valid,
          (SELECT coalesce(round(100 * (sum(k) / nullif(sum(n), 0)), 4), 0) FROM kept) AS "ETA",
          (SELECT coalesce(round(100 * avg(CASE WHEN n > 0 THEN k / n END), 4), 0) FROM kept) AS "ERR",
          {BLEU_TEXT} AS "BLEU", NULL::DOUBLE AS "COMET"
        FROM bleu""",
    "intrinsic_report": f"""WITH {pairs()}, {ngrams('valid')}, {chrf('')}, {overlap('valid')}
        SELECT 'pairs' AS input, (SELECT count(*) FROM valid) AS valid, (SELECT "chrF" FROM chrf) AS "chrF", {RATES}
        FROM overlap""",
    "system_report": f"""WITH {CHUNKS}, {ngrams('kept', 'pred', 'ref')}, {chrf('system')},
        {overlap('kept', 'pred', 'ref')},
        rates AS (SELECT system, {RATES} FROM overlap GROUP BY system),
        samples AS (SELECT system, count(*) AS samples FROM kept GROUP BY system),
        files AS (SELECT system, string_agg(DISTINCT file, ',' ORDER BY file) AS files FROM chunks GROUP BY system)
        SELECT system AS model, coalesce(samples, 0) AS samples, "chrF", hallucination_rate, content_coverage, files
        FROM files LEFT JOIN samples USING (system) LEFT JOIN chrf USING (system) LEFT JOIN rates USING (system)""",
    "path_index": f"""WITH {MEDIA}
        SELECT audio_path, max(row_idx) AS idx FROM items GROUP BY audio_path""",
    "merge_index": f"WITH {MEDIA} SELECT audio_path, split, idx FROM merged",
    "cache_lookup": f"""WITH {MEDIA}
        SELECT row_idx, audio_path, split, idx, idx IS NOT NULL AS hit
        FROM items LEFT JOIN merged USING (audio_path)""",
    "pending_items": f"""WITH {MEDIA}
        SELECT row_idx, audio_path FROM items
        WHERE audio_path NOT IN (SELECT audio_path FROM merged)""",
    "extract_pending": f"""WITH {MEDIA},
        todo AS (
          SELECT audio_path, max(row_idx) AS idx FROM items
          WHERE audio_path NOT IN (SELECT audio_path FROM merged) GROUP BY audio_path)
        SELECT audio_path, idx,
          CASE WHEN ends_with(audio_path, '7.wav') THEN 'ERR:unreadable' ELSE 'ok' END AS status,
          CASE WHEN NOT ends_with(audio_path, '7.wav') THEN array_to_string(
            list_transform(string_split(audio_path, '/'), lambda p: length(p)), ',') END AS frames
        FROM todo""",
    "align_features": f"""WITH {ALIGNED}
        SELECT row_idx, adjustment, generate_subscripts(frames, 1)::BIGINT - 1 AS pos,
          unnest(frames)::DOUBLE AS value FROM aligned""",
    "strip_padding": f"""WITH {MEDIA},
        kept AS (SELECT row_idx, list_filter(features, lambda x: x > 0) AS frames FROM items)
        SELECT row_idx, len(frames) AS valid_length,
          generate_subscripts(frames, 1)::BIGINT - 1 AS pos, unnest(frames)::DOUBLE AS value
        FROM kept""",
    "batch_concat": f"""WITH {ALIGNED},
        flat AS (
          SELECT row_idx, row_idx // 32 AS batch, generate_subscripts(frames, 1) AS i,
            unnest(frames)::DOUBLE AS value FROM aligned)
        SELECT batch, count(DISTINCT row_idx) OVER (PARTITION BY batch) AS samples,
          row_number() OVER (PARTITION BY batch ORDER BY row_idx, i) - 1 AS pos, value
        FROM flat""",
    "cached_batches": f"""WITH {MEDIA},
        found AS (
          SELECT i.row_idx, list_transform(range(1, i.expected_len + 1),
              lambda k: f.features[least(k, len(f.features))]) AS frames
          FROM items i JOIN merged m USING (audio_path) JOIN items f ON f.row_idx = m.idx),
        flat AS (
          SELECT row_idx, row_idx // 32 AS batch, generate_subscripts(frames, 1) AS i,
            unnest(frames)::DOUBLE AS value FROM found)
        SELECT batch, count(DISTINCT row_idx) OVER (PARTITION BY batch) AS samples,
          row_number() OVER (PARTITION BY batch ORDER BY row_idx, i) - 1 AS pos, value
        FROM flat""",
    "cache_audit": f"""WITH {ALIGNED}
        SELECT label, count(*) AS items, count(merged.idx) AS hits,
          count(*) - count(merged.idx) AS misses,
          count(*) FILTER (idx IS NOT NULL AND adjustment = 'padded') AS padded,
          count(*) FILTER (idx IS NOT NULL AND adjustment = 'cut') AS cut,
          count(*) FILTER (idx IS NOT NULL AND adjustment = 'exact') AS exact,
          count(*) FILTER (idx IS NOT NULL AND adjustment = 'empty') AS empty,
          coalesce(sum(CASE WHEN idx IS NOT NULL THEN len(frames) END), 0)::BIGINT AS frames
        FROM aligned LEFT JOIN merged USING (audio_path) GROUP BY label""",
}

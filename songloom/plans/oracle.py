"""SQL that states each query's result independently, over the given tables."""

from __future__ import annotations

import re

SPACE = r"[\s\pZ\x1c-\x1f\x85]"

# Views of the engine's tables, in order of use.
VIEWS = {
    "catalogue_wide": """
        SELECT doc_id AS row_idx, source AS artist, 'doc-' || doc_id AS title,
               CASE doc_id % 5 WHEN 0 THEN 'BOOKMARKED' WHEN 1 THEN 'YEEHAW' WHEN 2 THEN NULL
                    WHEN 3 THEN (60 + n_chars % 140)::VARCHAR || '.7' ELSE (60 + n_chars % 140)::VARCHAR END AS bpm,
               CASE WHEN lang = 'en' THEN text END AS en, CASE WHEN lang = 'fr' THEN text END AS fr,
               CASE WHEN lang = 'de' THEN text END AS de, CASE WHEN lang = 'es' THEN text END AS es
        FROM documents""",
    "catalogue": """
        SELECT row_idx, artist, title, bpm, 'en' AS section, en AS text FROM catalogue_wide WHERE en IS NOT NULL
        UNION ALL SELECT row_idx, artist, title, bpm, 'fr', fr FROM catalogue_wide WHERE fr IS NOT NULL
        UNION ALL SELECT row_idx, artist, title, bpm, 'de', de FROM catalogue_wide WHERE de IS NOT NULL
        UNION ALL SELECT row_idx, artist, title, bpm, 'es', es FROM catalogue_wide WHERE es IS NOT NULL""",
    "coerced": """
        SELECT row_idx, coalesce(trunc(try_cast(bpm AS DOUBLE))::BIGINT, 0) AS bpm FROM catalogue_wide""",
    "english": """
        SELECT c.row_idx, c.artist, c.title, n.bpm, c.section, c.text
        FROM catalogue c JOIN coerced n USING (row_idx) WHERE c.section = 'en'""",
    "bpms": """
        SELECT row_idx, artist AS Rappers, title AS Songs, bpm AS BPM FROM catalogue_wide
        UNION ALL SELECT row_idx + 1000000000000, artist, title, '1' FROM catalogue_wide""",
    "links": """
        SELECT event_id AS row_idx,
               CASE WHEN event_type = 'error' THEN 'Unfinished' ELSE 'https://x/' || event_type END AS Link,
               user_id::VARCHAR AS Artist
        FROM events""",
    "lyrics": """
        SELECT d.doc_id AS row_idx, d.source AS Artist,
               CASE l.quality WHEN 0 THEN 'Unfinished' WHEN 1 THEN d.text END AS Lyrics
        FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "scraped": """
        SELECT doc_id::VARCHAR AS artist, CASE WHEN quality = 0 THEN 'Unfinished' ELSE 'ok' END AS link FROM labels""",
    "remaining": """
        SELECT doc_id::VARCHAR AS artist FROM documents
        EXCEPT (SELECT artist FROM scraped EXCEPT SELECT artist FROM scraped WHERE link = 'Unfinished')""",
    "pairs": """
        SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer
        FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
        WHERE a.role = 'user' AND b.role = 'assistant'""",
    "examples": """
        SELECT '### Question: Write a ' || section || ' like ' || artist || chr(10) || ' ### Answer: ' || text AS text
        FROM catalogue""",
    "long_artists": "SELECT DISTINCT source AS artist FROM documents WHERE n_chars > 5000",
    "songs": "SELECT p_partkey AS song_id, p_brand AS artist, p_name AS title FROM part",
    "entries": """
        SELECT p_partkey AS id,
               CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE p_brand || ' ' || p_type END AS artist_name,
               CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' remix' WHEN 2 THEN p_type || ' ' || p_name
                    ELSE p_name || ' feat ' || p_brand END AS song_name,
               CASE WHEN p_size = 13 THEN 'n/a' ELSE (60 + p_size)::VARCHAR END AS bpm
        FROM part""",
    "song_words": """
        SELECT DISTINCT song_id, unnest(string_split(lower(artist || ' ' || title), ' ')) AS word FROM songs""",
    "entry_words": """
        SELECT DISTINCT id, unnest(string_split(lower(artist_name || ' ' || song_name), ' ')) AS word FROM entries""",
    "ranked": """
        SELECT song_id, id, count(*) AS shared,
               row_number() OVER (PARTITION BY song_id ORDER BY count(*) DESC, id) - 1 AS pos
        FROM song_words JOIN entry_words USING (word) GROUP BY song_id, id""",
    "hits": """
        SELECT song_id, pos, id, shared, artist_name, song_name, bpm FROM ranked JOIN entries USING (id) WHERE pos < 10""",
    "normal": """
        SELECT s.song_id, h.pos, h.id, h.bpm, lower(s.artist) AS qa, lower(replace(s.title, '’', '')) AS qt,
               trim(lower(h.artist_name)) AS ha, trim(replace(lower(h.song_name), '''', '')) AS ht,
               trim(lower(h.song_name)) AS ht_raw
        FROM songs s JOIN hits h USING (song_id)""",
    "asked": "SELECT song_id, lower(artist) AS qa, lower(replace(title, '’', '')) AS qt FROM songs",
    "offered": """
        SELECT id, bpm, trim(lower(artist_name)) AS ha, trim(replace(lower(song_name), '''', '')) AS ht,
               trim(lower(song_name)) AS ht_raw
        FROM entries""",
    "perfect": """
        SELECT song_id, min(id) AS pos, arg_min(bpm, id) AS bpm FROM asked JOIN offered ON qa = ha AND qt = ht GROUP BY song_id""",
    "near": """
        SELECT song_id, id AS pos, bpm, contains(ha, qa) OR contains(ht_raw, qa) AS artist_hit
        FROM asked JOIN offered ON contains(ht, qt) OR contains(ha, qa) OR contains(ht, qa)""",
    "firsts": """
        SELECT song_id, bpm, pos, artist_hit FROM near
        QUALIFY row_number() OVER (PARTITION BY song_id, bpm ORDER BY pos) = 1""",
    "reduced": """
        SELECT song_id, bpm, pos, artist_hit FROM
            (SELECT *, count(*) OVER (PARTITION BY song_id) AS n FROM firsts) WHERE n < 3 OR artist_hit""",
    "left_over": """
        SELECT song_id, count(*) AS n, arg_min(bpm, pos) AS first, min(try_cast(bpm AS BIGINT)) AS smallest,
               count(*) FILTER (try_cast(bpm AS BIGINT) IS NULL) AS bad,
               arg_min(bpm, pos) FILTER (try_cast(bpm AS BIGINT) IS NULL) AS bad_text
        FROM reduced GROUP BY song_id""",
    "judged": """
        SELECT s.song_id, p.bpm AS perfect, l.first, l.smallest, l.bad_text,
               CASE WHEN p.song_id IS NOT NULL AND try_cast(p.bpm AS BIGINT) IS NULL THEN 'INVALID_BPM'
                    WHEN p.song_id IS NOT NULL THEN 'PERFECT'
                    WHEN l.n <= 2 AND l.bad > 0 THEN 'INVALID_BPM'
                    WHEN l.n = 1 THEN 'NEAR1' WHEN l.n = 2 THEN 'NEAR2_MIN' ELSE 'BOOKMARKED' END AS match_status
        FROM songs s LEFT JOIN perfect p USING (song_id) LEFT JOIN left_over l ON l.song_id = s.song_id""",
    "decided": """
        SELECT song_id, CASE WHEN match_status = 'PERFECT' THEN try_cast(perfect AS BIGINT)
                             WHEN match_status IN ('NEAR1', 'NEAR2_MIN') THEN smallest END AS bpm,
               match_status,
               CASE WHEN perfect IS NOT NULL THEN perfect WHEN match_status = 'INVALID_BPM' THEN bad_text
                    WHEN match_status = 'NEAR1' THEN first
                    WHEN match_status = 'NEAR2_MIN' THEN smallest::VARCHAR END AS bpm_raw
        FROM judged""",
    "low": "SELECT doc_id, source, lower(text) AS t FROM documents",
    # Overlapping blocks, since substr counts characters from the beginning of its text.
    "blocks": """
        SELECT doc_id, b AS origin, substr(t, b::INT + 1, 640) AS t FROM low, unnest(range(0, length(t), 600)) u(b)""",
    "chars": "SELECT doc_id, unnest(regexp_extract_all(t, '(?s).')) AS ch FROM low",
    "vocab": "SELECT ch, row_number() OVER (ORDER BY ch) - 1 AS idx FROM (SELECT DISTINCT ch FROM chars)",
    "grams": """
        SELECT substr(t, i::INT + 1, 3) AS context, substr(t, i::INT + 4, 1) AS ch
        FROM blocks, unnest(range(0, least(length(t) - 3, 600))) u(i)""",
    "next_chars": """
        SELECT context, ch, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY context) AS p
        FROM grams GROUP BY context, ch""",
    "marked_pages": """
        SELECT page_id, CASE WHEN page_id % 10 = 0 THEN replace(html, '<b>', '') ELSE html END AS html FROM pages""",
    "plain_pages": """
        SELECT page_id, html, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS article FROM marked_pages""",
    "fields": r"""
        SELECT page_id, contains(article, '<b>') AS complete,
               regexp_replace(replace(regexp_replace(article, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g') AS lyrics,
               regexp_replace(replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&quot;', '"'), '&amp;?', '&', 'g') AS title,
               regexp_replace(replace(regexp_replace(regexp_extract(article, '(?s)<b>(.*?)(</b>|</?p>|$)', 1), '<[^>]*>', '', 'g'),
                                      '&quot;', '"'), '&amp;?', '&', 'g') AS features
        FROM plain_pages""",
    "anchors": """
        SELECT DISTINCT page_id, replace(unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)), '&amp;', '&') AS href
        FROM marked_pages""",
    "headers": """
        SELECT page_id, len(regexp_extract_all(html, '<li>')) + CASE WHEN page_id % 10 = 0 THEN 1 ELSE 0 END AS expected
        FROM pages""",
    "stamped_links": "SELECT *, row_number() OVER (PARTITION BY Link, Artist ORDER BY row_idx) AS rank FROM links",
    "first_open": "SELECT min(row_idx) AS first_open FROM lyrics WHERE Lyrics IS NULL",
}


def sql(body: str) -> str:
    """The body after the views it needs; a body may begin with further views after a comma."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in VIEWS:
            if name in words and name not in needed:
                needed.add(name)
                todo.append(VIEWS[name])
    parts = ", ".join(f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in VIEWS if name in needed)
    return f"WITH {parts} {body}" if parts else body


def uniform(*parts: str) -> str:
    digest = f"md5(concat_ws('|', {', '.join(parts)}))"
    return f"((('0x' || substr({digest}, 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)"


WINDOWS = """
    SELECT doc_id, origin + i AS start, substr(t, i::INT + 1, 40) AS sequence, substr(t, i::INT + 41, 1) AS next_char
    FROM blocks, unnest(range(0, length(t) - 40, 3)) u(i)"""

BODIES = {
    "src_csv": "SELECT conv_id, turn, question, answer FROM pairs",
    "src_csv_idx": "SELECT row_idx, Link, Artist FROM links",
    "src_lines": "SELECT title AS artist, count(*) AS n FROM songs GROUP BY title",
    "src_corpus": """
        SELECT source AS artist, sum(length(t) + 1)::BIGINT AS chars,
               ceil((sum(length(t) + 1) - 40) / 3)::BIGINT AS windows
        FROM low GROUP BY source""",
    "src_default": """
        SELECT artist AS Rappers, replace(title, ',', '') AS Songs, 'YEEHAW' AS BPM FROM songs""",
    "src_seed_nulls": """
        SELECT row_idx, NULL::VARCHAR AS "Song Title", NULL::VARCHAR AS Features, NULL::VARCHAR AS Producers,
               NULL::VARCHAR AS Lyrics, Link, Artist FROM links""",
    "src_bpm_init": "SELECT artist AS Rappers, title AS Songs, 'YEEHAW' AS BPM FROM songs",
    "snk_csv": "SELECT * FROM catalogue_wide",
    "snk_csv_idx": "SELECT row_idx, artist, section, text FROM catalogue",
    "snk_trainset": "SELECT text FROM examples",
    "prj_sections": "SELECT DISTINCT section FROM catalogue",
    "prj_unpivot": "SELECT * FROM catalogue",
    "flt_section": "SELECT row_idx, artist, title, bpm, text FROM english",
    "prj_select": """
        SELECT artist, title, n.bpm, fr FROM catalogue_wide c JOIN coerced n USING (row_idx) WHERE fr IS NOT NULL""",
    "flt_artists": "SELECT row_idx, artist, title, text FROM english WHERE artist IN ('src1', 'src7')",
    "flt_bpm_range": "SELECT row_idx, artist, title, bpm, text FROM english WHERE bpm >= 90 AND bpm <= 150",
    "flt_both": """
        SELECT row_idx, artist, title, bpm, text FROM english
        WHERE artist IN ('src1', 'src7') AND bpm <=
            (SELECT (min(bpm) + max(bpm)) // 2 FROM english WHERE artist IN ('src1', 'src7'))""",
    "flt_slice": """
        SELECT row_idx, artist, title, bpm, section, text FROM english
        WHERE artist IN ('src1', 'src3', 'src5', 'src7') AND bpm BETWEEN 0 AND 100""",
    "chk_slice": """
        , mine AS (SELECT * FROM english WHERE artist IN ('src1', 'nobody', 'src7', 'no one'))
        SELECT (SELECT count(*) FROM english) AS n,
               (SELECT string_agg(a, ',' ORDER BY a) FROM unnest(['src1', 'nobody', 'src7', 'no one']) u(a)
                WHERE a NOT IN (SELECT artist FROM english)) AS missing,
               min(bpm) AS min_bpm, max(bpm) AS max_bpm, 0 BETWEEN min(bpm) AND max(bpm) AS low_ok,
               1000000 BETWEEN min(bpm) AND max(bpm) AS high_ok
        FROM mine""",
    "flt_bpm_known": """
        SELECT row_idx, section, n.bpm FROM catalogue c JOIN coerced n USING (row_idx)
        WHERE c.bpm IS NULL OR (c.bpm <> 'BOOKMARKED' AND c.bpm <> '0')""",
    "flt_sentinel": "SELECT * FROM links WHERE Link = 'Unfinished'",
    "flt_drop_unfinished": "SELECT * FROM lyrics WHERE Lyrics IS NULL OR Lyrics <> 'Unfinished'",
    "flt_suffix": "SELECT row_idx, Artist FROM lyrics WHERE row_idx >= (SELECT first_open FROM first_open)",
    "chk_domain": "SELECT c_custkey::VARCHAR AS artist FROM customer EXCEPT SELECT user_id::VARCHAR FROM events",
    "cst_bpm": "SELECT * FROM coerced",
    "cst_str": """
        SELECT row_idx::VARCHAR AS row_idx, coalesce(artist, 'nan') AS artist, coalesce(title, 'nan') AS title, coalesce(bpm, 'nan') AS bpm,
               coalesce(en, 'nan') AS en, coalesce(fr, 'nan') AS fr, coalesce(de, 'nan') AS de, coalesce(es, 'nan') AS es
        FROM catalogue_wide""",
    "cst_int": """
        SELECT id, try_cast(bpm AS BIGINT) AS bpm,
               CASE WHEN try_cast(bpm AS BIGINT) IS NULL THEN 'INVALID_BPM' ELSE 'ok' END AS status FROM entries""",
    "join_position": """
        SELECT c.row_idx, c.c_custkey, c.c_name, s.s_suppkey, s.s_name
        FROM (SELECT *, row_number() OVER (ORDER BY c_name DESC, c_custkey) - 1 AS row_idx FROM customer) c
        LEFT JOIN (SELECT *, row_number() OVER (ORDER BY s_name DESC, s_suppkey) - 1 AS row_idx FROM supplier) s
        USING (row_idx)""",
    "join_keyed": """
        SELECT c.row_idx, c.artist, c.title, b.BPM AS bpm FROM catalogue_wide c LEFT JOIN
            (SELECT * FROM bpms QUALIFY row_number() OVER (PARTITION BY Rappers, Songs ORDER BY row_idx) = 1) b
        ON b.Rappers = c.artist AND b.Songs = replace(c.title, ',', '')""",
    "join_block": "SELECT * FROM hits",
    "join_candidates": "SELECT * FROM songs JOIN hits USING (song_id)",
    "join_anti_worklist": "SELECT artist FROM remaining",
    "join_semi_selected": """
        SELECT row_idx, artist, title FROM catalogue_wide WHERE artist IN (SELECT artist FROM long_artists)""",
    "join_song_count": """
        SELECT a.artist, count(e.row_idx) AS songs FROM long_artists a LEFT JOIN english e USING (artist) GROUP BY a.artist""",
    "join_vocab": "SELECT ch, n, idx FROM (SELECT ch, count(*) AS n FROM chars GROUP BY ch) JOIN vocab USING (ch)",
    "match_norm": "SELECT song_id, pos, qa, qt, ha, ht, ht_raw FROM normal",
    "match_perfect": "SELECT song_id, pos, bpm FROM perfect",
    "match_near": """
        SELECT 'title' AS kind, qt AS term, id, bpm FROM (SELECT DISTINCT qt FROM asked) JOIN offered ON contains(ht, qt)
        UNION ALL
        SELECT 'artist', qa, id, bpm FROM (SELECT DISTINCT qa FROM asked) JOIN offered ON contains(ht, qa) OR contains(ha, qa)""",
    "match_dedup_bpm": "SELECT song_id, bpm, pos, artist_hit FROM firsts",
    "match_reduce_artist": "SELECT song_id, bpm, pos, artist_hit FROM reduced",
    "match_decide": "SELECT * FROM decided",
    "match_nohit": """
        SELECT c_custkey AS song_id, c.bpm, c.match_status FROM (
            SELECT c_custkey, NULL::BIGINT AS bpm, 'BOOKMARKED' AS match_status FROM customer
            WHERE NOT EXISTS (SELECT 1 FROM offered WHERE contains(ha, lower(c_name)) OR contains(ht, lower(c_name))
                OR contains(ht, CASE WHEN c_nationkey < 12 THEN lower(c_mktsegment) ELSE 'blue steel' END))
        ) c""",
    "match_bpm": "SELECT * FROM decided",
    "agg_range": "SELECT min(bpm) AS min_bpm, max(bpm) AS max_bpm FROM english",
    "agg_counts": "SELECT artist, count(*) AS songs FROM english GROUP BY artist",
    "agg_selection_counts": """
        SELECT count(*) FILTER (Lyrics IS DISTINCT FROM 'Unfinished') AS kept, count(*) FILTER (Lyrics = 'Unfinished') AS dropped,
               count(DISTINCT Artist) FILTER (Lyrics IS DISTINCT FROM 'Unfinished') AS artists
        FROM lyrics""",
    "agg_distinct_artists": "SELECT DISTINCT artist FROM english",
    "agg_summary": """
        SELECT artist, min(bpm) AS min_bpm, max(bpm) AS max_bpm, count(*) AS songs, count(DISTINCT artist) AS artists
        FROM english GROUP BY ROLLUP (artist)""",
    "agg_progress": """
        SELECT artist, count(*) FILTER (bpm IS DISTINCT FROM 'YEEHAW') AS done, count(*) AS total,
               round(100.0::DOUBLE * (count(*) FILTER (bpm IS DISTINCT FROM 'YEEHAW')) / count(*), 3) AS percent,
               grouping(artist) = 1 AS overall
        FROM catalogue_wide GROUP BY ROLLUP (artist)""",
    "agg_first_open": "SELECT first_open FROM first_open",
    "ded_first": "SELECT row_idx, Link, Artist FROM stamped_links WHERE rank = 1",
    "ded_set": "SELECT DISTINCT Link FROM links",
    "srt_artist_title": "SELECT row_idx, artist, title, bpm FROM catalogue_wide ORDER BY artist, title, row_idx",
    "srt_distinct": "SELECT DISTINCT artist FROM catalogue_wide ORDER BY artist",
    "lim_first": "SELECT row_idx, Link, Artist FROM links ORDER BY Artist, row_idx LIMIT 1",
    "set_diff": "SELECT doc_id::VARCHAR AS artist FROM documents EXCEPT SELECT artist FROM scraped",
    "set_union_all": """
        SELECT row_idx, Link, Artist, NULL::VARCHAR AS Lyrics FROM links
        UNION ALL SELECT row_idx + (SELECT max(row_idx) + 1 FROM links), NULL, Artist, Lyrics FROM lyrics""",
    "ord_rowidx": """
        SELECT artist, title, row_idx AS doc_id, row_number() OVER (ORDER BY artist, title, row_idx) - 1 AS row_idx
        FROM catalogue_wide""",
    "str_lower": "SELECT doc_id, lower(text) AS text FROM documents",
    "str_strip": f"""
        SELECT doc_id, regexp_replace(regexp_replace(text, '^{SPACE}+', ''), '{SPACE}+$', '') AS text FROM documents""",
    "str_contains": "SELECT row_idx, contains(lower(text), section) AS found FROM catalogue",
    "str_replace": """
        SELECT doc_id, replace(replace(replace(text, ',', ''), '’', ''), '''', '') AS text FROM documents""",
    "str_concat": "SELECT song_id, artist || ' ' || title AS search FROM songs",
    "str_format": "SELECT song_id, 'Page ' || title || ' of ' || artist || '.' AS text FROM songs",
    "str_split_first": "SELECT page_id, expected FROM headers",
    "str_slice": "SELECT doc_id, substr(text, (length(text) // 2)::INT + 1, 40) AS piece FROM documents",
    "str_chars": """
        SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents)
        GROUP BY doc_id, ch""",
    "str_agg": """
        SELECT source AS artist, doc_id AS row_idx, t AS text,
               coalesce(sum(length(t)) OVER (PARTITION BY source ORDER BY doc_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset
        FROM low WHERE t <> ''""",
    "url_build": """
        SELECT p_partkey, 'https://example.org/artists/' || url_encode(p_brand || ' ' || p_name) AS url FROM part""",
    "math_log_exp": "SELECT context, ch, round(exp(ln(p) / 2), 9) AS w FROM next_chars",
    "math_round": """
        SELECT event_type, round(100.0::DOUBLE * count(*) / max(event_id), 3) AS percent FROM events GROUP BY event_type""",
    "math_min2": "SELECT event_id, least(event_id, user_id) AS smaller FROM events",
    "txt_prompt": "SELECT 'Write a ' || section || ' like ' || artist AS question, text AS answer FROM catalogue",
    "txt_sft_format": """
        SELECT '### Question: ' || question || chr(10) || ' ### Answer: ' || answer AS text FROM pairs""",
    "txt_token_cap": f"""
        SELECT CASE WHEN len(w) > 40 THEN array_to_string(w[1:40], ' ') ELSE text END AS text,
               len(w)::INT AS n_tokens, len(w) > 40 AS was_cut
        FROM (SELECT text, list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda x: x <> '') AS w FROM examples)""",
    "txt_windows": WINDOWS,
    "txt_windows_corpus": """
        , whole AS (SELECT source AS artist, string_agg(t, '' ORDER BY doc_id) AS t FROM low GROUP BY source),
        parts AS (SELECT artist, b, substr(t, b::INT + 1, 3040) AS t FROM whole, unnest(range(0, length(t), 3000)) u(b)),
        w AS (SELECT artist, b + i AS start, substr(t, i::INT + 1, 40) AS sequence, substr(t, i::INT + 41, 1) AS next_char
              FROM parts, unnest(range(0, length(t) - 40, 3)) u(i))
        SELECT artist, next_char, count(*) AS n, sum(start)::BIGINT AS starts,
               sum(unicode(substr(sequence, 1, 1)))::BIGINT AS points_0,
               sum(unicode(substr(sequence, 20, 1)))::BIGINT AS points_19,
               sum(unicode(substr(sequence, 40, 1)))::BIGINT AS points_39
        FROM w GROUP BY artist, next_char""",
    "txt_vocab": "SELECT ch FROM vocab",
    "txt_vocab_index": "SELECT ch, idx FROM vocab",
    "txt_encode": """
        , placed AS (SELECT doc_id, origin + i AS place, idx FROM blocks, unnest(range(0, least(length(t), 600))) u(i)
                     JOIN vocab ON vocab.ch = substr(t, i::INT + 1, 1)),
        seen AS (SELECT place, idx, lag(idx, 40) OVER w AS c0, lag(idx, 39) OVER w AS c1, lag(idx, 27) OVER w AS c13,
                        lag(idx, 14) OVER w AS c26, lag(idx, 1) OVER w AS c39
                 FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY place))
        SELECT idx::INT AS label, count(*) AS n, sum(place - 40)::BIGINT AS starts, sum(c0)::BIGINT AS codes_0,
               sum(c1)::BIGINT AS codes_1, sum(c13)::BIGINT AS codes_13, sum(c26)::BIGINT AS codes_26,
               sum(c39)::BIGINT AS codes_39
        FROM seen WHERE place >= 40 AND (place - 40) % 3 = 0 GROUP BY idx""",
    "txt_onehot": """
        , sizes AS (SELECT doc_id, length(t) AS size FROM low),
        placed AS (SELECT doc_id, origin + i AS spot, idx, size FROM blocks JOIN sizes USING (doc_id), unnest(range(0, least(length(t), 600))) u(i)
                   JOIN vocab ON vocab.ch = substr(t, i::INT + 1, 1))
        SELECT p::INT AS place, idx::INT AS code, count(*) AS n FROM placed, unnest(range(0, 41)) w(p)
        WHERE spot >= p AND (spot - p) % 3 = 0 AND spot - p + 40 < size GROUP BY p, idx""",
    "txt_nextchar_dist": "SELECT context, ch, n, round(p, 9) AS p FROM next_chars",
    "smp_temperature": """
        SELECT context, ch, round(p * p / sum(p * p) OVER (PARTITION BY context), 9) AS p FROM next_chars""",
    "smp_draw": f"""
        SELECT context, draw::INT AS draw, arg_max(ch, ln(p) - ln(-ln({uniform("7", "context", "draw", "ch")}))) AS ch
        FROM next_chars, unnest([1, 2]) u(draw) GROUP BY context, draw""",
    "smp_sweep": f"""
        SELECT context, temperature, 1 AS draw,
               arg_max(ch, ln(p) / temperature - ln(-ln({uniform("7", "context", "temperature", "1", "ch")}))) AS ch
        FROM next_chars, unnest([0.1, 0.25, 0.5, 0.75, 0.9, 1.0, 1.2, 1.5, 2.0]::DOUBLE[]) u(temperature)
        GROUP BY context, temperature""",
    "web_fields": f"""
        SELECT page_id, CASE WHEN complete THEN regexp_replace(lyrics, '^{SPACE}+|{SPACE}+$', '', 'g') ELSE 'Unscrapable' END AS lyrics,
               CASE WHEN complete THEN regexp_replace(title, '^{SPACE}+|{SPACE}+$', '', 'g') END AS title,
               CASE WHEN complete THEN regexp_replace(features, '^{SPACE}+|{SPACE}+$', '', 'g') END AS features
        FROM fields""",
    "web_unscrapable": """
        SELECT CASE WHEN complete THEN 'ok' ELSE 'Unscrapable' END AS status, count(*) AS n,
               count(*) FILTER (complete) AS titles, count(*) FILTER (complete) AS features
        FROM fields GROUP BY status""",
    "web_links": "SELECT page_id, href FROM anchors",
    "web_link_targets": r"""
        , targets AS (
            SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS origin, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
                   regexp_extract(url, '^[^#]*', 0) AS here, href
            FROM pages JOIN anchors USING (page_id)
        )
        SELECT DISTINCT page_id, CASE page_id % 5
            WHEN 0 THEN origin || href
            WHEN 1 THEN origin || regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]*/$', '') || href[2:]
            WHEN 2 THEN origin || path || '?p=2&to=' || href
            WHEN 3 THEN here || '#t'
            ELSE origin || regexp_replace(path, '[^/]*$', '') || href[2:] END AS href
        FROM targets""",
    "web_result_count": """
        SELECT page_id, expected, count(href) AS found, count(href) >= expected AS complete
        FROM headers LEFT JOIN anchors USING (page_id) GROUP BY page_id, expected""",
    "web_hits": r"""
        , items AS (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS names
                    FROM marked_pages),
        named AS (SELECT page_id, i AS pos, trim(regexp_replace(
                      regexp_replace(replace(names[i + 1], '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS name
                  FROM items, unnest(range(0, len(names))) u(i))
        SELECT page_id, pos, lower(name) AS artist_name, lower(name) AS song_name, name AS bpm FROM named""",
    "inc_worklist": "SELECT artist FROM remaining",
    "inc_stage": """
        , work AS (SELECT (SELECT count(*) FROM (
            SELECT c_custkey::VARCHAR FROM customer EXCEPT
            (SELECT Artist FROM links EXCEPT SELECT Artist FROM links WHERE Link = 'Unfinished'))) AS link_work, (SELECT count(*) FROM (
            SELECT source FROM documents EXCEPT
            (SELECT Artist FROM lyrics EXCEPT SELECT Artist FROM lyrics WHERE Lyrics = 'Unfinished'))) AS lyric_work)
        SELECT link_work, lyric_work, CASE WHEN link_work > 0 THEN 'links' WHEN lyric_work > 0 THEN 'lyrics' ELSE 'done' END AS stage
        FROM work""",
    "inc_resume_links": """
        SELECT row_idx, Link, Artist FROM (
            SELECT * FROM links WHERE Link <> 'Unfinished' UNION ALL
            SELECT o_orderkey + (SELECT max(row_idx) + 1 FROM links WHERE Link <> 'Unfinished'),
                   'https://x/' || lower(o_orderstatus), o_custkey::VARCHAR FROM orders)
        QUALIFY row_number() OVER (PARTITION BY Link, Artist ORDER BY row_idx) = 1""",
    "inc_resume_lyrics": """
        SELECT l.row_idx, l.Artist,
               CASE WHEN d.lang = 'en' AND l.row_idx >= (SELECT first_open FROM first_open) THEN 'new ' || d.text
                    ELSE l.Lyrics END AS Lyrics
        FROM lyrics l JOIN documents d ON d.doc_id = l.row_idx
        WHERE l.Lyrics IS NULL OR l.Lyrics <> 'Unfinished'""",
    "inc_first_lyrics": """
        SELECT l.row_idx, l.Artist, l.Link, NULL::VARCHAR AS Features, NULL::VARCHAR AS "Song Title", d.text AS Lyrics
        FROM links l LEFT JOIN documents d ON d.doc_id = l.row_idx
        WHERE l.Link IS NULL OR l.Link <> 'Unfinished'""",
    "inc_fail_mark": """
        SELECT row_idx, Link, Artist FROM links UNION ALL
        SELECT doc_id + (SELECT max(row_idx) + 1 FROM links), 'Unfinished', doc_id::VARCHAR FROM labels WHERE toxic = 1""",
    "inc_skip_done": "SELECT row_idx, Rappers, Songs FROM bpms WHERE BPM = 'YEEHAW'",
    "inc_checkpoint": "SELECT row_idx, Link, Artist FROM stamped_links WHERE rank = 1 AND Link <> 'Unfinished'",
    "inc_dedup_stream": "SELECT DISTINCT Link, Artist FROM links",
    "merge_catalogue": """
        SELECT row_number() OVER (ORDER BY c.artist NULLS LAST, c.title NULLS LAST, c.row_idx) - 1 AS place, c.row_idx, c.artist, c.title,
               b.BPM AS bpm, c.en, c.fr, c.de, c.es
        FROM catalogue_wide c LEFT JOIN
            (SELECT * FROM bpms QUALIFY row_number() OVER (PARTITION BY Rappers, Songs ORDER BY row_idx) = 1) b
        ON b.Rappers = c.artist AND b.Songs = replace(c.title, ',', '')""",
    "training_text": """
        SELECT '### Question: Write a en like ' || artist || chr(10) || ' ### Answer: ' || text AS text
        FROM english WHERE artist IN ('src1', 'src7') AND bpm BETWEEN 0 AND 150""",
}

ORACLE_SQL = {name: sql(body) for name, body in BODIES.items()}

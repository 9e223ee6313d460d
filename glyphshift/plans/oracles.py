"""DuckDB SQL for the registered queries, composed of named parts."""

from __future__ import annotations

# Literals of its own, so that a wrong one in the library shows: the two layouts in keyboard order, what models and lexicons
# count as letters, white space, and the grid.
EN_ROW, HE_ROW = "qwertyuiopasdfghjklzxcvbnm,./;'", "/'קראטוןםפשדגכעיחלךזסבהנמצתץ.ף,"
LETTERS, SIGNS = "abcdefghijklmnopqrstuvwxyz", "`~!@#$%^&*()-_=+[{]}\\|;:'\",<.>/?"
HE_LETTERS = "אבגדהוזחטיךכלםמןנסעףפץצקרשת"
EN_FROM, EN_TO = EN_ROW + LETTERS.upper(), HE_ROW + "שנבגקכעיןחלךצמםפ/רדאוה'סטז"
HE_FROM, HE_TO = HE_ROW, "QWERTYUIOPASDFGHJKLZXCVBNM,./;'"
STRICT_FROM, STRICT_TO = "קראטוןםפשדגכעיחלךזסבהנמצ", "ertyuiopasdfghjklzxcvbnm"
EN_ALLOWED, HE_ALLOWED = LETTERS + " " + SIGNS, HE_LETTERS + " " + SIGNS
BASELINES, ALPHAS, POWERS = [2, 2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6], [0.1, 0.3, 0.5, 0.7, 0.9, 1.1, 1.3, 1.5, 1.7], [1, 1.5, 2, 2.5, 3, 3.5, 4, 4.5]
WS = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def split(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda x: x <> '')"


def to_he(c: str) -> str:
    return f"translate({c}, {lit(EN_FROM)}, {lit(EN_TO)})"


def to_en(c: str) -> str:
    return f"translate({c}, {lit(HE_FROM)}, {lit(HE_TO)})"


def clean_markup(c: str) -> str:
    for tag in ("pre", "blockquote", "code"):
        c = f"regexp_replace({c}, '(?is)<{tag}\\b.*?</{tag}\\s*>', '', 'g')"
    return strip(f"regexp_replace({c}, '(?s)<[^>]*>', '', 'g')")


def unescape(c: str) -> str:
    """The references that the pages hold, and all numeric ones."""
    named = " ".join(f"WHEN regexp_matches(x, '^{name}{end}') THEN {lit(char)} || regexp_replace(x, '^{name};?', '')" for name, char, end in (("amp", "&", ""), ("lt", "<", ""), ("gt", ">", ""), ("quot", '"', ""), ("copy", "\u00a9", ""), ("middot", "\u00b7", ""), ("nbsp", "\u00a0", ""), ("apos", "'", ";")))
    return f"""array_to_string(list_transform(string_split({c}, '&'), lambda x, i: CASE WHEN i = 1 THEN x
      WHEN regexp_matches(x, '^#[0-9]+') THEN chr(CAST(regexp_extract(x, '^#([0-9]+)', 1) AS INTEGER)) || regexp_replace(x, '^#[0-9]+;?', '')
      WHEN regexp_matches(x, '^#[xX][0-9a-fA-F]+') THEN chr(CAST('0x' || regexp_extract(x, '^#[xX]([0-9a-fA-F]+)', 1) AS INTEGER)) || regexp_replace(x, '^#[xX][0-9a-fA-F]+;?', '')
      {named} ELSE '&' || x END), '')"""


# Literals of its own: what links, emphasis, addresses and handles look like.
LINK, EMPHASIS = r"\[([^\]]+)\]\([^)]+\)", r"\*\*|__|[*_]"
URL, HANDLE = r'https?://[^\s<>"]+|www\.[^\s<>"]+', r"@[\p{L}\p{N}_-]+"


def scrub(c: str) -> str:
    c = f"regexp_replace({c}, {lit(LINK)}, '\\1', 'g')"
    for pattern in (EMPHASIS, URL, HANDLE):
        c = f"regexp_replace({c}, {lit(pattern)}, '', 'g')"
    return strip(f"regexp_replace({c}, '{WS}+', ' ', 'g')")


HEBREW, ENGLISH, NIKUD = "'[\\x{0590}-\\x{05FF}]'", "'[A-Za-z]'", "'[\\x{0591}-\\x{05C7}]'"
STRICT = f"CASE WHEN translate(word, {lit(STRICT_FROM)}, '') = '' THEN translate(word, {lit(STRICT_FROM)}, {lit(STRICT_TO)}) ELSE '' END"
PURE = f"CASE WHEN model = 'he' THEN translate(word, {lit(HE_ALLOWED)}, '') = '' ELSE translate(word, {lit(EN_ALLOWED)}, '') = '' END"

#: Parts: name, what it needs, its SQL.
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": ((), f"SELECT doc_id, lang, source, line_no, {strip('part')} AS line FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS part, unnest(range(0, len(string_split(text, chr(10)))))::INTEGER AS line_no FROM documents) WHERE {strip('part')} <> ''"),
    "he_lines": (("lines",), f"SELECT * FROM (SELECT doc_id, 'he' AS lang, source, line_no, array_to_string(list_transform(list_filter({split('lower(line)')}, lambda w: regexp_full_match(w, '[a-z]+')), lambda w: {to_he('w')}), ' ') AS line FROM lines WHERE lang = 'de') WHERE line <> ''"),
    "so_lines": ((), f"SELECT * FROM (SELECT {strip('part')} AS line FROM (SELECT unnest(string_split(text, chr(10))) AS part FROM conversations WHERE role IN ('user', 'assistant'))) WHERE line <> ''"),
    "training": (("lines", "he_lines", "so_lines"), "SELECT 'en' AS model, line FROM lines WHERE lang = 'en' UNION ALL SELECT 'he', line FROM he_lines UNION ALL SELECT 'so', line FROM so_lines"),
    "wc": (("training",), f"SELECT model, word, count(*) AS cnt FROM (SELECT model, unnest({split('norm')}) AS word FROM (SELECT model, regexp_replace({strip('lower(line)')}, '[\\x{{200E}}\\x{{200F}}]', '', 'g') AS norm FROM training)) WHERE ({PURE}) AND NOT regexp_matches(word, {NIKUD}) AND length(word) <= {12} GROUP BY model, word"),
    "wordgrams": (("wc",), "SELECT model, word, cnt, n::INTEGER AS n, substr(' ' || word || ' ', i::INTEGER, n::INTEGER) AS gram FROM wc, unnest([2, 3, 4]) AS a(n), unnest(range(1, length(word) + 4 - n)) AS b(i)"),
    "ngrams": (("wordgrams",), "SELECT model, n, gram, sum(cnt)::BIGINT AS cnt FROM wordgrams GROUP BY model, n, gram"),
    "chars": (("wc",), "SELECT DISTINCT model, unnest(string_split(word, '')) AS ch FROM wc"),
    "vocab": (("chars",), "SELECT model, count(*) + 1 AS vocab_size FROM chars WHERE ch <> '' AND ch <> ' ' GROUP BY model"),
    "totals": (("ngrams",), "SELECT model, sum(cnt)::BIGINT AS total_bigrams FROM ngrams WHERE n = 2 GROUP BY model"),
    "firsts": (("ngrams",), "SELECT model, substr(gram, 1, 1) AS ch, sum(cnt)::BIGINT AS total FROM ngrams WHERE n = 2 GROUP BY 1, 2"),
    "meta": (("vocab", "totals"), "SELECT model, vocab_size AS v, total_bigrams AS t FROM vocab JOIN totals USING (model)"),
    "en_words": (("lines",), f"SELECT unnest({split('line')}) AS word FROM lines WHERE lang = 'en'"),
    "he_words": (("he_lines",), f"SELECT unnest({split('line')}) AS word FROM he_lines"),
    "lex_en": (("en_words",), "SELECT word, freq FROM (SELECT lower(word) AS word, count(*) AS freq FROM en_words GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10000) WHERE regexp_full_match(word, '[a-z]{2,6}')"),
    "lex_he": (("he_words",), f"SELECT DISTINCT {strip('word')} AS word FROM he_words WHERE regexp_full_match({strip('word')}, '[\\x{{05D0}}-\\x{{05EA}}]{{2,6}}')"),
    "pairs_c": (("lex_en", "lex_he"), f"SELECT he_word, en_word FROM (SELECT word AS he_word, {STRICT} AS en_word FROM lex_he) JOIN (SELECT DISTINCT word AS en_word FROM lex_en) USING (en_word) WHERE en_word <> ''"),
    "collisions": (("pairs_c",), "SELECT he_word AS word FROM pairs_c UNION SELECT en_word FROM pairs_c"),
    "alines": (("lines",), "SELECT * FROM lines WHERE lang IN ('en', 'es', 'fr')"),
    "placed": (("alines",), f"SELECT doc_id, lang, line_no, unnest(ws) AS word, unnest(range(0, len(ws)))::INTEGER AS w FROM (SELECT doc_id, lang, line_no, {split('line')} AS ws FROM alines)"),
    "awords": (("placed",), "SELECT DISTINCT word FROM placed"),
    "apairs": (("awords",), f"SELECT word AS en, {to_he('word')} AS he FROM awords"),
}
for name, pairs, english in (("", "apairs", ("en",)), ("m", "mpairs", ("en",)), ("t", "apairs", ("en", "so"))):
    PARTS[f"{name}evals"] = (
        (pairs, "ngrams", "meta", "collisions"),
        f"""SELECT en, he, list(struct_pack(j := j, d := d, coll := coll) ORDER BY j) AS evals FROM (SELECT en, he, j, max(coll) AS coll, round(min(d), 9) AS d FROM (
    SELECT en, he, j, (bh + sum(sh) OVER o) - (be + sum(se) OVER o) AS d,
           substr(le, 1, least(j + 2, length(le))) IN (SELECT word FROM collisions) OR substr(lh, 1, least(j + 2, length(le))) IN (SELECT word FROM collisions) AS coll
    FROM (SELECT me.model, p.en, p.he, p.j, le, lh, ln((coalesce(e4.cnt, 0) + 1) / (coalesce(e3.cnt, 0) + me.v)) AS se, ln((coalesce(h4.cnt, 0) + 1) / (coalesce(h3.cnt, 0) + mh.v)) AS sh,
                 ln((coalesce(e2.cnt, 0) + 1) / (me.t + me.v * me.v)) AS be, ln((coalesce(h2.cnt, 0) + 1) / (mh.t + mh.v * mh.v)) AS bh
          FROM (SELECT en, he, lower(en) AS le, lower(he) AS lh, j::INTEGER AS j FROM (SELECT DISTINCT en, he FROM {pairs} WHERE length(en) >= 2), unnest(range(1, length(en))) AS u(j)) p
          JOIN meta me ON me.model IN ({", ".join(map(lit, english))}) JOIN meta mh ON mh.model = 'he'
          LEFT JOIN ngrams e4 ON e4.model = me.model AND e4.n = 4 AND e4.gram = substr(' ' || le || ' ', j, 4)
          LEFT JOIN ngrams e3 ON e3.model = me.model AND e3.n = 3 AND e3.gram = substr(' ' || le || ' ', j, 3)
          LEFT JOIN ngrams e2 ON e2.model = me.model AND e2.n = 2 AND e2.gram = ' ' || substr(le, 1, 1)
          LEFT JOIN ngrams h4 ON h4.model = 'he' AND h4.n = 4 AND h4.gram = substr(' ' || lh || ' ', j, 4)
          LEFT JOIN ngrams h3 ON h3.model = 'he' AND h3.n = 3 AND h3.gram = substr(' ' || lh || ' ', j, 3)
          LEFT JOIN ngrams h2 ON h2.model = 'he' AND h2.n = 2 AND h2.gram = ' ' || substr(lh, 1, 1))
    WINDOW o AS (PARTITION BY model, en, he ORDER BY j)) GROUP BY en, he, j) GROUP BY en, he""",
    )
PARTS["items"] = (("placed", "evals"), f"SELECT p.*, length(word)::INTEGER AS size, coalesce(e.evals, []) AS evals FROM placed p LEFT JOIN evals e ON e.en = p.word AND e.he = {to_he('p.word')}")
HIT = "list_filter(evals, lambda e: NOT e.coll AND (CASE WHEN correct THEN 1 ELSE -1 END) * e.d > 4.0 + 0.5 * pow(k, 2))[1]"
for name, start in (("fp", "true"), ("fn", "false")):
    PARTS[f"state_{name}"] = (
        ("items",),
        f"""SELECT doc_id, line_no, 0 AS w, {start} AS correct, 0 AS k, 0 AS tail FROM (SELECT DISTINCT doc_id, line_no FROM items)
    UNION ALL SELECT doc_id, line_no, w + 1, CASE WHEN hit IS NULL THEN correct ELSE NOT correct END, CASE WHEN hit IS NULL THEN k + 1 ELSE 0 END,
        CASE WHEN hit IS NULL AND (size < 2 OR evals[-1].coll OR (CASE WHEN correct THEN 1 ELSE -1 END) * evals[-1].d > 0) THEN least(tail + 1, 50) ELSE 0 END
    FROM (SELECT s.*, i.size, i.evals, {HIT} AS hit FROM state_{name} s JOIN items i USING (doc_id, line_no, w))""",
    )
    PARTS[f"ev_{name}"] = (
        (f"state_{name}",),
        f"SELECT doc_id, lang, line_no, w, word, size, correct, k, tail, abs(hit.d) AS diff, hit IS NOT NULL AS switched, CASE WHEN hit.j = size - 1 THEN -1 ELSE hit.j + 1 END AS idx FROM (SELECT s.*, i.lang, i.word, i.size, {HIT} AS hit FROM state_{name} s JOIN items i USING (doc_id, line_no, w))",
    )
PARTS["titems"] = (("placed", "tevals"), PARTS["items"][1].replace("evals e ON", "tevals e ON"))
PARTS["state_tech"] = (("titems",), PARTS["state_fp"][1].replace("state_fp", "state_tech").replace("items", "titems"))
PARTS["ev_tech"] = (("state_tech",), PARTS["ev_fp"][1].replace("state_fp", "state_tech").replace("items", "titems"))
PARTS["fp"] = (("ev_fp",), "SELECT doc_id, lang, line_no, count(*) AS n_words, count(*) FILTER (switched AND correct) AS fp_count, count(*) FILTER (switched AND NOT correct) AS recovery_count FROM ev_fp GROUP BY ALL")
PARTS["fp_report"] = (("fp",), "SELECT lang, count(*) AS lines_tested, sum(n_words)::BIGINT AS words_tested, sum(fp_count)::BIGINT AS fp_count, sum(recovery_count)::BIGINT AS recovery_count, count(*) FILTER (fp_count > 0) AS lines_with_fp FROM fp GROUP BY lang")
PARTS["tech"] = (("ev_tech",), PARTS["fp"][1].replace("ev_fp", "ev_tech"))
PARTS["tech_report"] = (("tech",), PARTS["fp_report"][1].replace("FROM fp", "FROM tech"))
PARTS["fn"] = (
    ("ev_fn",),
    """SELECT doc_id, lang, line_no, n_words, line_switched, CASE WHEN line_switched THEN late ELSE every END AS latency, CASE WHEN line_switched THEN missed ELSE n_words END AS words_not_switched
    FROM (SELECT doc_id, lang, line_no, count(*) AS n_words, bool_or(switched AND NOT correct) AS line_switched, sum(size + 1)::BIGINT AS every,
          sum(CASE WHEN correct THEN 0 WHEN NOT switched OR idx = -1 THEN size + 1 ELSE idx + 1 END)::BIGINT AS late,
          sum(CASE WHEN switched AND NOT correct THEN greatest(w - tail, 0) ELSE 0 END)::BIGINT AS missed FROM ev_fn GROUP BY doc_id, lang, line_no)""",
)
PARTS["swaps"] = (
    ("ev_fn",),
    """SELECT e.doc_id, e.lang, e.line_no, e.w, e.word, (CASE WHEN e.switched THEN e.correct ELSE NOT e.correct END) <> (count(s.w) % 2 = 1) AS swap
    FROM ev_fn e LEFT JOIN (SELECT * FROM ev_fn WHERE switched AND tail > 0) s ON s.doc_id = e.doc_id AND s.line_no = e.line_no AND s.w > e.w AND s.w - s.tail <= e.w GROUP BY e.doc_id, e.lang, e.line_no, e.w, e.word, e.switched, e.correct""",
)
# A click before each line resets k and tail, so a session goes on from line to line by its layout alone.
PARTS["either"] = (("ev_fp", "ev_fn"), "SELECT true AS began, * FROM ev_fp UNION ALL SELECT false, * FROM ev_fn")
PARTS["line_ends"] = (
    ("either",),
    """SELECT *, row_number() OVER (PARTITION BY doc_id, began ORDER BY line_no) AS r, coalesce(sum(n) OVER (PARTITION BY doc_id, began ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM (SELECT doc_id, line_no, began, count(*) AS n, arg_max(correct <> switched, w) AS ended FROM either GROUP BY doc_id, line_no, began)""",
)
PARTS["sessions"] = (("line_ends",), "SELECT doc_id, 1::BIGINT AS r, true AS began FROM line_ends WHERE r = 1 AND began UNION ALL SELECT s.doc_id, s.r + 1, l.ended FROM sessions s JOIN line_ends l USING (doc_id, r, began)")
PARTS["fn_report"] = (("fn",), "SELECT lang, count(*) AS lines_tested, sum(n_words)::BIGINT AS words_tested, count(*) FILTER (line_switched) AS lines_switched, sum(words_not_switched)::BIGINT AS words_not_switched, sum(latency)::BIGINT AS total_latency_chars FROM fn GROUP BY lang")
for part in ("state", "ev"):
    PARTS[f"{part}_tfn"] = (("titems",) if part == "state" else ("state_tfn",), PARTS[f"{part}_fn"][1].replace("state_fn", "state_tfn").replace("items", "titems"))
PARTS["tfn"] = (("ev_tfn",), PARTS["fn"][1].replace("ev_fn", "ev_tfn"))
PARTS["tfn_report"] = (("tfn",), PARTS["fn_report"][1].replace("FROM fn", "FROM tfn"))
PARTS["dumped"] = ((), """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'), '\'\'', '&#x27;') ELSE html END AS html FROM pages""")
PARTS["voiced"] = (("lines", "he_lines"), "SELECT * FROM lines UNION ALL SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN line || chr(1456) ELSE line END AS line) FROM he_lines")
PARTS["comments"] = (
    (),
    f"""SELECT id, channel, CASE WHEN id % 17 = 0 THEN '[deleted]' WHEN id % 19 = 0 THEN '[removed]' WHEN id % 23 = 0 THEN '' WHEN id % 3 = 0 THEN text || ' ' || {to_he('lower(text)')} ELSE text END AS body
    FROM (SELECT conv_id * 1000 + turn AS id, text, role AS channel FROM conversations)""",
)
PARTS["mixed_c"] = (("comments",), f"SELECT id, channel, {strip('replace(body, chr(10), chr(32))')} AS text FROM comments WHERE coalesce(body, '') NOT IN ('', '[deleted]', '[removed]') AND regexp_matches(body, {HEBREW}) AND regexp_matches(body, {ENGLISH}) AND length(body) > 20")
PARTS["mtexts"] = (
    ("lines", "he_lines"),
    """SELECT i AS sample_id, a.line || ' ' || b.line AS text
    FROM (SELECT (SELECT count(*) FROM lines WHERE lang = 'en') AS ne, (SELECT count(*) FROM he_lines) AS nh), unnest(range(0, greatest(ne, nh))) AS u(i)
    JOIN (SELECT line, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS r FROM lines WHERE lang = 'en') a ON a.r = i % ne
    JOIN (SELECT line, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS r FROM he_lines) b ON b.r = i % nh""",
)
PARTS["runs"] = (
    ("mtexts",),
    f"""SELECT sample_id, run, lang, min(i)::INTEGER AS start, string_agg(c, '' ORDER BY i) AS chunk FROM (
    SELECT *, sum(CASE WHEN lang IS DISTINCT FROM before AND before IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id ORDER BY i)::INTEGER AS run FROM (
    SELECT *, lag(lang) OVER (PARTITION BY sample_id ORDER BY i) AS before FROM (
    SELECT sample_id, i, c, last_value(own IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY i) AS lang FROM (
    SELECT sample_id, i, c, CASE WHEN i = 0 THEN 'en' WHEN regexp_matches(c, {HEBREW}) THEN 'he' WHEN regexp_matches(c, {ENGLISH}) THEN 'en' END AS own
    FROM (SELECT sample_id, unnest(string_split(text, '')) AS c, unnest(range(0, length(text))) AS i FROM mtexts))))) GROUP BY sample_id, run, lang""",
)
PARTS["places"] = (("runs",), "SELECT sample_id, arg_max(start, run) AS trap_start, max(run) AS last, sum(length(chunk))::BIGINT AS total FROM runs GROUP BY sample_id HAVING max(run) > 0")
PARTS["forms"] = (("runs", "places"), f"SELECT r.*, last, CASE WHEN lang = 'en' THEN chunk ELSE {to_en('chunk')} END AS en, CASE WHEN lang = 'en' THEN {to_he('chunk')} ELSE chunk END AS he FROM runs r JOIN places USING (sample_id)")
PARTS["segs"] = (
    ("forms",),
    """SELECT false AS trap, sample_id, run AS seg, lang AS layout, start, en, he FROM forms
    UNION ALL SELECT true, sample_id, least(run, last - 1), arg_min(lang, run), min(start), string_agg(en, '' ORDER BY run), string_agg(he, '' ORDER BY run) FROM forms GROUP BY sample_id, least(run, last - 1)""",
)
PARTS["swords"] = (
    ("segs",),
    """SELECT *, (count(*) FILTER (en <> '') OVER o - CASE WHEN en <> '' THEN 1 ELSE 0 END) AS k, start + (sum(length(en) + 1) OVER o - length(en) - 1) AS place, i < n - 1 AS ended FROM (
    SELECT trap, sample_id, seg, layout, start, len(ens) AS n, unnest(ens) AS en, unnest(hes) AS he, unnest(range(0, len(ens))) AS i FROM (
    SELECT *, regexp_split_to_array(en, '[ \\n\\t]') AS ens, regexp_split_to_array(he, '[ \\n\\t]') AS hes FROM segs)) WINDOW o AS (PARTITION BY trap, sample_id, seg ORDER BY i)""",
)
PARTS["mpairs"] = (("swords",), "SELECT DISTINCT en, he FROM swords WHERE en <> ''")
PARTS["cand"] = (
    ("swords", "mevals"),
    """SELECT trap, sample_id, k, place + CASE WHEN e.j = size - 1 THEN size + 1 ELSE e.j + 2 END AS pos, CASE WHEN layout = 'en' THEN e.d ELSE -e.d END AS d
    FROM (SELECT s.*, length(s.en) AS size, unnest(evals) AS e FROM swords s JOIN mevals USING (en, he) WHERE s.en <> '') WHERE NOT e.coll AND (e.j < size - 1 OR ended)""",
)
PARTS["grid"] = ((), f"SELECT d0, a, p FROM unnest({BASELINES}::DOUBLE[]) AS x(d0), unnest({ALPHAS}::DOUBLE[]) AS y(a), unnest({POWERS}::DOUBLE[]) AS z(p)")
PARTS["one"] = ((), "SELECT 4.0::DOUBLE AS d0, 0.5::DOUBLE AS a, 2.0::DOUBLE AS p")
for table in ("grid", "one"):
    PARTS[f"hits_{table}"] = (("cand", table), f"SELECT trap, d0, a, p, sample_id, min(pos) AS pos FROM cand JOIN {table} ON d > d0 + a * pow(k, p) GROUP BY trap, d0, a, p, sample_id")
    PARTS[f"metrics_{table}"] = (
        (f"hits_{table}", "places"),
        f"""SELECT d0, a, p, round(fps / n, 6) AS fpr, round(tps / n, 6) AS recall, round(coalesce(chars / nullif(tps, 0), 0), 6) AS lat FROM (
    SELECT g.d0, g.a, g.p, (SELECT count(*) FROM places) AS n, count(*) FILTER (h.sample_id IS NOT NULL AND NOT trap) AS fps, count(*) FILTER (trap AND pos > trap_start) AS tps,
           coalesce(sum(pos - trap_start) FILTER (trap AND pos > trap_start), 0) AS chars
    FROM {table} g LEFT JOIN hits_{table} h ON g.d0 = h.d0 AND g.a = h.a AND g.p = h.p LEFT JOIN places l USING (sample_id) GROUP BY g.d0, g.a, g.p)""",
    )
SCORE = """SELECT text, round(CASE WHEN size < 2 THEN 0 WHEN size = 2 THEN ln((coalesce(c2.cnt, 0) + 1) / (coalesce(f.total, 0) + m.v)) WHEN size = 3 THEN ln((coalesce(c3.cnt, 0) + 1) / (coalesce(c2.cnt, 0) + m.v))
    ELSE ln((coalesce(c2.cnt, 0) + 1) / (m.t + m.v * m.v)) + tail END, 6) AS score
    FROM (SELECT text, low, length(low) AS size FROM (SELECT word AS text, lower(word) AS low FROM awords)) x
    JOIN meta m ON m.model = '{m}' LEFT JOIN ngrams c2 ON c2.model = '{m}' AND c2.n = 2 AND c2.gram = substr(low, 1, 2) LEFT JOIN ngrams c3 ON c3.model = '{m}' AND c3.n = 3 AND c3.gram = substr(low, 1, 3)
    LEFT JOIN firsts f ON f.model = '{m}' AND f.ch = substr(low, 1, 1)
    LEFT JOIN (SELECT word, sum(ln((coalesce(g4.cnt, 0) + 1) / (coalesce(g3.cnt, 0) + m.v))) AS tail FROM awords, unnest(range(1, length(word) - 2)) AS u(j) JOIN meta m ON m.model = '{m}'
      LEFT JOIN ngrams g4 ON g4.model = '{m}' AND g4.n = 4 AND g4.gram = substr(lower(word), j::INTEGER, 4) LEFT JOIN ngrams g3 ON g3.model = '{m}' AND g3.n = 3 AND g3.gram = substr(lower(word), j::INTEGER, 3) GROUP BY word) t ON t.word = x.text"""
for m in ("en", "so"):
    PARTS[f"score_{m}"] = (("awords", "ngrams", "meta", "firsts"), SCORE.replace("{m}", m))
PARTS["trace"] = (
    ("awords", "ngrams", "meta"),
    """SELECT text, j, gram, c4, c3, step, sum(step) OVER (PARTITION BY text ORDER BY j) AS total FROM (
    SELECT text, 0 AS j, substr(lower(text), 1, 2) AS gram, coalesce(g.cnt, 0) AS c4, 0 AS c3, ln((coalesce(g.cnt, 0) + 1) / (m.t + m.v * m.v)) AS step
    FROM (SELECT ' ' || word || ' ' AS text FROM awords) JOIN meta m ON m.model = 'en' LEFT JOIN ngrams g ON g.model = 'en' AND g.n = 2 AND g.gram = substr(lower(text), 1, 2)
    UNION ALL SELECT text, j::INTEGER, substr(lower(text), j::INTEGER, 4), coalesce(g4.cnt, 0), coalesce(g3.cnt, 0), ln((coalesce(g4.cnt, 0) + 1) / (coalesce(g3.cnt, 0) + m.v))
    FROM (SELECT ' ' || word || ' ' AS text FROM awords) x, unnest(range(1, length(text) - 2)) AS u(j) JOIN meta m ON m.model = 'en'
    LEFT JOIN ngrams g4 ON g4.model = 'en' AND g4.n = 4 AND g4.gram = substr(lower(text), j::INTEGER, 4) LEFT JOIN ngrams g3 ON g3.model = 'en' AND g3.n = 3 AND g3.gram = substr(lower(text), j::INTEGER, 3))""",
)
PARTS["buffers"] = (("awords",), f"SELECT word, 'en' AS layout, word AS active, {to_he('word')} AS shadow FROM awords UNION ALL SELECT word, 'he', {to_he('word')}, word FROM awords")
PARTS["pairs"] = (("buffers",), "SELECT active, shadow, layout, length(active) % 2 = 0 AS on_delimiter FROM buffers")
PARTS["ptexts"] = (
    ("pairs",),
    """SELECT *, ' ' || lower(CASE WHEN layout = 'en' THEN active ELSE shadow END) || CASE WHEN on_delimiter THEN ' ' ELSE '' END AS en_text,
    ' ' || lower(CASE WHEN layout = 'en' THEN shadow ELSE active END) || CASE WHEN on_delimiter THEN ' ' ELSE '' END AS he_text FROM pairs""",
)
for m in ("en", "he"):
    PARTS[f"ps_{m}"] = (
        ("ptexts", "ngrams", "meta", "firsts"),
        SCORE.replace("{m}", m).replace("awords", f"(SELECT DISTINCT {m}_text AS word FROM ptexts)").replace(", 6) AS score", ", 12) AS score"),
    )
PARTS["decided"] = (
    ("ptexts", "ps_en", "ps_he", "collisions"),
    """SELECT active, shadow, layout, on_delimiter, diff AS score_diff, coll AS is_colliding, short OR (NOT coll AND diff <= 4.0 AND diff > 0) AS is_ambiguous, NOT short AND NOT coll AND diff > 4.0 AS should_switch FROM (
    SELECT *, length(active) < 2 AS short, CASE WHEN length(active) < 2 THEN 0 WHEN layout = 'en' THEN h.score - e.score ELSE e.score - h.score END AS diff,
           length(active) >= 2 AND (lower(active) IN (SELECT word FROM collisions) OR lower(shadow) IN (SELECT word FROM collisions)) AS coll
    FROM ptexts p JOIN ps_en e ON e.text = en_text JOIN ps_he h ON h.text = he_text)""",
)
for m, form in (("en", "lower(word)"), ("he", to_he("word"))):
    PARTS[f"d7_{m}"] = (
        ("awords", "ngrams", "meta", "firsts"),
        "SELECT *, round(raw, 6) AS score FROM (" + SCORE.replace("{m}", m).replace("awords", f"(SELECT DISTINCT ' ' || {form} || ' ' AS word FROM awords)").replace(", 6) AS score", ", 15) AS raw") + ")",
    )
PARTS["doc_mode"] = (
    (),
    """SELECT DISTINCT doc_id, CASE WHEN mode IN ('technical', 'standard') THEN mode WHEN technical THEN 'technical' ELSE 'standard' END AS mode
    FROM (SELECT doc_id, ['smart', 'technical', 'odd', 'standard'][doc_id % 4 + 1] AS mode, lower(source) IN ('src0', 'src3') AS technical FROM documents)""",
)
PARTS["mode_pairs"] = (
    ("placed", "doc_mode", "pairs"),
    f"""SELECT mode, b.* EXCLUDE (word) FROM (SELECT DISTINCT word, mode FROM placed JOIN doc_mode USING (doc_id)) JOIN (SELECT CASE WHEN layout = 'en' THEN active ELSE shadow END AS word, * FROM pairs) b USING (word)""",
)
PARTS["ps_so"] = (("ptexts", "ngrams", "meta", "firsts"), PARTS["ps_en"][1].replace("'en'", "'so'"))
PARTS["mode_decided"] = (
    ("mode_pairs", "ptexts", "ps_en", "ps_so", "ps_he", "collisions"),
    """SELECT mode, active, shadow, layout, on_delimiter, diff AS score_diff, coll AS is_colliding, short OR (NOT coll AND diff <= 4.0 AND diff > 0) AS is_ambiguous, NOT short AND NOT coll AND diff > 4.0 AS should_switch FROM (
    SELECT *, length(active) < 2 AS short, CASE WHEN length(active) < 2 THEN 0 WHEN layout = 'en' THEN h - e ELSE e - h END AS diff,
           length(active) >= 2 AND (lower(active) IN (SELECT word FROM collisions) OR lower(shadow) IN (SELECT word FROM collisions)) AS coll
    FROM (SELECT m.*, h.score AS h, CASE WHEN mode = 'technical' THEN greatest(e.score, s.score) ELSE e.score END AS e
          FROM mode_pairs m JOIN ptexts p USING (active, shadow, layout, on_delimiter) JOIN ps_en e ON e.text = en_text JOIN ps_so s ON s.text = en_text JOIN ps_he h ON h.text = he_text))""",
)
for kind, columns in (
    ("fp", "count(*) AS lines_tested, sum(n_words)::BIGINT AS words_tested, sum(fp_count)::BIGINT AS fp_count, sum(recovery_count)::BIGINT AS recovery_count, count(*) FILTER (fp_count > 0) AS lines_with_fp"),
    ("fn", "count(*) FILTER (line_switched) AS lines_switched, sum(words_not_switched)::BIGINT AS words_not_switched, sum(latency)::BIGINT AS total_latency_chars"),
):
    standard, technical = (("fp", "tech") if kind == "fp" else ("fn", "tfn"))
    PARTS[f"mode_{kind}"] = (
        (standard, technical, "doc_mode"),
        f"SELECT lang, mode, {columns} FROM (SELECT * FROM {standard} JOIN doc_mode USING (doc_id) WHERE mode = 'standard' UNION ALL SELECT * FROM {technical} JOIN doc_mode USING (doc_id) WHERE mode = 'technical') GROUP BY lang, mode",
    )
CATEGORY = "CASE WHEN abs(score_diff) > 3 THEN '|x| > 3' WHEN abs(score_diff) > 2 THEN '3 > |x| > 2' WHEN abs(score_diff) > 1 THEN '2 > |x| > 1' ELSE '1 > |x|' END"
PARTS["log"] = (
    ("decided",),
    f"SELECT (1704067200 + 60 * length(active))::BIGINT * 1000000 AS time, active AS active_word, shadow AS shadow_word, layout, on_delimiter, is_colliding, is_ambiguous, round(score_diff, 3) AS score_diff, 4.0::DOUBLE AS delta, {CATEGORY} AS category, should_switch FROM decided WHERE length(active) >= 2",
)


def sql(select: str, *needs: str) -> str:
    """`select` behind the parts that it needs, and those that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for n in PARTS[name][0]:
                add(n)
            order.append(name)

    for n in needs:
        add(n)
    head = ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order)
    return f"WITH RECURSIVE {head}\n{select}" if head else select


def filtered(condition: str, lines: str = "lines") -> str:
    return sql(
        f"SELECT lang, word, count(*) AS cnt FROM (SELECT lang, unnest({split('norm')}) AS word FROM (SELECT lang, regexp_replace({strip('lower(line)')}, '[\\x{{200E}}\\x{{200F}}]', '', 'g') AS norm FROM {lines})) WHERE {condition} GROUP BY 1, 2", lines
    )


EN_MODEL = "SELECT model, n, gram, cnt FROM ngrams"
ALL_PAGES = "FROM pages"
ORACLES = {
    "a1_corpus_scan": "SELECT lang, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY lang",
    "a2_comment_dump": "SELECT conv_id * 1000 + turn AS id, text FROM conversations",
    "a3_explode_lines": sql("SELECT * FROM lines", "lines"),
    "a4_cap_lines": sql("SELECT lang, doc_id, line_no FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, line_no) AS r FROM lines) WHERE r <= 500", "lines"),
    "a5_sample_mod": "SELECT doc_id, lang, source FROM documents WHERE doc_id % 10 = 0",
    "a6_strip_markup": f"SELECT * FROM (SELECT page_id, {clean_markup('html')} AS clean FROM pages) WHERE clean <> ''",
    "a7_unescape_entities": sql(f"SELECT page_id, {unescape('html')} AS html FROM dumped", "dumped"),
    "a8_scrub": sql(f"SELECT page_id, {scrub(unescape('clean'))} AS line FROM (SELECT page_id, {clean_markup('html')} AS clean FROM (SELECT page_id, {unescape('html')} AS html FROM dumped))", "dumped"),
    "a9_budget_cut": sql("SELECT * FROM (SELECT id, coalesce(sum(strlen(body) + 1) OVER o, 0)::BIGINT AS bytes_before, coalesce(count(*) OVER o, 0) AS lines_before FROM comments WHERE body IS NOT NULL WINDOW o AS (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE bytes_before < 100000 AND lines_before < 2000000", "comments"),
    "a10_drop_tombstones": sql("SELECT id, channel FROM comments WHERE coalesce(body, '') NOT IN ('', '[deleted]', '[removed]')", "comments"),
    "a11_script_flags": sql(f"SELECT id, regexp_matches(body, {HEBREW}) AS has_hebrew, regexp_matches(body, {ENGLISH}) AS has_english, regexp_matches(body, {NIKUD}) AS has_nikud FROM comments", "comments"),
    "a12_pure_lines": sql(
        f"SELECT * FROM (WITH b AS (SELECT * FROM lines UNION ALL SELECT * FROM he_lines) SELECT * FROM (SELECT doc_id, line_no, 'he' AS script FROM b WHERE regexp_matches(line, {HEBREW}) AND NOT regexp_matches(line, {ENGLISH}) AND NOT regexp_matches(line, {NIKUD}) ORDER BY 1, 2 LIMIT 800) UNION ALL SELECT * FROM (SELECT doc_id, line_no, 'en' FROM b WHERE regexp_matches(line, {ENGLISH}) AND NOT regexp_matches(line, {HEBREW}) ORDER BY 1, 2 LIMIT 800))",
        "lines", "he_lines",
    ),
    "a13_mixed_sample": sql("SELECT min(id) AS id, text FROM mixed_c GROUP BY text ORDER BY 1 LIMIT 50", "mixed_c"),
    "a14_merge_samples": sql(
        "SELECT * FROM (WITH o AS (SELECT min(id) AS id, text FROM mixed_c WHERE channel = 'assistant' GROUP BY text ORDER BY 1 LIMIT 40), n AS (SELECT min(id) AS id, text FROM mixed_c GROUP BY text ORDER BY 1 LIMIT 50), u AS (SELECT 0 AS part, id, text FROM o UNION ALL SELECT 1, id, text FROM n) SELECT part, id, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY part, id) AS r FROM u) WHERE r = 1 ORDER BY part, id LIMIT 60)",
        "mixed_c",
    ),
    "b1_normalise": sql(f"SELECT * FROM (SELECT doc_id, line_no, regexp_replace({strip('lower(line)')}, '[\\x{{200E}}\\x{{200F}}]', '', 'g') AS line FROM lines) WHERE line <> ''", "lines"),
    "b2_words": filtered("true"),
    "b3_pure_words": filtered(f"translate(word, {lit(EN_ALLOWED)}, '') = ''"),
    "b4_drop_vocalised": filtered(f"NOT regexp_matches(word, {NIKUD})", "voiced"),
    "b5_cap_word_len": filtered("length(word) <= 12"),
    "b6_ngrams": sql("SELECT model, word, count(*) AS n_grams, max(gram) AS last_gram FROM wordgrams GROUP BY model, word", "wordgrams"),
    "b7_ngram_counts": sql(EN_MODEL + " WHERE model = 'en'", "ngrams"),
    "b8_vocab_size": sql("SELECT * FROM vocab", "vocab"),
    "b9_model_totals": sql("SELECT model, ch, total, total_bigrams FROM firsts JOIN totals USING (model)", "firsts", "totals"),
    "b10_merge_models": sql(EN_MODEL + " WHERE model = 'en'", "ngrams"),
    "b11_train": sql(EN_MODEL, "ngrams"),
    "b12_export_json": sql(EN_MODEL, "ngrams"),
    "b13_load_models": sql("SELECT model, n, count(*) AS n_grams, sum(cnt)::BIGINT AS total FROM (SELECT model, n, cnt FROM ngrams WHERE model = 'he' OR (model = 'en' AND n = 4) UNION ALL SELECT 'so', n, cnt FROM ngrams WHERE model = 'en' AND n = 4) GROUP BY model, n", "ngrams"),
    "c1_shadow_en_he": sql(f"SELECT DISTINCT word, {to_he('word')} AS shadow FROM (SELECT unnest({split('line')}) AS word FROM lines)", "lines"),
    "c2_shadow_he_en": sql(f"SELECT DISTINCT word, {to_en('word')} AS shadow FROM he_words", "he_words"),
    "c3_strict_shadow": sql(f"SELECT DISTINCT word, {STRICT} AS shadow FROM he_words", "he_words"),
    "c4_keymap": sql(
        f"SELECT en, he, shifted, coalesce(cnt, 0) AS cnt FROM (SELECT unnest(string_split({lit(EN_ROW)}, '')) AS en, unnest(string_split({lit(HE_ROW)}, '')) AS he, false AS shifted UNION ALL SELECT upper(c), {to_he('c')}, true FROM (SELECT unnest(string_split({lit(LETTERS)}, '')) AS c)) LEFT JOIN (SELECT ch AS en, count(*) AS cnt FROM (SELECT unnest(string_split(line, '')) AS ch FROM lines WHERE lang = 'en') GROUP BY 1) USING (en)",
        "lines",
    ),
    "d1_score": sql("SELECT * FROM score_en", "score_en"),
    "d2_score_trace": sql("SELECT text, j, gram, c4, c3, round(step, 6) AS step, round(total, 6) AS total FROM trace", "trace"),
    "d3_prefix_scores": sql("SELECT substr(text, 2, length(text) - 2) AS word, j, round(total, 6) AS score FROM trace WHERE j > 0 AND length(text) >= 4", "trace"),
    "d4_step_score": sql("SELECT substr(gram, 1, 3) AS context, substr(gram, 4, 1) AS ch, round(min(step), 6) AS step FROM trace WHERE j > 0 GROUP BY 1, 2", "trace"),
    "d5_score_en": sql("SELECT e.text, greatest(e.score, s.score) AS score FROM score_en e JOIN score_so s USING (text)", "score_en", "score_so"),
    "d6_resolve_mode": "SELECT doc_id, mode, technical, CASE WHEN mode IN ('technical', 'standard') THEN mode WHEN technical THEN 'technical' ELSE 'standard' END AS resolved FROM (SELECT doc_id, ['smart', 'technical', 'odd', 'standard'][doc_id % 4 + 1] AS mode, lower(source) IN ('src0', 'src3') AS technical FROM documents)",
    "d7_compare_layouts": sql(
        "SELECT word, e.score AS score_en, h.score AS score_he, round(h.raw - e.raw, 6) AS diff_if_en, round(e.raw - h.raw, 6) AS diff_if_he, CASE WHEN h.raw > e.raw THEN 'he' ELSE 'en' END AS verdict FROM (SELECT word, ' ' || lower(word) || ' ' AS en, ' ' || " + to_he("word") + " || ' ' AS he FROM awords) w JOIN d7_en e ON e.text = w.en JOIN d7_he h ON h.text = w.he",
        "d7_en", "d7_he",
    ),
    "e1_lexicon_en": sql("SELECT * FROM lex_en", "lex_en"),
    "e2_lexicon_he": sql("SELECT * FROM lex_he", "lex_he"),
    "e3_collision_pairs": sql("SELECT * FROM pairs_c", "pairs_c"),
    "e4_collision_set": sql("SELECT * FROM collisions", "collisions"),
    "e5_flag_collisions": sql("SELECT active, shadow, layout, lower(active) IN (SELECT word FROM collisions) OR lower(shadow) IN (SELECT word FROM collisions) AS is_colliding FROM pairs", "pairs", "collisions"),
    "e6_decide": sql("SELECT * REPLACE (round(score_diff, 6) AS score_diff) FROM decided", "decided"),
    "e6_decide_modes": sql("SELECT * REPLACE (round(score_diff, 6) AS score_diff) FROM mode_decided", "mode_decided"),
    "e7_first_trigger": sql(
        f"SELECT word, CASE WHEN hit.j = length(word) - 1 THEN -1 ELSE hit.j + 1 END AS idx, round(hit.d, 6) AS diff FROM (SELECT word, list_filter(coalesce(evals, []), lambda e: NOT e.coll AND e.d > 4.0)[1] AS hit FROM awords LEFT JOIN evals e ON e.en = word AND e.he = {to_he('word')})",
        "awords", "evals",
    ),
    "e8_delta_schedule": sql(f"SELECT len({split('line')})::INTEGER AS k, count(*) AS n_lines, round(4.0 + 0.5 * pow(len({split('line')}), 2), 6) AS delta FROM lines GROUP BY ALL", "lines"),
    "e9_gap_category": sql(f"SELECT layout, {CATEGORY} AS category, count(*) AS n FROM decided GROUP BY 1, 2", "decided"),
    "e10_decision_log": sql("SELECT * FROM log", "log"),
    "e11_retain_last": "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000",
    "e12_exclude_sources": "SELECT doc_id, source FROM documents WHERE lower(source) NOT IN ('src0', 'src7')",
    "e13_flag_technical": "SELECT doc_id, source, lower(source) IN ('src1', 'src2') AS technical FROM documents",
    "f1_word_buffers": sql("SELECT * FROM buffers", "buffers"),
    "f2_audit_fp": sql("SELECT * FROM fp", "fp"),
    "f2_fp_report": sql("SELECT * FROM fp_report", "fp_report"),
    "f3_audit_fn": sql("SELECT * FROM fn", "fn"),
    "f3_fn_report": sql("SELECT * FROM fn_report", "fn_report"),
    "f3_mode_reports": sql("SELECT * FROM mode_fp JOIN mode_fn USING (lang, mode)", "mode_fp", "mode_fn"),
    "f4_latency_summary": sql("SELECT lang, count(*) AS n, round(avg(latency), 6) AS mean, median(latency) AS median, list_sort(list(latency))[least(floor(count(*) * 0.95), count(*) - 1)::BIGINT + 1] AS p95 FROM fn GROUP BY lang", "fn"),
    "f5_rates": sql(
        "SELECT lang, round(fp_count / words_tested * 100, 6) AS fp_percent, round(lines_with_fp / lines_tested * 100, 6) AS lines_with_fp_percent, r.a AS lines_switched_percent, r.b AS words_not_switched_percent FROM fp_report JOIN (SELECT lang, round(lines_switched / lines_tested * 100, 6) AS a, round(words_not_switched / words_tested * 100, 6) AS b FROM fn_report) r USING (lang)",
        "fp_report", "fn_report",
    ),
    "f6_flagged": sql(
        """SELECT 'fp' AS kind, b.doc_id, b.line_no, substr(line, 1, 100) AS excerpt,
           string_agg(CASE WHEN correct THEN 'FP' ELSE 'Recovery' END || ' ' || (w + 1) || ' ' || word || CASE WHEN correct THEN printf(' diff=%+.2f delta=%.2f', diff, 4.0 + 0.5 * pow(k, 2)) ELSE '' END || ' lookback=' || tail, '; ' ORDER BY w) AS details
        FROM (SELECT DISTINCT doc_id, line_no FROM ev_fp WHERE switched AND correct ORDER BY 1, 2 LIMIT 30) b JOIN ev_fp e ON e.doc_id = b.doc_id AND e.line_no = b.line_no AND e.switched JOIN lines l ON l.doc_id = b.doc_id AND l.line_no = b.line_no GROUP BY ALL
        UNION ALL SELECT 'fn', b.doc_id, b.line_no, substr(line, 1, 100),
           CASE WHEN line_switched THEN 'switch ' || (e.w + 1) || ' ' || e.word || ' latency=' || latency || ' uncorrected=' || words_not_switched ELSE 'no switch lost=' || latency END
        FROM (SELECT * FROM fn WHERE NOT line_switched OR words_not_switched > 0 ORDER BY doc_id, line_no LIMIT 30) b JOIN lines l ON l.doc_id = b.doc_id AND l.line_no = b.line_no
        LEFT JOIN (SELECT doc_id, line_no, min(w) AS w, arg_min(word, w) AS word FROM ev_fn WHERE switched AND NOT correct GROUP BY 1, 2) e ON e.doc_id = b.doc_id AND e.line_no = b.line_no""",
        "ev_fp", "fn",
    ),
    "f7_lookback": sql("SELECT doc_id, lang, line_no, w, tail AS lookback FROM ev_fp WHERE switched", "ev_fp"),
    "f8_repair": sql(f"SELECT doc_id, lang, line_no, string_agg(CASE WHEN swap THEN {to_he('word')} ELSE word END, ' ' ORDER BY w) AS repaired FROM swaps GROUP BY doc_id, lang, line_no", "swaps"),
    "f9_script_runs": sql("SELECT * FROM runs", "runs"),
    "f10_mixed_valid": sql("SELECT sample_id, CASE WHEN pos IS NULL THEN 'no_switch' ELSE 'fp_early' END AS status, coalesce(pos, total)::BIGINT AS chars FROM places LEFT JOIN (SELECT * FROM hits_one WHERE NOT trap) USING (sample_id)", "places", "hits_one"),
    "f11_mixed_trap": sql(
        "SELECT sample_id, CASE WHEN pos IS NULL THEN 'no_switch' WHEN pos > trap_start THEN 'caught_trap' ELSE 'fp_early' END AS status, coalesce(pos, total)::BIGINT AS chars, greatest(coalesce(pos, total) - trap_start, 0)::BIGINT AS chars_since_trap FROM places LEFT JOIN (SELECT * FROM hits_one WHERE trap) USING (sample_id)",
        "places", "hits_one",
    ),
    "f12_mixed_metrics": sql("SELECT * FROM metrics_one", "metrics_one"),
    "f13_grid_search": sql("SELECT * FROM metrics_grid", "metrics_grid"),
    "f14_leaderboard": sql("SELECT * FROM metrics_grid ORDER BY fpr, recall DESC, lat, d0, a, p LIMIT 10", "metrics_grid"),
    "f15_audit_compare": sql(
        "SELECT 'standard' AS version, fp_report.*, lines_switched, words_not_switched, total_latency_chars FROM fp_report JOIN fn_report USING (lang) UNION ALL SELECT 'technical', tech_report.*, lines_switched, words_not_switched, total_latency_chars FROM tech_report JOIN tfn_report USING (lang)",
        "fp_report", "tech_report", "fn_report", "tfn_report",
    ),
    "g2_segment_stream": "SELECT user_id, epoch_us(min(ts)) AS began_us, epoch_us(max(ts)) + 3600000000 AS ended_us, count(*) AS n_events FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 3600000000 THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s HAVING epoch_us(max(ts)) + 3600000000 <= (SELECT epoch_us(max(ts)) FROM events) - 60000000",
    "g1_segment": "SELECT event_id, user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS segment FROM (SELECT *, CASE WHEN lag(ts) OVER o IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER o) > 3600000000 OR event_type IN ('click', 'tab', 'caps', 'select_all', 'suspend') THEN 1 ELSE 0 END AS b FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))",
    "g3_score_stream": sql("SELECT * REPLACE (round(score_diff, 6) AS score_diff) FROM decided", "decided"),
    "g4_ngram_stream": sql(EN_MODEL + " WHERE model = 'en'", "ngrams"),
    "g5_detect_stream": sql(
        "SELECT doc_id AS session, l.r + l.before + e.w + 1 AS event_id, word, switched, k, CASE WHEN switched THEN tail ELSE 0 END AS lookback, CASE WHEN correct THEN 'en' ELSE 'he' END AS layout FROM sessions JOIN line_ends l USING (doc_id, r, began) JOIN either e USING (doc_id, line_no, began)",
        "sessions", "line_ends", "either",
    ),
    "g6_log_stream": sql("SELECT * FROM log", "log"),
    "g7_mixed_stream": sql("SELECT DISTINCT text FROM mixed_c", "mixed_c"),
}

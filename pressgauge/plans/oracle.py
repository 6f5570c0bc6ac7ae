"""The catalogue's queries restated as DuckDB SQL, written from the rules rather
than from the Spark plans. What a model's fit gives has no SQL counterpart."""

from __future__ import annotations

import re

from pressgauge.functions import intake, wording
from pressgauge.functions.fingerprints import RULES
from pressgauge.operators import calibration, linear
from pressgauge.plans.standins import BAND, MARKERS, RECORD

# --- expressions -----------------------------------------------------------------

_SPACES = r"\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACES}]+|[{_SPACES}]+$', '', 'g')"


def norm(x: str) -> str:
    plain = f"translate({x}, '‘’‚‛′ʼ', '''''''''''''')"
    return (
        f"trim(regexp_replace(replace(lower(strip_accents({plain})), '''', ''), '[^a-z0-9]+', ' ', 'g'))"
    )


def simple(x: str) -> str:
    accented = "([À-ÅÇ-ÏÑ-ÖÙ-Ýà-åç-ïñ-öù-ýÿ])"
    plain = f"lower(strip_accents(regexp_replace({x}, '{accented}', '\\1 ', 'g')))"
    return f"trim(regexp_replace(replace({plain}, '''', ''), '[^a-z0-9]+', ' ', 'g'))"


def opening(normalized: str) -> str:
    words = f"string_split({normalized}, ' ')"
    return f"CASE WHEN len({words}) >= 20 THEN array_to_string({words}[1:20], ' ') ELSE '' END"


def extract(x: str) -> str:
    s = strip(x)
    return f"CASE WHEN length({s}) > 600 THEN substr({s}, 1, 600) || '...' ELSE {s} END"


def clean(x: str) -> str:
    for _, pattern, ignore in RULES:
        x = f"regexp_replace({x}, {text(_re2(pattern))}, ' ', '{'gi' if ignore else 'g'}')"
    return f"trim(regexp_replace({x}, '[{_SPACES}]+', ' ', 'g'))"


def _re2(pattern: str) -> str:
    spelled = {r"[-\s]": f"[-{_SPACES}]", r"\S": f"[^{_SPACES}]", r"\s": f"[{_SPACES}]"}
    return re.sub(r"\[-\\s\]|\\S|\\s", lambda m: spelled[m.group()], pattern)


def hits(x: str, pattern: str, ignore: bool) -> str:
    return f"len(regexp_extract_all({x}, {text(('(?i)' if ignore else '') + _re2(pattern))}))::INT"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_''-]+'))"


def latin(x: str) -> str:
    letters = f"len(regexp_extract_all({x}, '\\p{{L}}'))"
    return f"coalesce(len(regexp_extract_all({x}, '[A-Za-z]')) / nullif({letters}, 0), 0.0)"


def english(x: str) -> str:
    tokens = f"regexp_extract_all(lower({x}), '[a-z'']+')"
    markers = ", ".join(text(m) for m in intake.ENGLISH_MARKERS)
    return f"coalesce(len(list_filter({tokens}, lambda w: w IN ({markers}))) / nullif(len({tokens}), 0), 0.0)"


def rank(x: str) -> str:
    return f"CASE {x} WHEN 'fact_check' THEN 0 WHEN 'source' THEN 1 ELSE 99 END"


def percent(condition: str, among: str = "TRUE") -> str:
    return f"round(avg(CASE WHEN {condition} THEN 1.0::DOUBLE ELSE 0.0 END) FILTER ({among}) * 100, 1)"


# --- common tables ---------------------------------------------------------------

PASTE = f"""
stripped AS (SELECT doc_id, source, lang, {strip('text')} AS t FROM documents),
paste AS (
  SELECT doc_id AS id, source, lang, {strip("split_part(t, chr(10), 1)")} AS headline,
    {strip("CASE WHEN instr(t, chr(10)) > 0 THEN substr(t, instr(t, chr(10)) + 1) ELSE '' END")} AS body
  FROM stripped)"""

LABELLED = f"""{PASTE},
labelled AS (
  SELECT p.*, CASE WHEN quality = 0 THEN 'FAKE' ELSE 'REAL' END AS label,
    CASE WHEN toxic = 1 THEN 'fact_check' ELSE 'source' END AS basis, toxic
  FROM paste p JOIN labels l ON l.doc_id = p.id)"""

CORPUS = f"""{LABELLED},
extracted AS (SELECT *, {extract('body')} AS article_text FROM labelled),
corpus AS (
  SELECT id, substr({strip('headline')}, 1, 1000) AS headline, substr({norm('headline')}, 1, 1000) AS headline_key,
    article_text, substr({opening(norm('article_text'))}, 1, 400) AS body_key, label, source, basis AS label_basis
  FROM extracted)"""

INCOMING = f"""{CORPUS},
incoming AS (
  SELECT CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS file_no, id AS pos,
    CASE WHEN lang = 'en' THEN 'english.csv' ELSE 'other.csv' END AS file, headline, body,
    CASE WHEN id % 2 = 0 THEN 'FAKE' ELSE 'REAL' END AS label, source,
    CASE source WHEN 'src3' THEN 'fact_check' WHEN 'src5' THEN 'hearsay' ELSE 'source' END AS basis,
    {norm('headline')} AS key
  FROM paste),
held AS (SELECT headline_key AS key, min({rank('label_basis')}) AS held_rank FROM corpus GROUP BY 1),
ordered AS (
  SELECT i.*, held_rank, {rank('basis')} AS r,
    min({rank('basis')}) OVER (PARTITION BY i.key ORDER BY file_no, pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier_rank
  FROM incoming i LEFT JOIN held h ON h.key = i.key),
decided AS (
  SELECT *, CASE WHEN key = '' THEN 'unusable'
      WHEN held_rank IS NULL AND earlier_rank IS NULL THEN 'added'
      WHEN r < least(coalesce(held_rank, 1000), coalesce(earlier_rank, 1000)) THEN 'better_evidence'
      ELSE 'already_had' END AS outcome
  FROM ordered)"""



def _inserted(held: str, part: str) -> str:
    """What a load of `part` of the incoming rows adds to the table `held`, with ids."""
    return f"""SELECT row_number() OVER (ORDER BY file_no, pos) + (SELECT max(id) FROM {held}) AS id,
          substr(key, 1, 1000) AS headline_key, basis AS label_basis
        FROM (SELECT *, {rank('basis')} AS r, min({rank('basis')}) OVER (PARTITION BY key ORDER BY file_no, pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM incoming WHERE {part}) i
          LEFT JOIN (SELECT headline_key AS key, min({rank('label_basis')}) AS best FROM {held} GROUP BY 1) h USING (key)
        WHERE key <> '' AND r < least(coalesce(best, 1000), coalesce(before, 1000))"""


KEYS = f"""{CORPUS},
normed AS (SELECT *, {norm('headline')} AS nh, {norm('body')} AS nb, {norm("headline || chr(10) || body")} AS nt FROM paste),
keyed AS (SELECT *, nh AS k0, {opening('nb')} AS k1, {opening('nt')} AS k2 FROM normed),
by_head AS (SELECT * FROM corpus WHERE headline_key <> ''
  QUALIFY row_number() OVER (PARTITION BY headline_key ORDER BY {rank('label_basis')}, id) = 1),
by_body AS (SELECT * FROM corpus WHERE body_key <> ''
  QUALIFY row_number() OVER (PARTITION BY body_key ORDER BY {rank('label_basis')}, id) = 1)"""

_TEXT = strip("headline || ' ' || body")
_MODEL_INPUT = f"CASE WHEN {clean(_TEXT)} <> '' THEN {clean(_TEXT)} ELSE {_TEXT} END"
_TOO_SHORT = (
    f"printf({text(wording.TOO_SHORT.replace('%d word', '%d word', 1))}, n_words::INT, "
    f"CASE WHEN n_words = 1 THEN '' ELSE 's' END, {intake.MIN_WORDS})"
)
CASCADE = f"""{KEYS},
found AS (
  SELECT k.*, coalesce(h.id, b1.id, b2.id) AS match_id,
    CASE WHEN h.id IS NOT NULL THEN 'headline' WHEN coalesce(b1.id, b2.id) IS NOT NULL THEN 'body' END AS matched_on,
    {words("k.headline || ' ' || k.body")} AS n_words
  FROM keyed k LEFT JOIN by_head h ON h.headline_key = k.k0
    LEFT JOIN by_body b1 ON b1.body_key = k.k1 LEFT JOIN by_body b2 ON b2.body_key = k.k2),
scored AS (
  SELECT f.*, c.headline AS c_headline, c.article_text AS c_text, c.label AS c_label, c.source AS c_source, c.label_basis AS c_basis,
    CASE WHEN match_id IS NULL AND n_words >= 25
      THEN ('0x' || substr(md5({_MODEL_INPUT.replace('headline', 'f.headline').replace('body', 'f.body')}), 1, 6))::BIGINT / 16777215.0::DOUBLE END AS p
  FROM found f LEFT JOIN corpus c ON c.id = f.match_id),
told AS (
  SELECT *, CASE WHEN match_id IS NOT NULL THEN 'database' WHEN p IS NULL THEN 'too_short' ELSE 'reading_model' END AS method
  FROM scored),
cascade AS (
  SELECT id, headline, body, match_id, matched_on, c_headline, c_text, n_words, p, method,
    CASE method WHEN 'database' THEN CASE WHEN c_label = 'FAKE' THEN 100 ELSE 0 END WHEN 'too_short' THEN 50
      ELSE round_even(p * 100, 0)::INT END AS score,
    CASE method WHEN 'database' THEN CASE WHEN c_label = 'FAKE' THEN 'Likely Fake' ELSE 'Likely Real' END
      WHEN 'too_short' THEN 'Not Sure' ELSE CASE WHEN p > {RECORD.score_above} THEN 'Likely Fake' ELSE 'Likely Real' END END AS label,
    CASE method WHEN 'database' THEN 100.0::DOUBLE WHEN 'reading_model'
      THEN CASE WHEN p > {RECORD.score_above} THEN {RECORD.fake_precision}::DOUBLE ELSE {RECORD.real_precision}::DOUBLE END END AS confidence,
    CASE method WHEN 'database' THEN 'Found in our dataset of ' || format('{{:,}}', (SELECT count(*) FROM corpus)) || ' articles, '
        || CASE c_basis WHEN 'fact_check' THEN 'fact-checked ' ELSE 'labelled ' END || c_label || ' by ' || c_source || '.'
        || CASE matched_on WHEN 'body' THEN {text(wording.DATABASE_BODY_NOTE)} ELSE '' END
        || ' The 100% is how certain the match is.'
      WHEN 'too_short' THEN {_TOO_SHORT}
      ELSE 'Not in our dataset, so the reading model read the article itself. Verdicts like this are right '
        || CASE WHEN p > {RECORD.score_above} THEN '{RECORD.fake_precision}' ELSE '{RECORD.real_precision}' END
        || '% of the time, measured on {RECORD.measured_on:,} articles it never saw in training.' END AS explanation
  FROM told),
shown AS (
  SELECT id, CASE WHEN length(headline) > 500 THEN substr(headline, 1, 497) || '...' ELSE headline END AS headline,
    CASE WHEN body = '' AND length(headline) > 500 THEN headline ELSE body END AS article_text, score,
    label AS result_label, confidence, method, coalesce(c_headline, '') AS matched_headline,
    to_timestamp(1704067200 + id) AT TIME ZONE 'UTC' AS analyzed_at
  FROM cascade)"""

_markers = "[" + ", ".join(text(m) for m in MARKERS) + "]"
MARKED = f"""
marked AS (SELECT doc_id, lang, source, {_markers}[(doc_id % {len(MARKERS)})::INT + 1] || text AS raw FROM documents)"""

TAUGHT = f"""{LABELLED},
joined AS (SELECT id, source, label, {norm('headline')} AS key, {_TEXT} AS raw FROM labelled),
taught AS (
  SELECT *, {clean('raw')} AS cleaned, (label = 'FAKE')::INT AS label_binary,
    CASE WHEN length(source) = 4 THEN 'first' ELSE 'second' END AS collection
  FROM joined WHERE raw <> '' AND {clean('raw')} <> '')"""

_g = "CASE WHEN {x} < 0.5 THEN 2 * {x} * {x} ELSE 1 - 2 * (1 - {x}) * (1 - {x}) END"
EXAM = f"""
spread AS (SELECT event_id, value / (value + 35) AS x, ((event_id * 7919 % 1000) / 1000::DOUBLE - 0.5::DOUBLE) * 0.35::DOUBLE AS noise FROM events),
once AS (SELECT *, {_g.format(x='x')} AS y FROM spread),
exam AS (SELECT event_id, {_g.format(x='y')} AS score, CASE WHEN x + noise > 0.5 THEN 1 ELSE 0 END AS truth FROM once)"""

HALVES = f"""{EXAM},
split AS (
  SELECT *, row_number() OVER (PARTITION BY truth ORDER BY md5('42-' || event_id)) <= floor(count(*) OVER (PARTITION BY truth) * 0.5) AS chooses
  FROM exam),
half_a AS (SELECT * FROM split WHERE chooses),
half_b AS (SELECT * FROM split WHERE NOT chooses)"""


def _candidates(count: int) -> str:
    return f"""{HALVES},
ranked AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS r FROM half_a),
places AS (
  SELECT CASE WHEN i = {count - 1} THEN 0.999::DOUBLE ELSE 0.001::DOUBLE + i * ((0.999::DOUBLE - 0.001::DOUBLE) / {count - 1}) END
    * ((SELECT count(*) FROM half_a) - 1) AS place
  FROM range({count}) t(i)),
around AS (
  SELECT place - floor(place) AS part, a.score AS low, b.score AS high FROM places
    JOIN ranked a ON a.r = floor(place)::BIGINT JOIN ranked b ON b.r = ceil(place)::BIGINT),
found_candidates AS (
  SELECT CASE WHEN part < 0.5 THEN low + (high - low) * part ELSE high - (high - low) * (1 - part) END AS cutoff FROM around
  UNION SELECT 0.05::DOUBLE + i * 0.05::DOUBLE FROM range(19) t(i)),
candidates AS (SELECT row_number() OVER (ORDER BY cutoff)::INT AS position, cutoff FROM found_candidates)"""


SWEEP_STEPS = """
counts AS (
  SELECT position, cutoff, count(*) AS n, count(*) FILTER (truth = 1) AS fakes, count(*) FILTER (truth = 0) AS reals,
    count(*) FILTER (truth = 1 AND score >= cutoff) AS caught, count(*) FILTER (truth = 0 AND score < cutoff) AS spared
  FROM candidates, half_a GROUP BY ALL),
swept AS (
  SELECT position, cutoff, (caught + spared) * 100 / n AS accuracy, spared / reals AS real_recall, caught / fakes AS fake_recall
  FROM counts)"""
SWEEP = f"{_candidates(calibration.SWEEP_CANDIDATES)},{SWEEP_STEPS}"
FINE = f"""{HALVES},
candidates AS (SELECT (i + 1)::INT AS position, 0.05::DOUBLE + i * 0.01::DOUBLE AS cutoff FROM range(91) t(i)),{SWEEP_STEPS}"""


def _selected(cap: int, tests: str, full: str, extra: str = "") -> str:
    """The walk itself, one row per step of a recursive query."""
    return f"""RECURSIVE {LABELLED}{extra},
walked AS (
  SELECT id, source, {norm('headline')} AS key, count(*) OVER (PARTITION BY source) AS seen, lang, {strip('body')} AS text FROM paste),
screened AS (SELECT *, CASE {tests} END AS fell FROM walked),
queue AS (
  SELECT *, row_number() OVER (ORDER BY seen, id) AS step FROM screened WHERE fell IS NULL),
walk(step, held, sites, took) AS (
  SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], FALSE
  UNION ALL
  SELECT q.step,
    CASE WHEN ok THEN list_append(held, q.key) ELSE held END,
    CASE WHEN ok THEN list_append(sites, q.source) ELSE sites END, ok
  FROM (
    SELECT q.*, w.held, w.sites,
      NOT list_contains(w.held, q.key) AND len(list_filter(w.sites, lambda s: s = q.source)) < {cap} AS ok
    FROM walk w JOIN queue q ON q.step = w.step + 1) q),
kept_rows AS (SELECT q.* FROM queue q JOIN walk w ON w.step = q.step WHERE took),
selected AS (
  SELECT s.id, s.source, s.seen, k.id IS NOT NULL AS kept,
    CASE WHEN s.fell IS NOT NULL THEN s.fell WHEN k.id IS NOT NULL THEN NULL
      WHEN EXISTS (SELECT 1 FROM kept_rows e WHERE e.key = s.key AND (e.seen, e.id) < (s.seen, s.id)) THEN 'duplicate of one we kept'
      ELSE '{full}' END AS reason
  FROM screened s LEFT JOIN kept_rows k ON k.id = s.id)"""


FAKES = _selected(
    20,
    "WHEN lang NOT IN ('en', 'fr', 'de') THEN 'label we are not using' WHEN length(text) < 400 THEN 'too short to learn from' "
    "WHEN key = '' THEN 'no usable headline' WHEN key IN (SELECT key FROM blocked) THEN 'IN THE TEST SET - excluded'",
    "website already at its cap",
    f", blocked AS (SELECT {norm('headline')} AS key FROM labelled WHERE toxic = 1)",
)
_allowed = ", ".join(f"'src{i}'" for i in range(2, 18))
REALS = _selected(
    15,
    f"WHEN source IN ('src3', 'src4') THEN 'excluded outlet (' || source || ')' WHEN source NOT IN ({_allowed}) THEN 'not a general-news outlet' "
    "WHEN length(text) < 400 THEN 'too short to learn from' WHEN key = '' THEN 'no usable headline'",
    "outlet already at its cap",
)

REPLY = """
turns AS (
  SELECT conv_id, turn, role, text, split_part(text, chr(10), 1) AS line, (conv_id + turn) % 8 AS kind FROM conversations),
bodies AS (
  SELECT *,
    json_object('verdict', 'REAL', 'confidence', 'High', 'reporting', [line, 'None', '  BBC  ', 'n/a', role], 'debunking', []::VARCHAR[],
      'summary', text)::VARCHAR AS real,
    json_object('verdict', ' fake ', 'confidence', 'sure', 'reporting', list_transform(range(1, 13), lambda i: 'Outlet ' || i),
      'debunking', [line, 'None', '  BBC  ', 'n/a', role], 'summary', text, 'factcheck_rating', 'Pants on fire')::VARCHAR AS fake,
    json_object('verdict', 'UNCLEAR', 'confidence', 'low', 'reporting', ['null'], 'debunking', []::VARCHAR[], 'summary', text,
      'factcheck_rating', 'None')::VARCHAR AS blank,
    json_object('verdict', 'maybe', 'confidence', 'medium', 'reporting', line, 'debunking', []::VARCHAR[], 'summary', text,
      'factcheck_rating', '')::VARCHAR AS lone
  FROM turns),
replies AS (
  SELECT *, CASE WHEN kind = 0 THEN real WHEN kind = 1 THEN '```json' || chr(10) || fake || chr(10) || '```'
      WHEN kind = 2 THEN 'Here you go: ' || real || ' Hope it helps.' WHEN kind IN (3, 4) THEN 'I could not say. ' || text
      WHEN kind = 6 THEN blank ELSE lone END || ' ' AS answer
  FROM bodies),
parsed AS (SELECT *, TRY_CAST(regexp_extract(answer, '(?s)\\{.*\\}') AS JSON) AS obj FROM replies)"""


def _name_list(path: str, limit: int = 8) -> str:
    value = f"json_extract(obj, '$.{path}')"
    listed = f"CASE json_type({value}) WHEN 'ARRAY' THEN json_extract_string(obj, '$.{path}[*]') ELSE [json_extract_string(obj, '$.{path}')] END"
    trimmed = f"list_transform({listed}, lambda s: {strip('s')})"
    named = f"list_filter({trimmed}, lambda s: s <> '' AND lower(s) NOT IN ('none', 'null', 'n/a'))"
    return f"coalesce(array_to_string(list_transform({named}, lambda s: substr(s, 1, 80))[1:{limit}], ';'), '')"


_verdict = f"upper({strip(chr(34) + 'verdict_raw' + chr(34))})"
REPLIES = f"""{REPLY},
fields AS (
  SELECT *, kind = 5 AS dead, obj IS NULL AND kind <> 5 AS garbled, json_extract_string(obj, '$.verdict') AS verdict_raw,
    {_name_list('reporting')} AS rep, {_name_list('debunking')} AS deb,
    {strip("json_extract_string(obj, '$.factcheck_rating')")} AS rating_raw,
    lower({strip("json_extract_string(obj, '$.confidence')")}) AS conf
  FROM parsed),
judged AS (
  SELECT *, CASE WHEN {_verdict} IN ('REAL', 'FAKE', 'UNCLEAR') THEN {_verdict} ELSE 'UNCLEAR' END AS said,
    CASE WHEN rating_raw <> '' AND lower(rating_raw) NOT IN ('none', 'null', 'n/a') THEN substr(rating_raw, 1, 60) END AS rating,
    substr(CASE WHEN turn % 2 = 0 AND line <> '' THEN line ELSE 'https://news.example.com/' || conv_id END, 1, 100) || ' | https://news.example.com/' || conv_id AS src
  FROM fields),
web AS (
  SELECT conv_id, turn,
    CASE WHEN dead THEN 'unavailable' WHEN garbled THEN CASE WHEN kind = 4 THEN 'unavailable' ELSE 'found' END
      WHEN rep = '' AND deb = '' AND rating IS NULL AND said = 'UNCLEAR' THEN 'nothing' ELSE 'found' END AS status,
    CASE WHEN dead THEN NULL ELSE said END AS verdict,
    CASE WHEN NOT dead AND conf IN ('high', 'medium', 'low') THEN conf END AS confidence,
    CASE WHEN dead THEN '' WHEN garbled THEN substr({strip('answer')}, 1, 300)
      ELSE substr({strip("json_extract_string(obj, '$.summary')")}, 1, 400) END AS summary,
    CASE WHEN NOT dead THEN rating END AS factcheck_rating,
    CASE WHEN dead THEN 'reply had no usable content' WHEN garbled THEN 'could not read the reply as JSON' END AS error,
    CASE WHEN dead THEN '' ELSE rep END AS reporting, CASE WHEN dead THEN '' ELSE deb END AS debunking,
    CASE WHEN dead OR kind = 4 THEN '' ELSE src || ';' || src END AS sources,
    CASE WHEN dead THEN '' ELSE 'query one' || CASE WHEN {strip('line')} IN ('', 'none', 'null', 'n/a') THEN '' ELSE ';' || substr({strip('line')}, 1, 80) END END AS queries
  FROM judged)"""

_profile = f"""
measured AS (SELECT doc_id, s, {words('s')} AS words, {latin('s')} AS la, {english('s')} AS en FROM (SELECT doc_id, {strip('text')} AS s FROM documents)),
profile AS (
  SELECT *, CASE WHEN s = '' THEN 'empty' WHEN words > 400 THEN 'too_long' WHEN la < 0.85 THEN 'not_english'
    WHEN words >= 25 AND en < 0.10 THEN 'not_english_prose' END AS problem
  FROM measured)"""

_counts = ", ".join(
    f"{hits('raw', p, i)} AS {n.replace(' ', '_').replace('-', '_')}" for n, p, i in RULES
)
_rule_rows = " UNION ALL ".join(
    f"SELECT doc_id, lang, source, {text(n)} AS rule, {hits('raw', p, i)} AS hits FROM marked" for n, p, i in RULES
)
_unsure = " UNION ALL ".join(
    f"SELECT {i}::INT AS position, {low}::DOUBLE AS low, {high}::DOUBLE AS high" for i, (low, high) in enumerate(calibration.UNSURE_CANDIDATES)
)
UNSURE = f"""{HALVES},
pairs AS ({_unsure}),
judged AS (SELECT position, low, high, score > low AND score < high AS inside, (score >= 0.5) = (truth = 1) AS right_ FROM pairs, half_a),
bands AS (
  SELECT position, low, high, count(*) FILTER (inside) AS inside, count(*) FILTER (inside) / count(*) AS coverage,
    count(*) FILTER (inside AND right_) * 100 / nullif(count(*) FILTER (inside), 0) AS accuracy_inside,
    count(*) FILTER (NOT inside AND right_) * 100 / nullif(count(*) FILTER (NOT inside), 0) AS accuracy_outside
  FROM judged GROUP BY ALL)"""


def _measure(cutoff: float) -> str:
    said = f"score >= {cutoff}"
    return (
        f"avg(CASE WHEN ({said}) = (truth = 1) THEN 1.0::DOUBLE ELSE 0.0 END) * 100 AS accuracy, "
        f"avg(CASE WHEN {said} THEN 0.0::DOUBLE ELSE 1.0 END) FILTER (truth = 0) AS real_recall, "
        f"avg(CASE WHEN {said} THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (truth = 1) AS fake_recall"
    )


def _compare() -> str:
    runs = [("default", 0.5), ("best accuracy", 0.4), ("most even", 0.45)]
    rows = " UNION ALL ".join(f"SELECT {text(n)} AS name, {c}::DOUBLE AS cutoff, {_measure(c)} FROM half_b" for n, c in runs)
    return f"WITH {HALVES}, runs AS ({rows}) SELECT *, accuracy - (SELECT accuracy FROM runs WHERE name = 'default') AS accuracy_change FROM runs"


_top_two = "(SELECT max(position) AS n, arg_max(position, (accuracy, -position)) AS best, arg_min(position, (abs(real_recall - fake_recall), position)) AS fairest FROM swept)"

SQL = {
    "normalize_headlines": f"WITH {PASTE} SELECT p.id AS doc_id, {norm('headline')} AS headline_key, md5({norm('text')}) AS text_digest FROM paste p JOIN documents d ON d.doc_id = p.id",
    "body_keys": f"WITH {KEYS} SELECT id, k1 AS body_key, k2 AS paste_key FROM keyed",
    "simple_keys": f"WITH {PASTE} SELECT p.id AS doc_id, md5({simple('text')}) AS simple_digest, {simple('headline')} AS simple_key FROM paste p JOIN documents d ON d.doc_id = p.id",
    "build_extracts": f"WITH {PASTE} SELECT id, {extract('body')} AS extract FROM paste",
    "display_headlines": f"WITH {CASCADE} SELECT id, headline, md5(article_text) AS body_digest FROM shown",
    "full_texts": f"WITH {PASTE} SELECT id, length({_TEXT})::INT AS chars, md5({_TEXT}) AS digest FROM paste",
    "clean_text": f"WITH {MARKED} SELECT doc_id, length({clean('raw')})::INT AS chars, md5({clean('raw')}) AS digest FROM marked",
    "fingerprint_counts": f"WITH {MARKED} SELECT doc_id, {_counts} FROM marked",
    "fingerprint_map": f"WITH {MARKED} SELECT doc_id, rule, hits FROM ({_rule_rows}) WHERE hits > 0",
    "fingerprint_survey": f"WITH {MARKED} SELECT lang, source, count(*) AS articles, rule, count(*) FILTER (hits > 0) AS hits, floor(count(*) FILTER (hits > 0) * 100 / count(*))::BIGINT AS percent FROM ({_rule_rows}) GROUP BY lang, source, rule",
    "cleaning_loss": f"WITH {MARKED}, sizes AS (SELECT length(raw) AS r, length({clean('raw')}) AS c FROM marked) SELECT count(*) AS articles, count(*) FILTER (c = 0) AS emptied, sum(r)::BIGINT AS raw_chars, sum(c)::BIGINT AS cleaned_chars, (100 - sum(c) * 100 // greatest(sum(r), 1))::BIGINT AS removed_percent FROM sizes",
    "input_profile": f"WITH {_profile} SELECT doc_id, words::INT AS words, round(la, 3) AS latin_share, round(en, 3) AS english_share, problem FROM profile",
    "input_gate": f"""WITH {_profile} SELECT doc_id, problem AS code, CASE problem WHEN 'empty' THEN {text(wording.EMPTY)}
        WHEN 'too_long' THEN 'That is ' || format('{{:,}}', words) || ' words, and the limit is 400. Please paste the headline and the first few paragraphs.'
        WHEN 'not_english' THEN {text(wording.NOT_ENGLISH)} ELSE {text(wording.NOT_ENGLISH_PROSE)} END AS message FROM profile WHERE problem IS NOT NULL""",
    "gate_summary": f"WITH {_profile} SELECT coalesce(problem, 'accepted') AS code, count(*) AS articles FROM profile GROUP BY 1",
    "too_short_for_model": f"WITH {PASTE}, counted AS (SELECT id, {words(_TEXT)} AS n_words FROM paste) SELECT id, 'too_short_for_model' AS code, {_TOO_SHORT} AS message FROM counted WHERE n_words < 25",
    "corpus_table": f"WITH {CORPUS} SELECT * FROM corpus",
    "basis_descriptions": f"WITH {CORPUS} SELECT id, {rank('label_basis')} AS basis_rank, label_basis = 'fact_check' AS fact_checked, CASE label_basis WHEN 'fact_check' THEN 'fact-checked ' ELSE 'labelled ' END || label || ' by ' || source AS described FROM corpus",
    "held_ranks": f"WITH {CORPUS} SELECT headline_key AS key, min({rank('label_basis')}) AS held_rank FROM corpus GROUP BY 1",
    "corpus_status": f"WITH {CORPUS} SELECT 'total' AS scope, 'all' AS name, count(*) AS articles FROM corpus UNION ALL SELECT 'basis', label_basis, count(*) FROM corpus GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM corpus GROUP BY 2",
    "corpus_top_up": f"""WITH {INCOMING}, cut AS (SELECT *, {extract('body')} AS article_text FROM decided WHERE outcome IN ('added', 'better_evidence'))
        SELECT file_no, pos, substr({strip('headline')}, 1, 1000) AS headline, substr(key, 1, 1000) AS headline_key, article_text,
          substr({opening(norm('article_text'))}, 1, 400) AS body_key, label, source, basis AS label_basis FROM cut""",
    "top_up_outcomes": f"WITH {INCOMING} SELECT pos, file, outcome FROM decided",
    "top_up_report": f"""WITH {INCOMING} SELECT coalesce(file, 'all files') AS file, count(*) AS rows_read,
          count(*) FILTER (outcome IN ('added', 'better_evidence')) AS inserted, count(*) FILTER (outcome = 'added') AS added,
          count(*) FILTER (outcome = 'better_evidence') AS better_evidence, count(*) FILTER (outcome = 'already_had') AS already_had,
          count(*) FILTER (outcome = 'unusable') AS unusable FROM decided GROUP BY ROLLUP (file)""",
    "backfill_keys": f"WITH {CORPUS} SELECT id, {opening(norm('article_text'))} AS body_key FROM corpus",
    "corpus_append": f"""WITH {INCOMING}, fresh AS (
          SELECT row_number() OVER (ORDER BY file_no, pos) + (SELECT max(id) FROM corpus) AS id, substr(key, 1, 1000) AS headline_key, basis AS label_basis
          FROM decided WHERE outcome IN ('added', 'better_evidence'))
        SELECT id, headline_key, label_basis FROM corpus UNION ALL SELECT * FROM fresh""",
    "corpus_two_writers": f"""WITH {INCOMING},
        start AS (SELECT row_number() OVER (ORDER BY id) AS id, headline_key, label_basis FROM corpus),
        second AS ({_inserted('start', 'pos % 3 > 0')}),
        after_second AS (SELECT * FROM start UNION ALL SELECT * FROM second),
        first AS ({_inserted('after_second', 'pos % 3 < 2')})
        SELECT * FROM after_second UNION ALL SELECT * FROM first""",
    "merge_new": f"""WITH {PASTE}, k AS (SELECT *, {norm('headline')} AS key, length(source) = 4 AS old FROM paste)
        SELECT id, headline AS title, source FROM k WHERE old OR key NOT IN (SELECT key FROM k WHERE old)""",
    "labelled_csv_scan": f"""WITH {PASTE} SELECT {norm('headline')} AS key, upper(lang) AS label, 'documents' AS source, 'source' AS basis, md5(body) AS body_digest
        FROM paste WHERE headline <> ''""",
    "headline_lookup": f"WITH {KEYS} SELECT k.id, h.id AS match_id, h.label, h.label_basis FROM keyed k JOIN by_head h ON h.headline_key = k.k0",
    "body_lookup": f"""WITH {KEYS} SELECT k.id, coalesce(a.id, b.id) AS match_id, CASE WHEN a.id IS NULL THEN 1 ELSE 0 END AS door FROM keyed k
        LEFT JOIN by_body a ON a.body_key = k.k1 LEFT JOIN by_body b ON b.body_key = k.k2 WHERE coalesce(a.id, b.id) IS NOT NULL""",
    "cascade": f"WITH {CASCADE} SELECT id, score, label, confidence, method, explanation, matched_on, match_id FROM cascade",
    "cascade_indexed": f"WITH {CASCADE} SELECT id, score, label, confidence, method, explanation, matched_on, match_id FROM cascade",
    "cascade_by_method": f"WITH {CASCADE} SELECT method, label, count(*) AS articles FROM cascade GROUP BY ALL",
    "cascade_without_record": f"""WITH {CASCADE}, own AS (SELECT *, round(greatest(p, 1 - p) * 100, 2) AS conf FROM cascade)
        SELECT id, CASE WHEN p IS NULL THEN score WHEN p > 0.5 THEN trunc(conf)::INT ELSE trunc(100 - conf)::INT END AS score,
          CASE WHEN p IS NULL THEN label WHEN p > 0.5 THEN 'Likely Fake' ELSE 'Likely Real' END AS label,
          CASE WHEN p IS NULL THEN confidence ELSE conf END AS confidence,
          CASE WHEN p IS NULL THEN method ELSE 'ml_prediction' END AS method,
          CASE WHEN p IS NULL THEN explanation ELSE 'Not in our dataset, so the word-counting model read the article itself. It is '
            || conf || '% sure this is ' || CASE WHEN p > 0.5 THEN 'Fake' ELSE 'Real' END || '.' END AS explanation FROM own""",
    "cascade_unavailable": f"""WITH {CASCADE} SELECT CASE WHEN p IS NULL THEN method ELSE 'unavailable' END AS method,
        CASE WHEN p IS NULL THEN label ELSE 'Unknown' END AS label, CASE WHEN p IS NULL THEN score ELSE 0 END AS score, count(*) AS articles FROM cascade GROUP BY ALL""",
    "leak_drop": f"""WITH {PASTE}, k AS (SELECT *, {norm('headline')} AS key, length(source) = 4 AS old FROM paste)
        SELECT id, headline AS title FROM k WHERE NOT old AND (key = '' OR key NOT IN (SELECT key FROM k WHERE old))""",
    "blocklist": f"WITH {PASTE} SELECT DISTINCT {norm('headline')} AS key FROM paste WHERE {norm('headline')} <> ''",
    "diverse_select": f"WITH {FAKES} SELECT id, source, kept, reason FROM selected",
    "diverse_select_reals": f"WITH {REALS} SELECT id, kept, reason FROM selected",
    "rejection_tally": f"WITH {FAKES} SELECT reason, count(*) AS articles FROM selected WHERE NOT kept GROUP BY 1",
    "selection_profile": f"""WITH {FAKES}, per AS (SELECT source, count(*) AS n FROM selected WHERE kept GROUP BY 1)
        SELECT sum(n)::BIGINT AS articles, count(*) AS sites, arg_max(source, (n, source)) AS busiest_site, max(n) AS busiest_articles FROM per""",
    "kept_per_site": f"WITH {FAKES} SELECT source AS counted_site, count(*) AS articles FROM selected WHERE kept GROUP BY 1",
    "target_trim": f"WITH {FAKES} SELECT id, source FROM selected WHERE kept ORDER BY seen, id LIMIT 100",
    "diverse_set_rows": f"""WITH {FAKES} SELECT p.headline AS title, md5(p.body) AS digest, 'FAKE' AS label, p.source AS domain, p.lang AS type
        FROM selected s JOIN paste p USING (id) WHERE kept""",
    "spread_sample": """WITH placed AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS place,
          greatest(1, (SELECT count(*) FROM documents) // 30) AS step FROM documents)
        SELECT doc_id, source FROM placed WHERE place - least(place // step, 29) * step < 4""",
    "stratified_split": """SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42-' || doc_id)) <= floor(count(*) OVER (PARTITION BY lang) * 0.2) AS held FROM documents""",
    "balanced_sample": f"WITH {LABELLED} SELECT id, label FROM labelled QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42-' || id)) <= 50",
    "composition": f"""WITH {LABELLED} SELECT CASE WHEN length(source) = 4 THEN 'teach' ELSE 'exam' END AS collection, count(*) AS articles,
        count(*) FILTER (label = 'FAKE') AS fake, count(*) FILTER (label <> 'FAKE') AS real FROM labelled WHERE {_TEXT} <> '' GROUP BY 1""",
    "cutoff_candidates": f"WITH {_candidates(calibration.SWEEP_CANDIDATES)} SELECT * FROM candidates",
    "cutoff_sweep": f"WITH {SWEEP} SELECT * FROM swept",
    "fixed_ladder_sweep": f"WITH {FINE} SELECT * FROM swept",
    "choose_cutoff": f"WITH {SWEEP} SELECT arg_max(cutoff, (accuracy, -position)) AS best, arg_min(cutoff, (abs(real_recall - fake_recall), position)) AS fairest FROM swept",
    "tradeoff_table": f"""WITH {SWEEP}, top AS {_top_two},
        spots AS (SELECT round_even((n - 1) * i / 11, 0)::INT + 1 AS position FROM top, range(12) t(i) UNION SELECT best FROM top UNION SELECT fairest FROM top)
        SELECT s.*, CASE WHEN s.position = best THEN 'best accuracy' WHEN s.position = fairest THEN 'most even' ELSE '' END AS mark
        FROM swept s JOIN spots USING (position), top""",
    "verdict_stats": f"""WITH {HALVES} SELECT 0.4::DOUBLE AS score_above, {percent('(score > 0.4) = (truth = 1)')} AS accuracy,
        {percent('truth = 1', 'score > 0.4')} AS fake_precision, {percent('score > 0.4')} AS fake_coverage,
        {percent('truth = 0', 'score <= 0.4')} AS real_precision, {percent('score <= 0.4')} AS real_coverage, count(*) AS measured_on FROM half_b""",
    "cutoff_metrics": f"WITH {HALVES} SELECT 0.4::DOUBLE AS cutoff, {_measure(0.4)} FROM half_b",
    "flag_band": f"""WITH {_candidates(calibration.FLAG_CANDIDATES)},
        flagged AS (SELECT position, cutoff, count(*) FILTER (score > cutoff) AS n, count(*) FILTER (score > cutoff AND truth = 1) AS good
          FROM candidates, half_a GROUP BY ALL),
        tested AS (SELECT *, good / n >= 0.75 AS ok FROM flagged WHERE n >= 50),
        start_ AS (SELECT max(position) AS at FROM tested WHERE ok),
        stop_ AS (SELECT coalesce(max(position), 0) AS at FROM tested, start_ WHERE NOT ok AND position < start_.at)
        SELECT min(cutoff) AS score_above FROM tested, stop_, start_ WHERE ok AND position > stop_.at AND position <= start_.at""",
    "band_stats": f"""WITH {HALVES} SELECT 0.4::DOUBLE AS score_above, {percent('truth = 1', 'score > 0.4')} AS precision, {percent('score > 0.4')} AS coverage,
        {percent('truth = 0', 'score <= 0.4')} AS below_band_real, {percent('score <= 0.4')} AS below_band_coverage, count(*) AS measured_on FROM half_b""",
    "unsure_bands": f"WITH {UNSURE} SELECT * FROM bands",
    "unsure_band": f"""WITH {UNSURE} SELECT * FROM bands WHERE inside >= 50 AND coverage <= 0.20 AND accuracy_inside < 75
        AND accuracy_outside > accuracy_inside ORDER BY coverage DESC, position LIMIT 1""",
    "unsure_stats": f"""WITH {HALVES}, told AS (SELECT {BAND[0]}::DOUBLE AS low, {BAND[1]}::DOUBLE AS high,
          {percent(f'score > {BAND[0]} AND score < {BAND[1]}')} AS coverage,
          {percent('(score >= 0.5) = (truth = 1)', f'score > {BAND[0]} AND score < {BAND[1]}')} AS accuracy_inside,
          {percent('(score >= 0.5) = (truth = 1)', f'NOT (score > {BAND[0]} AND score < {BAND[1]})')} AS accuracy_outside,
          round_even(avg(CASE WHEN score > {BAND[0]} AND score < {BAND[1]} THEN 1.0::DOUBLE ELSE 0.0 END) * 1000, 0)::INT AS searches_per_1000_articles,
          count(*) AS measured_on FROM half_b)
        SELECT *, trunc(500 / greatest(coverage, 0.1) * 100)::INT AS articles_per_day FROM told""",
    "compare_cutoffs": _compare(),
    "sorting_score": f"""WITH {EXAM}, ranked AS (SELECT truth, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM exam)
        SELECT (sum(r) FILTER (truth = 1) - count(*) FILTER (truth = 1) * (count(*) FILTER (truth = 1) + 1) / 2)
          / (count(*) FILTER (truth = 1)) / (count(*) FILTER (truth = 0)) AS sorting_score FROM ranked""",
    "classification_report": f"""WITH {EXAM}, p AS (SELECT truth, CASE WHEN score >= 0.4 THEN 1 ELSE 0 END AS said FROM exam),
        classes AS (SELECT y, count(*) FILTER (truth = y AND said = y) AS hit, count(*) FILTER (said = y) AS said_, count(*) FILTER (truth = y) AS is_
          FROM p, (SELECT unnest([0, 1]) AS y) GROUP BY y),
        per AS (SELECT y, CASE y WHEN 0 THEN 'REAL' ELSE 'FAKE' END AS name, hit / said_ AS precision, hit / is_ AS recall, 2 * hit / (said_ + is_) AS f1, is_ AS support FROM classes),
        overall AS (SELECT count(*) FILTER (truth = said) / count(*) AS a, count(*) AS n FROM p)
        SELECT name, precision, recall, f1, support FROM per
        UNION ALL SELECT 'accuracy', a, a, a, n FROM overall
        UNION ALL SELECT 'macro avg', sum(precision * 0.5::DOUBLE ORDER BY y), sum(recall * 0.5::DOUBLE ORDER BY y), sum(f1 * 0.5::DOUBLE ORDER BY y), any_value(n) FROM per, overall
        UNION ALL SELECT 'weighted avg', sum(precision * (support / n) ORDER BY y), sum(recall * (support / n) ORDER BY y), sum(f1 * (support / n) ORDER BY y), any_value(n) FROM per, overall""",
    "history": f"WITH {CASCADE} SELECT id, headline, md5(article_text) AS article_digest, score, result_label, confidence, method, matched_headline FROM shown",
    "history_web": f"""WITH {CASCADE}, {REPLIES}, asked AS (SELECT id, method,
          CASE WHEN method <> 'reading_model' THEN NULL WHEN p > {BAND[0]} AND p < {BAND[1]} THEN 'unsure' WHEN id % 11 = 0 THEN 'requested' END AS reason FROM cascade)
        SELECT id, method, reason AS web_reason, CASE WHEN reason IS NOT NULL THEN coalesce(status, 'unavailable') END AS web_status,
          CASE WHEN reason IS NOT NULL THEN verdict END AS web_verdict
        FROM asked LEFT JOIN web ON conv_id = id AND turn = 0""",
    "history_total": f"WITH {CASCADE} SELECT count(*) AS total FROM shown",
    "dashboard": f"""WITH {CASCADE}, c AS (SELECT count(*) AS total, count(*) FILTER (result_label = 'Likely Real') AS real_count,
          count(*) FILTER (result_label = 'Likely Fake') AS fake_count, count(*) FILTER (result_label = 'Not Sure') AS unsure_count FROM shown)
        SELECT *, round(real_count * 100 / total, 1) AS real_pct, round(fake_count * 100 / total, 1) AS fake_pct, round(unsure_count * 100 / total, 1) AS unsure_pct FROM c""",
    "chart_series": f"""WITH {CASCADE}, series AS (SELECT * FROM (VALUES ('verdict', 0, 'Likely Real', 'Likely Real'), ('verdict', 1, 'Likely Fake', 'Likely Fake'),
          ('verdict', 2, 'Not Sure', 'Not Sure'), ('method', 0, 'Database Match', 'database'), ('method', 1, 'Reading Model', 'reading_model'),
          ('method', 2, 'Word-Counter', 'ml_prediction')) v(chart, position, label, code))
        SELECT chart, position, label, count(s.id) AS articles FROM series
          LEFT JOIN shown s ON code = CASE chart WHEN 'verdict' THEN result_label ELSE method END GROUP BY ALL""",
    "recent_20": f"""WITH {CASCADE}, n AS (SELECT *, row_number() OVER (ORDER BY analyzed_at, id) AS row_number FROM shown)
        SELECT row_number, id, headline, result_label, strftime(analyzed_at, '%b %-d, %Y') AS shown_date FROM n ORDER BY row_number DESC LIMIT 20""",
    "delete_analyses": f"WITH {CASCADE} SELECT id, method FROM shown WHERE id NOT IN (SELECT doc_id FROM labels)",
    "web_queue": f"""WITH {EXAM}, wanted AS (
          SELECT e.event_id AS id, ts, x.score > {BAND[0]} AND x.score < {BAND[1]} AS unsure, event_type = 'signup' AS asked
          FROM events e JOIN exam x ON x.event_id = e.event_id WHERE event_type <> 'error')
        SELECT id, CASE WHEN unsure THEN 'unsure' ELSE 'requested' END AS reason,
          row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, id)::INT AS turn, turn <= 50 AS within_allowance FROM wanted WHERE unsure OR asked""",
    "web_replies": f"WITH {REPLIES} SELECT * FROM web",
    "disagreement": f"""WITH {REPLIES} SELECT conv_id, turn, coalesce(status = 'found' AND ((verdict = 'REAL' AND conv_id % 2 = 0) OR (verdict = 'FAKE' AND conv_id % 2 = 1)), FALSE) AS disagrees FROM web""",
    "experiment_sizes": f"""WITH {TAUGHT}, other AS (SELECT * FROM (VALUES ('first', 'second'), ('second', 'first')) v(t, e)),
        parts AS (SELECT t || ' -> ' || e AS split, 'teach' AS part, label_binary FROM other JOIN taught ON collection = t
          UNION ALL SELECT t || ' -> ' || e, 'exam', label_binary FROM other JOIN taught x ON collection = e
          WHERE key = '' OR NOT EXISTS (SELECT 1 FROM taught y WHERE y.collection = t AND y.key = x.key))
        SELECT split, part, label_binary, count(*) AS articles FROM parts GROUP BY ALL""",
    "tfidf_vocabulary": f"""WITH {TAUGHT}, uses AS (SELECT id, unnest(regexp_extract_all(lower(cleaned), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM taught),
        terms AS (SELECT term, count(DISTINCT id) AS articles, count(*) AS uses FROM uses GROUP BY term ORDER BY uses DESC, term LIMIT 50000)
        SELECT term, articles, uses, ln(((SELECT count(*) FROM taught) + 1.0::DOUBLE) / (articles + 1.0::DOUBLE)) AS idf FROM terms""",
    "emptied_rows": f"""WITH {LABELLED}, {MARKED}, texts AS (
          SELECT label = 'FAKE' AS fake, {strip("' ' || CASE WHEN id % 7 = 0 THEN 'www.example.com/a' ELSE raw END")} AS t FROM labelled JOIN marked ON doc_id = id)
        SELECT fake::INT AS label_binary, count(*) AS articles, count(*) FILTER ({clean('t')} <> '') AS kept FROM texts WHERE t <> '' GROUP BY 1""",
    "ablation_piles": f"""WITH {TAUGHT}, piles AS (
          SELECT CASE WHEN collection = 'second' THEN 'exam' WHEN source < 'src5' THEN 'base' ELSE 'extra' END AS pile, * FROM taught),
        used AS (SELECT * FROM piles WHERE pile <> 'extra' OR label_binary = 1)
        SELECT pile, label_binary, count(*) AS articles FROM used u
        WHERE pile <> 'exam' OR key = '' OR NOT EXISTS (SELECT 1 FROM used k WHERE k.pile <> 'exam' AND k.key = u.key) GROUP BY ALL""",
    "corpus_reset": f"""WITH {CORPUS}, incoming AS (
          SELECT CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS file_no, id AS pos, {norm('headline')} AS key,
            CASE source WHEN 'src3' THEN 'fact_check' WHEN 'src5' THEN 'hearsay' ELSE 'source' END AS basis FROM paste),
        ranked AS (SELECT *, {rank('basis')} AS r, min({rank('basis')}) OVER (PARTITION BY key ORDER BY file_no, pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM incoming WHERE key <> '')
        SELECT row_number() OVER (ORDER BY file_no, pos) AS id, substr(key, 1, 1000) AS headline_key, basis AS label_basis
        FROM ranked WHERE earlier IS NULL OR r < earlier""",
    "score_store": f"WITH {EXAM} SELECT event_id::VARCHAR AS title, truth::INT AS label_binary, score FROM exam",
    "raw_crawl": f"""WITH {PASTE} SELECT id::VARCHAR AS id, lang AS type, source AS domain, headline AS title, md5(body) AS content_digest
        FROM paste WHERE id % 10 <> 0""",
}


# --- learning by whole-number sums ------------------------------------------------

_WORDS = "regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def _linear(teach: str, exam: str, before: str = TAUGHT) -> str:
    """CTEs up to weights(arm, term, w) and scored(arm, id, y, score). teach: arm, id, y, c, words; exam: arm, id, y, words."""
    return f"""WITH RECURSIVE {before},
teach AS MATERIALIZED ({teach}), exam_rows AS MATERIALIZED ({exam}),
held AS MATERIALIZED (SELECT arm, id, y, c, term, count(*) AS uses FROM (SELECT arm, id, y, c, unnest(words) AS term FROM teach WHERE c > 0) GROUP BY ALL),
sizes AS (SELECT arm, sum(c) AS n FROM teach GROUP BY arm),
used AS (SELECT arm, term, sum(c * uses) AS u, sum(c) AS articles FROM held GROUP BY arm, term
  QUALIFY row_number() OVER (PARTITION BY arm ORDER BY sum(c * uses) DESC, term) <= {linear.MAX_FEATURES}),
vocab AS MATERIALIZED (SELECT arm, term, floor((ln((1 + n)::DOUBLE / (1 + articles)::DOUBLE) + 1) * {1 << linear.RARITY} + 0.5::DOUBLE)::BIGINT AS rarity
  FROM used JOIN sizes USING (arm)),
unit AS (SELECT arm, id, y, c, term, floor(t * {1 << linear.VALUE}::DOUBLE / sqrt(sum(t::DOUBLE * t::DOUBLE) OVER (PARTITION BY arm, id)) + 0.5::DOUBLE)::BIGINT AS x
  FROM (SELECT arm, id, y, c, term, (uses * rarity)::BIGINT AS t FROM held JOIN vocab USING (arm, term))),
feat AS MATERIALIZED (SELECT * FROM unit UNION ALL SELECT arm, id, y, c, '', {1 << linear.VALUE} FROM teach WHERE c > 0),
bound AS MATERIALIZED (SELECT arm, term, 0.25::DOUBLE * sum(c * x * s)::DOUBLE / {1 << 2 * linear.VALUE}::DOUBLE + (term <> '')::INT AS d
  FROM feat JOIN (SELECT arm, id, sum(x)::BIGINT AS s FROM feat GROUP BY ALL) USING (arm, id) GROUP BY arm, term),
fit AS (SELECT 0 AS k, arm, term, 0::BIGINT AS w, 0::BIGINT AS z FROM bound
  UNION ALL
  SELECT k + 1, arm, term, w2, floor(w2 + k::DOUBLE / (k + 3)::DOUBLE * (w2 - w) + 0.5::DOUBLE)::BIGINT FROM (
    SELECT f.k, arm, term, f.w, floor(f.z - (g / {1 << linear.VALUE}::DOUBLE + f.z * (term <> '')::INT) / d + 0.5::DOUBLE)::BIGINT AS w2
    FROM fit f JOIN bound USING (arm, term) JOIN (
      SELECT arm, term, sum(c * r * x)::DOUBLE AS g FROM feat JOIN (
        SELECT arm, id, floor((1 / (1 + exp(-sum(z * x)::DOUBLE / {1 << linear.VALUE + linear.WEIGHT}::DOUBLE)) - y) * {1 << linear.WEIGHT}::DOUBLE + 0.5::DOUBLE)::BIGINT AS r
        FROM feat JOIN fit USING (arm, term) GROUP BY arm, id, y) USING (arm, id) GROUP BY arm, term) USING (arm, term)
    WHERE f.k < {linear.STEPS})),
weights AS MATERIALIZED (SELECT arm, term, w FROM fit WHERE k = {linear.STEPS}),
seen AS (SELECT arm, id, y, term, count(*) AS uses FROM (SELECT arm, id, y, unnest(words) AS term FROM exam_rows) GROUP BY ALL),
seen_unit AS (SELECT arm, id, term, floor(t * {1 << linear.VALUE}::DOUBLE / sqrt(sum(t::DOUBLE * t::DOUBLE) OVER (PARTITION BY arm, id)) + 0.5::DOUBLE)::BIGINT AS x
  FROM (SELECT arm, id, term, (uses * rarity)::BIGINT AS t FROM seen JOIN vocab USING (arm, term))),
margins AS (SELECT arm, id, sum(x * w) AS m FROM seen_unit JOIN weights USING (arm, term) GROUP BY ALL),
scored AS (SELECT e.arm, e.id, e.y, 1 / (1 + exp(-(coalesce(m, 0) + b.w * {1 << linear.VALUE})::DOUBLE / {1 << linear.VALUE + linear.WEIGHT}::DOUBLE)) AS score
  FROM exam_rows e JOIN weights b ON b.arm = e.arm AND b.term = '' LEFT JOIN margins g ON g.arm = e.arm AND g.id = e.id)"""


_W = _WORDS.format(text="cleaned")
_NEW = "key = '' OR NOT EXISTS (SELECT 1 FROM taught k WHERE {of} AND k.key = x.key)"
_ONE = f"SELECT 'first' AS arm, id, label_binary AS y, 1 AS c, {_W} AS words FROM taught WHERE collection = 'first'"
_SECOND = f"SELECT 'first' AS arm, id, label_binary AS y, {_W} AS words FROM taught x WHERE collection = 'second' AND ({_NEW.format(of=chr(39).join(['k.collection = ', 'first', '']))})"
_TICKET = "md5('{seed}-' || id)"


def _runs(wanted: int, trimmed: bool) -> str:
    """The ablation's arms, with the exam scored by each."""
    pool = f"old AND label_binary = {wanted}" + (" AND source IN ('src0', 'src1')" if trimmed else "")
    rank = "row_number() OVER (PARTITION BY pooled ORDER BY {t})"
    arms = {"A": "old::INT", "B": "(old OR new)::INT", "C": "old::INT + copied::INT"} | ({"D": "(old AND NOT dropped)::INT"} if trimmed else {})
    marked = f"""{TAUGHT}, flagged AS (SELECT *, collection = 'first' AND source < 'src5' AS old,
        collection = 'first' AND source >= 'src5' AND label_binary = {wanted} AS new FROM taught),
      pooled AS (SELECT *, {pool} AS pooled FROM flagged),
      counted AS (SELECT count(*) FILTER (new) AS n_new, count(*) FILTER (pooled) AS n_pool FROM pooled),
      drawn AS MATERIALIZED (SELECT p.*, pooled AND {rank.format(t=_TICKET.format(seed=42))} <= least(n_new, n_pool) AS copied,
        pooled AND {rank.format(t=_TICKET.format(seed=43))} <= greatest(least(n_new, n_pool - 1), 0) AS dropped FROM pooled p, counted)"""
    teach = " UNION ALL ".join(f"SELECT '{a}' AS arm, id, label_binary AS y, {c} AS c, {_W} AS words FROM drawn" for a, c in arms.items())
    exam = f"""SELECT arm, id, label_binary AS y, {_W} AS words FROM drawn x, (VALUES {', '.join(f"('{a}')" for a in arms)}) v(arm)
      WHERE collection = 'second' AND (key = '' OR NOT EXISTS (SELECT 1 FROM drawn k WHERE (k.old OR k.new) AND k.key = x.key))"""
    return _linear(teach, exam, marked)


_ABLATION = """, ranked AS (SELECT arm, y, score, rank() OVER (PARTITION BY arm ORDER BY score) + (count(*) OVER (PARTITION BY arm, score) - 1) / 2 AS r FROM scored)
  SELECT arm AS run, any_value(n)::BIGINT AS n_train, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2)
    / (count(*) FILTER (y = 1)) / (count(*) FILTER (y = 0)) * 100, 6) AS sorting, avg(((score > 0.5)::INT = y)::INT) * 100 AS accuracy
  FROM ranked JOIN sizes USING (arm) GROUP BY arm"""

_SPLITS = f"""{TAUGHT}, split AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY label_binary ORDER BY md5('42-' || id))
    <= floor(count(*) OVER (PARTITION BY label_binary) * 0.2) AS test FROM taught)"""
_VERSIONS = (("raw", "raw"), ("clean", "cleaned"))
_SPLIT_TEACH = " UNION ALL ".join(
    f"SELECT '{name}|{version}' AS arm, id, label_binary AS y, ({of})::INT AS c, {_WORDS.format(text=text)} AS words FROM split"
    for version, text in _VERSIONS
    for name, of in (("shuffled", "NOT test"), ("first -> second", "collection = 'first'"), ("second -> first", "collection = 'second'"))
)
_SPLIT_EXAM = " UNION ALL ".join(
    f"SELECT '{name}|{version}' AS arm, id, label_binary AS y, {_WORDS.format(text=text)} AS words FROM split x WHERE {of}"
    for version, text in _VERSIONS
    for name, of in (
        ("shuffled", "test"),
        ("first -> second", f"""collection = 'second' AND ({_NEW.format(of="k.collection = 'first'")})"""),
        ("second -> first", f"""collection = 'first' AND ({_NEW.format(of="k.collection = 'second'")})"""),
    )
)
_OLD_NEW = " UNION ALL ".join(
    f"SELECT '{arm}' AS arm, id, label_binary AS y, ({of})::INT AS c, {_W} AS words FROM taught"
    for arm, of in (("1", "collection = 'first' AND source < 'src5'"), ("2", "collection = 'first'"))
)
_OLD_NEW_EXAM = f"""SELECT arm, id, label_binary AS y, {_W} AS words FROM taught x, (VALUES ('1'), ('2')) v(arm)
  WHERE collection = 'second' AND ({_NEW.format(of="k.collection = 'first'")})"""

SQL |= {
    "linear_scores": _linear(_ONE, f"SELECT 'first' AS arm, id, label_binary AS y, {_W} AS words FROM taught")
    + " SELECT s.id, collection, label_binary, round(score, 6) AS fake_score FROM scored s JOIN taught t ON t.id = s.id",
    "linear_train_eval": _linear(_ONE, _SECOND)
    + """, p AS (SELECT y AS truth, (score > 0.5)::INT AS said FROM scored),
        classes AS (SELECT v.y, count(*) FILTER (truth = v.y AND said = v.y) AS hit, count(*) FILTER (said = v.y) AS said_, count(*) FILTER (truth = v.y) AS is_
          FROM p, (SELECT unnest([0, 1]) AS y) v GROUP BY v.y),
        per AS (SELECT y, CASE y WHEN 0 THEN 'REAL' ELSE 'FAKE' END AS name, coalesce(hit / nullif(said_, 0), 0) AS precision, coalesce(hit / nullif(is_, 0), 0) AS recall,
          coalesce(2 * hit / nullif(said_ + is_, 0), 0) AS f1, is_ AS support FROM classes),
        overall AS (SELECT count(*) FILTER (truth = said) / count(*) AS a, count(*) AS n FROM p)
        SELECT name, precision, recall, f1, support FROM per
        UNION ALL SELECT 'accuracy', a, a, a, n FROM overall
        UNION ALL SELECT 'macro avg', sum(precision * 0.5::DOUBLE ORDER BY y), sum(recall * 0.5::DOUBLE ORDER BY y), sum(f1 * 0.5::DOUBLE ORDER BY y), any_value(n) FROM per, overall
        UNION ALL SELECT 'weighted avg', sum(precision * (support / n) ORDER BY y), sum(recall * (support / n) ORDER BY y), sum(f1 * (support / n) ORDER BY y), any_value(n) FROM per, overall""",
    "linear_top_terms": _linear(f"SELECT 'all' AS arm, id, label_binary AS y, 1 AS c, {_W} AS words FROM taught", f"SELECT 'all' AS arm, id, label_binary AS y, {_W} AS words FROM taught WHERE false")
    + """, told AS (SELECT term, w AS weight FROM weights WHERE term <> '')
        SELECT * FROM (SELECT term, weight, 'REAL' AS leans FROM told ORDER BY weight, term LIMIT 20)
        UNION ALL SELECT * FROM (SELECT term, weight, 'FAKE' AS leans FROM told ORDER BY weight DESC, term LIMIT 20)""",
    "linear_experiment": _linear(_SPLIT_TEACH, _SPLIT_EXAM, _SPLITS)
    + """ SELECT split_part(arm, '|', 1) AS split, split_part(arm, '|', 2) AS version, count(*) FILTER ((score > 0.5)::INT = y) AS hits, count(*) AS articles,
        hits * 100.0::DOUBLE / articles AS accuracy FROM scored GROUP BY arm""",
    "linear_ablation_fakes": _runs(1, False) + _ABLATION,
    "linear_ablation_reals": _runs(0, True) + _ABLATION,
    "ablation_trimmed_rows": _runs(0, True) + " SELECT id, source, label_binary FROM drawn WHERE old AND NOT dropped",
    "model_registry": _linear(_OLD_NEW, _OLD_NEW_EXAM)
    + """, ranked AS (SELECT arm, y, score, rank() OVER (PARTITION BY arm ORDER BY score) + (count(*) OVER (PARTITION BY arm, score) - 1) / 2 AS r FROM scored),
        told AS (SELECT arm::BIGINT AS version, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2)
          / (count(*) FILTER (y = 1)) / (count(*) FILTER (y = 0)) * 100, 6) AS figure FROM ranked GROUP BY arm)
        SELECT version, figure, lag(figure) OVER (ORDER BY version) AS before,
          CASE WHEN before IS NULL THEN NULL WHEN figure - before < 0 THEN 'worse' WHEN figure - before < 1 THEN 'no real gain' ELSE 'better' END AS decision,
          (SELECT count(DISTINCT term) FROM held WHERE arm = '2') AS terms, (SELECT n FROM sizes WHERE arm = '2')::BIGINT AS training_samples FROM told""",
    "cutoff_record": f"""WITH {SWEEP}, pick AS (SELECT arg_max(cutoff, (accuracy, -position)) AS best, arg_min(cutoff, (abs(real_recall - fake_recall), position)) AS fairest FROM swept)
        SELECT any_value(best) AS cutoff, 'best accuracy on a held-out half of the exam' AS chosen_for, round(avg(((score >= best) = (truth = 1))::INT) * 100, 2) AS accuracy,
          round(avg((score < best)::INT) FILTER (truth = 0), 3) AS real_recall, round(avg((score >= best)::INT) FILTER (truth = 1), 3) AS fake_recall,
          (SELECT count(*) FROM half_a) AS cutoff_chosen_on, count(*) AS measured_on, 'cross_source' AS evaluation, any_value(fairest) AS alternative_even_cutoff FROM half_b, pick""",
    "dataset_registry": f"""WITH {PASTE}, parts AS (SELECT *, id % 3 AS part FROM paste WHERE headline <> '')
        SELECT part - 1 AS file_no, CASE part WHEN 1 THEN 'True.csv' ELSE 'fake_or_real_news.csv' END AS file, {norm('headline')} AS key,
          CASE WHEN part = 1 OR id % 2 = 1 THEN 'REAL' ELSE 'FAKE' END AS label, CASE part WHEN 1 THEN 'Kaggle ISOT' ELSE 'McIntire' END AS source,
          'source' AS basis, md5(body) AS body_digest FROM parts WHERE part > 0""",
    "csv_positions": f"WITH {PASTE} SELECT row_number() OVER (ORDER BY id) AS pos, id, md5(body) AS body_digest FROM paste",
}

# turns do not depend on the batches in which verdicts arrive
SQL["web_queue_stream"] = SQL["web_queue"]
